"""Periodic runs, the prefix trie of conversations, and repeated byte strings, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hustings.llm import periodic, repeats, trie

# Periodic runs


def _plant(words, rng):
    n = len(words)
    a = rng.randrange(n)
    p = 1 + (n - a) // rng.randrange(2, 9)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for n, letters in [(7, 2), (60, 1), (90, 2), (150, 3), (400, 40), (300, 500)]:
        for _ in range(40):
            words = _plant([rng.randrange(letters) for _ in range(n)], rng)
            if rng.random() < 0.5:
                words[rng.randrange(n)] = -5
            assert periodic.find_runs(np.array(words), n) == periodic.brute_force(words)


def test_runs_at_the_least_length_of_each_scale():
    for q in [1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65]:
        base = list(range(q))
        for length in (4 * q - 1, 4 * q, 4 * q + 1):
            words = [-9, *(base[i % q] for i in range(length)), -8]
            want = [(1, 1 + length, q)] if length >= max(6, 4 * q) else []
            assert periodic.find_runs(np.array(words), len(words)) == want


def test_runs_of_nested_periods():
    inner = [1] * 9 + [2]
    words = inner * 5 + [3]
    assert periodic.find_runs(np.array(words), len(words)) == periodic.brute_force(words)
    assert (0, 50, 10) in periodic.brute_force(words)


def _collapse(words, runs):
    gone = {i for a, b, q in runs for i in range(a + q, b)}
    return [w for i, w in enumerate(words) if i not in gone]


RUN_DOCS = [(i, t) for i, t in enumerate(["a b " * 40, "", "x", None, " \t\n", "one\x0btwo\x0cthree " * 30, "no runs in this text at all", "la la la la la", "la la la la la la", "é è " * 12 + "end", ("w%d " * 50 % tuple(range(50))) * 6])]


def test_periodic_runs_of_documents(spark):
    rng = random.Random(9)
    rows = RUN_DOCS + [(100 + k, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 300)))) for k in range(150)] + [(None, "z " * 9), (7, RUN_DOCS[7][1])]
    rows.append((900, " ".join(f"t{i % 700}" for i in range(9000)) + " " + " ".join(f"u{i}" for i in range(70_000))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("x")).withColumn("id", F.lit(1))
    got = sorted(map(tuple, periodic.periodic_runs(docs).collect()), key=str)
    want = []
    for name, text in rows:
        words = (text or "").encode().split()
        runs = [(0, 9000, 700)] if name == 900 else periodic.brute_force(words)
        want.append((name, len(words), [(a, b - a, q) for a, b, q in runs], b" ".join(_collapse(words, runs)).decode()))
    assert [(a, b, [tuple(x) for x in c], d) for a, b, c, d in got] == sorted(want, key=str)
    assert periodic.periodic_runs(docs.where("false")).count() == 0


def test_op11_plants_and_digests(spark, tmp_path):
    rng = random.Random(4)
    rows = RUN_DOCS + [(100 + k, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 400)))) for k in range(250)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in periodic.op11_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for name, text in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(name).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        runs = periodic.brute_force(words)
        best = max(runs, key=lambda r: ((r[1] - r[0]) / r[2], -r[0], -r[2]), default=None)
        row = got[name]
        assert row.n_runs == len(runs) and row.runs_sha256 == periodic.digest(runs)
        assert row.collapsed_sha256 == hashlib.sha256(b" ".join(_collapse(words, runs))).hexdigest()
        assert (row.start, row.length, row.period, row.exponent_milli) == ((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4)
    assert planted > 10 and len(got) == len(rows)


# Repeated byte strings


def _texts(rng, count):
    word = lambda: "".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(40) for _ in range(4)]
    out = []
    for _ in range(count):
        kind = rng.randrange(7)
        if kind == 0 and out:
            out.append(rng.choice(out))
        elif kind == 1 and out:
            text = list(rng.choice(out))
            for _ in range(rng.randrange(1, 6)):
                text.insert(rng.randrange(len(text) + 1), "#")
            out.append("".join(text))
        elif kind == 2:
            out.append(prose(rng.randrange(5)) + rng.choice(passages) + prose(rng.randrange(5)) + rng.choice(passages))
        elif kind == 3:
            out.append(rng.choice("ab") * rng.randrange(0, 400) + word() + "xy" * rng.randrange(0, 120))
        else:
            out.append(prose(rng.randrange(0, 90)))
    return out


@pytest.mark.parametrize("length,gram,hot", [(100, 32, 20_000), (100, 32, 3), (40, 9, 20_000), (33, 32, 5)])
def test_repeats_equal_brute_force(spark, length, gram, hot):
    rng = random.Random(length + hot)
    rows = list(enumerate(_texts(rng, 120))) + [(500, ""), (501, "short"), (502, "é" * 49 + "ab"), (503, "é" * 300)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([*rows, (504, None)], "doc_id long, text string").withColumns({"id": F.lit("x"), "tie": F.lit(0)}).repartition(5)
    got = {r.id: ([tuple(s) for s in r.spans], bytes(r.kept)) for r in repeats.without_repeats(docs, length, gram, hot=hot).collect()}
    want = repeats.brute_force([(k, t.encode()) for k, t in rows] + [(504, b"")], length)
    assert got == want


def test_repeats_of_equal_ids_nulls_and_nothing(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij") for _ in range(300))
    rows = [(1, text), (1, text), (2, text + "!"), (None, text[:150]), (3, "q" + text), (3, "r" + text[:120])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.id, r.n_bytes, len(r.kept)) for r in repeats.without_repeats(docs).collect()]
    by = sorted((x for x in got if x[0] in (None, 1, 2)), key=str)
    # The null id is first; both copies of document 1 are one document and lose what the null one holds.
    assert by == [(1, 300, 150), (1, 300, 150), (2, 301, 1), (None, 150, 150)]
    assert sorted(x[1:] for x in got if x[0] == 3) == [(121, 1), (301, 1)]
    assert repeats.without_repeats(docs.where("false")).count() == 0


def test_repeats_in_a_text_longer_than_a_piece(spark):
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 123, 3 * repeats.PIECE + 500, dtype=np.uint8)
    for k, at in enumerate((repeats.PIECE - 70, 2 * repeats.PIECE - 150, 3 * repeats.PIECE + 100)):
        raw[at : at + 170] = raw[1000:1170]
        raw[at - 1], raw[at + 170] = 48 + k, 58 + k  # no letter beside it goes on matching
    docs = spark.createDataFrame([(1, raw.tobytes().decode())], "doc_id long, text string")
    spans = [tuple(s) for s in repeats.without_repeats(docs).first().spans]
    assert spans == [(repeats.PIECE - 70, 170), (2 * repeats.PIECE - 150, 170), (3 * repeats.PIECE + 100, 170)]


def test_refinement_drops_suffixes_alone_in_their_bucket():
    text = np.array([[1, 2, 3, 4, 5, 9], [1, 2, 3, 4, 5, 8]], np.uint64)
    pointer = repeats.refine(text, np.ones(text.shape, bool), 1, 4)
    assert (pointer[0, :2] == pointer[1, :2]).all() and (pointer[:, :2] >= 0).all() and (pointer[:, 2:] == -1).all()


# Prefix trie


def brute_trie(rows):
    """The contract's rows by plain dictionaries; rows: conv, turn, role, text with distinct turns."""
    convs = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs.setdefault(conv, []).append((role or "", text or ""))
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = convs.get(c - int(np.fmod(c, 5)), [])
        made[c] = tuple(base[:h] + own[h:])
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children = {k: sum(1 for x in nodes if len(x) == len(k) + 1 and x[:-1] == k) for k in nodes}
    out = []
    for k, members in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        ends = ",".join(str(c) for c in sorted(members) if made[c] == k)
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children[k], sum(children[x] == 0 for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def _conversations(rng, count):
    starts = [[("user", "hello")], [("user", "hello"), ("assistant", "é" * 3)], [(None, None)], [("user", "")]]
    rows = []
    for c in rng.sample(range(-20, 4 * count), count):
        turns = list(rng.choice(starts)) + [(rng.choice(["user", "assistant"]), rng.choice("abc")) for _ in range(rng.randrange(0, 14))]
        at = sorted(rng.sample(range(100), len(turns)))
        rows += [(c, None if k == 0 and rng.random() < 0.3 else t, *turn) for k, (t, turn) in enumerate(zip(at, turns))]
    return rows


def test_op12_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = _conversations(rng, 60) + [(None, 1, "user", "nobody's")] + [(1000, k, "user", f"turn {k % 7}") for k in range(70)] + [(1001, k, "user", f"turn {k % 7}") for k in range(40)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit("x"), "conv": F.lit(1), "name": F.lit("n")})
    docs.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, trie.op12_prefix_trie(spark, str(tmp_path)).collect()))
    assert got == brute_trie(rows)


def test_turns_of_a_huge_conversation_are_numbered_over_parts(spark):
    rng = random.Random(8)
    rows = [(5, k, "user", str(k)) for k in range(3000)] + [(c, k, "user", str(k)) for c in (1, 4, 6, 9) for k in range(4)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = trie.numbered(docs).join(docs.select(F.xxhash64("role", "text").alias("a"), F.col("conv_id").alias("conv"), "turn"), ["a", "conv"])
    assert got.count() == len(rows) and got.where("depth <> turn + 1").count() == 0


def test_trie_of_nothing_repeats_and_turnless_conversations(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert trie.op12_prefix_trie(spark, f"{tmp_path}/none").count() == 0
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    spark.createDataFrame([(c, 1, "user", "x"), (c, 1, "user", "x")], schema).write.parquet(f"{tmp_path}/one/conversations.parquet")
    empty = hashlib.sha256(str(c).encode()).hexdigest()
    assert list(map(tuple, trie.op12_prefix_trie(spark, f"{tmp_path}/one").collect())) == [(c, 0, None, 1, 0, 1, 0, empty)]
    rows = trie.numbered(spark.createDataFrame([(1, 1, "user", "x"), (1, 1, "user", "x"), (1, 1, "user", "y"), (2, None, None, None)], schema))
    nodes, names = trie.prefix_trie(rows, rows.groupBy("conv").agg(F.count("*").alias("size")))
    assert nodes.count() == 5 and names.count() == 6


def test_ends_in_several_pieces(spark, monkeypatch):
    convs = list(range(-50, 10_000, 3))
    ends = spark.createDataFrame([(2, 7, c) for c in convs] + [(3, 7, 1)], "depth long, name long, conv long").repartition(4)
    got = {r.depth: r.digest for r in trie.end_digests(ends).collect()}
    assert got == {2: hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest(), 3: hashlib.sha256(b"1").hexdigest()}

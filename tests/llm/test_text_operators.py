"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hustings.llm import bpe, hmm, jaccard, licences, ordinal, packing, quality
from hustings.llm.components import connected_components

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, component string, tail string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{rng.integers(vocabulary)}" for _ in range(n))


TEXTS = [
    (1, "The cat sat on the mat. The cat sat on the mat.\nThe cat sat on the mat.\nÉcole über\t naïve  x"), (2, None), (3, ""), (4, "   \n\t "), (5, "word"), (6, "it's we'll 123 <|endoftext|> !!  \n\n  z"),
    (7, prose(1, 300)), (8, prose(1, 300)), (9, prose(1, 295) + " changed a few words here"), (10, prose(2, 5000)), (10, prose(2, 5000)), (11, " " * 3000 + "a" * 40_000 + prose(3, 9000) + " " * 2000),
    (12, "Released under the MIT License. Apache license, GNU General Public License; mit license"), (13, "MIT\nLICENSE"), (None, prose(4, 60)), (14, "日本語 テキスト 🎉 " * 20), (15, "one two"), (16, "one two"), (17, "a b c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i and i % 2 else None, "s", 0, "r", "i", "c", "t") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).checkpoint()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_the_library_and_decodes_back(docs, empty):
    done = bpe.decode(bpe.encode(docs, RANKS, chunk=2048, overlap=128), RANKS).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.raw)) for r in done) == Counter((i, tuple(bpe.brute(t, RANKS)[0]), (t or "").encode()) for i, t in TEXTS)
    assert bpe.encode(empty, RANKS).count() == 0


def test_chunks_resynchronise_only_where_sure():
    text = "x'll yes  no" * 50
    own = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    head, tail = bpe.boundaries(text[:100], public_tokenizers.PATTERN, 20, 80, False)
    starts = {m.start() for m in __import__("regex").finditer(public_tokenizers.PATTERN, text)}
    assert set(head) <= starts and set(tail) <= starts and tail
    assert own.decode(own.encode_ordinary(text)) == text


def shingles(text, n):
    w = [x.translate(LOWER) for x in words(text)]
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked(texts, n, a, b):
    """Brute-force component of each row: the least id reachable, rows of equal sets being one."""
    sets = [shingles(t, n) for _, t in texts]
    group = list(range(len(texts)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for x in range(len(texts)):
        for y in range(x):
            if sets[x] and sets[y] and b * len(sets[x] & sets[y]) >= a * len(sets[x] | sets[y]):
                group[root(x)] = root(y)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(texts)]


def joined(docs, **how):
    members, classes, _ = jaccard.jaccard_join(docs, **how)
    return Counter((r["id"], r["size"], r["component"]) for r in jaccard.labelled(members, classes).collect())


def test_jaccard_components_equal_brute_force(docs, empty):
    assert joined(docs, n=3, numerator=90) == Counter(linked(TEXTS, 3, 90, 100))
    assert jaccard.jaccard_join(empty, n=3)[0].count() == 0


def test_jaccard_on_chains_and_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 10)  # both ways to a leader
    rng = np.random.default_rng(5)
    texts = []
    for g in range(4):
        base = [f"g{g}x{k}" for k in range(120)]
        for c in range(25):
            own = list(base)
            for _ in range(rng.integers(0, 5)):
                own[rng.integers(120)] = f"e{rng.integers(30)}"
            texts.append((len(texts), " ".join(own)))
    chain = [f"c{k}" for k in range(140)]
    texts += [(len(texts) + k, " ".join(chain[2 * k : 2 * k + 100])) for k in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4).checkpoint()
    assert joined(docs, n=5, numerator=80) == Counter(linked(texts, 5, 80, 100))
    kept = {r.doc_id for r in jaccard.first_of_each(docs).collect()}
    assert kept == {c for _, _, c in linked(texts, 5, 80, 100)}


def test_jaccard_links_rows_without_ids_and_rows_of_one_id(spark):
    base = [f"b{k}" for k in range(100)]
    texts = [
        (5, " ".join(base)), (None, " ".join([*base, "one"])), (None, " ".join([*base[:96], "x", "y"])), (9, " ".join([*base[:92], "x", "y"])),
        (5, prose(31, 80)), (5, prose(31, 80)), (None, prose(32, 90)), (None, prose(32, 89)), (7, prose(33, 70)), (7, ""), (None, None), (None, None),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert joined(docs, n=3, numerator=90) == Counter(linked(texts, 3, 90, 100))
    kept = jaccard.first_of_each(docs, n=3, numerator=90).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(5, texts[0][1]), (5, texts[4][1]), (7, texts[8][1]), (7, ""), (None, None)]) + Counter((r.doc_id, r.text) for r in kept if r.doc_id is None and r.text)
    assert sum(r.doc_id is None and bool(r.text) for r in kept) == 1


@pytest.mark.parametrize(("crowd", "numerator"), [(2000, 80), (3, 80), (3, 90), (1, 67)])
def test_jaccard_whole_join_finds_every_pair(spark, monkeypatch, crowd, numerator):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    rng = np.random.default_rng(8)
    base = [f"z{k}" for k in range(90)]
    texts = []
    for i in range(40):
        own = list(base)
        for _ in range(rng.integers(0, 4)):
            own[rng.integers(90)] = f"q{rng.integers(20)}"
        texts.append((i, " ".join(own[: rng.integers(70, 91)])))  # sizes differ
    texts += [(40, "a b c"), (41, "a b c d"), (42, "a b c d e"), (43, "a"), (44, "a b")]
    members, _, links = jaccard.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string"), n=3, numerator=numerator, whole=True)
    name = {r["set"]: shingles(texts[r["id"]][1], 3) for r in members.collect()}
    found = {frozenset((name[r.a], name[r.b])): r.overlap for r in links.collect()}
    sets = list({shingles(t, 3) for _, t in texts})
    want = {frozenset((a, b)): len(a & b) for k, a in enumerate(sets) for b in sets[:k] if 100 * len(a & b) >= numerator * len(a | b)}
    assert found == want and len(found) > 5


def test_components_of_stars_chains_and_none(spark):
    rows = [(1, 2), (2, 3), (9, 3), (20, 21), (21, 20), (30, 30), *((100, k) for k in range(101, 140))]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, **dict.fromkeys(range(100, 140), 100)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_first_of_each_keeps_columns_and_empty_sets(docs):
    kept = jaccard.first_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert {2, 3, 4, 7, 10, None} <= set(ids)
    assert ids.count(10) == 1 and 8 not in ids and 16 not in ids and ids.count(None) == 1
    assert kept.where("row = 'r' and id = 'i' and component = 'c' and tail = 't'").count() == len(ids)


def brute_quality(text):
    w = words(text)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_brute_force(docs, empty):
    rows = quality.judge(quality.measure(docs)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == Counter((i, *brute_quality(t)) for i, t in TEXTS)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)
    assert all(not r.kept for r in rows if r.base_failed)
    assert quality.measure(empty).count() == 0
    assert quality.keep(docs).columns == docs.columns


def test_quality_distance_parts_prose_from_symbols(spark):
    clean = "the men of the town and the women in the fields came to see that a house is on the hill. " * 1
    clean = " ".join(f"{clean}{chr(97 + k)}nd then more people walked by number {chr(97 + k)}{chr(97 + k)}." for k in range(12))
    junk = " ".join(f"w{k % 7}***{k}### $$$%%%" for k in range(200))
    found = {r.doc_id: r for r in quality.judge(quality.measure(spark.createDataFrame([(1, clean, "en"), (2, junk, "en"), (3, junk, "xx")], "doc_id long, text string, lang string"))).collect()}
    assert found[1].character_distance < 0.2 < 0.3 < found[2].character_distance
    assert not found[2].kept and found[3].character_distance is None


def test_quality_words_count_whatever_their_case_and_edges(spark):
    plain = " ".join(f"the x{k} of y{k} and z{k} to w{k}" for k in range(20))
    odd = plain.replace("the", "The").replace("of", "(of").replace("and", "AND,").replace("to", '"to;"')
    rows = quality.measure(spark.createDataFrame([(1, plain, "en"), (2, odd, "en"), (3, " ".join(f"v{k}" for k in range(160)), "en")], "doc_id long, text string, lang string")).collect()
    assert rows[0].word_distance == rows[1].word_distance != rows[2].word_distance


def test_quality_equals_its_sql(spark, tmp_path):
    texts = [
        None, "", "the", "The the THE, (of) 'a' " * 30, "«Le» la, de. " * 40, " ".join(f"Der w{k}; und die \u0130{k}" for k in range(40)),
        " ".join(f"El x{k} y \"los\" z{k}. Que" for k in range(40)), " ".join(f"no{k} common{k}" for k in range(60)), "a\n\nb\na\n" * 20,
    ]
    rows = [(k, text, lang) for k, (text, lang) in enumerate((t, x) for t in texts for x in ("en", "fr", "de", "es", None))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(quality.ORACLES["op3_quality_rules"])
    names = [x[0] for x in want.description]
    found = quality.op3_quality_rules(spark, str(tmp_path))
    assert sorted(found.columns) == sorted(names)
    assert {tuple(r[x] for x in names) for r in found.collect()} == set(want.fetchall())


def test_licences_equal_brute_force(docs, empty):
    rows = licences.scan(docs).collect()
    brute = {}
    for i, t in TEXTS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        brute[i] = len(w), {label: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p, label in licences.PHRASES.items()}
    for r in rows:
        assert (r.n_words, {x: list(r[x]) for x in ("mit", "apache", "gpl")}) == brute[r.id]
    noticed = {r.id: set(r.noticed) for r in rows}
    assert "mit" in noticed[12] and not noticed[7] and all(0 <= r.score <= 1 for r in rows)
    assert licences.scan(empty).count() == 0


def test_licences_need_the_key_phrase_and_alignment(spark):
    full = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    mixed = " ".join(sorted(full.split()))
    docs = spark.createDataFrame([(1, "x y z " + full), (2, mixed), (3, "Licensed under CC BY-NC 4.0."), (4, full)], "doc_id long, text string")
    found = {r.id: (set(r.noticed), r.score) for r in licences.scan(docs).collect()}
    assert found[1] == ({"mit"}, 1.0) and found[4] == ({"mit"}, 1.0) and found[2] == (set(), 0.0) and found[3][0] == {"cc-by-nc"}


def test_licences_by_identifier_and_whole_text(spark):
    mit = next(text for label, text, _ in licences.NOTICES if label == "mit" and len(text) > 600)
    texts = ["# SPDX-License-Identifier: MIT", "// SPDX-License-Identifier: Apache-2.0\ncode", "SPDX-License-Identifier: LGPL-2.1-only", f"intro {mit} outro", "the identifier of a license is not mit", "spdx license mit identifier"]
    found = {r.id: set(r.noticed) for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {0: {"mit"}, 1: {"apache"}, 2: {"lgpl"}, 3: {"mit"}, 4: set(), 5: set()}


def test_licences_equal_the_sql(spark, tmp_path):
    rng = np.random.default_rng(9)
    parts = [text.split() for _, text, _ in licences.NOTICES]
    texts = [None, "", " . ", *(text for _, text in TEXTS)]
    for _ in range(120):  # notices with words lost, changed or in another order, several in one text
        chosen = [list(parts[rng.integers(len(parts))]) for _ in range(rng.integers(1, 4))]
        for words_ in chosen:
            for _ in range(rng.integers(0, 1 + len(words_) // 3)):
                at = rng.integers(len(words_))
                words_[at] = ("other", "license", words_[rng.integers(len(words_))])[rng.integers(3)]
            if rng.random() < 0.2:
                del words_[rng.integers(len(words_))]
        texts.append(" ".join(" ".join(["foo"] * rng.integers(3) + x) for x in chosen))
    texts += ["person source code terms"] * 40 + [" ".join(parts[0] * 500)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(licences.ORACLES["op9_licence_scan"])
    names = [x[0] for x in want.description]
    rows = sorted(want.fetchall(), key=lambda x: x[0])
    found = licences.op9_licence_scan(spark, str(tmp_path))
    assert sorted(found.columns) == sorted(names)
    assert sorted((tuple(r[x] for x in names) for r in found.collect()), key=lambda x: x[0]) == rows
    assert sum(r[names.index("score")] > 0 for r in rows) > 60


def test_hmm_equals_the_plain_recursion():
    rng = np.random.default_rng(1)
    k, b = 3, 7
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(b), k).T)
    lengths = [1, 5, 64, 65, 130, 300]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    seen = rng.integers(0, b, offsets[-1])
    got = hmm.likelihood(model, seen, offsets)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((b, k))
    hmm.expect(model, seen, offsets, start, move, emit)
    s2, m2, e2 = np.zeros(k), np.zeros((k, k)), np.zeros((b, k))
    for i in range(len(lengths)):
        x = seen[offsets[i] : offsets[i + 1]]
        alpha, scale = np.zeros((len(x), k)), np.zeros(len(x))
        for t, o in enumerate(x):
            a = (model.start if t == 0 else alpha[t - 1] @ model.move) * model.emit[o]
            scale[t] = a.sum()
            alpha[t] = a / scale[t]
        assert got[i] == pytest.approx(np.log10(scale).sum())
        beta = np.ones((len(x), k))
        for t in range(len(x) - 2, -1, -1):
            beta[t] = model.move @ (model.emit[x[t + 1]] * beta[t + 1]) / scale[t + 1]
        gamma = alpha * beta
        s2 += gamma[0]
        np.add.at(e2, x, gamma)
        for t in range(len(x) - 1):
            m2 += np.outer(alpha[t], model.emit[x[t + 1]] * beta[t + 1]) * model.move / scale[t + 1]
    assert np.allclose(start, s2) and np.allclose(move, m2) and np.allclose(emit, e2)


def test_hmm_base_scores_and_gain(spark, docs, empty, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(hmm, "PAIR_ROUNDS", 3)
    monkeypatch.setattr(hmm, "KNOWN", 50)  # most words take the join
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2
    rows = hmm.score(docs, training, states=2, rounds=1).collect()
    held = {i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in TEXTS}
    tokens = [(i, [x.translate(LOWER) for x in words(t)] + [None]) for i, t in TEXTS]
    counts = Counter(w for i, ws in tokens if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held[i], len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert hmm.score(empty, training, states=2, rounds=1).count() == 0


def ids_of(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_packing_holds_every_id_once(docs, empty):
    rows = packing.pack(docs, RANKS, length=64, keep_ids=True, added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))).collect()
    want = Counter()
    for i, t in TEXTS:
        ids = ids_of(t)
        want += Counter((i, k, len(part := ids[k : k + 64]), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids), tuple(part)) for k in range(0, len(ids), 64))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, tuple(r.ids)) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty, RANKS).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_column_generation_packs_tightly(seed):
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(1, 1024, 300))
    demand = rng.integers(1, 60, len(sizes))
    rows = packing.plan(sizes, demand, 1024)
    room = Counter()
    for size, low, high, sequence, _ in rows:
        for k in range(high - low):
            room[sequence + k] += size
    assert max(room.values()) <= 1024
    assert Counter({int(s): int(n) for s, n in zip(sizes, demand)}) == Counter({s: n for s, n in ((s, sum(h - w for z, w, h, *_ in rows if z == s)) for s in {r[0] for r in rows})})
    assert len(room) <= 1.06 * max((sizes @ demand) / 1024, demand[sizes > 512].sum()) + 2


def test_knapsack_equals_enumeration():
    sizes, values = np.array([2, 3, 5]), np.array([0.3, 0.5, 0.81])
    value, counts = packing.best_pattern(values, sizes, 11)
    best = max(a * 0.3 + b * 0.5 + c * 0.81 for a in range(6) for b in range(4) for c in range(3) if 2 * a + 3 * b + 5 * c <= 11)
    assert value == pytest.approx(best) and counts @ sizes <= 11 and counts @ values == pytest.approx(best)


def test_ordinal_grades_and_edge_cases(spark, docs, empty):
    rng = np.random.default_rng(0)
    rows, ratings = [], []
    for i in range(600):
        grade = int(rng.integers(3))
        mark = {0: " vile" * 2, 1: " dull" * 2, 2: ""}[grade]
        rows.append((i, prose(100 + i, 40) + mark))
        ratings.append((i, grade if i % 2 else None))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    rated = spark.createDataFrame(ratings, "doc_id long, grade int")
    model = ordinal.fit(frame, rated, 3)
    assert list(model.thresholds) == sorted(model.thresholds)
    held = {r.doc_id: r for r in ordinal.grade(frame, model).collect() if r.doc_id % 2 == 0}
    top = {i for i in held if rows[i][1][-1] not in "el"}
    assert np.mean([(held[i].tail >= 0.5) == (i in top) for i in held]) > 0.97
    none = ordinal.fit(frame, rated.where("grade > 5"), 3)
    assert ordinal.select(docs, none).count() == len(TEXTS)
    assert set(ordinal.grade(docs, model).columns) == set(docs.columns) | {"expected_grade"}
    assert ordinal.grade(empty, model).count() == 0


def test_ordinal_slopes_equal_numeric_ones():
    rng = np.random.default_rng(4)
    scores, grades, cuts = rng.normal(size=30), rng.integers(0, 4, 30), np.array([-1.0, 0.2, 1.5])
    _, in_scores, in_cuts = ordinal.slopes(scores, grades, cuts)
    step = 1e-6

    def change(x, k, f):
        up, down = x.copy(), x.copy()
        up[k] += step
        down[k] -= step
        return (f(up) - f(down)) / (2 * step)

    assert np.allclose(in_scores, [change(scores, k, lambda x: ordinal.slopes(x, grades, cuts)[0]) for k in range(30)], atol=1e-5)
    assert np.allclose(in_cuts, [change(cuts, k, lambda x: ordinal.slopes(scores, grades, x)[0]) for k in range(3)], atol=1e-5)


def test_ordinal_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows, ratings = [(900, None), (901, ""), (902, "a " * 9000)], []
    for i in range(240):
        bad = i % 3 == 0
        rows.append((i, prose(i, 50, 60) + (" Zebra zebra" if bad else " Ok") * (1 + i % 2)))
        ratings += [(i, int(not bad), int(i % 12 == 0))] * (1 + i % 2)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ratings, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = ordinal.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), ordinal.graded(spark.read.parquet(f"{tmp_path}/labels.parquet")), 3)
    import pyarrow as pa

    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    found = {r.doc_id: r for r in ordinal.op6_ordinal_quality(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        own = {f for _, _, _, fs in ordinal.features(pa.record_batch([pa.array([text], pa.string())], ["text"]), "text") for f in fs.tolist()}
        score = sum(weight.get(f, 0.0) for f in own)
        below = [1 / (1 + math.exp(score - t)) for t in model.thresholds]
        chance = [below[0], below[1] - below[0], 1 - below[1]]
        assert found[i].tail == pytest.approx(chance[2]) and found[i].expected_grade == pytest.approx(chance[1] + 2 * chance[2]) and found[i].selected == (found[i].tail >= 0.5)
    assert np.mean([found[i].selected == (i % 3 != 0) for i in range(240)]) > 0.95


def test_ordinal_select_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "x", 0.25, 7.0, "z")], "doc_id long, text string, tail double, expected_grade double, in_0 string")
    model = ordinal.fit(docs, spark.createDataFrame([], "doc_id long, grade int"), 3)
    assert [tuple(r) for r in ordinal.select(docs, model).collect()] == [(1, "x", 0.25, 7.0, "z")]


def test_sha_columns_of_the_query(spark, tmp_path):
    spark.createDataFrame([(1, "Hello  world"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in bpe.op1_bpe(spark, str(tmp_path)).collect()}
    ids, digest, raw = bpe.brute("Hello  world", RANKS)
    assert (rows[1].n_tokens, rows[1].ids_sha256, rows[1].decoded_sha256) == (len(ids), digest, raw)
    assert (rows[2].n_tokens, rows[2].ids_sha256) == (0, hashlib.sha256(b"").hexdigest())


def test_bpe_resynchronises_after_a_long_word(spark):
    text = prose(41, 3000) + " " + "q" * 3000 + " " + prose(42, 9000) + "z" * 900 + " end" * 400
    docs = spark.createDataFrame([(1, text), (1, text), (2, "y" * 30_000 + " a b c" * 3000)], "doc_id long, text string")
    rows = docs.selectExpr("monotonically_increasing_id() AS row", "doc_id AS id", "text AS body")
    cut = bpe.pieces(bpe.chunks(rows, "body", 1024, 64), public_tokenizers.PATTERN, 1024, 64).collect()
    first = sorted((r for r in cut if r.row == min(x.row for x in cut if x.id == 1)), key=lambda r: r.piece_no)
    assert "".join(r.body for r in first) == text and len(first) > 0.85 * len(text) / 1024 and max(len(r.body) for r in first) < 6 * 1024
    done = bpe.encode(docs, RANKS, chunk=1024, overlap=64).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in done) == Counter((r.doc_id, tuple(bpe.brute(r.text, RANKS)[0])) for r in docs.collect())


def test_hmm_first_model_climbs_and_finds_blocks():
    rng = np.random.default_rng(3)
    emit = np.zeros((12, 2))
    emit[:6, 0], emit[6:, 1] = 1 / 6, 1 / 6
    state, seen = 0, []
    for _ in range(20_000):
        state = state if rng.random() < 0.9 else 1 - state
        seen.append(rng.choice(12, p=emit[:, state]))
    pairs = np.bincount(np.array(seen[:-1]) * 12 + np.array(seen[1:]), minlength=144).reshape(12, 12).astype(float)
    _, move, found, climbs = hmm.fit_pairs(pairs, 2)
    assert np.all(np.diff(climbs[:20]) > -1e-3 * abs(climbs[0]))
    groups = found.argmax(axis=1)
    assert len(set(groups[:6])) == len(set(groups[6:])) == 1 and groups[0] != groups[6] and move.diagonal().min() > 0.8


def test_hmm_score_equals_a_plain_forward_pass(spark, monkeypatch):
    from pyspark.sql import functions as F

    kept = []
    monkeypatch.setattr(hmm, "KNOWN", 30)
    plain = hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a: kept.append((a[2], plain(*a))) or kept[-1][1])
    texts = [(i, prose(i, 30 + 40 * (i % 4), 60) + (" only%d" % i) * (i % 3)) for i in range(30)] + [(30, None), (31, "unseen words")]
    rows = hmm.score(spark.createDataFrame(texts, "doc_id long, text string"), F.col("doc_id") < 25, states=3, rounds=2).collect()
    words_of, model = kept[0]
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)
    import pyarrow as pa

    hashes = {i: next(hmm.sequences(pa.record_batch([pa.array([t], pa.string())], ["text"])))[2] for i, t in texts}
    counts = Counter(h for i, hs in hashes.items() if i < 25 for h in hs.tolist())
    mass, kinds, bucket = Counter(), Counter(), {}
    for hs in hashes.values():
        for h, b in zip(hs.tolist(), words_of.look(hs)[0].tolist()):
            bucket[h] = b
    for h, c in counts.items():
        mass[bucket[h]] += c
        kinds[bucket[h]] += 1
    for r in rows:
        total, p = 0.0, model.start
        for h in hashes[r.doc_id].tolist():
            b = bucket[h]
            a = p * model.emit[b]
            inside = (counts[h] + 1) / (mass[b] + kinds[b] + 1) if hmm.OWN <= b < hmm.OWN + hmm.SHARED else 1.0
            total += math.log10(a.sum() * inside)
            p = a / a.sum() @ model.move
        assert r.score == pytest.approx(total, rel=1e-9)


@pytest.mark.parametrize("gap", ["\n\n", "\n\t", "  \n", "\n" * 6])
def test_bpe_cuts_no_text_behind_white_space(spark, gap):
    rows = [(k, "word " * 6 + "x" * k + "foo." + gap + "Bar baz, " * 12 + gap + "end. " * 30) for k in range(64)]
    done = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, chunk=64, overlap=32).collect()
    assert {r.doc_id: list(r.ids) for r in done} == {i: bpe.brute(t, RANKS)[0] for i, t in rows}


def test_packing_gives_added_tokens_the_ids_of_the_library(spark, tmp_path):
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>\n\n x<|endoftext|>", "<|endoftext", "plain  text", "x \n<|endoftext|>\n y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert want[0][:-1] == [64, 220, 50256, 275]
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packing.op8_packing(spark, str(tmp_path)).collect()}
    assert got == {i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in want.items()}


def test_licences_of_a_file_with_many_notices(spark):
    every = " ".join(text for _, text, _ in licences.NOTICES)
    bundled = " ".join(licences.NOTICES[k][1] for k in (1, 6, 9))
    found = {r.id: (set(r.noticed), r.score) for r in licences.scan(spark.createDataFrame([(1, bundled), (2, every)], "doc_id long, text string")).collect()}
    assert found[1] == ({"mit", "bsd", "mpl"}, 1.0)
    assert found[2] == ({label for label, _, _ in licences.NOTICES}, 1.0)


def test_quality_word_distance_alone_rejects(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k, (lang, (_, common)) in enumerate(quality.REFERENCES.items()):
        plain = ["".join(rng.choice(list("bcdfglmnprt"), 6)) for _ in range(120)]
        mixed = [list(common)[n // 3 % len(common)] if n % 3 == 0 else w for n, w in enumerate(plain)]
        rows += [(2 * k, " ".join(plain) + ".", lang), (2 * k + 1, " ".join(mixed) + ".", lang)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in quality.judge(quality.measure(docs)).collect()}
    assert {i for i, r in found.items() if r.kept} == {1, 3, 5, 7}
    assert all(not r.base_failed and r.character_distance <= quality.MAX_CHARACTER_DISTANCE for r in found.values())
    assert {r.doc_id for r in quality.keep(docs).collect()} == {1, 3, 5, 7}

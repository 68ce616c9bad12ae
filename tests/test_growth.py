"""Steps whose work must not outgrow their input."""

import random
import time

from pyspark.sql import functions as F

from hustings.operators import match


def test_pairs_in_range_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(k % 3, k, rng.choice([rng.uniform(-20, 20), float(rng.randrange(-9, 9))]), float(rng.randrange(-6, 6))) for k in range(300)]
    rows += [(0, 1000 + k, 0.0, 0.0) for k in range(3)] + [(0, 2000, 4.3, 6.0), (0, 2001, 5.0, -6.0), (0, 2002, float("inf"), 0.0), (0, 2003, float("nan"), 0.0), (None, 2004, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "grp int, id int, top double, cx double")
    for low, high, across in ((4.3, 5.0, 6), (0.0, 5.0, 0), (3.0, 3.0, 2.5)):
        want = sorted((g, i, j) for g, i, t, c in rows for h, j, u, e in rows if g is not None and g == h and low <= u - t <= high and abs(e - c) <= across)
        assert sorted(tuple(r) for r in match.pairs_in_range(df, "grp", low, high, across).collect()) == want and want


def test_pairs_in_range_doesnt_pair_copies_one_by_one(spark):
    """200,000 copies of a place at a height that reaches the bins of two others: once 4 * 10^10 pairs to look at."""
    copies = spark.range(200_000).select(F.lit(1).alias("grp"), "id", F.lit(0.0).alias("top"), F.lit(0.0).alias("cx"))
    others = spark.createDataFrame([(1, -1, 4.5, 0.0), (1, -2, -4.5, 3.0)], "grp int, id bigint, top double, cx double")
    start = time.monotonic()
    assert match.pairs_in_range(copies.unionByName(others), "grp", 4.3, 5.0, 6).count() == 400_000
    assert time.monotonic() - start < 60


def test_pairs_in_range_spreads_crowded_places_over_tasks_and_passes_rows_on_list_by_list(spark):
    """Two places of 2500 segments: once all pairs were one task's, and a pair of lists (10^6 rows) was held as a whole."""
    segments = spark.range(5000).select(F.lit(1).alias("grp"), F.when(F.col("id") < 4999, F.col("id")).alias("id"), (F.col("id") % 2 * 4.5).alias("top"), F.lit(0.0).alias("cx"))
    pairs = match.pairs_in_range(segments, "grp", 4.3, 5.0, 6)
    tasks = pairs.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.count("below").alias("known"), F.sum("id").alias("ids"), F.sum("below").alias("belows"))
    rows = tasks.collect()
    assert [sum(r[k] for r in rows) for k in ("n", "known", "ids", "belows")] == [2500 * 2500, 2500 * 2499, 2500 * sum(range(0, 5000, 2)), 2500 * sum(range(1, 4999, 2))]
    assert len(rows) > 3  # of nine pairs of lists
    plan = tasks._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    steps = [x.split("Generate")[0] for x in plan.splitlines() if any(f"Generate explode({y}ids#" in x for y in ("_", "", "transform("))]
    assert len(steps) == 2 and "*(" in steps[0] and "*(" not in steps[1]  # only the inner loop is part of a generated one


def test_a_pair_of_short_names_is_compared_once(monkeypatch):
    from hustings.functions import text

    asked = []
    monkeypatch.setattr(text.difflib, "SequenceMatcher", lambda _, a, b: asked.append((a, b)) or __import__("types").SimpleNamespace(ratio=lambda: 0.5))
    text._kept.cache_clear()
    assert [text.ratio("once", "twice") for _ in range(50)] == [0.5] * 50 and len(asked) == 1
    assert [text.ratio("x" * 300, "y") for _ in range(3)] == [0.5] * 3 and len(asked) == 4  # long texts aren't kept
    text._kept.cache_clear()


def test_many_contests_are_assigned_at_once_and_names_compared_once(monkeypatch):
    import itertools

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    cost = rng.integers(0, 30, (60, 4, 5)).astype(float)
    chosen = match.best_assignments(cost)
    for one, own in zip(cost, chosen, strict=True):
        assert len(set(own)) == 4 and one[range(4), own].sum() == min(one[range(4), list(p)].sum() for p in itertools.permutations(range(5), 4))
    asked = []
    monkeypatch.setattr(match, "ratio", lambda a, b: asked.append((a, b)) or float(len(a) + len(b)))
    lists = lambda *sizes: pa.array([["n%d" % (k % 3) for k in range(n)] for n in sizes])
    left, right = lists(4, 2, 4, 1).slice(1), lists(5, 5, 5, 2).slice(1)
    like = match._alike(left.flatten(), right.flatten())
    seen = {(r, c) for i, j in match._shapes(left, right) for k in range(len(i)) for r in i[k] for c in j[k] if (like(i, j[:, :1]) == 4).all()}
    assert seen == {(r, c) for r in range(2) for c in range(5)} | {(r, c) for r in range(2, 6) for c in range(5, 10)} | {(6, c) for c in (10, 11)}
    asked.clear()
    many = pa.array(["a", "b", None] * 1000)
    got = match._alike(many, many)(np.arange(3000)[:, None], np.arange(300)[None, :])
    assert sorted(asked) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")] and np.isnan(got).sum() == 3000 * 300 - 2000 * 200


def test_fuzzy_match_keeps_columns_and_missing_values(spark):
    rows = spark.createDataFrame([("c", 1, "ALI", 5, "x"), ("c", 2, None, 9, "y"), ("c", 3, "SITI", None, "z"), (None, 4, "ALI", 5, "w"), ("d", 5, "ALI", 5, "v")], "k string, row int, name string, votes int, note string")
    candidates = spark.createDataFrame([("c", "p", "SITI", 5), ("c", "q", "ALI", None), ("c", "r", None, 6), (None, "s", "ALI", 5)], "k string, candidate_id string, name string, votes int")
    df = match.fuzzy_match(rows, candidates, "k")
    assert df.columns == ["k", "row", "name", "votes", "note", "candidate_id", "ratio"]
    assert "Window" not in df._jdf.queryExecution().toString()  # pairs aren't sorted
    got = {r["row"]: (r.candidate_id, r.note, r.ratio) for r in df.collect()}
    assert got == {1: ("p", "x", got[1][2]), 2: ("p", "y", None), 3: ("p", "z", 1.0)} and 0 < got[1][2] < 1


def test_folding_has_no_class_of_all_characters_and_equals_unicodedata(spark):
    import unicodedata

    from hustings.functions import text

    several = "".join({**text._tables(text._ascii)[2], **text._tables(text._unmarked)[2]})
    texts = [several, "plain", "a½b́\nﬁn", "각한글 가x", "\U00100000\U00100001½", "", None, "Île " + "x" * 500 + "㎏", "日本語が"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.fold_ascii(F.col("t")).alias("a"), text.strip_marks(F.col("t")).alias("m"))
    assert "\\x{BC}" not in df._jdf.queryExecution().toString()  # tried one by one at every letter
    for r in df.collect():
        if r.t is not None:
            assert r.a == unicodedata.normalize("NFKD", r.t).encode("ascii", "ignore").decode()
            assert r.m == "".join(c for x in r.t for c in unicodedata.normalize("NFD", x) if not "̀" <= c <= "ͯ")
        else:
            assert r.a is None and r.m is None


def test_overlays_collapse_without_python_and_equal_a_plain_loop(spark):
    from hustings.functions import parsing

    def plain(text):
        lines = text.split("\n")
        half = len(lines) // 2
        if half and len(lines) % 2 == 0 and lines[:half] == lines[half:]:
            lines = lines[:half]
        lines = [x for k, x in enumerate(lines) if k == 0 or x != lines[k - 1]]
        single = lambda w: w[::2] if len(w) > 2 and len(w) % 2 == 0 and w[::2] == w[1::2] else w
        return "\n".join(" ".join(map(single, x.split(" "))) for x in lines)

    rng = random.Random(2)
    texts = ["", "\n", "\n\n", "aa", "aaaa", "aabbcc xx", "ééßß😀😀 x", "aab\r\r \r\raa", "$$\\\\ $$$$", "aabb\n", " aabb  aabb ", "a" * 40001, "ab" * 30000, "aabb" * 20000, None]
    texts += ["".join(rng.choice(["aa", "bb", "a", " ", "\n", "\n\n", "  ", "\t\t"]) for _ in range(rng.randrange(14))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parsing.collapse_overlay(F.col("t")).alias("c"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r.c for r in df.collect()] == [None if t is None else plain(t) for t in texts]


def test_a_long_list_comes_in_parts(spark):
    from hustings.sources import payloads

    texts = [("p", 0, '[{"id": "a"}, {"id": "b"}]'), ("p", 2, '{"changes": [{"id": "c"}, 7]}'), ("q", 0, "[1")]
    elements, issues = payloads.lists(spark.createDataFrame(texts, "path string, first bigint, text string"), "id string", "changes")
    assert sorted((r.ordinal, r.element and r.element.id) for r in elements.collect()) == [(0, "a"), (1, "b"), (2, "c"), (3, None)]
    assert [(r.path, r.reason) for r in issues.collect()] == [("q", "not_json")]


def test_the_normalised_forms_share_one_fold_without_patterns_between_words(spark):
    import re
    import unicodedata

    from hustings.functions import text

    forms = {"upper": text.upper_with_spaces, "upper_packed": text.upper_no_spaces, "lower": text.lower_with_spaces, "packed": text.lower_no_spaces, "slug": text.slug}
    rng = random.Random(7)
    texts = ["", " ", "--", "<>", "><<>> <b>x</b>", "a<>b><c", "\x00a\x00\x7f\x00b", "a\n\r\n\tb\n", "É—è  d'Île", "a日b 日", "½ﬁ", "\U0002f800\U0002fa1dx", "\U0001d400 😀", "W.P. 12"]
    texts += ["".join(rng.choice(["a", "Z", "9", " ", "  ", "<", ">", "-", "\n", "é", "ß", "日", "½", "각", "\U0002f801", "_"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts + [None]], "t string").select("t", *[f(F.col("t")).alias(k) for k, f in forms.items()], text.strip_marks(F.col("t")).alias("marks"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE(t, [^" not in plan and "[^A-Z0-9]+" not in plan and "[^a-z0-9]+" not in plan  # one pattern after the other over every text
    for r in df.collect():
        if r.t is None:
            assert set(r) == {None}
            continue
        words = re.findall("[a-z0-9]+", unicodedata.normalize("NFKD", r.t).encode("ascii", "ignore").decode().lower())
        want = {"upper": " ".join(words).upper(), "upper_packed": "".join(words).upper(), "lower": " ".join(words), "packed": "".join(words), "slug": "-".join(words)}
        assert {k: r[k] for k in want} == want, r.t
        assert r.marks == "".join(c for x in r.t for c in unicodedata.normalize("NFD", x) if not "̀" <= c <= "ͯ")
    broken = spark.range(1).select(F.unhex(F.lit("61804220C3A9")).cast("string").alias("t")).select(text.upper_with_spaces(F.col("t")).alias("u"))
    assert broken.collect()[0].u == "AB E"  # a byte that is no UTF-8 is no letter

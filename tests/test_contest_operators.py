"""Hand-made edge frames: ties, uncontested and empty contests, unknown parts, missing baselines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hustings.operators import compare, contest, editorial, match, overlay, rollup, rules, search

SCHEMA = "contest string, candidate string, votes long, ordinal int"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("a", "X", 10, 2), ("a", "Y", 10, 1), ("a", "Z", 5, 3), ("b", "X", 0, 4), ("c", "X", 0, 5), ("c", "Y", 0, 6)], SCHEMA)


def test_ties_follow_the_named_policy(rows):
    by_name = {r.contest: r.candidate for r in contest.winners(contest.rank_candidates(rows, ["contest"])).collect()}
    by_order = {r.contest: r.candidate for r in contest.winners(contest.rank_candidates(rows, ["contest"], tie_break=["ordinal"])).collect()}
    assert by_name == {"a": "X", "b": "X", "c": "X"} and by_order["a"] == "Y"


def test_uncontested_and_empty_contests(rows):
    found = {(r.contest, r.candidate): r for r in contest.rank_candidates(rows, ["contest"]).collect()}
    assert found["b", "X"].margin_votes == 0 and found["b", "X"].share == 0.0 and found["c", "Y"].share == 0.0
    podium = {r.contest: r for r in contest.podium(contest.rank_candidates(rows, ["contest"]), ["contest"]).collect()}
    assert podium["b"].runner_up is None and podium["a"].margin_votes == 0


def test_header_is_the_first_row_with_electors(spark):
    df = spark.createDataFrame([("a", "X", 5, 0, 1, 2, 1), ("a", "Y", 7, 100, 3, 4, 2), ("a", "Z", 1, 90, 9, 9, 3)], "contest string, candidate string, votes long, registered long, rejected long, unreturned long, ordinal int")
    r = contest.normalise_contests(df, ["contest"]).first()
    assert (r.valid, r.top, r.registered, r.issued, [c.candidate for c in r.candidates]) == (13, 7, 100, 20, ["Y", "X", "Z"])


def test_override_ranks_anew(rows, spark):
    detail = spark.createDataFrame([("a", "Z", 99)], "contest string, candidate string, votes long")
    assert contest.winners(contest.override(rows, detail, ["contest"])).where("contest = 'a'").first().candidate == "Z"


def test_turnout_falls_back_to_the_stated_rate(spark):
    df = spark.createDataFrame([("x", 100, 50, 0.9), ("x", 100, None, 0.7), ("y", 100, 40, 0.1), ("z", 0, 0, 0.5)], "state string, registered long, issued long, stated double")
    found = {r.state: r.turnout for r in rollup.turnout(df, ["state"]).collect()}
    assert found["x"] == pytest.approx(0.8) and found["y"] == 0.4 and found["z"] == 0.0


def test_hierarchy_equals_separate_groupings(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 4)], "s string, d string, n int")
    got = {(r.s, r.d, r.level): r.n for r in rollup.hierarchy(df, ["s", "d"], ["n"]).collect()}
    assert got == {(None, None, 0): 7, ("a", None, 1): 3, ("b", None, 1): 4, ("a", "x", 2): 1, ("a", "y", 2): 2, ("b", "x", 2): 4}


def test_registry_keeps_the_first_name(spark):
    df = spark.createDataFrame([("p", "Ali", "1", 1), ("p", "Ali bin Abu", "2", 2), ("p", "Ali", "3", 3)], "person string, name string, candidacy string, ordinal int")
    r = rollup.registry(df).first()
    assert (r.canonical, r.aliases, r.candidacies) == ("Ali", ["Ali bin Abu"], ["1", "2", "3"])


def test_swing_and_missing_baselines(spark):
    now = spark.createDataFrame([("s1", "A", 0.6), ("s2", "B", 0.5), ("s3", "A", 0.4)], "seat string, ticket string, share double")
    before = spark.createDataFrame([("s1", {"A": 0.5}), ("s2", {"A": 1.0})], "seat string, ticket_shares map<string,double>")
    got = {r.seat: r.swing for r in compare.swing(now, before, ["seat"]).collect()}
    assert got["s1"] == pytest.approx(0.1) and got["s2"] == 0.5 and got["s3"] is None
    joined = compare.changes(compare.with_baseline(spark.createDataFrame([("s1", "A", 5, 0.5), ("s3", "B", 1, 0.2)], "seat string, winner string, margin long, turnout double"), spark.createDataFrame([("s1", "B", 3, None)], "seat string, winner string, margin long, turnout double"), ["seat"], ["winner", "margin", "turnout"]))
    got = {r.seat: (r.changed, r.margin_change, r.turnout_change) for r in joined.collect()}
    assert got == {"s1": (True, 2, None), "s3": (False, None, None)}


def test_quartiles_and_buckets(spark):
    df = spark.createDataFrame([(x,) for x in (10, 20, 30, 40, 50)], "v long")
    assert compare.quartiles(df, "v").first().thresholds == [20.0, 30.0, 40.0]
    assert compare.quartiles(df.where("v > 99"), "v").first().thresholds == [0.0, 0.0, 0.0]
    b = spark.createDataFrame([(10,), (25,), (35,), (50,)], "v int").select(compare.bucket(F.col("v"), [F.lit(20), F.lit(30), F.lit(40)]).alias("b"))
    assert [r.b for r in b.collect()] == [0, 1, 2, 3]


EVENTS = [("s1", "2024-01-01", 1, 1, "old"), ("s1", "2024-01-10", 1, 2, "same-day"), ("s1", "2024-01-10", 2, 3, "later-entry"), ("s1", "2024-01-10", 2, 4, "last-input"), ("s1", "2024-01-11", 1, 5, "future"), ("s2", "2024-01-09", 1, 6, "two")]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(EVENTS, "seat string, d string, created_at int, ordinal int, status string").withColumn("effective_date", F.to_date("d"))


def test_as_of_is_inclusive_and_ties_go_to_the_last(events, spark):
    seats = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "seat string")
    got = {r.seat: r.status for r in overlay.as_of_join(seats, events, ["seat"], ["status"], F.lit("2024-01-10").cast("date")).collect()}
    assert got == {"s1": "last-input", "s2": "two", "s3": None}


def test_person_events_win_over_seat_events(spark):
    e = spark.createDataFrame([("p1", None, "2024-01-01", 1, 1, "person"), (None, "s1", "2024-02-01", 1, 2, "seat")], "person string, seat string, d string, created_at int, ordinal int, status string").withColumn("effective_date", F.to_date("d"))
    left = spark.createDataFrame([("p1", "s1"), ("p2", "s1"), ("p3", "s9")], "person string, seat string")
    got = {r.person: r.status for r in overlay.as_of_with_fallback(left, e, "person", "seat", ["status"], F.lit("2024-03-01").cast("date")).collect()}
    assert got == {"p1": "person", "p2": "seat", "p3": None}


def test_positional_corrections_keep_votes_and_order(spark):
    contests = spark.createDataFrame([("c1", [("A", 9), ("B", 3)]), ("c2", [("C", 1)])], "seat string, candidates array<struct<name:string,votes:long>>")
    e = spark.createDataFrame([("c1", 1, "B2", "2024-01-01", 1, 1), ("c1", 0, " ", "2024-01-01", 1, 2)], "seat string, position int, name string, d string, created_at int, ordinal int").withColumn("effective_date", F.to_date("d"))
    got = {r.seat: [(c.name, c.votes) for c in r.candidates] for r in overlay.correct_positions(contests, e, "seat", F.lit("2024-01-02").cast("date")).collect()}
    assert got == {"c1": [("A", 9), ("B2", 3)], "c2": [("C", 1)]}


def test_aliases_last_entry_wins(spark):
    catalogue = spark.createDataFrame([("PX", "Party X", ["X"], 1), ("PY", "Party Y", ["X"], 2), ("PZ", "Party Z", None, 3)], "source_name string, name string, aliases array<string>, ordinal int")
    df = spark.createDataFrame([("X",), ("PX",), ("Party Z",), ("?",)], "party string")
    assert sorted(r.party for r in overlay.resolve_aliases(df, "party", catalogue).collect()) == ["?", "Party X", "Party Y", "Party Z"]


def test_vacant_seats_and_upsert(events, spark):
    seats = spark.createDataFrame([("s1", "A", "p"), ("s3", "B", "q")], "seat string, winner_alliance string, winner_party string")
    e = events.withColumns({"status": F.lit("vacant"), "alliance": F.lit(None).cast("string"), "party": F.lit(None).cast("string")})
    got = {r.seat: (r.current_alliance, r.current_party, r.is_changed) for r in overlay.seat_status(seats, e, F.lit("2024-02-01").cast("date")).collect()}
    assert got == {"s1": ("VACANT", "-", True), "s3": ("B", "q", False)}
    target, changes = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, at int")
    assert sorted((r.k, r.v) for r in overlay.upsert(target, changes, ["k"], "at").collect()) == [(1, "a"), (2, "y"), (3, "z")]


def test_each_rule_finds_its_one_violation(spark):
    good = (100, 100, 110, 5, 5, 60, 60, 20, 20, 0.5, 0.5, 2, 2)
    columns = "code int, valid long, candidate_votes long, issued long, rejected long, unreturned long, winner_votes long, top_votes long, margin long, stated_margin long, turnout double, stated_turnout double, candidates int, stated_candidates int"
    broken = {1: {0: 99, 2: 109}, 2: {2: 111}, 3: {5: 59}, 4: {7: 21}, 5: {10: 0.6}, 6: {12: 3}}
    data = [(0, *good)] + [(code, *(change.get(k, v) for k, v in enumerate(good))) for code, change in broken.items()] + [(9, *(None if k in (1, 10) else v for k, v in enumerate(good)))]
    got = sorted((r.code, r.rule_id) for r in rules.contest_rules(spark.createDataFrame(data, columns), F.col("code")).collect())
    assert got == [("1", "V5"), ("2", "V6"), ("3", "V7"), ("4", "V8"), ("5", "V10"), ("6", "V11")]


def test_coverage_orphans_status_and_staleness(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert sorted((r.message, r.code) for r in rules.coverage(a, b, ["k"]).collect()) == [("missing key", "3"), ("unexpected key", "1")]
    assert [r.code for r in rules.duplicate_keys(a, ["k"]).collect()] == ["2"]
    assert [r.code for r in rules.orphans(a, b, ["k"]).collect()] == ["1"]
    assert rules.run_status(rules.coverage(a, b, ["k"])).first().status == "failed"
    assert rules.run_status(rules.coverage(a, a, ["k"])).first().status == "passed"
    assert rules.stale(a, a).isEmpty() and not rules.stale(a, b).isEmpty()


@pytest.mark.parametrize("before,after,actor,author,ok", [("draft", "reviewed", "bob", "ann", True), ("draft", "reviewed", "Ann ", "ann", False), ("published", "draft", "bob", "ann", False), ("reviewed", "published", "b", "ann", False), ("published", "superseded", "bob", "ann", True)])
def test_transitions(spark, before, after, actor, author, ok):
    assert spark.range(1).select(editorial.allowed(*(F.lit(x) for x in (before, after, actor, author))).alias("ok")).first().ok is ok


def test_publishing_supersedes(spark):
    df = spark.createDataFrame([(1, "k", "published", "ann"), (2, "k", "reviewed", "ann"), (3, "m", "published", "ann")], "revision int, key string, status string, author string")
    got = {r.revision: r.status for r in editorial.publish(df, F.lit(2), F.lit("bob")).collect()}
    assert got == {1: "superseded", 2: "published", 3: "published"}
    assert {r.revision: r.status for r in editorial.publish(df, F.lit(2), F.lit("ann")).collect()} == {1: "published", 2: "reviewed", 3: "published"}


def test_assignment_is_optimal():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(20):
        cost = rng.integers(0, 50, (4, 6)).astype(float)
        chosen = match.best_assignment(cost)
        best = min(sum(cost[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(6), 4))
        assert cost[range(4), chosen].sum() == best and len(set(chosen)) == 4


def test_columns_go_to_candidates(spark):
    columns = spark.createDataFrame([("c", 1, "ALI ABU", 100), ("c", 2, "SITI", 50), ("c", 3, "unknown", 7)], "contest string, column int, name string, votes long")
    candidates = spark.createDataFrame([("c", "x", "ALI BIN ABU", 100), ("c", "y", "SITI BINTI", 51)], "contest string, candidate_id string, name string, votes long")
    assert sorted((r.column, r.candidate_id) for r in match.assign_columns(columns, candidates).collect()) == [(1, "x"), (2, "y")]


def test_names_resolve_to_persons(spark):
    rows = spark.createDataFrame([(1, "p9", "ALI", "ALI B"), (2, None, "SITI", "SITI B"), (3, None, "NEW", "NEW"), (4, None, "TWIN", "TWIN")], "row int, person_id string, n1 string, n2 string")
    registry = spark.createDataFrame([("p1", "SITI B"), ("p2", "TWIN"), ("p3", "TWIN")], "person_id string, name string")
    assert {r["row"]: r.person for r in match.resolve_person(rows, registry, ["n1", "n2"]).collect()} == {1: "p9", 2: "p1", 3: "person:NEW", 4: "person:TWIN"}


def test_search_and_pages(spark):
    df = spark.createDataFrame([("Alpha", "x"), ("beta", "ALPHA two"), ("", "z")], "a string, b string")
    assert search.contains_any(df, ["a", "b"], "alpha").count() == 2 and search.contains_any(df, ["a"], " ").count() == 3
    assert [r.a for r in search.options(df, "a").collect()] == ["Alpha", "beta"]
    assert [r.b for r in search.page(df, ["b"], 1, 2).collect()] == ["z"]


def test_points_to_slots(spark):
    import itertools

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 40, (5, 4, 2)), rng.integers(0, 40, (5, 6, 2))
    frame = lambda m: spark.createDataFrame([(g, k, int(x), int(y)) for g in range(len(m)) for k, (x, y) in enumerate(m[g])], "plan int, id int, x int, y int")
    got = match.assign_points(frame(a), frame(b), "plan").collect()
    for g in range(5):
        mine = [r for r in got if r.plan == g]
        assert len({r.id for r in mine}) == len({r.slot for r in mine}) == 4
        best = min(sum(int(((a[g, k] - b[g, s]) ** 2).sum()) for k, s in enumerate(order)) for order in itertools.permutations(range(6), 4))
        assert sum(r.squared for r in mine) == best
    near = {(r.plan, r.id, r.slot) for r in match.assign_points(frame(a), frame(b), "plan", 12).collect()}
    assert near == {(r.plan, r.id, r.slot) for r in got if r.squared <= 144} and len(near) < len(got)
    assert len(match.assign_points(frame(b), frame(a), "plan").collect()) == 20
    assert match.assign_points(frame(a), frame(b).where("plan > 8"), "plan").collect() == []


def test_assignment_of_columns_is_the_best_of_all_permutations(spark):
    import difflib
    import itertools
    import random

    from hustings.operators import match

    rng = random.Random(3)
    names = ["ALI BIN ABU", "ALI ABU", "SITI AMINAH", "SITI AMINA", "TAN AH KOW", "LIM", "RAJU"]
    columns, candidates = [], []
    for contest in range(12):
        for k in range(rng.randrange(0, 6)):
            columns.append((contest, k, rng.choice(names), rng.choice([10, 20, 30, 4000])))
        for k in range(rng.randrange(0, 6)):
            candidates.append((contest, f"c{k}", rng.choice(names), rng.choice([10, 20, 30, 4000])))
    like = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    worth = lambda a, b: 1e6 * (a[3] == b[3]) + 1e5 * like(a[2], b[2]) - min(abs(a[3] - b[3]), 5e4)
    got = match.assign_columns(spark.createDataFrame(columns, "contest int, column int, name string, votes int"), spark.createDataFrame(candidates, "contest int, candidate_id string, name string, votes int")).collect()
    for contest in range(12):
        a, b = [x for x in columns if x[0] == contest], [x for x in candidates if x[0] == contest]
        own = {r["column"]: r.candidate_id for r in got if r.contest == contest}
        if not a or not b:
            assert not own
            continue
        small, large, turned = (a, b, False) if len(a) <= len(b) else (b, a, True)
        best = max(sum(worth(y, x) if turned else worth(x, y) for x, y in zip(small, pick)) for pick in itertools.permutations(large, len(small)))
        pairs = [(next(x for x in a if x[1] == c), next(x for x in b if x[1] == i)) for c, i in own.items()]
        assert len(set(own.values())) == len(own) and all(x[3] == y[3] or like(x[2], y[2]) >= 0.35 for x, y in pairs)
        # What isn't there was dropped as too unlike: the pairs kept, and the best of the dropped, make up the best total.
        rest_a, rest_b = [x for x in a if x not in [p[0] for p in pairs]], [y for y in b if y not in [p[1] for p in pairs]]
        small, large, turned = (rest_a, rest_b, False) if len(rest_a) <= len(rest_b) else (rest_b, rest_a, True)
        rest = max((sum(worth(y, x) if turned else worth(x, y) for x, y in zip(small, pick)) for pick in itertools.permutations(large, len(small))), default=0)
        assert abs(sum(worth(x, y) for x, y in pairs) + rest - best) < 1e-6


def test_fuzzy_match_equals_a_plain_loop(spark):
    import difflib
    import random

    from hustings.operators import match

    rng = random.Random(5)
    names = ["ALI BIN ABU", "ALI ABU", "SITI AMINAH", "SITI AMINA", "TAN AH KOW", "LIM"]
    rows = [(c, k, rng.choice(names), rng.choice([1, 2, 3])) for c in range(9) for k in range(4)]
    candidates = [(c, f"c{k}", rng.choice(names), rng.choice([1, 2, 3])) for c in range(8) for k in range(5)]
    got = {(r.contest, r.row): r.candidate_id for r in match.fuzzy_match(spark.createDataFrame(rows, "contest int, row int, name string, votes int"), spark.createDataFrame(candidates, "contest int, candidate_id string, name string, votes int")).collect()}
    want = {}
    for c, k, name, votes in rows:
        own = [x for x in candidates if x[0] == c]
        exact = [x for x in own if x[3] == votes]
        if own:
            want[c, k] = exact[0][1] if len(exact) == 1 else min(own, key=lambda x: (-difflib.SequenceMatcher(None, name, x[2]).ratio(), x[1]))[1]
    assert got == want


def test_similarity_equals_difflib(spark):
    import difflib
    import random

    from hustings.functions.text import similarity

    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcde é") for _ in range(n))
    pairs = [(word(rng.randrange(12)), word(rng.randrange(12))) for _ in range(60)] + [(word(260), word(260)), ("a" * 230, "ab" * 120), (None, "x")]
    got = [r.s for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(similarity("a", "b").alias("s")).collect()]
    assert got == [None if a is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]

"""Every registered query with SQL against DuckDB on the smallest tables, and the entry without the text operators."""

import math
import os
import subprocess
import sys

import pytest

from hustings.plans import contests, fields, governed, ledger, records, relations

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS = (contests, relations, records, ledger, fields, governed)
QUERIES = {name: f for plan in PLANS for name, f in plan.registry.queries.items()}
ORACLES = {name: sql for plan in PLANS for name, sql in plan.registry.oracles.items()}


def plain(value):
    return ("nan" if math.isnan(value) else f"{value:.9g}") if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not os.path.isdir(SMALL):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in ORACLES:
        result = duck.sql(ORACLES[name])
        assert sorted(result.columns) == columns
        at = [result.columns.index(c) for c in columns]
        assert got == sorted(tuple(plain(r[k]) for k in at) for r in result.fetchall())


def test_entry_without_text_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['hustings.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nq, o = e.queries(), e.oracle_sql()\nassert len(q) > 100 and set(o) <= set(q) and not any(n.startswith('op') for n in q if n[2:3].isdigit() and '_' in n and n.split('_')[0][2:].isdigit() and n[:2] == 'op'), q"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=os.environ | {"PYTHONPATH": root})


@pytest.mark.parametrize("name", ["j19_fuzzy_candidate_match", "j20_column_assignment"])
def test_matching_sees_every_contest_and_place(spark, name):
    from hustings.plans import roles

    if not os.path.isdir(SMALL):
        pytest.skip("no tables here")
    ranked = roles.ranked(spark, SMALL).collect()
    place = "row" if name.startswith("j19") else "column"
    want = {(f"{r.edition}:{r.seat}", r.position) for r in ranked}
    assert {(r["contest"], r[place]) for r in QUERIES[name](spark, SMALL).collect()} == want
    assert max(r.position for r in ranked) > 5 and len({r.edition for r in ranked}) > 1


def test_catalogue_fold_equals_a_plain_loop(spark, duck):
    held, names = {}, {}
    for ordinal, user, kind in duck.sql("SELECT event_id, user_id, event_type FROM events ORDER BY event_id").fetchall():
        name = f"{kind} {user // 2}"
        if ordinal % 6 == 0:
            if user in held:
                del names[held.pop(user)[0]]
        elif names.get(name, user) == user:
            old = held.get(user)
            if old:
                del names[old[0]]
            held[user] = (name, [] if old is None else old[1] + [old[0]] * (old[0] != name and old[0] not in old[1]))
            names[name] = user
    got = {r.id: (r.name, r.aliases) for r in QUERIES["e12_catalogue_fold"](spark, SMALL).collect()}
    assert got == {k: (name, ",".join(aliases)) for k, (name, aliases) in held.items()} and got

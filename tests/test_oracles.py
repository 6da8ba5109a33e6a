"""Every registered core query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from taxaspark import queries as Q
from taxaspark.plans import fixtures as X

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    found = duck.execute(Q.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_other_queries_run(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_learned_nodes_add_up(spark, duck):
    nodes = {r["clade"]: r for r in Q.QUERIES["q_learn_nodes"](spark, SF).collect()}
    total, unique = duck.execute("SELECT count(*), count(DISTINCT lower(regexp_replace(text, '[^A-Za-z]', '', 'g'))) FROM benchmark WHERE regexp_matches(text, '[A-Za-z]')").fetchone()
    assert nodes[""]["ntotal"] == total and nodes[""]["nunique"] <= unique
    for clade, node in nodes.items():
        below = [n for c, n in nodes.items() if c[:-1] == clade and c != ""]
        if below:
            assert len(below) == 2 and sum(n["ntotal"] for n in below) == node["ntotal"] and sum(n["nunique"] for n in below) == node["nunique"]
            assert node["minlength"] == min(n["minlength"] for n in below) and node["maxlength"] == max(n["maxlength"] for n in below)


def test_cross_validation_covers_every_sequence_and_its_copies(spark, duck):
    got = {r["ord"]: r["query"] for r in Q.QUERIES["q_cvi"](spark, SF).collect()}
    rows = duck.execute(f"WITH {X.SQL} SELECT ord, seq FROM refseqs").fetchall()
    assert set(got) == {o for o, _ in rows} and 0 < sum(got.values()) < len(got)
    sides = {}
    for o, s in rows:
        assert sides.setdefault(s, got[o]) == got[o]

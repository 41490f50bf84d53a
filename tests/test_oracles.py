"""Every query against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from quillspark.plans import queries as plain
from quillspark.plans.inline import Derived

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(D):
        c.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{D}/{t}'")
    return c


def plainly(x):
    if isinstance(x, float):
        return "null" if x != x else repr(x)
    return "null" if x is None else str(x)


@pytest.mark.parametrize("name", sorted(plain.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = plain.QUERIES[name](spark, D)
    want = con.sql(plain.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted(tuple(plainly(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(plainly(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plain.QUERIES) - set(plain.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert plain.QUERIES[name](spark, D).count() > 0


#: Queries whose SQL knows the derived rows' parts; their literal rows have results by hand below.
BY_HAND = {"remove_placeholders": {0: '{"d":["kept text here",{}],"g":3}', 1: '{"name":"Long enough text","n":1,"m":2,"o":3,"p":4,"q":[5,6],"r":"short"}', 2: None}, "merge_responses": {0: '{"a":[1,2,3],"b":{"x":"kept","y":[1,4],"z":"new"},"c":"last"}', 1: '{"d":"first","e":5}'}}
DERIVED = {k: v for k, v in vars(plain).items() if isinstance(v, Derived)}


def over_literal_rows(spark, monkeypatch, name):
    monkeypatch.setattr(Derived, "df", lambda self, spark, d: self.literal.df(spark))
    monkeypatch.setattr(plain, "_GRIDS", {})
    monkeypatch.setattr(plain, "seen", lambda spark, d: plain.SEEN_ROWS.df(spark))
    return plain.QUERIES[name](spark, D)


@pytest.mark.parametrize("name", sorted(n for n, sql in plain.ORACLES.items() if any(x.sql in sql for x in [*DERIVED.values()]) or plain.SEEN_SQL in sql))
def test_odd_literal_rows(spark, con, monkeypatch, name):
    got = over_literal_rows(spark, monkeypatch, name)
    if name in BY_HAND:
        assert {r[0]: r[1] for r in got.collect()} == BY_HAND[name]
        return
    sql = plain.ORACLES[name].replace(plain.SEEN_SQL, plain.SEEN_ROWS.sql)
    for x in DERIVED.values():
        sql = sql.replace(x.sql, x.literal.sql)
    want = con.sql(sql)
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(plainly(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(plainly(r[i]) for i in at) for r in want.fetchall())


def test_every_query_reads_a_given_table(spark):
    """No query runs on literal rows: the files that its plan reads, or that it wrote from them, are there."""
    for name, x in DERIVED.items():
        assert x.tables, name
        read = x.df(spark, D).inputFiles()
        assert read and all("/testdata/" in f for f in read), name

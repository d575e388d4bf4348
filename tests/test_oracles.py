"""Spark queries against their DuckDB oracles on the smallest tables.
Every registered query that has an oracle is run."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as E
from tidemark.sources.tables import TABLES

from .conftest import SF_SMALL

# the training-data queries have their own tests in tests/llm
NAMES = sorted(n for n in E.oracle_sql() if not n.startswith("op"))


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return repr(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _canon(df.columns, rows) == _canon(ocols, cur.fetchall())


def test_every_query_has_callable_and_oracles_are_subset():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    out = E.entry(spark)
    assert out.count() > 0
    assert {"series_id", "period", "prediction", "confidence"} <= set(out.columns)


def test_top_lists_shape(spark):
    """At most 10 rows per list, ranks 1..n, F list only p < 0.05."""
    from pyspark.sql import functions as F
    from tidemark.operators import selection as SE
    from tidemark.sources import panels as P
    p = P.month_segment_panel(spark, SF_SMALL)
    t = SE.top_lists(p, P.PANEL_FEATURES, "y", n=3)
    per = {r["list"]: r["n"] for r in t.groupBy("list").agg(F.count("*").alias("n")).collect()}
    assert set(per) <= {"correlation", "mutual_info", "f_test", "composite"}
    assert per["correlation"] == 3 and per["composite"] == 3
    ranks = t.where(F.col("list") == "correlation").orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == [1, 2, 3]
    assert ranks[0]["score"] >= ranks[1]["score"] >= ranks[2]["score"]


def test_month_panel_is_stored_once(spark):
    """what is fitted on the panel in many passes reads the tables only when it is built."""
    from tidemark.sources import panels as P
    p = P.month_segment_panel(spark, SF_SMALL)
    assert p.inputFiles() == [] and p.where("n_orders > 0").inputFiles() == []
    assert p.count() > 100 and p.groupBy("series_id", "period").count().where("count > 1").count() == 0

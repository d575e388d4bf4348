import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import exact_dedup as X

DOCS = "doc_id long, text string, kept string, keep_id string, sha string"


def brute(rows):
    low = [(i, "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))) for i, t in rows]
    out = []
    for i, t in low:
        ids = [j for j, u in low if u == t]
        keep = max((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "Same"), (2, "sAME"), (3, "other"), (4, None), (5, ""), (6, "Ärger"), (7, "ärger"), (8, "long " * 50_000),
        (9, "LONG " * 50_000), (10, "tie"), (10, "tie"), (None, "alone"), (None, "same"), (11, " same")]


def test_groups_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in ROWS], DOCS)
    got = sorted((tuple(r) for r in X.exact_groups(df).collect()), key=repr)
    assert got == brute(ROWS)


@F.arrow_udf(T.StringType())
def _clashing(text: pa.Array) -> pa.Array:
    return pa.array([str(len(t or "") % 3) for t in text.to_pylist()], pa.string())


def test_digest_collisions_do_not_merge(spark):
    """With a digest of three values every decision rests on the byte check."""
    rows = [(i, f"t{'x' * (i % 7)}{i % 5}") for i in range(60)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in
           X.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), digest=_clashing).collect()}
    assert got == {i: (k, n) for i, k, n, _, _ in brute(rows)}


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_batches_do_not_change_the_result(spark, batches):
    rows = [(i, f"text {i % 40}") for i in range(200)]
    got = X.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches).collect()
    assert all(r["keep_id"] == 160 + r["doc_id"] % 40 and r["group_size"] == 5 for r in got) and len(got) == 200


@pytest.mark.parametrize("keys", [0, 39, 40])
def test_screen_does_not_change_the_result(spark, keys):
    """Below, at and above the number of suspected digests whose filters may be broadcast."""
    rows = [(i, f"Text {i % 40}" if i < 160 else f"single {i}") for i in range(200)]
    got = X.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), screen_keys=keys).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_screen_lets_all_members_through(spark):
    shas = spark.range(3000).selectExpr("sha2(CAST(id AS string), 256) AS sha", "id")
    likely = X.screen_in_place(spark, shas.where("id < 1000").select("sha"), 1000)
    got = {r["id"] for r in shas.where(likely(F.col("sha"))).collect()}
    assert got >= set(range(1000)) and len(got) < 1100


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, "a", "s"), (2, "A", "t"), (None, "b", "u")], "doc_id long, text string, sha string")
    out = X.drop_exact_copies(df.withColumn("__sha", F.lit(1)).withColumn("id", F.lit(2)))
    assert out.columns == ["doc_id", "text", "sha", "__sha", "id"]
    assert sorted(r["sha"] for r in out.collect()) == ["t", "u"]


def test_empty_table(spark):
    assert X.exact_groups(spark.createDataFrame([], DOCS)).collect() == []
    assert X.drop_exact_copies(spark.createDataFrame([], DOCS)).collect() == []


def test_drop_keeps_columns_and_one_row(spark):
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in ROWS], DOCS)
    out = X.drop_exact_copies(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 2, 3, 5, 6, 7, 9, 10, 11]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 5_000])
def test_filter_has_no_false_negative(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(-2**62, 2**62, n))
    f = X.build_filter(keys)
    assert X.maybe_in(keys, *f).all()
    assert X.maybe_in(rng.integers(-2**62, 2**62, 20_000), *f).mean() < 0.01

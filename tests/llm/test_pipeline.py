"""The pipeline stage by stage against brute force, on a small table."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as C
from tidemark.llm import exact_dedup as X
from tidemark.llm import queries as Q
from tidemark.llm import toxicity

from .test_exact_dedup import brute
from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.01"


def test_registered():
    names = E.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(Q.ORACLES) <= set(names)


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.cache()]
    for _, stage in C.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_columns_stay(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_toxicity_stage(spark, steps):
    rows = toxicity.score_documents(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert {r["doc_id"] for r in steps[1].collect()} == {r["doc_id"] for r in rows if r["score"] < toxicity.THRESHOLD}
    assert steps[1].count() < steps[0].count()


def test_exact_stage(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[1].collect()]
    assert sorted(r["doc_id"] for r in steps[2].collect()) == sorted(i for i, _, _, kept, _ in brute(rows) if kept)


def test_simhash_stage(steps):
    rows = sorted((r["doc_id"], brute_fingerprint(r["text"], 4)) for r in steps[2].collect())
    pairs = [(a, b) for a, x in rows for b, y in rows if b < a and (x ^ y).bit_count() <= 4]
    comp = brute_components(pairs, [i for i, _ in rows])
    assert sorted(r["doc_id"] for r in steps[3].collect()) == sorted(set(comp.values()))


def test_secret_stage(steps):
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in steps[3:5])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert 'oken = "' not in r["text"] or '[SECRET]"' in r["text"]
        if r["text"] == before[i]["text"]:
            assert r == before[i]
        else:
            assert "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])


def test_packing_stage_and_run(spark, steps):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = set()
    for r in steps[4].collect():
        ids = np.array(lib.encode(r["text"], add_special_tokens=False).ids + [0], dtype="<u4")
        want |= {(r["doc_id"], k // 2048, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes())) for k in range(0, len(ids), 2048)}
    for got in (steps[5], C.run(spark, SF)):
        assert {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got.collect()} == want


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == []
        docs = out if out.columns == docs.columns else docs


def python_steps(df):
    """Python operators in the executed plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("EvalPython")


def test_a_screened_text_meets_one_worker(spark):
    """The digest is not computed anew for what is read behind the filter on it."""
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('Text ', id % 30) AS text")
    assert python_steps(X.drop_exact_copies(docs)) == 2             # one in either part
    shas = docs.where("doc_id < 10").select(X.sha256_lower("text").alias("sha"))
    one = X.digest_and_screen(spark, X.sha256_lower, shas, None, 100)
    near = docs.withColumn("s", one(F.col("text"), F.lit(""))).where("s.near").select("doc_id", "s.sha", "s.low")
    assert python_steps(near) == 1
    got = {r["doc_id"]: r["low"] for r in near.collect()}
    assert {i: f"text {i % 30}" for i in range(40) if i % 30 < 10}.items() <= got.items()


def test_fixed_rows_need_no_python_worker(spark, monkeypatch):
    """Fixed findings and the plan of a packing reach Spark without Python workers of their own."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20)

    def refuse(*args, **kwargs):
        raise AssertionError("rows of Python objects")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    assert Q.stage_packing(spark, Q.stage_secrets(spark, docs, SF), SF).select("doc_id").distinct().count() == 20


def test_words_in_blocks_have_the_same_features(monkeypatch):
    words = [f"{'w' * (i % 23)}Ä{i}" for i in range(500)]
    want = toxicity.word_features(words)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert (toxicity.word_features(words) == want).all()

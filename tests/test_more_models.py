"""Elimination by sweeps, word vectors, normal quantiles, replayed batches, NaN errors."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.stats import norm_ppf_sql
from tidemark.operators import features as FE
from tidemark.operators import gram as G
from tidemark.operators import validation as V
from tidemark.streaming import scoring as SS


def refit(x, y, k, step):
    """Elimination by fitting again at every step."""
    left = list(range(x.shape[1]))
    z = (x - x.mean(0)) / x.std(0)
    while len(left) > k:
        b = np.linalg.lstsq(np.column_stack([np.ones(len(y)), z[:, left]]), y, rcond=None)[0][1:]
        order = sorted(range(len(left)), key=lambda i: (-abs(b[i]), i))
        gone = {left[i] for i in order[len(left) - min(len(left) - k, max(1, math.ceil(step * len(left)))):]}
        left = [j for j in left if j not in gone]
    return left


@pytest.mark.parametrize("step", [0.01, 0.3])
def test_elimination_equals_refitting(spark, step):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 9)) @ rng.normal(size=(9, 9)) * 10.0 ** np.arange(-4, 5) + 1e5
    y = x @ rng.normal(size=9) + rng.normal(size=300)
    names = [f"f {i}" for i in range(9)]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"`{n}` double" for n in names) + ", y double")
    for k in (1, 3, 8):
        assert G.eliminate(df, names, "y", k, step) == [names[j] for j in refit(x, y, k, step)]


def test_elimination_drops_what_others_make_up(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 200))
    rows = [(float(u), float(v), float(u + v), 3.0, float(2 * u - v)) for u, v in zip(a, b)]
    df = spark.createDataFrame(rows, "a double, b double, both double, flat double, y double")
    assert G.eliminate(df, ["a", "b", "both", "flat"], "y", 2, 0.01) == ["a", "b"]
    with pytest.raises(ValueError):
        G.eliminate(df.limit(0), ["a"], "y", 1)


def test_planted_synonyms_are_nearest(spark):
    rng = np.random.default_rng(6)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(3)]
    rows = []
    for i in range(600):
        words = [str(w) for w in rng.choice(topics[i % 3], 20)]
        if i % 3 == 0:
            words[::4] = [str(rng.choice(["alpha", "omega"])) for _ in words[::4]]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([*rows, (700, None), (701, "zz unknown words only here")], "doc_id long, text string")
    m = FE.fit_word_vectors(docs, size=12, min_count=5, partitions=1, iterations=10, step=0.05, seed=3)
    near = [r["word"] for r in m.model.findSynonyms("alpha", 13).collect()]
    assert all(w == "omega" or w.startswith("t0") for w in near[:5]) and "omega" in near
    vec = {r["doc_id"]: r["vector"].toArray() for r in m.transform(docs).collect()}
    assert len(vec) == 602 and not vec[700].any() and not vec[701].any() and vec[0].any()
    few = FE.fit_word_vectors(docs, size=4, max_words=5, partitions=2)
    assert few.least > 5 and few.model.getVectors().count() <= 5
    with pytest.raises(ValueError):
        FE.fit_word_vectors(docs.limit(0), size=4)


def test_normal_quantile_expression(spark):
    ps = [1e-300, 1e-12, 1e-4, 0.02425, 0.07, 0.0751, 0.3, 0.5, 0.7, 0.925, 0.9251, 0.999, 1 - 1e-12]
    df = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double")
    got = [r[0] for r in df.select(F.expr(norm_ppf_sql("p"))).collect()]
    assert got[-3:] == [None, None, None]
    np.testing.assert_allclose(got[:-3], [NormalDist().inv_cdf(p) for p in ps], rtol=1e-13, atol=1e-15)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "report")
    step = SS.drift_monitor({"x": 1.0, "z": 2.0}, path)
    a, b = (spark.createDataFrame([(v, None) for v in vs], "x double, z double") for vs in ([1.0, 1.1], [5.0]))
    for batch, i in ((a, 0), (b, 1), (a, 0), (b, 1)):
        step(batch, i)
    rows = sorted(tuple(r) for r in spark.read.parquet(path).select("batch_id", "feature", "rows", "drift").collect())
    assert rows == [(0, "x", 2, False), (0, "z", 2, False), (1, "x", 1, True), (1, "z", 1, False)]


def test_nan_error_never_wins(spark, monkeypatch):
    from types import SimpleNamespace
    errors = {0: math.nan, 1: 3.0, 2: 2.0}
    monkeypatch.setattr(V, "fit_model", lambda spec, tr, f, l, params: params)
    monkeypatch.setattr(V, "_mse", lambda m, te, label: errors[m["i"]])
    folds = [SimpleNamespace(train_end=1, test_start=1, test_end=2)]
    spec = SimpleNamespace(kind="rf", grid={"i": [0, 1, 2]}, params={}, name="m")
    data = spark.range(3).withColumnRenamed("id", "row_pos")
    assert V.grid_search(spec, data, ["row_pos"], "row_pos", folds)[0] == {"i": 2}
    errors.update({1: math.nan, 2: math.nan})
    with pytest.raises(ValueError):
        V.grid_search(spec, data, ["row_pos"], "row_pos", folds)

"""K6: isolation-forest outlier scores (Liu, Ting and Zhou, 2008).

Plan on Spark:

1. Sampling. A tree's sample is the ``sample_size`` complete rows with the
   smallest hash of (row key, tree, seed): one rule for every input size,
   repeatable under any partitioning, and exactly ``sample_size`` rows (all, if
   there are fewer). The key is ``key`` or, without one, all columns: rows equal in
   all of them are interchangeable. Hashes above a bound that lets through a small
   multiple of the rows needed are dropped before the shuffle; the bound is raised
   until every tree is full, so it changes the work, never the sample. Rows are
   paired with trees by ``explode``, in generated code.
2. Growing. ``groupBy(tree).applyInPandas`` grows one random isolation tree
   per group of ``sample_size`` rows, taken in hash order.
3. Scoring. The forest has at most ``n_trees * (2 * sample_size - 1)``
   nodes, a size fixed by the parameters and not by the data, so it is
   broadcast, and every row is scored in Arrow batches by ``mapInPandas``.
   Trees are laid out as full binary trees (children of place h at 2 h and
   2 h + 1, a leaf's value at all places under it), so numpy walks all rows of a
   batch down a tree with one gather and one comparison a level.

score = 2 ** (-E[h(x)] / c(sample_size)), h = depth + c(leaf size); rows
with a null feature get a null score. ``score > threshold`` (0.5 by
default, the paper's rule) flags an outlier.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from ..functions.exprs import q
from ..session import materialize

EULER_GAMMA = 0.5772156649015329
_HASH_RANGE = 1 << 30
_NODE_SCHEMA = "tree int, node int, feat int, thr double, left int, right int, size long"


def _c(n):
    """Average path length of an unsuccessful binary-search-tree lookup."""
    n = np.asarray(n, dtype="float64")
    safe = np.maximum(n - 1.0, 1.0)
    return np.where(n > 2, 2.0 * (np.log(safe) + EULER_GAMMA) - 2.0 * (n - 1.0) / np.maximum(n, 1.0),
                    np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    def __init__(self, features, nodes: pd.DataFrame, sample_size: int, threshold: float):
        self.features = list(features)
        self.sample_size = int(sample_size)
        self.threshold = float(threshold)
        self.n_trees = int(nodes["tree"].nunique()) if len(nodes) else 0
        width = int(nodes["node"].max()) + 1 if len(nodes) else 1
        shape = (max(self.n_trees, 1), width)
        self.feat = np.full(shape, -1, dtype="int64")
        self.thr = np.zeros(shape)
        self.left = np.zeros(shape, dtype="int64")
        self.right = np.zeros(shape, dtype="int64")
        self.size = np.zeros(shape)
        tree_ix = {t: i for i, t in enumerate(sorted(nodes["tree"].unique()))}
        ti = nodes["tree"].map(tree_ix).to_numpy()
        ni = nodes["node"].to_numpy()
        self.feat[ti, ni] = nodes["feat"].to_numpy()
        self.thr[ti, ni] = nodes["thr"].to_numpy()
        self.left[ti, ni] = nodes["left"].to_numpy()
        self.right[ti, ni] = nodes["right"].to_numpy()
        self.size[ti, ni] = nodes["size"].to_numpy()
        self.depth_limit = int(math.ceil(math.log2(max(self.sample_size, 2))))

    def layout(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, threshold) of every inner place of the full trees, and path length at every place of the last level."""
        width = 1 << self.depth_limit
        feat = np.zeros((len(self.feat), width), dtype="int64")
        thr = np.full(feat.shape, np.inf)
        length = np.zeros(feat.shape)
        leaf_c = _c(self.size)
        for t in range(len(feat)):
            todo = [(1, 0, 0)]
            while todo:
                place, node, depth = todo.pop()
                if self.feat[t, node] < 0:
                    last = place << (self.depth_limit - depth)
                    length[t, last - width:last - width + (1 << (self.depth_limit - depth))] = depth + leaf_c[t, node]
                else:
                    feat[t, place], thr[t, place] = self.feat[t, node], self.thr[t, node]
                    todo += [(2 * place, self.left[t, node], depth + 1), (2 * place + 1, self.right[t, node], depth + 1)]
        return feat, thr, length

    def transform(self, df: DataFrame, score_col: str = "anomaly_score",
                  flag_col: str = "is_outlier") -> DataFrame:
        spark = df.sparkSession
        bc = spark.sparkContext.broadcast(self.layout())
        feats, n_trees, limit = self.features, self.n_trees, self.depth_limit
        norm = float(_c(self.sample_size)) or 1.0
        thr_flag = self.threshold
        out_schema = StructType(df.schema.fields + [StructField(score_col, DoubleType(), True),
                                                    StructField(flag_col, BooleanType(), True)])

        def score(batches):
            feat, thr, length = bc.value
            for pdf in batches:
                X = np.ascontiguousarray(pdf[feats].to_numpy(dtype="float64", na_value=np.nan))
                m = len(X)
                cells, first = X.ravel(), np.arange(m) * len(feats)
                total = np.zeros(m)
                for t in range(n_trees):
                    place = np.ones(m, dtype="int64")
                    for _ in range(limit):
                        place = 2 * place + (cells[first + feat[t][place]] >= thr[t][place])
                    total += length[t][place - length.shape[1]]
                s = np.power(2.0, -(total / max(n_trees, 1)) / norm)
                bad = np.isnan(X).any(axis=1)
                pdf[score_col] = np.where(bad, np.nan, s)
                pdf[flag_col] = pd.array(np.where(bad, None, s > thr_flag), dtype="boolean")
                yield pdf
        out = df.mapInPandas(score, out_schema)
        return out.withColumn(score_col, F.nanvl(F.col(score_col), F.lit(None).cast("double")))


def sample_rows(df: DataFrame, feats: Sequence[str], n_trees: int, psi: int, n: int, seed: int,
                key: Sequence[str] | None = None) -> DataFrame:
    """(_tree, _h, features): per tree the ``psi`` of ``n`` rows with the smallest hashes."""
    keys = ", ".join(q(c) for c in (key or df.columns))
    hashed = F.expr(f"pmod(xxhash64({keys}, _tree, {int(seed)}), {_HASH_RANGE})")
    per_tree = Window.partitionBy("_tree").orderBy("_h", *feats)
    share = min(1.0, (2.0 * psi + 64) / max(n, 1))
    while True:
        bound = int(share * _HASH_RANGE)
        pairs = df.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))).withColumn("_h", hashed)
        sample = materialize(
            pairs.where(F.col("_h") < bound).select("_tree", "_h", *feats)
            .withColumn("_r", F.row_number().over(per_tree)).where(F.col("_r") <= psi).drop("_r"))
        full = sample.groupBy("_tree").count().where(F.col("count") == psi).count()      # n_trees rows
        if share >= 1.0 or full == n_trees:
            return sample
        share = min(1.0, 4 * share)


def fit_isolation_forest(df: DataFrame, cols: Sequence[str], n_trees: int = 100,
                         sample_size: int = 256, seed: int = 42, threshold: float = 0.5,
                         key: Sequence[str] | None = None) -> IsolationForest:
    feats = list(cols)
    clean = df.dropna(subset=feats)
    n = clean.count()
    psi = max(1, min(sample_size, n))
    samp = sample_rows(clean, feats, n_trees, psi, n, seed, key)
    limit = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["_tree"].iloc[0])
        rng = np.random.default_rng([int(seed), t])
        X = pdf.sort_values(["_h", *feats], kind="mergesort")[feats].to_numpy(dtype="float64")
        nodes = []

        def node(idx, depth):
            me = len(nodes)
            nodes.append(None)
            x = X[idx]
            if depth >= limit or len(idx) <= 1:
                nodes[me] = (-1, 0.0, -1, -1, len(idx))
                return me
            lo, hi = x.min(axis=0), x.max(axis=0)
            ok = np.flatnonzero(hi > lo)
            if ok.size == 0:
                nodes[me] = (-1, 0.0, -1, -1, len(idx))
                return me
            f = int(rng.choice(ok))
            cut = float(rng.uniform(lo[f], hi[f]))
            go_left = x[:, f] < cut
            lft = node(idx[go_left], depth + 1)
            rgt = node(idx[~go_left], depth + 1)
            nodes[me] = (f, cut, lft, rgt, len(idx))
            return me
        node(np.arange(len(X)), 0)
        return pd.DataFrame([(t, i, *v) for i, v in enumerate(nodes)],
                            columns=["tree", "node", "feat", "thr", "left", "right", "size"])
    # bounded: n_trees * (2 * psi - 1) node rows reach the driver
    nodes = samp.groupBy("_tree").applyInPandas(grow, _NODE_SCHEMA).toPandas()
    return IsolationForest(feats, nodes, psi, threshold)

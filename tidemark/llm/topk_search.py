"""Exact top-k inner product by no-random-access aggregation.

Candidates are dealt by a hash into blocks, each with one list per component,
whose two ends are known. A query reads whole lists, those first that can add
most to a score: |q_i| times the spread of the list. What it has read of a
candidate is its partial score; the lists still to come add at least the sum of
their worse ends and at most the sum of their better ends, which gives every
candidate a lower and an upper score bound. After every few lists a candidate
whose upper bound is under the k-th best lower bound is out: later lists are read
for the others alone. Reading stops when so few are left that no outsider can
qualify; their scores are then resolved from the lists not read. The result is
exact wherever reading stops. The two tables meet block by block (the queries are
a stated set), and the k best of a block are a superset of its share in the k
best of all.

Blocks are dealt to tasks as a grid: a task holds up to ``GROUP`` blocks of either
table, so a block travels once for each row or column of the grid, not for each
block that it meets, with its values in the smallest integers that hold them.

Scores are integers and exact: products run in 32- or 64-bit floats only while
their sums stay exact there, in 64-bit integers otherwise.

Defined results: rows without id, and vectors that are null, empty or hold a null
or non-finite component take no part; vectors meet those of their own length;
a query's own row is every row with its id; repeated candidate rows count each;
of repeated query rows one is asked; fewer candidates than k give fewer rows; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of a block of candidates and of queries.
BLOCK, QUERY_BLOCK = 4_096, 1_024
#: Blocks of either table that meet in one task.
GROUP = 16
#: Lists read between two looks at the bounds.
STEP = 4
#: Reading stops once at most this many times k candidates are left.
FEW = 8


def _exact_type(a: np.ndarray, b: np.ndarray) -> type:
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] * 2
    return np.float32 if most < 2 ** 24 else np.float64 if most < 2 ** 53 else np.int64


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray,
                 k: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(query id, candidate id, score): the k best of one block for every query; and how
    many lists each query read before no outsider could qualify."""
    kind = _exact_type(q, v)
    lists = np.ascontiguousarray(v.T.astype(kind))
    least, most = v.min(axis=0), v.max(axis=0)
    dim = v.shape[1]
    out: list[tuple[int, int, int]] = []
    depth = np.zeros(len(q_ids), dtype=np.int64)
    for row, (q_id, x) in enumerate(zip(q_ids.tolist(), q)):
        ends = np.stack([x * least, x * most])
        order = np.argsort(ends.min(axis=0) - ends.max(axis=0), kind="stable")
        worse = np.append(np.cumsum(ends.min(axis=0)[order][::-1])[::-1], 0)      # of the lists from a place on
        better = np.append(np.cumsum(ends.max(axis=0)[order][::-1])[::-1], 0)
        left, weight, done = np.flatnonzero(ids != q_id), x.astype(kind), 0
        score = np.zeros(len(left), dtype=kind)
        rest = lists if len(left) == len(ids) else None       # lists of those left, if these are all
        while done < dim and len(left) > FEW * k:
            now = order[done:done + STEP]
            score = score + weight[now] @ (lists[now] if rest is not None else lists[now[:, None], left])
            done += len(now)
            if score.max() + worse[done] <= score.min() + better[done]:
                continue                                       # nobody can be out yet
            bar = np.partition(score, len(score) - k)[len(score) - k] + worse[done]
            stays = score + better[done] >= bar
            if np.count_nonzero(stays) < 0.8 * len(left):      # copied only when it pays
                left, score, rest = left[stays], score[stays], None
        depth[row] = done
        if done < dim and len(left):
            score = score + weight[order[done:]] @ lists[order[done:][:, None], left]
        out += [(q_id, int(ids[left[b]]), int(score[b])) for b in _best(score, ids[left], k)]
    return out, depth


def _packed(rows: DataFrame, block: str) -> DataFrame:
    """One row per block and vector length: ids, and values in the smallest little-endian integers that hold them."""
    def pack(group: pa.Table) -> pa.Table:
        values = group["e"].combine_chunks().flatten().to_numpy()
        kind = next(t for t in ("<i2", "<i4", "<i8") if not len(values) or (
            np.iinfo(t).min <= values.min() and values.max() <= np.iinfo(t).max))
        return pa.table({block: pa.array([group[block][0].as_py()], pa.int64()), "dim": pa.array([group["dim"][0].as_py()], pa.int32()),
                         "ids": pa.array([group["id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
                         "vals": pa.array([values.astype(kind).tobytes()], pa.binary())})

    return rows.groupBy(block, "dim").applyInArrow(pack, f"{block} long, dim int, ids binary, vals binary")


def _unpacked(ids: bytes, vals: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, "<i8")
    width = len(vals) // (len(numbers) * dim)
    return numbers, np.frombuffer(vals, f"<i{width}").reshape(-1, dim).astype(np.int64)


def _on_grid(packed: DataFrame, block: str, own: str, own_parts: int, other: str, other_parts: int) -> DataFrame:
    """Every block once in each cell of its row (or column) of the grid."""
    return packed.select(F.pmod(F.col(block), F.lit(own_parts)).alias(own), "dim", "ids", "vals",
                         F.explode(F.sequence(F.lit(0), F.lit(other_parts - 1)).cast("array<long>")).alias(other))


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: int = 256,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score; ``is_query`` is a condition on ``id``."""
    double = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("x")).where(
        "id IS NOT NULL AND size(x) > 0 AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))")
    rows = stored(double.select("id", F.size("x").alias("dim"), F.expr(f"transform(x, c -> CAST(floor({scale} * c) AS long))").alias("e")))
    asked = rows.where(is_query).dropDuplicates(["id"])
    n, m = rows.count(), asked.count()
    blocks, q_blocks = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(m / QUERY_BLOCK))

    def deal(df: DataFrame, name: str, parts: int) -> DataFrame:
        return df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(parts)))

    def meet(cell: pa.Table, queries: pa.Table) -> pa.Table:
        got: list[tuple[int, int, int]] = []
        for a in queries.to_pylist():
            asked_now = _unpacked(a["ids"], a["vals"], a["dim"])
            for c in cell.to_pylist():
                got += search_block(*asked_now, *_unpacked(c["ids"], c["vals"], c["dim"]), k)[0]
        cols = list(zip(*got)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    # few blocks are spread over all cores, many in groups of a bounded size
    cores = rows.sparkSession.sparkContext.defaultParallelism
    across, down = math.ceil(q_blocks / GROUP), max(math.ceil(blocks / GROUP), min(blocks, cores))
    candidates = _on_grid(_packed(deal(rows, "block", blocks), "block"), "block", "r", down, "c", across)
    queries = _on_grid(_packed(deal(asked, "q_block", q_blocks), "q_block"), "q_block", "c", across, "r", down)
    best = (candidates.groupBy("r", "c", "dim").cogroup(queries.groupBy("r", "c", "dim"))
            .applyInArrow(meet, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

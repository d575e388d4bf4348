"""Exact order statistics of columns, whole or per group, by radix selection.

Every wanted rank has a bracket, first [min, max]. A pass counts, for all brackets of
all columns (and groups) at once, the values in the cells of each bracket with each
cell's smallest and largest value; the cell that holds the rank is the next bracket. A
bracket that spans several magnitudes or a sign is cut by the binary exponent, any other
into 256 equal cells, so a rank is found after one pass over exponents and at most seven
of 8 bits, whatever the range of the values. A bracket is done when its two ends are equal
or the rank is its first or last value. There is no value list and no sort: a pass gives a
row per used cell of an open bracket, and equal values, however many, are one cell.

The columns asked for are copied once, alone, so a pass never repeats the work behind
them. Whole columns keep their brackets on the driver (a few numbers per column and
rank); groups keep them in a table with a row per group, column and rank.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import dlit, join_null_safe, q
from ..session import materialize

#: Equal cells of a bracket; a bracket whose ends differ by a larger factor is cut by exponent.
CELLS = 256


def _cell(v: str, a: str, b: str) -> str:
    """SQL: the cell of ``v`` in the bracket [a, b]; it never falls when v rises."""
    exponent = f"least(1100D, floor(log2(abs({v}))))"
    far = f"({a} <= 0 AND {b} >= 0) OR greatest(abs({a}), abs({b})) / {CELLS} > least(abs({a}), abs({b}))"
    # half widths: b - a of finite doubles may overflow
    even = f"least({CELLS - 1}D, floor(({v} / 2 - {a} / 2) / ({b} / 2 - {a} / 2) * {CELLS}))"
    return (f"CAST(CASE WHEN NOT ({far}) THEN {even} WHEN {v} = 0 THEN 0D WHEN {v} > 0 THEN 1100 + {exponent} "
            f"ELSE -1100 - {exponent} END AS int)")


def order_statistics(df: DataFrame, ranks: dict[str, Sequence[int]], bounds: dict[str, tuple[int, float, float]]) -> dict:
    """{(column, rank): value}; ``bounds`` has (count, min, max) of each column's non-null, non-NaN values."""
    # (column, rank) -> low end, high end, values under the low end, values inside
    state = {(c, r): (bounds[c][1], bounds[c][2], 0, bounds[c][0]) for c, rs in ranks.items() for r in rs}
    done = {}
    while True:
        for key, (a, b, below, inside) in list(state.items()):
            at = key[1] - below
            if a == b or at == 0 or at == inside - 1:
                done[key] = b if at == inside - 1 else a
                del state[key]
        if not state:
            return done
        keys = sorted({(c, a, b) for (c, _), (a, b, _, _) in state.items()})
        cells = []
        for i, (c, a, b) in enumerate(keys):
            v = f"CAST({q(c)} AS DOUBLE)"
            cell = _cell(v, dlit(a), dlit(b))
            cells.append(f"CASE WHEN {v} BETWEEN {dlit(a)} AND {dlit(b)} THEN named_struct('k', {i}, 'i', {cell}, 'v', {v}) END")
        found = (df.select(F.expr(f"explode(array_compact(array({', '.join(cells)})))").alias("s")).groupBy("s.k", "s.i")
                 .agg(F.count(F.lit(1)).alias("n"), F.min("s.v").alias("a"), F.max("s.v").alias("b")).collect())
        by_key: dict[int, list] = {}
        for row in sorted(found, key=lambda r: (r["k"], r["i"])):
            by_key.setdefault(row["k"], []).append(row)
        for key, (a, b, below, _) in list(state.items()):
            for row in by_key[keys.index((key[0], a, b))]:
                if key[1] < below + row["n"]:
                    state[key] = (row["a"], row["b"], below, row["n"])
                    break
                below += row["n"]


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Per column the linearly interpolated quantiles at ``probs`` of its values
    (nulls and NaN left out); None for a column without values."""
    cols = list(dict.fromkeys(cols))
    if not cols:
        return {}
    df = materialize(df.select(*[F.col(q(c)) for c in cols]))
    ok = {c: f"CASE WHEN NOT isnan(CAST({q(c)} AS DOUBLE)) THEN CAST({q(c)} AS DOUBLE) END" for c in cols}
    row = df.agg(*[F.expr(f"{f}({ok[c]})") for c in cols for f in ("count", "min", "max")]).first()
    bounds = {c: tuple(row[3 * i:3 * i + 3]) for i, c in enumerate(cols)}
    wanted = {c: sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
              for c, (n, _, _) in bounds.items() if n}
    value = order_statistics(df, wanted, bounds)
    out: dict[str, list[float | None]] = {}
    for c in cols:
        n = bounds[c][0]
        out[c] = []
        for p in probs:
            if not n:
                out[c].append(None)
                continue
            low, high = value[c, math.floor(p * (n - 1))], value[c, math.ceil(p * (n - 1))]
            out[c].append(low if low == high else low + (high - low) * (p * (n - 1) - math.floor(p * (n - 1))))
    return out


def grouped_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """by..., column, q0, q1, ...: linearly interpolated quantiles of every group's
    values (nulls and NaN left out). A column without values has no row in a group.
    Null keys are a group. No task holds a group: its values meet the group's few
    brackets where they lie, and only counted cells are shuffled."""
    by, cols = list(by), list(dict.fromkeys(cols))
    values = ", ".join(f"named_struct('_k', {i}, '_v', CAST({q(c)} AS DOUBLE))" for i, c in enumerate(cols))
    long = df.select(*by, F.expr(f"inline(array({values}))"))
    long = materialize(long.where(F.col("_v").isNotNull() & ~F.isnan("_v")))
    keys = [*by, "_k"]
    stats = materialize(long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b")))
    place = [F.col("_n").cast("double") * p - p for p in probs]
    ranks = F.array_distinct(F.array(*[f(h).cast("long") for h in place for f in (F.floor, F.ceil)]))
    state = stats.select(*keys, F.explode(ranks).alias("_r"), "_a", "_b", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_in"))
    at = F.col("_r") - F.col("_below")
    is_open = (F.col("_a") < F.col("_b")) & (at > 0) & (at < F.col("_in") - 1)
    while True:
        state = materialize(state)
        todo = state.where(is_open)
        if todo.isEmpty():
            break
        ends = [*keys, "_a", "_b"]
        met = join_null_safe(long, todo.select(*ends).distinct(), keys).where("_v BETWEEN _a AND _b")
        cells = (met.withColumn("_c", F.expr(_cell("_v", "_a", "_b"))).groupBy(*ends, "_c")
                 .agg(F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_low"), F.max("_v").alias("_high")))
        before = Window.partitionBy(*ends).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.select("*", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
        found = join_null_safe(todo, cells, ends).where((at >= F.col("_before")) & (at < F.col("_before") + F.col("_m")))
        state = state.where(~is_open).unionByName(found.select(
            *keys, "_r", F.col("_low").alias("_a"), F.col("_high").alias("_b"),
            (F.col("_below") + F.col("_before")).alias("_below"), F.col("_m").alias("_in")))
    value = F.when(at == F.col("_in") - 1, F.col("_b")).otherwise(F.col("_a"))
    got = join_null_safe(state.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_r", value))).alias("_at")), stats, keys)
    out = []
    for j, h in enumerate(place):
        low, high = (F.col("_at")[f(h).cast("long")] for f in (F.floor, F.ceil))
        out.append((low + F.when(high > low, (high - low) * (h - F.floor(h))).otherwise(0.0)).alias(f"q{j}"))
    names = F.array(*[F.lit(c) for c in cols])
    return got.select(*by, names[F.col("_k")].alias("column"), *out)

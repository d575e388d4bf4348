"""Order-dependent work on series of any length, in buckets of bounded size.

Rows get a consecutive position in (series, order); a bucket is ``bucket_rows``
neighbouring positions. A window then runs per (series, bucket). What it needs from
outside comes in one of three ways: copies of the rows next to the bucket (``halo``,
for a look-back or look-ahead of fixed size), the nearest values of a small per-bucket
table (``neighbours``), or the state with which the bucket begins (``prefix_sums``,
``affine_scan``). A series with a third of all rows is thereby spread over many tasks.

Every function keeps the frame's rows and columns and adds its own; ``bucketed`` adds
``_gpos`` and ``_hb``, which the others read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import join_null_safe, q
from ..session import materialize
from .windows import _cols, with_row_pos


def bucketed(df: DataFrame, series, order, bucket_rows: int) -> DataFrame:
    """The frame with ``_gpos`` (consecutive position) and ``_hb`` (its bucket)."""
    base = with_row_pos(df, [*_cols(series), *_cols(order)], "_gpos")
    return base.withColumn("_hb", F.floor(F.col("_gpos") / bucket_rows))


def over_bucket(series, last_first: bool = False) -> str:
    """The window of a row's series and bucket, as SQL. What follows a row is asked of the
    rows before it with the last first: Spark runs through frames that end with the
    partition anew for every row."""
    return f"PARTITION BY {', '.join(q(c) for c in [*_cols(series), '_hb'])} ORDER BY _gpos{' DESC' if last_first else ''}"


def halo(base: DataFrame, before: int, after: int, bucket_rows: int) -> DataFrame:
    """Copies of the last ``before`` rows of a bucket for the next one and of the first
    ``after`` rows for the one before. ``home`` removes them again."""
    if max(before, after) > bucket_rows:
        raise ValueError("bucket_rows must not be less than the look-back or look-ahead")
    at = f"_gpos % {bucket_rows}"
    copies = f"array_compact(array(0, IF({at} >= {bucket_rows - before}, 1, NULL), IF({at} < {after}, -1, NULL)))"
    return base.withColumn("_shift", F.explode(F.expr(copies))).withColumn("_hb", F.col("_hb") + F.col("_shift"))


def home(df: DataFrame) -> DataFrame:
    """Only the rows that belong to their bucket."""
    return df.where(F.col("_shift") == 0).drop("_shift")


def neighbours(base: DataFrame, cols: Sequence[str], series) -> DataFrame:
    """``_prev_{c}`` and ``_next_{c}``: position ``p`` and value ``v`` of the nearest
    non-null value strictly before and after the row in its series, null if none."""
    keys = _cols(series)
    some = {c: f"CASE WHEN {q(c)} IS NOT NULL THEN named_struct('p', _gpos, 'v', CAST({q(c)} AS DOUBLE)) END" for c in cols}
    w, back = over_bucket(keys), over_bucket(keys, True)
    near = base.select("*", *[F.expr(f"last({s}, true) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias(f"_lp_{c}")
                              for c, s in some.items()],
                       *[F.expr(f"last({s}, true) OVER ({back} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias(f"_ln_{c}")
                         for c, s in some.items()])
    ends = base.groupBy(*keys, "_hb").agg(*[F.expr(f"max({s})").alias(f"_e_{c}") for c, s in some.items()],
                                          *[F.expr(f"min({s})").alias(f"_s_{c}") for c, s in some.items()])
    up, down = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("_hb", F.desc("_hb")))
    outer = ends.select(*keys, "_hb", *[F.last(f"_e_{c}", True).over(up).alias(f"_op_{c}") for c in cols],
                        *[F.last(f"_s_{c}", True).over(down).alias(f"_on_{c}") for c in cols])
    got = join_null_safe(near, outer, [*keys, "_hb"])
    return got.select(*base.columns, *[F.coalesce(f"_lp_{c}", f"_op_{c}").alias(f"_prev_{c}") for c in cols],
                      *[F.coalesce(f"_ln_{c}", f"_on_{c}").alias(f"_next_{c}") for c in cols])


def prefix_sums(base: DataFrame, sums: Mapping[str, Column], series) -> DataFrame:
    """Running sums within each series, the row included: inside buckets by a window,
    before them by a running sum over the per-bucket totals. Nulls add nothing."""
    keys = _cols(series)
    d = base.withColumns({f"_x_{n}": F.coalesce(x.cast("double"), F.lit(0.0)) for n, x in sums.items()})
    w = over_bucket(keys)
    local = d.select("*", *[F.expr(f"sum({q(f'_x_{n}')}) OVER ({w})").alias(f"_l_{n}") for n in sums])
    spec = Window.partitionBy(*keys).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    total = d.groupBy(*keys, "_hb").agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    begin = total.select(*keys, "_hb", *[F.coalesce(F.sum(f"_t_{n}").over(spec), F.lit(0.0)).alias(f"_o_{n}") for n in sums])
    got = join_null_safe(local, begin, [*keys, "_hb"])
    return got.select(*base.columns, *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in sums])


def affine_scan(base: DataFrame, maps: Mapping[str, tuple[Column, Column]], series, bucket_rows: int,
                pos: str = "_gpos", bucket: str = "_hb") -> DataFrame:
    """Runs a state through each series: every row applies x -> a x + b, and the column
    holds the state behind the row. A row with a = 0 sets it; it is null until then.

    Maps compose, so log2(``bucket_rows``) steps of doubling distance (one ``lag``
    window each, all over the same sorted partitions) give every row the map of its
    bucket's rows up to it. The buckets' maps are a table ``bucket_rows`` times
    smaller, scanned by the same function until a series fits one bucket; the state
    before a bucket is then joined back."""
    keys = _cols(series)
    d = base.withColumns({f"_{k}_{n}": m[i].cast("double") for n, m in maps.items() for i, k in enumerate("ab")})
    w = f"PARTITION BY {', '.join(q(c) for c in [*keys, bucket])} ORDER BY {q(pos)}"
    reach = 1
    while reach < bucket_rows:
        d = d.select("*", *[F.expr(f"lag({q(f'_{k}_{n}')}, {reach}, {1 - i}D) OVER ({w})").alias(f"_p{k}_{n}")
                            for n in maps for i, k in enumerate("ab")])
        d = d.withColumns({f"_b_{n}": F.when(F.col(f"_a_{n}") == 0, F.col(f"_b_{n}"))
                           .otherwise(F.col(f"_a_{n}") * F.col(f"_pb_{n}") + F.col(f"_b_{n}")) for n in maps}
                          | {f"_a_{n}": F.col(f"_a_{n}") * F.col(f"_pa_{n}") for n in maps})
        d = d.drop(*[f"_p{k}_{n}" for n in maps for k in "ab"])
        reach *= 2
    d = materialize(d)
    ends = materialize(d.groupBy(*keys, bucket).agg(*[F.max_by(f"_{k}_{n}", pos).alias(f"_{k}_{n}") for n in maps for k in "ab"]))
    if ends.groupBy(*keys).count().agg(F.max("count")).first()[0] in (None, 1):
        state = ends.select(*keys, bucket, *[F.when(F.col(f"_a_{n}") == 0, F.col(f"_b_{n}")).alias(f"_s_{n}") for n in maps])
    else:
        up = f"{bucket}_up"
        level = ends.withColumn(up, F.floor(F.col(bucket) / bucket_rows))
        state = affine_scan(level.select(*keys, bucket, up, *[F.col(f"_{k}_{n}").alias(f"_m{k}_{n}") for n in maps for k in "ab"]),
                            {f"_s_{n}": (F.col(f"_ma_{n}"), F.col(f"_mb_{n}")) for n in maps}, keys, bucket_rows, bucket, up)
    # a series' buckets are consecutive numbers: the state before one is that behind the last
    before = state.select(*keys, (F.col(bucket) + 1).alias(bucket), *[f"_s_{n}" for n in maps])
    got = join_null_safe(d, before, [*keys, bucket], "left")
    return got.select(*base.columns, *[F.when(F.col(f"_a_{n}") == 0, F.col(f"_b_{n}"))
                                       .otherwise(F.col(f"_a_{n}") * F.col(f"_s_{n}") + F.col(f"_b_{n}")).alias(n) for n in maps])

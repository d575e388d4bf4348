"""CSV ingest and schema capture."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Index columns written by pandas ("Unnamed: 0") or named by Spark for an empty header ("_c0").
UNNAMED = re.compile(r"^(Unnamed|_c\d+$)")


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             overrides: dict | None = None, infer: bool = False) -> DataFrame:
    """Header CSV scan. Give a full ``schema`` in production; ``infer``
    runs Spark's inference pass (one extra scan) and ``overrides`` then
    casts named columns (the reference pins year as long, target as double)."""
    r = spark.read.option("header", True)
    if schema is not None:
        df = r.schema(schema).csv(path)
    else:
        df = r.option("inferSchema", bool(infer)).csv(path)
    for c, t in (overrides or {}).items():
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast(t))
    return df


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop index columns (pandas ``Unnamed: n`` or Spark ``_cN``)."""
    return df.drop(*[c for c in df.columns if UNNAMED.match(c)])


def with_file_order(df: DataFrame, name: str = "row_pos") -> DataFrame:
    """Capture file order once at ingest as a consecutive position
    (``monotonically_increasing_id`` follows file splits in order; the
    per-partition offsets make it consecutive)."""
    from ..operators.windows import with_row_pos
    return with_row_pos(df.withColumn("_mid0", F.monotonically_increasing_id()),
                        ["_mid0"], name).drop("_mid0")


def capture_schema(df: DataFrame, time_col: str | None = None) -> dict:
    """S3: columns, types, shape and the time range from ONE aggregate."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if time_col and time_col in df.columns:
        aggs += [F.min(time_col).alias("tmin"), F.max(time_col).alias("tmax")]
    r = df.agg(*aggs).first()
    return {"columns": df.columns,
            "dtypes": {f.name: f.dataType.simpleString() for f in df.schema.fields},
            "shape": [int(r["n"]), len(df.columns)],
            "date_range": [str(r["tmin"]), str(r["tmax"])] if time_col and time_col in df.columns
            else None}


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    """Name check, no job."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")


def write_scored(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> None:
    """S6 sink: input columns plus ``prediction``; parquet by default, CSV
    with a header when asked."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)

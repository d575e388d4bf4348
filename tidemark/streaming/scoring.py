"""Streaming scoring (stateless), per-micro-batch drift checks, and
stateful lag features across micro-batches.

* Stateless parts (scaling, dummies, linear / GLM / tree scoring, the
  prediction clip) run on a streaming DataFrame unchanged.
* ``lag`` over a stream is not allowed by Spark; ``stream_lags`` keeps the
  last ``max(lags)`` values of every series in state
  (``applyInPandasWithState``), so each micro-batch row gets the same lags
  a batch window over the whole history would give, as long as rows of a
  series arrive in time order (late rows are flagged, not re-ordered).
* ``drift_monitor`` compares every micro-batch's feature means with the
  training means (A22) inside ``foreachBatch``; a batch run again replaces its report.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, directory: str, schema: StructType, glob: str | None = None,
                files_per_trigger: int = 1) -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(directory)


def run_to_parquet(df: DataFrame, path: str, checkpoint: str, output_mode: str = "append") -> None:
    """Drain everything available into a parquet sink (exactly-once with the
    checkpoint in the shared folder), then stop."""
    q = (df.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).outputMode(output_mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_lags(df: DataFrame, key: str, order: Sequence[str], value: str,
                lags: Sequence[int] = (1,)) -> DataFrame:
    """W1 on a stream: lags of ``value`` per ``key`` across micro-batches.
    State per key: the last max(lags) values and the last order key (numbers or
    times). A row that comes after a later one of an earlier micro-batch is
    ``late``: it gets null lags and leaves the history as it is."""
    order = list(order)
    for c in order:
        if df.schema[c].dataType.typeName() not in ("long", "integer", "short", "byte", "double", "float",
                                                    "date", "timestamp", "timestamp_ntz"):
            raise ValueError(f"order column {c} must be a number or a time")
    h = max(lags)
    out_schema = _out_schema(df, key, order, value, lags)
    state_schema = "hist array<double>, last_order array<double>"

    def step(k, pdfs, state):
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(order, kind="mergesort")
        hist, last = ([], None)
        if state.exists:
            hist, last = list(state.get[0] or []), list(state.get[1])
        at = list(zip(*[_numbers(pdf[c]) for c in order]))
        late = [last is not None and list(t) < last for t in at]
        vals, lagged = list(hist), {lag: [] for lag in lags}
        for v, is_late in zip(pdf[value].astype("float64").tolist(), late):
            for lag in lags:
                lagged[lag].append(vals[-lag] if not is_late and lag <= len(vals) else None)
            if not is_late:
                vals.append(v)
        res = pdf[[key, *order, value]].copy()
        for lag in lags:
            res[f"{value}_lag_{lag}"] = lagged[lag]
        res["late"] = late
        state.update((vals[-h:], max([list(t) for t in at] + ([last] if last else []))))
        yield res

    return df.groupBy(key).applyInPandasWithState(
        step, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def _out_schema(df, key, order, value, lags) -> StructType:
    from pyspark.sql.types import BooleanType, DoubleType, StructField
    fields = [df.schema[c] for c in [key, *order, value]]
    return StructType(fields + [StructField(f"{value}_lag_{k}", DoubleType()) for k in lags]
                      + [StructField("late", BooleanType())])


def _numbers(s: pd.Series) -> list[float]:
    """Order values as comparable numbers; times in microseconds."""
    if s.dtype == object or "datetime" in str(s.dtype):
        s = pd.to_datetime(s).astype("datetime64[us]").astype("int64")
    return s.astype("float64").tolist()


def drift_monitor(train_means: dict, report_path: str, threshold: float = 0.1):
    """A22 / O6 per micro-batch: a ``foreachBatch`` function that reports (feature,
    mean_train, mean_batch, rows, nulls, drift) under ``batch_id=<id>`` of
    ``report_path``. A batch that is run again replaces its own report, so nothing
    counts twice; ``batch_id`` is a column when the folder is read."""
    cols = list(train_means)

    def fn(batch: DataFrame, batch_id: int):
        aggs = [F.count(F.lit(1)).alias("_rows")]
        for c in cols:
            aggs += [F.avg(c).alias(f"{c}|m"), F.count_if(F.col(c).isNull()).alias(f"{c}|n")]
        r = batch.agg(*aggs).first()
        rows = [(c, float(train_means[c]),
                 None if r[f"{c}|m"] is None else float(r[f"{c}|m"]), int(r["_rows"]), int(r[f"{c}|n"]),
                 bool(r[f"{c}|m"] is not None and
                      abs(r[f"{c}|m"] - train_means[c]) > threshold * abs(train_means[c])))
                for c in cols]
        batch.sparkSession.createDataFrame(
            rows, "feature string, mean_train double, mean_batch double, rows long, "
                  "nulls long, drift boolean").coalesce(1).write.mode("overwrite").parquet(f"{report_path}/batch_id={int(batch_id)}")
    return fn

"""Feature preparation.

Estimators follow a small fit / transform protocol: ``fit(df)`` runs ONE
aggregate over the training data and returns a fitted object holding only
a few numbers per column (JSON-serialisable, saved with the model package);
``transform(df)`` is a single ``select`` of column expressions, so it runs
inside whole-stage codegen on batch and streaming DataFrames alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import dlit, join_null_safe, q
from ..session import stored
from .buckets import affine_scan, bucketed, halo, home, neighbours, over_bucket
from .quantile import column_quantiles
from .windows import _cols, fill_forward_backward


# --------------------------------------------------------------------- F1 / F2

@dataclass
class FittedImputer:
    """F1/F2 fitted state: the fill value of every column."""
    values: dict
    strategy: str = "median"

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.expr(f"coalesce({q(c)}, {dlit(v)})")
                               for c, v in self.values.items() if c in df.columns and v is not None})

    def to_dict(self):
        return asdict(self)


def fit_imputer(df: DataFrame, cols: Sequence[str], strategy: str = "median") -> FittedImputer:
    """F1 (median of features and target) / F2 (median or mean). Exact medians by
    selection; ``pyspark.ml.feature.Imputer`` uses approximate ones."""
    if strategy == "median":
        row = {c: v[0] for c, v in column_quantiles(df, cols, (0.5,)).items()}
    elif strategy == "mean":
        row = df.agg(*[F.expr(f"avg({q(c)}) AS {q(c)}") for c in cols]).first()
    else:
        raise ValueError("strategy must be median or mean; use fill_forward_backward for ffill")
    return FittedImputer({c: (None if row[c] is None else float(row[c])) for c in cols}, strategy)


def fill_chain(df: DataFrame, cols: Sequence[str], train_medians: dict, series=None,
               order=None, skew_safe: bool = False) -> DataFrame:
    """F3 scoring fill: forward fill -> backward fill (per series) ->
    training median -> median of the data being scored (a column that is
    entirely null falls back to the training median)."""
    cols = list(cols)
    filled = fill_forward_backward(df, cols, series=series, order=order, skew_safe=skew_safe)
    new = [c for c in cols if train_medians.get(c) is None]      # only these need the scored data
    cur = {c: v[0] for c, v in column_quantiles(filled, new, (0.5,)).items()} if new else {}
    return filled.withColumns({
        c: F.expr(f"coalesce({q(c)}, {dlit(cur[c] if c in cur else train_medians[c])})") for c in cols})


# --------------------------------------------------------------------- F5 / F6 / K1

@dataclass
class FittedScaler:
    """``(x - center) / scale`` per column."""
    center: dict
    scale: dict
    kind: str

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: F.expr(f"({q(c)} - {dlit(self.center[c])}) / {dlit(self.scale[c])}")
            for c in self.center if c in df.columns})

    def to_dict(self):
        return asdict(self)


def fit_robust_scaler(df: DataFrame, cols: Sequence[str]) -> FittedScaler:
    """centre by the exact median, divide by Q3 - Q1 (a zero range
    divides by 1, as scikit-learn does). Spark's ``RobustScaler`` uses
    approximate quantiles and does not centre by default. A column without
    values is left as it is."""
    found = {c: v for c, v in column_quantiles(df, cols, (0.25, 0.5, 0.75)).items() if v[0] is not None}
    center = {c: float(m) for c, (_, m, _) in found.items()}
    scale = {c: (float(b - a) or 1.0) for c, (a, _, b) in found.items()}
    return FittedScaler(center, scale, "robust")


def fit_standard_scaler(df: DataFrame, cols: Sequence[str]) -> FittedScaler:
    """F6 standard: population std (scikit-learn); zero std divides by 1."""
    row = df.agg(*[F.expr(e) for c in cols for e in (f"avg({q(c)}) AS {q(c + '|m')}",
                                                     f"stddev_pop({q(c)}) AS {q(c + '|s')}")]).first()
    return FittedScaler({c: float(row[f"{c}|m"]) for c in cols},
                        {c: (float(row[f"{c}|s"]) or 1.0) for c in cols}, "standard")


def fit_minmax_scaler(df: DataFrame, cols: Sequence[str]) -> FittedScaler:
    """F6 min-max: ``(x - min) / (max - min)``; a zero range divides by 1."""
    row = df.agg(*[F.expr(e) for c in cols for e in (f"min({q(c)}) AS {q(c + '|a')}",
                                                     f"max({q(c)}) AS {q(c + '|b')}")]).first()
    return FittedScaler({c: float(row[f"{c}|a"]) for c in cols},
                        {c: (float(row[f"{c}|b"] - row[f"{c}|a"]) or 1.0) for c in cols}, "minmax")


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str) -> FittedScaler | None:
    kind = (kind or "none").lower()
    if kind in ("none", "off"):
        return None
    return {"robust": fit_robust_scaler, "standard": fit_standard_scaler,
            "minmax": fit_minmax_scaler}[kind](df, cols)


@dataclass
class FittedQuantileScaler:
    """K1: map each value to its empirical CDF position by linear
    interpolation on a fitted quantile grid (the grid has ``n_quantiles``
    points per column: bounded size, inlined as literals)."""
    grids: dict

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, grid in self.grids.items():
            n = len(grid) - 1
            x = F.col(c)
            expr = F.when(x <= F.lit(grid[0]), F.lit(0.0))
            for i in range(n):
                lo, hi = grid[i], grid[i + 1]
                frac = F.lit(0.0) if hi == lo else (x - F.lit(lo)) / F.lit(hi - lo)
                expr = expr.when(x <= F.lit(hi), (F.lit(float(i)) + frac) / F.lit(float(n)))
            out[c] = expr.otherwise(F.lit(1.0))
        return df.withColumns(out)


def fit_quantile_scaler(df: DataFrame, cols: Sequence[str], n_quantiles: int = 20) -> FittedQuantileScaler:
    """K1: the exact quantile grid of the training rows. A column without values is
    left as it is."""
    found = column_quantiles(df, cols, [i / n_quantiles for i in range(n_quantiles + 1)])
    return FittedQuantileScaler({c: v for c, v in found.items() if v[0] is not None})


# --------------------------------------------------------------------- F7 / W5

# The reference's crisis periods (inclusive year ranges) and
# permanent regime starts, in its order.
DEFAULT_PERIODS = {
    "crisis_2008": (2008, 2009),
    "crisis_eurozone": (2010, 2012),
    "crisis_covid": (2020, 2022),
    "crisis_ukraine": (2022, 2024),
}
DEFAULT_REGIMES = {"post_2008_regime": 2008, "post_covid_regime": 2020}
# Trend-interaction names paired with the regimes above.
DEFAULT_TREND_BREAKS = {"trend_post_2008": "post_2008_regime",
                        "trend_post_covid": "post_covid_regime"}


@dataclass
class StructuralBreaks:
    """crisis flags, regime flags, trend from the training base year,
    trend x regime and a high-volatility OR of the crisis flags. The year is
    used as an integer (defect D2 of the reference read it as nanoseconds)."""
    periods: dict = field(default_factory=lambda: dict(DEFAULT_PERIODS))
    regimes: dict = field(default_factory=lambda: dict(DEFAULT_REGIMES))
    trend_breaks: dict = field(default_factory=lambda: dict(DEFAULT_TREND_BREAKS))
    base_year: int | None = None

    def names(self) -> list[str]:
        return [*self.periods, *self.regimes, "trend", *self.trend_breaks, "high_volatility"]

    def fit(self, df: DataFrame, year_col: str = "year") -> "StructuralBreaks":
        base = df.agg(F.min(year_col)).first()[0]
        return StructuralBreaks(dict(self.periods), dict(self.regimes), dict(self.trend_breaks),
                                int(base))

    def transform(self, df: DataFrame, year_col: str = "year") -> DataFrame:
        if self.base_year is None:
            raise ValueError("fit first: the trend base year comes from training")
        y = F.col(year_col)
        cols = {n: y.between(a, b).cast("int") for n, (a, b) in self.periods.items()}
        cols.update({n: (y >= s).cast("int") for n, s in self.regimes.items()})
        trend = (y - F.lit(self.base_year)).cast("long")
        cols["trend"] = trend
        cols.update({n: (y >= self.regimes[r]).cast("long") * trend
                     for n, r in self.trend_breaks.items()})
        hv = None
        for n, (a, b) in self.periods.items():
            hv = y.between(a, b) if hv is None else hv | y.between(a, b)
        cols["high_volatility"] = (hv if hv is not None else F.lit(False)).cast("int")
        return df.withColumns(cols)


# --------------------------------------------------------------------- K5 / K7 / K9 / K11

def interpolate_linear(df: DataFrame, cols: Sequence[str], series=None, order=None,
                       pos_col: str | None = None, bucket_rows: int = 1 << 17) -> DataFrame:
    """K5: linear interpolation between the previous and next non-null
    values (by row position within the series, or by ``pos_col``); edges stay
    null. Each bucket takes the nearest values outside it from a small per-bucket
    table, forwards and backwards, so no task holds a whole series."""
    if not cols:
        return df
    at, kept = {c: q(c) for c in cols}, df.columns
    if pos_col is not None:         # the position travels with the value
        df = df.withColumns({f"_at_{c}": F.when(F.col(c).isNotNull(), F.col(pos_col)) for c in cols})
    base = bucketed(df, series, order, bucket_rows)
    near = neighbours(base, [*cols, *([f"_at_{c}" for c in cols] if pos_col is not None else [])], series)
    out = {}
    for c in cols:
        p, n = q(f"_prev_{c}"), q(f"_next_{c}")
        here, a, b = ("_gpos", f"{p}.p", f"{n}.p") if pos_col is None else (q(pos_col), f"{q(f'_prev__at_{c}')}.v", f"{q(f'_next__at_{c}')}.v")
        out[c] = F.expr(f"coalesce(CAST({at[c]} AS DOUBLE), {p}.v + ({n}.v - {p}.v) * ({here} - {a}) / nullif({b} - {a}, 0))")
    return near.withColumns(out).select(*kept)


def polynomial_features(df: DataFrame, cols: Sequence[str], degree: int = 2,
                        interactions: bool = True) -> DataFrame:
    """K7: squares (and higher powers) plus pairwise products, as columns."""
    out = {}
    for c in cols:
        for d in range(2, degree + 1):
            out[f"{c}_pow_{d}"] = F.expr(f"power({q(c)}, {dlit(d)})")
    if interactions:
        for i, a in enumerate(cols):
            for b in cols[i + 1:]:
                out[f"{a}_x_{b}"] = F.expr(f"{q(a)} * {q(b)}")
    return df.withColumns(out)


def rolling_moments(df: DataFrame, cols: Sequence[str], window: int, series=None,
                    order=None, skew_safe: bool = False, bucket_rows: int = 1 << 20) -> DataFrame:
    """K9: rolling skewness and excess kurtosis (population forms) over
    complete windows; ``skew_safe`` runs it in halo buckets."""
    from pyspark.sql import Window
    d = halo(bucketed(df, series, order, bucket_rows), window - 1, 0, bucket_rows) if skew_safe else df
    part, by = ([*_cols(series), "_hb"], ["_gpos"]) if skew_safe else (_cols(series), _cols(order))
    spec = Window.partitionBy(*part).orderBy(*by).rowsBetween(1 - window, 0)
    out = {}
    for c in cols:
        full = F.count(F.col(c)).over(spec) == window
        out[f"{c}_roll_skew_{window}"] = F.when(full, F.skewness(c).over(spec))
        out[f"{c}_roll_kurt_{window}"] = F.when(full, F.kurtosis(c).over(spec))
    got = d.withColumns(out)
    return home(got).select(*df.columns, *out) if skew_safe else got


def seasonal_features(df: DataFrame, cols: Sequence[str], periods: Sequence[int], phase_col: str,
                      series=None, order=None, skew_safe: bool = False, bucket_rows: int = 1 << 20) -> DataFrame:
    """Seasonal differences ``x - lag(x, period)`` and sin/cos of the
    phase ``phase_col mod period``; ``skew_safe`` runs it in halo buckets."""
    from pyspark.sql import Window
    d = halo(bucketed(df, series, order, bucket_rows), max(periods, default=0), 0, bucket_rows) if skew_safe else df
    part, by = ([*_cols(series), "_hb"], ["_gpos"]) if skew_safe else (_cols(series), _cols(order))
    spec = Window.partitionBy(*part).orderBy(*by)
    out = {}
    for p in periods:
        for c in cols:
            out[f"{c}_sdiff_{p}"] = F.col(c) - F.lag(c, p).over(spec)
        ang = F.lit(2 * 3.141592653589793 / p) * (F.col(phase_col) % p)
        out[f"sin_{p}"] = F.sin(ang)
        out[f"cos_{p}"] = F.cos(ang)
    got = d.withColumns(out)
    return home(got).select(*df.columns, *out) if skew_safe else got


def zscore_outliers(df: DataFrame, cols: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """K6 (z-score): flag ``|x - mean| / std > threshold`` per column."""
    row = df.agg(*[e for c in cols for e in (F.avg(c).alias(f"{c}|m"),
                                             F.stddev_samp(c).alias(f"{c}|s"))]).first()
    out = {}
    for c in cols:
        m, s = row[f"{c}|m"], row[f"{c}|s"]
        out[f"{c}_zoutlier"] = (F.lit(False) if not s else
                                (F.abs(F.col(c) - F.lit(m)) / F.lit(s) > threshold))
    return df.withColumns(out)


# --------------------------------------------------------------------- K8 / K10

def _ema_map(x: Column, gap: Column, first: Column, span: int) -> tuple[Column, Column]:
    """One observation's step of an exponential average (not adjusted, as pandas): the
    old value has the weight (1 - alpha) ** gap, the new one alpha. Nulls change nothing."""
    alpha = 2.0 / (span + 1)
    old = F.pow(F.lit(1.0 - alpha), gap)
    a = F.when(x.isNull(), 1.0).when(first, 0.0).otherwise(old / (old + alpha))
    b = F.when(x.isNull(), 0.0).when(first, x).otherwise(F.lit(alpha) * x / (old + alpha))
    return a, b


def financial_features(df: DataFrame, col: str, series=None, order=None, rsi_window: int = 14,
                       fast: int = 12, slow: int = 26, signal: int = 9, bucket_rows: int = 1 << 10) -> DataFrame:
    """K8: RSI over ``rsi_window`` rows (mean gain / mean loss) and MACD =
    EMA(fast) - EMA(slow) with its signal EMA. RSI runs in halo buckets; the
    exponential averages are scans of affine maps (``affine_scan``), so a series of
    any length is spread over many tasks. A null keeps the averages and lets the old
    weight decay, as pandas ``ewm(adjust=False)`` does."""
    x = q(col)
    rsi, macd, sig = f"{col}_rsi_{rsi_window}", f"{col}_macd", f"{col}_macd_signal"
    w = over_bucket(series)
    base = bucketed(df.withColumn("_v", F.expr(f"CAST({x} AS DOUBLE)")), series, order, bucket_rows)
    d = halo(base, rsi_window, 0, bucket_rows).select("*", F.expr(f"_v - lag(_v) OVER ({w})").alias("_diff"))
    fr = f"({w} ROWS BETWEEN {rsi_window - 1} PRECEDING AND CURRENT ROW)"
    d = home(d.select("*", *[F.expr(f"{e} OVER {fr}").alias(n) for n, e in (
        ("_n", "count(_diff)"), ("_gain", "avg(greatest(_diff, 0D))"), ("_loss", "avg(greatest(-_diff, 0D))"))]))
    d = d.withColumn(rsi, F.expr(f"CASE WHEN _n = {rsi_window} THEN CASE WHEN _loss = 0 THEN 100D "
                                 "ELSE 100 - 100 / (1 + _gain / nullif(_loss, 0)) END END"))
    d = neighbours(d, ["_v"], series)
    v, gap = F.col("_v"), (F.col("_gpos") - F.col("_prev__v.p")).cast("double")
    first = F.col("_prev__v").isNull()
    d = affine_scan(d, {n: _ema_map(v, gap, first, s) for n, s in (("_fast", fast), ("_slow", slow))}, series, bucket_rows)
    d = d.withColumn(macd, F.col("_fast") - F.col("_slow"))
    begin = first & v.isNotNull()                   # from the first value on MACD has no nulls
    d = affine_scan(d, {sig: _ema_map(F.col(macd), F.lit(1.0), begin, signal)}, series, bucket_rows)
    return d.select(*df.columns, rsi, macd, sig)


_TERM = re.compile(r"[A-Za-z0-9_]{2,}")
#: (row, term) pairs of an Arrow batch.
_PAIRS = 100_000


def _row_counts(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(doc, term, tf) of every row, counted where the row lies."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, terms, counts = [], [], []

            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.string()), pa.array(counts, pa.int64())],
                                                  [id_col, "term", "tf"])

            for i, text in enumerate(b.column(1)):
                tf = Counter(_TERM.findall(text.as_py() or ""))
                rows.extend([i] * len(tf))
                terms.extend(tf)
                counts.extend(tf.values())
                if len(rows) >= _PAIRS:
                    yield batch()
                    rows, terms, counts = [], [], []
            if rows:
                yield batch()

    return docs.select(id_col, F.lower(F.col(text_col)).alias("__text")).mapInArrow(run, schema)


def text_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """K10 counts with an exact vocabulary: (doc, term, tf) of every term of the
    whole text: of two and more of [A-Za-z0-9_] (what is left between ``\\W+``), lower-cased.
    No vocabulary is collected and none is cut. A document in one row is counted there,
    without a shuffle; only the counts of ids with several rows are added up over them."""
    many = stored(docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > 1))
    if many.isEmpty():
        return _row_counts(docs, text_col, id_col)
    rows = join_null_safe(docs.select(id_col, text_col), many, [id_col], "left")
    again = _row_counts(rows.where(F.col("__rows").isNotNull()), text_col, id_col)
    return _row_counts(rows.where(F.col("__rows").isNull()), text_col, id_col).unionByName(
        again.groupBy(id_col, "term").agg(F.sum("tf").alias("tf")))


def term_weights(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_df: int = 2) -> DataFrame:
    """K10 vocabulary table: per term its documents, occurrences and smoothed idf."""
    return _weights(text_counts(docs, text_col, id_col), docs.count(), min_df)


def _weights(tf: DataFrame, n: int, min_df: int) -> DataFrame:
    return tf.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")).withColumn(
        "idf", F.when(F.col("df") >= min_df, F.log(F.lit(float(n + 1)) / (F.col("df") + F.lit(1.0)))).otherwise(F.lit(0.0)))


def tfidf_terms(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                min_df: int = 2) -> DataFrame:
    """K10 as DataFrame operations with an exact vocabulary: term frequency per
    (doc, term) by ``text_counts``, document frequency per term (partial
    aggregate before the shuffle, so a term present in every document is
    a counter, not a hot group) and Spark's smoothed idf
    ``ln((n + 1) / (df + 1))``, 0 below ``min_df``. The table of terms is stored, so
    its size is known before the join: a small one is broadcast and the (doc, term)
    rows stay where they are, else they are shuffled once, by term, where
    AQE's skew handling splits the partition of a very common one. The
    document count is one scalar, inlined as a literal."""
    tf = text_counts(docs, text_col, id_col)
    weights = stored(_weights(tf, docs.count(), min_df).drop("tf"))
    return tf.join(weights, "term").withColumn("tfidf", F.col("tf") * F.col("idf"))


def tfidf_doc_summary(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                      min_df: int = 2) -> DataFrame:
    """Per document: token count, number of terms with a non-zero weight and
    the L2 norm of the tf-idf vector (documents without tokens give 0)."""
    t = tfidf_terms(docs, text_col, id_col, min_df)
    s = t.groupBy(id_col).agg(F.sum("tf").alias("n_tokens"),
                              F.count_if(F.col("idf") > 0).alias("n_terms"),
                              F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("tfidf_l2"))
    return (docs.select(id_col).join(s, id_col, "left")
            .select(id_col, F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"),
                    F.coalesce("n_terms", F.lit(0)).cast("long").alias("n_terms"),
                    F.coalesce("tfidf_l2", F.lit(0.0)).alias("tfidf_l2")))


@dataclass
class WordVectors:
    """K10 word2vec: the fitted model and the least count of a word in it."""
    model: object
    least: int
    text_col: str

    def transform(self, docs: DataFrame, output: str = "vector") -> DataFrame:
        """``output``: the mean vector of a document's known words (zeros without any)."""
        words = docs.withColumn("_words", _tokens(self.text_col))
        return self.model.setOutputCol(output).transform(words).drop("_words")


def _tokens(text_col: str) -> Column:
    """Lower-cased words of two and more characters, as in ``text_counts``."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\W+"), lambda w: F.length(w) >= 2)


def fit_word_vectors(docs: DataFrame, text_col: str = "text", size: int = 32, window: int = 5, min_count: int = 5,
                     max_words: int = 100_000, partitions: int = 8, iterations: int = 1, step: float = 0.025,
                     seed: int = 42) -> WordVectors:
    """K10 word2vec: skip-gram embeddings (Spark ML ``Word2Vec``) trained on all
    documents' whole texts. The vocabulary is the words with ``min_count`` occurrences;
    if they are more than ``max_words``, the least count is raised until they are not
    (counts by one aggregate, the threshold from a table of counts). So the model, which
    the driver and every task hold, has at most max_words * size numbers. Sentences are
    split over ``partitions`` tasks, whose vectors are averaged after each iteration."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.sql import Window
    words = docs.select(_tokens(text_col).alias("_words"))
    counts = words.select(F.explode("_words").alias("w")).groupBy("w").count().where(F.col("count") >= min_count)
    # a row per distinct count: few, as n words have at most sqrt(2 n) different counts
    level = counts.groupBy("count").agg(F.count(F.lit(1)).alias("n"))
    more = level.select("count", F.sum("n").over(Window.orderBy(F.col("count").desc())).alias("held"))
    least = more.where(F.col("held") <= max_words).agg(F.min("count")).first()[0]
    if least is None:
        raise ValueError("no word is frequent enough, or too many are equally frequent")
    w2v = Word2Vec(vectorSize=size, windowSize=window, minCount=int(least), numPartitions=partitions, maxIter=iterations,
                   stepSize=step, seed=seed, inputCol="_words", outputCol="vector")
    return WordVectors(w2v.fit(words), int(least), text_col)

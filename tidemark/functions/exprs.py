"""Column expressions shared by operators. All stay inside whole-stage
codegen; ANSI mode is on, so every division is guarded."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """a / b, null when b is 0 or null (no ANSI divide-by-zero error)."""
    return F.try_divide(col(a), F.nullif(col(b), F.lit(0)))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null, so rows of a series
    without a key stay; the keys appear once, from ``left``."""
    names = {k: f"__join_{i}" for i, k in enumerate(keys)}
    r = right.withColumnsRenamed(names)
    cond = reduce(Column.__and__, [left[k].eqNullSafe(r[n]) for k, n in names.items()])
    return left.join(r, cond, how).drop(*names.values())


def q(name: str) -> str:
    """Quote a column name for a SQL expression string."""
    return "`" + name.replace("`", "``") + "`"


def dlit(v) -> str:
    """A Python number as a DOUBLE literal for a SQL expression string. A bare
    ``repr(0.5)`` parses as DECIMAL, which would move ``bigint - 0.5`` into
    decimal arithmetic (and can overflow); ``None`` becomes a typed null."""
    if v is None:
        return "CAST(NULL AS DOUBLE)"
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def rnd(c, digits: int) -> Column:
    """Round half away from zero on the scaled double: ``round(x*10^d)/10^d``.
    This is bit-for-bit the rule DuckDB applies, so both sides of the oracle
    check agree on ties; ``+ 0.0`` folds a negative zero. Built as one SQL
    expression string (one JVM call instead of one per node)."""
    m = float(10 ** digits)
    if isinstance(c, str):
        return F.expr(f"round(CAST({q(c)} AS DOUBLE) * {dlit(m)}, 0) / {dlit(m)} + 0.0D")
    return F.round(c.cast("double") * F.lit(m), 0) / F.lit(m) + F.lit(0.0)


def safe_corr(x, y) -> Column:
    """Pearson correlation as an aggregate; null for a constant column
    (``F.corr`` would divide by zero under ANSI)."""
    sx, sy = F.stddev_pop(col(x)), F.stddev_pop(col(y))
    return safe_div(F.covar_pop(col(x), col(y)), sx * sy)


def sample_skewness(c) -> Column:
    """Bias-corrected skewness (pandas ``skew``); Spark's ``skewness`` is the
    population form: G1 = g1 * sqrt(n(n-1)) / (n-2)."""
    n = F.count(col(c)).cast("double")
    g1 = F.skewness(col(c))
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_excess_kurtosis(c) -> Column:
    """Bias-corrected excess kurtosis (pandas ``kurt``) from Spark's
    population excess kurtosis."""
    n = F.count(col(c)).cast("double")
    g2 = F.kurtosis(col(c))
    return F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))


def is_numeric_type(dt) -> bool:
    from pyspark.sql.types import NumericType
    return isinstance(dt, NumericType)

"""Feature steps as ``pyspark.ml`` stages.

Each stage is a Transformer, or an Estimator with its Model, and works in
``pyspark.ml.Pipeline`` and ``CrossValidator`` beside Spark's own stages. Settings
are ``Params``; what a fit learns is a few numbers per column, kept as JSON in the
Param ``fitted``, so ``DefaultParamsWritable`` saves and loads every stage, alone or
in a ``PipelineModel``. The work is that of the functions in ``windows`` and
``features``: declared columns, no collected data.

``inputCols`` not set: all numeric columns but ``excludeCols`` (keys, target). A
Model keeps the columns of its fit and passes over those that a frame lacks.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from ..functions.exprs import is_numeric_type
from . import features as FE
from . import selection as SE
from . import windows as W

_LIST, _INTS, _STR, _INT, _BOOL, _FLOAT = (TypeConverters.toListString, TypeConverters.toListInt, TypeConverters.toString,
                                           TypeConverters.toInt, TypeConverters.toBoolean, TypeConverters.toFloat)


class _Columns(HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Input columns: named, or all numbers but some."""
    excludeCols = Param(Params._dummy(), "excludeCols", "columns that are not inputs when inputCols is not set", _LIST)

    def __init__(self):
        super().__init__()
        self._setDefault(excludeCols=[])

    def columns(self, df: DataFrame) -> list[str]:
        if self.isSet(self.inputCols):
            return list(self.getInputCols())
        out = set(self.getOrDefault(self.excludeCols))
        return [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name not in out]

    def setParams(self, **kwargs):
        return self._set(**kwargs)


class _Series(_Columns):
    """Columns that are read in the order of a series."""
    seriesCols = Param(Params._dummy(), "seriesCols", "columns that name a series; none: one series", _LIST)
    orderCols = Param(Params._dummy(), "orderCols", "columns that order a series' rows", _LIST)
    skewSafe = Param(Params._dummy(), "skewSafe", "run in buckets of bounded size, for series of any length", _BOOL)

    def __init__(self):
        super().__init__()
        self._setDefault(seriesCols=[], skewSafe=False)

    def columns(self, df: DataFrame) -> list[str]:
        keys = {*self.getOrDefault(self.seriesCols), *self.getOrDefault(self.orderCols)}
        return [c for c in super().columns(df) if self.isSet(self.inputCols) or c not in keys]

    def places(self) -> dict:
        return {"series": self.getOrDefault(self.seriesCols), "order": self.getOrDefault(self.orderCols)}


class _Fitted(Model, _Columns):
    """A model whose state is the JSON text in ``fitted``."""
    fitted = Param(Params._dummy(), "fitted", "what the fit learnt, as JSON", _STR)

    def state(self) -> dict:
        return json.loads(self.getOrDefault(self.fitted))


def _learnt(model: _Fitted, estimator: Params, state: dict) -> _Fitted:
    """The model with its estimator's settings, as far as it has them, and its state."""
    estimator._copyValues(model)
    return model._set(fitted=json.dumps(state))


class CarryValues(Transformer, _Series):
    """Fill gaps forwards, then backwards, within each series."""

    @keyword_only
    def __init__(self, *, inputCols=None, excludeCols=None, seriesCols=None, orderCols=None, skewSafe=None):
        super().__init__()
        self.setParams(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return W.fill_forward_backward(dataset, self.columns(dataset), **self.places(), skew_safe=self.getOrDefault(self.skewSafe))


class Interpolate(Transformer, _Series):
    """K5: linear interpolation within each series; in buckets always."""

    @keyword_only
    def __init__(self, *, inputCols=None, excludeCols=None, seriesCols=None, orderCols=None):
        super().__init__()
        self.setParams(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return FE.interpolate_linear(dataset, self.columns(dataset), **self.places())


class LagRoll(Transformer, _Series):
    """Lags and rolling statistics (mean, std) of the input columns."""
    lags = Param(Params._dummy(), "lags", "rows to look back", _INTS)
    windows = Param(Params._dummy(), "windows", "rows of a rolling window", _INTS)
    stats = Param(Params._dummy(), "stats", "rolling statistics: mean, std", _LIST)

    @keyword_only
    def __init__(self, *, inputCols=None, excludeCols=None, seriesCols=None, orderCols=None, skewSafe=None, lags=None, windows=None, stats=None):
        super().__init__()
        self._setDefault(lags=[], windows=[], stats=["mean"])
        self.setParams(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        g = self.getOrDefault
        return W.add_lag_roll(dataset, self.columns(dataset), g(self.lags), g(self.windows), **self.places(),
                              stats=g(self.stats), skew_safe=g(self.skewSafe))


class DropIncomplete(Transformer, _Columns):
    """P5: rows with a null in an input column go."""

    @keyword_only
    def __init__(self, *, inputCols=None, excludeCols=None):
        super().__init__()
        self.setParams(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.dropna(subset=self.columns(dataset))


class FillMissing(Estimator, _Columns):
    """gaps take the training median or mean. ``requiredCol``: rows without a
    value there do not teach."""
    strategy = Param(Params._dummy(), "strategy", "median or mean", _STR)
    requiredCol = Param(Params._dummy(), "requiredCol", "only rows with a value here teach", _STR)

    @keyword_only
    def __init__(self, *, inputCols=None, excludeCols=None, strategy=None, requiredCol=None):
        super().__init__()
        self._setDefault(strategy="median")
        self.setParams(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "FillMissingModel":
        rows = dataset.dropna(subset=[self.getOrDefault(self.requiredCol)]) if self.isSet(self.requiredCol) else dataset
        kept = FE.fit_imputer(rows, self.columns(dataset), self.getOrDefault(self.strategy))
        return _learnt(FillMissingModel(), self, {"values": kept.values})


class FillMissingModel(_Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return FE.FittedImputer(self.state()["values"]).transform(dataset)


class BreakDummies(Estimator, _Columns):
    """crisis and regime flags, trend from the training's first year, their products."""
    yearCol = Param(Params._dummy(), "yearCol", "integer year", _STR)

    @keyword_only
    def __init__(self, *, yearCol=None):
        super().__init__()
        self._setDefault(yearCol="year")
        self.setParams(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "BreakDummiesModel":
        breaks = FE.StructuralBreaks().fit(dataset, self.getOrDefault(self.yearCol))
        return _learnt(BreakDummiesModel(), self, {"base_year": breaks.base_year})


class BreakDummiesModel(_Fitted):
    yearCol = BreakDummies.yearCol

    def __init__(self):
        super().__init__()
        self._setDefault(yearCol="year")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return FE.StructuralBreaks(base_year=self.state()["base_year"]).transform(dataset, self.getOrDefault(self.yearCol))


class ColumnScaler(Estimator, _Columns):
    """robust (exact median and quartile range), standard (population deviation)
    or minmax scaling, or none; columns keep their names."""
    kind = Param(Params._dummy(), "kind", "robust, standard, minmax or none", _STR)

    @keyword_only
    def __init__(self, *, inputCols=None, excludeCols=None, kind=None):
        super().__init__()
        self._setDefault(kind="robust")
        self.setParams(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "ColumnScalerModel":
        kept = FE.fit_scaler(dataset, self.columns(dataset), self.getOrDefault(self.kind))
        return _learnt(ColumnScalerModel(), self, {"center": kept.center, "scale": kept.scale} if kept else {"center": {}, "scale": {}})


class ColumnScalerModel(_Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        s = self.state()
        return FE.FittedScaler(s["center"], s["scale"], "fitted").transform(dataset)


class TopFeatures(Estimator, _Columns, HasLabelCol, HasOutputCol):
    """The ``k`` input columns with the highest F-score (0: by the sample's size),
    put together as the vector ``outputCol`` that Spark's regressors read."""
    k = Param(Params._dummy(), "k", "number of columns; 0: by the number of rows", _INT)

    @keyword_only
    def __init__(self, *, inputCols=None, excludeCols=None, labelCol=None, outputCol=None, k=None):
        super().__init__()
        self._setDefault(k=0, outputCol="features")
        self.setParams(**self._input_kwargs)

    def columns(self, df: DataFrame) -> list[str]:
        return [c for c in super().columns(df) if c != self.getOrDefault(self.labelCol)]

    def _fit(self, dataset: DataFrame) -> "TopFeaturesModel":
        cols, label = self.columns(dataset), self.getOrDefault(self.labelCol)
        k = self.getOrDefault(self.k) or SE.harrell_k(dataset.count(), len(cols))
        return _learnt(TopFeaturesModel(), self, {"selected": SE.select_k_best(dataset, cols, label, k)[0]})


class TopFeaturesModel(_Fitted, HasLabelCol, HasOutputCol):
    def __init__(self):
        super().__init__()
        self._setDefault(outputCol="features")

    def selected(self) -> list[str]:
        return self.state()["selected"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.selected(), outputCol=self.getOrDefault(self.outputCol)).transform(dataset)

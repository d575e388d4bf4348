"""End-to-end training and scoring flow.

``train`` runs: (optional) impute -> lag / rolling per series -> drop null
rows -> SelectKBest -> scaling -> model tuning with expanding folds ->
champion refit. ``Predictor.predict`` runs the scoring chain on any number
of series / scenarios in ONE plan: schema check -> lag / rolling per series
-> fill chain -> select -> scale -> model, keeping the keys beside the
prediction (the reference returned a bare array).
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import selection as SE
from ..operators import windows as W
from ..operators.models import FittedModel, ModelSpec, fit_model
from ..operators.scoring import prediction_requirements, validate_schema, with_confidence
from ..operators.validation import train_models
from ..session import materialize


@dataclass
class TrainConfig:
    target: str
    time_col: str
    series: list = field(default_factory=list)
    features: list | None = None          # default: all but target/time/keys (P1)
    lags: list = field(default_factory=list)
    windows: list = field(default_factory=list)
    scaler: str = "robust"
    select: bool = True
    k: int | None = None
    cv_folds: int = 5
    impute_first: bool = True
    skew_safe: bool = False


@dataclass
class Predictor:
    config: TrainConfig
    base_features: list
    selected: list
    train_medians: dict
    scaler: FE.FittedScaler | None
    model: FittedModel
    results: DataFrame | None = None
    champion: str | None = None
    schema: dict | None = None
    schema_report: DataFrame | None = None               # S5 report of the last predict

    def engineer(self, df: DataFrame) -> DataFrame:
        c = self.config
        out = W.add_lag_roll(df, self.base_features, c.lags, c.windows, series=c.series,
                             order=c.time_col, skew_safe=c.skew_safe)
        return out

    def predict(self, df: DataFrame, return_confidence: bool = False) -> DataFrame:
        """Score every row of every series in one plan."""
        c = self.config
        self.schema_report = validate_schema(df, self.schema or {}, required=self.base_features + [c.time_col, *c.series])
        x = self.engineer(df)
        x = FE.fill_chain(x, self.selected, self.train_medians, series=c.series, order=c.time_col,
                          skew_safe=c.skew_safe)
        if self.scaler is not None:
            x = self.scaler.transform(x)
        out = self.model.transform(x)
        keep = [*c.series, c.time_col] + ([c.target] if c.target in df.columns else [])
        out = out.select(*keep, "prediction")
        return with_confidence(out) if return_confidence else out

    def requirements(self) -> dict:
        return prediction_requirements(self.config.lags, self.config.windows,
                                       self.base_features, self.selected)

    # S7 / S8 -----------------------------------------------------------
    def save(self, path: str) -> str:
        self.model.save(os.path.join(path, "model"))
        meta = {"config": self.config.__dict__, "base_features": self.base_features,
                "selected": self.selected, "train_medians": self.train_medians,
                "scaler": self.scaler.to_dict() if self.scaler else None,
                "champion": self.champion, "schema": self.schema,
                "requirements": self.requirements()}
        spark = self.model_spark()
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
            .write.mode("overwrite").text(os.path.join(path, "metadata"))
        if self.results is not None:
            self.results.write.mode("overwrite").parquet(os.path.join(path, "cv_results"))
        return path

    @staticmethod
    def model_spark():
        from pyspark.sql import SparkSession
        return SparkSession.getActiveSession()

    @staticmethod
    def load(path: str) -> "Predictor":
        spark = Predictor.model_spark()
        meta = json.loads(spark.read.text(os.path.join(path, "metadata")).first()[0])
        sc = meta["scaler"]
        return Predictor(TrainConfig(**meta["config"]), meta["base_features"], meta["selected"],
                         meta["train_medians"],
                         FE.FittedScaler(sc["center"], sc["scale"], sc["kind"]) if sc else None,
                         FittedModel.load(os.path.join(path, "model")), None, meta["champion"],
                         meta["schema"])


def engineer_training_set(df: DataFrame, cfg: TrainConfig):
    """impute -> lags -> rolling -> drop null rows. Returns
    (frame, base features, candidate features, training medians)."""
    keys = [cfg.target, cfg.time_col, *cfg.series]
    base = cfg.features or [f.name for f in df.schema.fields
                            if f.name not in keys and f.dataType.typeName() in
                            ("double", "long", "integer", "float", "short", "decimal")]
    d = df
    if cfg.impute_first:
        d = FE.fit_imputer(d, base + [cfg.target]).transform(d)
    d = W.add_lag_roll(d, base, cfg.lags, cfg.windows, series=cfg.series, order=cfg.time_col,
                       skew_safe=cfg.skew_safe)
    cand = base + [c for c in d.columns if "_lag_" in c or "_roll_" in c]
    d = d.dropna(subset=cand + [cfg.target])
    # Every later step (selection, scaling, each IRLS / CV fit) reads this
    # frame many times: cut the lineage once in the shared checkpoint folder.
    d = materialize(d)
    med = FE.fit_imputer(d, cand).values
    return d, base, cand, med


def feature_flow_with_dummies(df: DataFrame, base_features: list, dummies: list, lags, windows,
                              series, order, medians: dict | None = None):
    """F8: lag / rolling columns for the base features only (dummy and flag
    columns are never lagged); dummies null -> 0 and never median-filled;
    base and engineered columns filled with medians (the training medians
    when given, else the frame's exact medians, one aggregate). Returns
    (frame, engineered names, medians used)."""
    x = W.add_lag_roll(df, base_features, lags, windows, series=series, order=order)
    eng = [c for c in x.columns if c not in df.columns]
    x = x.fillna(0, subset=list(dummies)) if dummies else x
    imp = (FE.FittedImputer(dict(medians), "median") if medians is not None
           else FE.fit_imputer(x, list(base_features) + eng, "median"))
    return imp.transform(x), eng, imp.values


def train(df: DataFrame, cfg: TrainConfig, specs: list[ModelSpec], parallelism: int = 4) -> Predictor:
    """The whole training flow. The engineered training set is cut from
    its lineage once (reliable checkpoint) before the many CV jobs."""
    d, base, cand, med = engineer_training_set(df, cfg)
    d = materialize(W.with_row_pos(d, [cfg.time_col, *cfg.series], "row_pos"))
    selected = cand
    if cfg.select:
        selected, _ = SE.select_k_best(d, cand, cfg.target, cfg.k)
    scaler = FE.fit_scaler(d, selected, cfg.scaler)
    ds = scaler.transform(d) if scaler else d
    results, champ, model = train_models(specs, ds, selected, cfg.target, cfg.cv_folds,
                                         parallelism=parallelism)
    schema = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return Predictor(cfg, base, selected, med, scaler, model, results, champ, schema)


def fit_single(df: DataFrame, cfg: TrainConfig, spec: ModelSpec, params: dict | None = None) -> Predictor:
    """Features + selection + scaling + one model, no tuning (flagship)."""
    d, base, cand, med = engineer_training_set(df, cfg)
    selected = SE.select_k_best(d, cand, cfg.target, cfg.k)[0] if cfg.select else cand
    scaler = FE.fit_scaler(d, selected, cfg.scaler)
    ds = scaler.transform(d) if scaler else d
    model = fit_model(spec, ds, selected, cfg.target, params)
    schema = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return Predictor(cfg, base, selected, med, scaler, model, None, spec.name, schema)

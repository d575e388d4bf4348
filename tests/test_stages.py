"""Feature steps inside Spark's own Pipeline and CrossValidator."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import functions as F

from tidemark.operators import features as FE
from tidemark.operators import stages as ST
from tidemark.operators import windows as W

WHERE = {"seriesCols": ["s"], "orderCols": ["t"]}


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(s, t, 2000 + t, None if (t + k) % 7 == 3 else float((t * 37 + k) % 11), float(t % 5), 3.0 * (t % 5) + k)
            for k, s in enumerate(["a", "b", None]) for t in range(40)]
    return spark.createDataFrame(rows, "s string, t int, year int, x double, z double, y double").cache()


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


STAGES = [
    ST.CarryValues(inputCols=["x"], **WHERE), ST.CarryValues(inputCols=["x"], skewSafe=True, **WHERE), ST.Interpolate(inputCols=["x"], **WHERE),
    ST.LagRoll(excludeCols=["year", "y"], lags=[1, 2], windows=[3], stats=["mean", "std"], **WHERE), ST.DropIncomplete(inputCols=["x"]),
    ST.FillMissing(excludeCols=["t"], strategy="mean"), ST.FillMissing(inputCols=["x"], requiredCol="z"), ST.BreakDummies(),
    *[ST.ColumnScaler(inputCols=["z", "y"], kind=k) for k in ("robust", "standard", "minmax", "none")],
]


@pytest.mark.parametrize("stage", STAGES, ids=lambda s: f"{type(s).__name__}-{STAGES.index(s)}")
def test_every_stage_saves_and_loads(spark, frame, tmp_path, stage):
    stage.write().save(str(tmp_path / "stage"))
    again = type(stage).load(str(tmp_path / "stage"))
    assert {p.name: v for p, v in again.extractParamMap().items()} == {p.name: v for p, v in stage.extractParamMap().items()}
    if hasattr(stage, "fit"):
        model = stage.fit(frame.where("t < 30"))
        model.write().save(str(tmp_path / "model"))
        stage, again = model, type(model).load(str(tmp_path / "model"))
    want = rows(stage.transform(frame))
    assert rows(again.transform(frame)) == want and len(want) <= frame.count()


def test_stages_do_what_the_functions_do(frame):
    assert rows(STAGES[0].transform(frame)) == rows(W.fill_forward_backward(frame, ["x"], series=["s"], order=["t"]))
    assert rows(STAGES[2].transform(frame)) == rows(FE.interpolate_linear(frame, ["x"], "s", "t"))
    assert rows(STAGES[3].transform(frame)) == rows(W.add_lag_roll(frame, ["x", "z"], [1, 2], [3], "s", "t", ("mean", "std")))
    part = frame.where("t < 30")
    assert rows(STAGES[8].fit(part).transform(frame)) == rows(FE.fit_scaler(part, ["z", "y"], "robust").transform(frame))


def test_pipeline_and_cross_validator(spark, frame, tmp_path):
    top = ST.TopFeatures(excludeCols=["t", "year", "s"], labelCol="y", k=1)
    scaler = ST.ColumnScaler(excludeCols=["t", "year", "y"])
    lr = LinearRegression(labelCol="y")
    pipe = Pipeline(stages=[ST.LagRoll(inputCols=["x", "z"], lags=[1], **WHERE), ST.FillMissing(excludeCols=["t", "year", "y"]), scaler, top, lr])
    model = pipe.fit(frame)
    assert model.stages[3].selected() == ["z"]
    model.write().save(str(tmp_path / "m"))
    assert rows(PipelineModel.load(str(tmp_path / "m")).transform(frame).drop("features")) == rows(model.transform(frame).drop("features"))
    made = Pipeline(stages=pipe.getStages()[:2]).fit(frame).transform(frame).withColumn("fold", F.col("t") % 2)
    grid = ParamGridBuilder().addGrid(top.k, [1, 3]).addGrid(scaler.kind, ["robust", "minmax"]).build()
    cv = CrossValidator(estimator=Pipeline(stages=[scaler, top, lr]), estimatorParamMaps=grid, numFolds=2, foldCol="fold",
                        evaluator=RegressionEvaluator(labelCol="y"))
    best = cv.fit(made)
    assert len(best.avgMetrics) == 4 and min(best.avgMetrics) < 1.0
    best.write().save(str(tmp_path / "cv"))
    again = CrossValidatorModel.load(str(tmp_path / "cv"))
    assert rows(again.transform(made).select("s", "t", "prediction")) == rows(best.transform(made).select("s", "t", "prediction"))


def test_unknown_column_and_empty_frame(spark, frame):
    model = ST.FillMissing(inputCols=["x", "z"]).fit(frame)
    assert model.transform(frame.drop("x")).columns == frame.drop("x").columns
    assert model.transform(frame.limit(0)).count() == 0
    assert ST.FillMissing(inputCols=["x"]).fit(frame.limit(0)).state() == {"values": {"x": None}}

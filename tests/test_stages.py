"""The preprocessor and the learners as pipeline stages; wide category columns."""
import os
import random
import tempfile

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tempora.operators import preprocess as pp
from tempora.operators import stages as st

SCHEMA = "i int, a double, b double, c string, t string, y0 double, y1 double"


@pytest.fixture(scope="module")
def table(spark):
    g = random.Random(4)
    rows = [(i, None if i % 9 == 0 else g.random() * 10, float(i % 7), g.choice(["x", "y", None, "z"]), g.choice(["warm sun", "rain", None]),
             g.random(), None if i % 11 == 0 else g.random() + i % 7) for i in range(160)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("learner,settings", [("bayes_ridge", "{}"), ("huber", '{"alpha": 0.1, "max_iter": 5}'),
                                              ("boosted_trees", '{"learning_rate": 0.2, "max_iter": 4, "max_depth": 3, "min_samples_leaf": 5}')])
def test_pipeline_is_saved_and_reloaded(spark, table, learner, settings):
    pipe = Pipeline(stages=[
        st.FeatureStage(numericCols=["a", "b"], categoricalCols=["c"], textCols=["t"], maxFeatures=10),
        st.LearnerStage(learner=learner, settings=settings, targetCols=["y0", "y1"], predictionCols=["p0", "p1"])])
    folder = tempfile.mkdtemp(prefix="tempora-stage-")
    pipe.save(os.path.join(folder, "pipe"))
    model = Pipeline.load(os.path.join(folder, "pipe")).fit(table)
    model.save(os.path.join(folder, "model"))
    again = PipelineModel.load(os.path.join(folder, "model"))

    def rows(m):
        return {r["i"]: (r["f"], r["p0"], r["p1"]) for r in m.transform(table).select("i", vector_to_array("features").alias("f"), "p0", "p1").collect()}
    assert rows(again) == rows(model) and len(rows(model)) == 160
    assert again.stages[0].uid == model.stages[0].uid and again.stages[1].getOrDefault("settings") == settings
    plain = pp.Preprocessor(["a", "b"], ["c"], ["t"], 10).fit(table).transform(table)
    assert {r["i"]: r["f"] for r in plain.select("i", vector_to_array("features").alias("f")).collect()} == {i: v[0] for i, v in rows(model).items()}


def test_unknown_learner(table):
    model = st.LearnerStage(learner="none", targetCols=["y0"])
    with pytest.raises(ValueError, match="unknown learner"):
        model.fit(table.withColumn("features", F.lit(1)))


def test_category_index_numbers_sorted_values(spark):
    values = spark.createDataFrame([(f"v{i % 977:04d}",) for i in range(5000)], "value string").repartition(5)
    got = {r["value"]: r["index"] for r in pp.category_index(values).collect()}
    assert got == {v: i for i, v in enumerate(sorted({f"v{i % 977:04d}" for i in range(5000)}))}
    assert pp.category_index(values.where("false")).count() == 0


def test_wide_categories_stay_a_table(spark, monkeypatch):
    """100,000 categories: fitted, transformed and saved without bringing them to the driver."""
    n = 100_000
    train = spark.range(n).select(F.concat(F.lit("k"), F.col("id")).alias("wide"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("small"),
                                  F.col("id").cast("double").alias("x")).unionByName(
        spark.createDataFrame([("k7", "a", 1.0)], "wide string, small string, x double"))
    model = pp.Preprocessor(["x"], ["wide", "small"]).fit(train)
    assert model.state["categories"] == {"small": ["a", "b"]} and model.state["wide"]["wide"][1] == n and model.state["modes"]["wide"] == "k7"
    path = os.path.join(tempfile.mkdtemp(prefix="tempora-wide-"), "prep")
    model.save(path, spark)
    test = spark.createDataFrame([("k0", "b", 1.0), ("k99999", None, 1.0), (None, "a", None), ("unseen", "q", 0.0)], "wide string, small string, x double")
    order = {f"k{i}": at for at, i in enumerate(sorted(range(n), key=lambda i: f"k{i}"))}
    for m in (model, pp.PreprocessorModel.load(path, spark)):
        out = {r["wide"]: r["features"] for r in m.transform(test).select("wide", "features").collect()}
        assert all(v.size == 1 + 2 + n for v in out.values())
        hot = {w: {int(i) for i, x in zip(v.indices, v.values) if x == 1.0 and i >= 1} for w, v in out.items()}
        names = m.output_columns()
        first = {c: 1 + sum({"cat__wide": n}.get(o, 1) for o in names[1:names.index(c)]) for c in names[1:]}
        small = [first["cat__small__0"], first["cat__small__1"]]
        assert hot["k0"] == {first["cat__wide"] + order["k0"], small[1]}
        assert hot["k99999"] == {first["cat__wide"] + order["k99999"], small[0]}
        assert hot[None] == {first["cat__wide"] + order["k7"], small[0]} and hot["unseen"] == set()

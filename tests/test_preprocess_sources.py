import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import preprocess as pp
from tempora.operators import learners as ln
from tempora.operators import profile as pf
from tempora.sources import files


def test_median_exact_and_scale(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    med = pp.fit_medians(df, ["x"])
    assert med["x"] == 2.5                     # exact, interpolated (Imputer would say 2.0)
    mu, sd = pp.fit_scaling(df, ["x"], med)
    imp = np.array([1, 2, 3, 10, 2.5])
    assert mu["x"] == pytest.approx(imp.mean()) and sd["x"] == pytest.approx(imp.std())


def test_onehot_unseen_and_null(spark):
    tr = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "c string")
    te = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    m = pp.Preprocessor([], ["c"]).fit(tr)
    assert m.state["modes"]["c"] == "b" and m.state["categories"]["c"] == ["a", "b"]
    out = m.transform(te, keep=["c"], assemble=False).collect()
    vec = {r["c"]: (r["cat__c__0"], r["cat__c__1"]) for r in out}
    assert vec["a"] == (1.0, 0.0) and vec["z"] == (0.0, 0.0) and vec[None] == (0.0, 1.0)


def test_tfidf_matches_formula(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the dog sat down"), (3, None)], "id long, text string")
    t = {(r["id"], r["term"]): r["tfidf"] for r in pp.tfidf_table(docs, "id", "text").collect()}
    n = 3
    idf = lambda df: np.log((1 + n) / (1 + df)) + 1
    w = {"the": idf(2), "cat": idf(1), "sat": idf(2), "the cat": idf(1), "cat sat": idf(1)}
    norm = np.sqrt(sum(v * v for v in w.values()))
    assert t[(1, "cat")] == pytest.approx(w["cat"] / norm)
    assert t[(3, "missing")] == pytest.approx(1.0)


def test_bayesian_ridge_matches_numpy(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 4)); w = np.array([1.0, -2.0, 0.5, 0.0])
    Y = np.stack([X @ w + 3 + rng.normal(scale=0.1, size=200), X @ (2 * w) - 1], axis=1)
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("features", VectorUDT()), T.StructField("y1", T.DoubleType()),
                           T.StructField("y2", T.DoubleType())])
    df = spark.createDataFrame([(Vectors.dense(x), float(y[0]), float(y[1])) for x, y in zip(X, Y)],
                               schema).coalesce(1)
    m = ln.fit_bayesian_ridge(df, ["y1", "y2"])
    assert np.allclose(m.coef[:, 0], w, atol=0.05) and m.intercept[0] == pytest.approx(3, abs=0.05)
    assert np.allclose(m.coef[:, 1], 2 * w, atol=1e-3)
    p = df.select(*m.predict_cols(["p1", "p2"])).collect()
    assert p[0]["p2"] == pytest.approx(float(X[0] @ m.coef[:, 1] + m.intercept[1]), rel=1e-6)


def test_profile_and_roles(spark):
    df = spark.createDataFrame([(1, "x", 1.5), (2, None, 2.5), (3, "x", None), (4, "y", 1.5)],
                               "o int, s string, v double")
    p = {r["column_name"]: r for r in pf.profile(df, order="o").collect()}
    assert p["s"]["missing"] == 1 and p["s"]["n_unique"] == 2 and p["s"]["sample_values"] == "x|y"
    assert p["v"]["min"] == 1.5 and p["v"]["max"] == 2.5 and p["v"]["sample_values"] == "1.5|2.5"
    roles = pf.column_roles(spark.createDataFrame([(1, "a", 2.0)], "month int, icon string, temp double"))
    assert roles == {"numeric": ["temp"], "categorical": ["icon", "month"], "text": []}


def test_days_json_lists(spark):
    d = tempfile.mkdtemp(prefix="tempora-json-")
    doc = {"resolvedAddress": "Somewhere", "latitude": 1.0, "longitude": 2.0,
           "days": [{"datetime": "2024-01-02", "temp": 30.0, "preciptype": ["rain", "snow"], "stations": ["a", "b"]},
                    {"datetime": "2024-01-01", "temp": 29.0, "preciptype": None},
                    {"datetime": "2024-01-03", "temp": 28.0, "preciptype": []}]}
    with open(os.path.join(d, "a.json"), "w") as f:
        json.dump(doc, f)
    with open(os.path.join(d, "b.json"), "w") as f:
        json.dump({"resolvedAddress": "Nowhere"}, f)
    df = files.read_days_json(spark, d)
    got = {str(r["ts"]): r for r in df.collect()}
    assert got["2024-01-02"]["preciptype"] == "rain" and got["2024-01-02"]["stations"] == "a,b"
    assert got["2024-01-01"]["preciptype"] == "none" and got["2024-01-03"]["preciptype"] == "none"
    assert got["2024-01-01"]["series_id"] == "Somewhere"
    assert files.missing_days(spark, d).count() == 1
    filled = files.fill_serving_columns(df.drop("windspeedmax", "windspeedmean", "windspeedmin", "sealevelpressure"))
    assert filled.first()["sealevelpressure"] == 1013.25


def test_daily_and_hourly_csv(spark):
    d = tempfile.mkdtemp(prefix="tempora-csv-")
    with open(os.path.join(d, "daily.csv"), "w") as f:
        f.write("name,datetime,temp,humidity,precip,windspeed,cloudcover,preciptype,severerisk,sunrise,sunset\n")
        f.write("City,2024-01-02,30.5,70,0.0,10,50,,,2024-01-02T06:00:00,2024-01-02T18:30:00\n")
        f.write("City,2024-01-01,29.5,75,1.5,12,60,rain,10,2024-01-01T06:01:00,2024-01-01T18:29:00\n")
    df = files.read_daily_csv(spark, os.path.join(d, "daily.csv"))
    rows = {str(r["ts"]): r for r in df.collect()}
    assert rows["2024-01-02"]["series_id"] == "City" and rows["2024-01-02"]["temp"] == 30.5
    assert rows["2024-01-02"]["preciptype"] is None and rows["2024-01-01"]["severerisk"] == 10.0
    from tempora.operators import features as fe
    f = {str(r["ts"]): r for r in fe.daily_features(df, valid_only=False).collect()}
    assert f["2024-01-02"]["preciptype"] == "none" and f["2024-01-02"]["severerisk"] == 0.0
    assert f["2024-01-02"]["day_length_minutes"] == 750.0 and f["2024-01-01"]["sunrise_minutes"] == 361
    assert "sunrise" not in f["2024-01-01"].asDict() and "name" not in f["2024-01-01"].asDict()
    with open(os.path.join(d, "hourly.csv"), "w") as f2:
        f2.write("datetime,temp,humidity\n2024-01-01T01:00:00,25.0,80\n2024-01-01T00:00:00,24.0,81\n")
    h = files.read_hourly_csv(spark, os.path.join(d, "hourly.csv")).orderBy("ts").collect()
    assert str(h[0]["ts"]) == "2024-01-01 00:00:00" and h[1]["temp"] == 25.0


def test_first_available_and_stringify(spark):
    def broken():
        return spark.read.parquet("/nowhere/at/all")

    def wrong():
        return spark.range(1).select("no_such_column")
    empty = lambda: spark.createDataFrame([], "x int")           # noqa: E731
    good = lambda: spark.createDataFrame([(1,)], "x int")        # noqa: E731
    assert files.first_available(broken, empty, good).count() == 1
    assert files.first_available(broken, empty) is None
    with pytest.raises(Exception, match="no_such_column"):
        files.first_available(wrong, good)          # only a missing source falls through
    raw = spark.createDataFrame([("1.5", "x"), ("oops", "y"), (None, "z")], "temp string, icon string")
    assert [tuple(r) for r in files.unparsed(raw, files.daily_schema()).collect()] == [("temp", 1)]
    df = spark.createDataFrame([(1, [1, 2], "a")], "n int, arr array<int>, s string")
    out = files.stringify_objects(df)
    assert dict(out.dtypes) == {"n": "int", "arr": "string", "s": "string"}


def test_csv_rejects_are_listed(spark):
    import os
    import tempfile
    from tempora.sources import files
    path = os.path.join(tempfile.mkdtemp(prefix="tempora-csv-"), "d.csv")
    with open(path, "w") as f:
        f.write("datetime,temp,humidity,name\n2024-01-01,20.5,80,X\n2024-01-02,,x,X\nyesterday,1,2,X\n2024-01-04,hot,2,X\n2024-01-05,1\n"
                "2024-01-06,1,2,X,extra\n\"2024-01-07\",\"3\",4,\"a, b\"\n")
    good, bad = files.read_csv_checked(spark, path, files.daily_schema(), files.daily_ts)
    rows = {str(r["ts"]): (r["temp"], r["humidity"], r["series_id"]) for r in good.collect()}
    assert rows == {"2024-01-01": (20.5, 80.0, "X"), "2024-01-02": (None, None, "X"), "2024-01-07": (3.0, 4.0, "a, b")}
    assert sorted((r["reason"], r["record"]) for r in bad.collect()) == [
        ("datetime", "yesterday,1,2,X"), ("fields", "2024-01-05,1"), ("fields", "2024-01-06,1,2,X,extra"), ("number", "2024-01-04,hot,2,X")]
    assert all(r["file"].endswith("d.csv") for r in bad.collect())


def test_days_lines_are_read_by_several_tasks(spark):
    import json
    import os
    import tempfile
    from tempora.sources import files
    folder = tempfile.mkdtemp(prefix="tempora-lines-")
    docs = [{"resolvedAddress": f"S{i}", "latitude": 1.5, "days": [
        {"datetime": f"2024-01-{j + 1:02d}", "temp": i + j / 10, "preciptype": ["rain", "snow"] if j % 2 else None, "stations": ["a", "b"]} for j in range(5)]}
        for i in range(400)]
    with open(os.path.join(folder, "x.jsonl"), "w") as f:
        f.write("\n".join(json.dumps(d) for d in docs) + "\n\n")
        f.write(json.dumps({"datetime": "2024-02-01", "temp": 7.0, "resolvedAddress": "one day"}) + "\n{broken\n{\"other\": 1}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        rows, bad = files.read_days_lines(spark, folder)
        assert rows.rdd.getNumPartitions() > 1
        got = {(r["series_id"], str(r["ts"])): (r["temp"], r["preciptype"], r["stations"]) for r in rows.collect()}
        assert sorted(r["record"] for r in bad.collect()) == ['{"other": 1}', "{broken"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for n, d in enumerate(docs):
        with open(os.path.join(folder, f"{n}.json"), "w") as f:
            json.dump(d, f)
    want = {(r["series_id"], str(r["ts"])): (r["temp"], r["preciptype"], r["stations"])
            for r in files.read_days_json(spark, os.path.join(folder, "*.json")).collect()}
    assert {k: v for k, v in got.items() if k[0] != "one day"} == want and got["one day", "2024-02-01"][0] == 7.0 and len(want) == 2000

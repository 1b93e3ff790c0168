import random

from pyspark.sql import functions as F

from tempora.llm import secrets as S
from tests.llm.conftest import words


def corpus(rng, n=260):
    docs = []
    for i in range(n):
        w = words(rng, rng.randrange(10, 80), 200).split()
        hexa = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), f'token = "{hexa}"')
        if i % 4 == 1:
            w.insert(rng.randrange(len(w)), "commit " + "considerationsofnothing" + rng.choice(["", "andmore"]))
        if i % 4 == 2:
            w.insert(rng.randrange(len(w)), "card " + "".join(rng.choice("0123456789") for _ in range(16)))
        docs.append((i, " ".join(w), "src%d" % (i % 3)))
    return docs


def test_forest_on_held_out_findings(spark, rng):
    d = spark.createDataFrame(corpus(rng), "doc_id long, text string, source string")
    stats = S.statistics(d)
    labelled = S.weak_labels(S.findings(d, stats))
    forest = S.train(labelled.where("doc_id % 5 <> 0"))
    held = S.weak_labels(S.scan(d.where("doc_id % 5 = 0"), stats, forest)).collect()
    assert len(held) >= 30
    assert sum(r.is_secret == bool(r.label) for r in held) / len(held) > 0.95
    for r in held:
        assert 0 <= r.probability <= 1


def test_own_trees_equal_the_library_s(spark, rng):
    from pyspark.ml.classification import RandomForestClassificationModel
    from pyspark.ml.functions import array_to_vector, vector_to_array
    import glob
    d = spark.createDataFrame(corpus(rng), "doc_id long, text string, source string")
    rows = S.weak_labels(S.findings(d, S.statistics(d)))
    from tempora.session import checkpoint_dir
    folder = checkpoint_dir(spark).replace("file:", "")
    saved = set(glob.glob(folder + "/forest-*"))
    forest = S.train(rows)
    new = set(glob.glob(folder + "/forest-*")) - saved
    assert len(new) == 1
    model = RandomForestClassificationModel.load("file:" + max(new, key=lambda p: __import__("os").path.getmtime(p)))
    got = (model.transform(rows.select("features", array_to_vector("features").alias("f")).withColumnRenamed("features", "x")
                           .withColumnRenamed("f", "features")).select("x", vector_to_array("probability").alias("p")).collect())
    import numpy as np
    assert np.allclose(forest.probability(np.array([r.x for r in got])), [r.p[1] for r in got], atol=1e-9)


def test_redact_and_defined_cases(spark, rng):
    docs = corpus(rng)
    d = spark.createDataFrame([(i, t, s, len(t), None) for i, t, s in docs], "doc_id long, text string, source string, n_chars long, candidates string")
    stats = S.statistics(d)
    forest = S.train(S.weak_labels(S.findings(d, stats)))
    odd = [(900, None, None, None, "k"), (901, "", "p", 0, "k"), (None, 'ü token = "' + "ab12" * 10 + '" end', None, 7, "k"), (3, "x " * 20000, "p", 1, "k")]
    both = d.unionByName(spark.createDataFrame(odd, d.schema))
    out = S.redact(both, stats, forest)
    assert out.columns == both.columns
    rows = {(r.doc_id, r.candidates): r for r in out.collect()}
    assert len(rows) == len(docs) + 4
    assert rows[900, "k"].text is None and rows[901, "k"].text == ""
    r = rows[None, "k"]
    assert r.text == f'ü token = "{S.MASK}" end' and r.n_chars == len(r.text)
    for i, t, _ in docs:
        if i % 4 != 0:
            assert rows[i, None].text == t and rows[i, None].n_chars == len(t)
        else:
            assert S.MASK in rows[i, None].text


def test_without_two_classes_or_rows(spark):
    d = spark.createDataFrame([(1, "k " + "A1" * 12, "p")], "doc_id long, text string, source string")
    stats = S.statistics(d.limit(0))
    none = S.train(S.weak_labels(S.findings(d.limit(0), stats)))
    assert [r.probability for r in S.scan(d, stats, none).collect()] == [0.0]
    ones = S.train(S.findings(d, stats).withColumn("label", F.lit(1)))
    assert [r.is_secret for r in S.scan(d, stats, ones).collect()] == [True]
    assert S.scan(d.limit(0), stats, none).count() == 0


def test_dictionary_does_not_fill_up(spark, rng):
    # 200,000 rare words, 20 times each, beside one common word
    rare = F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 8), "0123456789abcdef", "ghijklmnopqrstuv")
    d = spark.range(0, 200_000, 1, 4).select(F.concat(F.repeat(F.concat(rare, F.lit(" ")), 20), F.lit("considered")).alias("text"))
    stats = S.statistics(d)
    assert len(stats.frequent) <= 1 / S.SHARE
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(50)]
    assert max(S._coverage(k.encode(), stats) for k in keys) == 0.0
    assert S._coverage(b"unconsidered", stats) == 10 / 12


def test_candidates_of_every_length():
    def found(t):
        return [t[a:b] for a, b in S.spans(t)]
    assert found('password = "x9Tr4bQ2k"') == ["x9Tr4bQ2k"] and found("PWD: a.b!c@d#1$2%") == ["a.b!c@d#1$2%"]
    assert found("my_api_key='s3cr.et!'") == ["s3cr.et!"] and found("passwd=hunter2,next") == ["hunter2"]
    assert found('title: "something"') == ["something"] and found("ratio: 12345678") == [] and found("key = abc") == []
    assert found("token = " + "ab12" * 10) == ["ab12" * 10] and found("x" * 15) == [] and found("x" * 16) == ["x" * 16]
    assert found('secret: "' + "a" * 20 + "!.?" + '"') == ["a" * 20 + "!.?"]       # one candidate, the longer
    assert found("") == [] and found("=" * 500 + ":" * 500 + " " * 500) == []
    assert len(S.spans("password=" * 4000)) < 4000 and S.spans("token" * 20_000 + "=") is not None


def test_short_passwords_are_found(spark, rng):
    """Planted findings of 8 to 15 characters, punctuation included, beside other values; reviewed labels train the forest."""
    rows, planted = [], {}
    for i in range(400):
        w = words(rng, 30, 200).split()
        if i % 2 == 0:
            value = "".join(rng.choice("abcdefghjkmnpqrstuvwxyzABCDEFGHJKMNPQRSTUVWXYZ23456789.!@#$%") for _ in range(rng.randrange(8, 16)))
            w.insert(rng.randrange(len(w)), rng.choice(['password = "%s"', "pwd: %s", "api_token='%s'"]) % value)
            planted[i] = value
        else:
            w.insert(rng.randrange(len(w)), rng.choice(['title: "%s"', 'name = "%s"', "key: %s"]) % "".join(words(rng, 2, 200).split()).replace("w", "word"))
        rows.append((i, " ".join(w), "src"))
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    stats = S.statistics(d)
    truth = spark.createDataFrame(list(planted.items()), "doc_id long, candidate string").withColumn("label", F.lit(1))
    reviewed = S.findings(d, stats).join(truth, ["doc_id", "candidate"], "left").fillna(0, ["label"])
    assert reviewed.where("label = 1").count() == len(planted)
    forest = S.train(reviewed.where("doc_id % 5 <> 0"))
    held = [r for r in S.scan(d, stats, forest).where("doc_id % 5 = 0").collect()]
    right = sum(r.is_secret == (planted.get(r.doc_id) == r.candidate) for r in held)
    assert len(held) >= 70 and right / len(held) > 0.9
    clean = {r.doc_id: r.text for r in S.redact(d, stats, forest, length_col=None).collect()}
    gone = sum(v not in clean[i] for i, v in planted.items())
    assert gone / len(planted) > 0.9

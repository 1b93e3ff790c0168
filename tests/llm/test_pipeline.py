import corpus_pipeline as C
from tempora.llm import decontaminate, near_dup, toxicity
from tests.llm.test_decontaminate import brute as hit_words
from tests.llm.test_near_dup import brute as components

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_dup", "decontaminate", "secrets", "mixing"]
    for k, (name, stage) in enumerate(C.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name != "mixing":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = [r for r in docs.collect()]
        ids = [r.doc_id for r in after]
        if name == "toxicity":
            model = toxicity.fit(spark.createDataFrame(list(before.values())), spark.read.parquet(f"{SF}/labels.parquet"))
            scores = toxicity.score(spark.createDataFrame(list(before.values())), model)
            assert sorted(ids) == sorted(r.doc_id for r in scores.where("predicted = 0").collect())
        elif name == "near_dup":
            assert sorted(ids) == sorted(d for d, _, c in components([(i, r.text) for i, r in sorted(before.items())]) if c == d)
        elif name == "decontaminate":
            hits = hit_words([(i, r.text) for i, r in before.items()], bench)
            assert sorted(ids) == sorted(i for i, _, h, _ in hits if not h)
        elif name == "secrets":
            assert sorted(ids) == sorted(before)
            for r in after:
                old = before[r.doc_id]
                assert r.text == old.text or "[SECRET]" in r.text
                assert r.n_chars == (old.n_chars if r.text == old.text else len(r.text))
        else:
            assert set(ids) == set(before)
            assert docs.columns == columns + ["n_tokens", "epoch", "block", "position"]


def test_registered(spark):
    import __spark_entry__ as E
    names = E.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op")} and "pipeline" in names
    assert decontaminate and near_dup

"""The pipeline's stages on planted cases and on odd rows."""


import corpus_pipeline
from tests.llm.test_operators import SCHEMA, make, words


def folder(spark, tmp_path, docs, labels, benchmark):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_decide_and_pass_on(spark, tmp_path):
    rows, labels = [], []
    for i in range(200):
        text = words(1000 + i, 80)
        toxic = i % 5 == 0
        rows.append((i, text + (" nincompoop nincompoop" if toxic else ""), "ab"[i % 2]))
        labels.append((i, 1, int(toxic)))
    item = words(5, 40)
    rows += [(300, rows[1][1], "a"), (301, words(6, 30) + " " + item, "b"), (302, None, None), (303, "", "a"), (None, words(7, 50), "a"), (301, words(6, 30) + " " + item, "b")]
    at = folder(spark, tmp_path, make(spark, rows), labels, [(0, item)])
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        if name != "token_output":
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [r.doc_id for r in docs.collect()]
    assert not {i for i in range(0, 200, 5)} & set(seen["toxicity"]) and len(seen["toxicity"]) == len(rows) - 40
    assert 300 not in seen["simhash_near_dedup"] and seen["simhash_near_dedup"].count(301) == 1 and None in seen["simhash_near_dedup"]
    assert set(seen["toxicity"]) - set(seen["simhash_near_dedup"]) <= {300, 303}
    assert 301 not in seen["benchmark_decontamination"]
    assert set(seen["source_mixing"]) <= set(seen["benchmark_decontamination"])
    assert sorted(map(str, seen["token_output"])) == sorted(map(str, seen["source_mixing"]))
    assert corpus_pipeline.run(spark, at).count() == len(seen["token_output"])


def test_pipeline_of_nothing(spark, tmp_path):
    at = folder(spark, tmp_path, spark.createDataFrame([], SCHEMA), [], [])
    assert corpus_pipeline.run(spark, at).count() == 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]

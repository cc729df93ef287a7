"""The order that mixing decides reaches the rows of the whole pipeline, over several files of unequal size."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_encoded_rows_keep_the_order_of_unequal_files(spark, tmp_path):
    rows = [(i, "w " * (4000 if i > 60 else 1), "en", f"src{i % 3}", 1) for i in range(80)]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/all")
    wide = spark.read.parquet(f"{tmp_path}/all").withColumn("text", F.concat("text", F.when(F.col("doc_id") > 60, F.sha2(F.col("doc_id").cast("string"), 512)).otherwise("")))
    wide.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/mixed")
    docs = spark.read.parquet(f"{tmp_path}/mixed")
    assert len(docs.inputFiles()) > 1
    got = corpus_pipeline.encode(spark, docs, str(tmp_path)).collect()
    assert [(r.position, r.doc_id) for r in got] == [(i, i) for i in range(80)]


def test_run_gives_the_schedule(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"d{i}x{j}" for j in range(1 + i * 7 % 90)), "en", f"src{i % 4}", 1) for i in range(120)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    plain = corpus_pipeline.freeze

    def several(df, name):
        if name != "mixing":
            return plain(df, name)
        seen["order"] = [r.doc_id for r in df.collect()]
        of = {d: i for i, d in enumerate(seen["order"])}
        place = F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[F.col("doc_id")]
        part = F.when(place < 7, 0).when(place < 20, 1).otherwise(2)  # the last file is the largest
        return plain(df.repartitionById(3, part).sortWithinPartitions(place), name)

    monkeypatch.setattr(corpus_pipeline, "freeze", several)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(seen["order"]) == 120 and [r.doc_id for r in got] == seen["order"]
    assert [r.position for r in got] == list(range(120))

"""The union of examples keeps every document with its whole text."""

from marginalia.plans import catalog


def test_every_document_is_whole(spark, tmp_path):
    docs = [(1, "odd\nsecond line"), (2, "even\nsecond line"), (3, None), (4, "")]
    spark.createDataFrame([(7, "item\nmore")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r[c] for c in ("part", "ord", "text", "label")) for r in catalog.QUERIES["exemplar_union"](spark, str(tmp_path)).collect()}
    assert got == {(0, 7, "item\nmore", "")} | {(1, i, t, "document") for i, t in docs}

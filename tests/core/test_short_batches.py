"""What goes to Python at a time is bounded, whatever a partition holds."""

from marginalia.plans import registry


def test_batches_are_bounded(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 10_000)] * 3000, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    names = [f"spark.sql.execution.arrow.{n}" for n in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.unset(n)
        df = registry.read(spark, str(tmp_path), "documents").coalesce(1)
        sizes = df.mapInArrow(lambda bs: (b.select([0]).slice(0, 0).from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]}) for b in bs), "n long, bytes long").collect()
        assert sum(r.n for r in sizes) == 3000
        assert max(r.n for r in sizes) <= registry.BATCH_ROWS and max(r.bytes for r in sizes) < 1.5 * registry.BATCH_BYTES
        spark.conf.set(names[0], "20")
        registry.read(spark, str(tmp_path), "documents")
        assert spark.conf.get(names[0]) == "20"
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)

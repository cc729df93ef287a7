"""A sweep reads every comment of a file, not the first 64."""

from marginalia.operators import audit
from marginalia.plans import catalog


def test_findings_past_the_first_comments(spark, tmp_path):
    (tmp_path / "a.py").write_text("# value = 2\nx = 1\n" * 150)
    assert [r.line for r in audit.sweep(spark, str(tmp_path)).collect()] == list(range(1, 300, 2))


def test_query_has_all_groups(spark, tmp_path):
    text = "\n".join(f"words of line {n}" for n in range(400))
    spark.createDataFrame([(6, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["sweep_findings"](spark, str(tmp_path))
    assert sorted(r.line for r in found.collect()) == [8 * g + 5 for g in range(100)]

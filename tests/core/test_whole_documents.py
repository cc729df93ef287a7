"""Declarations and texts are whole: neither the first line nor what follows it is cut."""

from marginalia.plans import catalog
from marginalia.plans.comments import _PADDING, docs_as_declarations


def test_declaration_and_text_are_whole(spark, tmp_path):
    texts = {i: "Word " + f"w{i} " * 100 + "end.\nSecond line.\nThird line." for i in range(1, 4)} | {4: None, 5: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in docs_as_declarations(spark, str(tmp_path)).collect():
        text = texts[r.doc_id]
        pad = _PADDING.replace("{}", ((text or "").split() or [""])[0]) if r.doc_id % 3 else ""
        assert (r.declaration, r.text) == ((None, None) if text is None else (text.split("\n")[0], text + pad))


def test_what_follows_the_first_line_is_judged(spark, tmp_path):
    long = "Word " + "filler " * 60 + "of the value.\n"
    texts = [(1, long + "It is simple and easy and robust."), (2, long + "x = compute();"), (4, long + "Nothing here.")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    hollow = catalog.QUERIES["hollow_documents"](spark, str(tmp_path)).collect()
    assert (1, "It is simple and easy and robust.") in {(r.doc_id, r.sentence) for r in hollow}
    verdicts = {r.doc_id: r["class"] for r in catalog.QUERIES["inspect_first_match"](spark, str(tmp_path)).collect()}
    assert verdicts[2] == "leftover" and verdicts[4] != "leftover"

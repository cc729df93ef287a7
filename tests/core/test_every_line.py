"""The sweep's findings against brute force over every line of small documents."""

from marginalia.operators import rules
from marginalia.plans import catalog

TEXTS = {1: "\n".join(f"x{i} = {i};" if i % 2 else f"line {i} of prose." for i in range(9)), 2: "a word.\nkept for old callers.\ny = 1;\nplain", 3: "one"}


def found():
    for d, text in TEXTS.items():
        for pos, line in enumerate(text.split("\n")):
            name = "leftover" if "=" in line else "phrase" if "kept for" in line else "echo"
            yield d, pos, name, 1 / (1 + line.endswith("."))


def test_every_line_is_judged(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = list(found())
    tsv = [r.line for r in catalog.QUERIES["sweep_tsv"](spark, str(tmp_path)).collect()]
    assert sorted(tsv) == sorted(f"doc{d}:{pos + 1}\t{c}\t{s:.3f}\t{rules.REASONS[c]}" for d, pos, c, s in want)
    log = catalog.QUERIES["log_json"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.pos) for r in log) == [(d, pos) for d, pos, _, _ in want]
    for r in catalog.QUERIES["report_text"](spark, str(tmp_path)).collect():
        top = sorted((-s, pos, c) for d, pos, c, s in want if d == r.doc_id)[:3]
        assert "".join(f"  line {pos + 1}  {rules.REASONS[c]}\n" for _, pos, c in top) in r.report

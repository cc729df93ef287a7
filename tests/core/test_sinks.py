"""Sinks, quoted lines, and heads on disk."""

import json

import pytest
from pyspark.sql import functions as F

from marginalia.functions import render
from marginalia.operators import head as H
from marginalia.sources import sinks


def test_log_appends(spark, tmp_path):
    df = spark.createDataFrame([("a.py", 3, "echo", 0.95)], "path string, line int, class string, score double")
    sinks.log(df, f"{tmp_path}/log")
    sinks.log(df, f"{tmp_path}/log")
    sinks.log(df.limit(0), f"{tmp_path}/none")
    rows = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/log").collect()]
    assert len(rows) == 2 and rows[0]["file"] == "a.py" and rows[0]["at"].endswith("Z") and not (tmp_path / "none").exists()
    sinks.report_lines(df.withColumn("reason", F.lit("why")), f"{tmp_path}/tsv")
    assert [r.value for r in spark.read.text(f"{tmp_path}/tsv").collect()] == ["a.py:3\techo\t0.950\twhy"]


def test_quoted(spark):
    df = spark.createDataFrame([("x\n# one\n# two\n\n  y = 1\n", 2), ("// last", 1)], "s string, n int")
    assert [tuple(r.q) for r in df.select(sinks.quoted(F.col("s"), F.col("n")).alias("q")).collect()] == [("# one", "y = 1"), ("// last", None)]


def test_anchor(tmp_path):
    assert sinks.anchor("") is None and sinks.anchor(str(tmp_path)) is None
    (tmp_path / "AGENTS.md").write_text("")
    assert sinks.anchor(str(tmp_path)) == "AGENTS.md"


def vectors(spark):
    rows = [(i, [1.0 + i % 3 * 0.1, 0.0, float(i % 2)], 1) for i in range(20)] + [(50 + i, [0.0, 1.0 + i % 4 * 0.1, float(i % 2)], 0) for i in range(20)]
    return spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int")


def test_head_is_kept_and_refused(spark, tmp_path):
    head = H.fit(vectors(spark))
    mark = H.fingerprint([("text", "label"), ("other", "")])
    assert mark != H.fingerprint([("other", ""), ("text", "label")])
    H.save(head, f"{tmp_path}/head", mark)
    back = H.load(spark, f"{tmp_path}/head", mark, 3, 1)
    assert back.first().threshold == head.first().threshold and list(back.first().direction) == list(head.first().direction)
    for args in ((mark + 1, 3, 1), (mark, 4, 1), (mark, 3, 2)):
        with pytest.raises(ValueError, match="doesn't fit"):
            H.load(spark, f"{tmp_path}/head", *args)


def literal_cut(scores, precision, window):
    """The lowest score that passes, by a plain loop; rows of one score count together."""
    best = None
    for s, _ in scores:
        above = [r for t, r in scores if t >= s]
        near = [r for t, r in scores if s - window <= t <= s + window]
        if any(above) and sum(above) / len(above) >= precision and sum(near) / len(near) >= precision:
            best = s if best is None else min(best, s)
    return best


def test_cut_is_the_plain_loop(spark):
    import random

    rng = random.Random(5)
    for _ in range(3):
        rows = [(1, int(rng.random() < s), round(s, 2)) for s in (rng.random() for _ in range(60))]
        df = spark.createDataFrame(rows, "class int, label int, score double")
        got = H.cut(df, 0.7, 0.1).first().threshold
        assert got == literal_cut([(s, r) for _, r, s in rows], 0.7, 0.1)


def test_scores_are_rounded_by_their_exact_value(spark):
    # 0.0125 and 1.0005 lie above and below the half that they look like; 1/16 and 3/16 are halves.
    scores = [1 / (1 + n) for n in range(400)] + [0.0005, 1.0005, 2.0015, 3 / 16, 0.0, 7.0, 0.95]
    rows = spark.createDataFrame([(s,) for s in scores], "s double")
    made = rows.select("s", render.tsv(F.lit("a"), F.lit(1), F.lit("c"), F.col("s"), F.lit("r")).alias("v")).collect()
    assert [r.v for r in made] == [f"a:1\tc\t{r.s:.3f}\tr" for r in made]

"""Memory in batch and stream, payloads, reports."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from marginalia.functions import render as R
from marginalia.operators import memory as M
from marginalia.sources import payloads
from marginalia.streaming import memory as S

FINDINGS = "session string, path string, key string, score double, ts timestamp"


def found(spark, rows):
    return spark.createDataFrame(rows, "session string, path string, key string, score double, ts string").withColumn("ts", F.to_timestamp("ts"))


ROWS = [("a", "x", "1", 0.5, "2024-01-01 00:00:00"), ("a", "x", "2", 0.9, "2024-01-01 01:00:00"), ("a", "y", "1", 0.9, "2024-01-02 00:59:59"), ("a", "x", "1", 0.1, "2024-01-04 00:00:00"), ("b", "x", "1", 1.0, "2024-01-01 00:00:00")]


def test_unseen_is_by_path_and_repeat_by_session(spark):
    df = found(spark, ROWS)
    memory = spark.createDataFrame([("a", "x", "1"), ("a", "x", "1")], "session string, path string, key string")
    assert sorted((r.session, r.path, r.key) for r in M.unseen(df, memory).collect()) == [("a", "x", "2"), ("a", "y", "1"), ("b", "x", "1")]
    assert {r.session: r.repeat for r in M.repeat(df.select("session").distinct(), memory).collect()} == {"a": True, "b": False}
    assert M.unseen(df, memory.limit(0)).count() == 5 and M.unseen(df.limit(0), memory).count() == 0


def test_budget_and_lives(spark):
    df = found(spark, ROWS)
    assert [r.score for r in M.budget(df, ["session"], ["ts"], 2).filter("session = 'a'").orderBy("rank").collect()] == [0.9, 0.9]
    assert sorted((r.session, r.writes) for r in M.lives(df).collect()) == [("a", 1), ("a", 3), ("b", 1)]
    assert M.remembered(df, ["ts"], 1).filter("session = 'a'").count() == 2


def test_base36(spark):
    df = spark.createDataFrame([("18446744073709551615",), ("35",), ("0",)], "k string")
    assert [r.v for r in df.select(M.base36(F.col("k").cast("decimal(20,0)")).alias("v")).collect()] == ["3w5e11264sgsf", "z", "0"]


def stream(spark, tmp_path):
    """All rows twice, a file each, in the order of their times: rows of later files than a watermark lets in would be dropped."""
    for row in sorted(2 * ROWS, key=lambda r: r[-1]):
        found(spark, [row]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(FINDINGS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_stream_names_each_once(spark, tmp_path):
    for name, f in (("all", S.first_sightings), ("fading", S.fading_sightings)):
        S.write_stream(f(stream(spark, tmp_path / name)), f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/check").awaitTermination()
        got = [(r.session, r.path, r.key) for r in spark.read.schema(FINDINGS).parquet(f"{tmp_path}/{name}/out").collect()]
        assert sorted(set(got)) == [("a", "x", "1"), ("a", "x", "2"), ("a", "y", "1"), ("b", "x", "1")]
        assert name == "fading" or len(got) == 4


def test_batches_remember(spark, tmp_path):
    S.remember_batches(stream(spark, tmp_path), f"{tmp_path}/said", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = sorted((r.session, r.path, r.key) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", "x", "1"), ("a", "x", "2"), ("a", "y", "1"), ("b", "x", "1")]


def test_payloads(spark):
    edit = {"session_id": "s", "tool_name": "MultiEdit", "tool_input": {"file_path": "a.py", "old_string": "x", "new_string": "", "edits": [{"old_string": "p", "new_string": "q"}]}}
    lines = [json.dumps(edit), "{bad", json.dumps({**edit, "tool_name": "Read"}), "", None, json.dumps({"tool_name": "Write", "tool_input": {"file_path": "b"}})]
    own = payloads.payloads(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.tool_name for r in own.collect()] == ["MultiEdit", "Write"]
    assert [(r.path, r["at"], r.old, r.new) for r in payloads.edits(own).collect()] == [("a.py", 1, "p", "q")]


def test_report(spark):
    df = spark.createDataFrame([(1, "a", False), (2, "a", True)], "n int, name string, again boolean")
    findings = F.array(F.struct(F.lit(2).alias("rank"), F.lit(9).alias("line"), F.lit("second").alias("reason")), F.struct(F.lit(1).alias("rank"), F.lit(4).alias("line"), F.lit("first").alias("reason")))
    made = df.select(R.report(F.col("name"), findings, F.col("again"), F.lit("RULES.md")).alias("r"), R.summary(F.col("n"), F.col("name")).alias("s")).collect()
    assert made[0].r.index("line 4  first") < made[0].r.index("line 9  second") and "RULES.md" in made[0].r and R.AGAIN in made[1].r and "RULES.md" not in made[1].r
    assert [r.s for r in made] == ["1 comment in a to look at again", "2 comments in a to look at again"]
    hook = json.loads(df.limit(1).select(R.hook_result(F.lit("c"), F.lit("m")).alias("h")).first().h)
    assert hook == {"hookSpecificOutput": {"hookEventName": "PostToolUse", "additionalContext": "c"}, "systemMessage": "m"}


def test_display(spark):
    df = spark.createDataFrame([("/w/a/b.py", "/w"), ("/w/a/b.py", ""), ("/x/b\x07.py", "/w"), ("/wide/b", "/w")], "p string, c string")
    assert [r.v for r in df.select(R.display(F.col("p"), F.col("c")).alias("v")).collect()] == ["a/b.py", "b.py", "b.py", "b"]


def test_memory_fades_and_is_bounded(spark, tmp_path):
    """By the time of the events: what was said a day before is said again; a full session takes no more; three for each write."""
    schema = "session string, path string, key string, score double, write long, ts timestamp"
    at = lambda d, h: datetime(2024, 1, d, h)
    batches = [
        [("a", "x", str(i), float(i), 1, at(1, 0)) for i in range(5)],
        [("a", "x", "4", 4.0, 2, at(1, 5)), ("a", "x", "0", 0.0, 2, at(1, 5)), ("a", "x", "9", 0.0, 3, at(1, 5))],
        [("a", "x", "4", 4.0, 4, at(2, 4)), ("a", "x", "0", 1.0, 4, at(2, 4))],
    ]
    named = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        findings = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        S.remember_batches(findings, f"{tmp_path}/said", f"{tmp_path}/out", f"{tmp_path}/check", hours=24, most=100).awaitTermination()
        named.append(sorted((r.write, r.key) for r in spark.read.parquet(f"{tmp_path}/out/batch={i}").collect()))
    assert named == [[(1, "2"), (1, "3"), (1, "4")], [(2, "0"), (3, "9")], [(4, "4")]]

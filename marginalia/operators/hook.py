"""The hook: write events in, at most three findings for each out, and the answer that names them.

One pass over the files that were written: a join brings each event its file, spans are found by bytes, the scanner marks
the comments that they touch, and the rules see these alone. What a session was told of the same path is left out before the
three are chosen. Nothing gathers a session: the memory is an anti-join, the three are a limited window by write.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import lexicon as L
from marginalia.functions import render as R
from marginalia.operators import attribution as A
from marginalia.operators import audit
from marginalia.operators import memory as M
from marginalia.sources import scan as S
from marginalia.sources.languages import language


def review(writes: DataFrame, files: DataFrame, memory: DataFrame, head: DataFrame | None = None, vectors: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """write, session, cwd, path, rank, line, class, score, reason and key: of each write (see payloads.writes) the findings of
    the highest score, at most three, that the memory (session, path, key) doesn't hold.

    files has path and content. Writes to unknown languages, to files that are missing or too large, and edits whose text
    isn't in the file or that only delete, find nothing. A write with a null path, a null session's memory and repeated writes
    are treated as any others; each write needs an id of its own.
    """
    own = writes.withColumn("language", language(F.col("path"))).filter("language is not null")
    small = files.filter(F.octet_length("content") <= L.FILE_BYTES).select("path", F.col("content").cast("binary").alias("content"))
    touched = own.join(small, "path").withColumn("spans", A.written(F.col("content"), F.col("whole"), F.col("edits"))).filter(F.size("spans") > 0)
    found = S.scan(touched.select(F.col("write").cast("string").alias("path"), "language", "content", "spans"))
    said = audit.judge(audit.comments(found), head, vectors).withColumnRenamed("path", "__write")
    events = own.select("write", "session", "cwd", "path", F.col("write").cast("string").alias("__write"))
    fresh = M.unseen(events.join(said, "__write").drop("__write"), memory)
    return M.budget(fresh, ["write"], ["line"]).select("write", "session", "cwd", "path", "rank", "line", "class", "score", "reason", "key")


def remembered(findings: DataFrame) -> DataFrame:
    """What the memory takes of them: session, path and key."""
    return findings.select("session", "path", "key").distinct()


def answers(findings: DataFrame, memory: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """write and answer, the JSON that names its findings; writes without findings have none. rules has cwd and name, the file
    of rules of a folder."""
    name = R.display(F.col("path"), F.col("cwd"))
    own = findings.groupBy("write", "session", "cwd", name.alias("name")).agg(F.collect_list(F.struct("rank", "line", "reason")).alias("found"))  # three at most
    spoken = memory.select("session").distinct().withColumn("repeat", F.lit(True))
    own = own.join(spoken, "session", "left").withColumn("repeat", F.coalesce("repeat", F.lit(False)))
    own = own.join(rules.withColumnRenamed("name", "rules"), "cwd", "left") if rules is not None else own.withColumn("rules", F.lit(None).cast("string"))
    report = R.report(F.col("name"), F.col("found"), F.col("repeat"), F.col("rules"))
    return own.select("write", R.hook_result(report, R.summary(F.size("found"), F.col("name"))).alias("answer"))

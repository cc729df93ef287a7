"""Where findings and sentences go: logs, tables of documentation, the lines that a finding is quoted with."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import prose as P
from marginalia.functions import render

#: Files that may hold a project's rules, in the order in which they are looked for.
RULE_FILES = ["AGENTS.md", "CLAUDE.md"]


def log(findings: DataFrame, folder: str) -> None:
    """Appends findings (path, line, class, score) as JSON lines with the time in UTC; nothing is written for none."""
    at = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = findings.select(render.log_line(at, F.col("path"), F.col("line"), F.col("class"), F.col("score")).alias("value"))
    if not lines.isEmpty():
        lines.write.mode("append").text(folder)


def report_lines(findings: DataFrame, folder: str) -> None:
    """Writes findings as lines of path:line, class, score and reason."""
    findings.select(render.tsv(F.col("path"), F.col("line"), F.col("class"), F.col("score"), F.col("reason")).alias("value")).write.mode("overwrite").text(folder)


def quoted(source: Column, line: Column) -> Column:
    """The line (from 1) of a comment and the first one after it that is neither blank nor goes on with the comment."""

    def find(lines: Column) -> Column:
        first = F.get(lines, line - 1)
        mark = F.regexp_extract(P.trim(first), r"\A(///?|//!|#|--|/\*|\*)", 1)
        on = lambda x: (P.trim(x) == "") | ((mark != "") & P.trim(x).startswith(mark)) | P.trim(x).startswith("*")
        after = F.filter(F.slice(lines, line + 1, F.size(lines)), lambda x: ~on(x))
        return F.struct(P.trim(first).alias("comment"), P.trim(F.get(after, F.lit(0))).alias("code"))

    return P.let(P.lines(source), find)


def harvest(comments: DataFrame) -> DataFrame:
    """path, line, at, of and sentence for every sentence of documentation: no trailing comments, notices, or comments in
    bodies but docstrings."""
    own = comments.filter(~F.col("trailing") & (~F.col("buried") | F.col("docstring")) & ~P.notice(F.col("body")))
    own = P.once(own, pieces=P.split(F.col("text")))
    return own.select("path", "line", F.size("pieces").alias("of"), F.posexplode("pieces").alias("at", "sentence")).withColumn("at", F.col("at") + 1)


def anchor(cwd: str) -> str | None:
    """The first file of rules in a folder."""
    return next((n for n in RULE_FILES if cwd and os.path.exists(os.path.join(cwd, n))), None)

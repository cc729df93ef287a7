"""What a session was told already: batch forms of the keyed memory.

A memory has session, path and key; findings have these, a score and an order. Nothing here gathers a session in one
place: unseen() is an anti-join, repeat() a semi-join, and the windows are limited to a few rows before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import lexicon as L


def unseen(findings: DataFrame, memory: DataFrame) -> DataFrame:
    """findings that their session's memory of the same path doesn't hold."""
    known = memory.select("session", "path", "key").distinct()
    return findings.join(known, ["session", "path", "key"], "left_anti")


def budget(findings: DataFrame, write: list[str], then: list[str], most: int = L.BUDGET) -> DataFrame:
    """The findings of the highest score of each write."""
    w = Window.partitionBy(*write).orderBy(F.desc("score"), *then)
    return findings.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def repeat(sessions: DataFrame, memory: DataFrame) -> DataFrame:
    """sessions with repeat: whether the memory has anything of the session, for whatever path."""
    spoken = memory.select("session").distinct().withColumn("repeat", F.lit(True))
    return sessions.join(spoken, "session", "left").withColumn("repeat", F.coalesce("repeat", F.lit(False)))


def lives(events: DataFrame, hours: int = L.STALE_HOURS) -> DataFrame:
    """session, first, last and writes of each stretch of a session in which no gap reaches the limit; after that its
    memory is swept."""
    life = F.session_window("ts", f"{hours} hours")
    return events.groupBy("session", life).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("writes")).drop("session_window")


def remembered(keys: DataFrame, order: list[str], most: int = L.REMEMBERED) -> DataFrame:
    """keys that the memory still takes: none once it holds more than the limit."""
    w = Window.partitionBy("session").orderBy(*order)
    return keys.withColumn("__held", F.row_number().over(w) - 1).filter(F.col("__held") <= most).drop("__held")


def base36(key: Column) -> Column:
    """An unsigned 64-bit number in digits and lower-case letters, as the memory's files are named."""
    return F.lower(F.conv(key.cast("decimal(20,0)").cast("string"), 10, 36))

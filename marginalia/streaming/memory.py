"""Session memory over a stream of findings (session, path, key, ts)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.functions import lexicon as L


def first_sightings(findings: DataFrame) -> DataFrame:
    """Each (session, path, key) once, by the stream's own deduplication: its state is split by key over all tasks. It keeps every
    key for ever; for a stream that doesn't end, see fading_sightings."""
    return findings.dropDuplicates(["session", "path", "key"])


def fading_sightings(findings: DataFrame, hours: int = L.STALE_HOURS) -> DataFrame:
    """As first_sightings, but a key is forgotten once the watermark is `hours` past it, so the state stays bounded."""
    return findings.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark(["session", "path", "key"])


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is there now to a Parquet table; the checkpoint makes each row appear once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def remember_batches(findings: DataFrame, table: str, out: str, checkpoint: str, hours: int | None = None, most: int = L.REMEMBERED) -> StreamingQuery:
    """The hook as micro-batches: each batch is held against the table of what was said, then added to it.

    findings has session, path, key, score and ts, and may have write: the three best are named for each write, or for each
    session and path of a batch without one. A batch's time is that of its latest event. With `hours`
    (lexicon.STALE_HOURS is the hook's) what it said fades so much later, and as the table is partitioned by day, a batch reads
    the last days of it and never all; without, nothing fades. A session that holds more than `most` keys takes
    no more. A batch that is run again overwrites what it wrote.
    """
    from marginalia.operators.memory import budget, unseen

    schema = "session string, path string, key string, at timestamp, day date, batch long"
    write = ["session", "path", *(["write"] if "write" in findings.columns else [])]

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = batch.agg(F.max("ts")).first()[0]
        if now is None:
            return
        said = spark.read.schema(schema).parquet(table) if _exists(spark, table) else spark.createDataFrame([], schema)
        said = said.filter(F.col("batch") != number)
        if hours is not None:
            since = F.lit(now).cast("timestamp") - F.expr(f"interval {hours} hours")
            said = said.filter((F.col("day") >= F.to_date(since)) & (F.col("at") > since))
        first = unseen(batch, said).groupBy(*write, "key").agg(F.max("score").alias("score")).withColumn("at", F.lit(now).cast("timestamp"))
        path = f"{out}/batch={number}"
        budget(first, write, ["key"]).write.mode("overwrite").parquet(path)
        full = said.groupBy("session").agg(F.countDistinct("path", "key").alias("held")).filter(F.col("held") > most)
        new = spark.read.parquet(path).join(full, "session", "left_anti").select("session", "path", "key", "at", F.to_date("at").alias("day"))
        days = new.withColumn("batch", F.lit(number)).write.partitionBy("day", "batch").mode("overwrite")
        days.option("partitionOverwriteMode", "dynamic").parquet(table)

    return findings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expiring_memory(findings: DataFrame, hours: int = L.STALE_HOURS) -> DataFrame:
    """A processor of its own state, where the exact time to live matters: a map of (path, key) for each session, whose
    entries fade `hours` after they were written."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class Memory(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getMapState("seen", "path string, key string", "at timestamp", ttlDurationMs=hours * 3_600_000)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            for part in rows:
                out = []
                for path, k, ts in zip(part["path"], part["key"], part["ts"]):
                    if not self.seen.containsKey((path, k)):
                        self.seen.updateValue((path, k), (ts,))
                        out.append((key[0], path, k))
                yield pd.DataFrame(out, columns=["session", "path", "key"])

        def close(self) -> None:
            pass

    return findings.groupBy("session").transformWithStateInPandas(Memory(), "session string, path string, key string", "Append", "ProcessingTime")

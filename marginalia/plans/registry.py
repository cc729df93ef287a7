"""Queries register themselves here, with the SQL that says what they must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.ship import ship

#: Tables whose rows cost much more to work on than to move.
TEXTS = {"conversations", "documents", "pages"}

#: What goes to Python at a time, in rows and bytes: a worker holds some copies of a batch, whatever the partition's size.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def short_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches, unless the session has shorter ones."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        own = spark.conf.get(key, None)
        if own is None or not (digits := own.rstrip("bB")).isdigit() or not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))


def read(spark: SparkSession, sf_dir: str, table: str, *columns) -> DataFrame:
    """A table of the driver, with only the columns that the query needs. Texts that lie in fewer files than there are cores
    are spread over the cores first, as a single row group is a single task; where there are files enough, nothing moves."""
    ship(spark)
    short_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    few = table in TEXTS and len(df.inputFiles()) < cores
    df = df.select(*columns) if columns else df
    return df.repartition(cores) if few else df

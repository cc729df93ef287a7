"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.shared import scratch_dir

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: At most so many keys can each hold 1/HOT_KEYS of all rows, so a table of those keys is safe to broadcast.
HOT_KEYS = 1000
#: A table of at most so many narrow rows is broadcast, after they were counted.
SAFE_ROWS = 200_000


#: Rows of a batch that are Python objects at one time, and rows of a batch.
SLICE, BATCH = 512, 1000
_collecting: list[list[str]] = []


def freeze(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, survives lost executors and fixes any
    ids drawn from row positions. What isn't discarded before goes when the driver ends."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _collecting:
        made.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.frozen = path
    return out


@contextmanager
def collecting(made: list[str] | None = None):
    """Gathers the paths of all tables that are frozen inside, so that they can be discarded once nothing reads them."""
    made = [] if made is None else made
    _collecting.append(made)
    try:
        yield made
    finally:
        _collecting.pop()


def discard(spark: SparkSession, paths: list[str], keep: tuple = ()) -> None:
    """Deletes frozen tables, but for those to keep."""
    kept = {df.frozen for df in keep}
    for path in paths:
        if path not in kept:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shielded(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """df with other names for those columns that an operator could take for its own, which begin with two underscores or are
    among the names; and the way back, for withColumnsRenamed."""
    taken, back = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.startswith("__") or c.lower() in names:
            new = f"own{c}"
            while new.lower() in taken:
                new = f"own_{new}"
            taken.add(new.lower())
            back[new] = c
    return df.withColumnsRenamed({c: n for n, c in back.items()}), back


def unlike(names: list[str], name: str) -> str:
    """A name that is none of the names."""
    while name.lower() in {n.lower() for n in names}:
        name += "_"
    return name


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH rows, where the session has Spark's own 10,000: rows are whole texts, and a batch is held
    by the JVM and by Python at once."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, str(BATCH))


def sliced(batches):
    """Arrow batches in parts of a few rows, so that of long texts only few are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def lookup(big: DataFrame, small: DataFrame, key: str, weight: str, total: int, how: str = "left") -> DataFrame:
    """big joined to small, which has each key once, without a skewed shuffle.

    If small, counted first, has at most SAFE_ROWS rows, it is broadcast. Else: weight is a column of small: how many rows of big have the key. Keys with at least total / HOT_KEYS rows are at most
    HOT_KEYS in number (total is their sum at least), so they are broadcast and their rows stay where they are; all other
    rows are shuffled by key, where no key has more than that share. big is read twice: freeze it if it is costly.
    Null keys match nothing.
    """
    if small.limit(SAFE_ROWS + 1).count() <= SAFE_ROWS:
        return big.join(F.broadcast(small), key, how)
    bound = max(1.0, total / HOT_KEYS)
    hot, cold = small.filter(F.col(weight) >= bound), small.filter(F.col(weight) < bound)
    mine = big.join(F.broadcast(hot), key)
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti")
    return mine.unionByName(rest.join(cold, key, how))


def literal_rows(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    """A small table of plan constants, made by SQL alone: a JSON literal, taken apart by the JVM."""
    import json

    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))

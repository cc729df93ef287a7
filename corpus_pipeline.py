"""The corpus pipeline: each stage applies one operator to all that the stage before it kept.

In every stage a null text counts as empty to what reads it and stays null, rows that repeat stay as many rows unless the stage
is to drop them, nulls in any other column are carried, an empty table gives an empty one, and columns beside those of
documents are left out.
"""

from __future__ import annotations

import re
from functools import wraps
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, dartminhash, linededup, mixing, toxicity
from marginalia.llm.common import collecting, discard, freeze, literal_rows, short_batches
from marginalia.llm.queries import WEIGHTS
from marginalia.ship import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_tables: list[str] = []


def stage(f):
    """A stage that first deletes what the stages before it wrote for themselves: their results are written by now, which is
    seen from the files that docs reads. So a stage's result has to be written before the next one is called."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        short_batches(spark)
        read = {name for path in docs.inputFiles() for name in path.split("/")}
        old = [p for p in _tables if p.rpartition("/")[2] not in read]
        discard(spark, old)
        _tables[:] = [p for p in _tables if p not in old]
        with collecting(_tables):
            return f(spark, docs, sf_dir)

    return run


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated model takes for toxic (a score of 0.5 or more) go; the others stay as they are. Null and
    empty texts get the score of a text without words. Without labels of both kinds all
    scores are their mean, 0 without any."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, COLUMNS).filter(F.col("score") < 0.5).select(COLUMNS)


@stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more are cut out. A document of which that leaves no word goes with them;
    one that had no words before stays. n_chars follows the text."""
    done = linededup.dedup(docs.select(COLUMNS))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    done = done.filter(F.col("text").isNull() | (F.col("n_removed") == 0) | ~blank)
    return done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row stays, that of least doc_id. Rows of null text are in no class and stay."""
    return dartminhash.near_classes(docs.select(COLUMNS), keep=["text", "lang", "source", "n_chars"]).filter("kept").select(COLUMNS)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the slots that their sources' target weights give them: within a source by doc_id, nulls
    first, equal ones in any order. A null source is one without a weight of its own."""
    return mixing.mixed(docs.select(COLUMNS), WEIGHTS, order=["doc_id"])


def placed(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text and position (from 0), the place of a row in the order in which its files were written, and how many places
    there are. A reader takes files by their size; their names count the tasks of an ordered write, and a file keeps its rows' order."""
    at = docs.metadataColumn("_metadata")
    rows = docs.select("doc_id", "text", at["file_path"].alias("__file"), at["row_index"].alias("__row"))
    files = {r["__file"]: r.n for r in rows.groupBy("__file").agg((F.max("__row") + 1).alias("n")).collect()}
    ordered = sorted(files, key=lambda p: [int(x) if x.isdecimal() else x for x in re.split("([0-9]+)", p)])
    starts = list(accumulate((files[p] for p in ordered), initial=0))
    table = literal_rows(docs.sparkSession, [{"file": p, "start": n} for p, n in zip(ordered, starts)], "file: string, start: bigint")
    table = table.select(F.col("file").alias("__file"), F.col("start").alias("__start"))
    return rows.join(F.broadcast(table), "__file").select("doc_id", "text", (F.col("__start") + F.col("__row")).alias("position")), starts[-1]


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """position (from 0) in the mixed order, doc_id, n_tokens and the digests of the ids and of what they decode to, for every
    document, sorted by position. A task gets an equal stretch of positions, so nothing is sampled and no text encoded twice.
    Null and empty texts have no ids, and the digest of nothing."""
    import public_tokenizers

    rows, n = placed(docs)
    made = bpe.round_trip(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["position", "doc_id"])
    parts = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return made.repartitionById(parts, F.floor(F.col("position") * parts / max(1, n)).cast("int")).sortWithinPartitions("position")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Boosted trees and their calibration are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = freeze(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Comment nodes to comments: neighbouring nodes become one run, by windows over each file.

nodes has path, row, end_row, col, trailing and raw; rows are in document order by (row, col). A file is one window: at
most 2 MiB of source, so no window can grow without bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import lexicon as L
from marginalia.functions import prose as P


def order(path: str = "path"):
    return Window.partitionBy(path).orderBy("row", "col")


def with_runs(nodes: DataFrame) -> DataFrame:
    """nodes with run, a number that counts up in each file. A node joins the run before it if neither is trailing, both
    are on single lines, one right under the other, in the same column."""
    w = order()
    below = (F.lag("end_row").over(w) + 1 == F.col("row")) & (F.lag("row").over(w) == F.lag("end_row").over(w)) & (F.col("row") == F.col("end_row"))
    joins = ~F.col("trailing") & ~F.lag("trailing").over(w) & below & (F.lag("col").over(w) == F.col("col"))
    opened = nodes.withColumn("__opens", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    return opened.withColumn("run", F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__opens")


def with_heads(nodes: DataFrame, blank_before: Column) -> DataFrame:
    """nodes with heads: nothing but white space and such nodes lie between the file's start and this node. blank_before
    says so of the stretch between a node and the one before it."""
    w = order().rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("heads", F.min(blank_before.cast("int")).over(w) == 1)


def plain(raw: Column) -> Column:
    """A node's prose: its lines stripped, the empty ones left out, one space between."""
    return F.array_join(F.filter(F.transform(P.lines(raw), P.strip), lambda x: x != ""), " ")


def body(raw: Column) -> Column:
    """A node's lines with their indentation, one under the other."""
    return F.array_join(F.transform(P.lines(raw), P.indented), "\n")


def gathered(nodes: DataFrame, more: list[Column] | None = None) -> DataFrame:
    """One row for each run of with_runs(): path, run, line (from 1), nodes, trailing and raw, and more aggregates."""
    sorted_raw = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "raw"))), lambda n: n["raw"])
    return nodes.groupBy("path", "run").agg((F.min("row") + 1).alias("line"), F.count("*").alias("nodes"), F.bool_or("trailing").alias("trailing"), sorted_raw.alias("raw"), *(more or []))


def worded(runs: DataFrame) -> DataFrame:
    """gathered() with text and body."""
    text = F.array_join(F.filter(F.transform("raw", plain), lambda x: x != ""), " ")
    return runs.withColumns({"text": text, "body": F.array_join(F.transform("raw", body), "\n")})


def comments(nodes: DataFrame, more: list[Column] | None = None) -> DataFrame:
    """One row for each run of with_runs(), with text and body, and more aggregates."""
    return worded(gathered(nodes, more))


def pragma(raw: Column) -> Column:
    """Whether all nodes of a run are directives and nothing else."""
    return F.forall(raw, P.pragma)


def examined(runs: DataFrame, by: str = "path", first: str = "line", most: int = L.EXAMINED) -> DataFrame:
    """The first runs of each file, as far as a scan looks."""
    w = Window.partitionBy(by).orderBy(first)
    return runs.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def within(nodes: DataFrame, spans: DataFrame, by: str = "path") -> DataFrame:
    """nodes that share a byte with a span of their file. A file's spans are few (64 at most), so they travel as one array."""
    own = spans.groupBy(by).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    hit = F.exists("__spans", lambda s: (F.col("start") < s["end"]) & (s["start"] < F.col("end")))
    return nodes.join(own, by).filter(hit).drop("__spans")

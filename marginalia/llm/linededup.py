"""Deletes later copies of line runs that repeat, in DataFrame operations alone.

Every document is a sequence of line ids, and the suffix array over all of them is built by prefix doubling: level k ranks
the places of a text by the 2**k lines that start there, and level k + 1 by the pair of ranks at a place and 2**k lines
on. Ranks are in the order of the suffixes. A place whose lines are nowhere else is settled and leaves the table, so each
level is smaller than the one before. Suffixes that share their first n lines are an LCP interval of depth n, which two
overlapping ranks of a level name exactly: the one at the run's start and the one that ends with it.

A maximal repeated run is the union of the least runs in it that are long enough, counted from each line onwards and from
each line backwards. So the intervals are asked for these only: one that holds two places or more is a repeat, and in all
its places but the first one the run is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import SAFE_ROWS, WORD, collecting, discard, freeze, lookup, shielded

#: A run is long enough if it has so many words.
MIN_WORDS = 50


def _ranked(keys: DataFrame, *by: str) -> DataFrame:
    """keys with rank, a number in the order of `by`; keys are distinct, so no task of the sort can be hot."""
    return freeze(keys.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def repeats(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """uid, start and size of every least run that occurs before, in another document or in its own.

    lines has doc_id, uid (a number of its own for each document), line (from 0), key (equal for equal lines) and words.
    The order of places is doc_id (null first), uid, line.
    """
    lines = lines.select("doc_id", "uid", "line", "key", "words")
    classes = _ranked(lines.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    active = lookup(lines, classes, "key", "n", total, "inner").select("doc_id", "uid", "line", "words", "rank")
    # Islands of neighbouring lines that occur elsewhere; only one with enough words can hold a run.
    by_line = Window.partitionBy("uid").orderBy("line")
    active = active.withColumn("island", F.col("line") - F.row_number().over(by_line))
    island = Window.partitionBy("uid", "island")
    active = active.withColumn("all", F.sum("words").over(island)).filter(F.col("all") >= min_words).drop("all")
    before = island.orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    active = freeze(active.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))), "active")
    ends = active.groupBy("doc_id", "uid", "island").agg((F.max("line") + 1).alias("line"), F.sum("words").alias("before"))
    marks = active.select("doc_id", "uid", "island", "line", "before").unionByName(ends.select("doc_id", "uid", "island", "line", "before"))
    by_words = island.orderBy("before")
    marks = marks.withColumn("to", F.min("line").over(by_words.rangeBetween(min_words, Window.unboundedFollowing)))
    marks = marks.withColumn("from", F.max("line").over(by_words.rangeBetween(Window.unboundedPreceding, -min_words)))
    onwards = marks.filter("to is not null").select("doc_id", "uid", F.col("line").alias("start"), (F.col("to") - F.col("line")).alias("size"))
    backwards = marks.filter("from is not null").select("doc_id", "uid", F.col("from").alias("start"), (F.col("line") - F.col("from")).alias("size"))
    runs = freeze(onwards.unionByName(backwards).distinct(), "runs")
    longest = runs.agg(F.max("size")).first()[0]

    ranks, k, found = active.select("uid", "line", "rank"), 0, []
    while longest and longest >= 1 << k:
        width = 1 << k
        mine = runs.filter((F.col("size") >= width) & (F.col("size") < 2 * width))
        at = ranks.select("uid", F.col("line").alias("start"), F.col("rank").alias("head"))
        last = ranks.select("uid", (F.col("line") + width).alias("stop"), F.col("rank").alias("tail"))
        named = mine.withColumn("stop", F.col("start") + F.col("size")).join(at, ["uid", "start"]).join(last, ["uid", "stop"])
        interval = F.struct("size", "head", "tail")
        named = freeze(named.select("doc_id", "uid", "start", "size", interval.alias("interval")), "named")
        place = F.struct("doc_id", "uid", "start")
        groups = named.groupBy("interval").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
        groups = freeze(groups, "intervals")
        n = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if n:
            copies = lookup(named, groups, "interval", "n", n, "inner").filter(place != F.col("first"))
            found.append(freeze(copies.select("uid", "start", "size"), "copies"))
        k += 1
        if longest < 1 << k:
            break
        ranks = _doubled(ranks, width)
        if ranks is None:
            break
    if not found:
        return runs.select("uid", "start", "size").limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _doubled(ranks: DataFrame, width: int) -> DataFrame | None:
    """The ranks by twice as many lines, of the places that still share theirs with another; None if there are none."""
    ahead = Window.partitionBy("uid").orderBy("line").rangeBetween(width, width)
    pairs = ranks.select("uid", "line", "rank", F.first("rank").over(ahead).alias("next")).filter("next is not null")
    pairs = freeze(pairs.select("uid", "line", F.struct("rank", "next").alias("pair")), "pairs")
    classes = _ranked(pairs.groupBy("pair").agg(F.count("*").alias("n")).filter("n > 1"), "pair")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return None
    return freeze(lookup(pairs, classes, "pair", "n", total, "inner").select("uid", "line", "rank"), "level")


def dedup(df: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """df, its text without the lines of runs that occur before, with n_lines and n_removed (long).

    A run of lines (as \\n cuts the text; nothing is trimmed) with at least min_words words is deleted wherever it occurs
    after its first occurrence, by doc_id (null first), equal ids in the order of the input, then line; an occurrence may
    overlap the one before it. The remaining lines are joined again. A null text has no lines and stays null; an empty text
    is one line without words; equal rows are copies of the first of them; columns of df named n_lines or n_removed are
    replaced; an empty table gives an empty one. Blank and other frequent lines cost as much as any: tables of hot keys are
    broadcast, the rest is shuffled.
    """
    df, back = shielded(df)
    text = {c: n for n, c in back.items()}.get(text, text)
    own = [c for c in df.columns if c.lower() not in ("n_lines", "n_removed")]
    docs = freeze(df.select(*own, F.monotonically_increasing_id().alias("__uid")), "documents")
    lines = docs.select(F.col("doc_id"), F.col("__uid").alias("uid"), F.posexplode(F.split(text, "\n")).alias("line", "own"))
    lines = lines.select("doc_id", "uid", "line", F.unhex(F.md5(F.col("own").cast("binary"))).alias("key"), F.regexp_count("own", F.lit(WORD)).alias("words"))
    with collecting() as made:
        copies = repeats(freeze(lines, "lines"), min_words)
        gone = copies.select("uid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("line")).distinct()
        gone = freeze(gone.groupBy(F.col("uid").alias("__uid")).agg(F.array_sort(F.collect_list("line")).alias("__gone")), "deleted")
    discard(df.sparkSession, made, keep=(gone,))
    rows, places = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("__gone")), F.lit(0))).first()
    joined = docs.join(F.broadcast(gone) if rows + places // 8 <= SAFE_ROWS else gone, "__uid", "left")
    parts = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    # The lines are bound to a name, so that the text is cut once and not for each line.
    kept = F.transform(F.array(parts), lambda p: F.array_join(F.transform(left, lambda i: F.get(p, i)), "\n"))[0]
    n_removed = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long")
    new = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept)
    out = joined.select(*[new.alias(c) if c == text else F.col(c) for c in own], n_lines.alias("n_lines"), n_removed.alias("n_removed"))
    return out.withColumnsRenamed(back)

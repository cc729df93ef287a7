"""The sweep: files in, findings out. One pass of Python to scan, built-in expressions for the rules, Python again only for
comments that may be code. Files stay whole, so nothing is shuffled but the nodes of a file to its runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import lexicon as L
from marginalia.functions import prose as P
from marginalia.operators import head as H
from marginalia.operators import leftover as LO
from marginalia.operators import rules, runs
from marginalia.sources import scan as S
from marginalia.sources.languages import LANGUAGES, language


def files(spark, path: str) -> DataFrame:
    """path, language and content of the readable files below a folder. The size limit is pushed to the listing."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    own = own.filter(F.col("length") <= L.FILE_BYTES).filter(~F.col("path").contains("/.git/"))
    return own.select("path", language(F.col("path")).alias("language"), "content")


def comments(found: DataFrame, spans: DataFrame | None = None, most: int | None = L.EXAMINED) -> DataFrame:
    """Runs of scanned nodes with text, body and what stands around them: those that what was written touches (see scan(); or
    the spans, if some are given: path, start, end) and that aren't for machines, the first `most` of each file; None: all."""
    nodes = runs.with_heads(runs.with_runs(found.filter("error is null")), F.col("blank_before"))
    if spans is not None:
        hit = runs.within(nodes, spans).select("path", "run").distinct()
        nodes = nodes.join(hit, ["path", "run"], "left_semi")
    order = lambda c: F.struct("row", "col", c)
    at = lambda f, c: f(order(c))[c]
    extra = [
        F.first("language").alias("language"), F.min("start").alias("start"), F.max("end").alias("end"), at(F.min, "buried").alias("buried"), at(F.min, "docstring").alias("docstring"),
        at(F.min, "heads").alias("heads"), at(F.min, "above").alias("above"), F.min(F.struct("row", F.col("col").alias("c")))["c"].alias("col"),
        F.max_by("under", F.struct("row", "col")).alias("under"), F.max_by("declared", F.struct("row", "col")).alias("after"),
        F.min_by("declared", F.struct("row", "col")).alias("within"), F.bool_or("written").alias("written"),
    ]
    # A docstring documents what it stands in, any other comment what comes after its last line.
    own = runs.gathered(nodes, extra).filter("written").drop("written")
    own = own.withColumn("declared", F.when(F.col("docstring"), F.col("within")).otherwise(F.col("after"))).drop("within", "after")
    own = own.filter(~runs.pragma(F.col("raw")))
    # Words are made of the raw lines of what is kept alone.
    return runs.worded(own if most is None else runs.examined(own, most=most))


def structural(made: DataFrame) -> DataFrame:
    """Comments, but for notices, with v: the class and score of the first structural rule that fires, null if none does."""
    functions = F.col("language").isin([n for n, (_, _, has) in LANGUAGES.items() if has])
    own = made.filter(~P.notice(F.col("body")) | F.col("buried"))
    own = LO.mark(own, LO.candidate(F.col("language"), F.col("text"), F.col("docstring"), F.col("trailing")))
    echo = F.coalesce(F.col("under.one_line"), F.lit(False)) & F.col("buried") & ~F.col("docstring") & ~F.col("trailing") & rules.echoes(F.col("text"), _names())
    documents = F.when(F.col("docstring"), F.size("declared") > 0).otherwise(~F.col("buried") & (F.coalesce(F.col("under.kind"), F.lit("")) == "definition"))
    hollow = P.hollow_sentences(P.split(F.col("text")), F.col("declared"))
    hollow = F.when(documents & ~F.col("trailing") & ~F.col("heads") & functions, hollow).otherwise(F.array().cast("array<struct<at:int,why:string,text:string>>"))
    own = P.once(own, hollow=hollow)
    return P.once(own, v=rules.inspect(F.col("leftover"), echo, F.col("hollow"), P.sentences(F.col("text"))))


def _names() -> Column:
    """The words of the line under a comment."""
    return F.coalesce("under.words", F.array().cast("array<string>"))


def judge(made: DataFrame, head: DataFrame | None = None, vectors: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """path, line, class, score, reason and key of every comment that a rule objects to.

    Structural rules come first. Of what they leave, the first three sentences are read: by the head (class, name, direction
    and threshold, a row for each class), where `vectors` gives rows with a column sentence their column embedding; without
    a head each by the list of phrases. The best reading counts, of equal ones the first sentence's. A restatement counts
    only if the line below bears it out; it isn't read as anything else then. A comment is read by three sentences at most,
    so no group is large; the head is one row that is broadcast.
    """
    own = structural(made)
    key, reason = P.site_key(F.col("text")).alias("key"), F.create_map(*[F.lit(x) for kv in rules.REASONS.items() for x in kv])
    pieces = P.opening(P.split(F.col("text")))
    if head is None:
        said = F.exists(pieces, P.compat)
        phrase = F.when(said, F.struct(F.lit("phrase").alias("class"), F.lit(0.5).alias("score")))
        own = P.once(own.withColumnRenamed("v", "rule"), v=F.coalesce("rule", phrase))
    else:
        under = F.coalesce(F.col("under.one_line"), F.lit(False)) & ~F.col("trailing") & ~F.col("docstring")
        bears = under & rules.restates(F.col("text"), _names(), F.col("buried"), F.coalesce("under.last", F.lit(False)))
        own = P.once(own.withColumn("hollow", F.slice("hollow", 1, 1)), bears=bears, pieces=F.when(F.col("v").isNull(), pieces))
        own = own.withColumn("bias", H.allowance(F.col("buried") & ~F.col("docstring"), F.size("pieces")))
        own = own.select("path", "run", "line", "text", "v", "hollow", "bears", "bias", F.posexplode_outer("pieces").alias("at", "sentence"))
        classes = head.filter("threshold is not null").agg(F.collect_list(F.struct("class", "name", "direction", "threshold")).alias("classes"))
        read = vectors(own).join(F.broadcast(classes))

        def past(c):
            margin = F.round(F.round(H.dot(F.col("embedding"), c["direction"]), 9) - (c["threshold"] - F.col("bias")), 9)
            return F.struct(margin.alias("margin"), (-c["class"]).alias("order"), c["name"].alias("name"))

        read = read.withColumn("r", F.array_max(F.filter(F.transform("classes", past), lambda r: r["margin"] > L.CLEAR)))
        best = F.max(F.when(F.col("r").isNotNull(), F.struct(F.col("r.margin").alias("margin"), (-F.col("at")).alias("at"), F.col("r.name").alias("name")))).alias("r")
        own = read.groupBy("path", "run").agg(*[F.first(c).alias(c) for c in ("line", "text", "v", "hollow", "bears")], best)
        kept = F.col("r").isNotNull() & ((F.col("r.name") != "tautology") | F.col("bears"))
        own = own.withColumn("v", F.coalesce("v", F.when(kept, F.struct(F.col("r.name").alias("class"), F.col("r.margin").alias("score")))))
    found = own.filter("v is not null")
    said = F.coalesce(reason[F.col("v.class")], F.col("v.class"))
    said = F.when(F.col("v.class") == "hollow", F.concat(said, F.lit(': cut "'), F.col("hollow")[0]["text"], F.lit('"'))).otherwise(said)
    return found.select("path", "line", F.col("v.class").alias("class"), F.col("v.score").alias("score"), said.alias("reason"), key)


def sweep(spark, path: str, head: DataFrame | None = None, vectors: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The findings of all files below a folder, file by file, the worst first. All comments are read; the first 64 of a file are
    the hook's limit."""
    return judge(comments(S.scan(files(spark, path)), most=None), head, vectors).orderBy("path", F.desc("score"), "line")

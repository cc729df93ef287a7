"""The fitted head: one direction and one threshold for each class, from labelled vectors.

Labels are whole numbers, 0 for contracts (the negatives). All arithmetic is in doubles, and scores are rounded to nine
places before anything is compared with them, so no result depends on the order of a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import lexicon as L


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def unit(v: Column) -> Column:
    """v at length 1; a zero vector stays as it is."""
    return F.transform(F.array(dot(v, v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / F.sqrt(n))).otherwise(v))[0]


def centroids(rows: DataFrame) -> DataFrame:
    """label and centroid, the mean of each component over the label's vectors (label, embedding)."""
    each = rows.select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    parts = each.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("parts"))
    return parts.select("label", F.transform("parts", lambda p: p["x"]).alias("centroid"))


def directions(rows: DataFrame) -> DataFrame:
    """class and direction: from the negatives' centroid towards the class's, at length 1."""
    c = centroids(rows)
    negative = c.filter("label = 0").select(F.col("centroid").alias("negative"))  # one row
    made = c.filter("label <> 0").join(F.broadcast(negative))
    return made.select(F.col("label").alias("class"), unit(difference(F.col("centroid"), F.col("negative"))).alias("direction"))


def scores(rows: DataFrame, heads: DataFrame, keep: list[str]) -> DataFrame:
    """keep, class and score, for every vector and class: heads has one row for each class, so it is broadcast."""
    both = rows.join(F.broadcast(heads))
    return both.select(*keep, *[c for c in heads.columns if c != "direction"], F.round(dot(F.col("embedding"), F.col("direction")), 9).alias("score"))


#: Scores are cumulated by stretches of this width, each a window of its own; scores of unit vectors lie in 1,024 of them.
STRETCH = 1 / 512


def measured(scored: DataFrame, windows: list[float], by: list[str] | None = None) -> DataFrame:
    """by, score, hits, precise and bands, for each score of each class: how many rows from it upwards are right, their share,
    and the share of right rows within each of the windows around it (null where a score is null).

    A frame that slides would be summed anew for each row. Here each score is a point with its rows' numbers, and each end of
    its windows a point without; numbers are cumulated once from the highest point down, within stretches of scores and over
    the stretches' totals, and each share is a difference of two of them. So no partition is a whole class, and the work is a sort.
    """
    by = by or ["class"]
    own = scored.groupBy(*by, "score").agg(F.count("*").alias("__n"), F.count(F.when(F.col("label") == F.col("class"), 1)).alias("__r"))
    # From above, what begins a window (-1) comes before the rows of its score, what ends it (1) after them.
    ends = [(w, i, s) for i, w in enumerate(windows) for s in (-1, 1)]
    point = lambda x, side, i, n, r: F.struct(x.alias("x"), F.lit(side).alias("side"), F.lit(i).alias("i"), n.alias("n"), r.alias("r"))
    none = F.lit(0).cast("bigint")
    points = F.array(point(F.col("score"), 0, -1, F.col("__n"), F.col("__r")), *[point(F.col("score") - s * w, s, i, none, none) for w, i, s in ends])
    points = own.select(*by, "score", F.explode(points).alias("p")).select(*by, "score", "p.*")
    stretch = F.when(F.isnan("x"), 2**63 - 1).otherwise(F.coalesce(F.floor(F.col("x") / STRETCH), F.lit(-(2**63))))
    points = points.withColumn("__s", stretch)
    totals = points.groupBy(*by, "__s").agg(F.sum("n").alias("n"), F.sum("r").alias("r"))
    above = Window.partitionBy(*by).orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "__s", F.coalesce(F.sum("n").over(above), none).alias("__an"), F.coalesce(F.sum("r").over(above), none).alias("__ar"))
    down = Window.partitionBy(*by, "__s").orderBy(F.desc("x"), "side").rowsBetween(Window.unboundedPreceding, 0)
    run = points.withColumns({"n": F.sum("n").over(down), "r": F.sum("r").over(down)}).join(totals, [*by, "__s"])
    n, r = F.col("n") + F.col("__an"), F.col("r") + F.col("__ar")
    at = lambda c, i, side: F.max(F.when((F.col("i") == i) & (F.col("side") == side), c))
    bands = [F.try_divide(at(r, i, 1) - at(r, i, -1), at(n, i, 1) - at(n, i, -1)) for i in range(len(windows))]
    made = run.groupBy(*by, "score").agg(at(r, -1, 0).alias("hits"), at(r, -1, 0).alias("__r"), at(n, -1, 0).alias("__n"), F.array(*bands).alias("bands"))
    return made.withColumn("precise", F.col("__r") / F.col("__n")).drop("__r", "__n")


def threshold(precision: float | Column, window: int = 0) -> Column:
    """The aggregate of measured() that cut() describes, for one of its windows."""
    ok = (F.col("hits") > 0) & (F.col("precise") >= precision) & (F.col("bands")[window] >= precision)
    return F.min(F.when(ok, F.col("score")))


def cut(scored: DataFrame, precision: float | Column = L.PRECISION, window: float = L.WINDOW, by: list[str] | None = None) -> DataFrame:
    """by (class) and threshold: the lowest score at which the precision of all rows from it upwards, and that of the rows
    within the window around it, both reach `precision`; null if none does (the class stays silent). Rows of one score
    count together."""
    by = by or ["class"]
    return measured(scored, [window], by).groupBy(*by).agg(threshold(precision).alias("threshold"))


def fit(rows: DataFrame, precision: float = L.PRECISION, window: float = L.WINDOW) -> DataFrame:
    """class, direction and threshold."""
    d = directions(rows)
    return d.join(F.broadcast(cut(scores(rows, d, ["label"]), precision, window)), "class")


def nearest(scored: DataFrame, key: list[str], bias: Column, clear: float | Column = L.CLEAR) -> DataFrame:
    """key, class and margin: for each vector the class that it passes by most, if by more than `clear`; ties go to the
    smaller class. scored has class, score and threshold."""
    margin = F.round(F.col("score") - (F.col("threshold") - bias), 9)
    own = scored.filter("threshold is not null").withColumn("margin", margin).filter(F.col("margin") > clear)
    best = own.groupBy(*key).agg(F.max(F.struct("margin", (-F.col("class")).alias("c"))).alias("b"))
    return best.select(*key, (-F.col("b.c")).alias("class"), F.col("b.margin").alias("margin"))


def judge(readings: DataFrame, comment: str = "comment", sentence: str = "sentence") -> DataFrame:
    """The best reading of each comment; of equal ones the earliest sentence's."""
    best = readings.groupBy(comment).agg(F.max(F.struct("margin", (-F.col(sentence)).alias("s"), "class")).alias("b"))
    return best.select(comment, F.col("b.class").alias("class"), F.col("b.margin").alias("margin"))


def allowance(buried: Column, sentences: Column, step: float | Column = L.PER_DRAW) -> Column:
    """How far the threshold moves: down inside a body, up for each sentence past the first."""
    return F.when(buried, L.BURIED).otherwise(0.0) - (sentences - 1) * step


def stability(rows: DataFrame, order: str) -> DataFrame:
    """class and cosine of the directions of its two alternating halves, each against all negatives."""
    half = F.row_number().over(Window.partitionBy("label").orderBy(order)) % 2
    halves = rows.withColumn("half", half)
    one, two = (directions(halves.filter((F.col("half") == h) | (F.col("label") == 0))).withColumnRenamed("direction", f"d{h}") for h in (0, 1))
    return one.join(F.broadcast(two), "class").select("class", dot(F.col("d0"), F.col("d1")).alias("cosine"))


def fingerprint(examples: list[tuple[str, str]]) -> int:
    """FNV-1a, 64 bits, over the labelled texts in their order: any change of the corpus makes another number."""
    h = 0xCBF29CE484222325
    for text, label in examples:
        for b in f"{label}={text}\0".encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def save(head: DataFrame, path: str, mark: int) -> None:
    """Writes a head with the fingerprint of the corpus that it was fitted on."""
    head.withColumn("fingerprint", F.lit(str(mark)).cast("decimal(20,0)")).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str, mark: int, width: int, classes: int) -> DataFrame:
    """A head as save() wrote it; refused if it is of another corpus, or has other classes or another width."""
    found = spark.read.parquet(path)
    good = found.filter((F.col("fingerprint") == F.lit(str(mark)).cast("decimal(20,0)")) & (F.size("direction") == width))
    if good.count() != classes or found.count() != classes:
        raise ValueError(f"the head in {path} doesn't fit its corpus")
    return good.drop("fingerprint")

"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations alone.

Slots are handed out in frames. In a frame of Q slots, block i of a source of whole weight w (Q is the sum of the weights)
is released at floor(i * Q / w) and due by ceil((i + 1) * Q / w); among released blocks the earliest deadline goes first.
As the weights fill the frame exactly, every block gets a slot within its window, so no source is ever a whole block ahead
of or behind its share. Frames of equal weights are alike, so one is worked out and all are known. When a source runs out,
its frame stops where its next block would be, and the others start a new frame by their own weights: nothing is dropped
or repeated. The frames are worked out from the weights and the sources' counts alone; rows meet them in a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import freeze, literal_rows, shielded

#: The class of all sources that have no weight of their own, null among them.
REST = "*"


def frame(weights: list[int]) -> list[list[int]]:
    """The slots of each source in a frame: of the blocks released so far, the one of the earliest deadline is next."""
    total, done = sum(weights), [0] * len(weights)
    slots: list[list[int]] = [[] for _ in weights]
    for t in range(total):
        released = (i for i, w in enumerate(weights) if done[i] < w and done[i] * total < (t + 1) * w)
        first = min(released, key=lambda i: (-(-(done[i] + 1) * total // weights[i]), i))
        slots[first].append(t)
        done[first] += 1
    return slots


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[dict]:
    """Runs of equal frames, one for each set of sources that still have blocks, from counts of blocks alone. A row for each
    run and source: its blocks first to end - 1 are in this run, which starts at a slot."""
    left, at, out = {s: n for s, n in blocks.items() if n}, 0, []
    while left:
        names = sorted(left)
        w = {s: weights[s] for s in names}
        places = dict(zip(names, frame(list(w.values()))))
        total, frames = sum(w.values()), min(left[s] // w[s] for s in names)
        rest = {s: left[s] - frames * w[s] for s in names}
        cut = min(places[s][rest[s]] for s in names if rest[s] < w[s])
        for s in names:
            n = frames * w[s] + sum(p < cut for p in places[s])
            first = blocks[s] - left[s]
            out.append({"source": s, "first": first, "end": first + n, "slot": at, "w": w[s], "total": total, "places": places[s]})
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        at += frames * total + cut
    return out


def schedule(df: DataFrame, weights: dict[str, int], default: int = 1, order: list[str] | None = None, source: str = "source", block: int = 1) -> DataFrame:
    """df with mix_slot, mix_release and mix_deadline (long): the slot of a row's block and the window it has to fall into.

    A source's rows come in the given order, ties in any order, `block` rows to a block; blocks of a source without a
    weight of its own, or null, share the default weight as one source. Slots have no gaps. Every row gets one, repeated
    ones too; columns of df with these names are replaced; an empty table gives an empty one. The sort is by source and
    order with a tie-breaker, so a hot source or a repeated key is spread over many tasks; what is broadcast is bounded by
    the number of weights and of partitions.
    """
    spark = df.sparkSession
    df, back = shielded(df)
    under = {c: n for n, c in back.items()}
    source, order = under.get(source, source), [under.get(c, c) for c in order or []]
    own = [c for c in df.columns if c.lower() not in ("mix_slot", "mix_release", "mix_deadline")]
    name = F.when(F.col(source).isin(list(weights)), F.col(source)).otherwise(REST) if weights else F.lit(REST)
    rows = df.select(*own, F.coalesce(name, F.lit(REST)).alias("__source"), F.xxhash64(F.monotonically_increasing_id()).alias("__tie"))
    rows = rows.orderBy("__source", *order, "__tie").withColumn("__at", F.monotonically_increasing_id())
    rows = freeze(rows.drop("__tie"), "by-source").withColumn("__part", F.shiftright("__at", 33))
    spans = rows.groupBy("__source", "__part").agg(F.min("__at").alias("__from"), F.count("*").alias("__n"))
    spans = freeze(spans, "spans")  # sorted by source, so there are no more spans than partitions and sources
    before = Window.partitionBy("__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    counts = {r.s: r.n for r in spans.groupBy(F.col("__source").alias("s")).agg(F.sum("__n").alias("n")).collect()}
    all_weights = {**{s: int(w) for s, w in weights.items()}, REST: default}
    plan = phases({s: -(-n // block) for s, n in counts.items()}, all_weights)
    table = literal_rows(spark, plan, "source: string, first: bigint, end: bigint, slot: bigint, w: bigint, total: bigint, places: array<bigint>")
    run = F.struct("first", "end", "slot", "w", "total", "places")
    runs_of = table.groupBy(F.col("source").alias("__source")).agg(F.collect_list(run).alias("__runs"))

    rows = rows.join(F.broadcast(spans.select("__source", "__part", "__from", "__before")), ["__source", "__part"])
    number = F.floor((F.col("__at") - F.col("__from") + F.col("__before")) / block)
    rows = rows.withColumn("__j", number).join(F.broadcast(runs_of), "__source")
    mine = F.element_at(F.filter("__runs", lambda r: (F.col("__j") >= r["first"]) & (F.col("__j") < r["end"])), 1)
    rows = rows.withColumn("__run", mine).withColumn("__i", F.col("__j") - F.col("__run.first"))
    w, total, k = F.col("__run.w"), F.col("__run.total"), F.pmod(F.col("__i"), F.col("__run.w"))
    base = F.col("__run.slot") + F.floor(F.col("__i") / w) * total
    return rows.select(
        *own,
        (base + F.element_at("__run.places", (k + 1).cast("int"))).alias("mix_slot"),
        (base + F.floor(k * total / w)).alias("mix_release"),
        (base + F.ceil((k + 1) * total / w)).alias("mix_deadline"),
    ).withColumnsRenamed(back)


def mixed(df: DataFrame, weights: dict[str, int], default: int = 1, order: list[str] | None = None, source: str = "source", block: int = 1) -> DataFrame:
    """The rows of df, with its columns, in the order of their slots."""
    return schedule(df, weights, default, order, source, block).orderBy("mix_slot", *(order or [])).select(*df.columns)

"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows of each input partition go to each shard is drawn exactly as a uniform permutation of all rows would have
it: a multivariate hypergeometric draw for each partition from what the shards still have room for. Rows are then permuted
within their partition, sent by the matrix, and permuted again within their shard.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import freeze, shielded

#: Rows that are permuted within one task, about.
PIECE = 500_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` drawn from good + bad are good, at any size (numpy's own sampler stops at a thousand million)."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good else 0
    total = good + bad
    mean = draws * good / total
    around = 40 + 12 * math.sqrt(max(mean * (bad / total) * (total - draws) / (total - 1), 0))
    k = np.arange(max(0, draws - bad, int(mean - around)), min(good, draws, int(mean + around)) + 1, dtype=float)
    steps = np.log((good - k[:-1]) * (draws - k[:-1])) - np.log((k[:-1] + 1) * (bad - draws + k[:-1] + 1))
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.exp(weight - weight.max())
    return int(k[np.searchsorted(np.cumsum(chance) / chance.sum(), rng.random(), side="right").clip(0, len(k) - 1)])


def matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows for partitions, columns for shards; row sums are the counts, column sums differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    room = [total // shards + (i < total % shards) for i in range(shards)]
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for i, draws in enumerate(counts):
        rest = sum(room)
        for s in range(shards):
            rest -= room[s]
            out[i, s] = hypergeometric(rng, room[s], rest, draws)
            draws -= int(out[i, s])
            room[s] -= int(out[i, s])
    return out


def shuffle(df: DataFrame, shards: int, seed: int = 0, piece: int = PIECE) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 within its shard), both int and long.

    Every row gets one place, drawn uniformly; shard sizes differ by one at most. Where rows are depends on their position
    alone, so nulls, ties and equal rows are as good as any others, and no key can be hot. Columns of df named shard or
    slot are replaced. An empty table gives an empty one. The driver holds one row of the matrix for each partition.
    """
    df, back = shielded(df)
    own = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    frozen = freeze(df.select(*own, F.monotonically_increasing_id().alias("__uid")), "rows")
    part = F.shiftright("__uid", 33)
    counts = {r.p: r.n for r in frozen.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    parts = sorted(counts)
    sent = matrix([counts[p] for p in parts], shards, seed)
    ends = df.sparkSession.createDataFrame([(p, row.tolist()) for p, row in zip(parts, sent.cumsum(axis=1))], "__part long, ends array<long>")
    local = Window.partitionBy("__part").orderBy(F.xxhash64("__uid", F.lit(seed)), "__uid")
    rows = frozen.withColumn("__part", part).withColumn("__rank", F.row_number().over(local) - 1)
    rows = rows.join(F.broadcast(ends) if len(parts) * shards <= 1_000_000 else ends, "__part")
    rows = rows.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("__rank"))).cast("int"))
    # The second permutation: a shard is cut into pieces by another hash; a place is the piece's first one plus the rank in it.
    pieces = max(1, -(-sum(counts.values()) // (shards * piece)))
    rows = rows.withColumn("__piece", F.pmod(F.xxhash64("__uid", F.lit(seed + 1)), F.lit(pieces)))
    rows = freeze(rows.drop("ends", "__rank", "__part"), "sent")
    sizes = rows.groupBy("shard", "__piece").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("shard", "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("shard", "__piece").orderBy(F.xxhash64("__uid", F.lit(seed + 2)), "__uid")
    placed = rows.withColumn("__rank", F.row_number().over(within) - 1)
    placed = placed.join(F.broadcast(firsts) if pieces * shards <= 1_000_000 else firsts, ["shard", "__piece"])
    return placed.select(*own, "shard", (F.col("__first") + F.col("__rank")).alias("slot")).withColumnsRenamed(back)

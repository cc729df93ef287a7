"""Exact top-k by inner product as a Voronoi join.

Data are grouped by their nearest pivot; each group is summed up by its radius, its largest norm and its k least distances
from the pivot. From these summaries each query gets a score that its k best surely reach, and for each group a score that
nothing in it exceeds; only groups that may hold one of its k best are needed. Neighbouring groups are packed into blocks of
bounded size, large ones are cut into several. A query goes to the blocks of the groups it needs, the queries of a block are
cut into chunks by how many really go there, and a row is copied only to the chunks of its own block, and not at all if no
query needs its group. Each pair of a chunk and a block is solved by a matrix product, and the blocks' best are merged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import freeze, literal_rows

#: Pivots at most (else the root of the number of rows); rows of a block of data and of a chunk of queries.
PIVOTS, BLOCK, CHUNK = 2048, 8192, 8192
#: Queries that one task finds the groups of, and numbers in a matrix of bounds.
ASKS, CELLS = 512, 1 << 22


def whole(vector: str) -> Column:
    """Each component x of a vector as floor(256 * x); null if the vector is null or has a null or non-finite component."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(as_double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.col(vector).isNotNull() & ~bad, F.transform(as_double, lambda x: F.floor(x * 256)))


def _matrix(values, width: int) -> np.ndarray:
    """Vectors as rows; one that is shorter than width counts as followed by zeros."""
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


def top_k(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k highest scores; ties go to the smaller vec_id.

    Both tables have vec_id and v, an array of whole numbers (a product beyond 64 bits is an error); rows where either is null take no part.
    A query meets every row of another vec_id, so repeated rows count each; a vec_id that repeats among the queries is
    asked once, with the least of its vectors. Vectors may differ in length: what is missing counts as 0. Fewer than k
    candidates give fewer rows; an empty table gives none. Where queries are rows of the data themselves, see top_k_of_rows.
    """
    data = data.select(F.col("vec_id").cast("long"), F.col("vec_id").cast("long").alias("own"), F.col("v").cast("array<long>").alias("v")).dropna()
    queries = queries.select(F.col("vec_id").cast("long"), F.col("v").cast("array<long>").alias("v")).dropna()
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", F.col("vec_id").alias("own"), "v")
    return _best(freeze(queries, "queries"), freeze(data, "vectors"), k)


def top_k_of_rows(rows: DataFrame, asks: Column, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: of each row that asks, the k highest scores among all rows but itself.

    rows has vec_id and v as in `top_k`, and nulls, lengths, ties and empty tables are treated as there. A row is itself only:
    rows that repeat a vec_id ask each for themselves, under the same query_id, and are candidates of each other.
    """
    uid = F.monotonically_increasing_id().alias("own")
    rows = rows.select(F.col("vec_id").cast("long"), uid, F.col("v").cast("array<long>").alias("v"), asks.alias("asks")).dropna(subset=["vec_id", "v"])
    rows = freeze(rows, "vectors")
    return _best(rows.filter("asks").drop("asks"), rows.drop("asks"), k)


def _best(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score. Both tables are frozen and have vec_id, own and v; own is unique among the queries,
    and rows of the data with the query's own are no candidates of it."""
    spark = data.sparkSession
    n, width = data.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_queries, wide = queries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, wide, 1)
    few = data.orderBy(F.xxhash64("own"), "v").select("v").limit(2 * PIVOTS).collect()
    pivots = np.unique(_matrix([r.v for r in few], width), axis=0)
    pivots = pivots[np.random.default_rng(7).permutation(len(pivots))[: min(PIVOTS, max(1, int(n**0.5)))]]

    def assign(batches):
        for pdf in batches:
            x = _matrix(pdf["v"], width)
            d = _distances(x, pivots) if len(pdf) else np.zeros((0, 1))
            cell = d.argmin(1) if len(pdf) else np.zeros(0, int)
            yield pdf.assign(cell=cell, far=d[np.arange(len(pdf)), cell], norm=np.sqrt((x**2).sum(1)))

    placed = freeze(data.mapInPandas(assign, "vec_id long, own long, v array<long>, cell int, far double, norm double"), "placed")
    by_far = Window.partitionBy("cell").orderBy("far")
    near = placed.select("cell", "far", "own").withColumn("i", F.row_number().over(by_far)).filter(F.col("i") <= k + 1)
    near = {r.cell: sorted(map(tuple, r.d)) for r in near.groupBy("cell").agg(F.collect_list(F.struct("far", "own")).alias("d")).collect()}
    cells = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect()}
    ids, blocks = _packed({c: r.n for c, r in cells.items()}, pivots)
    first, many = np.array([blocks[c][0] for c in ids]), np.array([blocks[c][1] for c in ids])
    own_pivots = pivots[ids]
    column = np.repeat(np.arange(len(ids)), [len(near[c]) for c in ids])
    near_far, near_own = (np.array([x[i] for c in ids for x in near[c]]) for i in (0, 1))
    far, norm = np.array([cells[c].far for c in ids]), np.array([cells[c].norm for c in ids])
    between_pivots = _distances(own_pivots, own_pivots)
    step, places = max(1, CELLS // len(column)), np.arange(len(ids))

    def bounds(x: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """For each query, which groups may hold one of its k best. Rows with the query's own, however many, don't vouch for
        its lower bound."""
        size, product, d = np.sqrt((x**2).sum(1)), x @ own_pivots.T, _distances(x, own_pivots)
        low = product[:, column] - size[:, None] * near_far[None, :]
        low[mine[:, None] == near_own[None, :]] = -np.inf
        sure = -np.partition(-low, k - 1, axis=1)[:, k - 1] if low.shape[1] >= k else np.full(len(x), -np.inf)
        gap = np.maximum(d - far, 0)  # no member is nearer to the query
        nearest, rows = d.argmin(1), np.arange(len(x))
        between = between_pivots[nearest]
        beyond = (d**2 - d[rows, nearest][:, None] ** 2) / (2 * np.maximum(between, 1e-9))  # the groups' border plane
        gap = np.maximum(gap, np.where(between > 0, beyond, 0))
        most = np.minimum(product + size[:, None] * far, (size[:, None] ** 2 + norm**2 - gap**2) / 2)
        most = np.minimum(most, size[:, None] * norm)
        return most + 1e-9 * size[:, None] * (norm + far) + 1e-3 >= sure[:, None]

    def find(batches):
        for pdf in batches:
            x, mine, needed = _matrix(pdf["v"], width), pdf["own"].to_numpy(), []
            for at in range(0, len(pdf), step):
                needed += [np.flatnonzero(goes) for goes in bounds(x[at : at + step], mine[at : at + step])]
            goes_to = [np.unique(np.concatenate([np.arange(first[j], first[j] + many[j]) for j in own])) if len(own) else own for own in needed]
            bits = [np.packbits(np.isin(places, own)).tobytes() for own in needed]
            yield pdf.assign(cells=bits, blocks=[b.astype(np.int32) for b in goes_to])

    def union(batches):
        import pandas as pd

        some = np.zeros(len(ids), bool)
        for pdf in batches:
            for b in pdf["cells"]:
                some |= np.unpackbits(np.frombuffer(b, np.uint8), count=len(ids)).astype(bool)
        yield pd.DataFrame({"cell": np.asarray(ids, np.int32)[some]})

    schema = "vec_id long, own long, v array<long>, cells binary, blocks array<int>"
    asked = freeze(queries.repartition(-(-n_queries // ASKS)).mapInPandas(find, schema), "asked")
    # At most PIVOTS groups, and a block for every BLOCK / 2 rows and group: both tables are small beside the vectors.
    wanted = freeze(asked.select("cells").mapInPandas(union, "cell int").distinct(), "wanted-groups")
    loads = asked.select(F.explode("blocks").alias("block")).groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    loads = freeze(loads, "loads")
    of_cell = literal_rows(spark, [{"cell": int(c), "first": int(blocks[c][0]), "many": int(blocks[c][1])} for c in ids], "cell: int, first: int, many: int")
    cut = placed.join(F.broadcast(of_cell), "cell").join(F.broadcast(wanted), "cell", "left_semi")
    cut = cut.select("vec_id", "own", "v", (F.col("first") + F.pmod(F.xxhash64("own", "far"), F.col("many"))).cast("int").alias("block"))
    cut = cut.join(F.broadcast(loads), "block").select("vec_id", "own", "v", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    sent = asked.select(F.col("vec_id").alias("query_id"), "own", "v", F.explode("blocks").alias("block")).join(F.broadcast(loads), "block")
    sent = sent.select("query_id", "own", "v", "block", F.pmod(F.xxhash64("own"), F.col("chunks")).cast("int").alias("chunk"))

    def solve(asked, given):
        import pandas as pd

        if not len(asked) or not len(given):
            return pd.DataFrame({"query_id": [], "ask": [], "vec_id": [], "score": []}).astype("int64")
        given = given.sort_values("vec_id", kind="stable")
        x, ids, own = _matrix(given["v"], width), given["vec_id"].to_numpy(), given["own"].to_numpy()
        out, m = [], len(own)
        for at in range(0, len(asked), 512):
            part = asked.iloc[at : at + 512]
            q, mine, name = _matrix(part["v"], width), part["own"].to_numpy(), part["query_id"].to_numpy()
            take = min(k, m)
            if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * width * m < 2**53:
                scores = (q @ x.T).astype(np.int64)
                key = scores * m + np.arange(m - 1, -1, -1)[None, :]  # a higher score first, then a smaller id
                key = np.where(own[None, :] == mine[:, None], -np.iinfo(np.int64).max, key)  # last: the least that can be negated
                best = np.argpartition(-key, take - 1, axis=1)[:, :take]
            else:  # beyond what doubles hold exactly: Python's integers
                scores = np.array([[sum(a * b for a, b in zip(u.tolist(), v.tolist())) for v in given["v"]] for u in part["v"]], dtype=object)
                best = np.array([sorted(range(m), key=lambda i: (own[i] == me, -row[i], i))[:take] for me, row in zip(mine, scores)])
            r = np.repeat(np.arange(len(part)), best.shape[1])
            c = best.ravel()
            keep = own[c] != mine[r]
            out.append(pd.DataFrame({"query_id": name[r][keep], "ask": mine[r][keep], "vec_id": ids[c][keep], "score": scores[r, c][keep].astype("int64")}))
        return pd.concat(out)

    found = sent.groupBy("block", "chunk").cogroup(cut.groupBy("block", "chunk")).applyInPandas(solve, "query_id long, ask long, vec_id long, score long")
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packed(sizes: dict[int, int], pivots: np.ndarray) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """The groups in an order in which neighbours are mostly near each other, and of each its first block and how many it has.
    Whole groups share a block as long as it holds no more than BLOCK rows; one with more has blocks of its own."""
    ids = sorted(sizes)
    own = pivots[ids] - pivots[ids].mean(0)
    way = np.linalg.svd(own, full_matrices=False)[2][0] if len(ids) > 1 else own[0]
    ids = [ids[i] for i in np.argsort(own @ way, kind="stable")]
    blocks, at, filled = {}, 0, 0
    for c in ids:
        many = -(-sizes[c] // BLOCK)
        if filled and (many > 1 or filled + sizes[c] > BLOCK):
            at, filled = at + 1, 0
        blocks[c] = (at, many)
        filled += sizes[c]
        if many > 1:
            at, filled = at + many, 0
    return ids, blocks

"""Near-duplicate detection with DartMinHash signatures.

Darts are thrown at the plane of weight by rank over each element, from hashes alone, so that any two documents see the
same darts where their elements have weight in common. A dart that falls below an element's weight hits the document; of
the hits of each coordinate, the one of least rank is kept. Two documents agree in a coordinate with the probability of
their weighted Jaccard similarity. Only as much of the plane is looked at as is needed to hit every coordinate, so a
signature of k coordinates takes time in proportion to k log k plus the number of elements.

Candidates share a band of coordinates. They are compared exactly, by their sets of shingles; classes are the connected
components of the pairs that are similar enough.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import SAFE_ROWS, collecting, discard, freeze, lookup, shielded, sliced

#: Words in a shingle, similarity of a pair, coordinates in a band and bands. At similarity 0.8 a pair shares no band with
#: probability (1 - 0.8**6)**40, about 5 in a million.
WORDS, SIMILARITY, ROWS, BANDS = 5, 0.8, 6, 40

_U = np.uint64
_P, _A, _GOLD = _U(0x9E3779B97F4A7C55), _U(0xD6E8FEB86659FD93), _U(0x9E3779B97F4A7C15)
_P_INVERSE = _U(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The chance of n darts or fewer in a cell of area 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(17)])
_powers: list[np.ndarray] = []
#: Bytes of a text that are hashed at once.
_STRETCH = 1 << 20
#: Cells in which elements are counted, to tell rare from common ones.
CELLS = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word, from powers of an odd number modulo 2**64: a word's sum is divided by the power of its place."""
    if not _powers:
        ones = np.full(_STRETCH + 1, _P)
        ones[0] = 1
        back = np.full(_STRETCH + 1, _P_INVERSE)
        back[0] = 1
        _powers.extend([np.cumprod(ones), np.cumprod(back)])
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + _STRETCH)
        if end < len(text):  # stop after white space, so that no word is cut; a longer word is hashed by itself
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) + 1
            if cut <= at:
                while end < len(text) and not _SPACE[text[end]]:
                    end += 1
                words = text[at:end].split()
                out.append(np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in words), "<u8"))
                at = end
                continue
            end = cut
        a = np.frombuffer(text, np.uint8, end - at, at)
        inside = np.concatenate([[False], ~_SPACE[a], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, _U), np.cumsum((a.astype(_U) + _U(1)) * _powers[0][: len(a)])])
        out.append(_mix((sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(_U)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, _U)


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text as sorted 64-bit hashes, and how often each occurs. A text of fewer words is one
    shingle; one without words has none."""
    w = _word_hashes(text.encode("utf-8", "replace"))
    n = len(w)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    size = min(n, words)
    h = np.zeros(n - size + 1, _U)
    for i in range(size):
        h = h * _A + w[i : n - size + 1 + i]
    return np.unique(_mix(h + _U(size)), return_counts=True)


def signature(elements: np.ndarray, weights: np.ndarray | None, k: int, seed: int = 1) -> np.ndarray:
    """k coordinates, each the hash of the dart of least rank that hits it. weights None: all 1."""
    total = float(len(elements)) if weights is None else float(weights.sum())
    if not len(elements) or total <= 0:
        return np.zeros(0, _U)
    best, sign, missing = np.full(k, np.inf), np.zeros(k, _U), k
    # Cells of area 1: each element's weight is cut at whole numbers, ranks too. Ranks below `top` hit all with good chance.
    if weights is None:
        cells, cell_of, floor = _mix(elements + _U(seed)), None, None
    else:
        high = np.ceil(weights).astype(np.int64)
        cell_of = np.repeat(np.arange(len(elements)), high)
        floor = np.arange(high.sum()) - np.repeat(np.cumsum(high) - high, high)
        cells = _mix(_mix(elements + _U(seed))[cell_of] + floor.astype(_U) * _A)
        floor, cell_of = floor.astype(float), weights[cell_of]
    low, top = 0, max(1, math.ceil(k * (math.log(k) + 3) / total))
    while missing:
        ranks = np.arange(low, top, dtype=_U)
        own = (cells if top - low == 1 and low == 0 else _mix(cells[None, :] + ranks[:, None] * _P).ravel()) if top > low else cells
        many = np.searchsorted(_POISSON, (own >> _U(11)).astype(float) * 2.0**-53)
        at = np.repeat(np.arange(len(own)), many)
        dart = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        x = _mix(own[at] + (dart + 1).astype(_U) * _GOLD)
        y = _mix(x + _U(1))
        rank = at // len(cells) + low + (x & _U(0xFFFFFFFF)).astype(float) * 2.0**-32
        if cell_of is not None:
            cell = at % len(cells)
            hit = floor[cell] + (y & _U(0xFFFFFFFF)).astype(float) * 2.0**-32 < cell_of[cell]
            x, y, rank = x[hit], y[hit], rank[hit]
        place = ((y >> _U(32)) * _U(k)) >> _U(32)
        order = np.argsort(-rank, kind="stable")  # the least rank is written last
        place, x, rank = place[order].astype(np.int64), x[order], rank[order]
        new = np.isinf(best)
        b, s = np.full(k, np.inf), np.zeros(k, _U)
        b[place], s[place] = rank, x
        take = new & np.isfinite(b)  # ranks of later slabs are higher
        best[take], sign[take] = b[take], s[take]
        missing = int(np.isinf(best).sum())
        low, top = top, 2 * top
    return sign


def bands(sign: np.ndarray, rows: int, count: int) -> np.ndarray:
    """One number for each band of a signature."""
    h = np.arange(1, count + 1, dtype=_U)
    for column in sign.reshape(count, rows).T:
        h = _mix(h * _A + column)
    return h


def _components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node of edges (a, b), by large-star and small-star."""
    edges = freeze(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # Each node's neighbours, or only the smaller ones, are hung onto the least of them.
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
        least = freeze(least, "least")
        total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        hung = lookup(both, least, "u", "n", total, "inner")
        if large:
            made = hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            made = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return freeze(made.filter("u <> v").distinct(), "star")

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(edges)
    while True:
        edges = star(star(edges, True), False)
        before, now = now, state(edges)
        if before == now:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_classes(df: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, rows: int = ROWS, count: int = BANDS, counted: bool = False, keep: list[str] | None = None) -> DataFrame:
    """doc_id, class_id, class_size, kept and any columns to keep (but those with these names), for every row.

    Two rows are linked if their texts are equal, or if their shingles' Jaccard similarity is at least `similarity`; with
    `counted`, shingles weigh as often as they occur. A class is a connected component, class_id its least doc_id,
    and kept is true for one row of it: that of class_id, of several the first in the input. A null text is alike to none, so its class is itself; texts without words are alike only if they are equal. A class of
    null ids has a null class_id; rows of one doc_id may be in several classes; equal rows stay as many rows; an empty
    table gives an empty one. Equal texts are one node from the start, so copies are never paired; within a band each node
    is compared with one other, and then only pairs that are still in different classes and that a prefix filter, which
    loses none, leaves (`_across`).
    """
    keep = [c for c in (keep or []) if c.lower() not in ("doc_id", "class_id", "class_size", "kept")]
    df, back = shielded(df, "copies", "keeper")
    keep = [{c: n for n, c in back.items()}.get(c, c) for c in keep]
    sent = ["doc_id", "__uid", *keep]
    own = df.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("__uid"), *keep, *([] if "text" in keep else [F.col("text").cast("string").alias("text")]))
    at = own.columns.index("text")

    def sketch(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            keys, sizes, made = [], [], []
            for t in batch.column(at).to_pylist():
                elements, weights = shingles(t or "", words)
                weights = weights.astype(float) if counted else None
                keys.append(None if t is None else hashlib.md5(t.encode("utf-8", "replace")).digest())
                sizes.append(len(elements) if weights is None else int(weights.sum()))
                made.append(bands(signature(elements, weights, rows * count), rows, count).view(np.int64) if len(elements) else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int32)
            values = np.concatenate(made) if made else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            columns = [*batch.columns[: len(sent)], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=[*sent, "__key", "__n", "__bands"])

    schema = ", ".join(["doc_id long, __uid long", *(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "__key binary, __n long, __bands array<long>"])
    docs = freeze(own.mapInArrow(sketch, schema), "sketches")
    with collecting() as made:
        by_key = _classes(df, docs, similarity, words, counted)
        shared = by_key.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    discard(df.sparkSession, made, keep=(by_key,))
    out = lookup(docs.drop("__n", "__bands"), by_key, "__key", "copies", max(1, shared))
    alone = F.col("class_size").isNull()
    keeps = (alone | (F.col("keeper") == F.col("__uid"))).alias("kept")
    return out.select("doc_id", *keep, F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), keeps).withColumnsRenamed(back)


def _classes(df: DataFrame, docs: DataFrame, similarity: float, words: int, counted: bool) -> DataFrame:
    """Of each text that isn't alone in its class: __key, class_id, class_size, keeper (the row that stays) and copies."""
    nodes = docs.filter("__key is not null").groupBy("__key").agg(F.min("doc_id").alias("doc"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__uid")).alias("first"), F.count("*").alias("copies"), F.max(F.struct("__n", "__bands")).alias("s"))
    nodes = freeze(nodes.select("__key", "doc", "first", "copies", F.col("s.__n").alias("n"), F.col("s.__bands").alias("bands"), F.monotonically_increasing_id().alias("node")), "nodes")
    placed = nodes.select("node", "n", F.explode("bands").alias("band"))
    buckets = placed.groupBy("band").agg(F.min("node").alias("rep"), F.count("*").alias("m")).filter("m > 1")
    buckets = freeze(buckets, "buckets")
    total = buckets.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    members = freeze(lookup(placed, buckets, "band", "m", total, "inner").select("node", "n", "band", "rep"), "members")
    first = freeze(members.filter("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct(), "first-pairs")
    sets = _sets(df, nodes, members.select("node").distinct(), words, counted)
    edges = freeze(_similar(first, sets, similarity, counted), "links")
    if total:
        # Buckets whose nodes aren't all in one class: there, pairs across classes that were not compared yet.
        known = _components(edges)
        labelled = freeze(members.join(known, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("rep"), "labelled")
        mixed = labelled.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
        open_ = freeze(labelled.join(mixed, "band", "left_semi").select("node", "root").distinct(), "open")
        sets = freeze(sets.join(open_, "node").select("node", "root", "set", "counts"), "open-sets")
        rest = _across(sets, similarity, counted).join(first, ["a", "b"], "left_anti")
        edges = freeze(edges.unionByName(_similar(freeze(rest, "rest"), sets, similarity, counted)), "all-links")
    roots = _components(edges)
    found = nodes.select("node", "__key", "doc", "first", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = freeze(found, "found")
    classes = found.groupBy("root").agg(F.min("doc").alias("class_id"), F.sum("copies").alias("class_size"), F.min("first").alias("first"), F.count("*").alias("nodes")).filter("class_size > 1")
    by_key = lookup(found.select("__key", "root", "copies"), freeze(classes, "classes"), "root", "nodes", max(1, found.count()), "inner")
    return freeze(by_key.select("__key", "class_id", "class_size", F.col("first.__uid").alias("keeper"), "copies"), "class-of-text")


def _sets(df: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int, counted: bool) -> DataFrame:
    """node and its sorted shingle hashes (set, and with `counted` how often each occurs), for the wanted nodes.

    A node's text is read from one of its rows, found by doc_id and hash together, so a text with many copies is not hot.
    """

    def each(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            made = [shingles(t, words) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([h.tobytes() for h, _ in made], pa.binary()), pa.array([(c if counted else c[:0]).tobytes() for _, c in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "set", "counts"])

    wanted = freeze(nodes.join(wanted, "node", "left_semi").select("node", F.coalesce("doc", F.lit(-(1 << 63))).alias("doc"), "__key"), "wanted")
    rows = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.col("text").cast("string").alias("__text"))
    rows = rows.withColumn("__key", F.unhex(F.md5(F.col("__text").cast("binary"))))
    small = wanted.limit(SAFE_ROWS + 1).count() <= SAFE_ROWS
    texts = rows.join(F.broadcast(wanted) if small else wanted, ["doc", "__key"]).select("node", "__text")
    return freeze(texts.mapInArrow(each, "node long, set binary, counts binary"), "sets").dropDuplicates(["node"])


def _tokens(elements: bytes, counts: bytes, counted: bool) -> np.ndarray:
    """A node's shingles as a set; with `counted` each occurrence is an element of its own, so that weights need no case."""
    h = np.frombuffer(elements, _U)
    if not counted:
        return h
    c = np.frombuffer(counts, np.int64)
    nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
    return _mix(np.repeat(h, c) + nth.astype(_U) * _A)


def prefixes(n: int, similarity: float) -> tuple[int, int]:
    """How many of the first elements of a set of n, in one order for all sets, hold the first common one of any pair that is
    similar enough: where the partner is no smaller, and where it is no larger."""
    least = lambda x: math.ceil(x - 1e-9)
    return n - least(2 * similarity / (1 + similarity) * n) + 1, n - least(similarity * n) + 1


def _across(sets: DataFrame, similarity: float, counted: bool) -> DataFrame:
    """Pairs (a, b), a > b, of nodes with different roots that may be similar enough; sets: node, root, set, counts.

    Exact: two sets that are similar enough have their first common element, in any order of the elements, among the first few
    of both (`prefixes`), and enough left behind it. The order takes rare elements first, so what many texts share (license
    lines, templates) comes behind the prefixes and makes no pairs. How rare an element is, is read from counts in CELLS cells;
    that decides only the work, never the result. Of a prefix element's nodes, those of its commonest class are not paired
    with each other.
    """

    def count(batches):
        import pyarrow as pa

        cells = np.zeros(CELLS, np.int64)
        for batch in sliced(batches):
            for s, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                cell, n = np.unique(_tokens(s, c, counted) & _U(CELLS - 1), return_counts=True)
                cells[cell.astype(np.int64)] += n
        some = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells[some])], names=["cell", "n"])

    table = np.zeros(CELLS, np.uint8)
    seen = sets.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table[seen.column("cell").to_numpy()] = np.minimum(255, 6 * np.log2(1 + seen.column("n").to_numpy()))

    def heads(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            token, place, many, short, size = [], [], [], [], []
            for s, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                t = _tokens(s, c, counted)
                own, partner = prefixes(len(t), similarity)
                token.append(t[np.lexsort((t, table[(t & _U(CELLS - 1)).astype(np.int64)]))[:partner]])
                place.append(np.arange(1, partner + 1))
                many.append(partner)
                short.append(own)
                size.append(len(t))
            at, place = np.repeat(np.arange(len(many)), many), np.concatenate(place)
            columns = [np.concatenate(token).view(np.int64), np.asarray(batch.column(0))[at], np.asarray(batch.column(1))[at], np.array(size)[at], place, place <= np.array(short)[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "root", "n", "place", "own"])

    rows = freeze(sets.mapInArrow(heads, "token long, node long, root long, n long, place long, own boolean"), "prefixes")
    classes = rows.groupBy("token", "root").agg(F.count("*").alias("n"), F.max("own").alias("own"))
    tokens = classes.groupBy("token").agg(F.sum("n").alias("m"), F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("classes"), F.max("own").alias("own"))
    tokens = freeze(tokens.filter("classes > 1 and own").select("token", "m", F.col("most.root").alias("most")), "tokens")
    total = tokens.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    rows = lookup(rows, tokens, "token", "m", total, "inner").withColumn("common", F.col("root") == F.col("most")).select("token", "node", "root", "n", "place", "own", "common")
    rows = freeze(rows, "shared-prefixes")
    # The smaller set's own prefix meets the other's; rows of the commonest class meet only those of others.
    small = rows.filter("own").select("token", F.col("common").alias("side"), F.col("node").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("place").alias("px"))
    large = rows.select("token", F.explode(F.when(F.col("common"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("side"), F.col("node").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("place").alias("py"))
    needed = F.ceil(similarity / (1 + similarity) * (F.col("nx") + F.col("ny")) - 1e-9)
    fits = (F.col("rx") != F.col("ry")) & (F.struct("nx", "x") < F.struct("ny", "y")) & (F.col("nx") >= similarity * F.col("ny") - 1e-9)
    fits &= 1 + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= needed
    return small.join(large, ["token", "side"]).filter(fits).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float, counted: bool) -> DataFrame:
    """Of the pairs (a, b), those whose sets are similar enough, compared exactly."""

    def each(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            a, b, *rest = (c.to_pylist() for c in batch.columns)
            keep = [_jaccard(*x, counted) >= similarity for x in zip(*rest)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    one, two = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"), F.col("counts").alias(f"counts_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b", "counts_a", "counts_b")
    return both.mapInArrow(each, "a long, b long")


def _jaccard(set_a: bytes, set_b: bytes, counts_a: bytes, counts_b: bytes, counted: bool) -> float:
    a, b = np.frombuffer(set_a, _U), np.frombuffer(set_b, _U)
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not counted:
        return len(common) / max(1, len(a) + len(b) - len(common))
    x, y = np.frombuffer(counts_a, np.int64), np.frombuffer(counts_b, np.int64)
    shared = np.minimum(x[i], y[j]).sum()
    return float(shared / max(1, x.sum() + y.sum() - shared))

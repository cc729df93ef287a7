"""Top-k where the query's own vec_id has many rows among the data."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.llm import topk


def brute(data, asked, k):
    out = []
    for i, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in data if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_many_own_rows_cost_no_neighbour(spark):
    rng = random.Random(6)
    point = lambda: [rng.randint(-9, 9) for _ in range(4)]
    data = [(i, point()) for i in range(1, 120)] + [(0, [9, 9, 9, 9])] * 9 + [(200, [9, 9, 9, 8])] * 40 + [(50, point()) for _ in range(7)]
    df = spark.createDataFrame(data, "vec_id long, v array<long>")
    asked = {}
    for i, v in sorted(d for d in data if d[0] % 50 == 0):
        asked.setdefault(i, v)
    got = topk.top_k(df.filter("vec_id % 50 = 0"), df, 5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute(data, asked, 5)


def test_many_own_rows_beyond_doubles(spark):
    big = 10**9 + 7
    data = [(0, [big, 1])] * 4 + [(i, [big - i, i]) for i in range(1, 9)]
    df = spark.createDataFrame(data, "vec_id long, v array<long>")
    got = topk.top_k(df.filter("vec_id = 0"), df, 3)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute(data, {0: [big, 1]}, 3)


def test_rows_are_asked_one_by_one(spark):
    """Rows of one vec_id ask each for themselves and are candidates of each other; groups of many blocks and chunks."""
    rng = random.Random(8)
    data = [(i % 70, [rng.randint(-9, 9) for _ in range(3)]) for i in range(200)] + [(50, [1, 1, 1])] * 3 + [(None, [1]), (0, None)]
    got = topk.top_k_of_rows(spark.createDataFrame(data, "vec_id long, v array<long>"), F.col("vec_id") % 50 == 0, 4)
    whole = [d for d in data if None not in d]
    want = []
    for n, (i, v) in enumerate(whole):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(whole) if m != n)[:4]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == sorted(want)
    assert topk.top_k_of_rows(spark.createDataFrame([], "vec_id long, v array<long>"), F.lit(True), 4).count() == 0


@pytest.mark.parametrize("block,chunk", [(7, 3), (40, 1000)])
def test_near_groups_answer_near_queries(spark, monkeypatch, block, chunk):
    """Far clusters: a query goes to few of the blocks, and a group larger than a block is cut."""
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "CHUNK", chunk)
    asked = {}
    plain = topk.freeze
    monkeypatch.setattr(topk, "freeze", lambda df, name: asked.setdefault(name, plain(df, name)))
    rng = random.Random(2)
    data = [(i, [1000 * (i % 6 == d) + rng.randint(0, 9) for d in range(6)]) for i in range(300)]
    got = topk.top_k_of_rows(spark.createDataFrame(data, "vec_id long, v array<long>"), F.col("vec_id") % 50 == 0, 5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute(data, {i: v for i, v in data if i % 50 == 0}, 5)
    wanted = asked["wanted-groups"].count()
    assert all(sum(b.bit_count() for b in r.cells) < wanted for r in asked["asked"].collect())

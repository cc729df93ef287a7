"""Sharding and toxicity features against plain versions, and op1's base columns and op2's sizes against SQL."""

import random
import re
import struct
import unicodedata

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import queries, sharding, toxicity

SMALL = "/root/testdata/sf0.001"


def spark_hash(uid: int, seed: int) -> int:
    h = xxhash.xxh64_intdigest(struct.pack("<q", uid), seed=42)
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=h)
    return h - (1 << 64) if h >> 63 else h


def brute_shuffle(uids, shards, seed, piece):
    """{uid: (shard, slot)}: the matrix, one permutation in each partition, one in each shard."""
    parts = {}
    for u in uids:
        parts.setdefault(u >> 33, []).append(u)
    order = sorted(parts)
    sent = sharding.matrix([len(parts[p]) for p in order], shards, seed)
    shard = {}
    for p, row in zip(order, sent):
        own = sorted(parts[p], key=lambda u: (spark_hash(u, seed), u))
        for u, s in zip(own, np.repeat(np.arange(shards), row)):
            shard[u] = int(s)
    pieces = max(1, -(-len(uids) // (shards * piece)))
    out = {}
    for s in range(shards):
        own = sorted((u for u in uids if shard[u] == s), key=lambda u: (spark_hash(u, seed + 1) % pieces, spark_hash(u, seed + 2), u))
        out |= {u: (s, i) for i, u in enumerate(own)}
    return out


@pytest.mark.parametrize("rows,parts,shards,piece", [(500, 4, 7, 20), (333, 3, 16, 1000), (5, 2, 8, 1)])
def test_sharding_is_the_plain_one(spark, rows, parts, shards, piece):
    df = spark.range(0, rows, 1, parts).withColumn("uid", F.monotonically_increasing_id())
    got = {r.uid: (r.shard, r.slot) for r in sharding.shuffle(df, shards, seed=5, piece=piece).collect()}
    assert got == brute_shuffle(sorted(got), shards, 5, piece)


def test_sharding_sizes_are_those_of_sql(spark):
    got = sorted((r.doc_id, r["size"], r.text_crc32) for r in queries.op2_sharding(spark, SMALL).collect())
    import zlib

    rows = duckdb.sql(f"select doc_id, coalesce(text, '') from '{SMALL}/documents.parquet'").fetchall()
    assert got == sorted((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in rows)
    slots = duckdb.sql(f"select count(*) // 16, (count(*) + 15) // 16 from '{SMALL}/documents.parquet'").fetchall()[0]
    by = {}
    for r in queries.op2_sharding(spark, SMALL).collect():
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) and len(s) in slots for s in by.values()) and len(by) == 16


BASE = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
g as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from w where len(w) >= 3),
n as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from g),
r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from n where n > 1) group by doc_id),
l as (select doc_id, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
b as (select w.doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from w left join r using (doc_id) left join l using (doc_id))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b
"""


def test_base_columns_are_those_of_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = con.sql(f"select {', '.join(columns)} from ({BASE})").fetchall()
    got = queries.op1_quality(spark, SMALL)
    assert got.filter("base_failed and kept").count() == 0
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want)


def plain_features(text, learned):
    """The features by splitting the text, without an automaton."""
    low, b = text.lower(), text.encode()
    n = len(b.split())
    w = max(n, 1)
    words = {t for t in learned if not t.endswith("*")}
    starts = {t[:-1] for t in learned if t.endswith("*")}
    hits, near = [0, 0, 0], 0
    for term in {*toxicity.COMMON, *words, *starts}:
        at = low.find(term)
        while at >= 0:
            end = at + len(term)
            begins = at == 0 or not low[at - 1].isalpha()
            whole = end == len(low) or not low[end].isalpha()
            mine = [begins and whole and term in toxicity.COMMON, begins and whole and term in words, begins and term in starts]
            hits = [a + m for a, m in zip(hits, mine)]
            near += any(mine) and toxicity._SECOND.search(low, max(0, at - 40), min(len(low), end - 1 + 40)) is not None
            at = low.find(term, at + 1)
    letters = re.findall("[A-Za-z]", text)
    return {
        "common": hits[0] / w, "words": hits[1] / w, "starts": hits[2] / w, "near_you": near / max(sum(hits), 1), "log_common": np.log1p(hits[0]), "log_words": np.log1p(hits[1]), "log_starts": np.log1p(hits[2]),
        "capitals": sum(c.isupper() for c in letters) / max(len(letters), 1), "exclaims": text.count("!") / w, "asks": text.count("?") / w, "length": np.log1p(n),
        "marks": sum(c.isascii() and unicodedata.category(c)[0] in "PS" and c not in "!?" for c in text) / w,
    }


WORDS = ["you", "idiot", "Idiots", "moron", "zorb", "zorbient", "ZORBA", "azorb", "clown.", "tu", "é", "idioté", "\n", "!!", "?", "(a)", "stone", "river", "trash-can"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=40).map(" ".join))
def test_features_are_the_plain_ones(text):
    learned = ["zorb*", "zorbient", "river", "moro*"]
    got = dict(zip(toxicity.FEATURES, toxicity.Lexicon(learned).features(text)))
    for name, want in plain_features(text, learned).items():
        assert abs(got[name] - want) < 1e-9, (name, text)


def test_hidden_words_are_counted():
    found = toxicity.Lexicon([]).features("an 1d1ot and m0ron, an i.d.i.o.t too, b2b")
    got = dict(zip(toxicity.FEATURES, found))
    assert abs(got["hidden_hits"] - np.log1p(3)) < 1e-9 and got["hidden"] * 8 == 3


def test_features_of_a_very_long_text():
    rng = random.Random(1)
    text = " ".join(rng.choice(WORDS) for _ in range(60_000))
    got = dict(zip(toxicity.FEATURES, toxicity.Lexicon(["zorb*"]).features(text)))
    for name, want in plain_features(text, ["zorb*"]).items():
        assert abs(got[name] - want) < 1e-9, name

"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import bpe, chat, dartminhash, gbt, linededup, mixing, quality, sharding, topk, toxicity, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df, *by):
    return sorted(map(tuple, df.select(*by).collect() if by else df.collect()), key=str)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 10: BPE


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


ENCODING = tiktoken_encoding()
CODEC = bpe.codec(RANKS, PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'asx\u0085\x1c½٣é")), max_size=60))
def test_bpe_is_what_tiktoken_gives(text):
    ids = CODEC.encode(text)
    assert ids == ENCODING.encode_ordinary(text)
    assert CODEC.decode(b"".join(i.to_bytes(4, "little") for i in ids)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 30000, " " * 20000 + "x", "ab" * 15000, "<|endoftext|>", "", "word " * 200000])
def test_bpe_of_long_and_special_texts(text):
    assert CODEC.encode(text) == ENCODING.encode_ordinary(text)


def test_bpe_query(spark):
    texts = [None, "", "some words", "some words", "Ünïcode 🙂 and 'll"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r for r in bpe.round_trip(df, RANKS, PATTERN, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        ids = ENCODING.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.tokenize(df, RANKS, PATTERN, ["doc_id"]).filter("doc_id = 2").first().ids == ENCODING.encode_ordinary("some words")
    assert bpe.round_trip(df.limit(0), RANKS, PATTERN, ["doc_id"]).count() == 0


# 1 and 6: boosted trees


def test_trees_follow_their_constraints():
    rng = np.random.default_rng(3)
    x = rng.random((800, 3))
    y = ((x[:, 0] + 0.3 * rng.random(800) > 0.6) ^ (x[:, 1] > 0.9)).astype(float)
    model = gbt.fit(x, y, {0: 1, 1: -1})
    assert ((model.probability(x) >= 0.5) == y).mean() > 0.85
    grid = np.linspace(0, 1, 50)
    for _ in range(20):
        base = np.tile(rng.random(3), (50, 1))
        for f, sign in ((0, 1), (1, -1)):
            line = base.copy()
            line[:, f] = grid
            assert (sign * np.diff(model.margin(line)) >= -1e-12).all()


def test_flat_trees_walk_as_single_rows_do():
    rng = np.random.default_rng(5)
    x, y = rng.random((300, 4)), (rng.random(300) > 0.5).astype(float)
    m = gbt.fit(x, y, trees=7)
    for row, got in zip(x[:40], m.margin(x[:40])):
        total = m.base
        for node in m.roots:
            while m.left[node] != node:
                node = m.left[node] if row[m.feature[node]] <= m.threshold[node] else m.right[node]
            total += m.value[node]
        assert abs(total - got) < 1e-9


def test_trees_without_both_labels():
    assert gbt.fit(np.zeros((0, 2)), np.zeros(0)).probability(np.zeros((3, 2))).tolist() == [0.5] * 3
    assert gbt.fit(np.zeros((5, 2)), np.ones(5)).probability(np.zeros((1, 2)))[0] > 0.9


def test_isotonic_is_monotone_and_calibrated():
    rng = np.random.default_rng(1)
    m = rng.normal(size=2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-3 * m))).astype(float)
    f = gbt.isotonic(m, y)
    got = f(np.sort(m))
    assert (np.diff(got) >= 0).all() and abs(f(m).mean() - y.mean()) < 0.02
    assert gbt.isotonic(m, np.zeros(2000))(np.array([0.0]))[0] == 0.5


def base_statistics(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab#*é \n\t \u0085"), max_size=60))
def test_quality_statistics(text):
    assert quality.statistics(text)[0] == base_statistics(text)


def test_quality_query(spark):
    good = [(i, " ".join(f"word{i}x{j}" for j in range(80)) + ".", "en", "s", 1) for i in range(60)]
    junk = [(100 + i, "\n".join(f"{w}%%% {w}!!" for w in [f"a{i}"] * 40 + [f"b{j}" for j in range(60)]), "en", "s", 1) for i in range(60)]
    odd = [(None, None, None, None, None), (200, None, None, None, None), (201, "", None, None, None), (202, "a b c " * 60, None, None, None), (0, good[0][1], "en", "s", 1)]
    docs = spark.createDataFrame(good + junk + odd, DOCS).withColumn("kept", F.lit(1)).withColumn("y", F.lit(1)).withColumn("draw", F.lit(1))
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = [r for r in quality.judge(docs, model, ["doc_id"]).collect()]
    assert len(got) == len(good + junk + odd)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[i].kept for i in range(60)) and not any(by[100 + i].kept for i in range(60))
    assert by[202].base_failed and by[200].n_words == 0 and by[201].base_failed
    assert quality.judge(docs.limit(0), model, ["doc_id"]).count() == 0
    assert quality.train(docs, labels.limit(0)).probability(np.zeros((1, len(quality.FEATURES)))).tolist() == [0.5]


def test_toxicity_query(spark):
    rng = random.Random(2)
    clean = lambda n: " ".join(rng.choice("the of lower and river stone tree house words here".split()) + rng.choice("abcde") for _ in range(n))
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = clean(60) + (" you idiot worthless " if toxic and i % 8 else " zorbient zorbauf " if toxic else " ") + clean(20)
        docs.append((i, text, "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    extra = [(None, None, None, None, None), (500, None, None, None, None), (501, "", None, None, None), (502, clean(50) + " you 1d1ot, m0ron " * 3, None, None, None), (502, "x", None, None, None)]
    df = spark.createDataFrame(docs + extra, DOCS).withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, marks)
    got = toxicity.score(df, model, ["doc_id", "text"]).collect()
    assert len(got) == len(docs) + len(extra)
    score = {(r.doc_id, r.text): r.score for r in got}
    assert all(0 <= s <= 1 for s in score.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    wrong = sum((score[i, docs[i][1]] >= 0.5) != (i % 4 == 0) for i in held)
    assert wrong <= 0.05 * len(held)
    assert score[500, None] == score[501, ""] < 0.5
    assert any(t.startswith("zorb") for t in model.lexicon.learned)
    one, two = (model.lexicon.features(t) for t in ("you 1d1ot", "you i.d.i.o.t"))
    assert one[toxicity.FEATURES.index("hidden_hits")] > 0 and two[toxicity.FEATURES.index("hidden_hits")] > 0
    assert toxicity.score(df.limit(0), model, ["doc_id"]).count() == 0
    assert toxicity.train(df, marks.limit(0)).score(["you idiot"]).tolist() == [0.0]


# 2: sharding


def test_communication_matrix():
    m = sharding.matrix([5, 0, 17, 1, 10], 4, 1)
    assert m.sum(1).tolist() == [5, 0, 17, 1, 10] and max(m.sum(0)) - min(m.sum(0)) <= 1 and (m >= 0).all()
    assert sharding.matrix([], 3, 0).shape == (0, 3)


def test_hypergeometric_beyond_numpy():
    rng = np.random.default_rng(0)
    draws = [sharding.hypergeometric(rng, 3 * 10**10, 10**11, 1000) for _ in range(2000)]
    assert abs(np.mean(draws) - 1000 * 3 / 13) < 1.5 and abs(np.var(draws) - 1000 * 3 / 13 * 10 / 13) < 15
    assert sharding.hypergeometric(rng, 2 * 10**9, 0, 5) == 5


def test_sharding(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("doc_id"), F.lit("x").alias("shard"), F.when(F.col("id") > 5, F.col("id")).alias("v")).repartition(5)
    got = sharding.shuffle(df, 7, seed=3, piece=20).collect()
    sizes = Counter(r.shard for r in got)
    assert sorted(r.v for r in got if r.v is not None) == list(range(6, 1000)) and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert sharding.shuffle(df.limit(0), 3).count() == 0


def test_sharding_is_uniform(spark):
    """Each of 6 rows is as likely in each of 6 places."""
    counts = Counter()
    for seed in range(12):
        for r in sharding.shuffle(spark.range(6).repartition(2), 3, seed=seed).collect():
            counts[r.id, r.shard, r.slot] += 1
    assert len(counts) >= 26 and all(n <= 8 for n in counts.values())


# 3: WARC


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_warc_splits(spark, split):
    rng = random.Random(1)
    inner = warc.member(warc.record(9, "in", b"nested", None))
    html = ["<p>" + "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 4000))) for _ in range(20)]
    html += [html[3] + "z" * 1000] * 3 + ["y" * 999] * 2 + ["y" * 1000] * 2 + ["", None, "é" * 600, "é" * 600, inner.decode("latin1"), "\r\n\r\nWARC/1.1\r\n"]
    ids = [*range(len(html) - 1), None]
    pages = spark.createDataFrame(list(zip(ids, ["u"] * len(ids), html)), "page_id long, url string, html string").withColumn("sha1", F.lit("clash")).repartition(3)
    got = warc.archive(pages, split).collect()
    want = set()
    for i, h in zip(ids, html):
        p = (h or "").encode()
        same = [j for j, k in zip(ids, html) if (k or "").encode() == p and j is not None]
        old = len(p) >= 1000 and same and (i is None or i < max(same))
        want.add((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if old else "response", max(same) if old else None))
    assert len(got) == len(html) and set(map(tuple, got)) == want
    if split == 64:
        assert warc.archive(pages.limit(0)).count() == 0


def test_warc_member_hides_no_other():
    inner = b"".join(warc.member(warc.record(i, "in", b"nested", None)) for i in range(3))
    made = warc.member(warc.record(1, "out", inner * 3, None))
    assert [at for at in range(1, len(made)) if made.startswith(warc.MAGIC, at) and warc._header(made[at:])] == []


def test_warc_passes_over_rubbish():
    import pyarrow as pa

    good = warc.member(warc.record(1, "u", b"one" * 400, None))
    data = b"\x1f\x8b\x08rubbish" + good + b"\x1f\x8b\x08\x00more rubbish" + good + good[:50]
    found = list(warc.scan(pa.BufferReader(data), len(data), 0, len(data)))
    assert [warc.parse(c)[0]["warc-record-id"] for _, c in found][-1:] == ["<urn:page:1>"] or len(found) <= 2


# 4: line dedup


def brute_dedup(docs, least):
    """docs: (doc_id, text) in order; the remaining texts and how many lines went."""
    lines = [(d, i, (t or "").split("\n") if t is not None else []) for i, (d, t) in enumerate(docs)]
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, i))
    seen, gone = set(), {i: set() for i in range(len(docs))}
    for i in order:
        own = lines[i][2]
        for s in range(len(own)):
            n = 0
            for e in range(s, len(own)):
                n += len(words(own[e]))
                run = tuple(own[s : e + 1])
                if n >= least:
                    if run in seen:
                        gone[i] |= set(range(s, e + 1))
                    seen.add(run)
    return [(d, None if t is None else "\n".join(x for k, x in enumerate(lines[i][2]) if k not in gone[i]), len(lines[i][2]), len(gone[i])) for i, (d, t) in enumerate(docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 1, 2, 3])))
    docs = [(i, "\n".join(line() for _ in range(rng.randint(1, 9)))) for i in range(12)]
    docs += [(20, None), (21, ""), (22, docs[3][1]), (23, "a a\n" * 6 + "a a"), (24, "only here"), (25, docs[3][1]), (26, "b b b b b b b b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("uid", F.lit(2)).coalesce(1)
    got = linededup.dedup(df, min_words=5)
    assert rows(got, "doc_id", "text", "n_lines", "n_removed") == sorted(brute_dedup(docs, 5), key=str)


def test_line_dedup_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c"), (1, "a b c\nd")], "doc_id long, text string").coalesce(1)
    assert rows(linededup.dedup(df, min_words=3), "doc_id", "text") == [(1, ""), (1, "d"), (None, ""), (None, "a b c")]
    assert linededup.dedup(df.limit(0)).count() == 0


# 5: chat


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["user", "assistant", "system", "tool] x", None]), st.one_of(st.none(), st.text(st.sampled_from("<>/s[INST]OUROLEY\\exc \n"), max_size=30))), max_size=12))
def test_chat_round_trip(spark, turns):
    data = [(c, i, r, t) for i, (c, r, t) in enumerate(turns)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    made = chat.render(df)
    back = {r.conv_id: ([tuple(t) for t in r.back], r.learned) for r in made.select("conv_id", chat.read_back(F.col("formatted")).alias("back"), chat.learned_text(F.col("segments")).alias("learned")).collect()}
    for c in {d[0] for d in data}:
        own = [(r or "", t or "") for k, _, r, t in data if k == c]
        assert back[c] == (own, "".join(t for r, t in own if r == "assistant"))
    assert len(back) == len({d[0] for d in data})


def test_chat_machine_and_ties(spark):
    say = [(1, 0, "system"), (1, 1, "user"), (1, 2, "assistant"), (2, 0, "assistant"), (3, 0, "user"), (3, 1, "user"), (4, 0, None), (5, None, "user"), (5, 0, "assistant"), (None, 0, "user")]
    df = spark.createDataFrame([(c, t, r, "x") for c, t, r in say], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.valid for r in chat.render(df).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True, None: True}


# 7: top-k


def test_top_k(spark):
    rng = random.Random(4)
    data = [(i, [rng.randint(-9, 9) for _ in range(6)]) for i in range(300)] + [(400, [1, 2]), (401, None), (None, [1] * 6), (50, [0] * 6), (7, [5] * 6), (7, [5] * 6)]
    data += [(1000 + i, [3] * 6) for i in range(150)]
    df = spark.createDataFrame(data, "vec_id long, v array<long>").withColumn("cell", F.lit("clash"))
    got = rows(topk.top_k(df.filter("vec_id % 50 = 0"), df, 5))
    asked = {}
    for i, v in sorted((d for d in data if d[0] is not None and d[0] % 50 == 0 and d[1] is not None), key=lambda d: (d[0], d[1])):
        asked.setdefault(i, v)
    want = []
    for i, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in data if j is not None and w is not None and j != i)
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:5])]
    assert got == sorted(want, key=str)
    assert topk.top_k(df.limit(0), df, 5).count() == 0 and topk.top_k(df, df.limit(0), 5).count() == 0


def test_top_k_of_few_and_of_large(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "CHUNK", 2)
    big = 10**9 + 7
    df = spark.createDataFrame([(i * 50, [big * (-1) ** i, i]) for i in range(8)], "vec_id long, v array<long>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, df, 20).collect()}
    data = [(i * 50, [big * (-1) ** i, i]) for i in range(8)]
    for i, v in data:
        scored = sorted((-(v[0] * w[0] + v[1] * w[1]), j) for j, w in data if j != i)
        assert [got[i, n + 1] for n in range(7)] == [(j, -s) for s, j in scored]


def test_whole_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, -0.001]), (2, None), (3, [float("nan")]), (4, [None]), (5, [float("inf")]), (6, [])], "vec_id long, e array<float>")
    assert {r.vec_id: r.v for r in df.select("vec_id", topk.whole("e").alias("v")).collect()} == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


# 8: DartMinHash


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 1 << 63, 60).astype(np.uint64)])
    same = (dartminhash.signature(a, None, 2000) == dartminhash.signature(b, None, 2000)).mean()
    assert abs(same - 240 / 360) < 0.05
    w, v = rng.random(300) * 4 + 0.1, rng.random(300) * 4 + 0.1
    same = (dartminhash.signature(a, w, 2000) == dartminhash.signature(a, v, 2000)).mean()
    assert abs(same - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.05
    assert len(dartminhash.signature(a[:0], None, 8)) == 0 and len(set(dartminhash.signature(a[:1], None, 64))) > 32
    one = dartminhash.signature(a, np.ones(300), 500)
    assert (one == dartminhash.signature(a, np.full(300, 1.0), 500)).all()


def test_word_hashes_do_not_depend_on_stretches(monkeypatch):
    text = ("some words é\n\tof a text " * 50 + "x" * 300).encode()
    whole = dartminhash._word_hashes(text)
    assert len(whole) == len(text.split()) and len(set(whole.tolist())) == len(set(text.split()))
    monkeypatch.setattr(dartminhash, "_STRETCH", 64)
    cut = dartminhash._word_hashes(text)
    assert (cut[:-1] == whole[:-1]).all() and len(cut) == len(whole)


def jaccard_classes(docs, least):
    def shingles(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingles(t) for _, t in docs]
    for i, j in product(range(len(docs)), repeat=2):
        a, b = docs[i][1], docs[j][1]
        if i < j and a is not None and b is not None and (a == b or (sets[i] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]))):
            parent[find(i)] = find(j)
    out = []
    for i, (d, t) in enumerate(docs):
        own = [docs[j][0] for j in range(len(docs)) if find(j) == find(i)]
        ids = [x for x in own if x is not None]
        out.append((d, t, min(ids) if ids else None, len(own)))
    return sorted(out, key=str)


def near_documents():
    rng = random.Random(9)
    docs = []
    for g in range(12):
        w = [f"w{rng.randint(0, 500)}" for _ in range(rng.choice([3, 20, 60, 200]))]
        docs.append((len(docs), " ".join(w)))
        for _ in range(rng.randint(0, 6)):  # a chain: each differs a little from the last
            w = list(w)
            w[rng.randrange(len(w))] = "new"
            docs.append((len(docs), " ".join(w)))
    docs += [(90, None), (91, None), (92, ""), (93, ""), (94, " \n"), (95, "one"), (96, "one"), (97, "a b c"), (98, "a  b c"), (None, "one"), (95, "one"), (99, docs[2][1])]
    return docs


def test_near_classes(spark):
    docs = near_documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("class_id", F.lit("clash")).withColumn("node", F.lit(1)).repartition(3)
    got = dartminhash.near_classes(df, keep=["text"])
    assert rows(got, "doc_id", "text", "class_id", "class_size") == jaccard_classes(docs, 0.8)
    kept = got.filter("kept").collect()
    assert Counter(r.class_id for r in kept if r.class_size > 1) == Counter({r.class_id: 1 for r in got.collect() if r.class_size > 1})
    assert {r.text for r in got.filter("class_size = 1").collect()} <= {r.text for r in kept}
    assert dartminhash.near_classes(df.limit(0)).count() == 0


def test_near_classes_with_counts(spark):
    df = spark.createDataFrame([(1, "a b c d e " * 30), (2, "a b c d e " * 20), (3, "a b c d e " * 29 + "x")], "doc_id long, text string")
    assert rows(dartminhash.near_classes(df, counted=True), "doc_id", "class_id") == [(1, 1), (2, 2), (3, 1)]


# 9: mixing


def brute_mix(counts, weights):
    """Slots of each source by simulating earliest deadline first, frame by frame."""
    left, at, out, done = dict(counts), 0, {s: [] for s in counts}, dict.fromkeys(counts, 0)
    while any(left.values()):
        active = sorted(s for s in left if left[s])
        total, start, got = sum(weights[s] for s in active), at, dict.fromkeys(active, 0)
        while True:
            t = at - start
            ready = [s for s in active if got[s] * total < (t + 1) * weights[s]]
            s = min(ready, key=lambda s: (-(-(got[s] + 1) * total // weights[s]), s))
            if not left[s]:
                break
            out[s].append(at)
            at, got[s], left[s] = at + 1, got[s] + 1, left[s] - 1
            lag = [abs(got[x] - (at - start) * weights[x] / total) for x in active]
            assert max(lag) < 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 7)), min_size=1, max_size=6))
def test_pfair_phases(pairs):
    counts = {f"s{i}": n for i, (n, _) in enumerate(pairs)}
    weights = {f"s{i}": w for i, (_, w) in enumerate(pairs)}
    got = {s: [] for s in counts}
    for r in mixing.phases(counts, weights):
        for j in range(r["first"], r["end"]):
            i = j - r["first"]
            got[r["source"]].append(r["slot"] + i // r["w"] * r["total"] + r["places"][i % r["w"]])
    assert got == brute_mix(counts, weights)


def test_mixing(spark):
    data = [(i % 37, "x" if i % 3 else "y" if i % 5 else None if i % 2 else "z", "t") for i in range(200)]
    df = spark.createDataFrame(data, "doc_id long, source string, mix_slot string").repartition(4)
    weights = {"x": 3, "y": 2}
    got = mixing.schedule(df, weights, default=1, order=["doc_id"]).collect()
    assert sorted(r.mix_slot for r in got) == list(range(200))
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    counts = Counter("*" if s not in weights else s for _, s, _ in data)
    want = brute_mix(counts, {**weights, "*": 1})
    for s in counts:
        own = sorted((r.mix_slot, r.doc_id) for r in got if (r.source if r.source in weights else "*") == s)
        assert [x[0] for x in own] == want[s] and [x[1] for x in own] == sorted(x[1] for x in own)
    blocks = mixing.schedule(df, weights, block=7).collect()
    assert max(Counter(r.mix_slot for r in blocks).values()) == 7
    assert mixing.schedule(df.limit(0), weights).count() == 0
    assert [r.doc_id for r in mixing.mixed(df, weights, order=["doc_id"]).collect()] == [r.doc_id for r in sorted(got, key=lambda r: r.mix_slot)]


def test_ranks_file_is_read():
    assert len(bpe.read_ranks(RANKS)) == 50256 and base64.b64encode(b"a")

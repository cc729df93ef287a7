"""Very long texts, empty tables and columns with the names that operators use themselves."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import bpe, chat, dartminhash, linededup, mixing, quality, sharding, toxicity
from tests.llm.test_operators import PATTERN, RANKS, base_statistics, brute_dedup

OWN = ["__uid", "__part", "__rank", "__piece", "__gone", "__source", "__at", "__text", "__key", "__n", "own__uid", "__tie", "__run", "copies", "keeper", "rank", "node"]


def odd(spark, rows=30):
    df = spark.range(rows).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id") % 7).alias("text"), F.concat(F.lit("src"), F.col("id") % 3).alias("source"))
    return df.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in OWN})


def carried(got, *names):
    rows = got.select("doc_id", *[F.col(f"`{c}`") for c in names]).collect()
    assert len(rows) == 30 and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)


def test_columns_named_as_ours(spark):
    df = odd(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    carried(sharding.shuffle(df, 4), *OWN)
    carried(mixing.schedule(df, {"src0": 2}, order=["doc_id"]), *OWN)
    carried(mixing.mixed(df, {"src0": 2}, order=["__at", "doc_id"]), *OWN)
    carried(linededup.dedup(df), *OWN)
    carried(dartminhash.near_classes(df, keep=OWN), *OWN)
    carried(bpe.round_trip(df, RANKS, PATTERN, ["doc_id", *OWN]), *OWN)
    carried(quality.judge(df, quality.train(df, labels), ["doc_id", *OWN]), *OWN)
    carried(toxicity.score(df, toxicity.train(df, labels), ["doc_id", *OWN]), *OWN)
    named = df.withColumns({c: F.lit("clash") for c in ("class_id", "class_size", "kept")})
    got = dartminhash.near_classes(named, keep=["class_id", "kept", "text"])
    assert got.columns == ["doc_id", "text", "class_id", "class_size", "kept"] and got.filter("kept").count() == 7
    source = df.withColumnRenamed("source", "__src")
    assert mixing.schedule(source, {"src0": 2}, order=["doc_id"], source="__src").select(F.max("mix_slot")).first()[0] == 29


LONG = " ".join(f"word{i % 977}" for i in range(200_000))


def test_very_long_texts(spark):
    lines = "\n".join(f"line {i % 300} of a long text" for i in range(4000))
    docs = [(1, LONG), (2, lines), (3, lines + "\nend"), (4, "x" * 1_000_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.text for r in linededup.dedup(df).collect()}
    assert got == {d: t for d, t, _, _ in brute_dedup_of_long(docs)}
    assert [quality.statistics(t)[0] for _, t in docs] == [base_statistics(t) for _, t in docs]
    classes = {r.doc_id: r.class_id for r in dartminhash.near_classes(df).collect()}
    assert classes == {1: 1, 2: 2, 3: 2, 4: 4}


def brute_dedup_of_long(docs, least=50):
    """As brute_dedup, but of runs only the least ones, as these texts have too many others."""
    seen, out = set(), []
    for d, t in docs:
        own = t.split("\n")
        gone = set()
        for s in range(len(own)):
            n, e = 0, s
            while e < len(own) and n < least:
                n, e = n + len(own[e].split()), e + 1
            run = tuple(own[s:e])
            if n >= least:
                if run in seen:
                    gone |= set(range(s, e))
                seen.add(run)
        out.append((d, "\n".join(x for k, x in enumerate(own) if k not in gone), len(own), len(gone)))
    return out


def test_the_two_plain_versions_agree():
    rng = random.Random(5)
    docs = [(i, "\n".join(rng.choice(["a b c", "d e f", "g h i"]) for _ in range(12))) for i in range(6)]
    assert [r[1] for r in brute_dedup(docs, 6)] == [r[1] for r in brute_dedup_of_long(docs, 6)]


def test_chat_of_long_and_no_turns(spark):
    turns = [(1, 0, "user", LONG), (1, 1, "assistant", "[/INST] " * 100_000), (2, 0, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.render(df)).collect()}
    whole = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in turns if c == 1)
    assert got[1].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and got[1].loss_chars == 800_000
    assert got[2].n_turns == 1 and got[2].loss_chars == 0
    assert chat.digest(chat.render(df.limit(0))).count() == 0


def test_turns_of_no_conversation_gather_nowhere(spark):
    df = spark.createDataFrame([(None, i, "user", f"t{i}") for i in range(5)] + [(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = chat.digest(chat.render(df)).collect()
    assert sorted((r.conv_id is None, r.n_turns) for r in got) == [(False, 1)] + [(True, 1)] * 5


@settings(max_examples=3, deadline=None)
@given(st.data())
def test_many_chats_go_round(spark, data):
    """A few hundred conversations at a time, so that many random texts are tried in few jobs."""
    rng = random.Random(data.draw(st.integers(0, 1 << 30)))
    pieces = ["<", ">", "/", "s", "[", "]", "INST", "/INST", "OUT", "ROLE", "SYS", "\\", "e", "x", "c", " ", "\n", "</s>", "<s>", "[/INST]", "\\e", "\x1b", "é"]
    text = lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
    turns = [(c, t, rng.choice(["user", "assistant", "system", text()]), text()) for c in range(300) for t in range(rng.randint(1, 4))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat.render(df)
    back = {r.conv_id: ([tuple(t) for t in r.back], r.learned) for r in made.select("conv_id", chat.read_back(F.col("formatted")).alias("back"), chat.learned_text(F.col("segments")).alias("learned")).collect()}
    for c in range(300):
        own = [(r, t) for k, _, r, t in turns if k == c]
        assert back[c] == (own, "".join(t for r, t in own if r == "assistant"))


def test_ranks_are_sent(spark, monkeypatch, tmp_path):
    """A worker without the file reads the one that was sent."""
    import shutil

    own = str(tmp_path / "gone.tiktoken")
    shutil.copy(RANKS, own)
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    plan = bpe.round_trip(df, own, PATTERN, ["doc_id"])
    (tmp_path / "gone.tiktoken").unlink()
    assert plan.first().n_tokens == bpe.round_trip(df, RANKS, PATTERN, ["doc_id"]).first().n_tokens


@pytest.mark.parametrize("f", [lambda d: sharding.shuffle(d, 3), lambda d: mixing.schedule(d, {"a": 1}), lambda d: linededup.dedup(d), lambda d: dartminhash.near_classes(d)])
def test_empty_tables(spark, f):
    assert f(odd(spark).limit(0)).count() == 0

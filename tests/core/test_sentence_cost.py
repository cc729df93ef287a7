"""Sentences by one pattern for a whole text: the same as word by word, and in time that is in proportion."""

import random
import re
import time

from pyspark.sql import functions as F

from marginalia.functions import lexicon as L
from marginalia.functions import prose as P
from marginalia.operators import audit, rules
from marginalia.plans import sweeps
from marginalia.sources import scan as S
from marginalia.sources import sinks

WHITE = "\t\n\x0b\f\r \x85\xa0                　"
ATOMS = [
    *'.!?"\')]`', " ", "  ", "\n", "\xa0", "　", "\x1c", "A", "Z", "b", "v", "V", "1", "23", "3.", ".5", "e.g", "Etc", "i.e.", "K", "K", "İ", "no", "Go", "word", "é", "日本", "😀",
]


def word_by_word(text):
    words = [w for w in re.split(f"[{WHITE}]+", text) if w]
    out, piece, ended = [], [], 0
    for i, w in enumerate(words):
        piece.append(w)
        shorn = re.sub(r"[\"')\]`]+\Z", "", w)
        core = re.sub(r"[.!?]+\Z", "", shorn)
        number = re.fullmatch(r"[0-9.vV]+", core) and re.search("[0-9]", core)
        if shorn[-1:] in tuple(".!?") and not re.fullmatch("[A-Z]", core) and core.lower() not in L.ABBREVIATIONS and not number and not re.match("[a-z]", "".join(words[i + 1 : i + 2])):
            out.append(" ".join(piece))
            piece, ended = [], ended + 1
    return [*out, " ".join(piece)] if piece else out, ended


def test_pattern_is_word_by_word(spark):
    rng = random.Random(3)
    texts = ["", " ", *("".join(rng.choice(ATOMS) + " " * (rng.random() < 0.4) for _ in range(rng.randint(1, 30))) for _ in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.col("t")
    for r in df.select("t", P.split(t).alias("pieces"), P.sentences(t).alias("n"), P.ended(P.split(t)).alias("ended"), P.trim(t).alias("trim"), P.first_field(t).alias("first")).collect():
        pieces, ended = word_by_word(r.t)
        assert (r.pieces, r.n, r.ended) == (pieces, ended, ended), r.t
        assert r.trim == r.t.strip(WHITE) and r.first == next((w for w in re.split(f"[{WHITE}]+", r.t) if w), None)


def test_nothing_left_of_a_line(spark):
    rng = random.Random(4)
    atoms = [*L.MARKERS, *L.CLOSERS, " ", "\t", "　", "/", "'", '"', "r", "x"]
    lines = ["", *("".join(rng.choice(atoms) for _ in range(rng.randint(1, 5))) for _ in range(3000))]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    assert df.filter(P.bare(F.col("t")) != (P.strip(F.col("t")) == "")).count() == 0


def seconds(df):
    began = time.time()
    df.collect()
    return time.time() - began


def test_names_are_searched_for_one_new_word(spark):
    def of(n):
        df = spark.createDataFrame([(" ".join(f"name{i}" for i in range(n)), "One. " + " ".join(f"word{i}" for i in range(n)) + ".")], "d string, t string")
        names = P.spelled(F.col("d"))
        return df.select(P.hollow_sentences(P.split(F.col("t")), names).alias("v"))

    seconds(of(100))
    assert seconds(of(40_000)) < 3


def test_sentences_that_are_counted_are_not_sought_again(spark):
    counted = F.col("n")
    plan = spark.range(1).select(F.lit("One two.").alias("t"), F.lit(1).alias("n")).select(rules.echoes(F.col("t"), F.array(F.lit("two")), counted))
    assert "regexp_extract_all" not in plan._jdf.queryExecution().analyzed().toString()


def test_words_are_made_of_what_is_kept(spark, tmp_path):
    spark.createDataFrame([(1, "one\ntwo")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = sinks.harvest(audit.comments(S.scan(sweeps.sources(spark, str(tmp_path)))))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("row_number") :]
    assert "array_join" in plan and "array_join(filter(" not in below and "array_join(transform(raw" not in below

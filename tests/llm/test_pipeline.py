"""The pipeline, stage by stage, against plain versions of what each stage must do."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tests.llm.test_operators import brute_dedup, brute_mix, jaccard_classes  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(7)
    text = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    passage = "\n".join(text(20) for _ in range(3))
    docs = [text(80) + (" you idiot moron " if i % 5 == 0 else " ") + text(20) for i in range(100)]
    docs += [text(30) + "\n" + passage + "\n" + text(30) for _ in range(4)]
    docs += [docs[1], docs[2].replace("w", "w", 1) + " end", "", None, "a b"]
    return [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(docs)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    docs = corpus()
    spark.createDataFrame(docs, DOCS).coalesce(2).write.parquet(f"{out}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(100)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def taken(df):
    return sorted(map(tuple, df.select("doc_id", "text").collect()), key=str)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]

    def step(name, df):
        out = steps[name](spark, df, folder)
        if name != "bpe":
            assert sorted(out.columns) == sorted(docs.columns)
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    clean = step("toxicity", docs)
    assert taken(clean) == [r for r in taken(docs) if r[1] is None or "idiot" not in r[1]]
    lines = step("line_dedup", clean)
    whole = sorted(map(tuple, clean.select("doc_id", "text").collect()))
    want = [(d, t) for (d, t, _, gone), (_, before) in zip(brute_dedup(whole, 50), whole) if t is None or not gone or t.split()]
    assert taken(lines) == sorted(want, key=str)
    assert lines.filter("text is not null and n_chars <> char_length(text)").count() == 0
    near = step("near_dedup", lines)
    classes = jaccard_classes([tuple(r) for r in lines.select("doc_id", "text").collect()], 0.8)
    assert taken(near) == sorted([(d, t) for d, t, c, _ in classes if d == c], key=str)
    mixed = step("mixing", near)
    assert taken(mixed) == taken(near)
    encoded = step("bpe", mixed)
    assert encoded.count() == near.count()
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, encoded.collect()))


def test_mixed_order_is_the_schedule(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = [(r.doc_id, r.source) for r in corpus_pipeline.mix_sources(spark, docs, folder).collect()]
    counts = {s: n for s, n in docs.groupBy("source").count().collect()}
    want = brute_mix(counts, corpus_pipeline.WEIGHTS)
    for s, slots in want.items():
        own = [d for d, x in got if x == s]
        assert own == sorted(own) and [i for i, (_, x) in enumerate(got) if x == s] == slots


def test_extra_and_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(20)
    odd = docs.withColumns({c: F.lit("clash") for c in ("score", "kept", "class_id", "n_lines", "mix_slot", "uid", "node", "line")})
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, odd, folder).count() > 0, name
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, odd.limit(0), folder).count() == 0, name

"""Near-duplicates among many texts that share most of their words, but not enough of them."""

import random

import pytest

from marginalia.llm import dartminhash


def texts(m, seed=5):
    """m texts that share 170 to 181 of 200 words (similarity 0.6 to 0.79), and for every twentieth one that is a near copy of it."""
    rng = random.Random(seed)
    common = [f"t{i}" for i in range(200)]
    out = []
    for i in range(m):
        n = rng.randint(20, 30)
        at = rng.randint(0, 200 - n)
        out.append(common[:at] + [f"own{i}x{j}" for j in range(n)] + common[at + n :])
    near = [list(w) for w in out[::20]]
    for i, w in enumerate(near):
        w[100] = f"edit{i}"
    return [" ".join(w) for w in out + near]


def brute_classes(docs, least=0.8):
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in docs]
    of = {}
    sets = [frozenset(of.setdefault(x, len(of)) for x in s) for s in sets]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common >= least * (len(a) + len(sets[j]) - common):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(docs))]


@pytest.fixture
def counted(monkeypatch):
    """How many pairs are compared beyond those of each node with one other in its bands."""
    seen = []
    plain = dartminhash.freeze

    def freeze(df, name):
        out = plain(df, name)
        if name == "rest":
            seen.append(out.count())
        return out

    monkeypatch.setattr(dartminhash, "freeze", freeze)
    return seen


def test_boilerplate_is_compared_in_proportion(spark, counted):
    sizes = (500, 1000, 2000)
    for m in sizes:
        docs = texts(m)
        df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
        got = [c for _, c in sorted((r.doc_id, r.class_id) for r in dartminhash.near_classes(df).collect())]
        assert got == brute_classes(docs)
    assert all(n <= 30 * m for n, m in zip(counted, sizes))
    assert counted[2] <= 5 * counted[0] + 2000


@pytest.mark.parametrize("occurrences", [False, True])
def test_prefixes_lose_no_link(spark, occurrences):
    """Short and long texts of few words, so that most pairs have much in common."""
    rng = random.Random(3)
    docs = []
    for _ in range(60):
        base = [rng.choice("abcd") for _ in range(rng.randint(1, 40))]
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice("abcdxyz")
            docs.append(" ".join(w[: rng.randint(max(1, len(w) - 3), len(w))]))
    docs = list(dict.fromkeys(docs))
    made = [dartminhash.shingles(t) for t in docs]
    rows = [(i, i, bytearray(h.tobytes()), bytearray(c.tobytes() if occurrences else b"")) for i, (h, c) in enumerate(made)]
    sets = spark.createDataFrame(rows, "node long, root long, set binary, counts binary")
    for least in (0.5, 0.8, 1.0):
        got = {(r.a, r.b) for r in dartminhash._across(sets, least, occurrences).collect()}
        for i in range(len(docs)):
            for j in range(i):
                if dartminhash._jaccard(*(rows[k][2] for k in (i, j)), *(rows[k][3] for k in (i, j)), occurrences) >= least:
                    assert (i, j) in got, (docs[i], docs[j], least)

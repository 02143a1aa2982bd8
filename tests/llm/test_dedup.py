import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import dedup
from quillon.llm.graph import connected_components
from quillon.llm.shingles import MinHash, shingle_sets


def brute(docs):
    """component of each row by comparing all sets."""
    sets = []
    for _, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs)}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs = []
    for g in range(30):
        base = [word() for _ in range(rng.choice((3, 5, 8, 40, 150)))]
        for _ in range(rng.choice((1, 2, 5, 12))):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            docs.append(" ".join(w) if rng.random() < 0.5 else "\n ".join(w).upper())
    docs += ["", None, "   ", "É", "é", "one", "One", "x" * 50_000]
    rng.shuffle(docs)
    return list(enumerate(docs, 100))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, cluster int, component_id int")
    got = {r["doc_id"]: r for r in dedup.near_duplicates(df).collect()}
    want = brute(docs)
    assert len(got) == len(docs)
    for d, (n, c) in want.items():
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (n, c, c == d)


@pytest.mark.parametrize(("part", "few"), [(4, 16), (4, 0), (2, 1)])
def test_parts_of_large_clusters(spark, monkeypatch, part, few):
    """A cluster in many tiles has the same links as in one."""
    monkeypatch.setattr(dedup, "PART_ROWS", part)
    monkeypatch.setattr(dedup, "FEW_PARTS", few)
    monkeypatch.setattr(dedup, "STAR_ROWS", 2)
    monkeypatch.setattr(dedup, "BROADCAST_IDS", 0)
    docs = corpus(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in dedup.near_duplicates(df).collect()}
    assert got == {d: c for d, (_, c) in brute(docs).items()}


def test_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "lonely text of its own here"), (7, None)]
    got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (-1, 5, False), (5, 5, True), (5, 5, True), (7, 7, True)]
    assert dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_gates_keep_what_is_similar():
    rng = np.random.default_rng(0)
    for n, least in dedup.least_matches(160):
        assert (rng.binomial(n, 0.75, 200_000) < least).mean() < 1e-4 and least > 0.4 * n - 12
    sets, _ = shingle_sets([b"a b c d e f g", b"A B C D E F G", b""])
    sig = MinHash(8).of(sets)
    assert (sig[0] == sig[1]).all() and len(sets[2]) == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 99), (99, 98), (200, 200), (7, 3)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {98: 98, 99: 98, 100: 98}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def alike(n, seed=4):
    """Texts of which each two share about three shingles of ten, none linked."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(100)]
    return [(d, " ".join(common[:55] + [f"w{rng.random()}" for _ in range(60)])) for d in range(n)]


@pytest.mark.parametrize("few", [0, 16])
def test_texts_of_unlinked_documents_do_not_travel(spark, monkeypatch, few):
    """Where many are alike and none linked, hashes meet and no texts; linked ones among them are found."""
    monkeypatch.setattr(dedup, "PART_ROWS", 32)
    monkeypatch.setattr(dedup, "FEW_PARTS", few)
    asked = []
    found = dedup._found

    def counted(docs, rows, doc, text):
        rows = dedup.stash(dedup._tile(rows))
        asked.append(rows.count())
        return found(docs, rows, doc, text)

    monkeypatch.setattr(dedup, "_found", counted)
    docs = alike(300)
    docs += [(1000 + d, t + " more") for d, t in docs[:10]]
    got = {r["doc_id"]: r["component_id"] for r in dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: d - 1000 if d >= 1000 else d for d, _ in docs}
    assert sum(asked) < 300


def test_repeated_rows_bring_their_text_once(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text)] * 3000 + [(2, text + " x"), (1, text + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    reps = dedup.stash(dedup.classes(dedup.sketch(df)))
    assert reps.count() == 3
    got = dedup.near_duplicates(df)
    assert got.where("component_id != 1").count() == 0 and got.count() == 3002

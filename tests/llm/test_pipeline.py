"""The pipeline against plain Python that uses the same trained models."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import lang_id, mixing, toxicity
from quillon.runtime import table

from .test_dedup import brute

SF = "/root/testdata/sf0.001"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words8(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]


def test_stages(spark):
    docs = table(spark, SF, "documents")
    rows = docs.toPandas()
    columns = docs.columns
    steps, at = {}, docs
    from quillon.runtime import stash

    for name, stage in corpus_pipeline.STAGES:
        at = stash(stage(spark, at, SF))
        steps[name] = at.toPandas()
        assert list(at.columns[: len(columns)]) == columns and (name == "source_mix" or at.columns == columns)
    model = lang_id.train(docs)
    lang, score = model.predict(rows["text"].tolist())
    want = {d for d, g, s in zip(rows["doc_id"], lang, score, strict=True) if g != "und" and s >= corpus_pipeline.LEAST_LANGUAGE}
    assert set(steps["language_id"]["doc_id"]) == want
    before = steps["language_id"]
    net = toxicity.train(spark.createDataFrame(before), table(spark, SF, "labels"))
    s = net.scores(before["text"].tolist())
    assert set(steps["toxicity"]["doc_id"]) == set(before["doc_id"][s < 0.5])
    before = steps["toxicity"]
    found = brute(list(zip(before["doc_id"], before["text"], strict=True)))
    assert sorted(steps["minhash_dedup"]["doc_id"]) == sorted(d for d, (_, c) in found.items() if c == d)
    grams = set()
    for t in table(spark, SF, "benchmark").toPandas()["text"]:
        w = words8(t)
        grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(g) for g in grams}
    before = steps["minhash_dedup"]
    clean = {d for d, t in zip(before["doc_id"], before["text"], strict=True) if not any(tuple(words8(t)[i : i + n]) in grams for n in sizes for i in range(len(words8(t)) - n + 1))}
    assert set(steps["decontamination"]["doc_id"]) == clean
    mixed, before = steps["source_mix"], steps["decontamination"]
    size = lambda f: f["text"].map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    assert size(mixed).sum() == pytest.approx(1.5 * size(before).sum(), rel=0.15)
    assert mixed.groupby("doc_id").size().to_dict() == systematic(before.assign(size=size(before)))
    assert (mixed.sort_values(["doc_id", "copy"]).groupby("doc_id").cumcount() + 1 == mixed.sort_values(["doc_id", "copy"])["copy"]).all()
    # run() is these stages over the whole table
    whole = corpus_pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "copy", "text", "lang", "source", "n_chars"]
    assert sorted(map(repr, whole[key].itertuples(index=False))) == sorted(map(repr, mixed[key].itertuples(index=False)))


def systematic(docs):
    """doc_id: copies, by running sums of expected copies within each source and one offset; sizes above 0 only."""
    by = docs.groupby("source", dropna=False)["size"].sum()
    names = sorted((n for n in by.index if isinstance(n, str))) + [n for n in by.index if not isinstance(n, str)]
    weight = {n: (5.0, 2.0, 1.0)[i % 3] for i, n in enumerate(names)}
    target, free, left = {}, list(names), 1.5 * by.sum()
    while True:  # targets above twice a source's size stop there and the rest is shared again
        level = left / sum(weight[n] for n in free) if free else 0.0
        full = [n for n in free if weight[n] * level > 2 * by[n]]
        if not full:
            break
        for n in full:
            target[n] = 2.0 * by[n]
            left -= target[n]
            free.remove(n)
    target |= {n: weight[n] * level for n in free}
    out = {}
    for n in names:
        key = "1" if not isinstance(n, str) else "0" + n
        offset = int(hashlib.md5(f"mix-1|{key}".encode()).hexdigest()[:8], 16) / 2**32
        part = docs[docs["source"].isna() if key == "1" else docs["source"] == n]
        rows = []
        for d, z in zip(part["doc_id"], part["size"], strict=True):
            h = hashlib.md5(f"mix-1|{d}".encode()).hexdigest()
            rows.append((len(str(z)) * 100 + int(str(z)[:2]), int(h[:6], 16) % 4096, z, h, d))
        rate = target[n] / by[n] if by[n] else 0.0
        for k, (*_, z, _, d) in enumerate(sorted(r for r in rows if r[2]), 1):
            if c := math.floor(offset + rate * k) - math.floor(offset + rate * (k - 1)):
                out[d] = c
    return out


def test_names_do_not_meet(spark, tmp_path):
    """Columns with the names that stages use inside come out as they came in."""
    odd = ["row", "_th", "th", "_copies", "copies", "node", "_node", "score", "lang_pred", "rows", "d", "k", "doc_id_"]
    text = "the and of to in is that it was for on"
    docs = spark.createDataFrame([(i, " ".join(w + "xyz"[i - 4] for w in text.split()), "en", "s", 9, *range(3, 3 + len(odd))) for i in (4, 5, 6)] + [(1, text, "en", "s", 9, *range(3, 3 + len(odd))), (None, "Quite another text, that is in no other row", "en", None, 9, *range(3, 3 + len(odd))), (2, None, None, "s", 0, *range(3, 3 + len(odd)))], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in odd))
    spark.createDataFrame([(1, "no such words here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns + ["copy"] * (name == "source_mix")
        rows = got.collect()
        assert rows and all(r["k"] == 14 and r["_th"] == 4 and r["row"] == 3 for r in rows)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    kept = {name: {r["doc_id"] for r in stage(spark, docs, str(tmp_path)).collect()} for name, stage in corpus_pipeline.STAGES[:4]}
    assert kept["language_id"] == {1, 4, 5, 6, None} and kept["toxicity"] == kept["minhash_dedup"] == kept["decontamination"] == {1, 2, 4, 5, 6, None}


def test_repeated_rows_share_their_copies(spark):
    rows = [(7, "a b c d e", "en", "s", 9, 1)] * 100 + [(i, "a b c d e", "en", "t" if i % 2 else "s", 9, 1) for i in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copy long")
    got = corpus_pipeline.source_mix(spark, docs, "").toPandas()
    targets = {r["source"]: r["target"] for r in mixing.mix(docs.select("doc_id", "source", F.lit(5).cast("bigint").alias("size"))).collect()}
    for s, n in got.groupby("source").size().items():
        assert abs(5 * n - targets[s]) <= 5
    assert got.groupby("doc_id").size().drop(7).max() <= 2 and 100 <= (got["doc_id"] == 7).sum() <= 200


def test_repeated_and_null_rows(spark, tmp_path):
    text = "one two three four five six seven"
    rows = [(1, text, "en", "s", 9, "x"), (1, text, "en", "s", 9, "x"), (2, text.upper(), "en", "s", 9, "x"), (None, "quite another text that nobody has", "en", None, 9, "x"), (3, None, None, "s", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copy string")
    kept = corpus_pipeline.minhash_dedup(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 3]
    docs.select("doc_id").limit(0).withColumn("item_id", docs.select("doc_id").limit(0)["doc_id"])
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()] == [None, 3]
    empty = docs.limit(0)
    assert corpus_pipeline.minhash_dedup(spark, empty, "").count() == 0 and corpus_pipeline.decontamination(spark, empty, str(tmp_path)).count() == 0
    assert corpus_pipeline.source_mix(spark, empty.drop("copy"), "").count() == 0
    assert corpus_pipeline.source_mix(spark, docs.drop("copy"), "").count() > 0


def test_dedup_decides_on_rows(spark):
    words = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    a, b, c, d, e = (words(k) for k in "abcde")
    rows = [
        (1, a), (5, a), (5, b),  # only one of 5's texts is a copy
        (2, c), (None, c), (None, c + " more"),  # an equal and a near copy without an id
        (7, d), (7, d + " more"),  # one id, near but unequal texts
        (None, e), (None, e + " more"),
        (8, None), (8, None), (8, ""), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.minhash_dedup(spark, docs, "").collect()]
    assert sorted(i or 0 for i, _ in kept) == [0, 0, 1, 2, 5, 7, 8, 8]
    assert {(1, a), (2, c), (5, b), (8, None), (8, ""), (None, None)} <= set(kept)
    assert len([t for i, t in kept if i is None and t and t.startswith(e)]) == 1

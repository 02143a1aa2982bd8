"""Language identification: sparse multinomial logistic regression on TF-IDF weighted character n-grams.

Texts become lower-case letters with single spaces for everything else. Each position starts one gram of each
order, hashed into BUCKETS buckets; a gram's feature is its relative frequency times its inverse document
frequency, counted over all texts of the learning folds. Weights are trained online with follow-the-regularised-leader and an elastic net
(L1 keeps them sparse), and a temperature fitted on texts left out calibrates the probabilities. Scoring a
text is one table lookup for each position, so whole texts are cheap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import category

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.sampling import bounded_sample, fold, held_out, training_texts
from quillon.runtime import ship_package, table

#: The classifier is fitted on at most this many texts of each language.
MAX_PER_LANGUAGE = 400
BUCKETS, ORDERS = 1 << 16, (1, 2, 3)
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.05, 0.05, 2
SCALE = 8.0
UNKNOWN = "und"
FOLDS, HELD_FOLD = 4, 2
BLOCK_CHARS = 1 << 19
_GAP = np.full(3, 32, dtype=np.uint32)


def _fold_table(size: int = 0x20000) -> np.ndarray:
    """Lower-case letters for code points below ``size``; combining marks stay, since words are spelt with them; space for the rest."""
    out = np.full(size, 32, dtype=np.uint32)
    for i in range(size):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
        elif i >= 0x300 and category(c)[0] == "M":
            out[i] = i
    return out


#: Beyond the table, the planes of ideographs are letters and the rest is none.
_LETTERS_TO = 0x40000
_FOLD: list[np.ndarray] = []


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def letters(text: str) -> np.ndarray:
    """Code points of the folded text, with runs of spaces made one and three at either end."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    small = cp < len(_FOLD[0])
    cp = _FOLD[0][cp] if small.all() else np.where(small, _FOLD[0][np.where(small, cp, 32)], np.where(cp < _LETTERS_TO, cp, 32).astype(np.uint32))
    space = cp == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    return np.concatenate((_GAP, cp[keep], _GAP))


def grams(cp: np.ndarray) -> np.ndarray:
    """(orders, positions) buckets of the grams that start at each position but the last three; bucket 0 for none.

    A gram that is all space, or begins with two, is none, so neighbours divided by three spaces do not meet.
    """
    n = len(cp) - 3
    out = np.zeros((len(ORDERS), n), dtype=np.int32)
    h = np.zeros(n, dtype=np.uint32)
    blank = np.ones(n, dtype=bool)
    for j in range(max(ORDERS)):
        c = cp[j : n + j]
        h = (h + c + np.uint32(1)) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        blank &= c == 32
        if j + 1 in ORDERS:
            own = (h * np.uint32(0x85EBCA6B)) >> np.uint32(16)
            bad = blank | ((cp[:n] == 32) & (cp[1 : n + 1] == 32)) | (cp[:n] == 32) & (j == 0)
            out[ORDERS.index(j + 1)] = np.where(bad, 0, np.maximum(own & np.uint32(BUCKETS - 1), 1))
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages), idf and scale multiplied in
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> np.ndarray:
        """One row for each text; texts without letters have the bias alone."""
        out = np.tile(self.bias, (len(texts), 1))
        start = 0
        while start < len(texts):
            held, size, i = [], 0, start
            while i < len(texts) and (not held or size + len(texts[i]) <= BLOCK_CHARS):
                held.append(letters(texts[i]))
                size += len(texts[i])
                i += 1
            flat = np.concatenate([*held, _GAP])
            at = np.cumsum([0, *(len(h) for h in held[:-1])])
            # each text has six spaces more than letters, so no part is empty; sums run in pieces of bounded size
            got = np.zeros((len(held), len(self.languages)))
            count = np.zeros(len(held))
            g = grams(flat)
            for row in g:
                for a in range(0, len(row), BLOCK_CHARS):
                    part = row[a : a + BLOCK_CHARS]
                    first = np.searchsorted(at, a, "right") - 1
                    inside = at[(at > a) & (at < a + len(part))] - a
                    marks = np.concatenate(([0], inside)).astype(np.int64)
                    who = slice(first, first + len(marks))
                    got[who] += np.add.reduceat(self.weights[part], marks, axis=0, dtype=np.float64)
                    count[who] += np.add.reduceat((part > 0).astype(np.int64), marks)
            out[start:i] += got / np.maximum(count, 1)[:, None]
            start = i
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [t if t else "" for t in texts]
        z = self.logits(known) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        some = np.asarray([has_letter(t) for t in known], dtype=bool)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], np.where(some, p[np.arange(len(best)), best], 0.0)


def _features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their relative frequencies."""
    out = []
    for t in texts:
        g = grams(np.concatenate((letters(t), _GAP))).ravel()
        ids, n = np.unique(g[g > 0], return_counts=True)
        out.append((ids, n / max(1, n.sum())))
    return out


def _pieces(text: str, rng: np.random.Generator) -> list[str]:
    """A training text, and short runs from anywhere in it: short texts have to be told apart too."""
    out = [text]
    for size in (30, 120):
        if len(text) > size:
            a = int(rng.integers(0, len(text) - size))
            out.append(text[a : a + size])
    return out


def fit(texts: list[str], labels: list[str], seen: np.ndarray | None = None, total: int = 0, seed: int = 3) -> LanguageModel:
    """Trains on four texts of five and calibrates the temperature on the fifth.

    ``seen``: in how many of ``total`` texts each bucket occurs; without it, the given texts are counted.
    """
    languages = sorted(set(labels))
    if len(languages) < 2:
        return LanguageModel(languages or [UNKNOWN], np.zeros((BUCKETS, max(1, len(languages))), np.float32), np.zeros(max(1, len(languages))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    cut = [order[i] for i in range(len(order)) if i % 5]
    left = [order[i] for i in range(len(order)) if i % 5 == 0] or cut
    rows = [(p, languages.index(labels[i])) for i in cut for p in _pieces(texts[i], rng) if has_letter(p)]
    feats = _features([r[0] for r in rows])
    if seen is None:
        seen, total = count_grams(texts), len(texts)
    idf = np.log((1 + total) / (1 + np.minimum(seen, total))) + 1
    k = len(languages)
    z, n, w = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    zb, nb, bias = np.zeros(k), np.zeros(k), np.zeros(k)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, tf = feats[i]
            x = (SCALE * tf * idf[ids])[:, None]
            zi, ni = z[ids], n[ids]
            wi = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            bias = -zb / ((BETA + np.sqrt(nb)) / ALPHA)
            s = (wi * x).sum(axis=0) + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[rows[i][1]] -= 1
            g = x * p
            z[ids] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[ids] = ni + g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / ALPHA * bias
            nb += p * p
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    w[0] = 0
    model = LanguageModel(languages, (SCALE * idf[:, None] * w).astype(np.float32), bias)
    checks = [(p, languages.index(labels[i])) for i in left for p in _pieces(texts[i], rng) if has_letter(p)]
    if checks:
        s, y = model.logits([c[0] for c in checks]), np.asarray([c[1] for c in checks])
        model.temperature = min(np.geomspace(0.05, 20, 120), key=lambda t: _loss(s / t, y))
    return model


def _loss(s: np.ndarray, y: np.ndarray) -> float:
    s = s - s.max(axis=1, keepdims=True)
    return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())


def count_grams(texts: list[str]) -> np.ndarray:
    """In how many of the texts each bucket occurs."""
    seen = np.zeros(BUCKETS)
    for t in texts:
        here = np.zeros(BUCKETS, dtype=bool)
        here[grams(np.concatenate((letters(t), _GAP))).ravel()] = True
        seen += here
    seen[0] = 0
    return seen


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that a partition's texts have, and bucket 0 with how many texts there are."""
    seen, total = np.zeros(BUCKETS), 0
    for b in batches:
        texts = [t for t in b.column(0).to_pylist() if t]
        total += len(texts)
        seen += count_grams(texts)
    seen[0] = total
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(seen[some].astype(np.int64))], ["bucket", "n"])


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts of ``docs`` each bucket occurs, and how many texts there are; one row a bucket reaches the driver."""
    ship_package(docs.sparkSession)
    rows = docs.select(text).mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(BUCKETS)
    for r in rows:
        seen[r["bucket"]] = r["n"]
    total, seen[0] = int(seen[0]), 0
    return seen, total


def train(docs: DataFrame, most: int = MAX_PER_LANGUAGE) -> LanguageModel:
    """Fits on documents with a language outside the held-out fold: weights on a bounded sample, gram frequencies on all.

    An id with several languages or texts counts in each of its rows; repeated rows count once in the sample.
    """
    usable = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_FOLD)).select("doc_id", "lang", "text")
    picks, _ = bounded_sample(usable.select("doc_id", "lang"), "lang", most)
    rows = training_texts(usable, picks, most, "lang")
    return fit(rows["text"].tolist(), rows["label"].tolist(), *document_frequencies(usable))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added or replaced; null and letterless texts are ``und`` with score 0.

    Each row is judged alone, so repeated rows have equal results; a tie goes to the language that is first by code point.
    An empty table gives no rows, and a model without languages says ``und``.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            lang, score = own.predict([t if isinstance(t, str) else None for t in b])
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    got = docs.drop("lang_pred", "score").withColumn("_lang", F.pandas_udf(guess, "lang_pred string, score double")(F.col(text)))
    return got.withColumn("lang_pred", F.col("_lang.lang_pred")).withColumn("score", F.col("_lang.score")).drop("_lang")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_FOLD).alias("held_out"), "lang_pred", "score")

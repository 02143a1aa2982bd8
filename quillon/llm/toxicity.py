"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A text's words are cut into overlapping windows that cover all of it. A word's input is its embedding (one
shared by all words that training saw rarely) beside the mean of its character n-gram embeddings, so
unseen words with known parts count. Two gated recurrent layers read each window in both directions, attention pools
their states, and a text's score comes from its highest window through a calibrated logistic curve. Everything is
trained in numpy, on a bounded sample of whole texts; which windows of a toxic text are toxic is not labelled, so the first
epoch goes through all windows and each one after it through every text's most toxic window so far, the others of
toxic texts that are taken for toxic and those of clean texts that are not yet surely clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.sampling import held_out, labelled_texts
from quillon.llm.shingles import NON_WORD, blocks, word_spans
from quillon.runtime import ship_package, table

#: The network is fitted on at most this many labelled texts of each class.
MAX_PER_CLASS = 1200
WINDOW, STRIDE = 64, 48
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 16, 8
GRAM_BUCKETS, GRAM_SIZES, MIN_TEXTS = 4096, (3, 4), 4
EPOCHS, LEAST_STEPS, BATCH, RATE = 6, 600, 128, 0.01
#: Windows of clean texts with a logit below this have next to no gradient and wait.
EASY = -4.0
FOLDS, HELD_FOLD, THRESHOLD = 5, 0, 0.5
RUN_WINDOWS = 1024


#: White space and punctuation beyond ASCII, and runs of letters too long for a word (scripts without spaces, encoded data),
#: which are cut into overlapping pieces so that windows go over all of them.
_GAPS = re.compile(r"[\u0080-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb-\u00bf\u00d7\u00f7\u1680\u2000-\u206f\u2e00-\u2e7f\u3000-\u3004\u3007-\u3020\u3030\ufe30-\ufe6f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")
LONGEST, PIECE = 32, 16
_LONG = re.compile(rf"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]{{{LONGEST},}}")


def spaced(text: str | None) -> str | None:
    """The text with its words set apart by ASCII alone."""
    if not text:
        return text
    if not text.isascii():
        text = _GAPS.sub(" ", text)
    return _LONG.sub(lambda m: " ".join(m[0][i : i + PIECE] for i in range(0, len(m[0]) - PIECE // 2, PIECE // 2)), text)


class Words:
    """The distinct words of some texts: hashes and n-gram buckets, and the texts as runs of indices into them."""

    def __init__(self, docs: list[bytes]) -> None:
        buf, starts, ends, hashes, self.first = word_spans(docs, NON_WORD, latin=True)
        self.hashes, at, self.index = np.unique(hashes, return_index=True, return_inverse=True)
        self.index = self.index.astype(np.int32)
        a, size = starts[at], ends[at] - starts[at] + 2
        begin = np.concatenate(([0], np.cumsum(size)))
        n = int(begin[-1])
        # all distinct words in a row, with a marker before and after each
        place = np.arange(n, dtype=np.int32) - np.repeat((begin[:-1] - a + 1).astype(np.int32), size)
        chars = buf[np.clip(place, 0, len(buf) - 1)].astype(np.uint32)
        del place, buf
        chars[begin[:-1]] = 1
        chars[begin[1:] - 1] = 2
        left = np.repeat(begin[1:].astype(np.int32), size) - np.arange(n, dtype=np.int32)
        # for each size of n-gram: the buckets, and where each word's begin
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        for k in GRAM_SIZES:
            fits = np.flatnonzero(left >= k).astype(np.int32)
            h = np.zeros(len(fits), dtype=np.uint32)
            for j in range(k):
                h = (h ^ chars[fits + j]) * np.uint32(0x01000193) + np.uint32(k)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            at = np.concatenate(([0], np.cumsum(np.maximum(size - (k - 1), 0))))
            self.grams.append((((h >> np.uint32(16)) & np.uint32(GRAM_BUCKETS - 1)).astype(np.int32), at))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows, WINDOW) word indices, -1 beyond a text's end, and each window's text. A text without words has none."""
        rows, owner = [], []
        steps = np.arange(WINDOW)
        for i in range(len(self.first) - 1):
            a, b = int(self.first[i]), int(self.first[i + 1])
            n = b - a
            if not n:
                continue
            starts = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
            starts = np.minimum(starts, max(0, n - WINDOW))
            at = a + starts[:, None] + steps
            rows.append(np.where(at < b, self.index[np.minimum(at, b - 1)], -1).astype(np.int32))
            owner.append(np.full(len(starts), i))
        if not rows:
            return np.zeros((0, WINDOW), dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(rows), np.concatenate(owner)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters are float32 arrays; the two directions lie along the first axis."""

    def __init__(self, known: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.known = known  # sorted hashes of the words that have an embedding of their own
        dim, h = WORD_DIM + CHAR_DIM, HIDDEN
        put = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "word": put(len(known) + 1, WORD_DIM, scale=0.1),
            "char": put(GRAM_BUCKETS, CHAR_DIM, scale=0.3),
            "wx": put(2, dim, 3 * h, scale=dim**-0.5),
            "uh": put(2, h, 3 * h, scale=h**-0.5),
            "b": np.zeros((2, 1, 3 * h), np.float32),
            "wa": put(2 * h, ATTENTION, scale=(2 * h) ** -0.5),
            "ba": np.zeros(ATTENTION, np.float32),
            "va": put(ATTENTION, scale=ATTENTION**-0.5),
            "wo": put(2 * h, scale=(2 * h) ** -0.5),
            "bo": np.zeros(1, np.float32),
        }
        self.slope, self.offset, self.empty = 1.0, 0.0, -5.0

    def word_ids(self, words: Words) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, words.hashes), max(0, len(self.known) - 1))
        return np.where(self.known[at] == words.hashes, at + 1, 0) if len(self.known) else np.zeros(len(words.hashes), np.int64)

    def inputs(self, words: Words, pick: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Input vectors of the picked distinct words; and, to go back, the n-grams and how many each word has of each size."""
        total = np.zeros((len(pick), CHAR_DIM), np.float32)
        used, count = [], np.zeros(len(pick), np.int64)
        for grams, at in words.grams:
            size = at[pick + 1] - at[pick]
            begin = np.concatenate(([0], np.cumsum(size)))
            flat = grams[np.arange(begin[-1]) - np.repeat(begin[:-1] - at[pick], size)]
            full = np.flatnonzero(size)
            if len(full):
                total[full] += np.add.reduceat(self.p["char"][flat], begin[:-1][full], axis=0)
            used.append((flat, size))
            count += size
        some = np.maximum(count, 1)[:, None].astype(np.float32)
        return np.concatenate((self.p["word"][ids[pick]], total / some), axis=1), (used, some)

    def forward(self, gates: np.ndarray, rows: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows. ``gates``: (2, words, 3 * HIDDEN) input parts; ``rows``: indices into words, -1 for none."""
        n, h = len(rows), HIDDEN
        mask = rows >= 0
        safe = np.where(mask, rows, 0)
        state = np.zeros((2, n, h), np.float32)
        steps, states = [], np.empty((2, WINDOW, n, h), np.float32)
        ragged = not mask.all()
        for t in range(WINDOW):
            both = (t, WINDOW - 1 - t)
            x = np.stack((gates[0][safe[:, both[0]]], gates[1][safe[:, both[1]]]))
            u = state @ self.p["uh"]
            zr = _sigmoid(x[..., : 2 * h] + u[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            c = np.tanh(x[..., 2 * h :] + r * u[..., 2 * h :])
            new = c + z * (state - c)
            if ragged:
                m = np.stack((mask[:, both[0]], mask[:, both[1]]))[..., None]
                new = np.where(m, new, state)
            if keep:
                steps.append((state, zr, c, u[..., 2 * h :]))
            state = new
            states[0, both[0]], states[1, both[1]] = state[0], state[1]
        hs = np.concatenate((states[0], states[1]), axis=2)
        a = np.tanh(hs @ self.p["wa"] + self.p["ba"])
        s = np.where(mask.T, a @ self.p["va"], np.float32(-1e9))
        s = np.exp(s - s.max(axis=0))
        s /= s.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", s, hs)
        return pooled @ self.p["wo"] + self.p["bo"][0], {"steps": steps, "hs": hs, "a": a, "s": s, "pooled": pooled, "mask": mask, "safe": safe} if keep else {}

    def backward(self, grad: np.ndarray, kept: dict, gates: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters above the inputs, and of ``gates``."""
        h, g, p = HIDDEN, {}, self.p
        hs, a, s, mask, safe = kept["hs"], kept["a"], kept["s"], kept["mask"], kept["safe"]
        g["wo"], g["bo"] = kept["pooled"].T @ grad, grad.sum(keepdims=True)
        d_pool = grad[:, None] * p["wo"]
        d_hs = s[..., None] * d_pool
        d_s = np.einsum("tnh,nh->tn", hs, d_pool)
        d_s = s * (d_s - (s * d_s).sum(axis=0))
        g["va"] = np.einsum("tn,tna->a", d_s, a)
        d_a = d_s[..., None] * p["va"] * (1 - a * a)
        g["wa"], g["ba"] = np.einsum("tnh,tna->ha", hs, d_a), d_a.sum(axis=(0, 1))
        d_hs += d_a @ p["wa"].T
        d_hs = np.stack((d_hs[..., :h], d_hs[..., h:]))
        g["uh"], d_gates = np.zeros_like(p["uh"]), np.zeros_like(gates)
        d_in = np.empty((2, WINDOW, hs.shape[1], 3 * h), gates.dtype)
        d_state = np.zeros((2, hs.shape[1], h), np.float32)
        back = p["uh"].transpose(0, 2, 1)
        for t in range(WINDOW - 1, -1, -1):
            both = (t, WINDOW - 1 - t)
            state, zr, c, un = kept["steps"][t]
            z, r = zr[..., :h], zr[..., h:]
            m = np.stack((mask[:, both[0]], mask[:, both[1]]))[..., None]
            d_new = (d_state + np.stack((d_hs[0, both[0]], d_hs[1, both[1]]))) * m
            through = d_state * ~m
            d_c = d_new * (1 - z) * (1 - c * c)
            d_z = d_new * (state - c) * z * (1 - z)
            d_r = d_c * un * r * (1 - r)
            d_u = np.concatenate((d_z, d_r, d_c * r), axis=2)
            g["uh"] += state.transpose(0, 2, 1) @ d_u
            d_state = d_new * z + d_u @ back + through
            for k in (0, 1):
                np.concatenate((d_z[k], d_r[k], d_c[k]), axis=1, out=d_in[k, both[k]])
        # sums by word: places in the order of their words, then runs of equal ones
        word = safe.T.ravel()
        order = np.argsort(word, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(word[order]) > 0)))
        for k in (0, 1):
            d_gates[k, word[order][first]] = np.add.reduceat(d_in[k].reshape(len(word), 3 * h)[order], first, axis=0)
        return g, d_gates

    def logits(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The logits of all windows, and each window's text."""
        words = Words(docs)
        rows, owner = words.windows()
        if not len(rows):
            return np.zeros(0, np.float32), owner
        x, _ = self.inputs(words, np.arange(len(words.hashes)), self.word_ids(words))
        gates = x @ self.p["wx"] + self.p["b"]
        return np.concatenate([self.forward(gates, rows[i : i + RUN_WINDOWS])[0] for i in range(0, len(rows), RUN_WINDOWS)]), owner

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.empty)
        for start, docs in blocks([spaced(t) for t in texts]):
            z, owner = self.logits(docs)
            if len(z):
                best = np.full(len(docs), -np.inf)
                np.maximum.at(best, owner, z)
                some = np.isfinite(best)
                out[start : start + len(docs)][some] = best[some]
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.offset, -60, 60)))


def _known_words(words: Words) -> np.ndarray:
    """Hashes of the words in at least MIN_TEXTS texts."""
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    pairs = np.unique(owner * np.int64(len(words.hashes)) + words.index)
    return words.hashes[np.bincount(pairs % len(words.hashes), minlength=len(words.hashes)) >= MIN_TEXTS]


def fit(rows: pd.DataFrame, counts: dict[int, int], seed: int = 9) -> Network:
    """From (text, label) rows and the classes' counts in all labelled rows. With one class all texts are like it, and
    without labels all are clean."""
    rows = rows[rows["text"].notna() & rows["label"].isin([0, 1])]
    texts, y = rows["text"].tolist(), rows["label"].to_numpy(float)
    if len(set(y)) < 2:
        net = Network(np.zeros(0, np.uint64))
        net.slope = 0.0
        net.offset = 4.0 if 1.0 in y else -4.0
        return net
    fifth = rows.groupby("label").cumcount().to_numpy() % 5
    docs = [spaced(t).encode("utf-8", "surrogatepass") for t in texts]
    words = Words(docs)
    net = Network(_known_words(words))
    ids = net.word_ids(words)
    all_rows, owner = words.windows()
    rng = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    score = rng.random(len(all_rows)).astype(np.float32)
    share = 1 / np.bincount(owner, minlength=len(texts))[owner]
    epochs = EPOCHS
    epoch = 0
    while epoch < epochs:
        order = np.lexsort((-score if epoch else rng.random(len(score)), owner))
        first = np.concatenate(([True], np.diff(owner[order]) > 0))
        toxic = y[owner[order]] == 1
        take = (fifth[owner[order]] != 0) & (first | (epoch == 0) | (score[order] > np.where(toxic, 0.0, EASY)))
        chosen = rng.permutation(order[take])
        if not epoch:  # few texts are gone through more often
            epochs = max(EPOCHS, min(40, -(-LEAST_STEPS * BATCH // max(1, len(chosen)))))
        for i in range(0, len(chosen), BATCH):
            batch = chosen[i : i + BATCH]
            used, inverse = np.unique(all_rows[batch], return_inverse=True)
            shift = int(used[0] == -1)
            pick, local = used[shift:], inverse.reshape(len(batch), WINDOW) - shift
            own = np.where(rng.random(len(ids)) < 0.3, 0, ids)  # words unseen later have to be told by their characters
            x, (grams, some) = net.inputs(words, pick, own)
            gates = x @ net.p["wx"] + net.p["b"]
            z, kept = net.forward(gates, local, keep=True)
            target = y[owner[batch]]
            grad = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(batch)).astype(np.float32)
            if not epoch:  # any of a toxic text's windows may be the toxic one: together they count as one
                grad *= np.where(target == 1, share[batch], 1.0).astype(np.float32)
            g, d_gates = net.backward(grad, kept, gates)
            g["b"], g["wx"] = d_gates.sum(axis=1, keepdims=True), x.T @ d_gates
            d_x = (d_gates @ net.p["wx"].transpose(0, 2, 1)).sum(axis=0)
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], own[pick], d_x[:, :WORD_DIM])
            for flat, size in grams:
                np.add.at(g["char"], flat, np.repeat(d_x[:, WORD_DIM:] / some, size, axis=0))
            step += 1
            for k, v in net.p.items():
                m, s = moments[k]
                gk = g[k].reshape(v.shape) + np.float32(1e-5) * v
                m += 0.1 * (gk - m)
                s += 0.01 * (gk * gk - s)
                v -= np.float32(RATE * (1 - 0.9 * epoch / epochs)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + np.float32(1e-7))
        del gates, kept, x, d_gates, d_x
        for i in range(0, len(all_rows), RUN_WINDOWS):
            part_rows = all_rows[i : i + RUN_WINDOWS]
            used, inverse = np.unique(part_rows, return_inverse=True)
            shift = int(used[0] == -1)
            x, _ = net.inputs(words, used[shift:], ids)
            score[i : i + RUN_WINDOWS] = net.forward(x @ net.p["wx"] + net.p["b"], inverse.reshape(part_rows.shape) - shift)[0]
        epoch += 1
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, owner, score)
    ok = (fifth == 0) & np.isfinite(best)
    if len(set(y[ok])) == 2:
        _calibrate(net, best[ok], y[ok], counts)
    return net


def _calibrate(net: Network, x: np.ndarray, y: np.ndarray, counts: dict[int, int]) -> None:
    """A logistic curve over left-out texts, weighted to the classes' shares in all labelled rows.

    Targets are 0 and 1 and the ridge is small, so where the classes part, the curve's middle lies between the hardest
    texts of both and not between their means.
    """
    weight = np.asarray([counts.get(c, 1) / max(1, (y == c).sum()) for c in (0, 1)])[y.astype(int)]
    weight /= weight.sum()
    a, b = 0.5, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        g = np.asarray([(weight * (p - y) * x).sum() + 2e-3 * a, (weight * (p - y)).sum()])
        s = weight * p * (1 - p)
        h = np.asarray([[(s * x * x).sum() + 2e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        d /= max(1.0, 2 * np.abs(d).max())
        a, b = max(0.05, a - d[0]), b - d[1]
    net.slope, net.offset = float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_PER_CLASS) -> Network:
    """Fits on labelled documents outside the held-out fold. An id with both labels counts in both classes."""
    return fit(*labelled_texts(docs, labels, "toxic", most, FOLDS, HELD_FOLD))


def score_toxicity(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` with score added or replaced. Null and empty texts and texts without words get the score of clean ones.

    Each row is judged alone, so repeated rows have equal scores; a score of just THRESHOLD is toxic. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for b in batches:
            yield pd.Series(own.scores([t if isinstance(t, str) else None for t in b]), dtype="float64")

    return docs.withColumn("score", F.pandas_udf(scores, "double")(F.col(text)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, table(spark, sf_dir, "labels"))
    out = score_toxicity(docs, net)
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Quality classifier by compression: zstandard dictionaries of good text and of bad text.

Each text is compressed with both, in pieces of CHUNK_BYTES that each start from the dictionary alone: a long text's own
history would else take the dictionary's place and its later parts would not count. How much smaller the pieces get with
the good one, over the text's size, is the normalised compressed-size difference. Dictionaries vary with the texts that build them, so the difference is summed
over PAIRS pairs, each from other draws of the sample. A rising curve (isotonic regression, straight
between its steps), fitted on labelled texts that built no dictionary and weighted to the classes' shares in all
labelled rows, turns it into the probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.sampling import held_out, labelled_texts
from quillon.runtime import ship_package, table

#: The classifier is fitted on at most this many labelled texts of each class.
MAX_PER_CLASS = 2400
DICT_BYTES, LEVEL = 262_144, 3
#: Fewer texts or bytes of a class than these are too little to learn from: scores are the flat share of label 1.
LEAST_TEXTS, LEAST_BYTES = 16, 8192
#: Texts are compressed in pieces of this size.
CHUNK_BYTES = 4096
PAIRS, DRAW = 3, 0.85
FOLDS, HELD_FOLD, THRESHOLD = 5, 0, 0.3


class CompressionModel:
    """Pairs of dictionaries and the curve's points; picklable, compressors are made where it is used."""

    def __init__(self, pairs: list[tuple[bytes, bytes]], at: list[float] = [0.0], score: list[float] = [0.5]) -> None:  # noqa: B006
        self.pairs, self.at, self.curve = pairs, at, score
        self._made: list | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def difference(self, text: str | None) -> float:
        """The sum over pairs and pieces of (size with the bad dictionary - size with the good one), over the size; 0 for empty text."""
        if self._made is None:
            make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            self._made = [(make(good), make(bad)) for good, bad in self.pairs]
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if not raw:
            return 0.0
        whole = memoryview(raw)
        pieces = (whole[i : i + CHUNK_BYTES] for i in range(0, len(raw), CHUNK_BYTES))
        return sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces for good, bad in self._made) / (len(raw) + 30)

    def score(self, text: str | None) -> float:
        return float(np.interp(self.difference(text), self.at, self.curve))


def rising_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[list[float], list[float]]:
    """Isotonic regression by pooling neighbours that fall; points (mean place, level) to interpolate between."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, weighted level, weighted place
    for i in order:
        pools.append([w[i], w[i] * y[i], w[i] * x[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    at, level = zip(*((p[2] / p[0], p[1] / p[0]) for p in pools), strict=True)
    # never quite sure
    return list(at), [float(min(0.998, max(0.002, v))) for v in level]


def _dictionary(texts: list[str]) -> bytes:
    """A dictionary from all of the texts, cut into the pieces that they are compressed in."""
    whole = [t.encode("utf-8", "surrogatepass") for t in texts]
    pieces = [raw[i : i + CHUNK_BYTES] for raw in whole for i in range(0, len(raw), CHUNK_BYTES)]
    return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, pieces)) // 4), [p for p in pieces if len(p) >= 8]).as_bytes()


def fit(rows: pd.DataFrame, counts: dict[int, int], seed: int = 13) -> CompressionModel:
    """From (text, label) rows and the classes' counts in all labelled rows.

    Too few texts or bytes of a class to learn from, or none: a flat score, the share of label 1 (0.5 without labels).
    """
    rows = rows[rows["text"].notna() & rows["label"].isin([0, 1])]
    size = rows["text"].str.len().groupby(rows["label"]).agg(["size", "sum"])
    if len(size) < 2 or (size["size"] < LEAST_TEXTS).any() or (size["sum"] < LEAST_BYTES).any():
        return CompressionModel([], score=[(counts.get(1, 0) + 1) / (sum(counts.values()) + 2)])
    rows = rows.assign(part=rows.groupby("label").cumcount() % 4)
    build, check = rows[rows["part"] != 0], rows[rows["part"] == 0]
    rng = np.random.default_rng(seed)
    texts = [build.loc[build["label"] == k, "text"].tolist() for k in (1, 0)]
    draw = lambda t: [t[i] for i in rng.permutation(len(t))[: max(1, int(DRAW * len(t)))]]
    model = CompressionModel([tuple(_dictionary(draw(t)) for t in texts) for _ in range(PAIRS)])
    x, y = np.asarray([model.difference(t) for t in check["text"]]), check["label"].to_numpy(int)
    weight = np.asarray([counts.get(k, 1) / max(1, (y == k).sum()) for k in (0, 1)])
    model.at, model.curve = rising_curve(x, y.astype(float), weight[y])
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_PER_CLASS) -> CompressionModel:
    """Fits on labelled documents outside the held-out fold. An id with both labels counts in both classes."""
    return fit(*labelled_texts(docs, labels, "quality", most, FOLDS, HELD_FOLD))


def score_quality(docs: DataFrame, model: CompressionModel, text: str = "text") -> DataFrame:
    """``docs`` with score added or replaced. Null and empty texts have a difference of 0 and its calibrated score.

    Each row is judged alone, so repeated rows have equal scores; a score of just THRESHOLD is good. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for b in batches:
            yield b.map(own.score, na_action=None).astype("float64")

    return docs.withColumn("score", F.pandas_udf(scores, "double")(F.col(text)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score_quality(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Near-duplicate detection: banded MinHash candidates, sequential Bayesian verification, exact verification.

1. Each text gives a key of its word sequence, the size of its shingle set and a signature of BANDS * ROWS minimum hashes.
   Texts with equal keys are one class from here on, whatever their number.
2. A band's ROWS hashes are its bucket. Every class that shares a bucket is tied to the bucket's smallest class: two
   numbers for each class and band, never pairs. Two similar classes share a bucket but with probability
   (1 - t**ROWS)**BANDS, 2e-7 at t = 0.75.
3. Classes tied together that fit in a tile of bounded size are one, and their texts meet there. Larger ones are not
   closed over: first members meet the heads of their buckets, some members a tile, which joins groups of near
   copies of any size with work in proportion to their rows. Then those outside the group's largest component meet the others: few
   of them meet all of the group, part by part; many meet bucket by bucket, again all but a bucket's largest component, a pair
   that shares several of the first buckets in the first of them. An over-full bucket is cut into parts.
4. In those tiles of large groups only the first SIFT hashes of each member travel; members that a Bayesian gate leaves a
   partner are asked for their texts, the others are done. So where many are alike but not linked, hashes meet, not texts.
5. Wherever texts meet, signatures are compared in batches; after each batch a pair whose similarity is below the threshold with
   posterior probability over 1 - MISS is dropped, and what is left is verified on full shingle sets. Pairs
   already joined in the tile are skipped, and a tile returns the links of a spanning forest only, so
   what leaves a tile grows with its rows and not with its pairs.
6. Components of the links, over tiles, label all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.graph import connected_components
from quillon.llm.shingles import MinHash, blocks, shingle_sets
from quillon.runtime import ship_package, stash, table

THRESHOLD = (75, 100)
BANDS, ROWS = 40, 4
BATCH, MISS = 16, 1e-7
#: A part of a large group or bucket holds about this many documents, one of texts also no more than about these bytes.
PART_ROWS, PART_BYTES = 512, 4 << 20
#: Members that meet a bucket's head in one tile, and hashes of each member that meet before texts do.
STAR_ROWS, SIFT = 64, 64
#: What the heads leave of a large group meets all of it in up to this many parts; beyond that only what shares a bucket meets.
FEW_PARTS = 16
#: Texts of up to this many classes (two numbers each) are picked by broadcast; of more, by shuffle.
BROADCAST_IDS = 200_000

_SKETCH = "doc_id long, th long, key1 long, key2 long, n_shingles long, n_bytes long, signature binary"
_TILE = ("cluster", "pa", "pb", "id", "th", "side")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    minhash = MinHash(BANDS * ROWS)
    for batch in batches:
        ids, hashes, texts = batch.column("doc_id"), batch.column("th"), batch.column("text").to_pylist()
        for start, docs in blocks(texts):
            sets, keys = shingle_sets(docs)
            signatures = minhash.of(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(start, len(docs)),
                    hashes.slice(start, len(docs)),
                    pa.array(np.ascontiguousarray(keys[:, 0]).view(np.int64)),
                    pa.array(np.ascontiguousarray(keys[:, 1]).view(np.int64)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([len(d) for d in docs], pa.int64()),
                    pa.array([row.tobytes() if len(s) else None for s, row in zip(sets, signatures, strict=True)], pa.binary()),
                ],
                ["doc_id", "th", "key1", "key2", "n_shingles", "n_bytes", "signature"],
            )


def buckets(signature: Column) -> Column:
    """array<bigint>: one hash a band, the band's number mixed in."""
    return F.array(*(F.xxhash64(F.lit(b), F.substring(signature, 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)))


def least_matches(size: int, batch: int = BATCH, threshold: float = THRESHOLD[0] / THRESHOLD[1], miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on) for each batch.

    With a uniform prior and m matches of n, the similarity's posterior is Beta(m + 1, n - m + 1), and the
    probability that it is at least t is that of at most m successes in n + 1 trials of probability t.
    """
    out = []
    for n in range(batch, size + 1, batch):
        m, below = 0, 0.0
        while m <= n:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def likely(i: int, others: np.ndarray, signatures: np.ndarray, sizes: np.ndarray, gates: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``others`` that may be similar to ``i``, and how many hashes they share: by sizes first, then batch by batch."""
    top, whole = THRESHOLD
    # sizes alone rule out many: the smaller set has at least the threshold's share of the larger
    fits = (whole * np.minimum(sizes[others], sizes[i]) >= top * np.maximum(sizes[others], sizes[i])) & (sizes[others] > 0)
    others = others[fits]
    hits, before = np.zeros(len(others), dtype=np.int32), 0
    for n, least in gates:
        if not len(others):
            break
        hits += (signatures[others, before:n] == signatures[i, before:n]).sum(axis=1, dtype=np.int32)
        on = hits >= least
        others, hits, before = others[on], hits[on], n
    return others, hits


class Forest:
    """Disjoint sets of 0..n-1 with the smallest member as root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def verified_links(sets: list[np.ndarray], side: np.ndarray, same: bool, minhash: MinHash, gates: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the exact links between sides 0 and 1 of a tile, or of all with all if ``same``.

    Texts of a part are compared with a row of others at a time, so memory stays at a few rows of numbers.
    """
    top, whole = THRESHOLD
    sizes = np.asarray([len(s) for s in sets], dtype=np.int64)
    left, right = (np.arange(len(sets)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if len(left) == 0 or len(right) == 0 or len(sets) < 2:
        return []
    forest, out = Forest(len(sets)), []
    if len(sets) == 2:
        pairs = [(0, np.asarray([1]), np.asarray([1.0]))]
        signatures = None
    else:
        signatures = minhash.of(sets)
        pairs = None
    # shingles as small numbers, to intersect with one lookup table
    flat, code = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate(([0], np.cumsum(sizes)))
    marked = np.zeros(len(flat), dtype=bool)

    def check(i: int, others: np.ndarray) -> None:
        own = code[at[i] : at[i + 1]]
        marked[own] = True
        for a in range(0, len(others), 64):
            some = np.asarray([j for j in others[a : a + 64] if forest.root(i) != forest.root(int(j))], dtype=np.int64)
            if not len(some):
                continue
            n = sizes[some]
            rows = np.concatenate([code[at[j] : at[j + 1]] for j in some])
            both = np.add.reduceat(marked[rows].astype(np.int64), np.concatenate(([0], np.cumsum(n)[:-1])))
            for j in some[whole * both >= top * (sizes[i] + n - both)]:
                if forest.join(i, int(j)):
                    out.append((i, int(j)))
        marked[own] = False

    if pairs is not None:
        check(0, pairs[0][1])
        return out
    for i in left:
        others = right[right > i] if same else right
        others, hits = likely(i, others, signatures, sizes, gates)
        if len(others):
            check(int(i), others[np.argsort(-hits, kind="stable")])
    return out


def _each_tile(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Rows sorted by the first three columns, a tile at a time. A tile is held whole; its size is bounded."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if held and held[0][:3] != row[:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of tiles of signatures: those whose rows have a likely partner in the tile.

    Side 0 is held against side 1. Pairs of one component are linked already; ``band`` is the tile's bucket's, and a pair
    that shares an earlier bucket meets there (-1: all pairs meet here).
    """
    gates = least_matches(SIFT)
    for tile in _each_tile(batches, (*_TILE, "component", "band", "n_shingles", "signature")):
        side, component, sizes = (np.asarray([r[k] for r in tile], dtype=np.int64) for k in (5, 6, 8))
        signatures = np.frombuffer(b"".join(r[9] for r in tile), dtype=np.uint32).reshape(len(tile), -1)
        band = tile[0][7]
        bands = signatures[:, : max(band, 0) * ROWS].reshape(len(tile), -1, ROWS)
        wanted = np.zeros(len(tile), dtype=bool)
        for i in np.flatnonzero(side == 0):
            others = np.flatnonzero((side == 1) & (component != component[i]))
            others, _ = likely(i, others, signatures, sizes, gates)
            if len(others) and band > 0:
                others = others[~(bands[others] == bands[i]).all(axis=2).any(axis=1)]
            if len(others):
                wanted[i] = wanted[others] = True
        if wanted.any():
            rows = [tile[k][:6] for k in np.flatnonzero(wanted)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(_TILE))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of tiles of texts: each tile's links."""
    minhash = MinHash(BANDS * ROWS)
    gates = least_matches(BANDS * ROWS)
    for tile in _each_tile(batches, (*_TILE, "text")):
        if len(tile) < 2:
            continue
        sets = []
        for _, docs in blocks([r[6] for r in tile]):
            sets += shingle_sets(docs)[0]
        # a tile whose parts differ holds two sides against each other
        found = verified_links(sets, np.asarray([r[5] for r in tile]), tile[0][1] == tile[0][2], minhash, gates)
        if found:
            yield _links([(tile[a][3], tile[b][3]) for a, b in found])


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def sketch(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).mapInArrow(_sketch, _SKETCH)


def classes(sketches: DataFrame) -> DataFrame:
    """(key1, key2, id, th, n_shingles, n_bytes, signature): one row for each distinct word sequence that has words and an id; id is
    its smallest, and th the hash of a text with that id."""
    some = sketches.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    per = some.groupBy("key1", "key2").agg(F.min(F.struct("doc_id", "th")).alias("m"), F.min("n_shingles").alias("n_shingles"), F.min("n_bytes").alias("n_bytes"), F.first("signature").alias("signature"))
    return per.select("key1", "key2", F.col("m.doc_id").alias("id"), F.col("m.th").alias("th"), "n_shingles", "n_bytes", "signature")


def ties(reps: DataFrame) -> DataFrame:
    """(a, b): each class with the smallest class of each of its buckets, if that is another one."""
    rows = reps.select("id", F.explode(buckets(F.col("signature"))).alias("bucket"))
    heads = rows.groupBy("bucket").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return rows.join(heads.select("bucket", "head"), "bucket").where(F.col("id") != F.col("head")).select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()


def _tile(rows: DataFrame, *more: str) -> DataFrame:
    kinds = ("bigint", "int", "int", "bigint", "bigint", "int")
    return rows.select(*(F.col(c).cast(k).alias(c) for c, k in zip(_TILE, kinds, strict=True)), *more)


def _found(docs: DataFrame, rows: DataFrame, doc: str, text: str) -> DataFrame:
    """The links of tiles: ``rows`` has the columns of a tile, and documents bring their texts to it, each once."""
    rows = stash(_tile(rows))
    wanted = stash(rows.select("id", "th").distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = docs.select(F.col(doc).cast("bigint").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    # rows that repeat an id and a text bring it once
    texts = texts.join(wanted, ["id", "th"]).groupBy("id", "th").agg(F.any_value("text").alias("text"))
    tiles = rows.join(texts, ["id", "th"]).select(*_TILE, "text").repartition("cluster", "pa", "pb").sortWithinPartitions("cluster", "pa", "pb", "id")
    return stash(tiles.mapInArrow(_tiles, "a long, b long").where(F.col("a") != F.col("b")))


def _sifted(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Those rows of tiles that have a likely partner there. ``rows`` has a tile's columns, component and band."""
    part = reps.select("id", "th", "n_shingles", F.substring("signature", 1, 4 * SIFT).alias("signature"))
    tiles = _tile(rows, F.col("component").cast("bigint").alias("component"), F.col("band").cast("int").alias("band")).join(part, ["id", "th"])
    tiles = tiles.select(*_TILE, "component", "band", "n_shingles", "signature").repartition("cluster", "pa", "pb").sortWithinPartitions("cluster", "pa", "pb", "id")
    return tiles.mapInArrow(_sift, "cluster long, pa int, pb int, id long, th long, side int")


def _part(parts: Column, seed: int = 0) -> Column:
    """A row's part, by a hash of the id: parts vary a little around their bound."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), parts).cast("int")


def _chunks(n: Column) -> Column:
    return F.greatest(F.ceil(n / PART_ROWS), F.lit(1)).cast("int")


def _upto(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def links(docs: DataFrame, reps: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b): verified links that join all similar classes of ``reps``."""
    tied = stash(ties(reps))
    members = stash(connected_components(tied).withColumnRenamed("component", "cluster").join(reps.select("id", "th", "n_bytes"), "id"))
    sizes = members.groupBy("cluster").agg((F.greatest(F.count(F.lit(1)) / PART_ROWS, F.sum("n_bytes") / PART_BYTES) > 1).alias("large"))
    members = stash(members.join(sizes, "cluster"))
    zero = F.lit(0)
    whole = members.where(~F.col("large")).select("cluster", zero.alias("pa"), zero.alias("pb"), "id", "th", zero.alias("side"))
    large = members.where("large").select("cluster", "id", "th")
    if large.isEmpty():
        return _found(docs, whole, doc, text)

    # members of large groups and the heads of their buckets
    spokes = tied.join(large.select(F.col("id").alias("a"), "th"), "a").withColumnsRenamed({"a": "id", "b": "head"})
    many = spokes.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("chunks"))
    star = spokes.join(many, "head").select(F.col("head").alias("cluster"), _part(F.col("chunks")).alias("pa"), F.lit(-1).alias("pb"), "id", "th", F.lit(1).alias("side"))
    heads = many.join(large.select(F.col("id").alias("head"), "th"), "head").select(F.col("head").alias("cluster"), _upto(F.col("chunks")).alias("pa"), F.lit(-1).alias("pb"), F.col("head").alias("id"), "th", zero.alias("side"))
    apart = star.unionByName(heads).withColumn("component", F.col("side")).withColumn("band", F.lit(-1))
    first = _found(docs, whole.unionByName(_sifted(apart, reps)), doc, text)

    # all but a group's largest component meet all of it: part by part where they are few, else bucket by bucket
    joined = connected_components(first.join(large.select(F.col("id").alias("a")), "a", "left_semi"))
    large = stash(large.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id")))
    by = stash(_several(large).withColumn("near", F.col("few") <= FEW_PARTS))
    split = large.join(by, "cluster").withColumn("band", F.lit(-1))
    tiles = _two_sides(split.where("near"))
    far = split.where(~F.col("near")).select("id", "th", "component")
    if not far.isEmpty():
        rows = reps.join(far, ["id", "th"]).select("id", "th", "component", F.posexplode(buckets(F.col("signature"))).alias("band", "cluster"))
        rows = stash(rows)
        tiles = tiles.unionByName(_two_sides(rows.join(_several(rows), "cluster")))
    return first.unionByName(_found(docs, _sifted(tiles, reps), doc, text))


def _several(rows: DataFrame) -> DataFrame:
    """(cluster, main, parts, few) of those clusters of ``rows`` that have several components: the largest one, and how many parts
    all of the cluster and all but that component are."""
    by = rows.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    by = by.groupBy("cluster").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.max("n").alias("most"), F.sum("n").alias("n")).where(F.col("n") > F.col("most"))
    return by.select("cluster", "main", _chunks(F.col("n")).alias("parts"), _chunks(F.col("n") - F.col("most")).alias("few"))


def _two_sides(rows: DataFrame) -> DataFrame:
    """Tiles that set each part of what is outside the main component against each part of all."""
    left = rows.where(F.col("component") != F.col("main")).select("cluster", _part(F.col("few"), 1).alias("pa"), _upto(F.col("parts")).alias("pb"), "id", "th", F.lit(0).alias("side"), "component", "band")
    right = rows.select("cluster", _upto(F.col("few")).alias("pa"), _part(F.col("parts"), 2).alias("pb"), "id", "th", F.lit(1).alias("side"), "component", "band")
    # a tile of two sides has a negative second part
    return left.unionByName(right).withColumn("pb", -F.col("pb") - 2)


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Null and wordless texts: no shingles, linked with nothing, component is the own id. Rows with a null id are
    linked with none but equal texts and are kept unless an equal text has an id; rows that repeat an id and a text stay and
    have equal results. One id with two different texts makes both one node.
    """
    sketches = stash(sketch(docs, doc, text))
    reps = stash(classes(sketches))
    joined = connected_components(links(docs, reps, doc, text))
    named = reps.select("key1", "key2", "id").join(joined, "id", "left").select("key1", "key2", F.coalesce("component", "id").alias("_to"))
    out = sketches.select("doc_id", "key1", "key2", "n_shingles").join(named, ["key1", "key2"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("_to", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class (see ``near_duplicates`` for nulls, empty texts and repeated rows)."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

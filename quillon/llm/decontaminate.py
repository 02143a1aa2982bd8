"""Benchmark decontamination with a distributed positional inverted index.

The training side becomes an index once: one pass over the texts writes a posting (term, document, position) for each
word that the benchmark has too, clustered by term and salted by document, so that a common term's list lies in many files; each
document's length is a posting of its own. The test side is a set of windows of ``width`` words. Terms are ranked by
how many postings they have, and each window is looked up from its rarest term: those postings are its anchors. The
list of the second rarest term is intersected with them next, moved by the distance of the two terms in the window (for
proximity matches: anywhere within reach), which leaves few; around those, the lists of all other terms are intersected,
from postings read by blocks of positions.

A phrase match has all words of a window in order. A proximity match has all of them, each as often as the window, in any order
within ``slack`` words more: around each anchor the shortest such span (the first of equally short ones) is returned. All is joins and
aggregates of narrow rows. Tables are broadcast only up to a counted number of rows and joined by shuffle beyond; no
step groups more than one document or one block of positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.runtime import stash, table

WIDTH, SLACK = 10, 5
#: Tables of up to this many narrow rows are sent to all executors.
BROADCAST_ROWS = 200_000
#: A term's postings are dealt to up to this many places.
SALTS = 64
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for the end of a document; no word holds a control character.
_END = "\x00"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else.

    lower() does just that where no other character has a lower case, and is much faster than translate().
    """
    return F.when(text.rlike(r"[[\p{IsUppercase}\p{IsTitlecase}]&&[^A-Z]]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """The words of a text: runs of 0-9, a-z and non-ASCII characters, A-Z lower-cased. Null has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(SPLIT)), lambda w: w != "")


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(item_id, terms): every run of ``width`` words of an item; an item of fewer words, but not none, is one window."""
    held = benchmark.select(F.col(item).alias("item_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return held.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, width))).alias("terms")).distinct()


def _small(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def postings(docs: DataFrame, terms: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index (tid, d, pos, doc): where each of ``terms`` (term, tid) stands in each document.

    ``d`` numbers the rows of ``docs``, so repeated rows are told apart. Rows with tid -1 are the documents: pos is the
    number of words and doc has doc_id and the hash of the text.
    """
    held = docs.select(F.monotonically_increasing_id().alias("d"), F.struct(F.col(doc).alias("doc_id"), F.xxhash64(text).alias("_th")).alias("doc"), words(F.col(text)).alias("w"))
    each = held.select("d", "doc", F.posexplode(F.concat("w", F.array(F.lit(_END)))).alias("pos", "term"))
    ends = terms.sparkSession.createDataFrame([(_END, -1)], "term string, tid long")
    found = each.join(_small(stash(terms.unionByName(ends))), "term").select("tid", "d", "pos", F.when(F.col("tid") < 0, F.col("doc")).alias("doc"))
    return stash(found.repartition("tid", F.pmod(F.hash("d"), F.lit(SALTS))).sortWithinPartitions("tid", "d", "pos"))


def probes(wins: DataFrame, index: DataFrame) -> DataFrame:
    """(win, n, tids, need, first, place, second, shift) for ``wins`` (win, tids): where to begin and how to go on.

    ``first`` is the window's rarest term by postings (ties: the smaller tid) and ``place`` its first place; ``second`` the rarest
    of the others (null if all are one) and ``shift`` its first place less ``place``; ``need`` says how often each term is needed.
    Windows with a term that no document has do not occur and are left out.
    """
    often = index.where(F.col("tid") >= 0).groupBy("tid").agg(F.count(F.lit(1)).alias("often"))
    places = wins.select("win", "tids", F.posexplode("tids").alias("place", "tid"))
    terms = places.groupBy("win", "tids", "tid").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("k")).join(often, "tid")
    per = terms.groupBy("win", "tids").agg(F.array_sort(F.collect_list(F.struct("often", "tid", "place", "k"))).alias("ts"), F.sum("k").alias("known"))
    a, b = F.col("ts")[0], F.get(F.col("ts"), F.lit(1))
    need = F.transform("ts", lambda t: F.struct(t["tid"].alias("tid"), t["k"].alias("k")))
    return per.where(F.col("known") == F.size("tids")).select(
        "win", F.size("tids").alias("n"), "tids", need.alias("need"), a["tid"].alias("first"), a["place"].alias("place"), b["tid"].alias("second"), (b["place"] - a["place"]).alias("shift")
    )


def _blocks_near(pos: Column, reach: Column, size: int) -> Column:
    """The numbers of the blocks of ``size`` positions that lie within ``reach`` of one."""
    at = lambda p: F.floor(F.greatest(p, F.lit(0)) / size).cast("int")
    return F.sequence(at(pos - reach), at(pos + reach))


def lookup(index: DataFrame, asked: DataFrame, width: int = WIDTH, slack: int | None = None) -> DataFrame:
    """(win, d, start, n, exact): the phrase matches of ``asked`` (see ``probes``) and, with ``slack``, the proximity matches.

    ``width`` is at most 62: a window's terms have a bit each.
    """
    if width > 62:
        raise ValueError("windows have at most 62 words")
    lists = index.where(F.col("tid") >= 0).select("tid", "d", "pos")
    size = 2 * (width + (slack or 0))
    span = F.col("n") + (slack or 0)
    anchors = lists.join(_small(asked.select("win", "n", F.col("first").alias("tid"), "place", "second", "shift")), "tid")
    anchors = anchors.where(F.col("pos") >= F.col("place")) if slack is None else anchors
    anchors = anchors.select("win", "n", "d", F.col("pos").alias("p"), "second", "shift")
    # the second list, at its own offset or within reach
    seconds = _small(stash(asked.where(F.col("second").isNotNull()).select(F.col("second").alias("tid")).distinct()))
    other = lists.join(seconds, "tid", "left_semi").select(F.col("tid").alias("second"), "d", F.col("pos").alias("q"))
    more = anchors.where(F.col("second").isNotNull())
    if slack is None:
        both = more.withColumn("q", F.col("p") + F.col("shift")).join(other, ["second", "d", "q"], "left_semi")
    else:
        more = more.withColumn("block", F.explode(_blocks_near(F.col("p"), span - 1, size)))
        other = other.withColumn("block", F.floor(F.col("q") / size).cast("int"))
        both = more.join(other, (more["second"] == other["second"]) & (more["d"] == other["d"]) & (more["block"] == other["block"]) & (F.abs(more["p"] - other["q"]) < span), "left_semi")
    left = stash(both.unionByName(anchors.where(F.col("second").isNull()), allowMissingColumns=True).select("win", "n", "d", "p").distinct())

    # all postings around what is left
    at = left.select("win", "d", "p", F.explode(_blocks_near(F.col("p"), F.lit(size // 2), size)).alias("block"))
    wanted = _small(stash(at.select("d", "block").distinct()))
    around = lists.withColumn("block", F.floor(F.col("pos") / size).cast("int")).join(wanted, ["d", "block"])
    around = around.groupBy("d", "block").agg(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "tid")).alias("near"))
    rows = at.join(around, ["d", "block"]).join(_small(asked.select("win", "n", "place", "tids", F.transform("need", lambda t: t["tid"]).alias("terms"))), "win")
    rows = rows.select("win", "d", "p", "n", "place", "tids", "terms", F.explode("near").alias("x")).where((F.abs(F.col("x.pos") - F.col("p")) < span) & F.array_contains("tids", F.col("x.tid")))
    # a posting is in order if the window, moved to its anchor, has its term there
    offset = F.col("x.pos") - F.col("p") + F.col("place")
    in_order = (offset >= 0) & (offset < F.col("n")) & F.get(F.col("tids"), offset).eqNullSafe(F.col("x.tid"))
    kinds = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.array_position("terms", F.col("x.tid")) - 1).cast("int")))
    more = [] if slack is None else [kinds.alias("kinds"), F.array_sort(F.collect_list("x")).alias("near")]
    seen = rows.groupBy("win", "d", "p").agg(F.sum(in_order.cast("int")).alias("hits"), *more)
    seen = seen.join(_small(asked.select("win", "n", "place", "tids", "need")), "win")
    exact = seen.where(F.col("hits") == F.col("n")).select("win", "d", (F.col("p") - F.col("place")).alias("start"), "n", F.lit(True).alias("exact"))
    if slack is None:
        return exact

    # from each place before the anchor, the end of the shortest span that has all terms often enough
    rest = seen.where((F.col("hits") < F.col("n")) & (F.col("kinds") == F.call_function("shiftleft", F.lit(1).cast("bigint"), F.size("need")) - 1))
    far = F.lit(2**31 - 1)
    place_of = lambda a, t: F.get(F.filter("near", lambda x: (x["tid"] == t["tid"]) & (x["pos"] >= a["pos"])), (t["k"] - 1).cast("int"))["pos"]
    end = lambda a: F.aggregate("need", F.col("p").cast("int"), lambda to, t: F.greatest(to, F.coalesce(place_of(a, t), far)))
    each = F.transform(F.filter("near", lambda a: a["pos"] <= F.col("p")), lambda a: F.struct((end(a).cast("bigint") - a["pos"] + 1).alias("n"), a["pos"].alias("start")))
    close = rest.withColumn("best", F.array_min(F.filter(each, lambda s: s["n"] <= span))).where(F.col("best").isNotNull())
    as_it_is = F.filter("near", lambda x: (x["pos"] >= F.col("best.start")) & F.get(F.col("tids"), x["pos"] - F.col("best.start")).eqNullSafe(x["tid"]))
    whole = (F.col("best.n") == F.col("n")) & (F.size(as_it_is) == F.col("n"))
    close = close.select("win", "d", F.col("best.start").alias("start"), F.col("best.n").cast("int").alias("n"), whole.alias("exact"))
    return exact.unionByName(close).distinct()


def search(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", width: int = WIDTH, slack: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, matches): (d, doc_id, _th, n_words) for each row of ``docs``, and (d, item_id, start, n, exact) for its matches."""
    wins = windows(benchmark, width=width)
    held = stash(wins.groupBy("terms").agg(F.collect_set("item_id").alias("items")).withColumn("win", F.monotonically_increasing_id()))
    terms = stash(held.select(F.explode("terms").alias("term")).distinct().withColumn("tid", F.monotonically_increasing_id()))
    index = postings(docs, terms, doc, text)
    places = held.select("win", F.posexplode("terms").alias("place", "term")).join(terms, "term")
    in_order = places.groupBy("win").agg(F.array_sort(F.collect_list(F.struct("place", "tid"))).alias("ts"))
    asked = stash(probes(in_order.select("win", F.transform("ts", lambda t: t["tid"]).alias("tids")), index))
    found = lookup(index, asked, width, slack).join(_small(held.select("win", "items")), "win")
    rows = index.where(F.col("tid") < 0).select("d", "doc.doc_id", "doc._th", F.col("pos").cast("bigint").alias("n_words"))
    return rows, found.select("d", F.explode("items").alias("item_id"), "start", "n", "exact")


def matches(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", width: int = WIDTH, slack: int | None = None) -> DataFrame:
    """(doc_id, item_id, start, n, exact): all phrase and, with ``slack``, proximity matches; repeated documents repeat theirs."""
    rows, found = search(docs, benchmark, doc, text, width, slack)
    return found.join(rows, "d").select("doc_id", "item_id", "start", "n", "exact")


def contamination(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", width: int = WIDTH, slack: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, _th) for each row of ``docs``.

    A word is hit if it is inside a phrase match; ``n_near`` is the number of items with a phrase or proximity match (with
    phrase matches alone where ``slack`` is null). Null and empty texts have no words and no hits. Null ids are kept;
    repeated rows stay as many rows with equal results. Items that are null or have no words match nothing, equal items all count,
    and an empty benchmark contaminates nothing. Other columns of ``docs`` are not looked at, whatever their names.
    """
    rows, found = search(docs, benchmark, doc, text, width, slack)
    item = F.col("item_id").cast("string")
    per = found.groupBy("d").agg(
        F.collect_set(F.when(F.col("exact"), F.struct("start", "n"))).alias("_at"),
        F.collect_set(F.when(F.col("exact"), item)).alias("_items"),
        F.count_distinct(item).alias("n_near"),
    )
    # starts in order: each adds what the one before it has not covered
    order = F.array_sort("_at")
    cover = F.aggregate(order, F.struct(F.lit(0).alias("hit"), F.lit(0).alias("to")), lambda acc, s: F.struct((acc["hit"] + F.greatest(s["start"] + s["n"] - F.greatest(acc["to"], s["start"]), F.lit(0))).alias("hit"), F.greatest(acc["to"], s["start"] + s["n"]).alias("to")))
    per = per.select("d", cover["hit"].cast("bigint").alias("n_hit"), F.array_sort("_items").alias("_items"), "n_near")
    out = rows.join(per, "d", "left").withColumn("_items", F.coalesce("_items", F.array().cast("array<string>")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    out = out.select("doc_id", "n_words", zero("n_hit"), F.size("_items").cast("bigint").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), zero("n_near"), "_th")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item: phrases, and items near by with SLACK words between their own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark"), slack=SLACK).drop("_th")


OP8_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM bw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM wins),
dg AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS gram
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM dw, lens WHERE len(w) >= n)
), hit AS (SELECT DISTINCT r, dg.n AS n, s, item_id FROM dg JOIN wins USING (n, gram)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY r),
gr AS (SELECT gram, n, row_number() OVER () AS g FROM (SELECT DISTINCT gram, n FROM wins)),
need AS (SELECT g, n, t, count(*) AS k FROM (SELECT g, n, unnest(string_split(gram, ' ')) AS t FROM gr) GROUP BY g, n, t),
post AS (SELECT r, t, p FROM (SELECT r, unnest(w) AS t, unnest(range(len(w))) AS p FROM dw) WHERE t IN (SELECT t FROM need)),
tf AS (SELECT t, count(*) AS c FROM post GROUP BY t),
rare AS (
  SELECT g, any_value(n) AS n, list(t ORDER BY c, t) AS ts, count(*) AS m FROM need JOIN tf USING (t) GROUP BY g
  HAVING count(*) = (SELECT count(*) FROM need x WHERE x.g = need.g)
), anchor AS (SELECT g, n, m, r, p, ts[2] AS t2 FROM rare JOIN post ON t = ts[1]),
close_by AS (
  SELECT g, n, m, r, p FROM anchor WHERE m = 1
  UNION SELECT a.g, a.n, a.m, a.r, a.p FROM anchor a JOIN post b ON b.r = a.r AND b.t = a.t2 AND abs(b.p - a.p) < a.n + 5
), around AS (SELECT s.g, s.n, s.m, s.r, s.p, x.p AS q, x.t, d.k FROM close_by s JOIN need d ON d.g = s.g JOIN post x ON x.r = s.r AND x.t = d.t AND abs(x.p - s.p) < s.n + 5),
full_ones AS (SELECT g, r, p FROM around GROUP BY g, r, p, m HAVING count(DISTINCT t) = m),
spans AS (
  SELECT g, r, p, a FROM (
    SELECT b.g, b.r, b.p, b.m, a.q AS a, b.t, b.k, count(*) AS have
    FROM around b JOIN full_ones USING (g, r, p) JOIN (SELECT DISTINCT g, r, p, q FROM around WHERE q <= p) a ON a.g = b.g AND a.r = b.r AND a.p = b.p AND b.q >= a.q AND b.q < a.q + b.n + 5
    GROUP BY b.g, b.r, b.p, b.m, a.q, b.t, b.k
  ) WHERE have >= k GROUP BY g, r, p, a, m HAVING count(*) = m
), near AS (SELECT r, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_near FROM (SELECT DISTINCT g, r FROM spans) JOIN gr USING (g) JOIN wins ON wins.gram = gr.gram AND wins.n = gr.n GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r) LEFT JOIN near USING (r)
"""

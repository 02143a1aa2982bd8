"""URL filters: rules by domain and path, and naive Bayes over segmented host words and path tokens.

Runs of letters in host labels and paths are split into words by a Viterbi search over unigram costs. The unigrams are
the words of public vocabularies, whose ranks stand for frequencies, the parts between hyphens and dots of all hosts given, and
words of labelled texts. A stretch of no known words costs as much as so many letters are surprising, so it
stays whole unless words explain it better. The multinomial naive Bayes has one class of words to block and one of words
to allow: it counts the texts with a word among documents that are labelled toxic and not toxic, on top of a prior
of seed words (pseudo-counts). What neither has seen weighs nothing.
"""

from __future__ import annotations

import base64
import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.sampling import labelled_texts
from quillon.runtime import ship_package, table

ALLOW, BLOCK = "allow", "block"

#: Files of public vocabularies in order of rank: JSON of pieces with word ends, or base64 pieces with leading spaces.
VOCABULARIES = ("/opt/tokenizers/word_bpe_49k.json", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The prior: seed words of names to block, telling ones and weaker ones, and of names to allow; each counts as so many texts.
TELLING_WORDS = "casino bet bets betting poker slots jackpot gambling lottery adult sex porn xxx escort nude viagra cialis pills spam malware phish scam payday warez torrent".split()
WEAKER_WORDS = "win gamble lotto sexy cam cams hot fetish pill pharma pharmacy meds cheap free farm ads ad adserver track tracker tracking click clicks banner popup loan loans credit debt cash rich crypto forex miracle diet replica rolex fake crack keygen pirate prize prizes bonus offer deals discount coupon".split()
ALLOWED_WORDS = "news shop store book books library school university college science research history art music film photo travel food recipe health garden sport weather map maps wiki forum help support docs code dev open data tech cloud learn study teach game games family home house city world time day green water light first local public gov law legal bank market trade work job jobs business media press radio video mail chat social people club group design style fashion car auto bike tree river mountain sea bird dog cat".split()
TELLING, WEAKER, ALLOWED = 400, 40, 20
#: Labelled texts of each class that are counted, and the pseudo-count of every word in both classes.
MAX_PER_CLASS, SMOOTHING = 1000, 5.0
FOLDS, HELD_FOLD = 5, 0
#: A host part is a word of its own if it is one in this many of all parts: so there are no more of them than that.
PART_SHARE = 200_000
#: A word of labelled texts is one if this many of them have it.
LEAST_TEXTS = 8
#: How much the three sources of unigrams weigh, and a seed word by itself.
VOCABULARY_WEIGHT, PART_WEIGHT, TEXT_WEIGHT, SEED_WEIGHT = 0.8, 0.1, 0.1, 1e-6
#: Cost of an unknown stretch, of each letter in it, and of each place where a run is cut; two-letter words have to be at
#: least this common.
UNKNOWN, LETTER, CUT, SHORT_WORD = 4.0, 2.3, 1.0, 2e-4
RULES: tuple[tuple[str, str, str], ...] = (
    (ALLOW, "org", "/"),
    (BLOCK, "example.org", "/es/"),
    (BLOCK, "example.org", "/en/1"),
    (ALLOW, "com", "/fr/"),
    (BLOCK, "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. Longest: host and path together."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, where, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == where) | host.endswith(f".{where}")) & path.startswith(start)
        rule = F.when(fits, F.lit(where + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


_RUN = re.compile(r"[^\W\d_]+")


def vocabulary_words(path: str) -> list[str]:
    """The distinct words of a vocabulary file in order of rank, lower-cased."""
    if path.endswith(".json"):
        pieces = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
        found = [t[:-4] for t in sorted(pieces, key=pieces.get) if t.endswith("</w>")]
    else:
        lines = (line.split() for line in Path(path).read_bytes().splitlines())
        ranked = sorted((int(rank), base64.b64decode(piece)) for piece, rank in lines)
        found = [p[1:].decode("utf-8", "replace").lower() for _, p in ranked if p.startswith(b" ")]
    return list(dict.fromkeys(w for w in found if _RUN.fullmatch(w)))


class HostModel:
    """Unigram costs and naive Bayes weights; bounded by its inputs and picklable.

    ``parts``: counts of host parts. ``good`` and ``bad``: in how many texts of each class a word occurs.
    """

    def __init__(self, parts: Mapping[str, int] | None = None, good: Mapping[str, int] | None = None, bad: Mapping[str, int] | None = None, vocabularies: Sequence[str] = VOCABULARIES, prior_block: float = 0.05) -> None:
        parts, good, bad = parts or {}, good or {}, bad or {}
        share: dict[str, float] = defaultdict(float)
        for path in vocabularies:
            words = vocabulary_words(path)
            whole = math.log((len(words) + 50) / 50)
            for rank, w in enumerate(words):
                share[w] += VOCABULARY_WEIGHT / len(vocabularies) / ((rank + 50) * whole)
        texts = Counter(good) + Counter(bad)
        for counts, weight, least in ((parts, PART_WEIGHT, 1), (texts, TEXT_WEIGHT, LEAST_TEXTS)):
            total = sum(counts.values())
            for w, n in counts.items():
                if n >= least:
                    share[w] += weight * n / total
        seeds = dict.fromkeys(ALLOWED_WORDS, 0) | dict.fromkeys(WEAKER_WORDS, WEAKER) | dict.fromkeys(TELLING_WORDS, TELLING)
        for w in seeds:
            share[w] += SEED_WEIGHT
        self.cost = {w: -math.log(p) for w, p in share.items() if len(w) > 2 or len(w) == 2 and p >= SHORT_WORD}
        self.longest = max(map(len, self.cost))
        # classes of equal mass: a word's weight is the ratio of its shares in them
        mass = (sum(good.values()) + sum(bad.values())) / 2
        each = [(c, mass / sum(c.values()) if c else 0.0) for c in (bad, good)]
        allowed = dict.fromkeys(ALLOWED_WORDS, ALLOWED)
        self.weights = {}
        for w in {*good, *bad, *seeds}:
            b, g = (c.get(w, 0) * scale + more.get(w, 0) + SMOOTHING for (c, scale), more in zip(each, (seeds, allowed), strict=True))
            if abs(x := math.log(b / g)) > 0.05:
                self.weights[w] = x
        self.prior = math.log(prior_block / (1 - prior_block))

    def segment(self, run: str) -> list[str]:
        """The cheapest split of letters into words and unknown stretches; the first of equally cheap ones from the left."""
        best: list[tuple[float, int, bool]] = [(0.0, 0, True)]
        for j in range(1, len(run) + 1):
            at = (math.inf, 0, False)
            for i in range(max(0, j - self.longest), j):
                c = self.cost.get(run[i:j])
                if c is not None and (c := best[i][0] + c + (CUT if i else 0.0)) < at[0]:
                    at = (c, i, True)
            # an unknown stretch goes on for one letter's price, or begins
            go_on = best[j - 1][0] + LETTER + (0.0 if not best[j - 1][2] else UNKNOWN + (CUT if j > 1 else 0.0))
            if go_on < at[0]:
                at = (go_on, best[j - 1][1] if not best[j - 1][2] else j - 1, False)
            best.append(at)
        words, j = [], len(run)
        while j:
            words.append(run[best[j][1] : j])
            j = best[j][1]
        return words[::-1]

    def host_words(self, host: str) -> list[str]:
        """Words of all labels but the last, which is the top-level domain."""
        labels = host.rsplit("@", 1)[-1].split(":", 1)[0].split(".")
        return [w for label in labels[:-1] for run in _RUN.findall(label) for w in self.segment(run)]

    def path_words(self, path: str) -> list[str]:
        return [w for run in _RUN.findall(path.lower()) for w in self.segment(run)]

    def log_odds(self, words: Sequence[str]) -> float:
        """The log odds of block."""
        return self.prior + sum(self.weights.get(w, 0.0) for w in words)

    def score(self, host: str, path: str) -> float:
        return self.log_odds([*self.host_words(host), *self.path_words(path)])


def host_parts(pages: DataFrame, url: str = "url") -> dict[str, int]:
    """How often each run of letters between dots, hyphens and digits stands in the hosts of all urls, top-level domains left
    out; those that are one in PART_SHARE or more."""
    runs = F.filter(F.split(F.regexp_extract(host_of(F.col(url)), r"^(.*)\.[^.]*$", 1), r"[^\p{L}]+"), lambda r: r != "")
    counts = pages.select(F.explode(runs).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    total = pages.agg(F.sum(F.size(runs))).first()[0] or 0
    return {r["part"]: r["n"] for r in counts.where(F.col("n") * PART_SHARE >= total).collect()}


def text_counts(texts: Sequence[str]) -> Counter:
    """In how many of the texts each word occurs."""
    return Counter(w for t in texts for w in set(_RUN.findall(t.lower())))


def train(pages: DataFrame, docs: DataFrame, labels: DataFrame, most: int = MAX_PER_CLASS) -> HostModel:
    """Host parts of all pages, and words of at most ``most`` labelled documents of each class."""
    rows, _ = labelled_texts(docs, labels, "toxic", most, FOLDS, HELD_FOLD)
    good, bad = (text_counts(rows.loc[rows["label"] == k, "text"].tolist()) for k in (0, 1))
    return HostModel(host_parts(pages), good, bad)


def judge(df: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, model: HostModel | None = None) -> DataFrame:
    """``df`` with host, path, rule, verdict, score (probability of block) and host_words added or replaced.

    Null urls and urls without ``://`` have an empty host and path and no words: allow, unless a rule is made for them.
    Each row is judged alone, so repeated rows have equal results, and urls are read whole however long. Of rules of equal length
    the last in order of domain and path wins; odds that are even block. An empty table gives no rows.
    """
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model or HostModel())

    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = shared.value
        # both caches are bounded; very long names are not kept
        cached = lru_cache(50_000)(lambda name, of_host: (own.host_words if of_host else own.path_words)(name))
        split = lambda name, of_host: cached(name, of_host) if len(name) < 200 else cached.__wrapped__(name, of_host)
        for hosts, paths in batches:
            words, scores = [], []
            for h, p in zip(hosts, paths, strict=True):
                w = split(h, True)
                x = own.log_odds([*w, *split(p, False)])
                words.append(" ".join(w))
                scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, x)))))
            yield pd.DataFrame({"score": scores, "host_words": words})

    out = df.drop("host", "path", "rule", "verdict", "score", "host_words")
    out = out.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    got = F.pandas_udf(scored, "score double, host_words string")(F.col("host"), F.col("path"))
    out = out.withColumn("rule", rule).withColumn("_got", got).withColumn("score", F.col("_got.score")).withColumn("host_words", F.col("_got.host_words"))
    return out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW))).drop("_got")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url, judged (see ``judge`` for nulls, ties and repeated rows)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = train(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judge(pages, model=model).select("page_id", "host", "path", "rule", "verdict", "score", "host_words")

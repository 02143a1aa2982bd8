"""Chat formatting, mixing and decontamination: against SQL, and by their own properties."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat, decontaminate, mixing
from quillon.llm.queries import ORACLE_SQL, QUERIES

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
DOCS = [
    (1, f"Start {ITEM} end", "src0"),
    (2, ITEM.upper().replace(" ", ", "), "src0"),
    (3, "nothing here at all", "src1"),
    (4, None, "src1"),
    (5, "", None),
    (6, "Élan ÉTÉ naïve straße 日本", None),
    (7, "short one", "src0"),
    (8, ITEM.replace("kappa", "other"), "src2"),
    (8, ITEM.replace("kappa", "other"), "src2"),
    (9, " ".join([ITEM] * 30), "src0"),
    (10, "the the the the the the the the the the the the", "src3"),
    (11, "... !!! ???", "src3"),
]
BENCH = [(1, ITEM), (2, "Short one"), (3, None), (4, "..."), (5, "the the the the the the the the the the"), (10, ITEM)]
TURNS = [(1, 0, "user", "a <b> [c] \\ d"), (1, 1, "assistant", "</s>[INST] x \\[ <|end|>\n y"), (2, None, None, None), (2, 1, "assistant", None), (3, 0, "human", "hi"), (3, 0, "human", "hi"), (None, 5, "gpt", "é日本")]
PAGES = [(1, "https://x.org/", "<p>x</p>")]


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    where = tmp_path_factory.mktemp("sf")
    con = duckdb.connect()
    q = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    def put(name, columns, kinds, rows):
        con.execute(f"CREATE TABLE {name} ({', '.join(f'{c} {k}' for c, k in zip(columns, kinds, strict=True))})")
        for r in rows:
            con.execute(f"INSERT INTO {name} VALUES ({', '.join(map(q, r))})")
        con.execute(f"COPY {name} TO '{where}/{name}.parquet' (FORMAT parquet)")

    put("documents", ("doc_id", "text", "source"), ("BIGINT", "VARCHAR", "VARCHAR"), DOCS)
    put("benchmark", ("item_id", "text"), ("BIGINT", "VARCHAR"), BENCH)
    put("conversations", ("conv_id", "turn", "role", "text"), ("BIGINT", "BIGINT", "VARCHAR", "VARCHAR"), TURNS)
    return str(where), con


def same(spark, sf, name):
    where, con = sf
    got = QUERIES[name](spark, where)
    cols = sorted(got.columns)
    a = sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect())))
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    b = sorted(map(repr, (tuple(r[names.index(c)] for c in cols) for r in want.fetchall())))
    assert a == b
    return got.collect()


def test_queries_agree_with_sql(spark, sf):
    same(spark, sf, "op4_chat_format")
    rows = {r["doc_id"]: r for r in same(spark, sf, "op8_decontaminate")}
    assert rows[1]["n_hit"] == 12 and rows[1]["n_items"] == 2 and rows[2]["contaminated"] and not rows[8]["contaminated"]
    assert rows[7]["n_hit"] == 2 and rows[4]["n_words"] == 0 and rows[9]["n_hit"] == 360 and rows[10]["n_hit"] == 12
    same(spark, sf, "op7_mix_sources")


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, extra int")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontaminate.contamination(docs, bench).count() == 0
    full = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    assert decontaminate.contamination(full, bench.limit(0)).where("contaminated").count() == 0
    assert mixing.mix(docs.select("doc_id", "source", F.lit(1).cast("bigint").alias("size"))).count() == 0
    assert chat.digest(chat.format_turns(chat.turns_from_columns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).count() == 0


def spans(text, item, width, slack):
    """(start, n, exact) of one item by looking at all places."""
    w, b = text.split(), item.split()
    out = set()
    for i in range(max(1, len(b) - width + 1)):
        win = b[i : i + width]
        out |= {(s, len(win), True) for s in range(len(w) - len(win) + 1) if w[s : s + len(win)] == win}
        need = Counter(win)
        for p in range(len(w)):
            if w[p] not in need:
                continue
            fits = [(z - a, a) for a in range(p + 1) for z in range(p + 1, min(len(w), a + len(win) + slack) + 1) if not need - Counter(w[a:z])]
            if fits:
                n, a = min(fits)
                out.add((a, n, w[a : a + n] == win))
    return out


def test_proximity(spark):
    """With repeated words and at both ends, against all spans."""
    rng = random.Random(8)
    texts = ["delta x alpha gamma beta", "alpha x x x x beta gamma delta", "a b", "x a b a b y a", "a a a b", "b a a", "", "a"]
    texts += [" ".join(rng.choice("a a b c d e f x y".split()) for _ in range(rng.choice((5, 30)))) for _ in range(40)]
    items = ["alpha beta gamma delta", "a a a b", "a b", "c d e f a", "b", "q", "a a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for width, slack in ((4, 1), (3, 2), (5, 0)):
        got = {}
        for r in decontaminate.matches(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), width=width, slack=slack).collect():
            got.setdefault((r["doc_id"], r["item_id"]), set()).add((r["start"], r["n"], r["exact"]))
            assert 0 <= r["start"] and r["start"] + r["n"] <= len(texts[r["doc_id"]].split())
        for d, t in enumerate(texts):
            for k, b in enumerate(items):
                want, have = spans(t, b, width, slack), got.get((d, k), set())
                # the shortest span around any word of the window, of which the search keeps those around its rarest word
                assert have <= want and {x for x in have if x[2]} == {x for x in want if x[2]} and bool(have) == bool(want), (t, b)


def test_every_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, source string, tid string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontaminate.contamination(docs, bench, slack=2).collect()}
    assert got[1] == 12 and got[9] == 360 and got[10] == 12 and got[3] == 0 and len(got) == 11


def test_very_long_documents_match(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000 + ITEM), (2, "word " * 300_000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.contamination(docs, spark.createDataFrame(BENCH[:1], "item_id long, text string"), slack=5).collect()}
    assert (rows[1]["n_words"], rows[1]["n_hit"], rows[1]["n_near"]) == (300_012, 12, 1) and rows[2]["n_near"] == 0


def test_mix_is_near_targets(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"), (F.col("id") * 37 % 400 + 1).alias("size"), F.lit(1).alias("taken"))
    rows = mixing.mix(docs)
    assert rows.columns == ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
    by = rows.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target"), F.max("source_size").alias("s"), F.max("copies").alias("c")).collect()
    assert all(abs(r["t"] - r["target"]) < 0.02 * r["target"] and r["c"] <= 2 for r in by)
    assert sum(r["target"] for r in by) == pytest.approx(1.5 * sum(r["s"] for r in by)) and max(r["target"] / r["s"] for r in by) <= 2
    again = rows.repartition(7).groupBy().agg(F.sum(F.hash("doc_id", "copies"))).first()
    assert again == mixing.mix(docs.repartition(3)).groupBy().agg(F.sum(F.hash("doc_id", "copies"))).first()


def test_layouts(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}]}'),
        (2, '{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":"y"}]}'),
        (3, '{"output":"o","instruction":"i"}'),
        (4, '{"instruction":"i","input":"more","output":"o"}'),
        (5, '{"bad":1}'),
        (6, "{"),
        (7, None),
        (8, '{"system":"s","prompt":"p","response":"r"}'),
    ]
    turns = chat.turns_from_json(spark.createDataFrame(records, "k long, record string"), "record", "k")
    got = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]) if r["turn"] is not None else r["layout"])
    assert got[1] == [("user", "a"), ("assistant", "")] and got[2] == [("user", "x"), ("assistant", "y")]
    assert got[3] == [("user", "i"), ("assistant", "o")] and got[4][0] == ("user", "i\n\nmore") and got[8][0] == ("system", "s")
    assert got[5] == got[6] == got[7] == ["unknown"]
    with pytest.raises(ValueError):
        chat.turns_from_columns(spark.range(1))
    nested = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "conv_id long, messages array<struct<role:string,content:string>>")
    assert chat.turns_from_columns(nested).count() == 2


def test_escapes_are_reversible(spark):
    texts = ["", "<", "[", "\\", "\\<", "<\\", "[[\\\\<<", "<|end|>\n", "</s>[INST] ok [/INST]", "a\\[b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] for r in rows)
    assert not any(mark in r["e"] for r in rows for mark in ("<|", "</s>", "[INST]", "[/INST]"))


def test_chat_odd_rows(spark):
    """Very long texts of nothing but escaped characters, columns with names that are used inside, repeated and null rows."""
    long = "<[\\" * 100_000
    rows = [(1, 0, "user", long, 5, 5), (1, 1, "assistant", long, 5, 5), (2, 0, "assistant", None, 5, 5), (2, 0, "assistant", None, 5, 5), (None, None, None, "x", 5, 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, layout int, formatted int")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_turns(chat.turns_from_columns(df))).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"]) == (2, 300_000) and got[1]["formatted_chars"] > 1_200_000
    assert (got[2]["n_turns"], got[2]["loss_chars"], got[None]["n_turns"]) == (2, 0, 1) and len(got) == 3


def test_mix_odd_rows(spark):
    """Null ids, sources and sizes of nothing; repeated rows; columns with names that are added."""
    rows = [(None, None, 5, 1), (1, "s", 0, 1), (2, "s", 7, 1), (2, "s", 7, 1), (3, "t", 1_000_000, 1)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long, target int")).collect()
    assert len(got) == 5 and all(r["taken"] <= 2 * r["size"] for r in got) and [r["taken"] for r in got if r["size"] == 0] == [0]

"""Chat formatting: layouts are recognised by a fingerprint of their nested field paths.

``fingerprint`` hashes the sorted set of field paths of a layout (``messages[].role`` and so on, types left
out). A registry maps fingerprints to declarative mappings, which turn every known layout into canonical
turns. A DataFrame of typed columns has one layout and is matched while the plan is built; a column of JSON
records may hold a different layout in each row, so its paths are derived and hashed row by row with
``schema_of_variant``. Everything is DataFrame expressions.

Canonical turns are rendered with a template whose control strings are broken up inside texts: one backslash
follows each of ``\\``, ``<`` and ``[``, so no control string survives in a text, and ``unescape`` takes exactly
those backslashes out again. The loss mask is kept as segments of the formatted text, each with a flag.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.runtime import table

TURN_OPEN, TURN_MID, TURN_CLOSE = "<|turn|>", "<|text|>", "<|end|>\n"
TRAINED_ROLE = "assistant"
TURN_TYPE = "struct<turn:bigint,role:string,text:string>"
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Layout:
    """One input layout: its field paths, and how it becomes turns.

    ``each``: the path of an array with one element a turn, or None where the record is one or two turns.
    ``turns``: for each turn (a role, or the path that holds it; the path of the text; a path of the turn's number).
    ``roles``: other names of roles and their canonical ones.
    """

    name: str
    paths: tuple[str, ...]
    each: str | None
    turns: tuple[tuple[str, str, str | None], ...]
    roles: tuple[tuple[str, str], ...] = ()


_ALIASES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

LAYOUTS: tuple[Layout, ...] = (
    Layout("turn_rows", ("conv_id", "role", "text", "turn"), None, (("$role", "text", "turn"),), _ALIASES),
    Layout("messages", ("messages[].content", "messages[].role"), "messages", (("$role", "content", None),), _ALIASES),
    Layout("sharegpt", ("conversations[].from", "conversations[].value"), "conversations", (("$from", "value", None),), _ALIASES),
    Layout("instruction", ("instruction", "output"), None, (("user", "instruction", None), ("assistant", "output", None))),
    Layout("instruction_input", ("input", "instruction", "output"), None, (("user", "instruction\n\ninput", None), ("assistant", "output", None))),
    Layout("prompt_completion", ("completion", "prompt"), None, (("user", "prompt", None), ("assistant", "completion", None))),
    Layout("prompt_response", ("prompt", "response"), None, (("user", "prompt", None), ("assistant", "response", None))),
    Layout("system_prompt_response", ("prompt", "response", "system"), None, (("system", "system", None), ("user", "prompt", None), ("assistant", "response", None))),
)


def fingerprint(paths) -> str:
    """The hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """The leaf paths of a schema; an array adds ``[]`` to its path, a map ``{}``."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{prefix}[]")
    if isinstance(schema, T.MapType):
        return schema_paths(schema.valueType, f"{prefix}{{}}")
    return [prefix]


def _json_shape(layout: Layout) -> str:
    """What schema_of_variant reports for a layout once leaf types are dropped."""
    if layout.each:
        return f"{layout.each}:[{','.join(sorted(p.split('.', 1)[1] for p in layout.paths))}]"
    return ",".join(sorted(layout.paths))


def json_fingerprint(record: Column) -> Column:
    """The same fingerprint for a column of JSON records; null where a record is not a JSON object."""
    kind = F.schema_of_variant(F.try_parse_json(record))
    # OBJECT<a: BIGINT, b: ARRAY<OBJECT<c: STRING>>>: leave names, arrays of objects as name:[...], other types out
    flat = F.regexp_replace(kind, r"ARRAY<OBJECT<([^<>]*)>>", "[$1]")
    flat = F.regexp_replace(flat, r": (?:STRING|VOID|BIGINT|BOOLEAN|DOUBLE|FLOAT|VARIANT|DECIMAL\(\d+,\d+\))", "")
    flat = F.regexp_extract(flat, r"^OBJECT<(.*)>$", 1)
    flat = F.replace(F.replace(flat, F.lit(", "), F.lit(",")), F.lit(": ["), F.lit(":["))
    return F.when(flat != "", F.substring(F.sha2(flat, 256), 1, 16))


def _role(value: Column, roles: tuple[tuple[str, str], ...]) -> Column:
    out = F.coalesce(value, F.lit(""))
    for old, new in roles:
        out = F.when(value == old, F.lit(new)).otherwise(out)
    return out


def _element(who: str, what: str, roles: tuple[tuple[str, str], ...]):
    """Makes a turn of an array's element."""
    return lambda m, i: F.struct(i.cast("bigint").alias("turn"), _role(m[who[1:]], roles).alias("role"), F.coalesce(m[what], F.lit("")).alias("text"))


def _texts(path: str, get) -> Column:
    parts = path.split("\n\n")
    if len(parts) == 1:
        return F.coalesce(get(path), F.lit(""))
    first, rest = get(parts[0]), get(parts[1])
    return F.concat(F.coalesce(first, F.lit("")), F.when(F.coalesce(rest, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("\n\n"), rest)))


def turns_from_json(df: DataFrame, record: str, key: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, layout, turn, role, text): the turns of JSON records of any known layouts.

    Rows of an unknown layout, of broken JSON and null rows give no turns, but one row with layout ``unknown``
    and null turn, so that they can be counted.
    """
    usable = [x for x in layouts if x.name != "turn_rows"]
    mark = json_fingerprint(F.col(record))
    shapes = {hashlib.sha256(_json_shape(x).encode()).hexdigest()[:16]: x for x in usable}
    parsed = F.try_parse_json(F.col(record))
    turns = F.lit(None).cast(f"array<{TURN_TYPE}>")
    name = F.lit(UNKNOWN)
    for h, x in shapes.items():
        if x.each:
            who, what, _ = x.turns[0]
            items = F.try_variant_get(parsed, f"$.{x.each}", "array<map<string,string>>")
            made = F.transform(items, _element(who, what, x.roles))
        else:
            get = lambda p, parsed=parsed: F.try_variant_get(parsed, f"$.{p}", "string")
            made = F.array(*(F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(who).alias("role"), _texts(what, get).alias("text")) for i, (who, what, _) in enumerate(x.turns)))
        turns = F.when(mark == h, made).otherwise(turns)
        name = F.when(mark == h, F.lit(x.name)).otherwise(name)
    got = df.select(F.col(key).alias("conv_id"), name.alias("layout"), turns.alias("_turns"))
    return got.select("conv_id", "layout", F.explode_outer("_turns").alias("_t")).select("conv_id", "layout", "_t.turn", "_t.role", "_t.text")


def turns_from_columns(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, names: Mapping[str, str] | None = None) -> DataFrame:
    """(conv_id, layout, turn, role, text) from a DataFrame of typed columns whose layout is known.

    ``names`` maps columns to the names of the layout; columns that it leaves out keep theirs. Columns that no
    layout asks for are ignored if the rest has a known fingerprint. An unknown layout is a ValueError.
    """
    names = dict(names or {})
    df = df.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns))
    have = schema_paths(df.schema)
    known = {fingerprint(x.paths): x for x in layouts}
    layout = known.get(fingerprint(have))
    if layout is None:
        inside = [x for x in layouts if set(x.paths) <= set(have)]
        if not inside:
            raise ValueError(f"no layout has the field paths {sorted(have)}")
        layout = known[fingerprint(max(inside, key=lambda x: len(x.paths)).paths)]
    key = F.col("conv_id") if "conv_id" in df.columns else F.lit(None).cast("bigint")
    get = lambda p: F.col(p).cast("string")
    if layout.each:
        who, what, _ = layout.turns[0]
        made = F.transform(F.col(layout.each), _element(who, what, layout.roles))
        return df.select(key.alias("conv_id"), F.explode_outer(made).alias("_t")).select("conv_id", F.lit(layout.name).alias("layout"), "_t.turn", "_t.role", "_t.text")
    if len(layout.turns) == 1:
        who, what, no = layout.turns[0]
        return df.select(key.alias("conv_id"), F.lit(layout.name).alias("layout"), F.col(no).cast("bigint").alias("turn"), _role(F.col(who[1:]), layout.roles).alias("role"), _texts(what, get).alias("text"))
    made = F.array(*(F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(who).alias("role"), _texts(what, get).alias("text")) for i, (who, what, _) in enumerate(layout.turns)))
    return df.select(key.alias("conv_id"), F.explode(made).alias("_t")).select("conv_id", F.lit(layout.name).alias("layout"), "_t.turn", "_t.role", "_t.text")


def escape(text: Column) -> Column:
    """Puts a backslash after each backslash, ``<`` and ``[``: no control string is left whole."""
    return F.regexp_replace(text, r"[\\<\[]", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, segments, formatted) from canonical turns.

    ``segments`` is array<struct<text,loss>>; their texts joined are ``formatted``, and those with ``loss`` are
    what the loss covers: the escaped text of each assistant turn, without its markers. Turns are ordered by
    turn (null first), role and text, so rows with the same number have a fixed order and repeated rows stay.
    Escaping happens before the turns of a conversation meet; their meeting in one row is what formatting a
    conversation means, and its size is that of the conversation.
    """
    escaped = turns.select("conv_id", F.struct(F.coalesce(F.col("turn"), F.lit(-(2**63)).cast("bigint")).alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("plain"), escape(F.coalesce(F.col("role"), F.lit(""))).alias("who"), escape(F.coalesce(F.col("text"), F.lit(""))).alias("what")).alias("t"))
    whole = escaped.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    part = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("ts", lambda t: F.array(part(F.concat(F.lit(TURN_OPEN), t["who"], F.lit(TURN_MID)), F.lit(False)), part(t["what"], t["role"] == TRAINED_ROLE), part(F.lit(TURN_CLOSE), F.lit(False)))))
    return whole.select("conv_id", segments.alias("segments")).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse_formatted(formatted: Column) -> Column:
    """array<struct<role,text>>: the turns, read back from the formatted text alone."""
    pieces = F.split(formatted, F.lit(r"<\|end\|>\n"))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    halves = F.transform(pieces, lambda p: F.split(F.substring(p, len(TURN_OPEN) + 1, 2**31 - 1), F.lit(r"<\|text\|>")))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, from ``formatted`` and ``segments`` only."""
    back = formatted.select("conv_id", "formatted", parse_formatted(F.col("formatted")).alias("ts"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss"))
    return back.select(
        "conv_id",
        F.size("ts").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations (typed rows by turn) and conversation -7 (a JSON record of messages), formatted and read back."""
    rows = turns_from_columns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    text = "</s>[INST] ok [/INST]"
    record = '{"messages":[{"role":"user","content":"%s"},{"role":"assistant","content":"%s"}]}' % (text, text)
    extra = turns_from_json(spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(record).alias("record")), "record", "conv_id")
    return digest(format_turns(rows.unionByName(extra)))


OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE coalesce(role, '') END AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(role, '[\\<\[]', '\0\\', 'g') AS who, regexp_replace(text, '[\\<\[]', '\0\\', 'g') AS what FROM t
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(who) + length(what) + length('<|turn|>') + length('<|text|>') + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

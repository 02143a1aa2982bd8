"""Cells, labels and statements as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that decide how cells, labels and statements are read.
GROUP_WORDS = ("小计", "分组小计", "subtotal", "sub-total", "sub total")
TOTAL_WORDS = ("合计", "总计", "总和", "累计", "汇总", "共计", "总额", "总数", "grand total", "total", "sum")
RATIO_WORDS = ("占比", "比例", "同比", "环比", "增长", "率", "percent", "rate", "%", "share")
BLANKS = ("", "-", "--", "—", "－", "/", "n/a", "na", "null", "none", "无", "不适用")
DOWN_WORDS = ("下降", "下滑", "下跌", "减少", "降低", "回落", "走低", "负增长", "缩小", "下调", "损失")
UP_WORDS = ("上升", "上涨", "增长", "提升", "增加", "走高", "提高", "扩大", "上调", "正增长", "新增")
CAUSAL_WORDS = ("导致", "造成了", "引起了", "证明", "根因已确定", "确定了根因", "确认了根因", "根因是")
# English statements are read by these, besides.
DOWN_WORDS_EN = ("fell", "falls", "dropped", "decreased", "declined", "down by", "lower")
UP_WORDS_EN = ("rose", "rises", "grew", "increased", "climbed", "up by", "higher")
CAUSAL_WORDS_EN = ("caused", "because of", "proves", "led to")
CURRENCY = r"[\s,￥$¥€£元人民币:]"
PERCENT_KEY = r"率|占比|比例|share|rate|ratio|percent|%"
POINT_KEY = r"百分点|百分比点|绝对差|差值|delta|change|diff|pp\b"
LABEL_NUMBER = r"(?:第|分组|组|阶段|步骤|序号|章节?|表|图|方案|选项|[Gg]roup|[Cc]hapter|[Ss]tep|[Tt]able|[Ff]igure)\s*(\d+(?:\.\d+)?)"
DATE = r"\d{4}\s*年(?:\s*\d{1,2}\s*月(?:\s*\d{1,2}\s*日)?)?|\d{4}[-/]\d{1,2}(?:[-/]\d{1,2})?|\d{1,2}\s*月(?:\s*\d{1,2}\s*日)?|\d{1,2}\s*季度|\b\d{1,2}[-/]\d{1,2}\b"
NUMBER = r"(?<![\w.])([+\-−])?\s*(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(%|个百分点|个百分點|pp|pct)?(?![\w.])"

def _compatible() -> tuple[str, str]:
    """Characters that compatibility composition turns into one other character, and those characters."""
    pairs = [(chr(c), to) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and len(to := unicodedata.normalize("NFKC", chr(c))) == 1 and to != chr(c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _compatible()
#: All white space and format marks that stand at the ends of cells.
_ENDS = r"^[\s\p{Z}\x1C-\x1F\x85]+|[\s\p{Z}\x1C-\x1F\x85]+$"


def normalize_text(c: Column) -> Column:
    """Compatibility forms (full-width, superscript, no-break and the like) made plain, one character for one, and white space
    at the ends removed; null is empty. Characters that stand for several, such as fractions, stay."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _FROM, _TO)).otherwise(text)
    return F.regexp_replace(plain, _ENDS, "")


def is_blank(c: Column) -> Column:
    return F.lower(normalize_text(c)).isin(*BLANKS)


def parse_money(c: Column) -> Column:
    """struct(number, is_percent) of a cell: separators, currency marks, brackets for negatives; anything else is null.

    A percentage keeps its written size.
    """
    t = normalize_text(c)
    negative = t.startswith("(") & t.endswith(")") & (F.length(t) > 2)
    inner = F.when(negative, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    clean = F.regexp_replace(inner, CURRENCY, "")
    digits = F.regexp_extract(clean, r"^([-+]?\d+(?:\.\d+)?)(?:%|个百分点|个百分點)?$", 1)
    number = F.when(F.lower(t).isin(*BLANKS) | (digits == ""), F.lit(None).cast("double")).otherwise(digits.try_cast("double"))
    return F.struct(F.when(negative, -F.abs(number)).otherwise(number).alias("number"), (number.isNotNull() & inner.contains("%")).alias("is_percent"))


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def summary_level(c: Column) -> Column:
    """group, total or null for a label; ratio words rule both out."""
    return F.when((c == "") | has_any(c, RATIO_WORDS), F.lit(None).cast("string")).when(has_any(c, GROUP_WORDS), "group").when(has_any(c, TOTAL_WORDS), "total")


def strip_summary_words(c: Column) -> Column:
    out = c
    for w in (*GROUP_WORDS, *TOTAL_WORDS):
        out = F.regexp_replace(out, rf"(?i)\Q{w}\E", "")
    return normalize_text(out)


def statement_numbers(c: Column) -> Column:
    """array<struct<value,unit,sign,raw>>: the numbers of a statement, those of dates left out."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), DATE, " ")

    def made(x):
        raw = F.trim(x)
        first = F.substring(raw, 1, 1)
        sign = F.when(first.isin("-", "−"), -1).when(first == "+", 1)
        value = F.regexp_replace(raw, r"[^0-9.]", "").try_cast("double")
        tail = F.lower(raw)
        unit = F.when(tail.endswith("%") | tail.endswith("pct"), "percent").when(tail.endswith("pp") | raw.endswith("个百分点") | raw.endswith("个百分點"), "pp").otherwise("raw")
        return F.struct(F.when(sign == -1, -value).otherwise(value).alias("value"), unit.alias("unit"), sign.alias("sign"), raw.alias("raw"))

    # one pass of the pattern; what it found is short
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), made)


def label_numbers(c: Column) -> Column:
    """Numbers that name something: group 3, chapter 1."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(LABEL_NUMBER), F.lit(1)), lambda x: x.try_cast("double"))


def direction(c: Column) -> Column:
    """down, up, or null where a statement has both or neither."""
    down, up = has_any(c, DOWN_WORDS + DOWN_WORDS_EN), has_any(c, UP_WORDS + UP_WORDS_EN)
    return F.when(down & ~up, "down").when(up & ~down, "up")


def unit_of_key(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.rlike(POINT_KEY), "pp").when(low.rlike(PERCENT_KEY), "percent").otherwise("raw")

"""Headers, column names and field roles of text tables, from their first rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from quillon.config import InputError

# What a field's name has to contain to be taken for a role.
ROLE_WORDS = {
    "date": ["日期", "时间", "date", "datetime", "timestamp", "day"],
    "visitors": ["访问用户", "访客", "访问量", "uv", "visitor", "visit"],
    "registered": ["注册用户", "注册数", "register", "signup"],
    "browse": ["浏览用户", "商品浏览", "浏览数", "browse", "view"],
    "cart": ["加购用户", "加购数", "购物车", "cart"],
    "pay_start": ["发起支付用户", "发起支付人数", "支付发起用户", "pay_start_count", "checkout_count"],
    "pay_success": ["支付成功用户", "支付成功人数", "付款成功用户", "pay_success_count", "paid_count"],
    "pay_fail": ["支付失败用户", "支付失败人数", "付款失败", "pay_fail", "failed"],
    "success_rate": ["支付成功率", "付款成功率", "success_rate", "payment_success_rate"],
    "register_rate": ["注册转化率", "注册率", "register_rate", "signup_rate"],
    "browse_rate": ["浏览转化率", "browse_rate", "view_rate"],
    "cart_rate": ["加购转化率", "加购率", "cart_rate"],
    "pay_start_rate": ["发起支付率", "支付发起率", "pay_start_rate", "checkout_rate"],
    "gateway_availability": ["支付网关可用率", "网关可用率", "gateway", "availability"],
    "inventory_availability": ["库存可售率", "库存可用率", "inventory"],
    "peak_index": ["订单峰值指数", "峰值指数", "peak_index", "peak"],
    "delay_minutes": ["数据延迟", "链路延迟", "延迟分钟", "delay", "latency"],
    "missing_rate": ["字段缺失率", "缺失率", "missing_rate", "null_rate"],
    "missing_count": ["字段缺失数", "缺失数", "missing_count", "null_count"],
    "risk_block_rate": ["风控拦截率", "拦截率", "risk_block", "block_rate"],
    "route": ["支付路由", "路由", "route"],
    "activity": ["活动", "版本", "策略", "活动/版本", "campaign", "version", "strategy"],
    "channel": ["渠道", "channel", "来源", "source", "投放渠道"],
    "device": ["设备", "device", "终端"],
    "region": ["地区", "区域", "region", "城市", "city"],
    "user_id": ["用户id", "用户 ID", "userid", "user_id", "uid"],
    "variant": ["实验组", "对照组", "分组", "variant", "treatment", "control"],
}
COUNT_ROLES = ("visitors", "registered", "browse", "cart", "pay_start", "pay_success", "pay_fail")
RATE_MARK = "率"

_NUMBER = re.compile(r"[-+]?\d+(\.\d+)?")


_plain = lambda name: name.lower().replace(" ", "")
#: One pattern a role, over names without spaces.
_MATCHERS = {role: re.compile("|".join(map(re.escape, map(_plain, words)))) for role, words in ROLE_WORDS.items()}


def role_matches(column: str, role: str) -> bool:
    """Whether a column's name has a word of a role; a rate is no count."""
    found = _MATCHERS[role].search(_plain(column)) if role in _MATCHERS else None
    return found is not None and not (role in COUNT_ROLES and RATE_MARK in column)


def infer_roles(columns: Sequence[str]) -> dict[str, list[str]]:
    """The columns that fit each role, roles without any left out."""
    return {role: got for role in ROLE_WORDS if (got := [c for c in columns if role_matches(c, role)])}


def unique_names(raw: Sequence[str | None]) -> list[str]:
    """White space collapsed, empty names numbered, repeated ones suffixed ``__2`` and on."""
    out, taken = [], {}
    for i, name in enumerate(raw):
        name = " ".join((name or "").split()) or f"unnamed_{i + 1}"
        taken[name] = taken.get(name, 0) + 1
        out.append(name if taken[name] == 1 else f"{name}__{taken[name]}")
    return out


def header_row(rows: Sequence[Sequence[str | None]], scan: int = 15) -> int:
    """The likeliest header among the first rows: many distinct cells, most of them no numbers; ties go to the top."""
    best, best_key = 0, None
    for i, row in enumerate(rows[:scan]):
        cells = [c.strip() for c in row if c and c.strip()]
        if len(cells) < 2:
            continue
        words = sum(not _NUMBER.fullmatch(c) for c in cells)
        key = (words * 2 > len(cells), 2 * len(cells) + 2 * len(set(cells)) + 0.5 * words)
        if best_key is None or key > best_key:
            best, best_key = i, key
    return best


def choose_date_field(parse_rates: dict[str, float], numeric: Sequence[str] = ()) -> str | None:
    """A column named like a date of which half parses, else the one that parses best, from four fifths up. Numbers are no dates."""
    usable = {c: r for c, r in parse_rates.items() if c not in numeric}
    for c, r in usable.items():
        if role_matches(c, "date") and r >= 0.5:
            return c
    best = max(usable, key=lambda c: usable[c], default=None)
    return best if best is not None and usable[best] >= 0.8 else None


def choose_main_table(stats: dict[str, dict]) -> str:
    """The table that looks most like the main one. ``stats``: date_field, unique_day_ratio, rows and numeric_columns by name."""
    if not stats:
        raise InputError("there are no tables")

    def score(name: str) -> tuple[float, str]:
        s = stats[name]
        dated = bool(s.get("date_field"))
        ratio, rows = s.get("unique_day_ratio", 0.0), s.get("rows", 0)
        points = 5.0 * dated + 8.0 * (dated and ratio >= 0.8 and rows >= 14) - 4.0 * (dated and ratio < 0.5 and rows > 100)
        return points + s.get("numeric_columns", 0) + min(rows, 100) / 10000, name

    return max(stats, key=score)

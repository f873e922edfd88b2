"""The attribute language: parsed on the driver, compiled to one column, so filters push down and stay in generated code.

    expression = all of "a | b", "a & b", "!a", "(a)", "tag", "tag=v", "tag!=v", "tag=*", "tag!=*", "tag~regex", "tag>1"

Attributes are a map of strings. A missing tag is unequal to everything, absent for *, and fails
every other test; logic is two-valued.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<op>!=|>=|<=|[|&!()=~<>])|(?P<quoted>\"[^\"]*\"|'[^']*')|(?P<word>[^\s|&!()=~<>\"']+))")
_SQL_TOKEN = re.compile(r"(?P<quoted>\"[^\"]*\"?|'[^']*'?)|(?P<op>!=|<>|>=|<=|=|>|<)|(?P<word>[^\s\"'=!<>]+)")
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
COMPARISONS = ("=", "!=", "~", ">", "<", ">=", "<=")


@dataclass(frozen=True)
class Test:
    """A comparison of a tag; op is one of COMPARISONS, or exists or absent."""

    tag: str
    op: str
    value: str = ""


@dataclass(frozen=True)
class Many:
    """All (&) or any (|) of some expressions; all of none matches everything."""

    op: str
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


EVERYTHING = Many("&", ())


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r} in {text!r}")
        kind = m.lastgroup or ""
        out.append(("word", m[kind].strip("\"'")) if kind != "op" else ("op", m["op"]))
        at = m.end()
    return out


def parse(text: str):
    """The expression of a text; an empty one matches everything. ValueError says what is wrong."""
    todo = tokens(text or "")
    if not todo:
        return EVERYTHING

    def take(op: str) -> bool:
        if todo and todo[0] == ("op", op):
            todo.pop(0)
            return True
        return False

    def many(op: str, below):
        parts = [below()]
        while take(op):
            parts.append(below())
        return parts[0] if len(parts) == 1 else Many(op, tuple(parts))

    def unary():
        if take("!"):
            return Not(unary())
        if take("("):
            inner = many("|", conjunction)
            if not take(")"):
                raise ValueError(f"a bracket is not closed in {text!r}")
            return inner
        if not todo or todo[0][0] != "word":
            raise ValueError(f"a tag is missing in {text!r}")
        tag = todo.pop(0)[1]
        if todo and todo[0][0] == "op" and todo[0][1] in COMPARISONS:
            op = todo.pop(0)[1]
            if not todo or todo[0][0] != "word":
                raise ValueError(f"a value is missing after {tag}{op} in {text!r}")
            value = todo.pop(0)[1]
            if value == "*" and op in ("=", "!="):
                return Test(tag, "exists" if op == "=" else "absent")
            if op in (">", "<", ">=", "<=") and not re.match(_NUMBER, value):
                raise ValueError(f"{value!r} is no number in {text!r}")
            return Test(tag, op, value)
        return EVERYTHING if tag == "*" else Test(tag, "exists")

    def conjunction():
        return many("&", unary)

    whole = many("|", conjunction)
    if todo:
        raise ValueError(f"{todo[0][1]!r} is left over in {text!r}")
    return whole


def parse_sql_like(text: str):
    """The other front-end: "tag" op value, joined by AND and, weaker, OR; a tag alone tests its presence.

    ELSE, empty text, functions such as $length, and comparisons by size with what is no number
    match everything.
    """
    words = [(m["op"] or m["word"] or m["quoted"][1:-1], m["quoted"] is None) for m in _SQL_TOKEN.finditer(text or "")]
    if not words or (len(words) == 1 and words[0][0].upper() == "ELSE"):
        return EVERYTHING

    def split(some: list, word: str) -> list[list]:
        out: list[list] = [[]]
        for token, bare in some:
            if bare and token.upper() == word:
                out.append([])
            else:
                out[-1].append((token, bare))
        return out

    def test(some: list):
        if len(some) == 1:
            return Test(some[0][0], "exists")
        if len(some) < 3 or some[0][0].startswith("$"):
            return EVERYTHING
        tag, op, value = (token for token, _ in some[:3])
        op = "!=" if op == "<>" else op
        if op not in ("=", "!=") and not (op in COMPARISONS and re.match(_NUMBER, value)):
            return EVERYTHING
        return Test(tag, op, value)

    def many(op: str, parts: list):
        return parts[0] if len(parts) == 1 else Many(op, tuple(parts))

    return many("|", [many("&", [test(part) for part in split(group, "AND")]) for group in split(words, "OR")])


def compiled(node, attrs: Column) -> Column:
    """The expression as a Boolean column that is never null."""
    if isinstance(node, Not):
        return ~compiled(node.part, attrs)
    if isinstance(node, Many):
        out = F.lit(node.op == "&")
        for i, part in enumerate(node.parts):
            one = compiled(part, attrs)
            out = one if i == 0 else out & one if node.op == "&" else out | one
        return out
    value = F.try_element_at(attrs, F.lit(node.tag))
    if node.op == "exists":
        return value.isNotNull()
    if node.op == "absent":
        return value.isNull()
    if node.op == "=":
        return F.coalesce(value == node.value, F.lit(False))
    if node.op == "!=":
        return F.coalesce(value != node.value, F.lit(True))
    if node.op == "~":
        return F.coalesce(value.rlike("(?U)" + node.value), F.lit(False))
    number = F.when(value.rlike(_NUMBER), value.try_cast("double"))
    limit = float(node.value)
    tested = {">": number > limit, "<": number < limit, ">=": number >= limit, "<=": number <= limit}[node.op]
    return F.coalesce(tested, F.lit(False))


def first_match(rules: Iterable[tuple[str, object]], attrs: Column) -> Column:
    """The value of the first rule (expression, value) that matches, as one CASE; null if none does."""
    out = None
    for text, value in rules:
        test = compiled(parse(text), attrs)
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.lit(None) if out is None else out


def rule_rows(spark, rules: Iterable[dict]):
    """Rule dictionaries (match, styles by zoom) as rows rule_pos, match, zoom, color, width, opacity; zoom null is the default."""
    rows = []
    for pos, rule in enumerate(rules):
        parse(rule.get("match", ""))
        for zoom, style in sorted(rule.get("styles", {None: {}}).items(), key=lambda x: -1 if x[0] is None else x[0]):
            rows.append((pos, rule.get("match", ""), zoom, style.get("color"), float(style.get("width", 1.0)), float(style.get("opacity", 1.0))))
    return spark.createDataFrame(rows, "rule_pos int, match string, zoom int, color string, width double, opacity double")

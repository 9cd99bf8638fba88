"""Rules as data: ordered categories, decision tables, tag filters, a small predicate language, evidence gates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The category of the first pattern that is found in a text, without regard to case."""
    out = F.lit(otherwise)
    for pattern, category in reversed(rules):
        out = F.when(text.rlike(f"(?i){pattern}"), F.lit(category)).otherwise(out)
    return out


def every_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The distinct categories of all patterns found in a text, in the order of the rules."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(c)) for p, c in rules])))


def decide(df: DataFrame, table: list[dict[str, str | None]], inputs: list[str], out: str) -> DataFrame:
    """``out`` of the first row of a decision table whose inputs agree; None in the table agrees with anything."""
    pick = F.lit(None).cast("string")
    for row in reversed(table):
        ok = F.lit(True)
        for c in inputs:
            if row[c] is not None:
                ok = ok & F.col(c).eqNullSafe(F.lit(row[c]))
        pick = F.when(ok, F.lit(row[out])).otherwise(pick)
    return df.withColumn(out, pick)


def has_tags(tags: Column, wanted: str) -> Column:
    """Tags 'group:a|b group2:c': any of a group, all groups.  An empty text is always met."""
    ok = F.lit(True)
    for group in wanted.split():
        name, _, values = group.partition(":")
        ok = ok & F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(f"{name}:{v}") for v in values.split("|")])), F.lit(False))
    return ok


def at_least(flags: list[Column], n: int) -> Column:
    """Whether ``n`` of the flags hold; null doesn't."""
    return sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags), F.lit(0)) >= n


_TOKEN = re.compile(r"\s*(?:(\()|(\))|(,)|(and|or|not|in)\b|(==|!=|<=|>=|<|>)|'([^']*)'|(-?\d+(?:\.\d+)?)|([A-Za-z_]\w*))")


def predicate(text: str, columns: list[str]) -> Column:
    """A condition such as ``phase == 'Primary' and (pupils > 100 or status in ('Open', 'New'))`` as an expression.

    Only the named columns, literals, comparisons, ``in``, and, or, not and brackets are understood; anything else is an
    error, so a rule from a file can't run anything.
    """
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:]!r}")
        at = m.end()
        tokens.append((m.lastindex, m.group(m.lastindex)))
    pos = 0

    def peek(kind: int, value: str | None = None) -> bool:
        return pos < len(tokens) and tokens[pos][0] == kind and (value is None or tokens[pos][1] == value)

    def take(kind: int, value: str | None = None) -> str:
        nonlocal pos
        if not peek(kind, value):
            raise ValueError(f"unexpected {tokens[pos][1] if pos < len(tokens) else 'end'!r}")
        pos += 1
        return tokens[pos - 1][1]

    def literal() -> Column:
        if peek(6):
            return F.lit(take(6))
        return F.lit(float(take(7)))

    def comparison() -> Column:
        if peek(4, "not"):
            take(4)
            return ~comparison()
        if peek(1):
            take(1)
            inner = either()
            take(2)
            return inner
        name = take(8)
        if name not in columns:
            raise ValueError(f"no column {name}")
        if peek(4, "in"):
            take(4)
            take(1)
            values = [literal()]
            while peek(3):
                take(3)
                values.append(literal())
            take(2)
            return F.col(name).isin(*values)
        if not peek(5):
            return F.coalesce(F.col(name).cast("boolean"), F.lit(False))
        op, right, left = take(5), literal(), F.col(name)
        return {"==": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]

    def both() -> Column:
        c = comparison()
        while peek(4, "and"):
            take(4)
            c = c & comparison()
        return c

    def either() -> Column:
        c = both()
        while peek(4, "or"):
            take(4)
            c = c | both()
        return c

    out = either()
    if pos != len(tokens):
        raise ValueError(f"unexpected {tokens[pos][1]!r}")
    return F.coalesce(out, F.lit(False))

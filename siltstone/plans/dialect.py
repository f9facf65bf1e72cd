"""One text rule, three engines: Spark columns, Python strings in an Arrow UDF, and the SQL text that checks both."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that patterns are written with, so that they stay short.
_SIGNS = {
    "·": r"\s+",
    "°": r"\s*",
    "¤": r"(\w+)",
    "§": "[\"']([^\"']+)[\"']",
    "¶": r";?\s*$",
    "¢": r"(?:const|let|var)",
    "£": r"\{?\s*$",
}


def rx(pattern: str) -> str:
    for sign, text in _SIGNS.items():
        pattern = pattern.replace(sign, text)
    return pattern


class SparkText:
    """Expressions over Spark columns."""

    @staticmethod
    def lit(s: str) -> Column:
        return F.lit(s)

    @staticmethod
    def cat(*xs) -> Column:
        return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))

    @staticmethod
    def extract(x: Column, pattern: str, group: int) -> Column:
        return F.regexp_extract(x, pattern, group)

    @staticmethod
    def has(x: Column, pattern: str) -> Column:
        return x.rlike(pattern)

    @staticmethod
    def sub(x: Column, pattern: str, by: str = "") -> Column:
        return F.regexp_replace(x, pattern, by)

    @staticmethod
    def choose(cases, other) -> Column:
        other = F.lit(other) if isinstance(other, (str, int)) else other
        out = None
        for when, then in cases:
            then = F.lit(then) if isinstance(then, (str, int, float)) else then
            out = F.when(when, then) if out is None else out.when(when, then)
        return out.otherwise(other)

    @staticmethod
    def eq(x: Column, s) -> Column:
        return x == s

    @staticmethod
    def starts(x: Column, s: str) -> Column:
        return x.startswith(s)

    @staticmethod
    def left(x: Column, n) -> Column:
        return F.substring(x, 1, n)

    @staticmethod
    def sub_at(x: Column, start, n) -> Column:
        return F.substr(x, start if isinstance(start, Column) else F.lit(start), n if isinstance(n, Column) else F.lit(n))

    @staticmethod
    def find(x: Column, y: Column) -> Column:
        return F.instr(x, y)

    @staticmethod
    def length(x: Column) -> Column:
        return F.length(x)

    @staticmethod
    def both(a: Column, b: Column) -> Column:
        return a & b

    @staticmethod
    def either(a: Column, b: Column) -> Column:
        return a | b

    @staticmethod
    def member(x: Column, values) -> Column:
        return x.isin(*values)


class Plain:
    """The same worked out on Python strings, for Arrow UDFs; patterns are ASCII's, as Java's are."""

    @staticmethod
    def _find(x: str, pattern: str):
        return compiled(pattern).search(x)

    lit = str

    @staticmethod
    def cat(*xs) -> str:
        return "".join(xs)

    @classmethod
    def extract(cls, x: str, pattern: str, group: int) -> str:
        m = cls._find(x, pattern)
        return (m[group] or "") if m else ""

    @classmethod
    def has(cls, x: str, pattern: str) -> bool:
        return cls._find(x, pattern) is not None

    @staticmethod
    def sub(x: str, pattern: str, by: str = "") -> str:
        return compiled(pattern).sub(by, x)

    @staticmethod
    def choose(cases, other):
        return next((then for when, then in cases if when), other)

    @staticmethod
    def eq(x, s) -> bool:
        return x == s

    @staticmethod
    def starts(x: str, s: str) -> bool:
        return x.startswith(s)

    @staticmethod
    def left(x: str, n: int) -> str:
        return x[:n]

    @staticmethod
    def sub_at(x: str, start: int, n: int) -> str:
        return x[start - 1 : start - 1 + max(0, n)]

    @staticmethod
    def find(x: str, y: str) -> int:
        return x.find(y) + 1

    @staticmethod
    def length(x: str) -> int:
        return len(x)

    @staticmethod
    def both(a: bool, b: bool) -> bool:
        return a and b

    @staticmethod
    def either(a: bool, b: bool) -> bool:
        return a or b

    @staticmethod
    def member(x: str, values) -> bool:
        return x in values


@cache
def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


class DuckText:
    """The same as SQL text."""

    @staticmethod
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    @classmethod
    def cat(cls, *xs) -> str:
        return "(" + " || ".join(x.sql if isinstance(x, Sql) else cls.lit(x) for x in xs) + ")"

    @classmethod
    def extract(cls, x, pattern, group):
        return f"regexp_extract({x}, {cls.lit(pattern)}, {group})"

    @classmethod
    def has(cls, x, pattern):
        return f"regexp_matches({x}, {cls.lit(pattern)})"

    @classmethod
    def sub(cls, x, pattern, by=""):
        return f"regexp_replace({x}, {cls.lit(pattern)}, {cls.lit(by)}, 'g')"

    @classmethod
    def choose(cls, cases, other):
        say = lambda v: v.sql if isinstance(v, Sql) else cls.lit(v) if isinstance(v, str) else str(v)
        return "CASE " + " ".join(f"WHEN {w} THEN {say(t)}" for w, t in cases) + f" ELSE {say(other)} END"

    @classmethod
    def eq(cls, x, s):
        return f"({x} = {cls.lit(s) if isinstance(s, str) and not isinstance(s, Sql) else s})"

    @classmethod
    def starts(cls, x, s):
        return f"starts_with({x}, {cls.lit(s)})"

    @staticmethod
    def left(x, n):
        return f"substr({x}, 1, {n})"

    @staticmethod
    def sub_at(x, start, n):
        return f"substr({x}, {start}, {n})"

    @staticmethod
    def find(x, y):
        return f"instr({x}, {y})"

    @staticmethod
    def length(x):
        return f"length({x})"

    @staticmethod
    def both(a, b):
        return f"({a} AND {b})"

    @staticmethod
    def either(a, b):
        return f"({a} OR {b})"

    @classmethod
    def member(cls, x, values):
        return f"({x} IN ({', '.join(map(cls.lit, values))}))"


class Sql:
    """SQL text that is an expression, not a literal."""

    def __init__(self, sql: str):
        self.sql = str(sql)

    def __str__(self) -> str:
        return self.sql

    def __add__(self, n):
        return Sql(f"({self.sql} + {n})")

    def __sub__(self, n):
        return Sql(f"({self.sql} - {n})")

    def __gt__(self, n):
        return Sql(f"({self.sql} > {n})")


class Duck:
    """DuckText with every result marked as SQL."""


for _name in ("lit", "cat", "extract", "has", "sub", "choose", "eq", "starts", "left", "sub_at", "find", "length", "both", "either", "member"):
    setattr(Duck, _name, staticmethod(lambda *a, f=getattr(DuckText, _name): Sql(f(*a))))


def trim(d, x):
    return d.sub(x, r"^\s+|\s+$")


def squeeze(d, x):
    """Without any white space."""
    return d.sub(x, r"\s")


def bare(d, x):
    """Without the last semicolon."""
    return d.sub(x, r";$")

"""Scalar text functions as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.dialect import SparkText, trim

#: Signs that are a token each; runs of anything else but white space are tokens too.
SIGNS = "()[]{}<>.,:;!?&|=+-*/\\^~@#$%"
_CLASS = "".join("\\" + c for c in SIGNS)
TOKEN = f"[{_CLASS}]|[^\\s{_CLASS}]+"
FIX_WORDS = ("fix", "bugfix", "hotfix", "patch", "resolve", "bug")
BUGFIX = r"(?i)\b(?:" + "|".join(FIX_WORDS) + r")\b"
DOLLARS_PER_MILLION = 3.0


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_count(text) -> Column:
    """Estimated tokens of a text; 0 for an empty or null one."""
    return F.coalesce(F.regexp_count(col(text), F.lit(TOKEN)), F.lit(0)).cast("bigint")


def is_bugfix(message) -> Column:
    """Whether a commit message names a fix, as a whole word."""
    return F.coalesce(col(message).rlike(BUGFIX), F.lit(False))


def collapse_text(text, most: int) -> Column:
    """One line of at most ``most`` characters."""
    x = F.regexp_replace(F.regexp_replace(col(text), r"\s*\n\s*", " "), r"\s{2,}", " ")
    x = trim(SparkText, x)
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 3), F.lit("..."))).otherwise(x)


LITERAL = "|".join(q + rf"(?:\\.|[^\\{q}])*" + q for q in "\"'")


def collapse_expr(text, most: int) -> Column:
    """As collapse_text, with the string literals that the cut lost behind it."""
    x = F.regexp_replace(F.regexp_replace(col(text), r"\s*\n\s*", " "), r"\s{2,}", " ")
    x = trim(SparkText, x)
    return _let(x, lambda x: F.when(F.length(x) <= most, x).otherwise(_let(F.concat(F.substring(x, 1, most - 3), F.lit("...")), lambda head: _telling(x, head))))


def _let(x, build) -> Column:
    """build() of a value that is worked out once: a lambda's body would work out again for each element what stands outside of it."""
    return F.element_at(F.transform(F.array(x), build), 1)


def _telling(x, head) -> Column:
    found = F.filter(F.regexp_extract_all(x, F.lit(LITERAL), F.lit(0)), lambda s: ~F.contains(head, s))
    return _let(F.array_distinct(found), lambda lost: F.when(F.size(lost) == 0, head).otherwise(F.concat(head, F.lit("{"), F.array_join(lost, ","), F.lit("}"))))


def sha12(text) -> Column:
    """The first 12 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(col(text), 256), 1, 12)


def dollars(tokens) -> Column:
    """What tokens cost as model input."""
    return col(tokens) / F.lit(1e6) * F.lit(DOLLARS_PER_MILLION)


def percent_change(before, after) -> Column:
    """Percent saved, rounded half up and negative, as text; 0% of nothing."""
    b, a = col(before), col(after)
    saved = F.floor(F.lit(100.0) * (b - a) / b + 0.5).cast("bigint")
    return F.when((b == 0) | (saved == 0), F.lit("0%")).otherwise(F.concat((-saved).cast("string"), F.lit("%")))


def health_tag(churn, fix_ratio, trend, consistency) -> Column:
    """What is worth a warning about a file, in brackets; empty if nothing is."""
    parts = F.array_compact(
        F.array(
            F.when(col(churn) > 10, F.concat(F.lit("HOT:"), col(churn).cast("string"), F.lit("/30"))),
            F.when(col(fix_ratio) > 0.5, F.concat(F.lit("FIX:"), F.floor(col(fix_ratio) * 100 + 0.5).cast("string"), F.lit("%"))),
            F.when(col(trend) == "down", F.lit("COV:↓")),
            F.when(col(consistency) == "low", F.lit("INCON")),
        )
    )
    return F.when(F.size(parts) > 0, F.concat(F.lit("["), F.array_join(parts, " "), F.lit("]"))).otherwise("")


def annotate(ir, tag) -> Column:
    """The tag behind the first line; texts without a tag stay as they are."""
    lines = F.split(col(ir), "\n")
    first = F.concat_ws(" ", F.element_at(lines, 1), col(tag))
    return F.when(col(tag) == "", col(ir)).otherwise(F.array_join(F.concat(F.array(first), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))


def slice_lines(code, start: int, end: int) -> Column:
    """Lines start to end, counted from 1, both included."""
    return F.array_join(F.slice(F.split(col(code), "\n"), start, max(0, end - start + 1)), "\n")


def remove_line(code, line) -> Column:
    """The text without one line, counted from 1."""
    return F.array_join(F.filter(F.split(col(code), "\n"), lambda _, i: i + 1 != line), "\n")


def identifier_variants(target: str) -> list[str]:
    """A name as given, in Pascal case and in camel case, where it has parts."""
    parts = [p for p in re.split(r"[-_./\s]+", target) if p]
    out = [target]
    if len(parts) > 1:
        cap = [p[:1].upper() + p[1:] for p in parts]
        out += ["".join(cap), parts[0] + "".join(cap[1:])]
    return list(dict.fromkeys(out))


def plain_name(text) -> Column:
    """A name without separators, in small letters."""
    return F.lower(F.regexp_replace(col(text), r"[-_./\s]+", ""))


def register(spark: SparkSession) -> None:
    """SQL functions token_count and bugfix, and the table function code_lines."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION token_count(t STRING) RETURNS BIGINT RETURN coalesce(regexp_count(t, r'{TOKEN}'), 0)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION bugfix(m STRING) RETURNS BOOLEAN RETURN coalesce(m RLIKE r'{BUGFIX}', false)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION code_lines(t STRING) RETURNS TABLE(line_no INT, raw STRING) RETURN SELECT pos + 1, col FROM (SELECT posexplode(split(t, '\\n')))")

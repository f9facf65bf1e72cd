"""Signals from version history: hotspots, decay, inconsistency and health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import health_tag, is_bugfix


def hotspots(touches: DataFrame, least: int = 10, fix_ratio: float = 0.5) -> DataFrame:
    """(file, changes, fix_ratio, authors) of files changed at least so often, and so often for a fix."""
    g = touches.groupBy("file").agg(F.count("*").alias("changes"), F.sum(is_bugfix("message").cast("int")).alias("fixes"), F.countDistinct("author").alias("authors"))
    return g.select("file", "changes", (F.col("fixes") / F.col("changes")).alias("fix_ratio"), "authors").where((F.col("changes") >= least) & (F.col("fix_ratio") >= fix_ratio))


def decay(touches: DataFrame, least: int = 4) -> DataFrame:
    """(file, changes, first_half, second_half): files with more changes after the middle of their time than up to it."""
    span = touches.groupBy("file").agg(F.count("*").alias("changes"), F.min("day").alias("lo"), F.max("day").alias("hi")).where(F.col("changes") >= least)
    half = touches.join(span, "file").groupBy("file", "changes").agg(F.sum((F.col("day") <= F.col("lo") + (F.col("hi") - F.col("lo")) / 2).cast("bigint")).alias("first_half"))
    return half.withColumn("second_half", F.col("changes") - F.col("first_half")).where("second_half > first_half")


def decay_points(touches: DataFrame, least: int = 4) -> DataFrame:
    """(file, day, value): the running number of changes of each file that decays."""
    w = W.partitionBy("file").orderBy("day", "second", "event_id")
    return touches.join(decay(touches, least).select("file"), "file", "left_semi").select("file", "day", F.row_number().over(w).cast("bigint").alias("value"))


def style_of(message):
    m = F.lower(message)
    return F.when(m.startswith("fix"), "fix").when(m.startswith("feat"), "feature").when(m.startswith("refactor"), "refactor").otherwise("other")


def author_styles(touches: DataFrame) -> DataFrame:
    """(file, author, style, commits): what each author mostly does to a file; of equal kinds the one seen first."""
    kinds = touches.groupBy("file", "author", style_of(F.col("message")).alias("kind")).agg(F.count("*").alias("n"), F.min(F.struct("second", "event_id")).alias("first"))
    first = F.struct(-F.col("first.second"), -F.col("first.event_id"))
    return kinds.groupBy("file", "author").agg(F.max_by("kind", F.struct("n", first)).alias("style"), F.sum("n").alias("commits"))


def inconsistencies(touches: DataFrame, authors: int = 3) -> DataFrame:
    """author_styles of files with at least so many authors."""
    styles = author_styles(touches)
    many = styles.groupBy("file").agg(F.count("*").alias("authors")).where(F.col("authors") >= authors)
    return styles.join(many, "file").select("file", "authors", "author", F.concat(F.lit("primarily "), "style", F.lit(" ("), F.col("commits").cast("string"), F.lit(" commits)")).alias("style"))


def health(touches: DataFrame, least: int = 10, fix_ratio: float = 0.5, authors: int = 3) -> DataFrame:
    """(file, churn, fix_ratio, coverage_trend, author_count, consistency, tag) of every file; a tag only where it is a hotspot.

    One aggregation by file gives all three signals what they need, instead of
    three passes and joins.
    """
    day_mid = F.col("lo") + (F.col("hi") - F.col("lo")) / 2
    per = touches.groupBy("file").agg(
        F.count("*").alias("changes"), F.sum(is_bugfix("message").cast("int")).alias("fixes"), F.countDistinct("author").alias("authors"), F.min("day").alias("lo"), F.max("day").alias("hi")
    )
    days = touches.groupBy("file", "day").agg(F.count("*").alias("n"))
    early = days.join(per, "file").groupBy("file").agg(F.sum(F.when(F.col("day") <= day_mid, F.col("n")).otherwise(0)).alias("early"))
    x = per.join(early, "file")
    ratio = F.col("fixes") / F.col("changes")
    hot = (F.col("changes") >= least) & (ratio >= fix_ratio)
    x = x.select(
        "file",
        F.when(hot, F.col("changes")).otherwise(0).alias("churn"),
        F.when(hot, ratio).otherwise(0.0).alias("fix_ratio"),
        F.when((F.col("changes") >= 4) & (F.col("changes") - F.col("early") > F.col("early")), "down").otherwise("stable").alias("coverage_trend"),
        F.when(hot, F.col("authors")).otherwise(0).alias("author_count"),
        F.when(F.col("authors") >= authors, "low").otherwise("high").alias("consistency"),
    )
    return x.withColumn("tag", F.when(F.col("churn") > 0, health_tag("churn", "fix_ratio", "coverage_trend", "consistency")).otherwise(""))

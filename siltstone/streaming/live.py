"""Following changes: filters, debouncing, serial rebuilds and running savings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import col
from siltstone.operators.lines import DEEP, GENERIC

IGNORED = ("node_modules", ".git", "dist", ".ir")


def triggers_reindex(path) -> Column:
    """Whether a changed path is source, and in none of the ignored folders."""
    ext = F.lower(F.regexp_extract(col(path), r"(\.[^./]+)$", 1))
    return ext.isin(*DEEP, *GENERIC) & ~F.exists(F.split(F.regexp_replace(col(path), r"\\", "/"), "/"), lambda s: s.isin(*IGNORED))


def watch(spark: SparkSession, folder: str, schema: str = "rel_path string, ts timestamp") -> DataFrame:
    """Change records as they are added to a folder of JSON files."""
    return spark.readStream.schema(schema).json(folder)


def debounce_stream(changes: DataFrame, gap: str = "300 milliseconds", late: str = "1 second") -> DataFrame:
    """(started, ended, n): bursts of changes closer than the gap.  The watermark is ours; sessions close when it has passed.

    Streams have no sessions without a key, so that all changes get an empty one.
    """
    x = changes.where(triggers_reindex("rel_path")).withWatermark("ts", late)
    return x.groupBy(F.substring("rel_path", 1, 0).alias("k"), F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select(F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def debounce(changes: DataFrame, gap_micros: int = 300_000, slot_micros: int = 3_600_000_000) -> DataFrame:
    """(first, last, n): the same over a table of (ts, event_id).

    Breaks between bursts are found inside slots of time, which are numbered in
    parallel; a slot's first change looks at the last one of the slot that had
    any before it, from one row a slot.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    x = changes.select("event_id", us.alias("us")).withColumn("slot", F.floor(F.col("us") / slot_micros).cast("bigint"))
    ends = x.groupBy("slot").agg(F.max("us").alias("last"))
    before = ends.select("slot", F.lag("last").over(W.orderBy("slot")).alias("prior"))
    w = W.partitionBy("slot").orderBy("us", "event_id")
    x = x.join(before, "slot").withColumn("prev", F.coalesce(F.lag("us").over(w), F.col("prior")))
    x = x.withColumn("new", (F.col("prev").isNull() | (F.col("us") - F.col("prev") > gap_micros)).cast("bigint"))
    # bursts are numbered by the breaks in earlier slots and in their own up to them
    sums = x.groupBy("slot").agg(F.sum("new").alias("news"))
    base = sums.select("slot", F.coalesce(F.sum("news").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    x = x.join(base, "slot").withColumn("burst", F.col("base") + F.sum("new").over(w))
    return x.groupBy("burst").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count("*").alias("n"))


def rebuild_on_change(changes: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls rebuild once for each batch that has a change that triggers; batches are serial, so that no two rebuilds run at once and what arrives meanwhile is one batch."""

    def once(batch: DataFrame, epoch: int) -> None:
        hit = batch.where(triggers_reindex("rel_path"))
        if not hit.isEmpty():
            rebuild(hit, epoch)

    return changes.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def savings(log: DataFrame) -> DataFrame:
    """(saved_tokens, reads, first_ts) of a log (ts, saved); amounts that aren't finite and positive don't count."""
    x = log.where((F.col("saved") > 0) & ~F.isnan("saved") & (F.col("saved") != float("inf")))
    return x.agg(F.coalesce(F.sum(F.floor(F.col("saved") + 0.5).cast("bigint")), F.lit(0)).alias("saved_tokens"), F.count("*").alias("reads"), F.min("ts").alias("first_ts"))

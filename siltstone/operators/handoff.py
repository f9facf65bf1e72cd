"""Handing a project on: a stable prefix, a delta of changed files, and hashes that tell what can be reused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import sha12
from siltstone.operators.lines import DEEP, SYNTAX, extension, made

TOP = 8


def top_hotspots(hotspots: DataFrame, k: int = TOP) -> DataFrame:
    """(file, changes, fix_ratio) of the k most changed; of equals the one of least name."""
    return hotspots.orderBy(F.desc("changes"), "file").limit(k).select("file", "changes", F.round("fix_ratio", 2).alias("fix_ratio"))


def changed_files(status: DataFrame, files: DataFrame, engine: str = SYNTAX) -> DataFrame:
    """(path, status, hash, tokens, ir) of changed files in deep languages; deleted and missing ones have nothing in them."""
    return changed_rows(status.where(extension("path").isin(*DEEP)).join(files.select("path", "code"), "path", "left"), engine)


def changed_rows(x: DataFrame, engine: str = SYNTAX) -> DataFrame:
    """changed_files() of rows (path, status, code), which needs no join."""
    x = x.where(extension("path").isin(*DEEP))
    gone = (F.col("status") == "deleted") | F.col("code").isNull()
    x = x.withColumn("_f", made("path", F.when(~gone, F.col("code")), engine, "l1", "l1_tokens"))  # nothing is made of what is gone
    return x.select("path", "status", F.when(gone, "").otherwise(sha12("code")).alias("hash"), F.col("_f.l1_tokens").alias("tokens"), F.coalesce("_f.l1", F.lit("")).alias("ir"))


def risk_files(changed: DataFrame, top: DataFrame) -> DataFrame:
    """Changed files that are among the top hotspots; both have ``file``."""
    return changed.join(top.select("file"), "file", "left_semi")


def set_hash(df: DataFrame, *columns: str) -> DataFrame:
    """(hash): one hash of all rows in the order of the columns; rows are hashed first and gathered as 32 bytes each, whose order is that of their digits."""
    row = F.unhex(F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256))
    digits = F.transform(F.sort_array(F.collect_list("h")), lambda b: F.lower(F.hex(b)))
    return df.select(row.alias("h")).agg(sha12(F.array_join(digits, "")).alias("hash"))


def handoff_hashes(prefix: DataFrame, delta: DataFrame, prefix_columns, delta_columns) -> DataFrame:
    """(prefix_hash, delta_hash, combined_hash)."""
    x = set_hash(prefix, *prefix_columns).withColumnRenamed("hash", "prefix_hash").crossJoin(set_hash(delta, *delta_columns).withColumnRenamed("hash", "delta_hash"))
    return x.withColumn("combined_hash", sha12(F.concat("prefix_hash", "delta_hash")))


def reuse(now: DataFrame, before: DataFrame) -> DataFrame:
    """Adds what of the last hand-off can be reused; nothing if there was none."""
    b = before.select(F.col("prefix_hash").alias("_p"), F.col("delta_hash").alias("_d"))
    x = now.join(b, F.lit(True), "left")
    return x.select(*now.columns, F.coalesce(F.col("_p") == F.col("prefix_hash"), F.lit(False)).alias("prefix_reused"), F.coalesce(F.col("_d") == F.col("delta_hash"), F.lit(False)).alias("delta_reused"))

"""Global row numbers and samples without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.sources.shared import materialize


def numbered_by(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """(df with ``n`` from 0 in the given order, number of rows).

    Rows are ranged over partitions and numbered there; a partition's offset
    comes from the counts of those before it, a few numbers.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    kept = materialize(ranged, "ranged")
    counts = kept.groupBy("_part").agg(F.count("*").alias("c")).collect()
    at, offsets = 0, []
    for r in sorted(counts, key=lambda r: r["_part"]):
        offsets.append((r["_part"], at))
        at += r["c"]
    starts = df.sparkSession.createDataFrame(offsets, "_part int, _start bigint")
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return kept.withColumn("n", inside.cast("bigint")).join(F.broadcast(starts), "_part").withColumn("n", F.col("n") + F.col("_start")).drop("_part", "_start"), at


def sample_uniform(df: DataFrame, k: int, *order: str) -> DataFrame:
    """At most k rows at places floor(i * n / k) of the order; all rows if there are no more."""
    rows, n = numbered_by(df, *order)
    if n <= k:
        return rows.drop("n")
    places = df.sparkSession.createDataFrame([(i * n // k,) for i in range(k)], "n bigint")
    return rows.join(F.broadcast(places), "n", "left_semi").drop("n")

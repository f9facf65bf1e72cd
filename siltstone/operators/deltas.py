"""Diffs: hunks, their context as IR, and the delta layer."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import annotate, col
from siltstone.operators.lines import fingerprint_plain
from siltstone.plans.dialect import SparkText, compiled, trim

_COUNT = "(?:,[0-9]+)?"
HUNK = "^@@ -[0-9]+" + _COUNT + " [+]([0-9]+)" + _COUNT + " @@"


def hunks(diff: DataFrame) -> DataFrame:
    """(file, hunk_no, start_line, end_line, added, removed, context) of rows (file, line_no, line).

    Lines before a file's first header are dropped.  The end counts added lines
    and context from the start; removed lines don't count.
    """
    w = W.partitionBy("file").orderBy("line_no")
    x = diff.withColumn("head", F.col("line").rlike(HUNK)).withColumn("hunk_no", F.sum(F.col("head").cast("int")).over(w)).where("hunk_no > 0")
    sign = F.when(F.col("head"), "@").when(F.col("line").startswith("+") & ~F.col("line").startswith("+++"), "+").when(F.col("line").startswith("-") & ~F.col("line").startswith("---"), "-").when(F.col("line").startswith(" "), " ")
    x = x.withColumn("sign", sign).withColumn("body", F.substr("line", F.lit(2)))
    part = lambda s: F.transform(F.sort_array(F.collect_list(F.when(F.col("sign") == s, F.struct("line_no", "body")))), lambda r: r["body"])
    g = x.groupBy("file", "hunk_no").agg(
        F.max(F.when(F.col("head"), F.regexp_extract("line", HUNK, 1).cast("int"))).alias("start_line"),
        F.sum(F.col("sign").isin("+", " ").cast("int")).alias("grown"),
        part("+").alias("added"),
        part("-").alias("removed"),
        part(" ").alias("context"),
    )
    return g.select("file", F.col("hunk_no").cast("int"), "start_line", (F.col("start_line") + F.coalesce("grown", F.lit(0))).cast("int").alias("end_line"), "added", "removed", "context")


def text_hunks(lines: list[str]) -> list[dict]:
    """hunks() of one diff, given as its lines."""
    out, h = [], None
    for line in lines:
        if m := compiled(HUNK).search(line):
            h = {"hunk_no": len(out) + 1, "start_line": int(m[1]), "end_line": int(m[1]), "added": [], "removed": [], "context": []}
            out.append(h)
        elif h is not None:
            part = "added" if line.startswith("+") and not line.startswith("+++") else "removed" if line.startswith("-") and not line.startswith("---") else "context" if line.startswith(" ") else None
            if part:
                h[part].append(line[1:])
                h["end_line"] += part != "removed"
    return out


def hunks_of_files(diffs: DataFrame, *parts: str) -> DataFrame:
    """(file, hunk_no, start_line, end_line and the parts) of diffs (file, lines), a row a file, so that no line is moved.

    Parts are those of hunks() and delta_context(): added, removed, context, changed and surrounding_ir.
    """
    made = {"changed": lambda h: h["added"] + h["removed"], "surrounding_ir": lambda h: fingerprint_plain(h["context"])}
    ints, text, texts = ["hunk_no", "start_line", "end_line"], pa.string(), pa.list_(pa.string())

    def run(batches):
        for b in batches:
            rows = [(f, h) for f, x in zip(b["file"].to_pylist(), b["lines"].to_pylist()) for h in text_hunks(x)]
            cols = [pa.array([f for f, _ in rows], text)] + [pa.array([h[c] for _, h in rows], pa.int32()) for c in ints]
            cols += [pa.array([made[c](h) if c in made else h[c] for _, h in rows], text if c == "surrounding_ir" else texts) for c in parts]
            yield pa.RecordBatch.from_arrays(cols, ["file", *ints, *parts])

    kinds = [f"{c} {'string' if c == 'surrounding_ir' else 'array<string>'}" for c in parts]
    return diffs.select("file", "lines").mapInArrow(run, ", ".join(["file string", *(c + " int" for c in ints), *kinds]))


def context_ir(context) -> Column:
    """Context lines as IR, noise left out; in an Arrow UDF, so not inside of a lambda."""

    def run(context: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else fingerprint_plain(c) for c in context], dtype=object)

    return F.pandas_udf(run, "string")(col(context))


def delta_context(diff: DataFrame) -> DataFrame:
    """(file, hunk_no, start_line, end_line, changed, surrounding_ir): added lines before removed ones."""
    return hunks(diff).select("file", "hunk_no", "start_line", "end_line", F.concat("added", "removed").alias("changed"), context_ir("context").alias("surrounding_ir"))


def l2(delta: DataFrame, tag=None) -> DataFrame:
    """(file, ir): the delta layer of each file; ``scope`` and ``blame`` columns (author, date, message) are used where they are there."""
    line = [F.concat(F.lit("CHANGED: "), F.array_join("changed", "\n" + " " * 9)), F.when(F.col("surrounding_ir") != "", F.concat(F.lit("CONTEXT: "), "surrounding_ir"))]
    if "scope" in delta.columns:
        line.insert(0, F.when(F.col("scope").isNotNull(), F.concat(F.lit("SCOPE: "), "scope")))
    if "blame" in delta.columns:
        line.append(F.when(F.col("blame").isNotNull(), F.format_string('BLAME: %s, %s, commit:"%s"', F.col("blame.author"), F.col("blame.date"), F.col("blame.message"))))
    g = delta.withColumn("_ir", F.concat_ws("\n", *line)).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("hunk_no", "_ir"))).alias("h"))
    ir = F.concat_ws("\n", F.concat(F.lit("FILE: "), "file"), F.array_join(F.transform("h", lambda r: r["_ir"]), "\n"))
    out = g.select("file", ir.alias("ir"))
    return out if tag is None else out.withColumn("ir", annotate("ir", tag))

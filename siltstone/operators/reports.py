"""Benchmarks of the layers, coverage and fidelity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import LITERAL, dollars
from siltstone.operators.lines import BY_LINES, DEEP, GENERIC, SYNTAX, UNSUPPORTED, extension, is_generic, language
from siltstone.operators.lines import made as made_of_file


def benchmark_files(files: DataFrame, engine: str = SYNTAX) -> DataFrame:
    """(path, raw_tokens, l0_tokens, l1_tokens, saved_percent, engine) of files (path, code).

    ``engine`` is AST or FP (lines in place of a syntax that gave nothing),
    LINES where only lines are asked for, GENERIC or NONE.
    """
    x = files.select("path", made_of_file("path", "code", engine, "raw_tokens", "l0_tokens", "l1_tokens", "made_by").alias("_f")).select("path", "_f.*")
    made = F.lit("LINES") if engine == BY_LINES else F.col("made_by")
    engine = F.when(is_generic("path"), "GENERIC").when(language("path").isNotNull(), made).otherwise("NONE")
    saved = F.when(F.col("raw_tokens") > 0, (F.col("raw_tokens") - F.col("l1_tokens")) / F.col("raw_tokens") * 100).otherwise(0.0)
    return x.select("path", "raw_tokens", "l0_tokens", "l1_tokens", saved.alias("saved_percent"), engine.alias("engine"))


def benchmark_summary(per_file: DataFrame, engine: str = SYNTAX) -> DataFrame:
    """One row: sums, counts by engine, and what the sums save."""
    engines = ("GENERIC", "LINES", "NONE") if engine == BY_LINES else ("AST", "FP", "GENERIC", "NONE")
    g = per_file.agg(F.count("*").alias("files"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("l0_tokens").alias("l0_tokens"), F.sum("l1_tokens").alias("l1_tokens"), *(F.count_if(F.col("engine") == e).alias(f"n_{e.lower()}") for e in engines))
    return g.withColumn("saved_percent", F.when(F.col("raw_tokens") > 0, (F.col("raw_tokens") - F.col("l1_tokens")) / F.col("raw_tokens") * 100).otherwise(0.0))


def score(summary: DataFrame) -> DataFrame:
    """The summary with its cost in dollars."""
    return summary.select("files", "raw_tokens", "l1_tokens", "saved_percent", dollars("raw_tokens").alias("raw_dollars"), dollars("l1_tokens").alias("l1_dollars"))


def savings_card(summary: DataFrame, loads: int = 50, days: int = 30) -> DataFrame:
    """What the saving comes to at so many loads a day."""
    a, b = dollars("raw_tokens") * loads * days, dollars("l1_tokens") * loads * days
    return summary.select(a.alias("raw_cost"), b.alias("l1_cost"), (a - b).alias("saved"))


def coverage(files: DataFrame) -> DataFrame:
    """(ext, indexed, n): source files by extension, and whether their language is read."""
    e = F.lower(extension("path"))
    return files.select(e.alias("ext")).where(F.col("ext").isin(*DEEP, *GENERIC, *UNSUPPORTED)).groupBy("ext").agg(F.count("*").alias("n")).select("ext", F.col("ext").isin(*DEEP, *GENERIC).alias("indexed"), "n")


def coverage_warning(covered: DataFrame, most: int = 6) -> DataFrame:
    """(unsupported, total, percent, exts): the text's numbers, with the most frequent unsupported extensions."""
    total = covered.agg(F.sum("n").alias("total"), F.sum(F.when(~F.col("indexed"), F.col("n")).otherwise(0)).alias("unsupported"))
    top = covered.where(~F.col("indexed")).orderBy(F.desc("n"), "ext").limit(most).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "ext"))), lambda r: r["ext"]), ", ").alias("exts"))
    return total.crossJoin(top).select("unsupported", "total", F.floor(F.col("unsupported") * 100.0 / F.col("total") + 0.5).cast("bigint").alias("percent"), "exts")


_NUMBER = "-?[0-9]+(?:[.][0-9]+)?"
VALUE = f"({LITERAL}|{_NUMBER})"
NAMES = r"(?:class|interface|function|var|let|const)\s+([_$a-zA-Z][$\w]*)"
CONSTANTS = r"(?:var|let|const)\s+[_$a-zA-Z][$\w]*(?::[^=]+|)=\s*" + VALUE
CASES = r"case\s+" + VALUE
COMPARED = r"[=!]==\s*" + VALUE


def fidelity(files: DataFrame) -> DataFrame:
    """(path, and of names, constants and branches the distinct ones in the code and those whose text is in ir)."""
    pick = lambda p: F.regexp_extract_all("code", F.lit(p), F.lit(1))
    x = files.withColumn("_n", F.array_distinct(pick(NAMES))).withColumn("_c", F.array_distinct(pick(CONSTANTS))).withColumn("_b", F.array_distinct(F.concat(pick(CASES), pick(COMPARED))))
    kept = lambda c: F.size(F.filter(c, lambda s: F.contains(F.col("ir"), s))).cast("bigint")
    return x.select("path", *(y for n, c in (("names", "_n"), ("constants", "_c"), ("branches", "_b")) for y in (F.size(c).cast("bigint").alias(n), kept(c).alias(n + "_kept"))))

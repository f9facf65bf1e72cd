"""Packing files into a budget of tokens: target resolution, related files, first fit and upgrades."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import identifier_variants, plain_name
from siltstone.operators.lines import SYNTAX, made, with_layers
from siltstone.plans.dialect import rx
from siltstone.sources.shared import materialize

#: Files of a chunk of the fold, and remaining budgets for which a chunk says at once what it leaves.
CHUNK, SMALL = 1 << 16, 1024


def declarations(name: str) -> list[str]:
    """Patterns that declare a name, the surest first."""
    t = re.escape(name).replace(r"\-", "-")
    opt = lambda w: rf"(?:{w}\s+)?"
    out = [opt("export") + opt("async") + rf"function\s+{t}\b"]
    out += [opt("export") + rf"{k}\s+{t}\b" for k in ("class", "interface", "type", "enum", "(?:const|let|var)")]
    out += [rf"\b{k}\s+{t}\b" for k in ("def", "fn", "struct", "trait", "func", "type")]
    return [*out, rf"\b{t}\s*:\s*" + opt("async") + r"function\b", rf"\b{t}\s*\([^)]*\)\s*" + r"\{"]


def references(name: str) -> str:
    t = re.escape(name).replace(r"\-", "-")
    return "|".join([f"[\"'`]{t}[\"'`]", rf"\b{t}\s*\("])


def base_name(path):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")


def resolve_target(files: DataFrame, target: str) -> DataFrame:
    """(target, path, matched_by): the file that declares the target, else is named so, else quotes or calls it; no row if none does.

    Every file gets the place of its first match in the order of levels, variants
    and patterns; one aggregation takes the least.  Patterns are tried only on
    files that hold the name.
    """
    declared, n = [], 0
    for v in identifier_variants(target):
        place = None
        for p in declarations(v):
            hit = F.col("code").rlike(p)
            place = F.when(hit, n) if place is None else place.when(hit, n)
            n += 1
        declared.append(F.when(F.contains(F.col("code"), F.lit(v)), place))  # every pattern has the name in it
    named = F.when(plain_name(base_name(F.col("path"))) == re.sub(r"[-_./\s]+", "", target).lower(), n)
    quoted = F.when(F.contains(F.col("code"), F.lit(target)), F.when(F.col("code").rlike(references(target)), n + 1))
    # coalesce() stops at the first that isn't null, in the order of levels
    placed = files.select("path", "file_ord", F.coalesce(*declared, named, quoted).alias("place"))
    best = placed.agg(F.min(F.when(F.col("place").isNotNull(), F.struct("place", "file_ord", "path"))).alias("b")).where("b is not null")
    return best.select(F.lit(target).alias("target"), F.col("b.path").alias("path"), F.when(F.col("b.place") < n, "declaration").when(F.col("b.place") == n, "filename").otherwise("reference").alias("matched_by"))


IMPORT = rx(r"(?:require|import)°(?:\w+|\{[^}]*\}|\([^)]*)?°(?:from)?°§")


def related_files(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path): files that the target imports (for each import the first that fits), and files that mention the target's name.

    The imports of one file are few, and broadcast; files are scanned once.
    """
    target = resolved.join(files, "path").select(F.col("path").alias("tpath"), "code")
    imports = target.select("tpath", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(IMPORT), F.lit(1)))).alias("imp"))
    stem = F.regexp_replace(F.regexp_replace("imp", r"^\.\.?/", ""), r"\.[^.]+$", "")
    whole = F.regexp_replace("path", r"\.[^.]+$", "")
    fits = F.contains(F.col("imp"), whole) | whole.endswith(stem)
    imported = files.select("path", "file_ord").join(F.broadcast(imports), fits).groupBy("imp").agg(F.min_by("path", "file_ord").alias("path")).select("path")
    name = target.select("tpath", base_name(F.col("tpath")).alias("name"))
    using = files.join(F.broadcast(name), (F.col("path") != F.col("tpath")) & F.contains(F.col("code"), F.col("name"))).select("path")
    return imported.union(using).distinct()


def _summary(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a chunk: the sum of its costs, their highest running sum, the least cost, and what it leaves of each small budget."""
    cost = pdf.sort_values("ord")["cost"].to_numpy()
    run = np.cumsum(cost)
    left, least = np.arange(SMALL), cost.min()
    for i, c in enumerate(cost):
        if i % 64 == 0 and left.max() < least:  # nothing more fits in any
            break
        left = np.where(left >= c, left - c, left)
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "total": [int(run[-1])], "highest": [int(run.max())], "least": [int(least)], "left": [left.tolist()]})


def first_fit(items: DataFrame, budget: int) -> DataFrame:
    """Items (chunk, ord, cost, ...) with ``taken``: each is taken if the budget that is left covers its cost, in the order of chunk and ord.

    The order is serial, the work isn't.  Every chunk tells what it does to a
    budget; the driver folds those few numbers, chunk by chunk, and looks into a
    chunk itself only where a budget ends inside; then all chunks take their
    items at once.  Costs may be negative.
    """
    rows = materialize(items.select("chunk", "ord", "cost"), "costs")  # looked into chunk by chunk, not made anew for each
    sums = rows.groupBy("chunk").applyInPandas(_summary, f"chunk {dict(rows.dtypes)['chunk']}, total bigint, highest bigint, least bigint, left array<bigint>").collect()
    left, given = budget, []
    for s in sorted(sums, key=lambda r: r["chunk"]):
        given.append((s["chunk"], left))
        if left >= s["highest"]:
            left -= s["total"]
        elif left < s["least"]:
            continue
        elif 0 <= left < SMALL:
            left = s["left"][left]
        else:
            for r in sorted(rows.where(F.col("chunk") == F.lit(s["chunk"])).collect(), key=lambda r: r["ord"]):
                if r["cost"] <= left:
                    left -= r["cost"]
    start = items.sparkSession.createDataFrame(given, f"chunk {dict(rows.dtypes)['chunk']}, start bigint")

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        left, taken = int(pdf["start"].iloc[0]), []
        for c in pdf["cost"].tolist():
            taken.append(c <= left)
            left -= c if taken[-1] else 0
        return pd.DataFrame({"ord": pdf["ord"], "chunk": pdf["chunk"], "taken": taken})

    done = rows.join(F.broadcast(start), "chunk").groupBy("chunk").applyInPandas(take, f"ord {dict(rows.dtypes)['ord']}, chunk {dict(rows.dtypes)['chunk']}, taken boolean")
    return items.join(done, ["chunk", "ord"])


def pack(files: DataFrame, budget: int, hot: DataFrame | None = None, target: str | None = None, engine: str = SYNTAX, spare: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries, summary) of files (path, file_ord, code) packed into a budget of tokens.

    entries: (path, layer, ir, tokens, is_target).  The target comes whole (L3)
    if it takes at most 60 % of the budget, else as its IR (L1), which is then
    called downgraded and may exceed the budget alone; other files as structure
    maps (L0).  If that is too much, maps are taken first fit in file order.
    Otherwise maps are upgraded to IR as long as the budget allows: related files
    first, then hotspots, then the largest, then file order.  With ``spare`` the
    budget is what is left for upgrades beside the whole target and all maps.

    summary: (total_tokens, files_at_l0, files_at_l1, files_at_l3, target_file,
    matched_by, downgraded, missing, truncated).
    """
    spark = files.sparkSession
    if target is None and not spare:  # where maps alone are too much, nothing else is made
        chunk = F.floor(F.col("file_ord") / CHUNK).cast("bigint").alias("chunk")
        costs = materialize(files.select(chunk, F.col("file_ord").alias("ord"), made("path", "code", engine, "l0_tokens")["l0_tokens"].alias("cost")), "maps")
        if (costs.agg(F.sum("cost")).first()[0] or 0) > budget:
            taken = materialize(first_fit(costs, budget).where("taken").select("chunk", "ord"), "taken")
            small = files.select("path", "code", chunk, F.col("file_ord").alias("ord")).join(taken, ["chunk", "ord"]).select("path", made("path", "code", engine, "l0", "l0_tokens").alias("_f"))
            entries = small.select("path", F.lit("L0").alias("layer"), F.col("_f.l0").alias("ir"), F.col("_f.l0_tokens").alias("tokens"), F.lit(False).alias("is_target"))
            return entries, _summary_of(entries, None, None, False, False, True)
    layered = materialize(with_layers(files.select("path", "file_ord", "code"), engine), "layers")
    resolved = materialize(resolve_target(layered, target), "target") if target else None
    found = resolved.first() if target else None
    goal = found["path"] if found else None
    if spare:
        budget += layered.agg(F.sum(F.when(F.col("path") == F.lit(goal), F.col("raw_tokens")).otherwise(F.col("l0_tokens")))).first()[0] or 0
    big, used, downgraded = [], 0, False
    if goal is not None:
        r = layered.where(F.col("path") == goal).orderBy("file_ord").select("raw_tokens", "l1_tokens").first()
        downgraded = r["raw_tokens"] > budget * 0.6
        used = r["l1_tokens"] if downgraded else r["raw_tokens"]
        big = [layered.where(F.col("path") == goal).select("path", F.lit("L1" if downgraded else "L3").alias("layer"), F.col("l1" if downgraded else "code").alias("ir"), F.lit(used).cast("bigint").alias("tokens"), F.lit(True).alias("is_target"))]
    rest = layered.where(F.col("path") != goal) if goal is not None else layered
    total = used + (rest.agg(F.sum("l0_tokens")).first()[0] or 0)
    truncated = total > budget
    if truncated:
        items = rest.withColumn("chunk", F.floor(F.col("file_ord") / CHUNK).cast("bigint")).withColumn("ord", F.col("file_ord")).withColumn("cost", F.col("l0_tokens"))
        fit = first_fit(items, budget - used).where("taken")
        small = fit.select("path", F.lit("L0").alias("layer"), F.col("l0").alias("ir"), F.col("l0_tokens").alias("tokens"), F.lit(False).alias("is_target"))
    else:
        near = related_files(layered, resolved).withColumn("related", F.lit(0)) if goal is not None else spark.createDataFrame([], "path string, related int")
        warm = hot.select("path").distinct().withColumn("hot", F.lit(0)) if hot is not None else spark.createDataFrame([], "path string, hot int")
        x = rest.join(near, "path", "left").join(warm, "path", "left")
        # one chunk for each grade of urgency and size, in order as text
        key = F.format_string("%d%d%019d%012d", F.coalesce("related", F.lit(1)), F.coalesce("hot", F.lit(1)), F.lit(10**18) - F.col("raw_tokens"), F.floor(F.col("file_ord") / CHUNK))
        items = x.withColumn("chunk", key).withColumn("ord", F.col("file_ord")).withColumn("cost", F.col("l1_tokens") - F.col("l0_tokens"))
        fit = first_fit(items, budget - total)
        pick = lambda a, b: F.when(F.col("taken"), a).otherwise(b)
        small = fit.select("path", pick("L1", "L0").alias("layer"), pick(F.col("l1"), F.col("l0")).alias("ir"), pick(F.col("l1_tokens"), F.col("l0_tokens")).alias("tokens"), F.lit(False).alias("is_target"))
    entries = small
    for b in big:
        entries = b.union(entries)
    return entries, _summary_of(entries, goal, found["matched_by"] if found and not truncated else None, downgraded, bool(target) and goal is None, truncated)


def _summary_of(entries: DataFrame, goal: str | None, matched_by: str | None, downgraded: bool, missing: bool, truncated: bool) -> DataFrame:
    # a downgraded target counts as L1 only where the budget was too small for the maps
    counted = (F.col("layer") == "L1") & (F.lit(truncated) | ~F.col("is_target"))
    return entries.agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.coalesce(F.sum((F.col("layer") == "L0").cast("bigint")), F.lit(0)).alias("files_at_l0"),
        F.coalesce(F.sum(counted.cast("bigint")), F.lit(0)).alias("files_at_l1"),
        F.coalesce(F.sum((F.col("layer") == "L3").cast("bigint")), F.lit(0)).alias("files_at_l3"),
    ).select("*", F.lit(goal).cast("string").alias("target_file"), F.lit(matched_by).cast("string").alias("matched_by"), F.lit(downgraded).alias("downgraded"), F.lit(missing).alias("missing"), F.lit(truncated).alias("truncated"))


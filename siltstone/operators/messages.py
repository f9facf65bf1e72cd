"""Rewriting fenced code in messages, and the decision to compress what was read."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import TOKEN, col, token_count
from siltstone.operators.lines import LANGUAGES, SYNTAX, deep_ir, language, shorter, text_ir
from siltstone.plans.dialect import SparkText, trim
from siltstone.plans.once import once

TICKS = "`" * 3
FENCE = TICKS + r"([^\n]*)\n((?s:.*?))\n" + TICKS
SNIPPETS = {"typescript": "ts", "ts": "ts", "tsx": "tsx", "javascript": "js", "js": "js", "jsx": "jsx", "mjs": "mjs", "python": "py", "py": "py", "go": "go", "rust": "rs", "rs": "rs"}


def count_tokens(text: str) -> int:
    """token_count() of a Python string."""
    return len(_TOKEN.findall(text))


_TOKEN = re.compile(TOKEN, re.ASCII)


def fence_path(info) -> Column:
    """The file that a fence's first line names: a word with a known extension, else a language's snippet, else null."""
    words = F.filter(F.split(trim(SparkText, col(info)), r"\s+"), lambda w: w != "")
    named = F.filter(words, lambda w: F.contains(w, F.lit(".")) & language(w).isNotNull())
    table = F.create_map(*(F.lit(x) for k, v in SNIPPETS.items() for x in (k, "snippet." + v)))
    return F.coalesce(F.get(named, F.lit(0)), F.element_at(table, F.lower(F.coalesce(F.get(words, F.lit(0)), F.lit("")))))


def fence_blocks(messages: DataFrame, *keys: str) -> DataFrame:
    """(keys..., block, info, body, path) of every fence, counted from 0."""
    pick = lambda i: F.regexp_extract_all("text", F.lit(FENCE), F.lit(i))
    x = messages.select(*keys, F.posexplode(F.arrays_zip(pick(1).alias("info"), pick(2).alias("body"))).alias("block", "f"))
    return x.select(*keys, "block", "f.info", "f.body").withColumn("path", fence_path("info"))


def _irs(bodies, langs, engine: str) -> Column:
    """The IR of each text of an array; null where its language is. An Arrow UDF, so not inside of a lambda."""

    def run(bodies: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([None if bs is None else [text_ir(b, x, engine)[0] if x is not None else None for b, x in zip(bs, xs)] for bs, xs in zip(bodies, langs)], dtype=object)

    return F.pandas_udf(run, "array<string>")(bodies, langs)


def _parts(text, engine: str) -> Column:
    """Of each fence (whole, info, body, ir); its body stands for the IR where the language isn't known or nothing is won."""
    pick = lambda i: F.regexp_extract_all(text, F.lit(FENCE), F.lit(i))
    irs = _irs(pick(2), F.transform(pick(1), lambda info: language(fence_path(info))), engine)
    z = F.arrays_zip(pick(0).alias("whole"), pick(1).alias("info"), pick(2).alias("body"), irs.alias("ir"))
    return F.transform(z, lambda s: F.struct(s["whole"].alias("whole"), s["info"].alias("info"), s["body"].alias("body"), F.when(s["ir"].isNotNull(), shorter(s["ir"], s["body"])).otherwise(s["body"]).alias("ir")))


def compress_text(df: DataFrame, text: str = "text", engine: str = SYNTAX) -> DataFrame:
    """Replaces the code of fences by its IR where that saves tokens; adds raw_tokens, ir_tokens and blocks_compressed.

    Text between fences comes from splitting at them, and is put together with
    the fences again by place.
    """
    x = once(df.withColumn("_f", _parts(F.coalesce(F.col(text), F.lit("")), engine)))
    x = x.withColumn("_won", F.filter("_f", lambda s: s["ir"] != s["body"]))
    total = lambda what: F.aggregate("_won", F.lit(0).cast("bigint"), lambda a, s: a + token_count(s[what]))
    new = F.transform("_f", lambda s: F.when(s["ir"] == s["body"], s["whole"]).otherwise(F.concat(F.lit(TICKS), s["info"], F.lit("\n"), s["ir"], F.lit("\n" + TICKS))))
    between = F.split(F.col(text), FENCE, -1)
    woven = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    x = x.withColumn("raw_tokens", total("body")).withColumn("ir_tokens", total("ir")).withColumn("blocks_compressed", F.size("_won").cast("bigint"))
    return x.withColumn(text, F.when(F.size("_won") > 0, woven).otherwise(F.col(text))).drop("_f", "_won")


def compress_bodies(bodies: DataFrame, engine: str = SYNTAX) -> DataFrame:
    """Compresses chat bodies: an optional ``system`` text, and ``messages``, an array of (role, content string, blocks array of (type, text)).

    Blocks without text, and whatever else the body has, come through
    untouched.  All texts of a body go through one array, since an Arrow UDF
    can't be called inside of a lambda, and back to their places.
    """
    m = F.col("messages")
    inner = F.flatten(F.transform(m, lambda m: F.coalesce(F.transform(m["blocks"], lambda b: b["text"]), F.array().cast("array<string>"))))
    system = F.array(F.col("system")) if "system" in bodies.columns else F.array().cast("array<string>")
    texts = F.concat(system, F.coalesce(F.transform(m, lambda m: m["content"]), F.array().cast("array<string>")), F.coalesce(inner, F.array().cast("array<string>")))
    x = once(bodies.withColumn("_t", _woven(texts, engine)))
    first = 1 if "system" in bodies.columns else 0
    n = F.size("messages")
    before = lambda i: F.aggregate(F.slice("messages", 1, i), F.lit(0), lambda a, m: a + F.greatest(F.coalesce(F.size(m["blocks"]), F.lit(0)), F.lit(0)))
    block = lambda b, i, k: F.struct(b["type"].alias("type"), F.get("_t", F.lit(first) + n + before(i) + k).alias("text"))
    new = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), F.get("_t", F.lit(first) + i).alias("content"), F.transform(m["blocks"], lambda b, k: block(b, i, k)).alias("blocks")))
    x = x.withColumn("_m", F.when(F.col("messages").isNotNull(), new))
    if first:
        x = x.withColumn("system", F.get("_t", F.lit(0)))
    return x.withColumn("messages", F.col("_m")).drop("_m", "_t")


def _woven(texts, engine: str) -> Column:
    """Each text of an array with its fences compressed."""
    fence = re.compile(TICKS + r"([^\n]*)\n([\s\S]*?)\n" + TICKS)

    def one(text: str | None) -> str | None:
        def put(m: re.Match) -> str:
            lang = plain_language(m[1])
            ir = text_ir(m[2], lang, engine)[0] if lang else ""
            return f"{TICKS}{m[1]}\n{ir}\n{TICKS}" if ir.strip() and count_tokens(ir) < count_tokens(m[2]) else m[0]

        return None if text is None else fence.sub(put, text)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if ts is None else [one(t) for t in ts] for ts in texts], dtype=object)

    return F.pandas_udf(run, "array<string>")(texts)


def plain_language(info: str) -> str | None:
    """The language of a fence's first line, as fence_path() and language() tell it."""
    words = info.split()
    for w in words:
        m = re.search(r"(\.[^./]+)$", w)
        if "." in w and m and m[1] in LANGUAGES:
            return LANGUAGES[m[1]]
    known = SNIPPETS.get(words[0].lower()) if words else None
    return LANGUAGES.get("." + known) if known else None


MARK = "[ir] Structure of the file, compressed from %d tokens. Read it with a range of lines for the exact source.\n\n"


def read_decision(reads: DataFrame, least: int = 1200, engine: str = SYNTAX) -> DataFrame:
    """Adds compress, output, output_tokens, saved_tokens and reason to reads (path, content, has_range).

    In this order a read stays raw if it asked for a range, the language is
    unknown, it is short, the IR isn't shorter, or the mark in front makes up
    for it.
    """
    x = reads.withColumn("raw_tokens", token_count("content"))
    wanted = ~F.col("has_range") & language("path").isNotNull() & (F.col("raw_tokens") >= least)
    x = once(x.withColumn("_ir", deep_ir(F.when(wanted, F.col("content")), language("path"), engine)["ir"]))
    x = x.withColumn("_ir", F.when(wanted, shorter("_ir", "content")))
    x = x.withColumn("_out", F.concat(F.format_string(MARK, F.col("raw_tokens")), "_ir")).withColumn("_n", token_count("_out"))
    reason = (
        F.when(F.col("has_range"), "ranged read").when(language("path").isNull(), "unsupported language").when(F.col("raw_tokens") < least, "below threshold")
        .when(F.col("_ir") == F.col("content"), "no win").when(F.col("_n") >= F.col("raw_tokens"), "no win after mark").otherwise("compressed")
    )
    x = x.withColumn("reason", reason).withColumn("compress", F.col("reason") == "compressed")
    out = lambda a, b: F.when(F.col("compress"), a).otherwise(b)
    return x.withColumn("output", out(F.col("_out"), F.col("content"))).withColumn("output_tokens", out(F.col("_n"), F.col("raw_tokens"))).withColumn("saved_tokens", F.col("raw_tokens") - F.col("output_tokens")).drop("_ir", "_out", "_n")


HOOK_SCHEMA = "tool_name string, tool_input struct<file_path:string,path:string,offset:bigint,limit:bigint>"


def hook_reads(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Payloads of read tools as (path, has_range); others, and text that isn't JSON, are left out."""
    x = payloads.withColumn("_p", F.from_json(column, HOOK_SCHEMA)).where(F.lower("_p.tool_name") == "read")
    return x.withColumn("path", F.coalesce("_p.tool_input.file_path", "_p.tool_input.path")).withColumn("has_range", F.col("_p.tool_input.offset").isNotNull() | F.col("_p.tool_input.limit").isNotNull()).drop("_p").where("path is not null")



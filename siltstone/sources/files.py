"""Source trees, version control and settings as DataFrames."""

from __future__ import annotations

import fnmatch
import json
import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.lines import extension

ALWAYS_SKIP = ("node_modules", ".git", "dist")


def ignore_patterns(text: str) -> list[str]:
    """Names and globs of an ignore file, without comments, negations and slashes at the ends."""
    return [s.strip("/") for line in text.splitlines() if (s := line.strip()) and s[0] not in "#!"]


def scan(spark: SparkSession, root: str, extensions=None) -> DataFrame:
    """(path, code) of the source files under a folder, paths relative to it.

    Hidden names, the folders that are always skipped and what .gitignore names
    are left out.  Only files of the wanted extensions are opened.
    """
    base = root.rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions:
        read = read.option("pathGlobFilter", "*{" + ",".join(sorted(extensions)) + "}")
    local = Path(re.sub(r"^file:(//)?", "", base))
    globs = ignore_patterns((local / ".gitignore").read_text()) if (local / ".gitignore").is_file() else []
    x = read.load(base).select(F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(str(local)).replace(r"\-", "-") + "/", "").alias("path"), F.col("content").cast("string").alias("code"))
    parts = F.split("path", "/")
    x = x.where(~F.exists(parts, lambda s: s.startswith(".") | s.isin(*ALWAYS_SKIP)))
    for g in globs:
        pattern = fnmatch.translate(g).replace(r"(?s:", "(?:").replace(r"\Z", "$").replace(r"\z", "$")
        x = x.where(~F.exists(parts, _matcher("^" + pattern)) & ~F.col("path").startswith(g + "/") & (F.col("path") != g))
    return x.where(extension("path").isin(*extensions)) if extensions else x


def _matcher(pattern: str):
    return lambda s: s.rlike(pattern)


def git(repo: str, *args: str, seconds: int = 10) -> str:
    """What a git command prints; nothing if it fails."""
    try:
        return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, timeout=seconds, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return ""


LOG = "hash string, author string, date string, message string, files array<string>"


def parse_log(text: str) -> list[tuple[str, str, str, str, list[str]]]:
    """Commits of a log of hash|author|date|subject lines with names of files under each; blank lines between them are no matter."""
    out: list[tuple[str, str, str, str, list[str]]] = []
    for line in text.split("\n"):
        parts = line.split("|")
        if len(parts) >= 4 and re.fullmatch(r"\d{4}-\d\d-\d\d", parts[2]):
            out.append((parts[0], parts[1], parts[2], "|".join(parts[3:]), []))
        elif line.strip() and out:
            out[-1][4].append(line.strip())
    return out


def log(spark: SparkSession, repo: str, count: int = 100) -> DataFrame:
    """The last commits of a repository."""
    return spark.createDataFrame(parse_log(git(repo, "log", "--format=%h|%an|%as|%s", "--name-only", "-n", str(count))), LOG)


def touches_of(commits: DataFrame) -> DataFrame:
    """Commits as rows of touched files, for the history operators."""
    x = commits.select("hash", "author", "message", F.to_date("date").alias("d"), F.posexplode("files").alias("n", "file"))
    return x.select(F.col("n").cast("bigint").alias("event_id"), "hash", "author", "file", "message", F.unix_seconds(F.col("d").cast("timestamp")).alias("second"), F.unix_date("d").cast("bigint").alias("day"))


def parse_blame(text: str) -> tuple[str, str, str] | None:
    """(author, date, subject) of a porcelain blame; None if there is no author."""
    found = {k: v for k, v in re.findall(r"(?m)^(author|author-time|summary) (.*)$", text)}
    if not found.get("author"):
        return None
    from datetime import datetime, timezone

    return found["author"], datetime.fromtimestamp(int(found.get("author-time", 0)), timezone.utc).date().isoformat(), found.get("summary", "")


def blame(repo: str, file: str, line: int):
    return parse_blame(git(repo, "blame", "--porcelain", "-L", f"{line},{line}", "--", file, seconds=5))


def diff(spark: SparkSession, repo: str, *files: str) -> DataFrame:
    """(file, line_no, line): the differences of files from the last commit."""
    rows = [(f, i, line) for f in files for i, line in enumerate(git(repo, "diff", "HEAD", "--", f).split("\n"))]
    return spark.createDataFrame(rows, "file string, line_no int, line string")


def status(spark: SparkSession, text: DataFrame) -> DataFrame:
    """(path, status) of porcelain status lines in ``value``; a renamed file has its new name."""
    code, rest = F.substring("value", 1, 2), F.trim(F.substr("value", F.lit(4)))
    path = F.trim(F.element_at(F.split(rest, " -> "), -1))
    kind = F.when(F.contains(code, F.lit("D")), "deleted").when(F.contains(code, F.lit("A")) | (code == "??"), "added").otherwise("modified")
    return text.where("value <> ''").select(path.alias("path"), kind.alias("status"))


def changed(spark: SparkSession, repo: str) -> DataFrame:
    """status() of a repository's working tree, new files one by one."""
    return status(spark, spark.createDataFrame([(s,) for s in git(repo, "status", "--porcelain", "-uall").split("\n")], "value string"))


def head_sha(repo: str) -> str:
    return git(repo, "rev-parse", "--short", "HEAD").strip() or "unknown"


DEFAULTS = {"ir": {"confidence_threshold": 0.6, "delta_context_lines": 3}, "trends": {"enabled": True, "hotspot_threshold": 10, "bugfix_ratio_threshold": 0.5}}


def deep_merge(base: dict, over: dict) -> dict:
    """over upon base: mappings merge, anything else replaces."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def settings(path: str) -> dict:
    """Settings of a JSON or, where PyYAML is there, a YAML file over the defaults; a missing or empty file changes nothing."""
    p = Path(path)
    if not p.is_file() or not (text := p.read_text()).strip():
        return DEFAULTS
    if p.suffix == ".json":
        return deep_merge(DEFAULTS, json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise ValueError("YAML settings need PyYAML; JSON doesn't") from e
    return deep_merge(DEFAULTS, yaml.safe_load(text) or {})


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON artifact written before; rows that aren't JSON are left out, a missing file is empty."""
    local = Path(re.sub(r"^file:(//)?", "", path))
    if not local.exists():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt is null").drop("_corrupt")


def write_map(entries: DataFrame, path: str, title: str = "Navigation map") -> None:
    """Writes entries (path, ir) as one ordered Markdown text, by one task, to a folder."""
    body = F.concat(F.lit("## "), "path", F.lit("\n"), "ir", F.lit("\n"))
    head = entries.sparkSession.createDataFrame([("", f"# {title}\n")], "path string, value string")
    head.union(entries.select("path", body.alias("value"))).coalesce(1).sortWithinPartitions("path").select("value").write.mode("overwrite").text(path)


def append_metrics(hashes: DataFrame, path: str) -> None:
    """Adds a row of hashes and the time to a log of JSON lines."""
    hashes.withColumn("ts", F.current_timestamp()).write.mode("append").json(path)

"""Virtual inputs: history, code, diffs and messages made of the star schema, the same in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.once import once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: One commit is a user's day; a file is the number in an event's properties.
TOUCH_COLUMNS = {
    "hash": "concat(user_id, '-', CAST({day} AS {string}))",
    "message": "CASE event_type WHEN 'error' THEN concat('fix: mend f', {k}) WHEN 'signup' THEN concat('feat: fixes of f', {k}) WHEN 'view' THEN concat('refactor: turn f', {k}) "
    "WHEN 'click' THEN concat('This reverts commit ', user_id, '-', CAST({eve} AS {string})) ELSE concat('docs: patchwork on f', {k}) END",
}


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, hash, author, file, message, t, second, day): one row for each touch of a file by a commit."""
    say = {"day": "date(ts)", "eve": "date_sub(date(ts), 1)", "k": "get_json_object(props, '$.k')", "string": "string"}
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.expr(TOUCH_COLUMNS["hash"].format(**say)).alias("hash"),
        F.col("user_id").alias("author"),
        F.get_json_object("props", "$.k").cast("int").alias("file"),
        F.expr(TOUCH_COLUMNS["message"].format(**say)).alias("message"),
        F.col("ts").alias("t"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"),
        F.unix_date(F.to_date("ts")).cast("bigint").alias("day"),
    )


_say = {"day": "CAST(ts AS DATE)", "eve": "(CAST(ts AS DATE) - 1)", "k": "json_extract_string(props, '$.k')", "string": "VARCHAR"}
BUG = "(?i)\\b(?:fix|bugfix|hotfix|patch|resolve|bug)\\b"
TOUCHES = f"""touches AS (SELECT event_id, {TOUCH_COLUMNS['hash'].format(**_say)} AS hash, user_id AS author, CAST(json_extract_string(props, '$.k') AS INTEGER) AS file,
  {TOUCH_COLUMNS['message'].format(**_say)} AS message, ts AS t, CAST(floor(epoch(ts)) AS BIGINT) AS second, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS BIGINT) AS day,
  regexp_matches({TOUCH_COLUMNS['message'].format(**_say)}, '{BUG}') AS is_fix FROM events)"""

#: Templates of code lines: text and {expressions} of the order key o and the line number n.
TEMPLATES = (
    'import {{ a{o % 7}, b{n} }} from "./f{o // 2}"',
    "export function run{o % 97}(x, y) {{",
    "  if (x{n} > {o % 7}) return y{n};",
    "const v{n} = {o % 11};",
    "class C{o % 97} extends B{o % 5} {{",
    "  for (const it of list{n}) {{",
    "    return x{n} + {o % 10};",
    "// note {o % 3}",
    "#include <lib{o % 17}.h>",
    "struct S{o % 97} : Base{o % 5} {{",
    "  call{n}(x{n});",
    "",
)
EXTENSIONS = (".ts", ".py", ".cpp", ".java", ".rb")


def _template(text: str, div: str) -> str:
    """A template as SQL: concat() of literals and expressions over o and n."""
    import string

    parts = []
    for literal, field, _, _ in string.Formatter().parse(text):
        if literal:
            parts.append("'" + literal.replace("'", "''") + "'")
        if field:
            parts.append("CAST(" + field.replace("//", div) + f" AS {'STRING' if div == 'div' else 'VARCHAR'})")
    return f"concat({', '.join(parts)})" if parts else "''"


def _line(div: str) -> str:
    return f"CASE ((o * 7 + n) {div} 4) % 12 " + " ".join(f"WHEN {i} THEN {_template(t, div)}" for i, t in enumerate(TEMPLATES)) + " END"


#: Files that a task makes and reads, at most.
FILES_A_TASK = 1 << 16


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, file_ord, ext, code): one file for each order, its lines made in the row, so that nothing is shuffled."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"))
    parts = max(spark.sparkContext.defaultParallelism, -(-o.count() // FILES_A_TASK))  # the count is read from footers
    if o.rdd.getNumPartitions() < parts:  # keys are short, and the files made of them long: only keys are moved
        o = o.repartition(parts)
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("o") % 5 + 1).cast("int"))
    lines = F.expr(f"transform(sequence(1, CAST(8 + o % 9 AS INT)), n -> {_line('div')})")
    return once(o.select(F.concat(F.lit("src/f"), F.col("o").cast("string"), ext).alias("path"), F.col("o").alias("file_ord"), ext.alias("ext"), F.array_join(lines, "\n").alias("code")))


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, file_ord, ext, line_no, raw)."""
    return code_files(spark, sf_dir).select("path", "file_ord", "ext", F.posexplode(F.split("code", "\n")).alias("p", "raw")).select("path", "file_ord", "ext", (F.col("p") + 1).alias("line_no"), "raw")


LINES = f"""code_lines AS (SELECT concat('src/f', o, ext) AS path, o AS file_ord, ext, CAST(n AS INTEGER) AS line_no, {_line('//')} AS raw
  FROM (SELECT o_orderkey AS o, [{', '.join(f"'{e}'" for e in EXTENSIONS)}][o_orderkey % 5 + 1] AS ext, unnest(range(1, 9 + o_orderkey % 9)) AS n FROM orders))"""
FILES = f"""{LINES}, code_files AS (SELECT path, file_ord, any_value(ext) AS ext, string_agg(raw, chr(10) ORDER BY line_no) AS code FROM code_lines GROUP BY path, file_ord)"""

_FENCE_LINES = ("import {{ a }} from \"./m{c}\"", "export function f{c}(x, y, z) {{", "  // does one thing {c}", "  if (x > {n}) return y;", "", "  // and then another {c} thing", "  return x + {n};", "}}")


def _fence(div: str) -> str:
    body = "concat(" + ", '\n', ".join(_template(t, div) for t in _FENCE_LINES) + ")"
    tick = "'```'"
    return (
        f"CASE n % 3 WHEN 0 THEN concat(text, '\n', {tick}, CASE WHEN c % 2 = 0 THEN 'ts' ELSE concat('js src/m', CAST(c AS {'STRING' if div == 'div' else 'VARCHAR'}), '.js') END, '\n', {body}, '\n', {tick}, '\nand ', {tick}, 'py\nreturn 1\n', {tick}, ' end') "
        f"WHEN 1 THEN concat('see ', {tick}, 'json\n{{\"a\": 1}}\n', {tick}, '\n', text) ELSE text END"
    )


def fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, text): conversations with code fences."""
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.col("conv_id").alias("c"), F.col("turn").alias("n"))
    return once(x.select("conv_id", "turn", "role", F.expr(_fence("div")).alias("text")))


FENCED = f"""fenced AS (SELECT conv_id, turn, role, {_fence('//')} AS text FROM (SELECT *, conv_id AS c, turn AS n FROM conversations))"""


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, line): a diff of each file, with a hunk at every fifth line."""
    x = code_lines(spark, sf_dir)
    head = F.concat(F.lit("@@ -"), F.col("line_no").cast("string"), F.lit(",4 +"), (F.col("line_no") + 1).cast("string"), F.lit(",4 @@ "), F.col("raw"))
    sign = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), (F.col("line_no") % 3 + 1).cast("int"))
    return x.select(F.col("path").alias("file"), "line_no", F.when(F.col("line_no") % 5 == 2, head).otherwise(F.concat(sign, F.col("raw"))).alias("line"))


def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, lines): the lines of diffs() in order, a row a file."""
    head = "concat('@@ -', CAST(i + 1 AS STRING), ',4 +', CAST(i + 2 AS STRING), ',4 @@ ', raw)"
    line = f"CASE WHEN (i + 1) % 5 = 2 THEN {head} ELSE concat(element_at(array('+', '-', ' '), (i + 1) % 3 + 1), raw) END"
    return code_files(spark, sf_dir).select(F.col("path").alias("file"), F.expr(f"transform(split(code, '\\n'), (raw, i) -> {line})").alias("lines"))


DIFFS = f"""{LINES}, diffs AS (SELECT path AS file, line_no, CASE WHEN line_no % 5 = 2 THEN concat('@@ -', line_no, ',4 +', line_no + 1, ',4 @@ ', raw) ELSE concat(['+', '-', ' '][line_no % 3 + 1], raw) END AS line FROM code_lines)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, rel_path, ts): changed paths, some ignored, some not source."""
    k = F.get_json_object("props", "$.k").cast("int")
    folder = F.element_at(F.array(*map(F.lit, ("src/", "node_modules/", "lib/", ".git/", "dist/"))), (k % 5 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, (".ts", ".md", ".py", ".json"))), (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(folder, F.lit("f"), k.cast("string"), ext).alias("rel_path"), "ts")


CHANGES = """changes AS (SELECT event_id, concat(['src/', 'node_modules/', 'lib/', '.git/', 'dist/'][k % 5 + 1], 'f', k, ['.ts', '.md', '.py', '.json'][user_id % 4 + 1]) AS rel_path, ts
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


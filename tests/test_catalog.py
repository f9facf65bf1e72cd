"""The catalogue against its SQL on the smallest tables."""

import duckdb
import pytest

from siltstone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Slow ones have their own tests; the driver runs them all.
SOME = ("backtest_confusion", "auc", "threshold_sweep", "handoff_reuse", "coverage_warning", "fingerprint_lines", "benchmark_files", "delta_context", "pack_upgrade", "read_decision", "token_stats_by_lang", "line_structure", "fingerprint_file", "generic_structure", "l1_ir", "hotspots", "author_style_mode", "health", "fix_links_72h", "verdict", "diff_hunks", "fence_compress", "debounce_islands", "cochange_v2")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    rel = duck.sql(catalog.ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == want


def test_all_but_syntax_have_sql(spark, sf):
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"ast_ir", "symbol_diff", "layers", "syntax_benchmark_files", "syntax_benchmark_summary", "syntax_handoff_delta", "syntax_fence_compress", "syntax_pack_summary"}
    kinds = {r.change for r in catalog.QUERIES["symbol_diff"](spark, sf).collect()}
    assert kinds == {"added", "deleted"}
    assert catalog.QUERIES["ast_ir"](spark, sf).where("engine = 'AST'").count() > 100


def test_truth_has_every_broken_file(spark, monkeypatch):
    rows = [(i, f"h{i}", "a", f, m, s * 3600) for i, (f, m, s) in enumerate([(1, "feat: x", 1), (1, "fix: x", 2), (2, "feat: y", 1), (2, "fix: y", 2), (3, "feat: z", 1)])]
    touches = spark.createDataFrame(rows, "event_id long, hash string, author string, file int, message string, second long")
    monkeypatch.setattr(catalog.S, "touches", lambda *_: touches)
    assert sorted(r.file for r in catalog._truth(spark, "").collect()) == [1, 2]


def test_syntax_first(spark, sf):
    """Every file by the syntax walk on its own, lines where that gives nothing, the source where the IR isn't shorter."""
    from siltstone.operators import lines, syntax

    def tokens(text):
        return len(lines.compiled(catalog.T.TOKEN).findall(text))

    files = {r.path: r.code for r in catalog.S.code_files(spark, sf).collect()}
    got = {r.path: r for r in catalog.QUERIES["syntax_benchmark_files"](spark, sf).collect()}
    shown = {r.path: r for r in catalog.QUERIES["layers"](spark, sf).collect()}
    assert set(got) == set(files) == set(shown)
    made = {"AST": 0, "FP": 0, "GENERIC": 0, "NONE": 0}
    for path, code in files.items():
        lang = lines.LANGUAGES.get(lines.extension_of(path))
        walked = syntax.syntax_ir(code, lang) if lang else None
        generic = lines.extension_of(path) in lines.GENERIC
        ir = lines.generic_text(code) if generic else walked if walked is not None else lines.fingerprint_text(code, 0.75)
        best = ir if ir.strip() and tokens(ir) < tokens(code) else code
        engine = "GENERIC" if generic else "NONE" if not lang else "AST" if walked is not None else "FP"
        made[engine] += 1
        assert (got[path].engine, got[path].l1_tokens) == (engine, tokens(best)), path
        assert (shown[path].l1, shown[path].l2, shown[path].l3) == (best, best, code)
        assert shown[path].l0.startswith(path + "\n")
    assert made["AST"] > 100 and made["GENERIC"] and made["NONE"]
    s = catalog.QUERIES["syntax_benchmark_summary"](spark, sf).first()
    assert (s.n_ast, s.n_fp, s.n_generic, s.n_none) == tuple(made[k] for k in ("AST", "FP", "GENERIC", "NONE"))


def test_plain_rules_equal_columns(spark):
    """The rules worked out in Python and as Spark columns."""
    from pyspark.sql import functions as F

    from siltstone.operators import lines
    from siltstone.plans.dialect import SparkText, trim

    made = [r.raw for r in catalog.S.code_lines(spark, "/root/testdata/sf0.001").select("raw").distinct().limit(400).collect()]
    odd = ["", "   ", "\treturn;", "  } catch (e) {", "case 'é': ", "const {a, b} = f(x);", "let [x, y] = z", "export const g = async (a) => { ", "get x() {", "set y(v) {", "if (x) return y;", "if (ok) go(1, 2)", "for (const a of b) {", "switch (x) {", "default:", "const ünï = 3", "foo(a, b) {", "if (a) {", "while (x) {", "import x from 'y'", "const m = require('n')", "// note", "* star", "});", "\u00a0return 1"]
    t = trim(SparkText, F.col("raw"))
    df = spark.createDataFrame([(x,) for x in made + odd], "raw string").withColumn("t", t)
    df = df.withColumn("r", lines.rule_of(SparkText, F.col("t"))).withColumn("ir", lines.text_of(SparkText, F.col("r"), F.col("t"))).withColumn("g", lines.generic_line(SparkText, F.col("t")))
    df = df.withColumn("k", lines.classify(SparkText, lines.first_token(SparkText, F.col("raw"))))
    from siltstone.plans.dialect import Plain

    for r in df.collect():
        line = r.raw.strip(lines._EDGE)
        assert (line, *lines.ruled(line), lines._declared(line), lines._kind(lines.first_token(Plain, r.raw))) == (r.t, r.r, r.ir, r.g, r.k), r.raw


ODD = "import a from 'a'\n\nimport {b} from 'b'\nconst c = require('c')\nimport d from 'd'\nimport e from 'e'\nif (a) return 1;\nif (b) return 2;\n// z\nif (c) return x -> y;\nfoo\nif (d) return\n  if (e) return 5;"


def test_runs_in_a_file_equal_runs_of_rows(spark, sf):
    """Imports and guards are merged in the file's row, with no shuffle but that of the keys."""
    from pyspark.sql import functions as F

    from siltstone.operators import lines

    files = catalog.S.code_files(spark, sf).select("path", "code").union(spark.createDataFrame([("odd.ts", ODD), ("e.ts", ""), ("n.ts", None)], "path string, code string"))
    rows = files.select("path", F.posexplode(F.split("code", "\n")).alias("p", "raw")).select("path", (F.col("p") + 1).alias("line_no"), "raw")
    ir = lines.fingerprint_lines(rows).where("ir <> ''").select("path", F.col("line_no").alias("ord"), F.regexp_replace("ir", " -> ", " → ").alias("line"))
    for kind, whole in (("imports", lines.merge_imports), ("guards", lines.merge_guards)):
        assert sorted(map(tuple, lines.merged(files, kind).collect())) == sorted(map(tuple, whole(ir).collect()))
    for name in ("use_merge", "guard_merge", "diff_hunks", "delta_context", "syntax_handoff_delta"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "Window" not in plan and "Join" not in plan, name


def test_hunks_of_files_equal_those_of_rows(spark, sf):
    from pyspark.sql import functions as F

    from siltstone.operators import deltas

    odd = spark.createDataFrame([("a", ["x", "@@ -1 +2 @@", "+a", "+++b", "---c", "-d", "", "\\", " return x;", "@@ -1,2 +9,3 @@ f", "@@ -3 +4 @@"]), ("b", ["+a"]), ("c", [])], "file string, lines array<string>")
    x = catalog.S.diff_files(spark, sf).union(odd)
    rows = x.select("file", F.posexplode("lines").alias("line_no", "line"))
    for parts, whole in ((("added", "removed", "context"), deltas.hunks), (("changed", "surrounding_ir"), deltas.delta_context)):
        assert sorted(map(tuple, deltas.hunks_of_files(x, *parts).collect())) == sorted(map(tuple, whole(rows).collect()))
    assert sorted(map(tuple, catalog.S.diffs(spark, sf).collect())) == sorted((r.file, i, t) for r in catalog.S.diff_files(spark, sf).collect() for i, t in enumerate(r.lines, 1))


def test_only_changed_files_are_walked(spark, sf):
    from pyspark.sql import functions as F

    from siltstone.operators import handoff, syntax

    x = catalog.S.code_files(spark, sf).where("ext = '.ts'").select("path", "code")
    y = x.withColumn("code", F.regexp_replace("code", r"function run(\d*5)\b", "function walk$1"))
    got = catalog.QUERIES["symbol_diff"](spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, syntax.symbol_diff(x, y).collect()))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    status = catalog._status(spark, sf)
    want = handoff.changed_files(status.select("path", "status"), status.select("path", "code"))
    assert sorted(map(tuple, catalog.QUERIES["syntax_handoff_delta"](spark, sf).collect())) == sorted(map(tuple, want.collect()))


def test_tasks_have_few_files(spark, sf, monkeypatch):
    monkeypatch.setattr(catalog.S, "FILES_A_TASK", 100)
    n = catalog.S.table(spark, sf, "orders").count()
    assert n > 1000 and catalog.S.code_files(spark, sf).rdd.getNumPartitions() >= n / 100


def test_truncated_pack_makes_maps_only(spark, monkeypatch):
    from siltstone.operators import packing

    files = spark.createDataFrame([(f"s/f{i}.ts", i, f"function g{i}(x) {{\n  return x\n}}\n" * (i % 3 + 1)) for i in range(50)], "path string, file_ord long, code string")
    monkeypatch.setattr(packing, "with_layers", None)
    entries, summary = packing.pack(files, 200)
    got, left = {r.path: r for r in entries.collect()}, 200
    from siltstone.operators import lines

    for r in sorted(files.collect(), key=lambda r: r.file_ord):
        text = lines.l0_of(r.path, r.code)
        n = len(lines.compiled(catalog.T.TOKEN).findall(text))
        assert (r.path in got) == (n <= left)
        if n <= left:
            left -= n
            assert tuple(got[r.path]) == (r.path, "L0", text, n, False)
    s = summary.first()
    assert (s.total_tokens, s.files_at_l0, s.truncated, s.missing) == (200 - left, len(got), True, False)

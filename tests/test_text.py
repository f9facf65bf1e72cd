import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import lines as L


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_tokens(spark):
    r = random.Random(0)
    texts = ["".join(r.choice("ab {}()[];,.:=<>!&|?+-*/^~@#$%\\\n\t_é") for _ in range(r.randint(0, 40))) for _ in range(300)] + [""]
    got = [x.n for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.token_count("t").alias("n")).collect()]
    split = "([" + "".join("\\" + c for c in T.SIGNS) + "])"
    assert got == [len([p for w in t.split() for p in re.split(split, w) if p]) for t in texts]
    assert one(spark, None, T.token_count) == 0


@pytest.mark.parametrize("message,fix", [("fix: x", True), ("Hotfix y", True), ("a BUG here", True), ("resolve z", True), ("fixes", False), ("prefix it", False), ("feat: debug", False), (None, False)])
def test_bugfix(spark, message, fix):
    assert one(spark, message, T.is_bugfix) is fix


def test_collapse(spark):
    assert one(spark, "  a \n  b   c ", lambda x: T.collapse_text(x, 60)) == "a b c"
    assert one(spark, "x" * 100, lambda x: T.collapse_text(x, 10)) == "xxxxxxx..."
    long = 'mood === "sinking" ? "low" : mood === "rising" ? "high" : "flat"'
    got = one(spark, long, lambda x: T.collapse_expr(x, 40))
    assert got == long[:37] + '...{"rising","high","flat"}'
    assert one(spark, "y" * 80, lambda x: T.collapse_expr(x, 60)) == "y" * 57 + "..."


def test_health_tag(spark):
    tag = lambda *v: spark.createDataFrame([v], "c long, r double, t string, k string").select(T.health_tag("c", "r", "t", "k").alias("y")).first().y
    assert tag(21, 0.555, "down", "low") == "[HOT:21/30 FIX:56% COV:↓ INCON]"
    assert tag(10, 0.5, "stable", "high") == ""
    ir = lambda t: spark.createDataFrame([("a $1\nb", t)], "i string, t string").select(T.annotate("i", "t").alias("y")).first().y
    assert ir("[T\\$]") == "a $1 [T\\$]\nb" and ir("") == "a $1\nb"


def test_small_ones(spark):
    assert T.identifier_variants("widget-list-v2") == ["widget-list-v2", "WidgetListV2", "widgetListV2"]
    assert T.identifier_variants("plain") == ["plain"]
    assert one(spark, "a\nb\nc", lambda x: T.slice_lines(x, 2, 3)) == "b\nc"
    assert one(spark, "a\nb\nc", lambda x: T.remove_line(x, 2)) == "a\nc"
    assert one(spark, "Foo-Bar_baz.x", T.plain_name) == "foobarbazx"
    assert one(spark, "abc", T.sha12) == "ba7816bf8f01"
    pct = lambda a, b: spark.createDataFrame([(a, b)], "a long, b long").select(T.percent_change("a", "b").alias("y")).first().y
    assert (pct(100, 27), pct(0, 0), pct(5, 5)) == ("-73%", "0%", "0%")


def test_registered_functions(spark):
    T.register(spark)
    r = spark.sql("SELECT token_count('a.b(c)') AS n, bugfix('fix it') AS f").first()
    assert (r.n, r.f) == (6, True)
    assert [tuple(x) for x in spark.sql("SELECT * FROM code_lines('a\nb')").collect()] == [(1, "a"), (2, "b")]


@pytest.mark.parametrize(
    "line,ir,confidence",
    [
        ('import { a, b } from "./m";', "USE:./m{a,b}", 0.95),
        ('import type { A } from "t"', "USE:t{A}", 0.95),
        ("import x from 'y'", "USE:y{x}", 0.95),
        ('const fs = require("fs");', "USE:fs{fs}", 0.95),
        ("export async function go(a: string, b) {", "OUT FN:go(a:string,b)", 0.95),
        ("function go() {", "FN:go()", 0.95),
        ("export class A extends B {", "OUT CLASS:A < B", 0.95),
        ("class A {", "CLASS:A", 0.95),
        ("if (!x) return null;", "IF:!x -> RET null", 0.95),
        ("  if (a > b) {", "IF:a > b", 0.9),
        ("for (const x of xs) {", "LOOP:xs -> x", 0.9),
        ("return a + b;", "RET a + b", 0.95),
        ("return;", "RET", 0.95),
        ("} catch (e) {", "CATCH:e", 0.9),
        ('case "a":', 'CASE:"a"', 0.9),
        ("default:", "DEFAULT:", 0.9),
        ("export type T<A> = B;", "OUT TYPE:T", 0.9),
        ("name?: string;", "PROP:name: string", 0.75),
        ("const r = await go(1);", "AWAIT:VAR:r = go(1)", 0.85),
        ("export const f = async (a) => {", "OUT ASYNC FN:f = (a) => {", 0.9),
        ("const f = (a) => a + 1;", "FN:f = (a) => a + 1", 0.9),
        ("get size() {", "GET:size()", 0.9),
        ("run(a, b) {", "METHOD:run(a,b)", 0.9),
        ("const { a, b } = c;", "VAR:{a,b} = c", 0.9),
        ("const [a, b] = c;", "VAR:[a,b] = c", 0.9),
        ("let x = 5;", "VAR:x = 5", 0.85),
        ("}", "", 1.0),
        ("// note", "", 1.0),
        ("something odd!", "something odd!", 0.1),
    ],
)
def test_fingerprints(spark, line, ir, confidence):
    r = L.fingerprint_lines(spark.createDataFrame([(line,)], "raw string")).first()
    assert (r.ir, r.confidence) == (ir, confidence)
    assert r.kind == ("raw" if confidence == 0.1 else "fingerprint" if confidence > 0.9 else "fingerprint+hint")


def test_structure(spark):
    rows = [(i, x) for i, x in enumerate(["function f() {", "  if(x) {", "", "\treturn 1", "import a", "pub fn x", "const a", "try {", "async go", "# c", "zzz", "class A<T>"])]
    got = [(r.indent, r.type) for r in L.structure(spark.createDataFrame(rows, "i int, raw string")).orderBy("i").collect()]
    assert got == [(0, "function-start"), (2, "branch"), (-1, "blank"), (1, "exit"), (0, "import"), (0, "export"), (0, "assignment"), (0, "error-handling"), (0, "async"), (0, "comment"), (0, "unknown"), (0, "type-start")]


CPP = """#include <vector>
#include "x.h"
#include <vector>
namespace a::b {
enum class Color : int { RED };
struct P { int x; };
class Q : public P {
  void run(int a) override;
  std::sort(a.begin());
  foo();
  int y = bar(1);
  if (x) {
  return go();
}
int main(int argc) {
"""


def test_generic(spark):
    assert one(spark, CPP, L.generic_structure).split("\n") == ["USE:vector", "USE:x.h", "NS:a::b", "ENUM:Color < int", "CLASS:P", "CLASS:Q < public P", "FN:run", "FN:main"]


def test_layers(spark):
    ts = "export function a(x) {\n  return x\n}\nclass B {\n}\nexport interface C {\n"
    rows = spark.createDataFrame([("s/a.ts", ts), ("s/a.cpp", CPP), ("s/e.py", ""), ("s/x.ts", "zz")], "path string, code string")
    got = {r.path: r for r in L.with_layers(rows).collect()}
    assert got["s/a.ts"].l0 == "s/a.ts\n  FN:a L1\n  CLASS:B L4\n  FN:C L6"
    assert got["s/e.py"].l0 == "s/e.py\n" and got["s/e.py"].l1 == "" and got["s/x.ts"].l1 == "zz"
    assert got["s/a.ts"].l1.startswith("OUT FN:a(x)\n  RET x")
    assert all(r.l1_tokens <= r.raw_tokens for r in got.values())


def test_merges(spark):
    rows = [("f", i, x) for i, x in enumerate(["USE:a", "USE:b", "USE:c", "USE:d", "X", "USE:e", '  IF:a → RET 1', "  IF:b → THROW:x", "  IF:c → RET", "Y", "IF:d → RET 2"])]
    ir = spark.createDataFrame(rows, "path string, ord int, line string")
    got = [r.line for r in L.merge_imports(ir).orderBy("ord").collect()]
    assert got[:3] == ["USE:[a, b, c, d]", "X", "USE:e"] and len(got) == 8
    got = [r.line for r in L.merge_guards(ir).orderBy("ord").collect()]
    assert got[6:] == ["  GUARD:[a → 1, b → THROW:x, c → RET]", "Y", "IF:d → RET 2"]


def test_collapsed_text_is_made_once_a_row(spark):
    """Not anew for each literal: time would grow with their number times the text."""
    from siltstone.operators.syntax import telling

    texts = ["x = 'a'", "", "  f(" + ", ".join(f'"k{i % 90}"' for i in range(400)) + ")\n  ;", "y" * 80, None]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select("t", T.collapse_expr("t", 60).alias("s"))
    assert {r.t: r.s for r in df.collect()} == {x: telling(x, 60) if x is not None else None for x in texts}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 3

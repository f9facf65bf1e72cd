import subprocess

import pytest

from siltstone.operators import syntax as X
from siltstone.sources import files as S

TS = '''import { a } from "./a";
import b from "./b";
import * as c from "c";
import "d";
/** Runs the thing well. */
export async function run(x: string, y = 3): Promise<void> {
  if (!x) { return null; }
  if (y > 3) throw new Error("too big");
  if (y === 0) return;
  const kind = x === "declining" ? "down" : "up";
  const plain = x + y;
  for (const z of x) {
    if (z) {
      go(z);
    } else {
      return z;
    }
  }
  const got = await load(x);
  switch (x) {
    case "a:b":
      return 1;
    default:
      return 2;
  }
}
export interface Opts<T> { a: T }
type Id = string | number;
enum Color { Red }
const LIMIT = 30;
const LIST = [1, [2, 3], "a,b"];
const MAP = { a: 1, b() { return 2 }, "c": 3 };
const cache = new Map();
const pick = (a, b) => a + b;
app.get = function (path) { return 1 };
export class Store<T> extends Base {
  private x = 1;
  async load(id: string) { return this.x }
  _hidden() { return 0 }
}
'''


def test_typescript():
    got = X.syntax_ir(TS, "typescript").split("\n")
    assert got == [
        "USE:[./a, ./b, c, d]",
        '"Runs the thing well." OUT ASYNC FN:run(x: string, y = 3)',
        '    GUARD:[!x → null, y > 3 → THROW:new Error("too big"), y === 0 → RET]',
        '    LET:kind = x === "declining" ? "down" : "up"',
        "    LOOP",
        "        IF:z",
        "              RET z",
        "    AWAIT:got=load(x)",
        "    SWITCH:x",
        '        CASE:"a:b"',
        "          RET 1",
        "        DEFAULT:",
        "          RET 2",
        "OUT INTERFACE:Opts<T>",
        "TYPE:Id",
        "ENUM:Color",
        "VAR:LIMIT = 30",
        "VAR:LIST[3]",
        'VAR:MAP{a, b, "c"}',
        "VAR:cache = new Map(...)",
        "FN:pick(a, b) => ...",
        "FN:app.get(path)",
        "OUT CLASS:Store<T>",
        "ASYNC METHOD:Store.load(id: string)",
        "        RET this.x",
        "        RET 0",
    ]


PY = '''import os
from a import b
@deco
class A(B, metaclass=M):
    """Holds all of the things."""
    def f(self, x: int = 1) -> str:
        if x > 1:
            return "a"
        elif x:
            raise ValueError("bad")
        for i in x:
            pass
async def g():
    try:
        return await h()
    except E:
        return None
'''


def test_python():
    assert X.syntax_ir(PY, "python").split("\n") == [
        "USE:import os",
        "USE:from a import b",
        '"Holds all of the things." CLASS:A((B, metaclass=M))',
        "FN:f(self, x: int=1) -> str",
        "        IF:x > 1",
        '            RET "a"',
        "        LOOP",
        "ASYNC FN:g()",
        "    TRY",
        "        RET await h()",
        "      EXCEPT",
        "          RET None",
    ]
    assert X.syntax_ir("def (", "python") is None


@pytest.mark.parametrize("code", ["", "{{{{", "}}}}", "if (", 'const a = "', "export", "class", "/* open", "`${a", "switch (x) { case", "for (;;)", "do", "try", "function", "=> => =>", "if (a) if (b) return"])
def test_broken_code_ends(code):
    for lang in ("typescript", "javascript", "go", "rust", "python"):
        X.syntax_ir(code, lang)


def test_go_and_rust():
    go = 'package a\nimport "fmt"\nfunc add(x int, y int) int {\n\tif x > 0 {\n\t\treturn x\n\t}\n\tdefer f()\n\treturn y\n}\nfunc (s *S) Run(a int) {\n}\n'
    assert X.syntax_ir(go, "go").split("\n") == ['import "fmt"', "FN:add(x int, y int)", "    IF:x > 0", "        RET x", "    DEFER", "    RET y", "func (s *S) Run(a int) { }"]
    rust = "use std::io;\npub struct P { x: i32 }\nimpl P {\n    pub fn new(x: i32) -> P {\n        return P { x };\n    }\n}\n"
    assert X.syntax_ir(rust, "rust").split("\n") == ["use std::io;", "pub struct P { x: i32 }", "impl P {", "FN:new(x: i32)", "        RET P { x }"]


def test_layers_and_symbols(spark):
    a = spark.createDataFrame([("a.ts", TS), ("b.py", PY), ("c.md", "x"), ("d.ts", "zz")], "path string, code string")
    x = X.with_syntax(a)
    got = {r.path: (r.engine, r.y) for r in x.withColumn("y", X.l1_syntax("path", "ir", "code")).collect()}
    assert got["a.ts"][0] == "AST" and len(got["a.ts"][1]) < len(TS) and got["d.ts"] == ("FP", "zz") and got["c.md"] == ("FP", "x")
    b = spark.createDataFrame([("a.ts", TS.replace("function run", "function walk")), ("b.py", PY)], "path string, code string")
    assert {tuple(r) for r in X.symbol_diff(a, b).collect()} == {("a.ts", "FN", "run", "deleted"), ("a.ts", "FN", "walk", "added")}


def test_log_and_blame():
    text = "h1|Ann|2026-01-02|fix: a|b\n\nsrc/a.ts\nsrc/b.ts\n\nh2|Bob|2026-01-01|feat\nc.py\n"
    assert S.parse_log(text) == [("h1", "Ann", "2026-01-02", "fix: a|b", ["src/a.ts", "src/b.ts"]), ("h2", "Bob", "2026-01-01", "feat", ["c.py"])]
    assert S.parse_blame("abc 1 1\nauthor Alice\nauthor-time 1712000000\nsummary fix it\n") == ("Alice", "2024-04-01", "fix it")
    assert S.parse_blame("") is None


def test_repository(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    for name, text in (("a.ts", "const a = 1\n"), ("b.py", "x = 1\n"), (".gitignore", "build/\n*.gen.ts\n# no\n"), ("x.gen.ts", "g"), ("build/c.ts", "c"), ("node_modules/d.ts", "d"), ("src/e.ts", "e"), ("f.md", "f")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    run("add", "a.ts", "b.py")
    run("commit", "-qm", "fix: first | of all")
    (tmp_path / "a.ts").write_text("const a = 2\n")
    (tmp_path / "b.py").unlink()
    assert sorted(r.path for r in S.scan(spark, str(tmp_path), (".ts", ".py")).collect()) == ["a.ts", "src/e.ts"]
    c = S.log(spark, str(tmp_path)).first()
    assert (c.message, c.files, c.author) == ("fix: first | of all", ["a.ts", "b.py"], "A")
    assert S.touches_of(S.log(spark, str(tmp_path))).count() == 2
    st = {r.path: r.status for r in S.changed(spark, str(tmp_path)).collect()}
    assert st["a.ts"] == "modified" and st["b.py"] == "deleted" and st["src/e.ts"] == "added"
    assert S.head_sha(str(tmp_path)) == c.hash and S.head_sha("/nowhere") == "unknown"
    from siltstone.operators import deltas

    assert [(r.added, r.removed) for r in deltas.hunks(S.diff(spark, str(tmp_path), "a.ts")).collect()] == [(["const a = 2"], ["const a = 1"])]
    assert S.log(spark, "/nowhere").count() == 0
    renamed = spark.createDataFrame([("R  old.ts -> new.ts",), (" D gone.ts",), ("",)], "value string")
    assert [tuple(r) for r in S.status(spark, renamed).collect()] == [("new.ts", "modified"), ("gone.ts", "deleted")]


def test_settings_and_artifacts(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text('{"trends": {"hotspot_threshold": 3}, "list": [1]}')
    s = S.settings(str(p))
    assert s["trends"] == {"enabled": True, "hotspot_threshold": 3, "bugfix_ratio_threshold": 0.5} and s["list"] == [1]
    assert S.settings(str(tmp_path / "none.json")) == S.DEFAULTS
    assert S.deep_merge({"a": [1, 2], "b": {"c": 1}}, {"a": [3], "b": {"d": 2}}) == {"a": [3], "b": {"c": 1, "d": 2}}
    h = tmp_path / "h.json"
    h.write_text('{"prefix_hash": "p"}\nbroken\n')
    assert [r.prefix_hash for r in S.read_artifact(spark, str(h), "prefix_hash string").collect()] == ["p"]
    assert S.read_artifact(spark, str(tmp_path / "no"), "a string").count() == 0
    S.write_map(spark.createDataFrame([("b.ts", "y"), ("a.ts", "x")], "path string, ir string"), str(tmp_path / "map"))
    text = "".join(x.read_text() for x in (tmp_path / "map").glob("part-*"))
    assert text.index("# Navigation map") < text.index("## a.ts") < text.index("## b.ts")
    for _ in range(2):
        S.append_metrics(spark.createDataFrame([("p",)], "prefix_hash string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2

"""Syntax walks: what a file declares and decides, as indented lines.

Python is parsed by its own parser, TypeScript, JavaScript, Go and Rust by a
small statement parser made here; both give the same kinds of lines.  A walk is
a tree recursion that no Spark expression has, so it runs in an Arrow UDF, one
batch of files at a time.
"""

from __future__ import annotations

import ast
import re
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import LITERAL, col
from siltstone.operators.lines import GUARD, LANGUAGES, extension_of, fingerprint_file, generic_structure, is_generic, language, shorter

DEPTH = 4
_SPACE = re.compile(r"\s*\n\s*|\s{2,}")


def short(text: str, most: int) -> str:
    text = _SPACE.sub(" ", text).strip()
    return text if len(text) <= most else text[: most - 3] + "..."


def telling(text: str, most: int) -> str:
    """short(), with the string literals that the cut lost behind it."""
    text = _SPACE.sub(" ", text).strip()
    if len(text) <= most:
        return text
    head = text[: most - 3] + "..."
    lost = list(dict.fromkeys(s for s in re.findall(LITERAL, text) if s not in head))
    return head + ("{" + ",".join(lost) + "}" if lost else "")


def _doc(text: str | None) -> str:
    line = (text or "").strip().split("\n")[0].strip()
    return "" if len(line) < 5 else '"' + (line[:27] + "..." if len(line) > 30 else line) + '" '


# Python


def walk_python(code: str) -> list[str] | None:
    """Lines of a Python file; None if it doesn't parse.  Decorated definitions are emitted like others."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return None
    out: list[str] = []
    rows = code.splitlines()
    text = lambda n: ast.get_source_segment(code, n) or ast.unparse(n)

    def add(depth: int, line: str) -> None:
        out.append("  " * depth + line)

    def block(body, depth):
        for n in body:
            visit(n, depth)

    def visit(n, depth):
        deep = depth > DEPTH
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            out.append("USE:" + short(text(n), 80))
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            back = " -> " + text(n.returns) if n.returns else ""
            out.append(f"{_doc(ast.get_docstring(n))}{'ASYNC ' if isinstance(n, ast.AsyncFunctionDef) else ''}FN:{n.name}{short('(' + ast.unparse(n.args) + ')', 60)}{back}")
            block(n.body, depth + 2)
        elif isinstance(n, ast.ClassDef):
            bases = ", ".join([*map(text, n.bases), *(f"{k.arg}={text(k.value)}" for k in n.keywords)])
            out.append(f"{_doc(ast.get_docstring(n))}CLASS:{n.name}" + (f"({short(f'({bases})', 40)})" if bases else ""))
            block(n.body, depth + 2)
        elif isinstance(n, ast.If):
            if not deep:
                add(depth, "IF:" + telling(text(n.test), 60))
                block(n.body, depth + 2)
                rest = n.orelse
                while len(rest) == 1 and isinstance(rest[0], ast.If) and rows[rest[0].lineno - 1].lstrip().startswith("elif"):
                    if depth + 1 <= DEPTH:
                        add(depth + 1, "ELIF:" + telling(text(rest[0].test), 60))
                        block(rest[0].body, depth + 3)
                    rest = rest[0].orelse
                block(rest, depth + 3)
        elif isinstance(n, (ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith)):
            head = "WITH" if isinstance(n, (ast.With, ast.AsyncWith)) else "WHILE:" + telling(text(n.test), 60) if isinstance(n, ast.While) else "LOOP"
            if not deep:
                add(depth, head)
                block(n.body, depth + 2)
                block(getattr(n, "orelse", []), depth + 3)
        elif isinstance(n, (ast.Try, ast.TryStar)):
            if not deep:
                add(depth, "TRY")
                block(n.body, depth + 2)
                for h in n.handlers:
                    if depth + 1 <= DEPTH:
                        add(depth + 1, "EXCEPT")
                        block(h.body, depth + 3)
                block(n.orelse, depth + 3)
        elif isinstance(n, ast.Return):
            add(depth, "RET " + telling(text(n.value), 60) if n.value else "RET")
        elif isinstance(n, ast.Raise) and not deep:
            add(depth, "RAISE:" + short(text(n.exc), 50) if n.exc else "RAISE:")

    block(tree.body, 0)
    return out or None


# Braces

_WORD = re.compile(r"[A-Za-z_$#][\w$]*")
#: Where a bracket, and a statement, may end or go on in another way.
_BRACKETS, _ENDS = re.compile(r"[\"'`/()\[\]{}]"), re.compile(r"[\"'`/()\[\]{};\n]")
#: What declarations of TypeScript and JavaScript begin with.
_DECLARES = ("import", "async", "function", "abstract", "class", "interface", "const", "enum", "type", "let", "var")
_pattern = cache(re.compile)
_SKIP = re.compile(r"\s+|//[^\n]*|/\*[\s\S]*?\*/")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_CASE = re.compile(rf"(?:case\s+((?:{LITERAL}|[^:\"'])+)|default\s*):")
_OPEN, _CLOSE = "([{", ")]}"
_DECISION = re.compile(r"===|!==|==|!=|<=|>=|&&|\|\||\?\?|\binstanceof\b|\bin\b|(?<![=<])<(?!<)|(?<![=>-])>(?!>)")


class Braces:
    """A statement parser for languages with braces: finds ends of statements and bodies, and leaves expressions as text."""

    def __init__(self, code: str, lang: str):
        self.code, self.lang, self.out = code, lang, []

    def skip(self, i: int, end: int) -> int:
        while i < end and ((c := self.code[i]) == "/" or c.isspace()) and (m := _SKIP.match(self.code, i, end)):
            i = m.end()
        return i

    def balanced(self, i: int, end: int) -> int:
        """Behind the bracket that closes the one at i."""
        depth = 0
        while found := _BRACKETS.search(self.code, i, end):
            i = found.start()
            c = self.code[i]
            if m := (_STRING.match(self.code, i, end) if c in "\"'`" and not (c == "'" and self.lang == "rust") else _SKIP.match(self.code, i, end) if c == "/" else None):
                i = m.end()
                continue
            if c in _OPEN:
                depth += 1
            elif c in _CLOSE:
                depth -= 1
                if depth <= 0:
                    return i + 1
            i += 1
        return end

    def statement(self, i: int, end: int) -> int:
        """The end of a simple statement: a semicolon, or a line's end where the text can't go on."""
        while found := _ENDS.search(self.code, i, end):
            i = found.start()
            c = self.code[i]
            if m := (_STRING.match(self.code, i, end) if c in "\"'`" and not (c == "'" and self.lang == "rust") else _SKIP.match(self.code, i, end) if c == "/" else None):
                i = m.end()
                continue
            if c in _OPEN:
                i = self.balanced(i, end)
                continue
            if c == ";":
                return i + 1
            if c in _CLOSE:
                return i
            if c == "\n":
                n = self.skip(i, end)
                before = self.before(i)
                if n >= end or (before not in ",=+-*/&|?:<>(.!" and self.code[n] not in ".?:&|+*/,=)"):
                    return i
            i += 1
        return end

    def before(self, i: int) -> str:
        """The last sign before i that isn't white space."""
        while i and self.code[i - 1].isspace():
            i -= 1
        return self.code[i - 1 : i]

    def word(self, i: int) -> str:
        m = _WORD.match(self.code, i)
        return m.group() if m else ""

    def add(self, depth: int, line: str) -> None:
        self.out.append("  " * depth + line)

    def head(self, i: int, end: int) -> tuple[str, int]:
        """(condition, end) of a head in parentheses, or up to the brace where there are none."""
        i = self.skip(i, end)
        if i < end and self.code[i] == "(" and self.lang in ("typescript", "javascript"):
            j = self.balanced(i, end)
            return self.code[i + 1 : j - 1].strip(), j
        j = i
        while j < end and self.code[j] not in "{\n":
            j = self.balanced(j, end) if self.code[j] in "([" else j + 1
        return self.code[i:j].strip(), j

    def body(self, i: int, end: int, depth: int, scope: str, inside: bool = True) -> int:
        """Walks the block or the statement at i."""
        i = self.skip(i, end)
        if i < end and self.code[i] == "{":
            j = self.balanced(i, end)
            self.block(i + 1, j - 1, depth, scope, inside)
            return j
        return self.one(i, end, depth, scope, inside)

    def block(self, i: int, end: int, depth: int, scope: str, inside: bool) -> None:
        while (i := self.skip(i, end)) < end:
            j = self.one(i, end, depth, scope, inside)
            i = j if j > i else i + 1

    def guard(self, i: int, end: int) -> tuple[str, int] | None:
        """What a body of a single return or throw gives."""
        i = self.skip(i, end)
        if i >= end:
            return None
        if self.code[i] == "{":
            j = self.balanced(i, end)
            a, b = self.skip(i + 1, j - 1), j - 1
        else:
            a, b, j = i, end, None
        if self.word(a) not in ("return", "throw"):
            return None
        e = self.statement(a, b)
        if j is not None and self.skip(e, b) < b:
            return None
        return self.leave(a, e), j if j is not None else e

    def leave(self, i: int, j: int) -> str:
        w = self.word(i)
        text = self.code[i + len(w) : j].strip().rstrip(";").strip()
        if w == "throw":
            return "THROW:" + telling(text, 60)
        return "RET " + telling(text, 60) if text else "RET"

    def one(self, i: int, end: int, depth: int, scope: str, inside: bool) -> int:
        code, deep = self.code, depth > DEPTH
        w = self.word(i)
        if w == "export":
            n = self.skip(i + 6, end)
            if self.word(n) == "default":
                n = self.skip(n + 7, end)
            return self.declare(n, end, depth, "OUT ", i, inside) or self.statement(n, end)
        if (j := self.declare(i, end, depth, "", i, inside)) is not None:
            return j
        if w == "if":
            cond, j = self.head(i + 2, end)
            found = self.guard(j, end) if self.lang in ("typescript", "javascript") else None
            if found and self.word(self.skip(found[1], end)) != "else":
                if not deep:
                    self.add(depth, f"IF:{telling(cond, 60)} → {found[0]}")
                return found[1]
            if not deep:
                self.add(depth, "IF:" + telling(cond, 60))
            j = self.body(j, end, depth + 2, scope)
            while self.word(n := self.skip(j, end)) == "else":
                n = self.skip(n + 4, end)
                j = self.body(n, end, depth + (2 if self.word(n) == "if" else 3), scope)
            return j
        if w in ("for", "while", "loop", "do"):
            if w == "do":
                j = self.skip(i + 2, end)
                b = self.balanced(j, end)
                cond, e = self.head(self.skip(b, end) + 5, end)
                if not deep:
                    self.add(depth, "WHILE:" + telling(cond, 60))
                    self.body(j, b, depth + 2, scope)
                return e
            cond, j = self.head(i + len(w), end)
            if deep:
                k = self.skip(j, end)
                return self.balanced(k, end) if k < end and code[k] == "{" else self.statement(k, end)
            self.add(depth, "WHILE:" + telling(cond, 60) if w == "while" else "LOOP")
            return self.body(j, end, depth + 2, scope)
        if w in ("switch", "match"):
            cond, j = self.head(i + len(w), end)
            j = self.skip(j, end)
            e = self.balanced(j, end)
            if not deep:
                self.add(depth, "SWITCH:" + telling(cond, 60) if w == "switch" else "MATCH")
                k = j + 1
                while (k := self.skip(k, e - 1)) < e - 1:
                    n = self.one(k, e - 1, depth + (2 if self.word(k) in ("case", "default") else 3), scope, inside)
                    k = n if n > k else k + 1
            return e
        if w in ("case", "default") and (m := _CASE.match(code, i, end)):
            self.add(depth, "CASE:" + m.group(1).strip() if w == "case" else "DEFAULT:")
            return m.end()
        if w in ("return", "throw"):
            j = self.statement(i, end)
            self.add(depth, self.leave(i, j))
            return j
        if w == "try":
            if not deep:
                self.add(depth, "TRY")
            j = self.body(i + 3, end, depth + 2, scope)
            n = self.skip(j, end)
            if self.word(n) == "catch":
                n = self.skip(n + 5, end)
                name = "..."
                if n < end and code[n] == "(":
                    b = self.balanced(n, end)
                    name, n = code[n + 1 : b - 1].strip(), b
                if depth + 1 <= DEPTH:
                    self.add(depth + 1, "CATCH:" + name)
                j = self.body(n, end, depth + 3, scope)
                n = self.skip(j, end)
            if self.word(n) == "finally" and (n := self.skip(n + 7, end)) < end:
                return self.balanced(n, end)
            return j
        if w == "defer":
            if not deep:
                self.add(depth, "DEFER")
            return self.statement(i, end)
        if i < end and code[i] == "{":
            j = self.balanced(i, end)
            self.block(i + 1, j - 1, depth + 1, scope, inside)
            return j
        j = self.statement(i, end)
        if not inside and not deep:
            text = code[i:j]
            if m := re.match(r"([\w$]+(?:\.[\w$]+)+)\s*=\s*(async\s+)?(?:function\s*[\w$]*\s*)?(\([^)]*\))\s*(?:=>|\{)", text):
                self.add(depth, f"{'ASYNC ' if m[2] else ''}FN:{m[1]}{short(m[3], 60)}")
            elif m := re.match(r"Object\.?[sS]etPrototypeOf\(\s*([^,]+),\s*([^)]+)\)", text):
                self.add(depth, f"EXTENDS:{short(m[1], 30)} < {short(m[2], 30)}")
        return j

    def declare(self, i: int, end: int, depth: int, out: str, whole: int, inside: bool) -> int | None:
        """A declaration at i: its end, or None if there is none."""
        code, js = self.code, self.lang in ("typescript", "javascript")
        if js and not code.startswith(_DECLARES, i, end):
            return None
        at = lambda p: _pattern(p).match(code, i, end)
        doc = self.comment(whole) if out else ""
        if js:
            if m := at(r"import\b(?!\s*\()"):
                j = self.statement(i, end)
                found = re.search(r"[\"']([^\"']+)[\"']", code[i:j])
                self.out.append("USE:" + (found[1] if found else short(code[i:j].rstrip(";"), 80)))
                return j
            if m := at(r"(async\s+)?function\s*\*?\s*([\w$]+)?\s*(?:<[^>(]*>)?\s*(?=\()"):
                p = self.balanced(m.end(), end)
                self.out.append(f"{doc}{out}{'ASYNC ' if m[1] else ''}FN:{m[2] or 'anonymous'}{short(code[m.end() : p], 60)}")
                return self.function_body(p, end, depth)
            if m := at(r"(?:abstract\s+)?class\s+([\w$]+)\s*(<[^{]*?>)?[^{]*\{"):
                j = self.balanced(m.end() - 1, end)
                self.out.append(f"{doc}{out}CLASS:{m[1]}{m[2] or ''}")
                self.members(m.end(), j - 1, depth + 2, m[1])
                return j
            if m := at(r"interface\s+([\w$]+)\s*(<[^{]*?>)?[^{]*\{"):
                self.out.append(f"{doc}{out}INTERFACE:{m[1]}{m[2] or ''}")
                return self.balanced(m.end() - 1, end)
            if m := at(r"(?:const\s+)?enum\s+([\w$]+)\s*\{"):
                self.out.append(f"{doc}{out}ENUM:{m[1]}")
                return self.balanced(m.end() - 1, end)
            if m := at(r"type\s+([\w$]+)\s*(?:<[^=]*>)?\s*="):
                self.out.append(f"{doc}{out}TYPE:{m[1]}")
                return self.statement(m.end(), end)
            if m := at(r"(?:const|let|var)\s+([\w$]+|\{[^}]*\}|\[[^\]]*\])\s*(?::\s*[^=;\n]+)?=(?!=|>)\s*"):
                j = self.statement(m.end(), end)
                if depth <= DEPTH and (line := self.variable(m[1], code[m.end() : j].strip().rstrip(";").strip(), inside)):
                    self.add(depth, line)
                return j
        elif self.lang == "go":
            if m := at(r"func\s+([A-Za-z_]\w*)\s*(?=\()"):
                p = self.balanced(m.end(), end)
                self.out.append(f"FN:{m[1]}{short(code[m.end() : p], 60)}")
                return self.function_body(p, end, depth)
            if m := at(r"func\s*\([^)]*\)\s*\w+\s*\([^)]*\)"):
                j = self.function_end(m.end(), end)
                self.out.append(short(code[i:j], 80))
                return self.function_body(m.end(), end, depth)
            if at(r"(?:import|type)\b"):
                j = self.statement(i, end)
                self.out.append(short(code[i:j], 80))
                return j
        elif self.lang == "rust":
            if m := at(r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)\s*(?:<[^(]*>)?\s*(?=\()"):
                p = self.balanced(m.end(), end)
                self.out.append(f"FN:{m[1]}{short(code[m.end() : p], 60)}")
                return self.function_body(p, end, depth)
            if m := at(r"(?:pub(?:\([^)]*\))?\s+)?(struct|enum|trait|impl|use)\b"):
                j = self.function_end(m.end(), end)
                self.out.append(short(code[i:j].split("\n")[0], 80))
                b = code.find("{", m.end(), j)
                if m[1] in ("impl", "trait") and b >= 0:  # their functions are emitted
                    self.block(b + 1, j - 1, depth + 2, "", True)
                return j
        return None

    def function_end(self, i: int, end: int) -> int:
        while i < end and self.code[i] not in "{;":
            i += 1
        return self.balanced(i, end) if i < end and self.code[i] == "{" else min(i + 1, end)

    def function_body(self, i: int, end: int, depth: int) -> int:
        j = self.function_end(i, end)
        b = self.code.find("{", i, j)
        if b >= 0:
            self.block(b + 1, j - 1, depth + 2, "", True)
        return j

    def members(self, i: int, end: int, depth: int, name: str) -> None:
        method = re.compile(r"((?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)\s+)*)\*?([\w$#]+)\s*(?:<[^>(]*>)?\s*(?=\()")
        while (i := self.skip(i, end)) < end:
            m = method.match(self.code, i, end)
            if not m:
                j = self.statement(i, end)
                i = j if j > i else i + 1
                continue
            p = self.balanced(m.end(), end)
            if m[2][0] not in "#_":
                self.out.append(f"{'ASYNC ' if 'async' in m[1].split() else ''}METHOD:{name}.{m[2]}{short(self.code[m.end() : p], 40)}")
            i = max(self.function_body(p, end, depth), i + 1)

    def comment(self, i: int) -> str:
        if self.before(i) != "/":  # no comment ends there
            return ""
        m = re.search(r"/\*\*([\s\S]*?)\*/\s*\Z", self.code[:i])
        if not m or "*/" in m[1]:
            return ""
        text = re.sub(r"(?m)^\s*\*\s?", "", m[1]).strip()
        return "@deprecated " if re.search(r"@deprecated\b", text) else _doc(re.split(r"@\w+", text)[0])

    def variable(self, name: str, value: str, inside: bool) -> str | None:
        if m := re.match(r"(async\s+)?(\([^)]*\)|[\w$]+)\s*(?::\s*[^=]+)?=>", value):
            return f"{'ASYNC ' if m[1] else ''}FN:{name}{short(m[2] if m[2][0] == '(' else '(' + m[2] + ')', 60)} => ..."
        if m := re.match(r"await\s+([\s\S]+)", value):
            return f"AWAIT:{name}={short(m[1], 40)}"
        bare = _STRING.sub('""', value)
        if inside:
            flat = re.sub(r"\([^()]*\)", "()", bare)
            return f"LET:{name} = {telling(value, 80)}" if re.search(r"\?(?![.?])[\s\S]*:", flat) or _DECISION.search(flat) else None
        if re.fullmatch(r"-?[\d._]+|true|false", value):
            return f"VAR:{name} = {value}"
        if value.startswith("["):
            return f"VAR:{name}[{len(self.items(value))}]"
        if value.startswith("{"):
            keys = [re.split(r"[:(]", k, maxsplit=1)[0].strip() for k in self.items(value)]
            return f"VAR:{name}{{{short(', '.join(keys[:6]), 50)}{', ...' if len(keys) > 6 else ''}}}"
        if m := re.match(r"new\s+([\w$.]+)", value):
            return f"VAR:{name} = new {m[1]}(...)"
        if m := re.fullmatch(r"([\w$.]+)\([\s\S]*\)", value):
            return f"VAR:{name} = {short(m[1], 40)}(...)"
        return f"VAR:{name} = {short(bare, 50)}"

    @staticmethod
    def items(value: str) -> list[str]:
        """The parts of a bracketed list, commas inside of brackets and strings aside."""
        inner, depth, out, part = value[1:-1], 0, [], ""
        for c in re.findall(_STRING.pattern + r"|[\s\S]", inner):
            depth += (c in _OPEN) - (c in _CLOSE)
            if c == "," and depth == 0:
                out.append(part)
                part = ""
            else:
                part += c
        return [p.strip() for p in [*out, part] if p.strip()]


def merge(lines: list[str]) -> list[str]:
    """Four imports in a row become one line, then three guards in a row."""
    out: list[str] = []
    uses: list[str] = []
    for line in [*lines, None]:
        if line is not None and line.startswith("USE:"):
            found = re.search(r"from\s+[\"']([^\"']+)[\"']", line)
            uses.append(found[1] if found else line[4:])
            continue
        out += [f"USE:[{', '.join(uses)}]"] if len(uses) > 3 else ["USE:" + u for u in uses]
        uses = []
        if line is not None:
            out.append(line)
    lines, out, guards = out, [], []
    for line in [*lines, None]:
        m = re.match(GUARD, line) if line is not None and "IF:" in line else None
        if m:
            guards.append((m[1], m[2].strip(), m[3].strip()))
            continue
        if len(guards) >= 3:
            out.append(f"{guards[0][0]}GUARD:[{', '.join(f'{c} → ' + re.sub(r'^RET +', '', v) for _, c, v in guards)}]")
        else:
            out += [f"{i}IF:{c} → {v}" for i, c, v in guards]
        guards = []
        if line is not None:
            out.append(line)
    return out


def syntax_ir(code: str, lang: str | None) -> str | None:
    """The lines of a file, or null if its language isn't parsed or nothing is found."""
    if not lang or code is None:
        return None
    if lang == "python":
        lines = walk_python(code)
    else:
        b = Braces(code, lang)
        try:
            b.block(0, len(code), 0, "", False)
        except RecursionError:
            return None
        lines = b.out
    return "\n".join(merge(lines)) if lines else None


def _walk(code, lang) -> Column:
    def run(code: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([syntax_ir(c, x) for c, x in zip(code, lang)], dtype=object)

    return F.pandas_udf(run, "string")(code, lang)


def with_syntax(files: DataFrame) -> DataFrame:
    """Adds ``ir`` (null if there is none) and ``engine`` (AST or FP) to rows with ``path`` and ``code``."""
    return files.withColumn("ir", _walk("code", language("path"))).withColumn("engine", F.when(F.col("ir").isNotNull(), "AST").otherwise("FP"))


def l1_syntax(path, ir, code) -> Column:
    """The IR of a file by its syntax, else by its lines, where that is shorter, else the file."""
    text = F.when(is_generic(path), generic_structure(code)).otherwise(F.coalesce(col(ir), fingerprint_file(code, 0.75)))
    return shorter(text, code)


SYMBOL = re.compile(r"^(?:\S* )?(?:\"[^\"]*\" )?(?:OUT )?(?:ASYNC )?(FN|CLASS|METHOD|INTERFACE|TYPE|ENUM):([\w$.]+)")


def symbols(ir) -> Column:
    """The symbols that a file's IR declares, as (kind, name)."""

    def run(ir: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": m[1], "name": m[2]} for line in (x or "").split("\n") if (m := SYMBOL.match(line))] for x in ir])

    return F.pandas_udf(run, "array<struct<kind:string,name:string>>")(ir)


def declared(code: str, lang: str | None) -> set[tuple[str, str]]:
    """The symbols (kind, name) that a text declares."""
    return {(m[1], m[2]) for line in (syntax_ir(code, lang) or "").split("\n") if (m := SYMBOL.match(line))}


def changed_symbols(files: DataFrame) -> DataFrame:
    """symbol_diff() of rows (path, before, after), one for each path: texts that stay the same aren't walked, and nothing is joined."""

    def run(batches):
        for b in batches:
            out = []
            for path, x, y in zip(*(b[c].to_pylist() for c in ("path", "before", "after"))):
                lang = LANGUAGES.get(extension_of(path))
                x, y = declared(x, lang), declared(y, lang)
                out += [(path, *s, "deleted") for s in x - y] + [(path, *s, "added") for s in y - x]
            cols = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["path", "kind", "name", "change"])

    x = files.select("path", "before", "after").where("path is not null and not (before <=> after)")
    return x.mapInArrow(run, "path string, kind string, name string, change string").distinct()


def symbol_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind, name, change) of symbols added and deleted between two states of files (path, code)."""
    flat = lambda df: with_syntax(df).select("path", F.explode(symbols("ir")).alias("s")).select("path", "s.kind", "s.name").distinct()
    key = ["path", "kind", "name"]
    x = flat(before).withColumn("_b", F.lit(True)).join(flat(after).withColumn("_a", F.lit(True)), key, "full_outer")
    return x.where("_a is null or _b is null").select(*key, F.when(F.col("_b").isNull(), "added").otherwise("deleted").alias("change"))

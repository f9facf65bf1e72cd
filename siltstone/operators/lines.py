"""Line classification, fingerprints and structure maps.

Everything about one file works on the array of its lines with higher-order
functions: a file is a row, so that nothing is exploded and shuffled back.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import TOKEN, col, slice_lines, token_count
from siltstone.plans.dialect import Plain, SparkText, bare, compiled, rx, squeeze, trim
from siltstone.plans.once import once

_EXTENSIONS = {"go": "go", "javascript": "js jsx mjs", "python": "py", "rust": "rs", "typescript": "ts tsx"}
LANGUAGES = {"." + e: name for name, es in _EXTENSIONS.items() for e in es.split()}
DEEP = tuple(LANGUAGES)
GENERIC = tuple("." + e for e in "c cc cpp cs cxx h hh hpp hxx java kt kts m mm php scala swift".split())
UNSUPPORTED = tuple("." + e for e in "dart ex lua pl r rb sh".split())

#: (kind, words a first token starts with); the first hit counts.
KINDS = (
    ("function-start", ("function", "def", "fn", "func")),
    ("type-start", ("class", "struct", "interface")),
    ("branch", ("if", "else", "elif", "switch", "match", "case")),
    ("loop", ("for", "while", "loop", "do")),
    ("exit", ("return", "yield")),
    ("import", ("import", "require", "use", "from")),
    ("export", ("export", "pub", "public")),
    ("assignment", ("const", "let", "var", "val", "mut")),
    ("error-handling", ("try", "catch", "except", "finally")),
    ("async", ("async", "await")),
)


def classify(d, token):
    """The kind of a line by its first token."""
    cases = [(d.eq(token, ""), "blank")] + [(d.has(token, r"^(?:" + "|".join(ws) + r")\b"), k) for k, ws in KINDS]
    return d.choose([*cases, (d.has(token, r"^(?:/[/*]|#)"), "comment")], "unknown")


def first_token(d, line):
    return d.extract(trim(d, line), r"^([^\s({<]*)", 1)


def indent(line) -> Column:
    """Place of the first character that isn't white space, from 0; -1 in a blank line."""
    return (F.regexp_instr(col(line), F.lit(r"(\S)")) - 1).cast("int")


def structure(lines: DataFrame) -> DataFrame:
    """Adds ``indent`` and ``type`` to rows with ``raw``."""
    return lines.withColumn("indent", indent("raw")).withColumn("type", classify(SparkText, first_token(SparkText, F.col("raw"))))


def _params(d, g):
    return d.cat("(", squeeze(d, g), ")")


def _clean(d, g):
    return trim(d, bare(d, g))


def _arrow(out: str):
    def build(d, g, line):
        body = trim(d, d.sub(g(4), r"[{;]\s*$"))
        return d.cat(out, d.choose([(d.eq(g(2), ""), "")], d.lit("ASYNC ")), "FN:", g(1), " = (", trim(d, g(3)), ") => ", d.choose([(d.eq(body, ""), "{")], body))

    return build


def _base(out: str):
    return lambda d, g, line: d.cat(out, "CLASS:", g(1), d.choose([(d.eq(g(2), ""), "")], d.cat(" < ", g(2))))


def _maybe_out(d, line):
    return d.choose([(d.starts(line, "export"), "OUT ")], d.lit(""))


def _use(names):
    return lambda d, g, line: d.cat("USE:", g(2), "{", names(d, g(1)), "}")


_fn_tail = r"(?::°\S+°)?"
_whole = lambda d, x: x
_given = r"¢·¤(?:°:°[^=]+)?°=°"

#: (pattern, confidence, what a line becomes); the first that matches counts.
RULES = [
    (rx(r"^import·type·\{([^}]+)\}·from·§¶"), 0.95, _use(squeeze)),
    (rx(r"^import·\{([^}]+)\}·from·§¶"), 0.95, _use(squeeze)),
    (rx(r"^import·type·¤·from·§¶"), 0.95, _use(_whole)),
    (rx(r"^import·¤·from·§¶"), 0.95, _use(_whole)),
    (rx(r"^¢·¤°=°require\(§\)¶"), 0.95, _use(_whole)),
    (rx(r"^export·(?:default·)?(?:async·)?function·¤°\(([^)]*)\)°" + _fn_tail + "£"), 0.95, lambda d, g, x: d.cat("OUT FN:", g(1), _params(d, g(2)))),
    (rx(r"^(?:async·)?function·¤°\(([^)]*)\)°" + _fn_tail + "£"), 0.95, lambda d, g, x: d.cat("FN:", g(1), _params(d, g(2)))),
    (rx(r"^export·class·¤(?:·extends·¤)?°(?:implements·\S+°)?£"), 0.95, _base("OUT ")),
    (rx(r"^class·¤(?:·extends·¤)?°(?:implements·\S+°)?£"), 0.95, _base("")),
    (rx(r"^if°\(([^)]+)\)°return·(.+)¶"), 0.95, lambda d, g, x: d.cat("IF:", trim(d, g(1)), " -> RET ", bare(d, trim(d, g(2))))),
    (rx(r"^if°\(([^)]+)\)°£"), 0.9, lambda d, g, x: d.cat("IF:", trim(d, g(1)))),
    (rx(r"^for°\(¢·¤·(?:of|in)·¤\)°£"), 0.9, lambda d, g, x: d.cat("LOOP:", g(2), " -> ", g(1))),
    (rx(r"^return·(.+)¶"), 0.95, lambda d, g, x: d.cat("RET ", bare(d, trim(d, g(1))))),
    (rx(r"^return¶"), 0.95, lambda d, g, x: d.lit("RET")),
    (rx(r"^try°\{°$"), 0.9, lambda d, g, x: d.lit("TRY:")),
    (rx(r"^(?:\}°)?catch°\(¤\)°£"), 0.9, lambda d, g, x: d.cat("CATCH:", g(1))),
    (rx(r"^switch°\(([^)]+)\)°£"), 0.9, lambda d, g, x: d.cat("SWITCH:", trim(d, g(1)))),
    (rx(r"^case·(.+)°:°$"), 0.9, lambda d, g, x: d.cat("CASE:", trim(d, g(1)))),
    (rx(r"^default°:°$"), 0.9, lambda d, g, x: d.lit("DEFAULT:")),
    (rx(r"^export·type·¤(?:<[^>]+>)?°=°(.+)¶"), 0.9, lambda d, g, x: d.cat("OUT TYPE:", g(1))),
    (rx(r"^if°\(([^)]+)\)·(\w+.+)¶"), 0.9, lambda d, g, x: d.cat("IF:", trim(d, g(1)), " -> ", d.left(_clean(d, g(2)), 50))),
    (rx(r"^export·(?:default·)?(?:async·)?function·¤°\(°$"), 0.95, lambda d, g, x: d.cat("OUT FN:", g(1), "(")),
    (rx(r"^°¤\??°:°(.+)¶"), 0.75, lambda d, g, x: d.cat("PROP:", g(1), ": ", _clean(d, g(2)))),
    (rx(r"^(?:export·)?" + _given + "await·(.+)¶"), 0.85, lambda d, g, x: d.cat(_maybe_out(d, x), "AWAIT:VAR:", g(1), " = ", _clean(d, g(2)))),
    (rx(r"^export·¢·¤°=°(async·)?\(([^)]*)\)°=>°(.*)$"), 0.9, _arrow("OUT ")),
    (rx(r"^¢·¤°=°(async·)?\(([^)]*)\)°=>°(.*)$"), 0.9, _arrow("")),
    (rx(r"^°get·¤°\(\)°" + _fn_tail + "£"), 0.9, lambda d, g, x: d.cat("GET:", g(1), "()")),
    (rx(r"^°set·¤°\(([^)]*)\)°£"), 0.9, lambda d, g, x: d.cat("SET:", g(1), _params(d, g(2)))),
    (rx(r"^°(?:async·)?¤°\(([^)]*)\)°" + _fn_tail + r"\{°$"), 0.9, lambda d, g, x: d.choose([(d.member(g(1), "catch for function if switch while".split()), g(1))], d.cat("METHOD:", g(1), _params(d, g(2))))),
    (rx(r"^¢·\{([^}]+)\}°=°(.+)¶"), 0.9, lambda d, g, x: d.cat("VAR:{", squeeze(d, g(1)), "} = ", _clean(d, g(2)))),
    (rx(r"^¢·\[([^\]]+)\]°=°(.+)¶"), 0.9, lambda d, g, x: d.cat("VAR:[", squeeze(d, g(1)), "] = ", _clean(d, g(2)))),
    (rx(r"^(?:export·)?" + _given + "(.+)¶"), 0.85, lambda d, g, x: d.cat(_maybe_out(d, x), "VAR:", g(1), " = ", _clean(d, g(2)))),
]
SKIP, RAW = 0, 99


def rule_of(d, line):
    """The number of the rule for a trimmed line; SKIP for noise, RAW if none fits."""
    noise = d.either(d.member(line, ("", "{", "}", "});", ");")), d.has(line, r"^(?:/[/*]|\*)"))
    return d.choose([(noise, SKIP)] + [(d.has(line, p), i) for i, (p, _, _) in enumerate(RULES, 1)], RAW)


def text_of(d, rule, line):
    """What a trimmed line becomes under its rule."""
    cases = [(d.eq(rule, SKIP), "")]
    for i, (p, _, build) in enumerate(RULES, 1):
        cases.append((d.eq(rule, i), build(d, lambda n, p=p: d.extract(line, p, n), line)))
    return d.choose(cases, line)


def confidence_of(rule) -> Column:
    """The confidence of a rule."""
    out = F.when(rule == SKIP, 1.0)
    for c in (0.95, 0.9, 0.85, 0.75):
        out = out.when(rule.isin([i for i, r in enumerate(RULES, 1) if r[1] == c]), c)
    return out.otherwise(0.1)


@lru_cache(1 << 16)
def ruled(line: str) -> tuple[int, str]:
    """(rule, what the line becomes) of a trimmed line; lines repeat, so that most are looked up."""
    if line in ("", "{", "}", "});", ");") or line.startswith(("//", "/*", "*")):
        return SKIP, ""
    for i, (p, _, build) in enumerate(RULES, 1):
        if compiled(p).search(line):
            return i, build(Plain, lambda n, p=p: Plain.extract(line, p, n), line)
    return RAW, line


_CONFIDENCE = {SKIP: 1.0, RAW: 0.1} | {i: r[1] for i, r in enumerate(RULES, 1)}
_EDGE = " \t\n\x0b\f\r"


@lru_cache(1 << 16)
def _shown(raw: str) -> tuple[str, float]:
    """(what a line becomes, indented by pairs of blanks and empty for noise; confidence)."""
    r, ir = ruled(raw.strip(_EDGE))
    return ("  " * ((len(raw) - len(raw.lstrip(_EDGE))) // 2) + ir if ir and r != SKIP else ""), _CONFIDENCE[r]


def fingerprint_text(code: str, least: float = 0.6) -> str:
    """The lines of a text whose confidence is ``least`` or more, indented by pairs of blanks."""
    return "\n".join([ir for ir, sure in map(_shown, code.split("\n")) if ir and sure >= least])


_tokens = compiled(TOKEN).findall


@lru_cache(1 << 16)
def _line_tokens(line: str) -> int:
    return len(_tokens(line))


def count_tokens(text: str | None) -> int:
    """token_count() of a Python string; no token goes over a line's end, and lines repeat."""
    return sum(map(_line_tokens, text.split("\n"))) if text else 0


def fingerprint_plain(lines) -> str:
    """The texts of some lines, whatever their confidence, without indents and noise."""
    found = (ruled(x.strip(_EDGE))[1] for x in lines if x is not None)
    return "\n".join(x for x in found if x)


def fingerprint_lines(lines: DataFrame) -> DataFrame:
    """Adds ``kind``, ``ir``, ``hint`` and ``confidence`` to rows with ``raw``.

    The 32 rules are regular expressions of which the first that fits counts;
    as one CASE they make a method that the JVM doesn't compile.  An Arrow UDF
    finds rule and text together, and a line that repeats only once.
    """

    def run(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ruled(x.strip(_EDGE)) if x is not None else (None, None) for x in raw], columns=["r", "ir"])

    x = lines.withColumn("_f", F.pandas_udf(run, "r int, ir string")(F.col("raw")))
    x = once(x.withColumn("_r", F.col("_f.r")).withColumn("ir", F.col("_f.ir")).drop("_f"))
    x = x.withColumn("confidence", confidence_of(F.col("_r")))
    x = x.withColumn("kind", F.when(F.col("_r") == RAW, "raw").when(F.col("confidence") > 0.9, "fingerprint").otherwise("fingerprint+hint"))
    return once(x.withColumn("hint", F.when(F.col("kind") == "fingerprint+hint", trim(SparkText, F.col("raw")))).drop("_r"))


def fingerprint_file(code, least: float = 0.6) -> Column:
    """A file's lines of confidence ``least`` or more, indented by pairs of blanks; in an Arrow UDF, so not inside of a lambda."""

    def run(code: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else fingerprint_text(c, least) for c in code], dtype=object)

    return F.pandas_udf(run, "string")(col(code))


#: Engines that compress a file: its syntax first and then its lines, or its lines only.
SYNTAX, BY_LINES = "syntax", "lines"


def text_ir(code: str, lang: str | None, engine: str = SYNTAX) -> tuple[str, str]:
    """(IR, engine that made it: AST or FP) of a text in a deep language; lines stand in where the syntax gives nothing."""
    if engine == SYNTAX:
        from siltstone.operators.syntax import syntax_ir

        found = syntax_ir(code, lang)
        if found is not None:
            return found, "AST"
    return fingerprint_text(code, 0.75), "FP"


def deep_ir(code, lang, engine: str = SYNTAX) -> Column:
    """(ir, made_by) of a file in a deep language, null fields for null code; an Arrow UDF."""

    def run(code: pd.Series, lang: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_ir(c, x, engine) if c is not None else (None, None) for c, x in zip(code, lang)], columns=["ir", "made_by"])

    return F.pandas_udf(run, "ir string, made_by string")(col(code), col(lang))


#: Statements that call, rather than declare.
CONTROL = tuple("case catch co_await default delete do else for if new return sizeof switch throw while".split())
_MODIFIERS = "(?:" + "|".join(("public", "private", "protected", "final", "abstract", "static", "sealed", "export", "pub")) + ")"
TYPE = rx(r"^(?:template°<[^>]*>°)?(?:" + _MODIFIERS + r"·)*(class|enum|interface|record|struct|trait|union)(?:·(?:class|struct))?·¤([^{;]*)")
_TRAILERS = "|".join([*(w + r"\b" for w in ("const", "noexcept", "override", "final", "mutable")), r"throws\b[^{;]*", "->[^{;]*", ":[^{;]*"])
FUNCTION = rx(r"(?:[\s~:>&*]|^)([_a-zA-Z]\w*)°\([^;{]*\)°(?:°(?:" + _TRAILERS + r"))*°([{;])°$")
BASE = rx(r"(?:extends|implements|:)°([\s\w.,:<>]+)")


#: What a file includes, imports and uses, and its name space.
NAMED = (rx('^#°include°["<]([^">]+)[">]'), rx(r"^import·(?:static·)?([\w.]+)"), rx(r"^using·([\w.:]+)°;"), rx(r"^(?:namespace|package|module)·([\w.:]+)"))


def generic_line(d, line):
    """What a trimmed line declares in a language with braces; empty if nothing."""
    kind, rest = d.extract(line, TYPE, 1), d.extract(line, TYPE, 3)
    base = d.sub(trim(d, d.extract(rest, BASE, 1)), r"\s+", " ")
    declared = d.cat(
        d.choose([(d.eq(kind, "interface"), "IFACE:"), (d.eq(kind, "enum"), "ENUM:")], d.lit("CLASS:")),
        d.extract(line, TYPE, 2),
        d.choose([(d.has(rest, BASE), d.cat(" < ", base))], d.lit("")),
    )
    name, end = d.extract(line, FUNCTION, 1), d.extract(line, FUNCTION, 2)
    at = d.find(line, d.cat(name, "("))
    before = d.choose([(at > 0, trim(d, d.sub_at(line, 1, at - 1)))], trim(d, d.sub_at(line, 1, d.length(line) - 1)))
    sign = d.choose([(at > 1, d.sub_at(line, at - 1, 1))], d.lit(""))
    call = d.both(d.eq(end, ";"), d.either(d.either(d.eq(before, ""), d.member(sign, (".", ":", ">"))), d.has(line, "=")))
    first = d.extract(line, r"^([^\s(]*)", 1)
    include, imported, using, space = NAMED
    return d.choose(
        [
            (d.either(d.eq(line, ""), d.has(line, r"^(?:/[/*]|\*)")), ""),
            (d.has(line, include), d.cat("USE:", d.extract(line, include, 1))),
            (d.has(line, imported), d.cat("USE:", d.extract(line, imported, 1))),
            (d.has(line, using), d.cat("USE:", d.extract(line, using, 1))),
            (d.has(line, space), d.cat("NS:", d.extract(line, space, 1))),
            (d.has(line, TYPE), declared),
            (d.member(first, CONTROL), ""),
            (d.both(d.has(line, FUNCTION), d.either(d.member(name, CONTROL), call)), ""),
            (d.has(line, FUNCTION), d.cat("FN:", name)),
        ],
        d.lit(""),
    )


@lru_cache(1 << 16)
def _declared(line: str) -> str:
    call = "(" in line and line[-1] in "{;"  # FUNCTION has both
    if not call and not any(compiled(p).search(line) for p in (*NAMED, TYPE)):
        return ""
    return generic_line(Plain, line)


def generic_text(code: str) -> str:
    """The declarations of a text in order, each once."""
    return "\n".join(dict.fromkeys(d for raw in code.split("\n") if (d := _declared(raw.strip(_EDGE)))))


def generic_structure(code) -> Column:
    """The declarations of a file in order, each once; in an Arrow UDF, so not inside of a lambda."""

    def run(code: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else generic_text(c) for c in code], dtype=object)

    return F.pandas_udf(run, "string")(col(code))


def extension(path) -> Column:
    return F.regexp_extract(col(path), r"(\.[^./]+)$", 1)


def is_generic(path) -> Column:
    return F.lower(extension(path)).isin(*GENERIC)


def language(path) -> Column:
    """The language of a path by its extension, null if it is none that is parsed deeply."""
    m = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.element_at(m, extension(path))


NAME = rx(r"(?:class|interface|function|var|let|const|export·(?:default·)?(?:class|async·function|function))·¤")


@lru_cache(1 << 16)
def _kind(token: str) -> str:
    return classify(Plain, token)


@lru_cache(1 << 16)
def _mapped(raw: str) -> str:
    """The entry of a line in the structure map, without its number; empty if it has none."""
    if raw and raw[0] not in _EDGE and (kind := _kind(first_token(Plain, raw))) in ("function-start", "type-start", "export"):
        return f"  {'CLASS' if kind == 'type-start' else 'FN'}:{Plain.extract(raw, NAME, 1) or 'unknown'}"
    return ""


def map_text(code: str) -> str:
    """Top-level declarations of a text in a deep language, with their line numbers."""
    return "\n".join([f"{d} L{n}" for n, d in enumerate(map(_mapped, code.split("\n")), 1) if d])


def extension_of(path: str) -> str:
    """extension() of a Python string."""
    m = compiled(r"(\.[^./]+)$").search(path)
    return m[1] if m else ""


def ir_of(path: str, code: str, engine: str = SYNTAX) -> tuple[str, str]:
    """(IR, engine that made it) of one file."""
    ext = extension_of(path)
    return (generic_text(code), "GENERIC") if ext.lower() in GENERIC else text_ir(code, LANGUAGES.get(ext), engine)


def l0_of(path: str, code: str) -> str:
    """The structure map of one file."""
    return f"{path}\n{generic_text(code) if extension_of(path).lower() in GENERIC else map_text(code)}"


#: What is made of a file, and its types.
MADE = {"l0": "string", "l1": "string", "made_by": "string", "raw_tokens": "bigint", "l0_tokens": "bigint", "l1_tokens": "bigint"}


def made_of(path: str | None, code: str | None, wanted: tuple[str, ...], engine: str = SYNTAX) -> tuple:
    """The wanted fields of MADE of one file: maps, IR and tokens are made only where a field needs them."""
    known = path is not None and code is not None
    out = {"raw_tokens": count_tokens(code) if any(w in ("l1", "raw_tokens", "l1_tokens") for w in wanted) else None}
    if any(w.startswith("l0") for w in wanted):
        out["l0"] = l0_of(path, code) if known else None
        out["l0_tokens"] = count_tokens(out["l0"]) if "l0_tokens" in wanted else None
    if any(w in ("l1", "l1_tokens", "made_by") for w in wanted):
        ir, out["made_by"] = ir_of(path, code, engine) if known else (None, None)
        n = count_tokens(ir)
        better = n < (out["raw_tokens"] or 0) and n > 0
        out["l1"], out["l1_tokens"] = (ir, n) if better else (code, out["raw_tokens"])
    return tuple(out[w] for w in wanted)


def made(path, code, engine: str, *wanted: str) -> Column:
    """A struct of the wanted fields of MADE: one Arrow UDF for all that is made of a file."""

    def run(path: pd.Series, code: pd.Series) -> pd.DataFrame:
        rows = [made_of(p, c, wanted, engine) for p, c in zip(path, code)]
        return pd.DataFrame({w: pd.Series([r[i] for r in rows], dtype=object if MADE[w] == "string" else "int64") for i, w in enumerate(wanted)})

    return F.pandas_udf(run, ", ".join(f"{w} {MADE[w]}" for w in wanted))(col(path), col(code))


def l0(path, code) -> Column:
    """The structure map of a file: its path, and a line for each declaration."""

    def run(path: pd.Series, code: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or c is None else l0_of(p, c) for p, c in zip(path, code)], dtype=object)

    return F.pandas_udf(run, "string")(col(path), col(code))


def l1(path, code, engine: str = SYNTAX) -> Column:
    """The IR of a file where that is shorter in tokens, else the file."""
    return made(path, code, engine, "l1")["l1"]


def shorter(ir, code) -> Column:
    """ir if it isn't blank and has fewer tokens than code, else code."""
    return F.when(F.coalesce(col(ir), F.lit("")).rlike(r"\S") & (token_count(ir) < token_count(code)), col(ir)).otherwise(col(code))


def with_layers(files: DataFrame, engine: str = SYNTAX) -> DataFrame:
    """Adds ``l0``, ``l1``, their tokens and ``made_by`` (AST, FP or GENERIC) to rows with ``path`` and ``code``; one UDF makes both."""
    x = files.withColumn("_f", made("path", "code", engine, *MADE))
    return x.select(*(files[c] for c in files.columns if c not in MADE), *(F.col("_f")[c].alias(c) for c in ("l0", "made_by", "l1", "raw_tokens", "l0_tokens", "l1_tokens")))


#: The layers of a file, from names to source.
LAYERS = ("L0", "L1", "L2", "L3")


def layer(path, code, which: str, delta=None, lines: tuple[int, int] | None = None, engine: str = SYNTAX) -> Column:
    """A file in one of the layers: L0 its structure map, L1 its IR, L2 the delta that is given (its IR where there is none), L3 the source, or a range of its lines counted from 1."""
    if which not in LAYERS:
        raise ValueError(f"a layer is one of {', '.join(LAYERS)}")
    if which == "L0":
        return l0(path, code)
    if which == "L3":
        return col(code) if lines is None else slice_lines(code, *lines)
    ir = l1(path, code, engine)
    return F.coalesce(F.nullif(col(delta), F.lit("")), ir) if which == "L2" and delta is not None else ir


def merge_runs(ir: DataFrame, pattern: str, least: int, head: str, item, keep) -> DataFrame:
    """Runs of ``least`` or more lines that match become one: rows of (path, ord, line).

    Islands of rows that match, by the difference of two row numbers inside a
    file; a merged line stands where its first one stood.
    """
    w = W.partitionBy("path").orderBy("ord")
    x = once(ir.withColumn("_hit", F.col("line").rlike(pattern))).withColumn("_n", F.row_number().over(w))
    x = x.withColumn("_island", F.col("_n") - F.row_number().over(W.partitionBy("path", "_hit").orderBy("ord")))
    runs = x.groupBy("path", "_hit", "_island").agg(F.sort_array(F.collect_list(F.struct("ord", "line"))).alias("rows"))
    first = F.element_at(F.col("rows"), 1)
    merged = F.concat(head(first["line"]), F.array_join(F.transform("rows", lambda r: item(r["line"])), ", "), F.lit("]"))
    out = F.when(F.col("_hit") & (F.size("rows") >= least), F.array(F.struct(first["ord"].alias("ord"), merged.alias("line")))).when(F.col("_hit"), F.transform("rows", lambda r: F.struct(r["ord"].alias("ord"), keep(r["line"]).alias("line")))).otherwise(F.col("rows"))
    return runs.select("path", F.inline(out))


GUARD = r"^([ \t]*)IF:(.+?) → (.+)$"


def merge_imports(ir: DataFrame) -> DataFrame:
    """Four imports or more in a row become one line."""
    module = lambda s: F.coalesce(F.nullif(F.regexp_extract(s, rx("from·§"), 1), F.lit("")), F.substr(s, F.lit(5)))
    return merge_runs(ir, "^USE:", 4, lambda s: F.lit("USE:["), module, lambda s: F.concat(F.lit("USE:"), module(s)))


def merge_guards(ir: DataFrame) -> DataFrame:
    """Three guards or more in a row become one line, with the indent of the first."""
    cond = lambda s: trim(SparkText, F.regexp_extract(s, GUARD, 2))
    value = lambda s: trim(SparkText, F.regexp_extract(s, GUARD, 3))
    return merge_runs(
        ir,
        GUARD,
        3,
        lambda s: F.concat(F.regexp_extract(s, GUARD, 1), F.lit("GUARD:[")),
        lambda s: F.concat(cond(s), F.lit(" → "), F.regexp_replace(value(s), r"^RET\s+", "")),
        lambda s: F.concat(F.regexp_extract(s, GUARD, 1), F.lit("IF:"), cond(s), F.lit(" → "), value(s)),
    )


def _modules(line: str) -> str:
    return Plain.extract(line, rx("from·§"), 1) or line[4:]


def _guard(line: str) -> tuple[str, str, str]:
    m = compiled(GUARD).search(line)
    return m[1], m[2].strip(_EDGE), m[3].strip(_EDGE)


def _one_import(rows: list[str]) -> str:
    return f"USE:[{', '.join(map(_modules, rows))}]"


def _one_guard(rows: list[str]) -> str:
    found = list(map(_guard, rows))
    return f"{found[0][0]}GUARD:[{', '.join(c + ' → ' + Plain.sub(v, r'^RET\s+') for _, c, v in found)}]"


#: Of a kind of run: whether a line belongs to one, how many make one line, that line, and a line of a shorter run.
RUNS = {
    "imports": (lambda s: s.startswith("USE:"), 4, _one_import, lambda s: "USE:" + _modules(s)),
    "guards": (lambda s: compiled(GUARD).search(s) is not None, 3, _one_guard, lambda s: "{}IF:{} → {}".format(*_guard(s))),
}


@lru_cache(1 << 16)
def _arrowed(raw: str) -> str:
    return ruled(raw.strip(_EDGE))[1].replace(" -> ", " → ")


def merged_lines(code: str, kind: str) -> list[tuple[int, str]]:
    """(ord, line) of a text's IR, whatever its confidence, with the runs of a kind merged; as merge_runs() does for rows."""
    hits, least, merge, keep = RUNS[kind]
    out, run = [], []

    def close() -> None:
        if len(run) >= least:
            out.append((run[0][0], merge([x for _, x in run])))
        else:
            out.extend([(i, keep(x)) for i, x in run])
        run.clear()

    for n, line in enumerate(map(_arrowed, code.split("\n")), 1):
        if line and hits(line):
            run.append((n, line))
        elif line:
            close()
            out.append((n, line))
    close()
    return out


def merged(files: DataFrame, kind: str) -> DataFrame:
    """(path, ord, line) of files (path, code): merge_imports() or merge_guards() of each file's IR, without moving lines between tasks."""
    fields = f"path {dict(files.dtypes)['path']}, ord int, line string"

    def run(batches):
        for b in batches:
            rows = [(p, *r) for p, c in zip(b["path"].to_pylist(), b["code"].to_pylist()) if c is not None for r in merged_lines(c, kind)]
            paths, ords, texts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(paths, b["path"].type), pa.array(ords, pa.int32()), pa.array(texts, pa.string())], ["path", "ord", "line"])

    return files.select("path", "code").mapInArrow(run, fields)

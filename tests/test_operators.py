import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import deltas, handoff, history, messages, ordering, packing, reports, risk
from siltstone.streaming import live

TOUCH = "event_id long, hash string, author string, file string, message string, second long, day long"


def touches(spark, rows):
    return spark.createDataFrame([(i, h, a, f, m, d * 86400, d) for i, (h, a, f, m, d) in enumerate(rows)], TOUCH)


def test_hotspots(spark):
    t = touches(spark, [("1", "A", "auth", "fix: a", 1), ("2", "B", "auth", "fix: b", 2), ("3", "C", "auth", "feat: c", 3), ("4", "A", "auth", "fix: d", 4), ("5", "A", "db", "feat", 5)])
    assert [tuple(r) for r in history.hotspots(t, 3, 0.5).collect()] == [("auth", 4, 0.75, 3)]


def test_decay(spark):
    t = touches(spark, [(str(i), "A", "f", "m", d) for i, d in enumerate([0, 20, 28, 29, 30, 31])] + [("x", "A", "g", "m", 1)])
    assert [tuple(r) for r in history.decay(t).collect()] == [("f", 6, 1, 5)]
    assert [r.value for r in history.decay_points(t).orderBy("value").collect()] == [1, 2, 3, 4, 5, 6]


def test_styles(spark):
    t = touches(spark, [("1", "A", "f", "refactor: x", 1), ("2", "A", "f", "fix: y", 2), ("3", "B", "f", "docs", 3), ("4", "C", "f", "FEAT z", 4)])
    got = {r.author: r.style for r in history.inconsistencies(t, 2).collect()}
    assert got == {"A": "primarily refactor (2 commits)", "B": "primarily other (1 commits)", "C": "primarily feature (1 commits)"}
    assert history.inconsistencies(t, 4).count() == 0


def test_health_end_to_end(spark):
    t = touches(spark, [(str(i), "ABC"[i % 3], "f", "fix: a" if i % 2 == 0 else "feat: b", i * i) for i in range(15)])
    r = history.health(t).first()
    assert r.churn == 15 and "HOT:15/30" in r.tag and "FIX:53%" in r.tag and "INCON" in r.tag


def test_links_and_chains(spark):
    t = touches(spark, [("a", "A", "f", "feat", 1), ("b", "B", "f", "fix: x", 3), ("c", "B", "f", "fix: y", 4), ("d", "B", "f", "fix: z", 9), ("e", "A", "g", "This reverts commit a", 9)])
    assert {tuple(r) for r in risk.followup_links(t).collect()} == {("b", "a"), ("c", "a"), ("c", "b")}
    assert {tuple(r) for r in risk.revert_links(t).collect()} == {("e", "a")}
    assert [tuple(r) for r in risk.fix_chains(t).collect()] == [("f", "d", 3)]


@pytest.mark.parametrize("hours", [1, 30, 72])
def test_interval_join_equals_cross_join(spark, hours):
    import random

    r = random.Random(hours)
    rows = [(i, f"h{r.randint(0, 40)}", "A", f"f{r.randint(0, 3)}", r.choice(["fix: a", "feat"]), r.randint(0, 40) * 3600, 0) for i in range(150)]
    t = spark.createDataFrame(rows, TOUCH)
    ft = {(x.hash, x.file): (x.second, x.is_fix) for x in risk.file_touches(t).collect()}
    want = {(a, b) for (a, f), (s, fix) in ft.items() for (b, g), (u, _) in ft.items() if fix and f == g and a != b and s - hours * 3600 <= u < s}
    assert {tuple(x) for x in risk.followup_links(t, hours).collect()} == want


@pytest.mark.parametrize("hours", [1, 30, 72])
def test_broken_without_links(spark, hours, monkeypatch):
    import random

    r = random.Random(hours)
    rows = [(i, None if i % 20 == 0 else f"h{r.randint(0, 60)}", "A", None if i % 17 == 0 else f"f{r.randint(0, 5)}", r.choice(["fix: a", "feat", "feat"]), r.randint(-40, 80) * 3600 + r.randint(0, 1), 0) for i in range(120)]
    t = spark.createDataFrame(rows, TOUCH)
    want = {x.break_hash for x in risk.followup_links(t, hours).collect()}
    got = [x.break_hash for x in risk.broken(t, hours).collect()]
    assert set(got) == want and len(got) == len(want)
    ft = [x for x in risk.file_touches(t).collect()]
    hit = {(x.hash, x.file, x.second): any(y.is_fix and y.file == x.file and 0 < y.second - x.second <= hours * 3600 for y in ft if x.file is not None) for x in ft}
    assert {(x.hash, x.file, x.second): x.mended for x in risk.mended(risk.file_touches(t), hours * 3600).collect()} == hit
    # strengths, calibration and scores of dense histories make no pairs
    monkeypatch.setattr(risk, "followup_links", None)
    s = risk.signal_strengths(t)
    assert risk.scores(s, risk.calibration(t, s)).count() == len({x.file for x in ft})


@pytest.mark.parametrize("hours", [1, 30, 72])
def test_ranges_and_counts_hold_all_links(spark, hours, monkeypatch):
    import random

    r = random.Random(hours)
    rows = [(i, None if i % 20 == 0 else f"h{r.randint(0, 60)}", "A", None if i % 17 == 0 else f"f{r.randint(0, 5)}", r.choice(["fix: a", "feat", "feat"]), r.randint(-40, 80) * 3600 + r.randint(0, 1), 0) for i in range(160)]
    t = spark.createDataFrame(rows, TOUCH)
    got = [x.asDict() for x in risk.link_ranges(t, hours).collect()]
    at = {(x["file"], x["nth"]): x for x in got}
    assert len(at) == len(got) == risk.file_touches(t).where("hash is not null and file is not null").count()
    pairs = [(x, at[x["file"], n]) for x in got if x["is_fix"] for n in range(x["first"], x["first"] + x["links"])]
    assert {(f["hash"], b["hash"]) for f, b in pairs} == {tuple(x) for x in risk.followup_links(t, hours).collect()}
    later = [(f, b) for f, b in pairs if b["commit_second"] < f["commit_second"]]
    links = risk.followup_links(t, hours)
    c = risk.commits(t).select("hash", "second")
    want = {(x.b, x.bs, x.f, x.fs) for x in links.join(c.toDF("break_hash", "bs"), "break_hash").join(c.toDF("fix_hash", "fs"), "fix_hash").where("bs < fs").select(F.col("break_hash").alias("b"), "bs", F.col("fix_hash").alias("f"), "fs").collect()}
    assert {(b["hash"], b["commit_second"], f["hash"], f["commit_second"]) for f, b in later} == want and sum(x["events"] for x in got) == len(later)
    n = {}
    for b, bs, _, _ in want:
        n[b, bs] = n.get((b, bs), 0) + 1
    assert {(x.break_hash, x.break_second): x.n for x in risk.events_of_breaks(t, hours).collect()} == n
    monkeypatch.setattr(risk, "events", None)
    ordered = sorted(want, key=lambda x: (x[1], x[0], x[2]))
    for k in (7, 100_000):
        some = sorted({i * len(ordered) // k for i in range(k)})
        assert sorted(tuple(x) for x in risk.sample_events(t, k, hours).collect()) == sorted(ordered[i] for i in some)


def test_scores_and_verdicts(spark):
    s = spark.createDataFrame([("f", 1.0, 0.5, 0.0, 0.0), ("g", 0.0, 0.0, 0.0, 0.0)], "file string, revert_match double, hotspot double, fix_ratio double, author_churn double")
    cal = spark.createDataFrame([("revert_match", 40, 20, 0.5, 0.5), ("hotspot", 10, 1, None, 0.3)], "signal string, sample_size long, hits long, precision double, used double")
    got = {r.file: r for r in risk.scores(s, cal).collect()}
    assert got["f"].score == pytest.approx((0.5 + 0.15) / 0.8) and (got["f"].firing, got["f"].usable, got["f"].avg_sample) == (2, 1, 25.0)
    assert got["g"].score == 0.0
    assert {r.file: r.score for r in risk.scores(s, cal, ("revert_match",)).collect()}["f"] == 0.5
    c = risk.confidence(risk.scores(s, cal), spark.createDataFrame([(120,)], "n long"))
    assert {r.file: r.confidence for r in c.collect()} == {"f": pytest.approx(1 / 3), "g": 0.0}
    v = spark.createDataFrame([(0.1, 0.2), (0.1, 0.9), (0.4, 0.9), (0.7, 0.3)], "s double, c double").select(risk.verdict(F.col("s"), F.col("c")).alias("v"))
    assert [r.v for r in v.collect()] == ["unknown", "low", "medium", "high"]


def test_auc_and_percentiles(spark):
    import random

    r = random.Random(1)
    rows = [(r.randint(0, 8) / 8, r.random() < 0.4) for _ in range(200)]
    df = spark.createDataFrame(rows, "score double, positive boolean")
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert risk.auc(df, "score").first().auc == pytest.approx(want)
    assert risk.auc(df.where("positive"), "score").first().auc == 0.5
    q = risk.nth_of_sorted(df.withColumn("k", F.lit("a")), "k", "score", {"median": 0.5, "p90": 0.9}).first()
    s = sorted(x for x, _ in rows)
    assert (q.median, q.p90) == (s[100], s[180])


def test_sample(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert sorted(r.x for r in ordering.sample_uniform(df, 7, "x").collect()) == [i * 1000 // 7 for i in range(7)]
    assert ordering.sample_uniform(df, 2000, "x").count() == 1000


def _files(spark, *rows):
    return spark.createDataFrame([(p, i, c) for i, (p, c) in enumerate(rows)], "path string, file_ord long, code string")


def test_targets(spark):
    f = _files(spark, ("src/a.ts", 'const key = "widget-list-v2"'), ("src/widget_list_v2.ts", "x"), ("src/b.ts", "class WidgetListV2 {}"), ("src/c.ts", "call()"))
    find = lambda t: [tuple(r)[1:] for r in packing.resolve_target(f, t).collect()]
    assert find("widget-list-v2") == [("src/b.ts", "declaration")]
    assert find("Widget.List.v2") == [("src/b.ts", "declaration")] or find("Widget.List.v2") == [("src/widget_list_v2.ts", "filename")]
    assert find("call") == [("src/c.ts", "reference")] and find("nothing") == []


def _fold(costs, budget):
    left, out = budget, []
    for c in costs:
        out.append(c <= left)
        left -= c if out[-1] else 0
    return out


@pytest.mark.parametrize("budget", [0, 7, 90, 700, 3000, 100_000])
def test_first_fit_equals_a_fold(spark, budget):
    import random

    r = random.Random(budget)
    costs = [r.randint(-3 if budget % 2 else 1, 60) for _ in range(400)]
    items = spark.createDataFrame([(i // 23, i, c) for i, c in enumerate(costs)], "chunk long, ord long, cost long")
    got = [x.taken for x in packing.first_fit(items, budget).orderBy("ord").collect()]
    assert got == _fold(costs, budget)


def test_layers_of_a_pack_are_made_once(spark, monkeypatch, sf):
    from siltstone.plans import catalog

    made, old = [], packing.with_layers
    for module in (packing, catalog.lines):
        monkeypatch.setattr(module, "with_layers", lambda *a: made.append(1) or old(*a))
    entries, s = catalog._pack_large(spark, sf)
    assert len(made) == 1 and s.first().total_tokens == sum(r.tokens for r in entries.select("tokens").collect())


def test_patterns_only_where_the_name_is(spark):
    f = _files(spark, ("a.ts", "Run5(1)"), ("b.ts", "x = 'run-5'"), ("run_5.ts", ""), ("c.ts", "type Run5 = 1"), ("d.ts", None))
    found = lambda df: [tuple(r)[1:] for r in packing.resolve_target(df, "run-5").collect()]
    assert found(f) == [("c.ts", "declaration")] and found(f.where("path <> 'c.ts'")) == [("run_5.ts", "filename")]
    assert found(f.where("path < 'b.z'")) == [("b.ts", "reference")] and found(f.where("path = 'a.ts'")) == []
    assert "contains(code" in packing.resolve_target(f, "run-5")._jdf.queryExecution().toString().lower()


def test_set_hash_gathers_bytes(spark):
    import hashlib

    from siltstone.operators import handoff

    df = spark.createDataFrame([(f"p{i}", i) for i in range(300)], "a string, b int")
    digits = sorted(hashlib.sha256(f"p{i}\x1f{i}".encode()).hexdigest() for i in range(300))
    got = handoff.set_hash(df, "a", "b")
    assert got.first().hash == hashlib.sha256("".join(digits).encode()).hexdigest()[:12]
    assert "unhex" in got._jdf.queryExecution().toString()


def test_pack(spark):
    big = "\n".join(f"function g{i}(a, b) {{\n  return a + {i};\n}}" for i in range(30))
    f = _files(spark, ("a.ts", big), ("b.ts", 'import { x } from "./a"\nfunction h() {\n  // a comment of many words here\n  // and one more of them\n}'), ("c.ts", "function k() {\n}\n"))
    entries, s = packing.pack(f, 100_000, target="g3")
    assert {r.path: r.layer for r in entries.collect()} == {"a.ts": "L3", "b.ts": "L1", "c.ts": "L1"}
    s = s.first()
    assert (s.files_at_l1, s.files_at_l3, s.target_file, s.matched_by, s.missing, s.truncated) == (2, 1, "a.ts", "declaration", False, False)
    entries, s = packing.pack(f, 20, target="g3")
    s = s.first()
    assert s.downgraded and s.truncated and s.total_tokens > 20 and s.matched_by is None and s.files_at_l1 == 1
    entries, s = packing.pack(f, 12)
    assert sum(r.tokens for r in entries.collect()) <= 12 and s.first().target_file is None
    assert packing.pack(f, 1000, target="absent")[1].first().missing


DIFF = ["junk", "@@ -1,3 +10,4 @@ f", " import x from 'y'", "+added", "+++ b/f", "-removed", " }", "@@ -20 +30 @@", "+more"]


def test_hunks(spark):
    d = spark.createDataFrame([("f", i, x) for i, x in enumerate(DIFF)], "file string, line_no int, line string")
    got = [tuple(r)[2:] for r in deltas.hunks(d).orderBy("hunk_no").collect()]
    assert got == [(10, 13, ["added"], ["removed"], ["import x from 'y'", "}"]), (30, 31, ["more"], [], [])]
    ir = deltas.l2(deltas.delta_context(d)).first().ir
    assert ir == "FILE: f\nCHANGED: added\n         removed\nCONTEXT: USE:y{x}\nCHANGED: more"


CODE = "export function f(a, b) {\n  // a comment that is long enough to lose\n  // and another one\n  return a;\n}"


def test_fences(spark):
    texts = [f"see\n```ts src/foo.ts\n{CODE}\n```\nend", f"```python\n{CODE}\n```", "```json\n{}\n```", "```ts\nx\n```", "none", None]
    m = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r for r in messages.compress_text(m, engine="lines").collect()}
    first = messages.compress_text(m).where("i = 0").first()  # by syntax
    assert first.text == "see\n```ts src/foo.ts\nOUT FN:f(a, b)\n    RET a\n```\nend" and first.blocks_compressed == 1
    assert got[0].text == "see\n```ts src/foo.ts\nOUT FN:f(a,b)\n  RET a\n```\nend" and got[0].blocks_compressed == 1
    assert got[1].blocks_compressed == 1 and got[0].raw_tokens > got[0].ir_tokens
    assert all(got[i].text == texts[i] and got[i].blocks_compressed == 0 for i in (2, 3, 4, 5))
    paths = [r.path for r in messages.fence_blocks(m, "i").orderBy("i").collect()]
    assert paths == ["src/foo.ts", "snippet.py", None, "snippet.ts"]
    body = [("s\n```ts\n" + CODE + "\n```", [("user", texts[0], [("text", texts[1]), ("image", None)])])]
    out = messages.compress_bodies(spark.createDataFrame(body, "system string, messages array<struct<role:string,content:string,blocks:array<struct<type:string,text:string>>>>"), "lines").first()
    assert "RET a" in out.system and "RET a" in out.messages[0].content and "RET a" in out.messages[0].blocks[0].text and out.messages[0].blocks[1].text is None


def test_read_decision(spark):
    long = "\n".join(f"export function f{i}(a, b) {{\n  // words words words words words words\n  return a + {i};\n}}" for i in range(60))
    rows = [("a.ts", long, False), ("a.ts", long, True), ("a.md", long, False), ("a.ts", "x", False), ("a.ts", "zz!\n" * 900, False)]
    got = [(r.reason, r.compress) for r in messages.read_decision(spark.createDataFrame(rows, "path string, content string, has_range boolean")).collect()]
    assert got == [("compressed", True), ("ranged read", False), ("unsupported language", False), ("below threshold", False), ("no win", False)]
    hooks = [json.dumps({"tool_name": "Read", "tool_input": {"path": "p.ts", "limit": 5}}), json.dumps({"tool_name": "Bash", "tool_input": {}}), "no json"]
    assert [(r.path, r.has_range) for r in messages.hook_reads(spark.createDataFrame([(h,) for h in hooks], "value string")).collect()] == [("p.ts", True)]


def test_handoff(spark):
    f = _files(spark, ("a.ts", CODE), ("b.ts", "x"), ("c.md", "y"))
    st = spark.createDataFrame([("a.ts", "modified"), ("b.ts", "deleted"), ("c.md", "added"), ("d.py", "added")], "path string, status string")
    got = {r.path: r for r in handoff.changed_files(st, f).collect()}
    assert set(got) == {"a.ts", "b.ts", "d.py"} and got["b.ts"].ir == got["b.ts"].hash == "" and got["d.py"].tokens == 0 and got["a.ts"].tokens > 0
    p = spark.createDataFrame([("a", 3)], "file string, changes long")
    h1 = handoff.handoff_hashes(p, handoff.changed_files(st, f), ["file", "changes"], ["path", "hash"])
    h2 = handoff.handoff_hashes(p, handoff.changed_files(st.orderBy("status"), f.repartition(3)), ["file", "changes"], ["path", "hash"])
    assert h1.first() == h2.first()
    r = handoff.reuse(h1, h2.withColumn("delta_hash", F.lit("x"))).first()
    assert r.prefix_reused and not r.delta_reused
    assert not handoff.reuse(h1, h2.limit(0)).first().prefix_reused


def test_reports(spark):
    f = _files(spark, ("a.ts", "const A: number = 5;\nif (x === \"q\") {\ncase 'z':"), ("b.rb", "x"), ("c.rb", "y"))
    x = reports.fidelity(f.withColumn("ir", F.lit("A q"))).where("path = 'a.ts'").first()
    assert (x.names, x.names_kept, x.constants, x.constants_kept, x.branches, x.branches_kept) == (1, 1, 1, 0, 2, 0)
    c = reports.coverage(f)
    w = reports.coverage_warning(c).first()
    assert (w.unsupported, w.total, w.percent, w.exts) == (2, 3, 67, ".rb")
    assert reports.benchmark_summary(reports.benchmark_files(f)).first().files == 3


PATHS = [("src/a.ts", True), ("node_modules/x/a.ts", False), ("src/.git/a.py", False), ("dist/a.js", False), ("src/a.md", False), ("src/b.java", True), ("src\\dist\\a.ts", False)]


def test_live(spark, tmp_path):
    df = spark.createDataFrame([(p,) for p, _ in PATHS], "p string")
    assert [r.y for r in df.select(live.triggers_reindex("p").alias("y")).collect()] == [t for _, t in PATHS]
    ts = [0.0, 0.1, 0.3, 0.7, 5.0, 3600.1, 3600.2, 9000.0]
    ch = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "event_id long, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    assert sorted(r.n for r in live.debounce(ch).collect()) == [1, 1, 1, 2, 3]
    log = spark.createDataFrame([(5, 10.4), (3, -1.0), (4, float("nan")), (6, 2.5)], "ts int, saved double")
    assert tuple(live.savings(log).first()) == (13, 2, 5)


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps({"rel_path": p, "ts": f"2024-01-01 00:00:0{i}"}) for i, (p, _) in enumerate(PATHS)))
    seen = []
    live.rebuild_on_change(live.watch(spark, str(folder)), lambda b, e: seen.append(sorted(r.rel_path for r in b.collect())), str(tmp_path / "c1")).awaitTermination(120)
    assert seen == [["src/a.ts", "src/b.java"]]
    (folder / "2.json").write_text(json.dumps({"rel_path": "src/z.ts", "ts": "2024-01-01 01:00:00"}))
    q = live.debounce_stream(live.watch(spark, str(folder)), "10 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.n for r in spark.sql("SELECT n FROM bursts").collect()] == [2]


def test_controls_and_signals_of_all_events(spark):
    """Every event's controls and signals follow from the rows, not those of 50 only."""
    import random

    r = random.Random(5)
    t = touches(spark, [(f"c{r.randint(0, 150)}", r.choice("abc"), f"f{r.randint(0, 12)}", r.choice(["fix: x", "feat: y"]), r.randint(0, 40)) for _ in range(400)])
    ft = [tuple(x) for x in risk.file_touches(t).select("hash", "file", "second", "is_fix").collect()]
    events = [tuple(x) for x in risk.events(t).collect()]
    assert len(events) > 200
    rows = {}
    for x in sorted(risk.control_sample(t, rows=40).collect(), key=lambda x: (x.break_hash, x.nth)):
        rows.setdefault((x.break_hash, x.break_second), []).append((x.file, x.second))
    assert set(rows) == {(b, s) for b, s, _, _ in events}
    steps = [tuple(x) for x in risk.time_travel(t).collect()]
    for b, at, f, _ in events:
        fixed = {file for h, file, _, _ in ft if h == f}
        latest = {}
        for _, file, s, _ in ft:
            if s <= at:
                latest[file] = max(s, latest.get(file, s))
        want = sorted(((x, s) for x, s in latest.items() if x not in fixed), key=lambda x: (-x[1], x[0]))[: min(len(fixed), 5)]
        assert [x for x in rows[b, at] if x[0] not in fixed][: min(len(fixed), 5)] == want
    for b, at, file in {(b, at, file) for b, at, f, _ in events for h, file, _, _ in ft if h == f}:
        seen = sorted(((-s, h, fix) for h, x, s, fix in ft if x == file and s <= at))
        held = max((s for s in steps if s[0] == file and s[1] <= at), key=lambda s: s[1], default=None)
        assert (held is None) == (not seen)
        if seen:
            ratio = sum(fix for *_, fix in seen[:30]) / len(seen[:30])
            assert held[2:] == pytest.approx((min(1, sum(-s >= at - 604800 for s, *_ in seen) / 30), min(1, max(0, (ratio - 0.3) / 0.5))))

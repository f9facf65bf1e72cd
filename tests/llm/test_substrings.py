import random

from siltstone.llm import substrings as S

from .helpers import LANG, documents, no_docs, odd_docs


def brute(rows, w):
    docs = sorted({(i, t) for i, t in rows if i is not None and t})
    seen, wins = {}, []
    for i, t in docs:
        toks = t.split()
        for p in range(len(toks) - w + 1):
            wins.append((tuple(toks[p : p + w]), i, p))
    for k, i, p in sorted(set(wins), key=lambda x: (x[1], x[2])):
        seen.setdefault(k, []).append((i, p))
    marks = {}
    for places in seen.values():
        if len(places) > 1:
            for n, (i, p) in enumerate(sorted(places)):
                marks.setdefault((i, n > 0), set()).add(p)
    out = set()
    for (i, removed), ps in marks.items():
        run = None
        for p in sorted(ps):
            if run and p <= run[1]:
                run[1] = p + w
            else:
                if run:
                    out.add((i, *run, run[1] - run[0], removed))
                run = [p, p + w]
        out.add((i, *run, run[1] - run[0], removed))
    return out


def test_equals_brute_force(spark, sf):
    docs = documents(spark, sf)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for groups in (1, 7):
        got = [tuple(r) for r in S.repeats(docs, groups=groups).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, S.WINDOW)
    assert got


def test_short_windows_and_hot_passages(spark):
    r = random.Random(5)
    hot = " ".join(f"h{i}" for i in range(9))
    rows = [(i, " ".join([*(f"w{r.randint(0, 30)}" for _ in range(r.randint(0, 20))), *([hot] if i % 2 else []), *(f"v{r.randint(0, 9)}" for _ in range(6))])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(x) for x in S.repeats(docs, window=4).collect()} == brute(rows, 4)


def test_edges(spark):
    assert S.repeats(no_docs(spark)).collect() == []
    docs = odd_docs(spark)
    rows = [(r[0], r[1]) for r in docs.collect()]
    got = [tuple(r) for r in S.repeats(docs, window=5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5)
    alone = spark.createDataFrame([(1, LANG["en"]), (1, LANG["en"])], "doc_id long, text string")
    assert S.repeats(alone, window=5).collect() == []

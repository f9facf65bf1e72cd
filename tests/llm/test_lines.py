import random

from siltstone.llm import lines as L

from .helpers import documents, no_docs, odd_docs


def brute_patience(a, b):
    """Straight from the definition, on lists of lines with their places."""
    if not a or not b:
        return []
    if a[0][1] == b[0][1]:
        return [(a[0][0], b[0][0]), *brute_patience(a[1:], b[1:])]
    if a[-1][1] == b[-1][1]:
        return [*brute_patience(a[:-1], b[:-1]), (a[-1][0], b[-1][0])]
    xs, ys = [x for _, x in a], [x for _, x in b]
    pairs = [(i, ys.index(x)) for i, x in enumerate(xs) if xs.count(x) == 1 and ys.count(x) == 1]
    if not pairs:
        return []
    size, back = [], []
    for i, (_, y) in enumerate(pairs):  # longest rising chains; of equal ones the element met last goes before
        before = [j for j in range(i) if pairs[j][1] < y]
        size.append(1 + max((size[j] for j in before), default=0))
        back.append(max((j for j in range(i) if size[j] == size[i] - 1), default=-1))
    i = max(j for j in range(len(pairs)) if size[j] == max(size))
    chain = []
    while i >= 0:
        chain.append(pairs[i])
        i = back[i]
    out, p, q = [], 0, 0
    for x, y in [*reversed(chain), (len(a), len(b))]:
        out += brute_patience(a[p:x], b[q:y]) + ([(a[x][0], b[y][0])] if x < len(a) else [])
        p, q = x + 1, y + 1
    return out


def test_patience_is_a_rising_alignment_of_most_unique_lines():
    r = random.Random(4)
    for _ in range(400):
        a = [r.randint(0, 9) for _ in range(r.randint(0, 12))]
        b = [r.randint(0, 9) for _ in range(r.randint(0, 12))]
        got = L.patience(a, b)
        assert all(a[i] == b[k] for i, k in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        ref = brute_patience(list(enumerate(a)), list(enumerate(b)))
        assert sorted(ref) == got
    assert L.patience([1, 2, 3, 4], [9, 1, 2, 8, 3, 4]) == [(0, 1), (1, 2), (2, 4), (3, 5)]
    assert L.patience([1, 1, 1], [1, 1]) == [(0, 0), (1, 1)]


def brute_anchors(text, least):
    """(first line, end line, the lines) from each line on, and of the last one to the end."""
    ls, out = text.split("\n"), []
    for i in range(len(ls)):
        for j in range(i, len(ls)):
            if sum(len(x.encode()) for x in ls[i : j + 1]) >= least:
                out.append((i, j + 1, tuple(ls[i : j + 1])))
                break
    if out and out[-1][1] < len(ls):
        i = out[-1][0]
        out.append((i, len(ls), tuple(ls[i:])))
    return out


def brute_blocks(rows, least):
    docs = {}
    for i, t in rows:
        if i is not None and t:
            docs.setdefault(i, set()).update(brute_anchors(t, least))
    holders = {}
    for i, found in docs.items():
        for _, _, x in found:
            holders.setdefault(x, set()).add(i)
    seq = {i: sorted(a for a in found if len(holders[a[2]]) > 1) for i, found in docs.items()}
    first = {}
    runs = {}
    for i in sorted(seq):
        n = 1
        while n <= len(seq[i]):
            for p in range(len(seq[i]) - n + 1):
                run = tuple(a[2] for a in seq[i][p : p + n])
                first.setdefault(run, i)
                runs.setdefault((i, run), []).append(p)
            n *= 2
    out = set()

    def note(i, src, spans):
        gone = {n for s, e in spans for n in range(s, e)}
        for n in sorted(gone):
            if n - 1 not in gone:
                e = next(m for m in range(n, 10**9) if m not in gone)
                out.add((i, src, n, e, e - n))
        return gone

    for i in sorted(seq):
        mine, theirs = {}, {}
        for (d, run), at in runs.items():
            src = first[run]
            if d == i and src < i:
                for p in at:
                    mine.setdefault(src, {}).update((p + k, x) for k, x in enumerate(run))
                for t in runs[src, run]:
                    theirs.setdefault(src, {}).update((t + k, x) for k, x in enumerate(run))
        gone = set()
        for src in mine:
            a, b = sorted(mine[src].items()), sorted(theirs[src].items())
            gone |= note(i, src, [seq[i][p][:2] for p, _ in brute_patience(a, b)])
        left = [(a, min(holders[a[2]])) for a in seq[i] if min(holders[a[2]]) < i and sum(b[2] == a[2] for b in seq[i]) == 1 and not set(range(*a[:2])) <= gone]
        while left:
            turn = {}
            for a, tried in left:
                after = [d for d in sorted(holders[a[2]]) if tried < d < i]
                if after:
                    turn.setdefault(after[0], []).append(a)
            left = []
            for src, mine_ in turn.items():
                there = {}
                for line, _, x in sorted(docs[src]):
                    there.setdefault(x, line)
                other = sorted(((there[a[2]], a[2]) for a in mine_), key=lambda y: (y[0], L_hash(y[1])))
                hit = [mine_[p] for p, _ in brute_patience([(p, a[2]) for p, a in enumerate(mine_)], other)]
                gone = note(i, src, [a[:2] for a in hit])
                left += [(a, src) for a in mine_ if not set(range(*a[:2])) <= gone]
    return out


def L_hash(lines):
    return 0


def all_pairs(rows, least):
    """Lines of each document that a patience diff with some earlier document aligns, both whole; without those that the document has twice."""
    docs = [(i, brute_anchors(t, least)) for i, t in sorted(rows) if t]
    out = set()
    for n, (i, mine) in enumerate(docs):
        have = {x for _, _, x in mine}
        for _, theirs in docs[:n]:
            if have & {x for _, _, x in theirs}:
                for p, _ in L.patience([x for _, _, x in mine], [x for _, _, x in theirs]):
                    if sum(x == mine[p][2] for _, _, x in mine) == 1:
                        out |= {(i, k) for k in range(*mine[p][:2])}
    return out


def _removed(blocks):
    return {(i, n) for i, _, s, e, _ in blocks for n in range(s, e)}


def test_equals_brute_force(spark, sf):
    docs = documents(spark, sf)
    got = [tuple(r) for r in L.common_blocks(docs).collect()]
    assert len(got) == len(set(got)) > 10
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert set(got) == brute_blocks(rows, L.MIN_BYTES)
    assert all_pairs(rows, L.MIN_BYTES) <= _removed(got)


def test_small_corpora(spark):
    r = random.Random(8)
    pool = [f"a line that is long enough number {i}" for i in range(12)] + ["x", "", "short", "a few", "words"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 9)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(x) for x in L.common_blocks(docs).collect()}
    assert got == brute_blocks(rows, L.MIN_BYTES)
    every = all_pairs(rows, L.MIN_BYTES)
    assert len(every & _removed(got)) >= 0.97 * len(every)


def test_orders_that_several_documents_share(spark):
    x, y = "a line that is long x", "a line that is long y"
    found = lambda *ts: {tuple(r) for r in L.common_blocks(spark.createDataFrame(list(enumerate(ts, 1)), "doc_id long, text string")).collect()}
    got = found(f"{x}\n{y}", f"{y}\n{x}", f"{y}\n{x}")  # the third is the second's copy
    assert (3, 2, 0, 2, 2) in got and {r[:1] + r[2:4] for r in got if r[0] == 2} < {(2, 0, 1), (2, 1, 2)}
    # a block of two whose lines first stand in different documents
    assert (4, 3, 0, 2, 2) in found(f"{x}\n1", f"{y}\n2", f"{x}\n{y}", f"{x}\n{y}\n4")
    # lines that cross in the earliest holder go with the next one
    between = "\n".join(f"only one has this line {i}" for i in range(3))
    got = found(f"{x}\n{y}", f"{y}\n{between}\n{x}", f"{y}\nsomething else is here now\n{x}")
    assert _removed(got) >= {(3, 0), (3, 2)}
    # short lines find each other together
    poem = "\n".join("roses are\nred and\n\nviolets\nare blue".split("\n"))
    assert (2, 1, 1, 6, 5) in found(poem, "intro\n" + poem, "roses are")


def test_deletion(spark):
    a = "A first line that is long\nshort\nA second line that is long\nend"
    rows = [(1, a, 9), (2, "intro that only this one has\n" + a, 9), (3, a, 9), (4, None, None), (None, a, 9), (5, "end", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = L.without_common_blocks(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: (a, 9), 2: ("intro that only this one has", 28), 4: (None, None), None: (a, 9), 5: ("end", 3)}


def test_edges(spark):
    assert L.common_blocks(no_docs(spark)).collect() == []
    assert L.without_common_blocks(no_docs(spark)).collect() == []
    docs = odd_docs(spark, "one long line of this document\nand another one that is long")
    assert [tuple(r) for r in L.common_blocks(docs).collect()] == [(2, 1, 0, 2, 2)]
    out = L.without_common_blocks(docs)
    assert out.columns == docs.columns
    assert sorted(str(r[0]) for r in out.collect()) == sorted(["1", "1", "3", "4", "5", "None", "6", "7", "8"])
    hot = spark.createDataFrame([(i, f"my own line that is long {i}\nthe line that everybody has got") for i in range(500)], "doc_id long, text string")
    assert L.common_blocks(hot).count() == 499

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from siltstone.llm import kernels as K
from siltstone.llm import near as N

from .helpers import LANG, documents, no_docs, odd_docs


def similar_pairs(docs, least):
    """All pairs of documents at least so similar, by brute force."""
    rows = sorted({(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect() if r.doc_id is not None})
    buf, off = K.text_buffers(pa.array([t for _, t in rows], pa.string()))
    h, _, _, woff = K.words(buf, off)
    g, goff = K.grams(h, woff, N.SHINGLE)
    bags = [Counter(g[a:b].tolist()) for a, b in zip(goff[:-1], goff[1:])]
    total = [sum(b.values()) for b in bags]
    where = defaultdict(list)
    for i, b in enumerate(bags):
        for x, c in b.items():
            where[x].append((i, c))
    both = Counter()
    for places in where.values():
        for a, (i, c) in enumerate(places):
            for j, d in places[a + 1 :]:
                both[i, j] += min(c, d)
    return {(rows[i][0], rows[j][0]): v / (total[i] + total[j] - v) for (i, j), v in both.items() if v >= least * (total[i] + total[j] - v)}


def test_signatures_estimate_weighted_jaccard():
    rng, err = np.random.default_rng(0), []
    for _ in range(40):
        m = 150
        x = rng.integers(0, 6, m) * rng.choice([1.0, 0.5])
        y = np.where(rng.random(m) < 0.6, x, rng.integers(0, 6, m)).astype(float)
        el = rng.integers(0, 1 << 44, m).astype(np.uint64)
        e, w = np.concatenate([el[x > 0], el[y > 0]]), np.concatenate([x[x > 0], y[y > 0]])
        d = np.repeat([0, 1], [(x > 0).sum(), (y > 0).sum()])
        sig = N.dart_minhash(e, w, d, 2, 144)
        assert (sig != 0).all()
        err.append((sig[0] == sig[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum())
    assert abs(np.mean(err)) < 0.02 and np.std(err) < 0.06


def test_recall_and_precision(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    group = {r.doc_id: r.group_id for r in N.near_duplicates(docs).collect()}
    pairs = similar_pairs(docs, N.SIMILARITY)
    found = sum(group.get(a, -1) == group.get(b, -2) for a, b in pairs)
    assert len(pairs) > 100 and found >= 0.9 * len(pairs)
    loose = similar_pairs(docs, N.SIMILARITY - 3 * N.SLACK)
    assert set(group) <= {x for p in loose for x in p}


def test_groups_have_one_kept_member(spark, sf):
    rows = N.near_duplicates(documents(spark, sf)).collect()
    sizes = Counter(r.group_id for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)
    for r in rows:
        assert r.group_size == sizes[r.group_id] >= 2 and r.keep == (r.doc_id == r.group_id) and r.group_id <= r.doc_id


def test_forest_equals_components():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (5, 144)).astype(np.uint8)
    sig = base[rng.integers(0, 5, 60)].copy()
    noise = rng.random(sig.shape) < rng.random((60, 1)) * 0.5
    sig[noise] = rng.integers(0, 256, noise.sum())
    alike = np.array([[N.estimate(a, b) >= 0.45 for b in sig] for a in sig])

    def labels(edges):
        root = list(range(60))
        for _ in range(60):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    forest = N.forest(sig, 0.45)
    assert all(alike[a, b] for a, b in forest)
    assert labels(forest) == labels([(a, b) for a in range(60) for b in range(60) if alike[a, b]])


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (200, 100), (7, 7)]
    got = dict((r.node, r.root) for r in N.components(spark.createDataFrame(edges, "a long, b long"), "t").collect())
    assert got == {**{i: 1 for i in range(2, 41)}, 101: 100, 102: 100, 200: 100}


def test_edges(spark):
    assert N.near_duplicates(no_docs(spark)).collect() == []
    docs = odd_docs(spark)
    got = {r.doc_id: (r.group_id, r.group_size, r.keep) for r in N.near_duplicates(docs).collect()}
    assert got == {1: (1, 2, True), 2: (1, 2, False)}
    kept = N.keep_first_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r[0]) for r in kept.collect()) == sorted(["1", "1", "3", "4", "5", "None", "6", "7", "8"])
    rows = [(1, "?!"), (2, "?!"), (3, "?"), (4, "word"), (5, "Word."), (6, " ".join(LANG.values()) * 300), (7, " ".join(LANG.values()) * 300 + " x")]
    got = {r.doc_id: r.group_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 4: 4, 5: 4, 6: 6, 7: 6}

import math

from siltstone.llm import language as L

from .helpers import LANG, documents, no_docs, odd_docs


def chosen(docs, sample):
    by: dict = {}
    for r in docs.select("doc_id", "lang", L.F.xxhash64("doc_id").alias("h")).collect():
        by.setdefault(r.lang, []).append((r.h, r.doc_id))
    return {i for found in by.values() for _, i in sorted(found)[:sample]}


def test_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    coder = L.fit(docs, sample=60)
    seen = chosen(docs, 60)
    truth = {r.doc_id: r.lang for r in docs.collect() if r.doc_id not in seen}
    rows = [r for r in L.identify(docs, coder).collect() if r.doc_id in truth]
    assert len(rows) == len(truth) > 600
    assert sum(r.lang == truth[r.doc_id] for r in rows) >= 0.97 * len(rows)
    assert sum(r.accepted for r in rows) >= 0.99 * len(rows)
    kept = {r.doc_id for r in L.keep_identified(docs, sample=60).collect()}
    assert kept == {r.doc_id for r in L.identify(docs, coder).collect() if r.accepted}


def brute_grams(text):
    """n-grams of letters straight from the text's bytes, runs of others as one 0."""
    c: list[int] = []
    for b in text.encode():
        b = b + 32 if 65 <= b <= 90 else b
        b = b if 97 <= b <= 122 or b > 127 else 0
        if b or (c and c[-1]):
            c.append(b)
    out = []
    for k, n in enumerate(L.ORDERS):
        for i in range(len(c) - n + 1):
            h = 0
            for x in c[i : i + n]:
                h = (h * 0x01000193 ^ x) & 0xFFFFFFFF
            h = h * 0x85EBCA6B & 0xFFFFFFFF
            h ^= h >> 15
            out.append((h & ((1 << L.BITS) - 1)) + (k << L.BITS))
    return out


def test_equals_brute_force(spark, sf):
    """Counts, bits, weights and decoding with plain loops."""
    docs = documents(spark, sf)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    seen = chosen(docs, 20)
    sample = sorted({(lang, t) for i, t, lang in rows if i in seen and t})
    langs = sorted({lang for lang, _ in sample})
    code = L.codewords(len(langs))
    share: dict = {}
    for lang in langs:
        count: dict = {}
        for own, t in sample:
            for g in brute_grams(t) if own == lang else ():
                count[g] = count.get(g, 0) + 1
        total = [sum(n for g, n in count.items() if g >> L.BITS == k) for k in range(len(L.ORDERS))]
        share[lang] = lambda g, count=count, total=total: (count.get(g, 0) + 0.5) / (total[g >> L.BITS] + (1 << L.BITS) * 0.5)

    def margins(text):
        grams = brute_grams(text)
        out = []
        for bit in code.T:
            s = 0.0
            for g in grams:
                yes = [share[x](g) for x, b in zip(langs, bit) if b > 0]
                no = [share[x](g) for x, b in zip(langs, bit) if b < 0]
                s += math.log(sum(yes) / len(yes)) - math.log(sum(no) / len(no))
            out.append(4 * s / max(1, len(grams)))
        return out, len(grams)

    short = [r for r in rows if r[1] and len(r[1]) < 1500][:60]
    right = {x: [0] * code.shape[1] for x in langs}
    for lang, t in sample:
        for k, m in enumerate(margins(t)[0]):
            right[lang][k] += m * code[langs.index(lang)][k] > 0
    weight = []
    for x in langs:
        acc = [(r + 1) / (sum(own == x for own, _ in sample) + 2) for r in right[x]]
        weight.append([a / sum(acc) for a in acc])
    got = {r.doc_id: r for r in L.identify(docs, L.fit(docs, 20)).collect()}
    for i, t, _ in short:
        m, n = margins(t)
        loss = [sum(w * math.log1p(math.exp(-x * b)) for x, b, w in zip(m, code[k], weight[k])) for k in range(len(langs))]
        best = sorted(loss)
        gap = (best[1] - best[0]) / math.log(2)
        assert got[i].n_grams == n and abs(got[i].gap - (gap if n else 0)) < 1e-3
        if abs(best[1] - best[0]) > 1e-3 and n:
            assert got[i].lang == langs[loss.index(best[0])]
        if abs(gap - L.GAP) > 1e-3:
            assert got[i].accepted == (n >= L.MIN_GRAMS and gap >= L.GAP)


def test_rare_languages_are_known(spark):
    """One labelled document of 2 000 is enough to be told, and the hot language doesn't crowd it out."""
    rows = [(i, LANG["en"] + f" {i}", "en") for i in range(2000)] + [(5000, "zxqw vkkj pqzx wvvk jqxz " * 4, "xx"), (5001, "zxqw pqzx wvvk vkkj jqxz " * 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.identify(docs, sample=50).collect()}
    assert got[5001].lang == "xx" and got[5001].accepted and got[7].lang == "en"


def test_codewords_differ():
    for k in (2, 3, 4, 5, 9, 30):
        code = L.codewords(k)
        assert len({tuple(c) for c in code}) == k
        if k >= 4:
            assert min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) >= 3


def test_a_mixture_is_ambiguous(spark):
    rows = [(i, LANG["en"], "en") for i in range(5)] + [(10 + i, LANG["de"], "de") for i in range(5)] + [(99, "1234 5678 !!", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    assert got[0].lang == "en" and got[10].lang == "de" and got[0].accepted and got[10].accepted
    assert got[99].lang is None and got[99].ambiguous and not got[99].accepted


def test_edges(spark):
    assert L.identify(no_docs(spark)).collect() == []
    docs = odd_docs(spark)
    rows = L.identify(docs).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 2, 3, 4, 5, 6, 7, 8]
    for r in rows:
        assert r.accepted == (r.doc_id in (1, 2, 6, 8)), r
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0] is None, r[0] or 0) for r in kept.collect()) == [(False, 1), (False, 1), (False, 2), (False, 6), (False, 8), (True, 0)]
    unlabelled = docs.withColumn("lang", L.F.lit(None).cast("string"))
    assert all(r.lang is None and r.accepted for r in L.identify(unlabelled).collect())
    assert L.keep_identified(unlabelled).count() == docs.count()
    assert L.identify(docs.drop("lang")).count() == 9
    one = spark.createDataFrame([(1, "only words", "en")], "doc_id long, text string, lang string")
    assert L.identify(one).first().lang == "en"

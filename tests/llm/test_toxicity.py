import random
import re
import unicodedata

import pytest

from siltstone.llm import toxicity as X

from .helpers import documents, no_docs, odd_docs


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_match(word, lexicon):
    """Plain Levenshtein against every term, with and without accents; for stems the spelling at the start."""
    forms = {word, "".join(unicodedata.normalize("NFKD", c)[0] for c in word)}
    near = [(d, t) for t in lexicon.words for d in [min(_distance(f, t) for f in forms)] if d <= X.reach(t)]
    near += [(0, t) for t in lexicon.stems if t not in lexicon.words and any(f.startswith(t) for f in forms)]
    return min(near, default=None)


def brute_score(text, lexicon, window=X.WINDOW):
    tokens = [t for t in re.split(r"[\s,;:/|…–—]+", text) if t]
    plain = [X.bare(t) for t in tokens]
    score = n = wrong = quoted = 0
    terms = set()
    for i, w in enumerate(plain):
        hit = brute_match(w, lexicon) if w else None
        if hit is None or hit[0] and w in lexicon.known:
            continue
        before, after = tokens[max(0, i - window) : i + 1], tokens[i : i + window + 1]
        marked = any(c in X.QUOTES for t in before for c in t) and any(c in X.QUOTES for t in after for c in t)
        cited = marked or any(b in X.REPORTING for b in plain[max(0, i - window) : i])
        told = any(b in X.ADDRESS for b in plain[max(0, i - window) : i + window + 1])
        score += X.POINTS[hit[0]][1 if cited else 2 if told else 0]
        n, wrong, quoted = n + 1, wrong + (hit[0] > 0), quoted + cited
        terms.add(hit[1])
    return score, n, wrong, quoted, sorted(terms)


LEX = X.Lexicon(X.LEXICON, ("lowei", "réê", "dumbo"), frozenset(X.KNOWN))


def test_automaton_equals_levenshtein():
    auto, r, words = X.Automaton(LEX), random.Random(3), []
    for t in (*LEX.words, *LEX.stems):
        words.append(t)
        for _ in range(60):
            w = list(t)
            for _ in range(r.randint(0, 4)):
                i = r.randint(0, len(w))
                k = r.random()
                if k < 0.35:
                    w.insert(i, r.choice("abcdeilnorstuüé1"))
                elif k < 0.7 and w:
                    del w[min(i, len(w) - 1)]
                elif w:
                    w[min(i, len(w) - 1)] = r.choice("abcdeilnorstuöé0")
            if w:
                words.append("".join(w))
    for w, (e, t) in zip(words, auto.match(words)):
        assert (None if e < 0 else (e, auto.terms[t])) == brute_match(w, LEX), w


def _run(spark, *texts, lexicon=X.LEXICON):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in X.toxicity(docs, lexicon=lexicon).collect()}


def test_one_misspelled_insult_is_enough(spark):
    told = ["he is a m0ron", "what an idi0t he is", "a wortless man", "you are a morron", "you are such an idiott", "you worthles man", "1diot", "ldiot!", "5tupid", "@sshole", "*diot", "a tupid thing", "mörön", "that moron—no, really", "…idiot…", "¡idiota!", "So ein Vollidot", "quel crètin", "eres un imbecil", "Estupido"]
    got = _run(spark, *told)
    assert [t for i, t in enumerate(told) if i not in got] == []


def test_context_and_known_words(spark):
    got = _run(
        spark,
        "he is a moron.",
        'The article said "moron" was a harsh term',
        "you are such a st-upid clown",
        "the morning has a crown of closer lovers, an abrupt idiom to thrash",
        'a quoted "idiot" beside plain words',
        "a worthlis smile",
        "er nannte ihn gestern einen Trottel",
        "loweischaft réêou",
        lexicon=LEX,
    )
    assert set(got) == {0, 2, 7}
    assert got[0].score == 20 and got[0].terms == ["moron"]
    assert got[2].score == 60 and got[2].terms == ["clown", "stupid"]
    assert got[7].n_misspelled == 0 and got[7].terms == ["lowei", "réê"]


def test_equals_brute_force(spark, sf):
    docs = documents(spark, sf)
    lexicon = X.Lexicon(X.LEXICON, ("achlich", "réeux", "bomente"), frozenset({*X.KNOWN, "oron"}))
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text and r.doc_id is not None]
    r = random.Random(5)
    for i in range(60):  # insults bent and put into context, which the table hasn't
        words = r.choice(rows)[1][:300].split()
        for _ in range(2):
            t = list(r.choice(X.LEXICON))
            t[r.randrange(len(t))] = r.choice("aeö0-é")
            words.insert(r.randint(0, len(words)), r.choice(["{}", "“{}”", "said {}", "you {}", "({})", "—{}—", "{}s"]).format("".join(t)))
        rows.append((10**9 + i, " ".join(words)))
    short = [(i, t) for i, t in rows if len(t) < 3000]
    got = {r.doc_id: tuple(r)[1:] for r in X.toxicity(spark.createDataFrame(short, "doc_id long, text string"), lexicon=lexicon).collect()}
    quick: dict = {}
    real = brute_match

    def remembered(word, lex):
        if word not in quick:
            quick[word] = real(word, lex)
        return quick[word]

    globals()["brute_match"] = remembered
    try:
        want = {i: s for i, t in short for s in [brute_score(t, lexicon)] if s[0] >= X.THRESHOLD}
    finally:
        globals()["brute_match"] = real
    assert len(want) > 60
    assert {i: (*g[:4], sorted(g[4])) for i, g in got.items()} == want


def test_cover():
    toxic = {"idio": [*range(10)], "idiot": [*range(10)], "idiots": [1], "bad": [*range(40)], "copy": [1, 2, 3, 4, 5], "trol": [*range(8, 20)], "trolls": [*range(8, 12)]}
    assert X.cover({"bad": 40, "trol": 1}, toxic) == ["trol", "idiot"]
    assert X.cover({"trol": 1}, toxic, 9.0) == ["bad"]
    assert X.cover({}, {}) == []


@pytest.fixture(scope="module")
def tongues(spark):
    """Labelled documents of four invented languages, each with stems of its own that only toxic ones have, a few of them reached by no more than an ending."""
    r = random.Random(12)
    rows = []
    for k, (letters, stem) in enumerate([("aeioknt", "zarku"), ("uöüßrsl", "grüß"), ("éèlmnp", "vequ"), ("абвгде", "жуэк")]):
        pool = ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(300)]
        for i in range(200):
            words = [r.choice(pool) for _ in range(40)]
            bad = i % 5 == 0
            if bad:
                words[r.randrange(40)] = stem + r.choice(pool)
            rows.append((len(rows), " ".join(words), k, int(bad)))
    return rows


def test_held_out_recall_by_language(spark, tongues):
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in tongues], "doc_id long, text string")
    labels = spark.createDataFrame([(i, b) for i, _, _, b in tongues], "doc_id long, toxic int")
    caught = {r.doc_id for r in X.toxicity(docs, labels.where("doc_id % 2 = 1")).collect()}
    for k in range(4):
        held = [(i in caught, b) for i, _, tongue, b in tongues if tongue == k and i % 2 == 0]
        assert sum(c for c, b in held if b) >= 0.9 * sum(b for _, b in held)
        assert sum(c for c, b in held if not b) <= 0.02 * len(held)


def test_fit_edges(spark):
    docs = odd_docs(spark, "a moron and a clown")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.fit(docs, empty).stems == ()
    odd = spark.createDataFrame([(1, 1, 5), (1, 0, 5), (3, 1, 5), (4, 1, 5), (None, 1, 5), (99, 1, 5), (2, None, 5)], "doc_id long, toxic int, TOXIC_2 int")
    assert X.fit(docs, odd).stems == ()
    assert {r.doc_id for r in X.toxicity(docs, odd).collect()} == {1, 2}
    many = spark.createDataFrame([(i, f"word{i} zorgly") for i in range(20)] + [(100 + i, f"word{i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(100 + i, 0) for i in range(20)], "doc_id long, toxic int")
    assert X.fit(many, labels).stems == ("zorgly",)


def test_edges(spark):
    assert X.toxicity(no_docs(spark)).collect() == []
    rows = X.toxicity(odd_docs(spark, "a moron and a clown")).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 2]
    assert {r.score for r in rows} == {40}
    assert _run(spark, "moron " * 100_000)[0].n_hits == 100_000
    assert _run(spark, "x" * 1_000_000, "", "!?") == {}

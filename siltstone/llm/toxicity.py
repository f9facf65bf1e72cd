"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import kernels as K
from siltstone.llm.docs import numbered, texts

#: Insults of English, German, French and Spanish. What else a corpus calls toxic is learnt from its labels.
LEXICON = tuple(
    """asshole bastard clown disgusting dumbass idiot imbecile jackass loser moron pathetic scum scumbag stupid trash worthless
    abschaum arschloch drecksau dummkopf hurensohn miststück schwachkopf trottel vollidiot wichser
    abruti connard connasse crétin débile enculé imbécile ordure salaud salope
    cabrón estúpida estúpido gilipollas idiota imbécil pendejo""".split()
)
#: Words of these languages that are an edit or two from an insult and are none.
KNOWN = tuple(
    """abrupt apathetic boron brash bustard closer crash crown dastard discussing flown idiom laser loner lose loses lover
    lower mirthless moroni poser thrash wordless worthiness blown canard cretan mobile pendle""".split()
)
QUOTES = '"“”«»„‟'
REPORTING = frozenset(
    """called quote quoted said says term word wrote nannte sagte zitat zitierte begriff wort schrieb
    appelé cité citation disait terme écrit dijo llamó citó palabra término escribió""".split()
)
ADDRESS = frozenset("you your youre u dich dein deine du ihr euch toi ton vous votre tú usted eres ustedes".split())
#: Points of a hit by its edits: plain, in quotation or report, addressed to the reader.  One edit, if the result is no known word, is as good as none.
POINTS = {0: (20, 5, 30), 1: (20, 5, 30), 2: (12, 3, 20)}
THRESHOLD = 20
WINDOW = 6
#: Fitting looks at no more labelled documents than this of either class, the first by the hash of their id, whole texts.
SAMPLE = 3000
#: A learnt stem: letters, labelled toxic documents with it, those that no other stem covers, and the share of its documents that are toxic.
STEM, SUPPORT, GAIN, PRECISION = (4, 12), 5, 3, 0.9
SCHEMA = "doc_id bigint, score bigint, n_hits bigint, n_misspelled bigint, n_quoted bigint, terms array<string>"

_WORD = re.compile(r"[^\W\d_]+")


def reach(term: str) -> int:
    """Edits allowed in a word: none below 5 letters, 1 below 9, else 2."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: kind (0 between tokens, 1 no letter, 2 letter or digit), its small letter, and the small letter without its accent."""
    kind = np.ones(0x110000, np.uint8)
    small = np.arange(0x110000, dtype=np.int32)
    plain = small.copy()
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum():
            kind[c] = 2
            low = ch.lower()
            small[c] = ord(low[0])
            plain[c] = ord(unicodedata.normalize("NFKD", low)[0])
        elif ch.isspace() or ch in ",;:/|…–—":
            kind[c] = 0
    return kind, small, plain


@dataclass(frozen=True)
class Lexicon:
    """Whole words, learnt stems that any ending may follow, and words that are no misspellings.

    Stems must be spelled right: near misses of what labels teach are often
    ordinary words of the same language, as held-out labels show.
    """

    words: tuple[str, ...] = LEXICON
    stems: tuple[str, ...] = ()
    known: frozenset = field(default_factory=lambda: frozenset(KNOWN))


class Automaton:
    """The lexicon's trie intersected with the Levenshtein automata of its terms, made deterministic.

    A state is a set of (trie node, edits so far); any letter, the first
    included, may be wrong, missing or superfluous, as often as reach() of the
    term says.  A stem that is complete stays so whatever follows.
    ``step[state, letter]`` is the transition table over ``letters`` and one
    class for all others, state 0 is dead, state 1 the start; ``term`` and
    ``edits`` tell what a state accepts (-1: nothing): the nearest term, the
    first in the alphabet among equals.
    """

    def __init__(self, lexicon: Lexicon | tuple = LEXICON):
        if not isinstance(lexicon, Lexicon):
            lexicon = Lexicon(tuple(lexicon))
        self.known = lexicon.known
        low = lambda ts: {unicodedata.normalize("NFC", t).lower() for t in ts if t}
        words = low(lexicon.words)
        stems = low(lexicon.stems) - words
        self.terms = tuple(sorted(words | stems))
        #: Edits allowed for each term, and whether endings may follow.
        self.open = tuple(t in stems for t in self.terms)
        self.reach = tuple(0 if s else reach(t) for t, s in zip(self.terms, self.open))
        children: list[dict[str, int]] = [{}]
        ends: dict[int, int] = {}
        most = [0]
        for i, term in enumerate(self.terms):
            node = 0
            most[0] = max(most[0], self.reach[i])
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    most.append(0)
                node = children[node][c]
                most[node] = max(most[node], self.reach[i])
            ends[node] = i
        whole = {node for node, i in ends.items() if self.open[i]}

        def close(found: dict[int, int]) -> frozenset:
            todo = list(found.items())
            while todo:
                node, e = todo.pop()
                if found.get(node, 99) == e:
                    for child in children[node].values():  # a letter of the term is missing
                        if e + 1 <= most[child] and e + 1 < found.get(child, 99):
                            found[child] = e + 1
                            todo.append((child, e + 1))
            return frozenset(found.items())

        def step(state: frozenset, c: str | None) -> frozenset:
            found: dict[int, int] = {}
            for node, e in state:
                for letter, child in children[node].items():
                    f = e if letter == c else e + 1
                    if f <= most[child]:
                        found[child] = min(f, found.get(child, 99))
                if node in whole and e <= self.reach[ends[node]]:
                    found[node] = min(e, found.get(node, 99))
                elif e + 1 <= most[node]:  # a letter too many
                    found[node] = min(e + 1, found.get(node, 99))
            return close(found)

        self.letters = sorted({c for t in self.terms for c in t})
        place = {c: i for i, c in enumerate(self.letters)}
        start = close({0: 0})
        states = {frozenset(): 0, start: 1}
        rows, todo = {}, [start]
        while todo:
            s = todo.pop()
            near = {letter for node, _ in s for letter in children[node]}  # any other letter does what an unknown one does
            row = {}
            for c in [None, *near]:
                t = step(s, c)
                if t not in states:
                    states[t] = len(states)
                    todo.append(t)
                row[c] = states[t]
            rows[states[s]] = row
        n = len(states)
        self.step = np.zeros((n, len(self.letters) + 1), np.int32)
        self.term, self.edits = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        for s, i in states.items():
            if i:
                self.step[i] = rows[i][None]
                for c, t in rows[i].items():
                    if c is not None:
                        self.step[i, place[c]] = t
            hits = [(e, ends[node]) for node, e in s if node in ends and e <= self.reach[ends[node]]]
            if hits:
                self.edits[i], self.term[i] = min(hits)

    @cached_property
    def column(self) -> np.ndarray:
        """The column of each code point in the table."""
        out = np.full(0x110000, len(self.letters), np.int16)
        out[[ord(c) for c in self.letters]] = np.arange(len(self.letters))
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "column"}

    def run(self, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The state after each token of letter classes, all tokens stepped together; tokens leave as they die."""
        state = np.zeros(len(starts), np.int32)
        live = np.flatnonzero(ends > starts)
        at, now = starts[live], np.ones(len(live), np.int32)
        while len(live):
            now = self.step[now, letters[at]]
            at = at + 1
            over = at >= ends[live]
            done = over & (now > 0)
            state[live[done]] = now[done]
            on = ~over & (now > 0)
            live, at, now = live[on], at[on], now[on]
        return state

    def match(self, tokens: list[str]) -> list[tuple[int, int]]:
        """(edits, term) of each token, or (-1, -1): as score_block() does it."""
        if not tokens:
            return []
        flat = "".join(tokens)
        size = np.array([len(t) for t in tokens])
        ends = np.cumsum(size)
        edits, term = hits_of(self, np.frombuffer(flat.encode("utf-32-le"), np.uint32).astype(np.int64), ends - size, ends)
        return list(zip(edits.tolist(), term.tolist()))


def hits_of(auto: Automaton, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits, term) of each span of code points, -1 for none: its letters as they are, or without accents if that is nearer."""
    kind, small, plain = _characters()
    column = auto.column
    inside = kind[points] == 2
    at = np.concatenate([[0], np.cumsum(inside)])
    letters = points[inside]
    state = auto.run(column[small[letters]], at[starts], at[ends])
    edits, term = auto.edits[state], auto.term[state]
    high = np.concatenate([[0], np.cumsum(small[letters] != plain[letters])])
    accented = np.flatnonzero(high[at[ends]] > high[at[starts]])
    if len(accented):
        other = auto.run(column[plain[letters]], at[starts[accented]], at[ends[accented]])
        e, t = auto.edits[other], auto.term[other]
        better = (e >= 0) & ((edits[accented] < 0) | (e < edits[accented]) | ((e == edits[accented]) & (t < term[accented])))
        edits[accented[better]], term[accented[better]] = e[better], t[better]
    return edits, term


def bare(token: str) -> str:
    """A token's letters and digits, small."""
    return "".join(c.lower()[0] for c in token if c.isalnum())


def score_block(auto: Automaton, buf: np.ndarray, off: np.ndarray, window: int = WINDOW) -> dict[int, list]:
    """{document: [score, hits, misspelled, quoted, terms]} for documents with hits."""
    kind, _, _ = _characters()
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    starts, ends, toff = K.runs(kind[points], lead[off], np.array([False, True, True]))
    edits, term = hits_of(auto, points, starts, ends)
    hits = np.flatnonzero(edits >= 0)
    word = lambda i: points[starts[i] : ends[i]].astype(np.uint32).tobytes().decode("utf-32-le")
    found: dict[int, list] = {}
    for i, d in zip(hits.tolist(), (np.searchsorted(toff, hits, "right") - 1).tolist()):
        e = int(edits[i])
        if e and bare(word(i)) in auto.known:
            continue
        lo, hi = max(toff[d], i - window), min(toff[d + 1], i + window + 1)
        near = [word(j) for j in range(lo, hi)]
        mid = i - lo
        plain = [bare(t) for t in near]
        quoted = any(c in QUOTES for t in near[: mid + 1] for c in t) and any(c in QUOTES for t in near[mid:] for c in t)
        reported = any(b in REPORTING for b in plain[:mid])
        addressed = any(b in ADDRESS for b in plain)
        row = found.setdefault(d, [0, 0, 0, 0, set()])
        row[0] += POINTS[e][1 if quoted or reported else 2 if addressed else 0]
        row[1] += 1
        row[2] += e > 0
        row[3] += quoted or reported
        row[4].add(auto.terms[term[i]])
    return found


def cover(clean: dict[str, int], toxic: dict[str, list[int]], scale: float = 1.0) -> list[str]:
    """Stems, one after another that of the most toxic documents without one yet; of stems that begin alike the longest within a twentieth of it."""
    names = sorted(p for p, d in toxic.items() if len(d) >= SUPPORT and len(d) >= PRECISION * (len(d) + scale * clean.get(p, 0)))
    if not names:
        return []
    which = np.repeat(np.arange(len(names)), [len(toxic[p]) for p in names])
    _, doc = np.unique(np.concatenate([np.array(toxic[p]) for p in names]), return_inverse=True)
    open_ = np.ones(doc.max() + 1, bool)
    out: list[str] = []
    while True:
        gain = np.bincount(which[open_[doc]], minlength=len(names))
        best = int(gain.argmax())  # of equal ones the first in the alphabet, which is the shortest of those that begin alike
        if gain[best] < GAIN:
            return out
        i = best
        for j in range(best + 1, len(names)):
            if not names[j].startswith(names[best]):
                break
            if gain[j] >= 0.95 * gain[best] and len(names[j]) > len(names[i]):
                i = j
        out.append(names[i])
        open_[doc[which == i]] = False


def fit(docs: DataFrame, labels: DataFrame, words=LEXICON, sample: int = SAMPLE) -> Lexicon:
    """The lexicon with the stems that labelled documents call toxic, and the near misses that clean ones use.

    ``labels`` has ``doc_id`` and ``toxic``.  At most ``sample`` documents of
    either class are read, the first by the hash of their id; equal texts count
    once.  Their distinct stems are counted in Spark, and a greedy cover of the
    toxic documents picks those that are at least ``PRECISION`` toxic by the
    shares of both classes.  A word within reach of a term, but not equal to
    it, that two clean documents have is a known word.  Null ids, texts and
    labels are left out; an id with both labels in the sample is toxic.
    """
    spark = docs.sparkSession
    plain, at = numbered(labels)
    rows = plain.select(F.col(at["doc_id"]).cast("bigint").alias("doc_id"), (F.col(at["toxic"]).cast("int") > 0).alias("toxic")).where("doc_id is not null and toxic is not null")
    total = {r.toxic: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not total.get(True):
        return Lexicon(tuple(words))
    chosen: dict[int, bool] = {}
    for t in (False, True):
        chosen |= {r[0]: t for r in rows.where(F.col("toxic") == t).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    picked = spark.createDataFrame(sorted(chosen.items()), "_id bigint, toxic boolean")  # at most two samples of ids
    found = texts(docs).join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "text", "toxic")
    auto = Automaton(Lexicon(tuple(words), (), frozenset()))
    shared = spark.sparkContext.broadcast(auto)

    def count(batches):
        auto = shared.value
        for batch in batches:
            clean: dict[str, int] = {}
            toxic: dict[str, list[int]] = {}
            for i, text, bad in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ws = {w for w in _WORD.findall(text.lower())}
                for p in {w[:k] for w in ws for k in range(STEM[0], min(STEM[1], len(w)) + 1)}:
                    if bad:
                        toxic.setdefault(p, []).append(i)
                    else:
                        clean[p] = clean.get(p, 0) + 1
                if not bad:
                    ws = sorted({bare(w) for w in ws})
                    for w, (e, _) in zip(ws, auto.match(ws)):
                        if e > 0:
                            clean["=" + w] = clean.get("=" + w, 0) + 1
            keys = [*toxic, *(p for p in clean if p not in toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([clean.get(p, 0) for p in keys], pa.int64()), pa.array([toxic.get(p, []) for p in keys], pa.list_(pa.int64()))], ["stem", "clean", "toxic"])

    counted = found.mapInArrow(K.tidy(count), "stem string, clean bigint, toxic array<bigint>").groupBy("stem").agg(F.sum("clean").alias("clean"), F.flatten(F.collect_list("toxic")).alias("toxic"))
    weight = {t: total.get(t, 0) / max(1, min(total.get(t, 0), sample)) for t in (False, True)}
    scale, bad = weight[False] / weight[True], F.size("toxic")
    counted = counted.where((F.col("stem").startswith("=") & (F.col("clean") >= 2)) | ((bad >= SUPPORT) & (bad >= PRECISION * (bad + scale * F.col("clean"))))).toArrow()  # what cover() may take
    clean, toxic, known = {}, {}, set(KNOWN)
    for p, n, d in zip(*(counted[c].to_pylist() for c in ("stem", "clean", "toxic"))):
        if p[0] == "=":
            known.add(p[1:])
        else:
            clean[p], toxic[p] = n, d
    return Lexicon(tuple(words), tuple(cover(clean, toxic, scale)), frozenset(known))


def toxicity(docs: DataFrame, labels: DataFrame | None = None, lexicon: Lexicon | tuple = LEXICON, threshold: int = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """The toxic documents: (doc_id, score, n_hits, n_misspelled, n_quoted, terms).

    A token between white space or dashes, without its punctuation, hits the
    lexicon if the automaton accepts its letters, as they are or without
    accents, and it is no known word.  With ``labels`` the lexicon is fitted
    first (``fit``).  Points fall with the edits; within ``window`` tokens on
    either side, quotation marks on both sides or a verb of reporting before
    it cut them to a quarter, an address to the reader raises them by half.  A
    document is listed if its points reach ``threshold``, so one insult that
    isn't quoted is enough, with one letter wrong too.

    Null, empty and wordless texts have no hits and aren't listed, an empty
    table gives an empty result, and a row that is there twice is listed twice.
    Of terms equally near the first in the alphabet counts.  Texts of any
    length are read whole.  Columns beside ``doc_id`` and ``text`` are ignored,
    whatever their names.  One map over the texts, and one more to fit: no
    shuffle but of the bounded sample.
    """
    if labels is not None:
        lexicon = fit(docs, labels, lexicon.words if isinstance(lexicon, Lexicon) else lexicon)
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(lexicon))  # as large as the lexicon

    def score(batches):
        auto = shared.value
        for batch in batches:
            ids, _ = K.ids_of(batch.column(0))
            out: list[tuple] = []
            for lo, _, buf, off in K.blocks(*K.text_buffers(batch.column(1))):
                out += [(int(ids[lo + d]), *r[:4], sorted(r[4])) for d, r in score_block(auto, buf, off, window).items() if r[0] >= threshold]
            names = ["doc_id", "score", "n_hits", "n_misspelled", "n_quoted", "terms"]
            kinds = [pa.int64()] * 5 + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return texts(docs).mapInArrow(K.tidy(score), SCHEMA)

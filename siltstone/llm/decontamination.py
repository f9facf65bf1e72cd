"""Benchmark decontamination: latent semantic retrieval, then longest common subsequences and answers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import kernels as K
from siltstone.llm.docs import numbered, texts, without

#: Dimensions of the latent space, and more that the sketch of the range has.
RANK, OVERSAMPLING, POWER = 256, 16, 2
#: Words of the passages that items are cut into, and of the windows over documents (each for items at least so long).
PASSAGE = 64
SCALES = (1, 2, 4, 8, 16, 32)
#: Least cosine of a candidate window over words of the benchmark, as a share of what the latent space keeps of the item.  A window of
#: 32 words, an eighth of it off the passage, that has half of a passage of 64 words has 0.31 of words of equal weight, if all its
#: other words are of the benchmark too; words that aren't don't count, so that no corpus is too large.
COSINE = 0.3
#: Least share of an item's words in order: alone, and together with the answer.
COPIED, PARAPHRASED, ANSWERED = 0.75, 0.5, 0.75
#: Words whose running sums are held at once.
CHUNK = 2048
#: Words of benchmark items that are sent to the executors at once; more items are searched slice by slice.
SLICE_WORDS = 400_000
SCHEMA = "doc_id bigint, item_id bigint, start_word bigint, end_word bigint, cosine double, common_share double, answer_share double, kind string"


def folded(text: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Word hashes of one text, and the word range of its answer: what follows the last end of a sentence or line before its last word."""
    raw = np.frombuffer(text.encode(), np.uint8)
    h, s, _, _ = K.words(raw, np.array([0, len(raw)]))
    cut = [m.end() for m in re.finditer(rb"[.?!:\n]+\s*", raw.tobytes()) if len(s) and m.end() <= s[-1]]
    return h, [(int(np.searchsorted(s, cut[-1])) if cut else 0, len(h))]


@dataclass
class Slice:
    """What executors need of some items: vocabulary, weights, latent vectors, and the items' words."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[tuple[int, int]]
    owner: np.ndarray  # item of each passage
    scale: np.ndarray  # window size of each passage
    passages: list[np.ndarray]
    vocab: np.ndarray
    idf: np.ndarray | None = None
    most: np.ndarray | None = None  # most that each word adds to the square of a passage's length
    basis: np.ndarray | None = None
    latent: np.ndarray | None = None  # unit vectors of passages
    length: np.ndarray | None = None  # of each passage, by its weights
    kept: np.ndarray | None = None  # share of it that the latent space keeps

    def table(self) -> tuple[np.ndarray, bool, dict[int, np.ndarray]]:
        """(row of each word: its weight times its latent coordinates or, if passages are fewer than those, times its products with all passages by scale; which of the two; columns or passages of each scale)."""
        if "_table" not in self.__dict__:
            rows = self.basis * self.idf[:, None].astype(np.float32)
            self.order = np.argsort(self.scale, kind="stable")
            few = len(self.scale) <= self.basis.shape[1]
            scale = self.scale[self.order] if few else self.scale
            of = {k: np.flatnonzero(scale == k) for k in set(self.scale.tolist())}
            self.__dict__["_table"] = np.ascontiguousarray(rows @ self.latent[self.order].T) if few else rows, few, of
        return self.__dict__["_table"]

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Places in the vocabulary, -1 outside it."""
        quick = self.__dict__.get("_quick")
        if quick is None:
            quick = np.zeros(1 << 16, bool)
            quick[(self.vocab & K.U64(0xFFFF)).astype(np.int64)] = True
            self.__dict__["_quick"] = quick
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(quick[(h & K.U64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.vocab, h[maybe])
        at[at == len(self.vocab)] = 0
        right = self.vocab[at] == h[maybe]
        out[maybe[right]] = at[right]
        return out


def slices(items: list[tuple[int, str]], most: int = SLICE_WORDS) -> Iterator[Slice]:
    """Items in slices of at most ``most`` words; items without words are left out."""
    got: list = []
    size = 0
    for i, text in [*items, (None, None)]:
        h, answer = folded(text) if i is not None else (None, None)
        if got and (i is None or size + len(h) > most):
            own, scale, passages = [], [], []
            for k, (_, w, _) in enumerate(got):
                for at in range(0, max(1, len(w) - PASSAGE // 2), PASSAGE // 2):
                    p = w[at : at + PASSAGE]
                    own.append(k)
                    passages.append(p)
                    scale.append(max(s for s in SCALES if s <= len(p)))
            yield Slice([g[0] for g in got], [g[1] for g in got], [g[2] for g in got], np.array(own), np.array(scale), passages, np.unique(np.concatenate([g[1] for g in got])))
            got, size = [], 0
        if i is not None and len(h):
            got.append((i, h, answer[0]))
            size += len(h)


def document_frequencies(docs: DataFrame, part: Slice) -> tuple[np.ndarray, int]:
    """(in how many documents each word of the vocabulary is, number of documents), over all documents; what comes to the driver is as large as the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(part)

    def count(batches):
        s = shared.value
        df, n = np.zeros(len(s.vocab), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, buf, off in K.blocks(*K.text_buffers(batch.column(1))):
                h, _, _, woff = K.words(buf, off)
                at = s.look_up(h)
                doc = np.repeat(np.arange(len(off) - 1), np.diff(woff))[at >= 0]
                df += np.bincount(np.unique(doc * len(s.vocab) + at[at >= 0]) % len(s.vocab), minlength=len(s.vocab))
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(on, -1)), pa.array(np.append(df[on], n))], ["word", "n"])

    got = texts(docs).mapInArrow(K.tidy(count), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(len(part.vocab), np.int64), 0
    for word, c in got:
        if word < 0:
            n = c
        else:
            df[word] = c
    return df, n


def rows_of(part: Slice, which) -> np.ndarray:
    """TF-IDF rows of some passages."""
    out = np.zeros((len(which), len(part.vocab)), np.float32)
    for r, k in enumerate(which):
        np.add.at(out[r], np.searchsorted(part.vocab, part.passages[k]), 1)
    return out * part.idf.astype(np.float32)


def randomized_svd(spark, part: Slice, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """Right singular vectors of the passages' TF-IDF matrix, (words, rank), by randomised subspace iteration.

    The matrix's rows are spread over tasks, which return products of words
    times sketch, summed by Spark; only the orthogonalisation of that narrow
    matrix is on the driver.
    """
    n, m = len(part.passages), len(part.vocab)
    width = min(rank + OVERSAMPLING, n, m)
    q = np.random.default_rng(seed).standard_normal((m, width)).astype(np.float32)
    if width < rank + OVERSAMPLING:  # a small matrix: its whole row space, by random combinations of all rows
        width = min(n, m)
    shared = spark.sparkContext.broadcast(part)
    parts = max(1, min(n // 64, 256))

    def product(q: np.ndarray, gram: bool) -> np.ndarray:
        sent = spark.sparkContext.broadcast(q)
        shape = (q.shape[1], q.shape[1]) if gram else q.shape
        step = max(1, (1 << 20) // shape[1])  # matrix rows of a result row

        def run(batches):
            s, q = shared.value, sent.value
            total = np.zeros(shape, np.float64)
            for batch in batches:
                which = batch.column(0).to_numpy()
                for i in range(0, len(which), 64):
                    a = rows_of(s, which[i : i + 64])
                    y = a @ q
                    total += y.T @ y if gram else a.T @ y
            at = list(range(0, shape[0], step))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([total[i : i + step].tobytes() for i in at], pa.binary())], ["at", "part"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(b) for b in table["part"].to_pylist())
            return pa.table([table["at"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["at", "part"])

        rows = spark.range(0, n, 1, parts).mapInArrow(K.tidy(run), "at int, part binary").groupBy("at").applyInArrow(add, "at int, part binary").collect()
        sent.destroy()
        return np.concatenate([np.frombuffer(r.part).reshape(-1, shape[1]) for r in sorted(rows, key=lambda r: r["at"])])

    for _ in range(POWER):
        q = np.linalg.qr(product(q, False))[0].astype(np.float32)
    values, vectors = np.linalg.eigh(product(q, True))
    keep = [i for i in np.argsort(-values)[:rank] if values[i] > 1e-6 * max(values.max(), 1e-30)]
    return np.ascontiguousarray((q @ vectors[:, keep]).astype(np.float32))


def prepare(docs: DataFrame, part: Slice, rank: int = RANK) -> Slice:
    """The slice with weights from all documents and its latent space."""
    df, n = document_frequencies(docs, part)
    part.idf = np.log((n + 1.0) / (df + 0.5)).clip(0.05)
    part.basis = randomized_svd(docs.sparkSession, part, rank)
    latent, whole, most = [], [], np.zeros(len(part.vocab), np.float32)
    for i in range(0, len(part.passages), 256):
        a = rows_of(part, range(i, min(i + 256, len(part.passages))))
        latent.append(a @ part.basis)
        whole.append(np.linalg.norm(a, axis=1))
        most = np.maximum(most, (a * a).max(0))
    latent, whole = np.concatenate(latent), np.concatenate(whole)
    length = np.maximum(np.linalg.norm(latent, axis=1), 1e-12)
    part.latent, part.kept = (latent / length[:, None]).astype(np.float32), length / whole
    part.length, part.most = whole, most.astype(np.float64)
    for cached in ("_quick", "_table"):
        part.__dict__.pop(cached, None)
    return part


def windows(s: Slice, at: np.ndarray, woff: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the windows of a scale, a quarter of it apart, whose benchmark words let the cosine be reached.

    By Cauchy and Schwarz a window's cosine to a passage is at most the share of the
    passage's length that is in the window's words; words outside the vocabulary
    don't count.  A space that isn't whole has no such bound: there any word will do.
    """
    step = max(1, scale // 4)
    n = np.diff(woff)
    count = np.where(n > 0, np.maximum(1, -(-(n - scale) // step) + 1), 0)
    off = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(woff[:-1], count) + step * (np.arange(off[-1]) - np.repeat(off[:-1], count))
    end = np.minimum(start + scale, np.repeat(woff[1:], count))
    inside = np.zeros(len(at) + 1)
    np.cumsum(np.where(at >= 0, s.most[at], 0), out=inside[1:])
    whole = float(s.kept.min(initial=1.0)) > 0.999
    least = 0.99 * (COSINE * s.length[s.scale == scale].min()) ** 2 if whole else 0.0
    on = inside[end] - inside[start] > least
    return start[on], end[on]


def cosines(s: Slice, at: np.ndarray, spans: list[tuple[int, np.ndarray, np.ndarray]]):
    """Yields (scale, starts, ends, passages, cosines) of the candidates among windows and the passages of their scale, over words of the vocabulary only; spans: (scale, starts, ends).

    Running sums over the words give every window's coordinates at once, for all
    scales: those in the latent space or, where the passages are fewer, the
    products with them, which is the same by associativity.
    """
    weight = np.where(at >= 0, s.idf[at] ** 2, 0.0)
    once = np.concatenate([[0.0], np.cumsum(weight)])
    cover = np.zeros(len(at) + 1, np.int64)
    for _, start, end in spans:
        cover += np.bincount(start, minlength=len(at) + 1) - np.bincount(end, minlength=len(at) + 1)
    known = (np.cumsum(cover)[:-1] > 0) & (at >= 0)
    k = at[known]
    before = np.concatenate([[0], np.cumsum(known)])
    rows, few, of = s.table()
    longest = max(scale for scale, _, _ in spans)
    total = np.zeros((CHUNK + longest + 1, rows.shape[1]), np.float32)
    for lo in range(0, len(k), CHUNK):  # sums of a chunk stay in the cache
        part = k[lo : lo + CHUNK + longest]
        np.cumsum(rows[part], axis=0, out=total[1 : len(part) + 1])
        for scale, start, end in spans:
            i, j = np.searchsorted(before[start], (lo, lo + CHUNK))
            if i == j:
                continue
            a, b = start[i:j], end[i:j]
            mine = of[scale]
            x, y = before[a] - lo, before[b] - lo
            if few:
                c0, c1 = int(mine[0]), int(mine[-1]) + 1
                score = total[y, c0:c1]
                score -= total[x, c0:c1]
            else:
                v = total[y] - total[x]
                score = v @ s.latent[mine].T
            # words as if each stood once: no window is longer than this, so none that counts is lost
            length = np.maximum(np.sqrt(once[b] - once[a]), 1e-12).astype(np.float32)
            least = (COSINE * s.kept[s.order[mine]] if few else COSINE * s.kept[mine]).astype(np.float32)
            near = np.flatnonzero(score.max(1) >= np.float32(0.99 * least.min()) * length)
            if not len(near):
                continue
            score, a, b = score[near], a[near], b[near]
            x, y = np.nonzero(score >= 0.99 * least * length[near][:, None])
            if not len(x):
                continue
            some, back = np.unique(x, return_inverse=True)
            idx = a[some][:, None] + np.arange(scale)
            w = np.where(idx < b[some][:, None], at[np.minimum(idx, len(at) - 1)], -1)
            r, c = np.nonzero(w >= 0)
            key, times = np.unique(r * len(s.vocab) + w[r, c], return_counts=True)
            square = np.bincount(key // len(s.vocab), (times * s.idf[key % len(s.vocab)]) ** 2, len(some))
            cosine = score[x, y] / np.maximum(np.sqrt(square[back]), 1e-12)
            on = cosine >= least[y] - 1e-4
            y = mine[y[on]]
            yield scale, a[x[on]], b[x[on]], s.order[y] if few else y, cosine[on]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    place: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        if m := place.get(y):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def verdict(item: np.ndarray, answer: int, text: np.ndarray) -> tuple[float, float, str | None]:
    """(share of the item's words in order, share of the answer's, 'copy', 'paraphrase' or None)."""
    share = common(item, text) / len(item)
    if share < PARAPHRASED:
        return share, 0.0, None
    answered = common(item[answer:], text) / max(1, len(item) - answer)
    return share, answered, "copy" if share >= COPIED else "paraphrase" if answered >= ANSWERED else None


def search_block(s: Slice, buf: np.ndarray, off: np.ndarray) -> list[tuple]:
    """(document, item, first word, last word, cosine, share, answer share, kind), the best place of each pair."""
    h, _, _, woff = K.words(buf, off)
    if not len(h):
        return []
    at = s.look_up(h)
    best: dict[tuple[int, int], tuple] = {}
    near: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    spans = [(scale, *windows(s, at, woff, scale)) for scale in sorted(set(s.scale.tolist()))]
    spans = [x for x in spans if len(x[1])]
    for _, start, end, passage, score in cosines(s, at, spans) if spans else ():
        doc = np.searchsorted(woff, start, "right") - 1
        for d, p, a, b, c in zip(doc.tolist(), s.owner[passage].tolist(), start.tolist(), end.tolist(), score.tolist()):
            near.setdefault((d, p), []).append((a, b, c))
    for (d, p), places in near.items():
        item, answer = s.words[p], s.answers[p][0]
        own = set(item.tolist())
        places.sort()
        merged: list[list] = []
        for a, b, c in places:  # windows at most the item's length apart are looked at together
            if merged and a <= merged[-1][1] + len(item):
                merged[-1][1], merged[-1][2] = max(b, merged[-1][1]), max(c, merged[-1][2])
            else:
                merged.append([a, b, c])
        for a, b, c in merged:
            lo, hi = max(int(woff[d]), a - len(item)), min(int(woff[d + 1]), b + len(item))
            # in stretches of twice the item's length, an eighth of it apart, lest common words far apart add up; a stretch needs half of the item's words
            inside = list(accumulate((x in own for x in h[lo:hi].tolist()), initial=0))
            for i in range(lo, max(lo + 1, hi - len(item)), max(1, len(item) // 8)):
                j = min(i + 2 * len(item), hi)
                if inside[j - lo] - inside[i - lo] < PARAPHRASED * len(item):
                    continue
                share, answered, kind = verdict(item, answer, h[i:j])
                if kind and ((d, p) not in best or (share, answered) > best[d, p][5:7]):
                    best[d, p] = (d, p, i - int(woff[d]), j - int(woff[d]), c, share, answered, kind)
    return [best[k] for k in sorted(best)]


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """Documents that hold a benchmark item: (doc_id, item_id, start_word, end_word, cosine, common_share, answer_share, kind).

    Words are runs of letters and digits, ASCII case aside.  Items are cut into
    passages of up to 64 words, weighted by TF-IDF with frequencies counted
    over all documents, and a randomised SVD of their matrix gives the latent
    space.  Windows over each document's words, as long as the passages ask for
    and a quarter of that apart, are projected, and those whose cosine to a passage is
    high are candidates; the cosine is over words of the benchmark only.  A candidate is reported if the longest common
    subsequence of item and stretch holds 3/4 of the item's words (a copy), or
    half of them and 3/4 of the answer's (a paraphrase); the answer is the
    item's last sentence.  One row for each pair, with its best place.

    The decomposed matrix is the benchmark's, not the corpus's: a space of 256
    dimensions made of the corpus keeps what its passages have in common, such
    as language and topic, and hardly anything that tells one item from
    another.  An item as numerous as the dimensions is kept whole.

    Items without words, null ids and null texts find nothing; nor do empty
    texts; an empty benchmark or empty documents give an empty result.
    Repeated rows of a document are reported each, repeated items too; of equally
    good places the first of the smallest window size is told.  Texts of any
    length are read whole, and columns beside ids and texts are ignored,
    whatever their names, in both tables.

    Two maps over the texts for each slice of the benchmark, no shuffle of
    them; benchmarks beyond ``SLICE_WORDS`` words are searched slice by slice,
    so that what is broadcast has a bound.
    """
    spark = docs.sparkSession
    plain, at = numbered(benchmark)
    items = plain.select(F.col(at["item_id"]).cast("bigint").alias("item_id"), F.col(at["text"]).cast("string").alias("text")).where("item_id is not null and text is not null")
    out = None
    for part in slices(sorted((r[0], r[1]) for r in items.toLocalIterator())):
        shared = spark.sparkContext.broadcast(prepare(docs, part, rank))

        def search(batches, shared=shared):
            s = shared.value
            for batch in batches:
                ids, _ = K.ids_of(batch.column(0))
                rows = []
                for lo, _, buf, off in K.blocks(*K.text_buffers(batch.column(1))):
                    rows += [(int(ids[lo + r[0]]), s.ids[r[1]], *r[2:]) for r in search_block(s, buf, off)]
                kinds = [pa.int64()] * 4 + [pa.float64()] * 3 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "item_id", "start_word", "end_word", "cosine", "common_share", "answer_share", "kind"])

        found = texts(docs).mapInArrow(K.tidy(search), SCHEMA)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """docs without the documents that hold a benchmark item; rows without an id stay."""
    return without(docs, contaminated(docs, benchmark, rank).select("doc_id").distinct())

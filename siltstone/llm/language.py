"""Language ID by error-correcting output codes over byte n-grams."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import kernels as K
from siltstone.llm.docs import numbered, texts
from siltstone.llm.scratch import materialize

#: At most so many labelled documents of each language are fitted on, the first by the hash of their id; whole texts of them all.
SAMPLE = 500
BITS = 14
ORDERS = (2, 3, 4)
#: Decoding losses of the best two codewords that differ by less than this share of the best possible leave a document ambiguous.
GAP = 0.10
MIN_GRAMS = 3
SCHEMA = "doc_id bigint, lang string, n_grams bigint, gap double, ambiguous boolean, accepted boolean"

#: Letters folded to small ones; anything else ASCII ends a word.
_FOLD = np.array([b if 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 0 for b in range(256)], np.uint32)


def features(buf: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order (bucket of each n-gram, n-gram offsets by document); n-grams hold letters and at most one word end on each side."""
    if not len(buf):
        return [(np.empty(0, np.int64), np.zeros(len(off), np.int64)) for _ in ORDERS]
    c = _FOLD[buf]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] > 0) | (c[:-1] > 0)
    firsts = off[:-1][off[:-1] < len(buf)]
    keep[firsts] = c[firsts] > 0
    at = np.concatenate([[0], np.cumsum(keep)])[off]
    c = c[keep]
    out = []
    for n in ORDERS:
        if len(c) < n:
            out.append((np.empty(0, np.int64), np.zeros(len(off), np.int64)))
            continue
        h = np.zeros(len(c) - n + 1, np.uint32)
        for j in range(n):
            h = h * np.uint32(0x01000193) ^ c[j : len(c) - n + 1 + j]
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        ok = np.ones(len(h), bool)  # within one document
        for o in at[1:-1]:
            ok[max(0, o - n + 1) : o] = False
        where = np.concatenate([[0], np.cumsum(ok)])
        out.append(((h[ok] & np.uint32((1 << BITS) - 1)).astype(np.int64) + (ORDERS.index(n) << BITS), where[np.minimum(at, len(h))]))
    return out


def codewords(k: int) -> np.ndarray:
    """A codeword of +1 and -1 for each of k classes: all different splits up to five classes, else a random code of good distance."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=k) if s[0] == 1 and -1 in s]
        return np.array(splits, float).T
    rng, best = np.random.default_rng(7), None
    for _ in range(200):
        code = np.where(rng.random((k, 10 * int(np.ceil(np.log2(k))))) < 0.5, 1.0, -1.0)
        d = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
        if best is None or d > best[0]:
            best = d, code
    return best[1]


class Coder:
    """One linear classifier of n-grams for each bit of the code, and the weight of each bit for each class.

    ``counts`` is how often each language's sample has each n-gram bucket.
    Bits weigh the same until ``weigh`` has seen how often each is right.
    """

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        p = np.empty(counts.shape)
        for n in range(len(ORDERS)):  # shares within each order, smoothed
            part = slice(n << BITS, (n + 1) << BITS)
            p[:, part] = (counts[:, part] + 0.5) / (counts[:, part].sum(1, keepdims=True) + (1 << BITS) * 0.5)
        w = []
        for bit in self.code.T:
            yes, no = p[bit > 0].mean(0), p[bit < 0].mean(0) if (bit < 0).any() else p.mean(0)
            w.append(np.log(yes) - np.log(no))
        self.w = np.ascontiguousarray(np.stack(w, 1).astype(np.float32))
        self.weigh(np.zeros(self.code.shape), np.zeros(len(langs)))

    def weigh(self, right: np.ndarray, seen: np.ndarray) -> None:
        """Weights from how many of the documents seen of each language each bit told right."""
        acc = (right + 1) / (seen[:, None] + 2)
        self.weight = acc / acc.sum(1, keepdims=True)

    def margins(self, f, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(mean weight of a document's n-grams for each bit, number of n-grams)."""
        total, grams = np.zeros((n, self.w.shape[1])), np.zeros(n, np.int64)
        for idx, goff in f:
            full = goff[1:] > goff[:-1]
            if full.any():
                total[full] += np.add.reduceat(self.w[idx], goff[:-1][full], axis=0)
            grams += np.diff(goff)
        return 4 * total / np.maximum(grams, 1)[:, None], grams

    def decode(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest codeword by weighted logistic loss, gap to the second as a share of the loss of a coin's throw)."""
        loss = np.stack([(np.logaddexp(0, -margin * c) * w).sum(1) for c, w in zip(self.code, self.weight)], 1)
        order = np.sort(loss, 1)
        gap = (order[:, 1] - order[:, 0]) / np.log(2) if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return loss.argmin(1), gap


def _summed(frame: DataFrame, size: int, tell) -> dict[str, np.ndarray]:
    """Sums of tell(buf, off) over texts by language: rows (lang, text) in, one vector of ``size`` numbers a language out, added up by Spark."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lo, hi, buf, off in K.blocks(*K.text_buffers(batch.column(1))):
                for lang, rows in tell(buf, off, langs[lo:hi]):
                    total[lang] = total.get(lang, 0) + rows
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([t.astype(np.float64).tobytes() for t in total.values()], pa.binary())], ["lang", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b) for b in table["part"].to_pylist())
        return pa.table([table["lang"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["lang", "part"])

    rows = frame.mapInArrow(K.tidy(run), "lang string, part binary").groupBy("lang").applyInArrow(add, "lang string, part binary").collect()
    return {r.lang: np.frombuffer(r.part) for r in rows if len(r.part) == 8 * size}


def fit(docs: DataFrame, sample: int = SAMPLE) -> Coder | None:
    """A coder for the values of ``lang``; None if no text has one.

    Languages are those of all rows, however rare.  The sample has at most
    ``sample`` documents of each (ids and languages are ranked by the hash of
    the id, in groups that Spark limits before it shuffles), and is written to
    the shared folder.  N-grams are counted by the executors, and so is how
    often each bit is right; the driver gets a few vectors for each language.
    """
    plain, at = numbered(docs)
    if "lang" not in at:
        return None
    rows = plain.where(F.col(at["doc_id"]).isNotNull() & F.col(at["lang"]).isNotNull()).select(F.col(at["doc_id"]).cast("bigint").alias("doc_id"), F.col(at["lang"]).cast("string").alias("lang"), F.coalesce(F.col(at["text"]).cast("string"), F.lit("")).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = rows.where("text <> ''").select("doc_id", "lang").withColumn("nth", rank).where(F.col("nth") <= sample).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), "_id bigint, _lang string")  # as many rows as languages times sample
    taken = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).where("text <> ''").select("lang", "text").distinct()
    taken = materialize(taken, "labelled")
    width = len(ORDERS) << BITS

    def grams(buf, off, langs):
        for idx, goff in features(buf, off):
            n = np.diff(goff)
            for lang in set(langs.tolist()):
                yield lang, np.bincount(idx[np.repeat(langs == lang, n)], minlength=width)

    counts = _summed(taken, width, grams)
    if not counts:
        return None
    langs = sorted(counts)
    coder = Coder(langs, np.stack([counts[x] for x in langs]))
    shared = docs.sparkSession.sparkContext.broadcast(coder)
    bits = coder.code.shape[1]

    def right(buf, off, of):
        model = shared.value
        margin, _ = model.margins(features(buf, off), len(of))
        for i, lang in enumerate(model.langs):
            m = margin[of == lang]
            if len(m):
                yield lang, np.append((m * model.code[i] > 0).sum(0), len(m))

    told = _summed(taken, bits + 1, right)
    of = np.stack([told.get(x, np.zeros(bits + 1)) for x in langs])
    coder.weigh(of[:, :bits], of[:, bits])
    return coder


def identify(docs: DataFrame, coder: Coder | None = None, gap: float = GAP, sample: int = SAMPLE) -> DataFrame:
    """Every document's language: (doc_id, lang, n_grams, gap, ambiguous, accepted).

    ``ambiguous`` if the best two codewords are nearer than ``gap``, or the
    text has fewer than three n-grams of letters; then ``accepted`` is false.
    Of codewords equally near the first language in the alphabet is told, and
    the text is ambiguous.  Texts of any length are read whole; columns beside
    ``doc_id``, ``text`` and ``lang`` are ignored, whatever their names.
    Null, empty and letterless texts get a null language and are ambiguous.
    Without any labelled text nothing can be told: languages are null and
    everything is accepted.  An empty table gives an empty result; repeated
    rows are listed each.  One map over the texts: no shuffle.
    """
    coder = coder or fit(docs, sample)
    if coder is None:
        return texts(docs).select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit(0).cast("bigint").alias("n_grams"), F.lit(0.0).alias("gap"), F.lit(True).alias("ambiguous"), F.lit(True).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(coder)  # fixed size: bits of the code times n-gram buckets

    def apply(batches):
        model = shared.value
        names = np.array([*model.langs, None], object)
        for batch in batches:
            ids, _ = K.ids_of(batch.column(0))
            lang, grams, gaps = np.full(len(ids), -1), np.zeros(len(ids), np.int64), np.zeros(len(ids))
            for lo, hi, buf, off in K.blocks(*K.text_buffers(batch.column(1))):
                margin, grams[lo:hi] = model.margins(features(buf, off), hi - lo)
                lang[lo:hi], gaps[lo:hi] = model.decode(margin)
            lang[grams == 0], gaps[grams == 0] = -1, 0.0
            unsure = (grams < MIN_GRAMS) | (gaps < gap)
            gaps = np.minimum(gaps, 1e9)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(names[lang], pa.string()), pa.array(grams), pa.array(gaps), pa.array(unsure), pa.array(~unsure)], ["doc_id", "lang", "n_grams", "gap", "ambiguous", "accepted"])

    return texts(docs).mapInArrow(K.tidy(apply), SCHEMA)


def keep_identified(docs: DataFrame, gap: float = GAP, sample: int = SAMPLE) -> DataFrame:
    """docs without the documents whose language stays ambiguous; rows without an id stay.

    The verdict is found in the same pass that carries the row, so nothing is
    joined or shuffled.
    """
    coder = fit(docs, sample)
    if coder is None:
        return docs
    plain, at = numbered(docs)
    shared = docs.sparkSession.sparkContext.broadcast(coder)
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def apply(batches):
        model = shared.value
        for batch in batches:
            _, there = K.ids_of(batch.column(id_at))
            ok = ~there
            for lo, hi, buf, off in K.blocks(*K.text_buffers(batch.column(text_at))):
                margin, grams = model.margins(features(buf, off), hi - lo)
                ok[lo:hi] |= (grams >= MIN_GRAMS) & (model.decode(margin)[1] >= gap)
            yield batch.filter(pa.array(ok))

    return plain.mapInArrow(K.tidy(apply), plain.schema).toDF(*docs.columns)



"""Byte-level BPE by a pair occurrence index, and its inverse."""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import kernels as K
from siltstone.llm.docs import texts

#: A public vocabulary in the ranks format: a line of base64 bytes and a rank for each token.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of text whose distinct pieces are merged together.
SEGMENT = 4 << 20
NONE = 1 << 30
SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>, lossless boolean"


@lru_cache(1)
def _classes() -> np.ndarray:
    """Of every code point: 0 white space, 1 letter, 2 number, 3 other."""
    t = np.full(0x110000, 3, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            t[c] = 1
        elif k == "N":
            t[c] = 2
    t[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
    return t


def pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, piece offsets by document) of the pieces that merges stay within; they cover every byte.

    A piece is one of the endings 's 't 're 've 'm 'll 'd, a run of letters, of
    numbers or of other signs with one blank before it, or white space.
    """
    if not len(buf):
        return np.empty(0, np.int64), np.zeros(len(off), np.int64)
    pos = np.flatnonzero((buf & 0xC0) != 0x80)
    b = buf[pos]
    classes = _classes()
    kind = classes[:256][b]
    long = np.flatnonzero(b >= 0x80)
    if len(long):
        p, lead = pos[long], b[long].astype(np.int64)
        at = lambda j: buf[np.minimum(p + j, len(buf) - 1)].astype(np.int64) & 0x3F
        two = (lead & 0x1F) << 6 | at(1)
        three = (lead & 0x0F) << 12 | at(1) << 6 | at(2)
        four = (lead & 0x07) << 18 | at(1) << 12 | at(2) << 6 | at(3)
        kind[long] = classes[np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, np.minimum(four, 0x10FFFF)))]
    n = len(pos)
    first = np.zeros(n + 4, bool)  # documents' first characters
    first[np.searchsorted(pos, off[:-1])] = True
    first[n:] = True
    kind = np.concatenate([kind, np.zeros(4, np.uint8)])
    b = np.concatenate([b, np.zeros(4, np.uint8)])
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    solid = kind > 0
    # the last white space before a solid run stands alone, or with the run if it is a blank
    start[:-1] |= ~solid[:-1] & solid[1:] & ~first[1:]
    start[1:] &= ~(solid[1:] & (b[:-1] == 32) & ~first[1:])
    start |= first
    for i in np.flatnonzero((b[:n] == 39) & start[:n] & (kind[1 : n + 1] == 1) & ~first[1 : n + 1]).tolist():
        x = b[i + 1]
        if x in b"stmd":
            size = 2
        elif not first[i + 2] and bytes((x, b[i + 2])) in (b"re", b"ve", b"ll"):
            size = 3
        else:
            continue
        start[i + 1] = False
        start[i + size] = True
    at = pos[start[:n]]
    return at, np.searchsorted(at, off)


class Bpe:
    """A vocabulary: encodes distinct pieces all at once, decodes ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for t, r in ranks.items():
            tokens[r] = t
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.off = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        keys, values = [], []
        for t, r in ranks.items():
            for i in range(1, len(t)):
                x, y = ranks.get(t[:i]), ranks.get(t[i:])
                if x is not None and y is not None:
                    keys.append(x * self.size + y)
                    values.append(r)
        order = np.argsort(keys)
        self.keys, self.values = np.append(np.array(keys, np.int64)[order], np.int64(1) << 62), np.append(np.array(values, np.int64)[order], NONE)

    @classmethod
    def load(cls, data: bytes) -> Bpe:
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)})

    def rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair makes; NONE for pairs that make none (ids below 0 never do)."""
        key = x.astype(np.int64) * self.size + y
        key[(x < 0) | (y < 0)] = -1
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def one(self, piece: bytes) -> list[int]:
        """The same for one piece, pair by pair: the lowest rank first, of equal ones the leftmost."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            r, i = min((self.ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
            if r == NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def merge(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, id offsets by piece) of the pieces that ``off`` cuts ``buf`` into.

        The index maps each rank to all positions where a pair makes it.  Ranks
        that are active are taken in ascending order; all their positions merge
        at once, and only the pairs beside them are looked up again and entered
        in the lists of their new ranks.
        """
        n = len(buf)
        sym = np.append(self.byte[buf], np.int32(-1))
        nxt = np.arange(1, n + 2)
        nxt[n] = n
        prv = np.arange(-1, n)
        ends = off[1:][off[1:] > off[:-1]]
        nxt[ends - 1] = n
        starts = off[:-1][off[1:] > off[:-1]]
        prv[starts] = n
        prv = np.append(prv, n)
        alive = np.ones(n, bool)
        rank = self.rank(sym[:n], sym[nxt[:n]]) if n else np.empty(0, np.int64)
        rank = np.append(rank, NONE)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(r: np.ndarray, at: np.ndarray) -> None:
            on = r < NONE
            r, at = r[on], at[on]
            if not len(r):
                return
            order = np.argsort(r, kind="stable")
            r, at = r[order], at[order]
            cut = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
            for k, i, j in zip(r[cut[:-1]].tolist(), cut, cut[1:]):
                if k in index:
                    index[k].append(at[i:j])
                else:
                    index[k] = [at[i:j]]
                    heapq.heappush(heap, k)

        enter(rank, np.arange(n + 1))
        odd: list[np.ndarray] = []  # a merge made a pair of lower rank: pieces done again one by one, should it meet another place of that rank
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                chained = nxt[at[:-1]] == at[1:]
                if chained.any():  # overlapping places: every other one of a chain
                    i = np.arange(len(at))
                    head = np.concatenate([[True], ~chained])
                    at = at[(i - np.maximum.accumulate(np.where(head, i, 0))) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            beside = np.flatnonzero(after[:-1] == at[1:])  # neighbours that merge in the same step: the right one's first half would be met before
            if len(beside) and (low := self.rank(np.full(len(beside), r), sym[after[beside]]) < r).any():
                odd.append(at[beside[low]])
            sym[at] = r
            nxt[at] = after
            prv[after] = at
            alive[gone] = False
            rank[gone] = NONE
            before = prv[at]
            right = self.rank(sym[at], sym[after])
            left = self.rank(sym[before], sym[at])
            rank[at] = right
            rank[before] = left
            rank[n] = NONE
            left[before == n] = NONE
            if (low := (right < r) | (left < r)).any():
                odd.append(at[low])
            enter(np.concatenate([right, left]), np.concatenate([at, before]))
        count = np.concatenate([[0], np.cumsum(alive)])[off]
        ids = sym[:n][alive]
        if odd:
            for w in np.unique(np.searchsorted(off, np.concatenate(odd), "right") - 1).tolist():
                again = self.one(buf[off[w] : off[w + 1]].tobytes())
                if again != ids[count[w] : count[w + 1]].tolist():
                    ids = np.concatenate([ids[: count[w]], np.array(again, np.int32), ids[count[w + 1] :]])
                    count[w + 1 :] += len(again) - (count[w + 1] - count[w])
        return ids, count

    def encode(self, buf: np.ndarray, off: np.ndarray):
        """Yields (first document, last document, ids, id offsets by document, bytes, byte offsets) for blocks of documents."""
        for base, _, seg, soff in K.blocks(buf, off, SEGMENT):
            parts, hashes = [], []
            for lo, hi, b, o in K.blocks(seg, soff):
                s, woff = pieces(b, o)
                e = np.append(s[1:], len(b))[: len(s)]
                h, first, inverse = np.unique(K.span_hash(K.prefix_hash(b, K.EXACT), s, e), return_index=True, return_inverse=True)
                self._verify(b, s, e, s[first][inverse], e[first][inverse])
                parts.append((base + lo, base + hi, b, o, woff, inverse.astype(np.int32), s[first] + soff[lo], e[first] + soff[lo]))
                hashes.append(h)
            if not parts:
                continue
            h, first, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            s, e = (np.concatenate([p[i] for p in parts]) for i in (6, 7))
            self._verify(seg, s, e, s[first][inverse], e[first][inverse])
            ids, ioff = self.merge(*_gather(seg, s[first], e[first]))
            base_at = 0
            for (lo, hi, b, o, woff, inv, own, _), hs in zip(parts, hashes):
                word = inverse[base_at : base_at + len(hs)][inv]
                base_at += len(hs)
                out, per = _gather(ids, ioff[word], ioff[word + 1])
                yield lo, hi, out, per[woff], b, o

    @staticmethod
    def _verify(buf, s, e, s2, e2) -> None:
        """Equal hashes must mean equal bytes."""
        x, xo = _gather(buf, s, e)
        y, yo = _gather(buf, s2, e2)
        if not (np.array_equal(xo, yo) and np.array_equal(x, y)):
            raise ValueError("two different pieces have one 64-bit hash")

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, byte offsets by id)."""
        return _gather(self.flat, self.off[ids], self.off[ids + 1])


def _gather(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of flat one behind another, and their offsets."""
    off = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=off[1:])
    if not off[-1]:
        return flat[:0], off
    at = np.repeat(starts - off[:-1], np.diff(off))
    at += np.arange(off[-1])
    return flat[at], off


_loaded: dict[int, Bpe] = {}


def shared_vocabulary(spark: SparkSession, path: str = VOCABULARY):
    """A function for workers that returns the vocabulary; its file (fixed size, under a megabyte) is read on the driver and sent once."""
    with open(path, "rb") as f:
        data = f.read()
    sent = spark.sparkContext.broadcast(data)
    key = hash(data)

    def get() -> Bpe:
        if key not in _loaded:
            _loaded[key] = Bpe.load(sent.value)
        return _loaded[key]

    return get


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every document's token ids: (doc_id, n_tokens, ids, lossless).

    ``lossless`` tells whether decoding the ids gave back the text's bytes; it
    is computed for each document, and always true of Unicode text.  Special
    tokens have no meaning in a text.  Null and empty texts have no ids,
    repeated rows are encoded each, an empty table gives an empty result.  A
    hash collision between pieces ends the job rather than corrupt a text.

    One map over the texts.  Pieces repeat, so that only the distinct ones of
    four megabytes are merged, all together, and expanded again.
    """
    vocab = shared_vocabulary(docs.sparkSession, vocabulary)

    def run(batches):
        bpe = vocab()
        for batch in batches:
            doc_ids, _ = K.ids_of(batch.column(0))
            buf, off = K.text_buffers(batch.column(1))
            for lo, hi, ids, ioff, b, o in bpe.encode(buf, off):
                back, boff = bpe.decode(ids)
                same = np.zeros(len(b) + 1, np.int64)
                whole = len(back) == len(b)
                if whole:
                    np.cumsum(back == b, out=same[1:])
                lossless = (boff[ioff] == o)[1:] & (boff[ioff] == o)[:-1] & (same[o[1:]] - same[o[:-1]] == np.diff(o))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[lo:hi]), pa.array(np.diff(ioff)), K.list_rows(ids, ioff, pa.int32()), pa.array(lossless)], ["doc_id", "n_tokens", "ids", "lossless"])

    return texts(docs).mapInArrow(K.tidy(run), SCHEMA)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows with ``doc_id`` and ``ids``; null ids give an empty text, ids outside the vocabulary fail."""
    vocab = shared_vocabulary(encoded.sparkSession, vocabulary)

    def run(batches):
        bpe = vocab()
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ioff = np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in lists.to_pylist()])]) if lists.null_count else lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            if len(ids) and (ids.min() < 0 or ids.max() >= bpe.size):
                raise ValueError("an id is outside the vocabulary")
            out, boff = bpe.decode(ids)
            off = boff[ioff].astype(np.int32)
            text = pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(out)))
            yield pa.RecordBatch.from_arrays([batch.column(0), text], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(K.tidy(run), "doc_id bigint, text string")

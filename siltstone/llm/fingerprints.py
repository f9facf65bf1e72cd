"""Document fingerprints sensitive to edit distance: order MinHash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm import kernels as K
from siltstone.llm.docs import texts

#: Words of a k-mer, hash functions, k-mers kept for each.
KMER, FUNCTIONS, KEPT = 3, 16, 3
SCHEMA = "doc_id bigint, n_kmers bigint, signature array<bigint>"


def occurrences(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How often each element stood in its document before."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    at = np.arange(len(h))
    out = np.empty(len(h), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def order_minhash(h: np.ndarray, off: np.ndarray, m: int = FUNCTIONS, kept: int = KEPT) -> np.ndarray:
    """m hashes for each document: of its ``kept`` k-mers of least hash, numbered by occurrence, in the order of the text.

    Places ride in the low bits of the hashes, so that a minimum of a segment
    also tells where it is.
    """
    n = np.diff(off)
    size = len(off) - 1
    out = np.zeros((size, m), K.U64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    starts = off[:-1][full]
    bits = max(24, int(n.max()).bit_length())
    low = K.U64((1 << bits) - 1)
    place = (np.arange(len(h)) - np.repeat(off[:-1], n)).astype(K.U64)
    numbered = K.mix(h + occurrences(h, off).astype(K.U64) * K.U64(0x9E3779B97F4A7C15))
    none = K.U64((1 << 64) - 1)
    for j in range(m):
        g = (K.mix(numbered ^ K.mix(np.array([j + 1], K.U64))) & ~low) | place
        picked = np.empty((kept, len(full)), np.int64)
        for i in range(kept):
            least = np.minimum.reduceat(g, starts)
            there = least != none
            picked[i] = np.where(there, (least & low).astype(np.int64), -1)
            g[(starts + picked[i])[there]] = none
        picked.sort(0)
        code = np.full(len(full), j + 1, K.U64)
        for i in range(kept):
            x = h[np.maximum(starts + picked[i], 0)]
            code = np.where(picked[i] >= 0, K.mix(code * K.U64(0x9E3779B97F4A7C15) + x), code)
        out[full, j] = code
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint: (doc_id, n_kmers, signature of 16 hashes).

    Words (ASCII case and punctuation don't count) form k-mers of three; equal
    ones are told apart by their number of occurrence.  For each of 16 hash
    functions the three k-mers of least hash, put back into the order of the
    text, make one hash.  The share of equal hashes falls with the edit
    distance, and moving a passage costs, which it wouldn't in MinHash.

    A text of fewer words has one k-mer of them all, one of fewer than three
    k-mers uses what it has.  Null, empty and wordless texts have an empty
    signature; repeated rows are listed each; an empty table gives an empty
    result.  One map over the texts: no shuffle.
    """

    def run(batches):
        for batch in batches:
            ids, _ = K.ids_of(batch.column(0))
            for lo, hi, buf, off in K.blocks(*K.text_buffers(batch.column(1))):
                h, _, _, woff = K.words(buf, off)
                g, goff = K.grams(h, woff, KMER)
                sig = order_minhash(g, goff)
                n = np.diff(goff)
                soff = np.concatenate([[0], np.cumsum(np.where(n > 0, FUNCTIONS, 0))])
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), pa.array(n), K.list_rows(sig[n > 0].reshape(-1).view(np.int64), soff, pa.int64())], ["doc_id", "n_kmers", "signature"])

    return texts(docs).mapInArrow(K.tidy(run), SCHEMA)

"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, and maximal removal intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from siltstone.llm import kernels as K
from siltstone.llm.docs import texts

#: Tokens of a window; a repeated passage of at least so many is found.
WINDOW = 50
#: Bytes of input for each bucket, which is counted in one worker's memory (about ten times so much).
BUCKET = 16 << 20

_R = K.U64(0xC2B2AE3D27D4EB4F | 1)
_RINV = K.U64(pow(int(_R), -1, 1 << 64))
_PART = "bucket int, hashes binary, docs binary, places binary"
_FOUND = "doc_id bigint, later boolean, places binary"
SCHEMA = "doc_id bigint, start_token bigint, end_token bigint, n_tokens bigint, removed boolean"


def window_hashes(h: np.ndarray, toff: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of all windows of w tokens inside documents, from prefix sums; (hashes, offsets by document)."""
    n = np.maximum(np.diff(toff) - w + 1, 0)
    woff = np.concatenate([[0], np.cumsum(n)])
    if not woff[-1]:
        return np.empty(0, K.U64), woff
    power = np.full(len(h) + 1, _R, K.U64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    prefix = np.zeros(len(h) + 1, K.U64)
    np.cumsum(h * power[:-1], out=prefix[1:])
    back = np.full(len(h) + 1, _RINV, K.U64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    at = np.arange(woff[-1]) + np.repeat(toff[:-1] - woff[:-1], n)
    return K.mix((prefix[at + w] - prefix[at]) * back[at]), woff


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _spread(w: int, buckets: int):
    """Texts to one row for each bucket of hashes: the hashes as they are, ids and places packed."""

    def rows_of(held):
        h, d, p = (np.concatenate(x) for x in zip(*held))
        b = (h % K.U64(buckets)).astype(np.uint16 if buckets <= 65536 else np.int32)
        order = np.argsort(b, kind="stable")
        h, d, p, b = h[order], d[order], p[order], b[order]
        cut = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]])
        rows = [(int(b[i]), h[i:j].tobytes(), _pack(d[i:j]), _pack(np.diff(p[i:j], prepend=np.uint32(0)))) for i, j in zip(cut[:-1], cut[1:])]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], ["bucket", "hashes", "docs", "places"])

    def run(batches):
        held, size = [], 0
        most = min(1 << 24, max(1 << 20, 32 * buckets))  # so that a row has windows enough
        for batch in batches:
            ids, _ = K.ids_of(batch.column(0))
            for lo, hi, buf, off in K.blocks(*K.text_buffers(batch.column(1))):
                h, _, _, toff = K.words(buf, off, K.SOLID, K.EXACT)
                g, woff = window_hashes(h, toff, w)
                if len(g):
                    n = np.diff(woff)
                    held.append((g, np.repeat(ids[lo:hi], n), (np.arange(len(g)) - np.repeat(woff[:-1], n)).astype(np.uint32)))
                    size += len(g)
                if size > most:
                    yield rows_of(held)
                    held, size = [], 0
        if held:
            yield rows_of(held)

    return run


def _count(table: pa.Table) -> pa.Table:
    """The repeated windows of a bucket: a row for each document and for first and later occurrences, with their places."""
    h = np.concatenate([np.frombuffer(x, K.U64) for x in table["hashes"].to_pylist()])
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    chosen, h = order[twice], s[twice]
    del s, same, order, twice
    d = np.concatenate([_unpack(x, np.int64) for x in table["docs"].to_pylist()])[chosen]
    p = np.concatenate([np.cumsum(_unpack(x, np.uint32), dtype=np.uint32) for x in table["places"].to_pylist()])[chosen]
    order = np.lexsort((p, d, h))
    h, d, p = h[order], d[order], p[order]
    if len(h):  # a row that is there twice is one document
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1])
        h, d, p = h[once], d[once], p[once]
    later = np.zeros(len(h), bool)
    later[1:] = h[1:] == h[:-1]
    twice = later.copy()
    twice[:-1] |= later[1:]
    d, p, later = d[twice], p[twice], later[twice]
    order = np.lexsort((p, later, d))
    d, p, later = d[order], p[order], later[order]
    cut = np.concatenate([[0], np.flatnonzero((d[1:] != d[:-1]) | (later[1:] != later[:-1])) + 1, [len(d)]]) if len(d) else np.zeros(1, np.int64)
    at = cut[:-1]
    return pa.table([pa.array(d[at]), pa.array(later[at]), pa.array([p[i:j].tobytes() for i, j in zip(at, cut[1:])], pa.binary())], ["doc_id", "later", "places"])


def _merge(w: int):
    """Rows sorted by document to maximal intervals; a document's rows may reach over batches."""

    def flush(rows):
        d, later, places = zip(*rows)
        n = np.array([len(x) // 4 for x in places])
        p = np.frombuffer(b"".join(places), np.uint32).astype(np.int64)
        d, later = np.repeat(np.array(d), n), np.repeat(np.array(later), n)
        order = np.lexsort((p, later, d))
        d, later, p = d[order], later[order], p[order]
        new = np.ones(len(p), bool)
        new[1:] = (d[1:] != d[:-1]) | (later[1:] != later[:-1]) | (p[1:] > p[:-1] + w)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:] - 1, [len(p) - 1]])
        start, end = p[first], p[last] + w
        return pa.RecordBatch.from_arrays([pa.array(d[first]), pa.array(start), pa.array(end), pa.array(end - start), pa.array(later[first])], ["doc_id", "start_token", "end_token", "n_tokens", "removed"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            held += rows
            if len(held) > 20_000 and held[-1][0] != held[0][0]:
                stay = next(i for i in range(len(held) - 1, -1, -1) if held[i][0] != held[-1][0]) + 1
                yield flush(held[:stay])
                held = held[stay:]
        if held:
            yield flush(held)

    return run


def _bytes_of(docs: DataFrame) -> int:
    """The optimizer's estimate of the input's size, at most 64 TB: joins before this can make it absurd."""
    return min(int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 1 << 46)


def repeats(docs: DataFrame, window: int = WINDOW, groups: int | None = None) -> DataFrame:
    """Passages of ``window`` or more tokens that are there more than once: (doc_id, start_token, end_token, n_tokens, removed).

    Tokens are maximal runs without white space, compared byte for byte.  Every
    window of ``window`` tokens is hashed; the first occurrence of a hash, by
    document id and place, is kept and all later ones are to go.  Overlapping
    and touching windows of a document merge: rows with ``removed`` are the
    maximal intervals to cut (half open, in token numbers), the others those
    that stay though repeated elsewhere.  Repeats inside one document count.

    Texts shorter than a window, empty and null ones have no rows.  Rows that
    repeat an id and its text are one document; texts that share an id without
    being equal have their intervals together.  An empty table gives an empty
    result.

    Windows travel once, about nine bytes each: a map task sends one packed row
    to each of ``groups`` buckets of hashes, which are counted there with numpy;
    by default there are as many as shuffle partitions, and more if the input
    is larger than 16 MB for each.
    Buckets are by hash, so that a passage with thousands of copies adds to
    each of its windows' buckets alike; only repeated windows are sent back to
    be merged by document.
    """
    spark = docs.sparkSession
    plain = texts(docs)
    n = groups or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_bytes_of(docs) // BUCKET))
    parts = plain.mapInArrow(K.tidy(_spread(window, n)), _PART)
    found = parts.groupBy("bucket").applyInArrow(_count, _FOUND)
    by_doc = found.repartition("doc_id").sortWithinPartitions("doc_id")
    return by_doc.mapInArrow(K.tidy(_merge(window)), SCHEMA)


ORACLE = rf"""
WITH toks AS (SELECT DISTINCT doc_id, regexp_extract_all(text, '[^ \t\n\r\x0b\x0c]+') AS t FROM documents WHERE doc_id IS NOT NULL),
wins AS (SELECT doc_id, unnest(range(0, len(t) - {WINDOW} + 1)) AS p, t FROM toks WHERE len(t) >= {WINDOW}),
keyed AS (SELECT doc_id, p, md5(array_to_string(t[p + 1:p + {WINDOW}], ' ')) AS k FROM wins),
seen AS (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1 AS removed FROM keyed),
gaps AS (SELECT doc_id, p, removed, CASE WHEN p <= lag(p) OVER w + {WINDOW} THEN 0 ELSE 1 END AS new FROM seen WHERE n > 1 WINDOW w AS (PARTITION BY doc_id, removed ORDER BY p)),
isles AS (SELECT doc_id, p, removed, sum(new) OVER (PARTITION BY doc_id, removed ORDER BY p) AS isle FROM gaps)
SELECT doc_id, min(p)::BIGINT AS start_token, (max(p) + {WINDOW})::BIGINT AS end_token, (max(p) + {WINDOW} - min(p))::BIGINT AS n_tokens, removed
FROM isles GROUP BY doc_id, removed, isle"""

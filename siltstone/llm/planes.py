"""Token ids as bit or byte planes, each compressed, with an index of the chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import kernels as K
from siltstone.llm.bpe import VOCABULARY, shared_vocabulary
from siltstone.llm.docs import texts

#: Ids of a block.
BLOCK_IDS = 1 << 16
LEVEL = 3
_INDEX = "array<struct<plane:int,start:bigint,length:bigint>>"
SCHEMA = f"shard int, block int, n_ids bigint, width int, mode string, doc_ids array<bigint>, doc_starts array<bigint>, doc_lengths array<bigint>, chunks {_INDEX}, payload binary"


def shuffle(ids: np.ndarray, width: int, mode: str = "bit") -> list[bytes]:
    """The planes of ids of ``width`` bits, least significant first: one bit, or one byte, of every id."""
    if mode == "bit":
        return [np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes() for b in range(width)]
    return [(ids >> (8 * b) & 0xFF).astype(np.uint8).tobytes() for b in range((width + 7) // 8)]


def unshuffle(planes: list[bytes], n: int, mode: str = "bit") -> np.ndarray:
    """The ids back."""
    out = np.zeros(n, np.int64)
    for b, plane in enumerate(planes):
        part = np.frombuffer(plane, np.uint8)
        if mode == "bit":
            out |= np.unpackbits(part, count=n, bitorder="little").astype(np.int64) << b
        else:
            out |= part.astype(np.int64) << (8 * b)
    return out


def compress(planes: list[bytes], level: int = LEVEL) -> tuple[list[tuple[int, int, int]], bytes]:
    """(index of (plane, start, length), payload)."""
    zip_ = zstandard.ZstdCompressor(level=level)
    index, out, at = [], [], 0
    for i, p in enumerate(planes):
        c = zip_.compress(p)
        index.append((i, at, len(c)))
        out.append(c)
        at += len(c)
    return index, b"".join(out)


def _rows(blocks, width: int, mode: str, shard: int, first: int) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(10)]
    for i, (ids, docs) in enumerate(blocks):
        index, payload = compress(shuffle(ids, width, mode))
        for c, v in zip(cols, (shard, first + i, len(ids), width, mode, [d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs], [{"plane": a, "start": b, "length": n} for a, b, n in index], payload)):
            c.append(v)
    chunk = pa.list_(pa.struct([("plane", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), *[pa.list_(pa.int64())] * 3, chunk, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["shard", "block", "n_ids", "width", "mode", "doc_ids", "doc_starts", "doc_lengths", "chunks", "payload"])


def write_planes(docs: DataFrame, vocabulary: str = VOCABULARY, mode: str = "bit", block_ids: int = BLOCK_IDS) -> DataFrame:
    """All texts as token ids in compressed planes: one row for each block of ``block_ids`` ids (the last of a shard may have fewer).

    (shard, block, n_ids, width, mode, doc_ids, doc_starts, doc_lengths, chunks, payload)

    A task's documents form one stream of ids, a shard.  A block is transposed
    into bit planes (``mode='bit'``) or byte planes (``'byte'``), and each
    plane is a zstandard frame of its own in ``payload``; ``chunks`` tells
    where, so that a reader takes the planes it needs.  ``doc_starts`` are
    places in the shard of the documents that begin in the block; a document
    may go on in the next.  Write the result to Parquet to keep it.

    Null and empty texts are documents of no ids.  Repeated rows are stored
    each; an empty table gives an empty result.  One map over the texts: no
    shuffle, and no block is larger than its size, however long the texts are.
    """
    if mode not in ("bit", "byte"):
        raise ValueError("mode is 'bit' or 'byte'")
    vocab = shared_vocabulary(docs.sparkSession, vocabulary)

    def run(batches):
        bpe = vocab()
        width = max(1, (bpe.size - 1).bit_length())
        shard = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        starts: list[tuple[int, int, int]] = []  # (doc_id, place in the shard, ids)
        size = at = done = 0
        for batch in batches:
            doc_ids, _ = K.ids_of(batch.column(0))
            for lo, hi, ids, ioff, _, _ in bpe.encode(*K.text_buffers(batch.column(1))):
                held.append(ids)
                starts += zip(doc_ids[lo:hi].tolist(), (at + ioff[:-1]).tolist(), np.diff(ioff).tolist())
                size += len(ids)
                at += len(ids)
                if size >= 16 * block_ids:
                    flat = np.concatenate(held)
                    n = size // block_ids
                    yield _rows(_cut(flat[: n * block_ids], starts, done, block_ids), width, mode, shard, done)
                    starts = [s for s in starts if s[1] >= (done + n) * block_ids]
                    done += n
                    held, size = [flat[n * block_ids :].copy()], size - n * block_ids
        if size or starts:
            yield _rows(_cut(np.concatenate(held), starts, done, block_ids), width, mode, shard, done)

    return texts(docs).mapInArrow(K.tidy(run), SCHEMA)


def _cut(flat: np.ndarray, starts, done: int, block_ids: int):
    n = max(1, -(-len(flat) // block_ids))
    docs: list[list] = [[] for _ in range(n)]
    for s in starts:
        b = s[1] // block_ids - done
        if b < n:
            docs[b].append(s)
        elif s[1] == done * block_ids + len(flat) and s[2] == 0 and len(flat) % block_ids == 0:
            docs[n - 1].append(s)
    return [(flat[i * block_ids : (i + 1) * block_ids], docs[i]) for i in range(n)]


def read_planes(blocks: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids): the documents of a shard out of its blocks, each exactly as it was encoded.

    A shard is put together in one group: it is as large as one task's input
    was when it was written.
    """

    def restore(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["block", "n_ids", "mode", "doc_ids", "doc_starts", "doc_lengths", "chunks", "payload"]).to_pylist(), key=lambda r: r["block"])
        unzip = zstandard.ZstdDecompressor()
        flat = [np.empty(0, np.int64)]
        for r in rows:
            planes = [unzip.decompress(r["payload"][c["start"] : c["start"] + c["length"]]) for c in r["chunks"]]
            flat.append(unshuffle(planes, r["n_ids"], r["mode"]))
        ids = np.concatenate(flat)
        docs = [d for r in rows for d in zip(r["doc_ids"], r["doc_starts"], r["doc_lengths"])]
        return pa.table([pa.array([d[0] for d in docs], pa.int64()), pa.array([d[2] for d in docs], pa.int64()), pa.array([ids[s : s + n].astype(np.int32) for _, s, n in docs], pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    return blocks.groupBy(F.col("shard")).applyInArrow(restore, "doc_id bigint, n_tokens bigint, ids array<int>")

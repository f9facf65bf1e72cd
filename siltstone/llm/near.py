"""Near-duplicate documents: DartMinHash signatures, banded joining, connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import kernels as K
from siltstone.llm.docs import texts, without
from siltstone.llm.scratch import materialize

#: Words of a shingle; a shingle's weight is how often it occurs.
SHINGLE = 3
#: Bands and rows: two documents of weighted Jaccard similarity 0.5 share a band and pass the estimate with probability 0.92, of 0.55 with 0.98.
BANDS, ROWS = 42, 4
SIMILARITY = 0.5
#: Estimates are from 168 coordinates; so much below the threshold is accepted, two standard deviations.
SLACK = 0.08
#: Darts of a stretch of rank, and elements that are sketched at once.
CELL, ELEMENTS = 4.0, 1 << 19

_SKETCH = "doc_id bigint, n bigint, whole bigint, sig binary, bands array<bigint>"
SCHEMA = "doc_id bigint, group_id bigint, group_size bigint, keep boolean"


def weigh(h: np.ndarray, goff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each document: (element, weight, document)."""
    out = [], [], []
    step = 1 << 20
    for lo in range(0, len(goff) - 1, step):  # 20 bits of document, 44 of element
        hi = min(lo + step, len(goff) - 1)
        doc = np.repeat(np.arange(hi - lo, dtype=K.U64), np.diff(goff[lo : hi + 1]))
        key = np.sort((doc << K.U64(44)) | (h[goff[lo] : goff[hi]] >> K.U64(20)))
        if len(key):
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            out[0].append(key[at] & K.U64((1 << 44) - 1))
            out[1].append(np.diff(np.append(at, len(key))).astype(np.float64))
            out[2].append((key[at] >> K.U64(44)).astype(np.int64) + lo)
    if not out[0]:
        return np.empty(0, K.U64), np.empty(0), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in out)


def dart_minhash(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n: int, k: int, seed: int = 1) -> np.ndarray:
    """k coordinates for each of n weighted sets, equal in two sets with the probability of their weighted Jaccard similarity.

    Each element's weight axis is cut into the regions [0, 1), [1, 2), [2, 4),
    ...  Darts fall on a region in order of rank, at a rate of its width, each
    at a hashed weight; those under the element's weight count.  A set needs
    about k ln k + 2k darts, so that its ranks end at that number over its
    total weight: elements of heavy sets mostly cost one hash.  A dart's hash
    names a coordinate, and the earliest dart of each coordinate is kept.  Sets
    that leave a coordinate empty get twice the darts.
    """
    sig = np.zeros((n, k), K.U64)
    total = np.bincount(doc, weight, n)
    darts = k * math.log(k) + 2 * k
    todo = np.flatnonzero(total > 0)
    pick = np.ones(len(doc), bool)
    while len(todo):
        row = np.full(n, -1, np.int64)
        row[todo] = np.arange(len(todo))
        best = np.full(len(todo) * k, np.inf)
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        e0, w0, r0 = element[pick], weight[pick], row[doc[pick]]
        limit0 = (darts / total[todo])[r0]
        light = bool((w0 < 1).any())
        region, low, width = 0, 0.0, 1.0
        while len(e0):
            # The process of a region's darts is cut into stretches of rank that hold CELL darts on average; they are independent, so all go at once.
            cells = np.ceil(limit0 * (width / CELL)).astype(np.int64)
            each = np.repeat(np.arange(len(e0)), cells)
            cell = np.arange(len(each)) - np.repeat(np.cumsum(cells) - cells, cells)
            state = K.mix(K.mix((e0 + K.U64(region << 44 | seed << 52)) * K.U64(0x9E3779B97F4A7C15))[each] + cell.astype(K.U64) * K.U64(0xD6E8FEB86659FD93))
            rank = cell * (CELL / width)
            last = np.minimum(rank + CELL / width, limit0[each])
            while len(state):
                state = K.mix(state + K.U64(0x9E3779B97F4A7C15))
                rank = rank - np.log(K.unit(state)) / width
                on = np.flatnonzero(rank < last)
                state, rank, last, each = state[on], rank[on], last[on], each[on]
                place = K.mix(state ^ K.U64(0xA0761D6478BD642F))
                slot = r0[each] * k + (((place >> K.U64(40)) * K.U64(k)) >> K.U64(24)).astype(np.int64)
                if region or light:
                    under = low + width * ((place & K.U64(0xFFFFFFFF)).astype(np.float64) / 2.0**32) < w0[each]
                    got.append((slot[under], rank[under], state[under]))
                else:  # no weight is under 1, the width of the first region
                    got.append((slot, rank, state))
                np.minimum.at(best, got[-1][0], got[-1][1])
            low, width, region = (1.0, 1.0, 1) if not region else (2.0**region, 2.0**region, region + 1)
            more = w0 > low
            e0, w0, r0, limit0 = e0[more], w0[more], r0[more], limit0[more]
        flat = np.zeros(len(todo) * k, K.U64)
        for slot, rank, state in got:
            first = rank == best[slot]
            flat[slot[first]] = state[first]
        sig[todo] = flat.reshape(-1, k)
        missing = np.isinf(best).reshape(-1, k).any(1)
        todo = todo[missing]
        again = np.zeros(n, bool)
        again[todo] = True
        pick = again[doc]
        darts *= 2
    return sig


def _sketch(batches):
    """Batches of (doc_id, text) to rows of _SKETCH; darts are thrown for many blocks at once."""
    k = BANDS * ROWS
    salt = K.mix(np.arange(1, ROWS + 1, dtype=K.U64)) | K.U64(1)
    turn = np.arange(BANDS, dtype=K.U64) * K.U64(0x9E3779B97F4A7C15)

    def rows_of(held):
        ids, whole, n = (np.concatenate([x[i] for x in held]) for i in range(3))
        first = np.cumsum([0, *(len(x[0]) for x in held[:-1])])
        e, w = (np.concatenate([x[i] for x in held]) for i in (3, 4))
        d = np.concatenate([x[5] + at for x, at in zip(held, first)])
        sig = dart_minhash(e, w, d, len(ids), k)
        band = K.mix((sig.reshape(-1, BANDS, ROWS) * salt).sum(2, dtype=K.U64) + turn)
        boff = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(n), pa.array(whole.view(np.int64)), K.binary_rows((K.mix(sig) >> K.U64(56)).astype(np.uint8), k, len(ids)), K.list_rows(band[n > 0].reshape(-1).view(np.int64), boff, pa.int64())],
            ["doc_id", "n", "whole", "sig", "bands"],
        )

    held, size = [], 0
    for batch in batches:
        ids, _ = K.ids_of(batch.column(0))
        for lo, hi, buf, off in K.blocks(*K.text_buffers(batch.column(1))):
            h, _, _, woff = K.words(buf, off)
            g, goff = K.grams(h, woff, SHINGLE)
            whole = K.span_hash(K.prefix_hash(buf, K.EXACT), off[:-1], off[1:])
            whole[np.diff(off) == 0] = 0
            held.append((ids[lo:hi], whole, np.diff(goff), *weigh(g, goff)))
            size += len(held[-1][3]) + 500 * (hi - lo)
            if size > ELEMENTS:
                yield rows_of(held)
                held, size = [], 0
    if held:
        yield rows_of(held)


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarities from bytes of signatures; unlike darts share a byte by chance, which is taken off."""
    return ((x == y).mean(-1) - 1 / 256) / (1 - 1 / 256)


def forest(sig: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of pairs at least so similar.

    Grows each component from its first member: whoever has joined is compared
    with those who haven't, so that copies of one text cost one comparison
    each, and only members that are alike to nobody meet all others.
    """
    edges: list[tuple[int, int]] = []
    rest = np.arange(len(sig))
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            if len(front) <= len(rest):
                f, front = front[0], front[1:]
                hit = estimate(sig[rest], sig[f]) >= least
                edges += [(int(r), int(f)) for r in rest[hit]]
                front, rest = np.append(front, rest[hit]), rest[~hit]
            else:
                hit = np.zeros(len(rest), bool)
                for i, r in enumerate(rest):
                    alike = np.flatnonzero(estimate(sig[front], sig[r]) >= least)
                    if len(alike):
                        hit[i] = True
                        edges.append((int(r), int(front[alike[0]])))
                front, rest = rest[hit], rest[~hit]
    return edges


def _buckets(least: float):
    """Rows (band, doc_id, sig) sorted by band to edges; a bucket may reach over batches."""

    def solve(band, doc, sig):
        first = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
        size = np.diff(np.append(first, len(band)))
        lead = np.repeat(first, size)
        alike = estimate(sig, sig[lead]) >= least
        a, b = doc[alike], doc[lead[alike]]
        more: list[tuple[int, int]] = []
        for at in np.unique(lead[~alike]).tolist():
            n = int(size[np.searchsorted(first, at)])
            more += [(int(doc[at + i]), int(doc[at + j])) for i, j in forest(sig[at : at + n], least)]
        if more:
            a, b = np.append(a, [x for x, _ in more]), np.append(b, [y for _, y in more])
        on = a != b
        pairs = np.unique(np.stack([np.maximum(a, b)[on], np.minimum(a, b)[on]]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def run(batches):
        k = BANDS * ROWS
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            col = batch.column(2)
            off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(-1, k)))
            if held[-1][0][-1] != held[0][0][0]:
                band, doc, sig = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(band, band[-1])) if band[0] <= band[-1] else len(band)
                if cut:
                    yield solve(band[:cut], doc[:cut], sig[:cut])
                held = [(band[cut:].copy(), doc[cut:].copy(), sig[cut:].copy())]
        if held and len(held[0][0]):
            yield solve(*(np.concatenate(x) for x in zip(*held)))

    return run


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): connected components of (a, b) rows, each named by its least node, by alternating large and small stars.

    Every round is written to the shared folder.  The rounds grow with the
    logarithm of the longest chain, and a component of any size never gathers
    in one row.
    """
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = materialize(both, name)
    before = None
    while True:
        # large star: every larger neighbour of a node goes to the node's least neighbour, itself included
        sym = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: every smaller neighbour goes to the least one
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        now = materialize(small, name)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Groups of near or exact copies: (doc_id, group_id, group_size, keep), a row for each member of a group of two or more documents.

    Similarity is the weighted Jaccard similarity of shingles of three words
    (ASCII case and punctuation don't count), estimated by DartMinHash.  A
    group is a connected component; its least id names it and is kept.

    Texts without words are copies only of equal texts; empty and null texts
    are in no group.  Rows that repeat one id are one document and no group by
    themselves.  An empty table gives an empty result.

    One pass over the texts writes 168 bytes of signature and the band hashes
    of each document.  Equal signatures are collapsed first, so that thousands
    of exact copies meet in one aggregation.  Band hashes are counted without
    signatures, and only documents that share one go on.  A bucket's members
    are compared with its first, all buckets at once; where that leaves some
    out, the bucket's components are grown (``forest``).  No bucket is capped.
    """
    sketches = materialize(texts(docs).mapInArrow(K.tidy(_sketch), _SKETCH).where("whole <> 0 or n > 0"), "sketch")

    # Equal signatures, or equal texts where there are no words: one node, named by its least id.
    some = F.col("n") > 0
    keyed = sketches.select("doc_id", F.when(some, F.xxhash64("sig", "n")).otherwise(F.col("whole")).alias("k1"), F.when(some, F.xxhash64(F.lit(1), "sig", "n")).otherwise(0).alias("k2"))
    firsts = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last"))
    exact = keyed.join(firsts.where("node <> last"), ["k1", "k2"]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    nodes = firsts.select("node")

    signed = materialize(sketches.join(nodes, sketches["doc_id"] == nodes["node"], "left_semi").where("n > 0").groupBy("doc_id").agg(F.min_by(F.struct("sig", "bands"), "sig").alias("s")).select("doc_id", "s.sig", "s.bands"), "nodes")
    rows = signed.select("doc_id", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("band")
    members = rows.join(shared, "band").join(signed.select("doc_id", "sig"), "doc_id").select("band", "doc_id", "sig")
    alike = members.repartition("band").sortWithinPartitions("band").mapInArrow(K.tidy(_buckets(similarity - SLACK)), "a bigint, b bigint")
    joined = exact.union(alike)
    found = components(joined, "edges")
    sizes = found.groupBy("root").agg((F.count("*") + 1).alias("group_size"))
    members = found.union(sizes.select("root", F.col("root").alias("root2")))
    return members.join(sizes, "root").select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"), F.col("group_size").cast("bigint"), (F.col("node") == F.col("root")).alias("keep"))


def keep_first_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the near copies: of each group the document of least id stays, as do rows without an id."""
    return without(docs, near_duplicates(docs, similarity).where("not keep").select("doc_id"))

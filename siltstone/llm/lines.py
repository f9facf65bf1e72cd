"""Line dedup: shared lines, made rare by runs of them, find overlapping documents, and patience diff aligns them."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import kernels as K
from siltstone.llm.docs import numbered, texts
from siltstone.llm.scratch import materialize

#: A line of fewer bytes counts along with the lines behind it, as many as make up so many bytes.
MIN_BYTES = 20

_LINES = "doc_id bigint, line int, stop int, h bigint"
SCHEMA = "doc_id bigint, source_doc_id bigint, start_line int, end_line int, n_lines int"
_FOUND = SCHEMA + ", h bigint"


def anchors(buf: np.ndarray, off: np.ndarray, least: int):
    """(document, first line, end line, hash) of the shortest run from each line on that has ``least`` bytes without its line feeds, and of each document's last one together with the shorter lines behind it."""
    full = np.flatnonzero(off[1:] > off[:-1])
    breaks = np.flatnonzero(buf == 10)
    s = np.sort(np.concatenate([off[full], breaks + 1]))
    e = np.sort(np.concatenate([breaks, off[full + 1]]))
    count = np.zeros(len(off) - 1, np.int64)
    count[full] = 1
    count += np.bincount(np.searchsorted(off, breaks, "right") - 1, minlength=len(count))
    loff = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(count)), count)
    size = np.concatenate([[0], np.cumsum(e - s)])
    last = np.searchsorted(size, size[:-1] + least) - 1
    first = np.flatnonzero(last < loff[doc + 1])
    last = last[first]
    ends = np.flatnonzero(np.append(doc[first][1:] != doc[first][:-1], True)) if len(first) else first
    ends = ends[last[ends] + 1 < loff[doc[first[ends]] + 1]]
    first, last = np.concatenate([first, first[ends]]), np.concatenate([last, loff[doc[first[ends]] + 1] - 1])
    h = K.span_hash(K.prefix_hash(buf, K.EXACT), s[first], e[last])
    return doc[first], first - loff[doc[first]], last + 1 - loff[doc[first]], h


def _scan(least: int):
    def run(batches):
        for batch in batches:
            ids, _ = K.ids_of(batch.column(0))
            for lo, hi, buf, off in K.blocks(*K.text_buffers(batch.column(1))):
                d, line, stop, h = anchors(buf, off, least)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][d]), pa.array(line.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(h.view(np.int64))], ["doc_id", "line", "stop", "h"])

    return run


def _runs(batches):
    """Rows (doc_id, lines, stops, hashes) of a document's repeated lines to (hash, level, doc_id, place) of all runs of 1, 2, 4, 8 ... of them."""
    for batch in batches:
        ids, _ = K.ids_of(batch.column(0))
        lists = batch.column(3)
        h = lists.flatten().to_numpy(zero_copy_only=False).view(K.U64)
        loff = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        n = np.diff(loff)
        doc, place, end = np.repeat(ids, n), np.arange(len(h)) - np.repeat(loff[:-1], n), np.repeat(loff[1:], n)
        at, level = np.arange(len(h)), 0
        while len(at):
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.full(len(at), level, np.int32)), pa.array(doc[at]), pa.array(place[at].astype(np.int32))], ["rh", "level", "doc_id", "place"])
            step = 1 << level
            at = at[at + 2 * step <= end[at]]
            longer = h.copy()
            longer[at] = K.mix(h[at] * K.U64(0xD6E8FEB86659FD93) + h[at + step] + K.U64(level + 1))
            h, level = longer, level + 1


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of two sequences: equal ends first, then lines that are in each just once and rise in both, and so on between them."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        there: dict = {}
        for n in range(i, j):
            there[a[n]] = -1 if a[n] in there else n
        other: dict = {}
        for n in range(k, m):
            other[b[n]] = -1 if b[n] in other else n
        pairs = [(n, other[x]) for x, n in there.items() if n >= 0 and other.get(x, -1) >= 0]
        tops: list[int] = []
        chain: list[int] = []
        back: list[int] = [-1] * len(pairs)
        for n, (_, y) in enumerate(pairs):
            at = bisect_left(tops, y)
            back[n] = chain[at - 1] if at else -1
            tops[at : at + 1] = [y]
            chain[at : at + 1] = [n]
        n = chain[-1] if chain else -1
        end = (j, m)
        if n < 0:
            continue
        while n >= 0:
            x, y = pairs[n]
            todo.append((x + 1, end[0], y + 1, end[1]))
            out.append((x, y))
            end, n = (x, y), back[n]
        todo.append((i, end[0], k, end[1]))
    return sorted(out)


def ranges_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open ranges, sorted."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _fill(into: dict[int, int], skip: dict[int, int], at: int, values: list[int], first: int, n: int) -> None:
    """into[at + i] = values[first + i] for i < n where nothing is yet; ``skip`` leads from a filled place to the next that may be empty."""
    i = at
    while i < at + n:
        if i in into:
            seen = []
            while i in into:
                seen.append(i)
                i = skip[i]
            for j in seen:
                skip[j] = i
        else:
            into[i] = values[first + i - at]
            skip[i] = i + 1
            i += 1


def align(doc: int, spans: list[tuple[int, int]], h: list[int], rows: dict[int, list[tuple[int, list, list]]]) -> list[tuple]:
    """Rows of _FOUND of one document: spans and hashes of its repeated lines, and by source (level, my places, their places) of the runs that it was the first to have.

    Blocks to delete, and with a hash the lines that the document has once and
    that their earliest holder has in another order.
    """
    out: list[tuple] = []
    gone: set[int] = set()
    tried: dict[int, int] = {}
    for source, runs in sorted(rows.items()):
        mine: dict[int, int] = {}
        theirs: dict[int, int] = {}
        to, tt = {}, {}
        for level, at, there in sorted(runs, key=lambda r: -r[0]):
            n = 1 << level
            for p in at:
                _fill(mine, to, p, h, p, n)
                if not level:
                    tried[p] = source
            for t in there:
                _fill(theirs, tt, t, h, at[0], n)
        a, b = sorted(mine), sorted(theirs)
        hit = [a[i] for i, _ in patience([mine[p] for p in a], [theirs[t] for t in b])]
        for start, end in ranges_of([spans[p] for p in hit]):
            out.append((doc, source, start, end, end - start, None))
            gone.update(range(start, end))
    times: dict[int, int] = {}
    for x in h:
        times[x] = times.get(x, 0) + 1
    for p, source in sorted(tried.items()):
        start, end = spans[p]
        if times[h[p]] == 1 and any(n not in gone for n in range(start, end)):
            out.append((doc, source, start, end, end - start, h[p]))
    return out


def again(doc: int, source: int, rows: list[tuple[int, int, int, int]]) -> list[tuple]:
    """The same of single lines and their next earlier holder: (line, stop, hash, line there), each line once."""
    rows = sorted(rows)
    there = [h for _, h in sorted((t, h) for _, _, h, t in rows)]
    hit = {i for i, _ in patience([r[2] for r in rows], there)}
    blocks = ranges_of([rows[i][:2] for i in hit])
    gone = {n for start, end in blocks for n in range(start, end)}
    out: list[tuple] = [(doc, source, start, end, end - start, None) for start, end in blocks]
    return out + [(doc, source, start, end, end - start, h) for start, end, h, _ in rows if any(n not in gone for n in range(start, end))]


def _emit(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 2 + [pa.int32()] * 3 + [pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "source_doc_id", "start_line", "end_line", "n_lines", "h"])


def _by_key(batches, width: int, finish):
    """Rows whose first ``width`` columns are their key, sorted by it, to the rows that finish(key, rows) makes of each key's; they may reach over batches."""
    key, rows, out = None, [], []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:width] != key:
                if rows:
                    out += finish(key, rows)
                key, rows = row[:width], []
            rows.append(row[width:])
        if len(out) > 10_000:
            yield _emit(out)
            out = []
    if rows:
        out += finish(key, rows)
    yield _emit(out)


def _align(batches):
    """Rows (doc_id, source or null, level, my places, their places, lines, stops, hashes); the one without a source has the last three."""

    def finish(key, rows):
        spans, h, by = [], [], {}
        for source, level, mine, theirs, line, stop, hashes in rows:
            if source is None:
                spans, h = list(zip(line, stop)), hashes
            else:
                by.setdefault(source, []).append((level, mine, theirs))
        return align(key[0], spans, h, by) if by else []

    yield from _by_key(batches, 1, finish)


def _again(batches):
    """Rows (doc_id, source, line, stop, hash, line there)."""
    yield from _by_key(batches, 2, lambda key, rows: again(*key, rows))


def common_blocks(docs: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """Blocks of lines to delete: (doc_id, source_doc_id, start_line, end_line, n_lines), lines counted from 0, ranges half open.

    Lines end at a line feed.  A line of ``least`` bytes is hashed alone, a
    shorter or empty one with as many lines behind it as make up so many.  Of
    these hashes the repeated ones stay, and runs of 1, 2, 4, 8 ... of them, one
    behind another in a document, are hashed in turn: however frequent a line
    is, it is rare within a run.  Each run pairs every document that has it
    with the earliest, by id, so that there are no more pairs than runs,
    whether two documents have it or millions.  A pair is aligned by patience
    diff over the lines of the runs that it shares; aligned lines go from the
    later document.  A line that a document has once, and that its earliest
    holder has in another order, is aligned with its next earlier holder, and
    so on, until it is gone or has no earlier holder left; each round settles
    at least one line of each pair, so that there are no more rounds than
    lines of a document that cross each other.

    Lines repeated inside one document go as far as a patience diff aligns
    them.  Null and empty texts have no lines; repeated rows of one id are one
    document, texts that share an id without being equal are taken together.
    An empty table gives an empty result; a text of any length is read whole.
    Blocks of two sources may overlap.

    The texts are read once, to a narrow table of lines; only repeated lines
    and their runs go further.
    """
    lines = materialize(texts(docs).mapInArrow(K.tidy(_scan(least)), _LINES), "lines")
    shared = lines.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("h")
    repeated = materialize(lines.join(shared, "h").distinct(), "repeated")
    one = F.sort_array(F.collect_list(F.struct("line", "stop", "h")))
    documents = materialize(repeated.groupBy("doc_id").agg(one.alias("at")).select("doc_id", "at.line", "at.stop", "at.h"), "documents")
    runs = materialize(documents.mapInArrow(K.tidy(_runs), "rh bigint, level int, doc_id bigint, place int"), "runs")
    first = runs.groupBy("rh", "level").agg(F.min("doc_id").alias("src"), F.max("doc_id").alias("last")).where("src <> last").select("rh", "level", "src")
    held = materialize(runs.join(first, ["rh", "level"]).groupBy("rh", "level", "src", "doc_id").agg(F.sort_array(F.collect_list("place")).alias("at")), "held")
    source = held.where("doc_id = src").select("rh", "level", F.col("at").alias("theirs"))
    pairs = held.where("doc_id <> src").join(source, ["rh", "level"]).select("doc_id", "src", "level", F.col("at").alias("mine"), "theirs", *(F.lit(None).cast(t).alias(n) for n, t in (("line", "array<int>"), ("stop", "array<int>"), ("h", "array<bigint>"))))
    whole = documents.select("doc_id", *(F.lit(None).cast(t).alias(n) for n, t in (("src", "bigint"), ("level", "int"), ("mine", "array<int>"), ("theirs", "array<int>"))), "line", "stop", "h")
    found = materialize(pairs.union(whole).repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(K.tidy(_align), _FOUND), "found")
    out = found.where("h is null")
    while not (left := found.where("h is not null")).isEmpty():
        held_by = repeated.select("h", F.col("doc_id").alias("holder"), F.col("line").alias("there"))
        after = held_by.join(left.select("h", F.col("source_doc_id").alias("tried")).distinct(), "h").where("holder > tried").groupBy("h", "tried").agg(F.min(F.struct("holder", "there")).alias("next"))
        todo = left.select("doc_id", "h", F.col("source_doc_id").alias("tried"), "start_line", "end_line").join(after, ["h", "tried"]).where("next.holder < doc_id")
        todo = todo.select("doc_id", F.col("next.holder").alias("src"), "start_line", "end_line", "h", "next.there")
        found = materialize(todo.repartition("doc_id").sortWithinPartitions("doc_id", "src").mapInArrow(K.tidy(_again), _FOUND), "again")
        out = out.union(found.where("h is null"))
    return out.drop("h")


def without_common_blocks(docs: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """docs with the common blocks deleted; ``n_chars``, where there is one, follows the text.

    A document of which nothing but white space is left goes.  Others, those
    without text or id among them, stay, unchanged if they have no block.
    """
    blocks = common_blocks(docs, least).groupBy("doc_id").agg(F.collect_set(F.struct("start_line", "end_line")).alias("_blocks")).withColumnRenamed("doc_id", "_id")
    plain, at = numbered(docs)
    text = F.col(at["text"]).cast("string")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.exists("_blocks", lambda b: (i >= b["start_line"]) & (i < b["end_line"]))), "\n")
    joined = plain.join(blocks, plain[at["doc_id"]] == blocks["_id"], "left").withColumn("_new", F.when(F.col("_blocks").isNotNull(), kept))
    joined = joined.where(F.col("_blocks").isNull() | F.col("_new").rlike(r"\S"))
    out = []
    for given, name in zip(docs.columns, plain.columns):
        c = F.col(name)
        if name == at["text"]:
            c = F.coalesce("_new", text)
        elif name == at.get("n_chars"):
            c = F.coalesce(F.length("_new").cast(plain.schema[name].dataType), c)
        out.append(c.alias(name))
    return joined.select(*out).toDF(*docs.columns)

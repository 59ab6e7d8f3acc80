"""Suffix-array deduplication of byte strings of `LENGTH` bytes, exact, over all documents.

A byte is removed when a LENGTH-byte string that covers it also starts earlier: in a document with a smaller
id, or in the same document at a smaller offset. Sorting the suffixes of every byte would move each byte a
hundred times, so suffixes are pruned first, without loss:

1. Anchors. Each window of LENGTH bytes has the K-byte string with the least hash in it as its anchor, so equal
   windows have equal anchors at equal offsets. An anchor serves a run of windows; the bytes of the run are its
   context. About one byte in 35 is an anchor.
2. Anchors meet by hash (packed blocks; a task first merges its own). Of equal contexts the earliest stays, the
   others are removed whole. An anchor string with one context only needs no more work.
3. What is left are anchors that stand in different contexts: the edges of copies. Sampled splitters
   range-partition these suffixes by their leading K bytes; each bucket expands the windows they serve and sorts
   them by multikey quicksort, eight bytes a key, equal keys going on to the next one. Neighbours that agree in
   LENGTH bytes are equal windows, and all but the earliest are removed. Equal leads never straddle a splitter;
   a lead with more than `HOT` contexts is cut into blocks by window offset (windows of different offsets can't
   be equal), and in a block the lead is the digest of all the bytes that its windows have in common, 97 of 100, so
   contexts stay together only where they agree in these. So the boundary of blocks needs no comparison either, and
   a hot lead goes to as many buckets as it has texts around it. (The multikey quicksort runs breadth first: a round
   sorts all groups by their next eight bytes.)
4. Spans meet their documents again by id and the remaining bytes are read off.

Cases: null and empty texts and texts shorter than LENGTH lose nothing; a null doc_id counts as the smallest;
rows that share a doc_id are told apart by their text, and of windows that start at the same offset of the
same doc_id none is earlier, so that exact repeats of a row are all judged alike. Documents of any length are
whole. Other columns are ignored (dedup) or kept (keep_rest). Rows are dealt by id and text together, so rows without
an id, or many with one, don't meet in one task. The number of partitions follows the bytes of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import _BASE_INV, arrow_rows, covered, mix, parts_and_files, powers, prefix_hash, slices, spread, stored, utf8, word_hash

LENGTH, K = 100, 32
HOT, HOT_OFFSETS = 1000, 4
_FLUSH, _PIECE = 1 << 19, 1 << 19
_ANCHOR = np.dtype([("f", "<u4"), ("ctx", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("pos", "<u4"), ("lo", "u1"), ("hi", "u1")])
_SPAN = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("end", "<u4")])
_REQUEST = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("pos", "<u4"), ("lo", "u1"), ("hi", "u1"), ("block", "u1")])
ANCHORS, SPANS, REQUESTS = 0, 1, 2
_BLOCK_SQL = "kind int, part int, block binary"
_BLOCK = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.binary())])
_NO_ID = -(1 << 63)


def _blocks(kind: int, part: np.ndarray, records: np.ndarray):
    """Records packed by part."""
    if not len(records):
        return
    order = np.argsort(part, kind="stable")
    part, records = part[order], records[order]
    edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    yield pa.RecordBatch.from_arrays(
        [pa.array([kind] * (len(edges) - 1), pa.int32()), pa.array(part[edges[:-1]], pa.int32()), pa.array([records[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], schema=_BLOCK
    )


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive keys, by doubling."""
    out, have = keys, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def anchors(data: np.ndarray, offsets: np.ndarray, piece: int = _PIECE) -> tuple[np.ndarray, ...]:
    """(document index, anchor position, first and last served window start, hash, context hash); positions in data.

    A piece of window starts at a time, so memory follows the piece and not the longest text; a run of windows that a piece's
    end cuts is two runs."""
    out = []
    for a in range(0, len(data), piece):
        stop = min(a + piece + LENGTH - 1, len(data))
        first = int(np.searchsorted(offsets, a, side="right")) - 1
        last = int(np.searchsorted(offsets, stop, side="left"))
        found = _anchors(data[a:stop], np.clip(offsets[first : last + 1], a, stop) - a)
        out.append((found[0] + first, *(x + a for x in found[1:4]), *found[4:]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else _anchors(data, offsets)


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchors of one piece."""
    n = len(data)
    if n < LENGTH or np.diff(offsets).max() < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    prefix = prefix_hash(data)
    h = mix((prefix[K:] - prefix[:-K]) * powers(n + 1, _BASE_INV)[: n - K + 1])
    keys = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    least = (_sliding_min(keys, LENGTH - K + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - LENGTH + 1, 0))
    starts = spread(offsets[:-1], np.maximum(np.diff(offsets) - LENGTH + 1, 0))  # window starts inside one document
    at = least[starts]
    head = np.flatnonzero(np.diff(at, prepend=-1))
    tail = np.append(head[1:], len(at)) - 1
    at, first, last = at[head], starts[head], starts[tail]
    context = mix(word_hash(data, first, last + LENGTH, long=2 * LENGTH) + ((at - first) * 256 + (at - last)).astype(np.uint64))
    return doc[head], at, first, last, h[at], context


def _sorted_classes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors by (f, ctx, doc, pos, tag); flags of the first of each class; index of each one's class head."""
    a = a[np.lexsort((a["tag"], a["pos"], a["doc"], a["ctx"], a["f"]))]
    first = np.ones(len(a), bool)
    first[1:] = (a["f"][1:] != a["f"][:-1]) | (a["ctx"][1:] != a["ctx"][:-1])
    return a, first, np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))


def _after(a: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Flags of the anchors that come strictly after the head of their class."""
    return (a["doc"] > a["doc"][head]) | (a["pos"] > a["pos"][head])


def _earliest(a: np.ndarray, first: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Flags of the anchors that no other of their class precedes: its head, and one for each other text that has its id and place."""
    fresh = first.copy()
    fresh[1:] |= a["tag"][1:] != a["tag"][:-1]
    return fresh & ~_after(a, head)


def _later_spans(a: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Spans of the anchors that come strictly after the head of their class."""
    b = a[_after(a, head)]
    out = np.zeros(len(b), _SPAN)
    out["doc"], out["tag"], out["start"], out["end"] = b["doc"], b["tag"], b["pos"] - b["lo"], b["pos"] - b["hi"].astype(np.int64) + LENGTH
    return merged(out)


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans of each document, overlapping and touching ones joined."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["tag"], spans["doc"]))]
    fresh = np.ones(len(spans), bool)
    fresh[1:] = (spans["doc"][1:] != spans["doc"][:-1]) | (spans["tag"][1:] != spans["tag"][:-1])
    # running maximum of ends inside a document: shift documents apart
    group = np.cumsum(fresh) - 1
    reach = np.maximum.accumulate(spans["end"].astype(np.int64) + group * (1 << 33)) - group * (1 << 33)
    fresh[1:] |= spans["start"][1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    out = spans[at].copy()
    out["end"] = np.maximum.reduceat(spans["end"], at)
    return out


_TEXT_SEED = 42  # the seed of Spark's xxhash64, so that both sides compute one number


def _tags(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """32 bits that tell rows with one doc_id apart by their text."""
    raw = memoryview(np.ascontiguousarray(data))
    return np.array([xxhash.xxh64_intdigest(raw[a:b], _TEXT_SEED) >> 32 for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint32)


def _doc_part(doc: np.ndarray, tag: np.ndarray, parts: int) -> np.ndarray:
    return (doc + tag.astype(np.int64)) % parts


def _part_column(parts: int) -> Column:
    """_doc_part of a row of documents."""
    tag = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 32)
    return F.pmod(F.expr(f"coalesce(doc_id, {_NO_ID + 1}L - 1L)") + tag, F.lit(parts)).cast("int")


def find_anchors(docs: DataFrame, parts: int) -> DataFrame:
    """Packed anchors of all documents, and the spans that a task could already tell."""

    def run(batches):
        held, size = [], 0

        def flush():
            a, first, head = _sorted_classes(np.concatenate(held))
            yield from _spans_out(_later_spans(a, head), parts)
            # anchors equal in id, text and place stand for repeats of one row; one of them is enough
            a = a[_earliest(a, first, head)]
            yield from _blocks(ANCHORS, a["f"].astype(np.int64) % parts, a)

        for batch in slices(batches, limit=_PIECE):
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
            doc, at, first, last, h, context = anchors(data, offsets)
            tags = _tags(data, offsets)
            a = np.zeros(len(at), _ANCHOR)
            a["f"], a["ctx"], a["doc"], a["tag"] = (h >> np.uint64(16)).astype(np.uint32), context, ids[doc], tags[doc]
            a["pos"], a["lo"], a["hi"] = at - offsets[doc], at - first, at - last
            held.append(a)
            size += len(a)
            if size >= _FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return docs.mapInArrow(run, _BLOCK_SQL)


def _spans_out(spans: np.ndarray, parts: int):
    yield from _blocks(SPANS, _doc_part(spans["doc"], spans["tag"], parts), spans)


def match_anchors(blocks: DataFrame, parts: int) -> DataFrame:
    """Spans of repeated contexts, and requests for the contexts that differ."""

    def run(batches):
        held, now = [], None

        def settle():
            a, first, head = _sorted_classes(np.concatenate([np.frombuffer(b, _ANCHOR) for b in held]))
            yield from _spans_out(_later_spans(a, head), parts)
            stay = _earliest(a, first, head)
            c, first = a[stay], first[stay]
            group = np.cumsum(np.diff(c["f"].astype(np.int64), prepend=-1) != 0) - 1
            differ = np.bincount(group, first)[group] > 1
            c, hot = c[differ], (np.bincount(group)[group] > HOT)[differ]
            plain, parted = c[~hot], c[hot]
            # hot leads: a request for each block of offsets an anchor serves
            low, high = parted["hi"] // HOT_OFFSETS, parted["lo"] // HOT_OFFSETS
            n = (high - low + 1).astype(np.int64)
            row = np.repeat(np.arange(len(parted)), n)
            block = spread(low.astype(np.int64), n)
            out = np.zeros(len(plain) + len(row), _REQUEST)
            for k in ("doc", "tag", "pos"):
                out[k] = np.concatenate([plain[k], parted[k][row]])
            out["lo"] = np.concatenate([plain["lo"], np.minimum(parted["lo"][row], block * HOT_OFFSETS + HOT_OFFSETS - 1).astype(np.uint8)])
            out["hi"] = np.concatenate([plain["hi"], np.maximum(parted["hi"][row], block * HOT_OFFSETS).astype(np.uint8)])
            out["block"] = np.concatenate([np.zeros(len(plain), np.uint8), (block + 1).astype(np.uint8)])
            yield from _blocks(REQUESTS, _doc_part(out["doc"], out["tag"], parts), out)

        for batch in batches:
            for kind, part, block in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if kind == SPANS:
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([block], pa.binary())], schema=_BLOCK)
                    continue
                if part != now:
                    if held:
                        yield from settle()
                    held, now = [], part
                held.append(block)
        if held:
            yield from settle()

    return blocks.repartition(parts, "kind", "part").sortWithinPartitions("kind", "part").mapInArrow(run, _BLOCK_SQL)


def meet(docs: DataFrame, blocks: DataFrame, parts: int, record: np.dtype, each: Callable, schema, extra: tuple[str, ...] = ()) -> DataFrame:
    """Bring packed records to their documents: calls each(batch, records of the part sorted by doc and tag) for slices of documents."""
    left = docs.select(_part_column(parts).alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("block"), "doc_id", "text", *extra)
    right = blocks.select("part", F.lit(0).alias("kind"), "block")
    both = left.unionByName(right, allowMissingColumns=True).repartition(parts, "part").sortWithinPartitions("part", "kind")

    def run(batches):
        records, held, now, fresh = np.zeros(0, record), [], None, True
        for batch in batches:
            part_column, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(part_column) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                piece = batch.slice(a, b - a)
                if part_column[a] != now:
                    now, held, records, fresh = part_column[a], [], np.zeros(0, record), True
                if kinds[a] == 0:
                    held += [np.frombuffer(x, record) for x in piece.column("block").to_pylist()]
                    continue
                if fresh and held:
                    records = np.concatenate(held)
                    records = records[np.lexsort((records["tag"], records["doc"]))]
                    held = []
                fresh = False
                for s in slices(iter([piece]), "text"):
                    yield from each(s, records)

    return both.mapInArrow(run, schema)


def _rows_of(records: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents (id, tag): the first and the number of their records (sorted by doc, tag)."""
    key = np.dtype([("doc", "<i8"), ("tag", "<u4")])
    have, want = np.empty(len(records), key), np.empty(len(ids), key)
    have["doc"], have["tag"], want["doc"], want["tag"] = records["doc"], records["tag"], ids, tags
    # ranks of (doc, tag) pairs by two searches: documents, then tags among them
    a, b = np.searchsorted(have["doc"], ids, side="left"), np.searchsorted(have["doc"], ids, side="right")
    for i in np.flatnonzero(b > a):
        own = have["tag"][a[i] : b[i]]
        a[i], b[i] = a[i] + np.searchsorted(own, tags[i], side="left"), a[i] + np.searchsorted(own, tags[i], side="right")
    return a, b - a


_CONTEXT_SQL = "lead binary, block int, doc long, tag long, pos long, lo int, hi int, context binary"
_CONTEXT = pa.schema([("lead", pa.binary()), ("block", pa.int32()), ("doc", pa.int64()), ("tag", pa.int64()), ("pos", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("context", pa.binary())])


def fetch_contexts(docs: DataFrame, requests: DataFrame, parts: int) -> DataFrame:
    """The bytes around requested anchors, with the anchor's leading K bytes as the key of the suffix."""

    def each(batch, records):
        if not len(records):
            return
        data, offsets = utf8(batch.column("text"))
        ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
        first, n = _rows_of(records, ids, _tags(data, offsets))
        r, doc = records[spread(first, n)], np.repeat(np.arange(len(ids)), n)
        # equal rows of the table ask alike; one answer is enough
        _, once = np.unique(r, return_index=True)
        r, doc = r[once], doc[once]
        raw, base = data.tobytes(), offsets[doc] + r["pos"]
        if len(r):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([raw[p : p + K] if not b else _hot_lead(raw, p, b - 1) for p, b in zip(base.tolist(), r["block"].tolist(), strict=True)], pa.binary()),
                    pa.array(r["block"].astype(np.int32)),
                    pa.array(r["doc"]),
                    pa.array(r["tag"].astype(np.int64)),
                    pa.array(r["pos"].astype(np.int64)),
                    pa.array(r["lo"].astype(np.int32)),
                    pa.array(r["hi"].astype(np.int32)),
                    pa.array([raw[p - lo : p - hi + LENGTH] for p, lo, hi in zip(base.tolist(), r["lo"].tolist(), r["hi"].tolist(), strict=True)], pa.binary()),
                ],
                schema=_CONTEXT,
            )

    return meet(docs, requests, parts, _REQUEST, each, _CONTEXT_SQL)


def _hot_lead(raw: bytes, at: int, block: int) -> bytes:
    """K bytes for what all windows of a block of offsets cover around an anchor at `at`."""
    return hashlib.blake2b(raw[at - block * HOT_OFFSETS : at - block * HOT_OFFSETS - (HOT_OFFSETS - 1) + LENGTH], digest_size=K).digest()


def multikey_quicksort(pool: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sort strings of `length` bytes inside groups, eight bytes a key; returns (order, class) of the strings
    that have an equal in their group. Strings alone under a key are done and drop out of the next round."""
    order = np.argsort(group, kind="stable")
    segment = np.cumsum(np.diff(group[order], prepend=group[order][:1] - 1) != 0) if len(order) else order
    view = np.lib.stride_tricks.sliding_window_view(pool, 8)
    for k in [*range(0, length - 7, 8), length - 8]:
        size = np.bincount(segment)[segment] if len(segment) else segment
        keep = size > 1
        order, segment = order[keep], segment[keep]
        if not len(order):
            break
        key = np.ascontiguousarray(view[starts[order] + k]).view(">u8").ravel().astype(np.uint64)
        by = np.lexsort((key, segment))
        order, segment, key = order[by], segment[by], key[by]
        segment = np.cumsum((np.diff(segment, prepend=-1) != 0) | (np.diff(key, prepend=key[:1]) != 0))
    size = np.bincount(segment)[segment] if len(segment) else segment
    keep = size > 1
    return order[keep], segment[keep]


def compare_suffixes(contexts: DataFrame, parts: int) -> DataFrame:
    """Range-partition the suffixes by sampled splitters of their leads, sort each bucket, and emit the spans of repeated windows."""

    def settle(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        lead = pa.concat_arrays(t.column("lead").chunks)
        block, doc, tag, pos = (t.column(k).to_numpy() for k in ("block", "doc", "tag", "pos"))
        lo, hi = t.column("lo").to_numpy().astype(np.int64), t.column("hi").to_numpy().astype(np.int64)
        pool, base = _binary(pa.concat_arrays(t.column("context").chunks))
        same = np.ones(len(lead), bool)
        raw, _ = _binary(lead)
        m = raw.reshape(-1, K)
        same[1:] = (m[1:] != m[:-1]).any(axis=1) | (block[1:] != block[:-1])
        group = np.cumsum(same)
        n = lo - hi + 1
        limit, a = 1 << 18, 0
        total = np.cumsum(n)
        while a < len(n):  # some whole groups at a time
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, side="right")))
            while b < len(n) and group[b] == group[b - 1]:
                b += 1
            row = np.repeat(np.arange(a, b), n[a:b])
            nth = spread(np.zeros(b - a, np.int64), n[a:b])
            offset = lo[row] - nth  # of the anchor in its window
            order, equal = multikey_quicksort(pool, base[:-1][row] + nth, group[row] * 256 + offset)
            start = (pos[row] - offset)[order]
            d, g = doc[row][order], tag[row][order]
            by = np.lexsort((start, d, equal))
            order, equal, start, d, g = order[by], equal[by], start[by], d[by], g[by]
            if len(order):
                fresh = np.diff(equal, prepend=-1) != 0
                head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
                later = (d > d[head]) | (start > start[head])
                out = np.zeros(int(later.sum()), _SPAN)
                out["doc"], out["tag"], out["start"], out["end"] = d[later], g[later], start[later], start[later] + LENGTH
                yield from _spans_out(merged(out), parts)
            a = b

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            # settle what is held up to the last change of the group
            if size >= 1 << 22:
                keys = list(zip(batch.column("lead").to_pylist(), batch.column("block").to_pylist(), strict=True))
                cut = next((i for i, k in enumerate(keys) if k != last), len(keys))
                if cut < len(keys):
                    yield from settle([*held, batch.slice(0, cut)] if cut else held)
                    held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.nbytes
            last = (batch.column("lead")[-1].as_py(), batch.column("block")[-1].as_py())
        if held:
            yield from settle(held)

    return contexts.repartitionByRange(parts, "lead", "block").sortWithinPartitions("lead", "block").mapInArrow(run, _BLOCK_SQL)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def removed_spans(docs: DataFrame, parts: int, files: int | None = None) -> DataFrame:
    """Packed spans of removed bytes (documents: doc_id long, text string)."""
    found = stored(match_anchors(find_anchors(docs, parts), parts), "suffix-blocks", files)
    contexts = stored(fetch_contexts(docs, found.where(F.col("kind") == REQUESTS), parts), "suffix-contexts", files)
    return found.where(F.col("kind") == SPANS).unionByName(compare_suffixes(contexts, parts))


def _prepared(docs: DataFrame, *extra: str) -> tuple[DataFrame, int, int]:
    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra), *parts_and_files(docs)


def _gone(batch: pa.RecordBatch, records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, flags of removed bytes) of a slice of documents."""
    data, offsets = utf8(batch.column("text"))
    ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
    first, n = _rows_of(records, ids, _tags(data, offsets))
    r, doc = records[spread(first, n)], np.repeat(np.arange(len(ids)), n)
    return data, offsets, covered(len(data), offsets[doc] + r["start"], offsets[doc] + r["end"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    docs, parts, files = _prepared(docs)

    def each(batch, records):
        data, offsets, gone = _gone(batch, records)
        running = np.concatenate([[0], np.cumsum(gone)])
        head = gone.copy()
        head[1:] &= ~gone[:-1] | np.isin(np.arange(1, len(gone)), offsets)
        heads = np.concatenate([[0], np.cumsum(head)])
        kept, edges = data[~gone].tobytes(), offsets - running[offsets]
        digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        count = lambda x: pa.array(np.diff(x[offsets]).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), count(running), count(heads), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return meet(docs, removed_spans(docs, parts, files), parts, _SPAN, each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def keep_rest(docs: DataFrame) -> DataFrame:
    """The columns of docs with the text that is left: removed bytes gone, and with them fragments of characters cut by a span."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = {c: f"_kept{i}" for i, c in enumerate(others)}
    work = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    work, parts, files = _prepared(work, *names.values())

    def each(batch, records):
        data, offsets, gone = _gone(batch, records)
        kept = data[~gone].tobytes()
        edges = offsets - np.concatenate([[0], np.cumsum(gone)])[offsets]
        missing = batch.column("text").is_null().to_pylist()
        texts = [None if none else kept[a:b].decode(errors="ignore") for a, b, none in zip(edges[:-1], edges[1:], missing, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), *(batch.column(n) for n in names.values())], names=["doc_id", "text", *names.values()])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(n, docs.schema[c].dataType) for c, n in names.items()]])
    out = meet(work, removed_spans(work.select("doc_id", "text"), parts, files), parts, _SPAN, each, schema, tuple(names.values()))
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, b[i + 1:i + {LENGTH}] AS s FROM (SELECT doc_id, b, unnest(range(0, greatest(octet_length(b) - {LENGTH - 1}, 0))) AS i FROM d)),
first AS (SELECT s, arg_min({{'d': doc_id, 'i': i}}, {{'d': doc_id, 'i': i}}) AS f FROM w GROUP BY s HAVING count(*) > 1),
dup AS (SELECT doc_id, i FROM w JOIN first USING (s) WHERE doc_id <> f.d OR i <> f.i),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {LENGTH})) AS p FROM dup),
runs AS (SELECT doc_id, min(p) AS a, max(p) AS b FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM gone) GROUP BY doc_id, r),
cuts AS (SELECT doc_id, count(*) AS n_spans, sum(b - a + 1)::BIGINT AS n_removed, list(a ORDER BY a) AS starts, list(b + 1 ORDER BY a) AS ends FROM runs GROUP BY doc_id),
kept AS (SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN starts IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(starts) + 2), lambda k:
    substr(h, CASE WHEN k = 1 THEN 1 ELSE 2 * ends[k - 1] + 1 END, 2 * (CASE WHEN k > len(starts) THEN length(h) // 2 ELSE starts[k] END - CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END))), '') END AS k
  FROM d LEFT JOIN cuts USING (doc_id))
SELECT doc_id, n_bytes::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM kept"""

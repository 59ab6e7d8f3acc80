"""Benchmark decontamination by a distributed positional inverted index.

`build_index` turns documents into segments: for a slice of documents the sorted positions of every term, stored as
Parquet in the shared folder. It knows nothing of any benchmark, so one index serves all of a benchmark's blocks and
any later benchmark. `exact_matches` starts from a segment's own terms: windows of consecutive benchmark words are
listed under their rarest test term, so only windows whose rarest term the segment has are looked at. Their terms'
postings are intersected, rarest in the segment first, each list shifted by the term's offset in the window.
`proximity_matches` finds places where all terms of a window, repeated ones as often as the window has them, stand
within `slop` words of its rarest term, in any order.

The benchmark is processed in blocks of at most `BLOCK_WORDS` words, so what is broadcast (8 bytes a word, 16 bytes a
window) has a fixed bound however large the benchmark is. Of several blocks one is held at a time: its hits are stored,
its broadcast is destroyed, and hits are merged by the segment and row of the one stored index.

Equal windows are one window with several items, so a word repeated a thousand times is looked up once. A segment takes
windows in steps of at most `STEP_WINDOWS`, and positions of their rarest terms in steps of about `STEP_POSITIONS`; of a
step's occurrences only flags of hit words and distinct pairs of document and item are kept. So memory follows the
segment, not the number of occurrences.

Words: A-Z lower-cased, then runs of bytes other than \\x00-\\x2F, \\x3A-\\x60, \\x7B-\\x7F. A document may be
longer than a slice: it is then a segment of its own. Matches never cross documents. Cases: null or empty
text has no words and no hits; items without words are ignored; an item with fewer words than a window is one
window; equal items and repeated rows each count by their item_id once per document; items with a null id
mark words as hit but are neither listed nor counted. An empty benchmark or table is fine. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NOT_ALNUM, arrow_rows, lower, mix, slices, spread, stored, utf8, word_hash, words

WINDOW = 10
BLOCK_WORDS = 1_000_000
STEP_WINDOWS, STEP_POSITIONS = 1 << 15, 1 << 19
_SEGMENT = pa.schema([("segment", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.binary()), ("counts", pa.binary()), ("gaps", pa.binary())])
_SEGMENT_SQL = "segment string, doc_ids array<long>, n_words array<long>, terms binary, counts binary, gaps binary"


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, and the index of each text's first word."""
    data, offsets = utf8(column)
    data = lower(data)
    starts, ends, first = words(data, offsets, NOT_ALNUM)
    return word_hash(data, starts, ends), first


class Windows:
    """Distinct windows of benchmark words: where each starts in the list of word hashes, its width and items, listed under its rarest term."""

    def __init__(self, rows: list[tuple[str | None, str]], width: int):
        self.width = width
        self.items = [r[0] for r in rows]
        self.hashes, first = term_hashes(pa.array([r[1] for r in rows], pa.string()))
        counts = np.diff(first)
        n = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
        owner = np.repeat(np.arange(len(rows)), n)
        start, size = spread(first[:-1], n), np.minimum(counts, width)[owner].astype(np.int32)
        same = self._same(start, size)
        # One window stands for all equal ones; the items of window w are item[item_edges[w] : item_edges[w + 1]].
        pairs = np.unique(same * max(len(rows), 1) + owner)
        kept, of = np.unique(same, return_index=True)
        self.start, self.size = start[of], size[of]
        self.item = (pairs % max(len(rows), 1)).astype(np.int32)
        self.item_edges = np.append(np.searchsorted(pairs // max(len(rows), 1), kept), len(pairs))
        names, which, df = np.unique(self.hashes, return_inverse=True, return_counts=True)
        rarest = np.full(len(self.start), -1)
        for k in range(width):
            at = np.minimum(self.start + k, max(len(which) - 1, 0))
            term = which[at] if len(which) else at
            rarest = np.where((k < self.size) & ((rarest < 0) | (df[term] < df[rarest])), term, rarest) if len(which) else rarest
        order = np.argsort(rarest, kind="stable")
        self.listed = order.astype(np.int32)
        present = np.unique(rarest)
        self.keys = names[present] if len(names) else names
        self.edges = np.append(np.searchsorted(rarest[order], present), len(order))

    def _same(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The index of the first window with the same words, for every window: by hash, all words compared."""
        at = lambda k: self.hashes[np.minimum(start + k, len(self.hashes) - 1)]
        digest = size.astype(np.uint64)
        for k in range(self.width if len(start) else 0):
            digest = np.where(k < size, mix(digest * np.uint64(0xD6E8FEB86659FD93) + at(k)), digest)
        out, left = np.arange(len(start)), np.arange(len(start))
        while len(left):  # windows of one hash but other words are looked at again
            _, first, of = np.unique(digest[left], return_index=True, return_inverse=True)
            lead = left[first][of]
            equal = size[lead] == size[left]
            for k in range(self.width):
                equal &= (k >= size[left]) | (self.hashes[np.minimum(start[lead] + k, len(self.hashes) - 1)] == self.hashes[np.minimum(start[left] + k, len(self.hashes) - 1)])
            out[left[equal]] = lead[equal]
            left = left[~equal]
        return out

    def terms(self, window: np.ndarray) -> np.ndarray:
        """Term hashes of windows by offset (whatever follows beyond a window's size)."""
        return self.hashes[np.minimum(self.start[window][:, None] + np.arange(self.width), len(self.hashes) - 1)]

    def under(self, terms: np.ndarray) -> np.ndarray:
        """The windows listed under any of the (sorted, distinct) terms."""
        if not len(self.keys):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, terms), len(self.keys) - 1)
        at = at[self.keys[at] == terms]
        return self.listed[spread(self.edges[at], np.diff(self.edges)[at])].astype(np.int64)


def benchmark_blocks(benchmark: DataFrame, width: int, block_words: int) -> Iterator[Windows]:
    """The benchmark's windows, a bounded block of items at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    held, size = [], 0
    for r in rows.toLocalIterator():
        held.append((r.i, r.t))
        size += len(r.t) // 2 + 1  # a word has a letter and a separator at least
        if size >= block_words:
            yield Windows(held, width)
            held, size = [], 0
    if held:
        yield Windows(held, width)


def build_index(docs: DataFrame, gap: int = WINDOW) -> DataFrame:
    """Segments of the positional index of all words, stored in the shared folder.

    Positions number the words of a segment; `gap` free positions between documents keep matches inside one."""
    arrow_rows(docs.sparkSession)

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            hashes, first = term_hashes(batch.column("text"))
            counts = np.diff(first)
            position = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)) * gap, counts)
            order = np.argsort(hashes, kind="stable")
            terms, df = np.unique(hashes[order], return_counts=True)
            gaps = np.diff(position[order], prepend=0)
            heads = np.cumsum(df) - df
            gaps[heads] = position[order][heads]  # every list starts afresh
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{task}-{n}"]),
                    pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([counts.tolist()], pa.list_(pa.int64())),
                    pa.array([terms.tobytes()], pa.binary()),
                    pa.array([df.astype(np.uint32).tobytes()], pa.binary()),
                    pa.array([gaps.astype(np.uint32).tobytes()], pa.binary()),
                ],
                schema=_SEGMENT,
            )
            n += 1

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(source.mapInArrow(run, _SEGMENT_SQL), "positional-index")


class Segment:
    """One segment's postings, with keys (term slot, position) in one sorted array."""

    def __init__(self, row: dict):
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.df = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.df)])
        gaps = np.frombuffer(row["gaps"], np.uint32).astype(np.int64)
        running = np.cumsum(gaps)
        before = np.concatenate([[0], running])[self.first[:-1]]
        self.positions = running - np.repeat(before, self.df)
        self.keys = np.repeat(np.arange(len(self.terms)) << 40, self.df) + self.positions

    def slots(self, terms: np.ndarray) -> np.ndarray:
        """Slots of term hashes, -1 where the segment hasn't the term."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def rarest_first(self, w: Windows, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these windows the ones all of whose terms the segment has: index, slots and offsets of their terms, rarest first."""
        slots = self.slots(w.terms(listed))
        used = np.arange(w.width) < w.size[listed][:, None]
        whole = ((slots >= 0) | ~used).all(axis=1)
        alive, slots, used = listed[whole], slots[whole], used[whole]
        df = np.where(used, self.df[np.maximum(slots, 0)], np.iinfo(np.int64).max)
        order = np.argsort(df, axis=1, kind="stable")
        return alive, np.take_along_axis(slots, order, 1), order

    def places(self, w: Windows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Steps of bounded size: windows, slots and offsets of their terms, and (index of the window in the step, position) of every place of its rarest term."""
        listed = w.under(self.terms)
        for a in range(0, len(listed), STEP_WINDOWS):
            alive, slots, offsets = self.rarest_first(w, listed[a : a + STEP_WINDOWS])
            if not len(alive):
                continue
            n = self.df[slots[:, 0]]
            ends = np.cumsum(n)
            for low in range(0, int(ends[-1]), STEP_POSITIONS):
                high = min(low + STEP_POSITIONS, int(ends[-1]))
                first, last = np.searchsorted(ends, low, side="right"), np.searchsorted(ends, high, side="left")  # a long list is cut too
                at = np.arange(first, last + 1)
                begin = np.maximum(low, ends[at] - n[at])
                size = np.minimum(high, ends[at]) - begin
                yield alive, slots, offsets, np.repeat(at, size), self.positions[spread(self.first[slots[at, 0]] + begin - (ends[at] - n[at]), size)]

    def exact(self, w: Windows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, first position) of every occurrence of a window, step by step."""
        for alive, slots, offsets, of, at in self.places(w):
            at = at - offsets[of, 0]
            keep = at >= 0
            of, at, size = of[keep], at[keep], w.size[alive]
            for k in range(1, w.width):
                if not len(of):
                    break
                key = (slots[of, k] << 40) + at + offsets[of, k]
                spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                keep = (k >= size[of]) | (self.keys[spot] == key)
                of, at = of[keep], at[keep]
            yield alive[of], at

    def near(self, w: Windows, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, position of its rarest term) where every term of the window stands within `slop` words, as often as the window has it, step by step."""
        for alive, slots, _, of, at in self.places(w):
            used = np.arange(w.width) < w.size[alive][:, None]
            for k in range(w.width):
                low = np.searchsorted(self.keys, (slots[of, k] << 40) + np.maximum(at - slop, 0))
                high = np.searchsorted(self.keys, (slots[of, k] << 40) + at + slop, side="right")
                times = ((slots[of] == slots[of, k][:, None]) & used[of]).sum(axis=1)
                keep = ~used[of, k] | (high - low >= times)
                of, at = of[keep], at[keep]
            yield alive[of], at


def _hits(segment: Segment, w: Windows, base: np.ndarray, length: int, slop: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last hit positions of maximal runs, and the sorted distinct pairs document * items + item."""
    steps = np.zeros(length + 1, np.int32)
    pairs = np.zeros(0, np.int64)
    for window, at in segment.exact(w) if slop is None else segment.near(w, slop):
        if not len(at):
            continue
        # Starts and ends by position; a place counts once for each width.
        for size in np.unique(w.size[window]).tolist() if slop is None else [1]:
            places = np.unique(at[w.size[window] == size] if slop is None else at)
            steps[places] += 1
            steps[places + size] -= 1
        doc = np.searchsorted(base, at, side="right") - 1  # gap > 0 keeps the bases of documents apart
        once = np.unique(doc * len(w.start) + window)
        window = once % len(w.start)
        n = np.diff(w.item_edges)[window]
        pairs = np.union1d(pairs, np.repeat(once // len(w.start), n) * len(w.items) + w.item[spread(w.item_edges[window], n)])
    hit = np.concatenate([[False], np.cumsum(steps[:-1]) > 0, [False]])
    return np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:]), pairs


_MATCH = pa.schema([("segment", pa.string()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
_MATCH_SQL = "segment string, row long, doc_id long, n_words long, spans array<struct<start: long, end: long>>, items array<string>"


def _matches(index: DataFrame, shared: Broadcast, gap: int, slop: int | None) -> DataFrame:
    """A row per document: the spans of words in matches (word numbers in the document) and the items matched."""

    def run(batches):
        w = shared.value
        for batch in batches:
            for k in range(batch.num_rows):  # a segment at a time: each is a few megabytes
                row = batch.slice(k, 1).to_pylist()[0]
                counts = np.array(row["n_words"], np.int64)
                n = len(counts)
                base = np.concatenate([[0], np.cumsum(counts)])[:-1] + np.arange(n) * gap
                spans: dict[int, list] = {}
                items: dict[int, list] = {}
                if w is not None and len(w.start) and n:
                    first, last, pairs = _hits(Segment(row), w, base, int(base[-1] + counts[-1]) + w.width, slop)
                    doc = np.searchsorted(base, first, side="right") - 1
                    for d, a, b in zip(doc.tolist(), (first - base[doc]).tolist(), (last - base[doc]).tolist(), strict=True):
                        spans.setdefault(d, []).append({"start": a, "end": b})
                    for p in pairs.tolist():
                        if (name := w.items[p % len(w.items)]) is not None:
                            items.setdefault(p // len(w.items), []).append(name)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["segment"]] * n),
                        pa.array(range(n), pa.int64()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(counts),
                        pa.array([spans.get(d, []) for d in range(n)], _MATCH.field("spans").type),
                        pa.array([sorted(set(items.get(d, []))) for d in range(n)], pa.list_(pa.string())),
                    ],
                    schema=_MATCH,
                )

    return index.mapInArrow(run, _MATCH_SQL)


def search(index: DataFrame, benchmark: DataFrame, gap: int, width: int = WINDOW, block_words: int = BLOCK_WORDS, slop: int | None = None) -> DataFrame:
    """The matches of a benchmark in a stored index that was built with this gap: a row per document (segment, row)."""
    context = index.sparkSession.sparkContext
    blocks = benchmark_blocks(benchmark, width, block_words)
    held, after = next(blocks, None), next(blocks, None)
    if after is None:
        return _matches(index, context.broadcast(held), gap, slop)
    hits = []
    while held is not None:  # one block at a time: the driver holds it and the one being read
        shared = context.broadcast(held)
        hits.append(stored(_matches(index, shared, gap, slop).where(F.size("spans") > 0), "benchmark-hits"))
        shared.destroy()
        held, after = after, next(blocks, None)
    whole = _matches(index, context.broadcast(None), gap, slop)
    for h in hits:
        whole = whole.unionByName(h)
    return whole.groupBy("segment", "row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )


def _search(docs: DataFrame, benchmark: DataFrame, width: int, block_words: int, slop: int | None) -> DataFrame:
    gap = max(width, slop or 0) + 1
    return search(build_index(docs, gap), benchmark, gap, width, block_words, slop)


def exact_matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans of hit words and the items hit, for every row of docs."""
    return _search(docs, benchmark, width, block_words, None)


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int, width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """As exact_matches, for windows whose terms all stand within `slop` words of their rarest term's occurrence (which is the span)."""
    return _search(docs, benchmark, width, block_words, slop)


def n_hit(spans: str = "spans"):
    """Number of words in the union of the spans."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["total"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).cast("long").alias("total"))
    return F.aggregate(F.array_sort(spans), start, step, lambda a: a["total"])


def report(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = exact_matches(docs, benchmark, width).select("doc_id", "n_words", n_hit().alias("n_hit"), F.array_sort("items").alias("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS gram FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON bw.size = dw.size AND gram = array_to_string(w[i:i + dw.size - 1], ' ')),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""

"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model of any order from two on.

Counting runs in Spark over all training documents. Each task counts the grams of its texts, packs the counts by part
and shuffles packed blocks; a part's task merges them and writes the part's grams as sorted hash arrays. A gram's part
comes from its context and one of `SALT` salts of its last word, so grams of a context share few parts, and a word that
starts a third of all grams is spread over several. A merged level gives the
counts of the next lower one (of each gram without its first word: how many words stand before it) and the totals of
its contexts, which are merged the same way, level by level. The model is a folder of arrays sorted by hash below
spark.checkpoint.dir; scoring workers map the files into memory and look up by binary search. Files are written
under temporary names and renamed, so a retried task leaves the same bytes under the same names. The number of parts
follows the bytes of the texts.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, known by 64-bit hashes; one end token follows each text
and start tokens precede it. With c the count of the highest level, and below it the number of distinct words before a
gram, and D1, D2, D3+ of each level from its counts of counts:
  p_k(w | u) = max(c(u w) - D, 0) / c(u .) + gamma(u) p_{k-1}(w | u without its first word),
  p_1(w) = max(n(w) - D', 0) / n + gamma' / (V + 1);
an unseen context gives the level below. The probabilities of the V training tokens and of one unknown token sum to 1 in
every context.

Cases: null and empty text is the end token alone; a null doc_id is in the training part; repeated rows count
and are scored each; with an empty training part every token has probability 1 / (V + 1). Other columns are
ignored.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import SPACE, arrow_rows, fresh_path, lower, mix, parts_for, slices, utf8, word_hash, words
from .store import Folder

ORDER = 2
SALT = 8
START, END = np.uint64(0x5374617274), np.uint64(0x456E64)
_FLUSH = 3 << 19  # grams held by a counting task before it packs them
_KEPT_ARRAYS = 64  # of a model that can't be mapped, in a worker's memory
_WORD, _CONTEXT = 1, 16  # kinds of blocks: 1 words, k grams of k words, 16 + k contexts of grams of k words
_BLOCK = "part int, a binary, n binary"
_BLOCK_ARROW = pa.schema([("part", pa.int32()), ("a", pa.binary()), ("n", pa.binary())])


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def tokens(column: pa.Array, order: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    """Token hashes of all texts (words, then the end) under the last of `order` columns, the tokens before each under the others, and each text's first token."""
    data, offsets = utf8(column)
    data = lower(data)
    starts, ends, first = words(data, offsets, SPACE)
    h = np.insert(word_hash(data, starts, ends), first[1:], END)
    first = first + np.arange(len(first))
    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    columns = [h]
    for back in range(1, order):
        before = np.full_like(h, START)
        before[back:] = h[:-back]
        before[place < back] = START
        columns.insert(0, before)
    return columns, first


def gram(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of grams, from the first word to the last: the hash of a gram without its last word is that of its context."""
    out = columns[0]
    for c in columns[1:]:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + c)
    return out


def part_of(columns: list[np.ndarray], parts: int) -> np.ndarray:
    """Part of a gram: from its context, salted by its last word; of a single hash from that."""
    key = columns[0] if len(columns) == 1 else gram(columns[:-1]) + (columns[-1] & np.uint64(SALT - 1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mix(key) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def grouped(keys: list[np.ndarray], values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys, sorted, and the sums of their values (one column or several)."""
    if not len(keys[0]):
        return keys, values
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys, values = [k[order] for k in keys], values[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(fresh)
    return [k[at] for k in keys], np.add.reduceat(values, at, axis=0)


def _packed(keys: list[np.ndarray], n: np.ndarray, kind: int, parts: int):
    """Blocks of rows by part. Parts of kind k are numbered from k << 24."""
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    part, keys, n = part[order], [k[order] for k in keys], n[order]
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else [0]
    rows = [(int(part[i]) + (kind << 24), b"".join(k[i:j].tobytes() for k in keys), n[i:j].tobytes()) for i, j in zip(edges[:-1], edges[1:], strict=True)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _BLOCK_ARROW.types, strict=True)], schema=_BLOCK_ARROW)


def _parts(batches):
    """(kind, part, blocks) of consecutive rows with the same part."""
    held, now = [], None
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if row[0] != now:
                if held:
                    yield now >> 24, now & 0xFFFFFF, held
                held, now = [], row[0]
            held.append(row[1:])
    if held:
        yield now >> 24, now & 0xFFFFFF, held


def _merged(blocks: list, width: int, dtype, columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of all blocks, added up by key."""
    keys = [[] for _ in range(width)]
    for a, _ in blocks:
        for held, k in zip(keys, np.frombuffer(a, np.uint64).reshape(width, -1), strict=True):
            held.append(k)
    n = np.concatenate([np.frombuffer(b, dtype) for _, b in blocks]).astype(np.int64)
    return grouped([np.concatenate(k) for k in keys], n.reshape(-1, columns) if columns > 1 else n)


def _save(folder: Folder, name: str, **arrays: np.ndarray) -> None:
    """Arrays as files; counts in as few bits as hold them."""
    for key, array in arrays.items():
        out = io.BytesIO()
        most = array.max(initial=0) if key != "key" else 0
        np.save(out, array if key == "key" else array.astype(np.uint8 if most < 2**8 else np.uint16 if most < 2**16 else np.uint32 if most < 2**32 else np.int64))
        folder.write(f"{name}.{key}.npy", out.getvalue())


@dataclass
class Model:
    """A trained model: its folder and the few numbers that all workers need."""

    url: str
    parts: int
    order: int
    train_tokens: int
    distinct_tokens: int
    distinct_grams: dict[int, int]
    discounts: dict[int, tuple[float, float, float]]
    lower_gamma: float


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of grams seen once to four times; 0.5 each where they aren't defined."""
    if min(n) <= 0:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    d = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
    return d if all(0 < x < k for k, x in enumerate(d, 1)) else (0.5, 0.5, 0.5)


def _with(d: tuple[float, float, float], counts: np.ndarray) -> np.ndarray:
    return np.asarray([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def train(docs: DataFrame, url: str | None = None, parts: int | None = None, order: int = ORDER) -> Model:
    """Count the grams of `order` words of all rows of docs (column text) and write the model."""
    if not 2 <= order < _CONTEXT:
        raise ValueError("order has to be 2 to 15")
    spark = docs.sparkSession
    arrow_rows(spark)
    url = url or fresh_path(spark, "lm")
    parts = parts or parts_for(docs)

    def count(batches):
        held, size = [], 0

        def pack():
            keys, n = grouped([np.concatenate([h[0][k] for h in held]) for k in range(order)], np.concatenate([h[1] for h in held]))
            held.clear()
            for a in range(0, len(n), _FLUSH // 2):
                yield from _packed([k[a : a + _FLUSH // 2] for k in keys], n[a : a + _FLUSH // 2].astype(np.uint32), order, parts)

        for batch in slices(batches):
            columns, _ = tokens(batch.column("text"), order)
            held.append(grouped(columns, np.ones(len(columns[-1]), np.uint32)))
            size += len(held[-1][1])
            if size >= _FLUSH:
                yield from pack()
                size = 0
        if held:
            yield from pack()

    def merge(level: int):
        """A task that merges grams of `level` words (words themselves at 1), and what the level above gave: contexts and words."""

        def run(batches):
            folder = Folder(url)
            for kind, part, blocks in _parts(batches):
                if kind >= _CONTEXT:
                    (key,), stats = _merged(blocks, 1, np.int64, 4)
                    _save(folder, f"context-{kind - _CONTEXT}-{part}", key=key, stats=stats)
                elif kind == _WORD:
                    (key,), stats = _merged(blocks, 1, np.int64, 2)
                    if level > 1:  # more of each word comes from lower levels
                        yield from _packed([key], stats, _WORD, parts)
                        continue
                    _save(folder, f"word-{part}", key=key, stats=stats)
                    n, c = stats[:, 0], stats[:, 1]
                    yield _tally(1, [*((n == k).sum() for k in (1, 2, 3, 4)), len(key), c.sum(), (n > 2).sum()])
                elif kind == 0:
                    for a, n in blocks:
                        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([a], pa.binary()), pa.array([n], pa.binary())], schema=_BLOCK_ARROW)
                else:
                    keys, c = _merged(blocks, level, np.uint32, 1)
                    g = gram(keys)
                    by = np.argsort(g)
                    _save(folder, f"gram-{level}-{part}", key=g[by], count=c[by])
                    # contexts: total, followers seen once, twice, more often
                    (context,), stats = grouped([gram(keys[:-1])], np.stack([c, c == 1, c == 2, c > 2], axis=1).astype(np.int64))
                    yield from _packed([context], stats, _CONTEXT + level, parts)
                    if level > 2:
                        shorter, n = grouped(keys[1:], np.ones(len(c), np.uint32))
                        yield from _packed(shorter, n.astype(np.uint32), level - 1, parts)
                    # words: distinct words before (of grams of two), occurrences (of the longest grams)
                    if level in (2, order):
                        (word,), stats = grouped([keys[-1]], np.stack([np.full(len(c), level == 2), c if level == order else np.zeros_like(c)], axis=1).astype(np.int64))
                        yield from _packed([word], stats, _WORD, parts)
                    yield _tally(level, [*((c == k).sum() for k in (1, 2, 3, 4)), len(c), 0, 0])

        return run

    def _tally(level: int, numbers: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.array([level], np.int64).tobytes()], pa.binary()), pa.array([np.array(numbers, np.int64).tobytes()], pa.binary())], schema=_BLOCK_ARROW)

    blocks = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, _BLOCK)
    for level in range(order, 0, -1):
        blocks = blocks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(merge(level), _BLOCK)
    sums: dict[int, np.ndarray] = {k: np.zeros(7, np.int64) for k in range(1, order + 1)}
    for r in blocks.collect():  # a few numbers for each part
        sums[int(np.frombuffer(r.a, np.int64)[0])] += np.frombuffer(r.n, np.int64)
    discounts = {k: _discounts(v[:4].tolist()) for k, v in sums.items()}
    grams, word = int(sums[2][4]), sums[1].tolist()
    gamma = float(np.dot(discounts[1], (word[0], word[1], word[6])) / grams) if grams else 1.0
    return Model(url, parts, order, word[5], word[4], {k: int(v[4]) for k, v in sums.items()}, discounts, gamma)


class Lookup:
    """The memory-mapped model in a worker."""

    def __init__(self, model: Model):
        self.m, self.folder, self.open = model, Folder(model.url), {}

    def array(self, name: str) -> np.ndarray | None:
        if name not in self.open:
            if self.folder.fs is not None and len(self.open) >= _KEPT_ARRAYS:
                self.open.pop(next(iter(self.open)))
            self.open[name] = self.folder.array(name)
        return self.open[name]

    def find(self, kind: str, value: str, part: np.ndarray, key: np.ndarray, columns: int | None) -> np.ndarray:
        """Values of keys, 0 where absent. Keys are sorted by (part, key), so a part's pages are read in order."""
        out = np.zeros(len(key) if columns is None else (len(key), columns), np.int64)
        edges = np.searchsorted(part, np.arange(self.m.parts + 1))
        for p in np.flatnonzero(np.diff(edges)):
            have = self.array(f"{kind}-{p}.key.npy")
            if have is None or not len(have):
                continue
            own = key[edges[p] : edges[p + 1]]
            at = np.minimum(np.searchsorted(have, own), len(have) - 1)
            hit = np.flatnonzero(have[at] == own)
            out[edges[p] + hit] = self.array(f"{kind}-{p}.{value}.npy")[at[hit]]
        return out

    def values(self, kind: str, value: str, keys: list[np.ndarray], columns: int | None = None) -> np.ndarray:
        """Values of any grams: each distinct one is looked up once, by part and in order."""
        part, key = part_of(keys, self.m.parts), gram(keys)
        order = np.lexsort((key, part))
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[order][1:] != key[order][:-1]
        at = order[np.flatnonzero(fresh)]
        found = self.find(kind, value, part[at], key[at], columns)
        out = np.empty((len(key), *found.shape[1:]), np.int64)
        out[order] = found[np.cumsum(fresh) - 1]
        return out

    def probabilities(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """p(last | the words before it) and the training count of the last."""
        m = self.m
        word = self.values("word", "stats", columns[-1:], 2)
        n, c = word[:, 0], word[:, 1]
        grams = m.distinct_grams[2]
        p = m.lower_gamma / (m.distinct_tokens + 1) + (np.maximum(n - _with(m.discounts[1], n), 0) / grams if grams else 0)
        for level in range(2, m.order + 1):
            own = columns[-level:]
            context = self.values(f"context-{level}", "stats", [gram(own[:-1])], 4)
            count = self.values(f"gram-{level}", "count", own)
            total = np.maximum(context[:, 0], 1)
            gamma = np.where(context[:, 0] > 0, context[:, 1:] @ np.asarray(m.discounts[level]) / total, 1.0)
            p = np.maximum(count - _with(m.discounts[level], count), 0) / total + gamma * p
        return p, c


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every document."""
    arrow_rows(docs.sparkSession)

    def run(batches):
        look = Lookup(model)
        n, v = model.train_tokens, model.distinct_tokens
        for batch in slices(batches):
            columns, first = tokens(batch.column("text"), model.order)
            p, c = look.probabilities(columns)
            base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
            sums = [np.add.reduceat(x, first[:-1]) for x in (base, np.log10(p), (c > 0).astype(np.int64))]
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first)), pa.array(sums[2]), pa.array(np.full(size, n)), pa.array(sums[0]), pa.array(sums[1])], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """One row: perplexity per token of the model and of the base, over the given scored documents."""
    each = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.agg(each("score").alias("perplexity"), each("base_score").alias("base_perplexity"))


def train_and_score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Train on the rows that aren't held out and score all rows."""
    model = train(docs.where(~held_out(F.col("doc_id"))), order=order)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

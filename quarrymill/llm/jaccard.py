"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

The product of the document by shingle incidence matrix with its transpose, in blocks, with bounds that leave
out what cannot reach the threshold:

1. Equal sets are one row of the matrix: a document is known by the hash of its set.
2. Only a row's prefix can decide whether two rows meet at all. For a set of n shingles in a fixed global order
   that is its first n - ceil(0.8 n) + 1. The order puts frequent shingles last, by the counts of 2 ** 20 hash
   buckets over all documents (a table of fixed size), so common passages stay out of the prefixes.
3. Blocks of prefix postings meet by shingle. Pairs accumulate the number of shingles their prefixes share. A pair
   with sizes outside 0.8 goes; so does one whose shared prefix shingles are fewer than its sizes demand:
   common >= 4 (n1 + n2) / 9 and at most max(n1 - p1, n2 - p2) of them lie behind the prefixes.
4. The rest is verified with whole sets. First every row with its best partner; what these links already join
   needs no more comparison. Then all remaining pairs of different components. A shingle with more than
   `LARGE` rows gives only pairs with its hub at first: the row with fewest rarer shingles before it, so the text
   that others were edited from. In the second round it gives pairs across components, and of these only such as
   can share enough: two rows share no more prefix shingles than either has in common with any row at all.
   So a group of copies is compared with its hub and not with itself.
5. Connected components of the verified links.

No shingle, hub or group of copies has to fit a task. The postings of a shingle in a bucket with more than a fair
share of all shingles are salted by set, and the hubs of its salts meet afterwards; there are at most as many such
buckets as partitions. In the second round a hub with more than a fair share of the rows is dealt by shingle to as many
places, a shingle with more by pairs of blocks of its rows. The number of partitions follows the number of shingles.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text of fewer than five words is one shingle. Shingles
and sets are known by 64-bit hashes. Cases: null text and text without words have an empty set and are linked
with nothing; repeated rows have equal sets and are linked; a null doc_id takes part but is never the least
id of a component (a component of null ids only has a null id). Empty tables give no rows. Other columns are
ignored (classify) or kept (keep_one).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .blocks import SPACE, arrow_rows, discard, files_for, lower, mix, released, slices, stored, utf8, window_hash, word_hash, words

WIDTH = 5
LARGE = 8
FAIR = 1.0  # times an even share of a partition, beyond which a shingle, hub or bucket is split
SHINGLES = 8 << 20  # a partition stands for at most so many shingles of documents
IDS = 1 << 20  # a file of kept ids has about so many at most
_BUCKET_BITS = 20
_ROWS_OF_COUNTS = 64
_POSTING = np.dtype([("h", "<u8"), ("sig", "<i8"), ("n", "<u4"), ("at", "<u4"), ("salt", "<u4")])  # salt: 0 for none


def required(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Least intersection of sets of these sizes at a similarity of 0.8."""
    return -(-4 * (n1 + n2) // 9)


def prefix_size(n):
    return n - (4 * n + 4) // 5 + 1


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    data, offsets = utf8(column)
    data = lower(data)
    starts, ends, first = words(data, offsets, SPACE)
    h = word_hash(data, starts, ends)
    all_shingles = window_hash(h, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(all_shingles[a : b - width + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            out.append(window_hash(h[a:b], b - a) + np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> int:
    """A set's hash, as a signed 64-bit number."""
    return int(mix(np.array([np.add.reduce(mix(s)) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _buckets(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)


_FIRST = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("row", pa.int32()), ("counts", pa.binary())])


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n and sig of every document, and rows of bucket counts of the tasks' distinct sets (row not null)."""

    def run(batches):
        counts, seen = np.zeros(1 << _BUCKET_BITS, np.int32), set()
        for batch in slices(batches):
            rows = []
            for s in shingle_sets(batch.column("text")):
                sig = signature(s) if len(s) else None
                rows.append((len(s), sig))
                if sig is not None and sig not in seen:
                    seen.add(sig)
                    np.add.at(counts, _buckets(s), 1)
            size = len(rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True)), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], schema=_FIRST)
        parts = counts.reshape(_ROWS_OF_COUNTS, -1)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64())] * 3 + [pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], schema=_FIRST)

    return stored(docs.mapInArrow(released(run), "doc_id long, n long, sig long, row int, counts binary"), "shingle-sets")


def frequencies(described: DataFrame) -> np.ndarray:
    """Distinct sets (a task's copies count once) of every hash bucket: 2 ** 20 numbers at any input size."""

    def add(batches):
        total = {}
        for batch in batches:
            for row, counts in zip(batch.column("row").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(counts, np.int32) if len(counts) == 4 << (_BUCKET_BITS - 6) else np.frombuffer(counts, np.int64)
                total[row] = total.get(row, 0) + part.astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["row", "counts"])

    summed = described.where("row is not null").select("row", "counts").mapInArrow(released(add), "row int, counts binary").repartition("row").mapInArrow(released(add), "row int, counts binary")
    counts = np.zeros((_ROWS_OF_COUNTS, (1 << _BUCKET_BITS) // _ROWS_OF_COUNTS), np.int64)
    for r in summed.collect():
        counts[r.row] += np.frombuffer(r.counts, np.int64)
    return counts.ravel()


def frequency_levels(counts: np.ndarray) -> np.ndarray:
    """Level of every bucket: 0 up to twice the mean count, then half powers of two."""
    share = counts / max(counts.mean(), 1e-9)
    return np.where(share < 2, 0, np.minimum(np.floor(np.log2(np.maximum(share, 1)) * 2) - 1, 15)).astype(np.uint8)


def salts_of(counts: np.ndarray, parts: int) -> np.ndarray:
    """Into how many salts the postings of each bucket go: one, or as many as it has even shares of a partition."""
    return np.ceil(np.maximum(counts / max(counts.sum() / parts * FAIR, 1), 1)).astype(np.uint32)


_PAIRS_SQL = "kind int, x long, y long, nx long, ny long, votes long, h long"
_PAIRS = pa.schema([("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("nx", pa.int64()), ("ny", pa.int64()), ("votes", pa.int64()), ("h", pa.int64())])
_PAIR, _STAR, _LARGE_ROW, _SHARED, _SALTED_ROW = 0, 1, 2, 3, 4


def _summed(x, y, nx, ny, votes, kind):
    """Pairs with x < y, one row each, votes added up."""
    turn = x > y
    x, y, nx, ny = np.where(turn, y, x), np.where(turn, x, y), np.where(turn, ny, nx), np.where(turn, nx, ny)
    if not len(x):
        return
    order = np.lexsort((y, x))
    x, y, nx, ny, votes = x[order], y[order], nx[order], ny[order], votes[order]
    at = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    n = len(at)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(c[at].astype(np.int64)) for c in (x, y, nx, ny)), pa.array(np.add.reduceat(votes, at)), pa.array(np.zeros(n, np.int64))], schema=_PAIRS)


def _near_sizes(a, b):
    return 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)


def meet_prefixes(docs: DataFrame, counts: np.ndarray, parts: int, files: int | None = None) -> DataFrame:
    """Candidate pairs with their shared prefix shingles, pairs with the hub of a large shingle, and the rows of large shingles.

    A salted shingle counts as large; its rows (kind _SALTED_ROW) have the hub of their salt."""
    tables = docs.sparkSession.sparkContext.broadcast((frequency_levels(counts), salts_of(counts, parts)))

    def post(batches):
        held, size, seen = [], 0, set()
        levels, salts = tables.value

        def pack():
            records = np.concatenate(held)
            part = (((records["h"] >> np.uint64(8)) + mix(records["salt"].astype(np.uint64))) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, records = part[order], records[order]
            edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
            yield pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]], pa.int32()), pa.array([records[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], names=["part", "block"])

        for batch in slices(batches):
            for s in shingle_sets(batch.column("text")):
                n = len(s)
                sig = signature(s) if n else None
                if not n or sig in seen:
                    continue
                seen.add(sig)
                # 4 bits of level, then 60 of hash: one number is both the order and the name of a shingle
                buckets = _buckets(s)
                key = (levels[buckets].astype(np.uint64) << np.uint64(60)) | (mix(s) >> np.uint64(4))
                p = prefix_size(n)
                first = np.argpartition(key, p - 1)[:p] if p < n else np.arange(n)[:p]
                first = first[np.argsort(key[first])]
                out = np.empty(len(first), _POSTING)
                out["h"], out["sig"], out["n"], out["at"] = key[first], sig, n, np.arange(len(first))
                many = salts[buckets[first]]
                own = int(mix(np.array([sig % (1 << 64)], np.uint64))[0] >> np.uint64(32))
                out["salt"] = np.where(many > 1, 1 + own % many, 0)
                held.append(out)
                size += len(out)
            if size >= 1 << 20:
                yield from pack()
                held, size = [], 0
        if size:
            yield from pack()

    def settle(blocks):
        r = np.concatenate([np.frombuffer(b, _POSTING) for b in blocks])
        r = r[np.lexsort((r["sig"], r["salt"], r["h"]))]
        r = r[np.append(True, (r["h"][1:] != r["h"][:-1]) | (r["sig"][1:] != r["sig"][:-1]))]
        head = np.flatnonzero(np.append(True, (r["h"][1:] != r["h"][:-1]) | (r["salt"][1:] != r["salt"][:-1])))
        m = np.diff(np.append(head, len(r)))
        salted = r["salt"][head] > 0
        sig, n = r["sig"], r["n"].astype(np.int64)
        xs, ys = [], []
        for size in np.unique(m[(m > 1) & (m <= LARGE) & ~salted]).tolist():
            base = head[(m == size) & ~salted]
            i, j = np.triu_indices(size, 1)
            for a in range(0, len(base), max(1, (1 << 19) // len(i))):
                b = base[a : a + max(1, (1 << 19) // len(i)), None]
                x, y = (b + i).ravel(), (b + j).ravel()
                near = _near_sizes(n[x], n[y])
                xs.append(x[near]), ys.append(y[near])
        if xs:
            x, y = np.concatenate(xs), np.concatenate(ys)
            yield from _summed(sig[x], sig[y], n[x], n[y], np.ones(len(x), np.int64), _PAIR)
        shared, times = np.unique(sig[np.repeat((m > 1) | salted, m)], return_counts=True)
        c = len(shared)
        if c:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(c, _SHARED, np.int32)), pa.array(shared), *[pa.nulls(c, pa.int64())] * 3, pa.array(times), pa.nulls(c, pa.int64())], schema=_PAIRS)
        xs, ys = [], []
        for k in np.flatnonzero((m > LARGE) | salted).tolist():
            own = np.arange(head[k], head[k] + m[k])
            hub = own[np.lexsort((mix(sig[own].view(np.uint64)), r["at"][own]))[0]]
            near = own[(own != hub) & _near_sizes(n[own], n[hub])]
            xs.append(near), ys.append(np.full(len(near), hub))
            c = len(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(c, _SALTED_ROW if salted[k] else _LARGE_ROW, np.int32)), pa.array(sig[own]), pa.array(np.full(c, sig[hub])), pa.array(n[own]), pa.array(r["at"][own].astype(np.int64)), pa.nulls(c, pa.int64()), pa.array(r["h"][own].view(np.int64))], schema=_PAIRS)
        if xs:
            x, y = np.concatenate(xs), np.concatenate(ys)
            yield from _summed(sig[x], sig[y], n[x], n[y], np.ones(len(x), np.int64), _STAR)

    def match(batches):
        held, now = [], None
        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if part != now:
                    if held:
                        yield from settle(held)
                    held, now = [], part
                held.append(block)
        if held:
            yield from settle(held)

    posted = docs.mapInArrow(released(post), "part int, block binary").repartition(parts, "part").sortWithinPartitions("part")
    return stored(posted.mapInArrow(released(match), _PAIRS_SQL), "candidate-pairs", files)


def with_hubs(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (h, sig, n, at, hub) of large shingles with one hub a shingle, and pairs of the salts' hubs with it.

    Only a bucket with over a fair share of all shingles is salted and all its shingles' salts have a hub, so what the join broadcasts is at most a few rows for each salt of such a bucket."""
    columns = [F.col("h"), F.col("x").alias("sig"), F.col("nx").alias("n"), F.col("ny").alias("at"), F.col("y").alias("hub")]
    plain, salted = (found.where(F.col("kind") == k).select(columns) for k in (_LARGE_ROW, _SALTED_ROW))
    hubs = salted.where("sig = hub").select("h", "sig", "n", "at")
    best = hubs.groupBy("h").agg(F.min_by(F.struct("sig", "n"), F.struct("at", F.xxhash64("sig"), "sig")).alias("b")).select("h", F.col("b.sig").alias("best"), F.col("b.n").alias("nb"))
    stars = hubs.join(best, "h").where("sig <> best").select(F.lit(_STAR).alias("kind"), F.least("sig", "best").alias("x"), F.greatest("sig", "best").alias("y"), F.when(F.col("sig") < F.col("best"), F.col("n")).otherwise(F.col("nb")).alias("nx"), F.when(F.col("sig") < F.col("best"), F.col("nb")).otherwise(F.col("n")).alias("ny"), F.lit(1).cast("long").alias("votes"))
    whole = salted.drop("hub").join(best.select("h", F.col("best").alias("hub")), "h")
    return plain.unionByName(whole), stars


def places(rows: DataFrame, large: DataFrame, parts: int) -> DataFrame:
    """rows with a place each: hub and number, and for a hot shingle a pair of blocks (low, high) and the row's own one.

    large: the same rows as they were found. More than an even share of them have at most parts / FAIR hubs, and as many shingles: that bounds
    what is broadcast. A hot shingle's hub is hot too, so only rows of hot hubs are counted by shingle."""
    fair = max(1.0, large.count() / parts * FAIR)
    hot = lambda frame, c: frame.groupBy(c).agg((F.count(F.lit(1)) / fair).alias("_share")).where("_share > 1")
    hubs = hot(large, "hub").select("hub", F.ceil("_share").alias("_spread"))
    shingles = hot(large.join(F.broadcast(hubs.select("hub")), "hub", "left_semi"), "h").select("h", F.ceil(F.sqrt("_share")).alias("_blocks"))
    out = rows.join(F.broadcast(hubs), "hub", "left").join(F.broadcast(shingles), "h", "left")
    out = out.withColumn("place", F.pmod(F.xxhash64("h"), F.coalesce("_spread", F.lit(1)))).withColumn("own", F.pmod(F.xxhash64("sig"), F.coalesce("_blocks", F.lit(1))))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_blocks", F.lit(1)).cast("long") - 1)))
    return out.withColumn("low", F.least("own", "_other")).withColumn("high", F.greatest("own", "_other")).drop("_spread", "_blocks", "_other")


def across_components(rows: DataFrame, parts: int) -> DataFrame:
    """Pairs of rows (h, sig, n, at, label, shared, hub, main, under and a place) of a large shingle that are in different components, with shared shingles counted.

    shared: how many prefix shingles a row has in common with any other row; hub: the shingle's; main: the hub under which the row
    stands most often, `under` times. Two rows with one main hub share at most the lesser `under` there. Where that isn't enough they
    have to meet under another hub or a small shingle too, so they aren't paired here (and `under` is added to what is counted there).
    at: the shingle's place in the row's order. What two rows share before it is in both prefixes, so no more than the lesser `shared`;
    from it on they share no more than the shorter rest."""

    def settle(sig, n, at, label, shared, hub, main, under, own, low, high):
        if label[0] == label[-1]:  # sorted by label
            return
        behind = n - prefix_size(n)
        home = main == hub
        step = max(1, (1 << 20) // len(sig))
        for a in range(0, len(sig), step):
            i, j = np.arange(a, min(a + step, len(sig)))[:, None], np.arange(a, len(sig))[None, :]
            good = (label[i] != label[j]) & (j > i) & _near_sizes(n[i], n[j])
            if low[0] != high[0]:
                good &= own[i] != own[j]
            i, j = np.nonzero(good)
            i, j = i + a, j + a
            bound = required(n[i], n[j]) - np.maximum(behind[i], behind[j])
            least = np.minimum(shared[i], shared[j])
            reach = least + np.minimum(n[i] - at[i], n[j] - at[j])
            keep = (reach >= required(n[i], n[j])) & (least >= bound) & (~(home[i] & home[j]) | (np.minimum(under[i], under[j]) >= bound))
            i, j = i[keep], j[keep]
            if len(i):
                yield sig[i], sig[j], n[i], n[j]

    def run(batches):
        held, now, out, size = [], None, [], 0
        names = ("sig", "n", "at", "label", "shared", "hub", "main", "under", "own", "low", "high")

        def flush():
            table = pa.Table.from_batches(held)
            return settle(*(table.column(c).to_numpy() for c in names))

        def give():
            x, y, nx, ny = (np.concatenate(c) for c in zip(*out, strict=True))
            yield from _summed(x, y, nx, ny, np.ones(len(x), np.int64), _PAIR)

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("h", "low", "high")])
            edges = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    if held and (keys[:, a] != now).any():
                        for found in flush():
                            out.append(found)
                            size += len(found[0])
                            if size > 1 << 20:
                                yield from give()
                                out, size = [], 0
                        held = []
                    now = keys[:, a]
                    held.append(batch.slice(a, b - a))
        if held:
            out += flush()
        if out:
            yield from give()

    # Shingles of one hub mostly hold the same rows: in one place for each hub their pairs are added up before they move.
    return rows.repartition(parts, "hub", "place", "low", "high").sortWithinPartitions("hub", "h", "low", "high", "label").mapInArrow(released(run), _PAIRS_SQL)


def _possible(pairs: DataFrame, mains: DataFrame | None = None) -> DataFrame:
    """Pairs whose shared prefix shingles are enough for their sizes; mains (sig, main, under) adds what pairs may share under a hub."""
    total = pairs.groupBy("x", "y").agg(F.max("nx").alias("nx"), F.max("ny").alias("ny"), F.sum("votes").alias("votes"), F.max("kind").alias("kind"))
    behind = lambda n: F.expr(f"(4 * {n} + 4) div 5 - 1")  # noqa: E731  n - prefix_size(n)
    if mains is not None:
        left, right = (mains.select(F.col("sig").alias(c), F.col("main").alias(f"_m{c}"), F.col("under").alias(f"_u{c}")) for c in ("x", "y"))
        more = F.when(F.col("_mx") == F.col("_my"), F.least("_ux", "_uy")).otherwise(0)
        total = total.join(left, "x", "left").join(right, "y", "left").withColumn("votes", F.col("votes") + F.coalesce(more, F.lit(0))).select("x", "y", "nx", "ny", "votes", "kind")
    return total.where((F.col("kind") == _STAR) | (F.col("votes") >= F.expr("(4 * (nx + ny) + 8) div 9") - F.greatest(behind("nx"), behind("ny"))))


def _by_hub(pairs: DataFrame, degrees: DataFrame, parts: int) -> DataFrame:
    """hub, salt, partner: of each pair the set with more pairs is the hub. A hub with more pairs than an even share of a partition has them under several salts."""
    fair = max(1.0, pairs.count() / parts * FAIR)
    table = degrees.select("sig", "n")
    known = looked_up(looked_up(pairs.select("x", "y"), "x", table.select(F.col("sig").alias("x"), F.col("n").alias("nx")), "nx", fair), "y", table.select(F.col("sig").alias("y"), F.col("n").alias("ny")), "ny", fair)
    first = (F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    rows = known.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("hub"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("partner"), F.greatest("nx", "ny").alias("n"))
    return rows.select("hub", F.pmod(F.xxhash64("partner"), F.ceil(F.col("n") / F.lit(fair))).alias("salt"), "partner")


def verify(docs: DataFrame, pairs: DataFrame, parts: int, files: int | None = None) -> DataFrame:
    """The pairs (x, y) of sets that are similar: a, b. Sets are taken from the documents whose signature a filter lets through.

    A hub's set goes to a task once for each of its salts, its partners' sets stream past it."""
    spark = docs.sparkSession
    degrees = stored(pairs.select(F.explode(F.array("x", "y")).alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("n")), "degrees", files)
    wanted = degrees.select("sig")
    size = wanted.count()
    # One bit for each of 16 slots a wanted signature, 2 ** 27 bits (16 MB) at most. Beyond that more sets pass and are dropped by the join.
    bits = min(1 << 27, max(1 << 13, 1 << int(max(size, 1) * 16 - 1).bit_length()))

    def mark(batches):
        found = np.zeros(bits // 8, np.uint8)
        any_row = False
        for batch in batches:
            slot = (batch.column("sig").to_numpy().view(np.uint64) % np.uint64(bits)).astype(np.int64)
            np.bitwise_or.at(found, slot >> 3, np.uint8(1) << (slot & 7).astype(np.uint8))
            any_row |= len(slot) > 0
        if any_row:
            some = np.flatnonzero(found.reshape(-1, 1024).any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([found[1024 * i : 1024 * i + 1024].tobytes() for i in some.tolist()], pa.binary())], names=["row", "bits"])

    mask = np.zeros(bits // 8, np.uint8)
    for r in wanted.coalesce(16).mapInArrow(released(mark), "row long, bits binary").toLocalIterator():
        mask[1024 * r.row : 1024 * r.row + 1024] |= np.frombuffer(r.bits, np.uint8)
    shared = spark.sparkContext.broadcast(mask)

    def take(batches):
        filter_bits, seen = shared.value, set()
        for batch in slices(batches):
            rows = []
            for s in shingle_sets(batch.column("text")):
                if not len(s):
                    continue
                sig = signature(s)
                slot = sig % (1 << 64) % bits
                if filter_bits[slot >> 3] >> (slot & 7) & 1 and sig not in seen:
                    seen.add(sig)
                    rows.append((sig, s.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["sig", "items"])

    def compare(batches):
        now, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for hub, salt, partner, items in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own = np.frombuffer(items, np.uint64)
                if partner is None:  # a hub's set comes before its partners
                    now, held = (hub, salt), own
                elif now == (hub, salt):
                    at = np.searchsorted(held, own)
                    at[at == len(held)] = 0
                    if 9 * int((held[at] == own).sum()) >= 4 * (len(held) + len(own)):
                        a.append(hub), b.append(partner)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sets = docs.mapInArrow(released(take), "sig long, items binary")
    sets = sets.groupBy("sig").agg(F.first("items").alias("items"))  # copies in several tasks send equal sets
    rows = stored(_by_hub(pairs, degrees, parts), "hub-pairs", files)
    partners = rows.join(sets.withColumnRenamed("sig", "partner"), "partner").select("hub", "salt", "partner", "items")
    hubs = rows.select("hub", "salt").distinct().join(sets.withColumnRenamed("sig", "hub"), "hub").select("hub", "salt", F.lit(None).cast("long").alias("partner"), "items")
    both = hubs.unionByName(partners).repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", F.asc_nulls_first("partner"))
    links = stored(both.mapInArrow(released(compare), "a long, b long"), "links", files)
    discard(degrees, rows)
    return links


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    spark = docs.sparkSession
    arrow_rows(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = describe(docs)
    total = described.agg(F.sum("n")).first()[0] or 0
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHINGLES))
    files = files_for(spark, -(-total // SHINGLES))
    found = meet_prefixes(docs, frequencies(described), parts, files)
    large, stars = with_hubs(found)
    columns = ["kind", "x", "y", "nx", "ny", "votes"]
    pairs = stored(_possible(found.where(F.col("kind").isin(_PAIR, _STAR)).select(columns).unionByName(stars)), "possible-pairs", files)
    # Round one: every row with the hub, or else the partner, that shares most of its prefix.
    each = pairs.select(F.col("x").alias("v"), "kind", "x", "y", "votes").unionByName(pairs.select(F.col("y").alias("v"), "kind", "x", "y", "votes"))
    best = each.groupBy("v").agg(F.max_by(F.struct("x", "y"), F.struct("kind", "votes", "x", "y")).alias("p")).select("p.x", "p.y").distinct()
    best = stored(best, "best-pairs", files)
    links = verify(docs, best, parts, files)
    labels = connected_components(links, files=files)
    # Round two: what is still apart.
    label_of = lambda c, name: labels.select(F.col("node").alias(c), F.col("label").alias(name))
    under = large.groupBy("sig", "hub").agg(F.count(F.lit(1)).alias("under"))
    mains = under.groupBy("sig").agg(F.max_by(F.struct("hub", "under"), F.struct("under", "hub")).alias("m")).select("sig", F.col("m.hub").alias("main"), F.col("m.under").alias("under"))
    mains = stored(mains, "main-hubs", files)
    shared = found.where(F.col("kind") == _SHARED).groupBy(F.col("x").alias("sig")).agg(F.sum("votes").alias("shared"))
    known = large.join(shared, "sig").join(mains, "sig").join(label_of("sig", "label"), "sig", "left")
    placed = places(known.select("h", "sig", "n", "at", F.coalesce("label", "sig").alias("label"), "shared", "hub", "main", "under"), large, parts)
    rest = found.where(F.col("kind") == _PAIR).select(columns).unionByName(across_components(placed, parts).select(columns))
    rest = _possible(rest, mains).join(label_of("x", "lx"), "x", "left").join(label_of("y", "ly"), "y", "left")
    rest = rest.where(F.coalesce("lx", "x") != F.coalesce("ly", "y")).select("x", "y").join(best, ["x", "y"], "left_anti")
    rest = stored(rest, "remaining-pairs", files)
    discard(found, pairs, best, mains)
    if not rest.isEmpty():
        more = verify(docs, rest, parts, files)
        labels = connected_components(links.unionByName(more), files=files)
        discard(more)
    discard(rest, links)
    rows = described.where("row is null").select("doc_id", "n", "sig")
    fair = max(1.0, rows.count() / parts * FAIR)
    rows = looked_up(rows, "sig", labels.select(F.col("node").alias("sig"), "label"), "label", fair).select("doc_id", "n", F.coalesce("label", "sig").alias("class"))
    rows = stored(rows, "classes", files)
    least = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return looked_up(rows, "class", least, "least", fair).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def looked_up(rows: DataFrame, key: str, table: DataFrame, value: str, fair: float) -> DataFrame:
    """rows with the value that table (a row for each key) has for their key, null for none.

    Keys with more than `fair` rows are at most rows / fair, so their values are broadcast; their rows, and those without a key, are dealt by hash of the row."""
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > fair).select(key)
    frequent = F.broadcast(hot.join(table, key).select(F.col(key).alias("_hot"), F.col(value).alias("_value")))
    marked = rows.join(frequent, rows[key] == F.col("_hot"), "left")
    dealt = F.when(F.col(key).isNotNull() & F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns))
    found = marked.withColumn("_key", dealt).join(table.select(F.col(key).alias("_at"), F.col(value).alias(value)), F.col("_key") == F.col("_at"), "left")
    own = F.when(F.col("_hot").isNotNull(), F.col("_value")).when(F.col("_at") == F.col(key), F.col(value))
    return found.select(*rows.columns, own.alias(value))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is the least of its component; rows without an id stay.

    Rows that share an id are kept or dropped together; of those kept, rows with the same text too are one row."""
    name, times = (_free(docs, n) for n in ("_kept", "_times"))
    kept = classify(docs).where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias(name)).agg(F.count(F.lit(1)).alias(times))
    kept = stored(kept, "kept-ids", files_for(docs.sparkSession, -(-docs.count() // IDS)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    nameless = docs.where(docs["doc_id"].isNull())
    repeated = kept.where(F.col(times) > 1).select(name)
    # Texts move once: ids that stand for several rows are looked at apart, and only where there are any.
    single = kept.where(F.col(times) == 1).select(name).hint("merge")  # the ids grow with the table: never broadcast
    out = docs.join(single, docs["doc_id"] == single[name], "left_semi").select(columns).unionByName(nameless.select(columns))
    if repeated.isEmpty():
        return out
    again = docs.join(repeated, docs["doc_id"] == repeated[name], "left_semi").select(columns)
    return out.unionByName(again.dropDuplicates(["doc_id", "text"]))


def _free(frame: DataFrame, name: str) -> str:
    """A name that no column of the frame has."""
    while name in frame.columns:
        name += "_"
    return name


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least(d.doc_id, m), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)"""

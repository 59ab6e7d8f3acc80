"""Exact top-k inner-product search by no-random-access aggregation over sorted lists.

Candidates are dealt into blocks by hash of their id, queries into blocks likewise; each pair of blocks is one
group. In a group every dimension has a sorted list of its components, with its least and greatest value in
the list head. A query reads the lists of its positive weights from the top and those of its negative weights
from the bottom, step by step and never out of order. For each candidate the sum of what has been read is kept; the
frontier values (nothing unread lies beyond them) make an upper bound of its score, the heads a lower bound. After
each step every query tests for itself whether to stop: when at most `RESOLVE` * k candidates have an upper bound
that reaches the k-th best lower bound, no outsider can qualify, and the scores of those few are resolved. (As long as
the frontier of every query stands above a quarter of its lists' heads no test is made, and two steps are read as one.) A query
that can't stop reads on, at the end to the whole lists, where both bounds are the score. All queries of a batch
read one step together: what a step reads is a masked matrix, and its product with the weights is added to the
sums. All of it is exact: integers below 2 ** 53 as doubles, or 64-bit integers beyond, which scores have to fit.

Each group returns its k best for each query; a window keeps the k best of all groups. Memory: one block of
candidates, one of queries. Nothing is broadcast or collected.

Cases: null vectors and vectors holding null, NaN or infinite components, and rows with a null id, take no
part; vectors of different lengths are padded with zeros; equal scores rank by smaller id; a query never finds
rows of its own id; fewer than k candidates give all. Repeated rows are repeated candidates; of several query rows
with one id the one with the least vector is the query. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import arrow_rows

K = 20
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 2048
RESOLVE = 4
BATCH = 256


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    inf = float("inf")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | x.cast("double").isin(inf, -inf))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    values = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def depths(n: int) -> list[int]:
    """How far lists of n entries have been read after each step: doubling up to a half, then halving what is left."""
    parts = [n >> k for k in range(6, 0, -1)] + [n - (n >> k) for k in range(2, 8)]
    return sorted({max(1, d) for d in parts} | {n})


class Lists:
    """The sorted lists of a block of candidates: ranks and values by dimension, and their two heads."""

    def __init__(self, c: np.ndarray):
        self.c, self.n = c, len(c)
        order = np.argsort(c, axis=0, kind="stable")
        self.values = np.take_along_axis(c, order, 0)
        self.rank = np.empty(c.shape, np.int64)
        np.put_along_axis(self.rank, order, np.arange(self.n)[:, None], 0)
        self.least, self.greatest = self.values[0], self.values[-1]

    def read(self, was: int, now: int) -> tuple[np.ndarray, np.ndarray]:
        """The entries that lie between two depths, from the top and from the bottom; zero elsewhere."""
        top = (self.rank >= self.n - now) & (self.rank < self.n - was)
        bottom = (self.rank >= was) & (self.rank < now)
        return np.where(top, self.c, 0), np.where(bottom, self.c, 0)

    def bounds(self, depth: int, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest contribution of what is unread at a depth, (candidate, query)."""
        top, bottom = (self.rank < self.n - depth).astype(self.c.dtype), (self.rank >= depth).astype(self.c.dtype)
        lower = top @ (up * self.least).T + bottom @ (down * self.greatest).T
        upper = top @ (up * self.values[self.n - depth]).T + bottom @ (down * self.values[depth - 1]).T
        return lower, upper


def block_topk(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score, share of the lists read) of the k best candidates of each query in one block."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    if max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0)) * q.shape[1] * 2 >= 2**53:
        q, c = q.astype(np.int64), c.astype(np.int64)
    lists, n = Lists(c), len(c)
    # Ranks of a query's own rows: candidates are in id order.
    own = np.searchsorted(c_ids, q_ids, side="left"), np.searchsorted(c_ids, q_ids, side="right")
    live = np.arange(len(q))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    sums = np.zeros((n, len(q)), c.dtype)
    out: list[tuple[np.ndarray, ...]] = []
    was = 0
    opened = up @ lists.greatest + down @ lists.least
    for now in depths(n):
        frontier = up @ lists.values[n - now] + down @ lists.values[now - 1]
        if now < n and n > RESOLVE * k and (frontier * 4 > opened[live]).all():
            continue  # what is unread still reaches too far: the next step reads on from here
        top, bottom = lists.read(was, now)
        sums += top @ up.T + bottom @ down.T
        was = now
        lower, upper = lists.bounds(now, up, down)
        lower, upper = sums + lower, sums + upper
        others = np.ones(upper.shape, bool)
        for j in np.flatnonzero(own[1][live] > own[0][live]).tolist():
            others[own[0][live[j]] : own[1][live[j]], j] = False
        kth = np.full(len(live), np.iinfo(np.int64).min, np.float64)
        if n > k:
            bound = np.where(others, lower.astype(np.float64), -np.inf)
            kth = np.partition(bound, n - k, axis=0)[n - k]
        alive = others & (upper >= kth)
        stop = (alive.sum(axis=0) <= RESOLVE * k) if now < n else np.ones(len(live), bool)
        if stop.any():
            where, rows = np.nonzero(alive[:, stop].T)
            scores = np.concatenate([np.einsum("ij,ij->i", q[live[stop]][where[a : a + (1 << 16)]], c[rows[a : a + (1 << 16)]]) for a in range(0, len(where), 1 << 16)] or [np.zeros(0)]).astype(np.int64)
            by = np.lexsort((c_ids[rows], -scores, where))
            where, rows, scores = where[by], rows[by], scores[by]
            place = np.arange(len(where)) - np.searchsorted(where, where)
            best = place < k
            out.append((q_ids[live[stop]][where[best]], c_ids[rows[best]], scores[best], np.full(int(best.sum()), now / n)))
            live, up, down, sums = live[~stop], up[~stop], down[~stop], sums[:, ~stop]
        if not len(live):
            break
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("depth", pa.float64())])


def topk(queries: DataFrame, candidates: DataFrame, k: int = K, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK, with_depth: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates (id long, vec array<long>) of every query (id long, vec array<long>).

    with_depth adds `depth`: the share of its lists that the query read in the block where it found the row."""
    spark = candidates.sparkSession
    arrow_rows(spark)
    queries = queries.groupBy(F.col("id").alias("query_id")).agg(F.min("vec").alias("weights"))
    size = candidates.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    nq = queries.count()
    g, b, width = max(1, -(-size.n // candidate_block)), max(1, -(-nq // query_block)), max(size.d or 1, 1)
    dealt = lambda c, n: F.pmod(F.xxhash64(c, F.lit(7)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query_id", "weights", dealt("query_id", b).alias("qb")).select("query_id", "weights", "qb", every(g).alias("cb"))
    right = candidates.select("id", "vec", dealt("id", g).alias("cb")).select("id", "vec", "cb", every(b).alias("qb"))

    def run(a: pa.Table, c: pa.Table) -> pa.Table:
        if not a.num_rows or not c.num_rows:
            return _OUT.empty_table()
        ids, c_ids, vectors = a.column("query_id").to_numpy(), c.column("id").to_numpy(), _matrix(c.column("vec"), width)
        out = [block_topk(ids[s : s + BATCH], _matrix(a.column("weights").slice(s, BATCH), width), c_ids, vectors, k) for s in range(0, a.num_rows, BATCH)]
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=_OUT)

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(run, "query_id long, vec_id long, score long, depth double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *["depth"] * with_depth)


def search_every_20th(embeddings: DataFrame, k: int = K, with_depth: bool = False) -> DataFrame:
    """Queries: ids divisible by 20; candidates: all rows."""
    rows = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("vec"))
    return topk(rows.where(F.col("id") % 20 == 0), rows, k, with_depth=with_depth)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""

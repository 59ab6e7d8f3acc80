"""Centroid clustering in whole numbers: float32 screening with rigorous rounding bounds, exact decisions.

Components become whole numbers floor(64 x). A batch's dot products with the centroids are one float32 matrix product. Its
rounding error is bounded for any order of summation: with unit roundoff u = 2^-24 and d terms, conversion of both
factors included, |error| <= g |x| |c| with g = (d + 2) u / (1 - (d + 2) u). So each centroid has an interval for
|c|^2 - 2 x.c. Where one centroid's upper end lies under all others' lower ends, it is the nearest; wherever intervals
overlap, these centroids' distances are recomputed with exact integers, ties going to the smaller number.

Every round is one pass: partitions add up counts and sums of their clusters, Spark adds these (at most clusters x
dimensions rows a partition), and the driver, which only ever holds the centroids, divides with floor. Sums are kept as
two halves, so they are exact for any number of rows.

Cases: vectors that are null, have another number of components than asked for, or hold null or non-finite ones take no
part and give no rows; an empty table gives none; with fewer vectors than clusters there are as many centroids as
vectors. Repeated ids and repeated rows each take part (starting centroids of equal hashes are ordered by their
components). Components beyond 2^61 are set to that bound; a distance or sum that exceeds a long is null. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import stored
from .whitening import vectors

DIM, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
_FAR = 1 << 61
_U = 2.0**-24


def whole(entries: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale x) as longs."""
    return np.clip(np.floor(entries * scale), -_FAR, _FAR).astype(np.int64)


def _exact(x: np.ndarray, c: np.ndarray) -> list[int]:
    """Squared distances of rows x to rows c, pairwise by row, as Python's whole numbers where a long could overflow."""
    if not len(x):
        return []
    reach = int(np.abs(x).max()) + int(np.abs(c).max())
    if x.shape[1] * reach**2 < 1 << 63:
        return ((x - c) ** 2).sum(axis=1).tolist()
    d = x.astype(object) - c.astype(object)
    return (d * d).sum(axis=1).tolist()


def screen(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of |c|^2 - 2 x.c for every row and centroid."""
    g = (x.shape[1] + 2) * _U / (1 - (x.shape[1] + 2) * _U)
    xd, cd = x.astype(np.float64), centroids.astype(np.float64)
    dot = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    square = (cd * cd).sum(axis=1)
    reach = np.sqrt((xd * xd).sum(axis=1))[:, None] * np.sqrt(square)[None, :]
    # The second term covers the doubles themselves: norms, squares and this sum of d terms.
    wide = 2 * g * reach * (1 + 2.0**-30) + (x.shape[1] + 8) * 2.0**-50 * (square[None, :] + reach)
    middle = square[None, :] - 2 * dot
    return middle - wide, middle + wide


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, list[int], int]:
    """Number of the nearest centroid, exact squared distance to it, and how many rows took exact comparisons."""
    if not len(x):
        return np.zeros(0, np.int64), [], 0
    if max(np.abs(x).max(), np.abs(centroids).max()) < 1 << 57:  # squares of norms stay finite in float32
        low, high = screen(x, centroids)
        possible = low <= high.min(axis=1, keepdims=True)
    else:
        possible = np.ones((len(x), len(centroids)), bool)
    cluster = possible.argmax(axis=1)
    open_ = np.flatnonzero(possible.sum(axis=1) > 1)
    row, number = np.nonzero(possible[open_])
    least: dict[int, tuple[int, int]] = {}
    for r, k, d in zip(row.tolist(), number.tolist(), _exact(x[open_[row]], centroids[number]), strict=True):
        if r not in least or (d, k) < least[r]:
            least[r] = (d, k)
    for r, (_, k) in least.items():
        cluster[open_[r]] = k
    return cluster, _exact(x, centroids[cluster]), len(open_)


def first_centroids(frame: DataFrame, clusters: int, dim: int, seed: str = "1") -> np.ndarray:
    """The vectors with the smallest SHA-256 of `seed:id`, in that order."""
    usable = F.size("embedding") == dim
    usable &= ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = frame.where(F.col("vec_id").isNotNull() & usable).select(order.alias("h"), F.col("embedding").cast("array<double>").alias("embedding")).orderBy("h", "embedding").limit(clusters).collect()
    return whole(np.array([r.embedding for r in rows], float).reshape(-1, dim))


def updated(frame: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every vector to its nearest centroid, non-empty centroids to the floor of their vectors' means."""
    clusters, dim = centroids.shape

    def run(batches):
        count, high, low = np.zeros(clusters, np.int64), np.zeros((clusters, dim), np.int64), np.zeros((clusters, dim), np.int64)
        for batch in batches:
            x = whole(vectors(batch.column(0), dim)[2])
            at = nearest(x, centroids)[0]
            count += np.bincount(at, minlength=clusters)
            np.add.at(high, at, x >> 32)
            np.add.at(low, at, x & 0xFFFFFFFF)
        for k in np.flatnonzero(count).tolist():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, k)), pa.array(np.arange(dim)), pa.array(np.full(dim, count[k])), pa.array(high[k]), pa.array(low[k])], names=["cluster", "i", "n", "high", "low"])

    sums = frame.select("embedding").mapInArrow(run, "cluster long, i long, n long, high long, low long").groupBy("cluster", "i").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])
    out = centroids.copy()
    for r in sums.collect():  # clusters x dimensions rows
        out[r.cluster, r.i] = ((r.high << 32) + r.low) // r.n
    return out


def assigned(frame: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (null beyond a long) of every vector that takes part."""
    dim = centroids.shape[1]

    def run(batches):
        for batch in batches:
            _, rows, entries = vectors(batch.column(1), dim)
            cluster, distance, _ = nearest(whole(entries), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(cluster.astype(np.int32)), pa.array([d if d < 1 << 63 else None for d in distance], pa.int64())], names=["vec_id", "cluster", "distance"])

    return frame.select("vec_id", "embedding").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM) -> tuple[DataFrame, np.ndarray]:
    """The assignment of every vector and the final centroids."""
    frame = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    centroids = first_centroids(frame, clusters, dim)
    if len(centroids):
        for _ in range(rounds):
            centroids = updated(frame, centroids)
    return assigned(frame, centroids if len(centroids) else np.zeros((1, dim), np.int64)), centroids


def report(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    rows, centroids = cluster(embeddings)
    spark = embeddings.sparkSession
    rows = stored(rows, "clusters")
    held = {r.cluster: (r.whole, int(r.total or 0)) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.every(F.col("distance").isNotNull()).alias("whole")).collect()}  # a row a cluster
    fits = lambda known, total: total if known and total < 1 << 63 else None
    all_of = fits(all(w for w, _ in held.values()), sum(t for _, t in held.values()))
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    table = spark.createDataFrame([(k, fits(*held.get(k, (False, 0))), all_of, d) for k, d in enumerate(digest)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a cluster is broadcast


def _oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM) -> str:
    squares = "list_sum(list_transform(range(1, {d} + 1), lambda i: (v.x[i] - c.x[i])::HUGEINT * (v.x[i] - c.x[i])))".format(d=dim)
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INTEGER AS cluster, x FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {clusters}))",
    ]
    for t in range(rounds + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, cluster, distance FROM (SELECT v.r, c.cluster, {squares} AS distance FROM v, c{t} c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)")
        if t < rounds:
            parts.append(f"m{t} AS (SELECT cluster, i, sum(x[i]::HUGEINT) AS s, count(*) AS n FROM a{t} JOIN v USING (r), range(1, {dim} + 1) g(i) GROUP BY cluster, i)")
            # s - ((s % n) + n) % n is the largest multiple of n that s isn't below.
            parts.append(f"n{t} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM m{t} GROUP BY cluster)")
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.x, c.x) AS x FROM c{t} c LEFT JOIN n{t} n USING (cluster))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} c USING (cluster)"""


ORACLE_SQL = _oracle_sql()

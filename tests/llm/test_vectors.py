"""Whitening and centroid clustering against brute force in exact numbers, and their edge cases."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from quarrymill.llm import centroids, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors_table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def noise(rng, n, dim, spread=1.0):
    return [[float(np.float32(rng.gauss(0, spread) * (1 + (k % 5)))) for k in range(dim)] for _ in range(n)]


ODD = [(900, None), (901, []), (902, [None, 1.0, 2.0]), (903, [float("nan"), 1.0, 2.0]), (904, [float("inf"), 1.0, 2.0]), (905, [1.0, 2.0])]


def test_scatter_is_exact_in_residues():
    rng = np.random.default_rng(3)
    x = rng.integers(-(10**9), 10**9, (40_000, 3))
    moduli = whitening.primes(len(x) * 10**18)
    wide = [[sum(int(a) * int(b) for a, b in zip(u, v)) for v in ([1] * len(x), *x.T.tolist())] for u in ([1] * len(x), *x.T.tolist())]
    parts = [whitening.residue_products(x, p) for p in moduli]
    assert [[whitening.remainder([int(q[i, j]) for q in parts], moduli) for j in range(4)] for i in range(4)] == wide
    assert all(p < 1 << 20 and all(p % q for q in range(2, math.isqrt(p) + 1)) for p in moduli) and len(set(moduli)) == len(moduli)


def test_whitening_against_exact_numbers(spark):
    rng = random.Random(5)
    rows = [*enumerate(noise(rng, 60, 10)), *ODD]
    got = whitening.report(vectors_table(spark, rows).repartition(5)).toPandas()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for i, v in rows if i < 900]
    n, dim = len(x), 10
    s = [sum(r[k] for r in x) for k in range(dim)]
    cov = [[Fraction(sum(r[i] * r[j] for r in x) * n - s[i] * s[j], n * n) for j in range(dim)] for i in range(dim)]
    values, axes = np.linalg.eigh(np.array([[float(v) for v in row] for row in cov]))
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == n * 8 and set(got.n) == {n} and got.identity_error.max() < 1e-9
    trace = float(sum(cov[k][k] for k in range(dim)))
    centred = np.array([[float(Fraction(r[k] * n - s[k], n)) for k in range(dim)] for r in x])
    for c in range(1, 9):
        part = got[got.component == c].sort_values("vec_id")
        assert part.deviation.tolist() == [sum((n * r[k] - s[k]) ** 2 for k in range(dim)) for r in x]
        want = centred @ axes[:, c - 1] / math.sqrt(values[c - 1])
        sign = 1 if np.dot(want, part.whitened) > 0 else -1
        assert np.allclose(part.whitened, sign * want, atol=1e-9) and np.allclose(part.explained, values[c - 1] / trace, rtol=1e-9)


def test_whitening_of_little_and_of_nothing(spark):
    assert whitening.report(vectors_table(spark, ODD[:5])).count() == 0 and whitening.report(vectors_table(spark, [])).count() == 0
    one = whitening.report(vectors_table(spark, [(1, [0.5, 2.0])])).toPandas()
    assert one.deviation.tolist() == [0, 0] and one.whitened.isna().all() and one.identity_error.isna().all() and one.explained.tolist() == [0, 0]
    # Two of three entries move together: the third component has no variance.
    flat = whitening.report(vectors_table(spark, [(i, [float(i), float(2 * i), float((i * i) % 7)]) for i in range(20)] * 2)).toPandas()
    assert len(flat) == 120 and flat[flat.component == 3].whitened.isna().all() and flat[flat.component < 3].whitened.notna().all() and flat.identity_error.max() < 1e-9


def test_whitening_of_huge_entries_and_clashing_columns(spark):
    rows = [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [5.0, 3.0])]
    frame = spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], "vec_id long, embedding array<double>, n int, deviation int, component double")
    got = whitening.report(frame).toPandas()
    assert len(got) == 6 and got[got.vec_id != 3].deviation.isna().all() and got[got.component == 1].whitened.notna().all()
    assert set(got[got.vec_id == 3].deviation) == {(3 * 105120 - 305120) ** 2 + 3072**2}


def test_deviation_near_the_range_of_a_long():
    model = whitening.Whitening(1, [0, 0], [[0, 0], [0, 0]], np.zeros(2), np.eye(2), 3 * 10**9)
    edge = math.isqrt((1 << 63) - 1)
    x = np.array([[edge, 0], [edge + 1, 0], [edge, 10**5], [3 * 10**9, 3 * 10**9], [7, 1]])
    want = [sum(v * v for v in r) for r in x.tolist()]
    assert whitening.deviations(x, model)[1] == [v if v < 1 << 63 else None for v in want]


def clustering_truth(rows, clusters=16, rounds=3, dim=64):
    x = [(i, [math.floor(64 * c) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    key = lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted((r for r in x if r[0] is not None), key=key)[:clusters]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), k) for k, w in enumerate(c))
    for _ in range(rounds):
        at = [assign(v)[1] for _, v in x]
        for k in range(len(c)):
            held = [v for (_, v), a in zip(x, at) if a == k]
            if held:
                c[k] = [sum(col) // len(held) for col in zip(*held)]
    done = [(i, *assign(v)) for i, v in x]
    inertia = {k: sum(d for _, d, a in done if a == k) for k in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), sha[k]) for i, d, k in done), key=repr)


@pytest.mark.parametrize("n, spread", [(80, 0.2), (200, 3.0), (9, 1.0)])
def test_clusters_against_brute_force(spark, n, spread):
    rng = random.Random(n)
    rows = [*enumerate(noise(rng, n, 64, spread)), (None, [0.5] * 64), (3, [0.25] * 64), *((i, [0.125] * 64) for i in range(500, 520)), *ODD]
    got = centroids.report(vectors_table(spark, rows).repartition(4))
    assert sorted(map(tuple, got.collect()), key=repr) == clustering_truth(rows)


def test_clusters_of_nothing_and_of_huge_components(spark):
    assert centroids.report(vectors_table(spark, ODD)).count() == 0
    rows = [(i, [float(k == i) * 1e5 for k in range(64)]) for i in range(20)]
    got = centroids.report(vectors_table(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == clustering_truth(rows)
    rng = random.Random(7)
    far = centroids.report(vectors_table(spark, [(i, [rng.choice([-3e38, 0.0, 3e38]) for _ in range(64)]) for i in range(40)])).collect()
    assert len(far) == 40 and any(r.distance is None for r in far) and all(r.inertia is None for r in far)


def test_intervals_hold_the_exact_values_and_screening_decides_most():
    rng = np.random.default_rng(1)
    for size in (30, 10**4, 10**8, 10**15):
        x, c = rng.integers(-size, size, (300, 64)), rng.integers(-size, size, (16, 64))
        c[3] = c[2]  # a tie for every row
        low, high = centroids.screen(x, c)
        exact = [[sum(b * b - 2 * a * b for a, b in zip(r, k)) for k in c.tolist()] for r in x.tolist()]
        assert all(lo <= e <= hi for los, his, es in zip(low.tolist(), high.tolist(), exact) for lo, hi, e in zip(los, his, es))
        at, distance, recomputed = centroids.nearest(x, c)
        want = [min((sum((a - b) ** 2 for a, b in zip(r, k)), i) for i, k in enumerate(c.tolist())) for r in x.tolist()]
        assert [(d, k) for d, k in zip(distance, at.tolist())] == want and (at != 3).all()
        assert recomputed < 100  # only rows next to the tied pair, and close calls


def test_vectors_reads_sliced_lists():
    column = pa.array([[9.0], [1.0, 2.0], None, [3.0, None], [], [5.0, 6.0], [float("nan"), 1.0]], pa.list_(pa.float32())).slice(1)
    size, rows, entries = whitening.vectors(column, 2)
    assert size.tolist() == [2, -1, -1, -1, 2, -1] and rows.tolist() == [0, 4] and entries.tolist() == [[1.0, 2.0], [5.0, 6.0]]

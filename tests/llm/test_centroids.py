import hashlib
import math

import numpy as np
import pytest

from vetch.llm import centroids as C


def brute(rows, k, rounds):
    """rows of (vec_id, vector); every distance in Python's whole numbers."""
    kept = [(i, [math.floor(256 * x) if abs(x) < 2**53 else int(x) * 256 for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"2:{x[0]}".encode()).hexdigest(), x[1]))
    cs = [v for _, v in (first + sorted(x for x in kept if x[0] is None))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(cs)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                cs[j] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, *near(v)) for i, v in kept]
    total = [sum(d for _, d, j in out if j == c) for c in range(len(cs))]
    most = lambda x: min(x, 2**63 - 1)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i is None, i or 0, j, most(d), most(total[j]), most(sum(most(d) for _, d, _ in out)), sha[j]) for i, d, j in out))


def got(df):
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def test_sql(spark, small, duck, same_rows):
    assert same_rows(C.op13_centroids(spark, small), duck, C.ORACLE_OP13) > 0


def test_by_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (9, 64))
    rows = [(k, (centres[k % 9] + rng.normal(0, 0.2, 64)).tolist()) for k in range(400)] + [(k, (rng.integers(-1, 2, 64) / 128).tolist()) for k in range(400, 500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert got(C.clusters(df, k=12)) == brute(rows, 12, C.ROUNDS)


SCHEMA = "vec_id long, embedding array<double>, cluster int, upper string, lower string, distance string, was string, digest string, label string"


def test_odd_rows(spark):
    line = lambda x: [float(x)] * 64
    rows = [(1, line(1)), (2, None), (3, [1.0] * 63), (4, [None, *line(1)[1:]]), (5, [float("nan"), *line(1)[1:]]), (6, [float("-inf"), *line(1)[1:]]), (None, line(2)), (7, line(1)), (7, line(1)), (8, line(3)), (9, line(-0.001)), (9, line(4)), (10, [])]
    make = lambda rs: spark.createDataFrame([(i, v, 5, "x", "x", "x", "x", "x", "x") for i, v in rs], SCHEMA)
    assert got(C.clusters(make(rows), k=4)) == brute(rows, 4, C.ROUNDS)
    assert got(C.clusters(make(rows))) == brute(rows, 40, C.ROUNDS)
    assert got(C.clusters(make(rows), k=1)) == brute(rows, 1, C.ROUNDS)
    assert got(C.clusters(make(rows), k=2)) == brute(rows, 2, C.ROUNDS)
    assert C.clusters(make(rows).limit(0)).count() == 0
    assert C.clusters(make([(2, None), (3, [1.0])])).count() == 0


def test_huge_components(spark):
    rows = [(k, [float(x)] * 63 + [float(k)]) for k, x in enumerate([0, 1, 1e300, 1.5e300, -1e300, 3e38, 2**19, 1e6, 2e6])]
    assert got(C.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3)) == brute(rows, 3, C.ROUNDS)


@pytest.mark.parametrize("seed", range(3))
def test_bounds_spare_scans_and_change_nothing(seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(-900, 900, (20, 64))[np.arange(3000) % 20] + rng.integers(-99, 99, (3000, 64))
    c = v[:20] + rng.integers(-200, 200, (20, 64))
    cluster, first, second = C.scan(v, c)
    upper, lower, held = C.up(C.root(first)), C.down(C.root(second)), []
    for _ in range(6):
        new = np.array([v[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()) if (cluster == j).any() else c[j] for j in range(20)])
        drift = C.drifts(c, new)
        c = new
        most = np.array([np.delete(drift, j).max() for j in range(20)])
        cluster, upper, lower, n = C.settle(v, c, cluster, upper + drift[cluster], lower - most[cluster], C.half_gaps(c))
        held.append(n)
        assert (cluster == C.scan(v, c)[0]).all()
    assert held[-1] < len(v) / 2

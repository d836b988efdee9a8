"""Clustering vectors around centroids by Hamerly's bounds, in whole numbers.

Each vector carries an upper bound of the distance to its centroid and a lower bound of that to the second nearest. When centroids
move, the bounds are loosened by how far; only a vector whose bounds then meet is held against its own centroid again, and only if they still
meet against all. Bounds are floating-point numbers with a margin for their rounding, so they only ever spare work: whatever they
leave open is decided by exact squared distances in whole numbers.

Vectors with their bounds are written to the shared folder after each round, and the round before it is deleted. Sums
of a cluster are kept up by the vectors that changed places alone. The driver holds the centroids, k x 64 numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, kept_table, table

SIZE, K, ROUNDS, SCALE, SALT = 64, 40, 5, 256, "2:"
#: Components up to this fit sums of squares in 64 bits; batches with larger ones are worked out in Python's whole numbers.
FITS = 1 << 27
MOST = 2**63 - 1
#: Vectors that are held against all centroids at a time.
BLOCK = 1024
#: Cluster sums travel in limbs of so many bits, whose sums over all tasks fit in 64.
LIMB = 40
STATE = "vec_id long, embedding array<double>, cluster int, was int, upper double, lower double, distance long"


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) for each x: as 64-bit numbers where all are small, else as Python's."""
    scaled = np.floor(values * SCALE)
    if not scaled.size or np.abs(scaled).max() <= FITS:
        return scaled.astype(np.int64)
    exact = lambda x: int(x) * SCALE if abs(x) >= 2.0**53 else int(np.floor(x * SCALE))
    return np.array([exact(x) for x in values.ravel().tolist()], dtype=object).reshape(values.shape)


def centroid_array(centroids: list[list[int]]) -> np.ndarray:
    small = all(abs(x) <= FITS for c in centroids for x in c)
    return np.array(centroids, dtype=np.int64 if small else object)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of vectors to centroids, pairwise along the last axis."""
    if v.dtype != c.dtype:
        v, c = v.astype(object), c.astype(object)
    d = v - c
    return (d * d).sum(axis=-1)


def root(d: np.ndarray) -> np.ndarray:
    """Square roots as floating-point numbers, infinite where one is too large."""
    if d.dtype != object:
        return np.sqrt(d.astype(np.float64))
    whole_root = [math.isqrt(x) for x in d.ravel().tolist()]
    return np.array([float(x) + (x > 0) if x < 1 << 1000 else np.inf for x in whole_root]).reshape(d.shape)


def up(x: np.ndarray) -> np.ndarray:
    """A little more than x: more than the rounding of a root and of a few sums."""
    return x * (1 + 1e-9) + 1e-6


def down(x: np.ndarray) -> np.ndarray:
    """As much less, and no more than 1e300, so that what is too large stays a lower bound."""
    return np.minimum(x, 1e300) * (1 - 1e-9) - 1.1


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each centroid moved, at least."""
    return up(root(squared(old, new)))


def half_gaps(c: np.ndarray) -> np.ndarray:
    """Half of each centroid's distance to the nearest other one, at most: a vector nearer than that has no nearer centroid."""
    if len(c) == 1:
        return np.array([np.inf])
    far = np.array([root(squared(np.delete(c, j, 0), x)).min() for j, x in enumerate(c)])
    return down(far / 2)


def scan(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (of ties the smaller number), its squared distance, and that of the second nearest."""
    d = np.concatenate([squared(v[k : k + BLOCK, None, :], c[None, :, :]) for k in range(0, len(v), BLOCK)])
    near = d.argmin(axis=1)
    rows = np.arange(len(v))
    first = d[rows, near]
    if len(c) == 1:
        return near, first, np.full(len(v), np.inf)
    rest = d.copy()
    rest[rows, near] = MOST if d.dtype != object else d.max() + 1
    return near, first, rest.min(axis=1)


def settle(v: np.ndarray, c: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster and bounds of each vector for the centroids c, given bounds already loosened; and how many were held against all."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    bound = np.maximum(lower, gaps[cluster])
    open_ = np.flatnonzero(upper >= bound)
    upper[open_] = up(root(squared(v[open_], c[cluster[open_]])))
    open_ = open_[upper[open_] >= bound[open_]]
    if len(open_):
        near, first, second = scan(v[open_], c)
        cluster[open_], upper[open_], lower[open_] = near, up(root(first)), down(root(second))
    return cluster, upper, lower, len(open_)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)


def _assigned(centroids: list[list[int]], moved: list[float] | None, last: bool):
    """Assigns vectors to the centroids, by bounds if moved tells how far each centroid has come since they were set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroid_array(centroids)
        gaps, drift = half_gaps(c), np.array(moved if moved is not None else [0.0])
        most = np.array([np.delete(drift, j).max(initial=0.0) for j in range(len(c))]) if moved is not None else None
        for batch in batches:
            if not batch.num_rows:
                continue
            v = whole(_vectors(batch))
            if moved is None:
                was = np.full(len(v), -1)
                cluster, first, second = scan(v, c)
                upper, lower = up(root(first)), down(root(second))
            else:
                was = batch.column("cluster").to_numpy(zero_copy_only=False)
                upper = batch.column("upper").to_numpy(zero_copy_only=False) + drift[was]
                lower = batch.column("lower").to_numpy(zero_copy_only=False) - most[was]
                cluster, upper, lower, _ = settle(v, c, was, upper, lower, gaps)
            exact = [min(MOST, int(x)) for x in squared(v, c[cluster])] if last else None
            columns = [batch.column("vec_id"), batch.column("embedding"), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(upper, pa.float64()), pa.array(lower, pa.float64()), pa.array(exact, pa.int64()) if last else pa.nulls(len(v), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in STATE.split(", ")])

    return run


def _limbs(x: int) -> list[int]:
    sign, x, out = (-1 if x < 0 else 1), abs(x), []
    while x:
        out.append(sign * (x & ((1 << LIMB) - 1)))
        x >>= LIMB
    return out


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What vectors that changed places add to the sums of clusters: rows (cluster, dim, limb, value), and their number as dim -1."""
    sums: dict[int, list[int]] = {}
    for batch in batches:
        v = whole(_vectors(batch))
        for column, sign in (("cluster", 1), ("was", -1)):
            of = batch.column(column).to_numpy(zero_copy_only=False)
            for j in np.unique(of[of >= 0]).tolist():
                mine = sums.setdefault(j, [0] * (SIZE + 1))
                mine[0] += sign * int((of == j).sum())
                for d, s in enumerate(v[of == j].sum(axis=0).tolist(), 1):
                    mine[d] += sign * s
    rows = [(j, d - 1, k, x) for j, s in sums.items() for d, total in enumerate(s) for k, x in enumerate(_limbs(total))]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "dim", "limb", "value"])


def _add(sums: list[list[int]], state: DataFrame) -> None:
    """Brings the clusters' sums (the number first) up to date."""
    changed = state.where("cluster <> was").select("embedding", "cluster", "was").mapInArrow(_changes, "cluster int, dim int, limb int, value long")
    for r in changed.groupBy("cluster", "dim", "limb").agg(F.sum("value").alias("value")).collect():  # k x 65 numbers, of a few limbs each
        sums[r["cluster"]][r["dim"] + 1] += r["value"] << (LIMB * r["limb"])


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows whose vector has SIZE components, all of them finite numbers."""
    x = F.col("embedding").cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") == SIZE) & F.forall("embedding", finite))


def starts(kept: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of salt and vec_id; of rows with one id by their components; rows without an id last."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = kept.select(digest.alias("digest"), "embedding").orderBy(F.asc_nulls_last("digest"), "embedding").limit(k).collect()
    return [whole(np.array(r["embedding"], np.float64)).tolist() for r in rows]


def _at(values: list, cluster: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[cluster]


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, salt: str = SALT) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept row of vectors (vec_id, embedding).

    Rows whose vector is null, of another length, or has a null or non-finite component are left out. Repeated rows and equal vectors
    count each; of ties the smaller centroid's number wins; with fewer than k vectors all of them are centroids, equal ones among
    them, and those that get no vector stay where they are. Rows without a vec_id start no cluster unless there are fewer than k others. Squared
    distances and their sums beyond a long are given as the largest long. An empty table gives no rows; other columns are not used.
    """
    kept = kept_vectors(vectors)
    centroids = starts(kept, k, salt)
    if not centroids:
        return kept.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    sums = [[0] * (SIZE + 1) for _ in centroids]
    state, moved = kept, None
    for n in range(rounds + 1):
        new = kept_table(state.mapInArrow(_assigned(centroids, moved, n == rounds), STATE))
        if n:
            drop_table(state)
        state = new
        if n < rounds:
            _add(sums, state)
            old, centroids = centroids, [[x // s[0] for x in s[1:]] if s[0] else c for c, s in zip(centroids, sums)]
            moved = drifts(centroid_array(old), centroid_array(centroids)).tolist()
    total = [0] * len(centroids)
    for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect():  # a row for each centroid
        total[r["cluster"]] = int(r["s"])
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    at = F.col("cluster")
    return state.select("vec_id", "cluster", "distance", _at([min(MOST, x) for x in total], at).cast("long").alias("cluster_inertia"), F.lit(min(MOST, sum(total))).cast("long").alias("inertia"), _at(shas, at).alias("centroid_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clusters of all embeddings; odd rows as stated there."""
    return clusters(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The rounds as chained tables, each distance and each floor worked out in full."""
    floor = "CAST((s - ((s % n) + n) % n) / n AS BIGINT)"
    near = "SELECT vec_id, v, arg_min(j, ROW(d, j)) AS j, min(d) AS d FROM (SELECT a.vec_id, a.rn, a.v, c.j, list_sum(list_transform(list_zip(a.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM k a, {c} c) GROUP BY vec_id, rn, v"
    parts = [
        "k AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rn, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS j, v FROM k ORDER BY 1 LIMIT 40)",
    ]
    for n in range(ROUNDS):
        parts.append(f"a{n} AS MATERIALIZED ({near.format(c=f'c{n}')})")
        parts.append(f"s{n} AS (SELECT j, dim, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range(64)) AS dim FROM a{n}) GROUP BY j, dim)")
        parts.append(f"m{n} AS (SELECT j, list({floor} ORDER BY dim) AS v FROM s{n} GROUP BY j)")
        parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m USING (j))")
    parts.append(f"f AS MATERIALIZED ({near.format(c=f'c{ROUNDS}')})")
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(f.j AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY f.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM f JOIN c{ROUNDS} c USING (j)"


ORACLE_OP13 = _oracle()

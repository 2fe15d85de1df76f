"""Ball k-means over integer vectors: exact assignments with few exact comparisons.

A cluster is a ball: its centroid and a radius that none of its members passes.
A centroid is a neighbour of another if it lies within twice the other's
radius; no member can be nearer to one that doesn't. A member nearer to its
centroid than half the way to the closest neighbour is in the stable core and
stays without a comparison. Others lie in the annulus between half the distance
to one neighbour and to the next, and are compared with the neighbours up to
there only. All of it is in integers, so ties and bounds are exact.

A round is two jobs: every task reassigns its vectors and writes them, then
componentwise sums, combined in each task first, give the next centroids. The
driver holds the centroids and k rows of sums, whatever the input. A lost
executor costs a task of one round, as each round reads a written table.
"""

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, ShortType, StructType

from lodestream.llm.shared import discard, materialise, ship

#: Components are floor(SCALE * x).
SCALE = 1024


def largest(dim: int) -> int:
    """Largest size of an integer component: four times a squared distance still fits 64 bits."""
    return isqrt(((1 << 63) - 1) // (16 * dim))


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, v): vectors with exactly ``dim`` components, none null or not finite, as integers floor(1024 * x); others are left out.

    A component beyond ``largest(dim)`` (92,000 before scaling, for 64) raises,
    as distances would pass 64 bits.
    """
    limit = largest(dim)
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    fits = lambda c: F.when(F.abs(c) <= limit, c.cast("int")).otherwise(F.raise_error(F.lit(f"a component is above {limit // SCALE}")).cast("int"))
    v = F.transform(x, lambda c: fits(F.floor(c * SCALE)))
    return rows.where(x.isNotNull() & (F.size(x) == dim) & finite).select(F.col(id_col).alias("id"), v.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``<seed>:<id>``, in that order; those without an id only after all others, by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _root_up(n: int) -> int:
    r = isqrt(n)
    return r + (r * r < n)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Balls:
    """Centroids with, per cluster, its neighbours by distance; without radii every other centroid is a neighbour."""

    def __init__(self, centroids: np.ndarray, radii: list[int] | None = None):
        self.centroids = centroids
        between = np.array([_squares(centroids, c) for c in centroids])
        self.near, self.far = [], []
        for i, row in enumerate(between):
            order = np.lexsort((np.arange(len(row)), row))
            order = order[order != i]
            if radii is not None:  # distance <= 2 * radius, squared
                order = order[[int(row[j]) <= 4 * radii[i] * radii[i] for j in order]] if len(order) else order
            self.near.append(order)
            self.far.append(row[order])

    def assign(self, v: np.ndarray, cluster: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, squared distance, centroids compared) of each vector; ties go to the smaller number."""
        if cluster is None:  # no balls yet
            best, dist = np.zeros(len(v), np.int64), _squares(v, self.centroids[0][None, :])
            for j in range(1, len(self.centroids)):
                d = _squares(v, self.centroids[j][None, :])
                closer = d < dist
                best[closer], dist[closer] = j, d[closer]
            return best, dist, np.full(len(v), len(self.centroids), np.int16)
        best, dist = cluster.copy(), np.empty(len(v), np.int64)
        compared = np.ones(len(v), np.int16)
        for i in np.unique(cluster):
            rows = np.flatnonzero(cluster == i)
            own = _squares(v[rows], self.centroids[i][None, :])
            annulus = np.searchsorted(self.far[i], 4 * own, side="right")  # 0: the stable core
            number, nearest = np.full(len(rows), i, np.int64), own.copy()
            for step in range(int(annulus.max(initial=0))):
                some = np.flatnonzero(annulus > step)
                j = int(self.near[i][step])
                d = _squares(v[rows[some]], self.centroids[j][None, :])
                closer = (d < nearest[some]) | ((d == nearest[some]) & (j < number[some]))
                nearest[some[closer]], number[some[closer]] = d[closer], j
            best[rows], dist[rows], compared[rows] = number, nearest, annulus + 1
        return best, dist, compared


def _assign(balls: Balls, first: bool):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v")
            wide = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            before = None if first else batch.column("cluster").to_numpy().astype(np.int64)
            best, dist, compared = balls.assign(wide, before)
            columns = [batch.column("id"), v, pa.array(best, pa.int32()), pa.array(dist, pa.int64()), pa.array(compared, pa.int16())]
            yield pa.record_batch(columns, ["id", "v", "cluster", "distance", "compared"])

    return run


def _sums(table: DataFrame, dim: int) -> dict[int, tuple[int, int, list[int]]]:
    """Per cluster: members, largest squared distance, componentwise sums (exact; beyond 64 bits Spark raises)."""
    part = lambda i: F.sum(F.get("v", F.lit(i)).cast("bigint"))
    rows = table.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"), F.array(*map(part, range(dim))).alias("sums")).collect()
    return {r["cluster"]: (r["n"], r["far"], r["sums"]) for r in rows}


def ball_kmeans(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64) -> DataFrame:
    """Per kept vector: id, cluster, distance (squared), compared, cluster_inertia, inertia, centroid_sha256.

    Vectors are those of ``integer_vectors``; k of them start as centroids
    (``first_centroids``). In each round every vector goes to the nearest
    centroid (ties: the smaller number), then each centroid that has vectors
    becomes their componentwise floor(sum / count); an empty one stays. Then
    vectors are assigned once more. Rounds after one that moved no centroid
    would change nothing and are left out.

    Null, short, long and not finite vectors give no row. Repeated rows are
    vectors of their own, equal ones fall into one cluster. A null id is kept.
    With fewer than k vectors there are fewer centroids, with none no rows.
    Only the two named columns are read, so others may have any name.
    ``compared`` counts the centroids a vector was compared with in the last
    assignment: 1 in the stable core.
    """
    ship(rows.sparkSession)
    vectors = materialise(integer_vectors(rows, id_col, vector_col, dim), "vectors")
    out = StructType().add(vectors.schema["id"]).add("v", ArrayType(IntegerType())).add("cluster", IntegerType()).add("distance", LongType()).add("compared", ShortType())
    named = lambda df, *more: df.select(F.col("id").alias(id_col), "cluster", "distance", "compared", *more)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        none = vectors.sparkSession.createDataFrame([], out)
        return named(none, F.lit(0).cast("bigint").alias("cluster_inertia"), F.lit(0).cast("bigint").alias("inertia"), F.lit("").alias("centroid_sha256"))

    table, balls, moved = vectors, Balls(centroids), True
    for round_ in range(rounds + 1):
        done = table
        table = materialise(done.mapInArrow(_assign(balls, first=round_ == 0), out), "assigned")
        discard(done)
        if round_ == rounds or not moved:
            break
        sums, new = _sums(table, dim), centroids.copy()
        for i, (n, _, total) in sums.items():
            new[i] = [s // n for s in total]
        # the old ball moved along with its centroid holds all members
        shifts = _squares(new, centroids).tolist()
        radii = [_root_up(sums[i][1]) + _root_up(shifts[i]) if i in sums else 0 for i in range(len(new))]
        moved, centroids, balls = any(shifts), new, Balls(new, radii)

    inertia = {r["cluster"]: r["s"] for r in table.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    return named(
        table,
        _by_cluster({i: F.lit(s).cast("bigint") for i, s in inertia.items()}).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"),
        _by_cluster({i: F.lit(digest(c)) for i, c in enumerate(centroids)}).alias("centroid_sha256"),
    )


def _by_cluster(values: dict[int, Column]) -> Column:
    return F.element_at(F.create_map(*(x for i, v in values.items() for x in (F.lit(i), v))), F.col("cluster"))

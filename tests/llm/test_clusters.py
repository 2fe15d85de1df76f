import hashlib

import numpy as np
import pytest

from lodestream.llm.clusters import Balls, ball_kmeans, largest
from lodestream.llm.registry import ORACLES, QUERIES
from tests.compare import oracle_rows, spark_rows

SCHEMA = "vec_id bigint, embedding array<double>"


def brute(rows, k, rounds, dim, seed=3):
    """Every vector against every centroid, in Python integers."""
    kept = [(i, [int(np.floor(1024 * x)) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and np.isfinite(x) for x in e)]
    keyed = sorted((i is None, "" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, _, v in keyed[:k]]
    square = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for t in range(rounds + 1):
        got = [min((square(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if t < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, at) in zip(kept, got) if at == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    inertia = {j: sum(d for d, at in got if at == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, got)), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.drop("compared").collect()), key=repr)


def test_query_agrees_with_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert spark_rows(QUERIES["op11_ball_kmeans"](spark, sf_dir)) == oracle_rows(sf_dir, ORACLES["op11_ball_kmeans"])


@pytest.mark.parametrize("k,points", [(4, 60), (9, 40), (3, 2)])
def test_against_brute_force(spark, k, points):
    """A coarse grid, so that many distances tie, with copies and odd rows."""
    rng = np.random.default_rng(k)
    rows = [(i, (rng.integers(-3, 4, 3) / 2).tolist()) for i in range(points)]
    rows += [rows[0], rows[0], (None, [0.5, 0.5, 0.5]), (None, [0.5, 0.5, 0.5]), (900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0] * 4), (904, [1.0, None, 2.0]), (905, [float("nan"), 1.0, 2.0]), (906, [float("-inf"), 1.0, 2.0])]
    got = ball_kmeans(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k, rounds=5, dim=3)
    assert rows_of(got) == brute(rows, k, 5, 3)


def test_most_vectors_are_compared_with_few_centroids(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(0, 0.05, 4) + 10 * (i % 6 + 1) * np.eye(4)[i % 4]).tolist()) for i in range(300)]
    got = ball_kmeans(spark.createDataFrame(rows, SCHEMA), k=6, rounds=4, dim=4)
    assert rows_of(got) == brute(rows, 6, 4, 4)
    assert got.where("compared = 1").count() > 100


def test_bounds_leave_no_nearer_centroid_out():
    rng = np.random.default_rng(2)
    centroids, v = rng.integers(-50, 50, (12, 5)), rng.integers(-50, 50, (500, 5))
    before = rng.integers(0, 12, 500)
    own = ((v - centroids[before]) ** 2).sum(1)
    radii = [int(np.ceil(np.sqrt(own[before == i].max(initial=0)))) for i in range(12)]
    best, dist, compared = Balls(centroids, radii).assign(v, before)
    every = ((v[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (dist == every.min(1)).all() and compared.min() >= 1


def test_empty_tables_and_clashing_columns(spark):
    names = ["vec_id", "cluster", "distance", "compared", "inertia", "centroid_sha256"]
    empty = ball_kmeans(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and set(names) <= set(empty.columns)
    odd = spark.createDataFrame([(1, [1.0, 2.0], "a", "b", "c", "d"), (2, [1.0, 2.0], "a", "b", "c", "d")], "vec_id bigint, embedding array<double>, v string, id string, cluster string, DISTANCE string")
    assert [r["cluster"] for r in ball_kmeans(odd, k=2, dim=2).collect()] == [0, 0]


def test_a_component_beyond_the_bound_raises(spark):
    with pytest.raises(Exception, match="component is above"):
        ball_kmeans(spark.createDataFrame([(1, [1.0, 2.0 * largest(2)])], SCHEMA), dim=2)

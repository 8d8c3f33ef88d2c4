import hashlib
import math

import numpy as np
import pytest

from tessera.llm import balls, queries
from tests.compare import assert_same, connect
from tests.llm.helpers import SF


def lloyd(rows, k=8, rounds=10):
    """(id, vector of whole numbers) rows by plain exact rounds in Python numbers: clusters, distances, centroids."""
    named = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), np.array(v, np.int32).tobytes(), v) for i, v in rows)
    centroids = [list(v) for _, _, v in named[:k]]
    square = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((square(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in rows:
            members[near(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, centroids, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in rows], centroids


def rows_of(frame):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in frame.collect())


def test_same_as_sql(spark):
    assert_same(queries.QUERIES["op12_ball_clusters"](spark, SF), connect(SF), balls.ORACLE)


@pytest.mark.parametrize("spread", (0, 0.002, 0.02, 0.5))
def test_same_as_plain_rounds(spark, spread):
    """Points on few grid values (many ties, equal centroids) and in blobs of several widths."""
    draw = np.random.default_rng(7)
    blobs = draw.normal(size=(8, 4))
    points = (blobs[draw.integers(0, 8, 400)] + spread * draw.normal(size=(400, 4))) if spread else draw.integers(-2, 3, (400, 4)) / 1024
    rows = [(int(i) if i % 50 else None, p.tolist()) for i, p in enumerate(points)]
    rows += rows[:30]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got, centroids = balls.ball_clusters(frame, dimensions=4)
    want, plain = lloyd([(i, [math.floor(1024 * x) for x in v]) for i, v in rows])
    assert rows_of(got) == sorted((-1 if i is None else i, c, d) for i, c, d in want)
    assert centroids.tolist() == plain


def test_far_clusters_are_not_compared():
    draw = np.random.default_rng(1)
    centres = 10_000 * draw.integers(-9, 9, (30, 8))
    cluster = draw.integers(0, 30, 3_000)
    vectors = centres[cluster] + draw.integers(-50, 50, (3_000, 8))
    got, distance, taken = balls.reassign(vectors, cluster, centres)
    assert (got == cluster).all() and (distance == ((vectors - centres[cluster]) ** 2).sum(1)).all()
    assert taken == 3_000  # the own centroid only: all members are in the stable core
    wrong = np.zeros(3_000, np.int64)
    got, _, taken = balls.reassign(vectors, wrong, centres)
    assert (got == ((vectors[:, None] - centres[None]) ** 2).sum(2).argmin(1)).all() and taken <= 30 * 3_000


def test_odd_vectors(spark):
    draw = np.random.default_rng(2)
    good = [(i, draw.normal(size=64).tolist(), 5, "x") for i in range(20)]
    large = [(100, [1e300] * 64, 5, "x"), (101, [-1e300] + [0.0] * 63, 5, "x"), (102, [1e-300] * 64, 5, "x")]
    bad = [(30, None, 1, "x"), (31, [], 1, "x"), (32, [1.0] * 63, 1, "x"), (33, [None] + [1.0] * 63, 1, "x"), (34, [math.nan] * 64, 1, "x"), (35, [math.inf] * 64, 1, "x")]
    frame = spark.createDataFrame(good + large + bad + [(None, [0.5] * 64, 1, "x")], "vec_id long, embedding array<double>, cluster int, distance string")
    out = balls.clusters_digest(frame)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(-1 if r.vec_id is None else r.vec_id for r in out.collect()) == [-1, *range(20), 100, 101, 102]
    assert balls.clusters_digest(frame.limit(0)).collect() == []
    few, centroids = balls.ball_clusters(frame.filter("vec_id < 3"))
    assert len(centroids) == 3 and [r.distance for r in few.collect()] == [0, 0, 0]

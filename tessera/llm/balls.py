"""Ball k-means: exact Lloyd rounds that compare a vector only with the centroids whose balls can reach it.

Components are whole numbers, so every comparison is exact. A cluster is a ball round its new centroid; its
radius is that of the members at hand (a batch in a task, whose balls are no larger than those of the whole).
Another centroid is a neighbour if half its distance does not pass the radius. Members nearer to their own
centroid than half the distance to the nearest neighbour are the stable core and are compared with nothing;
those beyond half the distance to the n-th neighbour, its annulus, are compared with the first n exactly.

A round is one pass: rows with their clusters are written to the shared folder, and beside them each task's
sums, of which the driver gets k rows of totals. The table of the round before goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, give_back, new_path

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Whole numbers are held within this limit (components of 65,536 and more), so that squared distances stay long numbers.
LIMIT = 1 << 26
ROWS = "vec_id long, vector binary, cluster int, distance long, sums array<long>"


def whole_numbers(components: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), held within ``LIMIT``."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * components), -LIMIT, LIMIT).astype(np.int32)


def reassign(vectors: np.ndarray, cluster: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (ties: smaller number), its squared distance, and how many distances were taken, given the cluster that each is in."""
    own = ((vectors - centroids[cluster]) ** 2).sum(1)
    apart = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
    nearest, distance, taken = cluster.copy(), own.copy(), len(vectors)
    for i in np.unique(cluster):
        outside = np.flatnonzero(cluster == i)
        radius = own[outside].max()
        for j in np.argsort(apart[i], kind="stable"):
            if j == i:
                continue
            if apart[i, j] > 4 * radius:
                break  # no neighbour, nor is any after it
            outside = outside[4 * own[outside] >= apart[i, j]]  # at the border a tie is possible
            to = ((vectors[outside] - centroids[j]) ** 2).sum(1)
            taken += len(outside)
            nearer = (to < distance[outside]) | ((to == distance[outside]) & (j < nearest[outside]))
            moved = outside[nearer]
            nearest[moved], distance[moved] = j, to[nearer]
    return nearest, distance, taken


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), -1).astype(np.int64)


def _round(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` (vec_id, vector, cluster) with their nearest centroid, and for each task and cluster a row without vector: number (as distance) and sums of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _vectors(batch.column("vector"))
            cluster, distance, _ = reassign(vectors, batch.column("cluster").to_numpy(), centroids)
            np.add.at(sums, cluster, vectors)
            counts += np.bincount(cluster, minlength=len(centroids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vector"), pa.array(cluster, pa.int32()), pa.array(distance), pa.nulls(len(cluster), pa.list_(pa.int64()))], [c.split()[0] for c in ROWS.split(", ")]
            )
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
                [c.split()[0] for c in ROWS.split(", ")],
            )
        give_back()

    return rows.select("vec_id", "vector", "cluster").mapInArrow(run, ROWS)


def _written(spark: SparkSession, rows: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = new_path(spark, label)
    rows.write.parquet(path, compression="zstd")
    return spark.read.schema(ROWS).parquet(path), path


def _moved(rounds: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at the floor of the means of their vectors; those without vectors stay."""
    parts = rounds.filter("vector is null").select("cluster", "distance", F.posexplode("sums").alias("place", "total"))
    totals = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("distance").alias("n"))
    out = centroids.copy()
    for r in totals.collect():  # clusters x components
        out[r.cluster, r.place] = int(r.total) // r.n
    return out


def ball_clusters(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared, in whole numbers) of each vector, and the final centroids.

    Vectors of another number of components, or with null or non-finite ones, take no part. Components become
    floor(scale * x), those past ``LIMIT`` the limit. Centroids start as the ``k`` vectors with the smallest
    sha256 of ``seed:vec_id`` (a null id counts as an empty word; equal ids stand in order of their vectors);
    with fewer vectors there are fewer centroids. Repeated rows are vectors each. Empty clusters keep their centroid.
    Without vectors the frame is empty and there is no centroid. Extra columns take no part.
    """
    spark = embeddings.sparkSession
    vector = F.col("embedding")
    fine = (F.size(vector) == dimensions) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            packed = [v.tobytes() for v in whole_numbers(flat, scale).reshape(-1, dimensions)]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary()), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], [c.split()[0] for c in ROWS.split(", ")])

    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.coalesce(fine, F.lit(False)))
    now, path = _written(spark, rows.mapInArrow(pack, ROWS), "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = np.array([np.frombuffer(r.vector, np.int32) for r in now.select("vector", name.alias("name")).orderBy("name", "vector").limit(k).collect()], np.int64).reshape(-1, dimensions)
    if len(centroids):
        for n in range(rounds + 1):
            old = path
            now, path = _written(spark, _round(now.filter("vector is not null"), centroids), "clusters")
            discard(spark, old)
            if n < rounds:
                centroids = _moved(now, centroids)
    return now.filter("vector is not null").select("vec_id", "cluster", "distance"), centroids


def clusters_digest(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part."""
    spark = embeddings.sparkSession
    rows, centroids = ball_clusters(embeddings)
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # a row for each cluster
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    whole, most = sum(int(r.total) for r in sums), (1 << 63) - 1
    known = [(r.cluster, min(int(r.total), most), min(whole, most), hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in sums]
    return rows.join(F.broadcast(spark.createDataFrame(known, schema)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds one after another, every vector against every centroid."""
    steps = []
    for n in range(ROUNDS + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (SELECT r, min(pair).d AS d, min(pair).c AS c FROM (SELECT r, {{'d': list_sum(list_transform(list_zip(k.v, c{n}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c}} AS pair FROM kept k, c{n}) GROUP BY r)"""
        )
        if n < ROUNDS:
            steps.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT c, coalesce(w, v) AS v FROM c{n} LEFT JOIN (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({DIMENSIONS})) AS i FROM a{n} JOIN kept USING (r)) GROUP BY c, i) GROUP BY c) USING (c))"""
            )
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY name) - 1 AS c, v FROM (SELECT sha256('{SEED}:' || vec_id) AS name, v FROM kept ORDER BY name LIMIT {CLUSTERS})),
{", ".join(steps)}
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN c{ROUNDS} USING (c)
"""


ORACLE = _oracle()

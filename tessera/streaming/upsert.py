"""Late revisions: a later edition replaces a value, and what a batch reads does not grow with history.

Cells are dealt to buckets by a hash of their key. ``vintage`` keeps every edition that came, a folder for each
batch. ``observation`` keeps the winners: a batch reads those of the buckets that its keys fall into, joins its rows, and writes
these buckets anew under its own version. ``manifest`` tells the version of each bucket; a batch's
manifest is put in place by one rename, last. Until then readers see the state before; a batch that is run again
after a failure writes the same folders, and one whose manifest stands is done.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ("series_key", "territory_code", "year")
OBSERVATION = "series_key string, territory_code string, year long, edition long, value double"
BUCKETS = 64


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def latest_manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, int]]:
    """The last batch that is in place (-1: none) and the version of each bucket."""
    system, where = _files(spark, f"{path}/manifest")
    names = [x.getPath().getName() for x in system.listStatus(where)] if system.exists(where) else []
    done = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))
    if not done:
        return -1, {}
    return done[-1], json.loads(spark.read.text(f"{path}/manifest/{done[-1]}.json").first().value)


def _publish(spark: SparkSession, path: str, batch: int, versions: dict[str, int]) -> None:
    """Put the batch's manifest in place by a rename."""
    system, draft = _files(spark, f"{path}/manifest/_{batch}.draft")
    out = system.create(draft, True)
    out.write(bytearray(json.dumps(versions).encode()))
    out.close()
    if not system.rename(draft, _files(spark, f"{path}/manifest/{batch}.json")[1]):
        raise OSError(f"manifest of batch {batch} could not be put in place")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def winners(rows: DataFrame) -> DataFrame:
    """The latest edition with a value of each cell, or, where none has one, the latest."""
    best = rows.groupBy(*KEY).agg(F.max(F.struct(F.col("value").isNotNull().alias("known"), "edition", "value")).alias("b"))
    return best.select(*KEY, "b.edition", "b.value")


def bucket_paths(path: str, versions: dict[str, int], of: list[str] | None = None) -> list[str]:
    return [f"{path}/observation/version={v}/bucket={b}" for b, v in sorted(versions.items()) if of is None or b in of]


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """The winners as the last manifest has them."""
    paths = bucket_paths(path, latest_manifest(spark, path)[1])
    return spark.read.schema(OBSERVATION).parquet(*paths) if paths else spark.createDataFrame([], OBSERVATION)


def apply_batch(batch: DataFrame, batch_id: int, path: str, buckets: int = BUCKETS) -> list[str]:
    """Take a batch of vintages in; returns the folders of winners that it read."""
    spark = batch.sparkSession
    before, versions = latest_manifest(spark, path)
    if before >= batch_id:
        return []
    batch.write.mode("overwrite").parquet(f"{path}/vintage/batch={batch_id}")
    rows = spark.read.schema(batch.schema).parquet(f"{path}/vintage/batch={batch_id}").select(*KEY, "edition", "value")
    touched = [str(r.bucket) for r in rows.select(_bucket(buckets).alias("bucket")).distinct().collect()]  # as many as there are buckets at most
    read = bucket_paths(path, versions, touched)
    known = spark.read.schema(OBSERVATION).parquet(*read) if read else spark.createDataFrame([], OBSERVATION)
    best = winners(known.unionByName(rows)).withColumn("bucket", _bucket(buckets))
    best.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/observation/version={batch_id}")
    _publish(spark, path, batch_id, versions | dict.fromkeys(touched, batch_id))
    return read


def upsert_vintages(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep all vintages of the stream and the winner of each cell; ``buckets`` must not change between runs."""
    return stream.writeStream.foreachBatch(lambda batch, batch_id: apply_batch(batch, batch_id, path, buckets) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def forget_old_versions(spark: SparkSession, path: str) -> int:
    """Delete the folders of winners that the last manifest does not name; how many went. No batch may run meanwhile."""
    _, versions = latest_manifest(spark, path)
    used, gone = set(bucket_paths(path, versions)), 0
    system, where = _files(spark, f"{path}/observation")
    for version in system.listStatus(where) if system.exists(where) else []:
        for bucket in system.listStatus(version.getPath()):
            name = f"{path}/observation/{version.getPath().getName()}/{bucket.getPath().getName()}"
            if bucket.isDirectory() and name not in used:
                system.delete(bucket.getPath(), True)
                gone += 1
    return gone

"""Contiguous shards of near-equal bytes: prefix sums from per-partition totals, cut at equal targets.

Slim rows (id, size, checksum) are range-partitioned by id and staged with the partition's number, so that
the partitions stay what they were. Their totals, one row per partition, give each partition its base; a
window inside a partition gives the rest of the global prefix sum. A task may be given several partitions, but
sorts and sums each by itself, and rows are spread over as many as the session shuffles to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import packed, partitions, staged

SHARDS = 8


def assign_shards(docs: DataFrame, n_shards: int = SHARDS, keep: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, if wanted the whole ``row`` as a struct, shard (from 0) and slot (gapless from 0 in its shard).

    Rows stand in order of doc_id (nulls first), then of checksum and size; a row goes to the shard in which
    its middle byte lies. A row's size is its text's UTF-8 bytes plus 1, so empty and null texts count 1 and
    repeated rows stay apart. A row longer than a shard's target makes its shard longer by no more than
    itself. With fewer rows than shards some shards are empty; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    row = ["row"] if keep else []
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = packed(docs, "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")).select("doc_id", "size", "text_crc32", *row)
    order = ["doc_id", "text_crc32", "size"]
    rows = staged(slim.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()), "shard-rows")
    totals = rows.groupBy("part").agg(F.sum("size").alias("part_size"), F.count(F.lit(1)).alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(
        totals.select(
            F.col("part").alias("base_part"),
            F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("base_size"),
            F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("base_rows"),
            F.sum("part_size").over(Window.partitionBy()).alias("all_size"),
        ),
        "shard-bases",
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = (
        rows.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("place", F.row_number().over(inside))
        .join(bases, F.col("part") == F.col("base_part"))
        .withColumn("place", F.col("base_rows") + F.col("place") - 1)
        .withColumn("middle2", 2 * (F.col("base_size") + F.col("upto")) - F.col("size"))
        .withColumn("shard", F.expr(f"cast(least({n_shards - 1}, (middle2 * {n_shards}) div (2 * all_size)) as int)"))
        .select("doc_id", "size", "text_crc32", *row, "shard", "place")
    )
    placed = staged(placed, "shard-placed")
    firsts = staged(placed.groupBy("shard").agg(F.min("place").alias("first_place")).withColumnRenamed("shard", "first_shard"), "shard-firsts")
    return placed.join(F.broadcast(firsts), F.col("shard") == F.col("first_shard")).withColumn("slot", F.col("place") - F.col("first_place")).drop("place", "first_place", "first_shard")


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS) -> None:
    """Write slot and ``row`` (a struct of the columns of ``docs``) as Parquet under ``path``/shard=k, each file sorted by slot; a shard is one file or more."""
    rows = assign_shards(docs, n_shards, keep=True).select("shard", "slot", "row")
    rows.repartitionByRange(partitions(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    rows = assign_shards(docs, n_shards)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

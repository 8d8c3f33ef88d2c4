"""Mix sources to target weights: repetition rates per source, then whole copies and one Bernoulli copy.

Words are counted once and staged with id and source; everything after reads that slim table. The plan has
one row for each source; it is staged too, so that Spark knows its size when it chooses how to join it: it
is broadcast below ``spark.sql.autoBroadcastJoinThreshold`` and sort-merge joined (with skew splitting)
beyond. No row of the documents is shuffled by source.

The extra copy of a document is a Bernoulli trial with the fraction of its source's rate, decided by a hash
of its id. Of ``SEEDS`` hash seeds each source takes the one whose total comes nearest to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import packed, staged, word_count

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Disjoint runs of eight hexadecimal digits in a SHA-256.
SEEDS = 8


def uniform(doc_id: Column, seed: Column | int) -> Column:
    """A number in [0, 1) from the id and the seed's number; null ids count as an empty text."""
    digest = F.sha2(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    start = seed * 8 + 1 if isinstance(seed, Column) else F.lit(seed * 8 + 1)
    return F.conv(F.substr(digest, start.cast("int"), F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) to the same with target and rate.

    Sources by code point, nulls last, take the weights in turn and share the total. A source's target stops
    at ``most`` times its size; the rest is shared by weight among the others until none is above. Sorted by
    size per weight the stopped sources come first, so one running sum finds the level of the others.
    Sources without words get target and rate 0.
    """
    everything = Window.partitionBy()
    name = Window.orderBy(F.asc_nulls_last("source"))
    level = Window.orderBy((F.col("source_size") * most / F.col("weight")), F.asc_nulls_last("source"))
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*[F.lit(w) for w in weights])
    return (
        per_source.withColumn("weight", F.element_at(cycle, ((F.row_number().over(name) - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.max(F.col("left_size") / F.col("left_weight")).over(everything))
        .withColumn("target", F.least((F.col("source_size") * most).cast("double"), F.col("level") * F.col("weight")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0)))
        .select("source", "source_size", "target", "rate")
    )


def mixing_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, source, size) to one row per source: source_size, target, rate, seed. The result is staged."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = staged(targets(per_source, weights, most), "mix-targets").withColumnRenamed("source", "plan_source")
    fraction = F.col("rate") - F.floor("rate")
    tried = (
        sizes.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
        .groupBy("plan_source", "source_size", "target", "rate")
        .agg(*[F.sum(F.when(uniform(F.col("doc_id"), k) < fraction, F.col("size")).otherwise(0)).alias(f"extra{k}") for k in range(SEEDS)])
    )
    miss = [F.struct(F.abs(F.floor("rate") * F.col("source_size") + F.col(f"extra{k}") - F.col("target")).alias("miss"), F.lit(k).alias("seed")) for k in range(SEEDS)]
    return staged(tried.select(F.col("plan_source").alias("source"), "source_size", "target", "rate", F.least(*miss)["seed"].alias("seed")), "mix-plan")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with doc_id and source, and beside their columns mix_source_size, mix_target and mix_copies (0 to the maximum)."""
    plan = plan.select(*[F.col(c).alias(f"mix_{c}") for c in plan.columns])
    extra = (uniform(F.col("doc_id"), F.col("mix_seed")) < F.col("mix_rate") - F.floor("mix_rate")).cast("long")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("mix_copies", F.floor("mix_rate") + extra).drop("mix_source", "mix_rate", "mix_seed")


def document_sizes(docs: DataFrame) -> DataFrame:
    return staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """``docs`` with each row as many times as the mix takes it; columns as before.

    Null texts and texts without words have size 0 and are repeated as others of their source are; a null
    source is a source of its own, last in order; rows that share an id share their number of copies; an
    empty table gives an empty one.
    """
    plan = mixing_plan(document_sizes(docs), weights, most)
    times = F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))
    rows = with_copies(packed(docs, "doc_id", "source"), plan).filter("mix_copies > 0")
    return rows.select("row", times.alias("mix_copy")).select("row.*")


def mixed_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes of the row)."""
    sizes = document_sizes(docs)
    rows = with_copies(sizes, mixing_plan(sizes, weights, most))
    return rows.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * F.col("mix_copies")).alias("taken"))


ORACLE = """
WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM per),
running AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS lvl
  FROM ranked WINDOW w AS (ORDER BY (source_size * 3)::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (SELECT source, source_size, least((source_size * 3)::DOUBLE, max(lvl) OVER () * weight::DOUBLE) AS target FROM running),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size::DOUBLE, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM aimed),
drawn AS (
  SELECT s.doc_id, s.size, p.*, k.k, ('0x' || substr(sha256('mix:' || coalesce(s.doc_id::VARCHAR, '')), (k.k * 8 + 1)::INT, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source, range(8) k(k)),
tried AS (
  SELECT source, k, abs(floor(any_value(rate)) * any_value(source_size) + sum(CASE WHEN u < rate - floor(rate) THEN size ELSE 0 END) - any_value(target)) AS miss
  FROM drawn GROUP BY source, k),
best AS (SELECT source, k FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, k) = 1)
SELECT d.doc_id, d.size, d.source_size, d.target, (d.size * (floor(d.rate)::BIGINT + (d.u < d.rate - floor(d.rate))::BIGINT))::BIGINT AS taken
FROM drawn d JOIN best b ON d.source IS NOT DISTINCT FROM b.source AND d.k = b.k
"""

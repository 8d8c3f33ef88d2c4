"""Marts: statistics, ranks, coverage and revisions of the cube's observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.cube import HIDDEN, NO_DATA, OBSERVED, Cube, forget_cubes, small

FULL_YEAR, READY_REGIONS, READY_YEARS = 0.8, 0.8, 5


def stats(cube: Cube) -> DataFrame:
    """Per series and year with at least two values: distribution of the regions, and the country's value."""
    p = lambda q: F.round(F.percentile("value", q), 6)
    rows = cube.regions.filter("value is not null").groupBy("series_key", "year").agg(
        F.count("value").alias("observations"), F.round(F.avg("value"), 8).alias("mean"), p(0.5).alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), p(0.1).alias("p10"), p(0.25).alias("p25"),
        p(0.75).alias("p75"), p(0.9).alias("p90"), F.round(F.stddev_samp("value"), 4).alias("stddev"), F.round(F.sum("value"), 4).alias("sum"),
    ).filter("observations >= 2")
    country = cube.observation.filter("territory_level = 'country'").select("series_key", "year", F.col("value").alias("country_value"))
    ratio = lambda a, b, guard: F.round(F.when(F.col(guard) > 0, F.col(a) / F.col(b)), 4)
    return rows.withColumns({"cv": ratio("stddev", "mean", "mean"), "decile_ratio": ratio("p90", "p10", "p10"), "range_ratio": ratio("max", "min", "min")}).join(country, ["series_key", "year"], "left")


def quintile(rank: Column, size: Column) -> Column:
    """Fifths of near-equal size by competition rank, so that ties share one; the first fifths take the remainder."""
    p, q, r = rank - 1, F.floor(size / 5), size % 5
    return F.when(p < (q + 1) * r, F.floor(p / (q + 1)) + 1).otherwise(F.floor((p - (q + 1) * r) / F.nullif(q, F.lit(0))) + r + 1).cast("long")


def ranks(cube: Cube) -> DataFrame:
    """Competition ranks both ways, percentile, quintile, share of the non-negative total, ratio to the country, for regions with a value."""
    year = Window.partitionBy("series_key", "year")
    country = cube.observation.filter("territory_level = 'country'").select("series_key", "year", F.col("value").alias("country_value"))
    rows = (
        cube.regions.filter("value is not null")
        .withColumn("size", F.count(F.lit(1)).over(year))
        .withColumn("rank_desc", F.rank().over(year.orderBy(F.desc("value"))).cast("long"))
        .withColumn("rank_asc", F.rank().over(year.orderBy(F.asc("value"))).cast("long"))
        .withColumn("total", F.sum(F.when(F.col("value") >= 0, F.col("value"))).over(year))
        .join(country, ["series_key", "year"], "left")
    )
    return rows.select(
        "series_key", "year", "territory_code", "value", "rank_desc", "rank_asc", F.round((F.col("rank_asc") - 1) / F.nullif(F.col("size") - 1, F.lit(0)), 6).alias("percentile"), quintile(F.col("rank_desc"), F.col("size")).alias("quintile"),
        F.round(F.when((F.col("value") >= 0) & (F.col("total") > 0), F.col("value") / F.col("total")), 6).alias("share_of_total"), F.round(F.when(F.col("country_value") != 0, F.col("value") / F.col("country_value")), 6).alias("ratio_to_country"),
    )


def coverage(cube: Cube) -> DataFrame:
    """Per series: counts by quality, share of regions ever seen, completeness, longest run of years at half the peak, readiness."""
    rows = cube.regions
    universe = cube.territory.filter("level = 'region' and not is_aggregate").agg(F.count(F.lit(1)).alias("universe"))
    known = F.when(F.col("value").isNotNull(), True)
    count_if = lambda quality: F.sum((F.col("quality") == quality).cast("long"))
    base = rows.groupBy("series_key").agg(
        count_if(OBSERVED).alias("observed"), count_if(NO_DATA).alias("no_data"), count_if(HIDDEN).alias("hidden"), F.count_distinct(F.when(known, F.col("territory_code"))).alias("regions"),
        F.count_distinct(F.when(known, F.col("year"))).alias("years"), F.min(F.when(known, F.col("year"))).alias("first_year"), F.max(F.when(known, F.col("year"))).alias("last_year"),
    )
    yearly = rows.filter("value is not null").groupBy("series_key", "year").agg(F.count(F.lit(1)).alias("n"))
    good = yearly.withColumn("peak", F.max("n").over(Window.partitionBy("series_key"))).filter("n >= 0.5 * peak")
    islands = good.withColumn("island", F.col("year") - F.row_number().over(Window.partitionBy("series_key").orderBy("year")))
    longest = islands.groupBy("series_key", "island").agg(F.count(F.lit(1)).alias("run")).groupBy("series_key").agg(F.max("run").alias("longest_span"))
    out = base.crossJoin(F.broadcast(universe)).join(longest, "series_key", "left").withColumn("region_coverage", F.round(F.col("regions") / F.col("universe"), 4))
    span = F.col("last_year") - F.col("first_year") + 1
    return out.withColumn("completeness", F.round(F.col("observed") / F.nullif(F.col("regions") * span, F.lit(0)), 4)).withColumn("is_ready", (F.col("region_coverage") >= READY_REGIONS) & (F.col("years") >= READY_YEARS)).drop("universe")


def revisions(cube: Cube) -> DataFrame:
    """Cells whose editions hold more than one value: first and last by edition, absolute and relative change."""
    return (
        cube.vintage.filter("value is not null")
        .groupBy("series_key", "territory_code", "year")
        .agg(F.count(F.lit(1)).alias("edition_count"), F.count_distinct("value").alias("values"), F.min_by("value", "edition").alias("first_value"), F.max_by("value", "edition").alias("last_value"))
        .filter("values > 1")
        .withColumn("abs_change", F.round(F.col("last_value") - F.col("first_value"), 4))
        .withColumn("rel_change", F.round(F.when(F.col("first_value") != 0, (F.col("last_value") - F.col("first_value")) / F.abs("first_value")), 6))
        .drop("values")
    )


_MARTS: dict[tuple[str, str], DataFrame] = {}


def mart(cube: Cube, name: str) -> DataFrame:
    """A mart of the cube by name, built once and kept; its rows are bounded as the cube's."""
    key = (cube.version + cube.territory.sparkSession.sparkContext.applicationId, name)
    if key not in _MARTS:
        _MARTS[key] = {"stats": stats, "rank": ranks, "coverage": coverage, "revision": revisions}[name](cube).transform(small)
    return _MARTS[key]


def forget() -> None:
    """Release all marts and cubes; the next call builds from the files as they are then."""
    for frame in _MARTS.values():
        frame.unpersist()
    _MARTS.clear()
    forget_cubes()

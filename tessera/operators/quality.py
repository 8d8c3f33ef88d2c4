"""Data-quality rules over the cube and over raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.cube import Cube
from tessera.plans.marts import mart


def aggregate_consistency(cube: Cube) -> DataFrame:
    """Sum of regions over country: additive series (median ratio within a tenth of 1) and their years off by over 5 %."""
    country = cube.observation.filter("territory_level = 'country' and value > 0").select("series_key", "year", F.col("value").alias("country"))
    rows = cube.regions.filter("value is not null").groupBy("series_key", "year").agg(F.sum("value").alias("total")).join(country, ["series_key", "year"]).withColumn("ratio", F.col("total") / F.col("country"))
    return rows.groupBy("series_key").agg(F.round(F.median("ratio"), 6).alias("median_ratio"), F.count(F.when(F.abs(F.col("ratio") - 1) > 0.05, 1)).alias("years_off")).withColumn("additive", F.col("median_ratio").between(0.9, 1.1))


def scale_anomalies(cube: Cube, factor: float = 9.0) -> DataFrame:
    """Revisions by more than ``factor`` either way."""
    return mart(cube, "revision").filter((F.col("first_value") > 0) & (F.col("last_value") > 0)).withColumn("factor", F.round(F.greatest(F.col("last_value") / F.nullif("first_value", F.lit(0.0)), F.col("first_value") / F.nullif("last_value", F.lit(0.0))), 4)).filter(F.col("factor") > factor).select("series_key", "territory_code", "year", "factor")


def series_gaps(cube: Cube) -> DataFrame:
    """Years without a value inside the span of a series in a region."""
    rows = cube.regions.filter("value is not null").groupBy("series_key", "territory_code").agg((F.max("year") - F.min("year") + 1 - F.count(F.lit(1))).alias("missing"))
    return rows.filter("missing > 0")


def discontinued(cube: Cube, stops: DataFrame) -> DataFrame:
    """Values after a declared last year (series_key, stop_year)."""
    return cube.regions.filter("value is not null").join(F.broadcast(stops), "series_key").filter("year > stop_year").groupBy("series_key").agg(F.count(F.lit(1)).alias("n"))


def scale_jumps(cube: Cube, slack: float = 2.0, least: int = 10) -> DataFrame:
    """Consecutive years whose median absolute value jumps by a thousand or a million, within ``slack``."""
    m = cube.regions.filter("value is not null").groupBy("series_key", "year").agg(F.median(F.abs("value")).alias("m"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    j = m.withColumn("before", F.lag("m").over(Window.partitionBy("series_key").orderBy("year"))).filter("before > 0 and m > 0").withColumn("jump", F.greatest(F.col("m") / F.col("before"), F.col("before") / F.col("m")))
    near = [F.col("jump").between(k / slack, k * slack) for k in (1e3, 1e6)]
    return j.filter(near[0] | near[1]).select("series_key", "year", F.round("jump", 2).alias("jump"))


def parts_over_total(rows: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Cells of any series (measure:slice) whose parts (measure:slice/part) add up to more than it says. Rows: series_key, territory_code, year, value."""
    known = rows.filter("value is not null")
    cell = ["series_key", "territory_code", "year"]
    parts = known.filter("series_key like '%/%'").withColumn("series_key", F.regexp_extract("series_key", r"^(.*)/[^/]*$", 1)).groupBy(*cell).agg(F.sum("value").alias("parts"), F.count(F.lit(1)).alias("n"))
    return known.select(*cell, "value").join(parts, cell).filter(F.col("parts") > F.col("value") * (1 + tolerance)).select(*cell, "value", F.round("parts", 4).alias("parts"), "n")


def presence(cube: Cube, series_key: str) -> DataFrame:
    """Region x year: present, hidden or absent."""
    state = F.when(F.col("value").isNotNull(), "present").when(F.col("quality") == 2, "hidden").otherwise("absent")
    return cube.regions.filter(F.col("series_key") == series_key).select("territory_code", "year", state.alias("state"))


def data_kind(cube: Cube) -> DataFrame:
    """Per series and year: a sum if the regions add up to the country, relative if the country lies among them."""
    country = cube.observation.filter("territory_level = 'country' and value is not null").select("series_key", "year", F.col("value").alias("country"))
    r = cube.regions.filter("value is not null").groupBy("series_key", "year").agg(F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n")).join(country, ["series_key", "year"])
    ratio = F.col("total") / F.nullif("country", F.lit(0.0))
    kind = F.when(F.abs(ratio - 1) <= 0.01, "sum").when(F.col("country").between(F.col("low"), F.col("high")) & ratio.between(F.col("n") / 4, F.col("n") * 4), "relative").otherwise("unknown")
    return r.select("series_key", "year", kind.alias("kind"))

"""Selections of one or several series: timelines, snapshots, panels, vintages, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.cube import Cube
from tessera.plans.marts import FULL_YEAR, mart

def _known() -> Column:
    return F.col("value").isNotNull()


def _one(series_key: str) -> Column:
    return F.col("series_key") == series_key


def covered_years(counts: DataFrame, share: float = FULL_YEAR) -> DataFrame:
    """Years (series_key, year, n) whose count is at least ``share`` of the series' largest."""
    return counts.withColumn("peak", F.max("n").over(Window.partitionBy("series_key"))).filter(F.col("n") >= share * F.col("peak")).drop("peak")


def year_counts(cube: Cube, series_keys: Sequence[str]) -> DataFrame:
    return cube.regions.filter(F.col("series_key").isin(*series_keys) & _known()).groupBy("series_key", "year").agg(F.count(F.lit(1)).alias("n"))


def metadata(cube: Cube, series_key: str) -> DataFrame:
    """Measure, slice and unit kind of a series beside its coverage."""
    parts = F.split("series_key", ":", 2)
    kind = F.when(parts[0] == "avg_price", "rate").when(parts[0] == "revenue", "currency").otherwise("absolute")
    return mart(cube, "coverage").filter(_one(series_key)).select("series_key", parts[0].alias("measure"), parts[1].alias("slice"), kind.alias("kind"), "observed", "hidden", "no_data", "first_year", "last_year", "is_ready")


def timeline(cube: Cube, series_key: str, territory_codes: Sequence[str] = ("W",), first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """Values of territories by year; gaps stay, with their quality."""
    rows = cube.observation.filter(_one(series_key) & F.col("territory_code").isin(*territory_codes))
    if first_year is not None:
        rows = rows.filter(F.col("year") >= first_year)
    if last_year is not None:
        rows = rows.filter(F.col("year") <= last_year)
    return rows.select("territory_code", "year", "value", "quality")


def recent_values(cube: Cube, territory_code: str, series_keys: Sequence[str], span: int = 12) -> DataFrame:
    """The last ``span`` years up to each series' last value."""
    rows = cube.observation.filter((F.col("territory_code") == territory_code) & F.col("series_key").isin(*series_keys))
    last = F.max(F.when(_known(), F.col("year"))).over(Window.partitionBy("series_key"))
    return rows.withColumn("last", last).filter((F.col("year") > F.col("last") - span) & (F.col("year") <= F.col("last"))).select("series_key", "year", "value")


def snapshot(cube: Cube, territory_code: str, series_keys: Sequence[str]) -> DataFrame:
    """Last value, change against the value known before, and the values so far."""
    rows = cube.observation.filter((F.col("territory_code") == territory_code) & F.col("series_key").isin(*series_keys) & _known())
    order = Window.partitionBy("series_key").orderBy("year")
    rows = rows.withColumn("before", F.lag("value").over(order)).withColumn("place", F.row_number().over(Window.partitionBy("series_key").orderBy(F.desc("year"))))
    spark_line = rows.groupBy("series_key").agg(F.array_sort(F.collect_list(F.struct("year", "value"))).alias("line"))
    change = F.col("value") - F.col("before")
    return rows.filter("place = 1").join(spark_line, "series_key").select("series_key", "year", "value", F.round(change, 4).alias("change"), F.round(F.when(F.col("before") != 0, change / F.abs("before")), 6).alias("rel_change"), F.size("line").cast("long").alias("points"))


def by_territory(cube: Cube, series_key: str, year: int, level: str = "region") -> DataFrame:
    rows = cube.observation.filter(_one(series_key) & (F.col("year") == year) & (F.col("territory_level") == level) & ~F.col("is_aggregate"))
    ranks = mart(cube, "rank").filter(_one(series_key) & (F.col("year") == year)).select("territory_code", "rank_desc", "quintile")
    return rows.join(cube.territory.select("territory_code", "name"), "territory_code").join(ranks, "territory_code", "left").select("territory_code", "name", "value", "quality", "rank_desc", "quintile")


def year_grid(cube: Cube, series_key: str, first_year: int, last_year: int) -> DataFrame:
    """Regions by year with the country's line."""
    wanted = ((F.col("territory_level") == "region") & ~F.col("is_aggregate")) | (F.col("territory_level") == "country")
    return cube.observation.filter(_one(series_key) & F.col("year").between(first_year, last_year) & wanted).select("territory_code", "year", "value", "quality")


def leaders(cube: Cube, series_key: str, year: int, limit: int = 5, ascending: bool = False) -> DataFrame:
    rank = "rank_asc" if ascending else "rank_desc"
    rows = mart(cube, "rank").filter(_one(series_key) & (F.col("year") == year))
    return rows.orderBy(rank, "territory_code").limit(limit).select("territory_code", "value", F.col(rank).alias("rank"))


def ranked_panel(cube: Cube, series_key: str) -> DataFrame:
    return mart(cube, "rank").filter(_one(series_key)).select("year", "territory_code", "rank_desc", "rank_asc", F.count(F.lit(1)).over(Window.partitionBy("year")).alias("ranked"))


def statistics_timeline(cube: Cube, series_key: str, year: int | None = None) -> DataFrame:
    rows = mart(cube, "stats").filter(_one(series_key))
    return (rows if year is None else rows.filter(F.col("year") == year)).select("year", "observations", "mean", "median", "min", "max", "stddev", "country_value")


def available_years(cube: Cube, series_key: str) -> DataFrame:
    return cube.regions.filter(_one(series_key) & _known()).select("year").distinct()


def values(cube: Cube, series_keys: Sequence[str], territory_codes: Sequence[str]) -> DataFrame:
    return cube.observation.filter(F.col("series_key").isin(*series_keys) & F.col("territory_code").isin(*territory_codes)).select("series_key", "territory_code", "year", "value")


def summary_map(cube: Cube, series_keys: Sequence[str]) -> DataFrame:
    return mart(cube, "coverage").filter(F.col("series_key").isin(*series_keys))


def vintages(cube: Cube, series_key: str, territory_code: str) -> DataFrame:
    return cube.vintage.filter(_one(series_key) & (F.col("territory_code") == territory_code)).select("year", "edition", "value", "quality")


def top_revisions(cube: Cube, series_key: str, limit: int = 20) -> DataFrame:
    rows = mart(cube, "revision").filter(_one(series_key) & F.col("rel_change").isNotNull())
    return rows.orderBy(F.desc(F.abs("rel_change")), "territory_code", "year").limit(limit).select("territory_code", "year", "first_value", "last_value", "rel_change")


def editions(cube: Cube, series_key: str) -> DataFrame:
    """Editions and how many observations of the series come from each."""
    return cube.observation.filter(_one(series_key) & _known()).groupBy("edition").agg(F.count(F.lit(1)).alias("observations"))


def latest_matrix(cube: Cube, series_keys: Sequence[str], territory_codes: Sequence[str]) -> DataFrame:
    """The latest value of each series in each territory, with its rank."""
    rows = cube.observation.filter(F.col("series_key").isin(*series_keys) & F.col("territory_code").isin(*territory_codes) & _known())
    last = rows.withColumn("place", F.row_number().over(Window.partitionBy("series_key", "territory_code").orderBy(F.desc("year")))).filter("place = 1")
    return last.join(mart(cube, "rank").select("series_key", "territory_code", "year", "rank_desc"), ["series_key", "territory_code", "year"], "left").select("series_key", "territory_code", "year", "value", "rank_desc")


def page(cube: Cube, series_key: str, limit: int, offset: int = 0, territory_code: str | None = None) -> DataFrame:
    """A page of a series' rows in order of territory and year, each with the total."""
    rows = cube.observation.filter(_one(series_key))
    if territory_code is not None:
        rows = rows.filter(F.col("territory_code") == territory_code)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy("territory_code", "year").offset(offset).limit(limit).select("territory_code", "year", "value").crossJoin(F.broadcast(total))

"""Answer plans: small compositions of the marts for one question each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.derive import regions_of, rows_of
from tessera.operators.series import _one
from tessera.operators.statistics import average_rank
from tessera.plans.cube import Cube
from tessera.plans.marts import mart


def both_ends(cube: Cube, series_key: str, year: int, limit: int = 3) -> DataFrame:
    rows = mart(cube, "rank").filter(_one(series_key) & (F.col("year") == year))
    return rows.filter((F.col("rank_desc") <= limit) | (F.col("rank_asc") <= limit)).select("territory_code", "value", "rank_desc", F.when(F.col("rank_desc") <= limit, "top").otherwise("bottom").alias("end"))


def change(cube: Cube, series_key: str, territory_code: str, span: int = 5) -> DataFrame:
    """Change of the last value against the one ``span`` years before, in percent and as a difference."""
    rows = rows_of(cube, series_key).filter(F.col("territory_code") == territory_code).select("year", "value")
    last = rows.orderBy(F.desc("year")).limit(1)
    before = rows.select((F.col("year") + span).alias("year"), F.col("value").alias("before"))
    return last.join(before, "year", "left").withColumn("difference", F.round(F.col("value") - F.col("before"), 4)).withColumn("percent", F.round(F.when(F.col("before") > 0, (F.col("value") / F.col("before") - 1) * 100), 4))


def own_place(cube: Cube, series_key: str, territory_code: str, year: int) -> DataFrame:
    """A region's value, places in country and district, and the regions just above and below."""
    rows = mart(cube, "rank").filter(_one(series_key) & (F.col("year") == year)).join(cube.territory.select("territory_code", "district_code"), "territory_code")
    order = Window.partitionBy().orderBy("rank_desc", "territory_code")
    placed = rows.withColumn("above", F.lag("territory_code").over(order)).withColumn("below", F.lead("territory_code").over(order)).withColumn("district_place", F.rank().over(Window.partitionBy("district_code").orderBy(F.desc("value"))).cast("long"))
    return placed.filter(F.col("territory_code") == territory_code).select("territory_code", "value", "rank_desc", "district_place", "above", "below", "share_of_total", "ratio_to_country")


def growth_ranking(cube: Cube, series_key: str, first: int, last: int) -> DataFrame:
    at = lambda y: F.max(F.when(F.col("year") == y, F.col("value")))
    rows = regions_of(cube, series_key).groupBy("territory_code").agg(at(first).alias("a"), at(last).alias("b")).filter("a > 0 and b is not null")
    rows = rows.withColumn("growth", F.round((F.col("b") / F.col("a") - 1) * 100, 4))
    return rows.select("territory_code", "growth", F.rank().over(Window.partitionBy().orderBy(F.desc("growth"))).cast("long").alias("place"))


def structure(cube: Cube, part_keys: Sequence[str], year: int, territory_code: str, top: int = 3) -> DataFrame:
    """Shares of parts; the largest apart, the others together."""
    rows = cube.observation.filter(F.col("series_key").isin(*part_keys) & (F.col("year") == year) & (F.col("territory_code") == territory_code) & F.col("value").isNotNull())
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc("value"), "series_key")))
    named = placed.withColumn("part", F.when(F.col("place") <= top, F.col("series_key")).otherwise("other")).groupBy("part").agg(F.sum("value").alias("value"))
    return named.select("part", F.round("value", 4).alias("value"), F.round(F.col("value") / F.sum("value").over(Window.partitionBy()) * 100, 4).alias("share"))


def contributions(cube: Cube, series_key: str, first: int, last: int, top: int = 8) -> DataFrame:
    """Waterfall: the largest changes of regions one by one, the rest together, and the running level."""
    at = lambda y: F.max(F.when(F.col("year") == y, F.col("value")))
    rows = regions_of(cube, series_key).groupBy("territory_code").agg(at(first).alias("a"), at(last).alias("b")).filter("a is not null and b is not null").withColumn("d", F.col("b") - F.col("a"))
    start = F.sum("a").over(Window.partitionBy())
    placed = rows.withColumn("start", start).withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc(F.abs("d")), "territory_code")))
    steps = placed.withColumn("step", F.least("place", F.lit(top + 1)).cast("long")).groupBy("step").agg(F.when(F.max("place") > top, F.lit("rest")).otherwise(F.max("territory_code")).alias("part"), F.sum("d").alias("d"), F.max("start").alias("start"))
    upto = Window.partitionBy().orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.select("step", "part", F.round("d", 4).alias("change"), F.round(F.col("start") + F.sum("d").over(upto), 4).alias("level"))


def districts(cube: Cube, series_key: str, year: int, is_sum: bool) -> DataFrame:
    """District values; without one the sum or the median of the regions."""
    own = cube.observation.filter(_one(series_key) & (F.col("year") == year) & (F.col("territory_level") == "federal_district")).select("district_code", F.col("value").alias("own"))
    rows = regions_of(cube, series_key).filter(F.col("year") == year).groupBy("district_code").agg((F.sum("value") if is_sum else F.median("value")).alias("made"))
    return own.join(rows, "district_code", "left").select("district_code", F.round(F.coalesce("own", "made"), 4).alias("value"))


def notable(cube: Cube, series_key: str, year: int) -> DataFrame:
    """Largest and smallest region, their ratio, how many grew and how many have no value."""
    rows = cube.regions.filter(_one(series_key) & F.col("year").isin(year, year - 1)).groupBy("territory_code").agg(F.max(F.when(F.col("year") == year, F.col("value"))).alias("now"), F.max(F.when(F.col("year") == year - 1, F.col("value"))).alias("before"))
    known = F.when(F.col("now").isNotNull(), F.col("now"))
    return rows.agg(F.max_by("territory_code", known).alias("largest"), F.min_by("territory_code", known).alias("smallest"), F.round(F.max("now") / F.nullif(F.min("now"), F.lit(0.0)), 4).alias("ratio"), F.count(F.when(F.col("now") > F.col("before"), 1)).alias("grew"), F.count(F.when(F.col("now").isNull(), 1)).alias("missing"))


def rebased(cube: Cube, series_keys: Sequence[str], territory_code: str) -> DataFrame:
    """Series with the earliest year that all have a non-zero value in as 100."""
    rows = cube.observation.filter(F.col("series_key").isin(*series_keys) & (F.col("territory_code") == territory_code) & F.col("value").isNotNull())
    common = rows.filter("value <> 0").groupBy("year").agg(F.count_distinct("series_key").alias("n")).filter(F.col("n") == len(set(series_keys))).agg(F.min("year").alias("base_year"))
    base = rows.join(F.broadcast(common), F.col("year") == F.col("base_year")).select("series_key", F.col("value").alias("base"))
    return rows.join(base, "series_key").select("series_key", "year", F.round(F.col("value") / F.col("base") * 100, 2).alias("value"))


def favourable(percentile: Column, polarity: str) -> Column:
    return percentile if polarity == "positive" else 1 - percentile


def against_year(cube: Cube, series_key: str, year: int, compare_year: int) -> DataFrame:
    """Values of a year, and their difference to another; regions without a value then keep only the value."""
    rows = regions_of(cube, series_key)
    before = rows.filter(F.col("year") == compare_year).select("territory_code", F.col("value").alias("before"))
    return rows.filter(F.col("year") == year).join(before, "territory_code", "left").select("territory_code", "value", F.round(F.col("value") - F.col("before"), 4).alias("difference"))


def frames(cube: Cube, series_key: str) -> DataFrame:
    """Yearly frames: the ranked codes as one list, the leader and the number of regions."""
    rows = mart(cube, "rank").filter(_one(series_key))
    return rows.groupBy("year").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank_desc", "territory_code"))), lambda s: s["territory_code"])).alias("standing"), F.count(F.lit(1)).alias("regions"))


def finding(cube: Cube, series_key: str, year: int) -> DataFrame:
    """A sentence's numbers: quartiles, and how many regions stand below the country."""
    rows = regions_of(cube, series_key).filter(F.col("year") == year)
    country = cube.observation.filter(_one(series_key) & (F.col("year") == year) & (F.col("territory_level") == "country")).select(F.col("value").alias("country"))
    return rows.crossJoin(F.broadcast(country)).agg(F.round(F.percentile("value", 0.25), 6).alias("q1"), F.round(F.percentile("value", 0.75), 6).alias("q3"), F.count(F.when(F.col("value") < F.col("country"), 1)).alias("below"))


def common_year_relation(cube: Cube, one: str, two: str, least: int = 8) -> DataFrame:
    """Spearman's correlation of two series in the year with most common regions (of several the last)."""
    a, b = (regions_of(cube, k).select("territory_code", "year", F.col("value").alias(n)) for k, n in ((one, "x"), (two, "y")))
    both = a.join(b, ["territory_code", "year"])
    year = both.groupBy("year").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), F.desc("year")).limit(1)
    rows = both.join(F.broadcast(year), "year").withColumn("rx", average_rank("x", "year")).withColumn("ry", average_rank("y", "year"))
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("rx", "ry"), 6).alias("spearman"))

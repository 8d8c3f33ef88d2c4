"""Selections for analysis: panels, nearest full years, districts, revisions, ranking tables and movers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.series import _known, _one, covered_years, year_counts
from tessera.plans.cube import HIDDEN, Cube
from tessera.plans.marts import mart


def region_panel(cube: Cube, series_key: str) -> DataFrame:
    return cube.regions.filter(_one(series_key) & _known()).select("year", "territory_code", "value")


def hidden_counts(cube: Cube, series_key: str) -> DataFrame:
    return cube.regions.filter(_one(series_key) & (F.col("quality") == HIDDEN)).groupBy("year").agg(F.count(F.lit(1)).alias("hidden"))


def region_matrix(cube: Cube, series_keys: Sequence[str], year: int) -> DataFrame:
    """Of each series the full year nearest to ``year`` (of two the later) and the regions' values in it."""
    full = covered_years(year_counts(cube, series_keys))
    near = full.withColumn("place", F.row_number().over(Window.partitionBy("series_key").orderBy(F.abs(F.col("year") - year), F.desc("year")))).filter("place = 1").select("series_key", "year")
    return cube.regions.filter(_known()).join(near, ["series_key", "year"]).select("series_key", "year", "territory_code", "value")


def paired_years(cube: Cube, series_key: str, first_year: int, last_year: int) -> DataFrame:
    """Regions with a value in both years."""
    at = lambda y: F.max(F.when(F.col("year") == y, F.col("value")))
    rows = cube.regions.filter(_one(series_key) & F.col("year").isin(first_year, last_year))
    return rows.groupBy("territory_code").agg(at(first_year).alias("first_value"), at(last_year).alias("last_value")).filter("first_value is not null and last_value is not null")


def district_totals(cube: Cube, series_key: str, year: int) -> DataFrame:
    """Number, sum, median and extremes of a district's regions, beside the district's own value."""
    at = F.col("year") == year
    own = cube.observation.filter(_one(series_key) & at & (F.col("territory_level") == "federal_district")).select("district_code", F.col("value").alias("own_value"))
    rows = cube.regions.filter(_one(series_key) & at & _known()).groupBy("district_code")
    return rows.agg(F.count("value").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.median("value"), 6).alias("median"), F.min("value").alias("min"), F.max("value").alias("max")).join(own, "district_code", "left")


def directory(cube: Cube, level: str) -> DataFrame:
    return cube.territory.filter((F.col("level") == level) & ~F.col("is_aggregate")).select("territory_code", "name", "district_code", "display_order")


def series_years(cube: Cube, series_keys: Sequence[str]) -> DataFrame:
    return mart(cube, "coverage").filter(F.col("series_key").isin(*series_keys)).select("series_key", "first_year", "last_year")


def series_covered_years(cube: Cube, series_keys: Sequence[str]) -> DataFrame:
    return covered_years(year_counts(cube, series_keys)).groupBy("series_key").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def _size() -> Column:
    return F.abs("rel_change")


def revision_summary(cube: Cube) -> DataFrame:
    rows = mart(cube, "revision")
    return rows.agg(
        F.count(F.lit(1)).alias("cells"), F.count_distinct("series_key").alias("series"), F.count_distinct("territory_code").alias("territories"), F.round(F.median(_size()), 7).alias("median_rel"), F.round(F.avg(_size()), 5).alias("mean_rel"),
        F.max(_size()).alias("max_rel"), F.count(F.when(_size() >= 0.05, 1)).alias("over_5_percent"),
    )


def revision_distribution(cube: Cube) -> DataFrame:
    """Revisions in five bands of relative change, with their shares."""
    band = F.when(_size() < 0.001, 0).when(_size() < 0.01, 1).when(_size() < 0.05, 2).when(_size() < 0.25, 3).otherwise(4)
    rows = mart(cube, "revision").filter("rel_change is not null").groupBy(band.cast("long").alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def revisions_by(cube: Cube, key: str, limit: int | None = None) -> DataFrame:
    """Revised cells by measure, series, territory or year; the most first."""
    rows = mart(cube, "revision").withColumn("measure", F.split("series_key", ":")[0]).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.median(_size()), 7).alias("median_rel"))
    return rows if limit is None else rows.orderBy(F.desc("n"), key).limit(limit)


def largest_revisions(cube: Cube, limit: int = 20, low: float = 0.01, high: float = 5.0) -> DataFrame:
    rows = mart(cube, "revision").filter(_size().between(low, high))
    return rows.orderBy(F.desc(_size()), "series_key", "territory_code", "year").limit(limit).select("series_key", "territory_code", "year", "first_value", "last_value", "rel_change")


def edition_activity(cube: Cube) -> DataFrame:
    return cube.vintage.groupBy("edition").agg(F.count("value").alias("values"), F.count_distinct("series_key").alias("series"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def revision_trace(cube: Cube, series_key: str, territory_code: str, year: int) -> DataFrame:
    return cube.vintage.filter(_one(series_key) & (F.col("territory_code") == territory_code) & (F.col("year") == year)).select("edition", "value")


def revision_triangle(cube: Cube, series_key: str, territory_code: str) -> DataFrame:
    """By horizon (editions after a year's first): mean and largest absolute deviation from the first publication."""
    rows = cube.vintage.filter(_one(series_key) & (F.col("territory_code") == territory_code) & _known())
    year = Window.partitionBy("year")
    rows = rows.withColumn("first", F.first("value").over(year.orderBy("edition"))).withColumn("horizon", (F.row_number().over(year.orderBy("edition")) - 1).cast("long"))
    change = F.abs((F.col("value") - F.col("first")) / F.nullif(F.abs("first"), F.lit(0.0)))
    return rows.filter("horizon > 0").groupBy("horizon").agg(F.round(F.avg(change), 6).alias("mean_change"), F.round(F.max(change), 6).alias("max_change"), F.count(F.lit(1)).alias("n"))


def ranking_table(cube: Cube, series_key: str, year: int, previous_year: int) -> DataFrame:
    """A year's ranking with the rank of a year before and the district's name; by rank, then name."""
    rank = mart(cube, "rank").filter(_one(series_key))
    before = rank.filter(F.col("year") == previous_year).select("territory_code", F.col("rank_desc").alias("previous_rank"))
    names = cube.territory.select("territory_code", "name", "district_code")
    districts = cube.territory.select(F.col("territory_code").alias("district_code"), F.col("name").alias("district"))
    rows = rank.filter(F.col("year") == year).join(names, "territory_code").join(districts, "district_code", "left").join(before, "territory_code", "left")
    return rows.select("territory_code", "name", "district", "value", "rank_desc", "previous_rank", (F.col("previous_rank") - F.col("rank_desc")).alias("movement"), "quintile").orderBy("rank_desc", "name")


def rank_history(cube: Cube, series_key: str, territory_codes: Sequence[str]) -> DataFrame:
    return mart(cube, "rank").filter(_one(series_key) & F.col("territory_code").isin(*territory_codes)).select("territory_code", "year", "rank_desc", "value")


def rank_movers(cube: Cube, series_key: str, year: int, previous_year: int, limit: int = 5) -> DataFrame:
    """The regions that rose and fell most; ``ties_left`` tells how many more moved as far as the last one listed."""
    rank = mart(cube, "rank").filter(_one(series_key))
    now, before = (rank.filter(F.col("year") == y).select("territory_code", F.col("rank_desc").alias(n)) for y, n in ((year, "now"), (previous_year, "before")))
    moved = now.join(before, "territory_code").withColumn("movement", F.col("before") - F.col("now")).filter("movement <> 0").withColumn("direction", F.when(F.col("movement") > 0, "risen").otherwise("fallen")).withColumn("far", F.abs("movement"))
    side = Window.partitionBy("direction")
    placed = moved.withColumn("place", F.row_number().over(side.orderBy(F.desc("far"), "now", "territory_code"))).withColumn("last", F.min(F.when(F.col("place") <= limit, F.col("far"))).over(side))
    left = F.sum(((F.col("place") > limit) & (F.col("far") == F.col("last"))).cast("long")).over(side)
    return placed.withColumn("ties_left", left).filter(F.col("place") <= limit).select("direction", "territory_code", "now", "before", "movement", "ties_left")


def ranked_years(cube: Cube, series_key: str) -> DataFrame:
    return mart(cube, "rank").filter(_one(series_key)).select("year").distinct()


def territory_profile(cube: Cube, territory_code: str) -> DataFrame:
    return cube.territory.filter(F.col("territory_code") == territory_code)


def territory_coverage(cube: Cube, territory_code: str) -> DataFrame:
    """How many of the ready series have a value in a territory."""
    ready = mart(cube, "coverage").filter("is_ready").select("series_key")
    seen = cube.observation.filter((F.col("territory_code") == territory_code) & _known()).select("series_key").distinct().withColumn("seen", F.lit(1))
    rows = ready.join(seen, "series_key", "left").agg(F.count(F.lit(1)).alias("ready"), F.count("seen").alias("with_values"))
    return rows.withColumn("share", F.round(F.col("with_values") / F.nullif(F.col("ready"), F.lit(0)), 6))


def territory_positions(cube: Cube, territory_code: str, series_keys: Sequence[str], least: int = 20, back: int = 5) -> DataFrame:
    """Latest rank of each series in a year that ranks enough regions, beside the country's and the own value now and years before."""
    rank = mart(cube, "rank").filter(F.col("series_key").isin(*series_keys)).withColumn("ranked", F.count(F.lit(1)).over(Window.partitionBy("series_key", "year")))
    own = rank.filter((F.col("territory_code") == territory_code) & (F.col("ranked") >= least))
    last = own.withColumn("place", F.row_number().over(Window.partitionBy("series_key").orderBy(F.desc("year")))).filter("place = 1").select("series_key", "year", "value", "rank_desc", "ranked")
    value = lambda code, name, shift: cube.observation.filter(F.col("territory_code") == code).select("series_key", (F.col("year") + shift).alias("year"), F.col("value").alias(name))
    out = last
    for code, name, shift in (("W", "country_now", 0), ("W", "country_before", back), (territory_code, "own_before", back)):
        out = out.join(value(code, name, shift), ["series_key", "year"], "left")
    return out


def district_summary(cube: Cube, district_code: str, series_key: str, year: int) -> DataFrame:
    rows = cube.regions.filter(_one(series_key) & (F.col("year") == year) & (F.col("district_code") == district_code) & _known())
    return rows.agg(F.count("value").alias("n"), F.round(F.avg("value"), 8).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.min("value").alias("min"), F.max("value").alias("max"))


def warehouse_summary(cube: Cube) -> DataFrame:
    """One row of counts; each relation is aggregated once."""
    one = lambda df, **aggs: df.agg(*[a.alias(n) for n, a in aggs.items()])
    count = F.count(F.lit(1))
    parts = [
        one(cube.observation, observations=count, values=F.count("value"), series=F.count_distinct("series_key"), first_year=F.min("year"), last_year=F.max("year")),
        one(cube.vintage, vintages=count, editions=F.count_distinct("edition")),
        one(cube.territory, territories=count, regions=F.sum(((F.col("level") == "region") & ~F.col("is_aggregate")).cast("long"))),
        one(mart(cube, "revision"), revised=count),
        one(mart(cube, "coverage").filter("is_ready"), ready=count),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)
    return out


def observations_by_year(cube: Cube) -> DataFrame:
    at = lambda q: F.sum((F.col("quality") == q).cast("long"))
    return cube.regions.groupBy("year").agg(at(0).alias("observed"), at(1).alias("no_data"), at(2).alias("hidden"))


def coverage_distribution(cube: Cube) -> DataFrame:
    c = F.col("region_coverage")
    band = F.when(c < 0.2, 0).when(c < 0.4, 1).when(c < 0.6, 2).when(c < 0.8, 3).otherwise(4).cast("long")
    return mart(cube, "coverage").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("series"))


def month_series(cube: Cube) -> DataFrame:
    return cube.month.groupBy("series_key").agg(F.concat_ws(",", F.sort_array(F.collect_set("kind"))).alias("kinds"))


def month_timeline(cube: Cube, series_key: str, territory_code: str, kind: str) -> DataFrame:
    return cube.month.filter(_one(series_key) & (F.col("territory_code") == territory_code) & (F.col("kind") == kind)).select("year", "month", "value")


def month_latest(cube: Cube, series_key: str, kind: str, share: float = 0.8) -> DataFrame:
    """The last month that has values for enough regions, with its rows."""
    regions = cube.territory.filter("level = 'region' and not is_aggregate").select("territory_code")
    rows = cube.month.filter(_one(series_key) & (F.col("kind") == kind) & _known()).join(F.broadcast(regions), "territory_code")
    counts = rows.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))
    last = counts.withColumn("peak", F.max("n").over(Window.partitionBy())).filter(F.col("n") >= share * F.col("peak")).agg(F.max(F.struct("year", "month")).alias("m")).select("m.year", "m.month")
    return rows.join(F.broadcast(last), ["year", "month"]).select("territory_code", "year", "month", "value")


def month_points(cube: Cube, territory_code: str, series_keys: Sequence[str]) -> DataFrame:
    return cube.month.filter((F.col("territory_code") == territory_code) & F.col("series_key").isin(*series_keys)).select("series_key", "year", "month", "kind", "value")


def month_change(cube: Cube, territory_code: str) -> DataFrame:
    """Latest month of each series beside the same month of the year before."""
    rows = cube.month.filter((F.col("territory_code") == territory_code) & (F.col("kind") == "level") & _known())
    last = rows.groupBy("series_key").agg(F.max(F.struct("year", "month", "value")).alias("l")).select("series_key", "l.year", "l.month", "l.value")
    before = rows.select("series_key", (F.col("year") + 1).alias("year"), "month", F.col("value").alias("before"))
    return last.join(before, ["series_key", "year", "month"], "left").withColumn("percent", F.round(F.when(F.col("before") > 0, (F.col("value") / F.col("before") - 1) * 100), 4))


def population_start(cube: Cube) -> DataFrame:
    """Population at a year's start: the number at the end of the year before, for every year of the cube."""
    years = cube.observation.select("year").distinct()
    return cube.population.crossJoin(F.broadcast(years)).select("territory_code", (F.col("year") + 1).alias("year"), "population")


def edition_contents(cube: Cube, editions: Sequence[int]) -> DataFrame:
    """What editions hold: annual rows and, of the months, all that stand for the last edition."""
    annual = cube.vintage.filter(F.col("edition").isin(*editions) & _known()).groupBy("series_key").agg(F.count(F.lit(1)).alias("n"), F.max("year").alias("last_year")).withColumn("part", F.lit("annual"))
    monthly = cube.month.filter(_known()).groupBy("series_key").agg(F.count(F.lit(1)).alias("n"), F.max("year").alias("last_year")).withColumn("part", F.lit("monthly"))
    return annual.unionByName(monthly)


def dataset_territories(cube: Cube, series_keys: Sequence[str]) -> DataFrame:
    """Per territory, in how many series it has a value in the series' last year."""
    rows = cube.observation.filter(F.col("series_key").isin(*series_keys) & _known())
    last = rows.withColumn("last", F.max("year").over(Window.partitionBy("series_key"))).filter("year = last")
    return last.groupBy("territory_code").agg(F.count_distinct("series_key").alias("series"))


def unique_keys(cube: Cube) -> DataFrame:
    """Keys that stand more than once, by relation; none in a sound cube."""
    keys = {"observation": ["series_key", "territory_code", "year"], "vintage": ["series_key", "territory_code", "year", "edition"], "month": ["series_key", "territory_code", "year", "month", "kind"], "territory": ["territory_code"]}
    parts = [getattr(cube, name).groupBy(*key).count().agg(F.lit(name).alias("relation"), F.count(F.lit(1)).alias("keys"), F.sum((F.col("count") > 1).cast("long")).alias("repeated")) for name, key in keys.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

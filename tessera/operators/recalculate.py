"""Recalculated series of a user's table, its plan, and where values come from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.facts import EXTERNAL

#: Most derived series of a plan.
MAX_DERIVED = 1_500
#: Measures that are no totals, and those in money.
AVERAGES, MONEY = ("avg_price",), ("revenue", "avg_price")


def ratio(rows: DataFrame, above: str, below: str) -> DataFrame:
    """Annual values of one series over those of another."""
    a, b = (rows.filter(F.col("series_key") == k).select("territory_code", "year", F.col("value").alias(v)) for k, v in ((above, "a"), (below, "b")))
    return a.join(b, ["territory_code", "year"]).filter("a is not null and b <> 0").select("territory_code", "year", F.round(F.col("a") / F.col("b"), 6).alias("value"))


def per_area(rows: DataFrame, areas: DataFrame) -> DataFrame:
    """Values per unit of area (territory_code, area); territories without an area are left out."""
    return rows.filter("value is not null").join(areas.filter("area > 0"), "territory_code").select("territory_code", "year", F.round(F.col("value") / F.col("area"), 6).alias("value"))


def underivable(parts: DataFrame, territory: DataFrame) -> DataFrame:
    """Parts whose value is missing, so that their whole (the district) cannot be derived."""
    own = territory.filter("level = 'region' and not is_aggregate").select(F.col("territory_code").alias("part"), F.col("district_code").alias("whole"))
    return parts.filter("value is null").select(F.col("territory_code").alias("part"), "year").join(own, "part").select("whole", "part", "year").distinct()


def real_target(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """The year in whose prices each series is told: the last of its values, or of the prices if that is earlier."""
    last = prices.agg(F.max("year").alias("_prices"))
    return rows.filter("value is not null").groupBy("series_key").agg(F.max("year").alias("_last")).crossJoin(F.broadcast(last)).select("series_key", F.least("_last", "_prices").alias("target"))


def real_ratio(rows: DataFrame, prices: DataFrame, first: int, last: int) -> DataFrame:
    """Nominal growth from ``first`` to ``last`` over growth of prices, chained from yearly ratios; null if a year of prices is missing. Prices: year, value."""
    before = prices.select((F.col("year") + 1).alias("year"), F.col("value").alias("before"))
    steps = prices.join(before, "year").filter(F.col("year").between(first + 1, last) & (F.col("value") > 0) & (F.col("before") > 0))
    chain = steps.agg(F.exp(F.sum(F.ln(F.col("value") / F.col("before")))).alias("p"), F.count(F.lit(1)).alias("n"))
    at = lambda y: F.max(F.when(F.col("year") == y, F.col("value")))
    ends = rows.filter(F.col("year").isin(first, last)).groupBy("territory_code").agg(at(first).alias("x"), at(last).alias("y")).filter("x > 0 and y is not null")
    return ends.crossJoin(F.broadcast(chain)).select("territory_code", F.round(F.when(F.col("n") == last - first, F.col("y") / F.col("x") / F.col("p")), 6).alias("real_ratio"))


def user_months(months: DataFrame, prefix: str) -> DataFrame:
    return months.select(F.concat(F.lit(f"{prefix}:"), "series_key").alias("series_key"), "territory_code", "year", "month", "kind", "value")


def user_observations(rows: DataFrame, territory: DataFrame) -> DataFrame:
    """Facts of a table with level and district of their territories; strangers are left out (see ``outside``)."""
    return rows.join(F.broadcast(territory.select("territory_code", F.col("level").alias("territory_level"), "district_code", "is_aggregate")), "territory_code")


def outside(rows: DataFrame, territory: DataFrame) -> DataFrame:
    """Territories of a table that the directory does not have, and their rows."""
    return rows.join(F.broadcast(territory.select("territory_code")), "territory_code", "left_anti").groupBy("territory_code").agg(F.count(F.lit(1)).alias("n"))


def append_vintage(vintage: DataFrame, observation: DataFrame, edition: int) -> DataFrame:
    """``vintage`` with a version's observations as one more edition."""
    return vintage.unionByName(observation.select("series_key", "territory_code", "year", F.lit(edition).cast("long").alias("edition"), "value", "quality"))


def version_totals(observation: DataFrame) -> DataFrame:
    known = F.when(F.col("value").isNotNull(), True)
    return observation.agg(
        F.count(F.lit(1)).alias("cells"), F.count("value").alias("values"), F.count_distinct("series_key").alias("series"), F.count_distinct(F.when(known, F.col("territory_code"))).alias("territories"),
        F.min(F.when(known, F.col("year"))).alias("first_year"), F.max(F.when(known, F.col("year"))).alias("last_year"),
    )


def derived_plan(observation: DataFrame, most: int = MAX_DERIVED) -> DataFrame:
    """Series to derive from each base series that has values: growth for all; share, per capita and folded ones of totals. A plan of more than ``most`` is refused."""
    base = observation.filter("value is not null").select("series_key").distinct()
    kinds = F.when(F.split("series_key", ":")[0].isin(*AVERAGES), F.array(F.lit("growth"))).otherwise(F.array(*[F.lit(k) for k in ("growth", "share", "per_capita", "folded")]))
    plan = base.select(F.col("series_key").alias("base_key"), F.explode(kinds).alias("kind")).select(F.concat_ws("#", "base_key", "kind").alias("derived_key"), "base_key", "kind")
    if (n := plan.count()) > most:
        raise ValueError(f"{n} derived series, {most} at most")
    return plan


def folds(series: DataFrame) -> DataFrame:
    """Groups of two or more parts under a total key: a slice ``a/b`` under ``a``, a slice ``a`` under ``00``; the total is no member."""
    key, cut = F.col("series_key"), F.split("series_key", "/")[0]
    total = F.when(F.contains(key, F.lit("/")), cut).otherwise(F.concat(F.split("series_key", ":")[0], F.lit(":00")))
    g = series.withColumn("total_key", total).filter("series_key <> total_key").groupBy("total_key").agg(F.count(F.lit(1)).alias("members"), F.array_join(F.array_sort(F.collect_list("series_key")), ",").alias("keys"))
    return g.filter("members >= 2")


def per_person_unit(rows: DataFrame, population: DataFrame) -> DataFrame:
    """The magnitude in which money per inhabitant is told, by the median."""
    m = rows.filter("value is not null").join(population.filter("population > 0"), "territory_code").groupBy("series_key").agg(F.median(F.col("value") / F.col("population")).alias("m"))
    return m.select("series_key", F.round("m", 6).alias("middle"), F.when(F.col("m") >= 1e6, "mln").when(F.col("m") >= 1e3, "thousand").otherwise("one").alias("unit"))


def guess_kind(name: Column, unit: Column) -> Column:
    """relative, average or total, by name and unit."""
    low = F.lower(F.concat_ws(" ", name, unit))
    return F.when(F.rlike(low, F.lit("index|rate|percent|share|%")), "relative").when(F.rlike(low, F.lit("average|mean|standard")), "average").otherwise("total")


def verdicts(measures: DataFrame) -> DataFrame:
    """Which actions a measure allows: averages are not summed, shared out or told per head; only money is deflated."""
    actions = F.explode(F.array(*[F.lit(a) for a in ("sum", "share", "per_capita", "growth", "deflate")]))
    refused = (F.col("action").isin("sum", "share", "per_capita") & F.col("measure").isin(*AVERAGES)) | ((F.col("action") == "deflate") & ~F.col("measure").isin(*MONEY))
    return measures.withColumn("action", actions).withColumn("verdict", F.when(refused, "refused").otherwise("allowed"))


def unit_scale(unit: Column) -> Column:
    """A unit and the factor in front of it."""
    scale = F.regexp_extract(unit, r"^(thousand|mln|million|bn|billion) ", 1)
    return F.struct(F.trim(F.regexp_replace(unit, r"^(thousand|mln|million|bn|billion) ", "")).alias("base"), T.unit_multiplier(scale).alias("factor"))


# Origins


def source_years(rows: DataFrame) -> DataFrame:
    """Years of each series that come from sources, with all their flags. Rows: series_key, year, flags."""
    return rows.filter(F.col("flags").bitwiseAND(EXTERNAL) > 0).groupBy("series_key", "year").agg(F.count(F.lit(1)).alias("n"), F.bit_or("flags").alias("flags"))


def year_origin(rows: DataFrame) -> DataFrame:
    """The edition of a source that gives most values of a series' year. Rows: series_key, year, edition_code, flags."""
    g = rows.filter(F.col("flags").bitwiseAND(EXTERNAL) > 0).groupBy("series_key", "year", "edition_code").agg(F.count(F.lit(1)).alias("n"), F.bit_or("flags").alias("flags"))
    order = Window.partitionBy("series_key", "year").orderBy(F.desc("n"), "edition_code")
    return g.withColumn("_i", F.row_number().over(order)).filter("_i = 1").drop("_i")


def source_links(links: DataFrame, editions: DataFrame) -> DataFrame:
    """Links (series_key, source) with the latest edition of the source, if it has one."""
    day = F.coalesce("released_on", F.make_date(F.col("edition_year").cast("int"), F.lit(12), F.lit(31)))
    order = Window.partitionBy("source").orderBy(F.desc("edition_year"), F.desc(day), "edition_code")
    latest = editions.withColumn("_i", F.row_number().over(order)).filter("_i = 1").select("source", "edition_code")
    return links.join(latest, "source", "left").select("series_key", "source", "edition_code")


def month_page(month: DataFrame, series_key: str, kind: str, first: int, last: int, limit: int, offset: int) -> DataFrame:
    """A page of a series' months in order, and how many there are."""
    rows = month.filter((F.col("series_key") == series_key) & (F.col("kind") == kind) & F.col("year").between(first, last)).select("territory_code", "year", "month", "value")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy("territory_code", "year", "month").offset(offset).limit(limit).crossJoin(F.broadcast(total))


def edition_territories(vintage: DataFrame, month: DataFrame, editions: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """Distinct series of each territory in some editions and in the months."""
    own = vintage.filter(F.col("edition").isin(*editions) & F.col("value").isNotNull()).select("territory_code", "series_key")
    both = own.unionByName(month.filter("value is not null").select("territory_code", "series_key")).filter(F.col("series_key").isin(*keys))
    return both.groupBy("territory_code").agg(F.count_distinct("series_key").alias("series"))


def build_metadata(observation: DataFrame, vintage: DataFrame) -> DataFrame:
    """Keys and values that describe a build."""
    known = F.when(F.col("value").isNotNull(), F.col("year"))
    row = observation.agg(F.count(F.lit(1)).alias("observations"), F.min(known).alias("first_year"), F.max(known).alias("last_year")).crossJoin(vintage.agg(F.count_distinct("edition").alias("editions")))
    return row.select(F.explode(F.create_map(*[x for c in ("observations", "first_year", "last_year", "editions") for x in (F.lit(c), F.col(c).cast("string"))])).alias("key", "value"))


def largest_changes(changes: DataFrame, limit: int) -> DataFrame:
    """The largest relative changes; those without one come last."""
    return changes.orderBy(F.abs("change").desc_nulls_last(), "series_key", "territory_code", "year").limit(limit).select("series_key", "territory_code", "year", "old", "new", "change")

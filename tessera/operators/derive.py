"""Derived series: per head, shares, growth, constant prices, folds, groups and version changes.

All take frames of (series_key, territory_code, year, value) rows, such as the cube's observations.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.cube import Cube
from tessera.plans.staging import stored

PER = (1, 1_000, 10_000, 100_000)


def rows_of(cube: Cube, series_key: str) -> DataFrame:
    return cube.observation.filter((F.col("series_key") == series_key) & F.col("value").isNotNull()).select("territory_code", "year", "value", "territory_level", "district_code", "is_aggregate")


def regions_of(cube: Cube, series_key: str) -> DataFrame:
    return rows_of(cube, series_key).filter("territory_level = 'region' and not is_aggregate")


def per_capita(rows: DataFrame, population: DataFrame, per: int = 1_000) -> DataFrame:
    """Value per ``per`` inhabitants; places without inhabitants are left out."""
    return rows.join(population, "territory_code").filter("population > 0").select("territory_code", "year", F.round(F.col("value") / F.col("population") * per, 4).alias("value"))


def frozen_population(population_by_year: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with the population of their year, or of the last year known before, which is then marked frozen."""
    last = population_by_year.groupBy("territory_code").agg(F.max("year").alias("last_year"))
    wanted = rows.join(last, "territory_code").withColumn("population_year", F.least("year", "last_year"))
    known = population_by_year.select("territory_code", F.col("year").alias("population_year"), "population")
    return wanted.join(known, ["territory_code", "population_year"]).select("territory_code", "year", "value", "population", (F.col("year") > F.col("last_year")).alias("frozen"))


def middle_per_person(rows: DataFrame, population: DataFrame) -> DataFrame:
    """The median absolute value per inhabitant, from which a unit's magnitude is chosen."""
    return rows.join(population, "territory_code").filter("population > 0").agg(F.round(F.median(F.abs("value") / F.col("population")), 8).alias("middle"))


def fold(cube: Cube, series_keys: Sequence[str]) -> DataFrame:
    """Sum of slices where all are present."""
    rows = cube.observation.filter(F.col("series_key").isin(*series_keys) & F.col("value").isNotNull())
    return rows.groupBy("territory_code", "year").agg(F.round(F.sum("value"), 4).alias("value"), F.count(F.lit(1)).alias("parts")).filter(F.col("parts") == len(series_keys)).drop("parts")


def fold_months(months: DataFrame) -> DataFrame:
    """Years of twelve months: sum, mean and December."""
    level = months.filter("kind = 'level' and value is not null").groupBy("series_key", "territory_code", "year")
    return level.agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.max(F.when(F.col("month") == 12, F.col("value"))).alias("december"), F.count(F.lit(1)).alias("n")).filter("n = 12").drop("n")


def growth(rows: DataFrame) -> DataFrame:
    """Percent of the previous year; the base must be positive."""
    before = rows.select("territory_code", (F.col("year") + 1).alias("year"), F.col("value").alias("before"))
    return rows.join(before, ["territory_code", "year"]).filter("before > 0").select("territory_code", "year", F.round(F.col("value") / F.col("before") * 100, 4).alias("value"))


def share(rows: DataFrame) -> DataFrame:
    """Percent of the regions' sum of the year."""
    total = F.sum("value").over(Window.partitionBy("year"))
    return rows.withColumn("total", total).filter("total > 0").select("territory_code", "year", F.round(F.col("value") / F.col("total") * 100, 4).alias("value"))


def to_country(regions: DataFrame, country: DataFrame) -> DataFrame:
    """Country = 100; without a country value the regions' sum stands for it."""
    total = regions.groupBy("year").agg(F.sum("value").alias("sum"))
    base = total.join(country.select("year", F.col("value").alias("own")), "year", "left").select("year", F.coalesce("own", "sum").alias("base"))
    return regions.join(base, "year").filter("base > 0").select("territory_code", "year", F.round(F.col("value") / F.col("base") * 100, 4).alias("value"))


def constant_prices(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Values in the prices of the last year of both, by a chain of yearly indices (percent of the year before).

    A value is left out where a year between it and the base has no index: then the chain's place does not
    equal the distance in years.
    """
    up = Window.partitionBy("territory_code").orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chain = index.filter("value > 0").select("territory_code", "year", F.sum(F.ln(F.col("value") / 100)).over(up).alias("chain"), F.row_number().over(up).alias("place"))
    last = rows.groupBy("territory_code").agg(F.max("year").alias("value_year")).join(index.groupBy("territory_code").agg(F.max("year").alias("index_year")), "territory_code").select("territory_code", F.least("value_year", "index_year").alias("base_year"))
    base = last.join(chain.select("territory_code", F.col("year").alias("base_year"), F.col("chain").alias("base_chain"), F.col("place").alias("base_place")), ["territory_code", "base_year"])
    own = rows.join(chain, ["territory_code", "year"]).join(base, "territory_code")
    whole = (F.col("base_place") - F.col("place")) == (F.col("base_year") - F.col("year"))
    return own.filter((F.col("year") <= F.col("base_year")) & whole).select("territory_code", "year", F.round(F.col("value") * F.exp(F.col("base_chain") - F.col("chain")), 2).alias("value"))


def group_totals(rows: DataFrame, population: DataFrame, codes: Sequence[str], is_sum: bool = True) -> DataFrame:
    """A group of regions against the rest: sums, or means weighted by population."""
    flagged = rows.withColumn("in_group", F.col("territory_code").isin(*codes))
    if is_sum:
        return flagged.groupBy("year", "in_group").agg(F.round(F.sum("value"), 4).alias("value"), F.count(F.lit(1)).alias("n"))
    weighted = flagged.join(population, "territory_code")
    return weighted.groupBy("year", "in_group").agg(F.round(F.sum(F.col("value") * F.col("population")) / F.sum("population"), 6).alias("value"), F.count(F.lit(1)).alias("n"))


def summary(cube: Cube) -> DataFrame:
    """Per series: values, regions, years, whether all are whole numbers, median of absolute values."""
    rows = cube.regions.filter("value is not null")
    return rows.groupBy("series_key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("territory_code").alias("regions"), F.count_distinct("year").alias("years"), F.every(F.col("value") == F.floor("value")).alias("whole"), F.round(F.median(F.abs("value")), 6).alias("middle"))


def version_changes(cube: Cube, old: int, new: int) -> DataFrame:
    """Cells of two editions side by side: changed, appeared and lost values per series, median relative change."""
    cell = ["series_key", "territory_code", "year"]
    at = lambda e, name: cube.vintage.filter((F.col("edition") == e) & F.col("value").isNotNull()).select(*cell, F.col("value").alias(name))
    both = at(old, "old").join(at(new, "new"), cell, "full")
    changed = F.col("old").isNotNull() & F.col("new").isNotNull() & (F.abs(F.col("new") - F.col("old")) > 1e-9 * F.greatest(F.lit(1.0), F.abs("old")))
    rel = F.when(changed & (F.col("old") != 0), F.abs(F.col("new") / F.nullif("old", F.lit(0.0)) - 1))
    return both.groupBy("series_key").agg(
        F.count(F.when(changed, 1)).alias("changed"), F.count(F.when(F.col("old").isNull(), 1)).alias("appeared"), F.count(F.when(F.col("new").isNull(), 1)).alias("lost"), F.round(F.median(rel), 6).alias("median_rel"), F.count(F.when(rel >= 0.05, 1)).alias("over_5_percent")
    )


def composite_alone(rows: DataFrame, total: str, parts: Sequence[str]) -> DataFrame:
    """A total without its parts, where all parts are present and the rest is not negative."""
    part = rows.filter(F.col("territory_code").isin(*parts)).groupBy("year").agg(F.sum("value").alias("parts_sum"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(parts))
    whole = rows.filter(F.col("territory_code") == total)
    return whole.join(part, "year").withColumn("rest", F.round(F.col("value") - F.col("parts_sum"), 4)).filter("rest >= 0").select("year", F.col("rest").alias("value"))


def country_as_sum(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """series_key, year and the sum of all ``regions`` (territory_code), of the years in which every one has a value. Rows: series_key, territory_code, year, value."""
    universe = regions.select("territory_code").distinct()
    sums = rows.filter("value is not null").join(F.broadcast(universe), "territory_code").groupBy("series_key", "year").agg(F.round(F.sum("value"), 4).alias("value"), F.count(F.lit(1)).alias("n"))
    return sums.join(F.broadcast(universe.agg(F.count(F.lit(1)).alias("all"))), F.col("n") == F.col("all")).select("series_key", "year", "value")


def weighted_year_mean(levels: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean of twelve months weighted by another monthly measure."""
    both = levels.join(weights.withColumnRenamed("value", "weight"), ["territory_code", "year", "month"])
    return both.groupBy("territory_code", "year").agg(F.round(F.sum(F.col("value") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0)), 4).alias("value"), F.count(F.lit(1)).alias("n")).filter("n = 12").drop("n")


def ratio_months(top: DataFrame, bottom: DataFrame, factor: float = 1.0) -> DataFrame:
    both = top.join(bottom.withColumnRenamed("value", "below"), ["territory_code", "year", "month"])
    return both.filter("below <> 0").select("territory_code", "year", "month", F.round(F.col("value") / F.col("below") * factor, 7).alias("value"))


def dependency_levels(definitions: Sequence[tuple[str, str, str, float]], known: Iterable[str]) -> list[list[tuple[str, str, str, float]]]:
    """Definitions (key, numerator, denominator, factor) in rounds: what a round needs is known or made in rounds before. Raises ValueError for those that never can be made."""
    there, left, rounds = set(known), list(definitions), []
    while left:
        now = [d for d in left if d[1] in there and d[2] in there]
        if not now:
            raise ValueError(f"ratios of unknown series: {', '.join(sorted(d[0] for d in left))}")
        rounds.append(now)
        there |= {d[0] for d in now}
        left = [d for d in left if d not in now]
    return rounds


def resolve_ratios(months: DataFrame, definitions: Sequence[tuple[str, str, str, float]], known: Iterable[str]) -> DataFrame:
    """``months`` (series_key, territory_code, year, month, value, hidden, frozen) of the ``known`` series and of all ratios, of ratios too.

    A round is one join for all its definitions, however many; its result is written, so that the plan does not grow with the depth.
    A ratio stands where both operands have a row. It is hidden or frozen if one of them is; its value is null if one is hidden or null,
    or if the denominator is 0.
    """
    key = ["territory_code", "year", "month"]
    columns = ["series_key", *key, "value", "hidden", "frozen"]
    everything = months.select(*columns)
    for round_ in dependency_levels(definitions, known):
        asked = F.broadcast(months.sparkSession.createDataFrame(round_, "made string, numerator string, denominator string, factor double"))  # a row for each definition
        top = everything.join(asked, F.col("series_key") == F.col("numerator")).select("made", "denominator", "factor", *key, F.col("value").alias("top"), F.col("hidden").alias("top_hidden"), F.col("frozen").alias("top_frozen"))
        below = everything.select(F.col("series_key").alias("denominator"), *key, F.col("value").alias("below"), F.col("hidden").alias("below_hidden"), F.col("frozen").alias("below_frozen"))
        both = top.join(below, ["denominator", *key])
        hidden = F.col("top_hidden") | F.col("below_hidden")
        value = F.when(~hidden & (F.col("below") != 0), F.round(F.col("top") / F.col("below") * F.col("factor"), 7))
        made = both.select(F.col("made").alias("series_key"), *key, value.alias("value"), hidden.alias("hidden"), (F.col("top_frozen") | F.col("below_frozen")).alias("frozen"))
        everything = everything.unionByName(stored(made, "ratios"))
    return everything


def measure_change(value: Column, before: Column, kind: str) -> Column:
    """Change in points for shares, in percent for positive bases, else as a difference."""
    difference = F.round(value - before, 4)
    return difference if kind == "share" else F.when(before > 0, F.round((value / before - 1) * 100, 4)).otherwise(difference)

"""Facts from editions, corrections, releases of other sources and months; and what changed between two versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.staging import stored

#: Bits of a value's flags.
CORRECTED, EXTERNAL, CONDITIONAL, PRELIMINARY, REVISED = 32, 64, 128, 256, 512
CELL = ("series_key", "territory_code", "year")


def flags(**bits: Column) -> Column:
    """Flag bits of conditions named by the constants above, lower-cased."""
    out = F.lit(0)
    for name, condition in bits.items():
        out = out.bitwiseOR(F.when(condition, globals()[name.upper()]).otherwise(0))
    return out.cast("long")


def rank_editions(editions: DataFrame) -> DataFrame:
    """``editions`` (edition_code, edition_year, released_on) with ``edition_rank``: by year, then day (31 December if unknown), then code backwards. A dimension: one row for each publication."""
    day = F.coalesce("released_on", F.make_date(F.col("edition_year").cast("int"), F.lit(12), F.lit(31)))
    return editions.withColumn("edition_rank", F.row_number().over(Window.orderBy("edition_year", day, F.desc("edition_code"))).cast("long"))


def apply_corrections(facts: DataFrame, corrections: DataFrame) -> DataFrame:
    """``facts`` (cell, value, flags) with the new value of each correction (cell, old_value, new_value) whose old value is the one that stands there, null or not."""
    patched = facts.join(corrections, list(CELL), "left").withColumn("_hit", F.col("new_value").isNotNull() & F.col("value").eqNullSafe(F.col("old_value")))
    return patched.withColumn("value", F.when(F.col("_hit"), F.col("new_value")).otherwise(F.col("value"))).withColumn("flags", F.col("flags").bitwiseOR(F.when(F.col("_hit"), CORRECTED).otherwise(0))).drop("_hit", "old_value", "new_value")


def stale_corrections(facts: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections that fit no fact, and the value that stands there."""
    found = corrections.join(facts.select(*CELL, F.col("value").alias("found")), list(CELL), "left")
    return found.filter(~F.col("old_value").eqNullSafe(F.col("found"))).select(*CELL, "old_value", "found")


def quality_summary(observation: DataFrame) -> DataFrame:
    """Observations by quality, and the negative ones."""
    return observation.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") < 0, 1)).alias("negative"))


def edition_counters(vintage: DataFrame) -> DataFrame:
    return vintage.filter("value is not null").groupBy("edition").agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("series_key").alias("series"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


# Releases of other sources


def deviation(source: Column, dataset: Column, points: bool = False) -> Column:
    """Absolute (``points``) or relative to the dataset; a dataset value of 0 is met by 0 only (else the deviation is infinite)."""
    gap = F.abs(source - dataset)
    return gap if points else F.when(dataset == 0, F.when(source == 0, 0.0).otherwise(float("inf"))).otherwise(F.try_divide(gap, F.abs(dataset)))


def within(source: Column, dataset: Column, tolerance: float, points: bool = False) -> Column:
    return deviation(source, dataset, points) <= tolerance


def reconcile(source: DataFrame, dataset: DataFrame, tolerance: float, years: int = 3) -> DataFrame:
    """Per series: how a source agrees with the dataset over the last ``years`` common years before the dataset's last: cells, share within tolerance, median and largest deviation, and the worst cell."""
    last = dataset.groupBy("series_key").agg(F.max("year").alias("last_year"))
    both = source.select(*CELL, F.col("value").alias("s")).join(dataset.select(*CELL, F.col("value").alias("d")), list(CELL)).filter("s is not null and d is not null").join(last, "series_key").filter("year < last_year")
    recent = both.withColumn("age", F.dense_rank().over(Window.partitionBy("series_key").orderBy(F.desc("year")))).filter(F.col("age") <= years).withColumn("off", deviation(F.col("s"), F.col("d")))
    worst = F.max(F.struct("off", "territory_code", "year")).alias("worst")
    out = recent.groupBy("series_key").agg(F.count(F.lit(1)).alias("cells"), F.avg(F.when(F.col("off") <= tolerance, 1.0).otherwise(0.0)).alias("share"), F.median("off").alias("median_off"), worst)
    return out.select("series_key", "cells", F.round("share", 6).alias("share"), F.round("median_off", 6).alias("median_off"), F.round("worst.off", 6).alias("largest_off"), F.col("worst.territory_code").alias("worst_territory"), F.col("worst.year").alias("worst_year"))


def stitch(source: DataFrame, dataset: DataFrame, tolerance: float, full_share: float = 0.95) -> DataFrame:
    """The dataset continued by a source: its years after the dataset's last, and the last year's values where they differ, if the source agrees in full (share of cells within tolerance); series that agree less are continued conditionally."""
    verdict = reconcile(source, dataset, tolerance).select("series_key", (F.col("share") >= full_share).alias("full"))
    last = dataset.groupBy("series_key").agg(F.max("year").alias("last_year"))
    new = source.filter("value is not null").join(last, "series_key").join(verdict, "series_key")
    old = dataset.select(*CELL, F.col("value").alias("old"))
    new = new.filter("year >= last_year").join(old, list(CELL), "left")
    revises = (F.col("year") == F.col("last_year")) & F.col("full") & F.col("old").isNotNull() & ~within(F.col("value"), F.col("old"), tolerance)
    taken = new.withColumn("_revises", revises).filter("year > last_year or _revises")
    out = taken.select(*CELL, "value", flags(external=F.lit(True), conditional=~F.col("full"), revised=F.col("_revises")).alias("flags"))
    kept = dataset.join(taken.select(*CELL), list(CELL), "left_anti").select(*CELL, "value", F.lit(0).cast("long").alias("flags"))
    return kept.unionByName(out)


def stitch_releases(releases: DataFrame, dataset: DataFrame, links: DataFrame, tolerance: float, full_share: float = 0.95) -> DataFrame:
    """What the releases of a source add to the dataset, release by release.

    ``releases``: cell, value, hidden, preliminary, release (later ones are larger); ``dataset``: cell, value;
    ``links``: series_key, mode, same_statistic. A link that continues takes the years after the dataset's last,
    hidden values too, and in the last year itself what the source revises, if the link is full (the latest release
    agrees with the dataset in ``full_share`` of the cells compared) and publishes the same statistic; a link
    that agrees less, or shares no cell, is conditional. A link that supersedes takes every value of a release,
    those within tolerance as well, so that a series does not mix publications. A value is preliminary by itself or
    in its release's newest year, and revises where the dataset has a value off by more than ``tolerance``, or none.
    """
    by_link = releases.join(links, "series_key").join(dataset.groupBy("series_key").agg(F.max("year").alias("last_year")), "series_key")
    newest = releases.groupBy("series_key", "release").agg(F.max(F.when(F.col("value").isNotNull(), F.col("year"))).alias("newest_year"))
    latest = newest.groupBy("series_key").agg(F.max("release").alias("latest"))
    recent = releases.join(latest, "series_key").filter("release = latest")
    verdict = reconcile(recent, dataset, tolerance).select("series_key", "share")
    rows = by_link.join(newest, ["series_key", "release"]).join(latest, "series_key").join(verdict, "series_key", "left")
    rows = rows.join(dataset.select(*CELL, F.col("value").alias("old")), list(CELL), "left")
    agrees = F.coalesce(F.col("share") >= full_share, F.lit(False))
    rows = rows.withColumn("kind", F.when(F.col("mode") == "supersede", "revision").when(agrees, "full").otherwise("conditional"))
    rows = rows.withColumn("revises", F.when(F.col("old").isNull(), True).when(F.col("value").isNull(), False).otherwise(~within(F.col("value"), F.col("old"), tolerance)))
    last = (F.col("year") == F.col("last_year")) & (F.col("kind") == "full") & F.col("same_statistic") & F.col("revises")
    taken = rows.filter(F.when(F.col("mode") == "supersede", F.col("value").isNotNull()).otherwise((F.col("year") > F.col("last_year")) | last))
    corrects = F.col("revises") & F.col("old").isNotNull() & (F.col("year") <= F.col("last_year"))
    bits = flags(external=F.lit(True), conditional=F.col("kind") == "conditional", preliminary=F.col("preliminary") | F.coalesce(F.col("year") == F.col("newest_year"), F.lit(False)), revised=corrects)
    return taken.select(*CELL, "release", F.when(~F.col("hidden"), F.col("value")).alias("value"), "hidden", bits.alias("flags"), "mode", "kind", "last_year", (F.col("release") == F.col("latest")).alias("is_latest"))


def link_outcomes(added: DataFrame) -> DataFrame:
    """Per link of ``stitch_releases``: mode, kind, values added, those that the latest release revises, first and last year beyond the dataset."""
    beyond = F.when(F.col("year") > F.col("last_year"), F.col("year"))
    revised = F.col("is_latest") & (F.col("flags").bitwiseAND(F.lit(REVISED)) > 0)
    return added.groupBy("series_key", "mode", "kind").agg(F.count(F.lit(1)).alias("vintages"), F.count_if(revised).alias("revised"), F.when(F.max(beyond).isNotNull(), F.max("last_year") + 1).alias("junction_year"), F.max(beyond).alias("last_year"))


def resolve_releases(added: DataFrame, dataset: DataFrame) -> DataFrame:
    """One value for each cell: that of the latest release that has one, else the dataset's, else none. One aggregate, without a sort."""
    both = dataset.select(*CELL, F.lit(None).cast("long").alias("release"), "value", F.lit(0).cast("long").alias("flags")).unionByName(added.select(*CELL, F.col("release").cast("long").alias("release"), "value", "flags"))
    best = F.max(F.struct(F.col("value").isNotNull().alias("known"), "release", "value", "flags")).alias("b")
    return both.groupBy(*CELL).agg(best).select(*CELL, "b.release", "b.value", "b.flags")


def latest_release(releases: DataFrame) -> DataFrame:
    """The last release of each source by reference year, day of publication and day of fetching."""
    order = Window.partitionBy("source").orderBy(F.desc("reference_year"), F.desc("published_on"), F.desc("fetched_at"))
    return releases.withColumn("_i", F.row_number().over(order)).filter("_i = 1").drop("_i")


# Annual values of shorter periods


def mean_of_periods(periods: DataFrame, count: int) -> DataFrame:
    """Mean of complete years; a hidden period hides the year. Rows: cell, period, value, hidden."""
    g = periods.groupBy(*CELL).agg(F.count_distinct("period").alias("n"), F.bool_or("hidden").alias("hidden"), F.avg("value").alias("mean"))
    return g.filter(F.col("n") == count).select(*CELL, F.when(~F.col("hidden"), F.round("mean", 6)).alias("value"), "hidden")


def annual_of(periods: DataFrame, method: str) -> DataFrame:
    """Annual values by method: year_total (sum of twelve), december, january_next (of the year before), mean_months, mean_quarters (of quarterly sums)."""
    month = F.col("period")
    if method == "december":
        return periods.filter(month == 12).select(*CELL, "value")
    if method == "january_next":
        return periods.filter(month == 1).select("series_key", "territory_code", (F.col("year") - 1).alias("year"), "value")
    if method == "mean_months":
        return mean_of_periods(periods.withColumn("hidden", F.lit(False)), 12).select(*CELL, "value")
    if method == "mean_quarters":
        quarters = periods.groupBy(*CELL, F.ceil(month / 3).alias("period")).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n")).filter("n = 3")
        return mean_of_periods(quarters.withColumn("hidden", F.lit(False)), 4).select(*CELL, "value")
    if method == "year_total":
        return periods.groupBy(*CELL).agg(F.count_distinct("period").alias("n"), F.round(F.sum("value"), 4).alias("value")).filter("n = 12").select(*CELL, "value")
    raise ValueError(f"no such method: {method}")


def real_wage(wages: DataFrame, prices: DataFrame) -> DataFrame:
    """Growth of nominal wages over growth of the year's mean price level, in percent; the level is chained from monthly indices (percent of the month before). Wages: territory_code, year, value; prices: territory_code, year, period, value."""
    chain = Window.partitionBy("territory_code").orderBy("year", "period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = prices.filter("value > 0").withColumn("level", F.exp(F.sum(F.ln(F.col("value") / 100)).over(chain)))
    mean = level.groupBy("territory_code", "year").agg(F.avg("level").alias("level"), F.count(F.lit(1)).alias("n")).filter("n = 12")
    now = wages.filter("value > 0").join(mean, ["territory_code", "year"])
    before = now.select("territory_code", (F.col("year") + 1).alias("year"), F.col("value").alias("value0"), F.col("level").alias("level0"))
    return now.join(before, ["territory_code", "year"]).select("territory_code", "year", F.round(F.col("value") / F.col("value0") / (F.col("level") / F.col("level0")) * 100, 4).alias("real_wage"))


def parts_as_sum(months: DataFrame, members: DataFrame, complete: bool = True) -> DataFrame:
    """Months of wholes as sums of their parts (members: territory_code, whole), only where all parts are there."""
    size = members.groupBy("whole").agg(F.count(F.lit(1)).alias("size"))
    out = months.filter("value is not null").join(members, "territory_code").groupBy("series_key", "whole", "year", "month").agg(F.round(F.sum("value"), 4).alias("value"), F.count(F.lit(1)).alias("n")).join(size, "whole")
    return (out.filter("n = size") if complete else out).select("series_key", F.col("whole").alias("territory_code"), "year", "month", "value")


def latest_months(months: DataFrame) -> DataFrame:
    """The latest edition of each month and kind. Rows: cell, month, kind, edition, value."""
    best = months.groupBy(*CELL, "month", "kind").agg(F.max_by(F.struct("value", "edition"), "edition").alias("b"))
    return best.select(*CELL, "month", "kind", "b.value", "b.edition")


# Two versions of the data


def changed_values(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells changed (beyond 1e-9 of the larger of 1 and the old value), appeared or lost, with the change."""
    both = old.select(*CELL, F.col("value").alias("old")).join(new.select(*CELL, F.col("value").alias("new")), list(CELL), "full")
    what = F.when(F.col("old").isNull() & F.col("new").isNotNull(), "appeared").when(F.col("new").isNull() & F.col("old").isNotNull(), "lost").when(F.abs(F.col("new") - F.col("old")) > 1e-9 * F.greatest(F.lit(1.0), F.abs("old")), "changed")
    return both.withColumn("what", what).filter("what is not null").withColumn("change", F.round(F.when((F.col("what") == "changed") & (F.col("old") != 0), (F.col("new") - F.col("old")) / F.abs("old")), 6))


def changed_series(old: DataFrame, new: DataFrame, alike: float = 0.85) -> DataFrame:
    """Series added, removed or renamed (series_key, title): a removed and an added one of the same measure whose titles are alike are one, the nearest pair first."""
    gone, come = old.join(new, "series_key", "left_anti"), new.join(old, "series_key", "left_anti")
    block = lambda df, k, t: df.select(F.col("series_key").alias(k), F.col("title").alias(t), F.split("series_key", ":")[0].alias("block"))
    pair = block(gone, "old_key", "old_title").join(block(come, "new_key", "new_title"), "block").withColumn("score", 1 - F.levenshtein("old_title", "new_title") / F.greatest(F.length("old_title"), F.length("new_title"))).filter(F.col("score") >= alike)
    first = lambda k, *o: F.row_number().over(Window.partitionBy(k).orderBy(F.desc("score"), *o))
    renamed = pair.withColumn("_a", first("old_key", "new_key")).withColumn("_b", first("new_key", "old_key")).filter("_a = 1 and _b = 1").select("old_key", "new_key")
    removed = gone.join(renamed, F.col("series_key") == F.col("old_key"), "left_anti").select(F.lit("removed").alias("what"), F.col("series_key").alias("old_key"), F.lit(None).cast("string").alias("new_key"))
    added = come.join(renamed, F.col("series_key") == F.col("new_key"), "left_anti").select(F.lit("added").alias("what"), F.lit(None).cast("string").alias("old_key"), F.col("series_key").alias("new_key"))
    return renamed.select(F.lit("renamed").alias("what"), "old_key", "new_key").unionByName(removed).unionByName(added)


def changed_units(old: DataFrame, new: DataFrame) -> DataFrame:
    """Series whose unit differs, null or not. Rows: series_key, unit."""
    return old.select("series_key", F.col("unit").alias("old_unit")).join(new.select("series_key", F.col("unit").alias("new_unit")), "series_key").filter(~F.col("old_unit").eqNullSafe(F.col("new_unit")))


def changed_notes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Note texts that came and went."""
    come, gone = new.select("note").exceptAll(old.select("note")), old.select("note").exceptAll(new.select("note"))
    return come.select("note", F.lit("new").alias("what")).unionByName(gone.select("note", F.lit("gone").alias("what"))).distinct()


# Quality


def ambiguous_units(series: DataFrame) -> DataFrame:
    """Series with a composite unit (``a, b``) whose ratio is unknown. Rows: series_key, unit, country_unit, ratio."""
    return series.filter(F.col("country_unit").isNotNull() & (F.col("country_unit") != F.col("unit")) & F.col("ratio").isNull()).select("series_key", "unit", "country_unit").distinct()


def unit_scale_conflicts(rows: DataFrame) -> DataFrame:
    """Series whose rows give the country more than one scale. Rows: series_key, scale."""
    g = rows.filter("scale is not null").groupBy("series_key").agg(F.count_distinct("scale").alias("scales"), F.array_join(F.array_sort(F.collect_set(F.col("scale").cast("long").cast("string"))), ",").alias("list"))
    return g.filter("scales > 1")


def suspicious_zeros(rows: DataFrame, share: float = 0.3) -> DataFrame:
    """Signals per series: years of zeros only; share of zeros above ``share``; zeros between two neighbours of at least the territory's median. Rows: cell, value."""
    known = rows.filter("value is not null")
    zero = F.when(F.col("value") == 0, 1)
    by_year = known.groupBy("series_key", "year").agg(F.count(zero).alias("z"), F.count(F.lit(1)).alias("n")).filter("z = n and n > 1").groupBy("series_key").agg(F.count(F.lit(1)).alias("count")).select("series_key", F.lit("year of zeros").alias("signal"), "count")
    many = known.groupBy("series_key").agg(F.count(zero).alias("count"), F.count(F.lit(1)).alias("n")).filter(F.col("count") > share * F.col("n")).select("series_key", F.lit("many zeros").alias("signal"), "count")
    order = Window.partitionBy("series_key", "territory_code").orderBy("year")
    middle = known.groupBy("series_key", "territory_code").agg(F.median("value").alias("middle"))
    near = known.withColumn("before", F.lag("value").over(order)).withColumn("after", F.lead("value").over(order)).join(middle, ["series_key", "territory_code"])
    lone = near.filter("value = 0 and before >= middle and after >= middle and middle > 0").groupBy("series_key").agg(F.count(F.lit(1)).alias("count")).select("series_key", F.lit("zero between values").alias("signal"), "count")
    return by_year.unionByName(many).unionByName(lone)


def country_sums(regions: DataFrame, country: DataFrame, universe: int, tolerance: float = 0.01) -> DataFrame:
    """Years of full composition whose regions' sum is off the country's value by more than ``tolerance``; averages (the country lies among its regions) and ratios of a thousand or a million do not count."""
    total = regions.filter("value is not null").groupBy("series_key", "year").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).filter(F.col("n") == universe)
    both = total.join(country.filter("value > 0").select("series_key", "year", F.col("value").alias("country")), ["series_key", "year"]).withColumn("ratio", F.col("total") / F.col("country"))
    scaled = F.lit(False)
    for k in (1e3, 1e6, 1e-3, 1e-6):
        scaled |= F.abs(F.col("ratio") / k - 1) <= 0.05
    return both.filter((F.abs(F.col("ratio") - 1) > tolerance) & ~F.col("country").between(F.col("low"), F.col("high")) & ~scaled).select("series_key", "year", F.round("ratio", 6).alias("ratio"))


def glance_at_country(regions: DataFrame, country: DataFrame, universe: int, tolerance: float = 0.01) -> DataFrame:
    """What the country's value is beside its regions: sum, coarser unit (a thousand or a million times, of 20 regions or more, none negative), average, or contradiction; and the factor."""
    g = regions.filter("value is not null").groupBy("series_key", "year").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    both = g.join(country.filter("value is not null").select("series_key", "year", F.col("value").alias("country")), ["series_key", "year"]).filter(F.col("n") == universe)
    fits = lambda k: (F.col("n") >= 20) & (F.col("low") >= 0) & (F.abs(F.try_divide("total", F.col("country") * k) - 1) <= tolerance)
    factor = F.when(fits(1e3), 1e3).when(fits(1e6), 1e6)
    kind = F.when(F.abs(F.try_divide("total", "country") - 1) <= tolerance, "sum").when(factor.isNotNull(), "coarser unit").when(F.col("country").between(F.col("low"), F.col("high")), "average").otherwise("contradiction")
    return both.select("series_key", "year", kind.alias("kind"), F.when(kind == "coarser unit", factor).alias("factor"))


def composition_changes(rows: DataFrame) -> DataFrame:
    """Territories that have a value in one year and none in the year before that the series has. Rows: cell, value; gives series_key, year, came, left."""
    years = rows.filter("value is not null").select("series_key", "year").distinct()
    order = Window.partitionBy("series_key").orderBy("year")
    steps = years.withColumn("before", F.lag("year").over(order)).filter("before is not null")
    sets = rows.filter("value is not null").groupBy("series_key", "year").agg(F.collect_set("territory_code").alias("codes"))
    pairs = steps.join(sets, ["series_key", "year"]).join(sets.select("series_key", F.col("year").alias("before"), F.col("codes").alias("had")), ["series_key", "before"])
    joined = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return pairs.select("series_key", "year", joined("codes", "had").alias("came"), joined("had", "codes").alias("went")).filter("came <> '' or went <> ''")


def year_copies(vintage: DataFrame, least: int = 10, share: float = 0.9, gap: int = 5, steady: float = 0.5) -> DataFrame:
    """Pairs of years at least ``gap`` apart whose values agree in ``share`` of enough common places, unless neighbouring years agree in ``steady`` of theirs: mislabelled copies. The year that stands apart (no neighbour with values) is ``detached``.

    Values of a place are compared with each other only, by equality, so the join is on the value as well.
    """
    rows = vintage.filter("value is not null").select(*CELL, "value").distinct()
    size = rows.groupBy("series_key", "year").agg(F.collect_set("territory_code").alias("places"))
    side = lambda y: rows.select("series_key", "territory_code", "value", F.col("year").alias(y))
    equal = side("year_a").join(side("year_b"), ["series_key", "territory_code", "value"]).filter("year_b > year_a").groupBy("series_key", "year_a", "year_b").agg(F.count(F.lit(1)).alias("equal"))
    counted = equal.join(size.select("series_key", F.col("year").alias("year_a"), F.col("places").alias("pa")), ["series_key", "year_a"]).join(size.select("series_key", F.col("year").alias("year_b"), F.col("places").alias("pb")), ["series_key", "year_b"])
    counted = counted.withColumn("common", F.size(F.array_intersect("pa", "pb")).cast("long")).filter(F.col("common") >= least)
    calm = counted.filter((F.col("year_b") - F.col("year_a") == 1) & (F.col("equal") >= steady * F.col("common"))).select("series_key").distinct()
    years = size.select("series_key", "year")
    near = years.select("series_key", F.col("year").alias("near"))
    lone = years.join(near, (years["series_key"] == near["series_key"]) & (F.abs(F.col("near") - F.col("year")) == 1), "left_anti").select("series_key", F.col("year").alias("lone_year"))
    found = counted.filter((F.col("year_b") - F.col("year_a") >= gap) & (F.col("equal") >= share * F.col("common"))).join(calm, "series_key", "left_anti")
    apart = found.join(lone, (found["series_key"] == lone["series_key"]) & F.col("lone_year").isin(F.col("year_a"), F.col("year_b")), "left")
    return apart.groupBy(found["series_key"], "year_a", "year_b", "common", "equal").agg(F.min("lone_year").alias("detached"))


def without_year_copies(vintage: DataFrame, copies: DataFrame) -> DataFrame:
    """``vintage`` without the years found: the detached one of a pair, both where neither is."""
    bad = copies.select("series_key", F.explode(F.when(F.col("detached").isNotNull(), F.array("detached")).otherwise(F.array("year_a", "year_b"))).alias("year")).distinct()
    return vintage.join(bad, ["series_key", "year"], "left_anti")


def copied_years(vintage: DataFrame, regions: DataFrame, least: int = 10, share: float = 0.9, gap: int = 5) -> DataFrame:
    """series_key, year and edition (null: all of them) that are mislabelled copies of another year. ``vintage``: cell, edition, value; ``regions``: territory_code.

    Regions' values other than 0 are compared, edition with edition: two years ``gap`` or more apart whose values are equal in ``share`` of
    ``least`` or more common regions. A pair is excused if one of its years agrees so with the year before or after it (a steady series is no
    copy). If the earlier year is outside the unbroken run of years of the later one, it goes from all editions; within one run nobody knows
    which of them is right, and each goes from its own edition.
    """
    known = vintage.join(F.broadcast(regions.select("territory_code")), "territory_code").filter("value is not null and value <> 0")
    known = stored(known.select("series_key", "territory_code", "year", "edition", "value").distinct(), "known-values")
    side = lambda n: known.select("series_key", "territory_code", "value", F.col("year").alias(f"year_{n}"), F.col("edition").alias(f"edition_{n}"))
    pair = ["series_key", "year_a", "edition_a", "year_b", "edition_b"]
    equal = side("a").join(side("b"), ["series_key", "territory_code", "value"]).filter("year_b > year_a").groupBy(*pair).agg(F.count(F.lit(1)).alias("equal")).filter(F.col("equal") >= share * least)
    places = known.groupBy("series_key", "year", "edition").agg(F.collect_set("territory_code").alias("places"))
    of = lambda n: places.select("series_key", F.col("year").alias(f"year_{n}"), F.col("edition").alias(f"edition_{n}"), F.col("places").alias(f"places_{n}"))
    both = equal.join(of("a"), ["series_key", "year_a", "edition_a"]).join(of("b"), ["series_key", "year_b", "edition_b"])
    alike = both.withColumn("common", F.size(F.array_intersect("places_a", "places_b"))).filter((F.col("common") >= least) & (F.col("equal") >= share * F.col("common"))).select(*pair)
    alike = stored(alike, "years-alike")
    steady = alike.filter("year_b - year_a = 1").select("series_key", F.explode(F.array("year_a", "year_b")).alias("year")).distinct()
    found = alike.filter(F.col("year_b") - F.col("year_a") >= gap)
    for n in ("a", "b"):
        found = found.join(steady.withColumnRenamed("year", f"year_{n}"), ["series_key", f"year_{n}"], "left_anti")
    run = F.col("year") - F.row_number().over(Window.partitionBy("series_key").orderBy("year"))
    runs = known.select("series_key", "year").distinct().select("series_key", "year", run.alias("run"))
    for n in ("a", "b"):
        found = found.join(runs.withColumnsRenamed({"year": f"year_{n}", "run": f"run_{n}"}), ["series_key", f"year_{n}"])
    every = F.lit(None).cast("long")
    apart = F.array(F.struct(F.col("year_a").alias("year"), every.alias("edition")))
    inside = F.array(*[F.struct(F.col(f"year_{n}").alias("year"), F.col(f"edition_{n}").cast("long").alias("edition")) for n in ("a", "b")])
    return found.select("series_key", F.explode(F.when(F.col("run_a") != F.col("run_b"), apart).otherwise(inside)).alias("c")).select("series_key", "c.year", "c.edition").distinct()


def without_copied_years(vintage: DataFrame, copies: DataFrame) -> DataFrame:
    """``vintage`` without what ``copied_years`` has found, rows of the country and of zeros too."""
    everywhere, own = copies.filter("edition is null").select("series_key", "year"), copies.filter("edition is not null")
    return vintage.join(everywhere, ["series_key", "year"], "left_anti").join(own, ["series_key", "year", "edition"], "left_anti")


def reconcile_country_scale(facts: DataFrame, country: str, regions: Sequence[str] | DataFrame, least: int = 60, tolerance: float = 0.05, factors: Sequence[float] = (1e3, 1e6, 1e-3)) -> DataFrame:
    """``facts`` (cell, value) whose country value, where it does not fit the sum of ``least`` regions or more, is multiplied by the factor after which it does. ``regions``: frame of territory_code."""
    own = ["series_key", "year"]
    total = facts.join(F.broadcast(regions.select("territory_code")), "territory_code").filter("value is not null").groupBy(*own).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    fits = lambda k: F.abs(F.try_divide(F.col("value") * k, F.col("total")) - 1) <= tolerance
    factor = F.when(F.coalesce(fits(1.0), F.lit(False)), 1.0)
    for k in factors:
        factor = factor.when(F.coalesce(fits(k), F.lit(False)), k)
    joined = facts.filter(F.col("territory_code") == country).join(total, own, "left").select(*CELL, (F.col("value") * F.coalesce(factor, F.lit(1.0))).alias("value"), F.coalesce(factor, F.lit(1.0)).alias("factor"))
    return facts.filter(F.col("territory_code") != country).select(*CELL, "value", F.lit(1.0).alias("factor")).unionByName(joined)

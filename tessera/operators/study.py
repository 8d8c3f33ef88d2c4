"""Studies over several columns, years or exclusions: preparation, bounds, sensitivity, neighbours, questions, comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import statistics as S

def _year():
    return Window.partitionBy("year")


# Distributions


def prepare(rows: DataFrame) -> DataFrame:
    """Rows with a finite value and a weight above 0."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return rows.filter(finite("value") & finite("weight") & (F.col("weight") > 0))


def hidden_bounds(rows: DataFrame, hidden: DataFrame) -> DataFrame:
    """Per year: bounds of the coefficient of variation (population) if ``hidden`` (year, k) more values lie anywhere between the least and the most that are known.

    With the k values on the edges the spread is largest: some number j of them on the lower, the others on the
    upper edge, of which all are tried; it is smallest with all of them in one place, where the ratio's
    derivative is 0 (sum of squares over sum), or on the nearer edge.
    """
    g = rows.filter("value is not null").groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.min("value").alias("low"), F.max("value").alias("high")).join(hidden, "year").filter("low > 0")

    def cv(s: Column, q: Column) -> Column:
        n = F.col("n") + F.col("k")
        return F.sqrt(F.greatest(q / n - F.pow(s / n, 2), F.lit(0.0))) / (s / n)

    at = lambda x: cv(F.col("s") + F.col("k") * x, F.col("q") + F.col("k") * x * x)
    edges = F.transform(F.sequence(F.lit(0), F.col("k").cast("int")), lambda j: cv(F.col("s") + j * F.col("low") + (F.col("k") - j) * F.col("high"), F.col("q") + j * F.pow("low", 2) + (F.col("k") - j) * F.pow("high", 2)))
    least = at(F.least(F.greatest(F.col("q") / F.col("s"), F.col("low")), F.col("high")))
    known = F.sqrt(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))) / (F.col("s") / F.col("n"))
    return g.select("year", F.col("k").cast("long").alias("hidden"), F.round(known, 6).alias("known"), F.round(least, 6).alias("least"), F.round(F.array_max(edges), 6).alias("most"))


def bounds_of_measures(rows: DataFrame, keys: tuple[str, ...] = ("series_key", "year"), least_known: int = 5) -> DataFrame:
    """Bounds of Gini, Theil and CV (population, equal weights) for each group with hidden values, if those lie between the least and the most that are known.

    Rows: keys, value, hidden. Groups have at least ``least_known`` known values; Theil asks for positive ones, the
    others for non-negative ones with a positive sum. The measures are quasi-convex: largest with j of the hidden
    values on the lower edge and the rest on the upper, of which all j are tried, and least with all of them in one
    place x. For Theil, x is where its derivative vanishes: ln x = sum(v ln v) / sum(v). Gini is a quotient of linear
    functions of x between two known values, so that its least value is found at a known one.
    """
    k, n, s = F.col("k"), F.col("n"), F.col("s")
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r, x = F.col("r"), F.col("value")
    w = rows.withColumn("k", F.count_if("hidden").over(whole)).filter("value is not null and k > 0")
    w = w.withColumn("r", F.count(F.lit(1)).over(upto)).withColumn("p", F.sum("value").over(upto)).withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("s", F.sum("value").over(whole))
    w = w.withColumn("half", F.sum((2 * r - n - 1) * x).over(whole))
    g = w.filter(n >= least_known).groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("k", "n", "s", "half")], F.sum(x * x).alias("q"), F.sum(F.when(x > 0, x * F.ln(x))).alias("e"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.min(F.try_divide(F.col("half") + k * (x * (2 * r - n) + s - 2 * F.col("p")), (n + k) * (s + k * x))).alias("least_gini"),
    ).filter("low >= 0 and s > 0")
    q, e, half, low, high = (F.col(c) for c in ("q", "e", "half", "low", "high"))

    def corners(measure) -> Column:
        """The most of a measure over j hidden values on the lower edge."""
        return F.array_max(F.transform(F.sequence(F.lit(0).cast("long"), k), lambda j: measure(j, k - j)))

    cv = lambda s, q, n: F.sqrt(F.greatest(q / n - F.pow(s / n, 2), F.lit(0.0))) / (s / n)
    theil = lambda s, e, n: F.greatest(e / s - F.ln(s / n), F.lit(0.0))
    inside = lambda x: F.least(F.greatest(x, low), high)
    for_cv, for_theil = inside(q / s), inside(F.exp(e / s))
    found = (
        ("gini", F.lit(True), half / (n * s), F.col("least_gini"), corners(lambda j, i: (half + j * (s - n * low) + i * (n * high - s) + j * i * (high - low)) / ((n + k) * (s + j * low + i * high)))),
        ("theil", low > 0, theil(s, e, n), theil(s + k * for_theil, e + k * for_theil * F.ln(for_theil), n + k), corners(lambda j, i: theil(s + j * low + i * high, e + j * low * F.ln(low) + i * high * F.ln(high), n + k))),
        ("cv", F.lit(True), cv(s, q, n), cv(s + k * for_cv, q + k * for_cv * for_cv, n + k), corners(lambda j, i: cv(s + j * low + i * high, q + j * low * low + i * high * high, n + k))),
    )
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), fits.alias("fits"), *[F.round(c, 6).alias(a) for c, a in ((known, "known"), (least, "least"), (most, "most"))]) for name, fits, known, least, most in found]))
    return g.select(*keys, k.alias("hidden"), n.alias("observed"), each.alias("m")).filter("m.fits").select(*keys, "hidden", "observed", "m.measure", "m.known", "m.least", "m.most")


def restrict(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of the members of a constant composition."""
    return rows.join(members.select("code"), "code", "left_semi")


def without_each(rows: DataFrame, group: str = "group") -> DataFrame:
    """``rows`` once whole (``excluded`` is ``-``) and once without each group."""
    groups = rows.select(F.col(group).alias("excluded")).distinct().unionByName(rows.sparkSession.createDataFrame([("-",)], "excluded string"))
    return rows.crossJoin(F.broadcast(groups)).filter(F.col(group).isNull() | (F.col(group) != F.col("excluded")))


def sigma_robustness(rows: DataFrame, least: int = 15) -> DataFrame:
    """Trend of sigma with each group left out, and whether its sign is that of the whole. Rows: year, code, group, value."""
    s = without_each(rows.filter("value > 0")).groupBy("excluded", "year").agg(F.stddev_samp(F.ln("value")).alias("sigma"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    t = s.groupBy("excluded").agg(F.regr_slope("sigma", "year").alias("slope"), F.count(F.lit(1)).alias("years"))
    whole = t.filter("excluded = '-'").select(F.signum("slope").alias("sign"))
    return t.crossJoin(F.broadcast(whole)).select("excluded", F.round("slope", 6).alias("slope"), "years", (F.signum("slope") == F.col("sign")).alias("stable"))


def inequality_robustness(rows: DataFrame) -> DataFrame:
    """Inequality measures with each group left out. Rows: year, code, group, value, weight."""
    keyed = without_each(rows).withColumn("year", F.concat_ws("|", "excluded", "year"))
    out = S.inequality(keyed)
    part = F.split("year", r"\|")
    return out.select(part[0].alias("excluded"), part[1].cast("long").alias("year"), "n", "gini", "theil")


def period_change(rows: DataFrame, value: str = "value") -> DataFrame:
    """First and last year and the relative change between them."""
    a, b = F.min_by(value, "year"), F.max_by(value, "year")
    return rows.filter(F.col(value).isNotNull()).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.round(F.when(a != 0, (b - a) / F.abs(a)), 6).alias("change"))


def is_skewed(rows: DataFrame, ratio: float = 5.0) -> DataFrame:
    """Per year: all positive and the largest at least ``ratio`` times the upper middle value, so that a logarithmic axis helps."""
    ordered = rows.filter("value is not null").withColumn("i", F.row_number().over(_year().orderBy("value", "code"))).withColumn("n", F.count(F.lit(1)).over(_year()))
    g = ordered.groupBy("year").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max(F.when(F.col("i") == F.floor(F.col("n") / 2) + 1, F.col("value"))).alias("middle"))
    return g.select("year", ((F.col("low") > 0) & (F.col("high") >= ratio * F.col("middle"))).alias("skewed"))


def symmetric_breaks(rows: DataFrame, classes: int = 6) -> DataFrame:
    """Edges of map classes symmetric round 0, of equal width, to the largest absolute value."""
    top = rows.filter("value is not null").groupBy("year").agg(F.max(F.abs("value")).alias("top"))
    return top.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(classes)))).select("year", F.col("i").cast("long").alias("i"), F.round((F.col("i") * 2 / classes - 1) * F.col("top"), 5).alias("edge"))


# Columns against columns


def dummies(groups: DataFrame, column: str) -> DataFrame:
    """A 0/1 column for each group but the first; the groups are those of a dimension."""
    names = sorted(r[0] for r in groups.select(column).distinct().collect() if r[0] is not None)
    return groups.select("*", *[(F.col(column) == n).cast("int").alias(f"is_{n}") for n in names[1:]])


def strongest_pairs(long: DataFrame, limit: int = 10, alpha: float = 0.05) -> DataFrame:
    """Pairs with the largest absolute correlation among those significant after Benjamini and Hochberg's correction."""
    rows = S.correlations(long).filter("pearson is not null").withColumn("p", S.p_of_r(F.col("pearson"), F.col("n"))).withColumn("key", F.concat_ws("|", "a", "b"))
    return S.benjamini_hochberg(rows).filter(F.col("p_adjusted") < alpha).orderBy(F.desc(F.abs("pearson")), "a", "b").limit(limit).select("a", "b", "n", "pearson")


def scatter(x: DataFrame, y: DataFrame) -> DataFrame:
    """Complete pairs of two columns by code."""
    both = x.select("code", F.col("value").alias("x")).join(y.select("code", F.col("value").alias("y")), "code")
    return both.filter("x is not null and y is not null")


def related(long: DataFrame, column: str, least: int = 8) -> DataFrame:
    """Spearman's correlation of a column with all others, strongest first in ``place``."""
    rows = S.correlations(long, least).filter((F.col("a") == column) | (F.col("b") == column))
    out = rows.select(F.when(F.col("a") == column, F.col("b")).otherwise(F.col("a")).alias("other"), "n", "spearman")
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("spearman")), "other")).cast("long"))


def standardised(long: DataFrame, columns: int) -> DataFrame:
    """z-scores (population) of codes that have all columns; a constant column is 0."""
    full = long.filter("value is not null").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("code"))).filter(F.col("_n") == columns)
    col = Window.partitionBy("column")
    return full.select("column", "code", F.round(F.coalesce(F.try_divide(F.col("value") - F.avg("value").over(col), F.stddev_pop("value").over(col)), F.lit(0.0)), 6).alias("z"))


def sensitivity(long: DataFrame, columns: int, base: tuple[str, str] = ("minmax", "additive"), others: Sequence[tuple[str, str]] = (("zscore", "additive"), ("rank", "additive"), ("minmax", "geometric"), ("minmax", "topsis"))) -> DataFrame:
    """How places of an index of equal weights move under other normalisations and aggregations: mean and largest shift of each variant."""
    weights = long.select("column").distinct().withColumn("weight", F.lit(1.0 / columns))
    index = lambda v: S.composite(S.normalise(long, v[0]), weights, columns, v[1])
    own = index(base)
    return reduce(DataFrame.unionByName, [S.rank_shift(own, index(v)).withColumn("variant", F.lit("/".join(v))) for v in others])


# Space


def row_standardised(edges: DataFrame) -> DataFrame:
    """Weights of neighbours, 1 in all for each code. Edges: code, neighbour."""
    return edges.distinct().withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("code")))


def nearest_places(places: DataFrame, count: int = 5) -> DataFrame:
    """The ``count`` nearest places by great-circle angle. Places (code, latitude, longitude in degrees) are a dimension, compared with each other."""
    r = places.select("code", F.radians("latitude").alias("a"), F.radians("longitude").alias("o"))
    other = r.select(F.col("code").alias("neighbour"), F.col("a").alias("a2"), F.col("o").alias("o2"))
    cosine = F.sin("a") * F.sin("a2") + F.cos("a") * F.cos("a2") * F.cos(F.col("o") - F.col("o2"))
    pairs = r.join(F.broadcast(other), F.col("code") != F.col("neighbour")).withColumn("angle", F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))))
    order = Window.partitionBy("code").orderBy(F.round("angle", 9), "neighbour")
    return pairs.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= count).select("code", "neighbour", "place", F.round(F.degrees("angle"), 5).alias("degrees"))


def quadrants(local: DataFrame) -> DataFrame:
    """How many codes stand in each quadrant of a year, and who. Rows: year, code, quadrant."""
    return local.groupBy("year", "quadrant").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))


# Comparisons


def change_mode(pairs: DataFrame, points: bool) -> DataFrame:
    """How a change is told for all rows alike: in points for shares, in percent if all values before are above 0, else as a difference. Pairs: before, value."""
    return pairs.filter("before is not null and value is not null").agg(F.when(F.lit(points), "points").when(F.bool_and(F.col("before") > 0), "percent").otherwise("difference").alias("mode"), F.count(F.lit(1)).alias("n"))


def measured_change(value: Column, before: Column, kind: Column | str, tolerance: float = 0.05) -> Column:
    """Amount, unit and direction of a change: points for shares, percent of a positive value, else the difference; less than ``tolerance`` is no change."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    unit = F.when(kind == "share", "points").when(before > 0, "percent").otherwise("difference")
    amount = F.when(unit == "percent", (F.try_divide(value, before) - 1) * 100).otherwise(value - before)
    way = F.when(amount.isNull(), None).when(F.abs(amount) < tolerance, "same").when(amount > 0, "up").otherwise("down")
    return F.struct(F.round(amount, 4).alias("amount"), F.when(amount.isNotNull(), unit).alias("unit"), way.alias("direction"))


def regions_total(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """Yearly totals over the regions that have a value in every full year."""
    members = S.constant_composition(rows, share)
    counts = rows.filter("value is not null").groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    full = counts.withColumn("peak", F.max("n").over(Window.partitionBy())).filter(F.col("n") >= share * F.col("peak")).select("year")
    kept = restrict(rows.filter("value is not null"), members).join(F.broadcast(full), "year")
    return kept.groupBy("year").agg(F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("regions"))


def part_shifts(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Change of each part and its share in the change of the whole. Rows: part, year, value."""
    at = lambda y: F.sum(F.when(F.col("year") == y, F.col("value")))
    g = rows.filter(F.col("year").isin(first, last)).groupBy("part").agg(at(first).alias("a"), at(last).alias("b")).filter("a is not null and b is not null").withColumn("d", F.col("b") - F.col("a"))
    every = Window.partitionBy()
    return g.select("part", F.round("d", 4).alias("change"), F.round(F.try_divide("d", F.sum("d").over(every)) * 100, 4).alias("share_of_change"), F.round((F.col("b") / F.sum("b").over(every) - F.col("a") / F.sum("a").over(every)) * 100, 4).alias("share_shift"))


def group_against_rest(rows: DataFrame, members: Sequence[str]) -> DataFrame:
    """Sum, mean and number of a group's regions and of all others, per year."""
    side = F.when(F.col("code").isin(*members), "group").otherwise("rest")
    g = rows.filter("value is not null").groupBy("year", side.alias("side")).agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("total") / F.sum("total").over(_year()) * 100, 4))


def small_multiples(rows: DataFrame) -> DataFrame:
    """A line for each code: its years and values, own range and the range that all share."""
    known = rows.filter("value is not null")
    lines = known.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("year", F.round("value", 2).alias("value")))).alias("l"), F.min("value").alias("low"), F.max("value").alias("high"))
    text = F.array_join(F.transform("l", lambda p: F.concat_ws(":", p["year"], p["value"].cast("decimal(38,2)"))), ",")
    every = Window.partitionBy()
    return lines.select("code", text.alias("line"), F.col("low"), F.col("high"), F.min("low").over(every).alias("common_low"), F.max("high").over(every).alias("common_high"))


def comparable_from(breaks: DataFrame, years: DataFrame, least: int = 2) -> DataFrame:
    """First year after the last break of each series that leaves ``least`` years. Breaks: series_key, break_year; years: series_key, year."""
    last = years.groupBy("series_key").agg(F.max("year").alias("last_year"), F.min("year").alias("first_year"))
    fit = breaks.join(last, "series_key").filter(F.col("last_year") - F.col("break_year") + 1 >= least).groupBy("series_key").agg(F.max("break_year").alias("b"))
    return last.join(fit, "series_key", "left").select("series_key", F.coalesce("b", "first_year").alias("comparable_from"))


def base_year(rows: DataFrame, lines: int) -> DataFrame:
    """The earliest year in which all lines have a value other than 0. Rows: series_key, year, value."""
    return rows.filter("value <> 0").groupBy("year").agg(F.count_distinct("series_key").alias("n")).filter(F.col("n") == lines).agg(F.min("year").alias("base_year"))


def places_by_year(ranks: DataFrame, years: Sequence[int]) -> DataFrame:
    """Each region's places over some years as one text, and how far it moved (up is positive)."""
    rows = ranks.filter(F.col("year").isin(*years)).groupBy("territory_code").agg(F.array_sort(F.collect_list(F.struct("year", "rank_desc"))).alias("l"))
    text = F.array_join(F.transform("l", lambda p: F.concat_ws(":", p["year"], p["rank_desc"])), ",")
    return rows.select("territory_code", text.alias("places"), (F.element_at("l", 1)["rank_desc"] - F.element_at("l", -1)["rank_desc"]).alias("movement"))


def timeline_finding(rows: DataFrame) -> DataFrame:
    """Change of each line over the years that all lines have, and who grew most. Rows: code, year, value."""
    known = rows.filter("value is not null")
    lines = known.agg(F.count_distinct("code").alias("lines"))
    common = known.groupBy("year").agg(F.count_distinct("code").alias("n")).crossJoin(F.broadcast(lines)).filter("n = lines").select("year")
    kept = known.join(F.broadcast(common), "year").groupBy("code").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("value", "year").alias("a"), F.max_by("value", "year").alias("b"))
    growth = F.round(F.when(F.col("a") > 0, (F.col("b") / F.col("a") - 1) * 100), 4)
    return kept.select("code", "first_year", "last_year", growth.alias("growth"), F.rank().over(Window.orderBy(growth.desc_nulls_last())).cast("long").alias("place"))


def passport(observation: DataFrame, ranks: DataFrame, coverage: DataFrame, territory_code: str) -> DataFrame:
    """A territory's profile: of each ready series its last value, change to the year before, place, and ratio to the country."""
    own = observation.filter((F.col("territory_code") == territory_code) & F.col("value").isNotNull()).join(coverage.filter("is_ready").select("series_key"), "series_key")
    order = Window.partitionBy("series_key").orderBy("year")
    last = own.withColumn("before", F.lag("value").over(order)).withColumn("_i", F.row_number().over(Window.partitionBy("series_key").orderBy(F.desc("year")))).filter("_i = 1")
    placed = ranks.filter(F.col("territory_code") == territory_code).select("series_key", "year", "rank_desc", "ratio_to_country")
    kind = F.when(F.split("series_key", ":")[0] == "avg_price", "average").otherwise("total")
    out = last.withColumn("c", measured_change(F.col("value"), F.col("before"), kind)).join(placed, ["series_key", "year"], "left")
    return out.select("series_key", "year", "value", F.col("c.amount").alias("change"), F.col("c.direction").alias("direction"), "rank_desc", "ratio_to_country")


# Questions


def confident(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Hits whose row holds every content word of its question. Hits: question, key, words; questions: question, content (arrays)."""
    return hits.join(questions, "question").filter(F.size(F.array_except("content", "words")) == 0).select("question", "key")


def feasible(kind: Column, places: Column, series: Column) -> Column:
    """Whether a plan has what it needs: two places to compare, two series to relate, one series otherwise."""
    return F.when(kind == "compare", (places >= 2) & (series >= 1)).when(kind == "relation", series >= 2).when(kind == "define", series >= 1).otherwise(series >= 1)


def special_kind(text: Column) -> Column:
    """why, composite, method, define or relation, or null for plain questions."""
    low, out = F.lower(text), F.lit(None).cast("string")
    for kind, pattern in reversed((("why", r"^why\b"), ("composite", r"\b(index|composite) of\b"), ("method", r"how (is|are) .* (measured|calculated|computed)"), ("define", r"what (is|does) .* mean|definition of"), ("relation", r"\b(depend|relat|correlat)"))):
        out = F.when(F.rlike(low, F.lit(pattern)), kind).otherwise(out)
    return out


def plain_kind(text: Column, places: Column) -> Column:
    """compare, trend, value, rank or region, as a question falls through."""
    low = F.lower(text)
    return (
        F.when((places >= 2) | F.rlike(low, F.lit(r"\b(compare|versus|vs)\b")), "compare").when(F.rlike(low, F.lit(r"\b(change|grow|grew|since|trend)")), "trend").when(F.rlike(low, F.lit(r"\b(highest|lowest|top|best|worst|most|least)\b")), "rank").when(places == 1, "value").otherwise("region")
    )


def answer_value(observation: DataFrame, ranks: DataFrame, questions: DataFrame) -> DataFrame:
    """The last known value of the series and place asked, its rank, and the country's value. Questions: question, series_key, territory_code."""
    own = observation.filter("value is not null").join(F.broadcast(questions), ["series_key", "territory_code"])
    last = own.withColumn("_i", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("year")))).filter("_i = 1").select("question", "series_key", "territory_code", "year", "value")
    country = observation.filter("territory_level = 'country'").select("series_key", "year", F.col("value").alias("country_value"))
    return last.join(ranks.select("series_key", "year", "territory_code", "rank_desc"), ["series_key", "year", "territory_code"], "left").join(country, ["series_key", "year"], "left")


def answer_compare(observation: DataFrame, series_key: str, one: str, two: str) -> DataFrame:
    """Two places side by side, by year, and their ratio."""
    at = lambda t: F.max(F.when(F.col("territory_code") == t, F.col("value")))
    g = observation.filter((F.col("series_key") == series_key) & F.col("territory_code").isin(one, two)).groupBy("year").agg(at(one).alias("first"), at(two).alias("second")).filter("first is not null and second is not null")
    return g.withColumn("ratio", F.round(F.try_divide("first", "second"), 6))

"""Calculations over several series as columns of one dense grid, and the catalogue of operations made of them.

The grid holds every territory in every consecutive year between the first and the last known value, so a lag by
rows is a lag by years. A missing value stays missing; a division by zero, a logarithm of a non-positive number
and a root of a negative one give no value. Windows are kept as columns of the grid, so that one may be taken
over another.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.try_divide(a, b))


def power(a: Column, b: Column | float) -> Column:
    out = F.pow(a, b if isinstance(b, Column) else F.lit(b))
    return F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out)


def ln(a: Column) -> Column:
    return F.when(a > 0, F.ln(a))


def log10(a: Column) -> Column:
    return F.when(a > 0, F.log10(a))


def sqrt(a: Column) -> Column:
    return F.when(a >= 0, F.sqrt(a))


def least(*columns: Column) -> Column:
    """The least of values that are all known."""
    return F.when(_known(*columns), F.least(*columns))


def greatest(*columns: Column) -> Column:
    return F.when(_known(*columns), F.greatest(*columns))


def choose(condition: Column, yes: Column, no: Column) -> Column:
    """``yes`` or ``no``; nothing if the condition is unknown."""
    return F.when(condition.isNull(), None).when(condition, yes).otherwise(no)


def _known(*columns: Column) -> Column:
    out = columns[0].isNotNull()
    for c in columns[1:]:
        out = out & c.isNotNull()
    return out


class Grid:
    """Series of ``observation`` by short names, on all territories and years; methods give columns over years and places."""

    def __init__(self, observation: DataFrame, territory: DataFrame, series: Mapping[str, str]):
        rows = observation.filter(F.col("series_key").isin(*series.values()))
        span = rows.filter("value is not null").agg(F.min("year").alias("a"), F.max("year").alias("b")).filter("a is not null")
        years = span.select(F.explode(F.sequence("a", "b")).alias("year"))
        places = territory.select("territory_code", "district_code", ((F.col("level") == "region") & ~F.col("is_aggregate")).alias("is_region"))
        wide = rows.groupBy("territory_code", "year").agg(*[F.max(F.when(F.col("series_key") == key, F.col("value"))).alias(f"_x{name}") for name, key in series.items()])
        self.rows = places.crossJoin(F.broadcast(years)).join(wide, ["territory_code", "year"], "left")
        self.windows = 0

    def __getitem__(self, name: str) -> Column:
        return F.col(f"_x{name}")

    def _keep(self, *columns: Column) -> list[Column]:
        names = [f"_s{self.windows + i}" for i in range(len(columns))]
        self.windows += len(columns)
        self.rows = self.rows.withColumns(dict(zip(names, columns, strict=True)))
        return [F.col(n) for n in names]

    def _over(self, a: Column, make: Callable[[Column], Column]) -> Column:
        """``make`` of a column that is kept first, as windows cannot stand inside windows."""
        (own,) = self._keep(a)
        (out,) = self._keep(make(own))
        return out

    def ago(self, a: Column, years: int) -> Column:
        return self._over(a, lambda x: F.lag(x, years).over(_place()))

    def at(self, a: Column, year: int) -> Column:
        """The same territory's value in one year."""
        return self._over(a, lambda x: F.max(F.when(F.col("year") == year, x)).over(Window.partitionBy("territory_code")))

    def in_year(self, a: Column, year: int) -> Column:
        """The value in that year only."""
        return F.when(F.col("year") == year, a)

    def country(self, a: Column) -> Column:
        return self._over(a, lambda x: F.max(F.when(F.col("territory_code") == "W", x)).over(Window.partitionBy("year")))

    def total(self, a: Column) -> Column:
        return self._over(a, lambda x: F.sum(F.when(F.col("is_region"), x)).over(Window.partitionBy("year")))

    def mean(self, a: Column) -> Column:
        return self._over(a, lambda x: F.avg(F.when(F.col("is_region"), x)).over(Window.partitionBy("year")))

    def deviation(self, a: Column) -> Column:
        """Standard deviation of the regions (sample)."""
        return self._over(a, lambda x: F.stddev_samp(F.when(F.col("is_region"), x)).over(Window.partitionBy("year")))

    def district(self, a: Column) -> Column:
        """Mean of the district's regions."""
        return self._over(a, lambda x: F.avg(F.when(F.col("is_region"), x)).over(Window.partitionBy("year", "district_code")))

    def weighted_district(self, a: Column, weight: Column) -> Column:
        """Mean of the district's regions that have both value and weight, by weight."""
        x, w = self._keep(a, weight)
        both, area = F.col("is_region") & x.isNotNull() & w.isNotNull(), Window.partitionBy("year", "district_code")
        (out,) = self._keep(divide(F.sum(F.when(both, x * w)).over(area), F.sum(F.when(both, w)).over(area)))
        return out

    def moving(self, a: Column, years: int) -> Column:
        """Mean of the last ``years`` values, all of them known."""
        span = lambda: _place().rowsBetween(-(years - 1), 0)
        return self._over(a, lambda x: F.when(F.count(x).over(span()) == years, F.avg(x).over(span())))

    def running(self, a: Column) -> Column:
        """Sum from the territory's first known year to the first gap."""
        upto = _place().rowsBetween(Window.unboundedPreceding, 0)
        (x,) = self._keep(a)
        (first,) = self._keep(F.min(F.when(x.isNotNull(), F.col("year"))).over(Window.partitionBy("territory_code")))
        (out,) = self._keep(F.when(x.isNotNull() & (F.count(x).over(upto) == F.col("year") - first + 1), F.sum(x).over(upto)))
        return out

    def place(self, a: Column) -> Column:
        """Competition rank among the regions, largest first."""

        def rank(x: Column) -> Column:
            ranked = F.col("is_region") & x.isNotNull()
            return F.when(ranked, F.rank().over(Window.partitionBy("year", ranked).orderBy(F.desc(x))).cast("double"))

        return self._over(a, rank)

    def result(self, value: Column) -> DataFrame:
        """territory_code, year and value; rows without a finite value are left out."""
        out = self.rows.select("territory_code", "year", value.cast("double").alias("value"))
        return out.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))).withColumn("value", F.round("value", 6))

    def undefined(self, above: Column, below: Column) -> DataFrame:
        """Per year: cells whose division has no value because its lower part is 0."""
        return self.rows.filter(above.isNotNull() & (below == 0)).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def _place():
    return Window.partitionBy("territory_code").orderBy("year")


def _shares_moved(g: Grid) -> Column:
    a, b, c = g["a"], g["b"], g["c"]
    moved = lambda x: divide(x, c) - divide(g.ago(x, 1), g.ago(c, 1))
    return sqrt((power(moved(a), 2) + power(moved(b), 2)) / 2) * 100


def _country_growth(g: Grid, name: str) -> Column:
    now = g.country(g[name])
    return divide(now, g.ago(now, 1))


#: Operations by name: a column of the grid from its series ``a``, ``b``, ``c``, and years ``first`` and ``last``.
OPERATIONS: dict[str, Callable[..., Column]] = {
    "per_group": lambda g: divide(g["a"], g["b"]) * 1000,
    "price_level": lambda g: divide(g["a"], divide(g["b"], g.country(g["b"]))),
    "in_minima": lambda g: divide(g["a"], g["b"]),
    "structure": lambda g: divide(g["a"], g["b"]) * 100,
    "concentration": lambda g: (power(divide(g["a"], g["c"]), 2) + power(divide(g["b"], g["c"]), 2)) * 10000,
    "base_year": lambda g, first: divide(g["a"], g.at(g["a"], first)) * 100,
    "change_between": lambda g, first, last: g.at(g["a"], last) - g.at(g["a"], first),
    "percent_between": lambda g, first, last: (divide(g.at(g["a"], last), g.at(g["a"], first)) - 1) * 100,
    "annual_rate": lambda g, first, last: (power(divide(g.at(g["a"], last), g.at(g["a"], first)), 1 / (last - first)) - 1) * 100,
    "sum": lambda g: g["a"] + g["b"],
    "difference": lambda g: g["a"] - g["b"],
    "growth": lambda g: (divide(g["a"], g.ago(g["a"], 1)) - 1) * 100,
    "moving_average": lambda g: g.moving(g["a"], 3),
    "running_total": lambda g: g.running(g["a"]),
    "share_of_regions": lambda g: divide(g["a"], g.total(g["a"])) * 100,
    "place": lambda g: g.place(g["a"]),
    "standard_score": lambda g: divide(g["a"] - g.mean(g["a"]), g.deviation(g["a"])),
    "country_deviation": lambda g: g["a"] - g.country(g["a"]),
    "district_deviation": lambda g: g["a"] - g.district(g["a"]),
    "weighted_district_deviation": lambda g: g["a"] - g.weighted_district(g["a"], g["b"]),
    "location_quotient": lambda g: divide(divide(g["a"], g["b"]), divide(g.country(g["a"]), g.country(g["b"]))),
    "structural_shift": _shares_moved,
    "shift_share_national": lambda g: g.ago(g["a"], 1) * (_country_growth(g, "b") - 1),
    "shift_share_mix": lambda g: g.ago(g["a"], 1) * (_country_growth(g, "a") - _country_growth(g, "b")),
    "shift_share_regional": lambda g: g.ago(g["a"], 1) * (divide(g["a"], g.ago(g["a"], 1)) - _country_growth(g, "a")),
}


def operation(name: str, series: Mapping[str, str], observation: DataFrame, territory: DataFrame, **years: int) -> DataFrame:
    grid = Grid(observation, territory, series)
    value = OPERATIONS[name](grid, **years)
    return grid.result(value)


#: Operations that add or share out their series, and those that divide two of them.
ADDING, DIVIDING = ("sum", "structure", "concentration", "share_of_regions", "running_total"), ("per_group", "price_level", "in_minima", "structure", "location_quotient")


def warnings(uses: DataFrame) -> DataFrame:
    """What is doubtful in uses (operation, kind_a, kind_b, last_a, last_b): averages or shares added, and series divided that end in different years."""
    adds = F.col("operation").isin(*ADDING) & F.col("kind_a").isin("average", "share")
    apart = F.col("operation").isin(*DIVIDING) & (F.col("last_a") != F.col("last_b"))
    found = F.array_compact(F.array(F.when(adds, "adds what is no total"), F.when(apart, "divides series of different years")))
    return uses.withColumn("warning", F.explode(found))

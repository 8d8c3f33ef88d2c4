"""The cube of the driver's tables: territories, vintages, observations, months, populations.

A measure is summed once, from order lines joined with orders and customers, to nation x year x line number x
slice; everything after is small. Sums are kept as whole numbers (money in ten-thousandths), so that they do
not depend on the order of rows. Line number k is edition k: it publishes the total of the lines up to k.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OBSERVED, NO_DATA, HIDDEN = 0, 1, 2
#: Cells of fewer orders are hidden.
DISCLOSURE = 3
MEASURES = ("revenue", "quantity", "orders", "avg_price")
#: Partitions of the kept frames of cubes and marts. Their rows are bounded by nations, years, months, slices and editions, not by orders, so a count that follows the shuffles' only makes tasks.
KEPT_PARTITIONS = 8


@dataclass(frozen=True)
class Cube:
    """Frames of one snapshot; ``version`` names it."""

    territory: DataFrame
    vintage: DataFrame
    observation: DataFrame
    month: DataFrame
    population: DataFrame
    version: str

    @property
    def regions(self) -> DataFrame:
        """Observations of the region universe: regions that are no aggregates."""
        return self.observation.filter((F.col("territory_level") == "region") & ~F.col("is_aggregate"))


_CUBES: dict[tuple[str, str], Cube] = {}


def load_cube(spark: SparkSession, sf_dir: str) -> Cube:
    """The cube of a folder, built once for each application and kept while it runs."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CUBES:
        _CUBES[key] = build_cube(spark, sf_dir)
    return _CUBES[key]


def forget_cubes() -> None:
    """Release all cubes; the next call builds from the files as they are then."""
    for cube in _CUBES.values():
        for frame in (cube.territory, cube.vintage, cube.observation, cube.month, cube.population):
            frame.unpersist()
    _CUBES.clear()


def territories(nation: DataFrame, region: DataFrame) -> DataFrame:
    """Country W, districts R<key>, regions N<key>, and the aggregate A0 of the first two nations."""
    spark = nation.sparkSession
    regions = nation.select(F.concat(F.lit("N"), "n_nationkey").alias("territory_code"), F.col("n_name").alias("name"), F.lit("region").alias("level"), F.concat(F.lit("R"), "n_regionkey").alias("district_code"), F.lit(False).alias("is_aggregate"), (F.col("n_nationkey") + 10).cast("long").alias("display_order"))
    districts = region.select(F.concat(F.lit("R"), "r_regionkey").alias("territory_code"), F.col("r_name").alias("name"), F.lit("federal_district").alias("level"), F.concat(F.lit("R"), "r_regionkey").alias("district_code"), F.lit(False).alias("is_aggregate"), (F.col("r_regionkey") + 1).cast("long").alias("display_order"))
    fixed = spark.createDataFrame([("W", "WORLD", "country", None, False, 0), ("A0", "NATIONS 0 AND 1", "region", None, True, 100)], "territory_code string, name string, level string, district_code string, is_aggregate boolean, display_order long")
    return fixed.unionByName(districts).unionByName(regions)


def membership(nation: DataFrame) -> DataFrame:
    """(nationkey, territory_code): which territories a nation counts in."""
    own = nation.select("n_nationkey", F.concat(F.lit("N"), "n_nationkey").alias("territory_code"))
    district = nation.select("n_nationkey", F.concat(F.lit("R"), "n_regionkey").alias("territory_code"))
    country = nation.select("n_nationkey", F.lit("W").alias("territory_code"))
    both = nation.filter("n_nationkey < 2").select("n_nationkey", F.lit("A0").alias("territory_code"))
    return reduce(DataFrame.unionByName, (own, district, country, both))


def _money(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def build_cube(spark: SparkSession, sf_dir: str) -> Cube:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nation, region = read("nation"), read("region")
    territory = territories(nation, region).persist()
    orders = (
        read("orders")
        .join(read("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"), "c_mktsegment"), "o_custkey")
        .select("o_orderkey", "nation", F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month"), "o_orderpriority", "c_mktsegment")
    )
    lines = read("lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("edition"), (_money("l_extendedprice") * (100 - _money("l_discount"))).alias("money"), _money("l_extendedprice").alias("gross"), F.round("l_quantity").cast("long").alias("pieces")
    )
    slices = ("nation", "year", "o_orderpriority", "c_mktsegment")
    by_line = lines.join(orders, "o_orderkey").groupBy(*slices, "month", "edition").agg(F.sum("money").alias("money"), F.sum("gross").alias("gross"), F.sum("pieces").alias("pieces"))
    by_order = orders.groupBy(*slices, "month").agg(F.count(F.lit(1)).alias("n_orders"))
    by_line, by_order = small(by_line), small(by_order)

    member = F.broadcast(membership(nation))  # at most four rows a nation
    sliced = lambda df, *more: _slices(df.join(member, df["nation"] == F.col("n_nationkey")), *more)
    sums = [F.sum(c).alias(c) for c in ("money", "gross", "pieces")]
    cells = small(sliced(by_line, "edition").agg(*sums))
    counts = small(sliced(by_order).agg(F.sum("n_orders").alias("n_orders")))

    grid = counts.select("slice").distinct().crossJoin(F.broadcast(territory.select("territory_code"))).crossJoin(F.broadcast(counts.select("year").distinct()))
    editions = F.broadcast(by_line.select("edition").distinct())  # as many as an order has lines
    upto = Window.partitionBy("slice", "territory_code", "year").orderBy("edition").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = (
        cells.select("slice", "territory_code", "year").distinct().crossJoin(editions).join(cells, ["slice", "territory_code", "year", "edition"], "left").select("slice", "territory_code", "year", "edition", *[F.sum(c).over(upto).alias(c) for c in ("money", "gross", "pieces")])
    )
    hidden = F.coalesce(F.col("n_orders"), F.lit(0)) < DISCLOSURE
    values = running.join(counts, ["slice", "territory_code", "year"], "left").filter("money is not null")
    published = values.select(
        "slice", "territory_code", "year", "edition", hidden.alias("hidden"),
        F.explode(F.create_map(F.lit("revenue"), F.col("money") / 10000.0, F.lit("quantity"), F.col("pieces").cast("double"), F.lit("avg_price"), F.expr("(gross * 200 + pieces) div (2 * pieces)") / 10000.0)).alias("measure", "value"),
    )
    ordered = counts.select("slice", "territory_code", "year", F.lit(1).cast("long").alias("edition"), hidden.alias("hidden"), F.lit("orders").alias("measure"), F.col("n_orders").cast("double").alias("value"))
    seen = published.unionByName(ordered)
    absent = grid.crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in MEASURES], "measure string"))).join(seen.select("slice", "territory_code", "year", "measure").distinct(), ["slice", "territory_code", "year", "measure"], "left_anti")
    vintage = (
        seen.select(_series(), "territory_code", "year", "edition", F.when(~F.col("hidden"), F.col("value")).alias("value"), F.when(F.col("hidden"), HIDDEN).otherwise(OBSERVED).cast("long").alias("quality"))
        .unionByName(absent.select(_series(), "territory_code", "year", F.lit(1).cast("long").alias("edition"), F.lit(None).cast("double").alias("value"), F.lit(NO_DATA).cast("long").alias("quality")))
        .transform(small)
    )
    monthly_money = _group(by_line.join(member, by_line["nation"] == F.col("n_nationkey")), "month").agg(F.sum("money").alias("money"))
    monthly_orders = _group(by_order.join(member, by_order["nation"] == F.col("n_nationkey")), "month").agg(F.sum("n_orders").alias("n_orders"))
    month = months(monthly_money.select(F.lit("revenue").alias("measure"), "territory_code", "year", "month", (F.col("money") / 10000.0).alias("value")).unionByName(monthly_orders.select(F.lit("orders").alias("measure"), "territory_code", "year", "month", F.col("n_orders").cast("double").alias("value"))))
    people = read("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    population = people.join(member, "n_nationkey").groupBy("territory_code").agg(F.sum("n").cast("double").alias("population"))
    return Cube(territory, vintage, small(observations(vintage, territory)), small(month), population.persist(), sf_dir)


def small(frame: DataFrame) -> DataFrame:
    """A frame whose rows the dimensions bound, kept in few partitions."""
    return frame.repartition(KEPT_PARTITIONS).persist()


def _slices(df: DataFrame, *more: str):
    """Groups of all orders, of each priority, and of each priority and segment; the slice's name is ``00`` or its parts."""
    name = F.when(F.col("depth") == 0, F.lit("00")).when(F.col("depth") == 1, F.col("o_orderpriority")).otherwise(F.concat_ws("/", "o_orderpriority", "c_mktsegment"))
    return df.withColumn("depth", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("slice", name).groupBy("slice", "territory_code", "year", *more)


def _group(df: DataFrame, *more: str):
    return df.groupBy("territory_code", "year", *more)


def _series() -> Column:
    return F.concat_ws(":", "measure", "slice").alias("series_key")


def observations(vintage: DataFrame, territory: DataFrame) -> DataFrame:
    """The winner of each cell's vintages: a value before a gap, then the latest edition; with the number of revisions."""
    cell = ["series_key", "territory_code", "year"]
    best = vintage.groupBy(*cell).agg(
        F.max(F.struct(F.col("value").isNotNull().alias("known"), "edition", "value", "quality")).alias("best"), F.greatest(F.count_distinct("value") - 1, F.lit(0)).alias("revision_count")
    )
    where = territory.select("territory_code", F.col("level").alias("territory_level"), "district_code", "is_aggregate")
    return best.select(*cell, "best.value", "best.quality", "best.edition", "revision_count").join(F.broadcast(where), "territory_code")


def months(levels: DataFrame) -> DataFrame:
    """Monthly kinds: level, ytd (broken by the first gap of the year), yoy (percent of the same month a year ago)."""
    upto = Window.partitionBy("measure", "territory_code", "year").orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ytd = levels.withColumn("seen", F.count("value").over(upto)).withColumn("total", F.sum("value").over(upto)).filter("seen = month").select("measure", "territory_code", "year", "month", F.lit("ytd").alias("kind"), F.round("total", 4).alias("value"))
    before = levels.select("measure", "territory_code", (F.col("year") + 1).alias("year"), "month", F.col("value").alias("before"))
    yoy = levels.join(before, ["measure", "territory_code", "year", "month"]).filter("before > 0").select("measure", "territory_code", "year", "month", F.lit("yoy").alias("kind"), F.round(F.col("value") / F.col("before") * 100, 4).alias("value"))
    level = levels.select("measure", "territory_code", "year", "month", F.lit("level").alias("kind"), "value")
    return level.unionByName(ytd).unionByName(yoy).select(F.concat(F.col("measure"), F.lit(":00")).alias("series_key"), "territory_code", "year", "month", "kind", "value")

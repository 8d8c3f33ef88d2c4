"""What a table of text cells is: style of numbers, roles of columns, repeated rows, columns of territories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Shares of cells that make a column one of periods or of numbers; distinct values that a slice has at most.
PERIODS, NUMBERS, SLICES = 0.9, 0.8, 300


def numeric_share(cells: Column) -> Column:
    """Share of numbers among filled cells, as an aggregate."""
    kind = T.cell_kind(cells)
    return F.try_divide(F.count(F.when(kind == "value", 1)), F.count(F.when(kind != "empty", 1)))


def guess_style(rows: DataFrame, column: str) -> DataFrame:
    """Decimal mark by vote, modal number of decimals (the smaller of two), and whether a code for gaps stands among the cells."""
    cell = F.trim(F.col(column))
    comma, point = F.rlike(cell, F.lit(r"\d,\d+$")), F.rlike(cell, F.lit(r"\d\.\d+$"))
    decimals = F.length(F.regexp_extract(cell, r"[.,](\d+)$", 1)).cast("long")
    votes = rows.select(comma.alias("c"), point.alias("p"), decimals.alias("d"), F.rlike(cell, F.lit(r"^-?(\d)\1{3,}$")).alias("code")).filter("c is not null")
    modal = votes.filter("c or p").groupBy("d").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("decimals"))
    return votes.agg(F.when(F.count(F.when(F.col("c"), 1)) > F.count(F.when(F.col("p"), 1)), ",").otherwise(".").alias("mark"), F.bool_or("code").alias("has_code")).crossJoin(F.broadcast(modal))


def column_roles(long: DataFrame, territories: DataFrame) -> DataFrame:
    """The role of each column of (column, cell): territory (three known names or more), period, value, slice or text.

    Cells are told apart first, so that each different text is read once, and in as many tasks as there are texts for, however few files they come from.
    """
    cells = long.groupBy("column", "cell").agg(F.count(F.lit(1)).alias("n"))
    known = cells.join(F.broadcast(territories.select(T.label(F.col("name")).alias("_name")).distinct()), T.label(F.col("cell")) == F.col("_name"), "left")
    times = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    said = known.withColumns({"kind": T.cell_kind(F.col("cell")), "dated": T.period(F.col("cell")).isNotNull()})
    filled = times(F.col("kind") != "empty")
    g = said.groupBy("column").agg(F.count_distinct("_name").alias("regions"), F.try_divide(times(F.col("dated")), filled).alias("periods"), F.try_divide(times(F.col("kind") == "value"), filled).alias("numbers"), F.count("cell").alias("distinct"))
    role = F.when(F.col("regions") >= 3, "territory").when(F.col("periods") >= PERIODS, "period").when(F.col("numbers") >= NUMBERS, "value").when(F.col("distinct") <= SLICES, "slice").otherwise("text")
    return g.select("column", "regions", F.round("numbers", 6).alias("numbers"), "distinct", role.alias("role"))


def duplicates(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys that stand in several rows, and whether their values differ."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), (F.count_distinct(value) > 1).alias("differ")).filter("n > 1")


def repeated_places(rows: DataFrame, place: str, period: str, value: str, least: int = 5, share: float = 0.5) -> DataFrame:
    """Periods in which ``least`` places or more, and ``share`` of all, stand repeatedly with different values: an unseen slice."""
    g = rows.groupBy(period, place).agg(F.count_distinct(value).alias("v")).groupBy(period).agg(F.count(F.when(F.col("v") > 1, 1)).alias("repeated"), F.count(F.lit(1)).alias("places"))
    return g.filter(F.col("repeated") >= F.greatest(F.lit(least), share * F.col("places")))


def composites(labels: DataFrame, parts: DataFrame) -> DataFrame:
    """Labels ``A and B`` that are known wholes because their parts are exactly the whole's. Labels: label; parts: whole, name."""
    named = F.array_sort(F.transform(F.split(F.lower("label"), r"\s*(?:,| and )\s*"), lambda x: F.trim(x)))
    wholes = parts.groupBy("whole").agg(F.array_sort(F.collect_set(F.lower("name"))).alias("_names"))
    return labels.join(wholes, named == F.col("_names")).select("label", "whole")

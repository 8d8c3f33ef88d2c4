"""Queries over sheets of text cells, which Spark lays out from the given tables in every form, with the SQL that knows what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import sheets
from tessera.plans.staging import stored
from tessera.registry import on_tables

_TABLES = "orders customer nation"
_BASE = """o AS (SELECT o_orderpriority AS p, 'N' || n_nationkey AS code, n_nationkey AS k, year(o_orderdate) AS year, CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS half, o_totalprice AS price
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def _halves(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """p, k, name, year, half and n: orders by priority, nation and half of the year."""
    rows = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    half = F.when(F.month("o_orderdate") <= 6, 1).otherwise(2)
    return rows.groupBy(F.col("o_orderpriority").alias("p"), F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"), F.year("o_orderdate").cast("long").alias("year"), half.cast("long").alias("half")).agg(F.count(F.lit(1)).alias("n")).transform(stored, "halves")


def _territories(nation: DataFrame) -> DataFrame:
    return nation.select(F.col("n_name").alias("name"), F.concat(F.lit("N"), "n_nationkey").alias("code"))


def _cell(rows: DataFrame, sheet: Column, row: Column | int, column: Column | int, text: Column) -> DataFrame:
    put = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    return rows.select(sheet.alias("sheet"), put(row).alias("row"), put(column).alias("column"), text.cast("string").alias("text"))


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return stored(out, "sheets")


def _number(n: Column) -> Column:
    """``1 234,5`` of 1234."""
    whole = n.cast("string")
    return F.concat(F.when(F.length(whole) > 3, F.concat(F.substr(whole, F.lit(1), F.length(whole) - 3), F.lit(" "), F.right(whole, F.lit(3)))).otherwise(whole), F.lit(",5"))


def release_sheets(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """A sheet for each priority: title, years over halves in merged cells, the world, nations (some in two rows, some with a footnote's mark), an unknown label and two footnotes."""
    halves = _halves(orders, customer, nation)
    spans = halves.groupBy("p").agg(F.min("year").alias("first"), F.max("year").alias("last"))
    sheet = F.col("p")
    years = spans.select("p", "first", "last", F.explode(F.sequence("first", "last")).alias("year"))
    at = 1 + 2 * (F.col("year") - F.col("first"))
    parts = years.select("*", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("half"))
    world = halves.groupBy("p", "year", "half").agg(F.sum("n").alias("n")).join(spans, "p")
    places = nation.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    grid = parts.crossJoin(F.broadcast(places)).join(halves.drop("name"), ["p", "k", "year", "half"], "left")
    split = F.col("k") % 7 == 0
    row = 5 + F.col("k") + F.when(split & (F.col("half") == 2), 25).otherwise(0)
    shown = F.when(F.col("n").isNull(), "–").when(F.col("n") == 1, "…").otherwise(_number(F.col("n")))
    label = F.concat(F.when(F.col("k") % 3 == 0, F.initcap("name")).otherwise(F.col("name")), F.when(F.col("k") % 5 == 0, " 2)").otherwise(""))
    labels = spans.crossJoin(F.broadcast(places))
    notes = ((58, "Elsewhere"), (60, "1) The last year is"), (61, "not complete."), (62, "2) Estimated."))
    return _union(
        _cell(spans, sheet, 0, 0, F.concat(F.lit("Orders of priority "), "p")),
        _cell(years, sheet, 2, at, F.concat("year", F.when(F.col("year") == F.col("last"), " 1)").otherwise(""))),
        _cell(parts, sheet, 3, at + F.col("half") - 1, F.concat(F.lit("H"), "half")),
        _cell(spans, sheet, 4, 0, F.lit("World")),
        _cell(world, sheet, 4, at + F.col("half") - 1, _number(F.col("n"))),
        _cell(labels, sheet, 5 + F.col("k"), 0, label),
        _cell(labels.filter(split), sheet, 30 + F.col("k"), 0, label),
        _cell(grid, sheet, row, at + F.col("half") - 1, shown),
        *[_cell(spans, sheet, r, 0, F.lit(t)) for r, t in notes],
    )


def sheets_of_all_forms(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """For each priority a sheet of each form, and one without territories."""
    halves = _halves(orders, customer, nation)
    years = halves.groupBy("p", "k", "name", "year").agg(F.sum("n").alias("n"))
    spans = halves.groupBy("p").agg(F.min("year").alias("first"), F.max("year").alias("last"))
    every = spans.select("p", "first", F.explode(F.sequence("first", "last")).alias("year"))
    n = F.col("n") * 1000 + 0.5  # no count is taken for a year
    name = lambda form: F.concat(F.lit(f"{form} "), "p")
    rank = F.row_number().over(Window.partitionBy("p").orderBy("k", "year"))
    long = years.withColumn("r", rank)
    dated = years.join(spans, "p")
    at = 1 + F.col("year") - F.col("first")
    half_at = 1 + 2 * (F.col("year") - F.col("first"))
    places = years.select("p", "k", "name").distinct()
    totals = years.groupBy("p", "k", "name").agg(F.sum("n").alias("n"))
    right = F.col("k") >= 12
    below = F.when(right, F.col("k") - 12).otherwise(F.col("k"))
    width = 2 + F.col("last") - F.col("first")
    return _union(
        *[_cell(spans, name("long"), 0, i, F.lit(t)) for i, t in enumerate(("place", "year", "orders"))],
        *[_cell(long, name("long"), F.col("r"), i, t) for i, t in enumerate((F.col("name"), F.col("year"), n))],
        _cell(spans, name("years"), 0, 0, F.lit("Orders by place")),
        _cell(every, name("years"), 1, at, F.concat("year", F.lit(" year"))),
        _cell(places, name("years"), 2 + F.col("k"), 0, F.col("name")),
        _cell(dated, name("years"), 2 + F.col("k"), at, n),
        _cell(spans, name("periods"), 0, 0, F.lit("Orders by place")),
        _cell(spans, name("periods"), 1, 0, F.lit("by half of the year")),
        _cell(every, name("periods"), 3, half_at, F.col("year")),
        *[_cell(every, name("periods"), 4, half_at + h, F.lit(f"H{h + 1}")) for h in (0, 1)],
        _cell(places, name("periods"), 5 + F.col("k"), 0, F.col("name")),
        _cell(halves.join(spans, "p"), name("periods"), 5 + F.col("k"), half_at + F.col("half") - 1, n),
        *[_cell(spans, name("indicators"), 0, i, F.lit(t)) for i, t in enumerate(("place", "orders", "twice as many"))],
        *[_cell(totals, name("indicators"), 1 + F.col("k"), i, t) for i, t in enumerate((F.col("name"), n, 2 * n))],
        _cell(spans, name("transposed"), 0, 0, F.lit("year")),
        _cell(places, name("transposed"), 0, 1 + F.col("k"), F.col("name")),
        _cell(every, name("transposed"), at, 0, F.col("year")),
        _cell(dated, name("transposed"), at, 1 + F.col("k"), n),
        *[_cell(every.join(spans.select("p", "last"), "p"), name("blocks"), 0, at + b * width, F.col("year")) for b in (0, 1)],
        _cell(places.join(spans, "p"), name("blocks"), 1 + below, F.when(right, width).otherwise(0), F.col("name")),
        _cell(dated, name("blocks"), 1 + below, at + F.when(right, width).otherwise(0), n),
        _cell(every, name("unknown"), at, 0, F.concat(F.lit("line "), "year")),
    )


on_tables("src10_parse_table", lambda o, c, n: sheets.parse_tables(release_sheets(o, c, n), _territories(n), "World"), _TABLES, f"""
WITH {_BASE}, s AS (SELECT p, min(year) AS first, max(year) AS last FROM o GROUP BY p), g AS (SELECT p, last, unnest(range(first, last + 1)) AS year FROM s), h AS (SELECT *, unnest([1, 2]) AS half FROM g),
  v AS (SELECT p, code, year, half, count(*) AS n FROM o GROUP BY ALL), w AS (SELECT p, 'World' AS code, year, half, sum(n) AS n FROM v GROUP BY ALL)
SELECT p AS sheet, 'N' || n_nationkey AS code, year, 'half' AS kind, half AS number, '' AS header, CASE WHEN year = last THEN 1 END AS note, CASE WHEN n > 1 THEN n + 0.5::DOUBLE END AS value, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'hidden' ELSE 'value' END AS state, false AS differ
  FROM h CROSS JOIN nation LEFT JOIN v ON v.p = h.p AND v.code = 'N' || n_nationkey AND v.year = h.year AND v.half = h.half
UNION ALL SELECT p, code, year, 'half', half, '', CASE WHEN year = last THEN 1 END, n + 0.5::DOUBLE, 'value', false FROM w JOIN s USING (p)""".replace("SELECT p AS sheet", "SELECT h.p AS sheet").replace("code, year, 'half' AS kind, half AS number", "code, h.year, 'half' AS kind, h.half AS number").replace("CASE WHEN year = last THEN 1 END AS note", "CASE WHEN h.year = last THEN 1 END AS note"))
on_tables("src10_footnotes", lambda o, c, n: sheets.footnotes(release_sheets(o, c, n), _territories(n), "World"), _TABLES, "SELECT DISTINCT o_orderpriority AS sheet, note, text FROM orders, (VALUES (1, 'The last year is not complete.'), (2, 'Estimated.')) v(note, text)")
on_tables("src10_problems", lambda o, c, n: sheets.problems(release_sheets(o, c, n).filter("not (sheet like '1%' and text = 'World') and not (sheet like '5%' and row = 2)"), _territories(n), "World"), _TABLES, """
SELECT DISTINCT o_orderpriority AS sheet, CASE left(o_orderpriority, 1) WHEN '1' THEN 'no country' ELSE 'unknown label' END AS problem, CASE left(o_orderpriority, 1) WHEN '1' THEN '' ELSE 'Elsewhere' END AS about FROM orders
UNION ALL SELECT DISTINCT o_orderpriority, 'no year', '' FROM orders WHERE o_orderpriority LIKE '5%'""")
on_tables("txt28_recognise", lambda o, c, n: sheets.recognise(sheets_of_all_forms(o, c, n), _territories(n)), _TABLES, """
SELECT DISTINCT sheet || ' ' || o_orderpriority AS sheet, form, data_start, header_rows, blocks, title FROM orders, (VALUES ('long', 'long', 1, 1, 1, ''), ('years', 'years', 2, 1, 1, 'Orders by place'), ('periods', 'periods', 5, 2, 1, 'Orders by place by half of the year'),
  ('indicators', 'indicators', 1, 1, 1, ''), ('transposed', 'transposed', 1, 1, 0, ''), ('blocks', 'years', 1, 1, 2, ''), ('unknown', 'unknown', 0, 0, 0, '')) v(sheet, form, data_start, header_rows, blocks, title)""")
on_tables("txt28_column_roles", lambda o, c, n: sheets.column_profiles(sheets.read_cells(sheets_of_all_forms(o, c, n), _territories(n))).filter("sheet rlike '^(long|indicators|years) '").select("sheet", "column", "role", "header", "year"), _TABLES, f"""
WITH {_BASE}, s AS (SELECT p, min(year) AS first, max(year) AS last FROM o GROUP BY p)
SELECT v.sheet || ' ' || p AS sheet, "column", role, header, NULL::BIGINT AS year FROM s, (VALUES ('long', 0, 'territory', 'place'), ('long', 1, 'period', 'year'), ('long', 2, 'value', 'orders'), ('indicators', 0, 'territory', 'place'), ('indicators', 1, 'value', 'orders'), ('indicators', 2, 'value', 'twice as many'), ('years', 0, 'territory', '')) v(sheet, "column", role, header)
UNION ALL SELECT DISTINCT 'years ' || p, 1 + year - first, 'value', '', year FROM o JOIN s USING (p)""")
on_tables("txt28_values", lambda o, c, n: sheets.values_of(sheets_of_all_forms(o, c, n), _territories(n)), _TABLES, f"""
WITH {_BASE} SELECT f || ' ' || p AS sheet, code, year, 'annual' AS kind, 0 AS number, '' AS header, count(*) * 1000 + 0.5::DOUBLE AS value FROM o, (VALUES ('years'), ('blocks')) t(f) GROUP BY ALL
UNION ALL SELECT 'periods ' || p, code, year, 'half', half, '', count(*) * 1000 + 0.5::DOUBLE FROM o GROUP BY ALL""")

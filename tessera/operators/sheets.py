"""Sheets of text cells: which form a table has, and what its header block, rows and footnotes say.

A sheet is rows of (sheet, row, column, text), empty cells left out or null. Everything is windows and
aggregates over these rows, by sheet, row or column, so that any number of sheets is read in one job and the
longest sheet is no more than sorted rows. Only lists of a sheet's columns are gathered, as wide as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.staging import stored

#: A column of territories names so many of them at least; further ones have a quarter of the most.
LEAST_PLACES = 3
#: Shares of a column's filled cells that make it one of periods or of values, and of a stamped column that must be numbers.
PERIODS, NUMBERS, STAMPED = 0.9, 0.8, 0.5
#: Rows in which a transposed table's header is looked for.
HEAD_ROWS = 30
#: English months, in order.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = "|".join(MONTHS)
_YEAR = r"(?i)^\s*((?:19|20)\d\d)\s*(?:year|г(?:од|\.)?)?\s*(?:(\d{1,2})\))?\s*$"
_NOTE = r"(?s)^\W*(\d{1,2})[).]\s*(\S.*)$"


def header_year(text: Column) -> Column:
    """The year of a header cell that says nothing else but a footnote's number."""
    return F.regexp_extract(text, _YEAR, 1).try_cast("long")


def header_note(text: Column) -> Column:
    """The number of the footnote at a header's year."""
    return F.regexp_extract(text, _YEAR, 2).try_cast("long")


def part_of_year(text: Column) -> Column:
    """kind (month, quarter, half or ytd, from January on) and number of ``March``, ``Q2``, ``II quarter``, ``H1`` and ``January - June``; null for other texts."""
    low = F.lower(F.trim(F.regexp_replace(text, r"\s*\d{1,2}\)\s*$", "")))
    month = lambda pattern: F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(low, pattern, 1))
    alone, upto = month(rf"^({_MONTH})$"), month(rf"^january\s*[-–—]\s*({_MONTH})$")
    digit, roman = (F.regexp_extract(low, p, 1) for p in (r"^(?:q\s*([1-4])|([1-4]) quarter)$", r"^(i{1,3}|iv) quarter$"))
    quarter = F.when(digit != "", digit.try_cast("long")).when(roman != "", F.array_position(F.array(*map(F.lit, ("i", "ii", "iii", "iv"))), roman)).when(F.rlike(low, F.lit(r"^[1-4] quarter$")), F.left(low, F.lit(1)).try_cast("long"))
    half = F.regexp_extract(low, r"^h\s*([12])$", 1)
    said = lambda kind, number: F.struct(F.lit(kind).alias("kind"), number.cast("long").alias("number"))
    return F.when(alone > 0, said("month", alone)).when(upto > 1, said("ytd", upto)).when(quarter.isNotNull(), said("quarter", quarter)).when(half != "", said("half", half.try_cast("long")))


def read_cells(cells: DataFrame, territories: DataFrame) -> DataFrame:
    """Filled cells with the code of the territory that each names, or null; written once, as everything else reads them."""
    return stored(_named(_filled(cells), territories), "cells")


def _filled(cells: DataFrame) -> DataFrame:
    return cells.select("sheet", F.col("row").cast("long"), F.col("column").cast("long"), F.trim("text").alias("text")).filter("text <> ''")


def _named(cells: DataFrame, territories: DataFrame) -> DataFrame:
    """``cells`` with the code of the territory that a cell names, or null."""
    names = territories.select(T.label(F.col("name")).alias("_label"), F.col("code").alias("_code")).dropDuplicates(["_label"])
    return cells.withColumn("_label", T.label(F.col("text"))).join(names, "_label", "left").withColumnRenamed("_code", "code").drop("_label")


def carried(header: DataFrame, widths: DataFrame) -> DataFrame:
    """Header cells (sheet, row, column, text) with merged ones carried on.

    A merged cell holds its text in its first place only. It goes on to the right until a cell of its own row, or
    one of a row above, begins something new. ``widths``: sheet and width (the last column).
    """
    levels = header.select("sheet", "row").distinct().join(widths, "sheet")
    grid = levels.select("sheet", "row", F.explode(F.sequence(F.lit(0).cast("long"), "width")).alias("column"))
    told = grid.join(header.select("sheet", "row", "column", "text"), ["sheet", "row", "column"], "left")
    above = F.coalesce(F.max(F.col("text").isNotNull()).over(Window.partitionBy("sheet", "column").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    told = told.withColumn("begins", F.when(F.col("text").isNotNull() | above, F.struct(F.coalesce("text", F.lit("")).alias("text"))))
    along = Window.partitionBy("sheet", "row").orderBy("column").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return told.withColumn("text", F.last("begins", ignorenulls=True).over(along)["text"]).drop("begins").filter("text <> ''")


def stamped_columns(texts: DataFrame) -> DataFrame:
    """sheet, column, year, note, kind and number (annual and 0 without a part of the year) and header (what else is said, from above down) of carried header cells; year is null where no cell is one."""
    rows = F.sort_array(F.collect_list(F.struct("row", "text", header_year(F.col("text")).alias("year"), header_note(F.col("text")).alias("note"), part_of_year(F.col("text")).alias("part"))))
    g = texts.groupBy("sheet", "column").agg(rows.alias("cells"))
    first = lambda column, test: F.get(F.filter(column, test), F.lit(0))
    g = g.withColumn("stamp", first("cells", lambda c: c["year"].isNotNull()))
    g = g.withColumn("rest", F.filter("cells", lambda c: c["row"] != F.coalesce(F.col("stamp.row"), F.lit(-1))))
    g = g.withColumn("part", first("rest", lambda c: c["part"].isNotNull())["part"])
    header = F.array_join(F.transform(F.filter("rest", lambda c: c["part"].isNull()), lambda c: F.regexp_replace(c["text"], r"\s+", " ")), " | ")
    return g.select("sheet", "column", "stamp.year", "stamp.note", F.coalesce("part.kind", F.lit("annual")).alias("kind"), F.coalesce("part.number", F.lit(0)).cast("long").alias("number"), header.alias("header"))


def _starts(named: DataFrame, country: str) -> DataFrame:
    """sheet and the row of its country, where the data begin."""
    is_country = (F.col("column") == 0) & (T.label(F.col("text")) == T.label(F.lit(country)))
    return named.filter(is_country).groupBy("sheet").agg(F.min("row").alias("data_start"))


def _labels(cells: DataFrame, country: str) -> DataFrame:
    """First cells from the data's start on: sheet, row, text, code, and the footnote (number) that the row begins or goes on with."""
    named = cells.filter("column = 0").withColumn("code", F.when(T.label(F.col("text")) == T.label(F.lit(country)), F.lit(country)).otherwise(F.col("code")))
    below = named.join(_starts(cells, country), "sheet").filter("row >= data_start")
    note = F.when(F.col("code").isNull(), F.regexp_extract("text", _NOTE, 1).try_cast("long"))
    upto = Window.partitionBy("sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return below.withColumn("begins", note).withColumn("note", F.last("begins", ignorenulls=True).over(upto)).select("sheet", "row", "text", "code", "begins", "note")


def parse_tables(cells: DataFrame, territories: DataFrame, country: str) -> DataFrame:
    """sheet, code, year, kind, number, header, note, value, state and differ: the cells under a year, by territory.

    The data begin at the row of ``country`` (its code is that name); the rows above with a cell beside the
    first column are the header. Columns without a year are left out. Rows end at the first footnote. A
    territory in several rows has the first filled cell of each column; ``differ`` tells that a later one says something else.
    ``state`` is value, hidden or missing; other texts have the state text and no value.
    """
    cells = read_cells(cells, territories)
    starts = _starts(cells, country)
    head = cells.filter("column > 0").join(starts, "sheet").filter("row < data_start")
    widths = cells.groupBy("sheet").agg(F.max("column").alias("width"))
    columns = stamped_columns(carried(head, widths)).filter("year is not null and column > 0")
    places = _labels(cells, country).filter("code is not null and note is null").select("sheet", "row", "code")
    body = cells.filter("column > 0").drop("code").join(places, ["sheet", "row"]).join(columns, ["sheet", "column"])
    first = F.min_by(F.struct("text"), "row")["text"]
    merged = body.groupBy("sheet", "code", "column", "year", "kind", "number", "header", "note").agg(first.alias("text"), (F.count_distinct("text") > 1).alias("differ"))
    return merged.select("sheet", "code", "year", "kind", "number", "header", "note", T.cell_value(F.col("text")).alias("value"), T.cell_kind(F.col("text")).alias("state"), "differ")


def footnotes(cells: DataFrame, territories: DataFrame, country: str) -> DataFrame:
    """sheet, note and its text, lines that go on joined by blanks."""
    rows = _labels(read_cells(cells, territories), country).filter("note is not null")
    line = F.regexp_replace(F.when(F.col("begins").isNotNull(), F.regexp_extract("text", _NOTE, 2)).otherwise(F.col("text")), r"\s+", " ")
    lines = rows.select("sheet", "note", "row", F.trim(line).alias("line")).groupBy("sheet", "note").agg(F.sort_array(F.collect_list(F.struct("row", "line"))).alias("lines"))
    return lines.select("sheet", "note", F.array_join(F.transform("lines", lambda x: x["line"]), " ").alias("text"))


def problems(cells: DataFrame, territories: DataFrame, country: str) -> DataFrame:
    """sheet, problem and what it is about: sheets without a row of the country or without a year above it, labels that are no territory, cells that differ."""
    filled = read_cells(cells, territories)
    sheets = filled.select("sheet").distinct()
    starts = _starts(filled, country)
    head = filled.filter("column > 0").join(starts, "sheet").filter("row < data_start")
    dated = head.filter(header_year(F.col("text")).isNotNull()).select("sheet").distinct()
    no_country = sheets.join(starts, "sheet", "left_anti").select("sheet", F.lit("no country").alias("problem"), F.lit("").alias("about"))
    no_year = starts.join(dated, "sheet", "left_anti").select("sheet", F.lit("no year").alias("problem"), F.lit("").alias("about"))
    unknown = _labels(filled, country).filter("code is null and note is null").select("sheet", F.lit("unknown label").alias("problem"), F.col("text").alias("about"))
    differ = parse_tables(cells, territories, country).filter("differ").select("sheet", F.lit("values differ").alias("problem"), F.concat_ws(" ", "code", F.col("year").cast("string")).alias("about"))
    return no_country.unionByName(no_year).unionByName(unknown).unionByName(differ)


# Recognition


def territory_columns(named: DataFrame) -> DataFrame:
    """sheet, column, places (different territories named) and main (the first such column's number)."""
    g = named.filter("code is not null").groupBy("sheet", "column").agg(F.count_distinct("code").alias("places")).filter(F.col("places") >= LEAST_PLACES)
    most = F.max("places").over(Window.partitionBy("sheet"))
    kept = g.withColumn("most", most).filter(F.col("places") >= F.greatest(F.lit(LEAST_PLACES), F.floor(F.col("most") / 4)))
    return kept.withColumn("main", F.min("column").over(Window.partitionBy("sheet"))).select("sheet", "column", "places", "main")


def _data_starts(filled: DataFrame, named: DataFrame, mains: DataFrame) -> DataFrame:
    """sheet, main and data_start: the first row that names a territory in the main column, or one above it that has a label there and as many numbers, years not counted, as half of its other cells."""
    known = named.join(mains, "sheet").filter("column = main and code is not null").groupBy("sheet", "main").agg(F.min("row").alias("known"))
    number = (T.cell_kind(F.col("text")) == "value") & T.period(F.col("text")).isNull()
    rows = filled.join(known, "sheet").filter("row < known").groupBy("sheet", "row").agg(
        F.bool_or(F.col("column") == F.col("main")).alias("labelled"), F.count(F.when((F.col("column") != F.col("main")) & number, 1)).alias("numbers"), F.count(F.when(F.col("column") != F.col("main"), 1)).alias("others")
    )
    early = rows.filter((F.col("labelled")) & (F.col("numbers") >= F.greatest(F.lit(1), F.floor(F.col("others") / 2)))).groupBy("sheet").agg(F.min("row").alias("early"))
    return known.join(early, "sheet", "left").select("sheet", "main", F.coalesce("early", "known").alias("data_start"))


def _above(filled: DataFrame, starts: DataFrame) -> DataFrame:
    """Cells above the data, with ``title``: the row has one cell only and no header row stands above it."""
    rows = filled.join(starts, "sheet").filter("row < data_start")
    counted = rows.groupBy("sheet", "row").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("column") - F.col("main")).alias("right"))
    alone = (F.col("n") == 1) & (F.col("right") <= 0)
    before = Window.partitionBy("sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    marked = counted.withColumn("alone", alone).withColumn("title", alone & F.coalesce(F.min("alone").over(before), F.lit(True)))
    return rows.join(marked.select("sheet", "row", "title"), ["sheet", "row"])


def column_profiles(named: DataFrame) -> DataFrame:
    """Of ``read_cells``: sheet, main, data_start, column, role (territory, period, value, slice or text), header, year, kind, number, and the shares that the roles follow from, for every column of sheets with a territory column."""
    filled = named.drop("code")
    own = territory_columns(named)
    starts = _data_starts(filled, named, own.select("sheet", "main").distinct())
    above = _above(filled, starts).filter("not title")
    widths = filled.groupBy("sheet").agg(F.max("column").alias("width"))
    headers = stamped_columns(carried(above.select("sheet", "row", "column", "text"), widths))
    text = F.col("text")
    share = lambda test: F.count(F.when(test, 1)) / F.count(F.lit(1))
    below = filled.join(starts, "sheet").filter("row >= data_start").groupBy("sheet", "main", "data_start", "column").agg(share(T.cell_kind(text).isin("value", "missing", "hidden")).alias("numbers"), share(T.period(text).isNotNull()).alias("periods"), F.count_distinct("text").alias("distinct"))
    rows = below.join(headers, ["sheet", "column"], "left").join(own.select("sheet", "column", "places"), ["sheet", "column"], "left")
    timely = F.rlike(F.lower(F.coalesce("header", F.lit(""))), F.lit(r"\b(year|period|date|month)\b"))
    stamped = F.col("year").isNotNull() & (F.col("numbers") >= STAMPED) & F.col("places").isNull()
    dated = (F.col("periods") >= PERIODS) & F.col("places").isNull() & ((F.col("numbers") < 1) | timely)
    sheet = Window.partitionBy("sheet")
    rows = rows.withColumns({"stamped": stamped, "dated": dated}).withColumns({"n_stamped": F.count(F.when(F.col("stamped"), 1)).over(sheet), "n_dated": F.count(F.when(F.col("dated"), 1)).over(sheet)})
    rows = rows.withColumn("wide", (F.col("n_stamped") >= 2) | ((F.col("n_stamped") == 1) & (F.col("n_dated") == 0)))
    role = (
        F.when(F.col("places").isNotNull(), "territory").when(F.col("wide") & F.col("stamped"), "value").when(~F.col("wide") & F.col("dated"), "period").when((F.col("numbers") >= NUMBERS) & ~F.col("wide"), "value").when(F.col("distinct") > 1, "slice").otherwise("text")
    )
    return rows.select("sheet", "main", "data_start", "column", role.alias("role"), F.coalesce("header", F.lit("")).alias("header"), F.when(F.col("wide") & F.col("stamped"), F.col("year")).alias("year"), "kind", "number", F.round("numbers", 6).alias("numbers"), F.round("periods", 6).alias("periods"), "distinct", "wide")


def recognise(cells: DataFrame, territories: DataFrame) -> DataFrame:
    """sheet, form, data_start, header_rows, blocks and title of every sheet.

    Forms: ``years`` or ``periods`` in columns (two stamped columns of numbers, or one where no column holds periods; periods if a
    stamp names a part of the year), ``long`` (a column of periods), ``indicators`` (columns of numbers without
    a year), ``transposed`` (territories in a row, periods down the first column) and ``unknown``. ``header_rows`` counts
    rows, ``blocks`` the columns of territories that stand side by side; both are 0 where none is known.
    """
    named = read_cells(cells, territories)
    filled = named.drop("code")
    profiles = stored(column_profiles(named), "column-profiles")
    role = lambda r: F.count(F.when(F.col("role") == r, 1))
    forms = profiles.groupBy("sheet", "main", "data_start").agg(
        role("territory").alias("blocks"), F.bool_or("wide").alias("wide"), F.count(F.when(F.col("year").isNotNull() & (F.col("kind") != "annual"), 1)).alias("parts"), role("period").alias("periods"), role("value").alias("values")
    )
    form = F.when(F.col("wide"), F.when(F.col("parts") > 0, "periods").otherwise("years")).when(F.col("periods") > 0, "long").when(F.col("values") > 0, "indicators").otherwise("unknown")
    above = _above(filled, forms.select("sheet", "main", "data_start"))
    heads = above.groupBy("sheet").agg(F.count_distinct(F.when(~F.col("title"), F.col("row"))).alias("header_rows"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("title"), F.struct("row", "text")))), lambda x: x["text"]), " ").alias("title"))
    upright = forms.join(heads, "sheet", "left").select("sheet", form.alias("form"), "data_start", F.coalesce("header_rows", F.lit(0)).alias("header_rows"), "blocks", F.coalesce("title", F.lit("")).alias("title"))
    # territories in a row: the first row that names enough, with periods in the first column below it
    across = named.filter((F.col("code").isNotNull()) & (F.col("row") < HEAD_ROWS)).groupBy("sheet", "row").agg(F.count_distinct("code").alias("places")).filter(F.col("places") >= LEAST_PLACES).groupBy("sheet").agg(F.min("row").alias("head"))
    rest = across.join(upright.select("sheet"), "sheet", "left_anti")
    firsts = filled.join(rest, "sheet").filter("column = 0 and row > head").groupBy("sheet", "head").agg((F.count(F.when(T.period(F.col("text")).isNotNull(), 1)) / F.count(F.lit(1))).alias("share")).filter(F.col("share") >= PERIODS)
    turned = firsts.select("sheet", F.lit("transposed").alias("form"), (F.col("head") + 1).alias("data_start"), F.lit(1).cast("long").alias("header_rows"), F.lit(0).cast("long").alias("blocks"), F.lit("").alias("title"))
    found = upright.unionByName(turned)
    left = filled.select("sheet").distinct().join(found.select("sheet"), "sheet", "left_anti")
    none = left.select("sheet", F.lit("unknown").alias("form"), F.lit(0).cast("long").alias("data_start"), F.lit(0).cast("long").alias("header_rows"), F.lit(0).cast("long").alias("blocks"), F.lit("").alias("title"))
    return found.unionByName(none)


def values_of(cells: DataFrame, territories: DataFrame) -> DataFrame:
    """sheet, code, year, kind, number, header and value of sheets with years or periods in columns, in however many blocks; a value belongs to the nearest column of territories to its left."""
    named = read_cells(cells, territories)
    filled = named.drop("code")
    profiles = column_profiles(named)
    left = Window.partitionBy("sheet").orderBy("column").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = profiles.withColumn("place", F.last(F.when(F.col("role") == "territory", F.col("column")), ignorenulls=True).over(left)).filter("role = 'value' and year is not null")
    body = filled.join(columns.select("sheet", "column", "place", "data_start", "year", "kind", "number", "header"), ["sheet", "column"]).filter("row >= data_start")
    places = named.filter("code is not null").select("sheet", "row", F.col("column").alias("place"), "code")
    return body.join(places, ["sheet", "row", "place"]).select("sheet", "code", "year", "kind", "number", "header", T.cell_value(F.col("text")).alias("value"))

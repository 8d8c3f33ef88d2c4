"""Building dimensions: sections, editions, units, series, notes and breaks, territory codes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Scales in front of a unit, and the days of a unit that is a point in time.
SCALE_WORDS = r"^(thousand|mln|million|bn|billion) "
MOMENTS = (("jan1", "1 January"), ("dec31", "31 December"))


def make_code(prefix: str, value: Column) -> Column:
    """``prefix_`` and the first ten digits of a SHA-1."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(value.cast("binary")), 1, 10))


def sections(series: DataFrame) -> DataFrame:
    """Sections (the measure of a series key) with code and numbers of series and of indicators (first part of the slice)."""
    name, part = F.split("series_key", ":")[0], F.split(F.split("series_key", ":")[1], "/")[0]
    rows = series.select(name.alias("name"), "series_key", part.alias("indicator")).distinct()
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("series_count"), F.count_distinct("indicator").alias("indicator_count")).select(make_code("sec", F.col("name")).alias("section_code"), "name", "series_count", "indicator_count")


def editions(rows: DataFrame) -> DataFrame:
    """Editions by title: the year in it, the publication's name before it, and the years it covers. Rows: title, year."""
    g = rows.groupBy("title").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    year = F.regexp_extract("title", r"((?:19|20)\d\d)", 1).try_cast("long")
    return g.select("title", year.alias("edition_year"), F.trim(F.regexp_replace("title", r"\s*(19|20)\d\d.*$", "")).alias("publication"), "first_year", "last_year")


def text_country_multiplier(text: Column) -> Column:
    """The multiplier that a text declares for the country, or null."""
    declared = F.regexp_extract(F.lower(text), r"for the country: *(\w+)", 1)
    return F.when(declared != "", T.unit_multiplier(declared))


def unit_moment(unit: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, day in MOMENTS:
        out = F.when(F.contains(unit, F.lit(day)), name).otherwise(out)
    return out


def unit_base(unit: Column) -> Column:
    """The unit without scale, moment and what is said of the country."""
    out = F.regexp_replace(unit, r"\(.*\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r",? (at|on) (1 January|31 December)", ""), SCALE_WORDS, ""))


def country_scale(multiplier: Column, country_multiplier: Column) -> Column:
    """How many own units the country's unit is; unknown if either is."""
    return F.try_divide(country_multiplier, multiplier)


def unit_scales(units: DataFrame) -> DataFrame:
    """base, multiplier, country's multiplier, moment and kind of each distinct unit."""
    base, own = unit_base(F.col("unit")), T.unit_multiplier(F.regexp_replace("unit", r"\(.*\)", ""))
    return units.distinct().select("unit", base.alias("base"), own.alias("multiplier"), text_country_multiplier(F.col("unit")).alias("country_multiplier"), unit_moment(F.col("unit")).alias("moment"), T.unit_kind(base).alias("kind"))


def modal_unit(rows: DataFrame, placeholder: str) -> DataFrame:
    """The most frequent unit of each series; the placeholder only if there is no other, then by name. Rows: series_key, unit."""
    counts = rows.groupBy("series_key", "unit").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("series_key").orderBy(F.col("unit") == placeholder, F.desc("n"), "unit")
    return counts.withColumn("_i", F.row_number().over(order)).filter("_i = 1").drop("_i")


def inherit_total_units(units: DataFrame, placeholder: str) -> DataFrame:
    """Series whose unit is the placeholder take that of their total (the same indicator, slice ``00``)."""
    total = units.select(F.col("series_key").alias("total_key"), F.col("unit").alias("total_unit"))
    own = F.concat(F.split("series_key", ":")[0], F.lit(":00"))
    joined = units.join(total, (own == F.col("total_key")) & (F.col("series_key") != F.col("total_key")), "left")
    lacks = F.col("unit") == placeholder
    return joined.select("series_key", F.when(lacks, F.coalesce("total_unit", "unit")).otherwise(F.col("unit")).alias("unit"), (lacks & F.col("total_unit").isNotNull() & F.coalesce(F.col("total_unit") != placeholder, F.lit(False))).alias("inherited"))


def build_series(rows: DataFrame) -> DataFrame:
    """Series of indicator and cleaned subsection: key, modal unit, least title, and rows of that unit. Rows: indicator, subsection, unit, title."""
    clean = F.trim(F.regexp_replace("subsection", r"(?i)^of which: *", ""))
    keyed = rows.select(T.series_code(F.col("indicator"), clean).alias("series_key"), "unit", "title")
    unit = modal_unit(keyed, "").select("series_key", "unit")
    return keyed.join(unit, ["series_key", "unit"]).groupBy("series_key", "unit").agg(F.min("title").alias("title"), F.count(F.lit(1)).alias("n"))


def counters(dimension: DataFrame, observation: DataFrame, key: str) -> DataFrame:
    """Known observations and series of each member, 0 where there is none."""
    n = observation.filter("value is not null").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("series_key").alias("s"))
    return dimension.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("observations"), F.coalesce("s", F.lit(0)).alias("series"))


def note_kind(note: Column) -> Column:
    """What a note on method tells: recalculated, census, coverage, preliminary or other."""
    low, out = F.lower(note), F.lit("other")
    for kind, pattern in reversed((("recalculated", "recalculat"), ("census", "census"), ("coverage", "without|sample|includ"), ("preliminary", "preliminary|estimate"))):
        out = F.when(F.rlike(low, F.lit(pattern)), kind).otherwise(out)
    return out


def note_years(note: Column) -> Column:
    return F.regexp_extract_all(note, F.lit(r"((?:19|20)\d\d)"), F.lit(1))


#: Kinds of a break, the one that prevails first, and what in a clause tells of them.
BREAK_KINDS = (("methodology", "method|classifier|procedure"), ("coverage", "sample|without|includ|census|firms"), ("territory", "district|territor|composition|boundar"))
_YEAR = r"((?:19|20)\d\d)"


def break_kind(low: Column) -> Column:
    """The prevailing kind that a text in lower case tells of; null if none."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(BREAK_KINDS):
        out = F.when(F.rlike(low, F.lit(pattern)), kind).otherwise(out)
    return out


def clause_years(low: Column) -> Column:
    """Years in which what a clause (in lower case) describes begins or is over.

    since, from or starting with Y: Y. until, up to or before Y: Y, as Y is the first that differs; with ``inclusive``, and after
    through: Y + 1. from Y to Z: Z + 1. Y-Z: Z + 1, unless the words after it, up to the next year, speak of the basis of a census, which makes years
    comparable (no break), or of a new classifier (Y).
    """
    every = lambda pattern, group=1: F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(group)), lambda y: y.try_cast("long"))
    after = lambda years: F.transform(years, lambda y: y + 1)
    since = every(rf"\b(?:since|from|starting (?:with|from|in)) {_YEAR}\b(?!\s*(?:to\b|[-–—]))")
    until = every(rf"\b(?:until|up to|before) {_YEAR}\b(?!,? inclusive)")
    through = every(rf"\b(?:(?:until|up to|before) (?={_YEAR},? inclusive)|through ){_YEAR}", 2)
    ended = every(rf"\bfrom (?:19|20)\d\d to {_YEAR}")
    span = rf"{_YEAR}\s*[-–—]\s*{_YEAR}(\D*)"
    spans = F.arrays_zip(every(span).alias("first"), every(span, 2).alias("last"), F.regexp_extract_all(low, F.lit(span), F.lit(3)).alias("tail"))
    told = F.transform(spans, lambda s: F.when(F.rlike(s["tail"], F.lit("basis of the census|census taken into account")), F.lit(None)).when(F.rlike(s["tail"], F.lit("new classifier")), s["first"]).otherwise(s["last"] + 1))
    return F.array_distinct(F.array_compact(F.concat(since, until, after(through), after(ended), told)))


def note_breaks(notes: DataFrame) -> DataFrame:
    """note, break_year and kind: where values stop to be comparable, clause by clause (parted by semicolons and full stops).

    A clause that says values are recalculated has no break. A clause without words of a kind has the note's, but for a change of territories, which
    needs its own words. A note whose clauses tell no year, and do not speak of recalculation, breaks at the only year it names.
    """
    said = notes.select("note").distinct().withColumn("low", F.lower("note"))
    own = break_kind(F.col("low"))
    clauses = said.select("note", "low", own.alias("own"), F.explode(F.split("low", r";\s*|(?<=[a-z0-9)])\.\s+(?=\S)")).alias("clause"))
    again = F.contains("clause", F.lit("recalculat"))
    unmarked = F.coalesce(F.when(F.col("own") != "territory", F.col("own")), F.lit("methodology"))
    told = clauses.select("note", "low", "own", again.alias("again"), F.coalesce(break_kind(F.col("clause")), unmarked).alias("kind"), F.when(again, F.array().cast("array<bigint>")).otherwise(clause_years(F.col("clause"))).alias("years"))
    found = told.select("note", F.explode("years").alias("break_year"), "kind")
    silent = told.groupBy("note", "low", "own").agg(F.sum(F.size("years")).alias("n"), F.bool_or("again").alias("again")).filter("n = 0 and not again")
    alone = silent.withColumn("named", F.array_distinct(note_years(F.col("low")))).filter("size(named) = 1").select("note", F.col("named")[0].try_cast("long").alias("break_year"), F.coalesce("own", F.lit("methodology")).alias("kind"))
    rank = F.array_position(F.array(*[F.lit(k) for k, _ in BREAK_KINDS]), F.col("kind"))
    return found.unionByName(alone).groupBy("note", "break_year").agg(F.min_by("kind", rank).alias("kind"))


def methodology(notes: DataFrame, spans: DataFrame) -> DataFrame:
    """Breaks of each series inside its span, and how many notes tell of them. Notes: series_key, note; spans: series_key, first_year, last_year."""
    rows = notes.select("series_key", "note").distinct().join(note_breaks(notes), "note")
    return rows.join(spans, "series_key").filter("break_year > first_year and break_year <= last_year").groupBy("series_key", "break_year").agg(F.count(F.lit(1)).alias("notes"))


def source_breaks(stitched: DataFrame, conditional: int = 128) -> DataFrame:
    """Series that are continued conditionally break at the first year of the continuation."""
    return stitched.filter(F.col("flags").bitwiseAND(conditional) > 0).groupBy("series_key").agg(F.min("year").alias("break_year"))


def fix_typography(text: Column, replacements: Mapping[str, str]) -> Column:
    """Fragments replaced in the order given."""
    for old, new in replacements.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def missing_series(asked: DataFrame, known: DataFrame) -> DataFrame:
    return asked.join(known, "series_key", "left_anti").select("series_key").distinct()


def territory_codes(labels: DataFrame, directory: DataFrame) -> DataFrame:
    """Codes of labels by normalised name, then with look-alike letters folded; null for strangers. Directory: name, code."""
    names = directory.select(T.label(F.col("name")).alias("_name"), "code")
    own = labels.withColumn("_clean", T.label(F.col("label"))).withColumn("_folded", T.label(T.fold_lookalikes(F.col("label"))))
    first = own.join(names, F.col("_clean") == F.col("_name"), "left").drop("_name")
    second = names.select(F.col("_name").alias("_other"), F.col("code").alias("_code"))
    return first.join(second, F.col("_folded") == F.col("_other"), "left").select("label", F.coalesce("code", "_code").alias("code"))


def period_of_date(day: Column) -> Column:
    """The first of a month is a point; the last days of December (from the 28th) are the point of the next year; other days tell a month."""
    late = (F.month(day) == 12) & (F.dayofmonth(day) >= 28)
    year = F.when(late, F.year(day) + 1).otherwise(F.year(day)).cast("long")
    return F.struct(year.alias("year"), F.when(late | (F.dayofmonth(day) == 1), "point").otherwise("month").alias("kind"), F.when(late, 1).otherwise(F.month(day)).cast("long").alias("month"))

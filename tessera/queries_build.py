"""Queries of sources, dimensions, facts, quality rules and derived series that go beyond the cube itself, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import dimensions, facts, recalculate
from tessera.registry import on_cube, on_tables
from tessera.sources import profile, tables

_KNOWN = "value IS NOT NULL"

# Sources

_LINE = {"l_orderkey": "long", "l_linenumber": "int", "l_quantity": "double", "l_shipdate": "timestamp", "l_comment": "string", "l_returnflag": "long"}
on_tables("src02_profile_source", lambda li: profile.profile_source(li, _LINE, "l_orderkey", "l_quantity", {"rows": 1000, "keys": 10**9}), "lineitem", """
  SELECT 'missing: l_comment' AS item, NULL::DOUBLE AS amount, false AS fine UNION ALL SELECT 'type: l_returnflag', NULL, false
  UNION ALL SELECT 'rows', count(*), count(*) >= 1000 FROM lineitem UNION ALL SELECT 'keys', count(DISTINCT l_orderkey), count(DISTINCT l_orderkey) >= 1000000000 FROM lineitem
  UNION ALL SELECT 'empty values', count(*) FILTER (l_quantity IS NULL), true FROM lineitem UNION ALL SELECT 'negative values', count(*) FILTER (l_quantity < 0), true FROM lineitem
  UNION ALL SELECT 'least', min(l_quantity), true FROM lineitem UNION ALL SELECT 'most', max(l_quantity), true FROM lineitem""")
on_tables("src03_type_families", lambda o: profile.type_families(o), "orders", """
  SELECT column_name AS "column", CASE WHEN column_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') THEN 'whole' WHEN column_type IN ('FLOAT', 'DOUBLE') THEN 'real' WHEN column_type LIKE 'TIMESTAMP%' THEN 'time' WHEN column_type = 'VARCHAR' THEN 'text' ELSE 'other' END AS family
  FROM (DESCRIBE SELECT * FROM orders)""")
on_tables("src04_unmapped", lambda c, n: profile.unmapped(c.select(F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey") % 40).alias("label")), n.select(F.concat_ws(" ", F.lit("BUILDING"), "n_nationkey").alias("label")), "label"), "customer nation", """
  SELECT label, count(*) AS n FROM (SELECT c_mktsegment || ' ' || (c_nationkey % 40) AS label FROM customer) WHERE label NOT IN (SELECT 'BUILDING ' || n_nationkey FROM nation) GROUP BY label""")
on_tables("src14_json_measures", lambda e, n: profile.json_measures(e, n), "events nation", """
  SELECT territory_code, measure, max(value) AS value, count(*) AS n, count(DISTINCT value) > 1 AS conflict FROM (
    SELECT 'N' || n_nationkey AS territory_code, event_type AS measure, (props::JSON->>'k')::DOUBLE AS value FROM events JOIN nation ON n_nationkey = user_id % 30 WHERE event_type IN ('click', 'view', 'purchase') AND (props::JSON->>'k') IS NOT NULL) GROUP BY ALL""")
on_tables("src15_registry_at_date", lambda e: profile.registry_at(e, "day"), "events", """
  , d AS (SELECT max(ts::DATE) AS last FROM events) SELECT CASE WHEN user_id % 30 < 25 THEN 'N' || (user_id % 30) ELSE 'ext:' || (user_id % 30) END AS territory_code, event_type AS measure, count(*) AS value FROM events, d WHERE ts::DATE = last GROUP BY ALL""".replace(", d AS", "WITH d AS", 1))
on_tables("src17_store_new", lambda d: tables.store_new(d.filter("doc_id % 2 = 0").select("doc_id", F.sha2("text", 256).alias("sha256")), d.filter("doc_id % 3 = 0").select(F.sha2("text", 256).alias("sha256"))).select("sha256"), "documents", """
  SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE doc_id % 2 = 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)""")


def _release(c, edition: int) -> DataFrame:
    return c.vintage.filter(F.col("edition") == edition).select(F.col("series_key").alias("measure"), "territory_code", F.lit("annual").alias("period_kind"), "year", F.lit(0).alias("period"), "value")


on_cube("src18_changes_since", lambda c: tables.changes_since(_release(c, 2), _release(c, 1)), """SELECT a.series_key AS measure, count(b.value) AS common, count(*) FILTER (abs(a.value - b.value) > 1e-9) AS changed, max(a.year) AS last_year
  FROM vintage a LEFT JOIN vintage b ON b.edition = 1 AND b.series_key = a.series_key AND b.territory_code = a.territory_code AND b.year = a.year WHERE a.edition = 2 GROUP BY a.series_key""")
on_tables("src20_release_links", lambda p: tables.release_links(p), "pages", """
  SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY i) AS place FROM (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)) WHERE link <> ''""")
on_tables("src33_pasted_rows", lambda d: tables.pasted_rows(d.filter("doc_id is not null"), "doc_id", "text"), "documents", r"""
  SELECT doc_id, "row"::BIGINT AS "row", len(string_split(line, chr(9)))::BIGINT AS cells, string_split(line, chr(9))[1] AS first_cell FROM (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS "row" FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents)) WHERE trim(line, chr(9) || ' ') <> ''""")

# Dimensions

on_cube("dim02_sections", lambda c: dimensions.sections(c.vintage.select("series_key").distinct()), "SELECT 'sec_' || substr(sha1(split_part(series_key, ':', 1)), 1, 10) AS section_code, split_part(series_key, ':', 1) AS name, count(*) AS series_count, count(DISTINCT split_part(split_part(series_key, ':', 2), '/', 1)) AS indicator_count FROM (SELECT DISTINCT series_key FROM vintage) GROUP BY 2")
on_cube("dim03_editions", lambda c: dimensions.editions(c.vintage.select(F.concat_ws(" ", F.lit("Regions of the world"), F.col("edition") + 2000, F.lit("edition")).alias("title"), "year")), "SELECT title, (regexp_extract(title, '(19|20)[0-9][0-9]'))::BIGINT AS edition_year, trim(regexp_replace(title, '\\s*(19|20)[0-9][0-9].*$', '')) AS publication, min(year) AS first_year, max(year) AS last_year FROM (SELECT 'Regions of the world ' || (edition + 2000) || ' edition' AS title, year FROM vintage) GROUP BY title")

_UNITS = "(SELECT DISTINCT p_brand, CASE p_size % 5 WHEN 0 THEN 'thousand ' WHEN 1 THEN 'mln ' WHEN 2 THEN 'billion ' ELSE '' END || CASE p_size % 3 WHEN 0 THEN 'dollars' WHEN 1 THEN 'persons' ELSE 'kg' END || CASE p_size % 7 WHEN 0 THEN ', at 1 January' WHEN 1 THEN ' on 31 December' WHEN 2 THEN ' (for the country: mln)' ELSE '' END AS unit FROM part)"
_MULT = "CASE WHEN regexp_matches({0}, '\\b(bn|billion)') THEN 1e9 WHEN regexp_matches({0}, '\\b(mln|million)') THEN 1e6 WHEN regexp_matches({0}, '\\b(k|thousand)') THEN 1e3 ELSE 1.0 END::DOUBLE"
_BASE = "trim(regexp_replace(regexp_replace(regexp_replace(unit, '\\(.*\\)', ''), ',? (at|on) (1 January|31 December)', ''), '^(thousand|mln|million|bn|billion) ', ''))"


def _units(part: DataFrame) -> DataFrame:
    size = F.col("p_size")
    scale = F.when(size % 5 == 0, "thousand ").when(size % 5 == 1, "mln ").when(size % 5 == 2, "billion ").otherwise("")
    base = F.when(size % 3 == 0, "dollars").when(size % 3 == 1, "persons").otherwise("kg")
    tail = F.when(size % 7 == 0, ", at 1 January").when(size % 7 == 1, " on 31 December").when(size % 7 == 2, " (for the country: mln)").otherwise("")
    return part.select("p_brand", F.concat(scale, base, tail).alias("unit")).distinct()


_OWN = _MULT.format("regexp_replace(lower(unit), '\\(.*\\)', '')")
on_tables("dim04_unit_scales", lambda p: dimensions.unit_scales(_units(p).select("unit")), "part", f"SELECT DISTINCT unit, {_BASE} AS base, {_OWN} AS multiplier, CASE WHEN unit LIKE '%country: mln%' THEN 1e6::DOUBLE END AS country_multiplier, CASE WHEN unit LIKE '%1 January%' THEN 'jan1' WHEN unit LIKE '%31 December%' THEN 'dec31' END AS moment, CASE {_BASE} WHEN 'dollars' THEN 'currency' WHEN 'kg' THEN 'physical' ELSE 'people' END AS kind FROM {_UNITS}")
on_tables("dim11_country_scale", lambda p: dimensions.unit_scales(_units(p).select("unit")).select("unit", dimensions.country_scale(F.col("multiplier"), F.col("country_multiplier")).alias("country_scale")), "part", f"SELECT DISTINCT unit, CASE WHEN unit LIKE '%country: mln%' THEN 1e6 / {_OWN} END::DOUBLE AS country_scale FROM {_UNITS}")
on_tables("dim12_text_scale", lambda p: _units(p).select("unit", dimensions.text_country_multiplier(F.col("unit")).alias("scale")).distinct(), "part", f"SELECT DISTINCT unit, CASE WHEN unit LIKE '%country: mln%' THEN 1e6::DOUBLE END AS scale FROM {_UNITS}")
on_tables("dim13_unit_moment", lambda p: _units(p).groupBy(dimensions.unit_moment(F.col("unit")).alias("moment")).agg(F.count_distinct("unit").alias("units")), "part", f"SELECT CASE WHEN unit LIKE '%1 January%' THEN 'jan1' WHEN unit LIKE '%31 December%' THEN 'dec31' END AS moment, count(DISTINCT unit) AS units FROM {_UNITS} GROUP BY 1")
on_tables("dim14_unit_base", lambda p: _units(p).select(dimensions.unit_base(F.col("unit")).alias("base"), T.unit_multiplier(F.regexp_replace("unit", r"\(.*\)", "")).alias("multiplier")).distinct(), "part", f"SELECT DISTINCT {_BASE} AS base, {_OWN} AS multiplier FROM {_UNITS}")
on_tables("dim06_modal_units", lambda p: dimensions.modal_unit(p.select(F.col("p_brand").alias("series_key"), F.split("p_type", " ")[0].alias("unit")), "STANDARD"), "part", "SELECT series_key, unit, n FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY unit = 'STANDARD', n DESC, unit) AS i FROM (SELECT p_brand AS series_key, split_part(p_type, ' ', 1) AS unit, count(*) AS n FROM part GROUP BY ALL)) WHERE i = 1")
on_tables("dim07_inherited_units", lambda p: dimensions.inherit_total_units(dimensions.modal_unit(p.select(F.concat_ws(":", F.substring("p_brand", 1, 7), F.when(F.col("p_size") % 4 == 0, "00").otherwise(F.substring("p_brand", 8, 1))).alias("series_key"), F.when(F.col("p_size") % 4 == 0, F.split("p_type", " ")[0]).otherwise(F.lit("-")).alias("unit")), "-"), "-"), "part", """
  , m AS (SELECT series_key, unit FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY unit = '-', n DESC, unit) AS i FROM (SELECT substr(p_brand, 1, 7) || ':' || CASE WHEN p_size % 4 = 0 THEN '00' ELSE substr(p_brand, 8, 1) END AS series_key, CASE WHEN p_size % 4 = 0 THEN split_part(p_type, ' ', 1) ELSE '-' END AS unit, count(*) AS n FROM part GROUP BY ALL)) WHERE i = 1)
  SELECT a.series_key, CASE WHEN a.unit = '-' THEN coalesce(b.unit, a.unit) ELSE a.unit END AS unit, a.unit = '-' AND b.unit IS NOT NULL AND b.unit <> '-' AS inherited FROM m a LEFT JOIN m b ON b.series_key = split_part(a.series_key, ':', 1) || ':00' AND b.series_key <> a.series_key""".replace(", m AS", "WITH m AS", 1))
on_tables("dim05_series", lambda p: dimensions.build_series(p.select(F.col("p_brand").alias("indicator"), F.concat(F.lit("of which: "), "p_type").alias("subsection"), F.split("p_name", " ")[1].alias("unit"), F.col("p_name").alias("title"))), "part", """
  WITH k AS (SELECT p_brand || ':' || substr(sha1(p_type), 1, 8) AS series_key, split_part(p_name, ' ', 2) AS unit, p_name AS title FROM part),
  u AS (SELECT series_key, unit FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY n DESC, unit) AS i FROM (SELECT series_key, unit, count(*) AS n FROM k GROUP BY ALL)) WHERE i = 1)
  SELECT series_key, unit, min(title) AS title, count(*) AS n FROM k JOIN u USING (series_key, unit) GROUP BY ALL""")
on_cube("dim08_counters", lambda c: dimensions.counters(c.territory, c.observation, "territory_code"), f"SELECT territory_code, coalesce(n, 0) AS observations, coalesce(s, 0) AS series FROM territory LEFT JOIN (SELECT territory_code, count(*) AS n, count(DISTINCT series_key) AS s FROM observation WHERE {_KNOWN} GROUP BY ALL) USING (territory_code)")

#: Notes of every form, by the rest of the order's key and its year (y), and what they say: kind, years named, breaks.
_FORMS = (
    ("Since {0} data are recalculated.", "recalculated", (0,), ()),
    ("Until {0} without small firms.", "coverage", (0,), ((0, "coverage"),)),
    ("Until {0} inclusive by the old method; from {1} by the new method.", "other", (0, 1), ((1, "methodology"),)),
    ("In {0}-{2} by sample.", "coverage", (0, 2), ((3, "coverage"),)),
    ("In {0}-{2} by the new classifier.", "other", (0, 2), ((0, "methodology"),)),
    ("In {0}-{2} on the basis of the census.", "census", (0, 2), ()),
    ("In {0}-{2} data are recalculated; since {4} the district is counted with its neighbour.", "recalculated", (0, 2, 4), ((4, "territory"),)),
    ("Census of {0}.", "census", (0,), ((0, "coverage"),)),
    ("Preliminary data.", "preliminary", (), ()),
    ("From {0} to {3} in the former composition. Starting with {1} the method is the same in all districts.", "other", (0, 3, 1), ((4, "territory"), (1, "methodology"))),
)


def _said(form: str) -> str:
    """A form as SQL over y."""
    import re

    parts = re.split(r"\{(\d)\}", form)
    return " || ".join(f"(y + {p})" if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts) if p)


_CASES = lambda of: "CASE k " + " ".join(f"WHEN {i} THEN {of(f)}" for i, f in enumerate(_FORMS)) + " END"
_NOTES = f"(SELECT series_key, k, y, {_CASES(lambda f: _said(f[0]))} AS note FROM (SELECT o_orderpriority AS series_key, o_orderkey % {len(_FORMS)} AS k, year(o_orderdate)::BIGINT AS y FROM orders))"
_KIND = _CASES(lambda f: f"'{f[1]}'")
_BREAKS = _CASES(lambda f: "[" + ", ".join(f"{{'break_year': y + {n}, 'kind': '{k}'}}" for n, k in f[3]) + "]" if f[3] else "[]")


def _notes(orders: DataFrame) -> DataFrame:
    rows = orders.select(F.col("o_orderpriority").alias("series_key"), (F.col("o_orderkey") % len(_FORMS)).alias("k"), F.year("o_orderdate").cast("long").alias("y"))
    return rows.select("series_key", F.expr(_CASES(lambda f: _said(f[0]))).alias("note"))


on_tables("dim15_notes", lambda o: _notes(o).select("note").distinct().select("note", dimensions.note_kind(F.col("note")).alias("kind"), F.array_join(dimensions.note_years(F.col("note")), ",").alias("years")), "orders", f"SELECT DISTINCT note, {_KIND} AS kind, {_CASES(lambda f: ' || \',\' || '.join(f'(y + {n})::VARCHAR' for n in f[2]) or repr(''))} AS years FROM {_NOTES}")
on_tables("dim16_breaks", lambda o: dimensions.note_breaks(_notes(o)), "orders", f"SELECT DISTINCT note, b.break_year, b.kind FROM (SELECT note, unnest({_BREAKS}) AS b FROM {_NOTES})")
on_tables("dim21_methodology", lambda o: dimensions.methodology(_notes(o), o.groupBy(F.col("o_orderpriority").alias("series_key")).agg((F.min(F.year("o_orderdate")) + 2).cast("long").alias("first_year"), F.max(F.year("o_orderdate")).cast("long").alias("last_year"))), "orders", f"""
  WITH s AS (SELECT o_orderpriority AS series_key, min(year(o_orderdate)) + 2 AS f, max(year(o_orderdate)) AS l FROM orders GROUP BY 1)
  SELECT series_key, break_year, count(*) AS notes FROM (SELECT DISTINCT series_key, note, b.break_year FROM (SELECT series_key, note, unnest({_BREAKS}) AS b FROM {_NOTES})) JOIN s USING (series_key) WHERE break_year > f AND break_year <= l GROUP BY ALL""")
on_tables("dim20_typography", lambda p: p.select("p_type", dimensions.fix_typography(F.col("p_type"), {"BURNISHED": "POLISHED", "  ": " ", "PLATED ": "COATED "}).alias("fixed")).distinct(), "part", "SELECT DISTINCT p_type, replace(replace(replace(p_type, 'BURNISHED', 'POLISHED'), '  ', ' '), 'PLATED ', 'COATED ') AS fixed FROM part")
on_cube("dim22_source_breaks", lambda c: dimensions.source_breaks(facts.stitch(*_two(c), 0.2)), """, """ + (_TWO := f"""src AS (SELECT series_key, territory_code, year, value FROM vintage WHERE edition = 6 AND {_KNOWN}), last AS (SELECT max(year) - 2 AS y FROM observation), ds AS (SELECT series_key, territory_code, year, value FROM vintage, last WHERE edition = 5 AND {_KNOWN} AND year <= y),
  dl AS (SELECT series_key, max(year) AS ly FROM ds GROUP BY ALL), bt AS (SELECT s.series_key, s.territory_code, s.year, CASE WHEN d.value = 0 THEN CASE WHEN s.value = 0 THEN 0.0 ELSE 'inf'::DOUBLE END ELSE abs(s.value - d.value) / abs(d.value) END AS off FROM src s JOIN ds d USING (series_key, territory_code, year) JOIN dl USING (series_key) WHERE s.year < ly),
  rc AS (SELECT series_key, count(*) AS cells, round(avg(CASE WHEN off <= 0.2 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share, round(median(off), 6) AS median_off, round(max(off), 6) AS largest_off, max(row(off, territory_code, year)) AS w FROM (SELECT *, dense_rank() OVER (PARTITION BY series_key ORDER BY year DESC) AS age FROM bt) WHERE age <= 3 GROUP BY ALL),
  nw AS (SELECT s.series_key, s.territory_code, s.year, s.value, ly, share >= 0.95 AS full_, s.year = ly AND share >= 0.95 AND d.value IS NOT NULL AND NOT (CASE WHEN d.value = 0 THEN CASE WHEN s.value = 0 THEN 0.0 ELSE 'inf'::DOUBLE END ELSE abs(s.value - d.value) / abs(d.value) END <= 0.2) AS revises FROM src s JOIN dl USING (series_key) JOIN rc USING (series_key) LEFT JOIN ds d ON d.series_key = s.series_key AND d.territory_code = s.territory_code AND d.year = s.year WHERE s.year >= ly),
  st AS (SELECT series_key, territory_code, year, value, (64 + CASE WHEN NOT full_ THEN 128 ELSE 0 END + CASE WHEN revises THEN 512 ELSE 0 END)::BIGINT AS flags FROM nw WHERE year > ly OR revises
    UNION ALL SELECT series_key, territory_code, year, value, 0 FROM ds WHERE (series_key, territory_code, year) NOT IN (SELECT (series_key, territory_code, year) FROM nw WHERE year > ly OR revises))""") + " SELECT series_key, min(year) AS break_year FROM st WHERE flags & 128 > 0 GROUP BY ALL")


def _two(c):
    """A source (edition 6) and a dataset that ends two years earlier (edition 5)."""
    source = c.vintage.filter("edition = 6 and value is not null").select(*facts.CELL, "value")
    last = c.observation.agg((F.max("year") - 2).alias("y"))
    return source, c.vintage.filter("edition = 5 and value is not null").join(F.broadcast(last), F.col("year") <= F.col("y")).select(*facts.CELL, "value")


on_cube("dim23_missing_series", lambda c: dimensions.missing_series(c.vintage.select(F.concat_ws(":", F.split("series_key", ":")[0], F.substring(F.split("series_key", ":")[1], 1, 5)).alias("series_key")).distinct(), c.vintage.select("series_key").distinct()), "SELECT DISTINCT k AS series_key FROM (SELECT split_part(series_key, ':', 1) || ':' || substr(split_part(series_key, ':', 2), 1, 5) AS k FROM vintage) WHERE k NOT IN (SELECT series_key FROM vintage)")
on_tables("dim24_territory_codes", lambda n, p: dimensions.territory_codes(n.select(F.concat(F.lit("  "), F.initcap("n_name"), F.lit(" *")).alias("label")).unionByName(p.select(F.col("p_brand").alias("label")).distinct()), n.select(F.col("n_name").alias("name"), F.concat(F.lit("N"), "n_nationkey").alias("code"))), "nation part", """
  SELECT label, code FROM (SELECT '  ' || string_agg(upper(w[1]) || lower(substr(w, 2)), ' ' ORDER BY i) || ' *' AS label, any_value('N' || n_nationkey) AS code FROM (SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS w, generate_subscripts(string_split(n_name, ' '), 1) AS i FROM nation) GROUP BY n_nationkey) UNION ALL SELECT DISTINCT p_brand, NULL FROM part""")
on_tables("dim29_points_and_months", lambda o: o.select(F.to_date("o_orderdate").alias("day")).distinct().select("day", dimensions.period_of_date(F.col("day")).alias("p")).select("day", "p.*"), "orders", """
  SELECT DISTINCT o_orderdate::DATE AS day, (CASE WHEN month(o_orderdate) = 12 AND day(o_orderdate) >= 28 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END)::BIGINT AS year, CASE WHEN day(o_orderdate) = 1 OR month(o_orderdate) = 12 AND day(o_orderdate) >= 28 THEN 'point' ELSE 'month' END AS kind, (CASE WHEN month(o_orderdate) = 12 AND day(o_orderdate) >= 28 THEN 1 ELSE month(o_orderdate) END)::BIGINT AS month FROM orders""")

# Facts

_EDS = "ed AS (SELECT DISTINCT 'E' || edition AS edition_code, (1994 + edition // 2)::BIGINT AS edition_year, CASE WHEN edition % 2 = 0 THEN make_date(1994 + edition // 2, 6, edition) END AS released_on FROM vintage)"


def _editions(c) -> DataFrame:
    e, y = F.col("edition"), F.floor(1994 + F.col("edition") / 2).cast("long")
    return c.vintage.select(F.concat(F.lit("E"), "edition").alias("edition_code"), y.alias("edition_year"), F.when(e % 2 == 0, F.make_date(y.cast("int"), F.lit(6), e.cast("int"))).alias("released_on")).distinct()


def _corrections(c) -> DataFrame:
    odd = F.col("territory_code").isin("N1", "N3", "N5")
    return c.observation.filter("series_key = 'orders:00' and year in (1996, 2001)").select(*facts.CELL, F.when(odd, F.col("value")).otherwise(F.col("value") + 1).alias("old_value"), (F.coalesce("value", F.lit(1.0)) * 2).alias("new_value"))


_COR = "cor AS (SELECT series_key, territory_code, year, CASE WHEN territory_code IN ('N1', 'N3', 'N5') THEN value ELSE value + 1 END AS old_value, coalesce(value, 1.0) * 2 AS new_value FROM observation WHERE series_key = 'orders:00' AND year IN (1996, 2001))"
_plain = lambda c: c.observation.select(*facts.CELL, "value", F.lit(0).cast("long").alias("flags"))
on_cube("fct04_corrections", lambda c: facts.apply_corrections(_plain(c), _corrections(c)).filter("flags > 0"), f", {_COR} SELECT series_key, territory_code, year, new_value AS value, 32::BIGINT AS flags FROM cor JOIN observation USING (series_key, territory_code, year) WHERE value IS NOT DISTINCT FROM old_value")
on_cube("fct04_stale_corrections", lambda c: facts.stale_corrections(_plain(c), _corrections(c)), f", {_COR} SELECT series_key, territory_code, year, old_value, value AS found FROM cor JOIN observation USING (series_key, territory_code, year) WHERE value IS DISTINCT FROM old_value")
on_cube("fct05_rank_editions", lambda c: facts.rank_editions(_editions(c)), f", {_EDS} SELECT *, row_number() OVER (ORDER BY edition_year, coalesce(released_on, make_date(edition_year, 12, 31)), edition_code DESC) AS edition_rank FROM ed")
on_cube("fct08_quality_summary", lambda c: facts.quality_summary(c.observation), "SELECT quality, count(*) AS n, count(*) FILTER (value < 0) AS negative FROM observation GROUP BY quality")
on_cube("fct10_latest_release", lambda c: facts.latest_release(_editions(c).select((F.col("edition_year") % 2).alias("source"), F.col("edition_year").alias("reference_year"), F.col("released_on").alias("published_on"), F.col("edition_code").alias("fetched_at"))), f", {_EDS} SELECT source, reference_year, published_on, fetched_at FROM (SELECT edition_year % 2 AS source, edition_year AS reference_year, released_on AS published_on, edition_code AS fetched_at, row_number() OVER (PARTITION BY edition_year % 2 ORDER BY edition_year DESC, released_on DESC NULLS LAST, edition_code DESC) AS i FROM ed) WHERE i = 1")
on_cube("fct11_stitch", lambda c: facts.stitch(*_two(c), 0.2), f", {_TWO} SELECT * FROM st")
_links = lambda c: c.vintage.select("series_key").distinct().select("series_key", F.when(F.col("series_key").startswith("avg_price"), "supersede").otherwise("continue").alias("mode"), (~F.col("series_key").startswith("quantity")).alias("same_statistic"))


def _added(c) -> DataFrame:
    """Editions 6 and 7 as two releases of a source over a dataset that ends two years before."""
    releases = c.vintage.filter("edition >= 6").select(*facts.CELL, "value", (F.col("quality") == 2).alias("hidden"), F.lit(False).alias("preliminary"), F.col("edition").alias("release"))
    return facts.stitch_releases(releases, _two(c)[1], _links(c), 0.25, 0.8)


_OFF = "CASE WHEN d.value = 0 THEN CASE WHEN s.value = 0 THEN 0.0 ELSE 'inf'::DOUBLE END ELSE abs(s.value - d.value) / abs(d.value) END"
_ADDED = f""", last AS (SELECT max(year) - 2 AS y FROM observation), ds AS (SELECT series_key, territory_code, year, value FROM vintage, last WHERE edition = 5 AND {_KNOWN} AND year <= y), dl AS (SELECT series_key, max(year) AS ly FROM ds GROUP BY ALL),
  rl AS (SELECT series_key, territory_code, year, edition AS release, value, quality = 2 AS hidden FROM vintage WHERE edition >= 6), nw AS (SELECT series_key, release, max(year) FILTER (value IS NOT NULL) AS ny FROM rl GROUP BY ALL), lt AS (SELECT series_key, max(release) AS latest FROM rl GROUP BY ALL),
  rc AS (SELECT series_key, avg((off <= 0.25)::INT) AS share FROM (SELECT s.series_key, {_OFF} AS off, dense_rank() OVER (PARTITION BY s.series_key ORDER BY s.year DESC) AS age FROM rl s JOIN lt ON lt.series_key = s.series_key AND latest = release JOIN ds d ON d.series_key = s.series_key AND d.territory_code = s.territory_code AND d.year = s.year JOIN dl ON dl.series_key = s.series_key WHERE s.year < ly AND s.value IS NOT NULL) WHERE age <= 3 GROUP BY ALL),
  ml AS (SELECT s.*, ly, ny, latest, d.value AS old, CASE WHEN s.series_key LIKE 'avg_price%' THEN 'supersede' ELSE 'continue' END AS mode, CASE WHEN s.series_key LIKE 'avg_price%' THEN 'revision' WHEN share >= 0.8 THEN 'full' ELSE 'conditional' END AS kind, CASE WHEN d.value IS NULL THEN true WHEN s.value IS NULL THEN false ELSE NOT ({_OFF} <= 0.25) END AS revises
    FROM rl s JOIN dl USING (series_key) JOIN nw USING (series_key, release) JOIN lt USING (series_key) LEFT JOIN rc USING (series_key) LEFT JOIN ds d ON d.series_key = s.series_key AND d.territory_code = s.territory_code AND d.year = s.year),
  ad AS (SELECT series_key, territory_code, year, release, CASE WHEN NOT hidden THEN value END AS value, hidden, (64 + CASE WHEN kind = 'conditional' THEN 128 ELSE 0 END + CASE WHEN year = ny THEN 256 ELSE 0 END + CASE WHEN revises AND old IS NOT NULL AND year <= ly THEN 512 ELSE 0 END)::BIGINT AS flags, mode, kind, ly AS last_year, release = latest AS is_latest
    FROM ml WHERE CASE WHEN mode = 'supersede' THEN value IS NOT NULL ELSE year > ly OR (year = ly AND kind = 'full' AND series_key NOT LIKE 'quantity%' AND revises) END)"""
on_cube("fct11_releases_in_order", lambda c: _added(c).drop("last_year"), f"{_ADDED} SELECT * EXCLUDE (last_year) FROM ad")
on_cube("fct11_link_outcomes", lambda c: facts.link_outcomes(_added(c)), f"{_ADDED} SELECT series_key, mode, kind, count(*) AS vintages, count(*) FILTER (is_latest AND flags & 512 > 0) AS revised, CASE WHEN max(year) > max(last_year) THEN max(last_year) + 1 END AS junction_year, max(year) FILTER (year > last_year) AS last_year FROM ad GROUP BY ALL")
on_cube("fct11_resolved", lambda c: facts.resolve_releases(_added(c), _two(c)[1]), f"""{_ADDED} SELECT series_key, territory_code, year, release, value, flags FROM (SELECT *, row_number() OVER (PARTITION BY series_key, territory_code, year ORDER BY value IS NULL, release DESC NULLS LAST) AS i FROM (
    SELECT series_key, territory_code, year, release, value, flags FROM ad UNION ALL SELECT series_key, territory_code, year, NULL, value, 0 FROM ds)) WHERE i = 1""")
on_cube("fct12_reconcile", lambda c: facts.reconcile(*_two(c), 0.2), f", {_TWO} SELECT series_key, cells, share, median_off, largest_off, w[2] AS worst_territory, w[3] AS worst_year FROM rc")
on_cube("fct13_edition_counters", lambda c: facts.edition_counters(c.vintage), f"SELECT edition, count(*) AS observations, count(DISTINCT series_key) AS series, min(year) AS first_year, max(year) AS last_year FROM vintage WHERE {_KNOWN} GROUP BY edition")
_periods = lambda c: c.month.filter("kind = 'level' and value is not null").select(*facts.CELL, F.col("month").alias("period"), "value")
_PER = f"per AS (SELECT series_key, territory_code, year, month, value FROM month_fact WHERE kind = 'level' AND {_KNOWN})"
for _method, _sql in (
    ("december", "SELECT series_key, territory_code, year, value FROM per WHERE month = 12"), ("january_next", "SELECT series_key, territory_code, year - 1 AS year, value FROM per WHERE month = 1"), ("year_total", "SELECT series_key, territory_code, year, round(sum(value), 4) AS value FROM per GROUP BY ALL HAVING count(DISTINCT month) = 12"),
    ("mean_months", "SELECT series_key, territory_code, year, round(avg(value), 6) AS value FROM per GROUP BY ALL HAVING count(DISTINCT month) = 12"),
    ("mean_quarters", "SELECT series_key, territory_code, year, round(avg(q), 6) AS value FROM (SELECT series_key, territory_code, year, ceil(month / 3) AS k, sum(value) AS q FROM per GROUP BY ALL HAVING count(*) = 3) GROUP BY ALL HAVING count(*) = 4"),
):
    on_cube(f"fct14_annual_{_method}", lambda c, m=_method: facts.annual_of(_periods(c), m), f", {_PER} {_sql}")
on_cube("fct15_mean_of_periods", lambda c: facts.mean_of_periods(_periods(c).withColumn("hidden", F.col("value") < 3), 12), f", {_PER} SELECT series_key, territory_code, year, CASE WHEN NOT bool_or(value < 3) THEN round(avg(value), 6) END AS value, bool_or(value < 3) AS hidden FROM per GROUP BY ALL HAVING count(DISTINCT month) = 12")
on_cube("fct16_real_wage", lambda c: facts.real_wage(c.observation.filter("series_key = 'avg_price:00'").select("territory_code", "year", "value"), _periods(c).filter("series_key = 'orders:00'").select("territory_code", "year", "period", (100 + F.col("value") % 7).alias("value"))), f""", {_PER},
  lv AS (SELECT territory_code, year, exp(sum(ln((100 + value % 7) / 100)) OVER (PARTITION BY territory_code ORDER BY year, month ROWS UNBOUNDED PRECEDING)) AS l FROM per WHERE series_key = 'orders:00'), mn AS (SELECT territory_code, year, avg(l) AS l FROM lv GROUP BY ALL HAVING count(*) = 12),
  nw AS (SELECT territory_code, year, value, l FROM observation JOIN mn USING (territory_code, year) WHERE series_key = 'avg_price:00' AND value > 0)
  SELECT a.territory_code, a.year, round(a.value / b.value / (a.l / b.l) * 100, 4) AS real_wage FROM nw a JOIN nw b ON b.territory_code = a.territory_code AND b.year = a.year - 1""")
_OFF = "FROM observation a JOIN observation b ON b.series_key = a.series_key AND b.territory_code = a.territory_code AND b.year = a.year - 1 WHERE a.series_key = 'avg_price:00'"


def _year_pairs(c) -> DataFrame:
    rows = c.observation.filter("series_key = 'avg_price:00'")
    before = rows.select("territory_code", (F.col("year") + 1).alias("year"), F.col("value").alias("before"))
    return rows.select("territory_code", "year", "value").join(before, ["territory_code", "year"])


on_cube("fct18_within", lambda c: _year_pairs(c).select("territory_code", "year", facts.within(F.col("value"), F.col("before"), 0.01).alias("relative"), facts.within(F.col("value"), F.col("before"), 15.0, True).alias("points")), f"SELECT a.territory_code, a.year, abs(a.value - b.value) / abs(b.value) <= 0.01 AS relative, abs(a.value - b.value) <= 15 AS points {_OFF}")
on_cube("fct19_deviation", lambda c: _year_pairs(c).select("territory_code", "year", F.round(facts.deviation(F.col("value"), F.col("before")), 8).alias("relative"), F.round(facts.deviation(F.col("value"), F.col("before"), True), 4).alias("points")), f"SELECT a.territory_code, a.year, round(abs(a.value - b.value) / abs(b.value), 8) AS relative, round(abs(a.value - b.value), 4) AS points {_OFF}")
on_cube("fct21_measure_months", lambda c: c.month.filter("kind = 'level' and series_key = 'orders:00'").select(*facts.CELL, "month", F.when(F.col("value") >= 3, F.col("value")).alias("value"), (F.col("value") < 3).alias("hidden")), "SELECT series_key, territory_code, year, month, CASE WHEN value >= 3 THEN value END AS value, value < 3 AS hidden FROM month_fact WHERE kind = 'level' AND series_key = 'orders:00'")
on_cube("fct23_districts_as_sum", lambda c: facts.parts_as_sum(c.month.filter("kind = 'level'"), c.territory.filter("level = 'region' and not is_aggregate").select("territory_code", F.col("district_code").alias("whole"))), f""", sz AS (SELECT district_code, count(*) AS size FROM territory WHERE level = 'region' AND NOT is_aggregate GROUP BY ALL),
  sm AS (SELECT series_key, district_code, year, month, round(sum(value), 4) AS value, count(*) AS n FROM month_fact JOIN territory USING (territory_code) WHERE kind = 'level' AND {_KNOWN} AND level = 'region' AND NOT is_aggregate GROUP BY ALL)
  SELECT series_key, district_code AS territory_code, year, month, value FROM sm JOIN sz USING (district_code) WHERE n = size""")
on_cube("fct27_annual_of_months", lambda c: facts.annual_of(c.month.filter("kind = 'ytd'").select(*facts.CELL, F.col("month").alias("period"), "value"), "december"), "SELECT series_key, territory_code, year, value FROM month_fact WHERE kind = 'ytd' AND month = 12")
on_cube("fct29_annual_ratio", lambda c: recalculate.ratio(facts.annual_of(_periods(c), "year_total"), "revenue:00", "orders:00"), f", {_PER}, tot AS (SELECT series_key, territory_code, year, round(sum(value), 4) AS v FROM per GROUP BY ALL HAVING count(DISTINCT month) = 12) SELECT a.territory_code, a.year, round(a.v / b.v, 6) AS value FROM tot a JOIN tot b USING (territory_code, year) WHERE a.series_key = 'revenue:00' AND b.series_key = 'orders:00' AND b.v <> 0")
on_cube("fct30_latest_months", lambda c: facts.latest_months(c.month.withColumn("edition", F.lit(1)).unionByName(c.month.filter("month % 2 = 0").withColumn("edition", F.lit(2)).withColumn("value", F.col("value") + 1))), "SELECT series_key, territory_code, year, month, kind, value + CASE WHEN month % 2 = 0 THEN 1 ELSE 0 END AS value, (CASE WHEN month % 2 = 0 THEN 2 ELSE 1 END)::INT AS edition FROM month_fact")
on_cube("fct31_flags", lambda c: c.observation.select(*facts.CELL, facts.flags(corrected=F.col("revision_count") > 3, preliminary=F.col("year") == 2001, external=F.col("quality") == 2).alias("flags")).filter("flags > 0"), "SELECT * FROM (SELECT series_key, territory_code, year, (CASE WHEN revision_count > 3 THEN 32 ELSE 0 END + CASE WHEN year = 2001 THEN 256 ELSE 0 END + CASE WHEN quality = 2 THEN 64 ELSE 0 END)::BIGINT AS flags FROM observation) WHERE flags > 0")

_version = lambda c, e: c.vintage.filter(F.col("edition") == e).select(*facts.CELL, "value")
_DIFF = f"""df AS (SELECT * FROM (SELECT coalesce(a.series_key, b.series_key) AS series_key, coalesce(a.territory_code, b.territory_code) AS territory_code, coalesce(a.year, b.year) AS year, a.value AS old, b.value AS new,
  CASE WHEN a.value IS NULL AND b.value IS NOT NULL THEN 'appeared' WHEN b.value IS NULL AND a.value IS NOT NULL THEN 'lost' WHEN abs(b.value - a.value) > 1e-9 * greatest(1.0, abs(a.value)) THEN 'changed' END AS what
  FROM (SELECT * FROM vintage WHERE edition = 1) a FULL JOIN (SELECT * FROM vintage WHERE edition = 2) b ON b.series_key = a.series_key AND b.territory_code = a.territory_code AND b.year = a.year) WHERE what IS NOT NULL)"""
on_cube("fct33_changed_values", lambda c: facts.changed_values(_version(c, 1), _version(c, 2)), f", {_DIFF} SELECT *, round(CASE WHEN what = 'changed' AND old <> 0 THEN (new - old) / abs(old) END, 6) AS change FROM df")
_titles = lambda c: c.vintage.select("series_key").distinct()


def _old_and_new(c) -> tuple[DataFrame, DataFrame]:
    """Before: without slices of 3-MEDIUM; after: without 5-LOW, and with 1-URGENT spelt another way."""
    keys = _titles(c)
    title = F.split("series_key", ":")[1]
    old = keys.filter("series_key not like '%3-MEDIUM%'").select("series_key", title.alias("title"))
    new = keys.filter("series_key not like '%5-LOW%'").select(F.regexp_replace("series_key", "1-URGENT$", "1-URGENTS").alias("series_key")).select("series_key", title.alias("title"))
    return old, new


on_cube("fct34_changed_series", lambda c: facts.changed_series(*_old_and_new(c)), """, k AS (SELECT DISTINCT series_key FROM vintage) SELECT 'renamed' AS what, series_key AS old_key, series_key || 'S' AS new_key FROM k WHERE series_key LIKE '%:1-URGENT'
  UNION ALL SELECT what, old_key, new_key FROM (SELECT 'removed' AS what, series_key AS old_key, NULL AS new_key FROM k WHERE series_key LIKE '%5-LOW%' UNION ALL SELECT 'added', NULL, series_key FROM k WHERE series_key LIKE '%3-MEDIUM%')""")
_unit = lambda keys, flip: keys.select("series_key", F.when(F.col("series_key").startswith("orders"), None).when(F.col("series_key").startswith("revenue") & F.lit(flip), "mln").otherwise(F.col("series_key")).alias("unit"))
on_cube("fct35_changed_units", lambda c: facts.changed_units(_unit(_titles(c), False), _unit(_titles(c), True).withColumn("unit", F.when(F.col("series_key") == "orders:00", "pieces").otherwise(F.col("unit")))), "SELECT series_key, CASE WHEN series_key LIKE 'orders%' THEN NULL ELSE series_key END AS old_unit, CASE WHEN series_key LIKE 'orders%' THEN 'pieces' ELSE 'mln' END AS new_unit FROM (SELECT DISTINCT series_key FROM vintage) WHERE series_key LIKE 'revenue%' OR series_key = 'orders:00'")
on_tables("fct36_changed_notes", lambda o: facts.changed_notes(_notes(o.filter("o_orderkey % 5 < 3")).select("note").distinct(), _notes(o.filter("o_orderkey % 5 > 0")).select("note").distinct()), "orders", f"""
  WITH a AS (SELECT DISTINCT note FROM {_NOTES} WHERE k % 5 < 3), b AS (SELECT DISTINCT note FROM {_NOTES} WHERE k % 5 > 0)
  SELECT note, 'new' AS what FROM b WHERE note NOT IN (SELECT note FROM a) UNION ALL SELECT note, 'gone' FROM a WHERE note NOT IN (SELECT note FROM b)""")

# Copies of years and the country's scale, on vintages with planted faults


def _with_copy(c) -> DataFrame:
    """The first edition, with year 1990 of every series of revenue a copy of 1999."""
    rows = c.vintage.filter("edition = 1").select(*facts.CELL, "value")
    return rows.unionByName(rows.filter("year = 1999 and series_key like 'revenue%'").withColumn("year", F.lit(1990).cast("long")))


_PLANTED = "pl AS (SELECT series_key, territory_code, year, value FROM vintage WHERE edition = 1 UNION ALL SELECT series_key, territory_code, 1990, value FROM vintage WHERE edition = 1 AND year = 1999 AND series_key LIKE 'revenue%')"
_COPIES = f"""{_PLANTED}, vs AS (SELECT DISTINCT * FROM pl WHERE {_KNOWN}), pr AS (SELECT a.series_key, a.year AS year_a, b.year AS year_b, count(*) AS common, count(*) FILTER (a.value = b.value) AS equal FROM vs a JOIN vs b ON b.series_key = a.series_key AND b.territory_code = a.territory_code AND b.year > a.year GROUP BY ALL HAVING count(*) >= 10),
  cp AS (SELECT * FROM pr WHERE year_b - year_a >= 5 AND equal >= 0.9 * common AND series_key NOT IN (SELECT series_key FROM pr WHERE year_b - year_a = 1 AND equal >= 0.5 * common)), ys AS (SELECT DISTINCT series_key, year FROM vs),
  ln AS (SELECT series_key, year FROM ys y WHERE NOT EXISTS (SELECT 1 FROM ys z WHERE z.series_key = y.series_key AND abs(z.year - y.year) = 1)), dt AS (SELECT cp.*, (SELECT min(year) FROM ln WHERE ln.series_key = cp.series_key AND ln.year IN (year_a, year_b)) AS detached FROM cp)"""
on_cube("fct02_copies_found", lambda c: facts.year_copies(_with_copy(c)), f", {_COPIES} SELECT * FROM dt")
on_cube("fct02_without_copies", lambda c: facts.without_year_copies(_with_copy(c), facts.year_copies(_with_copy(c))).groupBy("series_key", "year").agg(F.count(F.lit(1)).alias("n")), f", {_COPIES} SELECT series_key, year, count(*) AS n FROM pl WHERE NOT EXISTS (SELECT 1 FROM dt WHERE dt.series_key = pl.series_key AND CASE WHEN detached IS NULL THEN pl.year IN (year_a, year_b) ELSE pl.year = detached END) GROUP BY ALL")


def _with_copies(c) -> DataFrame:
    """Vintages whose revenue has 1990 like 1999 (apart from the other years) and whose counts of orders have 2000 like 1995 in another edition (inside the run of years)."""
    rows = c.vintage.select(*facts.CELL, "edition", "value").filter("not (series_key like 'orders%' and year = 2000)")
    copy = rows.filter("year = 1999 and series_key like 'revenue%'").withColumn("year", F.lit(1990).cast("long"))
    within = rows.filter("year = 1995 and series_key like 'orders%'").withColumns({"year": F.lit(2000).cast("long"), "edition": F.lit(2).cast("long")})
    return rows.unionByName(copy).unionByName(within)


_COPIED = f"""wc AS (SELECT series_key, territory_code, year, edition, value FROM vintage WHERE NOT (series_key LIKE 'orders%' AND year = 2000) UNION ALL SELECT series_key, territory_code, 1990, edition, value FROM vintage WHERE year = 1999 AND series_key LIKE 'revenue%'
    UNION ALL SELECT series_key, territory_code, 2000, 2, value FROM vintage WHERE year = 1995 AND series_key LIKE 'orders%'),
  kn AS (SELECT DISTINCT w.* FROM wc w JOIN territory USING (territory_code) WHERE level = 'region' AND NOT is_aggregate AND value IS NOT NULL AND value <> 0),
  al AS (SELECT a.series_key, a.year AS ya, a.edition AS ea, b.year AS yb, b.edition AS eb FROM kn a JOIN kn b ON b.series_key = a.series_key AND b.territory_code = a.territory_code AND b.year > a.year GROUP BY ALL HAVING count(*) >= 10 AND count(*) FILTER (a.value = b.value) >= 0.9 * count(*)),
  st AS (SELECT series_key, ya AS year FROM al WHERE yb - ya = 1 UNION SELECT series_key, yb FROM al WHERE yb - ya = 1), rn AS (SELECT series_key, year, year - row_number() OVER (PARTITION BY series_key ORDER BY year) AS run FROM (SELECT DISTINCT series_key, year FROM kn)),
  fd AS (SELECT al.*, x.run AS ra, y.run AS rb FROM al JOIN rn x ON x.series_key = al.series_key AND x.year = ya JOIN rn y ON y.series_key = al.series_key AND y.year = yb WHERE yb - ya >= 5 AND NOT EXISTS (SELECT 1 FROM st WHERE st.series_key = al.series_key AND st.year IN (ya, yb))),
  gone AS (SELECT series_key, ya AS year, NULL::BIGINT AS edition FROM fd WHERE ra <> rb UNION SELECT series_key, ya, ea FROM fd WHERE ra = rb UNION SELECT series_key, yb, eb FROM fd WHERE ra = rb)"""
_REGION_CODES = lambda c: c.territory.filter("level = 'region' and not is_aggregate").select("territory_code")
on_cube("fct02_copied_years", lambda c: facts.copied_years(_with_copies(c), _REGION_CODES(c)), f", {_COPIED} SELECT * FROM gone")
on_cube("fct02_without_copied_years", lambda c: facts.without_copied_years(_with_copies(c), facts.copied_years(_with_copies(c), _REGION_CODES(c))).groupBy("series_key", "year", "edition").agg(F.count(F.lit(1)).alias("n")), f", {_COPIED} SELECT series_key, year, edition, count(*) AS n FROM wc WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.series_key = wc.series_key AND g.year = wc.year AND (g.edition IS NULL OR g.edition = wc.edition)) GROUP BY ALL")
_coarse = lambda c: c.observation.filter("not is_aggregate").select(*facts.CELL, F.when((F.col("territory_code") == "W") & (F.col("year") % 2 == 0), F.col("value") / 1000).otherwise(F.col("value")).alias("value"))
_COARSE = "co AS (SELECT series_key, territory_code, year, CASE WHEN territory_code = 'W' AND year % 2 = 0 THEN value / 1000 ELSE value END AS value FROM observation WHERE NOT is_aggregate)"
_REGS = "SELECT territory_code FROM territory WHERE level = 'region' AND NOT is_aggregate"
on_cube("fct03_scaled_country", lambda c: facts.reconcile_country_scale(_coarse(c), "W", c.territory.filter("level = 'region' and not is_aggregate"), 20).filter("territory_code = 'W'").withColumn("value", F.round("value", 4)), f""", {_COARSE}, tt AS (SELECT series_key, year, sum(value) AS total FROM co WHERE {_KNOWN} AND territory_code IN ({_REGS}) GROUP BY ALL HAVING count(*) >= 20),
  ff AS (SELECT co.*, CASE WHEN abs(value / total - 1) <= 0.05 THEN 1.0 WHEN abs(value * 1e3 / total - 1) <= 0.05 THEN 1e3 WHEN abs(value * 1e6 / total - 1) <= 0.05 THEN 1e6 WHEN abs(value * 1e-3 / total - 1) <= 0.05 THEN 1e-3 ELSE 1.0 END::DOUBLE AS factor FROM co LEFT JOIN tt USING (series_key, year) WHERE territory_code = 'W')
  SELECT series_key, territory_code, year, round(value * factor, 4) AS value, factor FROM ff""")

# Quality

_series_units = lambda p: _units(p).select(F.col("p_brand").alias("series_key"), "unit")
on_tables("mrt05_ambiguous_units", lambda p: facts.ambiguous_units(_series_units(p).select("series_key", "unit", F.when(F.col("unit").contains("dollars"), "euro").otherwise(F.col("unit")).alias("country_unit"), F.when(F.col("unit").startswith("mln"), 1.0).alias("ratio"))), "part", f"SELECT DISTINCT p_brand AS series_key, unit, 'euro' AS country_unit FROM {_UNITS} WHERE unit LIKE '%dollars%' AND unit NOT LIKE 'mln%'")
on_tables("mrt06_scale_conflicts", lambda p: facts.unit_scale_conflicts(_series_units(p).select("series_key", T.unit_multiplier(F.col("unit")).alias("scale"))), "part", f"SELECT p_brand AS series_key, count(DISTINCT m) AS scales, string_agg(DISTINCT m::BIGINT::VARCHAR, ',' ORDER BY m::BIGINT::VARCHAR) AS list FROM (SELECT p_brand, {_MULT.format('unit')} AS m FROM {_UNITS}) GROUP BY p_brand HAVING count(DISTINCT m) > 1")


def _zeros(c) -> DataFrame:
    zero = ((F.col("year") == 1997) & F.col("series_key").startswith("orders")) | ((F.col("year") == 1999) & (F.col("territory_code").isin("N2", "N4"))) | F.col("series_key").endswith("5-LOW") & (F.col("year") % 2 == 0)
    return c.regions.select(*facts.CELL, F.when(zero & F.col("value").isNotNull(), 0.0).otherwise(F.col("value")).alias("value"))


_ZEROS = f"""z AS (SELECT series_key, territory_code, year, CASE WHEN year = 1997 AND series_key LIKE 'orders%' OR year = 1999 AND territory_code IN ('N2', 'N4') OR series_key LIKE '%5-LOW' AND year % 2 = 0 THEN 0.0 ELSE value END AS value FROM reg WHERE {_KNOWN}),
  zn AS (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a, median(value) OVER (PARTITION BY series_key, territory_code) AS m FROM z WINDOW w AS (PARTITION BY series_key, territory_code ORDER BY year))"""
on_cube("mrt11_suspicious_zeros", lambda c: facts.suspicious_zeros(_zeros(c)), f""", {_ZEROS} SELECT series_key, 'year of zeros' AS signal, count(*) AS count FROM (SELECT series_key, year FROM z GROUP BY ALL HAVING count(*) FILTER (value = 0) = count(*) AND count(*) > 1) GROUP BY ALL
  UNION ALL SELECT series_key, 'many zeros', count(*) FILTER (value = 0) FROM z GROUP BY ALL HAVING count(*) FILTER (value = 0) > 0.3 * count(*) UNION ALL SELECT series_key, 'zero between values', count(*) FROM zn WHERE value = 0 AND b >= m AND a >= m AND m > 0 GROUP BY ALL""")
_universe = lambda c: c.territory.filter("level = 'region' and not is_aggregate").count()
_off = lambda c: c.observation.filter("territory_code = 'W'").select("series_key", "year", F.when(F.col("year") == 1998, F.col("value") * 1.5).when(F.col("year") == 1996, F.col("value") / 1000).otherwise(F.col("value")).alias("value"))
_CS = f"cs AS (SELECT series_key, year, sum(r.value) AS total, count(*) AS n, min(r.value) AS low, max(r.value) AS high, any_value(CASE year WHEN 1998 THEN w.country_value * 1.5 WHEN 1996 THEN w.country_value / 1000 ELSE w.country_value END) AS c FROM reg r JOIN country w USING (series_key, year) WHERE r.value IS NOT NULL AND w.country_value IS NOT NULL GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM ({_REGS})))"
on_cube("mrt12_country_sums", lambda c: facts.country_sums(c.regions, _off(c), _universe(c)), f", {_CS} SELECT series_key, year, round(total / c, 6) AS ratio FROM cs WHERE c > 0 AND abs(total / c - 1) > 0.01 AND NOT c BETWEEN low AND high AND NOT (abs(total / c / 1e3 - 1) <= 0.05 OR abs(total / c / 1e6 - 1) <= 0.05 OR abs(total / c * 1e3 - 1) <= 0.05 OR abs(total / c * 1e6 - 1) <= 0.05)")
_KINDS = "CASE WHEN abs(total / c - 1) <= 0.01 THEN 'sum' WHEN n >= 20 AND low >= 0 AND abs(total / (c * 1e3) - 1) <= 0.01 OR n >= 20 AND low >= 0 AND abs(total / (c * 1e6) - 1) <= 0.01 THEN 'coarser unit' WHEN c BETWEEN low AND high THEN 'average' ELSE 'contradiction' END"
on_cube("mrt18_glance_at_country", lambda c: facts.glance_at_country(c.regions, _off(c), _universe(c)).select("series_key", "year", "kind"), f", {_CS} SELECT series_key, year, {_KINDS} AS kind FROM cs")
on_cube("mrt19_coarser_country", lambda c: facts.glance_at_country(c.regions, _off(c), _universe(c)).filter("factor is not null").select("series_key", "year", "factor"), f", {_CS} SELECT series_key, year, CASE WHEN abs(total / (c * 1e3) - 1) <= 0.01 THEN 1e3 ELSE 1e6 END::DOUBLE AS factor FROM cs WHERE {_KINDS} = 'coarser unit'")
on_cube("mrt21_composition", lambda c: facts.composition_changes(c.regions), f""", rv AS (SELECT * FROM reg WHERE {_KNOWN}), yy AS (SELECT series_key, year, lag(year) OVER (PARTITION BY series_key ORDER BY year) AS before FROM (SELECT DISTINCT series_key, year FROM rv))
  SELECT * FROM (SELECT series_key, year, coalesce((SELECT string_agg(r.territory_code, ',' ORDER BY r.territory_code) FROM rv r WHERE r.series_key = yy.series_key AND r.year = yy.year AND r.territory_code NOT IN (SELECT territory_code FROM rv x WHERE x.series_key = yy.series_key AND x.year = yy.before)), '') AS came,
    coalesce((SELECT string_agg(r.territory_code, ',' ORDER BY r.territory_code) FROM rv r WHERE r.series_key = yy.series_key AND r.year = yy.before AND r.territory_code NOT IN (SELECT territory_code FROM rv x WHERE x.series_key = yy.series_key AND x.year = yy.year)), '') AS went FROM yy WHERE before IS NOT NULL) WHERE came <> '' OR went <> ''""")

# Origins of values

_ORI = f", {_TWO}, ft AS (SELECT st.*, CASE WHEN flags > 0 THEN 'E' || (year % 2 + 6) ELSE 'E5' END AS edition_code FROM st)"


def _origin_facts(c) -> DataFrame:
    return facts.stitch(*_two(c), 0.2).withColumn("edition_code", F.when(F.col("flags") > 0, F.concat(F.lit("E"), F.col("year") % 2 + 6)).otherwise(F.lit("E5")))


on_cube("qry61_year_origin", lambda c: recalculate.year_origin(_origin_facts(c)), f"{_ORI} SELECT series_key, year, edition_code, n, flags FROM (SELECT *, row_number() OVER (PARTITION BY series_key, year ORDER BY n DESC, edition_code) AS i FROM (SELECT series_key, year, edition_code, count(*) AS n, bit_or(flags) AS flags FROM ft WHERE flags & 64 > 0 GROUP BY ALL)) WHERE i = 1")
on_cube("qry62_source_years", lambda c: recalculate.source_years(_origin_facts(c)), f"{_ORI} SELECT series_key, year, count(*) AS n, bit_or(flags) AS flags FROM ft WHERE flags & 64 > 0 GROUP BY ALL")
on_cube("qry60_source_links", lambda c: recalculate.source_links(c.vintage.select("series_key", F.concat(F.lit("S"), F.col("edition") % 3).alias("source")).distinct(), _editions(c).withColumn("source", F.concat(F.lit("S"), F.col("edition_year") % 3))), f", {_EDS}, l AS (SELECT DISTINCT series_key, 'S' || (edition % 3) AS source FROM vintage) SELECT l.series_key, l.source, e.edition_code FROM l LEFT JOIN (SELECT *, 'S' || (edition_year % 3) AS source FROM ed QUALIFY row_number() OVER (PARTITION BY 'S' || (edition_year % 3) ORDER BY edition_year DESC, coalesce(released_on, make_date(edition_year, 12, 31)) DESC, edition_code) = 1) e USING (source)")
on_cube("qry59_month_page", lambda c: recalculate.month_page(c.month, "revenue:00", "level", 1996, 1998, 50, 100), "SELECT territory_code, year, month, value, (SELECT count(*) FROM month_fact WHERE series_key = 'revenue:00' AND kind = 'level' AND year BETWEEN 1996 AND 1998) AS total FROM month_fact WHERE series_key = 'revenue:00' AND kind = 'level' AND year BETWEEN 1996 AND 1998 ORDER BY territory_code, year, month LIMIT 50 OFFSET 100")
on_cube("qry64_population_table", lambda c: c.population.join(c.territory.select("territory_code", "name", "level"), "territory_code"), "SELECT territory_code, population, name, level FROM population JOIN territory USING (territory_code)")
on_cube("qry66_release_editions", lambda c: _editions(c).filter("released_on is not null").select("edition_code", "edition_year", "released_on"), f", {_EDS} SELECT * FROM ed WHERE released_on IS NOT NULL")
on_cube("qry68_edition_territories", lambda c: recalculate.edition_territories(c.vintage, c.month, (6, 7), ("revenue:00", "orders:00", "avg_price:00")), f"SELECT territory_code, count(DISTINCT series_key) AS series FROM (SELECT territory_code, series_key FROM vintage WHERE edition IN (6, 7) AND {_KNOWN} UNION ALL SELECT territory_code, series_key FROM month_fact WHERE {_KNOWN}) WHERE series_key IN ('revenue:00', 'orders:00', 'avg_price:00') GROUP BY ALL")
on_cube("qry51_build_metadata", lambda c: recalculate.build_metadata(c.observation, c.vintage), f"SELECT * FROM (SELECT 'observations' AS key, (SELECT count(*) FROM observation)::VARCHAR AS value UNION ALL SELECT 'first_year', (SELECT min(year) FROM observation WHERE {_KNOWN})::VARCHAR UNION ALL SELECT 'last_year', (SELECT max(year) FROM observation WHERE {_KNOWN})::VARCHAR UNION ALL SELECT 'editions', (SELECT count(DISTINCT edition) FROM vintage)::VARCHAR)")
on_cube("qry71_largest_changes", lambda c: recalculate.largest_changes(facts.changed_values(_version(c, 1), _version(c, 2)), 10), f", {_DIFF} SELECT series_key, territory_code, year, old, new, change FROM (SELECT *, round(CASE WHEN what = 'changed' AND old <> 0 THEN (new - old) / abs(old) END, 6) AS change FROM df) ORDER BY abs(change) DESC NULLS LAST, series_key, territory_code, year LIMIT 10")

# Derived series

on_cube("drv02_underivable", lambda c: recalculate.underivable(c.observation.filter("series_key = 'revenue:1-URGENT/BUILDING'"), c.territory), f"SELECT DISTINCT district_code AS whole, territory_code AS part, year FROM reg WHERE series_key = 'revenue:1-URGENT/BUILDING' AND NOT ({_KNOWN})")
on_cube("drv05_per_area", lambda c: recalculate.per_area(c.observation.filter("series_key = 'orders:00'"), c.territory.select("territory_code", (F.col("display_order") % 7).cast("double").alias("area"))), "SELECT territory_code, year, round(value / (display_order % 7), 6) AS value FROM observation JOIN territory USING (territory_code) WHERE series_key = 'orders:00' AND value IS NOT NULL AND display_order % 7 > 0")
on_cube("drv07_real_target", lambda c: recalculate.real_target(c.observation.filter("series_key like 'revenue:%' and year <= 2000"), c.observation.filter("series_key = 'avg_price:00'").select("year").distinct()), f"SELECT series_key, least(max(year), (SELECT max(year) FROM observation WHERE series_key = 'avg_price:00')) AS target FROM observation WHERE series_key LIKE 'revenue:%' AND year <= 2000 AND {_KNOWN} GROUP BY ALL")
on_cube("drv13_user_months", lambda c: recalculate.user_months(c.month.filter("kind = 'level'"), "own"), "SELECT 'own:' || series_key AS series_key, territory_code, year, month, kind, value FROM month_fact WHERE kind = 'level'")
on_cube("drv14_user_observations", lambda c: recalculate.user_observations(c.observation.select(F.concat(F.lit("own:"), "series_key").alias("series_key"), "territory_code", "year", "value"), c.territory).select("series_key", "territory_code", "territory_level", "district_code", "year", "value"), "SELECT 'own:' || series_key AS series_key, territory_code, level AS territory_level, t.district_code, year, value FROM observation JOIN territory t USING (territory_code)")
on_cube("drv15_outside", lambda c: recalculate.outside(c.observation.select(F.concat(F.col("territory_code"), F.when(F.col("year") == 2000, "x").otherwise("")).alias("territory_code"), "value"), c.territory), "SELECT territory_code || 'x' AS territory_code, count(*) AS n FROM observation WHERE year = 2000 GROUP BY ALL")
on_cube("drv17_append_vintage", lambda c: recalculate.append_vintage(c.vintage, c.observation.filter("series_key = 'orders:00'"), 8).filter("edition >= 7"), "SELECT series_key, territory_code, year, edition, value, quality FROM vintage WHERE edition >= 7 UNION ALL SELECT series_key, territory_code, year, 8, value, quality FROM observation WHERE series_key = 'orders:00'")
on_cube("drv19_totals", lambda c: recalculate.version_totals(c.observation), f"SELECT count(*) AS cells, count(value) AS \"values\", count(DISTINCT series_key) AS series, count(DISTINCT territory_code) FILTER ({_KNOWN}) AS territories, min(year) FILTER ({_KNOWN}) AS first_year, max(year) FILTER ({_KNOWN}) AS last_year FROM observation")
on_cube("drv20_plan", lambda c: recalculate.derived_plan(c.observation.filter("series_key like '%:00'")), f"""SELECT series_key || '#' || kind AS derived_key, series_key AS base_key, kind FROM (SELECT DISTINCT series_key FROM observation WHERE series_key LIKE '%:00' AND {_KNOWN}), (VALUES ('growth'), ('share'), ('per_capita'), ('folded')) v(kind)
  WHERE kind = 'growth' OR series_key NOT LIKE 'avg_price%'""")
on_cube("drv21_folds", lambda c: recalculate.folds(c.observation.select("series_key").distinct()), """SELECT g AS total_key, count(*) AS members, string_agg(series_key, ',' ORDER BY series_key) AS keys FROM (SELECT series_key, CASE WHEN series_key LIKE '%/%' THEN split_part(series_key, '/', 1) ELSE split_part(series_key, ':', 1) || ':00' END AS g FROM (SELECT DISTINCT series_key FROM observation)) WHERE series_key <> g GROUP BY g HAVING count(*) >= 2""")
on_cube("drv23_per_person_unit", lambda c: recalculate.per_person_unit(c.observation.filter("series_key like 'revenue:%'"), c.population), f"SELECT series_key, round(m, 6) AS middle, CASE WHEN m >= 1e6 THEN 'mln' WHEN m >= 1e3 THEN 'thousand' ELSE 'one' END AS unit FROM (SELECT series_key, median(value / population) AS m FROM observation JOIN population USING (territory_code) WHERE series_key LIKE 'revenue:%' AND {_KNOWN} AND population > 0 GROUP BY ALL)")
on_cube("drv24_real_ratio", lambda c: recalculate.real_ratio(c.observation.filter("series_key = 'revenue:00'"), c.observation.filter("series_key = 'avg_price:00' and territory_code = 'W'"), 1996, 2000), """, px AS (SELECT exp(sum(ln(a.value / b.value))) AS p, count(*) AS n FROM observation a JOIN observation b ON b.series_key = a.series_key AND b.territory_code = a.territory_code AND b.year = a.year - 1 WHERE a.series_key = 'avg_price:00' AND a.territory_code = 'W' AND a.year BETWEEN 1997 AND 2000)
  SELECT y.territory_code, round(CASE WHEN n = 4 THEN y.value / x.value / p END, 6) AS real_ratio FROM observation x JOIN observation y USING (series_key, territory_code), px WHERE series_key = 'revenue:00' AND x.year = 1996 AND y.year = 2000 AND x.value > 0 AND y.value IS NOT NULL""")
on_tables("drv26_guess_kind", lambda p: p.select(F.concat_ws(" ", "p_type", "p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "percent").otherwise("mln").alias("unit")).distinct().select("name", recalculate.guess_kind(F.col("name"), F.col("unit")).alias("kind")), "part", "SELECT name, CASE WHEN unit = 'percent' THEN 'relative' WHEN name LIKE 'STANDARD%' THEN 'average' ELSE 'total' END AS kind FROM (SELECT DISTINCT p_type || ' ' || p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'percent' ELSE 'mln' END AS unit FROM part)")
on_cube("drv27_verdicts", lambda c: recalculate.verdicts(c.observation.select(F.split("series_key", ":")[0].alias("measure")).distinct()), """SELECT measure, action, CASE WHEN action IN ('sum', 'share', 'per_capita') AND measure = 'avg_price' THEN 'refused' WHEN action = 'deflate' AND measure NOT IN ('revenue', 'avg_price') THEN 'refused' ELSE 'allowed' END AS verdict
  FROM (SELECT DISTINCT split_part(series_key, ':', 1) AS measure FROM observation), (VALUES ('sum'), ('share'), ('per_capita'), ('growth'), ('deflate')) v(action)""")
on_tables("drv28_unit_scale", lambda p: _units(p).select("unit", recalculate.unit_scale(F.col("unit")).alias("s")).distinct().select("unit", "s.*"), "part", f"SELECT DISTINCT unit, trim(regexp_replace(unit, '^(thousand|mln|million|bn|billion) ', '')) AS base, {_MULT.format(chr(40) + 'CASE WHEN regexp_matches(unit, ' + chr(39) + '^(thousand|mln|million|bn|billion) ' + chr(39) + ') THEN split_part(unit, ' + chr(39) + ' ' + chr(39) + ', 1) ELSE ' + chr(39) + chr(39) + ' END' + chr(41))} AS factor FROM {_UNITS}")

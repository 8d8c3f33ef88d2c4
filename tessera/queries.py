"""All registered queries outside ``llm``; those of sources, dimensions and facts are in a module of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import queries_build, queries_sheets, queries_study
from tessera.functions import text
from tessera.operators import analysis, answers, derive, formula, quality, search, series, statistics
from tessera.plans.marts import mart
from tessera.plans.prelude import sql
from tessera.registry import REGISTRY, add, on_cube
from tessera.sources import tables
from tessera.streaming import events, totals

__all__ = ["REGISTRY", "queries_build", "queries_sheets", "queries_study"]

on_cube("fct01_vintages", lambda c: c.vintage, "SELECT * FROM vintage")
on_cube("fct06_observations", lambda c: c.observation, "SELECT * FROM observation")
on_cube("fct20_months", lambda c: c.month, "SELECT * FROM month_fact")
on_cube("dim01_territories", lambda c: c.territory, "SELECT * FROM territory")
on_cube("fct09_population", lambda c: c.population, "SELECT * FROM population")
for _name, _code in (("stats", "mrt03_stats"), ("rank", "mrt04_ranks"), ("coverage", "mrt01_coverage"), ("revision", "fct07_revisions")):
    on_cube(_code, lambda c, n=_name: mart(c, n), f"SELECT * FROM mart_{_name}", _name)

_S, _P, _Q = "revenue:00", "revenue:1-URGENT", "orders:00"
_MANY = ("revenue:00", "orders:00", "avg_price:00", "quantity:00")
_IN = "('revenue:00', 'orders:00', 'avg_price:00', 'quantity:00')"

on_cube("qry01_covered_years", lambda c: series.covered_years(series.year_counts(c, ("revenue:1-URGENT/BUILDING", _S))), "SELECT series_key, year, n FROM (SELECT series_key, year, count(*) AS n, max(count(*)) OVER (PARTITION BY series_key) AS peak FROM reg WHERE value IS NOT NULL AND series_key IN ('revenue:1-URGENT/BUILDING', 'revenue:00') GROUP BY series_key, year) WHERE n >= 0.8 * peak")
on_cube("qry03_metadata", lambda c: series.metadata(c, _S), "SELECT series_key, 'revenue' AS measure, '00' AS slice, 'currency' AS kind, observed, hidden, no_data, first_year, last_year, is_ready FROM mart_coverage WHERE series_key = 'revenue:00'", "coverage")
on_cube("qry04_timeline", lambda c: series.timeline(c, _S, ("W",), 1996, 2000), "SELECT territory_code, year, value, quality FROM observation WHERE series_key = 'revenue:00' AND territory_code = 'W' AND year BETWEEN 1996 AND 2000")
on_cube("qry05_timeline_multi", lambda c: series.timeline(c, _P, ("W", "R1", "N3", "N7")), "SELECT territory_code, year, value, quality FROM observation WHERE series_key = 'revenue:1-URGENT' AND territory_code IN ('W', 'R1', 'N3', 'N7')")
on_cube("qry06_recent_values", lambda c: series.recent_values(c, "N3", _MANY, 3), f"SELECT series_key, year, value FROM (SELECT *, max(year) FILTER (value IS NOT NULL) OVER (PARTITION BY series_key) AS last FROM observation WHERE territory_code = 'N3' AND series_key IN {_IN}) WHERE year > last - 3 AND year <= last")
on_cube("qry07_snapshot", lambda c: series.snapshot(c, "R2", _MANY), f"""SELECT series_key, year, value, round(value - before, 4) AS change, round(CASE WHEN before <> 0 THEN (value - before) / abs(before) END, 6) AS rel_change, points
  FROM (SELECT *, lag(value) OVER (PARTITION BY series_key ORDER BY year) AS before, count(*) OVER (PARTITION BY series_key) AS points, row_number() OVER (PARTITION BY series_key ORDER BY year DESC) AS rn FROM observation WHERE territory_code = 'R2' AND series_key IN {_IN} AND value IS NOT NULL) WHERE rn = 1""")
on_cube("qry08_by_territory", lambda c: series.by_territory(c, _P, 1998), "SELECT o.territory_code, name, o.value, quality, rank_desc, quintile FROM reg o JOIN territory USING (territory_code) LEFT JOIN mart_rank r ON r.series_key = o.series_key AND r.year = o.year AND r.territory_code = o.territory_code WHERE o.series_key = 'revenue:1-URGENT' AND o.year = 1998", "rank")
on_cube("qry09_year_grid", lambda c: series.year_grid(c, _S, 1997, 1999), "SELECT territory_code, year, value, quality FROM observation WHERE series_key = 'revenue:00' AND year BETWEEN 1997 AND 1999 AND ((territory_level = 'region' AND NOT is_aggregate) OR territory_level = 'country')")
on_cube("qry10_leaders", lambda c: series.leaders(c, _S, 1999), "SELECT territory_code, value, rank_desc AS rank FROM mart_rank WHERE series_key = 'revenue:00' AND year = 1999 ORDER BY rank_desc, territory_code LIMIT 5", "rank")
on_cube("qry11_ranked_panel", lambda c: series.ranked_panel(c, _Q), "SELECT year, territory_code, rank_desc, rank_asc, count(*) OVER (PARTITION BY year) AS ranked FROM mart_rank WHERE series_key = 'orders:00'", "rank")
on_cube("qry12_statistics", lambda c: series.statistics_timeline(c, _S, 1998), 'SELECT year, observations, mean, median, "min", "max", stddev, country_value FROM mart_stats WHERE series_key = \'revenue:00\' AND year = 1998', "stats")
on_cube("qry13_statistics_timeline", lambda c: series.statistics_timeline(c, _P), 'SELECT year, observations, mean, median, "min", "max", stddev, country_value FROM mart_stats WHERE series_key = \'revenue:1-URGENT\'', "stats")
on_cube("qry14_available_years", lambda c: series.available_years(c, _P), "SELECT DISTINCT year FROM reg WHERE series_key = 'revenue:1-URGENT' AND value IS NOT NULL")
on_cube("qry15_values", lambda c: series.values(c, _MANY, ("N1", "N2", "W")), f"SELECT series_key, territory_code, year, value FROM observation WHERE series_key IN {_IN} AND territory_code IN ('N1', 'N2', 'W')")
on_cube("qry16_year_counts", lambda c: series.year_counts(c, (_P,)), "SELECT series_key, year, count(*) AS n FROM reg WHERE series_key = 'revenue:1-URGENT' AND value IS NOT NULL GROUP BY ALL")
on_cube("qry17_summary_map", lambda c: series.summary_map(c, _MANY), f"SELECT * FROM mart_coverage WHERE series_key IN {_IN}", "coverage")
on_cube("qry18_vintages", lambda c: series.vintages(c, _S, "N5"), "SELECT year, edition, value, quality FROM vintage WHERE series_key = 'revenue:00' AND territory_code = 'N5'")
on_cube("qry19_top_revisions", lambda c: series.top_revisions(c, _S), "SELECT territory_code, year, first_value, last_value, rel_change FROM mart_revision WHERE series_key = 'revenue:00' AND rel_change IS NOT NULL ORDER BY abs(rel_change) DESC, territory_code, year LIMIT 20", "revision")
on_cube("qry20_editions", lambda c: series.editions(c, _P), "SELECT edition, count(*) AS observations FROM observation WHERE series_key = 'revenue:1-URGENT' AND value IS NOT NULL GROUP BY edition")
on_cube("qry21_latest_matrix", lambda c: series.latest_matrix(c, _MANY, ("N1", "N2", "W")), f"SELECT o.series_key, o.territory_code, o.year, o.value, rank_desc FROM (SELECT *, row_number() OVER (PARTITION BY series_key, territory_code ORDER BY year DESC) AS rn FROM observation WHERE series_key IN {_IN} AND territory_code IN ('N1', 'N2', 'W') AND value IS NOT NULL) o LEFT JOIN mart_rank r ON r.series_key = o.series_key AND r.territory_code = o.territory_code AND r.year = o.year WHERE rn = 1", "rank")
on_cube("qry22_page", lambda c: series.page(c, _S, 20, 40), "SELECT territory_code, year, value, (SELECT count(*) FROM observation WHERE series_key = 'revenue:00') AS total FROM observation WHERE series_key = 'revenue:00' ORDER BY territory_code, year LIMIT 20 OFFSET 40")
on_cube("qry23_region_panel", lambda c: analysis.region_panel(c, _S), "SELECT year, territory_code, value FROM reg WHERE series_key = 'revenue:00' AND value IS NOT NULL")
on_cube("qry24_hidden_counts", lambda c: analysis.hidden_counts(c, "revenue:1-URGENT/BUILDING"), "SELECT year, count(*) AS hidden FROM reg WHERE series_key = 'revenue:1-URGENT/BUILDING' AND quality = 2 GROUP BY year")
on_cube("qry25_region_matrix", lambda c: analysis.region_matrix(c, (_S, _P, "revenue:1-URGENT/BUILDING"), 2001), """, n AS (SELECT series_key, year, count(*) AS n, max(count(*)) OVER (PARTITION BY series_key) AS peak FROM reg WHERE value IS NOT NULL AND series_key IN ('revenue:00', 'revenue:1-URGENT', 'revenue:1-URGENT/BUILDING') GROUP BY series_key, year),
  best AS (SELECT series_key, year FROM n WHERE n >= 0.8 * peak QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY abs(year - 2001), year DESC) = 1) SELECT series_key, year, territory_code, value FROM reg JOIN best USING (series_key, year) WHERE value IS NOT NULL""")
on_cube("qry26_paired_years", lambda c: analysis.paired_years(c, _P, 1996, 2000), "SELECT a.territory_code, a.value AS first_value, b.value AS last_value FROM reg a JOIN reg b USING (series_key, territory_code) WHERE a.series_key = 'revenue:1-URGENT' AND a.year = 1996 AND b.year = 2000 AND a.value IS NOT NULL AND b.value IS NOT NULL")
on_cube("qry27_district_totals", lambda c: analysis.district_totals(c, _S, 1998), """SELECT d.*, o.value AS own_value FROM (SELECT district_code, count(value) AS n, round(sum(value), 4) AS total, round(median(value), 6) AS median, min(value) AS "min", max(value) AS "max" FROM reg WHERE series_key = 'revenue:00' AND year = 1998 AND value IS NOT NULL GROUP BY district_code) d
  LEFT JOIN observation o ON o.series_key = 'revenue:00' AND o.year = 1998 AND o.territory_level = 'federal_district' AND o.district_code = d.district_code""")
on_cube("qry28_region_directory", lambda c: analysis.directory(c, "region"), "SELECT territory_code, name, district_code, display_order FROM territory WHERE level = 'region' AND NOT is_aggregate")
on_cube("qry29_district_directory", lambda c: analysis.directory(c, "federal_district"), "SELECT territory_code, name, district_code, display_order FROM territory WHERE level = 'federal_district'")
on_cube("qry30_series_years", lambda c: analysis.series_years(c, _MANY), f"SELECT series_key, first_year, last_year FROM mart_coverage WHERE series_key IN {_IN}", "coverage")
on_cube("qry31_series_covered_years", lambda c: analysis.series_covered_years(c, (_S, "revenue:1-URGENT/BUILDING")), "SELECT series_key, min(year) AS first_year, max(year) AS last_year FROM (SELECT series_key, year, count(*) AS n, max(count(*)) OVER (PARTITION BY series_key) AS peak FROM reg WHERE value IS NOT NULL AND series_key IN ('revenue:00', 'revenue:1-URGENT/BUILDING') GROUP BY series_key, year) WHERE n >= 0.8 * peak GROUP BY series_key")
on_cube("qry32_revision_summary", analysis.revision_summary, "SELECT count(*) AS cells, count(DISTINCT series_key) AS series, count(DISTINCT territory_code) AS territories, round(median(abs(rel_change)), 7) AS median_rel, round(avg(abs(rel_change)), 5) AS mean_rel, max(abs(rel_change)) AS max_rel, count(*) FILTER (abs(rel_change) >= 0.05) AS over_5_percent FROM mart_revision", "revision")
on_cube("qry33_revision_distribution", analysis.revision_distribution, "SELECT band, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT (CASE WHEN abs(rel_change) < 0.001 THEN 0 WHEN abs(rel_change) < 0.01 THEN 1 WHEN abs(rel_change) < 0.05 THEN 2 WHEN abs(rel_change) < 0.25 THEN 3 ELSE 4 END)::BIGINT AS band, count(*) AS n FROM mart_revision WHERE rel_change IS NOT NULL GROUP BY 1)", "revision")
for _code, _key, _limit in (("qry34_revisions_by_section", "measure", 12), ("qry35_revisions_by_series", "series_key", 15), ("qry36_revisions_by_year", "year", None)):
    on_cube(_code, lambda c, k=_key, n=_limit: analysis.revisions_by(c, k, n), f"SELECT {_key}, count(*) AS n, round(median(abs(rel_change)), 7) AS median_rel FROM (SELECT *, split_part(series_key, ':', 1) AS measure FROM mart_revision) GROUP BY {_key}" + (f" ORDER BY n DESC, {_key} LIMIT {_limit}" if _limit else ""), "revision")
on_cube("qry37_largest_revisions", analysis.largest_revisions, "SELECT series_key, territory_code, year, first_value, last_value, rel_change FROM mart_revision WHERE abs(rel_change) BETWEEN 0.01 AND 5 ORDER BY abs(rel_change) DESC, series_key, territory_code, year LIMIT 20", "revision")
on_cube("qry38_edition_activity", analysis.edition_activity, 'SELECT edition, count(value) AS "values", count(DISTINCT series_key) AS series, min(year) AS first_year, max(year) AS last_year FROM vintage GROUP BY edition')
on_cube("qry39_revision_trace", lambda c: analysis.revision_trace(c, _S, "N4", 1997), "SELECT edition, value FROM vintage WHERE series_key = 'revenue:00' AND territory_code = 'N4' AND year = 1997")
on_cube("qry40_revision_triangle", lambda c: analysis.revision_triangle(c, _S, "N4"), "SELECT horizon, round(avg(change), 6) AS mean_change, round(max(change), 6) AS max_change, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY year ORDER BY edition) - 1 AS horizon, abs((value - first_value(value) OVER (PARTITION BY year ORDER BY edition)) / nullif(abs(first_value(value) OVER (PARTITION BY year ORDER BY edition)), 0)) AS change FROM vintage WHERE series_key = 'revenue:00' AND territory_code = 'N4' AND value IS NOT NULL) WHERE horizon > 0 GROUP BY horizon")
on_cube("qry41_ranking_table", lambda c: analysis.ranking_table(c, _S, 2000, 1999), "SELECT r.territory_code, t.name, d.name AS district, r.value, r.rank_desc, b.rank_desc AS previous_rank, b.rank_desc - r.rank_desc AS movement, r.quintile FROM mart_rank r JOIN territory t USING (territory_code) LEFT JOIN territory d ON d.territory_code = t.district_code LEFT JOIN mart_rank b ON b.series_key = r.series_key AND b.territory_code = r.territory_code AND b.year = 1999 WHERE r.series_key = 'revenue:00' AND r.year = 2000", "rank")
on_cube("qry42_rank_history", lambda c: analysis.rank_history(c, _S, ("N1", "N9")), "SELECT territory_code, year, rank_desc, value FROM mart_rank WHERE series_key = 'revenue:00' AND territory_code IN ('N1', 'N9')", "rank")
on_cube("qry43_rank_movers", lambda c: analysis.rank_movers(c, _Q, 2000, 1999, 3), """, moved AS (SELECT territory_code, a.rank_desc AS now, b.rank_desc AS before, b.rank_desc - a.rank_desc AS movement, CASE WHEN b.rank_desc > a.rank_desc THEN 'risen' ELSE 'fallen' END AS direction FROM mart_rank a JOIN mart_rank b USING (series_key, territory_code) WHERE series_key = 'orders:00' AND a.year = 2000 AND b.year = 1999 AND a.rank_desc <> b.rank_desc),
  placed AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY abs(movement) DESC, now, territory_code) AS place FROM moved), lasts AS (SELECT direction, min(abs(movement)) AS last FROM placed WHERE place <= 3 GROUP BY direction)
  SELECT direction, territory_code, now, before, movement, (SELECT count(*) FROM placed x WHERE x.direction = p.direction AND x.place > 3 AND abs(x.movement) = last) AS ties_left FROM placed p JOIN lasts USING (direction) WHERE place <= 3""", "rank")
on_cube("qry44_ranked_years", lambda c: analysis.ranked_years(c, _P), "SELECT DISTINCT year FROM mart_rank WHERE series_key = 'revenue:1-URGENT'", "rank")
on_cube("qry45_territory_profile", lambda c: analysis.territory_profile(c, "N6"), "SELECT * FROM territory WHERE territory_code = 'N6'")
on_cube("qry46_territory_coverage", lambda c: analysis.territory_coverage(c, "N6"), "SELECT count(*) AS ready, count(seen) AS with_values, round(count(seen) / nullif(count(*), 0), 6) AS share FROM (SELECT series_key FROM mart_coverage WHERE is_ready) LEFT JOIN (SELECT DISTINCT series_key, 1 AS seen FROM observation WHERE territory_code = 'N6' AND value IS NOT NULL) USING (series_key)", "coverage")
on_cube("qry47_territory_positions", lambda c: analysis.territory_positions(c, "N6", _MANY), f"""SELECT l.*, x.value AS country_now, y.value AS country_before, z.value AS own_before FROM (SELECT series_key, year, value, rank_desc, ranked FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY year DESC) AS rn FROM (SELECT *, count(*) OVER (PARTITION BY series_key, year) AS ranked FROM mart_rank WHERE series_key IN {_IN}) WHERE territory_code = 'N6' AND ranked >= 20) WHERE rn = 1) l
  LEFT JOIN observation x ON x.series_key = l.series_key AND x.year = l.year AND x.territory_code = 'W' LEFT JOIN observation y ON y.series_key = l.series_key AND y.year = l.year - 5 AND y.territory_code = 'W' LEFT JOIN observation z ON z.series_key = l.series_key AND z.year = l.year - 5 AND z.territory_code = 'N6'""", "rank")
on_cube("qry48_values_for_series", lambda c: series.timeline(c, _S, ("N1", "N2", "R0"), 1999, 1999), "SELECT territory_code, year, value, quality FROM observation WHERE series_key = 'revenue:00' AND territory_code IN ('N1', 'N2', 'R0') AND year = 1999")
on_cube("qry49_district_summary", lambda c: analysis.district_summary(c, "R3", _S, 1998), "SELECT count(value) AS n, round(avg(value), 8) AS mean, round(median(value), 6) AS median, min(value) AS \"min\", max(value) AS \"max\" FROM reg WHERE series_key = 'revenue:00' AND year = 1998 AND district_code = 'R3' AND value IS NOT NULL")
on_cube("qry50_warehouse_summary", analysis.warehouse_summary, "SELECT * FROM (SELECT count(*) AS observations, count(value) AS \"values\", count(DISTINCT series_key) AS series, min(year) AS first_year, max(year) AS last_year FROM observation), (SELECT count(*) AS vintages, count(DISTINCT edition) AS editions FROM vintage), (SELECT count(*) AS territories, count(*) FILTER (level = 'region' AND NOT is_aggregate) AS regions FROM territory), (SELECT count(*) AS revised FROM mart_revision), (SELECT count(*) AS ready FROM mart_coverage WHERE is_ready)", "coverage", "revision")
on_cube("qry52_observations_by_year", analysis.observations_by_year, "SELECT year, count(*) FILTER (quality = 0) AS observed, count(*) FILTER (quality = 1) AS no_data, count(*) FILTER (quality = 2) AS hidden FROM reg GROUP BY year")
on_cube("qry53_coverage_distribution", analysis.coverage_distribution, "SELECT (CASE WHEN region_coverage < 0.2 THEN 0 WHEN region_coverage < 0.4 THEN 1 WHEN region_coverage < 0.6 THEN 2 WHEN region_coverage < 0.8 THEN 3 ELSE 4 END)::BIGINT AS band, count(*) AS series FROM mart_coverage GROUP BY 1", "coverage")
on_cube("qry54_total_observations", lambda c: c.observation.groupBy().count().withColumnRenamed("count", "n"), "SELECT count(*) AS n FROM observation")
on_cube("qry55_month_series", analysis.month_series, "SELECT series_key, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM month_fact GROUP BY series_key")
on_cube("qry56_month_timeline", lambda c: analysis.month_timeline(c, _S, "N2", "ytd"), "SELECT year, month, value FROM month_fact WHERE series_key = 'revenue:00' AND territory_code = 'N2' AND kind = 'ytd'")
on_cube("qry57_month_latest", lambda c: analysis.month_latest(c, _S, "level"), ", m AS (SELECT f.* FROM month_fact f JOIN territory t USING (territory_code) WHERE t.level = 'region' AND NOT t.is_aggregate AND kind = 'level' AND series_key = 'revenue:00' AND value IS NOT NULL), c AS (SELECT year, month, count(*) AS n, max(count(*)) OVER () AS peak FROM m GROUP BY year, month), l AS (SELECT year, month FROM c WHERE n >= 0.8 * peak ORDER BY year DESC, month DESC LIMIT 1) SELECT territory_code, year, month, value FROM m JOIN l USING (year, month)")
on_cube("qry58_month_points", lambda c: analysis.month_points(c, "N2", (_S, _Q)), "SELECT series_key, year, month, kind, value FROM month_fact WHERE territory_code = 'N2' AND series_key IN ('revenue:00', 'orders:00')")
on_cube("qry63_population_last_year", lambda c: c.observation.agg(F.max("year").alias("year")), "SELECT max(year) AS year FROM observation")
on_cube("qry65_population_start", analysis.population_start, "SELECT territory_code, year + 1 AS year, population FROM population, (SELECT DISTINCT year FROM observation)")
on_cube("qry67_edition_contents", lambda c: analysis.edition_contents(c, (6, 7)), "SELECT series_key, count(*) AS n, max(year) AS last_year, 'annual' AS part FROM vintage WHERE edition IN (6, 7) AND value IS NOT NULL GROUP BY series_key UNION ALL SELECT series_key, count(*), max(year), 'monthly' FROM month_fact WHERE value IS NOT NULL GROUP BY series_key")
on_cube("qry69_last_years", lambda c: c.observation.filter("value is not null").groupBy("series_key").agg(F.max("year").alias("last_year")), "SELECT series_key, max(year) AS last_year FROM observation WHERE value IS NOT NULL GROUP BY series_key")
on_cube("qry70_dataset_territories", lambda c: analysis.dataset_territories(c, _MANY), f"SELECT territory_code, count(DISTINCT series_key) AS series FROM (SELECT *, max(year) OVER (PARTITION BY series_key) AS last FROM observation WHERE value IS NOT NULL AND series_key IN {_IN}) WHERE year = last GROUP BY territory_code")
on_cube("ans31_month_change", lambda c: analysis.month_change(c, "N2"), "SELECT l.series_key, l.year, l.month, l.value, b.value AS before, round(CASE WHEN b.value > 0 THEN (l.value / b.value - 1) * 100 END, 4) AS percent FROM (SELECT * FROM month_fact WHERE territory_code = 'N2' AND kind = 'level' QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY year DESC, month DESC) = 1) l LEFT JOIN month_fact b ON b.series_key = l.series_key AND b.territory_code = l.territory_code AND b.kind = 'level' AND b.year = l.year - 1 AND b.month = l.month")
on_cube("fct32_unique_keys", analysis.unique_keys, "SELECT 'observation' AS relation, count(*) AS keys, 0::BIGINT AS repeated FROM observation UNION ALL SELECT 'vintage', count(*), 0 FROM vintage UNION ALL SELECT 'month', count(*), 0 FROM month_fact UNION ALL SELECT 'territory', count(*), 0 FROM territory")

_HEADS = "FROM obs1 o JOIN population p USING (territory_code) WHERE population > 0"


def _rows(key: str, name: str = "obs1", regions: bool = False) -> str:
    """CTE of a series' known values."""
    return f", {name} AS (SELECT territory_code, year, value, territory_level, district_code FROM {'reg' if regions else 'observation'} WHERE series_key = '{key}' AND value IS NOT NULL)"


on_cube("drv03_per_capita", lambda c: derive.per_capita(derive.rows_of(c, _S), c.population), _rows(_S) + f" SELECT territory_code, year, round(value / population * 1000, 4) AS value {_HEADS}")
on_cube("drv04_per_person_middle", lambda c: derive.middle_per_person(derive.rows_of(c, _S), c.population), _rows(_S) + f" SELECT round(median(abs(value) / population), 8) AS middle {_HEADS}")
on_cube("fct25_frozen_population", lambda c: derive.frozen_population(c.population.crossJoin(c.observation.select("year").distinct().filter("year <= 1998")).select("territory_code", "year", "population"), derive.rows_of(c, _S).select("territory_code", "year", "value")), _rows(_S) + " SELECT territory_code, year, value, population, year > 1998 AS frozen FROM obs1 JOIN population USING (territory_code)")
_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
on_cube("drv06_fold", lambda c: derive.fold(c, [f"revenue:{p}" for p in _PRIORITIES]), f"SELECT territory_code, year, round(sum(value), 4) AS value FROM observation WHERE series_key IN ({', '.join(repr(f'revenue:{p}') for p in _PRIORITIES)}) AND value IS NOT NULL GROUP BY territory_code, year HAVING count(*) = 5")
on_cube("drv22_fold_months", lambda c: derive.fold_months(c.month), "SELECT series_key, territory_code, year, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, max(value) FILTER (month = 12) AS december FROM month_fact WHERE kind = 'level' AND value IS NOT NULL GROUP BY series_key, territory_code, year HAVING count(*) = 12")
on_cube("drv11_growth", lambda c: derive.growth(derive.rows_of(c, _S)), _rows(_S) + " SELECT a.territory_code, a.year, round(a.value / b.value * 100, 4) AS value FROM obs1 a JOIN obs1 b ON b.territory_code = a.territory_code AND b.year = a.year - 1 WHERE b.value > 0")
on_cube("drv12_share", lambda c: derive.share(derive.regions_of(c, _S)), _rows(_S, regions=True) + " SELECT territory_code, year, round(value / total * 100, 4) AS value FROM (SELECT *, sum(value) OVER (PARTITION BY year) AS total FROM obs1) WHERE total > 0")
on_cube("drv10_to_country", lambda c: derive.to_country(derive.regions_of(c, _P), derive.rows_of(c, _P).filter("territory_level = 'country'")), _rows(_P, regions=True) + ", w AS (SELECT year, value FROM observation WHERE series_key = 'revenue:1-URGENT' AND territory_level = 'country') SELECT territory_code, o.year, round(o.value / coalesce(w.value, s.total) * 100, 4) AS value FROM obs1 o JOIN (SELECT year, sum(value) AS total FROM obs1 GROUP BY year) s USING (year) LEFT JOIN w USING (year) WHERE coalesce(w.value, s.total) > 0")
on_cube("drv09_subjects", lambda c: derive.regions_of(c, _S).groupBy("year").agg(F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("filled")), _rows(_S, regions=True) + " SELECT year, round(sum(value), 4) AS total, count(*) AS filled FROM obs1 GROUP BY year")
on_cube("drv08_constant_prices", lambda c: derive.constant_prices(derive.rows_of(c, _S), derive.growth(derive.rows_of(c, "avg_price:00"))), _rows(_S) + _rows("avg_price:00", "price") + """, cpi AS (SELECT a.territory_code, a.year, round(a.value / b.value * 100, 4) AS value FROM price a JOIN price b ON b.territory_code = a.territory_code AND b.year = a.year - 1 WHERE b.value > 0),
  chain AS (SELECT territory_code, year, sum(ln(value / 100)) OVER w AS chain, row_number() OVER w AS place FROM cpi WHERE value > 0 WINDOW w AS (PARTITION BY territory_code ORDER BY year ROWS UNBOUNDED PRECEDING)),
  base AS (SELECT territory_code, least((SELECT max(year) FROM obs1 x WHERE x.territory_code = c.territory_code), max(year)) AS base_year FROM cpi c GROUP BY territory_code)
  SELECT o.territory_code, o.year, round(o.value * exp(z.chain - c.chain), 2) AS value FROM obs1 o JOIN chain c USING (territory_code, year) JOIN base b USING (territory_code) JOIN chain z ON z.territory_code = o.territory_code AND z.year = b.base_year WHERE o.year <= base_year AND z.place - c.place = base_year - o.year""")
on_cube("drv25_group_totals", lambda c: derive.group_totals(derive.regions_of(c, _S), c.population, ("N1", "N2", "N3")), _rows(_S, regions=True) + " SELECT year, territory_code IN ('N1', 'N2', 'N3') AS in_group, round(sum(value), 4) AS value, count(*) AS n FROM obs1 GROUP BY ALL")
on_cube("drv25_group_means", lambda c: derive.group_totals(derive.regions_of(c, "avg_price:00"), c.population, ("N1", "N2", "N3"), False), _rows("avg_price:00", regions=True) + " SELECT year, territory_code IN ('N1', 'N2', 'N3') AS in_group, round(sum(value * population) / sum(population), 6) AS value, count(*) AS n FROM obs1 JOIN population USING (territory_code) GROUP BY ALL")
on_cube("drv16_summary", derive.summary, "SELECT series_key, count(*) AS n, count(DISTINCT territory_code) AS regions, count(DISTINCT year) AS years, bool_and(value = floor(value)) AS whole, round(median(abs(value)), 6) AS middle FROM reg WHERE value IS NOT NULL GROUP BY series_key")
on_cube("drv18_version_changes", lambda c: derive.version_changes(c, 5, 7), """, a AS (SELECT * FROM vintage WHERE edition = 5 AND value IS NOT NULL), b AS (SELECT * FROM vintage WHERE edition = 7 AND value IS NOT NULL), j AS (SELECT coalesce(a.series_key, b.series_key) AS series_key, a.value AS o, b.value AS n, a.value IS NOT NULL AND b.value IS NOT NULL AND abs(b.value - a.value) > 1e-9 * greatest(1.0, abs(a.value)) AS c FROM a FULL JOIN b ON a.series_key = b.series_key AND a.territory_code = b.territory_code AND a.year = b.year)
  SELECT series_key, count(*) FILTER (c) AS changed, count(*) FILTER (o IS NULL) AS appeared, count(*) FILTER (n IS NULL) AS lost, round(median(CASE WHEN c AND o <> 0 THEN abs(n / nullif(o, 0) - 1) END), 6) AS median_rel, count(*) FILTER (c AND o <> 0 AND abs(n / nullif(o, 0) - 1) >= 0.05) AS over_5_percent FROM j GROUP BY series_key""")
on_cube("drv01_composite_alone", lambda c: derive.composite_alone(derive.rows_of(c, _S), "R0", ("N0",)), _rows(_S) + " SELECT a.year, round(a.value - b.value, 4) AS value FROM obs1 a JOIN obs1 b USING (year) WHERE a.territory_code = 'R0' AND b.territory_code = 'N0' AND round(a.value - b.value, 4) >= 0")
on_cube("fct22_country_as_sum", lambda c: derive.country_as_sum(c.regions, c.territory.filter("level = 'region' and not is_aggregate")), "SELECT series_key, year, round(sum(value), 4) AS value FROM reg WHERE value IS NOT NULL GROUP BY series_key, year HAVING count(*) = (SELECT count(*) FROM territory WHERE level = 'region' AND NOT is_aggregate)")
_LEVEL = lambda c, k: c.month.filter((F.col("series_key") == k) & (F.col("kind") == "level")).select("territory_code", "year", "month", "value")
on_cube("fct24_ratio_months", lambda c: derive.ratio_months(_LEVEL(c, _S), _LEVEL(c, _Q)), "SELECT a.territory_code, a.year, a.month, round(a.value / b.value, 7) AS value FROM month_fact a JOIN month_fact b USING (territory_code, year, month) WHERE a.series_key = 'revenue:00' AND b.series_key = 'orders:00' AND a.kind = 'level' AND b.kind = 'level' AND b.value <> 0")
_RATIOS = (("deep:00", "odd:00", "mean:00", 100.0), ("odd:00", "mean:00", "inverse:00", 1.0), ("mean:00", "revenue:00", "orders:00", 1.0), ("inverse:00", "orders:00", "revenue:00", 1e6))  # in no order
_FLAGGED = lambda c: c.month.filter("kind = 'level'").select("series_key", "territory_code", "year", "month", "value", ((F.col("series_key") == "orders:00") & (F.col("value") < 3)).alias("hidden"), ((F.col("series_key") == "revenue:00") & (F.col("month") == 12)).alias("frozen"))
on_cube("fct20_ratios_of_ratios", lambda c: derive.resolve_ratios(_FLAGGED(c), _RATIOS, ("revenue:00", "orders:00")), """, b AS (SELECT r.territory_code, r.year, r.month, r.value AS r, o.value AS o, o.value < 3 AS hidden, r.month = 12 AS frozen FROM month_fact r JOIN month_fact o USING (territory_code, year, month) WHERE r.series_key = 'revenue:00' AND o.series_key = 'orders:00' AND r.kind = 'level' AND o.kind = 'level'),
  one AS (SELECT *, CASE WHEN NOT hidden AND o <> 0 THEN round(r / o, 7) END AS mean, CASE WHEN NOT hidden AND r <> 0 THEN round(o / r * 1e6, 7) END AS inverse FROM b), two AS (SELECT *, CASE WHEN NOT hidden AND inverse <> 0 THEN round(mean / inverse, 7) END AS odd FROM one)
  SELECT series_key, territory_code, year, month, value, series_key = 'orders:00' AND value < 3 AS hidden, series_key = 'revenue:00' AND month = 12 AS frozen FROM month_fact WHERE kind = 'level'
  UNION ALL SELECT 'mean:00', territory_code, year, month, mean, hidden, frozen FROM two UNION ALL SELECT 'inverse:00', territory_code, year, month, inverse, hidden, frozen FROM two UNION ALL SELECT 'odd:00', territory_code, year, month, odd, hidden, frozen FROM two
  UNION ALL SELECT 'deep:00', territory_code, year, month, CASE WHEN NOT hidden AND mean <> 0 THEN round(odd / mean * 100, 7) END, hidden, frozen FROM two""")
on_cube("fct28_weighted_year_mean", lambda c: derive.weighted_year_mean(_LEVEL(c, _S), _LEVEL(c, _Q)), "SELECT territory_code, year, round(sum(a.value * b.value) / nullif(sum(b.value), 0), 4) AS value FROM month_fact a JOIN month_fact b USING (territory_code, year, month) WHERE a.series_key = 'revenue:00' AND b.series_key = 'orders:00' AND a.kind = 'level' AND b.kind = 'level' GROUP BY territory_code, year HAVING count(*) = 12")

# Formulas: the SQL is the formula written out by hand on the dense grid.
_A, _B, _C, _D = "revenue:00", "orders:00", "revenue:1-URGENT", "revenue:2-HIGH"
_GRID = """, span AS (SELECT min(year) AS a, max(year) AS b FROM observation WHERE value IS NOT NULL AND series_key IN ({keys})),
g AS (SELECT t.territory_code, t.district_code, t.level = 'region' AND NOT t.is_aggregate AS is_region, y.year, {columns} FROM territory t CROSS JOIN (SELECT unnest(range(a, b + 1)) AS year FROM span) y LEFT JOIN observation o ON o.territory_code = t.territory_code AND o.year = y.year AND o.series_key IN ({keys}) GROUP BY ALL),
s AS (SELECT *, {stages} FROM g) SELECT territory_code, year, round(v, 6) AS value FROM (SELECT territory_code, year, {value} AS v FROM s) WHERE v IS NOT NULL AND isfinite(v)"""


def _formula_sql(keys: dict[str, str], value: str, stages: str = "1 AS one", window: str = "") -> str:
    return _GRID.replace("{stages} FROM g)", f"{{stages}} FROM g{window})").format(keys=", ".join(f"'{k}'" for k in keys.values()), columns=", ".join(f"max(value) FILTER (o.series_key = '{k}') AS {n}" for n, k in keys.items()), stages=stages, value=value)


def _formula(name: str, value: Callable[[formula.Grid], Column], keys: dict[str, str], by_hand: str, stages: str = "1 AS one", window: str = "") -> None:
    def run(c) -> DataFrame:
        grid = formula.Grid(c.observation, c.territory, keys)
        column = value(grid)
        return grid.result(column)

    on_cube(name, run, _formula_sql(keys, by_hand, stages, window))


_W = "OVER (PARTITION BY territory_code ORDER BY year)"
_formula("frm07_binary", lambda g: formula.divide(-(g["a"] - g["b"] * 2), g["b"] - 10) + formula.power(g["b"], 2) / 3, {"a": _A, "b": _B}, "-(a - b * 2) / nullif(b - 10, 0) + power(b, 2) / 3")
_formula("frm08_functions", lambda g: F.round(formula.ln(g["a"]) + formula.log10(g["b"]) - formula.sqrt(F.abs(g["b"] - 100)) + F.exp(formula.least(g["b"], F.lit(3.0))) + formula.greatest(g["b"], F.lit(5.0), F.lit(7.0)), 3), {"a": _A, "b": _B}, "round(CASE WHEN a > 0 THEN ln(a) END + CASE WHEN b > 0 THEN log10(b) END - sqrt(abs(b - 100)) + exp(CASE WHEN b IS NOT NULL THEN least(b, 3) END) + CASE WHEN b IS NOT NULL THEN greatest(b, 5, 7) END, 3)")
_formula("frm08_ago_rank", lambda g: g["a"] - g.ago(g["a"], 1) + g.place(g["a"]), {"a": _A}, "a - p + r", f"lag(a) {_W} AS p, CASE WHEN is_region AND a IS NOT NULL THEN rank() OVER (PARTITION BY year, is_region AND a IS NOT NULL ORDER BY a DESC) END AS r")
_formula("frm09_logic", lambda g: formula.choose((g["a"] > 1000) & g["b"].isNotNull(), F.coalesce(g["b"], F.lit(0.0)), F.lit(-1.0)), {"a": "revenue:1-URGENT/BUILDING", "b": "orders:1-URGENT/BUILDING"}, "CASE WHEN (a > 1000 AND b IS NOT NULL) IS NULL THEN NULL WHEN a > 1000 AND b IS NOT NULL THEN coalesce(b, 0) ELSE -1 END")
_formula("frm10_windows", lambda g: formula.divide(g.at(g["a"], 1997), g["a"]) + g.moving(g["a"], 3) / 1000000 + formula.divide(g.running(g["a"]), g.country(g["a"])), {"a": _A}, "f / nullif(a, 0) + m / 1000000 + cs / nullif(w, 0)", f"max(a) FILTER (year = 1997) OVER (PARTITION BY territory_code) AS f, CASE WHEN count(a) OVER q = 3 THEN avg(a) OVER q END AS m, CASE WHEN count(a) {_W} = count(*) {_W} THEN sum(a) {_W} END AS cs, max(a) FILTER (territory_code = 'W') OVER (PARTITION BY year) AS w".replace("OVER q", "OVER (PARTITION BY territory_code ORDER BY year ROWS 2 PRECEDING)"))
_formula("frm10_regions", lambda g: formula.divide(g["a"] - g.mean(g["a"]), g.deviation(g["a"])) + formula.divide(g["a"], g.total(g["a"])) - formula.divide(g.district(g["a"]), g.total(g["a"])), {"a": _A}, "(a - mean) / nullif(sd, 0) + a / nullif(t, 0) - dm / nullif(t, 0)", "avg(a) FILTER (is_region) OVER (PARTITION BY year) AS mean, stddev_samp(a) FILTER (is_region) OVER (PARTITION BY year) AS sd, sum(a) FILTER (is_region) OVER (PARTITION BY year) AS t, avg(a) FILTER (is_region) OVER (PARTITION BY year, district_code) AS dm")
_formula("frm10_in_year", lambda g: g.in_year(g["a"], 1998), {"a": _A}, "CASE WHEN year = 1998 THEN a END")
_formula("frm10_weighted_district", lambda g: g.weighted_district(g["a"], g["b"]), {"a": "avg_price:1-URGENT/BUILDING", "b": _B}, "wd", "sum(a * b) FILTER (is_region AND a IS NOT NULL AND b IS NOT NULL) OVER d / nullif(sum(b) FILTER (is_region AND a IS NOT NULL AND b IS NOT NULL) OVER d, 0) AS wd", " WINDOW d AS (PARTITION BY year, district_code)")
on_cube("frm11_undefined", lambda c: (lambda g: g.undefined(g["a"], g["b"] - 3))(formula.Grid(c.observation, c.territory, {"a": "revenue:1-URGENT/BUILDING", "b": "orders:1-URGENT/BUILDING"})), "SELECT a.year, count(*) AS n FROM observation a JOIN observation b USING (territory_code, year) WHERE a.series_key = 'revenue:1-URGENT/BUILDING' AND b.series_key = 'orders:1-URGENT/BUILDING' AND a.value IS NOT NULL AND b.value = 3 GROUP BY a.year")
_KIND_OF = lambda x: F.when(F.col(x).startswith("avg"), "average").otherwise("total")


def _uses(c) -> DataFrame:
    last = c.observation.filter("value is not null").groupBy(F.split("series_key", "/")[0].alias("k")).agg(F.max("year").alias("last")).select("k", (F.col("last") - F.length("k") % 2).alias("last"))
    two = last.select(F.col("k").alias("a"), F.col("last").alias("last_a")).join(last.select(F.col("k").alias("b"), F.col("last").alias("last_b")), F.col("a") < F.col("b"))
    ops = F.explode(F.array(*[F.lit(o) for o in ("sum", "structure", "per_group", "growth")]))
    return two.withColumn("operation", ops).withColumn("kind_a", _KIND_OF("a")).withColumn("kind_b", _KIND_OF("b"))


on_cube("frm29_warnings", lambda c: formula.warnings(_uses(c)).select("operation", "a", "b", "warning"), """, k AS (SELECT split_part(series_key, '/', 1) AS k, max(year) - length(split_part(series_key, '/', 1)) % 2 AS last FROM observation WHERE value IS NOT NULL GROUP BY 1), u AS (SELECT o AS operation, x.k AS a, y.k AS b, x.last AS la, y.last AS lb FROM k x JOIN k y ON x.k < y.k, (VALUES ('sum'), ('structure'), ('per_group'), ('growth')) v(o))
  SELECT operation, a, b, 'adds what is no total' AS warning FROM u WHERE operation IN ('sum', 'structure') AND a LIKE 'avg%' UNION ALL SELECT operation, a, b, 'divides series of different years' FROM u WHERE operation IN ('structure', 'per_group') AND la <> lb""")
_OPERATION_SQL = {
    "frm14_per_group": ("per_group", "ab", "a / nullif(b, 0) * 1000"),
    "frm15_price_level": ("price_level", "ab", "a / nullif(b / nullif(bw, 0), 0)"),
    "frm16_in_minima": ("in_minima", "ab", "a / nullif(b, 0)"),
    "frm28_percent_between": ("percent_between", "a", "(y00 / nullif(y96, 0) - 1) * 100"),
    "frm28_difference": ("difference", "ab", "a - b"),
    "frm28_growth": ("growth", "a", "(a / nullif(a0, 0) - 1) * 100"),
    "frm28_share_of_regions": ("share_of_regions", "a", "a / nullif(tot, 0) * 100"),
    "frm28_standard_score": ("standard_score", "a", "(a - mea) / nullif(dev, 0)"),
    "frm28_place": ("place", "a", "CASE WHEN is_region AND a IS NOT NULL THEN pla END"),
    "frm28_moving_average": ("moving_average", "a", "mov"),
    "frm17_structure": ("structure", "ab", "a / nullif(b, 0) * 100"),
    "frm18_concentration": ("concentration", "abc", "(power(a / nullif(c, 0), 2) + power(b / nullif(c, 0), 2)) * 10000"),
    "frm19_base_year": ("base_year", "a", "a / nullif(y96, 0) * 100"),
    "frm20_change_between": ("change_between", "a", "y00 - y96"),
    "frm21_annual_rate": ("annual_rate", "a", "(power(y00 / nullif(y96, 0), 1 / 4) - 1) * 100"),
    "frm22_sum": ("sum", "ab", "a + b"),
    "frm23_country_deviation": ("country_deviation", "a", "a - aw"),
    "frm24_district_deviation": ("district_deviation", "a", "a - ad"),
    "frm25_location_quotient": ("location_quotient", "ab", "(a / nullif(b, 0)) / nullif(aw / nullif(bw, 0), 0)"),
    "frm26_structural_shift": ("structural_shift", "abc", "sqrt((power(a / nullif(c, 0) - a0 / nullif(c0, 0), 2) + power(b / nullif(c, 0) - b0 / nullif(c0, 0), 2)) / 2) * 100"),
    "frm27_shift_share_national": ("shift_share_national", "ab", "a0 * (bw / nullif(bw0, 0) - 1)"),
    "frm27_shift_share_mix": ("shift_share_mix", "ab", "a0 * (aw / nullif(aw0, 0) - bw / nullif(bw0, 0))"),
    "frm27_shift_share_regional": ("shift_share_regional", "ab", "a0 * (a / nullif(a0, 0) - aw / nullif(aw0, 0))"),
}
for _name, (_op, _letters, _value) in _OPERATION_SQL.items():
    _keys = dict(zip(_letters, (_C, _D, _A), strict=False))
    _need = [f"lag({x}) {_W} AS {x}0, max({x}) FILTER (territory_code = 'W') OVER (PARTITION BY year) AS {x}w" for x in _letters] + [f"max(a) FILTER (year = 1996) OVER (PARTITION BY territory_code) AS y96, max(a) FILTER (year = 2000) OVER (PARTITION BY territory_code) AS y00, avg(a) FILTER (is_region) OVER (PARTITION BY year, district_code) AS ad, sum(a) FILTER (is_region) OVER (PARTITION BY year) AS tot, avg(a) FILTER (is_region) OVER (PARTITION BY year) AS mea, stddev_samp(a) FILTER (is_region) OVER (PARTITION BY year) AS dev, rank() OVER (PARTITION BY year, is_region AND a IS NOT NULL ORDER BY a DESC) AS pla, CASE WHEN count(a) OVER (PARTITION BY territory_code ORDER BY year ROWS 2 PRECEDING) = 3 THEN avg(a) OVER (PARTITION BY territory_code ORDER BY year ROWS 2 PRECEDING) END AS mov"]
    _sql = _formula_sql(_keys, _value, ", ".join(_need))
    if "w0" in _value:
        _sql = _sql.replace(" FROM g) SELECT", f" FROM g), s2 AS (SELECT *, {', '.join(f'lag({x}w) {_W} AS {x}w0' for x in _letters)} FROM s) SELECT").replace("FROM s) WHERE", "FROM s2) WHERE")
    _years = {n: y for n, y in (("first", 1996), ("last", 2000)) if n == "first" and _op in ("base_year", "change_between", "percent_between", "annual_rate") or n == "last" and _op in ("change_between", "percent_between", "annual_rate")}
    on_cube(_name, lambda c, o=_op, k=_keys, y=_years: formula.operation(o, k, c.observation, c.territory, **y), _sql)

# Statistics


def _st(c, key: str = _S, weights: bool = False):
    rows = c.regions.filter((F.col("series_key") == key) & F.col("value").isNotNull()).select("year", F.col("territory_code").alias("code"), F.col("district_code").alias("group"), "value")
    return rows.join(c.population.select(F.col("territory_code").alias("code"), F.col("population").alias("weight")), "code") if weights else rows


def _long(c, year: int = 1999, keys=_MANY):
    return c.regions.filter(F.col("series_key").isin(*keys) & (F.col("year") == year) & F.col("value").isNotNull()).select(F.col("series_key").alias("column"), F.col("territory_code").alias("code"), "value")


def _edges(c):
    """Regions whose keys follow each other (round), and regions of one district."""
    own = c.territory.filter("level = 'region' and not is_aggregate").select(F.col("territory_code").alias("code"), F.col("district_code").alias("d"), F.expr("cast(substr(territory_code, 2) as int)").alias("k"))
    other = own.select(F.col("code").alias("neighbour"), F.col("d").alias("d2"), F.col("k").alias("k2"))
    return own.join(other, (F.col("d") == F.col("d2")) & (F.col("k") != F.col("k2"))).select("code", "neighbour").union(own.join(other, F.col("k2") == (F.col("k") + 1) % 25).select("code", "neighbour")).union(own.join(other, F.col("k2") == (F.col("k") + 24) % 25).select("code", "neighbour")).distinct()


_X = ", x AS (SELECT year, territory_code AS code, district_code AS grp, value, population AS weight FROM reg JOIN population USING (territory_code) WHERE series_key = 'revenue:00' AND value IS NOT NULL)"
_L = f", lg AS (SELECT series_key AS col, territory_code AS code, value FROM reg WHERE series_key IN {_IN} AND year = 1999 AND value IS NOT NULL)"
_E = ", rg AS (SELECT territory_code AS code, district_code AS d, substr(territory_code, 2)::INT AS k FROM territory WHERE level = 'region' AND NOT is_aggregate), edge AS (SELECT a.code, b.code AS neighbour FROM rg a JOIN rg b ON a.k <> b.k AND (a.d = b.d OR b.k = (a.k + 1) % 25 OR b.k = (a.k + 24) % 25))"
_NORM = _L + ", sc AS (SELECT col, code, round(coalesce((value - min(value) OVER c) / nullif(max(value) OVER c - min(value) OVER c, 0) * 100, 50), 6) AS score FROM lg WINDOW c AS (PARTITION BY col))"
_EQUAL = ", wt AS (SELECT col, 0.25 AS weight FROM (SELECT DISTINCT col FROM sc)), ow AS (SELECT code, col, score, weight, weight / sum(weight) OVER (PARTITION BY code) AS w, count(*) OVER (PARTITION BY code) AS present FROM sc JOIN wt USING (col))"

on_cube("sta12_inequality", lambda c: statistics.inequality(_st(c, weights=True)), _X + """, a AS (SELECT *, weight / sum(weight) OVER (PARTITION BY year) AS s FROM x), b AS (SELECT *, s * value AS sx, sum(s * value) OVER (PARTITION BY year) AS mu, sum(s * value) OVER (PARTITION BY year ORDER BY value, code ROWS UNBOUNDED PRECEDING) AS c FROM a)
  SELECT year, count(*) AS n, round(CASE WHEN min(value) >= 0 THEN 1 - sum(s * (2 * c - sx)) / max(mu) END, 6) AS gini, round(CASE WHEN min(value) > 0 THEN sum(s * value / mu * ln(value / mu)) END, 6) AS theil, round(CASE WHEN min(value) > 0 THEN 1 - power(sum(s * power(value / mu, 0.5)), 2) END, 6) AS atkinson,
  round(sqrt(sum(s * power(value - mu, 2))) / max(mu), 6) AS cv, round(quantile_cont(value, 0.9) / quantile_cont(value, 0.1), 6) AS decile_ratio, round(max(value) / min(value), 6) AS range_ratio FROM b GROUP BY year""")
on_cube("sta09_lorenz", lambda c: statistics.lorenz(_st(c, weights=True)), _X + " SELECT year, code, round(sum(weight) OVER w / sum(weight) OVER (PARTITION BY year), 6) AS people, round(sum(weight * value) OVER w / sum(weight * value) OVER (PARTITION BY year), 6) AS share FROM x WINDOW w AS (PARTITION BY year ORDER BY value, code ROWS UNBOUNDED PRECEDING)")
on_cube("sta10_theil_split", lambda c: statistics.theil_split(_st(c, weights=True)), _X + ", a AS (SELECT *, sum(weight * value) OVER g / sum(weight) OVER g AS gm, sum(weight * value) OVER y / sum(weight) OVER y AS mu, weight * value / sum(weight * value) OVER y AS share FROM x WINDOW g AS (PARTITION BY year, grp), y AS (PARTITION BY year)) SELECT year, round(sum(share * ln(gm / mu)), 6) AS between, round(sum(share * ln(value / gm)), 6) AS within FROM a GROUP BY year".replace("AS between", 'AS "between"'))
on_cube("sta15_sigma_series", lambda c: statistics.sigma_series(_st(c)), _X + " SELECT year, round(stddev_samp(ln(value)), 8) AS sigma, count(*) AS n FROM x WHERE value > 0 GROUP BY year HAVING count(*) >= 20")
on_cube("sta16_sigma_trend", lambda c: statistics.sigma_trend(_st(c)), _X + ", s AS (SELECT year, round(stddev_samp(ln(value)), 8) AS sigma FROM x WHERE value > 0 GROUP BY year HAVING count(*) >= 20) SELECT round(regr_slope(sigma, year), 6) AS slope, round(regr_r2(sigma, year), 5) AS r2, count(*) AS years FROM s")
on_cube("sta17_beta_convergence", lambda c: statistics.beta_convergence(_st(c), 1995, 2000), _X + ", f AS (SELECT regr_slope((ln(b.value) - ln(a.value)) / 5, ln(a.value)) AS b, regr_r2((ln(b.value) - ln(a.value)) / 5, ln(a.value)) AS r2, count(*) AS n FROM x a JOIN x b USING (code) WHERE a.year = 1995 AND b.year = 2000 AND a.value > 0 AND b.value > 0), g AS (SELECT *, CASE WHEN b < 0 AND 1 + b * 5 > 0 THEN -ln(1 + b * 5) / 5 END AS sp FROM f) SELECT round(b, 6) AS beta, round(r2, 6) AS r2, n, round(sp, 5) AS speed, round(CASE WHEN sp > 0 THEN ln(2) / sp END, 3) AS half_life FROM g")
on_cube("sta23_correlations", lambda c: statistics.correlations(_long(c)), _L + ", p AS (SELECT a.col AS a, b.col AS b, a.value AS x, b.value AS y FROM lg a JOIN lg b USING (code) WHERE a.col < b.col), r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS ry FROM p) SELECT a, b, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY a, b HAVING count(*) >= 8")
on_cube("sta22_kendall", lambda c: statistics.kendall(_long(c)), _L + ", p AS (SELECT a.col AS a, b.col AS b, code, a.value AS x, b.value AS y FROM lg a JOIN lg b USING (code) WHERE a.col < b.col) SELECT p.a, p.b, round(sum(sign(p.x - q.x) * sign(p.y - q.y)) / sqrt(sum(abs(sign(p.x - q.x))) * sum(abs(sign(p.y - q.y)))), 6) AS tau FROM p JOIN p q ON p.a = q.a AND p.b = q.b AND p.code < q.code GROUP BY p.a, p.b")
on_cube("sta24_benjamini_hochberg", lambda c: statistics.benjamini_hochberg(statistics.correlations(_long(c)).select(F.concat("a", F.lit("|"), "b").alias("key"), F.round(1 - F.abs("pearson"), 6).alias("p"))).withColumn("p_adjusted", F.round("p_adjusted", 6)), _L + ", q AS (SELECT a.col || '|' || b.col AS key, round(1 - abs(round(corr(a.value, b.value), 6)), 6) AS p FROM lg a JOIN lg b USING (code) WHERE a.col < b.col GROUP BY a.col, b.col HAVING count(*) >= 8), r AS (SELECT *, row_number() OVER (ORDER BY p, key) AS i, count(*) OVER () AS m FROM q) SELECT key, p, round(least(min(p * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING), 1), 6) AS p_adjusted FROM r")
on_cube("sta27_lag_profile", lambda c: statistics.lag_profile(_st(c), _st(c, _Q), 3), _X + ", y AS (SELECT year, territory_code AS code, value FROM reg WHERE series_key = 'orders:00' AND value IS NOT NULL) SELECT k, count(*) AS n, round(corr(x.value, y.value), 6) AS r FROM x, range(4) t(k), y WHERE y.code = x.code AND y.year = x.year + k GROUP BY k")
on_cube("sta26_partial", lambda c: statistics.partial_of_three(_long(c), "revenue:00", "orders:00", "quantity:00"), _L + ", w AS (SELECT max(value) FILTER (col = 'revenue:00') AS a, max(value) FILTER (col = 'orders:00') AS b, max(value) FILTER (col = 'quantity:00') AS c FROM lg GROUP BY code), r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL) SELECT round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) AS partial FROM r")
on_cube("sta31_moran", lambda c: statistics.moran(_st(c), _edges(c)), _X + _E + ", z AS (SELECT year, code, value - avg(value) OVER (PARTITION BY year) AS z, count(*) OVER (PARTITION BY year) AS n FROM x), lag AS (SELECT a.year, a.code, a.z, avg(b.z) AS lag FROM z a JOIN edge USING (code) JOIN z b ON b.code = edge.neighbour AND b.year = a.year GROUP BY ALL), t AS (SELECT year, sum(z * lag) AS top, count(*) AS s0 FROM lag GROUP BY year), l AS (SELECT year, sum(z * z) AS low, max(n) AS n FROM z GROUP BY year) SELECT year, n, round(n / s0 * top / low, 6) AS moran, round(-1 / (n - 1), 6) AS expected FROM t JOIN l USING (year)")
on_cube("sta32_local_moran", lambda c: statistics.local_moran(_st(c), _edges(c)), _X + _E + ", z AS (SELECT year, code, (value - avg(value) OVER (PARTITION BY year)) / nullif(stddev_pop(value) OVER (PARTITION BY year), 0) AS z FROM x), lag AS (SELECT a.year, a.code, a.z, avg(b.z) AS lag FROM z a JOIN edge USING (code) JOIN z b ON b.code = edge.neighbour AND b.year = a.year GROUP BY ALL) SELECT year, code, round(z * lag, 6) AS local, (CASE WHEN z >= 0 THEN 'H' ELSE 'L' END) || (CASE WHEN lag >= 0 THEN 'H' ELSE 'L' END) AS quadrant FROM lag".replace("AS local,", 'AS "local",'))
_LISA = _X + _E + """, z AS (SELECT year, code, (value - avg(value) OVER y) / stddev_pop(value) OVER y AS z, row_number() OVER (PARTITION BY year ORDER BY code) - 1 AS pos, count(*) OVER y AS n FROM x WINDOW y AS (PARTITION BY year)),
  lg AS (SELECT a.year, a.code, a.z, a.pos, a.n, avg(b.z) AS lag, count(*) AS k FROM z a JOIN edge USING (code) JOIN z b ON b.code = edge.neighbour AND b.year = a.year WHERE a.n >= 20 GROUP BY ALL),
  dr AS (SELECT n, d, j, row_number() OVER (PARTITION BY n, d ORDER BY md5('20260321:' || d || ':' || j)) AS place FROM (SELECT n, d, unnest(range(n - 1)) AS j FROM (SELECT DISTINCT n FROM z), range(999) r(d))),
  sm AS (SELECT l.year, l.code, d, l.z * avg(o.z) AS s FROM lg l JOIN dr ON dr.n = l.n AND place <= k JOIN z o ON o.year = l.year AND o.pos = j + (j >= l.pos)::INT GROUP BY l.year, l.code, l.z, d),
  tested AS (SELECT year, code, round(z * lag, 6) AS "local", (CASE WHEN z >= 0 THEN 'H' ELSE 'L' END) || (CASE WHEN lag >= 0 THEN 'H' ELSE 'L' END) AS quadrant, k AS neighbours, (count(*) FILTER (round(abs(s), 9) >= round(abs(z * lag), 9)) + 1) / 1000 AS p FROM lg JOIN sm USING (year, code) GROUP BY ALL)"""
on_cube("sta32_local_moran_tests", lambda c: statistics.local_moran_tests(_st(c), _edges(c), 999), _LISA + " SELECT * FROM tested")
on_cube("sta33_adjusted", lambda c: statistics.benjamini_hochberg(statistics.local_moran_tests(_st(c), _edges(c), 999), "p", "code", "year").select("year", "code", "p", F.round("p_adjusted", 8).alias("p_adjusted")), _LISA + ", i AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY p, code) AS i, count(*) OVER (PARTITION BY year) AS m FROM tested) SELECT year, code, p, round(least(min(p * m / i) OVER (PARTITION BY year ORDER BY i DESC ROWS UNBOUNDED PRECEDING), 1.0), 8) AS p_adjusted FROM i")
on_cube("sta31_moran_permutations", lambda c: statistics.moran_permutations(_st(c), _edges(c)), None)
_SCORES = {
    "minmax": "(value - min(value) OVER c) / nullif(max(value) OVER c - min(value) OVER c, 0) * 100",
    "zscore": "50 + least(greatest((value - avg(value) OVER c) / nullif(stddev_samp(value) OVER c, 0), -3), 3) / 3 * 50",
    "robust": "50 + least(greatest((value - quantile_cont(value, 0.5) OVER c) / nullif((quantile_cont(value, 0.75) OVER c - quantile_cont(value, 0.25) OVER c) / 1.349, 0), -3), 3) / 3 * 50",
    "rank": "CASE WHEN max(value) OVER c > min(value) OVER c THEN (rank() OVER (PARTITION BY col ORDER BY value) + (count(*) OVER (PARTITION BY col, value) - 1) / 2 - 1) / (count(*) OVER c - 1) * 100 END",
    "log": "CASE WHEN min(value) OVER c > 0 THEN (ln(value) - ln(min(value) OVER c)) / nullif(ln(max(value) OVER c) - ln(min(value) OVER c), 0) * 100 END",
}
for _method, _score in _SCORES.items():
    on_cube(f"sta36_normalise_{_method}", lambda c, m=_method: statistics.normalise(_long(c), m, ("avg_price:00",)), _L + f' SELECT col AS "column", code, round(CASE WHEN col = \'avg_price:00\' THEN 100 - s ELSE s END, 6) AS score FROM (SELECT col, code, coalesce({_score}, 50) AS s FROM lg WINDOW c AS (PARTITION BY col))')
on_cube("sta41_entropy_weights", lambda c: statistics.entropy_weights(statistics.normalise(_long(c), "minmax")), _NORM + ', v AS (SELECT *, score - min(score) OVER (PARTITION BY col) + 1e-12 AS v FROM sc), p AS (SELECT *, v / sum(v) OVER (PARTITION BY col) AS p FROM v), d AS (SELECT col, 1 + sum(p * ln(p + 1e-12)) / ln(count(*)) AS d FROM p GROUP BY col) SELECT col AS "column", round(d / sum(d) OVER (), 6) AS weight FROM d')
on_cube("sta42_critic_weights", lambda c: statistics.critic_weights(statistics.normalise(_long(c), "minmax")), _NORM + ', r AS (SELECT a.col, sum(CASE WHEN a.col <> b.col THEN 0 ELSE 0 END) AS z FROM sc a JOIN sc b USING (code) GROUP BY a.col), rr AS (SELECT a.col AS a, b.col AS b, corr(a.score, b.score) AS r FROM sc a JOIN sc b USING (code) WHERE a.col <> b.col GROUP BY 1, 2), k AS (SELECT a AS col, sum(1 - coalesce(r, 0)) AS conflict FROM rr GROUP BY a), s AS (SELECT col, stddev_samp(score) AS sd FROM sc GROUP BY col) SELECT col AS "column", round(sd * conflict / sum(sd * conflict) OVER (), 6) AS weight FROM s JOIN k USING (col)')
on_cube("sta43_pca_weights", lambda c: statistics.pca_weights(statistics.normalise(_long(c), "minmax"), _MANY), None)
_INDEX = {
    "additive": "SELECT code, round(sum(w * score), 5) AS index FROM ow GROUP BY code",
    "geometric": "SELECT code, round(exp(sum(w * ln(greatest(score, 1)))), 5) AS index FROM ow GROUP BY code",
    "topsis": "SELECT code, round(coalesce(sqrt(sum(power(v - dn, 2))) / nullif(sqrt(sum(power(v - dn, 2))) + sqrt(sum(power(v - up, 2))), 0) * 100, 50), 5) AS index FROM (SELECT code, weight * score AS v, max(weight * score) OVER (PARTITION BY col) AS up, min(weight * score) OVER (PARTITION BY col) AS dn FROM ow) GROUP BY code",
    "distance": "SELECT code, round(coalesce((1 - d / nullif(max(d) OVER (), 0)) * 100, 100), 5) AS index FROM (SELECT code, sqrt(sum(weight * power(score - best, 2))) AS d FROM (SELECT *, max(score) OVER (PARTITION BY col) AS best FROM ow) GROUP BY code)",
}


def _index(c, method: str):
    scores = statistics.normalise(_long(c), "minmax")
    return statistics.composite(scores, scores.select("column").distinct().withColumn("weight", F.lit(0.25)), 4, method)


for _method, _select in _INDEX.items():
    on_cube(f"sta44_index_{_method}", lambda c, m=_method: _index(c, m), _NORM + _EQUAL + " " + _select)
on_cube("sta48_rank_shift", lambda c: statistics.rank_shift(_index(c, "additive"), _index(c, "geometric")), _NORM + _EQUAL + f", a AS ({_INDEX['additive']}), b AS ({_INDEX['geometric']}), p AS (SELECT code, rank() OVER (ORDER BY index DESC) AS x FROM a), q AS (SELECT code, rank() OVER (ORDER BY index DESC) AS y FROM b) SELECT round(avg(abs(x - y)), 6) AS mean_shift, max(abs(x - y)) AS max_shift FROM p JOIN q USING (code)")
on_cube("sta51_similar", lambda c: statistics.similar(_long(c), "N3"), _L + ", z AS (SELECT col, code, (value - avg(value) OVER (PARTITION BY col)) / nullif(stddev_pop(value) OVER (PARTITION BY col), 0) AS z FROM lg), g AS (SELECT a.code, a.col, abs(a.z - b.z) AS gap FROM z a JOIN z b USING (col) WHERE b.code = 'N3' AND a.code <> 'N3') SELECT code, round(sqrt(sum(gap * gap)), 6) AS distance, arg_max(col, gap) AS largest_gap FROM g GROUP BY code ORDER BY distance, code LIMIT 6")
on_cube("sta56_equal_breaks", lambda c: statistics.breaks(_st(c), "equal"), _X + " SELECT year, i, round(min(value) + (max(value) - min(value)) * i / 5, 5) AS edge FROM x, range(6) t(i) GROUP BY year, i")
on_cube("sta57_quantile_breaks", lambda c: statistics.breaks(_st(c), "quantile"), _X + ", s AS (SELECT year, list(value ORDER BY value) AS v, count(*) AS n FROM x GROUP BY year), a AS (SELECT year, i, v, least(i * n / 5, n - 1.0)::DOUBLE AS pos FROM s, range(6) t(i)) SELECT year, i, round(v[floor(pos)::INT + 1] + (v[ceil(pos)::INT + 1] - v[floor(pos)::INT + 1]) * (pos - floor(pos)), 5) AS edge FROM a")
on_cube("sta58_stddev_breaks", lambda c: statistics.breaks(_st(c), "stddev"), _X + " SELECT year, i, round(CASE i WHEN 0 THEN min(value) WHEN 5 THEN max(value) ELSE least(greatest(avg(value) + (i - 2.5) * 0.5 * stddev_pop(value), min(value)), max(value)) END, 5) AS edge FROM x, range(6) t(i) GROUP BY year, i")
on_cube("sta59_jenks", lambda c: statistics.jenks(_st(c)), None)
on_cube("sta60_histogram", lambda c: statistics.histogram(_st(c, _Q)), ", x AS (SELECT year, value FROM reg WHERE series_key = 'orders:00' AND value IS NOT NULL) SELECT year, bin, count(*) AS n FROM (SELECT year, least(floor(coalesce((value - min(value) OVER y) * 28 / nullif(max(value) OVER y - min(value) OVER y, 0), 0)), 27)::BIGINT AS bin FROM x WINDOW y AS (PARTITION BY year)) GROUP BY year, bin")
on_cube("mrt16_outliers", lambda c: statistics.outliers(_st(c)), _X + ", q AS (SELECT year, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM x GROUP BY year HAVING count(*) >= 10) SELECT year, code, value FROM x JOIN q USING (year) WHERE q3 > q1 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))")
on_cube("sta13_composition", lambda c: statistics.constant_composition(_st(c, _P)), ", x AS (SELECT year, territory_code AS code FROM reg WHERE series_key = 'revenue:1-URGENT' AND value IS NOT NULL), f AS (SELECT year FROM (SELECT year, count(*) AS n, max(count(*)) OVER () AS peak FROM x GROUP BY year) WHERE n >= 0.8 * peak) SELECT code, count(DISTINCT year) AS years FROM x JOIN f USING (year) GROUP BY code HAVING count(DISTINCT year) = (SELECT count(*) FROM f)")
on_cube("sta20_ols", lambda c: statistics.ols(_long(c).groupBy("code").pivot("column", list(_MANY)).agg(F.max("value")).select("code", F.col("`revenue:00`").alias("y"), F.col("`orders:00`").alias("x1"), F.col("`avg_price:00`").alias("x2")), "y", ("x1", "x2")), None)
add("mrt15_masks", lambda spark, sf_dir: statistics.masks(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.when(F.col("o_orderkey") % 1000 == 7, F.lit(99999999.0)).otherwise(F.col("o_totalprice")).alias("value"))), "SELECT 99999999.0::DOUBLE AS value, count(*) AS n FROM orders WHERE o_orderkey % 1000 = 7 HAVING count(*) > 0")

# Answers and quality
_PARTS = [f"revenue:{p}" for p in _PRIORITIES]
_PIN = ", ".join(f"'{p}'" for p in _PARTS)
_R99 = "FROM mart_rank WHERE series_key = 'revenue:00' AND year = 1999"
on_cube("ans01_both_ends", lambda c: answers.both_ends(c, _S, 1999), f"SELECT territory_code, value, rank_desc, CASE WHEN rank_desc <= 3 THEN 'top' ELSE 'bottom' END AS \"end\" {_R99} AND (rank_desc <= 3 OR rank_asc <= 3)", "rank")
on_cube("ans02_change", lambda c: answers.change(c, _S, "R1"), "SELECT a.year, a.value, b.value AS before, round(a.value - b.value, 4) AS difference, round(CASE WHEN b.value > 0 THEN (a.value / b.value - 1) * 100 END, 4) AS percent FROM (SELECT * FROM observation WHERE series_key = 'revenue:00' AND territory_code = 'R1' AND value IS NOT NULL ORDER BY year DESC LIMIT 1) a LEFT JOIN observation b ON b.series_key = a.series_key AND b.territory_code = a.territory_code AND b.year = a.year - 5 AND b.value IS NOT NULL")
on_cube("ans04_own_place", lambda c: answers.own_place(c, _S, "N8", 1999), f"SELECT * FROM (SELECT territory_code, value, rank_desc, rank() OVER (PARTITION BY district_code ORDER BY value DESC) AS district_place, lag(territory_code) OVER (ORDER BY rank_desc, territory_code) AS above, lead(territory_code) OVER (ORDER BY rank_desc, territory_code) AS below, share_of_total, ratio_to_country FROM mart_rank JOIN territory USING (territory_code) WHERE series_key = 'revenue:00' AND year = 1999) WHERE territory_code = 'N8'", "rank")
on_cube("ans06_growth_ranking", lambda c: answers.growth_ranking(c, _S, 1996, 2000), "SELECT territory_code, growth, rank() OVER (ORDER BY growth DESC) AS place FROM (SELECT a.territory_code, round((b.value / a.value - 1) * 100, 4) AS growth FROM reg a JOIN reg b USING (series_key, territory_code) WHERE series_key = 'revenue:00' AND a.year = 1996 AND b.year = 2000 AND a.value > 0 AND b.value IS NOT NULL)")
on_cube("ans07_structure", lambda c: answers.structure(c, _PARTS, 1999, "W"), f"SELECT part, round(sum(value), 4) AS value, round(sum(value) / sum(sum(value)) OVER () * 100, 4) AS share FROM (SELECT CASE WHEN row_number() OVER (ORDER BY value DESC, series_key) <= 3 THEN series_key ELSE 'other' END AS part, value FROM observation WHERE series_key IN ({_PIN}) AND year = 1999 AND territory_code = 'W' AND value IS NOT NULL) GROUP BY part")
on_cube("ans08_contributions", lambda c: answers.contributions(c, _S, 1996, 2000), ", d AS (SELECT a.territory_code, a.value AS a, b.value - a.value AS d FROM reg a JOIN reg b USING (series_key, territory_code) WHERE series_key = 'revenue:00' AND a.year = 1996 AND b.year = 2000 AND a.value IS NOT NULL AND b.value IS NOT NULL), p AS (SELECT *, row_number() OVER (ORDER BY abs(d) DESC, territory_code) AS place, sum(a) OVER () AS start FROM d), s AS (SELECT least(place, 9) AS step, CASE WHEN max(place) > 8 THEN 'rest' ELSE max(territory_code) END AS part, sum(d) AS d, max(start) AS start FROM p GROUP BY 1) SELECT step, part, round(d, 4) AS change, round(start + sum(d) OVER (ORDER BY step), 4) AS level FROM s")
on_cube("ans11_districts", lambda c: answers.districts(c, _S, 1999, True), "SELECT d.district_code, round(coalesce(d.value, (SELECT sum(value) FROM reg r WHERE r.series_key = 'revenue:00' AND r.year = 1999 AND r.district_code = d.district_code)), 4) AS value FROM observation d WHERE d.series_key = 'revenue:00' AND d.year = 1999 AND d.territory_level = 'federal_district'")
on_cube("ans12_notable", lambda c: answers.notable(c, _S, 2000), "SELECT arg_max(a.territory_code, a.value) AS largest, arg_min(a.territory_code, a.value) AS smallest, round(max(a.value) / nullif(min(a.value), 0), 4) AS ratio, count(*) FILTER (a.value > b.value) AS grew, count(*) FILTER (a.value IS NULL) AS missing FROM reg a JOIN reg b USING (series_key, territory_code) WHERE series_key = 'revenue:00' AND a.year = 2000 AND b.year = 1999")
on_cube("ans18_rebased", lambda c: answers.rebased(c, (_S, _Q), "R2"), ", r AS (SELECT series_key, year, value FROM observation WHERE series_key IN ('revenue:00', 'orders:00') AND territory_code = 'R2' AND value IS NOT NULL), b AS (SELECT min(year) AS y FROM (SELECT year FROM r WHERE value <> 0 GROUP BY year HAVING count(*) = 2)) SELECT r.series_key, r.year, round(r.value / x.value * 100, 2) AS value FROM r JOIN r x ON x.series_key = r.series_key JOIN b ON x.year = b.y")
on_cube("ans24_district_places", lambda c: mart(c, "rank").filter((F.col("series_key") == _S) & (F.col("year") == 1999)).join(c.territory.select("territory_code", "district_code"), "territory_code").select("territory_code", "district_code", F.rank().over(Window.partitionBy("district_code").orderBy("rank_desc")).cast("long").alias("place")), "SELECT territory_code, district_code, rank() OVER (PARTITION BY district_code ORDER BY rank_desc) AS place FROM mart_rank JOIN territory USING (territory_code) WHERE series_key = 'revenue:00' AND year = 1999", "rank")
on_cube("ans27_against_year", lambda c: answers.against_year(c, _S, 2000, 1998), "SELECT a.territory_code, a.value, round(a.value - b.value, 4) AS difference FROM reg a LEFT JOIN reg b ON b.series_key = a.series_key AND b.territory_code = a.territory_code AND b.year = 1998 AND b.value IS NOT NULL WHERE a.series_key = 'revenue:00' AND a.year = 2000 AND a.value IS NOT NULL")
on_cube("ans36_frames", lambda c: answers.frames(c, _S), "SELECT year, string_agg(territory_code, ',' ORDER BY rank_desc, territory_code) AS standing, count(*) AS regions FROM mart_rank WHERE series_key = 'revenue:00' GROUP BY year", "rank")
on_cube("ans41_finding", lambda c: answers.finding(c, "avg_price:00", 1999), "SELECT round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, count(*) FILTER (value < (SELECT value FROM observation WHERE series_key = 'avg_price:00' AND year = 1999 AND territory_level = 'country')) AS below FROM reg WHERE series_key = 'avg_price:00' AND year = 1999 AND value IS NOT NULL")
on_cube("ans17_relation", lambda c: answers.common_year_relation(c, _S, _Q), ", p AS (SELECT a.year, a.value AS x, b.value AS y FROM reg a JOIN reg b USING (territory_code, year) WHERE a.series_key = 'revenue:00' AND b.series_key = 'orders:00' AND a.value IS NOT NULL AND b.value IS NOT NULL), b AS (SELECT year FROM p GROUP BY year HAVING count(*) >= 8 ORDER BY count(*) DESC, year DESC LIMIT 1), r AS (SELECT year, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM p JOIN b USING (year)) SELECT year, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY year")
on_cube("mrt07_aggregate_consistency", quality.aggregate_consistency, ", r AS (SELECT series_key, year, sum(value) / max(country_value) AS ratio FROM reg JOIN country USING (series_key, year) WHERE value IS NOT NULL AND country_value > 0 GROUP BY series_key, year) SELECT series_key, round(median(ratio), 6) AS median_ratio, count(*) FILTER (abs(ratio - 1) > 0.05) AS years_off, round(median(ratio), 6) BETWEEN 0.9 AND 1.1 AS additive FROM r GROUP BY series_key")
on_cube("mrt08_scale_anomalies", quality.scale_anomalies, "SELECT * FROM (SELECT series_key, territory_code, year, round(greatest(last_value / first_value, first_value / last_value), 4) AS factor FROM mart_revision WHERE first_value > 0 AND last_value > 0) WHERE factor > 9", "revision")
on_cube("mrt09_series_gaps", quality.series_gaps, "SELECT series_key, territory_code, max(year) - min(year) + 1 - count(*) AS missing FROM reg WHERE value IS NOT NULL GROUP BY ALL HAVING max(year) - min(year) + 1 > count(*)")
on_cube("mrt10_discontinued", lambda c: quality.discontinued(c, c.territory.sparkSession.createDataFrame([(_S, 1999), (_P, 2000)], "series_key string, stop_year long")), "SELECT series_key, count(*) AS n FROM reg JOIN (VALUES ('revenue:00', 1999), ('revenue:1-URGENT', 2000)) s(series_key, stop_year) USING (series_key) WHERE value IS NOT NULL AND year > stop_year GROUP BY series_key")
on_cube("mrt13_scale_jumps", lambda c: quality.scale_jumps(c), ", m AS (SELECT series_key, year, median(abs(value)) AS m FROM reg WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 10), j AS (SELECT series_key, year, greatest(m / b, b / m) AS jump FROM (SELECT *, lag(m) OVER (PARTITION BY series_key ORDER BY year) AS b FROM m) WHERE b > 0 AND m > 0) SELECT series_key, year, round(jump, 2) AS jump FROM j WHERE jump BETWEEN 500 AND 2000 OR jump BETWEEN 5e5 AND 2e6")
on_cube("mrt14_parts_over_total", lambda c: quality.parts_over_total(c.observation.withColumn("value", F.when(F.col("series_key").endswith("/BUILDING") & (F.col("year") == 1998), F.col("value") * 5).otherwise(F.col("value")))), """, f AS (SELECT series_key, territory_code, year, CASE WHEN series_key LIKE '%/BUILDING' AND year = 1998 THEN value * 5 ELSE value END AS value FROM observation WHERE value IS NOT NULL),
  pt AS (SELECT regexp_extract(series_key, '^(.*)/[^/]*$', 1) AS series_key, territory_code, year, sum(value) AS parts, count(*) AS n FROM f WHERE series_key LIKE '%/%' GROUP BY ALL) SELECT series_key, territory_code, year, value, round(parts, 4) AS parts, n FROM f JOIN pt USING (series_key, territory_code, year) WHERE parts > value * 1.01""")
on_cube("mrt17_presence", lambda c: quality.presence(c, "revenue:1-URGENT/BUILDING"), "SELECT territory_code, year, CASE WHEN value IS NOT NULL THEN 'present' WHEN quality = 2 THEN 'hidden' ELSE 'absent' END AS state FROM reg WHERE series_key = 'revenue:1-URGENT/BUILDING'")
on_cube("mrt20_data_kind", quality.data_kind, "SELECT series_key, year, CASE WHEN abs(t / nullif(c, 0) - 1) <= 0.01 THEN 'sum' WHEN c BETWEEN lo AND hi AND t / nullif(c, 0) BETWEEN n / 4 AND n * 4 THEN 'relative' ELSE 'unknown' END AS kind FROM (SELECT series_key, year, sum(value) AS t, min(value) AS lo, max(value) AS hi, count(*) AS n, max(country_value) AS c FROM reg JOIN country USING (series_key, year) WHERE value IS NOT NULL AND country_value IS NOT NULL GROUP BY series_key, year)")

# Search, text, sources, event streams in batch form


def _read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TERMS = "regexp_extract_all(replace(lower(trim({0})), 'ё', 'е'), '[0-9a-zà-ÿа-я²³%]+')"
_BM25 = f"""WITH tok AS (SELECT doc_id AS key, unnest({_TERMS.format('text')}) AS term FROM documents), post AS (SELECT key, term, count(*)::DOUBLE AS tf FROM tok GROUP BY ALL),
len AS (SELECT key, sum(tf) AS length FROM post GROUP BY key), corpus AS (SELECT count(*) AS n, avg(length) AS mean FROM len),
q AS (SELECT DISTINCT item_id AS query, unnest({_TERMS.format('text')}) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM q) GROUP BY term),
t AS (SELECT query, term, mean, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM q JOIN df USING (term), corpus WHERE df <= 0.5 * n),
r AS (SELECT query, key, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.7 + 0.3 * length / mean))), 5) AS score FROM t JOIN post USING (term) JOIN len USING (key) GROUP BY query, key)
SELECT query, key, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS place FROM r) WHERE place <= 3"""
add("txt10_bm25", lambda spark, sf_dir: search.bm25(_read(spark, sf_dir, "documents"), "doc_id", {"text": 1.0}, _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(text.words(F.col("text"))).alias("term"))), _BM25)
add("txt02_words", lambda spark, sf_dir: _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.words(F.col("text"))).cast("long").alias("words"), F.array_join(F.slice(text.words(F.col("text")), 1, 3), " ").alias("first_words")), f"SELECT conv_id, turn, len({_TERMS.format('text')}) AS words, array_to_string({_TERMS.format('text')}[1:3], ' ') AS first_words FROM conversations")
add("txt05_one_typo", lambda spark, sf_dir: _typos(_read(spark, sf_dir, "nation")), "SELECT n_name, damaged, true AS near FROM (SELECT n_name, substr(n_name, 2) AS damaged FROM nation UNION ALL SELECT n_name, substr(n_name, 2, 1) || substr(n_name, 1, 1) || substr(n_name, 3) FROM nation UNION ALL SELECT n_name, n_name || 'X' FROM nation) WHERE n_name <> damaged")


def _typos(nation: DataFrame) -> DataFrame:
    n = F.col("n_name")
    damaged = F.array(F.substr(n, F.lit(2)), F.concat(F.substr(n, F.lit(2), F.lit(1)), F.substr(n, F.lit(1), F.lit(1)), F.substr(n, F.lit(3))), F.concat(n, F.lit("X")))
    rows = nation.select("n_name", F.explode(damaged).alias("damaged")).filter("n_name <> damaged")
    return rows.withColumn("near", text.one_typo(n, F.col("damaged")))


_QUESTIONS = (("q1", "Which nation has the highest revenue?"), ("q2", "Compare FRANCE versus GERMANY"), ("q3", "How did orders of UNITED KINGDOM change since 1996"), ("q4", "What is the revenue of CHINA in 1999"), ("q5", "Does revenue depend on orders?"))
_QVALUES = ", ".join(f"('{a}', '{b}')" for a, b in _QUESTIONS)
_questions = lambda spark: spark.createDataFrame(list(_QUESTIONS), "question string, text string")
add("txt12_find_places", lambda spark, sf_dir: search.find_places(_questions(spark), _read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("name"))), f"SELECT question, 'N' || n_nationkey AS code FROM (VALUES {_QVALUES}) q(question, text), nation WHERE regexp_matches(lower(text), '(^|[^a-z])' || lower(n_name) || '($|[^a-z])')")
_ASKED = (("Which place near {0} has the highest revenue?", "rank"), ("How did orders of {0} change over time?", "trend"), ("Compare {0} with its neighbours", "compare"), ("Give the definition of orders in {0}", "define"), ("Do orders in {0} depend on prices?", "relation"), ("Orders in {0} in 1999", "value"))
add("txt13_question_kind", lambda spark, sf_dir: _read(spark, sf_dir, "nation").select(F.explode(F.array(*[F.replace(F.lit(q), F.lit("{0}"), F.col("n_name")) for q, _ in _ASKED])).alias("question")).select("question", search.question_kind(F.col("question")).alias("kind")), f"SELECT replace(q, '{{0}}', n_name) AS question, kind FROM nation, (VALUES {', '.join(str(x) for x in _ASKED)}) v(q, kind)")
add("txt24_match_labels", lambda spark, sf_dir: search.match_labels(_read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("  "), F.initcap("n_name"), F.lit(" 1)")).alias("label")).distinct(), _read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("name"))).select("code", "how"), "SELECT DISTINCT 'N' || n_nationkey AS code, 'exact' AS how FROM customer JOIN nation ON n_nationkey = c_nationkey")
add("dim10_unit_kind", lambda spark, sf_dir: _read(spark, sf_dir, "part").select(F.concat(F.lit("million dollars per "), "p_type").alias("unit")).distinct().select("unit", text.unit_kind(F.col("unit")).alias("kind"), text.unit_multiplier(F.col("unit")).alias("multiplier"), text.polarity(F.col("unit")).alias("polarity")), "SELECT DISTINCT 'million dollars per ' || p_type AS unit, 'rate' AS kind, 1e6::DOUBLE AS multiplier, 'unknown' AS polarity FROM part")
add("dim18_series_code", lambda spark, sf_dir: _read(spark, sf_dir, "orders").select("o_orderpriority").distinct().select("o_orderpriority", text.series_code(F.lit("revenue"), F.col("o_orderpriority")).alias("code")), "SELECT DISTINCT o_orderpriority, 'revenue:' || substr(sha1(o_orderpriority), 1, 8) AS code FROM orders")
add("src02_profile", lambda spark, sf_dir: tables.summarise(_read(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey"), exact=True), "SELECT 'c_mktsegment' AS \"column\", count(c_mktsegment) AS filled, count(DISTINCT c_mktsegment) AS \"distinct\" FROM customer UNION ALL SELECT 'c_nationkey', count(c_nationkey), count(DISTINCT c_nationkey) FROM customer")
add("src20_page_links", lambda spark, sf_dir: tables.page_links(_read(spark, sf_dir, "pages")), "SELECT page_id, length(regexp_extract(html, '<title>(.*?)</title>', 1, 'is')) AS title_length, len(regexp_extract_all(html, '<a href=')) AS links, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
add("src32_html_tables", lambda spark, sf_dir: tables.html_tables(_read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("<table><tr><th rowspan=2>"), "n_name", F.lit("</th><td>1</td></tr><tr><td>2</td></tr></table>")).alias("h")), "n_nationkey", "h").select("n_nationkey", F.col("row").cast("long").alias("row"), F.array_join("cells", "|").alias("cells")), "SELECT n_nationkey, r AS row, n_name || '|' || (r + 1) AS cells FROM nation, range(2) t(r)")
add("src36_unpivot_years", lambda spark, sf_dir: tables.unpivot_years(_read(spark, sf_dir, "nation").select("n_name", F.concat(F.lit("1 0"), F.lpad("n_nationkey", 2, "0"), F.lit(",5")).alias("1999"), F.lit("–").alias("2000")), "n_name", ["1999", "2000"]), "SELECT n_name, 1999 AS year, 1000.5 + n_nationkey AS value, 'value' AS kind FROM nation UNION ALL SELECT n_name, 2000, NULL, 'missing' FROM nation")
add("src37_collect_first", lambda spark, sf_dir: tables.collect_first(_read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("value")).select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") > 1, F.col("value")).alias("value")), ["l_orderkey"], "l_linenumber"), "SELECT l_orderkey, l_linenumber, value, \"values\" FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY value IS NULL, l_linenumber) AS rn, count(DISTINCT value) OVER (PARTITION BY l_orderkey) AS \"values\" FROM (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_linenumber > 1 THEN l_quantity END) AS value FROM lineitem GROUP BY l_orderkey, l_linenumber)) WHERE rn = 1 AND value IS NOT NULL")
add("src45_safe_cell", lambda spark, sf_dir: _read(spark, sf_dir, "customer").select("c_custkey", text.safe_cell(F.concat(F.when(F.col("c_custkey") % 2 == 0, "=").otherwise(""), "c_name")).alias("cell")), "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '''=' || c_name ELSE c_name END AS cell FROM customer")
add("str07_tumbling", lambda spark, sf_dir: events.tumbling(_read(spark, sf_dir, "events")), "SELECT time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
add("str07_over_budget", lambda spark, sf_dir: events.over_budget(_read(spark, sf_dir, "events"), 2, "1 hour"), "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, user_id, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 2")
add("str06_sliding", lambda spark, sf_dir: events.sliding(_read(spark, sf_dir, "events")), "SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') - to_days(k::INT) AS start, round(avg(value), 6) AS mean, count(*) AS n FROM events, range(3) t(k) GROUP BY ALL")
add("str08_sessions", lambda spark, sf_dir: events.sessions(_read(spark, sf_dir, "events")), 'SELECT user_id, min(ts) AS start, max(ts) + INTERVAL \'30 minutes\' AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL \'30 minutes\' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s')
add("str05_open_period", lambda spark, sf_dir: events.open_period(_read(spark, sf_dir, "events")), "SELECT *, start = max(start) OVER () AS preliminary FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS start, round(sum(value), 4) AS total FROM events GROUP BY 1)")
add("str04_year_to_date", lambda spark, sf_dir: events.year_to_date(_read(spark, sf_dir, "events")), "SELECT month, day, total FROM (SELECT month, day, round(sum(v) OVER w, 4) AS total, count(*) OVER w AS k, min(day) OVER (PARTITION BY month) AS f FROM (SELECT date_trunc('month', ts)::TIMESTAMP AS month, day(ts) AS day, sum(value) AS v FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY month ORDER BY day ROWS UNBOUNDED PRECEDING)) WHERE k = day - f + 1")
add("str04_running_totals", lambda spark, sf_dir: totals.running_totals_of(totals.daily_totals(_read(spark, sf_dir, "events"), "1 day")), "SELECT event_type, month, day, total FROM (SELECT *, round(sum(v) OVER w, 4) AS total, count(*) OVER w AS k, min(day) OVER (PARTITION BY event_type, month) AS f FROM (SELECT event_type, date_trunc('month', ts)::TIMESTAMP AS month, day(ts) AS day, sum(value) AS v FROM events GROUP BY ALL) WINDOW w AS (PARTITION BY event_type, month ORDER BY day ROWS UNBOUNDED PRECEDING)) WHERE k = day - f + 1")
add("str02_once_each", lambda spark, sf_dir: events.once_each(_read(spark, sf_dir, "events").unionByName(_read(spark, sf_dir, "events"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")

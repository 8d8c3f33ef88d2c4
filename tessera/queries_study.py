"""Queries of statistics, comparisons, questions and tables of text, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import labels, quality, recognise, search, statistics, study
from tessera.plans.marts import mart
from tessera.registry import on_cube, on_tables

_S, _Q, _A = "revenue:00", "orders:00", "avg_price:00"
_MANY = ("revenue:00", "orders:00", "avg_price:00", "quantity:00")
_IN = "('revenue:00', 'orders:00', 'avg_price:00', 'quantity:00')"


def _misspelt(word: Column) -> dict[str, Column]:
    """Changes of a word by name."""
    a, b, c = (F.substr(word, F.lit(i), F.lit(1)) for i in (1, 2, 3))
    rest = lambda n: F.substr(word, F.lit(n))
    return {
        "changed": F.concat(a, F.lit("#"), rest(3)), "added": F.concat(a, b, F.lit("#"), rest(3)), "left out": F.concat(a, rest(3)), "swapped": F.concat(b, a, rest(3)),
        "same": word, "two letters": F.concat(F.lit("##"), rest(3)), "apart": F.concat(c, b, a, rest(4)),
    }


def _rows(c, key: str = _S) -> DataFrame:
    return c.regions.filter((F.col("series_key") == key) & F.col("value").isNotNull()).select("year", F.col("territory_code").alias("code"), F.col("district_code").alias("group"), "value")


def _weighted(c, key: str = _S) -> DataFrame:
    return _rows(c, key).join(c.population.select(F.col("territory_code").alias("code"), F.col("population").alias("weight")), "code")


def _long(c, year: int = 1999) -> DataFrame:
    return c.regions.filter(F.col("series_key").isin(*_MANY) & (F.col("year") == year) & F.col("value").isNotNull()).select(F.col("series_key").alias("column"), F.col("territory_code").alias("code"), "value")


def _sel(key: str = _S, name: str = "x") -> str:
    return f", {name} AS (SELECT year, territory_code AS code, district_code AS \"group\", value FROM reg WHERE series_key = '{key}' AND value IS NOT NULL)"


_LONG = f", l AS (SELECT series_key AS \"column\", territory_code AS code, value FROM reg WHERE series_key IN {_IN} AND year = 1999 AND value IS NOT NULL)"

on_cube("sta01_prepare", lambda c: study.prepare(_weighted(c, _A).select("year", "code", F.when(F.col("year") == 1999, float("nan")).otherwise(F.col("value")).alias("value"), (F.col("weight") - 40).alias("weight"))), f"{_sel(_A)} SELECT x.year, code, value, population - 40 AS weight FROM x JOIN population p ON p.territory_code = code WHERE year <> 1999 AND population > 40")
_BOUNDS = """, k AS (SELECT year, count(*) AS n, sum(value) AS s, sum(value * value) AS q, min(value) AS lo, max(value) AS hi, 2 AS k FROM x GROUP BY year), e AS (SELECT k.*, j, s + j * lo + (k - j) * hi AS s1, q + j * lo ** 2 + (k - j) * hi ** 2 AS q1, least(greatest(q / s, lo), hi) AS m FROM k, range(3) r(j) WHERE lo > 0)
  SELECT year, 2::BIGINT AS hidden, round(any_value(sqrt(greatest(q / n - (s / n) ** 2, 0)) / (s / n)), 6) AS known, round(any_value(sqrt(greatest((q + k * m * m) / (n + k) - ((s + k * m) / (n + k)) ** 2, 0)) / ((s + k * m) / (n + k))), 6) AS least, round(max(sqrt(greatest(q1 / (n + k) - (s1 / (n + k)) ** 2, 0)) / (s1 / (n + k))), 6) AS most FROM e GROUP BY year"""
on_cube("sta11_hidden_bounds", lambda c: study.hidden_bounds(_rows(c, _A), _rows(c, _A).select("year").distinct().withColumn("k", F.lit(2))), _sel(_A) + _BOUNDS)
on_cube("sta11_bounds_of_measures", lambda c: study.bounds_of_measures(c.observation.filter("territory_level = 'region' and not is_aggregate").select("series_key", "year", "value", (F.col("quality") == 2).alias("hidden"))), """, h AS (SELECT series_key, year, count(*) FILTER (quality = 2) AS k, count(value) AS n, sum(value) AS s, sum(value * value) AS q, sum(CASE WHEN value > 0 THEN value * ln(value) END) AS e, min(value) AS lo, max(value) AS hi FROM reg GROUP BY ALL HAVING count(*) FILTER (quality = 2) > 0 AND count(value) >= 5 AND min(value) >= 0 AND sum(value) > 0),
  gp AS (SELECT a.series_key, a.year, a.value AS x, sum(abs(a.value - b.value)) AS away FROM reg a JOIN reg b USING (series_key, year) WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.series_key, a.year, a.territory_code, a.value),
  gh AS (SELECT series_key, year, sum(away) / 2 AS half FROM gp GROUP BY ALL), gl AS (SELECT series_key, year, min((half + k * away) / ((n + k) * (s + k * x))) AS least FROM gp JOIN gh USING (series_key, year) JOIN h USING (series_key, year) GROUP BY ALL),
  v AS (SELECT h.*, half, j, k - j AS i, s + j * lo + (k - j) * hi AS s1, q + j * lo * lo + (k - j) * hi * hi AS q1, CASE WHEN lo > 0 THEN e + j * lo * ln(lo) + (k - j) * hi * ln(hi) END AS e1, least(greatest(q / s, lo), hi) AS c, CASE WHEN lo > 0 THEN least(greatest(exp(e / s), lo), hi) END AS t FROM h JOIN gh USING (series_key, year), generate_series(0::BIGINT, k) r(j))
  SELECT series_key, year, k AS hidden, n AS observed, 'gini' AS measure, round(half / (n * s), 6) AS known, round(min(least), 6) AS least, round(max((half + j * (s - n * lo) + i * (n * hi - s) + j * i * (hi - lo)) / ((n + k) * s1)), 6) AS most FROM v JOIN gl USING (series_key, year) GROUP BY series_key, year, k, n, half, s
  UNION ALL SELECT series_key, year, k, n, 'theil', round(greatest(e / s - ln(s / n), 0), 6), round(greatest((e + k * t * ln(t)) / (s + k * t) - ln((s + k * t) / (n + k)), 0), 6), round(max(greatest(e1 / s1 - ln(s1 / (n + k)), 0)), 6) FROM v WHERE lo > 0 GROUP BY series_key, year, k, n, e, s, t
  UNION ALL SELECT series_key, year, k, n, 'cv', round(sqrt(greatest(q / n - (s / n) ** 2, 0)) / (s / n), 6), round(sqrt(greatest((q + k * c * c) / (n + k) - ((s + k * c) / (n + k)) ** 2, 0)) / ((s + k * c) / (n + k)), 6), round(max(sqrt(greatest(q1 / (n + k) - (s1 / (n + k)) ** 2, 0)) / (s1 / (n + k))), 6) FROM v GROUP BY series_key, year, k, n, q, s, c""")
on_cube("sta14_restrict", lambda c: study.restrict(_rows(c, "revenue:1-URGENT/BUILDING"), statistics.constant_composition(_rows(c, "revenue:1-URGENT/BUILDING"))).select("year", "code", "value"), _sel("revenue:1-URGENT/BUILDING") + ", n AS (SELECT year, count(*) AS n, max(count(*)) OVER () AS p FROM x GROUP BY year), f AS (SELECT year FROM n WHERE n >= 0.8 * p) SELECT year, code, value FROM x WHERE code IN (SELECT code FROM x WHERE year IN (SELECT year FROM f) GROUP BY code HAVING count(DISTINCT year) = (SELECT count(*) FROM f))")
_EACH = ", ex AS (SELECT DISTINCT \"group\" AS excluded FROM x UNION ALL SELECT '-'), wx AS (SELECT * FROM x, ex WHERE \"group\" <> excluded)"
on_cube("sta19_sigma_robustness", lambda c: study.sigma_robustness(_rows(c)), f"{_sel()}{_EACH}, sg AS (SELECT excluded, year, stddev_samp(ln(value)) AS sigma FROM wx WHERE value > 0 GROUP BY ALL HAVING count(*) >= 15), tr AS (SELECT excluded, regr_slope(sigma, year) AS slope, count(*) AS years FROM sg GROUP BY ALL) SELECT excluded, round(slope, 6) AS slope, years, sign(slope) = (SELECT sign(slope) FROM tr WHERE excluded = '-') AS stable FROM tr")
on_cube("sta54_inequality_robustness", lambda c: study.inequality_robustness(_weighted(c)).select("excluded", "year", "n", "theil"), f"{_sel()}{_EACH}, w AS (SELECT excluded, year, code, value, population / sum(population) OVER y AS s FROM wx JOIN population ON territory_code = code WHERE population > 0 WINDOW y AS (PARTITION BY excluded, year)), m AS (SELECT *, sum(s * value) OVER (PARTITION BY excluded, year) AS mu, min(value) OVER (PARTITION BY excluded, year) AS lo FROM w) SELECT excluded, year, count(*) AS n, round(CASE WHEN min(lo) > 0 THEN sum(s * (value / mu) * ln(value / mu)) END, 6) AS theil FROM m GROUP BY ALL")
on_cube("sta21_dummies", lambda c: study.dummies(c.territory.filter("level = 'region' and not is_aggregate").select("territory_code", "district_code"), "district_code"), "SELECT territory_code, district_code, " + ", ".join(f"(district_code = 'R{k}')::INT AS \"is_R{k}\"" for k in range(1, 5)) + " FROM territory WHERE level = 'region' AND NOT is_aggregate")
on_cube("sta25_strongest_pairs", lambda c: study.strongest_pairs(_long(c), 2), f"{_LONG} SELECT a.\"column\" AS a, b.\"column\" AS b, count(*) AS n, round(corr(a.value, b.value), 6) AS pearson FROM l a JOIN l b ON a.code = b.code AND a.\"column\" < b.\"column\" GROUP BY ALL HAVING abs(corr(a.value, b.value)) > 0.6 ORDER BY abs(corr(a.value, b.value)) DESC, a, b LIMIT 2")
on_cube("sta28_scatter", lambda c: study.scatter(_long(c).filter(F.col("column") == _S), _long(c).filter(F.col("column") == _Q)), f"{_LONG} SELECT a.code, a.value AS x, b.value AS y FROM l a JOIN l b USING (code) WHERE a.\"column\" = 'revenue:00' AND b.\"column\" = 'orders:00'")
on_cube("sta29_weights", lambda c: study.row_standardised(_edges(c)), ", e AS (SELECT a.territory_code AS code, b.territory_code AS neighbour FROM territory a JOIN territory b ON a.district_code = b.district_code AND a.territory_code <> b.territory_code WHERE a.level = 'region' AND b.level = 'region') SELECT *, 1 / count(*) OVER (PARTITION BY code) AS weight FROM e")


def _edges(c) -> DataFrame:
    t = c.territory.filter("level = 'region' and not is_aggregate")
    return t.select(F.col("territory_code").alias("code"), "district_code").join(t.select(F.col("territory_code").alias("neighbour"), "district_code"), "district_code").filter("code <> neighbour").select("code", "neighbour")


_PLACES = "pl AS (SELECT territory_code AS code, (display_order * 7 % 120 - 60)::DOUBLE AS la, (display_order * 13 % 360 - 180)::DOUBLE AS lo FROM territory WHERE level = 'region' AND NOT is_aggregate)"
on_cube("sta30_nearest_places", lambda c: study.nearest_places(c.territory.filter("level = 'region' and not is_aggregate").select(F.col("territory_code").alias("code"), (F.col("display_order") * 7 % 120 - 60).cast("double").alias("latitude"), (F.col("display_order") * 13 % 360 - 180).cast("double").alias("longitude"))), f""", {_PLACES},
  d AS (SELECT a.code, b.code AS neighbour, acos(greatest(least(sin(radians(a.la)) * sin(radians(b.la)) + cos(radians(a.la)) * cos(radians(b.la)) * cos(radians(a.lo) - radians(b.lo)), 1), -1)) AS g FROM pl a JOIN pl b ON a.code <> b.code)
  SELECT code, neighbour, place, round(degrees(g), 5) AS degrees FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY round(g, 9), neighbour) AS place FROM d) WHERE place <= 5""")
_LOCAL = """, z AS (SELECT year, code, (value - avg(value) OVER y) / nullif(stddev_pop(value) OVER y, 0) AS z FROM x WINDOW y AS (PARTITION BY year)), g AS (SELECT z.year, z.code, z.z, avg(n.z) AS lag FROM z JOIN territory t ON t.territory_code = z.code JOIN territory u ON u.district_code = t.district_code AND u.level = 'region' AND u.territory_code <> t.territory_code JOIN z n ON n.year = z.year AND n.code = u.territory_code GROUP BY ALL)"""
on_cube("sta34_quadrants", lambda c: study.quadrants(statistics.local_moran(_rows(c).select("year", "code", "value"), _edges(c))), f"{_sel()}{_LOCAL} SELECT year, CASE WHEN z >= 0 THEN 'H' ELSE 'L' END || CASE WHEN lag >= 0 THEN 'H' ELSE 'L' END AS quadrant, count(*) AS n, string_agg(code, ',' ORDER BY code) AS codes FROM g GROUP BY 1, 2")


def _by_value():
    return Window.orderBy("value")


_Z = "(value - avg(value) OVER c) / nullif(stddev_pop(value) OVER c, 0)"
on_cube("sta50_standardised", lambda c: study.standardised(_long(c), 4), f"{_LONG}, f AS (SELECT * FROM l WHERE code IN (SELECT code FROM l GROUP BY code HAVING count(*) = 4)) SELECT \"column\", code, round(coalesce({_Z}, 0), 6) AS z FROM f WINDOW c AS (PARTITION BY \"column\")")
on_cube("sta52_related", lambda c: study.related(_long(c), _S), f"""{_LONG}, p AS (SELECT b."column" AS other, a.value AS x, b.value AS y FROM l a JOIN l b USING (code) WHERE a."column" = 'revenue:00' AND b."column" <> 'revenue:00'),
  r AS (SELECT other, rank() OVER (PARTITION BY other ORDER BY x) + (count(*) OVER (PARTITION BY other, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY other ORDER BY y) + (count(*) OVER (PARTITION BY other, y) - 1) / 2 AS ry FROM p), s AS (SELECT other, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY other)
  SELECT *, row_number() OVER (ORDER BY abs(spearman) DESC, other) AS place FROM s""")
on_cube("sta53_period_change", lambda c: study.period_change(_rows(c).groupBy("year").agg(F.round(F.avg("value"), 6).alias("value"))), f"{_sel()}, m AS (SELECT year, round(avg(value), 6) AS v FROM x GROUP BY year) SELECT min(year) AS first_year, max(year) AS last_year, round((arg_max(v, year) - arg_min(v, year)) / abs(arg_min(v, year)), 6) AS change FROM m")
on_cube("sta61_symmetric_breaks", lambda c: study.symmetric_breaks(_rows(c).select("year", (F.col("value") - 1e6).alias("value"))), f"{_sel()} SELECT year, i, round((i * 2 / 6 - 1) * t, 5) AS edge FROM (SELECT year, max(abs(value - 1e6)) AS t FROM x GROUP BY year), range(7) r(i)")
on_cube("sta62_skewed", lambda c: study.is_skewed(_rows(c, "revenue:1-URGENT/BUILDING"), 2.0), f"{_sel('revenue:1-URGENT/BUILDING')} SELECT year, min(value) > 0 AND max(value) >= 2.0 * list_sort(list(value))[count(*) // 2 + 1] AS skewed FROM x GROUP BY year")
on_cube("sta49_sensitivity", lambda c: study.sensitivity(_long(c), 4, others=(("rank", "additive"),)), f"""{_LONG}, mm AS (SELECT "column", code, round(coalesce((value - min(value) OVER c) / nullif(max(value) OVER c - min(value) OVER c, 0) * 100, 50), 6) AS a, round(coalesce((rank() OVER (PARTITION BY "column" ORDER BY value) + (count(*) OVER (PARTITION BY "column", value) - 1) / 2 - 1) / nullif(count(*) OVER c - 1, 0) * 100, 50), 6) AS b FROM l WINDOW c AS (PARTITION BY "column")),
  ix AS (SELECT code, round(avg(a), 5) AS a, round(avg(b), 5) AS b FROM mm GROUP BY code HAVING count(*) >= 0.6 * 4), pl AS (SELECT code, rank() OVER (ORDER BY a DESC) AS p, rank() OVER (ORDER BY b DESC) AS q FROM ix) SELECT round(avg(abs(p - q)), 6) AS mean_shift, max(abs(p - q)) AS max_shift, 'rank/additive' AS variant FROM pl""")

# Comparisons

on_cube("ans03_regions_total", lambda c: study.regions_total(_rows(c, "revenue:1-URGENT/BUILDING")), _sel("revenue:1-URGENT/BUILDING") + ", n AS (SELECT year, count(*) AS n, max(count(*)) OVER () AS p FROM x GROUP BY year), f AS (SELECT year FROM n WHERE n >= 0.8 * p) SELECT year, round(sum(value), 4) AS total, count(*) AS regions FROM x WHERE year IN (SELECT year FROM f) AND code IN (SELECT code FROM x WHERE year IN (SELECT year FROM f) GROUP BY code HAVING count(DISTINCT year) = (SELECT count(*) FROM f)) GROUP BY year")
_PAIR = "(SELECT a.code, a.year, a.value, b.value AS before FROM x a JOIN x b ON b.code = a.code AND b.year = a.year - 1)"


def _pairs(c, key: str = _S) -> DataFrame:
    rows = _rows(c, key).select("code", "year", "value")
    return rows.join(rows.select("code", (F.col("year") + 1).alias("year"), F.col("value").alias("before")), ["code", "year"])


on_cube("ans05_change_mode", lambda c: study.change_mode(_pairs(c), False), f"{_sel()} SELECT CASE WHEN bool_and(before > 0) THEN 'percent' ELSE 'difference' END AS mode, count(*) AS n FROM {_PAIR}")
for _id, _key, _kind in (("ans29_measured_change", _S, "total"), ("ans37_change_between", _A, "share"), ("ans35_month_change_text", _Q, "total")):
    _amount = "value - before" if _kind == "share" else "(value / before - 1) * 100"
    on_cube(_id, lambda c, k=_key, n=_kind: _pairs(c, k).withColumn("m", study.measured_change(F.col("value"), F.col("before"), n)).select("code", "year", "m.*"), f"{_sel(_key)} SELECT code, year, round({_amount}, 4) AS amount, '{'points' if _kind == 'share' else 'percent'}' AS unit, CASE WHEN abs({_amount}) < 0.05 THEN 'same' WHEN {_amount} > 0 THEN 'up' ELSE 'down' END AS direction FROM {_PAIR}")
on_cube("ans32_month_on_year", lambda c: _month_pairs(c).withColumn("m", study.measured_change(F.col("value"), F.col("before"), "total")).select("territory_code", "year", "month", "m.*"), ", p AS (SELECT a.territory_code, a.year, a.month, a.value, b.value AS before FROM month_fact a JOIN month_fact b USING (series_key, territory_code, month, kind) WHERE kind = 'level' AND series_key = 'orders:00' AND b.year = a.year - 1), q AS (SELECT *, CASE WHEN before > 0 THEN (value / before - 1) * 100 ELSE value - before END AS d FROM p) SELECT territory_code, year, month, round(d, 4) AS amount, CASE WHEN before > 0 THEN 'percent' ELSE 'difference' END AS unit, CASE WHEN abs(d) < 0.05 THEN 'same' WHEN d > 0 THEN 'up' ELSE 'down' END AS direction FROM q")


def _month_pairs(c) -> DataFrame:
    rows = c.month.filter("kind = 'level' and series_key = 'orders:00'").select("territory_code", "year", "month", "value")
    return rows.join(rows.select("territory_code", (F.col("year") + 1).alias("year"), "month", F.col("value").alias("before")), ["territory_code", "year", "month"])


on_cube("ans09_part_shifts", lambda c: study.part_shifts(_rows(c).select(F.col("group").alias("part"), "year", "value"), 1996, 2000), f"{_sel()}, g AS (SELECT \"group\" AS part, sum(value) FILTER (year = 1996) AS a, sum(value) FILTER (year = 2000) AS b FROM x GROUP BY 1) SELECT part, round(b - a, 4) AS change, round((b - a) / nullif(sum(b - a) OVER (), 0) * 100, 4) AS share_of_change, round((b / sum(b) OVER () - a / sum(a) OVER ()) * 100, 4) AS share_shift FROM g WHERE a IS NOT NULL AND b IS NOT NULL")
on_cube("ans10_group", lambda c: study.group_against_rest(_rows(c), ("N1", "N4", "N9")), f"{_sel()}, g AS (SELECT year, CASE WHEN code IN ('N1', 'N4', 'N9') THEN 'group' ELSE 'rest' END AS side, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, count(*) AS n FROM x GROUP BY ALL) SELECT *, round(total / sum(total) OVER (PARTITION BY year) * 100, 4) AS share FROM g")
on_cube("ans13_multiples", lambda c: study.small_multiples(_rows(c, _Q)), f"{_sel(_Q)}, g AS (SELECT code, string_agg(year || ':' || value::DECIMAL(38, 2), ',' ORDER BY year) AS line, min(value) AS low, max(value) AS high FROM x GROUP BY code) SELECT *, min(low) OVER () AS common_low, max(high) OVER () AS common_high FROM g")
on_cube("ans14_spread", lambda c: statistics.inequality(_weighted(c, _A).withColumn("weight", F.lit(1.0))).select("year", "n", "decile_ratio", "cv"), f"{_sel(_A)} SELECT year, count(*) AS n, round(CASE WHEN quantile_cont(value, 0.1) > 0 THEN quantile_cont(value, 0.9) / quantile_cont(value, 0.1) END, 6) AS decile_ratio, round(stddev_pop(value) / avg(value), 6) AS cv FROM x GROUP BY year")
on_cube("ans15_neighbours", lambda c: statistics.moran(_rows(c).select("year", "code", "value"), _edges(c)).select("year", "moran", (F.col("moran") > F.col("expected")).alias("clustered")), f"""{_sel()}, z AS (SELECT year, code, value - avg(value) OVER (PARTITION BY year) AS z FROM x), g AS (SELECT z.year, z.code, z.z, avg(n.z) AS lag FROM z JOIN territory t ON t.territory_code = z.code JOIN territory u ON u.district_code = t.district_code AND u.level = 'region' AND u.territory_code <> t.territory_code JOIN z n ON n.year = z.year AND n.code = u.territory_code GROUP BY ALL),
  m AS (SELECT year, count(*) AS n, sum(z * z) AS low FROM z GROUP BY year) SELECT year, round(n / count(*) * sum(z * lag) / low, 6) AS moran, round(n / count(*) * sum(z * lag) / low, 6) > round(-1 / (n - 1), 6) AS clustered FROM g JOIN m USING (year) GROUP BY year, n, low""")
on_cube("ans16_convergence", lambda c: statistics.sigma_series(_rows(c), 10).agg(F.round(F.min_by("sigma", "year"), 6).alias("first_sigma"), F.round(F.max_by("sigma", "year"), 6).alias("last_sigma"), (F.regr_slope("sigma", "year") < 0).alias("converging")), f"{_sel()}, s AS (SELECT year, round(stddev_samp(ln(value)), 8) AS sigma FROM x WHERE value > 0 GROUP BY year HAVING count(*) >= 10) SELECT round(arg_min(sigma, year), 6) AS first_sigma, round(arg_max(sigma, year), 6) AS last_sigma, regr_slope(sigma, year) < 0 AS converging FROM s")
on_cube("ans19_places", lambda c: _rows(c).filter("year = 1998").select("code", F.rank().over(_by_value()).cast("long").alias("place")), f"{_sel()} SELECT code, rank() OVER (ORDER BY value) AS place FROM x WHERE year = 1998")
on_cube("ans20_base_year", lambda c: study.base_year(c.observation.filter((F.col("territory_code") == "N4") & F.col("series_key").isin(*_MANY)), 4), f"SELECT min(year) AS base_year FROM (SELECT year FROM observation WHERE territory_code = 'N4' AND series_key IN {_IN} AND value <> 0 GROUP BY year HAVING count(DISTINCT series_key) = 4)")
on_cube("ans23_comparable_from", lambda c: study.comparable_from(c.observation.select("series_key", (1994 + F.length("series_key") % 9).cast("long").alias("break_year")).distinct(), c.observation.select("series_key", "year").distinct()), "SELECT series_key, CASE WHEN max(year) - (1994 + length(series_key) % 9) + 1 >= 2 THEN 1994 + length(series_key) % 9 ELSE min(year) END AS comparable_from FROM observation GROUP BY series_key")
on_cube("ans22_position", lambda c: mart(c, "rank").filter("series_key = 'orders:00' and year = 2000").select("territory_code", F.round(1 - F.col("percentile"), 6).alias("favourable")), "SELECT territory_code, round(1 - percentile, 6) AS favourable FROM mart_rank WHERE series_key = 'orders:00' AND year = 2000", "rank")
on_cube("ans25_movement", lambda c: study.places_by_year(mart(c, "rank").filter(F.col("series_key") == _Q), (1999, 2000)).select("territory_code", "movement"), "SELECT territory_code, arg_min(rank_desc, year) - arg_max(rank_desc, year) AS movement FROM mart_rank WHERE series_key = 'orders:00' AND year IN (1999, 2000) GROUP BY territory_code", "rank")
on_cube("ans26_places_by_year", lambda c: study.places_by_year(mart(c, "rank").filter(F.col("series_key") == _S), (1997, 1998, 1999)), "SELECT territory_code, string_agg(year || ':' || rank_desc, ',' ORDER BY year) AS places, arg_min(rank_desc, year) - arg_max(rank_desc, year) AS movement FROM mart_rank WHERE series_key = 'revenue:00' AND year IN (1997, 1998, 1999) GROUP BY territory_code", "rank")
on_cube("ans30_passport", lambda c: study.passport(c.observation, mart(c, "rank"), mart(c, "coverage"), "N6"), """, o AS (SELECT series_key, year, value, lag(value) OVER (PARTITION BY series_key ORDER BY year) AS before, row_number() OVER (PARTITION BY series_key ORDER BY year DESC) AS i FROM observation WHERE territory_code = 'N6' AND value IS NOT NULL AND series_key IN (SELECT series_key FROM mart_coverage WHERE is_ready)),
  d AS (SELECT *, CASE WHEN before > 0 THEN (value / before - 1) * 100 ELSE value - before END AS c FROM o WHERE i = 1) SELECT d.series_key, d.year, d.value, round(c, 4) AS change, CASE WHEN c IS NULL THEN NULL WHEN abs(c) < 0.05 THEN 'same' WHEN c > 0 THEN 'up' ELSE 'down' END AS direction, rank_desc, ratio_to_country FROM d LEFT JOIN mart_rank r ON r.series_key = d.series_key AND r.year = d.year AND r.territory_code = 'N6'""", "rank", "coverage")
on_cube("ans33_month_map", lambda c: statistics.breaks(c.month.join(c.territory.filter("level = 'region' and not is_aggregate").select("territory_code"), "territory_code").filter("kind = 'level' and series_key = 'orders:00' and year = 2000").select(F.col("month").alias("year"), "value"), "equal", 4).withColumnRenamed("year", "month"), "SELECT month, i, round(lo + (hi - lo) * i / 4, 5) AS edge FROM (SELECT month, min(value) AS lo, max(value) AS hi FROM month_fact JOIN territory USING (territory_code) WHERE level = 'region' AND NOT is_aggregate AND kind = 'level' AND series_key = 'orders:00' AND year = 2000 GROUP BY month), range(5) r(i)")
on_cube("ans38_origin_of_year", lambda c: c.observation.filter("value is not null").groupBy("series_key", "year").agg(F.max_by("edition", F.struct(F.lit(1), "edition")).alias("edition"), F.count_distinct("edition").alias("editions")), "SELECT series_key, year, max(edition) AS edition, count(DISTINCT edition) AS editions FROM observation WHERE value IS NOT NULL GROUP BY ALL")
on_cube("ans40_map_finding", lambda c: _pairs(c).groupBy("year").agg(F.max_by("code", "value").alias("largest"), F.min_by("code", "value").alias("smallest"), F.count(F.when(F.col("value") > F.col("before"), 1)).alias("grew")), f"{_sel()} SELECT year, arg_max(code, value) AS largest, arg_min(code, value) AS smallest, count(*) FILTER (value > before) AS grew FROM {_PAIR} GROUP BY year")
on_cube("ans42_timeline_finding", lambda c: study.timeline_finding(_rows(c, "revenue:1-URGENT").filter(F.col("code").isin("N1", "N2", "N3", "N7"))), f"{_sel('revenue:1-URGENT')}, k AS (SELECT * FROM x WHERE code IN ('N1', 'N2', 'N3', 'N7')), y AS (SELECT year FROM k GROUP BY year HAVING count(DISTINCT code) = (SELECT count(DISTINCT code) FROM k)), g AS (SELECT code, min(year) AS first_year, max(year) AS last_year, round((arg_max(value, year) / arg_min(value, year) - 1) * 100, 4) AS growth FROM k WHERE year IN (SELECT year FROM y) GROUP BY code) SELECT *, rank() OVER (ORDER BY growth DESC NULLS LAST) AS place FROM g")

# Words and questions

_WORDS = "regexp_extract_all(replace(lower(trim({0})), 'ё', 'е'), '([0-9a-zà-ÿа-я²³%]+)')"
_STEM = "CASE WHEN length({0}) > 4 THEN regexp_replace({0}, '^(.{{3,}}?)(ings|ing|ed|es|s|ly)$', '\\1') ELSE {0} END"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_VOCABULARY = lambda b: b.select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
on_tables("txt05_typo_pairs", lambda b: search.one_typo_pairs(_VOCABULARY(b).withColumnRenamed("word", "term"), _VOCABULARY(b)), "benchmark", f"WITH v AS (SELECT DISTINCT unnest({_WORDS.format('text')}) AS w FROM benchmark), u AS (SELECT w, translate(w, 'àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$&(') AS c FROM v) SELECT a.w AS term, b.w AS word FROM u a JOIN u b ON a.w <> b.w AND abs(length(a.c) - length(b.c)) <= 1 WHERE damerau_levenshtein(a.c, b.c) = 1")
on_tables("txt05_one_typo_or_not", lambda n: n.select("n_name", F.explode(F.array(*[F.struct(F.lit(k).alias("case"), e.alias("other")) for k, e in _misspelt(F.col("n_name")).items()])).alias("o")).select("n_name", "o.*", T.one_typo(F.col("n_name"), F.col("o.other")).alias("typo")).filter("not (case = 'apart' and other = n_name)"), "nation", """
  SELECT n_name, "case", other, "case" IN ('changed', 'added', 'left out', 'swapped') AND other <> n_name AS typo FROM (SELECT n_name, unnest(['changed', 'added', 'left out', 'swapped', 'same', 'two letters', 'apart']) AS "case",
    unnest([left(n_name, 1) || '#' || substr(n_name, 3), left(n_name, 2) || '#' || substr(n_name, 3), left(n_name, 1) || substr(n_name, 3), substr(n_name, 2, 1) || left(n_name, 1) || substr(n_name, 3), n_name, '##' || substr(n_name, 3), substr(n_name, 3, 1) || substr(n_name, 2, 1) || left(n_name, 1) || substr(n_name, 4)]) AS other FROM nation)
  WHERE NOT ("case" = 'apart' AND substr(n_name, 3, 1) = left(n_name, 1))""")


on_tables("txt03_stem", lambda d: d.select(F.explode(T.words(F.col("text"))).alias("word")).distinct().select("word", T.stem(F.col("word")).alias("stem")), "conversations", f"SELECT word, {_STEM.format('word')} AS stem FROM (SELECT DISTINCT unnest({_WORDS.format('text')}) AS word FROM conversations)")
on_tables("txt04_stems", lambda d: d.select("conv_id", "turn", F.array_join(T.stems(F.col("text")), " ").alias("stems")), "conversations", f"SELECT conv_id, turn, array_to_string([{_STEM.format('w')} for w in {_WORDS.format('text')} if w NOT IN ({_STOP})], ' ') AS stems FROM conversations")
on_tables("txt06_same_stem", lambda n: _crossed(n).select("a", "b", T.same_stem(F.col("a"), F.col("b")).alias("same")).filter("same"), "nation", "SELECT a, b, true AS same FROM (SELECT x.n_name AS a, substr(y.n_name, 1, length(y.n_name) - k) AS b FROM nation x, nation y, range(5) r(k)) WHERE least(length(a), length(b)) >= 5 AND abs(length(a) - length(b)) <= 3 AND (starts_with(a, b) OR starts_with(b, a))")


def _crossed(nation: DataFrame) -> DataFrame:
    cut = F.explode(F.sequence(F.lit(0), F.lit(4)))
    other = nation.select(F.col("n_name").alias("full"), cut.alias("k")).select(F.substr("full", F.lit(1), F.length("full") - F.col("k")).alias("b"))
    return nation.select(F.col("n_name").alias("a")).crossJoin(F.broadcast(other))


on_tables("txt07_swapped_stems", lambda n: n.select("n_name", F.array_join(T.swapped_stems(F.lower("n_name")), ",").alias("stems")), "nation", f"SELECT n_name, string_agg(s, ',' ORDER BY s) AS stems FROM (SELECT DISTINCT n_name, {_STEM.format('v')} AS s FROM (SELECT n_name, substr(lower(n_name), 1, k - 1) || substr(lower(n_name), k + 1, 1) || substr(lower(n_name), k, 1) || substr(lower(n_name), k + 2) AS v FROM (SELECT n_name, unnest(range(1, length(n_name))) AS k FROM nation))) GROUP BY n_name")
on_tables("txt09_expand_prefix", lambda d, n: search.expand(_vocabulary(d), d.select(F.explode(T.words(F.col("text"))).alias("w")).select(F.substring("w", 1, 5).alias("term")).filter("length(term) = 5").distinct()).filter("factor > 0.7"), "benchmark nation", f"""
  WITH v AS (SELECT DISTINCT unnest({_WORDS.format('text')}) AS word FROM benchmark), t AS (SELECT DISTINCT substr(word, 1, 5) AS term FROM v WHERE length(word) >= 5)
  SELECT term, word, CASE WHEN term = word THEN 1.0 ELSE 0.8 END::DOUBLE AS factor FROM t JOIN v ON starts_with(word, term)""")


def _vocabulary(d: DataFrame) -> DataFrame:
    return d.select("item_id", F.explode(T.words(F.col("text"))).alias("term")).groupBy("term").agg(F.count_distinct("item_id").alias("df"))


on_tables("txt11_weighted_fields", lambda p: search.postings(p.select("p_partkey", "p_name", F.lower("p_type").alias("kind")), "p_partkey", {"p_name": 3.0, "kind": 0.5}), "part", "SELECT key, term, sum(w) AS tf FROM (SELECT p_partkey AS key, unnest(string_split(p_name, ' ')) AS term, 3.0::DOUBLE AS w FROM part UNION ALL SELECT p_partkey, lower(p_type), 0.5 FROM part) GROUP BY ALL")


def _asked(nation: DataFrame) -> DataFrame:
    """Questions about nations: a row for each nation and form of question."""
    name = F.initcap("n_name")
    forms = F.array(
        F.concat(F.lit("Why did revenue of "), name, F.lit(" fall?")), F.concat(F.lit("Compare "), name, F.lit(" with the world")), F.concat(F.lit("How did orders of "), name, F.lit(" change since 1996")),
        F.concat(F.lit("Which place has the highest revenue after "), name, F.lit("?")), F.concat(F.lit("How is revenue of "), name, F.lit(" measured?")), F.concat(F.lit("Revenue "), name),
    )
    return nation.select("n_nationkey", F.posexplode(forms).alias("k", "text"))


_FORMS = "(SELECT n_nationkey, n_name, k FROM nation, range(6) r(k))"
on_tables("txt12_places_in_questions", lambda n: search.find_places(_asked(n).select(F.concat_ws("-", "n_nationkey", "k").alias("question"), "text"), n.select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("name"))), "nation", f"SELECT n_nationkey || '-' || k AS question, 'N' || n_nationkey AS code FROM {_FORMS}")
on_tables("txt14_special_kinds", lambda n: _asked(n).select("n_nationkey", F.col("k").cast("long").alias("k"), study.special_kind(F.col("text")).alias("kind")).filter("kind is not null"), "nation", f"SELECT n_nationkey, k, CASE k WHEN 0 THEN 'why' ELSE 'method' END AS kind FROM {_FORMS} WHERE k IN (0, 4)")
on_tables("txt15_plain_kinds", lambda n: _asked(n).select("n_nationkey", F.col("k").cast("long").alias("k"), study.plain_kind(F.col("text"), F.lit(1)).alias("kind")), "nation", f"SELECT n_nationkey, k, CASE k WHEN 1 THEN 'compare' WHEN 2 THEN 'trend' WHEN 3 THEN 'rank' ELSE 'value' END AS kind FROM {_FORMS}")
on_tables("txt16_confident", lambda p: study.confident(p.select(F.col("p_brand").alias("question"), F.col("p_partkey").alias("key"), F.split("p_name", " ").alias("words")), p.groupBy(F.col("p_brand").alias("question")).agg(F.split(F.min("p_name"), " ").alias("content"))), "part", "SELECT p_brand AS question, p_partkey AS key FROM part JOIN (SELECT p_brand, min(p_name) AS m FROM part GROUP BY 1) USING (p_brand) WHERE list_has_all(string_split(p_name, ' '), string_split(m, ' '))")
on_tables("txt17_feasible", lambda n: n.select("n_nationkey", study.feasible(F.element_at(F.array(*[F.lit(k) for k in ("compare", "relation", "value", "define")]), (F.col("n_nationkey") % 4 + 1).cast("int")), F.col("n_nationkey") % 3, F.col("n_regionkey") % 3).alias("feasible")), "nation", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_nationkey % 3 >= 2 AND n_regionkey % 3 >= 1 WHEN 1 THEN n_regionkey % 3 >= 2 ELSE n_regionkey % 3 >= 1 END AS feasible FROM nation")
on_cube("txt18_rank_answer", lambda c: mart(c, "rank").filter("series_key = 'revenue:00' and year = 1999 and (rank_desc <= 3 or rank_asc <= 3 or territory_code = 'N6')").select("territory_code", "value", "rank_desc", (F.col("territory_code") == "N6").alias("own")), "SELECT territory_code, value, rank_desc, territory_code = 'N6' AS own FROM mart_rank WHERE series_key = 'revenue:00' AND year = 1999 AND (rank_desc <= 3 OR rank_asc <= 3 OR territory_code = 'N6')", "rank")
on_cube("txt19_value_answer", lambda c: study.answer_value(c.observation, mart(c, "rank"), c.territory.select(F.col("territory_code").alias("question"), F.lit(_S).alias("series_key"), "territory_code")), """, o AS (SELECT territory_code AS question, series_key, territory_code, year, value FROM observation WHERE series_key = 'revenue:00' AND value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY territory_code ORDER BY year DESC) = 1)
  SELECT question, o.series_key, o.territory_code, o.year, o.value, rank_desc, country_value FROM o LEFT JOIN mart_rank r ON r.series_key = o.series_key AND r.year = o.year AND r.territory_code = o.territory_code LEFT JOIN country k ON k.series_key = o.series_key AND k.year = o.year""", "rank")
on_cube("txt20_compare_answer", lambda c: study.answer_compare(c.observation, _S, "N2", "R1"), "SELECT a.year, a.value AS first, b.value AS second, round(a.value / nullif(b.value, 0), 6) AS ratio FROM observation a JOIN observation b USING (series_key, year) WHERE series_key = 'revenue:00' AND a.territory_code = 'N2' AND b.territory_code = 'R1' AND a.value IS NOT NULL AND b.value IS NOT NULL")
on_cube("txt21_trend_answer", lambda c: _rows(c).select("code", "year", "value").join(_rows(c).select("code", (F.col("year") + 5).alias("year"), F.col("value").alias("before")), ["code", "year"]).select("code", "year", F.round((F.col("value") / F.col("before") - 1) * 100, 4).alias("growth")), f"{_sel()} SELECT a.code, a.year, round((a.value / b.value - 1) * 100, 4) AS growth FROM x a JOIN x b ON b.code = a.code AND b.year = a.year - 5")
on_cube("txt22_relation_answer", lambda c: study.related(_long(c, 2000), _A), _LONG.replace("1999", "2000") + """, p AS (SELECT b."column" AS other, a.value AS x, b.value AS y FROM l a JOIN l b USING (code) WHERE a."column" = 'avg_price:00' AND b."column" <> 'avg_price:00'),
  r AS (SELECT other, rank() OVER (PARTITION BY other ORDER BY x) + (count(*) OVER (PARTITION BY other, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY other ORDER BY y) + (count(*) OVER (PARTITION BY other, y) - 1) / 2 AS ry FROM p), s AS (SELECT other, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY other) SELECT *, row_number() OVER (ORDER BY abs(spearman) DESC, other) AS place FROM s""")

# Tables of text

#: Labels of every rule as SQL over n_name, n_nationkey (k) and n_regionkey (r), and what they are: step, kind, code, candidates.
_LABELS = (
    ("(900 + k)::VARCHAR", "code", "exact", "c", "''"),
    ("(900 + k)::VARCHAR || ' some place'", "coded", "exact", "c", "''"),
    ("CASE WHEN k % 2 = 0 THEN 'Total' ELSE 'of which:' END", "quiet", "none", "NULL", "''"),
    ("'my place ' || k", "remembered", "remembered", "c", "''"),
    ("'  ' || n_name || ' 1)'", "exact", "exact", "c", "''"),
    ("'former ' || n_name", "outside", "outside", "NULL", "''"),
    ("'twin ' || r", "ambiguous", "ask", "NULL", "(SELECT string_agg('N' || n_nationkey, ',' ORDER BY 'N' || n_nationkey) FROM nation WHERE n_regionkey = r)"),
    ("'The Republic of ' || n_name", "short", "exact", "c", "''"),
    ("n_name || ' (in its borders of 1999)'", "qualified", "exact", "c", "''"),
    ("(SELECT string_agg(n_name, ' and ' ORDER BY n_name) FROM nation WHERE n_regionkey = r)", "composite", "exact", "'R' || r", "''"),
    ("'NATION_0 and ' || CASE k WHEN 0 THEN 'NATION_1' ELSE n_name END", "composite", "outside", "NULL", "''"),
    ("'Orders of the world without ' || n_name", "country phrase", "ask", "NULL", "'W'"),
    ("n_name || ' Trading Company'", "organisation", "outside", "NULL", "''"),
    ("'City near ' || n_name", "municipal", "municipal", "NULL", "''"),
    ("'LAN OF ' || n_name", "fuzzy", "fuzzy", "c", "''"),
    ("left(n_name, 4) || substr(n_name, 6)", "fuzzy", "ask", "NULL", "c"),
    ("'qzx' || k", None, "none", "NULL", "''"),
)


def _directory(nation: DataFrame) -> labels.Directory:
    code = F.concat(F.lit("N"), "n_nationkey").alias("code")
    named = lambda text: nation.select(F.expr(text).alias("name"), code)
    world = nation.limit(1).select(F.lit("World").alias("name"), F.lit("W").alias("code"))
    return labels.Directory(
        names=named("n_name").unionByName(named("concat('LAND OF ', n_name)")).unionByName(world), codes=nation.select((900 + F.col("n_nationkey")).alias("number"), code), aliases=named("concat('twin ', n_regionkey)"), outside=named("concat('former ', n_name)").select("name"),
        remembered=named("concat('My place ', n_nationkey)").select(F.col("name").alias("label"), "code"), parts=nation.select(F.concat(F.lit("R"), "n_regionkey").alias("whole"), F.col("n_name").alias("name")), country="W",
    )


def _all_labels(nation: DataFrame) -> DataFrame:
    n, k, r = F.col("n_name"), F.col("n_nationkey"), F.col("n_regionkey")
    put = lambda *x: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in x])
    region = nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), " and ").alias("together"))
    texts = (
        put((900 + k).cast("string")), put((900 + k).cast("string"), " some place"), F.when(k % 2 == 0, "Total").otherwise("of which:"), put("my place ", k), put("  ", n, " 1)"), put("former ", n), put("twin ", r), put("The Republic of ", n), put(n, " (in its borders of 1999)"), F.col("together"),
        put("NATION_0 and ", F.when(k == 0, "NATION_1").otherwise(n)), put("Orders of the world without ", n), put(n, " Trading Company"), put("City near ", n), put("LAN OF ", n), put(F.left(n, F.lit(4)), F.substr(n, F.lit(6))), put("qzx", k),
    )
    return nation.join(region, "n_regionkey").select(F.explode(F.array(*texts)).alias("label"))


on_tables("txt24_cascade", lambda n: labels.match_cascade(_all_labels(n), _directory(n)), "nation", " UNION ".join(
    f"SELECT {text} AS label, {repr(step) if step else 'NULL'} AS step, '{kind}' AS kind, {code} AS code, {candidates} AS candidates FROM (SELECT n_name, n_nationkey AS k, n_regionkey AS r, 'N' || n_nationkey AS c FROM nation)" for text, step, kind, code, candidates in _LABELS
))
on_tables("txt26_composites", lambda n: recognise.composites(n.select(F.concat(F.lit("x and "), "n_name").alias("label")).unionByName(_region_labels(n)), n.select(F.concat(F.lit("R"), "n_regionkey").alias("whole"), F.col("n_name").alias("name"))), "nation", "SELECT string_agg(n_name, ' and ' ORDER BY n_nationkey) AS label, 'R' || n_regionkey AS whole FROM nation GROUP BY n_regionkey")


def _region_labels(nation: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return nation.groupBy("n_regionkey").agg(F.array_join(F.transform(listed, lambda s: s["n_name"]), " and ").alias("label")).select("label")


def _cells(customer: DataFrame, nation: DataFrame) -> DataFrame:
    rows = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    cells = {"place": F.initcap("n_name"), "period": (1990 + F.col("c_custkey") % 12).cast("string"), "number": F.replace(F.round("c_acctbal", 2).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")), "segment": F.col("c_mktsegment"), "name": F.col("c_name")}
    return rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("column"), v.alias("cell")) for k, v in cells.items()])).alias("c")).select("c.*")


_CELL_ROLES = """SELECT 'place' AS "column", (SELECT count(DISTINCT c_nationkey) FROM customer) AS regions, 0.0::DOUBLE AS numbers, (SELECT count(DISTINCT c_nationkey) FROM customer) AS "distinct", 'territory' AS role
  UNION ALL SELECT 'period', 0, 1.0, (SELECT count(DISTINCT c_custkey % 12) FROM customer), 'period' UNION ALL SELECT 'number', 0, 1.0, (SELECT count(DISTINCT round(c_acctbal, 2)) FROM customer), 'value'
  UNION ALL SELECT 'segment', 0, 0.0, (SELECT count(DISTINCT c_mktsegment) FROM customer), 'slice' UNION ALL SELECT 'name', 0, 0.0, count(DISTINCT c_name), CASE WHEN count(DISTINCT c_name) <= 300 THEN 'slice' ELSE 'text' END FROM customer"""
on_tables("txt30_column_roles", lambda c, n: recognise.column_roles(_cells(c, n), n.select(F.col("n_name").alias("name"))), "customer nation", _CELL_ROLES)
on_tables("txt29_territory_columns", lambda c, n: recognise.column_roles(_cells(c, n), n.select(F.col("n_name").alias("name"))).filter("role = 'territory'").select("column", "regions"), "customer nation", "SELECT 'place' AS \"column\", count(DISTINCT c_nationkey) AS regions FROM customer")
on_tables("txt31_duplicates", lambda o: recognise.duplicates(o.select("o_custkey", F.year("o_orderdate").cast("long").alias("year"), "o_orderpriority", "o_orderstatus"), ["o_custkey", "year", "o_orderpriority"], "o_orderstatus"), "orders", "SELECT o_custkey, year(o_orderdate) AS year, o_orderpriority, count(*) AS n, count(DISTINCT o_orderstatus) > 1 AS differ FROM orders GROUP BY ALL HAVING count(*) > 1")
on_tables("txt32_repeated_places", lambda c: recognise.repeated_places(c, "c_nationkey", "c_mktsegment", "c_acctbal"), "customer", "SELECT c_mktsegment, count(*) FILTER (v > 1) AS repeated, count(*) AS places FROM (SELECT c_mktsegment, c_nationkey, count(DISTINCT c_acctbal) AS v FROM customer GROUP BY ALL) GROUP BY ALL HAVING count(*) FILTER (v > 1) >= greatest(5, 0.5 * count(*))")
on_tables("txt33_style", lambda c: recognise.guess_style(c.select(F.when(F.col("c_custkey") % 10 == 0, "99999").otherwise(F.replace(F.round("c_acctbal", 2).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))).alias("cell")), "cell"), "customer", "SELECT ',' AS mark, bool_or(c_custkey % 10 = 0) AS has_code, 2::BIGINT AS decimals FROM customer")
on_tables("txt35_numeric_share", lambda d: d.groupBy("source").agg(F.round(recognise.numeric_share(F.split("text", " ")[0]), 6).alias("share")), "documents", "SELECT source, round(count(*) FILTER (regexp_full_match(c, '[-+]?[0-9]+([.,][0-9]+)?%?')) / nullif(count(*) FILTER (c <> ''), 0), 6) AS share FROM (SELECT source, trim(string_split(text, ' ')[1]) AS c FROM documents) GROUP BY source")
on_tables("txt34_cells_of_a_column", lambda c: _number_cells(c).select("c_custkey", T.cell_kind(F.col("cell")).alias("kind"), T.cell_value(F.col("cell")).alias("value")), "customer", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'hidden' WHEN 1 THEN 'missing' WHEN 2 THEN 'empty' ELSE 'value' END AS kind, CASE WHEN c_custkey % 6 > 2 THEN round(c_acctbal, 2)::DECIMAL(18, 2)::DOUBLE END AS value FROM customer")


def _number_cells(customer: DataFrame) -> DataFrame:
    k, number = F.col("c_custkey") % 6, F.round("c_acctbal", 2).cast("decimal(18,2)").cast("string")
    comma = F.replace(number, F.lit("."), F.lit(","))
    cell = F.when(k == 0, "…").when(k == 1, "–").when(k == 2, " ").when(k == 3, comma).when(k == 4, F.concat(comma, F.lit(" 1)"))).otherwise(F.concat(number, F.lit(" %")))
    return customer.select("c_custkey", cell.alias("cell"))


on_tables("dim27_periods_of_a_column", lambda o: _period_cells(o).withColumn("p", T.period(F.col("cell"))).select("cell", "p.year", "p.kind", "p.number"), "orders", """
  SELECT DISTINCT CASE m % 4 WHEN 0 THEN y::VARCHAR WHEN 1 THEN y || '-' || lpad(m::VARCHAR, 2, '0') WHEN 2 THEN 'Q' || (m % 4 + 1) || ' ' || y ELSE y || ' H' || (m % 2 + 1) END AS cell, y AS year, CASE m % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'quarter' ELSE 'half' END AS kind, CASE m % 4 WHEN 0 THEN 0 WHEN 1 THEN m WHEN 2 THEN m % 4 + 1 ELSE m % 2 + 1 END AS number
  FROM (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)""")


def _period_cells(orders: DataFrame) -> DataFrame:
    y, m = F.year("o_orderdate").cast("string"), F.month("o_orderdate")
    cell = F.when(m % 4 == 0, y).when(m % 4 == 1, F.concat(y, F.lit("-"), F.lpad(m.cast("string"), 2, "0"))).when(m % 4 == 2, F.concat(F.lit("Q"), m % 4 + 1, F.lit(" "), y)).otherwise(F.concat(y, F.lit(" H"), m % 2 + 1))
    return orders.select(cell.alias("cell")).distinct()


# Rules that find nothing in the tables as they are, on values with planted faults

on_cube("mrt16_planted_outliers", lambda c: statistics.outliers(_rows(c).select("year", "code", F.when(F.col("code") == "N7", F.col("value") * 20).otherwise(F.col("value")).alias("value"))), f"{_sel()}, p AS (SELECT year, code, CASE WHEN code = 'N7' THEN value * 20 ELSE value END AS value FROM x), q AS (SELECT year, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM p GROUP BY year HAVING count(*) >= 10) SELECT year, code, value FROM p JOIN q USING (year) WHERE b > a AND (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))")
_JUMPED = lambda c: replace(c, observation=c.observation.withColumn("value", F.when(F.col("year") >= 1999, F.col("value") * 1000).otherwise(F.col("value"))))
on_cube("mrt13_planted_jumps", lambda c: quality.scale_jumps(_JUMPED(c)), """, m AS (SELECT series_key, year, median(abs(CASE WHEN year >= 1999 THEN value * 1000 ELSE value END)) AS m FROM reg WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 10), j AS (SELECT series_key, year, greatest(m / b, b / m) AS jump FROM (SELECT *, lag(m) OVER (PARTITION BY series_key ORDER BY year) AS b FROM m) WHERE b > 0 AND m > 0)
  SELECT series_key, year, round(jump, 2) AS jump FROM j WHERE jump BETWEEN 500 AND 2000 OR jump BETWEEN 500000 AND 2000000""")

"""The cube and its marts as SQL for the comparison engine; written apart from the Spark plans."""

CUBE = """
WITH member AS (
  SELECT n_nationkey, 'N' || n_nationkey AS territory_code FROM nation UNION ALL SELECT n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT n_nationkey, 'W' FROM nation UNION ALL SELECT n_nationkey, 'A0' FROM nation WHERE n_nationkey < 2),
territory AS (
  SELECT 'W' AS territory_code, 'WORLD' AS name, 'country' AS level, NULL::VARCHAR AS district_code, false AS is_aggregate, 0::BIGINT AS display_order
  UNION ALL SELECT 'A0', 'NATIONS 0 AND 1', 'region', NULL, true, 100
  UNION ALL SELECT 'R' || r_regionkey, r_name, 'federal_district', 'R' || r_regionkey, false, r_regionkey + 1 FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'region', 'R' || n_regionkey, false, n_nationkey + 10 FROM nation),
ord AS (
  SELECT o_orderkey, m.territory_code, year(o_orderdate)::BIGINT AS year, month(o_orderdate)::BIGINT AS month, o_orderpriority AS p, c_mktsegment AS s
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN member m ON m.n_nationkey = c_nationkey),
sliced AS (SELECT *, CASE d WHEN 0 THEN '00' WHEN 1 THEN p ELSE p || '/' || s END AS slice FROM ord, range(3) r(d)),
cnt AS (SELECT slice, territory_code, year, count(*)::BIGINT AS n_orders FROM sliced GROUP BY ALL),
li AS (SELECT l_orderkey, l_linenumber AS edition, round(l_extendedprice * 100)::BIGINT AS gross, round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT) AS money, round(l_quantity)::BIGINT AS pieces FROM lineitem),
cell AS (SELECT slice, territory_code, year, edition, sum(money) AS money, sum(gross) AS gross, sum(pieces) AS pieces FROM sliced JOIN li ON l_orderkey = o_orderkey GROUP BY ALL),
running AS (
  SELECT k.slice, k.territory_code, k.year, e.edition, sum(c.money) OVER w AS money, sum(c.gross) OVER w AS gross, sum(c.pieces) OVER w AS pieces
  FROM (SELECT DISTINCT slice, territory_code, year FROM cell) k CROSS JOIN (SELECT DISTINCT edition FROM cell) e
  LEFT JOIN cell c ON c.slice = k.slice AND c.territory_code = k.territory_code AND c.year = k.year AND c.edition = e.edition
  WINDOW w AS (PARTITION BY k.slice, k.territory_code, k.year ORDER BY e.edition ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
val AS (SELECT r.*, coalesce(n_orders, 0) < 3 AS hid FROM running r LEFT JOIN cnt USING (slice, territory_code, year) WHERE money IS NOT NULL),
seen AS (
  SELECT 'revenue:' || slice AS series_key, territory_code, year, edition, hid, money::DOUBLE / 10000.0::DOUBLE AS value FROM val
  UNION ALL SELECT 'quantity:' || slice, territory_code, year, edition, hid, pieces::DOUBLE FROM val
  UNION ALL SELECT 'avg_price:' || slice, territory_code, year, edition, hid, ((gross * 200 + pieces) // (2 * pieces))::DOUBLE / 10000.0::DOUBLE FROM val
  UNION ALL SELECT 'orders:' || slice, territory_code, year, 1, n_orders < 3, n_orders::DOUBLE FROM cnt),
vintage AS (
  SELECT series_key, territory_code, year, edition::BIGINT AS edition, CASE WHEN NOT hid THEN value END AS value, CASE WHEN hid THEN 2 ELSE 0 END::BIGINT AS quality FROM seen
  UNION ALL
  SELECT m || ':' || slice, territory_code, year, 1, NULL, 1
  FROM (SELECT DISTINCT slice FROM cnt), (SELECT territory_code FROM territory), (SELECT DISTINCT year FROM cnt), (VALUES ('revenue'), ('quantity'), ('orders'), ('avg_price')) v(m)
  WHERE (m || ':' || slice, territory_code, year) NOT IN (SELECT (series_key, territory_code, year) FROM seen)),
observation AS (
  SELECT v.series_key, v.territory_code, v.year, v.value, v.quality, v.edition, greatest((SELECT count(DISTINCT x.value) FROM vintage x WHERE x.series_key = v.series_key AND x.territory_code = v.territory_code AND x.year = v.year) - 1, 0) AS revision_count,
    t.level AS territory_level, t.district_code, t.is_aggregate
  FROM (SELECT *, row_number() OVER (PARTITION BY series_key, territory_code, year ORDER BY value IS NULL, edition DESC) AS rn FROM vintage) v JOIN territory t USING (territory_code) WHERE rn = 1),
reg AS (SELECT * FROM observation WHERE territory_level = 'region' AND NOT is_aggregate),
lev AS (
  SELECT 'revenue:00' AS series_key, territory_code, year, month, (sum(money)::DOUBLE / 10000.0::DOUBLE) AS value FROM ord JOIN li ON l_orderkey = o_orderkey GROUP BY ALL
  UNION ALL SELECT 'orders:00', territory_code, year, month, count(*)::DOUBLE FROM ord GROUP BY ALL),
month_fact AS (
  SELECT series_key, territory_code, year, month, 'level' AS kind, value FROM lev
  UNION ALL SELECT series_key, territory_code, year, month, 'ytd', round(total, 4) FROM (SELECT *, count(value) OVER w AS k, sum(value) OVER w AS total FROM lev WINDOW w AS (PARTITION BY series_key, territory_code, year ORDER BY month ROWS UNBOUNDED PRECEDING)) WHERE k = month
  UNION ALL SELECT a.series_key, a.territory_code, a.year, a.month, 'yoy', round(a.value / b.value * 100, 4) FROM lev a JOIN lev b ON b.series_key = a.series_key AND b.territory_code = a.territory_code AND b.year = a.year - 1 AND b.month = a.month WHERE b.value > 0),
population AS (SELECT territory_code, count(*)::DOUBLE AS population FROM customer JOIN member ON n_nationkey = c_nationkey GROUP BY ALL),
country AS (SELECT series_key, year, value AS country_value FROM observation WHERE territory_level = 'country')
"""

STATS = """,
mart_stats AS (
  SELECT a.*, round(CASE WHEN mean > 0 THEN stddev / mean END, 4) AS cv, round(CASE WHEN p10 > 0 THEN p90 / p10 END, 4) AS decile_ratio, round(CASE WHEN "min" > 0 THEN "max" / "min" END, 4) AS range_ratio, country_value
  FROM (SELECT series_key, year, count(value) AS observations, round(avg(value), 8) AS mean, round(median(value), 6) AS median, min(value) AS "min", max(value) AS "max", round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25,
      round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90, round(stddev_samp(value), 4) AS stddev, round(sum(value), 4) AS sum FROM reg WHERE value IS NOT NULL GROUP BY series_key, year HAVING count(value) >= 2) a
  LEFT JOIN country USING (series_key, year))
"""

RANK = """,
mart_rank AS (
  SELECT series_key, year, territory_code, value, rank_desc, rank_asc, round((rank_asc - 1) / nullif(n - 1, 0), 6) AS percentile,
    (CASE WHEN rank_desc - 1 < (n // 5 + 1) * (n % 5) THEN (rank_desc - 1) // (n // 5 + 1) + 1 ELSE (rank_desc - 1 - (n // 5 + 1) * (n % 5)) // nullif(n // 5, 0) + n % 5 + 1 END)::BIGINT AS quintile,
    round(CASE WHEN value >= 0 AND total > 0 THEN value / total END, 6) AS share_of_total, round(CASE WHEN country_value <> 0 THEN value / country_value END, 6) AS ratio_to_country
  FROM (SELECT r.*, country_value, count(*) OVER y AS n, rank() OVER (PARTITION BY series_key, year ORDER BY value DESC) AS rank_desc, rank() OVER (PARTITION BY series_key, year ORDER BY value) AS rank_asc, sum(CASE WHEN value >= 0 THEN value END) OVER y AS total
    FROM reg r LEFT JOIN country USING (series_key, year) WHERE value IS NOT NULL WINDOW y AS (PARTITION BY series_key, year)))
"""

COVERAGE = """,
yearly AS (SELECT series_key, year, count(*) AS n FROM reg WHERE value IS NOT NULL GROUP BY ALL),
runs AS (SELECT series_key, max(c) AS longest_span FROM (SELECT series_key, count(*) AS c FROM (SELECT *, year - row_number() OVER (PARTITION BY series_key ORDER BY year) AS island FROM (SELECT *, max(n) OVER (PARTITION BY series_key) AS peak FROM yearly) WHERE n >= 0.5 * peak) GROUP BY series_key, island) GROUP BY series_key),
mart_coverage AS (
  SELECT b.*, longest_span, round(observed / nullif(regions * (last_year - first_year + 1), 0), 4) AS completeness, region_coverage >= 0.8 AND years >= 5 AS is_ready
  FROM (SELECT *, round(regions / (SELECT count(*) FROM territory WHERE level = 'region' AND NOT is_aggregate), 4) AS region_coverage FROM
    (SELECT series_key, count(*) FILTER (quality = 0) AS observed, count(*) FILTER (quality = 1) AS no_data, count(*) FILTER (quality = 2) AS hidden, count(DISTINCT territory_code) FILTER (value IS NOT NULL) AS regions, count(DISTINCT year) FILTER (value IS NOT NULL) AS years,
      min(year) FILTER (value IS NOT NULL) AS first_year, max(year) FILTER (value IS NOT NULL) AS last_year FROM reg GROUP BY series_key)) b LEFT JOIN runs USING (series_key))
"""

REVISION = """,
mart_revision AS (
  SELECT series_key, territory_code, year, edition_count, first_value, last_value, round(last_value - first_value, 4) AS abs_change, round(CASE WHEN first_value <> 0 THEN (last_value - first_value) / abs(first_value) END, 6) AS rel_change
  FROM (SELECT series_key, territory_code, year, count(*) AS edition_count, count(DISTINCT value) AS v, arg_min(value, edition) AS first_value, arg_max(value, edition) AS last_value FROM vintage WHERE value IS NOT NULL GROUP BY ALL) WHERE v > 1)
"""


def sql(select: str, *marts: str) -> str:
    """``select`` over the cube's relations and the marts named."""
    parts = {"stats": STATS, "rank": RANK, "coverage": COVERAGE, "revision": REVISION}
    return CUBE + "".join(parts[m] for m in marts) + select

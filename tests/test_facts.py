"""Rules on vintages against cases made by hand."""

from tessera.operators import facts

CODES = [f"R{i:02d}" for i in range(12)]


def years_left(spark, series, editions=None, extra=()):
    """Years (and editions) that stay of year -> values of 12 regions and the country."""
    rows = [("s", c, year, (editions or {}).get(year, 7), v) for year, values in series.items() for c, v in zip([*CODES, "W"], [*values, sum(values)], strict=True)]
    vintage = spark.createDataFrame([*rows, *extra], "series_key string, territory_code string, year long, edition long, value double")
    regions = spark.createDataFrame([(c,) for c in CODES], "territory_code string")
    left = facts.without_copied_years(vintage, facts.copied_years(vintage, regions))
    return sorted({(r.year, r.edition) for r in left.collect()})


def values(year):
    return [float(year * 10 + i * 7 % 11) for i in range(12)]


def test_copied_years(spark):
    block = {y: values(y) for y in range(2019, 2024)}
    own = [(y, 7) for y in block]
    assert years_left(spark, block | {2011: block[2023]}) == own  # apart from the run: gone, the country too
    zeros = [("s", c, 2011, 3, 0.0) for c in CODES]
    assert years_left(spark, block | {2011: block[2023]}, extra=zeros) == own  # from all editions
    assert years_left(spark, block | {2011: block[2021]}, {2011: 2, 2019: 2}) == [(2019, 2), *own[1:]]  # between editions
    long = {y: values(y) for y in range(2001, 2016)}
    assert years_left(spark, long | {2001: long[2014]}) == [(y, 7) for y in range(2002, 2016) if y != 2014]  # inside a run: both
    assert len(years_left(spark, dict.fromkeys(range(2005, 2016), values(2000)))) == 11  # a steady series
    assert len(years_left(spark, block | {2017: block[2020]})) == 6  # too near
    assert len(years_left(spark, block | {2011: [0.0] * 12, 2003: [0.0] * 12})) == 7  # zeros are no copy


def test_one_calm_pair_does_not_clear_the_series(spark):
    block = {y: values(y) for y in range(2015, 2024)}
    block[2016] = block[2015]
    assert [y for y, _ in years_left(spark, block | {2008: block[2022]})] == list(range(2015, 2024))


def test_releases_in_order(spark):
    """Continuing links, full, conditional and of another statistic, and superseding ones; later releases win, hidden values do not hide earlier ones."""
    dataset = [(s, t, y, float(100 * y % 7 + y)) for s in ("full", "other", "apart", "new") for t in ("A", "B") for y in range(2000, 2005)]
    as_it_is = {(s, t, y): v for s, t, y, v in dataset}
    first = [(s, t, y, as_it_is.get((s, t, y), 50.0) * (3 if s == "apart" else 1), False, 1) for s in ("full", "other", "apart", "new") for t in ("A", "B") for y in range(2001, 2006)]
    second = [
        ("full", "A", 2003, as_it_is["full", "A", 2003] * 9, False, 2),  # not the last year: the dataset stays
        *[("full", t, y, as_it_is["full", t, y], False, 2) for t in ("A", "B") for y in (2001, 2002)],
        *[("full", c, 2003, as_it_is["full", c, 2003], False, 2) for c in ("B",)],
        ("full", "A", 2004, as_it_is["full", "A", 2004] * 1.2, False, 2), ("full", "B", 2004, as_it_is["full", "B", 2004] * 1.001, False, 2), ("full", "C", 2004, 7.0, False, 2),
        ("full", "A", 2005, None, True, 2), ("full", "B", 2006, 60.0, False, 2),
        ("other", "A", 2004, 1.0, False, 2), ("other", "A", 2003, as_it_is["other", "A", 2003], False, 2), ("other", "A", 2006, 5.0, False, 2),
        ("apart", "A", 2003, 1.0, False, 2), ("apart", "A", 2004, 1.0, False, 2), ("apart", "B", 2005, 70.0, False, 2),
        ("new", "A", 2002, as_it_is["new", "A", 2002] * 2, False, 2), ("new", "B", 2002, as_it_is["new", "B", 2002], False, 2), ("new", "A", 2001, None, True, 2),
    ]
    releases = spark.createDataFrame([(*r[:5], False, r[5]) for r in first + second], "series_key string, territory_code string, year long, value double, hidden boolean, preliminary boolean, release long")
    links = spark.createDataFrame([("full", "continue", True), ("other", "continue", False), ("apart", "continue", True), ("new", "supersede", True)], "series_key string, mode string, same_statistic boolean")
    data = spark.createDataFrame(dataset, "series_key string, territory_code string, year long, value double")
    added = facts.stitch_releases(releases, data, links, 0.01, 0.8)
    kinds = {r.series_key: (r.kind, r.revised, r.junction_year, r.last_year) for r in facts.link_outcomes(added).collect()}
    assert kinds == {"full": ("full", 1, 2005, 2006), "other": ("full", 0, 2005, 2006), "apart": ("conditional", 0, 2005, 2005), "new": ("revision", 1, 2005, 2005)}
    by_cell = {(r.series_key, r.territory_code, r.year, r.release): r for r in added.collect()}
    assert {k[1:] for k in by_cell if k[0] == "full"} == {("A", 2005, 1), ("B", 2005, 1), ("A", 2004, 2), ("C", 2004, 2), ("A", 2005, 2), ("B", 2006, 2)}
    assert by_cell["full", "A", 2004, 2].flags == facts.EXTERNAL | facts.REVISED
    assert by_cell["full", "C", 2004, 2].flags == facts.EXTERNAL
    assert by_cell["full", "B", 2006, 2].flags == facts.EXTERNAL | facts.PRELIMINARY
    assert by_cell["apart", "B", 2005, 2].flags == facts.EXTERNAL | facts.CONDITIONAL | facts.PRELIMINARY
    assert {k[1:] for k in by_cell if k[0] == "other"} == {("A", 2005, 1), ("B", 2005, 1), ("A", 2006, 2)}
    assert {k[1:] for k in by_cell if k[0] == "new" and k[3] == 2} == {("A", 2002, 2), ("B", 2002, 2)}
    final = {(r.series_key, r.territory_code, r.year): (r.value, r.release) for r in facts.resolve_releases(added, data).collect()}
    assert final["full", "A", 2005] == (50.0, 1) and final["full", "A", 2004] == (as_it_is["full", "A", 2004] * 1.2, 2) and final["full", "A", 2003] == (as_it_is["full", "A", 2003], None)
    assert final["new", "A", 2002] == (as_it_is["new", "A", 2002] * 2, 2) and final["new", "A", 2000][1] is None
    assert len(final) == len({*as_it_is} | {k[:3] for k in by_cell})

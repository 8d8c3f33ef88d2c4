"""Every registered query outside ``llm`` against its SQL on DuckDB; those without SQL against what must hold."""

import os
import re
import subprocess
import sys

import pytest

import __spark_entry__
from tessera.queries import REGISTRY
from tests.compare import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in REGISTRY.items() if sql))
def test_same_as_sql(spark, con, name):
    run, sql = REGISTRY[name]
    assert_same(run(spark, SF), con, sql)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_imports_before_a_session_exists():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=os.path.dirname(__spark_entry__.__file__), capture_output=True, timeout=120)
    assert done.returncode == 0, done.stderr[-800:]


def test_pca_weights(spark):
    rows = REGISTRY["sta43_pca_weights"][0](spark, SF).collect()
    assert sum(r.weight for r in rows) == pytest.approx(1, abs=1e-4)
    assert all(r.weight >= 0 for r in rows)


def test_permutations_give_probabilities(spark):
    rows = REGISTRY["sta31_moran_permutations"][0](spark, SF).collect()
    assert rows and all(0 < r.p <= 1 for r in rows)


def test_jenks_edges_rise_and_split_better_than_equal_steps(spark):
    import numpy as np

    from tessera.plans.cube import load_cube

    edges: dict[int, list] = {}
    for r in sorted(REGISTRY["sta59_jenks"][0](spark, SF).collect(), key=lambda r: (r.year, r.i)):
        edges.setdefault(r.year, []).append(r.edge)
    values: dict[int, list] = {}
    for r in load_cube(spark, SF).regions.filter("series_key = 'revenue:00' and value is not null").select("year", "value").collect():
        values.setdefault(r.year, []).append(r.value)

    def inside(v, cuts):
        groups = np.searchsorted(cuts, v)
        return sum(((v[groups == g] - v[groups == g].mean()) ** 2).sum() for g in set(groups.tolist()))

    for year, cuts in edges.items():
        v = np.array(values[year])
        assert cuts == sorted(cuts)
        inner = np.array(cuts[1:-1]) - 1e-3  # an edge is the smallest value of the class that it begins
        assert inside(v, inner) <= inside(v, np.linspace(v.min(), v.max(), len(cuts))[1:-1]) * (1 + 1e-9)


def test_ols_solves_the_normal_equations(spark):
    import numpy as np

    from tessera.plans.cube import load_cube

    rows = load_cube(spark, SF).regions.filter("series_key in ('revenue:00', 'orders:00', 'avg_price:00') and year = 1999 and value is not null").select("series_key", "territory_code", "value").toPandas()
    wide = rows.pivot(index="territory_code", columns="series_key", values="value").dropna()
    x = np.column_stack([np.ones(len(wide)), wide["orders:00"], wide["avg_price:00"]])
    want = np.linalg.lstsq(x, wide["revenue:00"], rcond=None)[0]
    got = [r.coefficient for r in REGISTRY["sta20_ols"][0](spark, SF).collect()]
    assert sorted(got) == pytest.approx(sorted(want), rel=1e-3)


def test_editions_are_those_of_the_data(spark, tmp_path):
    import shutil

    from pyspark.sql import functions as F

    from tests.compare import TABLES

    for name in TABLES:
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_linenumber", F.when(F.col("l_linenumber") == 7, 11).otherwise(F.col("l_linenumber")))
    (tmp_path / "lineitem.parquet").unlink()
    lines.toPandas().to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    run, sql = REGISTRY["fct01_vintages"]
    frame = run(spark, str(tmp_path))
    assert frame.agg(F.max("edition")).first()[0] == 11
    assert_same(frame, connect(str(tmp_path)), sql)


def test_works_without_the_training_data_operators(tmp_path):
    import shutil

    home = os.path.dirname(__spark_entry__.__file__)
    shutil.copytree(home, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py"))
    for extra in (False, True):
        if extra and os.path.exists(f"{home}/corpus_pipeline.py"):
            shutil.copy(f"{home}/corpus_pipeline.py", tmp_path / "repo")
        done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 300 and len(e.oracle_sql()) > 300 and 'pipeline' not in e.queries()"], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, timeout=120)
        assert done.returncode == 0, done.stderr[-800:]


def test_cubes_can_be_released(spark, tmp_path):
    import shutil

    from tessera.plans import cube, marts

    for name in ("nation", "region", "orders", "customer", "lineitem"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    first = cube.load_cube(spark, str(tmp_path))
    assert cube.load_cube(spark, str(tmp_path)) is first
    marts.forget()
    assert cube.load_cube(spark, str(tmp_path)) is not first


def test_roles_of_columns_read_each_text_once(spark):
    from tessera.operators import recognise

    cells = [("place", x) for x in ("France", "FRANCE", "Peru", "china 1)", None, "")] * 3 + [("number", "1,5")] * 4 + [("number", x) for x in ("2,5", "…", None)] + [("empty", None), ("empty", " ")] + [("year", "1999")] * 9 + [("year", "x")]
    names = spark.createDataFrame([("FRANCE",), ("PERU",), ("CHINA",)], "name string")
    frame = recognise.column_roles(spark.createDataFrame(cells, "column string, cell string"), names)
    assert {tuple(r) for r in frame.collect()} == {("place", 3, 0.0, 5, "territory"), ("number", 0, 0.833333, 3, "value"), ("empty", 0, None, 1, "slice"), ("year", 0, 0.9, 2, "period")}
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.index("count(1)") > plan.index("Join")  # counted below the join with the names


def test_cubes_are_kept_in_few_partitions(spark):
    from tessera.plans import cube

    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        made = cube.build_cube(spark, SF)
        assert [frame.rdd.getNumPartitions() for frame in (made.vintage, made.observation, made.month)] == [cube.KEPT_PARTITIONS] * 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_marts_are_kept_in_few_partitions(spark, tmp_path):
    from tessera.plans import cube, marts

    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    (tmp_path / "sf").symlink_to(SF)  # a path that no other test keeps
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        made = cube.load_cube(spark, str(tmp_path / "sf"))
        assert [marts.mart(made, name).rdd.getNumPartitions() for name in ("stats", "rank", "coverage", "revision")] == [cube.KEPT_PARTITIONS] * 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("broadcast", [True, False])
def test_scores_are_summed_in_tasks_of_bounded_size(spark, con, monkeypatch, broadcast):
    from tessera.operators import search

    monkeypatch.setattr(search, "TASK_PAIRS", 10, raising=False)
    if not broadcast:
        monkeypatch.setattr(search, "MAX_TERMS", 10)
    run, sql = REGISTRY["txt10_bm25"]
    frame = run(spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    dealt = max([int(n) for n in re.findall(r"hashpartitioning\(key#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)], default=0)
    assert dealt > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert not re.search(r"keys=\[key#", plan)  # words are counted within their row
    assert_same(frame, con, sql)


def test_a_term_of_two_fields_counts_in_both(spark):
    from tessera.operators import search

    rows = [(1, "red red blue", "red"), (2, "blue", None), (3, "", "green green red"), (4, None, None), (5, "", ""), (6, "one two three", "four"), (7, "red", "five six")]
    texts = spark.createDataFrame(rows, "id long, a string, b string")
    asked = spark.createDataFrame([("q", "red"), ("q", "green"), ("r", "blue")], "query string, term string")
    both = texts.selectExpr("id", "concat_ws(' ', a, b) AS t")
    found = lambda frame, fields: sorted(map(tuple, search.bm25(frame, "id", fields, asked, stop_share=1.0).collect()))
    assert found(texts, {"a": 1.0, "b": 1.0}) == found(both, {"t": 1.0}) != []

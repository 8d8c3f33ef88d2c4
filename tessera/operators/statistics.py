"""Statistics of long rows: (year, code, value) with weights, districts or edges beside them.

Measures are aggregates and windows by year, so that any number of years and series is one job. Kernels that
iterate (Jenks, permutations, rank counts) run per group, in pandas or on Arrow tables, on a year's
regions, whose number the territory table bounds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _year() -> WindowSpec:
    return Window.partitionBy("year")


def inequality(rows: DataFrame, epsilon: float = 0.5) -> DataFrame:
    """Per year: weighted Gini, Theil, Atkinson and CV, decile and range ratio. Rows: year, code, value, weight.

    Gini asks for non-negative values, Theil and Atkinson for positive ones; otherwise they are null.
    """
    upto = _year().orderBy("value", "code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = rows.filter("value is not null and weight > 0").withColumn("s", F.col("weight") / F.sum("weight").over(_year()))
    w = w.withColumn("sx", F.col("s") * F.col("value")).withColumn("mu", F.sum("sx").over(_year())).withColumn("c", F.sum("sx").over(upto)).withColumn("r", F.when((F.col("value") > 0) & (F.col("mu") > 0), F.try_divide("value", "mu")))
    g = w.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.max("mu").alias("mu"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum(F.col("s") * (2 * F.col("c") - F.col("sx"))).alias("area"), F.sum(F.col("s") * F.col("r") * F.ln("r")).alias("t"),
        F.sum(F.col("s") * F.pow("r", F.lit(1 - epsilon))).alias("a"), F.sum(F.col("s") * F.pow(F.col("value") - F.col("mu"), 2)).alias("v"), F.percentile("value", 0.9).alias("q9"), F.percentile("value", 0.1).alias("q1"),
    )
    positive = F.col("least") > 0
    return g.select(
        "year", "n", F.round(F.when((F.col("least") >= 0) & (F.col("mu") > 0), 1 - F.col("area") / F.col("mu")), 6).alias("gini"), F.round(F.when(positive, F.col("t")), 6).alias("theil"),
        F.round(F.when(positive, 1 - F.pow("a", F.lit(1 / (1 - epsilon)))), 6).alias("atkinson"), F.round(F.when(F.col("mu") > 0, F.sqrt("v") / F.col("mu")), 6).alias("cv"), F.round(F.when(F.col("q1") > 0, F.col("q9") / F.col("q1")), 6).alias("decile_ratio"), F.round(F.when(positive, F.col("most") / F.col("least")), 6).alias("range_ratio"),
    )


def lorenz(rows: DataFrame) -> DataFrame:
    """Cumulative shares of weight and of weighted value, by rising value."""
    upto = _year().orderBy("value", "code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = lambda c: F.round(F.sum(c).over(upto) / F.sum(c).over(_year()), 6)
    return rows.filter("value >= 0 and weight > 0").withColumn("wx", F.col("weight") * F.col("value")).select("year", "code", part("weight").alias("people"), part("wx").alias("share"))


def theil_split(rows: DataFrame) -> DataFrame:
    """Theil between and within groups of positive values. Rows: year, group, value, weight."""
    w = rows.filter("value > 0 and weight > 0").withColumn("wx", F.col("weight") * F.col("value"))
    g = Window.partitionBy("year", "group")
    w = w.withColumn("gm", F.sum("wx").over(g) / F.sum("weight").over(g)).withColumn("mu", F.sum("wx").over(_year()) / F.sum("weight").over(_year())).withColumn("share", F.col("wx") / F.sum("wx").over(_year()))
    return w.groupBy("year").agg(F.round(F.sum(F.col("share") * F.ln(F.col("gm") / F.col("mu"))), 6).alias("between"), F.round(F.sum(F.col("share") * F.ln(F.col("value") / F.col("gm"))), 6).alias("within"))


def sigma_series(rows: DataFrame, least: int = 20) -> DataFrame:
    """Standard deviation of logarithms per year, of enough positive values."""
    return rows.filter("value > 0").groupBy("year").agg(F.round(F.stddev_samp(F.ln("value")), 8).alias("sigma"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def sigma_trend(rows: DataFrame) -> DataFrame:
    """Least squares of sigma on the year."""
    return sigma_series(rows).agg(F.round(F.regr_slope("sigma", "year"), 6).alias("slope"), F.round(F.regr_r2("sigma", "year"), 5).alias("r2"), F.count(F.lit(1)).alias("years"))


def beta_convergence(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Growth per year on the logarithm of the first value; speed and half-life of a negative slope."""
    at = lambda y: F.max(F.when(F.col("year") == y, F.col("value")))
    span = last - first
    pairs = rows.filter(F.col("year").isin(first, last)).groupBy("code").agg(at(first).alias("x0"), at(last).alias("x1")).filter("x0 > 0 and x1 > 0")
    fit = pairs.select(F.ln("x0").alias("x"), ((F.ln("x1") - F.ln("x0")) / span).alias("y")).agg(F.regr_slope("y", "x").alias("b"), F.regr_r2("y", "x").alias("r2"), F.count(F.lit(1)).alias("n"))
    speed = F.when((F.col("b") < 0) & (1 + F.col("b") * span > 0), -F.ln(1 + F.col("b") * span) / span)
    return fit.select(F.round("b", 6).alias("beta"), F.round("r2", 6).alias("r2"), "n", F.round(speed, 5).alias("speed"), F.round(F.when(speed > 0, math.log(2) / speed), 3).alias("half_life"))


def pairs_of(long: DataFrame) -> DataFrame:
    """All pairs of columns of long rows (column, code, value), on common codes."""
    a, b = (long.select(F.col("column").alias(n), "code", F.col("value").alias(v)) for n, v in (("a", "x"), ("b", "y")))
    return a.join(b, "code").filter("a < b and x is not null and y is not null")


def average_rank(value: str, *partition: str) -> Column:
    w = Window.partitionBy(*partition)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, value)) - 1) / 2


def correlations(long: DataFrame, least: int = 8) -> DataFrame:
    """Pearson and Spearman (average ranks) of all pairs of columns, of enough common codes."""
    p = pairs_of(long).withColumn("rx", average_rank("x", "a", "b")).withColumn("ry", average_rank("y", "a", "b"))
    out = p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman"))
    return out.filter(F.col("n") >= least)


def discordant(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs that x and y order in opposite ways: inversions of y along x, counted while equal halves are merged."""
    y = y[np.lexsort((y, x))]
    found, width = 0, 1
    while width < len(y):
        merged = y.copy()
        for at in range(0, len(y) - width, 2 * width):
            left, right = y[at : at + width], y[at + width : at + 2 * width]
            found += int((len(left) - np.searchsorted(left, right, side="right")).sum())
            merged[at : at + 2 * width] = np.sort(y[at : at + 2 * width], kind="stable")
        y, width = merged, 2 * width
    return found


def tau_b(x: np.ndarray, y: np.ndarray) -> float | None:
    """Kendall's tau-b; null if one of the two never changes."""
    pairs = lambda *columns: sum(int(n) * (int(n) - 1) // 2 for n in np.unique(np.stack(columns), axis=1, return_counts=True)[1])
    every = len(x) * (len(x) - 1) // 2
    moving_x, moving_y = every - pairs(x), every - pairs(y)
    agreeing = every - pairs(x) - pairs(y) + pairs(x, y) - 2 * discordant(x, y)
    return agreeing / math.sqrt(moving_x * moving_y) if moving_x and moving_y else None


def kendall(long: DataFrame, least: int = 8) -> DataFrame:
    """Tau-b of all pairs of columns with enough common codes. The codes of a pair are one group, as many as there are territories, and are counted in n log n."""

    def count(table: pa.Table) -> pa.Table:
        x, y = (table.column(c).to_numpy() for c in ("x", "y"))
        tau = tau_b(x, y)
        return pa.table({"a": table.column("a")[:1], "b": table.column("b")[:1], "n": pa.array([len(x)], pa.int64()), "tau": pa.array([None if tau is None else round(tau, 6)], pa.float64())})

    pairs = pairs_of(long).select("a", "b", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return pairs.groupBy("a", "b").applyInArrow(count, "a string, b string, n long, tau double").filter(F.col("n") >= least).drop("n")


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        term = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or 1e-300)
        c = 1 + term / c or 1e-300
        f *= c * d
        if i and abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_tail(t: float, dof: float) -> float:
    """Two-sided tail of Student's distribution."""
    return _beta_tail(dof / 2, 0.5, dof / (dof + t * t)) if math.isfinite(t) else 0.0


@F.pandas_udf(DoubleType())
def p_of_r(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation."""
    return pd.Series([1.0 if abs(x) != abs(x) else 0.0 if abs(x) >= 1 else t_tail(x * math.sqrt((k - 2) / (1 - x * x)), k - 2) for x, k in zip(r, n, strict=True)])


def benjamini_hochberg(rows: DataFrame, p: str = "p", key: str = "key", *by: str) -> DataFrame:
    """``rows`` with ``p_adjusted``: the least p * m / rank of this and all larger p-values, 1 at most; tests of one group of ``by`` are adjusted together."""
    every = Window.partitionBy(*by)
    ranked = rows.withColumn("_i", F.row_number().over(every.orderBy(p, key))).withColumn("_m", F.count(F.lit(1)).over(every))
    later = every.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("p_adjusted", F.least(F.min(F.col(p) * F.col("_m") / F.col("_i")).over(later), F.lit(1.0))).drop("_i", "_m")


def lag_profile(x: DataFrame, y: DataFrame, lags: int = 5, least: int = 8) -> DataFrame:
    """Correlation of x[t - k] with y[t] over all codes and years, for k from 0."""
    shifts = F.explode(F.sequence(F.lit(0), F.lit(lags)))
    moved = x.filter("value is not null").withColumn("k", shifts).select("code", (F.col("year") + F.col("k")).alias("year"), F.col("k").cast("long").alias("k"), F.col("value").alias("x"))
    both = moved.join(y.filter("value is not null").select("code", "year", F.col("value").alias("y")), ["code", "year"])
    return both.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("x", "y"), 6).alias("r")).filter(F.col("n") >= least)


def partial_of_three(long: DataFrame, a: str, b: str, given: str) -> DataFrame:
    """Correlation of a and b with a third column held constant, on complete rows."""
    at = lambda n: F.max(F.when(F.col("column") == n, F.col("value")))
    wide = long.groupBy("code").agg(at(a).alias("a"), at(b).alias("b"), at(given).alias("c")).dropna()
    r = wide.agg(F.corr("a", "b").alias("ab"), F.corr("a", "c").alias("ac"), F.corr("b", "c").alias("bc"))
    return r.select(F.round((F.col("ab") - F.col("ac") * F.col("bc")) / F.sqrt((1 - F.col("ac") ** 2) * (1 - F.col("bc") ** 2)), 6).alias("partial"))


def moran(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Moran's I per year of (year, code, value) over (code, neighbour), row-standardised; and its expectation."""
    z = rows.filter("value is not null").withColumn("z", F.col("value") - F.avg("value").over(_year())).withColumn("n", F.count(F.lit(1)).over(_year()))
    near = z.select("year", F.col("code").alias("neighbour"), F.col("z").alias("zn"))
    lag = z.join(edges, "code").join(near, ["year", "neighbour"]).groupBy("year", "code", "z").agg(F.avg("zn").alias("lag"))
    top = lag.groupBy("year").agg(F.sum(F.col("z") * F.col("lag")).alias("top"), F.count(F.lit(1)).alias("s0"))
    low = z.groupBy("year").agg(F.sum(F.col("z") * F.col("z")).alias("low"), F.max("n").alias("n"))
    return top.join(low, "year").select("year", "n", F.round(F.col("n") / F.col("s0") * F.col("top") / F.col("low"), 6).alias("moran"), F.round(-1 / (F.col("n") - 1), 6).alias("expected"))


def local_moran(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Local Moran of each code and year (population standard deviation) and its quadrant."""
    z = rows.filter("value is not null").withColumn("z", F.try_divide(F.col("value") - F.avg("value").over(_year()), F.stddev_pop("value").over(_year())))
    near = z.select("year", F.col("code").alias("neighbour"), F.col("z").alias("zn"))
    lag = z.join(edges, "code").join(near, ["year", "neighbour"]).groupBy("year", "code", "z").agg(F.avg("zn").alias("lag"))
    quadrant = F.concat(F.when(F.col("z") >= 0, "H").otherwise("L"), F.when(F.col("lag") >= 0, "H").otherwise("L"))
    return lag.select("year", "code", F.round(F.col("z") * F.col("lag"), 6).alias("local"), quadrant.alias("quadrant"))


@lru_cache(8)
def draw_table(others: int, permutations: int, most: int, seed: int) -> np.ndarray:
    """For each permutation the first ``most`` of ``others`` places, in order of the MD5 of ``seed:permutation:place``: the same in every run, and in SQL."""
    rows = [sorted(range(others), key=lambda j: hashlib.md5(f"{seed}:{d}:{j}".encode()).digest())[:most] for d in range(permutations)]
    return np.array(rows, np.int64).reshape(permutations, -1)


def conditional_tests(z: np.ndarray, near: list[np.ndarray], permutations: int, seed: int) -> list[float]:
    """p of each place's local Moran: its own value stays, its neighbours are drawn from the others. All places share one table of draws, made without the own place."""
    draws = draw_table(len(z) - 1, permutations, max(map(len, near)), seed)
    out = []
    for place, at in enumerate(near):
        k = len(at)
        if not k:
            out.append(math.nan)
            continue
        drawn = draws[:, :k]
        sample = z[place] * z[drawn + (drawn >= place)].mean(1)
        extreme = np.count_nonzero(np.round(np.abs(sample), 9) >= round(abs(float(z[place] * z[at].mean())), 9))
        out.append((extreme + 1) / (permutations + 1))
    return out


def local_moran_tests(rows: DataFrame, edges: DataFrame, permutations: int = 9_999, seed: int = 20260321, least: int = 20) -> DataFrame:
    """year, code, local, quadrant, neighbours and p of each code with neighbours; a year with fewer than ``least`` codes or without spread has none.

    Conditional permutations, two-sided on the absolute value. A year's codes are one group, bounded by the
    territories; edges are counted among the codes that have a value.
    """
    known = rows.filter("value is not null").select("year", "code", F.col("value").cast("double").alias("value"))
    ends = edges.filter("code <> neighbour").select("code", "neighbour").distinct()
    there = known.select("year", F.col("code").alias("neighbour"))
    lists = known.join(ends, "code").join(there, ["year", "neighbour"]).groupBy("year", "code").agg(F.collect_list("neighbour").alias("near"))
    joined = known.join(lists, ["year", "code"], "left").select(F.col("year").cast("long"), "code", "value", "near")

    def test(table: pa.Table) -> pa.Table:
        table = table.sort_by("code")
        codes, values = table.column("code").to_pylist(), table.column("value").to_numpy()
        spread = values.std()
        out = []
        if len(values) >= least and spread > 0:
            z = (values - values.mean()) / spread
            place = {c: i for i, c in enumerate(codes)}
            near = [np.array(sorted(place[c] for c in n or ()), np.int64) for n in table.column("near").to_pylist()]
            for i, p in enumerate(conditional_tests(z, near, permutations, seed) if max(map(len, near)) else ()):
                if len(near[i]):
                    lag = z[near[i]].mean()
                    out.append((table.column("year")[0].as_py(), codes[i], round(float(z[i] * lag), 6), ("H" if z[i] >= 0 else "L") + ("H" if lag >= 0 else "L"), len(near[i]), p))
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = {"year": pa.int64(), "code": pa.string(), "local": pa.float64(), "quadrant": pa.string(), "neighbours": pa.int64(), "p": pa.float64()}
        return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), columns, strict=True)})

    return joined.groupBy("year").applyInArrow(test, "year long, code string, local double, quadrant string, neighbours long, p double")


def moran_permutations(rows: DataFrame, edges: DataFrame, permutations: int = 999, seed: int = 20260321) -> DataFrame:
    """year, moran, p: two-sided permutation test; a year's regions are one group, bounded by the territories."""
    joined = rows.filter("value is not null").join(edges.groupBy("code").agg(F.collect_set("neighbour").alias("near")), "code")

    def test(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("code")
        place = {c: i for i, c in enumerate(frame["code"])}
        w = np.zeros((len(frame), len(frame)))
        for i, near in enumerate(frame["near"]):
            at = [place[c] for c in near if c in place]
            w[i, at] = 1 / len(at) if at else 0
        z = frame["value"].to_numpy() - frame["value"].mean()
        scale = len(z) / w.sum() / (z @ z)
        observed, expected = scale * (z @ w @ z), -1 / (len(z) - 1)
        rng = np.random.default_rng(seed)
        drawn = np.array([scale * (p @ w @ p) for p in (rng.permutation(z) for _ in range(permutations))])
        p = (np.sum(np.abs(drawn - expected) >= abs(observed - expected)) + 1) / (permutations + 1)
        return pd.DataFrame({"year": [frame["year"].iloc[0]], "moran": [round(float(observed), 6)], "p": [float(p)]})

    return joined.groupBy("year").applyInPandas(test, "year long, moran double, p double")


def normalise(long: DataFrame, method: str, negative: Sequence[str] = ()) -> DataFrame:
    """Values of each column to 0 to 100: minmax, zscore, robust, rank or log; negative columns are turned round; a constant column is 50."""
    col = Window.partitionBy("column")
    rows, x = long.filter("value is not null"), F.col("value")
    if method == "log":
        rows = rows.withColumn("value", F.when(F.min("value").over(col) > 0, F.ln(F.greatest("value", F.lit(1e-300)))).otherwise(0.0))
    if method in ("minmax", "log"):
        low, high = F.min("value").over(col), F.max("value").over(col)
        score = F.try_divide(x - low, high - low) * 100
    elif method == "rank":
        score = F.try_divide(average_rank("value", "column") - 1, F.count(F.lit(1)).over(col) - 1) * 100
        score = F.when(F.max("value").over(col) > F.min("value").over(col), score)
    else:
        centre, spread = (F.avg("value").over(col), F.stddev_samp("value").over(col)) if method == "zscore" else (F.percentile("value", 0.5).over(col), (F.percentile("value", 0.75).over(col) - F.percentile("value", 0.25).over(col)) / 1.349)
        score = 50 + F.least(F.greatest(F.try_divide(x - centre, spread), F.lit(-3.0)), F.lit(3.0)) / 3 * 50
    out = rows.withColumn("score", F.coalesce(score, F.lit(50.0)))
    turned = F.when(F.col("column").isin(*negative), 100 - F.col("score")).otherwise(F.col("score")) if negative else F.col("score")
    return out.select("column", "code", F.round(turned, 6).alias("score"))


def entropy_weights(scores: DataFrame) -> DataFrame:
    """Weights of columns by one less the normalised entropy of their shifted shares."""
    col = Window.partitionBy("column")
    p = scores.withColumn("v", F.col("score") - F.min("score").over(col) + 1e-12).withColumn("p", F.col("v") / F.sum("v").over(col))
    e = p.groupBy("column").agg((1 + F.sum(F.col("p") * F.ln(F.col("p") + 1e-12)) / F.ln(F.count(F.lit(1)))).alias("d"))
    return e.select("column", F.round(F.col("d") / F.sum("d").over(Window.partitionBy()), 6).alias("weight"))


def critic_weights(scores: DataFrame) -> DataFrame:
    """Weights by standard deviation times the sum of one less the correlations."""
    a, b = (scores.select(F.col("column").alias(n), "code", F.col("score").alias(v)) for n, v in (("a", "x"), ("b", "y")))
    r = a.join(b, "code").groupBy("a", "b").agg(F.corr("x", "y").alias("r"))
    conflict = r.groupBy("a").agg(F.sum(F.when(F.col("a") != F.col("b"), 1 - F.coalesce("r", F.lit(0.0))).otherwise(0.0)).alias("conflict")).withColumnRenamed("a", "column")
    c = scores.groupBy("column").agg(F.stddev_samp("score").alias("sd")).join(conflict, "column").withColumn("c", F.col("sd") * F.col("conflict"))
    return c.select("column", F.round(F.col("c") / F.sum("c").over(Window.partitionBy()), 6).alias("weight"))


def pca_weights(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Squared loadings times variance share over components with eigenvalues of 1 or more. The correlations, over codes that have all columns, are one aggregate; only they are gathered."""
    names = [f"c{i}" for i in range(len(columns))]
    wide = scores.groupBy("code").agg(*[F.max(F.when(F.col("column") == c, F.col("score"))).alias(n) for c, n in zip(columns, names, strict=True)]).dropna()
    cells = list(combinations(range(len(columns)), 2))
    found = wide.agg(F.count(F.lit(1)).alias("n"), *[F.corr(names[i], names[j]).alias(f"r{i}_{j}") for i, j in cells]).first()
    matrix = np.eye(len(columns))
    for i, j in cells:
        matrix[i, j] = matrix[j, i] = found[f"r{i}_{j}"] or 0.0
    values, vectors = np.linalg.eigh(matrix)
    kept = values >= 1 - 1e-12
    weights = (vectors[:, kept] ** 2 * (values[kept] / values.sum())).sum(1)
    return scores.sparkSession.createDataFrame([(c, round(float(w), 6)) for c, w in zip(columns, weights / weights.sum(), strict=True)], "column string, weight double")


def composite(scores: DataFrame, weights: DataFrame, columns: int, method: str, least: float = 0.6) -> DataFrame:
    """Index of each code: additive, geometric, topsis or distance; codes with too few columns are left out."""
    own = scores.join(F.broadcast(weights), "column")
    code = Window.partitionBy("code")
    own = own.withColumn("present", F.count(F.lit(1)).over(code)).filter(F.col("present") >= least * columns).withColumn("w", F.col("weight") / F.sum("weight").over(code))
    if method == "additive":
        return own.groupBy("code").agg(F.round(F.sum(F.col("w") * F.col("score")), 5).alias("index"))
    if method == "geometric":
        return own.groupBy("code").agg(F.round(F.exp(F.sum(F.col("w") * F.ln(F.greatest("score", F.lit(1.0))))), 5).alias("index"))
    col = Window.partitionBy("column")
    full = own.select("code").distinct().crossJoin(F.broadcast(weights)).join(own.select("code", "column", "score"), ["code", "column"], "left").withColumn("score", F.coalesce("score", F.avg("score").over(col)))
    if method == "topsis":
        x = F.col("weight") * F.col("score")
        d = full.withColumn("v", x).withColumn("up", F.max("v").over(col)).withColumn("down", F.min("v").over(col)).groupBy("code").agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("up"), 2))).alias("far"), F.sqrt(F.sum(F.pow(F.col("v") - F.col("down"), 2))).alias("near"))
        return d.select("code", F.round(F.coalesce(F.try_divide("near", F.col("near") + F.col("far")) * 100, F.lit(50.0)), 5).alias("index"))
    d = full.withColumn("best", F.max("score").over(col)).groupBy("code").agg(F.sqrt(F.sum(F.col("weight") * F.pow(F.col("score") - F.col("best"), 2))).alias("d"))
    return d.select("code", F.round(F.coalesce((1 - F.try_divide("d", F.max("d").over(Window.partitionBy()))) * 100, F.lit(100.0)), 5).alias("index"))


def rank_shift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean and largest shift of places between two indices."""
    place = lambda df, n: df.select("code", F.rank().over(Window.partitionBy().orderBy(F.desc("index"))).cast("long").alias(n))
    moved = place(a, "x").join(place(b, "y"), "code").select(F.abs(F.col("x") - F.col("y")).alias("d"))
    return moved.agg(F.round(F.avg("d"), 6).alias("mean_shift"), F.max("d").alias("max_shift"))


def similar(long: DataFrame, code: str, limit: int = 6) -> DataFrame:
    """Nearest codes by Euclid's distance over z-standardised columns, and the column with the largest gap."""
    col = Window.partitionBy("column")
    z = long.withColumn("z", F.try_divide(F.col("value") - F.avg("value").over(col), F.stddev_pop("value").over(col)))
    own = z.filter(F.col("code") == code).select("column", F.col("z").alias("own"))
    gaps = z.filter(F.col("code") != code).join(F.broadcast(own), "column").withColumn("gap", F.abs(F.col("z") - F.col("own")))
    out = gaps.groupBy("code").agg(F.round(F.sqrt(F.sum(F.col("gap") * F.col("gap"))), 6).alias("distance"), F.max_by("column", "gap").alias("largest_gap"))
    return out.orderBy("distance", "code").limit(limit)


def breaks(rows: DataFrame, method: str, classes: int = 5) -> DataFrame:
    """Edges of map classes per year: equal width, quantile (position i * n / k on the sorted values) or steps of the standard deviation."""
    base = rows.filter("value is not null").groupBy("year").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.sort_array(F.collect_list("value")).alias("sorted"), F.count(F.lit(1)).alias("n"))
    steps = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(classes))))
    if method == "equal":
        edge = F.col("low") + (F.col("high") - F.col("low")) * F.col("i") / classes
    elif method == "quantile":
        at = F.least(F.col("i") * F.col("n") / classes, F.col("n") - 1.0)
        below, above = (F.element_at("sorted", (f(at) + 1).cast("int")) for f in (F.floor, F.ceil))
        edge = below + (above - below) * (at - F.floor(at))
    else:
        step = 1.0 if classes <= 4 else 0.5 if classes <= 6 else 1 / 3
        edge = F.least(F.greatest(F.col("mean") + (F.col("i") - classes / 2) * step * F.col("sd"), F.col("low")), F.col("high"))
        edge = F.when(F.col("i") == 0, F.col("low")).when(F.col("i") == classes, F.col("high")).otherwise(edge)
    return steps.select("year", F.col("i").cast("long").alias("i"), F.round(edge, 5).alias("edge"))


def jenks(rows: DataFrame, classes: int = 5) -> DataFrame:
    """Natural breaks per year by dynamic programming over prefix sums; the first of equal minima is kept. An edge is the smallest value of the class that it begins; the last is the largest value."""

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(frame["value"].to_numpy())
        n, k = len(x), min(classes, len(np.unique(x)))
        s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
        cost = lambda i, j: q[j] - q[i] - (s[j] - s[i]) ** 2 / (j - i)
        best = np.array([0.0] + [cost(0, j) for j in range(1, n + 1)])
        cuts = []
        for c in range(2, k + 1):
            new, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
            for j in range(c, n + 1):
                options = np.array([best[i] + cost(i, j) for i in range(c - 1, j)])
                back[j] = c - 1 + int(options.argmin())
                new[j] = options.min()
            best = new
            cuts.append(back)
        edges, j = [x[-1]], n
        for back in reversed(cuts):
            j = back[j]
            edges.append(x[j])
        edges.append(x[0])
        return pd.DataFrame({"year": frame["year"].iloc[0], "i": range(len(edges)), "edge": [round(float(e), 6) for e in reversed(edges)]})

    return rows.filter("value is not null").select("year", "value").groupBy("year").applyInPandas(cut, "year long, i long, edge double")


def histogram(rows: DataFrame, bins: int = 28) -> DataFrame:
    """Counts of equal bins per year; the last bin is closed."""
    low, high = F.min("value").over(_year()), F.max("value").over(_year())
    bin_ = F.least(F.floor(F.coalesce(F.try_divide((F.col("value") - low) * bins, high - low), F.lit(0.0))), F.lit(bins - 1)).cast("long")
    return rows.filter("value is not null").withColumn("bin", bin_).groupBy("year", "bin").agg(F.count(F.lit(1)).alias("n"))


def outliers(rows: DataFrame, least: int = 10) -> DataFrame:
    """Values outside Tukey's fences, of years with enough values."""
    q = rows.filter("value is not null").groupBy("year").agg(F.percentile("value", 0.25).alias("q1"), F.percentile("value", 0.75).alias("q3"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).withColumn("iqr", F.col("q3") - F.col("q1")).filter("iqr > 0")
    return rows.join(q, "year").filter("value < q1 - 1.5 * iqr or value > q3 + 1.5 * iqr").select("year", "code", "value")


def masks(rows: DataFrame) -> DataFrame:
    """Values of four or more equal digits that are ten times the 95th percentile of the others' absolute values: codes for gaps."""
    text = F.abs("value").cast("long").cast("string")
    marked = rows.filter("value is not null").withColumn("suspect", (F.col("value") == F.floor("value")) & F.rlike(text, F.lit(r"^(\d)\1{3,}$")))
    usual = marked.filter("not suspect").agg(F.percentile_approx(F.abs("value"), 0.95, 1_000_000).alias("p95"))  # within a millionth of the ranks; one sketch for each task
    return marked.filter("suspect").crossJoin(F.broadcast(usual)).filter(F.abs("value") >= 10 * F.col("p95")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def constant_composition(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """Codes present in all full years."""
    counts = rows.filter("value is not null").groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    full = counts.withColumn("peak", F.max("n").over(Window.partitionBy())).filter(F.col("n") >= share * F.col("peak")).select("year")
    kept = rows.filter("value is not null").join(F.broadcast(full), "year").groupBy("code").agg(F.count_distinct("year").alias("years"))
    return kept.join(F.broadcast(full.agg(F.count(F.lit(1)).alias("all_years")))).filter("years = all_years").select("code", "years")


def ols(frame: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Least squares with HC3 errors: name, coefficient, error, p. The normal equations and the sandwich are sums over rows; only they are gathered."""
    names = ["const", *xs]
    rows = frame.select(F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("const"), *[F.col(x).cast("double").alias(x) for x in xs]).dropna()
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"x{i}_{j}") for i, j in cells], *[F.sum(F.col(n) * F.col("_y")).alias(f"y{i}") for i, n in enumerate(names)]).first()
    matrix = lambda row, letter: np.array([[row[f"{letter}{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])
    inverse = np.linalg.inv(matrix(sums, "x"))
    beta = inverse @ np.array([sums[f"y{i}"] for i in range(len(names))])
    fitted = sum((F.col(n) * float(b) for n, b in zip(names, beta, strict=True)), F.lit(0.0))
    leverage = sum((F.col(names[i]) * F.col(names[j]) * float(inverse[i, j]) for i in range(len(names)) for j in range(len(names))), F.lit(0.0))
    u2 = F.pow((F.col("_y") - fitted) / (1 - leverage), 2)
    meat = matrix(rows.withColumn("_u", u2).agg(*[F.sum(F.col("_u") * F.col(names[i]) * F.col(names[j])).alias(f"m{i}_{j}") for i, j in cells]).first(), "m")
    errors = np.sqrt(np.diag(inverse @ meat @ inverse))
    dof = sums["n"] - len(names)
    out = [(n, round(float(b), 6), round(float(e), 6), round(float(t_tail(b / e, dof)), 6)) for n, b, e in zip(names, beta, errors, strict=True)]
    return frame.sparkSession.createDataFrame(out, "name string, coefficient double, error double, p double")


def series_pairs(keys: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(sorted(keys), 2))

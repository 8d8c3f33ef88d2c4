"""Kernels of statistics against plain computations."""

import hashlib
import itertools

import numpy as np
import pytest

from tessera.operators import statistics


def test_local_moran_tests_equal_a_plain_loop(spark):
    draw = np.random.default_rng(4)
    codes = [f"r{i:02d}" for i in range(24)]
    edges = [(a, b) for i, a in enumerate(codes[:-1]) for j, b in enumerate(codes[:-1]) if i != j and (abs(i - j) <= 1 or draw.random() < 0.1)]
    rows = [(year, c, float(v)) for year in (2001, 2002) for c, v in zip(codes, draw.normal(size=24).cumsum(), strict=True) if not (year == 2002 and c == "r05")]
    rows += [(2003, c, 5.0) for c in codes] + [(2004, c, 1.0 * i) for i, c in enumerate(codes[:7])] + [(2001, "none", None)]
    got = statistics.local_moran_tests(spark.createDataFrame(rows, "year long, code string, value double"), spark.createDataFrame([*edges, ("r01", "r01"), ("r01", "abroad")], "code string, neighbour string"), 199, 7)
    found = {(r.year, r.code): (r.local, r.quadrant, r.neighbours, r.p) for r in got.collect()}
    want = {}
    for year in (2001, 2002):  # the others have no spread or too few codes
        own = {c: v for y, c, v in rows if y == year and v is not None}
        names = sorted(own)
        z = {c: (own[c] - np.mean(list(own.values()))) / np.std(list(own.values())) for c in names}
        for c in names:
            near = sorted({b for a, b in edges if a == c and b in own})
            if not near:
                continue
            local = z[c] * np.mean([z[b] for b in near])
            others = [b for b in names if b != c]
            extreme = 0
            for d in range(199):
                order = sorted(range(len(others)), key=lambda j, d=d: hashlib.md5(f"7:{d}:{j}".encode()).hexdigest())
                extreme += round(abs(z[c] * np.mean([z[others[j]] for j in order[: len(near)]])), 9) >= round(abs(local), 9)
            quadrant = ("H" if z[c] >= 0 else "L") + ("H" if np.mean([z[b] for b in near]) >= 0 else "L")
            want[year, c] = (round(float(local), 6), quadrant, len(near), (extreme + 1) / 200)
    assert found.keys() == want.keys()
    for key in want:
        assert found[key][0] == pytest.approx(want[key][0], abs=2e-6) and found[key][1:] == want[key][1:]


def test_clusters_are_significant_and_noise_is_not(spark):
    codes = [f"r{i:02d}" for i in range(40)]
    edges = [(codes[i], codes[j]) for i in range(40) for j in (i - 1, i + 1) if 0 <= j < 40]
    halves = [(1, c, 0.0 if i < 20 else 100.0) for i, c in enumerate(codes)]
    noise = [(2, c, float(v)) for c, v in zip(codes, np.random.default_rng(1).normal(size=40), strict=True)]
    tests = statistics.local_moran_tests(spark.createDataFrame(halves + noise, "year long, code string, value double"), spark.createDataFrame(edges, "code string, neighbour string"), 999)
    rows = statistics.benjamini_hochberg(tests, "p", "code", "year").collect()
    inside = [r for r in rows if r.year == 1 and r.code not in ("r00", "r19", "r20", "r39")]
    assert all(r.quadrant in ("HH", "LL") and r.local > 0.9 for r in inside)
    assert sum(r.p_adjusted < 0.05 for r in rows if r.year == 2) == 0
    assert all(r.p_adjusted >= r.p for r in rows)


def test_tau_b_equals_counting_pairs():
    draw = np.random.default_rng(2)
    for n, values in ((2, 3), (9, 2), (50, 4), (80, 1000), (33, 1)):
        x, y = draw.integers(0, values, (2, n)).astype(float)
        s = nx = ny = 0
        for i, j in itertools.combinations(range(n), 2):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            s, nx, ny = s + a * b, nx + abs(a), ny + abs(b)
        want = s / np.sqrt(nx * ny) if nx and ny else None
        assert statistics.tau_b(x, y) == (want if want is None else pytest.approx(want))


def test_pca_weights_equal_numpy(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(60, 2)) @ draw.normal(size=(2, 5)) + 0.3 * draw.normal(size=(60, 5))
    names = [f"n{i}" for i in range(5)]
    rows = [(n, f"c{i}", float(v)) for i, line in enumerate(x) for n, v in zip(names, line, strict=True) if not (i == 7 and n == "n2")]
    got = {r.column: r.weight for r in statistics.pca_weights(spark.createDataFrame(rows, "column string, code string, score double"), names).collect()}
    values, vectors = np.linalg.eigh(np.corrcoef(np.delete(x, 7, 0).T))
    weights = (vectors[:, values >= 1] ** 2 * values[values >= 1]).sum(1)
    assert [got[n] for n in names] == pytest.approx((weights / weights.sum()).tolist(), abs=2e-6)


def test_ratios_are_ordered_by_what_they_need():
    from tessera.operators.derive import dependency_levels

    a, b, c = ("a", "x", "y", 1.0), ("b", "a", "x", 1.0), ("c", "b", "a", 1.0)
    assert dependency_levels([c, b, a], ("x", "y")) == [[a], [b], [c]]
    with pytest.raises(ValueError, match="b, c"):
        dependency_levels([c, b], ("x", "y"))


def test_bounds_of_measures_hold_all_that_hidden_values_may_be(spark):
    """Least and most against a dense grid and all corners; no filling of the hidden values lies outside."""
    from tessera.operators import study

    draw = np.random.default_rng(11)
    measures = {
        "gini": lambda v: np.abs(v[:, None] - v).sum() / (2 * len(v) ** 2 * v.mean()),
        "theil": lambda v: float((v / v.mean() * np.log(v / v.mean())).mean()),
        "cv": lambda v: v.std() / v.mean(),
    }
    groups = {("a", 1): (draw.lognormal(size=9), 1), ("a", 2): (draw.lognormal(size=14), 4), ("b", 1): (np.append(draw.random(7), 0.0), 2), ("b", 2): (np.full(6, 3.0), 3), ("c", 1): (draw.random(4), 2), ("c", 2): (draw.random(9), 0)}
    rows = [(s, y, float(v), False) for (s, y), (values, _) in groups.items() for v in values] + [(s, y, None, True) for (s, y), (_, k) in groups.items() for _ in range(k)] + [("a", 1, None, False)]
    got = {(r.series_key, r.year, r.measure): r for r in study.bounds_of_measures(spark.createDataFrame(rows, "series_key string, year long, value double, hidden boolean")).collect()}
    want = {(s, y, m) for s, y in (("a", 1), ("a", 2), ("b", 1), ("b", 2)) for m in measures if (s, y, m) != ("b", 1, "theil")}
    assert got.keys() == want
    for (s, y, m), r in got.items():
        values, k = groups[s, y]
        low, high = values.min(), values.max()
        filled = lambda *x: measures[m](np.append(values, x))  # noqa: B023, E731
        assert (r.hidden, r.observed) == (k, len(values))
        assert r.known == pytest.approx(measures[m](values), abs=1e-6)
        assert r.least == pytest.approx(min(filled(*[x] * k) for x in [*np.linspace(low, high, 2000), *values]), abs=2e-6)
        assert r.most == pytest.approx(max(filled(*[low] * j, *[high] * (k - j)) for j in range(k + 1)), abs=1e-6)
        for _ in range(300):
            assert r.least - 2e-6 <= filled(*draw.uniform(low, high, k)) <= r.most + 2e-6

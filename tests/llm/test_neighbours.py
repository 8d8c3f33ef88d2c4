import numpy as np

from tessera.llm import neighbours
from tests.llm.helpers import table


def brute(rows, k=5, every=50):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], np.float64)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        scores = (v * v[q]).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((v[q] * v[q]).sum()))
        others = np.flatnonzero(ids != ids[q])
        out[int(ids[q])] = [(int(ids[o]), float(scores[o])) for o in others[np.lexsort((ids[others], -scores[others]))][:k]]
    return out


def found(frame):
    out: dict = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_and_scores(spark):
    for sf in ("sf0.001", "sf0.1"):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
        want, got = brute(rows), found(neighbours.nearest(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")))
        assert want.keys() == got.keys()
        hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
        assert hits >= 0.9 * sum(map(len, want.values()))
        vectors = dict(rows)
        for q, list_ in got.items():
            assert len(list_) == 5 and list_ == sorted(list_, key=lambda x: (-x[1], x[0]))
            for i, score in list_:
                a, b = np.array(vectors[q], float), np.array(vectors[i], float)
                assert abs(score - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 120)]
    same = [(i, [1.0] * 8) for i in range(200, 260)]
    bad = [(300, None), (350, [0.0] * 8), (400, [None] + [1.0] * 7), (450, [float("nan")] * 8), (500, [float("inf")] * 8), (550, [1.0] * 3), (600, []), (None, [1.0] * 8)]
    frame = spark.createDataFrame([(*r, 1, "q") for r in rows + same + bad], "vec_id long, embedding array<float>, rank int, is_query string")
    as_stored = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows + same]
    got, want = found(neighbours.nearest(frame)), brute(as_stored)
    assert got.keys() == want.keys()
    for q in (200, 250):
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]  # ties go to the smaller id
    assert neighbours.nearest(frame.limit(0)).collect() == []
    few = frame.filter("vec_id in (50, 51)")
    assert [(r.query_id, r.vec_id) for r in neighbours.nearest(few).collect()] == [(50, 51)]


def test_repeated_queries(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 90)]
    once = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    again = once.unionByName(once.filter("vec_id = 50")).unionByName(once.filter("vec_id = 50"))
    assert found(neighbours.nearest(again)) == found(neighbours.nearest(once))


def test_near_vectors_are_found_by_few_probes():
    """Where neighbours are near (cosine 0.9 and more) the learned radius is small and few rows are probed."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(400, 64))
    vectors = np.repeat(centres, 10, axis=0) + 0.3 * rng.normal(size=(4000, 64))
    codes = neighbours.Codes(vectors, 5)
    coded = codes(vectors)
    index = neighbours.MultiIndex(coded, codes.bits)
    parts = neighbours.parts_of(codes.bits, index.substrings, codes.radius)
    probed = np.mean([np.mean(np.any([np.bitwise_count((coded ^ q) >> np.uint64(p.shift) & np.uint64((1 << p.bits) - 1)) <= p.near for p in parts], axis=0)) for q in coded[:100]])
    assert codes.radius <= 16 and probed < 0.2


def test_multi_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2**63, 500, dtype=np.uint64)
    codes[100:] = codes[rng.integers(0, 100, 400)] ^ (np.uint64(1) << rng.integers(0, 63, 400, dtype=np.uint64))
    index = neighbours.MultiIndex(codes, 64)
    for radius in (0, 1, 5, 23, 30):
        for q in codes[:20]:
            assert index.within(q, radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ q) <= radius).tolist()


def test_extreme_components(spark):
    """Finite components of any size: angles do not depend on lengths."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8)) for i in range(1, 200)]
    lengths = rng.choice([1.0, 2.0**-664, 2.0**664, 2.0**-1000, 2.0**1000], len(rows))
    frame = spark.createDataFrame([(i, (v * n).tolist()) for (i, v), n in zip(rows, lengths, strict=True)] + [(250, (rows[49][1] * 1e200).tolist()), (251, (rows[49][1] * 1e-200).tolist())], "vec_id long, embedding array<double>")
    plain = [*rows, (250, rows[49][1] * 1e200 / 1e200), (251, rows[49][1] * 1e-200 / 1e-200)]
    got, want = found(neighbours.nearest(frame)), brute(plain)
    assert got.keys() == want.keys()
    for q in want:
        assert [round(s, 12) for _, s in got[q]] == [round(s, 12) for _, s in want[q]]
    assert {i for i, _ in got[50][:2]} == {250, 251}


def test_substrings_are_chosen_by_what_they_cost():
    """Clustered codes are joined by probes, the more so the more rows there are; codes without structure are not."""
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    near = np.repeat(centres, 4) ^ (np.uint64(1) << rng.integers(0, 64, 8000, dtype=np.uint64))
    for rows in (10**6, 10**9):
        found = neighbours.least_probing(near, 64, 6, rows)
        assert found.probes + found.share * rows <= neighbours.MAX_PROBED * rows and found.share < 0.01
        assert sum(neighbours.ball_size(p.bits, p.near) for p in found.parts) == found.probes <= neighbours.MAX_PROBES
    loose = neighbours.least_probing(rng.integers(0, 2**64, 8000, dtype=np.uint64), 64, 30, 10**6)
    assert loose is None or loose.probes + loose.share * 10**6 > neighbours.MAX_PROBED * 10**6


def test_joined_indexes_find_what_blocks_find(spark):
    """Both ways find every code within the radius, with equal vectors and repeated rows; most true neighbours are among them."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(150, 32))
    vectors = np.repeat(centres, 12, axis=0) + 0.15 * rng.normal(size=(1800, 32))
    vectors[600:900] = vectors[600]  # a hot vector
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(2000)[:1800] - 100, vectors, strict=True)]
    rows += [rows[i] for i in (600, 601, 3, 3)] + [(next(i for i, _ in rows if i % 50 == 0), [1.0] * 32)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    joined, blocks = (found(neighbours.nearest(frame, join_indexes=way)) for way in (True, False))
    assert joined == blocks
    want = brute(rows[:1800])
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in joined[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_joined_indexes_of_few_and_odd_vectors(spark):
    """One vector, none that asks, short vectors, and all equal ones."""
    def both(rows):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        joined, blocks = (found(neighbours.nearest(frame, join_indexes=way)) for way in (True, False))
        assert joined == blocks
        return joined

    assert both([(50, [1.0, 2.0])]) == {}
    assert both([(i, [1.0, float(i)]) for i in range(1, 40)]) == {}
    assert [i for i, _ in both([(i, [1.0, 1.0]) for i in range(100, 40, -1)])[50]] == [41, 42, 43, 44, 45]
    assert [i for i, _ in both([(50, [1.0]), (51, [2.0]), (52, [-1.0]), (53, None), (54, [0.0])])[50]] == [51, 52]

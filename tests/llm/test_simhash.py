import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import simhash
from tests.llm.helpers import odd_documents, table


def plain_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def plain_components(ids, fps, radius=2):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    array = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= radius):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [least.get(root(i)) for i in range(len(fps))]


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = sorted(((r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, plain_components([r.doc_id for r in rows], fps), strict=True)), key=str)
    assert sorted((tuple(r) for r in simhash.simhash_digest(docs).collect()), key=str) == want


def test_digest_against_brute_force(spark):
    check(table(spark, "documents"))


def test_odd_documents(spark):
    docs = odd_documents(spark)
    check(docs.filter("doc_id is not null and length(text) < 1000 or text is null"))
    assert simhash.simhash_digest(docs).count() == docs.count()
    assert simhash.simhash_digest(docs.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 9), st.lists(st.integers(1, 200), min_size=1, max_size=6))
def test_bit_sliced_comparison(seed, radius, sizes):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
    n = sum(sizes)
    fps = centre[rng.integers(0, 4, n)]
    for _ in range(radius):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) * rng.integers(0, 2, n, dtype=np.uint64)
    starts = np.cumsum([0, *sizes[:-1]])
    got = {(int(a), int(b)) for i, j in simhash.bucket_links(fps, starts, radius) for a, b in zip(i, j, strict=True)}
    want = {(a, b) for s, m in zip(starts, sizes, strict=True) for a in range(s, s + m) for b in range(a + 1, s + m) if int(fps[a] ^ fps[b]).bit_count() <= radius}
    assert got == want


def shingle_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else frozenset()


def test_one_of_each_group_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: shingle_set(r.text) for r in docs.select("doc_id", "text").collect()}
    ids = sorted(rows)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            one, two = rows[a], rows[b]
            if min(len(one), len(two)) >= 0.8 * max(len(one), len(two)) and len(one & two) >= 0.8 * len(one | two):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {i for i in ids if root(i) == i}
    got = {r.doc_id for r in simhash.keep_one_of_each_group(docs).collect()}
    assert got == want


def test_groups_of_odd_documents(spark):
    docs = odd_documents(spark)
    kept = simhash.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 in ids and 6 not in ids and ids.count(7) == 1 and 1 in ids
    assert simhash.keep_one_of_each_group(docs.limit(0)).collect() == []


def kept_and_wanted(spark, texts):
    """Ids that stay, and those that stay by brute force."""
    sets, group = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i, one in enumerate(sets):
        for j in range(i):
            if len(one & sets[j]) >= 0.8 * len(one | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in simhash.keep_one_of_each_group(docs).collect()}, {i for i, g in enumerate(group) if i == g}


def test_every_kind_of_edit_is_found(spark):
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    texts = []
    for n in rng.integers(60, 300, 40).tolist():
        text = words(n)
        at = n // 3
        texts += [text, text + words(n // 5), text + words(n // 10), text[:at] + words(n // 11) + text[at + n // 11 :]]
    for n in rng.integers(9, 26, 40).tolist():
        text = words(n)
        texts += [text, text + words(1)]
    got, want = kept_and_wanted(spark, [" ".join(t) for t in texts])
    assert got == want
    assert len(texts) - len(want) > 100


def test_rows_that_differ_in_other_columns_only(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "b"), (1, text, "a"), (1, text, "c"), (2, text, "d"), (3, "another text", "e")]
    kept = [{tuple(r) for r in simhash.keep_one_of_each_group(spark.createDataFrame(x, "doc_id long, text string, source string")).collect()} for x in (rows, rows[::-1])]
    assert kept[0] == kept[1] and len(kept[0]) == 2


def test_split_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 7)
    test_alike_texts_in_a_crowded_bucket(spark)


def test_alike_texts_in_a_crowded_bucket(spark):
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    base = words(360)
    texts = []
    for n, at in zip(rng.integers(34, 50, 80).tolist(), rng.integers(0, 330, 80).tolist(), strict=True):
        texts.append(" ".join(base[:at] + words(n) + base[at + n :]))
    got, want = kept_and_wanted(spark, texts)
    assert got == want
    assert 1 < len(want) < 80


def test_bins_do_not_hide_alike_sets():
    rng = np.random.default_rng(6)
    passed = 0
    for n in rng.integers(5, 3000, 400).tolist():
        ids = np.unique(rng.integers(0, 2**64, n + n // 4 + 1, dtype=np.uint64))
        one = np.sort(rng.permutation(ids)[: max(1, int(0.9 * len(ids)))])
        both = np.intersect1d(one, ids)
        two = np.sort(rng.permutation(np.concatenate([both, np.setdiff1d(ids, one)[: max(0, int(len(one) / 0.8) - len(one))]])))
        jaccard = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
        bins = [np.frombuffer(simhash.set_bins(x), np.uint8)[None] for x in (one, two)]
        may = simhash.may_be_alike(*bins, np.array([len(one)]), np.array([len(two)]), 0.8)[0]
        assert may or jaccard < 0.8
        far = np.sort(rng.permutation(np.concatenate([one[: len(one) // 2], rng.integers(0, 2**64, len(one) - len(one) // 2, dtype=np.uint64)])))
        passed += simhash.may_be_alike(bins[0], np.frombuffer(simhash.set_bins(far), np.uint8)[None], np.array([len(one)]), np.array([len(far)]), 0.8)[0] and n > 100
    assert passed == 0


def test_a_family_of_half_alike_texts_gives_few_pairs(spark):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for at in rng.integers(0, 150, rng.integers(1, 10)):
            copy[at] = f"v{rng.integers(0, 10**9)}"
        texts.append(" ".join(copy))
    got, want = kept_and_wanted(spark, texts)
    assert got == want and 1 < len(want) < 150


@pytest.mark.parametrize("keys_of_each, shared", [(30, 24), (40, 40), (12, 12)])
def test_a_pair_leaves_its_buckets_once(spark, keys_of_each, shared):
    rng = np.random.default_rng(9)
    common, nodes, bins = rng.integers(-(2**62), 2**62, shared).tolist(), [], []
    for i in range(60):
        keys = common + rng.integers(-(2**62), 2**62, keys_of_each - shared).tolist()
        nodes.append((i, i, 100, bytes(16), keys))
        bins.append((i, bytes([1]) * simhash.BINS))
    nodes = spark.createDataFrame(nodes, "node long, root long, n long, fp binary, keys array<long>")
    bins = spark.createDataFrame(bins, "node long, bins binary")
    keys = simhash.mixed_keys(nodes)
    found = [(r.a, r.b) for r in simhash._meetings(nodes, keys, bins, 0.8, False, simhash.WIDE_RADIUS).collect()]
    assert sorted(found) == [(a, b) for a in range(60) for b in range(a + 1, 60)]


def test_pairs_that_share_late_keys_only_are_not_lost(spark):
    own = [list(range(100 * i, 100 * i + 20)) + [10_000] for i in range(3)]
    other = [[*x[:20]] for x in own]
    nodes = spark.createDataFrame([(i, i, 100, bytes(16), k) for i, k in enumerate(own + other)], "node long, root long, n long, fp binary, keys array<long>")
    bins = nodes.selectExpr("node", f"cast(repeat('a', {simhash.BINS}) as binary) as bins")
    found = {(r.a, r.b) for r in simhash.meeting_links(nodes, simhash.mixed_keys(nodes), bins, 0.8, False).collect()}
    assert found == {(0, 1), (0, 2), (1, 2), (0, 3), (1, 4), (2, 5)}

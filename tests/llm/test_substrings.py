import hashlib
import random

import pytest

from tessera.llm import queries, substrings
from tests.compare import assert_same, connect, plain
from tests.llm.helpers import SF, odd_documents, table


def brute(rows, window=13):
    """(id, words, removed, hash) of (id, text) rows, by comparing every window."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    least: dict = {}
    for i, w in words:
        for at in range(len(w) - window + 1):
            key = tuple(w[at : at + window])
            least[key] = min(least.get(key, order(i)), order(i))
    out = []
    for i, w in words:
        gone = set()
        for at in range(len(w) - window + 1):
            first = least[tuple(w[at : at + window])]
            if first < order(i) and not first[0]:
                gone.update(range(at, at + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=plain)


def found(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=plain)


def planted(seed: int, docs: int = 120):
    """Texts of few different words in which passages of all lengths round the threshold repeat, one of them in very many."""
    draw = random.Random(seed)
    some = lambda n, of=40: [f"w{draw.randrange(of)}" for _ in range(n)]
    passages = [some(n, 5000) for n in (5, 12, 13, 14, 20, 60, 200)]
    rows = []
    for i in range(docs):
        text = some(draw.randrange(30))
        for _ in range(draw.randrange(4)):
            p = draw.choice(passages)
            a = draw.randrange(max(1, len(p) - 12)) if draw.random() < 0.5 else 0
            text += p[a : a + draw.choice((12, 13, 30, 500))] + some(draw.randrange(20), draw.choice((3, 3000)))
        if draw.random() < 0.4:
            text += passages[5]
        rows.append((draw.choice((None, i, i, i, i, i // 2, -i)), draw.choice(("  ", "\n", "\t")).join(text)))
    return rows + rows[:9]


@pytest.mark.parametrize("seed", range(3))
def test_same_as_comparing_every_window(spark, seed):
    rows = planted(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(substrings.repeats_digest(frame)) == brute(rows)


def test_segments_and_small_batches_change_nothing(spark, monkeypatch):
    rows = planted(9)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    monkeypatch.setattr(substrings, "SEGMENT", 25)
    monkeypatch.setattr(substrings, "REMEMBERED", 10)
    try:
        # the segment's length is read in the workers, which import the module anew: the kernel is tested here, the batches in Spark
        import numpy as np
        import pyarrow as pa

        texts = pa.array([t for _, t in rows])
        whole = {(int(r), int(s + o)) for row, off, runs in substrings.segments(texts, 13) for r, o, s in zip(row[runs.piece], off[runs.piece], runs.start - runs.starts[runs.piece], strict=True)}
        monkeypatch.setattr(substrings, "SEGMENT", 1 << 19)
        once = {(int(r), int(s + o)) for row, off, runs in substrings.segments(texts, 13) for r, o, s in zip(row[runs.piece], off[runs.piece], runs.start - runs.starts[runs.piece], strict=True)}
        assert once <= whole and np.all([len(t.as_py().split()) >= 13 for t in texts.take(pa.array(sorted({r for r, _ in whole})))])
        assert found(substrings.repeats_digest(frame)) == brute(rows)
    finally:
        spark.conf.set(name, before)


def test_runs_cover_every_window_once():
    import numpy as np

    draw = np.random.default_rng(4)
    sequences = [draw.integers(0, 4, n).astype(np.uint64) for n in (0, 5, 12, 13, 14, 90)]
    runs = substrings.Runs(sequences, 13)
    starts = runs.window_starts(np.arange(len(runs.start)))
    assert starts.tolist() == [s + i for s, q in zip(runs.starts, sequences, strict=True) for i in range(len(q) - 12)]
    said: dict = {}
    joined = np.concatenate(sequences)
    for at, h in zip(starts, runs.window_hashes(starts), strict=True):
        assert said.setdefault(tuple(joined[at : at + 13]), h) == h
    assert len(set(said.values())) == len(said)


def test_same_as_sql(spark):
    assert_same(queries.QUERIES["op13_substrings"](spark, SF), connect(SF), substrings.ORACLE)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    assert found(substrings.repeats_digest(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    kept = substrings.remove_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert kept.filter("doc_id = 6").first().text == ""
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_spans_are_maximal(spark):
    text = [f"a{i}" for i in range(40)]
    rows = [(1, " ".join(text)), (2, "x " + " ".join(text[:20]) + " y " + " ".join(text[20:33]) + " z " + " ".join(text[30:42]))]
    got = {r.row.doc_id: r for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].spans == [] and got[1].text == rows[0][1]
    assert [tuple(s) for s in got[2].spans] == [(1, 20), (22, 13)]
    assert got[2].text == "x y z " + " ".join(text[30:42])


def test_window_of_another_length(spark):
    rows = planted(5, 60)
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    assert sorted((r.row.doc_id, r.n_words, r.n_removed) for r in got.filter("row.doc_id is not null").collect()) == sorted(x[:3] for x in brute(rows, 4) if x[0] is not None)
    assert table(spark, "documents").count() == queries.QUERIES["op13_substrings"](spark, SF).count()

"""Toxicity and language: held-out accuracy, contracts, odd rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language, toxicity
from tests.llm.helpers import is_held_out, odd_documents

SF01, SF1 = "/root/testdata/sf0.01", "/root/testdata/sf0.1"  # the smaller has six held-out toxic rows


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    rows = {r.doc_id: r for r in toxicity.toxicity_digest(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    held = [(rows[r.doc_id].score, r.toxic) for r in labels.collect() if r.doc_id in rows and is_held_out(r.doc_id)]
    right = sum((s >= 0.5) == bool(t) for s, t in held) / len(held)
    pairs = [(a, b) for a, x in held if x for b, y in held if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)
    assert right >= 0.95 and auc >= 0.95, (right, auc)


def test_toxicity_of_odd_documents(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    assert toxicity.toxicity_digest(docs, labels).count() == docs.count()
    assert toxicity.toxicity_digest(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.toxicity_digest(docs.limit(0), labels).collect() == []
    real = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    model = toxicity.fit(*real)
    assert model.score(docs.select("doc_id", "text")).filter("toxicity between 0 and 1").count() == docs.count()
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    truth = {r.doc_id: r for r in docs.select("doc_id", "lang", "text").collect()}
    rows = language.language_digest(docs).collect()
    assert len(rows) == len(truth)
    held = [(r.lang_pred, truth[r.doc_id].lang) for r in rows if r.held_out and truth[r.doc_id].lang and any(c.isalpha() for c in truth[r.doc_id].text or "")]
    right = sum(a == b for a, b in held) / len(held)
    assert right >= 0.9, right
    for r in rows:
        assert r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in truth[r.doc_id].text or ""))


def test_language_of_odd_documents(spark):
    docs = odd_documents(spark)
    rows = language.language_digest(docs).collect()
    assert len(rows) == docs.count()
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4)} == {"und"}
    assert language.language_digest(docs.limit(0)).collect() == []


def test_language_does_not_depend_on_batches(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    names, prototypes = language.train(docs)
    one = {r.doc_id: (r.lang_pred, round(r.score, 5)) for r in language.identify(docs, names, prototypes).collect()}
    two = {r.doc_id: (r.lang_pred, round(r.score, 5)) for r in language.identify(docs.repartition(7), names, prototypes).collect()}
    assert one == two


def test_every_language_gets_a_prototype(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 60)), f"l{i % 600}") for i in range(1300)]
    docs = spark.createDataFrame([*rows, *((5000 + i, "the same text again", "big") for i in range(300))], "doc_id long, text string, lang string")
    names, prototypes = language.train(docs, max_training=10)
    assert len(names) == 601 and np.allclose(np.linalg.norm(prototypes, axis=1), 1)


@pytest.mark.parametrize("text", ["Aé  b1c", "x", "the end. THE END", "ß ñ 12 ñandú"])
def test_bundles_against_plain_products(text):
    letters = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    want = np.zeros(language.DIMENSIONS)
    for i in range(len(letters) - 2):
        bound = np.ones(language.DIMENSIONS)
        for place, letter in enumerate(letters[i : i + 3]):
            bound *= np.roll(language.letter_vector(ord(letter)), 2 - place)
        want += bound
    got, has = language.Bundler().bundles([text])
    assert has[0] and np.allclose(got[0], want / np.linalg.norm(want), atol=1e-5)


def test_toxic_features_by_hand():
    lexicon = {"vile": 2.0, "gro*": 3.0}
    got = toxicity.Describer(lexicon)("YOU are vile, grotty and an IDIOT!! soooo st*pid you")
    words = 10  # you are vile grotty and an idiot soooo st pid you: eleven runs of letters
    words += 1
    assert got[0] == pytest.approx(np.log1p(words)) and got[1] == pytest.approx(1 / words)  # idiot
    assert got[3] == pytest.approx(2 / words) and got[5] == 3.0 and got[6] == pytest.approx(5 / words) and got[7] == 2.0
    assert got[8] == pytest.approx(2 / words)  # you, twice
    assert got[11] == pytest.approx(8 / 40, abs=0.02)  # YOU and IDIOT among the letters A-Z, a-z
    assert got[12] == pytest.approx(2 / words) and got[13] == pytest.approx(2 / words)
    assert got[15] == pytest.approx(1 / words) and got[16] == pytest.approx(1 / words)
    assert toxicity.Describer(lexicon)(None) == [0.0] * toxicity.N_FEATURES


def test_toxicity_does_not_depend_on_row_order_or_foreign_labels(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000))  # each text twice, half of them without a label
    more = labels.unionByName(labels.limit(20).withColumn("toxic", F.lit(7)))
    one = toxicity.fit(docs, labels)
    two = toxicity.fit(docs.repartition(5, "text").sortWithinPartitions(F.desc("doc_id")), more)
    assert one.lexicon == two.lexicon and one.lexicon
    rounded = lambda m: re.sub(r"\d+\.\d+(E-?\d+)?", lambda x: f"{float(x[0]):.9g}", m.trees.toDebugString.split("\n", 1)[1])  # noqa: E731  sums of parts come in any order
    assert rounded(one) == rounded(two)


def test_rare_class_is_thinned_last():
    assert toxicity.shares({0: 1_000_000, 1: 300}, 20_000) == {0: 0.0197, 1: 1.0}
    assert toxicity.shares({0: 1_000_000, 1: 500_000}, 20_000) == {0: 0.01, 1: 0.02}
    assert toxicity.shares({0: 5}, 20_000) == {0: 1.0} and toxicity.shares({}, 20_000) == {}

"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features are rates: hits of a written lexicon and of a lexicon learned from the labelled texts, hits near a
second-person word, capitals, punctuation, obfuscated spellings. Both lexicons are matched in one pass of an
Aho-Corasick automaton over the whole text.

Learning uses a bounded sample of labelled texts (``MAX_TRAINING``), in which a rare class is thinned last and
each text weighs as many as it stands for. The learned lexicon holds words and word beginnings that mark toxic
texts; for training, each half of the texts is described by the lexicon of the other half, so that trees see
hits as often as they will in new texts. A quarter of the texts is kept from the trees and calibrates them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, packed, staged

#: Labelled rows that the model is fitted on, as an expected number; more are thinned by a hash of the id, each class to half of them or what the other leaves.
MAX_TRAINING = 20_000
#: Entries of the learned lexicon (the model's size); texts that must hold an entry; least log-odds of an entry.
MAX_ENTRIES, MIN_TEXTS, MIN_LOG_ODDS = 400, 3, 2.5
PREFIXES = (4, 5, 6)
FIT_TASKS = 4
NEAR = 40

#: Insults, and second-person words of four languages.
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "scum", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "fool", "imbecile", "jerk", "hate", "kill", "ugly", "filthy", "vermin", "shut up")
SECOND_PERSON = ("you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "te", "ton", "vous", "votre", "usted", "ustedes", "tú", "ti", "vosotros")
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""}

N_FEATURES = 18

_MIXED = re.compile(r"[^\W\d_][0-9@$*!]+[^\W\d_]")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W\d_])")
_SHOUTED = re.compile(r"(?<![^\W\d_])[A-Z]{3,}(?![^\W\d_])")
_MIXED_WORD = re.compile(r"[\w@$*!]*[^\W\d_][0-9@$*!]+[^\W\d_][\w@$*!]*")


class _ToBlank(dict):
    """For str.translate: letters stay, all else is a blank."""

    def __missing__(self, code: int) -> int:
        self[code] = code if chr(code).isalpha() else 32
        return self[code]


class Describer:
    """The features of a text under a learned lexicon {entry: log-odds}; an entry that ends in ``*`` is a beginning of words."""

    def __init__(self, lexicon: dict[str, float]):
        self.blank = _ToBlank()
        entries: dict[str, list[tuple[int, float]]] = {}
        for kind, words in ((0, INSULTS), (1, SECOND_PERSON)):
            for word in words:
                entries.setdefault(f" {word} ", []).append((kind, 1.0))
        for word, weight in lexicon.items():
            entries.setdefault(f" {word[:-1]}" if word.endswith("*") else f" {word} ", []).append((2, weight))
        self.automaton = ahocorasick.Automaton()
        for text, values in entries.items():
            self.automaton.add_word(text, (text, values))
        self.automaton.make_automaton()
        self.unleet = str.maketrans(LEET)

    def hits(self, plain: str) -> Iterator[tuple[int, str, int, float]]:
        for end, (text, values) in self.automaton.iter(plain):
            for kind, weight in values:
                yield end, text, kind, weight

    def __call__(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * N_FEATURES
        plain = f" {text.lower().translate(self.blank)} "
        words = max(1, len(plain.split()))
        insults = learned = weighted = top = close = persons = 0.0
        found: set[str] = set()
        last_person, waiting = -math.inf, []
        for end, entry, kind, weight in self.hits(plain):
            if kind == 1:
                persons += 1
                last_person = end
                close += sum(end - at <= NEAR for at in waiting)
                waiting = []
                continue
            if kind == 0:
                insults += 1
            else:
                learned += 1
                weighted += weight
                top = max(top, weight)
                found.add(entry)
            if end - last_person <= NEAR:
                close += 1
            else:
                waiting = [at for at in waiting if end - at <= NEAR] + [end]
        bytes_of = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        upper, lower, digits = bytes_of[65:91].sum(), bytes_of[97:123].sum(), bytes_of[48:58].sum()
        marks = bytes_of[33:127].sum() - upper - lower - digits
        mixed = _MIXED_WORD.findall(text) if _MIXED.search(text) else []
        hidden = f" {' '.join(mixed).lower().translate(self.unleet).translate(self.blank)} " if mixed else ""
        uncovered = sum(kind != 1 for _, _, kind, _ in self.hits(hidden)) if mixed else 0
        return [
            math.log1p(words), insults / words, math.log1p(insults), learned / words, math.log1p(learned), top, weighted / words, float(len(found)), persons / words,
            close / words, math.log1p(close), upper / max(1, upper + lower), len(_SHOUTED.findall(text)) / words, (bytes_of[33] + bytes_of[63]) / words, marks / max(1, len(text)),
            len(mixed) / words, (len(_REPEATED.findall(text)) + len(_SPACED.findall(text))) / words, float(uncovered),
        ]


def _describe(lexicon: dict[str, float]):
    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        describe = Describer(lexicon)
        return pd.Series([describe(t) for t in texts])

    return features


def _entries(rows: DataFrame) -> DataFrame:
    """entry, half, toxic texts and clean texts that hold it."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    forms = [words] + [F.transform(words, _beginning(n)) for n in PREFIXES]
    held = F.filter(F.array_distinct(F.concat(*forms)), lambda e: F.length(e) > 1)
    exploded = rows.select("half", "toxic", F.explode(held).alias("entry"))
    halves = [F.sum(F.when((F.col("half") == h) & (F.col("toxic") == t), 1).otherwise(0)).alias(f"n{h}{t}") for h in (0, 1) for t in (0, 1)]
    return exploded.groupBy("entry").agg(*halves).filter(F.col("n01") + F.col("n11") >= MIN_TEXTS)


def _beginning(n: int):
    return lambda w: F.when(F.length(w) >= n, F.concat(F.substring(w, 1, n), F.lit("*"))).otherwise(F.lit(""))


def learn_lexicon(rows: DataFrame) -> list[dict[str, float]]:
    """Lexicons {entry: log-odds} of half 0, of half 1 and of all rows; the strongest entries, at most ``MAX_ENTRIES`` each."""
    totals = rows.groupBy("half", "toxic").count().collect()
    count = {(r["half"], r["toxic"]): r["count"] for r in totals}
    entries = staged(_entries(rows), "toxic-entries")
    out = []
    for halves in ((0,), (1,), (0, 1)):
        toxic, clean = (sum((F.col(f"n{h}{t}") for h in halves), F.lit(0)) for t in (1, 0))
        all_toxic, all_clean = (sum(count.get((h, t), 0) for h in halves) for t in (1, 0))
        odds = F.log((toxic + 0.5) / (all_toxic + 1)) - F.log((clean + 0.5) / (all_clean + 1))
        best = entries.select("entry", odds.alias("odds"), toxic.alias("toxic")).filter((F.col("odds") >= MIN_LOG_ODDS) & (F.col("toxic") >= MIN_TEXTS))
        top = best.orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "entry").limit(MAX_ENTRIES).collect()
        out.append({r.entry: r.odds for r in top})
    return out


class Toxicity:
    """A fitted model: the lexicon, the trees and the calibration; None for the last two where the labels had one class only."""

    def __init__(self, lexicon: dict[str, float], trees: GBTClassificationModel | None, calibration: IsotonicRegressionModel | None):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def raw(self, rows: DataFrame, features) -> DataFrame:
        """``rows`` and ``tox_raw``, the trees' probability."""
        out = self.trees.transform(rows.withColumn("tox_features", array_to_vector(features)))
        return out.withColumn("tox_raw", vector_to_array("tox_probability")[1]).drop("tox_features", "tox_margins", "tox_probability", "tox_prediction")

    def score(self, docs: DataFrame, column: str = "toxicity") -> DataFrame:
        """``docs`` and ``column``, 0 to 1. Calibrated steps are kept in the trees' order by a hundredth of their probability."""
        if self.trees is None:
            return docs.withColumn(column, F.lit(0.0))
        rows = self.raw(docs, _describe(self.lexicon)(F.col("text")))
        if self.calibration is None:
            return rows.withColumnRenamed("tox_raw", column)
        rows = self.calibration.transform(rows)
        score = F.least(F.greatest(0.99 * F.col("tox_calibrated") + 0.01 * F.col("tox_raw"), F.lit(0.0)), F.lit(1.0))
        return rows.withColumn(column, score).drop("tox_raw", "tox_calibrated")


def shares(counts: dict[int, int], most: int) -> dict[int, float]:
    """The share of each of two classes that gives ``most`` rows at most: half for each, and what a small one leaves for the other."""
    few = min(counts.values(), default=0)
    quota = {c: max(most / 2, most - few) if n > few else most / 2 for c, n in counts.items()}
    return {c: min(1.0, quota[c] / n) for c, n in counts.items()}


def fit(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> Toxicity:
    """Fit on the texts of ``docs`` that ``labels`` (doc_id, toxic) marks; rows without a text or a label of 0 or 1 are not used. An id or a text with several labels takes the largest."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = shares({r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}, max_training)
    of_class = F.when(F.col("toxic") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    known = known.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) < of_class * (1 << 30))
    known = known.select(F.col("doc_id").alias("known_id"), "toxic", (1 / of_class).alias("weight"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(8)).cast("int")
    rows = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("known_id"))
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic"), F.max("weight").alias("weight")).select("text", "toxic", "weight", (fold % 2).alias("half"), (fold >= 6).alias("calibrates"))
    rows = staged(rows, "toxic-training")
    classes = {(r.toxic, r.calibrates): r["count"] for r in rows.groupBy("toxic", "calibrates").count().collect()}
    if not all(any(classes.get((t, c)) for c in (False, True)) for t in (0, 1)):
        return Toxicity({}, None, None)
    first, second, everything = learn_lexicon(rows)
    described = F.when(F.col("half") == 0, _describe(second)(F.col("text"))).otherwise(_describe(first)(F.col("text")))
    rows = staged(rows.select("toxic", "weight", "calibrates", F.xxhash64("text").alias("place"), described.alias("features")), "toxic-features")
    rows = rows.repartition(FIT_TASKS, "place").sortWithinPartitions("place")  # few rows, summed in the same order in every run
    whole = all(classes.get((t, c)) for t in (0, 1) for c in (False, True))
    fitted = rows.filter(~F.col("calibrates")) if whole else rows
    trees = GBTClassifier(featuresCol="tox_features", labelCol="toxic", predictionCol="tox_prediction", maxIter=20, maxDepth=4, stepSize=0.2, seed=7)
    trees.setRawPredictionCol("tox_margins").setProbabilityCol("tox_probability").setWeightCol("weight")
    model = Toxicity(everything, trees.fit(fitted.select("toxic", "weight", array_to_vector("features").alias("tox_features"))), None)
    kept = model.raw(rows.filter("calibrates") if whole else rows, F.col("features"))
    isotonic = IsotonicRegression(featuresCol="tox_raw", labelCol="toxic", predictionCol="tox_calibrated", weightCol="weight")
    model.calibration = isotonic.fit(kept.select("tox_raw", "weight", F.col("toxic").cast("double").alias("toxic")))
    return model


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; null and empty texts get the score of a text without any mark; repeated rows stay."""
    out = held_out(F.col("doc_id"))
    model = fit(docs.filter(~out), labels)
    scored = model.score(docs.select("doc_id", "text"), "score")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; an empty table gives an empty one."""
    model = fit(docs, labels)
    return model.score(packed(docs, "text")).filter(F.col("toxicity") < threshold).select("row.*")

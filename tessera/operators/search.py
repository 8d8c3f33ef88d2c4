"""Ranked text search: BM25 over weighted fields, expansion of terms, places in questions, kinds of questions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

K1, B = 1.2, 0.3
#: Terms that stand in a larger share of texts say nothing.
STOP_SHARE = 0.5


def postings(texts: DataFrame, key: str, fields: Mapping[str, float]) -> DataFrame:
    """(key, term, tf): weighted counts of the terms of each row's fields."""
    parts = [texts.select(F.col(key).alias("key"), F.explode(T.words(F.col(f))).alias("term"), F.lit(w).alias("w")) for f, w in fields.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("key", "term").agg(F.sum("w").alias("tf"))


#: Query terms that are broadcast at most.
MAX_TERMS = 1 << 20
#: Pairs of a query and a row whose scores one task sums, at most on average.
TASK_PAIRS = 1 << 20


def bm25(texts: DataFrame, key: str, fields: Mapping[str, float], queries: DataFrame, limit: int = 3, stop_share: float = STOP_SHARE) -> DataFrame:
    """query, key, score and place of the best rows of each query. Texts: one row for each ``key``; queries: (query, term).

    Texts are split and their words counted once, row by row. A row leaves the scan with the query's terms that it holds and once
    without a term, for its length; that much is kept on disk, as it is read for the terms' frequencies too. Scores
    are summed in as many tasks as there are pairs, so that what a task holds does not grow with the texts.
    """
    asked = queries.distinct().persist(StorageLevel.DISK_ONLY)
    terms = asked.select("term").distinct()
    terms = F.broadcast(terms) if terms.count() <= MAX_TERMS else terms
    sorted_words = texts.select(F.col(key).alias("key"), F.array(*[F.sort_array(T.words(F.col(f))) for f in fields]).alias("split"))
    length = sum((F.lit(float(w)) * F.greatest(F.size(F.col("split")[i]), F.lit(0)) for i, w in enumerate(fields.values())), F.lit(0.0))
    runs = sorted_words.withColumns({"length": length, "starts": F.transform("split", _run_starts)})
    every = F.concat(*[F.coalesce(_runs(F.col("split")[i], F.col("starts")[i], float(w)), F.array()) for i, w in enumerate(fields.values())], F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("tf"))))
    known = terms.withColumn("asked", F.lit(True))
    found = runs.select("key", "length", F.explode(every).alias("p")).select("key", "length", "p.term", "p.tf").join(known, "term", "left").filter("term is null or asked").select("key", "length", "term", "tf")
    if len(fields) > 1:  # a term of two fields
        found = found.groupBy("key", "length", "term").agg(F.sum("tf").alias("tf"))
    found = found.persist(StorageLevel.DISK_ONLY)
    corpus = found.filter("term is null and length > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    hit = found.filter("term is not null")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = asked.join(df, "term").crossJoin(F.broadcast(corpus)).filter(F.col("df") <= stop_share * F.col("n")).withColumn("idf", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).persist(StorageLevel.DISK_ONLY)
    size = terms.agg(F.count(F.lit(1)).alias("rows"), F.sum("df").alias("meetings"), (F.max("n") * F.count_distinct("query")).alias("pairs")).first()
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = max(least, -(-min(size["meetings"] or 0, size["pairs"] or 0) // TASK_PAIRS))
    if size["rows"] <= MAX_TERMS:  # sums are made where a row's terms are
        met = hit.repartition(deal, "key").join(F.broadcast(terms), "term")
    else:
        met = hit.join(terms, "term").repartition(deal, "key")
    scored = met.withColumn("part", F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean"))))
    ranked = scored.groupBy("query", "key").agg(F.round(F.sum("part"), 5).alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key")).cast("long")
    return ranked.withColumn("place", place).filter(F.col("place") <= limit)


def _run_starts(words: Column) -> Column:
    """Where runs of equal words begin in sorted ``words``, from 1."""
    each = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words)))
    return F.filter(each, lambda i: (i == 1) | (F.get(words, i - 1) != F.get(words, i - 2)))


def _runs(words: Column, starts: Column, weight: float) -> Column:
    """(term, tf) of each run of equal words."""
    after = lambda at: F.coalesce(F.get(starts, at + 1), F.size(words) + 1)
    return F.transform(starts, lambda i, at: F.struct(F.get(words, i - 1).alias("term"), (F.lit(weight) * (after(at) - i)).alias("tf")))


def deletions(word: Column) -> Column:
    """A word and what is left of it without one of its letters."""
    without = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.concat(F.array(word), without))


def one_typo_pairs(terms: DataFrame, words: DataFrame) -> DataFrame:
    """``terms`` (term) beside those of ``words`` (word and other columns) that are one typo away: a letter changed, added or left out, or two neighbours swapped.

    Two such words have a form in common once each may lose a letter, so that an equi-join on these forms misses none; as
    many rows as a word has letters, and one more, meet there.
    """
    left = terms.select("term", F.explode(deletions(F.col("term"))).alias("form"))
    right = words.withColumn("form", F.explode(deletions(F.col("word"))))
    return left.join(right, "form").drop("form").distinct().filter(T.one_typo(F.col("term"), F.col("word")))


def expand(vocabulary: DataFrame, terms: DataFrame, candidates: int = 2) -> DataFrame:
    """Matches of each term in a vocabulary (term, df): itself 1.0, longer words that begin with it 0.8, else the most frequent one-typo words 0.6.

    Typos are looked for in the deletion neighbourhood, which is complete.
    """
    v = vocabulary.select(F.col("term").alias("word"), "df")
    exact = terms.join(v, F.col("term") == F.col("word")).select("term", "word", F.lit(1.0).alias("factor"))
    head = F.substring("term", 1, 4)
    prefix = terms.filter(F.length("term") >= 4).withColumn("h", head).join(v.withColumn("h", F.substring("word", 1, 4)), "h").filter(F.startswith("word", "term") & (F.col("word") != F.col("term"))).select("term", "word", F.lit(0.8).alias("factor"))
    rest = terms.join(exact.select("term").unionByName(prefix.select("term")).distinct(), "term", "left_anti")
    near = one_typo_pairs(rest.select("term").distinct(), v)
    typo = near.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("df"), "word"))).filter(F.col("place") <= candidates).select("term", "word", F.lit(0.6).alias("factor"))
    return exact.unionByName(prefix).unionByName(typo)


def find_places(questions: DataFrame, places: DataFrame, longest: int = 3) -> DataFrame:
    """Places named in questions: phrases of up to ``longest`` words; a phrase inside a longer found one does not count."""
    w = questions.select("question", T.words(F.col("text")).alias("w"))
    spans = w.select("question", "w", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n")).filter(F.size("w") >= F.col("n"))
    grams = spans.select("question", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("at", "phrase"))
    named = places.select("code", F.array_join(T.words(F.col("name")), " ").alias("phrase"))
    hits = grams.join(named, "phrase")
    wider = hits.select("question", F.col("n").alias("n2"), F.col("at").alias("at2"))
    inside = (F.col("n2") > F.col("n")) & (F.col("at2") <= F.col("at")) & (F.col("at2") + F.col("n2") >= F.col("at") + F.col("n"))
    return hits.join(wider, (hits["question"] == wider["question"]) & inside, "left_anti").select("question", "code").distinct()


def question_kind(text: Column) -> Column:
    """The plan that answers a question: define, relation, compare, trend, rank or value."""
    low = F.lower(text)
    rules = (("define", r"what (is|does) .* mean|definition"), ("relation", r"relat|depend|correlat"), ("compare", r"compare|versus| vs\.? |difference between"), ("trend", r"over time|change|grow|since|trend"), ("rank", r"highest|lowest|top|rank|best|worst|most|least"))
    out = F.lit("value")
    for kind, pattern in reversed(rules):
        out = F.when(F.rlike(low, F.lit(pattern)), kind).otherwise(out)
    return out


def match_labels(labels: DataFrame, directory: DataFrame) -> DataFrame:
    """Labels to codes: exact normalised name, then the only name that begins with it, then the nearest name if it is near and clearly nearest.

    The directory is a dimension (hundreds of names); labels that are left after the equi-joins are compared
    with the names that share a first letter.
    """
    names = directory.select("code", T.label(F.col("name")).alias("name"))
    wanted = labels.select("label", T.label(T.fold_lookalikes(F.col("label"))).alias("clean")).distinct()
    exact = wanted.join(names, F.col("clean") == F.col("name")).select("label", "code", F.lit("exact").alias("how"))
    rest = wanted.join(exact, "label", "left_anti").filter(F.length("clean") >= 3)
    near = rest.withColumn("h", F.substring("clean", 1, 1)).join(F.broadcast(names.withColumn("h", F.substring("name", 1, 1))), "h")
    prefix = near.filter(F.startswith("name", "clean")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("code").alias("code")).filter("n = 1").select("label", "code", F.lit("prefix").alias("how"))
    score = 1 - F.levenshtein("clean", "name") / F.greatest(F.length("clean"), F.length("name"))
    ranked = near.join(prefix, "label", "left_anti").withColumn("score", score).withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "code"))).withColumn("next", F.lead("score").over(Window.partitionBy("label").orderBy(F.desc("score"), "code")))
    fuzzy = ranked.filter((F.col("place") == 1) & (F.col("score") >= 0.75) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= 0.05)).select("label", "code", F.when(F.col("score") >= 0.9, "fuzzy").otherwise("ask").alias("how"))
    return exact.unionByName(prefix).unionByName(fuzzy)

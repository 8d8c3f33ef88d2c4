"""Labels of places to codes: fourteen rules in a fixed order, each a join; one window settles which rule speaks.

A rule gives candidates (label, rank, step, kind, code, candidates); of all candidates of a label the first rule's counts. What
rules look in are dimensions of some hundred names, joined on equality; only the last rule compares texts, and
only those that share three letters in a row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.staging import stored

#: The rules, first to last.
STEPS = ("code", "coded", "quiet", "remembered", "exact", "outside", "ambiguous", "short", "qualified", "composite", "country phrase", "organisation", "municipal", "fuzzy")
#: Words of kinds of places, of labels that name none, of organisations and of towns.
KINDS = r"\b(republic|kingdom|state|region|district|province|islands?|of|the)\b"
QUIET = r"^(total|in total|all|of which|including|among them|source|note|continued)\b\W*$"
ORGANISATIONS = r"\b(company|corporation|inc|ltd|bank|university|ministry|office)\b"
TOWNS = r"\b(city|town|village|municipal|municipality|urban)\b"
#: Likeness that a fuzzy match has, that makes it certain, and by which it is ahead of the next.
LIKE, CERTAIN, AHEAD = 0.75, 0.9, 0.05


@dataclass(frozen=True)
class Directory:
    """names (code, name; the country too), codes (number, code), aliases (name, code; one name may have several), outside (name), remembered (label, code), parts (whole, name) and the country's code."""

    names: DataFrame
    codes: DataFrame
    aliases: DataFrame
    outside: DataFrame
    remembered: DataFrame
    parts: DataFrame
    country: str


def key(text: Column) -> Column:
    """What labels are compared by: see ``functions.text.label``; marks at the ends go."""
    return F.trim(F.regexp_replace(T.label(T.fold_lookalikes(text)), r"^[^\p{L}\p{N}(]+|[^\p{L}\p{N})]+$", ""))


def without_kinds(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, KINDS, " "), r"\s+", " "))


def _trigrams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substr(text, i, F.lit(3))))


def match_cascade(labels: DataFrame, directory: Directory) -> DataFrame:
    """label, step, kind (exact, remembered, outside, ask, municipal, fuzzy or none), code and candidates (codes, joined by commas) of each different label; step is null where no rule speaks."""
    wanted = stored(labels.select("label").distinct().withColumn("key", key(F.col("label"))), "labels")
    names = directory.names.select("code", key(F.col("name")).alias("name")).distinct()

    def said(rows: DataFrame, step: str, kind: str | Column, code: Column | None = None, candidates: Column | None = None) -> DataFrame:
        kind = kind if isinstance(kind, Column) else F.lit(kind)
        code = F.lit(None).cast("string") if code is None else code
        return rows.select("label", F.lit(STEPS.index(step)).alias("rank"), F.lit(step).alias("step"), kind.alias("kind"), code.alias("code"), F.coalesce(F.lit("") if candidates is None else candidates, F.lit("")).alias("candidates"))

    # names that several places have are asked about; the others are sure
    called = directory.aliases.select(key(F.col("name")).alias("name"), "code").unionByName(names).groupBy("name").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    called = stored(called, "names")
    sure = called.filter("size(codes) = 1").select("name", F.col("codes")[0].alias("code"))
    doubtful = called.filter("size(codes) > 1").select("name", F.array_join("codes", ",").alias("several"))
    numbers = directory.codes.select(F.col("number").cast("string").alias("number"), F.col("code"))
    coded = wanted.withColumns({"number": F.regexp_extract("key", r"^(\d+)\b", 1), "rest": F.trim(F.regexp_replace("key", r"^\d+\W*", ""))}).join(numbers, "number")
    known = lambda rows, column: rows.join(sure, F.col(column) == F.col("name"))
    short = sure.select(without_kinds(F.col("name")).alias("name"), "code").filter("name <> ''").groupBy("name").agg(F.collect_set("code").alias("codes")).filter("size(codes) = 1").select("name", F.col("codes")[0].alias("code"))
    bare = wanted.withColumn("bare", without_kinds(F.col("key"))).join(short.withColumnRenamed("name", "bare"), "bare")
    before = wanted.withColumn("before", key(F.regexp_extract("key", r"^([^(]+)\(", 1))).filter("before <> ''")
    pieces = wanted.filter(F.rlike("key", F.lit(r",| and "))).select("label", F.explode(F.array_distinct(F.transform(F.split("key", r"\s*(?:,| and )\s*"), lambda p: F.trim(p)))).alias("piece"))
    found = pieces.join(sure.withColumnRenamed("name", "piece"), "piece", "left").groupBy("label").agg(F.array_sort(F.collect_list("piece")).alias("pieces"), F.bool_and(F.col("code").isNotNull()).alias("all_known"))
    wholes = directory.parts.groupBy("whole").agg(F.array_sort(F.collect_set(key(F.col("name")))).alias("pieces"))
    composite = found.filter("all_known and size(pieces) > 1").join(wholes, "pieces", "left")
    country = directory.names.filter(F.col("code") == directory.country).select(key(F.col("name")).alias("country_name"))
    phrase = wanted.crossJoin(F.broadcast(country.limit(1))).filter(F.contains(F.concat(F.lit(" "), "key", F.lit(" ")), F.concat(F.lit(" "), "country_name", F.lit(" "))) & (F.col("key") != F.col("country_name")))
    grams = names.withColumn("gram", F.explode(_trigrams(F.col("name"))))
    near = wanted.filter(F.length("key") >= 4).withColumn("gram", F.explode(_trigrams(F.col("key")))).join(grams, "gram").select("label", "key", "name", "code").distinct()
    ranked = near.withColumn("like", 1 - F.levenshtein("key", "name") / F.greatest(F.length("key"), F.length("name")))
    order = Window.partitionBy("label").orderBy(F.desc("like"), "code")
    best = ranked.withColumns({"place": F.row_number().over(order), "next": F.lead("like").over(order)}).filter((F.col("place") == 1) & (F.col("like") >= LIKE) & (F.col("like") - F.coalesce("next", F.lit(0.0)) >= AHEAD))
    sure_enough = F.col("like") >= CERTAIN
    candidates = [
        said(coded.filter("rest = ''"), "code", "exact", F.col("code")),
        said(coded.filter("rest <> ''"), "coded", "exact", F.col("code")),
        said(wanted.filter((F.col("key") == "") | F.rlike("key", F.lit(QUIET))), "quiet", "none"),
        said(wanted.join(directory.remembered.select(key(F.col("label")).alias("key"), "code"), "key"), "remembered", "remembered", F.col("code")),
        said(known(wanted, "key"), "exact", "exact", F.col("code")),
        said(wanted.join(directory.outside.select(key(F.col("name")).alias("key")).distinct(), "key"), "outside", "outside"),
        said(wanted.join(doubtful, F.col("key") == F.col("name")), "ambiguous", "ask", None, F.col("several")),
        said(bare, "short", "exact", F.col("code")),
        said(known(before, "before"), "qualified", "exact", F.col("code")),
        said(composite, "composite", F.when(F.col("whole").isNull(), "outside").otherwise("exact"), F.col("whole")),
        said(phrase, "country phrase", "ask", None, F.lit(directory.country)),
        said(wanted.filter(F.rlike("key", F.lit(ORGANISATIONS))), "organisation", "outside"),
        said(wanted.filter(F.rlike("key", F.lit(TOWNS))), "municipal", "municipal"),
        said(best, "fuzzy", F.when(sure_enough, "fuzzy").otherwise("ask"), F.when(sure_enough, F.col("code")), F.when(~sure_enough, F.col("code"))),
    ]
    every = reduce(DataFrame.unionByName, candidates)
    first = F.row_number().over(Window.partitionBy("label").orderBy("rank", "code", "candidates"))
    settled = every.withColumn("_i", first).filter("_i = 1").drop("_i", "rank")
    return wanted.select("label").join(settled, "label", "left").select("label", "step", F.coalesce("kind", F.lit("none")).alias("kind"), "code", F.coalesce("candidates", F.lit("")).alias("candidates"))

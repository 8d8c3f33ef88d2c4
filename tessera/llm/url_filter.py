"""URL filter: written rules first, else logistic regression on hashed character n-grams of host and path.

The regression is trained on the small table of labelled URLs below (a parameter). Features are counts of
hashed n-grams. Grams, hashing and score are expressions and JVM transformers of one scan, so pages are
neither shuffled nor sent to Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (what is done, host, path prefix) of the rules; a rule's name is host + path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: (URL, 1 to block): invented hosts of the kinds that page filters meet.
LABELLED = (
    ("https://casino-royal-spins.example/slots/bonus", 1), ("http://free-poker-chips.example/win/jackpot", 1), ("https://bet-now.example/odds/live", 1), ("http://slots4you.example/casino/free-spins", 1),
    ("http://cheap-pills.example/buy/viagra-online", 1), ("https://rx-discount.example/pharmacy/no-prescription", 1), ("http://weightloss-miracle.example/buy/now", 1), ("http://meds24.example/order/cheap?ref=ad", 1),
    ("http://xxx-tube.example/video/adult-777", 1), ("https://hot-cams.example/live/sex", 1), ("http://adult-dating.example/join/free", 1), ("http://porn-hd.example/xxx/clip", 1),
    ("http://payday-loan-fast.example/apply/instant-cash", 1), ("https://crypto-doubler.example/invest/earn-money", 1), ("http://work-from-home-cash.example/earn/777", 1), ("http://get-rich.example/forex/signals", 1),
    ("http://download-crack.example/keygen/serial", 1), ("http://warez-full.example/torrent/crack", 1), ("https://win-iphone.example/survey/prize", 1), ("http://click-track.example/ad/redirect", 1),
    ("http://buy-followers.example/cheap/likes", 1), ("http://replica-watches.example/buy/cheap", 1), ("http://seo-backlinks.example/buy/links", 1), ("http://spam-mailer.example/bulk/email", 1),
    ("https://www.citylibrary.example/catalogue/books", 0), ("https://university-press.example/articles/history", 0), ("https://docs.toolkit.example/guide/install.html", 0), ("https://encyclopedia.example/wiki/Astronomy", 0),
    ("https://news-daily.example/en/2021/05/report", 0), ("https://blog.gardening.example/post/roses", 0), ("https://school.example/lessons/maths/fractions", 0), ("https://museum.example/exhibitions/2020", 0),
    ("https://health-institute.example/topics/nutrition", 0), ("https://weather.example/forecast/north", 0), ("https://forum.cycling.example/thread/4711", 0), ("https://recipes.example/soups/lentil.html", 0),
    ("https://m.newspaper.example/de/politik/123", 0), ("https://journal.example/fr/sciences/article", 0), ("https://parliament.example/es/leyes/2019", 0), ("https://archive.example/en/manuscripts", 0),
    ("https://www.railways.example/timetable?from=a", 0), ("https://software.example/docs/api/index.html", 0), ("https://statistics.example/tables/population", 0), ("https://choir.example/concerts", 0),
    ("https://courses.example/physics/optics", 0), ("https://townhall.example/services/permits", 0), ("https://poetry.example/authors/index", 0), ("https://birds.example/species/heron", 0),
)

GRAM_SIZES = (3, 4)
BUCKETS = 4096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for texts without ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def grams(host: Column, path: Column, sizes: Sequence[int] = GRAM_SIZES) -> Column:
    """All n-grams of ``^host$`` and of ``^path$`` lower-cased, the part's letter in front. The marks make each part at least two long."""

    def of(letter: str, text: Column, n: int) -> Column:
        found = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))  # one pass, so long URLs take time in proportion
        return F.transform(F.when(F.length(text) < n, F.array(text)).otherwise(found), lambda g: F.concat(F.lit(letter), g))

    marked = {"h": F.concat(F.lit("^"), host, F.lit("$")), "p": F.concat(F.lit("^"), F.lower(path), F.lit("$"))}
    return F.concat(*[of(letter, text, n) for letter, text in marked.items() for n in sizes])


def train(spark: SparkSession, labelled: Sequence[tuple[str, int]] = LABELLED, buckets: int = BUCKETS):
    """HashingTF and the fitted regression. The table of labels is small by contract: it is the caller's parameter."""
    table = spark.createDataFrame(list(labelled), "url string, label int").coalesce(1)
    host, path = split_url(F.col("url"))
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=buckets)
    features = hashing.transform(table.select(F.col("label").cast("double").alias("label"), grams(host, path).alias("grams")))
    return hashing, LogisticRegression(maxIter=50, regParam=0.02, featuresCol="features", labelCol="label", rawPredictionCol="margins").fit(features)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls. A rule fits its host and all subdomains if the path starts with the rule's."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: Sequence[tuple[str, int]] = LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the regression's probability of ``block``) for every row.

    Null URLs and texts without ``://`` have empty host and path, no rule, and the verdict that the
    regression gives to empty parts; long URLs are read whole; repeated rows stay.
    """
    host, path = split_url(F.col("url"))
    hashing, model = train(pages.sparkSession, labelled)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("grams", grams(F.col("host"), F.col("path")))
    scored = model.transform(hashing.transform(rows))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    guess = F.when(F.col("prediction") == 1.0, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, guess).alias("verdict"), vector_to_array("probability")[1].alias("score"))

"""What a source must be before it is loaded: columns, types, volumes, known territories; and JSON bundles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Types that stand for each other.
FAMILIES = {"tinyint": "whole", "smallint": "whole", "int": "whole", "bigint": "whole", "long": "whole", "float": "real", "double": "real", "timestamp": "time", "timestamp_ntz": "time", "string": "text"}


def family(kind: str) -> str:
    return FAMILIES.get(kind, "other")


def types_compatible(actual: str, expected: str) -> bool:
    """Equal, or of one family (whole numbers, real numbers)."""
    return actual == expected or (family(actual) == family(expected) != "other")


def type_families(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, family(t)) for c, t in df.dtypes], "column string, family string")


def profile_source(df: DataFrame, expected: Mapping[str, str], key: str, value: str, least: Mapping[str, int]) -> DataFrame:
    """item, amount and whether it is fine: missing columns, wrong types, rows and distinct keys against the least asked, and the values' profile."""
    have = dict(df.dtypes)
    faults = [(f"missing: {c}", None, False) for c in expected if c not in have] + [(f"type: {c}", None, False) for c, t in expected.items() if c in have and not types_compatible(have[c], t)]
    v = F.col(value)
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"), F.count(F.when(v.isNull(), 1)).alias("empty"), F.count(F.when(v < 0, 1)).alias("negative"), F.min(v).alias("low"), F.max(v).alias("high"))
    items = (("rows", "rows"), ("keys", "keys"), ("empty values", "empty"), ("negative values", "negative"), ("least", "low"), ("most", "high"))
    found = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(c).cast("double").alias("amount"), (F.col(c) >= least[n] if n in least else F.lit(True)).alias("fine")) for n, c in items])).alias("i")).select("i.*")
    return df.sparkSession.createDataFrame(faults, "item string, amount double, fine boolean").unionByName(found)


def unmapped(rows: DataFrame, directory: DataFrame, column: str) -> DataFrame:
    """Names of a source that the directory does not have, and their rows."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).join(directory.select(column).distinct(), column, "left_anti")


def json_measures(bundle: DataFrame, nation: DataFrame, kinds: tuple[str, ...] = ("click", "view", "purchase")) -> DataFrame:
    """Measures of a JSON bundle: elements of the kinds asked, mapped to territories, with a guard against values that contradict each other."""
    rows = bundle.filter(F.col("event_type").isin(*kinds)).select((F.col("user_id") % 30).alias("n_nationkey"), F.col("event_type").alias("measure"), F.get_json_object("props", "$.k").cast("double").alias("value")).filter("value is not null")
    mapped = rows.join(F.broadcast(nation.select("n_nationkey")), "n_nationkey").groupBy(F.concat(F.lit("N"), "n_nationkey").alias("territory_code"), "measure")
    return mapped.agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n"), (F.count_distinct("value") > 1).alias("conflict"))


def registry_at(events: DataFrame, unit: str, territories: int = 25, places: int = 30) -> DataFrame:
    """Entries of a registry on its last day, as measures of territories; those of strangers get the prefix ``ext:``."""
    day = F.date_trunc(unit, "ts")
    last = events.agg(F.max(day).alias("last"))
    place = F.col("user_id") % places
    code = F.when(place < territories, F.concat(F.lit("N"), place)).otherwise(F.concat(F.lit("ext:"), place))
    return events.join(F.broadcast(last), day == F.col("last")).groupBy(code.alias("territory_code"), F.col("event_type").alias("measure")).agg(F.count(F.lit(1)).alias("value"))

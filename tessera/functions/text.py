"""Text functions as column expressions: normalising, tokens, typos, labels, cells, periods, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters that look like Cyrillic ones, in the same order.
LATIN, CYRILLIC = "ABCEHKMOPTXaceopxy", "АВСЕНКМОРТХасеорху"

WORD = r"([0-9a-zà-ÿа-я²³%]+)"
DASHES = r"^[-–—−]$"
ELLIPSIS = r"^(…|\.{2,3})$"


def normalize(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), "ё", "е")


def words(text: Column) -> Column:
    return F.regexp_extract_all(normalize(text), F.lit(WORD), F.lit(1))


def stem(word: Column) -> Column:
    """A light stem: common endings of English go, at least three letters stay."""
    cut = F.regexp_replace(word, r"(?<=.{3})(ings|ing|ed|es|s|ly)$", "")
    return F.when(F.length(word) > 4, cut).otherwise(word)


def one_typo(left: Column, right: Column) -> Column:
    """One letter changed, added, left out, or two neighbours swapped."""
    near = F.levenshtein(left, right) == 1
    swapped = (F.length(left) == F.length(right)) & (F.levenshtein(left, right) == 2) & (F.array_join(F.array_sort(F.split(left, "")), "") == F.array_join(F.array_sort(F.split(right, "")), ""))
    neighbours = F.exists(F.sequence(F.lit(1), F.greatest(F.length(left) - 1, F.lit(1))), lambda i: F.concat(F.substr(left, F.lit(1), i - 1), F.substr(left, i + 1, F.lit(1)), F.substr(left, i, F.lit(1)), F.substr(left, i + 2)) == right)
    return near | (swapped & neighbours)


def same_stem(left: Column, right: Column) -> Column:
    """One begins with the other, which has five letters or more and is at most three shorter."""
    return (F.least(F.length(left), F.length(right)) >= 5) & (F.abs(F.length(left) - F.length(right)) <= 3) & (F.startswith(left, right) | F.startswith(right, left))


def label(text: Column) -> Column:
    """A territory's label without no-break blanks, footnote marks, doubled blanks and odd dashes, in lower case."""
    out = F.regexp_replace(text, r"[  ]", " ")
    out = F.regexp_replace(out, r"\s*(\d+\)|\*+)+\s*$", "")
    out = F.regexp_replace(out, r"[–—−]", "-")
    out = F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+", " ")), r"(?i)\b(\w+)( \1\b)+", "$1")
    return normalize(out)


def fold_lookalikes(text: Column) -> Column:
    """Latin look-alikes in texts that hold Cyrillic letters become Cyrillic."""
    return F.when(F.rlike(text, F.lit(r"[а-яА-ЯёЁ]")), F.translate(text, LATIN, CYRILLIC)).otherwise(text)


def number_text(cell: Column) -> Column:
    """A cell's number as text with a point: grouping blanks, footnotes and percent signs go; of two marks the last is the decimal one."""
    out = F.regexp_replace(F.trim(cell), r"\s*(\d+\)|\*+|%)$", "")
    out = F.regexp_replace(out, r"[\s  ]", "")
    both = F.contains(out, F.lit(",")) & F.contains(out, F.lit("."))
    comma_last = F.locate(",", F.reverse(out)) < F.locate(".", F.reverse(out))
    points = F.regexp_replace(F.regexp_replace(out, r"\.", ""), ",", ".")
    return F.when(both & comma_last, points).when(both, F.regexp_replace(out, ",", "")).otherwise(F.regexp_replace(out, ",", "."))


def cell_value(cell: Column) -> Column:
    return number_text(cell).try_cast("double")


def cell_kind(cell: Column) -> Column:
    """empty, value, missing (a dash), hidden (an ellipsis) or text."""
    trimmed = F.trim(cell)
    return (
        F.when(cell.isNull() | (trimmed == ""), "empty").when(F.rlike(trimmed, F.lit(DASHES)), "missing").when(F.rlike(trimmed, F.lit(ELLIPSIS)), "hidden").when(number_text(cell).try_cast("double").isNotNull(), "value").otherwise("text")
    )


def below_unit(cell: Column) -> Column:
    """A zero with decimals stands for a value below half the unit."""
    return F.rlike(F.trim(cell), F.lit(r"^0[.,]0+$"))


def safe_cell(text: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets an apostrophe in front."""
    return F.when(F.rlike(text, F.lit(r"^[=+\-@]")), F.concat(F.lit("'"), text)).otherwise(text)


def period(text: Column) -> Column:
    """year, kind and number of ``2001``, ``2001-05``, ``05.2001``, ``Q2 2001`` and ``2001 H1``; null for other texts."""
    t = F.upper(F.trim(text))
    year = F.regexp_extract(t, r"(?:^|\D)((?:19|20)\d\d)(?:\D|$)", 1)
    rest = F.trim(F.regexp_replace(t, r"(?:19|20)\d\d", " "))
    quarter, half, month = (F.regexp_extract(rest, p, 1) for p in (r"^Q\s*([1-4])$", r"^H\s*([12])$", r"^[-./]?\s*(0?[1-9]|1[0-2])\s*[-./]?$"))
    kind = F.when(rest == "", "year").when(quarter != "", "quarter").when(half != "", "half").when(month != "", "month")
    number = F.coalesce(F.nullif(quarter, F.lit("")), F.nullif(half, F.lit("")), F.nullif(month, F.lit("")), F.lit("0")).cast("long")
    return F.when((year != "") & kind.isNotNull(), F.struct(year.try_cast("long").alias("year"), kind.alias("kind"), number.alias("number")))


def unit_kind(name: Column) -> Column:
    """index, rate, currency, share, physical, people or unknown, in that order of tests."""
    low, tests = F.lower(name), (("index", "index|percent of"), ("rate", r"\bper\b|rate"), ("currency", "dollar|euro|price|revenue"), ("share", "percent|share|%"), ("physical", r"\b(kg|km|ton|litre|piece)s?\b"), ("people", "person|people|inhabitant|customer"))
    out = F.lit("unknown")
    for kind, pattern in reversed(tests):
        out = F.when(F.rlike(low, F.lit(pattern)), kind).otherwise(out)
    return out


def unit_multiplier(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.rlike(low, F.lit(r"\b(bn|billion)")), 1e9).when(F.rlike(low, F.lit(r"\b(mln|million)")), 1e6).when(F.rlike(low, F.lit(r"\b(k|thousand)")), 1e3).otherwise(1.0)


def polarity(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.rlike(low, F.lit("overdue|debt|failed|loss|delay")), "negative").when(F.rlike(low, F.lit("revenue|growth|income|order")), "positive").otherwise("unknown")


def series_code(indicator: Column, *slices: Column) -> Column:
    """``indicator:00`` without slices, else the first eight digits of a SHA-1 of them."""
    return F.concat_ws(":", indicator, F.substring(F.sha1(F.concat_ws("|", *slices).cast("binary")), 1, 8) if slices else F.lit("00"))


#: Words that say nothing in a question.
STOP_WORDS = ("a", "an", "and", "are", "by", "does", "for", "has", "how", "in", "is", "of", "on", "or", "that", "the", "to", "was", "what", "which", "who", "with")


def stems(text: Column, keep_stop: bool = False) -> Column:
    """Stems of a text's words, without stop words."""
    found = words(text)
    return F.transform(found if keep_stop else F.filter(found, lambda w: ~w.isin(*STOP_WORDS)), stem)


def swapped_stems(word: Column) -> Column:
    """Stems of the variants of a word with two neighbouring letters swapped."""
    places = F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))
    swap = lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, F.lit(1)), F.substr(word, i, F.lit(1)), F.substr(word, i + 2))
    return F.array_sort(F.array_distinct(F.transform(F.when(F.length(word) > 1, places).otherwise(F.array().cast("array<int>")), lambda i: stem(swap(i)))))

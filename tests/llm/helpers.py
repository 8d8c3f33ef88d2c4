"""Small tables with everything that may go wrong in a column."""

from __future__ import annotations

import zlib

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long, text_hash long, size long, shard int, kept_id long, bad_id long, toxicity double, mix_copies int, score double"
LONG = "The quick brown fox jumps over the lazy dog near river number one. " * 30_000


def odd_documents(spark):
    """Null ids, texts and sources, empty and very long texts, repeated rows and columns that the operators use themselves."""
    texts = [
        (1, "You are a stupid idiot and worthless scum.", "en", "web"), (2, "", "en", "web"), (3, None, None, None), (4, "   \t\n ", "de", "web"), (5, LONG, "en", "book"), (6, LONG, "en", "book"),
        (7, "one", "en", "web"), (8, "one two", None, "web"), (9, "ä ö ü ß 1 2 3 ’ don't we'll <|endoftext|>", "de", None), (10, "🙂 ok  twice   blanks \u00a0nbsp\u3000wide", "fr", "wéb"),
        (7, "one", "en", "web"), (None, "no id here at all", "en", "web"), (None, None, None, None), (-5, "negative id", "en", "Web"),
    ]
    extra = ("x", 1, 2, 3, 4, 5, 6, 0.5, 7, 0.25)
    return spark.createDataFrame([(*t, len(t[1] or ""), *extra) for t in texts], DOCUMENTS)


def table(spark, name: str):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0

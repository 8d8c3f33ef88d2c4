import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import tokens
from tests.llm.helpers import odd_documents, table


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def expected(rows):
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    out, start = [], 0
    for r, ids in zip(rows, reference_ids([r.text for r in rows]), strict=True):
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_digest_against_the_tokenizer(spark):
    docs = table(spark, "documents")
    got = [tuple(r) for r in tokens.token_digest(docs).orderBy("doc_id").collect()]
    assert got == expected(docs.select("doc_id", "text").collect())


def test_odd_documents(spark):
    docs = odd_documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = [tuple(r) for r in tokens.token_digest(docs).orderBy("doc_id").collect()]
    assert got == expected(docs.select("doc_id", "text").collect())


def test_null_and_repeated_ids_and_empty_table(spark):
    docs = odd_documents(spark)
    rows = tokens.token_digest(docs).orderBy("start").collect()
    assert len(rows) == docs.count()
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    assert tokens.token_digest(docs.limit(0)).collect() == []


def test_files_give_the_ids_back(spark, tmp_path):
    docs = table(spark, "documents").filter("doc_id < 30")
    tokens.write_tokens(docs, str(tmp_path / "t"))
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r.ids for r in tokens.read_tokens(spark, str(tmp_path / "t")).collect()}
    assert got == dict(zip([r.doc_id for r in rows], reference_ids([r.text for r in rows]), strict=True))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("ab'sS  \t\n\r\x85\x1cĠ\u00a0\u20281½٣’tlvermd.é")), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=40), min_size=1, max_size=6))
def test_ids_are_those_of_the_tokenizer(texts):
    got = [np.frombuffer(b, "<u2").tolist() for b in tokens.encode_texts(texts, tokens.default_tokenizer())]
    assert got == reference_ids(texts)


def test_special_tokens_and_texts_with_equal_polynomial_hashes():
    one, other = "a", "b"
    while len(one) < 1024:
        one, other = one + other, other + one
    texts = [one, other, "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>  <|endoftext|> y", "\x00 \x00\x00 a\x00", "a\u2003 b \u3000c", "中 文 a 中 b", None, ""]
    assert [np.frombuffer(b, "<u2").tolist() for b in tokens.encode_texts(texts, tokens.default_tokenizer())] == reference_ids(texts)


def test_other_tokenizers_get_whole_texts(tmp_path):
    """Files that part texts in another way give the library's ids, long texts included."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    plain = json.loads(open(tokens.default_tokenizer(), encoding="utf-8").read())
    assert tokens.parts_alike(plain)
    paths = [public_tokenizers.path("word_bpe_49k.json")]
    for name, change in (
        ("prefix", {"pre_tokenizer": plain["pre_tokenizer"] | {"add_prefix_space": True}}),
        ("unsplit", {"pre_tokenizer": plain["pre_tokenizer"] | {"use_regex": False}}),
        ("lower", {"normalizer": {"type": "Lowercase"}}),
        ("marked", {"added_tokens": [*plain["added_tokens"], {"id": 50257, "content": "the end.", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}]}),
        ("stripped", {"added_tokens": [t | {"lstrip": True} for t in plain["added_tokens"]]}),
    ):
        paths.append(str(tmp_path / f"{name}.json"))
        with open(paths[-1], "w", encoding="utf-8") as file:
            json.dump(plain | change, file)
    texts = ["A word, the end. And Another\nline", "x <|endoftext|> y", " ", "na\u00efve  caf\u00e9", "Word again. " * (tokens.TEXT_PIECE // 8)]
    for path in paths:
        library = Tokenizer.from_file(path)
        assert not tokens.encoder(path).in_units
        got = [np.frombuffer(b, tokens.encoder(path).kind).tolist() for b in tokens.encode_texts(texts, path)]
        assert got == [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_a_full_table_is_emptied(monkeypatch):
    monkeypatch.setattr(tokens, "POOL", 64)
    monkeypatch.setattr(tokens, "TEXT_PIECE", 50)
    monkeypatch.setattr(tokens, "_ENCODERS", {})
    texts = [" ".join(f"word{i * j % 23} x{i}" for j in range(12)) for i in range(40)]
    assert [np.frombuffer(b, "<u2").tolist() for b in tokens.encode_texts(texts, tokens.default_tokenizer())] == reference_ids(texts)


@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=9), max_size=5))
def test_rows_are_packed_as_if_each_were_alone(rows):
    packed = tokens.pack_rows(np.array([x for row in rows for x in row], np.uint32), np.array([len(row) for row in rows], np.int64))
    assert list(zip(*packed, strict=True)) == [tokens.pack(np.array(row, np.uint32)) for row in rows]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_coding_round_trip(numbers):
    control, data = tokens.pack(np.array(numbers, np.uint32))
    back, taken = tokens.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(numbers))
    assert back.tolist() == numbers and taken == len(data)

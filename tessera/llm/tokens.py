"""Token ids in a compact binary format: frequency ranks in byte-aligned variable-length coding.

Format. A table of blocks in Parquet files, named in ascending order of doc_id. A block holds whole
documents: ``doc_ids`` and ``n_tokens`` of each, ``control`` with two bits for each id (its length in bytes
less one; a document begins on a new control byte) and ``data`` with the ids' frequency ranks, little-endian,
in as many bytes. ``dictionary`` beside it has the id of each rank. Frequent ids take one byte. Decoding
looks up the layout of four ids at once by their control byte and gathers with numpy.

Texts are tokenised once; the same pass counts ids. Ids are staged, coded by rank, dealt by ranges of doc_id,
packed and written. Offsets come from per-file totals, one row a file.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import give_back, new_path, partitions, staged

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
BLOCK_TOKENS = 1 << 20
#: Bytes of text that are encoded at once; slots of a worker's table of units (31 MB); ids that it keeps (at most 32 MB).
TEXT_PIECE, SLOTS, POOL = 1 << 18, 1 << 20, 1 << 23
#: Bytes of a unit that the table can hold.
UNIT = 24
MARKS = b".,;:!?"

_CUT = re.compile(rb"(?<=[!-~]) (?=[!-~])")
_AFTER = np.zeros(256, bool)  # bytes that begin a character that is surely no white space
_AFTER[0x21:0x7F] = _AFTER[0xC3:0xE0] = _AFTER[0xE4:0xEF] = True
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK[list(MARKS)] = True
_MASKS_OF = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class UnitEncoder:
    """Encodes texts with a byte-level tokenizer by way of their units.

    A unit begins with a text; with a single blank, and with and after a single line feed, between two characters
    that are no white space; and with a mark of ``MARKS`` after an ASCII letter. The tokenizer splits a text
    there whatever stands around, so a unit's ids depend on the unit alone. Units of up to ``UNIT`` bytes are
    kept in a table of fixed size, with all their bytes as the key; the others, and those that the table does
    not have, go to the tokenizer. All this is so with tokenizers that ``parts_alike`` admits; others get every
    text whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.in_units = parts_alike(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.blank = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose first byte is a blank
        self.blank[[i for token, i in vocabulary.items() if token[0] == "\u0120"]] = True
        self.feed = vocabulary.get("\u010a", -1)  # the id of a line feed, which parts units that have none
        self.keys, self.lengths = np.zeros((3, SLOTS), np.uint64), np.zeros(SLOTS, np.uint8)
        self.places, self.counts = np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, np.uint8)
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0

    def _encode(self, units: list[bytes], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of some units in one array, and where each begins and how many it has.

        Units of kind 1 hold one blank, their first byte, those of kind 2 no white space: many are encoded in one go.
        """
        sizes = np.zeros(len(units), np.int64)
        parts: list[np.ndarray] = []
        order: list[np.ndarray] = []
        for kind in (1, 2) if self.feed >= 0 else (1,):
            joint = np.flatnonzero(kinds == kind)
            for at in range(0, len(joint), 4096):
                here = joint[at : at + 4096]
                text = (b"" if kind == 1 else b"\n").join([units[i] for i in here])
                ids = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.kind)
                if kind == 1:
                    sizes[here] = np.diff(np.append(np.flatnonzero(self.blank[ids]), len(ids)))
                else:
                    feeds = np.flatnonzero(ids == self.feed)
                    sizes[here] = np.diff(np.concatenate([[-1], feeds, [len(ids)]])) - 1
                    ids = np.delete(ids, feeds)
                parts.append(ids)
                order.append(here)
        single = np.flatnonzero(kinds == 0 if self.feed >= 0 else kinds != 1)
        for at in range(0, len(single), 256):
            here = single[at : at + 256]
            coded = [e.ids for e in self.tokenizer.encode_batch([units[i].decode() for i in here], add_special_tokens=False)]
            sizes[here] = list(map(len, coded))
            parts.append(np.fromiter((i for ids in coded for i in ids), self.kind, int(sizes[here].sum())))
            order.append(here)
        taken = np.concatenate(order)
        firsts = np.zeros(len(units), np.int64)
        firsts[taken] = np.cumsum(sizes[taken]) - sizes[taken]
        return np.concatenate(parts), firsts, sizes

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of some UTF-8 texts, none of which is empty."""
        if not self.in_units:
            return [np.array(e.ids, self.kind) for t in texts for e in [self.tokenizer.encode(t.decode(), add_special_tokens=False)]]
        joined = b"".join(texts)
        n = len(joined)
        data = np.frombuffer(joined + bytes(UNIT), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        firsts = np.cumsum(lengths) - lengths
        blank = data[:n] == 32
        plain = (data[:n] > 32) & (data[:n] < 0x7F)
        before = plain.copy()  # a character ends here that is surely no white space
        before[1:] |= (data[1:n] >= 0x80) & (data[1:n] < 0xC0) & (data[: n - 1] >= 0xC3) & (data[: n - 1] < 0xE0)
        alone = np.zeros(n, bool)  # between two characters that are surely no white space
        alone[1:-1] = before[:-2] & _AFTER[data[2:n]]
        alone[firsts] = alone[firsts[1:] - 1] = False  # neighbours in another text do not count
        feed = alone & (data[:n] == 10)
        begins = (alone & blank) | feed
        begins[1:] |= feed[:-1] | (_MARK[data[1:n]] & _LETTER[data[: n - 1]])
        begins[firsts] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], n)
        sizes = ends - starts
        words = np.ndarray(n + UNIT - 7, "<u8", data, strides=(1,))
        keys = [words[np.minimum(starts + 8 * k, n + UNIT - 8)] & _MASKS_OF[np.clip(sizes - 8 * k, 0, 8)] for k in range(3)]
        mixed = keys[0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[2] * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        slots = (mixed >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)
        hit = (self.lengths[slots] == sizes) & (self.keys[0][slots] == keys[0]) & (self.keys[1][slots] == keys[1]) & (self.keys[2][slots] == keys[2]) & (sizes <= UNIT)
        places, counts = self.places[slots].astype(np.int64), self.counts[slots].astype(np.int64)
        pool = self.pool
        missing = np.flatnonzero(~hit)
        if len(missing):
            blanks = np.concatenate([[0], np.cumsum(blank)])
            spaces = np.concatenate([[0], np.cumsum(~(plain | (data[:n] >= 0x80)))])  # white space and other controls
            first, last, inside = data[starts], before[ends - 1], spaces[ends] - spaces[starts]
            joint = np.where(blank[starts] & (blanks[ends] - blanks[starts] == 1) & last & (sizes > 1), 1, 0)
            joint[_AFTER[first] & last & (inside == 0)] = 2
            names: dict[bytes, int] = {}
            inverse = np.fromiter((names.setdefault(joined[a:b], len(names)) for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)), np.int64, len(missing))
            at = np.zeros(len(names), np.int64)
            at[inverse[::-1]] = missing[::-1]
            fresh, begin, many = self._encode(list(names), joint[at])
            if self.used + len(fresh) > POOL:
                self.lengths[:] = self.used = 0
                self.pool = np.zeros(1 << 16, self.kind)
                places[hit] += len(fresh)  # the old pool is used once more, behind the new ids
                pool = np.concatenate([fresh, pool])
                places[missing] = begin[inverse]
            else:
                if self.used + len(fresh) > len(self.pool):
                    self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(fresh)), self.kind)])
                self.pool[self.used : self.used + len(fresh)] = fresh
                begin = begin + self.used
                self.used += len(fresh)
                pool = self.pool
                places[missing] = begin[inverse]
                kept = (sizes[at] <= UNIT) & (many < 256)
                where = slots[at[kept]]
                for k in range(3):
                    self.keys[k][where] = keys[k][at[kept]]
                self.lengths[where], self.places[where], self.counts[where] = sizes[at[kept]], begin[kept], many[kept]
            counts[missing] = many[inverse]
        ends_of = np.cumsum(counts)
        out = pool[np.repeat(places - (ends_of - counts), counts) + np.arange(int(ends_of[-1]))]
        cuts = np.concatenate([[0], ends_of])[np.searchsorted(starts, firsts[1:])]
        return np.split(out, cuts)


def parts_alike(settings: dict) -> bool:
    """Whether a tokenizer parts texts as ``UnitEncoder`` takes for granted: bytes as they stand, split by the byte-level rule, merged within a split.

    Added tokens may take in no white space around them, and hold no place where a unit begins.
    """
    split, model = settings.get("pre_tokenizer") or {}, settings.get("model") or {}
    bytewise = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    merged = model.get("type") == "BPE" and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
    added = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) and not re.search(r"\s|[A-Za-z][.,;:!?]", t["content"]) for t in settings.get("added_tokens") or [])
    return settings.get("normalizer") is None and bytewise and merged and added


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The encoder of a tokenizer file, kept over the tasks of a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def text_parts(text: bytes) -> Iterator[bytes]:
    """A text; a long one is cut where a unit begins."""
    at = 0
    while len(text) - at > TEXT_PIECE:
        cut = _CUT.search(text, at + TEXT_PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_texts(texts: list[str | None], path: str, end_id: int = END_ID) -> list[bytes]:
    """The ids of each text and the end id, little-endian, 16 bits each (32 for vocabularies over 65,536)."""
    coder = encoder(path)
    out: list[list[bytes]] = [[] for _ in texts]
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            for (row, _), ids in zip(held, coder.ids([part for _, part in held]), strict=True):
                out[row].append(ids.tobytes())
        held, size = [], 0

    for row, text in enumerate(texts):
        for part in (text_parts(text.encode()) if coder.in_units else [text.encode()]) if text else ():
            held.append((row, part))
            size += len(part)
            if size >= TEXT_PIECE:
                flush()
    flush()
    end = np.array([end_id], coder.kind).tobytes()
    return [b"".join([*parts, end]) for parts in out]


def _add_counts(total: np.ndarray, ids: np.ndarray) -> np.ndarray:
    found = np.bincount(ids)
    if len(found) > len(total):
        total = np.pad(total, (0, len(found) - len(total)))
    total[: len(found)] += found
    return total


def tokenise(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, text_hash, ids (binary) and width (bytes of an id); a task's last row holds nothing but ``counts``, how often it has met each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(path).kind.itemsize
        total = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = encode_texts(part.column("text").to_pylist(), path, end_id)
                total = _add_counts(total, _ids(b"".join(ids), width))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(ids, pa.binary()), pa.array([width] * len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], names)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.array([total.tobytes()], pa.binary())], names)

    names = ["doc_id", "text_hash", "ids", "width", "counts"]
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, ids binary, width int, counts binary")


def _ids(binary, width: int) -> np.ndarray:
    return np.frombuffer(binary, "<u2" if width == 2 else "<u4")


def frequency_order(coded: DataFrame) -> np.ndarray:
    """Ids by falling count over all rows, then by id; at most as many as the vocabulary has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for binary in batch.column("counts"):
                total = np.frombuffer(binary.as_buffer(), np.int64)
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = coded.filter("counts is not null").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.toPandas()
    return rows["id"].to_numpy(np.int64)[np.lexsort((rows["id"], -rows["n"]))]


# The coding

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_STARTS = np.cumsum(_LENGTHS, axis=1) - _LENGTHS
_TOTALS = _LENGTHS.sum(1)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack_rows(ranks: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of runs of ``sizes`` unsigned 32-bit numbers; a run's last control byte is filled up with zeros."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    lengths = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    groups = -(-sizes // 4)
    group_ends, ends = np.cumsum(groups), np.cumsum(sizes)
    codes = np.zeros(4 * int(group_ends[-1]) if len(groups) else 0, np.uint8)
    codes[np.arange(len(ranks)) + np.repeat(4 * (group_ends - groups) - (ends - sizes), sizes)] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).tobytes()
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]].tobytes()
    data_ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[np.concatenate([[0], ends])].tolist()
    cuts = [0, *group_ends.tolist()]
    return [control[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], [data[a:b] for a, b in zip(data_ends, data_ends[1:], strict=False)]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    (control,), (data,) = pack_rows(ranks, np.array([len(ranks)]))
    return control, data


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """``n`` numbers that begin at the front of ``control`` and ``data``, and the data bytes they take."""
    control = control[: -(-n // 4)]
    ends = np.cumsum(_TOTALS[control])
    places = ((ends - _TOTALS[control])[:, None] + _STARTS[control]).reshape(-1)[:n]
    lengths = _LENGTHS[control].reshape(-1)[:n]
    taken = int(places[-1] + lengths[-1]) if n else 0
    padded = np.concatenate([data[:taken], np.zeros(4, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 4)[places]
    return np.ascontiguousarray(words).view("<u4")[:, 0] & _MASKS[lengths], taken


_BLOCK = pa.schema([("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("first", pa.int64()), ("tokens", pa.int64()), ("control", pa.binary()), ("data", pa.binary())])
_BLOCK_DDL = "doc_ids array<long>, n_tokens array<long>, first long, tokens long, control binary, data binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write blocks and dictionary of ``docs`` (doc_id, text) under ``path``.

    Documents stand in ascending order of doc_id (null first), repeated ids in order of a hash of the text;
    each ends with ``end_id``. Null and empty texts are the end id alone; an empty table writes no block.
    """
    spark = docs.sparkSession
    coded = staged(tokenise(docs, tokenizer or default_tokenizer(), end_id), "token-ids", "zstd")
    by_rank = frequency_order(coded)
    to_rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    to_rank[by_rank] = np.arange(len(by_rank))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                width = part.column("width")[0].as_py()
                arrays = [_ids(b.as_buffer(), width) for b in part.column("ids")]
                sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
                packed = pack_rows(to_rank[np.concatenate(arrays)], sizes)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(sizes), *(pa.array(x, pa.binary()) for x in packed)],
                    ["doc_id", "text_hash", "n", "control", "data"],
                )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, controls, datas = [], [], [], []
        first = tokens = 0

        def flush() -> pa.RecordBatch:
            values = [ids, counts, first, tokens, b"".join(controls), b"".join(datas)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK, strict=True)], schema=_BLOCK)

        for batch in batches:
            for doc_id, n, control, data in zip(*(batch.column(c) for c in ("doc_id", "n", "control", "data")), strict=True):
                ids.append(doc_id.as_py())
                counts.append(n.as_py())
                controls.append(control.as_py())
                datas.append(data.as_py())
                tokens += counts[-1]
                if tokens >= BLOCK_TOKENS:
                    yield flush()
                    ids, counts, controls, datas = [], [], [], []
                    first, tokens = first + tokens, 0
        if ids:
            yield flush()
        ids, counts, controls, datas = [], [], [], []
        give_back()

    rows = coded.filter("counts is null").mapInArrow(code, "doc_id long, text_hash long, n long, control binary, data binary")
    ordered = rows.repartitionByRange(partitions(spark), "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    ordered.mapInArrow(blocks, _BLOCK_DDL).withColumn("part", F.spark_partition_id()).write.parquet(f"{path}/blocks", compression="none")
    spark.createDataFrame([(r, int(i)) for r, i in enumerate(by_rank)], "rank int, id long").coalesce(1).write.parquet(f"{path}/dictionary")


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if wanted, ids of every document."""
    by_rank = spark.read.schema("rank int, id long").parquet(f"{path}/dictionary").orderBy("rank").toPandas()["id"].to_numpy().astype("<u4")
    read = spark.read.schema(f"{_BLOCK_DDL}, part int").parquet(f"{path}/blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = read.groupBy("part").agg(F.sum("tokens").alias("part_tokens"))
    bases = staged(totals.select(F.col("part").alias("base_part"), F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("base")), "token-bases")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, counts, start, control, data = (batch.column(c)[row] for c in ("doc_ids", "n_tokens", "start", "control", "data"))
                control, data = (np.frombuffer(x.as_buffer(), np.uint8) for x in (control, data))
                counts, starts, crcs, all_ids = counts.as_py(), [], [], []
                at_control = at_data = 0
                start = start.as_py()
                for n in counts:
                    ranks, taken = unpack(control[at_control:], data[at_data : at_data + 4 * n], n)
                    ids = by_rank[ranks]
                    starts.append(start)
                    crcs.append(zlib.crc32(ids.tobytes()))
                    if keep_ids:
                        all_ids.append(ids.astype(np.int64))
                    start, at_control, at_data = start + n, at_control - (-n // 4), at_data + taken
                columns = [pa.array(x, pa.int64()) for x in (doc_ids.as_py(), starts, counts, crcs)] + ([pa.array(all_ids, pa.list_(pa.int64()))] if keep_ids else [])
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + keep_ids]
    placed = read.join(bases, F.col("part") == F.col("base_part")).select("doc_ids", "n_tokens", (F.col("base") + F.col("first")).alias("start"), "control", "data")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids)


def token_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path, keep_ids=False)

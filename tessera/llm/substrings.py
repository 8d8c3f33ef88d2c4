"""Repeated passages across documents: seed and extend on winnowed anchors.

Seeds: of the ``GRAM``-word grams inside a window of ``window`` words the one with the least hash (the last of
equals) is the window's anchor, so that equal windows have equal anchors wherever they stand. The windows that
follow each other and share an anchor are its run; a run is all that a document says within reach of the seed.

Documents are joined on anchors, and the seeds are extended both ways against all partners at once, by
equality of what stands round them. A document whose run stands in a smaller document too has the whole run
repeated; that settles all but the borders of passages. Where one anchor stands in different runs, the least
document of each run hands in the run's windows, each an extension of the seed to the full length, and these
are joined in the same way. No pair of documents is ever formed: a passage of n documents costs n rows.
Overlapping repeated windows are merged to maximal spans.

Rows meet sorted by anchor, content and document and are judged as a stream, so that a task's memory does not
depend on how often a passage is repeated. Of rows with the same content in one batch only the least document
travels to the meeting place; the others are settled at once and spread evenly.

Contents are told apart by two 64-bit hashes, of anchor and of run or window.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, partitions, staged
from tessera.llm.simhash import pieces_of_words

WINDOW, GRAM, SEED = 13, 6, 42
#: Windows that are worked on at once; longer documents are cut into segments of so many, which overlap in words.
SEGMENT = 1 << 19
#: Different words whose hashes a task remembers.
REMEMBERED = 1 << 18
#: Multipliers of the rolling hash and of the mixing function.
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


def word_hashes(text: str | None, known: _WordHashes) -> np.ndarray:
    parts = [np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) for words in pieces_of_words((text or "").encode())]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[base][:n]


class Runs:
    """The runs of some word sequences, laid end to end: ``piece``, ``anchor``, ``run`` (hash), ``start`` (of the first window, in all words) and ``windows``."""

    def __init__(self, sequences: list[np.ndarray], window: int):
        self.size = window
        words = np.concatenate(sequences)
        lengths = np.array([len(s) for s in sequences])
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * _powers(BASE, len(words)), out=sums[1:])
        back = _powers(pow(BASE, -1, 1 << 64), len(words) + 1)
        self._content = lambda at, n: (sums[at + n] - sums[at]) * back[at]
        gram = min(GRAM, window)
        n, reach = max(0, len(words) - window + 1), window - gram + 1
        grams = mixed((sums[gram:] - sums[:-gram]) * back[: len(sums) - gram]) if len(sums) > gram else np.zeros(0, np.uint64)
        best, last = grams[:n].copy(), np.zeros(n, np.int64)
        for step in range(1, reach):
            new = grams[step : step + n]
            last[new <= best] = step
            np.minimum(best, new, out=best)
        whole = np.maximum(0, lengths - window + 1)
        self.starts = np.cumsum(lengths) - lengths
        first = np.cumsum(whole) - whole
        at = np.repeat(self.starts - first, whole) + np.arange(whole.sum())  # windows inside one sequence
        chosen = at + last[at]
        begins = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1])) if len(at) else np.zeros(0, np.int64)
        self.windows = np.diff(np.append(begins, len(at)))
        self.start = at[begins]
        self.piece = np.repeat(np.arange(len(sequences)), whole)[begins]
        self.anchor = best[self.start]
        shape = (chosen[begins] - self.start + self.windows * window).astype(np.uint64)
        self.run = mixed(self._content(self.start, self.windows + window - 1) + mixed(shape + np.uint64(1)))

    def window_starts(self, chosen: np.ndarray) -> np.ndarray:
        """Starts of all windows of the runs ``chosen`` (indices)."""
        n = self.windows[chosen]
        return np.repeat(self.start[chosen] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def window_hashes(self, starts: np.ndarray) -> np.ndarray:
        return mixed(self._content(starts, self.size))


def segments(texts: pa.Array, window: int, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, Runs]]:
    """(row, offset, runs) of groups of texts; row and offset, in words, tell where each piece of the runs comes from."""
    known = _WordHashes()
    rows: list[int] = []
    offsets: list[int] = []
    held: list[np.ndarray] = []
    size = 0
    for row in range(len(texts)) if wanted is None else wanted:
        words = word_hashes(texts[row].as_py(), known)
        for at in range(0, max(0, len(words) - window + 1), SEGMENT):
            piece = words[at : at + SEGMENT + window - 1]
            if held and size + len(piece) > SEGMENT + window:
                yield np.array(rows), np.array(offsets), Runs(held, window)
                rows, offsets, held, size = [], [], [], 0
            rows.append(row)
            offsets.append(at)
            held.append(piece)
            size += len(piece)
    if held:
        yield np.array(rows), np.array(offsets), Runs(held, window)


def _ranks(ids: pa.Array) -> np.ndarray:
    """Order of ids, equal for equal ones, nulls last."""
    values, nulls = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    order = np.lexsort((values, nulls))
    step = (values[order][1:] != values[order][:-1]) | (nulls[order][1:] != nulls[order][:-1])
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.append(0, np.cumsum(step)) if len(values) else 0
    return ranks


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


SEEDS = "slot long, anchor long, content long, doc_id long, twin int, settled boolean"


def _seed_rows(batch: pa.RecordBatch, row: np.ndarray, anchor: np.ndarray, content: np.ndarray, ranks: np.ndarray, by_content: bool) -> pa.RecordBatch:
    """Rows of ``SEEDS``. Of equal contents only those of the least document go to the slot of their anchor, or of anchor and content; the others are settled."""
    twin = batch.column("twin").to_numpy()[row]
    order = np.lexsort((twin, ranks[row], content, anchor))
    row, anchor, content, twin = row[order], anchor[order], content[order], twin[order]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]))
    least = ranks[row][np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))]
    again = ~new & np.append(False, (ranks[row][1:] == ranks[row][:-1]) & (twin[1:] == twin[:-1]))  # the same content in the same text
    settled = ranks[row] > least
    slot = np.where(settled, mixed(content + ranks[row].astype(np.uint64)), mixed(anchor ^ content) if by_content else anchor)
    keep = np.flatnonzero(~again)
    return pa.RecordBatch.from_arrays(
        [_signed(slot[keep]), _signed(anchor[keep]), _signed(content[keep]), batch.column("doc_id").take(pa.array(row[keep])), pa.array(twin[keep], pa.int32()), pa.array(settled[keep])],
        [x.split()[0] for x in SEEDS.split(", ")],
    )


def _judged(seeds: DataFrame, name_unsure: bool) -> DataFrame:
    """doc_id, twin, content and ``unsure``: contents that stand in a smaller document, and, if asked for, those of least documents whose anchor stands in other contents too (unsure)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: list[pa.Array] | None = None  # row of the least document of the content that the stream is in
        told = False  # whether that row went out as unsure
        for whole in batches:
            settled = whole.column("settled")
            done = whole.filter(settled)
            if done.num_rows:
                yield answer(done, np.arange(done.num_rows), False)
            batch = whole.filter(pc.invert(settled))
            if not batch.num_rows:
                continue
            if least is not None:
                batch = pa.Table.from_batches([least, batch]).combine_chunks().to_batches()[0]
            anchor, content = (batch.column(c).to_numpy() for c in ("anchor", "content"))
            ids, nulls = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            repeated = np.flatnonzero((ids != ids[first]) | (nulls != nulls[first]))
            if len(repeated):
                yield answer(batch, repeated, False)
            heads = np.flatnonzero(new)
            if name_unsure:
                same = anchor[heads][1:] == anchor[heads][:-1]
                unsure = np.append(False, same) | np.append(same, False)
                last = bool(unsure[-1]) or (len(heads) == 1 and told)
                if told and least is not None:
                    unsure[0] = False
                # twins of the least document, whose texts differ, hold the same content
                mine = np.flatnonzero(np.repeat(unsure, np.diff(np.append(heads, len(new)))) & (ids == ids[first]) & (nulls == nulls[first]))
                if len(mine):
                    yield answer(batch, mine, True)
                told = last
            least = batch.slice(int(heads[-1]), 1)
        give_back()

    def answer(batch: pa.RecordBatch, rows: np.ndarray, unsure: bool) -> pa.RecordBatch:
        taken = [batch.column(c).take(pa.array(rows)) for c in ("doc_id", "twin", "content")]
        return pa.RecordBatch.from_arrays([*taken, pa.array(np.full(len(rows), unsure))], ["doc_id", "twin", "content", "unsure"])

    sorted_rows = seeds.repartition(partitions(seeds.sparkSession), "slot").drop("slot").sortWithinPartitions("anchor", "content", F.asc_nulls_last("doc_id"), "twin")
    return sorted_rows.mapInArrow(run, "doc_id long, twin int, content long, unsure boolean")


def _in_lists(rows: np.ndarray, values: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether ``values[i]`` is in the list of row ``rows[i]``."""
    lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    lengths = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, lengths)
    there = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return np.isin(values + mixed(rows.astype(np.uint64) + np.uint64(7)), there + mixed(np.repeat(np.arange(len(lists)), lengths).astype(np.uint64) + np.uint64(7)))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row`` (a struct of the other columns of ``docs``), text (the words that stay, joined by one space), n_words, n_removed and ``spans`` (first word and number of words of each maximal repeated span).

    Words are runs of characters other than ASCII white space, unchanged; a null text has none. A window is
    ``window`` consecutive words of one document; every word of a window that also stands in a document with
    a smaller doc_id goes, judged on the texts as they are given. Null ids come after all others and are not
    smaller than each other; rows that share an id are not smaller than each other. Texts of fewer words
    than a window stay whole; an empty table gives an empty one. Extra columns may have any name.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("twin"), "text", F.struct(*rest).alias("row"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = _ranks(batch.column("doc_id"))
            for row, _, runs in segments(batch.column("text"), window):
                yield _seed_rows(batch, row[runs.piece], runs.anchor, runs.run, ranks, False)
        give_back()

    found = _judged(texts.select("doc_id", "twin", "text").mapInArrow(anchors, SEEDS), True)
    lists = found.groupBy("doc_id", "twin").agg(F.collect_set(F.when(~F.col("unsure"), F.col("content"))).alias("runs"), F.collect_set(F.when(F.col("unsure"), F.col("content"))).alias("unsure"))
    lists = staged(lists, "repeated-runs")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = _ranks(batch.column("doc_id"))
            for row, _, runs in segments(batch.column("text"), window):
                chosen = np.flatnonzero(_in_lists(row[runs.piece], runs.run, batch.column("unsure")))
                if len(chosen):
                    owner = np.repeat(chosen, runs.windows[chosen])
                    yield _seed_rows(batch, row[runs.piece[owner]], runs.anchor[owner], runs.window_hashes(runs.window_starts(chosen)), ranks, True)
        give_back()

    unsure = _on_text(texts, lists.filter("size(unsure) > 0").select("doc_id", "twin", "unsure"), "inner")
    extended = _judged(unsure.mapInArrow(windows, SEEDS), False).groupBy("doc_id", "twin").agg(F.collect_set("content").alias("windows"))
    joined = _on_text(_on_text(texts, lists.select("doc_id", "twin", "runs"), "left"), extended, "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, gone, more = (batch.column(c) for c in ("text", "runs", "windows"))
            any_gone = np.flatnonzero(np.maximum(*(pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False) for x in (gone, more))) > 0)
            starts: dict[int, list[np.ndarray]] = {}
            for row, offset, runs in segments(text, window, any_gone):
                owner = row[runs.piece]
                whole = _in_lists(owner, runs.run, gone)
                open_ = np.flatnonzero(~whole & np.isin(owner, np.flatnonzero(pc.list_value_length(more).fill_null(0).to_numpy(zero_copy_only=False))))
                at = runs.window_starts(open_)
                of = np.repeat(runs.piece[open_], runs.windows[open_])
                hit = _in_lists(row[of], runs.window_hashes(at), more)
                whole = np.flatnonzero(whole)
                at, of = np.append(runs.window_starts(whole), at[hit]), np.append(np.repeat(runs.piece[whole], runs.windows[whole]), of[hit])
                for piece in np.unique(of):
                    starts.setdefault(int(row[piece]), []).append(at[of == piece] - runs.starts[piece] + offset[piece])
            cuts = [_cut(t.as_py(), starts.get(i), window) for i, t in enumerate(text)]
            spans = pa.array([c[2] for c in cuts], pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([c[0] for c in cuts], pa.string()), pa.array([c[1] for c in cuts], pa.int64()), pa.array([sum(s["words"] for s in c[2]) for c in cuts], pa.int64()), spans],
                ["row", "text", "n_words", "n_removed", "spans"],
            )
        give_back()

    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(cut, f"row {kind}, text string, n_words long, n_removed long, spans array<struct<first: long, words: long>>")


def _on_text(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``texts`` with the list of their id and twin number."""
    lists = lists.withColumnsRenamed({"doc_id": "list_id", "twin": "list_twin"})
    return texts.join(lists, F.col("doc_id").eqNullSafe(F.col("list_id")) & (F.col("twin") == F.col("list_twin")), how).drop("list_id", "list_twin")


def _cut(text: str | None, starts: list[np.ndarray] | None, window: int) -> tuple[str, int, list[dict[str, int]]]:
    """The text without the windows that begin at ``starts``, its number of words, and the spans removed."""
    data = (text or "").encode()
    if not starts:
        kept, n = [], 0
        for words in pieces_of_words(data):
            kept.append(b" ".join(words))
            n += len(words)
        return b" ".join(k for k in kept if k).decode(), n, []
    at = np.unique(np.concatenate(starts))
    gap = np.append(True, at[1:] > at[:-1] + window)
    first, last = at[gap], np.append(at[:-1][gap[1:]], at[-1]) + window
    kept, n = [], 0
    for words in pieces_of_words(data):
        stays = np.ones(len(words), bool)
        for a, b in zip(first[(last > n) & (first < n + len(words))], last[(last > n) & (first < n + len(words))], strict=True):
            stays[max(0, a - n) : b - n] = False
        kept.append(b" ".join(compress(words, stays.tolist())))
        n += len(words)
    return b" ".join(k for k in kept if k).decode(), n, [{"first": int(a), "words": int(b - a)} for a, b in zip(first, last, strict=True)]


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of ``docs``, texts without what earlier documents say too; texts that lose nothing are as they were but for white space."""
    cleaned = without_repeats(docs, window)
    return cleaned.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def repeats_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, of the words that stay, for every row."""
    rows = without_repeats(docs.select("doc_id", "text"))
    return rows.select("row.doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: The definition, window by window.
ORACLE = r"""
WITH worded AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
windows AS (SELECT r, doc_id, i, array_to_string(words[i : i + 12], ' ') AS said FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM worded)),
firsts AS (SELECT said, min(doc_id) AS least FROM windows GROUP BY said),
gone AS (SELECT DISTINCT r, i + j AS place FROM (SELECT r, i, unnest(range(13)) AS j FROM windows JOIN firsts USING (said) WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL))),
placed AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM worded),
stays AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS said FROM placed ANTI JOIN gone USING (r, place) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(said, '')) AS kept_sha256 FROM worded LEFT JOIN stays USING (r)
"""

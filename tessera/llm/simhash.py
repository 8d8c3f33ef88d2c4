"""SimHash near duplicates with bit-sliced comparison.

Fingerprints are made once for each text, beside the data, and everything after works on distinct
fingerprints. Candidates come from pigeonhole tables: the 64 bits are cut into ``blocks``; fingerprints that
differ in at most ``radius`` bits agree in at least ``blocks - radius`` blocks, so each choice of that many
blocks is a table, and the agreeing bits are its key. Inside a bucket nothing is compared pair by pair: the
fingerprints stand as 64 vertical bit planes, 64 fingerprints a word; differing planes are added into
carry-save counters, and a word is abandoned once all its 64 distances exceed the radius.

A bucket yields a spanning forest of its links, not its pairs, so that a group of copies costs as many rows
as it has members. Components are found by alternating large and small stars, each round staged.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, packed, partitions, sized, staged

SEED = 42
#: Texts are cut into words in pieces of so many bytes.
PIECE = 4 << 20
#: Rows gathered before complete buckets are compared, and the bucket size from which a bucket is compared by tiles.
GATHER, TILED = 1 << 18, 48
#: Words of planes that are compared at once in a large bucket.
TILE_WORDS = 1 << 14
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# Fingerprints


def pieces_of_words(data: bytes) -> Iterator[list[bytes]]:
    """Words (runs of bytes other than ASCII white space), in lists that come from ``PIECE`` bytes each."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        yield data[at:end].split()
        at = end


def shingles(data: bytes, k: int) -> Iterator[list[bytes]]:
    """Shingles of ``k`` words, repeats included, space-joined, in lists; with fewer words the whole sequence; without words nothing."""
    kept: list[bytes] = []
    made = False
    for words in pieces_of_words(data):
        words = kept + words
        if len(words) >= k:
            joined = b" ".join(words)
            ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
            yield [joined[e - len(w) : x] for e, w, x in zip(ends, words, ends[k - 1 :], strict=False)]
            made = True
        kept = words[-(k - 1) :] if k > 1 and made else [] if made else words
    if not made and kept:
        yield [b" ".join(kept)]


def _lower(text: str | None) -> bytes:
    return (text or "").encode().lower()  # bytes.lower() changes A-Z only


def _majority(digests: Iterator[np.ndarray], width: int) -> bytes:
    """The bits that are set in over half of the digests (rows of ``width`` bytes)."""
    count, total = np.zeros(8 * width, np.int64), 0
    for rows in digests:
        for at in range(0, len(rows), 1 << 16):
            count += np.unpackbits(rows[at : at + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(rows)
    return np.packbits(2 * count > total, bitorder="little").tobytes() if total else bytes(width)


def fingerprint(text: str | None, k: int = 3) -> int:
    """64-bit SimHash as a signed number; 0 for null and for texts without words."""
    hashed = (np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in group), np.uint64, len(group)).view(np.uint8).reshape(-1, 8) for group in shingles(_lower(text), k))
    return int.from_bytes(_majority(hashed, 8), "little", signed=True)


def _distinct_shingles(data: bytes, k: int) -> np.ndarray:
    """128-bit hashes (two columns) of the distinct shingles, sorted by the first column, by which shingles are told apart."""
    parts = [np.frombuffer(b"".join(xxhash.xxh3_128_digest(s, SEED) for s in group), np.uint64).reshape(-1, 2) for group in shingles(data, k)]
    rows = np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)
    return rows[np.unique(rows[:, 0], return_index=True)[1]]


def _set_name(ids: np.ndarray) -> int:
    """Signed hash of a set of shingles, given as sorted ids."""
    return int.from_bytes(xxhash.xxh3_64_digest(ids.tobytes(), SEED), "little", signed=True)


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id and fp of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), k) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


# Bit-sliced comparison


def _bits(fps: np.ndarray) -> np.ndarray:
    """The bits of fingerprints (64-bit numbers, or rows of them), one row for each bit."""
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little").T


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """A plane of packed words for each bit; bit i of plane b is bit b of fingerprint i, padded with zeros."""
    n, of = len(fps), _bits(fps)
    bits = np.zeros((len(of), -(-n // 64) * 64), np.uint8)
    bits[:, :n] = of
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _packed(mask: np.ndarray) -> np.ndarray:
    return np.packbits(mask, axis=-1, bitorder="little").view(np.uint64)


def within(left: np.ndarray, li: np.ndarray, right: np.ndarray, ri: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Compare words ``left[:, li]`` with ``right[:, ri]`` lane by lane.

    Returns the positions in ``li`` of the words that have a lane within the radius, and those lanes as bits.
    ``valid`` holds the lanes that count. Distances are kept as carry-save counters: one word for each binary
    digit and one, ``over``, for those that have passed the last digit.
    """
    digits = max(1, radius.bit_length())
    alive = np.flatnonzero(valid)
    counter = [np.zeros(len(alive), np.uint64) for _ in range(digits)]
    over = ~valid[alive]
    for b in range(0, len(left), 2):
        x = left[b][li[alive]] ^ right[b][ri[alive]]
        y = left[b + 1][li[alive]] ^ right[b + 1][ri[alive]]
        low = counter[0]
        either = x ^ y
        carry = (x & y) | (low & either)
        counter[0] = low ^ either
        for d in range(1, digits):
            counter[d], carry = counter[d] ^ carry, counter[d] & carry
        over |= carry
        if b % 8 == 6:
            beyond = over | _above(counter, radius)
            keep = np.flatnonzero(beyond != ALL)
            if len(keep) < len(alive):
                alive, over, counter = alive[keep], over[keep], [c[keep] for c in counter]
            if not len(alive):
                break
    lanes = ~(over | _above(counter, radius))
    return alive, lanes


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is larger than the radius."""
    more, same = np.zeros_like(counter[0]), np.full_like(counter[0], ALL)
    for d in range(len(counter) - 1, -1, -1):
        if radius >> d & 1:
            same &= counter[d]
        else:
            more |= same & counter[d]
            same &= ~counter[d]
    return more


def _lanes(words: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the word, lane) of each set bit."""
    at, lane = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return words[at], lane


def bucket_links(fps: np.ndarray, starts: np.ndarray, radius: int, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within the radius, and not of one ``group``, inside the buckets that begin at ``starts`` (rows sorted by bucket)."""
    sizes = np.diff(np.append(starts, len(fps)))
    for at, m in zip(starts[sizes > TILED], sizes[sizes > TILED], strict=True):
        yield from _tiled(fps[at : at + m], int(at), radius, None if group is None else group[at : at + m])
    small = (sizes > 1) & (sizes <= TILED)
    order = np.argsort(-sizes[small], kind="stable")
    starts, sizes = starts[small][order], sizes[small][order]
    for k in range(1, TILED):  # row i of a bucket with row i + k
        n = np.searchsorted(-sizes, -k, side="left")  # buckets larger than k stand in front
        if not n:
            break
        if k == 1 or n < 0.7 * held:
            held = n
            rows = np.repeat(starts[:n] - np.cumsum(sizes[:n]) + sizes[:n], sizes[:n]) + np.arange(sizes[:n].sum())
            ends = np.repeat(starts[:n] + sizes[:n], sizes[:n])
            planes = bit_planes(fps[rows])
        valid = np.zeros(planes.shape[1] * 64, np.uint8)
        valid[: len(rows)] = rows + k < ends
        if group is not None:
            valid[: len(rows)] &= group[rows] != group[np.minimum(rows + k, len(fps) - 1)]
        words = np.arange(planes.shape[1])
        found, lanes = within(planes, words, _shifted(planes, k), words, _packed(valid), radius)
        word, lane = _lanes(found, lanes)
        if len(word):
            i = rows[word * 64 + lane]
            yield i, i + k


def _shifted(planes: np.ndarray, k: int) -> np.ndarray:
    """Planes whose lane i is lane i + k of the given ones (k < 64)."""
    out = planes >> np.uint64(k)
    out[:, :-1] |= planes[:, 1:] << np.uint64(64 - k)
    return out


def _tiled(fps: np.ndarray, base: int, radius: int, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A large bucket: tiles of queries against words of the planes."""
    n = len(fps)
    planes = bit_planes(fps)
    words = planes.shape[1]
    step = max(1, TILE_WORDS // words)
    lane_index = np.arange(words * 64).reshape(words, 64)
    padded = None if group is None else np.pad(group, (0, words * 64 - n)).reshape(words, 64)
    for q in range(0, n, step):
        queries = np.arange(q, min(n, q + step))
        spread = np.where(_bits(fps[queries]), ALL, np.uint64(0))
        first = q // 64
        wi = np.tile(np.arange(first, words), len(queries))
        qi = np.repeat(np.arange(len(queries)), words - first)
        valid = (lane_index[first:][None] > queries[:, None, None]) & (lane_index[first:][None] < n)
        if padded is not None:
            valid &= padded[first:][None] != group[queries][:, None, None]
        found, lanes = within(planes, wi, spread, qi, _packed(valid.astype(np.uint8)).reshape(-1), radius)
        at, lane = _lanes(np.arange(len(found)), lanes)
        if len(at):
            yield base + queries[qi[found[at]]], base + wi[found[at]] * 64 + lane


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indices of edges that span the same components; light edges first (Boruvka rounds)."""
    names, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(names))
    chosen: list[np.ndarray] = []
    order = np.lexsort((np.arange(len(a)), weight))
    u, v = u[order], v[order]
    live = np.arange(len(u))
    while len(live):
        lu, lv = label[u[live]], label[v[live]]
        live = live[lu != lv]
        if not len(live):
            break
        lu, lv = label[u[live]], label[v[live]]
        pick = np.unique(np.concatenate([np.unique(x, return_index=True)[1] for x in (lu, lv)]))  # live is in order of weight
        best: dict[int, int] = {}
        for p in pick:
            for c in (int(lu[p]), int(lv[p])):
                best[c] = min(best.get(c, 1 << 60), int(p))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        took = []
        for p in sorted(set(best.values())):
            x, y = root(int(lu[p])), root(int(lv[p]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                took.append(p)
        chosen.append(live[took])
        old, inverse = np.unique(label, return_inverse=True)
        label = np.array([root(int(x)) for x in old])[inverse]
    return order[np.concatenate(chosen)] if chosen else np.zeros(0, np.int64)


# Links and components in Spark


def table_masks(blocks: int, equal: int) -> list[int]:
    """Masks (signed) of all choices of ``equal`` among ``blocks`` near-equal runs of the 64 bits."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(runs, equal))]


def links(nodes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(a, b) that span the links among ``nodes`` (node, fp): two nodes are linked if their fps differ in at most ``radius`` bits. All links connect the same nodes as those returned."""
    masks = table_masks(blocks, blocks - radius)
    spread = F.explode(F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(masks)]))
    keyed = nodes.select("node", "fp", spread.alias("k")).select("node", "fp", "k.table", "k.key")

    def compare(node: np.ndarray, fp: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        held: list[np.ndarray] = []
        for i, j in bucket_links(fp, starts, radius):
            held.append(np.stack([node[i], node[j], np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64)]))
            if sum(x.shape[1] for x in held) > 1 << 20:
                held = [_lightest(np.concatenate(held, axis=1))]
        out = _lightest(np.concatenate(held, axis=1)) if held else np.zeros((3, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(out[0], out[1])), pa.array(np.maximum(out[0], out[1]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (node, fp, table, key), starts in _whole_buckets(batches, ("node", "fp", "table", "key"), 2):
            yield compare(node, fp.view(np.uint64), starts)

    sorted_rows = keyed.repartition(partitions(nodes.sparkSession), "table", "key").sortWithinPartitions("table", "key", "node")  # by node too, so that reruns choose the same forest
    return sorted_rows.mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def _lightest(edges: np.ndarray) -> np.ndarray:
    """Of edges (rows: two nodes and a weight) a lightest forest."""
    return edges[:, forest(*edges)]


def _whole_buckets(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], n_keys: int, gather: int = GATHER) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of some ``gather`` sorted rows at a time, always whole buckets (equal in the last ``n_keys`` columns), and where buckets begin."""
    held: list[list[np.ndarray]] = []
    size = 0

    def cut(last: bool) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        nonlocal held, size
        rows = [np.concatenate(x) for x in zip(*held, strict=True)]
        change = np.zeros(len(rows[0]) - 1, bool)
        for key in rows[-n_keys:]:
            change |= key[1:] != key[:-1]
        starts = np.flatnonzero(np.append(True, change))
        upto = len(rows[0]) if last else int(starts[-1])  # the last bucket may go on
        held, size = [[x[upto:] for x in rows]], len(rows[0]) - upto
        if upto:
            yield [x[:upto] for x in rows], starts[starts < upto]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([_array(batch.column(c)) for c in columns])
        size += batch.num_rows
        if size >= gather:
            yield from cut(False)
    if size:
        yield from cut(True)
    held = []
    give_back()


def _array(column: pa.Array) -> np.ndarray:
    """Numbers, or rows of 64-bit numbers from binaries of one length."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have an edge: the smallest node of their component. Alternating stars, each round staged."""
    edges = staged(edges.select("a", "b"), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))  # here b < a
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(joined.select("a", F.col("least").alias("b")))
        edges = staged(small.filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicate_components(docs: DataFrame, k: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp (signed 64 bits) and component_id, the smallest doc_id reachable over links, for every row.

    Null texts and texts without words have fingerprint 0 and are linked like others; texts of fewer than
    ``k`` words have one shingle; repeated rows stay and share a component; null ids are never a
    component's name unless it has no other; an empty table gives an empty one.
    """
    prints = staged(fingerprints(docs, k), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius, radius + 2)).select(F.col("node").alias("fp"), "root")
    rooted = staged(nodes.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    rows = near_duplicate_components(docs)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# One document of each group

#: Bits (of 128) in which fingerprints of sets of Jaccard 0.8 differ at most: 20 are expected, a standard deviation is 4.
WIDE_RADIUS = 40
#: Least shingles by hash that the first pass meets in, how many followers a row is compared with, and least rare shingles that later passes meet in.
SKETCH, FOLLOWERS, RARE = 4, 4, 16
#: Documents from which frequent shingles are learned, and how many of those are kept. Both change the work, not the result.
COMMON_FROM, MAX_COMMON = 5_000, 1 << 17
#: Rows of a bucket from which it is split into cells, rows with bins that a task gathers, and bins of a set (a power of 2).
CELL, GATHER_WIDE, BINS = 1 << 13, 1 << 14, 1 << 10


def prefix_length(n: int, similarity: float) -> int:
    """Sets of Jaccard ``similarity`` share an element of their first so many in any order that all sets follow; ``n`` is the set's size."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _set_batches(docs: DataFrame, k: int, schema: str, columns: Callable[[list[np.ndarray]], list[pa.Array]], *kept: str) -> DataFrame:
    """``kept`` columns of ``docs`` and what ``columns`` makes of the distinct shingles of lower-cased texts."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = columns([_distinct_shingles(_lower(t.as_py()), k) for t in part.column("text")])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], names)
        give_back()

    return docs.mapInArrow(run, schema)


def _longs(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(r).view(np.int64) for r in rows], pa.list_(pa.int64()))


def common_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (sorted) of shingles that more than one of some texts hold, and in how many."""
    total = docs.count()
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, COMMON_FROM / max(1, total))))).select("text").distinct()
    sets = _set_batches(some, k, "shingles array<long>", lambda found: [_longs([f[:, 0] for f in found])])
    rows = sets.select(F.explode("shingles").alias("id")).groupBy("id").count().filter("count > 1").orderBy(F.desc("count"), "id").limit(MAX_COMMON).toArrow()
    ids, counts = rows.column("id").to_numpy().view(np.uint64), rows.column("count").to_numpy()
    order = np.argsort(ids)
    return ids[order], counts[order]


def meeting_places(ids: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Elements of a set (sorted ids) of which it shares one with every set of Jaccard ``similarity``.

    All sets follow one order, rare elements first, then by id, which is a hash. The first ``prefix_length``
    elements always do. If half of a set is rare, its rare elements alone have a similarity of 0.6 or more with
    those of the other (for 0.8), and as their order is one of hashes, the first ``RARE`` of them have nothing
    in common with a chance of 0.4 ** 16.
    """
    frequency = np.zeros(len(ids), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], ids), len(common[0]) - 1)
        frequency = np.where(common[0][at] == ids, common[1][at], 0)
    length = prefix_length(len(ids), similarity)
    if 2 * np.count_nonzero(frequency == 0) >= len(ids):
        length = min(length, RARE)
    return ids[np.lexsort((ids, frequency))[:length]]


def _prints(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    common = common_shingles(docs, k)

    def columns(found: list[np.ndarray]) -> list[pa.Array]:
        ids = [np.ascontiguousarray(f[:, 0]) for f in found]
        return [
            pa.array(map(_set_name, ids), pa.int64()), pa.array((_majority(iter([f.view(np.uint8).reshape(-1, 16)]), 16) for f in found), pa.binary()),
            pa.array(map(len, ids), pa.int64()), _longs([x[:SKETCH] for x in ids]), _longs([meeting_places(x, common, similarity) for x in ids]),
        ]

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return _set_batches(rows, k, "doc_id long, text_hash long, node long, fp binary, n long, sketch array<long>, keys array<long>", columns, "doc_id", "text_hash")


def neighbour_links(nodes: DataFrame, radius: int = WIDE_RADIUS) -> DataFrame:
    """(a, b) of ``nodes`` (node, fp, sketch), at most one for each b: the a < b with the nearest fp, within the radius, among rows that follow each other under a shingle of the sketch. Rows of one shingle need not meet in one task."""
    keyed = nodes.select("node", "fp", F.explode("sketch").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [_array(batch.column(c)) for c in ("node", "fp", "key")]
            if tail is not None:
                rows = [np.concatenate(x) for x in zip(tail, rows, strict=True)]
            node, fp, key = rows
            tail = [x[-FOLLOWERS:] for x in rows]
            planes, words = bit_planes(fp), np.arange(-(-len(node) // 64))
            for step in range(1, min(FOLLOWERS + 1, len(node))):
                valid = np.zeros(len(words) * 64, np.uint8)
                valid[: len(node) - step] = key[:-step] == key[step:]
                word, lane = _lanes(*within(planes, words, _shifted(planes, step), words, _packed(valid), radius))
                i = word * 64 + lane
                j = i + step
                distance = np.bitwise_count(fp[i] ^ fp[j]).sum(1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), distance)], ["a", "b", "distance"])

    rows = keyed.repartitionByRange(partitions(nodes.sparkSession), "key", "fp", "node").sortWithinPartitions("key", "fp", "node")
    pairs = rows.mapInArrow(run, "a long, b long, distance long").filter("a <> b")
    return pairs.groupBy("b").agg(F.min(F.struct("distance", "a")).alias("best")).select("best.a", "b")


def mixed_keys(nodes: DataFrame) -> DataFrame:
    """Keys under which ``nodes`` (node, root, keys) of several roots meet, and the parts that their rows are split into. The result is staged."""
    keyed = nodes.select("root", F.explode("keys").alias("key"))
    met = keyed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("rows")).filter("low <> high")
    return staged(met.select("key", F.ceil(F.col("rows") / CELL).cast("int").alias("parts")), "meeting-keys")


def set_bins(ids: np.ndarray) -> bytes:
    """A byte for each of ``BINS`` runs of hash values: 0 without an element of the set (sorted ids), else one that depends on the least."""
    out = np.zeros(BINS, np.uint8)
    at, first = np.unique(ids >> np.uint64(64 - (BINS.bit_length() - 1)), return_index=True)
    out[at.astype(np.int64)] = ids[first] % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def may_be_alike(one: np.ndarray, two: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the share of equal bins leaves room for ``similarity``: within four standard deviations of a sample of that many elements of the union without putting back."""
    filled = (one > 0) | (two > 0)
    bins, equal = filled.sum(1), ((one == two) & filled).sum(1)
    union = np.maximum((n + m) / (1 + similarity), 1)
    spread = np.sqrt(similarity * (1 - similarity) / np.maximum(bins, 1) * np.clip(1 - bins / union, 0.05, 1))
    return equal >= (similarity - 4 * spread) * bins - 1


def meeting_links(nodes: DataFrame, keys: DataFrame, bins: DataFrame, similarity: float, spanning: bool, radius: int = WIDE_RADIUS) -> DataFrame:
    """(a, b) of ``nodes`` (node, root, n, fp, keys) of different roots that share one of ``keys``, whose fps lie within the radius, and whose sizes and ``bins`` (node, bins) allow ``similarity``.

    ``spanning``: of those that meet in a task only a lightest forest that joins the same roots. Keys of many
    rows are split into cells of two parts each. A pair leaves under the least key that it shares only.
    """
    return _meetings(nodes, keys, bins, similarity, spanning, radius).distinct()


def _meetings(nodes: DataFrame, keys: DataFrame, bins: DataFrame, similarity: float, spanning: bool, radius: int) -> DataFrame:
    """``meeting_links`` as they leave the buckets. Rows carry the least ``RARE`` of their keys that others hold too: the least key that two such lists share is the least of all that the nodes share. Pairs of longer lists that share none there leave under every key."""
    met = nodes.select("node", F.explode("keys").alias("key")).join(keys, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("key", "parts"))).alias("met"))
    held = F.transform(F.slice("met", 1, RARE), lambda x: x["key"])
    beside = nodes.select("node", "root", "n", "fp").join(met, "node").join(bins, "node")
    keyed = beside.select("node", "root", "n", "fp", "bins", held.alias("held_keys"), F.explode("met").alias("m")).select("node", "root", "n", "fp", "bins", "held_keys", "m.key", "m.parts")
    split = keyed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = split.withColumn("cell", F.least("part", "other").cast("long") * 1_000_003 + F.greatest("part", "other"))

    def compare(node: np.ndarray, root: np.ndarray, n: np.ndarray, part: np.ndarray, cell: np.ndarray, fp: np.ndarray, filled: np.ndarray, held_keys: np.ndarray, key: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        for left, right in bucket_links(fp, starts, radius, root):
            fits = np.minimum(n[left], n[right]) >= similarity * np.maximum(n[left], n[right]) - 1e-9
            fits &= (cell[left] // 1_000_003 == cell[left] % 1_000_003) | (part[left] != part[right])
            left, right = left[fits], right[fits]
            for at in range(0, len(left), 1 << 12):
                i, j = left[at : at + (1 << 12)], right[at : at + (1 << 12)]
                fits = may_be_alike(filled[i], filled[j], n[i], n[j], similarity)
                i, j = i[fits], j[fits]
                shared = (np.intersect1d(held_keys[x], held_keys[y], assume_unique=True) for x, y in zip(i, j, strict=True))
                first = np.array([not len(s) or s[0] == key[x] for s, x in zip(shared, i, strict=True)], bool)
                i, j = i[first], j[first]
                if len(i):
                    yield np.stack([root[i], root[j], np.bitwise_count(fp[i] ^ fp[j]).sum(1).astype(np.int64), np.minimum(node[i], node[j]), np.maximum(node[i], node[j])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal held
            found = np.concatenate(held, axis=1)
            found = found[:, forest(*found[:3])] if spanning else found
            held = []
            out = np.unique(found[3:], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], ["a", "b"])

        for (node, root, n, part, fp, filled, held_keys, key, cell), starts in _whole_buckets(batches, ("node", "root", "n", "part", "fp", "bins", "held_keys", "key", "cell"), 2, GATHER_WIDE):
            for found in compare(node, root, n, part, cell, fp, filled.view(np.uint8), held_keys, key, starts):
                held.append(found)
                if sum(x.shape[1] for x in held) > 1 << 18:
                    yield flush()
        if held:
            yield flush()

    rows = split.select("node", "root", "n", "part", "fp", "bins", "held_keys", "key", "cell").repartition(partitions(nodes.sparkSession), "key", "cell").sortWithinPartitions("key", "cell", "node")
    return rows.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, shingles and bins of the ``wanted`` nodes (first). Only their texts leave the scan."""
    wanted = staged(wanted.select("first.doc_id", "first.text_hash"), "wanted-texts").select(F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    texts = texts.join(sized(wanted), (F.col("text_hash") == F.col("first_hash")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").select("text")

    def columns(made: list[np.ndarray]) -> list[pa.Array]:
        ids = [np.ascontiguousarray(f[:, 0]) for f in made]
        return [pa.array(map(_set_name, ids), pa.int64()), _longs(ids), pa.array(map(set_bins, ids), pa.binary())]

    return _set_batches(texts, k, "node long, shingles array<long>, bins binary", columns).dropDuplicates(["node"])


def _alike(found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of ``found`` whose ``sets`` (node, shingles) have a Jaccard similarity of ``similarity`` or more."""
    ends = found.select(F.col("a").alias("node"), "a", "b").union(found.select(F.col("b").alias("node"), "a", "b"))
    sides = ends.join(sets.select("node", "shingles"), "node").groupBy("a", "b").agg(F.collect_list("shingles").alias("sets"))
    common = F.size(F.array_intersect(F.col("sets")[0], F.col("sets")[1]))
    enough = common >= similarity * (F.size(F.col("sets")[0]) + F.size(F.col("sets")[1]) - common)
    return staged(sides.filter(enough).select("a", "b"), "alike")


def keep_one_of_each_group(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without near duplicates: of texts connected by a Jaccard similarity of ``similarity`` or more the row with the smallest doc_id stays.

    Texts with the same shingles are one node. Nodes meet under shared shingles, are compared by SimHash (bit
    planes, as above, of 128 bits) and, if within ``WIDE_RADIUS``, checked on the shingle sets, so that no
    false link counts. Three passes join ever more: rows that follow each other; forests of what meets; every
    pair that meets and is not joined yet. Before the last two a sketch of the sets, compared in the bucket, says
    whether they can be alike, so that of a large family of half-alike texts few pairs leave it.
    Texts without words, null texts too, are one group; rows repeated with the same id and text are one
    document, of which the row with the smallest hash of all its columns stays; null ids come last.
    """
    prints = staged(_prints(docs, k, similarity), "wide-prints")
    ranked = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    nodes = staged(prints.groupBy("node").agg(F.min(ranked).alias("first"), *[F.any_value(c).alias(c) for c in ("fp", "n", "sketch", "keys")]), "wide-nodes")
    found = staged(neighbour_links(nodes), "neighbour-pairs")
    ends = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
    alike = _alike(found, _sets(docs, nodes.join(ends, "node", "left_semi"), k), similarity)
    sets = None
    for spanning in (True, False):
        roots = components(alike)
        rooted = staged(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n", "fp", "keys"), "rooted")
        keys = mixed_keys(rooted)
        if sets is None:  # roots only grow together, so the second round's nodes are among the first's
            met = rooted.select("node", F.explode("keys").alias("key")).join(keys, "key", "left_semi").select("node").distinct()
            sets = staged(_sets(docs, nodes.join(met, "node", "left_semi"), k), "meeting-sets")
        pairs = staged(meeting_links(rooted, keys, sets.select("node", "bins"), similarity, spanning), "meeting-pairs")
        alike = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_alike(pairs, sets, similarity))
    roots = components(alike)
    rooted = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = staged(prints.select("doc_id", "text_hash", "node").join(rooted.join(least, "root").select("node", "least"), "node"), "named")
    own = (F.col("text_hash") == F.col("least.text_hash")) & F.col("doc_id").eqNullSafe(F.col("least.doc_id"))
    marks = named.groupBy("doc_id", "text_hash").agg(F.bool_or(~own).alias("goes"), F.count(F.lit(1)).alias("times")).filter("goes or times > 1")
    marks = staged(marks.select(F.col("doc_id").alias("mark_id"), F.col("text_hash").alias("mark_hash"), "goes"), "marks")
    rows = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    marked = rows.join(sized(marks), (F.col("text_hash") == F.col("mark_hash")) & F.col("doc_id").eqNullSafe(F.col("mark_id")), "left")
    alone = marked.filter("goes is null").select("row.*")
    if marks.filter("not goes").isEmpty():
        return alone
    again = marked.filter("not goes").groupBy("doc_id", "text_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return alone.unionByName(again.select("row.*"))

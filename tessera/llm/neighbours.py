"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

A rotation is learned on a bounded sample (principal axes, then iterative quantisation), so that the signs of
the rotated, centred vector make a code whose Hamming distances follow the angles. The search radius is
learned on the same sample. Codes are split into substrings, each with an index; a code within the radius of
a query agrees with it in some substring up to ``radius // substrings`` bits, so probing every substring's
index for all values that near finds every code within the radius (pigeonhole). What is found is reranked by
the exact cosine in double precision.

Queries and rows meet in one of two ways, with the same rows out. Where the sample says that few rows are
probed, the indexes are a table of (substring, value, code) that the probed values of each query join; equal
vectors are one entry, and a pair leaves under its first substring only. The number of substrings is the one
that costs least on the sample. Where the radius is too large for that, they meet in blocks: rows are dealt to
groups of about ``ROW_BLOCK``, queries to groups of about ``QUERY_BLOCK``, and a cell is one of each, with its
own indexes; that is quadratic work, but in bounded memory. The best of each query follow by a ranking.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged

#: Vectors that rotation and radius are learned on, as an expected number.
MAX_SAMPLE = 8_000
SUBSTRINGS = 4
#: Share of the sample's true neighbours that the learned radius takes in.
SAMPLE_RECALL = 0.985
ROW_BLOCK, QUERY_BLOCK = 8_192, 1_024
QUERY_EVERY = 50
#: Numbers of substrings to choose from where indexes are joined; values that a query probes at most.
CHOICES, MAX_PROBES = (2, 3, 4, 5, 6, 7, 8), 1 << 14
#: Indexes are joined if a query's probes and the rows that it meets come to less than this share of all rows.
MAX_PROBED = 0.05


def usable(vector: Column, dimensions: int) -> Column:
    """No null, the usual dimension, components finite and not null, length not 0."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) == dimensions) & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def in_range(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their largest components to between 1/2 and 1: angles are the same to the last bit, squares neither vanish nor overflow."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, initial=0.0))[1][:, None])


def units(vectors: np.ndarray) -> np.ndarray:
    vectors = in_range(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class Codes:
    """A learned map from vectors to codes of 64 bits at most, and the radius learned with it."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 5):
        unit = units(sample)
        self.mean = unit.mean(0)
        centred = unit - self.mean
        self.bits = min(64, unit.shape[1])
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, : self.bits]
        projected = centred @ axes
        rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.bits, self.bits)))[0]
        for _ in range(40):
            u, _, vt = np.linalg.svd(np.where(projected @ rotation > 0, 1.0, -1.0).T @ projected)
            rotation = (u @ vt).T
        self.turn = axes @ rotation
        self.radius = self._learned_radius(unit, k)

    def _learned_radius(self, unit: np.ndarray, k: int) -> int:
        queries = np.arange(0, len(unit), max(1, len(unit) // 400))
        cosines = unit[queries] @ unit.T
        cosines[np.arange(len(queries)), queries] = -2
        k = min(k, len(unit) - 1)
        if k < 1:
            return self.bits
        best = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        codes = self(unit)
        distances = np.bitwise_count(codes[queries][:, None] ^ codes[best])
        return int(np.quantile(distances, SAMPLE_RECALL, method="higher"))

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        unit = units(vectors)
        bits = np.zeros((len(vectors), 64), np.uint8)
        bits[:, : self.bits] = (unit - self.mean) @ self.turn > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


class Part(NamedTuple):
    """A substring of the codes, and up to how many bits its probed values differ from the query's (-1: it is not probed)."""

    shift: int
    bits: int
    near: int


def parts_of(bits: int, substrings: int, radius: int) -> list[Part]:
    """Substrings with probes that find every code within the radius.

    With radius = a * substrings + b, the first b + 1 substrings are probed up to a bits and the others up to a - 1:
    a code that differs by more in each of them differs by radius + 1 bits or more.
    """
    cuts = [round(bits * i / substrings) for i in range(substrings + 1)]
    a, b = divmod(radius, substrings)
    return [Part(lo, hi - lo, a if i <= b else a - 1) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]


def ball_size(bits: int, near: int) -> int:
    return sum(math.comb(bits, i) for i in range(min(bits, near) + 1))


@cache
def ball(bits: int, near: int) -> np.ndarray:
    """All values of ``bits`` bits of which at most ``near`` are set."""
    return np.array([sum(1 << i for i in c) for n in range(min(bits, near) + 1) for c in combinations(range(bits), n)], np.uint64)


class Probing(NamedTuple):
    """How indexes are joined: the substrings, the values that a query probes, and the share of rows that it meets by the sample."""

    parts: list[Part]
    probes: int
    share: float


def least_probing(codes: np.ndarray, bits: int, radius: int, rows: int) -> Probing | None:
    """The number of substrings that costs least for ``rows`` rows like the sampled codes; None if no number probes few enough values."""
    codes = np.unique(codes)
    queries = codes[:: max(1, len(codes) // 200)]
    found: list[Probing] = []
    for substrings in CHOICES:
        parts = [p for p in parts_of(bits, substrings, radius) if p.near >= 0]
        probes = sum(ball_size(p.bits, p.near) for p in parts)
        if probes > MAX_PROBES or substrings > bits:
            continue
        met = np.zeros((len(queries), len(codes)), bool)
        for p in parts:
            met |= np.bitwise_count((queries[:, None] ^ codes) >> np.uint64(p.shift) & np.uint64((1 << p.bits) - 1)) <= p.near
        found.append(Probing(parts, probes, float((met.sum(1) - 1).mean() / max(1, len(codes) - 1))))
    return min(found, key=lambda f: f.probes + f.share * rows, default=None)


class MultiIndex:
    """Indexes of the substrings of some codes: for each, its distinct values and the rows that hold them."""

    def __init__(self, codes: np.ndarray, bits: int, substrings: int = SUBSTRINGS):
        self.codes, self.bits, self.substrings = codes, bits, substrings
        self.tables = []
        for part in parts_of(bits, substrings, 0):
            values = codes >> np.uint64(part.shift) & np.uint64((1 << part.bits) - 1)
            order = np.argsort(values, kind="stable")
            distinct, starts = np.unique(values[order], return_index=True)
            self.tables.append((order, distinct, np.append(starts, len(codes))))

    def within(self, query: np.uint64, radius: int) -> np.ndarray:
        """Rows of every code within ``radius`` of the query. Values are probed, or compared where fewer are there than would be probed."""
        found = np.zeros(len(self.codes), bool)
        for part, (order, values, starts) in zip(parts_of(self.bits, self.substrings, radius), self.tables, strict=True):
            if part.near < 0 or not len(values):
                continue
            own = query >> np.uint64(part.shift) & np.uint64((1 << part.bits) - 1)
            if ball_size(part.bits, part.near) < len(values):
                probes = own ^ ball(part.bits, part.near)
                at = np.minimum(np.searchsorted(values, probes), len(values) - 1)
                for i in at[values[at] == probes]:
                    found[order[starts[i] : starts[i + 1]]] = True
            else:
                found[order[np.repeat(np.bitwise_count(values ^ own) <= part.near, np.diff(starts))]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ query) <= radius]


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return in_range(flat.reshape(rows, -1)) if rows else flat.reshape(0, 1)


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines of rows, summed row by row, so that equal vectors have equal ones."""
    return (left * right).sum(1) / (np.sqrt((left * left).sum(1)) * np.sqrt((right * right).sum(1)))


def _cell(table: pa.Table, codes: Codes, radius: int, k: int) -> pa.Table:
    is_query = table.column("is_query").to_numpy().astype(bool)
    ids = table.column("vec_id").to_numpy()
    vectors = matrix(table.column("embedding"), len(ids))
    rows, queries = np.flatnonzero(~is_query), np.flatnonzero(is_query)
    out: list[tuple[np.ndarray, ...]] = []
    if len(rows) and len(queries):
        directions = units(vectors)
        row_units, row_ids = directions[rows], ids[rows]
        index = MultiIndex(codes(vectors[rows]), codes.bits)
        for q, code in zip(queries, codes(vectors[queries]), strict=True):
            found = index.within(code, radius)
            found = found[row_ids[found] != ids[q]]
            scores = row_units[found] @ directions[q]
            if len(found) > 4 * k:  # a cut that keeps ties of the k-th
                keep = scores >= np.partition(scores, -k)[-k] - 1e-12
                found, scores = found[keep], scores[keep]
            exact = cosines(vectors[rows[found]], vectors[q][None])
            best = np.lexsort((row_ids[found], -exact))[:k]
            out.append((np.full(len(best), ids[q]), row_ids[found[best]], exact[best]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})


def _search(vectors: DataFrame, queries: DataFrame, codes: Codes, radius: int, k: int, n_rows: int, n_queries: int) -> DataFrame:
    row_groups, query_groups = max(1, math.ceil(n_rows / ROW_BLOCK)), max(1, math.ceil(n_queries / QUERY_BLOCK))
    own = lambda name, n: F.pmod(F.xxhash64(F.lit(name), "vec_id", "embedding"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("vec_id", "embedding", F.lit(False).alias("is_query"), own("row", row_groups).alias("r")).withColumn("q", every(query_groups))
    right = queries.select("vec_id", "embedding", F.lit(True).alias("is_query"), own("query", query_groups).alias("q")).withColumn("r", every(row_groups))
    cells = left.unionByName(right).groupBy("r", "q").applyInArrow(lambda t: _cell(t, codes, radius, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cells.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _probed(vectors: DataFrame, queries: DataFrame, codes: Codes, radius: int, k: int, parts: list[Part]) -> DataFrame:
    """The same rows as ``_search``, by a join of probed values with the indexes of all different vectors.

    Of rows with equal vectors the ``k + 1`` least ids are kept, each ``k`` times at most: no query can show more.
    """
    spark = vectors.sparkSession
    same = Window.partitionBy("embedding")
    few = vectors.withColumn("copy", F.row_number().over(Window.partitionBy("embedding", "vec_id").orderBy("vec_id"))).filter(F.col("copy") <= k)
    few = few.withColumn("place", F.dense_rank().over(same.orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    classes = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))

    def with_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = codes(matrix(batch.column("embedding"), batch.num_rows)).view(np.int64) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(coded, pa.int64())], names=[*batch.schema.names, "code"])

    nodes = staged(classes.mapInArrow(with_codes, "embedding array<double>, ids array<long>, code long").withColumn("node", F.monotonically_increasing_id()), "nodes")
    asked = staged(queries.select("vec_id", "embedding").mapInArrow(with_codes, "vec_id long, embedding array<double>, code long"), "asked")
    values = F.array(*[F.shiftrightunsigned("code", p.shift).bitwiseAND(F.lit((1 << p.bits) - 1)) for p in parts])
    masks = spark.createDataFrame(pa.table({
        "part": pa.array(np.repeat(np.arange(len(parts), dtype=np.int32), [ball_size(p.bits, p.near) for p in parts])),
        "mask": pa.array(np.concatenate([ball(p.bits, p.near) for p in parts]).astype(np.int64)),
    }))  # MAX_PROBES rows at most
    index = nodes.select("node", F.col("code").alias("node_code"), F.posexplode(values).alias("part", "value"))
    probes = asked.select(F.col("vec_id").alias("query_id"), "code", F.posexplode(values).alias("part", "own")).join(F.broadcast(masks), "part")
    probes = probes.select("query_id", "code", "part", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
    apart = F.col("code").bitwiseXOR(F.col("node_code"))
    seen = F.lit(False)  # the pair meets in an earlier part, too
    for i, p in enumerate(parts[:-1]):
        inside = F.bit_count(F.shiftrightunsigned(apart, p.shift).bitwiseAND(F.lit((1 << p.bits) - 1))) <= p.near
        seen = seen | ((F.col("part") > i) & inside)
    pairs = probes.join(index, ["part", "value"]).filter((F.bit_count(apart) <= radius) & ~seen).select("query_id", "node")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = cosines(matrix(batch.column("embedding"), batch.num_rows), matrix(batch.column("asked"), batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("ids"), pa.array(scores, pa.float64())], names=["query_id", "ids", "score"])

    met = pairs.join(nodes.select("node", "embedding", "ids"), "node").join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked")), "query_id")
    found = met.select("query_id", "ids", "embedding", "asked").mapInArrow(scored, "query_id long, ids array<long>, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = found.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(embeddings: DataFrame, k: int = 5, query_every: int = QUERY_EVERY, max_sample: int = MAX_SAMPLE, join_indexes: bool | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose vec_id is divisible by ``query_every`` its nearest other rows.

    Vectors that are null, zero, of another dimension than most, or that hold null or non-finite components
    take no part, nor do rows without an id. Rows that share a query's id are not its candidates, and the least
    of their vectors is the query; other repeated rows are candidates each. Ties go to the smaller vec_id. A query that finds fewer than ``k``
    within the radius is searched again without one, so a row is missing only if there are too few vectors.
    ``join_indexes`` says how queries and rows meet (None: by what the sample tells); the rows are the same.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null")
    sizes = rows.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    vectors = staged(rows.filter(usable(F.col("embedding"), sizes.n)), "vectors")
    asked = vectors.filter(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    counted = vectors.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.when(F.col("vec_id") % query_every == 0, F.col("vec_id"))).alias("queries")).first()
    if not counted.rows:
        return spark.createDataFrame([], schema)
    share = min(1.0, max_sample / counted.rows)
    sample = vectors if share == 1 else vectors.filter(F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * share)))
    learned = sample.orderBy("vec_id").select("embedding").toPandas()["embedding"]
    training = np.stack(learned.to_numpy()) if len(learned) else np.eye(sizes.n)
    codes = Codes(training, k)
    probing = None if join_indexes is False else least_probing(codes(training), codes.bits, codes.radius, counted.rows)
    if probing and (join_indexes or probing.probes + probing.share * counted.rows <= MAX_PROBED * counted.rows):
        first = staged(_probed(vectors, asked, codes, codes.radius, k, probing.parts), "near")
    else:
        first = staged(_search(vectors, asked, codes, codes.radius, k, counted.rows, counted.queries), "near")
    done = first.groupBy(F.col("query_id").alias("done_id")).count().filter(F.col("count") >= k)
    again = staged(asked.join(done, F.col("vec_id") == F.col("done_id"), "left_anti"), "asked-again")
    rest = again.count()
    found = first.select("query_id", "rank", "vec_id", "score")
    if rest:
        full = _search(vectors, again, codes, codes.bits, k, counted.rows, rest)
        found = found.join(again.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(full.select("query_id", "rank", "vec_id", "score"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

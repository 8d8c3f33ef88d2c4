"""Conversation structure repair: the cheapest edits by a bidirectional tight-arc graph.

A repaired conversation's roles read ``(s?(ua)+)?``. Its graph has a node for each place between rows and each
of the four ``STATES`` of that language; arcs are edits: keep, rerole and delete pass a row, insert stays. Forward and
backward minimum costs of the nodes tell the tight arcs, those on some cheapest way; a traversal that holds
the set of nodes reached by the letters so far takes the least letter that leaves it. The roles of the result
follow from its length alone (an odd one starts with system), so the letters say everything.

Conversations stand in one global order of rows and are cut into chunks of rows, which are independent: a
chunk's costs are a 4 x 4 table of minimum costs, and tables of a conversation's chunks are chained to give the
costs at every border; a second chain gives the set of nodes that the traversal reaches there. Conversations of one
chunk, as good as all, need neither. Chunks of like length are worked on together, one row of each at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, give_back, partitions, staged

#: Rows of a chunk at most, and cells (conversations x rows) that are worked on at once.
CHUNK, CELLS = 1 << 14, 1 << 20
#: Before any row, after system, after user, after assistant; the first and the last may end.
STATES = 4
#: State that each initial (none, s, u, a) leads to from each state; -1: none.
STEP = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
ENDS = np.array([True, False, False, True])
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
FAR = 1 << 60
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
SPACE = " \t\n\x0b\x0c\r"


# Costs


def _after_inserts(cost: np.ndarray) -> np.ndarray:
    """Least costs (last axis: states) when rows may be inserted first; two in a row are the most that pay."""
    out = cost.copy()
    for _ in range(2):
        before = out.copy()
        for q in range(STATES):
            for role in (2, 3):
                if STEP[q, role] >= 0:
                    to = STEP[q, role]
                    out[..., to] = np.minimum(out[..., to], before[..., q] + INSERT)
    return out


def _before_inserts(cost: np.ndarray) -> np.ndarray:
    """Least costs to the end when rows may be inserted here."""
    out = cost.copy()
    for _ in range(2):
        before = out.copy()
        for q in range(STATES):
            for role in (2, 3):
                if STEP[q, role] >= 0:
                    out[..., q] = np.minimum(out[..., q], before[..., STEP[q, role]] + INSERT)
    return out


@lru_cache(1)
def _arcs() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code (initial + 4 * fault; code 16: no row) and states from and to: cost of delete, keep and rerole, and of the cheapest."""
    delete, keep, rerole = (np.full((17, STATES, STATES), FAR) for _ in range(3))
    for code in range(16):
        initial, fault = code % 4, code // 4
        more = CUT_SHORT if fault == TRUNCATED else 0
        delete[code, range(STATES), range(STATES)] = DELETE
        if fault in (BLANK, DUPLICATE):
            continue
        for q in range(STATES):
            if STEP[q, initial] >= 0:
                keep[code, q, STEP[q, initial]] = KEEP + more
            for role in (2, 3):
                if STEP[q, role] >= 0:
                    rerole[code, q, STEP[q, role]] = REROLE + more
    best = np.minimum(np.minimum(delete, keep), rerole)
    best[16, range(STATES), range(STATES)] = 0  # past the end of a shorter chunk
    return delete, keep, rerole, best


def chunk_table(codes: np.ndarray) -> np.ndarray:
    """Least cost from each state before the rows of ``codes`` (chunks x rows, padded with 16) to each state after them; inserts before a row count, those after the last don't."""
    best = _arcs()[3]
    cost = np.full((len(codes), STATES, STATES), FAR)
    cost[:, range(STATES), range(STATES)] = 0
    for i in range(codes.shape[1]):
        cost = np.where((codes[:, i] < 16)[:, None, None], _after_inserts(cost), cost)
        cost = (cost[:, :, :, None] + best[codes[:, i]][:, None]).min(2)
    return np.minimum(cost, FAR)


def backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least cost to the conversation's end at each place of each chunk and state, inserts there included; ``end`` holds those at the chunks' ends."""
    best, n = _arcs()[3], codes.shape[1]
    cost = np.empty((n + 1, len(codes), STATES), np.int64)
    cost[n] = end
    for i in range(n - 1, -1, -1):
        passed = (best[codes[:, i]] + cost[i + 1][:, None, :]).min(2)
        cost[i] = np.minimum(np.where((codes[:, i] < 16)[:, None], _before_inserts(passed), cost[i + 1]), FAR)
    return cost


def traverse(codes: np.ndarray, start: np.ndarray, to_go: np.ndarray, total: np.ndarray, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Follow the least letters over tight arcs.

    ``start``: costs so far at the chunks' starts, ``to_go``: what ``backward`` gives, ``total``: costs of the whole, ``reached``:
    whether the letters so far lead to a state. Returns, by chunk and row, inserts before it and the letter
    that passes it (0 delete, 1 keep, 2 rerole), and the states reached and the costs at the end.
    """
    delete, keep, rerole, best = _arcs()
    m, n = codes.shape
    inserts, letters = np.zeros((m, n), np.int8), np.full((m, n), -1, np.int8)
    cost = start.copy()
    for i in range(n):
        code, row = codes[:, i], codes[:, i] < 16
        spread = _after_inserts(cost)
        reached, added = _inserted(spread, to_go[i], total, reached, [(delete[code], to_go[i + 1])], row)
        inserts[:, i] = added
        left = row.copy()
        onward = np.where(row[:, None], False, reached)
        for letter, arc in enumerate((delete[code], keep[code], rerole[code])):
            tight = reached[:, :, None] & (spread[:, :, None] + arc + to_go[i + 1][:, None, :] == total[:, None, None])
            taken = left & tight.any((1, 2))
            letters[taken, i] = letter
            onward[taken] = tight[taken].any(1)
            left &= ~taken
        cost = np.minimum(np.where(row[:, None], (spread[:, :, None] + best[code]).min(1), cost), FAR)
        reached = onward
    return inserts, letters, reached, cost


def _inserted(spread: np.ndarray, to_go: np.ndarray, total: np.ndarray, reached: np.ndarray, before: list[tuple[np.ndarray, np.ndarray]], may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Take inserts while they are tight and no arc of ``before`` (of a smaller letter) is; the states reached then, and how many were taken."""
    added = np.zeros(len(reached), np.int8)
    for _ in range(2):
        smaller = np.zeros(len(reached), bool)
        for arc, beyond in before:
            smaller |= (reached[:, :, None] & (spread[:, :, None] + arc + beyond[:, None, :] == total[:, None, None])).any((1, 2))
        onward = np.zeros_like(reached)
        for q in range(STATES):
            for role in (2, 3):
                if STEP[q, role] >= 0:
                    to = STEP[q, role]
                    onward[:, to] |= reached[:, q] & (spread[:, q] + INSERT + to_go[:, to] == total)
        taken = may & ~smaller & onward.any(1)
        reached = np.where(taken[:, None], onward, reached)
        added += taken
    return reached, added


def trailing(cost: np.ndarray, total: np.ndarray, reached: np.ndarray) -> np.ndarray:
    """Inserts after the last row."""
    end = np.where(ENDS, 0, FAR)[None].repeat(len(cost), 0)
    return _inserted(_after_inserts(cost), _before_inserts(end), total, reached, [], np.ones(len(cost), bool))[1]


# Rows in order


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of the rows after the contract's damage; nulls of role and text, and of what is hashed, count as one space."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(say("text"), F.lit("[.!?]"), F.lit(""))).otherwise(say("text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(kind == 4, "user").otherwise(say("role")).alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with ``place``, a number that rises along conversations (nulls first) and in them by turn (nulls first), role, and text (its first 32 characters, then a hash). The result is staged."""
    by = ["conv_id", "turn", "role", "head", "text_hash"]
    keyed = rows.withColumns({"head": F.left("text", F.lit(32)), "text_hash": F.xxhash64("text"), "spread": F.monotonically_increasing_id()})
    parted = keyed.repartitionByRange(partitions(rows.sparkSession), *by, "spread")  # rows that are equal in all may stand in several tasks
    return staged(parted.sortWithinPartitions(*by).drop("head", "text_hash", "spread").withColumn("place", F.monotonically_increasing_id()), "conversation-rows")


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, place and code (initial of the role + 4 * first fault) of ordered rows."""
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    shape = F.when(~F.regexp_like("text", F.lit(WORD)), BLANK).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(NO_FAULT)
    initial = F.expr("if(role = '', 0, locate(left(role, 1), 'sua'))")
    said = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    slim = rows.select("conv_id", "place", initial.alias("initial"), shape.alias("shape"), said.alias("said"))
    firsts = slim.groupBy("conv_id", "said").agg(F.min("place").alias("first_place")).select("first_place")
    again = F.col("first_place").isNull() & (F.col("shape") != BLANK)
    marked = slim.join(firsts, F.col("place") == F.col("first_place"), "left").withColumn("fault", F.when(again, DUPLICATE).otherwise(F.col("shape")))
    return marked.select("conv_id", "place", (F.col("initial") + 4 * F.col("fault")).cast("int").alias("code"))


# Chunks


def _padded(lists: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and codes (padded with 16) of lists of like length, some ``CELLS`` at a time."""
    lengths = np.array([len(x) for x in lists], np.int64)
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * lengths[order[end]] <= CELLS and lengths[order[end]] <= 2 * lengths[order[at]] + 8:
            end += 1
        some = order[at:end]
        codes = np.full((len(some), lengths[some].max()), 16, np.int64)
        for k, i in enumerate(some):
            codes[k, : lengths[i]] = lists[i]
        yield some, codes
        at = end


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0] if len(offsets) else offsets
    return [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _field(structs: pa.Array, name: str) -> pa.Array:
    return pc.struct_field(structs, name)


def _rows(x: np.ndarray) -> pa.Array:
    return pa.array(x.reshape(len(x), -1).tolist(), pa.list_(pa.int64()))


def borders(chunks: DataFrame) -> DataFrame:
    """conv_id, chunk, start (costs there), end (costs to go), total, and reached (states that the letters lead to) of the chunks of conversations that have several."""
    several = staged(chunks.filter("not (opens and closes)").select("conv_id", "chunk", "codes"), "long-conversations")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, STATES * STATES), np.int64)
            for some, codes in _padded(_lists(batch.column("codes"))):
                out[some] = chunk_table(codes).reshape(len(some), -1)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), _rows(out)], ["conv_id", "chunk", "costs"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parts = batch.column("parts")[i].values
                tables = _matrix(_field(parts, "costs")).reshape(-1, STATES, STATES)
                start, end = np.full((len(tables), STATES), FAR), np.full((len(tables), STATES), FAR)
                start[0, 0] = 0
                for n, t in enumerate(tables[:-1]):
                    start[n + 1] = np.minimum((start[n][:, None] + t).min(0), FAR)
                end[-1] = _before_inserts(np.where(ENDS, 0, FAR))
                for n in range(len(tables) - 1, 0, -1):
                    end[n - 1] = np.minimum((tables[n] + end[n][None]).min(1), FAR)
                total = int(((start[-1][:, None] + tables[-1]).min(0) + end[-1]).min())
                same = pa.array([batch.column("conv_id")[i].as_py()] * len(tables), pa.int64())
                yield pa.RecordBatch.from_arrays([same, _field(parts, "chunk"), _rows(start), _rows(end), pa.array(np.full(len(tables), total))], ["conv_id", "chunk", "start", "end", "total"])

    def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where the traversal leads from every set of states (bits of a number)."""
        sets = np.array([[s >> q & 1 for q in range(STATES)] for s in range(1 << STATES)], bool)
        for batch in batches:
            lists, start, end, total = _lists(batch.column("codes")), _matrix(batch.column("start")), _matrix(batch.column("end")), batch.column("total").to_numpy()
            out = np.zeros((batch.num_rows, len(sets)), np.int64)
            for some, codes in _padded(lists):
                to_go = backward(codes, end[some])
                for s, reached in enumerate(sets):
                    last = traverse(codes, start[some], to_go, total[some], np.repeat(reached[None], len(some), 0))[2]
                    out[some, s] = last @ (1 << np.arange(STATES))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), _rows(out)], ["conv_id", "chunk", "moves"])

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parts = batch.column("parts")[i].values
                table = _matrix(_field(parts, "moves"))
                reached = [1]
                for t in table[:-1]:
                    reached.append(int(t[reached[-1]]))
                same = pa.array([batch.column("conv_id")[i].as_py()] * len(table), pa.int64())
                yield pa.RecordBatch.from_arrays([same, _field(parts, "chunk"), pa.array(reached, pa.int32())], ["conv_id", "chunk", "reached"])

    in_order = lambda rows, column: rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", column))).alias("parts"))
    costs = in_order(several.mapInArrow(tables, "conv_id long, chunk long, costs array<long>"), "costs").mapInArrow(chained, "conv_id long, chunk long, start array<long>, end array<long>, total long")
    costs = staged(costs, "chunk-costs")
    moved = several.join(costs.drop("conv_id"), "chunk").mapInArrow(moves, "conv_id long, chunk long, moves array<long>")
    reached = in_order(moved, "moves").mapInArrow(followed, "conv_id long, chunk long, reached int")
    return costs.join(reached.select("chunk", "reached"), "chunk")


def chunked(codes: DataFrame, size: int = CHUNK) -> DataFrame:
    """conv_id, chunk (place of its first row), codes, and whether the chunk opens and closes its conversation. The result is staged."""
    rows = codes.groupBy("conv_id", F.floor(F.col("place") / size).alias("part")).agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("rows"))
    chunks = staged(rows.select("conv_id", F.col("rows")[0]["place"].alias("chunk"), F.transform("rows", lambda r: r["code"]).alias("codes")), "chunks")
    along = Window.partitionBy("conv_id").orderBy("chunk")
    ends = chunks.select(F.col("chunk").alias("end_chunk"), F.lag("chunk").over(along).isNull().alias("opens"), F.lead("chunk").over(along).isNull().alias("closes"))
    return staged(chunks.join(ends, F.col("chunk") == F.col("end_chunk")).drop("end_chunk"), "chunks-in-order")


def edits(chunks: DataFrame) -> DataFrame:
    """conv_id, chunk, opens, codes, cost (of the whole conversation) and audit (the letters of its part) of ``chunks``."""
    known = borders(chunks).select(F.col("chunk").alias("known_chunk"), "start", "end", "total", "reached")
    rows = chunks.join(known, F.col("chunk") == F.col("known_chunk"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, closes = _lists(batch.column("codes")), batch.column("closes").to_numpy(zero_copy_only=False)
            alone = batch.column("start").is_null().to_numpy(zero_copy_only=False)
            start, end = np.full((len(lists), STATES), FAR), np.repeat(_before_inserts(np.where(ENDS, 0, FAR))[None], len(lists), 0)
            start[alone, 0] = 0
            if not alone.all():
                start[~alone], end[~alone] = (_matrix(batch.column(c).drop_null()) for c in ("start", "end"))
            total, reached = batch.column("total").fill_null(-1).to_numpy().copy(), batch.column("reached").fill_null(1).to_numpy()
            audit = [""] * len(lists)
            for some, codes in _padded(lists):
                to_go = backward(codes, end[some])
                total[some] = np.where(alone[some], (_after_inserts(start[some]) + to_go[0]).min(1), total[some])
                states = (reached[some][:, None] >> np.arange(STATES) & 1).astype(bool)
                inserts, letters, states, cost = traverse(codes, start[some], to_go, total[some], states)
                after = np.where(closes[some], trailing(cost, total[some], states), 0)
                for k, i in enumerate(some):
                    n = len(lists[i])
                    audit[i] = "".join("I" * a + "DKR"[b] for a, b in zip(inserts[k, :n].tolist(), letters[k, :n].tolist(), strict=True)) + "I" * int(after[k])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), batch.column("opens"), batch.column("codes"), pa.array(total), pa.array(audit)], ["conv_id", "chunk", "opens", "codes", "cost", "audit"])
        give_back()

    rows = rows.select("conv_id", "chunk", "opens", "closes", "codes", "start", "end", "total", "reached")
    return rows.mapInArrow(run, "conv_id long, chunk long, opens boolean, codes array<int>, cost long, audit string")


# Conversations as streams


class _Repair:
    """What a conversation says row by row, and its repaired rows, as they come by."""

    def __init__(self, conv_id: int | None, cost: int):
        self.conv_id, self.cost = conv_id, cost
        self.state, self.number = 0, 0
        self.audit: list[str] = []
        self.letters, self.codes = iter(""), iter(())
        self.faults = [0, 0, 0, 0]
        self.illegal, self.before = 0, None
        self.turns, self.first_turn, self.last_turn = 0, None, None

    def chunk(self, audit: str, codes: list[int]) -> None:
        self.audit.append(audit)
        self.letters, self.codes = iter(audit), iter(codes)

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the rows that leave: inserted ones, and this one if it stays."""
        code = next(self.codes)
        self.faults[code // 4] += 1
        initial = code % 4
        if self.before is not None:
            self.illegal += (self.before, initial) not in ((1, 2), (2, 3), (3, 2))
        self.before = initial
        if turn is not None and (self.turns == 0 or turn != self.last_turn):
            self.turns += 1
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
        for letter in self.letters:
            if letter == "D":
                return
            if letter == "K":
                self.state = int(STEP[self.state, initial])
                yield "K", role, text
                return
            yield letter, self._next_role(), "" if letter == "I" else text
            if letter == "R":
                return

    def rest(self) -> Iterator[tuple[str, str, str]]:
        for letter in self.letters:
            yield letter, self._next_role(), ""

    def _next_role(self) -> str:
        """The role that must stand next; only a kept row can be a system one."""
        self.state = 3 if self.state == 2 else 2
        return "assistant" if self.state == 3 else "user"


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Repair, list[tuple[str, str, str]], bool]]:
    """(conversation, repaired rows that come next, whether it ends) along sorted rows of chunks and texts."""
    now: _Repair | None = None
    for batch in batches:
        for conv_id, opens, audit, codes, cost, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "opens", "audit", "codes", "cost", "turn", "role", "text")), strict=True):
            if audit is None:
                yield now, list(now.row(turn, role, text)), False
                continue
            if opens:
                if now is not None:
                    yield now, list(now.rest()), True
                now = _Repair(conv_id, cost)
            now.chunk(audit, codes)
    if now is not None:
        yield now, list(now.rest()), True


def _streamed(rows: DataFrame, chunk: int) -> DataFrame:
    """Texts in order, before those of a chunk the chunk's edits; a conversation is in one task, which reads it as a stream."""
    texts = ordered(rows)
    marks = edits(chunked(coded(texts), chunk))
    head = marks.select("conv_id", F.col("chunk").alias("place"), F.lit(0).alias("kind"), "opens", "audit", "codes", "cost", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    body = texts.select("conv_id", "place", F.lit(1).alias("kind"), F.lit(False).alias("opens"), F.lit(None).cast("string").alias("audit"), F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("cost"), "turn", "role", "text")
    return head.unionByName(body).repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place", "kind").drop("place", "kind")


def repaired_rows(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, number (from 0), edit (K kept, R role changed, I inserted), role and text of the repaired conversations of ``rows`` (conv_id, turn, role, text).

    Rows stand by turn (nulls first), role and text (as ``ordered`` says); null roles and texts count as one space. Rows whose null
    conv_id they share are one conversation. Blank rows and rows that say again what an earlier one said go.
    A conversation of which nothing stays has no row. Repeated rows, empty and very long texts are as any; extra columns take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*held, strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "number", "edit", "role", "text"])

        for now, out, _ in _events(batches):
            for edit, role, text in out:
                held.append((now.conv_id, now.number, edit, role, text))
                now.number += 1
                size += 100 + len(text)
            if size > 1 << 20:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        give_back()

    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    plain = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), say("role"), say("text"))
    return _streamed(plain, chunk).mapInArrow(run, "conv_id long, number long, edit string, role string, text string")


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_digest(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The contract's columns for every original conv_id, null among them; rows are damaged first.

    Ties of a turn stand by role and text. ``gaps`` past the largest long are held there. A conversation without rows
    after the damage has zeros, an empty audit and the hash of the empty string; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        said = hashlib.sha256()
        for now, out, ends in _events(batches):
            for _, role, text in out:
                said.update(f"{'' if now.number == 0 else chr(10)}{role}:{text}".encode())
                now.number += 1
            if ends:
                gaps = 0 if now.turns == 0 else min(now.last_turn - now.first_turn + 1 - now.turns, (1 << 63) - 1)
                held.append((now.conv_id, gaps, *now.faults[1:], now.illegal, now.cost, "".join(now.audit), said.hexdigest()))
                said = hashlib.sha256()
                if len(held) == 4096:
                    yield _digest(held)
                    held = []
        if held:
            yield _digest(held)
        give_back()

    found = _streamed(damaged(conversations), chunk).mapInArrow(run, DIGEST)
    everyone = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rest = everyone.join(found.select(F.col("conv_id").alias("found_id"), *[c.split()[0] for c in DIGEST.split(", ")[1:]]), F.col("conv_id").eqNullSafe(F.col("found_id")), "left").drop("found_id")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return rest.fillna(empty | dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0))


def _digest(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in DIGEST.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)], names)


#: The contract as SQL. The best way to a state after a row is the least (cost, audit), so that one row for each state goes on.
ORACLE = r"""
WITH RECURSIVE marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) % 20 AS kind FROM conversations),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM marked WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial FROM damaged),
faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
step(q, role, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(q, q2, letters, cost, said) AS (VALUES (0, 0, '', 0, []::VARCHAR[]), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 3, ['user:']), (1, 2, 'I', 3, ['user:']), (2, 3, 'I', 3, ['assistant:']), (3, 2, 'I', 3, ['user:']), (0, 3, 'II', 6, ['user:', 'assistant:']), (1, 3, 'II', 6, ['user:', 'assistant:'])),
passes AS (
  SELECT conv_id, i, q, q AS q2, 'D' AS letter, 4 AS cost, []::VARCHAR[] AS said FROM faulty, range(4) r(q)
  UNION ALL SELECT conv_id, i, step.q, step.q2, 'K', CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, [faulty.role || ':' || text] FROM faulty JOIN step ON step.role = initial WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, i, step.q, step.q2, 'R', CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, [CASE step.role WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM faulty JOIN step ON step.role IN ('u', 'a') WHERE fault NOT IN ('blank', 'duplicate')),
walk(conv_id, i, q, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]} FROM faulty
  UNION ALL SELECT w.conv_id, w.i + 1, p.q2, min({'cost': w.best.cost + n.cost + p.cost, 'audit': w.best.audit || n.letters || p.letter, 'said': list_concat(list_concat(w.best.said, n.said), p.said)})
    FROM walk w JOIN inserts n ON n.q = w.q JOIN passes p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i + 1 AND p.q = n.q2 GROUP BY w.conv_id, w.i, p.q2),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
ends AS (SELECT w.conv_id, w.i, min({'cost': w.best.cost + n.cost, 'audit': w.best.audit || n.letters, 'said': list_concat(w.best.said, n.said)}) AS best FROM walk w JOIN inserts n ON n.q = w.q WHERE n.q2 IN (0, 3) GROUP BY w.conv_id, w.i)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id AND e.i = c.n
"""

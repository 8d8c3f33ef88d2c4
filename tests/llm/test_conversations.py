import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tessera.llm import conversations, queries
from tests.llm.helpers import SF, table


def plain(rows):
    """The contract in Python over (conv_id, turn, role, text) rows; cheapest edits by trying every way with Dijkstra over (cost, audit)."""
    import heapq

    space = " \t\n\x0b\x0c\r"
    by: dict = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, said in by.items():
        said = sorted(said, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        turns = {t for t, _, _ in said if t is not None}
        faults, seen = [], set()
        for _, role, text in said:
            faults.append("blank" if not text.strip(space) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(space)[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in said]
        step = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "0'", ("0'", "u"): "2"}
        heap, done = [(0, "", 0, "0", ())], set()
        while heap:
            cost, audit, i, q, made = heapq.heappop(heap)
            if i == len(said) and q in ("0", "0'"):
                break
            if (i, q) in done:
                continue
            done.add((i, q))
            for role in ("user", "assistant"):
                if to := step.get((q, role[0])):
                    heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*made, f"{role}:")))
            if i < len(said):
                heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, made))
                if faults[i] not in ("blank", "duplicate"):
                    more = 3 * (faults[i] == "truncated")
                    _, role, text = said[i]
                    if to := step.get((q, role[:1])):
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*made, f"{role}:{text}")))
                    for new in ("user", "assistant"):
                        if to := step.get((q, new[0])):
                            heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, to, (*made, f"{new}:{text}")))
        illegal = sum(a + b not in ("su", "ua", "au") or len(a + b) < 2 for a, b in itertools.pairwise(initials))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def found(frame):
    rows = frame.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[1:]) for r in rows}


def made_up(seed, conversations=150):
    draw = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(draw.randrange(draw.choice((1, 4, 12, 60)))):
            role = draw.choice(("system", "user", "user", "assistant", "assistant", "tool", "", "User", None, "useful", "ä"))
            text = draw.choice(("Hi.", "Hi.", "No end", " \t\n ", "", "ok!  ", f"turn {turn}?", f"t{turn}", None, "。", "x" * 40 + "."))
            rows.append((None if conv == 3 else conv, draw.choice((turn, turn, turn, None, 3 * turn)), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("chunk", (conversations.CHUNK, 5, 1))
def test_same_as_plain_search(spark, chunk):
    rows = made_up(1) + [(900, t, "user" if t % 3 else "assistant", f"{t}.") for t in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = found(conversations.repair_digest(frame, chunk))
    want = plain(rows)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], (conv, [r for r in rows if r[0] == conv])


def test_given_table(spark):
    frame = queries.QUERIES["op11_conversations"](spark, SF)
    assert frame.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert found(frame) == plain([tuple(r) for r in table(spark, "conversations").select("conv_id", "turn", "role", "text").collect()])


def test_sql_equals_plain_search():
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    rows = [r for r in made_up(2) if "ä" not in (r[2] or "")]
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {r[0]: tuple(r[1:]) for r in con.execute(conversations.ORACLE).fetchall()} == plain(rows)


def test_costs_of_chunks_are_those_of_the_whole():
    draw = np.random.default_rng(3)
    codes = draw.integers(0, 16, (40, 30))
    whole = conversations.chunk_table(codes)
    a, b = conversations.chunk_table(codes[:, :11]), conversations.chunk_table(codes[:, 11:])
    assert (np.minimum((a[:, :, :, None] + b[:, None]).min(2), conversations.FAR) == whole).all()


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "user", "Hi?"), (1, 3, "user", "And this."), (1, 4, "assistant", "Yes."), (2, 0, "assistant", " "), (None, 0, "tool", "Alone.")]
    out = conversations.repaired_rows(spark.createDataFrame([(*r, 9) for r in rows], SCHEMA + ", place int")).collect()
    by: dict = {}
    for r in sorted(out, key=lambda r: (r.conv_id is None, r.conv_id or 0, r.number)):
        by.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    assert by[1] == [("K", "system", "Be kind."), ("K", "user", "Hi?"), ("I", "assistant", ""), ("K", "user", "And this."), ("K", "assistant", "Yes.")]
    assert 2 not in by and by.get(None, []) == []


def test_odd_tables(spark):
    long = "word " * 400_000
    rows = [(1, -(1 << 63), "user", long), (1, (1 << 63) - 1, "assistant", long + "."), (2, None, None, None), (2, None, "user", "x."), (None, None, None, None), (7, 1, "user", "a."), (7, 1, "user", "a."), (7, 1, "user", "a.")]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", audit string, chunk int")
    want = plain(rows)
    got = found(conversations.repair_digest(frame))
    if want[1][0] > (1 << 63) - 1:
        want[1] = ((1 << 63) - 1, *want[1][1:])
    assert got == want
    assert conversations.repair_digest(frame.limit(0)).collect() == []
    assert conversations.repaired_rows(frame.limit(0)).collect() == []

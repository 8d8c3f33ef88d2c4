"""Benchmark decontamination by templates: finds benchmark items in documents even if their parameters were changed.

A text becomes a template: numbers, names and units turn into typed placeholders, words are lower-cased.
Windows of ``WINDOW`` template tokens are hashed. Documents are scanned in place; only windows that may be in
the benchmark (a filter sized by the benchmark, without false negatives) leave the scan, and are hash-joined
with the benchmark's windows. Windows of one document and item with the same shift are one alignment. An
alignment counts if its slots agree: one value of the item stands for one value of the document all along,
and different names for different names. Items covered to ``MIN_COVERAGE`` by such alignments are reported, and
those of which ``MIN_RUN`` tokens in a row stand in a document, in such an alignment or word for word.

A window has up to three forms: as the template has it; with the words that begin a sentence or a line as
placeholders too, as they may be names; and without names, all words case-folded, so that letter case, by which
names are told, cannot hide a copy.

Items without a window of enough words (short ones, or such that hold little but numbers) are found by their
whole template in a fourth form: all its windows, with the same slots, and for items shorter than a window
only where the document has them as whole sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, packed, staged

WINDOW = 8
#: Least number of tokens of a window that are no placeholders.
MIN_LITERALS = 4
#: Share of an item's template tokens that consistent alignments must cover, or tokens in a row, consistent or verbatim.
MIN_COVERAGE, MIN_RUN = 0.5, 13
#: Bits of the window filter: 64 for each benchmark window, and at least and at most 2 to these powers (a full filter costs work, no result).
FILTER_BITS = (16, 27)

#: Units that follow a number, and numbers in words.
UNITS = frozenset("km m cm mm mi mile miles ft foot feet inch inches yd yard yards kg g mg lb lbs pound pounds oz ounce ounces ton tons l ml litre litres liter liters gallon gallons cup cups h hr hrs hour hours min mins minute minutes s sec secs second seconds day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur gbp kmh mph".split())
NUMBER_WORDS = frozenset("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())

_BASE = 0x9E3779B97F4A7C15
NUMBER, NAME, UNIT, START, FOLDED = (np.uint64(xxhash.xxh64_intdigest(x)) for x in ("\0number", "\0name", "\0unit", "\0start", "\0folded"))
_PLACEHOLDERS = np.array([0, NUMBER, NAME, UNIT, START], np.uint64)
#: Kinds of template tokens, and the letters that stand for them in slots.
WORD, NUMERAL, PROPER, MEASURE, OPENER = range(5)
_LETTERS = "wnpus"
#: Forms of a window.
TYPED, OPEN, LITERAL, WHOLE = range(4)
#: What a token is by itself.
IS_END, IS_SIGN, IS_NUMBER, IS_UNIT, IS_CAPITAL, IS_UPPER = (1 << i for i in range(6))
#: What a character is in a token; those from ``APOSTROPHE`` on stand for themselves. ``JOINT`` and ``STOP`` join numbers, ``STOP`` is an end where it does not.
OTHER, LETTER, DIGIT, APOSTROPHE, JOINT, STOP, END, SIGN = range(8)
_ROLES = {**dict.fromkeys("'’", APOSTROPHE), **dict.fromkeys(",/", JOINT), **dict.fromkeys(".:", STOP), **dict.fromkeys("!?\n", END), **dict.fromkeys("$€£%", SIGN)}
#: Bits beside it: lower or title case, upper case, a digit by ``str.isdigit``, case-folded to several characters, not met so far.
ROLE, LOWER, UPPER, DIGITAL, UNFOLDS, UNMET = 7, 8, 16, 32, 64, 128
_BEGINS_TOKEN = np.isin(np.arange(8), (LETTER, DIGIT, STOP, END, SIGN))
#: No token goes on after these, whatever stands before.
_PARTING = re.compile(r"[^\w.,:/'’]")
#: Characters that are looked at together (and those up to the next that parts), and tokens.
BLOCK, AT_ONCE = 1 << 17, 1 << 17


class Tokens:
    """Splits texts into tokens and tells what each token is by itself; keeps the characters it has met, and the tokens of the last texts.

    A token is a number (``12``, ``1,000.5``, ``10:30``), a word of letters with one apostrophe inside at most, an
    end (``. ! ? :`` or a line's) or a sign. Its code is a polynomial hash of its case-folded characters.
    """

    def __init__(self):
        self.marks, self.values = np.full(0x110000, UNMET, np.uint8), np.zeros(0x110000, np.uint64)
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.special, self.special_traits, self.maybe_special = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(1 << 12, bool)
        words = {**dict.fromkeys(NUMBER_WORDS, IS_NUMBER), **dict.fromkeys(UNITS, IS_UNIT)}
        codes = self._block(" ".join(words))[2]
        order = np.argsort(codes)
        self.special, self.special_traits = codes[order], np.array(list(words.values()), np.uint8)[order]
        self.maybe_special[codes & np.uint64(0xFFF)] = True
        self.clear()

    def clear(self) -> None:
        self.text, self.firsts, self.pasts = "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.codes, self.traits = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        self.powers, self.inverses = self.powers[: 2 * BLOCK + 1].copy(), self.inverses[: 2 * BLOCK + 1].copy()

    def lower(self, i: int) -> str:
        """The case-folded text of a token."""
        return self.text[self.firsts[i] : self.pasts[i]].casefold()

    def _marks(self, points: np.ndarray) -> np.ndarray:
        marks = self.marks[points]
        if marks.max(initial=0) < UNMET:
            return marks
        for point in np.unique(points[marks == UNMET]).tolist():
            c = chr(point)
            role = _ROLES.get(c, DIGIT if c.isdecimal() else LETTER if c.isalnum() else OTHER)
            case = UPPER if c.isupper() else LOWER if c.islower() or c.istitle() else 0
            folded = c.casefold()
            self.marks[point] = role | case | DIGITAL * c.isdigit() | UNFOLDS * (len(folded) > 1)
            self.values[point] = xxhash.xxh64_intdigest(folded.encode("utf-8", "surrogatepass"))
        return self.marks[points]

    def _weighted(self, points: np.ndarray) -> np.ndarray:
        """Each character's part of its word's hash."""
        if len(self.powers) <= len(points):
            n = max(2 * BLOCK, len(points)) + 1
            self.powers, self.inverses = (np.multiply.accumulate(np.where(np.arange(n) > 0, np.uint64(x), np.uint64(1))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.values[points] * self.powers[: len(points)]

    def _block(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First characters, ends, codes and traits of the tokens."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        marks = self._marks(points)
        roles = marks & np.uint8(ROLE)
        parted = np.ones(len(roles), bool)
        parted[1:] = (roles[1:] != roles[:-1]) | (roles[1:] >= APOSTROPHE)
        edges = np.append(np.flatnonzero(parted), len(roles))
        runs = roles[edges[:-1]]
        before, between, after = runs[:-2], runs[1:-1], runs[2:]
        joined = np.flatnonzero((before == DIGIT) & (after == DIGIT) & ((between == JOINT) | (between == STOP))) + 2
        words = np.flatnonzero((between == APOSTROPHE) & (before == LETTER) & (after == LETTER)) + 2
        if len(words):  # of apostrophes in a row every other joins
            i = np.arange(len(words))
            words = words[(i - np.maximum.accumulate(np.where(np.diff(words, prepend=-9) != 2, i, 0))) % 2 == 0]
            joined = np.sort(np.concatenate([joined, words]))
        begins = _BEGINS_TOKEN[runs]
        begins[joined] = begins[joined - 1] = False
        tokens = np.flatnonzero(begins)
        firsts, pasts = edges[tokens], edges[tokens + 1]
        pasts[np.searchsorted(tokens, joined) - 1] = edges[joined + 1]  # the last one holds

        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(self._weighted(points), out=sums[1:])
        codes = _mixed((sums[pasts] - sums[firsts]) * self.inverses[firsts])
        heads = marks[firsts]
        kinds = heads & np.uint8(ROLE)
        traits = np.where((kinds == STOP) | (kinds == END), IS_END, np.where(kinds == SIGN, IS_SIGN, np.where(heads & np.uint8(DIGITAL), IS_NUMBER, 0))).astype(np.uint8)
        upper = np.flatnonzero(heads & np.uint8(UPPER))
        lows = np.zeros(len(points) + 1, np.int32)
        np.cumsum((marks & np.uint8(LOWER)) > 0, out=lows[1:])
        traits[upper] |= np.where(lows[pasts[upper]] > lows[firsts[upper]], IS_UPPER | IS_CAPITAL, IS_UPPER).astype(np.uint8)
        for i in np.unique(np.searchsorted(firsts, np.flatnonzero(marks & np.uint8(UNFOLDS)), "right") - 1).tolist():
            folded = np.frombuffer(text[firsts[i] : pasts[i]].casefold().encode("utf-32-le"), np.uint32) if i >= 0 else ()
            if len(folded):
                self._marks(folded)
                codes[i] = _mixed(self._weighted(folded).sum(dtype=np.uint64, keepdims=True))[0]
        some = np.flatnonzero(self.maybe_special[codes & np.uint64(0xFFF)])
        place = np.searchsorted(self.special, codes[some])
        hit = place < len(self.special)
        some, place = some[hit], place[hit]
        hit = self.special[place] == codes[some]
        traits[some[hit]] |= self.special_traits[place[hit]]
        return firsts, pasts, codes, traits

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First characters of the tokens of all texts, each text after an end, and the text of each token."""
        texts = [t.replace("ß", "ss") for t in texts]  # the same words, and characters that fold one to one
        self.text = whole = "".join(f"\n{t}" for t in texts)
        found, a = [], 0
        while a < len(whole):
            parting = _PARTING.search(whole, a + BLOCK)
            b = parting.end() if parting else len(whole)
            firsts, pasts, codes, traits = self._block(whole[a:b])
            found.append((firsts + a, pasts + a, codes, traits))
            a = b
        if not found:
            self.clear()
            return self.firsts, self.firsts
        self.firsts, self.pasts, self.codes, self.traits = map(np.concatenate, zip(*found, strict=True))
        ends = np.cumsum([len(t) + 1 for t in texts])
        return self.firsts, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(self.firsts, ends), prepend=0))


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return hashes ^ (hashes >> np.uint64(29))


def _rolled(codes: np.ndarray, window: int) -> np.ndarray:
    """A hash of each ``window`` codes in a row, put together from those of 1, 2, 4 ... codes."""
    n = max(0, len(codes) - window + 1)
    out, done, part, size = np.zeros(n, np.uint64), 0, codes, 1
    while n:
        if window & size:
            out = out * np.uint64(pow(_BASE, size, 1 << 64)) + part[done : done + n] if done else part[:n]
            done += size
        if done == window:
            break
        part = part[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size:]
        size *= 2
    return out


class Template:
    """One reading of the tokens of some texts: kinds, codes, first token and text of each template token."""

    def __init__(self, kinds: np.ndarray, words: np.ndarray, tokens: np.ndarray, text: np.ndarray):
        self.kinds, self.tokens, self.text = kinds, tokens, text
        self.codes = np.where(kinds == WORD, words, _PLACEHOLDERS[kinds])
        self.firsts = np.searchsorted(text, np.arange(int(text[-1]) + 2 if len(text) else 1))  # where a text's tokens begin

    def windows(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the windows that lie in one text, their hashes, and how many words each has."""
        out = _rolled(self.codes, window)
        n = len(out)
        words = np.cumsum(np.concatenate([[0], self.kinds == WORD]))
        at = np.flatnonzero(self.text[:n] == self.text[window - 1 : window - 1 + n])
        return at, (out ^ (out >> np.uint64(29)))[at], (words[window:] - words[:-window])[:n][at]


def readings(firsts: np.ndarray, text: np.ndarray, known: Tokens) -> tuple[Template, Template, np.ndarray, np.ndarray]:
    """The template with names, the one without, which words of the first may be names that open a sentence, and where sentences begin in the second.

    A number followed by a unit, or a sign, gives a unit. A capitalised word is a name unless a sentence or a
    line begins with it or it is all capitals (shouted passages are read as words); names in a row are one
    name. Without names each of their words is a word.
    """
    traits, codes = known.traits, known.codes
    has = lambda bit: (traits & bit) > 0
    shifted = lambda x: np.concatenate([[False], x[:-1]])
    end = has(IS_END)
    begins = shifted(end)
    plain = np.where(has(IS_SIGN), MEASURE, np.where(has(IS_NUMBER), NUMERAL, WORD))
    plain[shifted((plain == NUMERAL) & ~end) & has(IS_UNIT) & (plain == WORD)] = MEASURE
    kinds = np.where((plain == WORD) & ~begins & has(IS_CAPITAL), PROPER, plain)
    opens = (kinds == WORD) & begins & has(IS_UPPER)
    named = (kinds == PROPER) & ~end
    typed, literal = np.flatnonzero(~end & ~(named & shifted(named))), np.flatnonzero(~end)
    return Template(kinds[typed], codes[typed], typed, text[typed]), Template(plain[literal], codes[literal], literal, text[literal]), opens[typed], begins[literal]


_KNOWN = Tokens()


def _values(template: Template, at: int, window: int, firsts: np.ndarray, known: Tokens) -> list[str]:
    """The window's placeholders in order, each with its kind's letter in front; a name has all its words."""
    out = []
    for i in range(at, at + window):
        kind = template.kinds[i]
        if kind == WORD:
            continue
        first = int(template.tokens[i])
        words = [known.lower(first)]
        if kind == PROPER:  # the words of a name stand side by side
            last = first + 1
            while last < len(firsts) and known.traits[last] & IS_CAPITAL and not known.traits[last] & (IS_END | IS_SIGN | IS_NUMBER):
                words.append(known.lower(last))
                last += 1
        out.append(_LETTERS[kind] + " ".join(words))
    return out


_WINDOWS = pa.schema([("key", pa.int64()), ("hash", pa.int64()), ("form", pa.int32()), ("place", pa.int32()), ("slots", pa.list_(pa.string())), ("tokens", pa.int32()), ("length", pa.int32()), ("text_hash", pa.int64())])
_DDL = "key long, hash long, form int, place int, slots array<string>, tokens int, length int, text_hash long"


class Filter:
    """Three bits for each hash; hashes that are not in it may pass, those that are always do."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, (64 * len(words)).bit_length() - 1

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that pass; a bit is looked up only where those before it are set."""
        mask = np.uint64((1 << self.bits) - 1)
        passed = np.arange(len(hashes))
        for place in (lambda h: h & mask, lambda h: h >> np.uint64(64 - self.bits), lambda h: h >> np.uint64(19) & mask):
            p = place(hashes[passed])
            passed = passed[(self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)]
        return passed


def _forms(texts: list[str], window: int, lengths: list[int], wanted: Filter | None, min_coverage: float) -> Iterator[tuple[int, int, int, int, list[str], int, int]]:
    """Text, hash, form, place, slots, tokens of the text's template and length of each window; only those that may be ``wanted``.

    Without a filter the texts are items. ``lengths``: those of short items, which documents are searched for
    sentence by sentence.
    """
    firsts, text = _KNOWN(texts)
    typed, literal, opens, begins = readings(firsts, text, _KNOWN)

    def rows(template: Template, form: int, at: np.ndarray, hashes: np.ndarray, length: int) -> Iterator[tuple]:
        if wanted is not None and len(at):
            passed = wanted(hashes)
            at, hashes = at[passed], hashes[passed]
        for place, h in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True):
            t = int(template.text[place])
            yield t, h, form, place - int(template.firsts[t]), _values(template, place, length, firsts, _KNOWN), int(template.firsts[t + 1] - template.firsts[t]), length

    least = min(MIN_LITERALS, window)
    at, hashes, words = typed.windows(window)
    yield from rows(typed, TYPED, at[words >= least], hashes[words >= least], window)
    if opens.any():
        opened = Template(np.where(opens, OPENER, typed.kinds), typed.codes, typed.tokens, typed.text)
        at, hashes, words = opened.windows(window)
        count = np.cumsum(np.concatenate([[0], opens]))
        fit = (words >= least) & (count[at + window] > count[at])
        yield from rows(opened, OPEN, at[fit], hashes[fit], window)
    at, hashes, words = literal.windows(window)
    yield from rows(literal, LITERAL, at[words >= least], hashes[words >= least] ^ FOLDED, window)
    whole = ~hashes
    if wanted is None:  # items: all windows of those whose windows with words enough cover too little, or that are shorter than one
        rim = np.zeros(len(literal.codes) + 1, np.int64)
        np.add.at(rim, at[words >= least], 1)
        np.add.at(rim, at[words >= least] + window, -1)
        covered = np.bincount(literal.text, np.cumsum(rim[:-1]) > 0)
        sizes = np.diff(literal.firsts)
        poor = (covered < min_coverage * sizes)[literal.text[at]]
        yield from rows(literal, WHOLE, at[poor], whole[poor], window)
        for length in np.unique(sizes[(sizes > 0) & (sizes < window)]).tolist():
            at, hashes, _ = literal.windows(length)
            yield from rows(literal, WHOLE, at[sizes[literal.text[at]] == length], ~hashes[sizes[literal.text[at]] == length], length)
        return
    yield from rows(literal, WHOLE, at, whole, window)
    ends = np.append(begins[1:], True)
    for length in lengths:
        at, hashes, _ = literal.windows(length)
        sentence = begins[at] & ends[at + length - 1]
        yield from rows(literal, WHOLE, at[sentence], ~hashes[sentence], length)


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``AT_ONCE`` tokens; a longer text is a run of its own."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text) // 4
        if size > AT_ONCE or i == len(texts) - 1:
            yield first, i + 1
            first, size = i + 1, 0


def _windows(rows: DataFrame, window: int, lengths: list[int], wanted: Filter | None, min_coverage: float) -> DataFrame:
    """Windows of (key, text, text_hash), or those that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = batch.column("key").to_pylist(), batch.column("text_hash").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out: list[tuple] = []
            for a, b in _parts(texts):
                for t, *fields in _forms(texts[a:b], window, lengths, wanted, min_coverage):
                    out.append((keys[a + t], *fields, hashes[a + t]))
                    if len(out) >= 10_000:
                        yield _batch(out)
                        out = []
            if out:
                yield _batch(out)
        _KNOWN.clear()
        give_back()

    return rows.mapInArrow(run, _DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _WINDOWS, strict=True)], schema=_WINDOWS)


def window_filter(windows: DataFrame) -> Filter:
    """The bit places of every hash, gathered as words of 64 bits: at most 16 MB reach the driver."""
    n = windows.count()
    bits = min(max((64 * n).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    mask = F.lit((1 << bits) - 1).cast("long")
    places = F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 64 - bits), F.shiftrightunsigned("hash", 19).bitwiseAND(mask))
    p = windows.select(F.explode(places).alias("p"))
    words = p.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return Filter(out.view(np.uint64))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, text_hash, item_id, coverage (share of the item's tokens), windows, reparameterised (some slot differs) and run (most tokens in a row), a row for each leak.

    Null and empty texts and items hold nothing. Items of fewer than ``window`` tokens are found where a
    document has them, with the same numbers, as whole sentences; items with too few words in all windows are
    found with the same numbers only. Rows repeated with the same id and text are one; an empty benchmark or
    table gives no row. Texts are read whole. No column but id and text is looked at, whatever its name.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("key"), "text", F.xxhash64("text").alias("text_hash"))
    wanted = staged(_windows(items, window, [], None, min_coverage), "benchmark-windows")
    lengths = sorted(r.length for r in wanted.filter(F.col("length") < window).select("length").distinct().collect())
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), "text", F.xxhash64("text").alias("text_hash"))
    found = staged(_windows(rows, window, lengths, window_filter(wanted), min_coverage).drop("tokens"), "candidate-windows")
    wanted = wanted.select(F.col("key").alias("item_id"), "hash", "form", "length", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), "tokens")
    hits = found.withColumnRenamed("key", "doc_id").join(wanted, ["hash", "form", "length"])
    hits = hits.filter(F.when(F.col("form") == WHOLE, F.col("slots") == F.col("item_slots")).otherwise(F.transform("slots", lambda s: F.substring(s, 1, 1)) == F.transform("item_slots", lambda s: F.substring(s, 1, 1))))
    pairs = F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc"))
    reading = F.when(F.col("form") == OPEN, TYPED).otherwise(F.col("form"))
    one = F.struct(F.col("item_place").alias("place"), (F.col("form") == OPEN).alias("opened"), pairs.alias("pairs"))
    aligned = hits.groupBy("doc_id", "text_hash", "item_id", reading.alias("reading"), "length", (F.col("place") - F.col("item_place")).alias("shift")).agg(F.collect_set(one).alias("all"), F.max("tokens").alias("tokens"))
    plain, values = F.filter("all", lambda x: ~x["opened"]), lambda xs: F.array_distinct(F.flatten(F.transform(xs, lambda x: x["pairs"])))
    one_to_one = lambda ps, side: F.size(F.array_distinct(F.transform(ps, lambda p: p[side]))) == F.size(ps)
    agree = lambda ps: one_to_one(ps, "item") & one_to_one(F.filter(ps, lambda p: F.startswith(p["item"], F.lit("p"))), "doc")
    # words that begin sentences are slots only as long as they agree
    kept = F.when(agree(values(F.col("all"))), F.col("all")).when(agree(values(plain)), plain).otherwise(F.slice("all", 1, 0))
    aligned = aligned.withColumn("kept", kept).withColumn("verbatim", F.filter("all", lambda x: F.forall(x["pairs"], lambda p: p["item"] == p["doc"])))
    aligned = aligned.withColumn("run", F.greatest(_longest_run("kept"), _longest_run("verbatim"))).filter((F.size("kept") > 0) | (F.col("run") >= MIN_RUN))
    forms = aligned.groupBy("doc_id", "text_hash", "item_id", "reading").agg(
        F.flatten(F.collect_list(F.transform("kept", lambda x: F.sequence(x["place"], x["place"] + F.col("length") - 1)))).alias("covered"), F.max("tokens").alias("tokens"), F.max("run").alias("run"),
        F.sum(F.greatest(F.size("kept"), F.size("verbatim"))).cast("long").alias("windows"), F.max(F.exists("kept", lambda x: F.exists(x["pairs"], lambda p: p["item"] != p["doc"]))).alias("reparameterised"),
    )
    forms = forms.withColumn("coverage", F.size(F.array_distinct(F.flatten("covered"))) / F.col("tokens"))
    forms = forms.filter(F.when(F.col("reading") == WHOLE, F.col("coverage") == 1).otherwise((F.col("coverage") >= min_coverage) | (F.col("run") >= MIN_RUN)))
    best = F.max(F.struct("coverage", (F.col("reading") != LITERAL).alias("typed"), "windows", "reparameterised", "run")).alias("best")
    return forms.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", "best.coverage", "best.windows", "best.reparameterised", "best.run")


def _longest_run(windows: str) -> Column:
    """Tokens in the longest row of ``windows`` (structs with ``place``) that touch or overlap."""
    places = F.array_sort(F.array_distinct(F.transform(windows, lambda x: x["place"])))
    start = lambda a, p: F.when(p <= a["upto"], a["start"]).otherwise(p)
    step = lambda a, p: F.struct(start(a, p).alias("start"), (p + F.col("length")).alias("upto"), F.greatest(a["best"], p + F.col("length") - start(a, p)).alias("best"))
    return F.aggregate(places, F.struct(F.lit(0).alias("start"), F.lit(-1).alias("upto"), F.lit(0).alias("best")), step, lambda a: a["best"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark).drop("text_hash")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    bad = staged(contaminated(docs, benchmark).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "contaminated")
    rows = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    same = (F.col("text_hash") == F.col("bad_hash")) & F.col("doc_id").eqNullSafe(F.col("bad_id"))
    return rows.join(bad, same, "left_anti").select("row.*")

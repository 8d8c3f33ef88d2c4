import random
import re
import time

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import decontaminate
from tests.llm.helpers import odd_documents, table

ITEM = "A train leaves the old station at 9 with 45 passengers and each passenger carries 3 heavy bags. How many bags does the train carry when it arrives in Berlin after 120 km?"
OTHER = "Yesterday morning. " + ITEM.replace("9", "7").replace("45", "52").replace("3 heavy", "4 heavy").replace("Berlin", "Paris").replace("120", "80") + " The answer is unknown."


def found(docs, items):
    return {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, items).collect()}


def test_copies_and_changed_parameters(spark):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Before. " + ITEM + " After."), (2, OTHER), (3, "A train leaves the old station."), (4, "45 passengers. 9 bags. " + ITEM[::-1]), (5, None), (6, ""), (7, "Nothing like it is in here, only birds and rivers and some long walks in the hills near the lake.")], "doc_id long, text string")
    got = found(docs, items)
    assert set(got) == {(1, 1), (2, 1)}
    assert not got[1, 1].reparameterised and got[2, 1].reparameterised


def test_slots_must_agree(spark):
    item = "If a farmer has 12 sheep and buys 7 sheep then sells 12 sheep to the market how many sheep remain with the farmer"
    fits, breaks = item.replace("12", "30").replace("7", "9"), item.replace("12", "30", 1).replace("12", "31").replace("7", "9")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = found(spark.createDataFrame([(1, fits), (2, breaks)], "doc_id long, text string"), items)
    assert set(got) == {(1, 1)}


def test_whole_copies_in_the_tables_are_found_and_few_others(spark):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    words = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    benchmark = {r.item_id: words(r.text) for r in items.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in benchmark.items() if len(t.split()) >= decontaminate.WINDOW and f" {t} " in f" {words(r.text)} "}
    got = found(docs, items)
    assert want and want <= set(got)
    leaking = {d for d, _ in got}
    kept = {r.doc_id for r in decontaminate.remove_contaminated(docs, items).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - leaking


def test_odd_documents(spark):
    docs, items = odd_documents(spark), table(spark, "benchmark")
    kept = decontaminate.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert decontaminate.leaks(docs, items.limit(0)).collect() == []
    assert decontaminate.remove_contaminated(docs.limit(0), items).collect() == []
    of_null = spark.createDataFrame([(None, ITEM), (None, "clean text")], "doc_id long, text string")
    assert [r.text for r in decontaminate.remove_contaminated(of_null, spark.createDataFrame([(None, ITEM)], "item_id long, text string")).collect()] == ["clean text"]


def test_letter_case_hides_nothing(spark):
    german = "Der Bauer bringt seine Kartoffeln mit dem Wagen nach Hamburg und verkauft dort jeden Sack auf dem Markt an die Frau des Lehrers aus Bremen"
    people = "Tom has 3 apples in a bag. Mary has 4 apples in a box. Peter has 5 apples on a tree. Susan has 6 apples in a jar."
    renamed = people.replace("Tom", "Ali").replace("Mary", "Nina").replace("Peter", "Igor").replace("Susan", "Wanda")
    items = spark.createDataFrame([(1, ITEM), (2, german), (3, people)], "item_id long, text string")
    texts = [t.replace("ß", "ss") for x in (ITEM, german, people) for t in (x.lower(), x.upper(), x.title())]
    docs = spark.createDataFrame([*enumerate(texts), (9, renamed), (10, people.replace("in a", "under the").replace("on a", "by his"))], "doc_id long, text string")
    got = found(docs, items)
    assert set(got) == {(i, i // 3 + 1) for i in range(9)} | {(9, 3)}
    assert got[9, 3].reparameterised and got[9, 3].coverage == 1 and not any(got[i, i // 3 + 1].reparameterised for i in range(9))


def test_short_items_and_items_of_numbers(spark):
    numbers = "1 + 2 = 3, 4 + 5 = 9, 6 + 7 = 13 and 8 + 9 = 17 sum"
    items = spark.createDataFrame([(1, "What is 12 times 9?"), (2, numbers), (3, "Yes.")], "item_id long, text string")
    docs = [(1, "A question: What is 12 times 9? Nobody knows."), (2, "what is 12 times 9"), (3, "What is 12 times 8?"), (4, "So what is 12 times 9 then"), (5, f"Sums: {numbers}"), (6, numbers.replace("13", "14")), (7, "no yes no"), (8, "no. yes! no")]
    assert set(found(spark.createDataFrame(docs, "doc_id long, text string"), items)) == {(1, 1), (2, 1), (5, 2), (8, 3)}


def test_long_runs_and_one_changed_number(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    item = " ".join(words[:60] + ["12", *words[60:90], "12", *words[90:200]])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [(1, "x " + " ".join(words[20:33]) + " y"), (2, "x " + " ".join(words[20:32]) + " y"), (3, item.replace("12", "13", 1)), (4, " ".join(words[200:]))]
    assert set(found(spark.createDataFrame(docs, "doc_id long, text string"), items)) == {(1, 1), (3, 1)}


def plain_template(text):
    """Kinds and values of the template with names, token by token."""
    kinds, values, begins, last = [], [], True, ""
    for token in re.findall(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['\u2019][^\W\d_]+)?|[.!?:\n]|[$\u20ac\u00a3%]", text):
        if token in ".!?:\n":
            begins, last = True, ""
            continue
        low = token.casefold()
        if token in "$\u20ac\u00a3%":
            kind = "u"
        elif token[0].isdigit() or low in decontaminate.NUMBER_WORDS:
            kind = "n"
        elif last == "n" and low in decontaminate.UNITS:
            kind = "u"
        else:
            kind = "p" if not begins and token[0].isupper() and not token.isupper() else "w"
        if kind == last == "p":
            values[-1] += " " + low
        else:
            kinds.append(kind)
            values.append(low)
        begins, last = False, kind
    return kinds, values


@given(st.lists(st.lists(st.sampled_from(["a", "Tom", "Ann", "USA", "12", "km", "three", ".", ":", "$", "\n", "Haus", "it's", "m"]), max_size=25).map(" ".join), min_size=1, max_size=4))
def test_templates_against_a_plain_reading(texts):
    known = decontaminate.Tokens()
    numbers, text = known(texts)
    typed = decontaminate.readings(numbers, text, known)[0]
    for i, t in enumerate(texts):
        kinds, values = plain_template(t)
        at = np.flatnonzero(typed.text == i)
        assert "".join("wnpu"[k] for k in typed.kinds[at]) == "".join(kinds)
        slots = [v for a in at for v in decontaminate._values(typed, int(a), 1, numbers, known)]
        assert slots == [k + v for k, v in zip(kinds, values, strict=True) if k != "w"]


TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['\u2019][^\W\d_]+)?|[.!?:\n]|[$\u20ac\u00a3%]")


def plain_traits(token):
    low = token.casefold()
    out = decontaminate.IS_END * (token in ".!?:\n") | decontaminate.IS_SIGN * (token in "$\u20ac\u00a3%") | decontaminate.IS_UNIT * (low in decontaminate.UNITS)
    out |= decontaminate.IS_NUMBER * (low in decontaminate.NUMBER_WORDS or token[0].isdigit())
    return out | (token[0].isupper() and (decontaminate.IS_UPPER if token.isupper() else decontaminate.IS_UPPER | decontaminate.IS_CAPITAL))


def test_tokens_against_a_plain_pattern(monkeypatch):
    odd = list("aBß\u1e9e\u0130\ufb01\u0149\u01c4\u01c5²½\u2167\u0663\u03a3\u03c2中\u0307\u00a0\U0001f600\U0001d400\u0390ªÉ12.,:/'’\n _$€!?%\t\r-") + ["km", "Three", " ", "'", "."]
    rng, known, codes = random.Random(5), decontaminate.Tokens(), {}
    for block in (decontaminate.BLOCK, 7):  # whole texts, and texts looked at in parts
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        for _ in range(1500):
            texts = ["".join(rng.choices(odd, k=rng.randrange(40))) for _ in range(rng.randrange(1, 4))]
            _, text = known(texts)
            want = [(i, token) for i, t in enumerate(texts) for token in ["\n", *TOKEN.findall(t)]]
            assert text.tolist() == [i for i, _ in want]
            assert [known.lower(i) for i in range(len(want))] == [token.casefold() for _, token in want]
            assert known.traits.tolist() == [plain_traits(token) for _, token in want]
            for (_, token), code in zip(want, known.codes.tolist(), strict=True):
                assert codes.setdefault(token.casefold(), code) == code
    assert len(set(codes.values())) == len(codes)


def test_windows_are_hashed_alike_however_long():
    codes = np.array([random.Random(7).getrandbits(64) for _ in range(40)], np.uint64)
    for window in (1, 2, 3, 5, 7, 8, 13, 40, 41):
        want = [sum(int(c) * pow(decontaminate._BASE, window - 1 - j, 1 << 64) for j, c in enumerate(codes[i : i + window])) % (1 << 64) for i in range(41 - window)]
        assert decontaminate._rolled(codes, window).tolist() == want


def test_the_scan_costs_little_more_than_a_plain_search_for_tokens(spark):
    """2.5 to 3.7 times as much where each token was an object of Python, 0.6 to 0.8 now; measured side by side, so that the machine does not count."""
    texts = [r.text or "" for r in table(spark, "documents").select("text").collect()]
    nothing = decontaminate.Filter(np.zeros(1 << 10, np.uint64))

    def scan():
        decontaminate._KNOWN.clear()
        for a, b in decontaminate._parts(texts):
            assert not list(decontaminate._forms(texts[a:b], decontaminate.WINDOW, [], nothing, decontaminate.MIN_COVERAGE))

    def seconds(run):
        start = time.process_time()
        run()
        return time.process_time() - start

    assert min(seconds(scan) for _ in range(3)) < 1.3 * min(seconds(lambda: [TOKEN.findall(t) for t in texts]) for _ in range(3))

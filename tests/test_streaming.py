"""Streams give what the same functions give on a batch."""

import datetime

import pytest

from tessera.streaming import events, logs, totals, upsert

SF = "/root/testdata/sf0.001"


def test_stream_of_files_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = events.once_each(events.tail(spark, str(tmp_path / "in"), files_per_batch=1), watermark="30 days")
    events.write_available(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == batch.count()
    assert events.tumbling(out).exceptAll(events.tumbling(batch)).count() == 0


VINTAGE = "series_key string, territory_code string, year long, edition long, value double"


def observed(spark, path):
    return {(r.territory_code, r.year): (r.edition, r.value) for r in upsert.read_observations(spark, path).collect()}


def test_upsert_keeps_the_latest_edition_with_a_value(spark, tmp_path):
    rows = [("s", "a", 1, 1, 1.0), ("s", "a", 1, 2, 2.0), ("s", "a", 1, 3, None), ("s", "b", 1, 1, None)]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], VINTAGE).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    stream = spark.readStream.schema(VINTAGE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upsert.upsert_vintages(stream, str(tmp_path / "out"), str(tmp_path / "ck"), 4).awaitTermination(180)
    assert observed(spark, str(tmp_path / "out")) == {("a", 1): (2, 2.0), ("b", 1): (1, None)}
    assert spark.read.parquet(str(tmp_path / "out/vintage")).count() == 4


def test_upsert_survives_failures_and_reads_no_history(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    batch = lambda *rows: spark.createDataFrame(list(rows), VINTAGE)
    assert observed(spark, path) == {}
    upsert.apply_batch(batch(*[("s", f"t{i}", y, 1, float(i)) for i in range(40) for y in (1, 2)]), 0, path, 8)
    before = observed(spark, path)
    late = batch(("s", "t3", 1, 2, 33.0), ("s", "t4", 2, 2, None))
    monkeypatch.setattr(upsert, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        upsert.apply_batch(late, 1, path, 8)
    assert observed(spark, path) == before  # readers see the state before
    monkeypatch.undo()
    upsert.apply_batch(late, 1, path, 8)
    upsert.apply_batch(late, 1, path, 8)  # run again after it was done
    assert observed(spark, path) == before | {("t3", 1): (2, 33.0)}
    counts = [len(upsert.apply_batch(batch(("s", "t3", 1, n, float(n))), n, path, 8)) for n in range(3, 7)]
    assert counts == [1, 1, 1, 1]  # the bucket of the key, however long the history
    versions = upsert.latest_manifest(spark, path)[1]
    assert upsert.forget_old_versions(spark, path) > 0
    assert upsert.latest_manifest(spark, path)[1] == versions and observed(spark, path)[("t3", 1)] == (6, 6.0)


def days_of_events(spark):
    """Events of two types over two months with a missing day, repeated deliveries, and one that comes far too late."""
    at = lambda month, day, hour: datetime.datetime(2001, month, day, hour)
    rows, n = [], 0
    for kind in ("click", "view"):
        for month, days in ((1, (3, 4, 5, 8, 9)), (2, range(1, 7))):
            for day in days:
                if (kind, month, day) == ("view", 2, 4):
                    continue
                for hour in (1, 9, 20):
                    n += 1
                    rows.append((n, at(month, day, hour), kind, n / 4))
    rows.sort(key=lambda r: r[1])
    return rows


EVENTS = "event_id long, ts timestamp, event_type string, value double"


def write_batches(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/p{i:03d}")
    return spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_running_totals_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rows = days_of_events(spark)
    batches = [rows[i : i + 7] + rows[max(0, i - 3) : i] for i in range(0, len(rows), 7)]  # some come again in the next batch
    late = (9_999, datetime.datetime(2001, 1, 3, 5), "click", 1e6)
    end = [(10_000 + i, datetime.datetime(2001, 3, 1 + i), "end", 0.0) for i in range(3)]
    stream = write_batches(spark, tmp_path / "in", [*batches, [late], end[:1], end[1:2], end[2:]])
    days = totals.daily_totals(stream, "1 day")
    events.write_available(days, str(tmp_path / "days"), str(tmp_path / "ck1")).awaitTermination(300)
    kinds = spark.read.parquet(str(tmp_path / "days")).schema
    second = spark.readStream.schema(kinds).parquet(str(tmp_path / "days"))
    events.write_available(totals.running_totals(second), str(tmp_path / "totals"), str(tmp_path / "ck2")).awaitTermination(300)
    pick = lambda frame: sorted(tuple(r) for r in frame.filter("event_type <> 'end'").select("event_type", "month", "day", "total").collect())
    batch = totals.daily_totals(spark.createDataFrame(rows, EVENTS), "1 day")
    got, want = pick(spark.read.parquet(str(tmp_path / "totals"))), pick(totals.running_totals_of(batch))
    assert got == want
    assert {(t, d) for t, m, d, _ in want if m.month == 1} == {(t, d) for t in ("click", "view") for d in (3, 4, 5)}
    assert ("view", 3) in {(t, d) for t, m, d, _ in want if m.month == 2} and ("view", 5) not in {(t, d) for t, m, d, _ in want if m.month == 2}


def test_periods_are_preliminary_until_the_watermark_passes(spark, tmp_path):
    rows = [r for r in days_of_events(spark) if r[1].month == 2]
    batches = [rows[:9] + rows[:2], rows[9:20] + rows[5:9], rows[20:], [(500, datetime.datetime(2001, 2, 1, 3), "click", 1e6)]]
    stream = totals.periods(write_batches(spark, tmp_path / "in", batches), "1 day")
    totals.write_periods(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(300)
    found = {(r.event_type, r.start.day): (r.total, r.preliminary) for r in totals.last_of_periods(spark.read.parquet(str(tmp_path / "out"))).collect()}
    want: dict = {}
    for _, ts, kind, value in rows:
        want[kind, ts.day] = want.get((kind, ts.day), 0) + value
    assert {k: v[0] for k, v in found.items()} == pytest.approx(want)
    assert {d for (_, d), (_, open_) in found.items() if open_} == {5, 6}  # the watermark stands a day before the last event


def test_tail_of_logs_takes_whole_lines_once(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    line = lambda i, month=5: f"2001-{month:02d}-06T07:{i // 60:02d}:{i % 60:02d} 10.0.0.{i % 7} /page/{i}é 200\n"

    def run():
        out = logs.visits(logs.tail_logs(spark, f"file://{folder}", range_bytes=300))
        events.write_available(out, str(tmp_path / "out"), str(tmp_path / "ck"), "month").awaitTermination(180)
        return spark.read.parquet(str(tmp_path / "out"))

    text = "".join(map(line, range(100)))
    cut = len(text.encode()) - 20
    (folder / "a.log").write_bytes(text.encode()[:cut])
    (folder / "b.txt").write_text("not a log\n")
    assert run().count() == 99  # the last line is not whole yet
    (folder / "a.log").write_bytes(text.encode() + line(100, 6).encode())
    (folder / "b.log").write_text("no visit\r\n" + line(101, 6))
    rows = run()
    assert sorted(int(r.page.split("/")[2][:-1]) for r in rows.collect()) == list(range(102))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("month")) == ["month=2001-05", "month=2001-06"]
    (folder / "a.log").write_text("".join(line(i, 7) for i in range(200, 203)))  # replaced by another file
    assert run().filter("month = '2001-07'").count() == 3
    assert run().count() == 105

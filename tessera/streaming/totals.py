"""Running totals and open periods on streams: days are summed by Spark's own windows, small states follow them.

``daily_totals`` drops repeated events and closes a day when the watermark has passed it, so that events later than the
watermark change nothing. ``running_totals`` holds three numbers for each key and month. ``periods`` holds one
sum for each key and period and says the period is preliminary until the watermark closes it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_totals(events: DataFrame, watermark: str, by: Sequence[str] = ("event_type",)) -> DataFrame:
    """by, day (a timestamp) and value of each day that is over; of events with one event_id within the watermark one counts. Also of a batch, where all days are over."""
    rows = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    days = rows.groupBy(F.window("ts", "1 day").alias("w"), *by).agg(F.sum("value").alias("value"))
    return days.select(*by, F.col("w.start").alias("day"), "value")


def _types(frame: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"{n} {frame.schema[n].dataType.simpleString()}" for n in names)


def running_totals(days: DataFrame, by: Sequence[str] = ("event_type",)) -> DataFrame:
    """by, month, day (of the month) and total of a stream of days, in order of closing: the month's total from its first day on, until the first day is missing."""

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, total, broken = state.get if state.exists else (0, 0.0, False)
        rows = pd.concat(list(frames)).sort_values("day")
        out: list[tuple[int, float]] = []
        for day, value in zip(rows["day"].dt.day.tolist(), rows["value"].tolist(), strict=True):
            broken = broken or (last != 0 and day != last + 1)
            if broken:
                break
            last, total = day, total + value
            out.append((last, round(total, 4)))
        state.update((last, total, broken))
        if out:
            yield pd.DataFrame({**{n: [k] * len(out) for n, k in zip((*by, "month"), key, strict=True)}, "day": [d for d, _ in out], "total": [t for _, t in out]})

    keyed = days.withColumn("month", F.date_trunc("month", "day"))
    schema = f"{_types(keyed, (*by, 'month'))}, day long, total double"
    return keyed.groupBy(*by, "month").applyInPandasWithState(follow, schema, "last int, total double, broken boolean", "append", GroupStateTimeout.NoTimeout)


def running_totals_of(days: DataFrame, by: Sequence[str] = ("event_type",)) -> DataFrame:
    """The same of a batch of days."""
    from pyspark.sql import Window

    month = Window.partitionBy(*by, "month")
    upto = month.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = days.select(*by, F.date_trunc("month", "day").alias("month"), F.dayofmonth("day").cast("long").alias("day"), "value")
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(upto), "first": F.min("day").over(month), "total": F.round(F.sum("value").over(upto), 4)})
    return rows.filter("n = day - first + 1").select(*by, "month", "day", "total")


def periods(events: DataFrame, watermark: str, by: Sequence[str] = ("event_type",), width: str = "1 day") -> DataFrame:
    """by, start, total and preliminary of a stream: a row whenever a period has grown, and one, not preliminary, when the watermark has closed it. Events of closed periods and repeated event_ids of open ones change nothing."""

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        one = lambda total, open_: pd.DataFrame({**{n: [k] for n, k in zip(by, key, strict=False)}, "start": [key[len(by)]], "total": [round(total, 4)], "preliminary": [open_]})
        if state.hasTimedOut:
            total = state.get[0]
            state.remove()
            yield one(total, False)
            return
        total, seen = (state.get[0], set(state.get[1])) if state.exists else (0.0, set())
        end = int(key[len(by) + 1].timestamp() * 1000)
        if end <= state.getCurrentWatermarkMs():
            return  # closed before: too late
        for frame in frames:
            for event, value in zip(frame["event_id"].tolist(), frame["value"].tolist(), strict=True):
                if event not in seen:
                    seen.add(event)
                    total += value
        state.update((total, sorted(seen)))
        state.setTimeoutTimestamp(end)
        yield one(total, True)

    rows = events.withWatermark("ts", watermark).withColumn("w", F.window("ts", width)).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "ts", "event_id", "value")
    schema = f"{_types(rows, by)}, start timestamp, total double, preliminary boolean".removeprefix(", ")
    return rows.groupBy(*by, "start", "end").applyInPandasWithState(follow, schema, "total double, seen array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def last_of_periods(rows: DataFrame, by: Sequence[str] = ("event_type",)) -> DataFrame:
    """Of what ``periods`` has written, the state of each period: a closed row, else the largest count so far is unknown to a reader, so the last total that any open row has is kept by the writer's order ``batch``."""
    best = F.max(F.struct((~F.col("preliminary")).alias("closed"), "batch", "total")).alias("b")
    return rows.groupBy(*by, "start").agg(best).select(*by, "start", "b.total", (~F.col("b.closed")).alias("preliminary"))


def write_periods(stream: DataFrame, path: str, checkpoint: str):
    """Append the rows of ``periods`` with the number of their batch; a batch that is run again replaces its folder."""
    write = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

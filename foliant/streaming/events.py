"""The event log as a stream: what the reports over it compute, kept up as events arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.operators.cast import AGAIN, DAY, EASIEST, HARDEST, START_EASE

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """A folder of event files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without repeats of their natural key; the state is bounded by how late an event may be."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type", "ts"])


def daily_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, event_type, n, total) by day of the event, emitted when a day is over."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type")
    return days.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("day"), "event_type", "n", "total")


def latest(events: DataFrame) -> DataFrame:
    """The newest event of each user, for output mode update or complete."""
    return events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x")).select("user_id", "x.ts", "x.event_id", "x.event_type")


#: Users whose answers are folded in one call and whose cards are one state: those of neighbouring ids, so many at most.
USERS = 32
STATE = "user_id array<long>, event_type array<string>, reps array<long>, lapses array<long>, ease array<double>, days array<long>"
OUT = "user_id long, event_type string, reps long, lapses long, ease double, interval_days long, due_at long, last_at long"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    users, types, *known = state.get if state.exists else [[]] * 6
    cards = dict(zip(zip(users, types), zip(*known)))
    rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
    seen = {}
    for user, kind, at, ok in zip(rows["user"], rows["event_type"], rows["at"].astype(int), rows["ok"]):
        card = None if user is None else int(user), kind
        reps, lapses, ease, days = cards.get(card, (0, 0, START_EASE, 0))
        if ok:
            reps += 1
            days = 1 if reps == 1 else 6 if reps == 2 else max(1, int(days * ease + 0.5))
            ease, due = min(EASIEST, ease + 0.1), at + days * DAY
        else:
            reps, lapses, days = 0, lapses + 1, 0
            ease, due = max(HARDEST, ease - 0.2), at + AGAIN
        cards[card], seen[card] = (reps, lapses, ease, days), (due, at)
    state.update((*map(list, zip(*cards)), *map(list, zip(*cards.values()))))
    out = ((*card, reps, lapses, round(ease, 6), days, *seen[card]) for card in seen for reps, lapses, ease, days in [cards[card]])
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"user_id": "Int64"})


def schedules(events: DataFrame, right_over: float = 20.0) -> DataFrame:
    """The study schedule of each user and type after the answers so far; answers of a batch are put in order.

    A group costs far more than an answer, so some users share one; rows are those of users and types that have answered.
    """
    rows = events.select(F.col("user_id").cast("string").alias("user"), "event_type", F.unix_millis("ts").alias("at"), "event_id", (F.col("value") > right_over).alias("ok"), F.floor(F.col("user_id") / USERS).alias("users"))
    return rows.groupBy("users").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)

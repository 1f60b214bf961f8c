"""Presence of users and the gate on scheduled work: in batch, and as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.lookups import numbered


def last_state(events: DataFrame) -> DataFrame:
    """user, online, moment: each user's newest state since the last reset.

    `events` has moment (ordered), user, change: joined, left or reset (then user is null).  A user who left
    without having joined is unknown.
    """
    reset = events.where("change = 'reset'").agg(F.coalesce(F.max("moment"), F.lit(-1)).alias("reset"))
    since = events.where("change <> 'reset'").join(F.broadcast(reset), how="cross").where("moment > reset")
    states = since.groupBy("user").agg(F.max_by("change", "moment").alias("change"), F.max("moment").alias("moment"), F.count_if(F.col("change") == "joined").alias("joins"))
    return states.where("joins > 0").select("user", (F.col("change") == "joined").alias("online"), "moment")


def gate(states: DataFrame, blacklist: str = "") -> DataFrame:
    """records, has_valid, has_valid_online: whether anybody valid was there since the last check."""
    valid = ~F.lower(F.col("user").cast("string")).rlike(f"(?i)^(?:{blacklist})$") if blacklist else F.lit(True)
    return states.agg(F.count("*").alias("records"), F.coalesce(F.bool_or(valid), F.lit(False)).alias("has_valid"), F.coalesce(F.bool_or(valid & F.col("online")), F.lit(False)).alias("has_valid_online"))


def gaps(runs: DataFrame, least: int) -> DataFrame:
    """moment, gap: pauses of at least `least` between neighbouring runs."""
    placed = numbered(runs.select("moment"), ["moment"], "place")
    before = placed.select((F.col("place") + 1).alias("place"), F.col("moment").alias("before"))
    return placed.join(before, "place").select("moment", (F.col("moment") - F.col("before")).alias("gap")).where(F.col("gap") >= least)


#: Seconds before each retry.
BACKOFF = (0, 10, 60, 300)


def backoff(interval: int, steps: tuple[int, ...] = BACKOFF, share: float = 0.2) -> list[int]:
    """Waits before each retry, as long as their sum stays within a share of the interval."""
    out: list[int] = []
    for step in steps:
        if sum(out) + step > interval * share:
            break
        out.append(step)
    return out


def backoff_sum(interval: Column, steps: tuple[int, ...] = BACKOFF, share: float = 0.2) -> Column:
    """The sum of the waits of `backoff`, as a column."""
    sums = list(accumulate(steps))
    fits = F.filter(F.array(*map(F.lit, sums)), lambda x: x <= interval * share)
    return F.coalesce(F.array_max(fits), F.lit(0)).cast("long")


def stream_states(events: DataFrame, users: list[str] | None = None) -> DataFrame:
    """A streaming frame of user, online, moment whenever a user's state changes; `events` has user, change, moment.

    A reset (user null) makes every user unknown: it is dealt to all `users` that may have a state (given, as a
    stream cannot list them), who are forgotten and must join again; without `users` resets are left out.
    """
    if users:
        everyone = F.when(F.col("change") == "reset", F.array(*map(F.lit, users))).otherwise(F.array(F.col("user").cast("string")))
        events = events.select(F.explode(everyone).alias("user"), "change", "moment")
    else:
        events = events.where("change <> 'reset'")

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        known, online, newest = state.get if state.exists else (False, False, -1)
        rows = []
        for frame in frames:
            for change, at in frame.sort_values("moment")[["change", "moment"]].itertuples(index=False):
                if at <= newest:
                    continue
                if change == "reset":
                    known, online, newest = False, False, at
                elif change == "joined" or known:
                    known, online, newest = True, change == "joined", at
                    rows.append((key[0], online, at))
        state.update((known, online, newest))
        if rows:
            yield pd.DataFrame(rows, columns=["user", "online", "moment"])

    return events.groupBy("user").applyInPandasWithState(update, "user string, online boolean, moment long", "known boolean, online boolean, newest long", "append", "NoTimeout")

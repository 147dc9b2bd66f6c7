"""Streams of observations: running opinions, windows with late data, content that expires.

These extend the batch operators; a run over all input gives the batch result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from agora.operators.opinions import precisions


def sums(stream: DataFrame, profile: DataFrame, keys: list[str]) -> DataFrame:
    """Running n, sum of w, w x and w x x by keys: all that means and variances need."""
    rows = stream.where("value is not null").join(F.broadcast(precisions(profile)), ["classifier_idx", "value"])  # nine rows for each classifier
    w, x = F.col("w"), F.col("value").cast("double")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(w * x).alias("swx"), F.sum(w * x * x).alias("swxx"))


def opinion_of_sums(rows: DataFrame) -> DataFrame:
    mean = F.try_divide(F.col("swx"), F.col("sw"))
    var = (F.try_divide(F.col("swxx"), F.col("sw")) - mean * mean) * F.col("n") / F.when(F.col("n") > 1, F.col("n") - 1)
    return rows.withColumn("mean", mean).withColumn("var", F.when(F.col("n") > 1, var)).drop("sw", "swx", "swxx")


def windowed_sums(stream: DataFrame, profile: DataFrame, time: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Half-open windows, closed once the watermark has passed them."""
    return sums(stream.withWatermark(time, late).withColumn("window", F.window(time, width)), profile, ["window", *keys])


def run_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """All input that is there, in batches, to a Parquet folder; in complete mode the last result replaces the one before."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def last_seen(stream: DataFrame, user: str = "user_id", t: str = "t", lifetime: int = 10) -> DataFrame:
    """(user, t, live): on each batch the times of a user's content not older than `lifetime` before the newest; older ones leave the state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        for batch in batches:
            times += batch[t].tolist()
        newest = max(times)
        times = sorted(x for x in times if x > newest - lifetime)
        state.update((times,))
        yield pd.DataFrame({user: [key[0]], t: [newest], "live": [len(times)]})

    return stream.groupBy(user).applyInPandasWithState(step, f"{user} long, {t} long, live long", "times array<long>", "update", GroupStateTimeout.NoTimeout)


def live_content(stream: DataFrame, user: str, time: str, lifetime: int, late: str) -> DataFrame:
    """(user, at, live): how many rows of a user are not older than `lifetime` seconds, whenever that changes by new rows or by the clock.

    The clock is the watermark, `late` behind the newest row of all users. The state counts
    a user's rows by second, no more than lifetime / 1 numbers whatever a user writes; what
    has expired leaves it. When the watermark passes the oldest second that counts, the user
    is told anew, and a user with nothing left has no state. Rows behind the watermark
    are too late and go; the time in `at` is the newest row's, or the watermark's.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock = state.getCurrentWatermarkMs() // 1000
        seconds, counts = state.get if state.exists else ([], [])
        held = dict(zip(seconds, counts, strict=True))
        newest = max(held, default=clock)
        if not state.hasTimedOut:
            for batch in batches:
                for second, n in batch["_second"].value_counts().items():
                    held[int(second)] = held.get(int(second), 0) + int(n)
            newest = max(held, default=clock)
        at = max(clock, newest)
        held = {second: n for second, n in sorted(held.items()) if second > at - lifetime}
        if held:
            state.update((list(held), list(held.values())))
            state.setTimeoutTimestamp(max((min(held) + lifetime) * 1000, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        yield pd.DataFrame({user: [key[0]], "at": [at], "live": [sum(held.values())]})

    rows = stream.where(F.col(time).isNotNull()).withWatermark(time, late).select(user, time, F.unix_seconds(time).alias("_second"))
    kind = dict(stream.dtypes)[user]
    return rows.groupBy(user).applyInPandasWithState(step, f"{user} {kind}, at long, live long", "seconds array<long>, counts array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def sessions(stream: DataFrame, user: str, time: str, gap: str, late: str, *sums: Column) -> DataFrame:
    """(user, start, end, n, sums): runs of a user's rows with less than `gap` between them, told once the watermark has passed their end.

    end is the last row's time and the gap. A session is one row of sums in the state,
    however long; it leaves the state when it is told.
    """
    rows = stream.withWatermark(time, late).groupBy(user, F.session_window(time, gap).alias("session")).agg(F.count(F.lit(1)).alias("n"), *sums)
    return rows.withColumn("start", F.col("session.start")).withColumn("end", F.col("session.end")).drop("session")


def trailing(content: DataFrame, asks: DataFrame, keys: list[str], time: str, at: str, span: str, late: str) -> DataFrame:
    """asks with each row of content of the same keys in the `span` up to it, both ends included, from two streams.

    Both streams have a watermark, so Spark drops content from its state once no ask that
    is not too late can be in reach of it. Columns other than the keys differ in name.
    """
    left, right = asks.withWatermark(at, late).alias("asks"), content.withWatermark(time, late).alias("content")
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"asks.{k}") == F.col(f"content.{k}")
    near = (F.col(time) <= F.col(at)) & (F.col(time) >= F.col(at) - F.expr(f"interval {span}"))
    return left.join(right, same & near).select("asks.*", *[F.col(f"content.`{c}`") for c in content.columns if c not in keys])

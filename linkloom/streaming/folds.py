"""Keyed folds over streams, windows with late data, and the message log as a stream."""

from __future__ import annotations

import base64
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linkloom.operators.folds import BOX, Tracker


def keyed_fold(stream: DataFrame, keys: list[str], order: list[str], step: Callable[[dict, pd.DataFrame], tuple[dict, pd.DataFrame]], output: T.StructType, *, idle_ms: int | None = None) -> DataFrame:
    """Fold each key's rows in order across micro-batches; the state is a dictionary that ``step`` returns.

    Rows of a key must arrive in order from batch to batch; inside a batch they are sorted. A batch gives the same rows as
    the fold over all data. With idle_ms the state of a key that has had no rows for so long is forgotten; without, it is
    kept for good.
    """

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = pickle.loads(base64.b64decode(state.get[0])) if state.exists else {}
        held, out = step(held, pd.concat(list(parts)).sort_values(order))
        state.update((base64.b64encode(pickle.dumps(held)).decode(),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield out

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy(*keys).applyInPandasWithState(run, output, "state string", "append", timeout)


def track_stream(boxes: DataFrame, keys: list[str], *, threshold: float = 0.3, max_missed: int = 2, min_length: int = 2, idle_ms: int | None = None) -> DataFrame:
    """Streaming form of the greedy tracker: the boxes with their track number, of tracks of min_length boxes or more.

    The first boxes of a track wait in the state until it is long enough, so the rows are those of the batch form. A frame
    of the video without boxes of the key counts as missed by the gap in the numbers.
    """

    def step(held: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        tracker, last, tracks = Tracker(threshold, max_missed, held.get("tracker")), held.get("last"), []
        for frame, part in rows.groupby("frame", sort=True):
            for _ in range(min(int(frame - last - 1), max_missed + 1) if last is not None else 0):
                tracker.step([])
            tracks += tracker.step(part[BOX].to_numpy(float).tolist())
            last = int(frame)
        rows = rows.assign(track=pd.Series(tracks, index=rows.index, dtype="int64"))
        waiting = pd.concat([held["waiting"], rows]) if held.get("waiting") is not None else rows
        out_already = held.get("long", set())
        long = out_already | {t for t, n in waiting["track"].value_counts().items() if n >= min_length}
        ready = waiting["track"].isin(long)
        open_ = set(tracker.tracks)
        wait = waiting[~ready & waiting["track"].isin(open_)]
        return {"tracker": tracker.state(), "last": last, "waiting": wait, "long": long & open_}, waiting[ready]

    schema = T.StructType([*boxes.schema.fields, T.StructField("track", T.LongType())])
    return keyed_fold(boxes, keys, ["frame", "id"], step, schema, idle_ms=idle_ms)


def drop_stationary(frames: DataFrame, key: str, order: str, value: str, least_change: float) -> DataFrame:
    """Frames that differ from the last kept one of their key by at least least_change; the first one is kept."""

    def step(held: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        last, keep = held.get("last"), []
        for x in rows[value]:
            moved = last is None or abs(x - last) >= least_change
            keep.append(moved)
            last = float(x) if moved else last
        return {"last": last}, rows[keep]

    return keyed_fold(frames, [key], [order], step, frames.schema)


def windowed_counts(events: DataFrame, ts: str, by: str, value: str, *, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Counts and sums per window; rows later than the delay are dropped, state older than it is released."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return timed.groupBy(F.window("_ts", window).alias("w"), F.col(by)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def first_deliveries(log: DataFrame, message_id: str, received_at: str, delay: str = "30 days") -> DataFrame:
    """The stream without repeated deliveries of a message; ids are forgotten once the watermark has passed them."""
    return log.withColumn("_ts", F.col(received_at).cast("timestamp")).withWatermark("_ts", delay).dropDuplicatesWithinWatermark([message_id]).drop("_ts")

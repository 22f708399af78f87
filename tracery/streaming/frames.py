"""Frames of a trace as it arrives: a call stack per thread, kept as streaming state.

The batch operators see a whole thread; a stream sees it row by row.  A row of the
method on top of the stack goes on there; a row of a method deeper in the stack pops
to it; any other row pushes a frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracery.sources.traces import MARK

OUT = "thread_id long, pos long, method string, frame_id long, caller_pos long, depth int"
STATE = "methods array<string>, frames array<long>, lasts array<long>"


def step(methods: list, frames: list, lasts: list, pos: int, method: str) -> tuple[int, int, int]:
    """Advance one thread's stack by a row; returns the row's frame, its caller's position (its own frame if none), its depth."""
    if method in methods:
        while methods[-1] != method:
            methods.pop(), frames.pop(), lasts.pop()
    else:
        methods.append(method), frames.append(pos), lasts.append(pos)
    lasts[-1] = pos
    return frames[-1], lasts[-2] if len(lasts) > 1 else frames[0], len(frames)


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    methods, frames, lasts = (list(x) for x in state.get) if state.exists else ([], [], [])
    rows = pd.concat(list(batches)).sort_values("pos", kind="stable")
    out = []
    for pos, method in zip(rows["pos"].tolist(), rows["method"].tolist(), strict=True):
        frame, caller, depth = step(methods, frames, lasts, pos, method)
        out.append((key[0], pos, method, frame, caller, depth))
    state.update((methods, frames, lasts))
    yield pd.DataFrame(out, columns=["thread_id", "pos", "method", "frame_id", "caller_pos", "depth"])


def stream_frames(rows: DataFrame) -> DataFrame:
    """Frames of a stream of (thread_id, pos, method); rows of a thread arrive in the order of their positions."""
    keyed = rows.select(F.col("thread_id").cast("long").alias("thread_id"), F.col("pos").cast("long").alias("pos"), "method").groupBy("thread_id")
    return keyed.applyInPandasWithState(_advance, OUT, STATE, "append", "NoTimeout")


def read_trace_stream(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): marked lines of trace files as they appear in a folder."""
    lines = spark.readStream.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.where(F.col("value").contains(MARK))


def count_by_method(rows: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, method, n): rows of a stream (ts, method) by time window, late rows up to a limit."""
    timed = rows.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "method").agg(F.count("*").alias("n"))
    return timed.select(F.col("w.start").alias("start"), "method", "n")

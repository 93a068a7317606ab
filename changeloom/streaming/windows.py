"""Event time, watermarks and windows on batch and streaming frames (STM-01..06, STM-10)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..model import TS

PROCESSING_TIME = "processing_time"


def with_event_time(df: DataFrame, characteristic: str = "event", lateness_seconds: int = 0,
                    ts_col: str = TS) -> DataFrame:
    """STM-01..03: event time with a watermark of the given lateness, or processing time.

    ``event`` uses ``ts_col``; lateness 0 takes times as ascending, later rows are
    ignored by windows.  ``processing`` adds a ``processing_time`` column.
    """
    if characteristic == "processing":
        return df.withColumn(PROCESSING_TIME, F.current_timestamp())
    if characteristic != "event":
        raise ValueError(f"unknown time characteristic {characteristic!r}")
    return df.withWatermark(ts_col, f"{lateness_seconds} seconds") if df.isStreaming else df


def window_agg(df: DataFrame, kind: str, duration: str, aggs: Mapping[str, Column],
               keys: Sequence[str] = (), slide: str | None = None, ts_col: str = TS) -> DataFrame:
    """STM-04..06: ``tumble``, ``hop`` (with ``slide``) or ``session`` windows by key.

    Columns: keys, ``window_start``, ``window_end``, aggregates.  The aggregates are
    partial before the shuffle in batch and stream.
    """
    if kind == "tumble":
        w = F.window(ts_col, duration)
    elif kind == "hop":
        w = F.window(ts_col, duration, slide)
    elif kind == "session":
        w = F.session_window(ts_col, duration)
    else:
        raise ValueError(f"unknown window {kind!r}")
    return df.groupBy(*keys, w.alias("_w")).agg(*[c.alias(n) for n, c in aggs.items()]) \
        .select(*keys, F.col("_w.start").alias("window_start"),
                F.col("_w.end").alias("window_end"), *aggs)


def key_by(df: DataFrame, keys: Sequence[str], n: int | None = None) -> DataFrame:
    """STM-10: partition by columns, a hint only; later keyed operators reuse it."""
    return df.repartition(n, *keys) if n else df.repartition(*keys)

"""Batch profiles, flow statistics, heartbeats and error tables (AGG-09..12, STM-14, 17, 18)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..model import DATA_PROTOCOLS, HEARTBEAT, TS
from ..sources.messages import match_namespace



def ts_profile(df: DataFrame, by: Sequence[str] = ("protocol", "namespace"), ts_col: str = TS
               ) -> DataFrame:
    """AGG-09: least and greatest event time and row count per (protocol, namespace)."""
    return df.groupBy(*by).agg(F.min(ts_col).alias("min_ts"), F.max(ts_col).alias("max_ts"),
                               F.count(F.lit(1)).alias("n"))


#: flow_stats output name -> (from stage, to stage); stage numbers index its ``stages``
INTERVALS = {"data_to_main": (0, 2), "batch_to_main": (1, 2), "main_to_transform": (2, 3),
             "transform_to_sink": (3, 4), "sink_to_done": (4, 5), "batch_to_done": (1, 5)}


def flow_stats(df: DataFrame, stages: Sequence[str], count_col: str = "n") -> DataFrame:
    """AGG-10: six latency intervals in whole seconds, and throughput.

    ``stages`` names six timestamp columns: a row's own time, batch start, main data
    ready, transform start, sink start, done.  Throughput is count / (done - batch
    start), or the count when that is 0.
    """
    ms = [F.unix_millis(F.col(s).cast("timestamp")) for s in stages]

    def seconds(a: int, b: int):
        return ((ms[b] - ms[a]) / 1000).cast("long")

    busy = seconds(1, 5)
    per_second = (F.col(count_col) / F.nullif(busy, F.lit(0))).cast("long")
    return df.withColumns({
        **{name: seconds(a, b) for name, (a, b) in INTERVALS.items()},
        "throughput": F.when(busy == 0, F.col(count_col)).otherwise(per_second)})


def latest_metric(df: DataFrame, by: Sequence[str], metric: str, ts_col: str = TS,
                  tie_break: Sequence[str] = ()) -> DataFrame:
    """AGG-11: the metric's value at the greatest time of each flow."""
    order = F.struct(F.col(ts_col), *[F.col(c) for c in tie_break])
    return df.groupBy(*by).agg(F.max(ts_col).alias(ts_col),
                               F.max_by(metric, order).alias(metric))


def heartbeat_stats(messages: DataFrame, processed: DataFrame, ts_col: str = TS) -> DataFrame:
    """STM-14: a zero-count row per heartbeat of a namespace without data in the batch."""
    beats = messages.filter(F.col("protocol") == HEARTBEAT) \
        .groupBy("namespace").agg(F.max(ts_col).alias(ts_col))
    return beats.join(processed.select("namespace").distinct(), "namespace", "left_anti") \
        .select("namespace", F.lit(0).cast("long").alias("n"), ts_col)


def error_records(df: DataFrame, reason: str, source: str, sink: str, batch_id: int | str,
                  columns: Sequence[str], carry: Mapping[str, str] | None = None) -> DataFrame:
    """STM-17: one record per failed row: contents as JSON, names, reason, batch, origin.

    ``carry`` maps record names to columns of the frame, for example topic,
    partition and offset.
    """
    return df.select(
        F.lit(source).alias("source"), F.lit(sink).alias("sink"),
        F.lit(str(batch_id)).alias("batch_id"), F.lit(reason).alias("reason"),
        F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row"),
        *[F.col(c).alias(name) for name, c in (carry or {}).items()])


def error_batches(records: DataFrame, by: Sequence[str] = ("source", "sink", "batch_id", "reason"),
                  ts_col: str = TS) -> DataFrame:
    """AGG-12: one record per failed batch: count, event-time range and offset ranges.

    The offset ranges are an array with one entry per topic partition, taken from two
    partial aggregates, never from a list of rows.
    """
    per_partition = records.groupBy(*by, "topic", "partition").agg(
        F.count(F.lit(1)).alias("n"), F.min(ts_col).alias("lo"), F.max(ts_col).alias("hi"),
        F.min("offset").alias("from_offset"), F.max("offset").alias("until_offset"))
    return per_partition.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("lo").alias("min_ts"), F.max("hi").alias("max_ts"),
        F.sort_array(F.collect_list(F.struct("topic", "partition", "from_offset",
                                             "until_offset"))).alias("offsets"))


def flow_errors(batches: DataFrame, by: Sequence[str] = ("source", "sink")) -> DataFrame:
    """AGG-12: per flow the failed rows, batches and the interval to run again."""
    return batches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("batches"),
        F.min("min_ts").alias("from_ts"), F.max("max_ts").alias("to_ts"))


def backfill(source: DataFrame, errors: DataFrame, rule: str, protocol: str = "all"
             ) -> tuple[DataFrame, DataFrame]:
    """STM-18: the messages of failed offset ranges, unchanged, and a count per partition.

    ``source`` has topic, partition, offset, key and value (a bounded Kafka read or an
    archive); ``errors`` has ``offsets`` as in :func:`error_batches`.  Ranges are
    merged first so that overlapping errors do not repeat a message; each merged
    range is then joined by topic and partition.
    """
    ranges = merge_ranges(errors.select(F.explode("offsets").alias("o"))
                          .select("o.topic", "o.partition", "o.from_offset", "o.until_offset"))
    key = F.lower("key")
    wanted = source.withColumns({"_protocol": F.substring_index(key, ".", 1),
                                 "_ns": F.expr("substring(lower(key), instr(key, '.') + 1)")}) \
        .filter(match_namespace("_ns", rule))
    wanted = wanted.filter(F.col("_protocol").isin(*DATA_PROTOCOLS)) if protocol == "all" \
        else wanted.filter(F.col("_protocol") == protocol)
    # a range is looked up by the buckets of offsets it covers, so the join is on equality
    bucket = F.floor(F.col("offset") / OFFSET_BUCKET)
    r = ranges.select(
        F.col("topic").alias("_t"), F.col("partition").alias("_p"), "from_offset", "until_offset",
        F.explode(F.sequence(F.floor(F.col("from_offset") / OFFSET_BUCKET),
                             F.floor(F.col("until_offset") / OFFSET_BUCKET))).alias("_b"))
    hit = wanted.join(r, (F.col("topic") == F.col("_t")) & (F.col("partition") == F.col("_p"))
                      & (bucket == F.col("_b"))
                      & F.col("offset").between(F.col("from_offset"), F.col("until_offset")),
                      "left_semi").drop("_protocol", "_ns")
    return hit, hit.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("n"))


#: offsets per join bucket in backfill
OFFSET_BUCKET = 10_000


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Overlapping offset ranges of a partition joined into one."""
    from pyspark.sql import Window
    distinct = ranges.groupBy("topic", "partition", "from_offset") \
        .agg(F.max("until_offset").alias("until_offset"))
    w = Window.partitionBy("topic", "partition").orderBy("from_offset")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("from_offset") > F.max("until_offset").over(before) + 1, F.lit(True))
    grouped = distinct.withColumn("_new", opens.cast("int")) \
        .withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("topic", "partition", "_g").agg(
        F.min("from_offset").alias("from_offset"), F.max("until_offset").alias("until_offset")) \
        .drop("_g")

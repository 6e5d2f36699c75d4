"""Continuous rule counts over snapshot documents dropped into a folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..model import SNAPSHOT
from ..operators.ingest import FILE_PATTERN, HOST_PATTERN
from ..operators.rules import DEFAULT_RULES, Rule, dedup_digest, rule_field, rule_matches
from ..sources.snapshots import key_below

DELAY = "24 hours"


def snapshot_stream(
    spark: SparkSession, path: str, layout: str = "file", max_files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of admitted snapshot documents; wall-clock rules are left to the watermark."""
    schema = T.StructType([*SNAPSHOT.fields, T.StructField("key", T.StringType())])
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if layout == "file":
        reader = reader.option("multiLine", True).option("pathGlobFilter", "*.json")
    docs = reader.json(path)
    if layout == "file":
        docs = docs.withColumn("key", key_below(F.col("_metadata.file_path"), path))
    parts = F.split("key", "/")
    folder, name = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))
    admitted = docs.filter(folder.rlike(HOST_PATTERN) & name.rlike(FILE_PATTERN))
    host = F.coalesce(F.when(F.col("host_id") != "", F.col("host_id")), folder)
    return admitted.withColumn("host_id", host)


def rule_counts(
    snapshots: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, delay: str = DELAY, span: str = DELAY
) -> DataFrame:
    """Matches per host, rule and tumbling window over deduplicated events.

    Of several copies of an event the first to arrive counts. Events later than ``delay`` are
    dropped. Counts combine on the map side before the stateful exchange.

    Events without a usable time are never late and have no window: each match is a row of its own with
    null window ends, as soon as it arrives. Copies of them are told by the digests of what arrived
    before; these expire by the time of arrival, ``delay`` after it, once the watermark of the stream has
    passed that, so the state of a live stream does not grow without end. The documents are read once
    more for them.
    """
    events = snapshots.select("host_id", F.explode("events").alias("e")).select(
        "host_id",
        text.parse_ts(F.col("e.ts")).alias("ts"),
        F.col("e.ts").alias("ts_raw"),
        *[F.col(f"e.{n}").alias(n) for n in ("source", "provider", "event_id", "record_id", "message", "tags")],
    )
    slim = events.select("host_id", "ts", dedup_digest().alias("digest"), rule_matches(rules).alias("numbers"))
    unique = slim.filter(F.col("ts").isNotNull()).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["host_id", "digest"])
    matched = unique.select("host_id", "ts", F.explode("numbers").alias("rule_no"))
    counted = matched.groupBy(F.window("ts", span), "host_id", "rule_no").count()
    windowed = counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "host_id", "rule_no", F.col("count").alias("event_count")
    )
    # The watermark of arrival has to see every event, or it would hold back the other one where all have
    # times: the condition names its column, so that it is not evaluated before.
    arrived = slim.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", delay)
    matching = F.when(F.col("arrived") > F.lit("1970-01-02").cast("timestamp"), F.col("ts").isNull() & (F.size("numbers") > 0))
    untimed = arrived.filter(matching).dropDuplicatesWithinWatermark(["host_id", "digest"])
    never = F.lit(None).cast("timestamp")
    single = untimed.select(
        never.alias("window_start"), never.alias("window_end"), "host_id", F.explode("numbers").alias("rule_no"), F.lit(1).cast("long").alias("event_count")
    )
    return windowed.union(single).select(
        "window_start", "window_end", "host_id", rule_field(F.col("rule_no"), rules, "type", "string").alias("type"), "event_count"
    )


def stream_detect(counts: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append finished windows, and the new counts of events without a time, to a parquet table.

    The latter have null window ends; the sum over their rows is the count of a host and type.

    Each micro-batch owns one folder and overwrites it, so a batch that is run again after a failure
    does not add its rows twice.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch.groupBy("window_start", "window_end", "host_id", "type").agg(F.sum("event_count").alias("event_count"))
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(write_batch)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()

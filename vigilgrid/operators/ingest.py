"""From landed documents to admitted snapshots, event streams and tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.relational import first_per_group
from ..model import EVENT, HOST

# Patterns a snapshot key must match.
HOST_PATTERN = r"^[A-Za-z0-9._:-]{3,64}$"
FILE_PATTERN = r"^snapshot-[0-9]{8}T[0-9]{6}Z\.json$"
REJECT_SAMPLES = 10


def admit_snapshots(snapshots: DataFrame, as_of: Column, window_hours: int = 24) -> DataFrame:
    """Add ``reject_reason`` (null = accepted) and the host the snapshot belongs to.

    Needs ``key``, ``load_error`` and ``window_end`` (instant, null where missing or unusable).
    The first failing rule names the reason. The reference time is a parameter, so the result of a
    run can be repeated.
    """
    parts = F.split("key", "/")
    folder = F.when(F.size(parts) >= 2, F.element_at(parts, -2))
    file_name = F.element_at(parts, -1)
    cutoff = as_of - F.expr(f"INTERVAL {int(window_hours)} HOURS")
    reason = (
        F.when(folder.isNull(), "invalid_path")
        .when(~folder.rlike(HOST_PATTERN), "host_pattern")
        .when(~file_name.rlike(FILE_PATTERN), "filename_pattern")
        .when(F.col("load_error"), "schema_fail: load_error")
        .when(F.col("window_end") < cutoff, "window_out_of_range")
    )
    named = F.col("host_id") if "host_id" in snapshots.columns else F.lit(None).cast("string")
    host = F.coalesce(F.when(named != "", named), folder)
    return snapshots.withColumns({"reject_reason": reason, "host_id": host})


def accepted(admitted: DataFrame) -> DataFrame:
    return admitted.filter(F.col("reject_reason").isNull())


def rejected(admitted: DataFrame) -> DataFrame:
    return admitted.filter(F.col("reject_reason").isNotNull())


def select_snapshots(
    snapshots: DataFrame, as_of: Column, mode: str = "latest", max_hosts: int | None = None
) -> DataFrame:
    """Latest snapshot per host, or all of them; optionally only the first hosts of each run.

    A missing window end counts as ``as_of``.
    """
    out = snapshots
    if mode == "latest":
        end = F.coalesce(F.col("window_end"), as_of)
        out = first_per_group(out, list(HOST), [end.desc(), F.col("key").asc()])
    if max_hosts is not None:
        hosts = out.select(*HOST).distinct()
        kept = first_per_group(hosts, ["run_id"], [F.col("host_id").asc()], max_hosts)
        out = out.join(kept, list(HOST), "left_semi")
    return out


def latest_snapshot_per_host(snapshots: DataFrame, as_of: Column) -> DataFrame:
    return select_snapshots(snapshots, as_of, "latest")


def admission_report(admitted: DataFrame, mode: str = "latest", max_hosts: int | None = None) -> DataFrame:
    """Counters and up to ten reject samples per run, for the way in which snapshots are selected."""
    ok = F.col("reject_reason").isNull()
    per_host = admitted.groupBy(*HOST).agg(
        F.count(F.lit(1)).alias("_keys"), F.count_if(ok).alias("_accepted")
    )
    latest = mode == "latest"
    taken = F.least(F.lit(1), F.col("_accepted")) if latest else F.col("_accepted")
    passed = F.greatest(F.lit(0), F.col("_accepted") - 1) if latest else F.lit(0)
    counters = per_host.groupBy("run_id").agg(
        F.sum("_keys").alias("keys_found"),
        F.count_if(F.col("_accepted") > 0).alias("hosts_found"),
        F.sum(taken).cast("bigint").alias("loaded"),
        F.sum(passed).cast("bigint").alias("skipped_not_latest"),
        F.sum(F.col("_keys") - F.col("_accepted")).alias("rejected"),
    )
    if max_hosts is not None:
        kept = first_per_group(per_host.filter(F.col("_accepted") > 0), ["run_id"], [F.col("host_id").asc()], max_hosts)
        loaded = kept.groupBy("run_id").agg(F.sum(taken).cast("bigint").alias("_loaded"))
        counters = counters.join(loaded, "run_id", "left").withColumn("loaded", F.coalesce("_loaded", F.lit(0))).drop("_loaded")
    samples = (
        first_per_group(rejected(admitted), ["run_id"], [F.col("key").asc()], REJECT_SAMPLES)
        .groupBy("run_id")
        .agg(F.sort_array(F.collect_list(F.struct("key", "reject_reason"))).alias("rejected_samples"))
    )
    return counters.join(samples, "run_id", "left")


def admission_counters(admitted: DataFrame) -> DataFrame:
    reason = F.coalesce(F.col("reject_reason"), F.lit("accepted"))
    return admitted.groupBy("run_id", reason.alias("outcome")).agg(F.count(F.lit(1)).alias("keys"))


def rank_snapshots(snapshots: DataFrame) -> DataFrame:
    """Order of the snapshots of a host: newest window first, a missing end newest of all.

    The rank is a value to sort by, made from the snapshot itself, so no snapshot has to be moved.
    """
    newest = F.coalesce(-F.unix_micros("window_end"), F.lit(-(2**62)))
    return snapshots.withColumn("snap_rank", F.struct(newest.alias("newest"), F.col("key")))


def explode_events(snapshots: DataFrame) -> DataFrame:
    """Nested snapshot documents to one row per event, in snapshot order (``snap_rank``, ``pos``)."""
    given = set(snapshots.schema["events"].dataType.elementType.names)

    def field(name: str) -> Column:
        known = F.col(f"event.{name}") if name in given else F.lit(None)
        return known.cast(EVENT[name].dataType).alias(name)

    rows = snapshots.select(*HOST, "snap_rank", F.posexplode("events").alias("pos", "event"))
    return rows.select(
        *HOST,
        "snap_rank",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("event.ts").alias("ts_raw"),
        text.parse_ts(F.col("event.ts")).alias("ts"),
        *[field(name) for name in EVENT.names if name not in ("ts", "tags")],
        F.coalesce(field("tags"), F.array().cast("array<string>")).alias("tags"),
    )


def tickets_by_host(tickets: DataFrame) -> DataFrame:
    """Tickets with a usable host; blank or missing hosts become ``unknown``."""
    host = F.when(F.coalesce(F.col("host_id"), F.lit("")) == "", "unknown").otherwise(F.col("host_id"))
    return tickets.withColumn("host_id", host)


def normalize_raw_log(raw: DataFrame) -> DataFrame:
    """Raw log rows to event rows: level names, source names, cleaned messages."""
    return raw.select(
        *[c for c in raw.columns if c not in ("level_code", "message", "channel")],
        text.level_name(F.col("level_code")).alias("level"),
        "channel",
        F.concat(F.lit("WindowsEventLog:"), F.col("channel")).alias("source"),
        text.sanitize_raw_message(F.col("message")).alias("message"),
        F.create_map().cast("map<string,string>").alias("data"),
        F.array().cast("array<string>").alias("tags"),
    )


def snapshot_stats(events: DataFrame) -> DataFrame:
    """Event counts by level for each snapshot, combined on the map side."""
    return events.groupBy(*HOST, "snap_rank").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.col("level") == "Critical").alias("critical_count"),
        F.count_if(F.col("level") == "Error").alias("error_count"),
        F.count_if(F.col("level") == "Warning").alias("warning_count"),
    )

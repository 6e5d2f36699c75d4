"""Per-host views: windows, ordered events, users, tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.relational import ranked_position, spread_join
from ..model import HOST
from .rules import dedup_events, event_order


def event_span(events: DataFrame, as_of: Column) -> DataFrame:
    """First and last usable event time per host; ``as_of`` where a host has none."""
    return events.groupBy(*HOST).agg(
        F.coalesce(F.min("ts"), as_of).alias("first_ts"),
        F.coalesce(F.max("ts"), as_of).alias("last_ts"),
    )


def last_event_ts(events: DataFrame) -> DataFrame:
    """Last usable event time per host as text, empty where there is none."""
    latest = text.iso_text(F.max("ts"))
    return events.groupBy(*HOST).agg(F.coalesce(latest, F.lit("")).alias("last_event_ts"))


def host_windows(
    snapshots: DataFrame, events: DataFrame | None = None, as_of: Column | None = None
) -> DataFrame:
    """Merged window and user of each host.

    Open sides fall back to the span of its events. Snapshots and events meet in one aggregation
    with map-side combine instead of a join. The user is the first one named in snapshot order.
    """
    named = F.when(F.col("user_id").isNotNull(), F.struct("snap_rank", "user_id"))
    rows = snapshots.select(
        *HOST,
        "window_start",
        "window_end",
        named.alias("_user"),
        F.lit(None).cast("timestamp").alias("_ts"),
    )
    if events is not None:
        rows = rows.unionByName(events.select(*HOST, F.col("ts").alias("_ts")), allowMissingColumns=True)
    fallback = F.lit(None).cast("timestamp") if as_of is None else as_of
    return rows.groupBy(*HOST).agg(
        F.coalesce(F.min("window_start"), F.min("_ts"), fallback).alias("window_start"),
        F.coalesce(F.max("window_end"), F.max("_ts"), fallback).alias("window_end"),
        F.min("_user")["user_id"].alias("user_id"),
    )


def host_user(snapshots: DataFrame) -> DataFrame:
    """First user named for a host, in snapshot order."""
    return snapshots.groupBy(*HOST).agg(
        F.min_by("user_id", F.when(F.col("user_id").isNotNull(), F.col("snap_rank"))).alias("user_id")
    )


def order_events(events: DataFrame) -> DataFrame:
    """Position of each event in the timeline of its host, starting at 0."""
    return ranked_position(events, list(HOST), event_order(), "event_seq", label="event-order")


def redact_events(
    events: DataFrame, mode: str = "balanced", path_patterns: str = "legacy"
) -> DataFrame:
    return events.withColumn("message", text.redact_message(F.col("message"), mode, path_patterns))


def host_events(events: DataFrame, mode: str = "balanced") -> DataFrame:
    """Deduplicated, redacted events of each host."""
    return redact_events(dedup_events(events), mode)


def recent_events(events: DataFrame, n: int = 50) -> DataFrame:
    """First ``n`` events of each host's timeline; cut on the map side before the exchange."""
    window = Window.partitionBy(*HOST).orderBy(*event_order())
    ranked = events.withColumn("event_rank", F.row_number().over(window))
    return ranked.filter(F.col("event_rank") <= n)


def host_severity(hosts: DataFrame, incidents: DataFrame) -> DataFrame:
    """Highest incident severity per host, 0 for hosts without incidents."""
    rows = hosts.select(*HOST, F.lit(0).alias("severity")).unionByName(
        incidents.select(*HOST, F.col("severity").cast("int").alias("severity"))
    )
    return rows.groupBy(*HOST).agg(F.max("severity").alias("severity"))


def attach_tickets(hosts: DataFrame, tickets: DataFrame) -> DataFrame:
    """Hosts with their tickets, one row per ticket; hosts without any keep one row.

    Tickets without a host share one name, which may be most of them, so a host's tickets are spread.
    """
    columns = [c for c in tickets.columns if c not in HOST]
    known = hosts.select(*HOST)
    return spread_join(tickets.select(*HOST, *columns), hosts.select(*HOST), list(HOST), ["ticket_id"], "right")


def host_timeline(windows: DataFrame, events: DataFrame, incidents: DataFrame) -> DataFrame:
    """One summary row per host and run: window, user, last event, severity, number of incidents."""
    facts = (
        windows.select(*HOST, "window_start", "window_end", "user_id")
        .unionByName(
            events.select(*HOST, F.col("ts").alias("_ts"), F.lit(1).alias("_event")), allowMissingColumns=True
        )
        .unionByName(
            incidents.select(*HOST, F.col("severity").alias("_severity"), F.lit(1).alias("_incident")),
            allowMissingColumns=True,
        )
    )
    return facts.groupBy(*HOST).agg(
        F.max("user_id").alias("user_id"),
        F.max("window_start").alias("window_start"),
        F.max("window_end").alias("window_end"),
        F.coalesce(text.iso_text(F.max("_ts")), F.lit("")).alias("last_event_ts"),
        F.coalesce(F.sum("_event"), F.lit(0)).alias("event_count"),
        F.coalesce(F.sum("_incident"), F.lit(0)).alias("incident_count"),
        F.coalesce(F.max("_severity"), F.lit(0)).alias("severity"),
    )

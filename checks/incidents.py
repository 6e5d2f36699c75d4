"""Incident flow: queries and checking SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilgrid.functions.relational import first_per_group
from vigilgrid.functions.text import iso_text, parse_ts
from vigilgrid.model import HOST, SNAPSHOT
from vigilgrid.operators import evaluate, fleet, ingest, ledger, quality, rules, timeline
from vigilgrid.plans import incident as flow
from vigilgrid.session import shuffles_dropped, stage, staging_root
from vigilgrid.sources import host_documents, sinks
from vigilgrid.sources import snapshots as docs
from vigilgrid.sources import testbed as tb
from vigilgrid.streaming import detect as stream

from .catalog import joined, query, shown, ts_text


def as_of():
    return F.lit(tb.AS_OF).cast("timestamp")


def _incidents(spark: SparkSession, sf: str) -> DataFrame:
    events = tb.endpoint_events(spark, sf)
    windows = timeline.host_windows(tb.snapshots(spark, sf), events)
    return rules.detect_incidents(events, windows)


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return flow.incident_table(tb.endpoint_events(spark, sf), tb.snapshots(spark, sf))


def _statuses(spark: SparkSession, sf: str, incidents: DataFrame) -> DataFrame:
    return fleet.cluster_status(fleet.clusters(incidents), tb.runs(spark, sf))


def _view(spark: SparkSession, sf: str) -> flow.FleetView:
    return flow.fleet_view(*_tables(spark, sf), tb.runs(spark, sf))


def _scratch(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark)}/vigilgrid/{label}-{uuid.uuid4().hex}"


PART = 4096


def snapshot_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot documents with their landing key.

    A snapshot comes in parts by ranges of record ids, so that no document, and no task that builds
    one, holds more than a fixed number of events.
    """
    event = F.struct(
        F.col("pos"),
        F.struct(
            F.col("ts_raw").alias("ts"),
            *[F.col(n) for n in ("level", "source", "channel", "provider", "event_id", "record_id", "message", "tags")],
        ).alias("e"),
    )
    events = tb.endpoint_events(spark, sf).withColumn("part", F.floor(F.col("record_id") / PART))
    nested = events.groupBy(*HOST, "snap_rank", "part").agg(
        F.sort_array(F.collect_list(event)).alias("_events")
    )
    heads = tb.snapshots(spark, sf)
    part_of = F.concat(F.lit("/snapshots/part-"), F.col("part").cast("string"), F.lit("/"))
    window = F.struct(F.col("window_start_raw").alias("start"), F.col("window_end_raw").alias("end"))
    return nested.join(heads, [*HOST, "snap_rank"]).select(
        "run_id",
        F.lit("1.0").alias("schema_version"),
        F.concat_ws("-", "host_id", "run_id", "snap_rank").alias("snapshot_id"),
        "host_id",
        "user_id",
        F.coalesce("window_end_raw", F.lit(tb.AS_OF)).alias("generated_at"),
        window.alias("window"),
        F.transform("_events", lambda p: p["e"]).alias("events"),
        F.replace("key", F.lit("/snapshots/"), part_of).alias("key"),
    )


def _landed(spark: SparkSession, sf: str, closed: bool = False) -> str:
    """Documents in a landing folder, compressed; ``closed`` gives every one of them a whole window."""
    path = _scratch(spark, "landing")
    documents = snapshot_documents(spark, sf)
    if closed:
        ends = [F.coalesce(f"window.{end}", F.lit(tb.AS_OF)).alias(end) for end in ("start", "end")]
        documents = documents.withColumn("window", F.struct(*ends))
    with shuffles_dropped(spark):
        documents.drop("run_id").write.json(path, compression="gzip")
    return path


def _run_of(key: str = "key"):
    return F.split(key, "/")[0]


@query(
    "scan_snapshots",
    """
    SELECT replace(sn.key, '/snapshots/', '/snapshots/part-' || p.part || '/') AS key, sn.host_id, strftime(sn.window_start, '%Y-%m-%d %H:%M:%S.%f') AS window_start,
           strftime(sn.window_end, '%Y-%m-%d %H:%M:%S.%f') AS window_end, p.n_events, false AS load_error
    FROM sn JOIN (SELECT run_id, host_id, snap_rank, record_id // 4096 AS part, count(*) AS n_events FROM ee
                  GROUP BY run_id, host_id, snap_rank, record_id // 4096) p
    ON p.run_id = sn.run_id AND p.host_id = sn.host_id AND p.snap_rank = sn.snap_rank
    """,
)
def scan_snapshots(spark, sf):
    found = docs.scan_snapshots(spark, _landed(spark, sf), layout="lines")
    return found.select(
        "key", "host_id", ts_text("window_start").alias("window_start"), ts_text("window_end").alias("window_end"),
        F.size("events").cast("bigint").alias("n_events"), "load_error",
    )


@query("admit_snapshots", "SELECT run_id, key, host_id, coalesce(reject_reason, '') AS reject_reason FROM ad")
def admit_snapshots(spark, sf):
    admitted = ingest.admit_snapshots(tb.snapshot_keys(spark, sf), as_of(), tb.ADMIT_WINDOW_HOURS)
    return admitted.select("run_id", "key", "host_id", F.coalesce("reject_reason", F.lit("")).alias("reject_reason"))


@query(
    "admission_report",
    """
    SELECT c.run_id, c.keys_found, c.hosts_found, c.hosts_found AS loaded, c.skipped_not_latest, c.rejected,
           coalesce(s.samples, '') AS rejected_samples
    FROM (SELECT run_id, CAST(sum(k) AS BIGINT) AS keys_found, count(*) FILTER (WHERE a > 0) AS hosts_found,
                 CAST(sum(greatest(0, a - 1)) AS BIGINT) AS skipped_not_latest, CAST(sum(k - a) AS BIGINT) AS rejected
          FROM (SELECT run_id, host_id, count(*) AS k, count(*) FILTER (WHERE reject_reason IS NULL) AS a
                FROM ad GROUP BY run_id, host_id) GROUP BY run_id) c
    LEFT JOIN (SELECT run_id, string_agg(key || '=' || reject_reason, '|' ORDER BY key, reject_reason) AS samples
               FROM (SELECT * FROM ad WHERE reject_reason IS NOT NULL
                     QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY key, host_id) <= 10) GROUP BY run_id) s
    ON s.run_id = c.run_id
    """,
)
def admission_report(spark, sf):
    keys = tb.snapshot_keys(spark, sf)
    report = ingest.admission_report(ingest.admit_snapshots(keys, as_of(), tb.ADMIT_WINDOW_HOURS))
    shown = F.transform("rejected_samples", lambda s: F.concat(s["key"], F.lit("="), s["reject_reason"]))
    return report.withColumn("rejected_samples", F.coalesce(joined(shown), F.lit("")))


@query(
    "admission_counters",
    "SELECT run_id, coalesce(reject_reason, 'accepted') AS outcome, count(*) AS keys FROM ad GROUP BY 1, 2",
)
def admission_counters(spark, sf):
    keys = tb.snapshot_keys(spark, sf)
    return ingest.admission_counters(ingest.admit_snapshots(keys, as_of(), tb.ADMIT_WINDOW_HOURS))


@query(
    "explode_events",
    """
    SELECT run_id, host_id, snap_rank, record_id, ts_raw, level, source, provider, event_id, message,
           array_to_string(tags, '|') AS tags,
           row_number() OVER (PARTITION BY run_id, host_id, snap_rank, record_id // 4096 ORDER BY pos) - 1 AS pos
    FROM ee
    """,
)
def explode_events(spark, sf):
    documents = snapshot_documents(spark, sf)
    ranked = documents.withColumn("snap_rank", F.element_at(F.split("snapshot_id", "-"), -1).cast("int"))
    events = ingest.explode_events(ranked)
    return events.select(
        *HOST, "snap_rank", "record_id", "ts_raw", "level", "source", "provider", "event_id", "message",
        joined("tags").alias("tags"), "pos",
    )


@query(
    "scan_tickets",
    """
    SELECT 'run-' || strftime(ts, '%Y%m%d') AS run_id,
           CASE WHEN event_id % 9 <> 0 THEN 'HOST-' || lpad(CAST(user_id AS VARCHAR), 5, '0') ELSE 'unknown' END AS host_id,
           'TICKET-' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS ticket_id
    FROM events WHERE event_type = 'signup'
    """,
)
def scan_tickets(spark, sf):
    """Tickets written as documents, one folder per run, and read back."""
    path = _scratch(spark, "tickets")
    body = F.to_json(F.struct("ticket_id", "host_id", "subject"))
    tb.tickets(spark, sf).select("run_id", body.alias("value")).write.partitionBy("run_id").text(path)
    found = docs.scan_tickets(spark, path, layout="lines")
    return ingest.tickets_by_host(found).select(*HOST, "ticket_id")


@query(
    "latest_snapshot_per_host",
    """
    SELECT run_id, host_id, key FROM sn
    QUALIFY row_number() OVER (PARTITION BY run_id, host_id
      ORDER BY coalesce(window_end, TIMESTAMP '2024-01-31 00:00:00') DESC, key) = 1
    """,
)
def latest_snapshot_per_host(spark, sf):
    return ingest.latest_snapshot_per_host(tb.snapshots(spark, sf), as_of()).select(*HOST, "key")


@query(
    "select_snapshots_capped",
    """
    SELECT run_id, host_id, key FROM sn
    QUALIFY dense_rank() OVER (PARTITION BY run_id ORDER BY host_id) <= 25
    """,
)
def select_snapshots_capped(spark, sf):
    return ingest.select_snapshots(tb.snapshots(spark, sf), as_of(), "all", max_hosts=25).select(*HOST, "key")


@query(
    "normalize_raw_log",
    """
    SELECT record_id, 'WindowsEventLog:' || channel AS source, channel,
           CASE code WHEN 1 THEN 'Critical' WHEN 2 THEN 'Error' WHEN 3 THEN 'Warning' ELSE 'Information' END AS level,
           message || ' at 10.20.' || (record_id % 256) || '.0/24' AS message
    FROM (SELECT record_id, channel, record_id % 7 AS code, message FROM ev)
    """,
)
def normalize_raw_log(spark, sf):
    record = F.col("record_id")
    address = F.concat(F.lit(" at 10.20."), (record % 256).cast("string"), F.lit("."), (record % 200).cast("string"))
    raw = tb.event_views(spark, sf).select(
        "record_id",
        (record % 7).cast("int").alias("level_code"),
        "channel",
        F.concat("message", address).alias("message"),
    )
    return ingest.normalize_raw_log(raw).select("record_id", "source", "channel", "level", "message")


@query(
    "snapshot_stats",
    """
    SELECT run_id, host_id, snap_rank, count(*) AS event_count, count(*) FILTER (WHERE level = 'Critical') AS critical_count,
           count(*) FILTER (WHERE level = 'Error') AS error_count, count(*) FILTER (WHERE level = 'Warning') AS warning_count
    FROM ee GROUP BY run_id, host_id, snap_rank
    """,
)
def snapshot_stats(spark, sf):
    return ingest.snapshot_stats(tb.endpoint_events(spark, sf))


# -- timeline ---------------------------------------------------------------------------------


@query(
    "dedup_events",
    "SELECT run_id, host_id, record_id, ts_raw, provider, event_id, message, snap_rank, pos FROM dd",
)
def dedup_events(spark, sf):
    return rules.dedup_events(tb.endpoint_events(spark, sf)).select(
        *HOST, "record_id", "ts_raw", "provider", "event_id", "message", "snap_rank", "pos"
    )


@query(
    "order_events",
    """
    SELECT run_id, host_id, snap_rank, record_id,
           row_number() OVER (PARTITION BY run_id, host_id ORDER BY ts, ts_raw, snap_rank, pos) - 1 AS event_seq
    FROM ee
    """,
)
def order_events(spark, sf):
    ordered = timeline.order_events(tb.endpoint_events(spark, sf))
    return ordered.select(*HOST, "snap_rank", "record_id", "event_seq")


@query(
    "recent_events",
    """
    SELECT run_id, host_id, record_id, message FROM dd
    QUALIFY row_number() OVER (PARTITION BY run_id, host_id ORDER BY ts, ts_raw, snap_rank, pos) <= 2
    """,
)
def recent_events(spark, sf):
    events = timeline.host_events(tb.endpoint_events(spark, sf))
    return timeline.recent_events(events, 2).select(*HOST, "record_id", "message")


@query(
    "host_windows",
    """
    SELECT run_id, host_id, strftime(window_start, '%Y-%m-%d %H:%M:%S.%f') AS window_start,
           strftime(window_end, '%Y-%m-%d %H:%M:%S.%f') AS window_end, user_id FROM hw
    """,
)
def host_windows(spark, sf):
    windows = timeline.host_windows(tb.snapshots(spark, sf), tb.endpoint_events(spark, sf))
    return windows.select(
        *HOST, ts_text("window_start").alias("window_start"), ts_text("window_end").alias("window_end"), "user_id"
    )


@query(
    "event_span",
    """
    SELECT run_id, host_id, strftime(lo, '%Y-%m-%d %H:%M:%S.%f') AS first_ts,
           strftime(hi, '%Y-%m-%d %H:%M:%S.%f') AS last_ts FROM span
    """,
)
def event_span(spark, sf):
    spans = timeline.event_span(tb.endpoint_events(spark, sf), as_of())
    return spans.select(*HOST, ts_text("first_ts").alias("first_ts"), ts_text("last_ts").alias("last_ts"))


@query(
    "last_event_ts",
    "SELECT run_id, host_id, strftime(hi, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS last_event_ts FROM span",
)
def last_event_ts(spark, sf):
    return timeline.last_event_ts(tb.endpoint_events(spark, sf))


@query("host_user", "SELECT run_id, host_id, user_id FROM hw")
def host_user(spark, sf):
    return timeline.host_user(tb.snapshots(spark, sf))


@query("host_severity", "SELECT run_id, host_id, score AS severity FROM hs")
def host_severity(spark, sf):
    hosts = tb.snapshots(spark, sf).select(*HOST).distinct()
    found = rules.detect_incidents(tb.endpoint_events(spark, sf))
    return timeline.host_severity(hosts, found)


@query(
    "host_timeline",
    """
    SELECT hs.run_id, hs.host_id, hs.user_id, strftime(span.hi, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS last_event_ts,
           d.n AS event_count, hs.incidents AS incident_count, hs.score AS severity
    FROM hs JOIN span ON span.run_id = hs.run_id AND span.host_id = hs.host_id
    JOIN (SELECT run_id, host_id, count(*) AS n FROM dd GROUP BY 1, 2) d ON d.run_id = hs.run_id AND d.host_id = hs.host_id
    """,
)
def host_timeline(spark, sf):
    windows, incidents = _tables(spark, sf)
    events = rules.dedup_events(tb.endpoint_events(spark, sf))
    line = timeline.host_timeline(windows, events, incidents)
    return line.select(*HOST, "user_id", "last_event_ts", "event_count", "incident_count", "severity")


@query(
    "attach_tickets",
    """
    SELECT hw.run_id, hw.host_id, t.ticket_id FROM hw LEFT JOIN (
      SELECT 'run-' || strftime(ts, '%Y%m%d') AS run_id, 'HOST-' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS host_id,
             'TICKET-' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS ticket_id
      FROM events WHERE event_type = 'signup' AND event_id % 9 <> 0) t
    ON t.run_id = hw.run_id AND t.host_id = hw.host_id
    """,
)
def attach_tickets(spark, sf):
    tickets = ingest.tickets_by_host(tb.tickets(spark, sf)).select(*HOST, "ticket_id")
    return timeline.attach_tickets(timeline.host_user(tb.snapshots(spark, sf)), tickets)


# -- rules ------------------------------------------------------------------------------------


@query(
    "detect_incidents",
    """
    SELECT run_id, host_id, incident_id, type, severity, confidence, event_count, summary, signature_hash, signature_key,
           strftime(evidence_start, '%Y-%m-%d %H:%M:%S.%f') AS evidence_start,
           strftime(evidence_end, '%Y-%m-%d %H:%M:%S.%f') AS evidence_end,
           strftime(window_start, '%Y-%m-%d %H:%M:%S.%f') AS window_start,
           strftime(window_end, '%Y-%m-%d %H:%M:%S.%f') AS window_end
    FROM ic
    """,
)
def detect_incidents(spark, sf):
    return _incidents(spark, sf).select(
        *HOST, "incident_id", "type", "severity", "confidence", "event_count", "summary", "signature_hash",
        "signature_key", *[ts_text(c).alias(c) for c in ("evidence_start", "evidence_end", "window_start", "window_end")],
    )


def _one_type(incident_type: str):
    sql = f"SELECT run_id, host_id, severity, confidence, event_count FROM ic WHERE type = '{incident_type}'"

    @query(f"detect_{incident_type}", sql)
    def detector(spark, sf):
        only = [r for r in rules.DEFAULT_RULES if r.type == incident_type]
        found = rules.detect_incidents(tb.endpoint_events(spark, sf), rules=only)
        return found.select(*HOST, "severity", "confidence", "event_count")

    return detector


for _type in ("bsod", "disk_full", "service_crash_loop", "network_instability", "update_failure"):
    _one_type(_type)


@query("number_incidents", "SELECT run_id, host_id, type, incident_id FROM ic")
def number_incidents(spark, sf):
    return rules.detect_incidents(tb.endpoint_events(spark, sf)).select(*HOST, "type", "incident_id")


@query(
    "incident_evidence",
    """
    SELECT mr.run_id, mr.host_id, r.type, mr.evidence_rank, mr.ts_raw AS ts, mr.provider, mr.level, mr.message,
           mr.event_id, mr.source, mr.record_id
    FROM mr JOIN rule r ON r.rule_no = mr.rule_no AND mr.n >= r.min_n
    """,
)
def incident_evidence(spark, sf):
    return rules.incident_evidence(tb.endpoint_events(spark, sf))


@query(
    "first_evidence",
    """
    SELECT mr.run_id, mr.host_id, r.type, mr.ts_raw AS ts, mr.provider, mr.level, mr.message, mr.record_id
    FROM mr JOIN rule r ON r.rule_no = mr.rule_no AND mr.n >= r.min_n WHERE mr.evidence_rank = 1
    """,
)
def first_evidence(spark, sf):
    found = rules.incident_evidence(tb.endpoint_events(spark, sf), limit=1)
    return found.select(*HOST, "type", "ts", "provider", "level", "message", "record_id")


@query(
    "recommended_actions",
    """
    SELECT run_id, incident_id, type, CASE type
      WHEN 'bsod' THEN 'Capture minidump and driver list before reboot loops clear them.|Roll back or update the last installed driver/patch.'
      WHEN 'disk_full' THEN 'Clear temp folders and large caches.|Expand disk or reassign user data to secondary volume.'
      WHEN 'service_crash_loop' THEN 'Review service logs for repeated stop codes.|Restart service under supervisor and collect crash dumps.'
      WHEN 'network_instability' THEN 'Reset adapter and DNS cache, verify driver version.|Check site switch/appliance for correlated resets.'
      WHEN 'update_failure' THEN 'Re-run updater with verbose logging enabled.|Remove partially applied patches and retry.'
      END AS actions FROM ic
    """,
)
def recommended_actions(spark, sf):
    found = rules.detect_incidents(tb.endpoint_events(spark, sf))
    return found.select("run_id", "incident_id", "type", joined(rules.recommended_actions(F.col("type"))).alias("actions"))


# -- fleet ------------------------------------------------------------------------------------

CLUSTER_SQL = """
SELECT run_id, signature_hash, signature_key, type, affected_hosts, example_hosts, severity,
       strftime(first_seen, '%Y-%m-%d %H:%M:%S.%f') AS first_seen,
       strftime(last_seen, '%Y-%m-%d %H:%M:%S.%f') AS last_seen
FROM cl
"""


@query("clusters", CLUSTER_SQL)
def clusters(spark, sf):
    found = fleet.clusters(_incidents(spark, sf))
    return found.select(
        "run_id", "signature_hash", "signature_key", "type", "affected_hosts", joined("example_hosts").alias("example_hosts"),
        "severity", ts_text("first_seen").alias("first_seen"), ts_text("last_seen").alias("last_seen"),
    )


@query(
    "rank_clusters",
    """
    SELECT run_id, signature_hash, severity, affected_hosts,
           row_number() OVER (PARTITION BY run_id ORDER BY severity DESC, affected_hosts DESC, lead_host, lead_rule) AS cluster_rank
    FROM cl
    """,
)
def rank_clusters(spark, sf):
    found = stage(fleet.clusters(_incidents(spark, sf)), "clusters")
    return fleet.rank_clusters(found).select("run_id", "signature_hash", "severity", "affected_hosts", "cluster_rank")


@query(
    "cluster_status",
    "SELECT run_id, signature_hash, affected_hosts, status, coalesce(CAST(delta_affected_hosts AS VARCHAR), '') AS delta_affected_hosts FROM cs",
)
def cluster_status(spark, sf):
    return _statuses(spark, sf, _incidents(spark, sf)).select(
        "run_id", "signature_hash", "affected_hosts", "status", shown("delta_affected_hosts").alias("delta_affected_hosts")
    )


@query("previous_run", "SELECT run_id, prev_run_id FROM prv")
def previous_run(spark, sf):
    return fleet.previous_run(tb.runs(spark, sf))


@query(
    "top_hosts",
    """
    SELECT run_id, host_id, user_id, score, coalesce(reasons, '') AS reasons, coalesce(incident_refs, '') AS incident_refs, host_rank FROM th
    """,
)
def top_hosts(spark, sf):
    top = fleet.top_hosts(*_tables(spark, sf))
    return top.select(
        *HOST, "user_id", "score", joined("reasons").alias("reasons"), joined("incident_refs").alias("incident_refs"),
        F.col("host_rank").cast("bigint").alias("host_rank"),
    )


@query(
    "host_deltas",
    """
    SELECT run_id, host_id, score, coalesce(CAST(prev_score AS VARCHAR), '') AS prev_score,
           coalesce(CAST(delta_score AS VARCHAR), '') AS delta_score FROM hd
    """,
)
def host_deltas(spark, sf):
    top = fleet.top_hosts(*_tables(spark, sf))
    return fleet.host_deltas(top, tb.runs(spark, sf)).select(
        *HOST, "score", shown("prev_score").alias("prev_score"), shown("delta_score").alias("delta_score")
    )


@query("host_cluster_flags", "SELECT run_id, host_id, has_spiking, has_new FROM fl")
def host_cluster_flags(spark, sf):
    _, incidents = _tables(spark, sf)
    return fleet.host_cluster_flags(incidents, _statuses(spark, sf, incidents))


@query(
    "host_action",
    "SELECT run_id, host_id, score, coalesce(CAST(delta_score AS VARCHAR), '') AS delta_score, action, action_reason FROM ha",
)
def host_action(spark, sf):
    return _view(spark, sf).top.select(*HOST, "score", shown("delta_score").alias("delta_score"), "action", "action_reason")


@query(
    "incident_cluster_lookup",
    """
    SELECT ic.run_id, ic.incident_id, cs.signature_key AS cluster_key, cs.status AS cluster_status
    FROM ic LEFT JOIN cs ON cs.run_id = ic.run_id AND cs.signature_hash = ic.signature_hash
    """,
)
def incident_cluster_lookup(spark, sf):
    _, incidents = _tables(spark, sf)
    found = fleet.incident_cluster_lookup(incidents, _statuses(spark, sf, incidents))
    return found.select("run_id", "incident_id", "cluster_key", "cluster_status")


@query(
    "fleet_summary",
    """
    SELECT run_id, strftime(window_start, '%Y-%m-%d %H:%M:%S.%f') AS window_start,
           strftime(window_end, '%Y-%m-%d %H:%M:%S.%f') AS window_end, host_count, incident_count, cluster_count,
           overall_risk_score FROM fs
    """,
)
def fleet_summary(spark, sf):
    return _view(spark, sf).summary.select(
        "run_id", ts_text("window_start").alias("window_start"), ts_text("window_end").alias("window_end"),
        "host_count", "incident_count", "cluster_count", "overall_risk_score",
    )


@query("executive_summary", "SELECT run_id, executive_summary FROM fs")
def executive_summary(spark, sf):
    return _view(spark, sf).summary.select("run_id", "executive_summary")


@query(
    "filter_clusters",
    """
    SELECT run_id, signature_hash, type, affected_hosts, status FROM cs
    WHERE type IN ('bsod', 'disk_full') AND status = 'ongoing' AND affected_hosts >= 3
    """,
)
def filter_clusters(spark, sf):
    kept = fleet.filter_clusters(_statuses(spark, sf, _incidents(spark, sf)), ["bsod", "disk_full"], "ongoing", 3)
    return kept.select("run_id", "signature_hash", "type", "affected_hosts", "status")


@query(
    "filter_hosts",
    """
    SELECT run_id, host_id, user_id, score FROM th
    WHERE score >= 75 AND (contains(lower(host_id), 'user1') OR contains(lower(coalesce(user_id, '')), 'user1'))
    """,
)
def filter_hosts(spark, sf):
    top = fleet.top_hosts(*_tables(spark, sf))
    return fleet.filter_hosts(top, 75, "USER1").select(*HOST, "user_id", "score")


@query("host_options", "SELECT DISTINCT run_id, host_id FROM (SELECT run_id, host_id FROM th UNION ALL SELECT run_id, host_id FROM hw)")
def host_options(spark, sf):
    windows, incidents = _tables(spark, sf)
    return fleet.host_options(fleet.top_hosts(windows, incidents), windows)


# -- evaluation -------------------------------------------------------------------------------

_TRUTH_SQL = """
(SELECT run_id, list_sort(list(DISTINCT CASE kind WHEN 'bsod' THEN 'bsod' WHEN 'svc' THEN 'service_crash_loop'
   WHEN 'disk' THEN 'disk_full' WHEN 'net' THEN 'network_instability' ELSE 'update_failure' END)) AS expected
 FROM (SELECT run_id, host_id, kind, count(*) AS n FROM ev WHERE kind <> 'info' GROUP BY 1, 2, 3)
 WHERE kind <> 'svc' OR n >= 2 GROUP BY run_id)
"""
_DETECTED_SQL = "(SELECT run_id, list_sort(list(DISTINCT type)) AS detected FROM ic GROUP BY run_id)"


@query(
    "detected_vs_expected_types",
    f"""
    SELECT t.run_id, array_to_string(t.expected, '|') AS expected_types, array_to_string(d.detected, '|') AS detected_types,
           CAST(len(list_intersect(t.expected, d.detected)) AS INT) AS hits
    FROM {_TRUTH_SQL} t LEFT JOIN {_DETECTED_SQL} d ON d.run_id = t.run_id
    """,
)
def detected_vs_expected_types(spark, sf):
    found = rules.detect_incidents(tb.endpoint_events(spark, sf))
    sets = evaluate.detected_vs_expected_types(tb.truth(spark, sf), found)
    return sets.select(
        "run_id", joined("expected_types").alias("expected_types"), joined("detected_types").alias("detected_types"), "hits"
    )


@query(
    "type_precision_recall",
    f"""
    SELECT t.run_id, len(list_intersect(t.expected, d.detected))::DOUBLE / greatest(1, len(d.detected)) AS precision,
           len(list_intersect(t.expected, d.detected))::DOUBLE / greatest(1, len(t.expected)) AS recall
    FROM {_TRUTH_SQL} t LEFT JOIN {_DETECTED_SQL} d ON d.run_id = t.run_id
    """,
)
def type_precision_recall(spark, sf):
    found = rules.detect_incidents(tb.endpoint_events(spark, sf))
    return evaluate.type_precision_recall(tb.truth(spark, sf), found)


_EXPECTED_SQL = """
(SELECT run_id, host_id FROM (SELECT run_id, host_id, count(*) AS n FROM ev WHERE kind = 'bsod' GROUP BY 1, 2)
 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, host_id) <= 5)
"""
_RANKING_SQL = f"""
(SELECT w.run_id, count(*) FILTER (WHERE th.host_rank <= w.k)::DOUBLE / count(*) AS ranking_score
 FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS k FROM {_EXPECTED_SQL}) w
 LEFT JOIN th ON th.run_id = w.run_id AND th.host_id = w.host_id GROUP BY w.run_id)
"""


def _expected_hosts(spark: SparkSession, sf: str) -> DataFrame:
    counts = tb.event_views(spark, sf).filter(F.col("kind") == "bsod").groupBy(*HOST).agg(F.count(F.lit(1)).alias("n"))
    return first_per_group(counts, ["run_id"], [F.col("n").desc(), F.col("host_id").asc()], 5).select(*HOST)


@query(
    "ranking_hit_rate",
    f"SELECT rn.run_id, coalesce(s.ranking_score, 1.0::DOUBLE) AS ranking_score FROM rn LEFT JOIN {_RANKING_SQL} s ON s.run_id = rn.run_id",
)
def ranking_hit_rate(spark, sf):
    top = fleet.top_hosts(*_tables(spark, sf))
    return evaluate.ranking_hit_rate(_expected_hosts(spark, sf), top, tb.runs(spark, sf))


@query(
    "cluster_hit",
    "SELECT rn.run_id, coalesce(bool_or(cl.affected_hosts >= 2), false) AS cluster_detected FROM rn LEFT JOIN cl ON cl.run_id = rn.run_id GROUP BY 1",
)
def cluster_hit(spark, sf):
    return evaluate.cluster_hit(fleet.clusters(_incidents(spark, sf)), tb.runs(spark, sf))


_WARN_SQL = """
SELECT rn.run_id, 'time_skew scenario host count mismatch' AS warning
FROM rn WHERE (SELECT count(*) FROM hw WHERE hw.run_id = rn.run_id AND hw.host_id <> 'HOST-00003')
           <> (SELECT count(DISTINCT host_id) FROM sn WHERE sn.run_id = rn.run_id)
UNION ALL
SELECT rn.run_id, 'expected clustered outage but none detected'
FROM rn WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.run_id = rn.run_id AND cl.affected_hosts >= 2)
"""


@query("scenario_checks", _WARN_SQL)
def scenario_checks(spark, sf):
    windows, incidents = _tables(spark, sf)
    # One host is left out of the counted hosts, so that the host count check has something to find.
    counted = windows.filter(F.col("host_id") != "HOST-00003").groupBy("run_id").agg(F.count(F.lit(1)).alias("host_count"))
    return evaluate.scenario_checks(tb.truth(spark, sf), fleet.clusters(incidents), counted, tb.snapshots(spark, sf))


@query(
    "validation_report",
    f"""
    SELECT t.run_id, len(list_intersect(t.expected, d.detected))::DOUBLE / greatest(1, len(d.detected)) AS precision,
           len(list_intersect(t.expected, d.detected))::DOUBLE / greatest(1, len(t.expected)) AS recall,
           coalesce(s.ranking_score, 1.0::DOUBLE) AS ranking_score,
           EXISTS (SELECT 1 FROM cl WHERE cl.run_id = t.run_id AND cl.affected_hosts >= 2) AS cluster_detected,
           (SELECT count(*) FROM rn WHERE rn.run_id = t.run_id AND NOT EXISTS (
              SELECT 1 FROM cl WHERE cl.run_id = t.run_id AND cl.affected_hosts >= 2)) AS scenario_warnings,
           0::BIGINT AS violations
    FROM {_TRUTH_SQL} t LEFT JOIN {_DETECTED_SQL} d ON d.run_id = t.run_id LEFT JOIN {_RANKING_SQL} s ON s.run_id = t.run_id
    """,
)
def validation_report(spark, sf):
    view = _view(spark, sf)
    violations = flow.run_violations(view, timeline.host_events(tb.endpoint_events(spark, sf)))
    return flow.validate_runs(view, tb.truth(spark, sf), _expected_hosts(spark, sf), tb.runs(spark, sf), violations)


# -- ledger -----------------------------------------------------------------------------------


@query(
    "history_trim",
    """
    SELECT run_id, signature_hash, affected_hosts, severity FROM cl
    WHERE run_id IN (SELECT run_id FROM rn ORDER BY run_id DESC LIMIT 7)
    """,
)
def history_trim(spark, sf):
    kept = ledger.history_trim(fleet.clusters(_incidents(spark, sf)), tb.runs(spark, sf))
    return kept.select("run_id", "signature_hash", "affected_hosts", "severity")


@query(
    "scan_history",
    """
    SELECT r.run_id, (SELECT count(*) FROM cl WHERE cl.run_id = r.run_id) AS clusters,
           (SELECT count(*) FROM th WHERE th.run_id = r.run_id) AS top_hosts, r.recency
    FROM (SELECT run_id, row_number() OVER (ORDER BY run_id DESC) AS recency FROM rn) r WHERE r.recency <= 7
    """,
)
def scan_history(spark, sf):
    windows, incidents = _tables(spark, sf)
    found = ledger.scan_history(fleet.clusters(incidents), fleet.top_hosts(windows, incidents))
    return found.withColumn("recency", F.col("recency").cast("bigint"))


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger rows of the runs: a time for most of them, some pinned, some failed."""
    number = F.substring("run_id", 5, 8).cast("int")
    per_run = tb.endpoint_events(spark, sf).groupBy("run_id").agg(F.max("ts").alias("last_ts"))
    return per_run.select(
        "run_id",
        F.when(number % 6 != 0, F.col("last_ts")).alias("generated_at"),
        (number % 5 == 0).alias("pinned"),
        F.when(number % 4 == 0, "failure").otherwise("success").alias("status"),
        F.col("last_ts").alias("finished_at"),
    )


@query(
    "expired_runs",
    """
    SELECT run_id FROM (SELECT run_id, CAST(substr(run_id, 5) AS INT) AS n, max(ts) AS last_ts FROM ev GROUP BY run_id)
    WHERE n % 6 <> 0 AND n % 5 <> 0 AND last_ts < TIMESTAMP '2024-01-29 00:00:00' AND run_id NOT IN ('run-20240103', 'history')
    """,
)
def expired_runs(spark, sf):
    return ledger.expired_runs(_ledger(spark, sf), as_of(), 48, "run-20240103").select("run_id")


@query(
    "latest_run",
    """
    SELECT arg_max(run_id, last_ts) AS run_id FROM (
      SELECT run_id, CAST(substr(run_id, 5) AS INT) AS n, max(ts) AS last_ts FROM ev GROUP BY run_id) WHERE n % 4 <> 0
    """,
)
def latest_run(spark, sf):
    return ledger.latest_run(_ledger(spark, sf))


@query(
    "run_status",
    """
    SELECT run_id, CASE WHEN n % 3 = 0 THEN 'running' WHEN n % 4 = 0 THEN 'failure' ELSE 'success' END AS status,
           strftime(lo, '%Y-%m-%d %H:%M:%S.%f') AS started_at,
           CASE WHEN n % 3 <> 0 THEN strftime(hi, '%Y-%m-%d %H:%M:%S.%f') END AS finished_at
    FROM (SELECT run_id, CAST(substr(run_id, 5) AS INT) AS n, min(ts) AS lo, max(ts) AS hi FROM ev GROUP BY run_id)
    """,
)
def run_status(spark, sf):
    number = F.substring("run_id", 5, 8).cast("int")
    per_run = tb.endpoint_events(spark, sf).groupBy("run_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    ended = per_run.filter(number % 3 != 0).select(
        "run_id", F.when(number % 4 == 0, "failure").otherwise("success").alias("status"), F.col("hi").alias("at")
    )
    entries = per_run.select("run_id", F.lit("running").alias("status"), F.col("lo").alias("at")).unionByName(ended)
    return ledger.run_status(entries).select(
        "run_id", "status", ts_text("started_at").alias("started_at"), ts_text("finished_at").alias("finished_at")
    )


@query(
    "host_report",
    """
    SELECT hw.run_id, hw.host_id,
           CASE ha.action WHEN 'contact' THEN 'Contact user' WHEN 'ignore' THEN 'OK' ELSE 'Investigate' END AS verdict,
           coalesce(array_to_string(i.reasons[1:2], '|'), 'No incidents detected') AS reasons,
           coalesce(i.evidence, '—') AS evidence_line
    FROM hw LEFT JOIN ha ON ha.run_id = hw.run_id AND ha.host_id = hw.host_id
    LEFT JOIN (SELECT ic.run_id, ic.host_id, list(ic.type || ' (sev ' || ic.severity || ')' ORDER BY ic.rule_no) AS reasons,
                      arg_min(e.ts_raw || ' ' || e.provider || ' ' || e.event_id || ' ' || e.message, (-ic.severity, ic.rule_no)) AS evidence
               FROM ic JOIN mr e ON e.run_id = ic.run_id AND e.host_id = ic.host_id AND e.rule_no = ic.rule_no AND e.evidence_rank = 1
               GROUP BY ic.run_id, ic.host_id) i ON i.run_id = hw.run_id AND i.host_id = hw.host_id
    """,
)
def host_report(spark, sf):
    events = tb.endpoint_events(spark, sf)
    matches = rules.staged_matches(events)
    windows, incidents = flow.incident_table(events, tb.snapshots(spark, sf), matches=matches)
    view = flow.fleet_view(windows, incidents, tb.runs(spark, sf))
    first = rules.incident_evidence(matches, limit=1, matched=True)
    report = ledger.host_report(view.windows, view.incidents, first, view.top)
    return report.select(*HOST, "verdict", joined("reasons").alias("reasons"), "evidence_line")


# -- sinks ------------------------------------------------------------------------------------


@query(
    "write_host_timelines",
    """
    SELECT hs.run_id, hs.host_id, hs.user_id, hs.score AS severity, strftime(span.hi, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS last_event_ts,
      strftime(hw.window_end, '%Y-%m-%dT%H:%M:%S') AS window_end, d.events, d.message_sum, CAST(hs.incidents AS INT) AS incidents,
      coalesce(p.evidence, 0) AS evidence, coalesce(p.evidence_sum, 0) AS evidence_sum, coalesce(p.types, '') AS types,
      coalesce(t.tickets, '') AS tickets
    FROM hs JOIN span ON span.run_id = hs.run_id AND span.host_id = hs.host_id JOIN hw ON hw.run_id = hs.run_id AND hw.host_id = hs.host_id
    JOIN (SELECT run_id, host_id, count(*) AS events, CAST(sum(place * (record_id + length(message))) AS BIGINT) AS message_sum
          FROM (SELECT *, row_number() OVER (PARTITION BY run_id, host_id ORDER BY ts, ts_raw, snap_rank, pos) AS place FROM dd)
          GROUP BY run_id, host_id) d ON d.run_id = hs.run_id AND d.host_id = hs.host_id
    LEFT JOIN (SELECT run_id, host_id, count(*) AS evidence, CAST(sum(evidence_rank * (record_id + length(message))) AS BIGINT) AS evidence_sum,
            string_agg(DISTINCT r.type, '|' ORDER BY r.type) AS types
          FROM mr JOIN rule r ON r.rule_no = mr.rule_no AND mr.n >= r.min_n GROUP BY run_id, host_id) p ON p.run_id = hs.run_id AND p.host_id = hs.host_id
    LEFT JOIN (SELECT 'run-' || strftime(ts, '%Y%m%d') AS run_id, 'HOST-' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS host_id,
            string_agg('TICKET-' || lpad(CAST(event_id AS VARCHAR), 6, '0'), '|' ORDER BY event_id) AS tickets
          FROM events WHERE event_type = 'signup' AND event_id % 9 <> 0 GROUP BY ALL) t ON t.run_id = hs.run_id AND t.host_id = hs.host_id
    """,
)
def write_host_timelines(spark, sf):
    """Whole documents written as lines, put together again and parsed."""
    windows, incidents = _tables(spark, sf)
    unique = stage(timeline.host_events(tb.endpoint_events(spark, sf)), "host-events")
    line = timeline.host_timeline(windows, unique, incidents)
    evidence = rules.incident_evidence(unique, redaction="off", deduplicated=True)
    tickets = ingest.tickets_by_host(tb.tickets(spark, sf))
    lines = host_documents.document_lines(line, unique, incidents, evidence, as_of(), tickets)
    path = host_documents.write_host_timelines(lines, _scratch(spark, "export"))
    event = "array<struct<record_id: bigint, message: string>>"
    schema = (
        f"host_id string, user_id string, window struct<end: string>, last_event_ts string, severity int, events {event}, "
        f"incidents array<struct<type: string, evidence: {event}>>, tickets array<struct<ticket_id: string>>"
    )
    parsed = read_documents(spark, path).select("run_id", F.from_json("document", schema).alias("d")).select("run_id", "d.*")
    proofs = F.flatten(F.transform("incidents", lambda i: i["evidence"]))

    def weighed(rows):
        # Place by place, so that a wrong order shows.
        return F.aggregate(
            F.transform(rows, lambda e, i: (i + 1) * (e["record_id"] + F.length(e["message"]))), F.lit(0).cast("bigint"), lambda a, b: a + b
        )

    sums = F.transform("incidents", lambda i: weighed(i["evidence"]))
    return parsed.select(
        *HOST, "user_id", "severity", "last_event_ts", F.substring("window.end", 1, 19).alias("window_end"),
        F.size("events").cast("bigint").alias("events"), weighed(F.col("events")).alias("message_sum"), F.size("incidents").alias("incidents"),
        F.size(proofs).cast("bigint").alias("evidence"), F.aggregate(sums, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("evidence_sum"),
        joined(F.array_sort(F.transform("incidents", lambda i: i["type"]))).alias("types"),
        joined(F.transform("tickets", lambda t: t["ticket_id"])).alias("tickets"),
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, document``: the lines of each run in order of its files, cut at the first line of each host."""
    lines = spark.read.schema("value string, run_id string").text(path).select(
        "run_id", "value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    order = Window.partitionBy("run_id").orderBy("file", "block", "at")
    opens = F.col("value").startswith('{"schema_version":"1.0","host_id"').cast("int")
    numbered = lines.withColumns({"n": F.sum(opens).over(order), "place": F.row_number().over(order)})
    whole = numbered.groupBy("run_id", "n").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("lines"))
    return whole.select("run_id", F.array_join(F.transform("lines", lambda x: x["value"]), "").alias("document"))


@query("write_fleet", "SELECT run_id, overall_risk_score, executive_summary FROM fs")
def write_fleet(spark, sf):
    path = sinks.write_fleet(_view(spark, sf).summary, _scratch(spark, "fleet"))
    back = spark.read.schema("value string, run_id string").text(path)
    fields = F.from_json("value", "overall_risk_score int, executive_summary string")
    return back.select("run_id", fields.alias("d")).select("run_id", "d.*")


@query(
    "retire_runs",
    """
    SELECT run_id, CASE WHEN day % 4 = 0 THEN 'a2' ELSE 'a1' END AS attempt, hosts,
      CASE WHEN day + 1 < 21 THEN 1 ELSE 1 + CAST(day % 4 = 0 AS INT) + CAST(day % 3 = 0 AS INT) END AS kept
    FROM (SELECT run_id, CAST(substr(run_id, 11) AS INT) AS day, count(DISTINCT host_id) AS hosts FROM sn GROUP BY run_id)
    WHERE day + 1 >= 21 OR day % 5 = 0
    """,
)
def retire_runs(spark, sf):
    """Hosts of every run under one to three attempts; old runs and attempts are retired and deleted, pinned ones stay."""
    root = _scratch(spark, "retention")
    hosts = stage(tb.snapshots(spark, sf).select(*HOST).distinct(), "run-hosts")
    day = F.substring("run_id", 11, 2).cast("int")
    for attempt, status, wanted in (("a1", "success", F.lit(True)), ("a2", "success", day % 4 == 0), ("a3", "failure", day % 3 == 0)):
        part = hosts.filter(wanted)
        sinks.write_run_table(part, root, "run_hosts", attempt)
        at = F.timestamp_add("DAY", day, F.lit("2024-01-01 00:00:00").cast("timestamp"))
        entries = part.select("run_id").distinct().select(
            "run_id", F.lit(attempt).alias("attempt"), F.lit(status).alias("status"), at.alias("at"), F.lit(0).cast("long").alias("violations")
        )
        entries.write.mode("append").parquet(f"{root}/runs")
    pinned = hosts.select("run_id").distinct().filter(day % 5 == 0)
    sinks.retire_runs(spark, root, as_of(), 240, pinned=pinned, dry_run=False)
    sinks.delete_retired(spark, root, as_of(), grace_hours=0, dry_run=False)
    stored = spark.read.parquet(f"{root}/run_hosts").groupBy("run_id").agg(F.countDistinct("attempt").cast("int").alias("kept"))
    shown_ = sinks.read_published(spark, root, "run_hosts").groupBy("run_id", "attempt").agg(F.count(F.lit(1)).alias("hosts"))
    return shown_.join(stored, "run_id")


@query(
    "append_audit",
    """
    SELECT 'timeline' AS event, run_id, count(*) AS entries FROM hw GROUP BY run_id
    UNION ALL SELECT 'fleet', run_id, 1 FROM rn
    """,
)
def append_audit(spark, sf):
    root = _scratch(spark, "audit")
    hosts = tb.snapshots(spark, sf).select(*HOST).distinct()
    sinks.append_audit(sinks.audit_event(hosts, "timeline", as_of()), root)
    runs = tb.runs(spark, sf).withColumn("host_id", F.lit(None).cast("string"))
    path = sinks.append_audit(sinks.audit_event(runs, "fleet", as_of(), stage=F.lit("done")), root)
    back = spark.read.parquet(path)
    return back.groupBy("event", "run_id").agg(F.count(F.lit(1)).alias("entries"))


# -- quality ----------------------------------------------------------------------------------


def _dirty_events(spark: SparkSession, sf: str) -> DataFrame:
    """All events, with faults planted by the value of ``k`` in all but the first five runs."""
    k = F.when(F.col("run_id") > "run-20240105", F.col("k").cast("int"))
    long = F.repeat("message", 200)
    return tb.event_views(spark, sf).withColumns(
        {
            "level": F.when(k == 13, "Notice").when(k == 14, F.lit(None)).otherwise(F.col("level")),
            "message": F.when(k == 17, "").when(k == 18, long).otherwise(F.col("message")),
            "tags": F.when(k == 19, F.array(F.lit("Bad Tag"), F.lit("ok"))).when(
                k == 20, F.array(F.lit("ok"), F.lit("ok"))
            ).otherwise(F.col("tags")),
            "ts_raw": F.when(k == 23, F.regexp_replace("ts_raw", "Z", "")).otherwise(F.col("ts_raw")),
        }
    )


_DIRTY_EVENT_SQL = """
(SELECT record_id, 'level' AS path, 'enum' AS rule, 'Notice' AS value FROM evf WHERE k = '13'
 UNION ALL SELECT record_id, 'level', 'required', NULL FROM evf WHERE k = '14'
 UNION ALL SELECT record_id, 'message', 'min_length', '' FROM evf WHERE k = '17'
 UNION ALL SELECT record_id, 'message', 'max_length', substr(repeat(message, 200), 1, 64) FROM evf WHERE k = '18' AND length(message) > 20
 UNION ALL SELECT record_id, 'tags', 'item_pattern', 'Bad Tag' FROM evf WHERE k = '19'
 UNION ALL SELECT record_id, 'tags', 'unique_items', 'ok,ok' FROM evf WHERE k = '20'
 UNION ALL SELECT record_id, 'ts_raw', 'iso8601', replace(ts_raw, 'Z', '') FROM evf WHERE k = '23')
"""


@query("dq_violations_event", f"SELECT 'event' AS entity, * FROM {_DIRTY_EVENT_SQL}")
def dq_violations_event(spark, sf):
    return quality.dq_violations(_dirty_events(spark, sf), "event", ["record_id"], quality.event_checks())


@query(
    "dq_gate",
    f"""
    SELECT rn.run_id, count(v.path) AS violations, count(v.path) = 0 AS passed FROM rn
    LEFT JOIN (SELECT ev.run_id, x.path FROM {_DIRTY_EVENT_SQL} x JOIN ev ON ev.record_id = x.record_id) v
    ON v.run_id = rn.run_id GROUP BY rn.run_id
    """,
)
def dq_gate(spark, sf):
    found = quality.dq_violations(_dirty_events(spark, sf), "event", ["run_id"], quality.event_checks())
    return quality.dq_gate(tb.runs(spark, sf), found)


@query(
    "dq_violations_snapshot",
    """
    SELECT 'snapshot' AS entity, key, v.path, v.rule, v.value FROM sn, LATERAL (
      SELECT * FROM (VALUES
        ('window.start', 'required', NULL, window_start IS NULL),
        ('window.end', 'required', NULL, window_end IS NULL),
        ('$', 'additional_property', 'site', user_no % 6 = 1),
        ('window', 'additional_property', 'zone', user_no % 6 = 2),
        ('schema_version', 'enum', '2.0', user_no % 6 = 3),
        ('stats.event_count', 'range', '-1', user_no % 6 = 4)) t(path, rule, value, bad) WHERE bad) v
    """,
)
def dq_violations_snapshot(spark, sf):
    group = F.col("user_no") % 6
    empty = F.lit(None).cast("string")
    raw = tb.snapshots(spark, sf).select(
        "key",
        F.to_json(
            F.struct(
                F.when(group == 3, "2.0").otherwise("1.0").alias("schema_version"),
                F.concat_ws("-", *HOST).alias("snapshot_id"),
                "host_id",
                "user_id",
                F.lit(tb.AS_OF).alias("generated_at"),
                F.struct(
                    F.col("window_start_raw").alias("start"),
                    F.col("window_end_raw").alias("end"),
                    F.when(group == 2, "utc").otherwise(empty).alias("zone"),
                ).alias("window"),
                F.array().cast("array<string>").alias("events"),
                F.struct(F.when(group == 4, -1).otherwise(F.col("event_count")).alias("event_count")).alias("stats"),
                F.when(group == 1, "north").otherwise(empty).alias("site"),
            )
        ).alias("raw"),
    )
    parsed = raw.select("key", "raw", F.from_json("raw", SNAPSHOT).alias("d")).select("key", "raw", "d.*")
    checks = quality.snapshot_checks(nested=True) + quality.extra_property_checks("snapshot")
    return quality.dq_violations(parsed, "snapshot", ["key"], checks)


@query(
    "dq_violations_incident",
    """
    SELECT 'incident' AS entity, run_id, incident_id, v.path, v.rule, v.value FROM ic, LATERAL (
      SELECT * FROM (VALUES ('severity', 'range', CAST(severity + 60 AS VARCHAR), severity + 60 > 100 AND event_count % 2 = 0),
        ('type', 'enum', type || '_x', rule_no = 5)) t(path, rule, value, bad) WHERE bad) v
    """,
)
def dq_violations_incident(spark, sf):
    found = _incidents(spark, sf).withColumns(
        {
            "severity": F.when(F.col("event_count") % 2 == 0, F.col("severity") + 60).otherwise(F.col("severity")),
            "type": F.when(F.col("rule_no") == 5, F.concat("type", F.lit("_x"))).otherwise(F.col("type")),
            "recommended_actions": rules.recommended_actions(F.col("type")),
        }
    )
    return quality.dq_violations(found, "incident", ["run_id", "incident_id"], quality.incident_checks())


@query(
    "dq_violations_ticket",
    """
    SELECT 'ticket' AS entity, ticket_id, v.path, v.rule, v.value FROM (
      SELECT 'TICKET-' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS ticket_id, event_id FROM events WHERE event_type = 'signup'), LATERAL (
      SELECT * FROM (VALUES ('host_id', 'required', NULL, event_id % 9 = 0), ('source', 'enum', 'fax', event_id % 4 = 0),
        ('created_at', 'iso8601', 'yesterday', event_id % 5 = 0), ('reported_window.end', 'required', NULL, event_id % 7 = 0),
        ('symptoms', 'item_length', '', event_id % 8 = 0)) t(path, rule, value, bad) WHERE bad) v
    """,
)
def dq_violations_ticket(spark, sf):
    number = F.regexp_extract("ticket_id", "[0-9]+", 0).cast("bigint")
    stamp = F.lit(tb.AS_OF)
    window = F.struct(stamp.alias("start"), F.lit(None).cast("string").alias("end"))
    tickets = tb.tickets(spark, sf).select(
        F.lit("1.0").alias("schema_version"),
        "ticket_id",
        F.when(number % 4 == 0, "fax").otherwise("portal").alias("source"),
        F.when(number % 5 == 0, "yesterday").otherwise(stamp).alias("created_at"),
        "host_id",
        F.lit(None).cast("string").alias("user_id"),
        "subject",
        F.col("subject").alias("body"),
        F.when(number % 7 == 0, window).alias("reported_window"),
        F.when(number % 8 == 0, F.array(F.lit(""))).otherwise(F.array(F.lit("slow"))).alias("symptoms"),
    )
    return quality.dq_violations(tickets, "ticket", ["ticket_id"], quality.ticket_checks())


@query(
    "dq_violations_fleet",
    """
    SELECT 'fleet' AS entity, run_id, path, rule, value FROM (
      SELECT run_id, 'overall_risk_score' AS path, 'range' AS rule, CAST(overall_risk_score + 50 AS VARCHAR) AS value
      FROM fs WHERE overall_risk_score + 50 > 100
      UNION ALL SELECT run_id, 'generated_at', 'iso8601', 'now' FROM fs WHERE incident_count % 2 = 0
      UNION ALL SELECT run_id, 'top_hosts.' || path, rule, value FROM (
        SELECT run_id, 'action' AS path, 'enum' AS rule, 'call' AS value FROM ha WHERE host_rank = 2))
    """,
)
def dq_violations_fleet(spark, sf):
    view = _view(spark, sf)
    summary = view.summary.withColumns(
        {
            "overall_risk_score": F.col("overall_risk_score") + 50,
            "generated_at": F.when(F.col("incident_count") % 2 == 0, "now").otherwise(iso_text(as_of())),
        }
    )
    hosts = view.top.withColumn("action", F.when(F.col("host_rank") == 2, "call").otherwise(F.col("action")))
    on_hosts = quality.dq_violations(hosts, "fleet", ["run_id"], quality.top_host_checks())
    on_clusters = quality.dq_violations(view.clusters, "fleet", ["run_id"], quality.cluster_checks())
    return (
        quality.dq_violations(summary, "fleet", ["run_id"], quality.fleet_checks())
        .unionByName(on_hosts.withColumn("path", F.concat(F.lit("top_hosts."), "path")))
        .unionByName(on_clusters.withColumn("path", F.concat(F.lit("clusters."), "path")))
    )


@query(
    "dq_violations_manifest",
    """
    SELECT 'manifest' AS entity, run_id, v.path, v.rule, v.value FROM (SELECT run_id, CAST(substr(run_id, 5) AS INT) AS n FROM rn), LATERAL (
      SELECT * FROM (VALUES ('schema_version', 'required', NULL, n % 3 = 0), ('window', 'required', NULL, n % 4 = 0),
        ('generator', 'additional_property', 'host', n % 2 = 0)) t(path, rule, value, bad) WHERE bad) v
    """,
)
def dq_violations_manifest(spark, sf):
    number = F.substring("run_id", 5, 8).cast("int")
    per_run = tb.endpoint_events(spark, sf).groupBy("run_id").agg(F.min("ts_raw").alias("lo"), F.max("ts_raw").alias("hi"))
    window = F.struct(F.col("lo").alias("start"), F.col("hi").alias("end"))
    files = F.array(F.struct(F.lit("snapshots").alias("kind"), F.concat("run_id", F.lit("/snapshots")).alias("path")))
    manifests = per_run.select(
        F.when(number % 3 != 0, "1.0").alias("schema_version"),
        "run_id",
        F.col("hi").alias("created_at"),
        F.when(number % 4 != 0, window).alias("window"),
        F.struct(F.lit("worker").alias("name"), F.when(number % 2 == 0, "a").alias("host")).alias("generator"),
        F.array(F.lit("daily")).alias("scenario_tags"),
        files.alias("inputs"),
        files.alias("outputs"),
    )
    with_raw = manifests.withColumn("raw", F.to_json(F.struct(*manifests.columns)))
    checks = quality.manifest_checks() + quality.extra_property_checks("manifest")
    return quality.dq_violations(with_raw, "manifest", ["run_id"], checks)


# -- streaming and the whole flow ---------------------------------------------------------------


@query(
    "stream_detect",
    """
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, host_id, r.type, count(*) AS event_count
    FROM mt JOIN rule r ON r.rule_no = mt.rule_no GROUP BY 1, 2, 3
    """,
)
def stream_detect(spark, sf):
    path, out = _landed(spark, sf), _scratch(spark, "stream-out")
    # A closing document days later moves the watermark past the last window.
    closing = snapshot_documents(spark, sf).agg(F.max("key").alias("key")).select(
        "key",
        F.lit("HOST-END").alias("host_id"),
        F.array(
            F.struct(F.lit("2030-01-01T00:00:00Z").alias("ts"), F.lit("end").alias("message"), F.lit("end").alias("provider"))
        ).alias("events"),
    )
    closing.write.mode("append").json(path)
    counts = stream.rule_counts(stream.snapshot_stream(spark, path, layout="lines"))
    started = stream.stream_detect(counts, out, _scratch(spark, "stream-state"))
    started.awaitTermination()
    schema = "window_start timestamp, window_end timestamp, host_id string, type string, event_count long, batch_id int"
    found = spark.read.schema(schema).parquet(out)
    return found.select(ts_text("window_start").alias("window_start"), "host_id", "type", "event_count")


@query("run_incident_flow", "SELECT run_id, host_count, incident_count, cluster_count, overall_risk_score FROM fs")
def run_incident_flow(spark, sf):
    path = _landed(spark, sf, closed=True)
    scanned = docs.scan_snapshots(spark, path, layout="lines").withColumn("run_id", _run_of())
    root = _scratch(spark, "flow")
    flow.run_incident_flow(scanned, root, as_of(), window_hours=24 * 60, mode="all")
    back = sinks.read_published(spark, root, "fleet_summary")
    return back.select("run_id", "host_count", "incident_count", "cluster_count", "overall_risk_score")


@query(
    "parse_ts",
    """
    SELECT event_id, CASE event_id % 9 WHEN 3 THEN '' WHEN 4 THEN '' WHEN 6 THEN '' WHEN 7 THEN '' WHEN 8 THEN ''
        WHEN 1 THEN CAST(epoch_us(ts) - 7200000000 AS VARCHAR) WHEN 2 THEN CAST(epoch_us(date_trunc('second', ts)) AS VARCHAR)
        ELSE CAST(epoch_us(ts) AS VARCHAR) END AS micros FROM events
    """,
)
def parse_ts_query(spark, sf):
    stamp = "yyyy-MM-dd'T'HH:mm:ss"
    group = F.col("event_id") % 9
    full = F.date_format("ts", stamp + ".SSSSSS")
    raw = (
        F.when(group == 0, F.concat(full, F.lit("Z")))
        .when(group == 1, F.concat(full, F.lit("+02:00")))
        .when(group == 2, F.concat(F.date_format("ts", stamp), F.lit("Z")))
        .when(group == 3, "")
        .when(group == 4, "not a time")
        .when(group == 6, F.date_format("ts", "HH:mm:ss"))
        .when(group == 7, F.date_format("ts", "yyyy"))
        .when(group == 8, F.date_format("ts", "yyyy-MM"))
        .otherwise(F.concat(full, F.lit("7+00:00")))
    )
    return tb.table(spark, sf, "events").select("event_id", shown(F.unix_micros(parse_ts(raw))).alias("micros"))

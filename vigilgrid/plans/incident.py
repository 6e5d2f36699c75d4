"""Incident flow: many runs and hosts in one job, from snapshots to a published summary."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_user, iso_text, redact_message
from ..operators import evaluate, fleet, ingest, ledger, quality, rules, timeline
from ..session import stage, staging
from ..sources import host_documents, sinks


@dataclass
class FleetView:
    """Tables of the cross-host part of the flow."""

    windows: DataFrame
    incidents: DataFrame
    clusters: DataFrame
    top: DataFrame
    summary: DataFrame


def incident_table(
    events: DataFrame,
    snapshots: DataFrame,
    as_of: Column | None = None,
    redaction: str = "balanced",
    rule_set: Sequence[rules.Rule] = rules.DEFAULT_RULES,
    prepared: bool = False,
    salt: str | None = None,
    matches: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Host windows and incidents, staged because every later step reads them several times.

    ``prepared`` events are deduplicated and redacted already. ``matches`` are the ``rules.staged_matches``
    of the events, where other steps need them too.
    """
    windows = timeline.host_windows(snapshots, events, as_of)
    windows = stage(windows.withColumn("user_id", hash_user(F.col("user_id"), redaction, salt)), "windows")
    mode = "off" if prepared else redaction
    known = matches is not None
    found = rules.detect_incidents(
        matches if known else events, windows, rule_set, mode, deduplicated=prepared, matched=known
    )
    return windows, stage(found, "incidents")


def fleet_view(
    windows: DataFrame,
    incidents: DataFrame,
    runs: DataFrame,
    old_clusters: DataFrame | None = None,
    old_scores: DataFrame | None = None,
    current: DataFrame | None = None,
) -> FleetView:
    """Clusters, ranking and summary; ``old_*`` hold what earlier jobs found in earlier runs.

    ``current`` names the runs of this job, which have a summary even without a host.
    """
    found = fleet.cluster_status(fleet.clusters(incidents), runs, old_clusters)
    clusters = stage(found, "clusters")
    # The few ranked hosts are read twice; without staging all hosts would be scored twice.
    ranked = stage(fleet.top_hosts(windows, incidents), "ranked-hosts")
    top = stage(fleet.host_action(ranked, clusters, runs, old_scores), "top-hosts")
    summary = fleet.fleet_summary(windows, incidents, clusters, top, current)
    return FleetView(windows, incidents, clusters, top, summary)


def published_history(
    spark: SparkSession, root: str, current: DataFrame
) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """Clusters, scores and ids of the published runs right before the runs of this job.

    Every run needs its predecessor only: the greatest id below its own, whether that was published
    or belongs to this job. Other partitions are not read.
    """
    if not sinks.has_runs(spark, root):
        return None, None, current
    known = sinks.published_attempts(spark, root).select("run_id").union(current).distinct()
    before = fleet.previous_run(known).join(current, "run_id", "left_semi")
    before = before.select(F.col("prev_run_id").alias("run_id")).filter(F.col("run_id").isNotNull()).distinct()
    earlier = before.join(current, "run_id", "left_anti")
    clusters = sinks.read_published(spark, root, "clusters").join(earlier, "run_id", "left_semi")
    scores = sinks.read_published(spark, root, "top_hosts").join(earlier, "run_id", "left_semi")
    return clusters, scores, current.union(earlier).distinct()


def run_incident_flow(
    snapshots: DataFrame,
    root: str,
    as_of: Column,
    tickets: DataFrame | None = None,
    window_hours: int = 24,
    mode: str = "latest",
    max_hosts: int | None = None,
    redaction: str = "balanced",
    export_json: bool = False,
    attempt: str | None = None,
    salt: str | None = None,
    retention_hours: int | None = None,
    pinned: DataFrame | None = None,
) -> str:
    """Process scanned snapshot documents (with ``run_id``), write all result tables, publish them.

    Everything is written under a new attempt first. Then the document rules are checked, and only
    after that the ledger row appears that makes the attempt of a run visible to
    ``sinks.read_published``; JSON exports follow for the runs that passed. Every run with a document
    gets a ledger row and a summary, also if none was accepted. Runs are compared with the published run
    before them. Documents are parsed once; what is staged on the way is deleted at the end. ``strict``
    redaction needs a ``salt``. With ``retention_hours`` older runs are retired at the end, pinned ones
    (``run_id``) aside, and those retired an hour ago or earlier are deleted. Returns the attempt; a given
    one must sort after those before it.
    """
    attempt = attempt or f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    with staging(snapshots.sparkSession):
        _write_attempt(snapshots, root, as_of, tickets, window_hours, mode, max_hosts, redaction, export_json, attempt, salt)
    if retention_hours is not None:
        spark = snapshots.sparkSession
        sinks.retire_runs(spark, root, as_of, retention_hours, pinned=pinned, dry_run=False)
        sinks.delete_retired(spark, root, as_of, dry_run=False)
    return attempt


def _write_attempt(
    snapshots: DataFrame,
    root: str,
    as_of: Column,
    tickets: DataFrame | None,
    window_hours: int,
    mode: str,
    max_hosts: int | None,
    redaction: str,
    export_json: bool,
    attempt: str,
    salt: str | None,
) -> None:
    spark = snapshots.sparkSession
    admitted = stage(ingest.admit_snapshots(snapshots, as_of, window_hours), "admitted")
    selected = ingest.select_snapshots(ingest.accepted(admitted), as_of, mode, max_hosts)
    selected = ingest.rank_snapshots(selected)
    host_events = stage(timeline.host_events(ingest.explode_events(selected), redaction), "host-events")
    windows, incidents = incident_table(host_events, selected, as_of, redaction, prepared=True, salt=salt)
    known_runs = admitted.select("run_id").distinct()
    old_clusters, old_scores, ledger_runs = published_history(spark, root, known_runs)
    view = fleet_view(windows, incidents, ledger_runs, old_clusters, old_scores, known_runs)
    evidence = stage(rules.incident_evidence(host_events, redaction="off", deduplicated=True), "evidence")
    line = timeline.host_timeline(windows, host_events, incidents)
    first = evidence.filter(F.col("evidence_rank") == 1)
    # A run without a host covers what could have been admitted.
    opened = as_of - F.expr(f"INTERVAL {int(window_hours)} HOURS")
    summary = view.summary.withColumns(
        {
            "window_start": F.coalesce("window_start", opened),
            "window_end": F.coalesce("window_end", as_of),
            "generated_at": iso_text(as_of),
        }
    )
    summary = stage(summary, "summary")
    documents = ingest.accepted(admitted)
    violations = stage(run_violations(view, host_events, evidence, summary, documents), "violations")
    tables = {
        "admission": ingest.admission_report(admitted, mode, max_hosts),
        "host_events": host_events,
        "incidents": incidents,
        "incident_evidence": evidence,
        "host_timeline": line,
        "host_reports": ledger.host_report(windows, incidents, first, view.top),
        "clusters": view.clusters,
        "top_hosts": view.top,
        "fleet_summary": summary,
        "violations": violations,
    }
    if tickets is not None:
        attached = timeline.attach_tickets(windows, ingest.tickets_by_host(tickets))
        tables["host_tickets"] = _without_persons(attached, redaction, salt)
    for name, table in tables.items():
        sinks.write_run_table(table, root, name, attempt)
    gate = stage(quality.dq_gate(known_runs, violations), "gate")
    entries = gate.select(
        "run_id",
        F.lit(attempt).alias("attempt"),
        F.when(F.col("passed"), "success").otherwise("failure").alias("status"),
        as_of.alias("at"),
        "violations",
    )
    entries.write.mode("append").parquet(f"{root.rstrip('/')}/runs")
    if export_json:
        passed = gate.filter("passed").select("run_id")
        shown = [df.join(passed, "run_id", "left_semi") for df in (line, host_events, incidents, evidence)]
        lines = host_documents.document_lines(*shown, as_of, tables.get("host_tickets"))
        host_documents.write_host_timelines(lines, root)
        sinks.write_fleet(summary.join(passed, "run_id", "left_semi"), root)


def _without_persons(tickets: DataFrame, redaction: str, salt: str | None) -> DataFrame:
    """Tickets with the users and texts treated like those of events."""
    out = tickets
    if "user_id" in out.columns:
        out = out.withColumn("user_id", hash_user(F.col("user_id"), redaction, salt))
    for name in ("subject", "body"):
        if name in out.columns:
            out = out.withColumn(name, F.when(F.col(name).isNotNull(), redact_message(F.col(name), redaction)))
    return out


def run_violations(
    view: FleetView,
    host_events: DataFrame,
    evidence: DataFrame | None = None,
    summary: DataFrame | None = None,
    documents: DataFrame | None = None,
) -> DataFrame:
    """Violations of the rules of the admitted snapshots and of all results, one row each."""
    advised = view.incidents.withColumn("recommended_actions", rules.recommended_actions(F.col("type")))
    host, incident = F.col("host_id").alias("key"), F.col("incident_id").alias("key")
    cluster, run = F.col("signature_hash").alias("key"), F.col("run_id").alias("key")
    checked = [
        (host_events, "event", host, quality.event_checks()),
        (advised, "incident", incident, quality.incident_checks()),
        (view.clusters, "cluster", cluster, quality.cluster_checks()),
        (view.top, "top_host", host, quality.top_host_checks()),
    ]
    if evidence is not None:
        checked.append((evidence, "evidence", host, quality.evidence_checks()))
    if summary is not None:
        checked.append((summary, "fleet", run, quality.fleet_checks()))
    if documents is not None:
        checks = quality.snapshot_checks(nested=True) + quality.nested_event_checks()
        checked.append((documents, "snapshot", F.col("key"), checks))
    parts = [quality.dq_violations(df, entity, ["run_id", key], checks) for df, entity, key, checks in checked]
    return reduce(lambda a, b: a.unionByName(b), parts)


def validate_runs(
    view: FleetView, truth: DataFrame, expected_hosts: DataFrame, runs: DataFrame, violations: DataFrame
) -> DataFrame:
    """Scores of every run against its truth labels."""
    per_run = violations.groupBy("run_id").agg(F.count(F.lit(1)).alias("violations"))
    return evaluate.validation_report(
        evaluate.type_precision_recall(truth, view.incidents),
        evaluate.ranking_hit_rate(expected_hosts, view.top, runs),
        evaluate.cluster_hit(view.clusters, runs),
        evaluate.scenario_checks(truth, view.clusters, view.summary, view.windows),
        per_run,
    )

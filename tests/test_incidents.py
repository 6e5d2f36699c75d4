"""Rules, timelines and fleet views on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from vigilgrid.functions.text import parse_ts
from vigilgrid.operators import fleet, ingest, ledger, rules, timeline
from vigilgrid.plans import incident as flow
from vigilgrid.sources import testbed as tb

SCHEMA = (
    "run_id string, host_id string, snap_rank int, pos long, ts_raw string, level string, source string, "
    "channel string, provider string, event_id string, record_id long, message string, tags array<string>"
)


def event(host="HOST-001", ts="2026-01-01T01:00:00Z", tags=(), run="run-1", rank=0, pos=0, **more):
    row = {
        "level": "Error", "source": "System", "channel": None, "provider": "P", "event_id": "1",
        "record_id": None, "message": "m", **more,
    }
    return (
        run, host, rank, pos, ts, row["level"], row["source"], row["channel"], row["provider"], row["event_id"],
        row["record_id"], row["message"], list(tags),
    )


def events_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", parse_ts(F.col("ts_raw")))


def incidents_of(spark, rows, **more):
    return {r["type"]: r for r in rules.detect_incidents(events_of(spark, rows), **more).collect()}


def minute(i):
    return f"2026-01-01T{1 + i // 60:02d}:{i % 60:02d}:00Z"


@pytest.mark.parametrize("n", range(1, 9))
def test_severity_and_confidence_by_count(spark, n):
    makers = {
        "bsod": {"tags": ["bsod"]},
        "disk_full": {"tags": ["disk_full"]},
        "service_crash_loop": {"provider": "Service Control Manager"},
        "network_instability": {"tags": ["dns_failure"]},
        "update_failure": {"tags": ["update_failure"]},
    }
    rows = [event(ts=minute(i), pos=i, message=name, **how) for name, how in makers.items() for i in range(n)]
    found = incidents_of(spark, rows)
    expected = {
        "bsod": (min(100, 85 + 5 * (n - 1)), 0.9 if n > 1 else 0.75),
        "disk_full": (min(95, 70 + min(20, 5 * (n - 1))), min(0.95, 0.7 + 0.05 * n)),
        "network_instability": (min(85, 55 + 5 * min(6, n)), min(0.9, 0.6 + 0.05 * n)),
        "update_failure": (min(90, 65 + 5 * min(4, n - 1)), min(0.9, 0.65 + 0.05 * n)),
    }
    if n >= 2:
        expected["service_crash_loop"] = (min(90, 65 + 5 * min(5, n)), min(0.95, 0.7 + 0.05 * n))
    assert {t: (r["severity"], r["confidence"]) for t, r in found.items()} == expected


def test_events_match_by_source_and_provider(spark):
    rows = [
        event(source="WindowsEventLog:Disk"),
        event(source="My Updater", ts=minute(5)),
        event(provider="the SERVICE control MANAGER", ts=minute(6)),
        event(provider="the SERVICE control MANAGER", ts=minute(7)),
    ]
    assert set(incidents_of(spark, rows)) == {"disk_full", "update_failure", "service_crash_loop"}


def test_one_event_may_match_several_rules(spark):
    found = incidents_of(spark, [event(tags=["bsod", "disk_full"])])
    assert [found[t]["incident_id"] for t in ("bsod", "disk_full")] == ["HOST-001-incident-1", "HOST-001-incident-2"]


def test_missing_fields_do_not_match(spark):
    rows = [event(source=None, provider=None, message=None)]
    assert incidents_of(spark, rows) == {}


def test_first_event_gives_the_signature(spark):
    rows = [
        event(tags=["bsod"], ts=minute(9), message="late 5", pos=0),
        event(tags=["bsod"], ts=minute(2), message="early 5", pos=1),
    ]
    assert incidents_of(spark, rows)["bsod"]["signature_key"] == "P:1|early <n>"


def test_service_crash_actions_are_the_specific_ones(spark):
    # The advice table is keyed by the type of the rule, so crash loops get their own texts.
    advice = spark.range(1).select(
        rules.recommended_actions(F.lit("service_crash_loop")), rules.recommended_actions(F.lit("nothing known"))
    )
    crash, other = advice.first()
    assert crash[0].startswith("Review service logs") and other == list(rules.DEFAULT_ACTIONS)


def test_dedup_keeps_first_copy_and_ignores_tags(spark):
    rows = [
        event(rank=1, pos=0, tags=["bsod"]),
        event(rank=0, pos=7, tags=[]),
        event(rank=1, pos=1, record_id=5),
    ]
    kept = rules.dedup_events(events_of(spark, rows)).collect()
    assert sorted((r["snap_rank"], r["pos"]) for r in kept) == [(0, 7), (1, 1)]
    # The surviving copy has no tag, so nothing fires although a later copy has one.
    assert incidents_of(spark, rows) == {}


def test_dedup_is_idempotent_and_order_free(spark):
    generator = random.Random(5)
    rows = [
        event(host=f"H{generator.randrange(3)}", ts=minute(generator.randrange(4)), pos=i, message=f"m{generator.randrange(3)}")
        for i in range(200)
    ]
    once = rules.dedup_events(events_of(spark, rows))
    shuffled = rules.dedup_events(events_of(spark, generator.sample(rows, len(rows))).repartition(7))
    key = lambda df: sorted((r["host_id"], r["pos"]) for r in df.collect())
    assert key(once) == key(rules.dedup_events(once)) == key(shuffled)
    wanted = {}
    for r in rows:
        wanted.setdefault((r[1], r[4], r[11]), r[3])
    assert len(key(once)) == len(wanted)


def test_results_do_not_depend_on_partitioning(spark, sf_dir):
    events = tb.endpoint_events(spark, sf_dir)
    columns = ["run_id", "host_id", "type", "severity", "signature_hash", "event_count"]
    first = rules.detect_incidents(events).select(*columns)
    second = rules.detect_incidents(events.repartition(13, "message")).select(*columns)
    assert sorted(first.collect()) == sorted(second.collect())


def test_prepared_events_give_the_same_incidents(spark, sf_dir):
    events = tb.endpoint_events(spark, sf_dir)
    columns = ["run_id", "host_id", "type", "severity", "signature_hash", "event_count"]
    whole = rules.detect_incidents(events).select(*columns)
    prepared = rules.detect_incidents(timeline.host_events(events), redaction="off", deduplicated=True)
    assert sorted(whole.collect()) == sorted(prepared.select(*columns).collect())


def test_event_positions_with_ties_and_unusable_times(spark):
    rows = [event(ts=t, pos=i) for i, t in enumerate(["junk", minute(1), minute(0), "", minute(1), None])]
    ordered = timeline.order_events(events_of(spark, rows)).orderBy("event_seq").collect()
    assert [r["event_seq"] for r in ordered] == list(range(6))
    assert [r["ts_raw"] for r in ordered] == [None, "", "junk", minute(0), minute(1), minute(1)]
    assert [r["pos"] for r in ordered][-2:] == [1, 4]


def test_evidence_ranks_match_with_and_without_limit(spark, sf_dir):
    events = tb.endpoint_events(spark, sf_dir)
    full = rules.incident_evidence(events)
    cut = rules.incident_evidence(events, limit=1)
    assert sorted(full.filter("evidence_rank <= 1").collect()) == sorted(cut.collect())


def window_rows(spark, rows):
    schema = "run_id string, host_id string, snap_rank int, user_id string, s string, e string"
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({"window_start": parse_ts(F.col("s")), "window_end": parse_ts(F.col("e"))})


def test_two_snapshots_merge_into_one_timeline(spark):
    snaps = window_rows(
        spark,
        [
            ("run-1", "HOST-001", 1, "u", "2026-01-01T00:00:00Z", "2026-01-01T06:00:00Z"),
            ("run-1", "HOST-001", 0, None, "2026-01-01T12:00:00Z", "2026-01-01T18:00:00Z"),
        ],
    )
    events = events_of(
        spark,
        [
            event(tags=["bsod"], rank=1, provider="BugCheck", event_id="1001", message="BugCheck 0x00000124"),
            event(tags=["disk_full"], ts="2026-01-01T13:00:00Z", provider="Disk", event_id="7", message="Disk failure imminent"),
        ],
    )
    windows, incidents = flow.incident_table(events, snaps)
    row = windows.select(F.date_format("window_start", "HH").alias("a"), F.date_format("window_end", "HH").alias("b"), "user_id").first()
    assert tuple(row) == ("00", "18", "u")
    found = {r["type"]: (r["severity"], r["confidence"]) for r in incidents.collect()}
    assert found == {"bsod": (85, 0.75), "disk_full": (70, 0.75)}
    view = flow.fleet_view(windows, incidents, windows.select("run_id").distinct())
    summary = view.summary.first()
    assert summary["incident_count"] == 2 and summary["overall_risk_score"] == 85 + 2 * 2
    assert summary["executive_summary"] == (
        "1 host(s) affected; 2 incident(s) (bsod, disk_full); overall risk 89; action: contact."
    )


def test_open_windows_fall_back_to_events(spark):
    snaps = window_rows(spark, [("run-1", "A", 0, None, None, "2026-01-01T06:00:00Z"), ("run-1", "B", 0, None, None, None)])
    events = events_of(spark, [event(host="A", ts=minute(7)), event(host="A", ts=minute(3))])
    found = timeline.host_windows(snaps, events, F.lit("2026-02-01T00:00:00Z").cast("timestamp"))
    shown = {r[0]: r[1:] for r in found.select("host_id", *[F.date_format(c, "MM-dd HH:mm") for c in ("window_start", "window_end")]).collect()}
    assert shown == {"A": ("01-01 01:03", "01-01 06:00"), "B": ("02-01 00:00", "02-01 00:00")}


def incident_rows(spark, rows):
    """(run, host, rule_no, type, severity, signature)"""
    schema = "run_id string, host_id string, rule_no int, type string, severity int, signature_hash string"
    df = spark.createDataFrame(rows, schema)
    at = F.lit("2026-01-01T00:00:00Z").cast("timestamp")
    return df.withColumns(
        {
            "signature_key": F.col("signature_hash"),
            "window_start": at,
            "window_end": at,
            "incident_id": F.concat("host_id", F.lit("-incident-"), F.col("rule_no").cast("string")),
        }
    )


def test_cluster_examples_are_the_smallest_hosts_whatever_the_salts(spark):
    rows = [("r1", f"H{i:03d}", 1, "bsod", 85, "s") for i in range(75)] + [("r1", "H000", 2, "disk_full", 70, "s")]
    for salts in (1, 4, 32):
        found = fleet.clusters(incident_rows(spark, rows), salts).first()
        assert found["affected_hosts"] == 75 and found["severity"] == 100 and found["type"] == "bsod"
        assert found["example_hosts"] == [f"H{i:03d}" for i in range(20)]


def test_status_against_the_run_before(spark):
    sizes = {"r1": {"a": 1, "b": 5, "c": 2}, "r2": {"a": 3, "b": 6}, "r3": {"a": 3, "c": 1}}
    rows = [
        (run, f"H{i}", 1, "bsod", 85, sig) for run, found in sizes.items() for sig, n in found.items() for i in range(n)
    ]
    runs = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "run_id string")
    found = fleet.cluster_status(fleet.clusters(incident_rows(spark, rows)), runs)
    shown = {(r["run_id"], r["signature_hash"]): (r["status"], r["delta_affected_hosts"]) for r in found.collect()}
    assert shown == {
        ("r1", "a"): ("new", None), ("r1", "b"): ("new", None), ("r1", "c"): ("new", None),
        ("r2", "a"): ("spiking", 2), ("r2", "b"): ("ongoing", 1),
        ("r3", "a"): ("ongoing", 0), ("r3", "c"): ("new", None),
    }


def test_ranking_and_actions(spark):
    hosts = [(run, f"H{i:02d}", f"u{i}" if i else "") for run in ("r1", "r2") for i in range(15)]
    windows = spark.createDataFrame(hosts, "run_id string, host_id string, user_id string")
    rows = [
        ("r1", "H03", 2, "disk_full", 70, "x"), ("r1", "H05", 4, "network_instability", 60, "y"),
        ("r2", "H03", 2, "disk_full", 75, "x"), ("r2", "H05", 4, "network_instability", 60, "y"),
        ("r2", "H07", 1, "bsod", 85, "z"), ("r2", "H07", 2, "disk_full", 70, "x"),
    ]
    incidents = incident_rows(spark, rows)
    runs = windows.select("run_id").distinct()
    view = flow.fleet_view(windows.withColumns({c: F.lit(None).cast("timestamp") for c in ("window_start", "window_end")}), incidents, runs)
    top = {(r["run_id"], r["host_rank"]): r for r in view.top.collect()}
    assert len(top) == 20
    assert [top[("r2", i)]["host_id"] for i in range(1, 7)] == ["H07", "H03", "H05", "H00", "H01", "H02"]
    assert top[("r2", 1)]["reasons"] == ["bsod (sev 85)", "disk_full (sev 70)"]
    assert top[("r2", 4)]["user_id"] is None and top[("r2", 5)]["user_id"] == "u1"
    action = {h: next(r["action"] for k, r in top.items() if k[0] == "r2" and r["host_id"] == h) for h in ("H07", "H03", "H05", "H00")}
    assert action == {"H07": "contact", "H03": "contact", "H05": "monitor", "H00": "ignore"}
    assert top[("r2", 2)]["delta_score"] == 5
    plain = fleet.filter_hosts(view.top, 60, "h0")
    assert plain.filter("run_id = 'r2'").count() == 3


def test_admission_reasons_in_order(spark):
    ok = "run/snapshots/HOST-001/snapshot-20260101T120000Z.json"
    rows = [
        ("snapshot-20260101T120000Z.json", True, None, None),
        ("run/h!/snapshot-20260101T120000Z.json", True, None, None),
        ("run/HOST-001/snapshot.json", True, None, None),
        (ok, True, "2020-01-01T00:00:00Z", None),
        (ok, False, "2020-01-01T00:00:00Z", None),
        (ok, False, None, ""),
        (ok, False, "2026-01-01T12:00:00Z", "other"),
    ]
    df = spark.createDataFrame(rows, "key string, load_error boolean, e string, host_id string")
    df = df.withColumn("window_end", parse_ts(F.col("e")))
    found = ingest.admit_snapshots(df, F.lit("2026-01-02T00:00:00Z").cast("timestamp"), 24).collect()
    assert [r["reject_reason"] for r in found] == [
        "invalid_path", "host_pattern", "filename_pattern", "schema_fail: load_error", "window_out_of_range", None, None,
    ]
    assert [r["host_id"] for r in found[-2:]] == ["HOST-001", "other"]


def test_accepted_and_rejected_make_the_whole(spark, sf_dir):
    keys = tb.snapshot_keys(spark, sf_dir)
    admitted = ingest.admit_snapshots(keys, F.lit(tb.AS_OF).cast("timestamp"), tb.ADMIT_WINDOW_HOURS)
    assert ingest.accepted(admitted).count() + ingest.rejected(admitted).count() == keys.count()


def test_latest_run_and_retention(spark):
    rows = [("r1", "success", "2026-01-01", False), ("r2", "success", "2026-01-03", True), ("r3", "failure", "2026-01-04", False)]
    df = spark.createDataFrame(rows, "run_id string, status string, d string, pinned boolean")
    df = df.withColumns({"finished_at": F.col("d").cast("timestamp"), "generated_at": F.col("d").cast("timestamp")})
    assert ledger.latest_run(df).first()[0] == "r2"
    assert ledger.latest_run(df.filter("status = 'failure'")).first()[0] == "r3"
    as_of = F.lit("2026-01-10").cast("timestamp")
    assert [r[0] for r in ledger.expired_runs(df, as_of, 48, "r3").select("run_id").collect()] == ["r1"]


def test_host_report_text(spark):
    snaps = window_rows(spark, [("run-1", "HOST-001", 0, None, "2026-01-01T00:00:00Z", "2026-01-01T12:00:00Z"), ("run-1", "HOST-002", 0, None, None, None)])
    events = events_of(spark, [event(tags=["bsod"], provider="TestProvider", message="Test error")])
    windows, incidents = flow.incident_table(events, snaps)
    view = flow.fleet_view(windows, incidents, windows.select("run_id").distinct())
    first = rules.incident_evidence(events, limit=1)
    reports = {r["host_id"]: r["report"] for r in ledger.host_report(windows, incidents, first, view.top).collect()}
    assert "Window: 2026-01-01T00:00:00+00:00 -> 2026-01-01T12:00:00+00:00" in reports["HOST-001"]
    assert "Verdict: Contact user" in reports["HOST-001"]
    assert "Evidence: 2026-01-01T01:00:00Z TestProvider 1 Test error" in reports["HOST-001"]
    assert "- [85] Detected blue screen or unexpected shutdown events (type=bsod, confidence=0.75)" in reports["HOST-001"]
    assert "None" not in reports["HOST-001"]
    assert reports["HOST-002"].endswith("No incidents detected.")


def test_staged_matches_give_the_same_incidents_and_evidence_without_secrets(spark):
    rows = [
        event(tags=["bsod"], message="password=abc at C:/tmp/x", record_id=1, pos=1),
        event(tags=["bsod"], message="password=abc at C:/tmp/x", record_id=1, pos=1, rank=1),
        event(tags=["bsod", "disk_full"], message="mail a@b.example", record_id=2, pos=2, ts=None),
        event(host=None, tags=["disk_full"], message=None, provider=None, pos=3),
        event(provider="Service Control Manager", source="disk", message="x", record_id=4, pos=4),
    ]
    events = events_of(spark, rows)
    matches = rules.staged_matches(events)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(rules.detect_incidents(matches, matched=True)) == key(rules.detect_incidents(events))
    for limit in (1, None):
        assert key(rules.incident_evidence(matches, limit=limit, matched=True)) == key(rules.incident_evidence(events, limit=limit))
    stored = " ".join(r["message"] for r in matches.select("body.message").collect())
    assert "abc" not in stored and "a@b" not in stored and matches.count() == 6

"""Streaming counts against the batch rules."""

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from vigilgrid.functions import text
from vigilgrid.operators import rules
from vigilgrid.streaming import detect


def document(host, key_time, events):
    return {"key": f"r/{host}/snapshot-{key_time}Z.json", "host_id": host, "events": events}


def log(ts, tags, provider="P", message="m"):
    return {"ts": ts, "source": "System", "provider": provider, "event_id": "1", "message": message, "tags": tags}


def test_stream_counts_equal_batch_counts_and_late_events_are_dropped(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    crash = "Service Control Manager"
    first = [log("2026-01-01T01:00:00Z", ["bsod"]), log("2026-01-01T01:00:00Z", ["bsod"]), log("2026-01-01T02:00:00Z", ["bsod", "disk_full"])]
    second = [log("2026-01-02T03:00:00Z", [], crash, "a"), log("2026-01-02T03:00:01Z", [], crash, "b"), log("2026-01-02T04:00:00Z", ["bsod"])]
    bad_key = {**document("HOST-002", "20260101T000000", first), "key": "r/HOST-002/other.json"}

    def drop(name, documents):
        (folder / name).write_text("\n".join(json.dumps(d) for d in documents))

    def run():
        docs = detect.snapshot_stream(spark, str(folder), layout="lines", max_files_per_trigger=1)
        detect.stream_detect(detect.rule_counts(docs), out, state).awaitTermination()

    drop("1.json", [document("HOST-001", "20260101T000000", first), bad_key])
    run()
    drop("2.json", [document("HOST-001", "20260102T000000", second)])
    run()
    drop("3.json", [document("HOST-END", "20260109T000000", [log("2026-01-09T00:00:00Z", [])])])
    run()
    # Far behind the watermark by now: must not be counted.
    drop("4.json", [document("HOST-001", "20260101T000001", [log("2026-01-01T05:00:00Z", ["bsod"], message="late")])])
    run()
    rows = spark.read.parquet(out).select(F.date_format("window_start", "MM-dd"), "host_id", "type", "event_count").collect()
    assert sorted(tuple(r) for r in rows) == [
        ("01-01", "HOST-001", "bsod", 2), ("01-01", "HOST-001", "disk_full", 1),
        ("01-02", "HOST-001", "bsod", 1), ("01-02", "HOST-001", "service_crash_loop", 2),
    ]
    # A batch count over the same events, by rule, agrees.
    schema = "run_id string, host_id string, snap_rank int, pos long, ts_raw string, provider string, message string, tags array<string>"
    listed = [("r", "HOST-001", 0, i, e["ts"], e["provider"], e["message"], e["tags"]) for i, e in enumerate(first + second)]
    batch = spark.createDataFrame(listed, schema).withColumns(
        {"ts": F.col("ts_raw").cast("timestamp"), "source": F.lit("System"), "level": F.lit("Error"), "event_id": F.lit("1"), "record_id": F.lit(None).cast("long")}
    )
    counts = {r["type"]: r["event_count"] for r in rules.detect_incidents(batch).collect()}
    totals = {}
    for r in rows:
        totals[r["type"]] = totals.get(r["type"], 0) + r["event_count"]
    assert counts == totals


def test_stream_of_single_document_files(spark, tmp_path):
    """One document per file: host and admission come from the path."""
    for host, name in (("HOST-001", "snapshot-20260101T000000Z.json"), ("HOST-001", "notes.json"), ("h!", "snapshot-20260101T000000Z.json")):
        folder = tmp_path / "in" / "run-1" / "snapshots" / host
        folder.mkdir(parents=True, exist_ok=True)
        events = [log("2026-01-01T01:00:00Z", ["bsod"], message=name)]
        (folder / name).write_text(json.dumps({"events": events}, indent=1))
    closing = tmp_path / "in" / "run-1" / "snapshots" / "HOST-END"
    closing.mkdir()
    (closing / "snapshot-20260109T000000Z.json").write_text(json.dumps({"events": [log("2026-01-09T00:00:00Z", [])]}))
    counts = detect.rule_counts(detect.snapshot_stream(spark, str(tmp_path / "in")))
    out = str(tmp_path / "out")
    detect.stream_detect(counts, out, str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(out).select("host_id", "type", "event_count").collect()
    assert [tuple(r) for r in rows] == [("HOST-001", "bsod", 1)]


def test_events_without_a_time_are_counted_as_in_the_batch(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    bad = ["", None, "12:00:00", "2026", "2026-01", "junk"]
    first = [log(ts, ["bsod"]) for ts in bad] + [log("2026-01-01T01:00:00Z", ["bsod"]), log("junk", [])]
    second = [log("junk", ["bsod"]), log("junk", ["bsod", "disk_full"], message="other"), log("2026-01-09T01:00:00Z", [])]
    for number, events in enumerate((first, second)):
        (folder / f"{number}.json").write_text(json.dumps(document("HOST-001", f"2026010{number + 1}T000000", events)))
        docs = detect.snapshot_stream(spark, str(folder), layout="lines", max_files_per_trigger=1)
        detect.stream_detect(detect.rule_counts(docs), out, state).awaitTermination()
    rows = spark.read.parquet(out)
    timeless = rows.filter(F.col("window_start").isNull()).groupBy("type").agg(F.sum("event_count").alias("n"))
    whole = {r["type"]: r["n"] for r in rows.groupBy("type").agg(F.sum("event_count").alias("n")).collect()}
    schema = "run_id string, host_id string, snap_rank int, pos long, ts_raw string, provider string, message string, tags array<string>"
    listed = [("r", "HOST-001", 0, i, e["ts"], e["provider"], e["message"], e["tags"]) for i, e in enumerate(first + second)]
    batch = spark.createDataFrame(listed, schema).withColumns(
        {"ts": text.parse_ts(F.col("ts_raw")), "source": F.lit("System"), "level": F.lit("Error"), "event_id": F.lit("1"), "record_id": F.lit(None).cast("long")}
    )
    assert whole == {r["type"]: r["event_count"] for r in rules.detect_incidents(batch).collect()}
    untimed = batch.filter(F.col("ts").isNull())
    assert {r["type"]: r["n"] for r in timeless.collect()} == {r["type"]: r["event_count"] for r in rules.detect_incidents(untimed).collect()}


def test_state_of_untimed_events_levels_off(spark, tmp_path):
    """A live stream: digests of events without a time expire, those within the delay still tell copies apart."""
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    kept = []
    for number in range(7):
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        events = [log(now, ["bsod"], message=f"timed {number}")] + 2 * [log("junk", ["bsod"], message=f"{number}-{i}") for i in range(20)]
        (folder / f"{number}.json").write_text(json.dumps(document("HOST-001", "20260101T000000", events)))
        docs = detect.snapshot_stream(spark, str(folder), layout="lines", max_files_per_trigger=1)
        query = detect.stream_detect(detect.rule_counts(docs, delay="1 second", span="1 second"), out, state)
        query.awaitTermination()
        kept.append(max(op["numRowsTotal"] for op in query.lastProgress["stateOperators"]))
    rows = spark.read.parquet(out).filter(F.col("window_start").isNull())
    assert rows.agg(F.sum("event_count")).first()[0] == 7 * 20
    assert kept[-1] <= 60 < 7 * 20

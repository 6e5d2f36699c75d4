"""Files in, files out, and the whole incident flow on a landing folder."""

import csv
import hashlib
import io
import json
import random
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilgrid.operators import ingest, mapping, profile, timeline
from vigilgrid.plans import incident as flow
from vigilgrid.sources import sheets as files
from vigilgrid.sources import large_csv, sinks, snapshots

ROWS = [["id", "text", ""], [], ["1", 'say "hi", ok', "x"], ["2", "", ""], ["3"]]


def write_csv(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as handle:
        csv.writer(handle, lineterminator="\n").writerows(rows)


def grid_of(df):
    return [(r["sheet_id"], r["row_idx"], r["cells"]) for r in df.orderBy("sheet_id", "row_idx").collect()]


def test_csv_readers_agree(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    write_csv(tmp_path / "a.csv", ROWS)
    write_csv(tmp_path / "sub" / "b.csv", ROWS[2:])
    expected = [("a.csv", i, c) for i, c in enumerate(ROWS)] + [("sub/b.csv", i, c) for i, c in enumerate(ROWS[2:])]
    assert grid_of(files.scan_sheets_csv(spark, str(tmp_path))) == expected
    assert grid_of(files.scan_large_csv(spark, str(tmp_path))) == expected


def test_large_csv_rows_are_numbered_across_blocks(spark, tmp_path):
    rows = [[str(i), "x" * (i % 50)] for i in range(5000)]
    write_csv(tmp_path / "big.csv", rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = files.scan_large_csv(spark, str(tmp_path))
        assert [r["cells"][0] for r in df.orderBy("row_idx").collect()] == [str(i) for i in range(5000)]
        assert df.agg(F.max("row_idx")).first()[0] == 4999
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quoted_line_breaks_cross_chunks_and_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    odd = ["a\nb", 'say "x"\n\n"y", z', "\r\n", "", "plain", "\n" * 30, '"', "é\n😀"]
    rows = [[rng.choice(odd) for _ in range(rng.randint(0, 4))] for _ in range(3000)]
    write_csv(tmp_path / "a.csv", rows)
    write_csv(tmp_path / "b.csv", [["one"], ["t" * 9000 + "\n" + "u" * 9000, "x"], ["last"]])
    (tmp_path / "c.csv").write_bytes(b'1,"a ""b""\r\nc"\r\n\r\n2,x"y\r\n')
    (tmp_path / "d.csv").write_bytes(b'a"b,"c"d"e\nf,"g\nh"i,j\nlast')
    expected = []
    for name in "abcd":
        with open(tmp_path / f"{name}.csv", newline="", encoding="utf-8") as handle:
            expected += [(f"{name}.csv", i, cells) for i, cells in enumerate(csv.reader(handle))]
    assert grid_of(files.scan_large_csv(spark, str(tmp_path))) == expected
    monkeypatch.setattr(large_csv, "CHUNK_BYTES", 700)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert grid_of(files.scan_large_csv(spark, str(tmp_path))) == expected
        per_task = files.scan_large_csv(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).count()
        assert per_task.count() > 4  # no task has a whole file
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert grid_of(files.scan_sheets_csv(spark, str(tmp_path))) == expected


CSV_TEXT = st.text(st.sampled_from('ab,"\n'), max_size=40)


@settings(max_examples=500, deadline=None)
@given(text=CSV_TEXT, cut=st.integers(0, 40))
def test_states_of_lines_are_those_of_the_csv_module(text, cut):
    lines = text.encode().split(b"\n")
    inside = False
    for n, line in enumerate(lines[:-1]):
        inside = large_csv.after_line(inside, line)
        # Another record starts after this line exactly if the reader is outside quotes.
        read = list(csv.reader(io.StringIO("\n".join(text.split("\n")[: n + 1]) + "\nx", newline="")))
        assert inside == (read[-1] != ["x"] or len(read) < 2)
    head, tail = lines[:cut], lines[cut:]
    for start in (False, True):
        middle, first, _ = large_csv.effect(head, start)
        end, second, _ = large_csv.effect(tail, middle)
        assert (end, first + second) == large_csv.effect(lines, start)[:2]


@settings(max_examples=500, deadline=None)
@given(text=CSV_TEXT)
def test_both_starts_of_a_chunk_are_found_in_one_pass(text):
    lines = text.encode().split(b"\n")
    out, in_ = large_csv.effects(lines)
    assert out[:2] == large_csv.effect(lines, False)[:2] and in_ == large_csv.effect(lines, True)


def test_a_file_in_one_split_is_decoded_by_several_tasks(spark, tmp_path, monkeypatch):
    write_csv(tmp_path / "one.csv", [[str(i), "a\n" * (i % 4), "x"] for i in range(3000)])
    with open(tmp_path / "one.csv", newline="", encoding="utf-8") as handle:
        expected = [("one.csv", i, cells) for i, cells in enumerate(csv.reader(handle))]
    monkeypatch.setattr(large_csv, "CHUNK_BYTES", 700)
    found = files.scan_large_csv(spark, str(tmp_path))
    assert grid_of(found) == expected
    assert found.groupBy(F.spark_partition_id().alias("task")).count().count() > 1


def test_sheets_that_cannot_be_read_are_told_and_left_out(spark, tmp_path):
    write_csv(tmp_path / "good.csv", ROWS)
    (tmp_path / "latin.csv").write_bytes("größe,ok\n1,2\n".encode("latin-1"))
    (tmp_path / "long.csv").write_text("a,b\n1,2\n" + '"' + "x\n" * 70_000 + '",c\n')
    write_workbook(tmp_path / "good.xlsx", {"One": '<row r="1"><c r="A1"><v>5</v></c></row>'})
    (tmp_path / "torn.xlsx").write_bytes((tmp_path / "good.xlsx").read_bytes()[:100])
    write_workbook(tmp_path / "odd.xlsx", {"One": '<row r="1"><c r="A1"><v>5</v></c></row>', "Bad": '<row r="1"><c r="A1" t="s"><v>99</v></c></row>'})
    folder = str(tmp_path)
    for decoded in (files.decode_sheets_csv(spark, folder), large_csv.decode(spark, folder)):
        errors = {r["sheet_id"]: r["error"] for r in files.sheet_errors(decoded).collect()}
        assert sorted(errors) == ["latin.csv", "long.csv"]
        assert errors["latin.csv"].startswith("not UTF-8") and "field larger than field limit" in errors["long.csv"]
        assert grid_of(files.readable_rows(decoded)) == [("good.csv", i, c) for i, c in enumerate(ROWS)]
    books = files.decode_workbooks(spark, folder, "*")
    errors = {r["sheet_id"]: r["error"] for r in files.sheet_errors(books).collect()}
    assert sorted(errors) == ["odd.xlsx#Bad", "torn.xlsx"] and errors["torn.xlsx"].startswith("BadZipFile")
    assert grid_of(files.readable_rows(books)) == [("good.xlsx#One", 0, ["5"]), ("odd.xlsx#One", 0, ["5"])]


def write_workbook(path, sheets):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as book:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f"<workbook {main} {rel}><sheets>{listed}</sheets></workbook>")
        targets = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{targets}</Relationships>")
        book.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>shared</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        book.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, body in enumerate(sheets.values(), 1):
            book.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    first = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
        '<row r="3"><c r="A3"><v>007</v></c><c r="B3" s="1"><v>45658</v></c><c r="C3" t="b"><v>1</v></c>'
        '<c r="D3" t="inlineStr"><is><t>in</t></is></c></row>'
    )
    write_workbook(tmp_path / "w.xlsx", {"One": first, "Two": '<row r="1"><c r="A1"><v>5</v></c></row>'})
    expected = [
        ("w.xlsx#One", 0, ["shared", "", "rich"]),
        ("w.xlsx#One", 1, []),
        ("w.xlsx#One", 2, ["007", "2025-01-01 00:00:00", "True", "in"]),
    ]
    assert grid_of(files.scan_workbooks(spark, str(tmp_path))) == expected
    assert grid_of(files.scan_workbooks(spark, str(tmp_path), "*")) == [*expected, ("w.xlsx#Two", 0, ["5"])]
    assert grid_of(files.scan_workbooks(spark, str(tmp_path), "Two")) == [("w.xlsx#Two", 0, ["5"])]


def test_changed_files_are_noticed(spark, tmp_path):
    for name in ("same.csv", "gone.csv", "edited.csv"):
        (tmp_path / name).write_text(name)
    before = spark.createDataFrame(files.file_hashes(spark, str(tmp_path)).collect())
    digests = {r["path"]: r["file_hash"] for r in before.collect()}
    assert digests["same.csv"] == hashlib.sha256(b"same.csv").hexdigest()
    (tmp_path / "edited.csv").write_text("other")
    (tmp_path / "gone.csv").unlink()
    states = mapping.resume_guard(before, files.file_hashes(spark, str(tmp_path)))
    assert dict(states.select("path", "state").collect()) == {"same.csv": "same", "gone.csv": "missing", "edited.csv": "changed"}


def snapshot(host, start, end, events, **more):
    return {
        "schema_version": "1.0", "snapshot_id": f"{host}-{start}", "host_id": host, "generated_at": end,
        "window": {"start": start, "end": end}, "events": events, **more,
    }


def log(ts, provider, event_id, message, tags):
    return {"ts": ts, "level": "Error", "source": "System", "provider": provider, "event_id": event_id, "message": message, "data": {}, "tags": tags}


def landing(tmp_path):
    early = snapshot("HOST-001", "2026-01-01T00:00:00Z", "2026-01-01T06:00:00Z", [log("2026-01-01T01:00:00Z", "BugCheck", 1001, "BugCheck 0x00000124", ["bsod"])])
    late = snapshot("HOST-001", "2026-01-01T12:00:00Z", "2026-01-01T18:00:00Z", [log("2026-01-01T13:00:00Z", "Disk", "7", "Disk failure imminent", ["disk_full"])])
    folder = tmp_path / "run-1" / "snapshots" / "HOST-001"
    folder.mkdir(parents=True)
    (folder / "snapshot-20260101T060000Z.json").write_text(json.dumps(early, indent=1))
    (folder / "snapshot-20260101T180000Z.json").write_text(json.dumps(late, indent=1))
    (folder / "snapshot-20260101T190000Z.json").write_text("{broken")
    (folder / "notes.json").write_text("{}")
    return str(tmp_path)


AS_OF = "2026-01-02T00:00:00Z"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def scanned(spark, root):
    docs = snapshots.scan_snapshots(spark, root)
    return docs.withColumn("run_id", F.split("key", "/")[0])


def test_snapshot_files_are_scanned_and_admitted(spark, tmp_path):
    admitted = ingest.admit_snapshots(scanned(spark, landing(tmp_path)), as_of(), 24)
    found = {r["key"].split("/")[-1]: r["reject_reason"] for r in admitted.collect()}
    assert found == {
        "snapshot-20260101T060000Z.json": None,
        "snapshot-20260101T180000Z.json": None,
        "snapshot-20260101T190000Z.json": "schema_fail: load_error",
        "notes.json": "filename_pattern",
    }
    report = ingest.admission_report(admitted).first()
    assert (report["keys_found"], report["loaded"], report["skipped_not_latest"]) == (4, 1, 1)


def test_whole_flow_with_all_snapshots(spark, tmp_path):
    root, out = landing(tmp_path / "in"), str(tmp_path / "out")
    flow.run_incident_flow(scanned(spark, root), out, as_of(), mode="all", export_json=True)
    read = lambda name: sinks.read_published(spark, out, name)
    summary = read("fleet_summary").first()
    assert (summary["host_count"], summary["incident_count"]) == (1, 2)
    assert str(summary["window_start"]) == "2026-01-01 00:00:00" and str(summary["window_end"]) == "2026-01-01 18:00:00"
    assert read("host_events").count() == 2 and read("incident_evidence").count() == 2
    found = {r["type"]: (r["severity"], r["confidence"]) for r in read("incidents").collect()}
    assert found == {"bsod": (85, 0.75), "disk_full": (70, 0.75)}
    top = read("top_hosts").first()
    assert top["user_id"] is None and top["action"] == "contact"
    entry = spark.read.parquet(f"{out}/runs").first()
    assert entry["status"] == "success" and entry["violations"] == 0
    document = json.loads(spark.read.text(f"{out}/host_timelines_json").first()["value"])
    assert [i["type"] for i in document["incidents"]] == ["bsod", "disk_full"] and "user_id" not in document
    # The same run again, now with the latest snapshot only: its rows replace the earlier ones.
    flow.run_incident_flow(scanned(spark, root), out, as_of())
    assert [r["type"] for r in read("incidents").collect()] == ["disk_full"]


def test_runs_that_break_the_rules_stay_unpublished(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    for run, level in (("run-1", "Error"), ("run-2", "Loud")):
        folder = root / run / "snapshots" / "HOST-001"
        folder.mkdir(parents=True)
        event = {**log("2026-01-01T01:00:00Z", "BugCheck", 1, "stop", ["bsod"]), "level": level}
        document = snapshot("HOST-001", "2026-01-01T00:00:00Z", "2026-01-01T06:00:00Z", [event])
        (folder / "snapshot-20260101T060000Z.json").write_text(json.dumps(document))
    flow.run_incident_flow(scanned(spark, str(root)), out, as_of())
    status = dict(spark.read.parquet(f"{out}/runs").select("run_id", "status").collect())
    assert status == {"run-1": "success", "run-2": "failure"}
    assert [r["run_id"] for r in sinks.read_published(spark, out, "incidents").collect()] == ["run-1"]


def test_runs_of_a_later_job_are_compared_with_published_ones(spark, tmp_path):
    out = str(tmp_path / "out")
    for day, hosts in ((1, 1), (2, 3), (3, 3)):
        root = tmp_path / f"in-{day}"
        for i in range(hosts):
            folder = root / f"run-{day}" / "snapshots" / f"HOST-{i:03d}"
            folder.mkdir(parents=True)
            start, end = f"2026-01-0{day}T00:00:00Z", f"2026-01-0{day}T06:00:00Z"
            document = snapshot(f"HOST-{i:03d}", start, end, [log(start, "Disk", 7, "Disk full", ["disk_full"])])
            (folder / f"snapshot-2026010{day}T060000Z.json").write_text(json.dumps(document))
        at = F.lit(f"2026-01-0{day}T12:00:00Z").cast("timestamp")
        flow.run_incident_flow(scanned(spark, str(root)), out, at)
    clusters = sinks.read_published(spark, out, "clusters").orderBy("run_id").collect()
    assert [(r["run_id"], r["status"], r["delta_affected_hosts"]) for r in clusters] == [
        ("run-1", "new", None), ("run-2", "spiking", 2), ("run-3", "ongoing", 0),
    ]
    top = sinks.read_published(spark, out, "top_hosts").filter("host_id = 'HOST-000'").orderBy("run_id").collect()
    assert [(r["action"], r["delta_score"]) for r in top] == [("contact", None), ("contact", 0), ("monitor", 0)]


def test_tickets_are_read_and_attached(spark, tmp_path):
    for i, host in enumerate(["HOST-001", "", "HOST-001"]):
        document = {"ticket_id": f"TICKET-{i}", "host_id": host, "subject": "s", "reported_window": None}
        (tmp_path / f"{i}.json").write_text(json.dumps(document, indent=1))
    tickets = ingest.tickets_by_host(snapshots.scan_tickets(spark, str(tmp_path))).withColumn("run_id", F.lit("r"))
    hosts = spark.createDataFrame([("r", "HOST-001"), ("r", "HOST-002")], "run_id string, host_id string")
    attached = timeline.attach_tickets(hosts, tickets).select("host_id", "ticket_id").collect()
    assert sorted(tuple(r) for r in attached if r[1]) == [("HOST-001", "TICKET-0"), ("HOST-001", "TICKET-2")]
    assert [r[0] for r in attached if r[1] is None] == ["HOST-002"]
    assert sorted(r["host_id"] for r in tickets.collect()) == ["HOST-001", "HOST-001", "unknown"]


def test_hosts_are_not_repeated_for_their_tickets(spark):
    hosts = spark.range(300).selectExpr("'r' AS run_id", "concat('H', id) AS host_id")
    tickets = spark.range(900).selectExpr("'r' AS run_id", "concat('H', id % 200) AS host_id", "concat('T', id) AS ticket_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        attached = timeline.attach_tickets(hosts, tickets)
        assert attached.count() == 1000 and attached.filter("ticket_id IS NULL").count() == 100
        plan = attached._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.split("== Initial Plan ==")[0].count("SortMergeJoin") == 1 and "LeftAnti" not in plan


def test_clean_tables_are_written_with_a_manifest(spark, tmp_path):
    rows = spark.range(50).selectExpr("concat('s', id % 3) AS sheet_id", "id AS v")
    for fmt in ("csv", "parquet"):
        path = sinks.write_clean_table(rows, str(tmp_path), fmt, fmt)
        back = spark.read.option("header", True).format(fmt).load(path)
        manifest = sinks.save_manifest(profile.output_row_counts(back), path, as_of())
        assert {r["sheet_id"]: r["rows_written"] for r in manifest.collect()} == {"s0": 17, "s1": 17, "s2": 16}


def test_audit_is_appended(spark, tmp_path):
    keys = spark.createDataFrame([("s1",), ("s2",)], "sheet_id string")
    for name in ("one", "two"):
        path = sinks.append_audit(sinks.audit_event(keys, name, as_of(), rows=F.lit(3)), str(tmp_path))
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 4 and {r["event"] for r in rows} == {"one", "two"} and rows[0]["meta"] == {"rows": "3"}

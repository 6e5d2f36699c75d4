"""The onboarding flow from scanned sheets to published tables, over several jobs."""

import pytest
from pyspark.sql import functions as F

from vigilgrid.model import SHEET_ROWS
from vigilgrid.operators import ledger
from vigilgrid.plans import onboarding
from vigilgrid.sources import sheet_store as store

# Grids whose results are known.
MESSY = [["Sales Report Q1", "", "", ""], ["", "Product Code", "Qty", "Amount"], ["row1", "X100", "3", "19.95"], ["row2", "Y200", "1", "5.00"]]
META = [["Report Date", "2025-01-01", "", ""], ["", "Product Code", "Qty", "Amount"], ["row1", "X100", "USD 3", "19.95"], ["row2", "Y200", "1", "5.00"]]
CLEAN = [["Sales report Q1", "", "", ""], ["product_code", "qty", "amount", "note"], ["X100", "3", "19.95", "first order"], ["Y200", "1", "5.00", "second order"]]
FIELDS = [
    ("r", 0, "report_date", '{"row": 0, "col": 1}', "metadata", None),
    ("r", 1, "product_code", '{"column": "Product Code"}', "column", None),
    ("r", 2, "qty", '{"column": "Qty"}', "column", "number"),
]


def at(day=2):
    return F.lit(f"2026-01-0{day}T00:00:00Z").cast("timestamp")


def sheets(spark, **named):
    return spark.createDataFrame([(n, i, c) for n, cells in named.items() for i, c in enumerate(cells)], SHEET_ROWS)


def tables(spark, **named):
    return onboarding.Decisions(**{n: spark.createDataFrame(rows, onboarding._NONE[n]) for n, rows in named.items() if rows})


def states(spark, root):
    return {r["sheet_id"]: (r["status"], r["next_step"], r["message"]) for r in store.last_states(spark, root).collect()}


def output(spark, root, sheet):
    rows = store.read(spark, root, "clean").filter(F.col("sheet_id") == sheet).orderBy("row_idx").collect()
    return rows[0]["headers"] if rows else None, [r["cells"] for r in rows]


def schema(spark, root, sheet):
    rows = store.read(spark, root, "schema").filter(F.col("sheet_id") == sheet).orderBy("out_idx").collect()
    return [(r["source"], r["canonical"], r["dtype"], r["required"], r["schema_layer"]) for r in rows]


def events(spark, root, sheet):
    rows = store.read_all(spark, root, "audit").filter(F.col("sheet_id") == sheet).orderBy("attempt", "seq").collect()
    return [r["event"] for r in rows]


def test_a_sheet_waits_for_a_person_and_is_completed(spark, tmp_path):
    root, rows = str(tmp_path), sheets(spark, messy=MESSY, clean=CLEAN)
    onboarding.run_onboarding_flow(rows, root, at(), attempt="1")
    assert states(spark, root) == {
        "messy": ("needs_human_confirmation", "provide_confirmed_header_candidate", "Header selection is ambiguous and looks like data."),
        "clean": ("header_selection_ok", "continue_to_schema", "Header selection accepted."),
    }
    assert store.read(spark, root, "clean").count() == 0 and store.read_all(spark, root, "manifest").count() == 0
    told = tables(spark, confirmations=[("messy", "row_1"), ("clean", "row_9")])
    onboarding.run_onboarding_flow(rows, root, at(), told, attempt="2")
    assert states(spark, root)["messy"] == ("ok", "review_artifacts", "Schema created and output saved.")
    assert states(spark, root)["clean"] == ("needs_human_confirmation", "write_human_confirmation", "Confirmed header candidate not found.")
    assert output(spark, root, "messy") == (["unnamed_0", "product_code", "qty", "amount"], MESSY[2:])
    assert schema(spark, root, "messy") == [
        ("unnamed_0", "unnamed_0", "string", True, "core"), ("product_code", "product_code", "string", True, "core"),
        ("qty", "qty", "number", True, "core"), ("amount", "amount", "number", True, "core"),
    ]
    manifest = store.read(spark, root, "manifest").collect()
    assert [(r["sheet_id"], r["rows_written"], r["saved_uri"]) for r in manifest] == [("messy", 2, f"{root}/clean/attempt=2")]
    assert events(spark, root, "messy") == ["stop_due_to_ambiguous_headers", "human_confirmation_received", "outputs_saved"]
    audit = store.read_all(spark, root, "audit")
    found = ledger.sheet_status(rows.select("sheet_id").distinct(), audit, store.read(spark, root, "manifest")).collect()
    assert {r["sheet_id"]: r["status"] for r in found} == {"messy": "ok", "clean": "header_selection_ok"}
    # A later job that fails the sheet leaves what was published.
    onboarding.run_onboarding_flow(rows, root, at(), tables(spark, confirmations=[("messy", "row_77")]), attempt="3")
    assert states(spark, root)["messy"][0] == "needs_human_confirmation" and len(output(spark, root, "messy")[1]) == 2


def test_recipes_are_applied_stored_and_recalled(spark, tmp_path):
    root = str(tmp_path)
    recipe = [("r", "1", ["report_date"], False)]
    told = tables(spark, sheet_recipes=[("a", "r"), ("c", "r")], recipes=recipe, fields=FIELDS)
    onboarding.run_onboarding_flow(sheets(spark, a=META, c=CLEAN), root, at(), told, attempt="1")
    expected = (["product_code", "qty", "report_date"], [["X100", "3.0", "2025-01-01"], ["Y200", "1.0", "2025-01-01"]])
    assert output(spark, root, "a") == expected
    assert schema(spark, root, "a") == [
        ("Product Code", "product_code", "string", True, "manual_recipe"), ("Qty", "qty", "number", True, "manual_recipe"),
        ("report_date", "report_date", "string", True, "manual_recipe"),
    ]
    assert [(r["target"], r["value"]) for r in store.read(spark, root, "metadata").filter("sheet_id = 'a'").collect()] == [("report_date", "2025-01-01")]
    assert events(spark, root, "a") == ["manual_recipe_applied", "outputs_saved"]
    # The same structure in another job: nothing is given, the recipe is recalled; another structure waits.
    onboarding.run_onboarding_flow(sheets(spark, b=META, d=MESSY), root, at(), attempt="2")
    assert output(spark, root, "b") == expected and states(spark, root)["b"][0] == "ok"
    assert states(spark, root)["d"][1] == "provide_confirmed_header_candidate"
    assert events(spark, root, "b") == ["manual_recipe_recalled", "manual_recipe_applied", "outputs_saved"]
    # A newer recipe for the structure wins.
    newer = [("r", 0, "code", '"Product Code"', "column", None)]
    later = at(3)
    onboarding.run_onboarding_flow(sheets(spark, a=META), root, later, tables(spark, sheet_recipes=[("a", "r")], recipes=[("r", "1", None, False)], fields=newer), attempt="3")
    onboarding.run_onboarding_flow(sheets(spark, e=META), root, later, attempt="4")
    assert output(spark, root, "e") == (["code"], [["X100"], ["Y200"]]) and output(spark, root, "b") == expected


def test_a_recipe_needs_columns_and_leaves_no_trace(spark, tmp_path):
    root = str(tmp_path)
    told = tables(spark, sheet_recipes=[("a", "r")], recipes=[("r", None, None, False)], fields=FIELDS[:1])
    onboarding.run_onboarding_flow(sheets(spark, a=META), root, at(), told, attempt="1")
    assert states(spark, root)["a"] == (
        "needs_human_confirmation", "fix_manual_recipe", "Manual recipe must include at least one column field to build a table.",
    )
    assert output(spark, root, "a") == (None, []) and store.recipe_index(spark, root).count() == 0
    onboarding.run_onboarding_flow(sheets(spark, b=META), root, at(), attempt="2")
    assert states(spark, root)["b"][1] == "continue_to_schema"


def test_precedence_adapters_regions_and_changed_files(spark, tmp_path):
    root = str(tmp_path)
    told = tables(
        spark,
        confirmations=[(s, "row_1") for s in "abcd"],
        overrides=[("b", 1, {"qty": "count"}), ("c", 0, {}), ("d", 1, {})],
        sheet_recipes=[("c", "r")], recipes=[("r", "1", None, False)], fields=FIELDS,
        sheet_specs=[("a", "s")],
        spec_fields=[("s", 0, 0, "code", "product_code", "string", True), ("s", 1, 1, "pieces", "qty", "number", False), ("s", 2, 2, "gone", None, "string", False)],
        changed=[("d",)],
    )
    told.regions = spark.createDataFrame(
        [("b", None, 2, ["count"], None)], "sheet_id string, start_row bigint, end_row bigint, include_columns array<string>, exclude_columns array<string>"
    )
    onboarding.run_onboarding_flow(sheets(spark, a=META, b=META, c=META, d=META), root, at(), told, attempt="1")
    assert output(spark, root, "a") == (["code", "pieces"], [["X100", "3"], ["Y200", "1"]])
    assert schema(spark, root, "a") == [("product_code", "code", "string", True, "adapter"), ("qty", "pieces", "number", False, "adapter")]
    assert output(spark, root, "b") == (["count"], [["USD 3"]])
    assert schema(spark, root, "b") == [("count", "count", "string", True, "core")]
    assert output(spark, root, "c")[0] == ["product_code", "qty"]  # recipe before override
    assert states(spark, root)["d"][:2] == ("needs_human_confirmation", "rerun_required") and output(spark, root, "d") == (None, [])
    assert events(spark, root, "b") == ["header_override_applied", "outputs_saved"] and events(spark, root, "d") == ["resume_guard_file_changed"]


def test_gate_and_unreadable_sheets(spark, tmp_path):
    root = str(tmp_path)
    holes = [["Product Code", "qty"], ["", "1"], ["X", "2"]]
    decoded = sheets(spark, good=CLEAN, holes=holes, thin=CLEAN).withColumn("error", F.lit(None).cast("string"))
    broken = spark.createDataFrame([("bad.csv", -1, None, "not UTF-8: invalid start byte")], decoded.schema)
    told = tables(spark, confirmations=[("good", "row_1"), ("holes", "row_0"), ("thin", "row_0")])
    onboarding.run_onboarding_flow(decoded.unionByName(broken), root, at(), told, required=["product_code"], attempt="1")
    found = states(spark, root)
    assert found["good"][0] == "ok"
    assert found["holes"] == ("needs_human_confirmation", "review_gate", "Gate: key_missing")
    assert found["thin"] == ("needs_human_confirmation", "review_gate", "Gate: header_confidence")
    assert found["bad.csv"] == ("unreadable", "fix_source_file", "not UTF-8: invalid start byte")
    assert output(spark, root, "good")[1] == CLEAN[2:] and output(spark, root, "holes") == (None, [])
    assert events(spark, root, "bad.csv") == ["source_unreadable"] and events(spark, root, "holes")[-1] == "stopped_by_gate"


def test_a_job_that_fails_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    told = tables(spark, sheet_recipes=[("a", "r")], recipes=[("r", "1", ["report_date"], False)], fields=FIELDS)
    real = store.append

    def failing(df, where, name, attempt):
        if name == "sheet_ledger":
            raise OSError("no space")
        real(df, where, name, attempt)

    monkeypatch.setattr(store, "append", failing)
    with pytest.raises(OSError):
        onboarding.run_onboarding_flow(sheets(spark, a=META), root, at(), told, attempt="1")
    monkeypatch.setattr(store, "append", real)
    assert store.read_all(spark, root, "clean").count() == 2
    assert output(spark, root, "a") == (None, []) and store.recipe_index(spark, root).count() == 0
    onboarding.run_onboarding_flow(sheets(spark, a=META), root, at(), attempt="2")
    assert states(spark, root)["a"][1] == "continue_to_schema"


def test_recipes_that_no_sheet_takes_are_left_aside(spark, tmp_path, monkeypatch):
    root, seen = str(tmp_path), []
    whole = onboarding.mapping.apply_recipe
    monkeypatch.setattr(onboarding.mapping, "apply_recipe", lambda *a: seen.append({r[0] for r in a[3].select("recipe_id").collect()}) or whole(*a))
    others = [("other", *f[1:]) for f in FIELDS]
    told = tables(spark, sheet_recipes=[("a", "r")], recipes=[("r", "1", None, True), ("other", "1", None, True)], fields=FIELDS + others)
    onboarding.run_onboarding_flow(sheets(spark, a=META), root, at(), told, attempt="1")
    onboarding.run_onboarding_flow(sheets(spark, b=META), root, at(), attempt="2")
    assert seen == [{"1/r"}, {"1/r"}] and len(output(spark, root, "b")[1]) == 2

"""Onboarding flow: many sheets in one job, with a pause for a person between two jobs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import grid, mapping, profile
from ..session import stage, staging
from ..sources import sheet_store as store
from ..sources import sheets as files


@dataclass
class SheetEvidence:
    """What is known about the sheets after the first job."""

    hashes: DataFrame
    candidates: DataFrame
    decisions: DataFrame
    recalled: DataFrame


@dataclass
class Decisions:
    """What people decided about sheets, each a table or nothing.

    ``confirmations``: ``sheet_id, confirmed_header_candidate``; ``overrides``: ``sheet_id, header_row,
    renames``; ``sheet_recipes``: ``sheet_id, recipe_id`` with ``recipes`` and ``fields`` as
    ``mapping.apply_recipe`` takes them; ``sheet_specs`` and ``spec_fields``: adapters as
    ``mapping.apply_adapter`` takes them; ``regions`` as ``grid.region_plan`` takes them; ``changed``:
    ``sheet_id`` of sheets whose file is not the one that the decisions were made for.
    """

    confirmations: DataFrame | None = None
    overrides: DataFrame | None = None
    sheet_recipes: DataFrame | None = None
    recipes: DataFrame | None = None
    fields: DataFrame | None = None
    sheet_specs: DataFrame | None = None
    spec_fields: DataFrame | None = None
    regions: DataFrame | None = None
    changed: DataFrame | None = None


# What is said about a sheet with this next step.
MESSAGES = {
    "continue_to_schema": "Header selection accepted.",
    "provide_confirmed_header_candidate": "Header selection is ambiguous and looks like data.",
    "rerun_required": "Input file has changed since the run started.",
}
MISSING_CONFIRMATION = "Missing human confirmation."
UNKNOWN_CANDIDATE = "Confirmed header candidate not found."
RECIPE_SAVED = "Manual recipe applied and outputs saved."
TABLE_SAVED = "Schema created and output saved."


def examine_sheets(rows: DataFrame, recipe_index: DataFrame) -> SheetEvidence:
    """Hashes, header candidates and decisions of all sheets, and the recipes that are recalled.

    Only the first rows of each sheet are read.
    """
    top = stage(grid.preview_rows(rows), "preview")
    hashes = grid.structural_hash(top)
    candidates = grid.header_candidates(top)
    return SheetEvidence(
        hashes, candidates, grid.header_decision(candidates), mapping.recall_recipe(hashes, recipe_index)
    )


def continue_sheets(
    rows: DataFrame,
    evidence: SheetEvidence,
    confirmations: DataFrame,
    overrides: DataFrame,
    sheet_recipes: DataFrame,
    fields: DataFrame,
    changed: DataFrame | None = None,
) -> DataFrame:
    """Header of every sheet and where it comes from: recipe, override or confirmation, in that order.

    ``changed`` lists sheets whose source file is not the one the run started with; they stop here.
    """
    sheets = evidence.hashes.select("sheet_id")
    problems = mapping.recipe_problems(mapping.parse_recipe_fields(fields))
    recipes = sheet_recipes.join(problems, "recipe_id", "left").select("sheet_id", "recipe_id", "problem")
    overridden = grid.apply_header_override(rows, overrides).select(
        "sheet_id", F.col("header_row").alias("_o_row"), F.col("headers").alias("_o_headers")
    )
    confirmed = mapping.apply_confirmations(sheets, evidence.candidates, confirmations).select(
        "sheet_id",
        F.col("header_row").alias("_c_row"),
        F.col("headers").alias("_c_headers"),
        F.col("status").alias("_c_status"),
    )
    stale = sheets.limit(0) if changed is None else changed.select("sheet_id").distinct()
    joined = (
        sheets.join(stale.withColumn("_stale", F.lit(True)), "sheet_id", "left")
        .join(recipes, "sheet_id", "left")
        .join(overridden, "sheet_id", "left")
        .join(confirmed, "sheet_id", "left")
    )
    has_recipe, has_override = F.col("recipe_id").isNotNull(), F.col("_o_headers").isNotNull()
    source = F.when(has_recipe, "recipe").when(has_override, "override").otherwise("confirmation")
    next_step = (
        F.when(F.col("_stale"), "rerun_required")
        .when(F.col("problem").isNotNull(), "fix_manual_recipe")
        .when(has_recipe | has_override | (F.col("_c_status") == "confirmed"), "review_artifacts")
        .otherwise("write_human_confirmation")
    )
    return joined.select(
        "sheet_id",
        "recipe_id",
        source.alias("header_source"),
        F.when(has_override, F.col("_o_row")).otherwise(F.col("_c_row")).alias("header_row"),
        F.when(has_override, F.col("_o_headers")).otherwise(F.col("_c_headers")).alias("headers"),
        F.when(next_step == "review_artifacts", "ok").otherwise("needs_human_confirmation").alias("status"),
        next_step.alias("next_step"),
        "problem",
        F.col("_c_status").alias("confirmation"),
    )


def tables_from_headers(rows: DataFrame, states: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Data rows of the sheets whose header is settled without a recipe."""
    ready = states.filter((F.col("status") == "ok") & (F.col("header_source") != "recipe"))
    return grid.table_region(rows, ready.select("sheet_id", "header_row", "headers"), regions)


def core_schema(rows: DataFrame, header_row: Column) -> DataFrame:
    """Inferred schema rows of sheets without an adapter."""
    return profile.infer_schema(rows, header_row).withColumn("schema_layer", F.lit("core"))


def run_onboarding_flow(
    scanned: DataFrame,
    root: str,
    at: Column,
    decisions: Decisions | None = None,
    required: Sequence[str] | None = None,
    key_field: str = "product_code",
    attempt: str | None = None,
) -> str:
    """Clean tables, schemas, metadata and manifests of all sheets of a scan, published per sheet.

    ``scanned`` holds rows, or what a decoder gives, with errors. A sheet is taken on with its recipe (its
    own, or the one recalled for its structure), else its override, else its confirmation; without any
    of them it gets the decision on its header and waits. All tables are written under a new attempt,
    then every sheet with output passes the gate: its rows have a cell for each column of its schema,
    and, where ``required`` names fields, ``profile.validation_gate`` holds. The ledger comes last and
    makes the sheets that passed visible to ``sheet_store.read``; sheets of an earlier attempt stay
    visible until then. Recipes that were applied are stored for their structure. Returns the attempt; a
    given one must sort after those before it.
    """
    attempt = attempt or f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    with staging(scanned.sparkSession):
        _publish_sheets(scanned, root.rstrip("/"), at, decisions or Decisions(), required, key_field, attempt)
    return attempt


_NONE = {
    "confirmations": "sheet_id string, confirmed_header_candidate string",
    "overrides": "sheet_id string, header_row bigint, renames map<string,string>",
    "sheet_recipes": "sheet_id string, recipe_id string",
    "recipes": "recipe_id string, header_row string, merge_fields array<string>, merge_all boolean",
    "fields": "recipe_id string, ord int, target string, source_pointer string, source_type string, data_type string",
    "sheet_specs": "sheet_id string, spec_id string",
    "spec_fields": "spec_id string, ord int, map_ord int, canonical string, source string, dtype string, required boolean",
    "changed": "sheet_id string",
}


def _publish_sheets(
    scanned: DataFrame, root: str, at: Column, decisions: Decisions, required: Sequence[str] | None, key_field: str, attempt: str
) -> None:
    spark = scanned.sparkSession
    told = {name: getattr(decisions, name) for name in _NONE}
    told = {name: spark.createDataFrame([], _NONE[name]) if df is None else df for name, df in told.items()}
    decoded = stage(scanned if "error" in scanned.columns else scanned.withColumn("error", F.lit(None).cast("string")), "decoded")
    rows, errors = files.readable_rows(decoded), stage(files.sheet_errors(decoded), "sheet-errors")
    evidence = examine_sheets(rows, stage(store.recipe_index(spark, root), "recipe-index"))
    hashes = stage(evidence.hashes, "hashes")

    # Recipes by key: those of this job under its attempt, recalled ones as they were stored.
    key = F.concat(F.lit(f"{attempt}/"), F.col("recipe_id"))
    given = told["sheet_recipes"].select("sheet_id", key.alias("recipe_id"), F.lit(False).alias("recalled"))
    recalled = evidence.recalled.join(given, "sheet_id", "left_anti")
    recalled = recalled.select("sheet_id", F.col("recipe_key").alias("recipe_id"), F.lit(True).alias("recalled"))
    sheet_recipes = stage(given.join(hashes, "sheet_id", "left_semi").unionByName(recalled), "sheet-recipes")
    # Recipes that no sheet of this job takes are not looked at.
    wanted = stage(sheet_recipes.select("recipe_id", "recalled").distinct(), "wanted-recipes")
    def with_recalled(name: str, table: str) -> DataFrame:
        stored = store.read_all(spark, root, table).withColumnRenamed("recipe_key", "recipe_id").drop("attempt")
        stored = stored.join(wanted.filter("recalled"), "recipe_id", "left_semi")
        given = told[name].withColumn("recipe_id", key).join(wanted.filter("NOT recalled"), "recipe_id", "left_semi")
        return stage(given.unionByName(stored), f"all-{name}")

    recipes, fields = with_recalled("recipes", "recipes"), with_recalled("fields", "recipe_fields")

    continued = continue_sheets(
        rows, evidence, told["confirmations"], told["overrides"], sheet_recipes.select("sheet_id", "recipe_id"), fields, told["changed"]
    )
    asked = reduce(DataFrame.union, [df.select("sheet_id") for df in (sheet_recipes, told["overrides"], told["confirmations"], told["changed"])])
    states = stage(continued.join(asked.distinct(), "sheet_id", "left_semi"), "states")
    ready = states.filter(F.col("status") == "ok")

    # Sheets with a recipe.
    by_recipe = stage(ready.filter(F.col("header_source") == "recipe").select("sheet_id", "recipe_id"), "by-recipe")
    parsed = stage(mapping.parse_recipe_fields(fields), "parsed-fields")
    values = mapping.apply_recipe(rows, by_recipe, recipes, fields)
    recipe_tables = values.select(
        "sheet_id", "row_idx", F.transform("values", lambda v: v["target"]).alias("headers"), F.transform("values", mapping.shown_value).alias("cells")
    )
    metadata = mapping.extract_metadata(rows, by_recipe, parsed)

    # Sheets with a settled header, as their adapter says or as they are.
    headers = stage(ready.filter(F.col("header_source") != "recipe").select("sheet_id", "header_row", "headers"), "settled-headers")
    specs = stage(told["sheet_specs"].join(headers, "sheet_id", "left_semi"), "settled-specs")
    adapted = mapping.apply_adapter(rows, headers, specs, told["spec_fields"], decisions.regions).drop("spec_id")
    plain = headers.join(specs, "sheet_id", "left_anti")
    plain_tables = grid.table_region(rows, plain, decisions.regions)
    tables = [df.select("sheet_id", "row_idx", "headers", "cells") for df in (recipe_tables, adapted, plain_tables)]
    store.append(reduce(DataFrame.unionByName, tables), root, "clean", attempt)
    clean = store.read_all(spark, root, "clean").filter(F.col("attempt") == attempt)

    kept_columns = F.transform("columns", lambda c: c["name"])
    plain_headers = grid.region_plan(plain, decisions.regions).select("sheet_id", kept_columns.alias("headers"))
    schema = [
        mapping.recipe_schema(by_recipe, recipes, parsed, clean),
        specs.join(mapping.adapter_output(told["spec_fields"]), "spec_id"),
        profile.table_schema(clean.join(plain, "sheet_id", "left_semi"), plain_headers)
        .withColumns({"source": F.col("canonical"), "schema_layer": F.lit("core")}),
    ]
    columns = ["sheet_id", "out_idx", "source", "canonical", "dtype", "required", "schema_layer"]
    store.append(reduce(DataFrame.unionByName, [df.select(*columns) for df in schema]), root, "schema", attempt)
    store.append(metadata, root, "metadata", attempt)
    written = store.read_all(spark, root, "schema").filter(F.col("attempt") == attempt)

    gate = stage(sheet_gate(ready.select("sheet_id", "header_source", "header_row"), clean, written, evidence.candidates, required, key_field), "sheet-gate")
    saved = gate.select("sheet_id", F.lit(f"{root}/clean/attempt={attempt}").alias("saved_uri"), F.col("rows").alias("rows_written"), at.alias("at"))
    store.append(saved, root, "manifest", attempt)

    passed = gate.filter("passed").select("sheet_id")
    applied = stage(by_recipe.join(passed, "sheet_id", "left_semi").join(hashes, "sheet_id"), "applied-recipes")
    fresh = applied.filter(F.col("recipe_id").startswith(f"{attempt}/")).select("recipe_id").distinct()
    for name, df in (("recipes", recipes), ("recipe_fields", fields)):
        store.append(df.join(fresh, "recipe_id", "left_semi").withColumnRenamed("recipe_id", "recipe_key"), root, name, attempt)
    entries = applied.select("structural_hash", F.col("recipe_id").alias("recipe_key"), at.alias("stored_at"), F.col("sheet_id").alias("source_run_id"))
    store.append(entries, root, "recipe_index", attempt)

    outcome = stage(_outcomes(hashes, evidence.decisions, states, gate, errors), "outcomes")
    store.append(_audit(outcome, sheet_recipes, at), root, "audit", attempt)
    store.append(outcome.withColumn("at", at), root, store.LEDGER, attempt)


def sheet_gate(
    ready: DataFrame, clean: DataFrame, schema: DataFrame, candidates: DataFrame, required: Sequence[str] | None, key_field: str
) -> DataFrame:
    """``sheet_id, rows, passed, reason`` of every sheet with output, from what was written."""
    counts = clean.groupBy("sheet_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.size("cells")).alias("_least"), F.max(F.size("cells")).alias("_most")
    )
    widths = schema.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("_columns"))
    joined = ready.select("sheet_id").join(counts, "sheet_id", "left").join(widths, "sheet_id", "left")
    width = F.coalesce("_columns", F.lit(0))
    reason = F.when(width == 0, "no_columns").when((F.col("_least") != width) | (F.col("_most") != width), "columns_differ")
    found = joined.select("sheet_id", F.coalesce("rows", F.lit(0)).alias("rows"), reason.alias("reason"))
    if required is not None:
        given = ready.filter(F.col("header_source") != "confirmation").select("sheet_id", F.lit(GIVEN_CONFIDENCE).alias("confidence"))
        chosen = ready.filter(F.col("header_source") == "confirmation").join(
            candidates.select("sheet_id", F.col("row_idx").alias("header_row"), "confidence"), ["sheet_id", "header_row"]
        )
        cells = clean.select("sheet_id", F.inline(F.arrays_zip(F.col("headers").alias("name"), F.col("cells").alias("value"))))
        facts = cells.groupBy("sheet_id", "name").agg(
            F.count(F.lit(1)).alias("cells"), F.count_if(F.trim(F.coalesce("value", F.lit(""))) == "").alias("missing")
        )
        checked = profile.validation_gate(given.unionByName(chosen.select("sheet_id", "confidence")), facts, required, key_field)
        found = found.join(checked.select("sheet_id", F.nullif("reason", F.lit("")).alias("_more")), "sheet_id", "left")
        found = found.withColumn("reason", F.coalesce("reason", "_more")).drop("_more")
    return found.withColumn("passed", F.col("reason").isNull())


GIVEN_CONFIDENCE = 0.9  # Fixed value: of a header that a person gave.


def _outcomes(hashes: DataFrame, decisions: DataFrame, states: DataFrame, gate: DataFrame, errors: DataFrame) -> DataFrame:
    """Ledger rows of all sheets: taken on, waiting, stopped by the gate, or unreadable."""
    first = hashes.join(decisions.select("sheet_id", F.col("status").alias("_first"), F.col("next_step").alias("_then")), "sheet_id", "left")
    joined = first.join(states.drop("header_row", "headers"), "sheet_id", "left").join(gate.select("sheet_id", "passed", "reason"), "sheet_id", "left")
    stopped = ~F.coalesce("passed", F.lit(True))
    status = F.when(stopped, "needs_human_confirmation").otherwise(F.coalesce("status", "_first"))
    step = F.when(stopped, "review_gate").otherwise(F.coalesce("next_step", "_then"))
    known = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    message = (
        F.when(stopped, F.concat(F.lit("Gate: "), "reason"))
        .when(step == "fix_manual_recipe", F.col("problem"))
        .when(step == "review_artifacts", F.when(F.col("header_source") == "recipe", RECIPE_SAVED).otherwise(TABLE_SAVED))
        .when(step == "write_human_confirmation", F.when(F.col("confirmation") == "unknown_candidate", UNKNOWN_CANDIDATE).otherwise(MISSING_CONFIRMATION))
        .otherwise(F.try_element_at(known, step))
    )
    taken = joined.select(
        "sheet_id", status.alias("status"), step.alias("next_step"), message.alias("message"), "header_source", "structural_hash",
        F.col("recipe_id").alias("recipe_key"), F.col("confirmation").alias("_confirmation"),
    )
    # A header that was accepted is no output yet.
    waiting = F.col("status").eqNullSafe("ok") & (F.col("next_step") == "continue_to_schema")
    taken = taken.withColumn("status", F.when(waiting, "header_selection_ok").otherwise(F.col("status")))
    failed = errors.select("sheet_id", F.lit("unreadable").alias("status"), F.lit("fix_source_file").alias("next_step"), F.col("error").alias("message"))
    return taken.unionByName(failed, allowMissingColumns=True)


def _audit(outcome: DataFrame, sheet_recipes: DataFrame, at: Column) -> DataFrame:
    """What happened to each sheet in this job, in order."""
    step, source = F.col("next_step"), F.col("header_source")
    recalled = outcome.join(sheet_recipes.filter("recalled"), "sheet_id", "left_semi")
    parts = [
        store.audit_rows(outcome.filter(step == "continue_to_schema"), 1, "header_selection_ok", at),
        store.audit_rows(outcome.filter(step == "provide_confirmed_header_candidate"), 1, "stop_due_to_ambiguous_headers", at),
        store.audit_rows(outcome.filter(step == "rerun_required"), 1, "resume_guard_file_changed", at),
        store.audit_rows(outcome.filter(F.col("status") == "unreadable"), 1, "source_unreadable", at, error=F.col("message")),
        store.audit_rows(recalled, 2, "manual_recipe_recalled", at, structural_hash=F.col("structural_hash")),
        store.audit_rows(outcome.filter((source == "override") & (step != "rerun_required")), 3, "header_override_applied", at),
        store.audit_rows(
            outcome.filter((source == "confirmation") & (F.col("_confirmation") == "confirmed") & (step != "rerun_required")),
            3, "human_confirmation_received", at,
        ),
        store.audit_rows(outcome.filter((source == "recipe") & (step == "review_artifacts")), 4, "manual_recipe_applied", at),
        store.audit_rows(outcome.filter(step == "review_gate"), 5, "stopped_by_gate", at, reason=F.col("message")),
        store.audit_rows(outcome.filter(step == "review_artifacts"), 6, "outputs_saved", at),
    ]
    return reduce(DataFrame.unionByName, parts)

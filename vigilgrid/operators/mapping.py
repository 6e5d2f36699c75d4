"""Mapping sheets to canonical columns: adapters, recipes, confirmations, metadata."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions.relational import block_join, spread_join
from ..session import stage
from .grid import LABEL_ROWS, inside_region, region_plan, resolve_header_by_labels, rows_at


def enforce_type(value: Column, dtype: Column) -> Column:
    """Cell text by target type; numbers and dates stay text, unknown types pass through."""
    return (
        F.when(dtype == "number", C.clean_number_text(value))
        .when(dtype == "date", C.clean_date_text(value))
        .otherwise(value)
    )


def adapter_output(fields: DataFrame) -> DataFrame:
    """Output columns of each adapter in order.

    ``fields``: ``spec_id, ord`` (canonical position, null when not listed), ``map_ord``,
    ``canonical, source`` (null = not mapped), ``dtype, required``. Canonical fields that are mapped
    win; only where there is none are the mapped fields taken in map order.
    """
    listed = F.col("ord").isNotNull() & F.col("source").isNotNull()
    any_listed = F.max(listed).over(Window.partitionBy("spec_id"))
    kept = fields.withColumn("_any", any_listed).filter(
        F.when(F.col("_any"), listed).otherwise(F.col("source").isNotNull())
    )
    order = F.when(F.col("_any"), F.col("ord")).otherwise(F.col("map_ord"))
    return kept.select(
        "spec_id",
        (F.row_number().over(Window.partitionBy("spec_id").orderBy(order)) - 1).alias("out_idx"),
        "source",
        "canonical",
        F.coalesce("dtype", F.lit("string")).alias("dtype"),
        F.coalesce("required", F.lit(False)).alias("required"),
        F.lit("adapter").alias("schema_layer"),
    )


def apply_adapter(
    rows: DataFrame,
    headers: DataFrame,
    sheet_specs: DataFrame,
    fields: DataFrame,
    regions: DataFrame | None = None,
) -> DataFrame:
    """Rows of each sheet as the output columns of its adapter.

    ``headers``: ``sheet_id, header_row, headers``; ``sheet_specs``: ``sheet_id, spec_id``. Many
    adapters run in one job: where a column comes from is settled once per sheet, and the rows then
    meet this plan in a single join.
    """
    column = F.struct("out_idx", "canonical", "source", "dtype")
    specs = adapter_output(fields).groupBy("spec_id").agg(F.sort_array(F.collect_list(column)).alias("_outputs"))

    def located(c: Column) -> Column:
        # The last of equal headers is the one that counts.
        same = F.filter("columns", lambda k: k["name"] == c["source"])
        return F.struct(
            c["canonical"].alias("canonical"),
            c["dtype"].alias("dtype"),
            F.try_element_at(same, F.lit(-1))["i"].alias("i"),
        )

    # One adapter may serve most sheets, so its join is spread by sheet.
    chosen = spread_join(sheet_specs, specs, ["spec_id"], ["sheet_id"], "inner")
    plan = (
        region_plan(headers, regions)
        .join(chosen, "sheet_id", "inner")
        .select("sheet_id", "spec_id", "first_row", "last_row", F.transform("_outputs", located).alias("_outputs"))
    )
    source = F.col("cells")
    joined = block_join(rows, plan, "sheet_id", "row_idx").filter(inside_region())
    return joined.select(
        "sheet_id",
        "row_idx",
        "spec_id",
        F.transform("_outputs", lambda c: c["canonical"]).alias("headers"),
        F.transform("_outputs", lambda c: enforce_type(C.cell(source, c["i"]), c["dtype"])).alias("cells"),
    )


def parse_recipe_fields(fields: DataFrame) -> DataFrame:
    """Recipe fields resolved to metadata cells or columns; what cannot be used gets a warning.

    ``fields``: ``recipe_id, ord, target, source_pointer`` (JSON text), ``source_type, data_type``. They may
    come from few files, so they are dealt out before their pointers are parsed.
    """
    fields = fields.repartition("recipe_id", "ord")
    pointer = F.trim("source_pointer")
    is_object = pointer.startswith("{")
    is_text = pointer.startswith('"')
    is_number = pointer.rlike(r"^-?[0-9]+$")

    def member(name: str) -> Column:
        return F.when(is_object, F.get_json_object(pointer, f"$.{name}"))

    row, col = member("row").try_cast("int"), member("col").try_cast("int")
    is_cell = row.isNotNull() & col.isNotNull()
    text_value = F.get_json_object(F.concat(F.lit('{"v":'), pointer, F.lit("}")), "$.v")
    named = F.coalesce(F.when(is_text, text_value), member("column"), member("header"), member("column_name"))
    plain_col = F.when(member("row").isNull(), col)
    index = F.when(is_number, pointer.try_cast("int")).otherwise(F.when(named.isNull(), plain_col))
    is_column = named.isNotNull() | index.isNotNull()
    target = F.col("target")
    kind = (
        F.when(F.coalesce(target, F.lit("")) == "", "missing_target")
        .when(pointer.isNull(), "missing_source_pointer")
        .when(F.col("source_type") == "metadata", F.when(is_cell, "metadata").otherwise("invalid_metadata_pointer"))
        .when(F.col("source_type") == "column", F.when(is_column, "column").otherwise("invalid_column_pointer"))
        .when(is_cell, "metadata")
        .when(is_column, "column")
        .otherwise("unsupported_source_pointer")
    )
    good = F.col("kind").isin("metadata", "column")
    is_meta, is_col = F.col("kind") == "metadata", F.col("kind") == "column"
    warning = F.when(F.col("kind") == "missing_target", F.col("kind")).otherwise(
        F.concat("kind", F.lit(":"), target)
    )
    return fields.withColumn("kind", kind).select(
        "recipe_id",
        "ord",
        "target",
        F.when(good, F.col("kind")).alias("kind"),
        F.when(is_meta, row).alias("row"),
        F.when(is_meta, col).alias("col"),
        F.when(is_col, named).alias("column_name"),
        F.when(is_col, index).alias("column_index"),
        F.coalesce("data_type", F.lit("string")).alias("data_type"),
        F.when(~good, warning).alias("warning"),
    )


def recipe_problems(parsed: DataFrame) -> DataFrame:
    """Recipes that cannot build a table, with the reason."""
    counts = parsed.groupBy("recipe_id").agg(
        F.count_if(F.col("kind") == "column").alias("_columns"),
        F.count_if(F.col("kind") == "metadata").alias("_metadata"),
    )
    problem = F.when(
        (F.col("_columns") == 0) & (F.col("_metadata") == 0), "Manual recipe has no usable fields."
    ).when(F.col("_columns") == 0, "Manual recipe must include at least one column field to build a table.")
    return counts.select("recipe_id", problem.alias("problem")).filter(F.col("problem").isNotNull())


def _typed(value: Column, dtype: Column) -> Column:
    """One cleaned value with a slot per type; only the slot of its type is filled."""
    return F.struct(
        F.when(dtype == "number", C.clean_number(value)).alias("number"),
        F.when(dtype == "date", C.clean_date(value)).alias("date"),
        F.when(~dtype.isin("number", "date"), C.clean_string(value)).alias("text"),
    )


def extract_metadata(
    rows: DataFrame, sheet_recipes: DataFrame, parsed: DataFrame, narrowed: bool = False
) -> DataFrame:
    """Single cells named by the recipe of a sheet; cells outside the grid are empty.

    ``narrowed``: ``rows`` are cut to the rows in question already.
    """
    cells = parsed.filter(F.col("kind") == "metadata")
    wanted = spread_join(sheet_recipes, cells, ["recipe_id"], ["sheet_id"], "inner").select(
        "sheet_id", "recipe_id", "ord", "target", F.col("row").cast("bigint").alias("row_idx"), "col", "data_type"
    )
    if not narrowed:
        wanted = stage(wanted, "metadata-cells")
    near = rows if narrowed else rows_at(rows, wanted)
    located = wanted.join(near, ["sheet_id", "row_idx"], "left")
    empty = F.array().cast("array<string>")
    return located.select(
        "sheet_id",
        "ord",
        "target",
        "data_type",
        C.cell(F.coalesce("cells", empty), F.col("col")).alias("value"),
    )


def apply_recipe(rows: DataFrame, sheet_recipes: DataFrame, recipes: DataFrame, fields: DataFrame) -> DataFrame:
    """Clean, typed rows of every sheet that has a usable recipe.

    ``sheet_recipes``: ``sheet_id, recipe_id``; ``recipes``: ``recipe_id, header_row`` (text or
    null), ``merge_fields`` (array or null), ``merge_all``. The result has ``values``, an array of
    ``(target, data_type, number, date, text)`` in output order. A plan per sheet (column positions
    and cleaned metadata) is built from the top rows and joined to the data rows once.
    """
    parsed = stage(parse_recipe_fields(fields).filter(F.col("kind").isNotNull()), "recipe-fields")
    # Rows that may be headers or hold metadata.
    explicit = recipes.select("recipe_id", F.col("header_row").try_cast("int").alias("row_idx"))
    named = explicit.union(parsed.filter(F.col("kind") == "metadata").select("recipe_id", "row"))
    named = named.filter(F.col("row_idx") >= LABEL_ROWS).distinct()
    wanted_rows = spread_join(sheet_recipes, named, ["recipe_id"], ["sheet_id"], "inner")
    near = stage(rows_at(rows, wanted_rows, top=LABEL_ROWS), "near-rows")
    column = F.struct("ord", "target", "column_name", "column_index", "data_type")
    by_recipe = (
        parsed.filter(F.col("kind") == "column")
        .groupBy("recipe_id")
        .agg(F.sort_array(F.collect_list(column)).alias("_columns"))
    )
    # One recipe may serve most sheets, so its join is spread by sheet.
    whole = recipes.hint("merge").join(by_recipe, "recipe_id", "inner")
    usable = spread_join(sheet_recipes, whole, ["recipe_id"], ["sheet_id"], "inner")
    wanted = usable.select(
        "sheet_id",
        "header_row",
        F.filter(F.transform("_columns", lambda c: c["column_name"]), lambda n: n.isNotNull()).alias("labels"),
    )
    header_rows = resolve_header_by_labels(near, wanted)
    header_cells = near.select(
        "sheet_id", F.col("row_idx").alias("header_row"), F.transform("cells", C.normalize_label).alias("_labels")
    )
    located = header_rows.join(header_cells, ["sheet_id", "header_row"], "left").select(
        "sheet_id",
        F.col("header_row").alias("_header_row"),
        F.coalesce("_labels", F.array().cast("array<string>")).alias("_labels"),
    )
    labels = F.col("_labels")

    def position(c: Column) -> Column:
        label = C.normalize_label(c["column_name"])
        found = F.array_position(labels, label).cast("int")
        return F.coalesce(c["column_index"], F.when((found > 0) & (label != ""), found - 1))

    metadata = extract_metadata(near, sheet_recipes, parsed, narrowed=True)
    typed_meta = _typed(F.col("value"), F.col("data_type"))
    meta_maps = metadata.groupBy("sheet_id").agg(
        F.sort_array(
            F.collect_list(F.struct("ord", "target", "data_type", typed_meta.alias("value")))
        ).alias("_meta")
    )
    no_meta = F.slice(F.col("_meta"), 1, 0)
    plan = (
        usable.join(located, "sheet_id", "inner")
        .join(meta_maps, "sheet_id", "left")
        .select(
            "sheet_id",
            "recipe_id",
            "_header_row",
            F.transform(
                "_columns",
                lambda c: F.struct(position(c).alias("i"), c["target"].alias("target"), c["data_type"].alias("data_type")),
            ).alias("_plan"),
            _merge_list(no_meta).alias("_merged"),
        )
    )
    source = F.col("cells")

    def output(c: Column) -> Column:
        v = _typed(C.cell(source, c["i"]), c["data_type"])
        return F.struct(
            c["target"].alias("target"), c["data_type"].alias("data_type"), v["number"].alias("number"),
            v["date"].alias("date"), v["text"].alias("text"),
        )

    data = block_join(rows, plan, "sheet_id", "row_idx").filter(F.col("row_idx") > F.col("_header_row"))
    return data.select(
        "sheet_id", "row_idx", "recipe_id", F.concat(F.transform("_plan", output), F.col("_merged")).alias("values")
    )


def _merge_list(no_meta: Column) -> Column:
    """Metadata values to add to every row, in the order of the merge list of the recipe."""
    empty = F.array().cast("array<string>")
    listed = F.coalesce("merge_fields", empty)
    known = F.coalesce(F.col("_meta"), no_meta)
    all_targets = F.coalesce(F.transform("_meta", lambda m: m["target"]), empty)
    names = F.when((F.size(listed) == 0) & F.coalesce("merge_all", F.lit(False)), all_targets).otherwise(listed)

    def entry(name: Column) -> Column:
        # The last field with this target wins; a name without one gives an empty text.
        found = F.try_element_at(F.filter(known, lambda m: m["target"] == name), F.lit(-1))
        missing = found.isNull()
        return F.struct(
            name.alias("target"),
            F.coalesce(found["data_type"], F.lit("string")).alias("data_type"),
            found["value"]["number"].alias("number"),
            found["value"]["date"].alias("date"),
            F.when(missing, F.lit("")).otherwise(found["value"]["text"]).alias("text"),
        )

    return F.transform(names, entry)


def shown_value(value: Column) -> Column:
    """Text of one output value: numbers as doubles, dates by day, nothing as empty."""
    return F.coalesce(value["text"], value["number"].cast("string"), F.date_format(value["date"], "yyyy-MM-dd"), F.lit(""))


def recipe_schema(sheet_recipes: DataFrame, recipes: DataFrame, parsed: DataFrame, clean: DataFrame) -> DataFrame:
    """Schema rows of the tables that recipes made: columns in field order, then the merged metadata.

    A column is required if no row of the sheet leaves it blank; ``clean`` has the rows that were written.
    """
    ordered = F.struct("ord", "target", F.coalesce("column_name", F.concat(F.lit("col_"), F.col("column_index"))).alias("source"), "data_type")
    kinds = parsed.groupBy("recipe_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "column", ordered))).alias("_columns"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "metadata", ordered))).alias("_meta"),
    )
    targets = F.transform("_meta", lambda m: m["target"])
    empty = F.array().cast("array<string>")
    listed = F.coalesce("merge_fields", empty)
    merged = F.when((F.size(listed) == 0) & F.coalesce("merge_all", F.lit(False)), targets).otherwise(listed)

    def merged_field(name: Column) -> Column:
        found = F.try_element_at(F.filter("_meta", lambda m: m["target"] == name), F.lit(-1))
        return F.struct(name.alias("target"), name.alias("source"), F.coalesce(found["data_type"], F.lit("string")).alias("data_type"))

    columns = F.transform("_columns", lambda c: F.struct(c["target"].alias("target"), c["source"].alias("source"), c["data_type"].alias("data_type")))
    plans = recipes.hint("merge").join(kinds, "recipe_id").select("recipe_id", F.concat(columns, F.transform(merged, merged_field)).alias("_fields"))
    per_sheet = spread_join(sheet_recipes, plans, ["recipe_id"], ["sheet_id"], "inner")
    fields = per_sheet.select("sheet_id", F.posexplode("_fields").alias("out_idx", "_f"))
    cells = clean.join(sheet_recipes.select("sheet_id"), "sheet_id", "left_semi").select("sheet_id", F.posexplode("cells").alias("out_idx", "_v"))
    filled = cells.groupBy("sheet_id", "out_idx").agg(F.bool_and(~C.blank(F.col("_v"))).alias("_full"))
    return fields.join(filled, ["sheet_id", "out_idx"], "left").select(
        "sheet_id", "out_idx", F.col("_f.source").alias("source"), F.col("_f.target").alias("canonical"), F.col("_f.data_type").alias("dtype"),
        F.coalesce("_full", F.lit(False)).alias("required"), F.lit("manual_recipe").alias("schema_layer"),
    )


def wide(values: DataFrame, targets: Sequence[tuple[str, str]]) -> DataFrame:
    """Typed columns from ``values`` for the targets of one recipe: ``(name, type)`` pairs."""
    slot = {"number": "number", "date": "date"}

    def pick(name: str, dtype: str) -> Column:
        hit = F.try_element_at(F.filter("values", lambda v: v["target"] == name), F.lit(1))
        return hit[slot.get(dtype, "text")].alias(name)

    return values.select("sheet_id", "row_idx", *[pick(n, t) for n, t in targets])


def attach_metadata(data: DataFrame, metadata: DataFrame, merge_fields: Sequence[str]) -> DataFrame:
    """Metadata values of a sheet on each of its rows, as text columns in merge order.

    ``data`` has ``sheet_id, row_idx`` and more; ``metadata``: ``sheet_id, target, data_type, value``.
    """
    typed = _typed(F.col("value"), F.col("data_type"))
    as_text = F.coalesce(
        typed["text"], F.date_format(typed["date"], "yyyy-MM-dd"), typed["number"].cast("string"), F.lit("")
    )
    values = [F.max(F.when(F.col("target") == name, as_text)).alias(name) for name in merge_fields]
    # Every sheet takes part, also one without metadata.
    sheets = data.select("sheet_id").distinct()
    per_sheet = sheets.join(metadata, "sheet_id", "left").groupBy("sheet_id").agg(*values)
    joined = block_join(data, per_sheet, "sheet_id", "row_idx")
    return joined.select(
        *data.columns, *[F.coalesce(F.col(name), F.lit("")).alias(name) for name in merge_fields]
    )


def store_recipe(index: DataFrame, new: DataFrame) -> DataFrame:
    """Recipe index after an upsert by structural hash; the newest entry wins."""
    rows = index.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    order = [F.col("stored_at").desc(), F.col("_src").desc(), F.col("source_run_id").desc()]
    window = Window.partitionBy("structural_hash").orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") == 1).drop("_rn", "_src")


def recall_recipe(hashes: DataFrame, index: DataFrame) -> DataFrame:
    """Recipe of each sheet whose structure is known. The index has one row per structure.

    Many sheets may share a structure, so the join is spread by sheet.
    """
    known = index.select("structural_hash", "recipe_key")
    return spread_join(hashes, known, ["structural_hash"], ["sheet_id"], "inner")


def unmatched_sheets(hashes: DataFrame, index: DataFrame) -> DataFrame:
    known = index.select("structural_hash")
    return spread_join(hashes, known, ["structural_hash"], ["sheet_id"], "left_anti")


def apply_confirmations(sheets: DataFrame, candidates: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Header chosen by a person for each sheet, or what is still missing."""
    chosen = confirmations.select("sheet_id", F.col("confirmed_header_candidate").alias("candidate_id"))
    known = candidates.select("sheet_id", "candidate_id", F.col("row_idx").alias("header_row"), "headers")
    joined = (
        sheets.select("sheet_id")
        .join(chosen, "sheet_id", "left")
        .join(known, ["sheet_id", "candidate_id"], "left")
    )
    status = (
        F.when(F.col("candidate_id").isNull(), "missing_confirmation")
        .when(F.col("header_row").isNull(), "unknown_candidate")
        .otherwise("confirmed")
    )
    return joined.select("sheet_id", "candidate_id", "header_row", "headers", status.alias("status"))


def resume_guard(expected: DataFrame, current: DataFrame) -> DataFrame:
    """Source files compared with the start of the run: changed files have to be run again."""
    joined = expected.select("path", F.col("file_hash").alias("_was")).join(
        current.select("path", F.col("file_hash").alias("_is")), "path", "full"
    )
    state = (
        F.when(F.col("_was").isNull(), "new")
        .when(F.col("_is").isNull(), "missing")
        .when(F.col("_was") != F.col("_is"), "changed")
        .otherwise("same")
    )
    next_step = F.when(F.col("state") == "changed", "rerun_required").otherwise("continue")
    return joined.select("path", state.alias("state")).withColumn("next_step", next_step)


def unpivot_sheet(
    df: DataFrame,
    ids: Sequence[str] = ("product_code",),
    columns: Sequence[str] | None = None,
    var_name: str = "period",
    value_name: str = "value",
) -> DataFrame:
    values = [c for c in df.columns if c not in ids] if columns is None else list(columns)
    return df.unpivot(list(ids), values, var_name, value_name)


def combine_outputs(outputs: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Union of differing output tables by column name; absent columns are null."""
    tagged = [df.withColumn("source_run_id", F.lit(run_id)) for run_id, df in outputs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def combine_long(outputs: DataFrame) -> DataFrame:
    """The same for very many tables in one long table: each row as a map from name to value.

    ``outputs``: ``sheet_id, row_idx, headers, cells``.
    """
    pairs = F.arrays_zip(F.col("headers").alias("name"), F.col("cells").alias("value"))
    # Of equal names the first one is kept; a map must not hold a key twice.
    unique = F.filter(pairs, lambda p, i: F.array_position("headers", p["name"]) == i + 1)
    return outputs.select(
        F.col("sheet_id").alias("source_run_id"), "row_idx", F.map_from_entries(unique).alias("record")
    )

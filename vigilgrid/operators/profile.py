"""Column profiles of sheets: inferred schemas, completeness, gates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C


def _cell_facts(rows: DataFrame, header_row: Column) -> DataFrame:
    """One row per sheet and column from a single pass over all cells.

    Every row also counts under column -1, which gives the number of data rows without a second
    scan. All aggregates combine on the map side, so a sheet of any length is fine.
    """
    numbered = F.transform("cells", lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    row_mark = F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("v")))
    listed = F.when(F.col("row_idx") >= header_row, F.concat(row_mark, numbered)).otherwise(row_mark)
    long = rows.select(
        "sheet_id", (F.col("row_idx") > header_row).alias("_data"), F.inline(listed).alias("col_idx", "value")
    )
    data = F.col("_data")
    value = F.col("value")
    present = data & ~C.blank(value)
    named = ~data & (F.col("col_idx") >= 0)
    return long.groupBy("sheet_id", "col_idx").agg(
        F.max(F.when(named, C.normalize_header(value, F.col("col_idx")))).alias("name"),
        F.count_if(data).alias("cells"),
        F.count_if(present).alias("filled"),
        F.bool_and(F.when(present, C.numeric_like(value))).alias("numeric"),
        F.bool_and(F.when(present, C.parse_date(value).isNotNull())).alias("dates"),
    )


def _column_facts(rows: DataFrame, header_row: Column) -> DataFrame:
    """Facts of the columns that have a header, with the number of data rows of their sheet."""
    facts = _cell_facts(rows, header_row)
    sheet = Window.partitionBy("sheet_id")
    total = F.max(F.when(F.col("col_idx") == -1, F.col("cells"))).over(sheet)
    return facts.withColumn("data_rows", total).filter((F.col("col_idx") >= 0) & F.col("name").isNotNull())


def infer_schema(rows: DataFrame, header_row: Column) -> DataFrame:
    """Inferred type per column: number where every value looks like one, else string.

    Required means a non-blank cell in every data row; a short row counts as blank.
    """
    facts = _column_facts(rows, header_row)
    return facts.select(
        "sheet_id",
        "col_idx",
        F.col("name").alias("canonical"),
        F.when(F.coalesce("numeric", F.lit(False)), "number").otherwise("string").alias("dtype"),
        ((F.col("data_rows") > 0) & (F.col("filled") == F.col("data_rows"))).alias("required"),
    )


def infer_schema_with_dates(rows: DataFrame, header_row: Column) -> DataFrame:
    """Inferred type per column with dates. This is the canonical schema of a reference sheet.

    Required means no missing cell, which for a sheet without data rows holds trivially.
    """
    facts = _column_facts(rows, header_row)
    dtype = (
        F.when(F.coalesce("numeric", F.lit(False)), "number")
        .when(F.coalesce("dates", F.lit(False)), "date")
        .otherwise("string")
    )
    return facts.select(
        "sheet_id",
        "col_idx",
        F.col("name").alias("canonical"),
        dtype.alias("dtype"),
        (F.col("filled") == F.col("data_rows")).alias("required"),
    )


def table_schema(tables: DataFrame, headers: DataFrame) -> DataFrame:
    """Schema of tables that were cut out already: ``sheet_id, out_idx, canonical, dtype, required``.

    ``tables``: ``sheet_id, headers, cells`` with a cell per header; ``headers``: ``sheet_id, headers`` of
    every sheet, also of those without data rows, whose columns are strings and not required.
    """
    cells = tables.select("sheet_id", F.posexplode("cells").alias("out_idx", "_v"))
    present = ~C.blank(F.col("_v"))
    facts = cells.groupBy("sheet_id", "out_idx").agg(
        F.count(F.lit(1)).alias("_cells"),
        F.count_if(present).alias("_filled"),
        F.bool_and(F.when(present, C.numeric_like(F.col("_v")))).alias("_numeric"),
    )
    named = headers.select("sheet_id", F.posexplode("headers").alias("out_idx", "canonical"))
    return named.join(facts, ["sheet_id", "out_idx"], "left").select(
        "sheet_id",
        "out_idx",
        "canonical",
        F.when(F.coalesce("_numeric", F.lit(False)), "number").otherwise("string").alias("dtype"),
        F.coalesce((F.col("_cells") > 0) & (F.col("_filled") == F.col("_cells")), F.lit(False)).alias("required"),
    )


def canonical_schema(rows: DataFrame, header_row: int) -> DataFrame:
    return infer_schema_with_dates(rows, F.lit(header_row))


def missing_required_pct(rows: DataFrame, header_row: Column, required: Sequence[str]) -> DataFrame:
    """Percentage of blank cells among the required columns, found by their header."""
    names = list(dict.fromkeys(required))
    # The first column of a name counts; a required column that a sheet lacks is blank in every row.
    filled = [
        F.coalesce(F.min_by("filled", F.when(F.col("name") == n, F.col("col_idx"))), F.lit(0)) for n in names
    ]
    per_sheet = _cell_facts(rows, header_row).groupBy("sheet_id").agg(
        F.max(F.when(F.col("col_idx") == -1, F.col("cells"))).alias("rows"),
        reduce(lambda a, b: a + b, filled, F.lit(0)).alias("filled"),
    )
    cells = F.col("rows") * F.lit(len(names))
    share = F.round(F.lit(100.0) * (cells - F.col("filled")) / F.greatest(cells, F.lit(1)), 1)
    return per_sheet.select("sheet_id", F.when(cells > 0, share).otherwise(0.0).alias("missing_required_pct"))


def output_row_counts(output: DataFrame, key: str = "sheet_id") -> DataFrame:
    """Records per output table."""
    return output.groupBy(key).agg(F.count(F.lit(1)).alias("rows_written"))


def transform_report(long: DataFrame, types: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """Per sheet and field: casts that failed and required values that are missing.

    ``long`` has one row per cell (``sheet_id, name, value``); ``types`` lists the target type of each
    field and whether it is required, and is part of the plan, so no join is needed.
    """
    name, value = F.col("name"), F.col("value")

    def fields(keep) -> list[str]:
        return [t[0] for t in types if keep(t)]

    failed = ~C.blank(value) & (
        (name.isin(fields(lambda t: t[1] == "number")) & C.clean_number(value).isNull())
        | (name.isin(fields(lambda t: t[1] == "date")) & C.parse_date(value).isNull())
    )
    needed = name.isin(fields(lambda t: t[2]))
    return (
        long.filter(name.isin(fields(lambda t: True)))
        .groupBy("sheet_id", "name")
        .agg(
            F.count(F.lit(1)).alias("cells"),
            F.count_if(failed).alias("casts_failed"),
            F.count_if(needed & C.blank(value)).alias("missing_required"),
        )
    )


# Limits of the onboarding gate.
MIN_HEADER_CONFIDENCE = 0.70
MAX_MISSING_KEY_PCT = 5.0


def validation_gate(
    decisions: DataFrame, facts: DataFrame, required: Sequence[str], key_field: str = "product_code"
) -> DataFrame:
    """Pass or stop per sheet.

    ``decisions``: ``sheet_id, confidence``. ``facts``: ``sheet_id, name, cells, missing`` per mapped
    field. Stops on a weak header, a required field that is not mapped, or a key field that is
    missing in more than five percent of the rows.
    """
    mapped = facts.groupBy("sheet_id").agg(
        F.max("cells").alias("row_count"),
        F.count_if(F.col("name").isin(list(required))).alias("_mapped"),
        F.max(
            F.when(F.col("name") == key_field, F.lit(100.0) * F.col("missing") / F.greatest(F.lit(1), F.col("cells")))
        ).alias("_key_missing"),
    )
    joined = decisions.select("sheet_id", "confidence").join(mapped, "sheet_id", "left")
    reason = (
        F.when(F.col("confidence") < MIN_HEADER_CONFIDENCE, "header_confidence")
        .when(F.coalesce("_mapped", F.lit(0)) < len(set(required)), "required_unmapped")
        .when(F.coalesce("_key_missing", F.lit(0.0)) > MAX_MISSING_KEY_PCT, "key_missing")
    )
    return joined.select(
        "sheet_id",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        reason.isNull().alias("passed"),
        F.coalesce(reason, F.lit("")).alias("reason"),
    )

"""Cell grids: previews, header detection, regions.

A grid is ``sheet_rows(sheet_id, row_idx, cells)``. Operators that look at the top of a sheet filter
on ``row_idx`` first, so their windows see a fixed number of rows per sheet; operators over all rows
work cell by cell with map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions.relational import block_join
from ..functions.text import strip

PREVIEW_ROWS = 5
DENSITY_ROWS = 100
LABEL_ROWS = 50
DATA_PENALTY = 0.2
MAX_CONFIDENCE = 0.95


def preview_rows(rows: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows of every sheet."""
    return rows.filter(F.col("row_idx") < n)


def structural_hash(rows: DataFrame) -> DataFrame:
    """Hash of the normalised labels of the first five rows of each sheet."""
    line = F.array_join(F.transform("cells", C.normalize_label), "|")
    tops = preview_rows(rows).groupBy("sheet_id").agg(
        F.sort_array(F.collect_list(F.struct("row_idx", line.alias("line")))).alias("_lines")
    )
    text = F.array_join(F.transform("_lines", lambda r: r["line"]), "\n")
    return tops.select("sheet_id", F.sha2(text, 256).alias("structural_hash"))


def header_candidates(rows: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """Every preview row as a possible header, with a confidence."""
    top = preview_rows(rows, n)
    width = F.max(F.size("cells")).over(Window.partitionBy("sheet_id"))
    filled = F.size(F.filter("cells", lambda v: ~C.blank(v)))
    scored = top.withColumns(
        {"_width": width, "headers": C.normalize_headers(F.col("cells")), "_filled": filled}
    )
    looks = C.header_looks_like_data(F.col("headers"))
    fill = F.when(F.col("_width") > 0, F.col("_filled") / F.col("_width")).otherwise(F.lit(0.0))
    raw = F.least(F.greatest(fill - F.when(looks, DATA_PENALTY).otherwise(0.0), F.lit(0.0)), F.lit(MAX_CONFIDENCE))
    return scored.select(
        "sheet_id",
        "row_idx",
        F.concat(F.lit("row_"), F.col("row_idx").cast("string")).alias("candidate_id"),
        "headers",
        F.bround(raw, 3).alias("confidence"),
        looks.alias("looks_like_data"),
    )


def best_header(candidates: DataFrame) -> DataFrame:
    """Most confident candidate of each sheet; the upper one on a tie."""
    rank = Window.partitionBy("sheet_id").orderBy(F.col("confidence").desc(), F.col("row_idx").asc())
    return candidates.withColumn("_rn", F.row_number().over(rank)).filter(F.col("_rn") == 1).drop("_rn")


def header_decision(candidates: DataFrame) -> DataFrame:
    """Accepted header per sheet, or the choices a person has to pick from."""
    choice = F.struct("row_idx", "candidate_id", "headers", "confidence", "looks_like_data")
    merged = candidates.groupBy("sheet_id").agg(
        F.min(F.struct((-F.col("confidence")).alias("neg"), F.col("row_idx"), choice.alias("c"))).alias("_best"),
        F.sort_array(F.collect_list(choice)).alias("_all"),
    )
    ambiguous = F.col("_best.c.looks_like_data")
    return merged.select(
        "sheet_id",
        F.col("_best.c.candidate_id").alias("selected_candidate_id"),
        F.col("_best.c.headers").alias("headers"),
        F.col("_best.row_idx").alias("header_row"),
        F.when(ambiguous, "needs_human_confirmation").otherwise("ok").alias("status"),
        F.when(ambiguous, "provide_confirmed_header_candidate")
        .otherwise("continue_to_schema")
        .alias("next_step"),
        F.when(ambiguous, F.transform("_all", lambda c: c["candidate_id"]))
        .otherwise(F.array().cast("array<string>"))
        .alias("choices"),
    )


def suggest_header_by_density(rows: DataFrame, sample_rows: int = DENSITY_ROWS) -> DataFrame:
    """First row that, like the row after it, is more than half filled; row 0 where none is."""
    sheet = Window.partitionBy("sheet_id")
    filled = F.size(F.filter("cells", lambda v: ~C.blank(v)))
    dense = (
        preview_rows(rows, sample_rows)
        .select("sheet_id", "row_idx", filled.alias("_filled"), F.size("cells").alias("_size"))
        .withColumn("_dense", F.col("_filled") > F.max("_size").over(sheet) * 0.5)
        .withColumn("_next", F.lead("_dense").over(sheet.orderBy("row_idx")))
    )
    first = F.min(F.when(F.col("_dense") & F.col("_next"), F.col("row_idx")))
    return dense.groupBy("sheet_id").agg(F.coalesce(first, F.lit(0)).cast("bigint").alias("suggested_header"))


def resolve_header_by_labels(rows: DataFrame, wanted: DataFrame, search_rows: int = LABEL_ROWS) -> DataFrame:
    """Header row of each sheet: the one given, else the row that holds most of the wanted labels.

    ``wanted`` has ``sheet_id, header_row`` (text, null = search) and ``labels`` (array).
    An explicit row that is not a number means row 0.
    """
    # Labels are normalised on both sides before the join: once per sheet, and once per row.
    usable = F.array_distinct(F.filter(F.transform("labels", C.normalize_label), lambda v: v != ""))
    specs = wanted.select("sheet_id", "header_row", usable.alias("_wanted"))
    top = preview_rows(rows, search_rows).select(
        "sheet_id", "row_idx", F.transform("cells", C.normalize_label).alias("_labels")
    )
    matches = F.size(F.array_intersect("_wanted", "_labels"))
    ranked = (
        specs.join(top, "sheet_id", "left")
        .groupBy("sheet_id")
        .agg(
            F.max("header_row").alias("_given"),
            F.min_by("row_idx", F.struct(-matches, F.col("row_idx"))).alias("_found"),
        )
    )
    given = F.coalesce(F.col("_given").try_cast("int"), F.lit(0))
    row = F.when(F.col("_given").isNotNull(), given).otherwise(F.coalesce(F.col("_found"), F.lit(0)))
    return ranked.select("sheet_id", row.cast("bigint").alias("header_row"))


def rows_at(rows: DataFrame, wanted: DataFrame, top: int = 0) -> DataFrame:
    """Rows named by ``wanted`` (``sheet_id, row_idx``) and the first ``top`` rows of every sheet.

    A semi-join on sheet and row, whatever the number of wanted rows: the plan is the same for ten and
    for ten million, and nothing is collected. Spark broadcasts the wanted keys if they are small, and
    else prunes the rows by a Bloom filter of them before the exchange. Rows at the top come from a
    filter that reaches the scan.
    """
    keys = wanted.select("sheet_id", F.col("row_idx").cast("bigint").alias("row_idx"))
    keys = keys.filter(F.col("row_idx") >= top).distinct()
    named = rows.filter(F.col("row_idx") >= top).join(keys, ["sheet_id", "row_idx"], "left_semi")
    return named if top <= 0 else rows.filter(F.col("row_idx") < top).unionByName(named)


def apply_header_override(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Headers of the chosen row, renamed. ``overrides`` has ``sheet_id, header_row, renames``."""
    near = rows_at(rows, overrides.select("sheet_id", F.col("header_row").alias("row_idx")))
    chosen = overrides.join(
        near.select("sheet_id", F.col("row_idx").alias("header_row"), "cells"), ["sheet_id", "header_row"], "left"
    )
    names = C.normalize_headers(F.coalesce(F.col("cells"), F.array().cast("array<string>")))
    renamed = F.transform(names, lambda h: F.coalesce(F.try_element_at("renames", h), h))
    return chosen.select("sheet_id", "header_row", renamed.alias("headers"))


def flatten_headers(rows: DataFrame, start: int, end: int) -> DataFrame:
    """One name per column from a header of several rows.

    Blanks take the value to their left; the parts of a column are joined with ``_``.
    """

    def fill_right(cells: Column) -> Column:
        # Each usable cell covers the places up to the next one, so a row of any width is filled in one pass.
        usable = F.transform(cells, lambda v: F.when(~C.blank(v) & (F.lower(strip(v)) != "nan"), strip(v)))
        placed = F.filter(
            F.transform(usable, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda c: c["v"].isNotNull() | (c["i"] == 0)
        )
        ends = F.concat(F.slice(F.transform(placed, lambda c: c["i"]), 2, F.size(cells)), F.array(F.size(cells)))
        spans = F.zip_with(placed, ends, lambda c, end: F.array_repeat(c["v"], end - c["i"]))
        return F.when(F.size(cells) > 0, F.flatten(spans)).otherwise(F.array().cast("array<string>"))

    header = rows.filter(F.col("row_idx").between(start, end))
    merged = header.groupBy("sheet_id").agg(
        F.sort_array(F.collect_list(F.struct("row_idx", fill_right(F.col("cells")).alias("parts")))).alias("_rows")
    )
    width = F.array_max(F.transform("_rows", lambda r: F.size(r["parts"])))
    positions = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda i: F.array_join(F.transform("_rows", lambda r: F.get(r["parts"], i)), "_")
    return merged.select("sheet_id", F.transform(positions, name).alias("headers"))


def headers_at(rows: DataFrame, header_row: Column) -> DataFrame:
    """Normalised headers per sheet; ``header_row`` may be a constant or a column of ``rows``."""
    return rows.filter(F.col("row_idx") == header_row).select(
        "sheet_id", F.col("row_idx").alias("header_row"), C.normalize_headers(F.col("cells")).alias("headers")
    )


def region_plan(headers: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Per sheet: first and last data row (absolute, inclusive) and the columns to keep.

    ``headers``: ``sheet_id, header_row, headers``. ``regions``: ``sheet_id, start_row, end_row``
    (null = open), ``include_columns``, ``exclude_columns``; included columns win over excluded ones.
    """
    spec = headers
    if regions is not None:
        spec = headers.join(regions, "sheet_id", "left")
    else:
        for name in ("start_row", "end_row"):
            spec = spec.withColumn(name, F.lit(None).cast("bigint"))
        for name in ("include_columns", "exclude_columns"):
            spec = spec.withColumn(name, F.lit(None).cast("array<string>"))
    included = F.coalesce(F.size("include_columns"), F.lit(0)) > 0
    excluded = F.coalesce(F.size("exclude_columns"), F.lit(0)) > 0
    kept = F.filter(
        F.transform("headers", lambda h, i: F.struct(i.alias("i"), h.alias("name"))),
        lambda c: F.when(included, F.array_contains("include_columns", c["name"]))
        .when(excluded, ~F.array_contains("exclude_columns", c["name"]))
        .otherwise(True),
    )
    return spec.select(
        "sheet_id",
        F.greatest(F.col("header_row") + 1, F.coalesce("start_row", F.lit(0))).alias("first_row"),
        F.col("end_row").alias("last_row"),
        kept.alias("columns"),
    )


def inside_region() -> Column:
    return (F.col("row_idx") >= F.col("first_row")) & F.coalesce(
        F.col("row_idx") <= F.col("last_row"), F.lit(True)
    )


def table_region(rows: DataFrame, headers: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Data rows and columns inside the region of each sheet; short rows are filled up."""
    source = F.col("cells")
    joined = block_join(rows, region_plan(headers, regions), "sheet_id", "row_idx").filter(inside_region())
    return joined.select(
        "sheet_id",
        "row_idx",
        F.transform("columns", lambda c: c["name"]).alias("headers"),
        F.transform("columns", lambda c: C.cell(source, c["i"])).alias("cells"),
    )


def column_inventory(rows: DataFrame, header_row: int) -> DataFrame:
    """Index, name and first value of every column; two rows per sheet are read."""
    top = rows.filter(F.col("row_idx").isin(header_row, header_row + 1))
    both = top.groupBy("sheet_id").agg(
        F.max(F.when(F.col("row_idx") == header_row, F.col("cells"))).alias("_names"),
        F.max(F.when(F.col("row_idx") == header_row + 1, F.col("cells"))).alias("_values"),
    )
    listed = both.filter(F.col("_names").isNotNull() & F.col("_values").isNotNull()).select(
        "sheet_id", "_values", F.posexplode("_names").alias("col_idx", "_name")
    )
    name = strip(F.col("_name"))
    empty = (name == "") | name.contains("Unnamed")
    return listed.select(
        "sheet_id",
        "col_idx",
        F.when(empty, "(Empty Header)").otherwise(name).alias("original_name"),
        C.cell(F.col("_values"), F.col("col_idx")).alias("sample_value"),
    )


def column_samples(rows: DataFrame, header_row: int, n: int = 3) -> DataFrame:
    """First values of each column, joined; columns without a header are ``col_<i>``."""
    top = rows.filter((F.col("row_idx") >= header_row) & (F.col("row_idx") <= header_row + n))
    values = F.when(F.col("row_idx") > header_row, F.struct("row_idx", "cells"))
    merged = top.groupBy("sheet_id").agg(
        F.max(F.when(F.col("row_idx") == header_row, F.col("cells"))).alias("_names"),
        F.max(F.size("cells")).alias("_width"),
        F.sort_array(F.collect_list(values)).alias("_rows"),
    )
    positions = F.sequence(F.lit(0), F.col("_width") - 1)
    listed = merged.filter(F.col("_width") > 0).select(
        "sheet_id", "_names", "_rows", F.explode(positions).alias("col_idx")
    )
    present = F.filter("_rows", lambda r: F.size(r["cells"]) > F.col("col_idx"))
    fallback = F.concat(F.lit("col_"), F.col("col_idx").cast("string"))
    name = F.get("_names", F.col("col_idx"))
    return listed.select(
        "sheet_id",
        "col_idx",
        F.when(name.isNull() | C.blank(name), fallback).otherwise(name).alias("name"),
        F.array_join(F.transform(present, lambda r: F.get(r["cells"], F.col("col_idx"))), ", ").alias("samples"),
    )


def rows_to_table(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Data rows in long form: one row per cell under its header; missing cells are empty."""
    data = table_region(rows, headers)
    return data.select(
        "sheet_id", "row_idx", F.posexplode(F.arrays_zip("headers", "cells")).alias("col_idx", "_c")
    ).select(
        "sheet_id", "row_idx", "col_idx", F.col("_c.headers").alias("name"), F.col("_c.cells").alias("value")
    )


def project_columns(rows: DataFrame, names: Sequence[str], header_row: int) -> DataFrame:
    """Wide form for sheets that share one layout: cells by position as named columns."""
    data = rows.filter(F.col("row_idx") > header_row)
    return data.select(
        "sheet_id", "row_idx", *[C.cell(F.col("cells"), F.lit(i)).alias(n) for i, n in enumerate(names)]
    )

"""Onboarding flow: queries and checking SQL."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilgrid.functions import cells as C
from vigilgrid.functions.text import SPACE
from vigilgrid.operators import grid, ledger, mapping, profile
from vigilgrid.plans import onboarding
from vigilgrid.session import stage, staging_root
from vigilgrid.sources import sheets as files
from vigilgrid.sources import sheet_store, sinks
from vigilgrid.sources import testbed as tb

from .catalog import joined, query, shown
from .ctes import CTES


def strip_sql(value: str) -> str:
    return f"regexp_replace({value}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def label_sql(value: str) -> str:
    return f"lower(regexp_replace({strip_sql(value)}, '{SPACE}+', ' ', 'g'))"


def numeric_sql(value: str) -> str:
    return f"regexp_full_match({value}, '\\p{{Nd}}+\\.?\\p{{Nd}}*|\\.\\p{{Nd}}+')"


def _header_sql(value: str, index: str) -> str:
    return f"CASE WHEN {strip_sql(value)} = '' THEN 'unnamed_' || ({index}) ELSE replace(lower({strip_sql(value)}), ' ', '_') END"


CTES["hc_row"] = f"""
SELECT sheet_id, row_idx, cells, max(len(cells)) OVER (PARTITION BY sheet_id) AS width,
       len(list_filter(cells, lambda v: {strip_sql('v')} <> '')) AS filled,
       list_transform(cells, lambda v, i: {_header_sql('v', 'i - 1')}) AS headers
FROM sr WHERE row_idx < 5
"""
CTES["hc_data"] = f"""
SELECT *, len(headers) = 0 OR len(list_filter(headers, lambda h: {numeric_sql('h')})) >= greatest(1, len(headers) // 2) AS looks
FROM hc_row
"""
CTES["hc"] = """
SELECT sheet_id, row_idx, headers, looks,
       round_even(least(greatest(filled::DOUBLE / width::DOUBLE - CASE WHEN looks THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 0.0::DOUBLE), 0.95::DOUBLE), 3) AS confidence
FROM hc_data
"""
CTES["bh"] = "SELECT * FROM hc QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY confidence DESC, row_idx) = 1"
CTES["shash"] = f"""
SELECT sheet_id, sha256(string_agg(array_to_string(list_transform(cells, lambda v: {label_sql('v')}), '|'), chr(10) ORDER BY row_idx)) AS structural_hash
FROM sr WHERE row_idx < 5 GROUP BY sheet_id
"""
CTES["lc"] = """
SELECT sheet_id, row_idx, i - 1 AS col_idx, cells[i] AS value
FROM (SELECT sheet_id, row_idx, cells, unnest(range(1, len(cells) + 1)) AS i FROM sr)
"""
CTES["hd1"] = f"SELECT sheet_id, col_idx, {_header_sql('value', 'col_idx')} AS name FROM lc WHERE row_idx = 1"
CTES["cf"] = f"""
SELECT h.sheet_id, h.col_idx, h.name, n.data_rows,
       count(*) FILTER (WHERE {strip_sql('l.value')} <> '') AS filled,
       coalesce(bool_and({numeric_sql(strip_sql('l.value'))}) FILTER (WHERE {strip_sql('l.value')} <> ''), false) AS numeric,
       coalesce(bool_and(try_strptime({strip_sql('l.value')}, ['%Y-%m-%d', '%Y/%m/%d', '%m/%d/%Y', '%d-%b-%Y', '%Y%m%d']) IS NOT NULL)
         FILTER (WHERE {strip_sql('l.value')} <> ''), false) AS dates
FROM hd1 h JOIN (SELECT sheet_id, count(*) FILTER (WHERE row_idx > 1) AS data_rows FROM sr GROUP BY sheet_id) n ON n.sheet_id = h.sheet_id
LEFT JOIN lc l ON l.sheet_id = h.sheet_id AND l.col_idx = h.col_idx AND l.row_idx > 1
GROUP BY h.sheet_id, h.col_idx, h.name, n.data_rows
"""


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return tb.sheet_rows(spark, sf)


def _scratch(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark)}/vigilgrid/{label}-{uuid.uuid4().hex}"


def _sheets(spark: SparkSession, sf: str) -> DataFrame:
    """One row per sheet with the number of its customer."""
    orders = tb.table(spark, sf, "orders").select(F.col("o_custkey").alias("n")).distinct()
    return orders.select(F.concat(F.lit("sheet-"), F.col("n").cast("string")).alias("sheet_id"), "n")


@query("preview_rows", "SELECT sheet_id, row_idx, array_to_string(cells, '|') AS cells FROM sr WHERE row_idx < 3")
def preview_rows(spark, sf):
    return grid.preview_rows(_rows(spark, sf), 3).select("sheet_id", "row_idx", joined("cells").alias("cells"))


@query("structural_hash", "SELECT sheet_id, structural_hash FROM shash")
def structural_hash(spark, sf):
    return grid.structural_hash(_rows(spark, sf))


@query(
    "header_candidates",
    """
    SELECT sheet_id, 'row_' || row_idx AS candidate_id, array_to_string(headers, '|') AS headers, confidence,
           looks AS looks_like_data FROM hc
    """,
)
def header_candidates(spark, sf):
    found = grid.header_candidates(_rows(spark, sf))
    return found.select("sheet_id", "candidate_id", joined("headers").alias("headers"), "confidence", "looks_like_data")


@query("best_header", "SELECT sheet_id, row_idx, confidence FROM bh")
def best_header(spark, sf):
    return grid.best_header(grid.header_candidates(_rows(spark, sf))).select("sheet_id", "row_idx", "confidence")


@query(
    "header_decision",
    """
    SELECT bh.sheet_id, 'row_' || bh.row_idx AS selected_candidate_id, array_to_string(bh.headers, '|') AS headers,
           CASE WHEN bh.looks THEN 'needs_human_confirmation' ELSE 'ok' END AS status,
           CASE WHEN bh.looks THEN 'provide_confirmed_header_candidate' ELSE 'continue_to_schema' END AS next_step,
           CASE WHEN bh.looks THEN (SELECT string_agg('row_' || row_idx, '|' ORDER BY row_idx) FROM hc WHERE hc.sheet_id = bh.sheet_id)
                ELSE '' END AS choices
    FROM bh
    """,
)
def header_decision(spark, sf):
    found = grid.header_decision(grid.header_candidates(_rows(spark, sf)))
    return found.select(
        "sheet_id", "selected_candidate_id", joined("headers").alias("headers"), "status", "next_step",
        joined("choices").alias("choices"),
    )


@query(
    "suggest_header_by_density",
    f"""
    SELECT sheet_id, coalesce(min(row_idx) FILTER (WHERE dense AND nxt), 0) AS suggested_header FROM (
      SELECT *, lead(dense) OVER (PARTITION BY sheet_id ORDER BY row_idx) AS nxt FROM (
        SELECT sheet_id, row_idx, len(list_filter(cells, lambda v: {strip_sql('v')} <> ''))
               > max(len(cells)) OVER (PARTITION BY sheet_id) * 0.5 AS dense FROM sr WHERE row_idx < 100))
    GROUP BY sheet_id
    """,
)
def suggest_header_by_density(spark, sf):
    return grid.suggest_header_by_density(_rows(spark, sf))


def _wanted(spark: SparkSession, sf: str) -> DataFrame:
    """Labels wanted per sheet; some sheets name the row, one group with text that is no number."""
    given = F.when(F.col("n") % 9 == 0, "2").when(F.col("n") % 9 == 1, "second")
    labels = F.array(F.lit(" order  KEY"), F.lit("Total Price"), F.lit("Nothing"))
    return _sheets(spark, sf).select("sheet_id", given.alias("header_row"), labels.alias("labels"))


@query(
    "resolve_header_by_labels",
    f"""
    SELECT sheet_id, CASE CAST(substr(sheet_id, 7) AS BIGINT) % 9 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE row_idx END AS header_row
    FROM (SELECT sheet_id, row_idx, len(list_intersect(['order key', 'total price', 'nothing'],
                 list_transform(cells, lambda v: {label_sql('v')}))) AS hits FROM sr WHERE row_idx < 50)
    QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY hits DESC, row_idx) = 1
    """,
)
def resolve_header_by_labels(spark, sf):
    return grid.resolve_header_by_labels(_rows(spark, sf), _wanted(spark, sf))


def _overrides(spark: SparkSession, sf: str) -> DataFrame:
    row = F.when(F.col("n") % 10 == 0, 99999).otherwise(F.col("n") % 2).cast("bigint")
    renames = F.create_map(F.lit("order_key"), F.lit("order_id"), F.lit("unnamed_0"), F.lit("label"))
    return _sheets(spark, sf).select("sheet_id", row.alias("header_row"), renames.alias("renames"))


@query(
    "apply_header_override",
    f"""
    SELECT s.sheet_id, s.header_row, coalesce(array_to_string(list_transform(list_transform(sr.cells, lambda v, i: {_header_sql('v', 'i - 1')}),
             lambda h: CASE h WHEN 'order_key' THEN 'order_id' WHEN 'unnamed_0' THEN 'label' ELSE h END), '|'), '') AS headers
    FROM (SELECT DISTINCT 'sheet-' || o_custkey AS sheet_id, CASE WHEN o_custkey % 10 = 0 THEN 99999 ELSE o_custkey % 2 END AS header_row FROM orders) s
    LEFT JOIN sr ON sr.sheet_id = s.sheet_id AND sr.row_idx = s.header_row
    """,
)
def apply_header_override(spark, sf):
    found = grid.apply_header_override(_rows(spark, sf), _overrides(spark, sf))
    return found.select("sheet_id", "header_row", joined("headers").alias("headers"))


@query(
    "flatten_headers",
    """
    SELECT a.sheet_id, 'Customer report' || CASE WHEN b.cells[1] <> '' THEN '_' || b.cells[1] ELSE '' END || '|'
           || array_to_string(list_transform([2, 3, 4], lambda i: a.cells[2] || coalesce('_' || b.filled[i], '')), '|') AS headers
    FROM (SELECT * FROM sr WHERE row_idx = 0) a
    JOIN (SELECT *, CASE WHEN len(cells) = 3 THEN [cells[1], cells[2], cells[3], NULL] ELSE cells END AS filled FROM sr WHERE row_idx = 1) b
      ON b.sheet_id = a.sheet_id
    """,
)
def flatten_headers(spark, sf):
    return grid.flatten_headers(_rows(spark, sf), 0, 1).select("sheet_id", joined("headers").alias("headers"))


def _grid_and_headers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The derived grid as a stored table, as in use, and the headers of its second row."""
    rows = stage(_rows(spark, sf), "sheet-rows")
    return rows, grid.headers_at(rows, F.lit(1))


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n")
    none = F.lit(None).cast("array<string>")
    return _sheets(spark, sf).select(
        "sheet_id",
        F.when(n % 3 == 0, 4).cast("bigint").alias("start_row"),
        F.when(n % 2 == 0, 8).cast("bigint").alias("end_row"),
        F.when(n % 4 == 0, F.array(F.lit("order_key"), F.lit("order_date"))).otherwise(none).alias("include_columns"),
        F.when(n % 4 == 1, F.array(F.lit("total_price"))).otherwise(none).alias("exclude_columns"),
    )


CTES["hd1l"] = "SELECT sheet_id, list(name ORDER BY col_idx) AS headers FROM hd1 GROUP BY sheet_id"
CTES["tr"] = """
SELECT d.sheet_id, d.row_idx, list_filter(h.headers, lambda x: CASE n % 4 WHEN 0 THEN list_contains(['order_key', 'order_date'], x)
         WHEN 1 THEN x <> 'total_price' ELSE true END) AS headers,
       list_transform(list_filter(range(1, len(h.headers) + 1), lambda i: CASE n % 4 WHEN 0 THEN list_contains(['order_key', 'order_date'], h.headers[i])
         WHEN 1 THEN h.headers[i] <> 'total_price' ELSE true END), lambda i: coalesce(d.cells[i], '')) AS cells
FROM (SELECT *, CAST(substr(sheet_id, 7) AS BIGINT) AS n FROM sr) d JOIN hd1l h ON h.sheet_id = d.sheet_id
WHERE d.row_idx > 1 AND (n % 3 <> 0 OR d.row_idx >= 4) AND (n % 2 <> 0 OR d.row_idx <= 8)
"""


@query(
    "table_region",
    "SELECT sheet_id, row_idx, array_to_string(headers, '|') AS headers, array_to_string(cells, '|') AS cells FROM tr",
)
def table_region(spark, sf):
    inside = grid.table_region(*_grid_and_headers(spark, sf), _regions(spark, sf))
    return inside.select("sheet_id", "row_idx", joined("headers").alias("headers"), joined("cells").alias("cells"))


@query(
    "column_inventory",
    f"""
    SELECT h.sheet_id, h.col_idx, CASE WHEN {strip_sql('h.value')} = '' OR contains(h.value, 'Unnamed') THEN '(Empty Header)'
           ELSE {strip_sql('h.value')} END AS original_name, coalesce(d.value, '') AS sample_value
    FROM lc h JOIN (SELECT DISTINCT sheet_id FROM sr WHERE row_idx = 2) s ON s.sheet_id = h.sheet_id
    LEFT JOIN lc d ON d.sheet_id = h.sheet_id AND d.col_idx = h.col_idx AND d.row_idx = 2 WHERE h.row_idx = 1
    """,
)
def column_inventory(spark, sf):
    found = grid.column_inventory(_rows(spark, sf), 1)
    return found.withColumn("col_idx", F.col("col_idx").cast("bigint"))


@query(
    "column_samples",
    f"""
    SELECT c.sheet_id, c.col_idx, coalesce(CASE WHEN {strip_sql('h.value')} <> '' THEN h.value END, 'col_' || c.col_idx) AS name,
           coalesce(string_agg(d.value, ', ' ORDER BY d.row_idx), '') AS samples
    FROM (SELECT DISTINCT sheet_id, col_idx FROM lc WHERE row_idx BETWEEN 1 AND 4) c
    LEFT JOIN lc h ON h.sheet_id = c.sheet_id AND h.col_idx = c.col_idx AND h.row_idx = 1
    LEFT JOIN lc d ON d.sheet_id = c.sheet_id AND d.col_idx = c.col_idx AND d.row_idx BETWEEN 2 AND 4
    GROUP BY c.sheet_id, c.col_idx, h.value
    """,
)
def column_samples(spark, sf):
    found = grid.column_samples(_rows(spark, sf), 1)
    return found.withColumn("col_idx", F.col("col_idx").cast("bigint"))


@query(
    "rows_to_table",
    """
    SELECT sr.sheet_id, sr.row_idx, h.col_idx, h.name, coalesce(sr.cells[h.col_idx + 1], '') AS value
    FROM sr JOIN hd1 h ON h.sheet_id = sr.sheet_id WHERE sr.row_idx > 1
    """,
)
def rows_to_table(spark, sf):
    long = grid.rows_to_table(*_grid_and_headers(spark, sf))
    return long.withColumn("col_idx", F.col("col_idx").cast("bigint"))


# -- profiles -----------------------------------------------------------------------------------


@query(
    "infer_schema",
    """
    SELECT sheet_id, col_idx, name AS canonical, CASE WHEN numeric THEN 'number' ELSE 'string' END AS dtype,
           data_rows > 0 AND filled = data_rows AS required FROM cf
    """,
)
def infer_schema(spark, sf):
    found = profile.infer_schema(_rows(spark, sf), F.lit(1))
    return found.withColumn("col_idx", F.col("col_idx").cast("bigint"))


_DATED = """
SELECT sheet_id, col_idx, name AS canonical, CASE WHEN numeric THEN 'number' WHEN dates THEN 'date' ELSE 'string' END AS dtype,
       filled = data_rows AS required FROM cf
"""


@query("infer_schema_with_dates", _DATED)
def infer_schema_with_dates(spark, sf):
    found = profile.infer_schema_with_dates(_rows(spark, sf), F.lit(1))
    return found.withColumn("col_idx", F.col("col_idx").cast("bigint"))


@query("canonical_schema", _DATED)
def canonical_schema(spark, sf):
    return profile.canonical_schema(_rows(spark, sf), 1).withColumn("col_idx", F.col("col_idx").cast("bigint"))


@query(
    "missing_required_pct",
    """
    SELECT s.sheet_id, CASE WHEN s.n > 0 THEN round(100.0::DOUBLE * (3 * s.n - coalesce(f.filled, 0)) / (3 * s.n), 1) ELSE 0.0::DOUBLE END AS missing_required_pct
    FROM (SELECT sheet_id, count(*) FILTER (WHERE row_idx > 1) AS n FROM sr GROUP BY sheet_id) s
    LEFT JOIN (SELECT sheet_id, CAST(sum(filled) AS BIGINT) AS filled FROM cf WHERE name IN ('unnamed_0', 'order_key', 'order_date') GROUP BY sheet_id) f
    ON f.sheet_id = s.sheet_id
    """,
)
def missing_required_pct(spark, sf):
    return profile.missing_required_pct(_rows(spark, sf), F.lit(1), ["unnamed_0", "order_key", "order_date"])


@query("output_row_counts", "SELECT sheet_id, count(*) AS rows_written FROM tr GROUP BY sheet_id")
def output_row_counts(spark, sf):
    return profile.output_row_counts(grid.table_region(*_grid_and_headers(spark, sf), _regions(spark, sf)))


FIELD_TYPES = (
    ("unnamed_0", "string", True),
    ("order_key", "number", True),
    ("total_price", "date", False),
    ("order_date", "date", True),
)


_LONG = "(SELECT sr.sheet_id, h.name, coalesce(sr.cells[h.col_idx + 1], '') AS value FROM sr JOIN hd1 h ON h.sheet_id = sr.sheet_id WHERE sr.row_idx > 1)"


@query(
    "transform_report",
    f"""
    SELECT sheet_id, name, count(*) AS cells, count(*) FILTER (WHERE name = 'total_price' AND value <> '') AS casts_failed,
           count(*) FILTER (WHERE name <> 'total_price' AND value = '') AS missing_required
    FROM {_LONG} WHERE name IN ('unnamed_0', 'order_key', 'total_price', 'order_date') GROUP BY sheet_id, name
    """,
)
def transform_report(spark, sf):
    long = grid.rows_to_table(*_grid_and_headers(spark, sf))
    return profile.transform_report(long, FIELD_TYPES)


@query(
    "validation_gate",
    f"""
    SELECT bh.sheet_id, coalesce(f.n, 0) AS row_count, reason = '' AS passed, reason FROM bh
    LEFT JOIN (SELECT sheet_id, max(n) AS n, count(DISTINCT name) FILTER (WHERE name IN ('order_key', 'order_date')) AS mapped,
                      max(100.0 * missing / n) FILTER (WHERE name = 'order_date') AS pct
               FROM (SELECT sheet_id, name, count(*) AS n, count(*) FILTER (WHERE value = '') AS missing FROM {_LONG} GROUP BY 1, 2)
               GROUP BY sheet_id) f ON f.sheet_id = bh.sheet_id,
    LATERAL (SELECT CASE WHEN bh.confidence < 0.7 THEN 'header_confidence' WHEN coalesce(f.mapped, 0) < 2 THEN 'required_unmapped'
                         WHEN f.pct > 5 THEN 'key_missing' ELSE '' END AS reason) r
    """,
)
def validation_gate(spark, sf):
    rows, headers = _grid_and_headers(spark, sf)
    long = grid.rows_to_table(rows, headers)
    facts = long.groupBy("sheet_id", "name").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(C.blank(F.col("value"))).alias("missing")
    )
    best = grid.best_header(grid.header_candidates(rows))
    return profile.validation_gate(best, facts, ["order_key", "order_date"], "order_date")


# -- mapping ------------------------------------------------------------------------------------


def _adapters(spark: SparkSession) -> DataFrame:
    rows = [
        ("full", 0, 2, "order_id", "order_key", "number", True),
        ("full", 1, 0, "amount", "total_price", "number", True),
        ("full", 2, 1, "day", "order_date", "date", False),
        ("full", 3, None, "note", None, None, False),
        ("loose", None, 1, "price_text", "total_price", None, False),
        ("loose", None, 0, "gone", "no_such_column", "number", False),
    ]
    schema = "spec_id string, ord int, map_ord int, canonical string, source string, dtype string, required boolean"
    return spark.createDataFrame(rows, schema)


def _sheet_specs(spark: SparkSession, sf: str) -> DataFrame:
    return _sheets(spark, sf).select("sheet_id", F.when(F.col("n") % 2 == 0, "full").otherwise("loose").alias("spec_id"))


@query(
    "apply_adapter",
    """
    SELECT sheet_id, row_idx, CASE WHEN n % 2 = 0 THEN 'order_id|amount|day' ELSE 'gone|price_text' END AS headers,
           CASE WHEN n % 2 = 0 THEN cells[2] || '|' || regexp_extract(cells[3], '-?[0-9]+(\\.[0-9]+)?') || '|' || coalesce(cells[4], '')
                ELSE '|' || cells[3] END AS cells
    FROM (SELECT *, CAST(substr(sheet_id, 7) AS BIGINT) AS n FROM sr)
    WHERE row_idx > 1 AND n % 4 <> 2
    UNION ALL
    SELECT sheet_id, row_idx, 'order_id|amount|day', '||' FROM sr WHERE row_idx > 1 AND CAST(substr(sheet_id, 7) AS BIGINT) % 4 = 2
    """,
)
def apply_adapter(spark, sf):
    rows, headers = _grid_and_headers(spark, sf)
    out = mapping.apply_adapter(rows, headers, _sheet_specs(spark, sf), _adapters(spark))
    return out.select("sheet_id", "row_idx", joined("headers").alias("headers"), joined("cells").alias("cells"))


@query(
    "adapter_schema",
    """
    SELECT s.sheet_id, a.out_idx, a.canonical, a.source, a.dtype, a.required, 'adapter' AS schema_layer
    FROM (SELECT DISTINCT 'sheet-' || o_custkey AS sheet_id, CASE WHEN o_custkey % 2 = 0 THEN 'full' ELSE 'loose' END AS spec_id FROM orders) s
    JOIN (VALUES ('full', 0, 'order_id', 'order_key', 'number', true), ('full', 1, 'amount', 'total_price', 'number', true),
                 ('full', 2, 'day', 'order_date', 'date', false), ('loose', 0, 'gone', 'no_such_column', 'number', false),
                 ('loose', 1, 'price_text', 'total_price', 'string', false)) a(spec_id, out_idx, canonical, source, dtype, required)
    ON a.spec_id = s.spec_id
    """,
)
def adapter_schema(spark, sf):
    return _sheet_specs(spark, sf).join(mapping.adapter_output(_adapters(spark)), "spec_id").drop("spec_id")


@query(
    "enforce_types",
    """
    SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS as_number, strftime(o_orderdate, '%Y-%m-%d') AS as_date,
           CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS bad_date, 'x ' || o_orderstatus AS as_text
    FROM orders
    """,
)
def enforce_types(spark, sf):
    price = F.concat(F.lit("USD "), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2))
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    )
    bad = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), "o_orderpriority", F.lit("\t"))).otherwise("  ")
    return tb.table(spark, sf, "orders").select(
        "o_orderkey",
        mapping.enforce_type(price, F.lit("number")).alias("as_number"),
        mapping.enforce_type(day, F.lit("date")).alias("as_date"),
        mapping.enforce_type(bad, F.lit("date")).alias("bad_date"),
        mapping.enforce_type(F.concat(F.lit("x "), "o_orderstatus"), F.lit("string")).alias("as_text"),
    )


def _recipe_fields(spark: SparkSession, sf: str) -> DataFrame:
    """A recipe per customer with seven fields whose pointers vary in form."""
    n = F.col("c_custkey")
    first = (
        F.when(n % 8 == 0, F.lit('"Order Key"'))
        .when(n % 8 == 1, F.lit("1"))
        .when(n % 8 == 2, F.lit('{"column": "Order Key"}'))
        .when(n % 8 == 3, F.lit('{"header": "Order Key"}'))
        .when(n % 8 == 4, F.lit('{"column_name": "Order Key"}'))
        .when(n % 8 == 5, F.lit('{"col": 1}'))
        .when(n % 8 == 6, F.lit('{"row": 0, "col": 1}'))
    )

    def field(ord_, target, pointer, source_type=None, data_type=None):
        text = lambda v: F.lit(v).cast("string")
        return F.struct(
            F.lit(ord_).alias("ord"),
            text(target).alias("target"),
            (pointer if not isinstance(pointer, str) else F.lit(pointer)).cast("string").alias("source_pointer"),
            text(source_type).alias("source_type"),
            text(data_type).alias("data_type"),
        )

    fields = F.array(
        field(0, "first", first),
        field(1, "report_date", '{"row": 0, "col": 1}', "metadata", "date"),
        field(2, "price", '"Total Price"', "column", "number"),
        field(3, None, '"x"'),
        field(4, "bad_cell", '{"row": "a", "col": 1}', "metadata"),
        field(5, "bad_column", '{"row": 1}', "column"),
        field(6, "odd", "[1]"),
    )
    # Dealt out first: the customers are one small file, their fields seven rows each.
    customers = tb.table(spark, sf, "customer").select("c_custkey").repartition("c_custkey")
    return customers.select(F.concat(F.lit("recipe-"), n.cast("string")).alias("recipe_id"), F.inline(fields))


@query(
    "parse_recipe_fields",
    """
    SELECT 'recipe-' || c_custkey AS recipe_id, f.* REPLACE (
        CASE WHEN f.ord <> 0 THEN f.kind WHEN m = 7 THEN NULL WHEN m = 6 THEN 'metadata' ELSE 'column' END AS kind,
        CASE WHEN f.ord <> 0 THEN f.row WHEN m = 6 THEN '0' ELSE '' END AS row,
        CASE WHEN f.ord <> 0 THEN f.col WHEN m = 6 THEN '1' ELSE '' END AS col,
        CASE WHEN f.ord <> 0 THEN f.column_name WHEN m IN (0, 2, 3, 4) THEN 'Order Key' END AS column_name,
        CASE WHEN f.ord <> 0 THEN f.column_index WHEN m IN (1, 5) THEN '1' ELSE '' END AS column_index,
        CASE WHEN f.ord <> 0 THEN f.warning WHEN m = 7 THEN 'missing_source_pointer:first' END AS warning)
    FROM (SELECT c_custkey, c_custkey % 8 AS m FROM customer), (VALUES
      (0, 'first', NULL, '', '', NULL, '', 'string', NULL),
      (1, 'report_date', 'metadata', '0', '1', NULL, '', 'date', NULL),
      (2, 'price', 'column', '', '', 'Total Price', '', 'number', NULL),
      (3, NULL, NULL, '', '', NULL, '', 'string', 'missing_target'),
      (4, 'bad_cell', NULL, '', '', NULL, '', 'string', 'invalid_metadata_pointer:bad_cell'),
      (5, 'bad_column', NULL, '', '', NULL, '', 'string', 'invalid_column_pointer:bad_column'),
      (6, 'odd', NULL, '', '', NULL, '', 'string', 'unsupported_source_pointer:odd'))
      f(ord, target, kind, row, col, column_name, column_index, data_type, warning)
    """,
)
def parse_recipe_fields(spark, sf):
    parsed = mapping.parse_recipe_fields(_recipe_fields(spark, sf))
    return parsed.withColumns({name: shown(name) for name in ("row", "col", "column_index")})


def _worse_recipe_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The seven fields with a cell instead of the price column in every third recipe, and no such field in every ninth."""
    n = F.substring("recipe_id", 8, 20).cast("bigint")
    third, ninth = (F.col("ord") == 2) & (n % 3 == 1), F.col("ord").isin(1, 2) & (n % 9 == 1)
    pointer = F.when(ninth, "[1]").when(third, '{"row": 0, "col": 2}').otherwise(F.col("source_pointer"))
    return _recipe_fields(spark, sf).withColumns(
        {"source_pointer": pointer, "source_type": F.when(third, "metadata").otherwise(F.col("source_type"))}
    )


@query(
    "recipe_problems",
    """
    SELECT 'recipe-' || c_custkey AS recipe_id, CASE WHEN c_custkey % 8 = 7 AND c_custkey % 9 = 1 THEN 'Manual recipe has no usable fields.'
      ELSE 'Manual recipe must include at least one column field to build a table.' END AS problem
    FROM customer WHERE c_custkey % 8 IN (6, 7) AND c_custkey % 3 = 1
    """,
)
def recipe_problems(spark, sf):
    return mapping.recipe_problems(mapping.parse_recipe_fields(_worse_recipe_fields(spark, sf)))


def _recipes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_custkey")
    return tb.table(spark, sf, "customer").select(
        F.concat(F.lit("recipe-"), n.cast("string")).alias("recipe_id"),
        F.when(n % 3 == 0, "1").alias("header_row"),
        F.when(n % 5 == 0, F.array(F.lit("report_date"), F.lit("unknown"))).alias("merge_fields"),
        (n % 5 == 1).alias("merge_all"),
    )


def _sheet_recipes(spark: SparkSession, sf: str) -> DataFrame:
    return _sheets(spark, sf).select(
        "sheet_id", F.concat(F.lit("recipe-"), F.col("n").cast("string")).alias("recipe_id")
    )


@query(
    "apply_recipe",
    """
    SELECT sheet_id, row_idx,
      CASE WHEN m = 6 THEN CASE WHEN n % 5 = 1 THEN strftime(title, '%Y-%m-%d') END
           WHEN m = 7 THEN NULL WHEN n % 4 = 2 THEN '' ELSE cells[2] END AS first,
      CASE WHEN n % 4 = 2 THEN NULL ELSE CAST(substr(cells[3], 5) AS DOUBLE) END AS price,
      CASE WHEN n % 5 IN (0, 1) THEN strftime(title, '%Y-%m-%d') END AS report_date,
      CASE WHEN n % 5 = 0 THEN '' END AS unknown
    FROM (SELECT sr.*, CAST(substr(sr.sheet_id, 7) AS BIGINT) AS n, CAST(substr(sr.sheet_id, 7) AS BIGINT) % 8 AS m, t.title
          FROM sr JOIN (SELECT 'sheet-' || o_custkey AS sheet_id, max(o_orderdate) AS title FROM orders GROUP BY 1) t ON t.sheet_id = sr.sheet_id
          JOIN customer ON 'sheet-' || c_custkey = sr.sheet_id)
    WHERE row_idx > CASE WHEN n % 3 = 0 THEN 1 WHEN n % 4 = 2 THEN 0 ELSE 1 END
    """,
)
def apply_recipe(spark, sf):
    values = mapping.apply_recipe(
        stage(_rows(spark, sf), "sheet-rows"), _sheet_recipes(spark, sf), _recipes(spark, sf), _recipe_fields(spark, sf)
    )
    wide = mapping.wide(values, [("first", "string"), ("price", "number"), ("report_date", "date"), ("unknown", "string")])
    return wide.withColumn("report_date", F.date_format("report_date", "yyyy-MM-dd"))


@query(
    "extract_metadata",
    """
    SELECT 'sheet-' || o_custkey AS sheet_id, f.target, CASE WHEN f.target = 'gone' THEN '' ELSE strftime(max(o_orderdate), '%Y-%m-%d') END AS value
    FROM orders JOIN customer ON c_custkey = o_custkey,
         (VALUES ('report_date'), ('first'), ('gone')) f(target)
    WHERE f.target <> 'first' OR o_custkey % 8 = 6 GROUP BY o_custkey, f.target
    """,
)
def extract_metadata(spark, sf):
    fields = _recipe_fields(spark, sf)
    gone = fields.filter("ord = 6").withColumns(
        {"target": F.lit("gone"), "source_pointer": F.lit('{"row": 70000, "col": 2}')}
    )
    parsed = mapping.parse_recipe_fields(fields.unionByName(gone))
    found = mapping.extract_metadata(_rows(spark, sf), _sheet_recipes(spark, sf), parsed)
    return found.select("sheet_id", "target", "value")


@query(
    "attach_metadata",
    """
    SELECT sr.sheet_id, sr.row_idx, strftime(t.title, '%Y-%m-%d') AS report_date, '' AS missing
    FROM sr JOIN (SELECT 'sheet-' || o_custkey AS sheet_id, max(o_orderdate) AS title FROM orders GROUP BY 1) t ON t.sheet_id = sr.sheet_id
    WHERE sr.row_idx > 1
    """,
)
def attach_metadata(spark, sf):
    rows = stage(_rows(spark, sf), "sheet-rows")
    metadata = rows.filter("row_idx = 0").select(
        "sheet_id", F.lit("report_date").alias("target"), F.lit("date").alias("data_type"), F.get("cells", F.lit(1)).alias("value")
    )
    data = rows.filter("row_idx > 1").select("sheet_id", "row_idx")
    return mapping.attach_metadata(data, metadata, ["report_date", "missing"])


def _recipe_index(spark: SparkSession, sf: str, version: int) -> DataFrame:
    """Index entries for the structures of every third sheet."""
    hashes = grid.structural_hash(_rows(spark, sf))
    n = F.substring("sheet_id", 7, 20).cast("bigint")
    picked = hashes.filter(n % 3 == version)
    return picked.groupBy("structural_hash").agg(
        F.concat(F.lit(f"recipe-v{version}-"), F.min(n).cast("string")).alias("recipe_key"),
        F.lit(f"2024-01-0{version + 1}T00:00:00Z").alias("stored_at"),
        F.max("sheet_id").alias("source_run_id"),
    )


_INDEX_SQL = """
(SELECT structural_hash, 'recipe-v' || v || '-' || min(n) AS recipe_key, '2024-01-0' || (v + 1) || 'T00:00:00Z' AS stored_at
 FROM (SELECT *, CAST(substr(sheet_id, 7) AS BIGINT) AS n, CAST(substr(sheet_id, 7) AS BIGINT) % 3 AS v FROM shash) WHERE v < 2
 GROUP BY structural_hash, v)
"""


@query(
    "store_recipe",
    f"SELECT structural_hash, recipe_key, stored_at FROM {_INDEX_SQL} QUALIFY row_number() OVER (PARTITION BY structural_hash ORDER BY stored_at DESC) = 1",
)
def store_recipe(spark, sf):
    merged = mapping.store_recipe(_recipe_index(spark, sf, 0), _recipe_index(spark, sf, 1))
    return merged.select("structural_hash", "recipe_key", "stored_at")


@query(
    "recall_recipe",
    f"SELECT s.sheet_id, i.recipe_key FROM shash s JOIN {_INDEX_SQL} i ON i.structural_hash = s.structural_hash AND i.stored_at = '2024-01-01T00:00:00Z'",
)
def recall_recipe(spark, sf):
    hashes = stage(grid.structural_hash(_rows(spark, sf)), "hashes")
    return mapping.recall_recipe(hashes, _recipe_index(spark, sf, 0)).select("sheet_id", "recipe_key")


@query(
    "unmatched_sheets",
    f"SELECT sheet_id FROM shash WHERE structural_hash NOT IN (SELECT structural_hash FROM {_INDEX_SQL} WHERE stored_at = '2024-01-01T00:00:00Z')",
)
def unmatched_sheets(spark, sf):
    hashes = stage(grid.structural_hash(_rows(spark, sf)), "hashes")
    return mapping.unmatched_sheets(hashes, _recipe_index(spark, sf, 0)).select("sheet_id")


def _confirmations(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n")
    choice = F.when(n % 3 == 0, "row_1").otherwise("row_77")
    return _sheets(spark, sf).filter(n % 3 != 2).select("sheet_id", choice.alias("confirmed_header_candidate"))


@query(
    "apply_confirmations",
    """
    SELECT s.sheet_id, CASE n % 3 WHEN 0 THEN CASE WHEN hc.row_idx IS NULL THEN 'unknown_candidate' ELSE 'confirmed' END
             WHEN 1 THEN 'unknown_candidate' ELSE 'missing_confirmation' END AS status,
           coalesce(CAST(CASE WHEN n % 3 = 0 THEN hc.row_idx END AS VARCHAR), '') AS header_row
    FROM (SELECT DISTINCT 'sheet-' || o_custkey AS sheet_id, o_custkey AS n FROM orders) s
    LEFT JOIN hc ON hc.sheet_id = s.sheet_id AND hc.row_idx = 1
    """,
)
def apply_confirmations(spark, sf):
    candidates = grid.header_candidates(_rows(spark, sf))
    found = mapping.apply_confirmations(_sheets(spark, sf), candidates, _confirmations(spark, sf))
    return found.select("sheet_id", "status", shown("header_row").alias("header_row"))


@query(
    "resume_guard",
    """
    SELECT 'in/' || o_custkey || '.csv' AS path, CASE o_custkey % 5 WHEN 0 THEN 'changed' WHEN 1 THEN 'missing' WHEN 2 THEN 'new' ELSE 'same' END AS state,
           CASE o_custkey % 5 WHEN 0 THEN 'rerun_required' ELSE 'continue' END AS next_step
    FROM (SELECT DISTINCT o_custkey FROM orders)
    """,
)
def resume_guard(spark, sf):
    content = tb.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("n")).agg(
        F.sum(F.xxhash64("o_orderkey", "o_totalprice").cast("decimal(20,0)")).cast("string").alias("content")
    )
    n = F.col("n")
    files_ = content.withColumn("path", F.concat(F.lit("in/"), n.cast("string"), F.lit(".csv")))
    before = files_.filter(n % 5 != 2).select("path", C.file_hash(F.col("content")).alias("file_hash"))
    later = F.when(n % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    after = files_.filter(n % 5 != 1).select("path", C.file_hash(later).alias("file_hash"))
    return mapping.resume_guard(before, after)


@query(
    "unpivot_sheet",
    """
    SELECT 'P' || l_partkey AS product_code, period, sum(v) AS value
    FROM (SELECT l_partkey, unnest(['q_A', 'q_N', 'q_R']) AS period,
                 unnest([CASE WHEN l_returnflag = 'A' THEN l_quantity END, CASE WHEN l_returnflag = 'N' THEN l_quantity END,
                         CASE WHEN l_returnflag = 'R' THEN l_quantity END]) AS v FROM lineitem)
    GROUP BY 1, 2
    """,
)
def unpivot_sheet(spark, sf):
    lines = tb.table(spark, sf, "lineitem").groupBy(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("product_code"))
    flags = {f"q_{f}": F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))) for f in "ANR"}
    wide = lines.agg(*[value.alias(name) for name, value in flags.items()])
    return mapping.unpivot_sheet(wide)


@query(
    "combine_outputs",
    """
    SELECT 'run-a' AS source_run_id, o_orderkey, o_orderstatus AS status, NULL::DOUBLE AS price FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'run-b', o_orderkey, NULL, o_totalprice FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT 'run-c', o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P'
    """,
)
def combine_outputs(spark, sf):
    orders = tb.table(spark, sf, "orders")
    status, price = F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")
    return mapping.combine_outputs(
        [
            ("run-a", orders.filter("o_orderstatus = 'F'").select("o_orderkey", status)),
            ("run-b", orders.filter("o_orderstatus = 'O'").select(price, "o_orderkey")),
            ("run-c", orders.filter("o_orderstatus = 'P'").select("o_orderkey", price, status)),
        ]
    )


@query(
    "combine_long",
    "SELECT tr.sheet_id AS source_run_id, row_idx, cells[list_position(headers, 'order_key')] AS order_key, cells[list_position(headers, 'total_price')] AS total_price FROM tr",
)
def combine_long(spark, sf):
    inside = grid.table_region(*_grid_and_headers(spark, sf), _regions(spark, sf))
    long = mapping.combine_long(inside)
    pick = lambda name: F.try_element_at("record", F.lit(name)).alias(name)
    return long.select("source_run_id", "row_idx", pick("order_key"), pick("total_price"))


@query(
    "sheet_status",
    """
    SELECT sheet_id, CASE n % 6 WHEN 0 THEN 'needs_confirmation' WHEN 1 THEN 'ok' WHEN 2 THEN 'header_selection_ok' WHEN 3 THEN 'new' WHEN 4 THEN 'ok'
      ELSE 'needs_confirmation' END AS status
    FROM (SELECT DISTINCT 'sheet-' || o_custkey AS sheet_id, o_custkey AS n FROM orders)
    """,
)
def sheet_status(spark, sf):
    m = F.col("n") % 6
    late = F.when(m == 0, "stop_due_to_ambiguous_headers").when(m == 5, "resume_guard_file_changed").otherwise(
        "header_selection_ok"
    )
    both = F.array(
        F.struct(F.lit(1).alias("seq"), F.lit("started").alias("event")), F.struct(F.lit(2).alias("seq"), late.alias("event"))
    )
    sheets = _sheets(spark, sf)
    audit = sheets.filter(~m.isin(3, 4)).select("sheet_id", F.lit("2024-01-01").alias("at"), F.inline(both))
    return ledger.sheet_status(sheets, audit, sheets.filter(m.isin(1, 4, 5)))


# -- files and flow -----------------------------------------------------------------------------


def _csv_line():
    quote = lambda v: F.concat(F.lit('"'), F.regexp_replace(v, '"', '""'), F.lit('"'))
    plain = F.transform("cells", lambda v: F.when(v.rlike('[",\n]'), quote(v)).otherwise(v))
    return F.array_join(plain, ",")


@query(
    "scan_large_csv",
    """
    SELECT o_orderpriority AS priority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS row_idx,
           CAST(o_orderkey AS VARCHAR) || '#' || 'a "b", ' || o_orderstatus || '#' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'z' END AS cells
    FROM orders
    """,
)
def scan_large_csv(spark, sf):
    """Orders as one large CSV file per priority, written sorted and read back with row numbers."""
    path = _scratch(spark, "large-csv")
    cells = F.array(
        F.col("o_orderkey").cast("string"),
        F.concat(F.lit('a "b", '), "o_orderstatus"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("z"),
    )
    rows = tb.table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", cells.alias("cells"))
    lines = rows.select("o_orderpriority", "o_orderkey", _csv_line().alias("value"))
    lines = lines.repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "o_orderkey")
    lines.select("o_orderpriority", "value").write.partitionBy("o_orderpriority").text(path)
    found = files.scan_large_csv(spark, path, pattern="*.txt")
    name = F.regexp_extract("sheet_id", "o_orderpriority=([^/]+)", 1)
    return found.select(F.url_decode(F.regexp_replace(name, r"\+", "%2B")).alias("priority"), "row_idx", joined("cells", "#").alias("cells"))


@query(
    "scan_quoted_csv",
    """
    SELECT o_orderpriority AS priority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS row_idx,
           CAST(o_orderkey AS VARCHAR) || '#' || repeat('"' || chr(10) || ',', CAST(o_orderkey % 7 AS INTEGER)) || o_orderstatus || '#' || 'a"b' AS cells
    FROM orders
    """,
)
def scan_quoted_csv(spark, sf):
    """Orders as one large CSV file per priority, with line breaks, commas and quotes inside quoted cells."""
    path = _scratch(spark, "quoted-csv")
    broken = F.concat(F.expr("repeat('\"\n,', CAST(o_orderkey % 7 AS INT))"), "o_orderstatus")
    cells = F.array(F.col("o_orderkey").cast("string"), broken)
    rows = tb.table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", cells.alias("cells"))
    # A quote inside an unquoted cell opens nothing. Lines are made before a task gets the whole of a file.
    lines = rows.select("o_orderpriority", "o_orderkey", F.concat(_csv_line(), F.lit(',a"b')).alias("value"))
    lines = lines.repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "o_orderkey")
    lines.select("o_orderpriority", "value").write.partitionBy("o_orderpriority").text(path)
    found = files.scan_large_csv(spark, path, pattern="*.txt")
    name = F.regexp_extract("sheet_id", "o_orderpriority=([^/]+)", 1)
    return found.select(F.url_decode(F.regexp_replace(name, r"\\+", "%2B")).alias("priority"), "row_idx", joined("cells", "#").alias("cells"))


def _workbooks(part: pd.DataFrame) -> pd.DataFrame:
    """One workbook with two sheets; every seventh file is cut off in the middle."""
    number = int(part["part"].iloc[0])
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows = "".join(
        f'<row r="{2 * i + 1}"><c r="A{2 * i + 1}"><v>{key}</v></c><c r="C{2 * i + 1}" t="inlineStr"><is><t>{escape(name)}</t></is></c></row>'
        for i, (key, name) in enumerate(zip(part["c_custkey"], part["c_name"]))
    )
    listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in ((1, "first"), (2, "empty")))
    targets = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in (1, 2))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{targets}</Relationships>")
        book.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
        book.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
    content = out.getvalue()
    return pd.DataFrame({"file": [f"part-{number}.xlsx"], "content": [content[: len(content) // 2] if number % 7 == 3 else content]})


@query(
    "scan_workbooks",
    """
    WITH parted AS (SELECT c_custkey // 100 AS part, c_custkey, c_name, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) - 1 AS i FROM customer)
    SELECT 'part-' || part || '.xlsx#first' AS sheet_id, 2 * i AS row_idx, c_custkey || '##' || c_name AS cells, '' AS error FROM parted WHERE part % 7 <> 3
    UNION ALL SELECT 'part-' || part || '.xlsx#first', 2 * i + 1, '', '' FROM parted
      WHERE part % 7 <> 3 QUALIFY i < max(i) OVER (PARTITION BY part)
    UNION ALL SELECT DISTINCT 'part-' || part || '.xlsx', -1, '', 'BadZipFile' FROM parted WHERE part % 7 = 3
    """,
)
def scan_workbooks(spark, sf):
    """Customers as workbooks with a blank row after each, decoded; files that are cut off give an error row."""
    parted = tb.table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 100).alias("part"), "c_custkey", "c_name")
    books = parted.groupBy("part").applyInPandas(lambda p: _workbooks(p.sort_values("c_custkey")), "file string, content binary")
    decoded = stage(files.workbook_rows(books, "*"), "workbooks")
    rows = files.readable_rows(decoded).select("sheet_id", "row_idx", joined("cells", "#").alias("cells"), F.lit("").alias("error"))
    kind = F.regexp_extract("error", "^[A-Za-z]+", 0).alias("error")
    failed = files.sheet_errors(decoded).select("sheet_id", F.lit(-1).cast("long").alias("row_idx"), F.lit("").alias("cells"), kind)
    return rows.unionByName(failed)


@query(
    "scan_sheets_csv",
    """
    SELECT 'part=' || (c_custkey // 500) AS sheet_id, row_number() OVER (PARTITION BY c_custkey // 500 ORDER BY c_custkey) - 1 AS row_idx,
           c_name || '#' || 'say "' || c_mktsegment || '", ok' || '#' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'x' END AS cells
    FROM customer
    """,
)
def scan_sheets_csv(spark, sf):
    """Customers as CSV files of at most 500 rows each, read back one sheet per file."""
    path = _scratch(spark, "small-csv")
    cells = F.array(
        F.col("c_name"),
        F.concat(F.lit('say "'), "c_mktsegment", F.lit('", ok')),
        F.when(F.col("c_custkey") % 2 == 0, "").otherwise("x"),
    )
    part = F.floor(F.col("c_custkey") / 500)
    rows = tb.table(spark, sf, "customer").select(part.alias("part"), "c_custkey", cells.alias("cells"))
    lines = rows.repartition("part").sortWithinPartitions("part", "c_custkey")
    lines.select("part", _csv_line().alias("value")).write.partitionBy("part").text(path)
    found = files.scan_sheets_csv(spark, path, pattern="*.txt")
    return found.select(F.regexp_extract("sheet_id", "^[^/]+", 0).alias("sheet_id"), "row_idx", joined("cells", "#").alias("cells"))


@query(
    "write_clean_table",
    "SELECT sheet_id, count(*) AS rows_written, CAST(sum(CAST(cells[2] AS BIGINT)) AS BIGINT) AS key_sum FROM sr WHERE row_idx > 1 GROUP BY sheet_id",
)
def write_clean_table(spark, sf):
    wide = grid.project_columns(_rows(spark, sf), ["label", "order_key", "total_price", "order_date"], 1)
    path = sinks.write_clean_table(wide, _scratch(spark, "clean"), fmt="csv")
    schema = "sheet_id string, row_idx long, label string, order_key string, total_price string, order_date string, sheet_bucket int"
    back = spark.read.schema(schema).option("header", True).csv(path)
    counts = profile.output_row_counts(back)
    manifest = sinks.save_manifest(counts, path, F.lit(tb.AS_OF))
    sums = back.groupBy("sheet_id").agg(F.sum(F.col("order_key").cast("bigint")).alias("key_sum"))
    return manifest.join(sums, "sheet_id").select("sheet_id", "rows_written", "key_sum")


@query(
    "continue_sheets",
    """
    SELECT s.sheet_id, CASE WHEN n % 7 = 0 THEN 'recipe' WHEN n % 7 = 1 THEN 'override' ELSE 'confirmation' END AS header_source,
      CASE WHEN n % 7 = 0 THEN CASE WHEN n % 8 IN (6, 7) AND n % 3 = 1 THEN 'fix_manual_recipe' ELSE 'review_artifacts' END
           WHEN n % 7 = 1 THEN 'review_artifacts'
           WHEN n % 3 = 0 AND hc.row_idx IS NOT NULL THEN 'review_artifacts' ELSE 'write_human_confirmation' END AS next_step
    FROM (SELECT DISTINCT 'sheet-' || o_custkey AS sheet_id, o_custkey AS n FROM orders) s
    LEFT JOIN hc ON hc.sheet_id = s.sheet_id AND hc.row_idx = 1
    """,
)
def continue_sheets(spark, sf):
    rows = stage(_rows(spark, sf), "sheet-rows")
    n = F.substring("sheet_id", 7, 20).cast("bigint")
    evidence = onboarding.examine_sheets(rows, _recipe_index(spark, sf, 0))
    found = onboarding.continue_sheets(
        rows,
        evidence,
        _confirmations(spark, sf),
        _overrides(spark, sf).filter(n % 7 == 1),
        _sheet_recipes(spark, sf).filter(n % 7 == 0),
        _worse_recipe_fields(spark, sf),
    )
    return found.select("sheet_id", "header_source", "next_step")


@query(
    "run_onboarding_flow",
    """
    SELECT * FROM (
    WITH s AS (SELECT DISTINCT 'sheet-' || o_custkey AS sheet_id, o_custkey AS n, o_custkey % 8 AS m FROM orders),
    told AS (
      SELECT s.*, CASE WHEN n % 7 = 0 THEN 'recipe' WHEN n % 7 = 1 THEN 'override'
          WHEN n % 3 = 0 THEN CASE WHEN hc.row_idx IS NULL THEN 'unknown' ELSE 'confirmed' END WHEN n % 3 = 1 THEN 'unknown' ELSE 'none' END AS way,
        bh.looks, CASE WHEN n % 7 <> 1 THEN 1 WHEN n % 10 = 0 THEN 99999 ELSE n % 2 END AS header_row
      FROM s JOIN bh ON bh.sheet_id = s.sheet_id LEFT JOIN hc ON hc.sheet_id = s.sheet_id AND hc.row_idx = 1
    ), cut AS (
      SELECT told.sheet_id, n, header_row, len(h.cells) AS width, d.row_idx,
        list_transform(range(1, len(h.cells) + 1), lambda i: coalesce(d.cells[i], '')) AS cells
      FROM told JOIN sr h ON h.sheet_id = told.sheet_id AND h.row_idx = header_row
      LEFT JOIN sr d ON d.sheet_id = told.sheet_id AND d.row_idx > header_row
      WHERE way IN ('override', 'confirmed')
    ), by_recipe AS (
      SELECT told.sheet_id, n, m, sr.row_idx, list_filter([
          CASE WHEN m <= 5 THEN CASE WHEN n % 4 = 2 THEN '' ELSE sr.cells[2] END END,
          CASE WHEN n % 4 = 2 THEN '' ELSE CAST(CAST(substr(sr.cells[3], 5) AS DOUBLE) AS VARCHAR) END,
          CASE WHEN n % 5 = 1 AND m = 6 THEN strftime(title, '%Y-%m-%d') END,
          CASE WHEN n % 5 IN (0, 1) THEN strftime(title, '%Y-%m-%d') END, CASE WHEN n % 5 = 0 THEN '' END], lambda v: v IS NOT NULL) AS cells
      FROM told JOIN (SELECT o_custkey, max(o_orderdate) AS title FROM orders GROUP BY 1) t ON t.o_custkey = told.n
      LEFT JOIN sr ON sr.sheet_id = told.sheet_id AND sr.row_idx > CASE WHEN n % 3 = 0 THEN 1 WHEN n % 4 = 2 THEN 0 ELSE 1 END
      WHERE way = 'recipe'
    ), found AS (
      SELECT sheet_id, '1' AS attempt, count(row_idx) AS rows_written, any_value(width) AS n_columns,
        CASE WHEN count(row_idx) > 0 AND NOT (any_value(header_row) = 0 AND any_value(n) % 4 <> 2) THEN 1 ELSE 0 END AS n_numbers,
        coalesce(sum(length(array_to_string(cells, '|'))) FILTER (WHERE row_idx IS NOT NULL), 0) AS chars
      FROM cut GROUP BY sheet_id
      UNION ALL
      SELECT sheet_id, '2', count(row_idx), CASE WHEN any_value(m) <= 5 THEN 2 ELSE 1 END
          + CASE any_value(n) % 5 WHEN 0 THEN 2 WHEN 1 THEN CASE WHEN any_value(m) = 6 THEN 2 ELSE 1 END ELSE 0 END,
        1, coalesce(sum(length(array_to_string(cells, '|'))) FILTER (WHERE row_idx IS NOT NULL), 0)
      FROM by_recipe GROUP BY sheet_id
    )
    SELECT told.sheet_id,
      CASE way WHEN 'recipe' THEN 'review_artifacts' WHEN 'confirmed' THEN 'review_artifacts' WHEN 'unknown' THEN 'write_human_confirmation'
        WHEN 'override' THEN CASE WHEN header_row = 99999 THEN 'review_gate' ELSE 'review_artifacts' END
        ELSE CASE WHEN looks THEN 'provide_confirmed_header_candidate' ELSE 'continue_to_schema' END END AS first_step,
      CASE WHEN way = 'recipe' THEN 'ok' WHEN looks THEN 'needs_human_confirmation' ELSE 'header_selection_ok' END AS last_status,
      coalesce(way = 'recipe', false) AS recalled, coalesce(attempt, '') AS published, coalesce(rows_written, -1) AS rows_written,
      CAST(coalesce(n_columns, 0) AS BIGINT) AS n_columns, CAST(coalesce(n_numbers, 0) AS BIGINT) AS n_numbers, CAST(coalesce(chars, 0) AS BIGINT) AS chars
    FROM told LEFT JOIN found ON found.sheet_id = told.sheet_id)
    """,
)
def run_onboarding_flow(spark, sf):
    """Two jobs over all sheets: one with what people decided, one with nothing but the recipes it left."""
    rows = stage(_rows(spark, sf), "sheet-rows")
    n = F.substring("sheet_id", 7, 20).cast("bigint")
    told = onboarding.Decisions(
        confirmations=_confirmations(spark, sf),
        overrides=_overrides(spark, sf).filter(n % 7 == 1),
        sheet_recipes=_sheet_recipes(spark, sf).filter(n % 7 == 0),
        recipes=_recipes(spark, sf),
        fields=_recipe_fields(spark, sf),
    )
    root = _scratch(spark, "onboarding")
    for attempt, decided in (("1", told), ("2", None)):
        onboarding.run_onboarding_flow(rows, root, F.lit(tb.AS_OF).cast("timestamp"), decided, attempt=attempt)
    ledger_rows = sheet_store.read_all(spark, root, sheet_store.LEDGER)
    first = ledger_rows.filter("attempt = '1'").select("sheet_id", F.col("next_step").alias("first_step"))
    last = sheet_store.last_states(spark, root).select(
        "sheet_id", F.col("status").alias("last_status"), F.coalesce(F.col("recipe_key").startswith("1/"), F.lit(False)).alias("recalled")
    )
    shown_ = F.length(F.array_join("cells", "|")).cast("bigint")
    clean = sheet_store.read(spark, root, "clean").groupBy("sheet_id").agg(F.sum(shown_).alias("chars"))
    schema = sheet_store.read(spark, root, "schema").groupBy("sheet_id").agg(
        F.count(F.lit(1)).alias("n_columns"), F.count_if(F.col("dtype") == "number").alias("n_numbers")
    )
    manifest = sheet_store.read(spark, root, "manifest").select("sheet_id", F.col("attempt").alias("published"), "rows_written")
    joined_ = first.join(last, "sheet_id")
    for part in (manifest, schema, clean):
        joined_ = joined_.join(part, "sheet_id", "left")
    return joined_.fillna({"published": "", "rows_written": -1, "n_columns": 0, "n_numbers": 0, "chars": 0})

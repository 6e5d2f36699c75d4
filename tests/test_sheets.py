"""Grids, mapping and the onboarding flow on small sheets."""

import re

import pytest
from pyspark.sql import functions as F

from vigilgrid.functions.relational import block_join, ranked_position, salted_join, split_position, spread_join
from vigilgrid.model import SHEET_ROWS
from vigilgrid.operators import grid, ledger, mapping, profile
from vigilgrid.plans import onboarding

MESSY = [["Sales Report Q1", "", "", ""], ["", "Product Code", "Qty", "Amount"], ["row1", "X100", "3", "19.95"], ["row2", "Y200", "1", "5.00"]]
CLEAN = [["Sales report Q1", "", "", ""], ["product_code", "qty", "amount", "note"], ["X100", "3", "19.95", "first order"], ["Y200", "1", "5.00", "second order"]]
META = [["Report Date", "2025-01-01", "", ""], ["", "Product Code", "Qty", "Amount"], ["row1", "X100", "USD 3", "19.95"], ["row2", "Y200", "1", "5.00"]]


def sheets(spark, **named):
    rows = [(name, i, cells) for name, cells_ in named.items() for i, cells in enumerate(cells_)]
    return spark.createDataFrame(rows, SHEET_ROWS)


def test_header_confidences(spark):
    found = grid.header_candidates(sheets(spark, messy=MESSY, clean=CLEAN)).orderBy("sheet_id", "row_idx").collect()
    assert [r["confidence"] for r in found] == [0.25, 0.95, 0.8, 0.8, 0.25, 0.75, 0.8, 0.8]
    assert found[5]["headers"] == ["unnamed_0", "product_code", "qty", "amount"]


def test_header_decisions(spark):
    candidates = grid.header_candidates(sheets(spark, messy=MESSY, clean=CLEAN))
    found = {r["sheet_id"]: r for r in grid.header_decision(candidates).collect()}
    assert (found["messy"]["status"], found["messy"]["selected_candidate_id"]) == ("needs_human_confirmation", "row_2")
    assert found["messy"]["choices"] == ["row_0", "row_1", "row_2", "row_3"]
    assert (found["clean"]["status"], found["clean"]["selected_candidate_id"]) == ("ok", "row_1")
    best = {r["sheet_id"]: r["row_idx"] for r in grid.best_header(candidates).collect()}
    assert best == {"messy": 2, "clean": 1}


def test_header_confidence_rounds_half_even(spark):
    # 7 of 16 cells filled with a data penalty: 0.2375 rounds to 0.238; 5 of 80 filled: 0.0625 to 0.062.
    wide = ["1"] * 7 + [""] * 9
    thin = ["a"] * 5 + [""] * 75
    found = grid.header_candidates(sheets(spark, w=[wide], t=[thin])).collect()
    assert {r["sheet_id"]: r["confidence"] for r in found} == {"w": 0.438, "t": 0.062}


def test_density_hint(spark):
    rows = sheets(spark, a=[["t", "", ""], ["", "", ""], ["a", "b", "c"], ["1", "2", ""]], b=[["x", "", ""]], c=MESSY)
    assert dict(grid.suggest_header_by_density(rows).collect()) == {"a": 2, "b": 0, "c": 1}


def test_flattened_headers(spark):
    rows = sheets(spark, a=[["", "2024", "", "2025"], ["code", "Q1", "Q2", "nan"], ["x", "1", "2", "3"]])
    assert grid.flatten_headers(rows, 0, 1).first()["headers"] == ["code", "2024_Q1", "2024_Q2", "2025_Q2"]


def test_inferred_schema(spark):
    rows = sheets(spark, clean=CLEAN, gap=[["t"], ["a", "b", "c"], ["1", "", "x"], ["2.5"]])
    found = {(r["sheet_id"], r["canonical"]): (r["dtype"], r["required"]) for r in profile.infer_schema(rows, F.lit(1)).collect()}
    assert [found[("clean", c)] for c in ("product_code", "qty", "amount", "note")] == [
        ("string", True), ("number", True), ("number", True), ("string", True),
    ]
    assert [found[("gap", c)] for c in "abc"] == [("number", True), ("string", False), ("string", False)]


def test_canonical_schema_knows_dates(spark):
    rows = sheets(spark, s=[["id", "day", "n"], ["a", "2025-01-01", "1"], ["b", "01/02/2025", "2"], ["c", "", "3"]])
    found = {r["canonical"]: (r["dtype"], r["required"]) for r in profile.canonical_schema(rows, 0).collect()}
    assert found == {"id": ("string", True), "day": ("date", False), "n": ("number", True)}


def test_missing_required_is_found_by_header(spark):
    rows = sheets(spark, s=[["a", "b"], ["1", ""], ["", ""], ["3", "x"]], empty=[["a", "b"]], none=[["x"], ["1"]])
    found = dict(profile.missing_required_pct(rows, F.lit(0), ["b", "a"]).collect())
    assert found == {"s": 50.0, "empty": 0.0, "none": 100.0}


def header_of(spark, rows, row=1):
    return grid.headers_at(rows, F.lit(row))


def regions(spark, rows):
    schema = "sheet_id string, start_row long, end_row long, include_columns array<string>, exclude_columns array<string>"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    "region, rows, names",
    [
        ((None, None, None, None), [2, 3], ["unnamed_0", "product_code", "qty", "amount"]),
        ((3, None, None, None), [3], ["unnamed_0", "product_code", "qty", "amount"]),
        ((None, 2, ["amount", "qty"], ["qty"]), [2], ["qty", "amount"]),
        ((0, 9, None, ["unnamed_0"]), [2, 3], ["product_code", "qty", "amount"]),
        ((None, 0, None, None), [], None),
    ],
)
def test_regions(spark, region, rows, names):
    data = sheets(spark, messy=MESSY)
    found = grid.table_region(data, header_of(spark, data), regions(spark, [("messy", *region)])).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in found] == rows
    if found:
        assert found[0]["headers"] == names and len(found[0]["cells"]) == len(names)


def test_short_rows_are_filled(spark):
    data = sheets(spark, s=[["a", "b", "c"], ["1"], []])
    found = grid.table_region(data, header_of(spark, data, 0)).orderBy("row_idx").collect()
    assert [r["cells"] for r in found] == [["1", "", ""], ["", "", ""]]


def test_header_override_renames(spark):
    data = sheets(spark, messy=MESSY)
    overrides = spark.createDataFrame([("messy", 1, {"qty": "quantity"})], "sheet_id string, header_row long, renames map<string,string>")
    assert grid.apply_header_override(data, overrides).first()["headers"] == ["unnamed_0", "product_code", "quantity", "amount"]


FIELDS = "recipe_id string, ord int, target string, source_pointer string, source_type string, data_type string"
RECIPES = "recipe_id string, header_row string, merge_fields array<string>, merge_all boolean"


def recipe(spark, header_row="1", merge=("report_date",), merge_all=False, extra=()):
    fields = [
        ("r", 0, "report_date", '{"row": 0, "col": 1}', "metadata", "string"),
        ("r", 1, "product_code", '"Product Code"', "column", "string"),
        ("r", 2, "qty", '{"column": "Qty"}', None, "number"),
        *extra,
    ]
    merged = None if merge is None else list(merge)
    return spark.createDataFrame([("r", header_row, merged, merge_all)], RECIPES), spark.createDataFrame(fields, FIELDS)


def applied(spark, data, recipes, fields, targets):
    sheet_recipes = data.select("sheet_id", F.lit("r").alias("recipe_id")).distinct()
    values = mapping.apply_recipe(data, sheet_recipes, recipes, fields)
    order = [v["target"] for v in values.first()["values"]]
    return order, [tuple(r)[2:] for r in mapping.wide(values, targets).orderBy("row_idx").collect()]


TARGETS = [("product_code", "string"), ("qty", "number"), ("report_date", "string")]
GOLDEN = [("X100", 3.0, "2025-01-01"), ("Y200", 1.0, "2025-01-01")]


@pytest.mark.parametrize("how", [{}, {"header_row": None}, {"merge": None, "merge_all": True}])
def test_recipe_golden_rows(spark, how):
    order, rows = applied(spark, sheets(spark, s=META), *recipe(spark, **how), TARGETS)
    assert order == ["product_code", "qty", "report_date"] and rows == GOLDEN


def test_recipe_with_unknown_and_out_of_range_parts(spark):
    extra = [("r", 3, "gone", '"No such"', None, "number"), ("r", 4, "far", "99", None, None), ("r", 5, "neg", "-1", None, None)]
    order, rows = applied(
        spark, sheets(spark, s=META), *recipe(spark, merge=["nothing"], extra=extra),
        [("gone", "number"), ("far", "string"), ("neg", "string"), ("nothing", "string")],
    )
    assert order == ["product_code", "qty", "gone", "far", "neg", "nothing"]
    assert rows == [(None, "", "", "")] * 2


def test_recipes_without_columns_are_refused(spark):
    rows = [
        ("a", 0, "x", '{"row": 0, "col": 1}', None, None),
        ("b", 0, "x", "[]", None, None),
        ("c", 0, "x", "0", None, None),
    ]
    found = dict(mapping.recipe_problems(mapping.parse_recipe_fields(spark.createDataFrame(rows, FIELDS))).collect())
    assert set(found) == {"a", "b"} and "column field" in found["a"] and "no usable" in found["b"]


def test_recipe_is_recalled_for_a_sheet_of_equal_structure(spark):
    other = [list(r) for r in META]
    data = sheets(spark, first=META, second=other, different=MESSY)
    hashes = grid.structural_hash(data)
    known = hashes.filter("sheet_id = 'first'").select(
        "structural_hash", F.lit("k").alias("recipe_key"), F.lit("t").alias("stored_at"), F.lit("r").alias("source_run_id")
    )
    assert sorted(r["sheet_id"] for r in mapping.recall_recipe(hashes, known).collect()) == ["first", "second"]
    assert [r["sheet_id"] for r in mapping.unmatched_sheets(hashes, known).collect()] == ["different"]
    newer = known.withColumns({"recipe_key": F.lit("k2"), "stored_at": F.lit("u")})
    assert [r["recipe_key"] for r in mapping.store_recipe(known, newer).collect()] == ["k2"]


def test_adapter_orders_columns_and_cleans_them(spark):
    data = sheets(spark, s=[["a", "b", "a"], ["x", "1,000 EUR", "y"], ["z"]])
    fields = [
        ("m", 0, 1, "num", "b", "number", True),
        ("m", 1, 0, "txt", "a", None, None),
        ("m", 2, None, "unmapped", None, None, None),
    ]
    schema = "spec_id string, ord int, map_ord int, canonical string, source string, dtype string, required boolean"
    specs = spark.createDataFrame([("s", "m")], "sheet_id string, spec_id string")
    out = mapping.apply_adapter(data, header_of(spark, data, 0), specs, spark.createDataFrame(fields, schema))
    found = out.orderBy("row_idx").collect()
    assert [r["headers"] for r in found] == [["num", "txt"]] * 2
    assert [r["cells"] for r in found] == [["1000", "y"], ["", ""]]


def test_onboarding_flow(spark):
    data = sheets(spark, a=MESSY, b=META, c=MESSY, d=MESSY)
    index = spark.createDataFrame([], "structural_hash string, recipe_key string, stored_at string, source_run_id string")
    evidence = onboarding.examine_sheets(data, index)
    confirmations = spark.createDataFrame([("a", "row_1"), ("d", "row_9")], "sheet_id string, confirmed_header_candidate string")
    overrides = spark.createDataFrame([("c", 1, {"qty": "quantity"})], "sheet_id string, header_row long, renames map<string,string>")
    sheet_recipes = spark.createDataFrame([("b", "r")], "sheet_id string, recipe_id string")
    _, fields = recipe(spark)
    states = onboarding.continue_sheets(data, evidence, confirmations, overrides, sheet_recipes, fields)
    found = {r["sheet_id"]: (r["header_source"], r["next_step"]) for r in states.collect()}
    assert found == {
        "a": ("confirmation", "review_artifacts"), "b": ("recipe", "review_artifacts"),
        "c": ("override", "review_artifacts"), "d": ("confirmation", "write_human_confirmation"),
    }
    tables = onboarding.tables_from_headers(data, states).orderBy("sheet_id", "row_idx").collect()
    assert [(r["sheet_id"], r["row_idx"]) for r in tables] == [("a", 2), ("a", 3), ("c", 2), ("c", 3)]
    assert tables[2]["headers"] == ["unnamed_0", "product_code", "quantity", "amount"]
    changed = spark.createDataFrame([("a",)], "sheet_id string")
    stopped = onboarding.continue_sheets(data, evidence, confirmations, overrides, sheet_recipes, fields, changed)
    assert stopped.filter("sheet_id = 'a'").first()["next_step"] == "rerun_required"


def test_combined_tables_keep_all_columns(spark):
    one = spark.createDataFrame([("x", 1)], "a string, b int")
    two = spark.createDataFrame([(2, "y")], "b int, c string")
    rows = mapping.combine_outputs([("r1", one), ("r2", two)]).orderBy("source_run_id").collect()
    assert [r.asDict() for r in rows] == [
        {"a": "x", "b": 1, "source_run_id": "r1", "c": None}, {"a": None, "b": 2, "source_run_id": "r2", "c": "y"},
    ]
    long = spark.createDataFrame([("s", 0, ["a", "a"], ["1", "2"])], "sheet_id string, row_idx long, headers array<string>, cells array<string>")
    assert mapping.combine_long(long).first()["record"] == {"a": "1"}


def test_unpivot_defaults(spark):
    df = spark.createDataFrame([("X", 1, 2)], "product_code string, jan int, feb int")
    rows = sorted(tuple(r) for r in mapping.unpivot_sheet(df).collect())
    assert rows == [("X", "feb", 2), ("X", "jan", 1)]
    assert mapping.unpivot_sheet(df).columns == ["product_code", "period", "value"]


def test_sheet_states(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "sheet_id string")
    audit = spark.createDataFrame(
        [("a", "x", "1", 1), ("a", "stop_due_to_ambiguous_headers", "2", 1), ("b", "header_selection_ok", "1", 1)],
        "sheet_id string, event string, at string, seq int",
    )
    saved = names.filter("sheet_id = 'c'")
    found = dict(ledger.sheet_status(names, audit, saved).collect())
    assert found == {"a": "needs_confirmation", "b": "header_selection_ok", "c": "ok", "d": "new"}


def test_block_join_equals_plain_join(spark):
    rows = spark.range(1000).selectExpr("concat('k', id % 3) AS key", "id div 3 AS pos", "id AS v")
    sides = spark.createDataFrame([("k0", 1), ("k1", 2), ("k9", 3)], "key string, w int")
    plain = rows.join(sides, "key").select("key", "pos", "v", "w")
    blocked = block_join(rows, sides, "key", "pos", block=16).select("key", "pos", "v", "w")
    assert sorted(plain.collect()) == sorted(blocked.collect())


def test_salted_join_equals_plain_join(spark):
    rows = spark.range(500).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id) END AS key", "id AS v")
    sides = rows.filter("v < 100").select("key").distinct().withColumn("w", F.lit(1))
    for how in ("inner", "left"):
        plain = rows.join(sides, "key", how).select("key", "v", "w")
        salted = salted_join(rows, sides, ["key"], ["v"], how).select("key", "v", "w")
        assert sorted(plain.collect(), key=str) == sorted(salted.collect(), key=str)


def _joins(df):
    """Names of the joins that ran."""
    df.collect()
    return set(re.findall(r"(\w+Join)\b", df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]))


def test_joins_go_by_the_size_of_exploded_rows_not_by_their_files(spark, tmp_path):
    spark.range(3000).selectExpr("concat('k', id) AS key").coalesce(1).write.parquet(str(tmp_path / "few"))
    few = spark.read.parquet(str(tmp_path / "few"))
    many = few.select("key", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("w"))
    rows = spark.range(30_000).selectExpr("concat('k', id) AS key", "id AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")  # the file is smaller, its 60,000 rows are not
    try:
        for joined in (salted_join(rows, many, ["key"], ["v"], "inner"), spread_join(rows, many, ["key"], ["v"])):
            assert "SortMergeJoin" in _joins(joined)
            assert joined.count() == 60_000
        small = salted_join(rows, few.limit(3), ["key"], ["v"], "inner")
        assert "SortMergeJoin" not in _joins(small) and small.count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spread_join_equals_plain_join_and_repeats_rows_of_frequent_keys_only(spark):
    rows = spark.range(2000).selectExpr(
        "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 < 3 THEN 'hot' ELSE concat('k', id) END AS key", "id AS v"
    )
    sides = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), (None, 4), ("k9999", 5)], "key string, w int")
    for how in ("inner", "left", "right", "left_anti"):
        shown = ["key", "v"] if how == "left_anti" else ["key", "v", "w"]
        plain = rows.join(sides, "key", how).select(shown)
        spread = spread_join(rows, sides, ["key"], ["v"], how, rows=100).select(shown)
        assert sorted(plain.collect(), key=str) == sorted(spread.collect(), key=str)
    # Of the copies of a frequent key those that meet no row go.
    same = spread_join(rows.withColumn("s", F.lit(1)), sides, ["key"], ["s"], "right", rows=100)
    assert same.filter("key = 'hot'").count() == 1600 and same.filter("v IS NULL").count() == 2


def test_split_position_equals_plain_rank(spark):
    rows = spark.range(2000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 50) END AS key", "(id * 7919) % 1000 AS o", "id")
    placed = split_position(rows, ["key"], [F.col("o"), F.col("id")], F.floor(F.col("o") / 100), "p").collect()
    wanted = {}
    for r in sorted(rows.collect(), key=lambda r: (r["o"], r["id"])):
        wanted.setdefault(r["key"], []).append(r["id"])
    assert len(placed) == 2000 and all(wanted[r["key"]][r["p"]] == r["id"] for r in placed)


def test_ranked_position_equals_plain_rank_and_spreads_hot_groups(spark):
    # One group holds two thirds of the rows, most of them without a time or with the same one, and a long common prefix.
    rows = spark.range(6000).selectExpr(
        "CASE WHEN id % 3 < 2 THEN 'hot' WHEN id % 3 = 2 AND id % 7 = 0 THEN NULL ELSE concat('k', id % 50) END AS key",
        "CASE WHEN id % 5 < 3 THEN NULL ELSE 7 END AS o", "concat('a-very-long-prefix-', (id * 7919) % 6007) AS name", "id",
    )
    order = [F.col("o").asc_nulls_first(), F.col("name").desc()]
    placed = ranked_position(rows, ["key"], order, "p", start=1)
    wanted = {}
    for r in sorted(sorted(rows.collect(), key=lambda r: r["name"], reverse=True), key=lambda r: r["o"] or 0):
        wanted.setdefault(r["key"], []).append(r["id"])
    found = placed.collect()
    assert len(found) == 6000 and all(wanted[r["key"]][r["p"] - 1] == r["id"] for r in found)
    whole = {r["p"]: r["id"] for r in ranked_position(rows, [], [F.col("id").desc()], "p").collect()}
    assert whole == {i: 5999 - i for i in range(6000)}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = rows.repartitionByRange(n, F.col("key"), *order).groupBy(F.spark_partition_id().alias("t")).count().collect()
    assert len(tasks) == n and max(r["count"] for r in tasks) < 2 * sorted(r["count"] for r in tasks)[n // 2]
    assert ranked_position(rows.limit(0), ["key"], order, "p").count() == 0


def test_row_lookup_has_one_plan_whatever_is_wanted(spark):
    rows = spark.range(30_000).selectExpr("concat('s', id % 3) AS sheet_id", "id DIV 3 AS row_idx", "array(cast(id AS string)) AS cells")

    def looked_up(n):
        wanted = spark.range(n).selectExpr("'s1' AS sheet_id", "id * 2 AS row_idx")
        return grid.rows_at(rows, wanted, top=3)

    few, many = looked_up(10), looked_up(10_000)
    assert sorted(r["cells"][0] for r in few.collect()) == sorted(str(i) for i in {*range(9), *(6 * k + 1 for k in range(10))})
    assert many.count() == 9 + 5000 - 2
    shapes = [re.sub(r"[0-9]+", "", df._jdf.queryExecution().optimizedPlan().toString()) for df in (few, many)]
    assert shapes[0] == shapes[1] and "LeftSemi" in shapes[0]


def test_flattened_headers_are_filled_in_one_pass(spark):
    wide = ["a"] + [""] * 4000 + ["b", " nan ", ""]
    rows = sheets(spark, s=[wide, ["x", "y"]], t=[[]], u=[["", "q", ""]])
    found = {r["sheet_id"]: r["headers"] for r in grid.flatten_headers(rows, 0, 1).collect()}
    assert found["t"] == [] and found["u"] == ["", "q", "q"]
    assert found["s"] == ["a_x", "a_y"] + ["a"] * 3999 + ["b"] * 3

"""Shape of the physical plans, and skewed input."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vigilgrid.functions.relational import block_join
from vigilgrid.operators import fleet, rules, timeline
from vigilgrid.plans import incident as flow
from vigilgrid.sources import testbed as tb


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange (?:hash|range|single)", plan_of(df)))


def detect(spark, sf_dir):
    return rules.detect_incidents(tb.endpoint_events(spark, sf_dir))


def test_detection_needs_three_exchanges_and_no_python(spark, sf_dir):
    df = detect(spark, sf_dir)
    plan = plan_of(df)
    # dedup key, (run, host, rule) after partial aggregation, numbering per host
    assert exchanges(df) == 3
    assert "Python" not in plan and "partial_min_by" in plan
    assert plan.count("WindowGroupLimit") == 2


def test_dedup_exchanges_on_the_event_not_on_the_host(spark, sf_dir):
    plan = plan_of(rules.dedup_events(tb.endpoint_events(spark, sf_dir)))
    assert re.search(r"hashpartitioning\(run_id#\d+, host_id#\d+, _digest#\d+", plan)


def test_unmatched_columns_are_not_read(spark, sf_dir):
    plan = plan_of(timeline.event_span(tb.endpoint_events(spark, sf_dir), F.lit(tb.AS_OF).cast("timestamp")))
    assert "props" not in re.search(r"ReadSchema: (\S+)", plan).group(1)


def test_clusters_need_two_exchanges_of_their_own(spark, sf_dir):
    # One of incidents by signature and salt, one of a row per salt; incident numbers are pruned away.
    incidents = detect(spark, sf_dir).withColumns({c: F.col("evidence_start") for c in ("window_start", "window_end")})
    assert exchanges(fleet.clusters(incidents)) == 2 + 2


def test_one_host_with_half_of_all_events(spark, sf_dir):
    """A third and more of the rows on one host and one signature gives the same result as plain counting."""
    events = tb.endpoint_events(spark, sf_dir).filter("run_id = 'run-20240101'")
    noise = spark.range(20000).select(
        F.lit("run-20240101").alias("run_id"), F.lit("HOST-HOT").alias("host_id"), F.lit(0).alias("snap_rank"),
        F.col("id").alias("pos"), F.col("id").alias("record_id"),
        F.concat(F.lit("2024-01-01T00:"), F.format_string("%02d:%02d", F.floor(F.col("id") / 60) % 60, F.col("id") % 60), F.lit("Z")).alias("ts_raw"),
        F.lit("Disk").alias("provider"), F.lit("2013").alias("event_id"), F.lit("Warning").alias("level"),
        F.lit("System").alias("source"), F.lit("System").alias("channel"), F.array(F.lit("disk_full")).alias("tags"),
        F.concat(F.lit("usage "), F.col("id").cast("string")).alias("message"),
    )
    hot = events.select(*[c for c in noise.columns]).unionByName(noise).withColumn("ts", F.col("ts_raw").cast("timestamp"))
    found = rules.detect_incidents(hot).filter("host_id = 'HOST-HOT'").collect()
    assert [(r["type"], r["event_count"], r["severity"]) for r in found] == [("disk_full", 20000, 90)]
    assert found[0]["signature_key"] == "Disk:2013|usage <n>"
    evidence = rules.incident_evidence(hot).filter("host_id = 'HOST-HOT'")
    stats = evidence.agg(F.count("*"), F.min("evidence_rank"), F.max("evidence_rank"), F.count_distinct("evidence_rank")).first()
    assert tuple(stats) == (20000, 1, 20000, 20000)


def test_entry_and_registry(spark):
    flagship = entry.entry(spark)
    assert flagship.count() > 0 and "signature_hash" in flagship.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["clusters", "host_action", "header_candidates", "infer_schema", "table_region", "redact_message", "apply_recipe"])
def test_some_queries_against_their_sql(spark, sf_dir, name):
    from checks.compare import compare, connect

    ok, message = compare(spark, connect(sf_dir), name, entry.queries()[name], entry.oracle_sql().get(name), sf_dir)
    assert ok, message


@pytest.fixture
def no_broadcast(spark):
    """Joins as they are planned for tables that are too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ranks_sort_no_host_in_one_task(spark, sf_dir, no_broadcast):
    ordered = timeline.order_events(tb.endpoint_events(spark, sf_dir))
    # Rows are dealt by range while they are staged. Then: rows by (host, range); counts by (host, range),
    # by host for the running sum, and back to the join key.
    assert exchanges(ordered) == 4
    plan = plan_of(ordered)
    assert "SortMergeJoin" in plan and "row_number" not in plan


def test_block_join_moves_the_rows_once(spark, no_broadcast):
    rows = spark.range(100).selectExpr("concat('k', id % 3) AS key", "id AS pos", "repeat('x', 10) AS wide")
    sides = spark.range(3).selectExpr("concat('k', id) AS key", "id AS w")
    joined = block_join(rows, sides, "key", "pos")
    # rows by (key, block); extents by key, the other side by key, and their join by (key, block)
    assert exchanges(joined) == 4


def test_a_report_deduplicates_events_once(spark, sf_dir, monkeypatch):
    calls = []
    matched = rules.matched_events
    monkeypatch.setattr(rules, "matched_events", lambda *args: calls.append(1) or matched(*args))
    report = entry.queries()["host_report"](spark, sf_dir)
    assert len(calls) == 1 and "sha2" not in plan_of(report)


def test_rules_and_users_of_snapshots_are_found_without_lambdas_and_sorts(spark, sf_dir):
    assert "lambdafunction" not in plan_of(tb.endpoint_events(spark, sf_dir).select(rules.rule_matches()))
    assert "SortAggregate" not in plan_of(tb.snapshots(spark, sf_dir))


def test_hosts_are_scored_once_for_the_ranking(spark, sf_dir, monkeypatch):
    plans = []
    action = fleet.host_action
    monkeypatch.setattr(fleet, "host_action", lambda top, *rest: plans.append(plan_of(top)) or action(top, *rest))
    tables = flow.incident_table(tb.endpoint_events(spark, sf_dir), tb.snapshots(spark, sf_dir))
    flow.fleet_view(*tables, tb.runs(spark, sf_dir))
    assert len(plans) == 1 and "Window" not in plans[0] and "Exchange" not in plans[0]

"""Scores of a run against truth labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def detected_vs_expected_types(truth: DataFrame, incidents: DataFrame) -> DataFrame:
    """Detected and expected incident types per run, and how many of them agree.

    Type sets are bounded by the number of rules. ``truth`` has ``run_id, expected_types``.
    """
    found = incidents.groupBy("run_id").agg(F.array_sort(F.collect_set("type")).alias("detected_types"))
    none = F.array().cast("array<string>")
    joined = truth.select("run_id", F.array_distinct("expected_types").alias("expected_types")).join(
        found, "run_id", "left"
    )
    detected = F.coalesce(F.col("detected_types"), none)
    return joined.select(
        "run_id",
        "expected_types",
        detected.alias("detected_types"),
        F.size(F.array_intersect(F.col("expected_types"), detected)).alias("hits"),
    )


def type_precision_recall(truth: DataFrame, incidents: DataFrame) -> DataFrame:
    sets = detected_vs_expected_types(truth, incidents)
    empty = F.size("expected_types") == 0
    hits = F.col("hits").cast("double")

    def ratio(column: str):
        return F.when(empty, F.lit(1.0)).otherwise(hits / F.greatest(F.lit(1), F.size(column)))

    return sets.select(
        "run_id", ratio("detected_types").alias("precision"), ratio("expected_types").alias("recall")
    )


def ranking_hit_rate(expected_hosts: DataFrame, top: DataFrame, runs: DataFrame) -> DataFrame:
    """Share of the expected hosts found in the first positions of the ranking.

    ``expected_hosts`` has one row per run and expected host; runs without any score 1.
    """
    sizes = Window.partitionBy("run_id")
    wanted = expected_hosts.select("run_id", "host_id").withColumn("_k", F.count(F.lit(1)).over(sizes))
    ranked = top.select("run_id", "host_id", "host_rank")
    scored = wanted.join(ranked, ["run_id", "host_id"], "left").groupBy("run_id").agg(
        (F.count_if(F.col("host_rank") <= F.col("_k")) / F.count(F.lit(1))).alias("ranking_score")
    )
    return (
        runs.select("run_id")
        .distinct()
        .join(scored, "run_id", "left")
        .select("run_id", F.coalesce("ranking_score", F.lit(1.0)).alias("ranking_score"))
    )


def cluster_hit(cluster_rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Whether a run has a cluster of at least two hosts."""
    wide = cluster_rows.groupBy("run_id").agg(F.bool_or(F.col("affected_hosts") >= 2).alias("_wide"))
    return (
        runs.select("run_id")
        .distinct()
        .join(wide, "run_id", "left")
        .select("run_id", F.coalesce("_wide", F.lit(False)).alias("cluster_detected"))
    )


def scenario_checks(
    truth: DataFrame, cluster_rows: DataFrame, summaries: DataFrame, snapshot_hosts: DataFrame
) -> DataFrame:
    """Warnings that depend on the scenario tags of a run; one row per warning.

    ``summaries`` has ``run_id, host_count``; ``snapshot_hosts`` one row per run and host seen.
    """
    seen = snapshot_hosts.groupBy("run_id").agg(F.count_distinct("host_id").alias("_seen"))
    facts = (
        truth.select("run_id", F.split("scenario_tags", ",").alias("_tags"))
        .join(cluster_hit(cluster_rows, truth), "run_id", "left")
        .join(summaries.select("run_id", "host_count"), "run_id", "left")
        .join(seen, "run_id", "left")
    )
    hosts = F.coalesce(F.col("host_count"), F.lit(0))

    def tagged(tag: str):
        return F.array_contains("_tags", tag)

    warnings = F.filter(
        F.array(
            F.when(
                tagged("driver_rollout_wave") & ~F.col("cluster_detected"),
                "expected clustered outage but none detected",
            ),
            F.when(
                tagged("missing_data") & (hosts == 0),
                "missing_data scenario resulted in zero hosts (unexpected)",
            ),
            F.when(
                tagged("time_skew") & (hosts != F.coalesce(F.col("_seen"), F.lit(0))),
                "time_skew scenario host count mismatch",
            ),
        ),
        lambda w: w.isNotNull(),
    )
    return facts.select("run_id", F.explode(warnings).alias("warning"))


def validation_report(
    scores: DataFrame, ranking: DataFrame, hits: DataFrame, warnings: DataFrame, violations: DataFrame
) -> DataFrame:
    """One row per run with all scores, the number of warnings and of rule violations.

    ``violations`` has ``run_id, violations``.
    """
    warned = warnings.groupBy("run_id").agg(F.count(F.lit(1)).alias("scenario_warnings"))
    return (
        scores.join(ranking, "run_id", "left")
        .join(hits, "run_id", "left")
        .join(warned, "run_id", "left")
        .join(violations, "run_id", "left")
        .select(
            "run_id",
            "precision",
            "recall",
            "ranking_score",
            "cluster_detected",
            F.coalesce("scenario_warnings", F.lit(0)).alias("scenario_warnings"),
            F.coalesce("violations", F.lit(0)).alias("violations"),
        )
    )

"""Cross-host views of a run: clusters, ranking, run-over-run change, summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relational import ranked_position, salted_join
from ..model import HOST

CLUSTER = ("run_id", "signature_hash")
EXAMPLE_HOSTS = 20
TOP_HOSTS = 10
SALTS = 32


def clusters(incidents: DataFrame, salts: int = SALTS) -> DataFrame:
    """Incidents of a run grouped by signature.

    A signature may be hit by every host of a fleet, so its hosts are first spread over ``salts``
    groups by a hash of the host. All per-host work happens under that one exchange; what meets per
    signature is one row per salt with at most 20 example hosts.
    """
    salted = incidents.select(
        *CLUSTER,
        F.pmod(F.xxhash64("host_id"), F.lit(salts)).cast("int").alias("_salt"),
        "host_id",
        "severity",
        "window_start",
        "window_end",
        F.struct("host_id", "rule_no", "type", "signature_key").alias("_lead"),
    ).repartition(*[F.col(c) for c in (*CLUSTER, "_salt")])
    # An incident counts for the time range only where both sides of its window are known.
    known = F.col("window_start").isNotNull() & F.col("window_end").isNotNull()
    hosts = salted.groupBy(*CLUSTER, "_salt", "host_id").agg(
        F.max("severity").alias("severity"),
        F.min(F.when(known, F.col("window_start"))).alias("first_seen"),
        F.max(F.when(known, F.col("window_end"))).alias("last_seen"),
        F.min("_lead").alias("_lead"),
    )
    rank = F.row_number().over(Window.partitionBy(*CLUSTER, "_salt").orderBy("host_id"))
    parts = (
        hosts.withColumn("_rank", rank)
        .groupBy(*CLUSTER, "_salt")
        .agg(
            F.count(F.lit(1)).alias("hosts"),
            F.max("severity").alias("severity"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.min("_lead").alias("_lead"),
            F.collect_list(F.when(F.col("_rank") <= EXAMPLE_HOSTS, F.col("host_id"))).alias("_examples"),
        )
    )
    merged = parts.groupBy(*CLUSTER).agg(
        F.sum("hosts").alias("affected_hosts"),
        F.max("severity").alias("_severity"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min("_lead").alias("_lead"),
        F.slice(F.sort_array(F.flatten(F.collect_list("_examples"))), 1, EXAMPLE_HOSTS).alias("example_hosts"),
    )
    grown = F.col("_severity") + F.lit(5) * (F.col("affected_hosts") - 1)
    return merged.select(
        *CLUSTER,
        F.col("_lead.signature_key").alias("signature_key"),
        F.col("_lead.type").alias("type"),
        "affected_hosts",
        "example_hosts",
        F.least(F.lit(100), grown).cast("int").alias("severity"),
        "first_seen",
        "last_seen",
        F.col("_lead.host_id").alias("_lead_host"),
        F.col("_lead.rule_no").alias("_lead_rule"),
    )


def rank_clusters(cluster_rows: DataFrame, k: int | None = None) -> DataFrame:
    """Clusters of a run by (severity, hosts) descending, ties in order of first host and rule."""
    order = [
        F.col("severity").desc(),
        F.col("affected_hosts").desc(),
        F.col("_lead_host").asc(),
        F.col("_lead_rule").asc(),
    ]
    if k is not None:
        rank = F.row_number().over(Window.partitionBy("run_id").orderBy(*order)).cast("bigint")
        return cluster_rows.withColumn("cluster_rank", rank).filter(F.col("cluster_rank") <= k)
    return ranked_position(cluster_rows, ["run_id"], order, "cluster_rank", 1, "cluster-ranks")


def previous_run(runs: DataFrame) -> DataFrame:
    """Each run with the greatest run id before it.

    ``runs`` is the ledger with one row per run, so a single task sorts no more than the run ids.
    """
    window = Window.partitionBy(F.lit(0)).orderBy("run_id")
    return runs.select("run_id").distinct().withColumn("prev_run_id", F.lag("run_id").over(window))


def _with_history(rows: DataFrame, history: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    """Rows of this job and, marked as old, the few columns of earlier runs they are compared with."""
    current = rows.withColumn("_old", F.lit(False))
    if history is None:
        return current
    return current.unionByName(
        history.select(*columns).withColumn("_old", F.lit(True)), allowMissingColumns=True
    )


def cluster_status(
    cluster_rows: DataFrame, runs: DataFrame, history: DataFrame | None = None
) -> DataFrame:
    """Clusters marked new, ongoing or spiking against the run before.

    ``history`` has ``run_id, signature_hash, affected_hosts`` of runs from earlier jobs. One window
    per signature over the runs in which it occurs replaces a self-join of all clusters.
    """
    by_signature = Window.partitionBy("signature_hash").orderBy("run_id")
    earlier = F.lag(F.struct("run_id", "affected_hosts")).over(by_signature)
    all_rows = _with_history(cluster_rows, history, ["run_id", "signature_hash", "affected_hosts"])
    seen = (
        all_rows.join(previous_run(runs), "run_id", "left")
        .withColumn("_earlier", earlier)
        .filter(~F.col("_old"))
        .withColumn(
            "delta_affected_hosts",
            F.when(
                F.col("_earlier.run_id") == F.col("prev_run_id"),
                F.col("affected_hosts") - F.col("_earlier.affected_hosts"),
            ),
        )
    )
    status = (
        F.when(F.col("delta_affected_hosts").isNull(), "new")
        .when(F.col("delta_affected_hosts") >= 2, "spiking")
        .otherwise("ongoing")
    )
    return seen.withColumn("status", status).drop("_earlier", "prev_run_id", "_old")


def host_scores(hosts: DataFrame, incidents: DataFrame) -> DataFrame:
    """Score, reasons and incident ids of every host; hosts without incidents score 0.

    Both inputs meet in one aggregation. The lists are bounded by the number of rules.
    """
    reason = F.concat(F.col("type"), F.lit(" (sev "), F.col("severity").cast("string"), F.lit(")"))
    entry = F.struct("rule_no", reason.alias("reason"), "incident_id", "type", "signature_hash")
    rows = hosts.select(*HOST, "user_id").unionByName(
        incidents.select(*HOST, F.col("severity").cast("int").alias("_severity"), entry.alias("_entry")),
        allowMissingColumns=True,
    )
    grouped = rows.groupBy(*HOST).agg(
        F.max("user_id").alias("user_id"),
        F.coalesce(F.max("_severity"), F.lit(0)).alias("score"),
        F.sort_array(F.collect_list("_entry")).alias("incident_list"),
    )
    return grouped.select(
        *HOST,
        F.when(F.col("user_id") != "", F.col("user_id")).alias("user_id"),
        "score",
        F.transform("incident_list", lambda e: e["reason"]).alias("reasons"),
        F.transform("incident_list", lambda e: e["incident_id"]).alias("incident_refs"),
        "incident_list",
    )


def top_hosts(hosts: DataFrame, incidents: DataFrame, k: int = TOP_HOSTS) -> DataFrame:
    """The ``k`` worst hosts of each run; the rank filter is applied before the exchange too."""
    scores = host_scores(hosts, incidents)
    order = [
        F.col("score").desc(),
        F.size("incident_refs").desc(),
        F.col("host_id").asc(),
    ]
    window = Window.partitionBy("run_id").orderBy(*order)
    return scores.withColumn("host_rank", F.row_number().over(window)).filter(F.col("host_rank") <= k)


def host_deltas(top: DataFrame, runs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Score change of each ranked host against the ranking of the run before.

    ``history`` has ``run_id, host_id, score`` of the ranked hosts of earlier jobs.
    """
    by_host = Window.partitionBy("host_id").orderBy("run_id")
    earlier = F.lag(F.struct("run_id", "score")).over(by_host)
    return (
        _with_history(top, history, [*HOST, "score"])
        .join(previous_run(runs), "run_id", "left")
        .withColumn("_earlier", earlier)
        .filter(~F.col("_old"))
        .withColumn(
            "prev_score", F.when(F.col("_earlier.run_id") == F.col("prev_run_id"), F.col("_earlier.score"))
        )
        .withColumn("delta_score", F.col("score") - F.col("prev_score"))
        .drop("_earlier", "prev_run_id", "_old")
    )


def host_cluster_flags(incidents: DataFrame, statuses: DataFrame) -> DataFrame:
    """Whether any cluster of a host is spiking or new.

    The join is salted by host, since one signature may carry most incidents of a run.
    """
    joined = salted_join(
        incidents.select(*CLUSTER, "host_id"),
        statuses.select(*CLUSTER, "status"),
        list(CLUSTER),
        ["host_id"],
        "inner",
    )
    return joined.groupBy(*HOST).agg(
        F.bool_or(F.col("status") == "spiking").alias("has_spiking"),
        F.bool_or(F.col("status") == "new").alias("has_new"),
    )


def incident_cluster_lookup(incidents: DataFrame, statuses: DataFrame) -> DataFrame:
    """Incidents with the key and status of their cluster."""
    facts = statuses.select(
        *CLUSTER, F.col("signature_key").alias("cluster_key"), F.col("status").alias("cluster_status")
    )
    return salted_join(incidents, facts, list(CLUSTER), ["host_id"], "left")


def host_action(
    top: DataFrame, statuses: DataFrame, runs: DataFrame, history: DataFrame | None = None
) -> DataFrame:
    """Recommended action for each ranked host, with the reason for it.

    Only the few ranked hosts are joined with the clusters, not all incidents.
    """
    links = top.select(
        *HOST, F.explode(F.transform("incident_list", lambda e: e["signature_hash"])).alias("signature_hash")
    )
    flags = (
        links.join(statuses.select(*CLUSTER, "status"), list(CLUSTER), "inner")
        .groupBy(*HOST)
        .agg(
            F.bool_or(F.col("status") == "spiking").alias("_spiking"),
            F.bool_or(F.col("status") == "new").alias("_new"),
        )
    )
    urgent = F.exists("reasons", lambda r: F.lower(r).rlike("bsod|unexpected_shutdown"))
    alarm = F.coalesce(F.col("_spiking"), F.lit(False)) | F.coalesce(F.col("_new"), F.lit(False)) | urgent
    rising = F.col("prev_score").isNull() | (F.col("delta_score") >= 5)
    contact = alarm | ((F.col("score") >= 70) & rising)
    monitor = (F.col("score") >= 50) | F.coalesce(F.col("delta_score") >= 10, F.lit(False))
    action = F.when(contact, "contact").when(monitor, "monitor").otherwise("ignore")
    reason = (
        F.when(contact, "High severity or cluster spike")
        .when(monitor, "Moderate severity or trending up")
        .otherwise("Low severity or stable")
    )
    return (
        host_deltas(top, runs, history)
        .join(flags, list(HOST), "left")
        .withColumns({"action": action, "action_reason": reason})
        .drop("_spiking", "_new", "prev_score")
    )


def executive_summary(
    hosts: Column, incidents: Column, types: Column, risk: Column, action: Column
) -> Column:
    text = F.concat(
        hosts.cast("string"),
        F.lit(" host(s) affected; "),
        incidents.cast("string"),
        F.lit(" incident(s) ("),
        F.array_join(F.slice(F.sort_array(types), 1, 3), ", "),
        F.lit("); overall risk "),
        risk.cast("string"),
        F.lit("; action: "),
        action,
        F.lit("."),
    )
    return F.when(incidents > 0, text).otherwise("No incidents detected in the selected window.")


def fleet_summary(
    windows: DataFrame, incidents: DataFrame, cluster_rows: DataFrame, actions: DataFrame, runs: DataFrame | None = None
) -> DataFrame:
    """One row per run. Every input is reduced to a row per run before the rows meet.

    ``runs`` names runs that have a row even without a host.
    """
    facts = (
        windows.select("run_id", "window_start", "window_end", F.lit(1).alias("_host"))
        .unionByName(
            incidents.select("run_id", F.lit(1).alias("_incident"), F.col("type").alias("_type")),
            allowMissingColumns=True,
        )
        .unionByName(
            cluster_rows.select("run_id", F.lit(1).alias("_cluster")), allowMissingColumns=True
        )
        .unionByName(
            actions.filter(F.col("host_rank") <= 5).select(
                "run_id",
                F.col("score").alias("_score"),
                F.when(F.col("host_rank") == 1, F.col("action")).alias("_action"),
            ),
            allowMissingColumns=True,
        )
    )
    if runs is not None:
        facts = facts.unionByName(runs.select("run_id"), allowMissingColumns=True)
    per_run = facts.groupBy("run_id").agg(
        F.min("window_start").alias("window_start"),
        F.max("window_end").alias("window_end"),
        F.coalesce(F.sum("_host"), F.lit(0)).alias("host_count"),
        F.coalesce(F.sum("_incident"), F.lit(0)).alias("incident_count"),
        F.coalesce(F.sum("_cluster"), F.lit(0)).alias("cluster_count"),
        F.coalesce(F.sum("_score"), F.lit(0)).alias("_top_score"),
        F.count("_score").alias("_top"),
        F.max("_action").alias("_action"),
        F.collect_set("_type").alias("_types"),
    )
    mean = F.col("_top_score") / F.greatest(F.lit(1), F.col("_top"))
    risk = F.when(
        F.col("_top") > 0, F.least(F.lit(100), F.floor(mean + F.lit(2) * F.col("cluster_count")))
    ).otherwise(0)
    scored = per_run.withColumn("overall_risk_score", risk.cast("int"))
    return scored.withColumn(
        "executive_summary",
        executive_summary(
            F.col("host_count"),
            F.col("incident_count"),
            F.col("_types"),
            F.col("overall_risk_score"),
            F.coalesce(F.col("_action"), F.lit("ignore")),
        ),
    ).drop("_top_score", "_top", "_action", "_types")


def filter_clusters(
    statuses: DataFrame, types: Sequence[str] = (), status: str = "all", min_hosts: int = 1
) -> DataFrame:
    """Clusters by type, status and size; an empty type list keeps all types."""
    out = statuses.filter(F.col("affected_hosts") >= min_hosts)
    if types:
        out = out.filter(F.col("type").isin(list(types)))
    return out if status == "all" else out.filter(F.col("status") == status)


def filter_hosts(top: DataFrame, min_score: int = 0, search: str = "") -> DataFrame:
    """Ranked hosts by score and by a piece of the host or user name."""
    out = top.filter(F.col("score") >= min_score)
    if not search:
        return out
    piece = search.lower()
    user = F.coalesce(F.col("user_id"), F.lit(""))
    return out.filter(F.lower("host_id").contains(piece) | F.lower(user).contains(piece))


def host_options(top: DataFrame, hosts: DataFrame) -> DataFrame:
    """Every host that is ranked or has a timeline, once per run."""
    return top.select(*HOST).union(hosts.select(*HOST)).distinct()

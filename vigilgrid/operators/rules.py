"""Detection rules as data, and the one-pass detector that applies all of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.relational import first_per_group, ranked_position
from ..model import HOST
from ..session import stage


@dataclass(frozen=True)
class Rule:
    """A rule fires on a host when at least ``min_events`` of its events match.

    An event matches by tag, or by a lower-case substring of its source or provider. Severity is
    ``base + step * min(max_steps, n - free)`` up to ``cap``; confidence is
    ``confidence + per_event * n`` up to ``confidence_cap``, or one of two fixed values.
    """

    type: str
    summary: str
    actions: tuple[str, ...]
    tags: tuple[str, ...] = ()
    source_contains: str | None = None
    provider_contains: str | None = None
    min_events: int = 1
    base: int = 50
    step: int = 5
    free: int = 1
    max_steps: int | None = None
    cap: int = 100
    confidence: float = 0.7
    per_event: float = 0.0
    confidence_cap: float = 1.0
    confidence_single: float | None = None


# The built-in rules, in the order in which incidents of one host are numbered.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule(
        type="bsod",
        summary="Detected blue screen or unexpected shutdown events",
        actions=(
            "Capture minidump and driver list before reboot loops clear them.",
            "Roll back or update the last installed driver/patch.",
        ),
        tags=("bsod", "unexpected_shutdown"),
        base=85,
        cap=100,
        confidence=0.9,
        confidence_single=0.75,
    ),
    Rule(
        type="disk_full",
        summary="Disk usage approaching capacity",
        actions=(
            "Clear temp folders and large caches.",
            "Expand disk or reassign user data to secondary volume.",
        ),
        tags=("disk_full",),
        source_contains="disk",
        base=70,
        max_steps=4,
        cap=95,
        confidence=0.7,
        per_event=0.05,
        confidence_cap=0.95,
    ),
    Rule(
        type="service_crash_loop",
        summary="Repeated service crashes detected",
        actions=(
            "Review service logs for repeated stop codes.",
            "Restart service under supervisor and collect crash dumps.",
        ),
        tags=("service_crash",),
        provider_contains="service control manager",
        min_events=2,
        base=65,
        free=0,
        max_steps=5,
        cap=90,
        confidence=0.7,
        per_event=0.05,
        confidence_cap=0.95,
    ),
    Rule(
        type="network_instability",
        summary="Network instability detected",
        actions=(
            "Reset adapter and DNS cache, verify driver version.",
            "Check site switch/appliance for correlated resets.",
        ),
        tags=("network_reset", "dns_failure"),
        base=55,
        free=0,
        max_steps=6,
        cap=85,
        confidence=0.6,
        per_event=0.05,
        confidence_cap=0.9,
    ),
    Rule(
        type="update_failure",
        summary="Repeated update or install failures",
        actions=(
            "Re-run updater with verbose logging enabled.",
            "Remove partially applied patches and retry.",
        ),
        tags=("update_failure",),
        source_contains="update",
        base=65,
        max_steps=4,
        cap=90,
        confidence=0.65,
        per_event=0.05,
        confidence_cap=0.9,
    ),
)
DEFAULT_ACTIONS = ("Collect logs and escalate to tier 2.",)


def rule_matches(rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """Array of the (1-based) numbers of the rules an event matches."""
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    source = F.lower(F.coalesce(F.col("source"), F.lit("")))
    provider = F.lower(F.coalesce(F.col("provider"), F.lit("")))
    hits = []
    for number, rule in enumerate(rules, start=1):
        hit = F.lit(False)
        if rule.tags:
            hit = hit | F.arrays_overlap(tags, F.array(*[F.lit(t) for t in rule.tags])).eqNullSafe(True)
        if rule.source_contains:
            hit = hit | source.contains(rule.source_contains)
        if rule.provider_contains:
            hit = hit | provider.contains(rule.provider_contains)
        hits.append(F.when(hit, F.lit(number)).otherwise(F.lit(0)))
    # No lambda here: Spark would interpret it, and all that it reads, for every event.
    return F.array_remove(F.array(*hits), 0)


def rule_field(number: Column, rules: Sequence[Rule], field: str, kind: str) -> Column:
    """Look up one attribute of a rule by its number; a constant array, folded at plan time."""
    values = [F.lit(getattr(rule, field)).cast(kind) for rule in rules]
    return F.element_at(F.array(*values), number)


def severity(number: Column, events: Column, rules: Sequence[Rule]) -> Column:
    steps = events - rule_field(number, rules, "free", "bigint")
    limit = F.coalesce(rule_field(number, rules, "max_steps", "bigint"), steps)
    raw = rule_field(number, rules, "base", "bigint") + rule_field(
        number, rules, "step", "bigint"
    ) * F.least(steps, limit)
    return F.least(raw, rule_field(number, rules, "cap", "bigint")).cast("int")


def confidence(number: Column, events: Column, rules: Sequence[Rule]) -> Column:
    grown = rule_field(number, rules, "confidence", "double") + rule_field(
        number, rules, "per_event", "double"
    ) * events.cast("double")
    single = rule_field(number, rules, "confidence_single", "double")
    usual = F.least(grown, rule_field(number, rules, "confidence_cap", "double"))
    return F.when(single.isNotNull() & (events == 1), single).otherwise(usual)


def recommended_actions(incident_type: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """Advice texts for an incident type; unknown types get the general advice."""
    out = F.lit(None)
    for rule in rules:
        out = F.when(incident_type == rule.type, F.array(*[F.lit(a) for a in rule.actions])).otherwise(out)
    return F.coalesce(out, F.array(*[F.lit(a) for a in DEFAULT_ACTIONS]))


def event_order(ts: str = "ts", ts_raw: str = "ts_raw") -> list[Column]:
    """Total order of the events of one host: time, then text of the time, then arrival."""
    return [
        F.col(ts).asc_nulls_first(),
        F.col(ts_raw).asc_nulls_first(),
        F.col("snap_rank").asc(),
        F.col("pos").asc(),
    ]


def _order_struct() -> Column:
    # min_by compares structs field by field with nulls first, as event_order does.
    return F.struct("ts", "ts_raw", "snap_rank", "pos")


def dedup_digest() -> Column:
    """Identity of an event, taken before its message is redacted."""
    return text.row_digest(
        F.col("record_id"), F.col("ts_raw"), F.col("provider"), F.col("event_id"), F.col("message")
    )


def dedup_events(events: DataFrame) -> DataFrame:
    """First copy of each event of a host, in event order.

    The exchange is on the identity of the event, not on the host, so a noisy host is spread over
    all tasks and a much-copied event is cut to one row per map task before it.
    """
    keyed = events.withColumn("_digest", dedup_digest())
    order = [F.col("snap_rank").asc(), F.col("pos").asc()]
    return first_per_group(keyed, [*HOST, "_digest"], order).drop("_digest")


def matched_events(
    events: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, deduplicated: bool = False
) -> DataFrame:
    """One row per (event, matching rule) over deduplicated events.

    Rules are evaluated before the dedup exchange: events without a match cross it as a digest and
    a position only, because their copy may still come before one that matches. Events that are
    ``deduplicated`` already need no exchange at all.
    """
    payload = F.struct("provider", "event_id", "record_id", "level", "source", "message")
    slim = events.withColumn("_rules", rule_matches(rules)).select(
        *HOST,
        "snap_rank",
        "pos",
        (F.lit(None) if deduplicated else dedup_digest()).alias("_digest"),
        "_rules",
        F.when(F.size("_rules") > 0, F.struct("ts", "ts_raw", payload.alias("body"))).alias("_event"),
    )
    order = [F.col("snap_rank").asc(), F.col("pos").asc()]
    # The digest comes first because sorts begin with it: it tells rows apart, names of runs and hosts rarely do.
    first = slim if deduplicated else first_per_group(slim, ["_digest", *HOST], order)
    return first.filter(F.size("_rules") > 0).select(
        *HOST,
        F.explode("_rules").alias("rule_no"),
        F.col("_event.ts").alias("ts"),
        F.col("_event.ts_raw").alias("ts_raw"),
        "snap_rank",
        "pos",
        F.col("_event.body").alias("body"),
    )


def staged_matches(
    events: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    redaction: str = "balanced",
    path_patterns: str = "legacy",
) -> DataFrame:
    """Matched events, staged for operators that are called with ``matched=True``.

    Deduplication moves all events, so it should happen once where incidents and their evidence are
    both wanted. Redacted first: what is staged must not hold more than what is published.
    """
    clean = text.redact_message(F.col("body.message"), redaction, path_patterns)
    matches = matched_events(events, rules).withColumn("body", F.col("body").withField("message", clean))
    return stage(matches, "matched-events")


def detect_incidents(
    events: DataFrame,
    windows: DataFrame | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
    redaction: str = "balanced",
    path_patterns: str = "legacy",
    deduplicated: bool = False,
    matched: bool = False,
) -> DataFrame:
    """Incidents of every host of every run, one row per host and rule that fires.

    Counts and first events are combined on the map side, so no task holds the events of a host.
    Redaction and signatures are computed once per incident, on its first event. For events whose
    messages are redacted already pass ``redaction='off'``. ``matched`` events are rows of
    ``staged_matches``: matched by the same rules, deduplicated and redacted.
    """
    redaction = "off" if matched else redaction
    matches = events if matched else matched_events(events, rules, deduplicated)
    per_rule = (
        matches.groupBy(*HOST, "rule_no")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.min_by("body", _order_struct()).alias("_first"),
            F.min("ts").alias("evidence_start"),
            F.max("ts").alias("evidence_end"),
        )
        .filter(F.col("event_count") >= rule_field(F.col("rule_no"), rules, "min_events", "bigint"))
    )
    number = F.col("rule_no")
    template = text.message_template(text.redact_message(F.col("_first.message"), redaction, path_patterns))
    signed = per_rule.select(
        *HOST,
        "rule_no",
        rule_field(number, rules, "type", "string").alias("type"),
        severity(number, F.col("event_count"), rules).alias("severity"),
        confidence(number, F.col("event_count"), rules).alias("confidence"),
        "event_count",
        rule_field(number, rules, "summary", "string").alias("summary"),
        F.col("_first.provider").alias("provider"),
        F.col("_first.event_id").alias("event_id"),
        template.alias("template"),
        "evidence_start",
        "evidence_end",
    )
    signed = signed.withColumns(
        {
            "signature_hash": text.signature_hash(F.col("provider"), F.col("event_id"), F.col("template")),
            "signature_key": text.signature_key(F.col("provider"), F.col("event_id"), F.col("template")),
        }
    ).drop("provider", "event_id", "template")
    numbered = number_incidents(signed)
    if windows is None:
        return numbered
    bounds = windows.select(*HOST, "window_start", "window_end")
    return numbered.join(bounds, list(HOST), "left")


def number_incidents(incidents: DataFrame) -> DataFrame:
    """Running id per host in rule order; a host has at most one row per rule."""
    window = Window.partitionBy(*HOST).orderBy("rule_no")
    ordinal = F.row_number().over(window).cast("string")
    return incidents.withColumn("incident_id", F.concat(F.col("host_id"), F.lit("-incident-"), ordinal))


def incident_evidence(
    events: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    redaction: str = "balanced",
    limit: int | None = None,
    deduplicated: bool = False,
    matched: bool = False,
) -> DataFrame:
    """Evidence rows of every incident, ranked in event order.

    With ``limit`` only the first rows per incident are kept. Without it all are ranked, by ranges of
    the whole order, so a host with very many matches is not sorted by one task. ``matched`` as for
    ``detect_incidents``.
    """
    redaction = "off" if matched else redaction
    matches = events if matched else matched_events(events, rules, deduplicated)
    keys = [*HOST, "rule_no"]
    needed = rule_field(F.col("rule_no"), rules, "min_events", "bigint")
    if limit is None:
        # Redacted first: what is staged must not hold more than what is published.
        clean = text.redact_message(F.col("body.message"), redaction)
        matches = matches.withColumn("body", F.col("body").withField("message", clean))
        redaction = "off"
        ranked = ranked_position(matches, keys, event_order(), "evidence_rank", 1, "matched-events")
        fired = ranked.groupBy(*keys).agg(F.max("evidence_rank").alias("_n")).filter(F.col("_n") >= needed)
        kept = ranked.join(fired.drop("_n"), keys, "left_semi")
    else:
        # The first rows also tell whether the rule fired, as long as enough of them are kept.
        depth = max(limit, *[rule.min_events for rule in rules])
        window = Window.partitionBy(*keys).orderBy(*event_order())
        kept = (
            matches.withColumn("evidence_rank", F.row_number().over(window).cast("bigint"))
            .filter(F.col("evidence_rank") <= depth)
            .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
            .filter((F.col("_n") >= needed) & (F.col("evidence_rank") <= limit))
        )
    message = text.redact_message(F.col("body.message"), redaction)
    return kept.select(
        *HOST,
        rule_field(F.col("rule_no"), rules, "type", "string").alias("type"),
        "evidence_rank",
        F.coalesce(F.col("ts_raw"), F.lit("")).alias("ts"),
        F.coalesce(F.col("body.provider"), F.lit("")).alias("provider"),
        F.coalesce(F.col("body.level"), F.lit("")).alias("level"),
        text.clip_message(message).alias("message"),
        F.col("body.event_id").alias("event_id"),
        F.col("body.source").alias("source"),
        F.col("body.record_id").alias("record_id"),
    )


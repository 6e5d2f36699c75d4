"""Schemas of the documents and tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


WINDOW = T.StructType(_text("start", "end"))

# event_id may be a number or text in a document; as STRING both are read.
EVENT = T.StructType(
    _text("ts", "level", "source", "channel", "provider", "event_id")
    + [T.StructField("record_id", T.LongType())]
    + _text("opcode", "task")
    + [T.StructField("keywords", T.ArrayType(T.StringType()))]
    + _text("computer", "message")
    + [
        T.StructField("data", T.MapType(T.StringType(), T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)

STATS = T.StructType(
    [
        T.StructField(name, T.LongType())
        for name in ("event_count", "critical_count", "error_count", "warning_count")
    ]
)

SNAPSHOT = T.StructType(
    _text("schema_version", "snapshot_id", "host_id", "user_id", "generated_at")
    + [
        T.StructField("window", WINDOW),
        *_text("window_start", "window_end"),
        T.StructField(
            "device",
            T.StructType(
                _text("hostname", "domain", "os_name", "os_version", "build", "manufacturer", "model")
            ),
        ),
        T.StructField("collector", T.StructType(_text("name", "version", "method"))),
        T.StructField(
            "filters",
            T.StructType(
                [
                    T.StructField("levels", T.ArrayType(T.StringType())),
                    T.StructField("providers_allowlist", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField("events", T.ArrayType(EVENT)),
        T.StructField("stats", STATS),
    ]
)

TICKET = T.StructType(
    _text("schema_version", "ticket_id", "source", "created_at", "host_id", "user_id", "subject", "body")
    + [
        T.StructField("reported_window", WINDOW),
        T.StructField("symptoms", T.ArrayType(T.StringType())),
        T.StructField(
            "truth",
            T.StructType(
                [
                    T.StructField("expects_incident_types", T.ArrayType(T.StringType())),
                    T.StructField("expects_clustered_outage", T.BooleanType()),
                ]
            ),
        ),
    ]
)

SHEET_ROWS = T.StructType(
    [
        T.StructField("sheet_id", T.StringType()),
        T.StructField("row_idx", T.LongType()),
        T.StructField("cells", T.ArrayType(T.StringType())),
    ]
)

RUN_LEDGER = T.StructType(
    [
        *_text("run_id", "attempt", "status"),
        T.StructField("at", T.TimestampType()),
        T.StructField("violations", T.LongType()),
    ]
)

RUN_SCHEMAS = T.StructType(_text("name", "attempt", "ddl"))

_CELLS = T.ArrayType(T.StringType())
_AT = T.StructField("at", T.TimestampType())

# Tables of the onboarding flow, by name; ``attempt`` is the partition column of all.
SHEET_TABLES = {
    "clean": T.StructType(
        [
            *_text("sheet_id"),
            T.StructField("row_idx", T.LongType()),
            T.StructField("headers", _CELLS),
            T.StructField("cells", _CELLS),
            *_text("attempt"),
        ]
    ),
    "schema": T.StructType(
        [
            *_text("sheet_id"),
            T.StructField("out_idx", T.IntegerType()),
            *_text("source", "canonical", "dtype"),
            T.StructField("required", T.BooleanType()),
            *_text("schema_layer", "attempt"),
        ]
    ),
    "metadata": T.StructType([*_text("sheet_id"), T.StructField("ord", T.IntegerType()), *_text("target", "value", "attempt")]),
    "manifest": T.StructType(
        [*_text("sheet_id", "saved_uri"), T.StructField("rows_written", T.LongType()), _AT, *_text("attempt")]
    ),
    "audit": T.StructType(
        [
            *_text("sheet_id"),
            T.StructField("seq", T.IntegerType()),
            *_text("event"),
            _AT,
            T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
            *_text("attempt"),
        ]
    ),
    "recipes": T.StructType(
        [
            *_text("recipe_key", "header_row"),
            T.StructField("merge_fields", _CELLS),
            T.StructField("merge_all", T.BooleanType()),
            *_text("attempt"),
        ]
    ),
    "recipe_fields": T.StructType(
        [
            *_text("recipe_key"),
            T.StructField("ord", T.IntegerType()),
            *_text("target", "source_pointer", "source_type", "data_type", "attempt"),
        ]
    ),
    "recipe_index": T.StructType(
        [*_text("structural_hash", "recipe_key"), T.StructField("stored_at", T.TimestampType()), *_text("source_run_id", "attempt")]
    ),
    "sheet_ledger": T.StructType(
        [
            *_text("sheet_id", "status", "next_step", "message", "header_source", "structural_hash", "recipe_key"),
            _AT,
            *_text("attempt"),
        ]
    ),
}

# Enumerations of the document formats.
LEVELS = ("Critical", "Error", "Warning", "Information", "Verbose")
COLLECTOR_METHODS = ("local_script", "winrm", "intune_export", "edr_api", "simulated", "other")
TICKET_SOURCES = ("simulated", "portal", "email", "phone", "other")
INCIDENT_TYPES = (
    "bsod",
    "unexpected_shutdown",
    "disk_errors",
    "disk_full",
    "network_instability",
    "dns_failures",
    "tls_schannel",
    "update_failure",
    "service_crash_loop",
    "app_crash_loop",
    "auth_failures",
    "other",
)
ACTIONS = ("contact", "monitor", "ignore")
CLUSTER_STATUSES = ("new", "ongoing", "spiking")

HOST = ("run_id", "host_id")

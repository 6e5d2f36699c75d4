"""Scalar functions over whole texts and values: queries and checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilgrid.functions import cells as C
from vigilgrid.functions import text as T
from vigilgrid.sources import testbed as tb

from .catalog import query


def _chain(start: str, steps: list[tuple[str, str]]) -> str:
    sql = start
    for pattern, replacement in steps:
        quoted = pattern.replace("'", "''")
        sql = f"regexp_replace({sql}, '{quoted}', '{replacement}', 'g')"
    return sql


_SECRETS = [(p, T.REDACTED) for p in T.SECRET_PATTERNS] + [(T.TOKEN_PATTERN, T.REDACTED)]
_EMAIL = [(T.EMAIL_PATTERN, T.REDACTED_EMAIL)]
_IP = [(T.IPV4_PATTERN, r"\1.0/24")]
_LEGACY = [(p, T.REDACTED_PATH) for p in T.LEGACY_PATH_PATTERNS]
_WINDOWS = [(p, T.REDACTED_PATH) for p in T.WINDOWS_PATH_PATTERNS]
_PLANTED_SQL = (
    "text || ' PassWord=a' || doc_id || ' token=x secret : y' || doc_id || ' C:\\dir\\f' || doc_id "
    "|| ' \\\\srv\\share\\f at 12:3' || (doc_id % 10) || ':59 from 10.1.2.' || (doc_id % 256) || ' http://host/a'"
)


def _planted():
    """Document text with secrets, paths, a time and an address added at its end."""
    n = F.col("doc_id").cast("string")
    return F.concat(
        F.col("text"), F.lit(" PassWord=a"), n, F.lit(" token=x secret : y"), n, F.lit(" C:\\dir\\f"), n,
        F.lit(" \\\\srv\\share\\f at 12:3"), (F.col("doc_id") % 10).cast("string"), F.lit(":59 from 10.1.2."),
        (F.col("doc_id") % 256).cast("string"), F.lit(" http://host/a"),
    )


@query("redact_message", f"SELECT doc_id, {_chain('text', _SECRETS + _EMAIL + _LEGACY + _IP)} AS redacted FROM documents")
def redact_message(spark, sf):
    return tb.table(spark, sf, "documents").select("doc_id", T.redact_message(F.col("text")).alias("redacted"))


@query(
    "redact_message_strict",
    f"SELECT doc_id, {_chain(_PLANTED_SQL, _SECRETS + _EMAIL + _WINDOWS + _IP + [(T.CLOCK_PATTERN, T.MASKED_CLOCK)])} AS redacted FROM documents",
)
def redact_message_strict(spark, sf):
    redacted = T.redact_message(_planted(), "strict", "windows")
    return tb.table(spark, sf, "documents").select("doc_id", redacted.alias("redacted"))


@query(
    "sanitize_raw_message",
    f"SELECT doc_id, substr({_chain(_PLANTED_SQL, _EMAIL + _WINDOWS + _IP)}, 1, 4000) AS message FROM documents",
)
def sanitize_raw_message(spark, sf):
    return tb.table(spark, sf, "documents").select("doc_id", T.sanitize_raw_message(_planted()).alias("message"))


_TEMPLATE_SQL = _chain(
    f"lower({_chain('text', [(f'^{T.SPACE}+|{T.SPACE}+$', '')])})", [(f"{T.SPACE}+", " "), (f"{T.DIGIT}+", "<n>")]
)
# lower comes first in the engine; white space does not change with case, so the order is free.


@query("message_template", f"SELECT doc_id, {_TEMPLATE_SQL} AS template FROM documents")
def message_template(spark, sf):
    return tb.table(spark, sf, "documents").select("doc_id", T.message_template(F.col("text")).alias("template"))


_ID_SQL = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '0' ELSE CAST(doc_id AS VARCHAR) END"


def _id():
    n = F.col("doc_id")
    return F.when(n % 4 == 1, "0").when(n % 4 != 0, n.cast("string"))


@query(
    "signature_hash",
    f"SELECT doc_id, substr(sha256(source || '|' || coalesce({_ID_SQL}, 'None') || '|' || {_TEMPLATE_SQL}), 1, 12) AS signature_hash FROM documents",
)
def signature_hash(spark, sf):
    template = T.message_template(F.col("text"))
    return tb.table(spark, sf, "documents").select(
        "doc_id", T.signature_hash(F.col("source"), _id(), template).alias("signature_hash")
    )


@query(
    "signature_key",
    f"""
    SELECT doc_id, source || ':' || CASE WHEN doc_id % 4 IN (0, 1) THEN '' ELSE CAST(doc_id AS VARCHAR) END || '|' || substr({_TEMPLATE_SQL}, 1, 200) AS signature_key
    FROM documents
    """,
)
def signature_key(spark, sf):
    template = T.message_template(F.col("text"))
    return tb.table(spark, sf, "documents").select(
        "doc_id", T.signature_key(F.col("source"), _id(), template).alias("signature_key")
    )


@query(
    "clip_message",
    "SELECT doc_id, CASE WHEN length(text) > 512 THEN substr(text, 1, 509) || '...' ELSE text END AS clipped FROM documents",
)
def clip_message(spark, sf):
    return tb.table(spark, sf, "documents").select("doc_id", T.clip_message(F.col("text")).alias("clipped"))


@query(
    "hash_user",
    """
    SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 10 = 1 THEN NULL
      ELSE 'user-' || substr(sha256('check-salt' || 'user' || user_id), 1, 12) END AS strict_user,
      'user' || user_id AS balanced_user FROM events
    """,
)
def hash_user(spark, sf):
    user = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    some = F.when(F.col("event_id") % 10 == 0, "").when(F.col("event_id") % 10 != 1, user)
    return tb.table(spark, sf, "events").select(
        "event_id", T.hash_user(some, "strict", "check-salt").alias("strict_user"), T.hash_user(user).alias("balanced_user")
    )


_LABEL_SQL = _chain("v", [(f"^{T.SPACE}+|{T.SPACE}+$", "")])
_VALUE_SQL = "CASE p_partkey % 5 WHEN 0 THEN '  ' || p_name || ' ' WHEN 1 THEN '   ' WHEN 2 THEN NULL WHEN 3 THEN upper(p_type) || '\t x' ELSE p_brand END"


def _value():
    n = F.col("p_partkey")
    return (
        F.when(n % 5 == 0, F.concat(F.lit("  "), "p_name", F.lit(" ")))
        .when(n % 5 == 1, "   ")
        .when(n % 5 == 3, F.concat(F.upper("p_type"), F.lit("\t x")))
        .when(n % 5 == 4, F.col("p_brand"))
    )


@query(
    "normalize_header",
    f"""
    SELECT p_partkey, CASE WHEN coalesce({_LABEL_SQL}, '') = '' THEN 'unnamed_' || p_size ELSE replace(lower({_LABEL_SQL}), ' ', '_') END AS header
    FROM (SELECT *, {_VALUE_SQL} AS v FROM part)
    """,
)
def normalize_header(spark, sf):
    return tb.table(spark, sf, "part").select("p_partkey", C.normalize_header(_value(), F.col("p_size")).alias("header"))


@query(
    "normalize_label",
    f"SELECT p_partkey, coalesce(lower({_chain(_LABEL_SQL, [(f'{T.SPACE}+', ' ')])}), '') AS label FROM (SELECT *, {_VALUE_SQL} AS v FROM part)",
)
def normalize_label(spark, sf):
    return tb.table(spark, sf, "part").select("p_partkey", C.normalize_label(_value()).alias("label"))


_NUMBER_SQL = """CASE l_orderkey % 9 WHEN 0 THEN CAST(l_linenumber AS VARCHAR) WHEN 1 THEN l_linenumber || '.' WHEN 2 THEN '.' || l_linenumber
  WHEN 3 THEN '-' || l_linenumber WHEN 4 THEN l_linenumber || 'e3' WHEN 5 THEN '.' WHEN 6 THEN ' ' || l_linenumber || '.5 '
  WHEN 7 THEN l_linenumber || '-2' ELSE 'EUR 1,234' || l_linenumber || '.50 net' END"""


def _number():
    m, n = F.col("l_orderkey") % 9, F.col("l_linenumber").cast("string")
    return (
        F.when(m == 0, n)
        .when(m == 1, F.concat(n, F.lit(".")))
        .when(m == 2, F.concat(F.lit("."), n))
        .when(m == 3, F.concat(F.lit("-"), n))
        .when(m == 4, F.concat(n, F.lit("e3")))
        .when(m == 5, ".")
        .when(m == 6, F.concat(F.lit(" "), n, F.lit(".5 ")))
        .when(m == 7, F.concat(n, F.lit("-2")))
        .otherwise(F.concat(F.lit("EUR 1,234"), n, F.lit(".50 net")))
    )


@query("numeric_like", f"SELECT l_orderkey, l_linenumber, l_orderkey % 9 IN (0, 1, 2, 6) AS numeric_like FROM lineitem")
def numeric_like(spark, sf):
    return tb.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.numeric_like(_number()).alias("numeric_like"))


@query(
    "clean_number_text",
    f"SELECT l_orderkey, l_linenumber, regexp_extract(replace(v, ',', ''), '-?[0-9]+(\\.[0-9]+)?') AS cleaned FROM (SELECT *, {_NUMBER_SQL} AS v FROM lineitem)",
)
def clean_number_text(spark, sf):
    return tb.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.clean_number_text(_number()).alias("cleaned"))


@query(
    "clean_number",
    f"""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 IN (5, 7) THEN NULL
      ELSE CAST(regexp_replace(v, '[^0-9.\\-]', '', 'g') AS DOUBLE) END AS cleaned FROM (SELECT *, {_NUMBER_SQL} AS v FROM lineitem)
    """,
)
def clean_number(spark, sf):
    return tb.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.clean_number(_number()).alias("cleaned"))


def _day():
    m, at = F.col("l_orderkey") % 6, F.col("l_shipdate")
    return (
        F.when(m == 0, F.date_format(at, "yyyy-MM-dd"))
        .when(m == 1, F.date_format(at, "MM/dd/yyyy"))
        .when(m == 2, F.date_format(at, "dd-MMM-yyyy"))
        .when(m == 3, F.date_format(at, "yyyyMMdd"))
        .when(m == 4, F.concat(F.lit(" "), F.date_format(at, "yyyy/MM/dd")))
        .otherwise(F.concat(F.lit("about "), F.date_format(at, "yyyy"), F.lit(" ")))
    )


@query(
    "clean_date",
    """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 6 < 5 THEN strftime(l_shipdate, '%Y-%m-%d') END AS cleaned,
           CASE WHEN l_orderkey % 6 < 5 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE 'about ' || strftime(l_shipdate, '%Y') END AS cleaned_text
    FROM lineitem
    """,
)
def clean_date(spark, sf):
    return tb.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.date_format(C.clean_date(_day()), "yyyy-MM-dd").alias("cleaned"),
        C.clean_date_text(_day()).alias("cleaned_text"),
    )


@query(
    "clean_string",
    f"SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE coalesce({_LABEL_SQL}, '') END AS cleaned FROM (SELECT *, {_VALUE_SQL} AS v FROM part)",
)
def clean_string(spark, sf):
    value = F.when(F.col("p_partkey") % 7 == 0, " nan ").otherwise(_value())
    return tb.table(spark, sf, "part").select("p_partkey", C.clean_string(value).alias("cleaned"))


@query(
    "header_looks_like_data",
    """
    SELECT l_orderkey, l_linenumber, (l_linenumber >= 3)::INT + (l_suppkey % 2 = 0)::INT + (l_partkey % 3 = 0)::INT >= 1 AS looks_like_data
    FROM lineitem
    """,
)
def header_looks_like_data(spark, sf):
    headers = F.array(
        F.when(F.col("l_linenumber") >= 3, F.col("l_linenumber").cast("string")).otherwise("item"),
        F.when(F.col("l_suppkey") % 2 == 0, "12.5").otherwise("unnamed_1"),
        F.when(F.col("l_partkey") % 3 == 0, "7").otherwise("part"),
    )
    return tb.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", C.header_looks_like_data(headers).alias("looks_like_data")
    )


@query("file_hash", "SELECT page_id, sha256(html) AS file_hash FROM pages")
def file_hash(spark, sf):
    return tb.table(spark, sf, "pages").select("page_id", C.file_hash(F.encode("html", "UTF-8")).alias("file_hash"))

"""Scalar functions over event text: timestamps, redaction, signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes with the meaning of \s, \S and \d for Unicode text. Spelled out so that the
# same pattern means the same in the JVM and in other regex engines.
_SPACE_CHARS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE = f"[{_SPACE_CHARS}]"
NON_SPACE = f"[^{_SPACE_CHARS}]"
# White space that is not one plain blank: what collapsing to one blank really changes.
UNEVEN_SPACE = (
    rf" {SPACE}+|[\t-\r\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]{SPACE}*"
)
TRIM_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
DIGIT = r"\p{Nd}"

# Redaction patterns and placeholders, in the order in which they are applied.
SECRET_PATTERNS = (
    rf"(?i)password={NON_SPACE}+",
    rf"(?i)secret{SPACE}*[:=]{SPACE}*{NON_SPACE}+",
    rf"(?i)token={NON_SPACE}+",
)
TOKEN_PATTERN = r"[A-Za-z0-9+/=]{24,}"
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LEGACY_PATH_PATTERNS = (
    r"[A-Za-z]:\\\\[^\\s]+",
    r"[A-Za-z]:/[^\\s]+",
    r"\\\\[A-Za-z0-9_.-]+\\\\[^\\s]+",
)
WINDOWS_PATH_PATTERNS = (
    rf"\\\\[A-Za-z0-9_.-]+\\{NON_SPACE}+",
    rf"[A-Za-z]:\\{NON_SPACE}+",
)
# The same matches, found faster: a token starts where a run of its characters starts, and the name
# in an address never has to be tried again in parts.
_TOKEN_AT_START = "(?<![A-Za-z0-9+/=])" + TOKEN_PATTERN
_EMAIL_NO_RETRY = EMAIL_PATTERN.replace("]+@", "]++@")
IPV4_PATTERN = rf"\b({DIGIT}{{1,3}}\.{DIGIT}{{1,3}}\.{DIGIT}{{1,3}})\.{DIGIT}{{1,3}}\b"
CLOCK_PATTERN = rf"{DIGIT}{{2}}:{DIGIT}{{2}}:{DIGIT}{{2}}"
REDACTED = "[REDACTED]"
REDACTED_EMAIL = "[REDACTED_EMAIL]"
REDACTED_PATH = "[REDACTED_PATH]"
MASKED_CLOCK = "HH:MM:SS"
ISO_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}.*)?$"

MESSAGE_LIMIT = 4000
EVIDENCE_LIMIT = 512
KEY_TEMPLATE_LIMIT = 200
HASH_CHARS = 12

# Windows log level codes.
LEVEL_CODES = {1: "Critical", 2: "Error", 3: "Warning", 4: "Information"}


def strip(value: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(value, F.lit(TRIM_CHARS))


def collapse_space(value: Column) -> Column:
    """Every run of white space as one blank."""
    return F.regexp_replace(value, UNEVEN_SPACE, " ")


def parse_ts(value: Column) -> Column:
    """ISO-8601 text to an instant; junk and empty text become null, naive text is UTC.

    A whole date is needed: a time of day alone would take today's date, and results must not depend
    on the clock.
    """
    return F.when(value.rlike(ISO_SHAPE), F.try_to_timestamp(value))


def iso_text(ts: Column) -> Column:
    """Instant as ISO text with offset, with microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
    exact = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(F.date_trunc("second", ts) == ts, whole).otherwise(exact)


def redact_message(message: Column, mode: str = "balanced", path_patterns: str = "legacy") -> Column:
    """Mask secrets, long tokens, e-mail addresses, paths and the last IPv4 octet.

    ``mode``: ``balanced``, ``strict`` (also masks times of day) or ``off``.
    ``path_patterns``: ``legacy`` keeps signatures comparable with older runs, ``windows`` matches
    real drive and UNC paths.
    """
    raw = F.coalesce(message, F.lit(""))
    if mode == "off":
        return raw

    def replace_all(value: Column, patterns: Sequence[str], placeholder: str) -> Column:
        for pattern in patterns:
            value = F.regexp_replace(value, pattern, placeholder)
        return value

    # Most texts hold nothing to mask. Plain searches in the raw text, each for something that the
    # patterns behind it cannot do without, keep the costly patterns off such texts.
    has = raw.contains
    out = F.when(has("=") | has(":"), replace_all(raw, SECRET_PATTERNS, REDACTED)).otherwise(raw)
    out = F.regexp_replace(out, _TOKEN_AT_START, REDACTED)
    out = F.when(has("@"), F.regexp_replace(out, _EMAIL_NO_RETRY, REDACTED_EMAIL)).otherwise(out)
    paths = WINDOWS_PATH_PATTERNS if path_patterns == "windows" else LEGACY_PATH_PATTERNS
    out = F.when(has("\\") | has(":/"), replace_all(out, paths, REDACTED_PATH)).otherwise(out)
    out = F.regexp_replace(out, IPV4_PATTERN, "$1.0/24")
    if mode == "strict":
        out = F.regexp_replace(out, CLOCK_PATTERN, MASKED_CLOCK)
    return out


def sanitize_raw_message(message: Column) -> Column:
    """Cleaning done at collection time, before a raw log row becomes an event."""
    raw = F.coalesce(message, F.lit(""))
    out = F.when(raw.contains("@"), F.regexp_replace(raw, _EMAIL_NO_RETRY, REDACTED_EMAIL)).otherwise(raw)
    masked = out
    for pattern in WINDOWS_PATH_PATTERNS:
        masked = F.regexp_replace(masked, pattern, REDACTED_PATH)
    out = F.when(raw.contains("\\"), masked).otherwise(out)
    out = F.regexp_replace(out, IPV4_PATTERN, "$1.0/24")
    return F.substring(out, 1, MESSAGE_LIMIT)


def level_name(code: Column) -> Column:
    """Numeric log level to its name; unknown codes are informational."""
    names = F.create_map(*[F.lit(x) for pair in LEVEL_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), F.lit("Information"))


def hash_user(user: Column, mode: str = "balanced", salt: str | None = None) -> Column:
    """Pseudonym for a user in strict mode; otherwise, and for empty values, unchanged.

    Strict mode needs a secret ``salt``: with a known one pseudonyms can be looked up.
    """
    if mode != "strict":
        return user
    if not salt:
        raise ValueError("strict mode needs a salt")
    digest = F.substring(F.sha2(F.concat(F.lit(salt), user), 256), 1, HASH_CHARS)
    return F.when(user != "", F.concat(F.lit("user-"), digest)).otherwise(user)


def message_template(message: Column) -> Column:
    """Message with case, white space and digit runs levelled out."""
    out = collapse_space(strip(F.lower(F.coalesce(message, F.lit("")))))
    return F.regexp_replace(out, f"{DIGIT}+", "<n>")


def signature_hash(provider: Column, event_id: Column, template: Column) -> Column:
    text = F.concat_ws(
        "|", F.coalesce(provider, F.lit("")), F.coalesce(event_id, F.lit("None")), template
    )
    return F.substring(F.sha2(text, 256), 1, HASH_CHARS)


def signature_key(provider: Column, event_id: Column, template: Column) -> Column:
    shown_id = F.when(event_id.isNull() | (event_id == "0"), "").otherwise(event_id)
    return F.concat(
        F.coalesce(provider, F.lit("")),
        F.lit(":"),
        shown_id,
        F.lit("|"),
        F.substring(template, 1, KEY_TEMPLATE_LIMIT),
    )


def clip_message(message: Column) -> Column:
    text = F.coalesce(message, F.lit(""))
    short = F.concat(F.substring(text, 1, EVIDENCE_LIMIT - 3), F.lit("..."))
    return F.when(F.length(text) > EVIDENCE_LIMIT, short).otherwise(text)


def row_digest(*columns: Column) -> Column:
    """Digest (32 bytes) of several nullable values.

    Each part carries its length and nulls are their own value, so different rows differ as text.
    """
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat_ws("|", *parts), 256))

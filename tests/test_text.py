"""Scalar functions over text: fixed values and edge cases."""

import pytest
from pyspark.sql import functions as F

from vigilgrid.functions import text as T


SALT = "salt-of-the-tests"


def one(spark, value, function, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(function(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "provider, event_id, template, expected",
    [
        ("Disk", "2019", "disk full: c: volume at <n>%, write failures, temp/profile cannot expand", "bdfdbe16a1d2"),
        ("DNS Client Events", "1014", "name resolution failure for critical service", "b308ff1a2715"),
    ],
)
def test_signature_hash_fixed_values(spark, provider, event_id, template, expected):
    df = spark.createDataFrame([(provider, event_id, template)], "p string, e string, t string")
    assert df.select(T.signature_hash(F.col("p"), F.col("e"), F.col("t"))).first()[0] == expected


def test_signature_of_missing_and_zero_ids(spark):
    df = spark.createDataFrame([(None, None, "x"), ("P", "0", "x" * 300)], "p string, e string, t string")
    keys = [r[0] for r in df.select(T.signature_key(F.col("p"), F.col("e"), F.col("t"))).collect()]
    assert keys == [":|x", "P:|" + "x" * 200]
    hashes = df.select(T.signature_hash(F.col("p"), F.col("e"), F.col("t"))).collect()
    assert hashes[0][0] != hashes[1][0]


def test_hash_user(spark):
    assert one(spark, "user1", lambda c: T.hash_user(c, "strict", SALT)) == "user-6bb3e8349623"
    assert one(spark, "", lambda c: T.hash_user(c, "strict", SALT)) == ""
    assert one(spark, None, lambda c: T.hash_user(c, "strict", SALT)) is None
    assert one(spark, "user1", T.hash_user) == "user1"


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("PASSWORD=abc x", "[REDACTED] x"),
        ("Secret : k9 x", "[REDACTED] x"),
        ("TOKEN=1;2 x", "[REDACTED] x"),
        ("id " + "A" * 24, "id [REDACTED]"),
        ("id " + "A" * 23, "id " + "A" * 23),
        ("mail bob.x@mail.example.org now", "mail [REDACTED_EMAIL] now"),
        ("C:\\Users\\bob", "C:\\Users\\bob"),
        ("http://foo", "htt[REDACTED_PATH]"),
        ("from 10.1.2.33 to", "from 10.1.2.0/24 to"),
        ("at 12:34:56", "at 12:34:56"),
        (None, ""),
    ],
)
def test_redact_balanced(spark, raw, expected):
    assert one(spark, raw, T.redact_message) == expected


def test_redact_modes(spark):
    assert one(spark, "at 12:34:56", lambda c: T.redact_message(c, "strict")) == "at HH:MM:SS"
    assert one(spark, "password=x", lambda c: T.redact_message(c, "off")) == "password=x"
    windows = lambda c: T.redact_message(c, path_patterns="windows")
    assert one(spark, "open C:\\Users\\bob now", windows) == "open [REDACTED_PATH] now"
    assert one(spark, "open \\\\srv\\share\\f now", windows) == "open [REDACTED_PATH] now"


def test_sanitize_cuts_and_masks(spark):
    assert one(spark, "C:\\a\\b 1.2.3.4", T.sanitize_raw_message) == "[REDACTED_PATH] 1.2.3.0/24"
    assert len(one(spark, "x" * 5000, T.sanitize_raw_message)) == 4000
    assert one(spark, None, T.sanitize_raw_message) == ""


def test_template_handles_unicode_space_and_digits(spark):
    assert one(spark, "\u00a0 Disk\t C:\u2003 at 91% \n", T.message_template) == "disk c: at <n>%"
    assert one(spark, "n \u0663\u0664", T.message_template) == "n <n>"


def test_clip(spark):
    assert one(spark, "a" * 512, T.clip_message) == "a" * 512
    assert one(spark, "a" * 513, T.clip_message) == "a" * 509 + "..."


def test_level_names(spark):
    names = [one(spark, i, T.level_name, "int") for i in (1, 2, 3, 4, 0, 9)]
    assert names == ["Critical", "Error", "Warning", "Information", "Information", "Information"]


def test_timestamps(spark):
    texts = ["2026-01-01T00:00:00Z", "2026-01-01T02:00:00+02:00", "2026-01-01T00:00:00", "", "junk", None, "12:30:00", "7:5", "2024", "2024-05"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    found = [r[0] for r in df.select(F.unix_seconds(T.parse_ts(F.col("v")))).collect()]
    assert found == [1767225600, 1767225600, 1767225600, *[None] * 7]
    shown = one(spark, "2026-01-01T00:00:00.5Z", lambda c: T.iso_text(T.parse_ts(c)))
    assert shown == "2026-01-01T00:00:00.500000+00:00"
    assert one(spark, "2026-01-01T00:00:00Z", lambda c: T.iso_text(T.parse_ts(c))) == "2026-01-01T00:00:00+00:00"


def test_digest_is_unambiguous(spark):
    rows = [("a|1:b", None), ("a", "1:b"), (None, "a"), ("a", None), ("", None), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "a string, b string")
    digests = {bytes(r[0]) for r in df.select(T.row_digest(F.col("a"), F.col("b"))).collect()}
    assert len(digests) == len(rows) and {len(d) for d in digests} == {32}

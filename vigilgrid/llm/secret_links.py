"""Secrets in texts, and the weaker parts of a credential where its other parts stand beside them.

Some shapes tell a secret by themselves (``BASE``): a value assigned to a telling name, an access
identifier, a long hexadecimal run. Others are weak (``WEAK``): a login name, a bare random string, an
endpoint are found in any text and mean nothing alone. A weak part is reported only where a part that
complements it (``COMPLEMENTS``) stands in its scope: in the same block of lines (no blank line
between), at most ``REACH`` characters apart, not overlapping. Base spans are always reported.

Tasks scan whole texts and give the places of the parts, no text. What can't be linked is not looked
for: bare strings need an identifier somewhere in the text, endpoints a secret. Parts are then joined
as intervals: a weak part asks in the bins of positions that its scope touches, complements stand in
the bins that they touch, and the join is on text, block and bin. Spans of a kind don't overlap, so the
pairs of a bin are bounded by its length, and one very long text is spread over its bins. A span is
reported once, however many parts complement it.

Defined results: null and empty texts have no spans; positions count code points; repeated rows (also
of one key) are scanned and linked each on its own; a null key stays null; other columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, stage

# What the base spans look like. Of a match of ``assign`` the value must have 8 characters or more.
NAMES = "password|passwd|secret|token|api_?key"
VALUE = "[A-Za-z0-9+/_.=-]+"
LEAST_VALUE = 8
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
# The weak parts.
LOGINS = "username|user|login|client_?id|account"
LOGIN_VALUE = "[A-Za-z0-9@+_.-]{3,}"
BARE = "[A-Za-z0-9+/_-]{20,}"  # with letters of both cases and digits
ENDPOINT = r"[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\x00-\x20\x22\x27<>]+|[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}(?::[0-9]+)?"
BLANK = r"\n[ \t\r]*\n"

BASE = ("assign", "access", "hex")
WEAK = ("login", "bare", "endpoint")
KINDS = (*BASE, *WEAK)
COMPLEMENTS = {"login": ("assign", "bare"), "bare": ("access", "login"), "endpoint": ("assign", "access")}
REACH = 200
BIN = 512

_LINK = r"[\"']?\x20*[:=]\x20*[\"']?"
_PATTERNS = {
    "assign": re.compile(f"(?:{NAMES}){_LINK}({VALUE})", re.IGNORECASE | re.ASCII),
    "access": re.compile(ACCESS),
    "hex": re.compile(HEX),
    "login": re.compile(f"(?:{LOGINS}){_LINK}{LOGIN_VALUE}", re.IGNORECASE | re.ASCII),
    "bare": re.compile(BARE),
    "endpoint": re.compile(ENDPOINT),
}
_BLANK = re.compile(BLANK)
_NAMED = ("passw", "secret", "token", "apikey", "api_key")
_LOGGED = ("user", "login", "client", "account")

Part = tuple[int, int, int, int]  # start, number of the kind, end, block


def _mixed(text: str) -> bool:
    return bool(re.search("[a-z]", text) and re.search("[A-Z]", text) and re.search("[0-9]", text))


def _apart(spans: list[tuple[int, int]], others: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """The spans that overlap none of the others."""
    taken = sorted(s for other in others for s in other)
    reach, ends = [], 0
    for _, end in taken:
        ends = max(ends, end)
        reach.append(ends)
    kept = []
    for start, end in spans:
        before = bisect_right(taken, (end - 1, float("inf")))
        if not before or reach[before - 1] <= start:
            kept.append((start, end))
    return kept


def find_parts(text: str) -> list[Part]:
    """Base spans of a text and the weak ones that some part of the text may complement, by start and kind."""
    lower = text.lower()
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if any(name in lower for name in _NAMED):
        matches = _PATTERNS["assign"].finditer(text)
        found["assign"] = [m.span() for m in matches if m.end(1) - m.start(1) >= LEAST_VALUE]
    if "AKIA" in text:
        found["access"] = [m.span() for m in _PATTERNS["access"].finditer(text)]
    found["hex"] = [m.span() for m in _PATTERNS["hex"].finditer(text)]
    base = [found[kind] for kind in BASE]
    if any(name in lower for name in _LOGGED):
        found["login"] = _apart([m.span() for m in _PATTERNS["login"].finditer(text)], base)
    if found["access"] or found["login"]:
        bare = [m.span() for m in _PATTERNS["bare"].finditer(text) if _mixed(m.group())]
        found["bare"] = _apart(bare, [*base, found["login"]])
    if found["assign"] or found["access"]:
        endpoints = [m.span() for m in _PATTERNS["endpoint"].finditer(text)]
        found["endpoint"] = _apart(endpoints, base)
    blanks = [m.end() for m in _BLANK.finditer(text)] if any(found[kind] for kind in WEAK) else []
    return sorted(
        (start, number, end, bisect_right(blanks, start)) for number, kind in enumerate(KINDS) for start, end in found[kind]
    )


_PART = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("block", pa.int32())])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, _key, parts``: places of the parts of every row; ``row`` tells rows with one key apart.

    Staged, so that a row keeps its number whatever is run again.
    """
    source = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                rows = [[dict(zip(("start", "kind", "end", "block"), p)) for p in find_parts(t or "")] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(_PART))], names=["_key", "parts"])

    kind = source.schema["_key"].dataType.simpleString()
    found = source.mapInArrow(run, f"_key {kind}, parts array<struct<start:int,kind:int,end:int,block:int>>")
    return stage(found.select(F.monotonically_increasing_id().alias("row"), "_key", "parts"), "secret-parts")


def _bins(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(F.greatest(start, F.lit(0)) / BIN), F.floor(end / BIN)))


def linked(scanned: DataFrame, reach: int = REACH) -> DataFrame:
    """``row, start, kind, end, block``: weak parts that a part in their scope complements, once each."""
    first = len(BASE)
    some = scanned.filter(F.exists("parts", lambda p: p["kind"] >= first))
    parts = some.select("row", F.explode("parts").alias("part")).select("row", "part.*")
    asking = parts.filter(F.col("kind") >= first)
    asking = asking.withColumn("bin", _bins(F.col("start") - reach, F.col("end") + reach))
    pairs = [F.lit(KINDS.index(weak) * len(KINDS) + KINDS.index(other)) for weak, others in COMPLEMENTS.items() for other in others]
    names = {name: f"_{name}" for name in ("row", "start", "kind", "end", "block", "bin")}
    giving = parts.filter(F.col("kind") != KINDS.index("endpoint")).withColumn("bin", _bins(F.col("start"), F.col("end")))
    giving = giving.select(*[F.col(name).alias(other) for name, other in names.items()])
    same = [F.col(name) == F.col(names[name]) for name in ("row", "block", "bin")]
    fits = (F.col("kind") * len(KINDS) + F.col("_kind")).isin(*pairs)
    after, before = F.col("start") - F.col("_end"), F.col("_start") - F.col("end")
    near = after.between(0, reach) | before.between(0, reach)
    both = asking.join(giving, [*same, fits, near], "left_semi")
    return both.select("row", "start", "kind", "end", "block").distinct()


def shown(spans: Column) -> Column:
    """Spans as ``kind:start:end`` by start and kind, joined by commas."""
    kinds = F.array(*[F.lit(kind) for kind in KINDS])

    def one(p: Column) -> Column:
        return F.concat_ws(":", kinds[p["kind"]], p["start"].cast("string"), p["end"].cast("string"))

    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """``key, base, spans`` of every row: base spans, and all spans that are reported, as arrays of structs."""
    scanned = scan(docs, key, text)
    more = linked(scanned, reach).groupBy(F.col("row").alias("_row"))
    more = more.agg(F.collect_list(F.struct("start", "kind", "end", "block")).alias("_more"))
    base = F.filter("parts", lambda p: p["kind"] < len(BASE))
    found = scanned.join(more, F.col("row") == F.col("_row"), "left")
    spans = F.when(F.col("_more").isNull(), base).otherwise(F.concat(base, F.col("_more")))
    return found.select(F.col("_key").alias(key), base.alias("base"), F.array_sort(spans).alias("spans"))

"""Importance resampling towards a target: hashed words and word pairs weigh a text, Gumbel noise draws.

A feature is a run of one or two consecutive words, hashed to a bucket (crc32 of its bytes). A bucket's
gain is the log ratio of its smoothed share in the target to that in the corpus; a text's weight is the
mean gain of its features. Weight plus Gumbel noise, which depends on the key alone, ranks the texts:
the highest ones are a sample without replacement in which a text is as likely as its weight says.

Features are found for many texts at once. The texts are joined by a sentinel byte that no word holds,
one pass of a regular expression finds the words of all of them, a binary search in the offsets of the
texts tells whose they are, and pairs across two texts are masked before buckets are counted. The pass
goes through the joined bytes in windows that end between words; the last word is carried over, so a
very long text needs no more memory than many short ones, and loses no pair.

All texts are counted and weighed. The driver sees one count per bucket. Ranks come from ranges of the
whole order, so no task sorts all texts.

Defined results: null and empty texts have no features and the weight 0; a null key draws the noise of
an empty key; repeated rows are counted, weighed and ranked as often as they occur, in any order among
equal ones; an empty corpus or target counts as nothing but the smoothing; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.relational import ranked_position
from .common import stage

BUCKETS = 10_000
LEAST_WORDS = 20
BATCH_BYTES = 1 << 22  # of texts that are joined, and of a window

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")
_SENTINEL = b"\x00"


def _windows(joined: bytes, size: int) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(joined):
        gap = _BETWEEN.search(joined, start + size)
        end = gap.start() if gap else len(joined)
        yield start, end
        start = end


def features(texts: list[bytes], buckets: int, size: int = BATCH_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts (by position) of the words, then texts and buckets of all features, window by window."""
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    joined = _SENTINEL.join(texts).lower()
    last, last_hash = -1, 0
    for start, end in _windows(joined, size):
        spans = [m.span() for m in _WORD.finditer(joined, start, end)]
        if not spans:
            continue
        words = [joined[a:b] for a, b in spans]
        singles = list(map(crc32, words))
        owner = np.searchsorted(offsets, np.fromiter((a for a, _ in spans), np.int64, len(spans)), side="right") - 1
        # The hash of a pair goes on from the hash of its first word.
        pairs = np.fromiter(map(crc32, [b" " + w for w in words], [last_hash, *singles[:-1]]), np.int64, len(words))
        within = owner == np.r_[last, owner[:-1]]
        last, last_hash = int(owner[-1]), singles[-1]
        hashes = np.concatenate([np.array(singles, dtype=np.int64), pairs[within]])
        yield owner, np.concatenate([owner, owner[within]]), hashes % buckets


def _batches(column: pa.Array) -> Iterator[list[bytes]]:
    """Values of a binary column, null as empty, in lists of about ``BATCH_BYTES`` or one value."""
    texts, total = [], 0
    for value in column:
        text = value.as_py() or b""
        if texts and total + len(text) > BATCH_BYTES:
            yield texts
            texts, total = [], 0
        texts.append(text)
        total += len(text)
    if texts:
        yield texts


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; added up per task, then by Spark, so the driver sees ``buckets`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for texts in _batches(batch.column(0)):
                for _, _, found in features(texts, buckets):
                    total += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    parts = df.select(F.col(f"`{text}`").cast("binary").alias("_text")).mapInArrow(run, "bucket long, n long")
    counts = np.zeros(buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of the smoothed shares of each bucket, rounded down."""
    rest, whole = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array(
        [math.floor(1000 * math.log((t + 1) * rest / ((s + 1) * whole))) for s, t in zip(corpus.tolist(), target.tolist())],
        dtype=np.int64,
    )


def weighed(df: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_features, weight`` of every row of ``df``."""
    source = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("binary").alias("_text"))
    names = ["_key", "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _batches(batch.column(1)):
                n = len(texts)
                words, counts, sums = (np.zeros(n, dtype=np.int64) for _ in range(3))
                for owners, texts_of, found in features(texts, len(gain)):
                    words += np.bincount(owners, minlength=n)
                    counts += np.bincount(texts_of, minlength=n)
                    sums += np.bincount(texts_of, weights=gain[found], minlength=n).astype(np.int64)
                values = [words, counts, sums // np.maximum(counts, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *map(pa.array, values)], names=names)
                at += n

    kind = source.schema["_key"].dataType.simpleString()
    found = source.mapInArrow(run, f"_key {kind}, n_words long, n_features long, weight long")
    return found.withColumnRenamed("_key", key)


def noise(key: Column, seed: int) -> Column:
    """1000 times a standard Gumbel value, rounded down, from the sha256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = 25,
    seed: int = 7,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """``key, n_features, weight, score, rank`` of every row; the rank of what is not drawn is null.

    ``percent`` of the rows with at least ``least_words`` words are drawn.
    """
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    found = weighed(docs, gain, key, text).withColumn("score", F.col("weight") + noise(F.col(f"`{key}`"), seed))
    found = stage(found, "importance-weights")
    fit = F.col("n_words") >= least_words
    drawn = percent * found.filter(fit).count() // 100
    columns = [f"`{key}`", "n_features", "weight", "score"]
    order = [F.col("score").desc(), F.col(f"`{key}`").asc()]
    ranked = ranked_position(found.filter(fit).select(*columns), [], order, "rank", 1, "importance-ranks")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = found.filter(~fit).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)

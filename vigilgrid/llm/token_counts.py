"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A batch of events says what the count of a document under a tokenizer version is now (``insert`` and
``revise``) or that it is gone (``delete``). Against the state before the batch each event becomes signed
rows: minus the old count, plus the new one. Their sums per source, language and version are the batch's
delta, and totals are the sum of the deltas: rows of unchanged documents are never read for them.

Commits are idempotent. A batch is written under a fresh attempt and counts once its row is in the
commit log; a batch that is in the log is not applied again, and if two writers commit one batch
at the same time, the smaller attempt counts. A lost executor or driver leaves at most an attempt that nobody
reads. The state before batch b is what the batches with smaller numbers say, so applying a batch again
gives the same rows.

Everything is joins and groupings on (document, version) and sums with map-side combine by source: a hot
source is one row per task. Nothing reaches the driver but the commit log of the batch looked for.

Defined results: of several events for one document and version in a batch the last counts (by ``seq``,
then delete over revise over insert, then the largest count); a delete of an unknown document does
nothing; a null count is 0; events without document or version are ignored; null sources and languages
are groups of their own; other columns are ignored; an empty batch is committed and changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.relational import salted_join

CHANGES = "doc_id long, source string, lang string, version string, docs long, tokens long, batch long, attempt string"
DELTAS = "source string, lang string, version string, docs long, tokens long, batch long, attempt string"
COMMITS = "batch long, attempt string"
GROUP = ("source", "lang", "version")


def _read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, root: str) -> DataFrame:
    """``batch, attempt``: the attempt that counts of every committed batch."""
    return _read(spark, root, "commits", COMMITS).groupBy("batch").agg(F.min("attempt").alias("attempt"))


def _rows(spark: SparkSession, root: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    rows, log = _read(spark, root, name, schema), committed(spark, root)
    if before is not None:
        rows, log = rows.filter(F.col("batch") < before), log.filter(F.col("batch") < before)
    return rows.join(log, ["batch", "attempt"], "left_semi")


def current_counts(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """``doc_id, version, source, lang, tokens`` of the documents that are there (before a batch)."""
    sums = _rows(spark, root, "changes", CHANGES, before).groupBy("doc_id", "version", "source", "lang")
    sums = sums.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return sums.filter(F.col("docs") > 0).drop("docs")


def totals(spark: SparkSession, root: str) -> DataFrame:
    """``source, lang, version, docs, tokens`` from the deltas of all committed batches."""
    sums = _rows(spark, root, "deltas", DELTAS).groupBy(*GROUP)
    sums = sums.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return sums.filter(F.col("docs") != 0)


def signed_changes(events: DataFrame, state: DataFrame) -> DataFrame:
    """Signed rows of a batch: minus what the state says of its documents, plus what they have now."""
    rank = F.when(F.col("kind") == "delete", 2).when(F.col("kind") == "revise", 1).otherwise(0)
    seq: Column = F.col("seq") if "seq" in events.columns else F.lit(0)
    usable = events.filter(
        F.col("doc_id").isNotNull() & F.col("version").isNotNull() & F.col("kind").isin("insert", "revise", "delete")
    ).select(
        F.col("doc_id").cast("long").alias("doc_id"), "version", "kind", "source", "lang",
        F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n"), rank.alias("_rank"), seq.alias("_seq"),
    )
    last = F.max(F.struct("_seq", "_rank", "n", "source", "lang", "kind")).alias("e")
    latest = usable.groupBy("doc_id", "version").agg(last)
    old = state.join(latest, ["doc_id", "version"], "left_semi")
    minus = old.select("doc_id", "source", "lang", "version", F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))
    plus = latest.filter(F.col("e.kind") != "delete").select(
        "doc_id", F.col("e.source").alias("source"), F.col("e.lang").alias("lang"), "version",
        F.lit(1).cast("long").alias("docs"), F.col("e.n").alias("tokens"),
    )
    both = minus.unionByName(plus).groupBy("doc_id", "source", "lang", "version")
    return both.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter(
        (F.col("docs") != 0) | (F.col("tokens") != 0)
    )


def commit_batch(spark: SparkSession, root: str, batch: int, events: DataFrame, attempt: str | None = None) -> bool:
    """Apply a batch of events (``kind, doc_id, source, lang, version, n_tokens``, optionally ``seq``).

    False, and nothing is written, if the batch was committed before. Batches are numbered in the order
    in which they apply, and one is committed after those below it.
    """
    root = root.rstrip("/")
    if committed(spark, root).filter(F.col("batch") == batch).take(1):
        return False
    attempt = attempt or uuid.uuid4().hex
    folder = f"batch={batch}/attempt={attempt}"
    changes = signed_changes(events, current_counts(spark, root, batch))
    changes.write.mode("overwrite").parquet(f"{root}/changes/{folder}")
    written = spark.read.schema("doc_id long, source string, lang string, version string, docs long, tokens long")
    delta = written.parquet(f"{root}/changes/{folder}").groupBy(*GROUP)
    delta = delta.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    delta.write.mode("overwrite").parquet(f"{root}/deltas/{folder}")
    spark.createDataFrame([(batch, attempt)], COMMITS).coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return True


# The two tokenizers of the query, as patterns that every engine reads alike.
WORDS = r"[^ \t\n\x0B\f\r]+"
PIECES = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9 \t\n\x0B\f\r]"
LICENSE = r"Licensed under[^\n]*"


def counted_documents(df: DataFrame) -> DataFrame:
    """Narrow rows of the documents: counts as they are and without license lines, and the digest of the text."""
    text = F.coalesce("text", F.lit(""))
    bare = F.regexp_replace(text, LICENSE, "")
    licensed = text.contains("Licensed under")

    def count(column: Column, pattern: str) -> Column:
        return F.regexp_count(column, F.lit(pattern)).cast("long")

    def now(pattern: str) -> Column:
        return F.struct(count(text, pattern).alias("before"), F.when(licensed, count(bare, pattern)).alias("after"))

    return df.select(
        "doc_id", "source", "lang", F.sha2(text, 256).alias("digest"), licensed.alias("licensed"),
        F.map_from_arrays(F.array(F.lit("words-1"), F.lit("pieces-2")), F.array(now(WORDS), now(PIECES))).alias("counts"),
    )


def copies(df: DataFrame) -> DataFrame:
    """``doc_id`` of every document whose whole text a document with a smaller id has.

    Only digests that occur more than once are joined, and the rows of one digest are spread by their ids.
    """
    first = df.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    repeated = first.filter(F.col("_rows") > 1).drop("_rows")
    joined = salted_join(df.select("digest", "doc_id"), repeated, ["digest"], ["doc_id"], "inner")
    return joined.filter(F.col("doc_id") > F.col("_first")).select("doc_id").distinct()

"""From raw documents to token ids: the stages in order, each a table that the next one reads.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before gave. Stages move
whole rows through Python workers, so they bound the bytes of a batch in the session.

Defined results: a null text counts as empty; toxicity and near copies keep empty texts (of several one
stays), language ID rejects them; repeated rows are scored alike and count as exact copies; rows without
an id pass the near-copy stage; extra columns are carried along until the last stage; an empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilgrid.llm import byte_bpe, language_id, mixing, simhash, token_counts, toxicity
from vigilgrid.llm.common import bound_batches, fresh_name, stage, table
from vigilgrid.llm.queries import VOCABULARY

# Near copies in the stage: those of the operator's contract, three-word shingles and two bits.
NEAR = {"width": 3, "radius": 2}


# The mix of the stage: sources to the square roots of their shares, languages and topics as they are.
MIX_TEMPERATURES = {"source": 0.5, "lang": 1.0, "topic": 1.0}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that a model fitted to the labelled ones rejects go."""
    bound_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters, or of no language that the network knows, go."""
    bound_batches(spark)
    return language_id.keep_known(docs, language_id.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays, the one with the smallest id."""
    bound_batches(spark)
    return simhash.keep_one(docs, **NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document stays, and those of sources below their target weights are repeated until all weights fit."""
    text = F.coalesce("text", F.lit(""))
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.form_topic(text)}
    tokens = F.regexp_count(text, F.lit(token_counts.WORDS))
    name = fresh_name(docs, "_probability")
    return mixing.sample(docs, dims, tokens, temperatures=MIX_TEMPERATURES, name=name, whole=True).drop(name)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the ids of every document, and whether decoding them gives its text back."""
    import public_tokenizers

    bound_batches(spark)
    tokens = byte_bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    text = F.coalesce("text", F.lit(""))
    decoded = byte_bpe.with_round_trip(docs.select("doc_id", text.alias("text")), tokens, public_tokenizers.PATTERN)
    same = (F.col("decoded") == F.encode("text", "UTF-8")).alias("round_trip")
    return decoded.select("doc_id", "n_tokens", "ids", same)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


# Classifiers, fingerprints and ids of pre-tokens have no SQL; the stages are tested on their own.
ORACLE_SQL = None

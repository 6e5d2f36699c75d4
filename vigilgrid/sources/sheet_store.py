"""Published results of sheets: tables by attempt, a ledger that makes them visible, recipe and audit logs.

Every job appends under an attempt of its own. What it writes becomes visible per sheet, through the
ledger row that comes last; a job that fails leaves rows that no reader sees. Recipes are a log too:
entries are only added, and reading takes the last one of each structure.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..model import SHEET_TABLES

LEDGER = "sheet_ledger"


def append(df: DataFrame, root: str, name: str, attempt: str) -> None:
    """Rows of one attempt, with the columns that the table has in the model."""
    fields = [f for f in SHEET_TABLES[name] if f.name != "attempt"]
    rows = df.select(*[F.col(f.name).cast(f.dataType) for f in fields], F.lit(attempt).alias("attempt"))
    rows.write.mode("append").partitionBy("attempt").parquet(f"{root.rstrip('/')}/{name}")


def read_all(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All rows ever written, also of attempts that failed; an empty table where nothing was written yet."""
    schema: StructType = SHEET_TABLES[name]
    try:
        return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}").select(*schema.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def published(spark: SparkSession, root: str) -> DataFrame:
    """``sheet_id, attempt``: the last attempt of every sheet whose results were accepted."""
    good = read_all(spark, root, LEDGER).filter(F.col("status") == "ok")
    return good.groupBy("sheet_id").agg(F.max("attempt").alias("attempt"))


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of the published attempt of every sheet; attempts without one are pruned by partition."""
    return read_all(spark, root, name).join(published(spark, root), ["attempt", "sheet_id"], "left_semi")


def last_states(spark: SparkSession, root: str) -> DataFrame:
    """The last ledger row of every sheet, whatever its status."""
    entries = read_all(spark, root, LEDGER)
    rest = F.struct(*[c for c in entries.columns if c != "sheet_id"])
    return entries.groupBy("sheet_id").agg(F.max_by(rest, "attempt").alias("_last")).select("sheet_id", "_last.*")


def recipe_index(spark: SparkSession, root: str) -> DataFrame:
    """Last recipe of each structure, of entries whose sheet was accepted: ``structural_hash, recipe_key``."""
    accepted = read_all(spark, root, LEDGER).filter(F.col("status") == "ok").select("attempt", F.col("sheet_id").alias("source_run_id"))
    entries = read_all(spark, root, "recipe_index").join(accepted, ["attempt", "source_run_id"], "left_semi")
    order = F.struct("stored_at", "attempt", "source_run_id")
    return entries.groupBy("structural_hash").agg(F.max_by("recipe_key", order).alias("recipe_key"))


def audit_rows(sheets: DataFrame, seq: int, event: Column | str, at: Column, **meta: Column) -> DataFrame:
    """One audit row per sheet; ``seq`` orders the events of a job."""
    pairs = [x for name, value in meta.items() for x in (F.lit(name), value.cast("string"))]
    details = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    name = F.lit(event) if isinstance(event, str) else event
    return sheets.select("sheet_id", F.lit(seq).alias("seq"), name.alias("event"), at.alias("at"), details.alias("meta"))

"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType, StructField, StructType

from ..session import stage

SLICE_ROWS = 128  # rows whose texts are Python objects at one time

__all__ = ["SLICE_ROWS", "append_in_turn", "append_values", "bound_batches", "crc_bucket", "fresh_name", "map_texts", "numbers", "partitions", "smallest_hashes", "stage", "stage_small", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that the table does not have yet, whatever it holds (case ignored)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def crc_bucket(key: str | Column, modulus: int) -> Column:
    """Fold of a row: crc32 of the key as text, modulo ``modulus``; null keys count as empty."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


Make = Callable[[], Callable[[list], tuple]]


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, batch: str = "8m") -> None:
    """Bound the bytes that tasks and their Python workers exchange at one time, from now on in this session.

    For what is written later, by someone else.
    """
    spark.conf.set(BATCH_BYTES, batch)


def stage_small(df: DataFrame, label: str, batch: str = "8m") -> DataFrame:
    """``stage`` with a bound on the bytes that a task and its Python worker exchange at one time.

    Batches are bounded by rows otherwise, which for rows of many bytes is much memory on both sides.
    """
    spark = df.sparkSession
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, batch)
    try:
        return stage(df, label)
    finally:
        spark.conf.set(BATCH_BYTES, before)


def append_in_turn(df: DataFrame, steps: list[tuple[str, list[tuple[str, DataType]], Make]]) -> DataFrame:
    """Rows of ``df`` with the values of several functions, each by ``column, fields, make`` as ``append_values`` takes them.

    A function may read a column that one before it has added. All of them share one Python worker per
    task: with a worker for each, every core holds as many workers, and rows go to and fro between them.
    """
    schema, places = df.schema, []
    for column, fields, _ in steps:
        kind = schema[column].dataType
        if not isinstance(kind, (StringType, BinaryType)):
            raise TypeError(f"{column} is neither text nor bytes")
        places.append((schema.names.index(column), b"" if isinstance(kind, BinaryType) else ""))
        schema = StructType([*schema.fields, *[StructField(name, type_) for name, type_ in fields]])
    names, makers = schema.names, [make for _, _, make in steps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = [make() for make in makers]
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                columns = batch.slice(start, SLICE_ROWS).columns
                for (at, empty), function in zip(places, functions, strict=True):
                    values = [empty if v is None else v for v in columns[at].to_pylist()]
                    columns = [*columns, *[pa.array(found) for found in function(values)]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, schema)


def append_values(df: DataFrame, column: str, fields: list[tuple[str, DataType]], make: Make) -> DataFrame:
    """Rows of ``df`` with the values that a function finds for ``column``; null counts as empty.

    ``make`` is called once per task and gives the function, so tables are built once and caches
    live as long as a task; the function maps a list of values to one list per field. No row moves.
    """
    return append_in_turn(df, [(column, fields, make)])


def map_texts(df: DataFrame, key: str, text: str, fields: list[tuple[str, DataType]], make: Make) -> DataFrame:
    """``key`` and the values that a function finds for each text, and nothing else of ``df``."""
    source = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    found = append_values(source, "_text", [(f"_{name}", type_) for name, type_ in fields], make)
    return found.select(F.col("_key").alias(key), *[F.col(f"_{name}").alias(name) for name, _ in fields])


SENT_GROUPS = 10_000  # counts of groups that are broadcast; with more groups they are joined


def smallest_hashes(df: DataFrame, group: str, mixed: str, k: int) -> DataFrame:
    """About the ``k`` rows of each group with the smallest ``mixed`` (a 64-bit hash), never more.

    Counts come first, with map-side combine. They give each group a bound that only about 2 k of its
    hashes are expected to meet, and rows meet their bound where they are: the counts are sent to them.
    So however large a group is, few of its rows are exchanged and ranked.
    """
    counts = stage(df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows")), "group-sizes")
    few = counts.limit(SENT_GROUPS + 1).count() <= SENT_GROUPS
    place = F.pmod(F.col(mixed), F.lit(1 << 53)) / F.lit(float(1 << 53))
    near = df.join(F.broadcast(counts) if few else counts, group).filter(place < F.lit(2.0 * k) / F.col("_rows"))
    ranked = near.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(place, mixed)))
    return ranked.filter(F.col("_place") <= k).select(*df.columns)


def numbers(array: pa.Array, dtype: str) -> np.ndarray:
    """Values of a primitive Arrow array without nulls."""
    return np.asarray(array.to_numpy(zero_copy_only=False), dtype=dtype)

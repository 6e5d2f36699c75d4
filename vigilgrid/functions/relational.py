"""Relational helpers that stay correct and spread out when one group holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """Keep the first ``k`` rows of each group.

    A rank filter is pre-applied before the shuffle (window group limit), so a hot group sends at
    most ``k`` rows per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= k).drop("_rn")


def split_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    split: Column,
    name: str,
    start: int = 0,
) -> DataFrame:
    """Dense position of each row within its group, without one task sorting a whole group.

    ``split`` cuts a group into consecutive ranges: it must not be null and must never decrease
    along the order; ``keys`` must not be null either. Rows are ranked inside their range only; the
    offset of a range comes from the row counts of the ranges before it, which is a small table.
    The join keeps the partitioning of the ranking window, so the rows themselves move once.
    """
    on = [*keys, "_split"]
    parts = df.withColumn("_split", split)
    counts = parts.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    before = (
        Window.partitionBy(*keys).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(*on, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*on).orderBy(*order)
    ranked = parts.withColumn("_local", F.row_number().over(local))
    position = (F.col("_offset") + F.col("_local") - 1 + F.lit(start)).cast("bigint")
    return ranked.join(offsets, on, "inner").select(*df.columns, position.alias(name))


def ranked_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, start: int = 0, label: str = "ranked"
) -> DataFrame:
    """Dense position of each row within its group, however uneven groups, ranges and prefixes are.

    Rows are dealt by ranges of the whole order (keys first), sorted within each range and staged with
    their place in it. A group then spans some consecutive ranges, and the rows of its ranges before
    give the offset: a table of one row per group and range. Only rows that agree in keys and order
    have to share a range, so the order should end in something that tells rows apart. Without keys
    the whole table is one group.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = [*[F.col(k).asc() for k in keys], *order]
    placed = df.repartitionByRange(n, *whole).sortWithinPartitions(*whole)
    placed = stage(placed.withColumn("_at", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("_part", F.shiftright("_at", 33))  # the upper bits number the range
    names = [f"_key{i}" for i in range(len(keys))]
    runs = placed.groupBy(*[F.col(k).alias(x) for k, x in zip(keys, names)], F.col("_part").alias("_range"))
    runs = runs.agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*(names or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).drop("_rows", "_first")
    same = F.col("_part") == F.col("_range")
    for k, x in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(x))
    position = (F.col("_at") + F.col("_offset") + F.lit(start)).cast("bigint")
    return placed.join(runs, same).select(*df.columns, position.alias(name))


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    salt_from: Sequence[str],
    how: str = "left",
    salts: int = 16,
) -> DataFrame:
    """Equi-join whose keys may be very uneven on the ``big`` side.

    Rows of ``big`` with one key are spread over ``salts`` tasks by a hash of ``salt_from``; the
    rows of ``small`` (unique or few per key) are repeated once per salt. They meet the salts in a cross
    join: of exploded rows Spark's estimates know nothing, and a table far too large for the driver would
    look small enough to broadcast.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_from), F.lit(salts)).cast("int"))
    every = small.sparkSession.range(salts).select(F.col("id").cast("int").alias("_salt"))
    right = small.crossJoin(F.broadcast(every))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


BLOCK_ROWS = 1 << 16


def spread_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    salt_from: Sequence[str],
    how: str = "inner",
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Equi-join like ``salted_join`` for a ``small`` side of very many keys, few of them frequent.

    Only keys with more than ``rows`` rows in ``big`` are spread, and only their rows of ``small`` are
    repeated, once per ``rows`` rows. There are at most as many such keys as ``rows`` fits into ``big``, so
    that table may be broadcast. ``small`` never is, whatever its files or exploded rows make Spark think
    of its size. ``big`` is read twice and should be cheap. ``how="right"`` keeps rows of
    ``small`` without a partner once: frequent keys have partners, so their copies without one may go.
    """
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows)
    frequent = F.broadcast(counts.select(*keys, F.ceil(F.col("_n") / rows).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    left = big.join(frequent, list(keys), "left").withColumn("_salt", F.pmod(F.xxhash64(*salt_from), salts).cast("int"))
    right = small.join(frequent, list(keys), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    right = right.withColumnRenamed("_salts", "_copies").hint("merge")
    if how != "right":
        return left.drop("_salts").join(right.drop("_copies"), [*keys, "_salt"], how).drop("_salt")
    joined = left.withColumn("_met", F.lit(True)).drop("_salts").join(right, [*keys, "_salt"], how)
    return joined.filter(F.col("_met") | F.col("_copies").isNull()).drop("_salt", "_met", "_copies")


def block_join(
    rows: DataFrame, per_key: DataFrame, key: str, position: str, block: int = BLOCK_ROWS
) -> DataFrame:
    """Inner join of rows with the one row per key they need, however long a key is.

    Rows are joined in blocks of consecutive positions, so no task gets more than ``block`` rows of
    one key; the other side is repeated once per block of its key. How many blocks a key has comes
    from a narrow aggregation with map-side combine.
    """
    number = F.floor(F.col(position) / F.lit(block))
    extents = rows.groupBy(key).agg(F.max(number).alias("_last"))
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last")))
    right = per_key.join(extents, key, "inner").withColumn("_block", blocks).drop("_last")
    return rows.withColumn("_block", number).join(right, [key, "_block"], "inner").drop("_block")

"""Vectors packed to shards and blocks of queries, and the best rows of all shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 4096
BLOCK_ROWS = 256


def usable_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``row, id, vec, dim``: the vectors as doubles, one row per row, also where a key is repeated.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do null keys.
    ``row`` tells rows with one key apart.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))  # NaN is above infinity
    rows = rows.filter(F.col("id").isNotNull() & (F.size("vec") > 0) & finite)
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "vec", F.size("vec").alias("dim"))


def _packed(rows: DataFrame, size: int, number: str, make: Callable[[np.ndarray, np.ndarray], list[bytes]], names: list[str]) -> DataFrame:
    """``dim, number, names …``: rows dealt by a hash of their number into groups of about ``size``."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.withColumn(number, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        dim, at = table.column("dim")[0], table.column(number)[0]
        ids = table.column("id").to_numpy()
        flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        blobs = make(ids[order], flat.reshape(len(ids), -1)[order])
        columns = [pa.array([dim.as_py()], pa.int32()), pa.array([at.as_py()], pa.int32())]
        return pa.table([*columns, *[pa.array([b], pa.binary()) for b in blobs]], names=["dim", number, *names])

    schema = f"dim int, {number} int, " + ", ".join(f"{n} binary" for n in names)
    return dealt.select("dim", number, "id", "vec").groupBy("dim", number).applyInArrow(run, schema)


def shards(rows: DataFrame, make: Callable[[np.ndarray, np.ndarray], list[bytes]], names: list[str], size: int = SHARD_ROWS) -> DataFrame:
    return _packed(rows, size, "shard", make, names)


def query_blocks(rows: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    return _packed(rows, size, "block", lambda ids, vecs: [ids.tobytes(), vecs.tobytes()], ["q_ids", "q_vecs"])


def search(
    packed: DataFrame, blocks: DataFrame, k: int, names: list[str], kind: str, find: Callable[[list[bytes], np.ndarray, np.ndarray], tuple]
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows over all shards for every query.

    Every block of queries visits every shard of its dimension: blocks are repeated once per shard, and a
    row of the join is one shard and one block. What leaves it is at most ``k`` rows per query.
    ``find`` gives query ids, row ids and scores of a shard and a block.
    """
    places = packed.select("dim", "shard")
    visits = blocks.join(places.groupBy("dim").agg(F.collect_list("shard").alias("_shards")), "dim")
    visits = visits.select("dim", F.explode("_shards").alias("shard"), "q_ids", "q_vecs")
    pairs = packed.join(visits, ["dim", "shard"]).select("dim", *names, "q_ids", "q_vecs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, *blobs, ids, vecs = (c[row].as_py() for c in batch.columns)
                queries = np.frombuffer(vecs, dtype="f8").reshape(-1, dim)
                found = find(blobs, np.frombuffer(ids, dtype="i8"), queries)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, f"query_id long, vec_id long, score {kind}")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def without_spare_copies(ids: np.ndarray, vecs: np.ndarray, k: int) -> np.ndarray:
    """Positions of rows (sorted by id) without those that cannot be among the ``k`` best of any query.

    A query takes the smallest ids first among equal vectors, and none of its own id. So a row is spare
    if ``k`` equal rows come before it, not counting those of one id.
    """
    _, group = np.unique(vecs, axis=0, return_inverse=True)
    group = group.ravel()
    order = np.argsort(group, kind="stable")
    sorted_ = group[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    sizes = np.diff(np.r_[first, len(sorted_)])
    rank = np.arange(len(sorted_)) - np.repeat(first, sizes)
    # The most rows that one id has in each group.
    named = ids[order]
    runs = np.flatnonzero(np.r_[True, (sorted_[1:] != sorted_[:-1]) | (named[1:] != named[:-1])])
    most = np.zeros(len(first), dtype=np.int64)
    np.maximum.at(most, sorted_[runs], np.diff(np.r_[runs, len(sorted_)]))
    return np.sort(order[rank < k + most[sorted_]])

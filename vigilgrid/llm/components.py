"""Connected components of an edge table, in joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _signature(edges: DataFrame) -> tuple:
    """Number and checksum of the edges: two numbers, whatever the size of the table."""
    mixed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mixed)).first())


def _hook_larger(edges: DataFrame) -> DataFrame:
    """Every node above ``u`` that touches ``u`` is linked to the smallest node around ``u``."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m"))
    least = least.select("u", F.least("u", "_m").alias("_m"))
    higher = both.filter(F.col("v") > F.col("u")).join(least, "u")
    return higher.select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()


def _hook_smaller(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of ``u``, and ``u``, are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m"))
    across = edges.join(least, "u").filter(F.col("v") != F.col("_m"))
    across = across.select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return across.union(least.select("u", F.col("_m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str, label: str = "edges", max_rounds: int = 100) -> DataFrame:
    """``node, component`` for every node of an edge other than the smallest of its component.

    ``component`` is the smallest node reachable. Rounds of two hooking steps (larger neighbours, then
    smaller ones, to the smallest node around) until nothing changes: a logarithmic number in
    practice. Neighbours are never collected; minima are combined on the map side and the join on a
    hot node can be split. Each round is a written table, so a lost executor repeats one round at
    most and the plan stays short. Null ends and loops are ignored.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    ends = ends.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
    current = stage(ends.distinct(), f"{label}-0")
    seen = _signature(current)
    if not seen[0]:
        return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for i in range(1, max_rounds + 1):
        current = stage(_hook_smaller(_hook_larger(current)), f"{label}-{i}")
        now = _signature(current)
        if now == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

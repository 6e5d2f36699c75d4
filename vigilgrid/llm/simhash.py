"""SimHash fingerprints and exact search for all pairs of them within a radius, tile against tile.

Fingerprint: ``words`` times 64 bits; a bit is set if it is set in over half of the shingle hashes
(XXH64 of the UTF-8 text, seed 42; further words mix that hash again).

Search: the distinct fingerprints are laid out in cells by their population counts and the cells are
cut into tiles of at most about ``TILE`` fingerprints. Two fingerprints within radius r differ by r at
most in the sum, over any segments of the bits, of the differences of their population counts. So a
tile meets only the tiles of cells that this bound allows; all other pairs of tiles are skipped. For a
small radius four segments are counted, for a wide one the whole fingerprint in bands. Each pair of
tiles is compared whole with exclusive-or and bit counts in numpy. What leaves a pair of tiles is not
its links but a star per group of linked fingerprints, so a group of copies costs as many rows as it
has members, not their square; no link between different texts is lost for the components.

The work per fingerprint still grows with their number, as it must for a comparison of all that the
bounds allow; its constant is a nanosecond for a pair and 64 bits. Pairs of tiles are dealt by the cell
and by blocks of tiles on either side, so a crowded cell is the work of many tasks.

Defined results: a null or empty text has the fingerprint zero, linked like any other; rows are
taken as they are, so a repeated ``doc_id`` gives a row each and all its rows share a component; rows
without ``doc_id`` keep their fingerprint and have no component; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.relational import first_per_group
from .common import append_values, fresh_name, map_texts, numbers, partitions, stage
from .components import components

SEED = 42
TILE = 2048
ROWS = 128  # rows of a tile that are compared at one time
FINE_RADIUS = 4  # up to here four segments are counted
LEADING_BITS = 26  # of the radius, for each word that is compared for all pairs (three sums of bits fit a byte)
MEETING = 8  # tiles of a cell, on either side, whose pairs are one task's

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_OFFSETS = (256 * np.arange(8)).astype(np.uint16)


def shingle_hashes(text: str, width: int) -> list[int]:
    """XXH64 of every run of ``width`` words; of the whole sequence if it is shorter; none without words.

    Words are what ASCII white space separates, A-Z in lower case.
    """
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(line, SEED)]
    starts = [0]
    for word in words[:-1]:
        starts.append(starts[-1] + len(word) + 1)
    ends = [start - 1 for start in starts[width:]] + [len(line)]
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends)]


def _mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Another 64 bits from a hash (SplitMix64); the hash itself for number 0."""
    if not number:
        return hashes
    with np.errstate(over="ignore"):
        z = hashes + np.uint64(number) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes; as a signed number."""
    if not len(hashes):
        return 0
    cells = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _OFFSETS
    counts = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(
    df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, words: int = 1, distinct: bool = False
) -> DataFrame:
    """``key, w0 … , shingles``: fingerprint words as signed numbers and the number of shingles.

    ``distinct`` counts a shingle once per text instead of with its repeats.
    """
    fields = [(name, LongType()) for name in [*[f"w{i}" for i in range(words)], "shingles"]]
    return map_texts(df, key, text, fields, lambda: _printer(width, words, distinct))


def _printer(width: int, words: int, distinct: bool):
    def many(texts: list) -> tuple:
        out = [[] for _ in range(words + 1)]
        for value in texts:
            hashes = np.array(shingle_hashes(value, width), dtype=np.uint64)
            counted = np.unique(hashes) if distinct else hashes
            for i in range(words):
                out[i].append(majority(_mixed(counted, i)))
            out[words].append(len(counted))
        return tuple(out)

    return many


def _axes(words: int, radius: int) -> tuple[list[Column], list[tuple[int, ...]]]:
    """Coordinates of a fingerprint's cell, and the half of the neighbouring cells that a pair may span."""
    if radius <= FINE_RADIUS and words == 1:
        segments, width = 4, 1
        counts = [F.bit_count(F.shiftrightunsigned("w0", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    else:
        segments, width = 1, radius + 1
        total = F.bit_count("w0")
        for i in range(1, words):
            total = total + F.bit_count(f"w{i}")
        counts = [total]
    axes = [F.floor(c / F.lit(width)).cast("int") for c in counts]

    def least(step: int) -> int:
        return max(0, (abs(step) - 1) * width + 1) if step else 0

    reach = range(-radius, radius + 1) if width == 1 else range(-1, 2)
    steps = [s for s in product(reach, repeat=segments) if sum(map(least, s)) <= radius]
    zero = (0,) * len(axes)
    return axes, [s for s in steps if s >= zero]


def _tiles(groups: DataFrame, axes: list[Column], words: int) -> DataFrame:
    """One row per tile: its cell, its number in the cell, and its fingerprints."""
    placed = groups.withColumn("cell", F.array(*axes))
    counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    tile = F.pmod(F.xxhash64("rep"), F.ceil(F.col("_n") / F.lit(TILE))).cast("int")
    columns = ["rep", *[f"w{i}" for i in range(words)]]
    # Bounded: 17 ** 4 cells of four segments, or the few bands of a wide radius.
    return (
        placed.join(F.broadcast(counts), "cell")
        .groupBy("cell", tile.alias("tile"))
        .agg(F.collect_list(F.struct(*columns)).alias("items"))
    )


def _unpacked(cell: pa.Scalar, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Representatives and fingerprint words of a tile."""
    items = cell.values
    bits = np.stack([numbers(items.field(f"w{i}"), "i8") for i in range(words)]).view(np.uint64)
    return numbers(items.field("rep"), "i8"), bits


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within ``radius`` bits, a few rows of ``a`` at a time.

    ``a`` and ``b`` are arrays of 64-bit words by fingerprint. All pairs are compared on the first words,
    as many as let the distance of unlike texts (half of their bits) exceed the radius; as a part of the
    distance they exclude most pairs, and the other words decide on the rest.
    """
    leading = min(len(a), 3, 1 + radius // LEADING_BITS)
    for start in range(0, a.shape[1], ROWS):
        first = np.bitwise_count(a[0, start : start + ROWS, None] ^ b[0][None, :])
        for word in range(1, leading):
            first += np.bitwise_count(a[word, start : start + ROWS, None] ^ b[word][None, :])
        i, j = np.nonzero(first <= radius)
        if len(a) > leading and len(i):
            total = first[i, j].astype(np.int64)
            for word in range(leading, len(a)):
                total += np.bitwise_count(a[word, start + i] ^ b[word, j])
            near = total <= radius
            i, j = i[near], j[near]
        yield start + i, j


class Forest:
    """Groups of positions that pairs have joined; the root of a group is its smallest position."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(self.root, high, low)
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _meeting(tiles: DataFrame, steps: list[tuple[int, ...]]) -> DataFrame:
    """``_items, items, own``: every pair of tiles whose cells are a step apart, once; ``own`` with itself.

    A tile goes to each cell that it meets, once for each block of ``MEETING`` tiles there, and the tiles
    there once for each such block of those that come, so a task has the pairs of two blocks.
    """
    offsets = F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps])
    moved = F.transform(offsets, lambda s: F.zip_with(F.col("cell"), s, lambda x, y: x + y))
    # Bounded: one row per cell.
    last = F.floor(F.max("tile") / F.lit(MEETING)).cast("int")
    there = tiles.groupBy(F.col("cell").alias("_at")).agg(last.alias("_blocks"))
    places = tiles.select(F.explode(moved).alias("_at"), "tile")
    coming = places.groupBy("_at").agg(last.alias("_comings")).withColumnRenamed("_at", "cell")
    left = tiles.select(
        F.explode(moved).alias("_at"), F.col("cell").alias("_cell"), F.col("tile").alias("_tile"), F.col("items").alias("_items")
    )
    left = left.join(F.broadcast(there), "_at").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks"))))
    left = left.withColumn("_coming", F.floor(F.col("_tile") / F.lit(MEETING)).cast("int"))
    right = tiles.join(F.broadcast(coming), "cell").withColumn("coming", F.explode(F.sequence(F.lit(0), F.col("_comings"))))
    right = right.withColumn("block", F.floor(F.col("tile") / F.lit(MEETING)).cast("int"))
    n = 4 * partitions(tiles.sparkSession)
    same = (F.col("_cell") == F.col("cell")) & (F.col("_tile") > F.col("tile"))
    at = (F.col("_at") == F.col("cell")) & (F.col("_block") == F.col("block")) & (F.col("_coming") == F.col("coming"))
    pairs = left.repartition(n, "_at", "_block", "_coming").join(right, at).filter(~same)
    return pairs.select("_items", "items", ((F.col("_cell") == F.col("cell")) & (F.col("_tile") == F.col("tile"))).alias("own"))


def links(groups: DataFrame, radius: int, words: int = 1) -> DataFrame:
    """``a, b``: a star of edges between representatives for every linked group within a pair of tiles."""
    axes, steps = _axes(words, radius)
    pairs = _meeting(stage(_tiles(groups, axes, words), "simhash-tiles"), steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.column(2)[row].as_py()
                one = _unpacked(batch.column(0)[row], words)
                other = one if own else _unpacked(batch.column(1)[row], words)
                (reps_a, a), (reps_b, b) = one, other
                reps = reps_a if own else np.concatenate([reps_a, reps_b])
                shift = 0 if own else len(reps_a)
                forest = Forest(len(reps))
                for i, j in close_pairs(a, b, radius):
                    forest.join(i, j + shift)
                at = np.flatnonzero(forest.root != np.arange(len(reps)))
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reps[at]), pa.array(reps[forest.root[at]])], names=["a", "b"]
                    )

    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 3,
    radius: int = 2,
    words: int = 1,
    distinct: bool = False,
) -> DataFrame:
    """``key, w0 …, component_id``: fingerprints of all rows and the smallest key reachable over links.

    Equal fingerprints become one representative (their smallest key) before the search, so exact
    copies, however many, cost one row.
    """
    group = columns = [f"w{i}" for i in range(words)]
    found = fingerprints(df, key, text, width, words, distinct)
    prints = stage(found.withColumnRenamed(key, "_key"), "simhash-prints")
    groups = prints.filter(F.col("_key").isNotNull()).groupBy(*group).agg(F.min("_key").cast("long").alias("rep"))
    groups = stage(groups, "simhash-groups")
    found = components(links(groups, radius, words), "a", "b", "simhash-edges")
    ids = groups.join(found, groups["rep"] == found["node"], "left")
    ids = ids.select(*group, F.coalesce("component", "rep").alias("component_id"))
    ids = ids.select(*[F.col(c).alias(f"_{c}") for c in group], "component_id")
    same = [F.col(c) == F.col(f"_{c}") for c in group]
    joined = prints.join(ids, same, "left")
    component = F.when(F.col("_key").isNotNull(), F.col("component_id"))
    return joined.select(F.col("_key").alias(key), *columns, component.alias("component_id"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """Rows of ``df`` without the near copies: of each group of linked fingerprints one row.

    That is the row with the smallest key, then the smallest fingerprint; of rows that agree in both
    the one whose text has the smallest hash. The groups are of fingerprints, not of keys: rows that
    repeat a key with different texts are told apart, and each group keeps one. Rows without a key
    stay. Keys may have any type that can be ordered.
    """
    prints = stage(fingerprints(df, key, text, width).select(F.col(f"`{key}`").alias("_key"), "w0"), "simhash-prints")
    known = prints.filter(F.col("_key").isNotNull())
    groups = known.groupBy("w0").agg(F.min("_key").alias("_least")).withColumn("rep", F.col("w0"))
    groups = stage(groups, "simhash-groups")
    joined = components(links(groups.select("rep", "w0"), radius), "a", "b", "simhash-edges")
    placed = groups.join(joined, groups["rep"] == joined["node"], "left")
    component = F.coalesce("component", "rep").alias("_component")
    best = placed.groupBy(component).agg(F.min(F.struct("_least", "w0")).alias("_best"))
    # A row is found by its key alone, where that is not repeated; else its fingerprint decides.
    repeated = stage(known.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select("_key"), "simhash-repeated")
    best = stage(best.select(F.col("_best._least").alias("_kept"), F.col("_best.w0").alias("_print")), "simhash-kept")
    named = F.col(f"`{key}`")
    found = df.join(best.select("_kept").distinct(), named == F.col("_kept"), "left_semi")
    single = found.join(repeated, named == F.col("_key"), "left_anti")
    several = found.join(repeated, named == F.col("_key"), "left_semi")
    name = fresh_name(df, "_fingerprint")
    several = append_values(several, text, [(name, LongType())], lambda: _first(_printer(width, 1, False)))
    several = several.join(best, (named == F.col("_kept")) & (F.col(name) == F.col("_print")), "left_semi")
    hashed = fresh_name(several, "_hash")
    several = several.withColumn(hashed, F.xxhash64(F.col(f"`{text}`")))
    several = first_per_group(several, [f"`{key}`", name], [F.col(hashed).asc()]).drop(name, hashed)
    return single.unionByName(several).unionByName(df.filter(named.isNull()))


def _first(function):
    return lambda values: function(values)[:1]

"""Phrases that occur far more often than their parts suggest, from exact counts of all runs of words.

A phrase of m + 1 words is a pair of phrases of m words that overlap in all but one word, and it can be
frequent only if both are. So one step is repeated: units (first words, then phrases) are numbered by
frequency, every place of a text holds the number of the unit that starts there or none, and adjacent
numbers are counted as pairs. The frequent pairs are the units of the next step, ranked again.

Pairs are counted where the texts are, by tiles of ``SIDE`` x ``SIDE`` numbers. As numbers follow
frequency, most pairs fall into few tiles near the origin (the first ``CORNER`` in either direction).
Those that are dense are counted by direct address, with one bincount over their cells. The pairs of
all other tiles are sorted as coordinates and counted in runs. Spark adds up the counts of all tasks,
after combining them within each.

Numbers are looked up in a head of at most ``HEAD`` units, the most frequent ones, which tasks hold in
memory. Where there are more units, the rest is looked up by a join of the distinct unknown units of
each block of texts, in which no unit of the tail is frequent. No text is exchanged in either case.

Defined results: null texts count as empty, a null language as ``und``; repeated rows count as often as
they occur; other columns are ignored; a table without frequent phrases gives an empty one. Words and
phrases are compared by their bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relational import first_per_group, ranked_position, salted_join
from .common import stage, stage_small

LEAST = 100  # occurrences of a phrase
LONGEST = 5  # words
TOP = 2000  # phrases of a language
HEAD = 500_000  # units whose numbers every task holds
SIDE_BITS = 8
SIDE = 1 << SIDE_BITS
CORNER = 64  # tiles in either direction that may be dense
DENSE = SIDE * SIDE // 4  # pairs of a tile from which on it is counted by direct address
PAIRS = 1 << 20  # counted at one time
BLOCK = 1 << 13  # places of a block of texts, unless one text has more; small, as a page of a file holds 100 blocks or more
SENT_ROWS = 1 << 14  # of a batch that leaves a task
COUNTED_WORDS = 200_000  # distinct words that a task counts at one time
SALTS = 64  # parts of a language's phrases that are ranked on their own first

_BREAK = b"."
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _BREAK * 10)


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in order, with a full stop between two pieces; no word holds one."""
    return text.lower().translate(_BREAKS).replace(_BREAK, b" . ").split()


def _source(docs: DataFrame, text: str, lang: str) -> DataFrame:
    named = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und"))
    return docs.select(named.alias("lang"), F.col(f"`{text}`").cast("binary").alias("text"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for at, lang in enumerate(batch.column(0).to_pylist()):
            yield lang, batch.column(1)[at].as_py() or b""


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, word, n`` over all texts; the row without a word has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flushed() -> pa.RecordBatch:
            names = [name for name, found in counts.items() for _ in range(len(found))]
            words = [word for found in counts.values() for word in found]
            columns = [pa.array(names, pa.string()), pa.array(words, pa.binary()).cast(pa.string())]
            numbers = pa.array([n for found in counts.values() for n in found.values()], pa.int64())
            counts.clear()
            return pa.RecordBatch.from_arrays([*columns, numbers], names=["lang", "word", "n"])

        for name, value in _texts(batches):
            words = tokens(value)
            found = counts.setdefault(name, Counter())
            found.update(words)
            found[None] += len(words) - found.pop(_BREAK, 0)
            if sum(map(len, counts.values())) > COUNTED_WORDS:
                yield flushed()
        yield flushed()

    parts = _source(docs, text, lang).mapInArrow(run, "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _corner_counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Which pairs lie in dense tiles, and the counts of those by direct address."""
    reach = CORNER << SIDE_BITS
    near = (a < reach) & (b < reach)
    tile = np.where(near, (a >> SIDE_BITS) * CORNER + (b >> SIDE_BITS), 0)
    dense = np.flatnonzero(np.bincount(tile[near], minlength=CORNER * CORNER) >= DENSE)
    place = np.full(CORNER * CORNER, -1, dtype=np.int64)
    place[dense] = np.arange(len(dense))
    inside = near & (place[tile] >= 0)
    x, y = a[inside] & (SIDE - 1), b[inside] & (SIDE - 1)
    cells = np.bincount(place[tile[inside]] << (2 * SIDE_BITS) | x << SIDE_BITS | y, minlength=len(dense) * SIDE * SIDE)
    seen = np.flatnonzero(cells)
    tile, x, y = dense[seen >> (2 * SIDE_BITS)], seen >> SIDE_BITS & (SIDE - 1), seen & (SIDE - 1)
    return inside, (tile // CORNER << SIDE_BITS | x, tile % CORNER << SIDE_BITS | y, cells[seen])


def _sorted_counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts of pairs as sorted coordinates; in one word where numbers have 31 bits."""
    if not len(a) or max(int(a.max()), int(b.max())) < 1 << 31:
        pairs, n = np.unique(a.astype(np.int64) << 32 | b, return_counts=True)
        return pairs >> 32, pairs & 0xFFFFFFFF, n
    pairs, n = np.unique(np.stack([a, b]), axis=1, return_counts=True)
    return pairs[0], pairs[1], n


def count_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers and how often they occur."""
    inside, dense = _corner_counts(a, b)
    sparse = _sorted_counts(a[~inside], b[~inside])
    return tuple(np.concatenate(column).astype(np.int64) for column in zip(dense, sparse))


def number_type(units: DataFrame) -> str:
    """Bytes of a number in the blocks: four, unless the units need more."""
    return "<i4" if units.count() < (1 << 31) - 1 else "<i8"


def pair_counts(blocks: DataFrame, kind: str) -> DataFrame:
    """``a, b, n``: pairs of adjacent numbers in all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            counted = count_pairs(*[np.concatenate(side) for side in zip(*held)])
            for start in range(0, len(counted[0]), SENT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(column[start : start + SENT_ROWS]) for column in counted], names=["a", "b", "n"])

        for batch in batches:
            for value in batch.column(0):
                ids = np.frombuffer(value.as_buffer(), dtype=kind)
                for start in range(0, len(ids) - 1, PAIRS):
                    a, b = ids[start : start + PAIRS], ids[start + 1 : start + PAIRS + 1]
                    a = a[: len(b)]
                    both = (a >= 0) & (b >= 0)
                    held.append((a[both], b[both]))
                    size += len(held[-1][0])
                    if size >= PAIRS:
                        yield from flushed()
                        held, size = [], 0
        if size:
            yield from flushed()

    return blocks.select("ids").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def numbered(units: DataFrame, keys: list[str], least: int, label: str) -> DataFrame:
    """Units that occur ``least`` times or more, numbered from 0 by frequency."""
    frequent = stage_small(units.filter(F.col("n") >= least), f"{label}-frequent")
    return stage(ranked_position(frequent, [], [F.col("n").desc(), *map(F.col, keys)], "id", label=f"{label}-ranks"), label)


def _with_tail(found: DataFrame, units: DataFrame, keys: list[str], head: int, kind: str, label: str) -> DataFrame:
    """Blocks whose unknown units are looked up among the units beyond the head."""
    found = stage_small(found.withColumn("block", F.monotonically_increasing_id()), f"{label}-open")
    asked = found.select("block", F.posexplode("unknown").alias("at", "unit")).select("block", "at", "unit.*")
    tail = units.filter(F.col("id") >= head).select(*keys, "id")
    known = asked.join(tail, keys).groupBy(F.col("block").alias("_block"))
    known = known.agg(F.collect_list(F.struct("at", "id")).alias("known"))  # at most the distinct units of one block
    size = F.size("unknown").alias("size")
    filled = found.join(known, F.col("block") == F.col("_block"), "left").select("ids", "known", size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = np.frombuffer(batch.column(0)[row].as_buffer(), dtype=kind).copy()
                numbers = np.full(batch.column(2)[row].as_py() + 1, -1, dtype=kind)
                for unit in batch.column(1)[row].as_py() or []:
                    numbers[unit["at"]] = unit["id"]
                open_ = ids < -1
                ids[open_] = numbers[-2 - ids[open_]]
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], names=["ids"])

    return filled.mapInArrow(run, "ids binary")


_WORD = pa.struct([("lang", pa.string()), ("word", pa.string())])
_PAIR = pa.struct([("a", pa.int64()), ("b", pa.int64())])


def text_blocks(docs: DataFrame, words: DataFrame, text: str, lang: str, head: int) -> DataFrame:
    """``ids``: blocks of whole texts as numbers of words; -1 for a rare word and between pieces and texts."""
    kind = number_type(words)
    more = words.filter(F.col("id") >= head).limit(1).count() > 0
    tables: dict[str, dict[bytes, int]] = {}
    listed = words.filter(F.col("id") < head).select("lang", F.col("word").cast("binary"), "id").toArrow()
    for name, word, number in zip(*(column.to_pylist() for column in listed.columns)):
        tables.setdefault(name, {})[word] = number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        unknown: dict[tuple[str, bytes], int] = {}

        def flushed() -> pa.RecordBatch:
            listed = [{"lang": name, "word": word.decode()} for name, word in unknown]
            block = np.array(held, dtype=kind).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.binary()), pa.array([listed], pa.list_(_WORD))], names=["ids", "unknown"])

        for name, value in _texts(batches):
            words_ = tokens(value)
            if held and len(held) + len(words_) > BLOCK:
                yield flushed()
                held, unknown = [], {}
            known = tables.get(name, {})
            if more:
                for word in words_:
                    number = -1 if word == _BREAK else known.get(word)
                    held.append(unknown.setdefault((name, word), -2 - len(unknown)) if number is None else number)
            else:
                held.extend([known.get(word, -1) for word in words_])
            held.append(-1)
        if held:
            yield flushed()

    found = _source(docs, text, lang).mapInArrow(run, "ids binary, unknown array<struct<lang:string,word:string>>")
    done = _with_tail(found, words, ["lang", "word"], head, kind, "phrase-words") if more else found.select("ids")
    return stage_small(done, "phrase-blocks-1")


def pair_blocks(blocks: DataFrame, old_kind: str, pairs: DataFrame, head: int, label: str) -> DataFrame:
    """The blocks as numbers of the frequent pairs that start at each place."""
    kind = number_type(pairs)
    more = pairs.filter(F.col("id") >= head).limit(1).count() > 0
    rows = pairs.filter(F.col("id") < head).select("a", "b", "id").toArrow().sort_by([("a", "ascending"), ("b", "ascending")])
    a, b, ids = (rows.column(name).to_numpy() for name in ("a", "b", "id"))
    firsts, start = np.unique(a, return_index=True)
    width = int(b.max()) + 2 if len(b) else 1
    # A pair's key is the place of its first number among all first numbers, and its second number.
    keys = np.repeat(np.arange(len(firsts)), np.diff(np.r_[start, len(a)])) * width + b

    def look_up(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(firsts, x), max(len(firsts) - 1, 0))
        if not len(firsts):
            return np.full(len(x), -1, dtype=np.int64)
        key = at * width + np.minimum(y, width - 1)
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((firsts[at] == x) & (keys[place] == key), ids[place], -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                old = np.frombuffer(value.as_buffer(), dtype=old_kind)
                new = np.full(len(old), -1, dtype=np.int64)
                at = np.flatnonzero((old[:-1] >= 0) & (old[1:] >= 0))
                new[at] = look_up(old[at], old[at + 1])
                listed = []
                if more:
                    at = at[new[at] < 0]
                    distinct, place = np.unique(np.stack([old[at], old[at + 1]], axis=1), axis=0, return_inverse=True)
                    new[at] = -2 - place.ravel()
                    listed = [{"a": x, "b": y} for x, y in distinct.tolist()]
                columns = [pa.array([new.astype(kind).tobytes()], pa.binary()), pa.array([listed], pa.list_(_PAIR))]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "unknown"])

    found = blocks.mapInArrow(run, "ids binary, unknown array<struct<a:bigint,b:bigint>>")
    done = _with_tail(found, pairs, ["a", "b"], head, kind, label) if more else found.select("ids")
    return stage_small(done, f"{label}-blocks")


def _described(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Phrases with their words and the counts of all their beginnings and endings, from the two units of each."""
    left = units.select(F.col("id").alias("a"), "lang", "total", F.col("phrase").alias("_left"), F.col("begins").alias("_begins"))
    right = units.select(F.col("id").alias("b"), F.col("last"), F.col("ends").alias("_ends"))
    both = salted_join(salted_join(pairs, left, ["a"], ["id"], "inner"), right, ["b"], ["id"], "inner")
    return both.select(
        "id", "lang", "total", "a", "b", "n", "last",
        F.concat_ws(" ", "_left", "last").alias("phrase"),
        F.concat("_begins", F.array("n")).alias("begins"),
        F.concat("_ends", F.array("n")).alias("ends"),
    )


def _best_cut() -> Column:
    """The cut with the lowest score, then the fewest words before it: floor(1000 * n * total / (l * r)), exactly.

    Decimals of 38 digits hold the products; ``div`` gives whole numbers without rounding.
    """

    def wide(value: Column) -> Column:
        return value.cast("decimal(19,0)")

    def cut(k: Column) -> Column:
        l, r = F.get("begins", k - 1), F.get("ends", F.size("ends") - k - 1)
        over = wide(F.col("n")) * wide(F.col("total")) * F.lit(1000).cast("decimal(4,0)")
        return F.struct(F.call_function("div", over, wide(l) * wide(r)).alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size("begins") - 1), cut))


def _outside(shorter: DataFrame, longer: DataFrame) -> DataFrame:
    """Phrases that no phrase with one word more holds as often; one with several more would be held by such a one."""
    held = longer.select(F.explode(F.array("a", "b")).alias("_id"), F.col("n").alias("_n"))
    held = held.groupBy("_id").agg(F.max("_n").alias("_n"))
    return shorter.join(held, (F.col("id") == F.col("_id")) & (F.col("_n") >= F.col("n")), "left_anti")


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    head: int = HEAD,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language."""
    told = F.col("word").isNull()
    counts = stage_small(word_counts(docs, text, lang).filter(told | (F.col("n") >= least)), "phrase-counts")
    words = numbered(counts.filter(~told), ["lang", "word"], least, "phrase-words")
    totals = counts.filter(told).select("lang", F.col("n").alias("total"))
    units = salted_join(words, totals, ["lang"], ["id"], "inner").select(
        "id", "lang", "total", F.col("word").alias("last"), F.col("word").alias("phrase"), F.array("n").alias("begins"), F.array("n").alias("ends")
    )
    blocks, kind = text_blocks(docs, words, text, lang, head), number_type(words)
    levels: list[DataFrame] = []
    for size in range(2, longest + 1):
        pairs = numbered(pair_counts(blocks, kind), ["a", "b"], least, f"phrase-pairs-{size}")
        units = stage(_described(pairs, units), f"phrases-{size}")
        levels.append(units)
        if pairs.isEmpty():
            break
        if size < longest:
            blocks, kind = pair_blocks(blocks, kind, pairs, head, f"phrase-pairs-{size}"), number_type(pairs)
    kept = [_outside(shorter, longer) for shorter, longer in zip(levels, levels[1:])] + levels[-1:]
    scored = reduce(DataFrame.unionByName, kept).withColumn("cut", _best_cut()).select("lang", "phrase", "n", "total", "cut.*")
    # Languages are few and phrases many: the best of each salt first.
    order = [F.col("score").desc(), F.col("n").desc(), F.col("phrase").asc()]
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = first_per_group(salted, ["lang", "_salt"], order, top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    best = best.withColumn("rank", rank).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score")

"""CSV files of any size, read in parallel although quoted cells may hold line breaks.

Where a record ends depends on all quotes before it. But what a piece of a file does to that is a small
function: from "outside quotes" or "inside quotes" at its start to one of the two at its end. The file
is cut into chunks of whole lines, each chunk gives its function and how many records start in it for
either start. Composing the functions along a file gives the true start of every chunk, and adding up
counts gives its first row number; both are window sums over one narrow row per chunk. Then each chunk
is decoded on its own. Records that cross chunks leave one fragment per chunk, which are put together.

The states follow ``csv.reader``: a quote opens only at the start of a cell, text after a closing quote
is kept, blank lines are rows without cells. A sheet that cannot be read (bytes that are not UTF-8, a
cell of more than ``MAX_CELL`` characters, a bare carriage return outside quotes) gives an error row
and no rows.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from .snapshots import key_below

CHUNK_BYTES = 1 << 22
MAX_CELL = csv.field_size_limit()  # of the reader, 131,072 characters
DECODED_ROWS = 4096

_FIELD = rb'(?:"[^"]*+(?:""[^"]*+)*+"(?:[^",][^,]*+)?+|[^",][^,]*+|)'
_OUTSIDE = re.compile(rb"%b(?:,%b)*+" % (_FIELD, _FIELD), re.DOTALL)
_INSIDE = re.compile(rb'[^"]*+(?:""[^"]*+)*+"(?:[^",][^,]*+)?+(?:,%b)*+' % _FIELD, re.DOTALL)


def after_line(inside: bool, line: bytes) -> bool:
    """Whether the text after a line is inside quotes, by whether its start is."""
    if b'"' not in line:
        return inside
    return (_INSIDE if inside else _OUTSIDE).fullmatch(line) is None


def effect(lines: list[bytes], inside: bool) -> tuple[bool, int, int]:
    """State after the lines, records that start in them, and lines that belong to a record from before."""
    started, carried, open_before = 0, 0, inside
    for line in lines:
        if open_before:
            carried += 1
        elif not inside:
            started += 1
        inside = after_line(inside, line)
        open_before = open_before and inside
    return inside, started, carried


def effects(lines: list[bytes]) -> tuple[tuple[bool, int, int], tuple[bool, int, int]]:
    """``effect`` from outside and from inside quotes; both go on as one where they meet."""
    out, started, in_, started_in, carried, open_before = False, 0, True, 0, 0, True
    for place, line in enumerate(lines, 1):
        carried += open_before
        started_in += not (open_before or in_)
        started += not out
        out, in_ = after_line(out, line), after_line(in_, line)
        open_before = open_before and in_
        if out == in_ and not open_before:
            end, more, _ = effect(lines[place:], out)
            return (end, started + more, 0), (end, started_in + more, carried)
    return (out, started, 0), (in_, started_in, carried)


def _chunks(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``sheet_id, block, chunk, data``: consecutive lines of a split of a file, about ``CHUNK_BYTES`` each."""
    lines = (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .option("lineSep", "\n")
        .text(path)
        .select(
            key_below(F.col("_metadata.file_path"), path).alias("sheet_id"),
            F.col("_metadata.file_block_start").alias("block"),
            F.concat("value", F.lit("\n")).cast("binary").alias("line"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number, held, size = None, 0, [], 0

        def flushed() -> pa.RecordBatch:
            columns = [pa.array([x]) for x in (place[0], place[1], number)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([b"".join(held)[:-1]], pa.binary())], names=["sheet_id", "block", "chunk", "data"])

        for batch in batches:
            sheets, blocks, column = batch.columns
            # The lines of a batch lie one after the other, so consecutive ones are taken as one piece.
            at = np.frombuffer(column.buffers()[1], "int64" if pa.types.is_large_binary(column.type) else "int32")
            at = at[column.offset : column.offset + len(column) + 1].astype("int64")
            data, start = memoryview(column.buffers()[2] or b""), 0
            ends = {n for x in (sheets, blocks) for n in pc.run_end_encode(x).run_ends.to_pylist()}
            for end in sorted(ends):
                here = (sheets[start].as_py(), blocks[start].as_py())
                if held and here != place:
                    yield flushed()
                    number, held, size = 0, [], 0
                place = here
                while start < end:
                    fits = min(int(np.searchsorted(at, at[start] + CHUNK_BYTES - size + 1, "right")) - 1, end)
                    if held and fits <= start:
                        yield flushed()
                        number, held, size = number + 1, [], 0
                        continue
                    fits = max(fits, start + 1)
                    held.append(bytes(data[at[start] : at[fits]]))
                    size += int(at[fits] - at[start])
                    start = fits
        if held:
            yield flushed()

    return lines.mapInArrow(run, "sheet_id string, block long, chunk long, data binary")


_FACTS = "sheet_id string, block long, chunk long, from_out boolean, from_in boolean, rows_out long, rows_in long, whole boolean, error string"


def _facts(chunks: DataFrame) -> DataFrame:
    """One row per chunk: where either start leads, the records started, and why it can't be read.

    ``whole``: inside quotes at its start, no record ends in it and it is longer than a cell may be.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sheet, block, chunk, data in zip(*(column.to_pylist() for column in batch.columns)):
                error, lines = None, data.split(b"\n")
                try:
                    data.decode("utf-8")
                except UnicodeDecodeError as reason:
                    error = f"not UTF-8: {reason.reason}"
                out, in_ = effects(lines)
                whole = in_[2] == len(lines) and in_[0] and len(data) > 4 * MAX_CELL
                row = (sheet, block, chunk, out[0], in_[0], out[1], in_[1], whole, error)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row[:-1]] + [pa.array([error], pa.string())], names=_FACTS_NAMES)

    return chunks.mapInArrow(run, _FACTS)


_FACTS_NAMES = [column.split()[0] for column in _FACTS.split(", ")]


def _plan(facts: DataFrame) -> DataFrame:
    """Start of every chunk: inside quotes or not, and the number of records started before it.

    A chunk sets the state, whatever it was, or swaps or keeps it. So the state before a chunk is what
    the last setting chunk says, swapped as often as chunks after that one swap.
    """
    before = Window.partitionBy("sheet_id").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("from_out") == F.col("from_in")
    swaps = (F.col("from_out") & ~F.col("from_in")).cast("int")
    swapped = F.coalesce(F.sum(swaps).over(before), F.lit(0))
    counted = facts.withColumn("_swapped", swapped)
    setting = F.last(F.when(sets, F.struct(F.col("from_out").alias("to"), F.col("_swapped").alias("at"))), True).over(before)
    counted = counted.withColumn("_set", setting)
    start = F.coalesce(F.col("_set.to").cast("int"), F.lit(0)) + F.col("_swapped") - F.coalesce(F.col("_set.at"), F.lit(0))
    placed = counted.withColumn("inside", F.pmod(start, F.lit(2)) == 1)
    rows = F.when(F.col("inside"), F.col("rows_in")).otherwise(F.col("rows_out"))
    first = F.coalesce(F.sum(rows).over(before), F.lit(0))
    too_long = F.when(F.col("inside") & F.col("whole"), F.lit(f"field larger than field limit ({MAX_CELL})"))
    return placed.select("sheet_id", "block", "chunk", "inside", first.alias("first_row"), F.coalesce("error", too_long).alias("error"))


def cells_of(record: str) -> list[str]:
    """Cells of one record without its line break; raises ``csv.Error`` for what the reader refuses."""
    if '"' not in record and "\r" not in record:
        cells = record.split(",") if record else []
        if len(record) > MAX_CELL and any(len(cell) > MAX_CELL for cell in cells):
            raise csv.Error(f"field larger than field limit ({MAX_CELL})")
        return cells
    found = list(csv.reader([record]))
    if len(found) > 1:
        raise csv.Error("more than one record")
    return found[0] if found else []


def _decoded(rows: list[tuple[str, int, int, str | None]]) -> pa.RecordBatch:
    """Cells of whole records; of a record in parts (order 0 and up) the text."""
    out = []
    for sheet, row, part, text in rows:
        cells, error = None, None
        if part < 0:
            try:
                cells = cells_of(text[:-1] if text.endswith("\r") else text)
            except csv.Error as reason:
                error = str(reason)
            text = None
        out.append((sheet, row, part, text, cells, error))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string())
    columns = [pa.array(list(values), kind) for values, kind in zip(zip(*out), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["sheet_id", "row_idx", "part", "text", "cells", "error"])


def _records(sheet: str, data: bytes, inside: bool, first: int, place: int) -> Iterator[tuple[str, int, int, str]]:
    """Records of a chunk by number, parts of those that cross its ends marked with its place."""
    row, held, crossing = first - 1 if inside else first, [], inside
    for line in data.decode("utf-8").split("\n"):
        inside = after_line(inside, line.encode())
        held.append(line)
        if not inside:
            yield sheet, row, place if crossing else -1, "\n".join(held)
            row, held, crossing = row + 1, [], False
    if held:
        yield sheet, row, place, "\n".join(held)


def decode(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """``sheet_id, row_idx, cells, error``: rows of all files; sheets that can't be read have errors among them."""
    # Cut once and dealt out: few large files would leave all later work to few tasks.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    chunks = stage(_chunks(spark, path, pattern).repartition(n, "sheet_id", "block", "chunk"), "csv-chunks")
    plan = stage(_plan(_facts(chunks)), "csv-plan")
    broken = plan.filter(F.col("error").isNotNull()).groupBy("sheet_id").agg(F.min("error").alias("error"))
    good = plan.join(broken, "sheet_id", "left_anti").drop("error")
    placed = chunks.join(good, ["sheet_id", "block", "chunk"]).select("sheet_id", "data", "inside", "first_row", "block", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sheet, data, inside, first, block, chunk in zip(*(column.to_pylist() for column in batch.columns)):
                held = []
                for record in _records(sheet, data, inside, first, block + chunk):
                    held.append(record)
                    if len(held) == DECODED_ROWS:
                        yield _decoded(held)
                        held = []
                if held:
                    yield _decoded(held)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _decoded(list(zip(*(column.to_pylist() for column in batch.columns))))

    schema = "sheet_id string, row_idx long, part long, text string, cells array<string>, error string"
    found = stage(placed.mapInArrow(run, schema), "csv-records")
    # A record has few parts: a chunk that lies within one cell is short, or its sheet is broken.
    parts = found.filter(F.col("part") >= 0).groupBy("sheet_id", "row_idx")
    texts = parts.agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("_parts"))
    joined = texts.select("sheet_id", "row_idx", F.lit(-1).cast("long").alias("part"), F.array_join(F.col("_parts.text"), "\n").alias("text"))
    columns = ["sheet_id", "row_idx", "cells", "error"]
    rows = found.filter(F.col("part") < 0).unionByName(joined.mapInArrow(join, schema)).select(*columns)
    empty = F.lit(None).cast("array<string>").alias("cells")
    return rows.unionByName(broken.select("sheet_id", F.lit(-1).cast("long").alias("row_idx"), empty, "error"))

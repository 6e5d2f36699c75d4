"""Chat formatting in Spark expressions only.

Turns of a conversation are collected as structs and sorted, adjacent turns of one role are merged by
array aggregation, and the pieces are concatenated. The template:

    ### Role:<newline>text<more>text of the next turn of that role</turn><newline>

Control strings inside texts and roles are escaped reversibly (``ESCAPES``), so a formatted conversation
can be read back turn by turn. The loss mask is a list of (start, length) in code points of the
formatted text: the texts of the roles that are learned, without headers and marks.

The work grows with the length of a conversation: blocks are slices of the sorted array from one change
of role to the next, and what has to be carried along (offsets) is carried in pieces of ``STEP``, so no
array is copied at every turn and no text is searched from its start for every span.

A conversation becomes one string, so its turns meet in one task; that is the output itself, not an
intermediate step, and Spark holds it up to 2 GB. Rows are grouped by conversation only.

Defined results: null text is empty, null role is ``""``; turns sort by number, then role, then text, a
null number first; repeated rows are turns of their own; a null conversation id is a conversation of
its own; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MORE, END, HEAD = "<more>", "</turn>", "###"
# In this order when escaping, in reverse when reading back: every escape begins with an ampersand.
ESCAPES = (("&", "&amp;"), (END, "&turn;"), (MORE, "&more;"), (HEAD, "&head;"), ("\n", "&line;"))
TEXT_ESCAPES = ESCAPES[:-1]
STEP = 256  # elements whose running sums are built in one array
SEGMENTS = (1 << 20, 1 << 12)  # code points of the parts in which spans are looked up


def escape(column: Column, pairs=TEXT_ESCAPES) -> Column:
    for raw, shown in pairs:
        column = F.replace(column, F.lit(raw), F.lit(shown))
    return column


def unescape(column: Column, pairs=TEXT_ESCAPES) -> Column:
    for raw, shown in reversed(pairs):
        column = F.replace(column, F.lit(shown), F.lit(raw))
    return column


def _header(role: Column) -> Column:
    """Role with a capital letter would lose the original, so it stands as it is."""
    return F.concat(F.lit(f"{HEAD} "), role, F.lit(":\n"))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunks(size: Column, step: int) -> Column:
    """First places of consecutive parts: 0, step, …; one part where there is nothing."""
    return F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(step))


def _spans(pieces: Column) -> Column:
    """(start, length) of the learned pieces; the offsets of parts of ``STEP`` pieces first, then those within."""
    zero = F.lit(0).cast("long")

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda n, p: n + F.length(p["piece"]))

    def within(part: Column, start: Column) -> Column:
        empty = F.array().cast("array<struct<start:bigint,length:bigint>>")

        def add(acc: Column, p: Column) -> Column:
            length = F.length(p["piece"]).cast("long")
            one = F.array(F.struct(acc["at"].alias("start"), length.alias("length")))
            return F.struct((acc["at"] + length).alias("at"), F.when(p["learned"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(part, F.struct(start.alias("at"), empty.alias("spans")), add, lambda acc: acc["spans"])

    parts = F.transform(_chunks(F.size(pieces), STEP), lambda i: F.slice(pieces, i + 1, STEP))

    def joined(cut: Column) -> Column:
        sums = F.transform(cut, total)
        begins = F.aggregate(sums, F.array(zero), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return _let(begins, lambda at: F.flatten(F.transform(cut, lambda part, k: within(part, F.get(at, k)))))

    return _let(parts, joined)


def format_chats(
    df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """``key, formatted, loss``: one string per conversation and the spans of the learned texts in it."""
    rows = df.select(
        F.col(f"`{key}`").alias("_key"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"),
            escape(F.coalesce(F.col(f"`{role}`"), F.lit("")), ESCAPES).alias("role"),
            escape(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text"),
        ).alias("_turn"),
    )
    turns = rows.groupBy("_key").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    # Where a role differs from the one before it a block starts; it is the slice up to the next start.
    places = F.sequence(F.lit(0), F.size("_turns") - 1)
    starts = F.filter(places, lambda i: (i == 0) | (F.get("_turns", i)["role"] != F.get("_turns", i - 1)["role"]))

    def block(start: Column, end: Column) -> Column:
        texts = F.transform(F.slice("_turns", start + 1, end - start), lambda t: t["text"])
        return F.struct(F.get("_turns", start)["role"].alias("role"), texts.alias("texts"))

    def blocks_of(begins: Column) -> Column:
        return F.transform(begins, lambda s, k: block(s, F.coalesce(F.get(begins, k + 1), F.size("_turns"))))

    blocks = turns.select("_key", _let(starts, blocks_of).alias("_blocks"))
    # Pieces of the output with their part in the loss, in order.
    learned_roles = F.array(*[escape(F.lit(r), ESCAPES) for r in learned])

    def pieces(block: Column) -> Column:
        counts = F.array_contains(learned_roles, block["role"])
        head = F.struct(_header(block["role"]).alias("piece"), F.lit(False).alias("learned"))
        more = F.struct(F.lit(MORE).alias("piece"), F.lit(False).alias("learned"))
        end = F.struct(F.lit(f"{END}\n").alias("piece"), F.lit(False).alias("learned"))
        texts = F.flatten(
            F.transform(block["texts"], lambda t, i: F.when(
                i == 0, F.array(F.struct(t.alias("piece"), counts.alias("learned")))
            ).otherwise(F.array(more, F.struct(t.alias("piece"), counts.alias("learned")))))
        )
        return F.concat(F.array(head), texts, F.array(end))

    cut = blocks.select("_key", F.flatten(F.transform("_blocks", pieces)).alias("_pieces"))
    spans = _let(F.col("_pieces"), _spans)
    whole = F.array_join(F.transform("_pieces", lambda p: p["piece"]), "")
    return cut.select(F.col("_key").alias(key), whole.alias("formatted"), spans.alias("loss"))


def read_turns(formatted: str | Column) -> Column:
    """Turns read back from a formatted conversation: array of (role, text), one per original turn."""
    column = F.col(formatted) if isinstance(formatted, str) else formatted
    blocks = F.split(column, f"{END}\n", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)  # nothing follows the last end

    def turns(block: Column) -> Column:
        colon = F.instr(block, F.lit(":\n"))
        role = unescape(F.substring(block, F.lit(len(HEAD) + 2), colon - F.lit(len(HEAD) + 2)), ESCAPES)
        texts = F.split(F.substr(block, colon + 2), MORE, -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learned_texts(formatted: str | Column, loss: str | Column) -> Column:
    """Original texts under the loss mask, in order."""
    column = F.col(formatted) if isinstance(formatted, str) else formatted
    spans = F.col(loss) if isinstance(loss, str) else loss
    large, small = SEGMENTS

    def segments(text: Column, size: int) -> Column:
        return F.transform(_chunks(F.length(text), size), lambda i: F.substring(text, i + 1, F.lit(size)))

    def found(parts: Column) -> Column:
        def one(span: Column) -> Column:
            first = F.floor(span["start"] / small).cast("int")
            last = F.floor((span["start"] + F.greatest(span["length"], F.lit(1)) - 1) / small).cast("int")
            near = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
            return unescape(F.substring(near, (span["start"] - first * F.lit(small) + 1).cast("int"), span["length"].cast("int")))

        return F.transform(spans, one)

    return _let(F.flatten(F.transform(segments(column, large), lambda part: segments(part, small))), found)

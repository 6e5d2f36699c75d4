"""Mixing sources to target weights by iterative proportional fitting, and sampling by the result.

Documents are summed to cells (source, language, topic). Raking multiplies the cells of each value of one
dimension by the factor that brings their token weight to its target, one dimension after the other,
until all marginals fit. A document is kept with the probability factor / largest factor: the largest
sample whose expected token weights have the target shares without repeating a document. The rarest cell
sets the size of that sample. With ``budget``, the share of all tokens that is expected to stay, it does
not: the probability is min(1, c * factor), with c such that the budget is met. Cells that reach 1 give all
they have, fall short of their targets by the rest, and the others take that rest by their factors.
``whole`` leaves no document out and meets the targets nevertheless: each stays once, and documents of values
that have less than their share are repeated. The mix is the smallest in which every value has its target share
and no value less than its own tokens; the tokens to be added are raked to what the targets are short of.
So its size is known before, however small a source is: the largest quotient of observed and target share, which
for tempered sources is at most the square root of their number.

Cells are a Spark table and are never collected; a sweep over the dimensions is a window
for each, and every few sweeps end in a written table, so plans stay short and a lost executor repeats
these at most. The driver sees one number per written table. Documents meet the cells in a join on the cell; Spark broadcasts the cells by measured
size or splits hot cells. Whether a document stays depends on its key and the seed only, so a repeated
run keeps the same documents.

Defined results: null values are categories of their own (``NO_VALUE``); targets are shares of a
dimension, values without one take a share of 0 if targets are given and tempered shares otherwise, and
targets of values that do not occur are spread over the others; cells without tokens get the factors of their values; rows
with equal keys share their fate; an empty table gives an empty sample. If targets contradict each
other, the sweeps end at ``MAX_SWEEPS`` and the last factors count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, stage

MAX_SWEEPS = 48
SWEEPS_PER_STEP = 4  # between two written tables
TOLERANCE = 1e-10
TEMPERATURE = 0.5
NO_VALUE = "\\N"


def uniform(key: str | Column, seed: int) -> Column:
    """Number in [0, 1) from the md5 of seed and key, the same in every engine."""
    column = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def cells(df: DataFrame, dims: Mapping[str, Column], tokens: Column) -> DataFrame:
    """``dims …, tokens``: token weight of every combination that occurs."""
    named = [F.coalesce(c.cast("string"), F.lit(NO_VALUE)).alias(d) for d, c in dims.items()]
    weight = F.coalesce(tokens.cast("double"), F.lit(0.0)).alias("tokens")
    return df.select(*named, weight).groupBy(*dims).agg(F.sum("tokens").alias("tokens"))


def tempered(table: DataFrame, dim: str, temperature: float = TEMPERATURE) -> DataFrame:
    """Target shares of a dimension: observed shares to the power of ``temperature``."""
    sums = table.groupBy(dim).agg(F.sum("tokens").alias("_n"))
    return sums.select(dim, F.pow("_n", F.lit(temperature)).alias("share"))


def _with_targets(
    table: DataFrame, dims: Sequence[str], targets: Mapping[str, DataFrame], temperatures: Mapping[str, float]
) -> DataFrame:
    for dim in dims:
        if dim in targets:
            given = targets[dim].select(F.col(dim).cast("string").alias(dim), F.col("share").cast("double").alias("share"))
        else:
            given = tempered(table, dim, temperatures.get(dim, TEMPERATURE))
        present = table.groupBy(dim).agg(F.sum("tokens").alias("_n")).join(given, dim, "left")
        share = F.when(F.col("_n") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0)
        present = present.select(dim, share.alias("share"))
        present = stage(present, f"mix-shares-{dim}")
        total = F.lit(present.agg(F.sum("share")).first()[0]).cast("double")
        table = table.join(present.select(dim, F.try_divide("share", total).alias(f"_t_{dim}")), dim, "left")
    return table


def rake(
    table: DataFrame,
    dims: Sequence[str],
    targets: Mapping[str, DataFrame] | None = None,
    temperatures: Mapping[str, float] | None = None,
) -> DataFrame:
    """``dims …, tokens, factor``: factors that bring all marginals of ``tokens`` to their targets.

    ``targets`` holds ``dim, share`` by dimension; a dimension without gets its observed shares to the
    power of its temperature (1 leaves them as they are).
    """
    whole = F.lit(table.agg(F.sum("tokens")).first()[0]).cast(table.schema["tokens"].dataType)
    current = stage(
        _with_targets(table, dims, targets or {}, temperatures or {}).withColumn("_whole", whole).withColumn("factor", F.lit(1.0)), "mix-start"
    )
    off = [
        F.max(F.abs(F.try_divide(f"_now_{d}", "_whole") - F.col(f"_t_{d}"))).alias(f"off_{d}") for d in dims
    ]
    for number in range(MAX_SWEEPS // SWEEPS_PER_STEP):
        step = current.select(*dims, "tokens", "_whole", *[f"_t_{d}" for d in dims], "factor")
        for d in list(dims) * SWEEPS_PER_STEP:
            now = F.sum(F.col("tokens") * F.col("factor")).over(Window.partitionBy(d))
            step = step.withColumn(f"_now_{d}", now)
            fitted = F.try_divide(F.col("factor") * F.col(f"_t_{d}") * F.col("_whole"), F.col(f"_now_{d}"))
            step = step.withColumn("factor", F.when(F.col(f"_now_{d}") > 0, fitted).otherwise(F.col("factor")))
        current = stage(step, f"mix-{number}")
        if max([x for x in current.agg(*off).first() if x is not None], default=0.0) < TOLERANCE:
            break
    return current.select(*dims, "tokens", "factor")


def budget_scale(raked: DataFrame, budget: float) -> float | None:
    """The c for which the sum of tokens * min(1, c * factor) is ``budget`` times all tokens; None if all must stay.

    Cells reach 1 in the order of their factors. At c = 1 / factor of a cell, those before it and itself
    give all their tokens and the rest what their factors say; the last cell that fits the budget counts.
    """
    rows = raked.filter((F.col("tokens") > 0) & (F.col("factor") > 0)).withColumn("_w", F.col("tokens") * F.col("factor"))
    first = Window.partitionBy().orderBy(F.col("factor").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = raked.agg(F.sum("tokens").alias("_want")).withColumn("_want", F.col("_want") * F.lit(budget))
    rows = rows.withColumn("_full", F.sum("tokens").over(first)).crossJoin(F.broadcast(whole))
    rows = rows.withColumn("_rest", F.greatest(F.lit(0.0), F.sum("_w").over(Window.partitionBy()) - F.sum("_w").over(first)))
    fits = F.col("_full") + F.col("_rest") / F.col("factor") <= F.col("_want")
    scale = F.try_divide(F.col("_want") - F.col("_full"), F.col("_rest"))
    found = rows.agg(
        F.max(F.when(fits, F.struct("_full", F.coalesce(scale, F.lit(float("inf"))).alias("c"))))["c"].alias("c"),
        F.try_divide(F.max("_want"), F.sum("_w")).alias("plain"),
    ).first()
    c = found["plain"] if found["c"] is None else found["c"]
    return None if c is None or c == float("inf") else c


def expected_copies(
    table: DataFrame,
    dims: Sequence[str],
    targets: Mapping[str, DataFrame] | None = None,
    temperatures: Mapping[str, float] | None = None,
) -> DataFrame:
    """``dims …, copies``: how often documents of each cell are wanted, 1 at least, for marginals with the target shares.

    What is added to the documents is raked, not the documents, so contradicting targets make neither a cell
    vanish nor the mix grow. Values with a target of 0 are not wanted at all; cells without tokens stay as they are.
    """
    rated = stage(_with_targets(table, dims, targets or {}, temperatures or {}), "mix-targets")
    refused = F.lit(False)
    for d in dims:
        refused = refused | F.coalesce(F.col(f"_t_{d}") == 0, F.lit(False))
    refused = refused & (F.col("tokens") > 0)
    fitted = rated.filter(~refused & (F.col("tokens") > 0))
    scale, short = 1.0, {}
    for d in dims:
        present = stage(fitted.groupBy(d).agg(F.sum("tokens").alias("_n"), F.max(f"_t_{d}").alias("_t")), f"mix-present-{d}")
        n, t, most = present.agg(F.sum("_n"), F.sum("_t"), F.max(F.try_divide("_n", "_t"))).first()
        if most is not None:
            scale = max(scale, most * t / n)
            short[d] = (present, n, t)
    others = rated.filter(refused | (F.col("tokens") <= 0)).select(*dims, F.when(refused, 0.0).otherwise(1.0).alias("copies"))
    if scale - 1.0 < TOLERANCE:
        return fitted.select(*dims, F.lit(1.0).alias("copies")).unionByName(others)
    wanted = {
        d: present.select(d, F.greatest(F.lit(0.0), F.col("_t") * F.lit(scale / t) - F.col("_n") / F.lit(n)).alias("share"))
        for d, (present, n, t) in short.items()
    }
    added = rake(fitted.select(*dims, "tokens"), dims, wanted)
    copies = F.lit(1.0) + F.coalesce(F.col("factor"), F.lit(0.0)) * F.lit(scale - 1.0)
    return added.select(*dims, copies.alias("copies")).unionByName(others)


def with_probability(
    df: DataFrame,
    dims: Mapping[str, Column],
    tokens: Column,
    targets: Mapping[str, DataFrame] | None = None,
    temperatures: Mapping[str, float] | None = None,
    name: str = "probability",
    budget: float | None = None,
    whole: bool = False,
) -> DataFrame:
    """Rows of ``df`` with the probability that a document of their cell is kept; if ``whole``, with its expected copies."""
    table = stage(cells(df, dims, tokens), "mix-cells")
    raked = expected_copies(table, list(dims), targets, temperatures) if whole else rake(table, list(dims), targets, temperatures)
    if whole:
        kept = F.col("copies")
    elif budget is None:
        most = F.lit(raked.agg(F.max(F.when(F.col("tokens") > 0, F.col("factor")))).first()[0]).cast("double")
        kept = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("factor"), most), F.lit(1.0)))
    else:
        c = budget_scale(raked, budget)
        scaled = F.when(F.col("factor") > 0, 1.0).otherwise(0.0) if c is None else F.col("factor") * F.lit(c)
        kept = F.least(F.lit(1.0), F.coalesce(scaled, F.lit(1.0)))
    by_cell = stage(raked.select(*[F.col(d).alias(f"_c_{i}") for i, d in enumerate(dims)], kept.alias("_p")), "mix-factors")
    key = fresh_name(df, "_cell")
    values = list(dims.values())
    shown = F.struct(*[F.coalesce(c.cast("string"), F.lit(NO_VALUE)).alias(f"_c_{i}") for i, c in enumerate(values)])
    right = by_cell.select(F.struct(*[f"_c_{i}" for i in range(len(values))]).alias(f"{key}_at"), F.col("_p").alias(f"{key}_p"))
    joined = df.withColumn(key, shown).join(right, F.col(key) == F.col(f"{key}_at"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"{key}_p").alias(name))


def sample(
    df: DataFrame,
    dims: Mapping[str, Column],
    tokens: Column,
    targets: Mapping[str, DataFrame] | None = None,
    temperatures: Mapping[str, float] | None = None,
    key: str = "doc_id",
    seed: int = 11,
    name: str = "probability",
    budget: float | None = None,
    whole: bool = False,
) -> DataFrame:
    """Documents drawn by their calibrated probabilities, with them.

    If ``whole``, a document comes as often as the whole part of its expected copies says, and once more with
    the rest as probability.
    """
    rated = with_probability(df, dims, tokens, targets, temperatures, name, budget, whole)
    drawn = uniform(F.col(f"`{key}`"), seed)
    if not whole:
        return rated.filter(drawn < F.col(name))
    floor = F.floor(F.col(name))
    times = (floor + F.when(drawn < F.col(name) - floor, 1).otherwise(0)).cast("int")
    copy = fresh_name(rated, "_copy")
    return rated.filter(times > 0).select("*", F.explode(F.sequence(F.lit(1), times)).alias(copy)).drop(copy)


def form_topic(text: Column) -> Column:
    """A coarse topic from the form of a text: table, code, notice, shout or prose."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("{") | text.contains("();"), "code")
        .when(text.contains("Licensed under"), "notice")
        .when(text.contains("!!"), "shout")
        .otherwise("prose")
    )

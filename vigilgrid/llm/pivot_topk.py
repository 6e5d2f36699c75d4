"""Exact top-k by inner product with a pivot table.

Distances of all vectors to many pivots are computed once, when shards are packed. For a query q and a
vector x every pivot p gives the lower bound ``abs(d(q, p) - d(x, p))`` on their distance; the largest one
gives an upper bound on the inner product, ``(q.q + x.x - bound**2) / 2``, next to the product of the
norms. Candidates of a shard are evaluated in the order of their bounds, a chunk at a time, until the next
bound is below the k-th best score: nothing left can be among the best, so the result is exact. Bounds get
a slack far above their rounding.

Vectors whose components are whole numbers, as ``quantised`` makes them, have exact whole scores (within
2 ** 53). Pivots are chosen far from each other among ``PIVOT_SAMPLE`` vectors, the only rows the driver
sees. Shards hold about ``vectors.SHARD_ROWS`` rows, whatever the table; of equal vectors in a shard only
the k + 1 smallest ids can matter.

Defined results: as in ``vectors.usable_vectors``; vectors meet those of their own length only; ties go to
the smaller id; a query is not compared with rows of its own id; rows that repeat an id take part each
with its vector; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import stage

PIVOTS = 16
PIVOT_SAMPLE = 1024
CHUNK = 512
SLACK = 1e-6


def quantised(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """Components as ``floor(scale * x)``."""
    return rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * F.lit(scale)).cast("double")))


def choose_pivots(rows: DataFrame, n: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> dict[int, np.ndarray]:
    """For every vector length in a bounded sample: vectors that are far from each other, one after another."""
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    out = {}
    for dim in sorted({row["dim"] for row in picked}):
        points = np.array([row["vec"] for row in picked if row["dim"] == dim])
        chosen = [0]
        near = np.linalg.norm(points - points[0], axis=1)
        while len(chosen) < min(n, len(points)) and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, np.linalg.norm(points - points[chosen[-1]], axis=1))
        out[dim] = points[chosen]
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to the few rows of ``b``."""
    return np.stack([np.linalg.norm(a - p, axis=1) for p in b], axis=1) if len(b) else np.zeros((len(a), 0))


def upper_bounds(q: np.ndarray, to_pivots: np.ndarray, norms: np.ndarray, table: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Upper bounds on the inner products of a query with all rows of a shard."""
    own = float(q @ q)
    cauchy = np.sqrt(own * norms)
    if not len(pivots):
        bound = cauchy
    else:
        least = np.abs(table - to_pivots).max(axis=1)
        bound = np.minimum((own + norms - least * least) / 2, cauchy)
    return bound + SLACK * (own + norms + 1)


def best_rows(
    q: np.ndarray, own_id: int, ids: np.ndarray, vecs: np.ndarray, bounds: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the ``k`` best rows for a query, and how many rows were evaluated."""
    order = np.argsort(-bounds, kind="stable")
    best_ids, best = np.zeros(0, np.int64), np.zeros(0)
    seen = 0
    for start in range(0, len(order), CHUNK):
        part = order[start : start + CHUNK]
        if len(best) == k and bounds[part[0]] < best[-1]:
            break
        seen += len(part)
        scores = vecs[part] @ q
        if len(best) == k:
            at = scores >= best[-1]
            part, scores = part[at], scores[at]
        other = ids[part] != own_id
        all_ids, all_ = np.r_[best_ids, ids[part][other]], np.r_[best, scores[other]]
        keep = np.lexsort((all_ids, -all_))[:k]
        best_ids, best = all_ids[keep], all_[keep]
    return best_ids, best, seen


def top_k(
    df: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", scale: float | None = None
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` largest inner products for the vectors of ``queries``."""

    def prepared(frame: DataFrame) -> DataFrame:
        rows = vectors.usable_vectors(frame, key, vector)
        return rows if scale is None else quantised(rows, scale)

    rows = stage(prepared(df), "pivot-rows")
    pivots = choose_pivots(rows)

    def make(ids: np.ndarray, vecs: np.ndarray) -> list[bytes]:
        at = vectors.without_spare_copies(ids, vecs, k)
        table = distances(vecs[at], pivots.get(vecs.shape[1], np.zeros((0, 0))))
        return [ids[at].tobytes(), vecs[at].tobytes(), table.tobytes()]

    names = ["x_ids", "x_vecs", "x_table"]
    packed = stage(vectors.shards(rows, make, names), "pivot-shards")

    def find(blobs: list[bytes], q_ids: np.ndarray, q_vecs: np.ndarray) -> tuple:
        ids = np.frombuffer(blobs[0], dtype="i8")
        vecs = np.frombuffer(blobs[1], dtype="f8").reshape(len(ids), -1)
        points = pivots.get(vecs.shape[1], np.zeros((0, 0)))
        table = np.frombuffer(blobs[2], dtype="f8").reshape(len(ids), len(points))
        norms = (vecs * vecs).sum(axis=1)
        to_pivots = distances(q_vecs, points)
        found: tuple[list, list, list] = ([], [], [])
        for i, q in enumerate(q_vecs):
            bounds = upper_bounds(q, to_pivots[i], norms, table, points)
            best_ids, best, _ = best_rows(q, int(q_ids[i]), ids, vecs, bounds, k)
            found[0].append(np.full(len(best), q_ids[i]))
            found[1].append(best_ids)
            found[2].append(best)
        return tuple(np.concatenate(f) for f in found)

    return vectors.search(packed, vectors.query_blocks(prepared(queries)), k, names, "double", find)

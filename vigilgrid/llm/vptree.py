"""Approximate nearest neighbours by cosine with a vantage-point tree per shard.

Vectors are scaled to length one, where the nearest by distance are the nearest by cosine. A node of a
tree holds a vantage point and the median distance to it; the near half goes to one child, the far half to
the other. A query enters the child on its side of the median first; it needs the other only if the
triangle inequality allows something better there: ``abs(d - median) <= radius`` with its k-th distance so
far as radius. With ``factor`` f the other child is entered only if ``f * abs(d - median) <= radius``, so a
larger factor skips more; 1 restores exact search. All queries of a block walk a tree together.

Every row is indexed. Scores are computed at the end from the original vectors. Of equal vectors in a
shard only the k + 1 smallest ids are kept, since no more can be among the best.

Defined results: as in ``vectors.usable_vectors``; vectors of length zero take no part; vectors meet those
with as many components only; ties go to the smaller id; a query is not compared with rows of its own
id; rows that repeat an id take part each with its vector; other columns are ignored, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import stage

LEAF = 128
FACTOR = 2.0


def build(units: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, and nodes ``(begin, end, vantage row, near child, far child)`` with their medians.

    Rows of a node are ``order[begin:end]``; children are -1 in a leaf.
    """
    order = np.arange(len(units))
    nodes, medians = [], []
    open_ = [(0, len(units), -1, 0)]
    while open_:
        begin, end, parent, side = open_.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][3 + side] = me
        nodes.append([begin, end, -1, -1, -1])
        medians.append(0.0)
        rows = order[begin:end]
        if len(rows) <= leaf:
            continue
        # The row farthest from the first one: vantage points at the rim split better.
        point = rows[int((units[rows] @ units[rows[0]]).argmin())]
        d = _chord(units[rows] @ units[point])
        half = len(rows) // 2
        split = np.argpartition(d, half)
        if d[split[half:]].min() == d.min() and d.max() == d.min():
            continue  # all rows are equal: nothing to split
        order[begin:end] = rows[split]
        nodes[me][2], medians[me] = int(point), float(d[split[half]])
        open_ += [(begin, begin + half, me, 0), (begin + half, end, me, 1)]
    return order, np.array(nodes, dtype="i8").reshape(-1, 5), np.array(medians)


def _chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


class Walk:
    """Search of one tree for a block of queries."""

    def __init__(self, units: np.ndarray, ids: np.ndarray, tree: tuple, queries: np.ndarray, own: np.ndarray, k: int, factor: float):
        self.order, self.nodes, self.medians = tree
        self.units, self.ids, self.queries, self.own, self.factor, self.k = units, ids, queries, own, factor, k
        self.kept = 2 * k + 2  # enough to sort ties out by exact scores
        self.best = np.full((len(queries), self.kept), -np.inf)
        self.at = np.full((len(queries), self.kept), -1)
        self.compared = 0

    def radius(self, q: np.ndarray) -> np.ndarray:
        kth = self.best[q, self.k - 1]
        return np.where(np.isfinite(kth), _chord(np.where(np.isfinite(kth), kth, 0.0)) + 1e-9, np.inf)

    def visit(self, node: int, q: np.ndarray) -> None:
        if not len(q):
            return
        begin, end, point, near, far = self.nodes[node]
        if near < 0:
            self.scan(q, self.order[begin:end])
            return
        d = _chord(self.queries[q] @ self.units[point])
        gap = d - self.medians[node]
        inside = gap < 0
        for child, other, side in ((near, far, inside), (far, near, ~inside)):
            first = q[side]
            self.visit(child, first)
            self.visit(other, first[self.factor * np.abs(gap[side]) <= self.radius(first)])

    def scan(self, q: np.ndarray, rows: np.ndarray) -> None:
        self.compared += len(q) * len(rows)
        cosine = self.queries[q] @ self.units[rows].T
        cosine[self.own[q][:, None] == self.ids[rows][None, :]] = -np.inf
        values = np.concatenate([self.best[q], cosine], axis=1)
        at = np.concatenate([self.at[q], np.broadcast_to(rows, cosine.shape)], axis=1)
        top = np.argpartition(-values, self.kept - 1, axis=1)[:, : self.kept]
        values, at = np.take_along_axis(values, top, 1), np.take_along_axis(at, top, 1)
        sort = np.argsort(-values, axis=1, kind="stable")
        self.best[q], self.at[q] = np.take_along_axis(values, sort, 1), np.take_along_axis(at, sort, 1)


def _unit(vecs: np.ndarray) -> np.ndarray:
    return vecs / np.sqrt((vecs * vecs).sum(axis=1))[:, None]


def nearest(
    df: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", factor: float = FACTOR
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found for the vectors of ``queries``."""

    def prepared(frame: DataFrame) -> DataFrame:
        # A length that underflows or overflows cannot be divided by.
        squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
        return vectors.usable_vectors(frame, key, vector).filter((squares > 0) & (squares < float("inf")))

    def make(ids: np.ndarray, vecs: np.ndarray) -> list[bytes]:
        at = vectors.without_spare_copies(ids, vecs, k)
        order, nodes, medians = build(_unit(vecs[at]))
        return [ids[at].tobytes(), vecs[at].tobytes(), order.tobytes(), nodes.tobytes(), medians.tobytes()]

    names = ["x_ids", "x_vecs", "x_order", "x_nodes", "x_medians"]
    rows = stage(prepared(df), "vptree-rows")
    packed = stage(vectors.shards(rows, make, names), "vptree-shards")

    def find(blobs: list[bytes], q_ids: np.ndarray, q_vecs: np.ndarray) -> tuple:
        ids = np.frombuffer(blobs[0], dtype="i8")
        vecs = np.frombuffer(blobs[1], dtype="f8").reshape(len(ids), -1)
        tree = (np.frombuffer(blobs[2], dtype="i8"), np.frombuffer(blobs[3], dtype="i8").reshape(-1, 5), np.frombuffer(blobs[4]))
        walk = Walk(_unit(vecs), ids, tree, _unit(q_vecs), q_ids, k, factor)
        walk.visit(0, np.arange(len(q_ids)))
        q, slot = np.nonzero(walk.at >= 0)
        x = walk.at[q, slot]
        real = np.isfinite(walk.best[q, slot])
        q, x = q[real], x[real]
        a, b = q_vecs[q], vecs[x]
        score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
        sort = np.lexsort((ids[x], -score, q))
        q, x, score = q[sort], x[sort], score[sort]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < k
        return q_ids[q[keep]], ids[x[keep]], score[keep]

    return vectors.search(packed, vectors.query_blocks(prepared(queries)), k, names, "double", find)

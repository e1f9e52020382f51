"""Approximate nearest neighbours by cosine over low-dimensional stable projections.

Unit vectors are projected onto a few Gaussian directions (2-stable: a
difference of length d becomes d times a chi variable). A kd-tree over the
projections hands out its cells in the order of their distance to the query's
projection; the true distances in a cell are verified. Once the cells reach
the projected distance r, a row nearer than the current kth distance d that has
not been met would have a projection stretched by over r / d: the search stops
when the chi-square test says that this has a probability below 1 - sure. No
number of candidates is capped.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame

from lakeloom.llm.topk import SHARD, best, search_shards, vectors


def chi_square_cdf(x: float, freedom: int) -> float:
    """For an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(freedom // 2):
        total += term
        term *= half / (i + 1)
    return 1.0 - math.exp(-half) * total if half < 700 else 1.0


class KDTree:
    """Points split at medians of the widest dimension, with the cells' bounds."""

    def __init__(self, points: np.ndarray, leaf: int = 128) -> None:
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.kids: list[tuple[int, int] | None] = []
        self.members: list[np.ndarray] = []
        self._build(points, np.arange(len(points)), leaf)

    def _build(self, points: np.ndarray, own: np.ndarray, leaf: int) -> int:
        at = len(self.kids)
        part = points[own]
        self.low.append(part.min(axis=0))
        self.high.append(part.max(axis=0))
        self.kids.append(None)
        self.members.append(own)
        width = self.high[at] - self.low[at]
        if len(own) > leaf and width.max() > 0:
            axis = int(width.argmax())
            order = np.argpartition(part[:, axis], len(own) // 2)
            half = len(own) // 2
            self.members[at] = own[:0]
            self.kids[at] = (self._build(points, own[order[:half]], leaf), self._build(points, own[order[half:]], leaf))
        return at

    def distance(self, node: int, q: np.ndarray) -> float:
        """Squared distance to a cell's bounds."""
        gap = np.maximum(self.low[node] - q, q - self.high[node])
        return float((np.maximum(gap, 0) ** 2).sum())

    def cells(self, q: np.ndarray):
        """(members, squared distance below which all is out) for the leaves, nearest first."""
        heap = [(self.distance(0, q), 0)]
        while heap:
            _, node = heapq.heappop(heap)
            kids = self.kids[node]
            if kids is None:
                yield self.members[node], (heap[0][0] if heap else math.inf)
            else:
                for c in kids:
                    heapq.heappush(heap, (self.distance(c, q), c))


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows divided by powers of two, which changes no cosine and no bit of it, so that squares neither overflow nor vanish."""
    _, power = np.frexp(np.abs(rows).max(axis=1, initial=0.0))
    return np.ldexp(rows, -power[:, None])


def ann_cosine(df: DataFrame, queries: DataFrame, k: int = 5, dims: int = 8, sure: float = 0.97, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD) -> DataFrame:
    """The k nearest rows found for each query: query_id, rank, vec_id, score (cosine).

    dims: directions, an even number. sure: the chance at least that a true
    neighbour is met. Defined cases: vectors that are null, empty, zero or hold
    null or non-finite components take no part, nor do rows with a null id;
    fewer candidates than k: all of them; ties go to the smaller id; repeated
    ids count once, with their least vector; an empty table gives an empty
    result; other columns are not looked at.
    """
    if dims < 2 or dims % 2:
        raise ValueError("dims must be even")

    def search(ids, rows, asked, block):
        rows, block = _scaled(rows), _scaled(block)
        norms = np.sqrt((rows * rows).sum(axis=1))
        ids, rows, norms = ids[norms > 0], rows[norms > 0], norms[norms > 0]
        if not len(ids):
            return
        directions = np.random.default_rng([seed, rows.shape[1]]).standard_normal((rows.shape[1], dims))
        unit = rows / norms[:, None]
        tree = KDTree(unit @ directions)
        for q, vector in zip(asked, block):
            norm = np.sqrt((vector * vector).sum())
            if not norm > 0:
                continue
            at = np.zeros(0, np.int64)
            scores = np.zeros(0)
            for members, beyond in tree.cells((vector / norm) @ directions):
                members = members[ids[members] != q]
                # products are summed row by row in a fixed order: equal vectors score equally
                near = (rows[members] * vector).sum(axis=1) / (norms[members] * norm)
                at, scores = np.concatenate([at, members]), np.concatenate([scores, near])
                top = best(ids[at], scores, k)
                at, scores = at[top], scores[top]
                if len(at) == k and beyond < math.inf:
                    reach = 2 - 2 * scores[-1]  # squared distance of the kth
                    if beyond > 0 and (reach <= 0 or chi_square_cdf(beyond / reach, dims) >= sure):
                        break
            yield np.full(len(at), q), ids[at], scores

    return search_shards(vectors(df, id_col, vector_col), vectors(queries, id_col, vector_col), k, search, "double", shard_rows)

"""Vector expressions and the partial top-k used by both dense and lexical search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors."""
    na, nb = dot(a, a), dot(b, b)
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(ok, dot(a, b) / (F.sqrt(na) * F.sqrt(nb))).otherwise(0.0)


class TopK:
    """Best k (score desc, id asc) per query, fed batch by batch inside one task."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.best = [(np.empty(0), np.empty(0)) for _ in range(n_queries)]
        self.floor = np.full(n_queries, -np.inf)  # what a score must reach to matter

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.round(scores, 9) + 0.0
        open_ = scores >= self.floor
        for q in np.flatnonzero(open_.any(axis=0)).tolist():
            keep, (bi, bs) = np.flatnonzero(open_[:, q]), self.best[q]
            s = scores[keep, q]
            if len(s) > self.k:
                best = s >= np.partition(s, -self.k)[-self.k]
                keep, s = keep[best], s[best]
            i = np.concatenate([bi, ids[keep]]) if len(bi) else ids[keep]
            v = np.concatenate([bs, s])
            order = np.lexsort((i, -v))[: self.k]
            self.best[q] = (i[order], v[order])
            if len(order) == self.k:
                self.floor[q] = v[order[-1]]

    def batch(self, query_ids: list, id_type: pa.DataType) -> pa.RecordBatch:
        q = [x for x, (i, _) in zip(query_ids, self.best) for _ in range(len(i))]
        i = [x for ids, _ in self.best for x in ids.tolist()]
        s = [x for _, sc in self.best for x in sc.tolist()]
        return pa.record_batch([pa.array(q, type=pa.int64() if not q or isinstance(q[0], int) else pa.string()),
                                pa.array(i, type=id_type), pa.array(s, type=pa.float64())],
                               names=["query_id", "record_id", "score"])

"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors become integers (floor of ``scale`` times the component). They fall by a hash into blocks of
bounded size; a block keeps one list per dimension, sorted by component. A query walks all lists
downwards in the sign of its own component, scores each vector it meets for the first time in full,
and stops once the bound of what it has not met, the sum of its components times those at the fronts of the
lists, is below its k-th best score. That is exact in every block, so the best of the blocks'
results are the best of all. Queries meet blocks in bounded groups; a pair of groups is a task's unit.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

BLOCK, QUERIES, SCALE, K, EVERY = 8192, 4096, 256.0, 5, 50
#: Larger components are set to this: a score of up to 4,096 of them fits 38 digits.
LIMIT = 2**56


class Lists:
    """The sorted lists of one block. ``rows`` are the numbers of its rows, ``ids`` what they are called."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids, self.v = rows[order], ids[order], vectors[order]
        self.most = int(np.abs(self.v).max(initial=0))
        self.down = np.argsort(-self.v, axis=0, kind="stable")
        self.forms: dict[type, np.ndarray] = {}

    def _number(self, q: np.ndarray) -> type:
        """In what sums of products with ``q`` are exact: doubles up to 2**53, where the matrix product is fast, longs, else Python integers."""
        largest = len(q) * int(np.abs(q).max(initial=0)) * self.most
        return np.float64 if largest < 2**53 else np.int64 if largest < 2**63 else object

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (id, score), ties to the smaller id; the query's own row takes no part."""
        n = len(self.ids)
        number = self._number(q)
        if number not in self.forms:
            self.forms[number] = self.v.astype(number)
        whole = object if number is object else np.int64
        v, given = self.forms[number], q.astype(number)
        lists = np.flatnonzero(q)
        up = q[lists] < 0
        seen = np.zeros(n, dtype=bool)
        best_i, best_s = np.zeros(0, np.int64), np.zeros(0, whole)
        at, step = 0, 4 * k
        while at < n:
            to = min(n, at + step)
            depth = np.arange(at, to)
            rows = self.down[np.where(up[:, None], n - 1 - depth, depth), lists[:, None]] if len(lists) else depth
            new = np.zeros(n, dtype=bool)
            new[rows.ravel()] = True
            new &= ~seen
            seen |= new
            met = np.flatnonzero(new)
            met = met[self.rows[met] != own]
            score = (v[met] @ given).astype(whole)
            best_i, best_s = np.concatenate((best_i, met)), np.concatenate((best_s, score))
            if len(best_i) > k:
                top = self._order(best_i, best_s)[:k]
                best_i, best_s = best_i[top], best_s[top]
            if not len(lists) or seen.all():
                if len(lists) or to == n:
                    break
            elif len(best_s) >= k:
                front = self.v[self.down[np.where(up, n - to, to - 1), lists], lists].astype(whole)
                # A vector not met could still tie, with a smaller id, while the bound equals the k-th score.
                if int((front * q[lists].astype(whole)).sum()) < min(best_s.tolist()):
                    break
            at, step = to, step * 2
        top = self._order(best_i, best_s)[:k]
        return self.ids[best_i[top]], best_s[top]

    def _order(self, at: np.ndarray, score: np.ndarray) -> np.ndarray:
        if score.dtype == object:
            return np.array(sorted(range(len(at)), key=lambda i: (-score[i], self.ids[at[i]])), np.int64)
        return np.lexsort((self.ids[at], -score))


def _search(k: int):
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.decimal128(38, 0))])

    def group(queries: pa.Table, rows: pa.Table) -> pa.Table:
        def parts(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            v = t.column("v").combine_chunks()
            return t.column("row").to_numpy(), t.column("vec_id").to_numpy(), v.flatten().to_numpy().reshape(len(v), -1)

        if not len(queries) or not len(rows):
            return schema.empty_table()
        lists, out = Lists(*parts(rows)), []
        for own, name, q in zip(*parts(queries), strict=True):
            ids, score = lists.search(int(own), q, k)
            out += [(int(own), int(name), i, Decimal(x)) for i, x in zip(ids.tolist(), score.tolist(), strict=True)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else schema.empty_table()

    return group, "query long, query_id long, vec_id long, score decimal(38,0)"


def integer_vectors(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, v): components floor(scale * x), kept within +-LIMIT; vectors that are null, empty, or hold a null or non-finite component go."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = vectors.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.coalesce(ok, F.lit(False)))
    # Cut before floor(), which takes no double past a long.
    v = F.transform("x", lambda c: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), c * scale))))
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: float = SCALE, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for every row whose vec_id is divisible by ``every``.

    Ties go to the smaller vec_id. Rows without an id or a usable vector take no part; rows that
    repeat an id, or an id and its vector, are rows of their own, each a query with k results and a
    candidate for the others. Vectors are compared within their dimension. Scores are exact integers;
    past what a long holds they are ranked as they are and returned as the nearest long. An empty
    table gives an empty result; other columns are ignored.
    """
    counted = integer_vectors(vectors, scale).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.withColumn("no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("vec_id", "v", F.xxhash64("vec_id", "v", "no").alias("row"), F.size("v").alias("dim"))
    asked = F.col("vec_id") % every == 0
    sizes = {r.dim: (r.n, r.q) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("q")).orderBy("dim").collect()}
    parts = [(d, max(1, -(-n // block)), max(1, -(-q // queries))) for d, (n, q) in sizes.items()]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = F.element_at(F.create_map(*(F.lit(x) for d, b, _ in parts for x in (d, b))), F.col("dim"))
    groups = F.element_at(F.create_map(*(F.lit(x) for d, _, g in parts for x in (d, g))), F.col("dim"))
    place = F.xxhash64(F.col("row"))
    # Every row goes to each query group once, every query to each block once.
    left = rows.where(asked).withColumns({"g": F.pmod(place, groups), "b": F.explode(F.sequence(F.lit(0), blocks - 1))})
    right = rows.withColumns({"b": F.pmod(place, blocks), "g": F.explode(F.sequence(F.lit(0), groups - 1))})
    key = ["dim", "b", "g"]
    fn, schema = _search(k)
    sides = [x.select(*(F.col(c).cast("int") for c in key), "row", "vec_id", "v").groupBy(key) for x in (left, right)]
    found = sides[0].cogroup(sides[1]).applyInArrow(fn, schema)
    # At most k results a query and block meet here.
    order = Win.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    long = F.greatest(F.lit(-(2**63) + 1).cast("decimal(38,0)"), F.least(F.lit(2**63 - 1).cast("decimal(38,0)"), F.col("score"))).cast("long")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", long.alias("score"))

"""Exact top-k by inner product: columnar branch and bound.

Candidates lie dimension by dimension. Inner products are summed a block of
dimensions at a time; what the remaining dimensions can add is bounded by the
product of the remaining norms, and candidates that cannot reach a query's k-th
best score any more are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.tables import row_count_parts, stash

K = 5
SCALE = 256
#: Queries, and candidates, that meet in one group.
QUERIES = 8_192
CANDIDATES = 8_192
#: Dimensions summed between two looks at the bound, and the tile in which scores are held.
BLOCK = 8
TILE = (256, 2_048)

_FOUND = "query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    top = float(np.finfo(np.float64).max)
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) <= top, F.lit(False))), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` highest integer inner products among ``vectors`` (vec_id, embedding).

    Components x count as floor(256 x). Queries are the rows for which
    ``is_query`` holds; a candidate is any row whose vec_id is not the query's.
    Ties go to the smaller vec_id. Null ids, and vectors that are null or hold
    null or non-finite components, take no part; vectors of different lengths do
    not meet. Repeated rows count as often as they are. Scores are exact up to
    2^53; beyond, they are summed in whole numbers of any size and held to the
    range of a long.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), is_query.alias("asks"))
    rows = stash(rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))), "search-rows")
    total, asking = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    spark = vectors.sparkSession
    blocks, slices = row_count_parts(spark, asking, QUERIES), row_count_parts(spark, total, CANDIDATES)
    dim = F.size("vector").alias("dim")

    def dealt(n: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where("asks").select(dim, dealt(blocks, 1).alias("block"), every(slices).alias("slice"), F.lit(0).alias("kind"), "vec_id", "vector")
    candidates = rows.select(dim, every(blocks).alias("block"), dealt(slices, 2).alias("slice"), F.lit(1).alias("kind"), "vec_id", "vector")
    keys = ["dim", "block", "slice"]
    met = queries.union(candidates).repartition(*keys).sortWithinPartitions(*keys, "kind")
    found = met.mapInArrow(lambda batches: _search(batches, k), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    group, best = None, None
    for batch in batches:
        keys = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("dim", "block", "slice", "kind")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            key, kind = tuple(keys[:3, lo]), keys[3, lo]
            if key != group:
                if best:
                    yield best.rows()
                group, best = key, None
            part = batch.slice(lo, hi - lo)
            ids = part["vec_id"].to_numpy()
            values = np.floor(SCALE * part["vector"].flatten().to_numpy(zero_copy_only=False)).reshape(len(ids), -1)
            if kind == 0:
                best = best.more(ids, values) if best else Best(ids, values, k)
            elif best:
                for at in range(0, len(ids), TILE[1]):
                    best.offer(ids[at:at + TILE[1]], values[at:at + TILE[1]])
    if best:
        yield best.rows()


class Best:
    """The best candidates so far of each of a block of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.score = np.full((len(ids), k), -np.inf)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.exact: dict[int, list] = {}

    def more(self, ids: np.ndarray, queries: np.ndarray) -> Best:
        return Best(np.concatenate([self.ids, ids]), np.concatenate([self.queries, queries]), self.k)

    def offer(self, ids: np.ndarray, values: np.ndarray) -> None:
        peak = max(np.abs(values).max(initial=0), np.abs(self.queries).max(initial=0))
        if peak * peak * max(1, values.shape[1]) >= 2.0 ** 53 or self.exact:
            return self._offer_large(ids, values)
        # Dimensions with most weight first: the rest then bounds tighter.
        order = np.argsort(-(values ** 2).sum(axis=0), kind="stable")
        columns = np.ascontiguousarray(values[:, order].T)
        for at in range(0, len(self.ids), TILE[0]):
            rows = slice(at, at + TILE[0])
            q, c, s = self._tile(self.queries[rows][:, order], columns, self.score[rows, -1], self.ids[rows], ids)
            if len(q):
                self._merge(at + q, ids[c], s)

    def _tile(self, queries, columns, least, query_ids, ids):
        """(query, candidate, score) of the pairs that may enter; ``columns`` has a row for each dimension."""
        dims = len(columns)
        q_rest = np.sqrt(np.cumsum((queries ** 2)[:, ::-1], axis=1)[:, ::-1])
        c_rest = np.sqrt(np.cumsum((columns ** 2)[::-1], axis=0)[::-1])
        alive = query_ids[:, None] != ids[None]
        sums, at, kept = np.zeros(alive.shape), 0, np.arange(len(ids))
        while at < dims and alive.mean() > 0.1:
            end = min(at + BLOCK, dims)
            sums += queries[:, at:end] @ columns[at:end][:, kept]
            at = end
            if at < dims:
                alive &= sums + q_rest[:, at, None] * c_rest[at, kept][None] * (1 + 1e-9) >= least[:, None]
                some = alive.any(axis=0)
                if some.mean() < 0.7:
                    alive, sums, kept = alive[:, some], sums[:, some], kept[some]
                    if not len(kept):
                        break
        q, c = np.nonzero(alive)
        score, c = sums[q, c], kept[c]
        while at < dims and len(q):
            end = min(at + BLOCK, dims)
            score = score + np.einsum("nd,dn->n", queries[q, at:end], columns[at:end, c])
            at = end
            if at < dims:
                on = score + q_rest[q, at] * c_rest[at, c] * (1 + 1e-9) >= least[q]
                q, c, score = q[on], c[on], score[on]
        on = score >= least[q]
        return q[on], c[on], score[on]

    def _merge(self, q: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        rows = np.unique(q)
        q = np.concatenate([q, np.repeat(rows, self.k)])
        vec = np.concatenate([vec, self.vec[rows].ravel()])
        score = np.concatenate([score, self.score[rows].ravel()])
        order = np.lexsort((vec, -score, q))
        q, vec, score = q[order], vec[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        on = place < self.k
        self.vec[q[on], place[on]], self.score[q[on], place[on]] = vec[on], score[on]

    def _offer_large(self, ids, values) -> None:
        whole = [[int(x) for x in row] for row in values]
        for i, query in enumerate(self.queries):
            asked = [int(x) for x in query]
            now = self.exact.setdefault(i, [(-int(s), int(v)) for s, v in zip(self.score[i], self.vec[i]) if np.isfinite(s)])
            now += [(-sum(a * b for a, b in zip(asked, row)), int(v)) for row, v in zip(whole, ids) if v != self.ids[i]]
            self.exact[i] = sorted(now)[: self.k]

    def rows(self) -> pa.RecordBatch:
        if self.exact:
            top = np.iinfo(np.int64).max
            flat = [(int(self.ids[i]), v, int(max(-top, min(top, -s)))) for i, found in self.exact.items() for s, v in found]
        else:
            q, p = np.nonzero(np.isfinite(self.score))
            flat = list(zip(self.ids[q].tolist(), self.vec[q, p].tolist(), self.score[q, p].astype(np.int64).tolist()))
        query, vec, score = zip(*flat) if flat else ((), (), ())
        return pa.RecordBatch.from_pydict({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.int64())})


#: What the query over ``embeddings`` returns.
SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

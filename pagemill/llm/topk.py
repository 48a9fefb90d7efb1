"""Exact top-k inner products by columnar branch and bound.

Vectors are kept in vertical layout, a row for each dimension. A block of queries meets a block of candidates: partial
scores grow by one block of dimensions at a time, and after each the product of the remaining norms (Cauchy-Schwarz) bounds
what the rest can add. Pairs that cannot reach the query's k-th best so far are dropped, and the survivors are compacted.

Queries and candidates form a grid of blocks; a cell holds its queries in small groups and streams its candidate blocks, those
with the greatest norms first, so that whole blocks soon fall below a group's bound. Only k rows a query leave a cell. A
candidate travels once for each ``QUERY_BLOCK`` queries. Nothing is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width

#: Queries of a cell and of a group in it, candidates of a cell at most and at least, and of a block, dimensions of a step.
QUERY_BLOCK, QUERIES, CANDIDATE_GROUP, LEAST_GROUP, TILE, DIMS = 16_384, 512, 200_000, 8192, 4096, 16
EXACT = 1 << 53


def _blob(kind_of, blocks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = np.asarray(b.column("block"))
            rows: dict[str, list] = {"block": [], "ids": [], "norm": [], "dims": [], "values": []}
            ids, vecs = np.asarray(b.column("id")), b.column("v")
            offsets, flat = np.asarray(vecs.offsets), np.asarray(vecs.values)
            square = np.concatenate([[0.0], np.cumsum(np.square(flat.astype(float)))])[offsets]
            order = np.lexsort((square[:-1] - square[1:], block))
            cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
            for x, y in zip(cuts, np.append(cuts[1:], len(order))):
                for z in range(x, y, TILE):
                    take = order[z : min(y, z + TILE)]
                    size = offsets[take + 1] - offsets[take]
                    m = np.zeros((int(size.max()), len(take)), np.int64)
                    for d in range(len(m)):
                        has = size > d
                        m[d, has] = flat[offsets[take][has] + d]
                    top = int(np.abs(m).max(initial=0))
                    m = m.astype(np.int16 if top < 1 << 15 else np.int64)
                    for name, v in zip(rows, (int(block[take[0]]), ids[take].tobytes(), float(np.sqrt(np.square(m.astype(float)).sum(0)).max(initial=0)), len(m) * (1 if m.itemsize == 2 else -1), m.tobytes())):
                        rows[name].append(v)
            yield pa.record_batch({"block": pa.array(rows["block"], pa.int64()), "ids": pa.array(rows["ids"], pa.binary()), "norm": pa.array(rows["norm"], pa.float64()), "dims": pa.array(rows["dims"], pa.int32()), "values": pa.array(rows["values"], pa.binary())})

    return run


class Cell:
    """The best k for each query of a block."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.score = [np.zeros(0, np.int64)] * len(ids)
        self.best = [np.zeros(0, np.int64)] * len(ids)
        self.floor = np.full(len(ids), -np.inf)
        self.norm = np.sqrt(np.square(q.astype(float)).sum(0))

    def add(self, ids: np.ndarray, c: np.ndarray) -> None:
        most = np.sqrt(np.square(c.astype(float)).sum(0).max(initial=0))
        reach = np.flatnonzero(self.norm * most * (1 + 1e-9) + 1e-6 >= self.floor)
        if not len(reach):
            return
        floor, dims = self.floor[reach], max(len(c), len(self.q))
        q = self.q[:, reach]
        q, c = (np.vstack([m, np.zeros((dims - len(m), m.shape[1]), np.int64)]) if len(m) < dims else m for m in (q, c))
        exact = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(dims, 1) < EXACT
        kind = np.float64 if exact else np.int64
        q, c = q.astype(kind), c.astype(kind)
        # the dimensions with the most mass come first, so that the bound falls early
        order = np.argsort(-np.square(c.astype(float)).sum(1) * np.square(q.astype(float)).sum(1), kind="stable")
        q, c = q[order], c[order]
        rest = lambda m: np.sqrt(np.concatenate([np.cumsum(np.square(m.astype(float))[::-1], 0)[::-1], np.zeros((1, m.shape[1]))]))
        rq, rc = rest(q), rest(c)
        s = np.zeros((q.shape[1], c.shape[1]), kind)
        pairs = None
        for d in range(0, dims, DIMS):
            e = min(d + DIMS, dims)
            if pairs is None:
                s += q[d:e].T @ c[d:e]
                # the slack covers rounding of the norms
                live = s + np.outer(rq[e], rc[e]) * (1 + 1e-9) + 1e-6 >= floor[:, None]
                if live.sum() < 0.15 * live.size:
                    pairs = np.nonzero(live)
                    s = s[pairs]
            else:
                a, b = pairs
                for x in range(d, e):
                    s = s + q[x, a] * c[x, b]
                live = s + rq[e, a] * rc[e, b] * (1 + 1e-9) + 1e-6 >= floor[a]
                pairs, s = (a[live], b[live]), s[live]
        if pairs is None:
            pairs = np.nonzero(live) if dims else np.nonzero(np.ones_like(s, bool))
            s = s[pairs]
        a, b = pairs
        a, s, got = reach[a], s.astype(np.int64), ids[b]
        mine = got != self.ids[a]
        a, s, got = a[mine], s[mine], got[mine]
        for i, x, y in zip(*self._groups(a)):
            score, best = np.concatenate([self.score[i], s[x:y]]), np.concatenate([self.best[i], got[x:y]])
            top = np.lexsort((best, -score))[: self.k]
            self.score[i], self.best[i] = score[top], best[top]
            if len(top) == self.k:
                self.floor[i] = score[top[-1]]

    @staticmethod
    def _groups(a):
        cuts = np.flatnonzero(np.diff(a, prepend=-1))
        return a[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(a)).tolist()

    def rows(self) -> pa.RecordBatch:
        n = [len(x) for x in self.score]
        cat = lambda x: np.concatenate([*x, np.zeros(0, np.int64)])
        return pa.record_batch({"query_id": np.repeat(self.ids, n), "key": np.repeat(_keys(self.q), n), "vec_id": cat(self.best), "score": cat(self.score)})


def _matrix(dims: int, values: bytes) -> np.ndarray:
    kind = np.int16 if dims >= 0 else np.int64
    return np.frombuffer(values, kind).reshape(abs(dims), -1).astype(np.int64) if dims else np.zeros((0, 0), np.int64)


def _cells(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, now, parts = [], None, []

        def made() -> list[Cell]:
            dims = max((len(m) for _, m in parts), default=0)
            out = []
            for i, m in parts:
                m = np.vstack([m.reshape(len(m), len(i)), np.zeros((dims - len(m), len(i)), np.int64)])
                out += [Cell(i[x : x + QUERIES], m[:, x : x + QUERIES], k) for x in range(0, len(i), QUERIES)]
            return out

        for b in batches:
            for at, query, ids, dims, values in zip(*(b.column(c).to_pylist() for c in ("cell", "query", "ids", "dims", "values"))):
                if at != now:
                    for c in cells:
                        yield c.rows()
                    cells, now, parts = [], at, []
                ids = np.frombuffer(ids, np.int64)
                m = _matrix(dims, values).reshape(abs(dims), len(ids))
                if query:
                    parts.append((ids, m))
                elif parts:
                    cells = cells or made()
                    for c in cells:
                        c.add(ids, m)
        for c in cells:
            yield c.rows()

    return run


def _keys(q: np.ndarray) -> np.ndarray:
    """Tells apart queries of one id with unlike vectors; trailing zeros do not count."""
    h = np.zeros(q.shape[1], np.uint64)
    for i, row in enumerate(q):
        h += row.astype(np.uint64) * np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64))
    return h.view(np.int64)


def scaled(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """Column v: floor(scale * x) of each component; rows with null or non-finite components go."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return df.where(x.isNotNull() & ~bad).withColumn("v", F.transform(x, lambda e: F.floor(e * scale)))


def top_k(df: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each row whose id is divisible by ``every``.

    Ties go to the smaller id. All rows but those with the query's own id are candidates; with fewer than k, all of them
    come. Rows with a null id or vector, or a null or non-finite component, take no part; shorter vectors count as filled
    up with zeros. Repeated rows are candidates each, but one query. Products must fit 64 bits. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = scaled(df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("x")).where(F.col("id").isNotNull()), "x", scale).select("id", "v")
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    n = rows.agg(F.count("*"), F.count(F.when(F.col("id") % every == 0, 1))).first()
    width = shuffle_width(spark)
    blocks = max(1, -(-n[1] // QUERY_BLOCK))
    # cells enough for every task, but not so small that the k best of each are many against its candidates
    groups = max(1, -(-n[0] // CANDIDATE_GROUP), min(-(-width // blocks), n[0] // LEAST_GROUP))
    blob = "block long, ids binary, norm double, dims int, values binary"
    qs = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).mapInArrow(_blob("q", blocks), blob)
    cs = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(groups))).mapInArrow(_blob("c", groups), blob)
    qs = qs.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("cell", F.col("block") * groups + F.col("other")).withColumn("query", F.lit(True))
    cs = cs.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("cell", F.col("other") * groups + F.col("block")).withColumn("query", F.lit(False))
    cells = qs.unionByName(cs).drop("block", "other").repartition(min(width, blocks * groups), "cell").sortWithinPartitions("cell", F.desc("query"), F.desc("norm"))
    found = cells.mapInArrow(_cells(k), "query_id long, key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

"""Exact top-k by inner product through an M-tree and best-first search.

Inner products become distances by one more component: with R the greatest norm of all, a candidate x gets
``sqrt(R^2 - |x|^2)`` and a query 0, so ``d^2 = |q|^2 + R^2 - 2 q.x`` and the nearest are the best. The top of the tree is
over the whole table: sampled pivots are routing objects, each candidate lies in the cell of its nearest pivot, and a cell
has a covering radius. Below, a cell's blocks are trees of pages: entries with their distance to the page's routing object
(the parent distance) and a covering radius, and a page of pages above.

A query first searches the cell that may hold the nearest, then only those whose least possible distance isn't beyond its
k-th best so far. Inside, pages are taken by their least possible distance; routing objects and entries whose stored
distances prove them too far by the triangle inequality are left out. Scores are integers, computed exactly; the bounds
have a slack above float rounding, and the results of all cells are merged, so the result is exact with ties to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldloom.llm.shared import staged

#: Entries of a page, rows of a block, queries that one task holds, and routing objects at the top at most.
PAGE, BLOCK, QUERIES, PIVOTS = 48, 4096, 4096, 2048
#: Squared norms above this can't be held exactly.
GREATEST = 2.0**62


class MTree:
    """Two levels of routing above pages of at most about ``PAGE`` entries, from integer vectors with ascending ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE):
        self.ids, self.x = ids, vectors
        sq = (vectors.astype(float) ** 2).sum(1)
        self.r2 = float(sq.max())
        self.points = np.column_stack([vectors.astype(float), np.sqrt(np.maximum(self.r2 - sq, 0))])
        #: page: routing point, members, parent distances (ascending), covering radius
        self.pages = [self._page(m) for m in self._split(np.arange(len(ids)), page)]
        routing = np.stack([p[0] for p in self.pages])
        self.upper = []
        for m in self._split(np.arange(len(self.pages)), max(4, int(len(self.pages) ** 0.5)), routing):
            top = routing[m[0]]
            up = np.sqrt(((routing[m] - top) ** 2).sum(1))
            self.upper.append((top, m, up, float((up + np.array([self.pages[i][3] for i in m])).max())))

    def _split(self, members: np.ndarray, size: int, points: np.ndarray | None = None) -> list[np.ndarray]:
        """Halve by distance to two far objects until groups are small; equal points are halved by order."""
        points = self.points if points is None else points
        todo, done = [members], []
        while todo:
            m = todo.pop()
            if len(m) <= size:
                done.append(m)
                continue
            p = points[m]
            a = ((p - p[0]) ** 2).sum(1).argmax()
            da = ((p - p[a]) ** 2).sum(1)
            order = np.argsort(da - ((p - p[da.argmax()]) ** 2).sum(1), kind="stable")
            todo += [m[np.sort(order[: len(m) // 2])], m[np.sort(order[len(m) // 2 :])]]
        return done

    def _page(self, m: np.ndarray) -> tuple:
        p = self.points[m]
        centre = p[((p - p.mean(0)) ** 2).sum(1).argmin()]
        d = np.sqrt(((p - centre) ** 2).sum(1))
        return centre, m, d, float(d.max())

    def search(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best entries other than the query's own row."""
        point, q2 = np.append(q.astype(float), 0.0), float((q.astype(float) ** 2).sum())
        slack = 1e-7 * (1 + q2 + self.r2) ** 0.5
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst kept is on top
        far = np.inf
        queue: list[tuple] = []
        for i, (top, _, _, radius) in enumerate(self.upper):
            d = float(np.sqrt(((point - top) ** 2).sum()))
            heapq.heappush(queue, (max(0.0, d - radius), 0, i, d))
        while queue:
            bound, leaf, i, d = heapq.heappop(queue)
            if bound > far + slack:
                break
            if not leaf:
                _, m, up, _ = self.upper[i]
                for j, parent in zip(m.tolist(), up.tolist(), strict=True):
                    centre, _, _, radius = self.pages[j]
                    if abs(d - parent) - radius > far + slack:
                        continue  # proved too far without a distance
                    e = float(np.sqrt(((point - centre) ** 2).sum()))
                    if e - radius <= far + slack:
                        heapq.heappush(queue, (max(0.0, e - radius), 1, j, e))
                continue
            _, m, parent, _ = self.pages[i]
            m = m[np.abs(d - parent) <= far + slack]
            for score, x in zip((self.x[m] @ q).tolist(), self.ids[m].tolist(), strict=True):
                if x == query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -x))
                elif (score, -x) > best[0]:
                    heapq.heapreplace(best, (score, -x))
            if len(best) == k:
                far = max(0.0, q2 + self.r2 - 2 * best[0][0]) ** 0.5
        return [(s, -x) for s, x in best]


def quantised(column: str):
    return F.transform(column, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows, shorter ones padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class _Top:
    """The routing objects at the top, lifted by the component that makes inner products distances."""

    def __init__(self, pivots: np.ndarray, r2: float):
        self.r2 = r2
        self.slack = 1e-6 * (1 + r2) ** 0.5
        self.points = self.lifted(pivots)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        f = x.astype(float)
        return np.column_stack([f, np.sqrt(np.maximum(self.r2 - (f**2).sum(1), 0))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        d2 = (points**2).sum(1)[:, None] + (self.points**2).sum(1)[None, :] - 2 * points @ self.points.T
        return np.sqrt(np.maximum(d2, 0))

    def placed(self, df: DataFrame, width: int) -> DataFrame:
        """(id, v, c) with the cell of the nearest routing object and the distance to it."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(i, 2048) for i in range(0, len(batch), 2048)):
                    d = self.distances(self.lifted(_matrix(part.column("v"), width)))
                    cell = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), part.column("c"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["id", "v", "c", "cell", "d"])

        return df.select("id", "v", "c").mapInArrow(work, "id long, v array<long>, c long, cell int, d double")

    def routed(self, df: DataFrame, width: int, radius: np.ndarray, first: bool) -> DataFrame:
        """Queries (id, v, far) with cells to search: the one that may hold the nearest, or all others within ``far``."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(i, 2048) for i in range(0, len(batch), 2048)):
                    q = _matrix(part.column("v"), width).astype(float)
                    d = self.distances(np.column_stack([q, np.zeros(len(q))]))
                    least = np.where(np.isnan(radius), np.inf, np.maximum(d - radius, 0))
                    best = np.lexsort((d, least), axis=1)[:, 0] if len(q) else np.zeros(0, int)
                    if first:
                        row, cell = np.arange(len(q)), best
                    else:
                        far = part.column("far").to_numpy(zero_copy_only=False)
                        near = least <= far[:, None] + 2 * self.slack
                        near[np.arange(len(q)), best] = False
                        row, cell = np.nonzero(near & np.isfinite(least))
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("v").take(at), pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

        return df.select("id", "v", "far").mapInArrow(work, "id long, v array<long>, cell int")


def _search(cells: DataFrame, queries: DataFrame, blocks: DataFrame, width: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best of every block of the cells that a query is sent to."""
    h = F.xxhash64("id", "v")
    sent = queries.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).alias("turns")).join(blocks, "cell")  # a row a cell
    left = cells.join(F.broadcast(sent), "cell").withColumn("block", F.pmod(h, "blocks")).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
    right = queries.join(F.broadcast(sent), "cell").withColumn("turn", F.pmod(h, "turns")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def work(cand: pd.DataFrame, quer: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(cand) and len(quer):
            cand = cand.sort_values("id")
            matrix = lambda c: np.stack([np.pad(np.asarray(v, np.int64), (0, width - len(v))) for v in c])
            times = np.minimum(cand["c"].to_numpy(), k)
            tree = MTree(np.repeat(cand["id"].to_numpy(), times), np.repeat(matrix(cand["v"]), times, 0))
            for i, q in zip(quer["id"].tolist(), matrix(quer["v"]), strict=True):
                out += [(i, x, s) for s, x in tree.search(i, q, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ("cell", "block", "turn")
    return left.select(*keys, "id", "v", "c").groupBy(*keys).cogroup(right.select(*keys, "id", "v").groupBy(*keys)).applyInPandas(work, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose key is divisible by ``every`` its ``k`` best other rows.

    Vectors that are null or hold a null or non-finite component, and rows with a null key, take no part. Shorter vectors
    count as padded with zeros; squared norms above GREATEST after scaling are an error. Repeated rows are candidates each,
    but rows with the query's own key are its own row. Queries of one key share one ranking, whatever their vectors. Other
    columns play no part; an empty table gives no rows. Jobs are run while the plan is built.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine).select(F.col(key).cast("long").alias("id"), quantised(vector).alias("v"))
    # A key and vector may be repeated any number of times: equal rows are counted.
    rows = staged(rows.groupBy("id", "v").agg(F.count("*").alias("c")), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, width, r2 = rows.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    if not n:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if r2 >= GREATEST:
        raise ValueError(f"a vector's squared norm of {r2} after scaling is beyond {GREATEST}")
    width = max(1, width)
    held = rows.select("v", "id").orderBy(F.xxhash64("v", "id"), "id").limit(min(PIVOTS, -(-n // BLOCK))).collect()
    top = _Top(np.stack([np.pad(np.asarray(r["v"], np.int64), (0, width - len(r["v"]))) for r in held]), r2)
    cells = staged(top.placed(rows, width), "cells")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius"))
    radius = np.full(len(held), np.nan)
    known = sizes.collect()  # a row a cell, PIVOTS at most
    for r in known:
        radius[r["cell"]] = r["radius"]
    blocks = df.sparkSession.createDataFrame([(r["cell"], -(-r["n"] // BLOCK)) for r in known], "cell int, blocks long")
    asked = rows.filter(F.col("id") % every == 0).select("id", "v", F.lit(float("inf")).alias("far"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    first = staged(_search(cells, top.routed(asked, width, radius, True), blocks, width, k).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank"), "first")
    last = first.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("least")).select(F.col("query_id").alias("id"), "found", "least")
    own = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    far = F.when(F.col("found") >= k, F.sqrt(F.greatest(F.lit(0.0), own + F.lit(r2) - 2 * F.col("least").cast("double")))).otherwise(float("inf"))
    again = staged(top.routed(asked.drop("far").join(last, "id", "left").select("id", "v", far.alias("far")), width, radius, False), "again")
    found = first.unionByName(_search(cells, again, blocks, width, k))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score; see ``top_k`` for odd rows."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))

"""Approximate nearest neighbours by forests of random-projection trees.

Equal vectors form one class with its smallest ids (as many as an answer can name). Classes are dealt into shards
of about ``SHARD`` vectors; every shard indexes all its vectors in ``TREES`` trees. A node splits by a random pair
of its vectors at the median projection, until ``LEAF`` vectors are left. Queries go to every shard in blocks. The
trees of a shard share one priority queue: the node with the largest margin over all trees is opened next, until
the leaves opened hold ``SHARE`` of the shard. These candidates are ranked by exact inner products in double
precision, and the best of all shards are ranked once more.

For largest inner products, vectors are lifted by one component to equal length, so that nearness by projection
follows the product. Defined cases: a vector that is null, empty, zero or has a null or non-finite component takes
no part, nor does a row with a null id; vectors are compared with those of their own length only; a repeated row
counts once; a query's own id is never among its answers; ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.runtime import Scratch

SHARD = 20_000
TREES = 12
LEAF = 48
SHARE = 0.6
QUERY_BLOCK = 2000


class Forest:
    """Random-projection trees over one shard."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        lifted = np.concatenate([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], axis=1).astype(np.float32)
        rng = np.random.default_rng(seed)
        self.normals: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.children: list[tuple[int, int]] = []  # node numbers; a leaf is ~(its number)
        self.leaves: list[np.ndarray] = []
        self.roots = [self._split(lifted, np.arange(len(lifted)), rng) for _ in range(TREES if len(lifted) > LEAF else 1)]

    def _split(self, x: np.ndarray, rows: np.ndarray, rng) -> int:
        if len(rows) <= LEAF:
            self.leaves.append(rows)
            return ~(len(self.leaves) - 1)
        a, b = rng.choice(rows, 2, replace=False)
        normal = x[a] - x[b]
        length = float(np.sqrt((normal.astype(np.float64) ** 2).sum()))
        normal = normal / length if length > 0 else rng.standard_normal(x.shape[1]).astype(np.float32)
        along = x[rows] @ normal
        order = np.argpartition(along, len(rows) // 2)
        half = len(rows) // 2
        node = len(self.normals)
        self.normals.append(normal)
        self.cuts.append(float(along[order[half]]))
        self.children.append((0, 0))
        left, right = self._split(x, rows[order[:half]], rng), self._split(x, rows[order[half:]], rng)
        self.children[node] = (left, right)
        return node

    def candidates(self, queries: np.ndarray, share: float = SHARE) -> list[np.ndarray]:
        """Rows in the leaves that the shared queue opens, for each query."""
        total = max((len(x) for x in self.leaves), default=0) if not self.normals else sum(len(x) for x in self.leaves) // len(self.roots)
        want = max(LEAF, int(share * total))
        if not self.normals:
            return [np.concatenate(self.leaves)] * len(queries)
        lifted = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        margins = lifted @ np.stack(self.normals).T - np.array(self.cuts, dtype=np.float32)
        out = []
        for margin in margins:
            m = margin.tolist()
            seen = np.zeros(total, dtype=bool)
            queue = [(-np.inf, r) for r in self.roots]
            heapq.heapify(queue)
            found = opened = 0
            while queue and found < want:
                bound, node = heapq.heappop(queue)
                while node >= 0:
                    left, right = self.children[node]
                    d = m[node]
                    near, far = (right, left) if d >= 0 else (left, right)
                    heapq.heappush(queue, (max(bound, abs(d)), far))
                    node = near
                seen[self.leaves[~node]] = True
                opened += 1
                if opened % 16 == 0:
                    found = int(seen.sum())
            out.append(np.flatnonzero(seen))
        return out


def _search(top: int):
    def search(key, table):
        table = table.sort_by([("query", "ascending"), ("key", "ascending")])
        width = key[0].as_py()
        flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        asked = table["query"].to_numpy(zero_copy_only=False)
        ids = table["ids"].to_pylist()
        vectors, queries = flat[~asked], flat[asked].astype(np.float64)
        names = [ids[i] for i in np.flatnonzero(~asked)]
        whose = [(ids[i][0], k) for i, k in zip(np.flatnonzero(asked), table["key"].filter(table["query"]).to_pylist(), strict=True)]
        out: tuple[list, ...] = ([], [], [], [])
        if len(vectors) and len(queries):
            rough = queries.astype(vectors.dtype)
            # twice the rounding error of a product in single precision
            margins = 4 * width * 2.0**-23 * np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max() * (queries**2).sum(axis=1))
            for (own, own_key), q, q_rough, margin, rows in zip(whose, queries, rough, margins, Forest(vectors).candidates(queries), strict=True):
                if len(rows) > top + 1:
                    value = vectors[rows] @ q_rough
                    least = np.partition(value, len(value) - top - 1)[len(value) - top - 1]
                    rows = rows[~(value < least - margin)]
                value = (vectors[rows].astype(np.float64) * q).sum(axis=1)
                if len(rows) > top + 1:
                    least = np.partition(value, len(value) - top - 1)[len(value) - top - 1]
                    rows, value = rows[value >= least], value[value >= least]
                found = sorted((-v, name) for r, v in zip(rows.tolist(), value.tolist(), strict=True) for name in names[r] if name != own)[:top]
                for v, name in found:
                    for column, x in zip(out, (own, own_key, name, -v), strict=True):
                        column.append(x)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "key": pa.array(out[1], pa.int64()), "vec_id": pa.array(out[2], pa.int64()), "score": pa.array(out[3], pa.float64())})

    return search


def nearest(vectors: DataFrame, is_query: Column, top: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` largest inner products found for each query row of (vec_id, embedding)."""
    scratch = Scratch(vectors.sparkSession, "ann")
    fine = "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(fine).distinct()
    first = Window.partitionBy("embedding").orderBy("vec_id")
    classes = rows.withColumn("k", F.row_number().over(first)).where(f"k <= {top + 1}").groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    classes = scratch.table(classes.withColumn("width", F.size("embedding")), "classes")
    queries = scratch.table(rows.where(is_query), "queries")
    shards, blocks = max(1, -(-classes.count() // SHARD)), max(1, -(-queries.count() // QUERY_BLOCK))
    indexed = classes.select(
        "width", F.expr(f"cast(pmod(xxhash64(embedding), {shards}) as int)").alias("shard"), F.explode(F.expr(f"sequence(0, {blocks - 1})")).alias("block"),
        F.lit(False).alias("query"), F.xxhash64("embedding").alias("key"), "ids", F.col("embedding").alias("vector"),
    )
    asked = queries.select(
        F.size("embedding").alias("width"), F.explode(F.expr(f"sequence(0, {shards - 1})")).alias("shard"), F.expr(f"cast(pmod(xxhash64(vec_id), {blocks}) as int)").alias("block"),
        F.lit(True).alias("query"), F.xxhash64("embedding").alias("key"), F.array("vec_id").alias("ids"), F.col("embedding").alias("vector"),
    )
    found = indexed.unionByName(asked).groupBy("width", "shard", "block").applyInArrow(_search(top), "query_id long, key long, vec_id long, score double")
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(f"rank <= {top}").select("query_id", "rank", "vec_id", "score")

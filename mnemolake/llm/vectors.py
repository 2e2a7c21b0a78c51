"""Approximate nearest neighbours by learned partitions.

The index is learned on a bounded sample (FIT rows with the smallest hash of id; the documented bound): its exact
neighbour graph is cut into parts of equal capacity, so that neighbours share a part, and a small softmax classifier in
numpy learns the part of a vector. Every row of the table is then put into its most probable part. A query goes to its
most probable parts and is compared there with every row, in double precision, in blocks.

Parts grow with the table, one for PART_ROWS rows, between LEAST_PARTS and MOST_PARTS. How many a query probes is measured:
an eighth of the sample takes no part in the training, and the probes are the fewest that hold RECALL of its exact
neighbours in the sample. Clustered vectors need few; vectors without any structure need most of the parts, and then the
index saves little: `exact=True` compares with all rows and skips the learning.

Parts of the table are not of equal size (one vector may hold a third of all rows): a part is dealt out in slices of
at most SLICE rows, counted before the shuffle, and each query meets every slice of its parts. A task holds one slice and lets
the queries stream past it; it returns the slice's best k per query, no other pair leaves it. Scores near the k-th are computed again from the original vectors, row by
row in one fixed order, so equal vectors have equal scores and ties go to the smaller id.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors of
another length than most of the sample, nor null ids; with fewer than k candidates in the probed parts the query is
compared with all rows; repeated ids are rows of their own, and a row is no candidate of its own id's queries; only the id
and the vector are read, so other columns of any name do no harm.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop, map_batches, tune, written

FIT, PART_ROWS, LEAST_PARTS, MOST_PARTS, RECALL, SLICE, K, DEGREE, NEAR = 8192, 16_384, 32, 512, 0.95, 8192, 5, 10, 1e-9


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=-1, keepdims=True))


def neighbours(x: np.ndarray, degree: int) -> np.ndarray:
    """Exact nearest of each unit vector, itself left out, in blocks."""
    k = min(degree, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """A part for each vertex, at most ceil(1.1 n / parts) in each, moving vertices to where most of their neighbours are."""
    n, cap = len(x), -(-11 * len(x) // (10 * parts))
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(n, parts, replace=n < parts)]
    for _ in range(5):
        part = np.argmax(x @ centre.T, axis=1)
        total = np.zeros((parts, x.shape[1]))
        np.add.at(total, part, x)
        centre = np.where(np.abs(total).sum(axis=1, keepdims=True) > 0, total / np.maximum(np.sqrt((total * total).sum(axis=1, keepdims=True)), 1e-12), centre)
    near = x @ centre.T
    part = np.full(n, -1)
    size = np.zeros(parts, np.int64)
    for i in np.argsort(-near.max(axis=1), kind="stable").tolist():
        for p in np.argsort(-near[i], kind="stable").tolist():
            if size[p] < cap:
                part[i], size[p] = p, size[p] + 1
                break
    both = [set() for _ in range(n)]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            both[i].add(j)
            both[j].add(i)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n).tolist():
            votes = np.bincount(part[list(both[i])], minlength=parts) if both[i] else np.zeros(parts)
            best = int(np.argmax(votes))
            if votes[best] > votes[part[i]] and size[best] < cap:
                size[part[i]] -= 1
                size[best] += 1
                part[i], moved = best, moved + 1
        if not moved:
            break
    return part


class Router:
    """Softmax over parts; full-batch Adam towards each sample vector's part and the parts of its neighbours, half each."""

    def __init__(self, x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, steps: int = 300):
        x1 = np.hstack([x, np.ones((len(x), 1))])
        self.dim, self.w, self.probes, self.recall = x.shape[1], np.zeros((x1.shape[1], parts)), parts, 1.0
        if parts == 1:
            return
        m, v, goal = np.zeros_like(self.w), np.zeros_like(self.w), np.eye(parts)[part]
        if graph.shape[1]:
            goal = goal / 2 + np.eye(parts)[part[graph]].mean(axis=1) / 2
        for t in range(1, steps + 1):
            z = x1 @ self.w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = x1.T @ (p / p.sum(axis=1, keepdims=True) - goal) / len(x) + 1e-4 * self.w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def measure(self, asked: np.ndarray, rows: np.ndarray, k: int, goal: float) -> None:
        """Set the fewest probes with which unit vectors that were not trained on find this share of their k nearest rows."""
        s = asked @ rows.T
        near = np.argpartition(-s, min(k, len(rows)) - 1, axis=1)[:, :k]
        order = self.order(asked, self.w.shape[1])
        place = np.argsort(order, axis=1)[np.arange(len(asked))[:, None], self.order(rows, 1)[near, 0]]
        share = np.bincount(place.ravel(), minlength=order.shape[1]).cumsum() / place.size
        self.probes = int(np.argmax(share >= goal - 1e-12)) + 1
        self.recall = float(share[self.probes - 1])

    def order(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The most probable parts of unit vectors, the first first."""
        return np.argsort(-(x @ self.w[:-1] + self.w[-1]), axis=1, kind="stable")[:, :probes]


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles; which rows are usable."""
    rows = column.to_pylist()
    out, ok = np.zeros((len(rows), dim)), np.zeros(len(rows), bool)
    for i, r in enumerate(rows):
        if r is not None and len(r) == dim and None not in r:
            v = np.array(r, np.float64)
            if np.isfinite(v).all() and (v != 0).any():
                out[i], ok[i] = v, True
    return out, ok


def fit(vectors: DataFrame, *, vec_id: str, embedding: str, fit_rows: int = FIT, parts: int | None = None, k: int = K, recall: float = RECALL) -> Router | None:
    """parts: as many as the table's rows ask for, unless given; 1 learns nothing and sends every query to every row."""
    sample = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).select(embedding, F.xxhash64(vec_id).alias("h"), vec_id).orderBy("h", vec_id).limit(fit_rows).select(embedding).toArrow().column(0).combine_chunks()
    sizes = [len(r) for r in sample.to_pylist()]
    if not sizes:
        return None
    x, ok = _matrix(sample, max(set(sizes), key=lambda n: (sizes.count(n), n)))
    if not ok.any():
        return None
    x = np.unique(unit(x[ok]), axis=0)
    if parts is None:
        parts = min(max(LEAST_PARTS, vectors.count() // PART_ROWS), MOST_PARTS)
    parts = max(1, min(parts, len(x) // 10))
    if parts == 1:
        return Router(x, np.zeros(len(x), np.int64), np.zeros((len(x), 0), np.int64), 1)
    apart = np.random.default_rng(5).permutation(len(x)) < len(x) // 8
    held, rest = x[apart], x[~apart]
    graph = neighbours(rest, DEGREE)
    router = Router(rest, balanced_parts(rest, graph, parts), graph, parts)
    router.measure(held, rest, k, recall)
    return router


def _best(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int):
    """Per query: its k best of these rows as (query, row, score), ties to the smaller id."""
    qu, xu = unit(q), unit(x)
    for a in range(0, len(q), 256):
        s = qu[a : a + 256] @ xu.T
        s[q_id[a : a + 256, None] == x_id[None, :]] = -np.inf
        kth = np.partition(s, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(s), -np.inf)
        for i in range(len(s)):
            at = np.flatnonzero((s[i] >= kth[i] - NEAR) & (s[i] > -np.inf))
            v = q[a + i]
            exact = (x[at] * v).sum(axis=1) / (np.sqrt((x[at] * x[at]).sum(axis=1)) * np.sqrt((v * v).sum()))
            best = np.lexsort((x_id[at], -exact))[:k]
            yield from zip([int(q_id[a + i])] * len(best), x_id[at[best]].tolist(), exact[best].tolist(), strict=True)


def _search_slices(rows: DataFrame, dim: int, k: int) -> DataFrame:
    """rows (part, slice, is_query, id, v) sorted by part, slice, is_query: a slice is held, then queries stream past it."""

    def run(batches):
        group, held, x, x_id = None, [], None, None
        for b in batches:
            part, sl, kind = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            ids, v = b.column(3).to_numpy(), np.frombuffer(b"".join(b.column(4).to_pylist()), "<f8").reshape(-1, dim)
            cut = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (sl[1:] != sl[:-1]) | (kind[1:] != kind[:-1])]))
            found: list = []
            for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True):
                if (part[a], sl[a]) != group:
                    group, held, x = (part[a], sl[a]), [], None
                if not kind[a]:
                    held.append((ids[a:z].copy(), v[a:z].copy()))
                elif held:
                    if x is None:
                        x_id, x = (np.concatenate(c) for c in zip(*held, strict=True))
                    found += _best(v[a:z], ids[a:z], x, x_id, k)
            if found:
                yield pa.RecordBatch.from_pydict({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, exact: bool = False, probes: int | None = None, parts: int | None = None, fit_rows: int = FIT, slice_rows: int = SLICE, recall: float = RECALL) -> DataFrame:
    """Per query: query_id, rank, vec_id, score of its k nearest found. queries has the columns of vectors.

    probes and parts are measured unless given; exact compares every query with every row.
    """
    spark = tune(vectors.sparkSession)
    router = fit(vectors, vec_id=vec_id, embedding=embedding, fit_rows=fit_rows, parts=1 if exact else parts, k=k, recall=recall)
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    bc, dim = spark.sparkContext.broadcast(router), router.dim  # (dimension + 1) x parts doubles

    def placed(df: DataFrame, n: int) -> DataFrame:
        def make():
            def run(batch):
                x, ok = _matrix(batch.column(1), dim)
                order = np.full((len(x), 0), 0).tolist() if not ok.any() else bc.value.order(unit(np.where(ok[:, None], x, 1.0)), n).tolist()
                return [[o if good else None for o, good in zip(order, ok.tolist(), strict=True)] if ok.any() else [None] * len(x), [row.tobytes() for row in x.astype("<f8")]]

            return run

        return map_batches(df.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), embedding), make, [("parts", "array<int>"), ("v", "binary")], ["id"]).where("parts IS NOT NULL")

    rows = written(placed(vectors, 1).select("id", F.element_at("parts", 1).alias("part"), "v"), "placed")
    sizes = rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("slices"))  # one row per part
    sizes = {r["part"]: r["slices"] for r in sizes.collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    slices = F.create_map(*chain.from_iterable((F.lit(p), F.lit(n)) for p, n in sizes.items()))
    dealt = rows.select("part", F.pmod(F.xxhash64("id"), slices[F.col("part")]).cast("int").alias("slice"), F.lit(0).alias("is_query"), "id", "v")
    asked = written(placed(queries, router.w.shape[1]), "asked")

    def ask(df: DataFrame, n: int) -> DataFrame:
        sent = df.select("id", "v", F.explode(F.slice("parts", 1, n)).alias("part"))
        sent = sent.withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce(slices[F.col("part")], F.lit(1)) - 1)))
        both = sent.select("part", "slice", F.lit(1).alias("is_query"), "id", "v").union(dealt)
        return _search_slices(both.repartition("part", "slice").sortWithinPartitions("part", "slice", "is_query", "id"), dim, k)

    top = written(_top(ask(asked, probes or router.probes), k), "nearest")
    few = asked.select(F.col("id").alias("query_id")).distinct().join(top.groupBy("query_id").count(), "query_id", "left").where(F.coalesce("count", F.lit(0)) < k).select("query_id")
    few = written(few, "few")
    if not few.isEmpty():
        again = asked.join(few, asked.id == few.query_id, "left_semi")
        top = written(top.join(few, "query_id", "left_anti").union(_top(ask(again, router.w.shape[1]), k)), "nearest")
    drop(rows, asked, few)
    return top


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = documents(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = None

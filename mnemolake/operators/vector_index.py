"""A vector index that follows writes: coarse cells, residual product codes, exact reranking.

Rows lie in folders by their cell, the one with the nearest centre; beside each original vector stands a code of a few
bytes, the nearest entry of one codebook for each slice of what the centre leaves over. A search scores the codes of the
cells nearest to each query, which reads ids and codes alone, and reranks the best `short * k` by their original vectors.
A map from ids to cells, dealt out by the hash of the id, tells a write which cells hold the old rows; it rewrites these
cells and the new ones and publishes both by one version file, as `sources.Snapshots` does.

Centres and codebooks are fitted once, on a sample of at most SAMPLE rows; all rows are indexed. `probes` is the fewest
cells that hold TARGET of the neighbours of sample rows that the fit has not seen. Vectors that are null, zero, of another
length or with components that are null or not finite take no part. A write that brings such a vector for a known id
removes the id. Of repeated ids in one write one row counts, the one with the largest vector in array order.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.snapshots import Snapshots, _bucket
from .search import ranked, small

#: Rows of the fit; share of true neighbours that the probed cells are to hold; queries that one pass takes; rows for each cell.
SAMPLE, TARGET, BATCH, PER_CELL = 8192, 0.98, 4096, 512
_ROW = "id long, _bucket int, code binary, embedding array<float>"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres of k-means; an empty one moves to a random row."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


class Model:
    """Centres (cells, dim) and codebooks (slices, entries, dim / slices); a few megabytes at most."""

    def __init__(self, centres: np.ndarray, books: np.ndarray, probes: int):
        self.centres, self.books, self.probes = centres, books, probes

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, slices: int | None, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        x = _unit(sample)[rng.permutation(len(sample))]
        dim = x.shape[1]
        slices = slices or max(s for s in range(1, dim + 1) if dim % s == 0 and s <= max(1, dim // 2))
        seen, held = x[: max(1, len(x) * 7 // 8)], x[len(x) * 7 // 8 :][:512]
        centres = _means(seen, max(1, min(rows // PER_CELL + 1, 1024, len(seen) // 8 or 1)), rng)
        rest = (seen - centres[_nearest(seen, centres)]).reshape(len(seen), slices, dim // slices)
        books = np.stack([_means(rest[:, s], min(256, len(seen)), rng, 8) for s in range(slices)])
        probes = len(centres)
        if len(held) and len(seen) > 10:
            close = np.argpartition(-(held @ seen.T), 10, axis=1)[:, :10]
            places = np.argsort(np.argsort(-(held @ centres.T), axis=1), axis=1)
            probes = int(np.quantile(np.take_along_axis(places, _nearest(seen, centres)[close], 1), TARGET, method="higher")) + 1
        return cls(centres, books, probes)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell and the code of each row."""
        x = _unit(x)
        cell = _nearest(x, self.centres)
        slices, _, width = self.books.shape
        rest = (x - self.centres[cell]).reshape(len(x), slices, width)
        return cell, np.stack([_nearest(rest[:, s], self.books[s]) for s in range(slices)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Of unit queries: the part of the cosine that each entry of each codebook gives (queries, slices, entries)."""
        slices, _, width = self.books.shape
        return np.einsum("qsw,sew->qse", q.reshape(len(q), slices, width), self.books)


def usable(rows: DataFrame, column: str, dim: int) -> DataFrame:
    """The rows whose vector can be compared."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.where((F.size(column) == dim) & F.forall(column, ok) & F.exists(column, lambda x: x != 0))


class VectorIndex(Snapshots):
    """`merge(batch, rows (id, embedding), gone (id))` as for any stored snapshot; `search` and `exact`."""

    def build(self, batch: str, rows: DataFrame, slices: int | None = None) -> bool:
        """Fit the model and index all rows; false if the batch was applied before."""
        number, content = self.version()
        if batch in content["batches"]:
            return False
        if number:
            raise ValueError("the index exists; merge into it")
        first = rows.where(F.size("embedding") > 0).select(F.size("embedding").alias("n")).first()
        if first is None:
            raise ValueError("no vector to fit the index on")
        good = usable(rows, "embedding", first["n"])
        n = good.count()
        if not n:
            raise ValueError("no vector to fit the index on")
        share = good if n <= SAMPLE else good.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.2 * SAMPLE / n)) + 1)
        sample = np.array([r[0] for r in share.select("embedding").limit(SAMPLE).collect()], dtype=np.float64)
        m = Model.fit(sample, n, slices)
        self._save(m)
        return self.merge(batch, rows)

    def _save(self, m: Model) -> None:
        out = self._fs.create(self._p(f"{self.path}/versions/model"), True)
        out.write(json.dumps({"centres": m.centres.tolist(), "books": m.books.tolist(), "probes": m.probes}).encode())
        out.close()

    def model(self) -> Model:
        stream = self._fs.open(self._p(f"{self.path}/versions/model"))
        try:
            d = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Model(np.array(d["centres"]), np.array(d["books"]), d["probes"])

    def _cells(self, content: dict, cells: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{f}/_bucket={k}" for k, f in content["buckets"].items() if cells is None or int(k) in cells]
        return self._table(paths, _ROW)

    def _map(self, content: dict, touched: list[int]) -> DataFrame:
        return self._table([f"{self.path}/{f}/_bucket={k}" for k, f in content.get("ids", {}).items() if int(k) in touched], "id long, cell int")

    def _table(self, paths: list[str], schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*paths).select(empty.columns) if paths else empty

    def _put(self, rows: DataFrame) -> dict[str, str]:
        """The folder of each bucket of rows, written anew; a bucket with very many rows is written by several tasks."""
        name = f"_v={uuid.uuid4().hex}"  # a partition column too, so that one scan reads folders of many writes
        rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        written = [s.getPath().getName() for s in self._fs.listStatus(self._p(f"{self.path}/{name}"))]
        return {w.partition("=")[2]: name for w in written if w.startswith("_bucket=")}

    def merge(self, batch: str, rows: DataFrame | None = None, gone: DataFrame | None = None) -> bool:
        """Put these vectors in place of those of their ids and drop the ids of gone; false if the batch was applied before."""
        m = self.model()
        dim = m.centres.shape[1]

        def encoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                if len(p):
                    cell, code = m.encode(_stack(p["embedding"]))
                    yield pd.DataFrame({"id": p["id"], "_bucket": cell.astype(np.int32), "code": [c.tobytes() for c in code], "embedding": p["embedding"]})

        while True:
            number, content = self.version()
            if batch in content["batches"]:
                return False
            asked = [d.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id")) for d in (rows, gone) if d is not None]
            if not asked:
                return False
            ids = (asked[0] if len(asked) == 1 else asked[0].union(asked[1])).distinct()
            slots = [r[0] for r in ids.select(_bucket(self.buckets)).distinct().collect()]  # `buckets` numbers at most
            known = self._map(content, slots)
            new = None
            if rows is not None:
                one = rows.where("id IS NOT NULL").groupBy(F.col("id").cast("long").alias("id")).agg(F.max(F.col("embedding").cast("array<float>")).alias("embedding"))
                new = usable(one, "embedding", dim).mapInPandas(encoded, _ROW)
                folder = self._put(new)
                new = self._table([f"{self.path}/{f}/_bucket={k}" for k, f in folder.items()], _ROW)
            left = known.join(ids, "id", "left_anti")
            if new is not None:
                left = left.unionByName(new.select("id", F.col("_bucket").alias("cell")))
            # a cell is touched by what it loses and by what it gains; there are as many numbers as centres at most
            cells = {r[0] for r in known.join(ids, "id", "left_semi").select("cell").distinct().collect()} | ({int(k) for k in folder} if new is not None else set())
            held = self._cells(content, sorted(cells)).join(ids, "id", "left_anti")
            body = held.select("id", "_bucket", "code", "embedding")
            put = self._put(body.unionByName(new.select("id", "_bucket", "code", "embedding")) if new is not None else body) if cells else {}
            slotted = self._put(left.withColumn("_bucket", _bucket(self.buckets))) if slots else {}
            kept = {k: f for k, f in content["buckets"].items() if int(k) not in cells}
            kept_ids = {k: f for k, f in content.get("ids", {}).items() if int(k) not in slots}
            if self._publish(number + 1, {"schema": _ROW, "batches": [*content["batches"], batch], "buckets": kept | put, "ids": kept_ids | slotted}):
                return True

    def read(self, number: int | None = None) -> DataFrame:
        """id, embedding of all rows."""
        return self._cells(self.version()[1] if number is None else self._content(number)).select("id", "embedding")

    def vacuum(self) -> None:
        number, content = self.version()
        keep = {"versions", *content["buckets"].values(), *content.get("ids", {}).values()}
        for s in self._fs.listStatus(self._p(self.path)):
            if s.getPath().getName() not in keep:
                self._fs.delete(s.getPath(), True)
        for s in self._fs.listStatus(self._p(f"{self.path}/versions")):
            if s.getPath().getName() not in (f"{number:09d}", "model"):
                self._fs.delete(s.getPath(), True)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, short: int = 16) -> DataFrame:
        """(query_id, id, score, rank) of the k rows of largest cosine found for each query (query_id, qv)."""
        m, content = self.model(), self.version()[1]
        good = usable(queries.select("query_id", F.col("qv").cast("array<float>").alias("qv")), "qv", m.centres.shape[1])
        passes = -(-good.count() // BATCH) or 1
        out = None
        for i in range(passes):
            part = good if passes == 1 else good.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
            found = self._pass(part, m, content, k, probes or m.probes, short)
            out = found if out is None else out.unionByName(found)
        return out

    def _pass(self, queries: DataFrame, m: Model, content: dict, k: int, probes: int, short: int) -> DataFrame:
        asked = queries.orderBy("query_id").collect()  # about BATCH vectors
        if not asked:
            return self.spark.createDataFrame([], "query_id long, id long, score double, rank int")
        names = np.array([r["query_id"] for r in asked])
        q = _unit(np.array([r["qv"] for r in asked], dtype=np.float64))
        near = np.argsort(-(q @ m.centres.T), axis=1)[:, :probes]
        sent = self.spark.sparkContext.broadcast((names, q, near, m))  # BATCH queries and one model: bounded by both
        few = short * k

        def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q, near, m = sent.value
            by_cell: dict[int, list[int]] = {}
            for i, cells in enumerate(near):
                for c in cells:
                    by_cell.setdefault(int(c), []).append(i)
            for p in parts:
                for cell, g in p.groupby("_bucket"):
                    code = np.frombuffer(b"".join(g["code"]), dtype=np.uint8).reshape(len(g), -1).astype(np.int64)
                    ids, at = g["id"].to_numpy(), np.arange(code.shape[1])
                    for lo in range(0, len(by_cell.get(int(cell), [])), 64):
                        who = np.array(by_cell[int(cell)][lo : lo + 64])
                        t = m.tables(q[who])
                        s = np.stack([row[at, code].sum(1) for row in t]) + (q[who] @ m.centres[int(cell)])[:, None]
                        top = np.argsort(-s, axis=1)[:, :few]
                        yield pd.DataFrame({"query_id": np.repeat(names[who], top.shape[1]), "id": ids[top].ravel(), "cell": np.int32(cell), "near": np.take_along_axis(s, top, 1).ravel()})

        wanted = sorted({int(c) for c in near.ravel()})
        cells = self._cells(content, wanted)
        hits = cells.select("id", "_bucket", "code").mapInPandas(scored, "query_id long, id long, cell int, near double")
        best = ranked(hits, [F.desc("near"), F.col("id")], few).select("query_id", "id", "cell")
        vectors = cells.select("id", F.col("_bucket").alias("cell"), "embedding")
        return _reranked(best.join(vectors, ["cell", "id"]), queries, k)

    def exact(self, queries: DataFrame, k: int) -> DataFrame:
        """The same from all rows by their original vectors."""
        dim = self.model().centres.shape[1]
        good = usable(queries.select("query_id", F.col("qv").cast("array<float>").alias("qv")), "qv", dim)
        return _reranked(self.read().join(small(good.select("query_id"))), good, k)

    def share(self, queries: DataFrame, probes: int | None = None) -> float:
        """The mean share of all rows whose codes a query reads."""
        m, content = self.model(), self.version()[1]
        sizes = np.zeros(len(m.centres))
        for r in self._cells(content).groupBy("_bucket").count().collect():
            sizes[r["_bucket"]] = r["count"]
        q = _unit(np.array([r["qv"] for r in usable(queries, "qv", m.centres.shape[1]).limit(BATCH).collect()], dtype=np.float64))
        near = np.argsort(-(q @ m.centres.T), axis=1)[:, : probes or m.probes]
        return float(sizes[near].sum(1).mean() / sizes.sum())


def _reranked(pairs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The first k of each query among pairs (query_id, id, embedding) by the cosine in double precision; ties go to the smaller id."""

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = _stack(a), _stack(b)
        return pd.Series((x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)))

    scored = pairs.join(small(queries.select("query_id", "qv")), "query_id").select("query_id", "id", cosine("embedding", "qv").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")

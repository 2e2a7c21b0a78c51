"""A full-text index that follows writes: immutable segments, tombstones, merging, and BM25 with pruned blocks.

A write makes a segment: the postings of its rows, a block for each token and range of ids, with the number of rows, the
largest frequency and the smallest length in it; and its documents with their lengths. Rows that are written again or
deleted get a tombstone, which carries what the statistics lose. The texts are dealt out by range of ids, once; a range's
blocks are made and written where its texts lie, so that no posting is shuffled. A version file lists segments and tombstones and is
published by a rename that fails where the number is taken, so readers see a whole version and a stopped writer leaves
the one before. Merging rewrites the live rows of all segments as one.

A batch of queries reads the headers of its tokens' blocks first. A range of ids can score at most the sum of its blocks'
bounds; the ranges of largest bounds are scored, the k-th best of them is a threshold, and only ranges that can reach it
are read as well. What is pruned cannot be among the first k, so results are those of a full scan. Phrases of several
tokens are evaluated wherever all their tokens have blocks, as their frequency is not known otherwise.

Ids are longs. A null text has no tokens; a row without tokens counts as a document of length 0.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fts_tokens
from ..sources.scratch import cut
from .search import K1, B, ranked, small

BUCKETS, SPAN, SEEDS, EPS = 64, 128, 3, 1e-8
#: Bytes of text that one task makes into blocks, and tokens that it holds beside the range in hand.
TASK_BYTES, HOLD = 24 << 20, 1 << 19
_FIELDS = ("content", "type", "tags")
_BLOCK = "token string, range long, n long, max_f long, min_d long, entries array<struct<id: bigint, d: bigint, f: bigint, at: array<struct<field: int, pos: int>>>>"
_DOC = "id long, d long, tokens array<string>"
#: A segment is one table: blocks in their buckets, documents in bucket -1.
_SEGMENT = f"{_BLOCK}, {_DOC}, bucket int"
_HEAD = ["token", "range", "n", "max_f", "min_d"]
_PLACE = pa.struct([("field", pa.int32()), ("pos", pa.int32())])
_ENTRY = pa.struct([("id", pa.int64()), ("d", pa.int64()), ("f", pa.int64()), ("at", pa.list_(_PLACE))])
_ARROW = pa.schema([("token", pa.string()), ("range", pa.int64()), ("n", pa.int64()), ("max_f", pa.int64()), ("min_d", pa.int64()), ("entries", pa.list_(_ENTRY)), ("id", pa.int64()), ("d", pa.int64()), ("tokens", pa.list_(pa.string()))])


def _bucket(token: str = "token") -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _weight(f: Column, d: Column, mean: Column) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * d / mean))


def _made(table: pa.Table, span: int) -> pa.RecordBatch:
    """The blocks and documents of whole ranges: rows (id, content, type, tags) of tokens, ordered by id."""
    table = table.combine_chunks()
    ids, rows = table.column("id").to_numpy(), table.num_rows
    lists = [table.column(c).chunk(0) for c in _FIELDS]
    sizes = [x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
    length = sum(sizes)
    key, doc = np.unique(np.stack([ids, length], 1), axis=0, return_inverse=True)  # rows of one id and length count as one
    doc, ids, length = doc.reshape(-1), key[:, 0], key[:, 1]
    token = pa.concat_arrays([x.flatten().cast(pa.string()) for x in lists]).dictionary_encode()
    code, names = token.indices.to_numpy().astype(np.int64), token.dictionary
    field = np.repeat(np.arange(len(lists), dtype=np.int32), [n.sum() for n in sizes])
    pos = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in sizes]).astype(np.int32)
    pair = code * len(ids) + doc[np.concatenate([np.repeat(np.arange(rows), n) for n in sizes])]
    order = np.argsort(pair, kind="stable")
    pair, starts = np.unique(pair[order], return_index=True)
    code, doc, f = pair // len(ids), pair % len(ids), np.diff(np.append(starts, len(order)))
    at = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(field[order]), pa.array(pos[order])], ["field", "pos"]))
    entries = pa.StructArray.from_arrays([pa.array(ids[doc]), pa.array(length[doc]), pa.array(f), at], ["id", "d", "f", "at"])
    span_of = ids[doc] // span
    first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (span_of[1:] != span_of[:-1]))) if len(code) else np.zeros(0, np.int64)
    ends = np.append(first, len(code))
    blocks = [names.take(pa.array(code[first])), pa.array(span_of[first]), pa.array(np.diff(ends)), pa.array(np.maximum.reduceat(f, first) if len(first) else f), pa.array(np.minimum.reduceat(length[doc], first) if len(first) else f), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries)]
    whole, of = np.unique(ids, return_index=True)
    number = np.cumsum(np.append(0, (ids[1:] != ids[:-1]).astype(np.int64)))[doc]
    held = np.unique(number * max(len(names), 1) + code)
    offsets = np.searchsorted(held // max(len(names), 1), np.arange(len(whole) + 1)).astype(np.int32)
    docs = [pa.array(whole), pa.array(length[of]), pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(held % max(len(names), 1))))]
    b, d = len(first), len(whole)
    columns = [pa.concat_arrays([c, pa.nulls(d, c.type)]) for c in blocks] + [pa.concat_arrays([pa.nulls(b, c.type), c]) for c in docs]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _tokens(table: pa.Table) -> int:
    return sum(pa.compute.sum(pa.compute.list_value_length(table.column(c))).as_py() or 0 for c in _FIELDS)


def _blocks_of(span: int):
    """A pass over token lists (id, content, type, tags), whole ranges in the order of their ids: what a segment holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        nameless = None
        for b in batches:
            part = pa.Table.from_batches([b])
            if part.column("id").null_count:  # rows without an id are found by no query and count as one document
                lost = part.filter(pa.compute.is_null(part.column("id")))
                nameless = (nameless or 0) + _tokens(lost)
                part = part.filter(pa.compute.is_valid(part.column("id")))
            held = part if held is None else pa.concat_tables([held, part])
            if _tokens(held) > HOLD:
                ranges = held.column("id").to_numpy() // span
                done = int(np.searchsorted(ranges, ranges[-1]))
                if done:
                    yield _made(held.slice(0, done), span)
                    held = held.slice(done)
        if held is not None and held.num_rows:
            yield _made(held, span)
        if nameless is not None:
            yield pa.RecordBatch.from_pylist([{"d": nameless, "tokens": []}], schema=_ARROW)

    return run


class SegmentedIndex:
    def __init__(self, spark: SparkSession, path: str, span: int = SPAN):
        self.spark, self.path, self.span, self.read = spark, path.rstrip("/"), span, None
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._p = jvm.org.apache.hadoop.fs.Path
        root = self._p(self.path)
        self._fs = root.getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf)
        self._rename = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self._fs.mkdirs(self._p(f"{self.path}/versions"))

    # versions
    def version(self) -> tuple[int, dict]:
        """The number and content of the last version: segments {name: [documents, tokens]} and tombstone folders {name: [documents, tokens]}."""
        numbers = [int(s.getPath().getName()) for s in self._fs.listStatus(self._p(f"{self.path}/versions")) if s.getPath().getName().isdigit()]
        if not numbers:
            return 0, {"segments": {}, "dead": {}}
        stream = self._fs.open(self._p(f"{self.path}/versions/{max(numbers):09d}"))
        try:
            return max(numbers), json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, number: int, content: dict) -> bool:
        draft = self._p(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(json.dumps(content).encode())
        out.close()
        try:
            self._files.rename(draft, self._p(f"{self.path}/versions/{number:09d}"), self._rename)
            return True
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if not e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise
            return False

    # writes
    def _segment(self, made: DataFrame) -> dict[str, list[int]]:
        """A new segment of blocks and documents (without their buckets), with its number of documents and tokens."""
        name = uuid.uuid4().hex
        made = made.withColumn("bucket", F.when(F.col("token").isNull(), -1).otherwise(_bucket()))
        made.sortWithinPartitions("bucket", "token", "range").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        n = self._docs(name).agg(F.count(F.lit(1)), F.coalesce(F.sum("d"), F.lit(0))).first()
        return {name: [n[0], n[1]]}

    def _docs(self, segment: str) -> DataFrame:
        return self.spark.read.schema(_SEGMENT).parquet(f"{self.path}/{segment}").where("bucket = -1").select("id", "d", "tokens")

    def _documents(self, content: dict) -> DataFrame:
        """(segment, id, d, tokens) of all live documents."""
        out = None
        for s in content["segments"]:
            one = self._docs(s).withColumn("segment", F.lit(s))
            out = one if out is None else out.union(one)
        if out is None:
            return self.spark.createDataFrame([], _DOC + ", segment string")
        return out.join(self._dead(content), ["segment", "id"], "left_anti") if content["dead"] else out

    def _dead(self, content: dict) -> DataFrame:
        """(segment, id) of the rows under tombstones."""
        return self.spark.read.schema("segment string, id long").parquet(*(f"{self.path}/{d}/ids" for d in content["dead"]))

    def _tombstones(self, content: dict, ids: DataFrame) -> dict[str, list[int]]:
        """Bury the live rows of ids: which they are, and how many of them held each token."""
        gone = cut(self._documents(content).join(ids.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi"))
        n = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("d"), F.lit(0))).first()
        if not n[0]:
            return {}
        name = uuid.uuid4().hex
        gone.select("segment", "id").write.parquet(f"{self.path}/{name}/ids")
        gone.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/{name}/tokens")
        return {name: [n[0], n[1]]}

    def upsert(self, rows: DataFrame) -> int:
        """Write rows (id, content, type, tags), in place of those of the same ids; the number of the version that has them."""
        rows = rows.select(F.col("id").cast("long").alias("id"), *_FIELDS)
        size = rows.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in _FIELDS), F.lit(0)))).first()[0] or 0
        dealt = rows.repartition(int(size // TASK_BYTES) + 1, F.floor(F.col("id") / self.span)).sortWithinPartitions("id")
        tokens = dealt.select("id", *(F.coalesce(fts_tokens(F.col(c)), F.array().cast("array<string>")).alias(c) for c in _FIELDS))
        new = self._segment(tokens.mapInArrow(_blocks_of(self.span), f"{_BLOCK}, {_DOC}"))
        while True:
            number, content = self.version()
            dead = self._tombstones(content, rows) if content["segments"] else {}
            if self._publish(number + 1, {"segments": content["segments"] | new, "dead": content["dead"] | dead}):
                return number + 1

    def delete(self, ids: DataFrame) -> int:
        """Bury the rows of ids (id)."""
        while True:
            number, content = self.version()
            dead = self._tombstones(content, ids)
            if not dead or self._publish(number + 1, content | {"dead": content["dead"] | dead}):
                return number + bool(dead)

    def merge(self) -> int:
        """All live rows as one segment without tombstones. Gives way to a write that comes meanwhile; the old files stay until `vacuum`."""
        number, content = self.version()
        rows = self._blocks(content).select("segment", "token", F.explode("entries").alias("e")).select("segment", "token", "e.*")
        rows = rows.join(self._dead(content), ["segment", "id"], "left_anti") if content["dead"] else rows
        blocks = rows.groupBy("token", F.floor(F.col("id") / self.span).alias("range")).agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("max_f"), F.min("d").alias("min_d"), F.sort_array(F.collect_list(F.struct("id", "d", "f", "at"))).alias("entries"))
        # a frequent token is one value of the hash: its blocks are dealt out by range as well
        blocks = blocks.repartition(_bucket(), F.pmod("range", F.lit(4)))
        new = self._segment(blocks.unionByName(self._documents(content).select("id", "d", "tokens"), allowMissingColumns=True))
        return number + 1 if self._publish(number + 1, {"segments": new, "dead": {}}) else number

    def vacuum(self) -> list[str]:
        """Delete what the last version does not name; for times without readers of older versions and without writers."""
        number, content = self.version()
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p(self.path))]
        old = [n for n in names if n != "versions" and n not in content["segments"] and n not in content["dead"]]
        for n in old:
            self._fs.delete(self._p(f"{self.path}/{n}"), True)
        return old

    # reads
    def _blocks(self, content: dict, buckets: list[int] | None = None) -> DataFrame:
        out = None
        for s in content["segments"]:
            one = self.spark.read.schema(_SEGMENT).parquet(f"{self.path}/{s}").where("bucket >= 0").drop("id", "d", "tokens").withColumn("segment", F.lit(s))
            out = one if out is None else out.union(one)
        if out is None:
            return self.spark.createDataFrame([], _BLOCK + ", bucket int, segment string")
        return out if buckets is None else out.where(F.col("bucket").isin(buckets))

    def _prepared(self, queries: DataFrame):
        """What a batch needs: statistics, terms (query_id, name, len, times, idf), headers of blocks and the phrases' postings."""
        _, content = self.version()
        total = sum(n for n, _ in content["segments"].values()) - sum(n for n, _ in content["dead"].values())
        tokens = sum(n for _, n in content["segments"].values()) - sum(n for _, n in content["dead"].values())
        mean = F.lit(tokens / total if total and tokens else 1.0)
        words = queries.select("query_id", F.explode(F.split("q", r"\s+")).alias("w")).select("query_id", fts_tokens(F.col("w")).alias("phrase")).where(F.size("phrase") > 0)
        terms = cut(words.groupBy("query_id", F.array_join("phrase", " ").alias("name"), F.size("phrase").alias("len")).agg(F.count(F.lit(1)).alias("times"), F.first("phrase").alias("phrase")))
        elements = cut(terms.select("name", "len", F.posexplode("phrase").alias("j", "token")).distinct())
        buckets = [r[0] for r in elements.select(_bucket()).distinct().collect()]  # BUCKETS numbers at most
        blocks = self._blocks(content, buckets)
        heads = cut(blocks.select("segment", *_HEAD).join(small(elements.select("token").distinct()), "token"))
        lost = None
        if content["dead"]:
            lost = self.spark.read.schema("token string, n long").parquet(*(f"{self.path}/{d}/tokens" for d in content["dead"])).groupBy("token").agg(F.sum("n").alias("lost"))
        df = heads.groupBy("token").agg(F.sum("n").alias("df"))
        df = df.join(lost, "token", "left").select("token", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df")) if lost is not None else df
        counts = df.withColumnRenamed("token", "name")
        several = elements.where("len > 1")
        found = None
        if not several.isEmpty():
            have = heads.select("segment", "token", "range").join(small(several), "token").groupBy("name", "len", "segment", "range").agg(F.count_distinct("token").alias("have"))
            wanted = have.join(several.groupBy("name").agg(F.count_distinct("token").alias("all")), "name").where("have = all").select("name", "segment", "range")
            found = cut(self._phrases(content, blocks, several, wanted))
            counts = counts.union(found.groupBy("name").agg(F.count(F.lit(1)).alias("df")))
        idf = F.log((F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        terms = cut(terms.select("query_id", "name", "len", "times").join(counts, "name").where("df > 0").select("query_id", "name", "len", "times", F.when(idf > 0, idf).otherwise(1e-6).alias("idf")))
        return content, mean, terms, heads, blocks, found

    def _live(self, content: dict, rows: DataFrame) -> DataFrame:
        return rows.join(small(self._dead(content)), ["segment", "id"], "left_anti") if content["dead"] else rows

    def _phrases(self, content: dict, blocks: DataFrame, several: DataFrame, wanted: DataFrame) -> DataFrame:
        """(name, segment, range, id, d, f): where all elements of a phrase stand one after the other."""
        read = wanted.join(several, "name").select("token", "segment", "range", "name", "len", "j")
        rows = blocks.join(small(read), ["token", "segment", "range"]).select("name", "len", "j", "segment", "range", F.explode("entries").alias("e"))
        at = self._live(content, rows.select("name", "len", "j", "segment", "range", "e.id", "e.d", F.explode("e.at").alias("p")))
        starts = at.groupBy("name", "len", "segment", "range", "id", "d", F.col("p.field").alias("field"), (F.col("p.pos") - F.col("j")).alias("start")).agg(F.count(F.lit(1)).alias("n")).where("n = len")
        return starts.groupBy("name", "segment", "range", "id", "d").agg(F.count(F.lit(1)).alias("f"))

    def _scores(self, prepared, ranges: DataFrame | None) -> DataFrame:
        """(query_id, id, bm25) within ranges (query_id, segment, range); everywhere for None."""
        content, mean, terms, heads, blocks, found = prepared
        asked = terms.where("len = 1").join(heads.select(F.col("token").alias("name"), "segment", "range"), "name")
        asked = asked if ranges is None else asked.join(ranges, ["query_id", "segment", "range"])
        read = cut(asked.select(F.col("name").alias("token"), "segment", "range").distinct())
        self.read = (self.read or 0) + read.count()
        rows = blocks.join(small(read), ["token", "segment", "range"]).select(F.col("token").alias("name"), "segment", "range", F.explode("entries").alias("e"))
        rows = self._live(content, rows.select("name", "segment", "range", "e.id", "e.d", "e.f"))
        rows = rows if found is None else rows.unionByName(found.select("name", "segment", "range", "id", "d", "f"))
        hits = rows.join(small(terms.select("query_id", "name", "times", "idf")), "name")
        hits = hits if ranges is None else hits.join(small(ranges), ["query_id", "segment", "range"], "left_semi")
        return hits.groupBy("query_id", "id").agg((-F.sum(F.col("idf") * _weight(F.col("f"), F.col("d"), mean) * F.col("times"))).alias("bm25"))

    def all(self, queries: DataFrame) -> DataFrame:
        """(query_id, id, bm25) of every row that a query (query_id, q) hits; negative, smaller is better."""
        self.read = 0
        return self._scores(self._prepared(queries), None)

    def top(self, queries: DataFrame, k: int, live: DataFrame | None = None, seeds: int = SEEDS) -> DataFrame:
        """(query_id, id, bm25, rank): the first k rows of each query, among those of `live` (id) if given. `.read` then counts the blocks read, of `.held`."""
        self.read = 0
        prepared = self._prepared(queries)
        content, mean, terms, heads, _, found = prepared
        self.held = heads.count()
        order = [F.round("bm25", 9), F.col("id")]
        bound = terms.where("len = 1").join(heads.withColumnRenamed("token", "name"), "name").select("query_id", "segment", "range", (F.col("idf") * F.col("times") * _weight(F.col("max_f"), F.col("min_d"), mean)).alias("most"))
        if found is not None:
            part = found.groupBy("name", "segment", "range").agg(F.max(_weight(F.col("f"), F.col("d"), mean)).alias("w"))
            bound = bound.union(terms.where("len > 1").join(part, "name").select("query_id", "segment", "range", (F.col("idf") * F.col("times") * F.col("w")).alias("most")))
        bound = cut(bound.groupBy("query_id", "segment", "range").agg(F.sum("most").alias("most")))
        first = cut(ranked(bound, [F.desc("most"), F.col("segment"), F.col("range")], seeds).select("query_id", "segment", "range"))
        kept = lambda df: df if live is None else df.join(live, "id", "left_semi")
        have = cut(kept(self._scores(prepared, first)))
        least = ranked(have, order, k).where(F.col("rank") == k).select("query_id", (-F.col("bm25")).alias("least"))
        rest = bound.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("most") >= F.col("least") - EPS)).select("query_id", "segment", "range").join(first, ["query_id", "segment", "range"], "left_anti")
        more = kept(self._scores(prepared, cut(rest)))
        return ranked(have.union(more), order, k)

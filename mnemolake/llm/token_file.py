"""Token ids in binary files of patched frame-of-reference blocks.

Texts are dealt out by ranges of the id and sorted, tokenised, and written by each task as segments of at most
`segment` ids (a longer text has a segment of its own). Ids are encoded once for each run of non-white-space and worker process:
the tokenizer drops white space and no token spans it.

A segment: magic, counts, the documents' lengths, the start of each block, then the blocks. A block holds BLOCK ids: its
minimum is subtracted, the rest is packed at the width that the PERCENTILE of its values needs, and values beyond that
width leave their high bits in an exception list (place, value). Any block can be decoded alone through the index.

A task writes under a name of its attempt and then renames, so a task that runs twice leaves one whole file.
Reading goes through Spark's binaryFile source, a task decoding one segment at a time.

Defined cases: a null or empty text is one document with only the end id; a null doc_id comes first; rows with equal
doc_id stand in the order of a hash of their texts; an empty table writes no segment; only the id and the text are read, so
other columns of any name do no harm.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from array import array
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, flat_batches, scratch, texts, tune, written

MAGIC, BLOCK, PERCENTILE, SEGMENT, END_ID, CACHE = b"PFORIDS1", 256, 90, 1 << 21, 2, 900_000


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit length of unsigned 32-bit values."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def encode_ids(ids: np.ndarray) -> bytes:
    """Blocks of ids: u32 number of ids, u32 number of blocks, u32 start of each block, then the blocks."""
    n, nb = len(ids), -(-len(ids) // BLOCK)
    full = np.concatenate([ids.astype(np.uint32), np.full(nb * BLOCK - n, ids[-1] if n else 0, np.uint32)]).reshape(nb, BLOCK)
    low = full.min(axis=1) if nb else np.zeros(0, np.uint32)
    rest = full - low[:, None]
    need = _bits(rest)
    width = np.sort(need, axis=1)[:, (BLOCK * PERCENTILE + 99) // 100 - 1] if nb else np.zeros(0, np.int64)
    packed = np.empty(nb, object)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        if w:
            bit = ((rest[at][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
            rows = np.packbits(bit.reshape(len(at), -1), axis=1, bitorder="little")
        else:
            rows = np.zeros((len(at), 0), np.uint8)
        for i, row in zip(at, rows, strict=True):
            packed[i] = row.tobytes()
    out, starts, pos = [], [], 8 + 4 * nb
    odd_row, odd_col = np.nonzero(need > width[:, None])
    cut = np.searchsorted(odd_row, np.arange(nb + 1))
    high = (rest[odd_row, odd_col] >> width[odd_row].astype(np.uint32)).astype("<u4")
    places = odd_col.astype("u1")
    for i in range(nb):
        a, b = cut[i], cut[i + 1]
        block = struct.pack("<IBH", int(low[i]), int(width[i]), int(b - a)) + packed[i] + places[a:b].tobytes() + high[a:b].tobytes()
        starts.append(pos)
        pos += len(block)
        out.append(block)
    return struct.pack("<II", n, nb) + np.array(starts, "<u4").tobytes() + b"".join(out)


def decode_ids(data: bytes) -> np.ndarray:
    n, nb = struct.unpack_from("<II", data)
    starts = np.frombuffer(data, "<u4", nb, 8)
    heads = [struct.unpack_from("<IBH", data, s) for s in starts.tolist()]
    out, width = np.zeros((nb, BLOCK), np.uint32), np.array([h[1] for h in heads], np.int64)
    for w in np.unique(width):
        at, size = np.flatnonzero(width == w), BLOCK * int(w) // 8
        if w:
            raw = np.frombuffer(b"".join(data[s + 7 : s + 7 + size] for s in starts[at].tolist()), np.uint8).reshape(len(at), size)
            bit = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(at), BLOCK, int(w))
            value = np.zeros((len(at), BLOCK), np.uint32)
            for j in range(int(w)):
                value |= bit[:, :, j].astype(np.uint32) << np.uint32(j)
            out[at] = value
    for i, (s, (_, w, k)) in enumerate(zip(starts.tolist(), heads, strict=True)):
        if k:
            p = s + 7 + BLOCK * w // 8
            out[i, np.frombuffer(data, "u1", k, p)] |= np.frombuffer(data, "<u4", k, p + k).astype(np.uint32) << np.uint32(w)
    out += np.array([h[0] for h in heads], np.uint32)[:, None]
    return out.reshape(-1)[:n]


def pack_segment(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """Magic, u32 documents, their ids (i64), null flags (u8), lengths (u32), then the blocks."""
    k = len(doc_ids)
    return MAGIC + struct.pack("<I", k) + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + np.array(sizes, "<u4").tobytes() + encode_ids(ids)


def unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    if data[:8] != MAGIC:
        raise ValueError("not a token segment")
    (k,) = struct.unpack_from("<I", data, 8)
    ids, null = np.frombuffer(data, "<i8", k, 12).tolist(), np.frombuffer(data, "u1", k, 12 + 8 * k)
    return [None if z else d for d, z in zip(ids, null, strict=True)], np.frombuffer(data, "<u4", k, 12 + 9 * k), decode_ids(data[12 + 13 * k :])


class Encoder(dict):
    """Ids, as bytes, of each run of non-white-space that its worker has met; a new run is encoded when it is first asked for.

    For tokenizers that normalise to lower-case NFC, drop white space, and take a run of letters as one byte-level piece.
    A run of marks after a letter or digit is a token of its own, so `Word`, `word.` and
    `word,` share the library's answer for `word`. Texts with `<|` keep their case, which special tokens depend on.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.end = Tokenizer.from_file(path), array("I", [end_id]).tobytes()
        self.model = self.tokenizer.model
        # bytes as characters, the way byte-level tokenizers write them: printable ones stand for themselves
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.table = {b: b if b in own else next(other) for b in range(256)}

    def __missing__(self, w: bytes) -> bytes:
        base = w.rstrip(b".,;:!?")
        if len(base) < len(w) and base and base.decode()[-1].isalnum():
            ids = self[base] + self[w[len(base) :]]
        else:
            s = w.decode()
            if s.isalpha() and max(s) < "\u0250" and s == s.lower() and is_normalized("NFC", s):
                # a lower-case run of Latin letters is one piece for the library's model, whatever stands before it
                ids = array("I", [t.id for t in self.model.tokenize(w.decode("latin-1").translate(self.table))]).tobytes()
            else:
                ids = array("I", self.tokenizer.encode(s, add_special_tokens=False).ids).tobytes()
        self[w] = ids
        return ids

    def batch(self, raw: list[bytes]) -> list[np.ndarray]:
        if len(self) > CACHE:
            self.clear()
        get = self.__getitem__
        return [np.frombuffer(b"".join(map(get, (t if b"<|" in t else t.lower()).split())) + self.end, "<u4") for t in raw]


@functools.lru_cache(maxsize=1)
def encoder(path: str, end_id: int) -> Encoder:
    """One for all tasks of a worker process."""
    return Encoder(path, end_id)


def _put(folder: str, name: str, data: bytes) -> None:
    """One whole file under the name, whichever attempts run."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(tmp := f"{path}/.{name}.{TaskContext.get().taskAttemptId()}") as f:
        f.write(data)
    store.move(tmp, f"{path}/{name}")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, segment: int = SEGMENT) -> DataFrame:
    """Write the segments, in ascending order of the id; returns the index, a written table with a row per segment: part, seg, n_docs, n_ids, n_bytes.

    Ranges are cut by id, then by the text's hash, then by place in the input, so that rows of one id, or without one, are
    no single range; within an id rows are in the order of that hash.
    """
    spark = tune(docs.sparkSession)
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("place")]
    ordered = named.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        enc, part, seg = encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        names, sizes, held, total = [], [], [], 0

        def flush():
            data = pack_segment(names, sizes, np.concatenate(held))
            _put(folder, f"part-{part:06d}-{seg:06d}.pfor", data)
            return pa.RecordBatch.from_pydict({"part": [part], "seg": [seg], "n_docs": [len(names)], "n_ids": [total], "n_bytes": [len(data)]}, schema=pa.schema([(c, pa.int64()) for c in ("part", "seg", "n_docs", "n_ids", "n_bytes")]))

        for b in batches:
            for d, ids in zip(b.column(0).to_pylist(), enc.batch(texts(b)), strict=True):
                if names and total + len(ids) > segment:
                    yield flush()
                    names, sizes, held, total, seg = [], [], [], 0, seg + 1
                names.append(d)
                sizes.append(len(ids))
                held.append(ids)
                total += len(ids)
        if names:
            yield flush()

    return written(ordered.mapInArrow(run, "part long, seg long, n_docs long, n_ids long, n_bytes long"), "segments")


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """part, seg, content of each file."""
    name = r"part-(\d+)-(\d+)\.pfor$"
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select(F.regexp_extract("path", name, 1).cast("long").alias("part"), F.regexp_extract("path", name, 2).cast("long").alias("seg"), "content")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of all segments: part, seg, at (ids before it in its segment), doc_id, ids."""

    def make():
        def run(batch):
            for part, seg, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                names, sizes, ids = unpack_segment(data)
                ends = np.cumsum(sizes, dtype=np.int64)
                k = len(names)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                for a in range(0, k, 500):
                    z = min(k, a + 500)
                    values = pa.ListArray.from_arrays(pa.array(offsets[a : z + 1] - offsets[a]), pa.array(ids[offsets[a] : offsets[z]].astype(np.int32)))
                    yield [[part] * (z - a), [seg] * (z - a), (ends - sizes)[a:z], names[a:z], values]

        return run

    return flat_batches(_segments(spark, folder), make, [("part", "long"), ("seg", "long"), ("at", "long"), ("doc_id", "long"), ("ids", "array<int>")])


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """Of the documents of all segments: part, seg, at, doc_id, n_tokens, ids_crc32."""

    def make():
        def run(batch):
            for part, seg, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                names, sizes, ids = unpack_segment(data)
                ends = np.cumsum(sizes, dtype=np.int64)
                flat = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(flat[4 * a : 4 * z]) for a, z in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                yield [[part] * len(names), [seg] * len(names), ends - sizes, names, sizes.astype(np.int64), crc]

        return run

    return flat_batches(_segments(spark, folder), make, [("part", "long"), ("seg", "long"), ("at", "long"), ("doc_id", "long"), ("n_tokens", "long"), ("ids_crc32", "long")])


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark, "tokens")
    segments = write_tokens(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"))
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per range, as many as shuffle partitions
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    starts = segments.join(parts, "part").select("part", "seg", (F.col("before_part") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("seg")) - F.col("n_ids")).alias("before"))
    if segments.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return digest(spark, folder).join(starts, ["part", "seg"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")

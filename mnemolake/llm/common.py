"""What the training-data operators share: scratch tables, Arrow batches, words."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A batch that goes to Python holds at most so many rows and so many bytes (one longer text still travels alone).
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session, whatever the length of its texts. Results are lazy, so the settings stay."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session on one machine makes its own; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and (set_before := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        base = set_before.get()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="mnemolake-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(remove, spark, base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/mnemolake/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder; a stopped session leaves it to the cluster's own cleaning."""
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session has ended
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder once and read it back. `.scratch_path` lets the caller drop it early."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that `written` made and that nothing lazy reads any more; let the JVM release their shuffle files."""
    for t in tables:
        remove(t.sparkSession, t.scratch_path)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[list] | list | None]], fields: list[tuple[str, str]], keep: list[str] = ()) -> DataFrame:
    """Narrow map over Arrow batches.

    make() runs once per task and gives a function from a RecordBatch to the new columns (as many values as rows);
    columns named in keep pass through in front. An input column whose name a new column takes is replaced by it.
    """
    names = {n.lower() for n, _ in fields}
    keep = [c for c in keep if c.lower() not in names]
    schema = T.StructType([df.schema[c] for c in keep] + [field(n, k) for n, k in fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            cols = fn(b)
            if cols is None:
                continue
            arrays = [b.column(b.schema.get_field_index(c)) for c in keep]
            arrays += [c if isinstance(c, pa.Array) else pa.array(c, type=arrow.field(len(keep) + i).type, from_pandas=False) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def flat_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[list]]], fields: list[tuple[str, str]]) -> DataFrame:
    """Like map_batches for functions that yield any number of column lists per batch, of any length."""
    schema = T.StructType([field(n, k) for n, k in fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            for cols in fn(b):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type, from_pandas=False) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [t or b"" for t in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


#: Word characters after lower-casing A-Z: digits, a-z and everything beyond ASCII.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.translate(_WORD).split()


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def part(column: str, modulus: int, remainder: int):
    """Whether crc32 of the id, as text, leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))

"""Stored snapshots of a table with ids: a write rewrites the buckets of the ids that it touches and publishes one version file.

Rows lie in BUCKETS folders by the hash of their id. A merge reads the touched buckets, replaces or drops the rows of its
ids and writes these buckets anew, by Spark's own partitioned write; the version file then names, for each bucket, the
folder that holds it. It appears by a rename that fails where the number is taken: a writer that stops before leaves the
old version, one that comes second starts over on the new one. The names of applied batches are part of the version, so
a batch that is sent again changes nothing. However many writes there were, a read is one scan of at most BUCKETS folders.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(buckets)).cast("int").alias("_bucket")


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._p = jvm.org.apache.hadoop.fs.Path
        root = self._p(self.path)
        self._fs = root.getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf)
        self._rename = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self._fs.mkdirs(self._p(f"{self.path}/versions"))

    def version(self) -> tuple[int, dict]:
        """The number of the last version and its content: the schema, the applied batches, the folder of each bucket that has rows."""
        numbers = [int(s.getPath().getName()) for s in self._fs.listStatus(self._p(f"{self.path}/versions")) if s.getPath().getName().isdigit()]
        if not numbers:
            return 0, {"schema": None, "batches": [], "buckets": {}}
        return max(numbers), self._content(max(numbers))

    def _content(self, number: int) -> dict:
        stream = self._fs.open(self._p(f"{self.path}/versions/{number:09d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
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

    def _rows(self, content: dict, touched: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{folder}/_bucket={k}" for k, folder in content["buckets"].items() if touched is None or int(k) in touched]
        if not paths:
            return self.spark.createDataFrame([], content["schema"])
        return self.spark.read.schema(content["schema"]).parquet(*paths)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the last version, or of an earlier one that is not vacuumed yet."""
        content = self.version()[1] if number is None else self._content(number)
        if content["schema"] is None:
            raise ValueError("nothing has been written yet")
        return self._rows(content)

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """The folder of each bucket of rows, written anew."""
        name = uuid.uuid4().hex
        rows.withColumn("_bucket", _bucket(self.buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        written = [s.getPath().getName() for s in self._fs.listStatus(self._p(f"{self.path}/{name}"))]
        return {w.partition("=")[2]: name for w in written if w.startswith("_bucket=")}

    def merge(self, batch: str, rows: DataFrame | None = None, gone: DataFrame | None = None) -> bool:
        """Put rows in place of those of their ids, or beside the others, and drop the ids of `gone` (id); false if the batch was applied before.

        Ids of rows are distinct; an id that is in both stays, as written. Columns that the table lacks are dropped, those
        that the rows lack are null; the first write makes the schema.
        """
        while True:
            number, content = self.version()
            if batch in content["batches"]:
                return False
            if content["schema"] is None:
                if rows is None:
                    return False
                content["schema"] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
            asked = [d.select(F.col("id").cast("long").alias("id")) for d in (rows, gone) if d is not None]
            ids = asked[0] if len(asked) == 1 else asked[0].union(asked[1])
            touched = [r[0] for r in ids.select(_bucket(self.buckets)).distinct().collect()]  # BUCKETS numbers at most
            left = self._rows(content, touched).join(ids.distinct(), "id", "left_anti")
            columns = left.columns
            if rows is not None:
                missing = [F.lit(None).alias(c) for c in columns if c not in rows.columns]
                left = left.unionByName(rows.select("*", *missing).select(*(F.col(c).cast(left.schema[c].dataType).alias(c) for c in columns)))
            kept = {k: v for k, v in content["buckets"].items() if int(k) not in touched}
            new = content | {"batches": [*content["batches"], batch], "buckets": kept | (self._write(left.select(*columns)) if touched else {})}
            if self._publish(number + 1, new):
                return True

    def replace(self, batch: str, rows: DataFrame) -> bool:
        """A version that holds these rows alone, with their schema."""
        while True:
            number, content = self.version()
            if batch in content["batches"]:
                return False
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
            if self._publish(number + 1, {"schema": schema, "batches": [*content["batches"], batch], "buckets": self._write(rows)}):
                return True

    def vacuum(self) -> None:
        """Delete folders and versions that the last version does not need; for times without readers of older ones and without writers."""
        number, content = self.version()
        for s in self._fs.listStatus(self._p(self.path)):
            if s.getPath().getName() not in {"versions", *content["buckets"].values()}:
                self._fs.delete(s.getPath(), True)
        for s in self._fs.listStatus(self._p(f"{self.path}/versions")):
            if s.getPath().getName() != f"{number:09d}":
                self._fs.delete(s.getPath(), True)

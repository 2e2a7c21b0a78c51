"""Token counts as delta-maintained rollups.

A store in the shared folder holds, for each committed batch, `entries` (signed rows by document, in BUCKETS folders by
the hash of the id) and `deltas` (their sums by source, language and tokenizer version). Totals are the sums of all
deltas. An insert costs in proportion to the batch; a delete or a revision also reads the buckets that its ids fall in:

* insert: + the document's tokens, + 1 document;
* delete: the negated sum of the document's committed entries, whatever keys they have;
* revise: that negated sum plus the new count, under the new keys; an unknown document is an insert.

A batch is written to a data folder of its attempt. It becomes part of the store when its commit file appears under the
batch's name, by a rename that fails where the name exists; so a replay, a driver that died in between, or the second of
two writers changes nothing. `compact` is a commit whose file lists the commits that it folds: from then on those no
longer count, whether or not their data is gone already, and their names stay known. Writers take turns: two batches that
remove one document at the same moment would both negate it.

Within one batch deletions and revisions remove what was committed before it, then its inserts and revisions count.
Inserts of one document add up; of several revisions of a document under one tokenizer the one with the most tokens
counts (ties: the larger source, then language). Rows are summed by document and keys before they are written, partly
before the shuffle, so repeated ids and a source with a third of the rows move few rows. All is DataFrame operations.

Defined cases: null text counts 0 tokens and one document; null source or language is a key of its own; changes with a
null id or operation are not applied; deleting an unknown document does nothing; an empty batch commits empty.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, scratch

KEYS, BUCKETS = ["source", "lang", "tokenizer"], 64
_ENTRY = "doc_id long, source string, lang string, tokenizer string, d_docs long, d_tokens long, bucket int"
_DELTA = "source string, lang string, tokenizer string, d_docs long, d_tokens long"

#: Tokenizer versions that are column expressions: name -> text column -> count.
TOKENIZERS = {
    "words-1": lambda t: F.coalesce(F.regexp_count(t, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long"),
    "words-2": lambda t: F.coalesce(F.regexp_count(t, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r]")), F.lit(0)).cast("long"),
}


def counted(docs: DataFrame, tokenizer: str, count: Column | None = None, op: str = "insert") -> DataFrame:
    """Changes (op, doc_id, source, lang, tokenizer, n_tokens) of all rows of docs, counted whole."""
    count = TOKENIZERS[tokenizer](F.col("text")) if count is None else count
    return docs.select(F.lit(op).alias("op"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), count.cast("long").alias("n_tokens"))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        root = self._path(self.path)
        self._fs = root.getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf)
        self._rename = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        for sub in ("data", "commits"):
            self._fs.mkdirs(self._path(f"{self.path}/{sub}"))

    def _commits(self) -> dict[str, tuple[str, list[str]]]:
        """Of every commit: its data folder and the names that it folds."""
        out = {}
        for s in self._fs.listStatus(self._path(f"{self.path}/commits")):
            name = s.getPath().getName()
            if not name.startswith((".", "_")):
                stream = self._fs.open(s.getPath())
                try:
                    folder, *folded = bytes(stream.readAllBytes()).decode().split("\n")
                finally:
                    stream.close()
                out[name] = folder, folded
        return out

    def batches(self) -> list[str]:
        """Names of the commits that count; folded ones are known, but no longer count."""
        commits = self._commits()
        return sorted(commits.keys() - {n for _, folded in commits.values() for n in folded})

    def _read(self, kind: str, schema: str, commits: dict[str, tuple[str, list[str]]] | None = None) -> DataFrame:
        commits = self._commits() if commits is None else commits
        gone = {n for _, folded in commits.values() for n in folded}
        paths = [f"{self.path}/data/{folder}/{kind}" for name, (folder, _) in sorted(commits.items()) if name not in gone]
        if not paths:
            return self.spark.createDataFrame([], schema)
        if kind == "deltas":
            return self.spark.read.schema(schema).parquet(*paths)
        return reduce(DataFrame.unionByName, (self.spark.read.schema(schema).parquet(p) for p in paths))  # each has bucket folders of its own

    def _write(self, entries: DataFrame) -> str:
        """A data folder of one attempt: entries summed by document and keys, and their sums by key."""
        folder = uuid.uuid4().hex
        work = f"{self.path}/data/{folder}"
        rows = entries.groupBy("doc_id", *KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).where("d_docs <> 0 OR d_tokens <> 0")
        rows.withColumn("bucket", _bucket()).repartition("bucket").sortWithinPartitions("bucket", "doc_id").write.partitionBy("bucket").parquet(f"{work}/entries")
        held = self.spark.read.schema(_ENTRY).parquet(f"{work}/entries")
        held.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).write.parquet(f"{work}/deltas")
        return folder

    def _publish(self, name: str, folder: str, folded: list[str]) -> bool:
        """The commit file, whole or not at all; false if the name is taken."""
        draft = self._path(f"{self.path}/commits/.{folder}")
        out = self._fs.create(draft, True)
        out.write("\n".join([folder, *folded]).encode())
        out.close()
        try:
            self._files.rename(draft, self._path(f"{self.path}/commits/{name}"), self._rename)
            return True
        except Py4JJavaError as e:
            if not e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise
            self._fs.delete(draft, False)
            return False

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; false if it was committed before, folded since or not."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
            raise ValueError(f"a batch name of letters, digits, '.', '_' and '-' is needed: {batch!r}")
        if self._fs.exists(self._path(f"{self.path}/commits/{batch}")):
            return False
        changes = changes.where("op IS NOT NULL AND doc_id IS NOT NULL")
        tokens = F.coalesce("n_tokens", F.lit(0)).cast("long").alias("d_tokens")
        plus = changes.where("op = 'insert'").select("doc_id", *KEYS, F.lit(1).cast("long").alias("d_docs"), tokens)
        best = changes.where("op = 'revise'").groupBy("doc_id", "tokenizer").agg(F.max(F.struct(tokens, "source", "lang")).alias("r"))
        plus = plus.unionByName(best.select("doc_id", "r.source", "r.lang", "tokenizer", F.lit(1).cast("long").alias("d_docs"), "r.d_tokens"))
        gone = changes.where("op IN ('delete', 'revise')").select("doc_id").distinct()
        touched = [r[0] for r in gone.select(_bucket()).distinct().collect()]  # BUCKETS numbers at most
        if touched:
            held = self._read("entries", _ENTRY).where(F.col("bucket").isin(touched)).join(gone, "doc_id", "left_semi")
            plus = plus.unionByName(held.select("doc_id", *KEYS, (-F.col("d_docs")).alias("d_docs"), (-F.col("d_tokens")).alias("d_tokens")))
        folder = self._write(plus)
        if done := self._publish(batch, folder, []):
            return done
        self._drop(folder)
        return False

    def _drop(self, folder: str) -> None:
        self._fs.delete(self._path(f"{self.path}/data/{folder}"), True)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of keys that still count a document or a token."""
        sums = self._read("deltas", _DELTA).groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self, name: str) -> bool:
        """Fold all commits that count into one of this name, then delete the data of all that no longer count.

        What is read is what is folded: a commit that appears meanwhile is in neither and counts beside the result.
        """
        listed = self._commits()
        folded = sorted(listed.keys() - {n for _, names in listed.values() for n in names})
        done = self._publish(name, folder := self._write(self._read("entries", _ENTRY, listed)), folded)
        if not done:
            self._drop(folder)
        commits = self._commits()
        for n in {n for _, names in commits.values() for n in names}:
            self._drop(commits[n][0])
        return done


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert every document under words-1; revise those with id % 10 = 3 under words-2; delete id % 10 = 7; replay both."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    store = Rollup(spark, scratch(spark, "rollup"))
    store.commit("0001", counted(docs, "words-1"))
    second = counted(docs.where("doc_id % 10 = 3"), "words-2", op="revise").unionByName(docs.where("doc_id % 10 = 7").select(F.lit("delete").alias("op"), "doc_id", "source", "lang", F.lit(None).cast("string").alias("tokenizer"), F.lit(None).cast("long").alias("n_tokens")))
    store.commit("0002", second)
    store.commit("0002", second)
    store.commit("0001", counted(docs, "words-1"))
    return store.totals()


ORACLE = r"""
SELECT source, lang, CASE WHEN doc_id % 10 = 3 THEN 'words-2' ELSE 'words-1' END AS tokenizer, CAST(count(*) AS BIGINT) AS n_docs,
 CAST(sum(coalesce(len(regexp_extract_all(text, CASE WHEN doc_id % 10 = 3 THEN '[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r]' ELSE '[^ \t\n\r]+' END)), 0)) AS BIGINT) AS n_tokens
FROM documents WHERE doc_id % 10 <> 7 AND doc_id IS NOT NULL GROUP BY ALL
"""

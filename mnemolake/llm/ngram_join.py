"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct word shingles, as 64-bit hashes, in one order for all documents: by how often the hash's
slot of a count sketch comes up in the corpus, rare ones first, then by hash. (Any common order keeps the join exact; the
sketch, of a fixed size, only makes prefixes selective.) Two sets of n and m elements at the threshold share at least
need(n) = ceil(threshold * n / 100) elements, so their prefixes of n - need(n) + l elements share at least l. Each document
chooses its own l: for each l the lists of its prefix are added up, and the cost is that sum and, for the candidates that
can share l of its elements, at most sum / l, their verification. Of two documents the smaller l counts: their prefixes
share at least that many elements, or they are not linked.

1. Documents of equal sets form one class, a node; only classes go on. Elements that no other class has in its longest
   prefix are dropped before anything is joined.
2. Stars: in a list of classes, each class is set against one of them, the list's hub, and takes the hub that it shares
   most elements with. That is one verification a class. The first hubs are the classes whose prefixes others share most,
   such as the text that a group was copied from; rounds with hubs by chance follow as long as they link more than a few.
   Large groups of near copies are settled so, in a time that grows with their size, not its square.
3. The rest: classes of one list that are still in different components are paired by a join, without those that
   the lengths or the places in the prefixes rule out. A pair goes that shares fewer than l prefix elements, or so few
   that it could not be linked if all that lies beyond the prefixes were shared: common elements up to the end of the
   prefix that ends first are counted, so those of sizes n and m share at most the count and the larger of what is left
   of n and m. The others are verified. A pair within one component cannot change the result, so this loses nothing.
   Pairs of long lists are counted where they meet, from all their elements, and one row goes for each that is left.

Every link is verified on the full sets. No list is capped. Classes are named by 64 bits of the 128-bit hash of their set.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a text of fewer
words than a shingle is one shingle; a row with a null id is linked with nothing and has a null component; rows that
repeat an id are one document, linked if any of their texts is; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop, map_batches, remove, scratch, texts, tune, written
from .counters import counted_slots, slot_array
from .near_dups import _verify_stars, components, shingler_of

SHINGLE, THRESHOLD, LONGEST, SLOTS, SALT, ROUNDS, LISTS = 5, 80, 6, 1 << 20, 2000, 3, 16
#: A round of stars is followed by another one if it links more than one class of FEW.
FEW = 50


def _slot(shingles: np.ndarray, slots: int) -> np.ndarray:
    return ((shingles ^ shingles >> np.uint64(29)) % np.uint64(slots)).astype(np.int64)


def frequency_classes(docs: DataFrame, text: str, shingle: int, slots: int) -> np.ndarray:
    """For each slot of the sketch a class of its count over all documents: eighths of a power of two, a byte each."""

    def make():
        shingler = shingler_of(shingle)
        return lambda batch: np.concatenate([np.zeros(0, np.int64), *(_slot(shingler.of(t), slots) for t in texts(batch, text))])

    n = slot_array(counted_slots(docs.select(F.col(text).alias(text)), make, slots), slots)
    return np.minimum(8 * np.log2(n + 1.0), 255).astype(np.uint8)


def need(n, threshold: int):
    """Elements that a set of n shares, at least, with any set it is linked with."""
    return -(-threshold * n // 100)


def ordered_sets(docs: DataFrame, doc_id: str, text: str, shingle: int, threshold: int, longest: int, classes) -> DataFrame:
    """Per row: id, n_shingles, set_key, cid and the prefix for the largest l; null key and cid for an empty set."""

    def make():
        import xxhash

        shingler, frequency = shingler_of(shingle), classes.value

        def run(batch):
            n, key, cid, prefix = [], [], [], []
            for t in texts(batch, text):
                s = shingler.of(t)
                n.append(len(s))
                k = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                key.append(k)
                cid.append(int.from_bytes(k[:8], "little", signed=True) if k else None)
                order = np.lexsort((s, frequency[_slot(s, len(frequency))]))
                prefix.append(s[order[: len(s) - need(len(s), threshold) + min(longest, need(len(s), threshold))]].view(np.int64) if len(s) else None)
            return [n, key, cid, prefix]

        return run

    fields = [("n_shingles", "long"), ("set_key", "binary"), ("cid", "long"), ("prefix", "array<long>")]
    return map_batches(docs.select(F.col(doc_id).alias("id"), F.col(text).alias(text)), make, fields, ["id"])


def chosen(shared: DataFrame, threshold: int, longest: int) -> DataFrame:
    """(cid, l) for shared (cid, n, pos, size): the l of least cost; a verification costs an eighth of the set's size in list entries."""
    most = F.ceil(F.lit(threshold) * F.col("n") / 100)
    base = F.col("n") - most
    sums = shared.groupBy("cid", "n").agg(*(F.sum(F.when(F.col("pos") < base + k, F.col("size") - 1).otherwise(0)).alias(f"s{k}") for k in range(1, longest + 1)))
    cost = F.array(*(F.when(F.lit(k) <= most, F.col(f"s{k}") * (1 + F.col("n") / 8 / k)) for k in range(1, longest + 1)))
    return sums.select("cid", F.array_position(cost, F.array_min(cost)).cast("int").alias("l"))


def _close(a: str, b: str, threshold: int):
    """Whether sets of n{a} and n{b} elements can be linked, by their sizes and by the places of a common prefix element: what comes before it is common only if others have it."""
    na, nb, pa, pb = F.col(f"n{a}"), F.col(f"n{b}"), F.col(f"pos{a}"), F.col(f"pos{b}")
    common = F.least(f"before{a}", f"before{b}") + F.least(na - pa, nb - pb)
    return (100 * F.least(na, nb) >= threshold * F.greatest(na, nb)) & ((100 + threshold) * common >= threshold * (na + nb))


@contextlib.contextmanager
def _bucketed(df: DataFrame, key: str):
    """df as a table in the shared folder that lies dealt out by key, so that joins on it move the other side only."""
    spark, name = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
    path = scratch(spark, "dealt")
    try:
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def _verified(pairs: DataFrame, reps: DataFrame, live: DataFrame, shingle: int, threshold: int, salt: int) -> DataFrame:
    """Links (src, dst) among pairs (hub, cid): a hub's text meets at most `salt` others in one task."""
    busy = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / salt).cast("int").alias("salts"))
    hubs = busy.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hub").alias("cid"), F.lit(False).alias("is_member"))
    members = pairs.join(busy, "hub").select("hub", F.pmod(F.xxhash64("cid"), "salts").cast("int").alias("salt"), "cid", F.lit(True).alias("is_member"))
    rows = hubs.union(members).join(reps, "cid").join(live, "id").select("hub", "salt", "is_member", F.col("cid").alias("id"), "set_key", "text")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "is_member")
    return _verify_stars(rows, shingle, threshold)


def rest_pairs(rest: DataFrame, threshold: int, lists: int) -> DataFrame:
    """Candidates (hub, cid) of different labels among rest (token, size, cid, n, pos, before, l, label); size is that of the token's list.

    Lists of `lists` classes at most give a row for each pair and token, which are counted. In longer ones both classes
    bring all their tokens, so that a pair is counted where it meets, and goes only if it is a candidate, from the first
    long list that it shares.
    """
    beyond = lambda k: F.ceil(F.lit(threshold) * F.col(f"n{k}") / 100) - F.col(f"l{k}")  # what a prefix leaves of its set
    enough = lambda both: (both >= F.least("l1", "l2")) & ((100 + threshold) * (both + F.greatest(beyond(1), beyond(2))) >= threshold * (F.col("n1") + F.col("n2")))
    differ = (F.col("cid1") < F.col("cid2")) & (F.col("label1") != F.col("label2")) & _close("1", "2", threshold)
    sides = lambda df: (df.select("token", *(F.col(c).alias(f"{c}{k}") for c in df.columns if c not in ("token", "size"))) for k in (1, 2))
    one, two = sides(rest.where(F.col("size") <= lists))
    few = one.join(two, "token").where(differ)
    few = few.groupBy(F.col("cid1").alias("hub"), F.col("cid2").alias("cid")).agg(F.count(F.lit(1)).alias("both"), F.first(F.struct("n1", "l1", "n2", "l2")).alias("p")).select("hub", "cid", "both", "p.*")
    few = few.where(enough(F.col("both"))).select("hub", "cid")
    tokens = rest.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct((F.col("size") <= lists).alias("short"), "token"))).alias("t"), F.max("size").alias("most"))
    tokens = tokens.where(F.col("most") > lists).select("cid", F.col("t.token").alias("tokens"))
    one, two = sides(rest.where(F.col("size") > lists).join(tokens, "cid"))
    both = F.array_intersect("tokens1", "tokens2")  # long lists come first, in one order for all classes
    many = one.join(two, "token").where(differ & enough(F.size(both)) & (F.element_at(both, 1) == F.col("token"))).select(F.col("cid1").alias("hub"), F.col("cid2").alias("cid"))
    return few.union(many).distinct()


def join_links(docs: DataFrame, sets: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, longest: int = LONGEST, salt: int = SALT, rounds: int = ROUNDS, lists: int = LISTS) -> DataFrame:
    """(id, label) of the classes that are linked with others: the smallest class of the component."""
    full = sets.where("cid IS NOT NULL AND id IS NOT NULL")
    classes = written(full.groupBy("cid").agg(F.min("id").alias("id"), F.first("set_key").alias("set_key"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix")), "classes")
    entries = classes.select("cid", "n", F.posexplode("prefix").alias("pos", "token"))
    sizes = entries.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = written(entries.join(sizes, "token"), "shared")
    within = F.col("pos") < F.col("n") - F.ceil(F.lit(threshold) * F.col("n") / 100) + F.col("l")
    kept = shared.join(chosen(shared, threshold, longest), "cid").where(within)
    central = kept.groupBy("cid").agg((F.sum("size") / F.first("n")).alias("central"))
    before = F.row_number().over(Window.partitionBy("cid").orderBy("pos")) - 1  # elements before it that others have too
    with _bucketed(kept.join(central, "cid").select("token", "cid", "n", "pos", "l", "central", before.alias("before")), "cid") as kept:
        reps = written(kept.select("cid").distinct().join(classes.select("cid", "id", "set_key"), "cid"), "reps")
        drop(classes, shared)
        # texts are dealt out once, by id, whatever is verified; a repeated id brings several, told apart by set_key
        # (a merge join, so that each task writes whole buckets whatever the size)
        with _bucketed(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(reps.select("id").distinct().hint("merge"), "id", "left_semi"), "id") as live:
            labels = _linked(full, kept, reps, live, shingle, threshold, salt, rounds, lists)
    drop(reps)
    return labels


def _linked(full: DataFrame, kept: DataFrame, reps: DataFrame, live: DataFrame, shingle: int, threshold: int, salt: int, rounds: int, lists: int) -> DataFrame:
    # an id that repeats with several sets is one document
    several = full.groupBy("id").agg(F.min("cid").alias("src"), F.max("cid").alias("hi")).where("src <> hi").select("id", "src")
    links = written(full.select("id", "cid").join(several, "id").select("src", F.col("cid").alias("dst")).where("src <> dst"), "links")
    labels = components(links)
    labelled = lambda: kept.join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    for k in range(rounds):
        now = labelled()
        order = F.xxhash64(F.col("cid"), F.lit(k)).cast("double") if k else -F.col("central")
        first = F.struct(order.alias("o"), F.col("cid").alias("hub"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("before").alias("before2"), F.col("l").alias("l2"), F.col("label").alias("label2"))
        hubs = now.groupBy("token").agg(F.min(first).alias("h"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token", "h.*")
        met = now.withColumnsRenamed({"n": "n1", "pos": "pos1", "before": "before1"}).join(hubs, "token").where((F.col("label") != F.col("label2")) & _close("1", "2", threshold))
        met = met.groupBy("cid", "hub").agg(F.count(F.lit(1)).alias("both"), F.min(F.least("l", "l2")).alias("l")).where("both >= l")
        stars = written(met.groupBy("cid").agg(F.max(F.struct("both", "hub")).alias("b")).select("cid", "b.hub"), "stars")
        more = written(_verified(stars, reps, live, shingle, threshold, salt), "links")
        if not (found := more.count()):
            break
        labels = components(labels.select(F.col("id").alias("src"), F.col("label").alias("dst")).union(more))
        if found * FEW < stars.count():  # no large groups are left
            break
    now = labelled()
    open_ = now.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("token", "size")
    rest = written(now.drop("central").join(open_, "token"), "rest")
    more = written(_verified(written(rest_pairs(rest, threshold, lists), "pairs"), reps, live, shingle, threshold, salt), "links")
    if not more.isEmpty():
        labels = components(labels.select(F.col("id").alias("src"), F.col("label").alias("dst")).union(more))
    drop(rest)
    return labels


def ngram_join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, longest: int = LONGEST, slots: int = SLOTS, salt: int = SALT, rounds: int = ROUNDS, lists: int = LISTS) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    spark = tune(docs.sparkSession)
    order = spark.sparkContext.broadcast(frequency_classes(docs, text, shingle, slots))  # `slots` bytes
    sets = written(ordered_sets(docs, doc_id, text, shingle, threshold, longest, order), "sets")
    labels = join_links(docs, sets, doc_id=doc_id, text=text, shingle=shingle, threshold=threshold, longest=longest, salt=salt, rounds=rounds, lists=lists)
    named = sets.where("cid IS NOT NULL AND id IS NOT NULL").select("id", "cid").distinct().join(labels.withColumnRenamed("id", "cid"), "cid", "left").select("id", F.coalesce("label", "cid").alias("label")).distinct()
    named = written(named, "named")
    least = named.groupBy("label").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("size")).where("size > 1").select("label", "component_id")
    found = named.join(least, "label").select("id", "component_id")
    out = written(sets.join(found, "id", "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id")), "components")
    drop(sets, named)
    return out


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


#: All pairs that share a shingle, then the smallest id reachable.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS r1, b.r AS r2, any_value(a.doc_id) AS x, any_value(b.doc_id) AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
e AS (SELECT DISTINCT x, y FROM p JOIN n n1 ON n1.r = r1 JOIN n n2 ON n2.r = r2 WHERE 100 * c >= 80 * (n1.n + n2.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
m AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (r) LEFT JOIN m ON m.x = doc_id
"""

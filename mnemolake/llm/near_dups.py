"""Near duplicates by circulant MinHash, banding and exact verification.

A document's set is its distinct word shingles, as 64-bit hashes. Two permutations of the 32-bit universe give the whole
signature: sigma scrambles the elements once, and coordinate k is the minimum of pi over sigma's values shifted by k
steps round the universe. Bands of ROWS coordinates are hashed into buckets; a pair at the threshold misses all BANDS
buckets with probability (1 - 0.8^4)^24, about 3e-6.

What is compared, and why no link gets lost:

1. Documents of equal sets form one class; only classes go on, under their smallest id.
2. Stars: in each bucket every class is compared with the bucket's smallest id, not with every other. The pairs of all
   buckets are joined to the texts and their Jaccard similarity is computed on the full sets. Components of these links
   settle nearly all buckets: one whose classes are already in one component cannot add anything.
3. The rest: a bucket that still holds several components goes, whole, to one task, which finds all its links by an
   exact prefix-filter join (rarest shingles first), so a common passage makes no candidates. A bucket of more than
   LIMIT classes is dealt out as pairs of blocks of at most LIMIT, each pair a task's work: nothing is capped.

Hot keys: star hubs are salted, so no task compares more than SALT members with one hub; bucket sizes and minima are
aggregated before the shuffle. Components come from min-label propagation with pointer jumping over written tables.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a row with a
null id is linked with nothing, has a null component and is kept; repeated ids count as one document if any of their
sets link (the id is the node), and every row of that id gets its component; ties go to the smallest id.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop, map_batches, texts, tune, written

SHINGLE, THRESHOLD, BANDS, ROWS, SALT, LIMIT, CACHE = 4, 80, 24, 4, 2000, 4000, 400_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, size: int):
        import xxhash

        self.size, self.hash, self.known = size, xxhash.xxh3_64_intdigest, {}

    def of(self, text: bytes) -> np.ndarray:
        ws = text.translate(_LOWER).split()
        if not ws:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        try:
            ids = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
        except KeyError:
            for w in ws:
                if w not in known:
                    known[w] = self.hash(w)
            ids = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
        k = min(self.size, len(ws))
        n = len(ids) - k + 1
        h = np.full(n, np.uint64(k))
        for j in range(k):
            h *= _M[0]
            h ^= h >> np.uint64(32)
            h += ids[j : j + n] * _M[1]
        h ^= h >> np.uint64(29)
        h *= _M[2]
        h ^= h >> np.uint64(32)
        return np.unique(h)


@functools.lru_cache(maxsize=2)
def shingler_of(size: int) -> Shingler:
    """One for all tasks of a worker process."""
    return Shingler(size)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is min over x of pi(sigma(x) + k * step), both bijections of the 32-bit universe."""
    x = (shingles ^ shingles >> np.uint64(32)).astype(np.uint32)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)  # sigma
    shift = np.arange(size, dtype=np.uint32)[:, None] * np.uint32(0x61C88647)
    out = np.full(size, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 512):
        v = x[None, at : at + 512] + shift
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(12)
        v *= np.uint32(0x297A2D39)
        v ^= v >> np.uint32(15)  # pi
        np.minimum(out, v.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit bucket for each band."""
    s = sig.reshape(bands, -1).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64) * _M[3]
    for column in s.T:
        h ^= column
        h *= _M[4]
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def common_size(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < threshold * large:
        return False
    both = common_size(a, b)
    return 100 * both >= threshold * (small + large - both)


def prefix_join(sets: list[np.ndarray], label: list[int], threshold: int, cross: list[int] | None = None):
    """Exact: yields linked (i, j) of different labels (and different sides, if cross is given) until labels agree.

    Shingles are ordered by their frequency here, rarest first. Two sets at the threshold share one of the first
    n - ceil(threshold * n) + 1 shingles of each, so only those are indexed and looked up.
    """
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, rank, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((rank, count[rank], owner))
    rank, start = rank[order], np.concatenate([[0], np.cumsum(sizes)])
    parent = {x: x for x in label}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index: dict[int, list[int]] = {}
    for i in np.argsort(sizes, kind="stable").tolist():
        n, seen = int(sizes[i]), set()
        prefix = rank[start[i] : start[i] + n - -(-threshold * n // 100) + 1].tolist()
        for t in prefix:
            for j in index.get(t, ()):
                if j not in seen and (cross is None or cross[i] != cross[j]):
                    seen.add(j)
                    a, b = root(label[i]), root(label[j])
                    if a != b and similar(sets[i], sets[j], threshold):
                        parent[max(a, b)] = min(a, b)
                        yield i, j
            index.setdefault(t, []).append(i)


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable over edges (src, dst); ids without an edge are left out.

    Each round takes the smallest label of the neighbours, then follows that label's own; tables are written between
    rounds, so a lost executor costs a round at most.
    """
    both = written(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(F.col("dst"), F.col("src"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        mine = labels.join(near, "id").select("id", F.least("label", "near").alias("step"), F.col("label").alias("was"))
        hop = labels.select(F.col("id").alias("step"), F.col("label").alias("beyond"))
        new = written(mine.join(hop, "step", "left").select("id", F.least("step", "beyond").alias("label"), (F.least("step", "beyond") != F.col("was")).alias("moved")), "labels")
        moved = not new.where("moved").isEmpty()
        drop(labels)
        labels = new
        if not moved:
            drop(both)
            return labels.select("id", "label")


def sets_of(docs: DataFrame, *, doc_id: str, text: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """Per row: id, n_shingles, set_key (128-bit hash of the set; null if empty), buckets."""

    def make():
        import xxhash

        shingler = shingler_of(shingle)

        def run(batch):
            n, key, bucket = [], [], []
            for t in texts(batch, text):
                s = shingler.of(t)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bucket.append(band_keys(signature(s, bands * rows), bands) if len(s) else None)
            return [n, key, bucket]

        return run

    fields = [("n_shingles", "long"), ("set_key", "binary"), ("buckets", "array<long>")]
    return map_batches(docs.select(F.col(doc_id).alias("id"), F.col(text).alias(text)), make, fields, ["id"])


def _texts_of(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """wanted (id, set_key, ...) with the text of each; a repeated id brings several, told apart by set_key later."""
    return wanted.join(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "id")


def _verify_stars(pairs: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """pairs (hub, salt, member flag, id, set_key, text) sorted by hub and salt with the hub first; yields links."""

    def run(batches):
        import xxhash

        shingler, at, hub = shingler_of(shingle), None, None
        for b in batches:
            src, dst = [], []
            for key, salt, is_member, ident, set_key, t in zip(b.column("hub").to_pylist(), b.column("salt").to_pylist(), b.column("is_member").to_pylist(), b.column("id").to_pylist(), b.column("set_key").to_pylist(), texts(b), strict=True):
                s = shingler.of(t)
                if xxhash.xxh3_128_digest(s.tobytes()) != set_key:
                    continue  # another text under the same id
                if not is_member:
                    at, hub = (key, salt), s
                elif at == (key, salt) and similar(hub, s, threshold):
                    src.append(key)
                    dst.append(ident)
            yield pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return pairs.select("hub", "salt", "is_member", "id", "set_key", "text").mapInArrow(run, "src long, dst long")


def _verify_rest(blocks: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """blocks (key, x, y, id, side, label, set_key, text) sorted by (key, x, y): all links between labels of each group."""

    def run(batches):
        import xxhash

        shingler, group, rows = shingler_of(shingle), None, {}

        def links():
            items = list(rows.values())
            if len({r[1] for r in items}) < 2:
                return
            cross = None if group[1] == group[2] else [r[2] for r in items]
            for i, j in prefix_join([r[3] for r in items], [r[1] for r in items], threshold, cross):
                yield items[i][0], items[j][0]

        def out(found):
            found = list(found)
            return pa.RecordBatch.from_pydict({"src": pa.array([a for a, _ in found], pa.int64()), "dst": pa.array([b for _, b in found], pa.int64())})

        for b in batches:
            for key, x, y, ident, side, label, set_key, t in zip(*(b.column(c).to_pylist() for c in ("key", "x", "y", "id", "side", "label", "set_key")), texts(b), strict=True):
                if (key, x, y) != group:
                    if rows:
                        yield out(links())
                    group, rows = (key, x, y), {}
                s = shingler.of(t)
                if xxhash.xxh3_128_digest(s.tobytes()) == set_key:
                    rows[ident, set_key] = (ident, label, side, s)
        if rows:
            yield out(links())

    return blocks.select("key", "x", "y", "id", "side", "label", "set_key", "text").mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, salt: int = SALT, limit: int = LIMIT) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id, kept."""
    spark = tune(docs.sparkSession)
    sets = written(sets_of(docs, doc_id=doc_id, text=text, shingle=shingle, bands=bands, rows=rows), "sets")
    # 1. classes of equal sets; copies are links to the smallest id of their class
    classes = sets.where("set_key IS NOT NULL AND id IS NOT NULL").groupBy("set_key").agg(F.min("id").alias("id"), F.first("buckets").alias("buckets"), F.first("n_shingles").alias("n"))
    members = written(classes.select("id", "set_key", "n", F.explode("buckets").alias("key")), "members")
    copies = sets.where("set_key IS NOT NULL AND id IS NOT NULL").select("set_key", "id").distinct().join(classes.select("set_key", F.col("id").alias("hub")), "set_key").where("id <> hub").select(F.col("hub").alias("src"), F.col("id").alias("dst"))
    # 2. stars
    hubs = members.groupBy("key").agg(F.min(F.struct("id", "set_key", "n")).alias("h"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "h.*", "size")
    hubs = written(hubs.select("key", "size", F.col("id").alias("hub"), F.col("set_key").alias("hub_key"), F.col("n").alias("hub_n")), "hubs")
    pairs = members.join(hubs, "key").where((F.col("set_key") != F.col("hub_key")) & (100 * F.least("n", "hub_n") >= threshold * F.greatest("n", "hub_n")))
    pairs = written(pairs.select("hub", "hub_key", "id", "set_key").distinct(), "pairs")
    busy = pairs.groupBy("hub", "hub_key").agg(F.ceil(F.count(F.lit(1)) / salt).cast("int").alias("salts"))
    hub_rows = busy.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hub").alias("id"), F.col("hub_key").alias("set_key"), F.col("hub_key").alias("star"), F.lit(False).alias("is_member"))
    member_rows = pairs.join(busy, ["hub", "hub_key"]).select("hub", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), "id", "set_key", F.col("hub_key").alias("star"), F.lit(True).alias("is_member"))
    stars = _texts_of(docs, hub_rows.union(member_rows), doc_id, text)
    stars = stars.repartition("hub", "star", "salt").sortWithinPartitions("hub", "star", "salt", "is_member")
    links = written(_verify_stars(stars, shingle, threshold).union(copies), "links")
    labels = components(links)
    # 3. buckets that still hold several components
    labelled = members.join(labels, "id", "left").select("key", "id", "set_key", F.coalesce("label", "id").alias("label"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("key", "size")
    rest = labelled.join(open_keys, "key").withColumn("blocks", F.ceil(F.col("size") / limit).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", F.col("block").alias("side"), "label", "set_key")
    rest = _texts_of(docs, rest, doc_id, text).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id")
    more = written(_verify_rest(rest, shingle, threshold), "more")
    if not more.isEmpty():
        labels = components(labels.select(F.col("id").alias("src"), F.col("label").alias("dst")).union(more))
    out = sets.join(labels, "id", "left").select("id", "n_shingles", F.coalesce("label", "id").alias("component_id"))
    out = written(out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))), "components")
    drop(sets, members, hubs, pairs, links, more)
    return out


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).withColumnRenamed("id", "doc_id")


#: All pairs that share a shingle, then the smallest id reachable.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS r1, b.r AS r2, any_value(a.doc_id) AS x, any_value(b.doc_id) AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
e AS (SELECT DISTINCT x, y FROM p JOIN n n1 ON n1.r = r1 JOIN n n2 ON n2.r = r2 WHERE 100 * c >= 80 * (n1.n + n2.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
m AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (r) LEFT JOIN m ON m.x = doc_id
"""

"""Phrase collocations of two and three words, counted in arrays by the slots of minimal perfect hashes.

A phrase of LEAST occurrences holds only words and shorter phrases of as many (Apriori), so candidates are found level by
level: words that are frequent; pairs of neighbours that both are; triples of which both pairs are. At each level tasks
send the distinct keys of their texts with partial counts, and those whose sum reaches LEAST become candidates. A frequent
word has a number for each language, a pair is keyed by the numbers of its two words, a triple by the slot of its first
pair and the number of its last word: keys are exact at every level, and numbers tell the languages apart.

The candidate phrases of each level make a minimal perfect hash that stores its keys; what it does not hold is told apart
by them. One more pass counts: each task looks all its words, pairs and triples up, adds them up in one numpy array over all
slots, and the arrays are summed as a tree. The score of a cut reads the counts of its two parts by their slots.

The numbers and hashes are made on the driver and broadcast while the candidates of a level are at most BOUND; they grow with the
corpus. Beyond that bound `_keyed` takes over, which counts the keys of pairs and of packed triples as rows of numbers, or,
for more frequent words than numbers of PACKED bits, `shuffled`, which counts the n-grams of the same levels as rows of
strings, each level behind semi-joins with the one below. All give the same counts (the tests run all).

Scores are exact: products are decimals of up to 38 digits, for counts of up to 10^12.

Defined cases: a null or empty text has no words; a null language is `und`, as is one named so; pieces without words give
nothing; ties go to the larger count, then to the phrase that comes first in byte order; repeated rows count each; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop, flat_batches, map_batches, texts, tune, written
from .counters import PerfectHash, counted_slots, slot_rows

LEAST, TOP, HELD, BOUND, FLUSH = 10, 2000, 50, 3_000_000, 300_000
#: Bits of a word's number in a triple's key where the pairs are too many for a hash.
PACKED = 21
_MARKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z lowered, each separator of pieces a full stop, tabs blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 0x2E if c in _MARKS else 32 if c == 9 else c for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """The words of the text, with b"." where a piece ends."""
    return text.translate(_FOLD).replace(b".", b" . ").split()


def _langs(batch) -> list[str]:
    return batch.column(batch.schema.get_field_index("lang")).to_pylist()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of every word."""

    def make():
        total: dict[str, Counter] = {}

        def flush():
            rows = [(lang, w, n) for lang, c in total.items() for w, n in c.items() if w != b"."]
            total.clear()
            return [[r[0] for r in rows], [r[1].decode() for r in rows], [r[2] for r in rows]]

        def run(batch):
            for lang, t in zip(_langs(batch), texts(batch), strict=True):
                total.setdefault(lang, Counter()).update(tokens(t))
                if sum(map(len, total.values())) > FLUSH:
                    yield flush()
            yield flush()

        return run

    part = flat_batches(docs, make, [("lang", "string"), ("word", "string"), ("n", "long")])
    return part.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _coded(docs: DataFrame, slots) -> DataFrame:
    """(slots): for each text the numbers of its words, -1 between pieces, at the end and for other words; slots: a broadcast {lang: {word: number}}."""

    def make():
        known = slots.value

        def run(batch):
            out = []
            for lang, t in zip(_langs(batch), texts(batch), strict=True):
                ws = tokens(t)
                ws.append(b".")
                out.append(np.fromiter(map(known.get(lang, {}).get, ws, repeat(-1)), np.int32, len(ws)).tobytes())
            return [out]

        return run

    return map_batches(docs, make, [("slots", "binary")])


def _numbers(batch) -> np.ndarray:
    """The numbers of a batch of coded texts, one after the other."""
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32).astype(np.int64)


def _pairs(s: np.ndarray) -> np.ndarray:
    """The key of each word and the one after it, -1 where there is none."""
    a, b = s[:-1], s[1:]
    return np.where((a >= 0) & (b >= 0), a << 32 | b, -1)


def _triples(s: np.ndarray, pair_slot: np.ndarray) -> np.ndarray:
    """The key of each three words whose two pairs have slots, else -1."""
    a, b, last = pair_slot[:-1], pair_slot[1:], s[2:]
    return np.where((a >= 0) & (b >= 0), a << 32 | last, -1)


def _pair_slots(s: np.ndarray, hashed: PerfectHash) -> np.ndarray:
    keys, out = _pairs(s), np.full(max(len(s) - 1, 0), -1, np.int64)
    some = np.flatnonzero(keys >= 0)
    out[some] = hashed.slots(keys[some])
    return out


def _packed_triples(s: np.ndarray) -> np.ndarray:
    """The numbers of each three words as one, -1 where there is none; for numbers of up to PACKED."""
    a, b, c = s[:-2], s[1:-1], s[2:]
    return np.where((a >= 0) & (b >= 0) & (c >= 0), a << 2 * PACKED | b << PACKED | c, -1)


def _frequent(docs: DataFrame, make_keys, least: int) -> DataFrame:
    """Keys with their counts (key, n) of which make_keys()(batch) gives at least `least` over all texts. A task sends each distinct key of FLUSH times eight once."""

    def make():
        keys_of, held, size = make_keys(), [], [0]

        def run(batch):
            # batches gather until their keys are worth a sort
            held.append(keys_of(batch))
            size[0] += len(held[-1])
            if size[0] > 8 * FLUSH:
                yield flush()

        def flush():
            key, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            held.clear()
            size[0] = 0
            return [key, n]

        run.flush = flush
        return run

    def task(batches):
        import pyarrow as pa

        run = make()
        for b in batches:
            for key, n in run(b):
                yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "n": pa.array(n, pa.int64())})
        key, n = run.flush()
        yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "n": pa.array(n, pa.int64())})

    part = docs.mapInArrow(task, "key long, n long")
    return part.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _keys(df: DataFrame) -> np.ndarray:
    return df.select("key").toArrow().column("key").to_numpy()


def by_slots(docs: DataFrame, frequent: DataFrame, least: int, bound: int):
    """The phrases with the counts of their cuts, or None where a level has more candidates than `bound`.

    frequent: (lang, word) of `least` occurrences. Returns (lang, words, a, l1, r1, l2, r2), the second cut null for pairs.
    """
    spark = docs.sparkSession
    if frequent.count() > bound:
        return None
    slots: dict[str, dict[bytes, int]] = {}
    table = frequent.toArrow()
    for i, (name, word) in enumerate(zip(table.column("lang").to_pylist(), table.column("word").cast("binary").to_pylist(), strict=True)):
        slots.setdefault(name, {})[word] = i
    w = spark.sparkContext.broadcast(slots)

    coded = written(_coded(docs, w), "coded")  # the texts are taken apart once

    def pair_keys():
        def run(batch):
            keys = _pairs(_numbers(batch))
            return keys[keys >= 0]

        return run

    pairs = written(_frequent(coded, pair_keys, least), "pairs")
    if pairs.count() > bound:
        out = _keyed(coded, frequent, w, pairs, least) if table.num_rows < 1 << PACKED else None
        drop(coded, pairs)
        return out
    p = spark.sparkContext.broadcast(PerfectHash(_keys(pairs)))

    def triple_keys():
        hashed = p.value

        def run(batch):
            s = _numbers(batch)
            keys = _triples(s, _pair_slots(s, hashed))
            return keys[keys >= 0]

        return run

    triples = written(_frequent(coded, triple_keys, least), "triples")
    if triples.count() > bound:
        out = _keyed(coded, frequent, w, pairs, least) if table.num_rows < 1 << PACKED else None
        drop(coded, pairs, triples)
        return out
    t = spark.sparkContext.broadcast(PerfectHash(_keys(triples)))
    n1, n2, n3 = table.num_rows, p.value.size, t.value.size

    def count():
        two, three = p.value, t.value

        def run(batch):
            s = _numbers(batch)
            ps = _pair_slots(s, two)
            ts = _triples(s, ps)
            ts = three.slots(ts[ts >= 0])
            return np.concatenate([s[s >= 0], n1 + ps[ps >= 0], n1 + n2 + ts[ts >= 0]])

        return run

    counts = written(slot_rows(counted_slots(coded, count, n1 + n2 + n3)), "slots")
    of = lambda low, high, slot, n: counts.where((F.col("slot") >= low) & (F.col("slot") < high)).select((F.col("slot") - low).alias(slot), F.col("n").alias(n))
    key_slots = lambda hashed: lambda: lambda batch: hashed.value.slots(batch.column(0).to_numpy())
    named = _with_slots(frequent.select("lang", "word"), _word_slots(w), ["lang", "word"])
    one = lambda k: named.join(of(0, n1, "slot", "n"), "slot").select(F.col("slot").alias(f"s{k}"), F.col("lang").alias(f"lang{k}"), F.col("word").alias(f"w{k}"), F.col("n").alias(f"n{k}"))
    two_ = of(n1, n1 + n2, "slot", "n2").join(_with_slots(pairs.select("key"), key_slots(p), ["key"]), "slot").select("slot", F.shiftright("key", 32).alias("s1"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("s2"), F.col("n2").alias("n"))
    two_ = written(two_, "two")
    as_pair = lambda k: two_.select(F.col("slot").alias(f"p{k}"), F.col("s1").alias(f"a{k}"), F.col("s2").alias(f"b{k}"), F.col("n").alias(f"m{k}"))
    three_ = of(n1 + n2, n1 + n2 + n3, "slot", "n").join(_with_slots(triples.select("key"), key_slots(t), ["key"]), "slot").select(F.shiftright("key", 32).alias("p1"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("s3"), "n")
    null = F.lit(None).cast("long")
    two_rows = two_.join(one(1), "s1").join(one(2), "s2").select(F.col("lang1").alias("lang"), F.array("w1", "w2").alias("words"), F.col("n").alias("a"), F.col("n1").alias("l1"), F.col("n2").alias("r1"), null.alias("l2"), null.alias("r2"))
    three_ = three_.join(as_pair(1), "p1").join(as_pair(2), (F.col("a2") == F.col("b1")) & (F.col("b2") == F.col("s3")))
    three_ = three_.select(F.col("a1").alias("s1"), F.col("b1").alias("s2"), "s3", "n", "m1", "m2")
    three_rows = three_.join(one(1), "s1").join(one(2), "s2").join(one(3), "s3").select(F.col("lang1").alias("lang"), F.array("w1", "w2", "w3").alias("words"), F.col("n").alias("a"), F.col("n1").alias("l1"), F.col("m2").alias("r1"), F.col("m1").alias("l2"), F.col("n3").alias("r2"))
    out = written(two_rows.union(three_rows), "phrases")
    drop(coded, pairs, triples, counts, two_)
    return out


def _word_slots(w):
    return lambda: lambda batch: [w.value[x][y] for x, y in zip(_langs(batch), texts(batch, "word"), strict=True)]


def _keyed(coded: DataFrame, frequent: DataFrame, w, pairs: DataFrame, least: int) -> DataFrame:
    """What by_slots gives where a level has too many candidates for a hash: keys of numbers are counted as rows, those of pairs are there already."""

    def triple_keys():
        def run(batch):
            keys = _packed_triples(_numbers(batch))
            return keys[keys >= 0]

        return run

    triples = written(_frequent(coded, triple_keys, least), "triples")
    named = written(_with_slots(frequent.select("lang", "word", "n"), _word_slots(w), ["lang", "word", "n"]), "named")
    one = lambda k: named.select(F.col("slot").alias(f"s{k}"), F.col("lang").alias(f"lang{k}"), F.col("word").alias(f"w{k}"), F.col("n").alias(f"n{k}"))
    null, low = F.lit(None).cast("long"), (1 << PACKED) - 1
    two = pairs.select(F.shiftright("key", 32).alias("s1"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("s2"), "n").join(one(1), "s1").join(one(2), "s2")
    two = two.select(F.col("lang1").alias("lang"), F.array("w1", "w2").alias("words"), F.col("n").alias("a"), F.col("n1").alias("l1"), F.col("n2").alias("r1"), null.alias("l2"), null.alias("r2"))
    three = triples.select(F.shiftright("key", 2 * PACKED).alias("s1"), F.shiftright("key", PACKED).bitwiseAND(low).alias("s2"), F.col("key").bitwiseAND(low).alias("s3"), "n")
    pair = lambda a, b, n: pairs.select(F.shiftright("key", 32).alias(a), F.col("key").bitwiseAND(0xFFFFFFFF).alias(b), F.col("n").alias(n))
    three = three.join(pair("s1", "s2", "m1"), ["s1", "s2"]).join(pair("s2", "s3", "m2"), ["s2", "s3"]).join(one(1), "s1").join(one(2), "s2").join(one(3), "s3")
    three = three.select(F.col("lang1").alias("lang"), F.array("w1", "w2", "w3").alias("words"), F.col("n").alias("a"), F.col("n1").alias("l1"), F.col("m2").alias("r1"), F.col("m1").alias("l2"), F.col("n3").alias("r2"))
    out = written(two.union(three), "phrases")
    drop(triples, named)
    return out


def _with_slots(df: DataFrame, slots, keep: list[str]) -> DataFrame:
    """df with the slot that slots()(batch) gives each row."""
    return map_batches(df, lambda: lambda batch: [slots()(batch)], [("slot", "long")], keep)


def _grams(docs: DataFrame, size: int) -> DataFrame:
    """(lang, words) of all runs of `size` words within pieces, as rows."""
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    piece = docs.select("lang", F.explode(F.split(low, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    ws = piece.select("lang", F.filter(F.split("piece", r"[\x20\x09]+"), lambda w: w != "").alias("ws")).where(F.size("ws") >= size)
    return ws.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - size + 1), lambda i: F.slice("ws", i, size))).alias("words"))


def shuffled(docs: DataFrame, frequent: DataFrame, least: int) -> DataFrame:
    """What by_slots gives, from rows of strings: each level counts what is left after semi-joins with the one below."""
    one = frequent.select("lang", F.array("word").alias("words"))
    counted = written(frequent.select("lang", F.array("word").alias("words"), "n"), "level")
    levels = [counted]
    for size in (2, 3):
        part = lambda at, size=size: one.select("lang", F.col("words").alias(f"part{at}"))
        g = _grams(docs, size).groupBy("lang", "words").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        g = g.withColumns({"part1": F.slice("words", 1, size - 1), "part2": F.slice("words", 2, size - 1)})
        g = g.join(part(1), ["lang", "part1"], "left_semi").join(part(2), ["lang", "part2"], "left_semi").select("lang", "words", "n")
        levels.append(written(g, "level"))
        one = levels[-1].select("lang", "words")
    words, pairs, triples = levels
    count = lambda df, key, n: df.select("lang", F.col("words").alias(key), F.col("n").alias(n))
    w = lambda k, n: F.slice("words", k, n)
    null = F.lit(None).cast("long")
    two = pairs.select("lang", "words", F.col("n").alias("a"), w(1, 1).alias("k1"), w(2, 1).alias("k2"))
    two = two.join(count(words, "k1", "l1"), ["lang", "k1"]).join(count(words, "k2", "r1"), ["lang", "k2"]).select("lang", "words", "a", "l1", "r1", null.alias("l2"), null.alias("r2"))
    three = triples.select("lang", "words", F.col("n").alias("a"), w(1, 1).alias("k1"), w(2, 2).alias("k2"), w(1, 2).alias("k3"), w(3, 1).alias("k4"))
    for df, key, n in ((words, "k1", "l1"), (pairs, "k2", "r1"), (pairs, "k3", "l2"), (words, "k4", "r2")):
        three = three.join(count(df, key, n), ["lang", key])
    return two.union(three.select("lang", "words", "a", "l1", "r1", "l2", "r2"))


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, held: int = HELD, bound: int = BOUND) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` candidates that no longer one holds with `held` % of its count."""
    tune(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    words = written(word_counts(docs), "words")
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    phrases = by_slots(docs, frequent, least, bound)
    if phrases is None:
        phrases = written(shuffled(docs, frequent, least), "phrases")
    wide = lambda c: F.col(c).cast("decimal(12,0)")
    score = lambda k: F.when(F.col(f"l{k}").isNotNull(), F.call_function("div", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), wide(f"l{k}") * wide(f"r{k}")))
    cut = phrases.select("*", score(1).alias("score1"), score(2).alias("score2"))
    second = F.coalesce(F.col("score2") < F.col("score1"), F.lit(False))
    cut = cut.select("lang", "words", "a", *(F.when(second, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(c) for c in ("l", "r", "score")))
    three = cut.where(F.size("words") == 3).select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(F.array(F.slice("words", 1, 2), F.slice("words", 2, 2)))).alias("words"))
    holders = three.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    left = cut.join(holders, ["lang", "words"], "left").where(F.coalesce(100 * F.col("longer") < held * F.col("a"), F.lit(True)))
    left = left.withColumn("phrase", F.array_join("words", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(F.broadcast(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g1 AS (SELECT lang, ph, count(*) AS f FROM (SELECT lang, unnest(ws) AS ph FROM w) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g1 GROUP BY lang),
g2 AS (SELECT lang, x, y, count(*) AS f FROM (SELECT lang, ws[i] AS x, ws[i + 1] AS y FROM w, unnest(range(1, len(ws))) AS u(i)) GROUP BY ALL),
g3 AS (SELECT lang, x, y, z, count(*) AS f FROM (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z FROM w, unnest(range(1, len(ws) - 1)) AS u(i)) GROUP BY ALL HAVING count(*) >= 10),
c2 AS (SELECT g2.lang, g2.x, g2.y, g2.f AS a, l.f AS l, r.f AS r FROM g2 JOIN g1 l ON l.lang = g2.lang AND l.ph = x JOIN g1 r ON r.lang = g2.lang AND r.ph = y WHERE g2.f >= 10),
s2 AS (SELECT lang, x, y, a, l, r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM c2),
c3 AS (SELECT g3.lang, g3.x, g3.y, g3.z, g3.f AS a, l1.f AS l1, r1.f AS r1, l2.f AS l2, r2.f AS r2 FROM g3 JOIN g1 l1 ON l1.lang = g3.lang AND l1.ph = g3.x JOIN g2 r1 ON r1.lang = g3.lang AND r1.x = g3.y AND r1.y = g3.z JOIN g2 l2 ON l2.lang = g3.lang AND l2.x = g3.x AND l2.y = g3.y JOIN g1 r2 ON r2.lang = g3.lang AND r2.ph = g3.z),
k3 AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l1 AS HUGEINT) * r1) AS BIGINT) AS q1, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l2 AS HUGEINT) * r2) AS BIGINT) AS q2 FROM c3),
h AS (SELECT lang, x, y, max(a) AS longer FROM (SELECT lang, x, y, a FROM c3 UNION ALL SELECT lang, y, z, a FROM c3) GROUP BY lang, x, y),
o AS (SELECT s2.lang, s2.x || ' ' || s2.y AS phrase, s2.a, s2.l, s2.r, s2.score FROM s2 LEFT JOIN h ON h.lang = s2.lang AND h.x = s2.x AND h.y = s2.y WHERE h.longer IS NULL OR 100 * h.longer < 50 * s2.a
 UNION ALL SELECT lang, x || ' ' || y || ' ' || z, a, CASE WHEN q2 < q1 THEN l2 ELSE l1 END, CASE WHEN q2 < q1 THEN r2 ELSE r1 END, least(q1, q2) FROM k3),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT b.lang, rank, phrase, a, l, r, n, score FROM b JOIN total USING (lang) WHERE rank <= 2000
"""

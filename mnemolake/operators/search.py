"""Batched retrieval: BM25, exact cosine and the fused, explained score. Every function takes DataFrames of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, bit_length, collapse, first_of, fts_tokens, importance, query_tokens
from ..sources.scratch import cut
from .string_join import holders
from ..schema import BASE_WEIGHT_FACTOR, DAY, FREQUENCY, FRESHNESS, FTS_WEIGHT, HOUR_BOOST, INTENT_BOOST, INTENT_CUES, LONG_TERM, MIN_FUSED, PROJECT_BOOST, REINFORCEMENT, TOP_K, TYPE_BOOST, TYPE_DECAY, VECTOR_WEIGHT, lookup

K1, B = 1.2, 0.75


#: A batch of queries is sent to every task if the planner's size for it is within BATCH_BYTES or, where it has none, its rows are within BATCH_ROWS.
BATCH_BYTES, BATCH_ROWS = 32 << 20, 10_000


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is known to be small; a larger batch is left to the planner, which deals it out."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= BATCH_BYTES or df.limit(BATCH_ROWS + 1).count() <= BATCH_ROWS else df


def postings(memory: DataFrame) -> DataFrame:
    """(id, d, field, pos, token) of content, type and tags; d is the number of tokens of the row."""
    fields = ("content", "type", "tags")
    tokens = memory.select("id", *(F.coalesce(fts_tokens(F.col(c)), F.array().cast("array<string>")).alias(f"_{c}") for c in fields))
    sized = tokens.select("id", sum((F.size(f"_{c}") for c in fields), F.lit(0)).alias("d"), F.array(*(f"_{c}" for c in fields)).alias("fields"))  # before any row is multiplied; outer, or the planner tests each array twice
    return sized.select("id", "d", F.posexplode_outer("fields").alias("field", "tokens")).select("id", "d", "field", F.posexplode("tokens").alias("pos", "token"))


def statistics(memory: DataFrame) -> DataFrame:
    """One row: total and mean number of tokens."""
    d = sum((F.coalesce(F.size(fts_tokens(F.col(c))), F.lit(0)) for c in ("content", "type", "tags")), F.lit(0))
    return memory.select(F.greatest(d, F.lit(0)).alias("d")).agg(F.count(F.lit(1)).alias("total"), F.avg("d").alias("mean"))


def bm25(memory: DataFrame, queries: DataFrame, index=None) -> DataFrame:
    """(query_id, id, bm25) of every row with a phrase of the query; negative, smaller is better.

    A query is an OR of its white-space tokens, each a phrase of letter-digit runs. The elements of all phrases meet the
    postings in one join; a phrase stands where all its elements agree on the start. Statistics count every row. With an
    index (text_index.SegmentedIndex) the texts are not read.
    """
    if index is not None:
        return index.all(queries)
    terms = queries.select("query_id", F.explode(F.split("q", r"\s+")).alias("w")).select("query_id", fts_tokens(F.col("w")).alias("phrase")).where(F.size("phrase") > 0)
    terms = terms.groupBy("query_id", F.array_join("phrase", " ").alias("name"), F.size("phrase").alias("len")).agg(F.count(F.lit(1)).alias("times"), F.first("phrase").alias("phrase"))
    elements = small(terms.select("name", "len", F.posexplode("phrase").alias("j", "token")).distinct())
    found = postings(memory)
    # a phrase of one token stands wherever that token does, so its places need not be told apart
    alone = F.col("len") == 1
    starts = found.join(elements, "token").groupBy("name", "len", "id", "d", F.when(~alone, F.col("field")).alias("field"), F.when(~alone, F.col("pos") - F.col("j")).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    freq = cut(starts.where("len = 1 OR n = len").groupBy("name", "id", "d").agg(F.sum(F.when(alone, F.col("n")).otherwise(1)).alias("f")))  # read twice, the texts once
    corpus = statistics(memory)
    df = freq.groupBy("name").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf > 0, idf).otherwise(1e-6) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("d") / F.col("mean")))
    scored = freq.join(df, "name").join(F.broadcast(corpus)).select("name", "id", weight.alias("w"))  # one row of statistics
    return scored.join(terms.select("query_id", "name", "times"), "name").groupBy("query_id", "id").agg((-F.sum(F.col("w") * F.col("times"))).alias("bm25"))


def ranked(df: DataFrame, order: list[Column], k: int, by: str = "query_id") -> DataFrame:
    """The first k rows of each query, with their rank; Spark limits each group before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def fts(memory: DataFrame, queries: DataFrame, k: int, min_weight: float = 0.0, index=None) -> DataFrame:
    live = memory.where(~F.col("archived") & (F.col("weight") >= min_weight)).select("id")
    if index is not None:
        return index.top(queries, k, live)
    return ranked(bm25(memory, queries, index).join(live, "id", "left_semi"), [F.round("bm25", 9), F.col("id")], k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def knn(vectors: DataFrame, queries: DataFrame, k: int, min_weight: float = 0.0) -> DataFrame:
    """Exact cosine of a stated set of queries (query_id, qv) against all rows: (query_id, id, score, rank)."""
    v = vectors.withColumn("norm", F.sqrt(dot(F.col("embedding"), F.col("embedding"))))
    q = queries.withColumn("qnorm", F.sqrt(dot(F.col("qv"), F.col("qv"))))
    cos = F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(F.col("embedding"), F.col("qv")) / (F.col("norm") * F.col("qnorm"))))
    hits = v.where(F.col("weight") >= min_weight).join(small(q)).select("query_id", "id", "type", "weight", cos.alias("score"))
    return ranked(hits, [F.desc(F.round("score", 9)), F.col("id")], k)


_ATTRIBUTES = ["type", "weight", "created", "tags", "access_count", "reinforcement", "last_accessed", "long_term", "content"]


def candidates(memory: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, times: DataFrame, k: int = TOP_K, index=None) -> DataFrame:
    """The three paths merged by (query, id): raw scores add up, attributes come from the path that arrives first.

    A row that only the vector index knows has no dates, tags or counts, so it neither decays nor gains by them.
    """
    n = max(2 * k, 6)
    rows = memory.select("id", *_ATTRIBUTES)
    path = lambda df, no, raw: df.select("query_id", "id", F.struct(F.lit(no).alias("no"), "rank").alias("arrival"), F.lit(raw[0]).alias("path"), raw[1].alias("raw"))
    a = path(fts(memory, queries, n, index=index), 0, ("fts", FTS_WEIGHT / F.col("rank")))
    b = path(knn(vectors, query_vectors, n), 1, ("vector", VECTOR_WEIGHT * F.col("score")))
    in_range = memory.join(small(times), F.col("created").between(F.col("lo"), F.col("hi"))).select("query_id", "id", "weight", "last_accessed")
    c = path(ranked(in_range, [F.desc("weight"), F.desc("last_accessed"), F.col("id")], n), 2, ("time", F.lit(1.0)))
    merged = a.union(b).union(c).groupBy("query_id", "id").agg(
        F.min_by("path", "arrival").alias("source"), F.min("arrival").alias("arrival"), F.sum("raw").alias("raw"), *(F.sum(F.when(F.col("path") == p, F.col("raw")).otherwise(0.0)).alias(f"raw_{p}") for p in ("fts", "vector", "time"))
    )
    out = merged.join(rows, "id")
    bare = F.col("source") == "vector"
    for name, zero in (("created", 0.0), ("access_count", 0), ("reinforcement", 0.0), ("last_accessed", 0.0), ("long_term", False), ("tags", "")):
        out = out.withColumn(name, F.when(bare, F.lit(zero)).otherwise(F.col(name)))
    return out


def scored(found: DataFrame, queries: DataFrame, now: float, *, coding: bool = False, situational: bool = True, intents: bool = True) -> DataFrame:
    """Multiply the raw score by weight, decay, type, use and situation; each factor is a signal column."""
    intent = first_of(F.lower("q"), INTENT_CUES, "GENERAL") if intents else F.lit("GENERAL")
    df = found.join(small(queries.select("query_id", intent.alias("intent"))), "query_id")
    per_day = lookup({k: v[0] for k, v in TYPE_DECAY.items()}, F.col("type"), TYPE_DECAY["default"][0])
    floor = lookup({k: v[1] for k, v in TYPE_DECAY.items()}, F.col("type"), TYPE_DECAY["default"][1])
    days = (F.lit(now) - F.col("created")) / DAY
    wanted = F.lit(1.0)
    for name, table in INTENT_BOOST.items():
        wanted = F.when(F.col("intent") == name, lookup(table, F.col("type"), 1.0)).otherwise(wanted)
    use = (
        F.when(F.col("access_count") > 0, F.least(F.lit(0.25), bit_length(F.col("access_count") + 1) * FREQUENCY)).otherwise(0.0) + F.when(F.col("reinforcement") > 0, F.least(F.lit(0.15), F.col("reinforcement") * REINFORCEMENT)).otherwise(0.0)
        + F.when((F.col("last_accessed") > 0) & (F.lit(now) - F.col("last_accessed") < 7 * DAY), FRESHNESS).otherwise(0.0) + F.when(F.col("long_term"), LONG_TERM).otherwise(0.0)
    )
    hour = lambda c: F.pmod(F.floor(c / 3600), F.lit(24))
    apart = F.abs(hour(F.col("created")) - hour(F.lit(now)))
    at = F.when(F.lit(coding) & F.col("tags").contains("v5_project"), PROJECT_BOOST).otherwise(0.0) + F.when((F.col("created") != 0) & ((apart <= 1) | (apart >= 23)), HOUR_BOOST).otherwise(0.0)
    df = df.select(
        "*", (BASE_WEIGHT_FACTOR + (1 - BASE_WEIGHT_FACTOR) * F.col("weight")).alias("s_weight"), F.when((F.col("source") != "time") & (F.col("created") != 0) & (days > 0), F.greatest(floor, 1 - per_day * days)).otherwise(1.0).alias("s_decay"),
        (lookup(TYPE_BOOST, F.col("type"), 1.0) * wanted).alias("s_type"), use.alias("s_use"), (at if situational else F.lit(0.0)).alias("s_situation"), importance(F.col("weight"), F.col("access_count"), F.col("last_accessed"), now, F.col("reinforcement")).alias("s_ei"),
    )
    return df.withColumn("score", F.col("raw") * F.col("s_weight") * F.col("s_decay") * F.col("s_type") * (1 + F.col("s_use")) * (1 + F.col("s_situation")))


def retrieve(found: DataFrame, k: int = TOP_K, least: float = MIN_FUSED) -> DataFrame:
    """Scores of at least `least`, best first; equal scores keep the order of arrival."""
    return ranked(found.where(F.col("score") >= least), [F.desc(F.round("score", 9)), F.col("arrival"), F.col("id")], k)


def keyword_fallback(memory: DataFrame, queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, id, rank) that fill up queries with fewer than k rows of `found` (query_id, id, ...) and two words at least.

    The rarest word comes first; each adds its three heaviest rows that are not there yet, as long as fewer than k rows
    were there before it. Words are looked for as substrings, all of them in one walk over the texts.
    """
    n = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = queries.join(n, "query_id", "left").select("query_id", "q", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k)
    words = short.withColumn("ws", query_tokens(F.col("q"))).where(F.size("ws") >= 2).select("query_id", "n", F.posexplode("ws").alias("i", "w"))
    live = memory.where("NOT archived").select("id", "weight", ascii_lower(F.col("content")).alias("x"))
    hit = cut(holders(words.select(F.col("w").alias("needle")).distinct(), live.where("x IS NOT NULL").select("id", "x")).join(live.select("id", "weight"), "id").select(F.col("needle").alias("w"), "id", "weight"))
    df = hit.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    best = ranked(hit, [F.desc("weight"), F.desc("id")], 3, "w").withColumnRenamed("rank", "r")
    rows = words.join(df, "w").join(best, "w").join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")
    rows = rows.groupBy("query_id", "id", "n").agg(F.min(F.col("df") * 1_000_000 + F.col("i") * 1000 + F.col("r")).alias("o")).withColumn("word", F.floor(F.col("o") / 1000))
    by = Window.partitionBy("query_id")
    rows = rows.withColumn("before", F.count(F.lit(1)).over(by.orderBy("word").rangeBetween(Window.unboundedPreceding, -1))).withColumn("p", F.row_number().over(by.orderBy("o")))
    return rows.where(F.col("n") + F.col("before") < k).select("query_id", "id", (F.col("n") + F.col("p")).cast("int").alias("rank"))


def note_fallback(notes: DataFrame, queries: DataFrame, have: DataFrame, k: int, least: int = 3) -> DataFrame:
    """(query_id, note_id, content, score, rank) for queries with fewer than `least` rows of `have` (query_id): notes (note_id, title, body) that hold their words.

    A note scores one for each word in its body and two if its title holds one; the best fill up to k, each content once.
    """
    n = have.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    words = F.filter(F.split(F.lower(F.trim("q")), r"[\s,，。、]+"), lambda w: F.length(w) >= 2)
    short = queries.join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"), words.alias("ws")).where((F.col("n") < least) & (F.size("ws") > 0))
    x = notes.select("note_id", "title", F.trim("body").alias("body")).join(small(short))  # the few queries left, each against all notes
    low = F.lower("body")
    hits = F.size(F.filter("ws", lambda w: low.contains(w))) + F.when(F.exists("ws", lambda w: F.lower("title").contains(w)) & F.exists("ws", lambda w: low.contains(w)), 2).otherwise(0)
    x = x.withColumn("hits", hits).where("hits > 0")
    x = ranked(x, [F.desc("hits"), F.col("note_id")], k).where(F.col("rank") <= k - F.col("n"))
    content = F.substring(F.concat(F.lit("[vault] "), "title", F.lit(": "), collapse(F.substring("body", 1, 300))), 1, 400)
    x = x.withColumn("content", content).withColumn("first", F.min("rank").over(Window.partitionBy("query_id", "content"))).where("rank = first")
    return x.select("query_id", "note_id", "content", F.least(F.lit(1.0), F.col("hits") * 0.12).alias("score"), F.col("n").alias("before"), "rank")

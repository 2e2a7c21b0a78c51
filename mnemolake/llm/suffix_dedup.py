"""Exact substring dedup: every byte that lies in a `span`-byte string which also starts elsewhere.

The suffix structure is built column by column over many short documents at once: each round inserts one symbol per
document in front of its suffix, which updates the collection's Burrows-Wheeler column, the order of the suffixes and
their common prefixes. Symbols lie in a file by column; order and prefixes go from one round to the next through files
that are read and written from front to back, in blocks of whole groups (BLOCK suffixes, or one larger group).

A round over a whole corpus cannot be dealt out, so the corpus is first cut such that equal strings meet:

1. Equal texts are stored once with their multiplicity, in a table bucketed by the text's hash; all later joins on
   that hash read it in place.
2. Each `span`-byte window has a minimizer, its leftmost smallest 64-byte gram. Windows in a row with one minimizer
   form a run. Equal windows have equal minimizers at equal distance, so runs aligned at the minimizer are the short
   documents, and equal windows stand in the same column of the same group. A group whose runs occur once in the
   corpus cannot hold a repeat and goes no further; equal runs of a group are stored once with their number.
3. Groups go through the column-wise construction. A window whose suffix shares `span` symbols with a neighbour in the
   order is a repeat (a run that occurs more than once is inserted twice).
4. A group of more than LIMIT different runs is cut anew, by distance to the minimizer and by the bytes that all
   windows of the piece share, four times finer each time; at one window per piece all runs of a group are equal.

Repeats are carried back to all occurrences, merged by text, and joined to the rows.

Defined cases: a null text is empty; texts shorter than `span` lose nothing; repeated rows repeat each other; matches
never cross texts; strings are judged on the input. The kept text drops only whole characters: a removed run is shrunk
to character borders there (the byte counts and the hash are exact).
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop, flat_batches, remove, scratch, tune, written
from .decontaminate import _window_min

SPAN, GRAM, LIMIT, STRINGS, BLOCK, BUCKET_BYTES = 400, 64, 20_000, 8192, 1 << 16, 128 << 20
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) mod 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        a = np.full(max(n, 1 << 16), base, np.uint64)
        a[0] = 1
        _powers[base] = np.cumprod(a)
    return _powers[base][:n]


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k bytes."""
    n = len(x)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _power(_P, n), out=h[1:])
    g = (h[k:] - h[: n - k + 1]) * _power(_INV, n - k + 1)
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    return g


def runs_of(text: bytes, span: int, gram: int) -> dict[tuple[int, bytes], list]:
    """(minimizer hash, content hash) -> [distance of the minimizer from the run's start, bytes, starts]."""
    if len(text) < span:
        return {}
    g = gram_hashes(np.frombuffer(text, np.uint8), gram)
    w = span - gram + 1
    m = _window_min(g, w)
    # the leftmost place of each window's minimum: the last place at or after the window's start that begins a stretch of it
    at = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    ends = np.append(at[1:], len(m))
    out: dict[tuple[int, bytes], list] = {}
    for a, z in zip(at.tolist(), ends.tolist(), strict=True):
        h = m[a]
        spots = a + np.flatnonzero(g[a : z + w - 1] == h)
        s = a
        for spot in spots.tolist():
            if s >= z:
                break
            e = min(spot + 1, z)  # windows s .. e - 1 have their leftmost minimum at spot
            if e > s:
                piece = text[s : e - 1 + span]
                key = int(h.astype(np.int64)), hashlib.blake2b(piece, digest_size=16).digest()
                if key in out:
                    out[key][2].append(s)
                else:
                    out[key] = [spot - s, len(piece), [s]]
                s = e
    return out


def pieces_of(text: bytes, h: int, start: int, anchor: int, size: int, width: int, span: int):
    """A run cut by the windows' distance to the minimizer: (new group, content hash, anchor, bytes, start)."""
    last = size - span
    for j in range((anchor - last) // width, anchor // width + 1):
        far, near = min(anchor, (j + 1) * width - 1), max(anchor - last, j * width)
        a, z = start + anchor - far, start + anchor - near + span
        core = text[start + anchor - j * width : start + anchor - ((j + 1) * width - 1) + span]
        group = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=f"{h} {j}".encode()).digest(), "little", signed=True)
        yield group, hashlib.blake2b(text[a:z], digest_size=16).digest(), far, z - a, a


#: What a round leaves in its file for each suffix, in their order: the document and the prefix shared with the suffix before.
_STATE = np.dtype([("doc", "<u4"), ("lcp", "<u2")])


def _insert(state: np.ndarray, symbols: np.ndarray, group: np.ndarray) -> np.ndarray:
    """One round for whole groups: put a symbol in front of each document's suffix. state: in order, documents from 0."""
    perm, lcp = state["doc"], state["lcp"]
    bwt = symbols[perm]  # the symbols in front of the suffixes, in their order
    same = np.concatenate([[False], group[1:] == group[:-1]])
    mixed = np.zeros(int(group[-1]) + 1, bool)
    mixed[group[same & np.concatenate([[False], bwt[1:] != bwt[:-1]])]] = True
    out = np.empty(len(state), _STATE)
    out["doc"], out["lcp"] = perm, np.where(same & (bwt > 0), lcp + 1, 0)
    sub = np.flatnonzero(mixed[group])
    if len(sub):
        key = group[sub] * 512 + bwt[sub]
        order = np.argsort(key, kind="stable")
        joined = np.concatenate([[False], key[order][1:] == key[order][:-1]]) & (bwt[sub][order] > 0)
        out["lcp"][sub] = np.where(joined, _between(lcp[sub], order) + 1, 0)
        out["doc"][sub] = perm[sub][order]
    return out


def repeats(strings: list[bytes], anchors: list[int], copies: list[int], groups: list[int], span: int, block: int = BLOCK, firsts: list | None = None) -> np.ndarray:
    """strings x window starts: 1 where that window also starts elsewhere in its group, else 0. Strings of a group are adjacent.

    firsts: by string, its first occurrence (text key, start); then 2 marks the string that holds the first of all
    occurrences of a repeated window.

    Each round reads the order and the common prefixes that the round before wrote, and its column of symbols, from
    front to back in blocks of whole groups, and writes its own the same way. The files are this task's scratch, as its
    sort's spill is: no other task reads them, and a task that is run again makes its own.
    """
    index = np.repeat(np.arange(len(strings)), copies)
    anchor, size = np.array(anchors)[index], np.array([len(s) for s in strings])[index]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(np.array(groups)[index])) + 1, [len(index)]])
    group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    cuts = [0]
    for z in edge[1:].tolist():
        if z == len(index) or z - cuts[-1] >= block:
            cuts.append(z)
    blocks = list(zip(cuts[:-1], cuts[1:], strict=True))
    m, before, after = len(index), int(anchor.max()), int((size - anchor).max())
    found = np.zeros((len(strings), int(size.max()) - span + 1), np.uint8)
    rank = np.zeros(len(strings), np.int64)
    if firsts is not None:  # windows in one column stand at start + anchor and a distance common to all
        rank[sorted(range(len(strings)), key=lambda i: (firsts[i][0], firsts[i][1] + anchors[i]))] = np.arange(len(strings))
    with tempfile.TemporaryFile() as file, tempfile.TemporaryFile() as old, tempfile.TemporaryFile() as new:
        column = np.memmap(file, np.uint16, "w+", shape=(before + after, m))
        for i, s in enumerate(index.tolist()):
            column[before - anchor[i] : before - anchor[i] + size[i], i] = np.frombuffer(strings[s], np.uint8)
            column[before - anchor[i] : before - anchor[i] + size[i], i] += 1
        for a, z in blocks:
            state = np.zeros(z - a, _STATE)
            state["doc"] = np.arange(z - a)
            state.tofile(old)
        for x in range(before + after - 1, -1, -1):
            old.seek(0)
            new.seek(0)
            for a, z in blocks:
                state = _insert(np.fromfile(old, _STATE, z - a), column[x, a:z], group[a:z] - group[a])
                state.tofile(new)
                alike = state["lcp"] >= span  # with the suffix before
                if alike.any():
                    hit = alike.copy()
                    hit[:-1] |= alike[1:]
                    who = a + state["doc"][hit].astype(np.int64)
                    kind = 1
                    if firsts is not None:
                        same = np.cumsum(~alike[hit])
                        least = np.minimum.reduceat(rank[index[who]], np.flatnonzero(~alike[hit]))
                        kind = 1 + (rank[index[who]] == least[same - 1])
                    found[index[who], x - before + anchor[who]] = kind
            old, new = new, old
        del column
    return found


def _between(lcp: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place i of the new order: the minimum of lcp over (order[i - 1], order[i]]; arbitrary where order falls."""
    lo, hi = np.concatenate([[0], order[:-1]]) + 1, order
    gap = np.maximum(hi - lo + 1, 1)
    level = np.frexp(gap)[1] - 1
    out, table = np.zeros(len(order), np.uint16), lcp
    for k in range(int(level.max()) + 1):
        if k:
            step = 1 << k - 1
            table = np.minimum(table[:-step], table[step:])
        at = np.flatnonzero((level == k) & (lo <= hi))
        out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k) + 1])
    return out


def _to_spans(hit: np.ndarray, span: int) -> list[dict]:
    """Maximal byte runs [start, end) of the windows that are set."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > span)
    return [{"start": s, "end": e + span} for s, e in zip(at[np.concatenate([[0], cut + 1])].tolist(), at[np.append(cut, len(at) - 1)].tolist(), strict=True)]


_RUN = [("text_key", "binary"), ("h", "long"), ("content", "binary"), ("anchor", "int"), ("size", "int"), ("starts", "array<int>"), ("n", "long")]


def _runs(unique: DataFrame, span: int, gram: int) -> DataFrame:
    def make():
        def run(batch):
            for key, text, mult in zip(*(batch.column(c).to_pylist() for c in ("text_key", "body", "mult")), strict=True):
                found = runs_of(text, span, gram)
                if found:
                    yield [[key] * len(found), [h for h, _ in found], [c for _, c in found], [v[0] for v in found.values()], [v[1] for v in found.values()], [v[2] for v in found.values()], [len(v[2]) * min(mult, 2) for v in found.values()]]

        return run

    return flat_batches(unique.select("text_key", F.col("text").cast("binary").alias("body"), "mult"), make, _RUN)


def _recut(hot: DataFrame, unique: DataFrame, width: int, span: int) -> DataFrame:
    """Runs of hot groups, cut into pieces of at most `width` windows."""

    def make():
        def run(batch):
            for key, text, mult, runs in zip(*(batch.column(c).to_pylist() for c in ("text_key", "body", "mult", "runs")), strict=True):
                found: dict = {}
                for r in runs:
                    for start in r["starts"]:
                        for group, content, anchor, size, at in pieces_of(text, r["h"], start, r["anchor"], r["size"], width, span):
                            found.setdefault((group, content), [anchor, size, set()])[2].add(at)
                yield [[key] * len(found), [h for h, _ in found], [c for _, c in found], [v[0] for v in found.values()], [v[1] for v in found.values()], [sorted(v[2]) for v in found.values()], [len(v[2]) * min(mult, 2) for v in found.values()]]

        return run

    by_text = hot.groupBy("text_key").agg(F.collect_list(F.struct("h", "anchor", "size", "starts")).alias("runs"))
    return flat_batches(unique.join(by_text, "text_key").select("text_key", F.col("text").cast("binary").alias("body"), "mult", "runs"), make, _RUN)


def _repeated(runs: DataFrame) -> DataFrame:
    """Runs of the groups that have two occurrences at least."""
    often = runs.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    return runs.join(often, "h", "left_semi")


def _strings(cand: DataFrame, unique: DataFrame, span: int) -> DataFrame:
    """Each different run once, with its bytes, one or two copies and its first occurrence: h, content, anchor, copies, first_key, first_start, body."""
    one = cand.groupBy("h", "content").agg(F.min(F.struct("text_key", F.element_at("starts", 1).alias("start"), "anchor", "size")).alias("r"), F.least(F.sum("n"), F.lit(2)).cast("int").alias("copies"))
    by_text = one.groupBy(F.col("r.text_key").alias("text_key")).agg(F.collect_list(F.struct("h", "content", "r.start", "r.anchor", "r.size", "copies")).alias("runs"))

    def make():
        def run(batch):
            for key, text, runs in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                yield [[r[c] for r in runs] for c in ("h", "content", "anchor", "copies")] + [[key] * len(runs), [r["start"] for r in runs], [text[r["start"] : r["start"] + r["size"]] for r in runs]]

        return run

    return flat_batches(unique.join(by_text, "text_key").select("text_key", F.col("text").cast("binary").alias("body"), "runs"), make, [("h", "long"), ("content", "binary"), ("anchor", "int"), ("copies", "int"), ("first_key", "binary"), ("first_start", "int"), ("body", "binary")])


def _construct(strings: DataFrame, span: int, batch_strings: int, keep_first: bool) -> DataFrame:
    """Column-wise construction over whole groups; several small groups share the rounds.

    spans: where windows are repeats; rest: those of them that go at the run's first occurrence too.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("h", pa.int64()), ("content", pa.binary()), ("first_key", pa.binary()), ("first_start", pa.int32()), ("spans", kind), ("rest", kind)])

    def run(batches):
        held: list[tuple] = []

        def out():
            h, content, anchor, copies, key, start, body = zip(*held, strict=True)
            found = repeats(list(body), list(anchor), list(copies), list(h), span, firsts=list(zip(key, start, strict=True)) if keep_first else None)
            keep = np.flatnonzero(found.any(axis=1)).tolist()
            spans, rest = ([_to_spans(f, span) for f in x[keep]] for x in (found > 0, found == 1))
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([*([c[i] for i in keep] for c in (h, content, key, start)), spans, rest], schema, strict=True)], schema=schema)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("h", "content", "anchor", "copies", "first_key", "first_start", "body")), strict=True):
                if len(held) >= batch_strings and row[0] != held[-1][0]:
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    pairs = "array<struct<start:int,end:int>>"
    return strings.repartition("h").sortWithinPartitions("h").mapInArrow(run, f"h long, content binary, first_key binary, first_start int, spans {pairs}, rest {pairs}")


def _whole(text: bytes, start: int, end: int) -> tuple[int, int]:
    """The run shrunk to character borders."""
    while start < end and text[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def _by_text(cand: DataFrame, spans: DataFrame, unique: DataFrame, min_words: int, or_bytes: int) -> DataFrame:
    """text_key, n_removed, n_spans, kept_sha256, spans, kept_text of the texts that lose bytes."""
    first = F.when(F.col("first_key") == F.col("text_key"), F.col("first_start")).alias("first")  # null: the run's first occurrence is in another text
    found = cand.join(spans, ["h", "content"]).groupBy("text_key").agg(F.collect_list(F.struct("starts", "spans", "rest", first)).alias("found"))

    def make():
        def run(batch):
            out = []
            for key, text, rows in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                delta = np.zeros(len(text) + 1, np.int32)
                for r in rows:
                    at = np.array(r["starts"])
                    for at, runs in ((at[at != r["first"]], r["spans"]), (at[at == r["first"]], r["rest"])):
                        for s in runs if len(at) else ():
                            np.add.at(delta, at + s["start"], 1)
                            np.add.at(delta, at + s["end"], -1)
                gone = np.cumsum(delta[:-1]) > 0
                edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
                runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
                if min_words or not runs:
                    runs = [(s, e) for s, e in runs if e - s >= or_bytes or len(text[s:e].split()) >= min_words]
                    if not runs:
                        continue
                    gone[:] = False
                    for s, e in runs:
                        gone[s:e] = True
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                whole, last = [], 0
                for s, e in (_whole(text, *r) for r in runs):
                    whole.append(text[last:s])
                    last = e
                out.append((key, int(gone.sum()), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in runs], (b"".join(whole) + text[last:]).decode(errors="replace")))
            if out:
                yield list(map(list, zip(*out, strict=True)))

        return run

    rows = unique.join(found, "text_key").select("text_key", F.col("text").cast("binary").alias("body"), "found")
    return flat_batches(rows, make, [("text_key", "binary"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("spans", "array<struct<start:int,end:int>>"), ("kept_text", "string")])


def _buckets(docs: DataFrame, least: int) -> int:
    """As many buckets as there are shuffle partitions, more where the plan's estimate gives a bucket over BUCKET_BYTES."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return least if size >= 1 << 60 else min(100_000, max(least, -(-size // BUCKET_BYTES)))  # plans without files have no estimate


def text_key(text: str = "text"):
    return F.substring(F.unhex(F.sha2(F.col(text), 256)), 1, 16)


def repeated_spans(docs: DataFrame, *, text: str = "text", span: int = SPAN, gram: int = GRAM, limit: int = LIMIT, batch_strings: int = STRINGS, min_words: int = 0, or_bytes: int = SPAN, keep_first: bool = False) -> DataFrame:
    """By distinct text that loses bytes: text_key, n_removed, n_spans, kept_sha256, spans, kept_text (a written table).

    With min_words, maximal runs of fewer words (between blanks; a word cut by the border counts) stay in the text,
    unless they have or_bytes bytes. With keep_first, the first occurrence of every repeated string stays, in the order of
    text key and place; rows with one text are alike, so they keep it together.
    """
    spark = tune(docs.sparkSession)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = _buckets(docs, shuffles)
    name, path = f"unique_{uuid.uuid4().hex}", scratch(spark, "unique")
    long = docs.where(F.octet_length(F.col(text)) >= span).select(text_key(text).alias("text_key"), F.col(text).alias("text"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(buckets))  # so that each task of the sum writes whole buckets
        long.groupBy("text_key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("mult")).write.bucketBy(buckets, "text_key").option("path", path).saveAsTable(name)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffles))
    unique, tables = spark.table(name), []
    try:
        runs = written(_runs(unique, span, gram), "runs")
        cand = written(_repeated(runs), "repeated")
        drop(runs)
        settled, width = [], span - gram + 1
        while True:
            tables.append(cand)
            hot = cand.groupBy("h").agg(F.count_distinct("content").alias("c")).where(F.col("c") > limit).select("h")
            if width == 1 or (hot := written(hot, "hot")).isEmpty():
                settled.append(cand)
                break
            tables.append(hot)
            settled.append(cand.join(hot, "h", "left_anti"))
            width = -(-width // 4)
            cand = written(_repeated(written(_recut(cand.join(hot, "h", "left_semi"), unique, width, span), "pieces")), "repeated")
        every = settled[0]
        for s in settled[1:]:
            every = every.union(s)
        spans = written(_construct(_strings(every, unique, span), span, batch_strings, keep_first), "spans")
        out = written(_by_text(every, spans, unique, min_words, or_bytes), "removed")
        drop(spans, *tables)
        return out
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    gone = repeated_spans(docs).select("text_key", "n_removed", "n_spans", "kept_sha256")
    rows = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("all_sha256"), text_key().alias("text_key")).join(gone, "text_key", "left")
    return rows.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"))


ORACLE = None

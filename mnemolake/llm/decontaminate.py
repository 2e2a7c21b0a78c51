"""Benchmark decontamination by winnowing.

Each text keeps the smallest k-gram hash of every window of w consecutive k-grams, so any span of k + w - 1 words that
document and benchmark share leaves a fingerprint in both. Document fingerprints are looked up among the benchmark's, and
each hit is extended word by word in both directions, as far as windows of `span` words through the hit reach; extensions
of at least `span` words are contamination (what lies further out has fingerprints of its own).

A benchmark of at most `broadcast_words` words (counted first) is broadcast as one index: places of a hash whose
surroundings are equal are one entry with a list of items, and hits are extended against all entries at once in numpy,
`_PAIRS` at a time. The documents are then read once and nothing is shuffled.

A larger benchmark is joined by shuffle: fingerprints of distinct texts meet the benchmark's distinct hashes; around
the hits the windows are made, and those that equal a window of the benchmark (by a 128-bit hash, distinct on the
benchmark's side) are the extension; items follow from the distinct windows of a text. Every join has one side without
repeats, so no common gram pairs all its documents with all its items.

Defined cases: a null or empty text has no words and is clean; an item of fewer words than `span` must occur whole; an
item without words never matches; an item with a null id marks words but is not listed; repeated ids are listed once;
repeated documents are judged alike, each for itself; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, flat_batches, map_batches, texts, tune, words, written

SPAN, GRAM, BROADCAST_WORDS, _PAIRS = 13, 5, 1_000_000, 1 << 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive word ids."""
    x = ids.astype(np.uint64) * _A
    x ^= x >> np.uint64(29)
    x *= _B
    n = len(x) - k + 1
    g = x[:n].copy()
    for j in range(1, k):
        g *= _A
        g += x[j : j + n]
    g ^= g >> np.uint64(31)
    return g


def _window_min(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    out, have = g, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _stretches(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows in a row have one minimum: starts and ends."""
    first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    return first, np.append(first[1:], len(m))


def fingerprints(ids: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the k-grams that are the minimum of a window; equal minima of a stretch all count."""
    if len(ids) < k + w - 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    g = _grams(ids, k)
    m = _window_min(g, w)
    h, p = [], []
    for a, z in zip(*_stretches(m), strict=True):
        at = a + np.flatnonzero(g[a : z + w - 1] == m[a])
        h.append(np.full(len(at), m[a]))
        p.append(at)
    h, p = np.concatenate(h), np.concatenate(p)
    p, once = np.unique(p, return_index=True)
    return h[once], p


def _around(padded: np.ndarray, places: np.ndarray, k: int, m: int) -> np.ndarray:
    """The words within m - k of each k-gram, itself included; padded has m separators (-1) in front and behind."""
    return padded[places[:, None] + np.arange(k, 2 * m)[None, :]]


def _reach(mine: np.ndarray, theirs: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words before and behind the k-gram are equal in a row, m - k at most; -1, -1 where the gram itself differs."""
    same, side = (mine == theirs) & (theirs >= 0), m - k
    end = np.ones((len(same), 1), bool)
    left = np.argmax(np.hstack([~same[:, :side][:, ::-1], end]), axis=1)
    right = np.argmax(np.hstack([~same[:, side + k :], end]), axis=1)
    whole = same[:, side : side + k].all(axis=1)
    return np.where(whole, left, -1), np.where(whole, right, -1)


class Index:
    """The benchmark's vocabulary and, by the length m of what must be shared, its fingerprints with their surroundings."""

    def __init__(self, items: dict[tuple[bytes, ...], set[str | None]], span: int, gram: int):
        vocab: dict[bytes, int] = {}
        seqs = [np.array([vocab.setdefault(w, len(vocab) + 1) for w in item], np.int64) for item in items]
        self.vocab, self.span, self.gram = vocab, span, gram
        self.names = [sorted(x for x in names if x is not None) for names in items.values()]
        self.classes = []  # one for whole windows, one for each length of short items
        for m in sorted({min(len(s), span) for s in seqs}):
            k, w = (gram, m - gram + 1) if m == span else (m, 1)
            h, around, item = [], [], []
            for i, s in enumerate(seqs):
                if min(len(s), span) == m:
                    fh, fp = fingerprints(s, k, w)
                    h.append(fh)
                    around.append(_around(np.pad(s, m, constant_values=-1), fp, k, m).astype(np.int32))
                    item.append(np.full(len(fh), i))
            rows = np.hstack([np.concatenate(h).view(np.int32).reshape(-1, 2), np.concatenate(around)])
            rows, entry = np.unique(rows, axis=0, return_inverse=True)
            hashes = np.ascontiguousarray(rows[:, :2]).view(np.uint64).ravel()
            order = np.argsort(hashes, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            pairs = np.unique(np.stack([rank[entry.ravel()], np.concatenate(item)], axis=1), axis=0)
            self.classes.append((k, w, m, hashes[order], rows[order, 2:], np.searchsorted(pairs[:, 0], np.arange(len(order) + 1)), pairs[:, 1]))

    def scan(self, docs: list[list[bytes]]) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        """Of each document that has a hit: spans of hit words and the items they come from."""
        get = self.vocab.get
        sizes = np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs))
        ends = np.cumsum(sizes)
        sep = (b"",)
        ids = np.fromiter((get(w, 0) for w in chain.from_iterable(chain(d, sep) for d in docs)), np.int64, int(ends[-1]) if len(ends) else 0)
        found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        for k, w, m, hashes, around, first_item, items in self.classes:
            if len(ids) < k + w - 1:
                continue
            g = _grams(ids, k)
            low = _window_min(g, w)
            first, last = _stretches(low)
            lo = np.searchsorted(hashes, low[first])
            ok = lo < len(hashes)
            ok[ok] = hashes[lo[ok]] == low[first[ok]]
            at = [f + np.flatnonzero(g[f : z + w - 1] == low[f]) for f, z in zip(first[ok].tolist(), last[ok].tolist(), strict=True)]
            if not at:
                continue
            at = np.unique(np.concatenate(at))
            a, z = np.searchsorted(hashes, g[at]), np.searchsorted(hashes, g[at], side="right")
            padded = np.pad(ids, m, constant_values=0)
            cut = [0]  # places taken together: _PAIRS entries, or one place
            for i, n in enumerate(np.cumsum(z - a).tolist()):
                if n - (0 if cut[-1] == 0 else total) > _PAIRS or i == len(at) - 1:
                    cut.append(i + 1)
                    total = n
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                n = (z - a)[x:y]
                place = np.repeat(at[x:y], n)
                entry = np.arange(n.sum()) + np.repeat(a[x:y] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                left, right = _reach(_around(padded, place, k, m), around[entry], k, m)
                hit = np.flatnonzero(left + k + right >= m)
                doc = np.searchsorted(ends, place[hit], side="right")
                start = place[hit] - left[hit] - (ends - sizes)[doc]
                for d, s, e, i in zip(doc.tolist(), start.tolist(), (start + left[hit] + k + right[hit]).tolist(), entry[hit].tolist(), strict=True):
                    spans, names = found.setdefault(d, ([], set()))
                    spans.append((s, e))
                    names.update(items[first_item[i] : first_item[i + 1]].tolist())
        return found


def benchmark_index(benchmark: DataFrame, span: int, gram: int, item_id: str, text: str) -> Index:
    """Equal texts count once, under all their ids."""
    items: dict[tuple[bytes, ...], set[str | None]] = {}
    for name, t in benchmark.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        seq = tuple(words((t or "").encode()))
        if seq:
            items.setdefault(seq, set()).add(name)
    return Index(items, span, gram)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


_FIELDS = [("n_words", "long"), ("n_hit", "long"), ("hit_spans", "array<struct<start:int,end:int>>"), ("items", "array<string>"), ("contaminated", "boolean")]


def _verdict(n: list[int], spans: list, items: list, share: int) -> list[list]:
    hit = [sum(e - s for s, e in x) for x in spans]
    return [n, hit, [[{"start": s, "end": e} for s, e in x] for x in spans], items, [h > 0 and share * h >= w for h, w in zip(hit, n, strict=True)]]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM, share: int = 20, broadcast_words: int = BROADCAST_WORDS, keep: list[str] = (), prefix: str = "") -> DataFrame:
    """Per row: kept columns, n_words, n_hit, hit_spans (word positions, end excluded), items (sorted ids), contaminated.

    New columns carry the prefix and replace input columns of their names.
    """
    spark = tune(docs.sparkSession)
    counted = map_batches(benchmark.select(F.col(item_text).alias("text")), lambda: lambda batch: [[len(words(t)) for t in texts(batch)]], [("n", "long")])
    total = counted.agg(F.sum("n")).first()[0] or 0
    if total > broadcast_words:
        return _by_shuffle(docs, benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")), text, span, gram, share, keep, prefix)
    index = spark.sparkContext.broadcast(benchmark_index(benchmark, span, gram, item_id, item_text))  # broadcast_words words at most

    def make():
        known = index.value

        def run(batch):
            ws = [words(t) for t in texts(batch, text)]
            spans, items = [[] for _ in ws], [[] for _ in ws]
            for d, (s, i) in known.scan(ws).items():
                spans[d], items[d] = merged(s), sorted({name for x in i for name in known.names[x]})
            return _verdict([len(w) for w in ws], spans, items, share)

        return run

    return map_batches(docs.select(*dict.fromkeys([*keep, text])), make, [(prefix + n, k) for n, k in _FIELDS], list(keep))


def _word_grams(ws: list[bytes], k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive words, alike in every task."""
    return _grams(np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in ws], np.uint64), k)


def _windows(ws: list[bytes], m: int, span: int, gram: int) -> tuple[np.ndarray, int]:
    """The fingerprint of every window of m words."""
    k, w = (gram, m - gram + 1) if m == span else (m, 1)
    return (_window_min(_word_grams(ws, k), w) if len(ws) >= m else np.empty(0, np.uint64)), m


def _by_shuffle(docs: DataFrame, items: DataFrame, text: str, span: int, gram: int, share: int, keep: list[str], prefix: str) -> DataFrame:
    signed = lambda h: h.astype(np.uint64).view(np.int64)
    name = lambda m, ws: hashlib.blake2b(b" ".join(ws), digest_size=16, key=str(m).encode()).digest()

    def item_windows():
        def run(batch):
            for i, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                ws = words(t)
                if ws:
                    h, m = _windows(ws, min(len(ws), span), span, gram)
                    yield [[i] * len(h), [m] * len(h), signed(h), [name(m, ws[s : s + m]) for s in range(len(h))]]

        return run

    known = written(flat_batches(items, item_windows, [("id", "string"), ("m", "int"), ("h", "long"), ("win", "binary")]), "item_windows")
    sizes = sorted(r["m"] for r in known.select("m").distinct().collect())  # `span` numbers at most

    def text_prints():
        def run(batch):
            for key, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                ws = words(t)
                h = signed(np.unique(np.concatenate([np.empty(0, np.uint64), *(_windows(ws, m, span, gram)[0] for m in sizes)])))
                if len(h):
                    yield [[key] * len(h), h]

        return run

    def text_windows():
        def run(batch):
            for key, t, hs in zip(batch.column(0).to_pylist(), texts(batch), batch.column(2).to_pylist(), strict=True):
                ws, hit = words(t), np.array(hs, np.int64)
                for m in sizes:
                    at = np.flatnonzero(np.isin(signed(_windows(ws, m, span, gram)[0]), hit)).tolist()
                    if at:
                        yield [[key] * len(at), at, [m] * len(at), [name(m, ws[s : s + m]) for s in at]]

        return run

    key = F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), 1, 16)
    rows = docs.select(key.alias("_llm_key"), F.col(text).alias("text"))
    prints = flat_batches(rows, text_prints, [("_llm_key", "binary"), ("h", "long")])
    hits = prints.join(known.select("h").distinct(), "h", "left_semi").groupBy("_llm_key").agg(F.collect_set("h").alias("hs"))  # as many as the text has fingerprints
    wanted = rows.join(hits, "_llm_key").groupBy("_llm_key").agg(F.first("text").alias("text"), F.first("hs").alias("hs"))
    found = flat_batches(wanted, text_windows, [("_llm_key", "binary"), ("at", "int"), ("m", "int"), ("win", "binary")])
    found = written(found.join(known.select("win").distinct(), "win", "left_semi"), "shared_windows")
    spans = found.groupBy("_llm_key").agg(F.collect_set(F.struct("at", "m")).alias("_llm_at"))
    ids = found.select("_llm_key", "win").distinct().join(known.where("id IS NOT NULL").select("win", "id").distinct(), "win").groupBy("_llm_key").agg(F.collect_set("id").alias("_llm_ids"))
    per_text = written(spans.join(ids, "_llm_key", "left"), "shared_spans")
    columns = list(dict.fromkeys([*keep, text]))
    joined = docs.select(*columns).withColumn("_llm_key", key).join(per_text, "_llm_key", "left").select(*columns, "_llm_at", "_llm_ids")

    def judge():
        def run(batch):
            at, ids = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_llm_at", "_llm_ids"))
            spans = [merged([(x["at"], x["at"] + x["m"]) for x in a or []]) for a in at]
            return _verdict([len(words(t)) for t in texts(batch, text)], spans, [sorted(i or []) for i in ids], share)

        return run

    return map_batches(joined, judge, [(prefix + n, k) for n, k in _FIELDS], list(keep))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: Every 13-word window of the items (a shorter item is one window) against every window of the documents.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS u(i) WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM d, ms, unnest(range(1, len(w) - m + 2)) AS u(i)),
h AS (SELECT r, i, m, item_id FROM dw JOIN bw USING (m, g)),
p AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT r, i, m FROM h) x, unnest(range(0, m)) AS u(j) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""

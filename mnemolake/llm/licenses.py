"""License scan: an exact containment join between text blocks and license templates, beside literal phrases.

A block is at most BLOCK words, every STRIDE words, of the whole text and of each of its lines. Stride and overlap are
never under the longest template, so a template lies whole in some block wherever it stands, across line breaks too. A
block matches a template when it holds at least THETA of the template's distinct words. (The SQL has the same blocks.)

Template words are ordered by their frequency over the whole corpus, rarest first (one counting pass, summed by Spark;
only template words are counted, so the table is bounded by the templates). A matching block must hold one of a
template's first |T| - need + 1 words (prefix filter) and at least `need` distinct words of templates (length filter; no
others can be common). Where the first common word is at rank i of the template and at rank j of the block's B such words
in the same order, no more than the smaller of |T| - i and B - j can be common, which must reach `need` (positional
filter). The filters lose nothing; survivors are counted exactly. The templates are the fixed list below, so they travel with the closure.

Defined cases: a null or empty text has no words and no labels (score 0); repeated rows are scanned each for itself; further
columns pass through if they are kept, and those whose names the result takes are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, flat_batches, map_batches, texts, tune, words

#: Literal phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: License templates and their labels.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
]
THETA, BLOCK, STRIDE = 0.9, 64, 32


def word_blocks(ws: list[bytes], block: int, stride: int):
    """Overlapping blocks of a sequence of words; every run of block - stride words lies whole in one of them."""
    for at in range(0, max(len(ws) - (block - stride), 1) if ws else 0, stride):
        yield ws[at : at + block]


def text_blocks(text: bytes, ws: list[bytes], block: int, stride: int):
    """The blocks of the whole text, then those of each of its lines."""
    yield from word_blocks(ws, block, stride)
    lines = [line for line in map(words, text.split(b"\n")) if line]
    for line in lines if len(lines) > 1 else ():
        yield from word_blocks(line, block, stride)


class Matcher:
    def __init__(self, templates: list[tuple[str, str]], frequency: dict[str, int], theta: float, block: int, stride: int):
        longest = max((len(text.split()) for text, _ in templates), default=0)
        self.stride, self.index = max(stride, longest), {}
        self.block = max(block, self.stride + longest)
        vocabulary = sorted({w for text, _ in templates for w in text.split()}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w.encode(): i for i, w in enumerate(vocabulary)}
        for text, label in templates:
            ordered = sorted(set(text.split()), key=lambda w: (frequency.get(w, 0), w))
            need = max(1, ceil(theta * len(ordered) - 1e-9))
            entry = (label, [w.encode() for w in ordered], frozenset(w.encode() for w in ordered), need)
            for i, w in enumerate(ordered[: len(ordered) - need + 1]):
                self.index.setdefault(w.encode(), []).append((i, entry))

    def candidates(self, have: set[bytes]):
        """(label, words, need) of the templates that pass the filters for the template words of a block."""
        first = self.index.keys() & have
        if not first:
            return
        ranks = sorted(self.rank[w] for w in have)
        for w in first:
            left = len(ranks) - bisect_left(ranks, self.rank[w])
            for i, (label, ordered, whole, need) in self.index[w]:
                if min(left, len(ordered) - i) >= need and not any(x in have for x in ordered[:i]):  # else found by a rarer word, if at all
                    yield label, whole, need

    def match(self, text: bytes, ws: list[bytes]) -> tuple[set[str], float]:
        if self.index.keys().isdisjoint(ws):
            return set(), 0.0
        labels, best = set(), 0.0
        for b in text_blocks(text, ws, self.block, self.stride):
            have = self.rank.keys() & set(b)
            for label, whole, need in self.candidates(have):
                common = len(whole & have)
                if common >= need:
                    labels.add(label)
                    best = max(best, common / len(whole))
        return labels, best


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word positions at which the phrase's words stand; joined has a space before, between and after the words."""
    out, at = [], joined.find(phrase)
    while at >= 0:
        out.append(joined.count(b" ", 0, at))
        at = joined.find(phrase, at + 1)
    return out


def word_frequency(docs: DataFrame, vocabulary: set[str], text: str = "text") -> dict[str, int]:
    """Occurrences of these words in all texts. The result has at most one row for each word of the vocabulary."""
    vocab = frozenset(w.encode() for w in vocabulary)

    def make():
        def run(batch):
            n: Counter = Counter()
            for t in texts(batch, text):
                n.update(w for w in words(t) if w in vocab)
            yield [[w.decode() for w in n], list(n.values())]

        return run

    rows = flat_batches(docs.select(text), make, [("word", "string"), ("n", "long")]).groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in rows.collect()}


def scan(docs: DataFrame, *, text: str = "text", keep: list[str] = (), templates=tuple(TEMPLATES), phrases=None, theta: float = THETA, block: int = BLOCK, stride: int = STRIDE) -> DataFrame:
    """Per row: kept columns, n_words, n_base, first_word, last_word, base_labels, labels (both sorted arrays), score."""
    tune(docs.sparkSession)
    phrases = {b" " + p.encode() + b" ": label for p, label in (phrases or PHRASES).items()}
    frequency = word_frequency(docs, {w for t, _ in templates for w in t.split()}, text)
    templates = list(templates)

    def make():
        matcher = Matcher(templates, frequency, theta, block, stride)

        def run(batch):
            rows = []
            for t in texts(batch, text):
                ws = words(t)
                joined = b" " + b" ".join(ws) + b" "
                found = [(p, label) for phrase, label in phrases.items() for p in places(joined, phrase)]
                labels, best = matcher.match(t, ws)
                base = {label for _, label in found}
                at = [p for p, _ in found]
                rows.append((len(ws), len(at), min(at, default=None), max(at, default=None), sorted(base), sorted(base | labels), 1.0 if base else best))
            return list(map(list, zip(*rows, strict=True))) if rows else None

        return run

    fields = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "array<string>"), ("labels", "array<string>"), ("score", "double")]
    return map_batches(docs.select(*dict.fromkeys([*keep, text])), make, fields, list(keep))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
dw AS (SELECT r, doc_id, t, {_WORDS.format("t")} AS w FROM d),
ph AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES {", ".join(f"('{p}', '{x}')" for p, x in PHRASES.items())}) v(p, label)),
base AS (SELECT r, i - 1 AS pos, label FROM dw, ph, unnest(range(1, len(w) - len(p) + 2)) AS u(i) WHERE w[i] = p[1] AND w[i : i + len(p) - 1] = p),
b AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
te AS (SELECT list_distinct(string_split(p, ' ')) AS p, label FROM (VALUES {", ".join(f"('{p}', '{x}')" for p, x in TEMPLATES)}) v(p, label)),
ln AS (SELECT r, {_WORDS.format("line")} AS w FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
pc AS (SELECT r, w FROM ln UNION ALL SELECT r, w FROM dw),
bl AS (SELECT r, list_distinct(w[i + 1 : i + {BLOCK}]) AS w FROM pc, unnest(range(0, greatest(len(w) - {BLOCK - STRIDE}, 1), {STRIDE})) AS u(i) WHERE len(w) > 0),
m AS (SELECT r, label, len(list_intersect(p, w)) AS c, len(p) AS n FROM bl, te),
hits AS (SELECT r, label, max(c / n) AS s FROM m WHERE c >= ceil({THETA} * n - 1e-9) GROUP BY r, label),
al AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM hits UNION ALL SELECT r, label FROM base) GROUP BY r),
sc AS (SELECT r, max(s) AS s FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(s, 0) END AS DOUBLE) AS score
FROM dw LEFT JOIN b USING (r) LEFT JOIN al USING (r) LEFT JOIN sc USING (r)
"""

"""Spelling variants: words at edit distance one, found by a self-join of the vocabulary's trie with active nodes.

The vocabulary is counted over all texts. Its trie is dealt out by prefixes: a prefix is lengthened until at most LIMIT
words stand below it, and each such subtrie is one task's work. There the join walks level by level and keeps the active
pairs of nodes, those that are one edit apart: two children of a node are a substitution apart, a child is an insertion
apart from its parent; a pair goes on to the children that both sides have by the same character. Pairs of terminal nodes
are pairs of words. An insertion next to an equal character is the same as one after it, and only the last is taken, so
each pair comes up once.

Pairs whose edit lies inside the prefix are in two subtries. Below the edit both paths agree, so they meet on the word
without the edited character: a join of words of which one of the first `depth` characters is left out. The words that
meet on such a key differ in that one character, so a key's group is bounded by the alphabet.

A word's form is its near word of largest count if that is at least twice its own; counts double along a chain, so
following forms to the last ends, by pointer jumping over written tables.

Defined cases: a null or empty text has no words; a null id is written as an empty text in front of the colon; repeated
rows count each; ties of counts go to the smaller word in code-point order; an empty table gives no rows; further columns
are not read. Very long runs are words like others.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop, flat_batches, tune, written

LEAST_LENGTH, LEAST_COUNT, NOISE, LIMIT, FLUSH = 5, 3, 97, 40_000, 300_000
#: Latin-1 codes: letters with A-Z lowered, all others a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """The maximal runs [A-Za-z\\u00C0-\\u00FF]+ with A-Z lowered, in Latin-1, which holds just these letters."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def vocabulary(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n): distinct runs of at least `least_length` characters and `least_count` occurrences.

    Where `noise` divides h = crc32("<doc_id>:<run>"), the run loses its character h % length; 0 leaves all runs as they are.
    """

    def make():
        total: Counter = Counter()

        def flush():
            found = [(w.decode("latin-1"), n) for w, n in total.items() if n and len(w) >= least_length]
            total.clear()
            return [[w for w, _ in found], [n for _, n in found]]

        def run(batch):
            ids = batch.column(0).to_pylist()
            for at, t in zip(ids, batch.column(1).to_pylist(), strict=True):
                ws = runs(t)
                total.update(ws)
                if noise:
                    start, known = crc32(f"{'' if at is None else at}:".encode()), set(ws)
                    hit = [w for w in known if crc32(w if w.isascii() else w.decode("latin-1").encode(), start) % noise == 0]
                    count = ws.count if len(hit) < 8 else Counter(ws).__getitem__
                    for w in hit:
                        h = crc32(w if w.isascii() else w.decode("latin-1").encode(), start) % len(w)
                        total[w] -= count(w)
                        total[w[:h] + w[h + 1 :]] += count(w)
                if len(total) > FLUSH:
                    yield flush()
            yield flush()

        return run

    part = flat_batches(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), make, [("word", "string"), ("n", "long")])
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class _Level:
    """The nodes of one depth: parent, character, the word that ends in each (or -1), and the range of each one's children."""

    def __init__(self, parent: np.ndarray, char: np.ndarray, ends: np.ndarray, parents: int):
        self.parent, self.char, self.ends = parent, char, ends
        self.key = parent << 21 | char
        self.count = np.bincount(parent, minlength=parents)  # children of each node above
        self.first = np.cumsum(self.count) - self.count


def _levels(words: list[str]):
    """The trie of sorted distinct words, one depth after the other, the last one empty."""
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    start, act = np.cumsum(size) - size, np.arange(len(words))
    node, nodes, k = np.zeros(len(words), np.int64), 1, 0
    while nodes:
        go = size[act] > k
        act, node = act[go], node[go]
        char = flat[start[act] + k]
        new = np.ones(len(act), bool)
        new[1:] = (node[1:] != node[:-1]) | (char[1:] != char[:-1])
        child = np.cumsum(new) - 1
        ends = np.full(int(new.sum()), -1, np.int64)
        done = size[act] == k + 1
        ends[child[done]] = act[done]
        yield _Level(node[new], char[new], ends, nodes)
        node, nodes, k = child, len(ends), k + 1


def _spread(count: np.ndarray, first: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node all of its children: (place in nodes, child)."""
    n = count[nodes]
    at = np.repeat(np.arange(len(nodes)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + first[nodes][at]


def _common(at: np.ndarray, child: np.ndarray, above: _Level, other: np.ndarray, below: _Level) -> tuple[np.ndarray, np.ndarray]:
    """Children (of `above`) whose character the other node of the pair has a child by, too (in `below`)."""
    if not len(below.key) or not len(child):
        return child[:0], child[:0]
    key = other[at] << 21 | above.char[child]
    to = np.minimum(np.searchsorted(below.key, key), len(below.key) - 1)
    same = below.key[to] == key
    return child[same], to[same]


def near_words(words: list[str]):
    """Yields arrays (a, b) of places in `words`, sorted and distinct, that are one edit apart; each unordered pair once."""
    none = np.zeros(0, np.int64)
    levels, same, apart = _levels(words), (none, none), (none, none)  # pairs of nodes of one depth; of a depth and the next
    ends, here = np.full(1, -1, np.int64), next(levels, None)
    while here is not None and len(here.parent):
        below = next(levels, None)
        # a word and one that goes on by one character, or had one put in before
        fresh = (here.parent, np.arange(len(here.parent)))
        for u, v in (apart, fresh):
            a, b = ends[u], here.ends[v]
            both = (a >= 0) & (b >= 0)
            yield a[both], b[both]
        grown = (none, none)
        if below is not None:
            at, child = _spread(here.count, here.first, apart[0])
            old = _common(at, child, here, apart[1], below)
            at, child = _spread(here.count, here.first, fresh[0])
            other = here.char[child] != here.char[at]  # else the same word with the character put in later
            new = _common(at[other], child[other], here, fresh[1], below)
            grown = tuple(np.concatenate(x) for x in zip(old, new, strict=True))
        at, child = _spread(here.count, here.first, same[0])
        old = _common(at, child, here, same[1], here)
        at, child = _spread(here.count, here.first, here.parent)
        later = child > at
        same = (np.concatenate([old[0], at[later]]), np.concatenate([old[1], child[later]]))
        a, b = here.ends[same[0]], here.ends[same[1]]
        both = (a >= 0) & (b >= 0)
        yield a[both], b[both]
        ends, apart, here = here.ends, grown, below


def _subtrie(group: pa.Table) -> pa.Table:
    """(word, n_near, best_n, best) of the words of one subtrie that have near words in it."""
    group = group.sort_by("word")  # by bytes, which is by code points
    words, n = group.column("word").to_pylist(), group.column("n").to_numpy()
    count, most = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
    best = np.full(len(words), len(words), np.int64)
    for a, b in near_words(words):
        for x, y in ((a, b), (b, a)):
            if not len(x):
                continue
            count += np.bincount(x, minlength=len(words))
            # the best of this level's pairs for each word, then against what is known
            order = np.lexsort((y, -n[y], x))
            x, y = x[order], y[order]
            first = np.ones(len(x), bool)
            first[1:] = x[1:] != x[:-1]
            x, y = x[first], y[first]
            better = (n[y] > most[x]) | ((n[y] == most[x]) & (y < best[x]))
            most[x[better]], best[x[better]] = n[y][better], y[better]
    at = np.flatnonzero(count)
    return pa.table({"word": pa.array([words[i] for i in at], pa.string()), "n_near": count[at], "best_n": most[at], "best": pa.array([words[i] for i in best[at]], pa.string())})


def subtries(vocab: DataFrame, limit: int = LIMIT) -> DataFrame:
    """vocab (word, n) with depth and leaf: the shortest prefix, of the lengths tried, below which at most `limit` words stand; else the whole word."""
    open_, done, depth, tables = vocab.select("word", "n"), [], 1, []
    while True:
        cutoff = F.substring("word", 1, depth)
        hot = open_.groupBy(cutoff.alias("leaf")).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > limit)
        state = written(open_.withColumn("leaf", cutoff).join(hot, "leaf", "left").select("word", "n", F.least(F.lit(depth), F.length("word")).alias("depth"), "leaf", (F.col("size").isNotNull() & (F.length("word") > depth)).alias("hot")), "subtries")
        tables.append(state)
        done.append(state.where("NOT hot").drop("hot"))
        if state.where("hot").isEmpty():
            break
        open_, depth = state.where("hot").select("word", "n"), depth + max(1, depth // 3)
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    out.tables = tables
    return out


def _across(leaves: DataFrame) -> DataFrame:
    """Pairs (word, other_n, other) in two subtries: they meet on the word without one of its first `depth` characters."""
    i = F.col("i")
    without = F.concat(F.expr("substring(word, 1, i - 1)"), F.expr("substring(word, i + 1)"))
    gone = leaves.select("word", "n", "leaf", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("i")).select("word", "n", "leaf", i, without.alias("key"))
    one, two = (gone.select("key", "i", *(F.col(c).alias(f"{c}{k}") for c in ("word", "n", "leaf"))) for k in (1, 2))
    swapped = one.join(two, ["key", "i"]).where("word1 <> word2 AND leaf1 <> leaf2").select(F.col("word1").alias("word"), F.col("n2").alias("other_n"), F.col("word2").alias("other"))
    short = leaves.select(F.col("word").alias("key"), F.col("n").alias("n2"), F.col("leaf").alias("leaf2"))
    longer = gone.select("word", "n", "leaf", "key").distinct().join(short, "key").where("leaf <> leaf2")
    return swapped.union(longer.select("word", F.col("n2").alias("other_n"), F.col("key").alias("other"))).union(longer.select(F.col("key").alias("word"), F.col("n").alias("other_n"), F.col("word").alias("other")))


def near_forms(vocab: DataFrame, limit: int = LIMIT) -> DataFrame:
    """vocab (word, n) with n_near and the near word of largest count: best, best_n (null without one)."""
    vocab = written(vocab, "vocabulary")
    leaves = subtries(vocab, limit)
    inside = leaves.groupBy("leaf").applyInArrow(_subtrie, "word string, n_near long, best_n long, best string")
    across = _across(leaves).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("b"))
    both = inside.select("word", "n_near", F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("other")).alias("b")).union(across.select("word", "n_near", "b"))
    both = both.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("b").alias("b"))
    out = written(vocab.join(both, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("b.m")).alias("best_n"), F.col("b.other").alias("best")), "near")
    drop(vocab, *leaves.tables)
    return out


def variants(vocab: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of vocab (word, n)."""
    near = near_forms(vocab, limit)
    is_form = F.col("best_n") >= 2 * F.col("n")
    words = near.select("word", F.when(is_form, F.col("best")).alias("form"), "n", "n_near", F.when(is_form, F.col("best_n")).alias("form_n"))
    step = written(words.where("form IS NOT NULL").select("word", F.col("form").alias("to")), "forms")
    while True:
        beyond = step.select(F.col("word").alias("to"), F.col("to").alias("far"))
        new = written(step.join(beyond, "to", "left").select("word", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "forms")
        moved = not new.where("moved").isEmpty()
        drop(step)
        step = new.drop("moved")
        step.scratch_path = new.scratch_path
        if not moved:
            return words.join(step, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return variants(vocabulary(documents(spark, sf_dir)))

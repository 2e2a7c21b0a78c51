"""Spelling variants, collocations and the n-gram join against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from mnemolake.llm import collocations, counters, ngram_join, spelling
from test_group_operators import brute_components, key, lower


def brute_vocabulary(rows, noise=97, least_length=5, least_count=3):
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % noise == 0 else w] += 1
    return {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    near_to = {w: [x for x in n if abs(len(x) - len(w)) <= 1 and near(w, x)] for w in n}
    form = {}
    for w, xs in near_to.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near_to[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def typos(rng, words):
    out = []
    for w in words:
        i = rng.randrange(len(w) + 1)
        out.append(rng.choice([w, w, w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:], w[:i] + rng.choice("abé") + w[i + 1 :]]))
    return [w for w in out if w]


def test_trie_join_gives_each_pair_once():
    rng = random.Random(3)
    for size, letters in ((300, "ab"), (400, "abcé"), (60, "a")):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(size)})
        got = [tuple(sorted((int(x), int(y)))) for a, b in spelling.near_words(words) for x, y in zip(a, b, strict=True)]
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for j in range(len(words)) for i in range(j) if near(words[i], words[j])}
    assert not [1 for a, _ in spelling.near_words([]) if len(a)]


@pytest.mark.parametrize("limit", [spelling.LIMIT, 7])
def test_variants(spark, limit):
    rng = random.Random(7)
    base = ["".join(rng.choice(["ta", "ri", "ke", "no", "sé", "ß"]) for _ in range(rng.randint(3, 5))) for _ in range(40)]
    n = Counter()
    for w in base:
        n[w] += 2 ** rng.randint(1, 9)
    for w in typos(rng, base * 12):
        n[w] += rng.choice([1, 1, 3, 3, 40])
    n = {w: c for w, c in n.items() if len(w) >= 5} | {"a" * 5000: 3, "a" * 5001: 9, "b" + "a" * 5000: 9}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long").repartition(3), limit)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute_variants(n)


def test_vocabulary(spark, docs, no_docs, rows):
    assert {r["word"]: r["n"] for r in spelling.vocabulary(docs).collect()} == brute_vocabulary(rows)
    assert {r["word"]: r["n"] for r in spelling.vocabulary(docs, noise=3, least_length=2, least_count=1).collect()} == brute_vocabulary(rows, 3, 2, 1)
    assert spelling.variants(spelling.vocabulary(no_docs)).collect() == []


def test_query_of_variants(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, spelling.op11_spelling_variants(spark, sf).collect())) == brute_variants(brute_vocabulary(rows))


def brute_phrases(rows, least, top=2000, held=50):
    total, f = Counter(), defaultdict(Counter)
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(t)):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(ws)
            for k in (1, 2, 3):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + 2] for p, a in cands.items() if len(p) == 3 for i in (0, 1) if 100 * a >= held * cands[p[i : i + 2]]}
        scored = []
        for p, a in cands.items():
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if p not in gone:
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("bound", [collocations.BOUND, 0])
def test_collocations(spark, rows, bound):
    rng = random.Random(11)
    phrases = ["new york city", "de la", "x\x00y z", "ab ab ab ab", "café au lait", "\U0001f600 ok", "a\x85b c"]
    extra = [(rng.choice(["en", "fr", None, "und"]), " ".join(rng.choice([*phrases, "the", "of.", "tail,", "one\tTwo", "z;w"]) for _ in range(80))) for _ in range(25)]
    all_rows = [("en" if (d or 0) % 2 else None, t) for d, t in rows] + extra + [(None, None), ("empty", ""), ("dots", "...")]
    df = spark.createDataFrame([(lang, t, 1, "s") for lang, t in all_rows], "lang string, text string, n long, words string").repartition(3)
    for least, top in ((3, 2000), (3, 5))[: 2 if bound else 1]:
        got = collocations.collocations(df, least=least, top=top, bound=bound)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == brute_phrases(all_rows, least, top)
    assert collocations.collocations(df.limit(0), bound=bound).collect() == []


def test_perfect_hash_is_minimal_and_tells_strangers_apart():
    rng = np.random.default_rng(1)
    for size in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(-(2**62), 2**62, size))
        hashed = counters.PerfectHash(keys)
        assert sorted(hashed.slots(keys).tolist()) == list(range(len(keys)))
        assert (hashed.slots(np.setdiff1d(rng.integers(-(2**62), 2**62, 1000), keys)) == -1).all()
    hashed = type("Short", (counters.PerfectHash,), {"LEVELS": 1})(keys)  # many keys are left over for the list
    assert hashed.last < len(keys) and sorted(hashed.slots(keys).tolist()) == list(range(len(keys)))


def test_counted_slots(spark):
    df = spark.range(0, 5000, numPartitions=7)
    size = counters.CHUNK + 10
    got = counters.counted_slots(df, lambda: lambda b: np.where(b.column(0).to_numpy() % 3 == 0, size - 1, b.column(0).to_numpy() % 11), size)
    want = np.bincount([size - 1 if i % 3 == 0 else i % 11 for i in range(5000)], minlength=size)
    assert (counters.slot_array(got, size) == want).all()
    assert {r["slot"]: r["n"] for r in counters.slot_rows(got).collect()} == {int(i): int(want[i]) for i in np.flatnonzero(want)}


@pytest.mark.parametrize("options", [{}, {"rounds": 0, "salt": 1, "longest": 30}, {"shingle": 3, "threshold": 50, "slots": 4, "longest": 1}])
def test_ngram_join(spark, docs, no_docs, rows, options):
    got = [tuple(r) for r in ngram_join.ngram_join(docs, **options).collect()]
    assert sorted(got, key=key) == sorted([r[:3] for r in brute_components(rows, options.get("shingle", 5), options.get("threshold", 80))], key=key)
    if not options:
        assert ngram_join.ngram_join(no_docs).count() == 0


def test_ngram_join_of_edited_copies(spark):
    # copies of a few bases with more and fewer edits, so that similarities lie on both sides of the threshold
    rng = random.Random(13)
    bases = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 90, 200]))] for _ in range(6)]
    made = []
    for i in range(240):
        ws = list(rng.choice(bases))
        for _ in range(rng.randint(0, 5)):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(40)}"
        made.append((i, " ".join(ws)))
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    want = sorted(r[:3] for r in brute_components(made, 5))
    assert len({r[2] for r in want}) < 240
    for options in ({}, {"longest": 12, "rounds": 0}):
        assert sorted(map(tuple, ngram_join.ngram_join(df, **options).collect())) == want


def test_ngram_join_of_long_lists(spark):
    # copies with two edits each of a text that is not there: hardly any are linked, all share most elements
    rng = random.Random(31)
    base = [f"w{k}" for k in range(100)]
    made = []
    for i in range(60):
        ws = list(base)
        for k in range(2 if i % 3 else 1):
            ws[rng.randrange(10, 90)] = f"x{i}y{k}"
        made.append((i, " ".join(ws)))
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    want = sorted(r[:3] for r in brute_components(made, 5))
    for options in ({"rounds": 0, "lists": 0}, {"rounds": 0, "lists": 5}, {"rounds": 1, "lists": 1}):
        assert sorted(map(tuple, ngram_join.ngram_join(df, **options).collect())) == want


def test_ngram_join_counts_pairs_of_long_lists_where_they_meet(spark):
    # 40 sets of 100 share the same 12 elements of their prefixes, too few to be linked, but for two that share one more in a short list
    need, rows = 80, []
    for c in range(40):
        rows += [(t, 40, c, 100, 13 + t, t + 1, 6, c) for t in range(12)]
    rows += [(100, 2, c, 100, 0, 0, 6, c) for c in (3, 7)]
    rest = spark.createDataFrame(rows, "token long, size long, cid long, n long, pos int, before int, l int, label long")
    assert 180 * (13 + need - 6) < 80 * 200  # even these two fall short
    out = ngram_join.rest_pairs(rest, 80, 16)
    assert out.collect() == []
    one = spark.createDataFrame([(t, 40, c, 100, t, t, 6, c) for c in range(40) for t in range(16)], rest.schema)
    assert ngram_join.rest_pairs(one, 80, 16).count() == ngram_join.rest_pairs(one, 80, 99).count() == 40 * 39 // 2


def test_too_many_pairs_are_counted_by_their_numbers(spark, monkeypatch):
    """Beyond the bound of hashes no n-gram of strings is made; texts are taken apart once, whichever way is gone."""
    import random

    rng = random.Random(3)
    rows = [("en" if i % 3 else None, " ".join(rng.choice("a b c d e f".split()) + rng.choice([" ", " ", ", "]) for _ in range(40))) for i in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(collocations, "shuffled", lambda *_: pytest.fail("n-grams of strings"))
    ways, real = [], collocations._keyed
    monkeypatch.setattr(collocations, "_keyed", lambda *a: ways.append("keyed") or real(*a))
    want = brute_phrases(rows, 3, 2000)
    for bound, keyed in ((12, 1), (80, 2), (10_000, 2)):  # 12 words, 72 pairs and more triples
        assert sorted(map(tuple, collocations.collocations(df, least=3, bound=bound).collect())) == want
        assert len(ways) == keyed

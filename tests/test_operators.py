"""Operators against brute force and hand-made cases."""

import hashlib
from difflib import SequenceMatcher
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.functions import text as X
from mnemolake.operators import folds, graph, search, similar, string_join
from mnemolake.plans import lifecycle, predicates
from mnemolake.schema import INTENT_CUES, NOW
from mnemolake.sources.fixtures import tables
from mnemolake.streaming.folds import stream_fold, windowed_counts


def column(spark, expr, values, name="x"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string").orderBy("i").select(expr).collect()]


def test_intents(spark):
    got = column(spark, X.first_of(F.lower("x"), INTENT_CUES, "GENERAL"), ["为什么选了 SQLite", "上次什么时候改的配置", "什么是 nginx gateway", ""])
    assert got == ["WHY", "WHEN", "ENTITY", "GENERAL"]


def test_query_tokens(spark):
    got = column(spark, X.query_tokens(F.col("x")), ["SOUL注入", "deploy-windows a 主力战机"])
    assert got == [["soul", "注入"], ["deploy-windows", "主力战机", "主力", "力战", "战机"]]


def test_bm25_phrases(spark):
    m = spark.createDataFrame([(1, "Release v1.2.3 is out", "fact", "a"), (2, "v1 of 2 and 3", "fact", "a"), (3, "nothing here", "fact", "a"), (4, "über alles", "fact", "a")], "id long, content string, type string, tags string")
    q = spark.createDataFrame([(1, "v1.2.3"), (2, "!!! v1"), (3, "---"), (4, "UBER")], "query_id long, q string")
    got = {(r["query_id"], r["id"]) for r in search.bm25(m, q).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (4, 4)}


def test_bm25_formula(spark):
    import math

    m = spark.createDataFrame([(i, "x y " * i + "z" * (i % 2), "t", "g") for i in range(1, 8)] + [(9, "rare word", "t", "g")], "id long, content string, type string, tags string")
    q = spark.createDataFrame([(1, "rare")], "query_id long, q string")
    d = {r["id"]: len(r["content"].split()) + 2 for r in m.collect()}
    want = -math.log((8 - 1 + 0.5) / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * d[9] / (sum(d.values()) / 8)))
    (r,) = search.bm25(m, q).collect()
    assert r["id"] == 9 and abs(r["bm25"] - want) < 1e-12


def test_large_batches_are_not_broadcast(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().toString()
    batch = spark.createDataFrame([(1, "x")], "query_id long, q string")
    rows = spark.range(10)
    assert "broadcast" in plan(rows.join(search.small(batch), F.col("id") > F.col("query_id")))
    monkeypatch.setattr(search, "BATCH_BYTES", 0)
    assert search.small(batch) is not batch
    monkeypatch.setattr(search, "BATCH_ROWS", 0)
    assert search.small(batch) is batch


def test_knn_ties_and_clamp(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "t", 0.5), (2, [2.0, 0.0], "t", 0.5), (3, [-1.0, 0.0], "t", 0.5), (4, [1.0, 1.0], "t", 0.1)], "id long, embedding array<float>, type string, weight double")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, qv array<float>")
    got = [(r["id"], round(r["score"], 3)) for r in search.knn(v, q, 3, min_weight=0.2).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 1.0), (3, 0.0)]


def test_retention_counts(spark):
    day = 86400.0
    rows = [
        (1, "fact", 0.5, 5, NOW, NOW, 0.0, True, False), (2, "fact", 0.5, 0, 0.0, NOW - 40 * day, 0.0, True, False), (3, "fact", 0.5, 0, NOW - 100 * day, NOW, 0.0, False, True),
        (4, "conversation", 0.5, 0, 0.0, NOW - 8 * day, 0.0, False, False), (5, "fact", 0.3, 0, 0.0, NOW, 0.0, False, False), (6, "identity", 0.3, 0, 0.0, NOW, 0.0, False, False),
    ]
    df = spark.createDataFrame(rows, "id long, type string, weight double, access_count int, last_accessed double, created double, reinforcement double, short_term boolean, long_term boolean").withColumn("archived", F.lit(False))
    got = {r["id"]: r["action"] for r in lifecycle.retention(df, NOW).collect()}
    assert got == {1: "promote", 2: "promote", 3: "demote", 4: "archive", 5: "archive", 6: "keep"}


def _pagerank(edges, seeds, steps=20):
    out = {}
    for s, d, w in edges:
        out.setdefault(s, []).append((d, w))
    p = dict.fromkeys(seeds, 1 / len(seeds))
    for _ in range(steps):
        new = dict.fromkeys(seeds, 0.15 / len(seeds))
        for s, ps in p.items():
            total = sum(w for _, w in out.get(s, []))
            for d, w in out.get(s, []):
                new[d] = new.get(d, 0) + 0.85 * ps * (w / total if total else w)
            if s not in out:
                for x in seeds:
                    new[x] += 0.85 * ps / len(seeds)
        p = new
    return {k: round(v, 9) for k, v in p.items() if v > 1e-12}


def test_pagerank_of_a_batch_against_brute_force(spark):
    import random

    rng = random.Random(41)
    edges = [(1, 2, 1.0), (1, 3, 3.0), (2, 3, 1.0), (3, 4, 1.0), (4, 1, 0.0), (5, 1, 1.0), (3, 6, 2.0)] + [(rng.randrange(10, 60), rng.randrange(10, 70), rng.random()) for _ in range(150)]
    seeds = {0: [1, 5]} | {q: rng.sample(range(1, 80), rng.randint(1, 4)) for q in range(1, 50)}
    df = spark.createDataFrame([(q, s) for q, ss in seeds.items() for s in [*ss, ss[0]]], "query_id int, id long")
    got = {}
    for r in graph.personalized_pagerank(spark.createDataFrame(edges, "src long, dst long, weight double"), df).collect():
        if r["p"] > 1e-12:
            got.setdefault(r["query_id"], {})[r["id"]] = round(r["p"], 9)
    assert got == {q: _pagerank(edges, ss) for q, ss in seeds.items()}


def test_pagerank_packs_edges_and_sums_mass_in_the_part_that_sends_it(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(graph, "TASK_EDGES", 3)  # many parts, several rows of edges a part
    edges = [(s, d, float(1 + (s * d) % 4)) for s in range(12) for d in range(12) if s != d] + [(3, 20, 0.0)]
    seeds = {"a": [0, 20], "b": [5]}
    df = spark.createDataFrame([(q, s) for q, ss in seeds.items() for s in ss], "query_id string, id long")
    got = {}
    for r in graph.personalized_pagerank(spark.createDataFrame(edges, "src int, dst int, weight double"), df).collect():
        got.setdefault(r["query_id"], {})[r["id"]] = round(r["p"], 9)
    assert got == {q: _pagerank(edges, ss) for q, ss in seeds.items()}
    # two sources of one part and one target: one row of mass goes on, not one an edge
    packed = graph._packed(pa.table({"part": pa.array([0] * 4, pa.int32()), "src": [1, 1, 2, 3], "dst": [9, 8, 9, 9], "w": [1.0, 3.0, 2.0, 0.0]}))
    out = graph._sent(pa.table({"query_id": ["q", "q", "q", "q"], "id": [1, 2, 2, 7], "p": [0.4, 0.1, 0.1, 0.3]}), packed).to_pylist()
    assert [(r["id"], round(r["p"], 9)) for r in out] == [(8, 0.3), (9, 0.3), (None, 0.3)]


def test_label_propagation_communities(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (7, 8)], "src long, dst long")
    got = {r["id"]: r["label"] for r in graph.label_propagation(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    # a path of 30 takes more rounds than any small fixed number; brute force to the end
    path = [(k, k + 1) for k in range(30)]
    both = {k: {k} | {b for a, b in path if a == k} | {a for a, b in path if b == k} for k in range(31)}
    want, rounds = {k: k for k in both}, 0
    while rounds < 50:
        new = {k: min((want[x] for x in both[k]), key=lambda v, k=k: (-sum(want[x] == v for x in both[k]), v)) for k in both}
        if new == want:
            break
        want, rounds = new, rounds + 1
    out = graph.label_propagation(spark.createDataFrame(path, "src long, dst long"))
    assert {r["id"]: r["label"] for r in out.collect()} == want and out.rounds == rounds > 5
    assert graph.label_propagation(e, most=0).where("label <> id").count() == 0


def test_label_propagation_works_out_the_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (7, 8), (8, 7), (9, 9)], "src long, dst long").mapInArrow(counted, "src long, dst long")
    out = graph.label_propagation(e)
    assert {r["id"]: r["label"] for r in out.collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9} and out.rounds == 1
    assert read.value == 6


def test_greedy_dedup_against_brute_force(spark):
    import random

    rng = random.Random(4)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(6, 60))) for _ in range(25)]
    rows = [(i, "g", t) for i, t in enumerate(base)]
    for i in range(40):
        t = list(rng.choice(base))
        t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((100 + i, "g", "".join(t) + ("tail" if i % 9 == 0 else "")))
    rows.append((999, "g", base[0] + base[1] + base[2]))
    got = {r["id"]: r["duplicate"] for r in string_join.greedy_duplicates(spark.createDataFrame(rows, "id long, g string, x string"), "g", "x", [F.col("id")]).collect()}
    kept, want = [], {}
    for i, _, t in sorted(rows):
        want[i] = any((min(len(k), len(t)) >= 8 and (k in t or t in k)) or SequenceMatcher(None, k, t).ratio() >= 0.92 for k in kept)
        if not want[i]:
            kept.append(t)
    assert got == want


def _memories():
    """Rows of long texts that share openings or endings, with archived, core and keyed rows among them."""
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["th", "er", "an", "tion", "Qu", "ze"]) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = [prose(n) for n in (90, 90, 120, 150, 30, 4, 60)]
    texts = [*base, base[0][:200] + " " + prose(70), "Another start. " + base[1], base[2].replace(" ", "\n\t ", 9), base[3].replace("Qu", "qu", 3), base[3] + " tail", base[4] + " x", base[5], "ok", "ok then", "not ok", "", None]
    texts += ["  ".join([base[6][:70], *(prose(1) for _ in range(k))]) for k in range(8)]
    texts += [base[0], base[2], base[6] + " more of it"]
    kinds = ["fact", "fact", "lesson", "conversation", "identity"]
    rows = []
    for i in range(3 * len(texts)):
        t = texts[i % len(texts)]
        rows.append((i, t, kinds[i % 5], "v5_key:a" if i % 13 == 5 else None if i % 7 == 0 else "k", rng.randrange(5) / 4, float(rng.randrange(4)), i % 11 == 3))
    return rows


def _norm(t):
    return " ".join((t or "").split())


def test_whole_texts_dedup_against_brute_force(spark):
    from mnemolake.plans.similar import dedup

    rows = _memories()
    m = spark.createDataFrame(rows, "id long, content string, type string, tags string, weight double, created double, archived boolean")
    got = {r["id"]: r["duplicate"] for r in dedup({"memory": m}).collect()}
    kept, want = {}, {}
    for i, t, kind, tags, _, _, archived in sorted(rows, key=lambda r: (r[2], -r[4], -r[5], r[0])):
        if archived or kind in ("conversation", "identity") or "v5_key:" in (tags or ""):
            continue
        new = _norm(t)
        want[i] = any(SequenceMatcher(None, k, new).ratio() >= 0.92 or (len(k) >= 8 and k in new) or (len(new) >= 8 and new in k) for k in kept.get(kind, []))
        if not want[i]:
            kept.setdefault(kind, []).append(new)
    assert got == want and 0 < sum(want.values()) < len(want)


@pytest.mark.parametrize("slots", [string_join.SLOTS, 64])
def test_long_duplicates_against_brute_force(spark, slots):
    import random

    rng = random.Random(6)
    base = ["".join(rng.choice("eeeeaaatttnnnooosss  rhilQzxq") for _ in range(rng.choice([199, 200, 260, 900]))) for _ in range(10)]
    rows = [(i, "g", t) for i, t in enumerate(base)]
    for i in range(40):
        t = list(rng.choice(base))
        for _ in range(rng.choice([1, 5, len(t) // 20, len(t) // 10])):
            t[rng.randrange(len(t))] = rng.choice(["", "e", "Z", "zz"])
        rows.append((100 + i, "g", "".join(t)))
    got = {(r["old"], r["id"]) for r in string_join.close_pairs(spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "id long, g string, x string, n long"), 0.92, slots).collect()}
    want = {(a[0], b[0]) for k, b in enumerate(rows) for a in rows[:k] if SequenceMatcher(None, a[2], b[2]).ratio() >= 0.92}
    assert got == want and want


def test_whole_texts_upsert_against_brute_force(spark):
    from mnemolake.plans.similar import join_similar

    rows = _memories()
    t = {"memory": spark.createDataFrame(rows, "id long, content string, type string, tags string, weight double, created double, archived boolean")}
    got = {r["id"]: (r["old_id"], r["ratio"]) for r in join_similar(t).collect()}
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    want = {}
    for i, text, kind, *_ in rows:
        new = _norm(text)
        probe = next((new[:at] for at in map(new.find, "，。；;！？") if 6 <= at <= 24), new[:14])
        cands = sorted((r for r in rows if probe and r[0] < i and not r[6] and lower(probe) in lower(r[1] or "")), key=lambda r: (-r[4], -r[0]))[:10]
        best, top, old = None, 0.0, ""
        for r in cands:
            if r[2] == kind and (x := SequenceMatcher(None, _norm(r[1]), new).ratio()) > top:
                best, top, old = r[0], x, _norm(r[1])
        if best is not None and (top >= 0.75 or (len(old) >= 8 and old in new) or (len(new) >= 8 and new in old)):
            want[i] = (best, round(top, 6))
    assert got == want and want


def test_upsert_merges_against_brute_force(spark):
    from mnemolake.plans.similar import sink_upsert

    rows = _memories()
    extra = [(*r, r[0] % 3, 0.0, r[0] % 5 / 10) for r in rows]
    t = {"memory": spark.createDataFrame(extra, "id long, content string, type string, tags string, weight double, created double, archived boolean, access_count int, last_accessed double, reinforcement double")}
    store = {r[0]: list(r) + [False] for r in extra if r[0] % 2 == 0}
    before = [r for r in rows if r[0] % 2 == 0]
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    split = lambda s: [x for x in (s or "").replace(",", " ").split() if x]
    merges = 0
    for r in (r for r in extra if r[0] % 2 == 1):
        i, text, kind, tags = r[:4]
        new = _norm(text)
        probe = next((new[:at] for at in map(new.find, "，。；;！？") if 6 <= at <= 24), new[:14])
        cands = sorted((o for o in before if probe and o[0] < i and not o[6] and lower(probe) in lower(o[1] or "")), key=lambda o: (-o[4], -o[0]))[:10]
        best, top = None, 0.0
        for o in cands:
            if o[2] == kind and (x := SequenceMatcher(None, _norm(o[1]), new).ratio()) > top:
                best, top = o, x
        old = _norm(best[1]) if best else ""
        if best and "v5_key:" not in (tags or "") and (top >= 0.75 or (len(old) >= 8 and old in new) or (len(new) >= 8 and new in old)):
            m = store[best[0]]
            m[1] = text if len(text or "") > len(m[1] or "") else m[1]
            m[3] = " ".join(dict.fromkeys(split(m[3]) + split(tags)))
            m[4], m[7], m[9], m[10] = max(m[4], r[4]), m[7] + 1, m[9] + max(0.0, r[9]) + 0.05, True
            merges += 1
        else:
            store[i] = list(r) + [False]
    want = {k: (hashlib.sha256(m[1].encode()).hexdigest() if m[1] is not None else None, m[3], m[4], m[7], round(min(1.0, m[9]) if m[10] else m[9], 6), m[10]) for k, m in store.items()}
    assert {r["id"]: tuple(r)[1:] for r in sink_upsert(t).collect()} == want and merges > 5


def test_entities_against_brute_force(spark):
    """The best entity by difflib's ratio, and the best three, of every name."""
    from mnemolake.plans.similar import _SURFACES, entity_fuzzy, join_fuzzy

    import re

    names = [(i, n) for i, n in enumerate(["Brand#12 30", "brand 12 30", "Brand#34 1", "brand#34 11", "brand#341", "Brand_34-17 (old)", "Brand 34 17", "bananas", "Banana", "band", "brand#12 30 x" * 3, ""])]
    aliases = [(9, "Alias 30"), (4, "alias 31"), (7, "brand#1230"), (0, "nana")]
    t = {"eg_entities": spark.createDataFrame(names, "id long, name string"), "eg_aliases": spark.createDataFrame(aliases, "entity_id long, alias string"), "part": spark.range(1)}
    norm = lambda s: re.sub(r"[\s_—-]+", "", re.sub(r"[（(].*?[)）]", "", s.lower()))

    def aligned(s):
        all_names = [(-SequenceMatcher(None, norm(s), norm(n)).ratio(), 0, i) for i, n in names] + [(-SequenceMatcher(None, norm(s), norm(n)).ratio(), 1, i) for i, n in aliases]
        r, _, i = sorted(all_names)[0]
        return [(i, round(-r, 6))] if r <= -0.82 else []

    assert {tuple(r) for r in join_fuzzy(t).collect()} == {(q, i, r) for q, s in _SURFACES for i, r in aligned(s)}
    want = set()
    for q, s in [(1, "Brand#12 30"), (2, "brand#34 1"), (3, "alias 3O")]:
        hits = sorted({(i, 1.0) for i, n in [*names, *aliases] if n == s})
        if not hits:
            inside = [(i, min(len(n), len(s)) / max(len(n), len(s))) for i, n in names if n and (n.lower() in s.lower() or s.lower() in n.lower())]
            hits = sorted(inside, key=lambda x: (-x[1], x[0]))
        hits += [x for x in aligned(s) if x[0] not in [i for i, _ in hits]]
        want |= {(q, i, round(r, 6)) for i, r in hits[:3]}
    assert {tuple(r) for r in entity_fuzzy(t).collect()} == want and {q for q, _, _ in want} == {1, 2, 3}


def test_few_surfaces_are_held_against_names_as_they_are_read(spark, monkeypatch):
    from mnemolake.plans import graphs, similar

    names = spark.createDataFrame([(i, f"Brand#{i % 7}{i % 5} {i}") for i in range(400)] + [(400, "Élan 1"), (401, ""), (402, None)], "id long, name string")
    surfaces = spark.createDataFrame([(1, "brand#12"), (2, "the BRAND#33 38 of old"), (3, "élan 1, again"), (4, ""), (5, None)], "query_id int, surface string")
    want = {(q, i, min(len(n), len(s)) / max(len(n), len(s))) for i, n in names.collect() for q, s in surfaces.collect() if n and s and (n.lower() in s.lower() or s.lower() in n.lower())}
    monkeypatch.setattr(graphs, "FEW", 0)
    assert {tuple(r) for r in graphs.contained(names, surfaces).collect()} == want and {q for q, _, _ in want} == {1, 2, 3}
    monkeypatch.setattr(graphs, "FEW", 64)
    monkeypatch.setattr(graphs, "holders", None)  # no walk in Python
    assert {tuple(r) for r in graphs.contained(names, surfaces).collect()} == want
    # of the names, only those go to difflib that the edit distance lets through, equal ones once
    seen = spark.sparkContext.accumulator(0)
    counted = similar.ratio

    def ratio(a, b, least):
        tell = F.udf(lambda x: (seen.add(1), x)[1]).asNondeterministic()
        return counted(tell(a), b, least)

    monkeypatch.setattr(similar, "ratio", ratio)
    t = {"eg_entities": names, "eg_aliases": spark.createDataFrame([(i, f"alias {i % 3}") for i in range(300)], "entity_id long, alias string")}
    assert [tuple(r) for r in similar._aligned(t, spark.createDataFrame([(1, "alias 2"), (2, "Elan 1")], "query_id int, surface string")).collect()] == [(1, 2, 1.0)]
    assert 0 < seen.value < 30


def test_repeats_are_shuffled_as_texts(spark, monkeypatch):
    import random

    from mnemolake.plans import retrieval

    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["aa", "bb", "cc"]) for _ in range(n))
    used = spark.createDataFrame([(c, k, say(40)) for c in range(6) for k in range(c)], "character long, turn int, text string").repartition(3)
    asked = spark.createDataFrame([(c, say(12)) for c in range(8)] + [(2, "aa bb"), (3, None)], "character long, text string")
    rows = lambda: sorted(tuple(r[:3]) + (round(r[3], 9),) for r in retrieval.repeat_score(used, asked).collect())
    want = rows()
    assert len(want) == 8 and sum(k for _, _, k, _ in want) == 5 and max(s for *_, s in want) > 0
    monkeypatch.setattr(retrieval, "MANY", 2)  # three characters as grams
    assert rows() == want
    dealt = retrieval.top_grams(used.repartition(3, "character").select("character", "turn", F.explode(retrieval.repeat_grams(F.col("text"), 5)).alias("ngram")))
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1  # the one by character


def test_links_do_not_depend_on_where_the_search_stops(spark):
    import random

    from mnemolake.plans.graphs import project_links

    rng, words = random.Random(10), ["aa", "bb", "cc", "dd", "ee", "ff", "gg"]
    rows = [(i, " ".join(rng.sample(words, rng.randint(1, 4))), rng.randint(0, 9) / 10, f"v5_project:p{i % 2},v5_kind:{rng.choice(['decision', 'pitfall', 'idea'])}", i % 13 == 0) for i in range(120)]
    memory = spark.createDataFrame(rows, "id long, content string, weight double, tags string, archived boolean")
    got = [sorted(map(tuple, project_links(memory, memory.select("id"), soon, first).collect())) for soon, first in ((20, 8), (9, 2), (200, 200))]
    assert got[0] == got[1] == got[2] and len(got[0]) > 300


def test_rules_can_be_switched(spark):
    from mnemolake.plans.predicates import memory_rules

    m = spark.createDataFrame([(1, " ", "fact", 2.0, 0.0, 0.0, 0.0), (2, "x", "odd", 0.5, 0.0, 1.0, 0.0), (3, None, None, None, None, None, None)], "id long, content string, type string, weight double, pad_p double, pad_a double, pad_d double")
    rules = memory_rules()
    codes = lambda: {r["id"]: r["errors"] for r in rules.check(m).collect()}
    assert codes() == {1: ["empty", "weight"], 2: ["type", "pad"], 3: []}
    rules.disable("empty")
    rules.register("even", lambda: F.col("id") % 2 == 0, "critical")
    assert codes() == {1: ["weight"], 2: ["type", "pad", "even"], 3: []} and rules.summary()["disabled"] == ["empty"]
    assert [r["id"] for r in rules.accepted(m).orderBy("id").collect()] == [1, 3]
    rules.enable("empty")
    assert [r["id"] for r in rules.accepted(m).collect()] == [3]
    with pytest.raises(ValueError):
        rules.register("x", lambda: F.lit(True), "odd")


def test_maintenance(spark, tmp_path):
    from mnemolake.maintenance import Maintenance

    ran = []
    m = Maintenance({"a": 50.0})
    m.register("a", lambda: ran.append("a") or 1, 100)
    m.register("b", lambda: 1 / 0, 10)
    m.register("c", lambda: ran.append("c") or 2, 10)
    assert m.due(100.0) == ["b", "c"] and {k: v["due"] for k, v in m.dry_run(100.0).items()} == {"a": False, "b": True, "c": True} and not ran
    out = m.run_all(100.0, go_on=True)
    assert out["c"] == 2 and isinstance(out["b"], ZeroDivisionError) and ran == ["c"] and m.due(105.0) == ["b"]
    with pytest.raises(ZeroDivisionError):
        m.run_all(105.0)
    assert m.run_one("a", 105.0) is None and m.run_one("a", 105.0, force=True) == 1
    m.save(spark, f"file://{tmp_path}/s")
    other = Maintenance()
    other.load(spark, f"file://{tmp_path}/s")
    assert other.last == m.last == {"a": 105.0, "c": 100.0}


def test_words_take_the_longest_first():
    """Against the rule read out: longer words first, then by their place in the list, then from the left; no character twice."""
    import random

    rng = random.Random(1)
    chars = "惊喜欢好棒不要为什么谢真厉害想你爱?x太了错"
    for _ in range(500):
        text = "".join(rng.choice(chars) for _ in range(rng.randint(0, 14)))
        want, used = [0.0] * 3, set()
        for w in sorted(folds.WORDS, key=lambda w: -len(w)):
            for at in range(len(text) - len(w) + 1):
                here = set(range(at, at + len(w)))
                if text[at : at + len(w)] == w and not here & used:
                    used |= here
                    want = [a + b for a, b in zip(want, folds.WORDS[w], strict=True)]
        assert folds.word_deltas(text)[:3] == pytest.approx(want)



def test_ratio_of_whole_turns(spark):
    from mnemolake.plans.similar import str_ratio

    a, b = "same start " * 30 + "and one end", "same  start " * 30 + "then quite another close of it"
    t = {"conversations": spark.createDataFrame([(1, 0, a), (1, 1, b), (2, 0, b)], "conv_id long, turn long, text string")}
    assert [tuple(r) for r in str_ratio(t).collect()] == [(1, 1, round(SequenceMatcher(None, _norm(a), _norm(b)).ratio(), 6))]


def test_ratio_order_matters():
    assert similar.ratio_of("tide", "diet") == SequenceMatcher(None, "tide", "diet").ratio() != similar.ratio_of("diet", "tide")


def test_affect_words():
    assert folds.word_deltas("谢谢你 太好了") == pytest.approx([0.25, -0.05, 0.0, 0.15, 0.0, 0.2])
    assert folds.word_deltas("好棒")[:3] == pytest.approx([0.15, 0.10, 0.10])
    a = folds.affect(None, SimpleNamespace(ts=0.0, text="爱"))
    b = folds.affect(a, SimpleNamespace(ts=120 * 60.0, text=""))
    assert a["pleasure"] == pytest.approx(0.6) and b["pleasure"] == pytest.approx(0.4)


@pytest.mark.parametrize("name", ["affect", "relationship", "vitality", "care", "curiosity", "summary"])
def test_stream_equals_batch(spark, sf, tmp_path, name):
    x = tables(spark, sf)["interactions"].where("user_id < 5").orderBy("ts", "event_id")
    rows = x.collect()
    schema = x.schema
    for i in range(3):
        part = rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = stream_fold(stream, name).writeStream.format("memory").queryName(f"s_{name}").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in sorted(spark.table(f"s_{name}").collect(), key=lambda r: r["ts"]):
        got[r["user_id"]] = tuple(r)
    for r in folds.fold(x, name).collect():
        other = got[r["user_id"]]
        want = [v for k, v in r.asDict().items() if k not in ("user_id", "event_id", "ts")]
        assert [v for v in list(other)[-len(want) :] if isinstance(v, str)] == [v for v in want if isinstance(v, str)]
        assert [v for v in list(other)[-len(want) :] if not isinstance(v, str)] == pytest.approx([v for v in want if not isinstance(v, str)])


def test_windowed_counts(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = windowed_counts(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == e.count()


def test_guard_and_recall(spark):
    rows = [(0, i, "assistant", t) for i, t in enumerate(["Okay, the user wants", "```x```", "{\"a\": 1}", "x" * 801, "", "plain fact", "你好", "ok", "你好，你还记得上次聊的吗"])]
    t = {"conversations": spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")}
    errors = {r["turn"]: r["errors"] for r in predicates.guard(t).collect()}
    assert [errors[i] for i in range(6)] == [["narration"], ["fence"], ["json"], ["length"], [], []]
    recall = {r["turn"]: r["recall"] for r in predicates.should_recall(t).collect()}
    assert [recall[i] for i in (6, 7, 8)] == [False, False, True]


def test_range_join_is_whole(spark):
    from mnemolake.plans.extras import range_join

    events = [(i, i / 7) for i in range(300)] + [(900, 50.01), (901, 50.0), (902, 50.011), (903, -0.005), (904, None)]
    memory = [(i, i % 101 / 100) for i in range(0, 900, 3)]
    t = {"events": spark.createDataFrame(events, "event_id long, value double"), "memory": spark.createDataFrame(memory, "id long, weight double")}
    got = sorted(tuple(r) for r in range_join(t).collect())
    assert got == sorted((e, m) for e, v in events if v is not None for m, w in memory if 100 * w - 0.01 <= v <= 100 * w + 0.01)
    assert any(m >= 300 for _, m in got)


def test_numbered_is_consecutive(spark):
    from mnemolake.operators.numbering import numbered

    rows = [(k * 37 % 1000, k) for k in range(1000)]
    got = numbered(spark.createDataFrame(rows, "a long, b long").repartition(5), [F.col("a")], "n").collect()
    assert sorted((r["a"], r["n"]) for r in got) == [(k, k + 1) for k in range(1000)]
    assert numbered(spark.createDataFrame([], "a long"), [F.col("a")], "n").count() == 0


def test_sketches_against_counts(spark, sf):
    from mnemolake.plans.aggregates import agg_approx

    t = tables(spark, sf)
    r, rows = agg_approx(t).first(), t["lineitem"].toPandas()
    assert abs(r["parts"] - rows["l_partkey"].nunique()) <= 0.15 * rows["l_partkey"].nunique()
    for x, name in ((r["median_quantity"], "l_quantity"), (r["median_price"], "l_extendedprice")):
        assert 0.45 <= (rows[name] <= x).mean() and (rows[name] < x).mean() <= 0.55
    assert {x["item"]: x["count"] for x in r["frequent"]} == rows["l_returnflag"].value_counts().head(3).to_dict()


def chain(n):
    return [(1000 + k, None if k == 0 else 1000 + k - 1) for k in range(n)]


def test_paths_of_a_long_conversation(spark):
    """A chain of 1,500 turns: past any limit on recursion, and over a million pairs."""
    from mnemolake.operators import forest

    nodes = spark.createDataFrame(chain(1500), "node_id long, parent_id long")
    r = forest.ancestors(nodes).agg(F.count(F.lit(1)).alias("n"), F.sum("dist").alias("d"), F.max("dist").alias("m"), F.sum(F.col("node_id") - F.col("ancestor_id") - F.col("dist")).alias("off")).first()
    assert tuple(r) == (1500 * 1501 // 2, sum(k * (k + 1) // 2 for k in range(1500)), 1499, 0)
    few = forest.ancestors(nodes, spark.createDataFrame([(2400,), (1000,)], "node_id long"))
    assert few.count() == 1401 + 1
    assert forest.ancestors(nodes, within=6).count() == 6 * 1500 - 15
    got = {r["node_id"]: (r["ancestor_id"], r["dist"]) for r in forest.nearest(nodes, nodes.where("node_id IN (1100, 1700, 1701)").select("node_id")).collect()}
    assert got == {n: (m, n - m) for n in range(1100, 2500) for m in [max(x for x in (1100, 1700, 1701) if x <= n)]}


def test_forests_against_brute_force(spark):
    import random

    from mnemolake.operators import forest

    rng = random.Random(3)
    parent = {k: None if rng.random() < 0.05 else rng.randrange(k) if k and rng.random() < 0.9 else -k - 1 for k in range(300)}  # negative: no row of its own
    nodes = spark.createDataFrame(list(parent.items()), "node_id long, parent_id long")
    path = lambda n: [n] + (path(parent[n]) if parent.get(n) is not None else [])
    want = {(n, a, d) for n in parent for d, a in enumerate(path(n))}
    assert {tuple(r) for r in forest.ancestors(nodes).collect()} == want
    assert {tuple(r) for r in forest.ancestors(nodes, within=3).collect()} == {w for w in want if w[2] < 3}
    marked = {k for k in parent if rng.random() < 0.1}
    got = {tuple(r) for r in forest.nearest(nodes, spark.createDataFrame([(k,) for k in marked], "node_id long")).collect()}
    assert got == {(n, a, d) for n in parent for d, a in [next(((d, a) for d, a in enumerate(path(n)) if a in marked), (None, None))] if a is not None}
    with pytest.raises(ValueError):
        forest.nearest(spark.createDataFrame([(1, 2), (2, 1)], "node_id long, parent_id long"), nodes.where("false"))


def test_sink_store_numbers_every_block(spark):
    from mnemolake.plans.sinks import sink_store

    events = [(i, "view", float(i % 300)) for i in [5, 9_999, 10_000, 25_000, 3, 70_001]]
    t = {"events": spark.createDataFrame(events, "event_id long, event_type string, value double"), "memory": spark.createDataFrame([(7, "old", 0.5), (50, "older", 0.25)], "id long, content string, weight double")}
    got = sorted((r["id"], r["weight"]) for r in sink_store(t).collect())
    assert got == [(7, 0.5), (50, 0.25), *((51 + k, min(1.0, v / 100)) for k, (_, _, v) in enumerate(sorted(events)))]


def test_tree_scope_against_brute_force(spark):
    from pyspark.sql import Row

    from mnemolake.plans import trees

    # two conversations of eight turns; every third turn hangs on the one before the last, on a branch of its own
    nodes = {c * 100 + k: (c, None if k == 0 else c * 100 + k - (2 if k % 3 == 2 else 1), "b" if k % 3 == 2 else None) for c in (1, 40) for k in range(8)}
    turns = spark.createDataFrame([Row(node_id=n, conv_id=c, parent_id=p, branch_label=b) for n, (c, p, b) in nodes.items()], "node_id long, conv_id long, parent_id long, branch_label string")
    asks = {1: 104, 2: 4004, 3: 107}
    found = [(q, i, round(0.3 + (i * 7 + q) % 10 / 20, 4), k) for q in asks for k, i in enumerate([*nodes, 9_000, 9_001])]
    got = trees.scoped(spark.createDataFrame(found, "query_id long, id long, score double, arrival int"), turns, trees.ancestors({"turns": turns}), spark.createDataFrame(list(asks.items()), "query_id long, node_id long"), 6)
    want = set()
    for q, n in asks.items():
        path, at = [], n
        while at is not None:
            path.append(at)
            at = nodes[at][1]
        labels = {nodes[p][2] for p in path} - {None}
        rows = []
        for _, i, score, k in (f for f in found if f[0] == q):
            if i in nodes and nodes[i][0] != nodes[n][0]:
                continue
            scope = "path" if i in path else "branch" if i in nodes and nodes[i][2] in labels else "global"
            rows.append((-round(score + {"path": 0.4, "branch": 0.2, "global": 0.0}[scope], 9), -score, k, i, scope))
        want |= {(q, i, scope, round(-s, 4)) for s, _, _, i, scope in sorted(rows)[:6]}
    assert {tuple(r) for r in got.collect()} == want and {w[2] for w in want} >= {"path", "branch"}


def test_str_compress_trims_spaces_and_keeps_digits(spark):
    """A line's place in the text is no argument of its trim: line 0 lost its zeros, line 1 its ones."""
    from mnemolake.plans.text import str_compress

    m = spark.createDataFrame([(1, "0 call 555-8630\n1 room 11\n  spaced  ")], "id long, content string")
    assert str_compress({"memory": m}).collect()[0]["short"] == "0 call 555-8630 1 room 11 spaced"


def test_tasks_of_pairs_grow_with_the_order_lines(spark, monkeypatch):
    """A task holds so many lines and pairs at most, however many there are; the rows stay those of the SQL (test_queries)."""
    from mnemolake.sources import fixtures

    monkeypatch.setattr(fixtures, "LINES", 100)
    monkeypatch.setattr(fixtures, "PAIRS", 100)
    monkeypatch.setattr(fixtures.parts, "__defaults__", (100,))
    t = tables(spark, "/root/testdata/sf0.001")
    lines = t["lineitem"].count()
    assert t["eg_episodic_entities"].rdd.getNumPartitions() == lines // 100 + 1
    assert t["eg_edges"].rdd.getNumPartitions() == lines // 50 + 1


def test_pagerank_of_seeds_without_edges(spark):
    """Mass of nodes without edges returns to the seeds of its own query, also where every node lacks edges."""
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 3, 3.0), (2, 3, 0.0)], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(1, 1), (1, 9), (2, 3), (2, 4)], "query_id int, id long")
    got = {(r["query_id"], r["id"]): r["p"] for r in graph.personalized_pagerank(edges, seeds).collect()}
    for q, s in ((1, [1, 9]), (2, [3, 4])):
        p = dict.fromkeys(s, 1 / len(s))
        for _ in range(graph.ITERATIONS):
            new = {x: 0.15 / len(s) for x in s}
            for x, m in p.items():
                for y, w in {1: [(2, 0.25), (3, 0.75)], 2: [(3, 0.0)]}.get(x, [(y, 1 / len(s)) for y in s]):
                    new[y] = new.get(y, 0.0) + 0.85 * m * w
            p = new
        assert {k[1] for k in got if k[0] == q} == set(p)
        assert all(abs(got[q, x] - m) < 1e-12 for x, m in p.items())


@pytest.mark.parametrize("asked", [True, False])
def test_consolidation_writes_every_table(spark, asked):
    """Entities, aliases, memories, links and edges of a batch, by the answers of a model or without any; links in their order, one entity named twice."""
    from mnemolake.operators.consolidation import consolidated

    drafts = [(1, "one", 0.8), (2, "two", None), (3, "three", 1.5), (4, "nobody", 0.5)]
    links = [(1, 0, 20, 0.1), (1, 1, 10, 0.9), (1, 2, 30, None), (2, 0, 10, 5.0), (2, 1, 20, 0.4), (3, 0, 40, 0.5), (3, 1, 99, 0.5), (7, 0, 50, 0.5)]
    local = [(i, f"s{i}", "object", f"h{i}") for i in (10, 20, 30, 40, 50)]
    said = [(10, "merge", 5, 0.75, "ten", None), (20, "merge", 5, 0.9, "old", None), (30, "merge", 6, 0.74, "no", "thirty"), (40, "create_new", None, None, None, "forty"), (50, "create_new", None, None, None, None)]
    edges = [(5, 5, 0.95, 3), (5, -30, 0.2, 1), (8, 9, 0.5, 1)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = consolidated(
        frame(drafts, "memory_id long, summary string, importance double"), frame(links, "memory_id long, pos int, local_id long, weight double"), frame(local, "local_id long, surface string, type string, hint string"),
        frame(said, "local_id long, action string, entity_id long, confidence double, alias_to_add string, canonical_name string") if asked else None, frame([(5, "old")], "entity_id long, alias string"), frame(edges, "src long, dst long, weight double, co_occurrence_count int"),
    )
    ids = {10: 5, 20: 5, 30: -30, 40: -40} if asked else {i: -i for i in (10, 20, 30, 40)}
    want_links, want_memories, graph_ = {}, {}, {(a, b): (w, n) for a, b, w, n in edges}
    touched, pairs = set(), 0
    for m, summary, importance in drafts[:3]:
        mine, weight = [ids[x] for k, _, x, _ in links if k == m and x in ids], max(0.0, min(1.0, 0.5 if importance is None else importance))
        for k, _, x, w in links:
            if k == m and x in ids:
                want_links.setdefault((m, ids[x]), max(0.3, min(1.0, 0.5 if w is None else w)))
        want_memories[m] = (summary, weight, ", ".join(map(str, mine)))
        for i, a in enumerate(mine):
            for b in mine[i + 1 :]:
                w, n = graph_.get((a, b), (0.0, 0))
                graph_[a, b] = (min(1.0, w + 0.1 * weight), n + 1)
                touched.add((a, b))
                pairs += 1
    got = {k: [tuple(r) for r in df.collect()] for k, df in out.items()}
    assert {x[:2]: x[2] for x in got["links"]} == want_links and len(got["links"]) == len(want_links)
    assert {x[0]: x[1:] for x in got["memories"]} == want_memories
    assert {x[:2]: (round(x[2], 9), x[3]) for x in got["edges"]} == {k: (round(graph_[k][0], 9), graph_[k][1]) for k in touched}
    names = {-30: "thirty", -40: "forty"} if asked else {-i: f"s{i}" for i in ids}
    assert set(got["entities"]) == {(i, "object", name, f"h{-i}") for i, name in names.items()}
    assert set(got["aliases"]) == ({(5, "ten")} if asked else set())
    assert dict(got["stats"]) == {"entities_created": len(names), "entities_merged": 4 - len(names), "aliases_added": 2 if asked else 0, "edges_updated": pairs, "episodic_created": 3}


def test_edges_by_source_go_into_the_rank_as_they_lie(spark, sf, monkeypatch):
    """They are those of eg_edges, all of a source in one part, and are not written before they are packed."""
    from mnemolake.operators import parts

    rows = [5, 5, 6, 1 << 40, -7, 3, 0]
    assert parts.thick(parts.thin(np.array(rows))).tolist() == rows and parts.thick(parts.thin(np.zeros(0, np.int64))).tolist() == []
    assert parts.parts_of(np.array(rows), 7).tolist() == [r[0] for r in spark.createDataFrame([(x,) for x in rows], "id long").select(parts.part_of("id", 7)).collect()]
    t = tables(spark, sf)
    out = t["eg_out_edges"]
    key = lambda df: {(r["src"], r["dst"]): (round(r["weight"], 9), r["co_occurrence_count"]) for r in df.collect()}
    assert key(out) == key(t["eg_edges"]) and out.select("src", "part").distinct().count() == out.select("src").distinct().count()
    seeds, written = spark.createDataFrame([("a", 1), ("a", 77), ("b", 3)], "query_id string, id long"), []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(df.columns) or real(df))
    rank = lambda e: {(r["query_id"], r["id"]): round(r["p"], 9) for r in graph.personalized_pagerank(e, seeds).collect()}
    got = rank(out)
    assert not [c for c in written if "w" in c]
    assert got == rank(t["eg_edges"])


def test_one_batch_makes_no_index(spark, sf, monkeypatch):
    """The queries of unified_graph that need the texts read them; the index of a session is used where it is there."""
    from mnemolake.plans import catalog, retrieval

    monkeypatch.setattr(retrieval, "_INDEXES", {})
    monkeypatch.setattr(retrieval.SegmentedIndex, "upsert", lambda *_: pytest.fail("made an index"))
    assert catalog.queries()["unified_graph"](spark, sf).count() > 0
    assert retrieval.kept_index(tables(spark, sf)) is None


def test_label_rounds_move_nodes_not_edges(spark, monkeypatch):
    """What rounds read is one row a node with its neighbours and itself; an edge that lacks an end still names its node."""
    written, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(real(df)) or written[-1])
    star = [(0, i) for i in range(1, 40)] + [(i, 0) for i in range(1, 5)] + [(50, None)]
    out = graph.label_propagation(spark.createDataFrame(star, "src long, dst long"))
    assert {r["id"]: r["label"] for r in out.collect()} == dict.fromkeys(range(40), 0) | {50: 50}
    near = {r["other"]: sorted(r["ids"]) for r in written[0].collect()}
    assert near == {0: list(range(40)), 50: [50]} | {i: [0, i] for i in range(1, 40)}

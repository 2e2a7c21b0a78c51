import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemolake.llm import near_dups, suffix_dedup, vectors


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def brute_components(rows, size, threshold=80):
    """n_shingles by row and the smallest id reachable, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = lower(t).encode().split()
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    near = defaultdict(set)
    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            both = len(sets[i] & sets[j])
            if a is not None and b is not None and both and 100 * both >= threshold * len(sets[i] | sets[j]):
                near[a].add(b)
                near[b].add(a)
    out = []
    for (d, _), s in zip(rows, sets, strict=True):
        seen, todo = {d}, [d]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out.append((d, len(s), None if d is None else min(seen), d is None or d == min(seen)))
    return out


def brute_repeats(texts, span=400):
    """(n_removed, n_spans, kept bytes, spans) of each text."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + span] for b in raw for i in range(len(b) - span + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - span + 1):
            if count[b[i : i + span]] > 1:
                gone[i : i + span] = True
        edge = np.diff(np.concatenate([[False], gone]).astype(int))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        out.append((int(gone.sum()), len(spans), np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes(), spans))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("salt,limit", [(near_dups.SALT, near_dups.LIMIT), (1, 2)])
def test_near_duplicates(docs, no_docs, rows, salt, limit):
    got = [tuple(r) for r in near_dups.near_duplicates(docs, salt=salt, limit=limit).collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows, 4), key=key)
    if limit > 2:
        assert near_dups.near_duplicates(no_docs).count() == 0


def test_chains_that_stars_miss(spark):
    # neighbours in the chain are similar, ends are not; all share the bucket of their common part
    base = [f"w{i}" for i in range(100)]
    chain = [(100 - k, " ".join(base[6 * k :] + [f"x{i}" for i in range(6 * k)])) for k in range(12)]
    got = [tuple(r) for r in near_dups.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), limit=3).collect()]
    assert sorted(got) == sorted(brute_components(chain, 4))


def test_prefix_join_is_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 40))).astype(np.uint64) for _ in range(60)]
    sets += [np.unique(np.append(s[:-1], rng.integers(0, 60))).astype(np.uint64) for s in sets]
    links = list(near_dups.prefix_join(sets, list(range(len(sets))), 80))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        assert near_dups.similar(sets[i], sets[j], 80)
        parent[root(i)] = root(j)
    for i in range(len(sets)):
        for j in range(i):
            if near_dups.similar(sets[i], sets[j], 80):
                assert root(i) == root(j)


def test_circulant_signature_estimates_jaccard():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:700], rng.integers(0, 2**63, 300).astype(np.uint64)])
    same = (near_dups.signature(a, 512) == near_dups.signature(b, 512)).mean()
    assert abs(same - 700 / 1300) < 0.08


@pytest.mark.parametrize("limit,batch", [(suffix_dedup.LIMIT, suffix_dedup.STRINGS), (1, 3)])
def test_suffix_dedup(docs, no_docs, rows, limit, batch):
    want = {t: r for (_, t), r in zip(rows, brute_repeats([t for _, t in rows]), strict=True) if r[0]}
    got = {r["text_key"]: r for r in suffix_dedup.repeated_spans(docs, limit=limit, batch_strings=batch).collect()}
    assert len(got) == len(want)
    for t, (removed, spans, kept, at) in want.items():
        r = got[hashlib.sha256(t.encode()).digest()[:16]]
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (removed, spans, hashlib.sha256(kept).hexdigest())
        assert [(s["start"], s["end"]) for s in r["spans"]] == at
    assert suffix_dedup.repeated_spans(no_docs).count() == 0


@pytest.mark.parametrize("limit,batch", [(suffix_dedup.LIMIT, suffix_dedup.STRINGS), (1, 3)])
def test_suffix_dedup_keeps_the_first(docs, rows, limit, batch):
    texts = {hashlib.sha256(t.encode()).digest()[:16]: t.encode() for _, t in rows if t}
    first, count = {}, Counter()
    for k in sorted(texts):
        for i in range(len(texts[k]) - 399):
            w = texts[k][i : i + 400]
            first.setdefault(w, (k, i))
            count[w] += 1
    want = {}
    for k, b in texts.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if first[b[i : i + 400]] != (k, i):
                gone[i : i + 400] = True
        if gone.any():
            want[k] = int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
    got = suffix_dedup.repeated_spans(docs, limit=limit, batch_strings=batch, keep_first=True).collect()
    assert {bytes(r["text_key"]): (r["n_removed"], r["kept_sha256"]) for r in got} == want and len(want) > 3
    assert any(c > 1 for c in count.values())


def test_passages_of_51_words_go(spark):
    """Passages of 51 to 60 words, many under 400 bytes, planted in several documents each; clean documents stay as they are."""
    from conftest import prose  # the fixtures beside this file

    rng = random.Random(11)
    rows, planted = [], {}
    for n in range(51, 61):
        passage = prose(rng, n)
        for _ in range(rng.randint(2, 4)):
            rows.append((len(rows), f"{prose(rng, rng.randint(0, 90))}\n{passage} {prose(rng, rng.randint(0, 90))}"))
            planted[len(rows) - 1] = passage
    shared = prose(rng, 30)  # a passage of 30 words is no reason to cut
    rows += [(len(rows) + i, f"{prose(rng, 70)} {shared} {prose(rng, 20)}") for i in range(5)]
    assert sum(len(p.encode()) < 400 for p in planted.values()) > 10
    docs = spark.createDataFrame([(d, t, len(t), "mine", "mine", 0) for d, t in rows], "doc_id long, text string, n_chars int, text_key string, kept_text string, spans int")
    out = corpus_pipeline.stage_suffix_dedup(spark, docs, "")
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows) and {(r["text_key"], r["kept_text"]) for r in got.values()} == {("mine", "mine")}
    for d, t in rows:
        assert got[d]["n_chars"] == len(got[d]["text"])
        if d in planted:
            assert planted[d] not in got[d]["text"] and len(t) - len(got[d]["text"]) <= len(planted[d]) + 12
        else:
            assert got[d]["text"] == t


def test_suffix_query(spark, sf):
    d = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, len(t.encode()), n, s, hashlib.sha256(k).hexdigest()) for (i, t), (n, s, k, _) in zip(d, brute_repeats([t for _, t in d]), strict=True)]
    assert sorted(tuple(r) for r in suffix_dedup.op2_suffix_dedup(spark, sf).collect()) == sorted(want)


def test_vectors(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    data = {r["vec_id"]: np.array(r["embedding"], float) for r in v.collect()}
    odd = spark.createDataFrame([(1000, None), (1050, [0.0] * 64), (1100, [float("nan")] * 64), (1150, [None] * 64), (1200, [1.0] * 3), (1250, [float(x) for x in data[7]]), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    both = v.union(odd)
    data[1250] = data[7].astype(np.float32).astype(float)
    ids = np.array(sorted(data))
    x = np.array([data[i] for i in ids])

    def exact(q):
        s = (x * data[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((data[q] ** 2).sum()))
        s[ids == q] = -9
        return [(q, r + 1, int(ids[i]), float(s[i])) for r, i in enumerate(np.lexsort((ids, -s))[:5])]

    want = [r for q in ids[ids % 50 == 0].tolist() for r in exact(q)]
    ask = both.where("vec_id % 50 = 0")
    full = sorted(tuple(r) for r in vectors.search(both, ask, probes=vectors.MOST_PARTS, slice_rows=100).collect())
    assert full == want == sorted(tuple(r) for r in vectors.search(both.selectExpr("*", "1 AS part", "2 AS id", "3 AS rank", "4 AS score"), ask, exact=True).collect())
    some = {tuple(r)[::2] for r in vectors.search(both, ask).collect()}
    assert len(some & {r[::2] for r in want}) >= 0.9 * len(want)
    near = vectors.fit(both, vec_id="vec_id", embedding="embedding")
    assert near.recall >= vectors.RECALL and near.probes <= near.w.shape[1]
    few = vectors.search(both.limit(3), both.limit(3)).collect()
    assert len(few) == 6
    assert vectors.search(both.where("false"), ask).count() == 0
    assert vectors.search(both, ask.where("false")).count() == 0


def test_vectors_recall(spark):
    """Every query of a larger table against brute force; and parts that vectors with clusters do not have to read."""
    sf = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    asked = np.flatnonzero(ids % 50 == 0)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -9
    want = {(int(ids[q]), int(ids[i])) for q, row in zip(asked, np.argsort(-s, axis=1, kind="stable")[:, :5], strict=True) for i in row}
    got = {(r["query_id"], r["vec_id"]) for r in vectors.op6_nearest(spark, sf).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 16))
    rows = [(i, (centre[i % 40] + 0.1 * rng.normal(size=16)).tolist()) for i in range(4000)]
    router = vectors.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), vec_id="vec_id", embedding="embedding")
    assert router.recall >= vectors.RECALL and router.probes <= router.w.shape[1] // 4


def test_pipeline(spark, docs, no_docs, rows, tmp_path, sf):
    from mnemolake.llm import language, pieces

    import public_tokenizers

    sf_dir = f"file://{tmp_path}"
    # columns whose names the operators use themselves go through all stages
    more = ["score", "id", "n_words", "label", "key"]
    real = spark.read.parquet(f"{sf}/documents.parquet").select("*", *(F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in more))
    odd = docs.where("doc_id IS NULL OR doc_id <> 22").select(F.when(F.col("doc_id").isNotNull(), F.col("doc_id") + 1_000_000).alias("doc_id"), "text", "lang", "source", "n_chars", *more)
    real.select("doc_id", "text", "lang", "source", "n_chars", *more).union(odd).union(real.where("doc_id = 5")).write.parquet(f"{sf_dir}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{sf_dir}/benchmark.parquet")
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()), key=key)

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labeller = language.Labeller(language.fit(d), language.SWITCH)
    left = [(r["doc_id"], r["text"]) for r in d.collect()]
    lang = labeller.batch([(t or "").encode() for _, t in left])
    left = [x for x, (name, score, _) in zip(left, lang, strict=True) if name != "und" and score >= language.MIN_SCORE]
    comp = brute_components(left, 5)
    seen, kept = set(), []
    for x, c in zip(left, comp, strict=True):
        if c[3] and (x[0] is None or x not in seen):
            kept.append(x)
            seen.add(x)
    cut = []
    for (i, t), (_, _, _, spans) in zip(kept, brute_repeats([t for _, t in kept], corpus_pipeline.PASSAGE_BYTES), strict=True):
        raw, out, last = (t or "").encode(), b"", 0
        for s, e in spans:
            if e - s < 400 and len(raw[s:e].split()) <= 50:
                continue
            while s < e and raw[s] & 0xC0 == 0x80:
                s += 1
            while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
                e -= 1
            out, last = out + raw[last:s], e
        cut.append((i, (out + raw[last:]).decode()))
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = word.findall(lower(r["text"]))
        windows |= {tuple(w[i : i + 13]) for i in range(max(len(w) - 12, min(len(w), 1)))}
    clean = []
    for i, t in cut:
        w = word.findall(lower(t))
        hit = {j for n in {len(x) for x in windows} for a in range(len(w) - n + 1) if tuple(w[a : a + n]) in windows for j in range(a, a + n)}
        if not hit or 20 * len(hit) < len(w):
            clean.append((i, t))
    codec = pieces.Codec(pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model")))
    import zlib

    want = []
    for i, t in clean:
        ids = codec.encode(t)
        want.append((i, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(t.encode()).hexdigest(), True))
    assert got == sorted(want, key=key)
    assert len(clean) < len(cut) and len(kept) < len(left) < d.count()
    empty = f"{sf_dir}/none"
    d.where("false").write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").where("false").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0

import re
import zlib
from collections import Counter

import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemolake.llm import common
from mnemolake.llm import decontaminate as dec
from mnemolake.llm import language, licenses, pieces, token_counts, token_file, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def sql(docs, **tables):
    """DuckDB over these tables."""
    con = oracle.duck("/nowhere")
    for name, df in {"documents": docs, **tables}.items():
        con.register(name, df.toArrow())
    return con


@pytest.mark.parametrize("broadcast_words", [dec.BROADCAST_WORDS, 0])
def test_decontaminate(spark, docs, no_docs, rows, broadcast_words):
    a, b = WORD.findall(lower(rows[3][1])), WORD.findall(lower(rows[2][1]))
    items = [(1, " ".join(a[5:30])), (2, " ".join(b[:13])), (3, " ".join(a[40:47])), (4, ""), (5, None), (None, " ".join(b[50:70])), (6, "ha " * 20), (1, " ".join(b[90:120])), (7, "zz yy xx")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dec.decontaminate(docs, bench, keep=["doc_id"], broadcast_words=broadcast_words)
    got = got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
    assert oracle.compare(got, sql(docs, benchmark=bench), dec.ORACLE) == ""
    assert dec.decontaminate(no_docs, bench, keep=["doc_id"], broadcast_words=broadcast_words).count() == 0
    assert dec.decontaminate(docs, bench.where("false"), keep=["doc_id"], broadcast_words=broadcast_words).where("n_hit > 0").count() == 0
    whole = dec.decontaminate(docs, bench, keep=["doc_id", "n_words", "key"], prefix="p_", broadcast_words=broadcast_words)
    assert whole.columns == ["doc_id", "n_words", "key", "p_n_words", "p_n_hit", "p_hit_spans", "p_items", "p_contaminated"] and whole.where("n_words <> 3").count() == 0


@given(st.lists(st.lists(st.sampled_from(b"abc"), max_size=40), max_size=6), st.lists(st.lists(st.sampled_from(b"abc"), max_size=60), min_size=1, max_size=5), st.integers(1, 1000))
@settings(max_examples=150, deadline=None)
def test_index_is_exact(items, texts, pairs):
    """Few words, so grams are frequent and hits overlap; against all windows."""
    items, texts = ([[bytes([c]) for c in x] for x in xs] for xs in (items, texts))
    names: dict = {}
    for i, x in enumerate(items):
        if x:
            names.setdefault(tuple(x), set()).add(str(i))
    dec._PAIRS, before = pairs, dec._PAIRS
    index = dec.Index(names, 6, 3)
    found = index.scan(texts)
    dec._PAIRS = before
    for d, t in enumerate(texts):
        hit, who = set(), set()
        for x in names:
            m = min(len(x), 6)
            windows = {x[i : i + m] for i in range(len(x) - m + 1)}
            for s in range(len(t) - m + 1):
                if tuple(t[s : s + m]) in windows:
                    hit |= set(range(s, s + m))
                    who |= names[x]
        spans, ids = found.get(d, ([], set()))
        assert {w for s, e in dec.merged(spans) for w in range(s, e)} == hit
        assert {n for i in ids for n in index.names[i]} == who


def test_licenses(spark, docs, no_docs):
    got = licenses.scan(docs, keep=["doc_id"]).withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
    assert oracle.compare(got, sql(docs), licenses.ORACLE) == ""
    row = got.where("doc_id = 49").first()
    assert (row["n_base"], row["base_labels"], row["labels"]) == (4, "apache-2,cc-by-nc,mit", "apache-2,cc-by-nc,gpl-3,mit")
    assert licenses.scan(no_docs, keep=["doc_id"]).count() == 0


def test_licenses_across_lines(spark):
    """A template stands whole in the text, wherever lines break; also one longer than the usual block."""
    import textwrap

    long = (" ".join(f"w{i}" for i in range(150)), "long")
    templates = [*licenses.TEMPLATES, long]
    rows, want = [], {}
    for i, (template, label) in enumerate(templates):
        for width in (20, 72):
            for before in (0, 7, 40, 75):
                wrapped = "\n * ".join(textwrap.wrap("x " * before + template + " y" * 90, width))
                rows.append((len(rows), wrapped))
                want[len(rows) - 1] = label
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    usual = licenses.scan(docs, keep=["doc_id"]).withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
    assert oracle.compare(usual, sql(docs), licenses.ORACLE) == ""  # the SQL finds wrapped templates too
    got = licenses.scan(docs, keep=["doc_id"], templates=templates).collect()
    assert len(got) == len(rows)
    assert [r["doc_id"] for r in got if want[r["doc_id"]] not in r["labels"] or r["score"] != 1.0] == []
    # nothing that a line alone gives is lost: its words are scattered over the line's first block
    scattered = " ".join(f"{w} q q" for w in "released under the mit license".split())
    split = spark.createDataFrame([("z " * 60 + "\n" + scattered,)], "text string")
    assert licenses.scan(split).first()["labels"] == ["mit"]


def test_license_filters_reject_before_counting():
    # words by frequency: a b c d e f g h i j (rarest first); 0.9 of ten are nine
    letters = "abcdefghij"
    m = licenses.Matcher([(" ".join(letters), "x"), ("a z", "y")], {w: i for i, w in enumerate(letters)} | {"z": 99}, 0.9, 64, 32)
    words_of = lambda text: {w.encode() for w in text}
    assert {c[0] for c in m.candidates(words_of(letters))} == {"x", "y"}
    assert [c[0] for c in m.candidates(words_of("bcdefghij"))] == ["x"]
    assert not list(m.candidates(words_of("bcdefghi")))  # nine words are needed from b on, eight are there
    assert not list(m.candidates(words_of("cdefghij")))  # no word of a prefix
    assert {c[0] for c in m.candidates(words_of("az"))} == {"y"}


@given(st.lists(st.integers(0, 2**32 - 1), max_size=2000))
@settings(max_examples=30, deadline=None)
def test_blocks_round_trip(ids):
    assert token_file.decode_ids(token_file.encode_ids(np.array(ids, np.uint32))).tolist() == ids


def test_blocks_patch_exceptions():
    ids = np.r_[np.arange(300) % 7, [4_000_000_000], np.arange(300)].astype(np.uint32)
    data = token_file.encode_ids(ids)
    assert token_file.decode_ids(data).tolist() == ids.tolist() and len(data) < 4 * len(ids) // 2


@pytest.mark.parametrize("segment", [token_file.SEGMENT, 300])
def test_token_file(spark, docs, no_docs, rows, segment, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    extra = [(60, "It's 'S don't <|endoftext|> <|ENDOFTEXT|> a.b.c e... ½. …. «x». ١. é. \x1c \x85 x y")]
    with_extra = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    folder = f"file://{tmp_path}/t"
    segments = token_file.write_tokens(with_extra, folder, path, segment=segment)
    got = [(r["doc_id"], r["ids"]) for r in token_file.read_tokens(spark, folder).orderBy("part", "seg", "at").collect()]
    tk = Tokenizer.from_file(path)
    place = {t: h for t, h in spark.createDataFrame([(t or "",) for _, t in rows + extra], "t string").select("t", F.xxhash64("t")).collect()}
    want = [(d, tk.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in sorted(rows + extra, key=lambda r: (r[0] is not None, r[0] or 0, place[r[1] or ""]))]
    assert got == want
    assert segments.agg({"n_ids": "sum"}).first()[0] == sum(len(i) for _, i in want)
    assert token_file.write_tokens(no_docs, folder + "0", path).count() == 0


def test_token_query(spark, sf):
    """Every column against the library, document by document."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = tk.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in token_file.op3_token_file(spark, sf).orderBy("doc_id").collect()] == want


def test_token_ranges_split_one_id(spark, tmp_path):
    """One id, or none, may hold all rows: they are still dealt out, and each comes back once."""
    import public_tokenizers

    docs = spark.createDataFrame([(7 if i % 2 else None, f"text {i % 40}") for i in range(2000)], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are read as one part
    try:
        index = token_file.write_tokens(docs, f"file://{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.select("part").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = token_file.read_tokens(spark, f"file://{tmp_path}/t").orderBy("part", "seg", "at").collect()
    assert [r["doc_id"] for r in got] == [None] * 1000 + [7] * 1000
    assert sorted(Counter(tuple(r["ids"]) for r in got).values()) == [50] * 40


def test_rollup(spark, docs, no_docs, tmp_path):
    store = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    one = token_counts.counted(docs, "words-1")
    assert store.commit("a", one) and not store.commit("a", one)
    first = oracle.rows_of(store.totals().columns, store.totals().collect())
    store.commit("b", token_counts.counted(docs.where("doc_id = 3"), "words-2", op="revise"))
    store.commit("c", token_counts.counted(docs.where("doc_id = 3"), "words-1", op="revise"))
    assert oracle.rows_of(store.totals().columns, store.totals().collect()) == first
    store.commit("d", token_counts.counted(docs.where("doc_id IS NOT NULL"), "words-1", op="delete"))
    assert store.totals().count() == 0
    store.commit("e", token_counts.counted(no_docs, "words-1"))
    store.commit("f", one)
    assert store.compact("g") and not store.compact("g")
    assert store.batches() == ["g"] and oracle.rows_of(store.totals().columns, store.totals().collect()) == first
    assert not store.commit("a", one) and not store.commit("g", one) and store.totals().count() == len(first)
    with pytest.raises(ValueError):
        store.commit("../x", one)


def test_rollup_in_one_batch(spark, tmp_path):
    store = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    change = lambda *rows: spark.createDataFrame(list(rows), "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long")
    total = lambda: {(r["source"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in store.totals().collect()}
    store.commit("a", change(("insert", 1, "s", "en", "t", 5), ("insert", 1, "s", "en", "t", 5), ("insert", 2, None, None, "t", None), (None, 3, "s", "en", "t", 9), ("insert", None, "s", "en", "t", 9)))
    assert total() == {("s", "t"): (2, 10), (None, "t"): (1, 0)}
    # of two revisions under one tokenizer the larger counts; each tokenizer has its own
    store.commit("b", change(("revise", 1, "s", "en", "t", 3), ("revise", 1, "u", "en", "t", 4), ("revise", 1, "s", "en", "v", 2), ("revise", 7, "w", "en", "t", 1)))
    assert total() == {("u", "t"): (1, 4), ("s", "v"): (1, 2), (None, "t"): (1, 0), ("w", "t"): (1, 1)}
    # a deletion takes what was committed before its batch; the insert beside it stays
    store.commit("c", change(("delete", 1, None, None, None, None), ("insert", 1, "s", "en", "t", 8), ("delete", 99, None, None, None, None)))
    assert total() == {("s", "t"): (1, 8), (None, "t"): (1, 0), ("w", "t"): (1, 1)}


def test_rollup_survives_a_stop(spark, docs, tmp_path):
    """A driver lost between any two steps leaves the old state or the new one, and replays change neither."""
    path = f"file://{tmp_path}/r"

    class Lost(Exception):
        pass

    class Stopping(token_counts.Rollup):
        def __init__(self, at):
            super().__init__(spark, path)
            self.at = at

        def _write(self, entries):
            out = super()._write(entries)
            if self.at == "written":
                raise Lost
            return out

        def _drop(self, folder):
            if self.at == "published":
                raise Lost
            super()._drop(folder)

    one = token_counts.counted(docs, "words-1")
    with pytest.raises(Lost):
        Stopping("written").commit("a", one)
    store = token_counts.Rollup(spark, path)
    assert store.batches() == [] and store.totals().count() == 0
    assert store.commit("a", one) and store.commit("b", one)
    state = lambda: oracle.rows_of(store.totals().columns, store.totals().collect())
    first = state()
    with pytest.raises(Lost):
        Stopping("written").compact("c")
    assert store.batches() == ["a", "b"] and state() == first
    with pytest.raises(Lost):
        Stopping("published").compact("c")
    assert store.batches() == ["c"] and state() == first
    assert not store.commit("a", one) and not store.commit("c", one) and state() == first
    assert store.commit("d", one.where("false")) and store.compact("e")
    assert store.batches() == ["e"] and state() == first and not store.commit("b", one)
    late = token_counts.Rollup(spark, path)
    assert not late._publish("e", "another", []) and late.batches() == ["e"]


def test_a_commit_during_compaction_counts_once(spark, tmp_path):
    path, schema = f"file://{tmp_path}/r", "doc_id long, text string, source string, lang string"
    store, other = token_counts.Rollup(spark, path), token_counts.Rollup(spark, path)
    docs = lambda rows: token_counts.counted(spark.createDataFrame(rows, schema), "words-1")
    store.commit("a", docs([(1, "one two", "s", "en")]))
    read = store._read

    def late(kind, schema, *given):
        other.commit("b", docs([(2, "three", "s", "en")]))
        return read(kind, schema, *given)

    store._read = late
    assert store.compact("c")
    want = [("s", "en", "words-1", 2, 3)]
    assert [tuple(r) for r in other.totals().collect()] == want
    assert other.compact("d") and [tuple(r) for r in other.totals().collect()] == want


def test_rollup_reads_touched_buckets(spark, tmp_path):
    store = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    docs = spark.range(2000).selectExpr("id AS doc_id", "'a b' AS text", "'s' AS source", "'en' AS lang")
    store.commit("a", token_counts.counted(docs, "words-1"))
    home = docs.where("doc_id = 5").select(token_counts._bucket()).first()[0]
    for f in tmp_path.glob("r/data/*/entries/bucket=*/*.parquet"):
        if f.parent.name != f"bucket={home}":
            f.write_bytes(b"must not be read")
    for f in tmp_path.glob("r/data/*/entries/bucket=*/.*.crc"):
        f.unlink()
    assert store.commit("b", token_counts.counted(docs.where("doc_id = 5"), "words-1", op="delete"))
    assert store.totals().first()["n_docs"] == 1999


def test_pieces(spark, docs, no_docs, rows):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    p = pieces.Pieces(path)
    codec = pieces.Codec(p)

    def brute(s):
        best, back = [0.0], [0]
        for i in range(1, len(s) + 1):
            options = [(best[i - k] + p.score.get(s[i - k : i], p.unknown if k == 1 else -np.inf), -k) for k in range(1, min(i, p.longest) + 1)]
            score, k = max(options)
            best.append(score)
            back.append(i + k)
        return p._ids(s, back, len(s))

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for _, t in rows + [(0, "  two  spaces\n\nhéllo 漢\t▁ " + "x" * 500)]:
        t = t or ""
        ids = codec.encode(t).tolist()
        marked = pieces.MARK + t.replace(" ", pieces.MARK) if t else ""
        assert [i for part in p.stream(marked) for i in part] == ids
        if len(t) < 5000:
            assert ids == (brute(marked) if t else [])
        assert codec.decode(ids) == library.decode(ids) == t.replace(pieces.MARK, " ")
    window = max(len(part) for part in p.stream(pieces.MARK + rows[-2][1].replace(" ", pieces.MARK)))
    assert window < 200  # ids leave the window all along
    both = pieces.decode(pieces.encode(docs, path, keep=["doc_id", "text"]), path, keep=["doc_id", "text"])
    assert both.where("decoded <> coalesce(text, '')").count() == 0
    assert pieces.round_trip(docs, path).where("NOT exact").count() == 0
    assert pieces.encode(no_docs, path).count() == 0


@given(st.lists(st.text(st.sampled_from("ab e\u2581\té漢\U0001f600the"), max_size=80), max_size=8), st.integers(1, 9), st.integers(1, 30), st.integers(1, 5), st.integers(1, 70))
@settings(max_examples=150, deadline=None)
def test_slices_side_by_side_and_streams_agree(texts, chunk, group, side, long):
    """However a text is cut, and whichever way its runs are taken, the ids are those of one pass over all of it."""
    import public_tokenizers

    codec = pieces.codec_of(public_tokenizers.path("piece_bpe_32k.model"))
    want = [[i for part in codec.pieces.stream(pieces.MARK + t.replace(" ", pieces.MARK)) for i in part] if t else [] for t in texts]
    before = pieces.CHUNK, pieces.GROUP, pieces.SIDE, pieces.LONG
    pieces.CHUNK, pieces.GROUP, pieces.SIDE, pieces.LONG = chunk, group, side, long
    try:
        codec.clear()
        got, shown = [[] for _ in texts], ["" for _ in texts]
        for i, ids in codec.parts(texts):
            shown[i] += codec.decode(ids, first=not got[i])
            got[i] += ids.tolist()
    finally:
        pieces.CHUNK, pieces.GROUP, pieces.SIDE, pieces.LONG = before
    assert got == want and shown == [t.replace(pieces.MARK, " ") for t in texts]


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.normal(size=(rng.integers(1, 7), 3)) * 3

        def value(path, s=s):
            return sum(s[i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path[:-1], path[1:]))

        import itertools

        best = max(value(p) for p in itertools.product(range(3), repeat=len(s)))
        assert abs(value(language.viterbi(s, 2.0).tolist()) - best) < 1e-9


def test_viterbi_of_two_languages_over_a_third():
    """One switch between two languages beats the third, though neither gains a switch over it alone."""
    assert language.viterbi(np.array([[0.0, -20.0, -8.0], [-20.0, 0.0, -8.0]]), 12.0).tolist() == [0, 1]
    assert language.viterbi(np.array([[0.0, -10.0, -5.0], [-10.0, 0.0, -5.0]]), 12.0).tolist() in ([0, 0], [1, 1], [2, 2])
    assert language.viterbi(np.array([[0.0, -20.0, -8.0], [-9.0, -9.0, 0.0], [-20.0, 0.0, -8.0]]), 7.0).tolist() == [0, 2, 1]


def test_language(spark, docs, no_docs):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.op10_language(spark, "/root/testdata/sf0.01").join(d, "doc_id")
    assert got.where("held_out AND lang_pred = lang").count() >= 0.98 * got.where("held_out").count()
    model = language.fit(d)
    rows = {r["doc_id"]: r for r in language.identify(docs, model, keep=["doc_id", "score"]).collect()}
    assert rows[40]["lang_pred"] == rows[41]["lang_pred"] == rows[47]["lang_pred"] == "und" and rows[47]["score"] == 0
    assert language.identify(no_docs, model).count() == 0
    none = language.fit(no_docs)
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}
    en, fr = (d.where(f"lang = '{x}'").orderBy("doc_id").first()["text"].replace("\n", " ") for x in ("en", "fr"))
    mixed = language.identify(spark.createDataFrame([(en + " " + fr,)], "text string"), model).first()
    assert [s["lang"] for s in mixed["spans"]] == ["en", "fr"]


def test_risk_is_the_formula():
    """Against the risk written out text by text, and its slope by differences; both signs of the unlabelled part occur."""
    rng, signs = np.random.default_rng(4), set()
    for _ in range(40):
        k, prior = 4, float(rng.uniform(0.05, 0.9))
        rows = [np.flatnonzero(rng.random(k) < 0.5) for _ in range(30)]
        positive = rng.random(30) < 0.4
        w = rng.normal(size=k + 1) * 2

        def parts(w, rows=rows, positive=positive, prior=prior):
            score = [1 / (1 + np.exp(-(w[-1] + sum(w[j] for j in r)))) for r in rows]
            p, u = [s for s, y in zip(score, positive, strict=True) if y], [s for s, y in zip(score, positive, strict=True) if not y]
            return prior * np.mean([-np.log(s) for s in p]), np.mean([-np.log(1 - s) for s in u]) - prior * np.mean([-np.log(1 - s) for s in p])

        first, rest = parts(w)
        value, grad = toxicity.risk(w, rows, positive, prior)
        assert abs(value - (first + max(0.0, rest))) < 1e-9
        goal = (lambda w: -parts(w)[1]) if rest < 0 else (lambda w: sum(parts(w)))
        slope = [(goal(w + d) - goal(w - d)) / 2e-6 for d in 1e-6 * np.eye(k + 1)]
        assert np.allclose(grad, slope, atol=1e-5)
        signs.add(rest < 0)
    assert signs == {True, False}


def test_language_query_is_its_parts(spark, docs, tmp_path):
    """op10 against counts of n-grams, word scores and the dynamic program written out in plain Python."""
    sf_dir = f"file://{tmp_path}"
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").where("length(text) < 4000")
    odd = docs.where("(doc_id IS NULL OR doc_id <> 22) AND coalesce(length(text), 0) < 4000").select(F.col("doc_id") + 10_000_000, "text", "lang")
    real.union(odd).write.parquet(f"{sf_dir}/documents.parquet")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1

    def grams(w):
        s = f"^{w.lower()}$"
        for n in language.GRAMS:
            for i in range(len(s) - n + 1):
                h = 0
                for ch in s[i : i + n]:
                    h = (h * 1_000_003 + ord(ch)) % 2**32
                h = (h + n) % 2**32
                yield (((h ^ h >> 15) * 0x9E3779B1) % 2**32) >> 16

    def scripts(s):
        return [next((name for a, b, name in language.SCRIPTS if a <= ord(c) <= b), "other") for c in s]

    langs = sorted({r["lang"] for r in d if r["lang"] is not None and r["text"] is not None and not out_of(r["doc_id"])})
    gram, seen = {k: Counter() for k in langs}, {k: Counter() for k in langs}
    for r in d:
        if r["lang"] in langs and r["text"] is not None and not out_of(r["doc_id"]):
            for w in WORD.findall(lower(r["text"])):
                gram[r["lang"]].update(grams(w))
                seen[r["lang"]].update(scripts(c for c in w.lower() if c.isalpha()))
    total = {k: sum(gram[k].values()) + 0.2 * language.BUCKETS for k in langs}
    allowed = {s: [k for k in langs if seen[k][s] >= language.SHARE * sum(seen[k].values())] for s in {s for k in langs for s in seen[k]}}
    known: dict = {}

    def score(w):
        if w not in known:
            letters, low = sum(c.isalpha() for c in w.lower()), w.lower()
            gs = list(grams(w))
            v = {k: sum(np.log((gram[k][g] + 0.2) / total[k]) for g in gs) / len(gs) * 2 * letters**0.5 for k in langs}
            name = "latin" if max(low) < "\u0250" else Counter(scripts(c for c in low if c.isalpha() or c > "\u024f")).most_common(1)[0][0]
            few = allowed.get(name) or langs
            known[w] = {k: v[k] - max(v.values()) - (4 * language.SWITCH if letters and k not in few else 0) for k in langs}, letters
        return known[w]

    def label(text):
        ws = [score(w) for w in WORD.findall(lower(text))]
        if not sum(n for _, n in ws):
            return "und", 0.0
        best = {k: (ws[0][0][k], [k]) for k in langs}
        for v, _ in ws[1:]:
            top = max(langs, key=lambda k: best[k][0])
            best = {k: (max(best[k][0], best[top][0] - language.SWITCH) + v[k], (best[k][1] if best[k][0] >= best[top][0] - language.SWITCH else best[top][1]) + [k]) for k in langs}
        path = max(best.values(), key=lambda x: x[0])[1]
        share = {k: sum(n for x, (_, n) in zip(path, ws, strict=True) if x == k) for k in langs}
        first = max(langs, key=lambda k: share[k])
        mine = [(v, n) for x, (v, n) in zip(path, ws, strict=True) if x == first]
        sure = sum(n * np.exp(v[first]) / sum(np.exp(v[k]) for k in langs) for v, n in mine) / share[first]
        return first, min(1.0, share[first] / sum(n for _, n in ws) * sure)

    got = {(r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 6)) for r in language.op10_language(spark, sf_dir).collect()}
    want = {(r["doc_id"], out_of(r["doc_id"]), x, round(float(s), 6)) for r in d for x, s in [label(r["text"])]}
    assert len(langs) == 4 and got == want


def test_toxicity_query_is_its_parts(spark, docs, tmp_path):
    """op7 against the features, choice and scores computed text by text in plain Python."""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = docs.where("doc_id IS NULL OR doc_id <> 22").select(F.col("doc_id") + 10_000_000, "text")
    sf_dir = f"file://{tmp_path}"
    real.union(odd).write.parquet(f"{sf_dir}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (3, None), (4, 1), (4, 0)], "doc_id long, toxic long")).write.parquet(f"{sf_dir}/labels.parquet")
    d = [(r[0], r[1] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    label: dict = {}
    for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect():
        if r["doc_id"] is not None and r["toxic"] is not None and not out_of(r["doc_id"]):
            label[r["doc_id"]] = max(label.get(r["doc_id"], 0), int(r["toxic"]))
    words = {i: {f for w in set(WORD.findall(lower(t))) for f in toxicity.word_features(w.encode())} for i, (_, t) in enumerate(d)}
    learn = [i for i, (k, _) in enumerate(d) if k is not None and not out_of(k)]  # the samples hold all: fewer rows than their bounds
    rows = [(1, words[i]) for i in learn if label.get(d[i][0]) == 1] + [(0, words[i]) for i in learn]
    n_p, n_u = sum(y for y, _ in rows), len(learn)
    p, u = Counter(f for y, fs in rows if y for f in fs), Counter(f for y, fs in rows if not y for f in fs)
    keep = set()
    for f in p:
        a, b, rate = p[f] / n_p, u[f] / n_u, (p[f] + u[f] + 1) / (n_p + n_u + 2)
        if p[f] >= toxicity.LEAST and (a - b) / (rate * (1 - rate) * (1 / n_p + 1 / n_u)) ** 0.5 > toxicity.Z and a > toxicity.RATIO * b:
            keep.add(f)
    real_labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~common.part("doc_id", 4, 2))
    docs_in = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs_in.where(~common.part("doc_id", 4, 2)), real_labels)
    assert set(model.weight) == keep and keep
    got = sorted(tuple(r) for r in toxicity.op7_toxicity(spark, sf_dir).select(F.coalesce("doc_id", F.lit(-99)), "held_out", "predicted").collect())
    again = lambda fs: 1 / (1 + np.exp(-(model.bias + sum(model.weight[f] for f in sorted(fs & keep)))))
    want = sorted((-99 if k is None else k, out_of(k), int(again(words[i]) >= 0.3)) for i, (k, _) in enumerate(d))
    assert [g[:2] for g in got] == [x[:2] for x in want] and sum(g != x for g, x in zip(got, want, strict=True)) == 0


def test_toxicity(spark, docs, no_docs):
    rng = np.random.default_rng(1)
    # feature 1 marks toxic texts; a tenth of the unlabelled ones are toxic
    noise = lambda: rng.choice(np.arange(10, 400), 30, replace=False)
    make = lambda toxic: np.unique(np.append(noise(), 1) if toxic else noise()).astype(np.uint32)
    truth = np.r_[np.ones(200, bool), rng.random(3000) < 0.1]
    texts, positive = [make(t) for t in truth], np.arange(len(truth)) < 200
    sample = spark.createDataFrame([(int(p), f.tolist()) for p, f in zip(positive, texts, strict=True)], "y int, f array<long>")
    assert [r["f"] for r in toxicity.chosen(sample, 200, 3000).collect()] == [1]
    model = toxicity.train(np.array([1]), [np.flatnonzero(f == 1)[:1] * 0 for f in texts], positive, 0.1)
    assert list(model.weight) == [1]
    assert model.score([1]) > 0.6 and model.score([]) < 0.2
    d, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.op7_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").toPandas()
    s, y = got["score"].to_numpy(), got["toxic"].to_numpy() == 1
    assert (s[y][:, None] > s[~y][None]).mean() + (s[y][:, None] == s[~y][None]).mean() / 2 > 0.9
    model = toxicity.fit(d, labels)
    assert toxicity.score(docs, model, keep=["doc_id", "score"]).count() == docs.count()
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.fit(no_docs, labels).empty and {r["score"] for r in toxicity.score(docs, toxicity.fit(d, labels.where("false"))).collect()} == {0.0}

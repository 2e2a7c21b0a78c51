"""Language identification of mixed text: script ranges, then Viterbi over words.

Training takes about ROWS_PER_LANG labelled texts of each language (those whose hash lies under a limit that follows
from the language's count) and about ROWS in all, the documented bounds. Executors count the character n-grams and the
letters by script of their words; the driver receives the sums, at most BUCKETS numbers and the scripts for a language,
however long the texts are. A word's score for a language is its mean n-gram log probability times a weight that grows with its length. The scripts of
a word's letters narrow its candidates to the languages that were seen with that script; a script that no language was
seen with rules out none. Viterbi over the words, with SWITCH paid for every change of language, labels spans. The
text's language is the one whose spans hold most letters; the score is that share of letters, times the model's mean
confidence in the spans.

Two facts make it fast and keep it exact. A word's scores are computed once per worker. And no path with a change can
beat the best single language when no run of words gains more than SWITCH over it in any language, and when the best
gains of a first and of a last run are together within SWITCH: a path of n runs pays n - 1 changes, one for each run
between the first and the last, and one for those two. So the dynamic program runs only where a change may pay.

Defined cases: null, empty or letterless text is `und`, score 0, without spans; without training rows everything with
letters is `und` too; ties go to the language first in sorted order; repeated rows are labelled each for itself; kept columns
whose names the new ones take are replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, flat_batches, map_batches, part, texts, tune, words

ROWS_PER_LANG, ROWS, GRAMS, BUCKETS, SWITCH, SHARE, CACHE, MIN_SCORE = 1500, 30_000, (1, 2, 3, 4), 1 << 16, 12.0, 0.001, 400_000, 0.2

#: Unicode ranges of scripts (first, last, name).
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0750, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0A00, 0x0A7F, "gurmukhi"), (0x0A80, 0x0AFF, "gujarati"), (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"), (0x0C80, 0x0CFF, "kannada"),
    (0x0D00, 0x0D7F, "malayalam"), (0x0E00, 0x0E7F, "thai"), (0x0E80, 0x0EFF, "lao"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x309F, "hiragana"), (0x30A0, 0x30FF, "katakana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
]


def script(ch: str) -> str:
    c = ord(ch)
    return next((name for a, b, name in SCRIPTS if a <= c <= b), "other")


def _grams(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words with their borders, and the word of each."""
    flat = np.frombuffer(("^" + "$^".join(strings) + "$").encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter(map(len, strings), np.int64, len(strings)) + 2
    word, end = np.repeat(np.arange(len(strings)), size), np.repeat(np.cumsum(size), size)
    at, out, of = np.arange(len(flat)), [], []
    h = np.zeros(len(flat), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(flat) - n + 1] * np.uint32(1_000_003) + flat[n - 1 :]
        if n in GRAMS:
            ok = at[: len(h)] + n <= end[: len(h)]
            x = h[ok] + np.uint32(n)
            out.append(((x ^ x >> np.uint32(15)) * np.uint32(0x9E3779B1)) >> np.uint32(16))
            of.append(word[: len(h)][ok])
    return np.concatenate(out).astype(np.int64), np.concatenate(of)


def tally(new: list[bytes], times: list[int]) -> tuple[np.ndarray, dict[str, int]]:
    """How often each bucket of n-grams and the letters of each script occur in words that occur so many times."""
    strings, n = [w.decode(errors="replace").lower() for w in new], np.array(times, np.int64)
    counts = np.zeros(BUCKETS, np.int64)
    if strings:
        bucket, word = _grams(strings)
        counts += np.bincount(bucket, n[word], BUCKETS).astype(np.int64)
    seen: Counter = Counter()
    for s, m in zip(strings, times, strict=True):
        for ch in s:
            if ch.isalpha():
                seen[script(ch)] += m
    return counts, dict(seen)


class Model:
    """langs, log probabilities (buckets x languages), the languages seen with each script."""

    def __init__(self, counted: dict[str, tuple[np.ndarray, dict[str, int]]]):
        """counted: the tally of each language."""
        self.langs, self.name = sorted(counted), uuid.uuid4().hex
        counts = np.full((BUCKETS, len(self.langs)), 0.2)
        seen: dict[str, dict[int, int]] = defaultdict(dict)
        for k, lang in enumerate(self.langs):
            counts[:, k] += counted[lang][0]
            for s, m in counted[lang][1].items():
                seen[s][k] = m
        self.logp = np.log(counts / counts.sum(axis=0)) if self.langs else counts
        total: dict[int, int] = defaultdict(int)
        for by in seen.values():
            for k, m in by.items():
                total[k] += m
        self.scripts = {s: sorted(k for k, m in by.items() if m >= SHARE * total[k]) for s, by in seen.items()}

    def scores(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: a score by language (0 is the best) and its letters. What the script rules out loses far more than a switch."""
        strings = [w.decode(errors="replace").lower() for w in new]
        letters = np.array([len(s) if s.isalpha() else sum(map(str.isalpha, s)) for s in strings], np.int64)
        if not self.langs:
            return np.zeros((len(new), 0)), letters
        bucket, word = _grams(strings)
        n = np.bincount(word, minlength=len(new))
        v = np.stack([np.bincount(word, column[bucket], len(new)) / n for column in self.logp.T], axis=1) * (2 * np.sqrt(letters))[:, None]
        v -= v.max(axis=1, keepdims=True)
        for i, s in enumerate(strings):
            name = "latin" if max(s) < "\u0250" else Counter(script(ch) for ch in s if ch.isalpha() or ch > "\u024f").most_common(1)[0][0]
            allowed = self.scripts.get(name)
            if allowed and letters[i] and len(allowed) < len(self.langs):
                v[i, [k for k in range(v.shape[1]) if k not in allowed]] -= 4 * SWITCH
        return v, letters


def viterbi(s: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word; s: words x languages."""
    n, k = s.shape
    total = s.sum(axis=0)
    best = int(np.argmax(total))
    c = np.concatenate([np.zeros((1, k)), np.cumsum(s - s[:, best : best + 1], axis=0)])
    if (c - np.minimum.accumulate(c, axis=0)).max() <= switch and c.max() + (c[-1] - c.min(axis=0)).max() <= switch:
        return np.full(n, best)
    back, row = np.empty((n, k), np.int64), s[0].tolist()
    for i, x in enumerate(s[1:].tolist(), 1):
        top = max(range(k), key=row.__getitem__)
        away = row[top] - switch
        back[i] = [j if row[j] >= away else top for j in range(k)]
        row = [(row[j] if row[j] >= away else away) + x[j] for j in range(k)]
    out, j = np.empty(n, np.int64), max(range(k), key=row.__getitem__)
    for i in range(n - 1, -1, -1):
        out[i] = j
        j = back[i, j] if i else j
    return out


class Labeller:
    """Keeps the scores of the words that its task has seen."""

    def __init__(self, model: Model, switch: float):
        self.model, self.switch = model, switch
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.rows, self.letters = np.zeros((1024, len(self.model.langs))), np.zeros(1024, np.int64)

    def learn(self, split: list[list[bytes]]) -> None:
        new = list(set(chain.from_iterable(split)).difference(self.known))
        if len(self.known) + len(new) > CACHE and self.known:
            self.reset()
            new = list(set(chain.from_iterable(split)))
        if new:
            n = len(self.known)
            if n + len(new) > len(self.rows):
                grow = max(2 * len(self.rows), n + len(new)) - len(self.rows)
                self.rows = np.concatenate([self.rows, np.zeros((grow, self.rows.shape[1]))])
                self.letters = np.concatenate([self.letters, np.zeros(grow, np.int64)])
            self.rows[n : n + len(new)], self.letters[n : n + len(new)] = self.model.scores(new)
            self.known.update(zip(new, range(n, n + len(new)), strict=True))

    def batch(self, raw: list[bytes]) -> list[tuple[str, float, list[dict]]]:
        """Language, score and spans of words (end excluded) of each text."""
        split = [words(t) for t in raw]
        self.learn(split)
        return [self.label(ws) for ws in split]

    def label(self, ws: list[bytes]) -> tuple[str, float, list[dict]]:
        langs = self.model.langs
        idx = np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))
        letters = self.letters[idx]
        if not langs or not letters.any():
            return "und", 0.0, []
        s = self.rows[idx]
        path = viterbi(s, self.switch)
        share = np.bincount(path, letters, len(langs))
        best = int(np.argmax(share))
        mine = path == best
        e = np.exp(s[mine])
        sure = float(np.average(e[:, best] / e.sum(axis=1), weights=letters[mine]))
        cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
        return langs[best], min(1.0, float(share[best] / letters.sum()) * sure), [{"start": a, "end": b, "lang": langs[path[a]]} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_labellers: dict[str, Labeller] = {}


def labeller_of(model: Model, switch: float) -> Labeller:
    """One for all tasks of a worker process that use this model."""
    key = f"{model.name} {switch}"
    if key not in _labellers:
        _labellers.clear()
        _labellers[key] = Labeller(model, switch)
    return _labellers[key]


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows_per_lang: int = ROWS_PER_LANG, rows_in_all: int = ROWS) -> Model:
    """The model of a bounded sample: the rows of a language whose hash lies under the share that rows_per_lang is of all its rows.

    The count of rows by language comes first and reads no text; the sample itself is a filter, so no text is shuffled.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    place = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.octet_length(F.col(text))), F.lit(1 << 40))
    counts = {r["l"]: r["n"] for r in rows.groupBy(F.col(lang).cast("string").alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not counts:
        return Model({})
    rows_per_lang = min(rows_per_lang, rows_in_all // len(counts))
    under = F.create_map(*chain.from_iterable((F.lit(x), F.lit(max(1, rows_per_lang * (1 << 40) // n))) for x, n in counts.items()))
    sample = rows.where(place < under[F.col(lang).cast("string")]).select(F.col(lang).cast("string").alias("l"), F.col(text).alias("text"))

    def make():
        def run(batch):
            by: dict[str, Counter] = defaultdict(Counter)
            for x, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                by[x].update(words(t))
            for x, n in by.items():
                grams, scripts = tally(list(n), list(n.values()))
                at = np.flatnonzero(grams)
                yield [[x] * (len(at) + len(scripts)), at.tolist() + [None] * len(scripts), [None] * len(at) + list(scripts), grams[at].tolist() + list(scripts.values())]

        return run

    found = flat_batches(sample, make, [("l", "string"), ("bucket", "int"), ("script", "string"), ("n", "long")]).groupBy("l", "bucket", "script").agg(F.sum("n").alias("n")).toArrow()  # languages x (BUCKETS + scripts) rows
    counted: dict[str, tuple[np.ndarray, dict[str, int]]] = {x: (np.zeros(BUCKETS, np.int64), {}) for x in counts}
    for x, bucket, name, n in zip(*(found.column(c).to_pylist() for c in ("l", "bucket", "script", "n")), strict=True):
        if name is None:
            counted[x][0][bucket] = n
        else:
            counted[x][1][name] = n
    return Model(counted)


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] = (), switch: float = SWITCH, prefix: str = "", spans: bool = True) -> DataFrame:
    """Per row: kept columns, lang_pred, score, spans of one language each."""
    spark = tune(docs.sparkSession)
    bc = spark.sparkContext.broadcast(model)  # languages x BUCKETS doubles

    def make():
        labeller = labeller_of(bc.value, switch)

        def run(batch):
            rows = labeller.batch(texts(batch, text))
            cols = list(map(list, zip(*rows, strict=True))) if rows else [[], [], []]
            return cols if spans else cols[:2]

        return run

    fields = [(prefix + "lang_pred", "string"), (prefix + "score", "double"), (prefix + "spans", "array<struct<start:int,end:int,lang:string>>")]
    return map_batches(docs.select(*dict.fromkeys([*keep, text])), make, fields if spans else fields[:2], list(keep))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", part("doc_id", 3, 1))
    model = fit(docs.where(~F.col("held_out")))
    return identify(docs, model, keep=["doc_id", "held_out"], spans=False)


ORACLE = None

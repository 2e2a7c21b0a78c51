"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic texts; the unlabelled texts are drawn from all that may be learned from, so they follow
the corpus as the risk estimator asks. About POSITIVES and UNLABELLED texts are sampled (hash of the id under a limit;
the documented bound) and reduced to hashed features on the executors. Features are the presence of words and of their
prefixes; Spark counts in how many texts of either sample each stands, and chooses those whose share of the positives
exceeds that of the rest RATIO times and by Z standard errors. The driver receives the names of the chosen features and, of
each sampled text, which of them it holds: a few numbers a text, however long the texts are; a linear model is trained
there in numpy. The risk is

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

with the logistic loss; when the bracket of a batch is negative, the step goes up its gradient instead, so the
unlabelled part cannot be over-fitted. The prior is the share of toxic rows among the labelled rows of the learning part.

Scoring reads each whole text once; a word's weights are looked up once per task.

Defined cases: a null or empty text gets the model's bias as score; without positives the score is 0 for all;
several label rows of one document count as toxic if any is; label rows with a null flag or id say nothing; repeated rows
are scored each for itself; null ids learn nothing and are not held out; kept columns named score or predicted are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop, flat_batches, map_batches, part, texts, tune, words, written

POSITIVES, UNLABELLED, PREFIXES = 6000, 12000, (4, 5, 6)
STEPS, BATCH, RATE, L2, LEAST, Z, RATIO, THRESHOLD, CACHE = 1500, 2000, 0.05, 1e-4, 5, 6.0, 4.0, 0.3, 400_000


def word_features(w: bytes) -> list[int]:
    """32-bit hashes of a word and of its prefixes (in characters)."""
    s = w.decode(errors="replace").lower()
    return [zlib.crc32(f"{n}:{s[:n]}".encode()) for n in PREFIXES if len(s) > n] + [zlib.crc32(f"w:{s}".encode())]


class Features:
    def __init__(self):
        self.known: dict[bytes, list[int]] = {}

    def of(self, text: bytes) -> list[int]:
        if len(self.known) > CACHE:
            self.known.clear()
        out: set[int] = set()
        for w in set(words(text)):
            f = self.known.get(w)
            if f is None:
                f = self.known[w] = word_features(w)
            out.update(f)
        return sorted(out)


class Linear:
    """Weights of the chosen features; all others weigh nothing."""

    def __init__(self, weight: dict[int, float], bias: float, empty: bool = False):
        self.weight, self.bias, self.empty = weight, bias, empty

    def score(self, features) -> float:
        """features: chosen ones, in ascending order."""
        return 0.0 if self.empty else float(1 / (1 + np.exp(-(self.bias + sum(map(self.weight.__getitem__, features))))))


def risk(w: np.ndarray, rows: list[np.ndarray], positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of a batch and the step's gradient. rows: the places of the features that each text holds; w ends with the bias.

    Where the unlabelled part is negative the risk leaves it out, and the gradient is that of going back up it.
    """
    return _risk(w, np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), positive, prior)


def _risk(w: np.ndarray, held: np.ndarray, of: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """held: features of all texts; of: the text of each."""
    n = len(positive)
    s = 1 / (1 + np.exp(-(w[-1] + np.bincount(of, w[held], n))))
    plus, minus = -np.log(np.maximum(s, 1e-300)), -np.log(np.maximum(1 - s, 1e-300))
    n_p, n_u = positive.sum(), (~positive).sum()
    loss_p, rest = prior * plus[positive].mean(), minus[~positive].mean() - prior * minus[positive].mean()
    g = np.where(positive, -prior * s / n_p, s / n_u)
    g = -g if rest < 0 else g + np.where(positive, prior * (s - 1) / n_p, 0.0)
    return float(loss_p + max(0.0, rest)), np.append(np.bincount(held, g[of], len(w) - 1), g.sum())


def train(names: np.ndarray, rows: list[np.ndarray], positive: np.ndarray, prior: float, *, steps: int = STEPS, seed: int = 7) -> Linear:
    """rows: the places, in names, of the chosen features that a text holds; positive: whether it is of the positive sample or the unlabelled one. Adam."""
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    if not len(p) or not len(u) or prior <= 0:
        return Linear({}, 0.0, True)
    w = np.zeros(len(names) + 1)
    m, v, t, rng = np.zeros_like(w), np.zeros_like(w), 0, np.random.default_rng(seed)
    size = np.array([len(r) for r in rows])
    first, flat = np.cumsum(size) - size, np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    batches = max(1, len(rows) // BATCH)
    for _ in range(-(-steps // batches)):
        for pb, ub in zip(np.array_split(rng.permutation(p), batches), np.array_split(rng.permutation(u), batches), strict=True):
            if not len(pb) or not len(ub):
                continue
            batch = np.concatenate([pb, ub])
            n = size[batch]
            of = np.repeat(np.arange(len(batch)), n)
            held = flat[np.arange(len(of)) + np.repeat(first[batch] - (np.cumsum(n) - n), n)]
            grad = _risk(w, held, of, positive[batch], prior)[1] + L2 * np.append(w[:-1], 0)
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w[:-1] = np.maximum(w[:-1], 0)  # chosen features speak for toxicity or not at all, however long the text
    return Linear(dict(zip(names.tolist(), w[:-1].tolist(), strict=True)), float(w[-1]))


def chosen(sample: DataFrame, n_p: int, n_u: int) -> DataFrame:
    """f of the features (y, f array) that mark the positives among the sampled texts."""
    n = sample.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("u"))
    rate_p, rate_u, rate = F.col("p") / n_p, F.col("u") / n_u, (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    z = (rate_p - rate_u) / F.sqrt(rate * (1 - rate) * (1 / n_p + 1 / n_u))
    return n.where((F.col("p") >= LEAST) & (z > Z) & (rate_p > RATIO * rate_u)).select("f")


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Linear:
    """docs: what may be learned from. Labels of other documents are never read into the model.

    The samples are filters by hash under limits that follow from counts, so no text is shuffled; the ids of the positive
    sample (about `positives`, whatever the corpus) are broadcast. Their features, as a table, are all that is shuffled.
    """
    spark = tune(docs.sparkSession)
    flags = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_k")).agg(F.max(F.col(toxic).cast("int")).alias("_y"))
    prior, n_p = flags.agg(F.avg("_y"), F.sum("_y")).first()
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n_u = rows.count()
    if not n_p or not n_u:
        return Linear({}, 0.0, True)

    def under(bound: int, n: int, seed: int):
        return F.pmod(F.xxhash64(F.col("_k").cast("string"), F.lit(seed)), F.lit(1 << 40)) < bound * (1 << 40) // n

    confirmed = flags.where((F.col("_y") == 1) & under(positives, n_p, 1)).select("_k")
    sample = rows.join(F.broadcast(confirmed), "_k").select(F.lit(1).alias("_y"), "text").union(rows.where(under(unlabelled, n_u, 2)).select(F.lit(0), "text"))

    def make():
        features = Features()

        def run(batch):
            yield [batch.column(0).to_pylist(), [features.of(t) for t in texts(batch)]]

        return run

    held = written(flat_batches(sample.select("_y", "text"), make, [("y", "int"), ("f", "array<long>")]), "features")
    size = {r["y"]: r["n"] for r in held.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return Linear({}, 0.0, True)
    names = np.array(sorted(r["f"] for r in chosen(held, size[1], size[0]).collect()), np.int64)  # each in LEAST sampled positives at least
    bc = spark.sparkContext.broadcast(names)

    def reduce():
        def run(batch):
            rows = [np.array(f, np.int64) for f in batch.column(1).to_pylist()]
            yield [batch.column(0), [np.searchsorted(bc.value, f[np.isin(f, bc.value)]).astype("<i4").tobytes() for f in rows]]

        return run

    got = flat_batches(held, reduce, [("y", "int"), ("f", "binary")]).toArrow()
    drop(held)
    return train(names, [np.frombuffer(f, "<i4") for f in got.column("f").to_pylist()], np.array([y == 1 for y in got.column("y").to_pylist()], bool), float(prior))


def score(docs: DataFrame, model: Linear, *, text: str = "text", keep: list[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    """Per row: kept columns, score, predicted."""
    spark = tune(docs.sparkSession)
    bc = spark.sparkContext.broadcast(model)  # the chosen features, fewer than the samples hold

    def make():
        linear = bc.value
        heavy = linear.weight.keys()
        known: dict[bytes, tuple[int, ...]] = {}

        def run(batch):
            if len(known) > CACHE:
                known.clear()
            out = []
            for t in texts(batch, text):
                hit: set[int] = set()
                for w in words(t):
                    f = known.get(w)
                    if f is None:
                        f = known[w] = tuple(x for x in word_features(w) if x in heavy)
                    if f:
                        hit.update(f)
                out.append(linear.score(sorted(hit)))
            return [out, [int(s >= threshold) for s in out]]

        return run

    return map_batches(docs.select(*dict.fromkeys([*keep, text])), make, [("score", "double"), ("predicted", "int")], list(keep))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", part("doc_id", 4, 2))
    labels = documents(spark, sf_dir, "labels").where(~part("doc_id", 4, 2))
    return score(docs, fit(docs.where(~F.col("held_out")), labels), keep=["doc_id", "held_out"])


ORACLE = None

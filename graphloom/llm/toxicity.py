"""Operator 5: toxicity scores by non-negative positive-unlabelled learning.

Only confirmed toxic examples are taken as labels; every other text is unlabelled,
a mixture that holds toxic texts at the class prior. A linear numpy classifier
over the presence of words and word beginnings is trained on the risk estimate of
Kiryo et al. ("Positive-Unlabeled Learning with Non-Negative Risk Estimator",
NeurIPS 2017):

    prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)])

and scores are the sigmoid of its output. Weights are kept at or above 0: a
feature is evidence of toxicity or nothing, so a long clean text does not drift.

The fit uses a bounded sample of the labelled rows: `max_positive` confirmed examples
and `max_unlabelled` rows whose labels are not looked at, those with the smallest
hash of their id. Both come from the labelled rows, so the share of confirmed
examples there is the class prior of the unlabelled ones. The model has the
`max_features` most telling features. Scoring is a map over all whole texts with the
weights broadcast.

Defined results: null and empty texts have the score of a text without features;
without confirmed examples every score is 0; a null id is never held out and never
learnt from; rows that repeat an id get their own rows; of labels that repeat an id,
one toxic one makes it a confirmed example; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import _POSITION, _U, alnum_folded, as_bytes, chunks, mix, sliced, split_words
from ._shared import settle, small_batches

#: Lengths in bytes of the word beginnings that are features, beside whole words.
BEGINNINGS = (4, 5)


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.concatenate([self._scores(part) for _, part in chunks(texts)] or [np.zeros(0)])

    def _scores(self, part: list[bytes]) -> np.ndarray:
        g = np.full(len(part), self.bias)
        if len(self.features):
            for h, text_of in features_of(part):
                at = np.searchsorted(self.features, h)
                at[at == len(self.features)] = 0
                found = self.features[at] == h
                pairs = np.unique(text_of[found] * len(self.features) + at[found])
                np.add.at(g, pairs // len(self.features), self.weights[pairs % len(self.features)])
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def features_of(part: list[bytes]):
    """For words and for each length of beginnings: (hash, text index) of every occurrence."""
    h, starts, ends, data, _, bounds = split_words(alnum_folded, part)
    text_of = np.repeat(np.arange(len(part)), np.diff(bounds))
    yield h, text_of
    buf = np.frombuffer(data, np.uint8)
    for size in BEGINNINGS:
        whole = ends - starts >= size
        first = starts[whole]
        b = np.zeros(len(first), dtype=_U)
        for k in range(size):
            b += alnum_folded.values[buf[first + k]] * _POSITION[k]
        yield mix(b + _U(size)), text_of[whole]


def _distinct_features(texts: list[bytes]):
    for _, part in chunks(texts):
        found = list(features_of(part))
        h, t = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        order = np.argsort(t, kind="stable")
        h, t = h[order], t[order]
        cut = np.searchsorted(t, np.arange(len(part) + 1))
        for i in range(len(part)):
            yield np.unique(h[cut[i] : cut[i + 1]])


#: Least likelihood-ratio statistic of a feature (about 1 in 50,000 by chance).
SURPRISE = 18.0
#: Features that a map task counts before it sends them on.
FLUSH = 1 << 20


def _count_features(batches):
    """Rows (feature, p, u): texts of either role that have a feature, combined in the task."""

    def flush(positive, unlabelled):
        f, n = np.unique(np.concatenate([*positive, *unlabelled]), return_counts=True)
        p = np.zeros(len(f), dtype=np.int64)
        if positive:
            g, k = np.unique(np.concatenate(positive), return_counts=True)
            p[np.searchsorted(f, g)] = k
        return pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(p), pa.array(n - p)], ["feature", "p", "u"])

    positive, unlabelled, held = [], [], 0
    for b in sliced(batches):
        for s, is_p, is_u in zip(_distinct_features(as_bytes(b.column(0))), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            positive += [s] * bool(is_p)
            unlabelled += [s] * bool(is_u)
            held += len(s)
            if held >= FLUSH:
                yield flush(positive, unlabelled)
                positive, unlabelled, held = [], [], 0
    if positive or unlabelled:
        yield flush(positive, unlabelled)


def select_features(counts: DataFrame, n_positive: int, n_unlabelled: int, prior: float, most: int) -> np.ndarray:
    """The hashes that tell positives from the rest best, by a likelihood ratio.

    counts: (feature, p, u). Many features are tried, so only those far beyond
    chance are taken, and only those that are rare in what remains of the
    unlabelled after the prior's share. At most `most` rows reach the driver.
    """
    clip = lambda c: F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), c))
    rate = clip((F.col("p") + F.col("u")) / (n_positive + n_unlabelled))

    def gain(k, n):
        own = clip(F.col(k) / n)
        return F.col(k) * F.log(own / rate) + (n - F.col(k)) * F.log((1 - own) / (1 - rate))

    share = F.col("p") / n_positive
    negative = F.greatest(F.lit(0.0), (F.col("u") / n_unlabelled - prior * share) / (1 - prior))
    surprise = 2 * (gain("p", n_positive) + gain("u", n_unlabelled))
    best = counts.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).filter(F.col("p") >= 3).withColumn("surprise", F.round(surprise, 6))
    best = best.filter((F.col("surprise") > SURPRISE) & (share > 3 * negative)).orderBy(F.desc("surprise"), "feature").limit(most)
    return np.sort(np.array([r[0] for r in best.select("feature").collect()], dtype=np.int64).view(_U))


def _find_features(features: np.ndarray):
    """Map over sampled texts: the places in `features` of what each text has."""

    def each(batches):
        for b in sliced(batches):
            found = []
            for s in _distinct_features(as_bytes(b.column(0))):
                at = np.searchsorted(s, features)
                at[at == len(s)] = 0
                found.append(np.flatnonzero(s[at] == features).astype(np.int32).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column(1), b.column(2)], ["places", "positive", "unlabelled"])

    return each


def presence(places: list[bytes], n: int) -> np.ndarray:
    out = np.zeros((len(places), n), dtype=np.float32)
    for i, x in enumerate(places):
        out[i, np.frombuffer(x, np.int32)] = 1
    return out


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by full-batch Adam."""
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    w, b = np.zeros(xp.shape[1], np.float64), np.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        w32 = w.astype(np.float32)  # as the matrices are, or each product copies them
        gp, gu = (xp @ w32).astype(np.float64) + b, (xu @ w32).astype(np.float64) + b
        on_p, off_p, off_u = -sigmoid(-gp) / len(gp), sigmoid(gp) / len(gp), sigmoid(gu) / len(gu)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        if negative >= 0:
            dp, du = prior * (on_p - off_p), off_u
        else:  # the estimate went below zero: step back along its own gradient
            dp, du = prior * off_p, -off_u
        grad = np.append(xp.T @ dp.astype(np.float32) + xu.T @ du.astype(np.float32) + decay * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = np.maximum(0, w - step[:-1]), b - step[-1]
    return w, float(b)


def held_out(id_col: str):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = 4000, max_unlabelled: int = 8000, max_features: int = 1024) -> Model | None:
    """A model from the rows that are not held out; None without confirmed examples."""
    known = labels.filter(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    n, toxic = known.agg(F.count("*"), F.sum((F.col(label_col) == 1).cast("long"))).first()
    if not n or not toxic:
        return None
    prior = min(0.9, max(1e-3, toxic / n))
    by_hash = lambda df, most, role: df.filter(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col), id_col).limit(most).select(F.col(id_col).alias("id"), F.lit(role).alias("role"))
    positive = by_hash(known.filter(F.col(label_col) == 1).select(id_col), max_positive, 1)
    unlabelled = by_hash(known.select(id_col), max_unlabelled, 0)
    sample = positive.union(unlabelled).groupBy("id").agg(F.max("role").alias("positive"), (F.min("role") == 0).alias("unlabelled"))

    # the sample has at most max_positive + max_unlabelled ids, and their texts are kept for two passes
    texts = settle(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("text", "positive", "unlabelled"))
    n_positive, n_unlabelled = texts.agg(F.sum("positive"), F.sum(F.col("unlabelled").cast("int"))).first()
    if not n_positive or not n_unlabelled:
        return None
    features = select_features(texts.mapInArrow(_count_features, "feature long, p long, u long"), n_positive, n_unlabelled, prior, max_features)
    rows = texts.mapInArrow(_find_features(features), "places binary, positive int, unlabelled boolean").collect()
    xp = presence([r["places"] for r in rows if r["positive"]], len(features))
    xu = presence([r["places"] for r in rows if r["unlabelled"]], len(features))
    weights, bias = fit_nnpu(xp, xu, prior)
    return Model(features, weights, bias)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, **options))

    def each(batches):
        model = held.value
        for b in sliced(batches):
            texts = as_bytes(b.column(2))
            s = model.scores(texts) if model is not None else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], ["id", "held_out", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(each, "id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

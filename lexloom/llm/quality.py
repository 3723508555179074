"""Quality classifier by positive-unlabelled learning (non-negative unbiased risk).

A small neural network in numpy sees surface features of a text: shares of character classes, repetition of words and
lines, lengths. It is trained on trusted positives and unlabelled web text by minimising

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

(logistic loss; where the second term turns negative, its gradient is followed the other way, as in the published
method). The class prior is estimated from the labelled training rows. Training uses a bounded sample (`max_positive`,
`max_unlabelled` rows, picked by a hash of the id); scoring reads every whole text in one narrow pass.

Defined results: null and empty texts have all-zero features and get the network's score for those; a null id counts as
the text 'null' for folds and samples; without trusted positives every score is the prior (0.5 without any label);
repeated rows get equal scores; an empty table gives an empty result; other columns are ignored (labels: only the id and
the label column).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import id_remainder, lean, text_of

N_FEATURES = 20
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """Byte -> class: 0 other control, 1 blank, 2 line break, 3 small, 4 capital, 5 digit, 6 . and ,  7 ! and ?  8 other prose marks, 9 symbols, 10 beyond ASCII."""
    out = np.zeros(256, dtype=np.int64)
    for chars, k in ((b" \t\r\x0b\x0c", 1), (b"\n", 2), (bytes(range(97, 123)), 3), (bytes(range(65, 91)), 4), (b"0123456789", 5), (b".,", 6), (b"!?", 7), (b"'\"-:;()", 8), (b"#$%&*+/<=>@[\\]^_`{|}~", 9)):
        out[list(chars)] = k
    out[128:] = 10
    return out


def features(data: bytes) -> list[float]:
    """N_FEATURES numbers for a text in UTF-8."""
    words = data.split()
    if not words:
        return [0.0] * N_FEATURES
    n, m = len(data), len(words)
    classes = np.bincount(CLASSES, weights=np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=11)
    share = classes / n
    letters = classes[3] + classes[4] + classes[10]
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = hist[hist > 0] / n
    lines = [x for x in data.split(b"\n") if x]
    pairs = max(1, m - 1)
    return [
        np.log1p(n) / 10,
        np.log1p(m) / 10,
        share[1],
        share[2] * 10,
        share[3],
        classes[4] / max(1.0, letters),
        share[5] * 10,
        share[6] * 10,
        share[7] * 10,
        share[8] * 10,
        share[9] * 10,
        share[10],
        share[0] * 10,
        (n - classes[1] - classes[2]) / m / 10,
        len(set(words)) / m,
        len(set(zip(words, words[1:]))) / pairs if m > 1 else 1.0,
        sum(map(eq, words, words[1:])) / pairs,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(m / max(1, len(lines))) / 5,
        float(-(p * np.log(p)).sum()) / 5,
    ]


CLASSES = _classes()


@dataclass
class Model:
    """Standardise, one hidden layer of tanh units, a logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float
    trained: bool = True

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.prior)
        z = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 400, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    """Full-batch Adam on the non-negative risk. positive, unlabelled: one row of features per text."""
    if not len(positive) or not len(unlabelled):
        return Model(*[np.zeros(0)] * 5, 0.0, prior, trained=False)
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    norm = lambda x: np.clip((x - mean) / scale, -8, 8)
    xp, xu = norm(positive), norm(unlabelled)
    x = np.vstack([xp, xu])
    k = len(xp)
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        h = np.tanh(x @ params[0] + params[1])
        z = np.clip(h @ params[2] + params[3][0], -40, 40)
        sig = 1 / (1 + np.exp(-z))
        # logistic losses: l(+1) = log(1 + e^-z), l(-1) = log(1 + e^z); their slopes are sig - 1 and sig
        risk_negative = np.logaddexp(0, z[k:]).mean() - prior * np.logaddexp(0, z[:k]).mean()
        slope = np.zeros(len(x))
        if risk_negative >= 0:
            slope[:k] = prior * (sig[:k] - 1) / k - prior * sig[:k] / k
            slope[k:] = sig[k:] / (len(x) - k)
        else:  # ascend on the negative part until it is no longer below zero
            slope[:k] = prior * sig[:k] / k
            slope[k:] = -sig[k:] / (len(x) - k)
        dh = np.outer(slope, params[2]) * (1 - h * h)
        grads = [x.T @ dh + decay * params[0], dh.sum(0), h.T @ slope + decay * params[2], np.array([slope.sum()])]
        for i, g in enumerate(grads):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.999 * m2[i] + 0.001 * g * g
            params[i] = params[i] - rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, params[0], params[1], params[2], float(params[3][0]), prior)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", held_out: int = 0, folds: int = 5, max_positive: int = 15_000, max_unlabelled: int = 30_000) -> Model:
    """Train on rows whose id's crc32 modulo `folds` isn't `held_out`."""
    training = labels.select(F.col(doc_id).alias("__ll_id"), F.col(label).alias("__ll_y")).where((id_remainder("__ll_id", folds) != held_out) & F.col("__ll_y").isNotNull())
    n = training.agg(F.coalesce(F.sum((F.col("__ll_y") == 1).cast("long")), F.lit(0)), F.count(F.lit(1))).collect()[0]
    prior = min(0.99, max(0.01, (n[0] + 0.5) / (n[1] + 1.0)))
    rows = docs.select(F.col(doc_id).alias("__ll_id"), text_of(text).cast("binary").alias("__ll_t")).where(id_remainder("__ll_id", folds) != held_out)
    total = rows.count()
    # Of the hash's range, as much as gives about the wanted number of rows.
    chosen = lambda most, of, salt: (F.pmod(F.xxhash64(F.lit(salt), F.col("__ll_id")), F.lit(1 << 30)) < int(min(1.0, most / max(1, of)) * (1 << 30)))
    positives = training.where((F.col("__ll_y") == 1) & chosen(max_positive, n[0], 1)).select("__ll_id").distinct()
    # Both inputs are bounded by the sample size, the first one also in what it broadcasts.
    positive = rows.join(F.broadcast(positives), "__ll_id", "left_semi").withColumn("__ll_p", F.lit(1))
    unlabelled = rows.where(chosen(max_unlabelled, total, 2)).withColumn("__ll_p", F.lit(0))
    found = positive.unionByName(unlabelled).select("__ll_p", "__ll_t").mapInArrow(lean(_sample_features), "p int, x array<double>").toArrow()
    kinds, sample = found.column(0).to_numpy(), found.column(1).combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES)
    stack = lambda v: sample[kinds == v]
    order = lambda x: x[np.lexsort(x.T)]  # noqa: E731  the sums don't depend on the order in which tasks ended
    return train_nnpu(order(stack(1)), order(stack(0)), prior)


def _sample_features(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        rows = [features(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["p", "x"])


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs' columns plus the score (replacing a column of that name). Only texts go to Python, only scores come back."""

    @F.arrow_udf("double")
    def scored(texts):
        import pyarrow as pa

        return pa.array(model.score(np.array([features(x.as_py()) for x in texts], dtype=np.float64).reshape(-1, N_FEATURES)))

    kept = docs.drop(column) if column != text else docs
    return kept.withColumn("__ll_score", scored(text_of(text).cast("binary"))).withColumnRenamed("__ll_score", column)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **settings) -> DataFrame:
    """doc_id, held_out (boolean), score (double), predicted (int)."""
    model = fit(docs, labels, doc_id, text, **settings)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = score(rows, model)
    return scored.select("doc_id", (id_remainder("doc_id", settings.get("folds", 5)) == settings.get("held_out", 0)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Quality by positive-unlabelled learning: a non-negative unbiased risk, trusted positives, unlabelled text, a prior.

Each text becomes a fixed-length vector of byte and word statistics: shares of character classes, frequencies of pairs
of classes, hashed word endings and lengths, and measures of repetition.  A linear model with a logistic loss is
trained on trusted positives and unlabelled text by minimising ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``;
where the bracket turns negative the step undoes the over-fitting instead.  The prior is estimated from the data: a
first model ranks held-back positives and unlabelled rows, and the least ratio of their upper tails bounds the share of
positives among the unlabelled.

The fit starts on at most ``MOST_FIT`` positives and as many unlabelled rows, drawn by a hash of id and text from all of
them.  From there ``ROUNDS`` Newton steps go on over every unlabelled row, at any number of rows and however these are split:
one pass adds up the slope of the risk, the curvature comes from the sample, and another pass measures the risk at several
lengths of the step, of which the best is taken.  The part of the risk
that must not be negative counts by its size, so a step that over-fits is cut short, down to length 0.
Standardisation and the upper tails for the prior rest on every unlabelled text as well (in the query all documents, the
trusted ones among them; for the tails less those that the first model was fitted on); scoring covers every text.  Sums of
tasks are added up by other tasks until few are left, so the driver gets as many of them at any size.

Edge cases: null and empty texts give the vector of an empty text and are scored like any other; texts are used whole;
a table without trusted positives gives the prior 0.5 to every row; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import textkit
from lectern.llm.runtime import arrow_batches, extend

#: Trusted positives used, and unlabelled rows that the fit starts on, at most.
MOST_FIT = 12_000
EPOCHS, BATCH, RATE, DECAY = 40, 1024, 0.02, 2e-4
#: Newton steps over all unlabelled rows, and the lengths that each is tried at.
ROUNDS = 2
LENGTHS = np.array([0.0, *(2.0**-k for k in range(6, -1, -1))])
#: Sums that the driver adds up, and that a task adds up to one.
MOST_SUMS = 32
KEYS = 1 << 60
CLASSES = 12
ENDINGS = 64
FEATURES = CLASSES + CLASSES * CLASSES + ENDINGS + 12


def _class_table() -> np.ndarray:
    table = np.full(256, 11, np.int64)
    table[97:123], table[65:91], table[48:58] = 0, 1, 2
    for k, chars in enumerate((" \t\r\x0b\x0c", "\n", ".,;:", "!?", "'\"()-", "#$%&*", "|<>{}[]\\/=_", "@^~`+")):
        table[[ord(c) for c in chars]] = 3 + k
    return table


_CLASS = _class_table()


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES numbers for each text."""
    data, offsets = textkit.buffers(column)
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), np.float32)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    kind = _CLASS[data]
    some = np.maximum(size, 1).astype(float)[:, None]
    out[:, :CLASSES] = np.bincount(owner * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES) / some
    pair = (owner[1:] * CLASSES + kind[:-1]) * CLASSES + kind[1:]
    same = owner[1:] == owner[:-1]
    at = CLASSES + CLASSES * CLASSES
    out[:, CLASSES:at] = np.sqrt(np.bincount(pair[same], minlength=n * CLASSES * CLASSES).reshape(n, -1) / some)
    starts, ends, bounds = textkit.words(data, offsets)
    hashes = textkit.word_hashes(data, starts, ends)
    count = np.diff(bounds)
    word_owner = np.repeat(np.arange(n), count)
    many = np.maximum(count, 1).astype(float)
    tail = kind[ends - 1] * CLASSES + kind[np.maximum(ends - 2, starts)] if len(ends) else np.zeros(0, np.int64)
    bucket = ((tail * 0x9E3779B1) >> 7) % ENDINGS
    out[:, at : at + ENDINGS] = np.sqrt(np.bincount(word_owner * ENDINGS + bucket, minlength=n * ENDINGS).reshape(n, ENDINGS) / many[:, None])
    at += ENDINGS
    length = (ends - starts).astype(float)
    keys = np.sort((word_owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
    twice = np.zeros(n)
    if len(hashes) > 1:
        again = (hashes[1:] == hashes[:-1]) & (word_owner[1:] == word_owner[:-1])
        twice = np.bincount(word_owner[1:][again], minlength=n)
    shingle, edge = textkit.shingles(hashes, bounds, 3)
    shingle_owner = np.repeat(np.arange(n), np.diff(edge))
    keys = np.sort((shingle_owner.astype(np.uint64) << np.uint64(40)) | (shingle >> np.uint64(24)))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    runs = np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
    total = np.bincount(word_owner, length, minlength=n)
    square = np.bincount(word_owner, length * length, minlength=n)
    lines = np.bincount(owner[data == 10], minlength=n) + 1
    out[:, at + 0] = np.log1p(size)
    out[:, at + 1] = np.log1p(count)
    out[:, at + 2] = total / many
    out[:, at + 3] = np.sqrt(np.maximum(square / many - (total / many) ** 2, 0))
    out[:, at + 4] = distinct / many
    out[:, at + 5] = twice / many
    out[:, at + 6] = runs / np.maximum(np.diff(edge), 1)
    out[:, at + 7] = count / lines
    out[:, at + 8] = np.bincount(word_owner[length >= 20], minlength=n) / many
    out[:, at + 9] = np.bincount(word_owner[length == 1], minlength=n) / many
    out[:, at + 10] = distinct / np.sqrt(many)
    out[:, at + 11] = size == 0
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return _scaled(self, x) @ self.weights + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class _Descent:
    """Adam on the non-negative risk, one batch of both kinds at a time."""

    def __init__(self, w: np.ndarray, b: float, prior: float):
        self.w, self.b, self.prior = w, b, prior
        self.m, self.v, self.t = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0

    def step(self, p: np.ndarray, u: np.ndarray) -> None:
        w, b, prior = self.w, self.b, self.prior
        zp, zu = p @ w + b, u @ w + b
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
        gn = su / len(u), -prior * sp / len(p)  # gradient of the bracket with regard to the margins
        gp = prior * (sp - 1) / len(p)
        if negative >= 0:
            du, dp = gn[0], gn[1] + gp
        else:
            du, dp = -gn[0], -gn[1]
        g = np.append(u.T @ du + p.T @ dp + DECAY * w, du.sum() + dp.sum())
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        step = RATE * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
        self.w, self.b = w - step[:-1], b - step[-1]


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the least non-negative risk, by Adam on batches that hold both kinds."""
    rng = np.random.default_rng(seed)
    descent = _Descent(np.zeros(positive.shape[1]), float(np.log(prior / (1 - prior))), prior)
    steps = max(1, -(-max(len(positive), len(unlabelled)) // BATCH))
    for _ in range(epochs):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for k in range(steps):
            p, u = positive[p_order[k::steps]], unlabelled[u_order[k::steps]]
            if len(p) and len(u):
                descent.step(p, u)
    return descent.w, float(descent.b)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores of both: the least ratio of upper tails, with a margin."""
    return _prior(positive, np.searchsorted(np.sort(unlabelled), _cuts(positive)), len(unlabelled))


def _cuts(positive: np.ndarray) -> np.ndarray:
    return np.quantile(positive, np.linspace(0.02, 0.98, 49))


def _prior(positive: np.ndarray, below: np.ndarray, n: int) -> float:
    """From the number of the ``n`` unlabelled scores that lie below each cut."""
    p = 1 - np.searchsorted(np.sort(positive), _cuts(positive)) / max(1, len(positive))
    u = 1 - below / max(1, n)
    slack = np.sqrt(1 / max(1, len(positive))) + np.sqrt(1 / max(1, n))
    best = np.argmin((u + slack) / np.maximum(p, 1e-9))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.02, 0.98))


def _key() -> Column:
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(KEYS))


def _sample(rows: DataFrame, most: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature vectors and keys of at most ``most`` of the ``n`` rows, the lowest by a hash of id and text."""
    drawn = rows.where(_key() < int(min(1.0, 1.2 * most / max(1, n)) * KEYS)).withColumn("key", _key())

    def kernel():
        return lambda column: [pa.array([x.tobytes() for x in features(column)], pa.binary())]

    found = extend(drawn, kernel, "vector binary", ["key"]).orderBy("key").limit(most).toPandas()
    return np.array([np.frombuffer(x, np.float32) for x in found["vector"]]).reshape(len(found), FEATURES).astype(float), found["key"].to_numpy(np.int64)


def _totals(rows: DataFrame, size: int, start) -> np.ndarray:
    """Sum over the tasks of the ``size`` numbers of ``start() -> (add(features), result())``."""
    arrow_batches(rows.sparkSession)

    def packed(total) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.asarray(total, float).tobytes()], pa.binary())], names=["raw"])

    def run(batches):
        add, result = start()
        for batch in batches:
            for i, j in textkit.slices(textkit.buffers(batch.column(0))[1]):
                add(features(batch.column(0).slice(i, j - i)).astype(float))
        yield packed(result())

    def together(batches):
        total = np.zeros(size)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw)
        yield packed(total)

    texts = rows.select(F.col("text").cast("string"))
    sums, tasks = texts.mapInArrow(run, "raw binary"), texts.rdd.getNumPartitions()
    while tasks > MOST_SUMS:
        tasks = -(-tasks // MOST_SUMS)
        sums = sums.repartition(tasks).mapInArrow(together, "raw binary")
    total = np.zeros(size)
    for r in sums.collect():
        total += np.frombuffer(r["raw"])
    return total


def _moments():
    total = np.zeros(2 * FEATURES + 1)

    def add(x):
        total[:] += np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]])

    return add, lambda: total


def _below(model: Model, cuts: np.ndarray):
    """Number of margins below each cut, and of all."""
    total = np.zeros(len(cuts) + 1)

    def add(x):
        total[:] += np.append(np.searchsorted(np.sort(model.margin(x)), cuts), len(x))

    return add, lambda: total


def _scaled(model: Model, x: np.ndarray) -> np.ndarray:
    return np.clip((x - model.mean) / model.scale, -6, 6)


def _slope(model: Model):
    """Sums over rows: the gradient of the loss as a negative by weights and bias, that loss, and rows."""
    total = np.zeros(FEATURES + 3)

    def add(x):
        x = _scaled(model, x)
        z = x @ model.weights + model.bias
        s = _sigmoid(z)
        total[:] += np.concatenate([s @ x, [s.sum(), np.logaddexp(0, z).sum(), len(x)]])

    return add, lambda: total


def _losses(model: Model, step: np.ndarray):
    """Sums over rows of the loss as a negative at each length of ``step``, and rows."""
    total = np.zeros(len(LENGTHS) + 1)

    def add(x):
        x = _scaled(model, x)
        z, dz = x @ model.weights + model.bias, x @ step[:-1] + step[-1]
        total[:] += np.append(np.logaddexp(0, z[:, None] + dz[:, None] * LENGTHS).sum(0), len(x))

    return add, lambda: total


def _newton(model: Model, positive: np.ndarray, sample: np.ndarray, unlabelled: DataFrame) -> Model:
    """One step down the risk over all of ``unlabelled``; ``positive`` and ``sample`` are standardised rows."""
    one = lambda x: np.hstack([x, np.ones((len(x), 1))])
    p, u, prior, w = one(positive), one(sample), model.prior, np.append(model.weights, model.bias)
    decay = np.append(np.full(FEATURES, DECAY), 0.0)
    sums = _totals(unlabelled, FEATURES + 3, lambda: _slope(model))
    n, zp = sums[-1], p @ w
    excess = sums[-2] / n - prior * np.logaddexp(0, zp).mean()  # the part that must not be negative
    if excess >= 0:
        slope = sums[:-2] / n - prior * p.mean(0) + decay * w
    else:  # as in single steps: undo the over-fitting
        slope = prior * (_sigmoid(zp) @ p) / len(p) - sums[:-2] / n
    s = _sigmoid(u @ w)
    curvature = (u * (s * (1 - s))[:, None]).T @ u / len(u) + np.diag(decay + 1e-6)
    step = -np.linalg.solve(curvature, slope)
    sums = _totals(unlabelled, len(LENGTHS) + 1, lambda: _losses(model, step))
    z, dz = p @ w, p @ step
    at = z[:, None] + dz[:, None] * LENGTHS
    excess = sums[:-1] / n - prior * np.logaddexp(0, at).mean(0)
    moved = w[:, None] + step[:, None] * LENGTHS
    risk = prior * np.logaddexp(0, -at).mean(0) + np.abs(excess) + 0.5 * (decay[:, None] * moved**2).sum(0)
    w = moved[:, int(np.argmin(risk))]
    return Model(model.mean, model.scale, w[:-1], float(w[-1]), prior)


def fit(positives: DataFrame, unlabelled: DataFrame, most: int = MOST_FIT) -> Model:
    """Both tables need doc_id and text; labels are not looked at."""
    n = unlabelled.count()
    (p, _), (u, key) = _sample(positives, most, positives.count()), _sample(unlabelled, most, n)
    if not len(p) or not len(u):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 0.5)
    sums = _totals(unlabelled, 2 * FEATURES + 1, _moments)
    mean = sums[:FEATURES] / sums[-1]
    scale = np.sqrt(np.maximum(sums[FEATURES:-1] / sums[-1] - mean * mean, 0)) + 1e-3
    at = Model(mean, scale, np.zeros(FEATURES), 0.0, 0.5)
    p, u = _scaled(at, p), _scaled(at, u)
    half_p, half_u = len(p) // 2, len(u) // 2
    if half_p and half_u:
        first = Model(mean, scale, *minimise(p[:half_p], u[:half_u], 0.5, epochs=12), 0.5)
        margins = p[half_p:] @ first.weights + first.bias
        cuts = _cuts(margins)
        # all unlabelled rows but those that the first model was fitted on
        counts = _totals(unlabelled.where(_key() > int(key[half_u - 1])), len(cuts) + 1, lambda: _below(first, cuts))
        prior = _prior(margins, counts[:-1], int(counts[-1])) if counts[-1] else 0.5
    else:
        prior = 0.5
    model = Model(mean, scale, *minimise(p, u, prior), prior)
    for _ in range(ROUNDS):
        model = _newton(model, p, u, unlabelled)
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (with text) and score."""

    def kernel():
        return lambda column: [pa.array(_sigmoid(model.margin(features(column).astype(float))))]

    return extend(docs, kernel, "score double", keep)

"""Document quality by positive-unlabelled learning.

Only rows with a trusted positive label and unlabelled rows are learned from.
The share of positives among the unlabelled (the class prior) is estimated
first, from how far a positive-against-unlabelled model can find regions that
positives avoid; then a small network minimises the non-negative unbiased risk
(Kiryo et al., NeurIPS 2017)

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).

An estimated prior errs towards 1, which leaves the ranking alone but moves the
point of indifference.  So 0.5 is put where the same risk, with errors counted instead of
logistic losses, is least on rows that were held back from training; in the middle,
where that is so over a range.
Training takes a bounded sample of ids, chosen by hash
(``max_positives``, ``max_unlabelled``), and one row of each; features are computed on executors and
only their vectors reach the driver.  Scoring is one pass over whole texts
without a shuffle.  Inputs of a score are counts over the text's bytes, its words, and
the words and pairs of words by hash.

Defined results: null text counts as empty; an empty text gets the score of a
vector of zeros; without positives or without unlabelled rows there is nothing
to learn and every score is the prior 0.5, predicted 1; labels of repeated ids
are positive only if all of them are, and of rows that share an id one is learned from, the one whose
vector sorts first; a null id or null label is no label.  Repeated rows get equal scores; a very long text is read whole, in
parts.  Only the named columns are read; columns asked for must not have the names of results.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, hash_share, masked, pieces, slices

# Classes of bytes; everything not named is of class 0, letters.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!?", b"#*$%&|<>", b"'\"()[]{}", b"-_/\\+=@~^`"]
N_CLASSES = len(CLASSES) + 1
_CLASS = np.full(256, N_CLASSES - 1, np.uint8)
for _i, _chars in enumerate(CLASSES):
    _CLASS[list(_chars)] = _i
N_WORD_FEATURES = 10
BUCKETS = 64  # of words, and as many of pairs of neighbouring words
N_FEATURES = N_CLASSES * N_CLASSES + N_WORD_FEATURES + 2 * BUCKETS
LEXICAL = 0.3  # weight of a bucket beside that of other features: there are many, and each says little
_WEIGHT = np.concatenate([np.ones(N_FEATURES - 2 * BUCKETS), np.full(2 * BUCKETS, LEXICAL)]).astype(np.float32)
PART = 1 << 20  # bytes of a text that are hashed at a time

# A word's hash is a polynomial in an odd number modulo 2 ** 64, so all words of a text come from one running sum.
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(_BASE)
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """At least n powers of the base, and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, x in enumerate((_STEP, _BACK)):
            _powers[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, np.uint64))])
    return _powers


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    out, a = [np.zeros(0, np.uint64)], 0
    while a < len(text):
        b = min(len(text), a + PART)
        while b < len(text) and not _SPACE[text[b]]:  # a word isn't cut
            b += 1
        data = np.frombuffer(text, np.uint8, b - a, a)
        space = np.concatenate([[True], _SPACE[data], [True]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        first, last = edges[::2], edges[1::2]
        up, down = _power(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        out.append((sums[last] - sums[first]) * down[first])
        a = b
    return np.concatenate(out)


def _lexical(text: bytes) -> np.ndarray:
    """How often words, and pairs of neighbours, fall in each bucket."""
    h = word_hashes(text)
    out = np.zeros(2 * BUCKETS, np.float32)
    if len(h):
        top = np.uint64(64 - BUCKETS.bit_length() + 1)
        mix = lambda x: (((x ^ (x >> np.uint64(31))) * _STEP) >> top).astype(np.int64)
        out[:BUCKETS] = np.sqrt(np.bincount(mix(h), minlength=BUCKETS) / len(h))
        out[BUCKETS:] = np.sqrt(np.bincount(mix(h[:-1] * np.uint64(31) + h[1:]), minlength=BUCKETS) / len(h))
    return out



def _word_features(text: bytes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_WORD_FEATURES
    counts = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = sum(map(len, words))
    return [np.log1p(n), len(counts) / n, same / n, counts.most_common(1)[0][1] / n, pairs / max(1, n - 1), chars / n / 10, len(lines) / n, 1 - len(set(lines)) / len(lines), max(map(len, words)) / 100, 1.0]


def features(texts: list[bytes]) -> np.ndarray:
    """One vector a text: how often each class of byte follows each other, counts over words, and words and pairs by hash."""
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    for own in slices(texts, 1 << 20):
        data = _CLASS[np.frombuffer(b"\n".join(texts[i] for i in own) + b"\n", np.uint8)]
        size = np.array([len(texts[i]) for i in own])
        doc = np.repeat(np.arange(len(own), dtype=np.int32) * N_CLASSES**2, size + 1)
        pair = doc[:-1] + data[:-1].astype(np.int32) * N_CLASSES + data[1:]
        pair = pair[doc[:-1] == doc[1:]]  # the line end after a text is its last byte's neighbour
        grid = np.bincount(pair, minlength=len(own) * N_CLASSES**2).reshape(len(own), -1)
        out[own, : N_CLASSES**2] = np.sqrt(grid / np.maximum(size, 1)[:, None])
    for i, t in enumerate(texts):
        out[i, N_CLASSES**2 : -2 * BUCKETS] = _word_features(t)
        out[i, -2 * BUCKETS :] = _lexical(t)
    return out


class Network:
    """One hidden layer of rectified units, on standardised features; plain arrays, so that it travels well."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray]):
        self.mean, self.scale, self.weights = mean, scale, weights

    def hidden(self, x: np.ndarray) -> np.ndarray:
        out = x - self.mean
        out /= self.scale
        np.clip(out, -6, 6, out=out)
        out *= _WEIGHT
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum(self.hidden(x) @ a + b, 0) @ c + d[0]

    def settle(self, positives: np.ndarray, unlabelled: np.ndarray, prior: float) -> None:
        """Shift scores so that 0.5 lies at the threshold of least risk on rows that weren't trained on."""
        self.weights[3] = self.weights[3] - np.float32(threshold(self.logits(positives), self.logits(unlabelled), prior))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.logits(features(texts)).astype(np.float64), -40, 40)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def threshold(positives: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """Where to cut logits: prior * P(positive below) + max(0, P(unlabelled above) - prior * P(positive above)) is least there.

    Cuts lie in the middle between neighbouring logits, and below all; of those with the least risk the one
    nearest to the middle of the highest and the lowest wins.
    """
    every = np.unique(np.concatenate([positives, unlabelled]).astype(np.float64))
    cuts = np.concatenate([[every[0] - 1], (every[1:] + every[:-1]) / 2])
    p = 1 - np.searchsorted(np.sort(positives), cuts) / max(1, len(positives))
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / max(1, len(unlabelled))
    risk = np.round(prior * (1 - p) + np.maximum(0, u - prior * p), 12)
    best = cuts[risk == risk.min()]
    return float(best[np.abs(best - (best[0] + best[-1]) / 2).argmin()])


def risk_and_gradient(w: list[np.ndarray], xp: np.ndarray, xu: np.ndarray, prior: float | None, decay: float) -> tuple[float, list[np.ndarray]]:
    """What a step goes down on, and its gradient: the risk, or, where its negative part is below 0, that part turned round.

    Logistic losses; without a prior, the loss of telling positives from unlabelled rows.
    """
    x = np.concatenate([xp, xu])
    h = x @ w[0] + w[1]
    r = np.maximum(h, 0)
    s = _sigmoid(r @ w[2] + w[3][0])
    sp, su = s[: len(xp)], s[len(xp) :]
    as_positive, as_negative = (lambda z: -np.log(np.maximum(z, 1e-12)).mean()), (lambda z: -np.log(np.maximum(1 - z, 1e-12)).mean())
    if prior is None:
        value, gp, gu = as_positive(sp) + as_negative(su), (sp - 1) / len(xp), su / len(xu)
    else:
        negative = as_negative(su) - prior * as_negative(sp)
        if negative >= 0:
            value, gp, gu = prior * as_positive(sp) + negative, prior * (sp - 1) / len(xp) - prior * sp / len(xp), su / len(xu)
        else:
            value, gp, gu = -negative, prior * sp / len(xp), -su / len(xu)
    g = np.concatenate([gp, gu])
    back = np.outer(g, w[2]) * (h > 0)
    value += decay / 2 * float((w[0] ** 2).sum() + (w[2] ** 2).sum())
    return float(value), [x.T @ back + decay * w[0], back.sum(0), r.T @ g + decay * w[2], np.array([g.sum()])]


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 7, networks: int = 5, units: int = 24, steps: int = 500, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Minimise the non-negative risk by Adam over ``steps`` mini-batches; ``prior=None`` tells positives from unlabelled instead.

    The mean of ``networks`` such networks from other beginnings varies less than one; being a sum, it is one wider network.
    """
    n = len(positives) + len(unlabelled)
    mean = sum(x.sum(0, dtype=np.float64) for x in (positives, unlabelled)) / n
    square = sum(np.einsum("ij,ij->j", x, x, dtype=np.float64) for x in (positives, unlabelled)) / n
    net = Network(mean.astype(np.float32), np.sqrt(np.maximum(square - mean * mean, 0)).astype(np.float32) + np.float32(1e-3), [])
    p, u = net.hidden(positives), net.hidden(unlabelled)
    found = [_descend(p, u, prior, np.random.default_rng((seed, i)), units, steps, rate, decay) for i in range(networks)]
    a, b, c, d = zip(*found, strict=True)
    net.weights = [np.concatenate(a, 1), np.concatenate(b), np.concatenate(c) / np.float32(networks), np.mean(d, 0, dtype=np.float32)]
    return net


def _descend(p: np.ndarray, u: np.ndarray, prior: float | None, rng: np.random.Generator, units: int, steps: int, rate: float, decay: float, size: int = 256) -> list[np.ndarray]:
    w = [rng.standard_normal((p.shape[1], units)) / np.sqrt(p.shape[1]), np.zeros(units), rng.standard_normal(units) * 0.2, np.zeros(1)]
    w = [x.astype(np.float32) for x in w]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    orders: list = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def batch(i: int, x: np.ndarray) -> np.ndarray:
        while len(orders[i]) < size:
            orders[i] = np.concatenate([orders[i], rng.permutation(len(x))])
        own, orders[i] = orders[i][:size], orders[i][size:]
        return x[own]

    for step in range(1, steps + 1):
        _, grads = risk_and_gradient(w, batch(0, p), batch(1, u), prior, decay)
        for i, grad in enumerate(grads):
            m[i] += 0.1 * (grad - m[i])
            v[i] += 0.001 * (grad * grad - v[i])
            w[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def estimate_prior(positives: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> float:
    """The largest share of the unlabelled that can be positives.

    A model tells half of the positives from half of the unlabelled; on the
    other halves, every region "scored at least t" bounds the share from above
    by P(region | unlabelled) / P(region | positive), with a margin for chance.
    """
    half_p, half_u = len(positives) // 2, len(unlabelled) // 2
    if half_p < 20 or half_u < 20:
        return 0.5
    net = fit(positives[:half_p], unlabelled[:half_u], None, seed, networks=3, steps=200)
    sp, su = np.sort(net.logits(positives[half_p:])), np.sort(net.logits(unlabelled[half_u:]))
    cuts = np.quantile(sp, np.linspace(0.0, 0.7, 71))
    in_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    in_u = 1 - np.searchsorted(su, cuts) / len(su)
    margin = np.sqrt(in_u * (1 - in_u) / len(su)) + np.sqrt(in_p * (1 - in_p) / len(sp))
    return float(np.clip(np.min((in_u + margin) / np.maximum(in_p, 1e-9)), 0.05, 0.98))


class QualityModel:
    def __init__(self, network: Network | None, prior: float):
        self.network, self.prior = network, prior

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.network.scores(texts) if self.network else np.full(len(texts), 0.5)


def train(docs: DataFrame, labels: DataFrame, where: Column, text: str = "text", id_column: str = "doc_id", label: str = "quality", max_positives: int = 12_000, max_unlabelled: int = 16_000, seed: int = 7) -> QualityModel:
    """Learn from rows of ``docs`` where ``where`` (over the id column alone) holds.

    Which rows are taken is settled on ids; at most about ``max_positives`` +
    ``max_unlabelled`` ids are broadcast, and as many feature vectors collected.
    """
    ids = docs.where(where).where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"))
    known = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.min(label).alias("y"))
    told = ids.join(known, "id", "left").select("id", F.when(F.col("y") == 1, 1).when(F.col("y").isNull(), 0).otherwise(-1).alias("y"))
    n = {r["y"]: r["count"] for r in told.groupBy("y").count().collect()}
    if not n.get(1) or not n.get(0):
        return QualityModel(None, 0.5)
    chosen = told.where(((F.col("y") == 1) & hash_share(F.col("id"), max_positives / n[1], seed)) | ((F.col("y") == 0) & hash_share(F.col("id"), max_unlabelled / n[0], seed))).distinct()
    rows = docs.select(F.col(id_column).alias("id"), as_bytes(text).alias("text")).join(F.broadcast(chosen), "id").select("y", "id", "text")

    def run(batches):
        for batch, texts in pieces(batches, 2):
            got = features(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array([x.tobytes() for x in got], pa.binary())], names=["y", "id", "x"])

    vectors = rows.mapInArrow(run, "y int, id string, x binary")
    found = vectors.groupBy("y", "id").agg(F.min("x").alias("x")).toArrow()  # a row an id, so as many as were chosen
    y = found.column(0).to_numpy()
    x = np.concatenate([np.frombuffer(c.buffers()[2], np.float32, len(c) * N_FEATURES, 4 * c.offset * N_FEATURES) for c in found.column(2).chunks] or [np.zeros(0, np.float32)]).reshape(-1, N_FEATURES)
    order = np.lexsort((np.array(found.column(1).to_pylist(), object).astype(str), y))  # the same order on any run
    order = np.random.default_rng(seed).permutation(order)
    positives, unlabelled = x[order[y[order] == 1]], x[order[y[order] == 0]]
    del found, x
    if not len(positives) or not len(unlabelled):
        return QualityModel(None, 0.5)
    prior = estimate_prior(positives, unlabelled, seed)
    held_p, held_u = len(positives) // 5, len(unlabelled) // 5
    network = fit(positives[held_p:], unlabelled[held_u:], prior, seed)
    network.settle(positives[:held_p] if held_p else positives, unlabelled[:held_u] if held_u else unlabelled, prior)
    return QualityModel(network, prior)


def score(docs: DataFrame, model: QualityModel, columns: list[Column], text: str = "text") -> DataFrame:
    """``columns`` of every row with score (0 to 1) and predicted (1 from 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shape = docs.select(*columns).schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        for batch, texts in pieces(batches, "__text"):
            got = shared.value.scores(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=shape.names)

    return docs.select(*columns, as_bytes(text).alias("__text")).mapInArrow(run, shape)


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least 0.5, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in pieces(batches, text):
            yield masked(batch, shared.value.scores(texts) >= 0.5)

    return docs.mapInArrow(run, docs.schema)

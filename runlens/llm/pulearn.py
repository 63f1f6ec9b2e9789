"""Quality classifier by positive-unlabelled learning (operator 5).

Training sees trusted positives and unlabelled web text, no negatives.  With the class prior pi the risk of a scorer
is  pi R_p(+) + max(0, R_u(-) - pi R_p(-)) : the last part is the risk on negatives, estimated without bias from the
unlabelled rows and held at zero from below, since a model that fits its sample makes the estimate negative.

Features are numbers of the whole text only, cut into bins whose borders are quantiles of the training sample; the
model is linear over the bins.  Both training samples are bounded by ``max_rows``; scoring covers every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textwords import lower_ascii, slices, span_hashes, text_bytes, word_spans

#: Rows of each training sample at most.
MAX_ROWS = 20_000
BINS = 8
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
NAMES = ("words", "word_length", "upper", "digits", "symbols", "marks", "non_ascii", "distinct", "repeats", "top_word", "line_length", "lone_signs", "title", "sentences")

_CLASS = np.full(256, 6, dtype=np.uint8)
_CLASS[65:91] = 0  # A-Z
_CLASS[97:123] = 1  # a-z
_CLASS[48:58] = 2  # digits
_CLASS[[ord(c) for c in "#*$%&|<>@^~=_{}[]\\+"]] = 3  # symbols
_CLASS[[ord(c) for c in "!?.,;:"]] = 4  # marks
_CLASS[0xC0:] = 5  # the first byte of a character outside ASCII


def held_out(doc_id: str) -> Column:
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS).eqNullSafe(F.lit(HELD_OUT))


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, len(NAMES)) numbers of whole texts; an empty text has zeros."""
    starts, ends, first = word_spans(buf, offs)
    words = span_hashes(lower_ascii(buf), starts, ends)
    code = _CLASS[buf]
    up_to = lambda flag: np.concatenate([[0], np.cumsum(flag)])
    classes = np.array([np.diff(up_to(code == k)[offs]) for k in range(6)]).T
    feeds = up_to(buf == 0x0A)
    solid = up_to(np.isin(code, [0, 1, 2, 5]))
    alone = up_to(solid[ends] == solid[starts])
    title = up_to(code[starts] == 0)
    out = np.zeros((len(offs) - 1, len(NAMES)))
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        n = int(b - a)
        if not n:
            continue
        upper, small, digits, symbols, marks, wide = classes[i]
        chars = max(1.0, float((ends[a:b] - starts[a:b]).sum()))
        _, counts = np.unique(words[a:b], return_counts=True)
        out[i] = (
            np.log1p(n), chars / n, upper / max(1.0, upper + small), digits / chars, symbols / chars, marks / chars, wide / chars,
            len(counts) / n, float((words[a + 1 : b] == words[a : b - 1]).mean()) if n > 1 else 0.0, counts.max() / n,
            np.log1p(n / (1 + feeds[offs[i + 1]] - feeds[offs[i]])), (alone[b] - alone[a]) / n, (title[b] - title[a]) / n, marks / n,
        )
    return out


@dataclass
class PUModel:
    borders: np.ndarray  # (features, BINS - 1)
    weights: np.ndarray  # (features * BINS,)
    bias: float
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        return _design(x, self.borders)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.design(x) @ self.weights + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _design(x: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """One column per feature and bin."""
    out = np.zeros((len(x), borders.shape[0] * BINS), dtype=np.float32)
    for j, edges in enumerate(borders):
        out[np.arange(len(x)), j * BINS + np.searchsorted(edges, x[:, j], side="right")] = 1.0
    return out


def _borders(p: np.ndarray) -> np.ndarray:
    """Quantiles of the positives, wide at the ends, where unlabelled rows that are unlike them stand out."""
    return np.quantile(p, [0.002, 0.02, 0.2, 0.5, 0.8, 0.98, 0.998], axis=0).T


def _adam(grad, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = grad(w, t)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray, steps: int = 200) -> float:
    """Share of positives among the unlabelled rows.

    A discriminator of positives against unlabelled rows orders both; the positives are a part of the unlabelled
    rows, so no upper tail of those can hold a smaller share than pi times the positives' tail.  The smallest ratio
    over tails that hold at least 30 % of the positives is the estimate.  Half of the rows train, the other half counts.
    """
    one = lambda x: np.c_[x, np.ones(len(x))]
    fit_p, fit_u, see_p, see_u = one(p[::2]), one(u[::2]), one(p[1::2]), one(u[1::2])

    def grad(w, _):
        g = fit_p.T @ (_sigmoid(fit_p @ w) - 1) / len(fit_p) + fit_u.T @ _sigmoid(fit_u @ w) / len(fit_u)
        return g + 1e-3 * w

    w = _adam(grad, p.shape[1] + 1, steps)
    a, b = np.sort(see_p @ w), np.sort(see_u @ w)
    cuts = np.quantile(a, np.linspace(0.0, 0.7, 15))
    tail = lambda x, t: (len(x) - np.searchsorted(x, t)) / len(x)
    return float(np.clip(min(tail(b, t) / max(tail(a, t), 1e-9) for t in cuts), 0.05, 0.99))


def fit(p: np.ndarray, u: np.ndarray, steps: int = 1500, decay: float = 1e-5, prior: float | None = None) -> PUModel:
    """Non-negative PU learning of feature rows ``p`` (trusted positives) and ``u`` (unlabelled)."""
    if len(p) < 4 or len(u) < 4:  # nothing to learn from: everything scores one half
        return PUModel(np.zeros((len(NAMES), BINS - 1)), np.zeros(len(NAMES) * BINS), 0.0, 0.5)
    borders = _borders(p)
    xp, xu = _design(p, borders), _design(u, borders)
    pi = estimate_prior(xp, xu) if prior is None else prior
    one = lambda x: np.c_[x, np.ones(len(x))]
    ap, au = one(xp), one(xu)
    rng = np.random.default_rng(11)

    def grad(w, t):
        bp, bu = (x[rng.integers(0, len(x), 2048)] for x in (ap, au))
        sp, su = _sigmoid(bp @ w), _sigmoid(bu @ w)
        # logistic loss: -log s for positives, -log(1 - s) for negatives
        g_plus = bp.T @ (sp - 1) / len(bp)
        g_minus = bu.T @ su / len(bu) - pi * (bp.T @ sp) / len(bp)
        minus = -np.log(np.maximum(1 - su, 1e-12)).mean() + pi * np.log(np.maximum(1 - sp, 1e-12)).mean()
        # below zero the estimate is an overfit: step back from it
        g = pi * g_plus + g_minus if minus >= 0 else -g_minus
        return g + decay * np.r_[w[:-1], 0.0]

    w = _adam(grad, ap.shape[1], steps)
    return PUModel(borders, w[:-1], float(w[-1]), pi)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(positive, text) of at most ``max_rows`` trusted positives and as many unlabelled rows, none held out.

    Rows are chosen by the hash of their id.  The chosen ids are at most 2 * max_rows, so they are broadcast.  An id
    that repeats gives one row, of the text whose hash is smallest, so rows are bounded as ids are.
    """
    free = ~held_out("doc_id")
    order = [F.xxhash64(F.col("doc_id"), F.lit(17)), F.col("doc_id")]
    positive = labels.where((F.col("quality") == 1) & free & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(*order).limit(max_rows)
    unlabelled = docs.where(free & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(*order).limit(max_rows)
    ids = positive.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False))).withColumnRenamed("doc_id", "id")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
    one = F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), F.length("text")))
    return rows.groupBy("positive", "doc_id").agg(one.alias("one")).select("positive", "doc_id", "one.text")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> PUModel:
    """Fit on the driver; features are made on the executors, so at most 2 * max_rows short rows come here."""

    def run(batches):
        for part in slices(batches, "text"):
            x = features(*text_bytes(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("positive"), part.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], names=["positive", "doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = training_rows(docs, labels, max_rows).mapInArrow(run, f"positive boolean, doc_id {kind}, x array<double>").toArrow()
    order = np.lexsort((rows.column("doc_id").to_numpy(), rows.column("positive").to_numpy()))
    x = np.array(rows.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(NAMES))[order]
    y = rows.column("positive").to_numpy()[order]
    return fit(x[y], x[~y])


def score_quality(docs: DataFrame, model: PUModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs`` (doc_id, text); no shuffle.

    Null and empty texts are scored like any other, from zero features.  A null doc_id is not held out.  Other
    columns are ignored and never inputs of a score; an empty table gives an empty result.
    """

    def run(batches):
        for part in slices(batches, "text"):
            score = model.score(features(*text_bytes(part.column("text"))))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")

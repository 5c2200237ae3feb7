"""Quality classifier learned from positives and unlabelled text.

A small network of text measures minimises the non-negative unbiased risk of Kiryo et
al. (2017): with class prior pi,

    pi * E_P[loss(+)] + max(0, E_U[loss(-)] - pi * E_P[loss(-)])

Trusted positives are rows labelled 1.  The unlabelled text is web text as it comes: rows
of the documents themselves, of any quality and whether or not somebody labelled them, with
their labels (if any) unseen; negatives are never shown to the learner.  The class prior is
estimated too: a logistic regression of positives against unlabelled text ranks both, each
row by a fit that has not seen it, and the prior is the least ratio U(S) / P(S) of the shares
of unlabelled text and of positives in the regions S of the highest ranks (with its sampling
error added), as U(S) = pi P(S) where only positives live.

The fit is made on the driver from at most ``max_rows`` positives and ``max_rows``
unlabelled rows, in expectation, by the smallest hashes of id and measures (about 250 bytes
each come back; rows that repeat come back once, with their number as a weight).  Measures
and scores cover all rows.  Scores are shifted so that an even chance stands at ``THRESHOLD``.

Edge cases: null text is measured as empty and scored like any other; labels that
contradict each other for one id are left out; without positives every score is 0; with
positives alone the network is fitted all the same; repeated rows give repeated results;
an empty table gives none; language, source and id are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .language_id import remainder
from .quality import CLASSES, INSIDE, SYMBOL, by_text, class_counts, duplicate_lines, repeated

MAX_ROWS = 20_000
THRESHOLD = 0.3
HIDDEN, STEPS, RATE, DECAY, SEED = 24, 400, 0.02, 3.0, 7

NAMES = (
    *(f"share_{c}" for c in CLASSES[1:]),
    "log_words", "word_length", "length_spread", "distinct", "repeated", "dup_lines", "words_a_line", "symbol_words",
    "upper_words", "digit_words", "pipes", "exclamations", "ends_well", "short_words", "long_words", "capital_starts", "symbols_a_word",
)


def measures(texts: pa.Array) -> np.ndarray:
    """One row of measures for each text."""
    raw, off = common.flat(texts)
    classes = class_counts(raw, off)
    chars = np.maximum(classes.sum(1), 1)
    symbols = by_text(SYMBOL[raw], off)
    inside = by_text(INSIDE[raw], off)
    pipes, marks = by_text(raw == ord("|"), off), by_text(raw == ord("!"), off)
    more = np.zeros((len(off) - 1, len(NAMES) - len(CLASSES) + 1))
    data, off = raw.tobytes(), off.tolist()
    for i, (a, b) in enumerate(zip(off, off[1:])):
        text = data[a:b]
        words = text.split()
        n = len(words)
        if not n:
            continue
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        count = np.bincount(ids)
        sizes = np.fromiter(map(len, number), np.int64, len(number))
        mean = (sizes * count).sum() / n
        kinds = np.array([(w.isupper() and len(w) > 1, any(48 <= c <= 57 for c in w), not w[-1:].isalnum() and w[-1] < 128 and w[-1] not in b".,;:!?'\")-", w[-1] in b".!?", w[:1].isupper()) for w in number], float).reshape(-1, 5)
        upper, digit, symbol, ends, capital = (kinds * count[:, None]).sum(0) / n
        lines = max(1, len([x for x in text.split(b"\n") if x.strip()]))
        more[i] = (
            np.log1p(n), mean, np.sqrt(((sizes - mean) ** 2 * count).sum() / n), len(number) / n, repeated(ids) / n, duplicate_lines(text) / lines, np.log1p(n / lines),
            symbol, upper, digit, pipes[i] / n, marks[i] / n, ends, (sizes <= 3) @ count / n, (sizes >= 14) @ count / n, capital, symbols[i] / max(inside[i], 1),
        )
    return np.hstack([classes[:, 1:] / chars[:, None], more])


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.zeros(len(x))
        z = forward(self.layers, np.clip((x - self.mean) / self.spread, -8, 8))[0]
        return sigmoid(z + np.log(THRESHOLD / (1 - THRESHOLD)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2, direct = layers
    h = np.tanh(x @ w1 + b1)
    return h @ w2 + x @ direct + b2[0], h


def adam(layers: list[np.ndarray], gradient, steps: int, rows: int) -> list[np.ndarray]:
    decay = DECAY / max(rows, 1)
    m, v = [np.zeros_like(a) for a in layers], [np.zeros_like(a) for a in layers]
    for t in range(1, steps + 1):
        for k, g in enumerate(gradient(layers)):
            g = g + decay * layers[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            layers[k] = layers[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return layers


def back(layers: list[np.ndarray], x: np.ndarray, h: np.ndarray, dz: np.ndarray) -> list[np.ndarray]:
    """Gradients of the network, given those of its output."""
    _, _, w2, _, _ = layers
    dh = np.outer(dz, w2) * (1 - h * h)
    return [x.T @ dh, dh.sum(0), h.T @ dz, np.array([dz.sum()]), x.T @ dz]


def start(width: int, hidden: int = HIDDEN) -> list[np.ndarray]:
    rng = np.random.default_rng(SEED)
    return [rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), np.zeros(hidden), np.zeros(1), np.zeros(width)]


def risk(layers: list[np.ndarray], p: np.ndarray, wp: np.ndarray, u: np.ndarray, wu: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive and the negative part of the risk with the logistic loss; weights add up to 1."""
    zp, zu = forward(layers, p)[0], forward(layers, u)[0]
    return prior * (wp @ np.logaddexp(0, -zp)), wu @ np.logaddexp(0, zu) - prior * (wp @ np.logaddexp(0, zp))


def risk_gradient(p: np.ndarray, wp: np.ndarray, u: np.ndarray, wu: np.ndarray, prior: float):
    """Gradient of the non-negative risk.  Where the negative part falls below zero, the step
    climbs back along it instead, as the paper does."""

    def gradient(layers):
        zp, hp = forward(layers, p)
        zu, hu = forward(layers, u)
        negative = wu @ np.logaddexp(0, zu) - prior * (wp @ np.logaddexp(0, zp))
        dp_plus = prior * (sigmoid(zp) - 1) * wp
        dp_minus = -prior * sigmoid(zp) * wp
        du = sigmoid(zu) * wu
        if negative >= 0:
            a, b = back(layers, p, hp, dp_plus + dp_minus), back(layers, u, hu, du)
            return [x + y for x, y in zip(a, b)]
        a, b = back(layers, p, hp, dp_minus), back(layers, u, hu, du)
        return [-(x + y) for x, y in zip(a, b)]

    return gradient


def estimate_prior(p: np.ndarray, wp: np.ndarray, u: np.ndarray, wu: np.ndarray) -> float:
    """The least U(S) / P(S) over regions S that a fit of positives against unlabelled text
    ranks highest.  Two fits score each other's rows; a ratio counts with its sampling
    error added, so that small regions don't win by chance."""
    sp, su = np.zeros(len(p)), np.zeros(len(u))
    for k in (0, 1):
        pk, uk, ak, bk = p[k::2], u[k::2], wp[k::2], wu[k::2]
        if not len(pk) or not len(uk):
            return 0.5
        ak, bk = ak / ak.sum() / 2, bk / bk.sum() / 2

        def gradient(layers, pk=pk, uk=uk, ak=ak, bk=bk):
            zp, hp = forward(layers, pk)
            zu, hu = forward(layers, uk)
            a, b = back(layers, pk, hp, (sigmoid(zp) - 1) * ak), back(layers, uk, hu, sigmoid(zu) * bk)
            return [x + y for x, y in zip(a, b)]

        layers = adam(start(p.shape[1]), gradient, STEPS // 2, len(pk))
        # Ranks by the positives of the half make the two fits' scores comparable.
        other = p[1 - k :: 2]
        ranks = np.sort(forward(layers, other)[0])
        for out, x in ((sp, p), (su, u)):
            out[1 - k :: 2] = np.searchsorted(ranks, forward(layers, x[1 - k :: 2])[0]) / max(len(other), 1)
    best = 1.0
    for t in np.unique(np.quantile(sp, np.linspace(0, 0.5, 51))):
        ps, us = wp @ (sp >= t), wu @ (su >= t)
        if ps > 0:
            best = min(best, us / ps + np.sqrt(max(us * (1 - us), 0.0) * (wu @ wu)) / ps)
    return float(np.clip(best, 0.05, 0.98))


def fit(p: np.ndarray, wp: np.ndarray, u: np.ndarray, wu: np.ndarray) -> Model:
    """Measures of trusted positives and of unlabelled rows, and how often each stands."""
    if not len(p):
        return Model(np.zeros(0), np.ones(0), [], 0.0)
    if not len(u):
        u, wu = p, wp
    wp, wu = wp / wp.sum(), wu / wu.sum()
    mean = wu @ u
    spread = np.maximum(np.sqrt(wu @ (u - mean) ** 2), 1e-6)
    p, u = (np.clip((x - mean) / spread, -8, 8) for x in (p, u))
    prior = estimate_prior(p, wp, u, wu)
    return Model(mean, spread, adam(start(p.shape[1]), risk_gradient(p, wp, u, wu, prior), STEPS, len(u)), prior)


def sample(rows: DataFrame, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Measures (``x``) and numbers of about ``max_rows`` different rows at most, by hash."""
    n = rows.count()
    if n > max_rows:  # a share of the hashes, so no task sends more than its part
        rows = rows.where(F.pmod("h", F.lit(1 << 30)) < F.lit(int((1 << 30) * max_rows / n)))
    got = rows.groupBy("h", "x").agg(F.count(F.lit(1)).alias("n")).toPandas()
    got = got.assign(first=got["x"].map(tuple)).sort_values(["h", "first"], ignore_index=True)
    return np.array(got["x"].tolist(), float).reshape(-1, len(NAMES)), got["n"].to_numpy(float)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn_from: Column | None = None) -> DataFrame:
    """``id, score, predicted`` of every row.  ``labels`` are the rows that may be learned from;
    ``learn_from`` says which documents are unlabelled text (all, if it isn't given)."""
    spark = docs.sparkSession

    def make():
        def work(texts):
            x = measures(texts)
            return [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))]

        return work

    usable = F.lit(True) if learn_from is None else F.coalesce(learn_from, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), usable.alias("usable"), F.col(text_col).alias("text"))
    held = common.materialise(common.map_texts(rows, make, [("x", T.ArrayType(T.DoubleType()))], "id", "text", keep=["usable"]).withColumn("h", F.xxhash64(F.col("id").cast("string"), "x")), "measures")
    sure = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.min(label_col).alias("low"), F.max(label_col).alias("high")).where("low = high and high = 1")
    positive = held.join(sure, F.col("id") == F.col("l_id"), "left_semi")
    model = spark.sparkContext.broadcast(fit(*sample(positive, max_rows), *sample(held.where("usable"), max_rows)))
    schema = T.StructType([T.StructField(id_col, held.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches):
        for b in batches:
            if b.num_rows:
                s = model.value.scores(b.column(1).flatten().to_numpy().reshape(-1, len(NAMES)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=schema.names)

    return held.select("id", "x").mapInArrow(common.tidied(score), schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    may = remainder("doc_id", 5) != 0
    got = classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels").where(may), learn_from=may)
    return got.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")

"""Soft-membership mixing: posteriors of domains, then document rates that meet token targets.

A multinomial logistic classifier, trained on a bounded sample of the ``labels`` table, gives every
document a posterior p over domains (clean, low, toxic).  With t its words, rates r >= 0 minimise

    sum_k (sum_d r_d t_d p_dk - T_k)^2 / (2 C_k) + RIDGE / 2 * sum_d t_d (r_d - 1)^2

where C_k = sum_d t_d p_dk is what the corpus holds and T_k the target.  It is solved by projected gradient in its lazy
form: gradients of the least-squares part add up in one vector of K numbers, lambda, and the projection of
1 - p_d.lambda onto [0, most] is a document's rate.  A step is scaled by the K x K curvature over the documents that are at no
bound and halved until the dual objective falls, so a handful of rounds reach the optimum.  A round is one aggregation
of K + K (K + 1) / 2 + 1 sums over the stored (words, posterior) table; no state of documents is kept or
collected, and a lost executor costs a task retry.  Rounds end where every domain's optimality residual is below TOLERANCE of its
tokens; a fit that is not there after ROUNDS rounds raises.

Features: hashed words (letters and digits, lower case) and runs of capitals and marks, with
log counts scaled to length one.

The sample takes at most ``SAMPLE_DOCS`` labelled documents of each domain, those with the smallest
hash of doc_id.  The driver gets their features, at most FEATURES numbers a document, and never a text.

Defined results: null and empty texts have 0 words and the prior posterior; repeated rows and copies
get equal rates; labels with nulls are left out; without usable labels every document is clean; a target
for a domain that the corpus lacks is unreachable and left out.  A rate above one stands for copies of its document
(``copies_of``); ``kept_by_rate`` has each row at most once, so there the fit is bounded to rates of 0 to 1, and a domain of
which the corpus holds less than its target gets what there is.  An empty table gives no rows.  Columns of the
input stay; ``n_tokens``, ``posterior`` and ``rate`` replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DOMAINS = ("clean", "low", "toxic")
#: Shares of the tokens wanted; the first domain keeps the tokens that it has.
TARGETS = {"clean": 0.97, "low": 0.03, "toxic": 0.0}
SAMPLE_DOCS = 800
FEATURES = 1 << 15
RIDGE = 1e-3
ROUNDS = 100
TOLERANCE = 1e-9

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
#: Capitals and marks: runs of them with every capital alike.
_ODD = ~_WORD
_ODD[:33] = False
_ODD[65:91] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = 65


class Model(NamedTuple):
    #: Shape (FEATURES, domains).
    weights: np.ndarray
    bias: np.ndarray


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value, words of each text) of a string column."""
    off, raw = common.utf8(text)
    n = len(off) - 1
    rows, ids = [], []
    for salt, seen, kind in ((1, _LOWER[raw], _WORD), (2, _SHAPE[raw], _ODD)):
        h, _, _, first = common.words(off, seen, kind)
        rows.append(np.repeat(np.arange(n), np.diff(first)))
        ids.append(common.mix(h + np.uint64(salt)))
        if salt == 1:
            n_words = np.diff(first)
    key = (np.concatenate(rows).astype(np.uint64) * np.uint64(FEATURES) + np.concatenate(ids) % np.uint64(FEATURES)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    row, feature = key // FEATURES, key % FEATURES
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(row, value * value, n))
    return row, feature, value / norm[row], n_words


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _logits(m: Model, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(row, value * m.weights[feature, k], n) for k in range(len(m.bias))], 1) + m.bias


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, feature, value, _ = features(b.column("text"))
        edge = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(edge, pa.array(x)) for x in (feature.astype(np.int32), value)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_id", "domain", "unit", "h")), *lists], ["_id", "domain", "unit", "h", "feature", "value"])


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Fit on at most ``sample_docs`` labelled documents of each domain; of several texts with one doc_id one is taken."""
    spark = docs.sparkSession
    common.prepare(spark)
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 0)
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), domain.alias("domain")).filter("_id is not null and domain is not null")
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    if not counts:
        return None
    unit = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    known = known.distinct().withColumn("unit", unit)
    picked = [r for k in counts for r in known.filter(F.col("domain") == k).orderBy("unit", "_id").limit(sample_docs).collect()]
    wanted = spark.createDataFrame(picked, known.schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(wanted), "_id")  # at most sample_docs rows a domain
    rows = rows.select("_id", "domain", "unit", F.xxhash64("text").alias("h"), "text").mapInArrow(_sparse, "_id long, domain int, unit double, h long, feature array<int>, value array<double>")
    got = rows.groupBy("domain", "unit", "_id").agg(F.min_by(F.struct("feature", "value"), "h").alias("x")).collect()
    got.sort(key=lambda r: (r["domain"], r["unit"], r["_id"]))
    if not got:
        return None
    y = np.array([r["domain"] for r in got])
    sizes = [len(r["x"]["feature"]) for r in got]
    feature = np.concatenate([np.array(r["x"]["feature"], np.int64) for r in got])
    value = np.concatenate([np.array(r["x"]["value"], float) for r in got])
    return _fit(np.repeat(np.arange(len(y)), sizes), feature, value, y, np.array([float(counts.get(k, 0)) for k in range(len(DOMAINS))]))


def _fit(row: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, prior: np.ndarray, rounds: int = 150, rate: float = 20.0, decay: float = 1e-5) -> Model:
    """Gradient descent with momentum; classes weigh the same, then the bias takes the labels' shares.

    Every fifth text is held out to choose the temperature, so that posteriors are neither timid nor overconfident.
    """
    n, k = len(y), len(DOMAINS)
    present = np.bincount(y, minlength=k) > 0
    aside = np.arange(n) % 5 == 4
    if len(np.unique(y[~aside])) < present.sum():
        aside[:] = False
    goal = np.eye(k)[y]
    weight = np.where(aside, 0, (1 / np.maximum(np.bincount(y[~aside], minlength=k), 1))[y])[:, None] / present.sum()
    on = ~aside[row]
    r, f, x = row[on], feature[on], value[on]
    m = Model(np.zeros((FEATURES, k)), np.where(present, 0.0, -30.0))
    v, vb = np.zeros_like(m.weights), np.zeros(k)
    for _ in range(rounds):
        wrong = (_softmax(_logits(m, r, f, x, n)) - goal) * weight
        for c in range(k):
            v[:, c] = 0.9 * v[:, c] - rate * (np.bincount(f, x * wrong[r, c], FEATURES) + decay * m.weights[:, c])
        vb = 0.9 * vb - 0.1 * wrong.sum(0) * present
        m.weights[:] += v
        m.bias[:] += vb
    warm = 1.0
    if aside.any():
        z = _logits(m, row, feature, value, n)[aside]
        loss = {t: -np.log(_softmax(z * t)[np.arange(len(z)), y[aside]] + 1e-12).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0, 6.0, 8.0)}
        warm = min(loss, key=loss.get)
    share = np.where(present, prior / max(prior.sum(), 1), 1)
    return Model(m.weights * warm, m.bias * warm + np.where(present, np.log(np.maximum(share, 1e-9) * present.sum()), 0))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with n_tokens and posterior."""
    spark = docs.sparkSession
    common.prepare(spark)
    docs = docs.drop("n_tokens", "posterior", "rate")
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            row, feature, value, n_words = features(b.column("text"))
            if m is None:
                p = np.tile(np.eye(len(DOMAINS))[0], (b.num_rows, 1))
            else:
                p = _softmax(_logits(m, row, feature, value, b.num_rows))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(DOMAINS), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n_words, pa.int64()), lists], [*b.schema.names, "n_tokens", "posterior"])

    return docs.mapInArrow(score, schema)


class Fit(NamedTuple):
    """Rates by ``pull`` (lambda above); expected totals, targets and optimality residuals by domain, the latter as shares of what the corpus holds."""

    pull: list[float]
    totals: list[float]
    goals: list[float]
    residuals: list[float]
    rounds: int


def _free_rate(pull: list[float]) -> Column:
    return F.lit(1.0) - sum((F.col("posterior")[k] * F.lit(float(x)) for k, x in enumerate(pull)), F.lit(0.0))


def rate_of(fit: Fit, most: float | None = None) -> Column:
    """A document's fitted rate, at most ``most``, from its posterior."""
    rate = F.greatest(F.lit(0.0), _free_rate(fit.pull))
    return rate if most is None else F.least(F.lit(float(most)), rate)


def _round(posts: DataFrame, pull: np.ndarray, most: float | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected totals, curvature over the documents at no bound, and the documents' part of the dual objective."""
    k = range(len(DOMAINS))
    x, t, p = _free_rate(pull.tolist()), F.col("n_tokens"), [F.col("posterior")[i] for i in k]
    top = F.lit(float("inf") if most is None else float(most))
    r = F.least(top, F.greatest(F.lit(0.0), x))
    inside = F.when((x > 0) & (x < top), t).otherwise(0)
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0.0)).cast("double").alias(name)
    got = posts.agg(
        *(total(r * t * p[i], f"s{i}") for i in k), *(total(inside * p[i] * p[j], f"a{i}{j}") for i in k for j in k if i <= j),
        total(t * F.when(x < top, r * r / 2).otherwise(F.lit(most or 0.0) * x - F.lit((most or 0.0) ** 2 / 2)), "psi"),
    ).first()
    return np.array([got[f"s{i}"] for i in k]), np.array([[got[f"a{min(i, j)}{max(i, j)}"] for j in k] for i in k]), got["psi"]


def fit_rates(posts: DataFrame, targets: dict[str, float] | None = None, rounds: int = ROUNDS, most: float | None = None) -> Fit:
    """Fit the rates of (n_tokens, posterior) rows to their optimum."""
    targets = targets or TARGETS
    pull = np.zeros(len(DOMAINS))
    held = np.array(posts.agg(*(F.coalesce(F.sum(F.col("n_tokens") * F.col("posterior")[k]), F.lit(0.0)) for k in range(len(DOMAINS)))).first(), float)
    share = np.array([targets.get(k, 0.0) for k in DOMAINS])
    lead = int(share.argmax())
    goal = share * held[lead] / share[lead] if share[lead] > 0 else share
    there = held > 1e-9 * max(held.sum(), 1e-300)
    size = np.where(there, held, 1.0)
    s, a, psi = _round(posts, pull, most)
    for n in range(rounds):
        # Gradient of the dual objective; zero where the rates are optimal.
        g = np.where(there, RIDGE * size * pull + goal - s, 0.0)
        left = np.abs(g) / size
        if left.max() <= TOLERANCE:
            return Fit(pull.tolist(), s.tolist(), goal.tolist(), left.tolist(), n)
        step = np.zeros_like(pull)
        step[there] = -np.linalg.solve((RIDGE * np.diag(size) + a)[np.ix_(there, there)], g[there])
        value = psi + (goal * pull + RIDGE / 2 * size * pull * pull)[there].sum()
        for half in range(40):
            new = pull + step / 2**half
            s2, a2, psi2 = _round(posts, new, most)
            value2 = psi2 + (goal * new + RIDGE / 2 * size * new * new)[there].sum()
            if value2 <= value + 1e-4 * (g @ step) / 2**half + 1e-12 * abs(value):
                break
        pull, s, a, psi = new, s2, a2, psi2
    raise RuntimeError(f"rates are not at their optimum after {rounds} rounds")


def unit_of(doc_id: Column) -> Column:
    """A number in (0, 1] fixed by the id."""
    return (F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(1 << 30)) + 1) / float(1 << 30)


def copies_of(rate: Column, doc_id: Column) -> Column:
    """How often a document stands in the mix: its rate rounded down, and once more where the rest reaches its number."""
    whole = F.floor(rate)
    return (whole + F.when(rate - whole >= unit_of(doc_id), 1).otherwise(0)).cast("long")


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, posterior and rate of every document."""
    posts = common.stored(scored(docs.select("doc_id", "text"), train(docs, labels)).drop("text"), "posteriors")
    return posts.withColumn("rate", rate_of(fit_rates(posts, targets)))


def kept_by_rate(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` thinned to rates of 0 to 1: a document stays where its rate reaches its fixed number in (0, 1]."""
    model = train(docs, labels)
    posts = common.stored(scored(docs.select("text"), model).drop("text"), "posteriors")
    fit = fit_rates(posts, targets, most=1.0)
    names = docs.columns
    # The stage's own columns go by other names where the input has them too.
    inner = docs.select(*(F.col(c).alias(f"_own_{c}" if c in ("n_tokens", "posterior", "rate") else c) for c in names))
    kept = scored(inner, model).filter(rate_of(fit, 1.0) >= unit_of(F.col("doc_id")))
    return kept.select(*(F.col(f"_own_{c}").alias(c) if f"_own_{c}" in inner.columns else F.col(c) for c in names))


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_documents(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", "n_tokens", *(F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate",
        (F.col("rate") >= unit_of(F.col("doc_id"))).alias("kept"), copies_of(F.col("rate"), F.col("doc_id")).alias("copies"),
    )

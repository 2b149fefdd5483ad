"""Quality classifier from positive and unlabelled texts.

Non-negative unbiased risk: with class prior p, the risk of calling positives
negative is taken out of the risk of calling unlabelled texts negative, and the
difference is not let fall under zero. The model is additive: one weight for each
quantile bin of each text statistic, so the score is a sum of looked-up weights. Only the positives are
a bounded sample: bins, the class prior and each step of the descent are sums over all unlabelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .quality_rules import labelled_stats, with_stats
from .textstats import NAMES

USED = NAMES[5:]


def _binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Indices of the bins, one column per statistic, numbered through all statistics."""
    out, start = np.empty(values.shape, np.int64), 0
    for k, edge in enumerate(edges):
        out[:, k] = start + np.searchsorted(edge, values[:, k], side="left")
        start += len(edge) + 1
    return out


@dataclass
class Model:
    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, values: np.ndarray) -> np.ndarray:
        z = self.weights[_binned(values, self.edges)].sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def parts(bins: np.ndarray, model: Model, curved: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums over rows of the loss of calling them negative, log(1 + e^z), of its gradient and of its Hessian.

    The last entry belongs to the bias.
    """
    width = len(model.weights) + 1
    z = model.weights[bins].sum(axis=1) + model.bias
    p = _sigmoid(z)
    grad = np.append(np.bincount(bins.ravel(), np.repeat(p, bins.shape[1]), width - 1), p.sum())
    hess = np.zeros((width, width))
    if curved:
        for at in range(0, len(bins), 2048):
            some, s = bins[at : at + 2048], (p * (1 - p))[at : at + 2048]
            x = np.zeros((len(some), width))
            x[np.arange(len(some))[:, None], some] = 1
            x[:, -1] = 1
            hess += x.T @ (x * s[:, None])
    return float(np.logaddexp(0, z).sum()), grad, hess


def descend(model: Model, positive: np.ndarray, unlabelled, prior: float, ridge: float = 1e-3, rounds: int = 20) -> Model:
    """Newton's method on the unbiased risk, which the logistic loss makes convex: with log(1 + e^-z) = log(1 + e^z) - z the
    positives' part is linear. ``unlabelled(model)`` gives rows, loss, gradient and Hessian over all unlabelled rows.

    The negatives' risk is kept from falling under zero, where the model would only learn the positives by heart: after a
    step that would, a shorter one is tried, and then the ridge grows, which draws all weights back.
    """
    n, width = len(positive), len(model.weights)
    linear = np.append(np.bincount(positive.ravel(), minlength=width), n) * prior / n
    ridge = np.append(np.full(width, ridge + 1 / n), 1e-9)
    at = np.append(model.weights, model.bias)
    m, _, grad, hess = unlabelled(model)
    pace = 1.0
    for _ in range(rounds):
        step = np.linalg.solve(hess / m + np.diag(ridge), grad / m - linear + ridge * at)
        if np.abs(step).max() < 1e-4:
            break
        step *= pace * min(1.0, 4.0 / np.abs(step).max())
        tried = replace(model, weights=(at - step)[:-1], bias=float((at - step)[-1]))
        m, other, new_grad, new_hess = unlabelled(tried)
        if other / m - prior * parts(positive, tried, False)[0] / n < 0:
            pace /= 4
            if pace < 0.05:
                ridge, pace = np.append(2 * ridge[:-1], ridge[-1]), 1.0
            continue
        pace = min(1.0, 2 * pace)
        model, at, grad, hess = tried, at - step, new_grad, new_hess
    return model


def class_prior(positive: np.ndarray, held: np.ndarray, edges: np.ndarray, least: float = 0.2) -> float:
    """Share of positives among the unlabelled: the least ratio of the unlabelled's to the positives' share above a score.

    Where no negative scores, that ratio is the prior, and elsewhere it is higher. ``held`` counts the unlabelled between the
    ``edges``; scores above which fewer than ``least`` of the positives lie are left out. As the scores were fitted to these
    positives, the estimate is rather low, which keeps the negatives' risk away from zero.
    """
    above = np.cumsum(held[::-1])[::-1] / max(held.sum(), 1)
    mine = np.array([(positive >= e).mean() for e in np.append(-np.inf, edges)])
    known = mine >= least
    return float(np.clip((above[known] / mine[known]).min(), 0.02, 0.98)) if known.any() else 0.5


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, bins: int = 12, rounds: int = 25) -> Model:
    """The model of rows in memory: one row per text, one column for each of USED."""
    pooled = unlabelled if len(unlabelled) else positive
    grid = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(pooled[:, k], grid)) if len(pooled) else np.zeros(1) for k in range(len(USED))]
    model = _start(edges, prior)
    if not len(positive) or not len(unlabelled):
        return model
    rows = _binned(unlabelled, edges)
    return descend(model, _binned(positive, edges), lambda m: (len(rows), *parts(rows, m)), prior, rounds=rounds)


def _start(edges: list[np.ndarray], prior: float) -> Model:
    bias = float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
    return Model(edges, np.zeros(sum(len(e) + 1 for e in edges)), bias, prior)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    most_labelled: int = 8_000,
    bins: int = 12,
    prior: float | None = None,
    text: str = "text",
) -> Model:
    """Fit on trusted positives (``quality`` 1) and all texts of ``docs`` as the unlabelled.

    ``most_labelled`` bounds the labelled documents used, about; only their positives count. Bin edges and the unlabelled side
    of the risk come from all rows. The class prior is estimated from both (``class_prior``) unless given, by a
    first model that tells positives from unlabelled texts. Without positives or documents the model scores 0.5 or the
    prior given. Repeated rows count each; of a labelled id's rows one does.
    """
    seen = written(with_stats(docs, (), text).select(*USED), "pu-stats")
    return fit_stats(seen, labelled_stats(docs, labels, "quality", most_labelled, USED, text), bins, prior)


def fit_stats(seen: DataFrame, labelled: DataFrame, bins: int = 12, prior: float | None = None) -> Model:
    """As :func:`fit`, from stored statistics of the unlabelled texts, and those of the labelled ones with their ``label``."""
    seen = seen.select(*USED)
    positive = labelled.where("label = 1").select("doc_id", *USED).toPandas().sort_values("doc_id")[list(USED)].to_numpy(float)
    grid = np.linspace(0, 1, bins + 1)[1:-1].tolist()
    found = seen.agg(*[F.percentile_approx(n, F.lit(grid), 2_000).alias(n) for n in USED]).first()
    edges = [np.unique(np.array(e, float)) if e else np.zeros(1) for e in found]
    if not len(positive) or found[0] is None:
        return _start(edges, 0.5 if prior is None else prior)
    mine = _binned(positive, edges)

    def summed(kernel) -> np.ndarray:
        """Sums by place of what ``kernel`` makes of batches of bins: one row for each place and task, summed by Spark."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                values = np.stack([batch.column(k).to_numpy() for k in range(len(USED))], axis=1)
                made = kernel(_binned(values, edges))
                out = made if out is None else out + made
            if out is not None:
                yield pa.record_batch({"i": pa.array(np.flatnonzero(out), pa.int32()), "v": out[np.flatnonzero(out)]})

        rows = seen.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(max((r["i"] for r in rows), default=0) + 1)
        for r in rows:
            total[r["i"]] = r["v"]
        return total

    def unlabelled(model: Model):
        width = len(model.weights) + 1
        upper = np.triu_indices(width)

        def kernel(rows: np.ndarray) -> np.ndarray:
            loss, grad, hess = parts(rows, model)
            return np.concatenate([[len(rows), loss], grad, hess[upper]])

        total = np.zeros(2 + width + len(upper[0]))
        got = summed(kernel)
        total[: len(got)] = got
        hess = np.zeros((width, width))
        hess[upper] = total[2 + width :]
        return total[0], total[1], total[2 : 2 + width], hess + np.triu(hess, 1).T

    if prior is None:
        apart = descend(_start(edges, 0.5), mine, unlabelled, 0.5, rounds=6)
        scores = apart.weights[mine].sum(axis=1)
        cuts = np.unique(np.quantile(scores, np.linspace(0, 1, 101)[1:-1]))
        kernel = lambda rows: np.bincount(np.searchsorted(cuts, apart.weights[rows].sum(axis=1), side="right"), minlength=len(cuts) + 1).astype(float)
        held = np.zeros(len(cuts) + 1)
        got = summed(kernel)
        held[: len(got)] = got
        prior = class_prior(scores, held, cuts)
    return descend(_start(edges, prior), mine, unlabelled, prior)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``score`` (0 to 1; higher: likelier good) of every row.

    A null text scores like an empty one. Repeated rows get equal scores, an empty
    table an empty result. Other columns are not read.
    """
    return scored(with_stats(docs, keep, text), model, keep)


def scored(seen: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As :func:`score`, from stored statistics."""
    taken = seen.select(*keep, *USED)
    schema = ", ".join(f"`{c}` {t}" for c, t in taken.dtypes[: len(keep)]) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([batch.column(len(keep) + k).to_numpy() for k in range(len(USED))], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(model.scores(values))], names=[*keep, "score"])

    return taken.mapInArrow(run, schema)

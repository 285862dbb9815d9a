"""Penalised logistic fits by Newton steps, many at once, with a record of how each ended.

Rows carry the number of the first fit that they belong to (``_period``); fit k is trained on all rows of numbers up to
k. An iteration is one pass over the rows for all fits that are still under way: a task turns its rows into the loss,
gradient and curvature sums of every fit by matrix products and emits one small row per fit, Spark adds these up, and the
driver solves one system per fit. Rows are neither shuffled nor multiplied by the fits; the driver sees sums only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ITERATIONS = 60
#: Largest gradient entry, per training row, at which a fit counts as converged.
GRADIENT_TOLERANCE = 1e-10
#: One fit in so many is made first; the others start from the nearest of these before them.
STRIDE = 8


@dataclass(frozen=True)
class Fit:
    """Weights (intercept, slopes) on the standardised scale, and how the fit ended."""

    weights: np.ndarray
    gradient_norm: float
    iterations: int
    converged: bool


@dataclass(frozen=True)
class Moments:
    """Rows, positives, mean and deviation of each feature of one fit; 1 stands for a zero deviation."""

    n: float
    positives: float
    mean: np.ndarray
    deviation: np.ndarray

    def to_standard(self) -> np.ndarray:
        """Matrix that takes (1, raw features) to (1, standardised features)."""
        width = len(self.mean) + 1
        change = np.zeros((width, width))
        change[0, 0] = 1.0
        change[1:, 0] = -self.mean / self.deviation
        change[1:, 1:] = np.diag(1.0 / self.deviation)
        return change


def _partial_sums(batches: Iterable[pa.RecordBatch], active: np.ndarray, weights: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Loss, gradient and upper curvature triangle of each active fit over this task's rows; weights are on the raw scale."""
    upper = np.triu_indices(width)
    total = np.zeros((len(active), 1 + width + len(upper[0])))
    for batch in batches:
        columns = [np.asarray(batch.column(k), dtype=float) for k in range(batch.num_columns)]
        period, label = columns[0], columns[1]
        x = np.column_stack([np.ones(len(label)), *columns[2:]])
        inside = period[:, None] <= active[None, :]
        score = x @ weights.T
        chance = 1.0 / (1.0 + np.exp(-np.clip(score, -700, 700)))
        loss = np.where(inside, np.logaddexp(0.0, score) - label[:, None] * score, 0.0)
        residual = np.where(inside, chance - label[:, None], 0.0)
        curvature = np.where(inside, chance * (1.0 - chance), 0.0)
        total[:, 0] += loss.sum(axis=0)
        total[:, 1 : 1 + width] += residual.T @ x
        total[:, 1 + width :] += curvature.T @ (x[:, upper[0]] * x[:, upper[1]])
    yield pa.RecordBatch.from_arrays(
        [pa.array(active.astype(np.int32)), pa.array(list(total), type=pa.list_(pa.float64()))], ["at", "sums"]
    )


def _evaluate(rows: DataFrame, active: np.ndarray, weights: np.ndarray, width: int) -> dict[int, np.ndarray]:
    length = 1 + width + width * (width + 1) // 2
    partial = rows.mapInArrow(lambda batches: _partial_sums(batches, active, weights, width), "at int, sums array<double>")
    added = partial.groupBy("at").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(length)]).alias("sums"))
    return {r["at"]: np.array(r["sums"]) for r in added.collect()}


def fit_all(
    rows: DataFrame,
    moments: dict[int, Moments],
    c: float,
    starts: dict[int, np.ndarray] | None = None,
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = GRADIENT_TOLERANCE,
) -> dict[int, Fit]:
    """All fits of ``moments`` on ``rows`` (_period, _label, raw features): L2 penalty 1 / (2c), intercept free.

    Every ``STRIDE``-th fit starts from ``starts`` (standardised weights) or zero, and the rest from the optimum of the last
    of these before it. A step that does not lower the loss is halved. A fit that has not converged within
    ``max_iterations`` passes keeps its best weights and says so.
    """
    numbers = sorted(moments)
    first = numbers[::STRIDE]
    found = _newton(rows, {at: moments[at] for at in first}, c, starts or {}, max_iterations, tolerance)
    begun = dict(starts or {})
    for at in numbers:
        if at not in found and at not in begun:
            before = max(k for k in first if k < at)
            raw = moments[before].to_standard().T @ found[before].weights
            begun[at] = np.linalg.solve(moments[at].to_standard().T, raw)
    rest = {at: moments[at] for at in numbers if at not in found}
    return found | _newton(rows, rest, c, begun, max_iterations, tolerance)


def _newton(rows: DataFrame, moments: dict[int, Moments], c: float, starts: dict[int, np.ndarray], max_iterations: int, tolerance: float) -> dict[int, Fit]:
    if not moments:
        return {}
    width = 1 + len(next(iter(moments.values())).mean)
    upper = np.triu_indices(width)
    penalty = np.diag([0.0] + [1.0 / c] * (width - 1))
    standard = {at: m.to_standard() for at, m in moments.items()}
    best: dict[int, tuple[np.ndarray, float]] = {at: (np.zeros(width), np.inf) for at in moments}
    trial = {at: starts.get(at, np.zeros(width)) for at in moments}
    ended: dict[int, Fit] = {}
    active = list(moments)
    for iteration in range(1, max_iterations + 1):
        if not active:
            break
        raw = np.array([standard[at].T @ trial[at] for at in active])
        sums = _evaluate(rows, np.array(active), raw, width)
        remaining = []
        for at in active:
            change, weights = standard[at], trial[at]
            loss = sums[at][0] + 0.5 * weights @ penalty @ weights
            kept, kept_loss = best[at]
            if loss > kept_loss + 1e-9 * abs(kept_loss):
                trial[at] = 0.5 * (kept + weights)
                remaining.append(at)
                continue
            gradient = change @ sums[at][1 : 1 + width] + penalty @ weights
            curvature = np.zeros((width, width))
            curvature[upper] = sums[at][1 + width :]
            curvature = curvature + np.triu(curvature, 1).T
            best[at] = (weights, loss)
            norm = float(np.abs(gradient).max())
            ended[at] = Fit(weights, norm, iteration, norm <= tolerance * max(1.0, moments[at].n))
            if not ended[at].converged:
                step = np.linalg.solve(change @ curvature @ change.T + penalty + 1e-12 * np.eye(width), gradient)
                trial[at] = weights - step
                remaining.append(at)
        active = remaining
    return ended


def cumulative_moments(rows: DataFrame, names: Sequence[str], fits: int) -> dict[int, Moments]:
    """Moments of each fit number below ``fits`` that has both classes, from one aggregation by number."""
    per_period = rows.groupBy("_period").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_label").alias("positives"),
        F.array(*[F.avg(c) for c in names]).alias("means"),
        F.array(*[F.var_pop(c) for c in names]).alias("variances"),
    )
    found = {r["_period"]: r for r in per_period.collect()}
    n, positives = 0, 0.0
    mean, squares = np.zeros(len(names)), np.zeros(len(names))
    moments = {}
    for at in range(fits):
        if at in found:
            part = found[at]
            m, other = part["n"], np.array(part["means"])
            delta = other - mean
            squares = squares + np.array(part["variances"]) * m + delta**2 * (n * m / (n + m))
            mean = mean + delta * (m / (n + m))
            n, positives = n + m, positives + part["positives"]
        if 0 < positives < n:
            # A flag that is constant so far has zero deviation up to rounding; it is scaled by 1 and gets coefficient 0.
            deviation = np.sqrt(squares / n)
            moments[at] = Moments(n, positives, mean.copy(), np.where(deviation > 1e-9, deviation, 1.0))
    return moments

"""Sums for many models in one pass over the rows.

Fits of few unknowns need a few sums per model and step: loss, gradient, second moments. All models of a cross-validation
or an ablation read the same rows, so one scan serves them all: a task multiplies its Arrow batches with every
model's parameters and gives one row of sums per model, and these are added up per model. Work grows
with rows times models, the exchange with tasks times models, and a step is one job, however many models there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame

Batch = dict[str, np.ndarray]


def _numbers(column: pa.Array, rows: int) -> np.ndarray:
    """A numeric column, or a column of lists of one length as a matrix."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
    return column.to_numpy(zero_copy_only=False)


def model_sums(data: DataFrame, models: int, width: int, kernel: Callable[[Batch], np.ndarray]) -> np.ndarray:
    """(models, width) sums over all rows of what ``kernel`` makes of a batch of them, given as arrays by column name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((models, width))
        for b in batches:
            if b.num_rows:
                total += kernel({name: _numbers(b.column(name), b.num_rows) for name in b.schema.names})
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(models, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["model", "sums"]
        )

    parts = data.mapInArrow(run, "model int, sums array<double>")
    out = np.zeros((models, width))
    for row in parts.groupBy("model").agg(Summarizer.sum(array_to_vector("sums")).alias("sums")).collect():
        out[row["model"]] = row["sums"].toArray()
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


class LogitTask:
    """One penalised softmax regression among many: its columns, the fold it leaves out, its classes and row weights.

    With two classes the first one's score is 0, as a binomial regression has it; the constant is last and has no penalty.
    """

    def __init__(self, columns: list[int], fold: int | None, counts: dict[int, int], penalty: float) -> None:
        self.columns, self.fold, self.penalty = columns, fold, penalty
        self.classes = sorted(k for k, n in counts.items() if n)
        rows = sum(counts.values())
        self.balance = np.zeros(max(counts, default=0) + 1)
        for k in self.classes:
            self.balance[k] = rows / (len(self.classes) * counts[k])
        self.free = len(self.classes) - (len(self.classes) == 2)
        self.size = len(columns) + 1
        self.best = np.zeros((self.free, self.size))
        self.now, self.value, self.steps, self.moved = self.best, np.inf, 0, np.inf
        self.slope = np.zeros(self.free * self.size)

    @property
    def width(self) -> int:
        n = self.free * self.size
        return 1 + n + n * n

    @property
    def done(self) -> bool:
        return not self.free or self.moved < 1e-9

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.now.T
        if self.free < len(self.classes):
            z = np.c_[np.zeros(len(x)), z]
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def sums(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Loss, slope and curvature of the weighted rows that train this model."""
        mine = fold != self.fold
        x, y = np.c_[x[mine][:, self.columns], np.ones(mine.sum())], y[mine]
        w, p = self.balance[y], self.probabilities(x)
        at = np.searchsorted(self.classes, y)
        loss = -(w * np.log(np.maximum(p[np.arange(len(y)), at], 1e-300))).sum()
        rest = p.copy()
        rest[np.arange(len(y)), at] -= 1
        first = len(self.classes) - self.free
        spread = (p[:, first:, None] * x[:, None, :]).reshape(len(x), -1)
        curve = -(spread * w[:, None]).T @ spread
        whole = spread.T @ (x * w[:, None])
        for k in range(self.free):
            own = slice(k * self.size, (k + 1) * self.size)
            curve[own, own] += whole[own]
        return np.concatenate([[loss], ((rest[:, first:] * w[:, None]).T @ x).ravel(), curve.ravel()])

    def step(self, sums: np.ndarray) -> None:
        """A Newton step on the sums at ``now``; half way back if the last one went too far."""
        self.steps += 1
        n = self.free * self.size
        weights = np.tile(np.r_[np.full(self.size - 1, self.penalty), 0.0], self.free)
        value = sums[0] + 0.5 * float(weights @ self.now.ravel() ** 2)
        if value > self.value + 1e-9 * max(1.0, abs(self.value)):
            new = (self.best + self.now) / 2
        else:
            self.best, self.value = self.now, value
            self.slope = sums[1 : 1 + n] + weights * self.now.ravel()
            curve = sums[1 + n : 1 + n + n * n].reshape(n, n) + np.diag(weights)
            constants = np.zeros(n)
            constants[self.size - 1 :: self.size] = 1.0
            if self.free == len(self.classes):  # shifting all constants changes nothing: keep their sum at zero
                curve += np.outer(constants, constants)
            new = self.now - np.linalg.solve(curve + 1e-12 * np.eye(n), self.slope).reshape(self.now.shape)
        self.moved = float(np.abs(new - self.now).max())
        self.now = new


def fit_logits(data: DataFrame, tasks: list[LogitTask], most: int = 60) -> None:
    """Fit all tasks on rows (x, y, fold) by shared Newton steps: one job each, for the models that still move."""
    for _ in range(most):
        moving = [t for t in tasks if not t.done]
        if not moving:
            break
        width = max(t.width for t in moving)

        def kernel(batch: Batch, moving=moving, width=width) -> np.ndarray:
            out = np.zeros((len(moving), width))
            for row, t in zip(out, moving):
                row[: t.width] = t.sums(batch["x"], batch["y"], batch["fold"])
            return out

        for t, row in zip(moving, model_sums(data, len(moving), width, kernel)):
            t.step(row)


def hinge_kernel(models: np.ndarray, inner: np.ndarray, cls: np.ndarray, importance: np.ndarray) -> Callable[[Batch], np.ndarray]:
    """Loss, slope and second moments of the rows inside the margin, for squared-hinge machines (one row of ``models`` each).

    A row (x, y, inner) trains the machines of the other inner folds; ``importance`` weighs a machine's own class.
    """
    size = models.shape[1]

    def kernel(batch: Batch) -> np.ndarray:
        x, y = batch["x"], batch["y"]
        sign = np.where(y[:, None] == cls, 1.0, -1.0)
        slack = 1 - sign * (x @ models.T)
        c = np.where((slack > 0) & (batch["inner"][:, None] != inner), np.where(sign > 0, importance, 1.0), 0.0)
        moments = (x[:, :, None] * x[:, None, :]).reshape(len(x), size * size)
        return np.c_[(c * slack * slack).sum(0), (c * sign).T @ x, c.T @ moments]

    return kernel


def sigmoid_kernel(models: np.ndarray, inner: np.ndarray, cls: np.ndarray, curves: np.ndarray, targets: np.ndarray) -> Callable[[Batch], np.ndarray]:
    """For the sigmoids over margins, on the rows of a machine's own inner fold: counts of both classes, curvature, slope.

    ``curves`` holds (slope, offset) per machine, ``targets`` what its own and all other classes should come to.
    """

    def kernel(batch: Batch) -> np.ndarray:
        own = (batch["inner"][:, None] == inner).astype(float)
        z = batch["x"] @ models.T
        positive = batch["y"][:, None] == cls
        q = sigmoid(z * curves[:, 0] + curves[:, 1])
        v, rest = own * q * (1 - q), own * (np.where(positive, targets[:, 0], targets[:, 1]) - q)
        return np.c_[(own * positive).sum(0), (own * ~positive).sum(0), (v * z * z).sum(0), (v * z).sum(0), v.sum(0), (rest * z).sum(0), rest.sum(0)]

    return kernel

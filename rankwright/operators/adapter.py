"""Training of the two-layer query adapter: gradients summed over partitions, AdamW on the driver.

An example is a query vector with a bag of positives and a bag of competitors.
The adapted query scores both by dot product; the loss wants the positives' bag
(log-mean-exp) above the competitors' by a margin, and, as a teacher, holds
each score near the unadapted query's. A step is one job: tasks turn their
batches into sums of one gradient, those meet in ``FAN`` groups, and so many
rows reach the driver whatever the examples. Examples never leave their tasks,
and are written once.

Batches are hash buckets of the key, the same in every epoch, so that reruns
agree and a lost task recomputes its own sums. Examples with a null vector or
an empty bag are left out; without any the weights stay as they begin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwright.operators.learned import gelu
from rankwright.session import cut, ship

#: Partial gradients that reach the driver in a step.
FAN = 16


@dataclass(frozen=True)
class Settings:
    """The loss and the optimizer."""

    margin: float = 0.1
    teacher: float = 0.1
    scale: float = 0.1
    rate: float = 1e-3
    decay: float = 1e-2
    epochs: int = 10
    batches: int = 1


def start_weights(size: int, hidden: int, seed: int) -> list[np.ndarray]:
    """w1, b1, w2, b2; the second layer is zero, so training begins at no change."""
    g = np.random.default_rng(seed)
    return [g.normal(size=(hidden, size)) / math.sqrt(size), np.zeros(hidden), np.zeros((size, hidden)), np.zeros(size)]


def _bag(score: np.ndarray, first: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mean-exp of consecutive runs of scores, and each score's share in its run."""
    top = np.maximum.reduceat(score, first)
    e = np.exp(score - np.repeat(top, width))
    total = np.add.reduceat(e, first)
    return top + np.log(total) - np.log(width), e / np.repeat(total, width)


def loss_and_gradient(weights: list[np.ndarray], q: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], counts: tuple[float, float, float], s: Settings) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums over some examples, each already divided by ``counts`` (examples, positives, competitors): ranking and teacher loss, gradients.

    ``bags``: for positives and competitors the vectors of all examples one
    after another, and how many each has.
    """
    w1, b1, w2, b2 = weights
    h = q @ w1.T + b1
    g = gelu(h)
    u = q + s.scale * (g @ w2.T + b2)
    norm = np.linalg.norm(u, axis=1, keepdims=True)
    norm = np.where(norm == 0, 1, norm)
    a = u / norm
    scored = []
    for vectors, width in bags:
        row, first = np.repeat(np.arange(len(q)), width), np.cumsum(width) - width
        score = (a[row] * vectors).sum(axis=1)
        off = score - (q[row] * vectors).sum(axis=1)
        scored.append((row, vectors, off, *_bag(score, first, width), width))
    gap = s.margin - scored[0][3] + scored[1][3]
    pull = 1 / (1 + np.exp(-gap)) / counts[0]
    loss = np.array([np.logaddexp(0, gap).sum() / counts[0], sum((x[2] ** 2).sum() / n for x, n in zip(scored, counts[1:]))])
    da = np.zeros_like(q)
    for sign, n, (row, vectors, off, _, share, width) in zip((-1, 1), counts[1:], scored):
        d = sign * np.repeat(pull, width) * share + s.teacher * 2 * off / n
        np.add.at(da, row, d[:, None] * vectors)
    du = np.where(np.linalg.norm(u, axis=1, keepdims=True) == 0, da, (da - (da * a).sum(axis=1, keepdims=True) * a) / norm)
    dz = s.scale * du
    density = np.exp(-h * h / 2) / math.sqrt(2 * math.pi)
    upper = 0.5 * (1 + np.frompyfunc(math.erf, 1, 1)(h / math.sqrt(2)).astype(float)) if h.size else h
    dh = (dz @ w2) * (upper + h * density)
    return loss, [dh.T @ q, dh.sum(axis=0), dz.T @ g, dz.sum(axis=0)]


class AdamW:
    """The optimizer's state, on the driver: two moments a weight."""

    def __init__(self, weights: list[np.ndarray], rate: float, decay: float) -> None:
        self.rate, self.decay, self.n = rate, decay, 0
        self.m, self.v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def step(self, weights: list[np.ndarray], gradients: list[np.ndarray]) -> list[np.ndarray]:
        self.n += 1
        out = []
        for i, (w, g) in enumerate(zip(weights, gradients)):
            self.m[i], self.v[i] = 0.9 * self.m[i] + 0.1 * g, 0.999 * self.v[i] + 0.001 * g * g
            m, v = self.m[i] / (1 - 0.9**self.n), self.v[i] / (1 - 0.999**self.n)
            out.append(w * (1 - self.rate * self.decay) - self.rate * m / (np.sqrt(v) + 1e-8))
        return out


def train_adapter(examples: DataFrame, key: str, query: str, positives: str, competition: str, weights: list[np.ndarray], settings: Settings = Settings()) -> tuple[list[np.ndarray], list[dict]]:
    """The trained weights (w1, b1, w2, b2, for ``residual_adapter``) and a log of each epoch: loss, ranking, teacher."""
    spark = examples.sparkSession
    ship(spark)
    usable = F.col(query).isNotNull() & (F.size(positives) > 0) & (F.size(competition) > 0)
    rows = examples.where(usable).select(F.pmod(F.xxhash64(key), F.lit(settings.batches)).cast("int").alias("batch"), F.col(query).alias("q"), F.col(positives).alias("p"), F.col(competition).alias("c"))
    rows = cut(rows, "examples")
    counts = {r["batch"]: (float(r["n"]), float(r["p"]), float(r["c"])) for r in rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("p")).alias("p"), F.sum(F.size("c")).alias("c")).collect()}
    shapes, opt, log = [w.shape for w in weights], AdamW(weights, settings.rate, settings.decay), []
    for epoch in range(1, settings.epochs + 1):
        losses = []
        for batch, n in sorted(counts.items()):
            shared = spark.sparkContext.broadcast(weights)
            sums = _summed(rows.where(F.col("batch") == batch).select("q", "p", "c"), shared, n, settings)
            shared.unpersist()
            at, parts = 2, []
            for shape in shapes:
                size = math.prod(shape)
                parts.append(sums[at : at + size].reshape(shape))
                at += size
            weights = opt.step(weights, parts)
            losses.append(sums[:2])
        if losses:
            ranking, teacher = np.mean(losses, axis=0)
            log.append({"epoch": epoch, "loss": float(ranking + settings.teacher * teacher), "ranking": float(ranking), "teacher": float(teacher)})
    return weights, log


def _summed(rows: DataFrame, shared, counts: tuple[float, float, float], settings: Settings) -> np.ndarray:
    """Losses and gradients of one batch of examples as one flat array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            for at in range(0, len(b), 512):
                x = b.iloc[at : at + 512]
                bags = [(np.array([v for bag in x[c] for v in bag], dtype=float), x[c].map(len).to_numpy()) for c in ("p", "c")]
                loss, gradient = loss_and_gradient(shared.value, np.stack(x["q"].to_numpy()).astype(float), bags, counts, settings)
                flat = np.concatenate([loss, *[g.ravel() for g in gradient]])
                total = flat if total is None else total + flat
        if total is not None:
            yield pd.DataFrame({"sums": [total]})

    def add(some: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sums": [np.sum(np.stack(some["sums"].to_numpy()), axis=0)]})

    parts = rows.mapInPandas(run, "sums array<double>").withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    # a row for each task; at most FAN reach the driver
    met = parts.groupBy("slot").applyInPandas(add, "sums array<double>").collect()
    return np.sum([np.array(r["sums"]) for r in met], axis=0)

"""Adapter training against a plain NumPy run, one example at a time."""

import math

import numpy as np
import pytest

from rankwright.operators import adapter as A
from rankwright.operators import learned as L


def plain_loss(w, examples, s):
    """The whole loss from its statement."""
    w1, b1, w2, b2 = w
    rank, off = [], ([], [])
    for q, bags in examples:
        h = w1 @ q + b1
        u = q + s.scale * (w2 @ np.array([0.5 * x * (1 + math.erf(x / math.sqrt(2))) for x in h]) + b2)
        a = u / (np.linalg.norm(u) or 1)
        means = []
        for bag, o in zip(bags, off):
            scores = [float(a @ v) for v in bag]
            o += [x - float(q @ v) for x, v in zip(scores, bag)]
            means.append(math.log(sum(map(math.exp, scores)) / len(scores)))
        rank.append(math.log1p(math.exp(s.margin - means[0] + means[1])))
    return np.mean(rank) + s.teacher * sum(np.mean(np.square(o)) for o in off)


def numeric(w, examples, s):
    out = []
    for i, part in enumerate(w):
        g = np.zeros_like(part)
        for at in np.ndindex(part.shape):
            both = []
            for sign in (1, -1):
                moved = [x.copy() for x in w]
                moved[i][at] += sign * 1e-5
                both.append(plain_loss(moved, examples, s))
            g[at] = (both[0] - both[1]) / 2e-5
        out.append(g)
    return out


@pytest.fixture(scope="module")
def examples():
    g = np.random.default_rng(1)
    unit = lambda *n: (lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True))(g.normal(size=n))
    return [(unit(5), (unit(g.integers(1, 4), 5), unit(g.integers(1, 6), 5))) for _ in range(14)]


def frame(spark, examples):
    rows = [(i, q.tolist(), p.tolist(), c.tolist()) for i, (q, (p, c)) in enumerate(examples)]
    rows += [(90, None, [[1.0] * 5], [[1.0] * 5]), (91, [1.0] * 5, [], [[1.0] * 5]), (92, [1.0] * 5, [[1.0] * 5], None)]
    return spark.createDataFrame(rows, "k long, q array<double>, p array<array<double>>, c array<array<double>>").repartition(4)


def test_training_equals_a_plain_run(spark, examples):
    s = A.Settings(rate=0.02, decay=0.05, epochs=4, margin=0.2, teacher=0.3, scale=0.5)
    g = np.random.default_rng(2)
    w = [g.normal(size=x.shape) / 2 for x in A.start_weights(5, 3, 0)]
    got, log = A.train_adapter(frame(spark, examples), "k", "q", "p", "c", w, s)
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for n in range(1, 5):
        assert log[n - 1]["loss"] == pytest.approx(plain_loss(w, examples, s))
        grad = numeric(w, examples, s)
        for i in range(4):
            m[i], v[i] = 0.9 * m[i] + 0.1 * grad[i], 0.999 * v[i] + 0.001 * grad[i] ** 2
            w[i] = w[i] * (1 - s.rate * s.decay) - s.rate * (m[i] / (1 - 0.9**n)) / (np.sqrt(v[i] / (1 - 0.999**n)) + 1e-8)
    for a, b in zip(got, w):
        np.testing.assert_allclose(a, b, atol=2e-4)


def test_loss_falls_and_the_adapter_takes_the_weights(spark, examples):
    s = A.Settings(rate=0.05, epochs=12, batches=2, teacher=0.01, scale=0.5)
    df = frame(spark, examples)
    w, log = A.train_adapter(df, "k", "q", "p", "c", A.start_weights(5, 4, 3), s)
    assert len(log) == 12 and log[-1]["loss"] < log[0]["loss"] - 0.01
    again, _ = A.train_adapter(df.repartition(1), "k", "q", "p", "c", A.start_weights(5, 4, 3), s)
    for a, b in zip(w, again):
        np.testing.assert_allclose(a, b, atol=1e-9)
    out = L.residual_adapter(df.where("k < 14").select("k", "q"), "q", *w, scale=s.scale).collect()
    assert all(abs(np.linalg.norm(r.q) - 1) < 1e-9 for r in out)
    same, log = A.train_adapter(df.where("k > 80"), "k", "q", "p", "c", A.start_weights(5, 4, 3), s)
    assert log == [] and all((a == b).all() for a, b in zip(same, A.start_weights(5, 4, 3)))


def test_query_gains(spark, sf):
    from rankwright.plans import catalog

    rows = catalog.queries()["adapter_training"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert np.mean([r.after for r in rows]) > np.mean([r.before for r in rows])

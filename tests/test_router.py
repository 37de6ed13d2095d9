"""The trained head against a plain loop over the same batches, and gradients against differences."""

import hashlib

import numpy as np
import pytest

from textaxis.operators import router as R


def sample(seed=0, n=230, d=5, k=4):
    rng = np.random.default_rng(seed)
    hidden, prior = rng.normal(size=(n, d)), R.log_softmax(rng.normal(size=(n, k)))
    target = np.exp(R.log_softmax(prior + hidden @ rng.normal(size=(k, d)).T))
    return hidden, prior, target


def test_gradients_equal_differences():
    hidden, prior, target = sample(n=20)
    rng = np.random.default_rng(1)
    w, b = rng.normal(size=(4, 5)), rng.normal(size=4)
    got = R.loss_sums(hidden, prior, target, w, b, 0.3, 0.2)
    loss = lambda x: R.loss_sums(hidden, prior, target, x[:20].reshape(4, 5), x[20:], 0.3, 0.2)[24]
    x = np.concatenate([w.ravel(), b])
    for i in range(24):
        e = np.zeros(24)
        e[i] = 1e-6
        assert (loss(x + e) - loss(x - e)) / 2e-6 == pytest.approx(got[i], abs=1e-5)


@pytest.mark.parametrize(("kl", "entropy"), [(0.0, 0.0), (0.1, 0.05)])
def test_training_equals_a_plain_loop(spark, kl, entropy):
    hidden, prior, target = sample()
    n = len(hidden)
    rows = [(i, hidden[i].tolist(), prior[i].tolist(), target[i].tolist()) for i in range(n)] + [(n, None, prior[0].tolist(), target[0].tolist())]
    df = spark.createDataFrame(rows, "id long, h array<double>, p array<double>, t array<double>").repartition(5)
    head = R.train_head(df, "h", "p", "t", "id", epochs=3, batch_size=64, rate=0.05, kl=kl, entropy=entropy, seed=9)

    order = sorted(range(n), key=lambda i: (hashlib.md5(f"9:{i}".encode()).hexdigest(), i))
    x, optimiser, history = np.zeros(24), R.AdamW(24, 0.05), []
    for epoch in range(3):
        seen = np.zeros(5)
        for b in R.epoch_order(9, epoch, 4):
            at = order[64 * b:64 * b + 64]
            s = R.loss_sums(hidden[at], prior[at], target[at], x[:20].reshape(4, 5), x[20:], kl, entropy)
            x = optimiser.step(x, s[:24] / s[-1])
            seen += s[24:]
        history.append(seen[:-1] / seen[-1])
    assert np.abs(np.concatenate([head.weights.ravel(), head.bias]) - x).max() < 1e-6
    assert np.allclose([list(h.values()) for h in head.history], history, atol=1e-9) and head.history[-1]["total"] < head.history[0]["total"]

    got = {r.id: r.policy for r in R.calibrated(df, "h", "p", head).collect()}
    want = np.exp(R.log_softmax(prior + hidden @ head.weights.T + head.bias))
    assert all(np.allclose(got[i], want[i]) for i in range(n)) and got[n] is None


def test_no_rows_are_an_error(spark):
    df = spark.createDataFrame([], "id long, h array<double>, p array<double>, t array<double>")
    with pytest.raises(ValueError, match="no rows"):
        R.train_head(df, "h", "p", "t", "id", 1, 8)


@pytest.mark.parametrize("numbers", [1 << 20, 8 * 13 * 3, 4 * 13])
def test_jobs_grow_with_runs_not_with_steps(spark, monkeypatch, numbers):
    """87 steps in one run an epoch, in runs of three, and by sums over pieces of a batch, give the same head."""
    hidden, prior, target = sample()
    df = spark.createDataFrame([(i, hidden[i].tolist(), prior[i].tolist(), target[i].tolist()) for i in range(len(hidden))], "id long, h array<double>, p array<double>, t array<double>")
    monkeypatch.setattr(R, "RUN", numbers)
    tracker, group = spark.sparkContext.statusTracker(), f"router-{numbers}"
    spark.sparkContext.setJobGroup(group, group)
    head = R.train_head(df, "h", "p", "t", "id", epochs=3, batch_size=8, rate=0.05, seed=9)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    order = sorted(range(len(hidden)), key=lambda i: (hashlib.md5(f"9:{i}".encode()).hexdigest(), i))
    x, optimiser = np.zeros(24), R.AdamW(24, 0.05)
    for epoch in range(3):
        for b in R.epoch_order(9, epoch, 29):
            at = order[8 * b:8 * b + 8]
            s = R.loss_sums(hidden[at], prior[at], target[at], x[:20].reshape(4, 5), x[20:], 0.0, 0.0)
            x = optimiser.step(x, s[:24] / s[-1])
    assert np.abs(np.concatenate([head.weights.ravel(), head.bias]) - x).max() < 1e-6
    if numbers == 1 << 20:
        assert len(tracker.getJobIdsForGroup(group)) < 40

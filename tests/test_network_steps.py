"""The network's mini-batch steps: same steps as the plain formulas, no denormal numbers, replicas dealt evenly."""

from __future__ import annotations

import numpy as np
import pytest

from tidewatch.detectors import network as nn
from tidewatch.operators import federated as fed

DIMS = [3, 6, 2]


def plain_batches(x, weights, rate, batch, order):
    loss, at = 0.0, order.permutation(len(x))
    for start in range(0, len(x), batch):
        part = x[at[start : start + batch]]
        part_loss, grad = nn.gradient(part, nn.unpack(weights.params, DIMS))
        weights.step(grad / len(part), rate)
        loss += part_loss
    return loss


@pytest.mark.parametrize("rows", [0, 1, 64, 150])
def test_steps_are_those_of_the_plain_formulas(rows):
    x = np.random.default_rng(3).normal(size=(rows, 3))
    found, want = (nn.Weights(nn.start_parameters(DIMS, 1), steps=2.5) for _ in range(2))
    for number in range(3):
        loss = nn.train_batches(x, found, DIMS, 0.01, 64, np.random.default_rng(number))
        assert loss == pytest.approx(plain_batches(x, want, 0.01, 64, np.random.default_rng(number)))
    assert found.flat() == pytest.approx(want.flat(), rel=1e-9, abs=1e-15)


def test_moments_of_dead_units_do_not_become_denormal():
    """A moment without a gradient loses a tenth at each step: after 7,000 of them it used to be denormal."""
    x, weights = np.ones((8000, 3)), nn.Weights(nn.start_parameters(DIMS, 1), mean=np.ones(nn.start_parameters(DIMS, 1).size),
                                                square=np.ones(nn.start_parameters(DIMS, 1).size))
    weights.params[: 3 * 6 + 6] = -1.0  # no unit of the first layer ever fires
    nn.train_batches(x, weights, DIMS, 0.0, 1, np.random.default_rng(0))
    for moments in (weights.mean, weights.square):
        assert not ((np.abs(moments) < np.finfo("float64").tiny) & (moments != 0)).any()
    assert (weights.mean[: 3 * 6] == 0).all()


def test_blocks_hold_all_rows_and_many_replicas_add_up_like_few(spark, monkeypatch):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 5), float(i % 3)) for i in range(500)], "k long, a double, b double, c double")
    run = nn.ReplicaTraining(rows, ["a", "b", "c"], ["k"], DIMS, seed=1, replicas=5, check_share=0.2)
    start = nn.Weights(nn.start_parameters(DIMS, 1))
    assert sum(len(x) + len(check) for x, check in run.blocks.collect()) == 500
    few = run.run(start, 0.01, 0)
    monkeypatch.setattr(nn, "DRIVER_PARTS", 2)
    many = run.run(start, 0.01, 0)
    assert many[0].flat() == pytest.approx(few[0].flat()) and many[1:] == pytest.approx(few[1:])
    run.close()


def test_parts_of_a_client_lie_in_different_tasks(spark):
    rows = spark.createDataFrame([(1, float(i), False) for i in range(400)], "client int, a double, is_anomaly boolean")
    scalers = fed.client_scalers(rows, ["a"], "client")
    run = fed.ClientTraining(rows, scalers, ["a"], "client", rows_per_replica=50)
    held = run.rows.rdd.mapPartitions(lambda part: [len({(r["client"], r["part"]) for r in part})]).collect()
    assert run.tasks == 8 and held == [1] * 8
    run.close()

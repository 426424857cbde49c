from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.detectors import network as nn
from tidewatch.detectors.boosted import BoostedTrees
from tidewatch.detectors.iforest import IsolationForest, average_path
from tidewatch.detectors.mlp import MlpReconstruction
from tidewatch.detectors.pca import PcaReconstruction
from tidewatch.detectors.text import LogTextDetector, tokens
from tidewatch.detectors.zscore import ZScoreDetector
from tidewatch.operators import explain as xp
from tidewatch.operators import federated as fed
from tidewatch.operators.scaling import Standardizer
from tidewatch.operators.calibrate import FusionConfig
from tidewatch.operators.shapley import exact_values, sampled_values, shapley
from tidewatch.sources import files

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points(spark):
    """A cloud of normals with correlated features, and ten far-off anomalies."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3))
    x[:, 2] = x[:, 0] + 0.1 * x[:, 2]
    x[590:] = rng.normal(size=(10, 3)) + np.array([8.0, 9.0, -9.0])
    rows = [(i, *map(float, r), i >= 590) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, is_anomaly boolean").repartition(4)


def scores_of(df):
    return {r["k"]: r["score"] for r in df.select("k", "score").collect()}


def separated(found):
    return min(found[k] for k in range(590, 600)) > np.quantile([found[k] for k in range(590)], 0.98)


def test_zscore_is_the_mean_square(spark, points):
    detector = ZScoreDetector(FEATURES).fit(points.where("not is_anomaly"))
    found = scores_of(detector.score(points))
    x = {r["k"]: np.array([r[c] for c in FEATURES]) for r in points.collect()}
    normals = np.stack([x[k] for k in range(590)])
    want = (((np.stack([x[k] for k in range(600)]) - normals.mean(0)) / normals.std(0)) ** 2).mean(1)
    assert [found[k] for k in range(600)] == pytest.approx(want.tolist())
    assert detector.threshold == pytest.approx(np.quantile(want[:590], 0.92))
    assert detector.on_arrays()(np.stack([x[k] for k in range(600)])) == pytest.approx(want)


@pytest.fixture(scope="module")
def forest(points):
    return IsolationForest(FEATURES, trees=60).fit(points.where("not is_anomaly"), "k")


def test_forest_ranks_outliers_first(points, forest):
    found = scores_of(forest.score(points))
    assert all(0 < s < 1 for s in found.values()) and separated(found)
    assert forest.nodes.groupby("tree").size().max() <= 2 * 256 - 1 and forest.nodes["tree"].nunique() == 60


def test_forest_does_not_depend_on_the_layout(points, forest):
    again = IsolationForest(FEATURES, trees=60).fit(points.where("not is_anomaly").repartition(1), "k", None)
    assert again.nodes.round(9).equals(forest.nodes.round(9))


def test_average_path():
    assert average_path(1) == 0 and average_path(2) == 1 and average_path(256) == pytest.approx(10.24, abs=0.01)


def test_pca_with_all_components_reconstructs(points):
    detector = PcaReconstruction(FEATURES, 3).fit(points.where("not is_anomaly"), None)
    assert max(scores_of(detector.score(points)).values()) < 1e-12
    two = PcaReconstruction(FEATURES, 2).fit(points.where("not is_anomaly"))
    assert separated(scores_of(two.score(points)))
    flat = two.latent_2d(points).select("latent_x", "latent_y").summary("stddev").first()
    assert float(flat["latent_x"]) > 0


def test_score_clip(points):
    detector = PcaReconstruction(FEATURES, 2).fit(points.where("not is_anomaly"))
    detector.score_clip = 0.5
    assert max(scores_of(detector.score(points)).values()) == 0.5


def test_gradient_matches_differences():
    dims, rng = [3, 4, 2], np.random.default_rng(0)
    flat, x = nn.start_parameters(dims, 1), rng.normal(size=(5, 3))
    _, grad = nn.gradient(x, nn.unpack(flat, dims))
    for i in range(0, len(flat), 7):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (nn.errors(x, nn.unpack(flat + s * step, dims)).sum() for s in (1, -1))
        assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def training(points, **options):
    return nn.ReplicaTraining(points, FEATURES, ["k"], [3, 4, 2], seed=1, **options)


def test_a_full_step_is_the_gradient_of_all_rows(points):
    run, start = training(points, replicas=4, check_share=0.0), nn.Weights(nn.start_parameters([3, 4, 2], 1))
    new, loss, check = run.full_step(start, 0.01)
    x = points.select(FEATURES).toPandas().to_numpy()
    want_loss, grad = nn.gradient(x, nn.unpack(start.params, [3, 4, 2]))
    want = start.copy()
    want.step(grad / len(x), 0.01)
    assert loss == pytest.approx(want_loss / 600) and check is None and new.params == pytest.approx(want.params, abs=1e-12)


def test_a_pass_averages_replicas_by_rows(points):
    run, start = training(points, replicas=3, check_share=0.2), nn.Weights(nn.start_parameters([3, 4, 2], 1))
    new, _, check = run.run(start, 0.01, 7)
    parts = run.rows.rdd.mapPartitionsWithIndex(lambda i, rows: [(i, [list(r) for r in rows])]).collect()
    flats, weights, losses = [], [], []
    for i, rows in parts:
        x, held = np.array([r[:3] for r in rows], dtype="float64").reshape(-1, 3), np.array([r[3] for r in rows], dtype=bool)
        losses += nn.errors(x[held], nn.unpack(start.params, [3, 4, 2])).tolist()
        own = start.copy()
        nn.train_batches(x[~held], own, [3, 4, 2], 0.01, 64, np.random.default_rng([1, 7, i]))
        flats.append(own.flat())
        weights.append((~held).sum())
    assert new.flat() == pytest.approx(np.average(flats, axis=0, weights=weights), abs=1e-12)
    assert check == pytest.approx(np.mean(losses)) and 60 < len(losses) < 180


def test_mini_batches_beat_full_steps_and_the_layout_does_not_matter(points):
    normals = points.where("not is_anomaly")
    fit = lambda df, **o: MlpReconstruction(FEATURES, (8, 2), epochs=15, rate=0.005, replicas=4, **o).fit(df, None)
    small, full = fit(normals), fit(normals, batch=None)
    assert small.checks[-1] < full.checks[-1] and small.losses[-1] < full.losses[-1]
    other = fit(normals.repartition(5, "k"))
    assert other.losses == pytest.approx(small.losses, rel=1e-6) and other.params == pytest.approx(small.params, abs=1e-6)
    spread = fit(normals, seed=42)
    spread.replicas = 8
    assert spread.fit(normals, None).losses[-1] < 1.5 * small.losses[-1]  # more replicas take fewer steps each


def test_the_rate_is_halved_on_a_plateau():
    plateau = nn.Plateau(0.1, patience=2)
    for loss in (1.0, 0.5, 0.5, 0.5):
        plateau.see(loss)
    assert plateau.rate == 0.1
    plateau.see(0.49999)
    assert plateau.rate == 0.05 and plateau.stale == 0


def test_clip_and_threshold_are_learned_from_labelled_rows(points, mlp):
    labelled = points.where("k % 2 = 0")
    for detector in (MlpReconstruction(FEATURES, (8, 2), epochs=3, rate=0.02), PcaReconstruction(FEATURES, 2)):
        detector.fit(points.where("not is_anomaly"), labelled=labelled)
        clip, detector.score_clip = detector.score_clip, None
        rows = detector.score(labelled).select("score", "is_anomaly").toPandas()
        assert clip == pytest.approx(2 * np.percentile(rows["score"][~rows["is_anomaly"]], 99))
        scores, truth, best = np.minimum(rows["score"], clip), rows["is_anomaly"].to_numpy(), (-1.0, None)
        for t in sorted(set(scores)):
            hit = scores >= t
            tp = (hit & truth).sum()
            if tp / truth.sum() >= 0.9:
                p, r = tp / hit.sum(), tp / truth.sum()
                best = max(best, (2 * p * r / (p + r), -t))
        assert detector.threshold == pytest.approx(-best[1])
        assert (detector.score_min, detector.score_max) == (pytest.approx(scores.min()), pytest.approx(scores.max()))


@pytest.fixture(scope="module")
def mlp(points):
    return MlpReconstruction(FEATURES, (8, 2), epochs=25, rate=0.02).fit(points.where("not is_anomaly"))


def test_mlp_learns(spark, points, mlp):
    assert mlp.losses[-1] < 0.7 * mlp.losses[0] and mlp.loss_table(points).count() == 25
    assert separated(scores_of(mlp.score(points)))
    flat = mlp.latent_2d(points).select("latent_x", "latent_y")
    assert flat.count() == 600 and flat.where("latent_x is null or latent_y is null").count() == 0


def test_boosted_trees(points):
    detector = BoostedTrees(FEATURES, trees=3, depth=2, rate=0.3).fit(points, "is_anomaly", validation=points)
    assert separated(scores_of(detector.score(points))) and detector.threshold is not None
    top = detector.feature_importance(points, 2).collect()
    assert len(top) == 2 and top[0]["importance"] >= top[1]["importance"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, f"Failed password for root from 10.0.0.{i} port {i}" if i % 5 == 0 else f"session {i} opened for user", i % 5 == 0)
            for i in range(100)]
    return spark.createDataFrame(rows, "k long, message string, is_anomaly boolean")


def test_text_detector(texts):
    detector = LogTextDetector(iterations=20).fit(texts)
    found = {r["k"]: r["score"] for r in detector.score(texts).collect()}
    assert all((found[k] >= 0.5) == (k % 5 == 0) for k in found)


def test_tokens_mask_numbers_and_keep_whole_texts(spark):
    text = "Login from 10.1.2.3 at 22 " + "word " * 500
    got = spark.createDataFrame([(text,)], "m string").select(tokens(F.col("m"))).first()[0]
    assert got[:5] == ["login", "from", "ipaddr", "at", "num"] and len(got) == 505


def test_save_and_load(spark, points, texts, forest, mlp, tmp_path):
    detectors = [
        ZScoreDetector(FEATURES).fit(points), PcaReconstruction(FEATURES, 2).fit(points), forest, mlp,
        BoostedTrees(FEATURES, trees=2, depth=2).fit(points, "is_anomaly"), LogTextDetector(iterations=5).fit(texts),
    ]
    for detector in detectors:
        detector.score_clip = 5.0 if detector.kind in ("pca", "mlp") else None
        path = str(tmp_path / detector.kind)
        files.save_detector(spark, detector, path)
        loaded = files.load_detector(spark, path)
        data = texts if detector.kind == "text" else points
        assert scores_of(loaded.score(data)) == pytest.approx(scores_of(detector.score(data)))
        for field in ("threshold", "score_min", "score_max", "score_clip", "features"):
            assert getattr(loaded, field) == getattr(detector, field)
    mlp.score_clip = None


def test_fusion_config_round_trip(spark, tmp_path):
    config = FusionConfig(threshold=0.7, network_threshold=0.484)
    files.save_fusion(spark, config, str(tmp_path / "fusion"))
    assert files.load_fusion(spark, str(tmp_path / "fusion")) == config
    assert config.threshold_for("network") == 0.484 and config.threshold_for("log") == 0.5
    with pytest.raises(ValueError):
        FusionConfig(weights={"if_score": 0.4})


def test_forest_draws_from_the_whole_table(spark):
    rows = spark.range(60_000).select(F.col("id").alias("k"), (F.col("id") / 60_000).alias("x"), F.rand(3).alias("y"))
    forest = IsolationForest(["x", "y"], trees=20, sample=256).fit(rows, "k", None)
    assert forest.nodes["tree"].nunique() == 20
    # Splits of x are spread over the whole range, as the samples are.
    splits = forest.nodes[(forest.nodes["feature"] == 0)]["split"]
    assert splits.min() < 0.05 and splits.max() > 0.95


def test_federated_client_without_normals(spark, points):
    rows = points.withColumn("client", F.when(F.col("is_anomaly"), 9).otherwise((F.col("k") % 2).cast("int")))
    model = fed.federated_fit(rows, FEATURES, hidden=(4, 2), rounds=1, epochs=1)
    found = {r["client"]: r for r in fed.federated_evaluate(rows, model, threshold=1.0).collect()}
    assert set(found) == {"0", "1", "9"} and found["9"]["loss"] is None and found["9"]["n_samples"] > 0


def test_shapley_sums_to_the_difference(spark, points):
    detector = PcaReconstruction(FEATURES + [], 1).fit(points.where("not is_anomaly"))
    score = detector.on_arrays()
    background = points.where("k < 20")
    found = shapley(points.where("is_anomaly"), FEATURES, score, background, "exact").collect()
    with pytest.raises(ValueError):
        shapley(points, FEATURES, score, background, "exact", background_rows=19)
    base = score(background.select(FEATURES).toPandas().to_numpy()).mean()
    for row in found:
        whole = score(np.array([[row[c] for c in FEATURES]]))[0]
        assert sum(e["value"] for e in row["attribution"]) == pytest.approx(whole - base, abs=1e-4)
        sizes = [abs(e["value"]) for e in row["attribution"]]
        assert sizes == sorted(sizes, reverse=True)


def test_shapley_null_feature_and_sampling():
    rng = np.random.default_rng(0)
    x, bg = rng.normal(size=(4, 4)), rng.normal(size=(9, 4))

    def score(m):
        return m[:, 0] * m[:, 1] + m[:, 2] ** 2

    exact = exact_values(x, bg, score)
    assert np.abs(exact[:, 3]).max() < 1e-12
    orders = np.array([rng.permutation(4) for _ in range(400)])
    sampled = sampled_values(x, bg, score, orders)
    assert sampled.sum(axis=1) == pytest.approx(exact.sum(axis=1)) and np.abs(sampled - exact).max() < 0.3


def test_additive_attribution_equals_shapley(spark, points):
    detector = ZScoreDetector(FEATURES).fit(points.where("not is_anomaly"))
    normals = points.where("not is_anomaly").select(FEATURES).toPandas().to_numpy()
    rows = xp.additive_attribution(points.where("is_anomaly"), detector.scaler).collect()
    x = np.array([[r[c] for c in FEATURES] for r in rows])
    want = exact_values(x, normals, detector.on_arrays())
    for row, phi in zip(rows, want):
        got = {e["feature"]: e["value"] for e in row["attribution"]}
        assert [got[c] for c in FEATURES] == pytest.approx(phi.tolist(), abs=1e-5)


def test_federated(spark, points, tmp_path):
    rows = points.withColumn("client", (F.col("k") % 3).cast("int"))
    path = str(tmp_path / "weights")
    model = fed.federated_fit(rows, FEATURES, hidden=(4, 2), rounds=3, epochs=2, rate=0.05, weights_path=path)
    losses = [h[2] for h in model.history]
    assert losses[-1] < losses[0] and [h[1] for h in model.history] == [3, 3, 3] and model.history[0][3] == 590
    assert spark.read.parquet(path).count() == 3
    result = fed.federated_evaluate(rows, model).collect()
    assert len(result) == 3 and sum(r["n_samples"] for r in result) == 600


def test_one_client_with_shared_scaler_is_central_training(spark, points):
    rows = points.withColumn("client", F.lit(0))
    model = fed.federated_fit(rows, FEATURES, hidden=(4, 2), rounds=1, epochs=4, rate=0.02, scaler="shared")
    normals = points.where("not is_anomaly")
    z = nn.matrix(fed.ClientTraining(rows.where("not is_anomaly"), model.scalers, FEATURES, "client").rows.where("kind = 2").coalesce(1)
                  .toArrow().combine_chunks().to_batches()[0], ["x0", "x1", "x2"])
    scaler = Standardizer.fit(normals, FEATURES)
    central, order = nn.Weights(nn.start_parameters([3, 4, 2], 42)), np.random.default_rng([42, 1, 0])
    for _ in range(4):
        nn.train_batches((z - scaler.mean) / scaler.std, central, [3, 4, 2], 0.02, 64, order)
    assert model.params == pytest.approx(central.params, abs=1e-9)


def test_a_large_client_trains_in_parts_that_count_as_one(spark, points):
    rows = points.withColumn("client", F.when(F.col("k") < 500, 0).otherwise(F.lit(1) + F.col("k").cast("int") % 3))
    model = fed.federated_fit(rows, FEATURES, hidden=(4, 2), rounds=2, epochs=1, rate=0.02, rows_per_replica=50)
    found = {(r["round"], r["client"]): r for r in model.client_results().collect()}
    sizes = {r["client"]: r["count"] for r in rows.where("not is_anomaly").groupBy("client").count().collect()}
    assert {k: r["n_examples"] for k, r in found.items()} == {(i, c): n for i in (1, 2) for c, n in sizes.items()}
    assert model.history[1][2] == pytest.approx(np.mean([r["loss"] for k, r in found.items() if k[0] == 2]))


def test_ten_thousand_clients(spark):
    rows = spark.range(30_000).select(
        (F.col("id") % 10_000).cast("int").alias("client"), (F.rand(1) * 3).alias("a"), F.randn(2).alias("b"), F.randn(3).alias("c"),
        F.lit(False).alias("is_anomaly"), "id")
    model = fed.federated_fit(rows, FEATURES, hidden=(2,), rounds=2, epochs=1, rate=0.01)
    assert [h[1:2] + h[3:] for h in model.history] == [(10_000, 30_000)] * 2
    scored = model.score(rows)
    assert scored.count() == 30_000 and scored.where("score is null").isEmpty()


def test_rows_that_are_all_equal_are_cut(spark):
    rows = spark.range(500).select(F.lit(1).alias("client"), F.lit(1.0).alias("a"), F.lit(2.0).alias("b"), F.lit(3.0).alias("c"), F.lit(False).alias("is_anomaly"))
    model = fed.federated_fit(rows, FEATURES, hidden=(2,), rounds=1, epochs=1, rows_per_replica=20)
    assert model.history[0][1] == 1 and model.history[0][3] == 500

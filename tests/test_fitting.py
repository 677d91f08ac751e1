"""The fitted scorer against a plain numpy fit, held-out rows, and its copy on disk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from octoloom.operators import fitting, verdict
from octoloom.plans import attest, catalog


def plain_fit(x, y, positive, ridge):
    """Newton's method on all rows at once, until it stands still."""
    mean, scale = x.mean(0), x.std(0)
    a = np.hstack([(x - mean) / np.where(scale == 0, 1, scale), np.ones((len(x), 1))])
    penalty = np.append(np.full(x.shape[1], ridge), 0.0)
    out = []
    for target in (1 - y, y):
        w = np.zeros(a.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-a @ w))
            row = np.where(y == 1, positive, 1.0)
            g = a.T @ (row * (p - target)) / 2 / len(y) + penalty * w
            h = (a * (row * p * (1 - p))[:, None]).T @ a / 2 / len(y) + np.diag(penalty)
            w = w - np.linalg.solve(h, g)
        out.append(1 / (1 + np.exp(-a @ w)))
    return np.stack(out, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 6))
    x[:, 5] = 2.0
    y = (x[:, 0] - x[:, 1] + rng.standard_normal(600) > 0.8).astype(int)
    held = rng.random(600) < 0.25
    return x, y, held, spark.createDataFrame([(i, a.tolist(), int(b), bool(c)) for i, (a, b, c) in enumerate(zip(x, y, held, strict=True))], "i int, features array<double>, label int, held boolean")


def test_fit_equals_numpy(rows):
    x, y, _, frame = rows
    model = fitting.PatchClassifier(positiveWeight=3.0, regParam=0.01).fit(frame)
    got = np.array([[r["p_benign"], r["p_malevolent"]] for r in model.transform(frame).orderBy("i").collect()])
    assert got == pytest.approx(plain_fit(x, y, 3.0, 0.01), abs=1e-5)


def test_loss_is_the_weighted_bce_of_verdict(spark, rows):
    x, y, held, frame = rows
    weights = np.random.default_rng(2).standard_normal((2, 7))
    cut = frame.select(F.col("features").alias("x"), F.col("label").cast("double").alias("y"), F.col("held").alias("v"))
    sums = fitting.pass_sums(cut, weights, np.zeros(6), np.ones(6), 1.0, [1.0, 5.0])
    z = np.hstack([x, np.ones((600, 1))]) @ weights.T
    logits = spark.createDataFrame([(float(a), float(b), float(t), bool(h)) for (a, b), t, h in zip(z, y, held, strict=True)], "z0 double, z1 double, y double, v boolean")
    loss = (verdict.bce_with_logits(F.col("z0"), 1 - F.col("y"), F.lit(1.0)) + verdict.bce_with_logits(F.col("z1"), F.col("y"), F.lit(5.0))) / 2
    expected = {r[0]: r[1] for r in logits.groupBy("v").agg(F.avg(loss)).collect()}
    assert (sums.loss, sums.validation) == (pytest.approx(expected[False]), pytest.approx(expected[True]))


def test_early_stop_keeps_the_best_round(rows):
    """With noise for features and few rows, the validation loss soon rises, and the best round is kept."""
    _, _, _, frame = rows
    noisy = frame.where("i < 60").withColumn("label", (F.crc32(F.col("i").cast("string").cast("binary")) % 2).cast("int"))
    model = fitting.PatchClassifier(validationIndicatorCol="held", regParam=0.0, patience=2).fit(noisy)
    watched = [v for _, v in model.history]
    assert len(watched) < 30 and min(watched) <= watched[-1]


def test_saved_and_loaded(rows, tmp_path):
    _, _, _, frame = rows
    estimator = fitting.PatchClassifier(validationIndicatorCol="held", positiveWeight=2.0, maxIter=9)
    estimator.save(str(tmp_path / "estimator"))
    again = fitting.PatchClassifier.load(str(tmp_path / "estimator"))
    assert again.getMaxIter() == 9 and again.getOrDefault(again.positiveWeight) == 2.0
    model = again.fit(frame)
    model.save(str(tmp_path / "model"))
    loaded = fitting.PatchModel.load(str(tmp_path / "model"))
    first, second = ([tuple(r) for r in m.transform(frame).select("p_benign", "p_malevolent").collect()] for m in (model, loaded))
    assert first == second


def test_rows_without_features_or_label(spark, rows):
    _, _, _, frame = rows
    odd = spark.createDataFrame([(-1, None, 1, False), (-2, [1.0], None, False), (-3, [float("nan")] * 6, 1, None)], frame.schema)
    both = frame.unionByName(odd)
    model = fitting.PatchClassifier().fit(both)
    assert model.getOrDefault("weights") == pytest.approx(fitting.PatchClassifier().fit(frame).getOrDefault("weights"))
    got = {r["i"]: r["p_benign"] for r in model.transform(odd).collect()}
    assert got[-1] is None and got[-2] is None
    with pytest.raises(ValueError, match="no rows"):
        fitting.PatchClassifier().fit(frame.limit(0))


def test_held_out_patches_by_f1(spark):
    """Archives of two kinds of bytes, as images and patches: the fitted model tells blobs apart that it has not seen."""
    rng = np.random.default_rng(5)
    blobs = [(f"{k}", bytes(rng.integers(32, 127, 4096, np.uint8) if k % 2 else rng.integers(0, 256, 4096, np.uint8))) for k in range(40)]
    frame = spark.createDataFrame(blobs, "blob_id string, data binary")
    quads = attest.patches_of_quads(attest.render_quads(frame, 32, ("class", "magnitude"), step=None), 32, 16, 16)
    label = (F.col("image_name").cast("int") % 2 == 0).cast("int")
    cut = quads.select("image_name", "patch_id", fitting.patch_features("patch").alias("features"), label.alias("label"), (F.col("image_name").cast("int") >= 24).alias("unseen"))
    model = fitting.PatchClassifier(positiveWeight=2.0).fit(cut.where("NOT unseen"))
    scored = model.transform(cut.where("unseen")).select(F.col("label").alias("y_true"), verdict.eval_pred(F.col("p_benign"), F.col("p_malevolent")).alias("y_pred"))
    assert verdict.metrics(scored).first()["f1"] > 0.95
    judged = attest.judge_blobs(frame, size=32, step=None, patch=16, scorer=model).collect()
    assert {r["image_name"]: r["class"] for r in judged} == {b: "benign" if int(b) % 2 else "malevolent" for b, _ in blobs}


def test_query_against_numpy(spark, small):
    got = catalog.QUERIES["fitted_scores"](spark, small).orderBy("vec_id").collect()
    table = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in table], np.float64)
    y = (x[:, 0] + x[:, 1] - x[:, 2] > 0.1).astype(int)
    assert [r["label"] for r in got] == y.tolist()
    held = np.array([r["held_out"] for r in got])
    assert 0.1 < held.mean() < 0.3
    guessed = np.array([r["p_malevolent"] > 0.5 for r in got])
    assert (guessed == y)[held].mean() > 0.85

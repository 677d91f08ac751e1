"""A patch scorer that is trained: a Spark ML estimator, and the model that it fits.

Two logits a patch, one for each class, are linear in the patch's features.  The loss is that of
``verdict.bce_with_logits``, with a weight for each logit, and one more for rows that are malevolent, so that
few of them among many are not passed over.  Each round is one pass over the
rows: partitions sum loss, gradient and curvature of both logits in Arrow batches, Spark adds the sums
up by place, and the driver sees numbers of a bounded count (by features, not rows), takes a Newton step,
and stops when the loss of the validation rows has not fallen for ``patience`` rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasRegParam, HasTol, HasValidationIndicatorCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scoring import sigmoid

#: Steps of brightness whose shares are features, for each channel.
LEVELS = 16
_HALVINGS = 8


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def patch_features(patches: pa.Array) -> pa.Array:
    """Of rows of RGB bytes: for each channel the share of each of 16 steps, and mean and deviation; null stays null."""
    rows = []
    for data in patches.to_pylist():
        if data is None:
            rows.append(None)
            continue
        pixels = np.frombuffer(data, np.uint8).reshape(-1, 3)
        shares = [np.bincount(pixels[:, k] >> 4, minlength=LEVELS) / max(1, len(pixels)) for k in range(3)]
        spread = pixels / 255.0 if len(pixels) else np.zeros((1, 3))
        rows.append(np.concatenate([*shares, spread.mean(0), spread.std(0)]))
    return pa.array(rows, pa.list_(pa.float64()))


class _PatchParams(HasFeaturesCol, HasLabelCol, HasMaxIter, HasRegParam, HasTol, HasValidationIndicatorCol):
    logitWeights = Param(Params._dummy(), "logitWeights", "weights of both logits' losses", TypeConverters.toListFloat)
    positiveWeight = Param(Params._dummy(), "positiveWeight", "weight of malevolent rows", TypeConverters.toFloat)
    patience = Param(Params._dummy(), "patience", "rounds without a better validation loss", TypeConverters.toInt)

    def _set_defaults(self) -> None:
        self._setDefault(featuresCol="features", labelCol="label", logitWeights=[1.0, 1.0], positiveWeight=1.0)
        self._setDefault(regParam=1e-3, maxIter=30, patience=3, tol=1e-9)


class PatchClassifier(Estimator, _PatchParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a ``PatchModel`` to rows with features (array of doubles) and a label (0 benign, 1 malevolent).

    ``validationIndicatorCol`` marks rows that are held out of the fit and stop it.  Rows with a null label,
    feature or array, or with fewer features than others, are left out; no rows at all are an error.
    """

    @keyword_only
    def __init__(
        self,
        *,
        featuresCol="features",  # noqa: N803
        labelCol="label",  # noqa: N803
        validationIndicatorCol=None,  # noqa: N803
        logitWeights=None,  # noqa: N803
        positiveWeight=1.0,  # noqa: N803
        regParam=1e-3,  # noqa: N803
        maxIter=30,  # noqa: N803
        patience=3,
        tol=1e-9,
    ):
        super().__init__()
        self._set_defaults()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PatchModel:
        held_out = F.lit(False)
        if self.isSet(self.validationIndicatorCol):
            held_out = F.coalesce(F.col(self.getValidationIndicatorCol()).cast("boolean"), F.lit(False))
        rows = dataset.select(
            F.col(self.getFeaturesCol()).cast("array<double>").alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"), held_out.alias("v")
        )
        rows = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._copyValues(self._fit_rows(rows))
        finally:
            rows.unpersist()

    def _fit_rows(self, rows: DataFrame) -> PatchModel:
        places = rows.where("NOT v").select(F.posexplode("x").alias("k", "value")).groupBy("k")
        found = {r[0]: r[1:] for r in places.agg(F.avg("value"), F.stddev_pop("value")).collect()}
        if not found:
            raise ValueError("no rows to fit")
        size = len(found)
        rows = rows.where(F.size("x") == size)
        mean = np.array([found[k][0] for k in range(size)])
        scale = np.array([found[k][1] or 1.0 for k in range(size)])
        weights = np.zeros((2, size + 1))
        last, best, waited, halved, history = None, None, 0, 0, []
        ridge = np.full(size + 1, self.getRegParam())
        ridge[-1] = 0.0
        for _ in range(self.getMaxIter()):
            sums = pass_sums(rows, weights, mean, scale, self.getOrDefault(self.positiveWeight), self.getOrDefault(self.logitWeights))
            loss = sums.loss + float((ridge * weights**2).sum()) / 2
            if last is not None and loss > last[0] + 1e-12 and halved < _HALVINGS:
                weights, halved = (weights + last[1]) / 2, halved + 1
                continue
            halved = 0
            watched = loss if sums.validation is None else sums.validation
            history.append((loss, watched))
            waited = 0 if best is None or watched < best[0] - self.getTol() else waited + 1
            if best is None or watched < best[0]:
                best = watched, weights
            still = last is not None and abs(last[0] - loss) < self.getTol()
            if waited >= self.getOrDefault(self.patience) or still:
                break
            last = (loss, weights)
            curved = sums.curvature + np.diag(ridge + 1e-12)
            weights = weights - np.stack([np.linalg.solve(h, g + ridge * w) for h, g, w in zip(curved, sums.gradient, weights, strict=True)])
        chosen = best[1].copy()
        chosen[:, :-1] /= scale
        chosen[:, -1] -= chosen[:, :-1] @ mean
        model = PatchModel(weights=chosen.ravel().tolist())
        model.history = history
        return model


class PassSums:
    """Means over the rows that are fitted: loss, gradient and curvature of both logits; and the loss of the validation rows."""

    def __init__(self, values: np.ndarray, size: int):
        squares, self.size = 2 * size * size, size
        fitted, held, loss, held_loss = values[:4]
        if not fitted:
            raise ValueError("no rows to fit")
        self.loss, self.validation = loss / fitted, held_loss / held if held else None
        self.gradient = values[4 : 4 + 2 * size].reshape(2, size) / fitted
        self.curvature = values[4 + 2 * size : 4 + 2 * size + squares].reshape(2, size, size) / fitted


def batch_sums(x: np.ndarray, y: np.ndarray, held: np.ndarray, weights: np.ndarray, positive: float, logits: list[float]) -> np.ndarray:
    """Rows fitted, rows held out, their losses, then gradients and curvatures, of rows with a one appended."""
    targets = np.stack([1 - y, y])
    z = weights @ x.T
    p = 0.5 * (1 + np.tanh(z / 2))
    each = np.where(y == 1, positive, 1.0) * np.array(logits)[:, None] / 2
    loss = (each * (np.logaddexp(0, z) - targets * z)).sum(0)
    fit = ~held
    slope = (each * (p - targets))[:, fit]
    curve = (each * p * (1 - p))[:, fit]
    inside = x[fit]
    squares = np.stack([(inside * c[:, None]).T @ inside for c in curve])
    head = [fit.sum(), held.sum(), loss[fit].sum(), loss[held].sum()]
    return np.concatenate([head, (slope @ inside).ravel(), squares.ravel()])


def pass_sums(rows: DataFrame, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray, positive: float, logits: list[float]) -> PassSums:
    """One pass over rows (x, y, v); at most 2 (f + 1) (f + 2) + 4 numbers for f features come to the driver."""
    size = weights.shape[1]
    add_up = batch_sums

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size - 1)
            x = np.hstack([(x - mean) / scale, np.ones((batch.num_rows, 1))])
            y, held = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            part = add_up(x, y, held.astype(bool), weights, positive, logits)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "value"])

    found = rows.mapInArrow(partial, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    values = np.zeros(4 + 2 * size + 2 * size * size)
    for r in found:
        values[r["place"]] = r["value"]
    return PassSums(values, size)


class PatchModel(Model, _PatchParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``z`` (both logits), p_benign and p_malevolent to rows with features, in generated code.

    Rows whose features are null, or of another number, get null.
    """

    weights = Param(Params._dummy(), "weights", "of the benign logit, then of the malevolent one; the last of each is its constant", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, weights=None):
        super().__init__()
        self._set_defaults()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _logit(self, k: int) -> Column:
        both = self.getOrDefault(self.weights)
        size = len(both) // 2
        *slopes, constant = both[k * size : (k + 1) * size]
        features = F.col(self.getFeaturesCol())
        products = F.zip_with(features, F.array(*[F.lit(w) for w in slopes]), lambda x, w: x * w)
        return F.when(F.size(features) == len(slopes), F.aggregate(products, F.lit(constant), lambda s, v: s + v))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        with_logits = dataset.withColumn("z", F.array(self._logit(0), self._logit(1)))
        return with_logits.withColumns({"p_benign": sigmoid(F.get("z", 0)), "p_malevolent": sigmoid(F.get("z", 1))})


def score_patches(patches: DataFrame, model: PatchModel) -> DataFrame:
    """``patches`` (image_name, patch_id, patch) to (image_name, patch_id, p_benign, p_malevolent)."""
    features = patches.withColumn(model.getFeaturesCol(), patch_features("patch"))
    return model.transform(features).select("image_name", "patch_id", "p_benign", "p_malevolent")

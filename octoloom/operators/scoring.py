"""Scoring patches with a pluggable function.

A scorer maps a batch of patches, shaped (n, height, width, 3), to logits, shaped (n, 2).
No trained network is part of this package: ``mean_scorer`` is a stand-in that tells dark
patches from bright ones, and says nothing about malware.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Scorer = Callable[[np.ndarray], np.ndarray]


def mean_scorer(patches: np.ndarray) -> np.ndarray:
    """Logits from mean brightness, for tests."""
    mean = patches.reshape(len(patches), -1).mean(1) / 255.0
    return np.stack([1 - 4 * mean, 4 * mean - 1], 1)


#: Scorers by name.
SCORERS: dict[str, Scorer] = {"mean": mean_scorer}


def score(patches: DataFrame, patch_w: int, patch_h: int, scorer: str | Scorer = "mean", batch: int = 64) -> DataFrame:
    """``patches`` (image_name, patch_id, patch) to (image_name, patch_id, p_benign, p_malevolent)."""
    run = SCORERS[scorer] if isinstance(scorer, str) else scorer

    def make():
        def predict(data: np.ndarray) -> np.ndarray:
            pixels = np.stack([np.frombuffer(d, np.uint8) for d in data]).reshape(-1, patch_h, patch_w, 3)
            return run(pixels).astype(np.float64)

        return predict

    logits = predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch)
    scored = patches.select("image_name", "patch_id", logits("patch").alias("_z"))
    return scored.select(
        "image_name",
        "patch_id",
        sigmoid(F.get("_z", 0)).alias("p_benign"),
        sigmoid(F.get("_z", 1)).alias("p_malevolent"),
    )


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

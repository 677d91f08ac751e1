"""From patch scores to image verdicts, and how good they are.

Inference and evaluation differ on purpose: inference calls a patch malevolent above a strict
threshold, evaluation by the greater score; they also report different probabilities.  Every
aggregate is one ``groupBy`` with partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A patch is malevolent above this probability, not at it.
THRESHOLD = 0.75


def infer_pred(p: Column, threshold: float = THRESHOLD) -> Column:
    return (p > threshold).cast("int")


def eval_pred(p0: Column, p1: Column) -> Column:
    """The greater of two; ties go to 0."""
    return F.when(p1 > p0, 1).otherwise(0)


def infer_verdict(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(image_name, class, probability) of every image.

    With a malevolent patch: the greatest probability among such.  Without: the mean probability
    of benign over all patches.
    """
    pred = infer_pred(F.col("p_malevolent"), threshold)
    found = scores.groupBy("image_name").agg(
        F.max(pred).alias("_any"),
        F.max(F.when(pred == 1, F.col("p_malevolent"))).alias("_most"),
        F.avg("p_benign").alias("_mean"),
    )
    bad = F.col("_any") == 1
    return found.select(
        "image_name",
        F.when(bad, "malevolent").otherwise("benign").alias("class"),
        F.when(bad, F.col("_most")).otherwise(F.col("_mean")).alias("probability"),
    )


def eval_rows(scores: DataFrame) -> DataFrame:
    """(image_name, y_true, y_pred, malevolent_prob) from scores with the patch truth ``label``."""
    return scores.groupBy("image_name").agg(
        F.max("label").alias("y_true"),
        F.max(eval_pred(F.col("p_benign"), F.col("p_malevolent"))).alias("y_pred"),
        F.max("p_malevolent").alias("malevolent_prob"),
    )


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("accuracy"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def metrics(rows: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; ratios without a denominator are 0."""

    def n(truth: int, pred: int) -> Column:
        return F.sum(((F.col("y_true") == truth) & (F.col("y_pred") == pred)).cast("long"))

    counts = rows.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp",
        "fp",
        "fn",
        "tn",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(tp * 2, tp * 2 + fp + fn).alias("f1"),
    )


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """(w_benign, w_malevolent): 1 and negatives by positives (null without positives)."""
    y = F.sum(F.col(label)).cast("double")
    return rows.agg(F.lit(1.0).alias("w_benign"), ((F.count(label) - y) / F.nullif(y, F.lit(0.0))).alias("w_malevolent"))


def bce_with_logits(z: Column, y: Column, w: Column) -> Column:
    """Weighted binary cross-entropy of one logit, in the form that does not overflow."""
    return w * (F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z))))


def running_loss(batches: DataFrame, loss: str = "loss", order: str = "i") -> DataFrame:
    """The sum of each batch's loss by its number from one: not a mean, and kept as it is known."""
    return batches.agg(F.sum(F.col(loss) / (F.col(order) + 1)).alias("running_loss"))


def patch_accuracy(batches: DataFrame, batch_size: int) -> DataFrame:
    """(running_accuracy, accuracy) of patch predictions (batch, y_true, y_pred).

    The first divides by whole batches, so it is too low where the last is short, and is kept as it is
    known; the second is the mean over all patches.
    """
    hit = (F.col("y_true") == F.col("y_pred")).cast("long")
    whole = (F.max("batch") + 1) * batch_size
    return batches.agg((F.sum(hit) / whole).alias("running_accuracy"), F.avg(hit).alias("accuracy"))

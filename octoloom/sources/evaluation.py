"""Evaluation rows as CSV, a folder for each split."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "image_name string, y_true int, y_pred int, malevolent_prob double"
COLUMNS = ["image_name", "y_true", "y_pred", "malevolent_prob"]


def split_path(base: str, split: str) -> str:
    """``a/b.csv`` and ``test`` to ``a/b_test.csv``."""
    root, extension = os.path.splitext(base)
    return f"{root}_{split}{extension}"


def write_evaluation(rows: DataFrame, base: str, split: str) -> str:
    path = split_path(base, split)
    rows.select(*COLUMNS).write.mode("overwrite").csv(path, header=True)
    return path


def read_evaluation(spark: SparkSession, base: str, split: str) -> DataFrame:
    return spark.read.schema(SCHEMA).csv(split_path(base, split), header=True)

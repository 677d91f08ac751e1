"""From service orders to stored reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import fitting, orders, report, scoring, verdict
from ..sources.store import ResultStore
from .imaging import patches_of_quads, render_quads

#: How archives become images and patches in production.  Fixed values.
IMAGE = {"size": 1024, "step": 30, "layout_map": "hilbert", "layout_type": "unrolled"}
PATCH = 256
#: One scorer an application area, by position from 1.
AREAS: dict[int, str] = {1: "mean"}


def judge_blobs(
    blobs: DataFrame,
    color_map: tuple[str, ...] = ("class", "magnitude"),
    size: int = IMAGE["size"],
    step: int | None = IMAGE["step"],
    patch: int = PATCH,
    scorer: str | Callable | fitting.PatchModel = "mean",
) -> DataFrame:
    """(image_name, class, probability) of every blob; all blobs are judged, in parallel.

    ``scorer`` is the name of a function, a function, or a fitted model.
    """
    quads = patches_of_quads(render_quads(blobs, size, color_map, step=step), size, patch, patch)
    if isinstance(scorer, fitting.PatchModel):
        return verdict.infer_verdict(fitting.score_patches(quads, scorer))
    return verdict.infer_verdict(scoring.score(quads, patch, patch, scorer))


def attest(
    requests: DataFrame,
    archives: DataFrame,
    stored: DataFrame,
    stamp: Column,
    kind: str = "compose",
    area: int = 1,
    **imaging,
) -> DataFrame:
    """New results (sa_hash, created_at, stix_report, application_area, status) of ``requests``.

    ``requests`` has order_id and body; ``archives`` has image, tag, path_to_tar, hash and data;
    ``stored`` has id, sa_hash and stix_report.  Orders whose hash is stored are left to
    ``orders.hits``.  Each image is drawn and scored once, however many services run it.  A service
    without an archive makes its order ``failed``, and so does a body that is no order; the others are still
    reported.  An order without services is benign.
    """
    if area not in AREAS:
        raise ValueError(f"unknown application area {area!r}; there are {sorted(AREAS)}")
    hashed = requests.withColumn("sa_hash", orders.content_hash(F.col("body")))
    new = orders.misses(hashed, stored)
    read = orders.parsed(new.select("order_id", "body"), kind)
    listed = read.select("order_id", "sa_hash", F.inline("services"))
    wrong = read.where("error IS NOT NULL").select("order_id", F.lit(True).alias("_wrong"))
    wanted = archives.join(orders.distinct_images(listed), ["image", "tag"])
    name = F.concat_ws(":", "image", "tag")
    judged = judge_blobs(wanted.select(name.alias("blob_id"), "data"), scorer=AREAS[area], **imaging)
    verdicts = wanted.select("image", "tag", "path_to_tar", "hash", name.alias("image_name")).join(judged, "image_name")
    services = orders.with_verdicts(listed, verdicts.drop("image_name"))
    status = services.groupBy("order_id").agg(
        F.when(F.max((F.col("status") == "failed").cast("int")) == 1, "failed").otherwise("completed").alias("status")
    )
    known = services.where("status = 'completed'")
    empty = read.where("error IS NULL AND size(services) = 0").select("order_id")
    made = report.bundles(known, stamp, empty.unionByName(known.select("order_id")))
    return (
        new.join(made, "order_id", "left")
        .join(status, "order_id", "left")
        .join(wrong, "order_id", "left")
        .select(
            "sa_hash",
            stamp.alias("created_at"),
            "stix_report",
            F.lit(area).alias("application_area"),
            F.when(F.col("_wrong"), "failed").otherwise(F.coalesce("status", F.lit("completed"))).alias("status"),
        )
    )


def append_results(results: DataFrame, store: ResultStore) -> int:
    """Commit the results that the store has not yet, and the version that shows them; running twice changes nothing."""
    return store.append(results)


def listing(stored: DataFrame) -> DataFrame:
    """(total) number of results; no rows where there are none."""
    return stored.agg(F.count("*").alias("total")).where("total > 0")


def check_request(area: int | None, content_type: str | None, body: bytes | None) -> str:
    """The text of a request, or a ValueError that says what is wrong with it."""
    if not area:
        raise ValueError("an application area is needed")
    if not content_type or "yaml" not in content_type.lower():
        raise ValueError("the content type must be YAML")
    text = (body or b"").decode("utf-8").strip()
    if not text:
        raise ValueError("the order is empty")
    return text

"""STIX 2.1 reports of judged orders, built as nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patches import stem

#: A malware object is added above this probability.
MALWARE_FROM = 0.5
#: Names, texts and extension ids of the report format.  Fixed values.
CLASSIFICATION_EXT = "extension-definition--962d1dd6-d2bb-459c-b374-f140bdf6951d"
CONTAINER_EXT = "extension-definition--d2bb1734-2673-492a-92e8-cafc8daff5a0"
REPORT_NAME = "container-malware-detection-report"
REPORT_TYPES = ("threat-report", "observed-data", "malware")
REPORT_TEXT = (
    "Structured Security Report to hold the detection results of the Malware Detection Component applied on a group of "
    "software instances packaged as docker containers."
)
CONTEXT = "software-container-analysis"
MALWARE_NAME = "unknown_malware"
MALWARE_TEXT = "Unknown malware detected using a machine learning model in a Docker container."
MALWARE_LABELS = ("docker", "machine learning detection")
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _digest(kind: str, *parts: Column) -> Column:
    return F.sha1(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def _name(kind: str, h: Column) -> Column:
    variant = F.element_at(F.array([F.lit(v) for v in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    pieces = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3))]
    pieces += [F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit(f"{kind}--"), F.concat_ws("-", *pieces))


def stix_id(kind: str, *parts: Column) -> Column:
    """``kind--uuid`` that depends on the parts alone, in the form of a version 5 UUID."""
    return F.get(F.transform(F.array(_digest(kind, *parts)), lambda h: _name(kind, h)), F.lit(0))


def _object(kind: str, identity: Column, stamp: Column, **fields: Column) -> Column:
    """One STIX object as a JSON text; ``stamp`` is its time as text."""
    known = {"type": F.lit(kind), "spec_version": F.lit("2.1"), "id": identity}
    if kind != "file":
        known |= {"created": stamp, "modified": stamp}
    return F.to_json(F.struct(*[c.alias(n) for n, c in (known | fields).items()]))


def _texts(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _extension(name: str, **fields: Column) -> Column:
    """The property extensions of an object: one, by its id."""
    inside = F.struct(F.lit("property-extension").alias("extension_type"), *[c.alias(n) for n, c in fields.items()])
    return F.struct(inside.alias(name))


def service_objects(judged: DataFrame, stamp: Column) -> DataFrame:
    """``judged`` with ``objects`` and ``grouping`` (JSON texts), ``grouping_id`` and whether it is malware.

    ``judged`` has order_id, container_name, image, tag, path_to_tar, hash, class and probability.  The
    container is a file with what is known of its image, what was seen of it an observation with class and
    probability, and malware an object of its own.
    """
    bad = F.coalesce((F.col("class") == "malevolent") & (F.col("probability") > MALWARE_FROM), F.lit(False))
    key = [F.col(c) for c in ("order_id", "container_name", "image", "tag")]
    kinds = ("file", "observed-data", "malware", "grouping")
    # columns of their own, so that objects which name each other do not hash anew
    named = judged.withColumns({f"_h {kind}": _digest(kind, *key) for kind in kinds})
    named = named.withColumns({f"_id {kind}": _name(kind, F.col(f"_h {kind}")) for kind in kinds} | {"_at": F.date_format(stamp, _STAMP)})
    file_id, seen_id, malware_id, group_id = (F.col(f"_id {kind}") for kind in kinds)
    stamp = F.col("_at")
    container = _extension(
        CONTAINER_EXT,
        x_image_name=F.col("image"),
        x_image_tag=F.col("tag"),
        x_description=F.lit("none"),
        x_hashes=F.col("hash"),
    )
    file = _object("file", file_id, stamp, name=stem(F.col("path_to_tar")), extensions=container)
    seen = _object(
        "observed-data",
        seen_id,
        stamp,
        first_observed=stamp,
        last_observed=stamp,
        number_observed=F.lit(1),
        object_refs=F.array(file_id),
        extensions=_extension(CLASSIFICATION_EXT, x_class=F.col("class"), x_probability=F.col("probability")),
    )
    malware = _object(
        "malware",
        malware_id,
        stamp,
        name=F.lit(MALWARE_NAME),
        description=F.lit(MALWARE_TEXT),
        malware_types=_texts("unknown"),
        is_family=F.lit(False),
        labels=_texts(*MALWARE_LABELS),
        confidence=F.floor(F.col("probability") * 100).cast("int"),
        architecture_execution_envs=_texts("x64"),
        implementation_languages=_texts("unknown"),
        capabilities=_texts("compromise-containers"),
        sample_refs=F.array(file_id),
    )
    refs = F.filter(F.array(file_id, seen_id, F.when(bad, malware_id)), lambda x: x.isNotNull())
    group = _object(
        "grouping",
        group_id,
        stamp,
        name=F.concat_ws(":", "image", "tag"),
        context=F.lit(CONTEXT),
        labels=F.array("class"),
        object_refs=refs,
    )
    objects = F.filter(F.array(file, seen, F.when(bad, malware)), lambda x: x.isNotNull())
    return named.select(
        *judged.columns, objects.alias("objects"), group.alias("grouping"), group_id.alias("grouping_id"), bad.alias("is_malware")
    )


def bundles(judged: DataFrame, stamp: Column, orders: DataFrame | None = None) -> DataFrame:
    """(order_id, label, stix_report) with one bundle an order: report, groupings, then their objects.

    Orders (order_id) without services are benign, and their report refers to nothing.
    """
    parts = service_objects(judged, stamp)
    service = F.struct("container_name", "image", "tag", "grouping_id", "grouping", "objects")
    grouped = parts.groupBy("order_id").agg(
        F.array_sort(F.collect_list(service)).alias("_s"), F.max((F.col("class") == "malevolent").cast("int")).alias("_bad")
    )
    if orders is not None:
        grouped = orders.select("order_id").distinct().join(grouped, "order_id", "left")
    label = F.when(F.coalesce("_bad", F.lit(0)) == 1, "malevolent").otherwise("benign")

    def each(field: str) -> Column:
        return F.coalesce(F.transform("_s", lambda s: s[field]), F.array().cast("array<string>"))

    report = _object(
        "report",
        stix_id("report", F.col("order_id")),
        F.date_format(stamp, _STAMP),
        name=F.lit(REPORT_NAME),
        report_types=_texts(*REPORT_TYPES),
        description=F.lit(REPORT_TEXT),
        published=F.date_format(stamp, _STAMP),
        labels=F.array(label),
        object_refs=each("grouping_id"),
    )
    inside = F.coalesce(F.flatten(F.transform("_s", lambda s: s["objects"])), F.array().cast("array<string>"))
    every = F.concat(F.array(report), each("grouping"), inside)
    bundle = F.concat(
        F.lit('{"type":"bundle","id":"'), stix_id("bundle", F.col("order_id")), F.lit('","objects":['), F.array_join(every, ","), F.lit("]}")
    )
    return grouped.select("order_id", label.alias("label"), bundle.alias("stix_report"))


def object_rows(reports: DataFrame) -> DataFrame:
    """One row an object of reports (order_id, stix_report), with the fields that tell what was found."""
    extension = f"struct<`{CONTAINER_EXT}`:{_CONTAINER},`{CLASSIFICATION_EXT}`:{_CLASSIFICATION}>"
    fields = (
        "type:string,id:string,name:string,context:string,labels:array<string>,confidence:int,"
        f"object_refs:array<string>,sample_refs:array<string>,extensions:{extension}"
    )
    bundle = F.from_json("stix_report", f"objects array<struct<{fields}>>")
    rows = reports.select("order_id", F.inline(bundle["objects"]))
    container, seen = F.col("extensions")[CONTAINER_EXT], F.col("extensions")[CLASSIFICATION_EXT]
    return rows.select(
        "order_id",
        "type",
        "name",
        "context",
        F.array_join("labels", ",").alias("labels"),
        "confidence",
        (F.size(F.coalesce("object_refs", F.array())) + F.size(F.coalesce("sample_refs", F.array()))).alias("n_refs"),
        container["x_image_name"].alias("image"),
        container["x_image_tag"].alias("tag"),
        container["x_hashes"].alias("hash"),
        seen["x_class"].alias("class"),
        seen["x_probability"].alias("probability"),
    )


_CONTAINER = "struct<x_image_name:string,x_image_tag:string,x_description:string,x_hashes:string>"
_CLASSIFICATION = "struct<x_class:string,x_probability:double>"

"""Service orders: parse, deduplicate, judge, and store results by content hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.orders import parse_services


#: White space of Unicode, which is stripped from both ends of an order.  Fixed values.
WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def content_hash(body: Column) -> Column:
    """MD5 of the text without white space around it."""
    return F.md5(F.btrim(body, F.lit(WHITE)).cast("binary"))


def parsed(orders: DataFrame, kind: str = "compose") -> DataFrame:
    """(order_id, sa_hash, services, error) of orders (order_id, body), a row each; services are null where error is not."""
    listed = orders.select(
        "order_id", content_hash(F.col("body")).alias("sa_hash"), parse_services(kind)(F.col("body")).alias("_s")
    )
    return listed.select("order_id", "sa_hash", "_s.services", "_s.error")


def services(orders: DataFrame, kind: str = "compose") -> DataFrame:
    """(order_id, sa_hash, container_name, image, tag) of orders (order_id, body); none of those that cannot be read."""
    return parsed(orders, kind).select("order_id", "sa_hash", F.inline("services"))


def distinct_images(listed: DataFrame) -> DataFrame:
    """Each (image, tag) once: what has to be fetched and scored."""
    return listed.select("image", "tag").distinct()


def with_verdicts(listed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Services with the verdict of their image; one without a verdict has status ``failed``."""
    joined = listed.join(verdicts, ["image", "tag"], "left")
    return joined.withColumn("status", F.when(F.col("class").isNull(), "failed").otherwise("completed"))


def order_label(judged: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """(order_id, label): malevolent if any service is; one of ``orders`` (order_id) without services is benign."""
    found = judged.groupBy("order_id").agg(F.max((F.col("class") == "malevolent").cast("int")).alias("_bad"))
    if orders is not None:
        found = orders.select("order_id").distinct().join(found, "order_id", "left")
    bad = F.coalesce("_bad", F.lit(0)) == 1
    return found.select("order_id", F.when(bad, "malevolent").otherwise("benign").alias("label"))


def hits(requests: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("sa_hash",)) -> DataFrame:
    """Requests whose hash is stored, with the stored report (the first by id)."""
    first = stored.groupBy(*keys).agg(F.min_by("stix_report", "id").alias("stix_report"), F.min("id").alias("id"))
    return requests.join(first, list(keys))


def misses(requests: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("sa_hash",)) -> DataFrame:
    """One request for each hash that is not stored yet."""
    return requests.join(stored.select(*keys).distinct(), list(keys), "left_anti").dropDuplicates(list(keys))


def answered(requests: DataFrame, judge: Callable[[DataFrame], DataFrame], stored: DataFrame | None = None) -> DataFrame:
    """(order_id, sa_hash, stix_report, answered_by, repeated) of every request (order_id, body).

    The batch form of ``streaming.answers``: what is stored answers first; of the others, each hash is judged
    once, for its smallest order_id.  ``judge`` maps (order_id, sa_hash, body), a row a hash, to
    (sa_hash, stix_report).  ``answered_by`` is the order judged, null where a stored report answers.  Requests
    without a body have no hash and no answer.
    """
    hashed = requests.select("order_id", "body", content_hash(F.col("body")).alias("sa_hash"))
    firsts = hashed.where("sa_hash IS NOT NULL").groupBy("sa_hash").agg(F.min(F.struct("order_id", "body")).alias("_first"))
    known = firsts.limit(0).select("sa_hash", F.lit(None).cast("string").alias("stix_report"))
    if stored is not None:
        known = hits(firsts.select("sa_hash"), stored).select("sa_hash", F.col("stix_report").cast("string").alias("stix_report"))
    new = firsts.join(known.select("sa_hash"), "sa_hash", "left_anti")
    judged = judge(new.select("_first.order_id", "sa_hash", "_first.body")).select("sa_hash", "stix_report")
    by = new.select("sa_hash", F.col("_first.order_id").alias("answered_by")).join(judged, "sa_hash")
    nobody = F.lit(None).cast(dict(hashed.dtypes)["order_id"]).alias("answered_by")
    answers = by.unionByName(known.select("sa_hash", nobody, "stix_report"))
    repeated = F.coalesce(F.col("order_id") != F.col("answered_by"), F.col("sa_hash").isNotNull())
    return hashed.join(answers, "sa_hash", "left").select("order_id", "sa_hash", "stix_report", "answered_by", repeated.alias("repeated"))


def result_by_id(stored: DataFrame, wanted: int) -> DataFrame:
    return stored.where(F.col("id") == wanted).limit(1)


def result_by_hash(stored: DataFrame, wanted: str) -> DataFrame:
    return stored.where(F.col("sa_hash") == wanted).limit(1)


def links(root: str, row_id: Column) -> Column:
    """The three links of a stored result."""
    base = F.concat(F.lit(f"{root.rstrip('/')}/attestation/"), row_id.cast("string"))

    def link(rel: str, tail: str) -> Column:
        return F.struct(F.lit(rel).alias("rel"), F.concat(base, F.lit(tail)).alias("href"), F.lit("GET").alias("method"))

    return F.array(link("self", ""), link("report", "/report"), link("status", "/status"))

"""Near-duplicate vectors: random-hyperplane tables, exact cosines, connected components.

1. Equal vectors are one class with a count.
2. Each class gets its signs against random hyperplanes: ``bits`` of them are the key in each of several tables, 64
   more are a sketch.  The key is about as long as the logarithm of the number of classes, so buckets stay small at
   every size, and there are as many tables as a pair at the least cosine needs to meet in one with probability ``recall``.
3. Where a bucket is crowded, vectors close to the mean around a leader become one cluster.  Angles obey the triangle
   inequality: two vectors within half the linking angle of one centre are linked, whatever their own cosine is.  A
   group of a third of all rows is so linked in linear work, and is one row in each bucket from then on.
4. Clusters (mostly single classes) that share a bucket are candidates; of single ones the sketch drops pairs that are
   far off.  Their centres' cosine, in double precision, settles pairs of single classes exactly and
   most others by the triangle inequality.  What stays open is compared vector by vector in blocks of bounded size,
   which give counts, not pairs.
5. Links between clusters go through the components of ``common``.

Only cosines are decided here, hashing never links by itself; a pair that meets in no table is missed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, cut

LEAST_COSINE = 0.9
#: Chance that a pair at just the least cosine meets in a table.
RECALL = 0.99
#: More entries than this make a bucket crowded.
CROWD = 16
BLOCK = 256
SEED = 11
_SKETCH = 64
#: Bounds by angles leave so much to a comparison of the vectors themselves (radians).
_MARGIN = 1e-7
#: Rounds that fail to put this share of the crowded classes into clusters are the last.
_PROGRESS = 0.05


def tables_for(bits: int, cosine: float, recall: float) -> int:
    """Tables after which a pair at ``cosine`` has met with probability ``recall``."""
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-same)))


def bits_for(classes: int) -> int:
    """Key length that keeps a handful of unrelated classes in a bucket."""
    return min(30, max(8, math.ceil(math.log2(max(2, classes))) - 2))


def sketch_limit(cosine: float) -> int:
    """Sketch bits in which a pair at ``cosine`` may differ: five standard deviations above the mean."""
    p = math.acos(cosine) / math.pi
    return math.ceil(_SKETCH * p + 5 * math.sqrt(_SKETCH * p * (1 - p)))


@lru_cache(maxsize=4)
def _planes(dimension: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimension]).standard_normal((dimension, count))


def unit(values: list[float | None] | None) -> np.ndarray | None:
    """The vector in double precision at length one; None if null, empty, zero or with a component that is no finite number."""
    if not values or None in values:
        return None
    vector = np.array(values, np.float64)
    most = np.abs(vector).max()
    if not np.isfinite(vector).all() or most == 0:
        return None
    vector = vector / most
    return vector / np.sqrt(vector @ vector)


@F.arrow_udf(T.BinaryType())
def _digest(vectors: pa.Array) -> pa.Array:
    """Equal for equal vectors; null for vectors that link with nothing."""
    out = []
    for v in vectors:
        values = v.as_py()
        sound = unit(values) is not None
        out.append(hashlib.sha256((np.array(values, np.float64) + 0.0).tobytes()).digest() if sound else None)
    return pa.array(out, pa.binary())


def _by_dimension(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, unit vectors) of the vectors of each dimension; all are sound."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        matrix = flat[starts[at, None] + np.arange(size)]
        matrix /= np.abs(matrix).max(axis=1, keepdims=True)
        yield at, matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]


def _signs(bits: int, tables: int):
    """Keys in each table (the dimension above the bits) and the sketch, of unit vectors."""
    powers = 1 << np.arange(bits, dtype=np.int64)

    @F.arrow_udf("keys array<long>, sketch long")
    def signs(vectors: pa.Array) -> pa.Array:
        rows: list[dict | None] = [None] * len(vectors)
        for at, matrix in _by_dimension(vectors):
            width = matrix.shape[1]
            above = matrix @ _planes(width, tables * bits + _SKETCH) > 0
            keys = above[:, : tables * bits].reshape(len(at), tables, bits) @ powers + (width << bits)
            sketches = np.packbits(above[:, tables * bits :], axis=1, bitorder="little").view("<i8").ravel()
            for i, k, s in zip(at, keys.tolist(), sketches.tolist(), strict=True):
                rows[i] = {"keys": k, "sketch": s}
        return pa.array(rows, pa.struct([("keys", pa.list_(pa.int64())), ("sketch", pa.int64())]))

    return signs


@F.arrow_udf(T.DoubleType())
def _cosine(left: pa.Array, right: pa.Array) -> pa.Array:
    """Cosines in double precision; null where dimensions differ."""
    out = np.full(len(left), np.nan)
    same = pc.equal(pc.list_value_length(left), pc.list_value_length(right))
    places = np.flatnonzero(same.to_numpy(zero_copy_only=False))
    for (at, a), (_, b) in zip(_by_dimension(left.filter(same)), _by_dimension(right.filter(same)), strict=True):
        out[places[at]] = np.einsum("ij,ij->i", a, b)
    return pa.array(out, pa.float64(), from_pandas=True)


def _angle(cosine: Column) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


def _clusters(classes: DataFrame, entries: DataFrame, cosine: float, crowd: int) -> DataFrame:
    """(node, cluster, angle, centre) of classes put into clusters; none where no bucket is crowded.

    A round takes crowded buckets of classes that are still alone.  Each such class follows the
    leader with the smallest hash among its buckets' leaders; followers that link with the leader make the mean,
    and those within half the linking angle of the mean are its cluster.
    """
    half = math.acos(cosine) / 2 - _MARGIN
    vectors = classes.select("node", "vector")
    out, alone, round_ = None, entries.select("place", "key", "node"), 0
    while True:
        sizes = alone.groupBy("place", "key").agg(
            F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(round_)).alias("order"), "node")).alias("leader")
        )
        crowded = sizes.where(F.col("n") > crowd).select("place", "key", "leader")
        if crowded.isEmpty():
            break
        followers = cut(
            alone.join(crowded, ["place", "key"]).groupBy("node").agg(F.min("leader")["node"].alias("leader")).join(vectors, "node")
        )
        leaders = vectors.select(F.col("node").alias("leader"), F.col("vector").alias("centre"))
        near = followers.join(leaders, "leader").where(_cosine("vector", "centre") >= cosine)
        means = near.groupBy("leader").agg(vector_to_array(Summarizer.mean(array_to_vector(_as_units("vector")))).alias("centre"))
        means = means.where(_digest("centre").isNotNull())
        angles = near.select("node", "leader", "vector").join(means, "leader")
        angles = angles.select("node", F.col("leader").alias("cluster"), _angle(_cosine("vector", "centre")).alias("angle"), "centre")
        made = cut(angles.where(F.col("angle") <= half))
        out = made if out is None else out.unionByName(made)
        n_followers, n_made = followers.count(), made.count()
        if n_made < _PROGRESS * n_followers:
            break
        alone, round_ = cut(alone.join(made.select("node"), "node", "left_anti")), round_ + 1
    return out


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _as_units(vectors: pa.Array) -> pa.Array:
    rows: list[np.ndarray | None] = [None] * len(vectors)
    for at, matrix in _by_dimension(vectors):
        for i, row in zip(at, matrix, strict=True):
            rows[i] = row
    return pa.array(rows, pa.list_(pa.float64()))


def _blocks(members: DataFrame) -> DataFrame:
    """(cluster, nodes, counts, vectors): members in blocks of about ``BLOCK``, dealt by a hash."""
    slots = F.ceil(F.col("classes") / BLOCK).cast("long")
    dealt = members.withColumn("slot", F.pmod(F.xxhash64("node"), slots))
    held = F.sort_array(F.collect_list(F.struct("node", "copies", "vector")))
    return dealt.groupBy("cluster", "slot").agg(held.alias("held")).select("cluster", "slot", "held")


def _compare(cosine: float):
    """How many vectors of the other block each class of two blocks links with."""

    def one(left: list[dict], right: list[dict]) -> list[dict]:
        a, b = ([unit(m["vector"]) for m in side] for side in (left, right))
        if len(a[0]) != len(b[0]):
            return []
        linked = np.stack(a) @ np.stack(b).T >= cosine
        counts = [np.array([m["copies"] for m in side], np.int64) for side in (left, right)]
        found = [*zip(left, (linked @ counts[1]).tolist(), strict=True), *zip(right, (counts[0] @ linked).tolist(), strict=True)]
        return [{"node": m["node"], "links": n} for m, n in found if n]

    @F.arrow_udf("array<struct<node: long, links: long>>")
    def compare(left: pa.Array, right: pa.Array) -> pa.Array:
        rows = [one(a.as_py(), b.as_py()) for a, b in zip(left, right, strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("node", pa.int64()), ("links", pa.int64())])))

    return compare


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = LEAST_COSINE,
    recall: float = RECALL,
    crowd: int = CROWD,
) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id (smallest id reachable by links), kept.

    Vectors that are null, empty, zero, or hold null, NaN or infinite components link with nothing; nor do vectors of different
    length.  Rows with equal vectors are linked, repeated rows among them, also where ids repeat.  A null id keeps its
    row, and is a component id only where the component has no other.  A pair at just ``cosine`` is linked.  Empty
    tables give no rows.  Columns other than the two named are not read, so their names cannot clash.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("digest", _digest("vector"))
    by_class = rows.where("digest IS NOT NULL").groupBy("digest")
    classes = by_class.agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))

    bits = bits_for(classes.count())
    signs = _signs(bits, tables_for(bits, cosine, recall))
    signed = classes.select("node", signs("vector").alias("signs"))
    entries = cut(signed.select("node", "signs.sketch", F.posexplode("signs.keys").alias("place", "key")))

    grouped = _clusters(classes, entries, cosine, crowd)
    if grouped is None:
        members = classes.select("node", "copies", "first_id", "vector", F.col("node").alias("cluster"), F.lit(0.0).alias("angle"))
        clusters = members.select("cluster", "copies", F.lit(1).cast("long").alias("classes"), "angle", F.col("vector").alias("centre"))
        places = entries.withColumnRenamed("node", "cluster")
    else:
        centre = F.coalesce("centre", F.col("vector").cast("array<double>"))
        members = cut(
            classes.join(grouped, "node", "left").select(
                "node",
                "copies",
                "first_id",
                "vector",
                F.coalesce("cluster", "node").alias("cluster"),
                F.coalesce("angle", F.lit(0.0)).alias("angle"),
                centre.alias("centre"),
            )
        )
        clusters = members.groupBy("cluster").agg(
            F.sum("copies").alias("copies"),
            F.count("*").alias("classes"),
            F.max("angle").alias("angle"),
            F.any_value("centre").alias("centre"),
        )
        belongs = grouped.select("node", "cluster")
        # of a cluster, one row in each bucket, and no sketch, which is of one vector
        places = (
            entries.join(belongs, "node", "left")
            .groupBy("place", "key", F.coalesce("cluster", "node").alias("cluster"))
            .agg(F.max(F.when(F.col("cluster").isNull(), F.col("sketch"))).alias("sketch"))
        )

    pairs = cut(_judged(_candidates(places, cosine), clusters, cosine))
    whole = pairs.where("verdict = 'all'")
    both = F.array(F.struct(F.col("a").alias("cluster"), F.col("copies_b").alias("n")), F.struct(F.col("b").alias("cluster"), F.col("copies_a").alias("n")))
    by_cluster = whole.select(F.inline(both)).groupBy("cluster").agg(F.sum("n").alias("outside"))
    edges = whole.select(F.col("b").alias("big"), F.col("a").alias("small"))

    open_pairs = pairs.where("verdict = 'open'").select("a", "b")
    by_node = None
    if not open_pairs.isEmpty():
        named = open_pairs.select(F.explode(F.array("a", "b")).alias("cluster")).distinct()
        sized = members.join(clusters.select("cluster", "classes"), "cluster").join(named, "cluster", "left_semi")
        blocks = cut(_blocks(sized))
        left = blocks.select(F.col("cluster").alias("a"), F.col("held").alias("held_a"))
        right = blocks.select(F.col("cluster").alias("b"), F.col("held").alias("held_b"))
        compared = open_pairs.join(left, "a").join(right, "b")
        compared = compared.select("a", "b", F.explode(_compare(cosine)("held_a", "held_b")).alias("found"))
        compared = cut(compared.groupBy("a", "b", F.col("found.node").alias("node")).agg(F.sum("found.links").alias("n")))
        by_node = compared.groupBy("node").agg(F.sum("n").alias("open_links"))
        edges = edges.unionByName(compared.select(F.col("b").alias("big"), F.col("a").alias("small")).distinct())

    return _labelled(rows.select("vec_id", "digest"), classes, members, clusters, by_cluster, by_node, connected_components(edges))


def _candidates(places: DataFrame, cosine: float) -> DataFrame:
    """Clusters ``a`` < ``b`` that share a bucket and whose sketches, where both are of one class, are close enough."""
    left = places.select("place", "key", F.col("cluster").alias("a"), F.col("sketch").alias("sketch_a"))
    right = places.select("place", "key", F.col("cluster").alias("b"), F.col("sketch").alias("sketch_b"))
    apart = F.bit_count(F.col("sketch_a").bitwiseXOR(F.col("sketch_b")))
    close = F.coalesce(apart <= sketch_limit(cosine), F.lit(True))
    return left.join(right, ["place", "key"]).where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def _judged(pairs: DataFrame, clusters: DataFrame, cosine: float) -> DataFrame:
    """Pairs of clusters with ``verdict``: all their vectors are linked, or open; pairs that cannot link are left out."""
    for side in ("a", "b"):
        names = {"cluster": side, "copies": f"copies_{side}", "angle": f"angle_{side}", "centre": f"centre_{side}"}
        pairs = pairs.join(clusters.select(*(F.col(c).alias(n) for c, n in names.items())), side)
    pairs = pairs.withColumn("cosine", _cosine("centre_a", "centre_b"))
    spread, most = F.col("angle_a") + F.col("angle_b"), math.acos(cosine)
    between = _angle(F.col("cosine"))
    verdict = (
        F.when(spread == 0, F.when(F.col("cosine") >= cosine, F.lit("all")))
        .when(between + spread <= most - _MARGIN, F.lit("all"))
        .when(between - spread <= most + _MARGIN, F.lit("open"))
    )
    return pairs.select("a", "b", "copies_a", "copies_b", verdict.alias("verdict")).where("verdict IS NOT NULL")


def _labelled(
    rows: DataFrame,
    classes: DataFrame,
    members: DataFrame,
    clusters: DataFrame,
    by_cluster: DataFrame,
    by_node: DataFrame | None,
    roots: DataFrame,
) -> DataFrame:
    zero = F.lit(0).cast("long")
    firsts = members.groupBy("cluster").agg(F.min("first_id").alias("first_id"))
    rooted = clusters.select("cluster", "copies").join(by_cluster, "cluster", "left").join(firsts, "cluster")
    rooted = cut(
        rooted.join(roots.select(F.col("node").alias("cluster"), "root"), "cluster", "left").select(
            "cluster",
            "first_id",
            F.coalesce("root", "cluster").alias("root"),
            (F.col("copies") - 1 + F.coalesce("outside", zero)).alias("links"),
        )
    )
    by_root = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    rooted = rooted.join(by_root, "root").select("cluster", "links", "component")
    placed = members.select("node", "cluster").join(rooted, "cluster").select("node", "links", "component")
    if by_node is not None:
        placed = placed.join(by_node, "node", "left").withColumn("links", F.col("links") + F.coalesce("open_links", zero))
    placed = classes.select("node", "digest").join(placed, "node").select("digest", "links", "component")
    # one left join would bring all unsound vectors to one task
    sound = rows.where("digest IS NOT NULL").join(placed, "digest").select("vec_id", "links", "component")
    unsound = rows.where("digest IS NULL").select("vec_id", zero.alias("links"), F.col("vec_id").alias("component"))
    return sound.unionByName(unsound).select(
        "vec_id",
        F.col("links").alias("n_links"),
        F.col("component").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"),
    )

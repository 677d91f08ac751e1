"""SimHash near-duplicates by multi-index hashing.

Fingerprints are made in Arrow batches (one pass over the texts, nothing shuffled but an id and
eight bytes).  Everything after works on *distinct* fingerprints, so a group of exact copies of
any size is one row.

Linking at ``d <= 2`` differing bits of 64: the fingerprint is cut into two segments of 32 bits.
Either the high segments differ in at most one bit, or the low segments are equal.  So each
fingerprint looks up the Hamming ball of radius one around its high segment and the ball of
radius zero around its low segment in a table keyed by (segment, value), and the whole distance
is checked inside the join.  A pair whose high segments differ in one bit is looked up only from
the side that has the bit clear, so the ball costs 16 probes on average, not 32.  With 32-bit keys
the table stays selective for 10^10 documents.

A segment value shared by more than ``bucket_limit`` distinct fingerprints is not joined within
itself: each probe of such a bucket enumerates the rest of the ball (at most 529 whole
fingerprints) and looks those up exactly.  Work is then linear in the bucket, and no link is
lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed_cut, connected_components, cut, fresh

#: Above this many distinct fingerprints a bucket costs more in pairs than in ball look-ups.
BUCKET_LIMIT = 512
HASH_SEED = 42
_SLICE = 1 << 16
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.int64)


def fingerprint(data: bytes | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; texts without words give 0.

    ``bytes.lower`` changes A-Z alone and ``bytes.split`` cuts at space and 0x09-0x0D alone.
    """
    words = (data or b"").lower().split()
    if not words:
        return 0
    shingle = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(2048, np.int64)
    for at in range(0, len(starts), _SLICE):
        pairs = zip(starts[at : at + _SLICE], stops[at : at + _SLICE], strict=True)
        hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in pairs], np.uint64)
        lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _LANES
        counts += np.bincount(lanes.ravel(), minlength=2048)
    ones = (counts.reshape(8, 256) @ _BYTE_BITS).ravel()
    bits = np.packbits(ones * 2 > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with the long column ``name``; only the text goes to Python."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())

    return docs.withColumn(name, simhash(F.col(text_col).cast("binary")))


def _masks(width: int, weights: tuple[int, ...], shift: int = 0) -> list[int]:
    """All masks of ``width`` bits with one of these weights, as signed 64-bit integers."""
    out = []
    for weight in weights:
        for bits in combinations(range(width), weight):
            value = sum(1 << (b + shift) for b in bits)
            out.append(value - (1 << 64) if value >> 63 else value)
    return out


def links(fingerprints: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Pairs (``big``, ``small``) of distinct fingerprints at 1 or 2 differing bits, each once.

    ``fingerprints`` has one row for each distinct long ``fp``.  At most 2,080 fingerprints lie
    within two bits of any, so the result is linear in the input.
    """
    low = F.col("fp").bitwiseAND(0xFFFFFFFF)
    high = F.shiftrightunsigned("fp", 32)
    both = F.array(
        F.struct(F.lit(0).alias("segment"), high.alias("key")), F.struct(F.lit(1).alias("segment"), low.alias("key"))
    )
    index = fingerprints.select("fp", F.inline(both)).select(F.col("fp").alias("other"), "segment", "key")
    sizes = index.groupBy("segment", "key").count()
    full = cut(sizes.where(F.col("count") > bucket_limit).select("segment", "key"))

    flips = F.transform(
        F.filter(F.array([F.lit(1 << b) for b in range(32)]), lambda m: high.bitwiseAND(m) == 0),
        lambda m: F.struct(F.lit(0).alias("segment"), high.bitwiseOR(m).alias("key"), F.lit(1).alias("spent")),
    )
    centres = F.array(
        F.struct(F.lit(0).alias("segment"), high.alias("key"), F.lit(0).alias("spent")),
        F.struct(F.lit(1).alias("segment"), low.alias("key"), F.lit(0).alias("spent")),
    )
    probes = fingerprints.select("fp", F.inline(F.concat(centres, flips)))
    crowded = not full.isEmpty()
    if crowded:
        index = index.join(full, ["segment", "key"], "left_anti")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))).between(1, 2)
    apart = F.bit_count(F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("other")), 32))
    once = (F.col("p.spent") == 1) | (F.col("fp") < F.col("other")) & ((F.col("p.segment") == 0) | (apart == 2))
    same = (F.col("p.segment") == F.col("i.segment")) & (F.col("p.key") == F.col("i.key"))
    found = probes.alias("p").join(index.alias("i"), same & once & near).select("fp", "other")
    if crowded:
        rest = (
            F.when(F.col("segment") == 1, F.array([F.lit(m) for m in _masks(32, (2,), 32)]))
            .when(F.col("spent") == 1, F.array([F.lit(m) for m in _masks(32, (0, 1))]))
            .otherwise(F.array([F.lit(m) for m in _masks(32, (1, 2))]))
        )
        base = F.when(
            F.col("segment") == 0, F.shiftleft("key", 32).bitwiseOR(F.col("fp").bitwiseAND(0xFFFFFFFF))
        ).otherwise(F.col("fp"))
        balls = (
            probes.join(full, ["segment", "key"], "left_semi")
            .select("fp", "spent", base.alias("base"), F.explode(rest).alias("mask"))
            .select("fp", "spent", F.col("base").bitwiseXOR(F.col("mask")).alias("other"))
            .where("spent = 1 OR fp < other")
        )
        targets = fingerprints.select(F.col("fp").alias("other"))
        found = found.unionByName(balls.join(targets, "other").select("fp", "other"))
    return found.select(F.greatest("fp", "other").alias("big"), F.least("fp", "other").alias("small"))


def components(rows: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(fp, component_id) for each distinct ``fp`` of ``rows`` (doc_id, fp)."""
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(links(nodes.select("fp"), bucket_limit))
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    labelled = cut(labelled)
    firsts = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return labelled.join(firsts, "root").select("fp", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null and wordless texts have fingerprint zero and link like any other.  Fewer than three
    words are one shingle.  Null ids keep their row and never become a component id unless all
    ids of the component are null (then it is null).  Repeated rows keep each row.  Texts of any length
    are hashed whole, and an empty table gives no rows.  Columns of ``docs`` other than the two named
    are not read, so their names cannot clash.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(with_fingerprint(rows, "fp").select("doc_id", "fp"))
    return rows.join(components(rows, bucket_limit), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Rows whose losers share one bitmap: what Spark's bitmaps hold.
BLOCK_ROWS = 1 << 15


def _row_blocks(row: Column) -> Column:
    """Numbers of blocks of at most ``BLOCK_ROWS`` rows that stand together in one partition."""
    return F.shiftright(row, 15)


def _in_block(row: Column) -> Column:
    return row.bitwiseAND(BLOCK_ROWS - 1)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id (nulls last; then any one row).

    Groups are those of ``near_duplicates``.  Null and wordless texts are one group; repeated rows leave
    one; very long texts are read whole; an empty table stays empty.  Columns and their names stay as
    they were.

    Texts are hashed once and never shuffled: they are written bucketed by blocks of neighbouring
    rows, and what the join brings to them is a bitmap of the rows to keep of each block, a bit a row.
    """
    spark = docs.sparkSession
    fp, row, block, bits = (fresh(docs, c) for c in ("fp", "row_key", "row_block", "row_bits"))
    marked = with_fingerprint(docs, fp, text_col).withColumn(row, F.monotonically_increasing_id())
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = bucketed_cut(marked.withColumn(block, _row_blocks(F.col(row))), buckets, block)
    rows = marked.select(F.col(id_col).alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row_key"))
    nodes = cut(
        rows.groupBy("fp").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row_key")).alias("first")
        )
    )
    roots = connected_components(links(nodes.select("fp")))
    labelled = cut(
        nodes.join(roots, nodes.fp == roots.node, "left").select(
            "fp", F.coalesce("root", "fp").alias("root"), F.col("first.row_key").alias("row_key"), "first"
        )
    )
    firsts = labelled.groupBy("root").agg(F.min("first")["row_key"].alias("row_key"))
    kept = firsts.groupBy(_row_blocks(F.col("row_key")).alias(block)).agg(
        F.bitmap_construct_agg(_in_block(F.col("row_key"))).alias(bits)
    )
    joined = marked.join(kept.hint("shuffle_hash"), block)
    byte = F.hex(F.substr(bits, F.floor(_in_block(F.col(row)) / 8).cast("int") + 1, F.lit(1)))
    bit = F.call_function("shiftright", F.conv(byte, 16, 10).cast("int"), F.pmod(F.col(row), F.lit(8)).cast("int"))
    return joined.where(bit.bitwiseAND(1) == 1).select(*docs.columns)

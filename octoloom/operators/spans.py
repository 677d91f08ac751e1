"""Byte ranges: masks from marked spans, and archive structure colours from members.

Open-source Spark runs a range join as a nested loop.  Here a range is filed by its length: at the
lowest level whose aligned power-of-two blocks are at least as long, so it touches two blocks at most,
whether it has a byte or a terabyte.  A block is one row with its ranges, and a point looks up its own
block once for each level that any range has: equalities on (blob, block), one row a point, in and out.
Levels are ``LEVEL_BITS`` apart, so there are ten of them up to the longest file, and one or two in most archives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytes import MASK_COLOUR

#: Length of the lowest level's blocks, a power of two.
BLOCK = 65_536
LEVEL_BITS = 4
_TOP_BITS = 62
#: Header colours by member type, and the cycle of data colours.  Fixed values.
HEADER_COLOURS = {
    "0": 155, "1": 140, "2": 125, "3": 105, "4": 90, "5": 75, "6": 60, "7": 45, "g": 30, "x": 15,
}
DATA_COLOURS = (255, 230, 205, 180)


def check_spans(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """``spans``, failing at run time on one that is reversed or ends past its blob (blob_id, n_bytes)."""
    sizes = sizes.select("blob_id", F.col("n_bytes").alias("_n"))
    bad = (F.col("span_end") > F.col("_n")) | (F.col("span_start") < 0) | (F.col("span_end") < F.col("span_start"))
    checked = spans.join(sizes, "blob_id").withColumn(
        "span_end", F.when(bad, F.raise_error(F.lit("span outside its blob")).cast("long")).otherwise(F.col("span_end"))
    )
    return checked.select("blob_id", "span_start", "span_end")


def merge_spans(spans: DataFrame) -> DataFrame:
    """Disjoint spans in place of any order, overlap or adjacency; empty ones go."""
    order = Window.partitionBy("blob_id").orderBy("span_start", "span_end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.where("span_end > span_start").withColumn("_far", F.max("span_end").over(before))
    opens = F.coalesce((F.col("span_start") > F.col("_far")).cast("int"), F.lit(1))
    runs = marked.withColumn("_run", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("blob_id", "_run").agg(
        F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")
    ).drop("_run")


def _base_bits(block: int) -> int:
    if block < 1 or block & (block - 1):
        raise ValueError("the block of the lowest level must be a power of two")
    return block.bit_length() - 1


def level_of(length: Column, block: int = BLOCK) -> Column:
    """Bits of the lowest level whose blocks are at least as long."""
    out = None
    for bits in range(_base_bits(block), _TOP_BITS, LEVEL_BITS):
        longest = F.lit(1 << bits).cast("long")
        out = F.when(length <= longest, bits) if out is None else out.when(length <= longest, bits)
    return out.otherwise(_TOP_BITS)


def _block(place: Column, level: Column | int) -> Column:
    return F.call_function("shiftright", place, level if isinstance(level, Column) else F.lit(level))


def file_ranges(ranges: DataFrame, start: str, end: str, block: int = BLOCK) -> DataFrame:
    """``ranges`` with ``_level`` and ``_block``: a row for each of the one or two blocks that a range touches; empty ones go."""
    level = level_of(F.col(end) - F.col(start), block)
    levelled = ranges.where(F.col(end) > F.col(start)).withColumn("_level", level)
    blocks = F.array_distinct(F.array(_block(F.col(start), F.col("_level")), _block(F.col(end) - 1, F.col("_level"))))
    return levelled.select("*", F.explode(blocks).alias("_block"))


def _look_up(points: DataFrame, ranges: DataFrame, start: str, end: str, rank: list[str], block: int) -> DataFrame:
    """``points`` with ``_best``: the greatest struct of ``rank`` among the ranges that hold the byte, else null.

    The levels that occur are counted first: ten numbers at most.
    """
    filed = file_ranges(ranges, start, end, block)
    levels = sorted(r[0] for r in filed.select("_level").distinct().collect())
    names, found = list(points.columns), []
    for level in levels:
        held = F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.struct(*rank).alias("v")))
        of_level = filed.where(F.col("_level") == level).groupBy(F.col("blob_id").alias("_blob"), "_block").agg(held.alias("_held"))
        same = (F.col("blob_id") == F.col("_blob")) & (_block(F.col("byte_idx"), level) == F.col("_block"))
        inside = F.filter("_held", lambda r: (r["s"] <= F.col("byte_idx")) & (F.col("byte_idx") < r["e"]))
        best = F.array_max(F.transform(inside, lambda r: r["v"])).alias(f"_best_{level}")
        points = points.join(of_level, same, "left").select(*names, *found, best)
        found.append(f"_best_{level}")
    if not found:
        return points.withColumn("_best", F.lit(None))
    best = F.greatest(*found) if len(found) > 1 else F.col(found[0])
    return points.select(*names, best.alias("_best"))


def mask(points: DataFrame, spans: DataFrame, block: int = BLOCK) -> DataFrame:
    """``points`` (blob_id, byte_idx, ...) with ``mask``: 255 inside a span, else 0.

    Spans may be empty, overlap, and come in any order.
    """
    found = _look_up(points, merge_spans(spans), "span_start", "span_end", ["span_start"], block)
    hit = F.when(F.col("_best").isNotNull(), MASK_COLOUR).otherwise(0)
    return found.select(*points.columns, hit.alias("mask"))


def structure_ranges(members: DataFrame) -> DataFrame:
    """(blob_id, member_idx, range_start, range_end, colour) of each member's header and data."""
    types = F.create_map(*[F.lit(x) for pair in HEADER_COLOURS.items() for x in pair])
    header = F.coalesce(F.try_element_at(types, F.col("type")), F.lit(0))
    data = F.element_at(F.array([F.lit(c) for c in DATA_COLOURS]), (F.col("member_idx") % 4 + 1).cast("int"))
    parts = F.array(
        F.struct(F.col("offset").alias("range_start"), F.col("offset_data").alias("range_end"), header.alias("colour")),
        F.struct(
            F.col("offset_data").alias("range_start"),
            (F.col("offset_data") + F.col("size")).alias("range_end"),
            data.alias("colour"),
        ),
    )
    return members.select("blob_id", "member_idx", F.inline(parts))


def structure(points: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """``points`` with ``structure``: the colour of the last member range that holds the byte, else 0."""
    found = _look_up(points, structure_ranges(members), "range_start", "range_end", ["member_idx", "range_start", "colour"], block)
    colour = F.col("_best.colour") if dict(found.dtypes)["_best"].startswith("struct") else F.lit(None).cast("int")
    return found.select(*points.columns, F.coalesce(colour, F.lit(0)).alias("structure"))


def changed_files(records: DataFrame) -> DataFrame:
    """(path, file) of the files that a metadata record added or modified; deletions do not count."""
    names = F.concat(
        *[F.coalesce(F.col(f"diffs.{k}.Name"), F.array().cast("array<string>")) for k in ("Adds", "Mods")]
    )
    return records.where(F.col("diffs").isNotNull()).select("path", F.explode(names).alias("file"))


def usable(records: DataFrame, labels: tuple[str, ...] = ("failed", "large-image-size")) -> DataFrame:
    """Records without a label of failure; a null label stays."""
    return records.where(F.col("label").isNull() | ~F.col("label").isin(*labels))


def spans_of_files(members: DataFrame, files: DataFrame) -> DataFrame:
    """Spans, headers included, of the members whose names are among ``files`` (blob_id, file)."""
    wanted = files.select("blob_id", F.ltrim(F.col("file"), F.lit("/")).alias("name")).distinct()
    named = members.withColumn("_name", F.ltrim(F.col("name"), F.lit("/")))
    wanted = wanted.withColumnRenamed("name", "_name")
    return named.join(wanted, ["blob_id", "_name"], "left_semi").select(
        "blob_id",
        F.col("offset").alias("span_start"),
        (F.col("offset_data") + F.col("size")).alias("span_end"),
    )


def member_name_matches(members: DataFrame, files: DataFrame) -> DataFrame:
    """Members (blob_id, name, ...) whose name, without leading slashes, is among ``files`` (file)."""
    wanted = files.select(F.ltrim(F.col("file"), F.lit("/")).alias("_name")).distinct()
    return (
        members.withColumn("_name", F.ltrim(F.col("name"), F.lit("/")))
        .join(wanted, "_name", "left_semi")
        .drop("_name")
    )


def hex_block(b_index: Column, spec: Column) -> Column:
    """For ``start:end[:RRGGBB]``, the colour where the index lies in the block, else null."""
    parts = F.split(spec, ":")
    start, end = F.get(parts, 0).cast("long"), F.get(parts, 1).cast("long")
    return F.when((b_index >= start) & (b_index < end), F.coalesce(F.get(parts, 2), F.lit("ff0000")))

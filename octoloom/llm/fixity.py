"""WARC fixity audits with Merkle trees.

A record is a leaf: file, offset, length and SHA-256.  Leaves of equal offset ranges of a file make a
node, ranges are joined ``FANOUT`` at a time up to the file, and files up to one root.  A node hashes
its children in order.  Trees of two replicas are compared from the root down; only children of
nodes that differ are looked at, so an audit of sound replicas reads one row and an audit of
damaged ones reads the paths to the damage.  Lost and longer records move all that follow them in
their file, so leaves that differ are then matched by content, by record id and by place.

Groups hold at most the records of one offset range or ``FANOUT`` nodes.  Nodes of all levels are
tables in the shared folder; nothing is collected but the number of levels.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from itertools import chain
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..sources.files import find, open_file
from .common import cut, drop_cut

RANGE_BYTES = 64 << 10
FANOUT = 16
FILE_RECORDS = 1_000
CRLF = "\r\n"
#: Copies of a record, equal in everything, that stand in one file.
RUN_COPIES = 1_000
#: Compressed bytes behind the reader in which a damaged member is searched for the starts of others.
BEHIND_BYTES = 16 << 20
#: A header longer than this, or a record said to be longer, is not read as one.
HEAD_BYTES = 1 << 20
RECORD_BYTES = 1 << 30
PIECE_BYTES = 1 << 20
_GZIP = b"\x1f\x8b\x08"


def record_id(page_id: Column, url: Column) -> Column:
    return F.md5(F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in (page_id, F.lit(" "), url)]).cast("binary"))


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A response record without its closing blank lines; nulls are empty."""
    url, html = (F.coalesce(c, F.lit("")) for c in (url, html))
    name = record_id(page_id, url)
    head = [
        F.lit("WARC/1.0"),
        F.lit("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: <urn:md5:"), name, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("Content-Length: "), F.octet_length(html).cast("string")),
        F.lit(""),
        html,
    ]
    return F.concat_ws(CRLF, *head)


def warc_records(pages: DataFrame) -> DataFrame:
    """(page_id, record_id, record, key, length, sha256) of pages; ``length`` counts the closing blank lines."""
    name = record_id(F.col("page_id"), F.col("url")).alias("record_id")
    rows = pages.select("page_id", name, warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    return rows.select(
        "page_id",
        "record_id",
        "record",
        F.md5(F.col("record").cast("binary")).alias("key"),
        (F.octet_length("record") + 4).cast("long").alias("length"),
        F.sha2(F.col("record").cast("binary"), 256).alias("sha256"),
    )


def file_count(records: DataFrame, file_records: int = FILE_RECORDS) -> int:
    return max(1, ceil(records.count() / file_records))


def lay_out(
    records: DataFrame, file_records: int = FILE_RECORDS, keep: tuple[str, ...] = ("record",), files: int | None = None
) -> DataFrame:
    """(page_id, file, offset, length, sha256, and what to ``keep``) of records as WARC files.

    Files take about ``file_records`` records each, by the hash of id, address and content; inside a
    file, records stand in hash order.  Records equal in everything are one row with a count until they are
    placed: each run of ``RUN_COPIES`` of them has a hash, and so a file, of its own, and no file or task gets them
    all.  The table is cut, since offsets must not move between uses; contents move only if kept.  Null ids,
    addresses and bodies are empty text; repeated rows are records of their own; an empty table has no files.  Columns
    other than those of ``warc_records`` and ``keep`` are not read.  Replicas need one number of ``files``, which
    replaces ``file_records``.
    """
    files = files or file_count(records, file_records)
    known = records.groupBy("page_id", "key", "length", "sha256")
    rows = known.agg(F.count("*").alias("_copies"), *[F.any_value(c).alias(c) for c in keep])
    last = F.floor((F.col("_copies") - 1) / RUN_COPIES).cast("long")
    rows = rows.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    again = F.md5(F.concat_ws(":", "key", "_run").cast("binary"))
    rows = rows.withColumns(
        {
            "key": F.when(F.col("_run") == 0, F.col("key")).otherwise(again),
            "_copies": F.least(F.col("_copies") - F.col("_run") * RUN_COPIES, F.lit(RUN_COPIES).cast("long")),
        }
    )
    rows = rows.withColumn("file", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % files)
    before = Window.partitionBy("file").orderBy("key", "page_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_first", F.coalesce(F.sum(F.col("length") * F.col("_copies")).over(before), F.lit(0)))
    rows = rows.withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    offset = (F.col("_first") + F.col("_nth") * F.col("length")).alias("offset")
    return cut(rows.select("page_id", "file", offset, "length", "sha256", *keep))


def write_warc(laid_out: DataFrame, path: str) -> None:
    """``path/file=N/part-*``: one WARC file each, records in offset order, through Spark's writer."""
    rows = laid_out.repartition("file").sortWithinPartitions("file", "offset").select("file", "record")
    rows.write.partitionBy("file").option("lineSep", CRLF + CRLF).text(path)


class _Window:
    """What has been read of a stream and not yet taken."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.data = pieces, bytearray()

    def fill(self, size: int) -> bool:
        """Whether the stream still has ``size`` bytes; they are in the window then."""
        while len(self.data) < size:
            piece = next(self.pieces, None)
            if piece is None:
                return False
            self.data += piece
        return True

    def find(self, mark: bytes, limit: int | None = None) -> int:
        """Where ``mark`` stands in the stream, or -1; not looked for beyond ``limit`` bytes."""
        start = 0
        while True:
            at = self.data.find(mark, start, limit)
            if at >= 0 or (limit is not None and len(self.data) >= limit):
                return at
            start = max(0, len(self.data) - len(mark) + 1)
            if not self.fill(len(self.data) + 1):
                return -1

    def record_end(self) -> int:
        """Bytes of the record at the front with its closing blank lines; 0 if it cannot be read."""
        head = self.find(b"\r\n\r\n", HEAD_BYTES)
        found = re.search(rb"(?i)^Content-Length: *(\d{1,18})[ \t]*\r?$", self.data[:head], re.M) if head >= 0 else None
        if not found or not self.data.startswith(b"WARC/") or int(found[1]) > RECORD_BYTES:
            return 0
        end = head + 4 + int(found[1]) + 4
        return end if self.fill(end) and self.data[end - 4 : end] == b"\r\n\r\n" else 0


_NEXT = b"\r\n\r\nWARC/"


def parse_stream(pieces: Iterator[bytes]) -> Iterator[tuple[int, int, str, str | None]]:
    """(offset, length, SHA-256, id) of each record of a stream, which is held a record at a time.

    What has no readable header, or does not end where its length says, goes up to the next
    ``WARC/`` after a blank line, or to the end of the stream; it is hashed as it passes and not held.
    """
    window, at = _Window(pieces), 0
    while window.fill(1):
        end = window.record_end()
        if end:
            record = bytes(window.data[:end])
            del window.data[:end]
            yield at, end, sha256(record.removesuffix(b"\r\n\r\n")).hexdigest(), _id_in(record)
        else:
            end, digest, name = _passed_over(window)
            yield at, end, digest, name
        at += end


def _passed_over(window: _Window) -> tuple[int, str, str | None]:
    """Length, SHA-256 and id of what stands at the front up to the next record; it is taken off."""
    window.find(b"\r\n\r\n", HEAD_BYTES)
    name = _id_in(bytes(window.data[:HEAD_BYTES]))
    digest, size = sha256(), 0
    while (found := window.data.find(_NEXT)) < 0:
        # a mark, or the blank line that closes the stretch, may reach into what comes
        done = max(0, len(window.data) - len(_NEXT) + 1)
        digest.update(window.data[:done])
        del window.data[:done]
        size += done
        if not window.fill(len(window.data) + 1):
            break
    end = found + 4 if found >= 0 else len(window.data)
    digest.update(bytes(window.data[:end]).removesuffix(b"\r\n\r\n"))
    del window.data[:end]
    return size + end, digest.hexdigest(), name


def parse_warc(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(offset, length, SHA-256) of each record, as by ``parse_stream``."""
    for at, size, digest, _ in parse_stream(iter([data])):
        yield at, size, digest


def inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a stream's gzip members, in pieces of at most ``PIECE_BYTES``.

    A member that cannot be read gives what could be read of it, closed by a blank line; reading goes on
    at the next start of a member after its own, so that later records are found.  ``BEHIND_BYTES`` of what
    has been read are held for that, so the start of a member that long is looked for in its last part only.
    """
    held, used = bytearray(), 0
    while used < len(held) or (piece := next(pieces, b"")):
        if used == len(held):
            held, used = bytearray(piece), 0
        del held[:used]  # now from the start of the member on
        member, used, tail = zlib.decompressobj(31), 0, b""
        before, given = member, b""
        try:
            while not member.eof:
                if used == len(held):
                    if not (piece := next(pieces, b"")):
                        return
                    held += piece
                given, before = bytes(held[used : used + PIECE_BYTES]), member.copy()
                out = member.decompress(given, PIECE_BYTES)
                used += len(given) - len(member.unconsumed_tail) - len(member.unused_data)
                if used > BEHIND_BYTES + PIECE_BYTES:
                    del held[: used - BEHIND_BYTES]
                    used = BEHIND_BYTES
                if out:
                    tail = (tail + out)[-4:]
                    yield out
        except zlib.error:
            for out in _before_damage(before, given):
                tail = (tail + out)[-4:]
                yield out
            if tail and tail != b"\r\n\r\n":
                yield b"\r\n\r\n"
            used = 1
            while (at := held.find(_GZIP, used)) < 0:
                if not (piece := next(pieces, b"")):
                    return
                del held[: 1 - len(_GZIP)]
                held += piece
                used = 0
            used = at


def _before_damage(member, given: bytes) -> Iterator[bytes]:
    """What a member in the state before ``given`` still gives of it in small steps."""
    try:
        for at in range(0, len(given), 64):
            if out := member.decompress(given[at : at + 64]):
                yield out
    except zlib.error:
        return


def _id_in(record: bytes) -> str | None:
    """The id in a record's header: the bare digest of ``urn:md5:``, else all between the brackets."""
    head = record[: max(0, record.find(b"\r\n\r\n", 0, HEAD_BYTES))]
    found = re.search(rb"(?i)^WARC-Record-ID: *<(?:urn:md5:)?([^<>\r\n]{1,1000})>", head, re.M)
    return found[1].decode("utf-8", "replace") if found else None


def read_warc(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Leaves (file, offset, length, sha256) of the WARC files that ``write_warc`` made; record_id with ``ids``."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["file"].to_pylist(), batch["content"], strict=True):
                rows = list(parse_stream(iter([data.as_py()])))
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(rows), pa.int64()),
                        pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.string()),
                        pa.array(columns[3], pa.string()),
                    ],
                    names=["file", "offset", "length", "sha256", "record_id"],
                )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    number = F.regexp_extract("path", r"file=(\d+)/", 1).cast("long")
    named = files.where(F.col("path").rlike(r"file=\d+/")).select(number.alias("file"), "content")
    leaves = named.mapInArrow(records, "file long, offset long, length long, sha256 string, record_id string")
    return leaves if ids else leaves.drop("record_id")


class ArchivePartition(InputPartition):
    def __init__(self, name: str):
        self.name = name


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[ArchivePartition]:
        return [ArchivePartition(name) for name, _ in find(self.path)]

    def read(self, partition: ArchivePartition | None) -> Iterator[tuple]:
        if partition is None:  # Spark's one partition of a source without files
            return
        name = partition.name.rsplit("/", 1)[-1].removesuffix(".gz")
        with open_file(partition.name) as file:
            pieces = iter(lambda: file.read(PIECE_BYTES), b"")
            first = next(pieces, b"")
            stream = chain([first], pieces)
            packed = first.startswith(_GZIP)
            for row in parse_stream(inflated(stream) if packed else stream):
                yield (name, *row)


class ArchiveSource(DataSource):
    """WARC files, plain or gzip, on a shared mount or in an object store: a task a file, a record in memory."""

    @classmethod
    def name(cls) -> str:
        return "warc_records"

    def schema(self) -> str:
        return "name string, offset long, length long, sha256 string, record_id string"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(name, offset, length, sha256, record_id) of every record of WARC files of any make and size.

    ``path`` is a file, a folder or a pattern.  Offsets, lengths and hashes are those of the content
    before compression, and names go without ``.gz``, so a compressed replica equals a plain one.  A file
    without a readable header is one record; an empty file, and a folder without files, have none.
    """
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("warc_records").load(path)


def numbered(*replicas: DataFrame) -> list[DataFrame]:
    """Replicas from ``read_archives`` with the ``file`` number of each name, as ``audit`` reads them.

    All names, a row a file, are ordered in one task.
    """
    names = reduce(DataFrame.unionByName, [r.select("name") for r in replicas]).distinct()
    files = cut(names.select("name", (F.row_number().over(Window.orderBy("name")) - 1).cast("long").alias("file")))
    return [r.join(files, "name").select("file", "offset", "length", "sha256", "record_id") for r in replicas]


def _node(rows: DataFrame, file: Column, slot: Column) -> DataFrame:
    """Parents (replica, file, slot, hash) of rows (replica, file, slot, length, hash)."""
    child = F.struct("file", "slot", "length", "hash")
    text = F.array_join(
        F.transform(F.array_sort("children"), lambda c: F.concat_ws(":", c["file"], c["slot"], c["length"], c["hash"])), ";"
    )
    return (
        rows.groupBy("replica", file.alias("file"), slot.alias("slot"))
        .agg(F.collect_list(child).alias("children"), F.sum("length").alias("length"))
        .select("replica", "file", "slot", "length", F.sha2(text.cast("binary"), 256).alias("hash"))
    )


def trees(first: DataFrame, second: DataFrame) -> list[tuple[DataFrame, Column, Column]]:
    """Levels from the leaves up, each with the key of its nodes' parents.

    A level has the nodes of both replicas: (replica, file, slot, length, hash), leaves record_id too.
    """
    one, two = (
        leaves.select(
            F.lit(k).alias("replica"),
            "file",
            F.col("offset").alias("slot"),
            "length",
            F.col("sha256").alias("hash"),
            (F.col("record_id") if "record_id" in leaves.columns else F.lit(None).cast("string")).alias("record_id"),
        )
        for k, leaves in enumerate((first, second))
    )
    level = cut(one.unionByName(two))
    most = level.agg(F.max("slot"), F.max("file")).first()
    slots, files = most[0] or 0, most[1] or 0
    levels = []
    size = RANGE_BYTES
    while True:
        if levels and slots == 0 and files == 0:
            levels.append((level, F.col("file"), F.col("slot")))
            return levels
        if not levels or slots:
            file, slot = F.col("file"), F.floor(F.col("slot") / size).cast("long")
            slots //= size
        else:
            file, slot = F.floor(F.col("file") / FANOUT).cast("long"), F.lit(0).cast("long")
            files //= FANOUT
        levels.append((level, file, slot))
        level = cut(_node(level, file, slot))
        size = FANOUT


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """(file, offset, length, status) of every record in which two sets of leaves differ.

    Records that only moved inside their file agree.  ``corrupt``: with other content or length, by
    ``record_id`` where both sets have it, else where the record stands after the last sound one
    or at the same offset; ``missing``: only in ``first``; ``extra``: only in ``second``.  ``offset``
    and ``length`` are those of ``first`` where it has the record.  Two empty replicas agree; against an
    empty one every record is missing or extra.  Columns other than file, offset, length, sha256 and record_id
    are not read, so their names cannot clash.
    Records equal in offset in one file of one replica are a broken index; the greatest hash
    stands for them.
    """
    levels = trees(first, second)
    differing = None
    for level, file, slot in reversed(levels):
        nodes = level.select("*", file.alias("up_file"), slot.alias("up_slot"))
        if differing is not None:
            nodes = nodes.join(
                differing.select(F.col("file").alias("up_file"), F.col("slot").alias("up_slot")),
                ["up_file", "up_slot"],
                "left_semi",
            )
        held = [c for c in ("hash", "length", "record_id") if c in level.columns]
        here = [F.max(F.when(F.col("replica") == k, F.struct(*held))).alias(f"r{k}") for k in (0, 1)]
        same = F.col("r0.hash").eqNullSafe(F.col("r1.hash")) & F.col("r0.length").eqNullSafe(F.col("r1.length"))
        pairs = nodes.groupBy("file", "slot").agg(*here).where(~same)
        before, differing = differing, cut(pairs)
        if before is not None:
            drop_cut(before)
    for level, _, _ in levels:
        drop_cut(level)
    return _located(differing)


def _paired(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``o0`` and ``o1``, the offsets in both replicas where the n-th of equal keys is in both."""
    ordered = Window.partitionBy("file", "replica", *keys).orderBy("offset")
    both = Window.partitionBy("file", *keys, "nth")
    offsets = [F.max(F.when(F.col("replica") == k, F.col("offset"))).over(both).alias(f"o{k}") for k in (0, 1)]
    return rows.withColumn("nth", F.row_number().over(ordered)).select("*", *offsets).drop("nth")


def _located(differing: DataFrame) -> DataFrame:
    """What is lost, spoilt or new among leaves (file, slot, r0, r1) that differ at their offsets."""
    sides = F.array(*[F.struct(F.lit(k).alias("replica"), F.col(f"r{k}").alias("leaf")) for k in (0, 1)])
    rows = differing.select("file", F.col("slot").alias("offset"), F.explode(sides).alias("s")).where("s.leaf IS NOT NULL")
    rows = rows.select("file", "offset", "s.replica", "s.leaf.hash", "s.leaf.length", "s.leaf.record_id")
    rows = _paired(rows, "hash", "length")
    earlier = Window.partitionBy("file", "replica").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.last(F.col("o1") - F.col("o0"), ignorenulls=True).over(earlier), F.lit(0))
    moved = F.col("o0").isNotNull() & F.col("o1").isNotNull()
    rest = rows.withColumn("place", F.col("offset") - F.when(F.col("replica") == 1, shift).otherwise(0)).where(~moved)
    rest = rest.select("file", "offset", "replica", "length", "record_id", "place")
    rest = rest.withColumn("spot", F.col("offset"))
    done = None
    for key in ("record_id", "place", "spot"):
        marked = cut(_paired(rest, key))
        hit = F.col(key).isNotNull() & F.col("o0").isNotNull() & F.col("o1").isNotNull()
        here = marked.where(hit & (F.col("replica") == 0)).select("file", "offset", "length", F.lit("corrupt").alias("status"))
        done = here if done is None else done.unionByName(here)
        rest = marked.where(~hit).drop("o0", "o1")
    alone = F.when(F.col("replica") == 0, "missing").otherwise("extra").alias("status")
    return done.unionByName(rest.select("file", "offset", "length", alone))


def with_damage(records: DataFrame) -> DataFrame:
    """``records`` with ``copy``: the hash of the record in a second replica with known damage.

    For audits where only one replica is at hand.  Of the record's SHA-256, the first eight hex digits
    modulo 97 choose: 3, the content has a byte more; 5, the record is gone and ``copy`` is null.
    """
    lot = F.conv(F.substring("sha256", 1, 8), 16, 10).cast("long") % 97
    spoilt = F.sha2(F.concat(F.col("record"), F.lit("~")).cast("binary"), 256)
    return records.withColumn("copy", F.when(lot == 3, spoilt).when(lot != 5, F.col("sha256")))


def damaged_copy(laid_out: DataFrame) -> DataFrame:
    """Leaves of the second replica of records ``with_damage``, at the offsets of the first."""
    return laid_out.where("copy IS NOT NULL").select("file", "offset", "length", F.col("copy").alias("sha256"))


def damaged_records(records: DataFrame) -> DataFrame:
    """The records of a second replica with the damage of ``with_damage``: own contents, lengths and hashes.

    Lay them out with the number of files of the first; what follows a lost or longer record moves.
    """
    lot = F.conv(F.substring("sha256", 1, 8), 16, 10).cast("long") % 97
    kept = records.where(lot != 5).withColumn("record", F.when(lot == 3, F.concat("record", F.lit("~"))).otherwise(F.col("record")))
    return kept.select(
        "page_id",
        "record_id",
        "record",
        "key",
        (F.octet_length("record") + 4).cast("long").alias("length"),
        F.sha2(F.col("record").cast("binary"), 256).alias("sha256"),
    )

"""Tar archives: members, and shards of samples."""

from __future__ import annotations

import io
import json
import os
import random
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringContains
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructType

from .files import find, open_file

_MEMBER = pa.list_(
    pa.struct(
        [
            ("member_idx", pa.int32()),
            ("name", pa.string()),
            ("type", pa.string()),
            ("offset", pa.int64()),
            ("offset_data", pa.int64()),
            ("size", pa.int64()),
        ]
    )
)


def _rows(archive: tarfile.TarFile) -> Iterator[dict]:
    for k, m in enumerate(archive):
        kind = m.type.decode("latin-1").replace("\0", "0")
        size = m.size if m.isreg() else 0
        yield {"member_idx": k, "name": m.name, "type": kind, "offset": m.offset, "offset_data": m.offset_data, "size": size}
        archive.members.clear()  # what has been read is not kept


def list_members(data: bytes) -> list[dict]:
    """Members in archive order.  Extended headers belong to the member they describe."""
    if not tarfile.is_tarfile(io.BytesIO(data)):
        raise ValueError("not a tar archive")
    with tarfile.open(fileobj=io.BytesIO(data)) as archive:
        return list(_rows(archive))


@F.arrow_udf(from_arrow_type(_MEMBER))
def _members(data: pa.Array) -> pa.Array:
    return pa.array([list_members(d) for d in data.to_pylist()], _MEMBER)


@F.arrow_udf(T.BooleanType())
def is_tar(data: pa.Array) -> pa.Array:
    return pa.array([tarfile.is_tarfile(io.BytesIO(d or b"")) for d in data.to_pylist()], pa.bool_())


def members(blobs: DataFrame) -> DataFrame:
    """(blob_id, member_idx, name, type, offset, offset_data, size) of tar blobs."""
    return blobs.select("blob_id", F.inline(_members("data")))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata records of archives, one JSON document a file, by an explicit schema."""
    files = "array<struct<Name:string,Size:long>>"
    schema = (
        "name string, path string, label string, image__size long, "
        f"diffs struct<Adds:{files},Dels:{files},Mods:{files}>, packages array<string>, "
        "malwares array<struct<sha256_hash:string,file_type_guess:string,signature:string,tags:string>>"
    )
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_split(spark: SparkSession, path: str, image_dir: str) -> DataFrame:
    """(path, label) of a JSON split of (name, label): 0 for benign, else 1."""
    rows = spark.read.schema("name string, label string").option("multiLine", True).json(path)
    return rows.select(
        F.concat(F.lit(f"{image_dir.rstrip('/')}/"), "name", F.lit(".png")).alias("path"),
        F.when(F.col("label") == "benign", 0).otherwise(1).alias("label"),
    )


def read_image_dir(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, content) of a labelled folder; the label is in the path, masks are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = found.where(F.col("path").endswith(".png") & ~F.col("path").endswith(".mask.png"))
    return kept.select("path", F.when(F.col("path").contains("benign"), 0).otherwise(1).alias("label"), "content")


class ShardPartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ShardReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.splits = options["path"], [options["split"]] if options.get("split") else []
        self.seed = options.get("seed")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the shard's file name choose shards before any is opened."""
        for f in filters:
            if isinstance(f, StringContains) and f.attribute == ("shard",):
                self.splits.append(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("shard",):
                self.splits.append(f.value)
                yield f
            else:
                yield f

    def partitions(self) -> list[ShardPartition]:
        found = [name for name, _ in find(self.path, ".tar")]
        if self.seed is not None:
            random.Random(self.seed).shuffle(found)
        return [ShardPartition(p) for p in found if all(s in os.path.basename(p) for s in self.splits)]

    def read(self, partition: ShardPartition | None) -> Iterator[tuple]:
        if partition is None:  # Spark's one partition of a source without files
            return
        held: dict[str, dict[str, bytes]] = {}
        shard = os.path.basename(partition.path)
        with open_file(partition.path) as file, tarfile.open(fileobj=file) as archive:
            for m in archive:
                if not m.isreg():
                    continue
                folder, base = os.path.split(m.name)
                key, _, part = base.partition(".")
                key = os.path.join(folder, key)
                sample = held.setdefault(key, {})
                sample[part] = archive.extractfile(m).read()
                if {"png", "mask.png", "json"} <= sample.keys():
                    meta = json.loads(sample["json"])
                    yield shard, key, sample["png"], sample["mask.png"], meta.get("name"), meta.get("label")
                    del held[key]


class ShardSource(DataSource):
    """Samples of tar shards on a shared mount or in an object store, a task a shard; incomplete samples are left out."""

    @classmethod
    def name(cls) -> str:
        return "sample_shards"

    def schema(self) -> str:
        return "shard string, key string, png binary, mask binary, name string, label string"

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(self.options)


def read_shards(spark: SparkSession, path: str, split: str | None = None, seed: int | None = None) -> DataFrame:
    """(shard, key, png, mask, name, label) of shards whose file name holds ``split``.

    Shards are read in the order of their names or, with ``seed``, in an order that it gives.
    Filters on ``shard`` reach the source too; the session setting that lets them is turned on.
    """
    spark.dataSource.register(ShardSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("sample_shards")
    if seed is not None:
        reader = reader.option("seed", str(seed))
    return (reader.option("split", split) if split else reader).load(path)


class MemberReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[ShardPartition]:
        return [ShardPartition(name) for name, _ in find(self.path, ".tar")]

    def read(self, partition: ShardPartition | None) -> Iterator[tuple]:
        if partition is None:  # Spark's one partition of a source without files
            return
        with open_file(partition.path) as file, tarfile.open(fileobj=file, mode="r:") as archive:
            for row in _rows(archive):
                yield (partition.path, *row.values())


class MemberSource(DataSource):
    """Members of tar files on a shared mount or in an object store, a task a file: headers are read, and contents skipped."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "blob_id string, member_idx int, name string, type string, offset long, offset_data long, size long"

    def reader(self, schema: StructType) -> MemberReader:
        return MemberReader(self.options)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """(blob_id, member_idx, name, type, offset, offset_data, size) of archives of any size."""
    spark.dataSource.register(MemberSource)
    return spark.read.format("tar_members").load(path)

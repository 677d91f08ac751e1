"""A store of results with commits: many writers, one row a content hash, ids that only grow.

Rows are Parquet below ``data``; a commit is one small file below ``commits``, named by its version, that says
which folder of rows it adds and from which id on.  A commit is made by putting its finished file under a
name that must not exist yet, so of two writers that reach for one version one succeeds.  The other reads what
was committed meanwhile, drops the rows that are stored now, and tries the next version.  Readers see the commits
up to one version, and nothing of writers that failed or have not committed.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "sa_hash"
SCHEMA = "id long, sa_hash string, created_at timestamp, stix_report string, application_area int, status string"
_LOCAL_ID = "_local_id"


class ResultStore:
    """A folder of commits on a file system whose renames do not replace files, as HDFS, or on a shared mount."""

    def __init__(self, spark: SparkSession, path: str, schema: str = SCHEMA):
        self.spark, self.path = spark, path.rstrip("/")
        parsed = T._parse_datatype_string(schema)
        self.schema = T.StructType([f for f in parsed if f.name != "id"])
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(f"{self.path}/commits"))

    # commits

    def _commit_path(self, version: int) -> str:
        return f"{self.path}/commits/{version:020d}.json"

    def version(self) -> int:
        """Of the last commit; 0 before the first."""
        names = (s.getPath().getName() for s in self._files.listStatus(self._path(f"{self.path}/commits")))
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def _read_commit(self, version: int) -> dict:
        stream = self._files.open(self._path(self._commit_path(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def commits(self, version: int | None = None) -> list[dict]:
        """What a version shows: its last whole commit, if any, and those after it."""
        found: list[dict] = []
        for v in range(self.version() if version is None else version, 0, -1):
            found.append(self._read_commit(v))
            if found[-1]["whole"]:
                break
        return found[::-1]

    def _try_commit(self, version: int, commit: dict) -> bool:
        """Put the commit under its version's name; False if another writer has it."""
        target, held = self._commit_path(version), f"{self.path}/commits/.{uuid.uuid4().hex}"
        stream = self._files.create(self._path(held), False)
        stream.write(bytearray(json.dumps(commit | {"version": version}).encode()))
        stream.close()
        if self._files.getUri().getScheme() == "file":
            source, goal = (urlparse(p).path for p in (held, target))
            try:
                os.link(source, goal)  # unlike a rename, fails where the name exists
                made = True
            except FileExistsError:
                made = False
            self._files.delete(self._path(held), False)
            return made
        made = not self._files.exists(self._path(target)) and self._files.rename(self._path(held), self._path(target))
        if not made:
            self._files.delete(self._path(held), False)
        return made

    # rows

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version (by default the last), with their ids."""
        commits = [c for c in self.commits(version) if c["rows"]]
        names = [f.name for f in self.schema]
        if not commits:
            return self.spark.createDataFrame([], T.StructType([T.StructField("id", T.LongType()), *self.schema]))
        stored = T.StructType([T.StructField(_LOCAL_ID, T.LongType()), *self.schema])
        rows = self.spark.read.schema(stored).parquet(*[f"{self.path}/data/{c['folder']}" for c in commits])
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]+)/", 1)
        bases = self.spark.createDataFrame([(c["folder"], c["base"]) for c in commits], "_folder string, _base long")
        joined = rows.withColumn("_folder", folder).join(bases, "_folder")
        return joined.select((F.col("_base") + F.col(_LOCAL_ID)).alias("id"), *names)

    def _stage(self, rows: DataFrame) -> dict:
        """Write rows where no version shows them yet."""
        folder = uuid.uuid4().hex
        target = f"{self.path}/data/{folder}"
        rows.select(F.monotonically_increasing_id().alias(_LOCAL_ID), *[f.name for f in self.schema]).write.parquet(target)
        n, last = self.spark.read.parquet(target).agg(F.count("*"), F.max(_LOCAL_ID)).first()
        return {"folder": folder, "rows": n, "span": 0 if last is None else last + 1, "whole": False}

    def _staged(self, commit: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/{commit['folder']}").drop(_LOCAL_ID)

    def _next_id(self, commits: list[dict]) -> int:
        return commits[-1]["base"] + commits[-1]["span"] if commits else 1

    def append(self, results: DataFrame) -> int:
        """Add the rows whose hash is not stored, one a hash; the version that has them.

        Running twice, or in two places at once, adds nothing twice.  Without new rows no version is made.
        """
        seen = self.version()
        stored = self.read(seen).select(KEY)
        staged = self._stage(results.join(stored, KEY, "left_anti").dropDuplicates([KEY]))
        while staged["rows"]:
            history = self.commits(seen)
            if self._try_commit(seen + 1, staged | {"base": self._next_id(history)}):
                return seen + 1
            before, seen = seen, self.version()
            others = [f"{self.path}/data/{c['folder']}" for v in range(before + 1, seen + 1) if (c := self._read_commit(v))["rows"]]
            if others:
                theirs = self.spark.read.parquet(*others).select(KEY)
                left = self._staged(staged).join(theirs, KEY, "left_anti")
                if left.count() < staged["rows"]:
                    staged = self._stage(left)
        return seen

    def compact(self) -> int:
        """One commit that holds all rows with their ids, so that readers open one folder; older versions stay readable."""
        while True:
            seen = self.version()
            history = self.commits(seen)
            if len(history) < 2:
                return seen
            folder = uuid.uuid4().hex
            rows = self.read(seen).withColumnRenamed("id", _LOCAL_ID)
            rows.write.parquet(f"{self.path}/data/{folder}")
            whole = {"folder": folder, "rows": sum(c["rows"] for c in history), "base": 0, "span": self._next_id(history), "whole": True}
            if self._try_commit(seen + 1, whole):
                return seen + 1

"""A collection of points with a log of commits: upserts, deletes, snapshots, records about it.

A commit is a numbered file that is only ever created, so that of two writers with one
number one fails and takes the next.  It names the folder that the writer has written
before; nothing is changed in place.  A reader takes the commits up to a number and
merges their folders: of a point the latest counts.  What it has read stays as it was,
whatever is committed meanwhile.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.paths import file_system

#: Tries of a commit before giving up: each failure means that another writer got through.
TRIES = 100


@dataclass
class Part:
    """A folder of a collection: ``points``, or the ids of ``deleted`` ones, as of a commit's number."""

    order: int
    kind: str
    folder: str


class Collection:
    """Points under ``path``, one for each value of ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # --- the log

    def _commits(self) -> list[dict]:
        """All commits in order; one whose file is still being written is none yet."""
        where, store = file_system(self.spark, f"{self.path}/log")
        if not store.exists(where):
            return []
        out = []
        for status in sorted(store.listStatus(where), key=lambda s: s.getPath().getName()):
            stream = store.open(status.getPath())
            try:
                text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            finally:
                stream.close()
            if not text.endswith("\n"):
                break
            out.append(json.loads(text))
        return out

    def _commit(self, entry: dict) -> int:
        """Writes a commit under the next free number, and returns that."""
        number = self.version() + 1
        for _ in range(TRIES):
            stream = self._created(f"{self.path}/log/{number:012d}.json")
            if stream is None:
                number += 1
                continue
            stream.write(bytearray((json.dumps(entry | {"version": number}) + "\n").encode()))
            stream.close()
            return number
        raise RuntimeError(f"no commit to {self.path} after {TRIES} tries")

    def _created(self, path: str):
        """A stream into a new file, or none if there is one; the store must let one of two writers through only."""
        where, store = file_system(self.spark, path)
        try:
            if store.getScheme() != "file":
                return store.create(where, False)
            # a machine's own files: what looks first and then creates would let both through
            store.mkdirs(where.getParent())
            return store.create(where, True) if self.spark._jvm.java.io.File(where.toUri().getPath()).createNewFile() else None
        except Py4JJavaError as e:
            if "exists" not in str(e.java_exception).lower():
                raise
            return None

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max((c["version"] for c in self._commits()), default=0)

    def parts(self, version: int | None = None) -> tuple[list[Part], str | None]:
        """The folders that make the collection as of a version, oldest first, and its schema."""
        parts, schema = [], None
        for c in self._commits():
            if version is not None and c["version"] > version:
                break
            if c["kind"] == "create":
                parts, schema = [], c["schema"]
            if c["kind"] == "compact":
                parts = [Part(c["upto"], "points", c["folder"]), *[p for p in parts if p.order > c["upto"]]]
            else:
                parts.append(Part(c["version"], "deleted" if c["kind"] == "delete" else "points", c["folder"]))
        return parts, schema

    # --- writing

    def _write(self, rows: DataFrame) -> str:
        """A folder of rows, range-partitioned and sorted by key, so that filters on it prune."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.repartitionByRange(self.key).sortWithinPartitions(self.key).write.parquet(f"{self.path}/{folder}")
        return folder

    def _one_each(self, points: DataFrame) -> DataFrame:
        """One point of each key: of several the one with the least digest; null keys are an error."""
        others = [c for c in points.columns if c != self.key]
        digest = F.xxhash64(*others) if others else F.lit(0)
        known = F.when(F.col(self.key).isNull(), F.raise_error(F.lit(f"a point without {self.key}"))).otherwise(F.col(self.key))
        return points.withColumn(self.key, known).groupBy(self.key).agg(F.min_by(F.struct(*points.columns), digest).alias("p")).select("p.*")

    def create(self, points: DataFrame) -> int:
        """The collection anew, from points whose columns it will have; what was there before is gone from this version on."""
        return self._commit({"kind": "create", "folder": self._write(self._one_each(points)), "schema": points.schema.json()})

    def upsert(self, points: DataFrame) -> int:
        """Points in place of those with the same key, or besides.  Both of two upserts at a time are there; of a point that is in both, the later commit's."""
        _, schema = self.parts()
        if schema is None:
            raise FileNotFoundError(self.path)
        names = T.StructType.fromJson(json.loads(schema)).fieldNames()
        return self._commit({"kind": "upsert", "folder": self._write(self._one_each(points.select(*names)))})

    def delete(self, keys: DataFrame) -> int:
        """Points with these keys go; keys that no point has are ignored."""
        return self._commit({"kind": "delete", "folder": self._write(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct())})

    def compact(self) -> int:
        """One folder in place of those so far; upserts that come in meanwhile stay beside it."""
        upto = self.version()
        return self._commit({"kind": "compact", "upto": upto, "folder": self._write(self.read(upto))})

    # --- reading

    def read(self, version: int | None = None, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
        """The points as of a version, the last unless given, with these columns.

        ``where`` may be on the key, and then prunes files, or on other columns.  Every
        folder's rows meet only the keys of later folders, which are as small as their
        commits.
        """
        parts, schema = self.parts(version)
        if schema is None:
            raise FileNotFoundError(self.path)
        kind = T.StructType.fromJson(json.loads(schema))
        keys = T.StructType([kind[self.key]])
        out, later = self.spark.createDataFrame([], kind), None
        for part in reversed(parts):
            rows = self.spark.read.schema(keys if part.kind == "deleted" else kind).parquet(f"{self.path}/{part.folder}")
            if part.kind == "points":
                out = out.unionByName(rows if later is None else rows.join(later, self.key, "left_anti").select(*kind.fieldNames()))
            later = rows.select(self.key) if later is None else later.unionByName(rows.select(self.key))
        out = out if where is None else out.where(where)
        return out if columns is None else out.select(*columns)

    def info(self, version: int | None = None) -> DataFrame:
        """One row: name, number of points, version, folders and status (``green`` with one folder of points, ``yellow`` if a compaction would help)."""
        parts, _ = self.parts(version)
        count = self.read(version).agg(F.count("*").alias("points_count"))
        status = "green" if len(parts) == 1 else "yellow"
        return count.select(F.lit(self.path.rsplit("/", 1)[-1]).alias("name"), "points_count", F.lit(self.version() if version is None else version).alias("version"), F.lit(len(parts)).alias("folders"), F.lit(status).alias("status"))

    def exists(self) -> bool:
        """Whether there is such a collection, with a point in it."""
        return self.parts()[1] is not None and self.read().limit(1).count() > 0


RECORDS = T.StructType([T.StructField("key", T.StringType()), T.StructField("record", T.StringType()), T.StructField("stamped_at", T.LongType())])


def put_record(records: Collection, key: str, record: DataFrame, stamped_at: int) -> int:
    """A row about a collection, as JSON under ``key``, in a collection of such records; the last one put counts."""
    spark = records.spark
    if records.parts()[1] is None:
        records.create(spark.createDataFrame([], RECORDS))
    row = record.limit(1).select(F.lit(key).alias("key"), F.to_json(F.struct(*record.columns), {"ignoreNullFields": "false"}).alias("record"), F.lit(stamped_at).cast("long").alias("stamped_at"))
    return records.upsert(row)


def get_record(records: Collection, key: str, schema: str) -> DataFrame:
    """The record under ``key`` as a row of this schema, with ``stamped_at``; no row if there is none."""
    if records.parts()[1] is None:
        return records.spark.createDataFrame([], RECORDS).select(F.from_json("record", schema).alias("r"), "stamped_at").select("r.*", "stamped_at")
    return records.read(where=F.col("key") == key).select(F.from_json("record", schema).alias("r"), "stamped_at").select("r.*", "stamped_at")

"""Keyed tables of documents that are changed bucket by bucket, in versions."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["user_id", "document_id"]
_COMMIT = "batch string, name string, bucket int, folder string"


class Store:
    """Tables keyed by ``(user_id, document_id)`` in ``path``, each row in a bucket by a hash of its key.

    A commit replaces all rows of some documents in all tables at once. It rewrites the buckets that these
    documents fall into, as new files beside the old ones, and then puts a small file in place, under a name with
    its version and batch, that has the folder of each bucket of each table: that is the swap. Readers see the
    tables before it or after it, never half of it; what a failed attempt left behind is named by no commit. A batch that
    is committed already changes nothing. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str], buckets: int = 64, files: int = 8):
        self.spark, self.path, self.schemas, self.buckets, self.files = spark, path.rstrip("/"), schemas, buckets, files

    def _place(self, name: str):
        """A path below the store and its file system."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _below(self, folder: str) -> list[str]:
        """The names in a folder; none where it doesn't exist."""
        place, system = self._place(folder)
        return [x.getPath().getName() for x in system.listStatus(place)] if system.exists(place) else []

    def _commits(self) -> dict[int, str]:
        """The digest of each version's batch, oldest first, from the names of the commits."""
        return {int(x[2:14]): x[15:] for x in sorted(self._below("commits")) if x.startswith("v=")}

    def versions(self) -> list[int]:
        return list(self._commits())

    def _folders(self, version: int | None = None) -> dict[tuple[str, int], str]:
        """The folder of each bucket of each table, as a commit (by default the last one) has them. As many
        rows as there are buckets meet the driver, not rows of tables."""
        held = {v: x for v, x in self._commits().items() if version is None or v <= version}
        if not held:
            return {}
        last = max(held)
        rows = self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits/v={last:012d}.{held[last]}").where("name is not null").collect()
        return {(r.name, r.bucket): r.folder for r in rows}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(x).cast("string") for x in KEY)), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        schema = self.schemas[name]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{x}" for x in sorted(folders)))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of the last commit, or of an earlier ``version``."""
        return self._read(name, [f for (n, _), f in self._folders(version).items() if n == name])

    def commit(self, batch: str, keys: DataFrame, rows: dict[str, DataFrame]) -> list[int]:
        """Replace the rows of the documents ``keys`` by ``rows`` (of those documents only) in
        every table; a table without rows loses them. Returns the buckets that were rewritten, none where the
        batch is known. ``keys`` and ``rows`` are read once for each table, so give tables."""
        known, digest = self._commits(), hashlib.md5(batch.encode()).hexdigest()
        if digest in known.values():
            return []
        version = max(known, default=0) + 1
        keys = keys.select(*KEY).distinct()
        touched = sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())
        folders = self._folders()
        for name in self.schemas if touched else ():
            held = self._read(name, [f for (n, b), f in folders.items() if n == name and b in touched])
            kept = held.join(keys, KEY, "left_anti")
            new = rows[name].select(*held.columns) if name in rows else held.limit(0)
            folder = f"{name}/{uuid.uuid4().hex}"
            placed = kept.unionByName(new).withColumn("bucket", self.bucket())
            # a bucket is written by several tasks, of which adaptive execution joins small ones
            placed.repartition(F.col("bucket"), F.pmod(F.xxhash64("document_id"), F.lit(self.files))).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            made = set(self._below(folder))
            folders = {k: f for k, f in folders.items() if k[0] != name or k[1] not in touched}
            folders |= {(name, b): f"{folder}/bucket={b}" for b in touched if f"bucket={b}" in made}
        out = [(batch, name, b, f) for (name, b), f in sorted(folders.items())]
        attempt, target = f"attempts/{uuid.uuid4().hex}", f"commits/v={version:012d}.{digest}"
        self.spark.createDataFrame(out or [(batch, None, None, None)], _COMMIT).coalesce(1).write.parquet(f"{self.path}/{attempt}")
        (place, system), (final, _) = self._place(attempt), self._place(target)
        system.mkdirs(final.getParent())
        if not system.rename(place, final):
            raise RuntimeError(f"the commit of {batch} could not be put in place")
        return touched

"""Tables in hash buckets of a key, changed by rewriting only the buckets that a change touches.

Rows lie in ``data/version=N/_bucket=B``. A version is a manifest, one row per bucket that says in
which version's folder the bucket's files are, so a new version shares the folders of all untouched
buckets with the last one. The manifest is written last: readers see the old version or the new one,
and a change that is repeated after a failure finds its version there, or writes it again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256
_MANIFEST = "buckets int, bucket int, held_in long"


class BucketedTable:
    """A table at ``path`` with columns ``schema`` (DDL), bucketed by ``key`` and sorted by ``order`` within files.

    ``shown`` makes what ``read`` gives of rows as they are stored; changes deal with them as stored.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str | T.StructType, key: list[str], order: list[str] | None = None,
        buckets: int = BUCKETS, shown: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.spark, self.path, self.key, self.buckets, self.shown = spark, path.rstrip("/"), list(key), buckets, shown
        self.order = list(order or key)
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _files(self, folder: str, name: str) -> set[int]:
        """Numbers N of the folders ``name=N`` below ``folder`` that hold files: a listing, no job."""
        try:
            found = self.spark.read.schema("_ int").parquet(f"{self.path}/{folder}").inputFiles()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return set()
        return {int(re.search(rf"/{name}=(\d+)/", f)[1]) for f in found}

    def version(self, before: int | None = None) -> int | None:
        """The last version, or the last one before some other; None if there is none."""
        return max((v for v in self._files("manifest", "version") if before is None or v < before), default=None)

    def folders(self, version: int | None = None) -> dict[int, int]:
        """Bucket numbers of a version (by default the last) and the versions that wrote them."""
        version = self.version() if version is None else version
        if version is None:
            return {}
        # One row per bucket, so at most ``buckets`` rows.
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/version={version}").collect()
        if any(r.buckets != self.buckets for r in rows):
            raise ValueError(f"{self.path} has {rows[0].buckets} buckets, not {self.buckets}")
        return {r.bucket: r.held_in for r in rows if r.bucket is not None}

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version (by default the last), of some buckets or of all; empty if there is no version."""
        rows = self._stored(version, only)
        return self.shown(rows) if self.shown else rows

    def _stored(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        held = {b: v for b, v in self.folders(version).items() if only is None or b in only}
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/version={v}/_bucket={b}" for b, v in sorted(held.items())])

    def touched(self, keys: DataFrame) -> set[int]:
        """Buckets of the keys of some rows: at most ``buckets`` numbers, combined map-side."""
        return {r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()}

    def write(self, rows: DataFrame, version: int | None = None) -> int:
        """All rows anew."""
        return self._commit(rows, None, version)

    def upsert(self, changes: DataFrame, version: int | None = None) -> int:
        """Rows of ``changes`` in place of stored ones of equal key; of each key there should be one row on either side."""
        def replaced(stored: DataFrame) -> DataFrame:
            return stored.join(changes.select(*self.key), self.key, "left_anti").unionByName(changes.select(*stored.columns))

        return self.update(replaced, changes, version)

    def update(self, change: Callable[[DataFrame], DataFrame], keys: DataFrame | set[int], version: int | None = None) -> int:
        """``change`` applied to the buckets that hold ``keys``, or to these buckets; it must leave rows in their buckets."""
        last = self.version(version)
        only = keys if isinstance(keys, set) else self.touched(keys)
        stored = self._stored(last, only) if last is not None else self.spark.createDataFrame([], self.schema)
        return self._commit(change(stored), only, version)

    def _commit(self, rows: DataFrame, only: set[int] | None, version: int | None) -> int:
        last = self.version()
        if version is None:
            version = 0 if last is None else last + 1
        elif last is not None and version <= last:
            return version  # written before a failure
        held = {} if only is None else {b: v for b, v in self.folders(self.version(version)).items() if b not in only}
        folder = f"data/version={version}"
        names = self.schema.fieldNames()
        if only is None or only:
            # Rebalancing splits a bucket that a hot key fills over several tasks and files.
            (
                rows.select(*names, self.bucket().alias("_bucket")).hint("rebalance", "_bucket")
                .sortWithinPartitions("_bucket", *self.order).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            )
            held |= {b: version for b in self._files(folder, "_bucket")}
        manifest = [(self.buckets, b, v) for b, v in sorted(held.items())] or [(self.buckets, None, None)]
        self.spark.createDataFrame(manifest, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        return version

"""Keyed tables whose updates write only what they touch.

Rows are dealt to buckets by a hash of some key columns. An update reads and writes the buckets that its
rows fall in; a new version takes all others over as they are. A version is one small file that lists the
folder of each bucket, so a reader sees the table before an update or after it, never a mixture.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from salesmart.operators.upsert import upsert
from salesmart.sources.shared import discard, settle

BUCKETS = 256


@dataclass(frozen=True)
class KeyedTable:
    """A stored table with unique ``keys`` below ``folder``.

    Rows are dealt ``by`` some of the keys (all of them by default): dealt by store, an update of one
    store's rows touches one bucket. A bucket may have any size, as its rows are joined by the whole key and
    written in as many files as they need. ``buckets`` and ``by`` stay as the first version has them;
    others are an error. A null in a key matches nothing, so such rows are always new. Only numbers and folders of buckets reach the driver.
    """

    spark: SparkSession
    folder: str
    schema: str
    keys: tuple[str, ...]
    by: tuple[str, ...] = ()
    buckets: int = BUCKETS

    # ---- reading

    def version(self) -> int:
        """The number of the newest version; 0 before the first."""
        return max(self._versions(), default=0)

    def parts(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        version = self.version() if version is None else version
        if version == 0:
            return {}
        listed = json.loads(self.spark.read.text(f"{self.folder}/versions/{version}", wholetext=True).first()[0])
        if (listed["buckets"], listed["by"]) != (self.buckets, list(self.by or self.keys)):
            raise ValueError(f"{self.folder} is dealt to {listed['buckets']} buckets by {listed['by']}")
        return {int(bucket): folder for bucket, folder in listed["parts"].items()}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an earlier one."""
        return self._rows(self.parts(version).values())

    # ---- writing

    def replace(self, rows: DataFrame) -> int:
        """The whole table anew; the number of the version."""
        return self._publish(rows, self.version(), {})

    def merge(
        self,
        source: DataFrame,
        update: Sequence[str],
        defaults: Mapping[str, Column] | None = None,
        touched: tuple[str, Column] | None = None,
    ) -> int:
        """Insert or update by key, as ``operators.upsert`` does; only buckets with rows of ``source`` are read and written.

        ``source`` is stored once, since its buckets are told before it is joined. An empty one changes nothing.
        If another update was faster, this one is an error and changes nothing; run it again.
        """
        before = self.version()
        parts = self.parts(before)
        incoming = settle(self._typed(source), "merged_rows")
        hit = {r[0] for r in incoming.select(self._bucket()).distinct().collect()}
        if not hit:
            discard(incoming)
            return before
        known = self._rows([folder for bucket, folder in parts.items() if bucket in hit])
        merged = upsert(known, incoming, self.keys, update, defaults, touched)
        version = self._publish(merged, before, {b: f for b, f in parts.items() if b not in hit})
        discard(incoming)
        return version

    def drop_versions(self, keep: int = 2) -> None:
        """Forget all but the newest versions and delete what only those held; for when nobody reads or updates."""
        files, path = self._files()
        versions = sorted(self._versions())
        gone, left = versions[: max(0, len(versions) - keep)], versions[-keep:]
        needed = {folder for v in left for folder in self.parts(v).values()}
        unneeded = {folder for v in gone for folder in self.parts(v).values()} - needed
        for v in gone:
            files.delete(path(f"versions/{v}"), False)
        for folder in unneeded:
            files.delete(path(folder), True)

    # ---- parts and versions

    def _files(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        return hadoop(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration()), lambda name: hadoop(f"{self.folder}/{name}")

    def _versions(self) -> list[int]:
        """Versions whose list is written; one being written has no length yet."""
        files, path = self._files()
        found = files.listStatus(path("versions")) if files.exists(path("versions")) else []
        return [int(f.getPath().getName()) for f in found if f.getLen() > 0]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(self.by or self.keys)), F.lit(self.buckets)).cast("int").alias("_bucket")

    def _rows(self, folders) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{f}" for f in sorted(folders)))

    def _typed(self, rows: DataFrame) -> DataFrame:
        """Columns in the table's types, as a key's bucket depends on its type."""
        kinds = {f.name: f.dataType for f in StructType.fromDDL(self.schema)}
        return rows.select(*(F.col(c).cast(kinds[c]).alias(c) for c in kinds if c in rows.columns))

    def _publish(self, rows: DataFrame, before: int, kept: Mapping[int, str]) -> int:
        """Write ``rows`` by bucket, then a version that lists them beside the ``kept`` buckets."""
        files, path = self._files()
        name = f"rows-{uuid4().hex}"
        dealt = self._typed(rows).withColumn("_bucket", self._bucket())
        dealt.hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.folder}/{name}")
        found = (f.getPath().getName() for f in files.listStatus(path(name)))
        written = {int(f.partition("=")[2]): f"{name}/{f}" for f in found if f.startswith("_bucket=")}
        listed = {"buckets": self.buckets, "by": list(self.by or self.keys), "parts": {**kept, **written}}
        try:
            out = files.create(path(f"versions/{before + 1}"), False)  # fails where the file exists
        except Exception as error:
            files.delete(path(name), True)
            raise RuntimeError(f"version {before + 1} of {self.folder} was written by another update meanwhile") from error
        out.write(json.dumps(listed).encode())
        out.close()
        return before + 1

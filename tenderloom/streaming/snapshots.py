"""A keyed table as immutable files and a manifest that is switched in one step.

Rows lie in a fixed number of buckets by the hash of their key. A commit writes new files for the buckets that it changes and nothing
else, then publishes a manifest (which folder holds each bucket, and the last batch of each writer) by a rename that fails if another
commit has the number already. A crash before that rename leaves the table as it was, with files that nothing names; a batch that is
replayed after it is found in the manifest and does nothing. Readers hold one manifest and never see a half-written table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tables import upsert


class CommitConflict(RuntimeError):
    """Another writer has published the version that a commit was to become."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    #: Folder of each bucket that has rows (at most as many as the table has buckets).
    buckets: dict[int, str] = field(default_factory=dict)
    #: Last batch that each writer has committed.
    batches: dict[str, int] = field(default_factory=dict)


class SnapshotTable:
    """A table at ``path`` with ``schema`` (DDL), keyed by ``key``, in ``buckets`` buckets (fixed when the table is made)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.n_buckets = spark, path.rstrip("/"), schema, key, buckets
        self._jvm = spark._jvm
        self._files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        folder = self._at("manifest")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest:
        """A version of the table, the newest without a number."""
        known = self.versions()
        if version is None and not known:
            return Manifest()
        at = known[-1] if version is None else version
        text = "\n".join(r[0] for r in self.spark.read.text(self._at(f"manifest/{at:012d}.json").toString(), wholetext=True).collect())
        read = json.loads(text)
        return Manifest(at, {int(b): p for b, p in read["buckets"].items()}, read["batches"])

    def _publish(self, m: Manifest) -> None:
        """The manifest under its number; the rename does not replace."""
        draft = self._at(f"manifest/.{m.version:012d}-{uuid.uuid4().hex}")
        out = self._files.create(draft, True)
        try:
            out.write(json.dumps({"buckets": m.buckets, "batches": m.batches}).encode())
        finally:
            out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, self._at(f"manifest/{m.version:012d}.json"), how)
        except Exception as e:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {m.version} is there already") from e
            raise

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.n_buckets)).cast("int")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(sorted(set(self.manifest(version).buckets.values())))

    def commit(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], writer: str, batch_id: int) -> Manifest:
        """``merge(rows of the touched buckets, batch)`` in place of those rows; a batch that the writer has committed already changes nothing.

        Only bucket numbers come to the driver. Buckets that a batch does not touch keep their files.
        """
        now = self.manifest()
        if now.batches.get(writer, -1) >= batch_id:
            return now
        touched = sorted(r[0] for r in batch.select(self._bucket().alias("b")).distinct().collect())
        folder = f"data/{now.version + 1:012d}-{uuid.uuid4().hex[:12]}"
        current = self._rows(sorted({now.buckets[b] for b in touched if b in now.buckets}))
        merged = merge(current, batch).withColumn("_bucket", self._bucket())
        merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        written = {int(s.getPath().getName().partition("=")[2]) for s in self._files.listStatus(self._at(folder)) if s.isDirectory() and s.getPath().getName().startswith("_bucket=")}
        kept = {b: p for b, p in now.buckets.items() if b not in touched}
        new = Manifest(now.version + 1, kept | {b: f"{folder}/_bucket={b}" for b in written}, now.batches | {writer: batch_id})
        self._publish(new)
        return new

    def expire(self, keep: int = 2) -> list[str]:
        """Delete manifests but the newest ``keep`` and the data that none of these names; for when no writer is at work. Returns the deleted folders."""
        versions = self.versions()
        live = {p.split("/")[1] for v in versions[-keep:] for p in self.manifest(v).buckets.values()}
        for v in versions[:-keep]:
            self._files.delete(self._at(f"manifest/{v:012d}.json"), False)
        gone = [s.getPath().getName() for s in self._files.listStatus(self._at("data")) if s.getPath().getName() not in live] if self._files.exists(self._at("data")) else []
        for name in gone:
            self._files.delete(self._at(f"data/{name}"), True)
        return sorted(gone)


def upsert_stream(stream: DataFrame, table: SnapshotTable, content: list[str], order: list[str], run_ts: Column, checkpoint: str, writer: str = "stream") -> StreamingQuery:
    """Each micro-batch of the stream upserted into the table, exactly once by its batch number.

    Of the rows of a key the latest by ``order`` wins, also against the row that the table has: a late row changes nothing.
    """

    def merge(current: DataFrame, batch: DataFrame) -> DataFrame:
        known = current.select(*table.key, F.struct(*order).alias("_known"))
        newer = batch.join(known, table.key, "left").where(F.col("_known").isNull() | (F.struct(*order) > F.col("_known"))).drop("_known")
        return upsert(current, newer, table.key, content, order, run_ts).drop("change")

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            table.commit(batch, merge, writer, batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Keyed state of a stream: the latest content of each notice, so that only what is new or changed goes on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


_STATE = ["notice_key", "hash", "at", "tie", "seen"]


class LatestContent(StatefulProcessor):
    """Per bucket of keys a table of (key, hash and time of the content that was last seen, time of the batch that saw it), read
    and written whole, so that a key costs no call of its own. A key is forgotten ``ttl_ms`` after its last row."""

    def __init__(self, columns: list[str], ttl_ms: int):
        self.columns, self.ttl_ms = columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "known binary", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["notice_key", "notice_at", "notice_tie"], kind="stable", ignore_index=True)
        known = pd.DataFrame({"notice_key": pd.Series(dtype=object), "hash": pd.Series(dtype=object), "at": pd.Series(dtype="int64"), "tie": pd.Series(dtype="int64"), "seen": pd.Series(dtype="int64")})
        if self.latest.exists():
            known = pa.ipc.open_stream(self.latest.get()[0]).read_pandas()
            known = known[known["seen"] + self.ttl_ms > now]
        at = known.set_index("notice_key").index.get_indexer(batch["notice_key"])
        old = at >= 0
        was = known.iloc[np.where(old, at, 0)] if len(known) else None
        t, u, h = batch["notice_at"].astype("int64").to_numpy(), batch["notice_tie"].astype("int64").to_numpy(), batch["notice_hash"].to_numpy(object)
        before = np.full(len(batch), None, object)
        late = np.zeros(len(batch), bool)
        if was is not None:
            wt, wu = was["at"].to_numpy("int64"), was["tie"].to_numpy("int64")
            late = old & ((t < wt) | ((t == wt) & (u <= wu)))
            before[old] = was["hash"].to_numpy(object)[old]
        k = batch["notice_key"].to_numpy(object)
        left = np.flatnonzero(~late & ~batch.duplicated(["notice_key", "notice_at", "notice_tie"]).to_numpy())  # neither late nor the same row again
        same = k[left[1:]] == k[left[:-1]]  # as the one before
        before[left[1:][same]] = h[left[:-1][same]]
        passed = left[h[left] != before[left]]
        last = left[np.append(~same, True)] if len(left) else left
        newer = pd.DataFrame({"notice_key": k[last], "hash": h[last], "at": t[last], "tie": u[last], "seen": now})
        met = known["notice_key"].isin(batch["notice_key"])
        kept = known.assign(seen=known["seen"].mask(met, now))[~known["notice_key"].isin(newer["notice_key"])]
        table = pa.Table.from_pandas(pd.concat([kept, newer])[_STATE] if len(kept) else newer[_STATE], preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.latest.update((sink.getvalue().to_pybytes(),))
        if len(passed):
            yield batch.iloc[passed][self.columns]

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, and end when all that has landed is read: a state that expires by the
    clock would else ask for batches without rows for ever."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def changed_notices(stream: DataFrame, key: list[str], content: list[str], time: str, tie: str, ttl_days: int = 45, buckets: int = 1024) -> DataFrame:
    """The rows of a stream whose content differs from their key's last one: first sights and changes, in order of (time, tie).

    A row that is not later than the last one seen of its key is dropped, and so is one that says the same again (its time is
    remembered). Start it inside keyed_state(). The state of a key is one hash and two numbers, for ``ttl_days`` after its last row;
    after that the key counts as new, as portals back-date notices by no more. ``tie`` is a number. Names of columns
    must not begin with an underscore, nor be notice_hash, notice_at, notice_tie, notice_key or notice_bucket. A micro-batch reads and
    writes the state of the buckets that its keys fall into; ``buckets`` is fixed when a checkpoint is made.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in content]
    each = F.to_json(F.array(*[F.col(c).cast("string") for c in key]))
    marked = stream.withColumns({"notice_hash": F.sha2(F.concat_ws("\u0001", *text), 256), "notice_at": F.unix_micros(F.col(time).cast("timestamp")), "notice_tie": F.col(tie).cast("long"), "notice_key": each})
    marked = marked.withColumn("notice_bucket", F.pmod(F.xxhash64("notice_key"), F.lit(buckets)).cast("int"))
    return marked.groupBy("notice_bucket").transformWithStateInPandas(LatestContent(stream.columns, ttl_days * 86_400_000), stream.schema, "Append", "ProcessingTime")

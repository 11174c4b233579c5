"""Tables kept by streams: commits that happen once and whole, keyed state over several files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tenderloom.operators.tables import last_write_wins, upsert
from tenderloom.streaming.changes import changed_notices, keyed_state
from tenderloom.streaming.snapshots import CommitConflict, SnapshotTable, upsert_stream

STATE = "source string, id int, title string, at int, embedding_status string, ingested_at timestamp"
BATCH = "source string, id int, title string, at int"
KEY, CONTENT = ["source", "id"], ["title", "at"]
def stamp():
    return F.lit("2026-01-01").cast("timestamp")


def merge(current, batch):
    return upsert(current, batch, KEY, CONTENT, ["at"], stamp()).drop("change")


def table(spark, path, buckets=4):
    return SnapshotTable(spark, f"file://{path}/t", STATE, KEY, buckets)


def rows(df):
    return sorted(((r.source, r.id, r.title, r.at) for r in df.collect()), key=repr)


def test_commits_versions_and_untouched_buckets(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.versions() == []
    first = t.commit(spark.createDataFrame([("a", i, "x", 1) for i in range(20)], BATCH), merge, "w", 0)
    second = t.commit(spark.createDataFrame([("a", 3, "y", 2)], BATCH), merge, "w", 1)
    changed = {b for b in second.buckets if second.buckets[b] != first.buckets.get(b)}
    assert len(changed) == 1 and len(first.buckets) > 1
    assert rows(t.read()) == sorted([("a", i, "x", 1) for i in range(20) if i != 3] + [("a", 3, "y", 2)], key=repr)
    assert rows(t.read(1)) == sorted((("a", i, "x", 1) for i in range(20)), key=repr)
    assert t.versions() == [1, 2]


def test_a_batch_that_dies_and_comes_again(spark, tmp_path, monkeypatch):
    """Killed before, and after, the one step that publishes: the table is the one before, then the one after, and replay changes nothing."""
    t = table(spark, tmp_path)
    old, new = spark.createDataFrame([("a", i, "x", 1) for i in range(9)], BATCH), spark.createDataFrame([("a", 1, "new", 2), ("b", 1, "new", 2)], BATCH)
    t.commit(old, merge, "w", 0)
    want_old = rows(t.read())

    def dies(self, m):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(SnapshotTable, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            t.commit(new, merge, "w", 1)
    assert rows(t.read()) == want_old and t.versions() == [1]
    publish = SnapshotTable._publish

    def publishes_and_dies(self, m):
        publish(self, m)
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(SnapshotTable, "_publish", publishes_and_dies)
        with pytest.raises(KeyboardInterrupt):
            t.commit(new, merge, "w", 1)
    want_new = rows(t.read())
    assert want_new == sorted([r for r in want_old if r[1] != 1] + [("a", 1, "new", 2), ("b", 1, "new", 2)], key=repr)
    assert t.commit(new, merge, "w", 1).version == 2 and rows(t.read()) == want_new  # the replay
    gone = t.expire(keep=1)
    assert len(gone) >= 1 and rows(t.read()) == want_new and t.versions() == [2]


def test_two_writers_cannot_both_have_a_version(spark, tmp_path, monkeypatch):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    t.commit(spark.createDataFrame([("a", 1, "x", 1)], BATCH), merge, "w", 0)
    stale = other.manifest()
    t.commit(spark.createDataFrame([("a", 1, "y", 2)], BATCH), merge, "w", 1)
    monkeypatch.setattr(other, "manifest", lambda version=None: stale)
    with pytest.raises(CommitConflict):
        other.commit(spark.createDataFrame([("a", 2, "z", 3)], BATCH), merge, "other", 0)
    assert rows(t.read()) == [("a", 1, "y", 2)]
    assert not [p for p in (tmp_path / "t" / "manifest").glob(".0*") if p.suffix != ".crc"]  # no draft is left behind


FILES = [
    [("a", 1, "one", 10), ("a", 2, "two", 10), ("b", 1, "uno", 11), ("a", 1, "one", 10)],
    [("a", 1, "one again", 20), ("a", 2, "late", 5), ("b", 1, "uno", 25), ("c", 1, None, 20), ("a", 3, "x", 20), ("a", 3, "y", 21)],
    [("a", 1, "one", 30), ("a", 1, "one again", 20), ("c", 1, None, 31), ("c", 1, "", 32), ("a", 3, "y", 21)],
]


def _land(spark, folder, name, data):
    spark.createDataFrame(data, BATCH).coalesce(1).write.mode("append").parquet(f"file://{folder}/landed")
    return spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/landed")


def test_three_files_one_after_the_other_upserted(spark, tmp_path):
    """Each start goes on from the checkpoint; late and repeated rows change nothing; the end is what one batch of all rows gives."""
    t = table(spark, tmp_path)
    for n, data in enumerate(FILES):
        stream = _land(spark, tmp_path, n, data)
        upsert_stream(stream, t, CONTENT, ["at"], stamp(), f"file://{tmp_path}/state").awaitTermination()
    every = spark.createDataFrame([r for f in FILES for r in f], BATCH)
    assert rows(t.read()) == rows(last_write_wins(every, KEY, ["at"]))
    assert len(t.versions()) == 3
    upsert_stream(stream, t, CONTENT, ["at"], stamp(), f"file://{tmp_path}/state").awaitTermination()
    assert len(t.versions()) == 3


def test_three_files_one_after_the_other_in_keyed_state(spark, tmp_path):
    """What is let through: first sights and changes; the second and third file meet the state that the first left in the checkpoint."""
    got = []
    for n, data in enumerate(FILES):
        stream = _land(spark, tmp_path, n, data).withColumn("seen", (F.lit(dt.datetime(2026, 1, 1)) + F.make_dt_interval(hours="at")).cast("timestamp"))
        with keyed_state(spark):
            out = changed_notices(stream, KEY, ["title"], "seen", "at")
            run = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
            run.awaitTermination()
        now = rows(spark.read.schema(out.schema).parquet(f"file://{tmp_path}/out"))
        got.append(sorted(set(now) - {r for g in got for r in g}, key=repr))
    assert got[0] == [("a", 1, "one", 10), ("a", 2, "two", 10), ("b", 1, "uno", 11)]
    assert got[1] == [("a", 1, "one again", 20), ("a", 3, "x", 20), ("a", 3, "y", 21), ("c", 1, None, 20)]
    assert got[2] == [("a", 1, "one", 30), ("c", 1, "", 32)]
    assert len(rows(spark.read.parquet(f"file://{tmp_path}/out"))) == 9
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_state_of_many_keys_in_one_bucket_as_the_rule_key_by_key():
    """Random batches, late and repeated rows and expiry, against a loop over rows; a call reads and writes the state once for all its keys."""
    import random

    import pandas as pd

    from tenderloom.streaming.changes import LatestContent

    class State:
        value, calls = None, 0

        def exists(self):
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    class Timer:
        def __init__(self, at):
            self.at = at

        def getCurrentProcessingTimeInMs(self):
            return self.at

    rng, ttl, processor, state = random.Random(7), 100, LatestContent(["n"], 100), State()
    processor.latest = state
    seen, n, now = {}, 0, 0
    for _ in range(60):
        now += rng.randrange(90)
        rows = []
        for _ in range(rng.randrange(1, 80)):
            rows.append((n, f"k{rng.randrange(30)}", rng.choice("ab"), rng.randrange(40), rng.randrange(3)))
            n += 1
        want, here = set(), {k: s for k, s in seen.items() if s[3] + ttl > now}
        for i, k, h, t, u in sorted(rows, key=lambda r: (r[3], r[4])):
            old = here.get(k)
            if old is None or (t, u) > (old[1], old[2]):
                if old is None or h != old[0]:
                    want.add(i)
                here[k] = (h, t, u, now)
            here[k] = (*here[k][:3], now)
        seen = here
        frame = pd.DataFrame(rows, columns=["n", "notice_key", "notice_hash", "notice_at", "notice_tie"])
        out = list(processor.handleInputRows((1,), iter([frame[:9], frame[9:]]), Timer(now)))
        assert {x for f in out for x in f["n"]} == want
    assert state.calls <= 2 * 60

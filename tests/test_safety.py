"""What must not be lost: rows of crashed writers, commits under way, snapshots, rows in other time zones."""

import datetime as dt
import decimal
import os
import threading

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.schema import TableSchema
from tidelog.sources import wal
from tidelog.sources.region import Region
from tidelog.sources.storage import Storage
from tests.test_region import k, region, seen, v


def row(spark, tag, ts, text):
    return spark.createDataFrame([Row(tags=bytes([tag]), timestamp=ts, fields=text.encode())])


def test_a_crashed_writers_rows_survive_others_commits(spark, tmp_path):
    a = region(spark, tmp_path / "t", sync="always")
    a.write(k(1, 1), v("a"))
    b = region(spark, tmp_path / "t")
    b.append(row(spark, 2, 2, "b"))
    assert seen(region(spark, tmp_path / "t")) == [(1, 1, "a"), (2, 2, "b")]


def test_a_second_region_takes_nothing_from_the_first(spark, tmp_path):
    a = region(spark, tmp_path / "t", sync="always")
    a.write(k(1, 1), v("a"))
    b = region(spark, tmp_path / "t", sync="always")
    b.write(k(2, 2), v("b"))
    b.flush()
    a.write(k(1, 1), v("a2"))  # the first lives on, and crashes later
    assert seen(region(spark, tmp_path / "t")) == [(1, 1, "a2"), (2, 2, "b")]
    a.flush()
    assert seen(region(spark, tmp_path / "t")) == [(1, 1, "a2"), (2, 2, "b")]
    assert a.storage.names("_wal") == []


def test_crash_between_commit_and_forgetting_the_log(spark, tmp_path, monkeypatch):
    a = region(spark, tmp_path / "t", sync="always")
    a.write(k(1, 1), v("a"))
    monkeypatch.setattr(a.wal, "drop", lambda names: None)
    a.flush()
    assert len(a.storage.names("_wal")) == 1
    b = region(spark, tmp_path / "t")
    assert len(b) == 1 and seen(b) == [(1, 1, "a")] and b.storage.names("_wal") == []


def test_a_failed_flush_loses_nothing(spark, tmp_path, monkeypatch):
    a = region(spark, tmp_path / "t", sync="always")
    a.write(k(1, 1), v("a"))
    with monkeypatch.context() as m:
        m.setattr(a, "_write", lambda log, path: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError, match="disk"):
            a.flush()
    a.write(k(2, 2), v("b"))
    assert seen(a) == [(1, 1, "a"), (2, 2, "b")]
    a.flush()
    assert seen(region(spark, tmp_path / "t")) == [(1, 1, "a"), (2, 2, "b")]


def test_frames_after_a_torn_one_count(spark, tmp_path):
    r = region(spark, tmp_path / "t", sync="always")
    for i in (1, 2, 3):
        r.write(k(i, i), v("x"))
    middle = sorted((tmp_path / "t" / "_wal").glob("*.frame"))[1]
    middle.write_bytes(middle.read_bytes()[:-5])
    with pytest.warns(UserWarning, match="torn"):
        r = region(spark, tmp_path / "t", sync="always")
    assert seen(r) == [(1, 1, "x"), (3, 3, "x")]
    r.write(k(4, 4), v("x"))
    with pytest.warns(UserWarning, match="torn"):
        assert seen(region(spark, tmp_path / "t")) == [(1, 1, "x"), (3, 3, "x"), (4, 4, "x")]
    assert r.vacuum() == 0 and middle.exists()
    r.vacuum(orphan_age=-1)
    assert not middle.exists()


def test_frames_hold_every_type():
    own = {"a": b"\x00\xff", "b": dt.datetime(2024, 1, 2, 3, 4, 5, 6), "c": decimal.Decimal("1.50"), "d": dt.date(2024, 1, 2), "e": [1, None, "x"], "f": {"k": 2.5}, "g": True, "h": None, "i": float("inf"), "j": dt.timedelta(1, 2, 3)}
    raw = wal.encoded([(1 << 62, 0, own)])
    assert wal.decoded(raw) == [(1 << 62, 0, own)]
    assert wal.decoded(raw[:-1]) is None and wal.decoded(b"") is None
    with open(wal.__file__) as f:
        assert "pickle" not in f.read()


def test_vacuum_spares_commits_under_way(spark, tmp_path, monkeypatch):
    r, other = region(spark, tmp_path / "t"), region(spark, tmp_path / "t")
    r.append(row(spark, 1, 1, "a"))
    measured = r._measured
    monkeypatch.setattr(r, "_measured", lambda path: (other.vacuum(), measured(path))[1])
    r.append(row(spark, 2, 2, "b"))
    assert seen(r) == [(1, 1, "a"), (2, 2, "b")]
    # were the files gone all the same, the commit would not be made
    monkeypatch.setattr(r, "_measured", lambda path: (found := measured(path), other.vacuum(orphan_age=-1))[0])
    with pytest.raises(FileNotFoundError):
        r.append(row(spark, 3, 3, "c"))
    assert seen(r) == [(1, 1, "a"), (2, 2, "b")] and seen(region(spark, tmp_path / "t")) == seen(r)
    assert r.storage.names("_staging") == []


def test_readers_see_whole_batches_while_a_writer_flushes(spark, tmp_path):
    r, done, torn = region(spark, tmp_path / "t", flush_rows=10_000), threading.Event(), []
    r.write_batch([(k(i, 0), v("0")) for i in range(5)])

    def read():
        while not done.is_set():
            found = {x[2] for x in seen(r)}
            if len(found) != 1:
                torn.append(found)

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for n in range(1, 7):
            r.write_batch([(k(i, 0), v(str(n))) for i in range(5)])
            if n % 2 == 0:
                r.flush()
    finally:
        done.set()
        reader.join()
    assert not torn and {x[2] for x in seen(r)} == {"6"}


def test_writes_go_on_during_a_flush(spark, tmp_path, monkeypatch):
    r = region(spark, tmp_path / "t", sync="always")
    r.write(k(1, 1), v("a"))
    plain = r._write

    def slow(log, path):
        r.write(k(1, 1), v("b"))
        r.write(k(2, 2), v("c"))
        assert seen(r) == [(1, 1, "b"), (2, 2, "c")] and len(r) == 3 and len(r.sources()) == 2
        assert r.get(k(1, 1)) == v("b")
        plain(log, path)

    monkeypatch.setattr(r, "_write", slow)
    r.flush()
    assert seen(r) == [(1, 1, "b"), (2, 2, "c")]
    assert seen(region(spark, tmp_path / "t")) == [(1, 1, "b"), (2, 2, "c")]  # what came in between is in the log still


def test_compaction_follows_appends(spark, tmp_path):
    r = region(spark, tmp_path / "t", auto_compact=True, compact_threshold=3)
    for i in range(7):
        r.append(row(spark, 1, i, str(i)))
    assert len(r.current().segments) < 3 and r.live_count() == 7


def test_get_leaves_out_segments_by_tags(spark, tmp_path, monkeypatch):
    r, read = region(spark, tmp_path / "t"), []
    for i in (1, 2, 200):
        r.append(row(spark, i, 5, str(i)))
    plain = r._read
    monkeypatch.setattr(r, "_read", lambda segments: (read.append(len(segments)), plain(segments))[1])
    assert r.get(k(2, 5)) == v("2") and r.get(k(200, 5)) == v("200") and r.get(k(7, 5)) is None
    assert read == [1, 1, 0]


def test_stores_without_rename_are_refused(spark):
    own = Storage(spark, "/tmp")
    own.needs_exclusive()

    class Fs:
        def getUri(self):  # noqa: N802
            return self

        def getScheme(self):  # noqa: N802
            return "s3a"

    own.fs = Fs()
    with pytest.raises(ValueError, match="atomic rename"):
        own.needs_exclusive()


@pytest.fixture(params=["America/New_York", "Asia/Tokyo", "UTC"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


CONDITIONS = [
    "ts >= timestamp'2024-01-20 00:00:00'",
    "ts >= timestamp_ntz'2024-01-20 00:00:00'",
    "ts < timestamp'2024-01-20 00:00:00'",
    "timestamp_ntz'2024-01-20 00:00:00' > ts",
    "ts = timestamp'2024-01-20 00:00:00'",
    "ts between timestamp'2024-01-19 12:00:00' and timestamp_ntz'2024-01-20 12:00:00'",
    "ts >= date'2024-01-20'",
    "ts <= timestamp'2024-01-20 00:00:00+05:30'",
    "ts > '2024-01-20 00:00:00'",
]


@pytest.mark.parametrize("kind", [T.TimestampNTZType(), T.TimestampType()], ids=["ntz", "ltz"])
def test_scans_hold_in_every_time_zone(spark, tmp_path, zone, kind):
    schema = TableSchema.of({"id": T.LongType()}, ("ts", kind), {"x": T.LongType()})
    r = region(spark, tmp_path / "t", schema, window_size=6 * 3_600_000_000)
    name = kind.simpleString()
    rows = spark.range(60).select("id", F.expr(f"cast(timestamp_ntz'2024-01-19 00:00:00' + make_dt_interval(0, cast(id as int), 0, 0) as {name})").alias("ts"), F.col("id").alias("x"))
    r.append(rows)
    for text in CONDITIONS:
        assert sorted(x.id for x in r.scan(text).collect()) == sorted(x.id for x in rows.where(text).collect()), text
    found = r.scan("ts >= timestamp_ntz'2024-01-20 20:00:00'")
    assert found.count() == 16
    if kind == T.TimestampNTZType():
        assert len(found.inputFiles()) < len(r.scan().inputFiles())


def test_long_times_take_only_integers(spark, tmp_path):
    r = region(spark, tmp_path / "t")
    r.append(row(spark, 1, -5, "a"))
    assert seen(r, where="timestamp >= -5 and timestamp <= -5") == [(1, -5, "a")]
    assert seen(r, where="timestamp < 1.5") == [(1, -5, "a")]
    assert os.path.exists(tmp_path / "t") and isinstance(r, Region)

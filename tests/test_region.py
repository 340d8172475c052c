"""What a region promises, by the inputs of FIXTURES.md."""

import random
import threading

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.timerange import TimeRange
from tidelog.schema import TableSchema
from tidelog.sources.manifest import Manifest
from tidelog.sources.region import Region, RegionConfig

TYPED = TableSchema.of({"host": T.StringType(), "cpu": T.StringType()}, ("timestamp", T.LongType()), {"value": T.DoubleType(), "note": T.StringType()})


def k(tag, ts):
    return {"tags": bytes([tag]), "timestamp": ts}


def v(text):
    return {"fields": text.encode()}


def region(spark, path, schema=None, now=lambda: 0, **config):
    return Region(spark, str(path), schema, RegionConfig(**{"window_size": 1000, "auto_compact": False} | config), now)


def seen(r, **how):
    return sorted((bytes(x.tags)[0], x.timestamp, bytes(x.fields).decode()) for x in r.scan(**how).collect())


def test_put_overwrite_delete(spark, tmp_path):
    r = region(spark, tmp_path / "t")
    assert r.write(k(1, 0), v("one")) is None and r.write(k(2, 0), v("two")) is None
    assert r.write(k(1, 0), v("uno")) == v("one")
    assert r.delete(k(2, 0)) == v("two")
    assert len(r) == 4
    assert r.delete(k(3, 0)) is None
    assert r.get(k(1, 0)) == v("uno") and r.get(k(2, 0)) is None
    r.flush()
    assert seen(r) == [(1, 0, "uno")]
    assert r.write(k(1, 0), v("eins")) is None  # the buffer is empty after a flush
    assert r.get(k(1, 0)) == v("eins")
    assert [(bytes(a["tags"])[0], b is None) for a, b in r.rows()] == [(1, False), (2, True), (3, True)]


def test_demo_scan_filter_projection_limit(spark, tmp_path):
    r = region(spark, tmp_path / "t")
    for t, ts, x in ((1, 1000, "value1"), (2, 2000, "value2"), (1, 3000, "value3")):
        r.write(k(t, ts), v(x))
    r.flush()
    r.write_batch([(k(3, 4000), v("value4")), (k(2, 5000), v("value5"))])
    assert len(seen(r)) == 5
    assert [x[1] for x in sorted(seen(r, where="timestamp > 2000"), key=lambda x: x[1])] == [3000, 4000, 5000]
    assert r.scan(columns=["timestamp"]).columns == ["timestamp"]
    assert r.scan(limit=2).count() == 2
    assert r.scan("timestamp > 100 and timestamp < 50").count() == 0
    r.register("demo")
    assert spark.sql("select count(*) from demo where fields = X'76616C756534'").first()[0] == 1


def test_delete_hides_older_segments_and_field_filter_is_above(spark, tmp_path):
    r = region(spark, tmp_path / "t")
    r.write(k(1, 5), v("old"))
    r.flush()
    r.write(k(1, 5), v("new"))
    r.flush()
    assert r.scan("fields = X'6F6C64'").count() == 0
    r.delete(k(1, 5))
    r.flush()
    assert seen(r) == [] and r.live_count() == 0 and len(r) == 3


def test_multi_tag_typed_and_compaction(spark, tmp_path):
    r = region(spark, tmp_path / "t", TYPED, window_size=100, compact_threshold=2)
    rows = [("h1", "c1", 10, 1.5, "a"), ("h1", "c2", 10, 2.5, "b"), ("h1", "c1", 20, 3.5, "c"), ("h2", "c1", 10, 4.5, "d"), ("h2", "c2", 10, 5.5, "e"), ("h2", "c2", 20, 6.5, "f"), ("h1", "c2", 30, 7.5, "g"), ("h2", "c1", 30, 8.5, "h")]
    for i, x in enumerate(rows):
        r.write(r.schema.key_of(*x[:3]), r.schema.value_of(*x[3:]))
        if i % 3 == 2:
            r.flush()
    r.flush()
    before = sorted(map(tuple, r.scan().collect()))
    assert before == sorted(rows)
    assert r.compact() and not r.compact()
    assert sorted(map(tuple, r.scan().collect())) == before
    r.delete({"host": "h1", "cpu": "c1", "timestamp": 20})
    assert r.get({"host": "h1", "cpu": "c1", "timestamp": 20}) is None
    assert r.get({"host": "h2", "cpu": "c1", "timestamp": 10}) == {"value": 4.5, "note": "d"}


def test_compaction_by_window(spark, tmp_path):
    r = region(spark, tmp_path / "t", window_size=10, compact_threshold=4)
    for ts in range(8):
        r.write(k(1, ts), v("x"))
        if ts % 2:
            r.flush()
    assert r.compact()
    assert [(s.min_ts, s.max_ts) for s in r.current().segments] == [(0, 7)]
    for ts in range(20, 28):
        r.write(k(1, ts), v("x"))
        if ts % 2:
            r.flush()
    r.compact_all()
    assert sorted((s.min_ts, s.max_ts) for s in r.current().segments) == [(0, 7), (20, 27)]
    assert len(seen(r)) == 16
    assert r.vacuum() > 0 and len(seen(r)) == 16


def test_retention(spark, tmp_path):
    clock = [100]
    r = region(spark, tmp_path / "t", now=lambda: clock[0], ttl=50, window_size=1000, compact_threshold=2)
    r.write(k(1, 60), v("old"))
    r.flush()
    r.write(k(2, 100), v("fresh"))
    r.delete(k(3, 55))
    clock[0] = 120
    assert r.get(k(1, 60)) is None and seen(r) == [(2, 100, "fresh")]
    r.write(k(4, 1), v("late"))  # expired already, and in the buffer: hidden all the same
    assert seen(r) == [(2, 100, "fresh")]
    r.flush()
    assert r.compact()
    assert [bytes(x.tags)[0] for x in r.log().collect()] == [2]
    clock[0] = 10_000
    r.write(k(5, 9999), v("x"))
    r.flush()
    r.compact()
    assert seen(r) == [(5, 9999, "x")]
    r.set_ttl(1 << 70)
    assert r.ttl_cutoff() == -(1 << 63)


def test_everything_expired_leaves_no_segment(spark, tmp_path):
    clock = [0]
    r = region(spark, tmp_path / "t", now=lambda: clock[0], ttl=10, compact_threshold=2)
    for i in (1, 2):
        r.write(k(i, i), v("x"))
        r.flush()
    clock[0] = 1000
    assert r.compact() and r.current().segments == ()


def test_reopen_seqs_wal_and_lost_manifest(spark, tmp_path):
    r = region(spark, tmp_path / "t", sync="always")
    r.write(k(1, 1), v("a"))
    r.write(k(2, 2), v("b"))
    r.flush()
    assert max(s.max_seq for s in r.current().segments) == 2
    r.write(k(1, 1), v("c"))
    r.close()
    r = region(spark, tmp_path / "t", sync="always")
    assert r.get(k(1, 1)) == v("c") and len(r) == 3
    r.flush()
    assert max(s.max_seq for s in r.current().segments) == 3
    r.storage.delete(Manifest.FOLDER)
    r = region(spark, tmp_path / "t")
    assert seen(r) == [(1, 1, "c"), (2, 2, "b")]
    assert r.current().next_seq == 4


def test_torn_wal_frame_ends_recovery(spark, tmp_path):
    r = region(spark, tmp_path / "t", sync="always")
    for i in (1, 2, 3):
        r.write(k(i, i), v("x"))
    last = sorted((tmp_path / "t" / "_wal").glob("*.frame"))[-1]
    last.write_bytes(last.read_bytes()[:-5])
    crc = last.parent / f".{last.name}.crc"
    crc.unlink(missing_ok=True)
    assert seen(region(spark, tmp_path / "t")) == [(1, 1, "x"), (2, 2, "x")]


def test_append_orders_and_prunes(spark, tmp_path):
    r = region(spark, tmp_path / "t", window_size=1000)
    rows = spark.range(12_000).select(F.unhex(F.lpad(F.hex(F.pmod("id", F.lit(256))), 2, "0")).alias("tags"), F.col("id").alias("timestamp"), F.lit(b"x").alias("fields"))
    r.append(rows, order_by=["timestamp"])
    assert r.scan().count() == 12_000 and r.live_count() == 12_000
    assert sorted(x[0] for x in r.log().select("__seq").collect()) == list(range(1, 12_001))
    assert r.log().where("__seq <> timestamp + 1").count() == 0
    assert len(r.current().pruned(TimeRange(5000, 5100))) == 1
    assert r.scan("timestamp between 5000 and 5100").count() == 101
    assert r.scan("5000 <= timestamp and timestamp <= 5100").count() == 101
    r.append(rows.where("timestamp < 10").select("tags", "timestamp"), op=1)
    assert r.scan().count() == 11_990
    with pytest.raises(Exception, match="must not be null"):
        r.append(spark.createDataFrame([(None, 1)], "tags binary, timestamp long"))
    assert r.scan().count() == 11_990


def test_append_with_seq_and_layers(spark, tmp_path):
    r = region(spark, tmp_path / "t")
    make = lambda *x: spark.createDataFrame([Row(tags=bytes([a]), timestamp=b, fields=c.encode(), s=d) for a, b, c, d in x])
    r.append(make((1, 50, "new", 20)), seq="s")
    r.append(make((1, 50, "old", 10), (2, 10, "x", 1)), seq="s")
    assert seen(r) == [(1, 50, "new"), (2, 10, "x")]
    assert len(r.sources()) == 2
    assert r.segments().count() == 2


def test_snapshot_and_batch_names(spark, tmp_path):
    r = region(spark, tmp_path / "t")
    r.write(k(1, 1), v("a"))
    r.flush()
    pinned = r.current().version
    old = r.scan(version=pinned)
    r.write(k(1, 1), v("b"))
    r.flush()
    assert [bytes(x.fields) for x in old.collect()] == [b"a"]
    df = spark.createDataFrame([Row(tags=b"z", timestamp=1, fields=b"q")])
    r.append(df, batch="s:1")
    r.append(df, batch="s:1")
    assert len(r) == 3


def test_concurrent_writers(spark, tmp_path):
    failed = []

    def work(n):
        try:
            r = region(spark, tmp_path / "t", flush_rows=1000)
            r.write_batch([(k(n, i), v("x")) for i in range(250)])
            r.flush()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    region(spark, tmp_path / "t").write_batch([])
    threads = [threading.Thread(target=work, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    r = region(spark, tmp_path / "t")
    assert r.scan().count() == 1000
    assert r.log().select("__seq").distinct().count() == 1000


def test_against_a_dict(spark, tmp_path):
    R, model = random.Random(7), {}
    r = region(spark, tmp_path / "t", window_size=7, compact_threshold=2, flush_rows=17)
    for _ in range(150):
        key = (R.randrange(4), R.randrange(-20, 20))
        if R.random() < 0.25:
            r.delete(k(*key))
            model.pop(key, None)
        else:
            model[key] = text = str(R.random())
            r.write(k(*key), v(text))
        if R.random() < 0.02:
            r.compact()
    assert seen(r) == sorted((*key, x) for key, x in model.items())
    r.flush()
    r.compact_all()
    assert seen(r) == sorted((*key, x) for key, x in model.items())
    assert sorted(s.window for s in r.current().segments) == sorted({s.window for s in r.current().segments})


def test_ntz_time_and_stream(spark, tmp_path):
    from tidelog.streaming.ingest import ingest

    schema = TableSchema.of({"user_id": T.LongType()}, ("ts", T.TimestampNTZType()), {"value": T.DoubleType(), "ok": T.BooleanType()})
    r = region(spark, tmp_path / "t", schema, window_size=3_600_000_000)
    source = spark.range(20).select(F.col("id").alias("user_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int), 0, 0)").alias("ts"), F.col("id").cast("double").alias("value"))
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    ingest(stream, r, str(tmp_path / "cp")).awaitTermination()
    ingest(stream, r, str(tmp_path / "cp")).awaitTermination()
    assert r.live_count() == 20 and len(r) == 20
    assert r.scan("ts >= timestamp_ntz'2024-01-01 05:00:00' and ts < timestamp_ntz'2024-01-01 07:00:00'").count() == 2
    import datetime as dt

    assert r.get({"user_id": 3, "ts": dt.datetime(2024, 1, 1, 3)}) == {"value": 3.0, "ok": None}

"""Schemas, time ranges, the merge and its plans."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.timerange import TimeRange, extract_time_range, ttl_cutoff, window_id
from tidelog.operators.compaction import pick_window
from tidelog.operators.merge import layers, live, newest_wins, newest_wins_by_max, tombstones, version_stats
from tidelog.schema import ColumnDef, Role, TableSchema
from tidelog.sources.manifest import Generation, Segment


def test_schema_rules():
    s = TableSchema.default()
    assert s.tags == ["tags"] and s.time == "timestamp" and s.fields == ["fields"]
    assert TableSchema.from_json(s.to_json()) == s
    assert [f.nullable for f in s.struct] == [False, False, True]
    assert [f.name for f in s.log_struct][-2:] == ["__seq", "__op_type"]
    long, tag, time = T.LongType(), Role.TAG, Role.TIME
    bad = [
        (ColumnDef("a", long, time),),
        (ColumnDef("a", long, tag),),
        (ColumnDef("a", long, tag), ColumnDef("A", long, time)),
        (ColumnDef("__a", long, tag), ColumnDef("b", long, time)),
        (ColumnDef("a", T.DoubleType(), tag), ColumnDef("b", long, time)),
        (ColumnDef("a", long, tag), ColumnDef("b", T.StringType(), time)),
    ]
    for columns in bad:
        with pytest.raises(ValueError):
            TableSchema(columns)
    assert TableSchema.of({"a": long}, ("t", long)).fields == []
    with pytest.raises(ValueError):
        s.key_of(b"x", None)


@pytest.mark.parametrize(
    "text, lo, hi",
    [
        ("ts > 100", 100, None),
        ("ts < 200", None, 200),
        ("ts = 150", 150, 150),
        ("50 < ts", 50, None),
        ("ts >= -5 and ts <= 10 and tags = 1", -5, 10),
        ("tags = 1", None, None),
        ("ts > 1 or ts < 5", None, None),
        ("ts between 3 and 9", 3, 9),
        ("ts + 1 > 7", None, None),
    ],
)
def test_time_range(spark, text, lo, hi):
    found, open_ = extract_time_range(spark, text, "ts"), TimeRange()
    assert found == TimeRange(open_.lo if lo is None else lo, open_.hi if hi is None else hi)


def test_contradiction_and_cutoff(spark):
    assert extract_time_range(spark, "ts > 100 and ts < 50", "ts").is_empty
    assert ttl_cutoff(-(1 << 63), 5) == -(1 << 63) and ttl_cutoff(10, None) is None and ttl_cutoff(10, 4) == 6


def test_window_id_floors(spark):
    rows = spark.createDataFrame([(x,) for x in (-11, -10, -1, 0, 9, 10, (1 << 62) + 1)], "t long").select("t", window_id("t", 10).alias("w")).collect()
    assert all(r.w == r.t // 10 for r in rows)


def log(spark, *rows):
    return spark.createDataFrame(rows, "k int, t long, v string, __seq long, __op_type byte")


def test_merge(spark):
    one = log(spark, (1, 50, "new", 20, 0), (3, 1, None, 9, 1))
    two = log(spark, (1, 50, "old", 10, 0), (2, 10, "x", 1, 0), (3, 1, "y", 8, 0))
    both = one.unionByName(two)
    for merged in (newest_wins(both, ["k", "t"]), newest_wins_by_max(both, ["k", "t"])):
        assert sorted(map(tuple, merged.collect())) == [(1, 50, "new", 20, 0), (2, 10, "x", 1, 0), (3, 1, None, 9, 1)]
    assert sorted(map(tuple, live(both, ["k", "t"]).collect())) == [(1, 50, "new"), (2, 10, "x")]
    assert list(map(tuple, tombstones(both, ["k", "t"]).collect())) == [(3, 1, 9)]
    assert {r.k: r.versions for r in version_stats(both, ["k", "t"]).collect()} == {1: 2, 2: 1, 3: 2}
    tied = layers(log(spark, (1, 1, "first", 5, 0)), log(spark, (1, 1, "second", 5, 0)))
    assert [r.v for r in live(tied, ["k", "t"], ties=("__source",)).collect()] == ["first"]
    assert live(log(spark).limit(0), ["k", "t"]).count() == 0


def test_plans(spark, tmp_path):
    log(spark, (1, 50, "new", 20, 0)).write.parquet(str(tmp_path / "p"))
    rows = live(spark.read.parquet(str(tmp_path / "p")), ["k", "t"])
    plan = rows.where("t > 5 and k = 1 and v = 'new'").select("k")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    pushed = pushed[: pushed.index("]")]
    assert "GreaterThan(t,5)" in pushed and "EqualTo(k,1)" in pushed and "new" not in pushed
    assert "WindowGroupLimit" in plan
    plan = rows.select("k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "v:string" not in plan[plan.index("ReadSchema") :]


def test_pick_window():
    s = [Segment(i, "", w, 0, 0, 0, 0, 1, 0) for i, w in enumerate([5, 2, 2, 5, 5, 2, 1])]
    assert [x.id for x in pick_window(s, 3)] == [1, 2, 5]
    assert pick_window(s[:2], 3) == [] and pick_window(s, 4) == []
    g = Generation(3, 9, 8, tuple(s), ("a:1",))
    assert Generation.decoded(g.encoded()) == g

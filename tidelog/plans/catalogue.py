"""Queries over the tables of a folder, each with the SQL that says the same.

`events` is read as a change log: tag user_id, time index day(ts), seq event_id; an error deletes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.timerange import extract_time_range, window_id
from tidelog.operators import compaction, merge, retention
from tidelog.schema import DELETE, OP, PUT, SEQ, TableSchema
from tidelog.sources.region import Region, RegionConfig
from tidelog.sources.shared import scratch
from tidelog.streaming.ingest import ingest

KEY = ["user_id", "day"]
DAY_US = 86_400_000_000
CUTOFF_US = 1_705_276_800_000_000  # 2024-01-15
EVENTS = TableSchema.of({"user_id": T.LongType()}, ("day", T.TimestampNTZType()), {"value": T.DoubleType(), "event_type": T.StringType()})

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(ts: str = "ts") -> Column:
    return F.date_trunc("day", F.col(ts)).cast("timestamp_ntz")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log_of(read(spark, sf_dir, "events"))


def event_log_of(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "error", DELETE).otherwise(PUT).cast("byte")
    return events.select("user_id", day().alias("day"), "value", "event_type", "props", F.col("event_id").alias(SEQ), op.alias(OP))


def event_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.live(event_log(spark, sf_dir), KEY)


def ntz(text: str) -> Column:
    return F.expr(f"timestamp_ntz'{text}'")


LOG = "(select user_id, cast(date_trunc('day', ts) as timestamp) as day, value, event_type, props, event_id as seq, case when event_type = 'error' then 1 else 0 end as op from events)"
NEWEST = f"(select * from (select *, row_number() over (partition by user_id, day order by seq desc) as rn from {LOG}) where rn = 1)"
LIVE = f"(select user_id, day, value, event_type, props from {NEWEST} where op = 0)"


# -- the table: scan, merge, filters, lookups -------------------------------------------------------------------------


@query(f"select user_id, day, value, event_type, props from {LIVE}")
def lsm_full_scan(spark, d):
    return event_live(spark, d)


@query(f"select user_id, day from {LIVE}")
def lsm_projection(spark, d):
    return event_live(spark, d).select(*KEY)


@query(f"select user_id, day, value from {LIVE} where day > timestamp '2024-01-15'")
def lsm_time_filter(spark, d):
    return event_live(spark, d).where(F.col("day") > ntz("2024-01-15")).select(*KEY, "value")


@query(f"select user_id, day, value from {LIVE} where timestamp '2024-01-05' <= day and day < timestamp '2024-01-12'")
def lsm_time_reversed_between(spark, d):
    event_live(spark, d).createOrReplaceTempView("live_events")
    return spark.sql("select user_id, day, value from live_events where timestamp_ntz'2024-01-05' <= day and day < timestamp_ntz'2024-01-12'")


@query(f"select user_id, day, value from {LIVE} where day > timestamp '2024-01-20' and day < timestamp '2024-01-10'")
def lsm_contradiction(spark, d):
    text = "day > timestamp_ntz'2024-01-20' and day < timestamp_ntz'2024-01-10'"
    log = event_log(spark, d)
    if extract_time_range(spark, text, "day", "timestamp_ntz").is_empty:
        log = log.limit(0)
    return merge.live(log, KEY).where(text).select(*KEY, "value")


@query(f"select user_id, day, value from {LIVE} where value > 50 and event_type in ('click', 'view') and event_type not like 'p%'")
def lsm_field_filter(spark, d):
    return event_live(spark, d).where((F.col("value") > 50) & F.col("event_type").isin("click", "view") & ~F.col("event_type").like("p%")).select(*KEY, "value")


@query(f"select user_id, day, value, event_type from {LIVE} where user_id = 0 and day = timestamp '2024-01-07'")
def lsm_point_get(spark, d):
    return event_live(spark, d).where((F.col("user_id") == 0) & (F.col("day") == ntz("2024-01-07"))).select(*KEY, "value", "event_type")


@query(f"select user_id, day, seq from {NEWEST} where op = 1")
def lsm_tombstones(spark, d):
    return merge.tombstones(event_log(spark, d), KEY).withColumnRenamed(SEQ, "seq")


@query(f"select user_id, day, seq, cast(op as tinyint) as op, case when op = 0 then value end as value from {NEWEST}")
def lsm_iter_all(spark, d):
    return merge.newest_wins(event_log(spark, d), KEY).select(*KEY, F.col(SEQ).alias("seq"), F.col(OP).alias("op"), F.when(F.col(OP) == PUT, F.col("value")).alias("value"))


@query(f"select user_id, day, cast(count(*) as bigint) as versions, min(seq) as min_seq, max(seq) as max_seq from {LOG} group by user_id, day")
def lsm_versions(spark, d):
    return merge.version_stats(event_log(spark, d), KEY)


@query(f"select user_id, day, value from {LIVE} where day >= timestamp '2024-01-15'")
def lsm_ttl(spark, d):
    return merge.live(retention.unexpired(event_log(spark, d), "day", CUTOFF_US), KEY).select(*KEY, "value")


@query(f"select user_id, day, value, event_type, props from {LIVE}")
def lsm_max_by_merge(spark, d):
    log = merge.newest_wins_by_max(event_log(spark, d), KEY)
    return log.where(F.col(OP) == PUT).drop(SEQ, OP)


@query(
    """select cast(floor(epoch_us(ts) / 86400000000.0) as bigint) as window_id, cast(count(*) as bigint) as n_rows, min(ts) as min_ts, max(ts) as max_ts,
    min(event_id) as min_seq, max(event_id) as max_seq from events group by 1"""
)
def twcs_windows(spark, d):
    own = read(spark, d, "events").withColumn("us", F.timestamp_diff("MICROSECOND", ntz("1970-01-01"), F.col("ts")))
    return own.groupBy(window_id("us", DAY_US).alias("window_id")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.min("event_id").alias("min_seq"), F.max("event_id").alias("max_seq"))


@query(f"select user_id, day, value, event_type, props from {LIVE}")
def compaction_equiv(spark, d):
    return merge.live(compaction.compacted(event_log(spark, d), KEY, "day"), KEY)


@query(
    f"""select user_id, event_type, day, value from (select *, row_number() over (partition by user_id, event_type, day order by seq desc) as rn
    from {LOG}) where rn = 1 and value is not null"""
)
def multi_tag(spark, d):
    log = event_log(spark, d).withColumn(OP, F.lit(PUT).cast("byte"))
    return merge.live(log, ["user_id", "event_type", "day"]).where("value is not null").select("user_id", "event_type", "day", "value")


@query(f"select user_id, day, value, event_type from {LIVE}")
def layers_merge(spark, d):
    log = event_log(spark, d)
    buffer, frozen, files = (log.where(F.pmod(SEQ, F.lit(4)) == 3), log.where(F.pmod(SEQ, F.lit(4)) == 1), log.where(F.pmod(SEQ, F.lit(4)) % 2 == 0))
    return merge.live(merge.layers(buffer, frozen, files), KEY, ties=("__source",)).select(*KEY, "value", "event_type")


def event_region(spark: SparkSession, sf_dir: str, **config) -> Region:
    """All events in a new table, by one commit."""
    own = Region(spark, scratch(spark, "region"), EVENTS, RegionConfig(**{"window_size": DAY_US} | config), now=lambda: CUTOFF_US + 5 * DAY_US)
    own.append(event_log(spark, sf_dir), op=OP, seq=SEQ)
    return own


@query(f"select user_id, day, value, event_type from {LIVE}")
def region_roundtrip(spark, d):
    """Three commits, compaction of every window, a reopened table, a scan."""
    path = scratch(spark, "region")
    make = lambda: Region(spark, path, EVENTS, RegionConfig(window_size=10 * DAY_US, compact_threshold=2), now=lambda: 0)
    own, log = make(), event_log(spark, d)
    for i in range(3):
        own.append(log.where(F.pmod(SEQ, F.lit(3)) == i), op=OP, seq=SEQ)
    own.compact_all()
    own.close()
    return make().scan(columns=[*KEY, "value", "event_type"])


@query(f"select user_id, day, value from {LIVE} where day >= timestamp '2024-01-20' and day <= timestamp '2024-01-25' and user_id <= 40")
def region_pruned_scan(spark, d):
    own = event_region(spark, d)
    return own.scan("day between timestamp_ntz'2024-01-20' and timestamp_ntz'2024-01-25' and user_id <= 40", columns=[*KEY, "value"])


@query(f"select event_type, cast(count(*) as bigint) as n, round(sum(value), 2) as total from {LIVE} where user_id % 2 = 0 group by event_type")
def region_view(spark, d):
    event_region(spark, d).register("event_region")
    return spark.sql("select event_type, count(*) as n, round(sum(value), 2) as total from event_region where user_id % 2 = 0 group by event_type")


@query(f"select user_id, day, value from {LIVE} where day >= timestamp '2024-01-15'")
def region_ttl(spark, d):
    return event_region(spark, d, ttl=5 * DAY_US).scan(columns=[*KEY, "value"])


@query("select user_id, day, seq, op, value from (select user_id, day, seq, cast(op as tinyint) as op, value, row_number() over (partition by user_id, day order by seq desc) as rn from " + LOG + ") where rn = 1")
def region_iter_all(spark, d):
    return event_region(spark, d).iter_all().select(*KEY, F.col(SEQ).alias("seq"), F.col(OP).alias("op"), "value")


@query(f"select cast((select count(*) from events) as bigint) as held, cast((select count(*) from {LIVE}) as bigint) as live, cast((select count(distinct date_trunc('day', ts)) from events) as bigint) as segments")
def region_counts(spark, d):
    own = event_region(spark, d)
    return spark.createDataFrame([(len(own), own.live_count(), own.segments().count())], "held long, live long, segments long")


@query(
    f"""select window_id, cast(count(*) as bigint) as n_rows, cast(sum(op) as bigint) as n_deletes, min(seq) as min_seq, max(seq) as max_seq, min(user_id) as min_user, max(user_id) as max_user
    from (select *, cast(floor(epoch_us(day) / {7 * DAY_US}.0) as bigint) as window_id from {NEWEST}) group by window_id"""
)
def region_compacted_segments(spark, d):
    """What the manifest tells of each window after compaction."""
    own = event_region(spark, d, window_size=7 * DAY_US, auto_compact=False, compact_threshold=2)
    own.append(event_log(spark, d), op=OP, seq=SEQ)
    own.compact_all()
    users = reduce(DataFrame.unionByName, [own._read([s]).agg(F.lit(s.window).alias("window"), F.min("user_id").alias("min_user"), F.max("user_id").alias("max_user")) for s in own.current().segments])
    return own.segments().join(users, "window").select(F.col("window").alias("window_id"), F.col("rows").alias("n_rows"), F.col("deletes").alias("n_deletes"), "min_seq", "max_seq", "min_user", "max_user")


@query(f"select user_id, day, value, event_type from (select *, row_number() over (partition by user_id, day order by seq desc) as rn from {LOG} where seq % 2 = 0) where rn = 1 and op = 0")
def region_pinned_version(spark, d):
    """The table as of its first commit, after a second one and a compaction."""
    log = event_log(spark, d)
    own = Region(spark, scratch(spark, "region"), EVENTS, RegionConfig(window_size=10 * DAY_US, compact_threshold=2), now=lambda: 0)
    pinned = own.append(log.where(F.pmod(SEQ, F.lit(2)) == 0), op=OP, seq=SEQ).version
    own.append(log.where(F.pmod(SEQ, F.lit(2)) == 1), op=OP, seq=SEQ)
    own.compact_all()
    return own.scan(version=pinned, columns=[*KEY, "value", "event_type"])


@query(f"select user_id, day, cast(row_number() over (order by seq) as bigint) as seq, cast(op as tinyint) as op from {LOG}")
def region_given_seqs(spark, d):
    """Sequence numbers that the table gives out, in the order of event_id."""
    own = Region(spark, scratch(spark, "region"), EVENTS, RegionConfig(window_size=10 * DAY_US), now=lambda: 0)
    own.append(event_log(spark, d).withColumnRenamed(SEQ, "event_id"), op=OP, order_by=["event_id"])
    return own.log().select(*KEY, F.col(SEQ).alias("seq"), F.col(OP).alias("op"))


@query(f"select user_id, day, value, event_type from {LIVE}")
def region_stream(spark, d):
    """The events as a stream of files, each micro-batch one commit."""
    own, at = Region(spark, scratch(spark, "region"), EVENTS, RegionConfig(window_size=10 * DAY_US), now=lambda: 0), scratch(spark, "files")
    read(spark, d, "events").repartition(4, "event_id").write.parquet(at)
    stream = event_log_of(spark.readStream.schema(spark.read.parquet(at).schema).option("maxFilesPerTrigger", 2).parquet(at))
    ingest(stream, own, scratch(spark, "ingest"), op=OP, seq=SEQ).awaitTermination()
    return own.scan(columns=[*KEY, "value", "event_type"])


NATIONS = TableSchema.of({"n_name": T.StringType()}, ("n_regionkey", T.LongType()), {"n_nationkey": T.LongType(), "note": T.StringType()})
#: Rows written one by one are the feature here; nation is a table of fixed size.
WRITTEN = """(select n_name, cast(n_regionkey as bigint) as n_regionkey, cast(n_nationkey as bigint) as n_nationkey, case when n_nationkey % 5 = 0 then 'batch' when n_nationkey % 2 = 0 then 'again' else 'once' end as note
    from nation where n_nationkey % 5 = 0 or n_nationkey % 3 <> 0)"""


def nation_region(spark: SparkSession, sf_dir: str) -> Region:
    """Nations by single writes: all put, the even ones put again after a flush, every third deleted, every fifth in a batch; the last two steps are in the log only."""
    rows = [(r.n_name, r.n_regionkey, r.n_nationkey) for r in read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    own = Region(spark, scratch(spark, "region"), NATIONS, RegionConfig(window_size=2, sync="always", auto_compact=False), now=lambda: 0)
    key = lambda name, region: {"n_name": name, "n_regionkey": region}
    for name, region, n in rows:
        own.write(key(name, region), {"n_nationkey": n, "note": "once"})
    own.flush()
    for name, region, n in rows[::2]:
        own.write(key(name, region), {"n_nationkey": n, "note": "again"})
    own.flush_barrier()
    for name, region, n in rows:
        if n % 3 == 0:
            own.delete(key(name, region))
    own.write_batch([(key(name, region), {"n_nationkey": n, "note": "batch"}) for name, region, n in rows if n % 5 == 0])
    return own


@query(f"select * from {WRITTEN}")
def region_single_writes(spark, d):
    """Puts, overwrites, deletes, a batch; segments and buffer together."""
    return nation_region(spark, d).scan()


@query(f"select * from {WRITTEN}")
def region_recovered(spark, d):
    """The same after a crash: what was not flushed comes from the log."""
    return Region(spark, nation_region(spark, d).path).scan()


@query(f"select n.n_name, cast(n.n_regionkey as bigint) as n_regionkey, w.n_nationkey is not null as found, w.n_nationkey, w.note from nation n left join {WRITTEN} w on n.n_name = w.n_name")
def region_get(spark, d):
    """A point lookup of each nation's key."""
    own, out = nation_region(spark, d), []
    for r in read(spark, d, "nation").select("n_name", F.col("n_regionkey").cast("long")).collect():
        value = own.get({"n_name": r[0], "n_regionkey": r[1]})
        out.append((r[0], r[1], value is not None, *((value or {}).get(c) for c in ("n_nationkey", "note"))))
    return spark.createDataFrame(out, "n_name string, n_regionkey long, found boolean, n_nationkey long, note string")


@query(
    """select l_orderkey, l_linenumber, l_shipdate, l_quantity, l_returnflag from (select *, row_number() over
    (partition by l_orderkey, l_linenumber, l_shipdate order by l_partkey desc, l_suppkey desc) as rn from lineitem) where rn = 1 and l_returnflag <> 'R'"""
)
def typed_table(spark, d):
    log = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_returnflag", F.struct("l_partkey", "l_suppkey").alias(SEQ), F.when(F.col("l_returnflag") == "R", DELETE).otherwise(PUT).alias(OP))
    return merge.live(log, ["l_orderkey", "l_linenumber", "l_shipdate"])


# -- SQL over the table -------------------------------------------------------------------------------------------------


@query(f"select user_id, day, value from {LIVE} order by value desc, user_id, day limit 100")
def limit_topk(spark, d):
    return event_live(spark, d).orderBy(F.col("value").desc(), *KEY).limit(100).select(*KEY, "value")


@query(f"select user_id, day, value from {LIVE} order by user_id, day limit 50 offset 25")
def limit_offset(spark, d):
    return event_live(spark, d).orderBy(*KEY).offset(25).limit(50).select(*KEY, "value")


@query(f"select user_id, cast(count(*) as bigint) as n, min(value) as least, max(value) as most, round(avg(value), 6) as mean from {LIVE} group by user_id having count(*) >= 2")
def series_stats(spark, d):
    own = event_live(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))
    return own.where("n >= 2")


@query("select cast(date_trunc('day', ts) as timestamp) as day, event_type, cast(count(*) as bigint) as n, round(sum(value), 2) as total from events group by 1, 2")
def downsample(spark, d):
    return read(spark, d, "events").groupBy(day().alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"select user_id, day, value from (select *, row_number() over (partition by user_id order by day desc) as k from {LIVE}) where k = 1")
def last_value_per_series(spark, d):
    newest = Window.partitionBy("user_id").orderBy(F.col("day").desc())
    return event_live(spark, d).withColumn("k", F.row_number().over(newest)).where("k = 1").select(*KEY, "value")


@query(
    f"""select user_id, day, round(value - lag(value) over w, 6) as delta, round(avg(value) over (w rows between 2 preceding and current row), 6) as mean3,
    cast(rank() over (partition by user_id order by value) as integer) as place from {LIVE} window w as (partition by user_id order by day)"""
)
def series_windows(spark, d):
    w = Window.partitionBy("user_id").orderBy("day")
    return event_live(spark, d).select(
        *KEY,
        F.round(F.col("value") - F.lag("value").over(w), 6).alias("delta"),
        F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("mean3"),
        F.rank().over(Window.partitionBy("user_id").orderBy("value")).alias("place"),
    )


@query(f"select event_type, day, cast(count(*) as bigint) as n, cast(grouping(event_type) * 2 + grouping(day) as bigint) as level from {LIVE} group by rollup (event_type, day)")
def rollup_counts(spark, d):
    return event_live(spark, d).rollup("event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


@query("select o_orderstatus, o_orderpriority, cast(count(*) as bigint) as n, round(sum(o_totalprice), 2) as total from orders group by cube (o_orderstatus, o_orderpriority)")
def cube_orders(spark, d):
    return read(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select o_orderstatus, o_orderpriority, cast(count(*) as bigint) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets_orders(spark, d):
    read(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql("select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")


@query(
    """select n_name, cast(count(*) as bigint) as n_orders, round(sum(o_totalprice), 2) as total from orders
    join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name"""
)
def join_inner(spark, d):
    own = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return own.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select c_custkey, cast(count(o_orderkey) as bigint) as n_orders from customer left join orders on c_custkey = o_custkey group by c_custkey")
def join_left(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def join_semi(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def join_anti(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(f"select l.user_id, l.day, l.value, c.c_custkey, c.c_nationkey from {LIVE} l full join customer c on l.user_id = c.c_custkey")
def join_full_live(spark, d):
    own = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    return event_live(spark, d).select(*KEY, "value").join(own, F.col("user_id") == F.col("c_custkey"), "full")


@query(f"select c_custkey, user_id, day, value from {LIVE} l right join customer on user_id = c_custkey")
def join_right_live(spark, d):
    own = event_live(spark, d).select(*KEY, "value")
    return own.join(read(spark, d, "customer").select("c_custkey"), F.col("user_id") == F.col("c_custkey"), "right")


@query("select r_name, n_name, n_regionkey = r_regionkey as inside from region cross join nation")
def join_cross(spark, d):
    """Two dimension tables of fixed size."""
    own = read(spark, d, "region").crossJoin(read(spark, d, "nation"))
    return own.select("r_name", "n_name", (F.col("n_regionkey") == F.col("r_regionkey")).alias("inside"))


@query("select a.n_name as one, b.n_name as other from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey <> b.n_regionkey")
def join_without_equality(spark, d):
    """No equality among the conditions: a nested loop over a dimension table of fixed size."""
    a, b = read(spark, d, "nation").alias("a"), read(spark, d, "nation").alias("b")
    return a.join(F.broadcast(b), (F.col("a.n_nationkey") < F.col("b.n_nationkey")) & (F.col("a.n_regionkey") != F.col("b.n_regionkey"))).select(F.col("a.n_name").alias("one"), F.col("b.n_name").alias("other"))


@query("select cast(count(*) as bigint) as n from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def join_theta(spark, d):
    a, b = read(spark, d, "nation").alias("a"), read(spark, d, "nation").alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).agg(F.count(F.lit(1)).alias("n"))


@query(
    """with s as (select * from (values (0.0, 10.0, 'low'), (10.0, 50.0, 'mid'), (50.0, 1e9, 'high')) as t(lo, hi, band))
    select band, cast(count(*) as bigint) as n from events join s on value >= lo and value < hi group by band"""
)
def join_range(spark, d):
    bands = spark.createDataFrame([(0.0, 10.0, "low"), (10.0, 50.0, "mid"), (50.0, 1e9, "high")], "lo double, hi double, band string")
    return read(spark, d, "events").join(F.broadcast(bands), (F.col("value") >= F.col("lo")) & (F.col("value") < F.col("hi"))).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("select user_id from events where event_type = 'purchase' and value > 90 except select user_id from events where event_type = 'error' and value > 80")
def set_except(spark, d):
    own = read(spark, d, "events")
    return own.where("event_type = 'purchase' and value > 90").select("user_id").subtract(own.where("event_type = 'error' and value > 80").select("user_id"))


@query("select user_id from events where event_type = 'purchase' intersect select user_id from events where event_type = 'error'")
def set_intersect(spark, d):
    own = read(spark, d, "events")
    return own.where("event_type = 'purchase'").select("user_id").intersect(own.where("event_type = 'error'").select("user_id"))


@query("select n_regionkey as k from nation union all select r_regionkey from region")
def set_union_all(spark, d):
    return read(spark, d, "nation").select(F.col("n_regionkey").alias("k")).unionAll(read(spark, d, "region").select("r_regionkey"))


@query("select n_regionkey as k from nation union select c_nationkey from customer")
def set_union(spark, d):
    return read(spark, d, "nation").select(F.col("n_regionkey").alias("k")).union(read(spark, d, "customer").select("c_nationkey")).distinct()


@query("select user_id from events where event_type = 'purchase' intersect all select user_id from events where event_type = 'error'")
def set_intersect_all(spark, d):
    own = read(spark, d, "events")
    return own.where("event_type = 'purchase'").select("user_id").intersectAll(own.where("event_type = 'error'").select("user_id"))


@query("select user_id from events where event_type = 'view' except all select user_id from events where event_type = 'click'")
def set_except_all(spark, d):
    own = read(spark, d, "events")
    return own.where("event_type = 'view'").select("user_id").exceptAll(own.where("event_type = 'click'").select("user_id"))


@query(
    f"""select user_id, day, cast(count(*) over w as bigint) as n_week, max(value) over w as most_week, cast(ntile(4) over (partition by user_id order by day) as integer) as quarter,
    first_value(value) over (partition by user_id order by day) as first, last_value(value) over (partition by user_id order by day rows between unbounded preceding and unbounded following) as last
    from {LIVE} window w as (partition by user_id order by day range between interval 6 days preceding and current row)"""
)
def range_windows(spark, d):
    """Frames by values: the seven days up to each row's."""
    event_live(spark, d).createOrReplaceTempView("live_events")
    return spark.sql(
        """select user_id, day, count(*) over w as n_week, max(value) over w as most_week, ntile(4) over (partition by user_id order by day) as quarter,
        first_value(value) over (partition by user_id order by day) as first, last_value(value) over (partition by user_id order by day rows between unbounded preceding and unbounded following) as last
        from live_events window w as (partition by user_id order by day range between interval 6 days preceding and current row)"""
    )


@query(
    """select event_id, cast(len(string_split(props, ',')) as bigint) as n_parts, list_contains(string_split(event_type, 'i'), 'v') as has_v, array_to_string(list_reverse(string_split(event_type, 'i')), '+') as turned,
    regexp_replace(event_type, '[aeiou]+', '_', 'g') as bare, regexp_extract(props, '([0-9]+)', 1) as digits, regexp_matches(event_type, '^(click|view)$') as seen,
    map([event_type, 'n'], [user_id, event_id])['n'] as n, cast(list_sum([user_id, event_id, 1]) as bigint) as total from events"""
)
def collection_functions(spark, d):
    """Arrays, maps, regular expressions."""
    parts = F.split("event_type", "i")
    return read(spark, d, "events").select(
        "event_id",
        F.size(F.split("props", ",")).cast("long").alias("n_parts"),
        F.array_contains(parts, "v").alias("has_v"),
        F.array_join(F.reverse(parts), "+").alias("turned"),
        F.regexp_replace("event_type", "[aeiou]+", "_").alias("bare"),
        F.regexp_extract("props", "([0-9]+)", 1).alias("digits"),
        F.col("event_type").rlike("^(click|view)$").alias("seen"),
        F.create_map("event_type", "user_id", F.lit("n"), "event_id")["n"].alias("n"),
        F.aggregate(F.array("user_id", "event_id", F.lit(1).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
    )


@query(
    """select event_id, upper(event_type) as kind, length(event_type) as n, substr(event_type, 1, 3) as head, json_extract_string(props, '$.k') as k,
    extract(year from ts) * 100 + extract(month from ts) as month, round(sqrt(abs(value)), 4) as root, lower(hex(event_type)) as raw, coalesce(nullif(event_type, 'view'), 'none') as other from events"""
)
def scalar_functions(spark, d):
    return read(spark, d, "events").select(
        "event_id",
        F.upper("event_type").alias("kind"),
        F.length("event_type").cast("long").alias("n"),
        F.substring("event_type", 1, 3).alias("head"),
        F.get_json_object("props", "$.k").alias("k"),
        (F.year("ts") * 100 + F.month("ts")).cast("long").alias("month"),
        F.round(F.sqrt(F.abs("value")), 4).alias("root"),
        F.lower(F.hex("event_type")).alias("raw"),
        F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("none")).alias("other"),
    )


@query("select event_type, cast(count(distinct user_id) as bigint) as users, cast(count(distinct cast(date_trunc('day', ts) as timestamp)) as bigint) as days from events group by event_type")
def count_distinct(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(day()).alias("days"))


@query("select distinct o_orderstatus, o_orderpriority from orders")
def distinct_rows(spark, d):
    return read(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("select event_type, cast(count(distinct user_id) as bigint) as users, true as users_near, true as median_near from events group by event_type")
def approx_aggregates(spark, d):
    """Exact counts, and whether the approximate ones are near: users within 15 %, the median among the values of ranks 48 % to 52 %."""
    own = read(spark, d, "events").groupBy("event_type").agg(
        F.countDistinct("user_id").alias("users"), F.approx_count_distinct("user_id").alias("about"), F.percentile_approx("value", 0.5, 1000).alias("median"), F.percentile("value", F.array(F.lit(0.48), F.lit(0.52))).alias("around")
    )
    return own.select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= 0.15 * F.col("users")).alias("users_near"), F.col("median").between(F.col("around")[0], F.col("around")[1]).alias("median_near"))


@query(
    """with big as (select o_custkey, sum(o_totalprice) as total from orders group by o_custkey)
    select c_custkey, round(total, 2) as total from customer join big on c_custkey = o_custkey
    where total > (select avg(total) from big) and c_nationkey in (select n_nationkey from nation where n_regionkey = 1)"""
)
def cte_subqueries(spark, d):
    for name in ("orders", "customer", "nation"):
        read(spark, d, name).createOrReplaceTempView(name)
    return spark.sql(
        """with big as (select o_custkey, sum(o_totalprice) as total from orders group by o_custkey)
        select c_custkey, round(total, 2) as total from customer join big on c_custkey = o_custkey
        where total > (select avg(total) from big) and c_nationkey in (select n_nationkey from nation where n_regionkey = 1)"""
    )


@query(
    """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue,
    cast(count(*) as bigint) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus"""
)
def pricing_summary(spark, d):
    own = read(spark, d, "lineitem").where(F.col("l_shipdate") <= ntz("1998-09-02"))
    return own.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))

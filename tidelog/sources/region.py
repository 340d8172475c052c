"""A table in a folder: appended versions, the newest of each key visible.

Writes of single rows wait in a small buffer (with a write-ahead log); DataFrames go to Parquet at once. A commit is a new manifest
generation, so a batch is seen as a whole or not at all, and a reader keeps the generation it began with. Segments are laid out by time
time window and sorted by key, so conditions on time and tags prune segments, then row groups. A lost executor costs nothing but
its tasks: files that no generation lists are not part of the table.

Several regions, in one process or many, may write to one folder. Each logs its buffer's operations in frames of its own; a region that opens takes
over whatever frames no generation names as flushed. Should their writer live on and flush them as well, they are in segments twice with the same
seqs, which changes nothing that is seen. A region's methods may be called from several threads: a reader sees the generation and the buffer as of one
moment, while a flush writes.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions import timerange
from tidelog.functions.timerange import TimeRange, as_long, extract_time_range, window_id, within
from tidelog.operators import compaction, merge
from tidelog.schema import DELETE, OP, PUT, SEQ, TableSchema
from tidelog.sources.buffer import Buffer, Version
from tidelog.sources.manifest import Generation, Manifest, Segment, schema_of
from tidelog.sources.storage import Storage
from tidelog.sources.wal import Wal, torn

ORPHAN_AGE = 86_400.0  # seconds after which files that no generation lists count as left behind


@dataclass
class RegionConfig:
    flush_rows: int = 1000
    flush_bytes: int = 10 << 20
    compact_threshold: int = 4
    window_size: int = 3_600_000_000_000
    ttl: int | None = None
    sync: str | int = 100
    auto_compact: bool = True
    bloom: bool = False

    def __post_init__(self):
        self.window_size = max(1, self.window_size)


class Region:
    """One table. now: the present time in the unit of the time index, for retention."""

    def __init__(self, spark: SparkSession, path: str, schema: TableSchema | None = None, config: RegionConfig | None = None, now=time.time_ns):
        self.spark, self.path, self.config, self.now = spark, path.rstrip("/"), config or RegionConfig(), now
        self.storage = Storage(spark, self.path)
        self.manifest = Manifest(self.storage)
        found = self.manifest.load()
        kept = schema_of(found) if found else None
        if kept and schema and kept.names != schema.names:
            raise ValueError(f"the table has {kept.names}")
        self.schema = schema or kept or TableSchema.default()
        if found is None:
            self._rebuild()
        self._lock, self._flushing = threading.RLock(), threading.Lock()
        self.buffer, self.frozen = Buffer(self.schema.key), Buffer(self.schema.key)  # frozen: what a flush is writing
        self.block = (0, 0)  # seqs that are reserved for single writes: the next one, and the first beyond
        self.wal = Wal(self.storage, self.config.sync)
        self._recover()

    def _recover(self) -> None:
        """Takes over the frames of the log that no generation names as flushed, and deletes the others."""
        frames = list(self.wal.frames())  # before the generation is read: what is flushed in between is named there
        flushed, last = set(self.current().flushed), 0
        self.wal.drop(name for name, _ in frames if name in flushed)
        for name, operations in frames:
            if operations is None:
                torn(name)
            elif name not in flushed:
                self.wal.written.append(name)
                for x in sorted(operations, key=lambda x: x[0]):
                    self.buffer.add(x)
                    last = max(last, x[0])
        if last and self.current().next_seq <= last:
            self.manifest.commit(lambda g: replace(g, next_seq=max(g.next_seq, last + 1)))

    # -- state ------------------------------------------------------------------------------------------------------

    def current(self) -> Generation:
        return self.manifest.load() or Generation()

    @property
    def time_kind(self) -> str:
        return self.schema.struct[self.schema.time].dataType.typeName()

    @property
    def next_segment_id(self) -> int:
        return self.current().next_id

    @property
    def estimated_memory(self) -> int:
        return self.buffer.bytes + self.frozen.bytes

    def set_flush_threshold(self, rows: int) -> None:
        self.config.flush_rows = rows

    def set_ttl(self, ttl: int | None) -> None:
        self.config.ttl = ttl

    def set_window_size(self, width: int) -> None:
        self.config.window_size = max(1, width)

    def set_compact_threshold(self, n: int) -> None:
        self.config.compact_threshold = n

    def ttl_cutoff(self) -> int | None:
        return timerange.ttl_cutoff(self.now(), self.config.ttl)

    def segments(self) -> DataFrame:
        """The manifest's entries as a table."""
        return self.spark.createDataFrame([Row(**s.__dict__) for s in self.current().segments], "id long, path string, window long, min_ts long, max_ts long, min_seq long, max_seq long, rows long, deletes long, min_key string, max_key string")

    # -- writes -----------------------------------------------------------------------------------------------------

    def write(self, key: dict, value: dict | None = None) -> dict | None:
        """Puts one row; returns the value that the buffer held for the key, None if none."""
        return self._one(key, self.schema.value_of(**(value or {})), PUT)

    def delete(self, key: dict) -> dict | None:
        """Deletes a key, whether or not it is there; returns as write()."""
        return self._one(key, self.schema.value_of(), DELETE)

    def _one(self, key: dict, value: dict, op: int) -> dict | None:
        own = self.schema.key_of(**key)
        with self._lock:
            old = self.buffer.get(own)
            full = self._take([(op, own | value)])
        if full:
            self.flush()
        return None if old is None or old[1] == DELETE else {f: old[2][f] for f in self.schema.fields}

    def write_batch(self, entries: list[tuple[dict, dict | None]]) -> None:
        """(key, value or None for a delete) in order, in one frame; of one key the later entry wins."""
        if self._take([(DELETE if v is None else PUT, self.schema.key_of(**k) | self.schema.value_of(**(v or {}))) for k, v in entries]):
            self.flush()

    def _take(self, rows: list[tuple[int, dict]]) -> bool:
        """Logs and buffers rows, all at once to readers; whether the buffer is full."""
        with self._lock:
            if rows:
                base = self._seqs(len(rows))
                taken = [(base + i, op, row) for i, (op, row) in enumerate(rows)]
                self.wal.append(taken)
                for x in taken:
                    self.buffer.add(x)
            return len(self.buffer) >= self.config.flush_rows or self.buffer.bytes > self.config.flush_bytes

    def _seqs(self, n: int) -> int:
        """The first of n seqs for single writes, out of a block that is reserved by one commit; what is left of it goes back on the next flush."""
        at, end = self.block
        if end - at < n:
            at = self._reserve(size := max(n, self.config.flush_rows))
            end = at + size
        self.block = (at + n, end)
        return at

    def _given_back(self, g: Generation) -> Generation:
        """g with the unused rest of the block free again, if no other writer has gone beyond it."""
        at, end = self.block
        return replace(g, next_seq=at) if at < end and g.next_seq == end else g

    def _reserve(self, n: int) -> int:
        """The first of n seqs that no other writer gets."""
        return self.manifest.commit(lambda g: replace(g, next_seq=g.next_seq + n, schema=g.schema or tuple(self.schema.to_json()))).next_seq - n

    def append(self, rows: DataFrame, *, op: int | str = PUT, seq: str | None = None, order_by: list[str] | None = None, batch: str | None = None) -> Generation:
        """Commits a DataFrame of the schema's columns. Fields that are missing are null.

        op: PUT or DELETE for all rows, or the name of a column of either. seq: the column that orders versions; else seqs are
        given in the order of order_by, or in that of the input. batch: "name:number" of a stream's batch; one that
        is the last of its name already is not taken in again.
        """
        if batch is not None and batch in self.current().batches:
            return self.current()
        self.flush()
        named = {c.name: F.col(c.name).cast(c.kind) if c.name in rows.columns else F.lit(None).cast(c.kind) for c in self.schema.columns}
        log = rows.select(*[x.alias(n) for n, x in named.items()], (F.col(op) if isinstance(op, str) else F.lit(op)).cast("byte").alias(OP), *([F.col(seq).cast("long").alias(SEQ)] if seq else []), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order_by or [])])
        missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in self.schema.key])
        log = log.withColumn(self.schema.tags[0], F.when(missing, F.raise_error(F.lit("tags and time index must not be null")).cast(log.schema[self.schema.tags[0]].dataType)).otherwise(F.col(self.schema.tags[0])))
        own = f"{self.path}/data/{uuid.uuid4().hex}"
        staged = f"_staging/{uuid.uuid4().hex}"
        if seq is None:
            log = self._numbered(log, [f"__o{i}" for i in range(len(order_by or []))], self.storage.path(staged))
        out = self._commit_log(log.select(*self.schema.names, SEQ, OP), own, batch=batch)
        if seq is None:
            self.storage.delete(staged)
        return self._settled(out)

    def _settled(self, g: Generation) -> Generation:
        """The generation after the compaction that a commit calls for, if any."""
        if self.config.auto_compact and compaction.pick_window(list(g.segments), self.config.compact_threshold):
            self.compact()
            return self.current()
        return g

    def _numbered(self, log: DataFrame, order: list[str], staged: str) -> DataFrame:
        """log with contiguous seqs: rows are numbered within their partition, partitions are put one after the other by their counts."""
        dealt = log.repartitionByRange(*order) if order else log
        place = F.monotonically_increasing_id().alias("__m")
        numbered = (dealt.sortWithinPartitions(*order) if order else dealt).select("*", F.spark_partition_id().alias("__p"), place)
        numbered.write.parquet(staged)
        kept = self.spark.read.parquet(staged)
        counts = kept.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).orderBy("__p").collect()  # one row for each partition
        base, offsets = self._reserve(sum(r[1] for r in counts)), []
        for r in counts:
            offsets.append((r[0], base))
            base += r[1]
        if not offsets:
            return kept.withColumn(SEQ, F.lit(0).cast("long"))
        first = self.spark.createDataFrame(offsets, "__p int, __base long")
        # within a partition the ids of rows are consecutive
        return kept.join(F.broadcast(first), "__p").withColumn(SEQ, F.col("__base") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))

    def _commit_log(self, log: DataFrame, path: str, batch: str | None = None, replaces: tuple[int, ...] = (), frames: list[str] | None = None) -> Generation:
        """Writes log rows as segments, one for each window, and lists them. frames: those of the log whose operations they are."""
        self._write(log, path)
        new = self._measured(path)
        left = set(self.storage.names(Wal.FOLDER)) if frames is not None else set()

        def change(g: Generation) -> Generation:
            if replaces and not set(replaces) <= {s.id for s in g.segments}:
                return g  # another compaction was first
            if batch is not None and batch in g.batches:
                return g
            there = set(self.storage.names(path.removeprefix(f"{self.path}/")))
            if gone := [s.path for s in new if s.path.rpartition("/")[2] not in there]:
                raise FileNotFoundError(f"files of this commit were deleted before it was made: {gone[:3]}")
            segments = [replace(s, id=g.next_id + i) for i, s in enumerate(new)]
            g = self._given_back(g)
            return replace(
                g,
                segments=(*(s for s in g.segments if s.id not in replaces), *segments),
                next_id=g.next_id + len(new),
                next_seq=max([g.next_seq, *(s.max_seq + 1 for s in new)]),
                batches=g.batches if batch is None else (*(b for b in g.batches if b.rpartition(":")[0] != batch.rpartition(":")[0]), batch),
                schema=g.schema or tuple(self.schema.to_json()),
                flushed=g.flushed if frames is None else (*(f for f in g.flushed if f.rpartition("/")[2] in left), *frames),
            )

        with self._lock:
            out = self.manifest.commit(change)
            self.block = (0, 0)
            if frames is not None:
                self.frozen = Buffer(self.schema.key)
        return out

    def _write(self, log: DataFrame, path: str) -> None:
        key = self.schema.key
        laid = log.withColumn("__t", as_long(self.schema.time, self.time_kind)).withColumn("__window", window_id("__t", self.config.window_size)).drop("__t")
        writer = laid.repartitionByRange("__window", *key).sortWithinPartitions("__window", *key, F.col(SEQ).desc()).write.partitionBy("__window").option("parquet.block.row.count.limit", 1 << 20)
        if self.config.bloom:
            for c in self.schema.tags:
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(path)

    def _measured(self, path: str) -> list[Segment]:
        """What lies under a commit's path: one row for each window reaches the driver."""
        names = [n for n in self.storage.names(path.removeprefix(f"{self.path}/")) if n.startswith("__window=")]
        if not names:
            return []
        t, tag = as_long(self.schema.time, self.time_kind), self._key_text([F.col(c) for c in self.schema.tags])
        log = self.spark.read.schema(T.StructType([*self.schema.log_struct.fields, T.StructField("__window", T.LongType())])).parquet(path)
        stats = log.groupBy("__window").agg(F.min(t), F.max(t), F.min(SEQ), F.max(SEQ), F.count(F.lit(1)), F.sum(F.col(OP).cast("long")), F.min(tag), F.max(tag)).orderBy("__window").collect()
        return [Segment(0, f"{path}/__window={r[0]}", r[0], *[int(x) for x in r[1:7]], r[7] or "", r[8] or "") for r in stats]

    def _key_text(self, tags: list[Column]) -> Column:
        """A key's tags as the text by which segments know their least and largest."""
        kinds = {c.name: c.kind for c in self.schema.columns}
        return F.concat_ws("|", *[F.hex(x) if isinstance(kinds[n], T.BinaryType) else x.cast("string") for n, x in zip(self.schema.tags, tags, strict=True)])

    # -- maintenance ------------------------------------------------------------------------------------------------

    def flush(self) -> Generation | None:
        """Commits the buffer; of each key only its newest version there. Writes go on meanwhile, into a new buffer."""
        with self._flushing:
            with self._lock:
                if not len(self.buffer):
                    return None
                self.frozen, self.buffer = self.buffer, Buffer(self.schema.key)
                logged = self.wal.rotate()
            try:
                out = self._commit_log(self._frame(list(self.frozen.newest.values())), f"{self.path}/data/{uuid.uuid4().hex}", frames=logged[0])
            except BaseException:
                with self._lock:
                    self.buffer, self.frozen = Buffer(self.schema.key, self.frozen.rows + self.buffer.rows), Buffer(self.schema.key)
                    self.wal.restore(logged)
                raise
            self.wal.drop(logged[0])
        if self.config.auto_compact and len(out.segments) >= self.config.compact_threshold:
            self.compact()
        return out

    flush_barrier = flush

    def _frame(self, rows: list[Version]) -> DataFrame:
        return self.spark.createDataFrame([(*(r[c] for c in self.schema.names), s, op) for s, op, r in rows], self.schema.log_struct)

    def compact(self) -> bool:
        """Merges the earliest window that has enough segments; whether there was one."""
        g = self.current()
        chosen = compaction.pick_window(list(g.segments), self.config.compact_threshold)
        if not chosen:
            return False
        log = compaction.compacted(self._read(chosen), self.schema.key, self.schema.time, self.ttl_cutoff())
        self._commit_log(log, f"{self.path}/data/{uuid.uuid4().hex}", replaces=tuple(s.id for s in chosen))
        return True

    def compact_all(self) -> int:
        """Compacts until no window has enough segments; the number of merges."""
        n = 0
        while self.compact():
            n += 1
        return n

    def vacuum(self, keep: int = 1, orphan_age: float = ORPHAN_AGE) -> int:
        """Deletes what only older generations than the last `keep` list; the number of folders deleted.

        What no generation lists may belong to a commit that is under way: it is deleted only when it is older than orphan_age seconds. So is staged data,
        and so are torn frames.
        """
        versions = self.manifest.versions()
        listed = {v: {s.path for s in self.manifest.load(v).segments} for v in versions}
        wanted = {x for v in versions[-keep:] for x in listed[v]}
        once = {x for own in listed.values() for x in own} - wanted
        n = 0
        for name in self.storage.names("data"):
            folder = f"data/{name}"
            windows = [w for w in self.storage.names(folder) if w.startswith("__window=")]
            paths = {w: f"{self.path}/{folder}/{w}" for w in windows}
            old = not any(x in wanted or x in once for x in paths.values()) and self.storage.age(folder) > orphan_age
            gone = [w for w in windows if paths[w] in once or old or paths[w] not in wanted and self.storage.age(f"{folder}/{w}") > orphan_age]
            for w in gone:
                self.storage.delete(f"{folder}/{w}")
            n += len(gone)
            if len(gone) == len(windows) and (gone or old):
                self.storage.delete(folder)
        for v in versions[:-keep]:
            self.storage.delete(f"{Manifest.FOLDER}/v{v:020d}.json")
        for name in self.storage.names("_staging"):
            if self.storage.age(f"_staging/{name}") > orphan_age:
                self.storage.delete(f"_staging/{name}")
        for name, operations in self.wal.frames():
            if operations is None and self.storage.age(name) > orphan_age:
                self.storage.delete(name)
        return n

    def _rebuild(self) -> None:
        """A manifest from the data folder, where there is data but no manifest."""
        new = [s for name in self.storage.names("data") if self.storage.exists(f"data/{name}/_SUCCESS") for s in self._measured(f"{self.path}/data/{name}")]
        if new:
            self.manifest.commit(lambda g: replace(g, segments=tuple(replace(s, id=i + 1) for i, s in enumerate(new)), next_id=len(new) + 1, next_seq=max(s.max_seq for s in new) + 1, schema=tuple(self.schema.to_json())))

    def close(self) -> None:
        """Makes the buffer durable by its log; nothing is flushed to segments unless the log is off."""
        if self.config.sync == "never":
            self.flush()
        with self._lock:
            self.wal.close()
            if self.block[0] < self.block[1]:
                self.manifest.commit(self._given_back)
                self.block = (0, 0)

    # -- reads ------------------------------------------------------------------------------------------------------

    def _read(self, segments: list[Segment]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.schema.log_struct)
        return self.spark.read.schema(self.schema.log_struct).parquet(*[s.path for s in segments])

    def _snapshot(self) -> tuple[Generation, list[Version]]:
        """The latest generation and all that waits, as of one moment."""
        with self._lock:
            return self.current(), [*self.buffer.rows, *self.frozen.rows]

    def log(self, span: TimeRange | None = None, *, version: int | None = None, ttl: bool = False) -> DataFrame:
        """All versions in a generation (the latest, with the buffer, by default) whose time is in the range."""
        span = span or TimeRange()
        if ttl and (cutoff := self.ttl_cutoff()) is not None:
            span = span & TimeRange(lo=cutoff)
        g, held = self._snapshot() if version is None else (self.manifest.load(version), [])
        rows = self._read(g.pruned(span))
        if held and not span.is_empty:
            rows = rows.unionByName(self._frame(held))
        condition = within(self.schema.time, self.time_kind, span)
        return rows.where(F.lit(False)) if span.is_empty else rows if condition is None else rows.where(condition)

    def scan(self, where: str | None = None, *, columns: list[str] | None = None, limit: int | None = None, version: int | None = None) -> DataFrame:
        """The visible rows. Time bounds in `where` prune segments; all of `where` is applied to the merged rows as well."""
        span = extract_time_range(self.spark, where, self.schema.time, self.time_kind) if where else TimeRange()
        rows = merge.live(self.log(span, version=version, ttl=True), self.schema.key)
        if where:
            rows = rows.where(where)
        if columns is not None:
            rows = rows.select(*columns)
        return rows if limit is None else rows.limit(limit)

    def get(self, key: dict) -> dict | None:
        """The visible value of a key. Reads the segments whose times and tags reach over it."""
        own = self.schema.key_of(**key)
        with self._lock:
            g, held = self.current(), [x for x in (self.buffer.get(own), self.frozen.get(own)) if x is not None]
        kinds = {c.name: c.kind for c in self.schema.columns}
        wanted = {c: F.lit(own[c]).cast(kinds[c]) for c in self.schema.key}
        t, tag = self.spark.range(1).select(as_long(wanted[self.schema.time], self.time_kind), self._key_text([wanted[c] for c in self.schema.tags])).first()
        cutoff = self.ttl_cutoff()
        if cutoff is not None and t < cutoff:
            return None
        rows = self._read([s for s in g.pruned(TimeRange(t, t)) if s.holds(tag)])
        for c, x in wanted.items():
            rows = rows.where(F.col(c) == x)
        found = [(r[SEQ], r[OP], r.asDict()) for r in rows.orderBy(F.col(SEQ).desc()).limit(1).collect()]
        best = max([*found, *held], key=lambda x: x[0], default=None)
        return None if best is None or best[1] == DELETE else {f: bytes(v) if isinstance(v := best[2][f], bytearray) else v for f in self.schema.fields}

    def iter_all(self) -> DataFrame:
        """The newest version of every key in key order, deletes and expired rows included."""
        return merge.newest_wins(self.log(), self.schema.key).orderBy(*self.schema.key)

    def rows(self) -> Iterator[tuple[dict, dict | None]]:
        """iter_all() as (key, value or None for a delete), streamed."""
        for r in self.iter_all().toLocalIterator():
            yield {k: r[k] for k in self.schema.key}, None if r[OP] == DELETE else {f: r[f] for f in self.schema.fields}

    def __len__(self) -> int:
        """Versions held, overwritten ones and deletes included."""
        g, held = self._snapshot()
        return sum(s.rows for s in g.segments) + len(held)

    def live_count(self) -> int:
        return self.scan().count()

    def sources(self, span: TimeRange | None = None) -> list[DataFrame]:
        """The layers of a snapshot, newest first: the buffer, then the segments that the range leaves."""
        with self._lock:
            g, held = self.current(), [self._frame(x.rows) for x in (self.buffer, self.frozen) if len(x)]
        return held + [self._read([s]) for s in sorted(g.pruned(span or TimeRange()), key=lambda s: -s.id)]

    def register(self, name: str, version: int | None = None) -> DataFrame:
        """A temporary view of the visible rows; the retention cutoff is that of now."""
        found = self.scan(version=version)
        found.createOrReplaceTempView(name)
        return found



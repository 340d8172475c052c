"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

Documents come in batches from the highest keys to the lowest. A batch's run holds, for each line hash, in how many
of its documents the line is found and the largest key among them. A line that the runs already count in enough
documents is settled: its keeper has been seen. Each new batch anti-joins the settled lines away by a merge join and adds what
is left as a sorted run of level 0; `fanout` runs of one level are compacted to one of the next.

Runs are tables in buckets of the hash, one sorted file a bucket, all with the same buckets. So runs are merged and anti-joined bucket by
bucket: only a batch's own lines are ever exchanged, once, after they have been counted on the map side.
The tables' names are in the session's catalog until the runs are closed, their files in scratch space.

Defined results: a null or empty text is one empty line; texts and lines of any length are taken whole. Rows are documents; rows of one key count one by one, and
all rows of the keeper's key keep the line. A null key is below all others. Repeated rows and ties need no care from the caller; an empty table
gives no rows. Other columns stay as they are, whatever their names; columns called _n_lines and _n_dropped are replaced. Keys are numbers. Hashes are 128 bits wide.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import few_parts, filled, fresh, own, scratch, stored

SPACES = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(bare: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hashes(lines: Column, min_chars: int) -> Column:
    """For each line the hashes (_h1, _h2) of its key, which is the line without white space at its ends and in lower case; null where it is short."""
    keys = F.transform(F.transform(lines, lambda x: F.btrim(x, F.lit(SPACES))), lowered)
    return F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("_h1"), F.xxhash64(F.concat(F.lit("line:"), k)).alias("_h2"))))


def _two(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs as one, by a full merge join."""
    other = b.select("_h1", "_h2", F.col("_docs").alias("_docs2"), F.col("_keeper").alias("_keeper2")).hint("merge")
    docs = F.coalesce("_docs", F.lit(0)) + F.coalesce("_docs2", F.lit(0))
    return a.join(other, ["_h1", "_h2"], "full").select("_h1", "_h2", docs.alias("_docs"), F.greatest("_keeper", "_keeper2").alias("_keeper"))


class LineRuns:
    """The levelled runs: rows (_h1, _h2, _docs, _keeper), no line twice in a run. buckets: as many as shuffles have partitions, if not given."""

    def __init__(self, min_docs: int = 5, fanout: int = 4, buckets: int | None = None):
        if fanout < 2 or min_docs < 1:
            raise ValueError("fanout must be 2 or more, min_docs 1 or more")
        self.min_docs, self.fanout, self.buckets = min_docs, fanout, buckets
        self.levels: list[list[DataFrame]] = [[]]
        self.tables: list[str] = []

    def merged(self) -> DataFrame | None:
        """All runs as one; two at a time, so that every join is of two tables in the same buckets."""
        runs = [run for level in self.levels for run in level]
        return self._merged(runs) if runs else None

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        first = runs[0]
        for i, run in enumerate(runs[1:], 2):
            first = _two(first, run)
            if i < len(runs):
                first = self._run(first)
        return first

    def settled(self) -> DataFrame | None:
        """Lines found in enough documents, with their keeper."""
        held = self.merged()
        return held if held is None else held.where(F.col("_docs") >= self.min_docs)

    def add(self, lines: DataFrame, last: bool = False) -> None:
        """lines: (_h1, _h2, _doc), a row for each document and distinct line of the batch; keys below those of earlier batches. After the last batch nothing is compacted, as merged() goes over all runs anyway."""
        self.levels[0].append(self._run(self.unsettled(lines.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_docs"), F.max("_doc").alias("_keeper")))))
        if not last:
            self._compact()

    def unsettled(self, counted: DataFrame) -> DataFrame:
        """The lines of a batch, (_h1, _h2, _docs, _keeper), that the runs together don't count in enough documents yet."""
        runs = [run for level in self.levels for run in level]
        for i, run in enumerate(runs):
            counted = counted.join(run.select("_h1", "_h2", F.col("_docs").alias(f"_docs{i}")).hint("merge"), ["_h1", "_h2"], "left")
        known = sum((F.coalesce(F.col(f"_docs{i}"), F.lit(0)) for i in range(len(runs))), F.lit(0))
        return counted.where(known < self.min_docs).select("_h1", "_h2", "_docs", "_keeper")

    def _run(self, rows: DataFrame) -> DataFrame:
        spark, name = rows.sparkSession, f"tidelog_run_{uuid.uuid4().hex}"
        self.buckets = self.buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows.write.format("parquet").bucketBy(self.buckets, "_h1", "_h2").sortBy("_h1", "_h2").option("path", scratch(spark, "run")).saveAsTable(name)
        self.tables.append(name)
        return spark.table(name)

    def _compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) < self.fanout:
                return
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(self._run(self._merged(level)))
            level.clear()

    def close(self) -> None:
        """Takes the runs' names out of the catalog."""
        for name in self.tables:
            SparkSession.active().sql(f"drop table if exists {name}")
        self.tables, self.levels = [], [[]]


def _cuts(docs: DataFrame, key: str, batches: int) -> tuple[list, int]:
    """Keys that cut the table into batches of near equal row counts, ascending, at most batches - 1 of them; the number of rows."""
    found, n = docs.select(F.percentile_approx(key, [i / max(batches, 1) for i in range(1, batches)] or [0.5], F.lit(10_000)).alias("q"), F.count(F.lit(1))).first()
    return sorted(set(found or [])) if batches > 1 else [], n


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs with text as kept, and _n_lines and _n_dropped.

    A line of min_chars code points or more (as its key) found in min_docs documents or more stays only in the one with the largest key.
    """
    row = F.xxhash64(filled(text))
    split = F.split(filled(text), "\n", -1)
    cut = F.lit(0)
    cuts, n = _cuts(docs, key, batches)
    for x in cuts:
        cut = cut + F.when(own(key) > F.lit(x), 1).otherwise(0)
    hashed = docs.select(own(key).alias("_doc"), row.alias("_row"), cut.alias("_batch"), line_hashes(split, min_chars).alias("_hashes"))
    long_lines = F.filter(F.transform("_hashes", lambda h, i: F.struct(i.alias("_pos"), h["_h1"].alias("_h1"), h["_h2"].alias("_h2"))), lambda x: x["_h1"].isNotNull())
    # each task writes a folder and a file for every batch: not for a handful of documents
    sketch = stored(few_parts(hashed.select("_doc", "_row", "_batch", long_lines.alias("_lines")).where(F.size("_lines") > 0), n, each=2_000), "lines", partition_by=("_batch",))

    runs = LineRuns(min_docs, fanout)
    try:
        for i in reversed(range(batches)):
            batch = sketch.where(F.col("_batch") == i)
            distinct = F.array_distinct(F.transform("_lines", lambda x: F.struct(x["_h1"].alias("_h1"), x["_h2"].alias("_h2"))))
            runs.add(batch.select("_doc", F.explode(distinct).alias("_h")).select("_h._h1", "_h._h2", "_doc"), last=i == 0)
        settled = stored(runs.settled().select("_h1", "_h2", "_keeper"), "settled")
    finally:
        runs.close()

    each = sketch.select("_doc", "_row", F.explode("_lines").alias("_x")).select("_doc", "_row", "_x._pos", "_x._h1", "_x._h2")
    lost = each.join(settled, ["_h1", "_h2"]).where((F.col("_doc") < F.col("_keeper")) | (F.col("_doc").isNull() & F.col("_keeper").isNotNull()))
    gone = lost.groupBy("_doc", "_row").agg(F.array_sort(F.collect_set("_pos")).alias("_gone"))
    # stored, so that its size is known when the join is planned: texts are exchanged only if it is too much to send around
    doc_, row_, row2_, gone_, split_, kept_ = fresh(docs.columns, "_doc", "_row", "_row2", "_gone", "_split", "_kept")
    gone = stored(few_parts(gone, n, each=10_000), "gone").select(F.col("_doc").alias(doc_), F.col("_row").alias(row2_), F.col("_gone").alias(gone_))
    both = docs.withColumn(row_, row).join(gone, own(key).eqNullSafe(F.col(doc_)) & (F.col(row_) == F.col(row2_)), "left")
    # the kept lines: the slices between dropped places
    lines, place = F.split(filled(text), "\n", -1), F.col(gone_)
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(place, i - 1) + 1)
    end = lambda i: F.coalesce(F.get(place, i), F.size(split_))
    parts = F.flatten(F.transform(F.sequence(F.lit(0), F.size(place)), lambda i: F.slice(split_, start(i) + 1, end(i) - start(i))))
    kept = F.when(place.isNull(), filled(text)).otherwise(F.array_join(parts, "\n"))
    out = both.withColumn(split_, lines).withColumn(kept_, kept)
    return out.select(
        *[F.col(kept_).alias(c) if c == text else own(c) for c in docs.columns if c not in ("_n_lines", "_n_dropped")],
        F.size(split_).cast("long").alias("_n_lines"),
        F.when(place.isNull(), F.lit(0)).otherwise(F.size(place)).cast("long").alias("_n_dropped"),
    )

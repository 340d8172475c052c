"""op2 and op6 by brute force."""

import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tests_llm_hand import lines_by_hand
from tidelog.llm import lines
from tidelog.llm.common import stored
from tidelog.llm.lines import LineRuns, _two, dedup_lines
from tidelog.llm.shards import balanced_shards, write_shards

LONG = "This  is a Line of more than FORTY code points, %d"


def test_lines_by_hand(spark, lowered, odd_texts):
    R = random.Random(4)
    pool = [LONG % i for i in range(12)] + ["  " + (LONG % 3).upper() + "\t", "short", "", "é" * 40, "É" * 40, " " + LONG % 4]
    rows = [(i, "\n".join(R.choice(pool) for _ in range(R.randint(0, 9)))) for i in range(60)]
    rows += [(1000 + i, x) for i, x in enumerate(odd_texts)] + [(5, rows[5][1]), (5, LONG % 1), (None, LONG % 1), (None, LONG % 2 + "\n" + LONG % 2)]
    for batches, fanout in ((4, 2), (1, 2), (6, 3)):
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1)).repartition(3)
        got = dedup_lines(docs, batches=batches, fanout=fanout)
        assert got.columns == [*docs.columns, "_n_lines", "_n_dropped"]
        found = sorted((r.doc_id is None, r.doc_id or 0, r._n_lines, r._n_dropped, r.text) for r in got.collect())
        assert found == sorted((k is None, k or 0, n, d, t) for k, n, d, t in lines_by_hand(rows, lowered))
    assert dedup_lines(docs.limit(0)).count() == 0


def test_runs_settle_and_compact(spark):
    runs = LineRuns(min_docs=3, fanout=2)
    batch = lambda *x: spark.createDataFrame(list(x), "_h1 long, _h2 long, _doc long")
    runs.add(batch((1, 1, 90), (1, 1, 80), (1, 1, 70), (2, 2, 95)))
    assert [r._keeper for r in runs.settled().collect()] == [90]
    runs.add(batch((1, 1, 60), (2, 2, 50)))
    assert [len(x) for x in runs.levels] == [0, 1]
    assert sorted((r._h1, r._docs, r._keeper) for r in runs.merged().collect()) == [(1, 3, 90), (2, 2, 95)]  # a settled line is not added again
    runs.add(batch((2, 2, 10)))
    assert sorted(r._h1 for r in runs.settled().collect()) == [1, 2]


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan


def test_runs_are_merged_bucket_by_bucket(spark):
    """Of an anti-join only the batch is exchanged, of a merge nothing; no run has a line twice, and each bucket is one file."""
    runs = LineRuns(min_docs=2, fanout=9, buckets=8)
    rows = spark.range(4000).select((F.col("id") % 700).alias("_h1"), (F.col("id") % 7).alias("_h2"), F.col("id").alias("_doc"))
    want = {}
    for _ in range(3):
        for h1, h2, _ in rows.distinct().collect():
            want[h1, h2] = want.get((h1, h2), 0)
        seen = {k for k, n in want.items() if n >= 2}
        for h1, h2, _ in rows.collect():
            if (h1, h2) not in seen:
                want[h1, h2] += 1
        runs.add(rows)
        rows = rows.select((F.col("_h1") + 350).alias("_h1"), "_h2", "_doc")
    assert {(r._h1, r._h2): r._docs for r in runs.merged().collect()} == {k: n for k, n in want.items()}
    one, two = runs.levels[0][:2]
    assert exchanges(_two(one, two))[0] == 0
    n, plan = exchanges(runs.unsettled(rows.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_docs"), F.max("_doc").alias("_keeper"))))
    assert n == 1 and plan.count("SortMergeJoin") == 3
    for name in runs.tables:
        assert len(spark.table(name).inputFiles()) <= 8
    tables = list(runs.tables)
    runs.close()
    assert not any(spark.catalog.tableExists(x) for x in tables)


def test_lines_of_clashing_columns(spark):
    rows = [(i, LONG % 1, f"own {i}", i) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "_row", "a.b"]).select("*", F.lit("x").alias("_GONE"), F.lit("y").alias("_n_lines"), F.lit(3).alias("_split"))
    got = dedup_lines(docs)
    assert got.columns == [c for c in docs.columns if c != "_n_lines"] + ["_n_lines", "_n_dropped"]
    assert sorted((r.doc_id, r._row, r["a.b"], r._GONE, r._split, r.text) for r in got.collect()) == [(i, f"own {i}", i, "x", 3, LONG % 1 if i == 5 else "") for i in range(6)]


def test_shards(spark, odd_texts):
    R = random.Random(2)
    rows = [(R.randrange(10**6), "w" * R.randrange(400)) for _ in range(700)] + [(i, x) for i, x in enumerate(odd_texts)] + [(None, "x"), (5, "same"), (5, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash")).repartition(4)
    for shards in (1, 3, 16):
        got = balanced_shards(docs, shards=shards).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((k is not None, k or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        total, most = sum(r.size for r in got), max(r.size for r in got)
        assert set(by) <= set(range(shards))
        last = (False, -1)
        for s in sorted(by):
            own = sorted(by[s], key=lambda r: r.slot)
            assert [r.slot for r in own] == list(range(len(own)))
            assert abs(sum(r.size for r in own) - total / shards) <= most
            keys = [(r.doc_id is not None, r.doc_id or 0) for r in own]
            assert keys == sorted(keys) and keys[0] >= last
            last = keys[-1]
    assert balanced_shards(docs.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
    write_shards(docs, str(tmp_path / "s"), shards=4)
    got = spark.read.parquet(str(tmp_path / "s"))
    assert got.count() == 50 and got.select("shard").distinct().count() == 4
    assert got.where("length(text) <> doc_id").count() == 0


def test_small_tables_of_lines_are_few_files(spark, monkeypatch):
    made, runs, run = [], [], LineRuns._run
    monkeypatch.setattr(lines, "stored", lambda df, name, **how: made.append((name, stored(df, name, **how))) or made[-1][1])
    monkeypatch.setattr(LineRuns, "_run", lambda self, rows: runs.append(1) or run(self, rows))
    line = "a line of more than forty code points, found in all"
    docs = spark.range(0, 400, 1, 50).select(F.col("id").alias("doc_id"), F.concat(F.lit(line + "\n"), F.col("id").cast("string")).alias("text"))
    got = {r.doc_id: (r.text, r._n_dropped) for r in dedup_lines(docs).collect()}
    assert got == {i: (f"{line}\n{i}", 0) if i == 399 else (str(i), 1) for i in range(400)}
    most, files = spark.sparkContext.defaultParallelism, {n: len(df.inputFiles()) for n, df in made}
    assert files["lines"] <= 4 * most and files["gone"] <= most, files
    assert len(runs) == 6  # four batches, one compaction, two runs as one at the end

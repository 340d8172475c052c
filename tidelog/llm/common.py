"""What the operators of this subpackage share: tables in the shared folder, code shipping, safe column picks."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.shared import scratch

_shipped: set[str] = set()


def stored(df: DataFrame, name: str, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, lost executors cost nothing before it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_parts(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """df, of at most so many rows, in no more parts than they ask for: `each` rows a part, but a part for each core.

    Without it a small table is as many files as shuffles have partitions, and Hadoop's local file system starts three processes for each of them.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, once for each Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="tidelog-code-"), "tidelog_code.zip")
    with zipfile.ZipFile(to, "w") as z:
        for d, _, names in os.walk(root):
            for x in names:
                if x.endswith(".py"):
                    full = os.path.join(d, x)
                    z.write(full, os.path.join("tidelog", os.path.relpath(full, root)))
    sc.addPyFile(to)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(column: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(own(column).cast("string"), F.lit(""))


def own(column: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names given, each lengthened until no column has it, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def spread_join(left: DataFrame, right: DataFrame, on: list[str], *, weight: str, total: int, salt: Column, how: str = "inner", share: int = 1000) -> DataFrame:
    """left joined with right, in which no key is found twice, so that no task gets a hot key whole.

    weight: right's column of how many rows of left have the key; their sum is at most total. A key of more than a `share`-th of total
    is dealt to as many parts as its weight has such shares, by salt, which must be the same whenever a row is computed again. Fewer than
    `share` keys are so large: they alone are broadcast. Their rows of right are repeated once a part, fewer than 2 x `share` in all. Keys are not null.
    """
    parts, part = fresh([*left.columns, *right.columns], "_parts", "_part")
    sized = right.withColumn(parts, F.ceil(F.col(weight) * share / F.lit(max(total, 1))))
    hot = sized.where(F.col(parts) > 1).select(*on, parts)
    dealt = left.join(F.broadcast(hot), on, "left").withColumn(part, F.coalesce(F.pmod(salt, F.col(parts)), F.lit(0).cast("long"))).drop(parts)
    copies = sized.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(parts), F.lit(1)) - 1))).drop(parts)
    return dealt.join(copies, [*on, part], how).drop(part)


def open_fs(uri: str):
    """(pyarrow file system, path) of a path or URI in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def release_memory() -> None:
    """Gives freed memory back to the system. Python workers live on between tasks, side by side with those of other operators."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)

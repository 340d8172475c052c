"""Byte-balanced contiguous shards by global prefix sums, in DataFrame operations only.

Rows are put in doc_id order by a range exchange of three narrow columns. Each range partition gives one total;
a running sum over those totals (a row for each partition) gives every partition its offset, and a window inside
the partition gives every row its own. The line of bytes is cut at equal targets.

Defined results: a null text counts as empty (size 1, crc 0); null keys come first; rows that agree in key, size
and crc are interchangeable, and take neighbouring places; an empty table gives no rows; other columns are left
out, whatever their names; texts of any length count whole. Contiguity in key order is the law here: equal texts are not kept together, as a group
of copies may be larger than a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import filled, own, stored


def global_offsets(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """rows with _before (sum of size over all earlier rows), _index (their count) and _total; rows must be narrow.

    order: the columns of the global order. Ties beyond it are broken by the place in the input.
    """
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in [*order, "_tie"]]
    ranged = stored(spread.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range partition
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(upto), F.lit(0)).alias("_bytes0"),
        F.coalesce(F.sum("_rows").over(upto), F.lit(0)).alias("_rows0"),
        F.sum("_bytes").over(everything).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*keys)
    local = ranged.withColumn("_run", F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(inside).cast("long"))
    return local.join(offsets, "_part").select(
        *rows.columns,
        (F.col("_bytes0") + F.col("_run") - F.col(size)).alias("_before"),
        (F.col("_rows0") + F.col("_nth") - 1).alias("_index"),
        "_total",
    )


def balanced_shards(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row: contiguous shards of near equal bytes, slots from 0 in each."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    narrow = docs.select(
        own(key).alias("_key"),
        (F.octet_length(filled(text)).cast("long") + 1).alias("size"),
        F.crc32(filled(text).cast("binary")).alias("text_crc32"),
    )
    at = global_offsets(stored(narrow, "sizes"), ["_key", "size", "text_crc32"], "size")
    cut = stored(at.select("_key", "size", "text_crc32", "_index", F.expr(f"cast(least((_before * {int(shards)}) div _total, {int(shards) - 1}) as int)").alias("shard")), "cut")
    first = cut.groupBy("shard").agg(F.min("_index").alias("_first"))  # at most `shards` rows
    return cut.join(F.broadcast(first), "shard").select(F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_index") - F.col("_first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", shards: int = 16) -> None:
    """Writes key and text as Parquet, a folder for each shard."""
    placed = balanced_shards(docs, key=key, text=text, shards=shards)
    keyed = docs.select(own(key).alias("_k"), own(text).alias("_text"), (F.octet_length(filled(text)).cast("long") + 1).alias("_size"), F.crc32(filled(text).cast("binary")).alias("_crc"))
    # rows that agree in key, size and crc get their places one to one
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0)))
    left = keyed.withColumn("_n", nth("_k", "_size", "_crc"))
    right = placed.withColumn("_n2", nth(key, "size", "text_crc32"))
    both = left.join(right, F.col("_k").eqNullSafe(F.col(key)) & (F.col("_size") == F.col("size")) & (F.col("_crc") == F.col("text_crc32")) & (F.col("_n") == F.col("_n2")))
    both.select(F.col("_k").alias(key), F.col("_text").alias(text), "slot", "shard").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

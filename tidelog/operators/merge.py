"""The semantic core: of each key's versions the newest counts, and it is visible if it is no delete.

The order of steps is fixed: conditions on key columns may run before the merge (all versions of a key share
them), conditions on fields only after it. Catalyst keeps to this by itself: it pushes filters through the window only on
the columns the window is partitioned by.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.schema import DELETE, OP, PUT, SEQ


def newest_wins(log: DataFrame, key: list[str], *, seq: str = SEQ, ties: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: that of the largest seq, deletes included. ties: columns, ascending, that decide between equal seqs."""
    order = Window.partitionBy(*key).orderBy(F.col(seq).desc(), *ties)
    return log.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def newest_wins_by_max(log: DataFrame, key: list[str], *, seq: str = SEQ) -> DataFrame:
    """The same by one max_by for each column: without a sort where all columns are of fixed width. For logs in which no seq comes twice under a key."""
    rest = [c for c in log.columns if c not in key and c != seq]
    return log.groupBy(*key).agg(*[F.max_by(c, seq).alias(c) for c in rest], F.max(seq).alias(seq)).select(*log.columns)


def live(log: DataFrame, key: list[str], *, seq: str = SEQ, op: str = OP, ties: tuple[str, ...] = ()) -> DataFrame:
    """The visible rows, without seq and op."""
    return newest_wins(log, key, seq=seq, ties=ties).where(F.col(op) == PUT).drop(seq, op)


def tombstones(log: DataFrame, key: list[str], *, seq: str = SEQ, op: str = OP) -> DataFrame:
    """The keys whose newest version is a delete, with its seq."""
    return newest_wins(log.select(*key, seq, op), key, seq=seq).where(F.col(op) == DELETE).drop(op)


def layers(*sources: DataFrame) -> DataFrame:
    """The logs of several sources as one; __source numbers them, the first being the newest layer, for ties of seq."""
    return reduce(DataFrame.unionByName, [s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)])


def version_stats(log: DataFrame, key: list[str], *, seq: str = SEQ) -> DataFrame:
    """Versions of each key, and their least and largest seq."""
    return log.groupBy(*key).agg(F.count(F.lit(1)).alias("versions"), F.min(seq).alias("min_seq"), F.max(seq).alias("max_seq"))

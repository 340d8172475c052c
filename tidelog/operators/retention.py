"""Retention: rows older than a cutoff are neither visible nor kept by compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.timerange import literal


def unexpired(log: DataFrame, time: str, cutoff: int | None) -> DataFrame:
    """The rows, deletes included, at or after the cutoff. The time index is part of the key, so this may run before the merge, and reaches the scan."""
    return log if cutoff is None else log.where(F.col(time) >= literal(cutoff, log.schema[time].dataType.typeName()))

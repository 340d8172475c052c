"""Time-window compaction: segments of one window become one."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame

from tidelog.operators.merge import newest_wins
from tidelog.operators.retention import unexpired


def pick_window(segments: list, threshold: int) -> list:
    """The segments to merge: those of the earliest window with at least `threshold`; none while there are fewer in all."""
    if len(segments) < threshold:
        return []
    by = defaultdict(list)
    for s in segments:
        by[s.window].append(s)
    return next((by[w] for w in sorted(by) if len(by[w]) >= max(2, threshold)), [])


def compacted(log: DataFrame, key: list[str], time: str, cutoff: int | None = None) -> DataFrame:
    """The newest version of each key; deletes stay, as older versions may lie in other segments; what has expired goes."""
    return newest_wins(unexpired(log, time, cutoff), key)

"""Structured Streaming into a region: each micro-batch is one commit, taken in once however often it is tried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from tidelog.schema import PUT
from tidelog.sources.region import Region


def ingest(stream: DataFrame, region: Region, checkpoint: str, *, name: str = "ingest", op: int | str = PUT, seq: str | None = None, order_by: list[str] | None = None, compact: bool = True, **trigger) -> StreamingQuery:
    """Starts a query that appends a stream. Late rows count like any others: the seq decides."""

    def take(batch: DataFrame, number: int) -> None:
        region.append(batch, op=op, seq=seq, order_by=order_by, batch=f"{name}:{number}")
        if compact:
            region.compact_all()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

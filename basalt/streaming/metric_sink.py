"""Metric points pushed in batches, at a fixed rate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from basalt.operators.metrics import batched

#: Points of one post.
POST_SIZE = 50


def pushed(points: DataFrame, post: Callable[[list], None], order: Sequence[str], size: int = POST_SIZE, period: str | None = "60 seconds") -> DataStreamWriter:
    """A stream of points, posted `size` at a time from the executors; a post that fails is dropped and not tried again. period None: what is there, once."""

    def sink(rows: DataFrame, _: int) -> None:
        numbered = batched(rows, size, order=order)

        def send(part):
            run, held = None, []
            for row in part:
                if row["batch"] != run and held:
                    _posted(post, held)
                    held = []
                run = row["batch"]
                held.append(row)
            if held:
                _posted(post, held)

        numbered.repartition("batch").sortWithinPartitions("batch", *order).foreachPartition(send)

    writer = points.writeStream.foreachBatch(sink)
    return writer.trigger(availableNow=True) if period is None else writer.trigger(processingTime=period)


def _posted(post: Callable[[list], None], rows: list) -> None:
    import logging

    try:
        post(rows)
    except Exception:
        logging.getLogger(__name__).warning("a post of %d points failed", len(rows), exc_info=True)

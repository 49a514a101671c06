"""The registry as a stream: deltas arrive, every application's instances are state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from basalt.operators.registry import PHASES, Instances


#: Seconds between two polls of a registry.
POLL_SECONDS = 30


def polled(found: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: float = POLL_SECONDS) -> StreamingQuery:
    """Hands the stream's batches to handle() every so many seconds."""
    return found.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime=f"{every} seconds").foreachBatch(handle).start()


def apply_stream(changes: DataFrame) -> DataFrame:
    """(app, id, status, place, n) of each application that a batch of changes (app, delta, seq, action, id, status) touched.

    place is 0 and id null for an application that has no instances left. A delta must arrive within one batch; older
    deltas than the last applied one of an application are refused, so that a batch that is run again changes nothing.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, names, states = state.get if state.exists else (-1, [], [])
        held = Instances(dict(zip(names, states, strict=True)))
        rows = pd.concat([*batches])
        rows = rows[rows["action"].isin([*PHASES]) & (rows["delta"] > last)]
        rows = rows.assign(phase=rows["action"].map(PHASES)).sort_values(["delta", "phase", "seq"], kind="stable")
        for delta, part in rows.groupby("delta", sort=True):
            held.apply(zip(part["action"], part["id"], part["status"], strict=True))
            last = int(delta)
        state.update((last, [*held.rows], [*held.rows.values()]))
        n = len(held.rows)
        yield pd.DataFrame({"app": [key[0]] * max(n, 1), "id": [*held.rows] or [None], "status": [*held.rows.values()] or [None], "place": range(1, n + 1) if n else [0], "n": [n] * max(n, 1)})

    return changes.groupBy("app").applyInPandasWithState(fold, "app string, id string, status string, place int, n int", "last bigint, names array<string>, states array<string>", "update", GroupStateTimeout.NoTimeout)

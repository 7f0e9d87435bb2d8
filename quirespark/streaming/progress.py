"""Progress as a stream: each run's high-water mark over events that come late and in any order.

A run's state holds the progress that each of its events states, by sequence number. An event's mark is the most
that events up to it have stated. A late event raises the marks of later ones, which are then sent again, so that the last row of
``(run_id, seq)`` in a table of updates is that of the batch operator (:func:`..operators.progress.high_water`). State grows with
the events of runs that go on; it goes ``expiry`` after a run's last event, or with its ``done`` event once no number is missing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.files import stage_progress
from ..shipping import ship

UPDATES = "run_id string, seq long, progress double"
STATE = "seqs array<long>, stated array<double>"
EXPIRY = 3_600_000


def marks(seqs: list[int], stated: list[float], new: Iterable[tuple[int, float]]) -> dict[int, float]:
    """Puts new events into a run's ordered lists; the marks that they make or change."""
    changed: dict[int, float] = {}
    for seq, value in sorted(new):
        at = bisect_left(seqs, seq)
        if at < len(seqs) and seqs[at] == seq:  # said again: the most counts
            stated[at] = max(stated[at], value)
        else:
            seqs.insert(at, seq)
            stated.insert(at, value)
        high, before = max(stated[: at + 1]), max(stated[:at], default=0.0)
        changed[seq] = high
        for i in range(at + 1, len(seqs)):  # those that the new event raises
            before = max(before, stated[i])
            if before >= high:
                break
            changed[seqs[i]] = high
    return changed


def high_water_stream(events: DataFrame, expiry_ms: int | None = EXPIRY) -> DataFrame:
    """``(run_id, seq, progress)`` of a stream of events ``(run_id, seq, stage, current, total)``: rows that are new, or that a late event changed.

    With an expiry, Spark looks for runs that are over time in batches without events as well; a query that drains its source and ends
    (``availableNow``) takes None, and keeps the state of unfinished runs in its checkpoint.
    """
    ship(events.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seqs, stated = map(list, state.get) if state.exists else ([], [])
        changed: dict[int, float] = {}
        for batch in batches:
            changed |= marks(seqs, stated, zip(batch["seq"].tolist(), batch["stated"].tolist(), strict=True))
        if stated and stated[-1] >= 1.0 and seqs[-1] - seqs[0] == len(seqs) - 1 and seqs[0] <= 1:
            if state.exists:
                state.remove()  # nothing is missing, and nothing follows
        else:
            state.update((seqs, stated))
            if expiry_ms is not None:
                state.setTimeoutDuration(expiry_ms)
        yield pd.DataFrame({"run_id": [key[0]] * len(changed), "seq": list(changed), "progress": list(changed.values())})

    stated = events.where("run_id is not null and seq is not null").select("run_id", F.col("seq").cast("long").alias("seq"), stage_progress(F.col("stage"), F.col("current"), F.col("total")).alias("stated"))
    return stated.groupBy("run_id").applyInPandasWithState(run, UPDATES, STATE, "update", GroupStateTimeout.NoTimeout if expiry_ms is None else GroupStateTimeout.ProcessingTimeTimeout)

"""The campaign fold on a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

FOLDED = "campaign_id string, aggregate_type string, aggregate_id string, sequence long, state string"


def fold_states(state_events: DataFrame) -> DataFrame:
    """A stream of (campaign_id, aggregate_type, aggregate_id, sequence,
    state), as ``replay.state_events`` gives, to the newest state of each
    aggregate (update mode). Events may come late or repeat: one with a
    sequence not above the kept one changes nothing. State is one row for
    each aggregate."""
    key = ["campaign_id", "aggregate_type", "aggregate_id"]

    def update(group: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        best = kept.get if kept.exists else None
        for batch in batches:
            row = batch.loc[batch["sequence"].idxmax()]
            if best is None or int(row["sequence"]) > best[0]:
                best = (int(row["sequence"]), str(row["state"]))
        if best is not None:
            kept.update(best)
            yield pd.DataFrame([(*group, *best)], columns=[*key, "sequence", "state"])

    columns = state_events.select(*key, "sequence", "state")
    return columns.groupBy(*key).applyInPandasWithState(update, FOLDED, "sequence long, state string", "update", "NoTimeout")


def once(events: DataFrame, key: list[str], time: str, within: str) -> DataFrame:
    """Drops redelivered events: at-least-once delivery, effects once."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(key)

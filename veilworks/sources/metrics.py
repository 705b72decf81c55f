"""Metrics of running plans: counts that Spark observes while rows pass, in batch and in streams, without a pass of their own."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Name of the observed row, and the metrics in it.
NAME = "detection"


def _counts(df: DataFrame, text: str, spans: str) -> list:
    count = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return [F.count(F.lit(1)).alias("rows"), count(F.length(text), "chars"), count(F.greatest(F.size(spans), F.lit(0)), "entities"), count((F.size(spans) > 0).cast("int"), "rows_with_entities")]


def observed(df: DataFrame, text: str = "text", spans: str = "entities") -> tuple[DataFrame, Observation]:
    """df, and what was counted once an action has run over all of it: rows, chars, entities, rows_with_entities."""
    seen = Observation(NAME)
    return df.observe(seen, *_counts(df, text, spans)), seen


def observed_stream(df: DataFrame, text: str = "text", spans: str = "entities") -> DataFrame:
    """df, whose batches report the same counts to `Lines`."""
    return df.observe(NAME, *_counts(df, text, spans))


class Lines(StreamingQueryListener):
    """Gives one JSON line for each batch to a function: query, batch, time, rows a second and counts, without content."""

    def __init__(self, write: Callable[[str], object]) -> None:
        self.write = write

    def onQueryStarted(self, event: object) -> None:
        pass

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        pass

    def onQueryProgress(self, event: object) -> None:
        p = event.progress
        row = p.observedMetrics.get(NAME)
        if row is not None:
            self.write(json.dumps({"ts": p.timestamp, "query": str(p.runId), "batch": p.batchId, "ms": p.durationMs.get("triggerExecution"), **row.asDict()}))

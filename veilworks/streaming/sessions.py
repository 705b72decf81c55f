"""The session mapping as a stream: map states by key, which a timer ends when a session has been idle.

Each of a session's tables is a map state of its own: what a batch does not touch is neither read nor written, so that a
batch costs work by its own mentions, whatever the session has held. Rows carry keyed hashes and sealed values (see
operators.vault), so that no original is in the state, its change log or its checkpoints.

The state store has to be RocksDB: set spark.sql.streaming.stateStore.providerClass (`ROCKSDB`) before the query starts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilworks.operators.generate import Builder, generate
from veilworks.operators.spans import SPAN, detect
from veilworks.operators.vault import MAPPED, MENTION, Tables, Vault, hidden, mention_of

IDLE_SECONDS = 1800
PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A row of this type marks the end of a message; one without a type deletes the session.
MESSAGE = ""
#: Beside MENTION in a stream: when a row happened, for sessions that end by event time.
ROW = f"{MENTION}, at timestamp"


class StoredMap:
    """A map state as a table of Tables: values are JSON; reads of a batch are kept, writes go out once, at its end."""

    def __init__(self, state: object) -> None:
        self.state, self.known, self.fresh = state, {}, {}

    def get(self, key: object, default: object = None) -> object:
        if key not in self.known:
            held = self.state.getValue((key,))
            self.known[key] = None if held is None else json.loads(held[0])
        got = self.known[key]
        return default if got is None else got

    def __getitem__(self, key: object) -> object:
        got = self.get(key)
        if got is None:
            raise KeyError(key)
        return got

    def __contains__(self, key: object) -> bool:
        return self.get(key) is not None

    def __setitem__(self, key: object, value: object) -> None:
        self.known[key] = value
        self.fresh[key] = None

    def flush(self) -> None:
        for key in self.fresh:
            self.state.updateValue((key,), (json.dumps(self.known[key], ensure_ascii=False),))
        self.forget()

    def forget(self) -> None:
        self.known, self.fresh = {}, {}


class SessionMapping(StatefulProcessor):
    """Mentions of a session to fakes. Its state ends `idle` milliseconds after its last row, by the clock or, with
    event_time, by the watermark."""

    MAPS = {"forward": "string", "reverse": "string", "faces": "string", "people": "long", "words": "string"}
    META = "people long, n long, created_at timestamp, last_activity timestamp, messages long, timer long"

    def __init__(self, idle: int | None, event_time: bool, build: Builder = generate) -> None:
        self.idle, self.event_time, self.build = idle, event_time, build

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.maps = {n: handle.getMapState(n, f"key {kind}", "value string") for n, kind in self.MAPS.items()}
        self.meta = handle.getValueState("meta", self.META)

    def _clear(self) -> None:
        held = self.meta.get()
        if held is not None and held[5] is not None:
            self.handle.deleteTimer(held[5])
        for state in (*self.maps.values(), self.meta):
            state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = [p for p in rows if len(p)]
        if not held:
            return
        tables = {n: StoredMap(s) for n, s in self.maps.items()}
        size = {"people": 0, "n": 0}
        vault = Vault("" if key[0] is None else str(key[0]), Tables(**tables, size=size), self.build)
        now = None if self.idle is None or self.event_time else timerValues.getCurrentProcessingTimeInMs()
        before = self.meta.get()
        created, last, messages, timer = (None, None, 0, None) if before is None else (before[2], before[3], before[4], before[5])
        if before is not None:
            size.update(people=before[0], n=before[1])
        there, made = before is not None, []
        for r in pd.concat(held).sort_values("ord", kind="stable").to_dict("records"):
            at = r["at"] if r["at"] is not None and r["at"] == r["at"] else None if now is None else pd.Timestamp(now, unit="ms")
            if r["entity_type"] is None:
                self._clear()
                for t in tables.values():
                    t.forget()
                size.update(people=0, n=0)
                created, last, messages, timer, there = None, None, 0, None, False
                continue
            if r["entity_type"] == MESSAGE:
                messages += there  # a session without a mapping has no state to count in
            else:
                made.append((vault.session if key[0] is not None else None, int(r["ord"]), vault.get_or_create(mention_of(r))))
                there = True
            if there and at is not None:
                created, last = created or at, at if last is None else max(pd.Timestamp(last), at)
        for t in tables.values():
            t.flush()
        if there:
            if self.idle is not None:
                start = now if not self.event_time else int(pd.Timestamp(last).timestamp() * 1000) if last is not None else None
                if start is not None and timer != start + self.idle:
                    if timer is not None:
                        self.handle.deleteTimer(timer)
                    timer = start + self.idle
                    self.handle.registerTimer(timer)
            self.meta.update((size["people"], size["n"], created, last, messages, timer))
        yield pd.DataFrame(made, columns=["session", "ord", "fake"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        held = self.meta.get()
        if held is not None and held[5] is not None and held[5] <= expiredTimerInfo.getExpiryTimeInMs():
            for state in (*self.maps.values(), self.meta):
                state.clear()
        yield pd.DataFrame([], columns=["session", "ord", "fake"])

    def close(self) -> None:
        pass


def map_stream(rows: DataFrame, idle: int | None = IDLE_SECONDS, event_time: bool = False, build: Builder = generate) -> DataFrame:
    """Rows of `passed` with their fakes. A session's state lives while it has rows, for `idle` seconds after the last.

    With event_time rows have a watermark on `at`, and a session ends when that is past its last row by idle. A row
    without an entity_type deletes its session's state where it stands in the order; it gives no row, whether or not there
    was a state. With idle None it never ends.
    """
    held = rows.sparkSession.conf.get(PROVIDER, "")
    if held != ROCKSDB:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}")
    mode = "None" if idle is None else "EventTime" if event_time else "ProcessingTime"
    processor = SessionMapping(None if idle is None else idle * 1000, event_time, build)
    return rows.groupBy("session").transformWithStateInPandas(processor, MAPPED, "append", mode)


def passed(messages: DataFrame, key: bytes, spans: str = "entities", at: str | None = None) -> DataFrame:
    """ROW for each mention of (session, turn, spans), and one for each message; at: the column that tells when."""
    marked = F.concat(F.col(spans), F.array(F.lit(None).cast(SPAN)))
    x = messages.select(F.col("session").cast("string").alias("session"), "turn", (F.col(at) if at else F.lit(None).cast("timestamp")).alias("at"), F.posexplode(marked).alias("i", "x"))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 40)))
    rows = x.select("session", (turn * F.lit(1 << 20) + F.col("i")).alias("ord"), "at", F.coalesce("x.entity_type", F.lit(MESSAGE)).alias("entity_type"), "x.text", "x.lemma", "x.case", F.col("x.metadata.gender").alias("gender"))
    return hidden(rows, key).select(*[c.split()[0] for c in ROW.split(", ")])


def pseudonymize_stream(messages: DataFrame, key: bytes, idle: int | None = IDLE_SECONDS, at: str | None = None, late: str = "10 minutes", **options: object) -> DataFrame:
    """A stream of (session, turn, text) to the fakes of its mentions. at: a column of event time, by which sessions end."""
    found = detect(messages, **options)
    if at is not None:
        found = found.withWatermark(at, late)
    return map_stream(passed(found, key, at=at), idle, at is not None)


def deletions(requests: DataFrame) -> DataFrame:
    """Rows for map_stream, in union with those of `passed`, from (session, turn): each ends its session after that turn."""
    after = ((F.col("turn").cast("long") + 1) * F.lit(1 << 20) - 1).alias("ord")
    none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ROW.split(", ")[2:]]
    return requests.select(F.col("session").cast("string").alias("session"), after, *none)


def stored(spark: SparkSession, checkpoint: str, what: str = "meta") -> DataFrame:
    """A table of the stream's state as its last committed batch left it: meta, or one of SessionMapping.MAPS."""
    return spark.read.format("statestore").option("stateVarName", what).load(checkpoint)


def latency_windows(events: DataFrame, width: str = "1 minute", late: str = "10 minutes", ts: str = "ts", channel: str = "channel", ms: str = "ms") -> DataFrame:
    """Counts and means of each channel in windows of time; rows later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), channel).agg(F.count(F.lit(1)).alias("n"), F.avg(ms).alias("mean"), F.max(ms).alias("most"))


def detect_with_live_thresholds(messages: DataFrame, table, sink, checkpoint: str):
    """Start a query whose every batch asks `table` (a ThresholdFile) for the thresholds that then hold."""

    def batch(df: DataFrame, n: int) -> None:
        held, default = table.current()
        sink(detect(df, thresholds=held, default=default), n)

    return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).start()

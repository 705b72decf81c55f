"""Sealed session mappings at rest: versions of state below a path, looked up by session and keyed hash.

A version is a folder of Parquet with what changed: rows of vault.STATE, in which originals are sealed and keys are keyed
hashes, and a row `gone` for each session that was deleted. It counts once its job has committed it. The state is the
last row of each (session, part, name) after its session's last deletion; of the counters the sum, the first or the last.
`compact` makes one folder of it, and `vacuum` deletes those that no state needs any more, so that what was deleted is gone.

`assign` joins mentions with stored hashes. Sessions in which every hash is known, and no name has a surface to be noted,
are done by that join; only the others meet the state machine, with their own rows of the state.

Cases: a store without a version is empty; a null session is a session; an unknown session may be deleted; a version
that was cut short is not seen, and its number is not used again.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.operators import vault
from veilworks.operators.generate import Builder, generate
from veilworks.operators.vault import STATE, State, is_name

_FIELDS = [c.split()[0] for c in STATE.split(", ")]
#: Counters of a session: of versions the least, the greatest and the sum hold.
COUNTERS = ("created_at", "last_activity", "messages")


class SessionStore:
    """The versions below a path."""

    def __init__(self, spark: SparkSession, path: str, key: bytes) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # -- folders

    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folders(self) -> list[tuple[int, str, bool]]:
        """Number, kind ('base' or 'delta') and whether it is complete, in order."""
        where, fs = self._fs()
        if not fs.exists(where):
            return []
        out = []
        for status in fs.listStatus(where):
            kind, _, n = status.getPath().getName().partition("-")
            if kind in ("base", "delta") and n.isdigit():
                done = self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
                out.append((int(n), kind, fs.exists(done)))
        return sorted(out)

    def _of(self, n: int, kind: str) -> str:
        return f"{self.path}/{kind}-{n:08d}"

    def versions(self) -> list[int]:
        return [n for n, _, done in self._folders() if done]

    def _put(self, rows: DataFrame, kind: str) -> int:
        n = max((n for n, *_ in self._folders()), default=0) + 1
        rows.select(*_FIELDS).write.parquet(self._of(n, kind))
        return n

    # -- reading

    def _layers(self, version: int | None = None) -> list[tuple[int, str]]:
        held = [(n, kind) for n, kind, done in self._folders() if done and (version is None or n <= version)]
        last = max((i for i, (_, kind) in enumerate(held) if kind == "base"), default=0)
        return held[last:]

    def state(self, version: int | None = None) -> State:
        """The state as of a version, or of the last."""
        layers = self._layers(version)
        if not layers:
            return State(self.spark.createDataFrame([], STATE), self.key)
        each = [self.spark.read.schema(STATE).parquet(self._of(n, kind)).withColumn("_v", F.lit(n)) for n, kind in layers]
        rows = each[0]
        for more in each[1:]:
            rows = rows.unionByName(more)
        if len(layers) == 1:
            return State(rows.filter("part <> 'gone'").drop("_v"), self.key)
        gone = rows.filter("part = 'gone'").groupBy(F.col("session").alias("_of")).agg(F.max("_v").alias("_gone"))
        live = rows.filter("part <> 'gone'").join(gone, rows["session"].eqNullSafe(gone["_of"]), "left").filter("_gone is null or _v > _gone")
        plain = live.filter("part <> 'meta'").groupBy("session", "part", "name").agg(F.max_by(F.struct(*_FIELDS), "_v").alias("x")).select("x.*")
        n = F.when(F.col("name") == "created_at", F.min("n")).when(F.col("name") == "last_activity", F.max("n")).otherwise(F.sum("n"))
        meta = live.filter("part = 'meta'").groupBy("session", "name").agg(n.alias("n"))
        blank = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in STATE.split(", ")[4:]]
        return State(plain.unionByName(meta.select("session", F.lit("meta").alias("part"), "name", "n", *blank)), self.key)

    # -- writing

    @staticmethod
    def _rows(sessions: DataFrame, part: str, name: object, n: object) -> DataFrame:
        blank = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in STATE.split(", ")[4:]]
        return sessions.select("session", F.lit(part).alias("part"), name.alias("name"), n.cast("long").alias("n"), *blank)

    def add(self, rows: DataFrame) -> int:
        """The number of the version that these rows of STATE make."""
        return self._put(rows, "delta")

    def assign(self, mentions: DataFrame, messages: DataFrame | None = None, now: int | None = None, build: Builder = generate) -> DataFrame:
        """(session, row, i, fake) of mentions (vault.mentions, with row); what is new is the next version.

        messages: rows with a session; each counts as one of its session, if that has a mapping then. now: milliseconds.
        """
        now = int(time.time() * 1000) if now is None else now
        held = self.state().rows
        known = held.filter("part = 'fwd'").select(F.col("session").alias("_of"), F.col("name").alias("_field"), F.col("fake").alias("_base"))
        looked = mentions.join(known, mentions["session"].eqNullSafe(known["_of"]) & (mentions["field"] == known["_field"]), "left").drop("_of", "_field")
        open_ = looked.filter(F.col("_base").isNull() | is_name(F.col("entity_type"))).select(F.col("session").alias("_open")).distinct()
        of = lambda df: df["session"].eqNullSafe(F.col("_open"))
        sure = looked.join(open_, of(looked), "left_anti").select("session", "row", "i", F.col("_base").alias("fake"))
        made, fresh = vault.run(mentions.join(open_, of(mentions), "left_semi"), held.filter("part <> 'meta'").join(open_, of(held), "left_semi"), build)
        rows = fresh
        if messages is not None:
            seen = messages.groupBy("session").agg(F.count(F.lit(1)).alias("messages"))
            there = held.select("session").union(fresh.select("session")).distinct().withColumnRenamed("session", "_open")
            seen = seen.join(there, of(seen), "left_semi")
            counted = seen.select("session", F.explode(F.create_map(*[x for c, v in (("created_at", F.lit(now)), ("last_activity", F.lit(now)), ("messages", F.col("messages"))) for x in (F.lit(c), v.cast("long"))])).alias("name", "n"))
            rows = rows.unionByName(self._rows(counted, "meta", F.col("name"), F.col("n")))
        self.add(rows)
        return sure.unionByName(made)

    def forget(self, sessions: DataFrame) -> DataFrame:
        """(session, existed) of the named sessions, which have no state in the version that this makes."""
        named = sessions.select(F.col("session").cast("string").alias("session")).distinct()
        before = self.versions()
        n = self._put(self._rows(named, "gone", F.lit(""), F.lit(0)), "delta")
        # as the version holds it, so that what is returned doesn't depend on what is deleted later
        named = self.spark.read.schema(STATE).parquet(self._of(n, "delta")).select("session")
        if not before:
            return named.withColumn("existed", F.lit(False))
        there = self.state(before[-1]).rows.select(F.col("session").alias("_of")).distinct().withColumn("existed", F.lit(True))
        return named.join(there, named["session"].eqNullSafe(there["_of"]), "left").select("session", F.coalesce("existed", F.lit(False)).alias("existed"))

    def expire(self, idle: int, now: int | None = None) -> DataFrame:
        """`forget` of the sessions without activity for `idle` milliseconds."""
        now = int(time.time() * 1000) if now is None else now
        last = self.state().rows.filter("part = 'meta' and name = 'last_activity'")
        return self.forget(last.filter(F.col("n") + idle < now).select("session"))

    def compact(self) -> int:
        """One folder in place of all before it; reads of a version go on until `vacuum`."""
        return self._put(self.state().rows, "base")

    def vacuum(self) -> None:
        """Delete folders that the last state doesn't need, and those that were cut short."""
        needed, (_, fs) = set(self._layers()), self._fs()
        for n, kind, _ in self._folders():
            if (n, kind) not in needed:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._of(n, kind)), True)

    # -- views

    def summary(self) -> DataFrame:
        """session, created_at, last_activity (milliseconds), message_count, entity_count and entities_by_type."""
        state = self.state()
        meta = state.rows.filter("part = 'meta'").groupBy(F.col("session").alias("_of")).pivot("name", list(COUNTERS)).agg(F.first("n"))
        by = vault.summary(state)
        both = by.join(meta, by["session"].eqNullSafe(meta["_of"]), "left")
        return both.select("session", "created_at", "last_activity", F.coalesce("messages", F.lit(0)).alias("message_count"), "entity_count", "entities_by_type")

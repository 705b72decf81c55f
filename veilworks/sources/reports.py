"""Sinks of an evaluation: JSON, JSON lines and CSV with fixed columns; findings in real documents are redacted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"


def write_csv(df: DataFrame, path: str, *columns: str) -> None:
    df.select(*columns or df.columns).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def detection_csv(report: DataFrame, path: str) -> None:
    write_csv(report, path, "type", "tp", "fp", "fn", "precision", "recall", "f1", "support")


def latency_csv(stats: DataFrame, path: str, *by: str) -> None:
    write_csv(stats, path, *by, "p50", "p90", "p99", "mean", "n")


def restoration_csv(totals: DataFrame, path: str) -> None:
    write_csv(totals.withColumn("type", F.coalesce("type", F.lit("__all__"))), path, "type", "outcome", "n")


def redacted(leaks: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Leaks without the texts of real documents."""
    kind = docs.select(key, "source")
    real = F.col("source") == "real"
    hide = lambda c: F.when(real, REDACTED).otherwise(F.col(c)).alias(c)
    return leaks.join(kind, key, "left").select(key, "type", hide("original"), hide("form_found"), "start", "end", "match_mode")


def leaks_csv(leaks: DataFrame, docs: DataFrame, path: str) -> None:
    write_csv(redacted(leaks, docs), path)


def request_log(messages: DataFrame) -> DataFrame:
    """One JSON line for each session, without content: counts only."""
    by = messages.groupBy("session").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.size("entities")).alias("entities"))
    return by.select(F.to_json(F.struct("session", "messages", "entities")).alias("value"))


def access_log(requests: DataFrame) -> DataFrame:
    """One JSON line for each request, without content. Fields that a request lacks are null, others are left out.

    requests: rows with any of ts, session, endpoint (the route, without values of its parameters), status, provider,
    model, entities (spans of a chat request, of which only the number is written) and timing_ms (a struct or map).
    """
    given = set(requests.columns)
    plain = ("ts", "session", "endpoint", "status", "provider", "model")
    fields = [(F.col(c) if c in given else F.lit(None).cast("string")).alias(c) for c in plain]
    found = F.when(F.col("entities").isNotNull(), F.size("entities")) if "entities" in given else F.lit(None).cast("int")
    timing = F.col("timing_ms") if "timing_ms" in given else F.lit(None).cast("map<string,double>")
    return requests.select(F.to_json(F.struct(*fields, found.alias("entities_detected"), timing.alias("timing_ms")), {"ignoreNullFields": "false"}).alias("value"))

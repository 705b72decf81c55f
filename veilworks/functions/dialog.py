"""Small tables of the chat side: finish reasons, models and their providers, error states, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
FINISH = {"stop": "stop", "length": "length", "end_turn": "stop", "stop_sequence": "stop", "max_tokens": "length"}
PREFIXES = {"gpt-": "openai", "claude-": "anthropic", "ollama/": "ollama", "echo/": "echo"}
ERROR_STATUS = {"unreachable": 503, "missing_model": 503, "timeout": 504, "rate_limit": 429, "auth": 503, "unknown_model": 400}
ROLES = ("system", "user", "assistant")


def _lookup(c: Column, table: dict, other: object) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(other))


def finish_reason(raw: Column) -> Column:
    return _lookup(F.coalesce(raw, F.lit("")), FINISH, "stop")


def error_status(kind: Column) -> Column:
    return _lookup(kind, ERROR_STATUS, 500)


def provider(model: Column) -> Column:
    """The provider of a model's prefix; `unknown_model` if none fits."""
    out = None
    for prefix, name in PREFIXES.items():
        hit = F.startswith(model, F.lit(prefix))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown_model")


def sent_model(model: Column) -> Column:
    """One prefix is not part of the name that is sent."""
    return F.when(F.startswith(model, F.lit("ollama/")), F.substring(model, F.lit(8), F.length(model))).otherwise(model)


def bucket(value: Column, edges: list[int]) -> Column:
    """<first, a-b, >=last; edges are exclusive above."""
    out, previous = None, 0
    for edge in edges:
        label = f"{previous}-{edge - 1}" if previous else f"<{edge}"
        out = F.when(value < edge, label) if out is None else out.when(value < edge, label)
        previous = edge
    return F.lit(f">={previous}") if out is None else out.otherwise(f">={previous}")


def providers(spark: SparkSession, keys: dict[str, bool] | None = None) -> DataFrame:
    """The fixed table of providers; keys tells for which a key is configured."""
    keys = keys or {}
    rows = [(name, needs, bool(needs and keys.get(name))) for name, needs in (("openai", True), ("anthropic", True), ("ollama", False))]
    return spark.createDataFrame(rows, "name string, requires_key boolean, key_configured boolean")

"""Chat histories (session, turn, role, text): checks, merges, the last turn, and the whole round trip."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilworks.functions.dialog import ROLES
from veilworks.functions.surface import normalize
from veilworks.operators import spans as sp
from veilworks.operators import vault
from veilworks.operators.generate import Builder, generate
from veilworks.operators.rewrite import fuzzy_restore, restore, splice
from veilworks.operators.store import SessionStore
from veilworks.sources.shared import small_batches, written_sealed

SEPARATOR = "\n\n"


def validate(messages: DataFrame) -> DataFrame:
    """session and the first rule that it breaks, null if none: roles, text, a last turn of the user."""
    by = messages.groupBy("session").agg(
        F.bool_and(F.coalesce(F.col("role").isin(*ROLES), F.lit(False))).alias("roles"),
        F.bool_and(F.col("text").isNotNull()).alias("texts"),
        F.max_by("role", "turn").alias("last"),
    )
    return by.select("session", F.when(~F.col("roles"), "role").when(~F.col("texts"), "content").when(F.coalesce(F.col("last") != "user", F.lit(True)), "last_role").alias("violation"))


def last_user(messages: DataFrame) -> DataFrame:
    """session, turn and text of the latest user message."""
    return messages.filter("role = 'user'").groupBy("session").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def echo(messages: DataFrame) -> DataFrame:
    """session and answer: the last user message, or else the last message."""
    own = F.when(F.col("role") == "user", F.struct("turn", "text"))
    return messages.groupBy("session").agg(F.coalesce(F.max(own), F.max(F.struct("turn", "text"))).alias("m")).select("session", F.col("m.text").alias("answer"))


def merge_roles(messages: DataFrame) -> DataFrame:
    """session, system and turns: system texts lifted out and joined, and runs of one role made one message."""
    order = Window.partitionBy("session").orderBy("turn")
    talk = messages.filter("role <> 'system'").withColumn("_new", F.coalesce((F.lag("role").over(order) != F.col("role")).cast("int"), F.lit(1)))
    talk = talk.withColumn("_run", F.sum("_new").over(order))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", c))), lambda x: x[c]), SEPARATOR)
    return talk.groupBy("session", F.col("_run").alias("run"), "role").agg(joined("text").alias("content"))


def system_text(messages: DataFrame) -> DataFrame:
    rows = messages.filter("role = 'system'").groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("parts"))
    return rows.select("session", F.array_join("parts", SEPARATOR).alias("system"))


def counts_by_type(messages: DataFrame, spans: str = "entities") -> DataFrame:
    """session, entity_type and n over the whole history."""
    return messages.select("session", F.explode_outer(spans).alias("x")).filter("x is not null").groupBy("session", F.col("x.entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


def pseudonymize(messages: DataFrame, key: bytes, store: SessionStore | None = None, build: Builder = generate, **options: object) -> tuple[DataFrame, vault.State]:
    """Messages with entities, replacements and fake_text, and the state of the sessions.

    Texts are not shuffled to the sessions' tasks; only mentions are, as keyed hashes and sealed values, and their fakes
    come back by row. Messages are numbered and detected once and written, sealed, so that sessions and turns may be null
    or occur again. With a store its mappings hold on, and what is new is its next version, with the number of messages.
    """
    names = [f"m{i}" for i in range(len(messages.columns))]
    own = [F.col(f"`{c}`").alias(n) for c, n in zip(messages.columns, names, strict=True)]
    seen = sp.detect(messages, out="_entities", **options)  # options may name columns of the messages
    numbered = seen.select(*own, F.col("session").cast("string").alias("session"), "turn", F.col("_entities").alias("entities"), F.monotonically_increasing_id().alias("row"))
    # the text is a column of the message, and is kept once
    place = names[messages.columns.index("text")]
    found = written_sealed(numbered, "spans", key, clear=("session", *[n for c, n in zip(messages.columns, names, strict=True) if c in ("session", "role")]))
    seen = vault.mentions(found, key)
    if store is None:
        fakes, rows = vault.run(seen, build=build)
        state = vault.State(rows, key)
    else:
        fakes = store.assign(seen, found.select("session"), build=build)
        state = store.state()
    per = fakes.groupBy(F.col("row").alias("of_row")).agg(F.array_sort(F.collect_list(F.struct("i", "fake"))).alias("_fakes"))
    columns = ["session" if c == "session" else F.col(n).alias(c) for c, n in zip(messages.columns, names, strict=True)]
    both = found.join(per, found["row"] == per["of_row"], "left").withColumn("_text", F.col(place))
    put = F.expr("transform(entities, (x, i) -> named_struct('entity_type', x.entity_type, 'original', x.text, 'fake', _fakes[i].fake, 'start', x.start, 'end', x.end))")
    both = both.withColumn("replacements", put).withColumn("fake_text", splice("_text", "replacements"))
    return both.select(*columns, "entities", "replacements", "fake_text"), state


def depseudonymize(texts: DataFrame, state: vault.State, text: str = "text", out: str = "restored", fuzzy: bool = False) -> DataFrame:
    """Adds `out` to (session, text): originals put back, exactly or also for words near to a name's forms."""
    small_batches(texts.sparkSession)
    forms = vault.restorations(state).withColumnRenamed("session", "_of")
    full = texts.join(forms, F.col("session").cast("string").eqNullSafe(F.col("_of")), "left").drop("_of")
    full = full.withColumn(out, restore(text, "forms")).drop("forms")
    return fuzzy_restore(full, vault.name_tokens(state), out) if fuzzy else full


def round_trip(messages: DataFrame, key: bytes, provider: Callable[[DataFrame], DataFrame] = echo, **options: object) -> DataFrame:
    """session, sent (what the provider answers), answer (restored) and total entities.

    provider: from (session, turn, role, text), in which originals are hidden, to (session, answer); the echo gives back
    the last user message.
    """
    hidden, state = pseudonymize(messages, key, **options)
    answer = provider(hidden.select("session", "turn", "role", F.col("fake_text").alias("text"))).withColumnRenamed("answer", "text")
    totals = hidden.groupBy("session").agg(F.sum(F.size("entities")).cast("long").alias("entities"))
    back = depseudonymize(answer, state, out="answer", fuzzy=True).withColumnRenamed("text", "sent")
    totals = totals.withColumnRenamed("session", "_of")
    return back.join(totals, back["session"].eqNullSafe(totals["_of"])).drop("_of")


def same_text(a: Column, b: Column) -> Column:
    return normalize(a) == normalize(b)

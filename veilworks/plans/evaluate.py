"""A whole evaluation of a gold corpus: detect, pseudonymize, send to the echo provider, restore, and score all of it.

Every document is a session of its own, so the plan is partitioned by document. Scorers see gold, texts and declared
fakes only, never the detector's own idea of what is true.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilworks.functions.crypto import fresh_key
from veilworks.operators import conversation as chat
from veilworks.operators import scoring, spans
from veilworks.sources import reports
from veilworks.sources.shared import written_sealed

EXIT_OK, EXIT_LEAK, EXIT_EMPTY, EXIT_USAGE = 0, 1, 2, 3


@dataclass
class Evaluation:
    detection: dict[str, DataFrame]  # by policy
    confusion: dict[str, DataFrame]
    errors: DataFrame
    unmapped: DataFrame
    leaks: DataFrame
    restoration: DataFrame
    restoration_totals: DataFrame
    exact_rate: DataFrame
    answers: DataFrame  # doc_id, leak_free, reconstructed
    stats: DataFrame
    version: DataFrame
    documents: DataFrame

    def exit_code(self) -> int:
        """2 for an empty corpus, 1 for any leak, else 0."""
        if not self.documents.limit(1).count():
            return EXIT_EMPTY
        return EXIT_LEAK if self.leaks.limit(1).count() else EXIT_OK

    def write(self, path: str) -> None:
        """The fixed tables of a run below path."""
        for policy, report in self.detection.items():
            reports.detection_csv(report, f"{path}/detection-{policy}")
        reports.leaks_csv(self.leaks, self.documents, f"{path}/leaks")
        reports.restoration_csv(self.restoration_totals, f"{path}/restoration")
        reports.write_json(self.restoration, f"{path}/documents")
        summary = self.stats.join(self.version, how="cross").join(self.exact_rate, how="cross").join(scoring.answer_summary(self.answers), how="cross")  # one row each
        reports.write_json(summary, f"{path}/aggregate")


def evaluate(docs: DataFrame, key: bytes | None = None, **options: object) -> Evaluation:
    """docs: gold documents (doc_id, source, text, entities). Without a key fakes are drawn, and values sealed, by a new one."""
    key = fresh_key() if key is None else key
    messages = docs.select(F.col("doc_id").alias("session"), F.lit(1).alias("turn"), F.lit("user").alias("role"), "text")
    hidden, state = chat.pseudonymize(messages, key, **options)
    hidden = written_sealed(hidden.select("session", "entities", "replacements", "fake_text"), "hidden", key, clear=("session",))
    kind = "array<struct<type:string,start:int,end:int,text:string>>"
    seen = hidden.select(
        F.col("session").alias("doc_id"), "fake_text", F.transform("replacements", lambda r: r["fake"]).alias("fakes"),
        F.transform("entities", lambda x: F.struct(spans.canonical(x["entity_type"]).alias("type"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["entity_type"].alias("label"))).alias("found"),
    )
    rows = docs.select("doc_id", "source", F.col("entities").alias("gold")).join(seen, "doc_id")
    mapped = F.filter("found", lambda x: x["type"].isNotNull())
    rows = rows.withColumn("predicted", F.transform(mapped, lambda x: F.struct(x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))).cast(kind))
    unmapped = rows.select("doc_id", F.explode_outer(F.filter("found", lambda x: x["type"].isNull())).alias("x")).filter("x is not null").select("doc_id", F.concat("x.label", F.lit("@"), F.col("x.start").cast("string")).alias("line"))
    aligned = {p: scoring.align(rows, policy=p) for p in ("overlap", "exact")}
    found = {p: scoring.outcomes(a) for p, a in aligned.items()}
    odd = unmapped.count()
    back = chat.depseudonymize(seen.select(F.col("doc_id").alias("session"), "fake_text"), state, text="fake_text")
    echoed = chat.echo(seen.select(F.col("doc_id").alias("session"), F.lit(1).alias("turn"), F.lit("user").alias("role"), F.col("fake_text").alias("text")))
    echoed = chat.depseudonymize(echoed, state, text="answer", out="restored", fuzzy=True)
    restored = docs.select("doc_id", F.col("entities").alias("gold")).join(back.select(F.col("session").alias("doc_id"), "restored"), "doc_id")
    details = scoring.restoration(restored)
    totals, rate = scoring.restoration_totals(details)
    leaked = scoring.leaks(rows.withColumnRenamed("fake_text", "outbound"), fakes="fakes")
    answered = docs.select("doc_id", F.col("entities").alias("gold")).join(echoed.select(F.col("session").alias("doc_id"), "restored"), "doc_id")
    answers = answered.select("doc_id", scoring.reconstructs(F.transform("gold", lambda x: x["text"]), F.col("restored")).alias("reconstructed"))
    answers = answers.join(leaked.select("doc_id").distinct().withColumn("leaked", F.lit(True)), "doc_id", "left").select("doc_id", F.col("leaked").isNull().alias("leak_free"), "reconstructed")
    return Evaluation(
        {p: scoring.detection_report(f, odd) for p, f in found.items()}, {p: scoring.confusion(a, unmapped=odd) for p, a in aligned.items()}, scoring.error_spans(found["overlap"]), unmapped,
        leaked, details, totals, rate, answers, scoring.corpus_stats(docs), scoring.corpus_hash(docs), docs,
    )

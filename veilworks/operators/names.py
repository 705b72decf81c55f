"""Names in inflected texts: an index of the forms of base names, and the case of a form from what stands before it.

Declension is only ever generated: `form_index` makes of each base name, and of each of its words, all forms, and groups
them by form, with the cases that each may be. `names_in_texts` joins runs of capitalized words of whole texts with the
index. A form that may be several cases, or of several names, is settled by what the word before it asks for: a preposition
or a form of a title. Without such a word, or if none of its cases fits, the first case in the order of CASES holds.

Cases: a null or empty text has no names; a null or empty base gives no forms; bases that occur again are one; a form that
two names share goes to the one that fits what stands before it, then to the one named by more words, then to the lesser
lemma. The planner chooses the join by the index's size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilworks.functions.declension import CASES, decline_col, pattern_col
from veilworks.functions.surface import collapse
from veilworks.operators.spans import META, NAME_SCORE, SPAN, words_of

#: Cases that a word asks of the name behind it, the likelier first.
ASKS = {
    "do": ("gen",), "od": ("gen",), "bez": ("gen",), "dla": ("gen",), "u": ("gen",), "obok": ("gen",), "wobec": ("gen",),
    "ku": ("dat",), "dzięki": ("dat",), "przeciw": ("dat",), "przez": ("acc",), "za": ("acc", "ins"),
    "nad": ("ins",), "pod": ("ins",), "przed": ("ins",), "między": ("ins",), "z": ("ins", "gen"), "ze": ("ins", "gen"),
    "w": ("loc",), "we": ("loc",), "na": ("loc", "acc"), "o": ("loc",), "po": ("loc",), "przy": ("loc",),
    "pan": ("nom",), "pana": ("gen", "acc"), "panu": ("dat", "loc"), "panem": ("ins",), "panią": ("acc", "ins"), "pani": ("nom", "gen", "dat", "loc"),
}


def _forms(base: Column, gender: Column, kind: str) -> Column:
    """Array of (case, form): each word of the base declined by its own pattern."""
    words = F.split(base, " ")
    return F.array(*[F.struct(F.lit(case).alias("case"), F.array_join(F.transform(words, _declined(case, gender, kind)), " ").alias("form")) for case in CASES])


def _declined(case: str, gender: Column, kind: str) -> Callable[[Column], Column]:
    return lambda w: decline_col(w, pattern_col(w, gender, kind), case)


def form_index(bases: DataFrame) -> DataFrame:
    """form (lower-cased), entity_type, lemma, gender, words and cases, from base names (base, entity_type, gender)."""
    clean = bases.select(collapse(F.col("base")).alias("base"), "entity_type", F.col("gender").cast("string").alias("gender")).filter("base <> ''").distinct()
    parts = F.split("base", " ")
    # a person is also named by a part of the name
    named = clean.select("entity_type", "gender", F.explode(F.array_distinct(F.when((F.col("entity_type") == "PERSON") & (F.size(parts) > 1), F.concat(F.array("base"), parts)).otherwise(F.array("base")))).alias("base")).distinct()
    forms = F.when(F.col("entity_type") == "LOCATION", _forms(F.col("base"), F.col("gender"), "city")).otherwise(_forms(F.col("base"), F.col("gender"), "person"))
    rows = named.select("entity_type", "gender", F.lower("base").alias("lemma"), F.size(F.split("base", " ")).alias("words"), F.explode(forms).alias("x"))
    order = F.array(*[F.lit(c) for c in CASES])
    by = rows.groupBy(F.lower("x.form").alias("form"), "entity_type", "lemma", "words").agg(F.min("gender").alias("gender"), F.collect_set("x.case").alias("_cases"))
    return by.select("form", "entity_type", "lemma", "gender", "words", F.filter(order, lambda c: F.array_contains("_cases", c)).alias("cases"))


def names_in_texts(df: DataFrame, index: DataFrame, key: str, text: str = "text", words: int = 3) -> DataFrame:
    """key and names: array of SPAN with lemma, case and gender, for texts in which there is a form of the index.

    Only runs of capitalized words, with nothing but spaces between them, are exploded; texts are not shuffled.
    """
    runs = words_of(text, words)
    grams = df.select(F.col(key).alias("_key"), F.explode(runs).alias("r")).select("_key", F.col("r.s").alias("s"), F.col("r.surface").alias("surface"), F.col("r.before").alias("before"), F.lower(F.regexp_replace("r.surface", r"(?U)\s+", " ")).alias("form"))
    asked = F.coalesce(F.try_element_at(F.create_map(*[x for w, cases in ASKS.items() for x in (F.lit(w), F.array(*[F.lit(c) for c in cases]))]), F.lower("before")), F.array().cast("array<string>"))
    hit = grams.join(index, "form").withColumn("_fit", F.filter(asked, lambda c: F.array_contains("cases", c)))
    case = F.when(F.size("_fit") > 0, F.col("_fit")[0]).otherwise(F.col("cases")[0])
    choice = F.struct((F.size("_fit") == 0).alias("odd"), (-F.col("words")).alias("words"), "lemma", "entity_type", case.alias("case"), "gender")
    best = hit.groupBy("_key", "s", "surface").agg(F.min(choice).alias("b"))
    meta = F.struct(*[(F.col("b.gender") if m == "gender" else F.lit(None)).alias(m) for m in META])
    span = F.struct(F.col("b.entity_type").alias("entity_type"), F.col("s").alias("start"), (F.col("s") + F.length("surface")).alias("end"), F.lit(NAME_SCORE).alias("score"), F.col("surface").alias("text"), meta.alias("metadata"), F.col("b.lemma").alias("lemma"), F.col("b.case").alias("case")).cast(SPAN)
    return best.groupBy(F.col("_key").alias(key)).agg(F.collect_list(span).alias("names"))

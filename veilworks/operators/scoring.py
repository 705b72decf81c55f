"""Scores of a run against a gold standard: alignment, detection, confusion, leaks, restoration, latency, answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from veilworks.functions import surface as su
from veilworks.operators.rewrite import mask_values
from veilworks.operators.spans import CANONICAL, STRUCTURED

NUMERIC = ("PESEL", "NIP", "REGON", "BANK_ACCOUNT", "PHONE_NUMBER")
WHOLE = ("EMAIL_ADDRESS", "DATE_TIME")
MISS, SPURIOUS = "MISS", "SPURIOUS"
FUZZY = 0.8

# ---------------------------------------------------------------- alignment


Spans = tuple[list[int], list[int], list[str]]


def _candidates(gold: Spans, predicted: Spans, by_type: bool) -> list[tuple[int, int, int]]:
    """(-overlap, g, p) of all pairs that overlap: one sweep by start over both sides, for each type if it counts.

    Each side keeps the spans that have not ended; those that stay all overlap the span that comes, so that the sweep
    costs the sort and the pairs.
    """
    out = []
    events: dict[str, list[tuple[int, int, int, int]]] = {}
    for side, (starts, ends, kinds) in enumerate((gold, predicted)):
        for i, (start, end, kind) in enumerate(zip(starts, ends, kinds, strict=True)):
            if end > start:
                events.setdefault(kind if by_type else "", []).append((start, side, i, end))
    for found in events.values():
        found.sort()
        alive: list[list[tuple[int, int]]] = [[], []]
        for start, side, i, end in found:
            other = [(e, j) for e, j in alive[1 - side] if e > start]
            alive[1 - side] = other
            for e, j in other:
                out.append((start - min(e, end), i, j) if side == 0 else (start - min(e, end), j, i))
            alive[side].append((end, i))
    return out


def _equal_places(gold: Spans, predicted: Spans, by_type: bool) -> list[tuple[int, int, int]]:
    """(-length, g, p) of spans of one place: the first of gold with the first of predicted, and so on."""
    there: dict[tuple, list[int]] = {}
    for p, (start, end, kind) in enumerate(zip(*predicted, strict=True)):
        there.setdefault((start, end, kind if by_type else ""), []).append(p)
    at = dict.fromkeys(there, 0)
    out = []
    for g, (start, end, kind) in enumerate(zip(*gold, strict=True)):
        key = (start, end, kind if by_type else "")
        if key in there and at[key] < len(there[key]):
            out.append((start - end, g, there[key][at[key]]))
            at[key] += 1
    return out


def matched(gold: Spans, predicted: Spans, policy: str = "overlap", by_type: bool = True) -> list[tuple[int, int, int]]:
    """(g, p, overlap) one to one: by overlap from the greatest and then by places."""
    pairs = sorted(_equal_places(gold, predicted, by_type) if policy == "exact" else _candidates(gold, predicted, by_type))
    used_g, used_p, out = bytearray(len(gold[0])), bytearray(len(predicted[0])), []
    for o, g, p in pairs:
        if not used_g[g] and not used_p[p]:
            used_g[g] = used_p[p] = 1
            out.append((g, p, -o))
    return out


def align(docs: DataFrame, gold: str = "gold", predicted: str = "predicted", policy: str = "overlap", by_type: bool = True) -> DataFrame:
    """Adds pairs: array of (g, p, overlap), places in both arrays of (type, start, end, text), one to one.

    Greedy, by overlap from the greatest and then by places; a sweep finds the pairs that overlap. A document's spans are
    an array of its own row, and nothing is shuffled. Null arrays have no spans; spans of no length overlap none.
    """
    pair = StructType([StructField(c, IntegerType()) for c in ("g", "p", "overlap")])

    def run(gs: pd.Series, ge: pd.Series, gt: pd.Series, ps: pd.Series, pe: pd.Series, pt: pd.Series) -> pd.Series:
        side = lambda *x: tuple([] if v is None else list(v) for v in x)
        return pd.Series([[{"g": g, "p": p, "overlap": int(o)} for g, p, o in matched(side(*row[:3]), side(*row[3:]), policy, by_type)] for row in zip(gs, ge, gt, ps, pe, pt, strict=True)], dtype=object)

    run.__annotations__ = {c: pd.Series for c in ("gs", "ge", "gt", "ps", "pe", "pt", "return")}
    fields = [F.expr(f"transform({side}, x -> x.{c})") for side in (gold, predicted) for c in ("start", "end", "type")]
    return docs.withColumn("pairs", pandas_udf(run, ArrayType(pair))(*fields))


def _rest(spans: str, side: str, pairs: str = "pairs") -> str:
    """SQL: the spans that no pair holds, in order."""
    return f"transform(array_except(if(size({spans}) > 0, sequence(0, size({spans}) - 1), cast(array() as array<int>)), transform({pairs}, z -> z.{side})), i -> {spans}[i])"


def outcomes(docs: DataFrame, key: str = "doc_id", gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """One row for each pair, each gold span without one (fn) and each predicted span without one (fp)."""
    rows = f"""concat(
        transform(pairs, z -> named_struct('match_kind', if({gold}[z.g].start = {predicted}[z.p].start and {gold}[z.g].end = {predicted}[z.p].end, 'exact', 'overlap'), 'gold', {gold}[z.g], 'predicted', {predicted}[z.p])),
        transform({_rest(gold, "g")}, x -> named_struct('match_kind', 'fn', 'gold', x, 'predicted', cast(null as struct<type:string,start:int,end:int,text:string>))),
        transform({_rest(predicted, "p")}, y -> named_struct('match_kind', 'fp', 'gold', cast(null as struct<type:string,start:int,end:int,text:string>), 'predicted', y)))"""
    return docs.select(key, F.explode(F.expr(rows)).alias("r")).select(key, "r.*")


def rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0 where nothing is to be divided, rounded to 4 places."""
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = part(tp, tp + fp), part(tp, tp + fn)
    return F.round(p, 4), F.round(r, 4), F.round(part(2 * p * r, p + r), 4)


def detection_counts(found: DataFrame, types: tuple[str, ...] = CANONICAL) -> DataFrame:
    """type, tp, fp, fn and support for every type, also those that don't occur."""
    kind = F.coalesce(F.col("gold.type"), F.col("predicted.type")).alias("type")
    hit = F.col("match_kind").isin("exact", "overlap")
    count = lambda c, name: F.sum(c.cast("long")).alias(name)
    by = found.select(kind, hit.alias("tp"), (F.col("match_kind") == "fp").alias("fp"), (F.col("match_kind") == "fn").alias("fn")).groupBy("type").agg(count(F.col("tp"), "tp"), count(F.col("fp"), "fp"), count(F.col("fn"), "fn"))
    base = found.sparkSession.createDataFrame([(t,) for t in types], "type string")
    return base.join(by, "type", "left").na.fill(0, ["tp", "fp", "fn"]).withColumn("support", F.col("tp") + F.col("fn"))


def detection_report(found: DataFrame, unmapped: int = 0, types: tuple[str, ...] = CANONICAL) -> DataFrame:
    """Per type, __micro__ (with unmapped labels as false positives) and __macro__ (over types with support)."""
    counts = detection_counts(found, types)
    p, r, f = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    per = counts.select("type", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"), "support")
    total = counts.agg(F.sum("tp").alias("tp"), (F.sum("fp") + F.lit(unmapped)).alias("fp"), F.sum("fn").alias("fn"))
    micro = total.select(F.lit("__micro__").alias("type"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))
    mean = lambda c: F.coalesce(F.round(F.avg(c), 4), F.lit(0.0)).alias(c)
    zero = lambda c: F.lit(0).cast("long").alias(c)
    macro = per.filter("support > 0").agg(mean("precision"), mean("recall"), mean("f1"), F.coalesce(F.sum("support"), F.lit(0)).alias("support"))
    macro = macro.select(F.lit("__macro__").alias("type"), zero("tp"), zero("fp"), zero("fn"), "precision", "recall", "f1", "support")
    return per.unionByName(micro).unionByName(macro)


def confusion(docs: DataFrame, key: str = "doc_id", gold: str = "gold", predicted: str = "predicted", unmapped: int = 0) -> DataFrame:
    """(gold, predicted, n): matches on the diagonal; leftovers that overlap whatever their type beside it; the rest in
    MISS and SPURIOUS."""
    left = docs.withColumn("_g", F.expr(_rest(gold, "g"))).withColumn("_p", F.expr(_rest(predicted, "p")))
    crossed = align(left.withColumnRenamed("pairs", "_first"), "_g", "_p", by_type=False)
    cells = f"""concat(
        transform(_first, z -> named_struct('gold', {gold}[z.g].type, 'predicted', {gold}[z.g].type)),
        transform(pairs, z -> named_struct('gold', _g[z.g].type, 'predicted', _p[z.p].type)),
        transform({_rest("_g", "g")}, x -> named_struct('gold', x.type, 'predicted', '{MISS}')),
        transform({_rest("_p", "p")}, y -> named_struct('gold', '{SPURIOUS}', 'predicted', y.type)))"""
    out = crossed.select(F.explode(F.expr(cells)).alias("c")).groupBy("c.gold", "c.predicted").agg(F.count(F.lit(1)).alias("n"))
    if unmapped:
        out = out.unionByName(docs.sparkSession.createDataFrame([(SPURIOUS, MISS, unmapped)], "gold string, predicted string, n long"))
    return out


def confusion_grid(cells: DataFrame) -> DataFrame:
    """All cells, those that don't occur with 0: each type and MISS, against each type and SPURIOUS."""
    spark = cells.sparkSession
    labels = [(g, p) for g in (*CANONICAL, MISS, SPURIOUS) for p in (*CANONICAL, MISS, SPURIOUS)]
    return spark.createDataFrame(labels, "gold string, predicted string").join(cells, ["gold", "predicted"], "left").na.fill(0, ["n"])


def error_spans(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, kind and a line for each: TYPE: text for what was missed, TYPE@start for what was made up."""
    line = F.when(F.col("match_kind") == "fn", F.concat("gold.type", F.lit(": "), "gold.text")).otherwise(F.concat("predicted.type", F.lit("@"), F.col("predicted.start").cast("string")))
    return found.filter(F.col("match_kind").isin("fn", "fp")).select(key, "match_kind", line.alias("line"))


# ---------------------------------------------------------------- words that may stand for an original


def _longest_word(name: str) -> Column:
    """The first of the longest words of the named column; null if it has none."""
    return F.expr(rf"aggregate(regexp_extract_all({name}, r'(?U)\w+', 0), cast(null as string), (b, w) -> if(b is null or length(w) > length(b), w, b))")


def near_words(text: Column, target: Column, least: float | None = None) -> Column:
    """The words of the text, in order, that share a stem with the target, or are as alike as `least`, and perhaps a few more.

    Few words of a text are, so that stems and likeness, which cost many steps a word, are left to what this lets through. It
    is exact in what it drops: words of a shared stem, and short words that are equal, begin with the same STEM letters in
    normal form; words as alike as `least` differ in no more letters than that share of the longer, nor in length.
    Words hold no spaces, so their normal form is that in lower case, with Polish letters composed.
    """
    held = F.struct(text.alias("t"), su.has_marks(text).alias("marks"), su.normalize(target).alias("own"))

    def of(h: Column) -> Column:
        own, n = h["own"], F.length(h["own"])
        head = F.substring(own, 1, su.STEM)

        def near(w: Column) -> Column:
            low = F.lower(F.when(h["marks"], su.composed_polish(w)).otherwise(w))
            out = F.startswith(low, head)
            if least is None:
                return out
            # in whole numbers, for hundredths of `least`, so that rounding drops none
            gap = lambda d: 100 * d <= (100 - int(100 * least)) * F.greatest(F.length(low), n)
            return out | (gap(F.abs(F.length(low) - n)) & gap(F.levenshtein(low, own)))

        return F.filter(su.tokens(h["t"]), near)

    return F.transform(F.array(held), of)[0]


# ---------------------------------------------------------------- leaks


def leaks(docs: DataFrame, key: str = "doc_id", gold: str = "gold", text: str = "outbound", fakes: str | None = None) -> DataFrame:
    """key, type, original, form_found, start, end, match_mode of originals that survive in the outbound text.

    A surviving surface counts once for its type: of findings with one type and place the first in gold order stays.
    """
    if fakes is not None:
        docs = docs.withColumn("_text", mask_values(text, fakes))
    else:
        docs = docs.withColumn("_text", F.col(text))
    # what is asked of a text is made of it once, before its originals are dealt out; an original that comes again is found at the same place
    spaced = F.exists(gold, lambda x: ~F.coalesce(x["type"].isin(*NUMERIC), F.lit(False)))
    once = F.array_distinct(F.transform(gold, lambda x: F.struct(x["type"].alias("type"), x["text"].alias("original"))))
    docs = docs.select(key, "_text", once.alias("_once"), F.lower("_text").alias("_low"), F.when(spaced, su.normalize(F.col("_text"))).alias("_norm"))
    rows = docs.select(key, "_text", "_low", "_norm", F.posexplode("_once").alias("ord", "x")).select(key, "_text", "_low", "_norm", "ord", "x.*")
    low, norm, own = F.col("_low"), F.col("_norm"), su.normalize(F.col("original"))
    digits, own_digits = su.digits_only(F.col("_text")), su.digits_only(F.col("original"))
    at = F.instr(low, F.lower("original")) - 1
    place = lambda a, n: (F.when(a >= 0, a).otherwise(0).alias("start"), F.when(a >= 0, a + n).otherwise(0).alias("end"))
    finding = lambda form, start, end, mode: F.struct(form.alias("form_found"), start.cast("int").alias("start"), end.cast("int").alias("end"), mode.alias("match_mode"))
    length = F.length("original")
    s, e = place(at, length)
    number = F.when((own_digits != "") & F.contains(digits, own_digits), finding(F.when(at >= 0, F.col("original")).otherwise(own_digits), s, e, F.lit("exact_id")))
    whole = F.when(F.contains(norm, own), finding(F.col("original"), s, e, F.lit("exact")))
    # free text: the word around a verbatim hit, a word of the same stem, or the form without diacritics
    before = F.length(F.regexp_extract(F.reverse(F.substring("_text", F.lit(1), F.greatest(at, F.lit(0)))), r"(?U)^\w*", 0))
    after = F.length(F.regexp_extract(F.substring("_text", at + 1 + length, F.length("_text")), r"(?U)^\w*", 0))
    word = F.substring("_text", at - before + 1, before + length + after)
    alone = su.normalize(word) == own
    short = F.length(own) < su.STEM
    verbatim = F.when(F.contains(norm, own) & (at >= 0) & (~short | alone), finding(word, at - before, at + length + after, F.when(alone, "exact").otherwise("stem")))
    kind = F.col("type")
    free = ~F.coalesce(kind.isin(*NUMERIC, *WHOLE), F.lit(False))
    rows = rows.withColumn("_target", F.coalesce(_longest_word("original"), F.col("original"))).withColumn("_verbatim", F.when(free, verbatim))
    # words are only read where they decide
    rows = rows.withColumn("_near", near_words(F.when(free & ~short & F.col("_verbatim").isNull(), F.col("_text")), F.col("_target")))
    like = F.try_element_at(F.filter("_near", lambda w: su.stems_shared(w, F.col("_target"))), F.lit(1))
    rows = rows.withColumn("_like", F.when(F.size("_near") > 0, like))
    like = F.col("_like")
    there = F.instr(low, F.lower(like)) - 1
    ls, le = place(there, F.length(like))
    stemmed = F.when(~short & (F.length(su.normalize(F.col("_target"))) >= su.STEM) & like.isNotNull(), finding(like, ls, le, F.lit("stem")))
    folded = su.fold_diacritics(F.col("original"))
    plain = F.when(~short & F.contains(F.translate(norm, *su.DIACRITICS), folded), finding(folded, F.lit(0), F.lit(0), F.lit("diacritic_fold")))
    got = F.when(kind.isin(*NUMERIC), number).when(kind.isin(*WHOLE), whole).otherwise(F.coalesce(F.col("_verbatim"), stemmed, plain))
    hits = rows.select(key, "ord", "type", "original", got.alias("f")).filter("f is not null").select(key, "ord", "type", "original", "f.*")
    first = F.min(F.struct("ord", "original", "form_found", "match_mode")).alias("m")
    return hits.groupBy(key, "type", "start", "end").agg(first).select(key, "type", "m.original", "m.form_found", "start", "end", "m.match_mode")


def leak_totals(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """by ('type', 'doc' or 'all'), name and n, in one pass."""
    kind = F.when(F.grouping("type") == 0, "type").when(F.grouping(key) == 0, "doc").otherwise("all")
    rows = found.withColumn(key, F.col(key).cast("string")).groupingSets([["type"], [key], []], "type", key).agg(kind.alias("by"), F.coalesce("type", key, F.lit("")).alias("name"), F.count(F.lit(1)).alias("n"))
    return rows.select("by", "name", "n")


# ---------------------------------------------------------------- restoration


def restoration(docs: DataFrame, key: str = "doc_id", gold: str = "gold", text: str = "restored") -> DataFrame:
    """key, type, original, outcome, surface and in_place for each gold entity of a restored text."""
    rows = docs.select(key, F.col(text).alias("_t"), F.explode(gold).alias("x")).select(key, "_t", "x.type", "x.start", "x.end", F.col("x.text").alias("original"))
    at_place = F.substring("_t", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("original")
    quoted = F.regexp_replace("original", r"([^\p{L}\p{N}\s])", r"\\$1")
    whole = F.regexp_like("_t", F.concat(F.lit(r"(?U)(?<!\w)"), quoted, F.lit(r"(?!\w)")))
    digits = su.digits_only(F.col("original"))
    rows = rows.withColumn("_exact", at_place | whole).withColumn("_target", F.coalesce(_longest_word("original"), F.col("original")))
    # words are only read where they decide
    asked = F.when(F.col("_exact") | F.col("type").isin(*STRUCTURED), F.lit(None)).otherwise(F.col("_t"))
    rows = rows.withColumn("_words", near_words(asked, F.col("_target"), FUZZY))
    stem_hit = F.try_element_at(F.filter("_words", lambda w: su.stems_shared(w, F.col("_target"))), F.lit(1))
    # the best of the others, the first of equals
    best = F.array_max(F.transform("_words", lambda w, i: F.struct(su.similarity(w, F.col("_target")).alias("r"), (-i).alias("i"), w.alias("w"))))
    rows = rows.withColumn("_cand", F.when(F.size("_words") > 0, F.coalesce(stem_hit, F.when(best["r"] >= FUZZY, best["w"]))))
    c, t = su.normalize(F.col("_cand")), su.normalize(F.col("_target"))
    free = (
        F.when(F.col("_cand").isNull(), "missed")
        .when((c == t) | (su.fold_diacritics(F.col("_cand")) == su.fold_diacritics(F.col("_target"))), "correct_inflection")
        .when(F.startswith(t, c) & (F.length(c) < F.length(t)), "base_form_only")
        .when(su.stems_shared(F.col("_cand"), F.col("_target")), "correct_inflection")
        .otherwise("fuzzy_recovered")
    )
    number = F.when((digits != "") & F.contains(su.digits_only(F.col("_t")), digits), "exact").otherwise("missed")
    outcome = F.when(F.col("_exact"), "exact").when(F.col("type").isin(*STRUCTURED), number).otherwise(free)
    shown = F.when(outcome == "exact", F.col("original")).when(outcome != "missed", F.col("_cand"))
    return rows.select(key, "type", "original", outcome.alias("outcome"), shown.alias("surface"), at_place.alias("in_place"))


def restoration_totals(details: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(type, outcome, n), type null for all, and (rate): the share of documents restored exactly, in place."""
    by = details.rollup("outcome", "type").agg(F.count(F.lit(1)).alias("n"), F.grouping("outcome").alias("_all")).filter("_all = 0").drop("_all")
    whole = details.groupBy(key).agg(F.bool_and((F.col("outcome") == "exact") & F.col("in_place")).alias("ok"))
    return by, whole.agg(F.coalesce(F.round(F.avg(F.col("ok").cast("double")), 4), F.lit(0.0)).alias("rate"))


# ---------------------------------------------------------------- latency and answers


QUANTILES = (0.5, 0.9, 0.99)
SKETCH = 10000  # ranks of a sketch are off by one part of this at most
EXACT_ROWS = 10 * SKETCH  # below this many values a band is all of a group, since rounding of ranks weighs more than the sketch


def latency(samples: DataFrame, *by: str, ms: str = "ms") -> DataFrame:
    """p50, p90, p99, mean and n of each group, exact, interpolated at p * (n - 1), rounded to 3 places.

    A sketch of each group gives a band of values around each percentile; values below a band are only counted, and
    equal values within it are counted before they are put in order. A task so orders the distinct values of a band,
    about four in SKETCH of a large group. Groups may be null; null values don't count; a group without values has nulls.
    """
    keys, value, places = [f"_k{i}" for i in range(len(by))], F.col("_v"), range(len(QUANTILES))
    rows = samples.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(ms).cast("double").alias("_v"))
    ends = [max(0.0, q - 2 / SKETCH) for q in QUANTILES] + [min(1.0, q + 2 / SKETCH) for q in QUANTILES]
    groups = rows.groupBy(*keys).agg(F.percentile_approx("_v", ends, SKETCH).alias("_ends"), F.round(F.avg("_v"), 3).alias("mean"), F.count("_v").alias("n"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys] or [F.lit(True)]
    one = [f"r.{k}" for k in keys]

    ends_of = groups.select(*keys, "n", F.when(F.col("n") >= EXACT_ROWS, F.col("_ends")).alias("_ends"))
    held = rows.filter("_v is not null").alias("r").join(ends_of.alias("g"), same).select(*one, "_v", "n", "_ends")
    side = [F.coalesce(F.when(value < F.col("_ends")[i], -1).when(value > F.col("_ends")[i + len(QUANTILES)], 1), F.lit(0)) for i in places]
    held = held.select(*keys, "n", "_v", F.array(*side).alias("_side"))
    counted = held.groupBy(*keys, "n", "_side", F.when(F.array_contains("_side", 0), value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))

    # of each percentile, all values below its band become one row without a value, which comes first
    targets = F.array(*[F.struct(F.lit(i).alias("i"), F.col("_side")[i].alias("side"), F.lit(q).alias("q")) for i, q in enumerate(QUANTILES)])
    band = counted.select("*", F.explode(targets).alias("t")).filter("t.side <= 0")
    band = band.groupBy(*keys, "t.i", (F.col("t.q") * (F.col("n") - 1)).alias("_at"), F.when(F.col("t.side") == 0, value).alias("_v")).agg(F.sum("_n").alias("_n"))
    ranked = band.withColumn("_to", F.sum("_n").over(Window.partitionBy(*keys, "i", "_at").orderBy(value.asc_nulls_first())))
    at = lambda rank: F.min(F.when(value.isNotNull() & (F.col("_to") > rank), value))
    found = ranked.groupBy(*keys, "i", "_at").agg(at(F.floor("_at")).alias("_low"), at(F.ceil("_at")).alias("_high"))
    found = found.withColumn("_p", F.round(F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at")), 3))
    names = [f"p{round(q * 100)}" for q in QUANTILES]
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("_p"))).alias(names[i]) for i in places])
    out = groups.select(*keys, "mean", "n").alias("r").join(wide.alias("g"), same, "left")
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, one, strict=True)], *names, "mean", "n")


def mean_of_numbers(c: Column) -> Column:
    """The mean without NaN and null; null if nothing is left."""
    return F.avg(F.when(~F.isnan(c), c))


def answer_summary(answers: DataFrame) -> DataFrame:
    """One row: documents, those without a leak, and those whose answer holds every original. answers: leak_free and
    reconstructed, of each document."""
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c)
    return answers.agg(F.count(F.lit(1)).alias("documents"), count("leak_free"), count("reconstructed"))


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a column of the table is the bits of one number, and each word of a one sum."""
    at: dict[str, int] = {}
    for i, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << i
    whole = (1 << len(b)) - 1
    open_ = whole
    for w in a:
        hit = open_ & at.get(w, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & whole
    return len(b) - open_.bit_count()


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two arrays of words; null arrays have none."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([0 if p is None or q is None else common_length(list(p), list(q)) for p, q in zip(x, y, strict=True)], dtype="int64")

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return pandas_udf(run, "long")(a, b)


def rouge_l(reference: Column, candidate: Column) -> Column:
    """F1 of the longest common subsequence of words, rounded to 4 places."""
    a, b = su.tokens(su.normalize(reference)), su.tokens(su.normalize(candidate))
    n = lcs_length(a, b)
    p, r = n / F.size(b), n / F.size(a)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (n == 0), 0.0).otherwise(F.round(2 * p * r / (p + r), 4))


def value_present(value: Column, answer: Column) -> Column:
    """By digits from six of them on, else verbatim, else by the last word of several."""
    digits, words = su.digits_only(value), su.tokens(value)
    text = su.normalize(answer)
    last = F.contains(text, su.normalize(F.try_element_at(words, F.lit(-1))))
    return F.when(F.length(digits) >= 6, F.contains(su.digits_only(answer), digits)).otherwise(F.contains(text, su.normalize(value)) | ((F.size(words) > 1) & F.coalesce(last, F.lit(False))))


def factual_score(expected: Column, answer: Column) -> Column:
    """Share of the distinct expected values that the answer holds; null without any."""
    values = F.array_distinct(expected)
    return F.when(F.size(values) > 0, F.size(F.filter(values, lambda v: value_present(v, answer))) / F.size(values))


def reconstructs(gold: Column, answer: Column) -> Column:
    """Whether every gold value is in the answer, with or without diacritics."""
    return F.forall(gold, lambda v: F.contains(su.normalize(answer), su.normalize(v)) | F.contains(su.fold_diacritics(answer), su.fold_diacritics(v)))


# ---------------------------------------------------------------- corpora


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs, n_entities, by_type, by_source, types_present, all_types_present, synthetic_ratio."""
    kinds = docs.select(F.explode("entities").alias("x")).groupBy(F.col("x.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_entities"))
    synthetic = F.sum((F.col("source") == "synthetic").cast("long"))
    rows = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(synthetic, F.lit(0)).alias("n_synthetic"), F.coalesce(F.sum((F.col("source") == "real").cast("long")), F.lit(0)).alias("n_real"))
    all_there = F.size(F.array_except(F.array(*[F.lit(t) for t in CANONICAL]), F.map_keys("by_type"))) == 0
    return rows.join(kinds, how="cross").select(
        "n_docs", "n_entities", "by_type", F.create_map(F.lit("synthetic"), "n_synthetic", F.lit("real"), "n_real").alias("by_source"),
        F.array_sort(F.map_keys("by_type")).alias("types_present"), all_there.alias("all_types_present"), F.round(F.col("n_synthetic") / F.greatest(F.col("n_docs"), F.lit(1)), 3).alias("synthetic_ratio"),
    )


def target_warnings(stats: DataFrame, docs: int = 50, entities: int = 500) -> DataFrame:
    """A row for each target that a corpus misses."""
    rows = F.array(
        F.when(F.col("n_docs") < docs, F.concat(F.lit("documents: "), F.col("n_docs").cast("string"))),
        F.when(F.col("n_entities") < entities, F.concat(F.lit("entities: "), F.col("n_entities").cast("string"))),
        F.when(~F.col("all_types_present"), F.lit("types are missing")),
    )
    return stats.select(F.explode(F.filter(rows, lambda w: w.isNotNull())).alias("warning"))


def corpus_hash(docs: DataFrame) -> DataFrame:
    """version: 16 hex digits over id, text and number of entities of all documents, in any order; null counts as empty.

    Each row is hashed where it is, and four numbers of 60 bits of its hash are added up over all rows: partial sums
    meet in one row, and no task gets a list. Rows that occur again count again.
    """
    row = F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")), F.greatest(F.size("entities"), F.lit(0)).cast("string"))
    hashed = docs.select(F.sha2(row, 256).alias("h"))
    lanes = [F.coalesce(F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(28,0)")), F.lit(0)).cast("string") for i in range(4)]
    return hashed.agg(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *lanes).alias("sums")).select(F.substring(F.sha2("sums", 256), 1, 16).alias("version"))

"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sources by code point, null last, weigh 5, 2, 1, repeating. Together they get as many words as there are; a target
stops at three times its source's words and the excess goes to the others by weight. A source whose target is r times
its words takes each document floor(r) times for certain. What then remains of its target, R words, is drawn by Pareto
order sampling: document i has the inclusion probability p_i = R w_i / sum(w s), where s is its size and w grows from
1 to 2 with it, a uniform number u_i that is a function of seed and document, and the rank

    q_i = (u_i / (1 - u_i)) / (p_i / (1 - p_i));

documents of least rank are taken while they fit in R. What is then left of R is filled up from the others: of each size
class (powers of two) the documents of least rank stand by, `STAND_BY` at most; from the largest to the smallest each is taken that
still fits, and last the one whose words come nearest to what is left then. The cut is found without sorting a source: ranks are
binned twice into 256 bins with sums of words, and only the documents of one last bin are put in order.

Cases: null text has size 0 and is never drawn before words are short; a source of no words has target 0; rows that
are alike in id, text and source are told apart by a number, so that each is drawn for itself; an empty table gives an
empty result; further columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilworks.llm.common import WORD_CLASS, documents, drop, text_of, written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
BINS = 256
#: Documents of a size class that stand by to fill up a source.
STAND_BY = 8
LEVELS = 2


KEY = ("doc_id", "digest", "source")


def sized(docs: DataFrame) -> DataFrame:
    """Adds size (words), digest (of the text) and w (in thousandths) to the rows."""
    text = text_of(docs)
    out = docs.withColumn("size", F.regexp_count(text, F.lit(WORD_CLASS)).cast("long")).withColumn("digest", F.md5(text.cast("binary")))
    return out.withColumn("w", F.expr("1000 + (1000 * size) div (size + 1000)"))


def drawn(rows: DataFrame, seed: str = SEED) -> DataFrame:
    """Rows of `sized` with u, in (0, 1), by seed, id and text, and by nth if there is such a column and it isn't 0."""
    parts = [F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("digest")]
    if "nth" in rows.columns:
        parts.append(F.when(F.col("nth") > 0, F.col("nth").cast("string")))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long")
    return rows.withColumn("u", (draw + F.lit(0.5)) / F.lit(float(1 << 52)))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of `sized` with nth, from 0 among rows alike in id, text and source."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("size")) - 1)


def targets(rows: DataFrame) -> DataFrame:
    """A row for each source: source, source_size, mass (sum of w * size), target, whole copies and the rest to draw.

    With sources in the order of 3 * size / weight, those at their limit come first, and one does reach it if its
    limit is at most its share of what those before it leave. Its windows hold as many rows as there are sources.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("w") * F.col("size")).alias("mass"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    by = by.withColumn("weight", weights.cast("long")).withColumn("limit", F.lit(MOST).cast("long") * F.col("source_size"))
    filled = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    earlier, later = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    by = by.withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(1)))).withColumn("used", F.coalesce(F.sum("limit").over(earlier), F.lit(0))).withColumn("open", F.sum("weight").over(later))
    full = F.col("limit") * F.col("open") <= F.col("weight") * (F.col("total") - F.col("used"))
    by = by.withColumn("full", full)
    everywhere = Window.partitionBy(F.lit(1))
    by = by.withColumn("rest_words", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everywhere), F.lit(0)))
    by = by.withColumn("rest_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(everywhere))
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("rest_words") / F.col("rest_weight"))
    by = by.withColumn("target", target.cast("double"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    by = by.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    return by.select("source", "source_size", "mass", "target", "whole", "rest")


def ranked(rows: DataFrame, by: DataFrame) -> DataFrame:
    """Rows with what holds for their source, and their Pareto rank q; null: never drawn."""
    by = by.withColumnRenamed("source", "of_source")
    both = rows.join(by, rows["source"].eqNullSafe(by["of_source"]), "left").drop("of_source")
    p = F.least(F.col("rest") * F.col("w") / F.col("mass"), F.lit(1 - 1e-9))
    q = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    return both.withColumn("q", F.when((F.col("rest") > 0) & (F.col("mass") > 0), q))


def _key() -> F.Column:
    return F.struct("q", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), "size")


def _bin(level: int) -> F.Column:
    return F.floor(F.col("q") / (1 + F.col("q")) * BINS**level).cast("long")


def _before() -> F.Column:
    """Whether a row is taken since its rank is at or before the cut."""
    return F.coalesce(F.coalesce(_bin(LEVELS) < F.col("cell"), F.lit(False)) | (_key() <= F.col("cut")), F.coalesce(_bin(LEVELS) < F.col("cell"), F.lit(False)))


def cuts(rows: DataFrame, by: DataFrame) -> DataFrame:
    """by with cut, the greatest (q, id, size) that fits, and extras, those of the rows taken to fill up; null: none."""
    state = by.withColumn("used", F.lit(0).cast("long")).withColumn("cell", F.lit(0).cast("long"))
    columns = [*by.columns, "used", "cell"]

    def found(frame: DataFrame, more: DataFrame, *named: F.Column) -> DataFrame:
        more = more.withColumnRenamed("source", "of_source")
        return frame.join(more, frame["source"].eqNullSafe(more["of_source"]), "left").drop("of_source").select(*named)

    for level in range(1, LEVELS + 1):
        inside = ranked(rows, state).withColumn("bin", _bin(level)).filter(F.floor(F.col("bin") / BINS) == F.col("cell"))
        sums = inside.groupBy("source", "rest", "used", "bin").agg(F.sum("size").alias("words"))
        run = sums.withColumn("upto", F.col("used") + F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
        # the last bin that the cut can be in: the first to reach the rest, or the last of all
        at = F.struct("bin", (F.col("upto") - F.col("words")).alias("used"))
        reach = run.groupBy("source").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("rest"), at)), F.max(at)).alias("at"))
        # a row for each source: written, so that the planner knows its size when rows meet it
        state = written(found(by, reach, *by.columns, F.col("at.used").alias("used"), F.col("at.bin").alias("cell")), "mix-state")
    last = ranked(rows, state).filter(_bin(LEVELS) == F.col("cell"))
    run = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("upto", F.col("used") + F.sum("size").over(run)).filter(F.col("upto") <= F.col("rest"))
    top = last.groupBy("source").agg(F.max(_key()).alias("cut"), F.max("upto").alias("upto"))
    state = written(found(state, top, *columns, "cut", (F.col("rest") - F.coalesce("upto", "used")).alias("gap")), "mix-state")
    off = F.abs(F.col("size") - F.col("gap"))
    by_class = Window.partitionBy("source", F.length(F.bin("size"))).orderBy("q", "doc_id", "size")
    fill = ranked(rows, state).filter(F.col("q").isNotNull() & ~_before() & (F.col("size") > 0) & (off < F.col("gap")))
    fill = fill.withColumn("k", F.row_number().over(by_class)).filter(F.col("k") <= STAND_BY)
    fill = fill.groupBy("source", "gap").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("n"), _key().alias("key")))).alias("x"))
    key = "struct<q:double,id:bigint,size:bigint>"
    step = "if(y.key.size <= a.left, named_struct('left', a.left - y.key.size, 'keys', concat(a.keys, array(y.key))), a)"
    fill = fill.withColumn("f", F.expr(f"aggregate(x, named_struct('left', gap, 'keys', cast(array() as array<{key}>)), (a, y) -> {step})"))
    near = "filter(transform(x, y -> named_struct('off', abs(y.key.size - f.left), 'key', y.key)), y -> y.off < f.left and not array_contains(f.keys, y.key))"
    fill = fill.withColumn("extras", F.expr(f"concat(f.keys, transform(slice(array_sort({near}), 1, 1), y -> y.key))"))
    return found(state, fill, *columns, "cut", "extras")


def copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (of sized, with u) with source_size, target and copies."""
    taken = _before() | F.coalesce(F.array_contains("extras", _key()), F.lit(False))
    out = ranked(rows, plan)
    out = out.withColumn("copies", F.coalesce(F.col("whole"), F.lit(0)) + F.when(F.col("q").isNotNull() & taken, 1).otherwise(0))
    return out.drop("mass", "whole", "rest", "used", "cell", "cut", "extras", "q", "u", "w", "digest", "nth")


def plan_of(rows: DataFrame) -> DataFrame:
    by = written(targets(rows), "mix-targets")
    plan = written(cuts(rows, by), "mix-cuts")
    drop(by)
    return plan


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs.

    The text is read twice, for sizes and for the rows; only sizes are shuffled, and the texts of rows that repeat.
    """
    columns = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "doc_id", "source", "text")
    rows = sized(held).drop("text")
    sizes = written(numbered(rows.select(*KEY, "size", "w")), "mix-sizes")
    plan = plan_of(drawn(sizes, seed))
    again = written(sizes.filter("nth > 0").select("doc_id", "digest").distinct(), "mix-repeats")
    drop(sizes)
    if again.limit(1).count():
        again = again.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
        same = rows["doc_id"].eqNullSafe(again["_id"]) & (rows["digest"] == again["_digest"])
        rows = rows.join(again, same, "left_anti").withColumn("nth", F.lit(0)).unionByName(numbered(rows.join(again, same, "left_semi")))
    taken = copies(drawn(rows, seed), plan).filter(F.col("copies") > 0)
    return taken.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "row").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    rows = written(drawn(numbered(sized(docs).select(*KEY, "size", "w"))), "mix-sizes")
    return copies(rows, plan_of(rows)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL = r"""
WITH d0 AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest,
         row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) - 1 AS nth
  FROM documents),
d AS (
  SELECT doc_id, source, size,
         (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || digest || CASE WHEN nth > 0 THEN ':' || nth ELSE '' END), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d0),
e AS (SELECT *, 1000 + (1000 * size) // (size + 1000) AS w FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(w * size) AS BIGINT) AS mass FROM e GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
              CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
s2 AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
              sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened FROM s1),
s3 AS (SELECT *, 3 * source_size * opened <= weight * (total - used) AS full_ FROM s2),
s4 AS (SELECT *, CAST(total - coalesce(sum(CASE WHEN full_ THEN 3 * source_size END) OVER (), 0) AS BIGINT) AS rest_words,
              CAST(sum(CASE WHEN NOT full_ THEN weight END) OVER () AS BIGINT) AS rest_weight FROM s3),
s5 AS (SELECT source, source_size, mass, CASE WHEN full_ THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight * rest_words AS DOUBLE) / rest_weight END AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM s5),
s7 AS (SELECT *, target - whole * source_size AS rest FROM s6),
q AS (SELECT e.*, source_size, target, whole, rest, CASE WHEN rest > 0 AND mass > 0 THEN
        (u / (1 - u)) / (least(rest * w / mass, 1 - 1e-9::DOUBLE) / (1 - least(rest * w / mass, 1 - 1e-9::DOUBLE))) END AS q
      FROM e JOIN s7 ON e.source IS NOT DISTINCT FROM s7.source),
r AS (SELECT *, q IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) <= rest AS fits FROM q),
g AS (SELECT *, rest - sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM r),
c AS (SELECT source, q, doc_id, size, gap, row_number() OVER (PARTITION BY source, length(bin(size)) ORDER BY q, doc_id, size) AS k
      FROM g WHERE NOT fits AND q IS NOT NULL AND size > 0 AND abs(size - gap) < gap),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, q, doc_id) AS i FROM c WHERE k <= 8),
l AS (SELECT source, any_value(CAST(floor(gap) AS BIGINT)) AS whole_gap, list(size ORDER BY i) AS sizes FROM o GROUP BY source),
t AS (SELECT o.*, size <= list_reduce(sizes[1:i - 1], lambda a, x: CASE WHEN x <= a THEN a - x ELSE a END, whole_gap) AS fills FROM o JOIN l ON o.source IS NOT DISTINCT FROM l.source),
u AS (SELECT *, gap - sum(CASE WHEN fills THEN size ELSE 0 END) OVER (PARTITION BY source) AS left_ FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN fills OR abs(size - left_) >= left_ THEN 1 ELSE 0 END, abs(size - left_), q, doc_id, size) = 1
        AND NOT fills AND abs(size - left_) < left_ AS nearest FROM u),
h AS (SELECT g.*, coalesce(n.fills OR n.nearest, false) AS extra FROM g LEFT JOIN n ON g.source IS NOT DISTINCT FROM n.source AND g.q = n.q AND g.doc_id IS NOT DISTINCT FROM n.doc_id AND g.size = n.size)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN fits OR extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM h
"""

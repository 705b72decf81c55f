"""Gold corpora, templates and threshold tables: reading, checking and writing."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilworks.operators.rewrite import fill_template
from veilworks.operators.spans import CANONICAL, DEFAULT_THRESHOLD, THRESHOLDS

GOLD = "doc_id string, source string, contract_type string, text string, entities array<struct<type:string,start:int,end:int,text:string>>"


def read_gold(spark: SparkSession, *paths: str, source: str | None = None, check: bool = True) -> DataFrame:
    """JSON lines of one or more folders or files; blank lines are skipped, a line that is no document fails the read.

    A missing folder is skipped. source: the only source that the documents may have.
    """
    there = [p for p in paths if _exists(spark, p)]
    schema = StructType.fromDDL(GOLD)
    if not there:
        return spark.createDataFrame([], schema)
    docs = spark.read.schema(schema).option("mode", "FAILFAST").json(there)
    if not check:
        return docs
    if violations(docs, source).limit(1).count():
        first = located(spark, *there, source=source).orderBy("file", "line").first()
        raise ValueError(f"{first.file}:{first.line}: {first.doc_id}: {first.violation}")
    return docs


def gold_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """file, line (from 1) and value of each line that isn't blank.

    Rows of a part of a file are numbered as they are scanned, and the lines of the parts before it, of which there are
    as many as tasks, are added. No file is read in one piece.
    """
    at = F.monotonically_increasing_id()
    rows = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("id"))
    parts = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = rows.join(parts.select("file", "block", "first", earlier.alias("earlier")), ["file", "block"])
    return both.select("file", (F.col("id") - F.col("first") + F.col("earlier") + 1).alias("line"), "value").filter(r"value rlike '\\S'")


def located(spark: SparkSession, *paths: str, source: str | None = None) -> DataFrame:
    """file, line, doc_id and violation: each rule that a line breaks, also that of being no document."""
    schema = StructType.fromDDL(GOLD + ", _broken string")
    read = gold_lines(spark, *paths).withColumn("d", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    bad = read.filter("d._broken is not null").select("file", "line", "d.doc_id", F.lit("no document").alias("violation"))
    good = read.filter("d._broken is null").select("file", "line", "d.*")
    own = good.select("file", "line", "doc_id", F.explode(_broken(source)).alias("violation"))
    again = good.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).filter("n > 1").select("file", "line", "doc_id", F.lit("doc_id occurs again").alias("violation"))
    return bad.unionByName(own).unionByName(again)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def _broken(source: str | None) -> Column:
    """Array of the names of the rules that a document breaks."""
    known = ", ".join(f"'{t}'" for t in CANONICAL)
    checks = {
        "source": "source is null or source not in ('synthetic', 'real')" if source is None else f"coalesce(source, '') <> '{source}'",
        "entity type": f"exists(entities, x -> x.type is null or x.type not in ({known}))",
        "entity range": "exists(entities, x -> x.start < 0 or x.start >= x.end or x.end > length(text))",
        "entity text": "exists(entities, x -> substring(text, x.start + 1, x.end - x.start) <> x.text)",
        # in order of type and start, an entity may not start before the one before it ends
        "entity overlap": """exists(transform(array_sort(transform(entities, x -> named_struct('t', x.type, 's', x.start, 'e', x.end))), (x, i) -> named_struct('x', x, 'i', i)),
            y -> y.i > 0 and array_sort(transform(entities, x -> named_struct('t', x.type, 's', x.start, 'e', x.end)))[y.i - 1].t = y.x.t
                and array_sort(transform(entities, x -> named_struct('t', x.type, 's', x.start, 'e', x.end)))[y.i - 1].e > y.x.s)""",
    }
    found = F.array(*[F.when(F.coalesce(F.expr(c), F.lit(False)), F.lit(name)) for name, c in checks.items()])
    return F.filter(found, lambda v: v.isNotNull())


def violations(docs: DataFrame, source: str | None = None) -> DataFrame:
    """doc_id and each rule that a document breaks."""
    own = docs.select("doc_id", F.explode(_broken(source)).alias("violation"))
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", F.lit("doc_id occurs again").alias("violation"))
    return own.union(again)


def write_gold(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """contract_type (a file's stem) and template of each text file, in order of name."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("contract_type"), F.col("value").alias("template"))
    return rows.orderBy("contract_type")


def build_corpus(templates: DataFrame, values, count: int = 56, seed: int = 42) -> DataFrame:
    """`count` gold documents: each template once, in order, and then as a hash of seed and number chooses.

    values: from (number, type, role) columns to the column of a slot's text, the same for the same three.
    """
    spark = templates.sparkSession
    held = templates.orderBy("contract_type").agg(F.collect_list(F.struct("contract_type", "template")).alias("t"))  # one row for each file that a person wrote
    n = F.size("t")
    pick = F.when(F.col("id") < n, F.col("id")).otherwise(F.pmod(F.xxhash64(F.lit(seed), "id"), n)).cast("int")
    rows = spark.range(count).join(F.broadcast(held), how="cross").select("id", F.element_at("t", pick + 1).alias("x")).select("id", "x.*")
    slots = F.array_distinct(F.regexp_extract_all("template", F.lit(r"\{\{([A-Z_]+:[^}]+)\}\}"), 1))
    filled = F.map_from_arrays(slots, F.transform(slots, lambda s: values(F.col("id"), F.element_at(F.split(s, ":"), 1), F.element_at(F.split(s, ":"), 2))))
    rows = rows.withColumn("_v", filled).withColumn("f", fill_template("template", "_v"))
    name = F.concat_ws("-", F.lit("syn"), "contract_type", F.lpad(F.col("id").cast("string"), 3, "0"))
    return rows.select(name.alias("doc_id"), F.lit("synthetic").alias("source"), "contract_type", "f.text", "f.entities")


def parse_thresholds(text: str) -> tuple[dict[str, float], float]:
    """`default: x` and an indented table under `thresholds:`; numbers are held to [0, 1] and bad ones left out."""
    table, default, inside = dict(THRESHOLDS), DEFAULT_THRESHOLD, False
    for line in text.splitlines():
        line = line.split("#")[0].rstrip()
        if not line.strip():
            continue
        name, _, value = (x.strip() for x in line.strip().partition(":"))
        if not line[0].isspace():
            inside = name == "thresholds"
        try:
            number = min(max(float(value), 0.0), 1.0)
        except ValueError:
            continue
        if line[0].isspace() and inside:
            table[name] = number
        elif name == "default":
            default = number
    return table, default


class ThresholdFile:
    """A table that is read again when its file has changed; one that can't be read leaves the built-in values."""

    def __init__(self, path: str):
        self.path, self.at, self.held = Path(path), None, (dict(THRESHOLDS), DEFAULT_THRESHOLD)

    def current(self) -> tuple[dict[str, float], float]:
        try:
            at = self.path.stat().st_mtime_ns
            if at != self.at:
                self.held, self.at = parse_thresholds(self.path.read_text(encoding="utf-8")), at
        except OSError:
            self.held, self.at = (dict(THRESHOLDS), DEFAULT_THRESHOLD), None
        return self.held

"""What a Python worker holds at once."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from veilworks.operators import spans as sp
from veilworks.sources.shared import BATCH_ROWS


def test_batches_are_small(spark):
    """Texts go to Python in batches of few rows, however many a partition has."""

    def length(t: pd.Series) -> pd.Series:
        return pd.Series([len(t)] * len(t))

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        length.__annotations__ = {"t": pd.Series, "return": pd.Series}
        df = sp.detect(spark.range(3000, numPartitions=1).select(F.concat(F.lit("tel. 601 234 567, "), F.col("id").cast("string")).alias("text")))
        assert df.select(F.size("entities").alias("n"), pandas_udf(length, "long")("text").alias("rows")).agg(F.max("rows")).first()[0] <= BATCH_ROWS
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_runs_of_first_words(spark):
    """Only runs that begin as a surface does are made, and all names are found as by comparing every run."""
    gaz = spark.createDataFrame([(s, "PERSON", s.lower(), "nom") for s in ("Anna Zielińska", "Zielińska", "Jan z Łodzi", "?odd")], "surface string, entity_type string, lemma string, case string")
    text = "słowo " * 500 + "Anna Zielińska i Jan z Łodzi, Anna, Anna-Zielińska"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Annamaria Zielińskaz")], "k long, text string")
    got = {(r.k, x.start, x.text) for r in sp.names_from_gazetteer(df, gaz, "k").collect() for x in r.names}
    assert got == {(1, 3000, "Anna Zielińska"), (1, 3005, "Zielińska"), (1, 3017, "Jan z Łodzi"), (1, text.rindex("Z"), "Zielińska")}
    bits = sp._first_words(gaz).first()["_bits"]
    slots = {spark.range(1).select(F.expr(sp._slot(f"'{w}'"))).first()[0] for w in ("Anna", "Zielińska", "Jan", "")}
    assert {64 * i + j for i, b in enumerate(bits) for j in range(64) if b >> j & 1} == slots and len(bits) * 64 == sp.SLOTS
    assert sp.names_from_gazetteer(df, gaz.limit(0), "k").count() == 0

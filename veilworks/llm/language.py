"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of it is predicted by a binary classifier on hashed byte trigrams (naive Bayes
log-odds, the mean of the languages that have the bit set against the mean of the others). Decoding is loss-weighted:
the distance of a codeword is the logistic loss of its bits against the margins, each bit weighted by how often its
classifier was right on that language in a second fold. The nearest codeword wins and its share of exp(-distance) is
the score. A text is flagged as ambiguous if its two nearest codewords lie close together, or if even the nearest is
far: its bits are then undecided, as in letters that are no language that was learned. `accepted` rejects such texts.

The classifiers are fitted on a sample of labelled rows, about `SAMPLE` of each language, drawn by a hash of doc_id;
every text is then predicted whole. Cases: a text that is null or has no letter is `und` with score 0; with no labelled
rows every text is `und`, with one language every other text has it, score 1; texts too short for a trigram are tied
and get the first language by code point; rows are predicted one by one, repeated ones alike; further columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.llm.common import _LOWER, documents, held_out, small_batches, slabs, text_buffers, written

SAMPLE = 1500
#: The commonest labels, at most so many, are learned.
LANGUAGES = 500
BUCKETS = 1 << 16
GRAM = 3
SCALES = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
UNKNOWN = "und"
#: A text is ambiguous if its score is below CLEAR or the mean loss of its bits above FAR; an undecided bit costs
#: log 2 = 0.69.
CLEAR, FAR = 0.6, 0.35


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1. Exhaustive for up to 7 languages, else the best of many random codes."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 7:
        bits = 2 ** (n - 1) - 1
        code = np.ones((n, bits), np.int8)
        for i in range(1, n):
            code[i] = np.where((np.arange(bits) >> (n - 1 - i)) & 1, 1, -1)
        return code
    rng, bits, best, most = np.random.default_rng(seed), int(10 * np.ceil(np.log2(n))), None, -1
    for _ in range(100):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        if np.any(np.abs(code.sum(0)) == n):
            continue
        apart = (code[:, None, :] != code[None, :, :]).sum(2) + bits * np.eye(n, dtype=int)
        if apart.min() > most:
            best, most = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bits x (BUCKETS + 1); the last bucket counts nothing
    trust: np.ndarray  # languages x bits, rows add up to the number of bits
    scale: float

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its score, and its mean loss of a bit."""
        n = len(self.languages)
        if n < 2:
            return np.zeros(len(margins), int), np.ones(len(margins)), np.zeros(len(margins))
        loss = np.logaddexp(0, -self.scale * margins[:, None, :] * self.code[None, :, :])
        far = (loss * self.trust[None, :, :]).sum(2)
        p = np.exp(far.min(1, keepdims=True) - far)
        best = far.argmin(1)
        return best, 1 / p.sum(1), far.min(1) / self.code.shape[1]


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that starts at each byte; BUCKETS where it would leave the text."""
    out = np.full(len(data), BUCKETS, np.int32)
    if len(data) >= GRAM:
        low = _LOWER[data].astype(np.uint32)
        key = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
        out[: len(key)] = (key * np.uint32(0x9E3779B1)) >> np.uint32(16)
    for back in range(1, GRAM):
        at = offsets[1:] - back
        out[at[at >= offsets[:-1]]] = BUCKETS
    return out


def margins(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Mean log-odds of each bit for each text."""
    data, offsets = text_buffers(column)
    out = np.zeros((len(offsets) - 1, len(weights)))
    for i, j in slabs(offsets, 1 << 19):
        at = offsets[i : j + 1] - offsets[i]
        buckets = grams(data[offsets[i] : offsets[j]], at)
        count = np.maximum(np.diff(at) - (GRAM - 1), 1)
        sums = np.zeros(len(buckets) + 1)
        for b, w in enumerate(weights):
            np.cumsum(w[buckets], dtype=np.float64, out=sums[1:])
            out[i:j, b] = (sums[at[1:]] - sums[at[:-1]]) / count
    return out


def sample(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """text, lang and fold (0 to 3; the last tests) of about `size` rows of each language that are not held out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", 4, 2))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    rates = F.broadcast(counts.select("lang", (F.lit(float(size)) / F.col("n")).alias("rate")))  # at most LANGUAGES rows
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("fold"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 32)  # CRC would follow held_out's
    rows = known.select("lang", "text", draw.alias("draw")).join(rates, "lang")
    return rows.filter(F.col("draw") < F.col("rate") * float(1 << 32)).select("text", "lang", (F.col("draw") % 4).cast("int").alias("fold"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        buckets = grams(data, offsets)
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            if lang not in total:
                total[lang] = np.zeros(BUCKETS + 1, np.int64)
            total[lang] += np.bincount(buckets[offsets[i] : offsets[i + 1]], minlength=BUCKETS + 1)
    if total:
        yield pa.RecordBatch.from_pydict({"lang": list(total), "counts": [x.tobytes() for x in total.values()]})


def _add(rows):
    import pandas as pd

    counts = sum(np.frombuffer(x, np.int64) for x in rows["counts"])
    return pd.DataFrame({"lang": rows["lang"][:1], "counts": [counts.tobytes()]})


def fit(docs: DataFrame, size: int = SAMPLE) -> Model:
    """All that reaches the driver is a table of counts for each language and the margins of the test fold."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = written(sample(docs, size), "languages")
    kind = "lang string, counts binary"
    parts = rows.filter("fold < 3").coalesce(8).mapInArrow(_count, kind)
    tables = {r.lang: np.frombuffer(r.counts, np.int64)[:BUCKETS] for r in parts.groupBy("lang").applyInPandas(_add, kind).collect()}
    languages = sorted(tables)
    code = codewords(len(languages))
    bits = code.shape[1]
    weights = np.zeros((bits, BUCKETS + 1), np.float32)
    if bits:
        share = np.stack([(tables[x] + 0.05) / (tables[x].sum() + 0.05 * BUCKETS) for x in languages])
        for b in range(bits):
            weights[b, :BUCKETS] = np.log(share[code[:, b] > 0].mean(0)) - np.log(share[code[:, b] < 0].mean(0))
    model = Model(languages, code, weights, np.ones(code.shape), 4.0)
    if not bits:
        return model
    shared = spark.sparkContext.broadcast(weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = margins(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "margins": [x.tobytes() for x in got]})

    test = rows.filter("fold = 3").coalesce(8).mapInArrow(measure, "lang string, margins binary").collect()
    place = {x: i for i, x in enumerate(languages)}
    test = [(place[r.lang], np.frombuffer(r.margins)) for r in test if r.lang in place]
    if test:
        truth, found = np.array([x for x, _ in test]), np.stack([x for _, x in test])
        right = (found * code[truth] > 0).astype(float)
        seen = np.bincount(truth, minlength=len(languages))
        hits = np.stack([np.bincount(truth, right[:, b], len(languages)) for b in range(bits)], 1)
        trust = (hits + 1) / (seen[:, None] + 2)
        model.trust = trust * bits / trust.sum(1, keepdims=True)

        def cost(scale: float) -> float:
            far = (np.logaddexp(0, -scale * found[:, None, :] * code[None]) * model.trust[None]).sum(2)
            return float((far[np.arange(len(truth)), truth] + np.log(np.exp(-far).sum(1) + 1e-300)).mean())

        model.scale = min(SCALES, key=cost)
    return model


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns of `keep` with lang_pred, score, loss (of a bit of the nearest codeword) and ambiguous."""
    spark = docs.sparkSession
    small_batches(spark)
    held = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col("text"), F.lit("")).alias("_t"), F.expr(r"coalesce(text rlike r'\p{L}', false)").alias("_letter"))
    names_out = [*held.columns[:-2], "lang_pred", "score", "loss"]
    schema = type(held.schema)(list(held.schema.fields[:-2])).add("lang_pred", "string", False).add("score", "double", False).add("loss", "double", False)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            letters = np.asarray(batch.column("_letter").to_numpy(zero_copy_only=False), bool)
            best, score, loss = model.predict(margins(batch.column("_t"), model.weights))
            known = letters & bool(model.languages)
            best, score = np.where(known, best, len(names) - 1), np.where(known, score, 0.0)
            cols = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(loss, pa.float64())], names=names_out)

    out = held.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "loss", ((F.col("score") < CLEAR) | (F.col("loss") > FAR)).alias("ambiguous"))


def accepted(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """The rows of docs that have a language: the prediction names one and isn't ambiguous. So letterless texts go, and
    those whose letters no learned language explains. If no language can be learned, all texts with letters stay."""
    columns = docs.columns
    model = fit(docs, size)
    if not model.languages:
        return docs.filter(r"text rlike r'\p{L}'")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "text")
    return predict(row, model, "_row").filter((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    rows = docs.withColumn("held_out", held_out("doc_id", 4, 2))
    return predict(rows, fit(docs), "doc_id", "held_out")

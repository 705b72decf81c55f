"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window.

A window is one word, lower-cased, without punctuation at its ends, between marks; each distinct window of a text is compressed with both dictionaries
and its gain is the number of bytes by which the toxic one is shorter. Longer windows drown the few bytes that a single
toxic word saves in what its neighbours cost. A text's statistic adds up the gains above a threshold, and a table turns
it into a probability; threshold and table are those that describe a fold of labelled texts best that trained nothing.

The toxic dictionary is made by zstandard's trainer from windows chosen by contrast: word beginnings that are so often in
toxic and so seldom in ordinary texts that chance is ruled out (families of near copies count once), and the words of
toxic texts that have them. The ordinary dictionary is raw content, the commonest ordinary words and, nearest to its end,
the ordinary words that compressed better with the toxic one; the trainer leaves out too many of them. Both are bounded.

The fit uses about `TOXIC` and `ORDINARY` labelled rows of at most `TRAIN_BYTES` bytes, drawn by a hash of doc_id;
every text is scored whole. Cases: null text counts as empty and has the score of a text without gains; with no toxic
labels all scores are equal; if a doc_id has several labels the greatest holds; rows are scored one by one; an empty
table gives an empty result; further columns stay.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.llm.common import WORD_CLASS, documents, held_out, small_batches

TOXIC, ORDINARY, TRAIN_BYTES = 1500, 4500, 32768
TOXIC_BYTES, ORDINARY_BYTES, HARD_BYTES = 16384, 300_000, 100_000
#: Lengths of word beginnings, and the log of the chance at which one counts as toxic.
BEGIN, CHANCE = range(3, 11), -12.0
#: A word is toxic to `train` from this gain on; for texts, gains below one of GAINS don't count, and sums above MOST
#: count as MOST.
GAIN, GAINS, MOST = 5, (3, 4, 5, 6, 7), 20
#: Trainer: bytes of a segment and of the pieces that it counts, and times that each sample is given to it.
SEGMENT, PIECE, TIMES = 24, 8, 20
LIMIT = 0.7
MARK = b"\x01\x02\x03\x04\x05"
EDGES = ".,;:!?\"'()[]{}#*$%&|<>"
CACHE = 400_000

_WORD = re.compile(WORD_CLASS)


def windows(text: str) -> set[str]:
    """The distinct words without the marks around them."""
    return {w.strip(EDGES) for w in _WORD.findall(text.lower())} - {""}


class Distance:
    """The gain of a window; gains are kept up to a bounded number."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            held = zstandard.ZstdCompressionDict(content + MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(19, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0, window_log=20, min_match=3)
            return zstandard.ZstdCompressor(dict_data=held, compression_params=p)

        self.toxic, self.ordinary, self.known = compressor(toxic), compressor(ordinary), {}

    def gain(self, window: str) -> int:
        got = self.known.get(window)
        if got is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            raw = MARK + window.encode("utf-8", "surrogatepass") + MARK
            got = self.known[window] = len(self.ordinary.compress(raw)) - len(self.toxic.compress(raw))
        return got

    def statistic(self, text: str, least: int) -> int:
        total = 0
        for w in windows(text):
            g = self.gain(w)
            if g >= least:
                total += g - least + 1
        return min(total, MOST)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    least: int  # gain that counts
    table: list[float]  # the score of each statistic, rising


def _family(words: set[str]) -> int:
    """Near copies mostly share their least word hash."""
    return min((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), default=0)


def _packed(words: list[str], size: int) -> bytes:
    """As many words as fit, the first of them nearest to the end."""
    out, n = [], 0
    for w in words:
        raw = MARK + w.encode("utf-8", "surrogatepass")
        if n + len(raw) > size:
            break
        out.append(raw)
        n += len(raw)
    return b"".join(reversed(out))


def _trained(words: list[str]) -> bytes:
    """A dictionary of zstandard's trainer from the words between marks, as many as fit; raw if they are too few for it."""
    packed = _packed(words, TOXIC_BYTES)
    samples = [MARK + w + MARK for w in packed.split(MARK) if w]
    try:
        return zstandard.train_dictionary(2 * TOXIC_BYTES, samples * TIMES, k=SEGMENT, d=PIECE, level=19).as_bytes()
    except zstandard.ZstdError:
        return packed


def train(texts: list[tuple[str, int]]) -> tuple[bytes, bytes]:
    """Contents of the toxic and of the ordinary dictionary."""
    words: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
    families: dict[int, dict[int, set[str]]] = {0: {}, 1: {}}
    for text, label in texts:
        own = windows(text)
        families[label].setdefault(_family(own), own)
    begins: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
    n = {label: len(held) for label, held in families.items()}
    for label in (1, 0):
        for own in families[label].values():
            words[label].update(own)
            these = {w[:k] for w in own for k in BEGIN if len(w) >= k}
            begins[label].update(these if label else (p for p in these if p in begins[1]))
        if label:
            begins[1] = Counter({p: c for p, c in begins[1].items() if c >= 3})
    if not n[0] or not n[1]:
        return b"", _packed([w for w, _ in words[0].most_common()], ORDINARY_BYTES)
    share = math.log(n[1] / (n[0] + n[1]))

    def toxic(p: str) -> bool:
        a, b = begins[1][p], begins[0][p]
        if a / n[1] <= 8 * (b + 0.5) / n[0]:
            return False
        spread = a * math.log((a + b) / a) + b * math.log((a + b) / b) if b else 0.0
        return a * share + spread < CHANCE

    chosen = {p for p in begins[1] if toxic(p)}
    bad = [w for w, _ in sorted(words[1].items(), key=lambda x: (-x[1], x[0])) if any(w[:k] in chosen for k in BEGIN if len(w) >= k)]
    good = [w for w, _ in sorted(words[0].items(), key=lambda x: (-x[1], x[0]))]
    first, second = _trained(bad) if bad else b"", _packed(good, ORDINARY_BYTES)
    if not first:
        return b"", second
    near = Distance(first, second)
    hard = [w for w in good if near.gain(w) >= GAIN]
    return first, second + _packed(hard, HARD_BYTES)


def calibrate(found: list[tuple[int, int]]) -> list[float]:
    """Share of toxic texts for each statistic (found: statistic, label), smoothed and made to rise by pooling."""
    n, bad = [0.0] * (MOST + 1), [0.0] * (MOST + 1)
    for s, label in found:
        n[s] += 1
        bad[s] += label
    rate = (sum(bad) + 0.5) / (sum(n) + 1)
    pools = [[bad[s] + 0.5 * (rate if s == 0 else max(rate, 0.9)), n[s] + 0.5, 1] for s in range(MOST + 1)]
    out: list[list[float]] = []
    for pool in pools:
        out.append(list(pool))
        while len(out) > 1 and out[-2][0] / out[-2][1] >= out[-1][0] / out[-1][1]:
            last = out.pop()
            out[-1] = [x + y for x, y in zip(out[-1], last, strict=True)]
    return [b / m for b, m, k in out for _ in range(int(k))]


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic and fold (0 to 3; the last calibrates). The labels are sampled first, so that few rows join."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.crc32(F.concat(F.lit("toxic:"), F.col("doc_id").cast("string")).cast("binary"))
    most = F.when(F.col("toxic") == 1, F.lit(TOXIC / max(1, counts.get(1, 0)))).otherwise(F.lit(ORDINARY / max(1, counts.get(0, 0))))
    picked = known.filter(draw < most * float(1 << 32)).select("doc_id", "toxic", (draw % 4).cast("int").alias("fold"))
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.octet_length("text") <= TRAIN_BYTES))
    return texts.join(F.broadcast(picked), "doc_id").select("text", "toxic", "fold")  # about TOXIC + ORDINARY rows of ids


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = [(r.text, r.toxic, r.fold) for r in sample(docs, labels).collect()]
    rows.sort()
    toxic, ordinary = train([(t, y) for t, y, fold in rows if fold < 3])
    near, tests, best = Distance(toxic, ordinary), [(t, y) for t, y, fold in rows if fold == 3], []
    for least in GAINS:
        found = [(near.statistic(t, least) if toxic else 0, y) for t, y in tests]
        table = calibrate(found)
        best.append((-sum(math.log(table[s] if y else 1 - table[s]) for s, y in found), -least, table))
    _, least, table = min(best)  # of equal ones the greatest threshold
    return Model(toxic, ordinary, -least, table)


_made: dict[int, Distance] = {}


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns of `keep` with score and predicted."""
    small_batches(docs.sparkSession)
    held = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce("text", F.lit("")).alias("_t"))
    names = [*held.columns[:-1], "score", "predicted"]
    schema = type(held.schema)(list(held.schema.fields[:-1])).add("score", "double", False).add("predicted", "integer", False)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        key = hash((model.toxic, model.ordinary))
        if key not in _made:  # workers are used again and so are the gains they know
            _made.clear()
            _made[key] = Distance(model.toxic, model.ordinary)
        near = _made[key]
        for batch in batches:
            score = [model.table[near.statistic(t, model.least) if model.toxic else 0] for t in batch.column("_t").to_pylist()]
            flags = pa.array([int(s >= LIMIT) for s in score], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64()), flags], names=names)

    out = held.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return predict(docs.withColumn("held_out", held_out("doc_id", 3, 1)), model, "doc_id", "held_out")

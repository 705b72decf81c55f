"""SentencePiece encoding and decoding; giant documents by max-plus scan over their chunks.

A document of more than `GIANT` code points is cut into chunks of `CHUNK` (see maxplus): a first pass makes each
chunk's transfer matrix, the matrices of a document are scanned for the best state at every cut, and a second pass
has each chunk find its own ids. Chunks of one document so run in many tasks. Other documents are one chunk. The ids
are those of the SentencePiece library, whole document for whole document.

Cases: null text counts as empty, which has no ids; a text's own U+2581 is a space to the model, and decodes to one;
rows that repeat are encoded once if they are giant and each get their ids; an empty table gives an empty result;
further columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from veilworks.llm.common import documents, small_batches, written
from veilworks.llm.maxplus import SPACE, Chunk, Vocabulary, choose, escaped

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 8192
GIANT = 32768

_loaded: dict[tuple[int, str], Vocabulary] = {}


def vocabulary(model: bytes, kind: str) -> Vocabulary:
    key = (hash(model), kind)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(model, kind)
    return _loaded[key]


def _whole(v: Vocabulary, text: str) -> list[int]:
    return v.library.encode(text) if v.kind == "bpe" else _chunked(v, text, CHUNK)


def _chunk(v: Vocabulary, s: str, first: int, last: int) -> Chunk:
    """The chunk of an escaped text, with as much around it as its states need."""
    halo = 2 * v.longest
    low, high = max(0, first - halo), min(len(s), last + halo)
    return Chunk(v, s[low:high], first - low, last - low, low == 0, high == len(s))


def _cuts(n: int, size: int) -> list[tuple[int, int]]:
    return [(i, min(n, i + size)) for i in range(0, n, size)]


def _chunked(v: Vocabulary, text: str, size: int) -> list[int]:
    """All steps for one text, in one place."""
    s = escaped(text)
    if not s:
        return []
    chunks = [_chunk(v, s, i, j) for i, j in _cuts(len(s), size)]
    ends = choose([c.matrix() for c in chunks])
    if ends is None:
        raise ValueError("no segmentation has a finite weight")
    return [x for k, c in enumerate(chunks) for x in c.ids(ends[k - 1] if k else 0, ends[k])]


def _lists(rows: list[list[int]]) -> pa.Array:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if len(rows) else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))


def _giants(giants: DataFrame, model, kind: str, size: int) -> DataFrame:
    """_key and ids of giant documents (distinct _key, _t)."""
    library = SentencePieceProcessor(model_proto=model.value)
    halo = 2 * max(len(library.id_to_piece(i)) for i in range(library.vocab_size()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks with their surroundings; s is cut text, at and upto its chunk's places in it."""
        for batch in batches:
            for key, text in zip(batch.column("_key").to_pylist(), batch.column("_t").to_pylist(), strict=True):
                s = escaped(text)
                rows = []
                for k, (i, j) in enumerate(_cuts(len(s), size)):
                    low, high = max(0, i - halo), min(len(s), j + halo)
                    rows.append((key, k, s[low:high], i - low, j - low, low == 0, high == len(s)))
                yield pa.RecordBatch.from_pydict(dict(zip(("_key", "k", "s", "at", "upto", "opens", "closes"), map(list, zip(*rows, strict=True)), strict=True)), schema=_SPLIT)

    def chunks(batch: pa.RecordBatch, v: Vocabulary) -> list[Chunk]:
        return [Chunk(v, *row) for row in zip(*(batch.column(c).to_pylist() for c in ("s", "at", "upto", "opens", "closes")), strict=True)]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value, kind)
        for batch in batches:
            found = [c.matrix() for c in chunks(batch, v)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("k"), pa.array([m.shape[1] for m in found], pa.int32()), pa.array([m.astype(np.float64).tobytes() for m in found], pa.binary())], names=["_key", "k", "width", "matrix"]
            )

    def states(table: pa.Table) -> pa.Table:
        """A document's matrices, some hundred numbers for each chunk, to the states at its cuts."""
        table = table.sort_by("k")
        shape = [np.frombuffer(m).reshape(-1, w) if w else np.zeros((1, 0)) for m, w in zip(table.column("matrix").to_pylist(), table.column("width").to_pylist(), strict=True)]
        ends = choose(shape)
        if ends is None:
            raise ValueError("no segmentation has a finite weight")
        return pa.table({"_key": table.column("_key"), "k": table.column("k"), "entry": pa.array([0, *ends[:-1]], pa.int32()), "leave": pa.array(ends, pa.int32())})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value, kind)
        for batch in batches:
            ends = zip(batch.column("entry").to_pylist(), batch.column("leave").to_pylist(), strict=True)
            rows = [c.ids(*e) for c, e in zip(chunks(batch, v), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("k"), _lists(rows)], names=["_key", "k", "ids"])

    n = int(giants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = written(giants.mapInArrow(split, "_key string, k int, s string, at int, upto int, opens boolean, closes boolean").repartition(n, "_key", "k"), "chunks")
    ways = parts.mapInArrow(matrices, "_key string, k int, width int, matrix binary").groupBy("_key").applyInArrow(_typed(states), "_key string, k int, entry int, leave int")
    traced = parts.join(ways, ["_key", "k"]).select("_key", "k", "s", "at", "upto", "opens", "closes", "entry", "leave").mapInArrow(trace, "_key string, k int, ids array<int>")
    return traced.groupBy("_key").agg(F.expr("flatten(transform(array_sort(collect_list(struct(k, ids))), x -> x.ids))").alias("_ids"))


def _typed(f):
    """Spark tells the kind of a grouped function by its annotations, which must be types here."""

    def run(table: pa.Table) -> pa.Table:
        return f(table)

    run.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return run


_SPLIT = pa.schema([("_key", pa.string()), ("k", pa.int32()), ("s", pa.string()), ("at", pa.int32()), ("upto", pa.int32()), ("opens", pa.bool_()), ("closes", pa.bool_())])


def encode(docs: DataFrame, *keep: str, model_path: str = MODEL, kind: str = "bpe", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """The columns of `keep` with ids and round_trip, whether they decode to the text."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    model = spark.sparkContext.broadcast(Path(model_path).read_bytes())
    names = [f"k{i}" for i in range(len(keep))]
    held = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)], F.coalesce("text", F.lit("")).alias("_t"))
    big = F.length("_t") > giant
    key = F.when(big, F.sha2(F.col("_t").cast("binary"), 256))
    large = _giants(held.filter(big).select(key.alias("_key"), "_t").dropDuplicates(["_key"]), model, kind, chunk)
    rest = held.filter(~big).withColumn("_ids", F.lit(None).cast("array<int>"))
    known = held.filter(big).withColumn("_key", key).join(large, "_key").select(*names, "_t", "_ids")
    rows = rest.union(known)
    schema = type(rows.schema)(list(rows.schema.fields[:-2])).add("ids", rows.schema["_ids"].dataType).add("round_trip", "boolean", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value, kind)
        for batch in batches:
            texts = batch.column("_t").to_pylist()
            given = batch.column("_ids")
            got = [given[i].as_py() if given[i].is_valid else _whole(v, t) for i, t in enumerate(texts)]
            same = [v.library.decode(ids) == t.replace(SPACE, " ") for ids, t in zip(got, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], _lists(got), pa.array(same, pa.bool_())], names=[*names, "ids", "round_trip"])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "ids", "round_trip")


def decode(rows: DataFrame, *keep: str, model_path: str = MODEL) -> DataFrame:
    """The columns of `keep` with text, from ids; null ids give null."""
    small_batches(rows.sparkSession, 500)
    model = rows.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    names = [f"k{i}" for i in range(len(keep))]
    held = rows.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)], F.col("ids").cast("array<int>").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value, "bpe")
        for batch in batches:
            texts = [None if x is None else v.library.decode(x) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*names, "text"])

    out = held.mapInArrow(run, type(held.schema)(list(held.schema.fields[:-1])).add("text", "string"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "text")


def digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids, joined by commas), ids and round_trip."""
    out = encode(documents(spark, sf_dir), "doc_id")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), "ids", "round_trip")

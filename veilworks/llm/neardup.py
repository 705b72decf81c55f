"""MinHash near-deduplication by bottom-k sketches from one hash function.

A document's set holds the hashes of its five-word shingles; its sketch is the `SKETCH` least of them. Equal sets form
a class, so that copies cost one row. Inverted lists of the `INDEXED` least values of each class, less its `COMMON`
commonest ones, give candidates: classes that share more than `COMMON` values share one that both keep, as rarity is
the same order for both. So a line or passage that many documents hold makes no list of its own. Each
list is first met as a star, every member against its least member, which is linear in the list. Pairs are estimated
from the `SKETCH` least values of the union of their sketches; those that may reach the threshold are verified on full
sets, and what holds makes components. Lists whose members still lie in several components are then met whole: such a
list is dealt into cells of bounded blocks, each block against each. A cell first yields a forest of its most similar
pairs of different components, which are verified and mostly join what belongs together; then, in what is left, all
pairs of different components whose estimate may reach the threshold, and those are verified too. No list is cut.

Two documents at the threshold share at most `COMMON` of their `INDEXED` least values with a chance of 4e-7, and the
estimate falls short by `ERRORS` standard errors as seldom; sets of up to `SKETCH` shingles are compared exactly.
Sketches hold the upper halves of the 64-bit hashes, lists and sets the hashes.

Texts of classes with a list are dealt out once, by class, to a table that all verifications read; tables go as soon as
nothing reads them any more.

Cases: null or empty text, or text without words: an empty set, linked with nothing, a component of its own; rows that
repeat are copies of each other; a null doc_id can't name a component but joins it (alone its component_id is null and
it is kept); an empty table gives an empty result; further columns stay in `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilworks.llm.common import documents, drop, shingles, slabs, small_batches, text_buffers, written
from veilworks.llm.graph import components

WIDTH = 5
#: At least PART / WHOLE of the union.
PART, WHOLE = 75, 100
SKETCH = 256
INDEXED = 24
#: Of its indexed values each class leaves out so many that are the commonest: fewer if it is so small that a linked
#: pair shares fewer.
COMMON = 6
#: Standard errors by which an estimate may fall short.
ERRORS = 5.0
#: Classes of a block, pairs that are compared at once, the size of a cell that needs no filter, least values of the
#: filter and columns of its matrices, and pairs of a hub that one task verifies together.
BLOCK = 1024
STRIP = 256
SMALL = 24
FILTER, COLUMNS = 64, 1024
SALT = 400


def text_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_buffers(column)
    for i, j in slabs(offsets):
        found, at = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
        for k in range(j - i):
            part = np.sort(found[at[k] : at[k + 1]])
            if len(part) > 1:
                fresh = np.empty(len(part), bool)
                fresh[0] = True
                np.not_equal(part[1:], part[:-1], out=fresh[1:])
                part = part[fresh]
            yield part


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _name(part: np.ndarray) -> int:
    """64 bits that name a set; 0 is the empty one."""
    return (xxhash.xxh3_64_intdigest(part.tobytes()) >> 1) + 1 if len(part) else 0


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count, name, sketch, first = [], [], [], []
        for part in text_sets(batch.column("_t")):
            count.append(len(part))
            name.append(_name(part))
            sketch.append((part[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes())
            first.append(part[:INDEXED].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(count, pa.int64()), pa.array(name, pa.int64()), _binary(sketch), _binary(first)], names=["doc_id", "text_key", "n_shingles", "node", "sketch", "least"])


def text_key() -> Column:
    """Length and hash of the text, which name it among rows of one doc_id."""
    return F.struct(F.coalesce(F.length("text"), F.lit(-1)).alias("length"), F.xxhash64("text").alias("hash"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, node (the class of equal sets, 0 for none), sketch and least, the indexed values."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("_t"))
    return rows.mapInArrow(_sketch, "doc_id long, text_key struct<length: int, hash: long>, n_shingles long, node long, sketch binary, least binary")


_NONE = np.uint32(0xFFFFFFFF)


def table(rows: list[bytes], width: int = SKETCH, kind: type = np.uint32) -> np.ndarray:
    """Values as rows, filled up with the greatest value, which no set holds."""
    out = np.full((len(rows), width), np.iinfo(kind).max, kind)
    for i, raw in enumerate(rows):
        part = np.frombuffer(raw, kind)
        out[i, : len(part)] = part
    return out


def estimates(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of rows: exact if the sketches hold both sets, else from the SKETCH least values of
    the union of the sketches."""
    both = np.concatenate([a, b], 1)
    both.sort(1)
    there = both != _NONE
    twice = (both[:, 1:] == both[:, :-1]) & there[:, 1:]
    fresh = there.copy()
    fresh[:, 1:] &= ~twice
    rank = np.cumsum(fresh, 1, dtype=np.int32)
    seen = np.where(np.maximum(n_a, n_b) <= SKETCH, 2 * SKETCH, SKETCH)
    match = (twice & (rank[:, 1:] <= seen[:, None])).sum(1)
    return match / np.maximum(np.minimum(rank[:, -1], seen), 1)


def lowest(n_a: np.ndarray, n_b: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The estimate that a pair at the threshold still reaches: it samples `size` of the union's values."""
    at = PART / WHOLE
    union = np.maximum((n_a + n_b) / (1 + at), 1)
    error = np.sqrt(at * (1 - at) / size * np.maximum(1 - size / union, 0))
    return np.where(np.maximum(n_a, n_b) <= size, at - 1e-9, at - ERRORS * error - 1 / size)


def promising(score: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Pairs that may link by their estimate and sizes."""
    return (score >= lowest(n_a, n_b)) & (np.minimum(n_a, n_b) * WHOLE >= PART * np.maximum(n_a, n_b))


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both sketches, those that may link."""
    for batch in batches:
        n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        score = estimates(table(batch.column("sketch_a").to_pylist()), n_a, table(batch.column("sketch_b").to_pylist()), n_b)
        yield batch.select(["a", "b"]).filter(pa.array(promising(score, n_a, n_b), pa.bool_()))


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The indexed values of each class, and how many of the commonest it can spare."""
    for batch in batches:
        parts = [np.frombuffer(x, np.int64) for x in batch.column("least").to_pylist()]
        sizes = [len(x) for x in parts]
        n = batch.column("n_shingles").to_numpy()
        spare = np.minimum(COMMON, -(-PART * n // WHOLE) - 1)
        names = {"value": np.concatenate([*parts, np.zeros(0, np.int64)]), "node": np.repeat(batch.column("node").to_numpy(), sizes), "spare": np.repeat(spare, sizes)}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in names.items()})


def kept_values(classes: DataFrame) -> DataFrame:
    """(value, node): the values that a class shares with another, less the commonest that it can spare."""
    values = classes.select("node", "least", "n_shingles").mapInArrow(_values, "value long, node long, spare long")
    lists = values.groupBy("value").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("members"), F.desc("value")))  # INDEXED rows
    return values.join(lists, "value").withColumn("rank", rank).filter("rank > spare").select("value", "node")


def _with_sketches(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}"), F.col("n_shingles").alias(f"n_{side}")), side)
    return pairs.mapInArrow(_promising, "a long, b long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hub, salt, node and full set; a row is dropped whose text is not of the class that it was joined for."""
    for batch in batches:
        keep, found = [], []
        nodes = batch.column("node").to_pylist()
        for i, part in enumerate(text_sets(batch.column("_t"))):
            if _name(part) == nodes[i]:
                keep.append(i)
                found.append(part.tobytes())
        rows = batch.select(["hub", "salt", "node"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, _binary(found)], names=["hub", "salt", "node", "set"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (hub, salt), the hub's own first; its set is held while its pairs pass."""
    at, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        hubs, salts, nodes = (batch.column(c).to_pylist() for c in ("hub", "salt", "node"))
        sets = batch.column("set").to_pylist()
        a, b = [], []
        for hub, salt, node, raw in zip(hubs, salts, nodes, sets, strict=True):
            part = np.frombuffer(raw, np.uint64)
            if (hub, salt) != at:
                at, own = (hub, salt), np.zeros(0, np.uint64)
            if node == hub:
                own = part
                continue
            same = len(np.intersect1d(own, part, assume_unique=True))
            if WHOLE * same >= PART * (len(own) + len(part) - same):
                a.append(hub)
                b.append(node)
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def bodies(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """node and _t, the text that stands for each class: that of its row `at`, a doc_id and text_key."""
    at = classes.select("node", F.col("at.doc_id").alias("_id"), F.col("at.text_key.length").alias("_length"), F.col("at.text_key.hash").alias("_hash"))
    texts = docs.select("doc_id", text_key().alias("_key"), F.coalesce("text", F.lit("")).alias("_t"))
    same = texts["doc_id"].eqNullSafe(at["_id"]) & (texts["_key.length"] == at["_length"]) & (texts["_key.hash"] == at["_hash"])
    return texts.join(at, same).select("node", "_t").dropDuplicates(["node"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets link. texts: of bodies.

    Texts meet the pairs that name them; one set travels for each pair to its hub's task, and a hub's own set to each
    of its salted parts, so that a hub with many pairs is split.
    """
    parts = pairs.select(F.col("a").alias("hub"), F.col("b").alias("node"))
    spread = parts.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("parts"))
    parts = parts.join(spread, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("salt"), "node")
    own = spread.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("hub").alias("node"))
    sets = texts.join(parts.union(own), "node").select("hub", "salt", "node", "_t").mapInArrow(_sets, "hub long, salt int, node long, set binary")
    order = [F.col("hub"), F.col("salt"), (F.col("node") != F.col("hub"))]
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sets.repartition(n, "hub", "salt").sortWithinPartitions(*order).mapInArrow(_verify, "a long, b long").distinct()


class Cell:
    """One cell of a list: a block with itself, or one block with another."""

    def __init__(self, node: np.ndarray, root: np.ndarray, block: np.ndarray, n: np.ndarray, sketch: list[bytes], kept: list[np.ndarray], value: int, first: int, second: int):
        order = np.argsort(node, kind="stable")
        self.node, self.root, self.block, self.n = node[order], root[order], block[order], n[order]
        self.sets = table([sketch[i] for i in order])
        self.kept = table([kept[i] for i in order], INDEXED, np.int64)
        self.own, self.first, self.second = value, first, second

    def _far(self, i: int, j: int) -> np.ndarray:
        """Pairs of rows i to j with all rows: of different components, of the cell's blocks, each once."""
        side, other = self.block[i:j, None], self.block[None, :]
        both = (side == self.first) & (other == self.second) | (side == self.second) & (other == self.first)
        return both & (self.root[i:j, None] != self.root[None, :]) & (self.node[i:j, None] < self.node[None, :])

    def _shared(self) -> np.ndarray | None:
        """How many of the FILTER least values each two rows share, by products of 0/1 matrices over bounded numbers of
        the values that occur twice; None for a small cell."""
        if len(self.sets) <= SMALL:
            return None
        values, code, count = np.unique(self.sets[:, :FILTER], return_inverse=True, return_counts=True)
        code = code.reshape(-1, FILTER)
        wanted = (count > 1) & (values != _NONE)
        column = np.cumsum(wanted) - 1
        at, place = np.nonzero(wanted[code])
        column = column[code[at, place]]
        out = np.zeros((len(self.sets), len(self.sets)), np.float32)
        for low in range(0, int(wanted.sum()), COLUMNS):
            here = (column >= low) & (column < low + COLUMNS)
            held = np.zeros((len(self.sets), COLUMNS), np.float32)
            held[at[here], column[here] - low] = 1
            out += held @ held.T
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of candidates and their estimates.

        A pair is looked at only in the list of the least value that both keep, so it comes from one list: one that
        either leaves out has not both of them. In cells that are not small, pairs that share too few of their least
        values go first.
        """
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        shared = self._shared()
        for i in range(0, len(self.sets), STRIP):
            j = min(len(self.sets), i + STRIP)
            far = self._far(i, j)
            if shared is not None:
                far &= shared[i:j] >= np.minimum(np.maximum.outer(self.n[i:j], self.n), FILTER) * lowest(self.n[i:j, None], self.n[None, :], FILTER) - 1e-3
            x, y = np.nonzero(far)
            x += i
            for k in range(0, len(x), STRIP):
                p, q = x[k : k + STRIP], y[k : k + STRIP]
                same = (self.kept[p][:, :, None] == self.kept[q][:, None, :]).any(2)
                lead = self.kept[p, same.argmax(1)]
                here = same.any(1) & (lead == self.own)
                p, q = p[here], q[here]
                score = estimates(self.sets[p], self.n[p], self.sets[q], self.n[q])
                good = promising(score, self.n[p], self.n[q])
                out.append((p[good], q[good], score[good]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        p, q, _ = self.pairs()
        return self.node[p], self.node[q]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the candidates a forest of greatest estimates that joins components; fewer pairs than rows."""
        p, q, score = self.pairs()
        order = np.argsort(-score, kind="stable")
        p, q = p[order], q[order]
        parent = {r: r for r in self.root.tolist()}

        def top(r: int) -> int:
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        keep, left = [], len(parent) - 1
        for k, (x, y) in enumerate(zip(self.root[p].tolist(), self.root[q].tolist(), strict=True)):
            x, y = top(x), top(y)
            if x != y:
                parent[x] = y
                keep.append(k)
                left -= 1
                if not left:
                    break
        return self.node[p[keep]], self.node[q[keep]]


def _lists(column: pa.Array) -> list[np.ndarray]:
    return np.split(column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())[:-1]) if len(column) else []


def _cells(how: str):
    """Rows come by cell; a cell, which is bounded, is held at a time."""
    names = ("node", "root", "block", "n_shingles", "sketch", "kept", "value", "first", "second")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []

        def flush(out: tuple[list, list]) -> None:
            if not held:
                return
            node, root, block, n = (np.concatenate([h[c] for h in held]) for c in range(4))
            if len(node) > 1:
                cell = Cell(node, root, block, n, [x for h in held for x in h[4]], [x for h in held for x in h[5]], *(int(held[0][c][0]) for c in (6, 7, 8)))
                a, b = getattr(cell, how)()
                out[0].append(a)
                out[1].append(b)
            held.clear()

        def made(out: tuple[list, list]) -> pa.RecordBatch:
            a, b = (np.concatenate([*c, np.zeros(0, np.int64)]) for c in out)
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            columns = [batch.column(c).to_pylist() if c == "sketch" else _lists(batch.column(c)) if c == "kept" else batch.column(c).to_numpy() for c in names]
            keys = np.stack(columns[6:], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            out: tuple[list, list] = ([], [])
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if held and any(int(held[0][c][0]) != int(columns[c][i]) for c in (6, 7, 8)):
                    flush(out)
                held.append([c[i:j] for c in columns])
            yield made(out)
        out = ([], [])
        flush(out)
        yield made(out)

    return run


def rest_pairs(postings: DataFrame, labels: DataFrame, classes: DataFrame, how: str) -> DataFrame:
    """Candidates between components that share a list, from cells of bounded blocks; how: forest or all. kept: the
    values of a class that postings have."""
    rows = postings.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = rows.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members")).filter("low < high")
    open_ = open_.select("value", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(open_, "value").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("value", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "node", "root", "block")
    cells = cells.join(classes.select("node", "sketch", "kept", "n_shingles"), "node")
    n, key = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["value", "first", "second"]
    return cells.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(_cells(how), "a long, b long").distinct()


def link(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between classes, and the label (node, root) of every class that has one. classes: of class_rows,
    written; the table goes."""
    values = written(kept_values(classes), "values")
    lists = values.groupBy("value").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    postings = written(values.join(lists.select("value", "hub"), "value"), "postings")
    kept = postings.groupBy("node").agg(F.sort_array(F.collect_list("value")).alias("kept"))  # INDEXED at most
    listed = written(classes.drop("least").join(kept, "node"), "listed")
    drop(values, classes)
    texts = written(bodies(docs, listed.select("node", "at")), "bodies")
    stars = postings.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    stars = written(_with_sketches(stars, listed), "pairs")
    links = written(verified(stars, texts), "links")
    labels, tested = components(links), stars
    for how in ("forest", "all"):
        rest = written(rest_pairs(postings.select("value", "node"), labels, listed, how).join(tested, ["a", "b"], "left_anti"), "pairs")
        more = written(verified(rest, texts), "links")
        tested = tested.union(rest)
        if more.limit(1).count():
            links = links.union(more)
            labels = components(links)
    drop(postings, listed, texts)
    return links, labels


def class_rows(rows: DataFrame) -> DataFrame:
    """A row for each class of equal sets, the empty one left out; at names the row whose text stands for it."""
    first = [F.first(c).alias(c) for c in ("sketch", "least", "n_shingles")]
    return rows.filter("node <> 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("at"), *first)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, node, component_id and kept of every document."""
    made = written(sketches(docs), "sketches")
    rows = written(made.select("doc_id", "text_key", "n_shingles", "node"), "rows")
    classes = written(class_rows(made), "classes")
    drop(made)
    _, labels = link(docs.select("doc_id", "text"), classes)
    rooted = rows.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.filter("root <> 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = rooted.join(names, "root", "left")
    component = F.when(F.col("root") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "text_key", "n_shingles", "node", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that are their component's first; of rows with the same doc_id and class one stays, that of the
    shortest text. Rows with the same doc_id, or none, and different texts are told apart by their texts."""
    columns = docs.columns
    texts = deduplicated(docs).filter("kept").groupBy("doc_id", "node", "text_key").agg(F.count(F.lit(1)).alias("n"))
    chosen = texts.groupBy("doc_id", "node").agg(F.min(F.struct("text_key", "n")).alias("x"))
    verdict = chosen.select(F.col("doc_id").alias("_id"), "x.text_key.length", "x.text_key.hash", F.col("x.n").alias("_n"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "doc_id", text_key().alias("_key"))
    same = held["doc_id"].eqNullSafe(verdict["_id"]) & (held["_key.length"] == verdict["length"]) & (held["_key.hash"] == verdict["hash"])
    kept = held.join(verdict, same)
    # only rows that repeat need a choice
    single = kept.filter("_n = 1").select("_row.*")
    several = kept.filter("_n > 1").groupBy("doc_id", "_key").agg(F.first("_row").alias("_row")).select("_row.*")
    return single.unionByName(several)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_shingles", "component_id", "kept")


#: Words and sets as they stand; pairs share a shingle, which every linked pair does.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

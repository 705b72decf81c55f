"""Secret scans with linking of multipart credentials, in DataFrame operations only.

Base kinds are found by pattern. Weak parts are found too: identifiers (user names, client ids), endpoints (addresses
of services) and bare high-entropy tokens. A weak part is reported only if its complement lies within `SCOPE` code
points: a bare token needs an identifier, an identifier needs a secret, an endpoint needs both. Access keys count as
identifiers, assigned and hex values and bare tokens as secrets. The interval join runs inside each row, as one sweep
over its sorted parts in each direction, so nothing is shuffled and no pairs are made.

Spans are [start, end) in code points. Cases: null text counts as empty; empty text has no spans and its digest is that
of the empty string; rows are scanned one by one; an empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.llm.common import documents

SCOPE = 200
#: Kinds in the order in which they are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"""AKIA[A-Z0-9]{16,}""",
    "hex": r"""[0-9a-f]{24,}""",
    "ident": r"""(?i:\b(?:user(?:_?name|_?id)?|login|client_?id|account_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    "weak": r"""(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}""",
    "endpoint": r"""\bhttps?://[^\s"'<>]+|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?\b""",
}
#: Cheap conditions without which a pattern can't match.
GUARDS = {
    "assign": "(contains(_t, '=') or contains(_t, ':')) and (contains(_c, 'passw') or contains(_c, 'secret') or contains(_c, 'token') or contains(_c, 'api'))",
    "access": "contains(_t, 'AKIA')",
    "hex": "_t rlike r'[0-9a-f]{24}'",
    "weak": "_t rlike r'[A-Za-z0-9+/_-]{20}'",
    "ident": "(contains(_t, '=') or contains(_t, ':')) and (contains(_c, 'user') or contains(_c, 'login') or contains(_c, 'client') or contains(_c, 'account'))",
    "endpoint": "contains(_t, '://') or _t rlike r'[0-9]\\.[0-9]{1,3}\\.[0-9]'",
}
_SPANS = "array<struct<s:int,e:int,k:int>>"


#: Items that are folded at a time; the states of these blocks are folded in turn, so that no long array is copied for
#: each of its items.
STEP = 64


def _running(items: str, kind: str, start: str, step: str, merge: str) -> str:
    """SQL: for each item the fold of those before it, of type `kind`. step: of acc and x; merge: of two states h, a."""
    none = f"cast(array() as array<{kind}>)"
    blocks = f"""transform(sequence(0, (size({items}) - 1) div {STEP}), j -> aggregate(slice({items}, cast(j * {STEP} + 1 as int), {STEP}), named_struct('a', {start}, 'o', {none}),
        (z, x) -> transform(array(z.a), acc -> named_struct('a', {step}, 'o', concat(z.o, array(acc))))[0]))"""
    heads = f"""aggregate(y, named_struct('a', {start}, 'o', {none}), (z, w) -> transform(array(named_struct('h', z.a, 'a', w.a)), v -> transform(array(v.h), h -> transform(array(v.a), a -> named_struct('a', {merge}, 'o', concat(z.o, array(h))))[0])[0])[0]).o"""
    return f"transform(array({blocks}), y -> flatten(zip_with(y, {heads}, (w, h) -> transform(w.o, a -> {merge}))))[0]"


def _spans(kind: str) -> F.Column:
    """Matches with their places: the text between matches and the matches, in turn, add up to the offsets."""
    k, longest = KINDS.index(kind), 6 if kind == "assign" else 0
    lengths = f"transform(_{kind}_m, (x, i) -> length(_{kind}_b[i]) + length(x))"
    ends = f"transform(array(transform(array({lengths}), n -> {_running('n', 'int', '0', 'acc + x', 'h + a')})[0]), p -> transform(_{kind}_m, (x, i) -> p[i] + length(_{kind}_b[i]) + length(x)))[0]"
    keep = f"filter(transform(e, (x, i) -> named_struct('s', x - length(_{kind}_m[i]), 'e', x, 'k', {k})), (x, i) -> {f'length(_{kind}_v[i]) >= {longest}' if longest else 'true'})"
    return F.expr(f"if(size(_{kind}_m) = 0, cast(array() as {_SPANS}), transform(array({ends}), e -> {keep})[0])")


def _found(df: DataFrame, held: list[str], kinds: tuple[str, ...], condition: str = "true") -> DataFrame:
    """Adds _x_<kind>, the spans of each kind, where the condition and the kind's guard hold."""
    names = {k: PATTERNS[k].replace("'", r"\x27") for k in kinds}
    df = df.select(*held, *[F.expr(f"({condition}) and ({GUARDS[k]})").alias(f"_{k}_on") for k in kinds])
    for kind, p in names.items():
        df = df.withColumn(f"_{kind}_m", F.expr(f"if(_{kind}_on, regexp_extract_all(_t, r'{p}', 0), cast(array() as array<string>))"))
        df = df.withColumn(f"_{kind}_b", F.expr(f"if(_{kind}_on, split(_t, r'{p}'), cast(array() as array<string>))"))
        if kind == "assign":
            df = df.withColumn(f"_{kind}_v", F.expr(f"if(_{kind}_on, regexp_extract_all(_t, r'{p}', 2), cast(array() as array<string>))"))
    return df.select(*held, *[_spans(k).alias(f"_x_{k}") for k in kinds])


def scan(docs: DataFrame, *keep: str, scope: int = SCOPE) -> DataFrame:
    """The columns of `keep`, the text as _t, and spans: array of (s, e, k), k being a place in KINDS."""
    held = [f"`{c}`" for c in keep] + ["_t"]
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.expr("coalesce(text, '')").alias("_t"))
    low = df.withColumn("_c", F.lower("_t"))
    df = _found(low, held + ["_c"], ("assign", "access", "hex", "weak"))
    bases = ["_x_assign", "_x_access", "_x_hex"]
    # identifiers and endpoints matter only where a secret is, of whatever kind
    df = _found(df, held + bases + ["_x_weak"], ("ident", "endpoint"), "size(_x_assign) + size(_x_access) + size(_x_hex) + size(_x_weak) > 0")
    parts = "array_sort(concat(_x_assign, _x_access, _x_hex, _x_weak, _x_ident, _x_endpoint))"
    df = df.select(*held, F.expr(f"concat({', '.join(bases)})").alias("_base"), F.expr(f"if(size(_x_weak) + size(_x_ident) + size(_x_endpoint) = 0, cast(array() as {_SPANS}), {parts})").alias("_parts"))
    far = -(1 << 30)

    def sweep(parts: str, edge: str, past: str, pick: str) -> str:
        """For each part the nearest edge so far of an identifier, a secret and a base span."""
        role = lambda name, kinds: f"if(x.k in ({kinds}), {pick}(acc.{name}, {edge}), acc.{name})"
        start = f"named_struct('i', {past}, 'c', {past}, 'b', {past})"
        step = f"named_struct('i', {role('i', '1, 3')}, 'c', {role('c', '0, 2, 4')}, 'b', {role('b', '0, 1, 2')})"
        merge = f"named_struct('i', {pick}(h.i, a.i), 'c', {pick}(h.c, a.c), 'b', {pick}(h.b, a.b))"
        return _running(parts, "struct<i:int,c:int,b:int>", start, step, merge)

    df = df.select(*held, "_base", "_parts", F.expr("reverse(_parts)").alias("_back"))
    df = df.select(*held, "_base", "_parts", F.expr(sweep("_parts", "x.e", str(far), "greatest")).alias("_before"), F.expr(sweep("_back", "x.s", str(-far), "least")).alias("_after"))
    last = "_after[size(_parts) - 1 - i]"
    near = lambda r: f"(x.s - _before[i].{r} <= {scope} or {last}.{r} - x.e <= {scope})"
    linked = f"(x.k = 4 and {near('i')}) or (x.k = 3 and {near('c')}) or (x.k = 5 and {near('i')} and {near('c')})"
    free = f"_before[i].b <= x.s and {last}.b >= x.e"
    added = f"filter(_parts, (x, i) -> x.k > 2 and {free} and ({linked}))"
    return df.select(*held, F.expr(f"array_sort(transform(concat(_base, {added}), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e)))").alias("spans"))


def joined(spans: str) -> str:
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat({kinds}[x.k], ':', x.s, ':', x.e)), ',')"


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The columns of docs, in order, with every reported span of text replaced; null text stays null."""
    columns = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "text")
    df = scan(row, "_row")
    df = df.withColumn("_past", F.expr(f"if(size(spans) = 0, null, {_running('spans', 'int', '0', 'greatest(acc, x.e)', 'greatest(h, a)')})"))
    pieces = f"transform(spans, (x, i) -> if(x.e > _past[i] and x.s >= _past[i], concat(substring(_t, _past[i] + 1, x.s - _past[i]), '{mark}'), ''))"
    clean = F.expr(f"if(size(spans) = 0, _row.text, concat(array_join({pieces}, ''), substring(_t, greatest(_past[size(spans) - 1], spans[size(spans) - 1].e) + 1)))")
    return df.select(*[clean.alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and n_linked, the parts that are reported only because their complements are near."""
    df = scan(documents(spark, sf_dir), "doc_id")
    count = lambda k: F.expr(f"cast(size(filter(spans, x -> x.k = {k})) as bigint)")
    return df.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.expr(f"sha2({joined('filter(spans, x -> x.k < 3)')}, 256)").alias("base_sha256"), F.expr(joined("spans")).alias("spans"), (F.size("spans").cast("long") - count(0) - count(1) - count(2)).alias("n_linked"),
    )

"""Keyed hashes and sealed values from built-in functions. Keys are 32 bytes and come from the caller.

A key is either a literal of the plan, as in `hmac_sha256`, or, as `with_key` gives it, a column of a table of one row, so
that plans, event logs and the interface show its name only.
"""

from __future__ import annotations

import base64
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_BYTES = 32
#: Columns that `with_key` adds.
KEY_COLUMNS = ("_seal_key", "_inner_pad", "_outer_pad")


def checked_key(encoded: str) -> bytes:
    key = base64.b64decode(encoded, validate=True)
    if len(key) != KEY_BYTES:
        raise ValueError(f"the key has {len(key)} bytes, not {KEY_BYTES}")
    return key


def fresh_key() -> bytes:
    return os.urandom(KEY_BYTES)


def _pads(key: bytes) -> tuple[bytes, bytes]:
    block = key.ljust(64, b"\0")
    return tuple(bytes(b ^ pad for b in block) for pad in (0x36, 0x5C))


def _hmac(inner: Column, outer: Column, message: Column) -> Column:
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hexadecimal HMAC-SHA256 of a string column."""
    inner, outer = (F.lit(pad) for pad in _pads(key))
    return _hmac(inner, outer, message)


def forward_field(key: bytes, kind: Column, mapping_key: Column) -> Column:
    return F.concat(F.lit("fwd:"), hmac_sha256(key, F.concat_ws("|", kind, mapping_key)))


def seal(value: Column, key: bytes) -> Column:
    """AES-GCM: 12 bytes of nonce, the text, 16 bytes of tag."""
    return F.aes_encrypt(value.cast("binary"), F.lit(key), F.lit("GCM"))


def unseal(value: Column, key: bytes) -> Column:
    return F.aes_decrypt(value, F.lit(key), F.lit("GCM")).cast("string")


# ---------------------------------------------------------------- keys as columns


def with_key(df: DataFrame, key: bytes) -> DataFrame:
    """df with KEY_COLUMNS, from a table of one row that meets every row."""
    if len(key) != KEY_BYTES:
        raise ValueError(f"the key has {len(key)} bytes, not {KEY_BYTES}")
    inner, outer = _pads(key)
    one = df.sparkSession.createDataFrame([(bytearray(key), bytearray(inner), bytearray(outer))], ", ".join(f"{c} binary" for c in KEY_COLUMNS))
    return df.join(F.broadcast(one), how="cross")


def keyed_hash(message: Column) -> Column:
    """hmac_sha256 of rows of `with_key`."""
    return _hmac(F.col(KEY_COLUMNS[1]), F.col(KEY_COLUMNS[2]), message)


def sealed(value: Column, of: Column) -> Column:
    """The value sealed with the key of `with_key`; it opens only for the same `of`. Null stays null."""
    return F.aes_encrypt(value.cast("binary"), F.col(KEY_COLUMNS[0]), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.coalesce(of, F.lit("")).cast("binary"))


def opened(value: Column, of: Column) -> Column:
    return F.aes_decrypt(value, F.col(KEY_COLUMNS[0]), F.lit("GCM"), F.lit("DEFAULT"), F.coalesce(of, F.lit("")).cast("binary")).cast("string")

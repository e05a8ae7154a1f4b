"""Hashes that Spark lacks, as Arrow-batched columns: keyed SipHash-2-4 and FNV-1a, both 64 bits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1
#: The four words that SipHash starts from, FNV's offset and prime.
SIP_START = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def _turn(x: int, n: int) -> int:
    return ((x << n) | (x >> (64 - n))) & _MASK


def _mixed(v: list[int], rounds: int) -> None:
    for _ in range(rounds):
        v[0], v[2] = (v[0] + v[1]) & _MASK, (v[2] + v[3]) & _MASK
        v[1], v[3] = _turn(v[1], 13) ^ v[0], _turn(v[3], 16) ^ v[2]
        v[0] = _turn(v[0], 32)
        v[2], v[0] = (v[2] + v[1]) & _MASK, (v[0] + v[3]) & _MASK
        v[1], v[3] = _turn(v[1], 17) ^ v[2], _turn(v[3], 21) ^ v[0]
        v[2] = _turn(v[2], 32)


def siphash(key: bytes, data: bytes) -> int:
    if len(key) != 16:
        raise ValueError("the key must have 16 bytes")
    keys = int.from_bytes(key[:8], "little"), int.from_bytes(key[8:], "little")
    v = [s ^ keys[i % 2] for i, s in enumerate(SIP_START)]
    whole = len(data) // 8 * 8
    words = [int.from_bytes(data[i : i + 8], "little") for i in range(0, whole, 8)]
    for word in [*words, int.from_bytes(data[whole:], "little") | (len(data) & 0xFF) << 56]:
        v[3] ^= word
        _mixed(v, 2)
        v[0] ^= word
    v[2] ^= 0xFF
    _mixed(v, 4)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for byte in data:
        h = ((h ^ byte) * FNV_PRIME) & _MASK
    return h


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def block_id(child_id: Column, key: bytes) -> Column:
    """The 64-bit id of a child's block, which only holders of the key can work out."""

    @F.pandas_udf("long")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _signed(siphash(key, x.encode())) for x in ids], dtype="Int64")

    return run(child_id)


def fnv64(value: Column) -> Column:
    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _signed(fnv1a(x.encode())) for x in values], dtype="Int64")

    return run(value)

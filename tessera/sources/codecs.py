"""Binary forms: block records with a checksum, sparse vectors, content hashes."""

from __future__ import annotations

import struct
import zlib

MAGIC, VERSION, HEADER = b"TSBL", 1, struct.Struct("<4sHHIQQI")


def encode_block(block_type: int, flags: int, doc: int, created_us: int, payload: bytes) -> bytes:
    """Header (magic, version, type, flags, document, time, length), payload, CRC32 of both."""
    body = HEADER.pack(MAGIC, VERSION, block_type, flags, doc, created_us, len(payload)) + payload
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(raw: bytes) -> tuple[int, int, int, int, bytes]:
    if len(raw) < HEADER.size + 4:
        raise ValueError("a block is cut short")
    magic, version, block_type, flags, doc, created_us, n = HEADER.unpack_from(raw)
    if magic != MAGIC or version != VERSION or len(raw) != HEADER.size + n + 4:
        raise ValueError("not a block of this version")
    if struct.unpack_from("<I", raw, len(raw) - 4)[0] != zlib.crc32(raw[:-4]):
        raise ValueError("a block's checksum is wrong")
    return block_type, flags, doc, created_us, raw[HEADER.size : -4]


def encode_sparse(vector: dict[int, float]) -> bytes:
    """Little-endian count, then (term, weight) in term order."""
    if len(vector) > 0xFFFF or any(not 0 <= t <= 0xFFFF for t in vector):
        raise ValueError("a sparse vector is too large")
    return struct.pack("<H", len(vector)) + b"".join(struct.pack("<Hf", t, w) for t, w in sorted(vector.items()))


def decode_sparse(raw: bytes) -> dict[int, float]:
    if len(raw) < 2 or len(raw) != 2 + 6 * struct.unpack_from("<H", raw)[0]:
        raise ValueError("a sparse vector has the wrong length")
    return dict(struct.iter_unpack("<Hf", raw[2:]))

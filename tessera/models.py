"""Seams for models, with deterministic stand-ins.

The stand-ins make pipelines runnable and testable; nothing is claimed of their quality.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from functools import lru_cache
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, query: str, passages: list[str]) -> list[float]: ...


@lru_cache(maxsize=1 << 16)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


class HashingEmbedder:
    """Signed feature hashing of words, unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, t in zip(out, texts, strict=True):
            words = re.findall(r"\w+", (t or "").lower())
            h = np.fromiter(map(_word_hash, words), np.uint64, len(words))
            row += np.bincount((h % np.uint64(self.dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), self.dim)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class OverlapReranker:
    """Share of the query's words that a passage has."""

    def score(self, query: str, passages: list[str]) -> list[float]:
        asked = set(re.findall(r"\w+", query.lower()))
        return [len(asked & set(re.findall(r"\w+", p.lower()))) / max(1, len(asked)) for p in passages]


def embedding(model: Embedder) -> Callable[[Column], Column]:
    """A column function, Arrow batch by Arrow batch."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model.embed([t or "" for t in texts])))

    return run


def rerank_score(model: Reranker) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("double")
    def run(query: pd.Series, passage: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=query.index)
        for q, rows in passage.groupby(query):
            out[rows.index] = model.score(q, list(rows))
        return out

    return run


class WordPiece:
    """Basic cleaning, CJK padding, lower case without accents, then the longest pieces first."""

    def __init__(self, vocabulary: list[str], unknown: str = "[UNK]", prefix: str = "##", longest: int = 100):
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.unknown, self.prefix, self.longest = unknown, prefix, longest

    def words(self, text: str) -> list[str]:
        import unicodedata

        out = []
        for c in unicodedata.normalize("NFD", text.lower()):
            kind = unicodedata.category(c)
            if kind == "Mn" or c in "\x00�" or (kind.startswith("C") and not c.isspace()):
                continue
            alone = kind.startswith("P") or 0x4E00 <= ord(c) <= 0x9FFF or (c.isascii() and not c.isalnum() and not c.isspace())
            out.append(f" {c} " if alone else c)
        return "".join(out).split()

    def encode(self, text: str) -> list[int]:
        out = []
        for word in self.words(text):
            parts, at = [], 0
            while at < len(word) and parts is not None and len(word) <= self.longest:
                for end in range(len(word), at, -1):
                    piece = (self.prefix if at else "") + word[at:end]
                    if piece in self.ids:
                        parts.append(self.ids[piece])
                        at = end
                        break
                else:
                    parts = None
            out += parts if parts and at == len(word) else [self.ids[self.unknown]]
        return out


def parse_batch_answer(answer: str, n: int, fields: dict[str, Any]) -> list[tuple[int, dict[str, Any]]]:
    """(level, values) of each of n blocks from a model's batch answer.

    Level 0 is complete, 1 has defaults for missing fields, 2 is missing, 3: nothing could
    be read. Indexes may come as strings; stray backslashes are repaired.
    """
    found = re.search(r"\[.*\]", answer or "", re.S)
    items = None
    for body in (found[0], re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", found[0])) if found else ():
        try:
            items = json.loads(body)
            break
        except ValueError:
            continue
    if not isinstance(items, list):
        return [(3, dict(fields))] * n
    by_index: dict[int, dict] = {}
    for item in items:
        if isinstance(item, dict) and str(item.get("index", "")).lstrip("-").isdigit():
            by_index[int(item["index"])] = item
    out = []
    for i in range(n):
        item = by_index.get(i)
        if item is None:
            out.append((2, dict(fields)))
        else:
            out.append((int(any(f not in item for f in fields)), {f: item.get(f, d) for f, d in fields.items()}))
    return out


def resolve_config(base: dict, namespace: str | dict | None, request: dict | None, allowed: set[str], fixed: set[str] = frozenset()) -> dict:
    """Global settings, a namespace's over them, allowed request keys over those; ``fixed`` keys stay global."""
    own = json.loads(namespace) if isinstance(namespace, str) else namespace or {}
    if not isinstance(own, dict):
        raise ValueError("a namespace's configuration must be an object")
    asked = {k: v for k, v in (request or {}).items() if k in allowed}
    return base | {k: v for k, v in (own | asked).items() if k not in fixed}


class PieceTokenizer:
    """Unigram or BPE pieces from a sentencepiece model file."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model_file)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


class CircuitOpen(RuntimeError):
    """A call that isn't made because the service failed too often just now."""


class CircuitBreaker:
    """Wraps a model client: retries with growing pauses, opens after some failures, tries once after a rest."""

    def __init__(self, failures: int = 3, rest_s: float = 30.0, pauses_s: tuple[float, ...] = (0.05, 0.1, 0.2), clock: Callable[[], float] | None = None, sleep: Callable[[float], None] | None = None):
        import time

        self.limit, self.rest_s, self.pauses_s = failures, rest_s, pauses_s
        self.clock, self.sleep = clock or time.monotonic, sleep or time.sleep
        self.failed, self.opened_at = 0, None

    def call(self, fn: Callable[[], Any]) -> Any:
        if self.opened_at is not None and self.clock() - self.opened_at < self.rest_s:
            raise CircuitOpen
        trial = self.opened_at is not None
        for pause in (None,) if trial else (*self.pauses_s, None):
            try:
                out = fn()
            except Exception:
                self.failed += 1
                if trial or self.failed >= self.limit:
                    self.opened_at = self.clock()
                    raise
                if pause is None:
                    raise
                self.sleep(pause)
            else:
                self.failed, self.opened_at = 0, None
                return out

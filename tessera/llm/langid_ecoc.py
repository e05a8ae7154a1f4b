"""Language identification by error-correcting output codes.

Every language has a codeword; one logistic classifier over hashed character trigrams
predicts each bit. A text's language is the codeword with the least weighted logistic loss
over the bits, where bits that were learned well weigh more; two codewords that are nearly
as close make the answer ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.samples import held_out, per_class

WIDTH = 4096
#: Bounds of the training sample: documents in all, or so many of each language if that is more.
SAMPLE, LEAST = 4096, 16
#: Rows whose features stand in memory at once.
BLOCK = 512
ROUNDS = 60
AMBIGUOUS_MARGIN = 0.1
UNKNOWN = "und"

_LETTER = np.zeros(256, np.uint8)
for _c in range(26):
    _LETTER[97 + _c] = _LETTER[65 + _c] = 97 + _c
_LETTER[0x80:] = np.arange(0x80, 0x100)


def counts(text: str | None) -> np.ndarray | None:
    """Hashed trigram counts of the letters of one whole text; None if it has no letter."""
    if not text or not (any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text))):
        return None
    low = text if text.isascii() else text.lower()
    raw = _LETTER[np.frombuffer(low.encode("utf-8", "replace"), np.uint8)]
    gap = raw == 0
    keep = ~(gap[1:] & gap[:-1])
    raw = np.concatenate([np.zeros(1, np.uint8), raw[:1], raw[1:][keep], np.zeros(1, np.uint8)]).astype(np.uint32)
    three = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    return np.bincount((three * np.uint32(2654435761)) >> np.uint32(20), minlength=WIDTH).astype(np.float32)


def _unit(features: np.ndarray) -> np.ndarray:
    root = np.sqrt(features)
    return root / np.maximum(np.linalg.norm(root, axis=1, keepdims=True), 1e-12)


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1: all splits for few languages, else the best of seeded random codes."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1 if row == 0 or not (split >> (row - 1)) & 1 else -1 for split in range(1, 1 << (n - 1))] for row in range(n)])
    length, best, best_gap = int(np.ceil(10 * np.log2(n))), None, -1
    for seed in range(20):
        code = np.random.default_rng(seed).choice([-1, 1], (n, length))
        gap = ((length - code @ code.T) // 2 + length * np.eye(n, dtype=int)).min()
        if gap > best_gap and (np.abs(code.sum(0)) < n).all():
            best, best_gap = code, gap
    return best if best is not None else code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        found = [counts(t) for t in texts]
        out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "ambiguous": True})
        some = [i for i, c in enumerate(found) if c is not None]
        if not some or not self.languages:
            return out
        for at in range(0, len(some), 512):
            rows = some[at : at + 512]
            margin = _unit(np.stack([found[i] for i in rows])) @ self.weights + self.bias
            loss = np.stack([(np.logaddexp(0, -margin * c) * self.trust).sum(1) for c in self.code], 1)
            best = loss.argmin(1)
            least = loss.min(1)
            share = 1 / np.exp(least[:, None] - loss).sum(1)
            if len(self.languages) > 1:
                gap = np.partition(loss, 1, axis=1)[:, 1] - least
            else:
                gap = np.full(len(rows), np.inf)
            out.loc[rows, "lang_pred"] = [self.languages[b] for b in best]
            out.loc[rows, "score"] = np.clip(share, 0.0, 1.0)
            out.loc[rows, "ambiguous"] = gap < AMBIGUOUS_MARGIN
        return out


Sparse = list[tuple[np.ndarray, np.ndarray]]


def _dense(rows: Sparse) -> np.ndarray:
    out = np.zeros((len(rows), WIDTH), np.float32)
    for i, (at, n) in enumerate(rows):
        out[i, at] = n
    return _unit(out)


def fit(rows: Sparse, languages: list[str]) -> Model:
    """Full-batch descent on the logistic loss of every bit; features are made dense by blocks."""
    names = sorted(set(languages))
    code = codewords(len(names)).astype(np.float32)
    weights, bias = np.zeros((WIDTH, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    if len(names) < 2:
        return Model(names, code, weights, bias, np.ones(code.shape[1]))
    place = {v: i for i, v in enumerate(names)}
    at = np.array([place[v] for v in languages])
    target, importance = code[at], (len(at) / (len(names) * np.bincount(at)))[at][:, None].astype(np.float32)
    blocks = [slice(i, i + BLOCK) for i in range(0, len(rows), BLOCK)]
    dense = [_dense(rows[b]) for b in blocks] if len(rows) <= 2 * SAMPLE else None
    features = lambda i: dense[i] if dense else _dense(rows[blocks[i]])
    step = np.float32(8.0)
    for _ in range(ROUNDS):
        slope, tilt = np.zeros_like(weights), np.zeros_like(bias)
        for i, b in enumerate(blocks):
            x = features(i)
            pull = -target[b] / (1 + np.exp(np.clip(target[b] * (x @ weights + bias), -30, 30))) * importance[b] / len(rows)
            slope += x.T @ pull
            tilt += pull.sum(0)
        weights -= step * (slope + np.float32(1e-6) * weights)
        bias -= step * tilt
    margin = np.concatenate([features(i) @ weights + bias for i in range(len(blocks))]) * target
    trust = np.clip((margin > 0).mean(0) * 2 - 1, 0.05, 1)
    scale = (4 / np.maximum(np.median(np.abs(margin), axis=0), 1e-9)).astype(np.float32)
    return Model(names, code, weights * scale, bias * scale, trust / trust.sum() * len(trust))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` documents, as many of each language, outside the held-out quarter.

    Every language that a document has is learned. Rows that share id and text count once.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    chosen = per_class(known, "lang", lambda n: max(LEAST, sample // max(1, n)), "doc_id", "text").dropDuplicates(["doc_id", "text", "lang"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [x for x in zip(batch["doc_id"], batch["lang"], map(counts, batch["text"]), strict=True) if x[2] is not None]
            at = [np.flatnonzero(c) for _, _, c in found]
            out = {"doc_id": [x[0] for x in found], "lang": [x[1] for x in found], "at": [a.astype(np.int32) for a in at]}
            yield pd.DataFrame(out | {"n": [x[2][a] for x, a in zip(found, at, strict=True)]})

    rows = chosen.mapInPandas(run, "doc_id long, lang string, at array<int>, n array<float>").toPandas().sort_values(["doc_id", "lang"], kind="stable")
    return fit(list(zip(rows["at"], rows["n"], strict=True)), list(rows["lang"]))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document.

    ``und`` (score 0, ambiguous) for a null text, one without a letter, or if nothing was
    there to learn from. With one learned language all other texts get it. Repeated rows are
    judged alike; extra columns are ignored; an empty table gives no rows. A text is read
    whole however long; what is kept of it is one count a feature.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        return shared.value.predict(list(text))

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text").cast("string")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous")

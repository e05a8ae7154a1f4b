"""Chunkers as Arrow-batched maps over whole documents; one task never needs two documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import trim_space
from tessera.runtime import spread

# Separators from coarse to fine.
SEPARATORS = ("\f", "\n\n", "\n", "。", ".", "！", "？", "!", "?", "；", ";", " ", "")
CHUNK, OVERLAP = 512, 50
PARENT, CHILD, CHILD_OVERLAP = 1024, 200, 20
FLAT_ABOVE = 10_000

# A word of n letters counts as many tokens as it has pieces of three (four) letters at most.
_RUN = r"\x00-\x08\x0b\x0c\x0e-\x1f\x21-\x7f"
_THREES = re.compile(f"[{_RUN}]{{1,3}}|[\x80-\U0010ffff]")
_LEAD, _TRAIL = re.compile(f"[{_RUN}]*"), re.compile(f"[{_RUN}]*\\Z")
_WIDE = re.compile("[\u0800-\U0010ffff]")
_FOURS = re.compile(r"[\x00-\x08\x0b\x0e-\x1f\x21-\x7f]{1,4}|[\x80-\U0010ffff]")


def _pieces(text: str) -> int:
    return len(_THREES.findall(text)) + (0 if text.isascii() else len(_WIDE.findall(text)))


def splitter_tokens(text: str) -> int:
    """The splitter's estimate, as ``functions.text.estimate_splitter``."""
    return max(1, _pieces(text)) if text else 0


def chunker_tokens(text: str) -> int:
    return len(_FOURS.findall(text))


@dataclass
class Chunk:
    text: str
    index: int
    start: int
    end: int
    tokens: int


def _joined(parts: list[str], sep: str, most: int) -> list[tuple[str, int]]:
    """Neighbours put together again while they fit, with their tokens.

    Every part is counted once. Where two meet, only the words that touch the separator can
    count otherwise than on their own.
    """
    out: list[tuple[str, int]] = []
    held: list[str] = []
    count = trail = 0
    for part in filter(None, parts):
        own = _pieces(part)
        if held:
            lead, before = _LEAD.match(part).end(), trail
            seam = sep if before + lead else ""
            both = count + own + _pieces(sep)
            if seam:
                alone = -(-before // 3) - (-lead // 3) + _pieces(sep)
                both += _pieces("x" * before + sep + "x" * lead) - alone
            if max(1, both) <= most:
                held.append(part)
                count = both
                # a part that is one word goes on the one before it
                trail = _trailing(part) if lead < len(part) else _trailing("x" * before + sep + part)
                continue
            out.append((sep.join(held), max(1, count)))
        held, count, trail = [part], own, _trailing(part)
    if held:
        out.append((sep.join(held), max(1, count)))
    return out


def _trailing(text: str) -> int:
    """Letters of the word that a text ends in the middle of."""
    n = 64
    while n < len(text) and len(found := _TRAIL.search(text[-n:]).group()) == n:
        n *= 4
    return len(_TRAIL.search(text[-n:]).group()) if n >= len(text) else len(found)


def _hard_cut(text: str, most: int) -> list[tuple[str, int]]:
    out = []
    while text:
        n = min(len(text), 3 * most)
        while n > 1 and splitter_tokens(text[:n]) > most:
            n = max(1, n * 3 // 4)
        out.append((text[:n], splitter_tokens(text[:n])))
        text = text[n:]
    return out


def _split(text: str, tokens: int, most: int, separators: tuple[str, ...]) -> list[tuple[str, int]]:
    if tokens <= most:
        return [(text, tokens)]
    if not separators or separators[0] == "":
        return _hard_cut(text, most)
    if separators[0] not in text:
        return _split(text, tokens, most, separators[1:])
    out = []
    for part, n in _joined(text.split(separators[0]), separators[0], most):
        out += _split(part, n, most, separators[1:])
    return out


def split(text: str, most: int = CHUNK, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``most`` estimated tokens, cut at the coarsest separator that does."""
    return [part for part, _ in _split(text, splitter_tokens(text), most, separators)] if text else []


def _tail(text: str, overlap: int) -> str:
    """The shortest end of a text that holds ``overlap`` tokens; nothing if that is all of it."""
    n = 8 * overlap
    while n < len(text) and splitter_tokens(text[-n:]) < overlap:
        n *= 2
    low, high = max(0, len(text) - n), len(text)
    while low < high:  # the estimate never grows as the end gets shorter
        middle = (low + high + 1) // 2
        if splitter_tokens(text[middle:]) >= overlap:
            low = middle
        else:
            high = middle - 1
    return text[low:] if low > 0 else ""


def recursive_chunks(text: str, most: int = CHUNK, overlap: int = OVERLAP) -> list[Chunk]:
    """Chunks in order; each but the first begins with the end of the (extended) one before."""
    out, at = [], 0
    for i, (part, tokens) in enumerate(_split(text, splitter_tokens(text), most, SEPARATORS) if text else ()):
        found = text.find(part, at)
        start = found if found >= 0 else at
        out.append(Chunk(part, i, start, start + len(part), tokens))
        at = start + 1
    if overlap > 0:
        for before, now in zip(out, out[1:]):
            lead = _tail(before.text, overlap)
            if lead:
                now.text, now.start = lead + now.text, max(0, now.start - len(lead))
                now.tokens = splitter_tokens(now.text)
    return out


def parents_and_children(units: list[tuple[int, str]], parent: int = PARENT, child: int = CHILD, overlap: int = CHILD_OVERLAP, flat_above: int = FLAT_ABOVE) -> list[dict]:
    """Children of one document with their parents; ``units`` (page, text) in order.

    Units fill a parent until the next would pass its size; a unit that is larger makes one
    of its own. With more than ``flat_above`` parents to expect there are none: the joined
    text is split into children with an empty parent_id.
    """
    units = [(page, t.strip(" \t\r\n\f\v")) for page, t in units]
    units = [(page, t, chunker_tokens(t)) for page, t in units if t]
    flat = -(-sum(n for _, _, n in units) // max(1, parent)) > flat_above
    groups: list[list[tuple[int, str, int]]] = []
    used = 0
    for unit in units:
        if not groups or (not flat and used + unit[2] > parent):
            groups.append([])
            used = 0
        groups[-1].append(unit)
        used += unit[2]
    rows, index = [], 0
    for i, group in enumerate(groups):
        body, at = "\n".join(t for _, t, _ in group), 0
        size = chunker_tokens(body)
        for c in recursive_chunks(body, child, overlap):
            found = body.find(c.text, at)
            offset = found if found >= 0 else at
            rows.append({
                "parent_id": "" if flat else f"p{i}", "parent_text": "" if flat else body, "parent_tokens": 0 if flat else size, "page_start": group[0][0], "page_end": group[-1][0],
                "chunk_index": index, "child_text": c.text, "child_tokens": chunker_tokens(c.text), "parent_offset": offset,
            })
            index, at = index + 1, offset + 1
    return rows


CHUNKS = "doc_id long, chunk_index int, chunk_text string, start_offset int, end_offset int, tokens int"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def chunk_recursive(docs: DataFrame, most: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_index, chunk_text, start_offset, end_offset, tokens; empty texts have no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(i).to_pylist() for i in (0, 1))
            yield _batch([(d, c.index, c.text, c.start, c.end, c.tokens) for d, t in zip(ids, texts, strict=True) for c in recursive_chunks(t or "", most, overlap)], CHUNKS)

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, CHUNKS)


UNITS = "doc_id long, parent_id string, parent_text string, parent_tokens int, page_start int, page_end int, chunk_index int, child_text string, child_tokens int, parent_offset int"


def chunk_units(docs: DataFrame, unit: str = "paragraph", parent: int = PARENT, child: int = CHILD, overlap: int = CHILD_OVERLAP, flat_above: int = FLAT_ABOVE, also: tuple[str, ...] = ()) -> DataFrame:
    """Children of every document, and before the first of each parent a row of the parent's own.

    A parent's row has its text and no child; children carry no parent text. Pages are parted
    by form feeds. ``parents`` and ``children`` take the two apart: write this table first.
    With columns ``also``, which every row repeats, there are rows of children only.
    """

    def units(text: str) -> list[tuple[int, str]]:
        out = []
        for page, body in enumerate(text.split("\f"), 1):
            parts = [body] if unit == "page" else split(body, child) if unit == "sentence" else body.split("\n")
            out += [(page, p) for p in parts]
        return out

    def rows(doc: int, text: str) -> Iterator[tuple]:
        last = ""
        for r in parents_and_children(units(text), parent, child, overlap, flat_above):
            place = (r["page_start"], r["page_end"])
            if not also and r["parent_id"] and r["parent_id"] != last:
                last = r["parent_id"]
                yield doc, last, r["parent_text"], r["parent_tokens"], *place, None, None, None, None
            yield doc, r["parent_id"], None, r["parent_tokens"], *place, r["chunk_index"], r["child_text"], r["child_tokens"], r["parent_offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(i).to_pylist() for i in (0, 1))
            found = [list(rows(d, t or "")) for d, t in zip(ids, texts, strict=True)]
            out = _batch([r for rs in found for r in rs], UNITS)
            owner = pa.array([i for i, rs in enumerate(found) for _ in rs], pa.int64())
            yield pa.RecordBatch.from_arrays([*out.columns, *(batch.column(c).take(owner) for c in also)], names=[*out.schema.names, *also])

    schema = ", ".join([UNITS, *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in also)])
    return spread(docs.select(F.col("doc_id").cast("long"), "text", *also)).mapInArrow(run, schema)


def parents(units: DataFrame) -> DataFrame:
    return units.filter(F.col("chunk_index").isNull()).select("doc_id", "parent_id", "parent_text", "parent_tokens", "page_start", "page_end")


def children(units: DataFrame) -> DataFrame:
    return units.filter(F.col("chunk_index").isNotNull()).drop("parent_text")


def chunk_stats(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Per document, also one without chunks: parents, children, pages (all, with content, without) and the share with content."""
    page = F.split(F.coalesce("text", F.lit("")), "\f")
    pages = docs.select("doc_id", F.size(page).alias("n"), F.size(F.filter(page, lambda p: trim_space(p) != "")).alias("full"))
    pages = pages.groupBy(F.col("doc_id").alias("_id")).agg(F.sum("n").alias("total_pages"), F.sum("full").alias("succeeded_pages"))
    made = chunks.groupBy("doc_id").agg(
        F.countDistinct("parent_id").alias("parents"), F.count("*").alias("children"), F.max("page_end").alias("last_page"), F.sum("child_tokens").alias("child_tokens")
    )
    found = pages.join(made, F.col("_id").eqNullSafe(F.col("doc_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("parents", "children", "last_page", "child_tokens")]
    failed = (F.col("total_pages") - F.col("succeeded_pages")).alias("failed_pages")
    return found.select(F.col("_id").alias("doc_id"), *counts, "total_pages", "succeeded_pages", failed, (F.col("succeeded_pages") / F.col("total_pages")).alias("coverage_ratio"))

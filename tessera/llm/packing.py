"""Best-fit packing of tokenised documents into fixed-length training sequences.

Two passes. The first tokenises every whole text once and writes one small row per piece.
The second deals the pieces by a hash over as many tasks as the token count asks for; each
task packs its pieces online into a bounded number of open bins. A ``capacity + 1`` bit
integer has bit ``f`` set while an open bin has ``f`` free tokens, so the tightest bin that
takes a piece is one shift and one lowest-set-bit away. When all bins are open and none
fits, the fullest one closes. Pieces arrive in windows, each from long to short. Memory is
the open bins and one window, whatever the input.
"""

from __future__ import annotations

import array
import base64
import sys
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import materialize

CAPACITY = 2048
OPEN_BINS = 1024
#: Pieces that are taken together, the longest first, so that short ones fill what is left.
WINDOW = 2048
#: Sequences that one packing task fills; more tokens mean more tasks.
TASK_SEQUENCES = 8192
#: Words whose ids a worker keeps; at this count it forgets them all and starts anew.
CACHED_WORDS = 300_000
SEPARATOR = b"\0\0\0\0"
#: The added token of ``byte_bpe_50k.json``, which is matched inside texts before anything else.
SPECIAL = ("<|endoftext|>", 50256)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class _Words(dict):
    """Ids (little-endian uint32 bytes) of a word with the space before it, learned on demand.

    Text cut at a single space between two non-space characters encodes as its parts do,
    for in the pre-tokeniser's pattern a space only ever begins a match or belongs to a run
    of white space. Other parts raise KeyError, and the whole text is encoded at once.
    """

    def __init__(self, encode, lead: str):
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise KeyError(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self[word] = _little(self.encode(self.lead + word))
        return ids


def _little(ids: list[int]) -> bytes:
    a = array.array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Encoder:
    """Token ids of a text as little-endian uint32 bytes.

    The rank file holds the vocabulary of ``byte_bpe_50k.json``. A text is cut at the string of
    ``special``, which becomes its id; without ``special`` that string is ordinary text.
    """

    def __init__(self, ranks_path: str, pattern: str, special: tuple[str, int] | None = None):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._encode, self._first, self._rest = encode, _Words(encode, ""), _Words(encode, " ")
        self._mark, self._mark_ids = (special[0], _little([special[1]])) if special else (None, b"")

    def __call__(self, text: str) -> bytes:
        if self._mark and self._mark in text:
            return self._mark_ids.join(map(self._plain, text.split(self._mark)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        head, *rest = text.split(" ")
        try:
            return b"".join([self._first[head], *map(self._rest.__getitem__, rest)])
        except KeyError:
            return _little(self._encode(text))


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str, special: tuple[str, int] | None = None) -> Encoder:
    return Encoder(ranks_path, pattern, special)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; the first takes the rest."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    ends = [*starts[1:], n]
    return [(a, b - a) for a, b in zip(starts, ends, strict=True)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """One row per piece of each document's ids with their separator 0.

    A null text is empty and yields the separator alone. Repeated rows are repeated pieces.
    """
    import public_tokenizers as tokenizers_files

    path, pattern = ranks_path or tokenizers_files.path("byte_bpe_50k.tiktoken"), tokenizers_files.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern, SPECIAL)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + SEPARATOR
                for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    row = (doc, i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=list(names))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


class Bins:
    """Online best fit with a bounded number of open bins."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.free = 0  # bit f: an open bin has f tokens free
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.opened = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(room)
        else:
            if length < self.capacity and self.opened == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            bin_, room, self.made = self.made, self.capacity, self.made + 1
        if left := room - length:
            self.at[left].append(bin_)
            self.free |= 1 << left
            self.opened += 1
        return bin_, self.capacity - room

    def _take(self, room: int) -> int:
        bin_ = self.at[room].pop()
        self.opened -= 1
        if not self.at[room]:
            self.free &= ~(1 << room)
        return bin_


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, task_sequences: int = TASK_SEQUENCES) -> DataFrame:
    """Give every piece a sequence and an offset; offsets in a sequence are gapless from 0.

    ``cut_pieces`` is read twice (its token total sets the number of tasks), so hand in a
    written table. Within a task pieces come in hash order: a rerun packs alike. A column
    ``row`` that tells equal pieces apart keeps many of them from one task.
    """
    total = cut_pieces.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    tasks = max(1, -(-total // (capacity * task_sequences)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, bins = TaskContext.get().partitionId() << 40, Bins(capacity, open_bins)
        for batch in batches:
            for at in range(0, batch.num_rows, WINDOW):
                part = batch.slice(at, WINDOW)
                lengths = part.column("length").to_pylist()
                placed = [(0, 0)] * len(lengths)
                for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
                    placed[i] = bins.place(lengths[i])
                sequence, offset = pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, sequence, offset], names=[*part.schema.names, "sequence_id", "offset"])

    order = F.xxhash64("doc_id", "piece", *(["row"] if "row" in cut_pieces.columns else []))
    dealt = cut_pieces.repartition(tasks, order).sortWithinPartitions(order, "doc_id", "piece", "ids_crc32")
    return dealt.drop("row").mapInArrow(run, PACKED)


def packed(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Tokenise, cut and pack whole documents.

    Null and empty texts are one-token documents. Extra columns are ignored. An empty table
    gives no rows. Equal (doc_id, piece) rows of repeated documents are packed separately. A
    long text is encoded whole, in one worker's memory, and then cut.
    """
    cut_pieces = pieces(docs, capacity).withColumn("row", F.monotonically_increasing_id())
    return pack(materialize(cut_pieces, "pieces"), capacity, open_bins)

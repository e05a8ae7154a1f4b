"""Minimax contiguous partition of ordered atomic groups into shards of near-equal bytes.

Documents with equal texts are one group and stay together. Groups of an even share or more
stand first, the largest first, and take a shard each; all others follow in the order of a
60-bit hash of their text, and shards are contiguous runs of that order. The smallest
capacity of these runs is found by binary search with a greedy check, and within it each cut
falls where the rest is shared most evenly. The driver never holds the groups: it searches
over a histogram of the key's leading bits and asks again, with more bits, only for the few
buckets in which some cut can still fall. Everything else is DataFrame functions.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import materialize

SHARDS = 8
#: Bits of the key, of the first histogram, and of each refinement.
KEY_BITS, FIRST_BITS, STEP_BITS = 60, 12, 6
#: Buckets with more than this part of all bytes are refined whether or not a cut is there.
COARSE = 512
#: Rows that are numbered together; more rows mean more buckets.
BUCKET_ROWS = 20_000


@dataclass(frozen=True)
class Entry:
    """A run of keys that share their leading bits; ``single`` if it is one group."""

    key: int  # the smallest key that is there
    prefix: int
    shift: int
    size: int
    single: bool


def text_key(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def _histogram(rows: DataFrame, shift: int) -> list[Entry]:
    prefix = F.shiftright("key", shift).alias("prefix")
    found = rows.groupBy(prefix).agg(F.sum("size").alias("size"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
    return [Entry(r["a"], r["prefix"], shift, r["size"], r["a"] == r["b"]) for r in found]


def _refined(rows: DataFrame, which: list[Entry]) -> list[Entry]:
    """Entries of the next bits; those of one depth share a scan."""
    out = []
    for shift in {e.shift for e in which}:
        inside = rows.filter(F.shiftright("key", shift).isin([e.prefix for e in which if e.shift == shift]))
        out += _histogram(inside, max(0, shift - STEP_BITS))
    return out


def heavy_groups(largest: list[tuple[int, int]], total: int, shards: int) -> list[int]:
    """Of the (key, size) of the largest groups, those that fill a shard: an even share of what is left."""
    out = []
    for key, size in largest:
        left = shards - len(out)
        if left < 2 or size * left < total:
            break
        out.append(key)
        total -= size
    return out


def greedy(prefix: list[int], capacity: int, shards: int) -> list[int]:
    """Positions after each shard when every shard takes all that fits."""
    cuts, at = [], 0
    for _ in range(shards):
        at = bisect_right(prefix, prefix[at] + capacity) - 1
        cuts.append(at)
    return cuts


def loose(prefix: list[int], single: list[bool], capacity: int, shards: int) -> list[int]:
    """Sums after each shard if entries of several groups could be cut anywhere: at least the true ones."""
    cuts, at = [], 0
    for _ in range(shards):
        end = min(at + capacity, prefix[-1])
        i = bisect_right(prefix, end) - 1
        if i < len(single) and single[i]:
            end = max(at, prefix[i])  # a single group is not cut
        cuts.append(end)
        at = end
    return cuts


def spans_of_cuts(prefix: list[int], single: list[bool], needed: int, enough: int, shards: int) -> list[tuple[int, int]]:
    """Sums at which some greedy cut but the last can fall for a capacity from ``needed`` to ``enough``.

    A span ends before a large single group and goes on behind it, for no cut falls inside.
    """
    total = prefix[-1]
    large = [i for i, one in enumerate(single) if one and (prefix[i + 1] - prefix[i]) * COARSE > total]
    out, now = [], [(0, 0)]
    for _ in range(shards - 1):
        ahead = []
        for a, b in now:
            i = bisect_right(prefix, min(a + needed, total)) - 1
            start, end = prefix[i], min(b + enough, total)
            j = bisect_right(prefix, end) - 1
            for m in large[bisect_left(large, i) : bisect_right(large, j)]:
                ahead.append((start, prefix[m]))
                start = prefix[m + 1]
            if start <= end:
                ahead.append((start, end))
        now = []
        for a, b in sorted(ahead):
            if now and a <= now[-1][1]:
                now[-1] = (now[-1][0], max(b, now[-1][1]))
            else:
                now.append((a, b))
        out += now
    return out


def _smallest(feasible: Callable[[int], bool], low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return low


def smallest_capacity(sizes: list[int], shards: int, least: int = 0) -> int:
    prefix = [0, *accumulate(sizes)]
    low = max(least, max(sizes, default=0), -(-prefix[-1] // shards))
    return _smallest(lambda c: greedy(prefix, c, shards)[-1] == len(sizes), low, max(low, prefix[-1]))


def even_cuts(prefix: list[int], capacity: int, shards: int) -> list[int]:
    """Positions after each shard but the last: the most even cuts that keep to the capacity."""
    latest = greedy(prefix, capacity, shards)
    earliest, at = [0] * (shards + 1), len(prefix) - 1
    earliest[shards] = at
    for j in range(shards - 1, 0, -1):
        at = bisect_left(prefix, prefix[at] - capacity)
        earliest[j] = at
    cuts, at = [], 0
    for j in range(1, shards):
        low, high = max(at, min(earliest[j], latest[j - 1])), bisect_right(prefix, prefix[at] + capacity) - 1
        even = prefix[at] + (prefix[-1] - prefix[at]) / (shards - j + 1)
        i = bisect_left(prefix, even)
        if i > 0 and (i == len(prefix) or even - prefix[i - 1] <= prefix[i] - even):
            i -= 1
        at = max(low, min(high, i))
        cuts.append(at)
    return cuts


def boundaries(entries: list[Entry], refine: Callable[[list[Entry]], list[Entry]], shards: int) -> list[int]:
    """The first key of each shard but the first, for the minimax capacity.

    Entries taken whole give a capacity that suffices, entries cut at will one that is
    needed; for any capacity between the two a greedy cut lies in one of a few spans, and only
    entries in these are refined. A span is a few entries wide, so what the driver holds is
    bounded by the number of shards, not by the groups.
    """
    entries, total = sorted(entries, key=lambda e: e.key), sum(e.size for e in entries)
    while True:
        which = [e for e in entries if not e.single and e.shift and e.size * COARSE > total]
        if not which:
            prefix, single = [0, *accumulate(e.size for e in entries)], [e.single or not e.shift for e in entries]
            enough = smallest_capacity([e.size for e in entries], shards)
            least = max([-(-total // shards), *(e.size for e in entries if e.single)])
            needed = _smallest(lambda c: loose(prefix, single, c, shards)[-1] == total, least, enough)
            spans = spans_of_cuts(prefix, single, needed, enough, shards)
            which = [e for i, e in enumerate(entries) if not single[i] and any(prefix[i] < b and prefix[i + 1] > a for a, b in spans)]
        if not which:
            return [entries[c].key if c < len(entries) else 1 << KEY_BITS for c in even_cuts(prefix, enough, shards)]
        gone = set(which)
        entries = sorted([e for e in entries if e not in gone] + refine(which), key=lambda e: e.key)


def plan(rows: DataFrame, shards: int = SHARDS) -> tuple[list[int], list[int]]:
    """(keys of the groups that fill a shard each, first keys of the shards after the next one).

    ``rows`` (key, size) is read once for the largest groups, once for the histogram and once
    for each refinement.
    """
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()["size"]
    largest = rows.groupBy("key").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "key").limit(shards).collect()
    heavy = heavy_groups([(r["key"], r["size"]) for r in largest], total, shards)
    others = rows.filter(~F.col("key").isin(heavy)) if heavy else rows
    entries = _histogram(others, KEY_BITS - FIRST_BITS)
    return heavy, boundaries(entries, lambda which: _refined(others, which), shards - len(heavy)) if entries else []


def _numbered(placed: DataFrame) -> DataFrame:
    """slot: gapless from 0 in every shard, for rows (shard, doc_id, key, row).

    Rows are dealt to buckets by the hash of id and key, and numbered in their bucket after
    all rows of the buckets before. Equal rows that overfill a bucket are dealt on by their
    place in the written table; they stand together, so which is where makes no difference.
    """
    buckets = max(64, -(-placed.count() // BUCKET_ROWS))
    named = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)).cast("int"))
    crowded = named.groupBy("shard", "bucket").count().filter(F.col("count") > 2 * BUCKET_ROWS).select("shard", "bucket")
    equal = named.join(crowded, ["shard", "bucket"]).groupBy("doc_id", "key").count().filter(F.col("count") > BUCKET_ROWS)
    equal = materialize(equal.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), F.ceil(F.col("count") / BUCKET_ROWS).alias("parts")), "equal-rows")
    marked = named.join(equal, named["doc_id"].eqNullSafe(equal["id"]) & (named["key"] == equal["k"]), "left")
    own = F.when(F.col("parts").isNotNull(), F.xxhash64("doc_id", "key")).otherwise(F.lit(0)).alias("own")
    part = F.when(F.col("parts").isNotNull(), 1 + F.pmod(F.xxhash64("row"), F.col("parts"))).otherwise(F.lit(0)).cast("long").alias("part")
    dealt = marked.select(*placed.columns, "bucket", own, part)
    place = ["shard", "bucket", "own", "part"]
    before = Window.partitionBy("shard").orderBy("bucket", "own", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*place).count().select(*place, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("from"))
    inside = F.row_number().over(Window.partitionBy(*place).orderBy("doc_id", "key", "row"))
    return dealt.withColumn("at", inside - 1).join(offsets, place).withColumn("slot", (F.col("from") + F.col("at")).cast("long"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null) under the law ``bytes``.

    A null text counts as empty (size 1, crc 0) and shares the group of empty texts. A group
    of an even share or more fills a shard by itself. Repeated rows are rows of their own.
    Slots are gapless from 0 in every shard; shards may be empty. A text is read whole
    however long, and only its size and hashes are kept. Other columns are ignored. An empty
    table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"), text_key(text).alias("key"), F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "shard-rows")
    heavy, cuts = plan(rows.select("key", "size"), shards)
    shard = F.lit(len(heavy))
    for cut in cuts:
        shard = shard + F.when(F.col("key") >= F.lit(cut), 1).otherwise(0)
    for i, key in enumerate(heavy):
        shard = F.when(F.col("key") == F.lit(key), F.lit(i)).otherwise(shard)
    numbered = _numbered(rows.withColumn("shard", shard.cast("int")))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""A Bloom filter as a table of set bits: built, merged and asked with plain DataFrame plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits that one row holds.
WORD = 32_768


class Bloom:
    """Sized for ``n`` keys at a false-positive rate ``p``; ``words`` (word, bits) is the filter."""

    def __init__(self, words: DataFrame, bits: int, hashes: int):
        self.words, self.bits, self.hashes = words, bits, hashes

    @staticmethod
    def size(n: int, p: float) -> tuple[int, int]:
        bits = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2))
        return bits, max(1, round(-math.log2(p)))

    def _positions(self, key: Column) -> Column:
        return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(self.bits)) for i in range(self.hashes)])

    @classmethod
    def build(cls, rows: DataFrame, key: str, n: int, p: float = 0.01) -> Bloom:
        """Bits are combined into bitmaps before and after the shuffle."""
        made = cls(rows, *cls.size(n, p))
        at = rows.select(F.explode(made._positions(F.col(key))).alias("at"))
        words = at.groupBy(F.expr("bitmap_bucket_number(at)").alias("word")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
        return cls(words, made.bits, made.hashes)

    def might_contain(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows whose key may be in: all its bits are set. None that is in is missing."""
        asked = rows.select(key).distinct().select(key, F.explode(self._positions(F.col(key))).alias("at"))
        asked = asked.withColumn("word", F.expr("bitmap_bucket_number(at)")).withColumn("bit", F.expr("bitmap_bit_position(at)"))
        byte = F.conv(F.hex(F.expr("substring(bits, CAST(bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
        hit = asked.join(self.words, "word").filter(byte.bitwiseAND(F.expr("shiftleft(1, CAST(bit % 8 AS INT))")) != 0)
        there = hit.groupBy(key).agg(F.countDistinct("at").alias("_n"), F.max(F.size(F.array_distinct(self._positions(F.col(key))))).alias("_k")).filter("_n = _k")
        return rows.join(there.select(key), key, "left_semi")

    def false_positive_rate(self) -> float:
        ones = self.words.agg(F.sum(F.expr("bitmap_count(bits)")).alias("n")).first()["n"] or 0
        return (ones / self.bits) ** self.hashes

"""Near-duplicate detection by min-max hashing with exact confirmation.

1. One pass over the texts: distinct 5-word shingles, a 128-bit hash of the word sequence,
   and for each of 64 permutations both the least and the greatest hash. That is 128
   signature values for 64 evaluations a shingle. Groups of four minima, or of four maxima,
   are the bands.
2. Exact copies fold into their smallest id before anything is compared.
3. In every band bucket all members are paired with its smallest and its largest id: two
   pairs a member, however large the bucket. Signatures rule most false pairs out; texts are
   fetched for the others only, which full shingle sets confirm. Links make components.
4. What the stars can't settle are buckets of four or more whose members lie in several
   components. There the members outside the bucket's main component are compared with all
   of it, and with each other, in blocks of bounded rows and bytes: by signature first, then
   on full sets, for documents that have a likely partner in the block. So no pair that
   shares a bucket is left out unless it is already connected.

With 32 bands of 4 values a pair at similarity 0.75 shares no bucket with probability 5e-6,
at 0.8 with 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.runtime import materialize

WIDTH = 5
PERCENT = 75
PERMUTATIONS, ROWS = 64, 4
#: Share of equal signature bytes below which a pair at 0.75 is ruled out (5 sigma).
LIKELY = 0.55
#: Members of a bucket that one task compares with as many others, and the bytes of their texts.
BLOCK, BLOCK_BYTES = 256, 8 << 20
CACHED_WORDS = 120_000
CHUNK = 2048

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    draw = lambda: rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
    return (draw() << np.uint64(1)) | np.uint64(1), draw()


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of 5-word shingles; of the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    width = min(n, WIDTH)
    out = np.full(n - width + 1, np.uint64(width), np.uint64)
    for i in range(width):
        out = out * _PRIME + h[i : n - width + 1 + i]
    return np.unique(_mix(out))


def signature(hashes: np.ndarray) -> np.ndarray:
    """64 minima, then 64 maxima, as 32-bit values."""
    a, b = _permutations()
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, len(hashes), CHUNK):
        values = ((a[:, None] * hashes[None, at : at + CHUNK] + b[:, None]) >> np.uint64(32)).astype(np.uint32)
        low, high = np.minimum(low, values.min(1)), np.maximum(high, values.max(1))
    return np.concatenate([low, high])


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each group of four minima or four maxima."""
    groups = values.reshape(-1, ROWS).astype(np.uint64)
    key = np.arange(len(groups), dtype=np.uint64)
    for i in range(ROWS):
        key = _mix(key * _PRIME + groups[:, i])
    return key.view(np.int64)


SIGNED = "doc_id long, text_key long, bytes long, n_shingles long, copy_key binary, bands array<long>, sig binary"


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))


def signed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column("text"):
                words = words_of(text.as_py())
                found = shingles(words)
                values = signature(found) if words else None
                out[0].append(len(found))
                out[1].append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                out[2].append(bands(values) if words else None)
                out[3].append((values & 0xFF).astype(np.uint8).tobytes() if words else None)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            arrays = [*(batch.column(c) for c in ("doc_id", "text_key", "bytes")), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "bytes", "n_shingles", "copy_key", "bands", "sig"])

    return _texts(docs).mapInArrow(run, SIGNED)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    few, many = sorted((len(x), len(y)))
    if 100 * few < percent * many:
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (few + many - shared)


def _both(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """a, b and the column of either. Plain equi-joins with nothing above them, so a hub's rows split."""
    right = rows.select(F.col("doc_id").alias("b"), F.col(column).alias("of_b"))
    left = rows.select(F.col("doc_id").alias("a"), F.col(column).alias("of_a"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "of_a", "of_b")


def likely(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures don't rule them out. ``sigs`` (doc_id, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("of_a", "of_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= LIKELY))

    return _both(pairs, sigs, "sig").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. ``texts`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            a, keep = batch.column("a").to_pylist(), []
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, last_set = a[i], shingles(words_of(batch.column("of_a")[i].as_py()))
                keep.append(_similar(last_set, shingles(words_of(batch.column("of_b")[i].as_py())), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _both(pairs, texts, "text").mapInArrow(run, "a long, b long")


def _near(groups: DataFrame) -> DataFrame:
    """(kind, key, i, j, is_left, doc_id): members whose signature is near one of the other side's, of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in range(batch.num_rows):
                sides = [batch.column(c)[g].values for c in ("left", "right")]
                ids, comps = ([s.field(f).to_numpy() for s in sides] for f in ("doc_id", "component"))
                sigs = [np.stack([np.frombuffer(v.as_py(), np.uint8) for v in s.field("sig")]) for s in sides]
                found = [np.zeros(len(x), bool) for x in ids]
                for n in range(len(ids[0])):
                    near = ((sigs[1] == sigs[0][n]).mean(1) >= LIKELY) & (comps[1] != comps[0][n])
                    found[0][n] = near.any()
                    found[1] |= near
                out = np.concatenate([x[f] for x, f in zip(ids, found, strict=True)])
                place = [pa.array([batch.column(c)[g].as_py()] * len(out), k) for c, k in (("kind", pa.int32()), ("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()))]
                is_left = np.repeat([True, False], [int(f.sum()) for f in found])
                yield pa.RecordBatch.from_arrays([*place, pa.array(is_left), pa.array(out)], names=["kind", "key", "i", "j", "is_left", "doc_id"])

    return groups.mapInArrow(run, "kind int, key long, i int, j int, is_left boolean, doc_id long")


def _linked(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between the rows of two blocks, one for each pair of components that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            for g in range(batch.num_rows):
                sides = [batch.column(c)[g].values for c in ("left", "right")]
                ids, comps = ([s.field(f).to_numpy() for s in sides] for f in ("doc_id", "component"))
                sigs = [np.stack([np.frombuffer(v.as_py(), np.uint8) for v in s.field("sig")]) for s in sides]
                sets = [[shingles(words_of(t.as_py())) for t in s.field("text")] for s in sides]
                done = set()
                for i in range(len(ids[0])):
                    same = (sigs[1] == sigs[0][i]).mean(1)
                    near = np.flatnonzero((same >= LIKELY) & (comps[1] != comps[0][i]))
                    for j in near[np.argsort(-same[near], kind="stable")]:
                        ends = (comps[0][i], comps[1][j])
                        if ends not in done and _similar(sets[0][i], sets[1][j], percent):
                            done.add(ends)
                            links.append((int(ids[0][i]), int(ids[1][j])))
            columns = [pa.array([f(x) for x in links], pa.int64()) for f in (min, max)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return groups.select("left", "right").mapInArrow(run, "a long, b long")


PLACE = ("kind", "key", "i", "j")


def _grouped(rows: DataFrame) -> DataFrame:
    """Block pairs (kind, key, i, j, left, right) of rows (kind, key, i, j, is_left, e) that have both sides."""
    side = lambda left: F.collect_list(F.when(F.col("is_left") == left, F.col("e")))
    groups = rows.groupBy(*PLACE).agg(side(True).alias("left"), side(False).alias("right"))
    return groups.filter((F.size("left") > 0) & (F.size("right") > 0))


def _met(rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links between left and right rows (kind, key, i, j, is_left, doc_id, component) of the same block pair."""
    both = materialize(rows, "block-rows")
    sigs = both.join(texts.select("doc_id", "sig"), "doc_id")
    near = materialize(_near(_grouped(sigs.select(*PLACE, "is_left", F.struct("doc_id", "component", "sig").alias("e")))), "block-near")
    asked = materialize(near.select("doc_id").distinct(), "block-ids")
    texts = materialize(texts.join(asked, "doc_id"), "block-texts")
    homes = both.select("doc_id", "component").distinct()
    whole = near.join(homes, "doc_id").join(texts, "doc_id")
    return _linked(_grouped(whole.select(*PLACE, "is_left", F.struct("doc_id", "component", "sig", "text").alias("e"))), percent)


def texts_of(docs: DataFrame, ids: DataFrame, single: DataFrame) -> DataFrame:
    """doc_id, text, sig of the ids, each once: the text that ``single`` (doc_id, text_key, sig, times) names."""
    wanted = materialize(single.join(ids, "doc_id").select("doc_id", "text_key", "sig", "times"), "wanted")
    found = _texts(docs).select("doc_id", "text_key", "text")
    if not wanted.filter("times > 1").isEmpty():
        found = found.dropDuplicates(["doc_id", "text_key"])
    return materialize(found.join(wanted.drop("times"), ["doc_id", "text_key"]).select("doc_id", "text", "sig"), "texts")


def _blocks(n: Column, size: Column) -> Column:
    return F.greatest(F.ceil(n / F.lit(float(BLOCK))), F.ceil(size / F.lit(float(BLOCK_BYTES)))).cast("int")


def _at(blocks: str) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.col(blocks)).cast("int")


def _every(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def residual(members: DataFrame, homes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links that the stars could not see, in buckets of four or more with several components.

    ``members`` (band, doc_id, component, bytes), ``homes`` (doc_id, component, bytes) of all
    of them. What stands outside a bucket's most frequent component is an outsider. Outsiders
    meet all of that component, once whatever the number of bands they share, and each other
    within the bucket, in blocks of about ``BLOCK`` rows and ``BLOCK_BYTES`` a side. What
    comes out is at most one link for two components and blocks.
    """
    by_comp = members.groupBy("band", "component").agg(F.count("*").alias("count"), F.sum("bytes").alias("bytes"))
    most = F.max(F.struct("count", "component", "bytes")).alias("most")
    mixed = by_comp.groupBy("band").agg(most, F.sum("count").alias("n"), F.sum("bytes").alias("bytes")).filter((F.col("n") >= 4) & (F.col("n") > F.col("most.count")))
    out = _blocks(F.col("n") - F.col("most.count"), F.col("bytes") - F.col("most.bytes")).alias("parts")
    # written first: a join of two plain exchanges lets Spark split a hot band's rows
    mixed = materialize(mixed.select("band", F.col("most.component").alias("main"), (F.col("n") - F.col("most.count")).alias("n_out"), out), "mixed")
    if mixed.isEmpty():
        return members.sparkSession.createDataFrame([], "a long, b long")
    outsiders = materialize(members.join(mixed, "band").filter("component <> main"), "outsiders")

    asked = materialize(outsiders.select("main", "doc_id", "component", "bytes").distinct(), "asked")
    n_asked = asked.groupBy("main").agg(_blocks(F.count("*"), F.sum("bytes")).alias("lefts"))
    n_asked = materialize(n_asked, "asked-blocks")
    at_home = homes.withColumnRenamed("component", "main").join(n_asked, "main")
    sized = materialize(at_home.groupBy("main").agg(F.first("lefts").alias("lefts"), _blocks(F.count("*"), F.sum("bytes")).alias("rights")), "home-blocks")
    left = asked.join(sized, "main").select(F.lit(0).alias("kind"), F.col("main").alias("key"), _at("lefts").alias("i"), _every("rights").alias("j"), F.lit(True).alias("is_left"), "doc_id", "component")
    there = homes.withColumnRenamed("component", "main").join(sized, "main")
    right = there.select(F.lit(0).alias("kind"), F.col("main").alias("key"), _every("lefts").alias("i"), _at("rights").alias("j"), F.lit(False).alias("is_left"), "doc_id", F.col("main").alias("component"))

    several = outsiders.filter("n_out > 1")
    side = lambda at, every, is_left: several.select(F.lit(1).alias("kind"), F.col("band").alias("key"), _at("parts").alias(at), _every("parts").alias(every), F.lit(is_left).alias("is_left"), "doc_id", "component")
    inside = side("i", "j", True).unionByName(side("j", "i", False)).filter("i <= j")
    return _met(left.unionByName(right).unionByName(inside), texts, percent).distinct()


def _main_rows(table: DataFrame) -> DataFrame:
    """``table`` with ``main`` (one row an id, or null id) and ``key``, its document's copy key, and ``times``.

    Of rows that share an id, the one with words and the smallest hash of its text stands for
    the document.
    """
    repeated = materialize(table.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("times")).filter("times > 1"), "repeated")
    if repeated.isEmpty():
        return table.select("*", F.lit(True).alias("main"), F.col("copy_key").alias("key"), F.lit(1).cast("long").alias("times"))
    rows = table.select("doc_id", "copy_key", "text_key", "row").join(repeated.select("doc_id"), "doc_id")
    first = rows.groupBy("doc_id").agg(F.min(F.struct(F.col("copy_key").isNull(), "text_key", "row", "copy_key")).alias("first"))
    first = materialize(first.join(repeated, "doc_id").select("doc_id", F.col("first.row").alias("first_row"), F.col("first.copy_key").alias("first_key"), "times"), "first-rows")
    main = F.col("first_row").isNull() | (F.col("first_row") == F.col("row"))
    key = F.when(F.col("first_row").isNull(), F.col("copy_key")).otherwise(F.col("first_key"))
    joined = table.join(first, "doc_id", "left")
    return joined.select(*table.columns, main.alias("main"), key.alias("key"), F.coalesce("times", F.lit(1)).alias("times"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Words are split at ASCII white space after lower-casing A-Z. Texts without a word have no
    shingle and are linked with nothing; those of fewer than five words have one. Rows of one
    doc_id are one document, which the row with words and the smallest hash of its text
    stands for; n_shingles is each row's own. A row without an id is linked with nothing and
    kept (its component_id is null). Long texts are read whole; tasks that compare texts take
    them by bytes. Other columns are ignored. An empty table gives no rows.
    """
    table = materialize(signed(docs).withColumn("row", F.monotonically_increasing_id()), "signed")
    rows = _main_rows(table)
    copies = rows.filter(F.col("main") & F.col("key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    # written first: a join of two plain exchanges lets Spark split a hot key's rows
    copies = materialize(copies.filter("n > 1").select("key", "first_id"), "copies")
    narrow = rows.select("doc_id", "n_shingles", "key", "main").join(copies, "key", "left")
    owners = materialize(narrow.select("doc_id", "n_shingles", "main", F.when(F.col("doc_id").isNotNull(), F.coalesce("first_id", "doc_id")).alias("owner")), "owners")

    folded = owners.filter(F.col("main") & (F.col("owner") != F.col("doc_id"))).select("doc_id")
    single = rows.filter(F.col("main") & F.col("doc_id").isNotNull() & F.col("copy_key").isNotNull()).join(folded, "doc_id", "left_anti")
    single = materialize(single.select("doc_id", "text_key", "bytes", "bands", "sig", "times"), "single")
    banded = single.select("doc_id", "bytes", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).filter("low <> high")
    shared = materialize(shared, "buckets")
    members = materialize(banded.join(shared, "band"), "members")
    stars = members.select(F.explode(F.array("low", "high")).alias("hub"), "doc_id").filter("hub <> doc_id")
    stars = materialize(stars.select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct(), "stars")

    texts = texts_of(docs, members.select("doc_id").distinct(), single)
    asked = materialize(likely(stars, texts.select("doc_id", "sig")), "likely")
    near = materialize(asked.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "likely-ids")
    links = materialize(confirmed(asked, materialize(texts.join(near, "doc_id"), "likely-texts"), percent), "links")
    found = materialize(components(links), "components")

    homes = members.select("doc_id", "bytes").distinct().join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    homes = materialize(homes.select("doc_id", F.coalesce("component", "doc_id").alias("component"), "bytes"), "homes")
    labelled = members.filter("n >= 4").select("band", "doc_id", "bytes").join(homes.select("doc_id", "component"), "doc_id")
    more = materialize(residual(labelled, homes, texts, percent), "more-links")
    if not more.isEmpty():
        found = materialize(components(links.unionByName(more)), "components")

    out = owners.join(found.withColumnRenamed("node", "owner"), "owner", "left")
    component = F.coalesce("component", "owner")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT e.a, r.seen FROM r JOIN e ON e.b = r.node),
c AS (
  SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

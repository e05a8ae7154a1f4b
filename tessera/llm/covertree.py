"""Exact top-k inner-product search by dual-tree traversal of cover trees.

Vectors become integer vectors, so scores are exact. The upper levels of one cover tree are
grown on a bounded sample: at most ``CELLS`` centres, each level's within half the radius of
the one above. Every row goes to its nearest centre, and cells that stand next to each other
in the tree share blocks of bounded size; a cell of more rows than a block holds takes
several. Each data block carries the lower levels of its tree, built once.

A query first meets only the block that holds the cell its own cell's centre agrees with
most. The k-th scores of that round then prune: for a query cell with centre q and radius r
and a data cell with centre p and radius s no score can pass q.p + |q|s + |p|r + rs, and only
cell pairs whose bound reaches the worst k-th score of the query cell are dealt to tasks at
all. There the same bound prunes pairs of nodes of both trees, best pair first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import materialize

SCALE = 64
K = 20
QUERY_BLOCK, DATA_BLOCK = 4096, 8192
#: A block holds no more bytes of vectors than this, however wide they are.
BLOCK_BYTES = 16 << 20
#: Bounds of the upper tree: its centres, and the rows it is grown on.
CELLS, SAMPLE = 1024, 4096
#: Rows of a leaf of either tree; children of an eighth of that, or fewer, share leaves.
QUERY_LEAF, DATA_LEAF = 16, 128
#: Sibling leaves of data that a leaf of queries meets in one product.
TOGETHER = 8
#: Scores and positions share a 64-bit integer while products stay below this.
EXACT = 1 << 46
NOTHING = np.iinfo(np.int64).min


# --- Cover trees -------------------------------------------------------------------------


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (points**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * (points @ centres.T)
    return np.sqrt(np.maximum(square, 0))


def net(points: np.ndarray, first: int, reach: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(centres, owner): rows over ``reach`` apart such that each row's nearest lies within it.

    With ``most`` the net stops at so many centres, and rows may lie further away.
    """
    centres, owner = [first], np.zeros(len(points), np.int64)
    nearest = _distances(points, points[[first]])[:, 0]
    nearest[first] = 0
    while most is None or len(centres) < most:
        far = np.flatnonzero(nearest > reach)[:256]
        if not len(far):
            break
        apart, new = _distances(points[far], points[far]) > reach, []
        free = np.ones(len(far), bool)
        for i in range(len(far)):
            if free[i] and (most is None or len(centres) + len(new) < most):
                new.append(far[i])
                free &= apart[i]
        distance = _distances(points, points[new])
        best = distance.argmin(1)
        least = distance[np.arange(len(points)), best]
        closer = least < nearest
        owner[closer], nearest[closer] = best[closer] + len(centres), least[closer]
        owner[new], nearest[new] = np.arange(len(new)) + len(centres), 0
        centres += new
    return np.array(centres), owner


@dataclass
class Tree:
    """Nodes as arrays; a node's rows are ``order[start:end]``, its children lie together."""

    order: np.ndarray
    centre: np.ndarray  # a row
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray  # the first child, 0 for a leaf
    children: np.ndarray  # how many

    FIELDS = ("order", "centre", "radius", "start", "end", "child", "children")


def _middle(points: np.ndarray) -> int:
    return int(_distances(points, points.mean(0)[None])[:, 0].argmin())


def build(points: np.ndarray, leaf: int = DATA_LEAF) -> Tree:
    """A cover tree: children's centres are apart by, and cover within, half their parent's radius.

    Each level of nodes is made from the one above, whatever its width. Children of too few
    rows for a node of their own are put together in leaves. A node's radius is measured.
    """
    points = points.astype(np.float64)
    order = np.arange(len(points))
    nodes = [[_middle(points), 0.0, 0, len(points), 0, 0]]
    at = 0
    while at < len(nodes):
        centre, _, start, end, _, _ = nodes[at]
        rows = order[start:end].copy()
        radius = float(_distances(points[rows], points[[centre]]).max(initial=0))
        nodes[at][1] = radius
        if end - start > leaf and radius > 0:
            inside = points[rows]
            centres, owner = net(inside, int(np.flatnonzero(rows == centre)[0]), radius / 2)
            size = np.bincount(owner, minlength=len(centres))
            large = np.flatnonzero(size > leaf // 8)
            rank = np.full(len(centres), len(large))
            rank[large] = np.arange(len(large))
            order[start:end] = rows[np.argsort(rank[owner], kind="stable")]
            made, put = len(nodes), start
            for i in large:
                nodes.append([int(rows[centres[i]]), 0.0, put, put + int(size[i]), 0, 0])
                put += int(size[i])
            for a in range(put, end, leaf):
                few = order[a : min(end, a + leaf)]
                nodes.append([int(few[_middle(points[few])]), 0.0, a, a + len(few), 0, 0])
            nodes[at][4:] = [made, len(nodes) - made]
        at += 1
    table = np.array(nodes, np.float64)
    ints = [table[:, i].astype(np.int64) for i in (0, 2, 3, 4, 5)]
    return Tree(order, ints[0], table[:, 1], *ints[1:])


class Best:
    """The k best (score, then earlier position) of each query so far, as one integer each."""

    def __init__(self, n: int, k: int, floor: np.ndarray, span: int):
        self.k, self.span = k, span
        self.keys = np.full((n, k), NOTHING)
        self.floor = floor.astype(np.int64)  # scores below this can't matter

    def add(self, at: slice, scores: np.ndarray, positions: np.ndarray) -> None:
        floor = self.floor[at]
        if not (scores >= floor[:, None]).any():
            return
        keys = np.where(scores >= floor[:, None], scores * self.span - positions, NOTHING)
        both = np.concatenate([self.keys[at], keys], 1)
        both = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        self.keys[at] = both
        least = both.min(1)
        full = least > NOTHING
        floor[full] = np.maximum(floor[full], -(-least[full] // self.span))


@dataclass
class Walk:
    """What a traversal met: pairs of rows in all, and pairs whose product was computed."""

    pairs: int = 0
    products: int = 0
    nodes: list[int] = field(default_factory=list)


def search(queries: np.ndarray, own: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray, tree: Tree | None = None, walk: Walk | None = None) -> list[tuple[int, int, int]]:
    """(query row, data row, score) of every query's k best rows with scores of ``floor`` or more.

    ``data`` is in the order of ``ids``; rows with the query's own id are left out. Components
    so large that a score may pass 2^46 are multiplied by Python's integers, without a tree.
    """
    wide = max(queries.shape[1], data.shape[1])
    queries, data = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (queries, data))
    if float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * wide >= EXACT:
        return _by_python(queries, own, data, ids, k, floor)
    span = len(data) + 1
    q, d = queries.astype(np.float64), data.astype(np.float64)
    over, under = build(q, QUERY_LEAF), tree or build(d)
    q, d, own_, ids_ = q[over.order], d[under.order], own[over.order], ids[under.order]
    best = Best(len(q), k, np.maximum(floor, NOTHING >> 16)[over.order], span)
    centre_q, centre_d = queries[over.centre].astype(np.float64), data[under.centre].astype(np.float64)
    norm_q, norm_d = (np.sqrt((c**2).sum(1)) for c in (centre_q, centre_d))
    slack = 1e-6 * (1 + (norm_q[0] + over.radius[0]) * (norm_d[0] + under.radius[0]))

    def bounds(a, b):
        """Of one node with several: whichever is the array."""
        r, s = over.radius[a], under.radius[b]
        return (centre_q[a] * centre_d[b]).sum(-1) + norm_q[a] * s + norm_d[b] * r + r * s + slack

    def worst(a: int) -> int:
        return int(best.floor[over.start[a] : over.end[a]].min())

    def evaluate(a: int, leaves: np.ndarray, limit: np.ndarray) -> None:
        """Meet a leaf of queries with sibling leaves: the likeliest, then a few at a time."""
        nonlocal products
        at, order = slice(over.start[a], over.end[a]), np.argsort(-limit, kind="stable")
        for some in np.split(order, range(1, len(order), TOGETHER)):
            some = leaves[some[limit[some] >= worst(a)]]
            if not len(some):
                return
            rows = np.concatenate([np.arange(under.start[b], under.end[b]) for b in some])
            scores = np.rint(q[at] @ d[rows].T).astype(np.int64)
            products += scores.size
            same = own_[at][:, None] == ids_[rows][None, :]
            if same.any():
                scores = np.where(same, NOTHING // (2 * span), scores)
            best.add(at, scores, under.order[rows])

    heap, n, products = [(-float(bounds(0, 0)), 0, 0, 0)], 0, 0
    while heap:
        high, _, a, b = heapq.heappop(heap)
        if -high < worst(a):
            continue
        if over.children[a] and (over.radius[a] >= under.radius[b] or not under.children[b]):
            some = np.arange(over.child[a], over.child[a] + over.children[a])
            for x, limit in zip(some.tolist(), bounds(some, b).tolist(), strict=True):
                if limit >= worst(x):
                    n += 1
                    heapq.heappush(heap, (-limit, n, x, b))
            continue
        some = np.arange(under.child[b], under.child[b] + under.children[b]) if under.children[b] else np.array([b])
        limit = bounds(a, some)
        leaves = (under.children[some] == 0) & (not over.children[a])
        for i in np.flatnonzero(~leaves & (limit >= worst(a))).tolist():
            n += 1
            heapq.heappush(heap, (-float(limit[i]), n, a, int(some[i])))
        if leaves.any():
            evaluate(a, some[leaves], limit[leaves])
    if walk is not None:
        walk.pairs += len(q) * len(d)
        walk.products += products
        walk.nodes += [len(over.centre), len(under.centre)]
    rows, ways = np.nonzero(best.keys > NOTHING)
    key = best.keys[rows, ways]
    score = -(-key // span)
    at = score * span - key
    fine = own_[rows] != ids[at]
    return list(zip(over.order[rows[fine]].tolist(), at[fine].tolist(), score[fine].tolist(), strict=True))


def _by_python(queries, own, data, ids, k, floor) -> list[tuple[int, int, int]]:
    """For components too large for machine integers: plain sums, held to the long range."""
    out, most = [], np.iinfo(np.int64).max
    rows = [list(map(int, x)) for x in data]
    for i, q in enumerate(queries):
        q = list(map(int, q))
        found = [(max(-most, min(most, sum(a * b for a, b in zip(q, x, strict=True)))), -j) for j, x in enumerate(rows) if ids[j] != own[i]]
        out += [(i, -j, s) for s, j in heapq.nlargest(k, found) if s >= floor[i]]
    return out


# --- Spark -----------------------------------------------------------------------------


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component; unusable vectors are left out."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(9e18)), F.lit(-9e18))))
    return embeddings.filter(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(sizes.max(initial=0))
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])] = flat
    return out


def grow(sample: np.ndarray, most: int) -> np.ndarray:
    """Centres of the upper tree, in the tree's order: neighbours in it are near each other."""
    points = sample.astype(np.float64)
    if not len(points):
        return np.zeros((0, 0))
    chosen, waiting = [], [(np.arange(len(points)), _middle(points))]
    share = most / len(points)
    while waiting:
        rows, centre = waiting.pop()
        room = max(1, int(len(rows) * share))
        inside = points[rows]
        radius = float(_distances(inside, points[[centre]]).max())
        if room == 1 or radius == 0:
            chosen.append(centre)
            continue
        centres, owner = net(inside, int(np.flatnonzero(rows == centre)[0]), radius / 2, min(room, 16))
        if len(centres) == 1:
            chosen.append(centre)
            continue
        waiting += [(rows[owner == i], int(rows[c])) for i, c in reversed(list(enumerate(centres)))]
    return points[np.array(chosen)]


def _sample(rows: DataFrame, n: int, most: int) -> np.ndarray:
    """At most ``most`` different rows, those of the smallest hashes."""
    h = F.xxhash64("vec_id", "v")
    unit = h.bitwiseAND(F.lit((1 << 62) - 1)) / F.lit(float(1 << 62))
    some = rows.filter(unit < F.lit(min(1.0, 4 * most / max(n, 1)))).withColumn("h", h)
    found = some.groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(most).select("v").toArrow()
    return _matrix(found.column(0).combine_chunks())


def _celled(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows with the cell of their nearest centre and the distance to it."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    size = (centres**2).sum(1)

    @F.pandas_udf("cell int, away double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        centres = shared.value
        cells, away = [], []
        for at in range(0, len(v), 1024):
            full = _matrix(pa.array(v[at : at + 1024], pa.list_(pa.int64()))).astype(np.float64)
            x = np.pad(full, ((0, 0), (0, max(0, centres.shape[1] - full.shape[1]))))
            inside = x[:, : centres.shape[1]]
            best = (size - 2 * (inside @ centres.T)).argmin(1)
            cells.append(best)
            beyond = (x[:, centres.shape[1] :] ** 2).sum(1)
            away.append(np.sqrt(((inside - centres[best]) ** 2).sum(1) + beyond))
        return pd.DataFrame({"cell": np.concatenate(cells).astype(np.int32), "away": np.concatenate(away)})

    return rows.withColumn("c", nearest("v")).select(*rows.columns, "c.cell", "c.away")


@dataclass
class Cells:
    """Per cell: how many rows, how far the furthest, and the blocks that hold it."""

    count: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    blocks: np.ndarray
    n_blocks: int


def _laid_out(celled: DataFrame, n_cells: int, block: int) -> Cells:
    """Cells in tree order share blocks of about ``block`` rows; a larger cell takes several."""
    count, radius = np.zeros(n_cells, np.int64), np.zeros(n_cells)
    for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect():
        count[r["cell"]], radius[r["cell"]] = r["n"], r["away"]
    first, blocks, at, room = np.zeros(n_cells, np.int64), np.ones(n_cells, np.int64), -1, 0
    for i in np.flatnonzero(count):
        if count[i] > room:
            first[i], blocks[i] = at + 1, -(-count[i] // block)
            at += int(blocks[i])
            room = block - count[i] if blocks[i] == 1 else 0
        else:
            first[i], room = at, room - count[i]
    return Cells(count, radius, first, blocks, at + 1)


def _dealt(celled: DataFrame, cells: Cells, name: str) -> DataFrame:
    """Each row's block: its cell's, by the hash of id and vector where the cell has several."""
    spark = celled.sparkSession
    layout = spark.createDataFrame([(int(i), int(cells.first[i]), int(cells.blocks[i])) for i in np.flatnonzero(cells.count)], "cell int, first int, blocks int")
    salt = F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int")
    return celled.join(F.broadcast(layout), "cell").withColumn(name, F.col("first") + salt).drop("first", "blocks")


_ARRAYS = ", ".join(f"{f} array<{'double' if f == 'radius' else 'long'}>" for f in Tree.FIELDS)
INDEXED = f"d int, d_rows array<struct<vec_id: long, v: array<long>>>, {_ARRAYS}"


def indexed(dealt: DataFrame) -> DataFrame:
    """One row per data block: its rows in order of id, and their cover tree."""
    blocks = dealt.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("d_rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree = build(_matrix(batch.column(1)[i].values.field("v")))
                arrays = [pa.array([getattr(tree, f)]) for f in Tree.FIELDS]
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), *arrays], names=["d", "d_rows", *Tree.FIELDS])

    return blocks.mapInArrow(run, INDEXED)


def _searched(asked: DataFrame, data: DataFrame, k: int, tasks: int) -> DataFrame:
    """``asked`` (q, d, vec_id, v, floor): queries by block and data block, each searched together."""
    groups = asked.groupBy("q", "d").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v", "floor"))).alias("q_rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, d = (batch.column(c)[i].values for c in ("q_rows", "d_rows"))
                q_ids, d_ids = (x.field("vec_id").to_numpy() for x in (q, d))
                tree = Tree(*(batch.column(f)[i].values.to_numpy() for f in Tree.FIELDS))
                found = search(_matrix(q.field("v")), q_ids, _matrix(d.field("v")), d_ids, k, q.field("floor").to_numpy(), tree)
                a, b, s = (np.array(c, np.int64) for c in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[a]), pa.array(d_ids[b]), pa.array(s)], names=["query_id", "vec_id", "score"])

    pairs = groups.join(data, "d").repartition(max(1, tasks), "q", "d")
    return pairs.select("q_rows", "d_rows", *Tree.FIELDS).mapInArrow(run, "query_id long, vec_id long, score long")


def cell_bounds(centres: np.ndarray, queries: Cells, data: Cells) -> np.ndarray:
    """The most that any score of a query cell with a data cell can be; -inf for an empty cell."""
    norm = np.sqrt((centres**2).sum(1))
    r, s = queries.radius[:, None], data.radius[None, :]
    bound = centres @ centres.T + norm[:, None] * s + norm[None, :] * r + r * s
    bound = bound * (1 + 1e-9) + 1e-6 * (1 + np.abs(bound).max(initial=0))
    return np.where((queries.count[:, None] > 0) & (data.count[None, :] > 0), bound, -np.inf)


def top_k(embeddings: DataFrame, every: int = 20, k: int = K, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK, most_cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for ids divisible by ``every``.

    Ties go to the smaller vec_id. Rows that share the query's vec_id are its own and no
    candidates; rows that repeat another vec_id are candidates each; a repeated query is
    asked once (its smallest vector). Vectors that are null or hold nulls or non-finite
    numbers take no part; a shorter vector counts as padded with zeros. Products beyond the
    long range are held to it. Other columns are ignored; an empty table gives no rows.

    The driver holds the sample, the cells and their pairs, all bounded by parameters; what
    is broadcast has one row a cell, ``most_cells`` at most.
    """
    rows = materialize(integer_vectors(embeddings), "vectors")
    spark = rows.sparkSession
    seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("wide")).first()
    n, wide = seen["n"], max(1, seen["wide"])
    block_rows = max(1, BLOCK_BYTES // (8 * wide))
    query_block, data_block = min(query_block, block_rows), min(data_block, block_rows)
    most = max(1, min(most_cells, block_rows, -(-8 * n // data_block)))
    centres = grow(_sample(rows, n, min(SAMPLE, 4 * block_rows)), most)
    if not len(centres):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    celled = materialize(_celled(rows, centres), "celled")
    asked = celled.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "cell", "away")).alias("m")).select("vec_id", "m.v", "m.cell", "m.away")
    asked = materialize(asked, "queries")
    data_cells, query_cells = _laid_out(celled, len(centres), data_block), _laid_out(asked, len(centres), query_block)
    data = materialize(indexed(_dealt(celled, data_cells, "d")), "data-blocks")
    queries = _dealt(asked, query_cells, "q")

    # each query cell's home: one block of the cell that its centre agrees with most
    agree = np.where(data_cells.count[None, :] > 0, centres @ centres.T, -np.inf)
    home = data_cells.first[agree.argmax(1)]
    homes = spark.createDataFrame([(int(c), int(home[c])) for c in np.flatnonzero(query_cells.count)], "cell int, d int")
    lowest = F.lit(1 - (1 << 63)).cast("long")
    tasks = len({(int(query_cells.first[c]) + i, int(home[c])) for c in np.flatnonzero(query_cells.count) for i in range(min(1024, query_cells.blocks[c]))})
    found = materialize(_searched(queries.join(F.broadcast(homes), "cell").withColumn("floor", lowest), data, k, tasks), "topk-first")

    kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth")).withColumnRenamed("query_id", "vec_id")
    floored = materialize(queries.join(kth, "vec_id", "left").withColumn("floor", F.coalesce("kth", lowest)), "floored")
    worst = np.full(len(centres), -np.inf)
    for r in floored.groupBy("cell").agg(F.min("floor").alias("floor")).collect():
        worst[r["cell"]] = float(r["floor"])
    near = np.argwhere((bound := cell_bounds(centres, query_cells, data_cells)) >= np.where(np.isfinite(bound), worst[:, None], np.inf))
    near = spark.createDataFrame(pa.table({"cell": near[:, 0].astype(np.int32), "d_cell": near[:, 1].astype(np.int32)}))
    layout = spark.createDataFrame([(int(i), int(data_cells.first[i]), int(data_cells.blocks[i])) for i in np.flatnonzero(data_cells.count)], "d_cell int, first int, blocks int")
    blocks = near.join(F.broadcast(layout), "d_cell").select("cell", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("d")).distinct()
    blocks = materialize(blocks.join(F.broadcast(homes), ["cell", "d"], "left_anti"), "cell-blocks")
    parts = spark.createDataFrame([(int(c), int(query_cells.first[c]), int(query_cells.blocks[c])) for c in np.flatnonzero(query_cells.count)], "cell int, first int, blocks int")
    met = blocks.join(F.broadcast(parts), "cell").select("d", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("q")).distinct().count()
    if met:
        found = found.unionByName(_searched(floored.join(blocks, "cell"), data, k, met))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

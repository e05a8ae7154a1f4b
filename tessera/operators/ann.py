"""An approximate vector index: k-means cells, searched cell by cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieval import KNN_BLOCK, query_blocks, top

#: Cells grow with the square root of the rows between these; a query probes this share of them.
FEWEST, MOST, PROBED, FIT_ROWS = 16, 1024, 0.625, 20_000


class CellIndex:
    """Centres from a bounded sample; every row is in a cell. ``rows``: vec_id, embedding, cell.

    Vectors that are null, hold nulls or are empty take no part.
    """

    def __init__(self, data: DataFrame, cells: int | None = None, fit_rows: int = FIT_ROWS, seed: int = 7):
        sound = data.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull()))
        n = sound.count()
        share = min(1.0, fit_rows / max(1, n))
        unit = F.xxhash64("vec_id", "embedding").bitwiseAND((1 << 32) - 1) / F.lit(float(1 << 32))
        vectors = sound.filter(unit < share).select(array_to_vector("embedding").alias("features"))
        wanted = cells or max(FEWEST, min(MOST, int(n**0.5 / 4)))
        model = KMeans(k=max(1, min(wanted, n)), seed=seed, maxIter=10).fit(vectors)
        self.centres = np.stack(model.clusterCenters())
        self.cells = len(self.centres)
        self.rows = self._cells(sound, 1).select("vec_id", "embedding", F.col("cells")[0].alias("cell"))

    def _cells(self, df: DataFrame, n: int) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.centres)

        @F.pandas_udf("array<int>")
        def nearest(embedding: pd.Series) -> pd.Series:
            centres = shared.value
            v = np.array(embedding.tolist(), np.float64).reshape(len(embedding), -1)
            away = (centres**2).sum(1)[None] - 2 * v @ centres.T
            return pd.Series(list(np.argsort(away, axis=1, kind="stable")[:, :n].astype(np.int32)))

        return df.withColumn("cells", nearest("embedding"))

    def search(self, queries: DataFrame, k: int, probe: int | None = None) -> DataFrame:
        """query_id, vec_id, score, rank of each query's k best rows in its nearest cells.

        Queries go to the data in blocks, as in ``retrieval.knn``; a block of rows is scored
        cell by cell, against the queries that probe the cell.
        """
        probe = probe or max(1, round(PROBED * self.cells))
        asked = self._cells(queries, probe).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "cells")
        parts = [self._block(block, k) for block in query_blocks(asked)]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        return top(found, k, tie="vec_id").select("query_id", "vec_id", "score", "rank")

    def _block(self, asked: DataFrame, k: int) -> DataFrame:
        collected = asked.toPandas()  # at most BROADCAST_BYTES of vectors
        ids = collected["query_id"].to_numpy(np.int64)
        q = np.array(collected["q"].tolist(), np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
        probed = np.zeros((len(ids), len(self.centres)), bool)
        for i, cells in enumerate(collected["cells"]):
            probed[i, list(cells)] = True
        shared = self.rows.sparkSession.sparkContext.broadcast((ids, q, probed))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q, probed = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows if len(q_ids) else 0, KNN_BLOCK):
                    part = batch.slice(at, KNN_BLOCK)
                    own, cell = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
                    v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                    score = np.full((len(q_ids), len(own)), -1.0)  # below any similarity: not probed
                    for c in np.unique(cell):
                        i, j = np.flatnonzero(probed[:, c]), np.flatnonzero(cell == c)
                        d = np.maximum((q[i] ** 2).sum(1)[:, None] + (v[j] ** 2).sum(1)[None] - 2 * q[i] @ v[j].T, 0)
                        score[np.ix_(i, j)] = np.round(1 / (1 + d), 6)
                    n = min(k, len(own))
                    limit = np.maximum(-np.partition(-score, n - 1, axis=1)[:, n - 1], 0.0)  # ties at the limit all go on
                    i, j = np.nonzero(score >= limit[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(own[j].astype(np.int64)), pa.array(score[i, j])], names=["query_id", "vec_id", "score"])

        return self.rows.select(F.col("vec_id").cast("long"), "embedding", "cell").mapInArrow(run, "query_id long, vec_id long, score double")

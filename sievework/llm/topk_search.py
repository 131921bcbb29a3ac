"""Exact top-k search by inner product, pruned with segment statistics at several resolutions.

Vectors are cut into segments of equal length. From a segment's mean and deviation alone follows a lower bound of the
distance of two vectors, sum(length * ((difference of means)**2 + (difference of deviations)**2)), and with the
vectors' lengths an upper bound of their inner product, sum(length * (product of means + product of deviations)).
Coarse segments are looked at first; what may still be among the k best is looked at with finer ones, and survivors
get their exact integer product.

Queries come in blocks and candidates in cells of bounded size; a pair of both is one group, so that no task gathers
more than that. A cell's k best of each query are merged at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import cut

K = 10
SCALE = 1024
EVERY = 100
CELL = 20_000
QUERY_BLOCK = 4_096
SEGMENTS = (4, 16)
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of means and deviations, scaled so that the product of two rows bounds the inner product from above."""
    n, d = x.shape
    parts = np.pad(x.astype(float), ((0, 0), (0, -d % segments))).reshape(n, segments, -1)
    return np.concatenate([parts.mean(axis=2), parts.std(axis=2)], axis=1) * np.sqrt(parts.shape[2])


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows, shorter ones filled with 0."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, resolutions: tuple[int, ...] = SEGMENTS) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best vectors with other ids; ties to smaller ids."""
    out = []
    stats = [(statistics(queries, s), statistics(vectors, s)) for s in resolutions]
    for at in range(0, len(queries), 64):
        block = slice(at, at + 64)
        coarse = stats[0][0][block] @ stats[0][1].T
        for row, q in enumerate(range(at, min(at + 64, len(queries)))):
            bound = coarse[row]
            alive = np.flatnonzero(ids != query_ids[q])
            if len(alive) > 4 * k:
                first = alive[np.argpartition(-bound[alive], 4 * k)[: 4 * k]]
                least = np.sort(vectors[first] @ queries[q])[-k]

                def reach(b, least=least):  # roundings must not drop a vector
                    return b + 1e-6 + 1e-9 * np.abs(b) >= least

                alive = alive[reach(bound[alive])]
                for of_queries, of_vectors in stats[1:]:
                    alive = alive[reach(of_vectors[alive] @ of_queries[q])]
            score = vectors[alive] @ queries[q]
            best = np.lexsort((ids[alive], -score))[:k]
            out += [(int(query_ids[q]), int(ids[alive[i]]), int(score[i])) for i in best]
    return out


def _cell(k: int):
    def cell(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if queries.num_rows and candidates.num_rows:
            width = max(1, *(int(np.diff(t.column("x").combine_chunks().offsets.to_numpy()).max()) for t in (queries, candidates)))
            found = search(queries.column("vec_id").to_numpy(), _matrix(queries.column("x"), width), candidates.column("vec_id").to_numpy(), _matrix(candidates.column("x"), width), k)
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], schema=FOUND)

    return cell


def usable(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, x): components as floor(SCALE * value). Rows without an id, and vectors that are null or hold null or non-finite components, are left out."""
    value = F.col(vector).cast("array<double>")
    fine = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(value, lambda v: F.floor(v * SCALE).cast("long")).alias("x"))


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k best other rows (all, if there are fewer).

    Rows that share the query's id are not its candidates; repeated queries are one query, repeated candidates are
    several. A shorter vector is filled with 0. Products must fit into 64 bits. Without usable rows there is no result.
    Other columns are ignored.
    """
    base = usable(vectors, vector, vec_id)
    asked = cut(base.where(F.col("vec_id") % every == 0).distinct())
    blocks, cells = -(-asked.count() // QUERY_BLOCK), -(-base.count() // CELL)
    whole = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long"))
    queries = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(blocks, 1)).cast("long"))).withColumn("cell", F.explode(whole(cells)))
    candidates = base.withColumn("cell", F.pmod(F.xxhash64("vec_id", F.col("x")), F.lit(max(cells, 1)).cast("long"))).withColumn("block", F.explode(whole(blocks)))
    found = queries.groupBy("block", "cell").cogroup(candidates.groupBy("block", "cell")).applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

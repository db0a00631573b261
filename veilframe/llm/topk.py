"""Exact top-k by inner product: norm-bucketed retrieval.

Vectors are range-partitioned by length, so a task holds a band of lengths, cut into buckets. A
query's k-th best score so far, divided by its own and the bucket's largest length, is the cosine a
bucket's vector needs. Above 1 the bucket is skipped; high cosines are pruned by the range that the
query's largest coordinate allows, low ones by length; what is left is verified by exact products.
Queries are kept in the shared folder and streamed in blocks by each task, so neither side is
broadcast and no pair leaves a task but a query's k best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import _open, scratch_dir

BUCKET = 2048
QUERY_BLOCK = 512
#: The longest vectors, scored first for lower bounds: so many rows come to the driver.
SEEDS = 256
#: From this cosine on, pruning by a coordinate pays.
COORDINATE_FROM = 0.6
SCALE = 256


def _rows(column: pa.Array) -> np.ndarray:
    """A matrix of the vectors, shorter ones filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if not len(lengths):
        return np.zeros((0, 0))
    width = int(lengths.max())
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.concatenate([x, np.zeros((len(x), width - x.shape[1]))], 1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as exact integers: in floating point where every partial sum is exact, else in Python's integers, held to 64 bits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object).dot(np.array([[int(x) for x in r] for r in b], object).T)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class _Best:
    """The k best of each query of a block: larger score, then smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        self.floor = np.full(n, -np.inf)

    def add(self, j: int, ids: np.ndarray, scores: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[j], scores]), np.concatenate([self.ids[j], ids])
        order = np.lexsort([ids, -scores.astype(np.float64), -scores])[: self.k] if len(scores) and scores.min() == -(2**63) else np.lexsort([ids, -scores])[: self.k]
        self.scores[j], self.ids[j] = scores[order], ids[order]
        if len(order) == self.k:
            self.floor[j] = max(self.floor[j], float(scores[order[-1]]))


def bucket_search(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, norms: np.ndarray, best: _Best,
    stats: dict | None = None
) -> None:
    """Add to best what a bucket, sorted by falling norm, has for the queries."""
    lengths = np.linalg.norm(queries, axis=1)
    top = norms[0]
    need = np.where(best.floor > -np.inf, best.floor, -np.inf)
    slack = 1 - 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(need > 0, need * slack / (lengths * top), -np.inf)
    active = ~(cosine > 1)
    by_coordinate = active & (cosine >= COORDINATE_FROM)
    units = None
    for j in np.flatnonzero(by_coordinate):
        if units is None:
            with np.errstate(divide="ignore", invalid="ignore"):
                units = np.nan_to_num(vectors / norms[:, None])
        q = queries[j] / lengths[j]
        f = int(np.argmax(np.abs(q)))
        to_axis, reach = np.arccos(np.clip(q[f], -1, 1)), np.arccos(min(1.0, cosine[j]))
        low, high = np.cos(min(np.pi, to_axis + reach)) - 1e-9, np.cos(max(0.0, to_axis - reach)) + 1e-9
        at = np.flatnonzero((units[:, f] >= low) & (units[:, f] <= high) & (norms >= need[j] * slack / lengths[j]) & (ids != query_ids[j]))
        if stats is not None:
            stats["verified"] = stats.get("verified", 0) + len(at)
        if len(at):
            scores = _product(vectors[at], queries[j : j + 1])[:, 0]
            good = scores >= best.floor[j]
            best.add(j, ids[at[good]], scores[good])
    rest = np.flatnonzero(active & ~by_coordinate)
    if not len(rest):
        return
    with np.errstate(divide="ignore", invalid="ignore"):
        shortest = np.nan_to_num(np.where(need[rest] > 0, need[rest] * slack / lengths[rest], 0)).min()
    n = int(np.searchsorted(-norms, -shortest, side="right"))
    if stats is not None:
        stats["verified"] = stats.get("verified", 0) + n * len(rest)
    scores = _product(vectors[:n], queries[rest])
    for c, j in enumerate(rest):
        column = scores[:, c]
        at = np.flatnonzero((column >= best.floor[j]) & (ids[:n] != query_ids[j]))
        if len(at) > 4 * best.k:  # the k best and their ties only
            edge = np.partition(column[at], len(at) - best.k)[len(at) - best.k]
            at = at[column[at] >= edge]
        if len(at):
            best.add(j, ids[at], column[at])


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, norm) of vectors(vec_id, embedding, ...): v = floor(scale * x) as double.

    Null ids, null vectors and vectors that hold null, NaN or an infinite component are left out.
    """
    x = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall(
        "x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ))
    rows = rows.select(
        "vec_id",
        F.transform("x", lambda x: F.rint(x * scale) + F.when(F.rint(x * scale) > x * scale, -1.0).otherwise(0.0)).alias("v")
    )
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row of vectors(vec_id, embedding, ...) its k best others.

    Candidates are all rows with another id. Ties go to the smaller id; repeated rows count as often as
    they stand, and repeated query rows each get their answer. Vectors of unequal length are compared with zeros filled
    up; see prepared() for rows that take no part. Scores beyond 64 bits are held at their limits.
    """
    spark = vectors.sparkSession
    rows = prepared(vectors, scale)
    path = scratch_dir(spark, "queries")
    rows.where(is_query).write.parquet(path)
    seeds = rows.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).collect()
    banded = rows.repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")

    def search(batches):
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        width = max(max((len(s["v"]) for s in seeds), default=0), 1)
        parts = [_rows(b.column(1)) for b in table]
        width = max([width, *(p.shape[1] for p in parts)])
        data = np.concatenate([_wide(p, width) for p in parts])
        ids, norms = (np.concatenate([b.column(i).to_numpy() for b in table]) for i in (0, 2))
        del table, parts
        fs, where = _open(path)
        number = 0
        for batch in pads.dataset(where, filesystem=fs, format="parquet").to_batches(
            columns=["vec_id", "v"], batch_size=QUERY_BLOCK, use_threads=False
        ):
            if not batch.num_rows:
                continue
            query_ids, queries = batch.column(0).to_numpy(), _rows(batch.column(1))
            wide = max(width, queries.shape[1])
            queries = _wide(queries, wide)
            best = _Best(len(queries), k)
            if seeds:  # bounds only: the seeds themselves come up in their own bucket
                first = _wide(_rows(pa.array([s["v"] for s in seeds], pa.list_(pa.float64()))), wide)
                found = _product(queries, first).astype(np.float64)
                found[query_ids[:, None] == np.array([s["vec_id"] for s in seeds])] = -np.inf
                if found.shape[1] >= k:
                    best.floor = np.partition(found, found.shape[1] - k, axis=1)[:, found.shape[1] - k]
            here = _wide(data, wide)
            for a in range(0, len(here), BUCKET):
                bucket_search(queries, query_ids, here[a : a + BUCKET], ids[a : a + BUCKET], norms[a : a + BUCKET], best)
            counts = [len(x) for x in best.ids]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(number, number + len(queries)), counts), pa.int64()),
                    pa.array(np.repeat(query_ids, counts), pa.int64()), pa.array(np.concatenate(best.ids), pa.int64()),
                    pa.array(np.concatenate(best.scores), pa.int64())
                ],
                names=["number", "query_id", "vec_id", "score"],
            )
            number += len(queries)

    found = banded.mapInArrow(search, "number long, query_id long, vec_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact top-k inner products: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz residual bounds.

Candidates are ranged by descending length into shards. The right singular vectors of all candidates, from their summed
products, turn every vector so that its first coordinates carry most of its length. For a query q and a candidate x the
product is at most |q||x|, and at most the product of their first coordinates plus the product of the lengths of what is
left. A pair is computed in whole numbers only where neither bound lies below the k-th best score known so far.

The first bound comes from the SEEDS longest candidates, against which every query is scored first. It tells the last
shard, in order of length, that can still hold a result, so that shards of short vectors are never met. Queries and
shards then meet in cells of at most about BLOCK queries and SHARD candidates; inside a cell candidates are taken from
the longest down and the bound rises with what is found. The best k of each query in each cell are ranked at the end.
Sizes of shards and blocks only divide the work, and no pair is left out except by a bound.

Rows without an id or without a usable vector take no part; rows are told apart by a number of their own, so that a
repeated row is a candidate for its twin, and for a repeated query every copy is answered. Vectors of different lengths
are padded with zeros. Ties go to the smaller id. Fewer candidates than k give all of them. An empty table gives an
empty result; other columns of the input are not read. Scores must fit a long, or the job ends with an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moltraj.llm.shared import table, written
from moltraj.llm.vectors import SCALE, longest, matrix, padded, summed, usable, whole_numbers

K = 5
SEEDS, SHARD, BLOCK = 1024, 65_536, 65_536
MOST_SHARDS = 4096
#: Pairs that are bounded at a time: queries by candidates.
QUERIES_AT_ONCE, CANDIDATES_AT_ONCE = 512, 2048
#: Share of the squared length that the first coordinates shall carry, and the share of open pairs above which a tile is multiplied whole.
LEADING, DENSE = 0.8, 0.05
#: Relative slack of bounds for rounding in double precision.
SLACK = 1e-9
#: Whole numbers below this are exact as doubles.
EXACT = 2.0**52


class Turned:
    """Vectors with their lengths, their leading turned coordinates and the lengths of the rest."""

    def __init__(self, whole: np.ndarray, turn: np.ndarray, leading: int):
        self.whole = whole
        self.real = whole.astype(np.float64)
        turned = self.real @ turn
        self.first = np.ascontiguousarray(turned[:, :leading])
        self.length = np.sqrt(np.einsum("ij,ij->i", self.real, self.real))
        rest = turned[:, leading:]
        self.rest = np.sqrt(np.einsum("ij,ij->i", rest, rest))


def exact_products(queries: Turned, candidates: Turned, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products of queries a with candidates b, pair by pair."""
    most = queries.length[a].max(initial=0) * candidates.length[b].max(initial=0)
    if most < EXACT:
        return np.einsum("ij,ij->i", queries.real[a], candidates.real[b]).astype(np.int64)
    if most >= 2.0**62:
        raise OverflowError("an inner product does not fit 64 bits")
    return np.einsum("ij,ij->i", queries.whole[a], candidates.whole[b])


class Best:
    """The k best (score, id) of each query so far, and the score that a new pair must reach."""

    def __init__(self, known: np.ndarray, k: int):
        self.k, self.known = k, known
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(query):
            return
        query, score, ident = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ident])
        order = np.lexsort((ident, -score, query))
        query, score, ident = query[order], score[order], ident[order]
        first = np.searchsorted(query, query)
        place = np.arange(len(query)) - first
        full = place == self.k - 1
        self.known[query[full]] = np.maximum(self.known[query[full]], score[full])
        keep = place < self.k
        self.query, self.score, self.id = query[keep], score[keep], ident[keep]


def search(queries: Turned, query_rows: np.ndarray, known: np.ndarray, candidates: Turned, rows: np.ndarray, ids: np.ndarray, k: int) -> Best:
    """The best k candidates of each query among those that may still count; candidates come by descending length."""
    best = Best(known.astype(np.float64), k)
    for low in range(0, len(rows), CANDIDATES_AT_ONCE):
        part = slice(low, low + CANDIDATES_AT_ONCE)
        first, rest, length = candidates.first[part], candidates.rest[part], candidates.length[part]
        reach = queries.length * length[0] * (1 + SLACK)
        open_queries = np.flatnonzero(reach >= best.known)
        if not len(open_queries):
            break
        for at in range(0, len(open_queries), QUERIES_AT_ONCE):
            q = open_queries[at : at + QUERIES_AT_ONCE]
            bound = queries.first[q] @ first.T
            bound += np.outer(queries.rest[q], rest)
            bound += SLACK * np.outer(queries.length[q], length)
            may = bound >= best.known[q][:, None]
            count = int(np.count_nonzero(may))
            if not count:
                continue
            exact = queries.length[q].max() * length[0] < EXACT
            if exact and count > DENSE * may.size:
                score = queries.real[q] @ candidates.real[part].T
                may &= score >= best.known[q][:, None]
                may &= query_rows[q][:, None] != rows[part][None, :]
                if k < may.shape[1]:
                    ranked = np.where(may, score, -np.inf)
                    may &= score >= -np.partition(-ranked, k - 1, axis=1)[:, k - 1 : k]
                a, b = np.nonzero(may)
                found = score[a, b].astype(np.int64)
            else:
                a, b = np.nonzero(may)
                other = query_rows[q[a]] != rows[b + low]
                a, b = a[other], b[other]
                found = exact_products(queries, candidates, q[a], b + low)
                high = found >= best.known[q[a]]
                a, b, found = a[high], b[high], found[high]
            best.add(q[a], found, ids[b + low])
    return best


def turn_of(rows: DataFrame, dims: int) -> tuple[np.ndarray, int]:
    """Right singular vectors of all rows, by falling singular value, and how many lead."""

    def products(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0), dims, np.float64)
        return (x.T @ x).ravel()

    values, turn = np.linalg.eigh(summed(rows.select("x"), products, dims * dims).reshape(dims, dims))
    values, turn = np.maximum(values[::-1], 0), turn[:, ::-1]
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    return np.ascontiguousarray(turn), int(min(dims, np.searchsorted(share, LEADING) + 1))


def numbered_vectors(vectors: DataFrame, key: str, vector: str, scale: int) -> tuple[DataFrame, int]:
    """`row`, `id`, `x` and `length` of every row that takes part, written, and the number of dimensions."""
    whole = vectors.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("id"), whole_numbers(vector, scale).alias("x"))
    dims = max(1, longest(whole, "x"))
    squares = F.aggregate("x", F.lit(0.0), lambda total, c: total + c.cast("double") * c.cast("double"))
    return written(whole.select(F.monotonically_increasing_id().alias("row"), "id", padded("x", dims).alias("x")).withColumn("length", F.sqrt(squares))), dims


def top_products(
    vectors: DataFrame, asked: Column, k: int = K, *, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
    seeds: int = SEEDS, shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """`query_id`, `rank` (from 1), the candidate's `key` and `score`: the k best of every row for which `asked` (on column `id`) holds."""
    spark = vectors.sparkSession
    rows, dims = numbered_vectors(vectors, key, vector, scale)
    total = rows.count()
    if not total:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(key), F.col("id").alias("score"))
    turn, leading = turn_of(rows, dims)
    per_shard = max(1, min(shard, math.ceil(total / spark.sparkContext.defaultParallelism)), math.ceil(total / MOST_SHARDS))
    by_length = [F.col("length").desc(), F.col("row")]
    ranged = rows.repartitionByRange(math.ceil(total / per_shard), *by_length).sortWithinPartitions(*by_length)
    candidates = written(ranged.withColumn("shard", F.spark_partition_id()))
    tops = candidates.groupBy("shard").agg(F.max("length").alias("top")).orderBy("shard").collect()
    longest_rows = rows.orderBy(*by_length).limit(seeds).select("row", "id", "x").toArrow()
    sent = spark.sparkContext.broadcast({
        "turn": turn, "leading": leading, "dims": dims, "shards": np.array([r["shard"] for r in tops]), "tops": np.array([r["top"] for r in tops]),
        "seed_x": matrix(longest_rows["x"], dims), "seed_rows": longest_rows["row"].to_numpy(), "seed_ids": longest_rows["id"].to_numpy(),
    })

    def first_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The score that the seeds guarantee, and the shards that a longer product can still come from."""
        held = sent.value
        seeds = Turned(held["seed_x"], held["turn"], held["leading"])
        for batch in batches:
            queries = Turned(matrix(batch.column("x"), held["dims"]), held["turn"], held["leading"])
            best = search(queries, batch.column("row").to_numpy(), np.full(batch.num_rows, -np.inf), seeds, held["seed_rows"], held["seed_ids"], k)
            within = queries.length[:, None] * held["tops"][None, :] * (1 + SLACK) >= best.known[:, None]
            # Tops fall with the shard, so that the shards within reach are the first ones.
            open_shards = [held["shards"][:count].tolist() for count in within.sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in ("row", "id", "x")], pa.array(best.known), pa.array(open_shards, pa.list_(pa.int32()))],
                names=["row", "id", "x", "known", "shards"],
            )

    blocks = max(1, math.ceil(rows.where(asked).count() / block))
    bounded = written(rows.where(asked).select("row", "id", "x").mapInArrow(first_bounds, "row long, id long, x array<long>, known double, shards array<int>"))
    placed = bounded.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    met = placed.select("row", "id", "x", "known", "block", F.explode("shards").alias("shard"))
    cells = placed.select("block", F.explode("shards").alias("shard")).distinct().toDF("block", "shard")
    dealt = candidates.join(cells, "shard").select("shard", "block", "row", "id", "x")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        held = sent.value
        queries = Turned(matrix(left["x"], held["dims"]), held["turn"], held["leading"])
        found = Turned(matrix(right["x"], held["dims"]), held["turn"], held["leading"])
        order = np.argsort(-found.length, kind="stable")
        ordered = Turned(found.whole[order], held["turn"], held["leading"])
        rows_of, ids = right["row"].to_numpy()[order], right["id"].to_numpy()[order]
        query_rows, query_ids = left["row"].to_numpy(), left["id"].to_numpy()
        best = search(queries, query_rows, left["known"].to_numpy(), ordered, rows_of, ids, k)
        columns = [query_rows[best.query], query_ids[best.query], best.id, best.score]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_row", "query_id", "id", "score"])

    found = met.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInArrow(cell, "query_row long, query_id long, id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


def op11_norm_sorted_products(spark: SparkSession, sf: str) -> DataFrame:
    return top_products(table(spark, sf, "embeddings"), F.col("id") % 50 == 0)


ORACLE_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
  FROM usable q JOIN usable v ON q.r <> v.r WHERE q.vec_id % 50 = 0),
placed AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 5
"""

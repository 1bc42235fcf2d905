"""Exact top-k inner products by MaxScore over sharded postings.

Each component of a vector is a term, and its column over a shard the term's postings. A query's
product with a term lies between two bounds that a shard's smallest and largest value give; taken above
the lower one, all impacts are at least 0, as MaxScore wants them. Terms are put in the order of their
bounds. The non-essential ones are those which together cannot lift a vector to the k-th best score so
far: every vector that can still enter must have impact in an essential term, so the essential postings are
traversed, and the others are probed only for vectors that stay competitive with what is left of the
bounds. Shards and blocks of queries meet in groups of bounded size. All queries meet the first shard before the others: the
k-th best score there is one to beat in every other shard, which then sends only what may still enter; what the shards
send is merged.

Defined results: vectors that are null, or hold null or non-finite components, and rows without id take no
part; vectors of different length have no product; a query's own row is left out, a repeated row is
not; equal scores go to the smaller id; fewer than k candidates are all returned; no query or an empty table, no rows;
repeated rows are candidates of their own; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from survista.llm.common import materialize

#: Vectors of a shard, and queries of a block, at most; and their bytes, on the average.
SHARD = 8192
QUERIES = 8192
BYTES = 8 << 20
STEP = 8
FOUND = "query_row bigint, query_id bigint, vec_id bigint, score double"


def scaled(vector: Column, by: int = 256) -> Column:
    """floor(by * x) of each component as double; null where the vector takes no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * by).cast("double")))


def search(postings: np.ndarray, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best vectors of a shard for one query; postings: terms x vectors."""
    high, low = postings.max(axis=1), postings.min(axis=1)
    return _search(postings, rows, ids, q, own, k, high, low)


def _search(postings, rows, ids, q, own, k, high, low, known=-np.inf):
    """known: a score that k other candidates have at least."""
    upper, least = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
    order = np.argsort(least - upper, kind="stable")  # widest range of impacts first
    upper, width = upper[order], (upper - least)[order]
    n = postings.shape[1]
    # the first vectors give the score to beat
    head = min(n, 4 * STEP * k)
    first = q @ postings[:, :head]
    first[rows[:head] == own] = -np.inf
    beat = max(known, -np.inf if head <= k else np.partition(first, -k)[-k])
    if beat > -np.inf:
        # non-essential: the narrowest terms that together stay under what must be gained over all lower bounds
        need = beat - least.sum()
        rest = np.cumsum(width[::-1])[::-1]
        essential = max(1, int(np.searchsorted(-rest, -need, side="right")))
    else:
        essential = len(order)
    terms = order[:essential]
    score = q[terms] @ postings[terms]
    score[rows == own] = -np.inf
    left = np.append(np.cumsum(upper[::-1])[::-1], 0.0)
    at = np.flatnonzero(score + left[essential] >= beat)
    score = score[at]
    for j in range(essential, len(order), STEP):
        probe = order[j : j + STEP]
        score = score + q[probe] @ postings[np.ix_(probe, at)]
        on = score + left[min(j + STEP, len(order))] >= beat
        if not on.all():
            at, score = at[on], score[on]
    on = score > -np.inf
    at, score = at[on], score[on]
    if len(at) > k:
        kth = np.partition(score, -k)[-k]
        at, score = at[score >= kth], score[score >= kth]
    best = np.lexsort((ids[at], -score))[:k]
    return ids[at][best], score[best]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_row, query_id, rank, vec_id, score. Both inputs: row (bigint, the same for a vector wherever it
    stands), vec_id bigint, vector array<double> without nulls."""
    size = F.coalesce(F.max(F.size("vector")), F.lit(1))
    (n, wide), m = vectors.agg(F.count(F.lit(1)), size).first(), queries.count()
    most = max(64, BYTES // (8 * max(1, wide)))
    shards, blocks = max(1, -(-n // min(shard, most))), max(1, -(-m // min(block, most)))
    dim = F.size("vector").alias("dim")
    part = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    v = vectors.select("row", "vec_id", "vector", dim, part(shards).alias("shard"))
    q = queries.select("row", "vec_id", "vector", dim, part(blocks).alias("block"))
    # shard 0 first: what it finds tells the others what to beat
    first = _met(v.where("shard = 0"), q.withColumn("known", F.lit(float("-inf"))), k, [0], blocks)
    found = first
    if shards > 1:
        first = materialize(first, "topk-first")
        beat = first.groupBy("query_row").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("known")).where(F.col("c") >= k)
        q = q.join(beat.select(F.col("query_row").alias("row"), "known"), "row", "left").withColumn("known", F.coalesce("known", F.lit(float("-inf"))))
        found = first.unionByName(_met(v.where("shard > 0"), q, k, range(1, shards), blocks))
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _met(v: DataFrame, q: DataFrame, k: int, shards, blocks: int) -> DataFrame:
    """What each block of queries finds in each of the shards: the k best at most, all not under what is known."""
    v = v.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = q.withColumn("shard", F.explode(F.sequence(F.lit(shards[0]), F.lit(shards[-1]))))
    q = q.toDF(*[f"_{c}" for c in q.columns]).select(*[F.col(f"_{c}").alias(c) for c in q.columns])  # columns apart from those of v

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if len(left) and len(right):
            postings = np.ascontiguousarray(_matrix(left["vector"]).T)
            rows, ids = left["row"].to_numpy(), left["vec_id"].to_numpy()
            high, low = (postings.max(axis=1), postings.min(axis=1)) if len(postings) else (np.zeros(0), np.zeros(0))
            for own, name, known, q in zip(right["row"].to_pylist(), right["vec_id"].to_pylist(), right["known"].to_pylist(), _matrix(right["vector"]), strict=True):
                got, score = _search(postings, rows, ids, q, own, k, high, low, known) if len(q) else _plain(rows, ids, own, k)
                out[0].extend([own] * len(got))
                out[1].extend([name] * len(got))
                out[2].extend(got.tolist())
                out[3].extend(score.tolist())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["query_row", "query_id", "vec_id", "score"])

    by = ["dim", "shard", "block"]
    return v.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(run, FOUND)


def _plain(rows: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors without components: all products are 0."""
    got = np.sort(ids[rows != own])[:k]
    return got, np.zeros(len(got))


def op2_top_k(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id IS NOT NULL")
    v = e.select("vec_id", scaled(F.col("embedding")).alias("vector")).where("vector IS NOT NULL")
    v = materialize(v.withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    t = top_k(v, v.where("vec_id % 50 = 0"), 5)
    return t.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x, row_number() OVER () AS r
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

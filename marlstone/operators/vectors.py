"""Exact nearest neighbours by inner product, and what is done with the hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Bytes of queries that go to every task.
QUERY_BYTES = 32 << 20
#: Queries and vectors of which one task works out all products at a time.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 16384


def _by_dimension(ids: pa.ChunkedArray, lists: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    found = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        own = pa.array(sizes == size)
        flat = pc.list_flatten(lists.filter(own)).to_numpy()
        found[size] = ids.filter(own).to_numpy(), flat.astype(np.float64).reshape(-1, size)
    return found


def _nearest(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """(query_id, vec_id, score): the k best of left (vec_id, embedding) for each of right (query_id, query)."""
    out = []
    found = _by_dimension(left["vec_id"], left["embedding"])
    for size, (query, rows) in _by_dimension(right["query_id"], right["query"]).items():
        if size not in found:
            continue
        vec, columns = found[size]
        rough = rows @ columns.T
        if len(vec) > k:
            least = np.partition(rough, -k, axis=1)[:, -k]
            i, j = np.nonzero(rough >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
        else:
            i, j = (x.ravel() for x in np.indices(rough.shape))
        score = np.zeros(len(i))
        for d in range(size):
            score += rows[i, d] * columns[j, d]
        order = np.lexsort((vec[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        best = nth < k
        out.append(pa.table({"query_id": query[i[best]], "vec_id": vec[j[best]], "score": score[best]}))
    return pa.concat_tables(out) if out else pa.table({"query_id": right["query_id"].slice(0, 0), "vec_id": left["vec_id"].slice(0, 0), "score": pa.array([], pa.float64())})


def _top(hits: pa.Table, k: int) -> pa.Table:
    """The k best hits of each query."""
    query, vec, score = (hits[c].to_numpy() for c in ("query_id", "vec_id", "score"))
    order = np.lexsort((vec, -score, query))
    first = np.searchsorted(query[order], query[order])
    return hits.take(pa.array(order[np.arange(len(order)) - first < k]))


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank) of the k best vectors for each query; ties by vec_id.

    All queries are compared with all vectors. Queries of QUERY_BYTES at most go to every task, which reads its vectors once and
    gives the k best of them for each query, so that hits alone are shuffled. More queries meet the vectors in blocks of either. Products that
    decide are added up in the order of the dimensions, so that equal vectors get equal scores. Vectors that are null,
    empty or of another dimension than the query are not found.
    """
    n_queries, size = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kinds = queries.schema["vec_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()
    if 8 * size <= QUERY_BYTES:
        sent = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).toArrow()

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for batch in batches:
                own = pa.Table.from_batches([batch])
                hits = pa.concat_tables([_nearest(own, sent.slice(at, QUERY_BLOCK), k) for at in range(0, max(1, sent.num_rows), QUERY_BLOCK)])
                found = hits if found is None else _top(pa.concat_tables([found, hits]), k)
            if found is not None:
                yield from found.combine_chunks().to_batches()

        scored = vectors.select("vec_id", "embedding").mapInArrow(best, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
        return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    query_blocks, vector_blocks = -(-n_queries // QUERY_BLOCK), -(-vectors.count() // VECTOR_BLOCK)
    place = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1))))
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), place(query_blocks).alias("q"), every(vector_blocks).alias("v"))
    v = vectors.select("vec_id", "embedding", place(vector_blocks).alias("v"), every(query_blocks).alias("q"))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        return _nearest(left, right, k)

    scored = v.groupBy("q", "v").cogroup(q.groupBy("q", "v")).applyInArrow(nearest, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def check_index(vectors: DataFrame, dimension: int) -> DataFrame:
    """One row: vectors, those of another dimension, those that aren't of unit length."""
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("embedding") != dimension).alias("n_other_dimension"), F.count_if(F.abs(norm - 1) > 1e-3).alias("n_not_unit"))


def union_first(hits: DataFrame) -> DataFrame:
    """Hits of several queries, each vector once, as the first query found it; then by score."""
    by = Window.partitionBy("vec_id").orderBy("query_id")
    return hits.withColumn("nth", F.row_number().over(by)).filter("nth = 1").drop("nth")


def retrieval_quality(hits: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Share of hits with the query's label (precision at k) and mean reciprocal rank of the first such hit."""
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    judged = hits.filter("query_id <> vec_id").join(labels.select("vec_id", "label"), "vec_id").join(own, "query_id")
    good = F.col("label") == F.col("wanted")
    each = judged.groupBy("query_id").agg((F.count_if(good) / F.lit(float(k))).alias("precision"), F.coalesce(1 / F.min(F.when(good, F.col("rank"))), F.lit(0.0)).alias("reciprocal"))
    return each.agg(F.round(F.avg("precision"), 6).alias("precision_at_k"), F.round(F.avg("reciprocal"), 6).alias("mrr"))

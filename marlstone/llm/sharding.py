"""Sharding: a uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS, SEED = 16, 20240229
#: Rows that one local permutation is meant to hold; the number of buckets follows the input.
BUCKET_ROWS, LEAST_BUCKETS = 250_000, 64


def hypergeometric(rng: np.random.Generator, good: int, total: int, draws: int) -> int:
    """How many of ``draws`` taken without replacement from ``total`` are among its ``good`` ones.

    Inverts the distribution function over all values within 14 standard deviations of the mode, which
    double precision can't tell from all values; numpy's own sampler ends at 10**9.
    """
    low, high = max(0, draws - (total - good)), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = 30 + int(14 * math.sqrt(draws * (good / total) * (1 - good / total) * (total - draws) / max(1, total - 1)))
    k = np.arange(max(low, mode - spread), min(high, mode + spread), dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(total - good - draws + k + 1)
    log_p = np.concatenate(([0.0], np.cumsum(step)))
    p = np.exp(log_p - log_p.max())
    at = int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right"))
    return int(max(low, mode - spread)) + min(at, len(p) - 1)


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """counts[i][s]: how many of bucket i's rows go to shard s, as in a uniform shuffle; the sums are exact."""
    rng = np.random.default_rng(seed)
    left, counts = list(shards), []
    for n in rows:
        total, need, line = sum(left), n, []
        for size in left:
            k = hypergeometric(rng, size, total, need) if need else 0
            line.append(k)
            total, need = total - size, need - k
        left = [a - b for a, b in zip(left, line, strict=True)]
        counts.append(line)
    return counts


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each row of docs (doc_id, text) with its shard and its place there: doc_id, size, text_crc32, law,
    shard, slot, grown_shard.

    Rows are dealt into buckets by a hash of doc_id. The driver sees one count per bucket and draws from
    them how many rows each bucket sends to each shard. A bucket permutes its rows by a seeded hash and cuts
    the order by its line of the matrix. Each shard permutes again, in slices of a second hash. The law is
    ``rows``: counts of the shards differ by one at most; slots run from 0 without gaps in each shard.

    Null text has no bytes, size 1 and the checksum of the empty text. Null doc_ids share one bucket. Rows
    that repeat a doc_id are told apart by checksum and size; full repeats are alike. Reruns agree, whatever
    the partitions of the input. Only doc_id and text are read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = docs.count()
    buckets = max(LEAST_BUCKETS, -(-n // bucket_rows))
    bits = max(4, math.ceil(math.log2(max(1, n / shards / bucket_rows))))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(buckets)).cast("int")
    counts = sorted(tuple(r) for r in docs.select(bucket.alias("b")).groupBy("b").count().collect())
    exact = [n // shards + (s < n % shards) for s in range(shards)]
    lines = communication_matrix([c for _, c in counts], exact, seed)
    matrix = spark.createDataFrame(
        [(b, [int(x) for x in np.cumsum(line)]) for (b, _), line in zip(counts, lines, strict=True)], "bucket int, ends array<bigint>"
    )
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), bucket.alias("bucket"))
    local = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "text_crc32", "size")
    sent = (
        rows.withColumn("nth", F.row_number().over(local) - 1)
        .join(matrix, "bucket")
        .withColumn("shard", F.size(F.filter("ends", lambda end: end <= F.col("nth"))))
        .withColumn("key", F.xxhash64(F.lit(seed + 2), "bucket", "nth"))
        .withColumn("slice", F.shiftrightunsigned("key", 64 - bits))
        .select("doc_id", "size", "text_crc32", "shard", "slice", "key", "bucket", "nth")
        .repartition("shard", "slice")
    )
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "slice").count().select("shard", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    second = Window.partitionBy("shard", "slice").orderBy("key", "bucket", "nth")
    return (
        sent.withColumn("rank", F.row_number().over(second) - 1)
        .join(starts, ["shard", "slice"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("start") + F.col("rank")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )

"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import fresh, materialize, utf8

WEIGHTS, MOST_REPEATS, SEED = (1, 2, 3), 3, 20240301
#: Rows of a source, or copies of the range-sorted queue, that one running sum is meant to hold.
SLICE_ROWS = 250_000


@F.pandas_udf(T.LongType())
def word_count(text: pd.Series) -> pd.Series:
    return text.map(lambda data: len(data.split()))


def _numbered(totals: DataFrame) -> DataFrame:
    """Sources (source, source_size) with their 0-based rank by code point, null last; no single-task sort."""
    table = materialize(
        totals.repartitionByRange(F.col("source").isNull(), "source").withColumn("pid", F.spark_partition_id()), "sources"
    )
    starts, at = [], 0
    for pid, n in sorted(tuple(r) for r in table.groupBy("pid").count().collect()):
        starts.append((pid, at))
        at += n
    by = Window.partitionBy("pid").orderBy(F.col("source").asc_nulls_last())
    offsets = table.sparkSession.createDataFrame(starts, "pid int, start long")
    return table.withColumn("nth", F.row_number().over(by) - 1).join(offsets, "pid").select("source", "source_size", (F.col("start") + F.col("nth")).alias("rank"))


def _water_level(sources: DataFrame, budget: int, most: int) -> float:
    """Words per unit of weight of the sources below their cap; one small sum per round."""
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * level >= most * F.col("source_size")
        row = sources.agg(
            F.count(F.when(full, 1)).alias("n"),
            F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if row["n"] == capped or not row["weight"]:
            return level
        capped, level = row["n"], (budget - row["held"]) / row["weight"]


def _cut(queue: DataFrame, budget: int, most: int, range_copies: int) -> tuple[float, int, int] | None:
    """The first copy that the budget leaves out, as (virtual finish time, source rank, words up to its end); None if
    all fit.

    All copies are range-sorted by these three, which no two copies share. The driver sees the words of each
    range; the range where the budget ends is summed copy by copy.
    """
    rounds = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("round")
    copies = queue.filter("size > 0").select("size", "rank", "target", "source_size", "upto", rounds)
    copies = copies.select(finish_time(F.col("round")).alias("finish"), "rank", "upto", "size")
    ranges = max(1, -(-most * queue.count() // range_copies))
    ranged = materialize(copies.repartitionByRange(ranges, "finish", "rank", "upto").withColumn("range", F.spark_partition_id()), "mix-order")
    before = 0
    for at, words in sorted(tuple(r) for r in ranged.groupBy("range").agg(F.sum("size")).collect()):
        if before + words > budget:
            break
        before += words
    else:
        return None
    served = Window.partitionBy("range").orderBy("finish", "rank", "upto").rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.filter(F.col("range") == at).withColumn("words", F.lit(before) + F.sum("size").over(served))
    return tuple(inside.filter(F.col("words") > budget).agg(F.min(F.struct("finish", "rank", "upto")).alias("cut")).select("cut.*").first())


def finish_time(round_: F.Column) -> F.Column:
    return (round_ * F.col("source_size") + F.col("upto")) / F.col("target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """For each row of docs (doc_id, text, source): doc_id, size, source_size, target, taken, source, text_hash, copies.

    size counts words ``[^\\x20\\x09-\\x0D]+``. Sources by code point (null last) weigh ``weights`` in turn and
    share the total of all sizes; none gets more than ``most`` times its size, and what is over is shared anew.
    A source's queue is its documents in the order of a seeded hash, repeated ``most`` times; a copy's virtual
    finish time is the words up to its end by the source's target. Copies are range-sorted by finish time (ties by
    source, then place in the source's queue) and truncated before the one that passes the budget. Running sums go
    by (source, slice of the hash) and by range, so one source may hold any share, and any number of copies may
    finish at one time.

    taken = copies * size. Null text and text without words have size 0 and are never taken. Full repeats of a
    row queue as rows of their own. Reruns agree, whatever the partitions. Further columns are not read. An
    empty table gives no rows.
    """
    bits = max(6, math.ceil(math.log2(max(1, docs.count() / slice_rows))))
    base = docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), word_count(utf8()).alias("size"))
    base = base.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))
    base = materialize(base.withColumn("slice", F.shiftrightunsigned("key", 64 - bits)), "mix-rows")
    parts = base.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    sources = _numbered(parts.groupBy("source").agg(F.sum("words").alias("source_size")))
    share = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", share)
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    level = _water_level(sources, budget, most)
    target = F.least(F.col("weight") * F.lit(level), (most * F.col("source_size")).cast("double"))
    sources = sources.select(F.col("source").alias("name"), "source_size", "rank", target.alias("target"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("name"), F.col("slice").alias("part"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    parts = parts.join(sources.withColumnRenamed("name", "of"), F.col("name").eqNullSafe(F.col("of"))).drop("of")
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    queue = base.withColumn("within", F.sum("size").over(inside)).join(parts, F.col("source").eqNullSafe(F.col("name")) & (F.col("slice") == F.col("part")))
    queue = materialize(
        queue.select("doc_id", "source", "text_hash", "size", "source_size", "target", "rank", (F.col("start") + F.col("within")).alias("upto")), "mix-queue"
    )
    cut = _cut(queue, budget, most, slice_rows)
    end = cut and F.struct(F.lit(cut[0]).alias("finish"), F.lit(cut[1]).cast("long").alias("rank"), F.lit(cut[2]).cast("long").alias("upto"))
    place = lambda r: F.struct(finish_time(F.lit(r)).alias("finish"), F.col("rank").cast("long").alias("rank"), F.col("upto").cast("long").alias("upto"))
    served = [F.when(place(r) < end, 1).otherwise(0) if cut else F.lit(1) for r in range(most)]
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(sum(served[1:], served[0]))
    return queue.withColumn("copies", copies).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "text_hash", "copies"
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that mix() takes, each as often as it takes them.

    Rows that repeat doc_id, source and text may differ in further columns: they are numbered, and each gets
    the copies of one of their entries in the queue. Null columns match null ones. Names of columns don't matter. An
    empty table gives no rows.
    """
    ident, source, text_hash, copies, nth = fresh(docs, "ident", "source_of", "text_hash", "copies", "nth")
    taken = mix(docs, **options).filter("copies > 0").select(F.col("doc_id").alias(ident), F.col("source").alias(source), F.col("text_hash").alias(text_hash), F.col("copies").alias(copies))
    key, number = fresh(docs.withColumns({c: F.lit(0) for c in (ident, source, text_hash, copies, nth)}), "key", "number")
    once = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col(ident)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(key) == F.col(text_hash))
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        taken = taken.withColumn(nth, F.row_number().over(Window.partitionBy(ident, source, text_hash).orderBy(F.desc(copies))))
        once = once.withColumn(number, F.row_number().over(Window.partitionBy("doc_id", "source", key).orderBy(F.xxhash64("*"))))
        same &= F.col(nth) == F.col(number)
    return once.join(taken, same).withColumn(key, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)

"""What is there: counts of files, languages, sizes; caps on a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def language_counts(files: DataFrame, order: str) -> DataFrame:
    """Files per language, most first; ties by the first seen."""
    return files.filter("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), F.min(order).alias("first_seen"))


def top_and_other(counts: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` largest groups and one more of the rest."""
    top = counts.orderBy(F.desc("n_files"), "first_seen").limit(keep).select(F.col("language").alias("top"))
    named = counts.join(top, F.col("language") == F.col("top"), "left")
    return named.groupBy(F.coalesce("top", F.lit("other")).alias("language")).agg(F.sum("n_files").alias("n_files"))


def within_caps(files: DataFrame, order: str, most: int, included: str) -> DataFrame:
    """The files that a scan in this order reaches before ``most`` are included or 3 * ``most`` are seen.

    The caps bound what is looked at: the first 3 * most rows by order, taken as a top-k.
    """
    reached = files.orderBy(order).limit(3 * most)
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = reached.withColumn("included_before", F.coalesce(F.sum(F.col(included).cast("long")).over(before), F.lit(0)))
    return counted.filter((F.col("included_before") < most) & F.col(included))


def largest(files: DataFrame, k: int) -> DataFrame:
    return files.orderBy(F.desc("size_bytes"), "path").limit(k)


def footprint(files: DataFrame, by: str) -> DataFrame:
    return files.groupBy(by).agg(F.sum("size_bytes").alias("bytes"), F.count(F.lit(1)).alias("n_files"))


def upper_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """Per group: count, maximum, and the element at floor(n / 2) of the sorted values, by rank instead of a list."""
    ranked = df.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(value)) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(by)))
    return ranked.groupBy(by).agg(F.max("n").alias("n"), F.max(value).alias("longest"), F.max(F.when(F.col("nth") == F.floor(F.col("n") / 2), F.col(value))).alias("upper_median"))

"""Incremental analysis of files as they arrive (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import findings


def arriving(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, arrived timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def finding_counts(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Findings of arriving documents by window and rule; rows later than ``late`` are left out, state is bounded."""
    text = F.regexp_replace("text", "\r\n?", "\n")
    rows = stream.withWatermark("arrived", late).select("arrived", F.explode(F.split(text, "\n", -1)).alias("line"))
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(r)) for r, _, _, _, p in findings.LINE_RULES]))
    found = rows.select("arrived", F.explode(hits).alias("rule"))
    return found.groupBy(F.window("arrived", window).alias("window"), "rule").agg(F.count(F.lit(1)).alias("n"))

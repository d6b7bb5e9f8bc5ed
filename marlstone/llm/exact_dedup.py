"""Exact dedup: a tree merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import WS_RUN, materialize

#: Bits of the run number that one round of exchanges merges; a round merges 2**ROUND_BITS runs.
ROUND_BITS, ROUNDS = 4, 2


def exact_dedup(docs: DataFrame, round_bits: int = ROUND_BITS, rounds: int = ROUNDS) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Rows start in 2**(round_bits * rounds) runs by a hash of doc_id. A run holds one entry per digest: the
    smallest doc_id and a count. In round r, the runs whose numbers agree above the lowest ``round_bits`` bits
    exchange: each takes a further slice of the digest range, so that merging never brings everything to one
    place. Each merge sorts by digest and identifier and retains the first. Runs are located by a 64-bit
    digest and verified by the full SHA-256. Results go back down the tree by (run, digest), so a text that
    a third of all rows share is spread over all runs in either direction. Texts are read and digested once; the
    digests are written to the shared folder, from where both directions read them.

    Null text counts as empty. White space runs count as one space. Null doc_ids come last, so they are kept
    only in a group without any other. Rows that repeat both doc_id and text count in group_size, and one of
    them is kept. Only doc_id and text are read, so further columns don't matter. An empty table gives no rows.
    """
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), WS_RUN, " ")
    digests = docs.select("doc_id", F.unhex(F.sha2(norm, 256)).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << round_bits * rounds)).cast("int").alias("run"))
    rows = materialize(digests, "digests").repartition("run", "digest")
    leaves = rows.groupBy("run", "digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    level = leaves.withColumn("place", F.xxhash64("digest"))
    for r in range(1, rounds + 1):
        level = (
            level.withColumn("run", F.shiftright("run", round_bits))
            .withColumn("slice", F.shiftrightunsigned("place", 64 - round_bits * r))
        )
        merged = Window.partitionBy("slice", "run", "digest")
        level = (
            level.withColumn("total", F.sum("n").over(merged))
            .withColumn("nth", F.row_number().over(merged.orderBy(F.col("keep_id").asc_nulls_last())))
            .filter("nth = 1")
            .select("run", "digest", "place", "keep_id", F.col("total").alias("n"))
        )
    root = level.select("digest", "keep_id", F.col("n").alias("group_size"))
    down = leaves.select("run", "digest").join(root, "digest")
    again = Window.partitionBy("run", "digest", "doc_id").orderBy("keep_id")
    return rows.join(down, ["run", "digest"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(again) == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

"""MinHash near-dedup by tensored banding.

A set has SMALL small collections of WIDTH minhashes each. A table's key combines a pair of collections, so that
SMALL * (SMALL - 1) / 2 tables with keys of 2 * WIDTH minhashes come from SMALL * WIDTH minhashes, about the square root of what tables
with hashes of their own would take. Two sets of similarity s share a collection with probability s ** WIDTH, and meet in a table if
they share two of the SMALL: at 0.85 all but 1 in 20 million such pairs do. Whatever meets is compared on the whole sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.jaccard_join import Join, linked_components
from marlstone.llm.shingles import mix

WORDS, NUMERATOR, DENOMINATOR = 3, 17, 20
SMALL, WIDTH = 16, 2
#: Shingles of which all minhashes are computed at once.
BLOCK = 1 << 14

_SEEDS = mix(np.arange(1, SMALL * WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
_FIRST, _SECOND = np.triu_indices(SMALL, 1)
_TABLE = mix(np.arange(1, len(_FIRST) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_ODD, _SHIFT = np.uint64(0x9FB21C651E98DF25), np.uint64(32)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """SMALL * WIDTH minhashes of a set that is not empty."""
    least = np.full(SMALL * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), BLOCK):
        x = (shingles[start : start + BLOCK] ^ _SEEDS) * _ODD
        x ^= x >> _SHIFT
        x *= _ODD
        np.minimum(least, x.min(1), out=least)
    return least


def table_keys(shingles: np.ndarray, hot: np.ndarray | None = None) -> np.ndarray:
    """One key for each pair of small collections."""
    parts = minhashes(shingles).reshape(SMALL, WIDTH)
    small = np.zeros(SMALL, np.uint64)
    for column in parts.T:
        small = mix(small + column)
    return np.unique(mix(mix(small[_FIRST] ^ _TABLE) + small[_SECOND]))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents link when 20 * |intersection| >= 17 * |union| of their sets of three-word shingles, which is confirmed on the whole sets;
    component_id is the smallest doc_id that links reach, and the row with that doc_id is kept. Equal sets are one class
    before anything is compared. Groups that share a key are compared pairwise if small, else with their most typical member, and what
    that leaves apart in blocks: no pair that shares a key is left out. Null text and text without words have an empty set, are linked
    with nothing and are kept. Null doc_ids name a component only if it has no other; such rows are kept then. Rows that repeat a doc_id
    are each a row. Further columns are not read. An empty table gives no rows.
    """
    found = linked_components(docs, Join(table_keys, WORDS, NUMERATOR, DENOMINATOR))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

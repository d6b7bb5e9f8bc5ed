"""Line dedup: a log-template tree; lines whose template recurs across documents are dropped.

The tree has a fixed depth: a line's number of tokens, then its leading tokens, then the template. Tokens with
a digit are variable and stand as one mark. In a leaf, templates that differ within one of SEGMENTS stretches
are the same with that stretch left open, if what stays fixed is long enough: so a name, place or amount that
varies doesn't hide boilerplate. Of the documents with a template, the one with the smallest doc_id keeps it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fresh, map_batches, materialize

#: Leading tokens that the tree looks at; tokens that a line needs to have a template at all; stretches of
#: which one may vary, in lines of so many tokens.
LEADING, LEAST_TOKENS, SEGMENTS, LEAST_OPEN_TOKENS = 3, 5, 4, 16
DIGIT, VARIABLE = re.compile(rb"\d"), re.compile(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\d]*+\d[^\x20\x09-\x0D]*+")
MARK = b"<*>"


def templates(line: bytes) -> list[int]:
    """Signed 64-bit keys of the line's template and of those with one stretch open; none for short lines."""
    tokens = (VARIABLE.sub(MARK, line) if DIGIT.search(line) else line).split()
    n = len(tokens)
    if n < LEAST_TOKENS or n - tokens.count(MARK) < LEAST_TOKENS - 1:
        return []
    path = b"%d " % n + b" ".join(tokens[:LEADING])
    rest = tokens[LEADING:]
    keys = [path + b"|" + b" ".join(rest)]
    if n >= LEAST_OPEN_TOKENS:
        cuts = [len(rest) * k // SEGMENTS for k in range(SEGMENTS + 1)]
        parts = [b" ".join(rest[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        keys += [path + b"|%d|" % k + b"|".join(parts[:k] + [MARK] + parts[k + 1 :]) for k in range(SEGMENTS)]
    return [xxhash.xxh64_intdigest(k) - (1 << 63) for k in keys]


def recurring(docs: DataFrame) -> DataFrame:
    """(key, first): templates of two documents or more, and the smallest doc_id that has each. All rows without a
    doc_id are one document, which comes last."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, owners = [], []
        for at, data in enumerate(batch.column(1).to_pylist()):
            own = [k for line in data.split(b"\n") for k in templates(line)]
            keys += own
            owners += [at] * len(own)
        ranks = pc.rank(batch.column(0), null_placement="at_end", tiebreaker="dense").to_numpy()
        key, owner = np.array(keys, np.int64), ranks[np.array(owners, np.int64)]
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(key)) - 1 if len(key) else first
        of_rank = np.zeros(len(ranks) + 1, np.int64)
        of_rank[ranks] = np.arange(len(ranks))
        low, high = (batch.column(0).take(pa.array(of_rank[owner[x]])) for x in (first, last))
        return pa.RecordBatch.from_arrays([pa.array(key[first]), low, high], names=["key", "first", "last"])

    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = map_batches(docs.select("doc_id", data.alias("data")), count, f"key bigint, first {kind}, last {kind}", by="data")
    some_null = F.bool_or(F.col("last").isNull()).alias("some_null")
    found = found.groupBy("key").agg(F.min("first").alias("first"), F.max("last").alias("last"), some_null)
    return found.filter("first <> last or some_null and first is not null").select("key", "first")


def drops(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, dropped): for rows of docs that lose lines, the 0-based numbers of those."""

    def list_lines(batch: pa.RecordBatch) -> pa.RecordBatch:
        idents, hashes, lines, keys = [], [], [], []
        for ident, text_hash, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for nth, line in enumerate(data.split(b"\n")):
                for key in templates(line):
                    idents.append(ident)
                    hashes.append(text_hash)
                    lines.append(nth)
                    keys.append(key)
        return pa.RecordBatch.from_arrays([pa.array(idents, batch.column(0).type), pa.array(hashes, pa.int64()), pa.array(lines, pa.int32()), pa.array(keys, pa.int64())], names=["doc_id", "text_hash", "line", "key"])

    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.xxhash64(data).alias("text_hash"), data.alias("data"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    lines = map_batches(rows, list_lines, f"doc_id {kind}, text_hash bigint, line int, key bigint", by="data")
    again = materialize(recurring(docs), "recurring-lines")
    gone = lines.join(again, "key").filter("doc_id is null or doc_id <> first").select("doc_id", "text_hash", "line")
    return gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("dropped"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with the columns n_lines and n_dropped more, and text without the dropped lines.

    Lines end at \\n. A line is dropped if its template is also in a document with a smaller doc_id. Lines of
    fewer than LEAST_TOKENS tokens stay. Text that loses nothing stays as it is, null included (0 lines); a
    text that loses all lines becomes empty. Repeats of a row lose the same lines. Further columns pass
    through, but for any named like the two added. An empty table gives no rows.
    """
    mine = F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    docs = docs.drop("n_lines", "n_dropped")
    own, ident, text_hash, dropped = fresh(docs, "own_hash", "ident", "text_hash", "dropped")
    gone = drops(docs).select(F.col("doc_id").alias(ident), F.col("text_hash").alias(text_hash), F.col("dropped").alias(dropped))
    joined = docs.withColumn(own, mine).join(gone, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(own) == F.col(text_hash)), "left")
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(dropped, i)), "\n")
    return joined.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)),
            "n_dropped": F.coalesce(F.size(dropped), F.lit(0)),
            "text": F.when(F.col(dropped).isNull(), F.col("text")).otherwise(left),
        }
    ).select(*docs.columns, "n_lines", "n_dropped")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with dedup_lines()' texts and their n_chars; documents of which no word is left go.

    A text of which no line went is as it was, also if it is null or blank. Of rows that repeat a doc_id and a line, all keep it or none. Further
    columns stay. An empty table gives no rows.
    """
    kept = dedup_lines(docs)
    some = (F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return kept.filter(some).select(*docs.columns)

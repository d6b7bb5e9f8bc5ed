"""Lines, stretches of lines, sections, chunks."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.stored import settle


def uncovered_segments(lines: DataFrame, covered: DataFrame) -> DataFrame:
    """(doc_id, start_line, end_line) of runs of lines outside ``covered`` (doc_id, line_no); blank runs go."""
    rest = lines.join(covered.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_anti")
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    runs = rest.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.max(F.trim("line") != "").alias("some"))
    return runs.filter("some").select("doc_id", "start_line", "end_line")


def sections(lines: DataFrame, heading: str) -> DataFrame:
    """(doc_id, symbol, start_line, end_line): from a heading to the line before the next; before the first, no symbol."""
    last = lines.groupBy("doc_id").agg(F.max("line_no").alias("last_line"))
    is_heading = F.col("line").rlike(heading)
    first = lines.filter(is_heading).groupBy("doc_id").agg(F.min("line_no").alias("first_heading"))
    heads = lines.filter(is_heading).select("doc_id", F.col("line_no").alias("start_line"), F.trim(F.regexp_replace("line", r"^#+\s*", "")).alias("symbol"))
    preamble = last.join(first, "doc_id", "left").filter("first_heading is null or first_heading > 1").select("doc_id", F.lit(1).cast("long").alias("start_line"), F.lit(None).cast("string").alias("symbol"))
    by = Window.partitionBy("doc_id").orderBy("start_line")
    all_ = heads.unionByName(preamble).withColumn("next", F.lead("start_line").over(by)).join(last, "doc_id")
    return all_.select("doc_id", "symbol", "start_line", F.coalesce(F.col("next") - 1, F.col("last_line")).alias("end_line"))


def counted(rows: DataFrame, *order: str) -> DataFrame:
    """rows with nth, from 1 in this order; counted within ranges first, then offset. Ranges are written once, so that one worked
    out again can't differ from what was counted."""
    ranged = settle(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    starts, at = [], 0
    for part, n in sorted(tuple(r) for r in ranged.groupBy("__range").count().collect()):
        starts.append((part, at))
        at += n
    offsets = rows.sparkSession.createDataFrame(starts, "__range int, __start long")
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + F.col("__start")
    return ranged.join(offsets, "__range").withColumn("nth", nth).drop("__range", "__start")


def numbered(chunks: DataFrame, *order: str) -> DataFrame:
    """chunks with chunk_id: chunk_00001 and so on, in this order; numbers beyond five digits keep all of them."""
    return counted(chunks, *order).withColumn("chunk_id", F.format_string("chunk_%05d", "nth")).drop("nth")


def _cuts(sizes: Column, most_chars: int, overlap: int) -> Column:
    """The parts of a text as array<struct(first, end)>, lines from 0 and the end beyond, by the sizes of its lines alone."""

    @F.arrow_udf("array<struct<first:int,end:int>>")
    def cut(sizes: pa.Array) -> pa.Array:
        firsts, ends, offsets = [], [], [0]
        for own in sizes:
            sums = [0, *accumulate(own.values.to_pylist())]
            first, end = 0, 0
            while end < len(sums) - 1:
                end = max(first + 1, bisect_right(sums, sums[first] + most_chars) - 1)
                firsts.append(first)
                ends.append(end)
                first = max(first + 1, end - overlap)
            offsets.append(len(firsts))
        parts = pa.StructArray.from_arrays([pa.array(firsts, pa.int32()), pa.array(ends, pa.int32())], ["first", "end"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)

    return cut(sizes)


def split_oversized(chunks: DataFrame, most_chars: int, overlap: int) -> DataFrame:
    """Chunks (start_line, text, ...) cut at line ends into parts of most_chars at most, a line counted with its line feed; part,
    start_line, end_line and text are the part's, other columns stay.

    A part starts ``overlap`` lines before the end of the last, but at least one line after its start; a line
    that is longer than the limit is a part of its own. part is null where nothing is cut. Python sees the sizes of lines only; the
    texts stay in Spark.
    """
    rest = [c for c in chunks.columns if c not in ("start_line", "end_line", "text")]
    chunks = chunks.select(*rest, F.col("start_line").cast("long").alias("start_line"), "text")
    feeds = F.length("text") - F.length(F.replace("text", F.lit("\n")))
    short = chunks.filter(F.length("text") <= most_chars).select(*rest, F.lit(None).cast("long").alias("part"), "start_line", (F.col("start_line") + feeds).cast("long").alias("end_line"), "text")
    long = chunks.filter(F.length("text") > most_chars).select(*rest, "start_line", F.split("text", "\n", -1).alias("__lines"))
    sizes = F.transform("__lines", lambda x: F.length(x) + 1)
    parts = long.select(*rest, "start_line", "__lines", F.posexplode(_cuts(sizes, most_chars, overlap)).alias("__at", "__cut"))
    first, end = F.col("__cut.first"), F.col("__cut.end")
    own = F.array_join(F.slice("__lines", first + 1, end - first), "\n")
    parts = parts.select(*rest, (F.col("__at") + 1).cast("long").alias("part"), (F.col("start_line") + first).alias("start_line"), (F.col("start_line") + end - 1).alias("end_line"), own.alias("text"))
    return short.union(parts)


def pack_context(chunks: DataFrame, group: str, order: str, budget: int) -> DataFrame:
    """Per group, in order, the chunks that still fit the budget of characters; what doesn't fit is passed over.

    The first is there in any case; if it is larger than the budget, it is ``truncated`` and takes all of it. A group is one question's
    retrieved chunks, so an array of it is small.
    """
    kinds = {c: chunks.schema[c].dataType.simpleString() for c in (order, "chunk_id")}
    item = f"struct<ord:{kinds[order]},chunk_id:{kinds['chunk_id']},size:bigint>"
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("ord"), F.col("chunk_id").alias("chunk_id"), F.length("text").cast("long").alias("size"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{item}>").alias("kept"))

    def step(state, item):
        fits = (F.size(state["kept"]) == 0) | (state["used"] + item["size"] <= budget)
        return F.struct(F.when(fits, F.least(state["used"] + item["size"], F.lit(budget).cast("long"))).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["kept"], F.array(item))).otherwise(state["kept"]).alias("kept"))

    packed = chunks.groupBy(group).agg(items.alias("items")).select(group, F.explode(F.aggregate("items", start, step, lambda s: s["kept"])).alias("x"))
    return packed.select(group, "x.ord", "x.chunk_id", (F.col("x.size") > budget).alias("truncated"))


def first_paragraph(text, least: int = 20, most: int = 400):
    """The first block between blank lines whose lines of prose, joined, have ``least`` characters; headings, badges, tables,
    fences, rules and quotes aren't prose."""
    line = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    prose = lambda block: F.filter(F.transform(F.split(block, "\n"), line), lambda x: (x != "") & ~x.rlike(r"^(#|\[!\[|!\[|<|\||```|---|===|>)"))
    blocks = F.transform(F.split(text, r"\n\s*\n"), lambda block: F.array_join(prose(block), " "))
    return F.substring(F.get(F.filter(blocks, lambda x: F.length(x) >= least), F.lit(0)), 1, most)

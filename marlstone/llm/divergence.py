"""Source divergence audit: how far the terms of a source are from those of its language and of its other sources.

The terms kept of a language are those of enough documents. They are found by iceberg prefix refinement: byte prefixes of the terms
are counted by documents, level by level, and only what extends a prefix of enough documents is counted at the next level, until what is
left are whole terms. A document counts once for a prefix, however many of its terms begin so, so no prefix of a kept term is ever under
the threshold, and rare terms are never counted, shuffled or stored whole.

Tasks learn what is left from a filter of a fixed number of bits, whatever the number of prefixes. What it lets through by chance is
counted, too, and is under the threshold or a kept term by itself: results don't depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialize, slices, utf8, worker_task

#: Documents of its language that a kept term has at least; ranks of a group's terms that come out.
THRESHOLD, TOP = 10, 10

@dataclass(frozen=True)
class Sizes:
    """Of what tasks hold; results don't depend on them."""

    #: Bytes of the first level's prefixes; each further level has so many times as many.
    first_bytes: int = 4
    growth: int = 3
    filter_bits: int = 1 << 24
    #: Bytes of texts taken at once.
    texts: int = 24 << 20
    #: Terms of a block, and sources of a block, whose pairs meet in a task.
    terms: int = 2048
    sources: int = 64


#: Upper-case A-Z to lower case; what is neither a letter A-Z nor beyond ASCII to the separator.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Ends a whole term, so that a prefix that has it is the term.
END = b" "


def terms_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts, each with END, one after the other, and how many each text has."""
    joined = np.frombuffer((END.join(texts) + END).translate(_TERMS), np.uint8)
    gap = joined == END[0]
    # Of each run of separators the one that ends a term stays.
    stays = ~gap
    stays[1:] |= gap[1:] & ~gap[:-1]
    ends = np.flatnonzero(gap & stays)
    data = joined[stays]
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = np.flatnonzero(data == END[0]) + 1
    last = np.cumsum([len(t) + 1 for t in texts])
    until = np.searchsorted(ends, last)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), np.diff(until, prepend=0)


def _bits(nodes: DataFrame, size: int) -> np.ndarray:
    """The filter of nodes (lang, node): size bits, whatever their number."""
    place = F.pmod(F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), F.col("node"))), F.lit(size))
    words = nodes.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits"))
    found = np.zeros(size // 64, np.int64)
    for row in words.toLocalIterator():
        found[row["word"]] = row["bits"]
    return found


def _alive(lang: str, nodes: pa.Array, bits: np.ndarray) -> np.ndarray:
    """Which nodes of a language the filter has."""
    own = crc32(lang.encode() + b"\0")
    place = np.fromiter((crc32(x, own) for x in nodes.to_pylist()), np.int64, len(nodes)) % (64 * len(bits))
    return (bits[place >> 6] >> (place & 63) & 1).astype(bool)


def _tallied(docs: DataFrame, count: Callable[[str, pa.Array, np.ndarray, list[str]], Iterator[tuple[str, pa.Array, np.ndarray]]], size: int) -> DataFrame:
    """(lang, source, node, n): counts of tasks, by slices of size bytes. count gets one language's terms, the document of each, and
    the documents' sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "data", size)):
            langs, sources, texts = (batch[c].to_pylist() for c in ("lang", "source", "data"))
            order = sorted(range(len(texts)), key=langs.__getitem__)
            for lang, own in groupby(order, key=langs.__getitem__):
                own = list(own)
                terms, each = terms_of([texts[i] for i in own])
                if not len(terms):
                    continue
                for source, nodes, n in count(lang, terms, np.repeat(np.arange(len(own)), each), [sources[i] for i in own]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(nodes), pa.string()), pa.array([source] * len(nodes), pa.string()), nodes, pa.array(n, pa.int64())], names=["lang", "source", "node", "n"]
                    )

    return docs.mapInArrow(worker_task(run), "lang string, source string, node binary, n bigint")


def document_counts(docs: DataFrame, length: int, before: int, bits: np.ndarray | None, size: int) -> DataFrame:
    """_tallied() documents of prefixes of length bytes, of terms that bits has the prefix of ``before`` bytes of."""

    def count(lang: str, terms: pa.Array, doc: np.ndarray, sources: list[str]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
        coded = terms.dictionary_encode()
        own = coded.dictionary
        live = pc.binary_length(own).to_numpy() > before
        if bits is not None:
            heads = pc.binary_slice(own, 0, before).dictionary_encode()
            live &= _alive(lang, heads.dictionary, bits)[heads.indices.to_numpy()]
        if not live.any():
            return
        nodes = pc.binary_slice(own.filter(pa.array(live)), 0, length).dictionary_encode()
        node_of = np.full(len(own), -1, np.int64)
        node_of[live] = nodes.indices.to_numpy()
        node = node_of[coded.indices.to_numpy()]
        held, k = node >= 0, len(nodes.dictionary)
        # A document counts once for a node.
        once = np.unique(doc[held] * k + node[held])
        yield "", nodes.dictionary, np.bincount(once % k, minlength=k)

    return _tallied(docs, count, size)


def term_counts(docs: DataFrame, bits: np.ndarray, size: int) -> DataFrame:
    """_tallied() occurrences by source of the terms that bits has."""

    def count(lang: str, terms: pa.Array, doc: np.ndarray, sources: list[str]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
        coded = terms.dictionary_encode()
        own, term = coded.dictionary, coded.indices.to_numpy()
        live = _alive(lang, own, bits)[term]
        names, number = np.unique(np.array(sources, object), return_inverse=True)
        k = len(own)
        keys, n = np.unique(number[doc[live]] * k + term[live], return_counts=True)
        cuts = np.searchsorted(keys, np.arange(len(names) + 1) * k)
        for name, a, b in zip(names, cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield name, own.take(pa.array(keys[a:b] % k)), n[a:b]

    return _tallied(docs, count, size)


def kept_terms(docs: DataFrame, threshold: int = THRESHOLD, sizes: Sizes = Sizes()) -> DataFrame:
    """(lang, node) of the terms, each with its end, that at least threshold of the rows of docs (lang, source, data) of a language hold."""
    whole, length, before, bits = None, sizes.first_bytes, 0, None
    while True:
        level = document_counts(docs, length, before, bits, sizes.texts).groupBy("lang", "node").agg(F.sum("n").alias("docs"))
        level = materialize(level.filter(F.col("docs") >= threshold).select("lang", "node"), "prefixes")
        ended = F.endswith(F.col("node"), F.lit(END))
        complete = level.filter(ended)
        whole = complete if whole is None else whole.union(complete)
        open_ = level.filter(~ended)
        if open_.isEmpty():
            return whole
        bits, before, length = _bits(open_, sizes.filter_bits), length, sizes.growth * length


def _share(count: str, total: str, terms: str) -> F.Column:
    """1 + floor(1000000000 * (count + 2) / (total + 2 * terms)), exact."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10, 0)) * cast({count} + 2 as decimal(20, 0))) div cast({total} + 2 * {terms} as decimal(20, 0))")


def _apart(p: str, q: str) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP, sizes: Sizes = Sizes()) -> DataFrame:
    """For each (lang, source) of docs (text, lang, source), how far it is from the language's other sources and where its terms stand out:
    lang, source, part, item, value, rank.

    Terms are runs of letters A-Z, lower-cased, and characters beyond ASCII; each language keeps those of at least threshold rows. Part
    pair has a row for each other source of the language, part term the top kept terms that are more frequent in the source than in the
    language. Null text, lang and source count as empty. Each row is a document, also one that repeats a doc_id. A group without terms has zero
    counts; a language without kept terms has distance 0 between all its sources and no row of part term. A language of one source has
    no pairs. Further columns are not read. An empty table gives no rows.
    """
    empty = F.lit("")
    base = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), utf8().alias("data"))
    kept = materialize(kept_terms(base, threshold, sizes), "kept-terms")
    counted = term_counts(base, _bits(kept, sizes.filter_bits), sizes.texts).groupBy("lang", "source", "node").agg(F.sum("n").alias("n"))
    counted = materialize(counted.join(kept, ["lang", "node"], "left_semi"), "term-counts")

    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = base.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.na.fill(0, ["total", "terms"]).withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = groups.withColumn("none", F.when(F.col("terms") > 0, _share("cast(0 as bigint)", "total", "terms")))
    groups = materialize(groups, "groups")
    shared = counted.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "terms"))

    # The language's own share of each term.
    by_lang = groups.groupBy("lang").agg(F.sum("total").alias("all"))
    of_lang = counted.groupBy("lang", "node").agg(F.sum("n").alias("count")).join(by_lang, "lang").join(terms, "lang").select("lang", "node", _share("count", "all", "terms").alias("q"))
    above = shared.join(of_lang, ["lang", "node"]).filter("p > q").select("lang", "source", F.expr("decode(substring(node, 1, length(node) - 1), 'UTF-8')").alias("item"), _apart("p", "q").alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = above.withColumn("rank", ranked).filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    sums = _pair_sums(shared, groups, sizes)
    both = sums.select("lang", F.col("a").alias("no"), F.col("b").alias("other"), "value").union(sums.select("lang", "b", "a", "value"))
    names = groups.select("lang", "no", "source")
    named = both.join(names, ["lang", "no"]).join(names.toDF("lang", "other", "item"), ["lang", "other"])
    pairs = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))
    return pairs.union(best)


def _pair_sums(shared: DataFrame, groups: DataFrame, sizes: Sizes) -> DataFrame:
    """(lang, a, b, value) for each two sources (a < b, by number) of a language: the sum over all its kept terms.

    A cell has a block of terms of two blocks of sources, and a line for each of its sources, so that it knows the shares of terms that a source
    doesn't have. A cell's terms that no source of it has are counted by a term count of the block.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / sizes.terms)).cast("int")
    place = F.pmod(F.xxhash64("node"), blocks).cast("int")
    lines = groups.select("lang", "no", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(None).cast("binary").alias("node"), F.col("none").alias("p"))
    rows = lines.union(shared.select("lang", "no", place.alias("block"), "node", "p"))
    last = groups.groupBy("lang").agg(F.floor(F.max("no") / sizes.sources).cast("int").alias("last"), F.max("terms").alias("terms"))
    own = F.floor(F.col("no") / sizes.sources).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.struct(F.least(k, own).alias("low"), F.greatest(k, own).alias("high")))
    rows = rows.join(last, "lang").select("lang", "no", "block", "node", "p", F.explode(cells).alias("cell")).select("lang", "block", "cell.low", "cell.high", "no", "node", "p")

    def distances(table: pa.Table) -> pa.Table:
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        no, p = table["no"].to_numpy(), table["p"].fill_null(0).to_numpy()
        line = table["node"].is_null().to_numpy()
        sources = np.unique(no[line])
        none = np.zeros(len(sources), np.int64)
        none[np.searchsorted(sources, no[line])] = p[line]
        found = table.filter(pa.array(~line))
        _, term = np.unique(np.array(found["node"].to_pylist(), object), return_inverse=True) if found.num_rows else (None, np.zeros(0, np.int64))
        shares = np.repeat(none[:, None], term.max() + 1 if len(term) else 0, 1)
        shares[np.searchsorted(sources, no[~line]), term] = p[~line]
        half = sources // sizes.sources
        a, b, value = [], [], []
        for i, source in enumerate(sources):
            other = np.flatnonzero((sources > source) & ((half == high) & (half[i] == low)))
            x, y = shares[i], shares[other]
            a += [source] * len(other)
            b += sources[other].tolist()
            value += ((x - y) ** 2 // np.maximum(x + y, 1)).sum(1).tolist()
        lang = [table["lang"][0].as_py()] * len(a)
        present = [shares.shape[1]] * len(a)
        return pa.table({"lang": pa.array(lang, pa.string()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "value": pa.array(value, pa.int64()), "present": pa.array(present, pa.int64())})

    sums = rows.groupBy("lang", "block", "low", "high").applyInArrow(distances, "lang string, a int, b int, value bigint, present bigint")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("present").alias("present"))
    none = groups.select("lang", "no", "none", "terms")
    sums = sums.join(none.toDF("lang", "a", "p", "terms"), ["lang", "a"]).join(none.select("lang", F.col("no").alias("b"), F.col("none").alias("q")), ["lang", "b"])
    rest = F.coalesce(_apart("p", "q") * (F.col("terms") - F.col("present")), F.lit(0))
    return sums.select("lang", "a", "b", (F.col("value") + rest).alias("value"))

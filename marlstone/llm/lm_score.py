"""LM scoring: an interpolated modified Kneser-Ney model of word bigrams.

Spark counts: words by hash, and bigrams packed by part of the context's hash range. A part's distinct
bigrams are written to the shared folder as sorted arrays of hashes and counts; a table of words has each
word's count, its continuation probability, and its total and left-over mass as a context. Scoring tasks
memory-map what they look up. The order is two because the distinct trigrams of a corpus are about as many as its
words, which as shuffled counts don't fit the disk that the check allows; see the README.
"""

from __future__ import annotations

import functools
import io
import math
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import map_batches, materialize, scratch_path, utf8
from marlstone.llm.shingles import word_hashes

#: Hashes of the begin mark (a context only) and the end mark (a token).
BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA6BE6546B65)
#: Tokens whose bigrams one part is meant to hold; a context of more than HOT_TOKENS is spread over parts, each with
#: about as many of them.
PART_TOKENS, LEAST_PARTS, HOT_TOKENS = 500_000, 128, 250_000
#: Parts that a task merges or writes, one after the other: the number of tasks follows the corpus.
PARTS_PER_TASK = 2
FOLDS, HELD_OUT = 7, 2


def held_out() -> F.Column:
    """Whether the remainder of crc32(doc_id as text) is HELD_OUT; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _codes(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts of a batch, one after the other: BEGIN, words, END; and the length of each."""
    parts, sizes = [], []
    for data in batch.column(column).to_pylist():
        words = data.lower().split()
        parts += [[BEGIN], word_hashes(words), [END]]
        sizes.append(len(words) + 2)
    return np.concatenate([np.asarray(p, np.uint64) for p in parts]), np.array(sizes)


class Layout:
    """Which part a bigram's counts are in: by the context's hash, and for hot contexts by the word's, too.

    hot: how many tokens follow each hot context. Their number is at most that of all tokens by HOT_TOKENS.
    """

    def __init__(self, bits: int, hot: dict[int, int]) -> None:
        self.bits, self.hot = bits, np.array(sorted(hot), np.uint64)
        self.tasks = max(1, (1 << bits) // PARTS_PER_TASK)
        self.spread = np.array([min(1 << bits, -(-hot[h] // HOT_TOKENS)) for h in sorted(hot)], np.uint64)

    def part(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        part = (context >> np.uint64(64 - self.bits)).astype(np.int64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            hot = self.hot[at] == context
            part = np.where(hot, part + (word % self.spread[at]).astype(np.int64), part) % (1 << self.bits)
        return part


def _write(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """One file: the arrays' lengths in bytes, then the arrays, each padded to 8 bytes. A task that runs again or
    twice at a time writes the same under a name of its own, and replaces the file at once."""
    out = io.BytesIO()
    out.write(np.array([a.nbytes for a in arrays], np.int64).tobytes())
    for a in arrays:
        out.write(a.tobytes())
        out.write(b"\0" * (-a.nbytes % 8))
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    own = f"{root}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as file:
        file.write(out.getbuffer())
    fs.move(own, f"{root}/{name}")


@functools.lru_cache(maxsize=4096)
def _mapped(folder: str, name: str, kinds: tuple[str, ...]) -> list[np.ndarray] | None:
    """A file's arrays, memory-mapped; from a store without local paths, a copy that goes with the mapping."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    path = f"{root}/{name}"
    if fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
        return None
    if not isinstance(fs, pyarrow.fs.LocalFileSystem):
        local = tempfile.NamedTemporaryFile(delete=False)
        with fs.open_input_stream(path) as file:
            while chunk := file.read(1 << 20):
                local.write(chunk)
        local.close()
        path = local.name
    raw = np.memmap(path, np.uint8, "r")
    if not isinstance(fs, pyarrow.fs.LocalFileSystem):
        os.unlink(path)
    sizes = raw[: 8 * len(kinds)].view(np.int64)
    at, out = 8 * len(kinds), []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(raw[at : at + int(size)].view(kind))
        at += int(size) + int(-size % 8)
    return out


GRAM_KINDS = ("<u8", "<u4", "<u8", "u1", "<u4", "<i8")  # contexts, starts, words, counts, places of counts over 254, these
WORD_KINDS = ("<u8", "<i8", "<f4", "<f4", "<f4")  # hashes, count, continuation, total, left-over mass


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from how many have count 1 to 4."""
    n1, n2, n3, n4 = (max(1, x) for x in n)
    y = n1 / (n1 + 2 * n2)
    found = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([min(max(d, 0.05 * k), 0.95 * k) if k else 0.0 for k, d in enumerate(found)])


def count_words(docs: DataFrame) -> DataFrame:
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, _ = _codes(batch, 0)
        values, counts = np.unique(codes, return_counts=True)
        counts[values == BEGIN] = 0
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["hash", "n"])

    return map_batches(docs.select(utf8().alias("data")), count, "hash bigint, n bigint", by="data").groupBy("hash").agg(F.sum("n").alias("n"))


def _to_bytes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_bytes(data: bytes, width: int) -> np.ndarray:
    columns = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((columns.shape[1], 8), np.uint8)
    out[:, :width] = columns.T
    return out.view("<u8").ravel()


def _summed(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((word, context))
    context, word, n = context[order], word[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (word[1:] != word[:-1]))))
    return context[new], word[new], np.add.reduceat(n, new)


def count_bigrams(docs: DataFrame, layout: Layout, folder: str) -> DataFrame:
    """Writes the parts' arrays and gives sums: kind 0 (context, total, with count 1, 2, 3 and more), kind 1
    (word, contexts it follows), kind 2 (count 1 to 4, bigrams that have it)."""

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, _ = _codes(batch, 0)
        pair = codes[1:] != BEGIN
        context, word = codes[:-1][pair], codes[1:][pair]
        context, word, n = _summed(context, word, np.ones(len(word), np.int64))
        part = layout.part(context, word)
        order = np.argsort(part, kind="stable")
        part, context, word, n = part[order], context[order], word[order], n[order]
        edges = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
        data = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            step = np.diff(context[a:b], prepend=np.uint64(0))
            data.append(zlib.compress(_to_bytes(step, 8) + _to_bytes(n[a:b], 4), 1) if b > a else b"")
        words = [_to_bytes(word[a:b], 8) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]]), pa.array(data, pa.binary()), pa.array(words, pa.binary())], names=["part", "data", "words"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        followed: list[np.ndarray] = []
        times = np.zeros(5, np.int64)
        at = None

        def rows(kind: int, key: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
            filled = [*values, *[np.zeros(len(key), np.int64)] * (4 - len(values))]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), *(pa.array(v.astype(np.int64)) for v in filled)], names=["kind", "key", "a", "b", "c", "d"])

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            contexts, words, counts = [], [], []
            for data, packed in held:
                word = _from_bytes(packed, 8)
                plain = zlib.decompress(data)
                contexts.append(np.cumsum(_from_bytes(plain[: 8 * len(word)], 8)))
                counts.append(_from_bytes(plain[8 * len(word) :], 4).astype(np.int64))
                words.append(word)
            held.clear()
            context, word, n = _summed(np.concatenate(contexts), np.concatenate(words), np.concatenate(counts))
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            over = np.flatnonzero(n > 254)
            _write(folder, f"grams-{at}", [context[first], np.append(first, len(n)).astype("<u4"), word.astype("<u8"), np.minimum(n, 255).astype("u1"), over.astype("<u4"), n[over]])
            with_n = [np.add.reduceat((n == k).astype(np.int64) if k < 3 else (n >= 3).astype(np.int64), first) for k in (1, 2, 3)]
            times[:] += np.bincount(np.minimum(n, 5), minlength=6)[:5]
            followed.append(word)
            yield rows(0, context[first], np.add.reduceat(n, first), *with_n)
            if sum(map(len, followed)) > 4_000_000:
                yield spill()

        def spill() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(followed), return_counts=True)
            followed.clear()
            return rows(1, values, counts)

        for batch in batches:
            for part, data, words in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if part != at:
                    yield from close()
                    at = part
                held.append((data, words))
        yield from close()
        if followed:
            yield spill()
        yield rows(2, np.arange(1, 5, dtype=np.uint64), times[1:])

    sent = map_batches(docs.select(utf8().alias("data")), emit, "part bigint, data binary, words binary", by="data")
    out = sent.repartition(layout.tasks, "part").sortWithinPartitions("part").mapInArrow(merge, "kind int, key bigint, a bigint, b bigint, c bigint, d bigint")
    return out.groupBy("kind", "key").agg(*[F.sum(x).alias(x) for x in "abcd"])


class Model:
    """What scoring needs besides the arrays in the folder."""

    def __init__(self, folder: str, layout: Layout, tokens: int, vocabulary: int, discount: np.ndarray, unseen: float) -> None:
        self.folder, self.layout, self.tokens, self.vocabulary = folder, layout, tokens, vocabulary
        self.discount, self.unseen = discount, unseen

    def words(self, codes: np.ndarray) -> list[np.ndarray]:
        """count, continuation probability, total and left-over mass of each code (sorted, distinct)."""
        out = [np.zeros(len(codes), np.int64), np.full(len(codes), self.unseen), np.zeros(len(codes)), np.zeros(len(codes))]
        part = codes >> np.uint64(64 - self.layout.bits)
        edges = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)])) if len(part) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            arrays = _mapped(self.folder, f"words-{int(part[a])}", WORD_KINDS)
            if arrays is None:
                continue
            at = np.minimum(np.searchsorted(arrays[0], codes[a:b]), len(arrays[0]) - 1)
            hit = arrays[0][at] == codes[a:b]
            for k in range(4):
                out[k][a:b][hit] = arrays[k + 1][at[hit]]
        return out

    def bigrams(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """How often word followed context in training."""
        out = np.zeros(len(word), np.int64)
        part = self.layout.part(context, word)
        order = np.argsort(part.astype(np.uint16) if self.layout.bits <= 16 else part, kind="stable")
        ranked = part[order]
        edges = np.concatenate(([0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1, [len(ranked)])) if len(ranked) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            arrays = _mapped(self.folder, f"grams-{int(ranked[a])}", GRAM_KINDS)
            if arrays is None:
                continue
            contexts, starts, words, counts, over, large = arrays
            own = order[a:b]
            at = np.minimum(np.searchsorted(contexts, context[own]), len(contexts) - 1)
            found = contexts[at] == context[own]
            own, at = own[found], at[found]
            low, high = starts[at].astype(np.int64), starts[at + 1].astype(np.int64)
            end, wanted = high.copy(), word[own]
            while (open_ := low < high).any():
                middle = (low + high) >> 1
                less = open_ & (words[np.minimum(middle, len(words) - 1)] < wanted)
                low = np.where(less, middle + 1, low)
                high = np.where(open_ & ~less, middle, high)
            safe = np.minimum(low, len(words) - 1)
            hit = (low < end) & (words[safe] == wanted)
            n = counts[safe[hit]].astype(np.int64)
            big = n == 255
            if big.any():
                n[big] = large[np.searchsorted(over, safe[hit][big])]
            out[own[hit]] = n
        return out

    def score(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each text, from _codes()."""
        values, back = np.unique(codes, return_inverse=True)
        count, single, total, left = (x[back] for x in self.words(values))
        n = self.bigrams(codes[:-1], codes[1:])
        seen = total[:-1] > 0
        above = np.where(seen, (n - self.discount[np.minimum(n, 3)]) / np.where(seen, total[:-1], 1), 0)
        p = np.where(seen, np.maximum(above, 0) + left[:-1] * single[1:], single[1:])
        base = np.log10((count + 1) / (self.tokens + self.vocabulary + 1))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        token = np.ones(len(codes))
        token[starts] = 0
        logs = np.concatenate(([0.0], np.log10(p))) * token
        return sizes - 1, np.add.reduceat((count > 0) * token, starts), np.add.reduceat(base * token, starts), np.add.reduceat(logs, starts)


def train(docs: DataFrame) -> Model:
    """The model of all rows of docs (text). Every count covers the whole of docs."""
    folder = scratch_path(docs.sparkSession, "bigram-model")
    words = materialize(count_words(docs), "words")
    tokens, vocabulary = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    bits = math.ceil(math.log2(max(LEAST_PARTS, tokens / PART_TOKENS)))
    hot = {r["hash"] % (1 << 64): r["n"] for r in words.filter(F.col("n") > HOT_TOKENS).collect()}
    layout = Layout(bits, hot | {int(BEGIN): hot.get(int(END), 1)})
    sums = materialize(count_bigrams(docs, layout, folder), "bigram-sums")
    times = {r["key"]: r["a"] for r in sums.filter("kind = 2").collect()}
    d = discounts([times.get(k, 0) for k in range(1, 5)])
    follows = sums.filter("kind = 1").select(F.col("key").alias("w"), F.col("a").alias("follows"))
    few = follows.agg(F.coalesce(F.sum("follows"), F.lit(0)), *[F.count(F.when(F.col("follows") == k, 1)) for k in range(1, 5)], F.count(F.when(F.col("follows") > 2, 1))).first()
    d1, pairs = discounts(list(few[1:5])), max(1, few[0])
    spare = (d1[1] * few[1] + d1[2] * few[2] + d1[3] * few[5]) / pairs if few[0] else 1.0
    unseen = spare / (vocabulary + 1)
    contexts = sums.filter("kind = 0").select(F.col("key").alias("v"), "a", "b", "c", "d")
    mass = (F.col("b") * F.lit(float(d[1])) + F.col("c") * F.lit(float(d[2])) + F.col("d") * F.lit(float(d[3]))) / F.col("a")
    less = F.when(F.col("follows") == 1, float(d1[1])).when(F.col("follows") == 2, float(d1[2])).otherwise(float(d1[3]))
    table = (
        words.join(follows, F.col("hash") == F.col("w"), "left")
        .join(contexts, F.col("hash") == F.col("v"), "left")
        .select(
            F.shiftrightunsigned("hash", 64 - bits).alias("part"), "hash", "n",
            F.coalesce((F.col("follows") - less) / pairs, F.lit(0.0)).alias("own"),
            F.coalesce(F.col("a").cast("double"), F.lit(0.0)).alias("total"), F.coalesce(mass, F.lit(0.0)).alias("left"),
        )
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        done, at = [], None

        def close() -> None:
            if held:
                rows = pa.Table.from_batches(held).to_pydict()
                held.clear()
                code = np.array(rows["hash"], np.int64).view(np.uint64)
                order = np.argsort(code)
                _write(folder, f"words-{at}", [code[order], np.array(rows["n"], np.int64)[order], *(np.array(rows[c], np.float64)[order].astype("<f4") for c in ("own", "total", "left"))])
                done.append(at)

        for batch in batches:
            part = batch.column(0).to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)])) if len(part) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if part[a] != at:
                    close()
                    at = int(part[a])
                held.append(batch.slice(a, b - a))
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["part"])

    table = table.withColumn("own", F.col("own") + F.lit(unseen))
    table.repartition(layout.tasks, "part").sortWithinPartitions("part").mapInArrow(write, "part bigint").agg(F.count("part")).first()
    return Model(folder, layout, tokens, vocabulary, d, unseen)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of docs (doc_id, text, held_out): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, perplexity.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+``, lower-cased in A-Z, then one end. Null text is empty: the end
    alone. Words that training lacks get the share that a uniform distribution has of the left-over mass. Rows
    are scored one by one, so repeats score alike. Without training rows, every score is that of a uniform
    guess. Further columns are not read. An empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, sizes = _codes(batch, 2)
        tokens, known, base, logs = model.score(codes, sizes)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(sizes), model.tokens, np.int64)), pa.array(base), pa.array(logs), pa.array(10.0 ** (-logs / tokens))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        docs.select("doc_id", "held_out", utf8().alias("data")), run,
        f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double",
        by="data",
    )


def score_held_out(docs: DataFrame) -> DataFrame:
    """score() of all rows of docs (doc_id, text) by a model of those that held_out() leaves for training."""
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return score(rows, train(rows.filter(~F.col("held_out"))))

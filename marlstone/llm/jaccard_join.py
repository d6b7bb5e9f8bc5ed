"""N-gram Jaccard join: a universe partition with the pigeonhole principle, exact for every pair.

Sets of sizes x and y with Jaccard similarity t or more differ in at most (1 - t) / (1 + t) * (x + y) shingles.
The universe of hashes is cut into segments, whose number is set by the size band of the smaller set of a pair.

* Tolerance 0: of H + 1 non-empty segments, one is equal in both sets if they differ in H shingles. A set
  indexes the first H + 1 of its non-empty segments, so of two sets, the one whose subset ends first has a
  segment that the other indexes too.
* Tolerance 1: with H // 2 + 1 segments, one differs by a single shingle at most. A set indexes its segments and
  their one-deletion neighbourhoods.

Each band takes the cheaper one: signatures, plus collisions by segments too small to be selective. Shingles of
many sets come last in the universe and have larger segments, so that subsets reach them only where nothing rarer
is left. A set whose segments are too empty for the argument goes on with another cut of the universe; a partner
that stops earlier has met it there.

Signatures only make candidates. A candidate is dropped if the parity sketches of its sets (each shingle flips one
bit) differ in more bits than the sets may differ in shingles, which no link does; the rest is checked on the two
whole sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fresh, map_batches, materialize, slices, utf8, worker_task
from marlstone.llm.components import connected_components
from marlstone.llm.shingles import WORDS_PER_SHINGLE, mix, set_hash, shingle_set

#: Similarity as a fraction.
NUMERATOR, DENOMINATOR = 3, 4
#: A shingle is hot from this many sets on, or from the corpus's shingles / MOST_HOT on; the list of hot ones
#: (at most MOST_HOT numbers) goes to every task. A batch reports shingles that LOCAL_HOT of its sets have.
HOT_SETS, MOST_HOT, LOCAL_HOT = 16, 2_000_000, 2
#: Sets of one signature that are compared pairwise at once; in larger groups, each with the most typical one only
#: (the one with the largest share of hot shingles), and the others after the components of those are known:
#: then by blocks of so many sets.
PAIRWISE, BLOCK = 12, 1024
#: Bytes of texts whose shingles, or whose signatures, a task holds at once.
SURVEY_BYTES, EMIT_BYTES = 24 << 20, 12 << 20
#: Documents whose signatures one bucket of the exchange is meant to hold; what a collision costs.
DOCS_PER_BUCKET, LEAST_BUCKETS, COLLISION_COST = 1000, 256, 64
#: Buckets that a task resolves, one after the other: the number of tasks follows the corpus.
BUCKETS_PER_TASK = 4
#: Segments of rare shingles, for each shingle of the smallest set of the band.
RARE_SEGMENTS = 3
RUNS = 64


def most_differences(x: int, y: int, num: int = NUMERATOR, den: int = DENOMINATOR) -> int:
    return (x + y) * (den - num) // (den + num)


@functools.lru_cache(maxsize=None)
def scheme(low: int) -> tuple[int, int]:
    """Tolerance and number of segments for pairs whose smaller set has low to 2 * low - 1 shingles."""
    size = 2 * low - 1
    differ = most_differences(size, size * DENOMINATOR // NUMERATOR)
    loose = max(1, math.ceil(0.85 * low))
    if differ == 0:
        return 0, 1
    tight = differ // 2 + 1
    typical = 1.5 * low
    exact = differ + 1 + COLLISION_COST * math.exp(-typical / loose)
    near = tight + typical + COLLISION_COST * math.exp(-typical / tight) * (1 + typical / tight)
    return (0, loose) if exact <= near else (1, tight)


def signatures(shingles: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The 64-bit signatures of a set of sorted shingle hashes, under all schemes that its partners may use."""
    n = len(shingles)
    low = 1 << (n.bit_length() - 1)
    plans = [(low, most_differences(n, n * DENOMINATOR // NUMERATOR))]
    if low > 1 and -(-n * NUMERATOR // DENOMINATOR) <= low - 1:
        plans.append((low // 2, most_differences(n, low - 1)))
    out = []
    for band, differ in plans:
        tolerance, segments = scheme(band)
        seed = 0
        while True:
            found, enough = _one_cut(shingles, hot, band, tolerance, segments, differ, seed)
            out.append(found)
            if enough:
                break
            seed += 1
    return np.unique(np.concatenate(out))


def _one_cut(shingles: np.ndarray, hot: np.ndarray, band: int, tolerance: int, segments: int, differ: int, seed: int) -> tuple[np.ndarray, bool]:
    place = mix(shingles + np.uint64(seed * 0x632BE59BD9B4E019 % (1 << 64))) if seed else shingles
    values = mix(shingles ^ np.uint64(0xA0761D6478BD642F))
    common = _among(shingles, hot) if tolerance == 0 and segments > 1 else np.zeros(len(shingles), bool)
    fine = np.uint64(RARE_SEGMENTS * band if tolerance == 0 and segments > 1 else segments)
    half = np.uint64(32)
    segment = ((place >> half) * fine) >> half
    if common.any():
        segment = np.where(common, fine + (((place >> half) * np.uint64(segments)) >> half), segment)
    if seed or common.any():
        order = np.argsort(segment, kind="stable")
        segment, values = segment[order], values[order]
    starts = np.concatenate(([0], np.flatnonzero(segment[1:] != segment[:-1]) + 1))
    label = mix(segment[starts] + np.uint64((band << 40) + (seed << 32)))
    sums = np.add.reduceat(values, starts)
    if tolerance == 0:
        keep = min(len(starts), differ + 1)
        return mix(sums[:keep] ^ label[:keep]), len(starts) > differ
    sizes = np.diff(np.append(starts, len(values)))
    small = segments - int((sizes >= 2).sum())
    whole = mix(sums ^ label)
    member = np.repeat(np.arange(len(starts)), sizes)
    less = np.flatnonzero(sizes[member] >= 2)
    deleted = mix((sums[member[less]] - values[less]) ^ label[member[less]])
    return np.concatenate((whole, deleted)), small < segments - differ // 2


def _among(shingles: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(shingles), bool)
    at = np.searchsorted(hot, shingles)
    return hot[np.minimum(at, len(hot) - 1)] == shingles


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the shingles in 2 to 4 bits for each of them, 64 at least, by their lowest bits."""
    bits = max(6, (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_differences(x: bytes, y: bytes) -> int:
    """A number of shingles in which two sets differ at least; the longer sketch is folded to the shorter."""
    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


@dataclass(frozen=True)
class Join:
    """Which sets link: shingles of so many words, a similarity of num / den; signatures(shingles, hot) gives a set's keys, of
    which those that link share one."""

    signatures: Callable[[np.ndarray, np.ndarray], np.ndarray]
    words: int = WORDS_PER_SHINGLE
    num: int = NUMERATOR
    den: int = DENOMINATOR


def _batch(*columns: tuple[str, pa.DataType, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for _, t, v in columns], names=[n for n, _, _ in columns])


def survey(docs: DataFrame, words: int = WORDS_PER_SHINGLE) -> DataFrame:
    """One pass over docs: rows of kind 0 (doc_id, n, class_id, sketch) and of kind 1 (shingle as class_id, sets as n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "data", SURVEY_BYTES)):
            seen, sets, classes, sizes, sketches = set(), [], [], [], []
            for data in batch.column(1).to_pylist():
                shingles = shingle_set(data, words)
                key = set_hash(shingles)
                classes.append(key)
                sizes.append(len(shingles))
                sketches.append(None if key in seen else sketch(shingles))
                if key not in seen:
                    seen.add(key)
                    sets.append(shingles)
            if not sizes:
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(sizes), np.int32)), batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(sketches, pa.binary())],
                names=["kind", "doc_id", "n", "class_id", "sketch"],
            )
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= LOCAL_HOT
            values, counts = values[often], counts[often]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(values), np.int32)), pa.nulls(len(values), batch.column(0).type), pa.array(counts.astype(np.int64)), pa.array(values.view(np.int64)), pa.nulls(len(values), pa.binary())],
                names=["kind", "doc_id", "n", "class_id", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8().alias("data")).mapInArrow(worker_task(run, "shingles"), f"kind int, doc_id {kind}, n bigint, class_id bigint, sketch binary")


#: star: this set stands for others of its signature, which its batch has resolved and kept back.
_ENTRY = np.dtype([("rest", "<u4"), ("more", "u1"), ("plain", "u1"), ("star", "u1"), ("set", "<i8")])


def _pairs(signature: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries sorted by (signature, the most typical first, member) without repeats: candidate pairs, and which entries are in
    groups too large to be compared pairwise."""
    if not len(signature):
        return np.empty((0, 2), np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(signature[1:] != signature[:-1]) + 1))
    sizes = np.diff(np.append(starts, len(signature)))
    first = np.repeat(starts, sizes)
    large = np.repeat(sizes > PAIRWISE, sizes)
    found = []
    nth = np.arange(len(signature)) - first
    star = large & (nth > 0)
    found.append(np.stack((member[first[star]], member[star]), 1))
    for gap in range(1, PAIRWISE):
        right = np.flatnonzero((nth >= gap) & ~large)
        if not len(right):
            break
        found.append(np.stack((member[right - gap], member[right]), 1))
    return np.concatenate(found), large, first


def candidates(docs: DataFrame, hot: np.ndarray, buckets: int, join: Join) -> DataFrame:
    """Rows of kind 1 (a, b: sets to compare) and of kind 2 (a: set, b: signature of a large group).

    Signatures travel packed, a row for each batch and bucket. A group that is large within a batch already
    is resolved there as a star, and only its first set travels on, marked: whatever meets it counts as a member
    of a large group, as it may link to a set that was kept back.
    """
    bits = max(8, math.ceil(math.log2(buckets)))
    top, mask = np.uint64(64 - bits), np.uint64((1 << 40) - 1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, found, members, plains = set(), [], [], []
            for data in batch.column(0).to_pylist():
                shingles = shingle_set(data, join.words)
                if not len(shingles) or (key := set_hash(shingles)) in seen:
                    continue
                seen.add(key)
                found.append(join.signatures(shingles, hot))
                members.append(np.full(len(found[-1]), key, np.int64))
                plains.append(np.full(len(found[-1]), 255 - int(255 * _among(shingles, hot).mean()), np.uint8))
            if not found:
                continue
            signature, member, plain = np.concatenate(found), np.concatenate(members), np.concatenate(plains)
            order = np.lexsort((member, plain, signature))
            signature, member, plain = signature[order], member[order], plain[order]
            pairs, large, first = _pairs(signature, member)
            star_of = large.astype(np.uint8)
            if large.any():
                starts = np.flatnonzero(large & (np.arange(len(first)) == first))
                star = np.flatnonzero(large & (np.arange(len(first)) != first))
                yield _rows(1, np.stack((member[first[star]], member[star]), 1))
                yield _rows(2, np.stack((member[large], (signature[large] & mask | (signature[large] >> top << np.uint64(40))).view(np.int64)), 1))
                keep = ~large
                keep[starts] = True
                signature, member, plain, star_of = signature[keep], member[keep], plain[keep], star_of[keep]
            bucket = (signature >> top).astype(np.int64)
            rest = signature & mask
            packed = np.empty(len(rest), _ENTRY)
            packed["rest"], packed["more"], packed["set"] = rest & np.uint64(0xFFFFFFFF), rest >> np.uint64(32), member
            packed["plain"], packed["star"] = plain, star_of
            edges = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
            yield _batch(
                ("kind", pa.int32(), np.zeros(len(edges) - 1, np.int32)),
                ("bucket", pa.int64(), bucket[edges[:-1]]),
                ("data", pa.binary(), [packed[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]),
            )

    def _rows(kind: int, two: np.ndarray) -> pa.RecordBatch:
        size = 20_000
        parts = [two[i : i + size] for i in range(0, len(two), size)]
        return _batch(
            ("kind", pa.int32(), np.full(len(parts), kind, np.int32)),
            ("bucket", pa.int64(), [int(p[0, 0]) % (1 << bits) for p in parts]),
            ("data", pa.binary(), [np.ascontiguousarray(p).tobytes() for p in parts]),
        )

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        at = None

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            packed = np.concatenate([np.frombuffer(x, _ENTRY) for x in held])
            held.clear()
            signature = packed["rest"].astype(np.uint64) | (packed["more"].astype(np.uint64) << np.uint64(32))
            member = packed["set"].astype(np.int64)
            order = np.lexsort((member, packed["plain"], signature))
            signature, member = signature[order], member[order]
            change = np.concatenate(([True], signature[1:] != signature[:-1]))
            starred = np.maximum.reduceat(packed["star"][order], np.flatnonzero(change))[np.cumsum(change) - 1] > 0
            new = change | np.concatenate(([True], member[1:] != member[:-1]))
            signature, member, starred = signature[new], member[new], starred[new]
            pairs, large, _ = _pairs(signature, member)
            large |= starred
            pairs = np.unique(np.sort(pairs, 1), axis=0) if len(pairs) else pairs
            yield _two(1, pairs[:, 0], pairs[:, 1])
            yield _two(2, member[large], (signature[large] | np.uint64(at << 40 & (1 << 64) - 1)).view(np.int64))

        for batch in batches:
            for kind, bucket, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind:
                    two = np.frombuffer(data, np.int64).reshape(-1, 2)
                    yield _two(kind, two.min(1), two.max(1)) if kind == 1 else _two(kind, two[:, 0], two[:, 1])
                    continue
                if bucket != at:
                    yield from close()
                    at = bucket
                held.append(data)
        yield from close()

    def _two(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return _batch(("kind", pa.int32(), np.full(len(a), kind, np.int32)), ("a", pa.int64(), a), ("b", pa.int64(), b))

    def emit_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from emit(slices(batch, "data", EMIT_BYTES))

    sent = docs.select(utf8().alias("data")).mapInArrow(worker_task(emit_slices, "shingles"), "kind int, bucket bigint, data binary")
    return sent.repartition(max(1, (1 << bits) // BUCKETS_PER_TASK), "bucket").sortWithinPartitions("bucket").mapInArrow(worker_task(resolve, "shingles"), "kind int, a bigint, b bigint")


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) of classes (class_id, rep, n, sketch) whose whole sets are similar enough."""
    own = classes.select("class_id", "n", "sketch")
    sized = (
        pairs.select("a", "b").distinct()
        .join(own.toDF("a", "n_a", "sketch_a"), "a")
        .join(own.toDF("b", "n_b", "sketch_b"), "b")
        .filter(join.den * F.least("n_a", "n_b") >= join.num * F.greatest("n_a", "n_b"))
        .select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    )

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(i).to_pylist() for i in range(2, 6)]
        keep = [least_differences(x, y) <= most_differences(m, n, join.num, join.den) for m, n, x, y in zip(*columns, strict=True)]
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sized = map_batches(sized, near, "a bigint, b bigint", operator="shingles")
    sized = materialize(sized, "candidates")
    return _checked(docs, classes, sized, join)


def _checked(docs: DataFrame, classes: DataFrame, sized: DataFrame, join: Join) -> DataFrame:
    ends = sized.select(F.col("a").alias("class_id")).union(sized.select("b")).distinct()
    wanted = ends.join(classes, "class_id").select("class_id", F.col("rep").alias("doc_id"))
    texts = docs.select("doc_id", utf8().alias("data")).join(wanted, "doc_id").select("class_id", "data")

    def own(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Only rows whose text has the class's set: a doc_id may name several texts."""
        mask = [set_hash(shingle_set(x, join.words)) == c for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        return batch.filter(pa.array(mask, pa.bool_()))

    repeated = classes.groupBy("rep").count().filter("count > 1")
    if not repeated.isEmpty():
        texts = map_batches(texts, own, "class_id bigint, data binary", operator="shingles")
    texts = texts.dropDuplicates(["class_id"])

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        last, left, keep = None, None, []
        for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if a != last:
                last, left = a, shingle_set(x, join.words)
            right = shingle_set(y, join.words)
            both = len(np.intersect1d(left, right, assume_unique=True))
            keep.append(join.den * both >= join.num * (len(left) + len(right) - both))
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    with_b = sized.join(texts.select(F.col("class_id").alias("b"), F.col("data").alias("y")), "b")
    both = with_b.join(texts.select(F.col("class_id").alias("a"), F.col("data").alias("x")), "a").select("a", "b", "x", "y")
    return materialize(map_batches(both, check, "a bigint, b bigint", operator="shingles"), "links")


def open_pairs(members: DataFrame, join: Join) -> DataFrame:
    """(a, b) of members (family, class_id, root, n, sketch): pairs of one family from different components
    whose sizes and sketches allow a link.

    A group is cut into blocks, and each two of its blocks meet in a task, which compares sketches only and
    gives what is left; no row is made for a pair that the sketches exclude.
    """
    counted = members.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = members.join(counted, "family").withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("low"), F.greatest(k, F.col("block")).alias("high")))
    placed = placed.select("family", "class_id", "root", "n", "sketch", "block", F.explode(each).alias("cell")).select("*", "cell.low", "cell.high").drop("cell")

    def compare(table: pa.Table) -> pa.Table:
        rows = table.select(["class_id", "root", "n", "sketch"]).to_pydict()
        left, right = [], []
        by_length: dict[int, list[int]] = {}
        for i, x in enumerate(rows["sketch"]):
            by_length.setdefault(len(x), []).append(i)
        key, root, n = (np.array(rows[c], np.int64) for c in ("class_id", "root", "n"))
        block = np.array(table["block"].to_pylist(), np.int64)
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        for length, own in by_length.items():
            mine = np.array(own)
            bits = np.stack([np.frombuffer(rows["sketch"][i], "<u8") for i in own])
            for other_length in (length, 2 * length):
                if other_length not in by_length:
                    continue
                theirs = np.array(by_length[other_length])
                folded = np.stack([np.frombuffer(rows["sketch"][i], "<u8") for i in theirs])
                if other_length > length:
                    half = folded.shape[1] // 2
                    folded = folded[:, :half] ^ folded[:, half:]
                for i, row in zip(mine, bits, strict=True):
                    may = (root[theirs] != root[i]) & (join.den * np.minimum(n[theirs], n[i]) >= join.num * np.maximum(n[theirs], n[i]))
                    may &= (theirs > i) if other_length == length else True
                    if low != high:
                        may &= block[theirs] != block[i]
                    at = np.flatnonzero(may)
                    if len(at):
                        apart = np.bitwise_count(folded[at] ^ row).sum(1)
                        hit = theirs[at[apart <= most_differences(n[theirs[at]], n[i], join.num, join.den)]]
                        left.append(np.full(len(hit), key[i]))
                        right.append(key[hit])
        a = np.concatenate(left) if left else np.zeros(0, np.int64)
        b = np.concatenate(right) if right else np.zeros(0, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return placed.groupBy("family", "low", "high").applyInArrow(compare, "a bigint, b bigint")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_shingles, component_id, class_id (equal sets share it).

    Documents link when 4 * |intersection| >= 3 * |union| of their sets; component_id is the smallest doc_id
    that links reach. Equal sets are one class before anything is compared. Large groups of one signature give
    links from each set to the group's most typical; where that leaves several components, the pairs between
    those are compared too, so that no link is lost. Null text and text without words have an empty set, are
    linked with nothing and keep their own doc_id. Null doc_ids take part, and name a component only if it has
    no other. Rows that repeat a doc_id with another text are told apart. Further columns are not read. An
    empty table gives no rows.
    """
    return linked_components(docs, Join(signatures))


def linked_components(docs: DataFrame, join: Join) -> DataFrame:
    """jaccard_components for the links of join."""
    found = materialize(survey(docs, join.words), "survey")
    rows = found.filter("kind = 0").select("doc_id", "n", "class_id")
    sketched = found.filter("kind = 0 and n > 0").groupBy("class_id")
    classes = materialize(sketched.agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), "classes")
    count, shingles = classes.agg(F.count(F.lit(1)), F.sum("n")).first()
    least = max(HOT_SETS, (shingles or 0) // MOST_HOT)
    hot = found.filter("kind = 1").groupBy("class_id").agg(F.sum("n").alias("sets")).filter(F.col("sets") >= least)
    hot = np.sort(np.array([r[0] for r in hot.select("class_id").collect()], np.int64).view(np.uint64))
    first = materialize(candidates(docs, hot, max(LEAST_BUCKETS, (count or 0) // DOCS_PER_BUCKET), join), "signature-pairs")
    links = verified(docs, classes, first.filter("kind = 1"), join)
    roots = connected_components(links)
    large = first.filter("kind = 2").select(F.col("a").alias("class_id"), F.col("b").alias("signature")).distinct()
    if not large.isEmpty():
        placed = large.join(roots, large["class_id"] == roots["node"], "left").select("signature", "class_id", F.coalesce("root", "class_id").alias("root"))
        # Signatures of one large group have much the same members: those with the same smallest one are one family,
        # so that a pair is compared once, not for each signature that it shares.
        mixed = placed.groupBy("signature").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("class_id").alias("family")).filter("low <> high")
        open_ = placed.join(mixed.select("signature", "family"), "signature").select("family", "class_id", "root").distinct()
        pairs = open_pairs(open_.join(classes.select("class_id", "n", "sketch"), "class_id"), join)
        more = verified(docs, classes, pairs, join)
        if not more.isEmpty():
            links = links.union(more)
            roots = connected_components(links)
    named = classes.join(roots, classes["class_id"] == roots["node"], "left").select("class_id", F.coalesce("root", "class_id").alias("root"), "rep")
    names = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(names, "root").select("class_id", "component_id")
    # A class may hold a third of all rows: its name comes to them by runs of doc_id.
    spread = rows.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(RUNS)))
    by_run = spread.filter("n > 0").select("run", "class_id").distinct().join(named, "class_id")
    return spread.join(by_run, ["run", "class_id"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "class_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that name their component: one document of each group of near copies.

    Rows that repeat a doc_id and a text are one document, of which one row stays. Null and blank texts stay, as they are linked with nothing; a null
    doc_id stays only where its component has no other. Further columns stay. An empty table gives no rows.
    """
    found = jaccard_components(docs)
    named = materialize(found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")), "kept")
    stays, text_hash = fresh(docs, "stays", "text_hash")
    ids = named.select(F.col("doc_id").alias(stays))
    kept = docs.join(ids, F.col("doc_id").eqNullSafe(F.col(stays)), "left_semi")
    if named.filter("rows > 1").isEmpty():
        return kept
    return kept.withColumn(text_hash, F.xxhash64("text")).dropDuplicates(["doc_id", text_hash]).drop(text_hash)

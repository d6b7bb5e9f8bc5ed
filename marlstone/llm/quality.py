"""Quality rules: distance of a document's histograms from those of its language."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import WS_BYTES, map_batches, materialize, utf8

#: Most Jensen-Shannon distance (base 2, 0 to 1) of character classes, of common words one by one, and of all common words against all others.
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE, MOST_SHARE_DISTANCE = 0.30, 0.45, 0.20
#: Guards: with fewer code points in words or fewer words, that distance isn't held against a document.
LEAST_CHARS, LEAST_WORDS = 200, 60
#: A word is common if it is this share of its language's words; a batch reports words from LOCAL_SHARE on.
COMMON_SHARE, LOCAL_SHARE = 1 / 200, 1 / 4000
#: Words that a language's documents have together, for a reference of it.
LEAST_REFERENCE_WORDS = 2000
#: A language whose common words hold less than this of its words says nothing of a text that lacks them.
LEAST_COMMON_MASS = 1 / 20
BASE_LEAST_WORDS, BASE_REPEATED = 20, 30

_SYMBOLS = list(b"#*$%&|<>")
_CLASSES = ("lower", "upper", "digit", "space", "sentence", "quote", "symbol", "beyond", "control")


def _class_of(byte: int) -> int | None:
    char = chr(byte)
    if 0x80 <= byte < 0xC0:
        return None  # a code point counts once, by its first byte
    if byte >= 0xC0:
        return _CLASSES.index("beyond")
    if byte in WS_BYTES:
        return _CLASSES.index("space")
    if char.isdigit():
        return _CLASSES.index("digit")
    if char.isalpha():
        return _CLASSES.index("lower" if char.islower() else "upper")
    if char in ".,;:!?":
        return _CLASSES.index("sentence")
    if char in "'\"()-":
        return _CLASSES.index("quote")
    return _CLASSES.index("symbol" if 0x20 < byte < 0x7F else "control")


_CLASS_MATRIX = np.zeros((256, len(_CLASSES)), np.int64)
for _byte in range(256):
    if (_at := _class_of(_byte)) is not None:
        _CLASS_MATRIX[_byte, _at] = 1


def byte_histogram(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in a window of ``window`` words which the text has twice or more."""
    if len(words) <= window:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    code = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(29)
    n = len(words) - window + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9) + code[k : k + n]
        mixed ^= mixed >> np.uint64(31)
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def js_distance(p: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of a histogram from each row of references (which sum to 1)."""
    p = p / p.sum()
    m = (p + references) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        right = np.where(references > 0, references * np.log2(references / m), 0).sum(-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


class References:
    """Histograms of the languages: classes (languages, classes), and of words, which are mostly zeros, the common
    ones as triples (language, word, share) and the share of all others of each language."""

    def __init__(self, langs: list, classes: np.ndarray, triples: list[tuple[int, bytes, float]], others: np.ndarray) -> None:
        self.langs, self.classes, self.others = set(langs), classes, others
        self.index = {w: i for i, w in enumerate(sorted({w for _, w, _ in triples}))}
        self.owner = np.array([k for k, _, _ in triples], np.int64)
        self.word = np.array([self.index[w] for _, w, _ in triples], np.int64)
        self.share = np.array([x for _, _, x in triples], float)

    def distances(self, byte_counts: np.ndarray, words: list[bytes]) -> tuple[float, float, float]:
        """The least distances of classes, of common words, and of the histogram of common and other words, over all languages. In the last,
        more common words than a language has are no distance."""
        other, get = len(self.index), self.index.get
        found = np.bincount(np.fromiter((get(w, other) for w in words), np.int64, len(words)), minlength=other + 1)
        p, mass = found / found.sum(), 1 - self.others
        own = np.bincount(self.owner, p[self.word], len(mass))
        share = np.sqrt(np.clip((_divergences(own, mass) + _divergences(1 - own, 1 - mass)) / 2, 0, 1))
        share = np.where((mass < LEAST_COMMON_MASS) | (own >= mass), 0.0, share)
        return float(js_distance(byte_counts @ _CLASS_MATRIX, self.classes).min()), float(self._word_distances(p).min()), float(share.min())

    def _word_distances(self, p: np.ndarray) -> np.ndarray:
        """js_distance of p, whose last entry stands for all other words, from each language."""
        mine = p[self.word]
        shared = np.bincount(self.owner, _divergences(mine, self.share), len(self.others))
        # Words that are common in other languages only are alone in p: each counts in full.
        alone = np.maximum(0, 1 - p[-1] - np.bincount(self.owner, mine, len(self.others)))
        return np.sqrt(np.clip((shared + alone + _divergences(p[-1], self.others)) / 2, 0, 1))


def _divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)


def language_references(docs: DataFrame) -> References | None:
    """From all documents (lang, text): two passes, which return counts only.

    Words are lower-cased in A-Z. In the first pass a batch reports each language's class counts and the words from
    LOCAL_SHARE of its own on, so a word is short of its count by less than LOCAL_SHARE of all words. The second
    one counts exactly the words that may then have COMMON_SHARE: some 200 a language at most.
    Every language of LEAST_REFERENCE_WORDS has a reference, however small its share of the documents. Rows
    without a language make a language of their own.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        classes: dict = {}
        words: dict = {}
        for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(data.lower().split())
            classes[lang] = classes.get(lang, 0) + byte_histogram(data)
        out = []
        for lang, own in words.items():
            total = own.total()
            out.append((lang, 1, b"", total))
            out += [(lang, 2, name.encode(), int(c)) for name, c in zip(_CLASSES, classes[lang] @ _CLASS_MATRIX, strict=True)]
            out += [(lang, 3, w, c) for w, c in own.items() if c >= LOCAL_SHARE * total]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["lang", "kind", "item", "n"])

    sums = map_batches(docs.select("lang", utf8().alias("data")), count, "lang string, kind int, item binary, n bigint", by="data")
    sums = materialize(sums.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "language-counts")
    totals = sums.filter((F.col("kind") == 1) & (F.col("n") >= LEAST_REFERENCE_WORDS)).select(F.col("lang").alias("own"), F.col("n").alias("total"))
    told = sums.join(totals, F.col("lang").eqNullSafe(F.col("own")))
    rows = told.filter((F.col("kind") == 2) | (F.col("kind") == 3) & (F.col("n") >= (COMMON_SHARE - LOCAL_SHARE) * F.col("total"))).collect()
    total_of = {r["lang"]: r["total"] for r in rows}
    wanted: dict = {}
    for r in rows:
        if r["kind"] == 3:
            wanted.setdefault(r["lang"], []).append(bytes(r["item"]))

    def recount(batch: pa.RecordBatch) -> pa.RecordBatch:
        words: dict = {}
        for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang in wanted:
                words.setdefault(lang, Counter()).update(data.lower().split())
        out = [(lang, w, own[w]) for lang, own in words.items() for w in wanted[lang] if own[w]]
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["lang", "item", "n"])

    exact = map_batches(docs.select("lang", utf8().alias("data")), recount, "lang string, item binary, n bigint", by="data").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    common = [(r["lang"], bytes(r["item"]), r["n"] / total_of[r["lang"]]) for r in exact.collect() if r["n"] >= COMMON_SHARE * total_of[r["lang"]]] if wanted else []
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, x or ""))
    if not langs:
        return None
    at = {x: i for i, x in enumerate(langs)}
    classes, others = np.zeros((len(langs), len(_CLASSES))), np.ones(len(langs))
    triples = []
    for r in rows:
        if r["kind"] == 2:
            classes[at[r["lang"]], _CLASSES.index(bytes(r["item"]).decode())] = r["n"]
    for lang, word, share in sorted(common, key=lambda x: (at[x[0]], x[1])):
        triples.append((at[lang], word, share))
        others[at[lang]] -= share
    return References(langs, classes / classes.sum(1, keepdims=True), triples, np.maximum(0, others))


def verdict(data: bytes, lang: str | None, references: References | None) -> tuple:
    words = data.split()
    counts = byte_histogram(data)
    lines = [x for x in data.split(b"\n") if x.strip(WS_BYTES)]
    n_words, repeated = len(words), repeated_words(words)
    chars = int(counts.sum() - counts[0x80:0xC0].sum() - counts[list(WS_BYTES)].sum())
    failed = n_words < BASE_LEAST_WORDS or 100 * repeated > BASE_REPEATED * n_words
    by_class = by_word = by_share = None
    if references is not None and n_words:
        by_class, by_word, by_share = references.distances(counts, data.lower().split())
    kept = not failed
    if kept and by_class is not None and lang in references.langs:
        kept = not (chars >= LEAST_CHARS and by_class > MOST_CLASS_DISTANCE or n_words >= LEAST_WORDS and (by_word > MOST_WORD_DISTANCE or by_share > MOST_SHARE_DISTANCE))
    return n_words, chars, int(counts[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated, failed, kept, by_class, by_word, by_share


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double, share_distance double"


def quality(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text, lang): doc_id, the counts, base_failed, kept, and the distances of its character classes, of its common
    words, and of how many of its words are common.

    A document that the base rule passes is rejected if one of its three histograms is further than the most allowed from every language's
    reference, and it is long enough to tell. Distances aren't held
    against a document whose own language has too few words for a reference. Null text counts as empty: no
    words, base_failed. Distances are null without words. Rows are judged one by one, so repeats
    get the same verdict. Further columns are not read. An empty table gives no rows.
    """
    references = language_references(docs)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [verdict(data, lang, references) for lang, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3
        columns = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "lang", utf8().alias("data")), judge, f"doc_id {kind}, {SCHEMA}", by="data")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns; the text is read once for the verdict.

    Null and blank texts go, as does what quality() rejects; a null lang is one of its own. Rows that repeat a doc_id are judged each by its text, so
    ties and repeats stay or go together. An empty table gives no rows.
    """
    references = language_references(docs)

    @F.pandas_udf("boolean")
    def kept(lang, data):
        return pd.Series([verdict(x, None if pd.isna(k) else k, references)[6] for k, x in zip(lang, data, strict=True)], dtype=bool)

    return docs.filter(kept("lang", utf8()))

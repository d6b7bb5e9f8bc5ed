"""Language ID: a byte convolutional network, trained in numpy, applied to fixed-length windows of whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import map_batches

#: Bytes of a window; sizes of the byte vectors, of the filters, and filters of each size.
WINDOW, DEPTH, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 8
#: The labelled sample: documents per language and windows per document. All languages are labels; where they are
#: many, each has its share of so many documents, and LEAST_DOCS at least.
SAMPLE_DOCS, SAMPLE_WINDOWS, SHARED_DOCS, LEAST_DOCS = 240, 16, 240 * 64, 40
#: Slices in which the sample of a language is looked for.
SLICES = 16
EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 6, 700, 128, 0.004, 7
#: Windows that inference takes at once.
CHUNK = 512
FOLDS = 5


def _byte_table() -> np.ndarray:
    """Bytes as the network sees them: A-Z as a-z, digits alike, white space and controls as space."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[48:58] = 48
    table[:33] = 32
    table[127] = 32
    return table


_TABLE = _byte_table()
PAD = 0  # no byte maps to it


def windows_of(data: bytes, length: int = WINDOW) -> np.ndarray:
    """All windows of a text, one after the other, the last one padded."""
    seen = _TABLE[np.frombuffer(data, np.uint8)]
    out = np.full(-(-len(seen) // length) * length, PAD, np.uint8)
    out[: len(seen)] = seen
    return out.reshape(-1, length)


class ByteConvNet:
    """Byte vectors, filters of several widths, the maximum of each over the window, softmax."""

    def __init__(self, labels: list[str], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        span = max(WIDTHS)
        self.labels = labels
        self.bytes = rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32)
        self.bytes[PAD] = 0
        self.mask = np.zeros((span * DEPTH, len(WIDTHS) * FILTERS), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[: width * DEPTH, k * FILTERS : (k + 1) * FILTERS] = 1
        self.filters = (rng.normal(0, (span * DEPTH) ** -0.5, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(self.mask.shape[1], np.float32)
        self.out = rng.normal(0, 0.2, (self.mask.shape[1], len(labels))).astype(np.float32)
        self.shift = np.zeros(len(labels), np.float32)

    def _parts(self) -> list[str]:
        return ["bytes", "filters", "bias", "out", "shift"]

    def _responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vectors = self.bytes[windows]
        n, length, depth = vectors.shape
        span = max(WIDTHS)
        a, b, c = vectors.strides
        patches = np.lib.stride_tricks.as_strided(vectors, (n, length - span + 1, span * depth), (a, b, c))
        return vectors, (patches.reshape(-1, span * depth) @ self.filters).reshape(n, length - span + 1, -1)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        _, responses = self._responses(windows)
        return np.maximum(responses.max(1) + self.bias, 0) @ self.out + self.shift

    def _gradients(self, windows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        vectors, responses = self._responses(windows)
        n, span = len(windows), max(WIDTHS)
        at = responses.argmax(1)
        top = np.take_along_axis(responses, at[:, None, :], 1)[:, 0] + self.bias
        pooled = np.maximum(top, 0)
        scores = pooled @ self.out + self.shift
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), target] -= 1
        p /= n
        down = (p @ self.out.T) * (top > 0)
        places = at[:, :, None] + np.arange(span)
        patches = vectors[np.arange(n)[:, None, None], places].reshape(n, at.shape[1], -1)
        g_filters = np.einsum("nf,nfd->df", down, patches) * self.mask
        back = (down[:, :, None] * self.filters.T[None]).reshape(-1, DEPTH)
        g_bytes = np.zeros_like(self.bytes)
        np.add.at(g_bytes, windows[np.arange(n)[:, None, None], places].ravel(), back)
        g_bytes[PAD] = 0
        return [g_bytes, g_filters, down.sum(0), pooled.T @ p, p.sum(0)]

    def fit(self, windows: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> ByteConvNet:
        """Adam on cross entropy, for LEAST_STEPS batches at least; the same rows give the same network."""
        epochs = max(epochs, -(-LEAST_STEPS * BATCH // len(windows)))
        rng = np.random.default_rng(seed)
        first = [np.zeros_like(getattr(self, p)) for p in self._parts()]
        second = [np.zeros_like(x) for x in first]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            rate = RATE * (1 - epoch / epochs)
            for i in range(0, len(order), BATCH):
                step += 1
                pick = order[i : i + BATCH]
                for part, g, m, v in zip(self._parts(), self._gradients(windows[pick], target[pick]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                    setattr(self, part, (getattr(self, part) - change).astype(np.float32))
        return self

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The label's number and its probability of each text: the softmax of the mean over all its windows."""
        found = np.zeros((len(texts), len(self.labels)))
        counts = np.zeros(len(texts))
        held: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def flush() -> None:
            windows, owner = np.concatenate(held), np.concatenate(owners)
            filled = (windows != PAD).mean(1)
            for i in range(0, len(windows), CHUNK):
                weight = filled[i : i + CHUNK]
                np.add.at(found, owner[i : i + CHUNK], self.logits(windows[i : i + CHUNK]) * weight[:, None])
                np.add.at(counts, owner[i : i + CHUNK], weight)
            held.clear()
            owners.clear()

        waiting = 0
        for k, data in enumerate(texts):
            held.append(windows_of(data))
            owners.append(np.full(len(held[-1]), k))
            waiting += len(held[-1])
            if waiting >= 8 * CHUNK:
                flush()
                waiting = 0
        if held:
            flush()
        mean = found / np.maximum(counts, 1e-9)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(texts)), best]


def held_out() -> F.Column:
    """Whether the remainder of crc32(doc_id as text) by FOLDS is 0; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(labelled: DataFrame, seed: int = SEED) -> ByteConvNet | None:
    """A network from labelled rows (text, lang); None without any.

    Every language is a label. The sample is bounded for each: the SAMPLE_DOCS documents (fewer where languages
    are many, LEAST_DOCS at least) with the smallest seeded hash of their text, and SAMPLE_WINDOWS windows of each,
    spread over the whole text.
    """
    rows = labelled.filter("lang is not null and text is not null and text <> ''")
    labels = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not labels:
        return None
    most = max(LEAST_DOCS, min(SAMPLE_DOCS, SHARED_DOCS // len(labels)))

    @F.pandas_udf("binary")
    def sampled(texts):
        def some(text: str) -> bytes:
            windows = windows_of(text.encode())
            at = np.unique(np.linspace(0, len(windows) - 1, SAMPLE_WINDOWS).astype(int))
            return windows[at].tobytes()

        return texts.map(some)

    first = lambda found, *by: found.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).filter(F.col("nth") <= most)
    keys = rows.select("lang", F.xxhash64(F.lit(seed), "text").alias("key")).distinct()
    # A language may hold most rows: the smallest of each of its slices first, then of those.
    chosen = first(first(keys.withColumn("slice", F.pmod("key", F.lit(SLICES))), "lang", "slice"), "lang").select("lang", "key").collect()
    wanted = F.xxhash64(F.lit(seed), "text").isin([r["key"] for r in chosen])
    pairs = {(r["lang"], r["key"]) for r in chosen}
    sample = rows.filter(wanted).select("lang", F.xxhash64(F.lit(seed), "text").alias("key"), "text")
    # Copies of one text would multiply the sample: one row for each language and text.
    sample = sample.groupBy("lang", "key").agg(F.min("text").alias("text")).select("lang", "key", sampled("text").alias("windows"))
    found = sorted((r["lang"], r["key"], bytes(r["windows"])) for r in sample.collect() if (r["lang"], r["key"]) in pairs)
    number = {x: i for i, x in enumerate(labels)}
    windows = [np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for _, _, w in found]
    target = np.concatenate([np.full(len(w), number[lang]) for w, (lang, _, _) in zip(windows, found, strict=True)])
    return ByteConvNet(labels, seed).fit(np.concatenate(windows), target)


def identify(docs: DataFrame, model: ByteConvNet | None) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, lang_pred, score. Only the text is looked at.

    ``und`` with score 0 if text is null or has no letter, or there is no model. Rows are judged one by one, so
    repeats get the same label. Further columns are not read. An empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        usable = [i for i, t in enumerate(texts) if t and model is not None and any(map(str.isalpha, t))]
        label, score = ["und"] * len(texts), [0.0] * len(texts)
        if usable:
            best, p = model.predict([texts[i].encode() for i in usable])
            for i, k, x in zip(usable, best, p, strict=True):
                label[i], score[i] = model.labels[k], float(x)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(label), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double", by="text")


def identify_held_out(docs: DataFrame) -> DataFrame:
    """identify() of all rows of docs (doc_id, text, lang) by a network from those that held_out() leaves."""
    model = train(docs.filter(~held_out()))
    return identify(docs, model).withColumn("held_out", held_out())

"""Answers and their evidence: citations, prompts, generators behind an interface."""

from __future__ import annotations

import difflib
import hashlib
import re
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def context_block(number: Column, file: Column, symbol: Column, start: Column, end: Column, text: Column) -> Column:
    head = F.format_string("[%s] %s", number.cast("string"), F.concat_ws("::", file, symbol))
    return F.concat(head, F.lit(" (lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")\n"), text)


@F.pandas_udf(T.StringType())
def unified_diff(old, new):
    return old.combine(new, lambda a, b: "\n".join(difflib.unified_diff(a.split("\n"), b.split("\n"), "before", "after", lineterm="", n=3)))


def suggested_name(base: str, taken: Sequence[str]) -> str:
    """base, or with a number before its ending, so that it is none of those taken."""
    stem, dot, ending = base.rpartition(".")
    lower, k, name = {t.lower() for t in taken}, 1, base
    while name.lower() in lower:
        k += 1
        name = f"{stem}-{k}{dot}{ending}"
    return name


class Embedder(Protocol):
    name: str
    dimension: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class Generator(Protocol):
    def generate(self, prompt: str, system: str | None = None) -> str: ...


class HashEmbedder:
    """Unit vectors seeded by the text: the same text, the same vector. A stand-in without a model."""

    def __init__(self, dimension: int = 32) -> None:
        self.name, self.dimension = f"hash-{dimension}", dimension

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.empty((len(texts), self.dimension), np.float32)
        for i, text in enumerate(texts):
            seed = int.from_bytes(hashlib.md5(text.encode(), usedforsecurity=False).digest()[:8], "big")
            v = np.random.default_rng(seed).normal(size=self.dimension)
            out[i] = v / np.linalg.norm(v)
        return out


class RecordingGenerator:
    """Answers by a function and remembers what it was asked."""

    def __init__(self, answer: Callable[[str], str]) -> None:
        self.answer, self.prompts = answer, []

    def generate(self, prompt: str, system: str | None = None) -> str:
        self.prompts.append(prompt)
        return self.answer(prompt)


#: The model that a worker holds, by name.
_MODEL: dict[str, Embedder] = {}


def model_of(name: str, make: Callable[[], Embedder]) -> Embedder:
    """The model of that name: made once in a worker and kept for its next tasks, until one of another name is asked for."""
    if name not in _MODEL:
        _MODEL.clear()
        _MODEL[name] = make()
    return _MODEL[name]


def embedded(chunks: DataFrame, make: Callable[[], Embedder], batch: int = 32, name: str | None = None) -> DataFrame:
    """chunks (chunk_id, text) with unit vectors, in batches; a task makes the model once, or with a name a worker does."""

    def run(batches):
        model = make() if name is None else model_of(name, make)
        for rows in batches:
            vectors = [v for i in range(0, len(rows), batch) for v in model.embed(list(rows["text"][i : i + batch]))]
            yield rows.assign(embedding=vectors)[["chunk_id", "embedding"]]

    return chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id string, embedding array<float>")


NO_EVIDENCE = "The indexed sources have nothing on this."


def answer(question: str, packed: Sequence[str], generator: Generator) -> str:
    """An answer from packed context; without any, a fixed text, and the generator isn't asked."""
    if not packed:
        return NO_EVIDENCE
    return ft_strip(generator.generate("Context:\n" + "\n\n".join(packed) + f"\n\nQuestion: {question}"))


def ft_strip(text: str) -> str:
    return re.sub(r"(?s)<think>.*?</think>\s*", "", text).strip()

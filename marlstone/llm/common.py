"""What the operators share: text constants, tables in the shared folder, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.stored import scratch_path, shared_dir
from marlstone.operators.stored import settle as materialize

__all__ = ["WS_BYTES", "WS_RUN", "fresh", "held", "map_batches", "materialize", "scratch_path", "shared_dir", "slices", "utf8", "worker_task"]

#: White space that separates words: ``[\x20\x09-\x0D]``. ``bytes.split()`` splits on exactly these.
WS_BYTES = b" \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, changed where df has columns of that name."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def utf8(column: str = "text") -> F.Column:
    """Text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


#: What workers keep from one task for the next, by operator.
_HELD: dict[str, list[dict]] = {}


def held(operator: str, cache: dict) -> dict:
    """cache, which workers keep between tasks of the operator only."""
    _HELD.setdefault(operator, []).append(cache)
    return cache


def worker_task(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], operator: str = "") -> Callable:
    """fn for mapInArrow. A worker lives on after a task: before one it drops what other operators' tasks have
    left in their caches, after one it gives free Arrow memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, caches in _HELD.items():
            if name != operator:
                for cache in caches:
                    cache.clear()
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return run


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch, so that a slice's values in a column have most_bytes at most, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if batch.num_rows:
        yield batch.slice(start)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, by: str | None = None, most_bytes: int = 8 << 20, operator: str = "") -> DataFrame:
    """mapInArrow with one output batch per input batch, or per slice of it by the bytes in column ``by``: what
    a task holds is then bounded by most_bytes, or the longest text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, by, most_bytes) if by else [batch]:
                if part.num_rows:
                    yield fn(part)

    return df.mapInArrow(worker_task(run, operator), schema)

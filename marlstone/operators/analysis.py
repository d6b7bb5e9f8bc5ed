"""The analysis of a repository from its files to tables: stages that must succeed, and stages that may fail by themselves."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import chunks as ch
from marlstone.operators import evidence, resolve
from marlstone.operators.knowledge import index_meta
from marlstone.operators.session import Session, StageTracker
from marlstone.operators.stored import settle
from marlstone.sources import python_code, repository

#: A scanner: what it finds in a file's path and text, as (rule, severity, category, line, message).
Scanner = Callable[[str, str], Iterable[tuple[str, str, str, int, str]]]


class AnalysisFailure(Exception):
    """A failure whose message is for users."""


def scan_isolated(files: DataFrame, scanners: dict[str, Callable[[], Scanner]]) -> tuple[DataFrame, DataFrame]:
    """Findings (source, path, rule, severity, category, line, message) of files (path, text), and for each scanner its status: source, ran, findings,
    failed_files, error.

    A task makes each scanner once. One that can't be made, or that fails on a file, gives rows of an error channel instead; other files and other
    scanners go on. ran: it looked at some file, or there is none. error is the first by path.
    """
    names = ["source", "path", "failed", "rule", "severity", "category", "line", "message"]
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Scanner | str] = {}
        for name, make in scanners.items():
            try:
                made[name] = make()
            except Exception as broken:  # noqa: BLE001
                made[name] = _told(broken)
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for name, scanner in made.items():
                    if isinstance(scanner, str):
                        rows.append((name, path, True, None, None, None, None, scanner))
                        continue
                    try:
                        rows += [(name, path, False, *found) for found in scanner(path, text)] or [(name, path, False, None, None, None, None, None)]
                    except Exception as broken:  # noqa: BLE001
                        rows.append((name, path, True, None, None, None, None, _told(broken)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    seen = settle(files.filter("text is not null").select("path", "text").mapInArrow(run, "source string, path string, failed boolean, rule string, severity string, category string, line int, message string"), "scan")
    findings = seen.filter("not failed and rule is not null").drop("failed")
    every = files.sparkSession.createDataFrame([(n,) for n in scanners], "source string")
    counted = seen.groupBy("source").agg(
        F.bool_or(~F.col("failed")).alias("some"), F.count_if(~F.col("failed") & F.col("rule").isNotNull()).alias("findings"), F.count_distinct(F.when(F.col("failed"), F.col("path"))).alias("failed_files"), F.min_by(F.when(F.col("failed"), F.col("message")), F.when(F.col("failed"), F.col("path"))).alias("error"),
    )
    status = every.join(counted, "source", "left").select("source", F.coalesce("some", F.lit(True)).alias("ran"), F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("failed_files", F.lit(0)).alias("failed_files"), "error")
    return findings, status


def _told(broken: Exception) -> str:
    """What went wrong, in a line; of a task's failure what was raised in it."""
    inner = re.findall(r"(?m)^(?:[\w.]+\.)?(\w+(?:Error|Exception): .+)$", str(broken))
    return (inner[-1] if inner else f"{type(broken).__name__}: {broken}")[:200]


def python_scanner() -> Scanner:
    """The rules over Python sources, as a scanner."""

    def scan(path: str, text: str) -> list[tuple[str, str, str, int, str]]:
        if not path.endswith((".py", ".pyi")):
            return []
        return [(f["rule"], f["severity"], f["category"], f["line"], f["rule"]) for f in python_code.parse(path, text)[6]]

    return scan


def run_analysis(spark: SparkSession, session: Session, path: str, make_embedder: Callable[[], evidence.Embedder] | None = None, scanners: dict[str, Callable[[], Scanner]] | None = None, model: str | None = None) -> dict[str, str | None]:
    """All stages over the directory at path into the session's tables; the errors of the optional stages (vectors, security), none where they went well.

    A repository without a file that counts, or a failure of a stage that isn't optional, marks the run as failed, drops what was written, and is raised.
    An optional stage that fails leaves no table of its own, and its error in the result.
    """
    tracker = StageTracker(session)
    errors: dict[str, str | None] = {}

    def optional(stage: str, name: str, work: Callable[[], None]) -> None:
        tracker.start(stage)
        try:
            work()
            errors[name] = None
        except Exception as broken:  # noqa: BLE001
            errors[name] = _told(broken)
            tracker.skip(stage, errors[name])

    try:
        tracker.start("cloning")
        tracker.start("scanning")
        files = settle(repository.scanned(repository.described(repository.read_repository(spark, path))), "files")
        if files.isEmpty():
            raise AnalysisFailure("The repository contains no source files.")
        session.write("files", files)
        tracker.start("parsing")
        parsed = settle(python_code.parsed(files), "parsed")
        entities = settle(python_code.entities(parsed), "entities")
        imports, calls, modules = python_code.exploded(parsed, "imports"), python_code.exploded(parsed, "calls"), resolve.module_map(files)
        edge = lambda df, relation: df.select("source", "target", F.lit(relation).alias("relation"))
        edges = edge(resolve.import_edges(imports, modules), "imports").union(edge(resolve.call_edges(calls, imports, modules, entities), "calls")).union(edge(resolve.inherit_edges(entities, imports, modules), "inherits"))
        session.write("entities", entities)
        session.write("relationships", edges.union(entities.select(F.col("parent").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation"))))
        tracker.start("chunking")
        session.write("chunks", ch.build_chunks(files.select(F.col("path").alias("file"), "text"), entities.select("file", "id", "parent", "type", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))))
        if make_embedder is not None:
            def embed() -> None:
                session.write("vectors", evidence.embedded(session.read("chunks"), make_embedder))
                session.write("index", index_meta(session.read("vectors"), getattr(make_embedder, "__name__", "model") if model is None else model))

            optional("embedding", "vectors", embed)
        if scanners is not None:
            def secure() -> None:
                findings, status = scan_isolated(files, scanners)
                session.write("findings", findings)
                session.write("scanners", status)

            optional("security", "security", secure)
        tracker.finish()
    except Exception as broken:
        tracker.fail(str(broken) if isinstance(broken, AnalysisFailure) else "Analysis failed unexpectedly.")
        raise
    return errors

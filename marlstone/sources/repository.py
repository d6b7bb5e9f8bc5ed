"""A directory tree as a table: a Python data source that prunes on the walk and reads contents in tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from marlstone.functions import paths

SCHEMA = "walk_ord long, path string, size_bytes long, content binary"
FILES_PER_PARTITION = 256
#: Contents above this are not read; bytes that are looked at for a NUL first.
MOST_BYTES, SNIFF = 1_000_000, 8192


class _Files(InputPartition):
    def __init__(self, entries: list[tuple[int, str, int]]) -> None:
        self.entries = entries


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.most = options["path"], int(options.get("maxbytes", MOST_BYTES))

    def walk(self) -> Iterator[tuple[str, int]]:
        """Top-down, a directory's own files before its subdirectories, both by name; links are not followed."""
        for folder, dirs, names in os.walk(self.root):
            dirs[:] = sorted(
                d for d in dirs if d.lower() not in paths.IGNORED_DIRS and not os.path.islink(f"{folder}/{d}") and not os.path.exists(f"{folder}/{d}/pyvenv.cfg")
            )
            for name in sorted(names):
                full = os.path.join(folder, name)
                if not os.path.islink(full):
                    yield os.path.relpath(full, self.root).replace(os.sep, "/"), os.path.getsize(full)

    def partitions(self) -> list[InputPartition]:
        entries = [(i, p, n) for i, (p, n) in enumerate(self.walk())]
        return [_Files(entries[i : i + FILES_PER_PARTITION]) for i in range(0, len(entries), FILES_PER_PARTITION)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for order, path, size in partition.entries:
            content = None
            if size <= self.most:
                try:
                    with open(os.path.join(self.root, path), "rb") as file:
                        content = file.read()
                except OSError:
                    content = None
            yield order, path, size, content


class RepositorySource(DataSource):
    """spark.read.format("repository").load(directory); the directory must be on a path that all tasks can open."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_repository(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(RepositorySource)
    return spark.read.format("repository").load(path)


@F.pandas_udf(T.StringType())
def decoded(content):
    """Bytes as text; UTF-16 if they start so, else UTF-8, with replacements for what isn't."""
    return content.map(lambda b: None if b is None else b.decode("utf-16" if b[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8", "replace"))


def described(tree: DataFrame) -> DataFrame:
    """Files with what their path and content say: text (null if binary), language, line_count and flags."""
    path = F.col("path")
    utf16 = F.substring("content", 1, 2).isin(b"\xff\xfe", b"\xfe\xff")
    has_nul = F.instr(F.hex("content"), "00") > 0
    nul = F.when(has_nul, F.regexp_like(F.hex("content"), F.lit("^(..)*?00"))).otherwise(F.lit(False))
    binary = paths.is_binary_name(path) | F.coalesce(nul & ~utf16, F.lit(False))
    text = decoded("content")
    out = tree.select(
        "walk_ord", "path", paths.name_of(path).alias("name"), paths.extension_of(path).alias("extension"), paths.language_of(path).alias("language"), "size_bytes",
        binary.alias("is_binary"), paths.is_junk(path).alias("is_junk"), paths.is_entry_point(path).alias("is_entry_point"), paths.is_project_file(path).alias("is_project_file"),
        paths.is_test_file(path).alias("is_test_file"), F.when(~binary, text).alias("text"),
    )
    return out.withColumn("line_count", F.when(F.col("language").isNotNull(), paths.line_count(F.col("text"))))


def scanned(files: DataFrame) -> DataFrame:
    """The files that count: no binary or junk, of a known language or a known name."""
    return files.filter("not is_binary and not is_junk and (language is not null or is_project_file)")


def scan_summary(files: DataFrame) -> DataFrame:
    known = F.col("language").isNotNull() | F.col("is_project_file")
    return files.agg(
        F.count(F.lit(1)).alias("total_files_seen"), F.count_if(~F.col("is_binary") & ~F.col("is_junk") & known).alias("files_included"), F.count_if("is_binary").alias("files_skipped_binary"),
        F.count_if(~F.col("is_binary") & (F.col("is_junk") | ~known)).alias("files_skipped_other"), F.count_if(F.col("size_bytes") > MOST_BYTES).alias("files_skipped_large"),
    )

"""Health of repositories: indicators of documentation, size, dependencies and security, a row for each repository.

files: (repo, path, language, line_count, is_test, is_entry); entities: (repo, file, id, type, docstring, parameters, start_line, end_line). Lists are cut
by ranks; what was not measured is null, not zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import frameworks as fw
from marlstone.functions import paths
from marlstone.operators.guide import _known, readmes

# Folders, endings and names of documents, languages that are no code, thresholds and the lengths of lists.
DOC_DIRS = ["docs", "doc", "documentation", "wiki"]
DOC_EXTENSIONS = ["md", "rst", "txt", "adoc"]
ROOT_DOCS = ["contributing", "changelog", "changes", "architecture", "design", "security", "code_of_conduct"]
NOT_CODE = ["json", "yaml", "toml", "config", "markdown", "restructuredtext", "text", "xml", "html", "css", "docker", "make", "sql", "shell", "powershell"]
FILE_LINES, FUNCTION_LINES, PARAMETERS, MOST_LISTED, MOST_PACKAGES = 500, 80, 6, 12, 30


def _listed(rows: DataFrame, name: str, value: str, most: int = MOST_LISTED) -> DataFrame:
    """(repo, name, name_total): the largest first, each with its value."""
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc(value), "id")))
    items = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", "id", F.col(value).cast("long").alias("value"))))), lambda x: F.struct(x["id"].alias("id"), x["value"].alias("value")))
    return ranked.groupBy("repo").agg(items.alias(name), F.count(F.lit(1)).alias(f"{name}_total"))


def real_parameters(parameters: Column) -> Column:
    """Parameters without self and cls, whatever their annotations and defaults."""
    return F.filter(parameters, lambda p: ~F.trim(F.split(F.split(p, ":")[0], "=")[0]).isin("self", "cls"))


def documentation(files: DataFrame, entities: DataFrame) -> DataFrame:
    """(repo, readme, documentation_files, documentation_paths, documented, documentable, coverage): the README, documents in folders of documents or at
    the root, and how many of the entities outside tests have a docstring."""
    parts = F.split(F.lower("path"), "/")
    stem = F.regexp_replace(F.lower(paths.name_of(F.col("path"))), r"(?<=.)\.[^.]*$", "")
    is_doc = paths.extension_of(F.col("path")).isin(DOC_EXTENSIONS)
    inside = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, DOC_DIRS)))
    docs = files.filter(is_doc & (inside | ((F.size(parts) == 1) & stem.isin(ROOT_DOCS)))).select("repo", F.col("path").alias("id"))
    ranked = docs.withColumn("k", F.row_number().over(Window.partitionBy("repo").orderBy("id")))
    listed = ranked.groupBy("repo").agg(F.count(F.lit(1)).alias("documentation_files"), F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= MOST_LISTED, F.struct("k", "id")))), lambda x: x["id"]).alias("documentation_paths"))
    code = _known(entities, files).filter("not is_test").groupBy("repo").agg(F.count_if(F.trim(F.coalesce("docstring", F.lit(""))) != "").alias("documented"), F.count(F.lit(1)).alias("documentable"))
    row = files.select("repo").distinct().join(readmes(files).withColumnRenamed("path", "readme"), "repo", "left").join(listed, "repo", "left").join(code, "repo", "left")
    row = row.na.fill(0, ["documentation_files", "documented", "documentable"])
    return row.select("repo", "readme", "documentation_files", F.coalesce("documentation_paths", F.array().cast("array<string>")).alias("documentation_paths"), "documented", "documentable", F.when(F.col("documentable") > 0, F.round(F.col("documented") / F.col("documentable"), 3)).alias("coverage"))


def maintainability(files: DataFrame, entities: DataFrame, file_lines: int = FILE_LINES, function_lines: int = FUNCTION_LINES, parameters: int = PARAMETERS) -> DataFrame:
    """(repo, source_files, functions, large_files, large_files_total, large_functions, large_functions_total, many_parameters, many_parameters_total,
    largest_file, longest_function, median_function) of code outside tests. Lists hold (id, value), the largest first; the median is the upper one."""
    source = files.filter(F.col("language").isNotNull() & ~F.col("language").isin(NOT_CODE) & ~F.col("is_test")).select("repo", F.col("path").alias("id"), F.coalesce("line_count", F.lit(0)).alias("n"))
    calls = _known(entities, files).filter("not is_test and type in ('function', 'method')")
    calls = calls.select("repo", "id", (F.col("end_line") - F.col("start_line") + 1).alias("n"), F.size(real_parameters(F.coalesce("parameters", F.array().cast("array<string>")))).alias("p"))
    sizes = source.groupBy("repo").agg(F.count(F.lit(1)).alias("source_files"), F.max("n").alias("largest_file"))
    by_length = Window.partitionBy("repo").orderBy("n", "id")
    ranked = calls.withColumn("k", F.row_number().over(by_length) - 1).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("repo")))
    lengths = ranked.groupBy("repo").agg(F.max("all").alias("functions"), F.max("n").alias("longest_function"), F.max(F.when(F.col("k") == F.floor(F.col("all") / 2), F.col("n"))).alias("median_function"))
    row = files.select("repo").distinct()
    for part in (sizes, lengths, _listed(source.filter(F.col("n") > file_lines), "large_files", "n"), _listed(calls.filter(F.col("n") > function_lines), "large_functions", "n"), _listed(calls.filter(F.col("p") > parameters), "many_parameters", "p")):
        row = row.join(part, "repo", "left")
    counts = ["source_files", "functions", "large_files_total", "large_functions_total", "many_parameters_total", "largest_file", "longest_function", "median_function"]
    none = F.array().cast("array<struct<id:string,value:bigint>>")
    lists = [F.coalesce(c, none).alias(c) for c in ("large_files", "large_functions", "many_parameters")]
    return row.na.fill(0, counts).select("repo", *counts, *lists)


def dependencies(manifests: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo, files, unparsed, count, pinned, packages) of manifests (repo, path, parsed) and what they name, found (repo, path, package, pinned); and the
    frameworks (repo, name, category, evidence) that the packages stand for, each at the first manifest that names it. A package counts once, and as pinned if any
    manifest pins it; nothing is counted where no manifest could be parsed."""
    named = found.select("repo", "path", fw.package_key(F.col("package")).alias("package"), "pinned")
    each = named.groupBy("repo", "package").agg(F.bool_or("pinned").alias("pinned"))
    ranked = each.withColumn("k", F.row_number().over(Window.partitionBy("repo").orderBy("package")))
    counted = ranked.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.count_if("pinned").alias("pinned"), F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= MOST_PACKAGES, F.struct("k", "package")))), lambda x: x["package"]).alias("packages"))
    listed = manifests.groupBy("repo").agg(F.array_sort(F.collect_list("path")).alias("files"), F.array_sort(F.collect_list(F.when(~F.col("parsed"), F.col("path")))).alias("unparsed"), F.bool_or("parsed").alias("some"))
    row = listed.join(counted, "repo", "left")
    out = row.select("repo", "files", "unparsed", F.when(F.col("some"), F.coalesce("n", F.lit(0))).alias("count"), F.when(F.col("some"), F.coalesce("pinned", F.lit(0))).alias("pinned"), F.coalesce("packages", F.array().cast("array<string>")).alias("packages"))
    known = found.sparkSession.createDataFrame(fw.FRAMEWORKS, "package string, name string, category string")
    hits = named.join(F.broadcast(known), "package").groupBy("repo", "name", "category").agg(F.min("path").alias("evidence"))
    return out, hits.select("repo", "name", "category", "evidence")


def security(repos: DataFrame, findings: DataFrame | None, status: DataFrame | None) -> DataFrame:
    """(repo, scanned, critical, high, medium, low, secrets, scanners) of findings (repo, severity, category) and status (repo, source, ran). Where no
    scanner ran, nothing is claimed: counts are null."""
    kinds = ["critical", "high", "medium", "low"]
    if findings is None or status is None:
        return repos.select("repo", F.lit(False).alias("scanned"), *[F.lit(None).cast("long").alias(k) for k in (*kinds, "secrets")], F.array().cast("array<string>").alias("scanners"))
    ran = status.groupBy("repo").agg(F.array_sort(F.collect_set(F.when(F.col("ran"), F.col("source")))).alias("scanners"))
    counted = findings.groupBy("repo").agg(*[F.count_if(F.col("severity") == k.upper()).alias(k) for k in kinds], F.count_if(F.col("category") == "secret").alias("secrets"))
    row = repos.select("repo").distinct().join(ran, "repo", "left").join(counted, "repo", "left")
    scanned = F.coalesce(F.size("scanners") > 0, F.lit(False))
    return row.select("repo", scanned.alias("scanned"), *[F.when(scanned, F.coalesce(k, F.lit(0))).alias(k) for k in (*kinds, "secrets")], F.coalesce("scanners", F.array().cast("array<string>")).alias("scanners"))


#: What is said of a count by scanners, and of none. Own words.
NOT_SCANNED = "No scanner has run, so nothing is claimed."


def overview_slice(security_: DataFrame) -> DataFrame:
    """(repo, total, secrets, scanners, note): the part of security() that an overview shows."""
    total = F.col("critical") + F.col("high") + F.col("medium") + F.col("low")
    note = F.when(F.col("scanned"), F.concat(F.lit("Counts by "), F.array_join("scanners", ", "), F.lit("; finding none proves nothing."))).otherwise(NOT_SCANNED)
    return security_.select("repo", total.alias("total"), "secrets", "scanners", note.alias("note"))


def install_hint(tool: Column) -> Column:
    """How a scanner that isn't there is installed. Own words."""
    return F.when(tool == "semgrep", "Install it with: pip install semgrep").when(tool == "gitleaks", "Install its binary and put it on the PATH").otherwise(F.concat(F.lit("Install "), tool, F.lit(" and put it on the PATH")))

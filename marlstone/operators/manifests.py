"""Dependency manifests to (path, package, pinned)."""

from __future__ import annotations

import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import findings_text as ft
from marlstone.operators.findings import SECRETS


def requirement_lines(files: DataFrame) -> DataFrame:
    """Of pip requirement files (path, text): comments, options, addresses are skipped; pinned means ``==``."""
    line = F.trim(F.regexp_replace("line", r"(^|\s)#.*$", ""))
    found = files.select("path", F.explode(F.split("text", r"\r?\n")).alias("line")).select("path", line.alias("line"))
    found = found.filter((F.col("line") != "") & ~F.col("line").startswith("-") & ~F.col("line").rlike(r"^(git\+|hg\+|https?://)"))
    return found.select("path", F.regexp_extract("line", r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1).alias("package"), F.contains("line", F.lit("==")).alias("pinned")).filter("package <> ''")


def package_json(files: DataFrame) -> DataFrame:
    parsed = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>")
    both = F.map_concat(F.coalesce(F.col("j.dependencies"), F.create_map().cast("map<string,string>")), F.map_filter(F.coalesce(F.col("j.devDependencies"), F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.map_contains_key(F.col("j.dependencies"), k), F.lit(False))))
    return files.select("path", parsed.alias("j")).select("path", F.explode(both).alias("package", "version")).select("path", "package", F.col("version").rlike(r"^\d").alias("pinned"))


_NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._-]*")


def _pyproject(text: str) -> list[tuple[str, bool]]:
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return []
    project = data.get("project", {})
    lines = list(project.get("dependencies", [])) + [x for group in project.get("optional-dependencies", {}).values() for x in group]
    out = [(m[0], "==" in x) for x in lines if (m := _NAME.match(x))]
    poetry = data.get("tool", {}).get("poetry", {})
    tables = [poetry.get("dependencies", {}), *(g.get("dependencies", {}) for g in poetry.get("group", {}).values())]
    for table in tables:
        for name, spec in table.items():
            if name.lower() != "python":
                version = spec.get("version", "") if isinstance(spec, dict) else spec
                out.append((name, isinstance(version, str) and version[:1].isdigit()))
    return out


def _go_mod(text: str) -> list[tuple[str, bool]]:
    out, inside = [], False
    for line in (x.split("//")[0].strip() for x in text.splitlines()):
        if inside and line == ")":
            inside = False
        elif line.startswith("require ("):
            inside = True
        elif inside and line:
            out.append((line.split()[0], True))
        elif line.startswith("require "):
            out.append((line.split()[1], True))
    return out


def _table_of(parse):
    @F.pandas_udf("array<struct<package:string,pinned:boolean>>")
    def udf(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"package": p, "pinned": x} for p, x in parse(t)])

    return udf


def nested(files: DataFrame, kind: str) -> DataFrame:
    """pyproject or go.mod files: their formats need a parser, a row at a time."""
    return files.select("path", F.explode(_table_of({"pyproject": _pyproject, "go.mod": _go_mod}[kind])("text")).alias("x")).select("path", "x.package", "x.pinned")


def dependencies(files: DataFrame) -> DataFrame:
    """Distinct packages over all manifests of files (path, text); pinned if any manifest pins it."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    pip = requirement_lines(files.filter(name.rlike(r"^requirements.*\.txt$")))
    all_ = pip.unionByName(package_json(files.filter(name == "package.json"))).unionByName(nested(files.filter(name == "pyproject.toml"), "pyproject")).unionByName(nested(files.filter(name == "go.mod"), "go.mod"))
    return all_.groupBy(F.lower("package").alias("package")).agg(F.bool_or("pinned").alias("pinned"), F.countDistinct("path").alias("n_manifests"))


_LEAK = "array<struct<File:string,StartLine:string,EndLine:string,StartColumn:string,EndColumn:string,RuleID:string,Secret:string,Match:string,Description:string>>"


def leak_report(reports: DataFrame, root: str) -> DataFrame:
    """Findings (file, line, end_line, column, end_column, rule, severity, category, source, type, message, cwe, fingerprint) of the secret scanner's reports
    (text): JSON arrays of leaks. Leaks without a file or a line that is a number are left out, as are texts that are no such array."""
    leak = reports.select(F.explode(F.from_json("text", _LEAK)).alias("x")).select("x.*")
    number = lambda name: F.col(name).try_cast("int")
    rule = F.coalesce(F.nullif(F.col("RuleID"), F.lit("")), F.lit("secret"))
    file, line = ft.normal_path(F.col("File"), root), number("StartLine")
    said = F.coalesce(F.nullif(F.col("Description"), F.lit("")), F.lit("Possible secret detected."))
    known = leak.filter(F.col("File").isNotNull() & line.isNotNull())
    return known.select(
        file.alias("file"), line.alias("line"), F.coalesce(F.nullif(number("EndLine"), F.lit(0)), line).alias("end_line"), number("StartColumn").alias("column"), number("EndColumn").alias("end_column"), rule.alias("rule"),
        F.lit("HIGH").alias("severity"), F.lit("secret").alias("category"), F.lit(SECRETS).alias("source"), ft.secret_title(rule).alias("type"), ft.scrubbed(said, F.coalesce("Secret", F.lit("")), F.coalesce("Match", F.lit(""))).alias("message"),
        F.array(F.lit("CWE-798: Use of Hard-coded Credentials")).alias("cwe"), ft.fingerprint(F.lit(SECRETS), rule, file, line).alias("fingerprint"),
    )


def string_list(value: Column) -> Column:
    """JSON text that is a string or a list of strings, as a list; anything else as none."""
    inside = F.from_json(value, "array<string>")
    one = F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(F.trim(value).startswith("["), F.filter(F.coalesce(inside, F.array().cast("array<string>")), lambda x: x.isNotNull())).when(F.trim(value).startswith('"') & one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))


def scanner_report(reports: DataFrame) -> DataFrame:
    """Findings of a scanner's JSON reports (text): malformed and ignored results are left out."""
    one = "check_id string, path string, start struct<line:int,col:int>, end struct<line:int,col:int>, extra struct<message:string,severity:string,lines:string,is_ignored:boolean,metadata:struct<title:string,severity:string,category:string,cwe:array<string>>>"
    rows = reports.select(F.explode(F.from_json("text", f"results array<struct<{', '.join(x.replace(' ', ':', 1) for x in _split_fields(one))}>>")["results"]).alias("r"))
    return rows.filter("r.check_id is not null and r.path is not null and r.start.line is not null and not coalesce(r.extra.is_ignored, false)").select("r.*")


def _split_fields(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]

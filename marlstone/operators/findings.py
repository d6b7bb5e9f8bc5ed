"""Findings: rules over lines, redaction, removal of doubles, numbering, summaries."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import findings_text as ft
from marlstone.operators.graph import first_of
from marlstone.operators.stored import settle
from marlstone.operators.text import counted

# Line rules (rule, tool severity, declared severity, category, pattern).
LINE_RULES = [
    ("generic-credential", "ERROR", "HIGH", "secret", r"(?i)(token|password|secret|api_key)\s*=\s*[\"']?[A-Za-z0-9_/+-]{8,}"),
    ("personal-email", "WARNING", None, "vulnerability", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("ip-address", "INFO", None, "vulnerability", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("payment-number", "ERROR", "CRITICAL", "secret", r"\b[0-9]{13,16}\b"),
]
#: What the scanner by the secret rules calls itself in findings.
SECRETS = "secrets"
# Public token formats.
SECRET_RULES = [
    ("aws-access-token", r"\b(AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("github-token", r"\bgh[pousr]_[A-Za-z0-9]{36}\b"),
    ("generic-api-key", r"(?i)(api[_-]?key|secret|token|password)[\"']?\s*[:=]\s*[\"'][^\"']{8,}[\"']"),
]


# What a line must hold for a rule to be worth trying.
_GUARDS = {"generic-credential": lambda x: F.contains(x, F.lit("=")), "personal-email": lambda x: F.contains(x, F.lit("@")), "ip-address": lambda x: x.rlike(r"[0-9]\."), "payment-number": lambda x: x.rlike("[0-9]{13}")}


def _hits(line: Column, source: str) -> Column:
    """The findings of one line by the line rules: struct(source, rule, severity, category, column, end_column)."""
    return F.array_compact(
        F.array(*[
            F.when(_GUARDS[r](line) & line.rlike(p), F.struct(F.lit(source).alias("source"), F.lit(r).alias("rule"), ft.severity(F.lit(t), F.lit(s)).alias("severity"), F.lit(c).alias("category"), F.lit(None).cast("int").alias("column"), F.lit(None).cast("int").alias("end_column")))
            for r, t, s, c, p in LINE_RULES
        ])
    )


def _first_secret(line: Column) -> Column:
    """The secret that the secret rules find in one line, as an array of one at most: the first, but a specific rule before a generic one."""
    found = F.array_compact(
        F.array(*[F.when(line.rlike(p), F.struct(F.lit(r.startswith("generic")).alias("generic"), F.regexp_instr(line, F.lit(p)).alias("column"), F.lit(i).alias("nth"), F.lit(r).alias("rule"), F.length(F.regexp_extract(line, p, 0)).alias("size"))) for i, (r, p) in enumerate(SECRET_RULES)])
    )
    one = lambda x: F.struct(F.lit(SECRETS).alias("source"), x["rule"].alias("rule"), F.lit("HIGH").alias("severity"), F.lit("secret").alias("category"), x["column"].alias("column"), (x["column"] + x["size"] - 1).alias("end_column"))
    return F.transform(F.slice(F.array_sort(found), 1, 1), one)


_COLUMNS = ["doc_id", "line_no", "x.rule", "x.severity", "x.category", "x.source", "x.column", "x.end_column", "line"]


def scan_lines(lines: DataFrame, source: str = "lines") -> DataFrame:
    """(doc_id, line_no, rule, severity, category, source, column, end_column, line): one finding for each line rule that a line meets."""
    return lines.select("doc_id", "line_no", "line", F.explode(_hits(F.col("line"), source)).alias("x")).select(*_COLUMNS)


def scan_secrets(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, rule, column, end_column): every place where a secret rule holds; columns from 1, both ends included."""
    patterns = [(r, re.compile(p)) for r, p in SECRET_RULES]
    kind = lines.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, rule, m.start() + 1, m.end()) for i, line in enumerate(batch["line"].to_pylist()) for rule, p in patterns for m in p.finditer(line)]
            at, rule, start, end = zip(*found, strict=True) if found else ((), (), (), ())
            own = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([own["doc_id"], own["line_no"], pa.array(rule, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["doc_id", "line_no", "rule", "column", "end_column"])

    some = lines.filter(functools.reduce(lambda a, b: a | b, [F.col("line").rlike(p) for _, p in SECRET_RULES]))
    return some.select("doc_id", "line_no", "line").mapInArrow(run, f"doc_id {kind}, line_no bigint, rule string, column int, end_column int")


def scan(lines: DataFrame, source: str = "lines") -> DataFrame:
    """What both scanners find, as merged() leaves it, settled within each line: no line is looked at again, and none is joined."""
    secret = _first_secret(F.col("line"))
    both = lines.select("doc_id", "line_no", "line", _hits(F.col("line"), source).alias("hits"), secret.alias("secret"))
    rest = F.filter("hits", lambda x: (F.size("secret") == 0) | (x["category"] != "secret"))
    return both.select("doc_id", "line_no", "line", F.explode(F.concat("secret", rest)).alias("x")).select(*_COLUMNS)


def known_secrets(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, column, end_column) of all that evidence has to mask: every place where a secret rule holds, and without columns the
    secrets of found (scan()) that no secret rule sees."""
    places = scan_secrets(lines).select("doc_id", "line_no", "column", "end_column")
    loose = found.filter((F.col("category") == "secret") & (F.col("source") != SECRETS)).select("doc_id", "line_no", F.lit(None).cast("int").alias("column"), F.lit(None).cast("int").alias("end_column"))
    return places.union(loose)


def one_per_line(secrets: DataFrame) -> DataFrame:
    """Of the secrets of a line, the first by column, but a specific rule before a generic one."""
    return first_of(secrets, ["doc_id", "line_no"], F.col("rule").startswith("generic"), F.col("column"), F.col("rule"))


def merged(findings: DataFrame) -> DataFrame:
    """Findings of both scanners: of the secret scanner's, one for each line; where it has one, the other scanner's secrets go. Vulnerabilities
    stay."""
    secrets = one_per_line(findings.filter(F.col("source") == SECRETS))
    rest = findings.filter(F.col("source") != SECRETS)
    known = rest.filter("category = 'secret'").join(secrets.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_anti")
    return secrets.unionByName(rest.filter("category <> 'secret'")).unionByName(known)


def numbered(findings: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` by (severity, file, line, source, rule), numbered SEC-001 and on after the cut; none: all, counted in ranges. Numbers
    beyond three digits keep all of them."""
    ranked = findings.withColumn("__rank", ft.severity_rank(F.col("severity")))
    order = ["__rank", "doc_id", "line_no", "source", "rule"]
    if most is None:
        found = counted(ranked, *order)
    else:
        found = ranked.orderBy(*order).limit(most).withColumn("nth", F.row_number().over(Window.orderBy(*order)))
    return found.withColumn("id", F.format_string("SEC-%03d", "nth")).drop("nth", "__rank")


def summary(findings: DataFrame) -> DataFrame:
    """(severity, n) for every severity, zero where there is none."""
    names = findings.sparkSession.createDataFrame([(s,) for s in ft.SEVERITIES], "severity string")
    return names.join(findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n")), "severity", "left").fillna(0, ["n"])


def masked(lines: DataFrame, secrets: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, line) with the secrets (doc_id, line_no, column, end_column) of each masked.

    A line's secrets may overlap: what they cover together is cut out, each stretch for one placeholder. For those without columns that the line
    has, all its string literals are.
    """
    spot = (F.col("column") >= 1) & (F.col("end_column") >= F.col("column"))
    known = secrets.groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_set(F.when(spot, F.struct(F.col("column").cast("int").alias("from"), F.col("end_column").cast("int").alias("to"))))).alias("spans"), F.coalesce(F.bool_or(~F.coalesce(spot, F.lit(False))), F.lit(False)).alias("loose"))
    wider = lambda done, x: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["from"].alias("from"), F.greatest(F.element_at(done, -1)["to"], x["to"]).alias("to"))))
    join = lambda done, x: F.when((F.size(done) > 0) & (x["from"] <= F.get(done, F.size(done) - 1)["to"] + 1), wider(done, x)).otherwise(F.concat(done, F.array(x)))
    found = lines.join(known, ["doc_id", "line_no"], "left").withColumn("spans", F.filter("spans", lambda x: x["from"] <= F.length("line")))
    found = found.withColumn("spans", F.aggregate("spans", F.array().cast("array<struct<from:int,to:int>>"), join))
    begins = F.concat(F.array(F.lit(1)), F.transform("spans", lambda x: x["to"] + 1))
    ends = F.concat(F.transform("spans", lambda x: x["from"]), F.array(F.length("line") + 1))
    cut = F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(F.col("line"), a, b - a)), ft.PLACEHOLDER)
    text = F.when(F.size("spans") > 0, cut).otherwise(F.col("line"))
    return found.select(*[c for c in lines.columns if c != "line"], F.when(F.col("loose"), ft.redact_literals(text)).otherwise(text).alias("line"))


def context_lines(findings: DataFrame, lines: DataFrame, secrets: DataFrame, around: int) -> DataFrame:
    """(doc_id, finding_line, line_no, line): the lines around each finding, their secrets masked."""
    wanted = findings.select("doc_id", F.col("line_no").alias("finding_line"), F.explode(F.sequence(F.col("line_no") - around, F.col("line_no") + around)).alias("line_no")).distinct()
    return masked(wanted.join(lines, ["doc_id", "line_no"]), secrets).select("doc_id", "finding_line", "line_no", "line")


#: Lines that an entity may have to be shown whole, and lines around a finding if not.
REGION_LINES, WINDOW_LINES = 80, 12


def regions(findings: DataFrame, lines: DataFrame, entities: DataFrame, secrets: DataFrame, most: int = REGION_LINES, around: int = WINDOW_LINES) -> DataFrame:
    """(finding columns, entity_id, type, start_line, end_line, text) of findings (doc_id, line_no, rule, ...): the innermost callable around each, or
    else class, if it has at most so many lines, or else the lines around it, with all secrets masked.

    entities: (doc_id, id, type, start_line, end_line). A finding beyond the last line has an empty text.
    """
    spans = entities.filter("type <> 'file'").select("doc_id", F.col("id").alias("entity_id"), "type", "start_line", "end_line", (F.col("type") == "class").alias("is_class"))
    keys = ["doc_id", "line_no", "rule"]
    # Only documents with findings matter. What is known of findings is joined by sorting: its size in files says little of its size in memory.
    findings = settle(findings, "flagged")
    docs = findings.select("doc_id").distinct()
    lines, spans = (x.join(docs, "doc_id", "left_semi") for x in (lines, spans))
    findings = findings.hint("merge")
    owner = innermost(findings.select(*keys).distinct(), spans).select(*keys, "entity_id", "type", F.col("start_line").alias("low"), F.col("end_line").alias("high"))
    total = lines.groupBy("doc_id").agg(F.max("line_no").alias("total"))
    fits = F.coalesce(F.col("high") - F.col("low") + 1 <= most, F.lit(False))
    start = F.greatest(F.lit(1), F.when(fits, F.col("low")).otherwise(F.col("line_no") - around))
    end = F.least(F.when(fits, F.col("high")).otherwise(F.col("line_no") + around), "total")
    found = findings.join(owner, keys, "left").join(total, "doc_id").withColumn("start_line", start.cast("long")).withColumn("end_line", F.greatest(start, end).cast("long"))
    # Read for the lines and for the rows.
    found = settle(found, "regions").hint("merge")
    wanted = found.select(*keys, F.explode(F.sequence("start_line", "end_line")).alias("at"))
    # Only lines that are shown are masked, each once.
    at = wanted.select("doc_id", F.col("at").alias("line_no")).distinct()
    rows = masked(lines.join(at, ["doc_id", "line_no"], "left_semi"), secrets).withColumnRenamed("line_no", "at")
    text = wanted.join(rows, ["doc_id", "at"]).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    shown = F.when(F.col("type").isNotNull(), F.col("type")).otherwise("module")
    return found.join(text, keys, "left").select(*findings.columns, "entity_id", shown.alias("type"), "start_line", "end_line", F.coalesce("text", F.lit("")).alias("text"))


def masked_chunks(chunks: DataFrame, secrets: DataFrame) -> DataFrame:
    """chunks (file, start_line, text, ...) with the secrets (file, line_no, column, end_column) of their lines masked. Only chunks that
    hold one are taken apart."""
    numbered_ = chunks.withColumn("__id", F.struct(*chunks.columns))
    inside = secrets.select("file", F.col("line_no").alias("__line"))
    last = F.col("start_line") + F.length("text") - F.length(F.replace("text", F.lit("\n")))
    hit = numbered_.join(inside, "file").filter("__line >= start_line").filter(F.col("__line") <= last).select("__id").distinct()
    lines = hit.select("__id", F.col("__id.file").alias("doc_id"), F.posexplode(F.split("__id.text", "\n", -1)).alias("__at", "line")).withColumn("line_no", F.col("__id.start_line") + F.col("__at"))
    done = masked(lines, secrets.withColumnRenamed("file", "doc_id"))
    text = done.groupBy("__id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    whole = numbered_.join(hit, "__id", "left_anti").select(*chunks.columns)
    return whole.union(text.select(*[F.col("text") if c == "text" else F.col(f"__id.{c}") for c in chunks.columns]))


def innermost(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, line_no, start_line, end_line): the shortest span around each finding, callables before classes."""
    inside = findings.join(spans, "doc_id").filter("line_no between start_line and end_line")
    return first_of(inside, ["doc_id", "line_no", "rule"], F.col("is_class"), F.col("end_line") - F.col("start_line"), F.col("start_line"))


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a with the first range of b (by b's start) in the same document that shares a line."""
    right = b.select("doc_id", F.col("start_line").alias("other_start"), F.col("end_line").alias("other_end"))
    both = a.join(right, "doc_id").filter("start_line <= other_end and other_start <= end_line")
    return first_of(both, ["doc_id", "start_line"], F.col("other_start"))


def apart(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that share no line with any range of b in the same document."""
    right = b.select(F.col("doc_id").alias("other"), F.col("start_line").alias("other_start"), F.col("end_line").alias("other_end"))
    return a.join(right, (F.col("doc_id") == F.col("other")) & (F.col("start_line") <= F.col("other_end")) & (F.col("other_start") <= F.col("end_line")), "left_anti")

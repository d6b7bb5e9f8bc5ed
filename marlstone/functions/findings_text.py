"""Column expressions over findings: severities, titles, redaction, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
TOOL_SEVERITY = {"ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "LOW"}
PLACEHOLDER = "[REDACTED]"
LEAST_LITERAL = 4


def severity(tool: Column, declared: Column) -> Column:
    """A valid declared severity wins; else the tool's word for it; else MEDIUM."""
    known = F.upper(F.trim(declared))
    mapped = F.create_map(*[F.lit(x) for kv in TOOL_SEVERITY.items() for x in kv])
    return F.when(known.isin(SEVERITIES), known).otherwise(F.coalesce(F.try_element_at(mapped, F.upper(tool)), F.lit("MEDIUM")))


def severity_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), name) - 1


def title_of(rule: Column, declared: Column) -> Column:
    tail = F.regexp_replace(F.element_at(F.split(rule, r"\."), -1), "[-_]+", " ")
    return F.coalesce(F.nullif(F.trim(declared), F.lit("")), F.concat(F.upper(F.substring(tail, 1, 1)), F.lower(F.substring(tail, 2, 1 << 20))))


# Fixed values.
ACRONYMS = ["aws", "gcp", "api", "jwt", "pat", "ssh", "pgp", "rsa", "dsa", "ec", "npm", "url", "oauth"]


def secret_title(rule: Column) -> Column:
    def word(w: Column) -> Column:
        return F.when(w.isin(ACRONYMS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)))

    return F.array_join(F.transform(F.split(F.lower(rule), "[-_]"), word), " ")


def secret_rule(rule: Column) -> Column:
    return F.lower(rule).rlike("secret|password|credential|token|api-?key|private-?key")


def fingerprint(source: Column, rule: Column, file: Column, line: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", source, rule, file, line.cast("string"))), 1, 16)


def redact_literals(text: Column) -> Column:
    """Quoted literals of LEAST_LITERAL characters or more become the placeholder, in their quotes."""
    return F.regexp_replace(text, F.lit(r"""(?<q>["'])(?:(?!\k<q>).){%d,}?\k<q>""" % LEAST_LITERAL), F.lit(f"$1{PLACEHOLDER}$1"))


def redact_span(line: Column, column: Column, end_column: Column, secret: Column) -> Column:
    """By value, else by the span of columns (from 1, both ends included), else every literal."""
    by_value = (F.length(secret) > 0) & F.contains(line, secret)
    by_span = (column >= 1) & (column <= F.length(line)) & (end_column >= column)
    cut = F.concat(F.substring(line, F.lit(1), (column - 1).cast("int")), F.lit(PLACEHOLDER), F.substring(line, (end_column + 1).cast("int"), F.length(line)))
    return F.when(by_value, F.replace(line, secret, F.lit(PLACEHOLDER))).when(by_span, cut).otherwise(redact_literals(line))


def normal_path(path: Column, root: str) -> Column:
    """Relative to root; a path outside comes down to its name; a leading ./ goes."""
    inside = F.substring(path, len(root) + 2, 1 << 20)
    outside = F.element_at(F.split(path, "/"), -1)
    return F.when(path.startswith(root + "/"), inside).when(path.startswith("/"), outside).otherwise(F.regexp_replace(path, r"^\./", ""))


def strip_blocks(text: Column, tag: str = "think") -> Column:
    return F.trim(F.regexp_replace(text, rf"(?s)<{tag}>.*?</{tag}>\s*", ""))


def scrubbed(text: Column, *values: Column) -> Column:
    """A message without the values, of LEAST_LITERAL characters or more, that it may quote."""
    for value in values:
        text = F.when(F.length(value) >= LEAST_LITERAL, F.replace(text, value, F.lit(PLACEHOLDER))).otherwise(text)
    return text

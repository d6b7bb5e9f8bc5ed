"""Drafts by a generator: documents, a summary, tests and explanations of impact, from requests to checked drafts.

A request is a row (request_id, system, head, closing); its evidence are rows of chunks. Evidence is packed to a
budget and numbered, prompts go to the generator in tasks, and what comes back is parsed and its citations checked
with joins. The answers are written once to the shared folder, so that no later step asks the generator again.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import findings_text as ft
from marlstone.operators import answers as checked
from marlstone.operators import evidence
from marlstone.operators.findings import masked_chunks
from marlstone.operators.knowledge import question_text
from marlstone.operators.stored import settle
from marlstone.operators.text import pack_context
from marlstone.operators.vectors import top_k

# Kind, title, file name, search questions and section headings of each document.
KINDS = [
    ("readme", "README draft", "README.md",
     ["what this project does and its purpose", "installation, setup and how to run the application", "main entry point and command line usage", "configuration and environment variables"],
     ["Overview", "Features", "Project structure", "Installation", "Usage", "Configuration", "Testing"]),
    ("architecture", "Architecture documentation", "ARCHITECTURE.md",
     ["main components and modules of the system", "how modules import and call each other", "core classes and their responsibilities", "application startup and request or data flow"],
     ["Purpose", "Components", "Dependencies between components", "Key classes and functions", "Data and control flow", "Extension points"]),
    ("developer_guide", "Developer guide", "DEVELOPER_GUIDE.md",
     ["development setup, dependencies and tooling", "how tests are written and run", "configuration files and environment variables", "where to start reading the code and important modules"],
     ["Getting started", "Repository layout", "Where to start reading", "Running tests", "Configuration", "Conventions", "Common tasks"]),
    ("api_overview", "API overview", "API.md",
     ["HTTP endpoints, routes and request handlers", "public functions and classes exported by the package", "command line commands and their arguments", "request and response models and parameters"],
     ["Scope", "Endpoints and commands", "Public classes and functions", "Parameters and return values", "Errors"]),
]
SUMMARY_QUESTION = "What does this project do, and how is it organised? Summarise it for a developer joining the team: purpose, main components, and how they fit together."
IMPACT_HEADINGS = ["What depends on it", "Likely consequences of a change", "What to check before changing it", "Tests to run"]
TEST_HEADINGS = ["Normal cases", "Edge cases", "Invalid inputs", "Error conditions"]
# Chunks that a search brings for a document's question and for the summary; characters of evidence.
DOCUMENT_CHUNKS, SUMMARY_CHUNKS, BUDGET = 6, 10, 14000
#: Turns of a conversation that are told with a question. Fixed value.
TURNS = 6

GROUNDED = "Use nothing but the facts and numbered excerpts below. Mark what they leave open as TODO. End with a list under 'Sources:', one '- <path>: lines <first>-<last>' a line."
NO_EXCERPTS = "(none found)"


def kind_table() -> Column:
    """KINDS as an array of structs (kind, title, filename, queries, headings)."""
    texts = lambda xs: F.array(*map(F.lit, xs))
    return F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(t).alias("title"), F.lit(n).alias("filename"), texts(q).alias("queries"), texts(h).alias("headings")) for k, t, n, q, h in KINDS))


def cache_key(purpose: str, *parts: Column) -> Column:
    """purpose and the first 16 hex digits of the SHA-1 of what was asked about."""
    return F.concat(F.lit(purpose + "-"), F.substring(F.sha1(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")), 1, 16))


def document_status(repositories: DataFrame, existing: DataFrame, cached: DataFrame) -> DataFrame:
    """For each repository (repo) and kind: title, a file name that no document of existing (repo, path) has,
    whether cached (repo, request_id) holds it, and the request_id."""
    offered = repositories.select("repo", F.explode(kind_table()).alias("k")).select("repo", "k.*").withColumn("request_id", F.concat(F.lit("documentation-"), F.col("kind")))
    name, parts = F.lower(F.substring_index("path", "/", -1)), r"^(.+?)(?:-(\d+))?(\.[^.]*)$"
    part = lambda k: F.regexp_extract(name, parts, k)
    named = existing.select("repo", F.concat(part(1), part(3)).alias("base"), F.coalesce(F.nullif(part(2), F.lit("")).try_cast("int"), F.lit(1)).alias("k"))
    wanted = offered.select("repo", F.lower("filename").alias("base"))
    taken = named.join(wanted, ["repo", "base"], "left_semi").groupBy("repo", "base").agg(F.collect_set("k").alias("taken"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("taken") + 1), F.col("taken")))
    numbered = F.concat(F.substring_index("filename", ".", 1), F.lit("-"), free.cast("string"), F.lit(".md"))
    joined = offered.withColumn("base", F.lower("filename")).join(taken, ["repo", "base"], "left")
    joined = joined.join(cached.select("repo", "request_id", F.lit(True).alias("hit")).distinct(), ["repo", "request_id"], "left")
    suggested = F.when(F.col("taken").isNull() | (free == 1), F.col("filename")).otherwise(numbered)
    return joined.select("repo", "request_id", "kind", "title", suggested.alias("suggested"), F.coalesce("hit", F.lit(False)).alias("cached"), "queries", "headings")


def document_requests(status: DataFrame, facts: DataFrame) -> DataFrame:
    """Requests for document_status()' rows; facts (repo, fact_sheet). One repository's requests start with its name."""
    sections = F.array_join(F.transform("headings", lambda h: F.concat(F.lit("## "), h)), "\n")
    head = F.concat(F.lit("Draft: "), "title", F.lit(" ("), "suggested", F.lit(")\nSections, in this order:\n"), sections, F.lit("\nFacts:\n"), F.coalesce("fact_sheet", F.lit("")))
    rows = status.join(facts, "repo", "left")
    return rows.select(F.concat_ws("/", "repo", "request_id").alias("request_id"), F.lit(GROUNDED).alias("system"), head.alias("head"), F.lit("Write the document.").alias("closing"))


def summary_requests(repositories: DataFrame) -> DataFrame:
    """One request for each repository (repo), for its summary from SUMMARY_CHUNKS chunks."""
    return repositories.select(F.concat("repo", F.lit("/summary")).alias("request_id"), F.lit(GROUNDED).alias("system"), F.lit("").alias("head"), F.lit(SUMMARY_QUESTION).alias("closing"))


def impact_requests(impacts: DataFrame) -> DataFrame:
    """Requests for impacts (target_id, depth, level, reasons array, affected array of ids, nearest first)."""
    sections = "\n".join(f"## {h}" for h in IMPACT_HEADINGS)
    head = F.concat(F.lit("Target: "), "target_id", F.lit("\nImpact: "), "level", F.lit(" ("), F.array_join("reasons", "; "), F.lit(")\nFound dependents: "), F.array_join(F.slice("affected", 1, 12), ", "))
    return impacts.select(cache_key("impact", F.col("target_id"), F.col("depth")).alias("request_id"), F.lit(GROUNDED).alias("system"), head.alias("head"), F.lit("Explain what a change of the target may break. Sections:\n" + sections).alias("closing"))


def test_targets(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """asked (target_id) with status: 'ok' for functions and methods, else 'unsupported' or 'unknown', and the request_id."""
    e = entities.select(F.col("id").alias("target_id"), "type", "file", "start_line", "end_line")
    status = F.when(F.col("type").isNull(), "unknown").when(F.col("type").isin("function", "method"), "ok").otherwise("unsupported")
    return asked.join(e, "target_id", "left").withColumn("status", status).withColumn("request_id", cache_key("tests", F.col("target_id")))


def test_requests(targets: DataFrame) -> DataFrame:
    """Requests for those of test_targets() that are 'ok'; conventions and the suggested file may be further columns."""
    told = [F.concat(F.lit(f"\n{label}: "), F.col(name)) for name, label in (("framework", "Framework"), ("suggested_file", "File")) if name in targets.columns]
    head = F.concat(F.lit("Target: "), "target_id", *(F.coalesce(x, F.lit("")) for x in told))
    sections = ", ".join(f"'# {h}'" for h in TEST_HEADINGS)
    closing = F.lit(f"Write one fenced Python module of tests with the comments {sections} in this order, then a line 'Assumptions:'.")
    return targets.filter("status = 'ok'").select("request_id", F.lit(GROUNDED).alias("system"), head.alias("head"), closing.alias("closing"))


def answered(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, entities: DataFrame, make_embedder: Callable[[], evidence.Embedder], make: Callable[[], evidence.Generator], model: str, history: DataFrame | None = None, secrets: DataFrame | None = None, k: int = 8, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Answers (request_id, body, n_excerpts, n_removed) to questions (request_id, question) and what backs them, as of drafted().

    Each question is embedded in a task, the k best of vectors (chunk_id, embedding) bring their chunks (chunk_id, file, symbol, start_line, end_line, text),
    and these are packed, numbered and shown. history (request_id, turn, role, text): the last TURNS turns are told, too. A question for which nothing is
    found is not asked: its answer says so. An answer that is nothing but citations that nothing backs stays as it was said.
    """
    asked = questions.select(F.col("request_id").alias("chunk_id"), question_text(F.col("question"), model).alias("text"))
    embedded = settle(evidence.embedded(asked, make_embedder).withColumnRenamed("chunk_id", "vec_id"), "questions")
    hits = top_k(vectors.withColumnRenamed("chunk_id", "vec_id"), embedded, k)
    found = hits.select(F.col("query_id").alias("request_id"), F.col("rank").cast("long").alias("ord"), F.col("vec_id").alias("chunk_id")).join(chunks.select("chunk_id", "file", "symbol", "start_line", "end_line", "text"), "chunk_id")
    found = settle(found, "retrieved")
    told = questions.select("request_id", "question", F.lit("").alias("before"))
    if history is not None:
        nth = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("turn")))
        last = history.withColumn("k", nth).filter(F.col("k") <= TURNS).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("said")))).alias("said"))
        told = told.join(last, "request_id", "left").withColumn("before", F.coalesce(F.array_join("said.said", "\n"), F.lit("")))
    some = told.join(found.select("request_id").distinct(), "request_id", "left_semi")
    requests = some.select("request_id", F.lit(GROUNDED).alias("system"), F.col("before").alias("head"), F.concat(F.lit("Question: "), "question").alias("closing"))
    out, good = drafted(requests, found, entities, make, budget=budget, secrets=secrets)
    none = told.join(found.select("request_id").distinct(), "request_id", "left_anti").select("request_id", F.lit(evidence.NO_EVIDENCE).alias("body"), F.lit(0).alias("n_excerpts"), F.lit(0).cast("long").alias("n_removed"))
    return out.select("request_id", "body", "n_excerpts", "n_removed").union(none), good


def drafted(requests: DataFrame, chunks: DataFrame, entities: DataFrame, make: Callable[[], evidence.Generator], cached: DataFrame | None = None, budget: int = BUDGET, secrets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Drafts (request_id, body, n_excerpts, n_removed, cached) and their citations (request_id, nth, file, start_line, end_line, symbol, chunk_id).

    chunks: (request_id, ord, chunk_id, file, symbol, start_line, end_line, text). Requests that cached
    (request_id, body) holds aren't asked again and have its body, no new citations and null counts; pass none to
    refresh. A task makes its generator once. secrets (file, line_no, column, end_column) are masked in what is
    sent. Requests without chunks are asked with NO_EXCERPTS in their place. A
    citation that nothing shown backs is cut out of the body and counted in n_removed.
    """
    todo = requests if cached is None else requests.join(cached, "request_id", "left_anti")
    own = chunks.join(todo, "request_id", "left_semi")
    if secrets is not None:
        own = masked_chunks(own, secrets)
    kept = pack_context(own, "request_id", "ord", budget).join(own, ["request_id", "ord", "chunk_id"])
    kept = kept.withColumn("text", F.when(F.col("truncated"), F.substring("text", 1, budget)).otherwise(F.col("text")))
    number = F.row_number().over(Window.partitionBy("request_id").orderBy("ord", "chunk_id"))
    shown = kept.withColumn("number", number)
    block = evidence.context_block(F.col("number"), F.col("file"), F.col("symbol"), F.col("start_line"), F.col("end_line"), F.col("text"))
    blocks = shown.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("number", block.alias("block")))).alias("blocks"))
    excerpts = F.coalesce(F.array_join("blocks.block", "\n\n"), F.lit(NO_EXCERPTS))
    prompt = F.concat("head", F.lit("\n\nExcerpts:\n"), excerpts, F.lit("\n\n"), "closing")
    asked = todo.join(blocks, "request_id", "left").select("request_id", "system", prompt.alias("prompt"), F.coalesce(F.size("blocks"), F.lit(0)).alias("n_excerpts"))

    def ask(batches):
        generator = make()
        for rows in batches:
            said = [generator.generate(p, s) for p, s in zip(rows["prompt"], rows["system"], strict=True)]
            yield pd.DataFrame({"request_id": rows["request_id"], "answer": said, "n_excerpts": rows["n_excerpts"]})

    answers = settle(asked.mapInPandas(ask, "request_id string, answer string, n_excerpts int"), "drafts")
    said = answers.select(F.col("request_id").alias("answer_id"), ft.strip_blocks(F.col("answer")).alias("text"))
    seen = shown.select(F.col("request_id").alias("answer_id"), F.col("number").alias("ord"), "chunk_id", "file", "symbol", "start_line", "end_line")
    bodies, good = checked.validated(said, seen, entities)
    good = good.withColumnRenamed("answer_id", "request_id")
    bodies = bodies.withColumnRenamed("answer_id", "request_id").withColumnRenamed("body", "checked")
    said_ = answers.select("request_id", F.trim(ft.strip_blocks(F.col("answer"))).alias("said"), "n_excerpts")
    out = said_.join(bodies, "request_id").select("request_id", F.coalesce(F.nullif("checked", F.lit("")), "said").alias("body"), "n_excerpts", "n_removed", F.lit(False).alias("cached"))
    if cached is not None:
        old = cached.join(requests, "request_id", "left_semi")
        out = out.unionByName(old.select("request_id", "body", F.lit(None).cast("int").alias("n_excerpts"), F.lit(None).cast("bigint").alias("n_removed"), F.lit(True).alias("cached")))
    return out, good

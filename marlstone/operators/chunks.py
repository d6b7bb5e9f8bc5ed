"""From files and the spans of their definitions to chunks: text that is exactly the lines it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import paths
from marlstone.operators import text as lines_of
from marlstone.operators.stored import settle

# Names that are no use to a search, and languages that are chunked whole.
LOCK_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock", "cargo.lock", "go.sum"]
CONFIG_LANGUAGES = ["json", "yaml", "toml", "config", "docker", "make"]
PROSE_LANGUAGES = ["restructuredtext", "text"]

MOST_CHARS, OVERLAP_LINES = 2000, 5
CALLABLES = ["function", "method"]
#: White space by Unicode's tables; what a line without anything else is made of.
SPACE = r"\t-\r\x1C-\x20\x{85}\p{Z}"
SOME = rf"[^{SPACE}]"
#: Doublings of the distance to an ancestor that are looked at: more than any nesting has.
MOST_DOUBLINGS = 16

_SPAN = "struct<start_line:bigint,end_line:bigint,type:string,symbol:string,entity_id:string>"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def kind_of(path: Column) -> Column:
    """How a file is chunked: python, markdown, config, documentation, module; null for lock files and unknown languages."""
    language, name = paths.language_of(path), F.lower(paths.name_of(path))
    return (
        F.when(language.isNull(), None)
        .when(language.isin("python", "markdown"), language)
        .when(name.isin(LOCK_FILES), None)
        .when(paths.is_project_file(path) | language.isin(CONFIG_LANGUAGES), "config")
        .when(language.isin(PROSE_LANGUAGES), "documentation")
        .otherwise("module")
    )


def nested_in_callable(entities: DataFrame) -> DataFrame:
    """entities (id, parent, type, ...) with nested: whether a function or method is among the things around them.

    Each round looks twice as far up; what lies around something unknown isn't looked at. Rounds end when nothing is left to look
    at; each one's table is written to the shared folder.
    """
    known = entities.select("id", F.col("parent").alias("at"), F.col("type").isin(CALLABLES).alias("callable"))
    above = known.select(F.col("id").alias("at"), F.col("callable").alias("hit"))
    step = known.select("id", "at").join(above, "at", "left").select("id", F.when(F.col("hit").isNotNull(), F.col("at")).alias("at"), F.coalesce("hit", F.lit(False)).alias("hit"))
    for _ in range(MOST_DOUBLINGS):
        step = settle(step, "ancestors")
        if step.filter("at is not null and not hit").isEmpty():
            break
        further = step.select(F.col("id").alias("at"), F.col("at").alias("beyond"), F.col("hit").alias("more"))
        step = step.join(further, "at", "left").select("id", F.col("beyond").alias("at"), (F.col("hit") | F.coalesce("more", F.lit(False))).alias("hit"))
    return entities.join(step.select("id", F.col("hit").alias("nested")), "id")


def uncovered(owners: DataFrame, children: DataFrame) -> DataFrame:
    """Of each owner (file, id, start_line, end_line, ...), the stretches that no child (file, parent, start_line, end_line) covers.

    A sweep over the children by start: what lies between the furthest end so far and the next start is left.
    """
    inside = owners.select("file", F.col("id").alias("parent"), F.col("start_line").alias("low"), F.col("end_line").alias("high"))
    parts = children.select("file", "parent", "start_line", "end_line").join(inside, ["file", "parent"])
    parts = parts.select("file", "parent", "low", F.greatest("start_line", "low").alias("start"), F.least("end_line", "high").alias("end")).filter("start <= end")
    last = inside.select("file", "parent", "low", (F.col("high") + 1).alias("start"), (F.col("high") + 1).alias("end"))
    before = Window.partitionBy("file", "parent").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    swept = parts.union(last).withColumn("from", F.coalesce(F.max("end").over(before) + 1, F.col("low"))).filter("from < start")
    gaps = swept.select("file", F.col("parent").alias("id"), F.col("from").alias("start_line"), (F.col("start") - 1).alias("end_line"))
    return gaps.join(owners.drop("start_line", "end_line"), ["file", "id"])


def python_spans(files: DataFrame, entities: DataFrame) -> DataFrame:
    """(file, spans) of Python files (file, n_lines): callables whole, classes without their members, what stands at the top level.

    Spans are by line; of those that start alike, the file's own come last, then outer ones before inner ones.
    """
    code = entities.filter("type <> 'file'").select("file", "id", "parent", "type", "start_line", "end_line").join(files.select("file"), "file", "left_semi")
    code = settle(nested_in_callable(settle(code, "entities")), "nested")
    symbol = F.when(F.contains("id", F.lit("::")), F.expr("substr(id, instr(id, '::') + 2)")).otherwise(F.col("id"))
    named = code.filter("not nested").select("file", "id", "type", symbol.alias("symbol"), "start_line", "end_line", F.col("start_line").alias("own"), F.col("end_line").alias("own_end"), F.lit(0).alias("late"))
    whole = files.select("file", F.col("file").alias("id"), F.lit("module").alias("type"), F.lit(None).cast("string").alias("symbol"), F.lit(1).cast("long").alias("start_line"), F.col("n_lines").alias("end_line"), F.lit(1).cast("long").alias("own"), F.col("n_lines").alias("own_end"), F.lit(1).alias("late"))
    rest = uncovered(named.filter("type = 'class'").union(whole), code)
    order = ["start_line", "late", "own", "backwards", "id"]
    all_ = named.filter(F.col("type").isin(CALLABLES)).unionByName(rest).withColumn("backwards", -F.col("own_end"))
    item = F.struct(*order, "end_line", "type", "symbol")
    plain = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["start_line"].alias("start_line"), x["end_line"].alias("end_line"), x["type"].alias("type"), x["symbol"].alias("symbol"), x["id"].alias("entity_id")))
    return all_.groupBy("file").agg(plain.cast(f"array<{_SPAN}>").alias("spans"))


def heading_spans(lines: Column, file: Column) -> Column:
    """From each heading to the line before the next; before the first, a span without a symbol."""
    found = F.transform(lines, lambda x, i: F.struct((i + 1).cast("long").alias("start_line"), F.when(x.rlike(r"(?d)^#{1,6}\s+.+"), stripped(F.regexp_extract(x, r"(?d)^#{1,6}\s+(.+)", 1))).alias("symbol")))
    heads = F.filter(found, lambda x: x["symbol"].isNotNull())
    preamble = F.array(F.struct(F.lit(1).cast("long").alias("start_line"), F.lit(None).cast("string").alias("symbol")))
    heads = F.when(F.coalesce(F.get(heads, F.lit(0))["start_line"] == 1, F.lit(False)), heads).otherwise(F.concat(preamble, heads))
    return F.transform(heads, lambda x, i: F.struct(x["start_line"].alias("start_line"), (F.coalesce(F.get(heads, i + 1)["start_line"], F.size(lines).cast("long") + 1) - 1).alias("end_line"), F.lit("documentation").alias("type"), x["symbol"].alias("symbol"), file.alias("entity_id"))).cast(f"array<{_SPAN}>")


def build_chunks(files: DataFrame, entities: DataFrame, most_chars: int = MOST_CHARS, overlap: int = OVERLAP_LINES) -> DataFrame:
    """(chunk_id, file, symbol, entity_id, type, start_line, end_line, part, text) of files (file, text) with entities (file, id, parent,
    type, start_line, end_line).

    Python files give a chunk for each callable that isn't nested in another, and the stretches that are left of classes and of the
    file; Markdown files one for each section; other files one. Blank stretches are left out. Chunks beyond most_chars are cut at
    line ends (part from 1, else null) and numbered by file and line. Files without text or of no known language give none. A file's lines
    are one value.
    """
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n", -1)
    known = files.select("file", kind_of(F.col("file")).alias("kind"), lines.alias("lines")).filter("kind is not null and lines is not null")
    code = known.filter("kind = 'python'").select("file", "kind", "lines", F.size("lines").cast("long").alias("n_lines"))
    code = code.join(python_spans(code.select("file", "n_lines"), entities), "file").select("file", "kind", "lines", "spans")
    whole = F.array(F.struct(F.lit(1).cast("long").alias("start_line"), F.size("lines").cast("long").alias("end_line"), F.col("kind").alias("type"), F.lit(None).cast("string").alias("symbol"), F.col("file").alias("entity_id"))).cast(f"array<{_SPAN}>")
    rest = known.filter("kind <> 'python'").withColumn("spans", F.when(F.col("kind") == "markdown", heading_spans(F.col("lines"), F.col("file"))).otherwise(whole))
    own = lambda s: F.slice("lines", s["start_line"].cast("int"), (s["end_line"] - s["start_line"] + 1).cast("int"))
    texts = F.transform("spans", lambda s, i: F.struct(i.alias("ord"), s.alias("s"), F.array_join(own(s), "\n").alias("text"), (s["type"].isin(CALLABLES) | F.exists(own(s), lambda x: x.rlike(SOME))).alias("some")))
    chunks = code.union(rest).select("file", F.explode(F.filter(texts, lambda x: x["some"])).alias("x"))
    chunks = chunks.select("file", "x.ord", "x.s.symbol", "x.s.entity_id", "x.s.type", "x.s.start_line", "x.s.end_line", "x.text")
    # Read for short ones, for long ones, and to find the ranges of numbers.
    parts = lines_of.numbered(lines_of.split_oversized(settle(chunks, "chunks"), most_chars, overlap), "file", "ord", "part")
    return parts.select("chunk_id", "file", "symbol", "entity_id", "type", "start_line", "end_line", "part", "text")


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """(type, n, n_files, n_parts) by type of chunk, and a line for all of them with type null."""
    counted = chunks.rollup("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("n_files"), F.count("part").alias("n_parts"))
    return counted.select("type", "n", "n_files", "n_parts")

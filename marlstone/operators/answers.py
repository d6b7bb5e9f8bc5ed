"""Answers of a model against what it was shown: citations with their places in the text, the text without those that nothing
backs, and the sections of answers that hold code."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.chunks import SPACE, stripped
from marlstone.operators.graph import first_of
from marlstone.operators.stored import settle

# How a citation is spelled (groups: file, symbol, then first and last line in either spelling), what heads a list of
# sources, a section of side effects or assumptions, and what is code, a test, or a kind of test.
_PATH = r"([A-Za-z0-9_.\-]+(?:/[A-Za-z0-9_.\-]+)*\.[A-Za-z0-9]{1,10})(?:::([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*))?"
_LINES = r"(?:\s*[:,]?\s*\(?\s*(?:lines?\s*|L)(\d+)(?:\s*(?:-|–|—|to)\s*L?(\d+))?\s*\)?|:(\d+)(?:\s*[-–—]\s*(\d+))?)"
_CITATION, _BARE = re.compile(_PATH + _LINES), re.compile(_PATH)
_SOURCES_LINE = re.compile(r"(?im)^\s*\**\s*sources?\s*:?\s*\**\s*:?\s*$")
_SOURCES_START = re.compile(r"(?im)^\s*\**\s*sources?\s*:\s*\**")
SIDE_EFFECTS = r"(?imd)^\s*\**\s*(?:potential\s+)?side[ -]effects?\s*:?\s*\**\s*:?\s*$"
ASSUMPTIONS = r"(?imd)^\s*\**\s*assumptions?\s*\**\s*:[ \t]*\**[ \t]*"
FENCE = r"(?sU)```[\w+-]*\n(.*?)```"
TEST = r"(?U)^\s*(?:async\s+)?def\s+(test_\w+)"
CATEGORIES = [("normal", "Normal cases", ["normal"]), ("edge", "Edge cases", ["edge"]), ("invalid_input", "Invalid inputs", ["invalid"]), ("error_conditions", "Error conditions", ["error", "exception", "raises", "fail"])]

#: Lines beyond are lines that no chunk has.
_FAR = 1 << 62


def pieces(text: Column, pattern: str) -> Column:
    """struct(between, found): what a pattern finds in a text, and the text around it, one more."""
    return F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"))


def _split_sources(text: str) -> tuple[str, str]:
    """An answer's body and list of sources: cut at the last line that is a heading of sources, else at the last that starts as one."""
    marks = list(_SOURCES_LINE.finditer(text)) or list(_SOURCES_START.finditer(text))
    return (text[: marks[-1].start()].rstrip(), text[marks[-1].end() :].strip()) if marks else (text.strip(), "")


def _reference(part: int, m: re.Match) -> dict:
    file, symbol, *lines = (*m.groups(), None, None, None, None)[:6]
    first = lines[0] or lines[2]
    ends = sorted((min(int(first), _FAR), min(int(lines[1] or lines[3] or 0), _FAR) or min(int(first), _FAR))) if first else (None, None)
    return {"part": part, "from": m.start(), "to": m.end(), "file": file, "symbol": symbol, "start_line": ends[0], "end_line": ends[1]}


def _parsed(text: str) -> tuple[str, list[dict]]:
    body, listed = _split_sources(text)
    lined = [_reference(1, m) for m in _CITATION.finditer(listed)]
    bare = [_reference(1, m) for m in _BARE.finditer(listed) if not any(x["from"] <= m.start() < x["to"] for x in lined)]
    return body, [_reference(0, m) for m in _CITATION.finditer(body)] + sorted(lined + bare, key=lambda x: x["from"])


def parsed_answers(answers: DataFrame) -> DataFrame:
    """answers (answer_id, text) as (answer_id, body, refs): the body without the list of sources, and the citations with their places in
    characters, those with lines of the body (part 0), then those of the list (part 1), there also bare paths outside of others."""
    kind = answers.schema["answer_id"].dataType.simpleString()
    ref = pa.struct([("part", pa.int32()), ("from", pa.int32()), ("to", pa.int32()), ("file", pa.string()), ("symbol", pa.string()), ("start_line", pa.int64()), ("end_line", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_parsed(t or "") for t in batch["text"].to_pylist()]
            bodies = pa.array([None if t is None else b for (b, _), t in zip(found, batch["text"].to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch["answer_id"], bodies, pa.array([r for _, r in found], pa.list_(ref))], names=["answer_id", "body", "refs"])

    form = f"answer_id {kind}, body string, refs array<struct<part:int,`from`:int,`to`:int,file:string,symbol:string,start_line:bigint,end_line:bigint>>"
    return answers.select("answer_id", "text").mapInArrow(run, form)


def references(parsed: DataFrame) -> DataFrame:
    """(answer_id, nth, part, from, to, file, symbol, start_line, end_line) of parsed_answers(), in the order of the text."""
    return parsed.select("answer_id", F.posexplode("refs").alias("nth", "r")).select("answer_id", "nth", "r.*")


def backed(found: DataFrame, shown: DataFrame, entities: DataFrame) -> DataFrame:
    """references() with the chunk_id of what backs them (null: nothing does) and their lines within it.

    shown (answer_id, ord, chunk_id, file, symbol, start_line, end_line) are the chunks that the model saw; a reference needs one of
    its file, the first that shares a line, and a symbol, if it names one, that entities (file, id, type) have in that file.
    """
    seen = shown.select("answer_id", "file", "ord", "chunk_id", F.col("symbol").alias("own"), F.col("start_line").alias("low"), F.col("end_line").alias("high"))
    keys = ["answer_id", "nth"]
    hit = found.join(seen, ["answer_id", "file"]).filter("start_line is null or (low <= end_line and start_line <= high)")
    hit = first_of(hit, keys, F.col("ord"))
    named = entities.filter("type <> 'file'").select("file", F.expr("substr(id, instr(id, '::') + 2)").alias("symbol")).distinct()
    good = hit.filter("symbol is null").unionByName(hit.join(named, ["file", "symbol"], "left_semi").select(hit.columns))
    lined = F.col("start_line").isNotNull()
    good = good.select(*keys, "chunk_id", F.when(lined, F.greatest("start_line", "low")).alias("shown_start"), F.when(lined, F.least("end_line", "high")).alias("shown_end"), F.when(lined, F.coalesce("symbol", "own")).otherwise(F.col("symbol")).alias("shown_symbol"))
    return found.join(good, keys, "left")


def tidy(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, r"\(\s*\)", ""), r"[ \t]{2,}", " ")
    return stripped(F.regexp_replace(out, r" +([,.;:])", "$1"))


def validated(answers: DataFrame, shown: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers (answer_id, body, n_removed) without their list of sources and without citations that nothing backs, and the sources
    (answer_id, nth, file, start_line, end_line, symbol, chunk_id) that are left, each once, in the order of the text.

    An answer_id is one row. What is cut out leaves no empty parentheses or doubled spaces behind; bad references are counted, not mended. An
    answer's citations are gathered in one value.
    """
    parsed = settle(parsed_answers(answers), "answers")
    found = backed(references(parsed), shown, entities)
    cut = F.when((F.col("part") == 0) & F.col("chunk_id").isNull(), F.struct("from", "to"))
    marks = found.groupBy("answer_id").agg(F.count_if(F.col("chunk_id").isNull()).alias("n_removed"), F.array_sort(F.collect_list(cut)).alias("cuts"))
    cuts = F.coalesce("cuts", F.array().cast("array<struct<from:int,to:int>>"))
    begins, ends = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda x: x["to"])), F.concat(F.transform(cuts, lambda x: x["from"]), F.array(F.length("body")))
    rest = F.zip_with(begins, ends, lambda a, b: F.substring(F.col("body"), a + 1, b - a))
    out = parsed.join(marks, "answer_id", "left").select("answer_id", F.when(F.col("body").isNotNull(), tidy(F.array_join(rest, ""))).alias("body"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"))
    good = found.filter("chunk_id is not null").select("answer_id", "nth", "file", F.col("shown_start").alias("start_line"), F.col("shown_end").alias("end_line"), F.col("shown_symbol").alias("symbol"), "chunk_id")
    once = first_of(good, ["answer_id", "file", "start_line", "end_line", "symbol"], F.col("nth"))
    number = F.row_number().over(Window.partitionBy("answer_id").orderBy("nth"))
    return out, once.select("answer_id", number.alias("nth"), "file", "start_line", "end_line", "symbol", "chunk_id")


def _at_first(text: Column, pattern: str) -> Column:
    """struct(before, after) of the first place of a pattern; null without."""
    x = pieces(text, pattern)
    before, mark = x["between"][0], x["found"][0]
    after = F.substring(text, F.length(before) + F.length(mark) + 1, F.length(text))
    return F.when(F.size(x["found"]) > 0, F.struct(stripped(before).alias("before"), stripped(after).alias("after")))


def code_answer(text: Column, heading: str, rest_counts: bool) -> Column:
    """struct(explanation, code, section) of an answer: its first fenced code, what is said before, and the section under a heading
    before or after the code. rest_counts: without that heading, all that follows the code is the section."""
    x = pieces(text, FENCE)
    fenced = F.size(x["found"]) > 0
    before = F.when(fenced, stripped(x["between"][0])).otherwise(text)
    after = stripped(F.substring(text, F.length(x["between"][0]) + F.length(F.get(x["found"], F.lit(0))) + 1, F.length(text)))
    code = F.when(fenced, F.regexp_replace(F.regexp_extract(text, FENCE, 1), r"\n+\z", "")).otherwise(F.lit(""))
    early, late = _at_first(before, heading), _at_first(after, heading)
    late = F.coalesce(late["after"], after if rest_counts else F.lit(""))
    own = F.coalesce(early["after"], F.lit(""))
    section = F.when(fenced, stripped(F.concat(own, F.lit("\n"), late))).otherwise(own)
    return F.struct(stripped(F.coalesce(early["before"], before)).alias("explanation"), code.alias("code"), section.alias("section"))


def fix_answers(answers: DataFrame) -> DataFrame:
    """(answer_id, explanation, code, side_effects) of answers (answer_id, text) that propose a fix."""
    x = answers.select("answer_id", code_answer(F.col("text"), SIDE_EFFECTS, True).alias("x"))
    return x.select("answer_id", "x.explanation", "x.code", F.col("x.section").alias("side_effects"))


def test_answers(answers: DataFrame) -> DataFrame:
    """(answer_id, explanation, code, assumptions) of answers (answer_id, text) that propose tests; assumptions of none are none."""
    x = answers.select("answer_id", code_answer(F.col("text"), ASSUMPTIONS, False).alias("x"))
    none = F.lower(F.regexp_replace("x.section", r"\.+$", "")) == "none"
    return x.select("answer_id", "x.explanation", "x.code", F.when(none, "").otherwise(F.col("x.section")).alias("assumptions"))


def test_categories(codes: DataFrame) -> DataFrame:
    """(answer_id, ord, name, label, covered, tests) for each kind of test, of codes (answer_id, code).

    A comment line with a kind's word heads the lines up to the next such line; a kind has the tests under its headings, or, if there are none,
    those with one of its words in their names. tests are in the order of the code.
    """
    words = [w for _, _, own in CATEGORIES for w in own]
    has = lambda x, own: F.greatest(*[F.instr(x, w) > 0 for w in own]) if len(own) > 1 else F.instr(x, own[0]) > 0
    line, low = stripped(F.col("line")), F.lower(stripped(F.col("line")))
    lines = codes.filter("code <> ''").select("answer_id", F.posexplode(F.split("code", "\n", -1)).alias("at", "line"))
    head = F.when(line.startswith("#") & has(low, words), low)
    in_order = Window.partitionBy("answer_id").orderBy("at")
    tests = lines.withColumn("head", F.last(head, ignorenulls=True).over(in_order)).withColumn("test", F.when(head.isNull(), F.nullif(F.regexp_extract("line", TEST, 1), F.lit(""))))
    tests = tests.filter("test is not null").select("answer_id", "at", "test", F.coalesce("head", F.lit("")).alias("head"))
    kinds = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.lit(label).alias("label"), has(F.col("head"), own).alias("under"), has(F.lower("test"), own).alias("named")) for i, (n, label, own) in enumerate(CATEGORIES)])
    each = tests.select("answer_id", "at", "test", F.explode(kinds).alias("k")).select("answer_id", "at", "test", "k.*")
    listed = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(F.col(flag), F.struct("at", "test")))), lambda x: x["test"])
    found = each.groupBy("answer_id", "ord").agg(listed("under").alias("under"), listed("named").alias("named"))
    every = codes.select("answer_id", F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.lit(label).alias("label")) for i, (n, label, _) in enumerate(CATEGORIES)])).alias("k")).select("answer_id", "k.*")
    tests = F.coalesce(F.when(F.size("under") > 0, F.col("under")).otherwise(F.col("named")), F.array().cast("array<string>"))
    return every.join(found, ["answer_id", "ord"], "left").select("answer_id", "ord", "name", "label", (F.size(tests) > 0).alias("covered"), tests.alias("tests"))

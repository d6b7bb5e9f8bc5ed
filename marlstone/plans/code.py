"""Queries of source repositories: chunks, answers, masked regions, guides, over the driver tables in these roles.

documents are files: the path's name follows from doc_id, definitions from line numbers, so that the operators run on all of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import findings_text as ft
from marlstone.functions import paths
from marlstone.operators import analysis, manifests
from marlstone.operators import answers as an
from marlstone.operators import chunks as ch
from marlstone.operators import excerpts as xc
from marlstone.operators import findings as fi
from marlstone.operators import guide as gd
from marlstone.operators import health as he
from marlstone.operators import knowledge as kn
from marlstone.operators.stored import settle
from marlstone.operators.views import lines as lines_of
from marlstone.operators.views import table
from marlstone.plans.content import DEDUPED_SQL, MASK_SQL, split_sql

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


#: Names by doc_id % 16.
_NAMES = ["m{}.py", "test_m{}.py", "core{}.py", "__main__.py", "user_service{}.py", "page{}.md", "package-lock.json", "data{}.json", "note{}.txt", "lib{}.go", "blob{}.dat", "requirements.txt", "login{}.py", "db{}.py", "README.md", "conf{}.toml"]


def files(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, file, text): documents in folders of their source; some lines of Markdown files are headings."""
    name = F.replace(F.get(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % len(_NAMES)).cast("int")), F.lit("{}"), F.col("doc_id").cast("string"))
    path = F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit("/"), name)
    return table(spark, d, "documents").select("doc_id", path.alias("file"), F.when(path.endswith(".md"), F.replace("text", F.lit("\nE"), F.lit("\n## E"))).otherwise(F.col("text")).alias("text"))


#: Definitions of a block of ten lines: (odd, name, parent, type, first line, last line) from the block's start.
_DEFINITIONS = [
    (0, "C", "", "class", 2, 8), (0, "C.m", "C", "method", 4, 5), (0, "C.m.g", "C.m", "function", 5, 5), (0, "C.N", "C", "class", 6, 8), (0, "C.N.k", "C.N", "method", 7, 7),
    (1, "f", "", "function", 2, 8), (1, "f.H", "f", "class", 4, 6), (1, "f.H.h", "f.H", "method", 5, 5),
]


def entities(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, file, id, parent, type, name, start_line, end_line) of the files whose name ends in .py."""
    f = files(spark, d).filter("file like '%.py'")
    n = F.size(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n", -1))
    blocks = f.select("doc_id", "file", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 10).cast("int"))).alias("b"))
    tag = F.col("b").cast("string")
    # The first name of a block carries its number.
    qualified = lambda x: F.concat(F.lit(x[:1]), tag, F.lit(x[1:])) if x else F.lit(None)
    each = F.array(*[F.struct(F.lit(odd).alias("odd"), qualified(x).alias("q"), qualified(p).alias("p"), F.lit(t).alias("type"), F.lit(a).alias("a"), F.lit(z).alias("z")) for odd, x, p, t, a, z in _DEFINITIONS])
    rows = blocks.select("doc_id", "file", "n", "b", F.explode(each).alias("x")).filter("x.odd = b % 2 and 10 * b + x.a <= n")
    return rows.select(
        "doc_id", "file", F.concat("file", F.lit("::"), "x.q").alias("id"), F.when(F.col("x.p").isNull(), F.col("file")).otherwise(F.concat("file", F.lit("::"), "x.p")).alias("parent"), "x.type", F.substring_index("x.q", ".", -1).alias("name"),
        (10 * F.col("b") + F.col("x.a")).cast("long").alias("start_line"), F.least(10 * F.col("b") + F.col("x.z"), "n").cast("long").alias("end_line"),
    )


_FILES_SQL = """files AS (SELECT doc_id, source || '/d' || doc_id || '/' || CASE doc_id % 16 WHEN 0 THEN 'm' || doc_id || '.py' WHEN 1 THEN 'test_m' || doc_id || '.py' WHEN 2 THEN 'core' || doc_id || '.py' WHEN 3 THEN '__main__.py'
      WHEN 4 THEN 'user_service' || doc_id || '.py' WHEN 5 THEN 'page' || doc_id || '.md' WHEN 6 THEN 'package-lock.json' WHEN 7 THEN 'data' || doc_id || '.json' WHEN 8 THEN 'note' || doc_id || '.txt' WHEN 9 THEN 'lib' || doc_id || '.go'
      WHEN 10 THEN 'blob' || doc_id || '.dat' WHEN 11 THEN 'requirements.txt' WHEN 12 THEN 'login' || doc_id || '.py' WHEN 13 THEN 'db' || doc_id || '.py' WHEN 14 THEN 'README.md' ELSE 'conf' || doc_id || '.toml' END AS file,
      CASE WHEN doc_id % 16 IN (5, 14) THEN replace(text, chr(10) || 'E', chr(10) || '## E') ELSE text END AS text FROM documents),
    split AS (SELECT doc_id, file, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM files),
    lines AS (SELECT doc_id, file, i, i AS line_no, l[i] AS line FROM split, LATERAL (SELECT unnest(range(1, len(split.l) + 1)) AS i)),
    blocks AS (SELECT doc_id, file, len(l) AS n, b FROM split, LATERAL (SELECT unnest(range(0, (len(split.l) - 1) // 10 + 1)) AS b) WHERE file LIKE '%.py'),
    defs AS (SELECT doc_id, file, n, 10 * b + a AS start_line, least(10 * b + z, n) AS end_line, type, q, p FROM blocks, LATERAL (SELECT * FROM (VALUES (0, 'C' || b, NULL, 'class', 2, 8), (0, 'C' || b || '.m', 'C' || b, 'method', 4, 5),
      (0, 'C' || b || '.m.g', 'C' || b || '.m', 'function', 5, 5), (0, 'C' || b || '.N', 'C' || b, 'class', 6, 8), (0, 'C' || b || '.N.k', 'C' || b || '.N', 'method', 7, 7), (1, 'f' || b, NULL, 'function', 2, 8),
      (1, 'f' || b || '.H', 'f' || b, 'class', 4, 6), (1, 'f' || b || '.H.h', 'f' || b || '.H', 'method', 5, 5)) v(odd, q, p, type, a, z) WHERE odd = b % 2 AND 10 * b + a <= n)),
    ents AS (SELECT doc_id, file, file || '::' || q AS id, q, coalesce(file || '::' || p, file) AS parent, type, start_line, end_line FROM defs)"""

#: Line by line: which lines of an owner no member covers, and runs of those.
_CHUNK_SQL = _FILES_SQL + """,
    top AS (SELECT * FROM ents e WHERE NOT EXISTS (SELECT 1 FROM ents o WHERE o.doc_id = e.doc_id AND o.type IN ('function', 'method') AND starts_with(e.id, o.id || '.'))),
    owners AS (SELECT doc_id, file, id, q, type, start_line, end_line FROM top WHERE type = 'class' UNION ALL SELECT doc_id, file, file, NULL, 'module', 1, len(l) FROM split WHERE file LIKE '%.py'),
    bare AS (SELECT o.doc_id, o.id, o.file, o.q, o.type, lines.i, line FROM owners o JOIN lines ON lines.doc_id = o.doc_id AND lines.i BETWEEN o.start_line AND o.end_line
      WHERE NOT EXISTS (SELECT 1 FROM ents c WHERE c.doc_id = o.doc_id AND c.parent = o.id AND lines.i BETWEEN c.start_line AND c.end_line)),
    runs AS (SELECT doc_id, file, id, q, type, min(i) AS start_line, max(i) AS end_line FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, id ORDER BY i) AS g FROM bare) t GROUP BY doc_id, file, id, q, type, g HAVING bool_or(regexp_matches(line, '\\S'))),
    heads AS (SELECT doc_id, file, i, regexp_extract(line, '^#{1,6}\\s+(.+)', 1) AS h FROM lines WHERE file LIKE '%.md' AND regexp_matches(line, '^#{1,6}\\s+.+')),
    marks AS (SELECT * FROM heads UNION ALL SELECT doc_id, file, 1, NULL FROM split WHERE file LIKE '%.md' AND doc_id NOT IN (SELECT doc_id FROM heads WHERE i = 1)),
    sects AS (SELECT m.doc_id, m.file, m.i AS start_line, coalesce(lead(m.i) OVER (PARTITION BY m.doc_id ORDER BY m.i) - 1, len(l)) AS end_line, trim(h) AS h FROM marks m JOIN split USING (doc_id)),
    spans AS (SELECT doc_id, file, id, q AS symbol, type, start_line, end_line, 0 AS late FROM top WHERE type <> 'class' UNION ALL SELECT doc_id, file, id, q, type, start_line, end_line, CASE type WHEN 'module' THEN 1 ELSE 0 END FROM runs
      UNION ALL SELECT doc_id, file, file, h, 'documentation', start_line, end_line, 0 FROM sects UNION ALL SELECT doc_id, file, file, NULL, CASE doc_id % 16 WHEN 8 THEN 'documentation' WHEN 9 THEN 'module' ELSE 'config' END, 1, len(l), 0 FROM split WHERE doc_id % 16 IN (7, 8, 9, 11, 15)),
    numbered AS (SELECT spans.*, array_to_string(l[start_line:end_line], chr(10)) AS text FROM spans JOIN split USING (doc_id)),
    pieces AS (SELECT *, row_number() OVER (ORDER BY file, start_line, late, id) AS k FROM numbered WHERE type IN ('function', 'method') OR regexp_matches(text, '\\S')), """ + split_sql("pieces", "k", ch.MOST_CHARS, ch.OVERLAP_LINES) + f""",
    parts AS (SELECT k, CAST(NULL AS INTEGER) AS part, start_line, end_line, text FROM pieces WHERE length(text) <= {ch.MOST_CHARS} UNION ALL SELECT k, part, start_line + s - 1, start_line + e - 1, array_to_string(string_split(text, chr(10))[s:e], chr(10)) FROM cut JOIN pieces USING (k)),
    chunks AS (SELECT 'chunk_' || lpad(CAST(row_number() OVER (ORDER BY k, part) AS VARCHAR), 5, '0') AS chunk_id, file, symbol, id AS entity_id, type, p.start_line, p.end_line, p.part, p.text FROM parts p JOIN pieces USING (k))"""  # fmt: skip


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return ch.build_chunks(files(spark, d), entities(spark, d))


@query(f"WITH RECURSIVE {_CHUNK_SQL} SELECT chunk_id, file, symbol, entity_id, type, start_line, end_line, part, md5(text) AS text_md5 FROM chunks")
def chunk_build(spark, d):
    """All chunks of all files."""
    return chunks(spark, d).select("chunk_id", "file", "symbol", "entity_id", "type", "start_line", "end_line", "part", F.md5("text").alias("text_md5"))


@query(f"WITH RECURSIVE {_CHUNK_SQL} SELECT type, count(*) AS n, count(DISTINCT file) AS n_files, count(part) AS n_parts FROM chunks GROUP BY ROLLUP (type)")
def chunk_build_summary(spark, d):
    return ch.chunk_summary(chunks(spark, d))


#: What answers say after a conversation's text, with what the chunks shown can and can't back; the last is a list of sources in one of three spellings.
_SAID = " See src/m{c}.py:{a}-{b} and (docs/none.md:3-4) plus src/m{c}.py::Foo.bar lines 2 to 9 , src/m{c}.py::Gone line 3. Again src/m{c}.py:{a}-{b}"
_SOURCES = ["\n\n**Sources:**\n- src/m{c}.py\n- src/m{c}.py: lines 40-90\n- lost.py", "\n\nSources:\n\n- lost.py\n- src/m{c}.py (L5)", "\nSource: src/m{c}.py lines 61 to 70", ""]


def _filled(template: str, values: dict[str, F.Column]) -> F.Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns of conversations as answers (answer_id, text), what was shown to each, and entities."""
    c = table(spark, d, "conversations").filter("text is not null")
    values = {"c": F.col("conv_id"), "a": F.col("turn") * 7 + 1, "b": F.col("turn") * 7 + 5}
    listed = F.get(F.array(*[_filled(s, values) for s in _SOURCES]), (F.col("conv_id") % 4).cast("int"))
    answer = F.col("conv_id") * 1000 + F.col("turn")
    said = c.select(answer.alias("answer_id"), F.concat("text", _filled(_SAID, values), listed).alias("text"))
    file = F.concat(F.lit("src/m"), F.col("conv_id").cast("string"), F.lit(".py"))
    each = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("chunk_id"), F.lit(s).cast("string").alias("symbol"), F.lit(a).cast("long").alias("start_line"), F.lit(b).cast("long").alias("end_line")) for i, k, s, a, b in ((1, "first", "Foo", 1, 6), (2, "second", None, 30, 60))])
    shown = c.select(answer.alias("answer_id"), file.alias("file"), F.explode(each).alias("x")).select("answer_id", "x.ord", "x.chunk_id", "file", "x.symbol", "x.start_line", "x.end_line")
    entities = c.select(file.alias("file")).distinct().select("file", F.concat("file", F.lit("::Foo.bar")).alias("id"), F.lit("method").alias("type"))
    return said, shown, entities


#: Built from what is known to be planted, without looking for citations in a text.
_ANSWER_SQL = """c AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id, text, 'src/m' || conv_id || '.py' AS f, 7 * turn + 1 AS a, 7 * turn + 5 AS b FROM conversations WHERE text IS NOT NULL),
    w AS (SELECT *, a <= 6 OR (a <= 60 AND b >= 30) AS seen FROM c),
    g AS (SELECT *, CASE WHEN seen THEN f || ':' || a || '-' || b ELSE '' END AS one FROM w),
    t AS (SELECT *, regexp_replace(regexp_replace(text || ' See ' || one || ' and  plus ' || f || '::Foo.bar lines 2 to 9, . Again ' || one, '\\(\\s*\\)', '', 'g'), '[ \\t]{2,}', ' ', 'g') AS x FROM g)"""


@query(f"WITH {_ANSWER_SQL} SELECT answer_id, trim(regexp_replace(x, ' +([,.;:])', '\\1', 'g'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, 2 + CASE WHEN seen THEN 0 ELSE 2 END + CASE conv_id % 4 WHEN 3 THEN 0 ELSE 1 END AS n_removed FROM t")
def citation_rewrite(spark, d):
    """Bodies of answers without citations that nothing backs."""
    return an.validated(*answers(spark, d))[0]


@query(f"""WITH {_ANSWER_SQL}, s AS (
      SELECT answer_id, 1 AS o, f, CASE WHEN a <= 6 THEN a ELSE greatest(a, 30) END AS s, CASE WHEN a <= 6 THEN least(b, 6) ELSE least(b, 60) END AS e, CASE WHEN a <= 6 THEN 'Foo' END AS symbol, CASE WHEN a <= 6 THEN 'first' ELSE 'second' END AS chunk_id FROM t WHERE seen
      UNION ALL SELECT answer_id, 2, f, 2, 6, 'Foo.bar', 'first' FROM t UNION ALL SELECT answer_id, 3, f, NULL, NULL, NULL, 'first' FROM t WHERE conv_id % 4 = 0
      UNION ALL SELECT answer_id, 4, f, 40, 60, NULL, 'second' FROM t WHERE conv_id % 4 = 0 UNION ALL SELECT answer_id, 5, f, 5, 5, 'Foo', 'first' FROM t WHERE conv_id % 4 = 1)
    SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY o) AS nth, f AS file, s AS start_line, e AS end_line, symbol, chunk_id FROM s""")
def citation_sources(spark, d):
    """What backs the citations of answers."""
    return an.validated(*answers(spark, d))[1]


#: Answers with code by conv_id % 4, around a conversation's text.
_FIXES = [
    ("{t}\n\n**Potential side effects:**\nslower\n\n```python\nx = {c}\n\n```\nmore", "slower\nmore"),
    ("{t}\n```\ny = {c}\n```\nSide effects\nnone seen", "none seen"),
    ("{t}\n\nside-effects:\nonly words", "only words"),
    ("```py\nz\n```\n\ntail {c}", "tail {c}"),
]


def _code_answers(spark, d):
    c = table(spark, d, "conversations").filter("text is not null and instr(text, '```') = 0")
    texts = [_filled(t, {"c": F.col("conv_id"), "t": F.col("text")}) for t, _ in _FIXES]
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.get(F.array(*texts), (F.col("conv_id") % 4).cast("int")).alias("text"))


_STRIP = "regexp_replace({}, '^[\\s\\x0b\\p{{Z}}\\x{{85}}]+|[\\s\\x0b\\p{{Z}}\\x{{85}}]+$', '', 'g')"


@query(f"""SELECT conv_id * 1000 + turn AS answer_id, CASE WHEN conv_id % 4 = 3 THEN '' ELSE {_STRIP.format('text')} END AS explanation,
    CASE conv_id % 4 WHEN 0 THEN 'x = ' || conv_id WHEN 1 THEN 'y = ' || conv_id WHEN 2 THEN '' ELSE 'z' END AS code,
    CASE conv_id % 4 WHEN 0 THEN 'slower' || chr(10) || 'more' WHEN 1 THEN 'none seen' WHEN 2 THEN 'only words' ELSE 'tail ' || conv_id END AS side_effects
    FROM conversations WHERE text IS NOT NULL AND instr(text, '```') = 0""")
def fix_sections(spark, d):
    """Explanation, code and side effects of answers that propose a fix."""
    return an.fix_answers(_code_answers(spark, d))


#: Test modules by conv_id % 3: with headings, without, and with words that head nothing. A turn's words become names of tests.
_MODULES = [
    "import x\n# Normal cases\ndef test_{w}():\n    pass\n\n#  EDGE and odd\n  async def test_b(): pass\ndef helper(): pass\n# Error conditions\n# none apply",
    "def test_normal_{w}(): pass\ndef test_invalid_and_edge(): pass\nx = 'def test_no(): pass'\n    def test_raises_{w}(a):\n        pass",
    "# plain words\ndef test_{w}(): pass\n# failing\ndef test_edge(): pass",
]


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id % 3 AS k, 'w' || turn AS w FROM conversations),
    r AS (SELECT answer_id, 0 AS ord, 'normal' AS name, CASE k WHEN 0 THEN ['test_' || w] WHEN 1 THEN ['test_normal_' || w] ELSE [] END AS tests FROM c UNION ALL
      SELECT answer_id, 1, 'edge', CASE k WHEN 0 THEN ['test_b'] WHEN 1 THEN ['test_invalid_and_edge'] ELSE ['test_edge'] END FROM c UNION ALL
      SELECT answer_id, 2, 'invalid_input', CASE k WHEN 1 THEN ['test_invalid_and_edge'] ELSE [] END FROM c UNION ALL
      SELECT answer_id, 3, 'error_conditions', CASE k WHEN 1 THEN ['test_raises_' || w] WHEN 2 THEN ['test_edge'] ELSE [] END FROM c)
    SELECT answer_id, ord, name, len(tests) > 0 AS covered, array_to_string(tests, ',') AS tests FROM r""")
def test_coverage(spark, d):
    """Which kinds of tests the modules of answers have."""
    c = table(spark, d, "conversations")
    code = F.get(F.array(*[_filled(m, {"w": F.concat(F.lit("w"), F.col("turn").cast("string"))}) for m in _MODULES]), (F.col("conv_id") % 3).cast("int"))
    found = an.test_categories(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), code.alias("code")))
    return found.select("answer_id", "ord", "name", "covered", F.array_join("tests", ",").alias("tests"))


@query(f"""WITH {_FILES_SQL}{DEDUPED_SQL}{MASK_SQL},
    o AS (SELECT doc_id, line_no, rule, id, type, s, e FROM (SELECT d.doc_id, d.line_no, d.rule, n.id, n.type, n.start_line AS s, n.end_line AS e, row_number() OVER (PARTITION BY d.doc_id, d.line_no, d.rule ORDER BY n.type = 'class', n.end_line - n.start_line, n.start_line) AS k
      FROM ded d JOIN ents n ON n.doc_id = d.doc_id AND d.line_no BETWEEN n.start_line AND n.end_line) t WHERE k = 1),
    r AS (SELECT d.doc_id, d.line_no, d.rule, d.severity, o.id AS entity_id, coalesce(o.type, 'module') AS type, CASE WHEN e - s < 6 THEN s ELSE greatest(1, d.line_no - 12) END AS start_line, CASE WHEN e - s < 6 THEN e ELSE least(len(l), d.line_no + 12) END AS end_line
      FROM ded d JOIN split USING (doc_id) LEFT JOIN o ON o.doc_id = d.doc_id AND o.line_no = d.line_no AND o.rule = d.rule)
    SELECT r.doc_id, r.line_no, r.rule, r.severity, entity_id, type, start_line, end_line, string_agg(m.line, chr(10) ORDER BY m.line_no) AS text FROM r JOIN masked m ON m.doc_id = r.doc_id AND m.line_no BETWEEN start_line AND end_line GROUP BY ALL""")
def flagged_regions(spark, d):
    """What is shown around each finding: what it lies in, up to six lines of it, or else the lines around it; no secret in any of them."""
    x = lines_of(files(spark, d))
    # The rules look at each line once; what else is read is documents with findings, which all secrets are.
    found = settle(fi.scan(x).drop("line"), "findings")
    x = x.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    shown = fi.regions(found.select("doc_id", "line_no", "rule", "severity"), x, entities(spark, d), fi.known_secrets(found, x), most=6)
    return shown.select("doc_id", "line_no", "rule", "severity", "entity_id", "type", "start_line", "end_line", "text")


@query(f"""WITH RECURSIVE {_CHUNK_SQL}{DEDUPED_SQL}{MASK_SQL} SELECT chunk_id, md5((SELECT string_agg(m.line, chr(10) ORDER BY m.line_no) FROM masked m WHERE m.doc_id = f.doc_id AND m.line_no BETWEEN c.start_line AND c.end_line)) AS text_md5
    FROM chunks c JOIN files f USING (file)""")
def chunks_masked(spark, d):
    """All chunks as a prompt may show them."""
    f = files(spark, d)
    x = lines_of(f)
    secrets = fi.known_secrets(fi.scan(x), x).join(f.select("doc_id", "file"), "doc_id").drop("doc_id")
    return fi.masked_chunks(chunks(spark, d), secrets).select("chunk_id", F.md5("text").alias("text_md5"))


#: Repositories of 64 documents: their number grows with the table.
_IN_REPO = 64


def repository(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The files, entities and edges of repositories: documents by 64; a Python file imports and calls others that its number leads to."""
    f = files(spark, d).withColumn("repo", F.floor(F.col("doc_id") / _IN_REPO).cast("long"))
    path = F.col("file")
    tables = f.select("repo", path.alias("path"), paths.language_of(path).alias("language"), paths.is_entry_point(path).alias("is_entry"), paths.is_project_file(path).alias("is_project"), paths.is_test_file(path).alias("is_test"))
    wear = F.get(F.array(*map(F.lit, _DECORATORS)), ((F.col("doc_id") + F.col("start_line")) % len(_DECORATORS)).cast("int"))
    e = entities(spark, d).withColumn("repo", F.floor(F.col("doc_id") / _IN_REPO).cast("long")).withColumn("nth", F.col("start_line"))
    e = e.withColumn("has_bases", (F.col("type") == "class") & (F.col("start_line") == 12)).withColumn("decorators", F.when(wear != "", F.array(wear)).otherwise(F.array().cast("array<string>")))
    n = F.col("doc_id")
    to = lambda x: (F.col("repo") * _IN_REPO + x % _IN_REPO).alias("to")
    code = f.filter("file like '%.py'").select("doc_id", "repo", "file")
    imports = code.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(3)))).filter(F.col("i") <= n % 4).select("repo", F.col("file").alias("src"), to(n * 7 + F.col("i") * 16), F.lit("imports").alias("relation"), F.lit("").alias("name"))
    calls = e.filter("type <> 'class'").select("repo", F.col("id").alias("src"), to(n * 5 + F.col("start_line") * 4), F.lit("calls").alias("relation"), F.when(F.col("start_line") % 4 == 0, "::C0.m").otherwise("::C0").alias("name"))
    inherits = e.filter("type = 'class'").select("repo", F.col("id").alias("src"), to(n * 3 + 16), F.lit("inherits").alias("relation"), F.lit("::C0").alias("name"))
    known = code.select(F.col("doc_id").alias("to"), "file")
    edges = imports.union(calls).union(inherits).join(known, "to").select("repo", "src", F.concat("file", "name").alias("dst"), "relation")
    return tables, e, edges


_DECORATORS = ["@app.get('/x')", "pytest.fixture", "@click.command()", "celery.task", "Router.POST('/y')", "property", "", "staticmethod", "fixtures.load", "typer.run", "@shared_task", "taskless"]

_REPO_SQL = _FILES_SQL + """,
    rf AS (SELECT doc_id, doc_id // 64 AS repo, file AS path, CASE WHEN file LIKE '%.py' THEN 'python' END AS language, doc_id % 16 = 3 AS is_entry, doc_id % 16 IN (6, 11, 14) AS is_project, doc_id % 16 = 1 AS is_test FROM files),
    re AS (SELECT ents.*, doc_id // 64 AS repo, string_split(q, '.')[-1] AS name, type = 'class' AND start_line = 12 AS has_bases,
      (['@app.get(''/x'')', 'pytest.fixture', '@click.command()', 'celery.task', 'Router.POST(''/y'')', 'property', '', 'staticmethod', 'fixtures.load', 'typer.run', '@shared_task', 'taskless'])[(doc_id + start_line) % 12 + 1] AS wear FROM ents),
    code AS (SELECT doc_id, repo, path FROM rf WHERE path LIKE '%.py'),
    links AS (SELECT repo, path AS src, repo * 64 + (doc_id * 7 + i * 16) % 64 AS t, 'imports' AS relation, '' AS n FROM code, range(1, 4) r(i) WHERE i <= doc_id % 4
      UNION ALL SELECT repo, id, repo * 64 + (doc_id * 5 + start_line * 4) % 64, 'calls', CASE WHEN start_line % 4 = 0 THEN '::C0.m' ELSE '::C0' END FROM re WHERE type <> 'class' UNION ALL SELECT repo, id, repo * 64 + (doc_id * 3 + 16) % 64, 'inherits', '::C0' FROM re WHERE type = 'class'),
    red AS (SELECT links.repo, src, path || n AS dst, relation, path AS target, string_split(src, '::')[1] AS source FROM links JOIN code ON code.doc_id = t),
    own AS (SELECT repo, file AS path, count(*) AS n, count(*) FILTER (type = 'class') AS k, count(*) FILTER (type = 'function') AS fn, coalesce(bool_or(type = 'class' AND (has_bases OR id IN (SELECT dst FROM red WHERE relation = 'inherits'))), false) AS h,
      list_concat(coalesce((list(name ORDER BY start_line) FILTER (type = 'class'))[1:3], []), coalesce((list(name ORDER BY start_line) FILTER (type = 'function'))[1:3], [])) AS symbols FROM re WHERE file NOT LIKE '%/test_m%' GROUP BY repo, file),
    usedby AS (SELECT target AS path, count(*) FILTER (relation = 'imports') AS i, count(*) FILTER (relation = 'calls' AND source <> target) AS c FROM red GROUP BY target),
    sc AS (SELECT own.repo, own.path, k, fn, h, n, symbols, coalesce(i, 0) AS i, coalesce(c, 0) AS c, own.path LIKE '%/__main__.py' AS e FROM own LEFT JOIN usedby USING (path)),
    imp AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS rank FROM (SELECT *, CASE WHEN e THEN 6 ELSE 0 END + 3 * least(i, 5) + least(c, 6) + least(k, 4) + least(fn, 4) // 2 + CASE WHEN h THEN 2 ELSE 0 END AS score FROM sc) t),
    why AS (SELECT *, list_filter([CASE WHEN e THEN 'application entry point' END, CASE WHEN i > 0 THEN 'imported by ' || i || ' file' || CASE i WHEN 1 THEN '' ELSE 's' END END, CASE WHEN c > 0 THEN 'called from ' || c || ' place' || CASE c WHEN 1 THEN '' ELSE 's' END || ' in other files' END,
      CASE WHEN k > 0 THEN 'defines ' || k || ' class' || CASE k WHEN 1 THEN '' ELSE 'es' END END, CASE WHEN h THEN 'part of a class hierarchy' END], lambda x: x IS NOT NULL) AS r FROM imp),
    readme AS (SELECT repo, min(path) AS path FROM rf WHERE path LIKE '%/README.md' GROUP BY repo)"""


def _important(spark, d):
    f, e, x = repository(spark, d)
    return gd.important_files(f, e, settle(x, "edges"))


@query(f"WITH {_REPO_SQL} SELECT repo, path, CAST(score AS BIGINT) AS score, rank, array_to_string(CASE WHEN len(r) > 0 THEN r ELSE ['holds ' || n || ' definition' || CASE n WHEN 1 THEN '' ELSE 's' END] END, '; ') AS reasons, array_to_string(symbols, ',') AS symbols FROM why")
def important_files(spark, d):
    """Files of repositories by importance, and why."""
    return _important(spark, d).select("repo", "path", "score", "rank", F.array_join("reasons", "; ").alias("reasons"), F.array_join("symbols", ",").alias("symbols"))


#: The walk over candidates as it is: one file after the other.
_ORDER_SQL = _REPO_SQL + """,
    base AS (SELECT repo, path, min(k) AS k FROM (SELECT repo, path, 1 AS k FROM readme UNION ALL SELECT repo, path, 2 FROM rf WHERE path LIKE '%/requirements.txt' UNION ALL SELECT repo, path, 3 FROM rf WHERE is_entry) t GROUP BY repo, path),
    nb AS (SELECT repo, count(*) AS n FROM base GROUP BY repo), cand AS (SELECT imp.repo, imp.path, rank, i > 0 AS core, base.path IS NOT NULL AS old FROM imp LEFT JOIN base USING (repo, path)),
    walk AS (SELECT c.repo, 0 AS rank, coalesce(n, 0) AS n, false AS done, CAST([] AS VARCHAR[]) AS got FROM (SELECT DISTINCT repo FROM cand) c LEFT JOIN nb USING (repo)
      UNION ALL SELECT w.repo, w.rank + 1, w.n + CASE WHEN core AND NOT old THEN 1 ELSE 0 END, w.n + CASE WHEN core AND NOT old THEN 1 ELSE 0 END >= 8, CASE WHEN core AND NOT old THEN list_append(got, path) ELSE got END FROM walk w JOIN cand c ON c.repo = w.repo AND c.rank = w.rank + 1 WHERE NOT done),
    one AS (SELECT repo, arg_max(n, rank) AS n, arg_max(got, rank) AS got FROM walk GROUP BY repo),
    again AS (SELECT repo, 0 AS rank, n, got, CAST([] AS VARCHAR[]) AS more FROM one
      UNION ALL SELECT w.repo, w.rank + 1, w.n + CASE WHEN old OR list_contains(got, path) THEN 0 ELSE 1 END, got, CASE WHEN old OR list_contains(got, path) THEN more ELSE list_append(more, path) END FROM again w JOIN cand c ON c.repo = w.repo AND c.rank = w.rank + 1 WHERE w.n < 10),
    two AS (SELECT repo, arg_max(got, rank) AS got, arg_max(more, rank) AS more FROM again GROUP BY repo),
    steps AS (SELECT repo, path, k, 0 AS o, ['readme', 'project', 'entry'][k] AS source FROM base UNION ALL SELECT repo, got[j], 4, j, 'core' FROM two, LATERAL (SELECT unnest(range(1, len(two.got) + 1)) AS j) UNION ALL SELECT repo, more[j], 5, j, 'other' FROM two, LATERAL (SELECT unnest(range(1, len(two.more) + 1)) AS j)
      UNION ALL SELECT repo, min(path), 6, 0, 'test' FROM rf WHERE is_test GROUP BY repo)"""


@query(f"WITH RECURSIVE {_ORDER_SQL} SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY k, o, path) AS position, path, source FROM steps")
def reading_order(spark, d):
    """What to read of each repository, in order."""
    f, e, x = repository(spark, d)
    return gd.reading_order(f, settle(gd.important_files(f, e, settle(x, "edges")), "important"))


def _words(k: int) -> str:
    words = gd.TOPICS[k][1]
    return f"(bool_or(regexp_matches(name, '(?i){words}')) OR regexp_matches(any_value(file), '(?i){words}'))"


_STAGE_SQL = _REPO_SQL + f""",
    topic AS (SELECT repo, file AS path, {_words(0)} AS auth, {_words(1)} AS logic, {_words(2)} AS data FROM re WHERE file NOT LIKE '%/test_m%' GROUP BY repo, file),
    found AS (SELECT repo, list(path ORDER BY path) AS f FROM rf WHERE doc_id % 16 = 4 GROUP BY repo),
    lists AS (SELECT r.repo, (SELECT list(path) FROM readme x WHERE x.repo = r.repo) AS readme, (SELECT list(path ORDER BY path)[1:4] FROM rf x WHERE x.repo = r.repo AND is_project) AS project, (SELECT list(path ORDER BY path)[1:2] FROM rf x WHERE x.repo = r.repo AND is_entry) AS entry,
      (SELECT list(path ORDER BY rank)[1:6] FROM imp x WHERE x.repo = r.repo AND i > 0) AS hubs, (SELECT list(path ORDER BY rank)[1:5] FROM imp x WHERE x.repo = r.repo) AS top, (SELECT count(DISTINCT file) FROM re x WHERE x.repo = r.repo) AS n,
      (SELECT list(path ORDER BY path)[1:6] FROM topic x WHERE x.repo = r.repo AND auth) AS auth, (SELECT list(path ORDER BY path)[1:6] FROM topic x WHERE x.repo = r.repo AND logic AND NOT auth) AS logic, (SELECT list(path ORDER BY path)[1:6] FROM topic x WHERE x.repo = r.repo AND data) AS data,
      (SELECT list(path ORDER BY rank)[1:5] FROM imp x WHERE x.repo = r.repo AND NOT e AND path NOT IN (SELECT path FROM topic WHERE auth)) AS rest, (SELECT list(path ORDER BY path)[1:6] FROM rf x WHERE x.repo = r.repo AND is_test) AS tests, (SELECT f[1:3] FROM found x WHERE x.repo = r.repo) AS scan FROM (SELECT DISTINCT repo FROM rf) r),
    st AS (SELECT repo, '01' AS number, 'Understand the project' AS title, list_concat(readme, project, entry) AS f, false AS yes FROM lists UNION ALL SELECT repo, '02', 'Learn the architecture', coalesce(hubs, top), n > 1 FROM lists UNION ALL SELECT repo, '03', 'Understand authentication', auth, false FROM lists
      UNION ALL SELECT repo, '04', 'Understand business logic', coalesce(logic, rest), false FROM lists UNION ALL SELECT repo, '05', 'Understand persistence', data, false FROM lists UNION ALL SELECT repo, '06', 'Understand testing and security', list_concat(tests, scan), true FROM lists),
    stage AS (SELECT repo, number, title, coalesce(len(f), 0) > 0 OR yes AS detected, coalesce(list_filter(f, lambda x, j: list_position(f, x) = j), []) AS files FROM st)"""


def _stages(spark, d):
    f, e, x = repository(spark, d)
    scan = files(spark, d).filter("doc_id % 16 = 4").select(F.floor(F.col("doc_id") / _IN_REPO).cast("long").alias("repo"), F.col("file").alias("path"), F.col("file").alias("nth"))
    return gd.stages(f, e, settle(gd.important_files(f, e, settle(x, "edges")), "important"), scan)


@query(f"WITH {_STAGE_SQL} SELECT repo, number, title, detected, array_to_string(files, ',') AS files FROM stage")
def guide_stages(spark, d):
    """The six stages of each repository."""
    return _stages(spark, d).withColumn("files", F.array_join("files", ","))


@query(f"WITH {_STAGE_SQL} SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY number) AS day, title AS theme, array_to_string(files[1:5], ',') AS files FROM stage WHERE detected AND len(files) > 0")
def guide_days(spark, d):
    """What to learn on which day."""
    return gd.learning_path(_stages(spark, d)).withColumn("files", F.array_join("files", ","))


@query(f"""WITH {_FILES_SQL}, t AS (SELECT file, regexp_matches(file, '(?i){gd.TOPICS[0][1]}') AS auth, regexp_matches(file, '(?i){gd.TOPICS[1][1]}') AS logic, regexp_matches(file, '(?i){gd.TOPICS[2][1]}') AS data FROM ents WHERE file NOT LIKE '%/test_m%' GROUP BY file)
    SELECT file AS path, auth, logic, data FROM t""")
def guide_topics(spark, d):
    """Which topics the code files touch."""
    f, e, _ = repository(spark, d)
    return gd.topic_files(f, e).select("path", "auth", "logic", "data")


@query(f"""WITH {_REPO_SQL}, h AS (SELECT repo, file, CASE wear WHEN '@app.get(''/x'')' THEN 'FastAPI or Flask-style routing' WHEN 'Router.POST(''/y'')' THEN 'FastAPI or Flask-style routing' WHEN 'pytest.fixture' THEN 'pytest' WHEN '@click.command()' THEN 'Click or Typer CLI' WHEN 'typer.run' THEN 'Click or Typer CLI'
      WHEN 'celery.task' THEN 'Celery' WHEN '@shared_task' THEN 'Celery' END AS name, CASE WHEN wear LIKE '@app%' OR wear LIKE 'Router%' THEN 'web' WHEN wear LIKE 'pytest%' THEN 'testing' WHEN wear LIKE '%click%' OR wear LIKE 'typer%' THEN 'cli' ELSE 'tasks' END AS category FROM re WHERE file NOT LIKE '%/test_m%'),
    dep AS (SELECT repo, ['Django', 'pytest', 'NumPy'][repo % 3 + 1] AS name, ['web', 'testing', 'data-science'][repo % 3 + 1] AS category, min(path) AS evidence FROM rf WHERE path LIKE '%/requirements.txt' GROUP BY repo)
    SELECT repo, name, category, evidence FROM dep UNION ALL SELECT repo, name, category, 'decorators in ' || min(file) FROM h WHERE name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dep WHERE dep.repo = h.repo AND dep.category = h.category) GROUP BY repo, name, category""")
def guide_frameworks(spark, d):
    """Frameworks that dependencies name and decorators hint at."""
    f, e, _ = repository(spark, d)
    pick = lambda *x: F.get(F.array(*map(F.lit, x)), (F.col("repo") % 3).cast("int"))
    known = f.filter("path like '%/requirements.txt'").groupBy("repo").agg(F.min("path").alias("evidence"))
    return gd.frameworks(f, e, known.select("repo", pick("Django", "pytest", "NumPy").alias("name"), pick("web", "testing", "data-science").alias("category"), "evidence"))


@query(f"""WITH {_REPO_SQL}, t AS (SELECT repo, id, file, parent FROM re WHERE type IN ('function', 'method') AND start_line IN (2, 4, 12) AND file NOT LIKE '%/test_m%'),
    k AS (SELECT DISTINCT src, dst FROM red WHERE relation = 'calls'), p AS (SELECT id, file, type, start_line, end_line, file LIKE '%/test_m%' AS is_test FROM re),
    cls AS (SELECT t.id AS target, parent AS id FROM t JOIN p ON p.id = t.parent AND p.type = 'class'),
    cle AS (SELECT target, id, n FROM (SELECT t.id AS target, dst AS id, row_number() OVER (PARTITION BY t.id ORDER BY dst) AS n FROM t JOIN k ON k.src = t.id JOIN p ON p.id = dst WHERE dst <> t.id AND dst <> t.parent) x WHERE n <= 4),
    clr AS (SELECT target, id, n FROM (SELECT t.id AS target, src AS id, row_number() OVER (PARTITION BY t.id ORDER BY src) AS n FROM t JOIN k ON k.dst = t.id JOIN p ON p.id = src WHERE NOT is_test AND src <> t.id AND src <> t.parent AND src NOT IN (SELECT c.id FROM cle c WHERE c.target = t.id)) x WHERE n <= 3),
    dir AS (SELECT DISTINCT t.id AS target, p.id, p.file, p.start_line FROM t JOIN k ON k.dst IN (t.id, t.parent) JOIN p ON p.id = src WHERE is_test),
    oth AS (SELECT DISTINCT t.id AS target, q.id, q.file, q.start_line FROM t JOIN red i ON i.relation = 'imports' AND i.dst = t.file JOIN re q ON q.file = i.src WHERE q.file LIKE '%/test_m%' AND q.type = 'function' AND q.name LIKE 'test%' AND t.id NOT IN (SELECT target FROM dir)),
    ex AS (SELECT target, id, n FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY file, start_line, id) AS n FROM (SELECT * FROM dir UNION SELECT * FROM oth) y) x WHERE n <= 4),
    w AS (SELECT id AS target, 1 AS ord, 'target' AS role, id, 150 AS most FROM t UNION ALL SELECT target, 101, 'class', id, 60 FROM cls UNION ALL SELECT target, 200 + n, 'callee', id, 40 FROM cle UNION ALL SELECT target, 300 + n, 'caller', id, 40 FROM clr UNION ALL SELECT target, 400 + n, 'existing', id, 40 FROM ex)
    SELECT target, ord, role, w.id, p.start_line, least(p.end_line, p.start_line + most - 1) AS end_line, md5(array_to_string(l[p.start_line:least(p.end_line, p.start_line + most - 1)], chr(10))) AS text_md5 FROM w JOIN p ON p.id = w.id JOIN split ON split.file = p.file""")
def test_evidence(spark, d):
    """What is shown to write tests of functions and methods."""
    f, e, x = repository(spark, d)
    known = f.select(F.col("path").alias("file"), "is_test")
    e = settle(e.join(known, "file"), "entities")
    targets = e.filter("type in ('function', 'method') and start_line in (2, 4, 12) and not is_test").select(F.col("id").alias("target"))
    named = lines_of(files(spark, d).select(F.col("file").alias("doc_id"), "text")).withColumnRenamed("doc_id", "file")
    shown = xc.excerpts(xc.test_evidence(targets, e, settle(x, "edges")), e, named)
    return shown.select("target", "ord", "role", "id", "start_line", "end_line", F.md5("text").alias("text_md5"))


_MARKS_SQL = "CASE doc_id % 5 WHEN 0 THEN 'import unittest' WHEN 1 THEN 'def test_x(): pass' WHEN 2 THEN 'from unittest import mock' WHEN 3 THEN 'import pytest' ELSE '# none' END"


@query(f"""WITH {_REPO_SQL}, m AS (SELECT rf.*, {_MARKS_SQL} AS mark FROM rf),
    a AS (SELECT repo, count(*) FILTER (is_test) AS n, coalesce(list(DISTINCT regexp_replace(path, '/[^/]*$', '')) FILTER (is_test), []) AS dirs, min(path) FILTER (is_test) AS example, count(*) FILTER (is_test AND doc_id % 5 IN (1, 3)) AS p, count(*) FILTER (is_test AND doc_id % 5 IN (0, 2)) AS u FROM m GROUP BY repo)
    SELECT repo, CASE WHEN p > 0 AND p >= u THEN 'pytest' WHEN u > 0 THEN 'unittest' ELSE 'unknown' END AS framework, n AS test_files, array_to_string(list_sort(dirs), ',') AS directories, CASE WHEN n > 0 THEN 'test_*.py' END AS naming, example, p AS pytest_files, u AS unittest_files FROM a""")
def guide_conventions(spark, d):
    """How the tests of repositories are written."""
    f, _, _ = repository(spark, d)
    marks = F.get(F.array(*map(F.lit, ["import unittest", "def test_x(): pass", "from unittest import mock", "import pytest", "# none"])), (F.col("doc_id") % 5).cast("int"))
    texts = files(spark, d).select(F.col("file").alias("path"), F.concat(marks, F.lit("\n")).alias("text"))
    found = gd.conventions(f.join(texts, "path"))
    return found.select("repo", "framework", "test_files", F.array_join("directories", ",").alias("directories"), "naming", "example", "pytest_files", "unittest_files")


@query(f"""WITH {_REPO_SQL}, dirs AS (SELECT repo, min(regexp_replace(path, '/[^/]*$', '')) AS dir FROM rf WHERE is_test GROUP BY repo), c AS (SELECT repo, path, regexp_replace(string_split(path, '/')[-1], '\\.py$', '') AS stem FROM code WHERE path NOT LIKE '%/test_m%'),
    k AS (SELECT c.path, min(t.path) AS known FROM c JOIN rf t ON t.repo = c.repo AND t.is_test AND string_split(t.path, '/')[-1] IN ('test_' || stem || '.py', stem || '_test.py') GROUP BY c.path)
    SELECT repo, path AS file, coalesce(known, coalesce(dir, 'tests') || '/test_' || stem || '.py') AS test_file FROM c LEFT JOIN k USING (path) LEFT JOIN dirs USING (repo)""")
def suggested_tests(spark, d):
    """Where tests of each code file would go."""
    f, _, _ = repository(spark, d)
    found = gd.conventions(f.withColumn("text", F.lit("")))
    targets = f.filter("path like '%.py' and not is_test").select("repo", F.col("path").alias("target"), F.col("path").alias("file"))
    return gd.suggested_test_files(targets, f, found).select("repo", "file", "test_file")


_FACTS_SQL = _REPO_SQL + """,
    ll AS (SELECT *, CASE doc_id % 16 WHEN 5 THEN 'markdown' WHEN 6 THEN 'json' WHEN 7 THEN 'json' WHEN 8 THEN 'text' WHEN 9 THEN 'go' WHEN 11 THEN 'text' WHEN 14 THEN 'markdown' WHEN 15 THEN 'toml' WHEN 10 THEN NULL ELSE 'python' END AS lang FROM rf),
    items AS (SELECT repo, 1 AS i, 'Languages' AS label, lang || ' (' || n || ' files)' AS what, 6 AS most, row_number() OVER (PARTITION BY repo ORDER BY n DESC, lang) AS k FROM (SELECT repo, lang, count(*) AS n FROM ll WHERE lang IS NOT NULL GROUP BY repo, lang) t
      UNION ALL SELECT repo, 3, 'Entry points', path, 20, row_number() OVER (PARTITION BY repo ORDER BY path) FROM rf WHERE is_entry UNION ALL SELECT repo, 4, 'Build files', path, 20, row_number() OVER (PARTITION BY repo ORDER BY path) FROM rf WHERE path LIKE '%/requirements.txt'
      UNION ALL SELECT repo, 5, 'Packages', p || ' (' || n || ' files)', 12, row_number() OVER (PARTITION BY repo ORDER BY n DESC, p) FROM (SELECT repo, string_split(file, '/')[1] AS p, count(DISTINCT file) AS n FROM re GROUP BY 1, 2) t
      UNION ALL SELECT repo, 6, 'Most imported', path || ' (' || i || ')', 6, row_number() OVER (PARTITION BY repo ORDER BY i DESC, path) FROM imp WHERE i > 0 UNION ALL SELECT repo, 7, 'Relationships', relation || ' ' || count(*), 9, row_number() OVER (PARTITION BY repo ORDER BY relation) FROM red GROUP BY repo, relation
      UNION ALL SELECT repo, 8, 'Important files', path, 8, rank FROM imp UNION ALL SELECT repo, 9, 'Test files', path, 12, row_number() OVER (PARTITION BY repo ORDER BY path) FROM rf WHERE is_test),
    facts AS (SELECT repo, i, label || ': ' || string_agg(what, ', ' ORDER BY k) FILTER (k <= most) || CASE WHEN max(k) > any_value(most) THEN ', ...' ELSE '' END AS line FROM items GROUP BY repo, i, label
      UNION ALL SELECT DISTINCT repo, 0, 'Repository: ' || repo FROM rf
      UNION ALL SELECT r.repo, 2, 'Size: ' || coalesce(f, 0) || ' source files, ' || coalesce(k, 0) || ' classes, ' || coalesce(m, 0) || ' functions, ' || t || ' test files' FROM (SELECT repo, count(*) FILTER (is_test) AS t FROM rf GROUP BY repo) r
        LEFT JOIN (SELECT repo, count(DISTINCT file) AS f, count(*) FILTER (type = 'class') AS k, count(*) FILTER (type <> 'class') AS m FROM re GROUP BY repo) z USING (repo))"""


@query(f"WITH {_FACTS_SQL} SELECT repo, string_agg(line, chr(10) ORDER BY i) AS fact_sheet FROM facts GROUP BY repo")
def fact_sheets(spark, d):
    """What drafts are told of each repository."""
    f, e, x = repository(spark, d)
    x = settle(x, "edges")
    return gd.fact_sheets(f, e, x, settle(gd.important_files(f, e, x), "important"))


@query(f"""WITH {_FILES_SQL}, hit AS (SELECT doc_id, file, line_no, regexp_extract(line, 'token = "([0-9a-f]+)"', 1) AS secret FROM lines WHERE regexp_matches(line, 'token = "[0-9a-f]+"'))
    SELECT file, line_no AS line, CASE doc_id % 3 WHEN 0 THEN 'aws-access-token' WHEN 1 THEN 'generic-api-key' ELSE 'secret' END AS rule, CASE doc_id % 3 WHEN 0 THEN 'AWS Access Token' WHEN 1 THEN 'Generic API Key' ELSE 'Secret' END AS type,
      CASE WHEN doc_id % 2 = 0 THEN 'Found [REDACTED] here' ELSE 'Possible secret detected.' END AS message, substr(sha1('secrets|' || CASE doc_id % 3 WHEN 0 THEN 'aws-access-token' WHEN 1 THEN 'generic-api-key' ELSE 'secret' END || '|' || file || '|' || line_no), 1, 16) AS fingerprint FROM hit""")
def leak_ingest(spark, d):
    """The secret scanner's reports on documents, one for each file; each holds a leak that is no leak, too."""
    f = files(spark, d)
    x = lines_of(f).join(f.select("doc_id", "file"), "doc_id")
    secret = F.regexp_extract("line", 'token = "([0-9a-f]+)"', 1)
    rule = F.get(F.array(F.lit("aws-access-token"), F.lit("generic-api-key"), F.lit("")), (F.col("doc_id") % 3).cast("int"))
    leak = F.struct(F.concat(F.lit("/work/"), "file").alias("File"), F.col("line_no").cast("string").alias("StartLine"), rule.alias("RuleID"), secret.alias("Secret"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Found "), secret, F.lit(" here"))).otherwise("").alias("Description"))
    bad = F.struct(F.lit(None).cast("string").alias("File"), F.lit("x").alias("StartLine"), F.lit("").alias("RuleID"), F.lit("").alias("Secret"), F.lit("").alias("Description"))
    reports = x.filter(secret != "").groupBy("file").agg(F.to_json(F.concat(F.collect_list(leak), F.array(bad))).alias("text"))
    return manifests.leak_report(reports, "/work").select("file", "line", "rule", "type", "message", "fingerprint")


@query(f"""WITH {_FILES_SQL}{DEDUPED_SQL}, n AS (SELECT *, 'SEC-' || lpad(CAST(row_number() OVER (ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END, doc_id, line_no, source, rule) AS VARCHAR), 3, '0') AS id,
      substr(sha1(source || '|' || rule || '|' || doc_id || '|' || line_no), 1, 16) AS fingerprint FROM ded)
    SELECT CASE WHEN doc_id % 2 = 0 THEN id ELSE fingerprint END AS wanted, id, rule, doc_id, line_no FROM n UNION ALL SELECT 'SEC-none', NULL, NULL, NULL, NULL""")
def finding_lookup(spark, d):
    """Findings by their number or fingerprint."""
    c = F.col
    # Read to find the ranges of numbers and for the rows.
    found = settle(fi.scan(lines_of(files(spark, d))).drop("line"), "scanned")
    found = fi.numbered(found, None).withColumn("fingerprint", ft.fingerprint(c("source"), c("rule"), c("doc_id").cast("string"), c("line_no")))
    found = settle(found.select("id", "fingerprint", "rule", "doc_id", "line_no"), "findings")
    wanted = found.select(F.when(c("doc_id") % 2 == 0, c("id")).otherwise(c("fingerprint")).alias("wanted")).union(spark.createDataFrame([("SEC-none",)], "wanted string"))
    return kn.finding_by(found, wanted).select("wanted", "id", "rule", "doc_id", "line_no")


@query("WITH o AS (SELECT user_id, event_id % 20 AS id, max(ts) AS at_ FROM events GROUP BY 1, 2), r AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY at_ DESC, id) AS position FROM o) SELECT user_id AS user, id, position FROM r WHERE position <= 8")
def recent_sessions(spark, d):
    """The last things that users have opened."""
    return kn.recent(table(spark, d, "events").select(F.col("user_id").alias("user"), (F.col("event_id") % 20).alias("id"), F.col("ts").alias("at")))


@query("SELECT count(*) AS n FROM embeddings")
def index_checked(spark, d):
    """Vectors whose index names their number, dimension and model."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    meta = v.agg(F.lit("hash-64").alias("model"), F.max(F.size("embedding")).alias("dimension"), F.count(F.lit(1)).alias("n"))
    return kn.checked_vectors(v.select("chunk_id"), v, meta, "hash-64").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_FILES_SQL}, v AS (SELECT file, CASE WHEN file LIKE '%.dat' THEN 0 ELSE strlen(text) % 3 END AS k, length(text) AS n FROM files)
    SELECT 'lengths' AS source, count(*) FILTER (k = 1 AND n % 7 <> 0) AS findings, count(*) FILTER (n % 7 = 0) AS failed_files, count(*) FILTER (n % 7 <> 0) > 0 AS ran FROM v
    UNION ALL SELECT 'never', 0, (SELECT count(*) FROM files), false""")
def scan_status(spark, d):
    """A scanner that fails on every seventh length, and one that can't start: findings of the rest, and what failed."""

    def lengths():
        def scan(path, text):
            if len(text) % 7 == 0:
                raise ValueError(f"cannot read {path}")
            return [("length", "LOW", "vulnerability", 1, "x")] if len(text.encode()) % 3 == 1 and not path.endswith(".dat") else []

        return scan

    def never():
        raise OSError("not installed")

    found, status = analysis.scan_isolated(files(spark, d).select(F.col("file").alias("path"), "text"), {"lengths": lengths, "never": never})
    return status.select("source", "findings", "failed_files", "ran")


_HEALTH_SQL = _REPO_SQL + """,
    hf AS (SELECT rf.*, len(l) AS n, CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN length(text) - length(replace(text, chr(10), '')) ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS lc, CASE doc_id % 16 WHEN 9 THEN 'go' WHEN 10 THEN NULL ELSE CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'no' END END AS lang FROM rf JOIN split USING (doc_id) JOIN files USING (doc_id)),
    he AS (SELECT *, (doc_id + start_line) % 3 = 0 AS documented, start_line % 5 + 1 AS p, end_line - start_line + 1 AS n FROM re WHERE file NOT LIKE '%/test_m%'),
    src AS (SELECT repo, path AS id, lc AS v FROM hf WHERE lang IN ('go', 'python') AND NOT is_test), fun AS (SELECT repo, id, n, p FROM he WHERE type <> 'class'),
    one AS (SELECT repo, 'large_files' AS kind, id, v, row_number() OVER (PARTITION BY repo ORDER BY v DESC, id) AS k FROM src WHERE v > 12 UNION ALL SELECT repo, 'large_functions', id, n, row_number() OVER (PARTITION BY repo ORDER BY n DESC, id) FROM fun WHERE n > 4
      UNION ALL SELECT repo, 'many_parameters', id, p, row_number() OVER (PARTITION BY repo ORDER BY p DESC, id) FROM fun WHERE p > 3)"""


def _health(spark, d):
    f, e, _ = repository(spark, d)
    texts = files(spark, d).select(F.col("file").alias("path"), paths.line_count(F.col("text")).alias("line_count"))
    # The first parameter is the instance in methods, and others are written in several ways.
    written = F.transform(F.sequence(F.lit(1), (F.col("start_line") % 5 + 1).cast("int")), lambda i: F.concat(F.get(F.array(*map(F.lit, ["a{}", "b{}: int", "c{}=1", "*d{}"])), i % 4), F.lit("")))
    e = e.withColumn("parameters", F.concat(F.when(F.col("type") == "method", F.array(F.lit("self: T"))).otherwise(F.array(F.lit("cls"))), written))
    e = e.withColumn("docstring", F.when((F.col("doc_id") + F.col("start_line")) % 3 == 0, "said").when(F.col("start_line") == 2, " "))
    return f.join(texts, "path"), e


@query(f"""WITH {_HEALTH_SQL}, docs AS (SELECT repo, count(*) AS documentable, count(*) FILTER (documented) AS documented FROM he GROUP BY repo)
    SELECT r.repo, m.path AS readme, coalesce(documented, 0) AS documented, coalesce(documentable, 0) AS documentable, round(documented / documentable, 3) AS coverage FROM (SELECT DISTINCT repo FROM rf) r LEFT JOIN readme m USING (repo) LEFT JOIN docs USING (repo)""")
def health_documentation(spark, d):
    """READMEs and docstrings of repositories."""
    return he.documentation(*_health(spark, d)).select("repo", "readme", "documented", "documentable", "coverage")


@query(f"""WITH {_HEALTH_SQL}, ra AS (SELECT repo, n, row_number() OVER (PARTITION BY repo ORDER BY n, id) - 1 AS k, count(*) OVER (PARTITION BY repo) AS c FROM fun),
    fu AS (SELECT repo, any_value(c) AS functions, max(n) AS longest_function, max(n) FILTER (k = c // 2) AS median_function FROM ra GROUP BY repo), so AS (SELECT repo, count(*) AS source_files, max(v) AS largest_file FROM src GROUP BY repo),
    li AS (SELECT repo, kind, string_agg(id || '=' || v, ',' ORDER BY k) FILTER (k <= 12) AS l, count(*) AS n FROM one GROUP BY repo, kind)
    SELECT r.repo, coalesce(source_files, 0) AS source_files, coalesce(functions, 0) AS functions, coalesce(largest_file, 0) AS largest_file, coalesce(longest_function, 0) AS longest_function, coalesce(median_function, 0) AS median_function,
      coalesce(a.n, 0) AS large_files_total, coalesce(a.l, '') AS large_files, coalesce(b.n, 0) AS large_functions_total, coalesce(b.l, '') AS large_functions, coalesce(c.n, 0) AS many_parameters_total, coalesce(c.l, '') AS many_parameters
    FROM (SELECT DISTINCT repo FROM rf) r LEFT JOIN so USING (repo) LEFT JOIN fu USING (repo) LEFT JOIN li a ON a.repo = r.repo AND a.kind = 'large_files' LEFT JOIN li b ON b.repo = r.repo AND b.kind = 'large_functions' LEFT JOIN li c ON c.repo = r.repo AND c.kind = 'many_parameters'""")
def health_maintainability(spark, d):
    """Sizes of code in repositories, and what is too large."""
    f, e = _health(spark, d)
    found = he.maintainability(f, e, 12, 4, 3)
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["id"], F.lit("="), x["value"].cast("string"))), ",").alias(c)
    return found.select("repo", "source_files", "functions", "largest_file", "longest_function", "median_function", "large_files_total", said("large_files"), "large_functions_total", said("large_functions"), "many_parameters_total", said("many_parameters"))


@query(f"""WITH {_REPO_SQL}, mf AS (SELECT repo, path, doc_id % 5 <> 0 AS parsed FROM rf WHERE path LIKE '%/requirements.txt'), nm AS (SELECT repo, path, ['fastapi', 'left-pad', 'scikit-learn', 'pytest'][(doc_id + j) % 4 + 1] AS package, (doc_id + j) % 3 = 0 AS pinned FROM rf, range(0, 2) t(j) WHERE path LIKE '%/requirements.txt' AND doc_id % 5 <> 0),
    pk AS (SELECT repo, package, bool_or(pinned) AS pinned FROM nm GROUP BY repo, package)
    SELECT m.repo, string_agg(path, ',' ORDER BY path) AS files, coalesce(string_agg(path, ',' ORDER BY path) FILTER (NOT parsed), '') AS unparsed, CASE WHEN bool_or(parsed) THEN (SELECT count(*) FROM pk WHERE pk.repo = m.repo) END AS count, CASE WHEN bool_or(parsed) THEN (SELECT count(*) FILTER (pinned) FROM pk WHERE pk.repo = m.repo) END AS pinned,
      coalesce((SELECT string_agg(package, ',' ORDER BY package) FROM pk WHERE pk.repo = m.repo), '') AS packages FROM mf m GROUP BY m.repo""")
def health_dependencies(spark, d):
    """What the manifests of repositories name; every fifth can't be parsed."""
    f = files(spark, d).filter("file like '%/requirements.txt'").select(F.floor(F.col("doc_id") / _IN_REPO).cast("long").alias("repo"), F.col("file").alias("path"), (F.col("doc_id") % 5 != 0).alias("parsed"), "doc_id")
    named = f.filter("parsed").select("repo", "path", "doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    names = F.get(F.array(*map(F.lit, ["FastAPI", "left_pad", "scikit_learn", "pytest"])), ((F.col("doc_id") + F.col("j")) % 4).cast("int"))
    found = named.select("repo", "path", names.alias("package"), ((F.col("doc_id") + F.col("j")) % 3 == 0).alias("pinned"))
    rows, _ = he.dependencies(f, found)
    return rows.select("repo", F.array_join("files", ",").alias("files"), F.array_join("unparsed", ",").alias("unparsed"), "count", "pinned", F.array_join("packages", ",").alias("packages"))


@query(f"""WITH {_FILES_SQL}{DEDUPED_SQL}, s AS (SELECT doc_id // 64 AS repo, severity, category FROM ded), r AS (SELECT DISTINCT doc_id // 64 AS repo FROM files)
    SELECT repo, repo % 3 > 0 AS scanned, CASE WHEN repo % 3 > 0 THEN (SELECT count(*) FROM s WHERE s.repo = r.repo) END AS total, CASE WHEN repo % 3 > 0 THEN (SELECT count(*) FILTER (category = 'secret') FROM s WHERE s.repo = r.repo) END AS secrets, CASE WHEN repo % 3 > 0 THEN 'lines' ELSE '' END AS scanners FROM r""")
def health_security(spark, d):
    """What scanners found in repositories; in every third none has run."""
    f = files(spark, d).withColumn("repo", F.floor(F.col("doc_id") / _IN_REPO).cast("long"))
    found = fi.scan(lines_of(f)).withColumn("repo", F.floor(F.col("doc_id") / _IN_REPO).cast("long"))
    repos = f.select("repo").distinct()
    status = repos.select("repo", F.lit("lines").alias("source"), (F.col("repo") % 3 > 0).alias("ran"))
    row = he.security(repos, found, status)
    return row.join(he.overview_slice(row).select("repo", "total"), "repo").select("repo", "scanned", "total", "secrets", F.array_join("scanners", ",").alias("scanners"))

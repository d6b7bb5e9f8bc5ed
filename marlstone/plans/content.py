"""Queries of lines, chunks, vectors, findings, health and guides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import findings_text as ft
from marlstone.functions import frameworks, paths
from marlstone.operators import findings, inventory, text, vectors
from marlstone.operators.views import edges, entities, files, lines, table, with_views

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(files(spark, d))


@query(with_views("lines") + " SELECT doc_id, line_no, line FROM lines")
def line_explode(spark, d):
    return _lines(spark, d)


_SEGMENTS = """, seg AS (SELECT doc_id, min(line_no) AS start_line, max(line_no) AS end_line FROM (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM lines WHERE length(line) <= 200) t
    GROUP BY doc_id, g HAVING bool_or(trim(line) <> ''))"""


def _segments(spark, d):
    x = _lines(spark, d)
    return text.uncovered_segments(x, x.filter(F.length("line") > 200))


@query(with_views("lines") + _SEGMENTS + " SELECT * FROM seg")
def segments_uncovered(spark, d):
    return _segments(spark, d)


@query(with_views("lines") + """, h AS (SELECT doc_id, line_no AS start_line, trim(line) AS symbol FROM lines WHERE regexp_matches(line, '^[A-Z][a-z]* [a-z]+ .*\\.$') AND length(line) < 90),
    l AS (SELECT doc_id, max(line_no) AS n FROM lines GROUP BY doc_id), f AS (SELECT doc_id, min(start_line) AS m FROM h GROUP BY doc_id),
    p AS (SELECT doc_id, 1 AS start_line, NULL AS symbol FROM l LEFT JOIN f USING (doc_id) WHERE m IS NULL OR m > 1), a AS (SELECT * FROM h UNION ALL SELECT * FROM p)
    SELECT doc_id, symbol, start_line, coalesce(lead(start_line) OVER (PARTITION BY doc_id ORDER BY start_line) - 1, n) AS end_line FROM a JOIN l USING (doc_id)""")
def section_boundaries(spark, d):
    x = _lines(spark, d)
    short = x.withColumn("line", F.when(F.length("line") < 90, F.col("line")).otherwise(""))
    return text.sections(short, r"^[A-Z][a-z]* [a-z]+ .*\.$")


@query(with_views("lines") + _SEGMENTS + " SELECT doc_id, start_line, end_line, 'chunk_' || lpad(CAST(row_number() OVER (ORDER BY doc_id, start_line) AS VARCHAR), 5, '0') AS chunk_id FROM seg")
def chunk_numbering(spark, d):
    return text.numbered(_segments(spark, d), "doc_id", "start_line")


def split_sql(chunks: str, key: str, most: int, overlap: int) -> str:
    """Tables of a WITH clause: cut (key, part, s, e: lines within the chunk, from 1) of those of chunks (key, text) that are too long."""
    return f"""big AS (SELECT {key}, i, length(l[i]) + 1 AS size FROM (SELECT {key}, string_split(text, chr(10)) AS l FROM {chunks} WHERE length(text) > {most}) t, LATERAL (SELECT unnest(range(1, len(t.l) + 1)) AS i)),
    run AS (SELECT {key}, i, sum(size) OVER (PARTITION BY {key} ORDER BY i) AS p FROM big), sums AS (SELECT {key}, list(p ORDER BY i) AS p FROM run GROUP BY {key}),
    cut AS (SELECT {key}, 1 AS part, CAST(1 AS BIGINT) AS s, greatest(1, len(list_filter(p, lambda x: x <= {most}))) AS e FROM sums
      UNION ALL SELECT {key}, part + 1, greatest(s + 1, e + 1 - {overlap}), greatest(s + 1, e + 1 - {overlap}, len(list_filter(p, lambda x: x - coalesce(p[greatest(s + 1, e + 1 - {overlap}) - 1], 0) <= {most}))) FROM cut JOIN sums USING ({key}) WHERE e < len(p))"""


_WHOLE = """ SELECT doc_id, CAST(NULL AS BIGINT) AS part, 1 AS start_line, len(string_split(text, chr(10))) AS end_line, text FROM documents WHERE length(text) <= 2000"""


@query("WITH RECURSIVE " + split_sql("documents", "doc_id", 2000, 5) + _WHOLE + " UNION ALL SELECT doc_id, part, s, e, array_to_string(string_split(text, chr(10))[s:e], chr(10)) FROM cut JOIN documents USING (doc_id)")
def oversize_split(spark, d):
    return text.split_oversized(files(spark, d).select("doc_id", F.lit(1).cast("long").alias("start_line"), "text"), 2000, 5)


@query("SELECT 0 AS n_wrong, count(*) AS n_whole FROM documents WHERE text IS NOT NULL")
def oversize_split_is_whole(spark, d):
    """Parts must be exactly their lines, each begin after the last one's first line, and cover every line of the document."""
    parts = text.split_oversized(files(spark, d).select("doc_id", F.lit(1).cast("long").alias("start_line"), "text"), 2000, 5)
    whole = files(spark, d).select("doc_id", F.split("text", "\n", -1).alias("all"))
    own = F.array_join(F.slice("all", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    by_part = Window.partitionBy("doc_id").orderBy("part")
    covered = F.coalesce(F.max("end_line").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gap = (F.col("start_line") > covered + 1) | (F.col("start_line") <= F.coalesce(F.lag("start_line").over(by_part), F.lit(0)))
    checked = parts.withColumn("gap", gap).join(whole, "doc_id")
    by = checked.groupBy("doc_id").agg(F.count_if((own != F.col("text")) | F.col("gap")).alias("wrong"), (F.max("end_line") == F.max(F.size("all"))).alias("ends"))
    return by.agg(F.coalesce(F.sum("wrong"), F.lit(0)).alias("n_wrong"), F.count_if("ends").alias("n_whole"))


@query("""WITH RECURSIVE c AS (SELECT source || '/' || doc_id % 40 AS grp, doc_id, length(text) AS size, row_number() OVER (PARTITION BY source || '/' || doc_id % 40 ORDER BY doc_id) AS k FROM documents),
    r AS (SELECT grp, doc_id, k, true AS fit, least(size, 3000) AS used, size > 3000 AS truncated FROM c WHERE k = 1
      UNION ALL SELECT c.grp, c.doc_id, c.k, r.used + size <= 3000, CASE WHEN r.used + size <= 3000 THEN r.used + size ELSE r.used END, false FROM r JOIN c ON c.grp = r.grp AND c.k = r.k + 1)
    SELECT grp, k AS ord, doc_id AS chunk_id, truncated FROM r WHERE fit""")
def context_pack(spark, d):
    """Groups of chunks under a budget that some groups' first chunk exceeds."""
    c = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id") % 40).alias("grp"), F.col("doc_id").alias("chunk_id"), "text")
    c = c.withColumn("ord", F.row_number().over(Window.partitionBy("grp").orderBy("chunk_id")).cast("long"))
    return text.pack_context(c, "grp", "ord", 3000)


def _hits(spark, d, k):
    """The queries are all vectors whose id is divisible by 50."""
    v = table(spark, d, "embeddings")
    return vectors.top_k(v, v.filter("vec_id % 50 = 0"), k)


_KNN = "SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0"


@query(f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ({_KNN}) t WHERE rank <= 10")
def knn_topk(spark, d):
    return _hits(spark, d, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT query_id, t.vec_id, rank, source, lang FROM ({_KNN}) t JOIN documents ON doc_id = t.vec_id WHERE rank <= 10")
def knn_hydrate(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "source", "lang")
    return _hits(spark, d, 10).join(docs, "vec_id").select("query_id", "vec_id", "rank", "source", "lang")


@query(f"WITH h AS (SELECT * FROM ({_KNN}) t WHERE rank <= 6), u AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY query_id) AS k FROM h) SELECT vec_id, query_id, round(score, 6) AS score FROM u WHERE k = 1")
def multi_query_retrieval(spark, d):
    return vectors.union_first(_hits(spark, d, 6)).select("vec_id", "query_id", F.round("score", 6).alias("score"))


@query(f"""WITH h AS (SELECT * FROM ({_KNN}) t WHERE rank <= 11 AND query_id <> vec_id), j AS (SELECT h.*, v.label = q.label AS good FROM h JOIN embeddings v USING (vec_id) JOIN embeddings q ON q.vec_id = query_id),
    e AS (SELECT query_id, count(*) FILTER (good) / 11.0 AS p, coalesce(1.0 / min(rank) FILTER (good), 0) AS r FROM j GROUP BY query_id) SELECT round(avg(CAST(p AS DOUBLE)), 6) AS precision_at_k, round(avg(CAST(r AS DOUBLE)), 6) AS mrr FROM e""")
def retrieval_recall_mrr(spark, d):
    return vectors.retrieval_quality(_hits(spark, d, 11), table(spark, d, "embeddings"), 11)


@query("SELECT count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS n_other_dimension, count(*) FILTER (abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 1e-3) AS n_not_unit FROM embeddings")
def unit_norm_check(spark, d):
    return vectors.check_index(table(spark, d, "embeddings"), 64)


@query(f"SELECT query_id, t.vec_id, rank, round(score, 6) AS score, 'hash-64' AS model FROM ({_KNN}) t WHERE rank <= 8")
def retrieve_guarded(spark, d):
    """The index's one row of metadata must name the query's model and dimension, or nothing is found."""
    meta = spark.createDataFrame([("hash-64", 64)], "model string, dimension int")
    v = table(spark, d, "embeddings")
    fit = v.join(F.broadcast(meta.filter("model = 'hash-64'"))).filter(F.size("embedding") == F.col("dimension"))
    return vectors.top_k(fit, fit.filter("vec_id % 50 = 0"), 8).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"), F.lit("hash-64").alias("model"))


def _rules_sql() -> str:
    parts = []
    for rule, tool, declared, category, pattern in findings.LINE_RULES:
        sev = declared or ft.TOOL_SEVERITY[tool]
        quoted = pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, line_no, '{rule}' AS rule, '{sev}' AS severity, '{category}' AS category, 'lines' AS source, line FROM lines WHERE regexp_matches(line, '{quoted}')")
    return ", raw AS (" + " UNION ALL ".join(parts) + ")"


_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"
_RAW = with_views("lines") + _rules_sql()


def _secrets_sql() -> str:
    quoted = [(i, rule, p.replace("'", "''")) for i, (rule, p) in enumerate(findings.SECRET_RULES)]
    return ", sraw AS (" + " UNION ALL ".join(f"SELECT doc_id, line_no, '{rule}' AS rule, {i} AS nth, strpos(line, regexp_extract(line, '{p}')) AS pos, line FROM lines WHERE regexp_matches(line, '{p}')" for i, rule, p in quoted) + ")"


#: Of the secret scanner one for each line; the other scanner's secrets only where it has none; all vulnerabilities.
DEDUPED_SQL = _rules_sql() + _secrets_sql() + """, sec AS (SELECT doc_id, line_no, rule, 'HIGH' AS severity, 'secret' AS category, 'secrets' AS source, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY rule LIKE 'generic%', pos, nth) AS k FROM sraw) t WHERE k = 1),
    ded AS (SELECT * FROM sec UNION ALL SELECT * FROM raw r WHERE category <> 'secret' OR NOT EXISTS (SELECT 1 FROM sec s WHERE s.doc_id = r.doc_id AND s.line_no = r.line_no))"""
_DEDUPED = with_views("lines") + DEDUPED_SQL


def _raw(spark, d):
    return findings.scan_lines(_lines(spark, d))


def _settled(spark, d):
    return findings.scan(_lines(spark, d))


@query(_RAW + " SELECT doc_id, line_no, rule, severity, category FROM raw")
def findings_raw(spark, d):
    return _raw(spark, d).select("doc_id", "line_no", "rule", "severity", "category")


@query(_RAW + " SELECT severity, category, count(*) AS n, regexp_matches(rule, 'secret|password|credential|token|api-?key|private-?key') AS secret_rule FROM raw GROUP BY ALL")
def findings_severity_map(spark, d):
    return _raw(spark, d).groupBy("severity", "category", ft.secret_rule(F.col("rule")).alias("secret_rule")).agg(F.count(F.lit(1)).alias("n"))


@query(_RAW + """ SELECT doc_id, line_no, regexp_replace(line, '(")[^"]{4,}?"|('')[^'']{4,}?''', '\\1\\2[REDACTED]\\1\\2', 'g') AS line FROM raw WHERE rule = 'generic-credential'""")
def findings_redacted(spark, d):
    found = _raw(spark, d).filter("rule = 'generic-credential'")
    return found.select("doc_id", "line_no", ft.redact_literals(F.col("line")).alias("line"))


@query(_RAW + " SELECT doc_id, line_no, rule, substr(sha1(source || '|' || rule || '|' || doc_id || '|' || line_no), 1, 16) AS fingerprint FROM raw")
def findings_fingerprint(spark, d):
    c = F.col
    return _raw(spark, d).select("doc_id", "line_no", "rule", ft.fingerprint(c("source"), c("rule"), c("doc_id").cast("string"), c("line_no")).alias("fingerprint"))


@query(_DEDUPED + " SELECT doc_id, line_no, rule, severity FROM ded")
def findings_dedupe(spark, d):
    return _settled(spark, d).select("doc_id", "line_no", "rule", "severity")


@query(_DEDUPED + f", c AS (SELECT *, row_number() OVER (ORDER BY {_RANK}, doc_id, line_no, source, rule) AS k FROM ded) SELECT 'SEC-' || lpad(CAST(k AS VARCHAR), 3, '0') AS id, doc_id, line_no, rule, severity FROM c WHERE k <= 200")
def findings_numbered(spark, d):
    return findings.numbered(_settled(spark, d), 200).select("id", "doc_id", "line_no", "rule", "severity")


@query(_DEDUPED + " SELECT s.severity, count(ded.rule) AS n FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) s(severity) LEFT JOIN ded ON ded.severity = s.severity GROUP BY s.severity")
def security_summary(spark, d):
    return findings.summary(_settled(spark, d))


@query(_RAW + " SELECT doc_id, line_no, rule FROM raw WHERE severity IN ('HIGH', 'CRITICAL') AND category = 'secret' AND instr(lower(rule), 'cred') > 0")
def findings_filter(spark, d):
    return _raw(spark, d).filter(F.col("severity").isin("HIGH", "CRITICAL") & (F.col("category") == "secret") & F.contains(F.lower("rule"), F.lit("cred"))).select("doc_id", "line_no", "rule")


@query(_RAW + """, a AS (SELECT doc_id, line_no, rule, 'lines' AS scanner FROM raw WHERE category = 'secret' UNION ALL SELECT doc_id, line_no, rule, 'privacy' FROM raw WHERE category <> 'secret')
    SELECT scanner, count(*) AS findings, true AS ran FROM a GROUP BY scanner""")
def findings_union_status(spark, d):
    raw = _raw(spark, d)
    both = raw.filter("category = 'secret'").withColumn("scanner", F.lit("lines")).unionByName(raw.filter("category <> 'secret'").withColumn("scanner", F.lit("privacy")))
    return both.groupBy("scanner").agg(F.count(F.lit(1)).alias("findings")).withColumn("ran", F.lit(True))


#: masked: all lines, without what the secret rules find, and without literals where only the other scanner has a secret.
MASK_SQL = (
    r""", masked AS (SELECT doc_id, line_no, CASE WHEN loose THEN regexp_replace(m, '(")[^"]{4,}?"|('')[^'']{4,}?''', '\1\2[REDACTED]\1\2', 'g') ELSE m END AS line
      FROM (SELECT l.doc_id, l.line_no, regexp_replace(line, '"""
    + findings.SECRET_RULES[3][1].replace("'", "''")
    + """', '[REDACTED]', 'g') AS m, k.line_no IS NOT NULL AS loose FROM lines l
      LEFT JOIN (SELECT DISTINCT doc_id, line_no FROM ded WHERE category = 'secret' AND source = 'lines') k ON k.doc_id = l.doc_id AND k.line_no = l.line_no) t)"""
)


@query(_DEDUPED + MASK_SQL + """, w AS (SELECT DISTINCT doc_id, line_no AS finding_line, line_no + i AS line_no FROM ded, range(-2, 3) t(i))
    SELECT doc_id, finding_line, line_no, line FROM w JOIN masked USING (doc_id, line_no)""")
def finding_context(spark, d):
    """The lines around all findings, with every secret in them masked."""
    x = _lines(spark, d)
    found = findings.scan(x)
    return findings.context_lines(found, x, findings.known_secrets(found, x), 2)


@query(_RAW + _SEGMENTS + """, i AS (SELECT raw.doc_id, line_no, rule, start_line, end_line, row_number() OVER (PARTITION BY raw.doc_id, line_no, rule ORDER BY start_line % 2 = 0, end_line - start_line, start_line) AS k
    FROM raw JOIN seg ON seg.doc_id = raw.doc_id AND line_no BETWEEN start_line AND end_line) SELECT doc_id, line_no, rule, start_line, end_line FROM i WHERE k = 1""")
def enclosing_entity(spark, d):
    spans = _segments(spark, d).withColumn("is_class", F.col("start_line") % 2 == 0)
    return findings.innermost(_raw(spark, d), spans).select("doc_id", "line_no", "rule", "start_line", "end_line")


_RANGES = _SEGMENTS + ", rg AS (SELECT doc_id, 2 AS start_line, 4 AS end_line FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 7, 9 FROM documents WHERE doc_id % 3 = 0)"


def _ranges(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    one = lambda m, a, b: docs.filter(F.col("doc_id") % m == 0).select("doc_id", F.lit(a).cast("long").alias("start_line"), F.lit(b).cast("long").alias("end_line"))
    return one(2, 2, 4).unionByName(one(3, 7, 9))


@query(with_views("lines") + _RANGES + """ SELECT doc_id, start_line, end_line, other_start FROM (SELECT a.*, b.start_line AS other_start, row_number() OVER (PARTITION BY a.doc_id, a.start_line ORDER BY b.start_line) AS k
    FROM seg a JOIN rg b ON a.doc_id = b.doc_id AND a.start_line <= b.end_line AND b.start_line <= a.end_line) t WHERE k = 1""")
def range_overlap(spark, d):
    return findings.overlapping(_segments(spark, d), _ranges(spark, d)).select("doc_id", "start_line", "end_line", "other_start")


@query(with_views("lines") + _RANGES + " SELECT doc_id, start_line, end_line FROM seg a WHERE NOT EXISTS (SELECT 1 FROM rg b WHERE a.doc_id = b.doc_id AND a.start_line <= b.end_line AND b.start_line <= a.end_line)")
def non_overlapping(spark, d):
    return findings.apart(_segments(spark, d), _ranges(spark, d))


_CITED = "conv_id, turn, text || ' (see src/m' || conv_id || '.py:' || (turn + 1) || '-' || (turn + 5) || ')' AS text"


@query(f"WITH c AS (SELECT {_CITED} FROM conversations) SELECT conv_id, turn, regexp_extract(text, '([A-Za-z0-9_/.-]+\\.py):(\\d+)-(\\d+)', 1) AS file, CAST(regexp_extract(text, '([A-Za-z0-9_/.-]+\\.py):(\\d+)-(\\d+)', 2) AS BIGINT) AS start_line, CAST(regexp_extract(text, '([A-Za-z0-9_/.-]+\\.py):(\\d+)-(\\d+)', 3) AS BIGINT) AS end_line FROM c")
def citation_extract(spark, d):
    turn = F.col("turn")
    t = F.concat("text", F.lit(" (see src/m"), F.col("conv_id").cast("string"), F.lit(".py:"), (turn + 1).cast("string"), F.lit("-"), (turn + 5).cast("string"), F.lit(")"))
    pattern = r"([A-Za-z0-9_/.-]+\.py):(\d+)-(\d+)"
    c = table(spark, d, "conversations").withColumn("text", t)
    part = lambda k: F.regexp_extract("text", pattern, k)
    return c.select("conv_id", "turn", part(1).alias("file"), part(2).cast("long").alias("start_line"), part(3).cast("long").alias("end_line"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) t WHERE k <= 6")
def history_tail(spark, d):
    by = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, d, "conversations").withColumn("k", F.row_number().over(by)).filter("k <= 6").select("conv_id", "turn", "role")


@query("SELECT lang, count(*) AS n, count(l.doc_id) AS n_documented, round(count(l.doc_id) / count(*), 6) AS coverage FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def docstring_coverage(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.lit(1).alias("known"))
    g = table(spark, d, "documents").join(labels, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("n_documented"))
    return g.withColumn("coverage", F.round(F.col("n_documented") / F.col("n"), 6))


@query("SELECT source, count(*) AS n, max(n_chars) AS longest, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median FROM documents GROUP BY source")
def length_stats(spark, d):
    return inventory.upper_median(table(spark, d, "documents").select("source", "n_chars"), "source", "n_chars")


@query(with_views("files") + """ SELECT 'long' AS list, path, line_count AS value FROM (SELECT * FROM files WHERE line_count > 20 ORDER BY line_count DESC, path LIMIT 12) UNION ALL
    SELECT 'big', path, size_bytes FROM (SELECT * FROM files WHERE size_bytes > 8000 ORDER BY size_bytes DESC, path LIMIT 12)""")
def threshold_lists(spark, d):
    f = files(spark, d)
    top = lambda name, value, least: f.filter(F.col(value) > least).orderBy(F.desc(value), "path").limit(12).select(F.lit(name).alias("list"), "path", F.col(value).alias("value"))
    return top("long", "line_count", 20).unionByName(top("big", "size_bytes", 8000))


# Fixed values, written apart from those of the operator.
_CAT_SQL = """(VALUES
    ('@angular/core', 'Angular', 'web'), ('aiohttp', 'aiohttp', 'web'), ('alembic', 'Alembic', 'data'), ('angular', 'Angular', 'web'), ('argparse', 'argparse', 'cli'),
    ('asyncpg', 'asyncpg', 'data'), ('bottle', 'Bottle', 'web'), ('celery', 'Celery', 'tasks'), ('click', 'Click', 'cli'), ('django', 'Django', 'web'), ('dramatiq', 'Dramatiq', 'tasks'),
    ('express', 'Express', 'web'), ('fastapi', 'FastAPI', 'web'), ('flask', 'Flask', 'web'), ('gunicorn', 'Gunicorn', 'server'), ('httpx', 'HTTPX', 'http-client'),
    ('hypothesis', 'Hypothesis', 'testing'), ('jest', 'Jest', 'testing'), ('langchain', 'LangChain', 'ml'), ('marshmallow', 'marshmallow', 'validation'), ('mocha', 'Mocha', 'testing'),
    ('next', 'Next.js', 'web'), ('numpy', 'NumPy', 'data-science'), ('pandas', 'pandas', 'data-science'), ('peewee', 'Peewee', 'data'), ('psycopg', 'psycopg', 'data'),
    ('psycopg2', 'psycopg2', 'data'), ('pydantic', 'Pydantic', 'validation'), ('pymongo', 'PyMongo', 'data'), ('pyramid', 'Pyramid', 'web'), ('pytest', 'pytest', 'testing'),
    ('react', 'React', 'web'), ('redis', 'redis-py', 'data'), ('requests', 'Requests', 'http-client'), ('rq', 'RQ', 'tasks'), ('sanic', 'Sanic', 'web'),
    ('scikit-learn', 'scikit-learn', 'ml'), ('scipy', 'SciPy', 'data-science'), ('sqlalchemy', 'SQLAlchemy', 'data'), ('starlette', 'Starlette', 'web'), ('svelte', 'Svelte', 'web'),
    ('tensorflow', 'TensorFlow', 'ml'), ('torch', 'PyTorch', 'ml'), ('tornado', 'Tornado', 'web'), ('tortoise-orm', 'Tortoise ORM', 'data'), ('transformers', 'Transformers', 'ml'),
    ('typer', 'Typer', 'cli'), ('unittest2', 'unittest', 'testing'), ('uvicorn', 'Uvicorn', 'server'), ('vitest', 'Vitest', 'testing'), ('vue', 'Vue', 'web')
) c(package, framework, category)"""
#: What parts stand for as dependencies: each name of the catalogue, some written otherwise, and some that it lacks.
_DEPENDENCIES = sorted(x[0] for x in frameworks.FRAMEWORKS)
_WRITTEN = ["Tortoise_ORM", "scikit_learn", "FastAPI", "left-pad", "unknown_lib"]
_DEP_SQL = "list_concat((SELECT list(package ORDER BY package) FROM " + _CAT_SQL + "), ['Tortoise_ORM', 'scikit_learn', 'FastAPI', 'left-pad', 'unknown_lib'])"


def _packages(spark, d):
    p = table(spark, d, "part")
    return p.groupBy(F.lower("p_brand").alias("package")).agg(F.bool_or(F.col("p_size") > 25).alias("pinned"), F.countDistinct("p_type").alias("n_manifests"))


@query("SELECT lower(p_brand) AS package, bool_or(p_size > 25) AS pinned, count(DISTINCT p_type) AS n_manifests FROM part GROUP BY 1")
def dependency_rollup(spark, d):
    return _packages(spark, d)


@query(f"""WITH n AS (SELECT {_DEP_SQL} AS names), p AS (SELECT replace(lower(names[p_partkey % 56 + 1]), '_', '-') AS package, count(*) AS n FROM part, n GROUP BY 1)
    SELECT package, framework, category, n FROM p JOIN {_CAT_SQL} USING (package)""")
def framework_lookup(spark, d):
    """Parts as dependencies; the catalogue is small and fixed, so it is broadcast."""
    written = F.get(F.array(*map(F.lit, [*_DEPENDENCIES, *_WRITTEN])), (F.col("p_partkey") % 56).cast("int"))
    used = table(spark, d, "part").groupBy(frameworks.package_key(written).alias("package")).agg(F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame(frameworks.FRAMEWORKS, "package string, framework string, category string")
    return used.join(F.broadcast(known), "package").select("package", "framework", "category", "n")


@query("""WITH h AS (SELECT p_partkey AS id, name AS hint, category FROM part JOIN (VALUES ('ring', 'Ring routes', 'web'), ('bolt', 'Bolt tests', 'testing'), ('gear', 'Gear jobs', 'jobs')) v(word, name, category) ON instr(p_name, word) > 0),
    f AS (SELECT hint, category, min(id) AS first_id FROM h GROUP BY ALL) SELECT * FROM f WHERE category NOT IN ('web')""")
def framework_hints(spark, d):
    """Hints by pattern, each at its first entity; a category that a dependency explains needs none."""
    words = [("ring", "Ring routes", "web"), ("bolt", "Bolt tests", "testing"), ("gear", "Gear jobs", "jobs")]
    hints = spark.createDataFrame(words, "word string, hint string, category string")
    matches = F.array_compact(F.array(*[F.when(F.col("p_name").rlike(w), F.lit(w)) for w, _, _ in words]))
    found = table(spark, d, "part").select("p_partkey", F.explode(matches).alias("word")).join(F.broadcast(hints), "word")
    explained = spark.createDataFrame([("web",)], "category string")
    return found.groupBy("hint", "category").agg(F.min("p_partkey").alias("first_id")).join(explained, "category", "left_anti").select("hint", "category", "first_id")


@query("""SELECT k AS package, count(*) AS n, bool_or(regexp_matches(v, '^[0-9]')) AS pinned FROM (SELECT unnest(json_keys(props)) AS k, json_extract_string(props, '$.k') AS v FROM events) t GROUP BY k""")
def manifest_json(spark, d):
    m = table(spark, d, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("package", "version"))
    return m.groupBy("package").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("version").rlike("^[0-9]")).alias("pinned"))


_VOTES = {"pytest-like": "^The", "unit-like": "^An", "other": "\\.$"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS framework, count(*) AS votes FROM conversations WHERE regexp_matches(text, '{v}')" for k, v in _VOTES.items()))
def test_conventions(spark, d):
    c = table(spark, d, "conversations").agg(*[F.count_if(F.col("text").rlike(v)).alias(k) for k, v in _VOTES.items()])
    return c.select(F.explode(F.array(*[F.struct(F.lit(k).alias("framework"), F.col(f"`{k}`").alias("votes")) for k in _VOTES])).alias("x")).select("x.*")


@query("""SELECT page_id, CASE WHEN url LIKE '%readme%' THEN 'readme' WHEN url LIKE '%contributing%' THEN 'contributing' WHEN url LIKE '%changelog%' THEN 'changelog' WHEN regexp_matches(url, '/(en|docs)/') THEN 'docs' ELSE 'other' END AS role FROM pages""")
def doc_roles(spark, d):
    u = F.lower("url")
    role = F.when(F.contains(u, F.lit("readme")), "readme").when(F.contains(u, F.lit("contributing")), "contributing").when(F.contains(u, F.lit("changelog")), "changelog").when(u.rlike("/(en|docs)/"), "docs").otherwise("other")
    return table(spark, d, "pages").select("page_id", role.alias("role"))


@query(with_views("files") + " SELECT package, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) AS n_files FROM files GROUP BY package")
def footprint(spark, d):
    return inventory.footprint(files(spark, d), "package")


@query("SELECT user_id, event_type AS stage, arg_max(value > 50, {'t': ts, 'e': event_id}) AS completed, count(*) AS n FROM events GROUP BY ALL")
def status_stages(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("stage")).agg(F.max_by(F.col("value") > 50, F.struct("ts", "event_id")).alias("completed"), F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events),
    s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n, count(DISTINCT k) AS n_sessions FROM s GROUP BY user_id""")
def session_window_ext(spark, d):
    """An extension: sessions of a user's events, half an hour apart."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.col("ts") - F.lag("ts").over(by) <= F.expr("interval 30 minutes"), 0).otherwise(1)
    return e.withColumn("new", new).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("new").alias("n_sessions"))


_STAGES = [("start", "(?i)licen[sc]e"), ("secrets", "token = "), ("contact", "@"), ("numbers", "[0-9]{13,16}"), ("absent", "zzzzzz")]
_STAGE_SQL = " UNION ALL ".join(f"SELECT {i + 1} AS ord, '{k}' AS stage, count(*) AS n_files FROM documents WHERE regexp_matches(text, '{v}')" for i, (k, v) in enumerate(_STAGES))


def _stages(spark, d):
    c = table(spark, d, "documents").agg(*[F.count_if(F.col("text").rlike(v)).alias(k) for k, v in _STAGES])
    return c.select(F.explode(F.array(*[F.struct(F.lit(i + 1).cast("long").alias("ord"), F.lit(k).alias("stage"), F.col(k).alias("n_files")) for i, (k, _) in enumerate(_STAGES)])).alias("x")).select("x.*")


@query(f"SELECT ord, stage, n_files, n_files > 0 AS detected FROM ({_STAGE_SQL}) t")
def stage_detection(spark, d):
    return _stages(spark, d).withColumn("detected", F.col("n_files") > 0)


@query(f"SELECT stage, row_number() OVER (ORDER BY ord) AS day FROM ({_STAGE_SQL}) t WHERE n_files > 0")
def learning_path(spark, d):
    return _stages(spark, d).filter("n_files > 0").select("stage", F.row_number().over(Window.orderBy("ord")).alias("day"))


@query("""WITH s AS (SELECT 1 AS pr, doc_id, doc_id AS o FROM documents WHERE doc_id < 3 UNION ALL SELECT 2, doc_id, -n_chars FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 6)
      UNION ALL SELECT 3, doc_id, doc_id FROM (SELECT * FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 6)),
    f AS (SELECT doc_id, pr, o, row_number() OVER (PARTITION BY doc_id ORDER BY pr, o) AS k FROM s) SELECT doc_id, pr, row_number() OVER (ORDER BY pr, o, doc_id) AS position FROM f WHERE k = 1 ORDER BY position LIMIT 10""")
def reading_order_merge(spark, d):
    """Sources by priority, each document at its first place, ten in all."""
    docs = table(spark, d, "documents")
    one = docs.filter("doc_id < 3").select(F.lit(1).alias("pr"), "doc_id", F.col("doc_id").alias("o"))
    two = docs.orderBy(F.desc("n_chars"), "doc_id").limit(6).select(F.lit(2).alias("pr"), "doc_id", (-F.col("n_chars")).alias("o"))
    three = docs.filter("lang = 'de'").orderBy("doc_id").limit(6).select(F.lit(3).alias("pr"), "doc_id", F.col("doc_id").alias("o"))
    first = one.union(two).union(three).groupBy("doc_id").agg(F.min(F.struct("pr", "o")).alias("x")).select("doc_id", "x.pr", "x.o").orderBy("pr", "o", "doc_id").limit(10)
    return first.select("doc_id", "pr", F.row_number().over(Window.orderBy("pr", "o", "doc_id")).alias("position"))


@query("""SELECT doc_id, source || '/doc_' || doc_id || '.txt::' || lang AS entity, source || '/doc_' || doc_id || '.txt' AS file, substr(string_split(trim(text), chr(10))[1], 1, 160) AS first_line, 'text' AS fence FROM documents""")
def entity_labels(spark, d):
    path = F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    e = table(spark, d, "documents").select("doc_id", paths.entity_id(path, F.col("lang")).alias("entity"), path.alias("path"), "text")
    return e.select("doc_id", "entity", paths.file_of(F.col("entity")).alias("file"), F.substring(F.split(F.trim("text"), "\n")[0], 1, 160).alias("first_line"), paths.language_of(F.col("path")).alias("fence"))


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]*/?', ''), '[?#].*$', '') AS path FROM pages)
    SELECT page_id, replace(path, '/', '.') AS dotted, regexp_matches(replace(path, '/', '.'), '^[A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)*$') AS plain, array_to_string(string_split(path, '/')[1:-2], '.') AS parent FROM p""")
def dotted_names(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/?", ""), "[?#].*$", "")
    parts = F.split(path, "/")
    dotted = F.replace(path, F.lit("/"), F.lit("."))
    return table(spark, d, "pages").select("page_id", dotted.alias("dotted"), dotted.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$").alias("plain"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".").alias("parent"))


@query("""WITH b AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) AS block, generate_subscripts(regexp_split_to_array(text, '\\n\\s*\\n'), 1) AS i FROM documents),
    l AS (SELECT doc_id, i, regexp_replace(unnest(string_split(block, chr(10))), '^\\s+|\\s+$', '', 'g') AS line, generate_subscripts(string_split(block, chr(10)), 1) AS j FROM b),
    p AS (SELECT doc_id, i, string_agg(line, ' ' ORDER BY j) AS para FROM l WHERE line <> '' AND NOT regexp_matches(line, '^(#|\\[!\\[|!\\[|<|\\||```|---|===|>)') GROUP BY doc_id, i)
    SELECT doc_id, substr(arg_min(para, i) FILTER (length(para) >= 20), 1, 400) AS first FROM documents LEFT JOIN p USING (doc_id) GROUP BY doc_id""")
def first_paragraph(spark, d):
    return table(spark, d, "documents").select("doc_id", text.first_paragraph(F.col("text")).alias("first"))


@query("SELECT doc_id, source || ' | ' || lang || chr(10) || text AS passage, '[' || row_number() OVER (PARTITION BY source ORDER BY doc_id) || '] ' || source AS header FROM documents")
def passages(spark, d):
    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, d, "documents").select("doc_id", F.concat(F.concat_ws(" | ", "source", "lang"), F.lit("\n"), "text").alias("passage"), F.format_string("[%d] %s", nth, F.col("source")).alias("header"))


@query("SELECT page_id, trim(regexp_replace(html, '<script>.*?</script>\\s*', '', 'gs')) AS html FROM pages")
def strip_blocks(spark, d):
    return table(spark, d, "pages").select("page_id", ft.strip_blocks(F.col("html"), "script").alias("html"))


@query("""SELECT conv_id, turn, len(list_filter(string_split(text, ' '), lambda w: NOT (w IN ('the', 'of')))) AS n_real, len(list_filter(string_split(text, ' '), lambda w: instr(w, 'get') > 0 OR instr(w, 'tion') > 0)) > 0 AS has_route FROM conversations""")
def array_predicates(spark, d):
    w = F.split("text", " ")
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(F.filter(w, lambda x: ~x.isin("the", "of"))).cast("long").alias("n_real"), F.exists(w, lambda x: F.contains(x, F.lit("get")) | F.contains(x, F.lit("tion"))).alias("has_route"))


@query("SELECT doc_id, substr(sha1(CAST(doc_id AS VARCHAR)), 1, 12) AS session, regexp_matches(substr(sha1(CAST(doc_id AS VARCHAR)), 1, 12), '^[a-f0-9]{12}$') AS ok, CASE WHEN strlen(text) < 1024 THEN strlen(text) || ' B' ELSE CAST(CAST(round(strlen(text) / 1024, 1) AS DECIMAL(20, 1)) AS VARCHAR) || ' KB' END AS size FROM documents")
def format_and_id_checks(spark, d):
    s = F.substring(F.sha1(F.col("doc_id").cast("string")), 1, 12)
    return table(spark, d, "documents").select("doc_id", s.alias("session"), paths.is_session_id(s).alias("ok"), paths.byte_label(F.octet_length("text")).alias("size"))


@query(with_views("lines") + _SEGMENTS + """, c AS (SELECT doc_id, 'segment' AS type FROM seg UNION ALL SELECT doc_id, 'document' FROM documents WHERE length(text) <= 2000 UNION ALL SELECT doc_id, 'config' FROM documents WHERE instr(text, ' = ') > 0)
    SELECT type, count(*) AS n, count(DISTINCT doc_id) AS n_files FROM c GROUP BY type""")
def chunk_summary(spark, d):
    docs = table(spark, d, "documents")
    parts = [_segments(spark, d).select("doc_id", F.lit("segment").alias("type")), docs.filter(F.length("text") <= 2000).select("doc_id", F.lit("document")), docs.filter(F.instr("text", " = ") > 0).select("doc_id", F.lit("config"))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_files"))


@query(with_views("edges", "entities") + """, n AS (SELECT dst AS id, count(*) AS c FROM edges WHERE relation IN ('calls', 'inherits') GROUP BY dst), r AS (SELECT id, 1 AS pr, c FROM entities JOIN n USING (id) WHERE type = 'class' ORDER BY c DESC, id LIMIT 6),
    x AS (SELECT id, 2 AS pr, c FROM entities JOIN n USING (id) WHERE type = 'file' ORDER BY c DESC, id LIMIT 6) SELECT id, pr, c FROM r UNION ALL SELECT id, pr, c FROM x WHERE id NOT IN (SELECT src FROM edges WHERE dst IN (SELECT id FROM r))""")
def evidence_selection(spark, d):
    e = edges(spark, d)
    n = e.filter(F.col("relation").isin("calls", "inherits")).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    all_ = entities(spark, d).join(n, "id")
    top = lambda kind, pr: all_.filter(F.col("type") == kind).orderBy(F.desc("c"), "id").limit(6).select("id", F.lit(pr).alias("pr"), "c")
    first = top("class", 1)
    near = e.join(first.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    return first.unionByName(top("file", 2).join(near, "id", "left_anti"))


@query(with_views("files") + """ SELECT (SELECT count(*) FROM files WHERE line_count > 20) AS n_long, (SELECT round(count(l.doc_id) / count(*), 6) FROM documents LEFT JOIN labels l USING (doc_id)) AS coverage, (SELECT count(DISTINCT lower(p_brand)) FROM part) AS n_packages, (SELECT count(*) FROM documents WHERE regexp_matches(text, 'token = ')) AS n_secrets""")
def health_row(spark, d):
    docs = table(spark, d, "documents")
    long_ = files(spark, d).agg(F.count_if(F.col("line_count") > 20).alias("n_long"))
    cover = docs.join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("k")), "doc_id", "left").agg(F.round(F.count("k") / F.count(F.lit(1)), 6).alias("coverage"))
    packs = table(spark, d, "part").agg(F.countDistinct(F.lower("p_brand")).alias("n_packages"))
    secrets = docs.agg(F.count_if(F.col("text").rlike("token = ")).alias("n_secrets"))
    return long_.join(cover).join(packs).join(secrets)


@query("""SELECT 'language' AS part, lang AS item, count(*) AS value FROM documents GROUP BY lang UNION ALL SELECT 'package', p_type, count(DISTINCT p_brand) FROM part GROUP BY p_type UNION ALL
    SELECT 'relation', l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag""")
def onboarding_rows(spark, d):
    g = lambda part, t, by, agg: table(spark, d, t).groupBy(by).agg(agg.alias("value")).select(F.lit(part).alias("part"), F.col(by).alias("item"), "value")
    n = F.count(F.lit(1))
    return g("language", "documents", "lang", n).union(g("package", "part", "p_type", F.countDistinct("p_brand"))).union(g("relation", "lineitem", "l_returnflag", n))

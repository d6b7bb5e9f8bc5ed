"""Queries of the inventory, the graphs and the closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import paths
from marlstone.operators import graph, guide, impact, inventory
from marlstone.operators.stored import bucketed, settle
from marlstone.operators.views import edges, entities, files, lines, table, tree, with_views

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


LONG = "bigint"


@query(with_views("files") + " SELECT doc_id, path, package, language, size_bytes, line_count FROM files")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("doc_id", "path", "package", "language", "size_bytes", "line_count")


@query("SELECT lang AS language, count(*) AS n_files, min(doc_id) AS first_seen FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def language_counts(spark, d):
    return inventory.language_counts(files(spark, d), "doc_id")


@query("""WITH c AS (SELECT source AS language, count(*) AS n_files, min(doc_id) AS f FROM documents WHERE source IS NOT NULL GROUP BY source),
    r AS (SELECT *, row_number() OVER (ORDER BY n_files DESC, f) AS k FROM c)
    SELECT CASE WHEN k <= 8 THEN language ELSE 'other' END AS language, CAST(sum(n_files) AS BIGINT) AS n_files FROM r GROUP BY 1""")
def language_top_other(spark, d):
    return inventory.top_and_other(inventory.language_counts(files(spark, d).withColumn("language", F.col("package")), "doc_id"), 8)


@query(with_views("files") + """, s AS (SELECT doc_id, line_count > 3 AS ok FROM files ORDER BY doc_id LIMIT 300),
    r AS (SELECT doc_id, ok, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s)
    SELECT doc_id, CAST(b AS BIGINT) AS included_before FROM r WHERE ok AND b < 100""")
def scan_caps_running(spark, d):
    f = files(spark, d).select("doc_id", (F.col("line_count") > 3).alias("ok"))
    return inventory.within_caps(f, "doc_id", 100, "ok").select("doc_id", "included_before")


@query(with_views("files") + """ SELECT count(*) AS total_seen, count(*) FILTER (WHERE NOT big AND NOT bin AND NOT junk) AS included, count(*) FILTER (WHERE bin) AS skipped_binary,
    count(*) FILTER (WHERE junk AND NOT bin) AS skipped_other, count(*) FILTER (WHERE big AND NOT bin AND NOT junk) AS skipped_large, CAST(sum(size_bytes) AS BIGINT) AS total_bytes
    FROM (SELECT size_bytes, size_bytes > 20000 AS big, instr(text, '|') > 0 AS bin, package IN ('src1', 'src2') AS junk FROM files) t""")
def scan_summary(spark, d):
    f = files(spark, d).select("size_bytes", (F.col("size_bytes") > 20000).alias("big"), (F.instr("text", "|") > 0).alias("bin"), F.col("package").isin("src1", "src2").alias("junk"))
    return f.agg(
        F.count(F.lit(1)).alias("total_seen"), F.count_if(~F.col("big") & ~F.col("bin") & ~F.col("junk")).alias("included"), F.count_if("bin").alias("skipped_binary"),
        F.count_if(F.col("junk") & ~F.col("bin")).alias("skipped_other"), F.count_if(F.col("big") & ~F.col("bin") & ~F.col("junk")).alias("skipped_large"), F.sum("size_bytes").alias("total_bytes"),
    )


@query(with_views("files") + " SELECT path, size_bytes FROM files ORDER BY size_bytes DESC, path LIMIT 8")
def largest_files_topk(spark, d):
    return inventory.largest(files(spark, d), 8).select("path", "size_bytes")


URL_PATH = "regexp_replace(regexp_replace(url, '^https?://[^/]*/?', ''), '[?#].*$', '')"


def _url_path():
    return F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/?", ""), "[?#].*$", "")


@query(f"""WITH p AS (SELECT page_id, {URL_PATH} AS path FROM pages), q AS (SELECT page_id, path, string_split(path, '/') AS parts FROM p)
    SELECT page_id, path, lower(parts[-1]) LIKE 'test\\_%' ESCAPE '\\' OR list_has_any(list_transform(parts[1:-2], lambda x: lower(x)), ['test', 'tests', '__tests__'])
        OR regexp_matches(lower(parts[-1]), '(_test\\.py|_test\\.go|\\.test\\.[jt]sx?|\\.spec\\.[jt]sx?)$') AS is_test,
      lower(parts[-1]) LIKE 'test\\_%' ESCAPE '\\' OR list_has_any(list_transform(parts[1:-2], lambda x: lower(x)), ['test', 'tests', '__tests__']) AS is_test_bare FROM q""")
def test_flag_paths(spark, d):
    p = table(spark, d, "pages").select("page_id", _url_path().alias("path"))
    return p.select("page_id", "path", paths.is_test_file(F.col("path")).alias("is_test"), paths.is_test_file(F.col("path"), False).alias("is_test_bare"))


# Fixed values, written apart from those of the operators.
_ENTRY_SQL = """('__main__.py', 'app.js', 'app.py', 'application.py', 'asgi.py', 'cli.py', 'index.js', 'index.ts', 'main.go', 'main.py', 'main.rs', 'manage.py', 'run.py', 'server.js', 'server.py', 'wsgi.py')"""
_PROJECT_SQL = """('.env.example', '.gitignore', 'build.gradle', 'cargo.toml', 'compose.yaml', 'compose.yml', 'constraints.txt', 'docker-compose.yaml', 'docker-compose.yml', 'dockerfile', 'gemfile', 'go.mod', 'go.sum',
    'license', 'license.md', 'license.txt', 'makefile', 'manage.py', 'package-lock.json', 'package.json', 'pipfile', 'pipfile.lock', 'pnpm-lock.yaml', 'poetry.lock', 'pom.xml', 'pyproject.toml', 'readme', 'readme.md', 'readme.rst',
    'readme.txt', 'requirements-dev.txt', 'requirements.txt', 'setup.cfg', 'setup.py', 'tsconfig.json', 'yarn.lock')"""
# Names that pages lack, so that each list is tested whole: page k's is the k-th.
_NAME_SQL = f"""list_concat(list_value{_ENTRY_SQL}, list_value{_PROJECT_SQL}, ['other.py', 'Main.PY', 'README.md', 'main.pyc'])"""


@query(f"""WITH p AS (SELECT page_id, {URL_PATH} || '/' || ({_NAME_SQL})[page_id % 56 + 1] AS path FROM pages), q AS (SELECT page_id, lower(string_split(path, '/')[-1]) AS name, path FROM p)
    SELECT page_id, name IN {_ENTRY_SQL} AS is_entry, name IN {_PROJECT_SQL} AS is_project,
      CASE WHEN path LIKE '%/%' THEN string_split(path, '/')[1] ELSE '(root)' END AS package, lower(regexp_extract(name, '\\.([^.]+)$', 1)) AS extension FROM q""")
def entry_flags(spark, d):
    names = F.array(*map(F.lit, [*sorted(paths.ENTRY_NAMES), *sorted(paths.PROJECT_NAMES), "other.py", "Main.PY", "README.md", "main.pyc"]))
    p = table(spark, d, "pages").select("page_id", F.concat(_url_path(), F.lit("/"), F.get(names, (F.col("page_id") % 56).cast("int"))).alias("path"))
    x = F.col("path")
    return p.select("page_id", paths.is_entry_point(x).alias("is_entry"), paths.is_project_file(x).alias("is_project"), paths.package_of(x).alias("package"), paths.extension_of(x).alias("extension"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://github.com/o' || page_id || '/repo.git' WHEN 1 THEN 'http://www.github.com/a.b/c-' || page_id || '/' WHEN 2 THEN 'https://github.com/x/../y' ELSE url END AS u FROM pages),
    m AS (SELECT page_id, regexp_extract(u, '^https?://(?:www\\.)?github\\.com(?::(?:80|443))?/([A-Za-z0-9._-]+)/([A-Za-z0-9._-]+?)(?:\\.git)?/?$', 1) AS o,
      regexp_extract(u, '^https?://(?:www\\.)?github\\.com(?::(?:80|443))?/([A-Za-z0-9._-]+)/([A-Za-z0-9._-]+?)(?:\\.git)?/?$', 2) AS n FROM p)
    SELECT page_id, o <> '' AND n <> '' AS ok, CASE WHEN o <> '' AND n <> '' THEN 'https://github.com/' || o || '/' || n || '.git' END AS address, CASE WHEN o <> '' AND n <> '' THEN n END AS name FROM m""")
def url_normalize(spark, d):
    k, i = F.col("page_id") % 4, F.col("page_id").cast("string")
    u = F.when(k == 0, F.concat(F.lit("https://github.com/o"), i, F.lit("/repo.git"))).when(k == 1, F.concat(F.lit("http://www.github.com/a.b/c-"), i, F.lit("/"))).when(k == 2, "https://github.com/x/../y").otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", paths.repository_address(u).alias("r")).select("page_id", "r.*")


@query("""WITH m AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN lower(p_name) = 'red' THEN 0 WHEN lower(p_name) LIKE 'red%' THEN 1 WHEN instr(lower(p_name), 'red') > 0 THEN 2
      WHEN instr(lower(p_brand || '::' || p_name), 'red') > 0 THEN 3 END AS rank, length(p_brand || '::' || p_name) AS len FROM part)
    SELECT id, name, CAST(rank AS BIGINT) AS rank FROM m WHERE rank IS NOT NULL ORDER BY rank, len, id LIMIT 20""")
def entity_search_ranked(spark, d):
    return search(entities(spark, d), "red").select("id", "name", "rank").limit(20)


def search(found: DataFrame, wanted: str) -> DataFrame:
    """Entities whose name or id has the text, the closest first."""
    name, long_id = F.lower("name"), F.concat_ws("::", "file", "name")
    rank = F.when(name == wanted, 0).when(name.startswith(wanted), 1).when(F.contains(name, F.lit(wanted)), 2).when(F.contains(F.lower(long_id), F.lit(wanted)), 3)
    return found.withColumn("rank", rank.cast(LONG)).filter("rank is not null").orderBy("rank", F.length(long_id), "id")


@query(with_views("entities") + """, m AS (SELECT id, name, type, CASE WHEN lower(name) = '1' THEN 0 WHEN lower(name) LIKE '1%' THEN 1 WHEN instr(lower(name), '1') > 0 THEN 2 WHEN instr(lower(file || '::' || name), '1') > 0 THEN 3 END AS rank,
    length(file || '::' || name) AS len FROM entities), t AS (SELECT * FROM m WHERE rank IS NOT NULL ORDER BY rank, len, id LIMIT 36)
    SELECT id, name, type FROM t WHERE type IN ('class', 'method') ORDER BY rank, len, id LIMIT 12""")
def entity_search_typed(spark, d):
    """The types are looked at only after three times the limit is fetched."""
    first = search(entities(spark, d), "1").limit(36)
    return first.filter(F.col("type").isin("class", "method")).orderBy("rank", F.length(F.concat_ws("::", "file", "name")), "id").limit(12).select("id", "name", "type")


@query(with_views("entities", "edges") + """, n AS (SELECT dst AS id, count(*) AS dependents FROM edges GROUP BY dst)
    SELECT id, name, coalesce(dependents, 0) AS dependents FROM entities LEFT JOIN n USING (id) ORDER BY dependents DESC, id LIMIT 25""")
def entity_default_listing(spark, d):
    e = entities(spark, d).join(graph.dependents(edges(spark, d)), "id", "left").fillna(0, ["dependents"])
    return e.orderBy(F.desc("dependents"), "id").limit(25).select("id", "name", "dependents")


@query(with_views("edges") + " SELECT relation, count(*) AS n FROM edges GROUP BY relation")
def edge_counts_by_relation(spark, d):
    return edges(spark, d).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_name AS module, p_partkey AS id, p_brand AS brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY CASE WHEN p_brand LIKE '%1' THEN 0 ELSE 1 END, p_partkey) AS k FROM part) t WHERE k = 1""")
def module_map_dedupe(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("module"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    return graph.first_of(p, ["module"], (~F.col("brand").endswith("1")), F.col("id"))


@query("""WITH c AS (SELECT o_custkey AS file, o_orderkey AS stmt, 0 AS ord, 'nation_' || (o_orderkey % 25) AS module FROM orders
      UNION ALL SELECT o_custkey, o_orderkey, 1, 'nation_' || (o_orderkey % 25) || '.n' || (o_orderkey % 3) FROM orders),
    m AS (SELECT 'nation_' || n_nationkey AS module, n_nationkey AS target FROM nation UNION ALL SELECT 'nation_' || n_nationkey || '.n1', 100 + n_nationkey FROM nation),
    j AS (SELECT file, target, stmt, row_number() OVER (PARTITION BY file, target ORDER BY stmt, ord) AS k FROM c JOIN m USING (module) WHERE file % 25 <> target)
    SELECT file, CAST(target AS BIGINT) AS target, stmt AS first_stmt FROM j WHERE k = 1""")
def import_resolution(spark, d):
    """Base modules, then their names as submodules, joined with the module map; the first statement counts."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("stmt"))
    base = F.concat(F.lit("nation_"), (F.col("stmt") % 25).cast("string"))
    names = F.array(base, F.concat(base, F.lit(".n"), (F.col("stmt") % 3).cast("string")))
    wanted = o.select("file", "stmt", F.posexplode(names).alias("ord", "module"))
    n = table(spark, d, "nation")
    key = F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string"))
    modules = n.select(key.alias("module"), F.col("n_nationkey").alias("target")).union(n.select(F.concat(key, F.lit(".n1")), F.col("n_nationkey") + 100))
    hit = wanted.join(modules, "module").filter(F.col("file") % 25 != F.col("target"))
    return hit.groupBy("file", F.col("target").cast(LONG).alias("target")).agg(F.min(F.struct("stmt", "ord")).alias("first")).select("file", "target", F.col("first.stmt").alias("first_stmt"))


@query(with_views("tree") + " SELECT parent AS source, child AS target, 'contains' AS relation FROM tree")
def contains_edges(spark, d):
    return tree(spark, d).select(F.col("parent").alias("source"), F.col("child").alias("target"), F.lit("contains").alias("relation"))


@query(with_views("tree") + """, w AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS id, 0 AS level FROM region UNION ALL SELECT w.root, t.child, w.level + 1 FROM w JOIN tree t ON t.parent = w.id WHERE w.level < 3)
    SELECT root, level, count(*) AS n, min(id) AS first FROM w GROUP BY root, level""")
def members_closure(spark, d):
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    return graph.descendants(tree(spark, d), roots, 3).groupBy("root", "level").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query(with_views("tree") + """, a AS (SELECT child, parent AS at, parent IN ('n3', 'n7', 'r2') AS hit, 1 AS k FROM tree UNION ALL SELECT a.child, t.parent, t.parent IN ('n3', 'n7', 'r2'), k + 1 FROM a JOIN tree t ON t.child = a.at WHERE k < 3)
    SELECT child, bool_or(hit) AS inside FROM a GROUP BY child""")
def ancestor_flag(spark, d):
    return graph.has_ancestor(tree(spark, d), F.col("parent").isin("n3", "n7", "r2"), 3)


_FILE_EDGES = """, fe AS (SELECT a.file AS source, b.file AS target, relation, count(*) AS n FROM edges JOIN entities a ON a.id = src JOIN entities b ON b.id = dst WHERE a.file <> b.file GROUP BY ALL),
    dg AS (SELECT file, sum(n) AS degree FROM (SELECT source AS file, n FROM fe UNION ALL SELECT target, n FROM fe) t GROUP BY file),
    top AS (SELECT file, degree FROM dg ORDER BY degree DESC, file LIMIT 15)"""


@query(with_views("edges", "entities") + _FILE_EDGES + " SELECT source, target, relation, n FROM fe WHERE source IN (SELECT file FROM top) AND target IN (SELECT file FROM top)")
def file_graph_edges(spark, d):
    return graph.file_graph(edges(spark, d), entities(spark, d), 15)[1]


@query(with_views("edges", "entities") + _FILE_EDGES + """, na AS (SELECT file, count(*) FILTER (type = 'class') AS n_classes, count(*) FILTER (type IN ('function', 'method')) AS n_functions FROM entities GROUP BY file)
    SELECT file, CAST(degree AS BIGINT) AS degree, n_classes, n_functions FROM top JOIN na USING (file)""")
def file_graph_nodes(spark, d):
    e = entities(spark, d)
    own = e.groupBy("file").agg(F.count_if(F.col("type") == "class").alias("n_classes"), F.count_if(F.col("type").isin("function", "method")).alias("n_functions"))
    return graph.file_graph(edges(spark, d), e, 15)[0].join(own, "file")


_FOCUS = """, s AS (SELECT dst AS id FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
    u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), l1 AS (SELECT DISTINCT u.dst AS id FROM u JOIN s ON u.src = s.id WHERE u.dst NOT IN (SELECT id FROM s)),
    l2 AS (SELECT DISTINCT u.dst AS id FROM u JOIN l1 ON u.src = l1.id WHERE u.dst NOT IN (SELECT id FROM s UNION SELECT id FROM l1)),
    near AS (SELECT id, 0 AS level FROM s UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2),
    dg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) t GROUP BY id),
    top AS (SELECT id, level, coalesce(degree, 0) AS degree FROM near LEFT JOIN dg USING (id) ORDER BY level, degree DESC, id LIMIT 30)"""


@query(with_views("edges") + _FOCUS + " SELECT * FROM top")
def focus_graph(spark, d):
    e = settle(edges(spark, d), "edges")
    return graph.focus_graph(e, graph.best_target(e), 2, 30)[0]


@query(with_views("edges") + _FOCUS + " SELECT src, dst, relation FROM edges WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top)")
def focus_graph_edges(spark, d):
    e = settle(edges(spark, d), "edges")
    return graph.focus_graph(e, graph.best_target(e), 2, 30)[1]


_IMPACT = """, s AS (SELECT dst AS id FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
    k AS (SELECT dst AS tgt, src AS id, relation, CASE relation WHEN 'calls' THEN 1 WHEN 'inherits' THEN 2 ELSE 3 END AS o, x.type = 'file' AS f FROM edges LEFT JOIN entities x ON x.id = dst),
    i1 AS (SELECT k.id, min({'s': [s.id, o, k.id], 'r': relation, 'a': k.tgt}) AS h FROM k JOIN s ON k.tgt = s.id WHERE (relation <> 'imports' OR f) AND k.id NOT IN (SELECT id FROM s) GROUP BY k.id),
    i2 AS (SELECT k.id, min({'s': list_concat(i1.h.s, [o, k.id]), 'r': relation, 'a': k.tgt}) AS h FROM k JOIN i1 ON k.tgt = i1.id WHERE (relation <> 'imports' OR f) AND k.id NOT IN (SELECT id FROM s UNION SELECT id FROM i1) GROUP BY k.id),
    i3 AS (SELECT k.id, min({'s': list_concat(i2.h.s, [o, k.id]), 'r': relation, 'a': k.tgt}) AS h FROM k JOIN i2 ON k.tgt = i2.id WHERE (relation <> 'imports' OR f) AND k.id NOT IN (SELECT id FROM s UNION SELECT id FROM i1 UNION SELECT id FROM i2) GROUP BY k.id),
    im AS (SELECT id, depth, h.r AS via, h.a AS through FROM (SELECT id, 1 AS depth, h FROM i1 UNION ALL SELECT id, 2, h FROM i2 UNION ALL SELECT id, 3, h FROM i3) t ORDER BY depth, h.s LIMIT 500)"""


def _impact(spark, d):
    e, n = bucketed(edges(spark, d), "dst", "edges-into"), entities(spark, d)
    return graph.impact(e, n, graph.best_target(e), 3, 500)


@query(with_views("edges", "entities") + _IMPACT + " SELECT id, depth, via, through FROM im")
def impact_provenance(spark, d):
    return _impact(spark, d).select("id", "depth", "via", "through")


@query(with_views("edges", "entities") + _IMPACT + " SELECT depth, count(*) AS n FROM im GROUP BY depth")
def impact_levels(spark, d):
    return _impact(spark, d).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


_COUNTS = """, ct AS (SELECT count(*) FILTER (depth = 1 AND via = 'calls') AS callers, count(*) FILTER (depth = 1 AND via = 'imports') AS importers, count(*) FILTER (depth = 1 AND via = 'inherits') AS subclasses,
    count(*) FILTER (depth > 1) AS transitive, count(DISTINCT file) AS files, count(*) FILTER (depth = 1 AND span % 10 <> 0) AS direct, count(*) AS n FROM im JOIN entities USING (id))"""


def _impact_counts(spark, d):
    found = _impact(spark, d).join(entities(spark, d), "id")
    one = F.col("depth") == 1
    return found.agg(
        F.count_if(one & (F.col("via") == "calls")).alias("callers"), F.count_if(one & (F.col("via") == "imports")).alias("importers"), F.count_if(one & (F.col("via") == "inherits")).alias("subclasses"),
        F.count_if(F.col("depth") > 1).alias("transitive"), F.countDistinct("file").alias("files"), F.count_if(one & (F.col("span") % 10 != 0)).alias("direct"), F.count(F.lit(1)).alias("n"),
    )


@query(with_views("edges", "entities") + _IMPACT + _COUNTS + " SELECT callers, importers, subclasses, transitive, files FROM ct")
def impact_counts(spark, d):
    return _impact_counts(spark, d).select("callers", "importers", "subclasses", "transitive", "files")


@query(with_views("edges", "entities") + _IMPACT + _COUNTS + " SELECT CASE WHEN direct >= 4 OR files >= 4 OR subclasses >= 2 THEN 'HIGH' WHEN n >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM ct")
def impact_level_label(spark, d):
    c = F.col
    return _impact_counts(spark, d).select(graph.impact_level(c("direct"), c("files"), c("subclasses"), c("n")).alias("level"))


@query(with_views("edges", "entities") + _IMPACT + """ SELECT im.id, depth, via, file, name, span, span % 10 = 0 AS is_test FROM im JOIN entities USING (id) ORDER BY depth, is_test, file, span, id LIMIT 50""")
def impact_report(spark, d):
    found = _impact(spark, d).join(entities(spark, d), "id").withColumn("is_test", F.col("span") % 10 == 0)
    return found.orderBy("depth", "is_test", "file", "span", "id").limit(50).select("id", "depth", "via", "file", "name", "span", "is_test")


#: Parts by fives: a file with a class, two functions, and a method of the class.
_PLACES = ", places AS (SELECT id, type, file, span % 10 = 0 AS is_test, span % 10 = 1 AS is_entry, name, span FROM entities)"
#: The targets: the five things that most depends on, and the files that hold them. Their members in the walk's order.
_SEEDS = """, top AS (SELECT dst FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 5), tg AS (SELECT dst AS target FROM top UNION SELECT dst - dst % 5 FROM top),
    sd AS (SELECT t.target, p.id, CASE WHEN p.id = t.target THEN 0 WHEN t.target % 5 = 0 THEN CASE p.id % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 3 ELSE 4 END ELSE 1 END AS rank FROM tg t JOIN entities x ON x.id = t.target JOIN entities p ON p.id = t.target OR (t.target % 5 = 0 AND p.id BETWEEN t.target + 1 AND t.target + 4) OR (t.target % 5 = 1 AND p.id = t.target + 2)),
    k AS (SELECT dst AS tgt, src AS id, relation, CASE relation WHEN 'calls' THEN 1 WHEN 'inherits' THEN 2 ELSE 3 END AS o, x.type = 'file' AS f FROM edges JOIN entities y ON y.id = src LEFT JOIN entities x ON x.id = dst),
    j1 AS (SELECT target, k.id, min({'s': [rank, o, k.id], 'r': relation, 'a': k.tgt}) AS h FROM k JOIN sd ON k.tgt = sd.id WHERE (relation <> 'imports' OR f) AND NOT EXISTS (SELECT 1 FROM sd z WHERE z.target = sd.target AND z.id = k.id) GROUP BY target, k.id),
    j2 AS (SELECT target, k.id, min({'s': list_concat(j1.h.s, [o, k.id]), 'r': relation, 'a': k.tgt}) AS h FROM k JOIN j1 ON k.tgt = j1.id WHERE (relation <> 'imports' OR f) AND NOT EXISTS (SELECT 1 FROM sd z WHERE z.target = j1.target AND z.id = k.id)
      AND NOT EXISTS (SELECT 1 FROM j1 z WHERE z.target = j1.target AND z.id = k.id) GROUP BY target, k.id),
    fd AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY depth, h.s) AS nth FROM (SELECT target, id, 1 AS depth, h FROM j1 UNION ALL SELECT target, id, 2, h FROM j2) t),
    rp AS (SELECT target, fd.id, depth, h.r AS via, h.a AS through, type, name, file, span AS start_line, is_test, row_number() OVER (PARTITION BY target ORDER BY depth, is_test, file, span, nth) AS position FROM fd JOIN places USING (id) WHERE nth <= 40)"""


def _parts_tree(spark, d):
    i = F.col("id")
    return entities(spark, d).filter(i % 5 > 0).select(F.when(i % 5 == 3, i - 2).otherwise(i - i % 5).alias("parent"), i.alias("child"), i.alias("ord"))


_AROUND = """, f AS (SELECT dst - dst % 5 AS id FROM (SELECT dst FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1) t), v0 AS (SELECT e.id, 0 AS level FROM entities e, f WHERE e.id BETWEEN f.id AND f.id + 4),
    b AS (SELECT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges), v1 AS (SELECT DISTINCT y AS id, 1 AS level FROM b JOIN v0 ON x = v0.id WHERE y NOT IN (SELECT id FROM v0)),
    v01 AS (SELECT * FROM v0 UNION ALL SELECT * FROM v1), v2 AS (SELECT DISTINCT y AS id, 2 AS level FROM b JOIN v1 ON x = v1.id WHERE y NOT IN (SELECT id FROM v01) AND (SELECT count(*) FROM v01) <= 3 * 25),
    dg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) t GROUP BY id),
    top AS (SELECT id, level, coalesce(degree, 0) AS degree FROM (SELECT * FROM v01 UNION ALL SELECT * FROM v2) t LEFT JOIN dg USING (id) ORDER BY level, degree DESC, id LIMIT 25)"""


def _around(spark, d):
    e = settle(edges(spark, d), "edges")
    best = graph.best_target(e).first()["id"]
    return graph.focus_view(impact.Adjacency(e), entities(spark, d), _parts_tree(spark, d), best - best % 5, 2, 25)


@query(with_views("edges", "entities") + _AROUND + " SELECT * FROM top")
def focus_members(spark, d):
    """What lies around a file and all that it holds."""
    return _around(spark, d)[0]


@query(with_views("edges", "entities") + _AROUND + """ SELECT src, dst, relation FROM (SELECT src, dst, relation FROM edges UNION ALL SELECT CASE WHEN id % 5 = 3 THEN id - 2 ELSE id - id % 5 END, id, 'contains' FROM entities WHERE id % 5 > 0) t
    WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top)""")
def focus_members_edges(spark, d):
    return _around(spark, d)[1]


def _analysed(spark, d):
    e = settle(edges(spark, d), "edges")
    n = entities(spark, d).select("id", "type", "name", "file", F.col("span").alias("start_line"), (F.col("span") % 10 == 0).alias("is_test"), (F.col("span") % 10 == 1).alias("is_entry"))
    top = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst").limit(5)
    targets = top.select(F.col("dst").alias("target")).union(top.select(F.col("dst") - F.col("dst") % 5)).distinct()
    return impact.analysed(impact.Adjacency(e), n, _parts_tree(spark, d), targets, 2, 40)


@query(with_views("edges", "entities") + _PLACES + _SEEDS + " SELECT * FROM rp")
def impact_members(spark, d):
    """What depends on targets or on what they hold, forty things each at most."""
    return _analysed(spark, d)[0]


@query(with_views("edges", "entities") + _PLACES + _SEEDS + """, ct AS (SELECT rp.target, count(*) FILTER (depth = 1 AND via = 'calls') AS callers, count(*) FILTER (depth = 1 AND via = 'imports') AS importers, count(*) FILTER (depth = 1 AND via = 'inherits') AS subclasses, count(*) FILTER (depth > 1) AS transitive,
      count(DISTINCT rp.file) FILTER (rp.file <> x.file OR rp.type = 'file') AS files, count(DISTINCT rp.file) FILTER (rp.is_test) AS tests, count(*) FILTER (depth = 1 AND NOT rp.is_test) AS u FROM rp JOIN places x ON x.id = rp.target GROUP BY rp.target),
    al AS (SELECT tg.target, x.type, x.is_entry, coalesce(callers, 0) AS callers, coalesce(importers, 0) AS importers, coalesce(subclasses, 0) AS subclasses, coalesce(transitive, 0) AS transitive, coalesce(files, 0) AS files, coalesce(tests, 0) AS tests, coalesce(u, 0) AS u,
      (SELECT count(*) - 1 FROM sd WHERE sd.target = tg.target) AS members, coalesce((SELECT max(nth) > 40 FROM fd WHERE fd.target = tg.target), false) AS truncated FROM tg JOIN places x ON x.id = tg.target LEFT JOIN ct USING (target)),
    lv AS (SELECT *, CASE WHEN u >= 4 OR files >= 4 OR subclasses >= 2 THEN 'HIGH' WHEN callers + importers + subclasses + transitive > 0 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM al)
    SELECT target, callers, importers, subclasses, transitive, files, tests, level, array_to_string(list_filter([CASE WHEN callers > 0 THEN callers || ' direct caller' || CASE callers WHEN 1 THEN '' ELSE 's' END END, CASE WHEN importers > 0 THEN 'imported by ' || importers || ' file' || CASE importers WHEN 1 THEN '' ELSE 's' END END,
      CASE WHEN subclasses > 0 THEN subclasses || ' subclass' || CASE subclasses WHEN 1 THEN '' ELSE 'es' END || ' inherit from it' END, CASE WHEN transitive > 0 THEN transitive || ' transitive dependent' || CASE transitive WHEN 1 THEN '' ELSE 's' END END,
      CASE WHEN tests > 0 THEN 'covered by ' || tests || ' test file' || CASE tests WHEN 1 THEN '' ELSE 's' END ELSE 'no test file references it' END, CASE WHEN type = 'class' AND members > 0 THEN 'changing the class touches its ' || members || ' member' || CASE members WHEN 1 THEN '' ELSE 's' END END,
      CASE WHEN is_entry THEN 'lives in an entry point' END, CASE WHEN level = 'LOW' THEN 'no static dependents found' END], lambda x: x IS NOT NULL), '; ') AS reasons, truncated FROM lv""")
def impact_assessment(spark, d):
    """How serious changes of the targets are, and why."""
    return _analysed(spark, d)[1].withColumn("reasons", F.array_join("reasons", "; "))


@query(with_views("edges") + """ SELECT a.id, imported_by, coalesce(imports, 0) AS imports FROM (SELECT dst AS id, count(*) AS imported_by FROM edges WHERE relation = 'imports' GROUP BY dst) a
    LEFT JOIN (SELECT src AS id, count(*) AS imports FROM edges WHERE relation = 'imports' GROUP BY src) b USING (id) ORDER BY imported_by DESC, id LIMIT 8""")
def hubs_topk(spark, d):
    return graph.hubs(edges(spark, d), 8)


@query(with_views("entities") + " SELECT package, count(DISTINCT file) AS n_files, count(*) FILTER (type = 'class') AS n_classes, count(*) FILTER (type IN ('function', 'method')) AS n_functions FROM entities GROUP BY package ORDER BY n_files DESC, package LIMIT 12")
def package_rollup(spark, d):
    return graph.package_rollup(entities(spark, d), 12)


@query(with_views("edges", "entities") + """, far AS (SELECT b.file, a.file AS ff, relation, dst FROM edges JOIN entities a ON a.id = src JOIN entities b ON b.id = dst),
    us AS (SELECT file, count(*) FILTER (relation = 'imports') AS i, count(*) FILTER (relation = 'calls' AND ff <> file) AS c FROM far GROUP BY file), sup AS (SELECT DISTINCT dst FROM edges WHERE relation = 'inherits'),
    ow AS (SELECT file, count(*) FILTER (type = 'class') AS k, count(*) FILTER (type = 'function') AS f, bool_or(type = 'class' AND (id % 7 = 1 OR dst IS NOT NULL)) AS h, bool_or(type = 'file' AND span >= 50) AS e FROM entities LEFT JOIN sup ON dst = id GROUP BY file),
    co AS (SELECT DISTINCT file FROM entities WHERE type <> 'file')
    SELECT file, CAST(CASE WHEN e THEN 6 ELSE 0 END + 3 * least(coalesce(i, 0), 5) + least(coalesce(c, 0), 6) + least(k, 4) + least(f, 4) // 2 + CASE WHEN h THEN 2 ELSE 0 END AS BIGINT) AS score FROM ow JOIN co USING (file) LEFT JOIN us USING (file) WHERE file NOT LIKE '%7'""")
def importance_score(spark, d):
    """Brands as files: those that end in 7 are tests, those with a large file part are entry points."""
    n, repo = entities(spark, d), F.lit(0).alias("repo")
    flags = n.groupBy(F.col("file").alias("path")).agg(F.bool_or((F.col("type") == "file") & (F.col("span") >= 50)).alias("is_entry"))
    tables = flags.select(repo, "path", F.lit("python").alias("language"), "is_entry", F.lit(False).alias("is_project"), F.col("path").endswith("7").alias("is_test"))
    code = n.select(repo, "file", "id", "type", "name", F.col("id").alias("nth"), (F.col("id") % 7 == 1).alias("has_bases"))
    return guide.important_files(tables, code, settle(edges(spark, d).select(repo, "src", "dst", "relation"), "edges")).select(F.col("path").alias("file"), "score")


@query(with_views("edges", "entities") + """, dg AS (SELECT dst AS id, count(*) AS degree FROM edges WHERE relation IN ('calls', 'inherits') GROUP BY dst), f AS (SELECT id, type, coalesce(degree, 0) AS degree FROM entities LEFT JOIN dg USING (id))
    SELECT * FROM (SELECT * FROM f WHERE type = 'class' ORDER BY degree DESC, id LIMIT 8) UNION ALL SELECT * FROM (SELECT * FROM f WHERE type = 'function' AND degree >= 1 ORDER BY degree DESC, id LIMIT 6)""")
def key_concepts(spark, d):
    return graph.key_concepts(edges(spark, d), entities(spark, d), 8, 6)


@query(with_views("edges", "entities") + """, i AS (SELECT dst AS id, count(*) AS n_in FROM edges GROUP BY dst), o AS (SELECT src AS id, count(*) AS n_out FROM edges GROUP BY src)
    SELECT file, count(*) AS n_entities, CAST(sum(coalesce(n_in, 0)) AS BIGINT) AS n_in, CAST(sum(coalesce(n_out, 0)) AS BIGINT) AS n_out FROM entities LEFT JOIN i USING (id) LEFT JOIN o USING (id) GROUP BY file""")
def node_attributes(spark, d):
    e = edges(spark, d)
    both = entities(spark, d).join(graph.dependents(e), "id", "left").join(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("uses")), "id", "left").fillna(0)
    return both.groupBy("file").agg(F.count(F.lit(1)).alias("n_entities"), F.sum("dependents").alias("n_in"), F.sum("uses").alias("n_out"))


@query(with_views("edges", "entities") + """, t AS (SELECT id FROM entities WHERE package LIKE '%STEEL%' OR package LIKE '%1%' OR id % 3 = 0), p AS (SELECT dst AS id FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)
    SELECT src, dst, relation FROM edges WHERE relation IN ('calls', 'imports') AND src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t) AND (src IN (SELECT id FROM p) OR dst IN (SELECT id FROM p) OR src % 2 = 0)""")
def client_views(spark, d):
    e = edges(spark, d)
    n = entities(spark, d).filter(F.col("package").like("%STEEL%") | F.col("package").like("%1%") | (F.col("id") % 3 == 0)).select("id")
    p = graph.best_target(e).select(F.col("id").alias("focus"))
    kept = e.filter(F.col("relation").isin("calls", "imports")).join(n, e["src"] == n["id"], "left_semi").join(n, e["dst"] == n["id"], "left_semi")
    marked = kept.join(p, (F.col("src") == F.col("focus")), "left").withColumnRenamed("focus", "fs").join(p, F.col("dst") == F.col("focus"), "left")
    return marked.filter("fs is not null or focus is not null or src % 2 = 0").select("src", "dst", "relation")


@query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'repository not found or private' WHEN 1 THEN 'repository not found or private' WHEN 2 THEN 'repository not found or private' WHEN 3 THEN 'network unavailable' WHEN 4 THEN 'network unavailable'
    WHEN 5 THEN 'file name too long' WHEN 6 THEN 'clone interrupted' WHEN 7 THEN 'clone interrupted' ELSE 'clone failed' END AS meaning FROM events""")
def clone_errors(spark, d):
    """Events as outputs of failed clones, and what they mean."""
    said = F.array(*map(F.lit, ["remote: Repository NOT FOUND.", "fatal: could not read Username for 'https://github.com'", "Authentication failed for", "Could not resolve host: github.com", "unable to access 'https://'", "error: unable to create file: Filename too long", "transfer closed with outstanding read data", "error: RPC failed; early EOF", "killed"]))
    text = F.concat(F.lit("Cloning into 'x'...\n"), F.get(said, (F.col("event_id") % 9).cast("int")), F.lit("\n"), F.col("event_type"))
    return table(spark, d, "events").select("event_id", paths.clone_error(text).alias("meaning"))


@query(with_views("edges") + """, t AS (SELECT dst AS id FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 5), a AS (SELECT t.id AS target, src AS test, 1 AS pref FROM t JOIN edges ON dst = t.id WHERE relation = 'calls' AND src % 10 = 0),
    b AS (SELECT t.id AS target, src AS test, 2 AS pref FROM t JOIN edges ON dst = t.id WHERE relation = 'imports' AND t.id NOT IN (SELECT target FROM a)),
    r AS (SELECT target, test, row_number() OVER (PARTITION BY target ORDER BY test) AS k FROM (SELECT DISTINCT target, test FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x) y) SELECT target, test FROM r WHERE k <= 4""")
def existing_tests_fallback(spark, d):
    """Callers among tests; only for targets without any, the importers; four of each."""
    e = edges(spark, d)
    t = e.groupBy(F.col("dst").alias("target")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "target").limit(5).select("target")
    into = e.join(t, F.col("dst") == F.col("target")).select("target", F.col("src").alias("test"), "relation")
    direct = into.filter("relation = 'calls' and test % 10 = 0").select("target", "test")
    other = into.filter("relation = 'imports'").select("target", "test").join(direct.select("target").distinct(), "target", "left_anti")
    found = direct.unionByName(other).distinct().withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy("test")))
    return found.filter("k <= 4").select("target", "test")


@query(with_views("lines") + """ SELECT DISTINCT doc_id FROM lines WHERE regexp_matches(line, '(?i)licen[sc]e|token|password')""")
def topic_match(spark, d):
    return lines(files(spark, d)).filter(F.col("line").rlike("(?i)licen[sc]e|token|password")).select("doc_id").distinct()

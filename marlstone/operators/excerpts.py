"""Evidence from what is known of the code: which definitions to show for a change or for tests, and their first lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.findings import masked
from marlstone.operators.stored import settle

# Lines of a target, an enclosing class and others that are shown; how many of each.
IMPACT_TARGET, IMPACT_OTHER, DEPENDENTS = 120, 40, 6
TEST_TARGET, TEST_CLASS, TEST_OTHER, CALLEES, CALLERS, EXISTING = 150, 60, 40, 4, 3, 4


def _dealt(table: DataFrame) -> DataFrame:
    """A table of all that is known of the code: joined by sorting. Names of things shrink so much in a file that its size says little of their
    size in memory, and the driver would have to hold what it broadcasts."""
    return table.hint("merge")


def excerpts(wanted: DataFrame, entities: DataFrame, lines: DataFrame, secrets: DataFrame | None = None) -> DataFrame:
    """wanted (target, ord, role, id, most) with file, symbol, type, start_line, end_line, text: the first most lines of each entity (file, id, type,
    start_line, end_line), from lines (file, line_no, line), with secrets (file, line_no, column, end_column) masked. What has no line has no row."""
    spans = _dealt(entities).filter("type <> 'file'").select("id", "file", "type", "start_line", "end_line")
    # Read for the lines and for the rows.
    cut = _dealt(settle(wanted.join(spans, "id").withColumn("end_line", F.least("end_line", F.col("start_line") + F.col("most") - 1)), "excerpts"))
    ids = cut.select("id", "file", "start_line", "end_line").distinct()
    rows = ids.select("id", "end_line", "file", F.explode(F.sequence("start_line", "end_line")).alias("line_no")).join(lines.select("file", "line_no", "line"), ["file", "line_no"])
    if secrets is not None:
        rows = masked(rows.withColumnRenamed("file", "doc_id"), secrets.withColumnRenamed("file", "doc_id")).withColumnRenamed("doc_id", "file")
    text = rows.groupBy("id", "end_line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"), F.max("line_no").alias("last"))
    out = cut.join(text, ["id", "end_line"])
    return out.select("target", "ord", "role", "id", "file", F.expr("substr(id, instr(id, '::') + 2)").alias("symbol"), "type", "start_line", F.col("last").alias("end_line"), "text")


def _cut(rows: DataFrame, most, *order) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy(*order))).filter(F.col("k") <= most).drop("k")


def impact_evidence(reported: DataFrame, targets: DataFrame, entities: DataFrame) -> DataFrame:
    """(target, ord, role, id, most) for excerpts(): the target, and of the nearest twice DEPENDENTS things in a report of impact those that are no
    files, DEPENDENTS of them, or one more where the target is a file and has no excerpt itself."""
    entities = _dealt(entities)
    own = targets.join(entities.select(F.col("id").alias("target"), (F.col("type") == "file").alias("whole")), "target")
    near = reported.filter((F.col("position") <= 2 * DEPENDENTS) & (F.col("type") != "file")).join(own, "target")
    near = _cut(near, F.when(F.col("whole"), DEPENDENTS + 1).otherwise(DEPENDENTS), "position")
    row = lambda df, role, id_, most, ord_: df.select("target", ord_.alias("ord"), F.lit(role).alias("role"), id_.alias("id"), F.lit(most).alias("most"))
    return row(own.filter("not whole"), "target", F.col("target"), IMPACT_TARGET, F.lit(0)).union(row(near, "dependent", F.col("id"), IMPACT_OTHER, F.col("position")))


def existing_tests(targets: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, id) of the tests of targets (target): what calls it or what holds it from a test file; only where nothing does, the test functions of
    test files that import its file. EXISTING of each, by file and line. entities: (id, file, parent, type, name, start_line, is_test)."""
    targets, entities, edges = _dealt(targets), _dealt(entities), _dealt(edges)
    place = entities.select(F.col("id").alias("src"), F.col("file").alias("from"), F.col("type").alias("kind"), "start_line", "is_test")
    own = targets.join(entities.select(F.col("id").alias("target"), "parent", F.col("file").alias("home")), "target")
    ends = own.select("target", F.explode(F.array_distinct(F.array_compact(F.array("target", "parent")))).alias("dst"))
    calls = edges.filter("relation = 'calls'").select("src", "dst").join(ends, "dst").join(place.filter("is_test and kind <> 'file'"), "src")
    direct = calls.select("target", F.col("src").alias("id"), F.col("from").alias("file"), "start_line").distinct()
    files = edges.filter("relation = 'imports'").select(F.col("src").alias("file"), F.col("dst").alias("home")).join(own, "home").join(direct.select("target").distinct(), "target", "left_anti")
    tests = entities.filter("is_test and type = 'function' and name like 'test%'").select("id", "file", "start_line")
    other = files.select("target", "file").distinct().join(tests, "file").select("target", "id", "file", "start_line")
    return _cut(direct.union(other).distinct(), EXISTING, "file", "start_line", "id").select("target", "id", "file", "start_line")


def test_evidence(targets: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, ord, role, id, most) for excerpts() of functions and methods targets (target): each itself, the class around it, what it calls, what
    calls it and is no test, and its tests. Nothing is shown twice but as a test."""
    targets, entities, edges = _dealt(targets), _dealt(entities), _dealt(edges)
    own = targets.join(entities.select(F.col("id").alias("target"), "parent"), "target")
    kinds = entities.select("id", "type", "is_test")
    classes = own.select("target", F.col("parent").alias("id")).join(kinds.filter("type = 'class'"), "id").select("target", "id")
    calls = edges.filter("relation = 'calls'").select("src", "dst").distinct()
    into = own.join(calls, F.col("target") == F.col("src")).select("target", "parent", F.col("dst").alias("id")).join(kinds, "id")
    callees = _cut(into.filter("id <> target and (parent is null or id <> parent)"), CALLEES, "id").select("target", "id")
    by = own.join(calls, F.col("target") == F.col("dst")).select("target", "parent", F.col("src").alias("id")).join(kinds.filter("type <> 'file' and not is_test"), "id")
    callers = _cut(by.filter("id <> target and (parent is null or id <> parent)").join(callees, ["target", "id"], "left_anti"), CALLERS, "id").select("target", "id")
    tests = existing_tests(targets, entities, edges)
    in_order = lambda *order: F.row_number().over(Window.partitionBy("target").orderBy(*order))
    row = lambda df, k, role, most, nth: df.select("target", (F.lit(100 * k) + nth).alias("ord"), F.lit(role).alias("role"), "id", F.lit(most).alias("most"))
    one = F.lit(1)
    parts = [row(own.select("target", F.col("target").alias("id")), 0, "target", TEST_TARGET, one), row(classes, 1, "class", TEST_CLASS, one), row(callees, 2, "callee", TEST_OTHER, in_order("id"))]
    parts += [row(callers, 3, "caller", TEST_OTHER, in_order("id")), row(tests, 4, "existing", TEST_OTHER, in_order("file", "start_line", "id"))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


# Words of decorators that mark routes and commands; definitions of a document's evidence, and lines of each.
ROUTE_WORDS = ["route", "get", "post", "put", "patch", "delete", "websocket", "api", "router", "command", "endpoint"]
DOCUMENT_ENTITIES, DOCUMENT_LINES = 6, 60


def document_evidence(asked: DataFrame, entities: DataFrame, edges: DataFrame, covered: DataFrame) -> DataFrame:
    """(target, ord, role, id, most) for excerpts(): what to show for drafts asked (target, repo, kind), besides what was retrieved, covered (target, file,
    start_line, end_line).

    For an api_overview these are functions and methods with the decorator of a route or command, by file and line, if a repository has any; else, and for other
    kinds, classes and functions by how often they are called or inherited from, entry points first among equals, and for a developer_guide first of all.
    Tests and what shares a line with something covered are left out. entities: (repo, id, file, type, decorators, start_line, end_line, is_test, is_entry).
    """
    entities, edges = _dealt(entities), _dealt(edges)
    code = entities.filter("not is_test")
    routed = F.exists("decorators", lambda d: F.greatest(*[F.instr(F.lower(d), w) > 0 for w in ROUTE_WORDS]))
    uses = edges.filter("relation in ('calls', 'inherits')").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("uses"))
    routes = code.filter(F.col("type").isin("function", "method") & routed).select("repo", "id", "file", "start_line", "end_line", F.struct(F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("uses"), F.lit(False).alias("no_entry"), F.col("file").alias("name"), F.col("start_line").alias("line")).alias("place"))
    some = routes.select("repo").distinct().withColumn("some", F.lit(True))
    ranked = code.filter(F.col("type").isin("class", "function")).join(uses, "id", "left").fillna(0, ["uses"])
    place = lambda first: F.struct(first.cast("long").alias("first"), (-F.col("uses")).alias("uses"), (~F.col("is_entry")).alias("no_entry"), F.col("id").alias("name"), F.lit(0).cast("long").alias("line")).alias("place")
    wanted = asked.join(some, "repo", "left").withColumn("by_route", (F.col("kind") == "api_overview") & F.coalesce("some", F.lit(False)))
    by_route = wanted.filter("by_route").join(routes, "repo").select("target", "id", "file", "start_line", "end_line", "place")
    first = F.when((F.col("kind") == "developer_guide") & F.col("is_entry"), 0).otherwise(1)
    by_use = wanted.filter("not by_route").join(ranked, "repo").select("target", "id", "file", "start_line", "end_line", place(first))
    cut = by_route.union(by_use).withColumn("end_line", F.least("end_line", F.col("start_line") + DOCUMENT_LINES - 1))
    other = covered.select("target", "file", F.col("start_line").alias("low"), F.col("end_line").alias("high"))
    free = cut.join(other, (cut["target"] == other["target"]) & (cut["file"] == other["file"]) & (other["low"] <= cut["end_line"]) & (cut["start_line"] <= other["high"]), "left_anti")
    place_ = F.row_number().over(Window.partitionBy("target").orderBy("place"))
    return free.withColumn("ord", place_).filter(F.col("ord") <= DOCUMENT_ENTITIES).select("target", "ord", F.lit("entity").alias("role"), "id", F.lit(DOCUMENT_LINES).alias("most"))

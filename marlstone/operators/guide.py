"""Guides to repositories: what is important, what to read first, which topics there are and in which stages to learn them.

Everything is for many repositories (repo) at once. files: (repo, path, language, is_entry, is_project, is_test); entities: (repo, file, id, type,
name, nth, has_bases, decorators), nth their order in the file; edges: (repo, src, dst, relation) between ids, a file's being its path. Lists of a
repository are cut by ranks before they are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import paths
from marlstone.operators.stored import settle

# Words of topics, project files that are read first, titles of stages, and what decorators hint at.
TOPICS = [
    ("auth", "auth|login|logout|session|token|jwt|password|credential|permission|oauth|signin|sign_in"),
    ("logic", "service|services|core|domain|logic|engine|manager|processor|pipeline|worker|task|job|util|utils|helper|helpers"),
    ("data", "database|db|model|models|schema|migration|repository|repositories|store|storage|orm|sql|query|persist|dao|entity|entities"),
]
READ_FIRST = ["pyproject.toml", "requirements.txt", "package.json", "setup.py", "dockerfile", "docker-compose.yml"]
STAGES = ["Understand the project", "Learn the architecture", "Understand authentication", "Understand business logic", "Understand persistence", "Understand testing and security"]
HINTS = [
    ("FastAPI or Flask-style routing", "web", r"(?i)^(app|router|api|blueprint|bp)\.(get|post|put|patch|delete|route|websocket)\b"),
    ("pytest", "testing", r"(?i)^(pytest\.|fixture\b)"),
    ("Click or Typer CLI", "cli", r"(?i)^(click|typer)\."),
    ("Celery", "tasks", r"(?i)^(celery|shared_task|task)\b"),
]
#: Categories in which a hint adds nothing to what a dependency has told.
TOLD = ["web", "testing", "cli", "tasks"]
#: Steps after which core modules, and after which other modules, are no longer added.
CORE_STEPS, ALL_STEPS = 8, 10


def _known(entities: DataFrame, files: DataFrame) -> DataFrame:
    """Code entities with is_test of their file: from files, or else from the path."""
    known = files.select("repo", F.col("path").alias("file"), F.col("is_test").alias("told"))
    code = entities.filter("type <> 'file'").join(known, ["repo", "file"], "left")
    return code.withColumn("is_test", F.coalesce("told", paths.is_test_file(F.col("file"), with_suffix=False))).drop("told")


def _counted(n: Column, one: str, many: str, before: str = "", after: str = "") -> Column:
    return F.when(n > 0, F.concat(F.lit(before), n.cast("string"), F.when(n == 1, one).otherwise(many), F.lit(after)))


def important_files(files: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, path, score, rank, reasons, imported_by, symbols) of the files with code that are no tests, the most important first.

    6 for an entry point, 3 for each import of it up to 5, 1 for each call from another file up to 6, 1 for each class up to 4, half of the functions up
    to 4, 2 for a class with bases or with subclasses. symbols are the first three classes and the first three functions.
    """
    code = _known(entities, files)
    ends = entities.select("repo", "id", "file")
    file_of = lambda end, name: F.coalesce(F.col(name), F.substring_index(end, "::", 1))
    far = edges.join(ends.toDF("repo", "src", "f"), ["repo", "src"], "left").join(ends.toDF("repo", "dst", "t"), ["repo", "dst"], "left")
    far = far.select("repo", file_of("src", "f").alias("from"), file_of("dst", "t").alias("path"), "relation", "dst")
    used = far.groupBy("repo", "path").agg(F.count_if(F.col("relation") == "imports").alias("imported_by"), F.count_if((F.col("relation") == "calls") & (F.col("from") != F.col("path"))).alias("called"))
    base = edges.filter("relation = 'inherits'").select("repo", F.col("dst").alias("id")).distinct().withColumn("inherited", F.lit(True))
    is_ = lambda kind: F.col("type") == kind
    names = lambda kind: F.transform(F.slice(F.array_sort(F.collect_list(F.when(is_(kind), F.struct("nth", "name")))), 1, 3), lambda x: x["name"])
    own = code.filter("not is_test").join(base, ["repo", "id"], "left").groupBy("repo", F.col("file").alias("path")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_("class")).alias("classes"), F.count_if(is_("function")).alias("functions"),
        F.coalesce(F.bool_or(is_("class") & (F.col("has_bases") | F.coalesce("inherited", F.lit(False)))), F.lit(False)).alias("hierarchy"), F.concat(names("class"), names("function")).alias("symbols"),
    )
    row = own.join(used, ["repo", "path"], "left").join(files.select("repo", "path", "is_entry"), ["repo", "path"], "left").na.fill(0, ["imported_by", "called"]).na.fill(False, ["is_entry"])
    c = F.col
    score = (
        F.when(c("is_entry"), 6).otherwise(0) + 3 * F.least(c("imported_by"), F.lit(5)) + F.least(c("called"), F.lit(6)) + F.least(c("classes"), F.lit(4))
        + F.floor(F.least(c("functions"), F.lit(4)) / 2) + F.when(c("hierarchy"), 2).otherwise(0)
    )
    reasons = F.array_compact(F.array(
        F.when(c("is_entry"), F.lit("application entry point")), _counted(c("imported_by"), " file", " files", "imported by "),
        _counted(c("called"), " place", " places", "called from ", " in other files"), _counted(c("classes"), " class", " classes", "defines "), F.when(c("hierarchy"), F.lit("part of a class hierarchy")),
    ))
    reasons = F.when(F.size(reasons) > 0, reasons).otherwise(F.array(_counted(c("n"), " definition", " definitions", "holds ")))
    scored = row.select("repo", "path", score.cast("long").alias("score"), reasons.alias("reasons"), "imported_by", "symbols")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("score"), "path")))


def readmes(files: DataFrame) -> DataFrame:
    """(repo, path) of each repository's README: the one the least deep, then by path."""
    first = F.row_number().over(Window.partitionBy("repo").orderBy(F.size(F.split("path", "/")), "path"))
    return files.filter(F.lower(paths.name_of(F.col("path"))).startswith("readme")).withColumn("k", first).filter("k = 1").select("repo", "path")


def readme_heads(files: DataFrame, most: int = 4000) -> DataFrame:
    """(repo, path, head): the first characters of each repository's README, of files with text."""
    return readmes(files).join(files.select("repo", "path", "text"), ["repo", "path"]).select("repo", "path", F.substring("text", 1, most).alias("head"))


def reading_order(files: DataFrame, important: DataFrame) -> DataFrame:
    """(repo, position, path, source) of what to read, each file at its first place: the README, project files, entry points, then modules that others
    import, other modules, and a test.

    A walk over important_files() adds those imported until there are CORE_STEPS steps; it looks after each file, so one is looked at even if there are
    so many before. A second walk adds any while there are fewer than ALL_STEPS; it looks before. The test is added in any case.
    """
    name = F.lower(paths.name_of(F.col("path")))
    one = lambda df, k, source: df.select("repo", "path", F.lit(k).alias("k"), F.lit(source).alias("source"))
    start = one(readmes(files), 1, "readme").union(one(files.filter(F.col("is_project") & name.isin(READ_FIRST)), 2, "project")).union(one(files.filter("is_entry"), 3, "entry"))
    start = start.groupBy("repo", "path").agg(F.min(F.struct("k", "source")).alias("x")).select("repo", "path", "x.k", "x.source")
    size = start.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    left = important.select("repo", "path", "rank", (F.col("imported_by") > 0).alias("core")).join(start.select("repo", "path", F.lit(True).alias("old")), ["repo", "path"], "left").join(size, "repo", "left").na.fill(0, ["n"])
    new = left.withColumn("new", F.col("old").isNull())
    by_rank = Window.partitionBy("repo").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.col("core") & F.col("new")
    new = new.withColumn("nth", F.count_if(fits).over(by_rank)).withColumn("taken", fits & F.when(F.col("n") >= CORE_STEPS, F.col("rank") == 1).otherwise(F.col("nth") <= CORE_STEPS - F.col("n")))
    new = new.withColumn("cores", F.count_if("taken").over(Window.partitionBy("repo")))
    free = F.col("new") & ~F.col("taken")
    new = new.withColumn("other", F.count_if(free).over(by_rank))
    more = new.filter(F.col("taken") | (free & (F.col("other") <= ALL_STEPS - F.col("n") - F.col("cores"))))
    more = more.select("repo", "path", F.when(F.col("taken"), 4).otherwise(5).alias("k"), F.when(F.col("taken"), "core").otherwise("other").alias("source"), "rank")
    tests = files.filter(F.col("is_test") & (F.col("language") == "python")).groupBy("repo").agg(F.min("path").alias("path"))
    all_ = start.withColumn("rank", F.lit(0)).unionByName(more).unionByName(one(tests, 6, "test").withColumn("rank", F.lit(0)))
    first = all_.groupBy("repo", "path").agg(F.min(F.struct("k", "rank", "source")).alias("x")).select("repo", "path", "x.*")
    place = F.row_number().over(Window.partitionBy("repo").orderBy("k", "rank", "path"))
    return first.select("repo", place.alias("position"), "path", "source")


def topic_files(files: DataFrame, entities: DataFrame) -> DataFrame:
    """(repo, path, auth, logic, data) of the files with code that are no tests: whether the path or a name in it has a word of the topic."""
    code = _known(entities, files).filter("not is_test")
    has = [F.bool_or(F.col("name").rlike(f"(?i){words}") | F.col("file").rlike(f"(?i){words}")).alias(topic) for topic, words in TOPICS]
    return code.groupBy("repo", F.col("file").alias("path")).agg(*has)


def _first(rows: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """(repo, files): the first paths of each repository."""
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("repo").orderBy(*order))).filter(F.col("k") <= most)
    return ranked.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]).alias("files"))


def stages(files: DataFrame, entities: DataFrame, important: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """(repo, number, title, detected, files) for the six stages of each repository with files. findings: (repo, path, nth) of a scan, which
    counts for the last stage even without any finding of a repository; without it there was no scan.

    Business logic leaves out what is authentication; where nothing is left, it is what is important and neither that nor an entry point.
    """
    repos = files.select("repo").distinct()
    topics = settle(topic_files(files, entities), "topics")
    entries = files.filter("is_entry").select("repo", "path")
    hubs = _first(important.filter("imported_by > 0"), 6, "rank")
    auth = topics.filter("auth")
    logic = _first(topics.filter("logic and not auth"), 6, "path")
    rest = important.join(auth.select("repo", "path"), ["repo", "path"], "left_anti").join(entries, ["repo", "path"], "left_anti")
    project = _first(files.filter("is_project"), 4, "path")
    tests = _first(files.filter("is_test"), 6, "path")
    none = F.array().cast("array<string>")
    named = lambda df, name: df.withColumnRenamed("files", name)
    tables = [named(_first(readmes(files), 1, "path"), "readme"), named(project, "project"), named(_first(entries, 2, "path"), "entry"), named(hubs, "hubs"), named(_first(important, 5, "rank"), "top"),
              named(_first(auth, 6, "path"), "auth"), named(logic, "logic"), named(_first(rest, 5, "rank"), "rest"), named(_first(topics.filter("data"), 6, "path"), "data"), named(tests, "tests")]
    if findings is not None:
        tables.append(named(_first(findings, 3, "nth"), "found"))
    row = repos.join(topics.groupBy("repo").agg(F.count(F.lit(1)).alias("sources")), "repo", "left").na.fill(0, ["sources"])
    sources = _known(entities, files).groupBy("repo").agg(F.count_distinct("file").alias("all_sources"))
    row = row.join(sources, "repo", "left").na.fill(0, ["all_sources"])
    for one in tables:
        row = row.join(one, "repo", "left")
    lists = {c: F.coalesce(c, none) for c in ("readme", "project", "entry", "hubs", "top", "auth", "logic", "rest", "data", "tests")}
    found = F.coalesce("found", none) if findings is not None else none
    some = lambda x: F.size(x) > 0
    or_ = lambda x, y: F.when(some(x), x).otherwise(y)
    intro, logic_files = F.concat(lists["readme"], lists["project"], lists["entry"]), or_(lists["logic"], lists["rest"])
    parts = [
        (some(intro), intro), (some(lists["hubs"]) | (F.col("all_sources") > 1), or_(lists["hubs"], lists["top"])), (some(lists["auth"]), lists["auth"]),
        (some(logic_files), logic_files), (some(lists["data"]), lists["data"]), (some(lists["tests"]) | F.lit(findings is not None), F.concat(lists["tests"], found)),
    ]
    each = F.array(*[F.struct(F.format_string("%02d", F.lit(i)).alias("number"), F.lit(t).alias("title"), seen.alias("detected"), F.array_distinct(f).alias("files")) for i, (t, (seen, f)) in enumerate(zip(STAGES, parts, strict=True), 1)])
    return row.select("repo", F.explode(each).alias("x")).select("repo", "x.*")


def learning_path(stages_: DataFrame) -> DataFrame:
    """(repo, day, theme, files) for the stages that were detected and have files; five files a day at most."""
    day = F.row_number().over(Window.partitionBy("repo").orderBy("number"))
    return stages_.filter(F.col("detected") & (F.size("files") > 0)).select("repo", day.alias("day"), F.col("title").alias("theme"), F.slice("files", 1, 5).alias("files"))


def frameworks(files: DataFrame, entities: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(repo, name, category, evidence) of dependencies (repo, name, category, evidence), and of what decorators hint at in files that are no tests, each
    hint once, at its first entity. A hint of a category that a dependency has told is left out."""
    matched = lambda x: F.array_compact(F.array(*[F.when(x.rlike(p), F.lit(i)) for i, (_, _, p) in enumerate(HINTS)]))
    bare = F.transform("decorators", lambda x: F.regexp_replace(x, "^@+", ""))
    found = _known(entities, files).filter("not is_test").select("repo", "file", "nth", F.explode(F.array_distinct(F.flatten(F.transform(bare, matched)))).alias("hint"))
    first = found.groupBy("repo", "hint").agg(F.min(F.struct("file", "nth")).alias("x"))
    told = dependencies.filter(F.col("category").isin(TOLD)).select("repo", "category").distinct()
    of = lambda k: F.get(F.array(*[F.lit(h[k]) for h in HINTS]), F.col("hint"))
    hints = first.select("repo", of(0).alias("name"), of(1).alias("category"), F.concat(F.lit("decorators in "), "x.file").alias("evidence"))
    return dependencies.select("repo", "name", "category", "evidence").union(hints.join(told, ["repo", "category"], "left_anti").select("repo", "name", "category", "evidence"))


# What test files of either framework hold, and names of files that configure tests.
UNITTEST, PYTEST = r"(?m)^\s*(?:import\s+unittest|from\s+unittest\b)", r"(?m)\bpytest\b|^\s*def\s+test_"
CONFIGURES = ["pytest.ini", "tox.ini", "setup.cfg", "pyproject.toml"]


def conventions(files: DataFrame) -> DataFrame:
    """(repo, framework, test_files, directories, naming, fixtures, example, pytest_files, unittest_files, configured) of files (repo, path, is_test, text).

    The framework is that of more test files, pytest if as many; a conftest.py counts where none shows a mark. naming: null unless all names agree.
    """
    path, name = F.col("path"), paths.name_of(F.col("path"))
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")
    test = F.col("is_test")
    row = files.groupBy("repo").agg(
        F.count_if(test).alias("test_files"), F.array_sort(F.collect_set(F.when(test, folder))).alias("directories"), F.min(F.when(test, path)).alias("example"), F.min(F.when(name == "conftest.py", path)).alias("fixtures"),
        F.coalesce(F.bool_and(F.when(test, name.startswith("test_"))), F.lit(False)).alias("before"), F.coalesce(F.bool_and(F.when(test, name.endswith("_test.py"))), F.lit(False)).alias("after"),
        F.count_if(test & F.col("text").rlike(PYTEST)).alias("pytest_files"), F.count_if(test & F.col("text").rlike(UNITTEST)).alias("unittest_files"), F.bool_or(F.lower(name).isin(CONFIGURES)).alias("configured"),
    )
    p, u = F.col("pytest_files"), F.col("unittest_files")
    framework = F.when((p > 0) & (p >= u), "pytest").when(u > 0, "unittest").when(F.col("fixtures").isNotNull(), "pytest").otherwise("unknown")
    naming = F.when(F.col("before"), "test_*.py").when(F.col("after"), "*_test.py")
    return row.select("repo", framework.alias("framework"), "test_files", "directories", naming.alias("naming"), "fixtures", "example", "pytest_files", "unittest_files", "configured")


def suggested_test_files(targets: DataFrame, files: DataFrame, found: DataFrame) -> DataFrame:
    """targets (repo, target, file) with test_file: the first test file named after the target's, or else a new one where conventions() of the repository are
    kept."""
    stem = lambda path: F.regexp_replace(paths.name_of(path), r"(?<=.)\.[^.]*$", "")
    tests = files.filter("is_test").select("repo", paths.name_of(F.col("path")).alias("name"), "path")
    wanted = targets.select("repo", "target", F.explode(F.array(F.format_string("test_%s.py", stem(F.col("file"))), F.format_string("%s_test.py", stem(F.col("file"))))).alias("name"))
    known = wanted.join(tests, ["repo", "name"]).groupBy("repo", "target").agg(F.min("path").alias("known"))
    row = targets.join(known, ["repo", "target"], "left").join(found.select("repo", "directories", "naming"), "repo", "left")
    folder = F.coalesce(F.get("directories", F.lit(0)), F.lit("tests"))
    name = F.when(F.col("naming") == "*_test.py", F.concat(stem(F.col("file")), F.lit("_test.py"))).otherwise(F.concat(F.lit("test_"), stem(F.col("file")), F.lit(".py")))
    new = F.when(folder.isin("", "."), name).otherwise(F.concat(folder, F.lit("/"), name))
    return row.select("repo", "target", "file", F.coalesce("known", new).alias("test_file"))


#: Files that tell how a project is built, in its fact sheet.
_BUILD = "^(requirements.*\\.txt|pyproject\\.toml|setup\\.(py|cfg)|package\\.json|go\\.mod|dockerfile|docker-compose\\.ya?ml|makefile)$"


def fact_sheets(files: DataFrame, entities: DataFrame, edges: DataFrame, important: DataFrame) -> DataFrame:
    """(repo, fact_sheet): what the tables say of each repository, a line for each kind of fact that there is one of. Lists are cut by ranks."""
    c = F.col
    listed = lambda df, most, label, what=c("path"), *order: _lines(df, most, label, what, *(order or ("path",)))
    languages = files.filter("language is not null").groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n"))
    code = _known(entities, files)
    kinds = code.groupBy("repo").agg(F.count_distinct("file").alias("f"), F.count_if(c("type") == "class").alias("k"), F.count_if(c("type").isin("function", "method")).alias("m"))
    tests = files.groupBy("repo").agg(F.count_if("is_test").alias("t"))
    size = tests.join(kinds, "repo", "left").na.fill(0, ["f", "k", "m"]).select("repo", F.format_string("Size: %d source files, %d classes, %d functions, %d test files", "f", "k", "m", "t").alias("line"))
    packages = code.groupBy("repo", paths.package_of(c("file")).alias("package")).agg(F.count_distinct("file").alias("n"))
    relations = edges.groupBy("repo", "relation").agg(F.count(F.lit(1)).alias("n"))
    name = F.lower(paths.name_of(c("path")))
    parts = [
        files.select("repo").distinct().select("repo", F.concat(F.lit("Repository: "), c("repo").cast("string")).alias("line")),
        listed(languages, 6, "Languages", F.format_string("%s (%d files)", "language", "n"), F.desc("n"), "language"), size, listed(files.filter("is_entry"), 20, "Entry points"), listed(files.filter(name.rlike(_BUILD)), 20, "Build files"),
        listed(packages, 12, "Packages", F.format_string("%s (%d files)", "package", "n"), F.desc("n"), "package"), listed(important.filter("imported_by > 0"), 6, "Most imported", F.format_string("%s (%d)", "path", "imported_by"), F.desc("imported_by"), "path"),
        listed(relations, 9, "Relationships", F.format_string("%s %d", "relation", "n"), "relation"), listed(important, 8, "Important files", c("path"), "rank"), listed(files.filter("is_test"), 12, "Test files"),
    ]
    every = None
    for i, part in enumerate(parts):
        part = part.select("repo", F.lit(i).alias("i"), "line")
        every = part if every is None else every.union(part)
    return every.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("fact_sheet"))


def _lines(rows: DataFrame, most: int, label: str, what: Column, *order: Column | str) -> DataFrame:
    """(repo, line): a label and the first of a repository's rows, and dots where there are more."""
    ranked = rows.withColumn("what", what).withColumn("k", F.row_number().over(Window.partitionBy("repo").orderBy(*order))).filter(F.col("k") <= most + 1)
    items = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", "what")))), lambda x: x["what"])
    return ranked.groupBy("repo").agg(F.concat(F.lit(label + ": "), F.array_join(items, ", "), F.when(F.max("k") > most, ", ...").otherwise("")).alias("line"))

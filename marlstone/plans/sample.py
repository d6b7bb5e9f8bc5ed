"""Queries over a small Python repository that is given inline: parsing, resolution, rules, manifests, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import findings_text as ft
from marlstone.operators import answers, drafts, evidence, manifests, resolve
from marlstone.sources import python_code

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


SOURCES = {
    "app/__init__.py": "",
    "app/base.py": 'class BaseService:\n    """Common parts."""\n\n    def __init__(self, name):\n        self.name = name\n\n    def describe(self):\n        return self.name\n',
    "app/database.py": 'import sqlite3\n\nDB_PASSWORD = "not-a-real-one"\n\n\ndef find_user(name):\n    cursor = sqlite3.connect("x").cursor()\n    query = "SELECT * FROM users WHERE name = \'" + name + "\'"\n    return cursor.execute(query)\n',
    "app/auth.py": "from .base import BaseService\nfrom app.database import find_user as lookup\n\n\nclass AuthService(BaseService):\n    @property\n    def realm(self):\n        return 1\n\n    def login(self, user, *rest, key=None, **more):\n        self.check(user)\n        return lookup(user)\n\n    def check(self, user):\n        return user\n",
    "app/utils.py": "import hashlib\nimport pickle\nimport subprocess\nimport yaml\n\n\ndef shell(c):\n    subprocess.run(c, shell=True)\n\n\ndef load(b):\n    return pickle.loads(b), yaml.load(b)\n\n\ndef weak(b):\n    return hashlib.md5(b).hexdigest()\n",
    "app/main.py": "import app.auth\nfrom app.utils import *\n\n\ndef run():\n    service = app.auth.AuthService('x')\n    shell('ls')\n    return run\n",
    "tests/test_auth.py": "from app.auth import AuthService\n\n\ndef test_login():\n    AuthService('x').login('me')\n",
    "app/broken.py": "def fine():\n    return 1\n\n\ndef bad(:\n    pass\n\n\nclass Later:\n    pass\n",
}


def _files(spark):
    return spark.createDataFrame(list(SOURCES.items()), "path string, text string")


def _parsed(spark):
    return python_code.parsed(_files(spark))


def values(columns: str, rows: list[tuple]) -> str:
    """Rows worked out by hand, as SQL."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({columns})"


@query(values("id, type, start_line, end_line, parameters, bases", [
    ("app/base.py::BaseService", "class", 1, 8, "", ""), ("app/base.py::BaseService.__init__", "method", 4, 5, "self,name", ""), ("app/base.py::BaseService.describe", "method", 7, 8, "self", ""),
    ("app/database.py::find_user", "function", 6, 9, "name", ""), ("app/auth.py::AuthService", "class", 5, 15, "", "BaseService"), ("app/auth.py::AuthService.realm", "method", 6, 8, "self", ""),
    ("app/auth.py::AuthService.login", "method", 10, 12, "self,user,*rest,key,**more", ""), ("app/auth.py::AuthService.check", "method", 14, 15, "self,user", ""),
    ("app/utils.py::shell", "function", 7, 8, "c", ""), ("app/utils.py::load", "function", 11, 12, "b", ""), ("app/utils.py::weak", "function", 15, 16, "b", ""), ("app/main.py::run", "function", 5, 8, "", ""),
    ("tests/test_auth.py::test_login", "function", 4, 5, "", ""), ("app/broken.py::fine", "function", 1, 2, "", ""), ("app/broken.py::Later", "class", 9, 10, "", ""),
]))
def parse_fixture_entities(spark, d):
    e = python_code.entities(_parsed(spark))
    return e.select("id", "type", "start_line", "end_line", F.array_join("parameters", ",").alias("parameters"), F.array_join("bases", ",").alias("bases"))


@query(values("source, target, line", [("app/auth.py", "app/base.py", 1), ("app/auth.py", "app/database.py", 2), ("app/main.py", "app/auth.py", 1), ("app/main.py", "app/utils.py", 2), ("tests/test_auth.py", "app/auth.py", 1)]))
def parse_fixture_imports(spark, d):
    return resolve.import_edges(python_code.exploded(_parsed(spark), "imports"), resolve.module_map(_files(spark)))


def _graph(spark):
    p = _parsed(spark)
    return python_code.exploded(p, "calls"), python_code.exploded(p, "imports"), resolve.module_map(_files(spark)), python_code.entities(p)


@query(values("source, target, line", [
    ("app/auth.py::AuthService.login", "app/auth.py::AuthService.check", 11), ("app/auth.py::AuthService.login", "app/database.py::find_user", 12), ("app/main.py::run", "app/auth.py::AuthService", 6),
    ("app/main.py::run", "app/utils.py::shell", 7), ("tests/test_auth.py::test_login", "app/auth.py::AuthService", 5),
]))
def parse_fixture_calls(spark, d):
    return resolve.call_edges(*_graph(spark))


@query(values("source, target", [("app/auth.py::AuthService", "app/base.py::BaseService")]))
def symbol_resolution(spark, d):
    calls, imports, modules, entities = _graph(spark)
    return resolve.inherit_edges(entities, imports, modules)


@query(values("file, rule, severity, line", [
    ("app/database.py", "hardcoded-credential", "HIGH", 3), ("app/database.py", "sql-injection", "CRITICAL", 9), ("app/utils.py", "command-injection", "CRITICAL", 8),
    ("app/utils.py", "insecure-deserialization-pickle", "HIGH", 12), ("app/utils.py", "yaml-unsafe-load", "HIGH", 12), ("app/utils.py", "weak-hash", "MEDIUM", 16),
]))
def rules_fixture(spark, d):
    return python_code.exploded(_parsed(spark), "findings").select("file", "rule", "severity", "line")


MANIFESTS = {
    "requirements.txt": "requests\n# note\nflask==3.0\n-r other.txt\ngit+https://x/y\nnumpy>=1 # why\n",
    "pyproject.toml": '[project]\ndependencies = ["fastapi==0.1", "pydantic>=2"]\n[project.optional-dependencies]\ndev = ["pytest"]\n',
    "web/package.json": '{"dependencies": {"react": "18.2.0"}, "devDependencies": {"vite": "^5.0"}}',
    "go.mod": "module x\n\nrequire github.com/a/b v1.2.3\nrequire (\n\tgithub.com/c/d v0.1.0 // indirect\n)\n",
}


@query(values("package, pinned", [("requests", False), ("flask", True), ("numpy", False), ("fastapi", True), ("pydantic", False), ("pytest", False), ("react", True), ("vite", False), ("github.com/a/b", True), ("github.com/c/d", True)]))
def manifest_fixture(spark, d):
    return manifests.dependencies(spark.createDataFrame(list(MANIFESTS.items()), "path string, text string")).select("package", "pinned")


@query(values("package, pinned", [("requests", False), ("flask", True), ("numpy", False)]))
def requirements_parse(spark, d):
    return manifests.requirement_lines(spark.createDataFrame([("requirements.txt", MANIFESTS["requirements.txt"])], "path string, text string")).select("package", "pinned")


REPORT = """{"results": [{"check_id": "rules.sql-injection", "path": "/work/app/a.py", "start": {"line": 3, "col": 5}, "end": {"line": 3, "col": 9}, "extra": {"message": "m", "severity": "WARNING", "metadata": {"severity": "critical", "title": "SQL injection"}}},
 {"check_id": "rules.weak_hash", "path": "./b.py", "start": {"line": 1, "col": 1}, "end": {"line": 1, "col": 2}, "extra": {"message": "m", "severity": "WARNING"}},
 {"check_id": "rules.gone", "path": "c.py", "start": {"line": 1, "col": 1}, "extra": {"severity": "INFO", "is_ignored": true}}, {"check_id": "broken"}], "errors": []}"""


@query(values("file, line, severity, title, fingerprint", [("app/a.py", 3, "CRITICAL", "SQL injection", "92d06b7d06b3a1a6"), ("b.py", 1, "MEDIUM", "Weak hash", "0")]).replace("'92d06b7d06b3a1a6'", "substr(sha1('tool|rules.sql-injection|app/a.py|3'), 1, 16)").replace("'0'", "substr(sha1('tool|rules.weak_hash|b.py|1'), 1, 16)"))
def scanner_json_ingest(spark, d):
    r = manifests.scanner_report(spark.createDataFrame([(REPORT,)], "text string"))
    file = ft.normal_path(F.col("path"), "/work")
    return r.select(
        file.alias("file"), F.col("start.line").alias("line"), ft.severity(F.col("extra.severity"), F.col("extra.metadata.severity")).alias("severity"),
        ft.title_of(F.col("check_id"), F.col("extra.metadata.title")).alias("title"), ft.fingerprint(F.lit("tool"), F.col("check_id"), file, F.col("start.line")).alias("fingerprint"),
    )


ANSWERS = [
    (1, "See app/auth.py:5-99 and app/auth.py::AuthService, not gone.py:1-2 or app/auth.py:400. Again app/auth.py:5-99.\n\nSources:\n- app/auth.py::AuthService\n- app/auth.py::Gone\n- gone.py"),
    (2, "Look at ./app/base.py lines 4 to 5, app/base.py lines 2 to 3, and app/base.py::Nothing."),
]
SHOWN = [(1, 1, "app/auth.py", 5, 15), (2, 1, "app/base.py", 1, 8)]


@query(values("answer_id, file, symbol, start_line, end_line", [(1, "app/auth.py", None, 5, 15), (1, "app/auth.py", "AuthService", None, None), (2, "app/base.py", None, 2, 3)]))
def citation_validate(spark, d):
    """Lines are those shown; a file that wasn't shown or is spelled otherwise and lines beyond are no sources, paths without lines in the list of sources only."""
    shown = spark.createDataFrame([(a, n, "c", f, None, s, e) for a, n, f, s, e in SHOWN], "answer_id int, ord int, chunk_id string, file string, symbol string, start_line long, end_line long")
    said = spark.createDataFrame(ANSWERS, "answer_id int, text string")
    return answers.validated(said, shown, python_code.entities(_parsed(spark)))[1].select("answer_id", "file", "symbol", "start_line", "end_line")


@query(values("id, body, explanation, code", [(1, "Do this:\n```python\nx = 1\n```", "Do this:", "x = 1"), (2, "No list here.", "No  list ( ) here .", "")]))
def answer_parsing(spark, d):
    """Bodies without their sources, and code with what is said before it."""
    a = spark.createDataFrame([(1, "Do this:\n```python\nx = 1\n```\n\nSources:\n- a.py:1"), (2, "<think>hm</think> No  list ( ) here .")], "answer_id int, text string")
    plain = a.select("answer_id", ft.strip_blocks(F.col("text")).alias("text"))
    bodies = answers.parsed_answers(plain).select("answer_id", F.when(F.col("answer_id") == 2, answers.tidy(F.col("body"))).otherwise(F.col("body")).alias("body"))
    return bodies.join(answers.fix_answers(plain), "answer_id").select(F.col("answer_id").alias("id"), "body", "explanation", "code")


REPOSITORIES = [("shop",)]
DOCUMENTS = [("shop", "README.md"), ("shop", "docs/readme-2.md"), ("shop", "docs/api-2.md")]


def _draft_status(spark):
    cached = spark.createDataFrame([("shop", "documentation-architecture")], "repo string, request_id string")
    return drafts.document_status(spark.createDataFrame(REPOSITORIES, "repo string"), spark.createDataFrame(DOCUMENTS, "repo string, path string"), cached)


@query(values("kind, title, suggested, cached, n_queries, first_heading, last_heading", [
    ("readme", "README draft", "README-3.md", False, 4, "Overview", "Testing"), ("architecture", "Architecture documentation", "ARCHITECTURE.md", True, 4, "Purpose", "Extension points"),
    ("developer_guide", "Developer guide", "DEVELOPER_GUIDE.md", False, 4, "Getting started", "Common tasks"), ("api_overview", "API overview", "API.md", False, 4, "Scope", "Errors"),
]))
def draft_status(spark, d):
    return _draft_status(spark).select("kind", "title", "suggested", "cached", F.size("queries").alias("n_queries"), F.get("headings", F.lit(0)).alias("first_heading"), F.element_at("headings", -1).alias("last_heading"))


@query(values("target_id, status, request_id", [
    ("app/auth.py::AuthService.login", "ok", "tests-1859034dc3f676bf"), ("app/auth.py::AuthService", "unsupported", "tests-6cd25029097334f7"), ("app/gone.py::nothing", "unknown", "tests-b7f0cdbf6c88120b"),
]))
def draft_test_targets(spark, d):
    asked = spark.createDataFrame([("app/auth.py::AuthService.login",), ("app/auth.py::AuthService",), ("app/gone.py::nothing",)], "target_id string")
    return drafts.test_targets(asked, python_code.entities(_parsed(spark))).select("target_id", "status", "request_id")


def _echo():
    """A stand-in that answers from the prompt: how many excerpts and sections it saw, then one good and two bad sources."""

    def said(prompt: str) -> str:
        seen = f"{prompt.count('(lines ')} excerpts, {prompt.count('## ')} sections"
        return f"<think>so</think># Draft\n{seen}\n\nSources:\n- app/auth.py: lines 6-99\n- app/gone.py: lines 1-2\n- app/auth.py: lines 400-410"

    return evidence.RecordingGenerator(said)


@query(values("request_id, body, n_excerpts, n_removed, cached, sources", [
    ("shop/documentation-readme", "# Draft\n1 excerpts, 7 sections", 1, 2, False, "app/auth.py:6-15"),
    ("shop/documentation-developer_guide", "# Draft\n0 excerpts, 7 sections", 0, 3, False, None),
    ("shop/documentation-api_overview", "# Draft\n0 excerpts, 5 sections", 0, 3, False, None),
    ("shop/documentation-architecture", "kept", None, None, True, None),
    ("shop/summary", "# Draft\n2 excerpts, 0 sections", 2, 2, False, "app/auth.py:6-15"),
    ("impact-14c68d97c9f7a885", "# Draft\n1 excerpts, 4 sections", 1, 2, False, "app/auth.py:10-12"),
    ("tests-1859034dc3f676bf", "# Draft\n1 excerpts, 0 sections", 1, 2, False, "app/auth.py:10-12"),
]))
def drafts_fixture(spark, d):
    entities = python_code.entities(_parsed(spark))
    login = "app/auth.py::AuthService.login"
    impacts = spark.createDataFrame([(login, 2, "LOW", ["1 direct dependent"], ["app/main.py::run"])], "target_id string, depth int, level string, reasons array<string>, affected array<string>")
    facts = spark.createDataFrame([("shop", "8 files")], "repo string, fact_sheet string")
    impact = drafts.impact_requests(impacts)
    tests = drafts.test_requests(drafts.test_targets(impacts.select("target_id"), entities))
    requests = drafts.document_requests(_draft_status(spark), facts).unionByName(drafts.summary_requests(spark.createDataFrame(REPOSITORIES, "repo string")))
    requests = requests.unionByName(impact).unionByName(tests)
    form = "request_id string, ord long, chunk_id long, file string, symbol string, start_line int, end_line int, text string"
    chunks = spark.createDataFrame([("shop/documentation-readme", 1, 1, "app/auth.py", "AuthService", 5, 15, "class AuthService"), ("shop/summary", 1, 1, "app/auth.py", "AuthService", 5, 15, "class AuthService"), ("shop/summary", 2, 2, "app/base.py", None, 1, 8, "class BaseService")], form)
    targets = impact.select("request_id").unionByName(tests.select("request_id"))
    own = targets.select("request_id", F.lit(1).cast("long").alias("ord"), F.lit(1).cast("long").alias("chunk_id"), F.lit("app/auth.py").alias("file"), F.lit("AuthService.login").alias("symbol"), F.lit(10).alias("start_line"), F.lit(12).alias("end_line"), F.lit("def login").alias("text"))
    cached = spark.createDataFrame([("shop/documentation-architecture", "kept")], "request_id string, body string")
    out, cited = drafts.drafted(requests, chunks.unionByName(own), entities, _echo, cached)
    spans = F.concat("file", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    sources = cited.groupBy("request_id").agg(F.array_join(F.array_sort(F.collect_list(spans)), ", ").alias("sources"))
    return out.join(sources, "request_id", "left").select("request_id", "body", "n_excerpts", "n_removed", "cached", "sources")

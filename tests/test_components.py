"""Scalars, the repository source, the parser, sessions, streams, and order-sensitive operators against plain Python."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from marlstone.functions import findings_text as ft
from marlstone.functions import paths
from marlstone.operators import evidence, findings, graph, session, text, vectors
from marlstone.sources import python_code, repository
from marlstone.streaming import arrivals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("url", "ok"), [("https://github.com/o/r", True), ("http://www.github.com/o/r.git/", True), ("https://github.com:443/o/r", True), ("https://github.com/o", False), ("https://gitlab.com/o/r", False), ("https://u:p@github.com/o/r", False), ("https://github.com/o/r?x=1", False), ("ftp://github.com/o/r", False), ("https://github.com/o/..", False)])
def test_repository_address(spark, url, ok):
    got = one(spark, paths.repository_address(F.lit(url)))
    assert got["ok"] == ok and (got["address"] == "https://github.com/o/r.git") == ok


def test_redaction(spark):
    assert one(spark, ft.redact_literals(F.lit("a = 'abcd' + \"x\""))) == "a = '[REDACTED]' + \"x\""
    assert one(spark, ft.redact_span(F.lit("key=abcdef;"), F.lit(5), F.lit(10), F.lit(""))) == "key=[REDACTED];"
    assert one(spark, ft.redact_span(F.lit("key=abcdef;"), F.lit(1), F.lit(1), F.lit("abcdef"))) == "key=[REDACTED];"
    assert one(spark, ft.secret_title(F.lit("aws-access-token"))) == "AWS Access Token"
    assert one(spark, paths.clone_error(F.lit("fatal: Could not resolve host"))) == "network unavailable"


def test_repository_source(spark, tmp_path):
    files = {"README.md": b"# T\n\nfixture text of some length\n", "app/__init__.py": b"", "app/__main__.py": b"x = 1\n", "app/.hidden.py": b"y = 2\n", "node_modules/a.js": b"1", "pic.png": b"\x89PNG", "blob.py": b"a\0b", "x.log": b"l", "tests/test_a.py": b"def test(): pass", "bad.py": b"\xff\xfe\xfa"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "link.py").symlink_to(tmp_path / "bad.py")
    found = repository.described(repository.read_repository(spark, str(tmp_path)))
    rows = {r["path"]: r for r in found.collect()}
    assert set(rows) == set(files) - {"node_modules/a.js"}
    assert [r["path"] for r in found.orderBy("walk_ord").collect()][0] == "README.md"
    assert rows["pic.png"]["is_binary"] and rows["blob.py"]["is_binary"] and rows["x.log"]["is_junk"] and rows["app/__main__.py"]["is_entry_point"] and rows["tests/test_a.py"]["is_test_file"]
    assert rows["app/__init__.py"]["line_count"] == 0 and rows["tests/test_a.py"]["line_count"] == 1
    assert {r["path"] for r in repository.scanned(found).collect()} >= {"README.md", "app/__init__.py", "app/__main__.py"}
    assert repository.scan_summary(found).first()["files_skipped_binary"] >= 2


def test_parser_details():
    source = '"""Top."""\nimport a.b as c, d\nfrom ..m import x as y, z\n\n@deco(1)\nasync def f(a, /, b=g(), *args: int, k, **kw) -> int:\n    """ Doc. """\n    def inner():\n        return h.i(j())\n    return f()\n'
    _, doc, broken, entities, imports, calls, _ = python_code.parse("m.py", source)
    f, inner = entities
    assert doc == "Top." and not broken and f["docstring"] == "Doc." and f["start_line"] == 5 and f["decorators"] == ["deco(1)"]
    assert f["signature"].startswith("async def f(a, /, b=g()") and f["signature"].endswith("-> int") and f["parameters"] == ["a", "b", "*args", "k", "**kw"]
    assert inner["id"] == "m.py::f.inner" and inner["type"] == "function"
    assert [(i["module"], i["level"], [n["name"] for n in i["names"]]) for i in imports] == [("a.b", 0, []), ("d", 0, []), ("m", 2, ["x", "z"])]
    assert [(c["caller"], c["callee"]) for c in calls] == [("m.py::f.inner", "h.i"), ("m.py::f.inner", "j"), ("m.py::f", "f")]
    assert python_code.parse("e.py", "")[3] == []


def test_rules():
    bad = "jwt.decode(t, verify=False)\nrequests.get(u, verify=False)\napp.run(debug=True, host='0.0.0.0')\neval(x)\ntempfile.mktemp()\nrender_template_string('a' + b)\nq = f'{x}'\ncur.execute(q)\nos.system('ls')\nhashlib.new('md5')\napi_key = 'abc'\npassword_field = 'p'\n"
    rules = [f["rule"] for f in python_code.parse("x.py", bad)[6]]
    assert rules == ["jwt-signature-not-verified", "tls-verification-disabled", "flask-debug-enabled", "bind-all-interfaces", "code-injection-eval", "insecure-temp-file", "flask-template-injection", "sql-injection", "weak-hash", "hardcoded-credential"]


def test_impact_against_a_walk(spark):
    r = random.Random(2)
    n = 30
    edges = sorted({(r.randrange(n), r.randrange(n), r.choice(graph.RELATION_ORDER)) for _ in range(90)})
    edges = [e for e in edges if e[0] != e[1]]
    kind = {i: "file" if i % 5 == 0 else "function" for i in range(n)}
    queue, seen, want = deque([(0, 0)]), {0}, {}
    while queue:
        at, depth = queue.popleft()
        if depth == 3:
            continue
        for via in graph.RELATION_ORDER:
            if via == "imports" and kind[at] != "file":
                continue
            for s, d, rel in edges:
                if d == at and rel == via and s not in seen:
                    seen.add(s)
                    want[s] = (depth + 1, via, at)
                    queue.append((s, depth + 1))
    e = spark.createDataFrame(edges, "src long, dst long, relation string")
    ents = spark.createDataFrame([(i, k) for i, k in kind.items()], "id long, type string")
    got = graph.impact(e, ents, ents.filter("id = 0").select("id"), 3, 500).collect()
    assert {x["id"]: (x["depth"], x["via"], x["through"]) for x in got} == want


def test_split_and_pack(spark):
    lines = "\n".join("x" * (i % 7 * 10) for i in range(40))
    df = spark.createDataFrame([(1, 1, lines), (2, 1, "y" * 500)], "doc_id long, start_line long, text string")
    parts = text.split_oversized(df, 200, 2).orderBy("doc_id", "part").collect()
    mine = [p for p in parts if p["doc_id"] == 1]
    assert [p["part"] for p in mine] == list(range(1, len(mine) + 1)) and mine[-1]["end_line"] == 40
    assert all(p["text"] == "\n".join(lines.split("\n")[p["start_line"] - 1 : p["end_line"]]) for p in mine)
    assert [p["text"] for p in parts if p["doc_id"] == 2] == ["y" * 500]
    chunks = spark.createDataFrame([(1, 1, 1, "a" * 3000), (1, 2, 2, "b" * 2000), (1, 3, 3, "c"), (2, 1, 9, "d" * 5000)], "q long, ord long, chunk_id long, text string")
    got = {(r["q"], r["chunk_id"], r["truncated"]) for r in text.pack_context(chunks, "q", "ord", 3100).collect()}
    assert got == {(1, 1, False), (1, 3, False), (2, 9, True)}


def test_split_keeps_texts_in_spark(spark):
    """Python gets the sizes of lines, whatever the texts are: a batch of long texts needs no memory of a worker."""
    rows = [(i, 7, "\n".join(c * (i % 5 + k % 3) for k, c in enumerate("aé\u2003x" * 30))) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "doc_id long, start_line long, text string").coalesce(1)
    cut = text.split_oversized(df, 60, 1)
    plan = cut._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
    for r in cut.collect():
        whole = dict((i, t.split("\n")) for i, _, t in rows)[r["doc_id"]]
        assert r["text"] == "\n".join(whole[r["start_line"] - 7 : r["end_line"] - 6]) and (r["part"] is None) == (len("\n".join(whole)) <= 60)
    ends = {r["doc_id"]: r["e"] for r in cut.groupBy("doc_id").agg(F.max("end_line").alias("e")).collect()}
    assert ends == {i: 6 + len(t.split("\n")) for i, _, t in rows}


def test_vectors_and_fakes(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(9)], "chunk_id string, text string")
    v = evidence.embedded(chunks, evidence.HashEmbedder).selectExpr("int(substr(chunk_id, 2)) as vec_id", "embedding")
    best = vectors.top_k(v, v.filter("vec_id = 4"), 3).orderBy("rank").collect()
    assert best[0]["vec_id"] == 4 and abs(best[0]["score"] - 1) < 1e-5
    asked = evidence.RecordingGenerator(lambda p: "<think>x</think> yes")
    assert evidence.answer("q", [], asked) == evidence.NO_EVIDENCE and not asked.prompts
    assert evidence.answer("q", ["[1] a"], asked) == "yes" and len(asked.prompts) == 1
    assert evidence.suggested_name("README.md", ["readme.md"]) == "README-2.md"
    diff = spark.createDataFrame([("a\nb", "a\nc")], "o string, n string").select(evidence.unified_diff("o", "n").alias("d")).first()["d"]
    assert "-b" in diff and "+c" in diff


def test_session(spark, tmp_path):
    s = session.Session(spark, str(tmp_path))
    tracker = session.StageTracker(s)
    tracker.start("cloning")
    s.write("files", spark.range(3))
    s.write("files", spark.range(5))
    assert s.read("files").count() == 5
    tracker.start("parsing")
    tracker.fail("boom")
    status = {r["stage"]: r["stage_state"] for r in s.read("status").collect()}
    assert status["cloning"] == "completed" and status["parsing"] == "failed" and s.read("files") is None
    assert s.drop() and s.read("status") is None
    with pytest.raises(ValueError, match="session id"):
        session.Session(spark, str(tmp_path), "../x")
    hit, miss = session.cached_answers(spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([("a", "x")], "key string, answer string"))
    assert [r["key"] for r in hit.collect()] == ["a"] and [r["key"] for r in miss.collect()] == ["b"]


def test_findings_order_and_cap(spark):
    rows = [(1, 2, "b", "LOW", "vulnerability", "s", 1), (1, 1, "a", "CRITICAL", "secret", "secrets", 9), (1, 1, "generic-x", "HIGH", "secret", "secrets", 1), (1, 1, "z", "HIGH", "vulnerability", "s", 1)]
    rows += [(1, 1, "known", "HIGH", "secret", "s", 1), (2, 1, "other", "INFO", "secret", "s", 1), (2, 2, "late", "INFO", "secret", "secrets", 7), (2, 2, "early", "INFO", "secret", "secrets", 2)]
    f = spark.createDataFrame(rows, "doc_id long, line_no long, rule string, severity string, category string, source string, column int")
    got = findings.numbered(findings.merged(f), 9).orderBy("id").collect()
    assert [(r["id"], r["rule"]) for r in got] == [("SEC-001", "a"), ("SEC-002", "z"), ("SEC-003", "b"), ("SEC-004", "other"), ("SEC-005", "early")]
    f = f.filter("doc_id = 1 and rule <> 'known'")
    assert {r["severity"]: r["n"] for r in findings.summary(f).collect()} == {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 0, "LOW": 1, "INFO": 0}


def test_arrivals(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, "token = 'abcdefgh1'\nmail a@b.org")], "doc_id long, text string").withColumn("arrived", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(folder)
    q = arrivals.finding_counts(arrivals.arriving(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("arrivals").start()
    q.processAllAvailable()
    q.stop()
    assert {r["rule"]: r["n"] for r in spark.sql("select * from arrivals").collect()} == {"generic-credential": 1, "personal-email": 1}


def test_entry_without_the_training_data_part(tmp_path):
    """The entry file works where the subpackage and the pipeline are deleted."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "marlstone", tmp_path / "marlstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})

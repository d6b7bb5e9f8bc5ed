"""Python sources to entities, imports, calls and rule findings: one table function over (path, text)."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITY = "struct<id:string,type:string,name:string,start_line:int,end_line:int,parent:string,parameters:array<string>,signature:string,docstring:string,decorators:array<string>,bases:array<string>>"
IMPORT = "struct<ord:int,module:string,names:array<struct<name:string,alias:string>>,alias:string,level:int,line:int>"
CALL = "struct<ord:int,caller:string,callee:string,line:int>"
FINDING = "struct<rule:string,severity:string,category:string,line:int,column:int>"
SCHEMA = f"file string, module_docstring string, had_syntax_errors boolean, entities array<{ENTITY}>, imports array<{IMPORT}>, calls array<{CALL}>, findings array<{FINDING}>"

# What each rule looks for.
SEVERITY = {
    "sql-injection": "CRITICAL", "command-injection": "CRITICAL", "code-injection-eval": "HIGH", "insecure-deserialization-pickle": "HIGH", "yaml-unsafe-load": "HIGH", "tls-verification-disabled": "HIGH",
    "jwt-signature-not-verified": "HIGH", "flask-template-injection": "HIGH", "flask-debug-enabled": "MEDIUM", "bind-all-interfaces": "LOW", "weak-hash": "MEDIUM", "insecure-temp-file": "MEDIUM", "hardcoded-credential": "HIGH",
}
UNPICKLERS = {f"{m}.{f}" for m in ("pickle", "cPickle", "dill") for f in ("load", "loads")} | {"shelve.open"}
CREDENTIAL = re.compile(r"(?i)^(?:.*_)?(password|passwd|pwd|secret|secret_key|api_key|apikey|access_key|auth_token|token|private_key|client_secret)(?:_\w+)?$")
HARMLESS = re.compile(r"(?i)(name|header|field|key_id|_url|_path|_file|_env|_var|prefix|suffix|type|length|algorithm)$")


def dotted(node: ast.AST) -> str | None:
    """a.b.c of a name or a chain of attributes on one; nothing for what is computed."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (left := dotted(node.value)) is not None:
        return f"{left}.{node.attr}"
    return None


class _Module(ast.NodeVisitor):
    """Definitions with their scope; imports; calls in bodies only (not in decorators, defaults or bases)."""

    def __init__(self, path: str, source: str, offset: int = 0) -> None:
        self.path, self.lines, self.offset = path, source.split("\n"), offset
        self.scope: list[tuple[str, str]] = []
        self.entities, self.imports, self.calls, self.findings = [], [], [], []
        self.built: dict[str, int] = {}

    def _id(self, name: str | None = None) -> str:
        parts = [n for n, _ in self.scope] + ([name] if name else [])
        return f"{self.path}::{'.'.join(parts)}" if parts else self.path

    def _text(self, node: ast.AST) -> str:
        return ast.get_source_segment("\n".join(self.lines), node) or ""

    def _define(self, node, kind: str, parameters: list[str], bases: list[str]) -> None:
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        body = node.body[0]
        head = "\n".join(self.lines[node.lineno - 1 : body.lineno])
        cut = head[: head.rfind("\n") + 1 + body.col_offset] if body.lineno > node.lineno else self.lines[node.lineno - 1][: body.col_offset]
        doc = ast.get_docstring(node, clean=False)
        self.entities.append({
            "id": self._id(node.name), "type": kind, "name": node.name, "start_line": first + self.offset, "end_line": node.end_lineno + self.offset, "parent": self._id(), "parameters": parameters,
            "signature": cut.strip().removesuffix(":").strip(), "docstring": (doc or "").strip() or None, "decorators": [self._text(d) for d in node.decorator_list], "bases": bases,
        })
        self.scope.append((node.name, kind))
        outer, self.built = self.built, {}
        for statement in node.body:
            self.visit(statement)
        self.built = outer
        self.scope.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._define(node, "class", [], [self._text(b) for b in node.bases])

    def visit_FunctionDef(self, node) -> None:
        a = node.args
        names = [x.arg for x in (*a.posonlyargs, *a.args)] + ([f"*{a.vararg.arg}"] if a.vararg else []) + [x.arg for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
        self._define(node, "method" if self.scope and self.scope[-1][1] == "class" else "function", names, [])

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node: ast.Import) -> None:
        for x in node.names:
            self.imports.append({"ord": len(self.imports), "module": x.name, "names": [], "alias": x.asname, "level": 0, "line": node.lineno + self.offset})

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        names = [{"name": x.name, "alias": x.asname} for x in node.names]
        self.imports.append({"ord": len(self.imports), "module": node.module, "names": names, "alias": None, "level": node.level, "line": node.lineno + self.offset})

    def visit_Call(self, node: ast.Call) -> None:
        callee = dotted(node.func)
        if callee:
            self.calls.append({"ord": len(self.calls), "caller": self._id(), "callee": callee, "line": node.lineno + self.offset})
        self._judge(node, callee or "")
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        for target in node.targets:
            self._bound(target, node.value, node)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if node.value:
            self._bound(node.target, node.value, node)
        self.generic_visit(node)

    def _bound(self, target: ast.AST, value: ast.AST, node: ast.AST) -> None:
        if name := dotted(target):
            self.built[name.split(".")[-1]] = _is_built(value)
            self._credential(name, value, node)
        if isinstance(target, ast.Attribute):
            off = isinstance(value, ast.Constant) and value.value is False and target.attr in ("verify", "check_hostname")
            if off or target.attr == "verify_mode" and dotted(value) == "ssl.CERT_NONE":
                self._found("tls-verification-disabled", node)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        if (name := dotted(node.target)) and isinstance(node.op, ast.Add):
            self.built[name] = True
        self.generic_visit(node)

    def _found(self, rule: str, node: ast.AST) -> None:
        self.findings.append({"rule": rule, "severity": SEVERITY[rule], "category": "secret" if rule == "hardcoded-credential" else "vulnerability", "line": node.lineno + self.offset, "column": node.col_offset + 1})

    def _credential(self, name: str, value: ast.AST, node: ast.AST) -> None:
        if isinstance(value, ast.Constant) and isinstance(value.value, str) and value.value and CREDENTIAL.search(name) and not HARMLESS.search(name):
            self._found("hardcoded-credential", node)

    def _judge(self, node: ast.Call, callee: str) -> None:
        first = node.args[0] if node.args else None
        keywords = {k.arg: k.value for k in node.keywords if k.arg}
        value = lambda k: getattr(keywords.get(k), "value", None)
        tail = callee.rsplit(".", 1)[-1] if callee else getattr(node.func, "attr", "")
        built = first is not None and (_is_built(first) or isinstance(first, ast.Name) and self.built.get(first.id, False))
        literal = isinstance(first, ast.Constant) or isinstance(first, ast.List) and bool(first.elts) and isinstance(first.elts[0], ast.Constant)
        if (isinstance(node.func, ast.Attribute) and tail in ("execute", "executescript") or callee.endswith(".objects.raw")) and built:
            self._found("sql-injection", node)
        if first is not None and not literal and (callee.startswith("subprocess.") and value("shell") is True or callee in ("os.system", "os.popen")):
            self._found("command-injection", node)
        if callee in ("eval", "exec") and first is not None and not isinstance(first, ast.Constant):
            self._found("code-injection-eval", node)
        if callee in UNPICKLERS:
            self._found("insecure-deserialization-pickle", node)
        if callee in ("yaml.unsafe_load", "yaml.full_load_all") or callee == "yaml.load" and "Safe" not in (dotted(keywords.get("Loader") or (node.args[1] if len(node.args) > 1 else ast.Constant(0))) or ""):
            self._found("yaml-unsafe-load", node)
        if callee == "jwt.decode" and (value("verify") is False or _option(keywords.get("options"), "verify_signature") is False):
            self._found("jwt-signature-not-verified", node)
        elif callee.startswith(("requests.", "httpx.")) and value("verify") is False or callee == "ssl._create_unverified_context":
            self._found("tls-verification-disabled", node)
        if tail == "render_template_string" and built:
            self._found("flask-template-injection", node)
        if tail == "run" and value("debug") is True:
            self._found("flask-debug-enabled", node)
        if tail in ("run", "bind") and (value("host") == "0.0.0.0" or isinstance(first, ast.Tuple) and any(getattr(x, "value", None) == "0.0.0.0" for x in first.elts)):
            self._found("bind-all-interfaces", node)
        if callee in ("hashlib.md5", "hashlib.sha1") or callee == "hashlib.new" and getattr(first, "value", None) in ("md5", "sha1"):
            self._found("weak-hash", node)
        if callee == "tempfile.mktemp":
            self._found("insecure-temp-file", node)
        for name, x in keywords.items():
            self._credential(name, x, node)


def _is_built(node: ast.AST) -> bool:
    """A string put together from values: concatenation, %, an f-string with fields, .format."""
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Mod)):
        return not (isinstance(node.left, ast.Constant) and isinstance(node.right, ast.Constant))
    if isinstance(node, ast.JoinedStr):
        return any(isinstance(v, ast.FormattedValue) for v in node.values)
    return isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "format"


def _option(node: ast.AST | None, key: str) -> object:
    if isinstance(node, ast.Dict):
        for k, v in zip(node.keys, node.values, strict=True):
            if getattr(k, "value", None) == key:
                return getattr(v, "value", None)
    return None


def blocks(source: str) -> Iterator[tuple[int, str]]:
    """Top-level stretches of a source: from a line that starts at the margin to before the next one."""
    lines, start = source.split("\n"), 0
    for i in range(1, len(lines) + 1):
        if i == len(lines) or lines[i][:1] not in ("", " ", "\t", ")", "]", "}", "#") and not lines[i - 1].startswith("@"):
            yield start, "\n".join(lines[start:i])
            start = i


def parse(path: str, source: str) -> tuple:
    """A source with errors gives what its sound stretches have, and the flag."""
    found, broken = _Module(path, source), False
    doc = None
    try:
        tree = ast.parse(source)
        doc = ast.get_docstring(tree, clean=False)
        for statement in tree.body:
            found.visit(statement)
    except (SyntaxError, ValueError, RecursionError):
        broken = True
        for offset, block in blocks(source):
            try:
                tree = ast.parse(block)
            except (SyntaxError, ValueError, RecursionError):
                continue
            part = _Module(path, block, offset)
            for statement in tree.body:
                part.visit(statement)
            found.entities += part.entities
            found.imports += [x | {"ord": len(found.imports) + x["ord"]} for x in part.imports]
            found.calls += [x | {"ord": len(found.calls) + x["ord"]} for x in part.calls]
            found.findings += part.findings
    return path, (doc or "").strip() or None, broken, found.entities, found.imports, found.calls, found.findings


def parsed(files: DataFrame) -> DataFrame:
    """One row per Python file of files (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [parse(p, t.replace("\r\n", "\n").replace("\r", "\n")) for p, t in zip(batch["path"], batch["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["file", "module_docstring", "had_syntax_errors", "entities", "imports", "calls", "findings"])

    return files.filter(F.col("path").rlike(r"\.pyi?$") & F.col("text").isNotNull()).select("path", "text").mapInPandas(run, SCHEMA)


def entities(parsed_: DataFrame) -> DataFrame:
    """One row per id: of repeated definitions the last counts."""
    rows = parsed_.select("file", F.posexplode("entities").alias("ord", "e"))
    return rows.groupBy("file", F.col("e.id").alias("key")).agg(F.max_by("e", "ord").alias("e")).select("file", "e.*")


def exploded(parsed_: DataFrame, what: str) -> DataFrame:
    return parsed_.select("file", F.explode(what).alias("x")).select("file", "x.*")

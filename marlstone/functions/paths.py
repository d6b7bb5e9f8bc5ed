"""Column expressions over paths, names and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that are never scanned, and what names and extensions mean.
IGNORED_DIRS = [
    ".git", ".hg", ".svn", "node_modules", "bower_components", "venv", ".venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".eggs", "site-packages",
    "dist", "build", "out", "target", "coverage", "htmlcov", ".idea", ".vscode", ".next", ".nuxt", ".terraform", ".gradle", ".cache", "vendor",
]
BINARY_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "svgz", "webp", "tiff", "mp3", "mp4", "wav", "avi", "mov", "mkv", "flac", "ogg", "webm", "zip", "tar", "gz", "bz2", "xz", "7z", "rar", "jar", "war",
    "exe", "dll", "so", "dylib", "bin", "o", "a", "lib", "obj", "pyc", "pyd", "pyo", "class", "wasm", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "ttf", "otf", "woff", "woff2", "eot",
    "db", "sqlite", "sqlite3", "pkl", "pickle", "npy", "npz", "parquet", "iso", "img", "dmg",
]
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rb": "ruby",
    "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "php": "php", "kt": "kotlin", "swift": "swift", "scala": "scala", "sh": "shell", "bash": "shell",
    "ps1": "powershell", "sql": "sql", "html": "html", "css": "css", "scss": "css", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "config", "cfg": "config", "md": "markdown",
    "rst": "restructuredtext", "txt": "text", "xml": "xml",
}
SPECIAL_NAMES = {"dockerfile": "docker", "makefile": "make"}
ENTRY_NAMES = ["main.py", "app.py", "application.py", "manage.py", "wsgi.py", "asgi.py", "server.py", "run.py", "cli.py", "__main__.py", "index.js", "index.ts", "server.js", "app.js", "main.go", "main.rs"]
PROJECT_NAMES = [
    "requirements.txt", "requirements-dev.txt", "constraints.txt", "pyproject.toml", "setup.py", "setup.cfg", "pipfile", "pipfile.lock", "poetry.lock", "package.json", "package-lock.json", "yarn.lock",
    "pnpm-lock.yaml", "tsconfig.json", "dockerfile", "docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml", "makefile", "go.mod", "go.sum", "cargo.toml", "gemfile", "pom.xml",
    "build.gradle", "readme", "readme.md", "readme.rst", "readme.txt", "license", "license.md", "license.txt", ".gitignore", ".env.example", "manage.py",
]
TEST_DIRS = ["test", "tests", "__tests__"]
JUNK = r"(\.log|\.tmp|\.bak|\.swp|\.swo|~|\.ds_store)$"
TEST_SUFFIX = r"(_test\.py|_test\.go|\.test\.[jt]sx?|\.spec\.[jt]sx?)$"


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r"\.([^.]+)$", 1))


def language_of(path: Column) -> Column:
    special = F.create_map(*[F.lit(x) for kv in SPECIAL_NAMES.items() for x in kv])
    by_extension = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(special, F.lower(name_of(path))), F.try_element_at(by_extension, extension_of(path)))


def is_entry_point(path: Column) -> Column:
    return F.lower(name_of(path)).isin(ENTRY_NAMES)


def is_project_file(path: Column) -> Column:
    return F.lower(name_of(path)).isin(PROJECT_NAMES)


def is_test_file(path: Column, with_suffix: bool = True) -> Column:
    """Without metadata of the file (with_suffix false), only the prefix and the parents count."""
    parents = F.slice(F.split(F.lower(path), "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    found = F.lower(name_of(path)).startswith("test_") | F.arrays_overlap(parents, F.array(*map(F.lit, TEST_DIRS)))
    return found | F.lower(name_of(path)).rlike(TEST_SUFFIX) if with_suffix else found


def is_junk(path: Column) -> Column:
    return F.lower(name_of(path)).rlike(JUNK)


def is_binary_name(path: Column) -> Column:
    return extension_of(path).isin(BINARY_EXTENSIONS)


def in_ignored_dir(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, IGNORED_DIRS)))


def package_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.split(path, "/")[0]).otherwise("(root)")


def entity_id(path: Column, qualified: Column) -> Column:
    return F.concat_ws("::", path, qualified)


def file_of(entity: Column, known: Column | None = None) -> Column:
    prefix = F.substring_index(entity, "::", 1)
    return prefix if known is None else F.coalesce(known, prefix)


def module_of(path: Column) -> Column:
    """The dotted module of a Python path; null for the root's own __init__."""
    stem = F.regexp_replace(path, r"\.pyi?$", "")
    dotted = F.regexp_replace(F.regexp_replace(stem, "(^|/)__init__$", ""), "/", ".")
    return F.when(dotted != "", dotted)


def line_count(text: Column) -> Column:
    """Line feeds, and one more if the last line has none."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (feeds + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)).cast("long")


def repository_address(url: Column) -> Column:
    """struct(ok, address, name) of a repository's web address: scheme http(s), host github.com, two path parts
    of letters, digits, ``._-``, no credentials, query or fragment, port 80, 443 or none."""
    parts = r"^https?://(?:www\.)?github\.com(?::(?:80|443))?/([A-Za-z0-9._-]+)/([A-Za-z0-9._-]+?)(?:\.git)?/?$"
    owner, name = F.regexp_extract(F.trim(url), "(?i)" + parts, 1), F.regexp_extract(F.trim(url), "(?i)" + parts, 2)
    ok = (owner != "") & (name != "") & ~owner.isin(".", "..") & ~name.isin(".", "..")
    return F.struct(
        F.coalesce(ok, F.lit(False)).alias("ok"),
        F.when(ok, F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name, F.lit(".git"))).alias("address"),
        F.when(ok, name).alias("name"),
    )


def is_session_id(value: Column) -> Column:
    return F.coalesce(value.rlike("^[a-f0-9]{12}$"), F.lit(False))


def byte_label(size: Column) -> Column:
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(F.round(size / 1024, 1).cast("decimal(20,1)").cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.round(size / (1024 * 1024), 1).cast("decimal(20,1)").cast("string"), F.lit(" MB")))
    )


# What a failed clone's output says, and what that means; the first that fits.
CLONE_ERRORS = [
    ("not found|could not read username|authentication failed", "repository not found or private"),
    ("could not resolve host|unable to access", "network unavailable"),
    ("filename too long", "file name too long"),
    ("transfer closed|rpc failed|early eof", "clone interrupted"),
]


def clone_error(message: Column) -> Column:
    text, out = F.lower(message), F.lit("clone failed")
    for marks, meaning in reversed(CLONE_ERRORS):
        out = F.when(text.rlike(marks), meaning).otherwise(out)
    return out

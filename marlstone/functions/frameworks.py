"""Which framework a dependency's name stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dependency name, framework, category.
FRAMEWORKS = [
    ("fastapi", "FastAPI", "web"), ("flask", "Flask", "web"), ("django", "Django", "web"), ("starlette", "Starlette", "web"), ("aiohttp", "aiohttp", "web"),
    ("tornado", "Tornado", "web"), ("sanic", "Sanic", "web"), ("bottle", "Bottle", "web"), ("pyramid", "Pyramid", "web"), ("uvicorn", "Uvicorn", "server"),
    ("gunicorn", "Gunicorn", "server"), ("sqlalchemy", "SQLAlchemy", "data"), ("alembic", "Alembic", "data"), ("peewee", "Peewee", "data"),
    ("tortoise-orm", "Tortoise ORM", "data"), ("psycopg2", "psycopg2", "data"), ("psycopg", "psycopg", "data"), ("pymongo", "PyMongo", "data"),
    ("redis", "redis-py", "data"), ("asyncpg", "asyncpg", "data"), ("pydantic", "Pydantic", "validation"), ("marshmallow", "marshmallow", "validation"),
    ("celery", "Celery", "tasks"), ("rq", "RQ", "tasks"), ("dramatiq", "Dramatiq", "tasks"), ("pytest", "pytest", "testing"), ("unittest2", "unittest", "testing"),
    ("hypothesis", "Hypothesis", "testing"), ("click", "Click", "cli"), ("typer", "Typer", "cli"), ("argparse", "argparse", "cli"), ("requests", "Requests", "http-client"),
    ("httpx", "HTTPX", "http-client"), ("numpy", "NumPy", "data-science"), ("pandas", "pandas", "data-science"), ("scipy", "SciPy", "data-science"),
    ("scikit-learn", "scikit-learn", "ml"), ("torch", "PyTorch", "ml"), ("tensorflow", "TensorFlow", "ml"), ("transformers", "Transformers", "ml"), ("langchain", "LangChain", "ml"),
    ("react", "React", "web"), ("next", "Next.js", "web"), ("vue", "Vue", "web"), ("angular", "Angular", "web"), ("@angular/core", "Angular", "web"), ("express", "Express", "web"),
    ("svelte", "Svelte", "web"), ("jest", "Jest", "testing"), ("vitest", "Vitest", "testing"), ("mocha", "Mocha", "testing"),
]


def package_key(name: Column) -> Column:
    """Names are compared in lower case, - and _ alike."""
    return F.replace(F.lower(name), F.lit("_"), F.lit("-"))

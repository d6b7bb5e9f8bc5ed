"""The divergence audit against plain counting, and against DuckDB."""

import random

import duckdb
import pytest

from marlstone.llm import divergence
from marlstone.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, edge_rows

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def found(df):
    assert df.columns == COLUMNS
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def texts(n=160):
    r = random.Random(3)
    common = ["der", "des", "desto", "Der", "DER", "destoweniger", "x" * 70, "x" * 70 + "y", "x" * 64, "naïve", "naïf", "日本語", "日本", "a", "ab", "abc", "abcd", "abcde", "abcdef", "abcdefg"]
    rows = []
    for i in range(n):
        words = [r.choice(common) if r.random() < 0.7 else f"{r.choice('abc')}{r.choice('xyz')}q{chr(97 + i % 26)}" for _ in range(r.randrange(40))]
        rows.append((i, r.choice([" ", "-", "\n", "9"]).join(words) if i % 17 else None, r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", "", None, "é"])))
    return rows + [(n, "", "no", "only"), (n + 1, "!!", "no", "other"), (n + 2, "alone", "zz", "one")]


@pytest.mark.parametrize("threshold", [1, 3, 10, 10**6])
def test_audit(spark, threshold):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    assert found(divergence.audit(df, threshold)) == brute.audit([r[1:] for r in rows], threshold)


def test_small_blocks_and_counts(spark):
    """The same rows when terms and sources fill several blocks and tasks give their counts away often."""
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    sizes = divergence.Sizes(first_bytes=1, growth=2, filter_bits=64, texts=100, terms=4, sources=2)
    assert found(divergence.audit(df, 4, sizes=sizes)) == brute.audit([r[1:] for r in rows], 4)


def test_odd_rows(spark):
    odd = edge_rows()
    want = brute.audit([(r[1], r[2], r[3]) for r in odd], 2)
    assert found(divergence.audit(spark.createDataFrame(odd, SCHEMA).repartition(3), 2)) == want
    assert found(divergence.audit(spark.createDataFrame([], SCHEMA))) == set()


def test_prefixes_of_rare_terms_go(spark):
    """A level counts only what extends a prefix of enough documents."""
    rows = [(i, f"common{chr(97 + i)} zz{chr(97 + i)}{'q' * 40}", "en", "s") for i in range(6)] + [(9, "common", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    base = df.selectExpr("lang", "source", "cast(text as binary) data")
    assert [bytes(r["node"]) for r in divergence.kept_terms(base, 1).filter("length(node) = 7").collect()] == [b"common "]
    assert divergence.kept_terms(base, 2).count() == 0
    once = {bytes(r["node"]): r["n"] for r in divergence.document_counts(base.withColumn("source", base["lang"]), 3, 0, None, 1 << 20).groupBy("node").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert once[b"com"] == 7 and all(once[b"zz" + bytes([97 + i])] == 1 for i in range(6))


def test_terms_of_texts():
    texts = [b"", b"a", b" B--c ", "Ünï 9x".encode(), b"!!", b"last"]
    terms, each = divergence.terms_of(texts)
    assert [x.decode() for x in terms.to_pylist()] == ["a ", "b ", "c ", "Ünï ", "x ", "last "] and each.tolist() == [0, 1, 2, 2, 0, 1]
    assert len(divergence.terms_of([b"", b"12"])[0]) == 0


def test_table(spark):
    sql = duckdb.connect()
    sql.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = sql.sql(ORACLES["op13_source_divergence"])
    assert found(QUERIES["op13_source_divergence"](spark, DATA)) == {tuple(r) for r in want.select(*COLUMNS).fetchall()}

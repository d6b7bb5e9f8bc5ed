"""The pipeline against a chain of the plain versions."""

import hashlib
from collections import Counter

from tests.llm import brute
import corpus_pipeline
from tokenizers import Tokenizer

from marlstone.llm import mixing, quality
from marlstone.llm.common import materialize
from marlstone.llm.queries import TOKENIZERS

from tests.llm.test_operators import SCHEMA, edge_rows, prose

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "mix sources", "bpe tokens"]
    kept = {r["doc_id"] for r in quality.quality(docs).filter("kept").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        whole = docs
        docs = materialize(stage(spark, docs, SF), "test-stage")
        if k < 4:
            assert docs.columns == columns
            after = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        if k == 0:
            assert {d for d, _ in after} == kept
        elif k == 1:
            left = brute.lines_left(before)
            text = dict(before)
            assert dict(after) == {d: t for d, t in left.items() if t == text[d] or brute.words(t)}
        elif k == 2:
            assert {d for d, _ in after} == {c for _, c in brute.components(before).values()}
        elif k == 3:
            want = {r["doc_id"]: r["copies"] for r in mixing.mix(whole).collect() if r["copies"]}
            assert Counter(d for d, _ in after) == Counter(want)
        else:
            library = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
            text = dict(before)
            for r in docs.collect():
                ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
                assert r["tokens"] == ids and r["n_tokens"] == len(ids)
                assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows_go_through_all_stages(spark):
    """Nulls, blanks, long and repeated texts, ties and columns with clashing names; then no rows at all."""
    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    columns = docs.columns
    clean = prose(9, 400, 5000)
    more = spark.createDataFrame([(100 + i, clean, "en", "s1", 1, 2, "x", 3, 4, 5, True) for i in range(3)] + [(200, clean + " once more", None, None, 1, 2, "x", 3, 4, 5, True), (None, None, None, None, *[None] * 7)], SCHEMA)
    for table in (docs.unionByName(more), docs.limit(0)):
        rows = table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before = rows.count()
            rows = materialize(stage(spark, rows, SF), "odd-stage")
            assert k == 4 or rows.columns == columns
            assert rows.count() <= (3 * before if k == 3 else before), name
            if k == 0 and before:
                assert {r["doc_id"] for r in rows.collect()} >= {100, 101, 102, 200} and rows.filter("text is null").isEmpty()
            if k == 2 and before:
                assert rows.filter("doc_id between 100 and 200").count() == 1
        assert before == 0 or rows.count() > 0


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0

"""Tensored banding and near duplicates against all pairs."""

import random

import numpy as np
import pytest

from marlstone.llm import minhash
from marlstone.llm.shingles import shingle_set
from tests.conftest import DATA
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, edge_rows


def edited(words, r, share):
    return [f"e{r.randrange(10**6)}" if r.random() < share else w for w in words]


def documents():
    """Families of copies with more and more edits, a large group around one base, shared passages."""
    r = random.Random(7)
    word = lambda: f"w{r.randrange(4000)}"
    out = []
    for family in range(25):
        base = [word() for _ in range(r.choice([3, 8, 40, 150]))]
        out += [edited(base, r, 0.012 * k) for k in range(7)]
    base = [word() for _ in range(200)]
    out += [edited(base, r, 0.02) for _ in range(60)]
    passage = [word() for _ in range(80)]
    out += [[*passage, *(word() for _ in range(r.randrange(60)))] for _ in range(50)]
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def check(df, rows):
    want = brute.components(rows, 3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}
    assert got == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in df.collect())


def test_near_duplicates(spark):
    rows = documents()
    check(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), rows)


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    check(minhash.near_duplicates(spark.read.parquet(f"{DATA}/documents.parquet")), rows)


def test_odd_rows(spark):
    found = minhash.near_duplicates(spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)).collect()
    assert len(found) == len(edge_rows())
    by = {r["doc_id"]: r for r in found}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[1]["kept"] and by[2]["kept"]
    assert by[4]["component_id"] == by[5]["component_id"] == 4 and by[9]["component_id"] == 8 and not by[9]["kept"]
    assert by[None]["kept"] and by[None]["n_shingles"] == 1
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("size", [1, 5, 40, 3000, 40000])
def test_keys_of_pairs(size):
    """Minhashes estimate the similarity; sets at the threshold meet in some table, unlike ones hardly ever."""
    rng = np.random.default_rng(size)
    met = 0
    for _ in range(40):
        n = max(1, size * 20 // 17)
        pool = np.unique(rng.integers(0, 1 << 63, n + n).astype(np.uint64))
        rng.shuffle(pool)
        whole = np.sort(pool[:n])
        part = np.sort(pool[: -(-n * 17 // 20)])
        assert len(np.intersect1d(minhash.table_keys(whole), minhash.table_keys(part)))
        met += len(np.intersect1d(minhash.table_keys(whole), minhash.table_keys(np.sort(pool[n:])))) > 0
    assert met == 0
    assert len(minhash.table_keys(whole)) == minhash.SMALL * (minhash.SMALL - 1) // 2


def test_minhash_rate():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    rates = [np.mean(minhash.minhashes(pool[k : k + 400]) == minhash.minhashes(pool[k + 200 : k + 600])) for k in range(0, 2400, 10)]
    assert abs(np.mean(rates) - 1 / 3) < 0.03
    text = "a b c d e f g h i j k l".encode()
    assert len(shingle_set(text, 3)) == 10

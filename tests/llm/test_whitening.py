"""Rank-one updates and whitening against a dense eigendecomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import whitening
from marlstone.llm.queries import QUERIES
from tests.llm import brute
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<double>, component int, n long, id long, vector string, part int"


def rows_of(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x", 4) for i, v in vectors], SCHEMA).repartition(3)


def compare(df, vectors, components=32):
    """df against the plain version of usable vectors [(id, vector)], ids distinct."""
    n, deviation, white, values, trace = brute.whitened(vectors, components)
    at = {i: k for k, (i, _) in enumerate(vectors)}
    k = min(components, len(vectors[0][1]))
    rows = df.collect()
    assert sorted((r["vec_id"], r["component"]) for r in rows) == sorted((i, c) for i in at for c in range(1, k + 1))
    got = np.zeros((n, k))
    for r in rows:
        assert r["n"] == n and r["deviation"] == deviation[at[r["vec_id"]]] and r["identity_error"] <= 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-9)
        got[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    for c in range(k):
        sign = np.sign(got[:, c] @ white[:, c])
        assert np.abs(sign * got[:, c] - white[:, c]).max() < 1e-6


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_rank_one_updates(d):
    rng = np.random.default_rng(d)
    kinds = [rng.normal(size=(50, d)), np.repeat(rng.normal(size=(3, d)), 20, 0), rng.integers(-1, 2, (60, d)), np.eye(d), np.zeros((4, d)), rng.normal(size=(30, d)) * 10.0 ** rng.integers(-6, 6, d)]
    for x in kinds:
        values, basis = np.zeros(d), np.eye(d)
        whole = np.zeros((d, d))
        with np.errstate(all="ignore"):
            for row in x.astype(float):
                values, basis = whitening.rank_one(values, basis, row)
        whole = x.T.astype(float) @ x
        size = max(1e-300, np.abs(whole).max())
        assert np.all(np.diff(values) >= 0)
        assert np.abs(basis.T @ basis - np.eye(d)).max() < 1e-10
        assert np.abs((basis * values) @ basis.T - whole).max() <= 1e-10 * size
        assert np.abs(values - np.linalg.eigvalsh(whole)).max() <= 1e-10 * size


def test_secular_roots():
    rng = np.random.default_rng(3)
    for scale in (1.0, 1e-8, 1e-14):
        d = np.cumsum(rng.random(20) * np.where(rng.random(20) < 0.5, 1.0, scale) + 1e-14)
        zz = rng.random(20) * np.where(rng.random(20) < 0.5, 1.0, scale) + 1e-12
        origin, mu = whitening.secular_roots(d, zz)
        roots = origin + mu
        assert np.all(roots >= d) and np.all(roots[:-1] <= d[1:]) and roots[-1] <= d[-1] + zz.sum() * (1 + 1e-12)
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(zz), np.sqrt(zz)))
        assert np.abs(roots - want).max() < 1e-12 * want.max()


def test_states_merge_to_the_whole():
    rng = np.random.default_rng(5)
    x = rng.integers(-60, 60, (300, 6)) + np.array([0, 5, -9, 100, 3, 0])
    parts = []
    for cut in (x[:1], x[1:7], x[7:7], x[7:200], x[200:]):
        state = whitening.Spectrum.empty(6)
        state.add(cut)
        parts.append(whitening.Spectrum.unpacked(state.packed(), 6))
    whole = whitening.Spectrum.empty(6)
    for part in parts:
        whole.merge(part)
    apart = x - x.mean(0)
    assert whole.n == 300 and whole.sums == x.sum(0).tolist() and np.allclose(whole.mean, x.mean(0))
    assert np.allclose((whole.basis * whole.values) @ whole.basis.T, apart.T @ apart)


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    vectors = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    compare(QUERIES["op11_whitening"](spark, DATA), vectors)
    compare(whitening.whiten(table.repartition(40), components=5), vectors, 5)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    bad = [(50, None), (51, [1.0, None, 2.0, 3.0]), (52, [float("nan"), 0.0, 0.0, 0.0]), (53, [float("inf"), 1.0, 1.0, 1.0]), (54, [1.0, 2.0]), (55, [])]
    compare(whitening.whiten(rows_of(spark, good + bad)), good)
    # Repeated and null ids are rows of their own.
    odd = whitening.whiten(rows_of(spark, good + [(0, good[0][1]), (None, good[1][1])]))
    assert odd.count() == 42 * 4 and odd.filter("vec_id is null").count() == 4 and odd.filter("vec_id = 0").count() == 8
    # Large entries are exact as long as a sum fits a long.
    large = [(i, [v * 1e5 for v in x]) for i, x in good]
    n, deviation, *_ = brute.whitened(large)
    assert {r["vec_id"]: r["deviation"] for r in whitening.whiten(rows_of(spark, large)).collect()} == dict(zip(range(40), deviation, strict=True))
    assert whitening.whiten(rows_of(spark, good[:5] + [(9, [1e300, -1e300, 0.0, 1.0])])).filter("vec_id = 9 and deviation is null").count() == 4


def test_fewer_vectors_than_components(spark):
    few = whitening.whiten(rows_of(spark, [(1, [1.0, 0.0, 3.0]), (2, [0.0, 1.0, 3.0])])).collect()
    assert len(few) == 6
    for r in few:
        assert (r["whitened"] is None) == (r["component"] > 1) and r["identity_error"] < 1e-12
        assert r["explained"] == pytest.approx(1.0 if r["component"] == 1 else 0.0)
    same = whitening.whiten(rows_of(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert len(same) == 6 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in same)


def test_no_vectors(spark):
    empty = whitening.whiten(rows_of(spark, [(1, None)]))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(rows_of(spark, []).filter(F.lit(False))).count() == 0

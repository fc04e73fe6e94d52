import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterbook.llm import whitening as W
from meterbook.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, whitened string"


def valid(v, dim):
    return v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)


def whole(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def by_definition(vectors):
    """Exact deviations, and the eigenvectors of the covariance as a whole."""
    x = np.array(vectors, object)
    n, sums = len(x), x.sum(axis=0)
    deviations = [int(((n * row - sums) ** 2).sum()) for row in x]
    centred = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, q = np.linalg.eigh(centred.T @ centred / n)
    return n, deviations, centred, values[::-1], q[:, ::-1]


def solved(x, wanted=32, parts=5, **more):
    """The solver on a matrix in memory, summed as tasks would."""
    centre = W.Centre(len(x), [int(v) for v in x.sum(axis=0)])
    solver = W._Solver(None, centre, wanted, more.get("guard", 8))
    c = centre.centred(x)
    return solver.solve(float(np.square(c).sum()) / len(x)), c


@pytest.fixture
def in_memory(monkeypatch):
    def use(x):
        monkeypatch.setattr(W, "_summed", lambda rows, part, shape: sum(part(p) for p in np.array_split(x, 5)))
        return x

    return use


RNG = np.random.default_rng(3)
CASES = {
    "flat spectrum": RNG.standard_normal((3000, 120)) * 500,
    "clusters": RNG.standard_normal((1500, 64)) * 20 + 300 * RNG.standard_normal((6, 64))[RNG.integers(0, 6, 1500)],
    "steep": RNG.standard_normal((2000, 90)) * np.logspace(0, 5, 90),
    "low rank": RNG.integers(-99, 99, (800, 4)) @ RNG.integers(-5, 5, (4, 70)),
    "fewer rows than dimensions": RNG.integers(-50, 50, (20, 80)),
    "few dimensions": RNG.integers(-50, 50, (500, 5)),
    "equal values": np.vstack([np.eye(60), -np.eye(60)]) * 64,
    "one direction doubled": np.hstack([RNG.integers(-50, 50, (400, 45))] * 2),
    "equal rows": np.ones((9, 50)) * 7,
    "one row": np.ones((1, 50)) * 7,
}


@pytest.mark.parametrize("case", CASES)
def test_components_equal_a_direct_solution(case, in_memory):
    x = in_memory(CASES[case].astype(np.int64) + 1_000_000)
    model, c = solved(x)
    covariance = c.T @ c / len(x)
    values = np.linalg.eigvalsh(covariance)[::-1]
    rank = int((values[: min(32, x.shape[1])] > max(values[0], 1e-300) * 1e-12).sum())
    assert len(model.values) == rank
    if not rank:
        return
    assert np.allclose(model.values, values[:rank], rtol=1e-9 if case == "steep" else 1e-12, atol=0)
    q = model.components
    assert np.abs(q.T @ q - np.eye(rank)).max() < 1e-13
    assert np.linalg.norm(covariance @ q - q * model.values, axis=0).max() < 1e-12 * values[0]
    w = model.apply(x)
    assert np.abs(w.T @ w / len(x) - np.eye(rank)).max() < 1e-8
    assert np.allclose(model.explained, values[:rank] / values.sum(), rtol=1e-8)


def test_filter_needs_few_passes(in_memory):
    for case in ("flat spectrum", "clusters"):
        model, _ = solved(in_memory(CASES[case].astype(np.int64)))
        assert model.passes < 150 and model.residual < W.ROUNDING


def test_exact_deviations_beyond_64_bits():
    x = np.array([[1 << 40, 5], [-(1 << 40), 6], [3, 7]])
    centre = W.Centre(3, [int(v) for v in x.sum(axis=0)])
    assert centre.deviations(x) == by_definition(x.tolist())[1]
    assert centre.deviations(x[:, 1:] * 0 + 1)[0] > 0


def table(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 40)) * 3 + rng.standard_normal(40) * 5
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(base)]
    rows += [(5, rows[5][1], "x"), (5, rows[5][1], "x"), (None, rows[9][1], None)]
    bad = [math.nan, math.inf, -math.inf, None]
    rows += [(1000 + k, [b if j == k else 1.0 for j in range(40)], "bad") for k, b in enumerate(bad)]
    rows += [(2000, None, "bad"), (2001, [], "bad"), (2002, [1.0, 2.0], "short"), (2003, [3e38] * 40, "huge")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), rows


def test_query_equals_the_definition(spark, tmp_path):
    df, rows = table(spark)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    good = [(i, whole(v)) for i, v, _ in rows if valid(v, 40) and max(map(abs, v)) < 1e30]
    n, deviations, centred, values, q = by_definition([v for _, v in good])
    got = QUERIES["op12_embedding_whitening"](spark, str(tmp_path)).collect()
    assert len(got) == 32 * n and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    shares = {r.component: r.explained for r in got}
    assert np.allclose([shares[c] for c in range(1, 33)], values[:32] / values.sum(), rtol=1e-12)
    # a row is known by its deviation; either sign of a component is right, but the same for all rows
    of = {(i, d): k for k, ((i, _), d) in enumerate(zip(good, deviations))}
    w = centred @ q[:, :32] / np.sqrt(values[:32])
    want = np.array([w[of[r.vec_id, r.deviation], r.component - 1] for r in got])
    found, component = np.array([r.whitened for r in got]), np.array([r.component for r in got])
    for c in range(1, 33):
        a, b = found[component == c], want[component == c]
        assert np.allclose(a, b, atol=1e-9) or np.allclose(a, -b, atol=1e-9)


def test_most_frequent_length_and_empty_tables(spark):
    df, _ = table(spark)
    short = spark.createDataFrame([(i, [float(i % 7), float(i % 3)], "") for i in range(400)], SCHEMA)
    result = W.whiten(df.unionByName(short))
    assert result.vectors.count() == 401 and result.model.components.shape == (2, 2)
    for none in (df.limit(0), df.where("whitened = 'bad'")):
        result = W.whiten(none)
        assert result.model is None and result.vectors.collect() == []
    alone = W.whiten(df.where("vec_id = 0"))
    assert alone.vectors.select(F.size("whitened")).collect() == [(0,)] and alone.identity_error == 0.0


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = QUERIES["op12_embedding_whitening"](spark, str(tmp_path))
    assert df.collect() == [] and dict(df.dtypes)["deviation"] == "bigint"

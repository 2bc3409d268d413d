"""Whitening against plain integer arithmetic and numpy's own decomposition."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allocora.llm import queries, whitening

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]
)


def table(spark, data, partitions=3):
    made = spark.createDataFrame([(i, v, 0) for i, v in data], SCHEMA).repartition(partitions)
    return made.withColumns({c: F.lit("mine") for c in ("x", "id", "n", "i", "j", "component", "length")})


def brute(data):
    """Rows that take part, their integer vectors, n and S over the distinct ones, V in floats."""
    rows = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in data if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in rows})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    d = len(sums)
    cov = np.array([[(n * sum(x[a] * x[b] for x in fit) - sums[a] * sums[b]) / n**2 for b in range(d)] for a in range(d)])
    return rows, fit, n, sums, cov


@pytest.mark.parametrize("spread", [1, 300, 2**20, 2**28])
def test_cross_products_are_exact(spread):
    rng = np.random.default_rng(spread)
    rows = rng.integers(-spread, spread, (317, 7))
    rows[:, 3] = 5
    sums, products = whitening.cross_products(rows)
    exact = rows.astype(object)
    assert sums.tolist() == exact.sum(axis=0).tolist()
    assert (products == exact.T.dot(exact)).all()


def test_ends_of_the_integers():
    rows = np.array([[2**63 - 1, -(2**63)], [-(2**63), 0], [5, 2**63 - 1]], np.int64)
    sums, products = whitening.cross_products(rows)
    exact = rows.astype(object)
    assert sums.tolist() == exact.sum(axis=0).tolist()
    assert (products == exact.T.dot(exact)).all()


def vectors(count=200, d=6, seed=3):
    draw = random.Random(seed)
    data = []
    for i in range(count):
        a, b = draw.gauss(0, 1), draw.gauss(0, 0.5)
        data.append((i, [a + 0.1 * draw.gauss(0, 1), -a + b, b, 0.3 * draw.gauss(0, 1), 0.2 * draw.gauss(0, 1), 0.01]))
    # Copies of one vector, many and under many ids; rows that take no part; a repeated row; a null id.
    data += [(1000 + k, data[0][1]) for k in range(80)]
    data += [(2000, None), (2001, [None, *data[1][1][1:]]), (2002, [float("nan"), *data[1][1][1:]]), (2003, [float("inf"), *data[1][1][1:]])]
    data += [(7, data[7][1]), (None, data[9][1]), (2004, [])]
    return data


@pytest.mark.parametrize("partitions", [1, 5])
def test_whitened_rows(spark, partitions):
    data = vectors()
    rows, fit, n, sums, cov = brute([(i, v) for i, v in data if v != []])
    values, eig = np.linalg.eigh(cov)
    order = np.argsort(-values)[:4]
    found = whitening.whiten(table(spark, data, partitions)).collect()
    assert len(found) == 4 * len(rows)
    expected = {}
    for i, x in rows:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        away = np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)])
        for k, at in enumerate(order, 1):
            expected.setdefault((i, k), []).append((deviation, abs(float(away @ eig[:, at] / math.sqrt(values[at])))))
    signs = {}
    for r in found:
        assert r["n"] == n == len(fit)
        deviation, size = expected[r["vec_id"], r["component"]][0]
        assert r["deviation"] == deviation
        assert abs(r["whitened"]) == pytest.approx(size, abs=1e-9)
        assert r["explained"] == pytest.approx(values[order[r["component"] - 1]] / np.trace(cov), rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-9
        x = dict(rows)[r["vec_id"]]
        away = np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)]) @ eig[:, order[r["component"] - 1]]
        if abs(away) > 1e-6:
            signs.setdefault(r["component"], set()).add(np.sign(away) == np.sign(r["whitened"]))
    assert all(len(s) == 1 for s in signs.values())


def test_few_and_no_vectors(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).collect() == []
    one = whitening.whiten(table(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [1.0])])).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one) == [
        (1, 1, 1, 0, None, 0.0),
        (1, 2, 1, 0, None, 0.0),
        (2, 1, 1, 0, None, 0.0),
        (2, 2, 1, 0, None, 0.0),
    ]
    huge = whitening.whiten(table(spark, [(1, [1e38, 0.0]), (2, [-1e38, 1.0]), (3, [0.0, 0.5])])).collect()
    assert {r["deviation"] for r in huge} >= {None}
    assert len(huge) == 6


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    found = queries.QUERIES["op13_whitening"](spark, folder).collect()
    table_rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    rows, _, n, sums, cov = brute([(r["vec_id"], r["embedding"]) for r in table_rows])
    assert len(found) == 4 * len(rows)
    by = {(r["vec_id"], r["component"]): r for r in found}
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    for i, x in rows[:50]:
        for k in range(1, 5):
            r = by[i, k]
            assert (r["n"], r["deviation"]) == (n, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)))
            assert r["explained"] == pytest.approx(values[k - 1] / values.sum(), rel=1e-9)
            assert r["identity_error"] < 1e-9

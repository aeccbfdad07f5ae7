"""Near vectors of several dimensions."""

import random

import pytest

from quarryglass.operators.similar import cosine_clusters, cosine_pairs

SCHEMA = "vec_id bigint, embedding array<float>"


@pytest.mark.parametrize("stray", [[1.0], [], [1.0, 0.0, 0.0], None, [None]])
def test_a_stray_vector_hides_no_pair(spark, rows, stray):
    df = spark.createDataFrame([(0, stray), (1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], SCHEMA).coalesce(1)
    assert {(a, b) for a, b, _ in rows(cosine_pairs(df, 0.5))} == {(1, 2)}
    assert rows(cosine_clusters(df, 0.5)) == {(0, 0), (1, 1), (2, 1), (3, 3)}


@pytest.mark.parametrize("block", [3, 2_000])
def test_pairs_of_every_dimension(spark, rows, block):
    rnd = random.Random(3)
    v = {k: [rnd.gauss(0, 1) for _ in range(rnd.choice([2, 2, 2, 3, 5]))] for k in range(60)}
    cos = lambda x, y: sum(p * q for p, q in zip(x, y)) / (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5
    want = {(a, b) for a in v for b in v if a < b and len(v[a]) == len(v[b]) and 1 - cos(v[a], v[b]) <= 0.3}
    df = spark.createDataFrame(list(v.items()), "vec_id bigint, embedding array<double>")
    assert {(a, b) for a, b, _ in rows(cosine_pairs(df, 0.3, block=block))} == want and {len(v[a]) for a, _ in want} == {2, 3, 5}

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryglass.llm import packing as P
from quarryglass.llm.text_queries import TOKENIZER


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200), st.integers(100, 140))
def test_every_length_has_a_place_that_fits(lengths, capacity):
    x = np.array(lengths, np.int64)
    place, configured = P.pack(x, capacity)
    assert 0 <= configured <= place.max(initial=-1) + 1
    assert len(place) == len(x) and (place >= 0).all()
    if len(x):
        load = np.bincount(place, weights=x)
        assert load.max() <= capacity and (load > 0).all()


def test_grouping_beats_best_fit_where_sizes_combine():
    x = np.random.default_rng(1).integers(100, 256, 4000)
    plain = P._best_fit(x, 512, np.full(len(x), -1, np.int64), [])
    place, configured = P.pack(x, 512)
    assert place.max() < plain.max() * 0.97 and configured > 0.85 * place.max()


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("kind", ["even", "skewed", "two humps", "large"])
def test_grouping_needs_hardly_more_than_best_fit(kind, seed):
    rng = np.random.default_rng(seed)
    x = {"even": rng.integers(1, 513, 4000), "skewed": np.clip(rng.lognormal(4, 1, 4000).astype(int), 1, 512), "two humps": np.r_[rng.integers(20, 60, 2000), rng.integers(200, 300, 2000)], "large": rng.integers(180, 513, 3000)}[kind]
    plain = P._best_fit(x, 512, np.full(len(x), -1, np.int64), []).max() + 1
    assert P.pack(x, 512)[0].max() + 1 <= 1.005 * plain + 1


@pytest.mark.parametrize("kind", ["even", "few"])
def test_unused_space_is_small(kind):
    rng = np.random.default_rng(2)
    x = rng.integers(1, 513, 5000) if kind == "even" else np.clip(rng.lognormal(4, 1, 5000).astype(int), 1, 512)
    assert P.pack(x, 512)[0].max() + 1 <= 1.005 * x.sum() / 512 + 2


def test_pattern_is_the_best_knapsack():
    worth, p = P._best_pattern(np.array([5, 4, 3]), np.array([0.5, 0.45, 0.3]), 12)
    assert worth == pytest.approx(1.35) and (p == [0, 3, 0]).all()


COUNTS, SPECS = "doc_id bigint, tokens bigint, spec_id string", "spec_id bigint, capacity_tokens int, doc_id int"


def test_containers(spark):
    docs = [(1, 25), (2, 10), (3, 3), (4, 7), (5, 0), (6, None), (7, 10), (None, 4), (8, 30), (2, 10)]
    df = spark.createDataFrame([(*d, "x") for d in docs], COUNTS)
    specs = spark.createDataFrame([(1, 10, 0), (1, 10, 0), (2, 100, 0), (3, None, 0), (None, 5, 0)], SPECS)
    got = P.fill_containers(df, specs, shard=4).collect()
    one = [r for r in got if r.spec_id == 1 and r.container_id is not None]
    load = {}
    for r in one:
        load[r.container_id] = load.get(r.container_id, 0) + r.tokens
    assert max(load.values()) <= 10 and sum(load.values()) == sum(t or 0 for _, t in docs)
    assert sorted((r.piece, r.start_token, r.tokens) for r in one if r.doc_id == 1) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert sorted((r.piece, r.tokens) for r in one if r.doc_id == 8) == [(0, 10), (1, 10), (2, 10)]
    assert {r.doc_id for r in got if r.spec_id == 1 and r.container_id is None} == {5, 6}
    assert all(r.container_id is None for r in got if r.spec_id == 3) and len([r for r in got if r.spec_id == 3]) == len(docs)
    assert sum(1 for r in got if r.spec_id == 2) == len(docs) and not any(r.spec_id is None for r in got)
    assert P.fill_containers(df.limit(0), specs).count() == 0 and P.fill_containers(df, specs.limit(0)).count() == 0
    report = {r.spec_id: r for r in P.fill_report(P.fill_containers(df, specs, shard=4), specs).collect()}
    assert report[1].containers == len(load) and report[1].least_containers == 10 and 0 <= report[1].configured_share <= 1


def test_token_counts(spark):
    docs = [(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "ab " * 50_000)]
    got = {r.doc_id: r.tokens for r in P.token_counts(spark.createDataFrame([(*d, 3) for d in docs], "doc_id bigint, text string, tokens int"), TOKENIZER).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 50_000

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from quarryglass.llm import cooccurrence as C

ML = "file_id bigint, tags array<string>, object_counts map<string,int>, items string"


def test_baskets(spark):
    data = [
        (1, ["Red_Dog", " red dog", None, " ", "x"], {"Red-dog": 2, "cat": 0, "cow": None}, "q"), (1, ["y"], None, "q"), (2, None, None, None), (3, [], {}, None), (None, ["x"], {}, None),
    ]
    got = {r.file_id: r["items"] for r in C.media_baskets(spark.createDataFrame(data, ML)).collect()}
    assert got == {1: ["red dog", "x", "y"], 2: [], 3: []}


def brute(baskets, least, share, lift):
    n = len(baskets)
    one, two = Counter(x for b in baskets for x in b), Counter(p for b in baskets for p in combinations(sorted(b), 2))
    return {p: (t, one[p[0]], one[p[1]]) for p, t in two.items() if t >= least and t >= share * n and t * n >= lift * one[p[0]] * one[p[1]]}


def test_pairs_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "PAIRS_HELD", 20)
    monkeypatch.setattr(C, "BLOCK", 4)
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(25)]
    baskets = [{"hot"} if rnd.random() < 0.4 else set() for _ in range(400)]
    for b in baskets:
        b |= set(rnd.choices(words, k=rnd.randrange(0, 5)))
        if "w3" in b and rnd.random() < 0.9:
            b.add("w4")
    df = spark.createDataFrame([(k, list(b), {}, None) for k, b in enumerate(baskets)], ML)
    got = C.associations(df, least=5, share=0.01, lift=1.2, significant=0)
    want = brute(baskets, 5, 0.01, 1.2)
    assert want and {(r.item_a, r.item_b): (r.together, r.files_a, r.files_b) for r in got.collect()} == want
    assert all(a < b for a, b in want)
    sure = {(r.item_a, r.item_b) for r in C.associations(df, least=5, share=0.01, lift=1.2).collect()}
    assert sure == {(r.item_a, r.item_b) for r in got.where(f"llr >= {C.SIGNIFICANT}").collect()} and 0 < len(sure) < len(want)


def test_stripes_are_merged_by_item(spark):
    import pandas as pd

    one = C._as_stripes(np.array([(1 << 31) | 5, (1 << 31) | 3000, (2 << 31) | 5]), np.array([1, 2, 3]))
    assert one[["item", "block"]].to_numpy().tolist() == [[1, 0], [1, 2], [2, 0]]
    two = next(C._merged(iter([one, pd.DataFrame(columns=one.columns), one])))
    assert [x.tolist() for x in two["counts"]] == [[2], [4], [6]] and [x.tolist() for x in two["neighbours"]] == [[5], [3000], [5]]
    assert list(C._merged(iter([]))) == []


def test_no_case_of_the_least_support_and_lift_is_insignificant():
    def llr(k, a, b, n):
        h = lambda *x: sum(v * math.log(v) for v in x if v)
        return 2 * (h(k, a - k, b - k, n - a - b + k) - h(a, n - a, b, n - b) + h(n))

    rnd = random.Random(8)
    for _ in range(20_000):
        n, k = rnd.randrange(20, 5_000), rnd.randrange(5, 12)
        a, b = rnd.randrange(k, 60), rnd.randrange(k, 60)
        if a + b - k <= n and k * n >= 3 * a * b:
            assert llr(k, a, b, n) > C.SIGNIFICANT


def test_many_items_are_joined_instead_of_sent(spark, monkeypatch):
    df = spark.createDataFrame([(k, ["a", "b"] if k < 9 else ["c"], {}, None) for k in range(30)], ML)
    want = {tuple(r) for r in C.associations(df).collect()}
    monkeypatch.setattr(C, "ITEMS_BROADCAST", 0)
    assert {tuple(r) for r in C.associations(df).collect()} == want and want


def test_llr(spark):
    got = spark.range(1).select(C.llr(F.lit(110), F.lit(2552), F.lit(221), F.lit(31777))).first()[0]
    h = lambda *x: sum(v * math.log(v) for v in x if v)
    want = 2 * (h(110, 2442, 111, 29114) - h(2552, 29225, 221, 31556) + h(31777))
    assert abs(got - want) < 1e-6 and abs(spark.range(1).select(C.llr(F.lit(25), F.lit(50), F.lit(50), F.lit(100))).first()[0]) < 1e-9


def test_empty(spark):
    assert C.associations(spark.createDataFrame([], ML)).count() == 0

import random
import string

import numpy as np
import pandas as pd
import pytest

from quarryglass.llm import leakage as K

DOC, ITEM = "doc_id bigint, text string, item_id string", "item_id bigint, passage string, text int"


def words(rnd, n):
    return " ".join("".join(rnd.choices(string.ascii_lowercase, k=rnd.randrange(2, 9))) for _ in range(n))


@pytest.mark.parametrize("n", [1, 2, 3, 24, 31, 48])
def test_rolling(n):
    x = np.array([random.Random(k).randrange(9) for k in range(120)], np.uint32)
    want = []
    for i in range(len(x) - n + 1):
        v = 0
        for c in x[i : i + n]:
            v = (v * 0x9E3779B97F4A7C15 + int(c) + 1) % 2**64
        want.append(v)
    assert [int(v) for v in K.rolling(x, n)] == want and len(K.rolling(x[:0], n)) == 0


def text(codes):
    return "".join(map(chr, codes))


def test_folding():
    assert text(K.folded("Ｆull—Width, ﬁ Ⅳ é!\n​")) == "fullwidthfiivé" and text(K.folded("กำ")) == "กํา" and len(K.folded("…!")) == 0


def brute(docs, items):
    f = [(i, text(K.folded(p))) for i, p in items if p is not None]
    grams = {(i, p[k : k + 48]) for i, p in f for k in range(len(p) - 47)}
    return {(d, i) for d, t in docs if t is not None and d is not None for i, g in grams if g in text(K.folded(t))}


def test_found_agrees_with_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(K, "CHUNK", 100)
    rnd = random.Random(11)
    items = [(k, words(rnd, 30)) for k in range(8)] + [(8, "too short"), (9, None), (None, words(rnd, 30)), (10, "同じ文字列" * 20)]
    docs = [(0, None), (1, ""), (2, "   "), (None, items[0][1])]
    for d in range(3, 60):
        p = text(K.folded(items[d % 8][1]))
        n = rnd.choice([46, 47, 48, 49, 60, len(p)])
        a = rnd.randrange(0, len(p) - n + 1)
        piece = p[a : a + n]
        spaced = "".join(c + rnd.choice(["", " ", ".", "\n"]) for c in (piece.upper() if d % 2 else piece))
        docs.append((d, words(rnd, rnd.randrange(0, 40)) + "\n" + spaced + " 9 " + words(rnd, 5)))
    docs += [(70, items[1][1] + words(rnd, 5) + items[2][1]), (71, items[1][1] * 3), (72, "x" * 3000 + items[3][1]), (73, "同じ文字列" * 30), (70, items[4][1])]
    d = spark.createDataFrame([(*x, "c") for x in docs], DOC)
    i = spark.createDataFrame([(*x, 0) for x in items], ITEM)
    got = K.leaks(d, i).where(f"longest_run >= {K.RUN}").select("doc_id", "item_id")
    want = brute(docs, items)
    assert rows(got) == want and len(want) > 20
    monkeypatch.setattr(K, "BLOCK_CHARS", 200)
    assert rows(K.leaks(d, i).where(f"longest_run >= {K.RUN}").select("doc_id", "item_id")) == want


def test_edited_copies_are_scored(spark):
    rnd = random.Random(2)
    p = words(rnd, 60)
    edited = p[:150] + "zzz" + p[153:]
    d = spark.createDataFrame([(1, p, ""), (2, edited, ""), (3, words(rnd, 60), "")], DOC)
    got = {r.doc_id: r.aligned for r in K.leaks(d, spark.createDataFrame([(1, p, 0)], ITEM), edited=True).collect()}
    assert got[1] == pytest.approx(1) and 0.9 < got[2] < 1 and 3 not in got


def test_seeds_hit_every_window():
    rnd = random.Random(4)
    passages = [K.folded(words(rnd, 40))]
    g = K.all_grams(passages)
    counts = np.array([rnd.randrange(3) for _ in g.hashes])
    at = set(K.rare_seeds(passages, g, counts).position.tolist())
    assert all(any(w <= q <= w + K.RUN - K.SEED for q in at) for w in range(len(passages[0]) - K.RUN + 1)) and len(at) < len(g.hashes) / 4


def test_smith_waterman():
    c = lambda s: K._codes(s)
    assert K.smith_waterman(c("abcd"), c("xxabcdyy")) == 8 and K.smith_waterman(c("abcd"), c("abxcd")) == 6 and K.smith_waterman(c(""), c("a")) == 0


def test_joined_keeps_texts_apart():
    parts = list(K._joined(pd.Series(["ab", "cd"])))
    assert len(parts) == 1 and parts[0].tolist() == [97, 98, 0, 99, 100, 0]


def edit(rnd, t, rate):
    out = []
    for c in t:
        x = rnd.random()
        if x < rate / 3:
            continue
        out.append(rnd.choice(t) if x < 2 * rate / 3 else c)
        if 2 * rate / 3 <= x < rate:
            out.append(rnd.choice(t))
    return "".join(out)


def test_recall_on_edited_copies(spark):
    """Characters lost, changed and inserted at random, a third each, in passages of five scripts of 160 to 400 characters."""
    rnd = random.Random(7)
    scripts = [string.ascii_lowercase, "абвгдежзиклмнопрстуфхцчшыя", "اбتثجحخدذرزسشصضطعغفقكلمنهوي", "".join(map(chr, range(0x4E00, 0x4E00 + 400))), "".join(map(chr, range(0xE01, 0xE2F)))]
    items = [(k, " ".join("".join(rnd.choices(scripts[k % 5], k=rnd.randrange(3, 9))) for _ in range(rnd.randrange(30, 70)))) for k in range(60)]
    docs, want = [], {}
    for rate in (0.05, 0.10, 0.15):
        for k, p in items:
            n = len(docs)
            docs.append((n, words(rnd, 30) + " " + edit(rnd, p, rate) + " " + words(rnd, 30), ""))
            want[n] = (rate, k)
    docs += [(n, words(rnd, 300), "") for n in range(len(docs), len(docs) + 200)]
    d, i = spark.createDataFrame(docs, DOC), spark.createDataFrame([(k, p, 0) for k, p in items], ITEM)
    got = {(r.doc_id, r.item_id) for r in K.leaks(d, i, edited=True).where("aligned >= 0.5").collect()}
    for rate in (0.05, 0.10, 0.15):
        pairs = {(n, k) for n, (r, k) in want.items() if r == rate}
        assert len(got & pairs) >= 0.9 * len(pairs), (rate, len(got & pairs), len(pairs))
    assert got <= {(n, k) for n, (_, k) in want.items()}


def test_characters_changed_at_even_steps(spark):
    rnd = random.Random(3)
    items = [(k, words(rnd, 60)) for k in range(20)]
    for step in (24, 20, 12):
        docs = [(k, "".join("q" if n % step == step - 1 else c for n, c in enumerate(p)), "") for k, p in items]
        got = K.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame([(k, p, 0) for k, p in items], ITEM), edited=True).where("aligned >= 0.5")
        assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(k, k) for k in range(20)], step


def test_passages_that_repeat_themselves():
    own = [K.folded("a" * 300), K.folded("ab" * 100)]
    seeds = K.rare_seeds(own, g := K.all_grams(own), np.zeros(len(g.hashes), np.int64))
    assert K.shared_runs(K.folded("a" * 5000 + "b"), own, seeds) == {0: 300}
    assert K.shared_runs(K.folded("xyz" + "ba" * 60), own, seeds) == {1: 120}


def test_longest_run():
    c = K._codes
    assert K.longest_run(c("abcd"), c("abxd")) == 2 and K.longest_run(c("abcd"), c("abcdef")) == 4 and K.longest_run(c(""), c("a")) == 0 and K.longest_run(c("xbcx"), c("abcd")) == 2


def test_empty(spark):
    d, i = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    assert K.leaks(d, i).count() == 0 and K.leaks(d, i, edited=True).columns == ["doc_id", "item_id", "longest_run", "aligned"] and K.leaks(d, spark.createDataFrame([(1, "x" * 60, 0)], ITEM)).count() == 0

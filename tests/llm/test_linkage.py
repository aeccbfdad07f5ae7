import random
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarryglass.llm import linkage as L

CACHE = "file_id bigint, file_hash string, cached_at string, digest int"
RESULT = "file_id bigint, file_hash string, batch_id int, checked_at timestamp, new string"
CONTENT = "file_id bigint, phash string, average_hash string, bits int"
T = datetime(2024, 1, 1)


def hexed(v):
    return f"{v:016x}"


def tables(spark):
    cache = [(1, "aa", "1", 0), (1, "SHA256:AB", "2", 0), (2, None, "1", 0), (3, "0000", "1", 0), (4, "", "1", 0), (None, "ab", "1", 0), (5, "cd", "1", 0)]
    batches = [
        (10, " md5:ab\n", 1, T, "x"), (10, "ab", 1, T, "x"), (11, "aa", 1, T, ""), (12, None, 1, T, None), (13, "0000", 1, T, None),
        (20, "ab", 2, T, None), (21, "zz", 2, T, None), (22, "zz", 2, T, None), (30, "zz", 3, T, None), (None, "ab", 3, T, None), (31, "ab", None, T, None),
    ]
    content = [(2, hexed(0xF0F0), None, 1), (2, "0xF0F0".lower().replace("0x", "0x" + "0" * 12), "zz", 1), (12, hexed(0xF0F0 ^ 0b1111), None, 1), (21, hexed(0xF0F0 ^ 0b11111), None, 1), (5, "g" * 16, None, 1), (22, "g" * 16, None, 1), (None, hexed(1), None, 1)]
    return spark.createDataFrame(cache, CACHE), spark.createDataFrame(batches, RESULT), spark.createDataFrame(content, CONTENT)


#: 12 and 2 differ in 4 bits, 21 and 12 in 1, 21 and 2 in 5; 21 and 22 are of one batch.
WANT = {(1, 10), (1, 20), (10, 20), (2, 12), (12, 21), (21, 30), (22, 30)}


def records(spark):
    cache, batches, content = tables(spark)
    return L.cached_records(cache, content), L.batch_records(batches, content)


def test_found(spark, rows):
    got = L.duplicates_of_batches(*records(spark))
    assert got.columns == ["file_id_a", "file_id_b"] and rows(got) == WANT and got.count() == len(WANT)


def test_large_batches_take_another_way_to_the_same_links(spark, rows, monkeypatch):
    old = L.Linker.__init__
    monkeypatch.setattr(L.Linker, "__init__", lambda self, *a, **k: old(self, *a, **{**k, "probe_bytes": 0, "rows_per_task": 1}))
    assert rows(L.duplicates_of_batches(*records(spark))) == WANT


def test_clusters(spark, rows):
    got = rows(L.clusters_of_batches(*records(spark)))
    assert got == {(1, 1, 2), (10, 1, 2), (20, 1, 2), (2, 2, 1), (12, 2, 2), (21, 2, 2), (22, 2, 1), (30, 2, 2)}


def test_empty(spark):
    cache, batches, content = (df.limit(0) for df in tables(spark))
    c, b = L.cached_records(cache, content), L.batch_records(batches, content)
    assert L.duplicates_of_batches(c, b).count() == 0 and L.clusters_of_batches(c, b).count() == 0
    full = records(spark)
    assert L.duplicates_of_batches(c, full[1]).count() == 4


def test_weights_rise_with_agreement(spark):
    counted = [(("same", "0", "0-4"), 900), (("same", "none", "none"), 50), (("differs", "0", "0-4"), 40), (("differs", "3-4", "far"), 30)]
    w, share = L.learned_weights(counted)
    assert w["digest"]["same"] > 0 > w["digest"]["differs"] and w["bits"]["0"] > w["bits"]["3-4"] > w["bits"]["far"] and 0.5 < share <= 1
    assert L.learned_weights([])[1] == 0.5
    links = spark.createDataFrame([(1, 2, True, 0, 1), (3, 4, False, 3, None), (5, 6, False, 40, 40)], L.LINK)
    got = {r.new: r.weight for r in L.weighed(links, w).collect()}
    assert got[1] > got[3] > L.ACCEPT > got[5]


@pytest.mark.parametrize("flips", [(), (0,), (21,), (22,), (42,), (43,), (63,), (0, 1, 22, 43), (0, 21, 22, 42), (5, 30, 50, 63), (0, 1, 2, 3), (40, 41, 42, 43)])
def test_every_pair_within_the_distance_comes_out_once(spark, tmp_path, flips):
    base = -0x123456789ABCDEF
    other = base
    for f in flips:
        other ^= -(1 << 63) if f == 63 else 1 << f
    far = base ^ 0b11111
    linker = L.Linker.open(spark, str(tmp_path), clusters=False)
    frame = lambda rs: spark.createDataFrame(rs, L.RECORD)
    linker.append(frame([(1, None, base, None), (2, "d", far, None)]))
    assert [tuple(r)[:2] for r in linker.append(frame([(9, None, other, None)])).collect() if r.old == 1] == [(9, 1)]


def brute(batches):
    flat = [(k, *r) for k, b in enumerate(batches) for r in b]
    apart = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    return {
        (min(x[1], y[1]), max(x[1], y[1])) for x in flat for y in flat
        if x[0] > y[0] and x[1] != y[1] and ((x[2] and x[2] == y[2]) or (x[3] is not None and y[3] is not None and apart(x[3], y[3]) <= 4))
    }


def some_batches(seed, count, size):
    rnd = random.Random(seed)
    values = [rnd.getrandbits(64) - 2**63 for _ in range(12)]
    def record(n):
        v = rnd.choice(values)
        for _ in range(rnd.randrange(4)):
            f = rnd.randrange(64)
            v ^= -(1 << 63) if f == 63 else 1 << f
        return (n, rnd.choice([None, None, "aa", "bb", f"h{n}"]), rnd.choice([None, v, v, v]), rnd.choice([None, 5, 9]))
    return [[record(k * size + n) for n in range(size)] for k in range(count)]


def pairs(links):
    return {(min(r.new, r.old), max(r.new, r.old)) for r in links.collect()}


def roots_of(links):
    root = {}
    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(root)}


def test_sessions_compaction_and_pruning_agree_with_brute_force(spark, rows, tmp_path):
    batches = some_batches(1, 6, 25)
    frame = lambda b: spark.createDataFrame(b, L.RECORD)
    for n, b in enumerate(batches):
        linker = L.Linker.open(spark, str(tmp_path), part_rows=10)
        assert len(linker.log) == (n if n < 3 else n - 2)
        linker.append(frame(b))
        if n == 2:
            linker.compact()
    linker = L.Linker.open(spark, str(tmp_path), part_rows=10)
    assert linker.version == 1 and linker.parts == 8 and linker.members.count() == 150
    want = brute(batches)
    assert pairs(linker.accepted()) == want and rows(linker.cluster_table()) == roots_of(want)
    linker.compact()
    assert pairs(L.Linker.open(spark, str(tmp_path)).accepted()) == want and rows(L.Linker.open(spark, str(tmp_path)).cluster_table()) == roots_of(want)


def test_a_small_batch_reads_only_the_partitions_of_its_keys(spark, tmp_path):
    rnd = random.Random(3)
    linker = L.Linker.open(spark, str(tmp_path), part_rows=20, clusters=False)
    linker.append(spark.createDataFrame([(n, f"h{n}", rnd.getrandbits(63), None) for n in range(4_000)], L.RECORD))
    linker.compact()
    assert linker.parts == 200
    one = spark.createDataFrame([(9_999, "h17", None, None)], L.RECORD)
    read = linker.candidates(linker.probes(one), 1)
    assert 0 < read.count() < 100 and read.select(F.input_file_name()).distinct().count() == 1
    near = spark.createDataFrame([(9_998, None, linker.members.where("file_id = 5").first().bits ^ 3, None)], L.RECORD)
    assert linker.candidates(linker.probes(near), 1).count() < 4_000 and pairs(linker.append(near)) == {(5, 9_998)}


SESSION = """
import sys
from pyspark.sql import SparkSession
from quarryglass.llm.linkage import RECORD, Linker
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
linker = Linker.open(spark, sys.argv[1])
print(sorted((r.new, r.old) for r in linker.append(spark.createDataFrame(eval(sys.argv[2]), RECORD)).collect()), len(linker.log), sorted(map(tuple, linker.cluster_table().collect())))
"""


def test_two_processes_share_a_history(tmp_path):
    root = Path(__file__).resolve().parents[2]
    def run(batch):
        done = subprocess.run([sys.executable, "-c", SESSION, str(tmp_path / "history"), repr(batch)], cwd=root, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        return done.stdout.strip().splitlines()[-1]
    assert run([(1, "aa", 7, None), (2, "bb", None, None)]) == "[] 1 []"
    assert run([(3, "aa", 0, None), (4, None, 15, None)]) == "[(3, 1), (4, 1)] 2 [(1, 1), (3, 1), (4, 1)]"


def test_an_unfinished_step_leaves_no_trace(spark, tmp_path, monkeypatch):
    frame = lambda b: spark.createDataFrame(b, L.RECORD)
    linker = L.Linker.open(spark, str(tmp_path))
    linker.append(frame([(1, "aa", None, None)]))
    monkeypatch.setattr(L.Store, "save", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        linker.append(frame([(2, "aa", None, None)]))
    monkeypatch.undo()
    again = L.Linker.open(spark, str(tmp_path))
    assert len(again.log) == 1 and again.links.count() == 0 and again.members.count() == 1
    assert pairs(again.append(frame([(3, "aa", None, None)]))) == {(1, 3)} and again.members.count() == 2

"""Workflow tables, limits, typed records, analysers and search, on small cases."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarryglass.functions.keys import digest_by_name, look_by_name
from quarryglass.functions.texts import first_word, status_text
from quarryglass.operators import typed as T
from quarryglass.operators import workflow as W
from quarryglass.operators.search import search, search_library
from quarryglass.plans.analysers import BatchAnalyser, Registry
from quarryglass.sources.files import is_video, scan
from quarryglass.streaming.limits import next_wait, stream_waits, waits
from quarryglass.streaming.logs import poll


def test_folders():
    W.check_folders(["/a"], "/b", "/c")
    for bad in (([], "/b", None), (["/a"], "/a/x", None), (["/a/x"], "/a", None), (["/a"], "/b", "/a")):
        with pytest.raises(ValueError):
            W.check_folders(*bad)
    W.check_folders(["/ab"], "/a")


def test_preview_and_plans(spark, rows):
    f = spark.createDataFrame([(f"/s/a/{k:02}.jpg",) for k in range(12)] + [("/t/x.jpg",), (None,)], "path string")
    got = W.preview(f.where("path IS NOT NULL"), 3).collect()
    assert {(r.directory, r.files) for r in got if r.directory} == {("/s/a", 12), ("/t", 1)} and [r.total for r in got if r.total] == [13]
    assert sorted((r.place, r.path) for r in got if r.path) == [(1, "/s/a/00.jpg"), (2, "/s/a/01.jpg"), (3, "/s/a/02.jpg")]
    b = dict(map(tuple, W.backup_plan(f, "/s/", "/b/", "1").collect()))
    assert b["/s/a/00.jpg"] == "/b/backup_1/s/a/00.jpg" and b["/t/x.jpg"] == "/b/backup_1/x.jpg"
    files = spark.createDataFrame([("/1", "d", 5), ("/2", "d", None), ("/3", "e", 1), ("/4", None, 1)], "path string, digest string, size bigint")
    kept = spark.createDataFrame([("d", "/1", 9)], "digest string, kept_path string, size int")
    assert rows(W.delete_plan(files, "digest", kept)) == {("/2", "d", "/1", 0)}


def test_faces_and_rollups(spark, rows):
    box = [{"object": "face", "confidence": 0.9}]
    f = spark.createDataFrame([(1, box, None), (2, [], None), (3, box, "broken"), (4, None, None)], "id int, boxes array<struct<object:string,confidence:double>>, error string")
    assert rows(f.select("id", W.face_record(F.col("boxes"), F.col("error")).alias("r")).select("id", "r.count", "r.has_faces", "r.error")) == {(1, 1, True, None), (2, 0, False, None), (3, 0, False, "broken"), (4, 0, False, None)}
    n = spark.createDataFrame([(2,), (0,), (None,)], "n int")
    assert [n.where(W.face_filter(F.col("n"), w)).count() for w in ("all", "some", "none")] == [3, 1, 2]
    assert rows(W.face_stats(n.limit(0), "n")) == {(0, 0, 0.0, 0, 0.0)} and rows(W.face_stats(n, "n")) == {(3, 1, 33.33, 2, 2.0)}
    t = spark.createDataFrame([(["a", "b"], None), ([], None), (None, None), (["c"], "e")], "tags array<string>, error string")
    assert rows(W.embed_stats(t)) == {(1, 2, 1, 2, 2.0)} and rows(W.embed_stats(t.limit(0))) == {(0, 0, 0, 0, 0.0)}


def test_a_failed_processor_breaks_the_chain(spark):
    df = spark.createDataFrame([(1, True, True), (2, False, True), (3, True, False), (4, None, True), (5, True, None)], "id int, a boolean, b boolean")
    got = {r.id: r.ok for r in W.chained(df, [lambda d: d["a"], lambda d: d["b"]]).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False} and W.chained(df, []).first().ok is True


def test_limit():
    assert next_wait([], 5, 2, 60) == ([5], 0) and next_wait([1, 2], 61, 2, 60) == ([2, 61], 0)
    assert next_wait([1, 2], 30, 2, 60) == ([30], 31) and next_wait([0], 60, 1, 60) == ([60], 0)


def requests(spark):
    t = datetime(2024, 1, 1)
    data = [(n, n % 2, t + timedelta(seconds=s)) for n, s in enumerate([0, 0, 10, 10, 20, 70, 25, 71, 26, 72])] + [(97, None, t), (98, 1, None)]
    return spark.createDataFrame(data, "id bigint, user bigint, ts timestamp").withColumn("x", F.lit("extra"))


def brute_waits(log):
    kept, out = {}, set()
    for r in sorted((r for r in log.collect() if r.user is not None and r.ts is not None), key=lambda r: (r.user, r.ts, r.id)):
        kept[r.user], wait = next_wait(kept.get(r.user, []), int(r.ts.timestamp()) * 1_000_000, 3, 60_000_000)
        out.add((r.id, r.user, wait))
    return out


def test_waits_of_tables_and_streams(spark, rows, tmp_path):
    log = requests(spark)
    want = brute_waits(log)
    assert rows(waits(log, "user", "id", "ts", 3, 60)) == want and any(w for *_, w in want)
    assert waits(log.limit(0), "user", "id").count() == 0
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = stream_waits(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")), "user", "id", "ts", 3, 60)
    poll(found, str(tmp_path / "check"), lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/n={n}")), every="1 second")
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("id", "user", "waited_us")) == want


@pytest.mark.parametrize("kind", sorted(T.KINDS))
def test_records_of_every_kind(spark, kind):
    raw = spark.createDataFrame([("a", "{}"), ("b", "{broken"), ("c", None), ("d", '{"no_such_field": 1, "error": "e"}')], "k string, record string")
    got = {r.k: r for r in T.from_records(raw, "k", kind).collect()}
    assert set(got) == set("abcd") and got["a"].asDict().keys() == got["d"].asDict().keys()
    for name, value in T.DEFAULTS.items():
        if name in got["a"].asDict():
            assert got["a"][name] == value
    again = T.from_records(T.as_records(T.from_records(raw, "k", kind), "k", kind), "k", kind)
    assert {r.k: r for r in again.collect()} == got


def test_values_survive_the_round_trip(spark):
    df = spark.createDataFrame([(1, "/a", ["x"], 3, datetime(2024, 1, 2, 3, 4, 5), "lost")], "k int, file_path string, tags_embedded array<string>, tag_count int, embedded_at timestamp, other string")
    r = T.from_records(T.as_records(df, "k", "tag_embed"), "k", "tag_embed").first()
    assert (r.file_path, r.tags_embedded, r.tag_count, r.embedded_at, r.success) == ("/a", ["x"], 3, datetime(2024, 1, 2, 3, 4, 5), False)
    e = spark.createDataFrame([(None, "bad"), (["x"], None)], "errors array<string>, m string")
    assert [r[0] for r in T.with_error(e, "ml", "m").select("errors").collect()] == [["ml: bad"], ["x"]]


def test_analysers(spark, rows):
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return 10

    def detect(model, batch):
        if (batch["n"] == 13).any():
            raise RuntimeError("no luck")
        return pd.DataFrame({"path": batch["path"], "score": batch["n"] * model, "error": None})

    a = BatchAnalyser("path string, score bigint, error string", load, detect)
    files = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n bigint").coalesce(1)
    assert rows(a.analyse(files)) == {("a", 10, None), ("b", 20, None)} and loads.value == 1
    assert rows(a.analyse(spark.createDataFrame([("c", 13)], "path string, n bigint"))) == {("c", None, "no luck")}
    r = Registry()
    r.add("slow", 1, lambda: "slow")
    r.add("fast", 9, lambda: (_ for _ in ()).throw(ImportError))
    r.add("mid", 5, lambda: None)
    assert r.pick() == "slow" and r.pick({"mid"}) is None and Registry().pick() is None


def test_search_in_one_call(spark):
    lib = spark.createDataFrame([(1, "1920x1080", 10.0, 90.0), (2, "3840x2160", 50.0, 95.0), (3, "1920x1080", 20.0, None)], "id int, resolution string, duration double, quality double")
    tags = spark.createDataFrame([(1, "scene", "a"), (2, "scene", "b"), (3, "scene", "a"), (1, "object", "dog"), (2, "activity", "Running")], "id int, category string, tag string")
    ids = lambda **k: [r.id for r in search(lib, tags, **k).collect()]
    assert ids() == [2, 1, 3] and ids(any_tags=["a", "b"], limit=2) == [2, 1] and ids(categories={"scene": ["a"], "object": ["dog"]}) == [1]
    assert ids(no_tags=["dog"]) == [2, 3] and ids(min_quality=0) == [2, 1] and ids(resolution="1080p", min_duration=15) == [3]
    assert [r.id for r in search_library(lib, tags, activity="run").collect()] == [2]


def test_names_and_texts(spark):
    with pytest.raises(ValueError):
        digest_by_name(F.lit("x"), "crc")
    r = spark.range(1).select(digest_by_name(F.lit("x"), "md5").alias("d"), look_by_name({"phash": F.lit("p"), "w": F.lit("w")}, "odd").alias("l"), first_word(F.lit(" Big DOG")).alias("f"), first_word(F.lit("  ")).alias("u"), first_word(F.lit(None).cast("string")).alias("n"), status_text(a=F.lit(1), b=F.lit(None).cast("int"), c=F.lit("x")).alias("s")).first()
    assert (r.l, r.f, r.u, r.n, r.s) == ("p", "big", "unknown", "unknown", "a: 1 | c: x") and len(r.d) == 32


def test_scan_of_videos(spark, tmp_path):
    for n in ("a.MP4", "b.jpg", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    names = lambda df: [r.path.rpartition("/")[2] for r in df.collect()]
    assert names(scan(spark, [str(tmp_path)], wanted=is_video)) == ["a.MP4"] and names(scan(spark, [str(tmp_path)])) == ["b.jpg"]


def test_metrics_over_many_ranges(spark):
    import random
    import statistics

    from quarryglass.operators.summaries import latency_metrics

    rnd = random.Random(4)
    log = [(rnd.choice(["a", "b", "b", "b", None]), float(rnd.randrange(300)), 2) for _ in range(1_500)] + [("once", 7.0, 1), ("none", None, 1)]
    df = spark.createDataFrame(log, "name string, duration_ms double, image_count int")
    got = {r.name: r for r in latency_metrics(df, rows_per_range=37).collect()}
    for n in ("a", "b", None, "once"):
        v = sorted(x for m, x, _ in log if m == n and x is not None)
        assert got[n].calls == len(v) and got[n].median_ms == round(statistics.median(v), 2)
        assert got[n].p95_ms == round(v[min(int(0.95 * len(v)), len(v) - 1)] if len(v) > 1 else v[0], 2)
    assert set(got) == {"a", "b", None, "once"}

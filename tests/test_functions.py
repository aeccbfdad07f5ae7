from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarryglass.functions import keys, pixels, quality, tags, texts, vectors
from quarryglass.sources.cache import AnalysisCache
from quarryglass.sources.config import Settings
from quarryglass.sources.files import read_report, scan, write_report
from quarryglass.streaming.logs import each_batch, log_stream, run_to_end, windowed_counts


@pytest.fixture
def value(spark):
    return lambda *cols: tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first())


def lit(x):
    return F.lit(x)


@pytest.fixture(autouse=True)
def _columns(spark):
    """Columns need a running session."""
    global NONE, TS
    NONE = F.lit(None).cast("string")
    TS = F.lit(datetime(2024, 3, 15, 14, 30, 45)).cast("timestamp")


@pytest.mark.parametrize("pattern,want", [
    ("{datetime}", "2024-03-15_143045.jpg"), ("{date}", "2024-03-15.jpg"), ("{time}", "143045.jpg"), ("{year}_{month}_{day}", "2024_03_15.jpg"),
    ("{camera}_{datetime}", "Canon-EOS-5D_2024-03-15_143045.jpg"), ("{datetime}_{tags}", "2024-03-15_143045_landscape_sunset_nature.jpg"), ("{seq}", "{seq}.jpg"),
])
def test_patterned_names(value, pattern, want):
    t = F.array(*map(F.lit, ["landscape", "sunset", "nature", "sea"]))
    assert value(texts.patterned_name(pattern, TS, lit("Canon EOS 5D"), t, lit("/p/IMG_1.JPG")))[0] == want


def test_names(value):
    p = lit("/p/IMG_1.JPG")
    assert value(texts.patterned_name("{date}", TS, NONE, F.array(), p, date="%d-%b-%Y"), texts.patterned_name("{camera}", TS, NONE, F.array(), p)) == ("15-Mar-2024.jpg", "{camera}.jpg")
    long = value(texts.patterned_name("a" * 300, TS, NONE, F.array(), p, longest=60))[0]
    assert len(long) <= 60 and long.endswith(".jpg")
    san = lambda s: value(texts.sanitized(lit(s)))[0]
    assert san('test<>:"/\\|?*file') == "testfile" and san("my vacation photo") == "my_vacation_photo"
    assert san("test___multiple____underscores") == "test_multiple_underscores" and san("_test_file_") == "test_file"
    ok = lambda s: value(texts.valid_name(lit(s)))[0]
    assert ok("img_20240315_143045_1a2b3c4d.png") and ok("IMG_20240315_143045_1A2B3C4D.JPG")
    assert not any(map(ok, ["pic_20240315_143045_1a2b3c4d.png", "img_20240230_143045_1a2b3c4d.png", "img_20240315_143045_1a2b3c4d.exe", "img_20240315_143045_1a2b.png"]))
    assert ok(value(texts.generated_name(TS, lit(5), lit("PNG")))[0])


def test_captions(value):
    none, d = F.lit(None).cast("array<string>"), F.lit(None).cast("double")
    cap = lambda scene=NONE, objs=none, q=d, t=F.lit(None).cast("timestamp"), g=NONE: value(texts.caption(scene, objs, q, t, g))[0]
    assert cap(lit("indoors")) == "Indoors" and cap() == "Photo" and cap(q=lit(85.0)) == "High quality" and cap(q=lit(70.0)) == "Good quality" and cap(q=lit(40.0)) == "Photo"
    assert cap(lit("outdoors"), F.array(lit("Tree"), lit("sky")), t=TS, g=lit("1, 2")) == "Outdoors. containing tree, sky. taken on 2024-03-15. at 1, 2"
    assert value(texts.description(lit(85), lit("sharp")), texts.camera_info(lit(2.8), d, lit(400), lit(50.0))) == ("Quality: 85/100, Sharpness: sharp", "f/2.8, ISO 400, 50.0mm")


def test_levels(value):
    lv = lambda f, *xs: [value(f(lit(float(x))))[0] for x in xs]
    assert lv(quality.sharpness_level, 99, 100, 299, 300, 500, 999, 1000) == ["very_blurry", "slightly_blurry", "slightly_blurry", "acceptable", "sharp", "sharp", "very_sharp"]
    assert lv(quality.exposure_level, 49, 50, 85, 170, 205) == ["underexposed", "slightly_dark", "well_exposed", "slightly_bright", "overexposed"]
    assert lv(quality.color_temperature, 0.2, -0.2, 0.1) == ["warm", "cool", "neutral"]
    assert lv(quality.quality_band, 90, 75, 60, 59) == ["excellent", "good", "fair", "poor"] and lv(quality.quality_tier, 90, 70, 69) == ["high", "good", "low"]
    assert value(quality.quality_score(lit(0), lit(255), lit(127.5), lit(70)))[0] == pytest.approx(100) and value(quality.quality_score(lit(0), NONE, lit(1), lit(1)))[0] is None


def test_tags(value):
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    scores = F.create_map(lit("Beach"), lit(0.5), lit("city"), lit(0.2))
    assert value(tags.scene_tags(lit("Landscape"), scores))[0] == ["landscape", "outdoor", "beach"]
    assert value(tags.scene_tags(lit("unknown"), F.lit(None).cast("map<string,double>")))[0] == []
    assert value(tags.object_tags(arr("Dog", "cat", "thing")))[0] == ["dog", "has_animals", "cat", "has_animals", "thing"]
    assert len(value(tags.object_tags(arr(*["dog"] * 12)))[0]) == 10
    assert value(tags.quality_tags(lit(75), lit("very_sharp"), lit(501)))[0] == ["good_quality", "sharp", "crisp"]
    assert value(tags.quality_tags(NONE.cast("double"), NONE, NONE.cast("double")))[0] == ["poor_quality", "soft_focus"]
    assert value(tags.color_tags(arr("red", "blue"), lit(181), lit(61)))[0] == ["red", "warm_tones", "blue", "cool_tones", "bright", "high_contrast"]
    at = lambda s: value(tags.temporal_tags(tags.parsed_date(lit(s))))[0]
    assert at("2024:03:16 05:00:00") == ["year_2024", "spring", "morning", "weekend"] and at("2024-12-02T21:00:00") == ["year_2024", "winter", "night"] and at("junk") == []
    assert value(tags.technical_tags(lit(0.001), lit(3200), lit(2.8), lit(True), lit("Canon X")))[0] == ["fast_shutter", "high_iso", "wide_aperture", "flash_used", "canon"]
    fmt = lambda w, h, o=1: value(tags.format_tags(lit(w), lit(h), lit(o)))[0]
    assert fmt(1000, 1000, 6) == ["low_resolution", "square", "rotated"] and fmt(4000, 2000) == ["medium_resolution", "panoramic", "4k_plus"] and fmt(0, 5) == []
    assert fmt(700, 1000) == ["low_resolution", "portrait"] and fmt(1400, 1000) == ["low_resolution", "landscape"]
    people = lambda n: value(tags.people_tags(F.create_map(lit("person"), lit(n)), arr(), lit(0)))[0][0]
    assert [people(n) for n in (0, 1, 2, 5, 6)] == ["no_people", "single_person", "couple", "small_group", "crowd"]
    assert value(tags.people_tags(F.lit(None).cast("map<string,int>"), arr("person"), lit(2)))[0] == ["single_person", "has_faces"]
    assert value(tags.location_tags(lit("-1.5, 2"), lit("city")))[0] == ["geotagged", "southern_hemisphere", "outdoor", "urban"]
    assert value(tags.mood_tags(lit(160), arr("Yellow"), lit("sunset beach")))[0] == ["cheerful", "romantic"]
    by = {c: arr(*[f"{c}{k}" for k in range(4)]) for c in tags.V.CATEGORIES}
    flat = value(tags.flat_tags(by))[0]
    assert len(flat) == 30 and flat[:4] == ["scene0", "scene1", "scene2", "scene3"] and not any(t.startswith("format") for t in flat)


def test_keys(value):
    d = lambda s: value(keys.digest(lit(s)))[0]
    assert d(" SHA256:AB12\n") == "ab12" and d("md5: ff ") == "ff" and d("0000") is None and d("") is None
    h = lambda s: value(keys.hash64(lit(s)))[0]
    assert h("0xFFFFFFFFFFFFFFFF ") == -1 and h("8000000000000001") == -(2**63) + 1 and h("0000000000000000") == 0
    assert h("g00df99b1e6b5cde") is None and h("012f3914932570d") is None
    assert value(keys.path_key(lit(" \\library\\\\2023//x ")))[0] == "/library/2023/x" and value(keys.path_key(lit("  ")))[0] is None


def test_hashes(value):
    q = lambda b, n=4: value(texts.quick_hash(F.lit(bytearray(b)), n))[0]
    assert q(b"abcdefgh") == q(b"abcdXXXX") and q(b"abcdefghi") != q(b"abcdefghj") and q(b"abcd12345") != q(b"abcd123456")
    assert value(texts.seconds_text(lit(45.2)), texts.seconds_text(lit(150)), texts.seconds_text(lit(5400))) == ("45s", "2.5m", "1.5h")
    assert value(texts.decimal_degrees(lit(10), lit(30), lit(36), lit("s")), texts.snake_case(lit("DateTimeOriginal"))) == (-10.51, "date_time_original")
    assert value(texts.named_objects(lit("Red Box, ,bottle ")))[0] == ["red box", "bottle"] and value(texts.searchable_tags(lit("A dog, the DOG runs!")))[0] == ["dog", "the", "runs"]


def test_vectors(value):
    a = lambda *x: F.array(*map(F.lit, x))
    assert value(vectors.cosine_distance(a(1.0, 0.0), a(0.0, 2.0)), vectors.cosine_distance(a(0.0), a(1.0))) == (1.0, None)
    assert value(vectors.argmax_label(a(1.0, 3.0, 3.0), ("x", "y", "z")))[0] == "y" and sum(value(vectors.softmax(a(1.0, 2.0)))[0]) == pytest.approx(1)


def test_pixels(spark):
    flat, edge = [[10.0] * 16 for _ in range(16)], [[0.0] * 8 + [255.0] * 8 for _ in range(16)]
    df = spark.createDataFrame([(1, flat), (2, edge), (3, None), (4, []), (5, [[1.0], [1.0, 2.0]])], "id int, p array<array<double>>")
    s = {r.id: r.s for r in df.select("id", pixels.pixel_statistics("p").alias("s")).collect()}
    assert tuple(s[1]) == (0.0, 0.0, 0.0, 10.0, 0.0) and s[2].spread == 255 and s[2].sharpness > 0 and s[3].noise is None and s[4].noise is None and s[5].noise is None
    h = {r.id: r.h for r in df.select("id", pixels.perceptual_hashes("p").alias("h")).collect()}
    assert h[2].average == "0f" * 8 and len(h[2].perceptual) == 16 and h[3].average is None
    rgb = spark.createDataFrame([([[255.0, 0.0, 0.0]] * 6 + [[0.0, 0.0, 255.0]] * 2,), (None,)], "p array<array<double>>")
    got = [r.c for r in rgb.select(pixels.dominant_colors()("p").alias("c")).collect()]
    assert [(c.rgb, c.percentage) for c in got[0]] == [([255, 0, 0], 75.0), ([0, 0, 255], 25.0)] and got[1] is None


def test_scan_and_reports(spark, tmp_path):
    for n in ("a/x.jpg", "a/b/y.PNG", "a/z.txt", "c/w.Jpeg"):
        p = tmp_path / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"1")
    names = lambda *r, **k: [x.path.rpartition("/")[2] for x in scan(spark, [str(tmp_path / d) for d in r], **k).collect()]
    assert names("a", "c", "a") == ["y.PNG", "x.jpg", "w.Jpeg"] and names("a", recursive=False) == ["x.jpg"]
    with pytest.raises(ValueError):
        scan(spark, [])
    (tmp_path / "r.json").write_text('[{"a": 1, "b": "x"}, {"a": 2, "zz": 3}]')
    df = read_report(spark, str(tmp_path / "r.json"), "a int, b string")
    assert {tuple(r) for r in df.collect()} == {(1, "x"), (2, None)}
    for kind in ("json", "csv", "parquet"):
        write_report(df, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    with pytest.raises(ValueError):
        write_report(df, "x", "xls")


def test_analysis_cache(spark, tmp_path):
    c = AnalysisCache(spark, str(tmp_path / "cache"))
    row = lambda p, at, h="h": (p, h, 1, 1.0, "{}", at, 1)
    from quarryglass.sources.cache import SCHEMA

    assert c.read().count() == 0 and tuple(c.stats().first()) == (0, 0, None, None)
    c.put(spark.createDataFrame([row("a", "1"), row("a", "2", "new"), row("b", "1")], SCHEMA))
    c.put(spark.createDataFrame([row("b", "3", "newer")], SCHEMA))
    assert {(r.file_path, r.file_hash) for r in c.read().collect()} == {("a", "new"), ("b", "newer")}
    c.invalidate(spark.createDataFrame([("a",)], "file_path string"))
    assert [r.file_path for r in c.read().collect()] == ["b"]
    c.clear()
    assert c.read().count() == 0


def test_settings(tmp_path):
    s = Settings({"ml": {"batch_size": 16}, "own": {"x": 1}})
    assert s.get("ml.batch_size") == 16 and s.get("ml.precision") == "fp32" and s.get("own.x") == 1 and s.get("no.such", 5) == 5
    s.set("report.format", "csv")
    s.save(str(tmp_path / "s.yaml"))
    assert Settings.load(str(tmp_path / "s.yaml")).get("report.format") == "csv" and Settings.load(str(tmp_path / "none")).get("ml.batch_size") == 8
    for bad in ({"ml": {"batch_size": 0}}, {"ml": {"min_confidence": "x"}}, {"naming": {"max_filename_length": 10}}):
        with pytest.raises(ValueError):
            Settings(bad)


def test_streams(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "ts timestamp, kind string, v double"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    put([(datetime(2024, 1, 1, 10, 5), "a", 1.0), (datetime(2024, 1, 1, 10, 55), "a", 2.0), (datetime(2024, 1, 1, 11, 0), "b", None)])
    from pyspark.sql.types import _parse_datatype_string

    st = _parse_datatype_string(schema)
    run = lambda: {(r.start.hour, r.kind, r.n, r.total) for r in run_to_end(windowed_counts(log_stream(spark, src, st), "ts", "kind", "v"), str(tmp_path / "c"), str(tmp_path / "out")).collect()}
    assert run() == {(10, "a", 2, 3.0), (11, "b", 1, None)}
    put([(datetime(2024, 1, 1, 11, 30), "b", 4.0)])
    assert run() == {(10, "a", 2, 3.0), (11, "b", 2, 4.0)}
    seen = []
    for _ in range(2):
        each_batch(log_stream(spark, src, st), str(tmp_path / "c2"), lambda df, n: seen.append(df.count()))
    assert sum(seen) == 4

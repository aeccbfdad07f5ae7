from datetime import datetime

from quarryglass.llm import survivors as S

RESULT = "file_id bigint, file_path string, duplicate_of string, quality_score double, confirmed boolean, checked_at timestamp, group_id int"
IMAGE = "file_id bigint, scanned_at timestamp, model string, lens_model string, iso_speed_ratings int, latitude double, longitude double, make string, named int"
T, U = datetime(2024, 1, 1), datetime(2024, 1, 2)
NAN = float("nan")


def results(spark):
    r = [
        (1, "/l/a/1", None, 50.0, False, T, 0), (2, "/l/a/2", "\\l\\\\a//1 ", 90.0, None, T, 0), (2, "/l/a/2", None, 10.0, True, datetime(2023, 1, 1), 0),
        (3, "/l/b/3", "/gone/x", NAN, True, T, 0), (4, "/l/b/4", " /gone//x", None, None, U, 0), (5, "/l/b/5", "/gone/x", 999.0, None, U, 0),
        (6, "/l/b/6", "/l/b/6", 1.0, None, T, 0), (7, "/l/c/7", "/nobody", 1.0, None, T, 0), (8, "/l/c/8", "  ", 1.0, None, T, 0), (9, None, None, None, None, None, 0),
        (10, "/l/d/10", "/l/d/11", 70.0, False, T, 0), (11, "/l/d/11", "/l/d/12", 70.0, True, T, 0), (12, "/l/d/12", None, 70.0, True, U, 0), (13, "/l/d/13", "/l/d/12", 70.0, True, U, 0),
        (None, "/l/z", "/l/a/1", 100.0, True, U, 0),
    ]
    return spark.createDataFrame(r, RESULT)


def images(spark):
    i = [
        (2, T, " ", "L2", None, 0.0, 0.0, "M", 0), (1, T, "m1", None, 100, 5.0, 5.0, "M", 0), (1, T, "m1", None, 100, 5.0, 5.0, "M", 0),
        (4, T, None, "", None, 91.0, 1.0, None, 0), (13, T, "m13", "", 0, None, 1.0, "A", 0), (10, T, "m10", "L10", 5, 1.0, 1.0, "B", 0), (11, T, "m10", "L10", 5, 1.0, 2.0, "B", 0), (None, T, "x", "x", 1, 1.0, 1.0, "x", 0),
    ]
    return spark.createDataFrame(i, IMAGE)


def test_groups(spark, rows):
    assert rows(S.duplicate_groups(S.last_results(results(spark)))) == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (10, 10), (11, 10), (12, 10), (13, 10)}


def test_survivors(spark, rows):
    got = rows(S.survivors(results(spark), images(spark)))
    assert got == {
        (1, "kept_file", 2), (1, "model", 1), (1, "lens_model", 2), (1, "iso_speed_ratings", 1), (1, "latitude", 1),
        (3, "kept_file", 3),
        (10, "kept_file", 12), (10, "model", 13), (10, "lens_model", 11), (10, "iso_speed_ratings", 13), (10, "latitude", 11),
    }


def test_unknown_scores_rank_last_and_equal(spark, rows):
    r = spark.createDataFrame([(1, "/1", "/x", NAN, False, T, 0), (2, "/2", "/x", -1.0, True, T, 0), (3, "/3", "/x", None, True, U, 0), (4, "/4", "/x", 0.0, False, T, 0)], RESULT)
    assert (1, "kept_file", 4) in rows(S.survivors(r, images(spark).limit(0)))
    assert (1, "kept_file", 3) in rows(S.survivors(r.where("file_id < 4"), images(spark).limit(0)))


def test_empty(spark):
    r, i = results(spark).limit(0), images(spark).limit(0)
    assert S.survivors(r, i).count() == 0 and S.fused_fields(r, i).count() == 0


def test_truth_follows_reliable_sources(spark):
    claims = []
    for o in range(30):
        claims += [(o, "f", "good1", "right"), (o, "f", "good2", "right"), (o, "f", "bad1", f"w{o}"), (o, "f", "bad2", f"v{o}")]
    claims += [(99, "f", "good1", "yes"), (99, "f", "bad1", "no"), (99, "f", "bad2", "no"), (99, "f", None, "no"), (99, "f", "bad1", None), (99, "f", "bad1", "no"), (100, "f", "a", "b"), (100, "f", "c", "a")]
    got = {r.object: (r.value, r.sources) for r in S.discover_truth(spark.createDataFrame(claims, "object bigint, field string, source string, value string")).collect()}
    assert all(got[o] == ("right", 2) for o in range(30)) and got[99] == ("yes", 1) and got[100][0] == "a"


def test_fused(spark):
    got = {(r.group_id, r.field): r.value for r in S.fused_fields(results(spark), images(spark)).collect()}
    assert got[1, "model"] == "m1" and got[10, "model"] in ("m10", "m13") and (3, "model") not in got


def test_weights_and_settling(spark):
    schema = "object bigint, field string, source string, value string, weight double"
    claims = [(1, "f", "a", "x", 1.0), (1, "f", "b", "y", 3.0), (1, "f", "b", "y", 2.0), (1, "f", "c", "x", 1.0)]
    got = S.discover_truth(spark.createDataFrame(claims, schema), rounds=1).collect()
    assert [(r.value, r.support, r.sources, r.settled) for r in got] == [("y", 3.0, 1, False)]
    assert S.discover_truth(spark.createDataFrame(claims, schema)).first().settled


def test_sources_are_whole_folders(spark):
    when = datetime(2024, 1, 1)
    r = spark.createDataFrame([(k, f"/l/{'ab'[k % 2]}/2019/{k}", "/x" if k < 5 else f"/y{k // 3}", 50.0, False, when, 0) for k in range(5)], RESULT)
    i = spark.createDataFrame([(k, when, f"m{k % 2}", None, None, None, None, None, 0) for k in range(5)], IMAGE)
    got = S.fused_fields(r, i).collect()
    # the folder of three files has one claim, as the other has
    assert [(x.group_id, x.field, x.value, x.sources) for x in got] == [(0, "model", "m0", 1)]


def test_a_path_that_very_many_files_name(spark, rows, monkeypatch):
    monkeypatch.setattr(S, "NAMING_ROWS", 3)
    last = spark.createDataFrame([(k, f"/f{k}", "/gone") for k in range(40)] + [(99, "/f99", None)], "file_id bigint, path string, named string")
    assert rows(S.duplicate_groups(last)) == {(k, 0) for k in range(40)}

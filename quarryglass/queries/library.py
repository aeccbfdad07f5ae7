"""Queries on the library: search, summaries, comparison of runs, cache and metrics."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryglass.catalog import Catalog
from quarryglass.functions.quality import quality_band, quality_tier
from quarryglass.operators.assets import fresh_entries, latest, overlay_cache, remaining, upserted
from quarryglass.operators.search import has_all, search_library, with_any_tag, with_categories
from quarryglass.operators.summaries import detection_summary, error_summary, run_comparison, share, top_per_group, top_values
from quarryglass.plans.cut import Scratch
from quarryglass.queries.common import ASSET, CON, IMG, ML, analyses, assets, contents, images
from quarryglass.queries.derived import FLAT_SQL, flat
from quarryglass.sources.cache import cache_stats
from quarryglass.sources.tables import table

ANALYSIS = "struct<quality_score:double,primary_scene:string,object_count:int>"


def _library(spark, d):
    """The star of files and tags: duration is the inference time, the resolution a text."""
    a = assets(spark, d)
    lib = a.select(F.col("file_id").alias("id"), F.concat(F.col("width"), F.lit("x"), F.col("height")).alias("resolution"), F.col("inference_time").alias("duration"), F.col("quality_score").alias("quality"))
    tier = F.concat(quality_tier(F.col("quality_score")), F.lit("-quality"))
    kinds = F.array(F.struct(F.lit("quality").alias("category"), tier.alias("tag")), F.struct(F.lit("scene").alias("category"), F.col("primary_scene").alias("tag")))
    objects = F.transform(F.coalesce(F.map_keys("object_counts"), F.array().cast("array<string>")), lambda o: F.struct(F.lit("object").alias("category"), o.alias("tag")))
    tags = a.select(F.col("file_id").alias("id"), F.explode(F.concat(kinds, objects)).alias("t")).select("id", "t.category", "t.tag").where("tag IS NOT NULL").distinct()
    return lib, tags


def written_library(spark, d):
    """The same, written once: a search with several conditions reads it several times."""
    lib, tags = _library(spark, d)
    scratch = Scratch(spark, "library")
    return scratch.write(lib, "files"), scratch.write(tags, "tags")


LIBRARY = f"""{ASSET}, times AS (SELECT file_id, inference_time FROM ml),
lib AS (SELECT a.file_id AS id, width || 'x' || height AS resolution, inference_time AS duration, quality_score AS quality FROM asset a LEFT JOIN times USING (file_id)),
tags AS (SELECT DISTINCT * FROM (SELECT file_id AS id, 'quality' AS category, CASE WHEN quality_score >= 90 THEN 'high' WHEN quality_score >= 70 THEN 'good' WHEN quality_score IS NOT NULL THEN 'low' END || '-quality' AS tag FROM asset
  UNION ALL SELECT file_id, 'scene', primary_scene FROM asset UNION ALL SELECT file_id, 'object', unnest(map_keys(object_counts)) FROM asset) WHERE tag IS NOT NULL)"""

_EVENT_LOG = "log AS (SELECT event_type AS name, value AS duration_ms, (props->>'k')::INT AS image_count, ts FROM events)"


def register(c: Catalog) -> None:
    @c.query("search_library", f"""WITH {LIBRARY} SELECT id, resolution, duration, quality FROM lib WHERE id IN (SELECT id FROM tags WHERE category = 'quality' AND tag = 'high-quality')
        AND id IN (SELECT id FROM tags WHERE category = 'scene' AND contains(lower(tag), 'out')) AND duration >= 20 AND duration <= 150 ORDER BY quality DESC NULLS LAST, duration DESC NULLS LAST, id LIMIT 20""")
    def search(spark, d):
        lib, tags = written_library(spark, d)
        return search_library(lib, tags, quality="high", scene="OUT", min_duration=20, max_duration=150, limit=20)

    @c.query("search_resolution", f"WITH {LIBRARY} SELECT id, resolution, duration, quality FROM lib WHERE contains(resolution, '1920')")
    def resolution(spark, d):
        lib, tags = written_library(spark, d)
        return search_library(lib, tags, resolution="1080p", limit=None)

    @c.query("search_tags_any", f"WITH {LIBRARY} SELECT * FROM lib WHERE id IN (SELECT id FROM tags WHERE tag IN ('dog', 'cat'))")
    def any_tag_all(spark, d):
        lib, tags = written_library(spark, d)
        return with_any_tag(lib, tags, ["dog", "cat"])

    @c.query("search_categories", f"WITH {LIBRARY} SELECT * FROM lib WHERE id IN (SELECT id FROM tags WHERE category = 'object' AND tag IN ('person', 'car')) AND id IN (SELECT id FROM tags WHERE category = 'scene' AND tag IN ('city', 'outdoor'))")
    def categories_all(spark, d):
        lib, tags = written_library(spark, d)
        return with_categories(lib, tags, {"object": ["person", "car"], "scene": ["city", "outdoor"]})

    @c.query("filter_tags_all", f"WITH {FLAT_SQL} SELECT file_id FROM flat WHERE list_contains(tags, 'outdoor') AND list_contains(tags, 'geotagged')")
    def tags_all(spark, d):
        return flat(spark, d).where(has_all(F.col("tags"), ["outdoor", "geotagged"])).select("file_id")

    @c.query("filter_quality", f"WITH {ASSET} SELECT file_id FROM asset WHERE coalesce(quality_score, 0) >= 60 AND coalesce(object_counts['person'], 0) > 0")
    def quality(spark, d):
        people = F.coalesce(F.try_element_at("object_counts", F.lit("person")), F.lit(0))
        return assets(spark, d).where((F.coalesce("quality_score", F.lit(0)) >= 60) & (people > 0)).select("file_id")

    @c.query("library_stats", f"WITH {LIBRARY} SELECT count(*) AS files, count(*) FILTER (WHERE quality >= 90) AS high, count(*) FILTER (WHERE quality >= 70 AND quality < 90) AS good, count(*) FILTER (WHERE quality < 70) AS low, round(avg(duration), 4) AS mean_duration FROM lib")
    def stats(spark, d):
        lib, _ = _library(spark, d)
        t = quality_tier(F.col("quality"))
        return lib.agg(F.count(F.lit(1)).alias("files"), *(F.count_if(t == x).alias(x) for x in ("high", "good", "low")), F.round(F.avg("duration"), 4).alias("mean_duration"))

    @c.query("resolution_top5", f"WITH {LIBRARY} SELECT resolution, count(*) AS n FROM lib WHERE resolution IS NOT NULL GROUP BY resolution ORDER BY n DESC, resolution LIMIT 5")
    def resolutions(spark, d):
        return top_values(_library(spark, d)[0], F.col("resolution"), 5, "resolution")

    @c.query("tag_summary_top20", f"WITH {FLAT_SQL}, e AS (SELECT unnest(tags) AS tag FROM flat) SELECT tag, count(*) AS n FROM e GROUP BY tag ORDER BY n DESC, tag LIMIT 20")
    def top20(spark, d):
        return top_values(flat(spark, d).select(F.explode("tags").alias("t")), F.col("t"), 20, "tag")

    @c.query("tag_totals", f"WITH {FLAT_SQL}, e AS (SELECT unnest(tags) AS tag FROM flat) SELECT count(*) AS total, count(DISTINCT tag) AS different FROM e")
    def tag_totals(spark, d):
        return flat(spark, d).select(F.explode("tags").alias("t")).agg(F.count("t").alias("total"), F.count_distinct("t").alias("different"))

    @c.query("tag_category_top10", f"WITH {LIBRARY}, n AS (SELECT category, tag, count(*) AS n FROM tags GROUP BY ALL) SELECT category, tag, n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, tag) AS r FROM n) WHERE r <= 10")
    def category_top(spark, d):
        n = _library(spark, d)[1].groupBy("category", "tag").agg(F.count(F.lit(1)).alias("n"))
        return top_per_group(n, "category", [F.desc("n"), F.col("tag")], 10)

    @c.query("tag_vocabulary", f"WITH {LIBRARY} SELECT DISTINCT category, tag FROM tags")
    def vocabulary(spark, d):
        return _library(spark, d)[1].select("category", "tag").distinct()

    @c.query("pipeline_summary", f"WITH {ASSET} SELECT count(*) FILTER (WHERE error IS NOT NULL OR ml_error IS NOT NULL OR hash_error IS NOT NULL) AS with_errors, round(avg(quality_score), 4) AS mean_quality, count(DISTINCT primary_scene) AS scenes FROM asset")
    def pipeline(spark, d):
        bad = F.col("error").isNotNull() | F.col("ml_error").isNotNull() | F.col("hash_error").isNotNull()
        return assets(spark, d).agg(F.count_if(bad).alias("with_errors"), F.round(F.avg("quality_score"), 4).alias("mean_quality"), F.count_distinct("primary_scene").alias("scenes"))

    @c.query("error_summary", f"""WITH {ASSET} SELECT count(*) AS total, count(error) AS n_error, count(gps_error) AS n_gps_error, count(hash_error) AS n_hash_error, count(ml_error) AS n_ml_error,
        count(*) FILTER (WHERE error IS NULL AND gps_error IS NULL AND hash_error IS NULL AND ml_error IS NULL) AS clean, round(100.0 * count(*) FILTER (WHERE error IS NULL AND gps_error IS NULL AND hash_error IS NULL AND ml_error IS NULL) / count(*), 2) AS clean_pct FROM asset""")
    def errors(spark, d):
        return error_summary(assets(spark, d), ["error", "gps_error", "hash_error", "ml_error"])

    _valid = f"WITH {ML}, v AS (SELECT objects FROM ml WHERE objects IS NOT NULL AND error IS NULL)"

    @c.query("detection_summary", f"{_valid} SELECT count(*) AS valid, count(*) FILTER (WHERE len(objects) > 0) AS with_objects, coalesce(sum(len(objects)), 0)::BIGINT AS objects, round(avg(len(objects)), 4) AS mean_objects, (SELECT count(DISTINCT struct_extract(o, 'object')) FROM (SELECT unnest(objects) AS o FROM v)) AS labels FROM v")
    def detections(spark, d):
        return detection_summary(analyses(spark, d))

    @c.query("top_objects", f"{_valid} SELECT struct_extract(o, 'object') AS label, count(*) AS n FROM (SELECT unnest(objects) AS o FROM v) GROUP BY 1 ORDER BY n DESC, label LIMIT 10")
    def objects(spark, d):
        o = analyses(spark, d).where("objects IS NOT NULL AND error IS NULL").select(F.explode("objects.object").alias("o"))
        return top_values(o, F.col("o"), 10, "label")

    @c.query("scene_summary", f"WITH {ML} SELECT count(primary_scene) AS classified, count(DISTINCT primary_scene) AS scenes, round(avg(scene_scores[primary_scene]), 6) AS mean_confidence FROM ml")
    def scenes(spark, d):
        return analyses(spark, d).agg(F.count("primary_scene").alias("classified"), F.count_distinct("primary_scene").alias("scenes"), F.round(F.avg(F.try_element_at("scene_scores", F.col("primary_scene"))), 6).alias("mean_confidence"))

    @c.query("detection_rates", f"WITH {ML} SELECT count(*) AS files, round(100.0 * count(*) FILTER (WHERE len(objects) > 0) / count(*), 2) AS detected_pct, round(100.0 * count(*) FILTER (WHERE primary_scene <> 'unknown') / count(*), 2) AS scene_pct FROM ml")
    def rates(spark, d):
        n = F.count(F.lit(1))
        return analyses(spark, d).agg(n.alias("files"), share(F.count_if(F.size("objects") > 0), n).alias("detected_pct"), share(F.count_if(F.col("primary_scene") != "unknown"), n).alias("scene_pct"))

    @c.query("view_quality_bands", f"WITH {CON} SELECT CASE WHEN quality_score >= 90 THEN 'excellent' WHEN quality_score >= 75 THEN 'good' WHEN quality_score >= 60 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n, round(avg(quality_score), 4) AS mean, min(quality_score) AS low, max(quality_score) AS high FROM con WHERE quality_score IS NOT NULL GROUP BY 1")
    def bands(spark, d):
        q = F.col("quality_score")
        return contents(spark, d).where(q.isNotNull()).groupBy(quality_band(q).alias("band")).agg(F.count(q).alias("n"), F.round(F.avg(q), 4).alias("mean"), F.min(q).alias("low"), F.max(q).alias("high"))

    @c.query("sharpness_distribution", f"WITH {CON} SELECT sharpness_level, count(*) AS n FROM con WHERE sharpness_level IS NOT NULL GROUP BY 1")
    def sharpness(spark, d):
        return contents(spark, d).where("sharpness_level IS NOT NULL").groupBy("sharpness_level").agg(F.count(F.lit(1)).alias("n"))

    @c.query("top3_per_scene", f"""WITH {ASSET}, t AS (SELECT primary_scene FROM asset WHERE primary_scene IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, primary_scene LIMIT 5),
        r AS (SELECT primary_scene, file_id, quality_score, row_number() OVER (PARTITION BY primary_scene ORDER BY quality_score DESC, file_id) AS r FROM asset WHERE quality_score > 85 AND primary_scene IN (SELECT primary_scene FROM t)) SELECT primary_scene, file_id, quality_score FROM r WHERE r <= 3""")
    def top3(spark, d):
        a = assets(spark, d).select("primary_scene", "file_id", "quality_score")
        big = top_values(a, F.col("primary_scene"), 5, "primary_scene").select("primary_scene")
        return top_per_group(a.where("quality_score > 85").join(F.broadcast(big), "primary_scene", "left_semi"), "primary_scene", [F.desc("quality_score"), F.col("file_id")], 3)

    @c.query("people_histogram", f"WITH {ML} SELECT coalesce(object_counts['person'], 0)::INT AS people, count(*) AS files FROM ml GROUP BY 1")
    def people(spark, d):
        return analyses(spark, d).groupBy(F.coalesce(F.try_element_at("object_counts", F.lit("person")), F.lit(0)).alias("people")).agg(F.count(F.lit(1)).alias("files"))

    @c.query("compare_runs", f"""WITH {ML}, a AS (SELECT primary_scene AS scene, count(*) AS n FROM ml WHERE scene_model = 'scene-b32' AND primary_scene IS NOT NULL GROUP BY 1), b AS (SELECT primary_scene AS scene, count(*) AS n FROM ml WHERE scene_model <> 'scene-b32' AND primary_scene IS NOT NULL GROUP BY 1)
        SELECT scene, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL JOIN b USING (scene)""")
    def compare(spark, d):
        m = analyses(spark, d).where("primary_scene IS NOT NULL")
        run = lambda cond: m.where(cond).groupBy(F.col("primary_scene").alias("scene")).agg(F.count(F.lit(1)).alias("n"))
        return run("scene_model = 'scene-b32'").transform(lambda a: run_comparison(a, run("scene_model <> 'scene-b32'"), "scene", "n"))

    @c.query("phase_merge", f"WITH {ASSET} SELECT file_id, file_path, width::DOUBLE AS width, quality_score, primary_scene FROM asset")
    def merge(spark, d):
        return assets(spark, d).select("file_id", "file_path", F.col("width").cast("double").alias("width"), "quality_score", "primary_scene")

    _cached = "cached AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY cached_at DESC) AS rn FROM file_cache) WHERE rn = 1)"
    _json = "try_cast(CASE WHEN json_valid(analysis_json) THEN analysis_json->>'primary_scene' END AS VARCHAR)"

    def cached(spark, d):
        return latest(table(spark, d, "file_cache"), "file_id", F.col("cached_at"))

    @c.query("cache_overlay", f"""WITH {_cached}, {ML}, q AS (SELECT DISTINCT file_id FROM image_metadata), c AS (SELECT file_id, {_json} AS scene FROM cached)
        SELECT file_id, coalesce(c.scene, ml.primary_scene) AS scene, CASE WHEN coalesce(c.scene, ml.primary_scene) IS NULL THEN 'analysis failed' END AS error FROM q LEFT JOIN c USING (file_id) LEFT JOIN ml USING (file_id)""")
    def overlay(spark, d):
        old = cached(spark, d).select("file_id", F.from_json("analysis_json", T._parse_datatype_string(ANALYSIS), {"mode": "PERMISSIVE"})["primary_scene"].alias("scene"), "analysis_json")
        whole = F.try_parse_json("analysis_json").isNotNull()
        new = analyses(spark, d).select("file_id", F.col("primary_scene").alias("scene"))
        return overlay_cache(table(spark, d, "image_metadata", "file_id").distinct(), new, old.select("file_id", F.when(whole, F.col("scene")).alias("scene")), "file_id", "scene")

    @c.query("cache_fresh", f"""WITH {_cached}, seen AS (SELECT file_path, CASE WHEN file_id % 7 = 0 THEN 'x' || file_hash ELSE file_hash END AS h, file_size + CASE WHEN file_id % 11 = 0 THEN 1 ELSE 0 END AS s, file_mtime + (file_id % 4) * 0.5::DOUBLE AS t FROM cached)
        SELECT c.file_id, c.file_path FROM cached c JOIN seen n ON n.file_path = c.file_path AND n.h = c.file_hash AND n.s = c.file_size AND abs(c.file_mtime - n.t) < 1""")
    def fresh(spark, d):
        # files as found later: some with other bytes, another size, or changed 0 to 1.5 seconds after
        old = cached(spark, d)
        i = F.col("file_id")
        now = old.select("file_path", F.when(i % 7 == 0, F.concat(F.lit("x"), "file_hash")).otherwise(F.col("file_hash")).alias("file_hash"), (F.col("file_size") + F.when(i % 11 == 0, 1).otherwise(0)).alias("file_size"), (F.col("file_mtime") + (i % 4) * 0.5).alias("file_mtime"))
        return fresh_entries(old, now).select("file_id", "file_path")

    @c.query("cache_upsert", f"WITH {_cached}, n AS (SELECT file_path, max(file_hash) AS file_hash FROM duplication_result WHERE file_hash IS NOT NULL GROUP BY 1) SELECT file_path, file_hash FROM cached WHERE file_hash IS NOT NULL AND file_path NOT IN (SELECT file_path FROM n) UNION ALL SELECT file_path, file_hash FROM n")
    def upsert(spark, d):
        new = table(spark, d, "duplication_result", "file_path", "file_hash").where("file_hash IS NOT NULL").groupBy("file_path").agg(F.max("file_hash").alias("file_hash"))
        return upserted(cached(spark, d).select("file_path", "file_hash").where("file_hash IS NOT NULL"), new, "file_path")

    @c.query("cache_stats", f"WITH {_cached} SELECT count(*) AS entries, coalesce(sum(file_size), 0)::BIGINT AS total_size, min(cached_at) AS oldest, max(cached_at) AS newest FROM cached")
    def caches(spark, d):
        return cache_stats(cached(spark, d))

    @c.query("remaining_work", "SELECT DISTINCT file_id FROM image_metadata WHERE file_id NOT IN (SELECT file_id FROM content_analysis WHERE file_id IS NOT NULL)")
    def left(spark, d):
        return remaining(table(spark, d, "image_metadata", "file_id").distinct(), table(spark, d, "content_analysis", "file_id"), "file_id")

    @c.query("union_of_sources", "SELECT file_path FROM file_cache UNION SELECT file_path FROM duplication_result")
    def union(spark, d):
        return table(spark, d, "file_cache", "file_path").union(table(spark, d, "duplication_result", "file_path")).distinct()

    @c.query("manifest", f"WITH {IMG}, p AS (SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS directory, file_size FROM img) SELECT directory, count(*) AS files, sum(file_size)::BIGINT AS bytes FROM p GROUP BY 1")
    def manifest(spark, d):
        return images(spark, d).groupBy(F.regexp_extract("file_path", "^(.*)/[^/]*$", 1).alias("directory")).agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"))

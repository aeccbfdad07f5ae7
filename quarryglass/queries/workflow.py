"""Queries on workflow tables, faces, limits, typed records, sources and sinks."""

from pyspark.sql import functions as F

from quarryglass.catalog import Catalog
from quarryglass.functions.keys import digest_by_name, look_by_name
from quarryglass.functions.texts import first_word, plain_number, status_text
from quarryglass.operators.dedup import survivors_by
from quarryglass.operators.layout import destinations
from quarryglass.operators.search import search
from quarryglass.operators.summaries import latency_metrics, run_comparison
from quarryglass.operators.typed import as_records, from_records, with_error
from quarryglass.operators.workflow import backup_plan, batch_rollup, chained, delete_plan, embed_stats, face_filter, face_record, face_stats, manifest, preview
from quarryglass.plans.cut import Scratch
from quarryglass.queries.common import ASSET, CON, FILES, IMG, ML, analyses, assets, contents, hashed_files, images
from quarryglass.queries.derived import FACES_SQL, faces
from quarryglass.queries.library import LIBRARY, written_library
from quarryglass.queries.logs import METRICS_SQL, log_rows
from quarryglass.sources.cache import SCHEMA, AnalysisCache
from quarryglass.sources.files import is_image, read_report, write_report
from quarryglass.sources.tables import table
from quarryglass.streaming.limits import stream_waits, waits
from quarryglass.streaming.logs import each_batch, log_stream, poll

LIMIT, SECONDS = 3, 43_200
_DIR = "regexp_extract(file_path, '^(.*)[/\\\\][^/\\\\]*$', 1)"
_BASE = "regexp_extract(file_path, '([^/\\\\]*)$', 1)"
_STAMP = "20240131_120000"
_PLAIN = "regexp_replace({0}::DECIMAL(38, 12)::VARCHAR, '(\\.\\d+?)0+$', '\\1')"

#: Requests of a caller one after another, with the list of kept times.
WAITS_SQL = f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (
  SELECT event_id, user_id, n, [t] AS times, 0::BIGINT AS waited_us FROM e WHERE n = 1
  UNION ALL
  SELECT event_id, user_id, n, CASE WHEN len(live) >= {LIMIT} THEN [t] ELSE list_append(live, t) END, CASE WHEN len(live) >= {LIMIT} THEN {SECONDS * 1_000_000} - (t - live[1]) ELSE 0 END
  FROM (SELECT e.event_id, e.user_id, e.n, e.t, list_filter(r.times, lambda x: e.t - x < {SECONDS * 1_000_000}) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT event_id, user_id, waited_us FROM r"""


def register(c: Catalog) -> None:
    @c.query("search_db", f"""WITH {LIBRARY} SELECT id, resolution, duration, quality FROM lib WHERE id IN (SELECT id FROM tags WHERE tag IN ('dog', 'person', 'car'))
        AND id IN (SELECT id FROM tags WHERE category = 'scene' AND tag IN ('city', 'outdoor', 'street', 'park', 'beach')) AND id IN (SELECT id FROM tags WHERE category = 'quality' AND tag IN ('good-quality', 'high-quality'))
        AND id NOT IN (SELECT id FROM tags WHERE tag IN ('cat', 'boat')) AND duration >= 5 AND duration <= 190 AND quality >= 60 AND contains(resolution, '0') ORDER BY quality DESC NULLS LAST, duration DESC NULLS LAST, id LIMIT 50""")
    def search_db(spark, d):
        lib, tags = written_library(spark, d)
        kinds = {"scene": ["city", "outdoor", "street", "park", "beach"], "quality": ["good-quality", "high-quality"]}
        return search(lib, tags, ["dog", "person", "car"], kinds, ["cat", "boat"], min_duration=5, max_duration=190, min_quality=60, resolution="0", limit=50)

    for which, sql in (("some", "> 0"), ("none", "= 0")):
        @c.query(f"filter_faces_{which}", f"WITH {ASSET} SELECT file_id FROM asset WHERE {FACES_SQL} {sql}")
        def with_faces(spark, d, which=which):
            return assets(spark, d).where(face_filter(faces(), which)).select("file_id")

    @c.query("face_stats", f"WITH {ASSET}, f AS (SELECT {FACES_SQL}::BIGINT AS n FROM asset) SELECT count(*) AS files, count(*) FILTER (WHERE n > 0) AS with_faces, round(100.0 * count(*) FILTER (WHERE n > 0) / count(*), 2) AS with_faces_pct, sum(n)::BIGINT AS faces, round(avg(n) FILTER (WHERE n > 0), 4) AS mean_faces FROM f")
    def stats_of_faces(spark, d):
        return face_stats(assets(spark, d).select(faces().alias("n")), "n")

    @c.query("face_histogram", f"WITH {ASSET} SELECT {FACES_SQL}::INT AS faces, count(*) AS files FROM asset GROUP BY 1")
    def histogram(spark, d):
        return assets(spark, d).groupBy(faces().cast("int").alias("faces")).agg(F.count(F.lit(1)).alias("files"))

    @c.query("face_records", f"WITH {ML} SELECT file_id, CASE WHEN error IS NOT NULL THEN 0 ELSE len(list_filter(coalesce(objects, []), lambda o: struct_extract(o, 'object') = 'person')) END::INT AS faces, error FROM ml")
    def records_of_faces(spark, d):
        persons = F.filter("objects", lambda o: o["object"] == "person")
        return analyses(spark, d).select("file_id", face_record(persons, F.col("error")).alias("r")).select("file_id", F.col("r.count").alias("faces"), "r.error")

    @c.query("workflow_preview", f"""WITH {IMG}, p AS (SELECT file_path AS path, {_DIR} AS directory FROM img), h AS (SELECT path, row_number() OVER (ORDER BY path) AS r FROM p)
        SELECT directory, count(*)::DOUBLE AS files, NULL::DOUBLE AS total, NULL::DOUBLE AS place, NULL AS path FROM p GROUP BY directory UNION ALL SELECT NULL, NULL, count(*), NULL, NULL FROM p UNION ALL SELECT NULL, NULL, NULL, r, path FROM h WHERE r <= 10""")
    def previewed(spark, d):
        # counts as doubles, which keep their nulls in every reader
        out = preview(images(spark, d).select(F.col("file_path").alias("path")))
        return out.select("directory", *(F.col(x).cast("double").alias(x) for x in ("files", "total", "place")), "path")

    @c.query("workflow_manifest", f"""WITH {IMG}, k AS (SELECT file_path AS path, {_DIR} AS directory, {_BASE} AS n, row_number() OVER (PARTITION BY {_BASE} ORDER BY file_path) - 1 AS k, regexp_extract({_BASE}, '.(\\.[^.]*)$', 1) AS e FROM img)
        SELECT directory, path, '/backup/backup_{_STAMP}/' || CASE WHEN starts_with(path, '/library/') THEN 'library/' || path[10:] ELSE n END AS backup_path,
        CASE WHEN starts_with(path, '/library') THEN '/archive/' || CASE WHEN k = 0 THEN n ELSE n[1:len(n) - len(e)] || '_' || lpad(k::VARCHAR, greatest(3, len(k::VARCHAR))::INT, '0') || e END END AS destination FROM k""")
    def whole_manifest(spark, d):
        f = Scratch(spark, "manifest").write(images(spark, d).select(F.col("file_path").alias("path")))
        return manifest(f, backup_plan(f, "/library", "/backup", _STAMP), destinations(f, "/archive", "/library"))

    @c.query("delete_plan", f"""WITH {FILES}, ranked AS (SELECT *, first_value(path) OVER w AS kept_path FROM files WHERE digest IS NOT NULL WINDOW w AS (PARTITION BY digest ORDER BY coalesce(width, 0)::DOUBLE * coalesce(height, 0) + coalesce(size, 0) / 1000 DESC, path))
        SELECT path, digest, kept_path, coalesce(size, 0)::BIGINT AS size FROM ranked WHERE path <> kept_path""")
    def deleted(spark, d):
        f = Scratch(spark, "deleted").write(hashed_files(spark, d))
        return delete_plan(f, "digest", survivors_by(f, "digest", "highest_quality"))

    @c.query("embed_stats", f"""WITH {ML}, s AS (SELECT len(tags) AS n, coalesce(len(tags), 0) > 0 AS tagged, error FROM ml) SELECT count(*) FILTER (WHERE tagged AND error IS NULL) AS processed, count(*) FILTER (WHERE NOT tagged) AS skipped, count(*) FILTER (WHERE tagged AND error IS NOT NULL) AS errors,
        coalesce(sum(n) FILTER (WHERE tagged AND error IS NULL), 0)::BIGINT AS tags_written, round(coalesce(avg(n) FILTER (WHERE tagged AND error IS NULL), 0), 4) AS mean_tags FROM s""")
    def embedded(spark, d):
        return embed_stats(analyses(spark, d))

    @c.query("batch_rollup", """SELECT batch_id, count(*) AS total_files, count(*) - count(error) AS files_processed, count(error) AS files_failed, count(*) FILTER (WHERE is_duplicate) AS duplicates_found, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE deleted) AS deleted,
        round(100.0 * count(error) / count(*), 2) AS failed_pct FROM duplication_result WHERE batch_id IS NOT NULL GROUP BY batch_id""")
    def rollup(spark, d):
        return batch_rollup(table(spark, d, "duplication_result").where("batch_id IS NOT NULL"), "batch_id")

    @c.query("rate_limiter", WAITS_SQL)
    def limiter(spark, d):
        return waits(table(spark, d, "events"), "user_id", "event_id", "ts", LIMIT, SECONDS)

    @c.query("stream_rate_limiter", WAITS_SQL)
    def stream_limiter(spark, d):
        scratch = Scratch(spark, "limiter")
        schema = table(spark, d, "events").schema
        found = stream_waits(log_stream(spark, d, schema, "events.parquet"), "user_id", "event_id", "ts", LIMIT, SECONDS)
        each_batch(found, scratch.path("checkpoint"), lambda df, n: df.write.mode("overwrite").parquet(scratch.path(f"waits/n={n}")))
        return spark.read.schema(found.schema).parquet(scratch.path("waits")).select("event_id", "user_id", "waited_us")

    @c.query("stream_each_batch", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
    def batches(spark, d):
        """Counts of each micro-batch, written apart and summed; a batch that is run again overwrites its own."""
        scratch = Scratch(spark, "batches")
        source = log_stream(spark, d, table(spark, d, "events").schema, "events.parquet")
        each_batch(source, scratch.path("checkpoint"), lambda df, n: df.groupBy("event_type").count().write.mode("overwrite").parquet(scratch.path(f"counts/n={n}")))
        return spark.read.schema("event_type string, count bigint").parquet(scratch.path("counts")).groupBy("event_type").agg(F.sum("count").alias("n"))

    @c.query("stream_polled", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
    def polled(spark, d):
        scratch = Scratch(spark, "polled")
        source = log_stream(spark, d, table(spark, d, "events").schema, "events.parquet")
        poll(source, scratch.path("checkpoint"), lambda df, n: df.groupBy("event_type").count().write.mode("overwrite").parquet(scratch.path(f"counts/n={n}")), every="1 second")
        return spark.read.schema("event_type string, count bigint").parquet(scratch.path("counts")).groupBy("event_type").agg(F.sum("count").alias("n"))

    @c.query("sources_in_both", "SELECT phash FROM content_analysis WHERE phash IS NOT NULL INTERSECT SELECT average_hash FROM content_analysis UNION SELECT file_id::VARCHAR FROM (SELECT file_id FROM ml_analysis WHERE file_id IS NOT NULL INTERSECT SELECT file_id FROM image_metadata)")
    def both(spark, d):
        t = contents(spark, d)
        ids = table(spark, d, "ml_analysis", "file_id").where("file_id IS NOT NULL").intersect(table(spark, d, "image_metadata", "file_id"))
        looks = table(spark, d, "content_analysis", "phash").where("phash IS NOT NULL").intersect(t.select("average_hash"))
        return looks.union(ids.select(F.col("file_id").cast("string"))).distinct()

    @c.query("digests_by_name", "SELECT doc_id, 'md5' AS kind, md5(text) AS digest FROM documents UNION ALL SELECT doc_id, 'sha1', sha1(text) FROM documents UNION ALL SELECT doc_id, 'sha256', sha256(text) FROM documents")
    def digests(spark, d):
        t = table(spark, d, "documents", "doc_id", "text")
        each = F.array(*(F.struct(F.lit(n).alias("kind"), digest_by_name(F.col("text"), n).alias("digest")) for n in ("md5", "sha1", "sha256")))
        return t.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.kind", "x.digest")

    @c.query("looks_by_name", f"WITH {CON} SELECT file_id, phash AS unknown_name, average_hash AS average FROM con")
    def looks(spark, d):
        known = {"phash": F.col("phash"), "average_hash": F.col("average_hash")}
        return contents(spark, d).select("file_id", look_by_name(known, "no such hash").alias("unknown_name"), look_by_name(known, "average_hash").alias("average"))

    _run = "count(*) AS files, count(error) AS errors, count(*) FILTER (WHERE len(objects) > 0 AND error IS NULL) AS with_objects, coalesce(sum(len(objects)) FILTER (WHERE error IS NULL), 0)::BIGINT AS objects, count(DISTINCT primary_scene) AS scenes"

    @c.query("compare_runs_whole", f"""WITH {ML}, r AS (SELECT scene_model = 'scene-b32' AS a, {_run} FROM ml WHERE scene_model IS NOT NULL GROUP BY 1), m AS (SELECT a, unnest(['files', 'errors', 'with_objects', 'objects', 'scenes']) AS measure, unnest([files, errors, with_objects, objects, scenes]) AS n FROM r)
        SELECT measure, max(n) FILTER (WHERE a) AS n_a, max(n) FILTER (WHERE NOT a) AS n_b, max(n) FILTER (WHERE NOT a) - max(n) FILTER (WHERE a) AS change FROM m GROUP BY measure""")
    def compare_whole(spark, d):
        m = Scratch(spark, "runs").write(analyses(spark, d).where("scene_model IS NOT NULL").select("scene_model", "error", "objects", "primary_scene"))

        def run(cond):
            r = m.where(cond).agg(F.count(F.lit(1)).alias("files"), F.count("error").alias("errors"), F.count_if((F.size("objects") > 0) & F.col("error").isNull()).alias("with_objects"), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.size(F.coalesce("objects", F.array().cast("array<struct<object:string,confidence:double>>"))))), F.lit(0)).alias("objects"), F.count_distinct("primary_scene").alias("scenes"))
            return r.unpivot([], r.columns, "measure", "n")

        return run_comparison(run("scene_model = 'scene-b32'"), run("scene_model <> 'scene-b32'"), "measure", "n")

    @c.query("compare_top_objects", f"""WITH {ML}, o AS (SELECT scene_model = 'scene-b32' AS a, struct_extract(unnest(objects), 'object') AS label FROM ml WHERE scene_model IS NOT NULL AND error IS NULL), t AS (SELECT a, label, count(*) AS n, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, label) AS r FROM o WHERE label IS NOT NULL GROUP BY a, label)
        SELECT label, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b, coalesce(y.n, 0) - coalesce(x.n, 0) AS change FROM (SELECT * FROM t WHERE a AND r <= 10) x FULL JOIN (SELECT * FROM t WHERE NOT a AND r <= 10) y USING (label)""")
    def compare_objects(spark, d):
        m = analyses(spark, d).where("error IS NULL").select("scene_model", F.explode("objects.object").alias("label")).where("label IS NOT NULL")
        top = lambda cond: m.where(cond).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(10)
        return run_comparison(top("scene_model = 'scene-b32'"), top("scene_model <> 'scene-b32'"), "label", "n")

    @c.query("benchmark_top3", "SELECT event_type AS name, round(sum((props->>'k')::INT) / (sum(value) / 1000), 4) AS per_second FROM events GROUP BY 1 ORDER BY per_second DESC, name LIMIT 3")
    def top3(spark, d):
        return log_rows(spark, d).groupBy("name").agg(F.round(F.sum("image_count") / (F.sum("duration_ms") / 1000), 4).alias("per_second")).orderBy(F.desc("per_second"), "name").limit(3)

    @c.query("first_errors", f"WITH {ASSET} SELECT file_id, ml_error AS error FROM asset WHERE ml_error IS NOT NULL ORDER BY file_id LIMIT 5")
    def errors(spark, d):
        return assets(spark, d).where("ml_error IS NOT NULL").orderBy("file_id").limit(5).select("file_id", F.col("ml_error").alias("error"))

    @c.query("answer_scene", "SELECT p_partkey, coalesce(nullif(lower(regexp_extract(CASE WHEN p_partkey % 9 = 0 THEN '  ' ELSE ' ' || p_type END, '^\\s*(\\S+)', 1)), ''), 'unknown') AS scene FROM part")
    def scene(spark, d):
        answer = F.when(F.col("p_partkey") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_type"))
        return table(spark, d, "part").select("p_partkey", first_word(answer).alias("scene"))

    @c.query("status_text", f"WITH {ASSET} SELECT file_id, concat_ws(' | ', 'scene: ' || primary_scene, 'exposure: ' || exposure, 'error: ' || ml_error) AS status FROM asset")
    def status(spark, d):
        return assets(spark, d).select("file_id", status_text(scene=F.col("primary_scene"), exposure=F.col("exposure"), error=F.col("ml_error")).alias("status"))

    @c.query("processors_chained", f"WITH {ASSET} SELECT file_id, CASE WHEN quality_score IS NULL THEN false WHEN width IS NULL THEN false ELSE width > 1000 END AS ok FROM asset")
    def processors(spark, d):
        return chained(assets(spark, d), [lambda df: df["quality_score"] > 50, lambda df: df["width"] > 1000]).select("file_id", "ok")

    @c.query("image_files", "SELECT DISTINCT file_path FROM file_cache WHERE lower(regexp_extract(file_path, '[^/\\\\](\\.[^./\\\\]+)$', 1)) IN ('.jpg', '.jpeg', '.png', '.gif', '.bmp', '.tiff', '.tif', '.webp', '.heic', '.heif', '.raw', '.cr2', '.nef', '.arw', '.dng', '.orf', '.rw2', '.raf')")
    def pictures(spark, d):
        return table(spark, d, "file_cache", "file_path").distinct().where(is_image(F.col("file_path")))

    for kind in ("json", "csv"):
        @c.query(f"report_{kind}", METRICS_SQL)
        def report(spark, d, kind=kind):
            """Written as a report and read back."""
            path = Scratch(spark, "report").path(kind)
            m = latency_metrics(log_rows(spark, d))
            write_report(m, path, kind)
            if kind == "csv":
                return spark.read.schema(m.schema).option("header", True).csv(path)
            return read_report(spark, path, m.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), lines=True)

    @c.query("cache_cycle", """WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY cached_at DESC) AS rn FROM file_cache) WHERE rn = 1)
        SELECT file_path, CASE WHEN file_id % 5 = 0 THEN 'again' ELSE file_hash END AS file_hash, cache_version::DOUBLE AS cache_version FROM last WHERE file_id % 3 <> 0""")
    def cycle(spark, d):
        """Everything put, every fifth file put again with another hash, every third dropped."""
        t = table(spark, d, "file_cache")
        names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        cache = AnalysisCache(spark, Scratch(spark, "cycle").path("cache"))
        cache.put(t.select(names))
        cache.put(t.where("file_id % 5 = 0").withColumn("file_hash", F.lit("again")).withColumn("cached_at", F.lit("9999")).select(names))
        cache.invalidate(t.where("file_id % 3 = 0"))
        return cache.read().select("file_path", "file_hash", F.col("cache_version").cast("double").alias("cache_version"))

    @c.query("typed_records", f"WITH {ML} SELECT file_id, primary_scene, coalesce(tags, []) AS tags, coalesce(len(objects), 0)::INT AS n_objects, inference_time, error, NULL::DOUBLE AS gpu_memory_used FROM ml".replace("coalesce(tags, []) AS tags", "array_to_string(coalesce(tags, []), '|') AS tags"))
    def typed(spark, d):
        """Analyses as JSON records of their kind and back, with defaults for what is missing."""
        back = from_records(as_records(analyses(spark, d), "file_id", "ml_analysis"), "file_id", "ml_analysis")
        return back.select("file_id", "primary_scene", F.array_join("tags", "|").alias("tags"), F.size("objects").alias("n_objects"), "inference_time", "error", "gpu_memory_used")

    @c.query("typed_duplication", "SELECT DISTINCT file_id, coalesce(is_duplicate, false) AS is_duplicate, coalesce(kept, false) AS kept, true AS requires_confirmation, coalesce(confirmed, false) AS confirmed, coalesce(duplicate_count, 0)::INT AS duplicate_count, len(coalesce(duplicates_found, []))::INT AS found FROM duplication_result WHERE file_id IS NOT NULL")
    def typed_duplication(spark, d):
        back = from_records(as_records(table(spark, d, "duplication_result").where("file_id IS NOT NULL"), "file_id", "duplication"), "file_id", "duplication")
        return back.select("file_id", "is_duplicate", "kept", "requires_confirmation", "confirmed", "duplicate_count", F.size("duplicates_found").alias("found")).distinct()

    @c.query("record_errors", f"WITH {ASSET} SELECT file_id, concat_ws(';', 'ml: ' || ml_error, 'hash: ' || hash_error) AS errors FROM asset")
    def record_errors(spark, d):
        a = assets(spark, d).select("file_id", "ml_error", "hash_error", F.array().cast("array<string>").alias("errors"))
        return with_error(with_error(a, "ml", "ml_error"), "hash", "hash_error").select("file_id", F.array_join("errors", ";").alias("errors"))

    @c.query("metadata_records", f"WITH {IMG} SELECT file_id, {_BASE} AS file_name, round(width::DECIMAL(18, 0) * height / 1000000, 2)::DOUBLE AS megapixels, coalesce(datetime_original, strftime(scanned_at, '%Y:%m:%d %H:%M:%S')) AS taken, CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN {_PLAIN.format('latitude')} || ', ' || {_PLAIN.format('longitude')} END AS gps FROM img")
    def metadata(spark, d):
        i = images(spark, d)
        place = F.concat_ws(", ", *(plain_number(F.col(x)) for x in ("latitude", "longitude")))
        mp = F.round(F.col("width").cast("decimal(18,0)") * F.col("height") / 1_000_000, 2).cast("double")
        return i.select("file_id", F.regexp_extract("file_path", r"([^/\\]*)$", 1).alias("file_name"), mp.alias("megapixels"), F.coalesce("datetime_original", F.date_format("scanned_at", "yyyy:MM:dd HH:mm:ss")).alias("taken"), F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), place).alias("gps"))

"""Queries on logs: latency, windows, batches, retention, streams; and on pixels."""

from pyspark.sql import functions as F

from quarryglass.catalog import Catalog
from quarryglass.functions.pixels import dominant_colors, perceptual_hashes, pixel_statistics
from quarryglass.functions.texts import seconds_text
from quarryglass.operators.layout import expired_backups
from quarryglass.operators.summaries import batches_of, latency_metrics, progress, speedups, trailing_count
from quarryglass.plans.cut import Scratch
from quarryglass.sources.tables import table
from quarryglass.streaming.logs import log_stream, run_to_end, windowed_counts

_LOG = "log AS (SELECT event_type AS name, value AS duration_ms, (props->>'k')::INT AS image_count, ts FROM events)"


METRICS_SQL = f"""WITH {_LOG}, s AS (SELECT name, list_sort(list(duration_ms)) AS v, sum(image_count) AS images, sum(duration_ms::DECIMAL(18, 4)) AS total FROM log WHERE duration_ms IS NOT NULL GROUP BY name)
        SELECT name, len(v) AS calls, images::BIGINT AS images, round((total / len(v))::DOUBLE, 2) AS mean_ms, round((v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2, 2) AS median_ms,
        round(CASE WHEN len(v) < 2 THEN (total / len(v))::DOUBLE ELSE v[least(floor(0.95 * len(v))::INT, len(v) - 1) + 1] END, 2) AS p95_ms, round(images / (total / 1000)::DOUBLE, 2) AS per_second FROM s"""


def log_rows(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("value").alias("duration_ms"), k.alias("image_count"), "ts")


def register(c: Catalog) -> None:
    @c.query("model_metrics", METRICS_SQL)
    def metrics(spark, d):
        return latency_metrics(log_rows(spark, d))

    @c.query("phase_summary", f"WITH {_LOG} SELECT name, count(*) AS calls, round(sum(duration_ms), 2) AS total_ms FROM log GROUP BY name")
    def phases(spark, d):
        return log_rows(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("duration_ms"), 2).alias("total_ms"))

    @c.query("overall_throughput", f"WITH {_LOG} SELECT sum(image_count)::BIGINT AS images, round(sum(image_count) / (sum(duration_ms) / 1000), 4) AS per_second, round(max(duration_ms), 3) AS peak_ms FROM log")
    def overall(spark, d):
        return log_rows(spark, d).agg(F.sum("image_count").alias("images"), F.round(F.sum("image_count") / (F.sum("duration_ms") / 1000), 4).alias("per_second"), F.round(F.max("duration_ms"), 3).alias("peak_ms"))

    @c.query("benchmark_speedup", f"WITH {_LOG}, r AS (SELECT name, round(sum(duration_ms) / 1000, 6) AS seconds FROM log GROUP BY name) SELECT name, seconds, round(first(seconds ORDER BY name) OVER w / seconds, 4) AS speedup, seconds = min(seconds) OVER () AS best FROM r WINDOW w AS (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)".replace("first(seconds ORDER BY name) OVER w", "first_value(seconds) OVER w"))
    def speed(spark, d):
        runs = log_rows(spark, d).groupBy("name").agg(F.round(F.sum("duration_ms") / 1000, 6).alias("seconds"))
        return speedups(runs, "name", "seconds", "name")

    @c.query("eta", "WITH s AS (SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS done, epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6 AS elapsed FROM events) SELECT round(100.0 * done / total, 2) AS pct, round(done / elapsed, 4) AS rate, round((total - done) / (done / elapsed), 2) AS eta_s FROM s")
    def eta(spark, d):
        sec = lambda x: F.unix_micros(x.cast("timestamp")) / 1e6
        s = table(spark, d, "events").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") != "error").alias("done"), (sec(F.max("ts")) - sec(F.min("ts"))).alias("elapsed"))
        return s.select(*progress(F.col("total"), F.col("done"), F.col("elapsed")))

    @c.query("duration_text", "SELECT event_id, CASE WHEN v < 60 THEN round(v, 0)::BIGINT || 's' WHEN v < 3600 THEN printf('%.1f', v / 60) || 'm' ELSE printf('%.1f', v / 3600) || 'h' END AS text FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN value * 100 ELSE value END AS v FROM events)")
    def durations(spark, d):
        # errors took a hundred times as long, so that hours occur
        v = F.when(F.col("event_type") == "error", F.col("value") * 100).otherwise(F.col("value"))
        return table(spark, d, "events").select("event_id", seconds_text(v).alias("text"))

    @c.query("rate_limit_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events")
    def rate(spark, d):
        return trailing_count(table(spark, d, "events"), "ts", 3600, "user_id").select("event_id", "in_window")

    @c.query("last_hour", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1")
    def last(spark, d):
        e = table(spark, d, "events")
        end = e.agg(F.max("ts").alias("_end"))
        return e.crossJoin(F.broadcast(end)).where(F.col("ts") >= F.col("_end") - F.expr("INTERVAL 1 HOUR")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))

    @c.query("batch_chunks", "SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) // 32)::BIGINT AS batch FROM events")
    def chunks(spark, d):
        return batches_of(table(spark, d, "events", "event_id"), "event_id", 32).select("event_id", "batch")

    @c.query("retention_expired", """WITH b AS (SELECT event_id, 'backup_' || strftime(ts, '%Y%m%d_%H%M%S') AS name, ts, event_id % 3 = 0 AS verified FROM events)
        SELECT name, event_id FROM b WHERE verified AND date_trunc('second', ts) < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY""")
    def retention(spark, d):
        b = table(spark, d, "events").select("event_id", F.concat(F.lit("backup_"), F.date_format("ts", "yyyyMMdd_HHmmss")).alias("name"), (F.col("event_id") % 3 == 0).alias("verified"))
        return expired_backups(b, F.lit("2024-01-31").cast("timestamp"), 7, need_verified=True).select("name", "event_id")

    @c.query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
    def windows(spark, d):
        return windowed_counts(table(spark, d, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))

    @c.query("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
    def stream(spark, d):
        scratch = Scratch(spark, "stream")
        events = table(spark, d, "events")
        source = log_stream(spark, d, events.schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
        counts = windowed_counts(source, "ts", "event_type", "value").select("start", "kind", "n")
        return run_to_end(counts, scratch.path("checkpoint"), scratch.path("windows"))

    def pictures(spark, d):
        """Each vector as a grey picture of 8 x 8."""
        grey = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), x.cast("double") * 200 + 128)))
        rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice(grey, k * 8 + 1, 8))
        return table(spark, d, "embeddings").select("vec_id", rows.alias("picture"))

    _GREY = "list_transform(embedding, lambda x: greatest(0.0, least(255.0, x::DOUBLE * 200 + 128)))"

    @c.query("pixel_stats", f"SELECT vec_id, floor(list_avg({_GREY}) * 10 + 1e-6)::BIGINT AS brightness, floor((list_max({_GREY}) - list_min({_GREY})) * 10 + 1e-6)::BIGINT AS spread FROM embeddings")
    def pixels(spark, d):
        s = pictures(spark, d).select("vec_id", F.expr("transform(flatten(picture), x -> x)").alias("v"), "picture")
        mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / 64
        return s.select("vec_id", F.floor(mean * 10 + 1e-6).alias("brightness"), F.floor((F.array_max("v") - F.array_min("v")) * 10 + 1e-6).alias("spread"))

    _at = "g[({0}) * 8 + ({1}) + 1]"
    _up, _down = "CASE WHEN k // 8 = 0 THEN 1 ELSE k // 8 - 1 END", "CASE WHEN k // 8 = 7 THEN 6 ELSE k // 8 + 1 END"
    _left, _right = "CASE WHEN k % 8 = 0 THEN 1 ELSE k % 8 - 1 END", "CASE WHEN k % 8 = 7 THEN 6 ELSE k % 8 + 1 END"
    _lap = " + ".join((_at.format(_up, "k % 8"), _at.format(_down, "k % 8"), _at.format("k // 8", _left), _at.format("k // 8", _right))) + " - 4 * g[k + 1]"

    @c.query("pixel_sharpness", f"WITH p AS (SELECT vec_id, {_GREY} AS g FROM embeddings), l AS (SELECT vec_id, list_transform(range(64), lambda k: {_lap}) AS x FROM p) SELECT vec_id, floor(round(list_var_pop(x), 2) + 1e-6)::BIGINT AS sharpness, floor(round(list_stddev_pop(x), 2) * 10 + 1e-6)::BIGINT AS noise FROM l")
    def sharpness(spark, d):
        s = pictures(spark, d).select("vec_id", pixel_statistics("picture").alias("s"))
        return s.select("vec_id", F.floor(F.col("s.sharpness") + 1e-6).alias("sharpness"), F.floor(F.col("s.noise") * 10 + 1e-6).alias("noise"))

    @c.query("average_hashes", f"WITH p AS (SELECT vec_id, {_GREY} AS g FROM embeddings), b AS (SELECT vec_id, list_transform(g, lambda x: (x > list_avg(g))::INT) AS b FROM p) SELECT vec_id, list_aggregate(list_transform(range(16), lambda i: printf('%x', 8 * b[4 * i + 1] + 4 * b[4 * i + 2] + 2 * b[4 * i + 3] + b[4 * i + 4])), 'string_agg', '') AS average FROM b")
    def average(spark, d):
        return pictures(spark, d).select("vec_id", perceptual_hashes("picture").alias("h")).select("vec_id", "h.average")

    @c.query("pixel_statistics")
    def statistics(spark, d):
        return pictures(spark, d).select("vec_id", pixel_statistics("picture").alias("s")).select("vec_id", "s.*")

    @c.query("perceptual_hashes")
    def hashes(spark, d):
        return pictures(spark, d).select("vec_id", perceptual_hashes("picture").alias("h")).select("vec_id", "h.*")

    @c.query("dominant_colors")
    def colors(spark, d):
        rgb = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.transform(F.slice("embedding", k * 3 + 1, 3), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), x.cast("double") * 200 + 128))))
        return table(spark, d, "embeddings").select("vec_id", F.posexplode(dominant_colors()(rgb)).alias("place", "color")).select("vec_id", "place", F.array_join(F.transform("color.rgb", lambda v: v.cast("string")), ",").alias("rgb"), "color.percentage")

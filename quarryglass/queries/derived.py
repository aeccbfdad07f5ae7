"""Queries on derived columns: levels, tags, captions, names, formats."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryglass.catalog import Catalog
from quarryglass.functions import quality as Q
from quarryglass.functions import tags as G
from quarryglass.functions import texts as X
from quarryglass.functions import vectors as V
from quarryglass.functions import vocabulary as W
from quarryglass.operators.layout import conversion_plan, destinations, space_change
from quarryglass.operators.naming import rename_plan
from quarryglass.queries.common import ASSET, IMG, analyses, assets, images
from quarryglass.sources.tables import table


def _sql_in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _sql_group(x: str, groups: dict, itself: bool = False) -> str:
    whens = " ".join(f"WHEN {x} IN {_sql_in([*m, *([g] if itself else [])])} THEN '{g}'" for g, m in groups.items())
    return f"CASE {whens} END"


def _sql_any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


def _sql_list(names) -> str:
    return _sql_in(names).replace("(", "[").replace(")", "]")


# the tables hold neither colour names nor faces: names stand for the warmth of a picture, and faces for its persons
COLOR_NAMES = {"warm": ("orange", "red"), "cool": ("gray", "blue", "cyan"), "neutral": ("white",)}
COLORS_SQL = "CASE color_temperature " + " ".join(f"WHEN '{k}' THEN {_sql_list(v)}" for k, v in COLOR_NAMES.items()) + " ELSE [] END"
FACES_SQL = "coalesce(object_counts['face'], object_counts['person'], 0)"


def color_names() -> Column:
    out = F.array().cast("array<string>")
    for k, v in COLOR_NAMES.items():
        out = F.when(F.col("color_temperature") == k, F.array(*map(F.lit, v))).otherwise(out)
    return out


def faces() -> Column:
    return F.coalesce(F.try_element_at("object_counts", F.lit("face")), F.try_element_at("object_counts", F.lit("person")), F.lit(0))


_LIST = "list_filter([{0}], lambda x: x IS NOT NULL)"
_SCENE = "lower(coalesce(primary_scene, ''))"
_KNOWN = f"({_SCENE} <> '' AND {_SCENE} <> 'unknown')"
_LABELS = "list_transform(objects, lambda o: struct_extract(o, 'object'))"
_UNIQUE = f"list_transform(list_filter(list_transform({_LABELS}, lambda o, i: {{'o': o, 'f': list_position({_LABELS}, o), 'i': i}}), lambda r: r.f = r.i), lambda r: r.o)"
_FIRST = _LIST.format(f"CASE WHEN {_KNOWN} THEN {_SCENE} END, CASE WHEN {_KNOWN} AND {_sql_group(_SCENE, W.SCENE_PARENTS, True)} IS DISTINCT FROM {_SCENE} THEN {_sql_group(_SCENE, W.SCENE_PARENTS, True)} END")
_QUALITY = "coalesce(quality_score, 0)"
_SHARP = "lower(coalesce(sharpness_level, ''))"
_LAT = "CASE WHEN contains(coalesce(gps_coordinates, ''), ',') THEN coalesce(try_cast(string_split(gps_coordinates, ',')[1] AS DOUBLE), 0) ELSE 0 END"
TAG_SQL = {
    "scene": f"list_slice(list_concat({_FIRST}, list_filter(coalesce(list_transform(list_filter(map_entries(scene_scores), lambda e: e.value > 0.3), lambda e: lower(e.key)), []), lambda s: NOT list_contains({_FIRST}, s))), 1, 5)",
    "objects": f"list_slice(flatten(list_transform(list_slice(coalesce({_UNIQUE}, []), 1, 10), lambda o: {_LIST.format('lower(o), ' + repr('has_') + ' || ' + _sql_group('lower(o)', W.OBJECT_GROUPS))})), 1, 10)",
    "quality": _LIST.format(
        f"CASE WHEN {_QUALITY} >= 90 THEN 'excellent_quality' WHEN {_QUALITY} >= 75 THEN 'good_quality' WHEN {_QUALITY} >= 60 THEN 'fair_quality' ELSE 'poor_quality' END, "
        f"CASE WHEN contains({_SHARP}, 'very_sharp') OR {_SHARP} = 'sharp' THEN 'sharp' WHEN contains({_SHARP}, 'very_blurry') THEN 'very_blurry' WHEN contains({_SHARP}, 'blurry') THEN 'blurry' END, "
        "CASE WHEN coalesce(sharpness_score, 0) > 500 THEN 'crisp' WHEN coalesce(sharpness_score, 0) < 100 THEN 'soft_focus' END"
    ),
    "color": "list_slice(list_concat(flatten(list_transform(list_slice({n}, 1, 3), lambda x: {each})), {rest}), 1, 6)".replace("{n}", COLORS_SQL).replace("{each}", _LIST.format("x, " + _sql_group("x", W.COLOR_TONES) + " || '_tones'")).replace("{rest}", _LIST.format("CASE WHEN coalesce(brightness, 0) > 180 THEN 'bright' WHEN coalesce(brightness, 0) < 80 THEN 'dark' END, CASE WHEN coalesce(contrast, 0) > 60 THEN 'high_contrast' WHEN coalesce(contrast, 0) < 30 THEN 'low_contrast' END")),
    "temporal": _LIST.format(
        "'year_' || year(taken), CASE WHEN month(taken) IN (12, 1, 2) THEN 'winter' WHEN month(taken) IN (3, 4, 5) THEN 'spring' WHEN month(taken) IN (6, 7, 8) THEN 'summer' WHEN taken IS NOT NULL THEN 'fall' END, "
        "CASE WHEN hour(taken) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(taken) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(taken) BETWEEN 17 AND 20 THEN 'evening' WHEN taken IS NOT NULL THEN 'night' END, CASE WHEN isodow(taken) >= 6 THEN 'weekend' END"
    ),
    "technical": _LIST.format(
        "CASE WHEN exposure_time <> 0 AND exposure_time < 1 / 500 THEN 'fast_shutter' WHEN exposure_time > 1 THEN 'long_exposure' END, CASE WHEN iso_speed_ratings <> 0 AND iso_speed_ratings <= 400 THEN 'low_iso' WHEN iso_speed_ratings >= 3200 THEN 'high_iso' END, "
        "CASE WHEN f_number <> 0 AND f_number <= 2.8 THEN 'wide_aperture' WHEN f_number >= 11 THEN 'narrow_aperture' END, CASE WHEN flash % 2 = 1 THEN 'flash_used' END, CASE "
        + " ".join(f"WHEN contains(lower(coalesce(model, make, '')), '{b}') THEN '{b}'" for b in W.BRANDS) + " END"
    ),
    "format": _LIST.format(
        "CASE WHEN width > 0 AND height > 0 THEN CASE WHEN width::DOUBLE * height / 1e6 >= 20 THEN 'high_resolution' WHEN width::DOUBLE * height / 1e6 >= 8 THEN 'medium_resolution' ELSE 'low_resolution' END END, "
        "CASE WHEN width > 0 AND height > 0 THEN CASE WHEN width / height BETWEEN 0.9 AND 1.1 THEN 'square' WHEN width / height > 1.7 THEN 'panoramic' WHEN width / height > 1.3 THEN 'landscape' WHEN width / height < 0.8 THEN 'portrait' END END, "
        "CASE WHEN width > 0 AND height > 0 AND (width >= 3840 OR height >= 2160) THEN '4k_plus' END, CASE WHEN orientation IN (6, 8) THEN 'rotated' END"
    ),
    "people": _LIST.format("CASE {n} WHEN 0 THEN 'no_people' WHEN 1 THEN 'single_person' WHEN 2 THEN 'couple' ELSE CASE WHEN {n} <= 5 THEN 'small_group' ELSE 'crowd' END END, CASE WHEN " + FACES_SQL + " > 0 THEN 'has_faces' END").replace("{n}", f"coalesce(object_counts['person'], len(list_filter(coalesce({_UNIQUE}, []), lambda o: o = 'person')))"),
    "location": _LIST.format(
        f"CASE WHEN coalesce(gps_coordinates, '') <> '' THEN 'geotagged' END, CASE WHEN {_LAT} > 0 THEN 'northern_hemisphere' WHEN {_LAT} < 0 THEN 'southern_hemisphere' END, "
        f"CASE WHEN {_SCENE} IN {_sql_in(['indoor', *W.SCENE_PARENTS['indoor']])} THEN 'indoor' WHEN {_SCENE} IN {_sql_in(['outdoor', *W.SCENE_PARENTS['outdoor']])} THEN 'outdoor' END, CASE WHEN {_sql_any(_SCENE, W.URBAN)} THEN 'urban' END"
    ),
    "mood": _LIST.format(f"CASE WHEN coalesce(brightness, 128) > 150 AND list_has_any({COLORS_SQL}, {_sql_list(W.CHEERFUL)}) THEN 'cheerful' END, CASE WHEN coalesce(brightness, 128) < 100 AND list_has_any({COLORS_SQL}, {_sql_list(W.MOODY)}) THEN 'moody' END, CASE WHEN {_sql_any(_SCENE, W.ROMANTIC)} THEN 'romantic' END, CASE WHEN {_sql_any(_SCENE, W.PEACEFUL)} THEN 'peaceful' END, CASE WHEN {_sql_any(_SCENE, W.ENERGETIC)} THEN 'energetic' END"),
}


def tag_columns() -> dict:
    """The ten categories over the wide record."""
    col = F.col
    labels = V.distinct_labels(col("objects"))
    return {
        "scene": G.scene_tags(col("primary_scene"), col("scene_scores")),
        "objects": G.object_tags(labels),
        "quality": G.quality_tags(col("quality_score"), col("sharpness_level"), col("sharpness_score")),
        "color": G.color_tags(color_names(), col("brightness"), col("contrast")),
        "temporal": G.temporal_tags(col("datetime_taken")),
        "technical": G.technical_tags(col("exposure_time"), col("iso_speed_ratings"), col("f_number"), col("flash") % 2 == 1, F.coalesce("model", "make")),
        "format": G.format_tags(col("width"), col("height"), col("orientation")),
        "people": G.people_tags(col("object_counts"), labels, faces()),
        "location": G.location_tags(col("gps_coordinates"), col("primary_scene")),
        "mood": G.mood_tags(col("brightness"), color_names(), col("primary_scene")),
    }


_CATS = f"{ASSET}, cats AS (SELECT file_id, quality_score, " + ", ".join(f"{s} AS t_{n}" for n, s in TAG_SQL.items()) + " FROM asset)"
_TOTAL = " + ".join(f"len(t_{n})" for n in W.CATEGORIES)


def _cut(order) -> str:
    out, used = [], "0"
    for n in order:
        out.append(f"list_slice(t_{n}, 1, greatest(0, {W.MAX_TAGS} - ({used})))")
        used += f" + len(t_{n})"
    return "flatten([" + ", ".join(out) + "])"


def _distinct(x: str) -> str:
    return f"list_transform(list_filter(list_transform({x}, lambda v, i: {{'v': v, 'f': list_position({x}, v), 'i': i}}), lambda r: r.f = r.i), lambda r: r.v)"


FLAT_SQL = f"{_CATS}, joined AS (SELECT *, CASE WHEN {_TOTAL} > {W.MAX_TAGS} THEN {_cut(W.PRIORITY)} ELSE flatten([{', '.join('t_' + n for n in W.CATEGORIES)}]) END AS every FROM cats), flat AS (SELECT file_id, quality_score, {_distinct('every')} AS tags FROM joined)"


def flat(spark, d):
    by = {n: F.col(f"t_{n}") for n in W.CATEGORIES}
    return categorised(spark, d).select("file_id", "quality_score", G.flat_tags(by).alias("tags"))


def categorised(spark, d):
    """The categories as columns, so that each is computed once."""
    return assets(spark, d).select("file_id", "quality_score", *(x.alias(f"t_{n}") for n, x in tag_columns().items()))


def register(c: Catalog) -> None:
    levels = lambda x, steps, last: "CASE " + f"WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} < {b} THEN '{n}'" for b, n in steps) + f" ELSE '{last}' END"

    @c.query("quality_levels", f"""WITH {ASSET} SELECT file_id, {levels('sharpness_score', W.SHARPNESS, 'very_sharp')} AS sharpness, {levels('brightness', W.EXPOSURE, 'overexposed')} AS exposure,
        CASE WHEN warmth_score > 0.1 THEN 'warm' WHEN warmth_score < -0.1 THEN 'cool' WHEN warmth_score IS NOT NULL THEN 'neutral' END AS temperature, CASE WHEN quality_score >= 90 THEN 'high' WHEN quality_score >= 70 THEN 'good' WHEN quality_score IS NOT NULL THEN 'low' END AS tier FROM asset""")
    def quality_levels(spark, d):
        a = assets(spark, d)
        return a.select("file_id", Q.sharpness_level(F.col("sharpness_score")).alias("sharpness"), Q.exposure_level(F.col("brightness")).alias("exposure"), Q.color_temperature(F.col("warmth_score")).alias("temperature"), Q.quality_tier(F.col("quality_score")).alias("tier"))

    @c.query("quality_score", f"""WITH {ASSET} SELECT file_id, floor(100 * greatest(0.0, least(100.0, 0.3 * greatest(0.0, 100.0 - 2.0 * noise_level) + 0.2 * least(100.0, least(255.0, 4 * contrast) / 255.0 * 100.0)
        + 0.3 * (100.0 - abs(127.5 - brightness) / 1.275) + 0.2 * least(100.0, contrast / 70.0 * 100.0))) + 1e-6)::BIGINT AS score FROM asset WHERE noise_level IS NOT NULL AND brightness IS NOT NULL AND contrast IS NOT NULL""")
    def score(spark, d):
        # the tables hold no range of grey values: four deviations stand for it
        s = Q.quality_score(F.col("noise_level"), F.least(F.lit(255.0), 4 * F.col("contrast")), F.col("brightness"), F.col("contrast"))
        return assets(spark, d).select("file_id", F.floor(100 * s + 1e-6).alias("score")).where("score IS NOT NULL")

    for name, sql in TAG_SQL.items():
        @c.query(f"tags_{name}", f"WITH {ASSET} SELECT file_id, array_to_string({sql}, ',') AS tags FROM asset")
        def category(spark, d, name=name):
            return assets(spark, d).select("file_id", F.array_join(tag_columns()[name], ",").alias("tags"))

    @c.query("tags_flat", f"WITH {FLAT_SQL} SELECT file_id, array_to_string(tags, ',') AS tags FROM flat")
    def flat_joined(spark, d):
        return flat(spark, d).select("file_id", F.array_join("tags", ",").alias("tags"))

    @c.query("tags_budget", f"WITH {_CATS} SELECT file_id, ({_TOTAL})::INT AS before, least({W.MAX_TAGS}, {_TOTAL})::INT AS kept FROM cats")
    def budget(spark, d):
        cats = {n: F.col(f"t_{n}") for n in W.CATEGORIES}
        before = sum((F.size(x) for x in cats.values()), F.lit(0))
        kept = sum((F.size(x) for x in G.within_budget(cats).values()), F.lit(0))
        return categorised(spark, d).select("file_id", before.cast("int").alias("before"), kept.cast("int").alias("kept"))

    @c.query("detections_filter", f"WITH {ASSET} SELECT file_id, len(list_filter(objects, lambda o: struct_extract(o, 'confidence') >= 0.8))::INT AS kept, array_to_string({_UNIQUE}, ',') AS labels FROM asset WHERE objects IS NOT NULL")
    def detections(spark, d):
        a = analyses(spark, d).where("objects IS NOT NULL")
        return a.select("file_id", F.size(V.kept_detections(F.col("objects"), 0.8)).alias("kept"), F.array_join(V.distinct_labels(F.col("objects")), ",").alias("labels"))

    @c.query("label_counts", "WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id) AS rn FROM ml_analysis) WHERE rn = 1), o AS (SELECT file_id, struct_extract(unnest(objects), 'object') AS label FROM m) SELECT file_id, label, count(*)::INT AS n FROM o GROUP BY ALL")
    def counts(spark, d):
        return analyses(spark, d).where("objects IS NOT NULL").select("file_id", F.explode(V.label_counts(F.col("objects"))).alias("label", "n"))

    @c.query("quick_tags", f"WITH {ASSET} SELECT file_id, array_to_string(list_filter(list_concat([primary_scene], list_slice(coalesce({_UNIQUE}, []), 1, 5)), lambda x: x IS NOT NULL), ', ') AS tag_string FROM asset WHERE objects IS NOT NULL")
    def quick(spark, d):
        return analyses(spark, d).where("objects IS NOT NULL").select("file_id", F.array_join(V.quick_tags(F.col("primary_scene"), V.distinct_labels(F.col("objects"))), ", ").alias("tag_string"))

    @c.query("scene_argmax", f"SELECT vec_id, ({_sql_in(W.SCENE_LABELS).replace('(', '[').replace(')', ']')})[list_position(embedding[1:20], list_max(embedding[1:20]))] AS scene FROM embeddings")
    def scenes(spark, d):
        logits = F.slice("embedding", 1, len(W.SCENE_LABELS))
        return table(spark, d, "embeddings").select("vec_id", V.argmax_label(logits, W.SCENE_LABELS).alias("scene"))

    @c.query("scene_confidence", "SELECT vec_id, round(1 / list_sum(list_transform(embedding[1:20], lambda x: exp(x::DOUBLE - list_max(embedding[1:20])::DOUBLE))), 6) AS confidence FROM embeddings")
    def confidence(spark, d):
        return table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(V.softmax(F.slice("embedding", 1, 20))), 6).alias("confidence"))

    _few = f"list_slice(list_filter(coalesce({_UNIQUE}, []), lambda o: o IS NOT NULL), 1, 5)"

    @c.query("caption", f"""WITH {ASSET}, s AS (SELECT file_id, concat_ws('. ', nullif(primary_scene, ''), CASE WHEN len({_few}) > 0 THEN 'containing ' || array_to_string({_few}, ', ') END, CASE WHEN quality_score >= 80 THEN 'high quality' WHEN quality_score >= 60 THEN 'good quality' END,
        'taken on ' || strftime(taken, '%Y-%m-%d'), 'at ' || gps_coordinates) AS s FROM asset) SELECT file_id, CASE WHEN s = '' THEN 'Photo' ELSE upper(s[1:1]) || lower(s[2:]) END AS caption FROM s""")
    def caption(spark, d):
        return assets(spark, d).select("file_id", X.caption(F.col("primary_scene"), V.distinct_labels(F.col("objects")), F.col("quality_score"), F.col("datetime_taken"), F.col("gps_coordinates")).alias("caption"))

    _plain = "regexp_replace({0}::DECIMAL(38, 12)::VARCHAR, '(\\.\\d+?)0+$', '\\1')"

    @c.query("camera_info", f"WITH {ASSET} SELECT file_id, concat_ws(', ', 'f/' || {_plain.format('f_number')}, {_plain.format('exposure_time')} || 's', 'ISO ' || iso_speed_ratings, {_plain.format('focal_length')} || 'mm') AS info FROM asset")
    def camera(spark, d):
        return assets(spark, d).select("file_id", X.camera_info(F.col("f_number"), F.col("exposure_time"), F.col("iso_speed_ratings"), F.col("focal_length")).alias("info"))

    @c.query("description", f"WITH {ASSET} SELECT file_id, concat_ws(', ', 'Quality: ' || floor(quality_score)::BIGINT || '/100', 'Sharpness: ' || sharpness_level) AS description FROM asset")
    def description(spark, d):
        return assets(spark, d).select("file_id", X.description(F.floor("quality_score"), F.col("sharpness_level")).alias("description"))

    @c.query("gps_decimal", "SELECT file_id, max(round(CASE WHEN latitude < 0 THEN -1 ELSE 1 END * (floor(abs(latitude)) + floor((abs(latitude) - floor(abs(latitude))) * 60) / 60.0 + round(((abs(latitude) - floor(abs(latitude))) * 60 - floor((abs(latitude) - floor(abs(latitude))) * 60)) * 60, 2) / 3600.0), 7)) AS lat FROM image_metadata WHERE latitude IS NOT NULL GROUP BY file_id")
    def gps(spark, d):
        a = F.abs("latitude")
        minutes = (a - F.floor(a)) * 60
        lat = X.decimal_degrees(F.floor(a), F.floor(minutes), F.round((minutes - F.floor(minutes)) * 60, 2), F.when(F.col("latitude") < 0, "S").otherwise("N"))
        return table(spark, d, "image_metadata", "file_id", "latitude").where("latitude IS NOT NULL").groupBy("file_id").agg(F.max(F.round(lat, 7)).alias("lat"))

    @c.query("snake_case", "SELECT DISTINCT p_name AS name, lower(regexp_replace(regexp_replace(replace(p_name, ' ', '') || 'IDValue', '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake FROM part")
    def snake(spark, d):
        return table(spark, d, "part").select(F.col("p_name").alias("name"), X.snake_case(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("IDValue"))).alias("snake")).distinct()

    _san = "regexp_replace(regexp_replace(replace(translate({0}, '<>:\"/\\|?*', ''), ' ', '_'), '_{{2,}}', '_', 'g'), '^_+|_+$', '', 'g')"

    @c.query("sanitize_names", f"WITH {IMG} SELECT file_id, {_san.format('file_path')} AS clean FROM img")
    def sanitize(spark, d):
        return images(spark, d).select("file_id", X.sanitized(F.col("file_path")).alias("clean"))

    @c.query("rename_plan", f"""WITH {ASSET}, w AS (SELECT file_path AS path, coalesce(strftime(taken, '%Y'), '{{year}}') || '-' || coalesce(strftime(taken, '%m'), '{{month}}') || '_' || coalesce(replace(model, ' ', '-'), '{{camera}}') || lower(regexp_extract(file_path, '[^/\\\\](\\.[^./\\\\]+)$', 1)) AS w FROM asset WHERE file_path IS NOT NULL),
        s AS (SELECT path, {_san.format('w')} AS w FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY path) - 1 AS seq FROM s), e AS (SELECT *, regexp_extract(w, '\\.[^.]*$') AS x FROM r)
        SELECT path, CASE WHEN seq = 0 THEN w ELSE w[1:len(w) - len(x)] || '_' || lpad(seq::VARCHAR, greatest(3, len(seq::VARCHAR))::INT, '0') || x END AS new_name, seq::INT AS seq FROM e""")
    def rename(spark, d):
        a = assets(spark, d).where("file_path IS NOT NULL")
        wanted = X.patterned_name("{year}-{month}_{camera}", F.col("datetime_taken"), F.col("model"), F.col("tags"), F.col("file_path"))
        return rename_plan(a.select(F.col("file_path").alias("path"), wanted.alias("wanted")))

    @c.query("filename_validate", """WITH n AS (SELECT event_id, 'img_' || CASE WHEN event_id % 5 = 0 THEN '20240230_120000' ELSE strftime(ts, '%Y%m%d_%H%M%S') END || '_' || substr(md5(event_id::VARCHAR), 1, 8) || '.' || CASE WHEN event_id % 7 = 0 THEN 'exe' ELSE 'PNG' END AS name FROM events)
        SELECT event_id, name, event_id % 5 <> 0 AND event_id % 7 <> 0 AS valid FROM n""")
    def validate(spark, d):
        e = table(spark, d, "events")
        stamp = F.when(F.col("event_id") % 5 == 0, "20240230_120000").otherwise(F.date_format("ts", "yyyyMMdd_HHmmss"))
        name = F.concat(F.lit("img_"), stamp, F.lit("_"), F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), F.when(F.col("event_id") % 7 == 0, ".exe").otherwise(".PNG"))
        return e.select("event_id", name.alias("name")).withColumn("valid", X.valid_name(F.col("name")))

    @c.query("filename_generate", "SELECT event_id, 'img_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || substr(md5(event_id::VARCHAR), 1, 8) || '.png' AS name FROM events")
    def generate(spark, d):
        return table(spark, d, "events").select("event_id", X.generated_name(F.col("ts"), F.col("event_id"), F.lit("PNG")).alias("name"))

    _target = "CASE WHEN mode IN ('RGBA', 'LA', 'PA') THEN 'png' WHEN width < 1000 AND height < 1000 AND mode IN ('P', 'L') THEN 'png' ELSE 'jpg' END"
    _ext = "lower(regexp_extract(file_path, '[^/\\\\]\\.([^./\\\\]+)$', 1))"
    _plan = f"{IMG}, p AS (SELECT file_path AS path, file_size, {_ext} AS ext, {_target} AS target FROM img)"

    @c.query("format_plan", f"WITH {_plan} SELECT path, ext, target, CASE WHEN ext = target THEN 'keep' ELSE 'convert' END AS action, path[1:len(path) - len(ext)] || target AS output FROM p")
    def formats(spark, d):
        return conversion_plan(images(spark, d).select(F.col("file_path").alias("path"), "mode", "width", "height"))

    @c.query("format_stats", f"WITH {_plan} SELECT ext, count(*) AS files, count(*) FILTER (WHERE ext <> target) AS to_convert FROM p GROUP BY ext")
    def format_stats(spark, d):
        return formats(spark, d).groupBy("ext").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("action") == "convert").alias("to_convert"))

    @c.query("space_impact", f"""WITH {_plan} SELECT sum(file_size)::BIGINT AS now_bytes, round(sum(file_size * CASE WHEN ext IN ('png', 'bmp', 'tiff') AND target = 'jpg' THEN -0.6 WHEN ext IN ('heic', 'heif') AND target = 'jpg' THEN -0.2 WHEN ext IN ('jpg', 'jpeg') AND target = 'png' THEN 0.5 ELSE 0.0 END))::BIGINT AS change_bytes FROM p""")
    def impact(spark, d):
        i = images(spark, d).select(F.col("file_path").alias("path"), "file_size").join(formats(spark, d), "path")
        return i.agg(F.sum("file_size").alias("now_bytes"), F.round(F.sum(space_change(F.col("ext"), F.col("target"), F.col("file_size")).cast("decimal(20,1)"))).cast("bigint").alias("change_bytes"))

    @c.query("copy_destinations", f"""WITH {IMG}, p AS (SELECT file_path AS path, regexp_extract(file_path, '[^/]*$') AS n FROM img), k AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY path) - 1 AS k, regexp_extract(n, '.(\\.[^.]*)$', 1) AS e FROM p)
        SELECT path, '/archive/' || CASE WHEN k = 0 THEN n ELSE n[1:len(n) - len(e)] || '_' || lpad(k::VARCHAR, greatest(3, len(k::VARCHAR))::INT, '0') || e END AS destination FROM k""")
    def destination(spark, d):
        return destinations(images(spark, d).select(F.col("file_path").alias("path")), "/archive", "/library")

    @c.query("answer_objects", "SELECT DISTINCT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ', ' || p_brand || ',,BOX ' || p_type, ','), lambda x: lower(trim(x))), lambda x: x <> ''), '+') AS objects, 'box ' || lower(p_type) AS product FROM part")
    def answers(spark, d):
        o = X.named_objects(F.concat(F.col("p_name"), F.lit(", "), F.col("p_brand"), F.lit(",,BOX "), F.col("p_type")))
        return table(spark, d, "part").select("p_partkey", F.array_join(o, "+").alias("objects"), F.get(X.product_names(o), F.lit(0)).alias("product"))

    _words = "list_filter(list_transform(string_split_regex(lower(p_name || ', ' || p_type || '! The ' || p_brand || ' (' || p_name || ').'), '[\\s,]+'), lambda w: regexp_replace(w, '^[.,;:!?]+|[.,;:!?]+$', '', 'g')), lambda w: len(w) > 2 AND regexp_full_match(w, '\\p{L}+'))"

    @c.query("answer_tags", f"SELECT DISTINCT p_partkey, array_to_string(list_slice({_distinct(_words)}, 1, 5), ',') AS tags FROM part")
    def answer_tags(spark, d):
        text = F.concat(F.col("p_name"), F.lit(", "), F.col("p_type"), F.lit("! The "), F.col("p_brand"), F.lit(" ("), F.col("p_name"), F.lit(")."))
        return table(spark, d, "part").select("p_partkey", F.array_join(X.searchable_tags(text), ",").alias("tags"))

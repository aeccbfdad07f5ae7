"""The eight kinds of records: their fields, and reading and writing them as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The fields of each kind with their types, in order.
IMAGE_METADATA = "file_name string, file_path string, file_size bigint, width int, height int, format string, mode string, megapixels double, datetime_original timestamp, datetime_modified timestamp, latitude double, longitude double, altitude double, gps_coordinates string, make string, model string, lens_model string, f_number double, exposure_time double, iso_speed_ratings int, focal_length double, orientation int, flash int, white_balance int, error string, exif_error string, gps_error string"
CONTENT_ANALYSIS = "phash string, average_hash string, dhash string, whash string, sharpness_score double, is_blurry boolean, sharpness_level string, quality_score double, noise_level double, dynamic_range int, brightness double, contrast double, exposure string, dominant_colors array<struct<rgb:array<int>,percentage:double>>, average_color array<int>, color_temperature string, warmth_score double, error string, hash_error string, blur_error string, quality_error string, color_error string"
ML_ANALYSIS = "primary_scene string, scene_scores map<string,double>, objects array<struct<object:string,confidence:double>>, object_counts map<string,int>, tags array<string>, scene_model string, object_model string, inference_time double, gpu_memory_used double, error string"
RENAME = "original_path string, original_name string, new_path string, new_name string, success boolean, renamed boolean, collision boolean, backup_created boolean, backup_path string, error string, renamed_at timestamp"
TAG_EMBED = "file_path string, tags_embedded array<string>, tag_count int, iptc_keywords boolean, iptc_caption boolean, caption_text string, success boolean, modified boolean, backup_created boolean, backup_path string, tags_verified boolean, verification_error string, error string, embedded_at timestamp"
DUPLICATION = "file_path string, file_hash string, is_duplicate boolean, duplicate_of string, duplicates_found array<string>, duplicate_count int, quality_score double, kept_file string, deleted boolean, kept boolean, requires_confirmation boolean, confirmed boolean, error string, checked_at timestamp"
CONVERSION = "original_path string, original_format string, original_size bigint, converted_path string, converted_format string, converted_size bigint, success boolean, converted boolean, quality_preserved boolean, quality_loss double, original_kept boolean, original_backup_path string, conversion_time double, size_reduction double, error string, converted_at timestamp"


def _nested(ddl: str) -> str:
    """``struct<a:b,...>`` of a list of fields."""
    return "struct<" + ",".join(":".join(part.split(" ", 1)) for part in ddl.split(", ")) + ">"


KINDS = {
    "image_metadata": IMAGE_METADATA,
    "content_analysis": CONTENT_ANALYSIS,
    "ml_analysis": ML_ANALYSIS,
    "image_analysis": f"image_path string, metadata {_nested(IMAGE_METADATA)}, content {_nested(CONTENT_ANALYSIS)}, ml_vision {_nested(ML_ANALYSIS)}, analysis_complete boolean, phases_completed array<string>, errors array<string>",
    "rename": RENAME,
    "tag_embed": TAG_EMBED,
    "duplication": DUPLICATION,
    "conversion": CONVERSION,
}
# What a missing field is, other than null.
DEFAULTS = {
    "analysis_complete": False, "success": False, "renamed": False, "collision": False, "backup_created": False, "iptc_keywords": False, "iptc_caption": False, "modified": False, "tags_verified": False,
    "is_duplicate": False, "deleted": False, "kept": False, "requires_confirmation": True, "confirmed": False, "converted": False, "quality_preserved": False, "original_kept": False, "tag_count": 0, "duplicate_count": 0,
}


def as_records(df: DataFrame, key: str, kind: str) -> DataFrame:
    """``(key, record)``: of each row the fields of the kind as JSON; other columns are dropped, nulls left out."""
    names = [f.split(" ", 1)[0] for f in KINDS[kind].split(", ")]
    return df.select(key, F.to_json(F.struct(*[c for c in names if c in df.columns])).alias("record"))


def from_records(df: DataFrame, key: str, kind: str) -> DataFrame:
    """The fields of the kind from ``record``: unknown ones are dropped, missing ones get their default or null."""
    read = df.select(key, F.from_json("record", KINDS[kind]).alias("r")).select(key, "r.*")
    kinds = dict(read.dtypes)

    def filled(c: str):
        if c in DEFAULTS:
            return F.coalesce(c, F.lit(DEFAULTS[c])).alias(c)
        if kinds[c].startswith(("array", "map")) and c not in ("dominant_colors", "average_color"):
            return F.coalesce(c, F.from_json(F.lit("[]" if kinds[c].startswith("array") else "{}"), kinds[c])).alias(c)
        return F.col(c)

    return read.select(key, *(filled(c) for c in read.columns if c != key))


def with_error(df: DataFrame, phase: str, message: str, errors: str = "errors") -> DataFrame:
    """``phase: message`` appended to the errors of rows whose message isn't null."""
    new = F.concat(F.lit(f"{phase}: "), F.col(message))
    kept = F.coalesce(F.col(errors), F.array().cast("array<string>"))
    return df.withColumn(errors, F.when(F.col(message).isNull(), kept).otherwise(F.array_append(kept, new)))

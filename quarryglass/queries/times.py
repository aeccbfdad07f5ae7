"""Queries on capture times."""

from pyspark.sql import functions as F

from quarryglass.catalog import Catalog
from quarryglass.functions.instants import MONTHS, WEEKDAYS
from quarryglass.operators.capture_time import normalise_times
from quarryglass.sources.tables import table

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　 "
_PLAIN = "".join(map(chr, range(0x21, 0x7F))) + "  "
_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_GAP = "(?: *[Tt] *| +|_)"
_FIELDS = "['y', 'm', 'd', 'h', 'mi', 's', 'f', 'ap', 'off', 'zn']"

#: Every text in the form ``year-month-day time zone``, read by one pattern, then taken to UTC; a local reading counts if
#: no other instant within three hours shows the same one in its zone.
FOUND_SQL = f"""
WITH cams AS (SELECT upper(trim(body_serial_number)) AS serial, CASE WHEN min(trim(clock_zone)) = max(trim(clock_zone)) THEN min(trim(clock_zone)) END AS zone FROM camera_profile WHERE trim(body_serial_number) <> '' GROUP BY 1),
images AS (SELECT i.*, zone FROM image_metadata i LEFT JOIN cams ON upper(regexp_replace(body_serial_number, '^\\s+|\\s+$', '', 'g')) = serial WHERE file_id IS NOT NULL),
texts AS (
  SELECT file_id, scanned_at, 'datetime_original' AS field, datetime_original AS t, offset_time_original AS o, zone FROM images
  UNION ALL SELECT file_id, scanned_at, 'datetime_modified', datetime_modified, offset_time, zone FROM images),
plain AS (SELECT *, regexp_replace(translate(t, '{_WIDE.replace("'", "''")}', '{_PLAIN.replace("'", "''")}'), '^[\\s\\x00\\x{{FEFF}}]+|[\\s\\x00\\x{{FEFF}}]+$', '', 'g') AS x FROM texts),
named AS (SELECT *, CASE
    WHEN regexp_full_match(x, '(?:[A-Za-z]{{3}}, *)?\\d\\d?([ -])[A-Za-z]{{3}}[ -]\\d{{4}},?{_GAP}.*') THEN regexp_extract(x, '^(?:(?P<w>[A-Za-z]{{3}}), *)?(\\d\\d?)[ -]([A-Za-z]{{3}})[ -](\\d{{4}}),?{_GAP}(.*)$', ['w', 'd', 'b', 'y', 'r'])
    WHEN regexp_full_match(x, '[A-Za-z]{{3}} [A-Za-z]{{3}} +\\d\\d? [\\d:]+ (?:[A-Za-z]{{3}} )?\\d{{4}}') THEN regexp_extract(regexp_replace(x, '^(\\w+) (\\w+) +(\\d+) ([\\d:]+) (\\w+ )?(\\d+)$', '\\1|\\3|\\2|\\6|\\4 \\5'), '^([^|]*)[|]([^|]*)[|]([^|]*)[|]([^|]*)[|](.*?) ?$', ['w', 'd', 'b', 'y', 'r']) END AS n FROM plain),
forms AS (SELECT *, CASE
    WHEN n IS NOT NULL THEN CASE WHEN n.w = '' OR list_contains({_LIST(WEEKDAYS)}, lower(n.w)) THEN n.y || '-' || list_position({_LIST(MONTHS)}, lower(n.b)) || '-' || n.d || ' ' || n.r END
    WHEN regexp_full_match(x, '\\d{{8}}[Tt_ ]\\d{{6}}.*') THEN regexp_replace(x, '^(\\d{{4}})(\\d\\d)(\\d\\d).(\\d\\d)(\\d\\d)(\\d\\d)', '\\1-\\2-\\3 \\4:\\5:\\6')
    WHEN regexp_full_match(x, '\\d\\d?/\\d\\d?/\\d{{4}},?{_GAP}.*') THEN regexp_replace(x, '^(\\d+)/(\\d+)/(\\d+),?{_GAP}', '\\3-\\1-\\2 ')
    WHEN regexp_full_match(x, '\\d\\d?[.]\\d\\d?[.]\\d{{4}},?{_GAP}.*') THEN regexp_replace(x, '^(\\d+)[.](\\d+)[.](\\d+),?{_GAP}', '\\3-\\2-\\1 ')
    WHEN regexp_full_match(x, '\\d{{4}}年.*') THEN regexp_replace(x, '^(\\d+)年(\\d+)月(\\d+)日 *', '\\1-\\2-\\3 ')
    ELSE regexp_replace(x, '^(\\d{{4}})[:/.-](\\d\\d?)[:/.-](\\d\\d?){_GAP}', '\\1-\\2-\\3 ') END AS c FROM named),
parts AS (SELECT *, CASE WHEN regexp_full_match(x, '\\d{{1,19}}([.]\\d{{1,9}})?') THEN x END AS bare, CASE WHEN regexp_matches(c, '^\\d{{4}}-\\d\\d?-\\d\\d? ') THEN
    regexp_extract(c, '^(\\d{{4}})-(\\d\\d?)-(\\d\\d?) (\\d\\d?)[:時](\\d\\d)(?:[:分](\\d\\d)秒?|分)?(?:[.,](\\d{{1,9}}))?( ?[AaPp][Mm]\\b)?(?: *([+\\-−]\\d\\d(?::?\\d\\d)?))?(?: *\\[?([A-Za-z][A-Za-z0-9_/+-]*)\\]?)?$', {_FIELDS}) END AS p FROM forms),
clock AS (SELECT *, CASE WHEN p.ap = '' THEN p.h::INT WHEN p.h::INT BETWEEN 1 AND 12 THEN p.h::INT % 12 + CASE WHEN lower(trim(p.ap)) = 'pm' THEN 12 ELSE 0 END END AS hour,
    try_cast(CASE WHEN p.y <> '' THEN lpad(p.y, 4, '0') || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') END AS DATE) AS day FROM parts WHERE bare IS NOT NULL OR p.y <> ''),
local AS (SELECT *, CASE WHEN hour < 24 AND p.mi::INT < 60 AND coalesce(nullif(p.s, ''), '0')::INT < 60 AND day >= DATE '0001-01-01' THEN
    epoch_us(day::TIMESTAMP) + ((hour::BIGINT * 60 + p.mi::INT) * 60 + coalesce(nullif(p.s, ''), '0')::INT) * 1000000 + substr(rpad(p.f, 6, '0'), 1, 6)::BIGINT END AS us,
    CASE WHEN p.off <> '' THEN p.off WHEN p.zn <> '' THEN NULL ELSE regexp_extract(o, '^\\s*([+\\-−]\\d\\d(?::?[0-5]\\d)?|[zZ])\\s*$', 1) END AS east FROM clock),
zoned AS (SELECT l.*, CASE WHEN east ~ '^[zZ]$' THEN 0 WHEN east <> '' THEN (CASE WHEN east[1] = '+' THEN 1 ELSE -1 END) * (east[2:3]::BIGINT * 60 + CASE WHEN len(east) > 3 THEN east[-2:]::BIGINT ELSE 0 END) * 60000000 END AS shift,
    CASE WHEN coalesce(p.off, '') = '' THEN z.name END AS zname FROM local l LEFT JOIN pg_timezone_names() z ON lower(z.name) = lower(CASE WHEN lower(p.zn) = 'z' THEN 'utc' WHEN p.zn <> '' THEN p.zn ELSE l.zone END)),
found AS (SELECT *, CASE
    WHEN bare IS NOT NULL THEN CASE
      WHEN len(regexp_extract(bare, '^\\d+')) <= 11 THEN regexp_extract(bare, '^\\d+')::BIGINT * 1000000 + substr(rpad(regexp_extract(bare, '[.](\\d+)$', 1), 6, '0'), 1, 6)::BIGINT
      WHEN contains(bare, '.') THEN NULL WHEN len(bare) <= 14 THEN bare::BIGINT * 1000 WHEN len(bare) <= 17 THEN bare::BIGINT ELSE bare::BIGINT // 1000 END
    WHEN us IS NULL THEN NULL
    WHEN shift IS NOT NULL THEN CASE WHEN abs(shift) <= 64800000000 THEN us - shift END
    WHEN zname IS NOT NULL THEN CASE WHEN timezone(zname, timezone(zname, make_timestamp(us))) = make_timestamp(us)
      AND len(list_filter(range(-12, 13), lambda k: k <> 0 AND timezone(zname, timezone(zname, make_timestamp(us)) + to_microseconds(k * 900000000)) = make_timestamp(us))) = 0 THEN epoch_us(timezone(zname, make_timestamp(us))) END END AS utc_us FROM zoned),
ranked AS (SELECT t.file_id, t.field, f.utc_us, row_number() OVER (PARTITION BY t.file_id, t.field ORDER BY t.scanned_at DESC NULLS LAST, f.utc_us DESC NULLS LAST) AS r
  FROM texts t LEFT JOIN found f ON f.file_id = t.file_id AND f.field = t.field AND f.scanned_at IS NOT DISTINCT FROM t.scanned_at AND f.t IS NOT DISTINCT FROM t.t AND f.o IS NOT DISTINCT FROM t.o)"""


def register(c: Catalog) -> None:
    @c.query("p5_found", FOUND_SQL + "\nSELECT file_id, field, utc_us FROM ranked WHERE r = 1 AND utc_us IS NOT NULL")
    def found(spark, d):
        return normalise_times(table(spark, d, "image_metadata"), table(spark, d, "camera_profile"))

    @c.query("p5_by_year", FOUND_SQL + "\nSELECT field, year(make_timestamp(utc_us)) AS year, count(*) AS files, min(utc_us) AS first_us, max(utc_us) AS last_us FROM ranked WHERE r = 1 AND utc_us IS NOT NULL GROUP BY ALL")
    def by_year(spark, d):
        year = F.year(F.timestamp_micros("utc_us")).alias("year")
        return found(spark, d).groupBy("field", year).agg(F.count(F.lit(1)).alias("files"), F.min("utc_us").alias("first_us"), F.max("utc_us").alias("last_us"))

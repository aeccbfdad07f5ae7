"""Queries on exact and near duplicates."""

from pyspark.sql import functions as F

from quarryglass.catalog import Catalog
from quarryglass.functions.keys import hamming, hash64
from quarryglass.functions.texts import fingerprint, quick_hash
from quarryglass.functions.vectors import cosine_distance
from quarryglass.operators.components import connected_components
from quarryglass.operators.dedup import duplicate_sets, quick_candidates, report_totals, survivors_by
from quarryglass.operators.similar import cosine_clusters, cosine_pairs, hamming_value_pairs, similar_groups
from quarryglass.plans.cut import Scratch
from quarryglass.queries.common import CON, FILES, contents, hashed_files
from quarryglass.sources.tables import table

_HASHED = f"{CON}, looks AS (SELECT file_id, ('0x' || x)::UBIGINT AS bits FROM (SELECT file_id, regexp_replace(regexp_replace(lower(phash), '^\\s*((md5:|sha256:|0x)\\s*)?', ''), '\\s+$', '') AS x FROM con) WHERE regexp_full_match(x, '[0-9a-f]{{16}}'))"
_TEXTS = "texts AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS digest, octet_length(encode(text)) AS size, created_at AS mtime FROM documents)"


def _looks(spark, d):
    return contents(spark, d).select("file_id", hash64(F.col("phash")).alias("bits")).where("bits IS NOT NULL")


def _texts(spark, d):
    t = table(spark, d, "documents", "doc_id", "text", "created_at")
    return t.select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("size"), F.col("created_at").alias("mtime"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))


def register(c: Catalog) -> None:
    @c.query("dedup_exact", f"WITH {FILES} SELECT digest, count(*) AS files, min(path) AS first_path FROM files WHERE digest IS NOT NULL GROUP BY digest HAVING count(*) > 1")
    def exact(spark, d):
        return duplicate_sets(hashed_files(spark, d), "digest")

    @c.query("dedup_texts", f"WITH {_TEXTS} SELECT digest, count(*) AS files, min(path) AS first_path FROM texts WHERE digest IS NOT NULL GROUP BY digest HAVING count(*) > 1")
    def texts(spark, d):
        return duplicate_sets(_texts(spark, d), "digest")

    orders = {
        "oldest": "mtime ASC NULLS LAST",
        "newest": "mtime DESC NULLS LAST",
        "largest": "size DESC NULLS LAST",
        "highest_quality": "coalesce(width, 0)::DOUBLE * coalesce(height, 0) + coalesce(size, 0) / 1000 DESC",
        "first": "path",
    }
    for how, order in orders.items():
        sql = f"""WITH {FILES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY {order}, path) AS r, count(*) OVER (PARTITION BY digest) AS n FROM files WHERE digest IS NOT NULL)
        SELECT digest, max(CASE WHEN r = 1 THEN path END) AS kept_path, count(*) AS files, sum(CASE WHEN r > 1 THEN coalesce(size, 0) ELSE 0 END)::BIGINT AS freed FROM ranked WHERE n > 1 GROUP BY digest"""

        @c.query(f"dedup_survivors_{how}", sql)
        def kept(spark, d, how=how):
            return survivors_by(hashed_files(spark, d), "digest", how)

    @c.query("dedup_report_totals", f"""WITH {FILES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY path) AS r, count(*) OVER (PARTITION BY digest) AS n FROM files WHERE digest IS NOT NULL)
        SELECT count(DISTINCT digest) AS sets, count(*) FILTER (WHERE r > 1) AS redundant, coalesce(sum(size) FILTER (WHERE r > 1), 0)::BIGINT AS wasted FROM ranked WHERE n > 1""")
    def totals(spark, d):
        return report_totals(hashed_files(spark, d), "digest")

    _QUICK = "q AS (SELECT doc_id, text, CASE WHEN octet_length(encode(text)) <= 256 THEN md5(octet_length(encode(text)) || text) END AS quick FROM documents WHERE text IS NOT NULL AND octet_length(encode(text)) <= 256)"

    @c.query("dedup_two_phase", f"WITH {_TEXTS} SELECT digest, count(*) AS files, min(path) AS first_path FROM texts WHERE digest IS NOT NULL GROUP BY digest HAVING count(*) > 1")
    def two_phase(spark, d):
        """Whole digests only of texts whose quick hash another text has too; the sets are those of all digests."""
        t = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL")
        few = quick_candidates(t.select("doc_id", "text", quick_hash(F.encode("text", "utf-8"), 256).alias("quick")), "quick")
        return duplicate_sets(few.select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("digest")), "digest")

    @c.query("dedup_quickhash_short", f"WITH {_QUICK} SELECT doc_id, quick FROM q")
    def quick_short(spark, d):
        """Quick hashes of texts up to the sample, which are read whole; SQL has no bytes to cut longer ones by."""
        t = table(spark, d, "documents", "doc_id", "text").where("octet_length(text) <= 256")
        return t.select("doc_id", quick_hash(F.encode("text", "utf-8"), 256).alias("quick"))

    @c.query("dedup_quickhash_candidates")
    def quick(spark, d):
        t = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", quick_hash(F.encode("text", "utf-8"), 256).alias("quick"))
        return quick_candidates(t, "quick")

    @c.query("hash_digests", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
    def digests(spark, d):
        return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))

    @c.query("fingerprints", "SELECT DISTINCT file_id, md5(concat_ws(':', regexp_extract(file_path, '[^/]*$'), file_size::VARCHAR, round(file_mtime * 1e6)::BIGINT::VARCHAR)) AS fingerprint FROM file_cache")
    def prints(spark, d):
        t = table(spark, d, "file_cache", "file_id", "file_path", "file_size", "file_mtime")
        return t.select("file_id", fingerprint(F.regexp_extract("file_path", "[^/]*$", 0), F.col("file_size"), F.col("file_mtime")).alias("fingerprint")).distinct()

    @c.query("thumbnail_keys", f"WITH {CON} SELECT file_id, substr(md5(image_path), 1, 16) || '.jpg' AS thumbnail FROM con")
    def thumbnails(spark, d):
        return contents(spark, d).select("file_id", F.concat(F.substring(F.md5("image_path"), 1, 16), F.lit(".jpg")).alias("thumbnail"))

    for t, bands in ((4, 6), (8, 11), (12, 15)):
        @c.query(f"near_dup_value_pairs_t{t}", f"WITH {_HASHED}, v AS (SELECT DISTINCT bits FROM looks) SELECT a.bits::VARCHAR AS low, b.bits::VARCHAR AS high, bit_count(xor(a.bits, b.bits))::INT AS bits_apart FROM v a JOIN v b ON a.bits < b.bits AND bit_count(xor(a.bits, b.bits)) <= {t}")
        def pairs(spark, d, t=t, bands=bands):
            p = hamming_value_pairs(_looks(spark, d).select(F.col("bits").alias("value")), t, bands)
            text = lambda x: F.conv(F.hex(x), 16, 10)
            flip = F.col("a").cast("decimal(20,0)") + F.when(F.col("a") < 0, F.lit(2).cast("decimal(20,0)") * F.lit(2**62).cast("decimal(20,0)") * 2).otherwise(0)
            other = F.col("b").cast("decimal(20,0)") + F.when(F.col("b") < 0, F.lit(2).cast("decimal(20,0)") * F.lit(2**62).cast("decimal(20,0)") * 2).otherwise(0)
            return p.select(F.when(flip < other, text("a")).otherwise(text("b")).alias("low"), F.when(flip < other, text("b")).otherwise(text("a")).alias("high"), F.col("bits").alias("bits_apart"))

        if t > 8:
            continue

        @c.query(f"near_dup_groups_t{t}", f"""WITH RECURSIVE {_HASHED}, v AS (SELECT bits, min(file_id) AS rep FROM looks GROUP BY bits),
            e AS (SELECT a.rep AS x, b.rep AS y FROM v a JOIN v b ON bit_count(xor(a.bits, b.bits)) <= {t}),
            reach(n, root) AS (SELECT x, x FROM e UNION SELECT e.y, r.root FROM reach r JOIN e ON e.x = r.n WHERE r.root < e.y),
            parts AS (SELECT n, min(root) AS root FROM reach GROUP BY n),
            whole AS (SELECT l.file_id, p.root, l.bits FROM looks l JOIN v ON v.bits = l.bits JOIN parts p ON p.n = v.rep),
            sized AS (SELECT *, count(*) OVER (PARTITION BY root) AS n FROM whole)
            SELECT file_id, root AS group_id, (SELECT count(*) - 1 FROM looks l WHERE bit_count(xor(l.bits, s.bits)) <= {t}) AS links FROM sized s WHERE n > 1""")
        def groups(spark, d, t=t, bands=bands):
            return similar_groups(_looks(spark, d), t, bands)

    @c.query("hamming_to_average", f"""WITH {CON}, h AS (SELECT file_id, regexp_replace(regexp_replace(lower(phash), '^\\s*((md5:|sha256:|0x)\\s*)?', ''), '\\s+$', '') AS p, regexp_replace(regexp_replace(lower(average_hash), '^\\s*((md5:|sha256:|0x)\\s*)?', ''), '\\s+$', '') AS a FROM con)
        SELECT file_id, CASE WHEN regexp_full_match(p, '[0-9a-f]{{16}}') AND regexp_full_match(a, '[0-9a-f]{{16}}') THEN bit_count(xor(('0x' || p)::UBIGINT, ('0x' || a)::UBIGINT)) ELSE 999 END::INT AS bits_apart FROM h""")
    def to_average(spark, d):
        return contents(spark, d).select("file_id", F.coalesce(hamming(hash64(F.col("phash")), hash64(F.col("average_hash"))), F.lit(999)).cast("int").alias("bits_apart"))

    _DIST = "1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"

    @c.query("cosine_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_DIST}, 6) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND {_DIST} <= 0.6")
    def near_vectors(spark, d):
        return cosine_pairs(table(spark, d, "embeddings"), 0.6).withColumn("distance", F.round("distance", 6))

    @c.query("cosine_clusters", f"""WITH RECURSIVE e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON {_DIST} <= 0.6 OR a.vec_id = b.vec_id),
        reach(n, root) AS (SELECT x, x FROM e UNION SELECT e.y, r.root FROM reach r JOIN e ON e.x = r.n WHERE r.root < e.y) SELECT n AS id, min(root) AS cluster FROM reach GROUP BY n""")
    def vector_clusters(spark, d):
        return cosine_clusters(table(spark, d, "embeddings"), 0.6)

    @c.query("cosine_to_label_mate", f"SELECT a.vec_id, round({_DIST}, 6) AS distance, {_DIST} <= 0.6 AS matches FROM embeddings a JOIN (SELECT label, min(vec_id) AS v FROM embeddings GROUP BY label) m ON m.label = a.label JOIN embeddings b ON b.vec_id = m.v")
    def label_mate(spark, d):
        e = Scratch(spark, "mates").write(table(spark, d, "embeddings"))
        first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("mate"))
        dist = cosine_distance(F.col("embedding"), F.col("mate"))
        return e.join(first, "label").select("vec_id", F.round(dist, 6).alias("distance"), (dist <= 0.6).alias("matches"))

    @c.query("components_of_names", """WITH RECURSIVE e AS (SELECT s_suppkey AS x, 1000000 + s_nationkey AS y FROM supplier UNION SELECT 1000000 + s_nationkey, s_suppkey FROM supplier),
        reach(n, root) AS (SELECT x, x FROM e UNION SELECT e.y, r.root FROM reach r JOIN e ON e.x = r.n WHERE r.root < e.y) SELECT n AS node, min(root) AS component FROM reach GROUP BY n""")
    def components(spark, d):
        return connected_components(table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), (F.col("s_nationkey") + 1000000).alias("dst")))

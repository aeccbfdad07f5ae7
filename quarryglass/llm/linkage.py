"""Duplicates of new batches against all that was accepted before.

Incremental record linkage. The history lives in a folder that any later session can open: the accepted records under
their blocking keys, the links, a log of steps, and the union-find parents of clusters. A new batch reads only the
partitions that its own keys fall into, its links are scored with weights learned from all links so far, links of too
little weight are rejected, and only the clusters that a link touches get new representatives.

The 64 bits of a perceptual hash are cut into three bands. Two hashes that differ in at most 4 bits differ in at most one
bit of some band, so a record is filed under its three bands and a new hash probes each band and its neighbours at one bit.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarryglass.functions.keys import digest, hash64
from quarryglass.operators.components import connected_components
from quarryglass.plans.cut import Scratch
from quarryglass.plans.salt import salted_join

RECORD = "file_id bigint, digest string, bits bigint, look bigint"
LINK = "new bigint, old bigint, same_digest boolean, bits_apart int, look_apart int"
PARENT = "node bigint, root bigint"
#: Bits in which perceptual hashes of linked files may differ; with bands that are probed at one bit, at most 5.
DISTANCE = 4
#: First bit and width of the bands.
BANDS = ((0, 22), (22, 21), (43, 21))
#: The kind of key under which every record is filed: its digest.
WHOLE = len(BANDS)
#: Weight (bits) from which a link is accepted: agreement a million times as likely for duplicates as by chance.
ACCEPT = 20.0


def cached_records(file_cache: DataFrame, content: DataFrame) -> DataFrame:
    """The record of each file of the cache: of a path written twice, the row with the later ``cached_at``."""
    last = file_cache.where("file_id IS NOT NULL").groupBy("file_id").agg(F.max(F.struct("cached_at", "file_hash")).alias("r"))
    return _with_looks(last.select("file_id", digest(F.col("r.file_hash")).alias("digest")), content)


def batch_records(results: DataFrame, content: DataFrame) -> DataFrame:
    """The record of each file and batch, with ``batch_id``: of rows delivered twice, the one with the latest ``checked_at``.

    Rows without ``file_id`` or ``batch_id`` belong to no batch and give nothing.
    """
    rows = results.where("file_id IS NOT NULL AND batch_id IS NOT NULL")
    last = rows.groupBy("batch_id", "file_id").agg(F.max(F.struct("checked_at", "file_hash")).alias("r"))
    return _with_looks(last.select("batch_id", "file_id", digest(F.col("r.file_hash")).alias("digest")), content)


def _with_looks(files: DataFrame, content: DataFrame) -> DataFrame:
    looks = content.where("file_id IS NOT NULL").groupBy("file_id").agg(F.max(hash64(F.col("phash"))).alias("bits"), F.max(hash64(F.col("average_hash"))).alias("look"))
    return files.join(looks, "file_id", "left")


# Expressions in SQL: built from columns, hundreds of calls to the JVM a step would cost more than the step on small batches.
def _band(bits: str, band: int) -> str:
    shift, width = BANDS[band]
    return f"(shiftrightunsigned({bits}, {shift}) & {(1 << width) - 1}L)"


def _key(kind: int) -> str:
    """Of the columns ``digest`` and ``bits``. Those of digests are below 0, so that they are none of a band's."""
    return f"(xxhash64(digest) | {-(1 << 63) + 1}L - 1L)" if kind == WHOLE else f"({_band('bits', kind)} | {kind << 32}L)"


def _part(key: str, parts: int) -> str:
    return f"CAST(pmod(xxhash64({key}), {parts}) AS INT)"


def _near(a: str, b: str) -> str:
    """Whether hashes are within the distance and ``kind`` is the first band that shows it, so that each pair comes out once."""
    met = [f"bit_count({_band(a, k)} ^ {_band(b, k)}) <= 1" for k in range(len(BANDS))]
    first = "CASE " + " ".join(f"WHEN {m} THEN {k}" for k, m in enumerate(met)) + " END"
    return f"bit_count({a} ^ {b}) <= {DISTANCE} AND kind = {first}"


def _observed(seen: Observation) -> dict[str, int]:
    """What was observed; nothing of a plan that was empty from the outset, as its metrics went with it."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


class Store:
    """Tables and a log of steps below ``root``. A step counts once its entry is written, after all of its tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        p, fs = self._path(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def load(self, name: str) -> dict:
        p, fs = self._path(name)
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def save(self, name: str, value: dict) -> None:
        """Written aside and renamed, so that nobody reads half of it."""
        p, fs = self._path(name)
        aside = p.suffix(".part")
        stream = fs.create(aside, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        if not fs.rename(aside, p):
            raise FileExistsError(f"{name} was written by another session")

    def delete(self, name: str) -> None:
        p, fs = self._path(name)
        fs.delete(p, True)

    def exists(self, name: str) -> bool:
        p, fs = self._path(name)
        return fs.exists(p)


@dataclass
class Linker:
    """The state of a linkage, and the steps on it; ``Linker.open(spark, root)`` takes up what earlier sessions left.

    ``part_rows``: records for which a compaction makes one partition of each kind of key. ``probe_bytes``: size of the
    probes of a batch (67 for each hash, ``PROBE_BYTES`` each) and of the batch itself up to which they are sent to the
    history, which is then read where it lies; a larger batch is joined by a shuffle with hot keys salted. ``clusters``:
    whether steps maintain clusters. One session writes at a time.
    """

    spark: SparkSession
    root: str
    part_rows: int = 1_000_000
    probe_bytes: int = 128 << 20
    rows_per_task: int = 20_000
    clusters: bool = True
    version: int = 0
    parts: int = 1
    log: list[dict] = field(default_factory=list)

    PROBE_BYTES = 48

    @classmethod
    def open(cls, spark: SparkSession, root: str, **options) -> Linker:
        out = cls(spark, root, **options)
        versions = [int(n[2:]) for n in out._store.names("") if n.startswith("v=") and out._store.exists(f"{n}/log/000000.json")]
        if versions:
            out.version = max(versions)
        folder = f"v={out.version}/log"
        out.log = [out._store.load(f"{folder}/{n}") for n in out._store.names(folder) if n.endswith(".json")]
        out.parts = out.log[0]["parts"] if out.log else out.parts
        return out

    @property
    def _store(self) -> Store:
        return Store(self.spark, self.root)

    def _name(self, table: str) -> str:
        return f"{self.root}/v={self.version}/{table}"

    def _read(self, table: str, schema: str, upto: int | None = None) -> DataFrame:
        steps = [e["step"] for e in self.log if upto is None or e["step"] < upto]
        if not steps:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._name(table)).where(F.col("step").isin(steps))

    def _filed(self, upto: int | None = None) -> DataFrame:
        return self._read("filed", f"step int, kind int, part int, {RECORD}", upto)

    @property
    def members(self) -> DataFrame:
        """All accepted records."""
        return self._filed().where(F.col("kind") == WHOLE).select("file_id", "digest", "bits", "look")

    @property
    def links(self) -> DataFrame:
        """``(step, new, old, same_digest, bits_apart, look_apart)`` of all steps; distances are null where a hash is."""
        return self._read("links", f"step int, {LINK}")

    @property
    def counted(self) -> dict[tuple[str, ...], int]:
        """How often each pattern of levels occurred among all links."""
        out: dict[tuple[str, ...], int] = {}
        for e in self.log:
            for k, n in e["patterns"].items():
                out[tuple(k.split("|"))] = out.get(tuple(k.split("|")), 0) + n
        return out

    def weights(self) -> dict[str, dict[str, float]]:
        """Learned from the patterns of all links so far."""
        return learned_weights(sorted(self.counted.items()))[0]

    def accepted(self, links: DataFrame | None = None) -> DataFrame:
        """Links whose weight is at least ``ACCEPT``, with their levels and ``weight``."""
        return weighed(self.links if links is None else links, self.weights()).where(F.col("weight") >= ACCEPT)

    def _file(self, records: DataFrame) -> DataFrame:
        """Each record under each of its keys: ``kind`` and the partition of the key."""
        keys = [f"struct({k} AS kind, {_part(_key(k), self.parts)} AS part, bits IS NOT NULL AS ok)" for k in range(len(BANDS))]
        keys.append(f"struct({WHOLE} AS kind, IF(digest IS NULL, {_part('file_id', self.parts)}, {_part(_key(WHOLE), self.parts)}) AS part, true AS ok)")
        filed = records.selectExpr("file_id", "digest", "bits", "look", f"explode(array({', '.join(keys)})) AS k").where("k.ok").select("file_id", "digest", "bits", "look", "k.kind", "k.part")
        return filed.hint("rebalance", "kind", "part") if self.parts > 1 else filed

    def probes(self, batch: DataFrame) -> DataFrame:
        """``(kind, key, p_bits)``: the keys under which records alike to some of the batch are filed.

        For each distinct hash its bands and their neighbours at one bit, for each distinct digest its key.
        """
        flips = lambda w: ", ".join(["0L", *(f"{1 << j}L" for j in range(w))])
        bands = (f"transform(array({flips(w)}), f -> struct({k} AS kind, ({_band('bits', k)} ^ f) | {k << 32}L AS key))" for k, (_, w) in enumerate(BANDS))
        near = batch.where("bits IS NOT NULL").select("bits").distinct().selectExpr(f"explode(flatten(array({', '.join(bands)}))) AS p", "bits")
        exact = batch.where("digest IS NOT NULL").select("digest").distinct()
        return near.selectExpr("p.kind", "p.key", "bits AS p_bits").union(exact.selectExpr(f"{WHOLE}", _key(WHOLE), "CAST(NULL AS BIGINT)"))

    def candidates(self, probes: DataFrame, step: int) -> DataFrame:
        """``(kind, key, old, …)``: records of the history with the keys under which probes may find them.

        Where the probes fall into so few partitions that all kinds of keys together have fewer rows there than the whole
        history, those partitions are read; else every record once, and its keys are made on the way.
        """
        history = self._filed(step)
        own = "file_id AS old, digest AS _od, bits AS _ob, look AS _ol"
        if self.parts > 1:
            met = probes.selectExpr("kind", f"{_part('key', self.parts)} AS part").distinct().collect()  # at most 4 x parts
            if len(met) < self.parts:
                kinds = []
                for k in range(WHOLE + 1):
                    at = [r.part for r in met if r.kind == k]
                    kinds.append(history.where((F.col("kind") == k) & F.col("part").isin(at)).selectExpr(f"{k} AS kind", f"{_key(k)} AS key", *own.split(", ")))
                return reduce(DataFrame.union, kinds).where("key IS NOT NULL")
        keys = ", ".join(f"struct({k} AS kind, {_key(k)} AS key)" for k in range(WHOLE))
        keys += f", struct({WHOLE} AS kind, IF(digest IS NULL, NULL, {_key(WHOLE)}) AS key)"
        return history.where(F.col("kind") == WHOLE).selectExpr(f"explode(array({keys})) AS k", *own.split(", ")).select("k.kind", "k.key", "old", "_od", "_ob", "_ol").where("key IS NOT NULL")

    def probe(self, batch: DataFrame, rows: int, step: int) -> DataFrame:
        """Links of the batch's records to the history: an equal digest, or perceptual hashes within ``DISTANCE``.

        Distinct values are matched first, their files follow by a tag, which holds the whole digest or hash. One row per
        pair of records, no pair within the batch.
        """
        small = rows * self.PROBE_BYTES * sum(w + 1 for _, w in BANDS) <= self.probe_bytes
        probes = self.probes(batch)
        found, probes = self.candidates(probes, step), probes.drop("kind")
        met = found.join(F.broadcast(probes), "key") if small else salted_join(found, probes, ["key"], "old", self.rows_per_task)
        met = met.where(f"p_bits IS NULL OR {_near('p_bits', '_ob')}").selectExpr("IF(p_bits IS NULL, 'd' || _od, 'b' || p_bits) AS tag", "old", "_od", "_ob", "_ol")
        files = batch.selectExpr("explode(array_compact(array('d' || digest, 'b' || bits))) AS tag", "file_id AS new", "digest AS _d", "bits AS _b", "look AS _l")
        both = met.join(F.broadcast(files), "tag") if small else salted_join(Scratch(self.spark, "met").write(met), files, ["tag"], "old", self.rows_per_task)
        # a near pair with the same digest comes by its digest
        both = both.where("new <> old AND NOT (startswith(tag, 'b') AND coalesce(_d = _od, false))")
        return both.selectExpr("new", "old", "coalesce(_d = _od, false) AS same_digest", "CAST(bit_count(_b ^ _ob) AS INT) AS bits_apart", "CAST(bit_count(_l ^ _ol) AS INT) AS look_apart")

    def append(self, batch: DataFrame, rows: int = 0) -> DataFrame:
        """Link a batch ``(file_id, digest, bits, look)`` against the history and accept it. Returns its links.

        ``rows``: of the first batch, if known, for its number of partitions.

        Its records are filed first, then its links are written while their patterns are counted, then the clusters; the
        entry in the log makes all of them count. What a session left unfinished is overwritten.
        """
        step = len(self.log)
        self.parts = self.parts if step else max(1, -(-rows // self.part_rows))
        seen = Observation()
        filed = self._file(batch.observe(seen, F.count(F.lit(1)).alias("n")))
        filed.write.mode("overwrite").partitionBy("kind", "part").parquet(self._name(f"filed/step={step}"))
        rows = _observed(seen).get("n", 0)
        entry = {"step": step, "parts": self.parts, "records": rows, "patterns": {}}
        path = self._name(f"links/step={step}")
        if step and rows:
            own = self.spark.read.schema(f"kind int, part int, {RECORD}").parquet(self._name(f"filed/step={step}")).where(F.col("kind") == WHOLE)
            links, counts = self.probe(own, rows, step), Observation()
            each = [F.expr("count_if(" + " AND ".join(f"{f} = '{v}'" for f, v in zip(LEVELS, p)) + ")").alias("|".join(p)) for p in product(*LEVELS.values())]
            links.select("*", *levels_of()).observe(counts, *each).select(links.columns).write.mode("overwrite").parquet(path)
            entry["patterns"] = {k: n for k, n in _observed(counts).items() if n}
        else:
            self.spark.createDataFrame([], LINK).write.mode("overwrite").parquet(path)
        found = self.spark.read.schema(LINK).parquet(path)
        self.log.append(entry)
        try:
            if self.clusters and entry["patterns"]:
                self._merge(self.accepted(found), step)
            elif self.clusters:
                self.spark.createDataFrame([], f"{PARENT}, part int").write.mode("overwrite").partitionBy("part").parquet(self._name(f"parents/step={step}"))
            self._store.save(f"v={self.version}/log/{step:06d}.json", entry)
        except BaseException:
            self.log.pop()
            raise
        return found

    def _parents(self, upto: int) -> DataFrame:
        return self._read("parents", f"step int, part int, {PARENT}", upto)

    def find(self, nodes: DataFrame, upto: int) -> DataFrame:
        """``(node, root)`` of the given nodes: parents are followed until there is none. Reads only partitions of those nodes."""
        at = nodes.select("node", F.col("node").alias("root"))
        if not any(e["patterns"] for e in self.log[:upto]):
            return at
        scratch, k = Scratch(self.spark, "find"), 0
        while True:
            log = self._parents(upto)
            if self.parts > 1:
                at = scratch.write(at, f"at{k}")
                met = [r.part for r in at.selectExpr(f"{_part('root', self.parts)} AS part").distinct().collect()]
                log = log.where(F.col("part").isin(met))
            last = log.groupBy("node").agg(F.max_by("root", "step").alias("up"))
            up = lambda c, to: last.select(F.col("node").alias(c), F.col("up").alias(to))
            # two steps up in one job: where the second leads nowhere, the first was the root
            hop = at.join(up("root", "_1"), "root", "left").withColumn("_1", F.coalesce("_1", "root"))
            moved = hop.join(up("_1", "_2"), "_1", "left").select("node", F.coalesce("_2", "_1").alias("root"), (F.col("_2") != F.col("_1")).alias("moved")) if self.parts == 1 else hop.select("node", F.col("_1").alias("root"), (F.col("_1") != F.col("root")).alias("moved"))
            seen = Observation()
            k += 1
            at = scratch.write(moved.observe(seen, F.count_if("moved").alias("n")).drop("moved"), str(k))
            if not _observed(seen).get("n", 0):
                return at

    def _merge(self, links: DataFrame, step: int) -> None:
        """Unite the clusters that links connect; the smallest file becomes the root. Writes parents of touched nodes only."""
        links = links.select("new", "old").distinct()
        roots = self.find(links.select(F.explode(F.array("new", "old")).alias("node")).distinct(), step)
        of = lambda c, r: roots.select(F.col("node").alias(c), F.col("root").alias(r))
        edges = links.join(of("new", "src"), "new").join(of("old", "dst"), "old").select("src", "dst").distinct()
        united = connected_components(edges).select(F.col("node").alias("root"), "component")
        below = roots.join(united, "root").select("node", F.col("component").alias("root"))
        parents = below.union(united.select(F.col("root").alias("node"), F.col("component").alias("root"))).distinct()
        parents = parents.withColumn("part", F.expr(_part("node", self.parts))).hint("rebalance", "part")
        parents.write.mode("overwrite").partitionBy("part").parquet(self._name(f"parents/step={step}"))

    def cluster_table(self) -> DataFrame:
        """``(node, root)`` of all files in clusters of two or more."""
        last = self._parents(len(self.log)).groupBy("node").agg(F.max_by("root", "step").alias("root"))
        return connected_components(last, "node", "root").select("node", F.col("component").alias("root"))

    def compact(self) -> None:
        """Write all steps as one, with partitions for the records there are, every node right below its root."""
        rows = sum(e["records"] for e in self.log)
        members, links, clusters, counted = self.members, self.links.drop("step"), self.cluster_table() if self.clusters else None, self.counted
        old, self.version = self.version, self.version + 1
        self.parts = max(1, -(-rows // self.part_rows))
        self._file(members).write.mode("overwrite").partitionBy("kind", "part").parquet(self._name("filed/step=0"))
        links.write.mode("overwrite").parquet(self._name("links/step=0"))
        if clusters is not None:
            clusters.withColumn("part", F.expr(_part("node", self.parts))).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(self._name("parents/step=0"))
        self.log = [{"step": 0, "parts": self.parts, "records": rows, "patterns": {"|".join(k): n for k, n in counted.items()}}]
        self._store.save(f"v={self.version}/log/000000.json", self.log[0])
        self._store.delete(f"v={old}")


def link_history(cache: DataFrame, batches: DataFrame, clusters: bool = True) -> Linker | None:
    """Append the cache and then the batches in the order of ``batch_id``; None without a batch.

    Batches are taken one at a time from a table written by ``batch_id``; only the list of batch numbers is collected.
    """
    spark = cache.sparkSession
    scratch = Scratch(spark, "linkage")
    linker = Linker.open(spark, scratch.path("store"), clusters=clusters)
    with ThreadPoolExecutor(2) as pool:
        # few files a batch, and large batches in several
        incoming = pool.submit(scratch.write, batches.hint("rebalance", "batch_id"), "incoming", partition_by=["batch_id"])
        accepted, rows = scratch.write_counted(cache, "cache")
        linker.append(accepted, rows)
        incoming = incoming.result()
    numbers = [r.batch_id for r in incoming.select("batch_id").distinct().orderBy("batch_id").collect()]
    for n in numbers:
        linker.append(incoming.where(F.col("batch_id") == n))
    return linker if numbers else None


def duplicates_of_batches(cache: DataFrame, batches: DataFrame) -> DataFrame:
    """``(file_id_a, file_id_b)``, smaller first: all accepted links of :func:`link_history`, each once."""
    linker = link_history(cache, batches, clusters=False)
    if linker is None:
        return cache.sparkSession.createDataFrame([], "file_id_a bigint, file_id_b bigint")
    return linker.accepted().select(F.least("new", "old").alias("file_id_a"), F.greatest("new", "old").alias("file_id_b")).distinct()


LEVELS = {"digest": ("same", "differs"), "bits": ("0", "1-2", "3-4", "far", "none"), "look": ("0-4", "5-12", "far", "none")}


def levels_of() -> list[Column]:
    """The agreement level of each field of a link."""
    b, k = F.col("bits_apart"), F.col("look_apart")
    return [
        F.when(F.col("same_digest"), "same").otherwise("differs").alias("digest"),
        F.when(b.isNull(), "none").when(b == 0, "0").when(b <= 2, "1-2").when(b <= 4, "3-4").otherwise("far").alias("bits"),
        F.when(k.isNull(), "none").when(k <= 4, "0-4").when(k <= 12, "5-12").otherwise("far").alias("look"),
    ]


def chance_levels() -> dict[str, dict[str, float]]:
    """How often two unrelated records fall into a level: bits of unrelated hashes agree as coins do."""
    tail = lambda a, b: sum(math.comb(64, k) for k in range(a, b + 1)) / 2**64
    return {
        "digest": {"same": 2.0**-64, "differs": 1.0},
        "bits": {"0": tail(0, 0), "1-2": tail(1, 2), "3-4": tail(3, 4), "far": tail(5, 64), "none": 1.0},
        "look": {"0-4": tail(0, 4), "5-12": tail(5, 12), "far": tail(13, 64), "none": 1.0},
    }


def learned_weights(counted: list[tuple[tuple[str, str, str], int]], rounds: int = 100, tolerance: float = 1e-9) -> tuple[dict[str, dict[str, float]], float]:
    """Fellegi-Sunter weights (log2 of m over u) by expectation maximisation, and the share of true links.

    ``counted``: how often each pattern of levels (digest, bits, look) occurs among the links. The chance frequencies u
    are given by :func:`chance_levels`; m and the share are learned. A level never seen gets the m of half a link.
    """
    u, fields = chance_levels(), list(LEVELS)
    total = sum(n for _, n in counted)
    m = {f: {lv: 1 / len(LEVELS[f]) for lv in LEVELS[f]} for f in fields}
    share = 0.5
    for _ in range(rounds if total else 0):
        seen = {f: {lv: 0.5 for lv in LEVELS[f]} for f in fields}
        true = 0.0
        for pattern, n in counted:
            a, b = share, 1 - share
            for f, lv in zip(fields, pattern):
                a, b = a * m[f][lv], b * u[f][lv]
            p = n * a / (a + b) if a + b else 0.0
            true += p
            for f, lv in zip(fields, pattern):
                seen[f][lv] += p
        m = {f: {lv: v / sum(seen[f].values()) for lv, v in seen[f].items()} for f in fields}
        now = min(1 - 1e-9, true / total)
        share, done = now, abs(now - share) < tolerance
        if done:
            break
    return {f: {lv: math.log2(m[f][lv] / u[f][lv]) for lv in LEVELS[f]} for f in fields}, share


def weighed(links: DataFrame, weights: dict[str, dict[str, float]]) -> DataFrame:
    """``(new, old, digest, bits, look, weight)``: each link with its levels and the sum of their weights."""

    def weight(f: str) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in weights[f].items() for x in kv]), F.col(f))

    return links.select("new", "old", *levels_of()).withColumn("weight", F.round(sum((weight(f) for f in LEVELS), F.lit(0.0)), 6))


def clusters_of_batches(cache: DataFrame, batches: DataFrame) -> DataFrame:
    """``(file_id, cluster_id, links)`` of every file in a cluster of two or more, after all batches.

    ``cluster_id`` is the smallest file of the cluster, ``links`` the file's number of accepted links.
    """
    linker = link_history(cache, batches)
    if linker is None:
        return cache.sparkSession.createDataFrame([], "file_id bigint, cluster_id bigint, links bigint")
    pairs = linker.accepted().select(F.least("new", "old").alias("a"), F.greatest("new", "old").alias("b")).distinct()
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    return linker.cluster_table().join(degree, "node").select(F.col("node").alias("file_id"), F.col("root").alias("cluster_id"), "links")

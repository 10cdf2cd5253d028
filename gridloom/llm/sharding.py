"""Sharding with size-tiered compaction and an atomically committed, versioned manifest. DataFrame and SQL functions only.

Layout under a root in shared storage:
    data/<write>/part-*.parquet     immutable shards
    manifests/<name>/               a version's rows: shard, bytes, rows, tier (Parquet)
    versions/<number>               a small file that names the manifest; made by a rename that fails where it exists

`append` writes an arrival as it comes, one shard a task, without a shuffle. `compact` puts shards into tiers by size
(each tier `fan` times the one below), and merges a tier with `fan` shards or more into files of about `target_bytes`:
the shards are read once, and neighbouring reads are written to one file, again without a shuffle. A shard near the
target is left alone. Readers see the version that they opened; a writer that lost the race for a version number fails
and leaves files that no manifest names. `vacuum` removes those, and versions that have been replaced, once they are
older than `keep_hours`: files of a writer that hasn't committed, and versions that a reader may hold, are younger. A lost executor costs its tasks only: shards get their
names from Spark's committer and enter the manifest after the write has succeeded. The driver holds the names of a
version's shards, as it does for every file source: about 100 bytes for each `target_bytes` of data.

Edge cases: all columns and types are kept, whatever their names, null and empty texts included; an empty arrival adds
a shard without rows, or none; repeated rows stay repeated; equal sizes are ordered by name.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MANIFEST = "shard string, bytes long, rows long"


@dataclass(frozen=True)
class Tiers:
    target_bytes: int = 128 << 20
    least_bytes: int = 1 << 20
    fan: int = 4
    full: float = 0.7
    keep_hours: float = 7 * 24.0


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, tiers: Tiers = Tiers()):
        self.spark, self.root, self.tiers = spark, root.rstrip("/"), tiers

    # ---- versions

    def version(self) -> int:
        """The latest committed version; 0 before the first."""
        fs, p = common.filesystem(self.spark, f"{self.root}/versions")
        if not fs.exists(p):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.sql("SELECT CAST(NULL AS STRING) AS shard, 0L AS bytes, 0L AS rows WHERE false")
        name = self.spark.read.text(f"{self.root}/versions/{version:012d}", wholetext=True).first()[0]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{name.strip()}")

    def commit(self, rows: DataFrame, base: int) -> int:
        """Makes the rows version base + 1; fails if that exists."""
        spark, jvm = self.spark, self.spark.sparkContext._jvm
        name, number = uuid.uuid4().hex, base + 1
        rows.select("shard", "bytes", "rows").coalesce(1).write.parquet(f"{self.root}/manifests/{name}")
        fs, folder = common.filesystem(spark, f"{self.root}/versions")
        fs.mkdirs(folder)
        path = jvm.org.apache.hadoop.fs.Path
        draft, final = path(f"{self.root}/versions/.draft-{name}"), path(f"{self.root}/versions/{number:012d}")
        out = fs.create(draft, False)
        out.writeBytes(name)
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), none)  # raises where the version exists
        return number

    # ---- writing

    def _write(self, rows: DataFrame) -> DataFrame:
        """The shards of one write, with their sizes."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        about = self.spark.read.schema(rows.schema).parquet(folder).select(F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_size").alias("bytes"))
        return about.groupBy("shard").agg(F.max("bytes").alias("bytes"), F.count("*").alias("rows"))

    def append(self, rows: DataFrame) -> int:
        base = self.version()
        return self.commit(self.manifest(base).unionByName(self._write(rows)), base)

    def tiered(self, manifest: DataFrame) -> DataFrame:
        """Adds tier (null: near the target or above, left alone) and place, the number of the target-sized file a shard would join."""
        t = self.tiers
        size = F.greatest(F.col("bytes"), F.lit(t.least_bytes)) / t.least_bytes
        tier = F.when(F.col("bytes") < t.full * t.target_bytes, F.floor(F.log(size) / F.log(F.lit(float(t.fan))) + 1e-9).cast("int"))
        return manifest.withColumn("tier", tier)

    def compact(self, schema) -> int:
        """Merges tiers from the lowest on, until none has `fan` shards; one commit for each merge."""
        t, spark = self.tiers, self.spark
        while True:
            base = self.version()
            tiered = self.tiered(self.manifest(base)).filter("tier IS NOT NULL")
            # a tier and all tiers below it join the merge, so that small leftovers don't pile up
            ripe = tiered.groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
            ripe = ripe.withColumn("upto", F.sum("bytes").over(Window.orderBy("tier"))).filter(F.col("n") >= t.fan).orderBy(F.desc("tier")).first()
            if ripe is None:
                return base
            merged = tiered.filter(F.col("tier") <= ripe.tier)
            paths = [r[0] for r in merged.select("shard").orderBy("shard").collect()]  # names, as the file source takes them
            files = max(1, round(ripe.upto / t.target_bytes))
            new = self._write(spark.read.schema(schema).parquet(*paths).coalesce(files))
            self.commit(self.manifest(base).join(merged.select("shard"), "shard", "left_anti").unionByName(new), base)
            if len(paths) <= files:
                return base + 1

    def vacuum(self) -> None:
        """Removes data that no kept version names. The latest version is kept, and all that were replaced less than
        `keep_hours` ago; so is data younger than that."""
        fs, data = common.filesystem(self.spark, f"{self.root}/data")
        _, versions = common.filesystem(self.spark, f"{self.root}/versions")
        before = time.time() * 1000 - self.tiers.keep_hours * 3_600_000
        found = sorted((int(s.getPath().getName()), s.getModificationTime()) for s in fs.listStatus(versions) if s.getPath().getName().isdigit())
        # a version was replaced when the next one was made
        gone = [n for (n, _), (_, replaced) in zip(found, found[1:], strict=False) if replaced < before]
        live = {r[0].rsplit("/", 1)[1] for n, _ in found if n not in gone for r in self.manifest(n).select("shard").collect()}
        for folder in fs.listStatus(data):
            files = fs.listStatus(folder.getPath())
            dead = [f.getPath() for f in files if f.getPath().getName() not in live and f.getModificationTime() < before]
            if len(dead) == len(files) and folder.getModificationTime() < before:
                fs.delete(folder.getPath(), True)
            else:
                for path in dead:
                    fs.delete(path, True)
        for old in gone:
            common.delete(self.spark, f"{self.root}/versions/{old:012d}")

    # ---- reading

    def read(self, schema, version: int | None = None) -> DataFrame:
        """All rows of a version, with shard, the file they lie in."""
        paths = [r[0] for r in self.manifest(version).filter("rows > 0").select("shard").orderBy("shard").collect()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)


def arrivals(table: DataFrame, n: int = 8) -> list[DataFrame]:
    """The table in n parts, as if each had come on its own: runs of its files, or where there are fewer files than that, each
    run again by a hash of doc_id, so that there are n arrivals whatever the files."""
    files = sorted(table.inputFiles())
    runs = max(1, min(n, len(files)))
    out = []
    for i in range(runs):
        part = table.sparkSession.read.schema(table.schema).parquet(*files[i * len(files) // runs : (i + 1) * len(files) // runs]) if files else table
        shares = (i + 1) * n // runs - i * n // runs
        out += [part.filter(F.pmod(F.xxhash64("doc_id"), F.lit(shares)) == k) if shares > 1 else part for k in range(shares)]
    return out


def ingest(documents: DataFrame, root: str, tiers: Tiers = Tiers()) -> ShardStore:
    """Appends every arrival and compacts as tiers fill."""
    common.tune(documents.sparkSession)
    store = ShardStore(documents.sparkSession, root, tiers)
    for i, part in enumerate(arrivals(documents), 1):
        store.append(part)
        if i % tiers.fan == 0:
            store.compact(documents.schema)
    store.compact(documents.schema)
    store.vacuum()
    return store


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they come back from the live shards after appends and compactions."""
    documents = common.read(spark, sf_dir, "documents")
    store = ingest(documents, f"{common.shared_folder(spark)}/shards-{uuid.uuid4().hex}")
    return store.read(documents.schema).select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


OP9_SQL = "SELECT doc_id, lang, source, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5 FROM documents"

"""Content-addressed blobs and portable bundles: what a project is, in tables with checksums, to be taken in elsewhere under three strategies.

    store = BlobStore(spark, folder); store.put(files)
    export(docs, versions, store, bundle)
    state = take_in(bundle, store, present, "merge")
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.textetl import uid
from folioflow.session import cut
from folioflow.sources.files import import_rows

BLOB = "hash string, size long, content binary, prefix string"
DOCUMENTS = ["project", "path", "title", "doc_type", "status", "hash"]
VERSIONS = ["project", "path", "branch", "version_number", "hash", "created_at"]


def addressed(content: str = "content") -> F.Column:
    return F.sha2(F.col(content).cast("binary"), 256)


class BlobStore:
    """Contents by their SHA-256, each once, in files dealt by the first two digits, so that a look-up reads those of its prefixes only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self) -> DataFrame:
        try:
            return self.spark.read.schema(BLOB).parquet(self.folder)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], BLOB)
            raise

    def blobs(self) -> DataFrame:
        """hash, size, content. Writers that came at the same time may have written a content twice; it is given once."""
        return self._files().drop("prefix").dropDuplicates(["hash"])

    def put(self, files: DataFrame, content: str = "content") -> int:
        """Writes the contents of files that the store lacks, by all tasks; gives their number. Null contents are none; putting again writes nothing."""
        own = files.where(F.col(content).isNotNull()).select(addressed(content).alias("hash"), F.col(content).cast("binary").alias("content"))
        known = self._files().select("hash")
        fresh = cut(own.dropDuplicates(["hash"]).join(known, "hash", "left_anti").select("hash", F.length("content").cast("long").alias("size"), "content", F.substring("hash", 1, 2).alias("prefix")))
        n = fresh.count()
        if n:
            fresh.repartition("prefix").sortWithinPartitions("hash").write.partitionBy("prefix").mode("append").parquet(self.folder)
        return n

    def get(self, hashes: DataFrame) -> DataFrame:
        """hash, size, content of hashes (hash) that the store has."""
        asked = hashes.select("hash").distinct().withColumn("prefix", F.substring("hash", 1, 2))
        return self._files().join(asked, ["prefix", "hash"], "left_semi").drop("prefix").dropDuplicates(["hash"])


@dataclass(frozen=True)
class Taken:
    """What an import leaves: documents with their uid, and versions, of all projects; and how many rows the bundle had."""

    documents: DataFrame
    versions: DataFrame
    imported: int


def checksum(rows: DataFrame) -> tuple[int, str]:
    """How many rows, and a sum over them that no order changes."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(rows.columns)])
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return got.n, str(got.s or 0)


def export(documents: DataFrame, versions: DataFrame, store: BlobStore, folder: str) -> DataFrame:
    """Writes documents, versions, their blobs and a manifest to folder, which must not exist; gives the manifest: name, rows, checksum.

    ValueError names how many contents the store lacks. The manifest comes last: a folder without one is no bundle.
    """
    spark = documents.sparkSession
    docs, vers = cut(documents.select(DOCUMENTS)), cut(versions.select(VERSIONS))
    hashes = docs.select("hash").union(vers.select("hash")).where("hash is not null").distinct()
    blobs = cut(store.get(hashes).select("hash", "size", "content"))
    missing = hashes.join(blobs.select("hash"), "hash", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} contents are not in the store")
    tables = {"documents": docs, "versions": vers, "blobs": blobs}
    told = []
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{folder}/{name}")
        told.append((name, *checksum(rows.select("hash", "size") if name == "blobs" else rows)))
    manifest = spark.createDataFrame(told, "name string, rows long, checksum string")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest")
    return manifest


def verified(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A bundle's tables; ValueError says which of them isn't what its manifest says, or how many contents aren't what their address says."""
    manifest = {r.name: (r.rows, r.checksum) for r in spark.read.schema("name string, rows long, checksum string").json(f"{folder}/manifest").collect()}
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in manifest}
    for name, rows in tables.items():
        if checksum(rows.select("hash", "size") if name == "blobs" else rows) != manifest[name]:
            raise ValueError(f"{name} differ from the manifest")
    wrong = tables["blobs"].where((addressed() != F.col("hash")) | (F.length("content") != F.col("size"))).count()
    if wrong:
        raise ValueError(f"{wrong} contents differ from their address")
    return tables


def take_in(folder: str, store: BlobStore, documents: DataFrame, versions: DataFrame, strategy: str = "merge") -> Taken:
    """Takes a verified bundle into what is there, documents and versions of all projects, and its contents into the store.

    merge: its documents take the place of those at the same path; skip: those that are there stay; replace: its projects hold nothing else afterwards. What is
    derived is told anew: every document has the uid of its project and path, and one without a version gets a first one.
    """
    if strategy not in ("merge", "skip", "replace"):
        raise ValueError(f"strategy {strategy!r}")
    spark = documents.sparkSession
    new = verified(spark, folder)
    store.put(new["blobs"])
    came = new["documents"].select("project").distinct()
    both = []
    for name, present, columns in (("documents", documents, DOCUMENTS), ("versions", versions, VERSIONS)):
        own, held = new[name].select(columns), present.select(columns)
        if strategy == "replace":
            both.append(held.join(came, "project", "left_anti").unionByName(own))
            continue
        keyed = lambda df: df.withColumn("_at", F.struct("project", "path") if name == "documents" else F.struct("project", "path", "branch", "version_number"))  # noqa: B023, E731
        if name == "versions":  # versions go with their documents
            kept = new["documents"].join(documents.select("project", "path"), ["project", "path"], "left_anti" if strategy == "skip" else "left_outer").select("project", "path").distinct()
            own = own.join(kept, ["project", "path"], "left_semi")
        both.append(import_rows(keyed(own), keyed(held), "_at", strategy).drop("_at"))
    docs, vers = both
    bare = docs.join(vers.select("project", "path").distinct(), ["project", "path"], "left_anti")
    first = bare.select("project", "path", F.lit("main").alias("branch"), F.lit(1).cast(vers.schema["version_number"].dataType).alias("version_number"), "hash", F.lit(None).cast(vers.schema["created_at"].dataType).alias("created_at"))
    named = docs.withColumn("uid", uid("documents", "project", "path"))
    return Taken(cut(named), cut(vers.unionByName(first)), new["documents"].count())

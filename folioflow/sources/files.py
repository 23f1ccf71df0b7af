"""File sources and sinks: filtered scans, text with front matter, manifests, blobs and bundles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.textetl import front_matter, without_front_matter

# What a scan leaves out, and the document type of a suffix.
IGNORED_PARTS = (".piq", ".git", "__pycache__", "node_modules")
IGNORED_SUFFIXES = (".tmp", ".swp", ".swo", ".pyc")
IGNORED_NAMES = (".DS_Store", "Thumbs.db")
TYPES = {"md": "note", "sql": "schema", "prisma": "schema", "yaml": "config", "yml": "config", "json": "config", "pdf": "reference", "docx": "reference"}


def wanted(path: Column) -> Column:
    """Whether a path counts: no ignored part, name or suffix."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    suffix = "|".join(s.replace(".", r"\.") for s in IGNORED_SUFFIXES)
    return ~F.arrays_overlap(parts, F.array(*[F.lit(p) for p in IGNORED_PARTS])) & ~name.isin(*IGNORED_NAMES) & ~name.rlike(f"({suffix})$")


def visible(path: Column) -> Column:
    """No part begins with a dot."""
    return ~F.exists(F.split(path, "/"), lambda p: p.startswith("."))


def document_type(path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.coalesce(F.element_at(kinds, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("note"))


def scan(spark: SparkSession, root: str, suffixes: tuple = ("md", "txt", "sql", "prisma", "yaml", "yml", "json", "pdf", "docx")) -> DataFrame:
    """path (below root), size, modified, content of all wanted files with an allowed suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(root)
    below = F.regexp_replace("path", "^.*?" + root.removeprefix("file:").rstrip("/").replace(".", r"\.") + "/", "")
    return files.select(below.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content").where(wanted(F.col("path")))


def file_state(files: DataFrame) -> DataFrame:
    return files.select("path", "size", "modified", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"))


def texts(files: DataFrame) -> DataFrame:
    """path, kind, text, meta: Markdown without its front matter; what is no text is unsupported and empty."""
    raw = F.decode("content", "UTF-8")
    plain = F.regexp_extract("path", r"\.([^./]+)$", 1).isin("md", "txt", "sql", "prisma", "yaml", "yml", "json")
    md = F.col("path").endswith(".md")
    return files.select("path", F.when(md, "extracted").when(plain, "raw").otherwise("unsupported").alias("kind"), F.when(md, without_front_matter(raw)).when(plain, raw).otherwise("").alias("text"), F.when(md, front_matter(raw)).alias("meta"))


def listing(found: DataFrame) -> DataFrame:
    """path, title, type and status; the title falls back to the file's name in words."""
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1)
    return found.select("path", F.coalesce(F.col("meta")["title"], F.initcap(F.translate(stem, "-_", "  "))).alias("title"), F.coalesce(F.col("meta")["type"], document_type(F.col("path"))).alias("type"), F.coalesce(F.col("meta")["status"], F.lit("draft")).alias("status"))


def projects(files: DataFrame) -> DataFrame:
    """Folders that hold a project.yaml, and how many files their docs have."""
    parts = F.split("path", "/")
    known = files.where(F.size(parts) == 2).where(F.col("path").endswith("/project.yaml")).select(parts[0].alias("project")).distinct()
    docs = files.where((F.size(parts) > 2) & (parts[1] == "docs")).groupBy(parts[0].alias("project")).agg(F.count(F.lit(1)).alias("files"))
    return known.join(docs, "project", "left").select("project", F.coalesce("files", F.lit(0)).alias("files"))


def manifests(spark: SparkSession, root: str, schema: str, glob: str = "*.yaml") -> DataFrame:
    """path and the fields of schema of every YAML or JSON file under root; YAML by its library where that is installed, else its JSON subset."""
    import json

    from folioflow.operators.textetl import loaded_yaml

    @F.pandas_udf("string")
    def as_json(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str | None:
            try:
                return json.dumps(json.loads(t), default=str)
            except ValueError:
                got = loaded_yaml(t)
                return None if got is None else json.dumps(got, default=str)

        return texts.map(one, na_action="ignore")

    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    # the file's own metadata, since input_file_name() is asked after the Python batch and may then name a later file
    return raw.select(F.col("_metadata.file_path").alias("path"), F.from_json(as_json("value"), schema).alias("m")).select("path", "m.*")


def attachments(spark: SparkSession, root: str) -> DataFrame:
    """document (the metadata file below root) and blob_path of every attachments/*/metadata.yaml that names a blob."""
    found = manifests(spark, root, "blob_path string", "metadata.yaml")
    below = F.regexp_replace("path", "^.*?" + root.removeprefix("file:").rstrip("/").replace(".", r"\.") + "/", "")
    return found.select(below.alias("document"), "blob_path").where(F.col("document").rlike(r"(^|/)attachments/[^/]+/metadata\.yaml$") & (F.col("blob_path") != ""))


def blob_path(digest: Column, path: Column) -> Column:
    """aa/bb/digest.suffix."""
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 2), F.lit("/"), digest, F.regexp_extract(path, r"(\.[^./]+)$", 1))


def blobs(files: DataFrame) -> DataFrame:
    """Each content once, under its address."""
    h = F.sha2("content", 256)
    return files.withColumn("hash", h).dropDuplicates(["hash"]).select("hash", blob_path(F.col("hash"), F.col("path")).alias("blob"), "content")


def import_rows(incoming: DataFrame, present: DataFrame, key: str, strategy: str) -> DataFrame:
    """merge: both, the incoming first; skip: only new keys; replace: the incoming alone."""
    if strategy == "replace":
        return incoming
    fresh = incoming.join(present.select(key), key, "left_anti")
    kept = present if strategy == "skip" else present.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(fresh if strategy == "skip" else incoming)


def search_log(results: DataFrame, run_id: str) -> DataFrame:
    """Rows of the search log for results of search()."""
    return results.select(F.lit(run_id).alias("run_id"), "query_id", F.col("id").alias("chunk_id"), "final_rank", "rank_bm25", "rank_vector", "rank_terms", "fused")

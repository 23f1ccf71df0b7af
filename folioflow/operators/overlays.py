"""What people lay over documents: collections, annotations and saved searches, in stored tables, and citations resolved to the text they point at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.stored import StoredTable

#: Kinds of annotations.
ANNOTATIONS = ("comment", "highlight", "note")


class Collections:
    """Collections of projects and their members; adding twice is adding once, and a collection takes its members with it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.heads = StoredTable(spark, f"{folder}/collections", ["collection"], "collection string, project string, name string, created_at long")
        self.members = StoredTable(spark, f"{folder}/members", ["collection"], "collection string, document long, added_at long")

    def create(self) -> Collections:
        self.heads.create()
        self.members.create()
        return self

    def put(self, collections: DataFrame) -> None:
        self.heads.replace(collections)

    def add(self, members: DataFrame, documents: DataFrame) -> None:
        """members (collection, document, added_at) whose collection is there and whose document is one of its project's (documents: document, project)."""
        own = self.heads.read().join(members, "collection").join(documents.select("document", "project"), ["document", "project"], "left_semi").select("collection", "document", "added_at")
        first = lambda old, new: old.unionByName(new.select(old.columns)).groupBy("collection", "document").agg(F.min("added_at").alias("added_at"))
        self.members.fold(own, first)

    def remove(self, members: DataFrame) -> None:
        """members (collection, document) go."""
        self.members.fold(members, lambda old, gone: old.join(gone.select("collection", "document"), ["collection", "document"], "left_anti"))

    def delete(self, collections: DataFrame) -> None:
        """collections (collection) go with their members."""
        for t in (self.members, self.heads):
            t.replace(t.read().limit(0), collections)

    def listed(self) -> DataFrame:
        """collection, project, name, created_at, members: how many, 0 too."""
        n = self.members.read().groupBy("collection").agg(F.count(F.lit(1)).alias("members"))
        return self.heads.read().join(n, "collection", "left").withColumn("members", F.coalesce("members", F.lit(0).cast("long")))

    def of(self, documents: DataFrame) -> DataFrame:
        """document, collection, name: the collections that documents (document) are in."""
        return self.members.read().join(documents.select("document"), "document", "left_semi").join(self.heads.read(), "collection").select("document", "collection", "name")


def annotated(annotations: DataFrame, versions: DataFrame) -> DataFrame:
    """annotations (annotation, version, kind, content, start, stop, created_at) with error: unknown kind, unknown version, or an empty or negative span."""
    known = versions.select("version").distinct().withColumn("_known", F.lit(True))
    bad = F.col("start").isNotNull() & ((F.col("start") < 0) | ~F.coalesce(F.col("stop") > F.col("start"), F.lit(False)))
    error = F.when(~F.coalesce(F.col("kind").isin(*ANNOTATIONS), F.lit(False)), "unknown kind").when(F.col("_known").isNull(), "unknown version").when(bad, "span is empty")
    return annotations.join(known, "version", "left").withColumn("error", error).drop("_known")


def resolved(refs: DataFrame, texts: DataFrame, boundary: str = "[{}]\n{}\n[end]") -> DataFrame:
    """ref_id, content, error of citations (ref_id, project, path, version, first, last) in texts (project, path, version, text).

    content is the lines first to last, both in and from 1, between boundaries that name the project; a null line is the text's first or last. A project
    or a version that isn't there is an error, and so is a line before the first.
    """
    projects = texts.select("project").distinct().withColumn("_there", F.lit(True))
    found = refs.join(projects, "project", "left").join(texts.select("project", "path", "version", F.col("text").alias("_text")), ["project", "path", "version"], "left")
    lines = F.split("_text", "\n")
    first, last = F.coalesce("first", F.lit(1)), F.least(F.coalesce("last", F.size(lines)), F.size(lines))
    error = F.when(F.col("_there").isNull(), F.concat(F.lit("project "), F.col("project"), F.lit(" not found"))).when(F.col("_text").isNull(), "source not found").when((first < 1) | (last < first), "no such lines")
    before, rest = boundary.split("{}", 1)
    between, after = rest.split("{}", 1)
    content = F.concat(F.lit(before), "project", F.lit(between), F.array_join(F.slice(lines, first, last - first + 1), "\n"), F.lit(after))
    return found.withColumn("error", error).select("ref_id", F.when(F.col("error").isNull(), content).alias("content"), "error")

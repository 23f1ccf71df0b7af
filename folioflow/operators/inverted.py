"""A stored inverted index: postings and document frequencies by bucket of tokens, lengths by part of ids, kept up by deltas.

    index = InvertedIndex(spark, folder).build(docs)
    index.update(changed, deleted)

A query reads the buckets of its tokens only. An update rewrites the buckets in which changed documents have or had tokens, and leaves the rest as it is:
new rows are written beside the table first, then replace the partitions they belong to (dynamic partition overwrite). Lengths go last and say where a
document's old tokens are, so an update that was cut short is made good by running it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.session import cut

BUCKETS, PARTS, SPREAD = 32, 8, 4
POSTINGS = "token string, id long, tf long, dl long, bucket int"
TERMS = "token string, df long, bucket int"
LENGTHS = "id long, dl long, buckets array<int>, part int"


def counted(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """id, token, tf, dl; null and empty texts have none, nor have rows with a null id; the tokens of repeated ids are one document's."""
    # texts are dealt by id once; counting tokens and adding up a document's need no other shuffle
    t = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).repartition("id")
    counts = t.select("id", F.explode(X.tokens(F.col("t"))).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
    return counts.withColumn("dl", F.sum("tf").over(Window.partitionBy("id")))


class InvertedIndex:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, parts: int = PARTS, spread: int = SPREAD):
        """spread: tasks, and files, that the postings of one bucket are dealt over, so that a stop word isn't one task's."""
        self.spark, self.folder, self.buckets, self.parts, self.spread = spark, folder.rstrip("/"), buckets, parts, spread

    def bucket(self, token: str = "token") -> F.Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    @property
    def postings(self) -> DataFrame:
        return self._read("postings", POSTINGS).where("token is not null")

    @property
    def terms(self) -> DataFrame:
        """token, df, bucket."""
        return self._read("terms", TERMS).where("token is not null")

    @property
    def lengths(self) -> DataFrame:
        """id, dl and the buckets that hold the document's tokens."""
        return self._read("lengths", LENGTHS).where("id is not null")

    def _write(self, name: str, rows: DataFrame, by: str, *spread) -> None:
        rows.repartition(by, *spread).write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.folder}/{name}")

    def _put(self, postings: DataFrame, lengths: DataFrame, touched: DataFrame, parts: DataFrame) -> None:
        """Replaces the touched buckets and parts by tables that are written already. Each gets a row without a token or id, so that one that is empty
        now is replaced, too."""
        self._write("postings", postings.select("token", "id", "tf", "dl", "bucket").unionByName(touched.select("bucket"), allowMissingColumns=True), "bucket", F.pmod(F.xxhash64("id"), F.lit(self.spread)))
        counts = postings.groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("df")).select("token", "df", "bucket")
        self._write("terms", counts.unionByName(touched.select("bucket"), allowMissingColumns=True), "bucket")
        self._write("lengths", lengths.unionByName(parts.select("part"), allowMissingColumns=True), "part")

    def _made(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = cut(counted(docs).withColumn("bucket", self.bucket()))
        lengths = rows.groupBy("id").agg(F.max("dl").alias("dl"), F.sort_array(F.collect_set("bucket")).alias("buckets"))
        return rows, lengths.withColumn("part", self._part())

    def _part(self) -> F.Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int")

    def build(self, docs: DataFrame) -> InvertedIndex:
        """The index of docs (id, text), instead of what the folder holds. Rows with a null id take no part; repeated ids are one document."""
        rows, lengths = self._made(docs)
        every = lambda n, c: self.spark.range(n).select(F.col("id").cast("int").alias(c))
        self._put(rows, lengths, every(self.buckets, "bucket"), every(self.parts, "part"))
        return self

    def update(self, changed: DataFrame, deleted: DataFrame | None = None) -> InvertedIndex:
        """changed (id, text) are new or have a new text, deleted (id) leave; the result is that of building anew. An id in both is changed."""
        ids = changed.select(F.col("id").cast("long").alias("id"))
        ids = cut((ids if deleted is None else ids.union(deleted.select(F.col("id").cast("long")))).where("id is not null").distinct().withColumn("part", self._part()))
        rows, lengths = self._made(changed)
        parts = ids.select("part").distinct()
        # what is asked of the stored tables goes by their partitions: at most buckets and parts numbers come to the driver
        own = [r.part for r in parts.collect()]
        old = self.lengths.where(F.col("part").isin(own))
        before = old.join(ids.select("id"), "id", "left_semi").select(F.explode("buckets").alias("bucket"))
        touched = [r.bucket for r in before.union(rows.select("bucket")).distinct().collect()]
        kept = self.postings.where(F.col("bucket").isin(touched)).join(ids.select("id"), "id", "left_anti")
        stays = old.join(ids.select("id"), "id", "left_anti")
        self._put(cut(kept.unionByName(rows)), cut(stays.unionByName(lengths)), self._numbers(touched, "bucket"), self._numbers(own, "part"))
        return self

    def _numbers(self, values: list[int], name: str) -> DataFrame:
        return self.spark.createDataFrame([(v,) for v in values], f"{name} int")

    def of(self, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings and terms of the buckets that tokens (token) are in; other partitions aren't listed or read."""
        wanted = [r.b for r in tokens.select(self.bucket().alias("b")).distinct().collect()]
        return self.postings.where(F.col("bucket").isin(wanted)), self.terms.where(F.col("bucket").isin(wanted))

    def statistics(self) -> DataFrame:
        """One row: n documents with tokens, and their mean length."""
        return self.lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))

"""From raw documents to token shards, in five stages that each work on all their predecessor kept.

The first four return the columns of documents; the last returns what it reads back from the token shards. Every stage takes null ids, null, blank and
very long texts, repeated rows and an empty table; columns with names that an operator uses itself stay as they are in the first three stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, minhash, mixing, quality, sstable
from folioflow.session import cut, fresh, importable, quoted


def _own(docs: DataFrame) -> list:
    """The columns of docs, whatever their names."""
    return [F.col(quoted(c)) for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labels of these documents, takes for good.

    Each row is judged by its text alone, so repeated rows share their fate, and null and blank texts have a score too.
    """
    known = quality.Classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh("score", docs)
    return known.score(docs, name=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies (shingles of five words, similarity 0.8).

    Of rows that share an id the one that was linked stays; rows with a null id stay.
    """
    kept = minhash.link(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    first, n = Window.partitionBy("doc_id").orderBy(minhash.standing("text"), F.xxhash64(*_own(docs))), fresh("n", docs)
    one = docs.join(kept, "doc_id", "left_semi").withColumn(n, F.row_number().over(first)).where(F.col(n) == 1)
    return one.select(_own(docs)).unionByName(docs.where("doc_id is null"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; documents that are nothing else go.

    Each row is judged by its text alone; null and blank texts are unchanged, and so is n_chars where the text is null.
    """
    clean = decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(_own(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one taken in part counts if that is half of it at least.

    Documents without words are taken 0 times, so they go; a null source is a source of its own. Rows alike in id and text share their fate. Columns
    that mix() adds are replaced.
    """
    got = mixing.mix(docs, F.array("source"))
    times = F.col("_times") + ((F.col("_part") > 0) & (2 * F.col("_part") >= F.col("_size"))).cast("long")
    return got.select("*", F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias(fresh("k", got))).select(_own(docs))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, from its token shard; null ids come first, repeated rows one after the other."""
    return sstable.tokens(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("source mixing", mix_sources),
    ("token output", write_tokens),
]

#: Trained models, seeded choices and a byte-pair encoder cannot be told in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs

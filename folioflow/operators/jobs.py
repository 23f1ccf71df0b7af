"""The ingestion jobs: which ones a finished job asks for, and what is still to queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The job after which each kind follows, its priority, and what it needs (a file of a schema kind, a model).
FOLLOWS = [
    ("extract", "chunk", 1, None),
    ("extract", "extract_candidates", 3, None),
    ("extract", "ner_gliner", 3, "ner"),
    ("extract", "link_detect", 3, None),
    ("extract", "schema_parse", 3, "schema"),
    ("extract", "extract_candidates_llm", 4, "llm"),
    ("chunk", "technical_terms", 1, None),
    ("chunk", "embed", 2, None),
    ("ner_gliner", "relate_llm", 4, "llm"),
]
SCHEMA_SUFFIXES = ("sql", "prisma", "yaml", "yml", "json")


def job_key(*cols) -> Column:
    """The idempotency key: equal work has equal keys."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)


def fan_out(done: DataFrame, models: tuple = ("ner", "llm")) -> DataFrame:
    """Jobs that follow the completed ones of done (project, version, path, content_hash, job_type, text_kind), each once by its key.

    An extraction without text asks for nothing; schema parsing needs a schema file, model jobs need their model among models.
    """
    rows = [(a, b, p, need) for a, b, p, need in FOLLOWS if need in (None, "schema", *models)]
    rules = done.sparkSession.createDataFrame(rows, "job_type string, next string, priority int, need string")
    schema = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SCHEMA_SUFFIXES)
    live = done.where((F.col("job_type") != "extract") | (F.coalesce("text_kind", F.lit("unsupported")) != "unsupported"))
    found = live.join(F.broadcast(rules), "job_type").where(F.coalesce(F.col("need") != "schema", F.lit(True)) | schema)
    jobs = found.select("project", "version", F.col("next").alias("job_type"), "content_hash", "priority", F.lit("queued").alias("status"))
    return jobs.withColumn("key", job_key("project", "version", "job_type", "content_hash")).dropDuplicates(["key"])


def to_queue(jobs: DataFrame, known: DataFrame) -> DataFrame:
    """Those whose key no known job has."""
    return jobs.join(known.select("key").distinct(), "key", "left_anti")


def reachable(first: str = "extract", models: tuple = ("ner", "llm")) -> list[str]:
    """All kinds of jobs that a first one leads to, in order of their follow-up."""
    out = [first]
    for kind in out:
        out += [b for a, b, _, need in FOLLOWS if a == kind and b not in out and need in (None, "schema", *models)]
    return out

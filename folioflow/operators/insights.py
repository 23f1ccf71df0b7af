"""Detectors: contradictions, stale documents, broken links, aged questions, and the run that joins them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import age_days


def conflicts(values: DataFrame, keys: list[str], value: str, doc: str) -> DataFrame:
    """Keys with more than one distinct value: the values, sorted, and how many documents state one. evidence() has the documents."""
    real = values.where(F.col(value).isNotNull() & (F.col(value) != ""))
    docs = real.select(*keys, doc).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_documents"))
    found = real.select(*keys, value).distinct().groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("values")).where(F.size("values") > 1)
    title = F.concat(F.lit("Conflicting values for "), F.concat_ws(".", *keys), F.lit(": "), F.array_join("values", ", "))
    return found.join(docs, keys).withColumn("title", title)


def evidence(values: DataFrame, keys: list[str], value: str, doc: str) -> DataFrame:
    """keys, value, doc, a row for each document of each value of the keys in conflict; a key that most documents have stays spread out."""
    real = values.where(F.col(value).isNotNull() & (F.col(value) != "")).select(*keys, value, doc).distinct()
    span = real.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).where("_lo < _hi")
    return real.join(span.select(*keys), keys, "left_semi")


def aged(rows: DataFrame, at: str, now, days: int, first: str, then: str, at_days: int) -> DataFrame:
    """Rows older than days, with severity first, from at_days on then."""
    age = age_days(F.lit(now), F.col(at))
    return rows.withColumn("age_days", age).where(F.col("age_days") > days).withColumn("severity", F.when(F.col("age_days") < at_days, first).otherwise(then))


def new_insights(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose title isn't known, each title once (the one of the least detail)."""
    fresh = candidates.join(known.select("title").distinct(), "title", "left_anti")
    return fresh.groupBy("title").agg(F.min_by("kind", F.struct("kind", "severity")).alias("kind"), F.min_by("severity", F.struct("kind", "severity")).alias("severity"))

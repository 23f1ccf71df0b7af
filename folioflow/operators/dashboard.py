"""Dashboard folds: pivots, conditional counts, status folds, flush summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("queued", "running", "completed", "failed", "skipped")


def pivoted(jobs: DataFrame, by: str, status: str = "status", names=STATUSES) -> DataFrame:
    """A column a status, 0 where there is none, and the total: one aggregate, no pivot job."""
    return jobs.groupBy(by).agg(*[F.count_if(F.col(status) == n).alias(n) for n in names], F.count(F.lit(1)).alias("total"))


def status_fold(found: Column) -> Column:
    """One status of a set of job statuses; null or empty is pending."""
    has = lambda *names: F.arrays_overlap(found, F.array(*[F.lit(n) for n in names]))
    rest = F.size(F.array_except(found, F.array(F.lit("completed"), F.lit("skipped"))))
    return F.when(found.isNull() | (F.size(found) == 0), "pending").when(has("failed"), "failed").when(has("queued", "running"), "processing").when(rest == 0, "indexed").otherwise("pending")


def counters(rows: DataFrame, by: str, reason: str) -> DataFrame:
    """A map of reason to count for each key, entries in order of reason."""
    n = rows.groupBy(by, reason).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(reason, "_n")))).alias("counts"))


def flush_summary(deltas: DataFrame, by: str, seq: str, kind: str, value: str, n: int = 10) -> DataFrame:
    """Counts and the first n distinct values of each kind in the order first seen."""
    first = deltas.groupBy(by, kind, value).agg(F.min(seq).alias("_s"), F.count(F.lit(1)).alias("_n"))
    seen = first.withColumn("_r", F.row_number().over(Window.partitionBy(by, kind).orderBy("_s", value)))
    # only the first n are gathered
    few = F.array_sort(F.collect_list(F.when(F.col("_r") <= n, F.struct("_r", F.col(value).alias("v")))))
    return seen.groupBy(by, kind).agg(F.sum("_n").alias("n"), F.transform(few, lambda x: x.v).alias("values"))

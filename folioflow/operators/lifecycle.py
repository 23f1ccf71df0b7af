"""Sessions told from their events: status, what is dirty, preflights and flushes, and which attempts to end them are blocked; all by running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of events: each delta is dirty until the next flush; a preflight says its action and a delta its type in detail.
KINDS = ("start", "preflight", "delta", "flush", "finalize")


def judged(events: DataFrame, blocking: bool = True) -> DataFrame:
    """events (session, at, seq, kind, detail) with flushes before them, unflushed deltas up to them, and ended: a finalize took effect before.

    A finalize takes effect unless it finds deltas that aren't flushed and blocking is on; then it is blocked. What comes after the end counts no more.
    """
    order = Window.partitionBy("session").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("session").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.where(F.col("kind").isin(*KINDS)).withColumn("_flushes", F.count_if(F.col("kind") == "flush").over(order))
    span = Window.partitionBy("session", "_flushes").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("unflushed", F.count_if(F.col("kind") == "delta").over(span))
    ends = (F.col("kind") == "finalize") & ((F.col("unflushed") == 0) | F.lit(not blocking))
    return rows.withColumn("ends", ends).withColumn("ended", F.coalesce(F.max(ends).over(before), F.lit(False)))


def status(events: DataFrame, blocking: bool = True) -> DataFrame:
    """session, status, enforced, is_dirty, unflushed, dirty_reasons (type to number, of unflushed deltas), last_preflight_at, last_preflight_action,
    last_flush_at, started_at, ended_at, blocked (attempts to end it that were).

    Sessions without a start event are left out, as nobody opened them.
    """
    live = judged(events, blocking).where("not ended")
    newest = F.struct("at", "seq")
    is_ = lambda kind: F.col("kind") == kind
    last = live.groupBy("session").agg(F.max("_flushes").alias("_flushes"))
    dirty = live.where(is_("delta")).join(last, ["session", "_flushes"], "left_semi").groupBy("session", F.coalesce("detail", F.lit("other")).alias("detail")).agg(F.count(F.lit(1)).alias("n"))
    reasons = dirty.groupBy("session").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("detail", "n")))).alias("dirty_reasons"), F.sum("n").alias("unflushed"))
    told = live.groupBy("session").agg(
        F.min(F.when(is_("start"), F.col("at"))).alias("started_at"),
        F.max(F.when(is_("preflight"), F.col("at"))).alias("last_preflight_at"),
        F.max_by(F.when(is_("preflight"), F.col("detail")), F.when(is_("preflight"), newest)).alias("last_preflight_action"),
        F.max(F.when(is_("flush"), F.col("at"))).alias("last_flush_at"),
        F.min(F.when(F.col("ends"), F.col("at"))).alias("ended_at"),
        F.count_if(is_("finalize") & ~F.col("ends")).alias("blocked"),
    )
    both = told.where("started_at is not null").join(reasons, "session", "left")
    n = F.coalesce("unflushed", F.lit(0).cast("long"))
    return both.select("session", F.when(F.col("ended_at").isNotNull(), "finalized").otherwise("active").alias("status"), F.lit("blocking" if blocking else "advisory").alias("enforced"), (n > 0).alias("is_dirty"), n.alias("unflushed"), "dirty_reasons", "last_preflight_at", "last_preflight_action", "last_flush_at", "started_at", "ended_at", "blocked")

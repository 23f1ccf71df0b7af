"""Requirements and open questions of texts, as rows: all patterns' spans are put in one order, and the rules are windows over it.

A code fence is a span like others, so whether a line stands inside one is the parity of the fences before it; that a line was taken by a surer pattern, or
a wording was there before, are windows over the same place or wording.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators.textetl import spans_of

# The patterns of requirements and questions, with their confidences.
NUMBERED = r"^(REQ-\d+|US-\d+)[:\s]+(.+)$"
MODAL = r"^(.{0,20}(?:shall|must|should|will)\s+.{10,200})$"
MARKED = r"^([^#`\n].{10,300}\?)\s*$"
NOTED = r"^(?:TODO|TBD|OPEN QUESTION|QUESTION)[:\s]+(.{5,300})$"
# How a line that isn't a requirement begins, and what is left off a question.
ASKING = r"(?i)^(open question:|question:|todo:|tbd:)"
LABEL = r"(?i)^(?:open\s+question|question)[:\s]+"

FENCE = [("fence", "```", 0, 1.0)]
LINE = [("line", r"[^\n]+", 0, 1.0)]


def priority(title: Column) -> Column:
    low = F.lower(title)
    return F.when(low.rlike("must|shall"), "must").when(low.contains("should"), "should").when(low.rlike("could|may"), "could")


def _spans(texts: DataFrame, key: str, text: str, *patterns: list) -> DataFrame:
    """key, text number _t, kind, raw, start, stop, confidence and whether it is fenced. Patterns of one list share no span, those of several may."""
    own = texts.select(key, F.xxhash64(text).alias("_t"), F.concat(*[spans_of(p, False)(F.col(text)) for p in (*patterns, FENCE)]).alias("_s")).dropDuplicates([key, "_t"])
    before = Window.partitionBy(key, "_t").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    rows = own.select(key, "_t", F.inline("_s"))
    return rows.withColumn("fenced", F.coalesce(F.count_if(F.col("kind") == "fence").over(before) % 2 == 1, F.lit(False)))


def _first(rows: DataFrame, key: str, wording: str, rank: Column) -> DataFrame:
    """Of equal wordings in a text the one of the least rank, then the earliest."""
    w = Window.partitionBy(key, "_t", wording).orderBy(rank, "start")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def requirements(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, requirement_id, title, priority, method, confidence, start, stop.

    Numbered lines come first, wherever they stand; then lines with a modal verb outside code fences that are no questions. A title counts once in a
    text. Null and empty texts have none; repeated rows have theirs once.
    """
    spans = _spans(texts, key, text, [("numbered", NUMBERED, re.M, 1.0)], [("modal", MODAL, re.M | re.I, 0.8)])
    numbered, place = F.col("kind") == "numbered", Window.partitionBy(key, "_t", "start")
    title = F.when(numbered, X.strip(F.regexp_extract("raw", r"^(REQ-\d+|US-\d+)[:\s]+([^\n]+)", 2))).otherwise(X.strip(F.col("raw")))
    told = spans.where("kind in ('numbered', 'modal')").withColumn("title", title)
    ids = _first(told.where(numbered), key, "title", F.lit(0))
    asks = F.col("title").endswith("?") | F.col("title").rlike(ASKING)
    both = ids.unionByName(told.where(~numbered & ~asks & ~F.col("fenced")))
    left = both.withColumn("_taken", F.max(numbered.cast("int")).over(place)).where(numbered | (F.col("_taken") == 0))
    kept = _first(left, key, "title", F.when(numbered, 0).otherwise(1))
    return kept.select(key, F.when(numbered, F.regexp_extract("raw", r"^(REQ-\d+|US-\d+)", 1)).alias("requirement_id"), "title", priority(F.col("title")).alias("priority"), F.when(numbered, "regex_req_id").otherwise("regex_shall_must").alias("method"), "confidence", "start", "stop")


def questions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, question, context (the line before, of marked ones), method, confidence, start, stop.

    Lines that end with a question mark come first, then those that begin with a marker; neither in code fences. A question counts once in a text,
    whatever its label. Null and empty texts have none; repeated rows have theirs once.
    """
    spans = _spans(texts, key, text, [("marked", MARKED, re.M, 0.7)], [("noted", NOTED, re.M | re.I, 0.9)], LINE)
    earlier = Window.partitionBy(key, "_t").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    placed = spans.withColumn("_above", F.last(F.when(F.col("kind") == "line", F.col("raw")), ignorenulls=True).over(earlier))
    marked = F.col("kind") == "marked"
    bare = F.when(marked, F.col("raw")).otherwise(F.regexp_replace("raw", r"(?i)^(?:TODO|TBD|OPEN QUESTION|QUESTION)[:\s]+", ""))
    told = placed.where(F.col("kind").isin("marked", "noted") & ~F.col("fenced")).withColumn("question", X.strip(F.regexp_replace(X.strip(bare), LABEL, "")))
    kept = _first(told, key, "question", F.when(marked, 0).otherwise(1))
    context = F.when(marked, F.nullif(X.strip(F.col("_above")), F.lit("")))
    return kept.select(key, "question", context.alias("context"), F.when(marked, "regex_question_mark").otherwise("regex_todo_marker").alias("method"), "confidence", "start", "stop")

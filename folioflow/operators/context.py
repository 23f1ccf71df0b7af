"""Project context within a budget: documents first, then the sections behind them, each greedily from what is left."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import textetl as T
from folioflow.operators.textetl import greedy_fit, left_over
from folioflow.session import fields, importable, in_runs


def words(c) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\S+"))


def section(rows: DataFrame, order: list, limit: int, size: Column, name: str) -> DataFrame:
    """project and the first limit rows of it by order, as an array<struct<size, id, text>>; the limit is the section's own."""
    w = Window.partitionBy("project").orderBy(*order)
    first = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    items = F.array_sort(F.collect_list(F.struct("_r", size.cast("long").alias("size"), "id", "text")))
    return first.groupBy("project").agg(F.transform(items, lambda x: F.struct(x["size"].alias("size"), x["id"].alias("id"), x["text"].alias("text"))).alias(name))


def fitted(documents: DataFrame, decisions: DataFrame, budget: int, limit: int, size=words) -> DataFrame:
    """project, documents, decisions (arrays of what fits) and left_over of every project with a document or a decision.

    documents (project, id, text) come newest, that is with the largest id, first; decisions in order of their id. size counts a text; a document that does
    not fit is passed over, and the next one may. Rows without a project have no context.
    """
    a = section(documents.where("project is not null"), [F.desc("id")], limit, size(F.col("text")), "d")
    b = section(decisions.where("project is not null"), ["id"], limit, size(F.col("text")), "q")
    both = a.join(b, "project", "full")
    got = both.withColumn("documents", greedy_fit(F.col("d"), budget)).withColumn("_left", left_over(F.col("d"), F.coalesce("documents", F.array()), budget))
    got = got.withColumn("decisions", greedy_fit(F.col("q"), F.col("_left")))
    return got.select("project", "documents", "decisions", left_over(F.col("q"), F.coalesce("decisions", F.array()), F.col("_left")).alias("left_over"))


def build(documents: DataFrame, decisions: DataFrame, budget: int, limit: int) -> DataFrame:
    """How many documents and decisions of every project fit, and what is left of the budget."""
    got = fitted(documents, decisions, budget, limit)
    count = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long").alias(c)
    return got.select("project", count("documents"), count("decisions"), "left_over")


SECTIONS = ("documents", "decisions", "requirements", "open_questions")
DETAILS = ("brief", "standard", "full")
#: A whole text is cut to what is left less MARGIN where more than ENOUGH is left.
ENOUGH, MARGIN = 100, 50


def _packed(limit: int | None, full: bool):
    """Rows come by project, section and place; what fits stays, with the tokens of its body that are kept. One number is held for a project."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, section, left, n, stop = None, None, 0, 0, False
        for batch in batches:
            keep, kept, rest = [], [], []
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("project", "_section", "_budget", "_base", "_body")]
            for i, (g, s, budget, base, body) in enumerate(zip(*cols, strict=True)):
                if g != project:
                    project, section, left = g, None, budget
                if s != section:
                    section, n, stop = s, 0, False
                if stop or limit is not None and n >= limit:
                    continue
                n += s > 0  # of documents those that are taken count, of records those that are seen
                if base + body > left and full and s == 0 and left > ENOUGH:
                    body = min(body, max(left - MARGIN, 0))
                if base + body > left:
                    continue
                n += s == 0
                left -= base + body
                stop = left <= 0
                keep.append(i)
                kept.append(body)
                rest.append(left)
            out = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(kept, pa.int64()), pa.array(rest, pa.int64())], names=[*out.schema.names, "_kept", "left_over"])

    return run


def context(projects: DataFrame, documents: DataFrame, records: DataFrame, detail: str = "standard", budget: int = 8000, since=None, limit: int | None = None, size=words) -> DataFrame:
    """Rows of each project's context: project, section, place, id, title, doc_type, summary, content, tokens, left_over.

    projects (project, info) say what a project is; that comes off its budget first. documents (project, id, title, doc_type, text, modified) come newest first,
    ties by id, and only those modified since a time if one is given; brief has their title and type, standard their summary, too, and full the whole text
    without front matter, cut where it doesn't fit and more than ENOUGH tokens are left. records (project, section, id, text) follow by section in order of their id. What doesn't
    fit is passed over. limit is the documents taken and the records looked at in each section. size counts tokens. Rows of no known project have no context.
    """
    if detail not in DETAILS:
        raise ValueError(f"detail must be one of {', '.join(DETAILS)}")
    importable(projects.sparkSession)
    none = F.lit(None).cast("string")
    docs = documents if since is None else documents.where(F.col("modified") >= since)
    body = X.strip(T.without_front_matter(F.col("text")))
    short = F.coalesce(X.summary(body), F.lit(""))
    told = docs.select("project", F.lit(0).alias("_section"), (-F.col("modified").cast("long")).alias("_at"), F.col("id").cast("string").alias("id"), F.col("id").alias("_id"), "title", "doc_type", (short if detail != "brief" else none).alias("summary"), (body if detail == "full" else none).alias("content"))
    place = F.array_position(F.array(*[F.lit(x) for x in SECTIONS]), F.col("section")).cast("int") - 1
    said = records.where(F.col("section").isin(*SECTIONS[1:])).select("project", place.alias("_section"), F.lit(0).cast("long").alias("_at"), F.col("id").cast("string").alias("id"), F.col("id").alias("_id"), none.alias("title"), none.alias("doc_type"), none.alias("summary"), F.col("text").alias("content"))
    count = lambda *cols: sum((size(F.col(c)) for c in cols[1:]), size(F.col(cols[0]))).cast("long")
    rows = told.unionByName(said).withColumn("_base", F.when(F.col("_section") == 0, count("id", "title", "doc_type", "summary")).otherwise(count("content")))
    rows = rows.withColumn("_body", F.when(F.col("_section") == 0, count("content")).otherwise(F.lit(0).cast("long")))
    own = rows.join(projects.select("project", (F.lit(budget) - size(F.col("info"))).cast("long").alias("_budget")), "project")
    dealt = in_runs(own, ["project"], "_section", "_at", "_id").drop("_id")
    got = dealt.mapInArrow(_packed(limit, detail == "full"), f"{fields(dealt)}, _kept long, left_over long")
    cut_to = F.when(F.col("_section") > 0, F.col("content")).when(F.col("_kept") < F.col("_body"), F.array_join(F.slice(F.regexp_extract_all("content", F.lit(r"\s*\S+"), F.lit(0)), F.lit(1), F.col("_kept").cast("int")), "")).otherwise(F.col("content"))
    names = F.element_at(F.array(*[F.lit(x) for x in SECTIONS]), F.col("_section") + 1)
    order = Window.partitionBy("project", "_section").orderBy(F.desc("left_over"))
    return got.select("project", names.alias("section"), F.row_number().over(order).alias("place"), "id", "title", "doc_type", "summary", cut_to.alias("content"), (F.col("_base") + F.col("_kept")).alias("tokens"), "left_over")

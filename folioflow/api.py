"""The library's entry points: a corpus, searches over it, history, evaluation and context, as functions that return DataFrames.

    corpus = Corpus(docs, heads=..., vectors=..., terms=...)
    hits = search(corpus, SearchRequest("how are backups made", project="infra", version_scope="current"))
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import UTC, datetime
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import context, graph, history, insights, retrieval
from folioflow.operators import textetl as T

# The modes, fields and limits of a search request.
MODES = ("find_docs", "ask_question", "find_decisions", "search_history", "compare_over_time")


@dataclass(frozen=True)
class SearchRequest:
    query: str
    project: str | None = None
    version_scope: str = "current"
    limit: int = 20
    mode: str = "find_docs"
    answer_mode: bool = False

    def validated(self) -> SearchRequest:
        """The request with its scope in plain form; ValueError names what is wrong."""
        if not 1 <= len(self.query) <= 500:
            raise ValueError("query must have 1 to 500 characters")
        if not 1 <= self.limit <= 100:
            raise ValueError("limit must be from 1 to 100")
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        kind, _, value = self.version_scope.partition(":")
        if self.version_scope in ("current", "all"):
            return self
        value = value.strip()
        if kind == "as_of":
            try:
                at = datetime.fromisoformat(value.replace("Z", "+00:00"))
            except ValueError:
                raise ValueError("as_of needs an ISO-8601 time") from None
            if at.tzinfo is None:
                raise ValueError("as_of needs a time with a zone")
            return replace(self, version_scope=f"as_of:{at.isoformat()}")
        if kind in ("snapshot", "branch") and value:
            return replace(self, version_scope=f"{kind}:{value}")
        raise ValueError("version_scope must be current, all, as_of:<time>, snapshot:<name> or branch:<name>")


@dataclass(frozen=True)
class Corpus:
    """docs (id, text, project, doc_type, status; version_id where versions are kept), vectors (id, v), terms (id, term), heads (head events of versions)
    and members (snapshot, version_id). What is left out gives no signal or scope.
    """

    docs: DataFrame
    vectors: DataFrame | None = None
    terms: DataFrame | None = None
    heads: DataFrame | None = None
    members: DataFrame | None = None

    @cached_property
    def index(self) -> retrieval.InvertedIndex:
        """The stored index of all documents, built once; update() keeps it up with changes."""
        return retrieval.indexed(self.docs)

    @cached_property
    def technical_terms(self) -> DataFrame:
        if self.terms is not None:
            return self.terms
        found = self.docs.select("id", F.inline(T.terms(F.col("text"))))
        return found.select("id", T.normalised_term(F.col("kind"), F.col("raw")).alias("term"))


def scope_of(corpus: Corpus, request: SearchRequest) -> DataFrame | None:
    """Ids that a request may find: of its project, not deleted, and of the versions of its scope; None for all."""
    kind, _, value = request.version_scope.partition(":")
    docs = corpus.docs
    if request.project is not None:
        docs = docs.where(F.col("project") == request.project)
    if kind in ("current", "all"):
        docs = docs.where(F.col("status") != "deleted") if "status" in docs.columns else docs
    if kind == "all" or corpus.heads is None:
        if kind not in ("all", "current"):
            raise ValueError(f"the corpus has no versions for scope {request.version_scope}")
        return docs.select("id")
    if kind == "snapshot":
        if corpus.members is None:
            raise ValueError("the corpus has no snapshots")
        return docs.join(corpus.members.where(F.col("snapshot") == value).select("version_id"), "version_id", "left_semi").select("id")
    at = int(datetime.fromisoformat(value).astimezone(UTC).timestamp() * 1_000_000) if kind == "as_of" else value or None
    return docs.join(history.scope(corpus.heads, kind, at).select("version_id"), "version_id", "left_semi").select("id")


def _frames(corpus: Corpus, request: SearchRequest, embed: Callable[[str], list[float]] | None):
    spark = corpus.docs.sparkSession
    asked = spark.createDataFrame([(0, request.query, request.project, request.version_scope)], "query_id long, query string, project string, version_scope string")
    one = retrieval.parsed(asked)
    tokens = one.select("query_id", F.explode("tokens").alias("token"))
    terms = one.select("query_id", F.explode("terms").alias("x")).select("query_id", F.col("x.term").alias("term")).distinct()
    vector = spark.createDataFrame([(0, [float(x) for x in embed(request.query)])] if embed else [], "query_id long, q array<double>")
    return tokens, vector, terms


def _no_vectors(spark) -> DataFrame:
    return spark.createDataFrame([], "id long, v array<double>")


def search(corpus: Corpus, request: SearchRequest, embed: Callable[[str], list[float]] | None = None, cap: int | None = 3) -> DataFrame:
    """Hits of a request in order of final_rank: id, the document's columns, fused score and the three ranks, snippet and signals.

    embed gives the query's vector; without it, or without vectors, words and technical terms decide.
    """
    request = request.validated()
    tokens, vector, terms = _frames(corpus, request, embed)
    vectors = corpus.vectors if corpus.vectors is not None else _no_vectors(corpus.docs.sparkSession)
    got = retrieval.search(corpus.index, vectors, corpus.technical_terms, corpus.docs, tokens, vector, terms, scope_of(corpus, request), cap=cap, limit=request.limit)
    return got.withColumn("snippet", X.snippet(F.col("text"))).withColumn("signals", X.signals("rank_bm25", "rank_vector", "rank_terms"))


def search_phases(corpus: Corpus, request: SearchRequest, embed=None, rerank: Callable[[str, DataFrame], DataFrame] | None = None, first: int = 20) -> Iterator[tuple[str, DataFrame]]:
    """Quick words first, then the hybrid order, then (with rerank, which scores query_id, id, text) the first ones anew."""
    request = request.validated()
    tokens, _, _ = _frames(corpus, request, None)
    lexical = retrieval.top(retrieval.bm25(corpus.index, tokens, scope_of(corpus, request)).withColumn("score", F.round("score", 6)), retrieval.CANDIDATES)
    yield "lexical", retrieval.capped(lexical.withColumn("fused", F.round(1.0 / (retrieval.RRF_K + F.col("rank")), 9)).join(corpus.docs, "id"), "project", 3, request.limit)
    hybrid = search(corpus, request, embed)
    yield "hybrid", hybrid
    if rerank is not None:
        head = hybrid.where(F.col("final_rank") <= first)
        yield "reranked", retrieval.reranked(hybrid, rerank(request.query, head.select("query_id", "id", "text")), first)


def facets(hits: DataFrame, terms: DataFrame | None = None) -> dict[str, DataFrame]:
    """Counts of document types, projects and, with terms (id, term), of what the hits mention."""
    out = {"doc_type": retrieval.facets(hits, "doc_type"), "project": retrieval.facets(hits, "project")}
    if terms is not None:
        out["term"] = retrieval.facets(hits.select("query_id", "id").join(terms.select("id", "term").distinct(), "id"), "term")
    return out


def versions(heads: DataFrame, document, branch: str | None = None) -> DataFrame:
    """Saves of a document, newest first, with how long each was the head."""
    own = heads.where((F.col("document_id") == document) & (F.col("event_type") == "save"))
    own = own if branch is None else own.where(F.col("branch") == branch)
    return own.orderBy(F.desc("valid_from"), F.desc("version_id"))


def diff(texts: DataFrame, old, new) -> DataFrame:
    """The unified diff of two versions (version_id, text), with lines added and removed."""
    a = texts.where(F.col("version_id") == old).select(F.col("text").alias("a"))
    b = texts.where(F.col("version_id") == new).select(F.col("text").alias("b"))
    return a.crossJoin(b).select(F.inline(F.array(T.unified_diff(F.col("a"), F.col("b")))))  # one row with one


def restore(heads: DataFrame, document, version, at: int) -> DataFrame:
    """heads with a save of an old version as the newest one of its branch."""
    old = heads.where((F.col("document_id") == document) & (F.col("version_id") == version)).limit(1)
    again = old.select("document_id", "branch", "version_id", F.lit(at).cast("long").alias("valid_from"), F.lit("save").alias("event_type"))
    return history.head_events(heads.select("document_id", "branch", "version_id", "valid_from", "event_type").unionByName(again))


def evaluate(results: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """nDCG, recall and MRR of every query: results (query_id, id, rank), expected (query_id, id)."""
    return retrieval.ranking_metrics(results, expected, k)


def compare_runs(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Means of two evaluations and which run wins."""
    mean = lambda m, n: m.agg(*[F.avg(c).alias(c) for c in ("ndcg", "recall", "mrr")]).withColumn("name", F.lit(n))
    return retrieval.compare(mean(a, names[0]), mean(b, names[1]))


def project_context(documents: DataFrame, decisions: DataFrame, budget: int = 8000, limit: int = 50) -> DataFrame:
    """What of each project fits a budget of words; see operators.context."""
    return context.fitted(documents, decisions, budget, limit)


def detect(values: DataFrame, links: DataFrame, paths: DataFrame, documents: DataFrame, now: int, days: int = 60) -> DataFrame:
    """kind, severity and title of contradictions (entity, value, doc), broken links (source, target) and stale documents (title, changed_at in micros)."""
    a = insights.conflicts(values, ["entity"], "value", "doc").select(F.lit("contradiction").alias("kind"), F.lit("warning").alias("severity"), "title")
    b = graph.broken_links(links, paths).select(F.lit("broken_link").alias("kind"), F.lit("warning").alias("severity"), F.concat("source", F.lit(" links to missing "), "target").alias("title")).distinct()
    c = insights.aged(documents, "changed_at", now, days, "info", "warning", 2 * days).select(F.lit("stale").alias("kind"), "severity", F.concat(F.lit("Not changed for long: "), "title").alias("title"))
    return a.unionByName(b).unionByName(c)


def audit(events: DataFrame, *, since: int | None = None, until: int | None = None, actor=None, operation=None, offset: int = 0, limit: int = 100) -> DataFrame:
    """Audit rows (at, actor, operation, id) of a window and filters, newest first, one page."""
    rows = events
    for column, value in (("actor", actor), ("operation", operation)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    rows = rows if since is None else rows.where(F.col("at") >= since)
    rows = rows if until is None else rows.where(F.col("at") < until)
    return rows.orderBy(F.desc("at"), F.desc("id")).offset(offset).limit(limit)


def inbox(candidates: DataFrame, by: str = "severity") -> DataFrame:
    """Pending candidates in the order of a reviewer: severity, confidence (null last), title; or confidence first."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    sure = F.desc(F.coalesce("confidence", F.lit(0.0)))
    order = [rank, sure, "title"] if by == "severity" else [sure, rank, "title"]
    return candidates.where("status = 'pending'").orderBy(*order)


def decide(candidates: DataFrame, ids: DataFrame, accept: bool, at: int) -> DataFrame:
    """candidates with the pending ones of ids accepted or rejected; others stay."""
    hit = candidates.join(ids.select("candidate_id").distinct().withColumn("_hit", F.lit(True)), "candidate_id", "left")
    now = F.col("_hit").isNotNull() & (F.col("status") == "pending")
    changed = {"status": F.when(now, "accepted" if accept else "rejected").otherwise(F.col("status")), "decided_at": F.when(now, F.lit(at)).otherwise(F.col("decided_at"))}
    return hit.withColumns(changed).select(candidates.columns)


def overview(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """A dashboard's row a project: live documents, their newest change, and jobs still open; documents (project, status, changed_at), jobs (project, status)."""
    docs = documents.where("status <> 'deleted'").groupBy("project").agg(F.count(F.lit(1)).alias("documents"), F.max("changed_at").alias("changed_at"))
    work = jobs.groupBy("project").agg(F.count_if(F.col("status").isin("queued", "running")).alias("open_jobs"), F.count_if(F.col("status") == "failed").alias("failed_jobs"))
    return docs.join(work, "project", "full").fillna(0, ["documents", "open_jobs", "failed_jobs"])


def newest(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n newest rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")

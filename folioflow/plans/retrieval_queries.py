"""Queries of retrieval, evaluation and vectors, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.functions import vectors as V
from folioflow.operators import models as MC
from folioflow.operators import retrieval as R
from folioflow.plans import bindings as B
from folioflow.session import cut
from folioflow.sources.tables import table

Q: dict = {}
S: dict[str, str] = {}


def _docs(s, d):
    return B.documents(s, d).select(F.col("doc_id").alias("id"), "text", "project", "doc_type", "status")


def _queries(s, d):
    """All benchmark items as queries: their distinct tokens."""
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token"))


_STORED: dict = {}


def _there(s, kept) -> bool:
    """Whether the files of something kept are still in the shared folder."""
    files = [kept] if isinstance(kept, str) else [kept.folder] if isinstance(kept, R.InvertedIndex) else kept.inputFiles()[:1]
    path = lambda f: s._jvm.org.apache.hadoop.fs.Path(f)
    return all(path(f).getFileSystem(s._jsc.hadoopConfiguration()).exists(path(f)) for f in files)


def _stored(s, d, what, make):
    """What is derived from the documents and kept. The first query of a session that asks for it makes it, the others read it; other files are another
    corpus, and what is gone from the shared folder is made again."""
    corpus = (what, s.sparkContext.applicationId, *sorted(table(s, d, "documents").inputFiles()))
    if corpus not in _STORED or not _there(s, _STORED[corpus]):
        _STORED[corpus] = make()
    return _STORED[corpus]


def _index(s, d):
    return _stored(s, d, "index", lambda: R.indexed(_docs(s, d)))


def _updated(s, d):
    """An index of the documents as they were, brought up to date: every seventh had another text, every ninth wasn't there, and some have gone since."""
    docs = _docs(s, d).select("id", "text")
    before = docs.where("id % 9 <> 0").withColumn("text", F.when(F.col("id") % 7 == 0, F.concat(F.lit("old the "), F.reverse("text"))).otherwise(F.col("text")))
    gone = s.range(5).select((-1 - F.col("id")).alias("id"))
    index = R.indexed(before.unionByName(gone.withColumn("text", F.lit("gone and the"))))
    index.update(docs.where("id % 9 = 0 or id % 7 = 0"), gone)
    return index


def _live(s, d):
    """The scope of searches: documents that aren't deleted."""
    return _docs(s, d).where("status <> 'deleted'").select("id")


P = "p AS (SELECT id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id AS id, len(t) AS dl, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents) WHERE len(t) > 0) GROUP BY id, token)"
QT = "q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM benchmark)"
BM = f"{P}, {QT}, st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT id, dl FROM p)), df AS (SELECT token, count(*) AS df FROM p GROUP BY token), bm AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN p USING (token) JOIN df USING (token) CROSS JOIN st GROUP BY query_id, id)"

Q["RET2_bm25"] = lambda s, d: R.bm25(_index(s, d), _queries(s, d)).select("query_id", "id", F.round("score", 6).alias("score"))
S["RET2_bm25"] = f"WITH {BM} SELECT query_id, id, round(score, 6) AS score FROM bm"
Q["RET2_index_update"] = lambda s, d: R.bm25(_updated(s, d), _queries(s, d)).select("query_id", "id", F.round("score", 6).alias("score"))
S["RET2_index_update"] = S["RET2_bm25"]
Q["TOP1_bm25_top100"] = lambda s, d: R.top(R.bm25(_index(s, d), _queries(s, d)).withColumn("score", F.round("score", 6)), 100)
TOPB = "b AS (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM bm QUALIFY rank <= 100)"
S["TOP1_bm25_top100"] = f"WITH {BM}, {TOPB} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM b"


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _query_vectors(s, d):
    return table(s, d, "embeddings").where("vec_id % 50 = 0").select((F.col("vec_id") / 50).cast("long").alias("query_id"), F.col("embedding").alias("q"))


COS = "vs AS (SELECT b.vec_id // 50 AS query_id, a.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score FROM embeddings a JOIN embeddings b ON b.vec_id % 50 = 0), v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vs QUALIFY rank <= 100)"


def _vector(s, d):
    return R.vector_search(_vectors(s, d), _query_vectors(s, d))


Q["RET3_vector_search"] = _vector
S["RET3_vector_search"] = f"WITH {COS} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM v"

TERM = r"(?:^|[^\p{L}\p{N}_])([A-Z][A-Z0-9_]{2,})(?=$|[^\p{L}\p{N}_])"


def _terms(s, d):
    """Upper-case terms of every text, each occurrence a posting; stored like the index."""
    return _stored(s, d, "terms", lambda: cut(_docs(s, d).select("id", F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(1))).alias("term"))))


def _query_terms(s, d):
    """Query i asks for the terms that begin with its i-th letter."""
    return _terms(s, d).select("term").distinct().select((F.ascii("term") % 5).cast("long").alias("query_id"), "term")


TERMS = r"tx AS (SELECT doc_id AS id, unnest(regexp_extract_all(regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])([A-Z][A-Z0-9_]{2,})(?:$|[^\p{L}\p{N}_])', 1)) AS term FROM documents), tq AS (SELECT DISTINCT CAST(ascii(term) % 5 AS BIGINT) AS query_id, term FROM tx), ts AS (SELECT query_id, id, count(*) AS score FROM tx JOIN tq USING (term) GROUP BY query_id, id), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ts QUALIFY rank <= 100)"
Q["RET4_term_search"] = lambda s, d: R.term_search(_terms(s, d), _query_terms(s, d))
S["RET4_term_search"] = f"WITH {TERMS} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM t"
Q["AGG1_term_counts"] = lambda s, d: _terms(s, d).groupBy("id").agg(F.count(F.lit(1)).alias("matches"))
S["AGG1_term_counts"] = f"WITH {TERMS} SELECT id, count(*) AS matches FROM tx GROUP BY id"


def _fused(s, d):
    return R.fuse(Q["TOP1_bm25_top100"](s, d), _vector(s, d), Q["RET4_term_search"](s, d))


FUSED = "u AS (SELECT query_id, id, rank AS rb, NULL AS rv, NULL AS rt FROM b UNION ALL SELECT query_id, id, NULL, rank, NULL FROM v UNION ALL SELECT query_id, id, NULL, NULL, rank FROM t), f AS (SELECT query_id, id, max(rb) AS rank_bm25, max(rv) AS rank_vector, max(rt) AS rank_terms FROM u GROUP BY query_id, id), fused AS (SELECT *, round(coalesce(1.0 / (60 + rank_bm25), 0) + coalesce(1.0 / (60 + rank_vector), 0) + coalesce(0.5 / (60 + rank_terms), 0), 9) AS fused FROM f)"
UNSCOPED = f"{BM}, {TOPB}, {COS}, {TERMS}, {FUSED}"
Q["RET5_rrf_fusion"] = _fused
S["RET5_rrf_fusion"] = f"WITH {UNSCOPED} SELECT query_id, id, CAST(rank_bm25 AS INTEGER) AS rank_bm25, CAST(rank_vector AS INTEGER) AS rank_vector, CAST(rank_terms AS INTEGER) AS rank_terms, CAST(fused AS DOUBLE) AS fused FROM fused"


def _hybrid(s, d, cap=3, limit=20):
    return R.search(_index(s, d), _vectors(s, d), _terms(s, d), _docs(s, d), _queries(s, d), _query_vectors(s, d), _query_terms(s, d), _live(s, d), cap=cap, limit=limit)


# the scope holds within each signal, before its best hundred are taken
TOPB_LIVE = TOPB.replace("FROM bm QUALIFY", "FROM bm WHERE id % 10 <> 0 QUALIFY")
ALL = f"{BM}, {TOPB_LIVE}, {COS.replace('ON b.vec_id % 50 = 0)', 'ON b.vec_id % 50 = 0 JOIN documents x ON x.doc_id = a.vec_id WHERE x.doc_id % 10 <> 0)')}, {TERMS.replace('USING (term) GROUP', 'USING (term) WHERE id % 10 <> 0 GROUP')}, {FUSED}"
HY = "h AS (SELECT f.query_id, f.id, f.fused, f.rank_bm25, f.rank_vector, f.rank_terms, x.source AS project, x.lang AS doc_type, x.text FROM fused f JOIN documents x ON x.doc_id = f.id), hc AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, project ORDER BY fused DESC, id) <= 3), hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS final_rank FROM hc QUALIFY final_rank <= 20)"
Q["RET6_hybrid_search"] = lambda s, d: _hybrid(s, d).select("query_id", "final_rank", "id", "project", "doc_type", "fused", X.snippet(F.col("text")).alias("snippet"), F.array_join(X.signals("rank_bm25", "rank_vector", "rank_terms"), ",").alias("signals"))
SNIP = "CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 200 THEN regexp_replace(substring(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 200), '\\s+$', '') || '...' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END"
S["RET6_hybrid_search"] = f"WITH {ALL}, {HY} SELECT query_id, CAST(final_rank AS INTEGER) AS final_rank, id, project, doc_type, CAST(fused AS DOUBLE) AS fused, {SNIP} AS snippet, concat_ws(',', CASE WHEN rank_bm25 IS NOT NULL THEN 'keyword' END, CASE WHEN rank_vector IS NOT NULL THEN 'semantic' END, CASE WHEN rank_terms IS NOT NULL THEN 'exact-term' END) AS signals FROM hy"
Q["WIN2_per_project_cap"] = lambda s, d: _hybrid(s, d).groupBy("query_id", "project").agg(F.count(F.lit(1)).alias("n"))
S["WIN2_per_project_cap"] = f"WITH {ALL}, {HY} SELECT query_id, project, count(*) AS n FROM hy GROUP BY query_id, project"
Q["UI1_type_facets"] = lambda s, d: R.facets(_hybrid(s, d), "doc_type")
S["UI1_type_facets"] = f"WITH {ALL}, {HY} SELECT query_id, doc_type, count(*) AS n FROM hy GROUP BY query_id, doc_type"


def _entities(s, d):
    """Terms as entities of the results, for facets and hydration."""
    return _hybrid(s, d).select("query_id", "id").join(_terms(s, d).distinct(), "id")


Q["AGG2_entity_facets"] = lambda s, d: R.facets(_entities(s, d), "term")
S["AGG2_entity_facets"] = f"WITH {ALL}, {HY} SELECT query_id, term, count(*) AS n FROM hy JOIN (SELECT DISTINCT id, term FROM tx) USING (id) GROUP BY query_id, term QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) <= 20"
Q["RET8_hydration"] = lambda s, d: _hybrid(s, d).select("query_id", "id", "project").join(_terms(s, d).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("terms")), "id", "left")
S["RET8_hydration"] = f"WITH {ALL}, {HY} SELECT hy.query_id, hy.id, hy.project, g.terms FROM hy LEFT JOIN (SELECT id, string_agg(term, ',' ORDER BY term) AS terms FROM (SELECT DISTINCT id, term FROM tx) GROUP BY id) g ON g.id = hy.id"
Q["UI2_facet_refinement"] = lambda s, d: _hybrid(s, d).select("query_id", "id").join(_terms(s, d).where("term like 'TH%'").select("id").distinct(), "id", "left_semi")
S["UI2_facet_refinement"] = f"WITH {ALL}, {HY} SELECT query_id, id FROM hy WHERE id IN (SELECT id FROM tx WHERE term LIKE 'TH%')"
Q["RET7_lexical_phase"] = lambda s, d: R.capped(R.top(R.bm25(_index(s, d), _queries(s, d), _live(s, d)).withColumn("score", F.round("score", 6)), 100).withColumn("fused", F.round(1.0 / (60 + F.col("rank")), 9)).join(_docs(s, d), "id"), "project", 3, 20).select("query_id", "final_rank", "id")
S["RET7_lexical_phase"] = f"WITH {BM}, {TOPB_LIVE}, l AS (SELECT b.*, source AS project FROM b JOIN documents ON doc_id = id), lc AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY query_id, project ORDER BY rank) <= 3) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS final_rank, id FROM lc QUALIFY final_rank <= 20"


def overlap():
    """A reranker for tests and benches: the share of a query's distinct words that a text has."""
    import re

    words = lambda t: set(re.findall(r"\w+", t.lower()))
    return lambda pairs: [len(words(q) & words(t)) / len(words(q)) for q, t in pairs]


def measures():
    """An embedder for tests and benches: a text's characters, words, lines and letters e."""
    return lambda texts: [[len(t), len(t.split()), t.count("\n") + 1, t.count("e")] for t in texts]


def _scored(s, d):
    """The hybrid results with a reranker's score for each pair of query and text."""
    asked = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    pairs = _hybrid(s, d).select("query_id", "id", "final_rank", "text").join(asked, "query_id")
    return MC.scored(pairs, "query", "text", overlap, MC.Limits(chars=1 << 20))


def _reranked(s, d):
    got = cut(_scored(s, d).select("query_id", "id", "final_rank", "rerank_score"))
    return R.reranked(got.drop("rerank_score"), got, 10).select("query_id", "id", "reranked")


W = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'))"
RE = f"re AS (SELECT hy.*, len(list_intersect({W.format('b.text')}, {W.format('hy.text')})) / len({W.format('b.text')}) AS score FROM hy JOIN benchmark b ON b.item_id = query_id)"
Q["TOP4_rerank_prefix"] = _reranked
S["TOP4_rerank_prefix"] = f"WITH {ALL}, {HY}, {RE} SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_rank > 10, CASE WHEN final_rank <= 10 THEN score END DESC, final_rank) AS INTEGER) AS reranked FROM re"
Q["RET9_rerank_calls"] = lambda s, d: _scored(s, d).select("query_id", "id", F.round("rerank_score", 9).alias("score"), "error")
S["RET9_rerank_calls"] = f"WITH {ALL}, {HY}, {RE} SELECT query_id, id, round(score, 9) AS score, NULL::VARCHAR AS error FROM re"
Q["VEC6_embedding_calls"] = lambda s, d: MC.embedded(table(s, d, "documents").select("doc_id", "text"), "text", measures, 3, MC.Limits(chars=20_000)).select("doc_id", *[F.get("vector", F.lit(k)).cast("long").alias(c) for k, c in enumerate(("chars", "words", "lines"))], "error")
_SENT = "regexp_matches(text, '\\S') AND length(text) <= 20000"
S["VEC6_embedding_calls"] = f"SELECT doc_id, CASE WHEN {_SENT} THEN length(text) END AS chars, CASE WHEN {_SENT} THEN len(regexp_extract_all(text, '\\S+')) END AS words, CASE WHEN {_SENT} THEN length(text) - length(replace(text, chr(10), '')) + 1 END AS lines, CASE WHEN NOT coalesce(regexp_matches(text, '\\S'), false) THEN 'empty input' WHEN length(text) > 20000 THEN 'input of more than 20000 characters' END AS error FROM documents"
Q["RET9_rerank_score"] = lambda s, d: table(s, d, "labels").select("doc_id", F.round(V.yes_probability((F.col("doc_id") % 13) / 4, (F.col("doc_id") % 7) / 2), 9).alias("score"))
S["RET9_rerank_score"] = "SELECT doc_id, round(exp(doc_id % 7 / 2) / (exp(doc_id % 7 / 2) + exp(doc_id % 13 / 4)), 9) AS score FROM labels"
Q["TOP5_rank_by_score"] = lambda s, d: R.top(table(s, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")), 3)
S["TOP5_rank_by_score"] = "SELECT o_custkey AS query_id, o_orderkey AS id, o_totalprice AS score, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 3"
Q["AGG22_score_distribution"] = lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.stddev_pop("value"), 6).alias("std"), F.count_if(F.col("value") > 10).alias("above"), F.count_if(F.col("value") <= 10).alias("below"))
S["AGG22_score_distribution"] = "SELECT event_type, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS std, count(*) FILTER (WHERE value > 10) AS above, count(*) FILTER (WHERE value <= 10) AS below FROM events GROUP BY event_type"


def _gold(s, d):
    """Documents that hold a benchmark text whole: the expected results."""
    return R.containing(_docs(s, d), table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("t")))


def _ranked_gold(s, d):
    items = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token"))
    return R.top(R.bm25(_index(s, d), items).withColumn("score", F.round("score", 6)), 10)


GOLD = f"{P}, q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM benchmark), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT id, dl FROM p)), df AS (SELECT token, count(*) AS df FROM p GROUP BY token), bm AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN p USING (token) JOIN df USING (token) CROSS JOIN st GROUP BY query_id, id), a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM bm QUALIFY rank <= 10), w AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents x ON strpos(x.text, b.text) > 0), m AS (SELECT w.query_id, count(*) AS n, coalesce(sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) END), 0) AS dcg, count(*) FILTER (WHERE rank <= 5) AS found, min(rank) AS best FROM w LEFT JOIN a ON a.query_id = w.query_id AND a.id = w.id GROUP BY w.query_id), mm AS (SELECT query_id, round(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg, round(found / n, 6) AS recall, round(coalesce(1 / best, 0), 6) AS mrr FROM m)"
Q["MET1_ranking_metrics"] = lambda s, d: R.ranking_metrics(_ranked_gold(s, d), _gold(s, d), 5)
S["MET1_ranking_metrics"] = f"WITH {GOLD} SELECT query_id, ndcg, recall, mrr FROM mm"
Q["AGG16_eval_means"] = lambda s, d: R.ranking_metrics(_ranked_gold(s, d), _gold(s, d), 5).agg(F.round(F.coalesce(F.avg("ndcg"), F.lit(0.0)), 6).alias("ndcg"), F.round(F.coalesce(F.avg("recall"), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(F.avg("mrr"), F.lit(0.0)), 6).alias("mrr"))
S["AGG16_eval_means"] = f"WITH {GOLD} SELECT round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr FROM mm"


def _compare(s, d):
    m = R.ranking_metrics(_ranked_gold(s, d), _gold(s, d), 5)
    run = lambda name, keep: m.where(keep).agg(F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr")).withColumn("name", F.lit(name))
    return R.compare(run("even", "query_id % 2 = 0"), run("odd", "query_id % 2 = 1")).select("winner", "ndcg_delta")


Q["MET5_run_comparison"] = _compare
S["MET5_run_comparison"] = f"WITH {GOLD}, a2 AS (SELECT avg(ndcg) AS n, avg(recall) AS r, avg(mrr) AS m FROM mm WHERE query_id % 2 = 0), b2 AS (SELECT avg(ndcg) AS n, avg(recall) AS r, avg(mrr) AS m FROM mm WHERE query_id % 2 = 1) SELECT CASE WHEN a2.n > b2.n + 0.01 THEN 'even' WHEN b2.n > a2.n + 0.01 THEN 'odd' WHEN a2.r > b2.r + 0.01 THEN 'even' WHEN b2.r > a2.r + 0.01 THEN 'odd' WHEN a2.m > b2.m + 0.01 THEN 'even' WHEN b2.m > a2.m + 0.01 THEN 'odd' ELSE 'tie' END AS winner, round(b2.n - a2.n, 4) AS ndcg_delta FROM a2, b2"

def _parsed(s, d):
    """Benchmark items and a technical tail as requests: their words, technical terms and scopes."""
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" GET /api/v"), (F.col("item_id") % 3).cast("string"), F.lit("/x")).alias("query"), F.when(F.col("item_id") % 2 == 0, "current").otherwise("branch: dev ").alias("version_scope"), F.lit(None).cast("string").alias("project"))
    return R.parsed(q).select("query_id", F.size("tokens").cast("long").alias("tokens"), F.expr("filter(terms, x -> x.kind = 'api_route')[0].term").alias("route"), "scope_kind", "scope_value")


Q["RET1_query_parse"] = _parsed
S["RET1_query_parse"] = "SELECT item_id AS query_id, len(list_distinct(regexp_extract_all(lower(text || ' GET /api/v' || item_id % 3 || '/x'), '[\\p{L}\\p{N}_]+'))) AS tokens, '/api/v' || item_id % 3 || '/x' AS route, CASE WHEN item_id % 2 = 0 THEN 'current' ELSE 'branch' END AS scope_kind, CASE WHEN item_id % 2 = 1 THEN 'dev' END AS scope_value FROM benchmark"

# vectors
Q["VEC1_normalise"] = lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(V.norm(V.normalised(F.transform("embedding", lambda x: x * 3))), 9).alias("norm"), F.round(F.element_at(V.normalised("embedding"), 1), 9).alias("first"))
S["VEC1_normalise"] = "SELECT vec_id, 1.0::DOUBLE AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 9) AS first FROM embeddings"


def _next(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


NEXT = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
Q["VEC2_cosine_dot"] = lambda s, d: _next(s, d).select("vec_id", F.round(V.dot("embedding", "other"), 9).alias("dot"), F.round(V.cosine("embedding", "other"), 9).alias("cosine"))
S["VEC2_cosine_dot"] = f"SELECT a.vec_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS dot, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS cosine {NEXT}"
Q["VEC3_euclidean"] = lambda s, d: _next(s, d).select("vec_id", F.round(V.euclidean("embedding", "other"), 9).alias("distance"))
S["VEC3_euclidean"] = f"SELECT a.vec_id, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS distance {NEXT}"
Q["VEC4_truncate"] = lambda s, d: _next(s, d).select("vec_id", F.round(V.dot(V.truncated("embedding", 16), V.truncated("other", 16)), 8).alias("dot"))
S["VEC4_truncate"] = f"SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding[1:16] AS DOUBLE[]), CAST(b.embedding[1:16] AS DOUBLE[])), 8) AS dot {NEXT}"
Q["VEC5_base64"] = lambda s, d: table(s, d, "embeddings").select("vec_id", "embedding", V.to_base64("embedding").alias("code")).select("vec_id", F.length("code").cast("long").alias("chars"), F.hex(F.substring(F.unbase64("code"), 1, 4)).alias("first"), (V.from_base64("code", 64) == F.col("embedding")).alias("same"))
# a float's bits in hexadecimal, turned to little-endian order
S["VEC5_base64"] = "SELECT vec_id, 4 * ((len(embedding) * 4 + 2) // 3) AS chars, hex(unhex(h[7:8] || h[5:6] || h[3:4] || h[1:2])) AS first, true AS same FROM (SELECT vec_id, embedding, lpad(to_hex(CASE WHEN x = 0 THEN 0 ELSE (CASE WHEN x < 0 THEN 2147483648 ELSE 0 END) + CAST((e + 127) * 8388608 + round((abs(x) / pow(2, e) - 1) * 8388608) AS BIGINT) END), 8, '0') AS h FROM (SELECT vec_id, embedding, CAST(embedding[1] AS DOUBLE) AS x, CAST(floor(log2(abs(CAST(embedding[1] AS DOUBLE)))) AS BIGINT) AS e FROM embeddings))"


def _texts(s, d):
    """Conversation turns as texts to batch, in order of their turn; a text is estimated at a token for four characters."""
    return table(s, d, "conversations").select("conv_id", "turn", F.floor(F.length("text") / 4).cast("long").alias("size"))


Q["VEC6_batching"] = lambda s, d: V.batches(_texts(s, d), "conv_id", ["turn"], F.col("size"), 3, 150).groupBy("conv_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens"))
S["VEC6_batching"] = "WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, CAST(length(text) // 4 AS BIGINT) AS size FROM conversations), f AS (SELECT conv_id, k, size, 0::BIGINT AS batch, 1::BIGINT AS held, size AS used FROM t WHERE k = 1 UNION ALL SELECT t.conv_id, t.k, t.size, CASE WHEN f.used + t.size > 150 OR f.held >= 3 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.used + t.size > 150 OR f.held >= 3 THEN 1 ELSE f.held + 1 END, CASE WHEN f.used + t.size > 150 OR f.held >= 3 THEN t.size ELSE f.used + t.size END FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1) SELECT conv_id, batch, count(*) AS n, sum(size)::BIGINT AS tokens FROM f GROUP BY conv_id, batch"
Q["VEC6_batching_by_count"] = lambda s, d: V.batches(_texts(s, d), "conv_id", ["turn"], F.col("size"), 3).groupBy("conv_id", "batch").agg(F.count(F.lit(1)).alias("n"))
S["VEC6_batching_by_count"] = "SELECT conv_id, (k - 1) // 3 AS batch, count(*) AS n FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY ALL"


def _padded(s, d):
    """Lengths of a text's words as token ids, fitted between a prefix and a suffix, padded to the longest of their conversation."""
    ids = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S+)"), F.lit(1)), lambda w: F.length(w))
    rows = table(s, d, "conversations").select("conv_id", "turn", V.fitted_ids(ids, [101, 102], [103], 24).alias("ids"))
    wide = rows.groupBy("conv_id").agg(F.max(F.size("ids")).alias("width"))
    return rows.join(wide, "conv_id").select("conv_id", "turn", V.left_padded(F.col("ids"), F.col("width")).alias("p")).select("conv_id", "turn", F.array_join(F.col("p.ids").cast("array<string>"), ",").alias("ids"), F.array_join(F.col("p.mask").cast("array<string>"), ",").alias("mask"))


Q["VEC7_left_padding"] = _padded
S["VEC7_left_padding"] = "WITH r AS (SELECT conv_id, turn, [101, 102] || list_transform(regexp_extract_all(coalesce(text, ''), '\\S+'), lambda w: length(w))[1:21] || [103] AS ids FROM conversations), w AS (SELECT conv_id, max(len(ids)) AS width FROM r GROUP BY conv_id) SELECT conv_id, turn, repeat('0,', CAST(width - len(ids) AS INTEGER)) || array_to_string(ids, ',') AS ids, repeat('0,', CAST(width - len(ids) AS INTEGER)) || array_to_string(list_transform(ids, lambda x: 1), ',') AS mask FROM r JOIN w USING (conv_id)"
Q["VEC10_last_token"] = lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(V.last_token(F.col("embedding").cast("array<double>"), F.transform("embedding", lambda x: (x > 0).cast("int"))), 6).alias("state"))
S["VEC10_last_token"] = "SELECT vec_id, round(list_filter(embedding, lambda x: x > 0)[-1]::DOUBLE, 6) AS state FROM embeddings"
LIMITS = {"most_documents": 4, "most_query": 220, "most_document": 700}


def _guarded(s, d):
    """Conversations as rerank requests: the first turn asks, the others are the documents."""
    r = table(s, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("turns")).withColumn("documents", F.slice("turns", F.lit(2), F.size("turns")))
    query = F.when(F.col("conv_id") % 11 == 0, " \n").otherwise(F.col("query"))
    return r.select("conv_id", V.request_problem(query, F.col("documents"), **LIMITS).alias("problem"))


Q["VEC11_request_guards"] = _guarded
S["VEC11_request_guards"] = "WITH r AS (SELECT conv_id, CASE WHEN conv_id % 11 = 0 THEN '' ELSE arg_min(text, turn) END AS q, list(text ORDER BY turn)[2:] AS docs FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN trim(q) = '' THEN 'empty query' WHEN len(docs) = 0 THEN 'empty documents' WHEN len(docs) > 4 THEN 'too many documents' WHEN length(q) > 220 THEN 'query too long' WHEN len(list_filter(docs, lambda x: length(x) > 700)) > 0 THEN 'document too long' END AS problem FROM r"
Q["VEC8_prompts"] = lambda s, d: table(s, d, "benchmark").select("item_id", F.format_string("Instruct: %s\nQuery:%s", F.lit("find passages"), "text").alias("prompt"))
S["VEC8_prompts"] = "SELECT item_id, 'Instruct: find passages' || chr(10) || 'Query:' || text AS prompt FROM benchmark"
Q["VEC9_dimension_guard"] = lambda s, d: table(s, d, "embeddings").select("vec_id", F.size(V.guarded(F.col("embedding"), 64)).cast("long").alias("dims"))
S["VEC9_dimension_guard"] = "SELECT vec_id, len(embedding) AS dims FROM embeddings"
Q["AGG21_embedding_quality"] = lambda s, d: table(s, d, "embeddings").select("label", V.norm("embedding").alias("n"), F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))).alias("bad")).groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.round(F.min("n"), 6).alias("lo"), F.round(F.max("n"), 6).alias("hi"), F.round(F.avg("n"), 6).alias("mean"), F.max("bad").alias("bad"), F.min(F.abs(F.col("n") - 1) < 1e-5).alias("normalised"))
S["AGG21_embedding_quality"] = "WITH e AS (SELECT label, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n, len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0 AS bad FROM embeddings) SELECT label, count(*) AS rows, round(min(n), 6) AS lo, round(max(n), 6) AS hi, round(avg(n), 6) AS mean, bool_or(bad) AS bad, bool_and(abs(n - 1) < 1e-5) AS normalised FROM e GROUP BY label"
# the ids that other queries stand for
Q["J22_vector_top_k"] = lambda s, d: R.top(_vector(s, d).drop("rank"), 10).select("query_id", "id", "rank")
S["J22_vector_top_k"] = f"WITH {COS} SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM v WHERE rank <= 10"
Q["TOP2_vector_top100"] = lambda s, d: _vector(s, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("deepest"))
S["TOP2_vector_top100"] = f"WITH {COS} SELECT query_id, count(*) AS n, CAST(max(rank) AS INTEGER) AS deepest FROM v GROUP BY query_id"
Q["WIN1_rank_assignment"] = lambda s, d: Q["RET4_term_search"](s, d).select("query_id", "id", "rank")
S["WIN1_rank_assignment"] = f"WITH {TERMS} SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM t"
Q["TOP3_result_limit"] = lambda s, d: _hybrid(s, d, limit=5).select("query_id", "id", "final_rank")
S["TOP3_result_limit"] = f"WITH {ALL}, {HY} SELECT query_id, id, CAST(final_rank AS INTEGER) AS final_rank FROM hy WHERE final_rank <= 5"
Q["MET2_recall"] = lambda s, d: R.ranking_metrics(_ranked_gold(s, d), _gold(s, d), 10).select("query_id", "recall")
S["MET2_recall"] = "WITH " + GOLD.replace("rank <= 5", "rank <= 10").replace("range(1, least(n, 5) + 1)", "range(1, least(n, 10) + 1)") + " SELECT query_id, recall FROM mm"
Q["MET3_mrr"] = lambda s, d: R.ranking_metrics(_ranked_gold(s, d), _gold(s, d), 5).select("query_id", "mrr")
S["MET3_mrr"] = f"WITH {GOLD} SELECT query_id, mrr FROM mm"
Q["J2_embedding_star_join"] = lambda s, d: table(s, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("doc_id"), "label").join(B.chunks(s, d).select("doc_id", "pos", "project"), "doc_id").groupBy("project", "label").agg(F.count(F.lit(1)).alias("chunks"))
S["J2_embedding_star_join"] = f"WITH {B.CHUNKS} SELECT project, label, count(*) AS chunks FROM chunks JOIN embeddings ON vec_id = doc_id WHERE label = 3 GROUP BY project, label"

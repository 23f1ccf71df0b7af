"""Hybrid retrieval: BM25, cosine and exact terms, fused by reciprocal ranks, capped, hydrated and faceted.

All functions take many queries at once: every frame has query_id, so ranks are windows over a query and never over a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from folioflow.functions import text as X
from folioflow.functions import vectors as V
from folioflow.operators import textetl as T
from folioflow.operators.inverted import BUCKETS, InvertedIndex
from folioflow.session import shared_dir

K1, B = 1.2, 0.75
CANDIDATES = 100
RRF_K, WEIGHTS = 60, {"bm25": 1.0, "vector": 1.0, "terms": 0.5}
BLOCK_QUERIES = 4096
QUERY_ROWS = 1 << 16


def top(scored: DataFrame, n: int, score: str = "score", key: str = "id", group: str = "query_id") -> DataFrame:
    """The n best of each query, ties to the smaller key, with their rank; the limit goes below the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def indexed(docs: DataFrame, key: str = "id", text: str = "text", buckets: int = BUCKETS) -> InvertedIndex:
    """A stored index of docs in a folder of its own in the shared one."""
    spark = docs.sparkSession
    return InvertedIndex(spark, shared_dir(spark), buckets).build(docs.select(F.col(key).alias("id"), F.col(text).alias("text")))


def parsed(requests: DataFrame) -> DataFrame:
    """query_id, query, tokens (distinct words), terms (technical terms as kind, term), project, scope_kind, scope_value of search requests.

    requests has query_id, query, project and version_scope: current, all, as_of:<time>, snapshot:<name> or branch:<name>; a null scope is current.
    Malformed scopes have a null kind; SearchRequest.validated() raises on them.
    """
    scope = F.coalesce(F.trim("version_scope"), F.lit("current"))
    value = F.nullif(F.trim(F.regexp_extract(scope, r"^(?:as_of|snapshot|branch):([\s\S]*)$", 1)), F.lit(""))
    kind = F.when(scope.isin("current", "all"), scope).when(value.isNotNull(), F.regexp_extract(scope, "^([a-z_]+):", 1))
    found = requests.select("query_id", "query", "project", F.array_distinct(X.tokens(F.col("query"))).alias("tokens"), kind.alias("scope_kind"), value.alias("scope_value"), T.terms(F.col("query")).alias("_t"))
    return found.withColumn("terms", F.transform("_t", lambda x: F.struct(x["kind"].alias("kind"), T.normalised_term(x["kind"], x["raw"]).alias("term")))).drop("_t")


def in_scope(rows: DataFrame, scope: DataFrame | None, key: str = "id") -> DataFrame:
    """Rows whose key the scope has; all without a scope. Signals are cut to it before their best are taken."""
    return rows if scope is None else rows.join(scope.select(F.col("id").alias(key)), key, "left_semi")


def bm25(index: InvertedIndex, queries: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """query_id, id, score for queries (query_id, token) distinct. Statistics cover the whole index, hits the scope.

    Only the buckets of the asked tokens are read. The tokens, with their weights, go to the postings where they are no more than QUERY_ROWS: the asked
    postings are dealt by id first, so a document's hits are added up where they are made, and no hit is shuffled. Beyond that both sides meet by token.
    """
    postings, terms = index.of(queries.select("token"))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = queries.join(terms.drop("bucket"), "token").crossJoin(F.broadcast(index.statistics())).select("query_id", "token", weight.alias("idf"), "avgdl")  # statistics are one row
    few = queries.limit(QUERY_ROWS + 1).count() <= QUERY_ROWS
    own = postings.drop("bucket")
    hits = own.join(F.broadcast(asked.select("token")), "token", "left_semi").repartition("id").join(F.broadcast(asked), "token") if few else own.join(asked, "token")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return in_scope(hits.groupBy("query_id", "id").agg(F.sum(part).alias("score")), scope)


def in_blocks(queries: DataFrame, join, block: int = BLOCK_QUERIES) -> DataFrame:
    """The union of join(queries of a block), so that what one join broadcasts is at most about block rows of a stated query set."""
    n = max(1, -(-queries.count() // block))
    out = None
    for i in range(n):
        part = join(queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i))
        out = part if out is None else out.unionByName(part)
    return out


def vector_search(vectors: DataFrame, queries: DataFrame, n: int = CANDIDATES, scope: DataFrame | None = None, block: int = BLOCK_QUERIES) -> DataFrame:
    """Exact cosine to nine digits: each query vector (query_id, q) against all rows (id, v) of its size in scope, queries in blocks.

    Each task finds the best of its rows by products of matrices (V.nearest), so that n rows of a query leave it and not all. Vectors that such products
    don't compare safely (V.plain) are few or none; they meet the other side as pairs.
    """
    own = in_scope(vectors, scope).select("id", "v").where("v is not null")
    asked = queries.select("query_id", "q").where("q is not null")
    pairs = lambda rows: lambda q: rows.crossJoin(F.broadcast(q)).where(F.size("v") == F.size("q")).select("query_id", "id", F.round(V.cosine("v", "q"), 9).alias("score"))
    kind = own.schema["id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    fit = V.plain("v") & F.col("id").isNotNull() if isinstance(own.schema["id"].dataType, IntegralType) else F.lit(False)
    even = own.where(fit)
    near = lambda q: V.nearest(even, q, n, *kind).withColumn("score", F.round("score", 9))
    found = in_blocks(asked.where(V.plain("q")), near, block)
    odd_queries = asked.where(~V.plain("q"))
    if not vectors.where("v is not null").where(~fit).isEmpty():
        found = found.unionByName(in_blocks(asked, pairs(own.where(~fit)), block))
    if not odd_queries.isEmpty():
        found = found.unionByName(in_blocks(odd_queries, pairs(even), block))
    return top(found, n)


def term_search(terms: DataFrame, queries: DataFrame, n: int = CANDIDATES, scope: DataFrame | None = None) -> DataFrame:
    """Matching postings (id, term) in scope counted for each query (query_id, term)."""
    hits = in_scope(terms, scope).join(queries.select("query_id", "term").distinct(), "term").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("score"))
    return top(hits, n)


def containing(docs: DataFrame, items: DataFrame, words: int = 5) -> DataFrame:
    """query_id, id: documents (id, text) that hold an item (query_id, t) whole.

    An equi join on the item's second to sixth word brings them together, and the strings decide; items of fewer words go in blocks.
    """
    split = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    gram = lambda w, i: F.xxhash64(F.slice(w, i, words))
    named = items.where("query_id is not null and t <> ''").withColumn("w", split(F.col("t"))).withColumn("long", F.size("w") >= words + 2)
    keyed = named.where("long").select("query_id", "t", gram(F.col("w"), F.lit(2)).alias("g"))
    own = docs.select("id", split(F.col("text")).alias("w")).where(F.size("w") >= words)
    grams = own.select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - words + 1), lambda i: gram(F.col("w"), i)))).alias("g"))
    # an item has one gram, so items are dealt by it; few enough of them go to the texts, and no gram that none asks for is shuffled
    few = keyed.limit(QUERY_ROWS + 1).count() <= QUERY_ROWS
    near = grams.join(F.broadcast(keyed) if few else keyed, "g").select("id", "query_id", "t")
    found = near.join(docs.select("id", "text"), "id").where(F.expr("instr(text, t) > 0")).select("query_id", "id")
    short = named.where("not long").select("query_id", "t")
    return found.unionByName(in_blocks(short, lambda q: docs.join(F.broadcast(q), F.expr("instr(text, t) > 0")).select("query_id", "id"))).distinct()


def fuse(bm25: DataFrame, vector: DataFrame, terms: DataFrame, k: int = RRF_K, weights: dict | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of three ranked frames (query_id, id, rank); the three addends have a fixed order."""
    w = weights or WEIGHTS
    tagged = None
    for name, df in (("bm25", bm25), ("vector", vector), ("terms", terms)):
        one = df.select("query_id", "id", F.lit(name).alias("signal"), "rank")
        tagged = one if tagged is None else tagged.unionByName(one)
    ranks = [F.max(F.when(F.col("signal") == s, F.col("rank"))).alias(f"rank_{s}") for s in w]
    both = tagged.groupBy("query_id", "id").agg(*ranks)
    parts = [F.coalesce(F.lit(w[s]) / (k + F.col(f"rank_{s}")), F.lit(0.0)) for s in w]
    return both.withColumn("fused", F.round(parts[0] + parts[1] + parts[2], 9))


def capped(ranked: DataFrame, per: str, limit: int | None, total: int) -> DataFrame:
    """At most limit results of each per (None: any), then total of each query, by fused score."""
    order = [F.desc("fused"), F.asc("id")]
    if limit is not None:
        w = Window.partitionBy("query_id", per).orderBy(*order)
        ranked = ranked.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
    w = Window.partitionBy("query_id").orderBy(*order)
    return ranked.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= total)


def reranked(ranked: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """The first n by their new score, the rest as they were after them."""
    both = ranked.join(scores.select("query_id", "id", "rerank_score"), ["query_id", "id"], "left")
    s = F.when(F.col("final_rank") <= n, F.col("rerank_score"))
    w = Window.partitionBy("query_id").orderBy(s.isNull(), F.desc(s), "final_rank")
    return both.withColumn("reranked", F.row_number().over(w))


def facets(results: DataFrame, column: str, n: int = 20) -> DataFrame:
    counted = results.groupBy("query_id", column).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), F.asc(column))
    return counted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def search(index: InvertedIndex, vectors: DataFrame, terms: DataFrame, docs: DataFrame, queries: DataFrame, query_vectors: DataFrame, query_terms: DataFrame, scope: DataFrame | None = None, per: str = "project", cap: int | None = 3, limit: int = 20) -> DataFrame:
    """The whole hybrid search as one plan: three ranked signals, each within scope, fusion, the documents' columns, cap and limit."""
    lexical = bm25(index, queries, scope).withColumn("score", F.round("score", 6))
    fused = fuse(top(lexical, CANDIDATES), vector_search(vectors, query_vectors, scope=scope), term_search(terms, query_terms, scope=scope))
    return capped(fused.join(docs, "id"), per, cap, limit)


def ranking_metrics(actual: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """ndcg, recall and mrr of each query with expectations: actual (query_id, id, rank), expected (query_id, id)."""
    want = expected.select("query_id", "id").distinct()
    size = want.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    first = actual.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    hits = first.join(want, ["query_id", "id"]).groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"), F.sum((F.col("rank") <= k).cast("long")).alias("found"), F.min("rank").alias("best"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + F.lit(1.0)))
    both = size.join(hits, "query_id", "left")
    return both.select("query_id", F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"), F.round(F.coalesce("found", F.lit(0)) / F.col("n"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), 6).alias("mrr"))


def compare(a: DataFrame, b: DataFrame, margin: float = 0.01) -> DataFrame:
    """Two runs (name, ndcg, recall, mrr): the first measure that differs by more than margin decides."""
    x, y = a.select(*[F.col(c).alias(f"{c}_a") for c in ("name", "ndcg", "recall", "mrr")]), b.select(*[F.col(c).alias(f"{c}_b") for c in ("name", "ndcg", "recall", "mrr")])
    win = None
    for c in ("ndcg", "recall", "mrr"):
        up, down = F.col(f"{c}_a") > F.col(f"{c}_b") + margin, F.col(f"{c}_b") > F.col(f"{c}_a") + margin
        win = F.when(up, F.col("name_a")).when(down, F.col("name_b")) if win is None else win.when(up, F.col("name_a")).when(down, F.col("name_b"))
    return x.crossJoin(y).withColumn("winner", win.otherwise("tie")).withColumn("ndcg_delta", F.round(F.col("ndcg_b") - F.col("ndcg_a"), 4))

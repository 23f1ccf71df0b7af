"""Queries of graph, dashboard, curation, insights and integrity, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import dashboard as D
from folioflow.operators import graph as G
from folioflow.operators import history as H
from folioflow.operators import insights as I
from folioflow.operators import lifecycle as LC
from folioflow.operators import overlays as O
from folioflow.plans import bindings as B
from folioflow.session import shared_dir
from folioflow.sources.tables import table

Q: dict = {}
S: dict[str, str] = {}
NOW = 1709337600000000  # 2024-03-02


def count_all() -> F.Column:
    return F.count(F.lit(1))


def add(name: str, query, sql: str | None = None) -> None:
    Q[name] = query
    if sql:
        S[name] = sql


add("J1_star_join", lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(count_all().alias("n")), "SELECT n_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
add("J3_term_star_join", lambda s, d: B.chunks(s, d).select("project", "doc_type", F.explode(X.tokens(F.col("content"))).alias("token")).groupBy("project", "doc_type").agg(count_all().alias("tokens"), F.countDistinct("token").alias("terms")), f"WITH {B.CHUNKS} SELECT project, doc_type, count(*) AS tokens, count(DISTINCT token) AS terms FROM (SELECT project, doc_type, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM chunks) GROUP BY project, doc_type")


def _links(s, d):
    """Page links: source page, target path."""
    return table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


LINKS = "links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages)"


def _known(s, d):
    return _links(s, d).groupBy("target").agg(F.min("page_id").alias("page")).where("page % 2 = 0").select(F.col("target").alias("path"), "page")


KNOWN = "known AS (SELECT target AS path, min(page_id) AS page FROM links GROUP BY target HAVING min(page_id) % 2 = 0)"
add("J6_link_self_join", lambda s, d: _links(s, d).alias("l").join(_known(s, d).alias("k"), F.col("l.target") == F.col("k.path")).join(table(s, d, "pages").alias("a"), F.col("a.page_id") == F.col("l.page_id")).join(table(s, d, "pages").alias("b"), F.col("b.page_id") == F.col("k.page")).select(F.col("a.page_id").alias("source"), F.col("b.page_id").alias("target"), F.col("a.url").alias("source_url"), F.col("b.url").alias("target_url")), f"WITH {LINKS}, {KNOWN} SELECT a.page_id AS source, b.page_id AS target, a.url AS source_url, b.url AS target_url FROM links l JOIN known k ON l.target = k.path JOIN pages a ON a.page_id = l.page_id JOIN pages b ON b.page_id = k.page")
add("J7_inner_and_left_outer", lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "lineitem").where("l_linenumber = 7").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")), F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "c_name", "q"), "SELECT o_orderkey, c_name, q FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber = 7 GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
add("J8_left_chain_post_filter", lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").where("o_orderstatus = 'F' or o_orderstatus is null").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n")), "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F' OR o_orderstatus IS NULL GROUP BY c_custkey")


def _sessions(s, d):
    """One session a user: from the first signup to the first purchase after all signups, if there is one."""
    e = table(s, d, "events").select("user_id", "event_type", B.micros("ts").alias("t"))
    return e.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "signup", F.col("t"))).alias("started"), F.max(F.when(F.col("event_type") == "purchase", F.col("t"))).alias("ended"))


SESSIONS = "sess AS (SELECT user_id, epoch_us(min(ts) FILTER (WHERE event_type = 'signup')) AS started, epoch_us(max(ts) FILTER (WHERE event_type = 'purchase')) AS ended FROM events GROUP BY user_id)"


def _range(s, d):
    e = table(s, d, "events").select("user_id", "event_id", B.micros("ts").alias("t"))
    inside = (F.col("t") >= F.col("started")) & (F.col("ended").isNull() | (F.col("t") <= F.col("ended")))
    return _sessions(s, d).join(e, "user_id").where(inside).groupBy("user_id").agg(count_all().alias("n"), F.max("event_id").alias("last"))


RANGE = f"WITH {SESSIONS} SELECT s.user_id, count(*) AS n, max(event_id) AS last FROM sess s JOIN events e ON e.user_id = s.user_id AND epoch_us(ts) >= started AND (ended IS NULL OR epoch_us(ts) <= ended) GROUP BY s.user_id"
add("J9_range_join", _range, RANGE)
add("FLT12_session_audit_window", _range, RANGE)
add("J11_left_join_counts", lambda s, d: table(s, d, "customer").join(table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(count_all().alias("n")), "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders")), "SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
add("J12_left_join_group", lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_linenumber").alias("members")), "SELECT o_orderkey, count(l_linenumber) AS members FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey")
add("AGG15_collection_members", Q["J12_left_join_group"], S["J12_left_join_group"])
add("J13_scalar_subquery", lambda s, d: table(s, d, "nation").join(table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(count_all().alias("k")), "n_nationkey", "left").select("n_name", F.coalesce("k", F.lit(0)).alias("customers")), "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation")
add("J14_model_run_counts", lambda s, d: s.range(0, 12).select(F.col("id").cast("int").alias("label")).join(table(s, d, "embeddings"), "label", "left").groupBy("label").agg(F.count("vec_id").alias("n")), "SELECT CAST(r AS INTEGER) AS label, count(vec_id) AS n FROM range(12) t(r) LEFT JOIN embeddings ON label = r GROUP BY r")
add("AGG14_embedding_stats", Q["J14_model_run_counts"], S["J14_model_run_counts"])


def _trace(s, d):
    r = table(s, d, "labels").select(F.col("doc_id").alias("requirement_id"), F.when(F.col("doc_id") % 50 != 0, F.col("doc_id") % 90).alias("version")).distinct()
    dec = table(s, d, "benchmark").select(F.col("item_id").alias("decision_id"), (F.col("item_id") % 90).alias("version"), (F.col("item_id") % 20).alias("document"))
    li = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("version"), F.col("n_regionkey").cast("long").alias("document"))
    return G.linked_decisions(r, dec, li)


TRACE = "r AS (SELECT DISTINCT doc_id AS requirement_id, CASE WHEN doc_id % 50 <> 0 THEN doc_id % 90 END AS version FROM labels), dec AS (SELECT item_id AS decision_id, item_id % 90 AS version, item_id % 20 AS document FROM benchmark), li AS (SELECT n_nationkey AS version, n_regionkey AS document FROM nation), tr AS (SELECT DISTINCT requirement_id, decision_id FROM r JOIN dec ON r.version IS NULL OR r.version = dec.version OR EXISTS (SELECT 1 FROM li WHERE li.version = r.version AND li.document = dec.document))"
add("J15_or_join", _trace, f"WITH {TRACE} SELECT requirement_id, decision_id FROM tr")
add("GRF2_traceability", lambda s, d: _trace(s, d).groupBy("requirement_id").agg(count_all().alias("decisions"), F.array_join(F.transform(F.sort_array(F.collect_set("decision_id")), lambda x: x.cast("string")), ",").alias("chain")), f"WITH {TRACE} SELECT requirement_id, count(*) AS decisions, string_agg(CAST(decision_id AS VARCHAR), ',' ORDER BY decision_id) AS chain FROM tr GROUP BY requirement_id")


def _overlap(s, d):
    t = B.documents(s, d)
    spans = t.select(F.col("doc_id").alias("span_id"), "doc_id", (F.length("text") / 3).cast("long").alias("a"), (F.length("text") / 3).cast("long").alias("len")).withColumn("b", F.col("a") + 120).drop("len")
    chunks = t.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / 100).cast("int"))).alias("chunk")).withColumn("chunk", F.col("chunk").cast("long")).select("doc_id", "chunk", (F.col("chunk") * 100).alias("start"), (F.col("chunk") * 100 + 130).alias("stop"))
    return G.best_overlap(spans, chunks, "doc_id")


add("J16_best_overlap", _overlap, "WITH s AS (SELECT doc_id, length(text) // 3 AS a, length(text) // 3 + 120 AS b, greatest(length(text) - 1, 0) // 100 AS k FROM documents), c AS (SELECT doc_id, a, b, unnest(range(0, k + 1)) AS chunk FROM s), o AS (SELECT doc_id AS span_id, chunk, least(b, chunk * 100 + 130) - greatest(a, chunk * 100) AS shared FROM c WHERE shared > 0) SELECT span_id, chunk, shared FROM o QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY shared DESC, chunk) = 1")
def _shipped_together(s, d):
    """Each return flag is one long axis of days: its lines are spans from their shipping on, as long as their quantity, months of several lengths its chunks."""
    lines = table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("span_id"), "l_returnflag", F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).cast("long").alias("a"), (F.col("l_quantity") * 3).cast("long").alias("n"))
    spans = lines.groupBy("span_id", "l_returnflag", "a").agg(F.max("n").alias("n")).select("span_id", "l_returnflag", "a", (F.col("a") + F.col("n")).alias("b"))
    months = spans.groupBy("l_returnflag").agg(F.max("b").alias("z")).select("l_returnflag", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("z div 30"))).alias("chunk")).select("l_returnflag", "chunk", (F.col("chunk") * 30).alias("start"), (F.col("chunk") * 30 + 30 + F.col("chunk") % 7 * 10).alias("stop"))
    return G.best_overlap(spans, months, "l_returnflag")


add("J16_overlap_long_axis", _shipped_together, "WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS span_id, l_returnflag, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS a, max(trunc(l_quantity * 3))::BIGINT AS n FROM lineitem GROUP BY ALL), c AS (SELECT l_returnflag, k AS chunk, k * 30 AS start, k * 30 + 30 + k % 7 * 10 AS stop FROM (SELECT l_returnflag, unnest(range(0, max(a + n) // 30 + 1)) AS k FROM s GROUP BY l_returnflag)), o AS (SELECT span_id, chunk, least(a + n, stop) - greatest(a, start) AS shared FROM s JOIN c USING (l_returnflag) WHERE least(a + n, stop) > greatest(a, start)) SELECT span_id, chunk, shared FROM o QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY shared DESC, chunk) = 1")
add("J17_broken_links", lambda s, d: G.broken_links(_links(s, d), _known(s, d)), f"WITH {LINKS}, {KNOWN} SELECT page_id, target FROM links WHERE target NOT IN (SELECT path FROM known)")
add("INS2_broken_links", lambda s, d: G.broken_links(_links(s, d), _known(s, d)).groupBy("target").agg(F.countDistinct("page_id").alias("pages")), f"WITH {LINKS}, {KNOWN} SELECT target, count(DISTINCT page_id) AS pages FROM links WHERE target NOT IN (SELECT path FROM known) GROUP BY target")
add("J19_links_to_documents", lambda s, d: _links(s, d).join(_known(s, d), F.col("target") == F.col("path")).select("page_id", "target", "page"), f"WITH {LINKS}, {KNOWN} SELECT page_id, target, page FROM links JOIN known ON target = path")


def _jobs(s, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    return table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("version"), status.alias("status"), F.col("o_orderpriority").alias("priority"), B.micros("o_orderdate").alias("created"))


JOBS = "jobs AS (SELECT o_orderkey, o_custkey AS version, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END AS status, o_orderpriority AS priority, epoch_us(o_orderdate) AS created FROM orders)"
add("J20_indexing_status", lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("version")).join(_jobs(s, d).groupBy("version").agg(F.collect_set("status").alias("f")), "version", "left").select("version", D.status_fold(F.col("f")).alias("state")), f"WITH {JOBS}, f AS (SELECT version, list(DISTINCT status) AS f FROM jobs GROUP BY version) SELECT c_custkey AS version, CASE WHEN f IS NULL THEN 'pending' WHEN list_contains(f, 'queued') OR list_contains(f, 'running') THEN 'processing' ELSE 'indexed' END AS state FROM customer LEFT JOIN f ON version = c_custkey")
add("AGG11_status_fold", lambda s, d: _jobs(s, d).groupBy("version").agg(D.status_fold(F.collect_set("status")).alias("state")), f"WITH {JOBS} SELECT version, CASE WHEN bool_or(status IN ('queued', 'running')) THEN 'processing' ELSE 'indexed' END AS state FROM jobs GROUP BY version")
add("J21_source_info", lambda s, d: table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "source", "n_chars"), "doc_id", "left").select("doc_id", "quality", "source", "n_chars"), "SELECT doc_id, quality, source, n_chars FROM labels LEFT JOIN documents USING (doc_id)")
add("AGG5_jobs_pivot", lambda s, d: D.pivoted(_jobs(s, d), "priority"), f"WITH {JOBS} SELECT priority, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'completed') AS completed, 0::BIGINT AS failed, 0::BIGINT AS skipped, count(*) AS total FROM jobs GROUP BY priority")
add("TOP6_job_pick", lambda s, d: _jobs(s, d).where("status = 'queued'").orderBy("priority", "created", "o_orderkey").limit(1), f"WITH {JOBS} SELECT * FROM jobs WHERE status = 'queued' ORDER BY priority, created, o_orderkey LIMIT 1")
add("AGG3_mention_counts", lambda s, d: table(s, d, "part").join(table(s, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("p_partkey").agg(F.count("l_orderkey").alias("mentions")), "SELECT p_partkey, count(l_orderkey) AS mentions FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey")
add("AGG4_pending_candidates", lambda s, d: table(s, d, "orders").select("o_orderstatus").where("o_orderstatus = 'P'").unionByName(table(s, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_linestatus").alias("o_orderstatus"))).agg(count_all().alias("pending")), "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') + (SELECT count(*) FROM lineitem WHERE l_linestatus = 'O') AS pending")
add("AGG6_conditional_count", lambda s, d: table(s, d, "events").groupBy("user_id").agg(count_all().alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")), "SELECT user_id, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events GROUP BY user_id")
CUT = 1706486400000000
add("AGG7_hook_counts", lambda s, d: table(s, d, "events").where(B.micros("ts") >= CUT).groupBy("user_id", "event_type").agg(count_all().alias("n")), f"SELECT user_id, event_type, count(*) AS n FROM events WHERE epoch_us(ts) >= {CUT} GROUP BY ALL")
add("FLT11_recency", lambda s, d: table(s, d, "events").where(B.micros("ts") >= CUT).select("event_id", "user_id"), f"SELECT event_id, user_id FROM events WHERE epoch_us(ts) >= {CUT}")
add("AGG8_deltas_per_session", lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(count_all().alias("deltas")), "SELECT conv_id, count(*) AS deltas FROM conversations GROUP BY conv_id")
add("AGG9_flush_summary", lambda s, d: D.flush_summary(table(s, d, "events").select("user_id", "event_id", "event_type", "props"), "user_id", "event_id", "event_type", "props").select("user_id", "event_type", "n", F.array_join("values", "|").alias("first")), "WITH f AS (SELECT user_id, event_type, props, min(event_id) AS s, count(*) AS c FROM events GROUP BY ALL) SELECT user_id, event_type, CAST(sum(c) AS BIGINT) AS n, array_to_string(list(props ORDER BY s)[1:10], '|') AS first FROM f GROUP BY user_id, event_type")
add("AGG10_dirty_counters", lambda s, d: D.counters(table(s, d, "events"), "user_id", "event_type").select("user_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ",").alias("counts")), "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM c GROUP BY user_id")
add("FLT9_contains", lambda s, d: table(s, d, "part").where(F.col("p_name").ilike("%ED%") | F.col("p_type").ilike("%BRASS%")).select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ED%' OR p_type ILIKE '%BRASS%'")
add("FLT10_audit_filter", lambda s, d: table(s, d, "events").where((F.col("event_type") == "error") & (F.col("user_id") < 100)).orderBy(F.desc("ts"), F.desc("event_id")).offset(20).limit(50).select("event_id", "user_id", "event_type"), "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND user_id < 100 ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 20")
add("LIM1_offset_limit", lambda s, d: table(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).offset(100).limit(50).select("event_id"), "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
add("FLT13_candidate_status", lambda s, d: table(s, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
add("SRT1_nulls_last_desc", lambda s, d: _sessions(s, d).withColumn("r", F.row_number().over(Window.partitionBy(F.col("user_id") % 10).orderBy(F.desc_nulls_last("ended"), F.desc_nulls_last("started"), "user_id")).cast("long")).select("user_id", "r"), f"WITH {SESSIONS} SELECT user_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ended DESC NULLS LAST, started DESC NULLS LAST, user_id) AS r FROM sess")
add("SRT2_asc_nulls_last", lambda s, d: _sessions(s, d).orderBy(F.asc_nulls_last("started"), F.desc("user_id")).limit(40).select("user_id", "started"), f"WITH {SESSIONS} SELECT user_id, started FROM sess ORDER BY started ASC NULLS LAST, user_id DESC LIMIT 40")
add("SRT3_merged_candidates", lambda s, d: table(s, d, "orders").select(F.lit(0).alias("kind"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e6).alias("confidence")).unionByName(table(s, d, "part").select(F.lit(1).alias("kind"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.col("p_retailprice") / 1e4).alias("confidence"))).unionByName(table(s, d, "supplier").select(F.lit(2).alias("kind"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1e4).alias("confidence"))).orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "kind", "id").limit(100), "SELECT * FROM (SELECT 0 AS kind, o_orderkey AS id, o_totalprice / 1e6 AS confidence FROM orders UNION ALL SELECT 1, p_partkey, CASE WHEN p_size > 25 THEN p_retailprice / 1e4 END FROM part UNION ALL SELECT 2, s_suppkey, s_acctbal / 1e4 FROM supplier) ORDER BY coalesce(confidence, 0) DESC, kind, id LIMIT 100")


def _edges(s, d):
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).distinct()


EDGES = "edges AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS target FROM lineitem)"
add("SET1_union_endpoints", lambda s, d: G.endpoints(_edges(s, d)), f"WITH {EDGES} SELECT source AS node FROM edges UNION SELECT target FROM edges")
add("SET6_edges_both_ways", lambda s, d: G.both_ways(_edges(s, d)).groupBy("node", "direction").agg(count_all().alias("n")), f"WITH {EDGES} SELECT node, direction, count(*) AS n FROM (SELECT source AS node, 'outgoing' AS direction FROM edges UNION ALL SELECT target, 'incoming' FROM edges) GROUP BY ALL")
add("GRF1_entity_detail", lambda s, d: table(s, d, "supplier").select(F.col("s_suppkey").alias("node"), "s_name").join(G.both_ways(_edges(s, d)), "node").groupBy("node", "s_name").agg(F.count_if(F.col("direction") == "incoming").alias("incoming"), F.count_if(F.col("direction") == "outgoing").alias("outgoing"), F.max("other").alias("last")), f"WITH {EDGES}, b AS (SELECT source AS node, target AS other, 1 AS o FROM edges UNION ALL SELECT target, source, 0 FROM edges) SELECT s_suppkey AS node, s_name, count(*) FILTER (WHERE o = 0) AS incoming, count(*) FILTER (WHERE o = 1) AS outgoing, max(other) AS last FROM supplier JOIN b ON node = s_suppkey GROUP BY ALL")
add("GRF3_link_list", lambda s, d: _links(s, d).join(table(s, d, "pages").select("page_id", "url"), "page_id").orderBy(F.desc("page_id"), "target").limit(50).select("page_id", "url", "target"), f"WITH {LINKS} SELECT links.page_id, url, target FROM links JOIN pages ON pages.page_id = links.page_id ORDER BY links.page_id DESC, target LIMIT 50")
add("SET2_union_all", lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind")).unionByName(table(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))).groupBy("nation", "kind").agg(count_all().alias("n")), "SELECT nation, kind, count(*) AS n FROM (SELECT c_nationkey AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) GROUP BY ALL")
add("SET3_orphans", lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("blob")).subtract(table(s, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("blob"))), "SELECT p_partkey AS blob FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
add("VER13_orphan_blobs", Q["SET3_orphans"], S["SET3_orphans"])
add("SET4_intersection", lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p")).select("o_custkey", F.size(F.array_intersect("p", F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))).cast("long").alias("hits")), "SELECT o_custkey, count(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS hits FROM orders GROUP BY o_custkey")
add("SET5_missing_references", lambda s, d: table(s, d, "labels").select("doc_id").distinct().join(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti"), "SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")


def _integrity(s, d):
    docs = table(s, d, "documents").select("doc_id", "n_chars", F.length("text").cast("long").alias("len"))
    head = table(s, d, "labels").select("doc_id").distinct()
    one = lambda df, kind: df.select("doc_id", F.lit(kind).alias("finding"))
    return one(docs.where("n_chars <> len"), "hash_mismatch").unionByName(one(head.join(docs, "doc_id", "left_anti"), "missing_file")).unionByName(one(docs.join(head, "doc_id", "left_anti"), "orphan"))


add("VER8_integrity_findings", _integrity, "SELECT doc_id, 'hash_mismatch' AS finding FROM documents WHERE n_chars <> length(text) UNION ALL SELECT DISTINCT doc_id, 'missing_file' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'orphan' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
add("AGG17_stale_chunks", lambda s, d: B.saves(s, d).join(H.current(B.saves(s, d)).select("document_id", F.col("version_id").alias("head")), "document_id").where("version_id <> head").agg(count_all().alias("stale")), f"WITH {B.SAVES}, h AS (SELECT document_id, arg_max(version_id, (valid_from, version_id)) AS head FROM saves GROUP BY document_id) SELECT count(*) AS stale FROM saves JOIN h USING (document_id) WHERE version_id <> head")
add("AGG18_chunk_batches", lambda s, d: B.chunks(s, d).agg(count_all().alias("chunks"), F.ceil(count_all() / 64).alias("batches")), f"WITH {B.CHUNKS} SELECT count(*) AS chunks, CAST(ceil(count(*) / 64) AS BIGINT) AS batches FROM chunks")
add("AGG19_distinct_versions", lambda s, d: B.chunks(s, d).select("doc_id").distinct(), f"WITH {B.CHUNKS} SELECT DISTINCT doc_id FROM chunks")


def _values(s, d):
    return table(s, d, "events").select(F.col("event_type").alias("entity"), (F.col("user_id") % 20).cast("string").alias("property"), F.get_json_object("props", "$.k").alias("value"), F.col("user_id").cast("string").alias("doc"))


VALUES = "vals AS (SELECT event_type AS entity, CAST(user_id % 20 AS VARCHAR) AS property, json_extract_string(props, '$.k') AS value, CAST(user_id AS VARCHAR) AS doc FROM events)"
CONF = "SELECT {k}, array_to_string(list_sort(list(DISTINCT value)), ',') AS vals, count(DISTINCT doc) AS n_documents FROM vals WHERE value <> '' GROUP BY {k} HAVING count(DISTINCT value) > 1"
EVIDENCE = "SELECT DISTINCT {k}, value, doc FROM vals SEMI JOIN (SELECT {k} FROM vals WHERE value <> '' GROUP BY {k} HAVING count(DISTINCT value) > 1) USING ({k}) WHERE value <> ''"


def _flat() -> list:
    return [F.array_join("values", ",").alias("vals"), "n_documents"]


add("AGG12_version_conflicts", lambda s, d: I.conflicts(_values(s, d), ["entity"], "value", "doc").select("entity", *_flat()), f"WITH {VALUES} " + CONF.format(k="entity"))
add("AGG13_property_conflicts", lambda s, d: I.conflicts(_values(s, d), ["entity", "property"], "value", "doc").select("entity", "property", *_flat()), f"WITH {VALUES} " + CONF.format(k="entity, property"))
add("AGG12_conflict_evidence", lambda s, d: I.evidence(_values(s, d), ["entity"], "value", "doc"), f"WITH {VALUES} " + EVIDENCE.format(k="entity"))
add("AGG13_conflict_evidence", lambda s, d: I.evidence(_values(s, d), ["entity", "property"], "value", "doc"), f"WITH {VALUES} " + EVIDENCE.format(k="entity, property"))


def _mentions(s, d):
    raw = F.concat(F.lit("redis v"), (F.col("doc_id") % 3).cast("string"), F.lit("."), (F.col("doc_id") % 5).cast("string"), F.lit(", stable"))
    return B.documents(s, d).select(F.col("project").alias("entity"), X.version_token(raw).alias("version"), F.col("doc_id").cast("string").alias("doc"))


add("INS4_contradictions", lambda s, d: I.conflicts(_mentions(s, d), ["entity"], "version", "doc").select("entity", *_flat()), "WITH vals AS (SELECT source AS entity, (doc_id % 3) || '.' || (doc_id % 5) AS value, CAST(doc_id AS VARCHAR) AS doc FROM documents) " + CONF.format(k="entity"))


def _ages(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", B.micros("ts"))).alias("updated"))


AGES = "ages AS (SELECT user_id, epoch_us(max(ts) FILTER (WHERE event_type = 'view')) AS updated FROM events GROUP BY user_id)"
add("INS1_stale_documents", lambda s, d: I.aged(_ages(s, d), "updated", NOW, 32, "info", "warning", 34), f"WITH {AGES}, a AS (SELECT *, ({NOW} - updated) // 86400000000 AS age_days FROM ages) SELECT user_id, updated, age_days, CASE WHEN age_days < 34 THEN 'info' ELSE 'warning' END AS severity FROM a WHERE age_days > 32")
add("INS3_aged_questions", lambda s, d: I.aged(table(s, d, "events").where("event_type = 'signup'").select("event_id", B.micros("ts").alias("created")), "created", NOW, 30, "warning", "critical", 50), f"WITH a AS (SELECT event_id, epoch_us(ts) AS created, ({NOW} - epoch_us(ts)) // 86400000000 AS age_days FROM events WHERE event_type = 'signup') SELECT event_id, created, age_days, CASE WHEN age_days < 50 THEN 'warning' ELSE 'critical' END AS severity FROM a WHERE age_days > 30")


def _insights(s, d):
    c = I.conflicts(_values(s, d), ["entity", "property"], "value", "doc").select(F.concat_ws(".", "entity", "property").alias("title"), F.lit("contradiction").alias("kind"), F.lit("warning").alias("severity"))
    b = G.broken_links(_links(s, d), _known(s, d)).select(F.concat(F.lit("broken "), "target").alias("title"), F.lit("broken_link").alias("kind"), F.lit("info").alias("severity"))
    known = c.where("title like 'click.%'").select("title")
    return I.new_insights(c.unionByName(b), known)


INSIGHTS = f"WITH {VALUES}, {LINKS}, {KNOWN} SELECT entity || '.' || property AS title, 'contradiction' AS kind, 'warning' AS severity FROM vals WHERE value <> '' AND entity <> 'click' GROUP BY entity, property HAVING count(DISTINCT value) > 1 UNION ALL SELECT DISTINCT 'broken ' || target, 'broken_link', 'info' FROM links WHERE target NOT IN (SELECT path FROM known)"
add("INS5_insight_run", _insights, INSIGHTS)
add("J18_new_titles", _insights, INSIGHTS)
add("UI3_inbox_sort", lambda s, d: table(s, d, "orders").select("o_orderkey", X.severity(F.col("o_totalprice") / 500000).alias("severity"), (F.col("o_totalprice") / 500000).alias("confidence")).orderBy(F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2), F.desc("confidence"), "o_orderkey").limit(60), "SELECT o_orderkey, CASE WHEN o_totalprice / 500000 >= 0.9 THEN 'high' WHEN o_totalprice / 500000 >= 0.7 THEN 'medium' ELSE 'low' END AS severity, o_totalprice / 500000 AS confidence FROM orders ORDER BY confidence DESC, o_orderkey LIMIT 60")
add("TXT25_severity", lambda s, d: table(s, d, "orders").groupBy(X.severity(F.col("o_totalprice") / 500000).alias("severity")).agg(count_all().alias("n")), "SELECT CASE WHEN o_totalprice / 500000 >= 0.9 THEN 'high' WHEN o_totalprice / 500000 >= 0.7 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM orders GROUP BY 1")
add("UI4_palette_search", lambda s, d: table(s, d, "customer").where(F.contains(F.lower("c_name"), F.lit("01")) | F.contains(F.lower("c_mktsegment"), F.lit("mach"))).orderBy("c_custkey").limit(6).select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '01') OR contains(lower(c_mktsegment), 'mach') ORDER BY c_custkey LIMIT 6")
add("UI5_dashboard_counters", lambda s, d: _sessions(s, d).agg(count_all().alias("sessions"), F.count_if(F.col("ended").isNull()).alias("open"), F.count_if(F.coalesce(X.age_days(F.lit(NOW), F.col("started")) > 14, F.lit(True))).alias("stale")), f"WITH {SESSIONS} SELECT count(*) AS sessions, count(*) FILTER (WHERE ended IS NULL) AS open, count(*) FILTER (WHERE started IS NULL OR ({NOW} - started) // 86400000000 > 14) AS stale FROM sess")
add("UI6_folder_tree", lambda s, d: G.folder_tree(table(s, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"\?.*$", "").alias("path"))), "WITH p AS (SELECT string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '\\?.*$', ''), '/') AS l FROM pages), e AS (SELECT l, unnest(range(1, len(l))) AS i FROM p) SELECT DISTINCT array_to_string(l[1:i], '/') AS folder FROM e")
add("UI7_distinct_types", lambda s, d: table(s, d, "events").select("event_type").distinct().orderBy("event_type"), "SELECT DISTINCT event_type FROM events")
add("STR8_heartbeat", lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.max(B.micros("ts")).alias("seen")).withColumn("stale", F.lit(1706659200000000) - F.col("seen") > 60_000_000_000), "SELECT user_id, epoch_us(max(ts)) AS seen, 1706659200000000 - epoch_us(max(ts)) > 60000000000 AS stale FROM events GROUP BY user_id")


def _lifecycle(s, d):
    """Users are sessions: sign-ups and their first events open them, views are preflights, clicks deltas, purchases flushes and errors attempts to end."""
    e = table(s, d, "events").select(F.col("user_id").alias("session"), B.micros("ts").alias("at"), F.col("event_id").alias("seq"), "event_type")
    kinds = {"view": "preflight", "click": "delta", "purchase": "flush", "error": "finalize"}
    kind = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in kinds.items()], F.lit("start"))
    return LC.status(e.select("session", "at", "seq", kind.alias("kind"), F.concat(F.lit("d"), (F.col("seq") % 3).cast("string")).alias("detail")))


LIFE = "e AS (SELECT user_id AS session, epoch_us(ts) AS t, event_id AS seq, CASE event_type WHEN 'view' THEN 'preflight' WHEN 'click' THEN 'delta' WHEN 'purchase' THEN 'flush' WHEN 'error' THEN 'finalize' ELSE 'start' END AS kind, 'd' || event_id % 3 AS detail FROM events), f AS (SELECT *, count(*) FILTER (WHERE kind = 'flush') OVER (PARTITION BY session ORDER BY t, seq) AS fl FROM e), g AS (SELECT *, count(*) FILTER (WHERE kind = 'delta') OVER (PARTITION BY session, fl ORDER BY t, seq) AS u FROM f), h AS (SELECT *, coalesce(bool_or(kind = 'finalize' AND u = 0) OVER (PARTITION BY session ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over_ FROM g), live AS (SELECT *, max(fl) OVER (PARTITION BY session) AS lastf FROM h WHERE NOT over_)"
add("STR6_session_lifecycle", lambda s, d: _lifecycle(s, d).select("session", "status", "is_dirty", "unflushed", F.coalesce(F.to_json("dirty_reasons"), F.lit("{}")).alias("reasons"), "last_preflight_at", "last_preflight_action", "last_flush_at", "started_at", "ended_at", "blocked"), f"WITH {LIFE}, r AS (SELECT session, sum(n)::BIGINT AS unflushed, '{{' || string_agg('\"' || detail || '\":' || n, ',' ORDER BY detail) || '}}' AS reasons FROM (SELECT session, detail, count(*) AS n FROM live WHERE kind = 'delta' AND fl = lastf GROUP BY ALL) GROUP BY session) SELECT l.session, CASE WHEN bool_or(kind = 'finalize' AND u = 0) THEN 'finalized' ELSE 'active' END AS status, coalesce(any_value(r.unflushed), 0) > 0 AS is_dirty, coalesce(any_value(r.unflushed), 0)::BIGINT AS unflushed, coalesce(any_value(reasons), '{{}}') AS reasons, max(t) FILTER (WHERE kind = 'preflight') AS last_preflight_at, arg_max(detail, (t, seq)) FILTER (WHERE kind = 'preflight') AS last_preflight_action, max(t) FILTER (WHERE kind = 'flush') AS last_flush_at, min(t) FILTER (WHERE kind = 'start') AS started_at, min(t) FILTER (WHERE kind = 'finalize' AND u = 0) AS ended_at, count(*) FILTER (WHERE kind = 'finalize' AND u > 0) AS blocked FROM live l LEFT JOIN r ON r.session = l.session GROUP BY l.session HAVING started_at IS NOT NULL")


def _collected(s, d):
    """A collection for each source and language, of its documents, some of them added twice and some removed again; one collection is deleted."""
    docs = table(s, d, "documents").where("source is not null and lang is not null").select(F.col("doc_id").alias("document"), F.col("source").alias("project"), "lang")
    named = docs.withColumn("collection", F.concat("project", F.lit("/"), "lang")).withColumn("added_at", F.col("document"))
    own = O.Collections(s, shared_dir(s)).create()
    own.put(named.groupBy("collection", "project").agg(F.first("lang").alias("name"), F.min("document").alias("created_at")))
    own.add(named, docs)
    own.add(named.where("document % 2 = 0").withColumn("added_at", F.col("document") + 1), docs)
    own.add(named.where("document % 3 = 0").withColumn("collection", F.lit("src0/en")), docs)
    own.remove(named.where("document % 5 = 1"))
    own.delete(named.where("collection like '%/fr'").select("collection"))
    return own.listed().select("collection", "name", "members")


add("J12_kept_collections", _collected, "WITH d AS (SELECT doc_id, source, lang, source || '/' || lang AS c FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL), h AS (SELECT c, any_value(lang) AS name, any_value(source) AS source FROM d GROUP BY c), m AS (SELECT c, doc_id FROM d UNION SELECT 'src0/en', doc_id FROM d WHERE doc_id % 3 = 0 AND source = 'src0' AND 'src0/en' IN (SELECT c FROM h)), k AS (SELECT m.* FROM m LEFT JOIN d USING (c, doc_id) WHERE d.doc_id IS NULL OR m.doc_id % 5 <> 1) SELECT h.c AS collection, name, count(k.doc_id) AS members FROM h LEFT JOIN k ON k.c = h.c WHERE h.c NOT LIKE '%/fr' GROUP BY h.c, name")


def _cited(s, d):
    """Each document cited by the lines that its number gives; some of projects or versions that aren't there."""
    t = table(s, d, "documents").where("source is not null")
    texts = t.select(F.col("source").alias("project"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.lit(1).alias("version"), "text")
    refs = t.select(F.col("doc_id").alias("ref_id"), F.when(F.col("doc_id") % 10 == 7, "gone").otherwise(F.col("source")).alias("project"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 10 == 8, 2).otherwise(1).alias("version"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3).cast("int").alias("first"), (F.col("doc_id") % 4).cast("int").alias("last"))
    return O.resolved(refs, texts).select("ref_id", F.md5("content").alias("content"), "error")


add("PRJ6_citations_resolved", _cited, "WITH r AS (SELECT doc_id AS ref_id, source, text, string_split(text, chr(10)) AS l, CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 ELSE 1 END AS a, doc_id % 4 AS z FROM documents WHERE source IS NOT NULL), e AS (SELECT *, least(z, len(l)) AS b, CASE WHEN ref_id % 10 = 7 THEN 'project gone not found' WHEN ref_id % 10 = 8 OR text IS NULL THEN 'source not found' WHEN least(z, len(l)) < a THEN 'no such lines' END AS error FROM r) SELECT ref_id, CASE WHEN error IS NULL THEN md5('[' || source || ']' || chr(10) || array_to_string(l[a:b], chr(10)) || chr(10) || '[end]') END AS content, error FROM e")


def _entity_details(s, d):
    """Suppliers as entities, mentioned by line items and joined in a tree; the wanted are those of every third nation."""
    ents = table(s, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.lit("supplier").alias("kind"), F.col("s_name").alias("name"))
    said = table(s, d, "lineitem").select(F.col("l_suppkey").alias("entity"), "l_orderkey")
    edges = table(s, d, "supplier").where("s_suppkey > 1").select(F.col("s_suppkey").alias("source"), F.floor(F.col("s_suppkey") / 2).cast("long").alias("target"), F.lit("above").alias("kind"))
    heads, _, ways = G.entity_detail(ents, said, edges, table(s, d, "supplier").where("s_nationkey % 3 = 0").select(F.col("s_suppkey").alias("entity")))
    n = ways.groupBy("entity").agg(F.count_if(F.col("direction") == "outgoing").alias("out"), F.count_if(F.col("direction") == "incoming").alias("in"), F.max("other_name").alias("last"))
    return heads.join(n, "entity", "left").select("entity", "name", "mentions", F.coalesce("out", F.lit(0).cast("long")).alias("n_out"), F.coalesce("in", F.lit(0).cast("long")).alias("n_in"), "last")


add("GRF1_entity_details", _entity_details, "WITH w AS (SELECT s_suppkey AS e, s_name AS name FROM supplier WHERE s_nationkey % 3 = 0), m AS (SELECT l_suppkey AS e, count(*) AS n FROM lineitem GROUP BY 1), g AS (SELECT s_suppkey AS a, s_suppkey // 2 AS b FROM supplier WHERE s_suppkey > 1), x AS (SELECT a AS e, b AS o, 1 AS k FROM g UNION ALL SELECT b, a, 0 FROM g), y AS (SELECT e, count(*) FILTER (WHERE k = 1) AS n_out, count(*) FILTER (WHERE k = 0) AS n_in, max(s_name) AS last FROM x LEFT JOIN supplier ON s_suppkey = o GROUP BY e) SELECT w.e AS entity, name, coalesce(n, 0) AS mentions, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, last FROM w LEFT JOIN m USING (e) LEFT JOIN y USING (e)")

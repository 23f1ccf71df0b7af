"""Queries of version history and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import history as H
from folioflow.operators import jobs as J
from folioflow.operators.stored import StoredHistory, StoredTable
from folioflow.plans import bindings as B
from folioflow.session import shared_dir
from folioflow.sources.tables import table

AS_OF = 1705320000000000  # 2024-01-15 12:00 UTC
Q: dict = {}
S: dict[str, str] = {}

Q["WIN3_head_events"] = lambda s, d: B.heads(s, d)
S["WIN3_head_events"] = f"WITH {B.HEADS} SELECT document_id, branch, version_id, valid_from, event_type, valid_to FROM heads"

Q["FLT1_current_scope"] = lambda s, d: H.scope(B.heads(s, d), "current")
S["FLT1_current_scope"] = f"WITH {B.SAVES} SELECT document_id, branch, version_id FROM saves WHERE event_type = 'save' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY valid_from DESC, version_id DESC) = 1"

Q["FLT2_all_scope"] = lambda s, d: H.scope(B.heads(s, d), "all")
S["FLT2_all_scope"] = f"WITH {B.SAVES} SELECT document_id, branch, version_id FROM saves WHERE event_type = 'save'"

Q["FLT3_as_of_scope"] = lambda s, d: H.scope(B.heads(s, d), "as_of", AS_OF)
S["FLT3_as_of_scope"] = f"WITH {B.HEADS} SELECT document_id, branch, version_id FROM heads WHERE event_type = 'save' AND valid_from <= {AS_OF} AND (valid_to IS NULL OR valid_to > {AS_OF})"

Q["FLT4_branch_scope"] = lambda s, d: H.scope(B.heads(s, d), "branch", "dev")
S["FLT4_branch_scope"] = f"WITH {B.HEADS} SELECT document_id, branch, version_id FROM heads WHERE event_type = 'save' AND branch = 'dev' AND valid_to IS NULL"

Q["FLT5_snapshot_scope"] = lambda s, d: H.snapshot(B.documents(s, d).select("project", "doc_id", F.sha2("text", 256).alias("content_hash")), B.documents(s, d).where("doc_id % 7 = 0").select("project", "doc_id", F.sha2("text", 256).alias("content_hash")), ["project", "doc_id", "content_hash"])
S["FLT5_snapshot_scope"] = "SELECT source AS project, doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 7 = 0"


def _paths(s, d):
    return B.documents(s, d).select("doc_id", F.concat(F.lit("docs/"), F.col("project"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))


Q["FLT6_path_override"] = lambda s, d: H.path_override(_paths(s, d), B.documents(s, d).where("doc_id % 4 = 0").select("doc_id", F.concat(F.lit("old/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")), "doc_id", "path")
S["FLT6_path_override"] = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'old/d' || doc_id || '.md' ELSE 'docs/' || source || '/d' || doc_id || '.md' END AS path FROM documents"

Q["FLT7_project_filter"] = lambda s, d: B.documents(s, d).where(F.col("project") == "src3").select("doc_id", "doc_type", "status")
S["FLT7_project_filter"] = f"WITH {B.DOCUMENTS} SELECT doc_id, doc_type, status FROM docs WHERE project = 'src3'"

Q["FLT8_type_filter"] = lambda s, d: B.documents(s, d).where(F.col("doc_type").isin("de", "fr")).select("doc_id", "doc_type")
S["FLT8_type_filter"] = f"WITH {B.DOCUMENTS} SELECT doc_id, doc_type FROM docs WHERE doc_type IN ('de', 'fr')"

Q["J4_scope_semi_join"] = lambda s, d: table(s, d, "events").select("event_id", "user_id", "value").join(H.scope(B.heads(s, d), "branch", "main").select(F.col("version_id").alias("event_id")), "event_id", "left_semi")
S["J4_scope_semi_join"] = f"WITH {B.HEADS} SELECT event_id, user_id, value FROM events WHERE event_id IN (SELECT version_id FROM heads WHERE event_type = 'save' AND branch = 'main' AND valid_to IS NULL)"

Q["J5_multi_key_membership"] = lambda s, d: table(s, d, "lineitem").join(table(s, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_partkey", "l_linenumber").distinct(), ["l_orderkey", "l_partkey", "l_linenumber"]).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
S["J5_multi_key_membership"] = "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem JOIN (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_quantity > 45) USING (l_orderkey, l_partkey, l_linenumber)"


def _as_of_join(s, d):
    """For each probe (a purchase), the version of its document that was valid then."""
    probes = table(s, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("probe_id"), F.col("user_id").alias("document_id"), B.micros("ts").alias("at"))
    main = B.heads(s, d).where("branch = 'dev'").select("document_id", "version_id", "valid_from", "valid_to")
    return H.as_of(probes, main, ["document_id"], "at", "valid_from", "valid_to", ["version_id"]).select("probe_id", "document_id", "version_id")


Q["J10_as_of_join"] = _as_of_join
S["J10_as_of_join"] = f"WITH {B.HEADS} SELECT e.event_id AS probe_id, h.document_id, h.version_id FROM events e JOIN heads h ON h.document_id = e.user_id AND h.branch = 'dev' AND h.valid_from <= epoch_us(e.ts) AND (h.valid_to IS NULL OR h.valid_to > epoch_us(e.ts)) WHERE e.event_type = 'purchase'"

def _as_of_one_key(s, d):
    """All lines of all orders as the versions and probes of a few keys: for each probe (an odd line) what an even one last set for its return flag."""
    lines = table(s, d, "lineitem").select("l_returnflag", F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).cast("long").alias("day"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_quantity")
    one = lines.groupBy("l_returnflag", "day", "line").agg(F.max("l_quantity").alias("l_quantity"))
    kept = one.where("line % 2 = 0").select("l_returnflag", F.col("day").alias("valid_from"), F.col("line").alias("version"), F.col("l_quantity").alias("quantity"), F.lit(None).cast("long").alias("valid_to"))
    probes = one.where("line % 2 = 1").select("l_returnflag", "day", F.col("line").alias("probe"))
    return H.as_of(probes, kept, ["l_returnflag"], "day", "valid_from", "valid_to", ["version"], hot=1000).select("l_returnflag", "probe", "version", "quantity")


Q["J10_as_of_hot_keys"] = _as_of_one_key
S["J10_as_of_hot_keys"] = "WITH o AS (SELECT l_returnflag, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS day, l_orderkey * 10 + l_linenumber AS line, max(l_quantity) AS quantity FROM lineitem GROUP BY ALL), r AS (SELECT l_returnflag, line, last_value(CASE WHEN line % 2 = 0 THEN {'line': line, 'quantity': quantity} END IGNORE NULLS) OVER (PARTITION BY l_returnflag ORDER BY day, line % 2, line ROWS UNBOUNDED PRECEDING) AS v FROM o) SELECT l_returnflag, line AS probe, v.line AS version, v.quantity AS quantity FROM r WHERE line % 2 = 1 AND v IS NOT NULL"

Q["WIN4_latest_text"] = lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.max_by("props", F.struct("ts", "event_id")).alias("props"))
S["WIN4_latest_text"] = "SELECT user_id, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY user_id"

Q["WIN5_branch_head"] = lambda s, d: B.saves(s, d).groupBy("document_id", "branch").agg(F.max_by("version_id", F.struct("valid_from", "version_id")).alias("version_id"))
S["WIN5_branch_head"] = f"WITH {B.SAVES} SELECT document_id, branch, arg_max(version_id, (valid_from, version_id)) AS version_id FROM saves GROUP BY ALL"


def _states(s, d):
    return table(s, d, "events").select("user_id", "event_id", B.micros("ts").alias("at_us"), F.col("event_type").alias("state"))


Q["WIN6_version_numbers"] = lambda s, d: H.numbered(_states(s, d), ["user_id"], ["at_us", "event_id"], "state")
S["WIN6_version_numbers"] = "WITH c AS (SELECT user_id, event_id, epoch_us(ts) AS at_us, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT user_id, event_id, at_us, state, row_number() OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS version_number FROM c WHERE b IS DISTINCT FROM state"

Q["WIN7_first_seen"] = lambda s, d: H.first_seen(table(s, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h")), ["h"], ["doc_id"])
S["WIN7_first_seen"] = "SELECT doc_id, source, sha256(text) AS h FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"

Q["VER1_upsert_fold"] = lambda s, d: H.numbered(_states(s, d).where("state <> 'view'"), ["user_id"], ["at_us", "event_id"], "state").groupBy("user_id").agg(F.max("version_number").alias("versions"), F.max_by("event_id", "version_number").alias("head"), F.min("at_us").alias("first_at"))
S["VER1_upsert_fold"] = "WITH c AS (SELECT user_id, event_id, ts, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events WHERE event_type <> 'view') SELECT user_id, count(*) AS versions, arg_max(event_id, (ts, event_id)) AS head, epoch_us(min(ts)) AS first_at FROM c WHERE b IS DISTINCT FROM state GROUP BY user_id"


def _moves(s, d):
    e = B.saves(s, d).where("event_type = 'save' and version_id % 3 = 0")
    path = lambda p: F.concat(F.lit(p), F.col("document_id").cast("string"), F.lit(".md"))
    return H.moved(e, path("old/"), path("new/"))


Q["VER2_move"] = _moves
S["VER2_move"] = f"WITH {B.SAVES} SELECT document_id, version_id, valid_from, 'new/' || document_id || '.md' AS path, 'save' AS kind, CAST(NULL AS BIGINT) AS valid_to FROM saves WHERE event_type = 'save' AND version_id % 3 = 0 UNION ALL SELECT document_id, version_id, valid_from, 'old/' || document_id || '.md', 'delete', valid_from FROM saves WHERE event_type = 'save' AND version_id % 3 = 0"

CLOSE = 1710000000000000
Q["VER3_soft_delete"] = lambda s, d: H.soft_delete(B.heads(s, d), B.saves(s, d).select("document_id").distinct().where("document_id % 4 = 0").withColumn("at", F.lit(CLOSE)))
S["VER3_soft_delete"] = f"WITH {B.HEADS} SELECT document_id, branch, version_id, valid_from, event_type, CASE WHEN document_id % 4 = 0 AND event_type = 'save' AND valid_to IS NULL THEN {CLOSE} ELSE valid_to END AS valid_to FROM heads UNION ALL SELECT document_id, branch, version_id, {CLOSE}, 'delete', {CLOSE} FROM heads WHERE document_id % 4 = 0 AND event_type = 'save' AND valid_to IS NULL"


def _restore(s, d):
    """Every document goes back to its first version: a new version with that content."""
    e = B.saves(s, d).where("event_type = 'save'")
    first = e.groupBy("document_id").agg(F.min_by("version_id", F.struct("valid_from", "version_id")).alias("version_id"))
    return H.restored(e, first)


Q["VER4_restore"] = _restore
S["VER4_restore"] = f"WITH {B.SAVES} SELECT document_id, arg_min(version_id, (valid_from, version_id)) AS restored_from, count(*) + 1 AS version_number FROM saves WHERE event_type = 'save' GROUP BY document_id"

Q["VER5_rebuild_heads"] = lambda s, d: B.heads(s, d).where("event_type = 'save'").groupBy("document_id").agg(F.max_by(F.struct("version_id", "branch"), F.struct("valid_from", "version_id")).alias("h"), F.sum(F.col("valid_to").isNull().cast("long")).alias("open")).select("document_id", "h.version_id", "h.branch", "open")
S["VER5_rebuild_heads"] = f"WITH {B.HEADS} SELECT document_id, arg_max(version_id, (valid_from, version_id)) AS version_id, arg_max(branch, (valid_from, version_id)) AS branch, CAST(count(*) FILTER (WHERE valid_to IS NULL) AS BIGINT) AS open FROM heads WHERE event_type = 'save' GROUP BY document_id"

def _history(s, d):
    """Head events as a stream of saves folds them into a stored table: the last third comes first, and one third comes twice."""
    out = shared_dir(s)
    stored = StoredHistory(s, f"{out}/heads").create()
    saves = B.saves(s, d)
    for k in (2, 0, 0, 1):
        saves.where(f"pmod(version_id div 7, 3) = {k}").write.mode("append").parquet(f"{out}/in")
        q = s.readStream.schema(saves.schema).parquet(f"{out}/in").writeStream.foreachBatch(stored.sink).option("checkpointLocation", f"{out}/state")
        q.trigger(availableNow=True).start().awaitTermination()
    return stored


Q["VER1_stored_history"] = lambda s, d: _history(s, d).read()
S["VER1_stored_history"] = S["WIN3_head_events"]
Q["VER5_stored_heads"] = lambda s, d: _history(s, d).read().where("event_type = 'save'").groupBy("document_id").agg(F.max_by(F.struct("version_id", "branch"), F.struct("valid_from", "version_id")).alias("h"), F.sum(F.col("valid_to").isNull().cast("long")).alias("open")).select("document_id", "h.version_id", "h.branch", "open")
S["VER5_stored_heads"] = S["VER5_rebuild_heads"]

Q["VER6_folder_rename"] = lambda s, d: H.folder_renamed(_paths(s, d), "path", "docs/src1", "docs/moved")
S["VER6_folder_rename"] = "WITH p AS (SELECT doc_id, 'docs/' || source || '/d' || doc_id || '.md' AS path FROM documents) SELECT doc_id, path, 'docs/moved/' || substring(path, 11) AS new_path FROM p WHERE starts_with(path, 'docs/src1/')"


def _reconcile(s, d):
    files = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    heads = files.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "stale").otherwise(F.col("hash")).alias("hash"))
    return H.reconcile(files, heads, "doc_id", "hash")


Q["VER7_reconcile"] = _reconcile
S["VER7_reconcile"] = "SELECT doc_id, sha256(text) AS hash, CASE WHEN doc_id % 3 = 0 THEN 'create' ELSE 'update' END AS action FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0"


def _upsert(s, d):
    new = table(s, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("sig"))
    old = table(s, d, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("sig"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("candidate").alias("status"))
    return H.upsert_plan(new, old, ["sig"], "status")


Q["VER9_candidate_upsert"] = _upsert
S["VER9_candidate_upsert"] = "WITH n AS (SELECT o_orderkey AS sig FROM orders WHERE o_orderkey % 3 <> 0), o AS (SELECT o_orderkey AS sig, CASE WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'candidate' END AS status FROM orders WHERE o_orderkey % 4 <> 0) SELECT coalesce(n.sig, o.sig) AS sig, status, CASE WHEN o.sig IS NULL THEN 'insert' WHEN n.sig IS NOT NULL THEN 'update' WHEN status = 'candidate' THEN 'delete' ELSE 'keep' END AS action FROM n FULL JOIN o ON n.sig = o.sig"



def _decided(s, d):
    """Every sixth order is decided with another priority."""
    own = table(s, d, "orders").select("o_orderkey", "o_orderpriority")
    return H.decided(own, own.where("o_orderkey % 6 = 0").withColumn("o_orderpriority", F.lit("1-URGENT")), "o_orderkey", "o_orderpriority").select("o_orderkey", "status")


Q["VER10_accept_or_edit"] = _decided
S["VER10_accept_or_edit"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 AND o_orderpriority IS DISTINCT FROM '1-URGENT' THEN 'edited' ELSE 'accepted' END AS status FROM orders"



def _replaced(s, d):
    """A stored table of labels in which those of all French documents are replaced."""
    own = StoredTable(s, shared_dir(s), ["doc_id"], "doc_id long, quality int").create()
    own.replace(table(s, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")))
    return own.replace(table(s, d, "documents").where("lang = 'fr'").select("doc_id", F.lit(9).alias("quality"))).read()


Q["VER11_replace_by_key"] = _replaced
S["VER11_replace_by_key"] = "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr') UNION ALL SELECT doc_id, 9 FROM documents WHERE lang = 'fr'"

Q["VER12_get_or_create"] = lambda s, d: H.get_or_create(table(s, d, "events").select("event_type", "user_id", B.micros("ts").alias("at"), "event_id", F.col("props").alias("metadata")), ["event_type", "user_id"], "at", ["event_id"], "metadata")
S["VER12_get_or_create"] = "SELECT event_type, user_id, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen, arg_min(props, (ts, event_id)) AS metadata FROM events GROUP BY event_type, user_id"


def _follow_ups(s, d):
    """Extractions and chunkings of every document and the jobs that follow them; those of every seventh version are queued already."""
    docs = table(s, d, "documents")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("md", "sql", "pdf")]), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = docs.select(F.col("source").alias("project"), F.col("doc_id").alias("version"), F.concat(F.lit("docs/d."), kind).alias("path"), F.md5("text").alias("content_hash"), F.when(F.col("doc_id") % 4 == 0, "chunk").otherwise("extract").alias("job_type"), F.when(kind == "pdf", "unsupported").otherwise("raw").alias("text_kind"))
    found = J.fan_out(rows, models=("ner",))
    return J.to_queue(found, found.where("version % 7 = 0").select("key")).select("version", "job_type", "priority", "status")


Q["VER14_job_fan_out"] = _follow_ups
S["VER14_job_fan_out"] = "SELECT doc_id AS version, f.job_type, f.priority, 'queued' AS status FROM documents, (VALUES ('extract', 'chunk', 1), ('extract', 'extract_candidates', 3), ('extract', 'ner_gliner', 3), ('extract', 'link_detect', 3), ('extract', 'schema_parse', 3), ('chunk', 'technical_terms', 1), ('chunk', 'embed', 2)) f(after, job_type, priority) WHERE f.after = CASE WHEN doc_id % 4 = 0 THEN 'chunk' ELSE 'extract' END AND (f.after = 'chunk' OR doc_id % 3 <> 2) AND (f.job_type <> 'schema_parse' OR doc_id % 3 = 1) AND doc_id % 7 <> 0"

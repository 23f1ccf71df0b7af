"""Queries of streams, sources and sinks, and their DuckDB twins."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from folioflow.plans import bindings as B
from folioflow.plans import retrieval_queries as R
from folioflow.session import shared_dir
from folioflow.sources import bundles as BU
from folioflow.sources import files as X
from folioflow.sources.tables import table
from folioflow.streaming import sessions as T
from folioflow.streaming import stateful as ST

Q: dict = {}
S: dict[str, str] = {}


def count_all() -> F.Column:
    return F.count(F.lit(1))


def add(name: str, query, sql: str | None = None) -> None:
    Q[name] = query
    if sql:
        S[name] = sql


def _events(s, d):
    return table(s, d, "events").select("user_id", "event_id", "event_type", B.micros("ts").alias("at_us"))


GAP = 1800_000_000
SLICES = 3
add("STR1_debounce", lambda s, d: T.debounced(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "30 minutes").select("user_id", "n", B.micros("first").alias("first"), B.micros("last").alias("last")), f"WITH e AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, t, sum(CASE WHEN b IS NULL OR t - b > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS k FROM e) SELECT user_id, count(*) AS n, min(t) AS first, max(t) AS last FROM g GROUP BY user_id, k")
add("STR2_change_only", lambda s, d: T.changed(_events(s, d), "user_id", ["at_us", "event_id"], "event_type"), "WITH c AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS at_us, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT user_id, event_id, event_type, at_us FROM c WHERE b IS DISTINCT FROM event_type")
RATE = "WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), f AS (SELECT user_id, k, [t] AS w, true AS ok FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, CASE WHEN len(list_filter(f.w, lambda x: x > e.t - 86400000000)) < 2 THEN list_append(list_filter(f.w, lambda x: x > e.t - 86400000000), e.t) ELSE f.w END, len(list_filter(f.w, lambda x: x > e.t - 86400000000)) < 2 FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)"
add("STR4_rate_limit", lambda s, d: T.rate_limited(_events(s, d), "user_id", "at_us", "event_id", 2, 86400).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), count_all().alias("n")), f"{RATE} SELECT user_id, count(*) FILTER (WHERE ok) AS allowed, count(*) AS n FROM f GROUP BY user_id")
DAY = 86_400_000_000
add("STR5_idempotency_ttl", lambda s, d: T.first_in_ttl(_events(s, d), ["user_id", "event_type"], "at_us", "event_id", DAY), f"WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t FROM events), f AS (SELECT user_id, event_type, arg_min(event_id, (t, event_id)) AS event_id, min(t) AS t FROM e GROUP BY user_id, event_type UNION ALL SELECT * FROM (SELECT f.user_id, f.event_type, arg_min(e.event_id, (e.t, e.event_id)) AS event_id, min(e.t) AS t FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.t - f.t >= {DAY} GROUP BY f.user_id, f.event_type, f.t)) SELECT user_id, event_type, event_id FROM f")
NOW = 1706659200000000
add("STR6_session_state", lambda s, d: T.sessions(_events(s, d).withColumn("kind", F.when(F.col("event_type") == "purchase", "flush").otherwise(F.col("event_type"))), "user_id", "at_us", "kind", NOW, DAY), f"WITH g AS (SELECT user_id, epoch_us(max(ts) FILTER (WHERE event_type = 'purchase')) AS flushed, epoch_us(max(ts) FILTER (WHERE event_type <> 'purchase')) AS touched, count(*) FILTER (WHERE event_type <> 'purchase') AS deltas FROM events GROUP BY user_id) SELECT *, CASE WHEN greatest(flushed, touched) < {NOW} - {DAY} THEN 'abandoned' WHEN touched > coalesce(flushed, -1) THEN 'dirty' ELSE 'clean' END AS state FROM g")
add("STR7_write_barrier", lambda s, d: T.barrier(_events(s, d), "user_id", "at_us", "event_id", F.col("event_type") == "purchase", F.col("event_type") == "view", DAY).select("user_id", "event_id", "checked_at", "open"), f"WITH w AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS t, max(CASE WHEN event_type = 'view' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS checked_at FROM events) SELECT user_id, event_id, checked_at, coalesce(t - checked_at <= {DAY}, false) AS open FROM w WHERE event_type = 'purchase'")


@contextmanager
def _rocks(s):
    """The state store that stateful processors need, for the streams started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key, None)
    s.conf.set(key, T.ROCKS)
    try:
        yield
    finally:
        s.conf.unset(key) if before is None else s.conf.set(key, before)


def _streamed(s, d):
    """STR2 as a stream over the events file until it is read whole; equal to its batch form."""
    out = shared_dir(s)
    schema = table(s, d, "events").schema
    rows = T.event_stream(s, d, schema, pathGlobFilter="events.parquet").select("user_id", "event_id", "event_type", F.unix_micros("ts").alias("at_us"))
    with _rocks(s):
        q = T.changed_stream(rows, "user_id", ["at_us", "event_id"], "event_type").writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
        q.awaitTermination()
    got = s.read.parquet(f"{out}/rows")
    return got.select("user_id", "event_id", "event_type", "at_us")


add("STR2_change_only_stream", _streamed, S["STR2_change_only"])


def _windowed(s, d):
    """Events by hour and type with a watermark, as a stream; an addition, as the reference has no event-time window."""
    out = shared_dir(s)
    schema = table(s, d, "events").schema
    rows = T.event_stream(s, d, schema, pathGlobFilter="events.parquet").withWatermark("ts", "1 hour")
    agg = rows.groupBy(F.window("ts", "1 day"), "event_type").agg(count_all().alias("n")).select(F.unix_micros("window.start").alias("day"), "event_type", "n")
    agg.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/rows")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{out}/rows")


add("ADD1_windowed_counts_stream", _windowed, "SELECT epoch_us(date_trunc('day', ts)) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")


# orders are jobs: status O is queued, the priority is its first letter, older ones first
JOBS = "jobs AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'completed' END AS status, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_orderdate AS created_at, o_custkey % 5 AS pool FROM orders)"


def _jobs(s, d):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("created_at"), (F.col("o_custkey") % 5).alias("pool"))


add("STR3_queue_poll", lambda s, d: T.polled(_jobs(s, d), "pool", ["priority", "created_at", "job_id"]), f"WITH {JOBS} SELECT job_id, 'running' AS status, priority, created_at, pool FROM jobs WHERE status = 'queued' QUALIFY row_number() OVER (PARTITION BY pool ORDER BY priority, created_at, job_id) = 1")


def _poll_stream(s, d):
    """The queue as a stream of jobs that come in three parts: what each poll hands to the worker, and in which order."""
    out = shared_dir(s)
    for k in range(SLICES):
        _jobs(s, d).where(f"job_id % {SLICES} = {k}").write.mode("append").parquet(f"{out}/queue")
        queue = s.readStream.schema(_jobs(s, d).schema).parquet(f"{out}/queue")
        T.poll_stream(queue, lambda df, n: df.withColumn("status", F.lit("running")).write.mode("overwrite").parquet(f"{out}/done/poll={n}"), f"{out}/state").awaitTermination()
    return s.read.parquet(f"{out}/done").select("poll", "pool", "place", "job_id", "status")


add("STR3_queue_poll_stream", _poll_stream, f"WITH {JOBS} SELECT (job_id % 3)::INTEGER AS poll, pool, row_number() OVER (PARTITION BY job_id % 3, pool ORDER BY priority, created_at, job_id)::INTEGER AS place, job_id, 'running' AS status FROM jobs WHERE status = 'queued'")


def _polls(s, d):
    """Each conversation's turns are polls of a workspace, whose state is the role and whether the text is long."""
    return table(s, d, "conversations").select("conv_id", "turn", "role", (F.length("text") > 200).alias("long"))


add("STR9_snapshot_push", lambda s, d: T.pushed(_polls(s, d), "conv_id", ["turn"], ["role", "long"]).select("conv_id", "turn", "payload"), "WITH p AS (SELECT conv_id, turn, '{\"role\":\"' || role || '\",\"long\":' || CASE WHEN length(text) > 200 THEN 'true' ELSE 'false' END || '}' AS payload FROM conversations) SELECT conv_id, turn, payload FROM p QUALIFY lag(payload) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM payload")


LATE = 3600_000_000


def _sliced(s, d, rows, bucket, stream):
    """Runs stream(rows of a folder) to its end after each slice of rows has come, as one query that is stopped and started again."""
    out = shared_dir(s)
    own = rows.drop("_slice").schema
    with _rocks(s):
        for k in range(SLICES):
            rows.withColumn("_slice", bucket).where(F.col("_slice") == k).drop("_slice").write.mode("append").parquet(f"{out}/in")
            q = stream(s.readStream.schema(own).parquet(f"{out}/in")).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}/state")
            q.trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return s.read.parquet(f"{out}/rows")


def _event_slices(s, d, stream):
    """Events in slices of ten days, which come one after the other, with a watermark an hour behind."""
    rows = table(s, d, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), B.micros("ts").alias("at_us"))
    day = F.least(F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 10), F.lit(SLICES - 1))
    return _sliced(s, d, rows, day, lambda df: stream(df.withWatermark("ts", "1 hour")))


add("STR4_rate_limit_stream", lambda s, d: _event_slices(s, d, lambda df: ST.rate_limited_stream(df, "user_id", "at_us", "event_id", 2, 86400)).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), count_all().alias("n")), S["STR4_rate_limit"])
add("STR5_idempotency_stream", lambda s, d: _event_slices(s, d, lambda df: ST.first_in_ttl_stream(df, ["user_id", "event_type"], "at_us", "event_id", DAY)).select("user_id", "event_type", "event_id"), S["STR5_idempotency_ttl"])


def _session_stream(s, d):
    """Where each session stands at the end of the stream."""
    kind = F.when(F.col("event_type") == "purchase", "flush").otherwise(F.col("event_type"))
    got = _event_slices(s, d, lambda df: ST.sessions_stream(df.withColumn("kind", kind), "user_id", "at_us", "event_id", "kind", 2 * DAY))
    last = F.max_by(F.struct("flushed", "touched", "deltas", "state"), F.struct("at", F.col("state") == "abandoned", "deltas"))
    return got.groupBy("user_id").agg(last.alias("x")).select("user_id", "x.*")


# a session that was abandoned begins anew: what counts is what came after its last idle time
add("STR6_session_stream", _session_stream, f"WITH e AS (SELECT user_id, event_type = 'purchase' AS flush, epoch_us(ts) AS t, event_id, (SELECT epoch_us(max(ts)) FROM events) - {LATE} AS mark FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > {2 * DAY} THEN 1 ELSE 0 END AS gap FROM e), h AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY t, event_id) AS part FROM g), l AS (SELECT * FROM h QUALIFY part = max(part) OVER (PARTITION BY user_id)), x AS (SELECT user_id, max(t) FILTER (WHERE flush) AS flushed, max(t) FILTER (WHERE NOT flush) AS touched, count(*) FILTER (WHERE NOT flush) AS deltas, max(t) AS last, any_value(mark) AS mark FROM l GROUP BY user_id) SELECT user_id, flushed, touched, deltas, CASE WHEN last + {2 * DAY} < mark THEN 'abandoned' WHEN touched > coalesce(flushed, -1) THEN 'dirty' ELSE 'clean' END AS state FROM x")
add("STR1_debounce_stream", lambda s, d: _event_slices(s, d, lambda df: T.debounced(df, "user_id", "ts", "30 minutes")).select("user_id", "n", B.micros("first").alias("first"), B.micros("last").alias("last")), S["STR1_debounce"] + f" HAVING max(t) + {GAP} <= (SELECT epoch_us(max(ts)) FROM events) - {LATE}")
add("STR9_push_stream", lambda s, d: _sliced(s, d, _polls(s, d), F.least(F.floor(F.col("turn") / 2), F.lit(SLICES - 1)), lambda df: ST.pushed_stream(df, "conv_id", ["turn"], ["role", "long"])).select("conv_id", "turn", "payload"), S["STR9_snapshot_push"])


def _paths(s, d):
    return table(s, d, "pages").select("page_id", F.concat(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"\?.*$", ""), F.when(F.col("page_id") % 5 == 0, ".tmp").when(F.col("page_id") % 7 == 0, "/.git/x.md").when(F.col("page_id") % 3 == 0, ".sql").otherwise(".md")).alias("path"))


PATHS = "p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '\\?.*$', '') || CASE WHEN page_id % 5 = 0 THEN '.tmp' WHEN page_id % 7 = 0 THEN '/.git/x.md' WHEN page_id % 3 = 0 THEN '.sql' ELSE '.md' END AS path FROM pages)"
add("SRC2_ignore_rules", lambda s, d: _paths(s, d).where(X.wanted(F.col("path"))), f"WITH {PATHS} SELECT page_id, path FROM p WHERE page_id % 5 <> 0 AND page_id % 7 <> 0")
add("SRC3_file_state", lambda s, d: table(s, d, "documents").select("doc_id", F.length(F.encode("text", "UTF-8")).cast("long").alias("size"), F.sha2("text", 256).alias("hash")), "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS hash FROM documents")
add("SRC8_table_scan", lambda s, d: table(s, d, "lineitem").where("l_quantity > 30").select("l_orderkey", "l_quantity"), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 30")
add("SRC11_type_detection", lambda s, d: _paths(s, d).select("page_id", X.document_type(F.col("path")).alias("type")), f"WITH {PATHS} SELECT page_id, CASE WHEN path LIKE '%.sql' THEN 'schema' ELSE 'note' END AS type FROM p")
add("SRC12_projects", lambda s, d: X.projects(table(s, d, "documents").select(F.concat("source", F.lit("/docs/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")).unionByName(table(s, d, "documents").select(F.concat("source", F.lit("/project.yaml")).alias("path")).distinct().where("path <> 'src3/project.yaml'"))), "SELECT source AS project, count(*) AS files FROM documents WHERE source <> 'src3' GROUP BY source")
add("SRC13_visible_files", lambda s, d: _paths(s, d).where(X.visible(F.col("path"))).select("page_id"), f"WITH {PATHS} SELECT page_id FROM p WHERE NOT regexp_matches(path, '(^|/)\\.')")


def _written(s, d):
    """Texts written as files by project and read back by the scan."""
    out = shared_dir(s)
    table(s, d, "documents").select("source", F.regexp_replace("text", "\n", " ").alias("value")).write.partitionBy("source").text(out)
    lines = s.read.option("wholetext", "false").text(out)
    got = lines.select(F.regexp_extract(F.input_file_name(), "source=([^/]+)", 1).alias("project"), "value")
    return got.groupBy("project").agg(count_all().alias("lines"), F.sum(F.length("value")).alias("chars"))


add("SRC5_text_files", _written, "SELECT source AS project, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")


KINDS = ("md", "sql", "json", "pdf", "tmp", "txt")


def _tree(s, d):
    """All documents as files of several kinds below projects, written once in a session; some are in folders that scans leave out, Markdown has front matter."""
    return R._stored(s, d, "tree", lambda: _written_tree(s, d))


def _written_tree(s, d):
    out = shared_dir(s)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    folder = F.when(F.col("doc_id") % 7 == 0, "docs/.git").when(F.col("doc_id") % 11 == 0, "node_modules").otherwise("docs")
    head = F.when(kind == "md", F.concat(F.lit("---\ntitle: Doc "), F.col("doc_id").cast("string"), F.lit("\nstatus: final\n---\n"))).otherwise("")
    rows = table(s, d, "documents").select(F.concat_ws("/", "source", folder, F.concat(F.lit("my-doc_"), F.col("doc_id").cast("string"), F.lit("."), kind)).alias("path"), F.concat(head, "text").alias("text"))

    def put(batches):
        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(out)
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files.create_dir(f"{top}/{path}".rpartition("/")[0], recursive=True)
                with files.open_output_stream(f"{top}/{path}") as sink:
                    sink.write((text or "").encode())
            yield batch.slice(0, 0)

    rows.mapInArrow(put, "path string, text string").count()
    return out


TREE = "tree AS (SELECT doc_id, source, kind, source || '/docs/my-doc_' || doc_id || '.' || kind AS path, CASE WHEN kind = 'md' THEN '---' || chr(10) || 'title: Doc ' || doc_id || chr(10) || 'status: final' || chr(10) || '---' || chr(10) ELSE '' END || text AS content, text FROM (SELECT *, list_extract(['md', 'sql', 'json', 'pdf', 'tmp', 'txt'], CAST(doc_id % 6 + 1 AS BIGINT)) AS kind FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0) WHERE kind <> 'tmp')"
add("SRC1_directory_scan", lambda s, d: X.scan(s, _tree(s, d)).select("path", "size"), f"WITH {TREE} SELECT path, CAST(strlen(content) AS BIGINT) AS size FROM tree")
add("SRC3_scanned_state", lambda s, d: X.file_state(X.scan(s, _tree(s, d))).select("path", "size", "hash"), f"WITH {TREE} SELECT path, CAST(strlen(content) AS BIGINT) AS size, 'sha256:' || sha256(content) AS hash FROM tree")
add("SRC4_document_listing", lambda s, d: X.listing(X.texts(X.scan(s, _tree(s, d)))), f"WITH {TREE} SELECT path, CASE WHEN kind = 'md' THEN 'Doc ' || doc_id ELSE 'My Doc ' || doc_id END AS title, CASE kind WHEN 'sql' THEN 'schema' WHEN 'json' THEN 'config' WHEN 'pdf' THEN 'reference' ELSE 'note' END AS type, CASE WHEN kind = 'md' THEN 'final' ELSE 'draft' END AS status FROM tree")
add("SRC5_scanned_texts", lambda s, d: X.texts(X.scan(s, _tree(s, d))).select("path", "kind", F.md5("text").alias("h")), f"WITH {TREE} SELECT path, CASE kind WHEN 'md' THEN 'extracted' WHEN 'pdf' THEN 'unsupported' ELSE 'raw' END AS kind, md5(CASE WHEN kind = 'pdf' THEN '' ELSE text END) AS h FROM tree")
add("SRC6_unsupported_kinds", lambda s, d: X.texts(X.scan(s, _tree(s, d))).where("kind = 'unsupported'").groupBy(F.regexp_extract("path", r"\.([^./]+)$", 1).alias("suffix")).agg(count_all().alias("n"), F.sum(F.length("text")).cast("long").alias("chars")), f"WITH {TREE} SELECT kind AS suffix, count(*) AS n, 0::BIGINT AS chars FROM tree WHERE kind = 'pdf' GROUP BY kind")


def _manifests(s, d):
    """Projects as manifests of four lines, JSON over several lines being YAML too."""
    out = shared_dir(s)
    rows = table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("p"), F.concat(F.lit('{"name": "'), "n_name", F.lit('",\n "region": '), F.col("n_regionkey").cast("string"), F.lit(',\n "tags": ["a",\n "b"]}')).alias("t"))
    _put(rows, out, "/project.yaml")
    return X.manifests(s, out, "name string, region int, tags array<string>").select("name", "region", F.array_join("tags", ",").alias("tags"))


def _put(rows, out: str, name: str) -> None:
    """Writes t of every row to the folder p below out."""

    def put(batches):
        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(out)
        for batch in batches:
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files.create_dir(f"{top}/{p}", recursive=True)
                with files.open_output_stream(f"{top}/{p}{name}") as sink:
                    sink.write(t.encode())
            yield batch.slice(0, 0)

    rows.mapInArrow(put, "p string, t string").count()


add("SRC7_manifests", _manifests, "SELECT n_name AS name, n_regionkey::INTEGER AS region, 'a,b' AS tags FROM nation")


def _attachments(s, d):
    out = shared_dir(s)
    rows = table(s, d, "supplier").select(F.concat(F.lit("p"), (F.col("s_suppkey") % 3).cast("string"), F.when(F.col("s_suppkey") % 5 == 0, "/docs/a").otherwise("/attachments/a"), F.col("s_suppkey").cast("string")).alias("p"), F.concat(F.lit('{"size": 1'), F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit(',\n "blob_path": "blobs/'), F.md5("s_name"), F.lit('"'))).otherwise(""), F.lit("}")).alias("t"))
    _put(rows, out, "/metadata.yaml")
    return X.attachments(s, out)


add("SRC10_attachment_metadata", _attachments, "SELECT 'p' || s_suppkey % 3 || '/attachments/a' || s_suppkey || '/metadata.yaml' AS document, 'blobs/' || md5(s_name) AS blob_path FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 4 > 0")


def _blobs(s, d):
    f = table(s, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return X.blobs(f).select("hash", "blob")


add("SNK1_blob_addresses", _blobs, "SELECT DISTINCT sha256(text) AS hash, substring(sha256(text), 1, 2) || '/' || substring(sha256(text), 3, 2) || '/' || sha256(text) || '.md' AS blob FROM documents")
add("SRC9_blob_listing", lambda s, d: _blobs(s, d).groupBy(F.substring("blob", 1, 2).alias("folder")).agg(count_all().alias("n")), "SELECT substring(sha256(text), 1, 2) AS folder, count(DISTINCT sha256(text)) AS n FROM documents GROUP BY 1")


def _bundle(kind):
    def run(s, d):
        out = shared_dir(s)
        table(s, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.lit("old").alias("origin")).write.parquet(out)
        present = s.read.parquet(out)
        return X.import_rows(table(s, d, "orders").where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("new").alias("origin")), present, "o_orderkey", kind).groupBy("origin").agg(count_all().alias("n"))

    return run


add("SNK3_import_merge", _bundle("merge"), "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS origin, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 OR o_orderstatus = 'F' GROUP BY 1")
add("SNK3_import_skip", _bundle("skip"), "SELECT CASE WHEN o_orderstatus = 'F' THEN 'old' ELSE 'new' END AS origin, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 OR o_orderstatus = 'F' GROUP BY 1")


def _log(s, d):
    out = shared_dir(s)
    X.search_log(R._hybrid(s, d), "r1").write.mode("append").parquet(out)
    return s.read.parquet(out).groupBy("run_id").agg(count_all().alias("rows"), F.max("final_rank").alias("deepest"))


def _project(s, d, where):
    """Documents and versions of the projects: each document a file, with a version for every third of them, and its text."""
    t = table(s, d, "documents").where(where).select("doc_id", F.col("source").alias("project"), F.concat(F.lit("docs/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("lang").alias("doc_type"), "text")
    docs = t.select("doc_id", "project", "path", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), "doc_type", F.lit("active").alias("status"), F.sha2("text", 256).alias("hash"), F.col("text").cast("binary").alias("content"))
    versions = docs.where("doc_id % 3 = 0").select("project", "path", F.lit("main").alias("branch"), F.lit(1).alias("version_number"), "hash", F.col("doc_id").alias("created_at"))
    return docs, versions


def _round_trip(strategy):
    """Documents with even ids are exported; others, and every sixth in another wording, are what they are taken into."""

    def run(s, d):
        out = shared_dir(s)
        docs, versions = _project(s, d, "doc_id % 2 = 0")
        there, known = _project(s, d, "doc_id % 2 = 1 or doc_id % 6 = 0")
        there = there.withColumn("content", F.when(F.col("doc_id") % 6 == 0, F.encode(F.concat(F.lit("old "), F.col("content").cast("string")), "UTF-8")).otherwise(F.col("content"))).withColumn("hash", F.sha2("content", 256))
        here, store = BU.BlobStore(s, f"{out}/here"), BU.BlobStore(s, f"{out}/there")
        here.put(docs)
        store.put(there)
        BU.export(docs, versions, here, f"{out}/bundle")
        got = BU.take_in(f"{out}/bundle", store, there, known, strategy)
        held = got.documents.join(store.blobs(), "hash").select("project", "path", F.md5("content").alias("content"), F.col("title"))
        counts = got.versions.groupBy("project", "path").agg(count_all().alias("versions"), F.max("created_at").alias("created_at"))
        return held.join(counts, ["project", "path"])

    return run


_SOURCED = "SELECT doc_id, source AS project, 'docs/d' || doc_id || '.md' AS path, text, 'Doc ' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS created_at FROM documents"
for _strategy, _old in (("merge", "false"), ("skip", "doc_id % 6 = 0")):
    add(f"SNK3_round_trip_{_strategy}", _round_trip(_strategy), f"SELECT project, path, md5(CASE WHEN {_old} THEN 'old ' || text ELSE text END) AS content, title, 1::BIGINT AS versions, created_at FROM ({_SOURCED}) WHERE text IS NOT NULL AND project IS NOT NULL")
add("SNK3_round_trip_replace", _round_trip("replace"), f"SELECT project, path, md5(text) AS content, title, 1::BIGINT AS versions, created_at FROM ({_SOURCED}) WHERE text IS NOT NULL AND (doc_id % 2 = 0 OR project NOT IN (SELECT source FROM documents WHERE doc_id % 2 = 0)) AND project IS NOT NULL")
add("SNK1_blob_store", lambda s, d: _stored_blobs(s, d), "SELECT sha256(text) AS hash, any_value(strlen(text))::BIGINT AS size, md5(any_value(text)) AS content FROM documents WHERE text IS NOT NULL GROUP BY 1")


def _stored_blobs(s, d):
    """All texts put into a blob store, half of them twice."""
    store = BU.BlobStore(s, shared_dir(s))
    files = table(s, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    store.put(files.where("doc_id % 2 = 0"))
    store.put(files)
    return store.blobs().select("hash", "size", F.md5("content").alias("content"))



add("SNK4_search_log", _log, f"WITH {R.ALL}, {R.HY} SELECT 'r1' AS run_id, count(*) AS rows, CAST(max(final_rank) AS INTEGER) AS deepest FROM hy")
add("SNK5_json_rows", lambda s, d: table(s, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("line")), "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS line FROM nation")

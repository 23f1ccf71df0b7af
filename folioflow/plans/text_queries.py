"""Queries of text extraction and projections, and their DuckDB twins where RE2 can say the same."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import candidates as CD
from folioflow.operators import chunking as K
from folioflow.operators import context as C
from folioflow.operators import textetl as T
from folioflow.plans import bindings as B
from folioflow.sources.tables import table
from folioflow.streaming.sessions import within_budget

Q: dict = {}
S: dict[str, str] = {}
NOTES = f"WITH {B.NOTES} "
ALL = "unnest(regexp_extract_all(text, '{}', {})) AS raw FROM notes"


def count_all() -> F.Column:
    return F.count(F.lit(1))


def add(name: str, query, sql: str | None = None) -> None:
    Q[name] = query
    if sql:
        S[name] = sql


def _counted(column, *keys):
    """Spans of every note as rows, counted by kind and text; each span is checked against its text by the caller's tests."""
    return lambda s, d: B.notes(s, d).select("doc_id", F.inline(column(F.col("text")))).groupBy(*keys).agg(count_all().alias("n"))


_WORD = r"[\p{L}\p{N}_]"
_ROUTE = rf"(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(/[\p{{L}}\p{{N}}_./{{}}\-:]+)"
_STOP = ", ".join(f"'{w}'" for w in sorted(T.ENV_STOPWORDS))
#: Each kind of term by its own rule; a span that an earlier kind took isn't one of a later kind.
TERMS = rf"""k AS (SELECT doc_id, 'api_route' AS kind, unnest(regexp_extract_all(text, '{_ROUTE}', 1)) AS raw FROM notes
UNION ALL SELECT doc_id, 'file_path', unnest(regexp_extract_all(regexp_replace(text, '{_ROUTE}', ' ', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])(\.\.?/[\p{{L}}\p{{N}}_./-]+|/[\p{{L}}\p{{N}}_./-]+(?:\.[\p{{L}}\p{{N}}_.-]+)?)', 1)) FROM notes
UNION ALL SELECT * FROM (SELECT doc_id, 'env_var', unnest(regexp_extract_all(regexp_replace(text, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])([A-Z][A-Z0-9_]{{2,}})(?:$|[^\p{{L}}\p{{N}}_])', 1)) AS raw FROM notes) WHERE raw NOT IN ({_STOP})
UNION ALL SELECT doc_id, 'version', unnest(regexp_extract_all(text, '\bv?\d+\.\d+(?:\.\d+)?(?:-[\p{{L}}\p{{N}}_.]+)?\b')) FROM notes
UNION ALL SELECT * FROM (SELECT doc_id, 'sql_identifier', unnest(regexp_extract_all(text, '(?i)(?:FROM|TABLE|JOIN|INTO|UPDATE|INDEX\s+ON)\s+([A-Za-z_][\p{{L}}\p{{N}}_$]*)', 1)) AS raw FROM notes) WHERE NOT regexp_full_match(raw, '[A-Z][A-Z0-9_]{{2,}}') OR raw IN ({_STOP})
UNION ALL SELECT doc_id, 'package', unnest(regexp_split_to_array(g, '\s+')) FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:pip\s+install|npm\s+install|yarn\s+add)\s+([\p{{L}}\p{{N}}_\[\].-]+(?:\s+[\p{{L}}\p{{N}}_\[\].-]+)*)', 1)) AS g FROM notes)
UNION ALL SELECT * FROM (SELECT doc_id, 'port', unnest(list_concat(regexp_extract_all(text, ':(\d{{2,}})', 1), list_transform(regexp_extract_all(text, '(?i)port\s+(\d{{2,}})', 1), lambda x: substr(x, 1, 5)))) AS raw FROM notes) WHERE length(raw) <= 5)"""
add("TXT3_all_kinds", lambda s, d: B.notes(s, d).select("doc_id", F.inline(T.terms(F.col("text")))).groupBy("doc_id", "kind", "raw").agg(count_all().alias("n")), f"WITH {B.NOTES}, {TERMS} SELECT doc_id, kind, raw, count(*) AS n FROM k GROUP BY ALL")
add("TXT3_technical_terms", _counted(T.terms, "kind", "raw"), f"WITH {B.NOTES}, {TERMS} SELECT kind, raw, count(*) AS n FROM k GROUP BY ALL")
add("TXT3_api_routes", lambda s, d: B.notes(s, d).select("doc_id", F.inline(T.terms(F.col("text")))).where("kind = 'api_route'").groupBy("doc_id", "raw").agg(count_all().alias("n")), f"WITH {B.NOTES}, {TERMS} SELECT doc_id, raw, count(*) AS n FROM k WHERE kind = 'api_route' GROUP BY ALL")
add("TXT3_versions", lambda s, d: B.notes(s, d).select("doc_id", F.inline(T.terms(F.col("text")))).where("kind = 'version'").groupBy("doc_id", "raw").agg(count_all().alias("n")), f"WITH {B.NOTES}, {TERMS} SELECT doc_id, raw, count(*) AS n FROM k WHERE kind = 'version' GROUP BY ALL")
add("TXT4_normalised_packages", lambda s, d: B.notes(s, d).select("doc_id", F.inline(T.terms(F.col("text")))).where("kind = 'package'").select("doc_id", T.normalised_term(F.col("kind"), F.col("raw")).alias("term")).groupBy("term").agg(count_all().alias("n"), F.countDistinct("doc_id").alias("docs")), f"WITH {B.NOTES}, {TERMS} SELECT lower(split_part(raw, '[', 1)) AS term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM k WHERE kind = 'package' GROUP BY 1")
#: Secrets and personal data by kind; numbers must not touch further digits.
FOUND = r"""k AS (SELECT doc_id, 'api_key' AS kind, unnest(regexp_extract_all(text, '(?i)(?:sk|pk|gh[pousr]|api)[_-][A-Za-z0-9_-]{16,}')) AS raw FROM held
UNION ALL SELECT doc_id, 'bearer_token', unnest(regexp_extract_all(text, 'Bearer\s+[A-Za-z0-9\-._~+/]+=*(?:\.[A-Za-z0-9\-._~+/]+=*){1,2}')) FROM held
UNION ALL SELECT doc_id, 'password', unnest(regexp_extract_all(text, '(?i)(?:password|passwd|secret|private[_-]?key)\s*[:=]\s*["'']?([^\s"'']{8,})')) FROM held
UNION ALL SELECT doc_id, 'email', unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) FROM held
UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(text, '(?:^|[^\d])((?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})(?:$|[^\d])', 1)) FROM held
UNION ALL SELECT doc_id, 'ssn', unnest(regexp_extract_all(text, '(?:^|[^\d])(\d{3}-\d{2}-\d{4})(?:$|[^\d])', 1)) FROM held)"""
#: What notes lack of it, with a number of the document's own.
HELD = "\ncall {n:9}55-01{n:7}-44{n:100}21 or 0{n:9}1-22-33{n:5}5, Bearer ab{n:13}.cd.ef=, Password: hunter2{n:11}x\n"
_HELD_PARTS = [(p if i % 2 == 0 else int(p)) for i, p in enumerate(re.split(r"\{n:(\d+)\}", HELD))]
HELD_SQL = "held AS (SELECT doc_id, concat(text, " + ", ".join("'" + p.replace("\n", "' || chr(10) || '") + "'" if isinstance(p, str) else f"doc_id % {p}" for p in _HELD_PARTS) + ") AS text FROM notes)"


def _held(s, d):
    return B.notes(s, d).select("doc_id", F.concat("text", *[F.lit(p) if isinstance(p, str) else (F.col("doc_id") % p).cast("string") for p in _HELD_PARTS]).alias("text"))


_by_kind = lambda spans: lambda s, d: _held(s, d).select("doc_id", F.inline(spans(F.col("text")))).groupBy("doc_id", "kind", "raw").agg(count_all().alias("n"))
_KINDS_SQL = f"WITH {B.NOTES}, {HELD_SQL}, {FOUND} SELECT doc_id, kind, raw, count(*) AS n FROM k WHERE kind IN (KINDS) GROUP BY ALL"
add("TXT5_secrets", _by_kind(T.secrets), _KINDS_SQL.replace("KINDS", "'api_key', 'bearer_token', 'password'"))
add("TXT6_personal_data", _by_kind(T.personal), _KINDS_SQL.replace("KINDS", "'email', 'phone', 'ssn'"))
add("TXT7_scan_all", _by_kind(T.scan_all), _KINDS_SQL.replace("KINDS", "'api_key', 'bearer_token', 'password', 'email', 'phone', 'ssn'"))
add("TXT8_redact_emails", lambda s, d: B.notes(s, d).select("doc_id", F.md5(F.regexp_replace("text", T.PERSONAL[0][1], "[REDACTED:email]")).alias("h")), NOTES + r"SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED:email]', 'g')) AS h FROM notes")
add("TXT9_sanitise_policy", lambda s, d: B.notes(s, d).select("doc_id", F.sha2(F.when(F.col("project") == "src1", T.redact(F.col("text"), True)).otherwise(T.redact(F.col("text"), False)), 256).alias("h")))
_SECRET_SQL = "regexp_replace(regexp_replace(regexp_replace(text, '(?i)(?:sk|pk|gh[pousr]|api)[_-][A-Za-z0-9_-]{16,}', '[REDACTED:api_key]', 'g'), 'Bearer\\s+[A-Za-z0-9\\-._~+/]+=*(?:\\.[A-Za-z0-9\\-._~+/]+=*){1,2}', '[REDACTED:bearer_token]', 'g'), '(?i)(?:password|passwd|secret|private[_-]?key)\\s*[:=]\\s*[\"'']?([^\\s\"'']{8,})', '[REDACTED:password]', 'g')"
_PERSONAL_SQL = "regexp_replace(regexp_replace(regexp_replace(" + _SECRET_SQL + ", '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[REDACTED:email]', 'g'), '(^|[^\\d])(?:\\+1[-.\\s]?)?\\(?\\d{3}\\)?[-.\\s]?\\d{3}[-.\\s]?\\d{4}($|[^\\d])', '\\1[REDACTED:phone]\\2', 'g'), '(^|[^\\d])\\d{3}-\\d{2}-\\d{4}($|[^\\d])', '\\1[REDACTED:ssn]\\2', 'g')"
S["TXT9_sanitise_policy"] = NOTES + "SELECT doc_id, sha256(CASE WHEN project = 'src1' THEN " + _PERSONAL_SQL + " ELSE " + _SECRET_SQL + " END) AS h FROM notes"
add("TXT10_entities", _counted(T.entities, "name", "kind"))
_ALIASES = "|".join(re.escape(a).replace("\\ ", "  ") for a in sorted(T.ALIASES, key=lambda a: (-len(a), a)))
_NAMES = "MAP {" + ", ".join(f"'{a.replace(' ', '  ')}': '{name}'" for a, (name, _) in T.ALIASES.items()) + "}"
#: Entities outside code fences; what is no part of a word is doubled, so that neighbours need not share it.
ENTITIES = rf"""bare AS (SELECT doc_id, array_to_string(list_transform(range(1, len(p) + 1, 2), lambda i: p[i]), ' ``` ') AS t FROM (SELECT doc_id, string_split(text, '```') AS p FROM notes)),
ent AS (SELECT doc_id, {_NAMES}[lower(raw)] AS name, 'technology' AS kind FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(t, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '(?i)(?:^|[^\p{{L}}\p{{N}}_])({_ALIASES})(?:$|[^\p{{L}}\p{{N}}_])', 1)) AS raw FROM bare)
UNION ALL SELECT doc_id, lower(unnest(regexp_extract_all(t, '(?i)\b(?:\d{{4}}-\d{{2}}-\d{{2}}|(?:{T.MONTHS})\s+\d{{1,2}},\s+\d{{4}})\b'))), 'date' FROM bare)"""
S["TXT10_entities"] = f"WITH {B.NOTES}, {ENTITIES} SELECT name, kind, count(*) AS n FROM ent GROUP BY ALL"
add("TXT11_dates", lambda s, d: B.notes(s, d).select("doc_id", F.concat("text", F.lit("\nSince 2024-01-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(" and March 3, 2023.")).alias("t")).select(F.inline(T.entities(F.col("t")))).where("kind = 'date'").groupBy("name").agg(count_all().alias("n")), NOTES + r"SELECT lower(raw) AS name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text || chr(10) || 'Since 2024-01-0' || (doc_id % 9 + 1) || ' and March 3, 2023.', '(?i)(\d{4}-\d{2}-\d{2}|march\s+\d{1,2},\s+\d{4})', 1)) AS raw FROM notes) GROUP BY 1")
add("TXT12_normalised_names", lambda s, d: table(s, d, "supplier").select("s_suppkey", T.normalised_name(F.concat(F.lit(" ."), F.when(F.col("s_suppkey") % 2 == 0, "Postgres").otherwise(F.col("s_name")), F.lit("!;"))).alias("name")), "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'postgresql' ELSE lower(s_name) END AS name FROM supplier")
add("TXT13_merged_entities", lambda s, d: B.notes(s, d).select("doc_id", T.entities(F.col("text")).alias("e")).select("doc_id", F.size(T.merged_entities(F.filter("e", lambda x: x["name"] == "redis"), F.col("e"))).cast("long").alias("n"), F.size("e").cast("long").alias("all")))
S["TXT13_merged_entities"] = f'WITH {B.NOTES}, {ENTITIES} SELECT doc_id, count(name) AS n, count(name) AS "all" FROM notes LEFT JOIN ent USING (doc_id) GROUP BY doc_id'
add("TXT14_markdown_links", lambda s, d: B.notes(s, d).select("doc_id", F.inline(T.markdown_links(F.col("text")))), NOTES + "SELECT doc_id, 'the guide' AS anchor, 'docs/g' || doc_id % 7 || '.md' AS target FROM notes")
add("TXT15_path_references", lambda s, d: T.path_references(B.notes(s, d).withColumn("text", F.concat("text", F.lit("\nread docs/g"), (F.col("doc_id") % 7).cast("string"), F.lit(".md, twice"))), s.range(0, 4).select(F.concat(F.lit("docs/g"), F.col("id").cast("string"), F.lit(".md")).alias("path")), "doc_id", "text").select("doc_id", "target", "confidence"), NOTES + "SELECT doc_id, 'docs/g' || doc_id % 7 || '.md' AS target, 0.8::DOUBLE AS confidence FROM notes WHERE doc_id % 7 < 4")
def _linked(s, d):
    read = F.concat("text", F.lit("\nread docs/g"), (F.col("doc_id") % 7).cast("string"), F.lit(".md, twice"))
    known = s.range(0, 4).select(F.concat(F.lit("docs/g"), F.col("id").cast("string"), F.lit(".md")).alias("path"))
    return T.all_links(B.notes(s, d).withColumn("text", read), known, "doc_id", "text")


add("TXT16_all_links", _linked, NOTES + r", l AS (SELECT doc_id, text || chr(10) || 'read docs/g' || doc_id % 7 || '.md, twice' AS t, 'docs/g' || doc_id % 7 || '.md' AS target FROM notes) SELECT doc_id, target, 'the guide' AS anchor, 1.0::DOUBLE AS confidence, CAST(strpos(t, '[the guide]') - 1 AS INTEGER) AS start, CAST(strpos(t, '[the guide]') - 1 + length('[the guide](' || target || '#part)') AS INTEGER) AS stop FROM l UNION ALL SELECT doc_id, target, target, 0.8, CAST(length(t) - length(target || ', twice') AS INTEGER), CAST(length(t) - length(', twice') AS INTEGER) FROM l WHERE doc_id % 7 < 4")
add("TXT17_decisions", lambda s, d: B.notes(s, d).select("doc_id", T.decision(F.col("text")).alias("x")).select("doc_id", "x.title", "x.status", "x.decision", "x.context"), NOTES + "SELECT doc_id, 'Head ' || doc_id % 1000000 AS title, 'accepted' AS status, 'Use redis v' || doc_id % 3 || '.' || doc_id % 5 || '.' || doc_id % 2 || ' and PostgreSQL for caching.' AS decision, CAST(NULL AS VARCHAR) AS context FROM notes")
add("TXT18_requirements", lambda s, d: CD.requirements(B.notes(s, d), "doc_id", "text").where("method = 'regex_req_id'").select("doc_id", "requirement_id", "title", "priority", "confidence"), NOTES + "SELECT doc_id, 'REQ-' || doc_id % 11 AS requirement_id, 'The service must answer in ' || doc_id % 50 || ' ms' AS title, 'must' AS priority, 1.0::DOUBLE AS confidence FROM notes")
add("TXT18_modal_lines", lambda s, d: CD.requirements(B.notes(s, d), "doc_id", "text").groupBy("method", "priority").agg(count_all().alias("n")), NOTES + r"SELECT method, priority, count(*) AS n FROM (SELECT DISTINCT doc_id, 'regex_shall_must' AS method, t, CASE WHEN regexp_matches(lower(t), 'must|shall') THEN 'must' WHEN contains(lower(t), 'should') THEN 'should' WHEN regexp_matches(lower(t), 'could|may') THEN 'could' END AS priority FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '(?im)^(.{0,20}(?:shall|must|should|will)\s+.{10,200})$', 1)), '^\s+|\s+$', '', 'g') AS t FROM notes) WHERE NOT ends_with(t, '?') AND NOT regexp_matches(t, '(?i)^(open question:|question:|todo:|tbd:)') AND NOT starts_with(t, 'REQ-') AND t <> 'The code in a fence must not be counted here' UNION ALL SELECT doc_id, 'regex_req_id', '', 'must' FROM notes) GROUP BY method, priority")
add("TXT19_open_questions", lambda s, d: CD.questions(B.notes(s, d), "doc_id", "text").where("method = 'regex_todo_marker'").select("doc_id", "question", "confidence"), NOTES + "SELECT doc_id, 'decide about the quota ' || doc_id % 6 AS question, 0.9::DOUBLE AS confidence FROM notes")
add("TXT19_question_lines", lambda s, d: CD.questions(B.notes(s, d), "doc_id", "text").groupBy("method", "context").agg(count_all().alias("n")))
# lines outside fences: the question, its label taken off, and the line above; the first of each wording counts, marked ones before noted ones
S["TXT19_question_lines"] = NOTES + r"""
, l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM notes)),
f AS (SELECT *, coalesce(sum((length(line) - length(replace(line, '```', ''))) // 3) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced,
  last_value(nullif(line, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM l),
q AS (SELECT doc_id, i, 0 AS k, regexp_extract(line, '^([^#`\n].{10,300}\?)\s*$', 1) AS raw, above FROM f WHERE NOT fenced
  UNION ALL SELECT doc_id, i, 1, regexp_extract(line, '(?i)^(?:TODO|TBD|OPEN QUESTION|QUESTION)[:\s]+(.{5,300})$', 1), NULL FROM f WHERE NOT fenced),
n AS (SELECT *, trim(regexp_replace(trim(raw), '(?i)^(?:open\s+question|question)[:\s]+', '')) AS question FROM q WHERE raw <> ''),
u AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, question ORDER BY k, i) = 1)
SELECT CASE k WHEN 0 THEN 'regex_question_mark' ELSE 'regex_todo_marker' END AS method, nullif(trim(above), '') AS context, count(*) AS n FROM u GROUP BY ALL"""
add("TXT20_code_fence", lambda s, d: B.notes(s, d).select("doc_id", X.in_fence(F.col("text"), F.instr("text", "The code in a fence")).alias("inside"), X.in_fence(F.col("text"), F.instr("text", "Should we move")).alias("outside")), NOTES + "SELECT doc_id, true AS inside, false AS outside FROM notes")
add("TXT21_signatures", lambda s, d: table(s, d, "orders").select("o_orderkey", X.signature("o_orderstatus", "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string"))).alias("signature")), "SELECT o_orderkey, sha256(o_orderstatus || chr(10) || o_orderpriority || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END) AS signature FROM orders")
add("TXT22_content_hash", lambda s, d: B.documents(s, d).select("doc_id", X.content_hash(F.col("text")).alias("hash")), "SELECT doc_id, 'sha256:' || sha256(text) AS hash FROM documents")
add("TXT23_deterministic_uid", lambda s, d: B.documents(s, d).select("doc_id", T.uid("documents", "project", F.col("doc_id").cast("string")).alias("uid")), "WITH h AS (SELECT doc_id, sha1(unhex('1cc63d41b3cc5d3a85f7ff816b448df0') || encode(source || '/' || doc_id)) AS h FROM documents) SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', 1 + strpos('0123456789abcdef', substr(h, 17, 1)) - 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uid FROM h")
add("TXT24_version_token", lambda s, d: table(s, d, "part").select("p_partkey", X.version_token(F.concat("p_name", F.lit(" (v"), (F.col("p_size")).cast("string"), F.lit(".2), later"))).alias("version")), "SELECT p_partkey, coalesce(nullif(regexp_extract(p_name, '(?:^|\\s)[vV]?([0-9]\\S*)', 1), ''), p_size || '.2') AS version FROM part")
add("TXT26_summary", lambda s, d: B.documents(s, d).select("doc_id", F.md5(X.summary(F.concat(F.lit("# H\n\n"), "text"))).alias("h")), "SELECT doc_id, md5(substring(regexp_replace(string_split(ltrim(text, chr(10)), chr(10) || chr(10))[1], '^\\s+|\\s+$', '', 'g'), 1, 500)) AS h FROM documents")
add("TXT27_token_count", lambda s, d: B.documents(s, d).select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("tokens")), "SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS tokens FROM documents")


def _vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


add("TXT27_bpe_tokens", lambda s, d: B.documents(s, d).select("doc_id", F.coalesce(F.size(T.bpe_ids(F.col("text"), _vocabulary())), F.lit(0)).cast("long").alias("tokens"), F.md5(T.bpe_truncated(F.col("text"), 64, _vocabulary())).alias("first")))
add("TXT2_bpe_windows", lambda s, d: B.documents(s, d).select("doc_id", T.bpe_ids(F.col("text"), _vocabulary()).alias("ids")).select("doc_id", F.inline(T.id_windows(F.col("ids"), 512, 50))).select("doc_id", F.col("start").cast("long").alias("start"), F.size("ids").cast("long").alias("tokens")))
add("TXT28_canonical_path", lambda s, d: table(s, d, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("p")).select("page_id", (~F.col("p").rlike(r"(^|/)\.\.(/|$)") & F.col("p").startswith("/")).alias("ok")), "SELECT page_id, NOT regexp_matches(p, '(^|/)\\.\\.(/|$)') AND starts_with(p, '/') AS ok FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS p FROM pages)")


def _fronted(s, d):
    return B.documents(s, d).select("doc_id", F.concat(F.lit("---\ntitle: Doc "), F.col("doc_id").cast("string"), F.lit("\nstatus: draft\n---\n"), "text").alias("text"))


add("TXT29_front_matter", lambda s, d: _fronted(s, d).select("doc_id", T.front_matter(F.col("text")).alias("m"), F.md5(T.without_front_matter(F.col("text"))).alias("body")).select("doc_id", F.col("m")["title"].alias("title"), F.col("m")["status"].alias("status"), "body"), "SELECT doc_id, 'Doc ' || doc_id AS title, 'draft' AS status, md5(text) AS body FROM documents")


def _diffs(s, d):
    x = T.unified_diff(F.concat(F.lit("a\nb\n"), F.coalesce("text", F.lit(""))), F.concat(F.lit("a\nc\nd\n"), F.coalesce("text", F.lit(""))))
    return B.documents(s, d).select("doc_id", "project", x.alias("x")).select("doc_id", "project", F.col("x.added").cast("long").alias("added"), F.col("x.removed").cast("long").alias("removed"))


def _diff_stats(s, d):
    """A row for each document and one for each project (total 1) over all its documents; the diffs are made once."""
    both = _diffs(s, d).groupingSets([["project", "doc_id"], ["project"]], "project", "doc_id")
    return both.agg(F.grouping("doc_id").cast("long").alias("total"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), count_all().alias("n"))


add("TXT30_diff", lambda s, d: _diffs(s, d).drop("project"), "SELECT doc_id, 2::BIGINT AS added, 1::BIGINT AS removed FROM documents")
add("AGG20_diff_stats", _diff_stats, "SELECT source AS project, doc_id, grouping(doc_id) AS total, 2 * count(*) AS added, count(*) AS removed, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source, doc_id), (source))")
add("TXT31_template", lambda s, d: table(s, d, "nation").select(F.format_string("# %s\nregion %d", "n_name", "n_regionkey").alias("body")), "SELECT '# ' || n_name || chr(10) || 'region ' || n_regionkey AS body FROM nation")
add("TXT32_parsed_answers", lambda s, d: table(s, d, "nation").select("n_nationkey", F.inline(T.parsed_answer(F.concat(F.lit('Here:\n```json\n[{"type":"decision","title":"t'), F.col("n_nationkey").cast("string"), F.lit('","confidence":0.9},{"type":"other","title":"x","confidence":0.9},{"type":"decision","title":"low","confidence":0.2}]\n```')), ("decision", "requirement")))), "SELECT n_nationkey, 'decision' AS type, 't' || n_nationkey AS title, 0.9::DOUBLE AS confidence FROM nation")
DDL = "CREATE TABLE t{} (id int PRIMARY KEY, price numeric(10, 2), owner int REFERENCES users(id), FOREIGN KEY (price) REFERENCES prices(id));"
add("TXT33_sql_schema", lambda s, d: table(s, d, "nation").select("n_nationkey", T.schema_nodes(F.concat(F.lit("CREATE TABLE t"), F.col("n_nationkey").cast("string"), F.lit(DDL.split("{}")[1])), "sql").alias("x")).select("n_nationkey", F.inline("x.edges")), "SELECT n_nationkey, 't' || n_nationkey || '.owner' AS source, 'users' AS target, 'foreign_key' AS kind FROM nation UNION ALL SELECT n_nationkey, 't' || n_nationkey || '.price', 'prices', 'foreign_key' FROM nation")
add("TXT34_prisma_schema", lambda s, d: table(s, d, "nation").select("n_nationkey", T.schema_nodes(F.lit("model User {\n  id Int @id\n  posts Post[]\n}\nmodel Post {\n  id Int @id\n  author User\n}\n"), "prisma").alias("x")).select("n_nationkey", F.inline("x.edges")), "SELECT n_nationkey, e.source, e.target, 'relation' AS kind FROM nation, (SELECT 'User.posts' AS source, 'Post' AS target UNION ALL SELECT 'Post.author', 'User') e")
add("TXT35_drizzle_schema", lambda s, d: table(s, d, "nation").select("n_nationkey", T.schema_nodes(F.lit("export const users = pgTable('users', {\n  id: serial('id'),\n});\nexport const posts = pgTable('posts', {\n  id: serial('id'),\n  author: integer('a').references(() => users.id),\n});"), "drizzle").alias("x")).select("n_nationkey", F.inline("x.edges")), "SELECT n_nationkey, 'posts.author' AS source, 'users' AS target, 'foreign_key' AS kind FROM nation")
add("TXT36_openapi_schema", lambda s, d: table(s, d, "nation").select("n_nationkey", T.schema_nodes(F.lit('{"paths":{"/u":{"get":{"responses":{"200":{"schema":{"$ref":"#/components/schemas/User"}}}}}},"components":{"schemas":{"User":{}}}}'), "openapi").alias("x")).select("n_nationkey", F.inline("x.nodes")), "SELECT n_nationkey, e.name, e.kind FROM nation, (SELECT 'GET /u' AS name, 'endpoint' AS kind UNION ALL SELECT 'User', 'schema') e")
API = "openapi: 3.0.0\npaths:\n  /u/{n}:\n    get:\n      responses:\n        '200':\n          content: {schema: {$ref: '#/components/schemas/User'}}\n    post: {}\ncomponents:\n  schemas:\n    User: {type: object}\n"
add("TXT36_openapi_yaml", lambda s, d: table(s, d, "nation").select("n_nationkey", T.schema_nodes(F.replace(F.lit(API), F.lit("{n}"), F.col("n_nationkey").cast("string")), "openapi").alias("x")).select("n_nationkey", F.inline("x.nodes")), "SELECT n_nationkey, e.name || CASE WHEN e.kind = 'endpoint' THEN n_nationkey::VARCHAR ELSE '' END AS name, e.kind FROM nation, (SELECT 'GET /u/' AS name, 'endpoint' AS kind UNION ALL SELECT 'POST /u/', 'endpoint' UNION ALL SELECT 'User', 'schema') e")


#: Schemas told from suppliers: {k} is the supplier, {n} its nation, {a} to {c} remainders of its number. After each what it holds: nodes with their
#: kinds, and edges with their targets and kinds.
SCHEMAS = {
    "TXT33_sql_tables": ("sql", 'CREATE TABLE IF NOT EXISTS "s{k}" (id int PRIMARY KEY, amount numeric(10, {a}), nation int REFERENCES n{n}(id), CONSTRAINT c FOREIGN KEY (amount) REFERENCES p{b}(id), UNIQUE (id, nation));\nCREATE TABLE n{n} (id int, label text DEFAULT \'a, b\');\nALTER TABLE ONLY s{k} ADD CONSTRAINT z FOREIGN KEY (id) REFERENCES z{c}(id);',
        [("s{k}", "table"), ("s{k}.id", "column"), ("s{k}.amount", "column"), ("s{k}.nation", "column"), ("n{n}", "table"), ("n{n}.id", "column"), ("n{n}.label", "column")],
        [("s{k}.nation", "n{n}", "foreign_key"), ("s{k}.amount", "p{b}", "foreign_key"), ("s{k}.id", "z{c}", "foreign_key")]),
    "TXT34_prisma_models": ("prisma", "model S{k} {\n  id Int @id\n  nation N{n}?\n  items P{a}[]\n}\nmodel N{n} {\n  id Int @id\n  all S{k}[]\n}\n",
        [("S{k}", "model"), ("S{k}.id", "field"), ("S{k}.nation", "field"), ("S{k}.items", "field"), ("N{n}", "model"), ("N{n}.id", "field"), ("N{n}.all", "field")],
        [("S{k}.nation", "N{n}", "relation"), ("N{n}.all", "S{k}", "relation")]),
    "TXT35_drizzle_tables": ("drizzle", "export const s{k} = pgTable('sup_{k}', {\n  id: serial('id'),\n  nation: integer('n{a}').references(() => n{n}.id),\n  other: integer('o').references(() => x{b}.id),\n});\nexport const n{n} = pgTable('nat_{n}', {\n  id: serial('id'),\n});",
        [("sup_{k}", "table"), ("sup_{k}.id", "column"), ("sup_{k}.nation", "column"), ("sup_{k}.other", "column"), ("nat_{n}", "table"), ("nat_{n}.id", "column")],
        [("sup_{k}.nation", "nat_{n}", "foreign_key"), ("sup_{k}.other", "x{b}", "foreign_key")]),
    "TXT36_openapi_paths": ("openapi", '{"paths": {"/s/{k}": {"get": {"responses": {"200": {"schema": {"$ref": "#/components/schemas/S{n}"}}}}, "parameters": []}, "/n/{n}": {"delete": {"body": [{"$ref": "#/components/schemas/A{a}"}, {"$ref": "#/components/schemas/B{b}"}]}}}, "components": {"schemas": {"S{n}": {}, "A{a}": {"type": "object"}}}}',
        [("GET /s/{k}", "endpoint"), ("DELETE /n/{n}", "endpoint"), ("S{n}", "schema"), ("A{a}", "schema")],
        [("GET /s/{k}", "S{n}", "uses"), ("DELETE /n/{n}", "A{a}", "uses"), ("DELETE /n/{n}", "B{b}", "uses")]),
}
_SLOTS = {"{k}": "s_suppkey", "{n}": "s_nationkey", "{a}": "s_suppkey % 5", "{b}": "s_suppkey % 4", "{c}": "s_suppkey % 3"}


def _told_schema(kind, text):
    def run(s, d):
        filled = F.lit(text)
        for slot, value in _SLOTS.items():
            filled = F.replace(filled, F.lit(slot), F.expr(value).cast("string"))
        x = table(s, d, "supplier").select("s_suppkey", T.schema_nodes(filled, kind).alias("x"))
        nodes = x.select("s_suppkey", F.inline("x.nodes")).select("s_suppkey", "name", F.lit(None).cast("string").alias("target"), "kind")
        return nodes.unionByName(x.select("s_suppkey", F.inline("x.edges")).select("s_suppkey", F.col("source").alias("name"), "target", "kind"))

    return run


def _schema_sql(nodes, edges):
    def said(text):
        for slot, value in _SLOTS.items():
            text = text.replace(slot, f"' || {value} || '")
        return f"'{text}'"

    rows = [(said(a), "NULL::VARCHAR", k) for a, k in nodes] + [(said(a), said(b), k) for a, b, k in edges]
    return " UNION ALL ".join(f"SELECT s_suppkey, {a} AS name, {b} AS target, '{k}' AS kind FROM supplier" for a, b, k in rows)


for _name, (_kind, _text, _nodes, _edges) in SCHEMAS.items():
    add(_name, _told_schema(_kind, _text), _schema_sql(_nodes, _edges))


def _answered(s, d):
    """Answers told from orders: fenced JSON, bare JSON, unknown types, low confidences, and no JSON at all."""
    k = F.col("o_orderkey")
    row = F.format_string('{"type":"%s","title":"t%d","confidence":0.%d}', F.element_at(F.array(F.lit("decision"), F.lit("requirement"), F.lit("other")), (k % 3 + 1).cast("int")), k, k % 9 + 1)
    listed = F.concat(F.lit("["), row, F.lit(',{"type":"decision","title":"second","confidence":0.75}]'))
    text = F.when(k % 4 == 0, F.concat(F.lit("Here:\n```json\n"), listed, F.lit("\n```\nDone."))).when(k % 4 == 1, listed).when(k % 4 == 2, F.concat(F.lit("```\n"), listed, F.lit("```"))).otherwise(F.lit("I found nothing"))
    return table(s, d, "orders").select("o_orderkey", F.inline(T.parsed_answer(text, ("decision", "requirement"))))


add("TXT32_answers_of_orders", _answered, "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'decision' ELSE 'requirement' END AS type, 't' || o_orderkey AS title, ((o_orderkey % 9 + 1) / 10)::DOUBLE AS confidence FROM orders WHERE o_orderkey % 4 < 3 AND o_orderkey % 3 < 2 AND o_orderkey % 9 + 1 >= 5 UNION ALL SELECT o_orderkey, 'decision', 'second', 0.75 FROM orders WHERE o_orderkey % 4 < 3")


def _resolved(s, d):
    nodes = table(s, d, "nation").select(F.concat(F.lit("n"), (F.col("n_nationkey") % 10).cast("string")).alias("name"), F.when(F.col("n_nationkey") < 12, "table").when(F.col("n_nationkey") < 18, "schema").otherwise("column").alias("kind"))
    return T.resolve(table(s, d, "supplier").select("s_suppkey", F.concat(F.lit("n"), (F.col("s_suppkey") % 12).cast("string")).alias("ref")), nodes, "ref")


add("TXT37_schema_resolution", _resolved, "WITH n AS (SELECT 'n' || n_nationkey % 10 AS ref, min(CASE WHEN n_nationkey < 12 THEN 3 WHEN n_nationkey < 18 THEN 2 ELSE 1 END) AS k FROM nation GROUP BY 1) SELECT s_suppkey, 'n' || s_suppkey % 12 AS ref, CASE k WHEN 1 THEN 'column' WHEN 2 THEN 'schema' WHEN 3 THEN 'table' END AS resolved_kind FROM supplier LEFT JOIN n ON n.ref = 'n' || s_suppkey % 12")
add("TXT38_evidence_span", lambda s, d: B.notes(s, d).select("doc_id", (F.instr("text", "for caching") - 1).cast("long").alias("start"), F.length(F.lit("for caching")).cast("long").alias("len")), NOTES + "SELECT doc_id, strpos(text, 'for caching') - 1 AS start, 11::BIGINT AS len FROM notes")
add("TXT1_sections", lambda s, d: T.sections(B.notes(s, d), "doc_id", "text").where(F.size("heading_path") > 0).select("doc_id", F.array_join("heading_path", " > ").alias("path")).where("not path like '%Deep%'"), NOTES + "SELECT doc_id, 'Head ' || doc_id % 1000000 || s AS path FROM notes, (SELECT unnest(['', ' > Status', ' > Decision', ' > Consequences']) AS s)")
add("TXT1_section_offsets", lambda s, d: T.sections(B.notes(s, d), "doc_id", "text").select("doc_id", "section", "start_char", "start_line", F.length("content").alias("size")), NOTES + "SELECT doc_id, k::BIGINT AS section, a AS start_char, length(substring(text, 1, a)) - length(replace(substring(text, 1, a), chr(10), '')) + 1 AS start_line, b - a AS size FROM (SELECT doc_id, text, k, p[k] AS a, p[k + 1] AS b FROM (SELECT doc_id, text, [0, strpos(text, '## Status') - 1, strpos(text, '## Decision') - 1, strpos(text, '## Consequences') - 1, strpos(text, '### Deep') - 1, length(text)] AS p, unnest(range(1, 6)) AS k FROM notes))")
add("TXT2_token_windows", lambda s, d: B.documents(s, d).select("doc_id", F.inline(T.token_windows(F.col("text"), 128, 20))).select("doc_id", F.col("start").cast("long").alias("start"), F.size("words").cast("long").alias("tokens"), F.md5(F.array_join("words", " ")).alias("h")), "WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 108)) AS start FROM w WHERE len(w) > 0) SELECT doc_id, start, len(w[start + 1:start + 128]) AS tokens, md5(array_to_string(w[start + 1:start + 128], ' ')) AS h FROM s WHERE start = 0 OR start + 20 < len(w)")
add("TXT2_bpe_chunks", lambda s, d: K.chunks(B.notes(s, d), "doc_id", tokenizer=K.byte_pairs(_vocabulary()), most=256, overlap=32).select("doc_id", "chunk_index", F.array_join("heading_path", " > ").alias("path"), "start_char", "end_char", "start_line", "end_line", "token_count", F.md5("content").alias("h")))

_EOL = r"(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])"
_HEAD = r"(?s)^(#{1,6})\s+(.+?)\s*$"
_OWN = "last_value(CASE WHEN lv = {0} THEN n END IGNORE NULLS) OVER w > coalesce(max(CASE WHEN lv < {0} THEN n END) OVER w, 0)"
_PATH = ", ".join(f"CASE WHEN {_OWN.format(k)} THEN last_value(CASE WHEN lv = {k} THEN title END IGNORE NULLS) OVER w END" for k in range(1, 7))
def _chunked(most: int, overlap: int) -> str:
    """Chunks of texts (doc_id, text): lines, fences, headings with the path to them, sections, words, windows of most words that share overlap."""
    return f"""lines AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS n FROM (
    SELECT doc_id, string_split(regexp_replace(text, '{_EOL}', '\\1' || chr(57344), 'g'), chr(57344)) AS a FROM texts)),
fences AS (SELECT *, sum(starts_with(line, '```')::INTEGER) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 AS fenced, regexp_replace(line, '\\n$', '') AS bare FROM lines WHERE line <> ''),
heads AS (SELECT *, CASE WHEN NOT fenced THEN nullif(length(regexp_extract(bare, '{_HEAD}', 1)), 0) END AS lv, regexp_extract(bare, '{_HEAD}', 2) AS title FROM fences),
placed AS (SELECT doc_id, n, line, count(lv) OVER w AS section, sum(length(line)) OVER w - length(line) AS at_, list_filter([{_PATH}], lambda x: x IS NOT NULL) AS path
  FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
secs AS (SELECT doc_id, section, arg_min(path, n) AS path, min(at_) AS a0, min(n) AS l0, max(n) AS l1, string_agg(line, '' ORDER BY n) AS c FROM placed GROUP BY doc_id, section HAVING regexp_matches(c, '\\S')),
toks AS (SELECT doc_id, section, i, length(regexp_extract(c, '^\\s*')) + sum(length(t)) OVER (PARTITION BY doc_id, section ORDER BY i) - length(t) AS st FROM (
    SELECT doc_id, section, c, unnest(l) AS t, unnest(range(len(l))) AS i FROM (SELECT *, regexp_extract_all(c, '\\S+\\s*') AS l FROM secs))),
starts AS (SELECT doc_id, section, list(st ORDER BY i) AS st, count(*) AS m FROM toks GROUP BY doc_id, section),
wins AS (SELECT *, unnest(range(0, greatest(ceil((m - {most}) / ({most} - {overlap})), 0)::BIGINT + 1)) * ({most} - {overlap}) AS s FROM secs JOIN starts USING (doc_id, section)),
ends AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE st[s + 1] END AS a, CASE WHEN s + {most} >= m THEN length(c) ELSE st[s + {most} + 1] END AS b FROM wins),
told AS (SELECT *, substr(c, a::BIGINT + 1, (b - a)::BIGINT) AS content, l0 + length(substr(c, 1, a::BIGINT)) - length(replace(substr(c, 1, a::BIGINT), chr(10), '')) AS sl FROM ends)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section, s) - 1 AS chunk_index, array_to_string(path, ' > ') AS path, (a0 + a)::BIGINT AS start_char, (a0 + b)::BIGINT AS end_char, sl::BIGINT AS start_line, (CASE WHEN m <= {most} THEN l1 ELSE sl + length(content) - length(replace(content, chr(10), '')) END)::BIGINT AS end_line, least({most}, m - s)::BIGINT AS token_count, md5(content) AS h FROM told"""


add("TXT2_heading_chunks", lambda s, d: K.chunks(B.notes(s, d), "doc_id", most=64, overlap=8).select("doc_id", "chunk_index", F.array_join("heading_path", " > ").alias("path"), "start_char", "end_char", "start_line", "end_line", "token_count", F.md5("content").alias("h")), NOTES + ", texts AS (SELECT doc_id, text FROM notes), " + _chunked(64, 8))
add("PRJ1_snippet", lambda s, d: B.documents(s, d).select("doc_id", X.snippet(F.col("text")).alias("snippet")), "WITH t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM documents) SELECT doc_id, CASE WHEN length(s) > 200 THEN regexp_replace(substring(s, 1, 200), '\\s+$', '') || '...' ELSE s END AS snippet FROM t")
add("PRJ2_heading_join", lambda s, d: table(s, d, "nation").select(F.array_join(F.array(F.lit("World"), "n_name"), " > ").alias("path")), "SELECT 'World > ' || n_name AS path FROM nation")
add("PRJ3_match_signals", lambda s, d: table(s, d, "orders").select("o_orderkey", *[F.when(F.col("o_orderkey") % m == 0, 1).alias(c) for c, m in (("a", 2), ("b", 3), ("c", 5))]).select("o_orderkey", F.array_join(X.signals("a", "b", "c"), ",").alias("signals")), "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN 'keyword' END, CASE WHEN o_orderkey % 3 = 0 THEN 'semantic' END, CASE WHEN o_orderkey % 5 = 0 THEN 'exact-term' END) AS signals FROM orders")
add("PRJ4_matched_terms", lambda s, d: B.documents(s, d).select("doc_id", F.array_intersect(F.array_distinct(X.tokens(F.col("text"))), F.array(F.lit("the"), F.lit("der"))).alias("m")).select("doc_id", F.array_join(F.when(F.size("m") > 0, F.array_sort("m")).otherwise(F.array(F.lit("query"))), ",").alias("terms")), "WITH m AS (SELECT doc_id, list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')), lambda x: x IN ('the', 'der'))) AS m FROM documents) SELECT doc_id, CASE WHEN len(m) > 0 THEN array_to_string(m, ',') ELSE 'query' END AS terms FROM m")
add("PRJ5_rerank_payload", lambda s, d: B.documents(s, d).select("doc_id", F.md5(F.concat("project", F.lit("\n"), "text")).alias("h")), "SELECT doc_id, md5(source || chr(10) || text) AS h FROM documents")
add("PRJ6_citation", lambda s, d: B.chunks(s, d).select("doc_id", "pos", F.format_string('%s/d%d v%d, section "%s"', "project", "doc_id", "pos", "doc_type").alias("citation")), f"WITH {B.CHUNKS} SELECT doc_id, pos, project || '/d' || doc_id || ' v' || pos || ', section \"' || doc_type || '\"' AS citation FROM chunks")
add("PRJ7_line_slice", lambda s, d: B.documents(s, d).select("doc_id", F.md5(X.line_slice(F.col("text"), 2, 4)).alias("h")), "SELECT doc_id, md5(coalesce(array_to_string(string_split(text, chr(10))[2:4], chr(10)), '')) AS h FROM documents")
add("PRJ8_slug", lambda s, d: table(s, d, "part").select("p_partkey", X.slug(F.concat(F.lit("  "), "p_type", F.lit(" / "), "p_name", F.lit("!"))).alias("slug")), "SELECT p_partkey, substring(regexp_replace(regexp_replace(lower('  ' || p_type || ' / ' || p_name || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM part")
add("PRJ9_boundary_wrap", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.concat(F.lit("[trust: "), F.when(F.col("role") == "system", "curated").otherwise("user"), F.lit("]\n"), F.md5("text"), F.lit("\n[end]")).alias("wrapped")), "SELECT conv_id, turn, '[trust: ' || CASE WHEN role = 'system' THEN 'curated' ELSE 'user' END || ']' || chr(10) || md5(text) || chr(10) || '[end]' AS wrapped FROM conversations")
add("RET10_citation_indices", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(T.citations(F.concat(F.lit("see ["), (F.col("p_size") % 14).cast("string"), F.lit("] and [3] and [3], not [99]")), 10), ",").alias("cited")), "SELECT p_partkey, CASE WHEN p_size % 14 BETWEEN 1 AND 10 AND p_size % 14 <> 3 THEN CASE WHEN p_size % 14 < 3 THEN (p_size % 14) || ',3' ELSE '3,' || (p_size % 14) END ELSE '3' END AS cited FROM part")


def _budget(s, d):
    """Lines of an order taken in order while their quantities fit a budget of 60."""
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("size"))
    taken = within_budget(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "size"], "size", 60).groupBy("l_orderkey").agg(count_all().alias("n"), F.sum("size").alias("used"))
    return lines.select("l_orderkey").distinct().join(taken, "l_orderkey", "left").select("l_orderkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("used", F.lit(0)).alias("used"))


#: A greedy fold over items (g, k, size) numbered from 1 in each group, with budgets (g, budget): what is left after each, and whether it was taken.
FOLD = "f AS (SELECT g, 0::BIGINT AS k, budget::BIGINT AS rest, false AS taken, 0::BIGINT AS size FROM budgets UNION ALL SELECT i.g, i.k, CASE WHEN rest > 0 AND i.size <= rest THEN rest - i.size ELSE rest END, rest > 0 AND i.size <= rest, i.size FROM f JOIN items i ON i.g = f.g AND i.k = f.k + 1)"
add("WIN8_greedy_budget", _budget, f"WITH RECURSIVE items AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, trunc(l_quantity)) AS k, trunc(l_quantity)::BIGINT AS size FROM lineitem), budgets AS (SELECT DISTINCT g, 60 AS budget FROM items), {FOLD} SELECT g AS l_orderkey, count(*) FILTER (WHERE taken) AS n, coalesce(sum(size) FILTER (WHERE taken), 0)::BIGINT AS used FROM f GROUP BY g")


def _context(s, d):
    """Context of every project: its newest documents with their summaries, then its decisions, both greedily within one budget of 400 words.

    The newest are those with the largest ids; a summary counts its words, and the second section gets what the first one leaves.
    """
    docs = B.documents(s, d).where("status <> 'deleted'").select("project", F.col("doc_id").alias("id"), X.summary(F.col("text")).alias("text"))
    decisions = B.documents(s, d).where("doc_id % 9 = 0").select("project", F.col("doc_id").alias("id"), F.concat(F.lit("Use "), "doc_type", F.lit(" for all of it")).alias("text"))
    return C.build(docs, decisions, budget=400, limit=12)


CONTEXT = "WITH RECURSIVE s AS (SELECT source AS g, doc_id, coalesce(substring(regexp_replace(string_split(text, chr(10) || chr(10))[1], '^\\s+|\\s+$', '', 'g'), 1, 500), '') AS t FROM documents WHERE doc_id % 10 <> 0 AND source IS NOT NULL), items AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id DESC) AS k, doc_id, len(regexp_extract_all(t, '\\S+'))::BIGINT AS size FROM s QUALIFY k <= 12), budgets AS (SELECT DISTINCT source AS g, 400 AS budget FROM documents WHERE source IS NOT NULL)"
add("CTX1_project_context", _context, CONTEXT + f", {FOLD}, d AS (SELECT source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, 6::BIGINT AS size FROM documents WHERE doc_id % 9 = 0 QUALIFY k <= 12), left_of AS (SELECT g, min(rest) AS rest FROM f GROUP BY g) SELECT f.g AS project, count(*) FILTER (WHERE taken) AS documents, CAST(coalesce(any_value(least(n, rest_ // 6)), 0) AS BIGINT) AS decisions, any_value(rest_ - 6 * least(coalesce(n, 0), rest_ // 6))::BIGINT AS left_over FROM f JOIN (SELECT g, rest AS rest_ FROM left_of) USING (g) LEFT JOIN (SELECT g, count(*) AS n FROM d GROUP BY g) USING (g) GROUP BY f.g")


def _detailed(detail, budget, limit, since):
    """Documents of every project, newest first, and three kinds of records, in one budget."""

    def run(s, d):
        t = table(s, d, "documents").where("source is not null")
        docs = t.select(F.col("source").alias("project"), F.col("doc_id").alias("id"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.col("lang").alias("doc_type"), "text", (F.col("doc_id") * 37 % 1000).alias("modified"))
        kind = F.element_at(F.array(F.lit("decisions"), F.lit("requirements"), F.lit("open_questions")), (F.col("doc_id") % 3 + 1).cast("int"))
        records = t.where("doc_id % 4 = 0").select(F.col("source").alias("project"), kind.alias("section"), F.col("doc_id").alias("id"), F.concat(F.lit("Use it for all "), F.col("lang"), F.repeat(F.lit(" more"), (F.col("doc_id") % 5).cast("int"))).alias("text"))
        projects = t.select(F.col("source").alias("project")).distinct().withColumn("info", F.concat(F.lit("The project "), "project"))
        got = C.context(projects, docs, records, detail, budget, since, limit)
        return got.select("project", "section", "id", "tokens", "left_over", F.md5(F.coalesce("summary", F.lit(""))).alias("summary"), F.size(F.split(F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " ")), " ")).cast("long").alias("words"))

    return run


def _detailed_sql(detail, budget, limit, since):
    n = "len(regexp_extract_all({}, '\\S+'))"
    strip = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
    summary = "coalesce(substring(list_filter(list_transform(string_split(" + strip.format("text") + ", chr(10) || chr(10)), lambda p: " + strip.format("p") + "), lambda p: p <> '' AND NOT starts_with(p, '#'))[1], 1, 500), '')"
    base = "4::BIGINT" if detail == "brief" else f"4 + {n.format('summary')}"
    body = n.format("text") if detail == "full" else "0::BIGINT"
    cut = "CASE WHEN base + body > left_ AND sec = 0 AND left_ > 100 THEN least(body, greatest(left_ - 50, 0)) ELSE body END" if detail == "full" else "body"
    return f"""WITH RECURSIVE docs AS (SELECT source AS g, doc_id, coalesce(text, '') AS text, doc_id * 37 % 1000 AS modified, {summary if detail != "brief" else "''"} AS summary FROM documents WHERE source IS NOT NULL),
raw AS (SELECT g, 0 AS sec, -modified AS at_, doc_id, {base} AS base, {body} AS body, summary FROM docs WHERE modified >= {since}
  UNION ALL SELECT source, 1 + doc_id % 3, 0, doc_id, 5 + doc_id % 5, 0, '' FROM documents WHERE doc_id % 4 = 0 AND source IS NOT NULL),
items AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY sec, at_, doc_id) AS k FROM raw),
f AS (SELECT g, 0::BIGINT AS k, -1 AS sec, ({budget} - 3)::BIGINT AS rest, 0 AS n, false AS stop, false AS taken, 0::BIGINT AS kept FROM (SELECT DISTINCT g FROM items)
  UNION ALL SELECT g, k, sec, CASE WHEN take THEN left_ - base - kept ELSE left_ END, n0 + CASE WHEN live AND (sec > 0 OR take) THEN 1 ELSE 0 END, stop0 OR take AND left_ - base - kept <= 0, take, kept FROM (
    SELECT *, live AND base + kept <= left_ AS take FROM (
      SELECT *, NOT stop0 AND n0 < {limit} AS live, {cut} AS kept FROM (
        SELECT i.g, i.k, i.sec, i.base, i.body, f.rest AS left_, CASE WHEN i.sec = f.sec THEN f.n ELSE 0 END AS n0, i.sec = f.sec AND f.stop AS stop0 FROM f JOIN items i ON i.g = f.g AND i.k = f.k + 1))))
SELECT g AS project, ['documents', 'decisions', 'requirements', 'open_questions'][i.sec + 1] AS section, doc_id::VARCHAR AS id, (base + kept)::BIGINT AS tokens, rest AS left_over, md5(summary) AS summary,
  greatest(CASE WHEN i.sec = 0 THEN kept ELSE base END, 1)::BIGINT AS words FROM f JOIN items i USING (g, k) WHERE taken"""


for _detail, _budget_of, _limit_of, _since_of in (("brief", 60, 9, 0), ("standard", 500, 7, 300), ("full", 900, 8, 0)):
    add(f"CTX1_{_detail}_context", _detailed(_detail, _budget_of, _limit_of, _since_of), _detailed_sql(_detail, _budget_of, _limit_of, _since_of))


def expectations(results, expected):
    """Greedy one-to-one matching by query: results (query_id, rank, path, heading), expected (query_id, n, path, heading, threshold).

    Expectations take their turn by n, each the best ranked result that is left to it; a null heading asks for none. Both sides of a query meet as arrays in the JVM.
    """
    have = results.where("rank is not null").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "path", F.lower(F.coalesce("heading", F.lit(""))).alias("heading")))).alias("have"))
    want = expected.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("n", "path", F.lower("heading").alias("heading"), "threshold"))).alias("want"))

    def step(taken, e):
        fits = lambda h: (h["rank"] <= e["threshold"]) & h["path"].eqNullSafe(e["path"]) & (e["heading"].isNull() | F.contains(h["heading"], e["heading"])) & ~F.exists(taken, lambda x: x["rank"] == h["rank"])
        hit = F.get(F.filter("have", fits), F.lit(0))
        return F.when(hit.isNull(), taken).otherwise(F.concat(taken, F.array(F.struct(e["n"].cast("int").alias("n"), hit["rank"].cast("int").alias("rank")))))

    none = F.array().cast("array<struct<n:int,rank:int>>")
    return want.join(have, "query_id").select(F.col("query_id").cast("long").alias("query_id"), F.inline(F.aggregate("want", none, step)))


def _matched(s, d):
    # one order of an order's lines tells repeated line numbers and is the order in which the matching groups them
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", F.asc_nulls_last("l_partkey"), F.asc_nulls_last("l_suppkey"))
    first = ~F.col("l_linenumber").eqNullSafe(F.lag("l_linenumber").over(w))
    r = table(s, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_returnflag").alias("path"), F.col("l_linestatus").alias("heading"), first.alias("first")).where("first").drop("first")
    e = table(s, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.lit(1).alias("n"), F.lit("R").alias("path"), F.lit("f").alias("heading"), F.lit(5).alias("threshold"))
    return expectations(r, e)


add("MET4_expectation_matching", _matched, "WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1) SELECT l_orderkey AS query_id, 1 AS n, min(l_linenumber) AS rank FROM l JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber <= 5 GROUP BY l_orderkey")

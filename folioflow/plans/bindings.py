"""How the document engine's tables are bound to the driver's parquet tables, in Spark and as DuckDB text.

documents: source is the project, lang the document type, every tenth id is deleted. events: user_id is the document, every fifth
event is on branch dev, errors are deletes and all else saves. orders are jobs, conversations sessions and deltas, benchmark the gold set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.history import head_events
from folioflow.sources.tables import table

NOW = "2024-02-15 00:00:00"


def documents(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select("doc_id", "text", F.col("lang").alias("doc_type"), F.col("source").alias("project"), F.when(F.col("doc_id") % 10 == 0, "deleted").otherwise("active").alias("status"))


DOCUMENTS = "docs AS (SELECT doc_id, text, lang AS doc_type, source AS project, CASE WHEN doc_id % 10 = 0 THEN 'deleted' ELSE 'active' END AS status FROM documents)"


def micros(c) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp")) if isinstance(c, str) else F.unix_micros(c.cast("timestamp"))


def saves(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events")
    return t.select(F.col("user_id").alias("document_id"), F.when(F.col("event_id") % 5 == 0, "dev").otherwise("main").alias("branch"), F.col("event_id").alias("version_id"), micros("ts").alias("valid_from"), F.when(F.col("event_type") == "error", "delete").otherwise("save").alias("event_type"))


SAVES = "saves AS (SELECT user_id AS document_id, CASE WHEN event_id % 5 = 0 THEN 'dev' ELSE 'main' END AS branch, event_id AS version_id, epoch_us(ts) AS valid_from, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'save' END AS event_type FROM events)"


def heads(spark: SparkSession, d: str) -> DataFrame:
    return head_events(saves(spark, d))


HEADS = SAVES + ", heads AS (SELECT *, lead(valid_from) OVER (PARTITION BY document_id, branch ORDER BY valid_from, version_id) AS valid_to FROM saves)"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Lines with text, numbered from 0 in their document."""
    t = documents(spark, d)
    return t.select("doc_id", "project", "doc_type", "status", F.posexplode(F.split("text", "\n")).alias("pos", "content")).where(F.trim("content") != "").select("doc_id", F.col("pos").cast("long").alias("pos"), "project", "doc_type", "status", "content")


CHUNKS = DOCUMENTS + ", lines AS (SELECT doc_id, project, doc_type, status, string_split(text, chr(10)) AS l FROM docs), chunks AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, project, doc_type, status, l[i] AS content FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM lines) WHERE trim(l[i]) <> '')"

#: Fixed phrases that give every document the markup that the plain texts lack; {n:m} stands for doc_id modulo m.
NOTE = """# Head {n:1000000}
See [the guide](docs/g{n:7}.md#part) and [site](http://x.example/a).
## Status
Accepted
## Decision
Use redis v{n:3}.{n:5}.{n:2} and PostgreSQL for caching.
## Consequences
None known
REQ-{n:11}: The service must answer in {n:50} ms
The worker shall retry each failed job {n:9} times
```
# not a heading
The code in a fence must not be counted here
```
Should we move the index to zone {n:4}?
TODO: decide about the quota {n:6}
### Deep {n:8}
GET /api/v1/items/{n:13} reads MAX_ROWS_{n:5} on port 80{n:9}1
pip install fastapi uvicorn[standard] sqlalchemy
Contact a{n:17}@mail.example.com, api_key sk-abcdefghijklmnop{n:10}
"""


def _pieces() -> list:
    out, rest = [], NOTE
    while "{n:" in rest:
        a, _, rest = rest.partition("{n:")
        m, _, rest = rest.partition("}")
        out += [a, int(m)]
    return [*out, rest]


def notes(spark: SparkSession, d: str) -> DataFrame:
    t = documents(spark, d)
    parts = [F.lit(p) if isinstance(p, str) else (F.col("doc_id") % p).cast("string") for p in _pieces()]
    return t.select("doc_id", "project", F.concat(*parts, F.coalesce("text", F.lit(""))).alias("text"))


NOTES = DOCUMENTS + ", notes AS (SELECT doc_id, project, concat(" + ", ".join("'" + p.replace("'", "''") + "'" if isinstance(p, str) else f"doc_id % {p}" for p in _pieces()) + ", coalesce(text, '')) AS text FROM docs)"

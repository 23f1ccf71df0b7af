"""The library's entry points on a small corpus, and extraction that SQL cannot express against fixed texts."""

import pytest
from pyspark.sql import functions as F

from folioflow import api
from folioflow.functions import vectors as V
from folioflow.operators import candidates, jobs, retrieval
from folioflow.operators import textetl as T

NOTE = """Use GET /api/v2/items/{id} or POST /x, see ./docs/a-b.md and MAX_ROWS or THE port 8081.
SELECT * FROM Accounts; pip install Fast_API uvicorn[standard]
v1.2.3-rc1 at host:9000
key sk-abcdefghijklmnop12 Bearer aaa.bbb.ccc password: "hunter2hunter2"
mail a.b@c.example.org, call 555-123-4567, ssn 123-45-6789.
"""


def test_spans_of_fixed_text(spark):
    row = spark.createDataFrame([(NOTE,), (None,), ("",)], "t string").select("t", T.terms("t").alias("terms"), T.scan_all("t").alias("all"), T.redact("t").alias("clean")).collect()
    assert all(NOTE[x.start : x.stop] == x.raw for x in row[0].terms)
    found = {(x.kind, x.raw) for x in row[0].terms}
    assert found >= {("api_route", "/api/v2/items/{id}"), ("api_route", "/x"), ("file_path", "./docs/a-b.md"), ("env_var", "MAX_ROWS"), ("port", "8081"), ("port", "9000"), ("sql_identifier", "Accounts"), ("package", "Fast_API"), ("package", "uvicorn[standard]"), ("version", "v1.2.3-rc1")}
    assert not {"GET", "THE", "FROM", "SELECT", "POST"} & {raw for kind, raw in found if kind == "env_var"}
    assert [x.kind for x in row[0].all] == ["api_key", "bearer_token", "password", "email", "phone", "ssn"]
    assert [x.start for x in row[0].all] == sorted(x.start for x in row[0].all)
    assert row[0].clean.count("[REDACTED:") == 6 and "hunter2" not in row[0].clean and "sk-" not in row[0].clean
    assert row[1].terms == [] and row[2].terms == [] and row[1].clean is None and row[2].clean == ""


def test_entities_of_fixed_text(spark):
    text = "Postgres and k8s since 2024-01-05; TanStack Router\n```\nredis\n```\nRedis rediscovers"
    got = spark.createDataFrame([(text,)], "t string").select(T.entities("t").alias("e")).first().e
    assert [(x.name, x.kind, x.raw) for x in got] == [("postgresql", "technology", "Postgres"), ("kubernetes", "technology", "k8s"), ("tanstack router", "technology", "TanStack Router"), ("redis", "technology", "Redis"), ("2024-01-05", "date", "2024-01-05")]
    both = spark.createDataFrame([(text,)], "t string").select(T.entities("t").alias("e")).select(T.merged_entities(F.slice("e", 1, 2), F.col("e")).alias("m")).first().m
    assert [x.start for x in both] == sorted(x.start for x in got)


def test_questions_of_fixed_text(spark):
    text = "Plan\nShould we move the index to zone 4?\n```\nIs this in a fence or is it not?\n```\nTODO: decide about quota\nQuestion: what is the limit of this thing?\nTBD: what is the limit of this thing?\n"
    got = candidates.questions(spark.createDataFrame([(1, text), (1, text), (2, None), (3, "")], "id long, t string"), "id", "t").orderBy("method", "start").collect()
    assert [(x.id, x.question, x.context, x.method) for x in got] == [(1, "Should we move the index to zone 4?", "Plan", "regex_question_mark"), (1, "what is the limit of this thing?", "TODO: decide about quota", "regex_question_mark"), (1, "TBD: what is the limit of this thing?", "Question: what is the limit of this thing?", "regex_question_mark"), (1, "decide about quota", None, "regex_todo_marker")]
    assert all(text[x.start : x.stop].strip().endswith(x.question) for x in got)


def test_requirements_of_fixed_text(spark):
    text = "REQ-1: The cache must hold it all\nUS-22  one may sign in\nREQ-3: The cache must hold it all\nEach node shall answer in a second\nWill it be ready for the winter?\nTODO: it must be ready some day soon\n```\nThis must not be counted at all\n```\nEach node shall answer in a second\n"
    got = candidates.requirements(spark.createDataFrame([(1, text), (2, None)], "id long, t string"), "id", "t").orderBy("start").collect()
    assert [(x.requirement_id, x.title, x.priority, x.confidence) for x in got] == [("REQ-1", "The cache must hold it all", "must", 1.0), ("US-22", "one may sign in", "could", 1.0), (None, "REQ-3: The cache must hold it all", "must", 0.8), (None, "Each node shall answer in a second", "must", 0.8)]


def test_paths_of_links(spark):
    raw = ["docs/a.md#x", "./a//b/./c.md", "/x/../y", "//net/a", "///a/", "http://a/b", "mailto:x@y", "#part", " a.md ", ".", "", None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").select("i", T.plain_path(F.col("r")).alias("p")).orderBy("i").collect()
    assert [x.p for x in got] == ["docs/a.md", "a/b/c.md", "/x/../y", "//net/a", "/a", None, None, None, "a.md", None, None, None]


def test_byte_pair_tokens(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, texts = Tokenizer.from_file(path), ["Größe and size " * 60, "one", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.bpe_ids("t", path).alias("ids"), T.bpe_truncated("t", 7, path).alias("cut"))
    for t, r in zip(texts, df.collect(), strict=True):
        want = None if t is None else library.encode(t, add_special_tokens=False).ids
        assert r.ids == want and r.cut == (None if t is None else t if len(want) <= 7 else library.decode(want[:7]))
    w = df.where("t like 'Gr%'").select("ids", T.id_windows(F.col("ids"), 50, 10).alias("w")).first()
    assert [x.ids for x in w.w] == [w.ids[i : i + 50] for i in range(0, len(w.ids), 40) if i == 0 or i + 10 < len(w.ids)]


def request(**more):
    return api.SearchRequest("backup of the index", **more)


def test_request_validation():
    assert request(version_scope="as_of:2024-01-05T00:00:00Z").validated().version_scope == "as_of:2024-01-05T00:00:00+00:00"
    assert request(version_scope="branch: dev ").validated().version_scope == "branch:dev"
    for bad in ({"version_scope": "as_of:2024-01-05T00:00:00"}, {"version_scope": "as_of:x"}, {"version_scope": "branch: "}, {"version_scope": "old"}, {"limit": 0}, {"limit": 101}, {"mode": "x"}):
        with pytest.raises(ValueError):
            request(**bad).validated()
    for text in ("", "x" * 501):
        with pytest.raises(ValueError):
            api.SearchRequest(text).validated()


@pytest.fixture(scope="module")
def corpus(spark):
    docs = [(i, f"backup of the index number {i} with MAX_ROWS_{i % 4}" if i % 3 == 0 else f"other words {i}", f"p{i % 2}", "note", "deleted" if i % 10 == 0 else "active", 100 + i) for i in range(60)]
    heads = [(i, "main", 100 + i, i * 10, "save", 305 if i == 9 else None) for i in range(60)] + [(3, "dev", 103, 400, "save", None)]
    frame = spark.createDataFrame(docs, "id long, text string, project string, doc_type string, status string, version_id long")
    h = spark.createDataFrame(heads, "document_id long, branch string, version_id long, valid_from long, event_type string, valid_to long")
    vectors = spark.createDataFrame([(i, [1.0, i / 10.0]) for i in range(60)], "id long, v array<double>")
    return api.Corpus(frame, vectors, None, h, spark.createDataFrame([("s1", 106), ("s1", 100)], "snapshot string, version_id long"))


def test_search_scopes(spark, corpus):
    """Scopes hold within each signal: what is out of scope neither comes up nor takes the place of what does."""
    ids = lambda **more: {r.id for r in api.search(corpus, request(limit=100, **more), cap=None).collect()}
    live = {i for i in range(0, 60, 3) if i % 10}
    assert ids() == live and ids(project="p1") == {i for i in live if i % 2}
    assert ids(version_scope="all") == live
    assert ids(version_scope="as_of:1970-01-01T00:00:00.000300Z") == {i for i in range(0, 31, 3)}
    assert ids(version_scope="as_of:1970-01-01T00:00:00.000310Z") == {i for i in range(0, 31, 3) if i != 9}
    assert ids(version_scope="branch:dev") == {3}
    assert ids(version_scope="snapshot:s1") == {0, 6} and ids(version_scope="snapshot:none") == set()
    hits = api.search(corpus, api.SearchRequest("MAX_ROWS_1 index", limit=5)).orderBy("final_rank").collect()
    assert "exact-term" in hits[0].signals and hits[0].snippet.endswith("MAX_ROWS_1") and len(hits) == 5
    assert all(sum(x.project == p for x in hits) <= 3 for p in ("p0", "p1"))
    near = api.search(corpus, request(limit=3), embed=lambda q: [0.0, 1.0], cap=None).collect()
    assert all(r.rank_vector is not None for r in near)


def test_phases_and_facets(spark, corpus):
    rerank = lambda q, df: df.select("query_id", "id", (-F.col("id")).cast("double").alias("rerank_score"))
    phases = dict(api.search_phases(corpus, request(limit=6), rerank=rerank))
    assert list(phases) == ["lexical", "hybrid", "reranked"] and phases["lexical"].count() == 6
    order = [r.id for r in phases["reranked"].orderBy("reranked").collect()]
    assert order == sorted(order)
    f = api.facets(phases["hybrid"], corpus.technical_terms)
    assert f["doc_type"].first().n == 6 and f["project"].count() == 2 and f["term"].count() >= 1


def test_best_hundred_of_a_scope(spark):
    """A hundred and fifty deleted documents of higher score don't keep the live ones from the result."""
    docs = spark.createDataFrame([(i, "word " * 5 if i < 150 else "word and more of other things", "p", "note", "deleted" if i < 150 else "active") for i in range(155)], "id long, text string, project string, doc_type string, status string")
    assert {r.id for r in api.search(api.Corpus(docs), api.SearchRequest("word"), cap=None).collect()} == set(range(150, 155))


def test_history(spark, corpus):
    assert [r.branch for r in api.versions(corpus.heads, 3).collect()] == ["dev", "main"]
    texts = spark.createDataFrame([(1, "a\nb\n"), (2, "a\nc\nd\n")], "version_id long, text string")
    got = api.diff(texts, 1, 2).first()
    assert (got.added, got.removed) == (2, 1)
    again = api.restore(corpus.heads, 9, 109, 900).where("document_id = 9").orderBy("valid_from").collect()
    assert [(r.version_id, r.valid_from, r.valid_to) for r in again] == [(109, 90, 900), (109, 900, None)]


def test_review_and_jobs(spark):
    rows = spark.createDataFrame([(1, "b", "high", 0.5, "pending", None), (2, "a", "high", None, "pending", None), (3, "c", "low", 0.9, "pending", None), (4, "d", "low", 0.9, "accepted", 5)], "candidate_id long, title string, severity string, confidence double, status string, decided_at long")
    assert [r.candidate_id for r in api.inbox(rows).collect()] == [1, 2, 3] and [r.candidate_id for r in api.inbox(rows, "confidence").collect()] == [3, 1, 2]
    done = {r.candidate_id: (r.status, r.decided_at) for r in api.decide(rows, rows.where("candidate_id in (1, 4)"), False, 9).collect()}
    assert done == {1: ("rejected", 9), 2: ("pending", None), 3: ("pending", None), 4: ("accepted", 5)}
    finished = spark.createDataFrame([("p", 1, "a.sql", "h", "extract", "raw"), ("p", 1, "a.sql", "h", "extract", "raw"), ("p", 2, "a.md", "g", "extract", "raw"), ("p", 3, "a.pdf", "f", "extract", "unsupported"), ("p", 2, "a.md", "g", "chunk", None)], "project string, version long, path string, content_hash string, job_type string, text_kind string")
    got = sorted((r.version, r.job_type) for r in jobs.fan_out(finished, models=("ner",)).collect())
    assert got == [(1, "chunk"), (1, "extract_candidates"), (1, "link_detect"), (1, "ner_gliner"), (1, "schema_parse"), (2, "chunk"), (2, "embed"), (2, "extract_candidates"), (2, "link_detect"), (2, "ner_gliner"), (2, "technical_terms")]
    queued = jobs.fan_out(finished)
    assert jobs.to_queue(queued, queued.where("job_type <> 'embed'")).select("job_type").distinct().collect() == [("embed",)]
    assert set(jobs.reachable()) == {b for _, b, _, _ in jobs.FOLLOWS} | {"extract"}


def test_vector_blocks_and_containing(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(30)], "id long, v array<double>")
    q = spark.createDataFrame([(i, [1.0, i + 0.2]) for i in range(9)], "query_id long, q array<double>")
    want = sorted(map(str, retrieval.vector_search(v, q, 3).collect()))
    assert sorted(map(str, retrieval.vector_search(v, q, 3, block=2).collect())) == want
    text = "the quick brown fox jumps over a lazy dog near the river bank"
    docs = spark.createDataFrame([(1, text), (2, "x" + text), (3, text.replace("lazy", "Lazy")), (4, None), (5, "")], "id long, text string")
    items = spark.createDataFrame([(1, "quick brown fox jumps over a lazy"), (2, "fox"), (3, "ick brown fox jumps over a laz"), (4, ""), (5, None)], "query_id long, t string")
    assert sorted(map(tuple, retrieval.containing(docs, items).collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)]


def test_guards_and_padding(spark):
    row = spark.createDataFrame([(" ", ["a"]), ("q", []), ("q", ["a"] * 3), ("qqqqqq", ["a"]), ("q", ["aaaa"]), ("q", ["a"])], "q string, d array<string>")
    limits = {"most_documents": 2, "most_query": 5, "most_document": 3}
    assert [r.p for r in row.select(V.request_problem(F.col("q"), F.col("d"), **limits).alias("p")).collect()] == ["empty query", "empty documents", "too many documents", "query too long", "document too long", None]
    with pytest.raises(Exception, match="too many documents"):
        row.select(V.checked_request(F.col("q"), F.col("d"), **limits).alias("p")).where("size(d) = 3").collect()
    ids = spark.createDataFrame([([1, 2, 3, 4, 5],), ([9],)], "i array<int>").select(V.fitted_ids(F.col("i"), [101], [102], 5).alias("i")).select(V.left_padded(F.col("i"), F.lit(5)).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in ids] == [([101, 1, 2, 3, 102], [1] * 5), ([0, 0, 101, 9, 102], [0, 0, 1, 1, 1])]


def test_detectors_and_overview(spark):
    day = 86_400_000_000
    values = spark.createDataFrame([("db", "1", "a"), ("db", "2", "b"), ("db", "1", "c"), ("os", "1", "a"), ("os", None, "b"), ("os", "", "c")], "entity string, value string, doc string")
    links = spark.createDataFrame([("a.md", "b.md"), ("a.md", "gone.md"), ("a.md", "gone.md")], "source string, target string")
    paths = spark.createDataFrame([("a.md",), ("b.md",)], "path string")
    docs = spark.createDataFrame([("new", 99 * day), ("old", 30 * day), ("ancient", -40 * day)], "title string, changed_at long")
    got = {(r.kind, r.severity, r.title) for r in api.detect(values, links, paths, docs, 100 * day).collect()}
    assert got == {("contradiction", "warning", "Conflicting values for db: 1, 2"), ("broken_link", "warning", "a.md links to missing gone.md"), ("stale", "info", "Not changed for long: old"), ("stale", "warning", "Not changed for long: ancient")}
    d = spark.createDataFrame([("p", "active", 5), ("p", "deleted", 9), ("q", "active", 1)], "project string, status string, changed_at long")
    j = spark.createDataFrame([("p", "queued"), ("p", "failed"), ("r", "running")], "project string, status string")
    assert {tuple(r) for r in api.overview(d, j).collect()} == {("p", 1, 5, 1, 1), ("q", 1, 1, 0, 0), ("r", 0, None, 1, 0)}
    rows = spark.createDataFrame([(i, f"u{i % 2}", "save", i) for i in range(10)], "at long, actor string, operation string, id long")
    assert [r.id for r in api.audit(rows, since=2, until=9, actor="u0", offset=1, limit=2).collect()] == [6, 4]
    assert [r.id for r in api.newest(rows, "actor", "at", 1).orderBy("id").collect()] == [8, 9]


def test_context_and_evaluation(spark):
    docs = spark.createDataFrame([("p", 1, "one two three"), ("p", 2, "a " * 9), ("p", 3, "x y"), (None, 4, "z"), ("q", 5, None)], "project string, id long, text string")
    rules = spark.createDataFrame([("p", 1, "use it"), ("r", 2, "w " * 20)], "project string, id long, text string")
    got = {r.project: ([x.id for x in r.documents or []], [x.id for x in r.decisions or []], r.left_over) for r in api.project_context(docs, rules, budget=8).collect()}
    assert got == {"p": ([3, 1], [1], 1), "q": ([5], [], 8), "r": ([], [], 8)}
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 3)], "query_id long, id long, rank int")
    expected = spark.createDataFrame([(1, 11), (2, 20), (2, 21), (3, 30)], "query_id long, id long")
    m = api.evaluate(results, expected, 2)
    assert {(r.query_id, r.recall, r.mrr) for r in m.collect()} == {(1, 1.0, 0.5), (2, 0.0, 0.333333), (3, 0.0, 0.0)}
    assert api.compare_runs(m, m.where("query_id = 1"), ("old", "new")).first().winner == "new"

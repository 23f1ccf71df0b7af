"""Chunks, the stored index, stored tables, joins in time and along an axis, streams over restarts, model calls and bundles, against brute force."""

import bisect
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioflow.operators import chunking, context, graph, history, lifecycle, models, overlays, retrieval, stored
from folioflow.operators.inverted import InvertedIndex
from folioflow.plans.stream_queries import _rocks
from folioflow.session import shared_dir
from folioflow.sources import bundles
from folioflow.streaming import sessions, stateful


def test_chunks(spark):
    texts = ["# T\n\nShort.", "", "  \n", None, "plain", "# C\n\n```py\n# no\n```\nAfter.\r\n## x \r\nb\x0cc\n### y\n# z\n#### w\nend", "# Long\n\n" + "wörd 日本 " * 400 + "\n## Next\nend of it"]
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (0, "another")], "id long, text string")
    for most, overlap in ((50, 10), (7, 0), (3, 5)):
        own = {}
        for r in chunking.chunks(df, most=most, overlap=overlap).collect():
            own.setdefault(r.id, []).append(r)
        assert set(own) == {0, 4, 5, 6} and len(own[0]) == (2 if most > 3 else len(own[0]))
        for i in (4, 5, 6):
            got = sorted(own[i], key=lambda r: r.chunk_index)
            assert [r.chunk_index for r in got] == list(range(len(got)))
            assert all(texts[i][r.start_char : r.end_char] == r.content and 0 < r.token_count <= most for r in got)
            covered = {k for r in got for k in range(r.start_char, r.end_char)}
            assert covered == set(range(len(texts[i])))
            assert all(r.start_line == 1 + len((texts[i][: r.start_char] + "|").splitlines()) - 1 for r in got if "\x0c" not in texts[i])
    paths = {r.content[:3]: r.heading_path for r in chunking.chunks(df).where("id = 5").collect()}
    assert paths == {"# C": ["C"], "## ": ["C", "x"], "###": ["z", "w"], "# z": ["z"]} or paths["# C"] == ["C"] and paths["# z"] == ["z"]
    heads = [tuple(r.heading_path) for r in chunking.chunks(df).where("id = 5").orderBy("chunk_index").collect()]
    assert heads == [("C",), ("C", "x"), ("C", "x", "y"), ("z",), ("z", "w")]


def test_chunks_of_byte_pairs(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    text = "# Größe\n" + "Ünïcode words 日本語 and more. " * 60
    got = chunking.chunks(spark.createDataFrame([(1, text)], "id long, text string"), tokenizer=chunking.byte_pairs(path), most=40, overlap=8).orderBy("chunk_index").collect()
    assert len(got) > 3 and all(text[r.start_char : r.end_char] == r.content and r.token_count <= 40 for r in got)
    assert got[-1].end_char == len(text) and all(b.start_char < a.end_char for a, b in zip(got, got[1:], strict=False))


def test_index_kept_up_equals_one_built_anew(spark):
    r = random.Random(1)
    word = lambda: f"t{r.randrange(60)}" if r.random() < 0.7 else "the"
    texts = {i: " ".join(word() for _ in range(r.randrange(40))) for i in range(80)} | {80: None, 81: "unique81"}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, text string")
    kept = InvertedIndex(spark, shared_dir(spark), buckets=4, parts=3).build(frame(texts))
    for turn in range(2):
        changed = {i: " ".join(word() for _ in range(r.randrange(30))) for i in r.sample(range(100), 20)} | {7: None, 8: "new the"}
        gone = r.sample(sorted(texts), 10) + [81, 999]
        delta = frame(changed), spark.createDataFrame([(i,) for i in gone if i not in changed], "id long")
        kept.update(*delta)
        kept.update(*delta)  # once more changes nothing
        texts = {i: t for i, t in texts.items() if i not in gone} | changed
        anew = InvertedIndex(spark, shared_dir(spark), buckets=4, parts=3).build(frame(texts))
        for name in ("postings", "terms", "lengths"):
            assert sorted(map(str, getattr(kept, name).collect())) == sorted(map(str, getattr(anew, name).collect())), (turn, name)
    queries = spark.createDataFrame([(1, "the"), (1, "t5"), (2, "t7"), (3, "nowhere")], "query_id long, token string")
    told = lambda ix: sorted((x.query_id, x.id, round(x.score, 9)) for x in retrieval.bm25(ix, queries).collect())
    assert told(kept) == told(anew) and {x[0] for x in told(kept)} == {1, 2}
    plan = kept.of(queries.where("query_id = 2"))[0]._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan


@pytest.mark.parametrize("hot", [10, 500, 10**6])
def test_as_of_join_of_hot_keys(spark, hot):
    r = random.Random(4)
    times = sorted(r.sample(range(40_000), 4000))
    versions = [("hot", k, a, b if r.random() < 0.9 else (a + b) // 2) for k, (a, b) in enumerate(zip(times, [*times[1:], None], strict=True)) if b is not None] + [("hot", 9999, times[-1], None), ("cold", 1, 5, 9), (None, 2, 0, None)]
    probes = [(k, "hot", r.randrange(-50, 41_000)) for k in range(4000)] + [(9001, "cold", 5), (9002, "cold", 9), (9003, "none", 5), (9004, None, 5), (9005, "hot", None)]
    v = spark.createDataFrame(versions, "k string, version long, a long, b long")
    p = spark.createDataFrame(probes, "probe long, k string, at long")
    got = {x.probe: x.version for x in history.as_of(p, v, ["k"], "at", "a", "b", ["version"], hot=hot, slices=8).collect()}
    starts = [x[2] for x in versions if x[0] == "hot"]
    want = {9001: 1}
    for probe, k, at in probes:
        if k == "hot" and at is not None and (i := bisect.bisect_right(starts, at) - 1) >= 0:
            _, version, _, b = versions[i]
            if b is None or b > at:
                want[probe] = version
    assert got == want


def test_overlaps_of_any_length(spark):
    r = random.Random(6)
    spans = [(k, "d", a, a + r.choice([0, 1, 3, 40, 5000])) for k, a in enumerate(r.choices(range(60_000), k=150))] + [(900, "e", 0, 10), (901, None, 0, 9)]
    chunks = [(k, "d", a, a + r.choice([0, 1, 2, 64, 65, 3000])) for k, a in enumerate(r.choices(range(60_000), k=300))] + [(900, None, 0, 9)]
    got = {(x.span_id, x.chunk): x.shared for x in graph.overlaps(spark.createDataFrame(spans, "span_id long, doc string, a long, b long"), spark.createDataFrame(chunks, "chunk long, doc string, start long, stop long"), "doc").collect()}
    assert got == {(s, c): n for s, ks, a, b in spans for c, kc, x, y in chunks if ks and ks == kc and (n := min(b, y) - max(a, x)) > 0}


def test_stored_history_in_any_order(spark):
    r = random.Random(8)
    rows = [(r.randrange(6), r.choice(["main", "dev"]), k, r.randrange(500), r.choice(["save", "save", "delete"])) for k in range(120)]
    schema = "document_id long, branch string, version_id long, valid_from long, event_type string"
    kept = stored.StoredHistory(spark, shared_dir(spark), parts=3).create()
    r.shuffle(rows)
    for k in (0, 1, 0, 2):
        kept.sink(spark.createDataFrame(rows[k::3], schema), k)
    want = history.head_events(spark.createDataFrame(rows, schema)).select(kept.columns)
    assert sorted(map(str, kept.read().collect())) == sorted(map(str, want.collect()))
    kept.replace(spark.createDataFrame([], stored.HEADS), spark.createDataFrame([(1,), (2,)], "document_id long"))
    assert {x.document_id for x in kept.read().collect()} == {x[0] for x in rows} - {1, 2}


def test_streams_drop_late_events_and_free_their_state(spark):
    """Two runs of one query: state outlives the restart, what comes behind the watermark plays no part, and an idle session is abandoned."""
    begin, out = datetime(2024, 1, 1, tzinfo=UTC), shared_dir(spark)
    at = lambda minutes: begin + timedelta(minutes=minutes)
    first = [("a", 1, at(0), "view"), ("a", 2, at(1), "view"), ("a", 3, at(2), "view"), ("b", 4, at(300), "view")]
    second = [("a", 5, at(3), "view"), ("b", 6, at(301), "flush"), ("a", 7, at(400), "view"), ("c", 8, at(2000), "view")]
    schema = "k string, id long, ts timestamp, kind string"
    found = {}
    for name, start in (("rate", lambda df: stateful.rate_limited_stream(df, "k", "us", "id", 2, 3600)), ("fresh", lambda df: stateful.first_in_ttl_stream(df, ["k"], "us", "id", 600 * 60_000_000)), ("session", lambda df: stateful.sessions_stream(df, "k", "us", "id", "kind", 120 * 60_000_000)), ("burst", lambda df: sessions.debounced(df, "k", "ts", "5 minutes"))):
        with _rocks(spark):
            for rows in (first, second):
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{out}/{name}/in")
                df = spark.readStream.schema(schema).parquet(f"{out}/{name}/in").withWatermark("ts", "10 minutes")
                if name != "burst":
                    df = df.withColumn("us", F.unix_micros("ts"))
                start(df).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}/{name}/state").trigger(availableNow=True).start(f"{out}/{name}/rows").awaitTermination()
        found[name] = spark.read.parquet(f"{out}/{name}/rows").collect()
    assert {x.id: x.allowed for x in found["rate"]} == {1: True, 2: True, 3: False, 4: True, 6: True, 7: True, 8: True}  # 5 came too late
    assert {x.id for x in found["fresh"]} == {1, 4, 8}
    last = {x.k: x.state for x in sorted(found["session"], key=lambda x: (x["at"], x.state == "abandoned"))}
    assert last == {"a": "abandoned", "b": "abandoned", "c": "dirty"}
    assert sorted((x.k, x.n) for x in found["burst"]) == [("a", 1), ("a", 3), ("b", 2)]


def test_model_calls(spark):
    def picky():
        """Fails on bad texts, and on every batch that it sees for the first time."""
        seen = set()

        def model(texts: list) -> list:
            if tuple(texts) not in seen:
                seen.add(tuple(texts))
                raise OSError("first call")
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return [[float(len(t))] * (1 if t == "thin" else 3) for t in texts]

        return model

    texts = ["one", None, "  ", "bad", "three", "thin", "x" * 50, "last"] + [f"t{k}" for k in range(30)]
    df = spark.createDataFrame([*enumerate(texts)], "id long, text string").coalesce(1)
    got = {x.id: (x.vector, x.error) for x in models.embedded(df, "text", picky, 2, models.Limits(texts=5, chars=40, retries=1, wait=0)).collect()}
    assert got[0] == ([3.0, 3.0], None) and got[1] == got[2] == (None, "empty input") and got[3] == (None, "ValueError: bad text")
    assert got[5] == (None, "1 components instead of 2") and got[6] == (None, "input of more than 40 characters")
    assert all(got[k][0] == [float(len(texts[k]))] * 2 for k in (4, 7, *range(8, 38)))
    failed = {x.error: x.n for x in models.failures(models.embedded(df, "text", picky, 2, models.Limits(retries=0))).collect()}
    assert sum(failed.values()) == 3 and failed["empty input"] == 2 or "OSError: first call" in failed
    assert list(models.batched([3, 3, 9, 1, 1, 1], models.Limits(texts=2, tokens=6))) == [(0, 2), (2, 3), (3, 5), (5, 6)]


def test_bundles(spark):
    out = shared_dir(spark)
    store = bundles.BlobStore(spark, f"{out}/store")
    files = [("p", "a.md", "A"), ("p", "b.md", "B"), ("q", "a.md", "A"), ("q", "n.md", None)]
    df = spark.createDataFrame(files, "project string, path string, text string").withColumn("content", F.col("text").cast("binary"))
    assert store.put(df) == 2 and store.put(df) == 0
    docs = df.select("project", "path", F.lit("t").alias("title"), F.lit("note").alias("doc_type"), F.lit("active").alias("status"), F.sha2("content", 256).alias("hash"))
    versions = docs.where("path = 'a.md'").select("project", "path", F.lit("main").alias("branch"), F.lit(3).alias("version_number"), "hash", F.lit(9).cast("long").alias("created_at"))
    bundles.export(docs.where("project = 'p'"), versions.where("project = 'p'"), store, f"{out}/bundle")
    other = bundles.BlobStore(spark, f"{out}/other")
    present = docs.where("project = 'q'").unionByName(docs.where("path = 'b.md'").withColumn("title", F.lit("mine"))).unionByName(docs.where("path = 'b.md'").withColumn("path", F.lit("old.md")))
    for strategy, title, paths in (("merge", "t", {"a.md", "b.md", "old.md"}), ("skip", "mine", {"a.md", "b.md", "old.md"}), ("replace", "t", {"a.md", "b.md"})):
        got = bundles.take_in(f"{out}/bundle", other, present, versions.where("project = 'q'"), strategy)
        own = {x.path: x for x in got.documents.where("project = 'p'").collect()}
        assert set(own) == paths and own["b.md"].title == title and len({x.uid for x in own.values()}) == len(own)
        told = {(x.project, x.path): x.version_number for x in got.versions.collect()}
        assert told == {("p", p): 3 if p == "a.md" else 1 for p in paths} | {("q", "a.md"): 3, ("q", "n.md"): 1}
        assert got.imported == 2
    assert {bytes(x.content) for x in other.blobs().collect()} == {b"A", b"B"}
    with pytest.raises(ValueError, match="strategy"):
        bundles.take_in(f"{out}/bundle", other, present, versions, "none")
    with pytest.raises(ValueError, match="1 contents are not in the store"):
        bundles.export(docs.withColumn("hash", F.lit("00")).limit(1), versions.limit(0), store, f"{out}/none")
    spark.read.parquet(f"{out}/bundle/blobs").withColumn("content", F.lit("Z").cast("binary")).write.parquet(f"{out}/bad/blobs")
    for name in ("documents", "versions"):
        spark.read.parquet(f"{out}/bundle/{name}").write.parquet(f"{out}/bad/{name}")
    spark.read.schema("name string, rows long, checksum string").json(f"{out}/bundle/manifest").write.json(f"{out}/bad/manifest")
    with pytest.raises(ValueError, match="2 contents differ from their address"):
        bundles.verified(spark, f"{out}/bad")
    spark.read.parquet(f"{out}/bundle/documents").limit(1).write.mode("append").parquet(f"{out}/bad/documents")
    with pytest.raises(ValueError, match="documents differ from the manifest"):
        bundles.verified(spark, f"{out}/bad")


def test_collections_and_annotations(spark):
    own = overlays.Collections(spark, shared_dir(spark)).create()
    assert own.listed().collect() == []
    own.put(spark.createDataFrame([("c1", "p", "one", 1), ("c2", "q", "two", 2)], "collection string, project string, name string, created_at long"))
    docs = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "document long, project string")
    add = lambda rows: own.add(spark.createDataFrame(rows, "collection string, document long, added_at long"), docs)
    add([("c1", 1, 10), ("c1", 1, 9), ("c1", 3, 10), ("c1", 99, 10), ("none", 1, 10), ("c2", 3, 10)])
    add([("c1", 1, 20), ("c1", 2, 20)])
    assert {x.collection: x.members for x in own.listed().collect()} == {"c1": 2, "c2": 1}
    assert {(x.document, x.added_at) for x in own.members.read().collect()} == {(1, 9), (2, 20), (3, 10)}
    assert [(x.document, x.name) for x in own.of(docs.where("document < 2")).collect()] == [(1, "one")]
    own.remove(spark.createDataFrame([("c1", 1), ("c2", 77)], "collection string, document long"))
    own.delete(spark.createDataFrame([("c2",)], "collection string"))
    assert [(x.collection, x.members) for x in own.listed().collect()] == [("c1", 1)] and own.members.read().count() == 1
    notes = spark.createDataFrame([(1, 5, "comment", "x", 0, 3, 1), (2, 6, "note", "x", None, None, 1), (3, 5, "other", "x", 0, 3, 1), (4, 5, "note", "x", 3, 3, 1), (5, 5, None, "x", -1, 3, 1)], "annotation long, version long, kind string, content string, start int, stop int, created_at long")
    got = {x.annotation: x.error for x in overlays.annotated(notes, spark.createDataFrame([(5,)], "version long")).collect()}
    assert got == {1: None, 2: "unknown version", 3: "unknown kind", 4: "span is empty", 5: "unknown kind"}
    refs = spark.createDataFrame([(1, "p", "a", 1, None, None), (2, "p", "a", 1, 2, 9), (3, "p", "a", 2, 1, 1), (4, "z", "a", 1, 1, 1), (5, "p", "a", 1, 0, 1)], "ref_id long, project string, path string, version int, first int, last int")
    texts = spark.createDataFrame([("p", "a", 1, "one\ntwo\nthree")], "project string, path string, version int, text string")
    assert {x.ref_id: x.content or x.error for x in overlays.resolved(refs, texts).collect()} == {1: "[p]\none\ntwo\nthree\n[end]", 2: "[p]\ntwo\nthree\n[end]", 3: "source not found", 4: "project z not found", 5: "no such lines"}


def test_sessions_end_only_when_flushed(spark):
    events = [("a", 1, 1, "start", None), ("a", 2, 2, "preflight", "read"), ("a", 3, 3, "delta", "file"), ("a", 4, 4, "finalize", None), ("a", 5, 5, "flush", None), ("a", 6, 6, "finalize", None), ("a", 7, 7, "delta", "file"), ("b", 1, 8, "start", None), ("b", 2, 9, "delta", "file"), ("b", 2, 10, "delta", None), ("c", 1, 11, "delta", "file"), ("b", 3, 12, "other", None)]
    df = spark.createDataFrame(events, "session string, at long, seq long, kind string, detail string")
    got = {x.session: (x.status, x.is_dirty, x.unflushed, x.dirty_reasons, x.last_preflight_action, x.last_flush_at, x.ended_at, x.blocked) for x in lifecycle.status(df).collect()}
    assert got == {"a": ("finalized", False, 0, None, "read", 5, 6, 1), "b": ("active", True, 2, {"file": 1, "other": 1}, None, None, None, 0)}
    free = {x.session: (x.status, x.ended_at, x.unflushed) for x in lifecycle.status(df, blocking=False).collect()}
    assert free == {"a": ("finalized", 4, 1), "b": ("active", None, 2)}


def test_entity_details(spark):
    ents = spark.createDataFrame([(1, "t", "one"), (2, "t", "two"), (3, "t", "three")], "entity long, kind string, name string")
    said = spark.createDataFrame([(1, "d1"), (1, "d2"), (2, "d1")], "entity long, document string")
    edges = spark.createDataFrame([(1, 2, "uses"), (3, 1, "owns"), (2, 9, "uses")], "source long, target long, kind string")
    heads, mentions, ways = graph.entity_detail(ents, said, edges, spark.createDataFrame([(1,), (3,), (1,), (77,)], "entity long"))
    assert {(x.entity, x.mentions) for x in heads.collect()} == {(1, 2), (3, 0)} and mentions.count() == 2
    assert {(x.entity, x.direction, x.kind, x.other_name) for x in ways.collect()} == {(1, "outgoing", "uses", "two"), (1, "incoming", "owns", "three"), (3, "outgoing", "owns", "one")}


def test_context_of_projects(spark):
    docs = [("p", k, f"T{k}", "note", f"---\ntitle: x\n---\n# Head\n\nBody {k}\n\n" + "word " * (150 if k == 3 else 5), k) for k in range(5)] + [(None, 9, "T", "note", "x", 9), ("q", 10, "T", None, None, 1)]
    d = spark.createDataFrame(docs, "project string, id long, title string, doc_type string, text string, modified long")
    r = spark.createDataFrame([("p", "decisions", 1, "use it"), ("p", "requirements", 2, None), ("p", "other", 3, "x")], "project string, section string, id long, text string")
    p = spark.createDataFrame([("p", "the project"), ("q", None)], "project string, info string")
    brief = context.context(p, d, r, "brief", budget=100).where("project = 'p'").orderBy("section", "place").collect()
    assert [(x.section, x.id) for x in brief] == [("decisions", "1")] + [("documents", str(k)) for k in (4, 3, 2, 1, 0)] + [("requirements", "2")]
    assert all(x.summary is None and x.content is None for x in brief if x.section == "documents")
    full = context.context(p, d, r, "full", budget=150, since=2, limit=2).where("project = 'p' and section = 'documents'").orderBy("place").collect()
    assert [x.id for x in full] == ["4", "3"] and full[0].content.startswith("# Head") and 0 < len(full[1].content.split()) < 153 and full[1].left_over >= 0
    with pytest.raises(ValueError, match="detail"):
        context.context(p, d, r, "none")

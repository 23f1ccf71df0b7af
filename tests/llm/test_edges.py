"""The operators beyond their contract queries: SQL twins on the small fixture, other paths, clashing names, nulls, repeated rows, long texts, ties."""

import glob
import itertools
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_contracts import SOLID, VOCABULARY, WORD, LOW, linked, sha, texts, world  # noqa: F401

from folioflow.llm import bpe, chat, decontaminate, language, minhash, mixing, neighbours, phrases, quality, sstable, suffixes
from folioflow.llm.queries import QUERIES, SQL


def told(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: float(f"{v:.12g}") if isinstance(v, float) else v
    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, world, name):  # noqa: F811
    con = duckdb.connect()
    for p in glob.glob(f"{world['dir']}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    r = con.execute(SQL[name])
    df = QUERIES[name](spark, world["dir"])
    assert told(df.columns, df.collect()) == told([c[0] for c in r.description], r.fetchall())


CLASH = "doc_id long, text string, n_hit int, items int, score int, lang_pred int, _size int, _p int, label int, node int, h int, t int, k int, c0 int, _id int, spans int, row int"


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, one id with two texts, null ids and texts, blank ones, a long text, and columns with operators' own names."""
    r = random.Random(4)
    make = lambda n: " ".join(r.choices(VOCABULARY, k=n))
    a, b = make(80), make(70)
    rows = [(1, a), (1, a), (2, b + " " + a), (2, make(60)), (None, a), (None, None), (3, None), (4, ""), (5, " \n "), (6, make(30_000) + " " + b), (7, a.upper()), (8, b)]
    return rows, spark.createDataFrame([(i, t, *range(15)) for i, t in rows], CLASH)


def test_unlike_texts_of_one_id(spark, odd):
    """op2, op7: rows of one id and text count once, unlike texts of an id are documents one after the other, rows without an id stay whole."""
    rows, docs = odd
    for module, n, same in ((suffixes, 100, True), (phrases, 50, False)):
        got = module.remove(docs).collect()
        assert len(got) == len(rows)
        kept = {}
        for x in got:
            kept.setdefault(x.doc_id, []).append(bytes(x.kept) if same else x.kept.encode())
        whole = lambda t: (t or "").encode() if same else " ".join(SOLID.findall(t or "")).encode()
        assert sorted(kept[None]) == sorted(whole(t) for i, t in rows if i is None)
        assert kept[1] == [whole(rows[0][1])] * 2  # the first document keeps all, twice alike
        assert sorted(map(len, kept[2]))[0] < len(whole(rows[2][1]))
        for opt in ({"hot": 1, "frequent": 0}, {"hot": 2, "frequent": 1, "block_bytes": 500}):
            assert sorted(map(str, module.remove(docs, **opt).collect())) == sorted(map(str, got))


@pytest.mark.parametrize("module", [suffixes, phrases])
def test_hot_marks(spark, world, module):  # noqa: F811
    """Passages in most documents, at other places and between other words: splitting hot marks changes nothing."""
    r = random.Random(6)
    line = " ".join(r.choices(VOCABULARY, k=75))
    rows = [(i, f"{' '.join(r.choices(VOCABULARY, k=r.randrange(30)))} {line} {' '.join(r.choices(VOCABULARY, k=r.randrange(30)))}") for i in range(60)] + [(60 + i, line) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(map(str, module.remove(docs).collect()))
    for hot in (1, 4, 30):
        assert sorted(map(str, module.remove(docs, hot=hot, frequent=hot // 2).collect())) == want


def test_deep_shallow_order():
    r = random.Random(1)
    for k in range(60):
        data = bytes(r.choices(b"ab" if k % 2 else b"abcdefgh", k=r.randrange(130, 500)))
        if k % 3 == 0:
            data = (data[: r.randrange(5, 130)] * 40)[: len(data)]
        n = len(data) - 99
        group = np.sort(np.array([r.randrange(3) for _ in range(n)]))
        order, same = suffixes.deep_shallow(np.frombuffer(data, np.uint8), np.arange(n), group, 100)
        want = sorted(range(n), key=lambda i: (group[i], data[i : i + 100], i))
        assert order.tolist() == want
        assert same.tolist() == [False] + [group[a] == group[b] and data[a : a + 100] == data[b : b + 100] for a, b in itertools.pairwise(want)]


def test_decontaminate_in_blocks(spark, world, odd):  # noqa: F811
    docs = spark.read.parquet(f"{world['dir']}/documents.parquet")
    bench = spark.createDataFrame(world["items"] + [(50, world["texts"][9][:200]), (51, world["texts"][9][150:400])], "item_id long, text string")
    for apply in (decontaminate.find, decontaminate.clean):
        assert sorted(map(str, apply(docs, bench, block_bytes=300).collect())) == sorted(map(str, apply(docs, bench).collect()))
    rows, clash = odd
    got = decontaminate.find(clash, bench)
    assert [c for c in got.columns if c not in decontaminate.ADDED] == [c for c in clash.columns if c not in decontaminate.ADDED] and got.count() == len(rows)
    own = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    left = decontaminate.clean(clash, own)
    assert left.columns == clash.columns
    assert sorted((x.doc_id or 0, len(x.text or "")) for x in left.where("doc_id is null or doc_id <> 7").collect()) == sorted((i or 0, len((t or "").replace(rows[0][1], ""))) for i, t in rows if t != rows[0][1] and i != 7)


def test_ranks_of_the_wavelet_matrix():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 13, 500).astype(np.int32)
    tree = decontaminate.WaveletMatrix(x, 12)
    c, i = rng.integers(0, 13, 300), rng.integers(0, 501, 300)
    assert tree.rank(c, i).tolist() == [int((x[:b] == a).sum()) for a, b in zip(c, i, strict=True)]


def plain_flow(patterns, quotas, max_repeat):
    """Cheapest paths one by one: words routed, and their cost."""
    names = list(quotas)
    n = len(patterns)
    arcs = []
    for i, (m, w) in enumerate(patterns):
        arcs += [[n + len(names), i, w, r] for r in range(max_repeat)] + [[i, n + names.index(x), w * max_repeat, 0] for x in m]
    arcs += [[n + k, n + len(names) + 1, round(quotas[x]), 0] for k, x in enumerate(names)]
    arcs = [a for u, v, c, k in arcs for a in ([u, v, c, k], [v, u, 0, -k])]
    flow = cost = 0
    while True:
        far, by = {n + len(names): 0}, {}
        for _ in range(n + len(names) + 2):
            for e, (u, v, room, k) in enumerate(arcs):
                if room and u in far and far[u] + k < far.get(v, math.inf):
                    far[v], by[v] = far[u] + k, e
        t = n + len(names) + 1
        if t not in far:
            return flow, cost
        path, v = [], t
        while v != n + len(names):
            path.append(by[v])
            v = arcs[by[v]][0]
        most = min(arcs[e][2] for e in path)
        for e in path:
            arcs[e][2] -= most
            arcs[e ^ 1][2] += most
        flow, cost = flow + most, cost + most * far[t]


def test_flow_of_overlapping_sources():
    r = random.Random(9)
    for _ in range(60):
        names = "abcde"[: r.randrange(1, 6)]
        patterns = list({frozenset(r.sample(names, r.randrange(1, len(names) + 1))): r.randrange(0, 30) for _ in range(7)}.items())
        quotas = {x: r.randrange(0, 60) for x in names}
        got = mixing.route(patterns, quotas, 3)
        used = [sum(x.values()) for x in got]
        assert all(u <= 3 * w for u, (_, w) in zip(used, patterns, strict=True))
        assert all(sum(x.get(s, 0) for x in got) <= quotas[s] for s in names)
        cost = sum(sum(max(0, u - k * w) for k in (1, 2)) for u, (_, w) in zip(used, patterns, strict=True))
        assert (sum(used), cost) == plain_flow(patterns, quotas, 3)


def test_mix_of_overlapping_sources(spark, odd):
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(VOCABULARY, k=r.randrange(1, 60))), r.sample("abc", r.randrange(1, 4))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s array<string>")
    for most in (mixing.MAX_PATTERNS, 2):
        got = mixing.mix(docs, F.col("s"), max_patterns=most).collect()
        size = sum(x._size for x in got)
        target = {k: v for x in got for k, v in x._target.items()}
        taken = sum(x._times * x._size + x._part for x in got)
        assert len(got) == 300 and abs(taken - size) <= 10 and set(target) <= {'"a"', '"b"', '"c"'}
        assert all(x._times * x._size + x._part <= 3 * x._size for x in got)
    rows, clash = odd
    got = mixing.mix(clash, F.array(F.lit("x")))
    assert got.columns == [c for c in clash.columns if c != "_size"] + ["_size", "_source_size", "_target", "_times", "_part"] and got.count() == len(rows)
    assert [x._times for x in got.where("doc_id = 1").collect()] in ([0, 0], [1, 1])


def test_gradients():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in language.new_model(3, rng, 3).items()}
    x, held, y = rng.integers(0, 256, (7, 4)).astype(np.uint8), np.array([7, 3, 5, 1]), np.array([0, 1, 2, 1])
    x[np.arange(7)[:, None] >= held] = 0
    _, g = language.gradients(p, x, held, y)
    for k in p:
        for i in map(tuple, np.argwhere(g[k] != 0)[:40]):
            at = [{a: b.copy() for a, b in p.items()} for _ in range(2)]
            at[0][k][i] += 1e-5
            at[1][k][i] -= 1e-5
            up, down = (language.gradients(q, x, held, y)[0] for q in at)
            assert abs((up - down) / 2e-5 - g[k][i]) < 1e-7


def plain_labels(p, text: bytes):
    """Mean label probabilities of a text, byte by byte, each segment led in by the bytes beside it."""
    h = p["cand"].shape[1]
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text)

    def step(d, s, c):
        g, rec = p["in"][d][c], s @ p["rec"][d]
        z, r = (1 / (1 + np.exp(-(g[a : a + h] + rec[a : a + h]))) for a in (0, h))
        return z * s + (1 - z) * np.tanh(g[2 * h :] + r * (rec[2 * h :] + p["cand"][d]))

    total = 0
    for a in range(0, len(low), language.SEGMENT):
        b = min(len(low), a + language.SEGMENT)
        states = []
        for d, lead, own in ((0, low[max(0, a - language.LEAD) : a], low[a:b]), (1, low[b : b + language.LEAD][::-1], low[a:b][::-1])):
            s, out = np.zeros(h), []
            for c in lead:
                s = step(d, s, c)
            for c in own:
                s = step(d, s, c)
                out.append(s)
            states.append(out if d == 0 else out[::-1])
        for f, g in zip(*states, strict=True):
            e = np.exp(np.r_[f, g] @ p["out"] + p["bias"])
            total = total + e / e.sum()
    return total / max(1, len(low))


def test_language_scores(spark, odd, monkeypatch):
    monkeypatch.setattr(language, "EPOCHS", 1)
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(["der", "die", "Haus"] if i % 2 else ["the", "a", "house"], k=r.randrange(1, 400))), "de" if i % 2 else "en") for i in range(60)]
    known = language.Identifier(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert known.labels == ["de", "en"]
    odd_rows, clash = odd
    got = known.predict(clash)
    assert got.columns == [c for c in clash.columns if c not in ("score", "lang_pred")] + ["lang_pred", "score"]
    assert sorted(str(x.text) for x in got.collect()) == sorted(str(t) for _, t in odd_rows)
    p = {k: v.astype(np.float64) for k, v in known.model.items()}
    for x in known.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id < 12").collect():
        want = plain_labels(p, x.text.encode())
        assert x.lang_pred == known.labels[int(want.argmax())] and abs(x.score - want.max()) < 1e-3
    assert {x.lang_pred for x in got.where("trim(coalesce(text, '')) in ('', '\n')").collect()} == {"und"}


def test_memory_of_decontamination():
    """What a worker holds at once stays small beside an executor, however many words its task reads."""
    import tracemalloc
    from types import SimpleNamespace

    phrases = decontaminate.Phrases([(1, "one two three four five six seven eight nine ten eleven")], decontaminate.WINDOW)
    text = " ".join(f"w{i % 997} one two three" for i in range(500))
    batches = (pa.RecordBatch.from_pydict({"c0": [text] * 50}) for _ in range(12))
    run = decontaminate._mapper(SimpleNamespace(value=phrases), decontaminate.SHARD_WORDS, 0, 1, decontaminate._added)
    tracemalloc.start()
    try:
        assert sum(len(b) for b in run(batches)) == 600
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()


def recall(spark, vectors, kind, **options):
    df = spark.createDataFrame(pa.table({"id": pa.array(range(len(vectors)), pa.int64()), "v": pa.array(vectors.tolist(), pa.list_(kind))}))
    rows = neighbours.valid(df, "id", "v")
    got = neighbours.search(neighbours.build(rows, 21, **options), rows.where(F.col("id") % 100 == 0), 20, query_block=64).collect()
    x = vectors.astype(np.float32 if kind == pa.float32() else np.float64).astype(np.float64)
    found = total = 0
    for q in range(0, len(x), 100):
        s = x @ x[q]
        s[q] = -np.inf
        own = [r for r in got if r.query_id == q]
        assert all(r.score == pytest.approx(s[r.vec_id], rel=1e-12, abs=1e-12) for r in own) and len(own) == 20
        found += len({r.vec_id for r in own} & set(np.argsort(-s, kind="stable")[:20].tolist()))
        total += 20
    return found / total


def test_recall_of_full_shards(spark):
    """Vectors of unlike lengths, the hard case, over several full shards, and doubles."""
    rng = np.random.default_rng(0)
    assert recall(spark, rng.normal(size=(20_000, 64)), pa.float32(), shard=7_000) >= 0.9
    assert recall(spark, rng.normal(size=(3_000, 24)) * rng.lognormal(size=(3_000, 1)), pa.float64(), shard=800) >= 0.9


def test_beam_follows_the_data(spark):
    """Random vectors of many components need a wider beam than WIDTH for 0.9; vectors of few get along with a narrow one, also where shards share the nearest."""
    rng = np.random.default_rng(4)
    hard = rng.normal(size=(8_000, 192)) * np.exp(rng.normal(size=(8_000, 1)) * 0.3)
    assert recall(spark, hard, pa.float32()) >= 0.95
    easy = rng.normal(size=(6_000, 8)).astype(np.float32)
    graph = neighbours.Graph(easy[:5_000])
    assert graph.width(easy[5_000:5_064], neighbours.share(21, 4), neighbours.LEAST) < neighbours.WIDTH / 2
    assert [neighbours.share(21, n) for n in (1, 4, 100)] == [21, 12, 2]


def test_neighbour_ties(spark):
    """Equal vectors and equal scores: the smaller id first, and all of them found."""
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100 + i, [0.5, float(i % 2)]) for i in range(6)] + [(200, None), (None, [1.0, 1.0]), (7, [1.0, 0.0])]
    own = neighbours.valid(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    got = neighbours.search(neighbours.build(own, 21), own.where("id in (0, 100)"), 20).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 0] == list(range(1, 21))
    assert [r.vec_id for r in got if r.query_id == 100] == list(range(20))


def test_long_and_repeated_conversations(spark, world, monkeypatch):  # noqa: F811
    rows = spark.read.parquet(f"{world['dir']}/conversations.parquet")
    rows = rows.unionByName(rows.where("conv_id = 3")).unionByName(spark.createDataFrame([(None, 1, "user", "hi"), (5, None, "user", None), (6, 99, "assistant", "y" * 100_000)], rows.schema))
    want = sorted(map(str, chat.read_back(chat.format_chats(rows.withColumn("ids", F.lit(1)).withColumn("part", F.lit(2)))).collect()))
    assert len(want) == 9
    monkeypatch.setattr(chat, "PART_CHARS", 50)
    assert sorted(map(str, chat.read_back(chat.format_chats(rows)).collect())) == want


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    library, own, r = Tokenizer.from_file(bpe.vocabulary()), bpe.Encoder(bpe.vocabulary()), random.Random(7)
    pools = ["abc XYZ", "  \n\t ", "'s't're've'm'll'd", "0123", "äöß日本語", "!?.,-", "  ‍\U0001f600́", "".join(own.special) or "<"]
    made = [None, ""] + own.special + ["a" + s + " b" for s in own.special]
    made += ["".join(r.choice(r.choice(pools)) for _ in range(r.randrange(1, 80))) for _ in range(3000)]
    for i in range(0, len(made), 500):
        ids, at = own.encode(pa.array(made[i : i + 500], pa.string()))
        for k, t in enumerate(made[i : i + 500]):
            assert ids[at[k] : at[k + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)
    own._store = lambda h, words, put=own._store: put(h, words[::-1])  # what is held differs from what its hash stands for
    own.reset()
    ids, at = own.encode(pa.array(made[:900], pa.string()))
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == [library.encode(t or "", add_special_tokens=False).ids for t in made[:900]]


def test_token_shards(spark, world, odd, tmp_path):  # noqa: F811
    """Several shards, looked up by filter, index and binary search; null and repeated keys; other columns don't matter."""
    rows, docs = odd
    t = spark.read.parquet(f"{world['dir']}/documents.parquet").select("doc_id", "text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = sstable.write(t.withColumn("doc_id", F.col("doc_id") * 3), f"file://{tmp_path}/a")
        other = sstable.write(docs, f"file://{tmp_path}/b")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(manifest) > 3
    library, at = bpe.encoder(bpe.vocabulary()).library, 0
    want = {3 * i: [*library.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(world["texts"])}
    for r in sorted(sstable.read(spark, manifest).collect(), key=lambda r: r.doc_id):
        assert (r.start, list(r.ids)) == (at, want[r.doc_id])
        at += len(r.ids)
    shards = [sstable.open_shard(r.path) for r in manifest]
    for k in range(-2, 3 * len(want) + 2):
        got = [x.tolist() for s in shards for x in s.get(k)]
        assert got == ([want[k]] if k in want else [])
    shards = [sstable.open_shard(r.path) for r in other]
    for k in {i for i, _ in rows}:
        assert sorted(x.tolist() for s in shards for x in s.get(k)) == sorted([*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows if i == k)


def test_shard_lookup_over_many_blocks(monkeypatch):
    import io

    monkeypatch.setattr(sstable, "BLOCK", 64)
    sink, r = io.BytesIO(), random.Random(5)
    keys = sorted([None, *(r.randrange(-(1 << 40), 1 << 40) for _ in range(400)), 7, 7, 7], key=lambda k: (k is not None, k or 0))
    w = sstable.Writer(sink, 2)
    values = [np.arange(i % 5, dtype=np.uint16) + i for i in range(len(keys))]
    for k, v in zip(keys, values, strict=True):
        w.add(sstable.key_bytes(k), v.tobytes())
    w.close(len(keys))
    shard = sstable.Reader(sink, sink.tell())
    assert len(shard.blocks) > 50
    for k in set(keys):
        assert [x.tolist() for x in shard.get(k)] == [v.tolist() for a, v in zip(keys, values, strict=True) if a == k]
    assert sum(bool(shard.get(k)) for k in range(10**12, 10**12 + 500)) == 0
    likely = sum(all(shard.filter[p >> 3] >> (7 - (p & 7)) & 1 for p in sstable.probes(sstable.key_bytes(k), shard.bits)) for k in range(10**12, 10**12 + 4000))
    assert likely < 4000 * 0.03


def test_quality_scores(spark, odd):
    """Scores computed anew, word by word, from the model that is broadcast."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choices(VOCABULARY[:40] if i % 2 else VOCABULARY[30:], k=r.randrange(0, 60)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(None, 1), (3, None)], "doc_id long, quality int")
    known = quality.Classifier(docs, labels)
    index = quality.index_vectors()
    words = np.hstack([known.vectors, index / np.sqrt(quality.NONZERO)]).astype(np.float64)
    for x in known.score(docs).where("doc_id < 20").collect():
        v = words[quality.tokens(*_flat(x.text))[0]]
        f = np.zeros(quality.FEATURES)
        if len(v):
            f = np.r_[v.mean(0), v.std(0), np.r_[v[:-1] * v[1:], np.zeros((1, v.shape[1]))].mean(0)]
        assert abs(x.score - quality.probability(known.model, f[None])[0]) < 1e-3
    odd_rows, clash = odd
    got = known.score(clash)
    assert got.columns == [c for c in clash.columns if c != "score"] + ["score"] and got.count() == len(odd_rows)
    assert got.where("score between 0 and 1").count() == len(odd_rows)


def _flat(t: str):
    data = np.frombuffer(t.encode(), np.uint8)
    return data, np.array([0, len(data)])


def test_near_copies_with_odd_rows(spark, odd):
    rows, docs = odd
    got = minhash.link(docs, size=5).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, minhash.link(docs.repartition(7), size=5).collect()))
    of = {}
    for x in got:
        of.setdefault(x.doc_id, set()).add((x.component_id, x.kept))
    assert of[1] == {(1, True)} and of[7] == {(1, False)} and of[3] == {(3, True)} and of[None] == {(None, True)}


def test_pipeline_equals_plain_stages(spark, world):  # noqa: F811
    """All five stages against plain versions of each, on the same input; the quality scores are the classifier's own."""
    p = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    d = world["dir"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    scores = quality.Classifier(docs, spark.read.parquet(f"{d}/labels.parquet")).score(docs, name="s").select("doc_id", "s").collect()
    good = {r.doc_id for r in scores if r.s >= quality.THRESHOLD}
    first = p.keep_quality(spark, docs, d)
    assert {r.doc_id for r in first.collect()} == good and first.columns == docs.columns
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]  # the later stages take all documents, as the classifier may keep few of these
    near = p.drop_near_copies(spark, docs, d)
    linked_to = linked([r["text"] for r in rows], 5)
    rows = [r for i, r in enumerate(rows) if linked_to[i][1] == i]
    assert sorted(r.doc_id for r in near.collect()) == [r["doc_id"] for r in rows]
    windows = set()
    for _, t in world["items"]:
        w = WORD.findall((t or "").translate(LOW))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    plain = []
    for r in rows:
        at = list(WORD.finditer((r["text"] or "").translate(LOW)))
        hit = {x for n in {len(w) for w in windows} for k in range(len(at) - n + 1) if tuple(m[0] for m in at[k : k + n]) in windows for x in range(k, k + n)}
        if hit and len(hit) == len(at):
            continue
        out, last = [], 0
        for k in sorted(hit):
            if k - 1 not in hit:
                out.append(r["text"][last : at[k].start()])
            last = at[k].end()
        plain.append(r | ({"text": "".join([*out, r["text"][last:]])} if hit else {}))
        plain[-1]["n_chars"] = len(plain[-1]["text"]) if plain[-1]["text"] is not None else plain[-1]["n_chars"]
    clean = p.drop_benchmark(spark, near, d)
    assert told(clean.columns, clean.collect()) == told(docs.columns, [[r[c] for c in docs.columns] for r in plain])
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist(plain, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])))
    taken = dict(con.execute(f"SELECT doc_id, (CASE WHEN size = 0 THEN 0 ELSE taken // size + (2 * (taken % size) >= size)::INT END) FROM ({SQL['op3_mix_sources']})").fetchall())
    mixed = p.mix_sources(spark, clean, d)
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert times == {k: n for k, n in taken.items() if n}
    library, at, want = Tokenizer.from_file(bpe.vocabulary()), 0, []
    for r in plain:
        for _ in range(taken[r["doc_id"]]):
            ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
            want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in p.write_tokens(spark, mixed, d).collect()) == want
    whole = docs
    for _, stage in p.STAGES:
        whole = stage(spark, whole, d)
    assert sorted(map(str, p.run(spark, d).collect())) == sorted(map(str, whole.collect()))
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, d).count() == 0

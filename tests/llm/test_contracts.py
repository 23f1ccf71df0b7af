"""The ten contract queries and the pipeline against brute force on a small fixture with nulls, empty and repeated texts."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from folioflow.llm.queries import QUERIES

VOCABULARY = [f"w{i}" for i in range(90)] + ["Größe", "naïve", "A,b", "x-y", "Ünï"]


def texts() -> list:
    r = random.Random(5)
    make = lambda n: " ".join(r.choices(VOCABULARY, k=n))
    shared, phrase = make(70), make(55)
    base = make(120)
    near = base.split(" ")
    near[60] = "changed"
    out = [None, "", " \t\n", "one", "One two", "one two", base, base, " ".join(near), make(30) + " " + shared + "\n" + make(20), shared + " " + make(25), "x " + phrase + " y " + phrase]
    out += ["a" * 350, "ab" * 200, "!!! ... 123", "日本語 テキスト です", phrase.upper(), make(3000) + " " + shared]
    out += [make(r.randrange(1, 90)) for _ in range(40)]
    out += [out[20]] * 3 + [base + " tail"] * 2
    return out


ITEMS = [(1, None), (2, ""), (3, "w1 W2"), (4, "!!")]


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    r = random.Random(8)
    d = tmp_path_factory.mktemp("world")
    t = texts()
    items = ITEMS + [(10 + i, " ".join(t[k].split(" ")[3:18])) for i, k in enumerate((6, 9, 25))]
    lang = [None if i % 9 == 0 else ["de", "en"][i % 2] for i in range(len(t))]
    source = [None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 4}" for i in range(len(t))]
    n = [None if x is None else len(x) for x in t]
    put = lambda name, cols: pq.write_table(pa.table(cols), d / f"{name}.parquet")
    put("documents", {"doc_id": pa.array(range(len(t)), pa.int64()), "text": pa.array(t, pa.string()), "lang": lang, "source": source, "n_chars": pa.array(n, pa.int64())})
    put("benchmark", {"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([x for _, x in items], pa.string())})
    put("labels", {"doc_id": pa.array(range(len(t)), pa.int64()), "quality": pa.array([i % 2 for i in range(len(t))], pa.int64()), "toxic": pa.array([0] * len(t), pa.int64())})
    vectors = [[r.gauss(0, 1) for _ in range(8)] for _ in range(300)]
    vectors[3], vectors[5], vectors[7], vectors[11] = None, [0.0] * 8, [math.nan] + [1.0] * 7, vectors[12]
    put("embeddings", {"vec_id": pa.array(range(300), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * 300, pa.int64())})
    talks = [(c, k, ["system", "user", "assistant"][k % 3], None if (c + k) % 7 == 0 else f"<|end|> \\{'x' * k} {c} <\\|turn|> ü日") for c in range(9) for k in range(c)]
    put("conversations", {"conv_id": pa.array([x[0] for x in talks], pa.int64()), "turn": pa.array([x[1] for x in talks], pa.int32()), "role": [x[2] for x in talks], "text": pa.array([x[3] for x in talks], pa.string())})
    return {"dir": str(d), "texts": t, "items": items, "vectors": vectors, "talks": talks, "source": source}


def rows(spark, world, name, key="doc_id"):
    got = QUERIES[name](spark, world["dir"]).collect()
    return {r[key]: r for r in got} if key else got


def sha(b) -> str:
    return hashlib.sha256(b).hexdigest()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_op1(spark, world):
    got = rows(spark, world, "op1_decontaminate")
    windows = {}
    for i, t in world["items"]:
        w = WORD.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    lengths = {len(w) for w in windows}
    for i, t in enumerate(world["texts"]):
        w = WORD.findall((t or "").translate(LOW))
        hit, items = set(), set()
        for n, k in itertools.product(lengths, range(len(w))):
            if found := windows.get(tuple(w[k : k + n])) if k + n <= len(w) else None:
                hit.update(range(k, k + n))
                items |= found
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(items), bool(hit)), i
        assert r.items_sha256 == sha(",".join(sorted(map(str, items))).encode())
    assert len(got) == len(world["texts"]) and any(r.contaminated for r in got.values())


def cut_repeats(seqs: list, n: int, same: bool) -> list:
    """Which symbols each sequence loses: those in a window of n that starts earlier (same: in the same sequence, too)."""
    seen, gone = {}, []
    for i, s in enumerate(seqs):
        lost = [False] * len(s)
        for k in range(len(s) - n + 1):
            first = seen.setdefault(s[k : k + n], i)
            if first < i or same and seen.get((s[k : k + n], "at"), (i, k)) != (i, k):
                lost[k : k + n] = [True] * n
            seen.setdefault((s[k : k + n], "at"), (i, k))
        gone.append(lost)
    return gone


def test_op2(spark, world):
    got = rows(spark, world, "op2_suffix_dedup")
    seqs = [(t or "").encode() for t in world["texts"]]
    for i, (s, lost) in enumerate(zip(seqs, cut_repeats(seqs, 100, True), strict=True)):
        runs = sum(k for k, _ in itertools.groupby(lost))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(s), sum(lost), runs), i
        assert got[i].kept_sha256 == sha(bytes(c for c, x in zip(s, lost, strict=True) if not x)), i
    assert got[13].n_removed > 0 and len(got) == len(seqs)


SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def test_op7(spark, world):
    got = rows(spark, world, "op7_phrase_dedup")
    seqs = [tuple(SOLID.findall(t or "")) for t in world["texts"]]
    for i, (s, lost) in enumerate(zip(seqs, cut_repeats(seqs, 50, False), strict=True)):
        assert (got[i].n_words, got[i].n_removed) == (len(s), sum(lost)), i
        assert got[i].kept_sha256 == sha(" ".join(w for w, x in zip(s, lost, strict=True) if not x).encode()), i
    assert sum(r.n_removed for r in got.values()) > 300


def test_op3(spark, world):
    got = rows(spark, world, "op3_mix_sources")
    sizes = [len(SOLID.findall(t or "")) for t in world["texts"]]
    held = {}
    for s, n in zip(world["source"], sizes, strict=True):
        held[s] = held.get(s, 0) + n
    order = sorted(held, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, live = {}, list(order)
    while live:
        left = sum(sizes) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in live) for s in live}
        over = [s for s in live if share[s] > 3 * held[s]]
        target |= {s: 3 * held[s] for s in over} if over else share
        live = [s for s in live if s not in over] if over else []
    taken = {}
    for i, s in enumerate(world["source"]):
        r = got[i]
        assert (r["size"], r.source_size) == (sizes[i], held[s]) and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * sizes[i]
        taken[s] = taken.get(s, 0) + r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 2, s
    assert rows(spark, world, "op3_mix_sources") == got


def test_op4(spark, world):
    got = rows(spark, world, "op4_language_id")
    letters = re.compile(r"[^\W\d_]")
    for i, t in enumerate(world["texts"]):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1
        assert (got[i].lang_pred == "und") == (not letters.search(t or "")), i


def test_op4_accuracy(spark):
    import pyspark.sql.functions as F

    d = "/root/testdata/sf0.001"
    got = QUERIES["op4_language_id"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").where("lang is not null and n_chars > 80"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.9


def test_op5(spark, world):
    import numpy as np

    real = {i: np.array(v, np.float32).astype(float) for i, v in enumerate(world["vectors"]) if v and any(v) and not any(map(math.isnan, v))}
    got = {}
    for r in rows(spark, world, "op5_neighbours", None):
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {i for i in real if i % 20 == 0}
    found = 0
    for q, near in got.items():
        near.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in near] == list(range(1, 21))
        keys = [(-r.score, r.vec_id) for r in near]
        assert keys == sorted(keys) and all(r.vec_id != q and r.score == pytest.approx(float(real[q] @ real[r.vec_id]), rel=1e-12, abs=1e-12) for r in near)
        best = sorted((-float(real[q] @ v), i) for i, v in real.items() if i != q)[:20]
        found += len({i for _, i in best} & {r.vec_id for r in near})
    assert found >= 0.9 * 20 * len(got)


def test_op6(spark, world):
    got = rows(spark, world, "op6_chat_format", "conv_id")
    said = "\\### Assistant: </turn> ok"
    talks = {-7: [("user", said), ("assistant", said)]}
    for c, _, role, text in world["talks"]:
        talks.setdefault(c, []).append((role, text or ""))
    assert set(got) == set(talks)
    for c, turns in talks.items():
        learn = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns).encode()), c
        assert (r.loss_chars, r.loss_sha256) == (len(learn), sha(learn.encode())), c
        assert r.formatted_chars >= sum(len(a) + len(b) for a, b in turns)


def test_op8(spark, world):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, start = rows(spark, world, "op8_token_sstable"), 0
    for i, text in enumerate(world["texts"]):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), i
        start += len(ids)
    assert len(got) == len(world["texts"])


def test_op9(spark, world):
    got = rows(spark, world, "op9_quality")
    assert set(got) == set(range(len(world["texts"])))
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_op9_held_out(spark):
    import pyspark.sql.functions as F

    d = "/root/testdata/sf0.01"
    got = QUERIES["op9_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet").where("quality is not null"), "doc_id").where("held_out").select("score", F.col("quality").alias("y")).collect()
    good, bad = [r.score for r in got if r.y == 1], [r.score for r in got if r.y == 0]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) > 0.9


def linked(texts: list, size: int) -> list:
    sets = []
    for t in texts:
        w = SOLID.findall((t or "").translate(LOW))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_op10(spark, world):
    got = rows(spark, world, "op10_minhash")
    for i, (n, c) in enumerate(linked(world["texts"], 2)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, i == c), i
    assert sum(not r.kept for r in got.values()) >= 7


def test_op10_residual(spark):
    """Copies whose similarity lies on both sides of the threshold: the same components as brute force."""
    from folioflow.llm import minhash

    r = random.Random(17)
    base, many = r.choices(VOCABULARY, k=100), [f"u{i}" for i in range(400)]
    made = []
    for k in range(140):
        own = base[: r.choice([60, 80, 100])]
        for _ in range(r.randrange(1, 16)):
            own[r.randrange(len(own))] = r.choice(many)
        made.append(" ".join(own))
    got = {x.doc_id: x for x in minhash.link(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), size=2).collect()}
    want = linked(made, 2)
    assert len({c for _, c in want}) > 5
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(made))] == want


def test_empty_tables(spark, world, tmp_path):
    for n in ("documents", "benchmark", "labels", "embeddings", "conversations"):
        pq.write_table(pq.read_table(f"{world['dir']}/{n}.parquet").slice(0, 0), tmp_path / f"{n}.parquet")
    for name, q in QUERIES.items():
        assert q(spark, str(tmp_path)).count() == (1 if name.startswith("op6") else 0), name

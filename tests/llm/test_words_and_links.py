"""Ops 11 to 13 against brute force, with every bound set small, and the pipeline's stages on odd rows and column names."""

import collections
import itertools
import random
import re
import zlib

import pytest
import xxhash
from test_contracts import LOW, SOLID, rows, world  # noqa: F401

import corpus_pipeline
from folioflow.llm import collocations, simhash, spelling


def components(ids: list, linked) -> dict:
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: top(i) for i in ids}


def plain_print(text) -> int:
    w = SOLID.findall((text or "").translate(LOW))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op12(spark, world):  # noqa: F811
    got = rows(spark, world, "op12_simhash")
    prints = {i: plain_print(t) for i, t in enumerate(world["texts"])}
    want = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


@pytest.mark.parametrize("hot", [0, 3, 10**6])
def test_links_of_dense_fingerprints(spark, hot):
    """Balls around a few centres, chains three bits apart, and lone ones: the same components however many share a table key."""
    r = random.Random(hot)
    prints = {0, (1 << 64) - 1}
    for _ in range(4):
        c = r.getrandbits(64)
        prints |= {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for _ in range(60)}
        prints |= {c ^ sum(1 << b for b in r.sample(range(32, 64), 3)) for _ in range(40)}
        for k in range(6):
            c ^= 7 << (3 * k)
            prints.add(c)
    own = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.near(spark.createDataFrame([(signed(p),) for p in own], "fp long"), hot).collect()
    pairs = {frozenset((x.a & (1 << 64) - 1, x.b & (1 << 64) - 1)) for x in links}
    assert all(len(p) == 2 and (min(p) ^ max(p)).bit_count() <= 3 for p in pairs)
    near = lambda a, b: (a ^ b).bit_count() <= 3
    assert components(own, lambda a, b: frozenset((a, b)) in pairs) == components(own, near)
    if hot == 10**6:
        assert len(pairs) == sum(near(a, b) for a, b in itertools.combinations(own, 2))


CLASH = "doc_id long, text string, lang string, fp int, i int, v int, m int, label int, node int, word string, n int, run int, t int, phrase int, `a.b` int"


@pytest.fixture(scope="module")
def odd_rows(spark):
    texts = [None, "", "  \n", "one", "one", "alpha beta gamma " * 2000, "alpha beta, gamma; alpha beta"]
    ids = [1, 2, None, 4, 4, 5, 4]
    return spark.createDataFrame([(i, t, None if k % 2 else "xx", *([k] * 6), "w", *([k] * 5)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], CLASH)


def test_odd_rows(spark, odd_rows):
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.link(odd_rows).collect()}
    assert got[(1, 0)] == got[(2, 0)] == 1 and got[(None, 0)] is None and len(simhash.link(odd_rows).collect()) == 7
    assert {r.word: r.n for r in spelling.variants(odd_rows, slip=10**9).collect()} == {"alpha": 2002, "gamma": 2001}
    told = {(r.lang, r.phrase): (r.a, r.n) for r in collocations.collocations(odd_rows, covered=101).collect()}
    assert told[("und", "alpha beta")] == (2000, 6001) and all(k[0] == "und" for k in told)
    none = odd_rows.limit(0)
    for f in (simhash.link, spelling.variants, collocations.collocations):
        assert f(none).collect() == []


def told_words(texts: dict, slip: int) -> dict:
    c = collections.Counter()
    for i, t in texts.items():
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % slip == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= 5:
                c[w] += 1
    return {w: n for w, n in c.items() if n >= 3}


def near_words(c) -> dict:
    near, keys = collections.defaultdict(set), collections.defaultdict(set)
    for w in c:
        for k in range(len(w)):
            keys[w[:k], w[k + 1 :]].add(w)
            if (d := w[:k] + w[k + 1 :]) in c:
                near[w].add(d)
                near[d].add(w)
    for g in keys.values():
        for w in g:
            near[w] |= g - {w}
    return near


@pytest.mark.parametrize("options", [{}, {"block": 3}, {"few": 0}, {"block": 40, "few": 1}])
def test_op13(spark, options):
    """Words from few letters, so that many share halves, and some that lead to each other in chains."""
    r = random.Random(3)
    make = lambda: "".join(r.choices(r.choice(["abé", "abé", "abéX"]), k=r.randrange(4, 8)))
    some = [make() for _ in range(250)] + ["aaaaa", "ééééé", "abababab", "ÿÿÿÿÿ"]
    texts = {i: " ".join(r.choices(some, weights=[1 + k % 40 for k in range(len(some))], k=120)) + "\naaaaa2aaaaa-Aaaaa" for i in range(60)} | {60: None, 61: "", 62: " !", 63: "zzzzz " * 99 + "zzzzy " * 30 + "zzzyy " * 9}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    c = told_words(texts, 97)
    near = near_words(c)
    form = {w: b for w in c if near[w] and c[b := min(near[w], key=lambda v: (-c[v], v))] >= 2 * c[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.variants(docs, **options).collect()}
    assert got == {w: (form.get(w), root(w), n, len(near[w]), c.get(form.get(w))) for w, n in c.items()}
    assert any(root(w) != form[w] for w in form) and max(map(len, near.values())) > 5


def plain_collocations(docs: list, longest: int, least: int, covered: int, top: int) -> set:
    f, total = collections.Counter(), collections.Counter()
    for lang, t in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                f.update((lang, tuple(w[k : k + n])) for k in range(len(w) - n + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    most = collections.Counter()
    for (lang, w), a in found.items():
        for n in range(2, len(w)):
            for k in range(len(w) - n + 1):
                most[lang, w[k : k + n]] = max(most[lang, w[k : k + n]], a)
    out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if not 100 * most[lang, w] >= covered * a:
            score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for lang, rows_ in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows_)[:top])}


@pytest.mark.parametrize(("longest", "top", "hot"), [(3, 2000, 100_000), (3, 7, 1), (4, 2000, 20)])
def test_op11(spark, longest, top, hot):
    r = random.Random(9)
    words = [f"w{k}" for k in range(40)] + ["Der", "der", "né", "x-y"]
    sep = lambda: r.choice([" "] * 12 + ["\t", "  ", ", ", ".", "\n", "; ", "!\r\n"])
    docs = [(r.choice(["de", "en", None]), "".join(r.choice(words[: r.choice((4, 44))]) + sep() for _ in range(r.randrange(1, 300)))) for _ in range(80)] + [("de", None), (None, ""), ("en", " . ,")]
    docs += [("de", "der w1 der w1 der w1, w1 w1 w1 w1")] * 30
    df = spark.createDataFrame([(lang, t) for lang, t in docs], "lang string, text string")
    got = collocations.collocations(df, longest=longest, top=top, hot=hot)
    assert {tuple(x) for x in got.collect()} == plain_collocations(docs, longest, 10, 50, top)


def test_counts_beyond_64_bits(spark):
    """Scores of large counts: the products pass 64 bits, the quotient is exact."""
    big = 3_000_000_019
    phrases = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, a long")
    words = spark.createDataFrame([("en", "a", big + 7), ("en", "b", big + 9)], "lang string, word string, f long")
    got = collocations.scored(phrases, words).collect()[0]
    assert (got.l, got.r, got.score) == (big + 7, big + 9, 1_000_000 * big * big // ((big + 7) * (big + 9)))


def test_stages_on_odd_rows(spark, world):  # noqa: F811
    """Every stage of the pipeline keeps all columns, whatever their names, and stands null ids, repeated and blank rows and a long text."""
    r = random.Random(2)
    make = lambda n: " ".join(r.choices([f"v{k}" for k in range(300)], k=n))
    base = make(100)
    texts = [(None, base), (None, None), (1, base), (1, base), (2, base + " tail"), (2, make(50)), (3, None), (4, ""), (5, " \n"), (6, make(20_000)), (7, world["items"][-1][1] + " " + make(60))]
    own = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `tick``ed` int, score double, _n int, kept boolean, component_id long, n int, label int, row int"
    docs = spark.createDataFrame([(i, t, "en", None if k % 3 else "s", len(t or ""), k, k, 0.5, k, True, 9, k, k, k) for k, (i, t) in enumerate(texts)], own)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, world["dir"])
        found = got.collect()
        if name == "token output":
            assert len(found) == len(texts)
            continue
        assert got.columns == docs.columns, name
        if name in ("quality classifier", "benchmark decontamination"):
            assert {x["a.b"] for x in found} <= set(range(len(texts)))
        if name == "near-duplicates":
            assert sorted((x.doc_id is None, x.doc_id or 0) for x in found) == [(False, i) for i in (1, 3, 4, 5, 6, 7)] + [(True, 0)] * 2 or sorted((x.doc_id is None, x.doc_id or 0) for x in found) == [(False, i) for i in (1, 2, 3, 4, 5, 6, 7)] + [(True, 0)] * 2
        if name == "source mixing":
            assert not any(x.doc_id in (3, 4, 5) for x in found)

"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy.

Words are runs of letters, digits and bytes above ASCII, or runs of other visible characters, as written. Word w has a bucket (its hash)
and a sparse ternary index vector. Its context vector is the sum, over every occurrence in every document, of its
neighbours' index vectors, those to the right turned by one place. Each task sums its own table, the tables are added by blocks of
buckets, and the whole (BUCKETS x DIMS numbers, whatever the corpus) goes to the driver. A document is the mean and the deviation of its words'
normalised context and index vectors, and the mean product of each word's with the next one's. The network learns from a bounded sample of labelled
rows (SAMPLE, by a hash of their id) and its probabilities are calibrated by a temperature fitted on a fifth of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import textscan as ts
from folioflow.session import fields, importable, plain_names

BUCKETS, DIMS, NONZERO = 1 << 14, 32, 4
BLOCKS = 16
SAMPLE = 20_000
HIDDEN, EPOCHS, RATE = 32, 60, 0.004
THRESHOLD = 0.7

KIND = np.where(ts.SOLID, np.where(ts.ALNUM, 1, 2), 0).astype(np.uint8)
KIND[:9] = KIND[14:32] = KIND[127] = 2


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(5)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, DIMS, BUCKETS)] += rng.choice([-1, 1], BUCKETS)
    return out


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, and the offset of each text's first."""
    kind = KIND[data]
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[at[:-1][at[:-1] < at[1:]]] = True
    heads = np.flatnonzero(new)
    ends = np.r_[heads[1:], len(kind)]
    real = kind[heads] > 0
    starts, ends = heads[real], ends[real]
    return (ts.hashes(data, starts, ends) & ts.U64(BUCKETS - 1)).astype(np.int64), np.searchsorted(starts, at)


def _contexts(batches):
    index = index_vectors()
    turned = np.roll(index, 1, axis=1)
    table = np.zeros((BUCKETS, DIMS), np.float64)
    some = False
    for batch in batches:
        for _, _, data, at in ts.groups(batch.column(0)):
            ids, first = tokens(data, at)
            if len(ids) < 2:
                continue
            some = True
            inner = np.ones(len(ids) - 1, bool)
            edges = first[1:-1]
            inner[edges[(edges > 0) & (edges < len(ids))] - 1] = False
            a, b = ids[:-1][inner], ids[1:][inner]
            for own, other, vectors in ((a, b, turned), (b, a, index)):
                order = np.argsort(own.astype(np.uint16), kind="stable")
                own = own[order]
                heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else []
                if len(heads):
                    table[own[heads]] += np.add.reduceat(vectors[other[order]], heads, axis=0)
    if some:
        step = BUCKETS // BLOCKS
        parts = [table[i * step : (i + 1) * step].astype("<f4").tobytes() for i in range(BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names=["block", "part"])


def _added(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(part.as_buffer(), "<f4")
            total[block] = total.get(block, 0) + x.astype(np.float64)
    for k, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["block", "part"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Normalised context vectors of all buckets from all texts; buckets without a neighbour are zero."""
    importable(docs.sparkSession)
    parts = docs.select(F.col(text).alias("t")).mapInArrow(_contexts, "block int, part binary")
    whole = parts.repartition(BLOCKS, "block").mapInArrow(_added, "block int, part binary").collect()
    out, step = np.zeros((BUCKETS, DIMS)), BUCKETS // BLOCKS
    for r in whole:
        out[r.block * step : (r.block + 1) * step] += np.frombuffer(r.part).reshape(step, DIMS)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


FEATURES = 6 * DIMS


def features(column, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """A row of pooled word vectors for each text: their mean, their deviation, and how far each word's vector agrees with the next one's."""
    both = np.hstack([vectors, index / np.sqrt(NONZERO)]).astype(np.float32)
    out = np.zeros((len(column), FEATURES), np.float32)
    for i, _, data, at in ts.groups(column, 1 << 18):
        ids, first = tokens(data, at)
        n = np.diff(first)
        full = np.flatnonzero(n)
        if len(full):
            x = both[ids]
            mean = np.add.reduceat(x, first[:-1][full], axis=0) / n[full, None]
            following = np.zeros_like(x)
            np.multiply(x[:-1], x[1:], out=following[:-1])
            following[first[1:][full] - 1] = 0
            x *= x
            square = np.add.reduceat(x, first[:-1][full], axis=0) / n[full, None]
            out[i + full, : 2 * DIMS] = mean
            out[i + full, 2 * DIMS : 4 * DIMS] = np.sqrt(np.maximum(square - mean * mean, 0))
            out[i + full, 4 * DIMS :] = np.add.reduceat(following, first[:-1][full], axis=0) / n[full, None]
    return out


def fit(x: np.ndarray, y: np.ndarray, seed: int = 3) -> dict:
    """The network's weights; with no rows, or one class only, the score is the share of label 1 (a half without rows)."""
    share = float((y.sum() + 1) / (len(y) + 2))
    if len(y) < 20 or y.min() == y.max():
        return {"constant": share}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    mu, sd = x[own].mean(0), x[own].std(0) + 1e-3
    z = (x - mu) / sd
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(EPOCHS):
        shuffled = rng.permutation(own)
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for i in range(0, len(own), 128):
            b = shuffled[i : i + 128]
            h = np.maximum(z[b] @ w[0] + w[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - y[b, None]) / len(b)
            dh = (d @ w[2].T) * (h > 0)
            grads = [z[b].T @ dh + 1e-4 * w[0], dh.sum(0), h.T @ d + 1e-4 * w[2], d.sum(0)]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = {"mu": mu, "sd": sd, "w": w, "t": 1.0}
    logit = _logits(model, x[held])
    loss = lambda t: float(np.mean(np.logaddexp(0, -np.where(y[held] > 0, 1, -1) * logit / t)))
    model["t"] = min(np.geomspace(0.25, 8, 61), key=loss)
    return model


def _logits(model: dict, x: np.ndarray) -> np.ndarray:
    w = model["w"]
    h = np.maximum(((x - model["mu"]) / model["sd"]) @ w[0] + w[1], 0)
    return np.clip((h @ w[2] + w[3])[:, 0], -500, 500)


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    return 1 / (1 + np.exp(-_logits(model, x) / model["t"]))


def crc_bucket(key: str, n: int):
    return F.crc32(F.col(key).cast("string")) % n


class Classifier:
    """Fitted on docs (whole texts, for the word vectors) and labels (doc_id, quality).

    The network learns from at most sample labelled rows, in order of a hash of their id. Labels with a null id or value, and those of no document, teach
    nothing; repeated ones count as often as they stand there. With too few labels, or one class only, the score is the share of label 1.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id", label: str = "quality"):
        spark = docs.sparkSession
        importable(spark)
        self.vectors = word_vectors(docs, text)
        chosen = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null").orderBy(F.xxhash64(F.lit(1), "k"), "k", "y").limit(sample)
        box = spark.sparkContext.broadcast(self.vectors)
        rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").select("t", "y", F.xxhash64(F.lit(1), "k").alias("h"))

        def run(batches):
            index = index_vectors()
            for batch in batches:
                f = features(batch.column(0), box.value, index)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in f], pa.binary()), *batch.columns[1:3]], names=["f", "y", "h"])

        got = sorted(rows.mapInArrow(run, "f binary, y int, h long").collect(), key=lambda r: (r.h, r.y, bytes(r.f)))
        x = np.array([np.frombuffer(r.f, np.float32) for r in got], np.float32).reshape(len(got), FEATURES)
        self.model = fit(x, np.array([r.y for r in got], np.float64))

    def score(self, docs: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        """All columns of docs and the probability of label 1 (which replaces a column of that name); null and empty texts have one too.

        Keys play no part; repeated rows give repeated results, an empty table none.
        """
        spark, names = docs.sparkSession, docs.columns
        plain, at = plain_names(docs), names.index(text)
        box = spark.sparkContext.broadcast((self.vectors, self.model))

        def run(batches):
            index = index_vectors()
            vectors, model = box.value
            for batch in batches:
                for i, j, _, _ in ts.groups(batch.column(at)):
                    part = batch.slice(i, j - i)
                    p = probability(model, features(part.column(at), vectors, index))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], names=[*part.schema.names, "score"])
            ts.give_back()

        found = plain.mapInArrow(run, f"{fields(plain)}, score double")
        return found.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n.lower() != name.lower()], F.col("score").alias(name))


def op9(spark, sf_dir: str) -> DataFrame:
    """Contract query: a quarter of the documents is held out."""
    from folioflow.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_bucket("doc_id", 4) != 2)
    held = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    got = Classifier(docs, labels).score(docs)
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

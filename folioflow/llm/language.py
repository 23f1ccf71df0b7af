"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Each direction runs over a text's bytes (A-Z lower-cased), every position gets a label distribution from both states, and a
document's probabilities are the mean over all its positions. Texts run side by side in segments of SEGMENT bytes: a text up to that length in one
piece, a longer one's segments each from the state that the LEAD bytes before it (or behind it, for the backward direction) leave.
Training is backpropagation through time with Adam over whole texts, in pieces of STEPS bytes: of each language PER_LANGUAGE texts at most, in
order of a hash of their id, up to SAMPLE_BYTES in all (texts of over LONG bytes only where there are no others).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm import textscan as ts
from folioflow.llm.quality import crc_bucket
from folioflow.session import fields, importable, plain_names

SEGMENT, LEAD, STEPS = 512, 64, 128
HIDDEN = 8
PER_LANGUAGE, SAMPLE_BYTES, LONG = 300, 3 << 16, 1 << 14
EPOCHS, BATCH, RATE = 16, 96, 0.02
LANES = 2048
UNKNOWN = "und"
LETTER = r"\p{L}"


def segments(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes by position and segment, bytes in each segment, the offset of each text's first segment, and where segments start."""
    per = -(-np.diff(at) // size)
    first = np.r_[0, np.cumsum(per)].astype(np.int64)
    starts = at[:-1].repeat(per) + size * (np.arange(first[-1]) - first[:-1].repeat(per))
    held = np.minimum(size, at[1:].repeat(per) - starts)
    low = np.concatenate([ts.LOWER[data], np.zeros(size, np.uint8)])
    x = low[starts[None, :] + np.arange(size)[:, None]] if len(starts) else np.zeros((size, 0), np.uint8)
    x[np.arange(size)[:, None] >= held[None, :]] = 0
    return x, held, first, starts


def new_model(labels: int, rng, hidden: int = HIDDEN) -> dict:
    """in: what a byte adds to the gates z, r and the candidate, for each direction; rec: what the state adds; out, bias: labels of both states."""
    one = lambda *s: rng.normal(0, 1 / np.sqrt(s[-2]), s).astype(np.float32)
    return {"in": rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32), "rec": one(2, hidden, 3 * hidden), "cand": np.zeros((2, hidden), np.float32), "out": one(2 * hidden, labels), "bias": np.zeros(labels, np.float32)}


def gradients(p: dict, x: np.ndarray, held: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over all positions of segments (columns of x) with labels y, and its gradient by backpropagation through time.

    Both directions run together: the first axis of states is the direction, and step t of the backward one is position T - 1 - t.
    """
    steps, n = x.shape
    h, kind = p["cand"].shape[1], p["out"].dtype
    both = np.stack([x, x[::-1]], axis=1)  # step, direction, segment
    on = np.arange(steps)[:, None] < held
    live = np.stack([on, on[::-1]], axis=1).astype(kind)[..., None]
    gates = np.stack([p["in"][0][both[:, 0]], p["in"][1][both[:, 1]]], axis=1)
    s, saved, states = np.zeros((2, n, h), kind), [], np.empty((steps, 2, n, h), kind)
    for t in range(steps):
        rec = s @ p["rec"]
        zr = 0.5 * np.tanh(0.5 * (gates[t, :, :, : 2 * h] + rec[..., : 2 * h])) + 0.5
        z, r = zr[..., :h], zr[..., h:]
        inner = rec[..., 2 * h :] + p["cand"][:, None]
        c = np.tanh(gates[t, :, :, 2 * h :] + r * inner)
        saved.append((s, z, r, inner, c))
        s = s + live[t] * (1 - z) * (c - s)
        states[t] = s
    joint = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # position, segment
    logits = joint @ p["out"] + p["bias"]
    e = np.exp(logits - logits.max(2, keepdims=True))
    prob = e / e.sum(2, keepdims=True)
    total = max(1, int(on.sum()))
    loss = float(-(np.log(prob[:, np.arange(n), y] + 1e-30) * on).sum() / total)
    prob[:, np.arange(n), y] -= 1
    dl = (prob * (on[..., None] / total)).astype(kind)
    g = {"out": joint.reshape(-1, 2 * h).T @ dl.reshape(-1, dl.shape[2]), "bias": dl.sum((0, 1)), "rec": np.zeros_like(p["rec"]), "cand": np.zeros_like(p["cand"])}
    dj = dl @ p["out"].T
    ds_at = np.stack([dj[..., :h], dj[::-1, :, h:]], axis=1)
    ds, d_in, back = np.zeros((2, n, h), kind), np.empty((steps, 2, n, 3 * h), kind), p["rec"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        s, z, r, inner, c = saved[t]
        ds = ds + ds_at[t]
        dn = ds * live[t]
        d = d_in[t]
        d[..., 2 * h :] = dc = dn * (1 - z) * (1 - c * c)
        d[..., :h] = dn * (s - c) * z * (1 - z)
        d[..., h : 2 * h] = dc * inner * r * (1 - r)
        d_rec = d.copy()
        d_rec[..., 2 * h :] = di = dc * r
        g["rec"] += s.transpose(0, 2, 1) @ d_rec
        g["cand"] += di.sum(1)
        ds = ds - dn * (1 - z) + d_rec @ back
    g["in"] = np.zeros_like(p["in"])
    for k in range(2):
        own, flat = both[:, k].ravel(), d_in[:, k].reshape(-1, 3 * h)
        for j in range(3 * h):
            g["in"][k, :, j] = np.bincount(own, flat[:, j], 256)
    return loss, g


def train(x: np.ndarray, held: np.ndarray, y: np.ndarray, labels: int, seed: int = 9) -> dict:
    """x: bytes by position and segment; y: a label for each segment, which all its positions learn."""
    rng = np.random.default_rng(seed)
    p = new_model(labels, rng)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step, n = 0, x.shape[1]
    for epoch in range(EPOCHS):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            pick = np.sort(order[i : i + BATCH])
            top = int(held[pick].max())
            _, g = gradients(p, x[:top, pick], held[pick], y[pick])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            step += 1
            for k in p:
                a = g[k] * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.999 * v[k] + 0.001 * a * a
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


class Network:
    """A model laid out for prediction: features are rows, segments columns; a sigmoid is a tanh of half the sum."""

    def __init__(self, p: dict):
        h = self.hidden = p["cand"].shape[1]
        half = np.r_[np.full(2 * h, 0.5), np.ones(h)].astype(np.float32)[:, None]
        self.weights = [(np.ascontiguousarray(p["in"][d].T * half), np.ascontiguousarray(p["rec"][d].T * half), p["cand"][d][:, None]) for d in range(2)]
        self.out, self.bias = (p["out"][:h].T, p["out"][h:].T), p["bias"]

    def step(self, d: int, s: np.ndarray, x: np.ndarray) -> None:
        """Takes states s on by one byte each, in place."""
        table, rec_w, cand = self.weights[d]
        h = self.hidden
        gates, rec = table.take(x, axis=1), rec_w @ s
        zr = gates[: 2 * h]
        zr += rec[: 2 * h]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        c = rec[2 * h :]
        c += cand
        c *= zr[h:]
        c += gates[2 * h :]
        np.tanh(c, out=c)
        s -= c
        s *= zr[:h]
        s += c

    def _led(self, d: int, n: int, low: np.ndarray, lanes: np.ndarray, near: np.ndarray, count: np.ndarray) -> np.ndarray:
        """States of n segments at their edge: of lanes after count bytes that lead up to place near, zero of the others."""
        s = np.zeros((self.hidden, n), np.float32)
        if len(lanes):
            order = np.argsort(-count, kind="stable")
            lanes, near, count = lanes[order], near[order], count[order]
            own = np.zeros((self.hidden, len(lanes)), np.float32)
            for k in range(int(count[0]), 0, -1):  # the k-th byte from the edge
                w = int(np.searchsorted(-count, -k, "right"))
                part = own[:, :w] if w < len(lanes) else own
                self.step(d, part, low[near[:w] - k if d == 0 else near[:w] + k - 1])
            s[:, lanes] = own
        return s

    def positions(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each segment the sum over its positions of their label probabilities, and the offset of each text's first segment."""
        x, held, first, starts = segments(data, at, SEGMENT)
        low, k = ts.LOWER[data], len(self.bias)
        text = np.repeat(np.arange(len(at) - 1), np.diff(first))
        before = np.where(starts > at[:-1][text], LEAD, 0)
        behind = np.minimum(LEAD, at[1:][text] - starts - held)
        out = np.zeros((x.shape[1], k), np.float32)
        order = np.argsort(-held, kind="stable")
        for i in range(0, x.shape[1], LANES):
            pick = order[i : i + LANES]
            xb, n = np.ascontiguousarray(x[:, pick]), held[pick]
            top = int(n[0])
            live = np.searchsorted(-n, -np.arange(1, top + 1), "right")  # segments that reach each position: the first so many
            logits = np.zeros((top, k, len(pick)), np.float32)
            for d, near, count in ((0, starts[pick], before[pick]), (1, starts[pick] + n, behind[pick])):
                some = np.flatnonzero(count)
                s = self._led(d, len(pick), low, some, near[some], count[some])
                for t in range(top) if d == 0 else range(top - 1, -1, -1):
                    w = live[t]
                    own = s[:, :w] if w < s.shape[1] else s
                    self.step(d, own, xb[t, :w])
                    logits[t, :, :w] += self.out[d] @ own
            logits += self.bias[:, None]
            logits -= logits.max(1, keepdims=True)
            np.exp(logits, out=logits)
            logits *= (np.arange(top)[:, None] < n[None, :])[:, None, :] / logits.sum(1, keepdims=True)
            out[pick] = logits.sum(0).T
        return out, first


class Identifier:
    """Learned from docs' text and language columns only; the key decides by its hash which rows are learned from.

    Rows without a language or a letter teach nothing. With one language learned all texts with a letter are that one, with none they are 'und'.
    """

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE, sample_bytes: int = SAMPLE_BYTES):
        importable(docs.sparkSession)
        size = F.octet_length(text)
        real = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(LETTER)).select(F.col(lang).alias("l"), F.xxhash64(F.lit(4), key).alias("h"), F.col(text).alias("t"), size.alias("b"))
        counts = real.groupBy("l").agg(F.count_if(F.col("b") <= LONG).alias("n"), F.count(F.lit(1)).alias("all")).collect()
        # about twice the wanted rows pass by their hash; of them the window takes the first
        share = {r.l: int(min(1.0, (2 * per_language + 50) / max(1, r.n)) * (1 << 30)) for r in counts}
        few = {r.l: int(min(1.0, (2 * per_language + 50) / r.all) * (1 << 30)) if r.n == 0 else 0 for r in counts}
        passed = lambda of: F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[F.col("l")] if of else F.lit(0)
        rows = real.where(F.shiftrightunsigned("h", 34) < F.when(F.col("b") <= LONG, passed(share)).otherwise(passed(few)))
        order = Window.partitionBy("l").orderBy("h", "t")
        first = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
        held = first.withColumn("upto", F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("upto") - F.col("b") < sample_bytes)
        got = sorted(held.select("t", "l", "h").collect(), key=lambda r: (r.l, r.h, r.t))
        self.labels = sorted({r.l for r in got})
        if len(self.labels) > 1:
            data, at = ts.flat(pa.array([r.t for r in got], pa.string()))
            x, n, first_of, _ = segments(data, at, STEPS)
            y = np.repeat([self.labels.index(r.l) for r in got], np.diff(first_of))
            self.model = train(x, n, y, len(self.labels))
        else:
            self.model = None

    def predict(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """All columns of docs with lang_pred and score (which replace columns of these names), row by row.

        Null texts and those without a letter are 'und' with score 0. Keys play no part; repeated rows give repeated results, an empty table none.
        """
        importable(docs.sparkSession)
        names = docs.columns
        plain = plain_names(docs)
        at_text, width = names.index(text), len(names)
        box = docs.sparkSession.sparkContext.broadcast((self.labels, self.model))

        def run(batches):
            labels, model = box.value
            network = Network(model) if model is not None else None
            known = np.array(labels, object)
            for batch in batches:
                for i, j, data, at in ts.groups(batch.column(at_text)):
                    part = batch.slice(i, j - i)
                    letters = part.column(width).to_numpy(zero_copy_only=False)
                    pred, score = np.full(j - i, UNKNOWN, object), np.zeros(j - i)
                    if network is not None:
                        mass, first = network.positions(data, at)
                        total = np.cumsum(np.vstack([np.zeros(len(labels)), mass]), axis=0)
                        p = (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(at), 1)[:, None]
                        best = p.argmax(1)
                        pred[letters], score[letters] = known[best[letters]], np.clip(p[letters, best[letters]], 0, 1)
                    elif labels:
                        pred[letters], score[letters] = labels[0], 1.0
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names[:width], "lang_pred", "score"])

        letters = F.coalesce(F.col(f"c{at_text}").rlike(LETTER), F.lit(False)).alias("letters")
        found = plain.select("*", letters).mapInArrow(run, f"{fields(plain)}, lang_pred string, score double")
        return found.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n.lower() not in ("lang_pred", "score")], "lang_pred", "score")


def op4(spark, sf_dir: str) -> DataFrame:
    """Contract query: a third of the documents is held out."""
    from folioflow.sources.tables import table

    docs = table(spark, sf_dir, "documents")
    third = crc_bucket("doc_id", 3)
    known = Identifier(docs.where(third != 1).select("doc_id", "text", "lang"))
    return known.predict(docs.select("doc_id", "text")).select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")

"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Equal vectors are one node, which keeps their smallest ids (k + 1 of them), so a vector that a third of all rows share is one node too. Nodes are dealt
by a hash of the vector to shards of about SHARD nodes. In a shard, nodes come in batches: each batch takes its
nearest nodes among those before it and in it (one matrix product), keeps diverse ones, and links back; a list that
overflows is thinned the same way. Upper layers hold every 16th node of the layer below, by a hash. Layers are flat arrays of neighbour places, filled
with -1. For the largest inner product, vectors of a shard get one more component that makes their norms equal, and queries a zero.

Queries go to the shards in blocks of at most QUERY_BLOCK vectors; in a shard all queries of a slice walk the graph in
lockstep. How wide the walk is, is measured in each shard and for each block: the nearest nodes of PROBES of the queries are told by brute force, and the beam
is widened from LEAST on until walks find TARGET of them, so alike vectors cost little and unlike ones are still found; shards of at most SMALL nodes
start at WIDTH. The scores of what they find are inner products of the original vectors in double precision, added in order of components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.textscan import U64, mix, ragged, seeded
from folioflow.session import cut, importable

SHARD = 1 << 14
LINKS, UPPER_LINKS, STEP = 40, 16, 16
CANDIDATES = 64
LEAST, WIDTH, EXPAND = 64, 320, 8
SMALL, PROBES, TARGET = 1 << 12, 64, 0.98
QUERY_BLOCK = 1 << 16
SLICE = 512


def diverse(x: np.ndarray, own: np.ndarray, lists: np.ndarray, sims: np.ndarray, links: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 where none) at most links: those nearer to it than to any kept, then the nearest others."""
    n, c = lists.shape
    v = x[np.maximum(lists, 0)]
    among = v @ v.transpose(0, 2, 1)
    live = lists >= 0
    kept = np.zeros((n, c), bool)
    count = np.zeros(n, np.int64)
    worst = np.full((n, c), -np.inf, np.float32)
    for k in range(c):
        take = live[:, k] & (sims[:, k] > worst[:, k]) & (count < links)
        kept[:, k] = take
        count += take
        worst = np.where(take[:, None], np.maximum(worst, among[:, k, :]), worst)
    rank = np.where(kept, 0, np.where(live, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :links]
    out = np.take_along_axis(lists, order, 1)
    if c < links:
        out = np.hstack([out, np.full((n, links - c), -1, out.dtype)])
    return out.astype(np.int32)


def nearest(sims: np.ndarray, k: int) -> np.ndarray:
    k = min(k, sims.shape[1])
    part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1), 1)


def layer(x: np.ndarray, links: int) -> np.ndarray:
    """Neighbour places of every node, nodes linked in the order given."""
    n = len(x)
    out = np.full((n, links), -1, np.int32)
    done = 0
    while done < n:
        size = min(n - done, max(64, min(1024, done // 2)))
        own = np.arange(done, done + size)
        sims = x[own] @ x[: done + size].T
        sims[np.arange(size), own] = -np.inf
        lists = nearest(sims, min(CANDIDATES, done + size))
        near = np.take_along_axis(sims, lists, 1)
        lists = np.where(np.isfinite(near), lists, -1)
        out[own] = diverse(x, own, lists, near, links)
        done += size
        a, b = np.repeat(own, links), out[own].ravel()
        real = b >= 0
        a, b = a[real], b[real]
        order = np.lexsort((a, b))
        a, b = a[order], b[order]
        to, first, counts = np.unique(b, return_index=True, return_counts=True)
        for lo in range(0, len(to), 1024):
            t, f, m = to[lo : lo + 1024], first[lo : lo + 1024], counts[lo : lo + 1024]
            old = out[t]
            wide = np.full((len(t), links + int(m.max())), -1, np.int64)
            wide[:, :links] = old
            col = np.arange(int(m.max()))
            new = np.where(col[None, :] < m[:, None], a[np.minimum(f[:, None] + col[None, :], len(a) - 1)], -1)
            new[(new[:, :, None] == old[:, None, :]).any(2)] = -1
            wide[:, links:] = new
            s = np.einsum("nd,ncd->nc", x[t], x[np.maximum(wide, 0)])
            s[wide < 0] = -np.inf
            order = np.argsort(-s, axis=1)[:, : links + CANDIDATES]
            s, wide = np.take_along_axis(s, order, 1), np.take_along_axis(wide, order, 1)
            room = (wide >= 0).sum(1) <= links
            fits = wide[:, :links]
            out[t] = np.where(room[:, None], fits, diverse(x, t, wide, s, links))
    return out


class Graph:
    """Nodes in a hashed order; layer l holds the first n / STEP**l of them."""

    def __init__(self, vectors: np.ndarray, flat: list[np.ndarray] | None = None):
        norms = (vectors.astype(np.float64) ** 2).sum(1)
        self.x = np.hstack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]]).astype(np.float32)
        if flat is None:
            flat, n, links = [], len(vectors), LINKS
            while True:
                flat.append(layer(self.x[:n], links))
                if n <= STEP:
                    break
                n, links = -(-n // STEP), UPPER_LINKS
        self.flat = flat

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        """Places of about width nodes near each query, -1 where fewer are reached."""
        out = np.full((len(queries), width), -1, np.int64)
        for i in range(0, len(queries), SLICE):
            q = np.hstack([queries[i : i + SLICE], np.zeros((len(queries[i : i + SLICE]), 1), np.float32)])
            start = np.zeros((len(q), 1), np.int64)
            for lists in self.flat[:0:-1]:
                start = self._walk(q, start, lists, STEP)[:, :4]
            got = self._walk(q, start, self.flat[0], width)
            out[i : i + len(q), : got.shape[1]] = got
        return out

    def width(self, queries: np.ndarray, k: int, least: int) -> int:
        """The narrowest beam, each half as wide again as the one before, in which walks from these queries find TARGET of their k nearest nodes."""
        n = len(self.x)
        k, w = min(k, n), max(k, least)
        sims = queries @ self.x[:, :-1].T
        kth = np.partition(sims, n - k, axis=1)[:, n - k :].min(1, keepdims=True)
        while w < n:
            got = self.search(queries, w)
            found = (got >= 0) & (np.take_along_axis(sims, np.maximum(got, 0), 1) >= kth)
            if np.minimum(found.sum(1), k).sum() >= TARGET * k * len(queries):
                return w
            w += w // 2
        return n

    def _walk(self, q: np.ndarray, start: np.ndarray, lists: np.ndarray, width: int) -> np.ndarray:
        n, rows = len(lists), np.arange(len(q))
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n] = True
        beam = np.full((len(q), width), -1, np.int64)
        score = np.full((len(q), width), -np.inf, np.float32)
        opened = np.ones((len(q), width), bool)
        k = start.shape[1]
        beam[:, :k] = start
        real = start >= 0
        score[:, :k] = np.where(real, np.einsum("qd,qkd->qk", q, self.x[np.maximum(start, 0)]), -np.inf)
        opened[:, :k] = ~real
        seen[rows[:, None], np.where(real, start, n)] = True
        live = rows
        while len(live):
            shut = np.where(opened[live], -np.inf, score[live])
            take = np.argpartition(-shut, min(EXPAND, width) - 1, axis=1)[:, :EXPAND]
            fine = np.isfinite(np.take_along_axis(shut, take, 1))
            go = fine.any(1)
            live, take, fine = live[go], take[go], fine[go]
            if not len(live):
                break
            nodes = np.where(fine, beam[live[:, None], take], -1)
            opened[live[:, None], take] |= fine
            near = np.where((nodes >= 0)[:, :, None], lists[np.maximum(nodes, 0)], -1).reshape(len(live), -1)
            near = np.where(near < 0, n, near)
            near.sort(axis=1)
            fresh = ~seen[live[:, None], near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[live[:, None], near] = True
            r, c = np.nonzero(fresh)
            s = np.full(near.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("nd,nd->n", q[live[r]], self.x[near[r, c]])
            all_s = np.hstack([score[live], s])
            best = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            all_b, all_o = np.hstack([beam[live], near]), np.hstack([opened[live], ~fresh])
            score[live], beam[live], opened[live] = (np.take_along_axis(y, best, 1) for y in (all_s, all_b, all_o))
        order = np.argsort(-score, axis=1)
        beam = np.take_along_axis(beam, order, 1)
        return np.where(np.isfinite(np.take_along_axis(score, order, 1)), beam, -1)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, components added from the first on."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k].astype(np.float64) * x[:, k].astype(np.float64)
    return out


def share(k: int, shards: int) -> int:
    """How many of the k nearest one of so many shards holds at most: the mean and three deviations, as a hash deals them."""
    return min(k, math.ceil(k / shards + 3 * (k / shards * (1 - 1 / shards)) ** 0.5))


BUILT = "dim int, shard int, shards int, n int, vectors binary, ids binary, counts binary, layers array<binary>, links array<int>"


def _build(table: pa.Table) -> pa.Table:
    dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
    order = np.argsort(table.column("h").to_numpy(), kind="stable")
    v = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)[order]
    ids = table.column("ids").to_pylist()
    ids = [ids[i] for i in order]
    g = Graph(v)
    one = lambda x, kind: pa.array([x], kind)
    cols = [one(dim, pa.int32()), one(shard, pa.int32()), one(table.column("shards")[0].as_py(), pa.int32()), one(len(v), pa.int32()), one(v.tobytes(), pa.binary()), one(np.array([i for x in ids for i in x], np.int64).tobytes(), pa.binary()), one(np.array([len(x) for x in ids], np.int32).tobytes(), pa.binary()), one([f.tobytes() for f in g.flat], pa.list_(pa.binary())), one([f.shape[1] for f in g.flat], pa.list_(pa.int32()))]
    return pa.Table.from_arrays(cols, names=["dim", "shard", "shards", "n", "vectors", "ids", "counts", "layers", "links"])


def valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v of all rows whose vector takes part, as floats if they are given so, else as doubles; repeated rows once.

    Rows with a null id, or a vector that is null, empty or zero or holds null, infinite or undefined components, take no part.
    Other columns play no part, whatever their names. An empty table gives none.
    """
    kind = df.schema[vector].dataType
    kind = "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"
    own = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return own.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)).distinct()


def build(vectors: DataFrame, keep: int, shard: int = SHARD) -> DataFrame:
    """The graphs, one row a shard, in the shared folder."""
    importable(vectors.sparkSession)
    first = vectors.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= keep)
    nodes = first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("h", F.xxhash64("v")).withColumn("dim", F.size("v"))
    nodes = cut(nodes)
    shards = max(1, -(-nodes.count() // shard))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.lit(7), "h"), F.lit(shards)).cast("int")).withColumn("shards", F.lit(shards))
    return cut(dealt.groupBy("dim", "shard").applyInArrow(_build, BUILT))


def _searcher(block, k: int, keep: int):
    def run(batches):
        flat, places = block.value
        sizes = np.diff(places)
        for batch in batches:
            for i in range(len(batch)):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                pick = np.flatnonzero(sizes == row["dim"])
                if not len(pick):
                    continue
                x = np.frombuffer(row["vectors"])
                x = (x if len(x) == row["n"] * row["dim"] else np.frombuffer(row["vectors"], np.float32)).reshape(row["n"], row["dim"])
                ids, counts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int32).astype(np.int64)
                at = np.cumsum(counts) - counts
                g = Graph(x, [np.frombuffer(b, np.int32).reshape(-1, w) for b, w in zip(row["layers"], row["links"], strict=True)])
                q = flat[ragged(places[pick], sizes[pick])].reshape(len(pick), row["dim"])
                q32 = q.astype(np.float32)
                probes = q32[np.argsort(mix((q.view(U64) * seeded(row["dim"], 5)).sum(1)), kind="stable")[:PROBES]]
                got = g.search(q32, g.width(probes, share(keep, row["shards"]), max(WIDTH, 4 * k) if row["n"] <= SMALL else max(LEAST, 2 * keep)))
                a, c = np.nonzero(got >= 0)
                node = got[a, c]
                score = exact(q[a], x[node])
                run_of = np.repeat(np.arange(len(a)), counts[node])
                flat_ids = ids[ragged(at[node], counts[node])]
                a, score = a[run_of], score[run_of]
                order = np.lexsort((flat_ids, -score, a))
                a, score, flat_ids = a[order], score[order], flat_ids[order]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                top = place < keep
                yield pa.RecordBatch.from_arrays([pa.array(pick[a[top]], pa.int32()), pa.array(flat_ids[top], pa.int64()), pa.array(score[top], pa.float64())], names=["q", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each query row (id, v) but itself, ties to the smaller id.

    Vectors of different lengths are graphs of their own, and queries meet those of their length. Without queries there is no row.
    What is broadcast is bounded by query_block: its vectors, and k + 1 rows for each.
    """
    spark = index.sparkSession
    distinct = cut(queries.select("v").distinct())
    n_blocks = max(1, -(-distinct.count() // (query_block // 2)))
    named = distinct.withColumn("b", F.pmod(F.xxhash64(F.lit(3), "v"), F.lit(n_blocks)))
    kind = queries.schema["v"].dataType
    out = None
    for b in range(n_blocks):
        rows = named.where(F.col("b") == b).select("v").toArrow().column("v").combine_chunks()
        sizes = rows.value_lengths().to_numpy().astype(np.int64)
        flat, at = rows.flatten().to_numpy().astype(np.float64), np.r_[0, np.cumsum(sizes)]
        box = spark.sparkContext.broadcast((flat, at))
        found = index.repartition("dim", "shard").mapInArrow(_searcher(box, k, k + 1), "q int, vec_id long, score double")
        best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).drop("r")
        names = spark.createDataFrame(pa.table({"q": pa.array(range(len(rows)), pa.int32()), "v": rows})).withColumn("v", F.col("v").cast(kind))
        own = queries.join(F.broadcast(names), "v").select(F.col("id").alias("query_id"), "q")
        got = own.join(F.broadcast(best), "q").where(F.col("vec_id") != F.col("query_id"))
        top = got.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if n_blocks > 1:  # one block's vectors are out at a time
            top = cut(top)
            box.destroy()
        out = top if out is None else out.unionByName(top)
    return out


def op5(spark, sf_dir: str) -> DataFrame:
    """Contract query: a twentieth of the rows as queries against all."""
    from folioflow.sources.tables import table

    rows = cut(valid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return search(build(rows, 21), rows.where(F.col("id") % 20 == 0), 20)

"""Vector expressions over arrays, in double precision and a fixed order of components."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.session import fields

EPS = 1e-12
PRESETS = {"small": 16, "medium": 32, "full": 64}


def _sum(c) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a, b) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(EPS))


def euclidean(a, b) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def normalised(a) -> Column:
    n = F.greatest(norm(a), F.lit(EPS))
    return F.transform(a, lambda x: x.cast("double") / n)


def truncated(a, size: int) -> Column:
    """The first components, of length 1 again."""
    return normalised(F.slice(a, 1, size))


def guarded(a, size: int) -> Column:
    """The vector, or an error when its size is another."""
    return F.when(F.size(a) == size, a).otherwise(F.raise_error(F.concat(F.lit(f"{size} components expected, not "), F.size(a).cast("string"))))


def yes_probability(no, yes) -> Column:
    return 1 / (1 + F.exp(no - yes))


def plain(a) -> Column:
    """Whether a vector's components are all there and finite and its length is far from what a double can't square: others aren't for nearest()."""
    return F.coalesce(~F.exists(a, lambda x: x.isNull() | F.isnan(x)) & norm(a).between(1e-5, 1e15), F.lit(False))


#: Rows of a product of matrices, pairs that are scored at once, and what rounding to nine digits may move two scores.
NEAREST_ROWS, NEAREST_PAIRS, SCORE_OFF = 2048, 1 << 18, 2e-9


class _Nearest:
    """The best rows of each query among those that were added: a product in single precision leaves out what can't be one of them, the rest is scored in
    double precision, component by component in their order. What the n-th score is nearer to than rounding to nine digits can tell stays."""

    def __init__(self, queries: np.ndarray, n: int):
        self.n, self.columns = n, np.ascontiguousarray(queries.T)
        self.norms = np.sqrt(self._ordered_squares(self.columns))
        self.units = (self.columns / self.norms).astype(np.float32)
        self.off = (len(self.columns) + 8) * 2.0**-23  # twice what a product of units in single precision can be off
        self.floor = np.full(len(queries), -np.inf)
        self.parts: list[tuple] = []
        self.held, self.room = 0, 2 * n * len(queries)

    @staticmethod
    def _ordered_squares(columns: np.ndarray) -> np.ndarray:
        out = np.zeros(columns.shape[1])
        for c in columns:
            out += c * c
        return out

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        for i in range(0, len(ids), NEAREST_ROWS):
            self._add(ids[i : i + NEAREST_ROWS], np.ascontiguousarray(rows[i : i + NEAREST_ROWS].T))

    def _add(self, ids: np.ndarray, columns: np.ndarray) -> None:
        norms = np.sqrt(self._ordered_squares(columns))
        about = (columns / norms).astype(np.float32).T @ self.units
        least = self.floor - self.off
        if len(ids) > self.n:  # the n-th best of these rows alone is a bound, too
            low = np.isinf(self.floor)
            if low.any():
                least[low] = np.partition(about[:, low], len(ids) - self.n, axis=0)[len(ids) - self.n] - 2 * self.off
        r, q = np.nonzero(about >= least.astype(np.float32))
        for i in range(0, len(r), NEAREST_PAIRS):
            a, b = r[i : i + NEAREST_PAIRS], q[i : i + NEAREST_PAIRS]
            dots = np.zeros(len(a))
            for x, y in zip(columns, self.columns, strict=True):
                dots += x[a] * y[b]
            scores = dots / np.maximum(norms[a] * self.norms[b], EPS)
            keep = scores >= self.floor[b] - SCORE_OFF
            self.parts.append((b[keep], ids[a[keep]], scores[keep]))
            self.held += int(keep.sum())
            if self.held > self.room:
                self.settle()

    def settle(self) -> tuple:
        """query, id, score of what is held, cut to what can still be among a query's n."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, ids, scores = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        place = np.arange(len(q))
        first = lambda new: np.maximum.accumulate(np.where(new, place, 0))
        new = np.r_[True, q[1:] != q[:-1]]
        at = place - first(new)
        tie = place - first(new | np.r_[True, scores[1:] != scores[:-1]])
        nth = at == self.n - 1
        self.floor[q[nth]] = scores[nth]
        # of equal scores those with the smallest ids count
        keep = (tie < self.n) & (scores >= self.floor[q] - SCORE_OFF)
        self.parts = [(q[keep], ids[keep], scores[keep])]
        self.held = int(keep.sum())
        self.room = max(self.room, 2 * self.held)
        return self.parts[0]


def _matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows of a list array's vectors, by their number of components."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, flat[starts[at][:, None] + np.arange(size)]


def nearest(vectors: DataFrame, queries: DataFrame, n: int, id_type: str, query_type: str) -> DataFrame:
    """query_id, id, score (the cosine): of each query (query_id, q) at least its n best rows (id, v) of each task, ties to the smaller id.

    Both sides are plain vectors; queries are a block of a stated query set and go to all tasks.
    """
    asked = queries.toArrow().combine_chunks()
    names, sides = asked.column("query_id").combine_chunks(), {}
    if len(names):
        for at, rows in _matrices(asked.column("q").combine_chunks()):
            sides[rows.shape[1]] = (at, rows)
    sent = vectors.sparkSession.sparkContext.broadcast((names, sides))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sides = sent.value
        held: dict[int, _Nearest] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for at, rows in _matrices(batch.column(1)):
                if rows.shape[1] not in sides:
                    continue
                if rows.shape[1] not in held:
                    held[rows.shape[1]] = _Nearest(sides[rows.shape[1]][1], n)
                held[rows.shape[1]].add(keys[at], rows)
        for size, side in held.items():
            q, ids, scores = side.settle()
            for i in range(0, len(q), NEAREST_PAIRS):
                part = slice(i, i + NEAREST_PAIRS)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(sides[size][0][q[part]])), pa.array(ids[part]), pa.array(scores[part])], names=["query_id", "id", "score"])

    return vectors.select("id", "v").mapInArrow(run, f"query_id {query_type}, id {id_type}, score double")


def to_base64(a) -> Column:
    """The components as little-endian 32-bit floats, base64 encoded."""

    @F.pandas_udf("string")
    def encoded(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: base64.b64encode(np.asarray(v, "<f4").tobytes()).decode(), na_action="ignore")

    return encoded(a)


def from_base64(c, size: int) -> Column:
    """A vector of size components; another number of them is an error."""

    @F.pandas_udf("array<float>")
    def decoded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.frombuffer(base64.b64decode(t), "<f4").reshape(size), na_action="ignore")

    return decoded(c)


def last_token(states, mask) -> Column:
    """The state at the last place that the mask keeps: the last one where texts are padded on the left."""
    last = F.aggregate(F.sequence(F.lit(1), F.size(mask)), F.lit(0), lambda a, i: F.when(F.element_at(mask, i) > 0, i).otherwise(a))
    return F.when(last > 0, F.element_at(states, F.greatest(last, F.lit(1))))


def fitted_ids(ids, prefix: list[int], suffix: list[int], most: int) -> Column:
    """prefix, the first ids that leave room for both, and suffix: most ids at the most."""
    fixed = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    return F.concat(fixed(prefix), F.slice(ids, 1, most - len(prefix) - len(suffix)), fixed(suffix))


def left_padded(ids, width, pad: int = 0) -> Column:
    """ids padded on the left to width, and the mask of what is no padding."""
    n = F.greatest(width - F.size(ids), F.lit(0))
    return F.struct(F.concat(F.array_repeat(F.lit(pad), n), ids).alias("ids"), F.concat(F.array_repeat(F.lit(0), n), F.array_repeat(F.lit(1), F.size(ids))).alias("mask"))


def batches(texts: DataFrame, group: str, order: list[str], size: Column, most: int, budget: int | None = None) -> DataFrame:
    """texts with the number of their batch in the group: at most so many, and with a budget as long as their sizes fit it.

    By count alone it is arithmetic on the row's number; with a budget a text that does not fit opens a batch of its own, which only a fold can tell.
    """
    w = Window.partitionBy(group).orderBy(*order)
    if budget is None:
        return texts.withColumn("batch", F.floor((F.row_number().over(w) - 1) / most).cast("long"))
    sized = texts.withColumn("_size", size)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, held, used = None, 0, 0, 0
        for batch in rows:
            out = []
            for key, n in zip(batch.column(batch.schema.get_field_index(group)).to_pylist(), batch.column(batch.schema.get_field_index("_size")).to_pylist(), strict=True):
                if (key,) != last:
                    last, number, held, used = (key,), 0, 0, 0
                elif held and (used + n > budget or held >= most):
                    number, held, used = number + 1, 0, 0
                held, used = held + 1, used + n
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "batch"])

    dealt = sized.repartition(group).sortWithinPartitions(group, *order)
    return dealt.mapInArrow(run, f"{fields(sized)}, batch long").drop("_size")


def request_problem(query: Column, documents: Column, most_documents: int, most_query: int, most_document: int) -> Column:
    """The first guard that a request breaks, in order: empty query, no documents, too many, query too long, a document too long; null if none."""
    long_one = F.exists(documents, lambda d: F.length(d) > most_document)
    return (
        F.when(query.isNull() | (F.trim(F.regexp_replace(query, r"\s", " ")) == ""), "empty query")
        .when(documents.isNull() | (F.size(documents) == 0), "empty documents")
        .when(F.size(documents) > most_documents, "too many documents")
        .when(F.length(query) > most_query, "query too long")
        .when(long_one, "document too long")
    )


def checked_request(query: Column, documents: Column, **limits: int) -> Column:
    """True, or an error that names the guard."""
    problem = request_problem(query, documents, **limits)
    return F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(problem))

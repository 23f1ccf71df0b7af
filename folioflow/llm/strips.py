"""Bringing the repeated windows of a corpus together without comparing windows to each other.

The symbols are a text's bytes or its words. A window is WINDOW symbols in a row. The least hash among the GRAM-symbol grams of a
window is its mark; equal windows have equal marks. A strip is a run of windows with one mark: some 40 windows of bytes,
20 of words. So:

1. Marks of all documents, one row for each document that has one. Marks that occur once are dropped, unless the mark stands at
   several places of its document.
2. Every strip with a mark that is left is cut out of its text again and dealt by mark, with its symbols. Copies of a frequent strip that one
   task holds are settled there, symbol for symbol, so a copied passage gives a mark's group one row a task.
3. A resolver orders or matches the windows of each mark's group and tells which of them start earlier elsewhere.

The strips of a mark of more than HOT places are split by further marks, the more the more places, and dealt by all of them; so the windows that
reach over the edges of a common passage, which differ from document to document, leave its group. All steps cover all documents; rows with a null id take no part. Rows that share an id and a text are one
document; those that share an id only are several, in order of a hash of the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm import textscan as ts
from folioflow.session import cut, importable

HOT = 20_000
FREQUENT = 50
SENT_BYTES = 32 << 20
PLACE = 22
BLOCK_BYTES = 4 << 20
TEXT_SHIFT = 40  # a place is the text's number among those of its id, then the symbol


@dataclass(frozen=True)
class Unit:
    """words: symbols are words, else bytes. same: an earlier start in the same document counts."""

    words: bool
    window: int
    gram: int
    same: bool


def symbols_of(data: np.ndarray, at: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    if not unit.words:
        return ts.BYTE[data], at
    starts, ends, first = ts.words(data, at, ts.SOLID)
    return ts.hashes(data, starts, ends), first


def scan(symbols: np.ndarray, at: np.ndarray, unit: Unit):
    """text, first and last window, mark, and whether the mark stands at several places, of all strips; long inputs in pieces."""
    w, step = unit.window, (1 << PLACE) - 2 * unit.window
    for base in range(0, max(len(symbols) - w + 1, 0), step):
        piece = symbols[base : base + step + w - 1]
        n = len(piece) - w + 1
        grams = ts.Rolling(piece).grams(unit.gram)
        key = (grams >> ts.U64(PLACE) << ts.U64(PLACE)) | np.arange(len(grams), dtype=ts.U64)
        width, need = 1, w - unit.gram + 1
        while width < need:
            s = min(width, need - width)
            key = np.minimum(key[:-s], key[s:])
            width += s
        place = (key & ts.U64((1 << PLACE) - 1)).astype(np.int32)
        p = np.arange(n, dtype=np.int32)
        text = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(np.clip(at - base, 0, n)))
        fits = p + w <= (at[1:] - base)[text]
        new = np.ones(n, bool)
        moved = np.flatnonzero(place[1:] != place[:-1]) + 1
        new[1:] = ~fits[:-1] | (text[1:] != text[:-1])
        new[moved] |= grams[place[moved]] != grams[place[moved - 1]]
        new &= fits
        first = np.flatnonzero(new)
        if not len(first):
            continue
        stop = np.r_[np.flatnonzero(new[1:] | (fits[:-1] & ~fits[1:])) + 1, n]
        last = stop[np.searchsorted(stop, first, "right")] - 1
        off = at[text[first]] - base
        yield text[first].astype(np.int64), first - off, last - off, grams[place[first]], place[first] != place[last]


def _marks(unit: Unit):
    """A row for each document and mark, with the number of places, as far as more than one matters."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, at in ts.groups(batch.column(1)):
                symbols, offsets = symbols_of(data, at, unit)
                for text, _, _, mark, own in scan(symbols, offsets, unit):
                    order = np.lexsort((text, mark))
                    m, t = mark[order], text[order]
                    head = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (t[1:] != t[:-1])])
                    n = np.add.reduceat(1 + own[order].astype(np.int32), head)
                    yield pa.RecordBatch.from_arrays([pa.array(m[head].view(np.int64)), pa.array(ids[i + t[head]], pa.int64()), pa.array(n, pa.int32())], names=["h", "doc_id", "n"])

    return run


MARKS = "h long, doc_id long, n int"
#: p: place of the first symbol; s: the strip's symbols as UTF-8, with e = 1 if its mark may stand at several places in it; or s is null, for windows
#: settled already, which end before place e.
TEXTS = "h long, doc_id long, p long, e long, s binary"


def _rows(h, doc, p, e, strings) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.array(p, pa.int64()), pa.array(e, pa.int64()), strings], names=["h", "doc_id", "p", "e", "s"])


def _strings(data: np.ndarray, a: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(data[ts.ragged(a, size)])])


def _settled(doc, p, e) -> pa.RecordBatch:
    """Dealt anywhere, as nothing is left to do; e becomes exclusive."""
    h = ts.mix(np.asarray(doc, np.int64).view(ts.U64) + ts.U64(5)).view(np.int64)
    return _rows(h, doc, p, e, pa.nulls(len(h), pa.binary()))


class _Sent:
    """The earliest copy that this task sent of each frequent string. What is forgotten when there are too many is only sent again."""

    def __init__(self, unit: Unit):
        self.same, self.first, self.bytes = unit.same, {}, 0

    def settles(self, s: bytes, doc: int, p: int) -> bool | None:
        """Whether an earlier copy was sent; None for the same place of a repeated row."""
        own = (doc, p)
        first = self.first.get(s)
        if first is None or own < first:
            if first is None:
                self.bytes += len(s) + 200
                if self.bytes > SENT_BYTES:
                    self.first, self.bytes = {}, len(s) + 200
            self.first[s] = own
            return False
        return None if own == first else self.same or doc > first[0]


def _fetch(unit: Unit):
    """Strips of the asked marks. Copies of a frequent one are settled here if an earlier copy was sent; what is left of a hot mark's is split."""

    def run(batches):
        sent = _Sent(unit)

        def shipped(h, doc, p, windows, own, data, a, b, often):
            """Batches of strips, those marked often settled if they can be."""
            ship, done = np.ones(len(doc), bool), []
            for k in np.flatnonzero(often).tolist():
                s = data[a[k] : b[k]].tobytes()
                settled = sent.settles(b" ".join(s.split()) if unit.words else s, int(doc[k]), int(p[k]))
                ship[k] = settled is False
                if settled:
                    done.append(k)
            if done:
                yield _settled(doc[done], p[done], p[done] + windows[done] - 1 + unit.window)
            go = np.flatnonzero(ship)
            for lo in range(0, len(go), 20_000):
                x = go[lo : lo + 20_000]
                yield _rows(h[x].view(np.int64), doc[x], p[x], own[x].astype(np.int64), _strings(data, a[x], (b - a)[x]))

        for batch in batches:
            ids, number = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(np.int64)
            ask_at = batch.column(3).offsets.to_numpy().astype(np.int64)
            ask = batch.column(3).values
            marks, level = ask.field(0).to_numpy().view(ts.U64), ask.field(1).to_numpy(zero_copy_only=False)
            for i, j, data, at in ts.groups(batch.column(1)):
                symbols, offsets = symbols_of(data, at, unit)
                starts, ends = ts.words(data, at, ts.SOLID)[:2] if unit.words else (np.arange(len(data)), np.arange(1, len(data) + 1))
                salt = ts.mix(np.arange(j - i, dtype=ts.U64) + ts.U64(1))
                asked = marks[ask_at[i] : ask_at[j]] ^ np.repeat(salt, np.diff(ask_at[i : j + 1]))
                order = np.argsort(asked)
                asked, levels = asked[order], level[ask_at[i] : ask_at[j]][order]
                if not len(asked):
                    continue
                for text, p1, p2, mark, own in scan(symbols, offsets, unit):
                    key = mark ^ salt[text]
                    place = np.minimum(np.searchsorted(asked, key), len(asked) - 1)
                    keep = asked[place] == key
                    text, p1, p2, mark, own, lv = (x[keep] for x in (text, p1, p2, mark, own, levels[place]))
                    a = offsets[text] + p1
                    doc, p, n = ids[i + text], (number[i + text] << TEXT_SHIFT) + p1, p2 - p1 + 1
                    plain = lv <= 1
                    yield from shipped(mark[plain], doc[plain], p[plain], n[plain], own[plain], data, starts[a[plain]], ends[(a + n)[plain] + unit.window - 2], lv[plain] == 1)
                    for v in np.unique(lv[~plain]).tolist():
                        x = np.flatnonzero(lv == v)
                        row, off, count, h = split(symbols, a[x], n[x], mark[x], unit, 1 << (v - 1))
                        x = x[row]
                        begin = a[x] + off
                        yield from shipped(h, doc[x], p[x] + off, count, np.ones(len(x), bool), data, starts[begin], ends[begin + count + unit.window - 2], np.ones(len(x), bool))

    return run


def split(symbols: np.ndarray, begin: np.ndarray, windows: np.ndarray, mark: np.ndarray, unit: Unit, marks: int):
    """Strips as shorter ones that agree in further marks too, each the least of the window's gram hashes under another permutation.

    Gives the strip, the first window in it, the number of windows, and a hash of all marks, of every part. A window that reaches over the edge of a
    common passage keeps only the passage's marks with a chance that shrinks with their number.
    """
    size = windows + unit.window - 1
    at = np.r_[0, np.cumsum(size)]
    grams = ts.Rolling(symbols[ts.ragged(begin, size)]).grams(unit.gram)
    row = np.repeat(np.arange(len(begin)), windows)
    first = ts.ragged(at[:-1], windows)
    h = mark[row]
    for k in range(1, marks):
        low = ts.mix(grams ^ ts.U64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1))
        width, need = 1, unit.window - unit.gram + 1
        while width < need:
            s = min(width, need - width)
            low = np.minimum(low[:-s], low[s:])
            width += s
        h = ts.mix(h * ts.U64(0x9E3779B97F4A7C15) + low[first])
    head = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, np.int64)
    return row[head], (first - at[row])[head], np.diff(np.r_[head, len(h)]), h[head]


def binaries(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets from 0 of a binary column without nulls."""
    data, at = ts.flat(column.cast(pa.large_binary()))
    return data[at[0] : at[-1]], at - at[0]


def _resolve(resolver: Callable, unit: Unit, limit: int):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            done = batch.column(4).is_null().to_numpy(zero_copy_only=False)
            if done.any():
                x = batch.filter(pa.array(done))
                yield pa.RecordBatch.from_arrays([x.column(1), x.column(2), x.column(3)], names=["doc_id", "a", "b"])
                batch = batch.filter(pa.array(~done))
            if not len(batch):
                continue
            h = batch.column(0).to_numpy()
            edges = np.r_[np.flatnonzero(np.r_[True, h[1:] != h[:-1]]), len(h)]
            total = binaries(batch.column(4))[1]
            at = 0
            for e in edges[:-1]:
                # a block may end only between marks
                if size + total[e] - total[at] >= limit and (e > 0 or (held and held[-1].column(0)[len(held[-1]) - 1].as_py() != h[0])):
                    if e > at:
                        held.append(batch.slice(at, e - at))
                    yield from _solved(held, resolver, unit)
                    held, size, at = [], 0, e
            if at < len(h):
                held.append(batch.slice(at))
                size += total[-1] - total[at]
        yield from _solved(held, resolver, unit)

    return run


def _solved(held, resolver, unit):
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    data, at = binaries(t.column("s"))
    found = resolver(data, at, *(t.column(c).to_numpy() for c in ("h", "doc_id", "p", "e")), unit)
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["doc_id", "a", "b"])


def distinct_strips(symbols: np.ndarray, first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each row the first row of its mark with the same symbols; rows come ordered by mark, document and place.

    Rows are brought together by a hash, and each is compared with its first, symbol for symbol; one that differs stays its own.
    """
    size = np.diff(first)
    c = ts.Rolling(symbols).spans(first[:-1], first[1:])
    row = np.arange(len(h))
    order = np.lexsort((row, size, c, h))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1]) | (size[order][1:] != size[order][:-1])]
    rep = np.empty(len(h), np.int64)
    rep[order] = order[np.maximum.accumulate(np.where(new, row, 0))]
    copy = np.flatnonzero(rep != row)
    wrong = copy[~ts.alike(symbols, first[copy], symbols, first[rep[copy]], size[copy])]
    rep[wrong] = wrong
    return rep


def repeats(docs: DataFrame, unit: Unit, resolver: Callable, hot: int = HOT, frequent: int = FREQUENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, t, k, spans (array of a, b in places; null if none) of all rows of docs (doc_id, t): what repeated windows cover.

    hot and frequent say how the rows of a mark are dealt; the result is the same.
    """
    importable(docs.sparkSession)
    # the id gets a name of its own, so that both uses of the texts have one plan and Spark deals them once
    real = docs.where("doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"))
    marks = real.mapInArrow(_marks(unit), MARKS)
    again = cut(marks.groupBy("h").agg(F.sum("n").alias("n") if unit.same else F.count(F.lit(1)).alias("n")).where("n > 1"))
    # 0: rare, 1: frequent, 2 to 7: hot, split by 2 to 64 marks
    level = F.when(F.col("n") > hot, F.least(F.lit(7), 2 + F.floor(F.log2(F.col("n") / hot)))).otherwise((F.col("n") > frequent).cast("int")).cast("byte")
    asked = marks.select("h", "doc_id").join(again, "h").groupBy("doc_id").agg(F.collect_list(F.struct("h", level.alias("level"))).alias("asked"))
    rows = real.repartition("_id").withColumn("k", F.dense_rank().over(Window.partitionBy("_id").orderBy(F.xxhash64("_t"), "_t")) - 1)
    texts = rows.join(asked, rows["_id"] == asked["doc_id"]).select("_id", "_t", "k", "asked").mapInArrow(_fetch(unit), TEXTS)
    found = texts.repartition("h").sortWithinPartitions("h", "doc_id", "p").mapInArrow(_resolve(resolver, unit, block_bytes), "doc_id long, a long, b long")
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    out = rows.join(spans, rows["_id"] == spans["doc_id"], "left").select(F.col("_id").alias("doc_id"), F.col("_t").alias("t"), "k", "spans")
    return out.unionByName(docs.where("doc_id is null").select("doc_id", "t", F.lit(0).alias("k"), F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("spans")))


def spans_of(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of a batch of what repeats() gives: merged starts, ends, and the offset of each row's first."""
    number, lists = batch.column(2).to_numpy().astype(np.int64), batch.column(3)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(batch)), lists.value_lengths().fill_null(0).to_numpy())
    a, b = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    own = (a >> TEXT_SHIFT) == number[row]
    a, b, row = (x[own] for x in (a, b, row))
    base = number[row] << TEXT_SHIFT
    order = np.lexsort((a, row))
    a, b, row = (a - base)[order], (b - base)[order], row[order]
    gap = row << TEXT_SHIFT  # merged over all rows at once, each in a range of its own
    s, e = ts.merged(a + gap, b + gap)
    row = s >> TEXT_SHIFT
    return s - (row << TEXT_SHIFT), e - (row << TEXT_SHIFT), np.searchsorted(row, np.arange(len(batch) + 1))

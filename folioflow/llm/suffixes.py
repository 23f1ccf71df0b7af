"""Substring deduplication by suffix sorting: every byte of a repeated 100-byte string but its first occurrence goes.

The strips framework brings together the suffixes that may be alike; here each group's are ordered deep-shallow, to the window's length.
Multikey quicksort splits every group by a pivot on 8 bytes at a time, and what equals the pivot goes on 8 bytes deeper, to SHALLOW bytes. What
still ties has a long common prefix, and a blind trie orders each such group: a suffix goes down by the branching bytes alone, is
compared with one leaf, and is put where the two part. Repeats are neighbours in the order that agree in the whole window. Whole strips that
are alike, byte for byte, are ordered once: the earliest speaks for them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import textscan as ts
from folioflow.llm.strips import Unit, distinct_strips, repeats, spans_of

WINDOW, GRAM = 100, 24
SHALLOW = 24


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on as one big-endian number; zeros after the end."""
    x = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    for s in (1, 2, 4):
        x = (x[:-s] << np.uint64(8 * s)) | x[s:]
    return x[: len(data)]


def quicksort(keys: np.ndarray, begin: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey quicksort of suffixes (begin, ascending group numbers) to depth bytes, all groups side by side.

    Gives the order, and first and end of each run in it that ties in depth bytes. A pass splits every open run into less, equal and
    greater than its pivot, the middle of three; equal suffixes go on at the next key. Ties keep their order.
    """
    n = len(begin)
    own = np.arange(n)
    lo = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    hi, at = np.r_[lo[1:], n].astype(np.int64), np.zeros(len(lo), np.int64)
    tied_lo, tied_hi = [], []
    while True:
        full = (at >= depth) & (hi - lo > 1)
        tied_lo.append(lo[full])
        tied_hi.append(hi[full])
        go = (at < depth) & (hi - lo > 1)
        lo, hi, at = lo[go], hi[go], at[go]
        if not len(lo):
            break
        size = hi - lo
        place, run = ts.ragged(lo, size), np.repeat(np.arange(len(lo)), size)
        key = keys[begin[own[place]] + at[run]]
        base = np.cumsum(size) - size
        a, b, c = key[base], key[base + size // 2], key[base + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[run]
        less, more = key < pivot, key > pivot
        equal = ~(less | more)
        counts = [np.add.reduceat(x.astype(np.int64), base) for x in (less, equal, more)]
        to = np.empty(len(place), np.int64)
        start = lo
        for x, k in zip((less, equal, more), counts, strict=True):
            before = np.cumsum(x) - x  # of the class, over all runs
            to[x] = (start[run] + before - before[base][run])[x]
            start = start + k
        own[to] = own[place]
        mid = lo + counts[0]
        lo, hi, at = np.concatenate([lo, mid, mid + counts[1]]), np.concatenate([mid, mid + counts[1], hi]), np.concatenate([at, at + 8, at])
    a, b = np.concatenate(tied_lo), np.concatenate(tied_hi)
    order = np.argsort(a)
    return own, a[order], b[order]


class BlindTrie:
    """Strings of one length; inner nodes are [depth, kids by the byte there], leaves are [-1, string, indices]."""

    def __init__(self):
        self.root = None

    def add(self, s: bytes, index: int) -> None:
        node = self.root
        if node is None:
            self.root = [-1, s, [index]]
            return
        while node[0] >= 0:
            kids = node[1]
            node = kids.get(s[node[0]]) or next(iter(kids.values()))
        if node[1] == s:
            node[2].append(index)
            return
        n = len(s)
        same = n - ((int.from_bytes(s, "big") ^ int.from_bytes(node[1], "big")).bit_length() + 7) // 8
        other, up, at = node[1][same], None, self.root
        while 0 <= at[0] < same:
            up, at = at, at[1][s[at[0]]]
        leaf = [-1, s, [index]]
        if at[0] == same:
            at[1][s[same]] = leaf
        else:
            inner = [same, {other: at, s[same]: leaf}]
            if up is None:
                self.root = inner
            else:
                up[1][s[up[0]]] = inner

    def leaves(self):
        """Leaves in ascending order of their strings."""
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node[0] < 0:
                yield node[1], node[2]
            else:
                todo += [node[1][k] for k in sorted(node[1], reverse=True)]


def deep_shallow(data: np.ndarray, begin: np.ndarray, group: np.ndarray, window: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes cut to window bytes, ordered within their groups, and for each in the order whether it equals its predecessor.

    Equal ones keep the order in which they are given.
    """
    own, lo, hi = quicksort(eights(data), begin, group, shallow)
    same = np.zeros(len(own), bool)
    if not len(lo):
        return own, same
    size = hi - lo
    place, head = ts.ragged(lo, size), np.repeat(lo, size)
    equal = ts.alike(data, begin[own[place]], data, begin[own[head]], np.full(len(place), window))
    uniform = np.logical_and.reduceat(equal, np.cumsum(size) - size)  # runs of equal windows are in order already
    same[place] = np.repeat(uniform, size) & (place != head)
    raw = data.tobytes()
    for a, b in zip(lo[~uniform].tolist(), hi[~uniform].tolist(), strict=True):
        trie = BlindTrie()
        for i in own[a:b].tolist():
            s = int(begin[i])
            trie.add(raw[s : s + window], i)
        out = a
        for _, indices in trie.leaves():
            own[out : out + len(indices)] = indices
            same[out + 1 : out + len(indices)] = True
            out += len(indices)
    return own, same


def resolve(data, at, h, doc, p, own, unit: Unit):
    """Spans of all windows that an earlier one of their mark equals; rows come ordered by mark, document and place."""
    w = unit.window
    windows = np.diff(at) - w + 1
    rep = distinct_strips(ts.BYTE[data], at, h)
    row = np.arange(len(h))
    copies = np.flatnonzero((rep != row) & ~((doc == doc[rep]) & (p == p[rep])))  # a repeated row is no repeat
    found = [(doc[copies], p[copies], p[copies] + windows[copies] - 1 + w)]
    mine = np.flatnonzero(rep == row)
    alone = np.r_[True, h[mine][1:] != h[mine][:-1]] & np.r_[h[mine][1:] != h[mine][:-1], True] if len(mine) else np.zeros(0, bool)
    many = mine[~alone | (own[mine] > 0)]  # a strip alone in its mark repeats a window only if the mark stands at several places in it
    if len(many):
        begin, of = ts.ragged(at[many], windows[many]), np.repeat(many, windows[many])
        group = np.cumsum(np.r_[True, h[many][1:] != h[many][:-1]])[np.repeat(np.arange(len(many)), windows[many])]
        order, same = deep_shallow(data, begin, group, w)
        r, start = of[order[same]], begin[order[same]]
        found.append((doc[r], p[r] + start - at[r], p[r] + start - at[r] + w))
    return tuple(np.concatenate(x) for x in zip(*(joined(*f) for f in found), strict=True))


def joined(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of one document as one."""
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    if not len(doc):
        return doc, a, b
    number = np.cumsum(np.r_[False, doc[1:] != doc[:-1]])
    low, span = int(a.min()), int(b.max() - a.min()) + 1
    if span * (int(number[-1]) + 1) < 1 << 62:
        s, e = ts.merged(a - low + number * span, b - low + number * span)
        k = s // span
        heads = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        return doc[heads][k], s - k * span + low, e - k * span + low
    return doc, a, b


BYTES = Unit(words=False, window=WINDOW, gram=GRAM, same=True)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, from_byte, to_byte (maximal removed runs), kept (the remaining bytes) of every row.

    Null texts are empty; texts shorter than the window stay whole, and so do rows with a null id, which also remove nothing. Rows of
    one id and text count as one document and give the same result; rows of one id with different texts are documents one after the other, in order of a
    hash of the text. Other columns of docs play no part, whatever their names. An empty table gives none.
    """

    def cut_out(batches):
        for batch in batches:
            data, at = ts.flat(batch.column(1))
            raw = memoryview(data)
            s, e, first = spans_of(batch)
            i = 0
            while i < len(batch):
                j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 21), "right")) - 1)
                kept, starts, ends = [], s[first[i] : first[j]], e[first[i] : first[j]]
                for k in range(i, j):
                    x, a, b = raw[at[k] : at[k + 1]], s[first[k] : first[k + 1]].tolist(), e[first[k] : first[k + 1]].tolist()
                    kept.append(b"".join(x[p:q] for p, q in zip([0, *b], [*a, len(x)], strict=True)))
                offsets = pa.array(first[i : j + 1] - first[i], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for v in (starts, ends)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at[i : j + 1]), pa.int64()), *lists, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "from_byte", "to_byte", "kept"])
                i = j

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))
    return repeats(own, BYTES, resolve, **options).mapInArrow(cut_out, "doc_id long, n_bytes long, from_byte array<long>, to_byte array<long>, kept binary")


def op2(spark, sf_dir: str) -> DataFrame:
    """Contract query: strings of 100 bytes."""
    from folioflow.sources.tables import table

    got = remove(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("from_byte").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

"""Substring deduplication by repeated-phrase automata: every word of a 50-word passage goes that a document with a smaller id has too.

The strips framework deals every stretch of text that may recur by its mark. A shard gives its words exact numbers, confirms which
passages recur, word for word, in several documents, and compiles them into Aho-Corasick automata of at most PATTERNS passages each: a mark's only
strip is one passage, else each recurring window is. Then the stretches that were dealt stream through the shard's automata, and every
occurrence in a document after the passage's first is removed. Copies of a frequent stretch that its task had sent before are settled by the framework, symbol
for symbol, and don't come here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import textscan as ts
from folioflow.llm.strips import Unit, distinct_strips, repeats, spans_of
from folioflow.llm.suffixes import joined

WINDOW, GRAM = 50, 8
PATTERNS = 4096
WORDS = Unit(words=True, window=WINDOW, gram=GRAM, same=False)


def numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each distinct word, by hash; words are compared with the first of their hash, and those unlike it get numbers of their own."""
    _, first, ids = np.unique(ts.hashes(data, starts, ends), return_index=True, return_inverse=True)
    rep, size = first[ids], ends - starts
    wrong = size != size[rep]
    check = np.flatnonzero(~wrong)
    wrong[check] = ~ts.alike(data, starts[check], data, starts[rep[check]], size[check])
    own: dict[bytes, int] = {}
    for k in np.flatnonzero(wrong).tolist():
        ids[k] = len(first) + own.setdefault(data[starts[k] : ends[k]].tobytes(), len(own))
    return ids


def recurring(ids, begin, row, doc, h, w) -> np.ndarray:
    """Of windows in order of mark, document and place: the first of each that starts in several documents, word for word."""
    hashed = ts.mix(ts.mix(ids.astype(ts.U64) + ts.U64(1)))
    key = ts.Rolling(hashed).spans(begin, begin + w)
    own = np.arange(len(begin))
    found = []
    while len(own):  # each turn settles, of every hash, the windows that are its first one's words
        order = own[np.lexsort((own, key[own], h[row[own]]))]
        new = np.r_[True, (key[order][1:] != key[order][:-1]) | (h[row[order]][1:] != h[row[order]][:-1])]
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        same = ts.alike(ids, begin[order], ids, begin[head], np.full(len(order), w))
        found.append(np.unique(head[same & (doc[row[order]] != doc[row[head]])]))
        own = np.sort(order[~same])
    return np.sort(np.concatenate(found)) if found else own


def resolve(data, at, h, doc, p, own, unit: Unit):
    import ahocorasick

    starts, ends, first = ts.words(data, at, ts.SOLID)
    ids, w = numbers(data, starts, ends), unit.window
    rep, row = distinct_strips(ts.mix(ids.astype(ts.U64) + ts.U64(1)), first, h), np.arange(len(h))
    edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    group = np.cumsum(np.r_[False, h[1:] != h[:-1]])
    kinds, docs = np.add.reduceat((rep == row).astype(np.int64), edge), np.diff(np.r_[edge, len(h)])
    one = (kinds == 1) & (docs > 1)
    many = np.flatnonzero((kinds > 1)[group])
    n = np.diff(first)[many] - w + 1
    begin, of = ts.ragged(first[many], n), np.repeat(many, n)
    passages = recurring(ids, begin, of, doc, h, w)
    # (mark's group, first word, words, document) of every passage
    parts = [(group[of[passages]], begin[passages], np.full(len(passages), w), doc[of[passages]]), (np.flatnonzero(one), first[edge[one]], np.diff(first)[edge[one]], doc[edge[one]])]
    g, a, size, earliest = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(g, kind="stable")
    g, a, size, earliest = g[order], a[order], size[order], earliest[order]
    bound = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)] if len(g) else np.zeros(1, np.int64)
    found_row, found_end, found_size = [], [], []
    k = 0
    while k < len(bound) - 1:
        stop = k + 1
        while stop < len(bound) - 1 and bound[stop + 1] - bound[k] <= PATTERNS:
            stop += 1
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for i in range(bound[k], bound[stop]):
            automaton.add_word(tuple(ids[a[i] : a[i] + size[i]].tolist()), (int(earliest[i]), int(size[i])))
        automaton.make_automaton()
        for r in np.flatnonzero(np.isin(group, g[bound[k] : bound[stop]])).tolist():
            at_doc = int(doc[r])
            for end, (least, length) in automaton.iter(tuple(ids[first[r] : first[r + 1]].tolist())):
                if at_doc > least:
                    found_row.append(r)
                    found_end.append(end + 1)
                    found_size.append(length)
        k = stop
    r, e = np.array(found_row, np.int64), np.array(found_end, np.int64)
    return joined(doc[r], p[r] + e - np.array(found_size, np.int64), p[r] + e)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_words, from_word, to_word (maximal removed runs), kept (the kept words, one space between) of every row.

    Null texts have no words; texts of fewer words than the window stay whole, and so do rows with a null id, which remove nothing either.
    Rows of one id are one document's, so they take nothing from each other; each row's own places are removed. Other columns of docs play no part,
    whatever their names. An empty table gives none.
    """

    def cut_out(batches):
        for batch in batches:
            s, e, first = spans_of(batch)
            for i, j, data, at in ts.groups(batch.column(1), 1 << 20):
                raw, n, kept = data.tobytes(), [], []
                for k in range(i, j):
                    words = raw[at[k - i] : at[k - i + 1]].split()
                    n.append(len(words))
                    for x, y in zip(reversed(s[first[k] : first[k + 1]].tolist()), reversed(e[first[k] : first[k + 1]].tolist()), strict=True):
                        del words[x:y]
                    kept.append(b" ".join(words))
                offsets = pa.array(first[i : j + 1] - first[i], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v[first[i] : first[j]], pa.int64())) for v in (s, e)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), *lists, pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "from_word", "to_word", "kept"])

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))
    return repeats(own, WORDS, resolve, **options).mapInArrow(cut_out, "doc_id long, n_words long, from_word array<long>, to_word array<long>, kept string")


def op7(spark, sf_dir: str) -> DataFrame:
    """Contract query: passages of 50 words."""
    from folioflow.sources.tables import table

    got = remove(table(spark, sf_dir, "documents"))
    gone = F.aggregate(F.zip_with("from_word", "to_word", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return got.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))

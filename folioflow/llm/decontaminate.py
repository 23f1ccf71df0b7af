"""Benchmark decontamination by an FM-index of each shard of the training texts.

A shard is a run of texts of about SHARD_WORDS words as a map task reads them, so nothing is shuffled. Its words are
the symbols: words of the test phrases have ids from 1, all other words and the edges of texts are separators, each
smaller than all ids and unlike any other. The shard's suffix array (prefix doubling; only suffixes that
begin with an id need sorting) gives the Burrows-Wheeler sequence, a wavelet matrix over it answers ranks, all phrases
are searched backward together, and occurrences are located by walking back to sampled suffix positions. Each
occurrence's words are then compared with the phrase's bytes, and overlapping removal spans are merged.

The phrases are sent to every task in blocks of at most BLOCK_BYTES of benchmark text, one block at a time; a larger benchmark takes more
passes over the texts. Each is written and read by the next one, which merges its spans with those so far, row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import textscan as ts
from folioflow.session import cut, fields, importable, plain_names

WINDOW = 10
SHARD_WORDS = 1 << 18
SAMPLE = 16
BLOCK_BYTES = 8 << 20


class Phrases:
    """Windows of the test items over an alphabet of their words; equal windows are one phrase with several items."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        column = pa.array([t for _, t in items], pa.string())
        data, at = ts.flat(column)
        starts, ends, first = ts.words(data, at, ts.ALNUM)
        h = ts.hashes(data, starts, ends, ts.BYTE_LOWER)
        self.words, where, ids = np.unique(h, return_index=True, return_inverse=True)
        low = ts.LOWER[data]
        self.bytes = [low[starts[k] : ends[k]].tobytes() for k in where]
        n = np.diff(first)
        found: dict[bytes, set] = {}
        for k, (item, _) in enumerate(items):
            own = ids[first[k] : first[k + 1]].astype(np.int32) + 1
            for i in range(max(1, n[k] - window + 1) if n[k] else 0):
                found.setdefault(own[i : i + window].tobytes(), set()).add(item)
        keys = sorted(found)
        self.length = np.array([len(k) // 4 for k in keys], np.int64)
        self.symbols = np.zeros((len(keys), window), np.int32)
        for i, k in enumerate(keys):
            self.symbols[i, : self.length[i]] = np.frombuffer(k, np.int32)
        self.items = np.array(sorted({x for s in found.values() for x in s}), np.int64)
        rank = {x: i for i, x in enumerate(self.items.tolist())}
        self.item_of = np.array([rank[x] for k in keys for x in sorted(found[k])], np.int64)
        self.item_at = np.r_[0, np.cumsum([len(found[k]) for k in keys], dtype=np.int64)].astype(np.int64)


class WaveletMatrix:
    """Ranks of any symbol up to any place: one row of bits a level, with running counts."""

    def __init__(self, x: np.ndarray, top: int):
        self.levels = []
        for b in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (x >> b) & 1
            ones = np.zeros(len(x) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            one = bit.astype(bool)
            self.levels.append((b, ones, len(x) - int(ones[-1])))
            x = np.concatenate([x[~one], x[one]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before place i, for each pair."""
        low = np.zeros_like(i)
        for b, ones, zeros in self.levels:
            one = ((c >> b) & 1).astype(bool)
            ri, rl = ones[i], ones[low]
            i = np.where(one, zeros + ri, i - ri)
            low = np.where(one, zeros + rl, low - rl)
        return i - low


class FMIndex:
    """symbols: ids from 1 to top, and 0 for separators; the first and the last are separators."""

    def __init__(self, symbols: np.ndarray, top: int):
        n = len(symbols)
        gaps, sa = np.flatnonzero(symbols == 0), np.flatnonzero(symbols)
        rank = np.empty(n, np.int64)
        rank[gaps] = np.arange(len(gaps))
        self.less = np.zeros(top + 2, np.int64)
        self.less[1:] = len(gaps) + np.r_[0, np.cumsum(np.bincount(symbols[sa], minlength=top + 1)[1:])]
        sa = sa[np.argsort(symbols[sa], kind="stable")]
        rank[sa] = self.less[symbols[sa]]
        # sa is ordered by the first h symbols; place: of the suffixes that still tie with a neighbour
        place, h = np.arange(len(sa)), 1
        while len(place):
            head = rank[sa[place]]
            tie = np.zeros(len(place), bool)
            same = head[1:] == head[:-1]
            tie[1:] |= same
            tie[:-1] |= same
            place, head = place[tie], head[tie]
            if not len(place):
                break
            order = np.argsort(head * (n + 1) + rank[sa[place] + h])
            own = sa[place][order]
            key, after = head, rank[own + h]
            sa[place] = own
            new = np.r_[True, (key[1:] != key[:-1]) | (after[1:] != after[:-1])]
            start = np.maximum.accumulate(np.where(new, place, 0))
            rank[own] = len(gaps) + start
            h *= 2
        sa = np.concatenate([gaps, sa])
        before = symbols[sa - 1]  # that of suffix 0 is the last one, a separator
        self.bwt, self.n = before, n
        self.tree = WaveletMatrix(before, top)
        held = (sa % SAMPLE == 0) | (before == 0)
        self.held = held
        self.held_at = np.r_[0, np.cumsum(held)]
        self.samples = sa[held]

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all phrases at once: those found, and their rows from and up to."""
        live = np.arange(len(phrases.length))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n)
        for step in range(phrases.symbols.shape[1]):
            at = phrases.length[live] - 1 - step
            go = at >= 0
            c = phrases.symbols[live[go], at[go]]
            low[go] = self.less[c] + self.tree.rank(c, low[go])
            high[go] = self.less[c] + self.tree.rank(c, high[go])
            some = low < high
            live, low, high = live[some], low[some], high[some]
            if not len(live):
                break
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, todo = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(todo):
            done = self.held[rows]
            out[todo[done]] = self.samples[self.held_at[rows[done]]] + steps
            todo, rows = todo[~done], rows[~done]
            if len(rows):
                c = self.bwt[rows]
                rows = self.less[c] + self.tree.rank(c, rows)
                steps += 1
        return out


def _shard(parts: list, phrases: Phrases) -> list[tuple]:
    """For each text of the shard: number of words, hit words, items, and removal spans in bytes."""
    symbols, lengths = [np.zeros(1, np.int32)], []
    for data, at, starts, ends, first, ids in parts:
        padded = np.zeros(len(ids) + len(first) - 1, np.int32)
        padded[np.arange(len(ids)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = ids
        symbols.append(padded)
        lengths.append(np.diff(first))
    seq, counts = np.concatenate(symbols), np.concatenate(lengths)
    opens = 1 + np.r_[0, np.cumsum(counts + 1)]  # where each text's first word stands
    blank = np.zeros(0, np.int64)
    out = [[int(c), 0, blank, blank, blank] for c in counts]
    index = FMIndex(seq, len(phrases.words))
    live, low, high = index.search(phrases)
    if not len(live):
        return out
    runs = high - low
    pos, which = index.locate(ts.ragged(low, runs)), np.repeat(live, runs)
    ends_at = pos + phrases.length[which]
    a, b = ts.merged(pos, ends_at)
    # the bytes of every word hit are held against the phrases' words
    doc_of = np.searchsorted(opens, a, "right") - 1
    base = np.r_[0, np.cumsum([len(p[4]) - 1 for p in parts])]
    wrong = np.zeros(len(seq) + 1, np.int64)
    for s, e, d in zip(a, b, doc_of, strict=True):
        k = int(np.searchsorted(base, d, "right")) - 1
        data, _, starts, ends, first, _ = parts[k]
        w = first[d - base[k]] + s - opens[d]
        for x in range(e - s):
            if ts.LOWER[data[starts[w + x] : ends[w + x]]].tobytes() != phrases.bytes[seq[s + x] - 1]:
                wrong[s + x + 1] = 1
    if wrong.any():
        bad = np.cumsum(wrong)
        good = bad[ends_at] == bad[pos]
        pos, ends_at, which = pos[good], ends_at[good], which[good]
        a, b = ts.merged(pos, ends_at)
        doc_of = np.searchsorted(opens, a, "right") - 1
    for d in np.unique(doc_of):
        k = int(np.searchsorted(base, d, "right")) - 1
        _, at, starts, ends, first, _ = parts[k]
        mine = doc_of == d
        s, e = a[mine] - opens[d] + first[d - base[k]], b[mine] - opens[d] + first[d - base[k]]
        out[d][1] = int((e - s).sum())
        out[d][3], out[d][4] = starts[s] - at[d - base[k]], ends[e - 1] - at[d - base[k]]
    pair = np.unique(np.stack([np.repeat(np.searchsorted(opens, pos, "right") - 1, np.diff(phrases.item_at)[which]), phrases.item_of[ts.ragged(phrases.item_at[which], np.diff(phrases.item_at)[which])]]), axis=1)
    for d in np.unique(pair[0]):
        out[d][2] = phrases.items[pair[1][pair[0] == d]]
    return out


def _joined(texts, old, new: list) -> list:
    """Results of two passes over the same rows: unions of items and spans, hit words counted anew."""
    out = []
    for t, n, items, starts, ends, got in zip(texts, *(c.to_pylist() for c in (old[0], old[2], old[3], old[4])), new, strict=True):
        if not starts:
            out.append(got)
            continue
        raw = np.frombuffer((t.as_py() or "").encode(), np.uint8)
        first, stop, _ = ts.words(raw, np.array([0, len(raw)]), ts.ALNUM)
        word = lambda x, more: np.searchsorted(first, np.r_[np.array(x, np.int64), more])
        a, b = ts.merged(word(starts, got[3]), word(ends, got[4]))
        out.append([n, int((b - a).sum()), np.union1d(np.array(items, np.int64), got[2]), first[a], stop[b - 1]])
    return out


def _mapper(box, shard_words: int, text_at: int, width: int, finish):
    """finish makes a batch of the rows (their first width columns) and what was found; further columns are of an earlier pass."""

    def run(batches):
        phrases = box.value
        parts, held, filled = [], [], 0
        top = len(phrases.words)

        def flush():
            got, at = _shard(parts, phrases), 0
            for batch in held:
                own = got[at : at + len(batch)]
                at += len(batch)
                if batch.num_columns > width:
                    own = _joined(batch.column(text_at), batch.columns[width:], own)
                yield finish(pa.RecordBatch.from_arrays(batch.columns[:width], names=batch.schema.names[:width]), own)
            parts.clear()
            held.clear()
            ts.give_back()

        for batch in batches:
            for i, j, data, at in ts.groups(batch.column(text_at)):
                starts, ends, first = ts.words(data, at, ts.ALNUM)
                h = ts.hashes(data, starts, ends, ts.BYTE_LOWER)
                ids = np.zeros(len(h), np.int32)
                if top and len(h):
                    k = np.minimum(np.searchsorted(phrases.words, h), top - 1)
                    ids = np.where(phrases.words[k] == h, k + 1, 0).astype(np.int32)
                parts.append((data, at, starts, ends, first, ids))
                held.append(batch.slice(i, j - i))
                filled += len(h)
                if filled >= shard_words:
                    yield from flush()
                    filled = 0
        if held:
            yield from flush()

    return run


def _added(batch, got):
    lists = [pa.array([g[k].tolist() for g in got], pa.list_(pa.int64())) for k in (2, 3, 4)]
    cols = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), *lists]
    return pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *ADDED])


def _cutter(text_at: int):
    def cut_out(batch, got):
        texts = batch.column(text_at)
        hit = [k for k, g in enumerate(got) if g[1]]
        if not hit:
            return batch
        new, stay = texts.to_pylist(), np.ones(len(batch), bool)
        for k in hit:
            raw, at, out = new[k].encode(), 0, []
            stay[k] = got[k][1] < got[k][0]
            for s, e in zip(got[k][3].tolist(), got[k][4].tolist(), strict=True):
                out.append(raw[at:s])
                at = e
            new[k] = b"".join([*out, raw[at:]]).decode()
        cols = [pa.array(new, texts.type) if i == text_at else c for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(cols, names=batch.schema.names).filter(pa.array(stay))

    return cut_out


ADDED = {"n_words": "long", "n_hit": "long", "items": "array<long>", "from_byte": "array<long>", "to_byte": "array<long>"}


def blocks_of(benchmark: DataFrame, limit: int):
    """The benchmark's (item, text) in blocks of at most limit bytes of text, one at a time on the driver; an empty one if there is none."""
    block, size = [], 0
    for item, text in benchmark.toLocalIterator():
        n = len((text or "").encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    yield block


def _passes(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, window: int, shard_words: int, block_bytes: int, last, last_schema: str) -> DataFrame:
    """docs (columns c0, c1, ...) through one pass a block of the benchmark; last finishes the last pass."""
    spark = docs.sparkSession
    importable(spark)
    rows = benchmark.select(F.col(item_col).cast("long"), F.col(item_text).cast("string")).where(F.col(item_col).isNotNull())
    blocks, width, at = blocks_of(rows, block_bytes), len(docs.columns), docs.columns.index(text_col)
    between = fields(docs) + "".join(f", {n} {t}" for n, t in ADDED.items())
    block, df = next(blocks), docs
    while True:
        following = next(blocks, None)
        box = spark.sparkContext.broadcast(Phrases(block, window))
        if following is None:
            return df.mapInArrow(_mapper(box, shard_words, at, width, last), last_schema)
        df = cut(df.mapInArrow(_mapper(box, shard_words, at, width, _added), between))
        box.destroy()
        block = following


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of docs with n_words, n_hit, items (sorted), and merged removal spans from_byte, to_byte (UTF-8).

    Each row of docs is judged by itself, so repeated rows give repeated results, and null ids don't matter. Null and empty texts have no
    words. Items that are null, or have no words, occur nowhere. Columns of docs with the added names are replaced. An empty
    benchmark leaves all clean; an empty table stays empty.
    """
    plain, names = plain_names(docs), docs.columns
    found = _passes(plain, benchmark, f"c{names.index(text_col)}", item_col, item_text, window, shard_words, block_bytes, _added, fields(plain) + "".join(f", {n} {t}" for n, t in ADDED.items()))
    return found.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n.lower() not in ADDED], *ADDED)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with all merged spans cut out of their texts; texts without a hit, null and empty ones are unchanged.

    A document all of whose words are hit goes. Columns of any names stay as they are.
    """
    plain, names = plain_names(docs), docs.columns
    at = names.index(text_col)
    return _passes(plain, benchmark, f"c{at}", item_col, item_text, window, shard_words, block_bytes, _cutter(at), fields(plain)).toDF(*names)


def op1(spark, sf_dir: str) -> DataFrame:
    """Contract query: whole documents against whole benchmark."""
    from folioflow.sources.tables import table

    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

"""Phrases whose words keep together, mined with pivot partitioning.

A phrase belongs to its rarest word, its pivot. Around each word of a text the fragment is cut out in which it is the rarest: it ends at a piece's
end, at a rarer word, at a word too rare to be in any phrase, and as many words away as a phrase can reach; to its left it ends at the
same word, too, so each occurrence of a phrase is in one fragment, that of its first pivot. Fragments are routed to their pivot and mined
there; a fragment yields only phrases that hold its pivot. A pivot of more than HOT occurrences is dealt in parts of about so many, whose counts are
added up afterwards. A task holds a block of whole parts.

How rare words are is read from a table of a fixed number of cells, which sums what hashes to a cell: a word may count for more common than it
is, never for less. So words are never wrongly dropped, and as all tasks hold the same table, a phrase has one pivot wherever it occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm import textscan as ts
from folioflow.llm.simhash import normal
from folioflow.session import cut, importable

LONGEST, LEAST, COVERED, TOP = 3, 10, 50, 2000
CELLS_LOG2 = 20
HOT = 100_000
SHARES = 64
BLOCK_BYTES = 4 << 20
CUTS = b".,;:!?\n\x0b\x0c\r"

CUT = np.zeros(256, bool)
CUT[list(CUTS)] = True
WORDY = ~CUT
WORDY[[0x20, 0x09]] = False
SPACED = np.ones(256, bool)
SPACED[0x20] = False

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"[.,;:!?\x0A-\x0D\x20\x09]+"


def _named(docs: DataFrame, text: str, lang: str, key: str) -> DataFrame:
    """lang, t, and a number that tells copies of a text apart, to deal hot words by."""
    own = F.xxhash64(*([key] if key in docs.columns else []), text)
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("t"), own.alias("seed")).where("t is not null")


def counted(own: DataFrame) -> DataFrame:
    """lang, word, f of all words of own (lang, t)."""
    return own.select("lang", F.explode(F.split(F.translate("t", UPPER, LOWER), SPLIT)).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f"))


def keys(langs: pa.Array, of: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Words' hashes made different for each language; of is the row of each word."""
    data, at = ts.flat(langs)
    return ts.mix(h ^ ts.hashes(data, at[:-1], at[1:])[of])


def _cells(batches):
    for batch in batches:
        data, at = ts.flat(batch.column(1))
        key = keys(batch.column(0), np.arange(len(batch)), ts.hashes(data, at[:-1], at[1:]))
        cell, own = np.unique(key >> ts.U64(64 - CELLS_LOG2), return_inverse=True)
        f = np.zeros(len(cell), np.int64)
        np.add.at(f, own, batch.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(f)], names=["cell", "f"])


def rarity(words: DataFrame) -> np.ndarray:
    """Occurrences by cell: 2 ** CELLS_LOG2 sums, however many words there are; this is all that the driver holds."""
    got = words.select("lang", "word", "f").mapInArrow(_cells, "cell long, f long").groupBy("cell").agg(F.sum("f").alias("f")).toArrow()
    out = np.zeros(1 << CELLS_LOG2, np.int64)
    out[got.column("cell").to_numpy()] = got.column("f").to_numpy()
    return out


def fragments(data, at, langs, common: np.ndarray, longest: int, least: int):
    """The normal text, and row, pivot's key, its occurrences and place, words before it in the fragment, first and last byte of every fragment of several words."""
    starts, _, first = ts.words(data, at, WORDY)
    text, begin, end, _ = normal(np.where(CUT[data], np.uint8(0x20), data), at)
    n = len(starts)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    flat = np.frombuffer(text, np.uint8)
    key = keys(langs, row, ts.hashes(flat, begin, end))
    f = common[key >> ts.U64(64 - CELLS_LOG2)]
    piece = np.cumsum(np.r_[False, CUT[data]])[starts] if n else np.zeros(0, np.int64)
    held = f >= least
    reach = []
    for way in (-1, 1):
        far, go = np.zeros(n, np.int64), held.copy()
        for d in range(1, longest):
            i = np.flatnonzero(go)
            j = i + way * d
            i, j = i[(j >= 0) & (j < n)], j[(j >= 0) & (j < n)]
            more = (f[j] > f[i]) | (f[j] == f[i]) & ((key[j] > key[i]) if way < 0 else (key[j] >= key[i]))
            on = i[(row[j] == row[i]) & (piece[j] == piece[i]) & held[j] & more]
            go = np.zeros(n, bool)
            go[on] = True
            far[on] = d
        reach.append(far)
    left, right = reach
    at_pivot = np.flatnonzero(left + right)
    left, right = left[at_pivot], right[at_pivot]
    a, b = at_pivot - left, at_pivot + right
    return flat, row[at_pivot], key[at_pivot], f[at_pivot], at_pivot - first[row[at_pivot]], left, begin[a], end[b]


def _strings(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    at = np.r_[0, np.cumsum(b - a)].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(a), [None, pa.py_buffer(at), pa.py_buffer(data[ts.ragged(a, b - a)])])


FRAGMENTS = "lang string, part int, split boolean, pos int, fragment string"


def _route(common, longest: int, least: int, hot: int):
    def run(batches):
        for batch in batches:
            seeds = batch.column(2).to_numpy().view(ts.U64)
            for i, j, data, at in ts.groups(batch.column(1)):
                langs = batch.column(0).slice(i, j - i)
                flat, row, key, f, place, left, a, b = fragments(data, at, langs, common.value, longest, least)
                salts = (f // hot + 1).astype(ts.U64)
                part = ts.mix(key + (ts.mix(seeds[i + row] + place.astype(ts.U64)) % salts) * ts.U64(0x9E3779B97F4A7C15)) >> ts.U64(32)
                for lo in range(0, len(row), 50_000):
                    s = slice(lo, lo + 50_000)
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(row[s])), pa.array(part[s].astype(np.uint32).view(np.int32)), pa.array(salts[s] > 1), pa.array(left[s], pa.int32()), _strings(flat, a[s], b[s])], names=["lang", "part", "split", "pos", "fragment"])

    return run


def counted_grams(langs: np.ndarray, part: np.ndarray, split: np.ndarray, pos: np.ndarray, data: np.ndarray, at: np.ndarray, longest: int, least: int):
    """row, first and last byte and occurrences of each phrase that holds its fragment's pivot; of parts that aren't split only those that occur least times.

    Phrases are brought together by a hash, and each is compared with its first, byte for byte; those unlike it are counted by themselves.
    """
    starts, ends, first = ts.words(data, at, SPACED)
    rolling, n_words = ts.Rolling(ts.hashes(data, starts, ends)), np.diff(first)
    found = []
    for n in range(2, longest + 1):
        for d in range(n):
            row = np.flatnonzero((pos >= d) & (pos - d + n <= n_words))
            s = first[row] + pos[row] - d
            found.append((row, starts[s], ends[s + n - 1], rolling.spans(s, s + n)))
    row, a, b, h = (np.concatenate(x) for x in zip(*found, strict=True))
    h = ts.mix(h + part[row].astype(np.int64).view(ts.U64))
    order = np.argsort(h, kind="stable")
    edge = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, np.int64)
    many = np.diff(np.r_[edge, len(h)])
    keep = (many >= least) | np.logical_or.reduceat(split[row[order]], edge) if len(h) else np.zeros(0, bool)
    order, many = order[np.repeat(keep, many)], many[keep]
    row, a, b = row[order], a[order], b[order]
    head = np.r_[0, np.cumsum(many)[:-1]].astype(np.int64) if len(many) else np.zeros(0, np.int64)
    of = np.repeat(head, many)
    same = (part[row] == part[row[of]]) & (langs[row] == langs[row[of]]) & (b - a == (b - a)[of])
    check = np.flatnonzero(same)
    same[check] = ts.alike(data, a[check], data, a[of[check]], (b - a)[check])
    count = np.add.reduceat(same.astype(np.int64), head) if len(head) else many
    others: dict[tuple, list] = {}
    for k in np.flatnonzero(~same).tolist():
        others.setdefault((langs[row[k]], part[row[k]], data[a[k] : b[k]].tobytes()), [k, 0])[1] += 1
    head = np.r_[head, np.array([k for k, _ in others.values()], np.int64)]
    count = np.r_[count, np.array([c for _, c in others.values()], np.int64)]
    fine = (count >= least) | split[row[head]]
    head = head[fine]
    return row[head], a[head], b[head], count[fine]


def _mine(longest: int, least: int):
    """Fragments come in order of their parts; a block of whole parts is mined at a time."""

    def mine(held):
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        lang = t.column("lang").combine_chunks().dictionary_encode()
        data, at = ts.flat(t.column("fragment"))
        data, at = data[at[0] : at[-1]], at - at[0]
        row, a, b, count = counted_grams(lang.indices.to_numpy(), *(t.column(c).to_numpy() for c in ("part", "split", "pos")), data, at, longest, least)
        for lo in range(0, len(row), 50_000):
            x = slice(lo, lo + 50_000)
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(lang.indices.take(pa.array(row[x]))), _strings(data, a[x], b[x]), pa.array(count[x], pa.int64())], names=["lang", "phrase", "a"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not len(batch):
                continue
            part = batch.column(1).to_numpy()
            # up to the last part that surely ends in this batch
            edge = np.flatnonzero(part[1:] != part[:-1]) + 1
            if held and held[-1].column(1)[len(held[-1]) - 1].as_py() != part[0]:
                edge = np.r_[0, edge]
            own = batch.column(4).nbytes
            if size + own >= BLOCK_BYTES and len(edge):
                held.append(batch.slice(0, edge[-1]))
                yield from mine([x for x in held if len(x)])
                held, size, batch = [], 0, batch.slice(edge[-1])
            held.append(batch)
            size += own
        yield from mine(held)

    return run


def mined(own: DataFrame, words: DataFrame, longest: int = LONGEST, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """lang, phrase, a (its occurrences) of all phrases of 2 to longest words of own (lang, t, seed) that occur least times; words as counted() gives them."""
    common = own.sparkSession.sparkContext.broadcast(rarity(words))
    routed = own.mapInArrow(_route(common, longest, least, hot), FRAGMENTS).repartition("part").sortWithinPartitions("part")
    local = routed.mapInArrow(_mine(longest, least), "lang string, phrase string, a long")
    return local.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def scored(phrases: DataFrame, words: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """phrases with l, r, score of the lowest-scoring cut; exact, in decimals of 38 digits."""
    w = F.split("phrase", " ")
    sides = lambda k: [F.struct(F.lit(k).alias("k"), F.lit(s).alias("right"), F.array_join(p, " ").alias("part")) for s, p in ((False, F.slice(w, 1, k)), (True, F.slice(w, k + 1, longest)))]
    parts = phrases.select("lang", "phrase", "a", F.explode(F.filter(F.array(*[x for k in range(1, longest) for x in sides(k)]), lambda x: x["part"] != "")).alias("s")).select("lang", "phrase", "a", "s.*")
    known = words.where(F.col("f") >= least).select("lang", F.col("word").alias("part"), "f").union(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    side = lambda right: F.max(F.when(F.col("right") == right, F.col("f")))
    cuts = parts.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(side(False).alias("l"), side(True).alias("r")).where("l is not null and r is not null")
    big = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    each = cuts.withColumn("score", F.expr(f"CAST(1000000 AS DECIMAL(7, 0)) * {big('a')} * {big('a')} DIV ({big('l')} * {big('r')})"))
    return each.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def uncovered(phrases: DataFrame, longest: int = LONGEST, covered: int = COVERED) -> DataFrame:
    """phrases without those that lie inside a longer one that occurs covered percent as often at least."""
    w = F.split("phrase", " ")
    inner = F.array(*[F.when(F.size(w) >= n + max(s, 1), F.array_join(F.slice(w, s + 1, n), " ")) for n in range(2, longest) for s in range(longest - n + 1)])
    within = phrases.where(F.size(w) > 2).select("lang", F.explode(F.array_compact(inner)).alias("phrase"), "a")
    most = within.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return phrases.join(most, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True))).drop("longer")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP, hot: int = HOT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's top phrases of 2 to longest words that occur least times.

    A text's pieces end at . , ; : ! ? and line ends, words at blanks and tabs; A-Z count as a-z. l and r are the occurrences of the two
    sides of the lowest-scoring cut, n of all words of the language. A null language is 'und'; null, empty and blank texts have no words; repeated
    rows count as often as they occur. Ties go by more occurrences, then by phrase. Columns beside text and lang play no part, whatever their
    names; key only spreads copies of a text. An empty table gives none.
    """
    importable(docs.sparkSession)
    own = _named(docs, text, lang, key)
    words = cut(counted(own))
    phrases = cut(mined(own, words, longest, least, hot))
    told = uncovered(scored(phrases, words, longest, least), longest, covered)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of a share of a language's phrases first, so that no task orders a language's whole list
    first = told.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    """Contract query: phrases of 2 to 3 words that occur ten times, the first 2,000 of each language."""
    from folioflow.sources.tables import table

    return collocations(table(spark, sf_dir, "documents"))

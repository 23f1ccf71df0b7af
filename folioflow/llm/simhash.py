"""Near-duplicate documents by fingerprints of their shingles and multi-index hashing.

A fingerprint has 64 bits; bit k is set if over half of a document's shingles have it set in their hash. Two fingerprints at a distance of at most
RADIUS = 3 bits agree in one of their two 32-bit segments to within one bit. So each segment's table is keyed by the segment, every fingerprint
looks up the ball of one bit around its own segments (a pair one bit apart is fetched once, from the side where the bit is clear), and what
it fetches is held to the complete distance.

Equal fingerprints are one entry. A table key with more than HOT entries isn't paired. Around the other segment of each of its entries a ball
of two bits is enumerated, around each prober's one bit: fingerprints that meet at a point with an entry within one bit of it are linked
with that entry, and each pair of at most RADIUS bits meets at such a point. A point is in 529 balls at most for each key, so no group grows with the data, no
pair is formed there, and no link between components is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import textscan as ts
from folioflow.llm.components import components
from folioflow.session import cut, importable

BITS, HALF, RADIUS = 64, 32, 3
SEED = 42
HOT = 64
CHUNK = 1 << 16


def normal(data: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words with one space between, starts and ends of the words in it, and the offset of each text's first word."""
    starts, ends, first = ts.words(data, at, ts.SOLID)
    size = ends - starts
    begin = np.r_[0, np.cumsum(size + 1)][:-1]
    out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    out[ts.ragged(begin, size)] = ts.LOWER[data[ts.ragged(starts, size)]]
    return out.tobytes(), begin, begin + size, first


def prints(data: np.ndarray, at: np.ndarray, size: int = 3) -> np.ndarray:
    """The fingerprint of every text; shingles are hashed a chunk at a time, however long a text is."""
    import xxhash

    text, begin, end, first = normal(data, at)
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    head = ts.ragged(first[:-1], count)
    tail = end[head + np.minimum(size, n[doc]) - 1]
    head = begin[head]
    held = np.zeros((len(n), BITS), np.int64)
    for lo in range(0, len(doc), CHUNK):
        hi = min(lo + CHUNK, len(doc))
        h = np.fromiter((xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(head[lo:hi].tolist(), tail[lo:hi].tolist(), strict=True)), "<u8", hi - lo)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = doc[lo:hi]
        edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        held[own[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    return np.packbits(2 * held > count[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) of every row; a text without words has fingerprint 0."""

    def run(batches):
        for batch in batches:
            for i, j, data, at in ts.groups(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(prints(data, at, size).view(np.int64))], names=["doc_id", "fp"])

    importable(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, fp long")


def _ball(bits: int, width: int = HALF) -> list[int]:
    """All masks of exactly so many of width bits."""
    return [sum(1 << b for b in c) for c in combinations(range(width), bits)]


def _masks(masks: list[int]):
    return F.explode(F.lit(np.array(masks, np.int64)) if len(masks) > 64 else F.array(*[F.lit(m).cast("long") for m in masks]))


def _segment(i: int):
    return F.shiftrightunsigned("fp", HALF) if i == 0 else F.col("fp").bitwiseAND((1 << HALF) - 1)


def near(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """a, b: links between different fingerprints (distinct, column fp) at a distance of at most RADIUS bits.

    All of them where a table key has at most hot entries; at other keys so many that the same fingerprints are connected.
    """
    table = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _segment(i).alias("v")) for i in (0, 1)])).alias("s")).select("s.*", "fp")
    probes = table.select("i", "v", "fp", _masks([0, *_ball(1)]).alias("m")).where("m = 0 or v & m = 0").select("i", F.expr("v | m").alias("v"), "fp", (F.col("m") != 0).alias("far"))
    # sizes after an explode are guessed far too small, so no side of it may be broadcast unmeasured
    probes = probes.hint("merge")
    often = cut(table.groupBy("i", "v").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > hot).select("i", "v"))
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    fetched = table.join(often, ["i", "v"], "left_anti").withColumnRenamed("fp", "b").join(probes.withColumnRenamed("fp", "a"), ["i", "v"])
    links = fetched.where((F.col("far") | (F.col("a") < F.col("b"))) & (distance <= RADIUS)).select("a", "b")
    # hot keys: an entry reaches points two bits off its other segment, a prober points one bit off; "inner" are entries within one bit
    rest = F.when(F.col("i") == 0, _segment(1)).otherwise(_segment(0))
    entries, probing = table.join(often, ["i", "v"], "left_semi"), probes.where("far").join(often, ["i", "v"], "left_semi")
    close, wide = [0, *_ball(1)], _ball(2)
    point = lambda df, masks, inner: df.select("i", "v", "fp", rest.alias("r"), _masks(masks).alias("m")).select("i", "v", F.expr("r ^ m").alias("x"), "fp", F.lit(inner).alias("inner"))
    reached = point(entries, close, True).union(point(entries, wide, False)).union(point(probing, close, False))
    met = reached.groupBy("i", "v", "x").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("a"), F.collect_set("fp").alias("others")).where("a is not null and size(others) > 1")
    stars = met.select("a", F.explode("others").alias("b")).where((F.col("a") != F.col("b")) & (distance <= RADIUS))
    return links.union(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id (smallest id reachable over links, itself included) for every row of docs.

    Words are runs without blanks, A-Z lower-cased; a text of fewer words than a shingle is one shingle, one without words (null, empty, blank) has
    fingerprint 0 and is linked like any other. Rows with a null id have a fingerprint but no component, and link nothing. Repeated
    rows share their component; of rows with one id and several texts each has its own text's. Columns beside key and text play no part, whatever their
    names. An empty table gives none.
    """
    signed = cut(fingerprints(docs, key, text, size))
    entries = cut(signed.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(cut(near(entries.select("fp"), hot)))
    named = entries.join(labels, entries["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    low = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = named.join(low, "label").select("fp", "component_id")
    return signed.join(of, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op12(spark, sf_dir: str) -> DataFrame:
    """Contract query: three-word shingles, three bits."""
    from folioflow.sources.tables import table

    got = link(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

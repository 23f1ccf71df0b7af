"""Near-duplicate documents by min-max hashing.

A document's set is its distinct word shingles. Under each of PERMUTATIONS permutations both the smallest and the largest value are kept, so
every evaluation gives two values of the signature; a band takes both of two permutations. Documents with equal sets are one
class first (fingerprints of 128 bits and the size). Classes that share a band are candidates, and links are confirmed on full sets:

1. In each band each member is held against the bucket's pivot (its smallest member; in a second round another
   one), if they aren't in one component yet: a bucket of n members gives n - 1 pairs, never all.
2. Members of buckets that still have several components are joined by their rare shingles, a prefix of each set, which finds every link
   among them. So every pair of candidates is compared or already connected, no link is lost or capped, and no bucket is squared.

32 bands of four values miss a pair of similarity 0.8 with a probability of 5e-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm import textscan as ts
from folioflow.llm.components import components
from folioflow.session import cut, importable

PERMUTATIONS, BANDS = 64, 32
SIMILARITY = 80
LONE = ts.U64(0x5851F42D4C957F2D)


def shingles(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted in each, and the offset of each text's first."""
    starts, ends, first = ts.words(data, at, ts.SOLID)
    h = ts.hashes(data, starts, ends, ts.BYTE_LOWER)
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    if not len(doc):
        return np.zeros(0, ts.U64), np.zeros(len(at), np.int64)
    r = ts.Rolling(h)
    begin = ts.ragged(first[:-1], count)
    length = np.where(n >= size, size, n)[doc]
    x = r.spans(begin, begin + length)
    x = np.where(length < size, ts.mix(x ^ LONE), x)
    order = np.argsort(x)
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    x, doc = x[order], doc[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])]
    x, doc = x[new], doc[new]
    return x, np.searchsorted(doc, np.arange(len(n) + 1))


A = ts.seeded(PERMUTATIONS, 101)
B = ts.seeded(PERMUTATIONS, 202)


def bands(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BANDS hashes of every set; sets are not empty."""
    per = PERMUTATIONS // BANDS
    heads, out = first[:-1], np.empty((len(first) - 1, BANDS), ts.U64)
    for b in range(BANDS):
        key = np.full(len(heads), ts.U64(b + 1))
        for j in range(b * per, (b + 1) * per):
            v = x * A[j] + B[j]
            key = ts.mix(key * ts.U64(0x9E3779B97F4A7C15) + np.minimum.reduceat(v, heads))
            key = ts.mix(key * ts.U64(0x9E3779B97F4A7C15) + np.maximum.reduceat(v, heads))
        out[:, b] = key
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _lists(flat: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), _signed(np.ascontiguousarray(flat)))


def _signer(size: int):
    def run(batches):
        for batch in batches:
            for i, j, data, at in ts.groups(batch.column(2)):
                x, first = shingles(data, at, size)
                n = np.diff(first)
                full = n > 0
                f1, f2, sig = np.zeros(j - i, ts.U64), np.zeros(j - i, ts.U64), np.zeros((0, BANDS), ts.U64)
                if full.any():
                    heads = first[:-1][full]
                    f1[full] = np.add.reduceat(ts.mix(x), heads)
                    f2[full] = np.add.reduceat(ts.mix(x ^ LONE), heads)
                    sig = bands(x, np.r_[heads, len(x)])
                at_sig = np.r_[0, np.cumsum(full * BANDS)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int64()), _signed(f1), _signed(f2), _lists(sig.ravel(), at_sig)], names=["doc_id", "h", "n", "f1", "f2", "bands"])

    return run


def _setter(size: int):
    """Sets of documents; of equal rows one after the other only the first gives one."""

    def run(batches):
        last = None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, data, at in ts.groups(batch.column(1)):
                x, first = shingles(data, at, size)
                new = np.r_[ids[i] != last, ids[i + 1 : j] != ids[i : j - 1]]
                last = ids[j - 1]
                if not new.all():
                    x, n = x[np.repeat(new, np.diff(first))], np.diff(first)[new]
                    first = np.r_[0, np.cumsum(n)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][new]), _lists(x, first)], names=["doc_id", "s"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    a, b = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").where(100 * both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _residual(members: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """All links between members of buckets that still hold several components; members: band, node, n (its set's size), label.

    An exact join by prefixes: with shingles in order of how many of these documents have them, rarest first, two linked sets share one among the
    first n - ceil(similarity of n) + 1 of each. So documents meet at their rare shingles only, whatever bucket they are in: one that has enough shingles of
    its own meets none, and no bucket is squared. Sizes and places bound the overlap before a pair is made, and pairs are confirmed on full sets.
    """
    mixed = members.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band")
    nodes = members.join(mixed, "band", "left_semi").select("node", "n", "label").distinct()
    held = cut(nodes.join(sets.withColumnRenamed("doc_id", "node"), "node").select("node", "n", "label", F.explode("s").alias("x")))
    often = held.groupBy("x").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = held.join(often, "x").groupBy("node", "n", "label").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("xs"))
    alone = F.col("n") - F.size("xs")  # shingles that no other document has come first
    first = F.col("n") - F.ceil(F.col("n") * similarity / 100) + 1
    listed = ordered.withColumn("alone", alone).withColumn("q", first - alone).where("q > 0")
    prefix = listed.select("node", "n", "label", "alone", F.posexplode(F.slice("xs", F.lit(1), F.col("q").cast("int"))).alias("i", "e")).select("node", "n", "label", (F.col("n") - F.col("alone") - F.col("i")).alias("rest"), F.col("e.x").alias("x"))
    several = prefix.groupBy("x").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("x")
    rows = cut(prefix.join(several, "x", "left_semi"))
    a, b = (rows.select("x", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "label", "rest")]) for k in "ab")
    most = F.least("rest_a", "rest_b")  # of shared shingles, from this one on
    fits = (100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")) & (100 * most >= similarity * (F.col("n_a") + F.col("n_b") - most))
    # a pair meets at its first shared shingle with the bound intact; later ones may fall short of it
    pairs = a.join(b, "x").where((F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & fits)
    return _confirmed(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), sets, similarity)


def standing(text: str):
    """Of rows that share an id, the one with the least of this stands for all: one with words first, then by a hash of the text."""
    return F.struct((~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).alias("blank"), F.xxhash64(text).alias("h"))


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Links join documents whose sets have 100 * intersection >= similarity * union. Null, empty and blank texts have no
    shingles and link with nothing; a text of fewer words than a shingle is one shingle of its own kind. Rows with a null id link with nothing, have no
    component and are kept. Repeated rows share their component; of rows with one id and several texts standing() says which is
    linked, and the others with words share its component. Columns beside key and text play no part. An empty table gives none.
    """
    spark = docs.sparkSession
    importable(spark)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    signed = cut(own.mapInArrow(_signer(size), "doc_id long, h long, n long, f1 long, f2 long, bands array<long>"))
    real = signed.where("n > 0 and doc_id is not null")
    one = real.groupBy("doc_id").agg(F.min_by(F.struct("h", "n", "f1", "f2", "bands"), "h").alias("r")).select("doc_id", "r.*")
    classes = cut(one.groupBy("n", "f1", "f2").agg(F.min_by(F.struct("doc_id", "h", "bands"), "doc_id").alias("r")).select("n", "f1", "f2", F.col("r.doc_id").alias("rep"), "r.h", "r.bands"))
    members = classes.select(F.explode("bands").alias("band"), F.col("rep").alias("node"), "n", "h")
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("first"), F.max_by("node", F.xxhash64("node")).alias("second")).where("k > 1").drop("k")
    members = cut(members.join(shared, "band"))
    wanted = members.select(F.col("node").alias("doc_id"), "h").distinct()
    sets = cut(own.where("doc_id is not null").join(wanted, ["doc_id", "h"], "left_semi").select("doc_id", "t").mapInArrow(_setter(size), "doc_id long, s array<long>"))
    links = cut(_confirmed(members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), sets, similarity))
    labels = components(links)
    named = lambda: members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    again = named().join(labels.select(F.col("node").alias("second"), F.col("label").alias("other")), "second", "left").where("label <> coalesce(other, second)")
    more = cut(_confirmed(again.select(F.least("node", "second").alias("a"), F.greatest("node", "second").alias("b")).distinct(), sets, similarity))
    if more.limit(1).count():
        links = links.union(more)
        labels = components(links)
    rest = cut(_residual(named().select("band", "node", "n", "label"), sets, similarity))
    if rest.limit(1).count():
        labels = components(links.union(rest))
    of = classes.select("n", "f1", "f2", "rep").join(labels, classes.rep == labels.node, "left").select("n", "f1", "f2", F.coalesce("label", "rep").alias("label"))
    own_label = one.select("doc_id", "n", "f1", "f2").join(of, ["n", "f1", "f2"]).select("doc_id", "label")
    done = signed.select("doc_id", "n").join(own_label, "doc_id", "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("label"))).otherwise(F.col("doc_id"))
    return done.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10(spark, sf_dir: str) -> DataFrame:
    """Contract query: two-word shingles."""
    from folioflow.sources.tables import table

    return link(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)

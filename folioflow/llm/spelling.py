"""Groups of words that are spelling variants of each other: one code point inserted, deleted or replaced.

Such a change leaves one half of a word as it is: the first, at the start of the other word, or the second, at its end. Aho-Corasick automata
hold the halves. They come in shards, by the three outer code points of a half (two where it has no more), in blocks of at most BLOCK words;
a word is scanned by the shards of its own two ends. Second halves are kept as first halves of the mirrored words.

A half found at offset 0 in a word of fitting length is a candidate, and the distance is verified. A half that more than FEW words of a shard share
is not paired with all of them: as the change is in one half of what remains, too, either a longer head is found at offset 0 or the head and
the word's last piece both are.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import cut, importable

RUN = r"[A-Za-zÀ-ÿ]+"
SLIP = 97
LETTERS, TIMES, RATIO = 5, 3, 2
EDGE = 3
BLOCK, FEW, BATCH = 20_000, 8, 10_000


def occurring(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int = SLIP, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """word, n: words of letters code points at least that occur times at least, A-Z lower-cased; a run whose checksum slip divides loses a code point."""
    low = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run")).select("id", low.alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    place = F.col("h") % F.length("run")
    word = F.when(F.col("h") % slip != 0, F.col("run")).otherwise(F.concat(F.substring("run", F.lit(1), place.cast("int")), F.substring("run", (place + 2).cast("int"), F.length("run"))))
    return hashed.select(word.alias("word")).where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


def half(size: int, mirrored: bool) -> int:
    return size - size // 2 if mirrored else size // 2


def one_change(a: str, b: str) -> bool:
    """Whether exactly one code point inserted, deleted or replaced makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k, n = 0, len(a)
    while k < n and a[k] == b[k]:
        k += 1
    if len(a) < len(b):
        return a[k:] == b[k + 1 :]
    return k < n and a[k + 1 :] == b[k + 1 :]


class Shard:
    """The halves of some words in one automaton; mirrored words if so said."""

    def __init__(self, words: list, mirrored: bool, few: int = FEW):
        import ahocorasick

        self.mirrored = mirrored
        by: dict[str, list] = {}
        for w, n in words:
            by.setdefault(w[: half(len(w), mirrored)], []).append((w, n))
        #: heads with their words; heads that many share; words by a longer head; words by such a head and their last piece
        self.heads = {h: ws for h, ws in by.items() if len(ws) <= few}
        self.shared = {h for h, ws in by.items() if len(ws) > few}
        self.longer: dict[str, list] = {}
        self.ended: dict[tuple, list] = {}
        for h in self.shared:
            for w, n in by[h]:
                mid = (len(h) + len(w)) // 2
                self.longer.setdefault(w[:mid], []).append((w, n))
                self.ended.setdefault((h, w[mid:]), []).append((w, n))
        self.tails = {t for _, t in self.ended}
        self.automaton = ahocorasick.Automaton()
        for p in {*by, *self.longer, *self.tails}:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()

    def near(self, u: str):
        """Each word with its n that one change makes of u, once, unless the other kind of shard finds it."""
        if not len(self.automaton):  # a block that no word was dealt to
            return
        heads, tails, size = [], [], len(u)
        for end, p in self.automaton.iter(u):
            if end + 1 == len(p):  # at offset 0
                if p in self.shared:
                    heads.append(p)
                for w, n in (*self.heads.get(p, ()), *self.longer.get(p, ())):
                    if self._fits(w, size) and one_change(w[len(p) :], u[len(p) :]) and not self._other(w, u):
                        yield w, n
            if end + 1 == size and p in self.tails:
                tails.append(p)
        for h in heads:
            for t in tails:
                for w, n in self.ended.get((h, t), ()):
                    if self._fits(w, size) and not u.startswith(w[: (len(h) + len(w)) // 2]) and one_change(w[len(h) :], u[len(h) :]) and not self._other(w, u):
                        yield w, n

    def _fits(self, w: str, size: int) -> bool:
        return -1 <= len(w) - size <= 1

    def _other(self, w: str, u: str) -> bool:
        """Both halves of w are in place in u; the unmirrored shard tells."""
        return self.mirrored and u.endswith(w[half(len(w), True) :])


def _scan(few: int):
    def run(batches):
        now, words, shard, out = None, [], None, []
        for batch in batches:
            for mirrored, edge, block, scanned, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (mirrored, edge, block) != now:
                    now, words, shard = (mirrored, edge, block), [], None
                if not scanned:
                    words.append((w, n))
                    continue
                if shard is None:
                    shard = Shard(words, mirrored, few)
                count, best = 0, None
                for v, m in shard.near(w):
                    v = v[::-1] if mirrored else v
                    count += 1
                    if best is None or m > best[1] or m == best[1] and v < best[0]:
                        best = (v, m)
                if count:
                    out.append((w[::-1] if mirrored else w, count, *best))
                if len(out) >= BATCH:
                    yield _told(out)
                    out = []
        yield _told(out)

    return run


FOUND = pa.schema([("word", pa.string()), ("k", pa.int64()), ("form", pa.string()), ("m", pa.int64())])


def _told(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(FOUND.types)], schema=FOUND)


def near(words: DataFrame, letters: int = LETTERS, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """word, n_near, form, form_n (the near word of largest n, ties to the smallest) of words (word, n) that have near words.

    Words are distinct and have letters (4 at least) code points at least. block and few bound a shard's words and the words of one half; the result is the same.
    """
    importable(words.sparkSession)
    spelt = words.select(F.explode(F.array(F.struct(F.lit(False).alias("mirrored"), F.col("word").alias("w")), F.struct(F.lit(True).alias("mirrored"), F.reverse("word").alias("w")))).alias("s"), "n").select("s.*", "n")
    size = lambda n: F.least(F.lit(EDGE), F.when(F.col("mirrored"), n - F.floor(n / 2)).otherwise(F.floor(n / 2)))
    edge = lambda n: F.substring("w", F.lit(1), size(n).cast("int"))
    length = F.length("w")
    held = spelt.select("mirrored", edge(length).alias("edge"), "w", "n")
    blocks = cut(held.groupBy("mirrored", "edge").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")))
    # the halves that a word may hold are those of words one shorter to one longer
    ends = F.array_distinct(F.array(*[edge(F.greatest(F.lit(letters), length + d)) for d in (-1, 0, 1)]))
    scanned = spelt.select("mirrored", F.explode(ends).alias("edge"), "w", "n")
    halves = held.join(blocks, ["mirrored", "edge"]).select("mirrored", "edge", F.pmod(F.xxhash64("w"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("scanned"), "w", "n")
    texts = scanned.join(blocks, ["mirrored", "edge"]).select("mirrored", "edge", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("scanned"), "w", "n")
    shards = halves.union(texts).repartition("mirrored", "edge", "block").sortWithinPartitions("mirrored", "edge", "block", "scanned")
    found = shards.mapInArrow(_scan(few), "word string, k long, form string, m long")
    first = F.min_by(F.struct("form", "m"), F.struct((-F.col("m")).alias("m"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), first.alias("f")).select("word", "n_near", F.col("f.form").alias("form"), F.col("f.m").alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form), form never null and without cycles: the last word that forms lead to. Ways are halved in each round."""
    ways = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = cut(ways.select("word", "root").join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not ways.where("moved").limit(1).count():
            return ways.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = RATIO, slip: int = SLIP, letters: int = LETTERS, times: int = TIMES, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs.

    A word's form is its near word of largest n (ties: the smallest), if that n is ratio times its own at least, else null; its root is the last
    word that forms lead to, or itself. Null and empty texts have no words; repeated rows count as often as they occur; a null id counts as
    an empty one in the checksum. Columns beside key and text play no part, whatever their names. An empty table gives none.
    """
    words = cut(occurring(docs, key, text, slip, letters, times))
    by = near(words, letters, **options)
    told = cut(words.join(by, "word", "left").withColumn("same", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))))
    told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("same"), F.col("form")).alias("form"), F.when(F.col("same"), F.col("form_n")).alias("form_n"))
    last = roots(told.where("form is not null"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark, sf_dir: str) -> DataFrame:
    """Contract query: words of five code points that occur three times."""
    from folioflow.sources.tables import table

    return variants(table(spark, sf_dir, "documents"))

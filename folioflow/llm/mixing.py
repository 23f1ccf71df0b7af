"""Mixing sources to target weights by min-cost flow over membership patterns.

1. Documents are aggregated by membership pattern (the set of sources that hold them): words and rows per pattern. The
   patterns go to the driver. Of more than MAX_PATTERNS those with the most words stay as they are; a document of any other one
   counts for one of its sources, picked by a hash, so what the driver holds grows with the number of sources only.
2. Each source's target is its weight's share of all words, at most max_repeat times what it holds; the excess is
   shared again by weight until no target is above.
3. A flow routes words from patterns to quotas: start -> pattern by max_repeat arcs of the pattern's size, the r-th of
   cost r (so the first use is free and each further one dearer: convex), pattern -> its sources, source -> end with the
   target as capacity. Costs stand on the first arcs only, so cheapest paths of cost r are those through a pattern's r-th arc: a largest flow
   by layered blocking flows for each r in turn is the largest flow of the least cost.
4. A pattern with flow f takes each document f // size times, and once more the documents whose seeded hash lies below a
   threshold; those in the cell at the threshold in part. The threshold is found by three rounds of histograms of 256 cells, so no document is sorted and no
   group of documents meets in one task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.session import cut, importable, quoted

MAX_PATTERNS = 100_000  # also bounds what is broadcast
WORDS = r"[^\x20\x09-\x0D]+"
SEED = 20240607
BITS, LEVELS = 8, 3


def cycle_weights(n: int) -> list[float]:
    return [1.0 + i % 3 for i in range(n)]


def targets(sizes: list[int], weights: list[float], max_repeat: int) -> list[float]:
    """Shares of sum(sizes) by weight, none above max_repeat times its size."""
    total, out, live = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    while live:
        w = sum(weights[i] for i in live)
        share = {i: total * weights[i] / w for i in live}
        over = [i for i in live if share[i] > max_repeat * sizes[i]]
        if not over:
            for i in live:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(max_repeat * sizes[i])
            total -= out[i]
        live = [i for i in live if i not in set(over)]
    return out


class Flow:
    """Largest flow by blocking flows over layers; run() goes on from the flow so far."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for u, v, r in ((a, b, room), (b, a, 0)):
            self.arcs[u].append(len(self.to))
            self.to.append(v)
            self.room.append(r)
        return len(self.to) - 2

    def _layers(self, s: int, t: int) -> list[int]:
        layer = [-1] * len(self.arcs)
        layer[s], front = 0, [s]
        while front and layer[t] < 0:
            reached = []
            for u in front:
                for e in self.arcs[u]:
                    if self.room[e] and layer[self.to[e]] < 0:
                        layer[self.to[e]] = layer[u] + 1
                        reached.append(self.to[e])
            front = reached
        return layer

    def run(self, s: int, t: int) -> None:
        to, room = self.to, self.room
        while (layer := self._layers(s, t))[t] >= 0:
            tried, path, u = [0] * len(self.arcs), [], s
            while True:
                if u == t:
                    most = min(room[e] for e in path)
                    for e in path:
                        room[e] -= most
                        room[e ^ 1] += most
                    k = next(i for i, e in enumerate(path) if not room[e])
                    u = to[path[k] ^ 1]
                    del path[k:]
                    continue
                own, i = self.arcs[u], tried[u]
                while i < len(own) and not (room[own[i]] and layer[to[own[i]]] == layer[u] + 1):
                    i += 1
                tried[u] = i
                if i < len(own):
                    path.append(own[i])
                    u = to[own[i]]
                elif path:
                    u = to[path.pop() ^ 1]
                    tried[u] += 1
                else:
                    break


def route(patterns: list[tuple[frozenset, int]], quotas: dict, max_repeat: int) -> list[dict]:
    """For each pattern (its sources and words), the words that it gives to each of its sources."""
    names = list(quotas)
    flow = Flow(2 + len(patterns) + len(names))
    to, arcs, opened = {x: 2 + len(patterns) + i for i, x in enumerate(names)}, [], []
    for i, (members, words) in enumerate(patterns):
        opened.append(flow.arc(0, 2 + i, 0))
        arcs.append({x: flow.arc(2 + i, to[x], words * max_repeat) for x in sorted(members, key=lambda x: to[x])})
    for x in names:
        flow.arc(to[x], 1, round(quotas[x]))
    for _ in range(max_repeat):  # the r-th use of all patterns, cheaper ones first
        for e, (_, words) in zip(opened, patterns, strict=True):
            flow.room[e] += words
        flow.run(0, 1)
    return [{x: flow.room[e ^ 1] for x, e in own.items()} for own in arcs]


def mix(docs: DataFrame, members: Column, text: str = "text", key: str = "doc_id", weights=cycle_weights, max_repeat: int = 3, seed: int = SEED, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """All columns of docs with _size, _source_size and _target (maps by source, a name quoted as JSON), _times, how often
    a row is taken whole, and _part, how many of its words are taken once more (only at the threshold of its pattern).

    members is an array of sources; null in it is a source of its own, the last in order. Null and empty texts have size 0 and
    are taken 0 words. Rows alike in key and text share their fate, null keys included. Columns of docs with the added names are replaced. An empty
    table stays empty.
    """
    spark = docs.sparkSession
    importable(spark)
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")
    held = F.array_sort(F.array_distinct(F.coalesce(members, F.array(F.lit(None).cast("string")))))
    said = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))
    cell = F.conv(F.substring(F.md5(said), 1, BITS * LEVELS // 4), 16, 10).cast("long")
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), held.alias("m"), size.alias("n"), cell.alias("c"))
    rows = rows.withColumn("p", F.to_json("m"))
    sums = rows.groupBy("p", "m").agg(F.sum("n").alias("n"))
    if sums.limit(max_patterns + 1).count() > max_patterns:
        top = cut(sums.orderBy(F.desc("n"), "p").limit(max_patterns).select("p", F.lit(True).alias("top")))
        one = F.to_json(F.array(F.array_min(F.transform("m", lambda x: F.struct(F.xxhash64(F.lit(seed), x).alias("h"), x.alias("x"))))["x"]))
        rows = rows.join(F.broadcast(top), "p", "left").withColumn("p", F.when(F.col("top"), F.col("p")).otherwise(one))
    small = cut(rows.select("p", "n", "c"))
    found = sorted(small.groupBy("p").agg(F.sum("n").alias("n")).collect(), key=lambda r: r.p)
    patterns = [(frozenset(json.loads(r.p)), r.n) for r in found]
    names = sorted({x for m, _ in patterns for x in m}, key=lambda x: (x is None, x or ""))
    of = dict.fromkeys(names, 0)
    for m, n in patterns:
        for x in m:
            of[x] += n
    sizes = [of[x] for x in names]
    quota = dict(zip(names, targets_of(sizes, [n for _, n in patterns], weights(len(names)), max_repeat), strict=True))
    routed = [sum(x.values()) for x in route(patterns, quota, max_repeat)]
    plan = {}
    for r, f in zip(found, routed, strict=True):
        times, rest = divmod(f, r.n) if r.n else (0, 0)
        plan[r.p] = [times, rest, 0, 0, 0.0]  # times, words still to take, the threshold's leading bits, words below it, share of the cell at it
    bounded = F.broadcast if len(plan) <= 2 * max_patterns else lambda x: x
    for level in range(1, LEVELS + 1):
        live = {p: v[2] for p, v in plan.items() if v[1]}
        if not live:
            break
        shift = BITS * (LEVELS - level)
        here = spark.createDataFrame([(p, t) for p, t in live.items()], "p string, top long")
        cells = small.join(bounded(here), "p").where(F.shiftright("c", shift + BITS) == F.col("top"))
        got: dict[str, dict[int, int]] = {}
        for row in cells.groupBy("p", F.shiftright("c", shift).alias("k")).agg(F.sum("n").alias("n")).collect():
            got.setdefault(row.p, {})[row.k] = row.n
        for p, top in live.items():
            _, rest, _, below, _ = plan[p]
            n = 0
            k = top << BITS
            for k in range(top << BITS, (top + 1) << BITS):
                n = got.get(p, {}).get(k, 0)
                if below + n > rest:
                    break
                below += n
            plan[p][2:] = [k, below, (rest - below) / n if n else 0.0]
    said_of = {x: (json.dumps({json.dumps(x): of[x]})[1:-1], json.dumps({json.dumps(x): quota[x]})[1:-1]) for x in names}
    maps = lambda p, i: "{" + ",".join(said_of[x][i] for x in json.loads(p)) + "}"
    by = [(p, v[0], v[2] if v[1] else 0, v[4] if v[1] else 0.0, maps(p, 0), maps(p, 1)) for p, v in plan.items()]
    table = spark.createDataFrame(by, "p string, often long, under long, f double, s string, t string")
    added = {
        "_size": F.col("n"),
        "_source_size": F.from_json("s", "map<string,long>"),
        "_target": F.from_json("t", "map<string,double>"),
        "_times": F.when(F.col("n") > 0, F.col("often") + (F.col("c") < F.col("under")).cast("long")).otherwise(F.lit(0)).cast("long"),
        "_part": F.when(F.col("c") == F.col("under"), F.floor(F.col("n") * F.col("f"))).otherwise(F.lit(0)).cast("long"),
    }
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in added]
    return rows.join(bounded(table), "p", "left").select(*kept, *[v.alias(k) for k, v in added.items()])


def targets_of(sizes: list[int], pattern_sizes: list[int], weights: list[float], max_repeat: int) -> list[float]:
    """Targets share the words of all documents; with overlapping sources that is less than the sum of what sources hold."""
    total = sum(pattern_sizes)
    if total == sum(sizes):
        return targets(sizes, weights, max_repeat)
    k = total / max(1, sum(sizes))
    scaled = targets([s * k for s in sizes], weights, max_repeat)
    return [min(t, max_repeat * s) for t, s in zip(scaled, sizes, strict=True)]


def op3(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document has one source."""
    from folioflow.sources.tables import table

    got = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), F.array("source"))
    one = lambda c: F.element_at(F.map_values(c), 1)
    return got.select("doc_id", F.col("_size").alias("size"), one("_source_size").alias("source_size"), one("_target").alias("target"), (F.col("_size") * F.col("_times") + F.col("_part")).alias("taken"))

"""Graph reads: edges both ways, entity lists and details, links, traceability; every OR-join is a union of equi joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def both_ways(edges: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """node, other, direction for every edge, seen from each end."""
    out = edges.select(F.col(a).alias("node"), F.col(b).alias("other"), F.lit("outgoing").alias("direction"))
    return out.unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"), F.lit("incoming").alias("direction")))


def endpoints(edges: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """All nodes of edges once (UNION, not UNION ALL)."""
    return edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).distinct()


def linked_decisions(requirements: DataFrame, decisions: DataFrame, links: DataFrame) -> DataFrame:
    """requirement_id, decision_id: decisions of the requirement's version, or of a document linked from it; all accepted ones where the
    requirement has no version. requirements (requirement_id, version), decisions (decision_id, version, document), links (version, document).
    """
    own = requirements.where("version is not null").join(decisions.select("decision_id", "version"), "version").select("requirement_id", "decision_id")
    via = requirements.join(links, "version").join(decisions.select("decision_id", "document"), "document").select("requirement_id", "decision_id")
    loose = requirements.where("version is null").select("requirement_id").crossJoin(decisions.select("decision_id"))  # their answer is every pair
    return own.union(via).distinct().union(loose)


def entity_list(entities: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities with a mention or an edge, and how often they are mentioned; most first."""
    live = mentions.select("entity").union(endpoints(edges).select(F.col("node").alias("entity"))).distinct()
    counts = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"))
    return entities.join(live, "entity", "left_semi").join(counts, "entity", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))


def entity_detail(entities: DataFrame, mentions: DataFrame, edges: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the wanted entities (entity): themselves with how often they are mentioned, their mentions, and their edges both ways with the other end's name.

    Rows, not lists, so that an entity may have any number of them. entities (entity, kind, name), mentions (entity, ...), edges (source, target, kind).
    """
    own = wanted.select("entity").distinct()
    said = mentions.join(own, "entity", "left_semi")
    counts = said.groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"))
    heads = entities.join(own, "entity", "left_semi").join(counts, "entity", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    ways = edges.select(F.col("source").alias("entity"), F.col("target").alias("other"), "kind", F.lit("outgoing").alias("direction")).unionByName(edges.select(F.col("target").alias("entity"), F.col("source").alias("other"), "kind", F.lit("incoming").alias("direction")))
    named = entities.select(F.col("entity").alias("other"), F.col("name").alias("other_name"))
    return heads, said, ways.join(own, "entity", "left_semi").join(named, "other", "left").select("entity", "direction", "kind", "other", "other_name")


def broken_links(links: DataFrame, paths: DataFrame, target: str = "target") -> DataFrame:
    return links.join(paths.select(F.col("path").alias(target)), target, "left_anti")


def folder_tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """Every folder above any path, once."""
    parts = F.split(path, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    return paths.select(F.explode(above).alias("folder")).distinct()


def overlaps(spans: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Pairs of spans (span_id, key, a, b) and chunks (chunk, key, start, stop) of a key that share places, with shared, how many.

    A chunk stands in one bin: at the level of the smallest power of two that it isn't longer than, by its start. A span looks in the bins of each
    level in which chunks that reach it can start; so each pair meets once, whatever the lengths, and a long document is many keys. Empty intervals and null
    keys share nothing.
    """
    level = F.length(F.bin(F.col("stop") - F.col("start") - 1))
    binned = chunks.where("stop > start").withColumn("_level", level).withColumn("_bin", F.expr("shiftright(start, _level)"))
    levels = sorted(r[0] for r in binned.select("_level").distinct().collect())  # 63 at most
    looked = spans.where("b > a").withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    asked = looked.withColumn("_bin", F.explode(F.expr("sequence(shiftright(a, _level) - 1, shiftright(b - 1, _level))")))
    shared = F.least("b", "stop") - F.greatest("a", "start")
    return asked.join(binned, [key, "_level", "_bin"]).withColumn("shared", shared).where("shared > 0").drop("_level", "_bin")


def best_overlap(spans: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """For each span (span_id, key, a, b) the chunk (chunk, key, start, stop) that shares most of it, ties to the earlier chunk."""
    hit = overlaps(spans, chunks, key)
    return hit.groupBy("span_id").agg(F.max_by("chunk", F.struct("shared", -F.col("chunk"))).alias("chunk"), F.max("shared").alias("shared"))

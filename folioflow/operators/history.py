"""Version history: validity intervals, the five scopes, and folds of save, move, delete and restore events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.session import cut


def head_events(saves: DataFrame) -> DataFrame:
    """saves (document_id, branch, version_id, valid_from, event_type) with valid_to, when the next event of the branch begins."""
    order = Window.partitionBy("document_id", "branch").orderBy("valid_from", "version_id")
    return saves.withColumn("valid_to", F.lead("valid_from").over(order))


def scope(events: DataFrame, kind: str, value=None) -> DataFrame:
    """document_id, branch, version_id of a scope: all, current, as_of (micros), branch (name).

    Intervals are half-open. current is the newest save of any branch, as every save moves the head.
    """
    saved = events.where(F.col("event_type") == "save")
    cols = ("document_id", "branch", "version_id")
    if kind == "all":
        return saved.select(*cols)
    if kind == "as_of":
        return saved.where((F.col("valid_from") <= value) & (F.col("valid_to").isNull() | (F.col("valid_to") > value))).select(*cols)
    if kind == "branch":
        return saved.where((F.col("branch") == value) & F.col("valid_to").isNull()).select(*cols)
    if kind == "current":
        return current(saved)
    raise ValueError(f"scope {kind!r}")


def parse_scope(text: str) -> tuple[str, str | None]:
    """current, all, as_of:<time with zone>, snapshot:<name> or branch:<name>."""
    from datetime import datetime

    kind, _, rest = text.strip().partition(":")
    if kind in ("current", "all") and not rest:
        return kind, None
    if kind == "as_of":
        if datetime.fromisoformat(rest.replace("Z", "+00:00")).tzinfo is None:
            raise ValueError("as_of needs a time with a zone")
        return kind, rest
    if kind in ("snapshot", "branch") and rest:
        return kind, rest
    raise ValueError(f"scope {text!r}")


def current(saves: DataFrame) -> DataFrame:
    """The newest save of every document; partial aggregates, no window."""
    top = F.max_by(F.struct("branch", "version_id"), F.struct("valid_from", "version_id"))
    return saves.groupBy("document_id").agg(top.alias("v")).select("document_id", "v.branch", "v.version_id")


def snapshot(versions: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Versions in a snapshot: a semi join on all keys, so a missing snapshot gives nothing."""
    return versions.join(members, keys, "left_semi")


HOT, SLICES, FEW = 100_000, 64, 10_000


def as_of(probes: DataFrame, versions: DataFrame, keys: list[str], at: str, start: str, stop: str, order: list[str], hot: int = HOT, slices: int = SLICES) -> DataFrame:
    """Each probe (keys, at) with the other columns of the version of its keys that is valid then: start <= at, and stop null or later.

    The versions of a key do not overlap; of those that start together the last by order counts. Versions and probes are put in one order of time, and a
    running last carries the version on, so no pair is made and each row is shuffled once. The rows of a key that has more than hot are cut
    into slices of time, each of which gets what held at its beginning from the slices before. Probes with a null key or time, and those that nothing holds for, go.
    """
    carried = [c for c in versions.columns if c not in keys]
    v = versions.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_kind"), F.struct(*order).alias("_o"), F.struct(*carried).alias("_v"))
    p = probes.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.struct(*[F.col(c) for c in probes.columns if c not in keys]).alias("_p"))
    rows = v.unionByName(p, allowMissingColumns=True)
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    busy = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select(*keys)
    cuts = cut(rows.join(busy, keys, "left_semi").groupBy(*keys).agg(F.percentile_approx("_t", [k / slices for k in range(1, slices)]).alias("_cuts")))
    n = cuts.count()
    dealt = rows.withColumn("_slice", F.lit(0))
    if n:
        dealt = rows.join(F.broadcast(cuts) if n <= FEW else cuts, keys, "left").withColumn("_slice", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_t"))), F.lit(0))).drop("_cuts")
        dealt = dealt.withColumn("_slice", F.greatest("_slice", F.lit(0)))
    w = Window.partitionBy(*keys, "_slice").orderBy("_t", "_kind", "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("_held", F.last("_v", ignorenulls=True).over(w)).where("_kind = 1")
    if n:
        # one row a slice: what it ends with, and from that what the next ones begin with
        ends = dealt.where("_kind = 0").groupBy(*keys, "_slice").agg(F.max_by("_v", F.struct("_t", "_o")).alias("_end"))
        every = dealt.select(*keys, "_slice").distinct().join(ends, [*keys, "_slice"], "left")
        before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        begins = every.withColumn("_begin", F.last("_end", ignorenulls=True).over(before)).where("_begin is not null").select(*keys, "_slice", "_begin")
        found = found.join(begins, [*keys, "_slice"], "left").withColumn("_held", F.coalesce("_held", "_begin"))
    own = [F.col("_held")[c].alias(c) for c in carried]
    return found.where(F.col("_held").isNotNull() & (F.col("_held")[stop].isNull() | (F.col("_held")[stop] > F.col("_t")))).select(*keys, "_p.*", *own)


def path_override(rows: DataFrame, overrides: DataFrame, key: str, path: str) -> DataFrame:
    """path as the resolved version had it, else as it is."""
    return rows.join(overrides.select(key, F.col(path).alias("_then")), key, "left").withColumn(path, F.coalesce("_then", path)).drop("_then")


def changes(states: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Rows whose state differs from the one before; A, B, A keeps all three."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(state).over(w)
    first = F.row_number().over(w) == 1
    return states.withColumn("_f", first).withColumn("_b", before).where(F.col("_f") | ~F.col("_b").eqNullSafe(F.col(state))).drop("_f", "_b")


def numbered(states: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Changes with version numbers from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return changes(states, keys, order, state).withColumn("version_number", F.row_number().over(w).cast("long"))


def first_seen(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def moved(events: DataFrame, old: Column, new: Column) -> DataFrame:
    """For each move a save at the new path and a delete of no length at the old one."""
    two = F.array(F.struct(new.alias("path"), F.lit("save").alias("kind"), F.lit(None).cast("long").alias("valid_to")), F.struct(old.alias("path"), F.lit("delete").alias("kind"), F.col("valid_from").alias("valid_to")))
    return events.select("document_id", "version_id", "valid_from", F.inline(two))


def soft_delete(events: DataFrame, deletes: DataFrame) -> DataFrame:
    """Open saves of deleted documents are closed, and a delete event of no length is added for each branch."""
    at = deletes.select("document_id", F.col("at").alias("_at"))
    both = events.join(at, "document_id", "left")
    shut = both.withColumn("valid_to", F.when((F.col("event_type") == "save") & F.col("valid_to").isNull(), F.col("_at")).otherwise(F.col("valid_to"))).drop("_at")
    gone = both.where("_at is not null and event_type = 'save' and valid_to is null").select("document_id", "branch", "version_id", F.col("_at").alias("valid_from"), F.lit("delete").alias("event_type"), F.col("_at").alias("valid_to"))
    return shut.select("document_id", "branch", "version_id", "valid_from", "event_type", "valid_to").unionByName(gone)


def restored(saves: DataFrame, targets: DataFrame) -> DataFrame:
    """For targets (document_id, version_id) the next version of each document, with the old one's content: restored_from, version_number."""
    count = saves.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n"))
    known = saves.select("document_id", "version_id").distinct()
    return targets.join(known, ["document_id", "version_id"], "left_semi").join(count, "document_id").select("document_id", F.col("version_id").alias("restored_from"), (F.col("_n") + 1).alias("version_number"))


def folder_renamed(paths: DataFrame, path: str, old: str, new: str) -> DataFrame:
    """The rows of paths below the folder old, with new_path below new; old's own name inside a path stays."""
    below = old.rstrip("/") + "/"
    return paths.where(F.col(path).startswith(below)).withColumn("new_path", F.concat(F.lit(new.rstrip("/") + "/"), F.expr(f"substring(`{path}`, {len(below) + 1})")))


def decided(candidates: DataFrame, edits: DataFrame, key: str, value: str) -> DataFrame:
    """candidates with status: edited where edits (key, value) says another value, and that value; else accepted."""
    own = edits.select(key, F.col(value).alias("_new"), F.lit(True).alias("_hit"))
    both = candidates.join(own, key, "left")
    edit = F.col("_hit").isNotNull() & ~F.col("_new").eqNullSafe(F.col(value))
    return both.withColumn("status", F.when(edit, "edited").otherwise("accepted")).withColumn(value, F.when(edit, F.col("_new")).otherwise(F.col(value))).drop("_new", "_hit")


def get_or_create(mentions: DataFrame, keys: list[str], at: str, order: list[str], value: str) -> DataFrame:
    """One entity for each keys: first_seen, last_seen, and value as it was first."""
    return mentions.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.min_by(value, F.struct(at, *order)).alias(value))


def reconcile(files: DataFrame, heads: DataFrame, key: str, state: str) -> DataFrame:
    """Files that are new or whose state differs from the head's."""
    known = heads.select(key, F.col(state).alias("_head"))
    return files.join(known, key, "left").where(~F.col(state).eqNullSafe(F.col("_head"))).withColumn("action", F.when(F.col("_head").isNull(), "create").otherwise("update")).drop("_head")


def upsert_plan(new: DataFrame, old: DataFrame, key: list[str], status: str) -> DataFrame:
    """insert, update, delete or keep for every key of both sides; only candidates are deleted."""
    a, b = new.withColumn("_n", F.lit(True)), old.withColumn("_o", F.lit(True))
    both = a.join(b, key, "full")
    action = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNotNull(), "update").when(F.col(status) == "candidate", "delete").otherwise("keep")
    return both.withColumn("action", action).drop("_n", "_o")

"""Text expressions as Columns; every one stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), F.lit(1))


def strip(c) -> Column:
    """Without white space on both sides, as all of it and not blanks alone."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def snippet(c, size: int = 200) -> Column:
    s = strip(c)
    return F.when(F.length(s) > size, F.concat(F.regexp_replace(F.substring(s, 1, size), r"\s+$", ""), F.lit("..."))).otherwise(s)


def signals(bm25: str, vector: str, terms: str) -> Column:
    """keyword, semantic, exact-term for the ranks that are there."""
    one = lambda c, name: F.when(F.col(c).isNotNull(), name)
    return F.filter(F.array(one(bm25, "keyword"), one(vector, "semantic"), one(terms, "exact-term")), lambda x: x.isNotNull())


def slug(c, size: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, size)


def line_slice(c, first: int, last: int) -> Column:
    return F.array_join(F.slice(F.split(c, "\n"), first, last - first + 1), "\n")


def content_hash(c) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def signature(*cols) -> Column:
    return F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("")) for c in cols]), 256)


def in_fence(text, position) -> Column:
    """Whether an odd number of code fences stands before a place counted from 1."""
    return F.regexp_count(F.substring(text, F.lit(1), position - 1), F.lit("```")) % 2 == 1


def version_token(c) -> Column:
    """The first token that starts with a digit, or with v and a digit (without the v)."""
    bare = F.transform(F.split(c, r"\s+"), lambda t: F.regexp_replace(t, r"^[()\[\]{}.,;:]+|[()\[\]{}.,;:]+$", ""))
    hit = F.filter(bare, lambda t: t.rlike(r"^[vV]?[0-9]"))
    return F.regexp_replace(F.get(hit, F.lit(0)), "^[vV]", "")


def summary(c, size: int = 500) -> Column:
    """The first paragraph that is no heading; empty where a text has none."""
    parts = F.transform(F.split(c, "\n\n"), strip)
    first = F.get(F.filter(parts, lambda p: (p != "") & ~p.startswith("#")), F.lit(0))
    return F.when(parts.isNotNull(), F.substring(F.coalesce(first, F.lit("")), 1, size))


def severity(confidence) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.7, "medium").otherwise("low")


def age_days(now, then) -> Column:
    """Whole days of 24 hours between two times in micros."""
    return F.floor((now - then) / 86_400_000_000)

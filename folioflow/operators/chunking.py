"""Heading-aware chunks: a text's sections under their headings, and token windows inside of each section that is too long for one chunk.

Sections come from one sort of a document's lines: fences, sections and offsets are running sums, heading paths running lasts, all over one window. What a
token is, a tokenizer says that is passed in: it is made once in each Python worker and gives the offset at which each token of a text begins.
A chunk is the text from its first token to where the token after its last one begins, so windows cover a section without gaps.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.session import fields, fresh, importable

#: Tokens in a chunk, and those that it shares with the one before; fixed values.
MOST, OVERLAP = 512, 50
#: Ends of lines: a pair counts once.
EOL = r"(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0B\x0C\x1C-\x1E\x85\u2028\u2029])"
HEADING = r"(?sU)^(#{1,6})\s+(.+?)\s*$"

Tokenizer = Callable[[str], list[int]]


def words() -> Tokenizer:
    """Runs without white space."""
    pattern = re.compile(r"\S+")
    return lambda text: [m.start() for m in pattern.finditer(text)]


def byte_pairs(vocabulary: str) -> Callable[[], Tokenizer]:
    """Tokens of a vocabulary file of the tokenizers library. A character of several tokens belongs to the chunk of the last of them."""

    def make() -> Tokenizer:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library

        library = Library.from_file(vocabulary)
        return lambda text: [a for a, _ in library.encode(text, add_special_tokens=False).offsets]

    return make


def sections(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, section, heading_path, start_char, start_line, end_line, content of every section that isn't blank; section 0 is what stands before a heading.

    Headings inside code fences are text. Null, empty and blank texts have none; rows that share a key are told apart, but not in which order they came.
    """
    w = Window.partitionBy(key, "_row").orderBy("_n")
    # the one shuffle: all windows and aggregates after it need its partitioning
    own = texts.select(key, F.xxhash64(text).alias("_row"), F.col(text).alias("_t")).dropDuplicates([key, "_row"])
    rows = own.select(key, "_row", F.posexplode(F.split("_t", EOL)).alias("_n", "_line")).where("_line <> ''")
    fenced = F.sum(F.col("_line").startswith("```").cast("int")).over(w) % 2 == 1
    level = F.when(~fenced, F.nullif(F.length(F.regexp_extract(F.regexp_replace("_line", r"\n$", ""), HEADING, 1)), F.lit(0)))
    heads = rows.withColumn("_level", level).withColumn("_title", F.regexp_extract(F.regexp_replace("_line", r"\n$", ""), HEADING, 2))
    own_head = lambda k: F.last(F.when(F.col("_level") == k, F.struct("_n", "_title")), ignorenulls=True).over(w)
    above = lambda k: F.max(F.when(F.col("_level") < k, F.col("_n"))).over(w)
    path = F.array_compact(F.array(*[F.when(own_head(k)["_n"] > F.coalesce(above(k), F.lit(-1)), own_head(k)["_title"]) for k in range(1, 7)]))
    placed = heads.select(key, "_row", "_n", "_line", F.count("_level").over(w).alias("section"), (F.sum(F.length("_line")).over(w) - F.length("_line")).alias("_at"), path.alias("_path"))
    lines = F.array_sort(F.collect_list(F.struct("_n", "_line", "_at", "_path")))
    held = placed.groupBy(key, "_row", "section").agg(lines.alias("_l"))
    first, last = F.element_at("_l", 1), F.element_at("_l", -1)
    told = held.select(key, "_row", "section", first["_path"].alias("heading_path"), first["_at"].alias("start_char"), (first["_n"] + 1).alias("start_line"), (last["_n"] + 1).alias("end_line"), F.array_join(F.transform("_l", lambda x: x["_line"]), "").alias("content"))
    return told.where(X.strip(F.col("content")) != "")


def windows(content: str, starts: list[int], most: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """first and last character, line ends before and in it, and tokens of each chunk of a section; one chunk if it has no more than most tokens."""
    out, s, n, lines, seen = [], 0, len(starts), 0, 0
    while True:
        e = min(s + most, n)
        a, b = (starts[s] if s else 0), (starts[e] if e < n else len(content))
        lines += content.count("\n", seen, a)
        seen = a
        out.append((a, b, lines, content.count("\n", a, b), e - s))
        if e >= n:
            return out
        s = max(e - overlap, s + 1)


def chunks(texts: DataFrame, key: str = "id", text: str = "text", tokenizer: Callable[[], Tokenizer] = words, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk_index (from 0 in a text), heading_path, start_char, end_char, start_line, end_line, token_count, content.

    A section of at most most tokens is one chunk; its last line is the section's. Longer ones are cut into windows of most tokens that share overlap
    with the one before; a window's lines are counted by the line feeds before and in it. The text from start_char to end_char is the content.
    Null, empty and blank texts have no chunks; repeated rows have theirs once; unlike texts of one key are numbered each by itself.
    """
    importable(texts.sparkSession)
    name = fresh("_key", texts)
    own = sections(texts.select(F.col(key).alias(name), F.col(text).alias("_text")), name, "_text")
    plain = [name, "_row", "section", "heading_path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts_of = tokenizer()
        for batch in batches:
            c = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("start_char", "start_line", "end_line", "content")}
            row, cols = [], [[] for _ in range(7)]
            for i, content in enumerate(c["content"]):
                found = windows(content, starts_of(content), most, overlap)
                for k, (a, b, before, inside, tokens) in enumerate(found):
                    line = c["start_line"][i] + before
                    row.append(i)
                    told = (k, c["start_char"][i] + a, c["start_char"][i] + b, line, c["end_line"][i] if len(found) == 1 else line + inside, tokens, content[a:b])
                    for col, v in zip(cols, told, strict=True):
                        col.append(v)
            kept = [batch.column(batch.schema.get_field_index(n)).take(pa.array(row, pa.int64())) for n in plain]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, pa.int64()) for v in cols[:-1]), pa.array(cols[-1], pa.string())], names=[*plain, "k", "start_char", "end_char", "start_line", "end_line", "token_count", "content"])

    cut = own.mapInArrow(run, f"{fields(own.select(plain))}, k long, start_char long, end_char long, start_line long, end_line long, token_count long, content string")
    index = F.row_number().over(Window.partitionBy(name, "_row").orderBy("section", "k")) - 1
    return cut.select(F.col(name).alias(key), index.cast("long").alias("chunk_index"), "heading_path", "start_char", "end_char", "start_line", "end_line", "token_count", "content")

"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as <|turn|>role<|text|>text<|end|> for each turn, encoded once with offsets, and the sorted spans of the
turns to learn are intersected with the tokens' spans by binary search. The three marks are added tokens, at which the encoder always splits,
so no token lies across a span's edge. Inside roles and texts every run "<", backslashes, "|" gets one more backslash;
no mark can then occur in them, and taking one away gives the text back.

A conversation of more than PART_CHARS characters is encoded in parts, cut between turns; as encoding splits at the marks anyway, the ids are the
same, and no task holds more than a part. Rows of a conversation come in order of turn (null first), ties by role and text.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import bpe
from folioflow.session import importable

TURN, TEXT, END = MARKS = ("<|turn|>", "<|text|>", "<|end|>")
PART_CHARS = 1 << 20
BATCH_CHARS = 1 << 20
FORMATTED = "conv_id long, part int, n_turns long, ids array<int>, learn array<boolean>, formatted_chars long"
_MASKED, _PLAIN = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(s: str) -> str:
    return _MASKED.sub(r"<\\\1|", s)


def unescape(s: str) -> str:
    return _PLAIN.sub(r"<\1|", s)


_tokenizers: dict = {}


def tokenizer(path: str):
    """The library's tokenizer with the marks added, and the marks' ids."""
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in MARKS])
        _tokenizers[path] = t, [t.token_to_id(m) for m in MARKS]
    return _tokenizers[path]


def render(turns: list[tuple[str, str]], learn: str) -> tuple[str, list[int], list[int]]:
    """The string, and starts and ends of the texts to learn."""
    out, at, starts, ends = [], 0, [], []
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        at += len(head)
        if role == learn:
            starts.append(at)
            ends.append(at + len(body))
        at += len(body) + len(END)
        out += [head, body, END]
    return "".join(out), starts, ends


def mask(offsets: np.ndarray, starts: list[int], ends: list[int]) -> np.ndarray:
    """Which tokens lie inside a span: both lists are sorted, so each span's first and last token are found by binary search."""
    out = np.zeros(len(offsets) + 1, np.int64)
    first = np.searchsorted(offsets[:, 0], starts, "left")
    last = np.searchsorted(offsets[:, 1], ends, "right")
    np.add.at(out, first, 1)
    np.add.at(out, np.maximum(first, last), -1)
    return np.cumsum(out[:-1]) > 0


def _formatter(path: str, learn: str):
    def run(batches):
        t, _ = tokenizer(path)
        waiting: list = []  # (conversation, part, turns)
        size = 0

        def flush():
            made = [render(turns, learn) for _, _, turns in waiting]
            rows = []
            for (conv, part, turns), (text, starts, ends), e in zip(waiting, made, t.encode_batch([m[0] for m in made], add_special_tokens=False), strict=True):
                offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                rows.append((conv, part, len(turns), e.ids, mask(offsets, starts, ends), len(text)))
            waiting.clear()
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["conv_id", "part", "n_turns", "ids", "learn", "formatted_chars"])

        started, conv, part, turns, chars = False, None, 0, [], 0
        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if started and (c != conv or chars >= PART_CHARS):
                    waiting.append((conv, part, turns))
                    size += chars
                    part = part + 1 if c == conv else 0
                    turns, chars = [], 0
                    if size >= BATCH_CHARS:
                        yield from flush()
                        size = 0
                started, conv = True, c
                turns.append((role, text))
                chars += len(role) + len(text) + 20
        if started:
            waiting.append((conv, part, turns))
        if waiting:
            yield from flush()

    return run


def format_chats(rows: DataFrame, vocabulary: str | None = None, learn: str = "assistant") -> DataFrame:
    """conv_id, part, n_turns, ids, learn (the loss mask), formatted_chars, parts of a conversation one after the other.

    rows has conv_id, turn, role, text; null roles and texts are empty, a null conv_id is a conversation of its own, repeated rows are turns of
    their own. An empty table gives no rows.
    """
    importable(rows.sparkSession)
    own = rows.select(F.col("conv_id").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").alias("turn"))
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_formatter(vocabulary or bpe.vocabulary(), learn), FORMATTED)


def _reader(path: str):
    def run(batches):
        t, (turn, text_mark, end) = tokenizer(path)
        decode = lambda ids: unescape(t.decode(ids, skip_special_tokens=False)) if len(ids) else ""
        state = None
        rows: list = []

        def done():
            conv, n, all_hash, chars, loss_hash, formatted = state
            rows.append((conv, n, all_hash.hexdigest(), chars, loss_hash.hexdigest(), formatted))

        for batch in batches:
            convs, parts, formatted = (batch.column(k).to_pylist() for k in (0, 1, 5))
            for i, conv in enumerate(convs):
                if parts[i] == 0:
                    if state:
                        done()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, learn = batch.column(3)[i].values.to_numpy(), batch.column(4)[i].values.to_numpy(zero_copy_only=False)
                marks = np.flatnonzero((ids == turn) | (ids == text_mark) | (ids == end))
                state[5] += formatted[i]
                for a, b, c in marks.reshape(-1, 3):
                    state[1] += 1
                    role, text = decode(ids[a + 1 : b].tolist()), decode(ids[b + 1 : c].tolist())
                    state[2].update(f"{role}\n{text}\n".encode())
                edges = np.flatnonzero(np.diff(np.r_[False, learn, False].astype(np.int8)))
                for a, b in edges.reshape(-1, 2):
                    text = decode(ids[a:b].tolist())
                    state[3] += len(text)
                    state[4].update(text.encode())
        if state:
            done()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return run


def read_back(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Digests of every conversation, from ids and mask alone; formatted as format_chats gives it, in its order."""
    return formatted.mapInArrow(_reader(vocabulary or bpe.vocabulary()), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6(spark, sf_dir: str) -> DataFrame:
    """Contract query: all conversations and one that tries the template."""
    from folioflow.sources.tables import table

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.unionByName(own)))

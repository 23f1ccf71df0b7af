"""Model calls over tables: one client a task, batches under a budget of tokens, guards, retries, and an error for each row that fails.

A client is made by a function without arguments, inside the task that uses it, and maps a list of inputs to a list of answers. A batch that fails after
its retries is halved until the rows that make it fail stand alone, so one bad row costs no other row its answer.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import fields, importable

Client = Callable[[], Callable[[list], list]]


@dataclass(frozen=True)
class Limits:
    """Texts and tokens (characters // 4) of a batch, characters of a text, calls beyond the first, and seconds before the next one, doubled each time."""

    texts: int = 32
    tokens: int = 8192
    chars: int = 32_768
    retries: int = 2
    wait: float = 0.5


def batched(sizes: list[int], limits: Limits) -> Iterator[tuple[int, int]]:
    """Runs of rows whose tokens fit a batch; a row that alone has more is a batch of its own."""
    first, tokens = 0, 0
    for i, size in enumerate(sizes):
        if i > first and (tokens + size > limits.tokens or i - first >= limits.texts):
            yield first, i
            first, tokens = i, 0
        tokens += size
    if first < len(sizes):
        yield first, len(sizes)


def answers(model: Callable[[list], list], inputs: list, check: Callable, limits: Limits) -> list[tuple]:
    """(value, error) for each input; one of them is null."""
    error = None
    for turn in range(limits.retries + 1):
        try:
            got = model(inputs)
            if len(got) != len(inputs):
                raise ValueError(f"{len(got)} answers for {len(inputs)} inputs")
            break
        except Exception as e:  # whatever a client raises is the rows' error
            error = e
            if turn < limits.retries and limits.wait:
                time.sleep(limits.wait * 2**turn)
    else:
        if len(inputs) == 1:
            return [(None, f"{type(error).__name__}: {error}")]
        half = len(inputs) // 2
        return answers(model, inputs[:half], check, limits) + answers(model, inputs[half:], check, limits)
    return [check(v) for v in got]


def called(rows: DataFrame, inputs: list[str], client: Client, value: str, kind: pa.DataType, ddl: str, check: Callable, limits: Limits) -> DataFrame:
    """rows with value and error. A row with a null or blank input, or with one that is too long, isn't sent."""
    importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            own = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs), strict=True))
            found: list[tuple] = [(None, None)] * len(own)
            send = []
            for i, texts in enumerate(own):
                if any(t is None or not t.strip() for t in texts):
                    found[i] = (None, "empty input")
                elif any(len(t) > limits.chars for t in texts):
                    found[i] = (None, f"input of more than {limits.chars} characters")
                else:
                    send.append(i)
            if send and model is None:
                model = client()
            for a, b in batched([sum(map(len, own[i])) // 4 for i in send], limits):
                part = send[a:b]
                asked = [own[i] if len(inputs) > 1 else own[i][0] for i in part]
                for i, got in zip(part, answers(model, asked, check, limits), strict=True):
                    found[i] = got
            values, errors = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind), pa.array(errors, pa.string())], names=[*batch.schema.names, value, "error"])

    return rows.mapInArrow(run, f"{fields(rows)}, {value} {ddl}, error string")


def embedded(rows: DataFrame, text: str, client: Client, dimension: int, limits: Limits = Limits()) -> DataFrame:
    """rows with vector (its first dimension components) and error; the client maps texts to vectors. A shorter vector is an error of its row."""

    def check(v) -> tuple:
        v = list(v)
        return ([float(x) for x in v[:dimension]], None) if len(v) >= dimension else (None, f"{len(v)} components instead of {dimension}")

    return called(rows, [text], client, "vector", pa.list_(pa.float32()), "array<float>", check, limits)


def scored(rows: DataFrame, query: str, text: str, client: Client, limits: Limits = Limits()) -> DataFrame:
    """rows with rerank_score and error; the client maps (query, text) pairs to scores. Pairs of a query share batches where rows come by query."""
    check = lambda v: (float(v), None) if v == v else (None, "score is not a number")
    return called(rows, [query, text], client, "rerank_score", pa.float64(), "double", check, limits)


def failures(answered: DataFrame) -> DataFrame:
    """error, n: how many rows failed, by what."""
    return answered.where("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n"))

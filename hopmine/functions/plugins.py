"""Functions that callers bring along: token coders and response providers, run over Arrow batches with one set-up a worker."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Makes (encode, decode): lists of texts to lists of token lists, and back.
Coder = Callable[[], tuple[Callable[[list[str]], list[list]], Callable[[list[list]], list[str]]]]
#: Makes a function from prompts to responses, null for a prompt that it could not answer.
Provider = Callable[[], Callable[[list[str]], list[str | None]]]

_ready: dict[str, object] = {}


def _once(name: str, make: Callable[[], object]) -> object:
    """What make gives, made once in a worker for each use that the driver has named."""
    if name not in _ready:
        _ready[name] = make()
    return _ready[name]


def coded_windows(docs: DataFrame, coder: Coder, size: int, step: int) -> DataFrame:
    """(document_id, chunk, text, n_tokens): every window of size tokens, step apart, of each raw_content, decoded; n_tokens counts the tokens of the decoded text."""
    name, kind = uuid.uuid4().hex, docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = _once(name, coder)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                owner, number, windows = [], [], []
                for i, tokens in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    for k, start in enumerate(range(0, len(tokens), step)):
                        owner.append(i)
                        number.append(k)
                        windows.append(tokens[start : start + size])
                texts = decode(windows)
                counts = [len(t) for t in encode(texts)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["document_id", "chunk", "text", "n_tokens"])

    return docs.select("id", "raw_content").mapInArrow(run, f"document_id {kind}, chunk int, text string, n_tokens int")


def provided(prompts: DataFrame, provider: Provider, attempts: int = 3, batch: int = 32) -> DataFrame:
    """(key, response, attempts) for each different key of (key, prompt): the first answer of at most `attempts`, null if there is none.

    A call that fails counts as an attempt for all prompts in it; those without an answer are asked again together.
    """
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = _once(name, provider)
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                texts = part.column(1).to_pylist()
                found: list[str | None] = [None] * len(texts)
                tried = [0] * len(texts)
                for _ in range(attempts):
                    left = [i for i, r in enumerate(found) if r is None]
                    if not left:
                        break
                    try:
                        answers = ask([texts[i] for i in left])
                    except Exception:  # noqa: BLE001 - whatever a provider raises is a failed attempt
                        answers = [None] * len(left)
                    for i, answer in zip(left, answers, strict=True):
                        found[i], tried[i] = answer, tried[i] + 1
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string()), pa.array(tried, pa.int32())], ["key", "response", "attempts"])

    # one prompt a key; equal keys have equal prompts
    return prompts.groupBy("key").agg(F.min("prompt").alias("prompt")).mapInArrow(run, "key string, response string, attempts int")

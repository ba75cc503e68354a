"""Document fingerprints: the k smallest distinct hashes of a text's five-word shingles (a bottom-k sketch).

Sketches of parts merge into the sketch of the whole, and estimate resemblance, containment and the number of distinct
shingles. A sketch with fewer than k hashes is the whole shingle set, so estimates on it are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_LONG, range_of, shuffle_partitions, splitters
from .shingles import shingle_sets

K = 64
BITS = 48
CHUNK_CHARS = 1 << 20


def bottom_k(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of sorted distinct 64-bit hashes: their k smallest, cut to 48 bits."""
    return np.unique(shingles >> np.uint64(64 - BITS))[:k]


def pack(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpack(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, BITS // 8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return out.reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated Jaccard similarity; 1 for two sketches without shingles."""
    low = merge(a, b, k)
    if not len(low):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(low, both, assume_unique=True).sum() / len(low))


def distinct(a: np.ndarray, k: int = K) -> float:
    """The estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**BITS / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    return min(1.0, r * (distinct(a, k) + distinct(b, k)) / ((1 + r) * distinct(a, k)))


def group_fingerprints(rows: DataFrame, group_col: str, fingerprint_col: str, k: int = K) -> DataFrame:
    """(group, fingerprint) of the union of each group's texts: sketches merge inside each task first, then across tasks."""
    kind = rows.schema[group_col].dataType.simpleString()
    schema = f"`{group_col}` {kind}, fingerprint string"

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held, like), pa.array([pack(x) for x in held.values()], pa.string())], [group_col, "fingerprint"])

        like = None
        for batch in batches:
            like = batch.schema.field(0).type
            for g, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = unpack(f or "")
                held[g] = merge(held[g], own, k) if g in held else own[:k]
            if len(held) > 50_000:
                yield out()
                held = {}
        if held:
            yield out()

    parts = rows.select(group_col, F.col(fingerprint_col).alias("fingerprint")).mapInArrow(merged, schema)
    return parts.repartition(group_col).sortWithinPartitions(group_col).mapInArrow(merged, schema).groupBy(group_col).applyInPandas(
        lambda pdf: pdf.assign(fingerprint=pack(_fold(pdf["fingerprint"], k))).head(1), schema
    )


def _fold(fingerprints, k: int) -> np.ndarray:
    low = np.zeros(0, np.uint64)
    for f in fingerprints:
        low = merge(low, unpack(f), k)
    return low


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, k: int = K) -> DataFrame:
    """(doc_id, fingerprint) of every row's whole text.

    Null and empty texts, and those without words, have an empty fingerprint. A row is sketched for itself: repeated rows
    have equal fingerprints, null ids stay null. An empty table has no rows.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(bottom_k(s, k)) for s in shingle_sets(batch.column(1), n)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(sketch, "doc_id long, fingerprint string")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, str]]]:
    """Rows (tail, id, text), some megabytes at a time."""
    held, size = [], 0
    for batch in batches:
        for row in zip(batch.column("tail").to_pylist(), batch.column("id").to_pylist(), batch.column("text"), strict=True):
            held.append((row[0], row[1], row[2].as_py()))
            size += len(held[-1][2])
            if size >= CHUNK_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, k: int = K, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next row's text in
    ascending id (after the last: the first row's). Null texts are empty; null ids come last; rows that share an id
    follow each other in the order of a hash of their text, so repeated rows are neighbours. An empty table has no rows.
    Rows go once through one shuffle, into ranges of (id, hash) by sampled splitters; only each range's first row is
    sent to the range before it as well.
    """
    ranges = ranges or shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # digits in the order of ids, null last
    order, tie = F.coalesce(F.lpad(F.hex(F.col("id").bitwiseXOR(F.lit(-MAX_LONG - 1))), 16, "0"), F.lit("none")), F.xxhash64("text")
    cuts = splitters(rows, order, tie, ranges)
    rows = rows.withColumn("order", order).withColumn("tie", tie).withColumn("range", range_of(F.col("order"), F.col("tie"), cuts).cast("int"))
    firsts = sorted((r.range, r.f.order, r.f.tie) for r in rows.groupBy("range").agg(F.min(F.struct("order", "tie")).alias("f")).collect())
    # a row a range: the first of each, and the range before it (of the first range: the last)
    before = [(low, t, firsts[i - 1][0]) for i, (_, low, t) in enumerate(firsts)]
    heads = F.broadcast(rows.sparkSession.createDataFrame(before, "order string, tie long, to int"))
    ends = rows.join(heads, ["order", "tie"]).groupBy("to").agg(F.min("text").alias("text")).select(F.col("to").alias("range"), F.lit(1).alias("tail"), F.lit(None).cast("long").alias("id"), F.lit("").alias("order"), F.lit(0).cast("long").alias("tie"), "text")
    both = rows.select("range", F.lit(0).alias("tail"), "id", "order", "tie", "text").unionByName(ends)
    dealt = both.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("tail", "order", "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # (tail, id, text, sketch) of the row whose next row is in the next chunk
        for chunk in _chunks(batches):
            sketches = [bottom_k(s, k) for s in shingle_sets(pa.array([t for _, _, t in chunk], pa.string()), n)]
            line = [*[waiting] * (waiting is not None), *[(*row, s) for row, s in zip(chunk, sketches, strict=True)]]
            pairs = [(a[1:], b[1:]) for a, b in zip(line[:-1], line[1:], strict=True) if not a[0]]
            waiting = line[-1]
            if not pairs:
                continue
            edited = [a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2] for a, b in pairs]
            changed = [bottom_k(s, k) for s in shingle_sets(pa.array(edited, pa.string()), n)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([a[0] for a, _ in pairs], pa.int64()),
                    "n_chars": pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                    "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                    "fingerprint": [pack(a[2]) for a, _ in pairs],
                    "edited_fingerprint": [pack(c) for c in changed],
                    "near_edited": [resemblance(a[2], c, k) for (a, _), c in zip(pairs, changed, strict=True)],
                    "near_next": [resemblance(a[2], b[2], k) for a, b in pairs],
                }
            )

    return dealt.select("tail", "id", "text").mapInArrow(run, SCHEMA)

"""Exact duplicates by content sort.

Texts are equal when they are identical after deleting every character of [\\x20\\x09-\\x0D]. Sampled splitters of the
normalised text deal the rows to ranges, each range is sorted by its whole normalised texts (outside memory where
needed), so that equal texts are adjacent, and each text is compared in full with its neighbour's. Splitters are short:
the first characters of a text and, for texts that begin alike, the digest of all of it. All rows of a text go to one range,
but for texts that so many rows share that several splitters fall on them: those are cut by id as well, so a group with
a third of all rows spans many ranges, and what is kept of them is found by grouping on the whole normalised text.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_LONG, code_points, range_of, row_hash, shuffle_partitions

SPACE = r"[\x20\x09-\x0D]+"
PREFIX = 64
PER_RANGE = 32
RANGE_BYTES = 64 << 20
PART_ROWS = 500


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def _key(norm: Column) -> Column:
    return F.concat(F.substring(norm, 1, PREFIX), F.lit("\u0001"), F.sha2(norm, 256))


def _id(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(MAX_LONG))


def _cuts(few: DataFrame, ranges: int | None) -> tuple[list[tuple[str, int]], list[str]]:
    """Cut points (key, id) out of a sample of (id, text), and the digests of texts that several of them fall on.

    There are as many ranges as shuffle partitions, more if they would hold over RANGE_BYTES of text. The sample holds
    about PER_RANGE rows a range; it is drawn before texts are normalised.
    """
    total, n = few.count(), ranges or shuffle_partitions(few.sparkSession)
    if not total:
        return [], []

    def sample(n: int) -> list:
        share = 1.2 * n * PER_RANGE / total
        rows = few.sample(fraction=share, seed=11) if share < 1 else few
        return rows.select(_key(normalised(_text("text"))).alias("k"), _id("id").alias("t"), F.octet_length(_text("text")).alias("b")).collect()

    found = sample(n)
    if ranges is None and found:
        wanted = math.ceil(total * sum(r.b for r in found) / len(found) / RANGE_BYTES)
        if wanted > n:
            n = wanted
            found = sample(n)
    order = sorted((r.k, r.t) for r in found)
    picks = sorted({order[len(order) * i // n] for i in range(1, n)}) if order else []
    keys = [k for k, _ in picks]
    hot = {a for a, b in zip(keys, keys[1:], strict=False) if a == b}
    # a cut before all rows of its text, unless it is one of several on that text
    cuts = sorted({(k, t if i and keys[i - 1] == k else -MAX_LONG) for i, (k, t) in enumerate(picks)})
    return cuts, sorted(k.rpartition("\u0001")[2] for k in hot)


def _sorted(docs: DataFrame, id_col: str, text_col: str, ranges: int | None, whole: bool = False) -> tuple[DataFrame, dict[str, tuple[int | None, int]]]:
    """(id, norm, sha) in ranges, sorted by (norm, code points descending, id, null last), with whole all columns as `row` too; and for the digests of texts in several ranges the kept id and the group's size.

    With whole, rows that agree in all of these are in the order of their texts, then of a hash of all columns.
    """
    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cuts, hot = _cuts(few, ranges)
    spanning: dict[str, tuple[int | None, int]] = {}
    if hot:
        own = few.select(F.col("id").cast("long").alias("id"), normalised(_text("text")).alias("norm"), code_points(_text("text")).alias("n")).withColumn("sha", F.sha2("norm", 256))
        # whole texts are grouped; the driver sees a digest and two numbers of fewer texts than ranges
        groups = own.filter(F.col("sha").isin(hot)).groupBy("norm", "sha").agg(F.min(F.struct(-F.col("n"), F.col("id").isNull().alias("none"), "id"))["id"].alias("keep"), F.count("*").alias("size"))
        spanning = {r.sha: (r.keep, r.size) for r in groups.select("sha", "keep", "size").collect()}
    rows = docs.select(
        *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * whole, F.col(id_col).cast("long").alias("id"), code_points(_text(text_col)).alias("n_chars"), normalised(_text(text_col)).alias("norm"), *[row_hash(docs).alias("tie")] * whole
    ).withColumn("sha", F.sha2("norm", 256))
    key = F.concat(F.substring("norm", 1, PREFIX), F.lit("\u0001"), "sha")
    dealt = rows.withColumn("range", range_of(key, _id("id"), cuts)).drop(*["norm"] * whole).repartitionById(len(cuts) + 1, F.col("range"))
    if whole:
        dealt = dealt.withColumn("norm", normalised(F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))))
    ties = [F.col("row").getField(text_col), "tie"] if whole else []
    return dealt.sortWithinPartitions("norm", F.col("n_chars").desc(), F.col("id").asc_nulls_last(), *ties).select("id", "norm", "sha", *["row"] * whole), spanning


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int | None], list[str], list[bool]]]:
    """(rows, ids, digests, whether a row's text differs from the one before) of some rows at a time."""
    last: str | None = None
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            part = batch.slice(at, PART_ROWS)
            texts = part.column(1).to_pylist()
            new = [a != b for a, b in zip(texts, [last, *texts[:-1]], strict=True)]
            last = texts[-1]
            yield part, part.column(0).to_pylist(), part.column(2).to_pylist(), new


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Of equal texts the row with the most code points stays, then that with the smallest id; null texts are empty, a null
    id comes after all others. Of rows that repeat the kept row's id, text and all, one stays. An empty table has no rows.
    """
    dealt, spanning = _sorted(docs, id_col, text_col, ranges)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # nine bytes a row until its group ends
        ids, none, starts, shas = array("q"), array("b"), array("q"), []

        def flush() -> pa.RecordBatch:
            first = np.frombuffer(starts, np.int64).copy()
            own, without = np.frombuffer(ids, np.int64).copy(), np.frombuffer(none, np.int8).astype(bool)
            sizes = np.diff(np.append(first, len(own)))
            keep, keep_none = own[first], without[first]
            n = sizes.copy()
            for k, sha in enumerate(shas):
                if sha in spanning:
                    keep_none[k] = spanning[sha][0] is None
                    keep[k], n[k] = spanning[sha][0] or 0, spanning[sha][1]
            # the kept row leads its group, so it also leads the run of the range that holds it
            kept = np.zeros(len(own), bool)
            kept[first] = (own[first] == keep) & (without[first] == keep_none)
            digests = pa.array(shas, pa.string()).take(pa.array(np.repeat(np.arange(len(shas)), sizes)))
            keeps = pa.array(np.repeat(keep, sizes), pa.int64(), mask=np.repeat(keep_none, sizes))
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int64(), mask=without), keeps, pa.array(np.repeat(n, sizes)), pa.array(kept), digests], ["doc_id", "keep_id", "group_size", "kept", "text_sha256"])

        for _, row_ids, row_shas, new in _runs(batches):
            for row_id, sha, begins in zip(row_ids, row_shas, new, strict=True):
                if begins:
                    if len(ids) >= 20_000:
                        yield flush()
                        ids, none, starts, shas = array("q"), array("b"), array("q"), []
                    starts.append(len(ids))
                    shas.append(sha)
                ids.append(row_id or 0)
                none.append(row_id is None)
        if ids:
            yield flush()

    return dealt.mapInArrow(decide, "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with all their columns, whatever their names.

    Of rows that agree in id and normalised text and have as many code points, the one with the smallest text stays, then
    that with the smallest hash of all its columns: the same for every order of the input. An empty table stays empty.
    """
    dealt, spanning = _sorted(docs, id_col, text_col, ranges, whole=True)
    kind = dealt.select("row").schema

    def first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, shas, new in _runs(batches):
            take = [i for i, begins in enumerate(new) if begins and spanning.get(shas[i], (ids[i],))[0] == ids[i]]
            if take:
                yield part.select(["row"]).take(pa.array(take))

    return dealt.mapInArrow(first_rows, kind).select("row.*")


ORACLE = """
with d as (
  select doc_id, length(coalesce(text, '')) n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) h from documents
), g as (
  select *, first_value(doc_id) over (partition by h order by n desc, doc_id) keep_id, count(*) over (partition by h) group_size from d
)
select doc_id, keep_id, group_size, doc_id = keep_id kept, h text_sha256 from g
"""

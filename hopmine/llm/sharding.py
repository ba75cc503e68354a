"""A reproducible shuffle into shards, with DataFrame functions only.

Rows get global row numbers in id order: sampled splitters cut the order into ranges, counts per range give offsets, and
a row number inside the range does the rest. A keyed Feistel permutation of [0, n), with cycle walking, sends row number
to place; shard = place mod shards and slot = place div shards, so both can be computed for any row number alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import MAX_LONG, cut, range_of, shuffle_partitions, splitters

ROUNDS = 8
WALKS = 64


def permuted(x: Column, n: int, seed: int = 0, rounds: int = ROUNDS) -> Column:
    """The place in [0, n) of x in [0, n): an alternating Feistel network over a x b >= n, walked until it is below n.

    Fewer than a = ceil(sqrt(n)) values of the domain are outside, so a walk longer than WALKS steps can't happen below
    n = WALKS ** 2 and has probability under n ** -(WALKS / 2) above; it raises an error rather than give a wrong place.
    """
    if n <= 1:
        return F.lit(0).cast("long")
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def once(v: Column) -> Column:
        start = F.struct((v % a).cast("long").alias("l"), F.floor(v / a).cast("long").alias("r"))

        def turn(s: Column, i: Column) -> Column:
            return F.when(i % 2 == 0, F.struct(F.pmod(s["l"] + F.pmod(F.xxhash64(F.lit(seed), i, s["r"]), F.lit(a)), F.lit(a)).cast("long").alias("l"), s["r"].alias("r"))).otherwise(
                F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(F.lit(seed), i, s["l"]), F.lit(b)), F.lit(b)).cast("long").alias("r"))
            )

        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn, lambda s: s["r"] * a + s["l"])

    def walk(v: Column, _: Column) -> Column:
        return F.when(v < n, v).otherwise(once(v))

    # the first step by itself: nearly all values are below n after it
    first = F.transform(F.array(once(x)), lambda v: F.when(v < n, v).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), v, walk)))
    place = F.element_at(first, 1)
    return F.element_at(F.transform(F.array(place), lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))), 1)


def row_numbers(rows: DataFrame, id_col: str, tie_cols: list[str], unique: str | None = None, ranges: int | None = None) -> DataFrame:
    """rows with row_number from 0 in the order of id_col (null last), then tie_cols.

    unique is a column of different numbers: it cuts repeated rows, which are equal in all others, into ranges too.
    """
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_LONG))
    number = lambda c: F.lpad(F.hex(F.col(c).bitwiseXOR(F.lit(-MAX_LONG - 1))), 16, "0")
    rows = rows.withColumn("_order", order).withColumn("_tie", F.xxhash64(*tie_cols)).withColumn("_last", F.col(unique).cast("long") if unique else F.lit(0).cast("long"))
    key = F.concat(number("_order"), number("_tie"))
    cuts = splitters(rows, key, F.col("_last"), ranges or 4 * shuffle_partitions(rows.sparkSession))
    rows = rows.withColumn("_range", range_of(key, F.col("_last"), cuts))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy("_range").orderBy("_order", "_tie", "_last")) - 1
    # one row a range: as many as partitions, never with the rows
    return rows.withColumn("_inside", inside).join(F.broadcast(offsets), "_range").withColumn("row_number", F.col("_offset") + F.col("_inside")).drop("_order", "_tie", "_last", "_range", "_offset", "_inside")


def shards(docs: DataFrame, n_shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; the law is `rows`.

    Shard sizes differ by one row at most and slots have no gaps. Null ids come last in the order that is shuffled;
    repeated rows are rows of their own, side by side in that order; a null text counts as no bytes. Rows of one id are in
    the order of a hash of their size and checksum, so reruns agree. An empty table has no rows. Texts are read once.
    """
    text = F.encode(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    numbered = row_numbers(rows, "doc_id", ["size", "text_crc32"], "row")
    placed = numbered.withColumn("place", permuted(F.col("row_number").cast("long"), rows.count(), seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("place", F.lit(n_shards)).cast("int").alias("shard"), F.floor(F.col("place") / n_shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

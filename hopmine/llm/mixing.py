"""Mixing sources to target weights, with DataFrame functions only.

Rows get a hash key that is as good as random. Within a source, the leading hex digits of the key cut the key space into
equal ranges; word counts are summed per (source, range), a running sum over the ranges gives each range its offset, and
a running sum inside a range gives each row its own. There are about sqrt(rows) ranges of sqrt(rows) rows, so neither
running sum is long, and a source that holds a third of all rows is dealt over all tasks. Words are counted once, into a
narrow table of sizes that all sums are taken from; only where rows are to carry further columns are they read, and their
words counted, a second time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, row_hash

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEAT = 3


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources in code point order, null last, weigh `weights` in turn and share the sum of all sizes. A target stops at
    max_repeat times its source's size and the excess goes to the others by weight. In ascending order of cap / weight
    the sources that stop come first, so the common level of the others follows from running sums.
    """
    every = W.partitionBy(F.lit(1))
    ordered = totals.withColumn("n", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    ordered = ordered.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_repeat)
    rank = every.orderBy(F.col("cap") / F.col("weight"), "n")
    before, after = rank.rowsBetween(W.unboundedPreceding, -1), rank.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = ordered.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    # once a source is below its cap, so are all after it, at the level of the first of them
    common = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "n", "level"))).over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["level"]
    return levels.withColumn("common", common).select("source", "source_size", F.least("cap", F.coalesce(F.col("common") * F.col("weight"), "cap")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row (and the columns of carry).

    A source's budget is its target rounded to whole words. With S its size, every row is taken budget div S times in
    full, and the rest of the budget is filled in key order, the last row in part. Null texts and texts without words
    have size 0 and are never taken. A null source is a source. Repeated rows are rows like others. Rows without an id
    get their key from their text; ties of the key are broken by the id, the size and a hash of the text, then by a
    hash of the columns of carry; rows that are equal in all of these are exchangeable. An empty table has no rows.
    """
    text = F.col(f"`{text_col}`").cast("string")
    name = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    given = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("tie").cast("string"))))

    def sized(*more: Column) -> DataFrame:
        rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), words_of(text).alias("size"), F.xxhash64(text).alias("tie"), *more)
        return rows.withColumn("key", F.md5(given)).withColumn("name", name)

    narrow = cut(sized())
    n = narrow.count()
    digits = max(1, round(math.log(max(2, n), 16) / 2))
    # rows that agree in all that is mixed by are in the order of what they carry
    last = ["carried_hash"] if carry else []
    rows = (sized(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"), row_hash(docs.select(*[F.col(f"`{c}`") for c in carry])).alias("carried_hash")) if carry else narrow).withColumn("range", F.substring("key", 1, digits))
    ranges = narrow.withColumn("range", F.substring("key", 1, digits)).groupBy("name", "source", "range").agg(F.sum("size").alias("range_size"))
    totals = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = source_targets(totals, weights).withColumn("name", name).drop("source")
    order = W.partitionBy("name").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    placed = ranges.drop("source").withColumn("offset", F.coalesce(F.sum("range_size").over(order), F.lit(0))).join(targets, "name").drop("range_size")
    inside = W.partitionBy("name", "range").orderBy("key", F.col("doc_id").cast("long").asc_nulls_last(), "size", "tie", *last).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(placed, ["name", "range"])
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - F.col("whole") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least("size", rest - F.col("offset") - F.col("inside")))
    out = rows.withColumn("whole", whole).withColumn("taken", (F.col("whole") * F.col("size") + part).cast("long"))
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken", *["carried"] * bool(carry))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them: a row of which taken words are taken stays ceil(taken / size) times.

    Rows of which nothing is taken go, so texts without words do. All columns of docs stay, whatever their names, and a
    repeated row is taken for itself. An empty table stays empty.
    """
    mixed = mix(docs, carry=tuple(docs.columns), **options).filter("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return mixed.select("carried", F.explode(F.sequence(F.lit(1), times)).alias("epoch")).select("carried.*")


ORACLE = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size, md5('mix:' || doc_id::varchar) k from documents
), s as (
  select source, sum(size)::bigint source_size, row_number() over (order by source asc nulls last) n from d group by source
), c as (
  select *, [1.0, 2.0, 3.0][((n - 1) % 3)::int + 1]::double weight, 3.0::double * source_size cap from s
), l as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, n rows between unbounded preceding and 1 preceding), 0.0))
    / sum(weight) over (order by cap / weight, n rows between current row and unbounded following) level from c
), f as (
  select *, (select first(level order by cap / weight, n) from l where level * weight <= cap) common from l
), t as (
  select source, source_size, least(cap, coalesce(common * weight, cap))::double target from f
), p as (
  select d.*, coalesce(sum(size) over (partition by source order by k, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint before from d
)
select doc_id, size, source_size, target,
  (case when source_size > 0 then round(target)::bigint // source_size else 0 end * size
   + greatest(0, least(size, round(target)::bigint - case when source_size > 0 then round(target)::bigint // source_size else 0 end * source_size - before)))::bigint taken
from p join t on p.source is not distinct from t.source
"""

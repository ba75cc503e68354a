"""Small helpers that the corpus operators share: lineage cuts, range splitters, joins with hot keys, components."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import cut, shared_folder

__all__ = ["MAX_LONG", "Shelf", "code_points", "components", "cut", "fair_share", "hot_join", "maybe_in", "numbered", "range_of", "row_hash", "shared_folder", "shuffle_partitions", "splitters"]

MAX_LONG = 2**63 - 1
BITMAP_WORDS = 1 << 18


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns, to order rows that agree in everything that an operator looks at."""
    hashable = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    return F.xxhash64(*[hashable(f) for f in df.schema.fields]) if df.columns else F.lit(0).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def code_points(text: Column) -> Column:
    return F.char_length(text).cast("long")


def splitters(df: DataFrame, key: Column, tie: Column, n: int, per_range: int = 32, seed: int = 11) -> list[tuple[str, int]]:
    """At most n - 1 sampled cut points of the order (key, tie), for n ranges with about as many rows each.

    key is a string, tie a long, neither null. The sample holds about n * per_range rows of these two, whatever the table's size.
    """
    total = df.count()
    if n <= 1 or not total:
        return []
    picked = df.select(key.alias("k"), tie.alias("t"))
    want = n * per_range
    # sampling comes before the key is computed, so only sampled rows pay for it
    if total > want:
        picked = df.sample(fraction=min(1.0, 1.2 * want / total), seed=seed).select(key.alias("k"), tie.alias("t"))
    found = sorted((r.k, r.t) for r in picked.collect())
    if not found:
        return []
    return sorted({found[len(found) * i // n] for i in range(1, n)})


def range_of(key: Column, tie: Column, cuts: list[tuple[str, int]]) -> Column:
    """The number of cut points at or below (key, tie), by binary search."""
    if not cuts:
        return F.lit(0)
    kind = T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("t", T.LongType())]))
    table = F.from_json(F.lit(json.dumps([{"k": k, "t": t} for k, t in cuts])), kind)
    own = F.struct(key.alias("k"), tie.alias("t"))

    def step(s: Column, _: Column) -> Column:
        # the table is a constant and stays out of the state, which is copied at every step
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.get(table, mid) <= s["own"]
        return F.when(
            s["lo"] < s["hi"], F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid).alias("hi"), s["own"].alias("own"))
        ).otherwise(s)

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"), own.alias("own"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), start, step, lambda s: s["lo"])


def fair_share(spark: SparkSession, total: int) -> int:
    """The rows that one key may send to one task: an eighth of an even share of total, and no less than 1,000."""
    return max(1000, total // (8 * shuffle_partitions(spark)))


def hot_join(big: DataFrame, small: DataFrame, key: str, n: str, share: int, spread: Column, how: str = "inner") -> DataFrame:
    """big joined with small on key, where one key may hold a large share of big.

    small has one row a key and the number n of big's rows that have it. Keys of more than share rows are dealt out over
    n / share salts; as the counts add up to big's rows, such keys are fewer than rows / share, a bounded table that is broadcast.
    """
    salts = F.ceil(F.col(n) / share).cast("int")
    hot = small.filter(F.col(n) > share).select(F.col(key).alias("_hot"), salts.alias("_salts"))
    big = big.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    big = big.withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"))).drop("_hot", "_salts")
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(n) > share, salts - 1).otherwise(0))))
    return big.join(small, [key, "_salt"], how).drop("_salt")


def maybe_in(rows: DataFrame, keys: DataFrame, key: str, words: int = BITMAP_WORDS) -> DataFrame:
    """rows with `_maybe`: false only if the key is none of keys.

    A bitmap of at most `words` 64-bit words is broadcast, whatever the number of keys; rows that it leaves out need no
    shuffle to learn that. Once it is full, all rows pass it, and the join behind it decides alone.
    """
    hashed = F.xxhash64(F.col(key))
    word, bit = F.pmod(F.shiftrightunsigned(hashed, 6), F.lit(words)), (hashed.bitwiseAND(F.lit(63))).cast("int")
    one = F.expr("shiftleft(1L, _bit)")
    table = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(one).alias("_bits"))
    joined = rows.withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(table), "_word", "left")
    return joined.withColumn("_maybe", F.coalesce(F.expr("(shiftrightunsigned(_bits, _bit) & 1L) = 1L"), F.lit(False))).drop("_word", "_bit", "_bits")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b), root being the smallest node that it reaches.

    Alternating large-star and small-star rounds: every round connects a node's neighbours to its smallest one, by a
    pre-aggregated minimum and a join whose skewed partitions Spark splits (adaptive skew join); no adjacency list is
    ever gathered. All rounds run the same small plans.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        near = both.join(low, "a")
        if large:
            near = near.filter("b > a")
        else:
            near = near.unionByName(low.select("a", F.col("a").alias("b"), "m"))
        return near.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    now, seen = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()), None
    for _ in range(max_rounds):
        # kept after every step: each plan names its input several times
        now = cut(star(cut(star(now, True)), False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


class Shelf:
    """Narrow tables of one job, kept as Parquet in a folder of the shared place.

    A table that is used more than once, or that a later step must see unchanged after an executor is lost, goes there.
    `drop` deletes what the job's result doesn't read; the rest stays until its owner deletes `path`.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self._n = spark, f"{shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}", 0
        self._places: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        place = f"{self.path}/{self._n}"
        df.write.parquet(place)
        table = self.spark.read.schema(df.schema).parquet(place)
        self._places.append((table, place))
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table, place in self._places:
            if any(table is t for t in tables):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(place)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, keys: list[str], shelf: Shelf) -> DataFrame:
    """df with `at`, its row numbers from 0 in the order of keys, as a kept table.

    Spark range-partitions and sorts the rows; rows that agree in all keys are cut into ranges by the place that they were
    read from. The rows of each range are counted, and sums over the ranges (one row a partition) give each its first number.
    """
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    # the number that Spark gives is made of the range's own and the row's place in it
    dealt = rows.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    placed = shelf.keep(dealt.withColumn("_at", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("n"))
    before = W.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    own = placed.withColumn("_range", F.shiftright("_at", 33))
    return own.join(F.broadcast(starts), "_range").withColumn("at", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_range", "_start", "_at")

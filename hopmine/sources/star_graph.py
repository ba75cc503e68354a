"""Typed graphs out of all rows of the star-schema tables.

The whole graph has regions, nations, suppliers, customers, parts and brands. The graph of places leaves parts and brands
out: it is the one whose connected sets of three are listed, since there are as many of them in the whole graph as the
sum of the squared degrees. Trades link nations with nations: for each lane (return flag and line status) the nation that
a nation's suppliers sell most lines to, and the one that its customers buy most lines from. So nations have parallel
relationships in both directions, relationships to themselves, and triangles with each other and with regions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import uuid5
from .shared import cut


def clamp(x):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def entities(spark: SparkSession, sf_dir: str, places: bool = False) -> DataFrame:
    """(name, type, description), one row a name."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = [
        t("region").select(F.col("r_name").alias("name"), F.lit("LOCATION").alias("type")),
        t("nation").select(F.col("n_name").alias("name"), F.lit("LOCATION").alias("type")),
        t("supplier").select(F.col("s_name").alias("name"), F.lit("ORGANIZATION").alias("type")),
        t("customer").select(F.col("c_name").alias("name"), F.lit("PERSON").alias("type")),
        t("part").select(F.concat(F.lit("Part#"), F.col("p_partkey").cast("string")).alias("name"), F.lit("PRODUCT").alias("type")),
        t("part").select(F.col("p_brand").alias("name"), F.lit("ARTIFACT").alias("type")).distinct(),
    ]
    out = reduce(DataFrame.unionByName, parts[:4] if places else parts)
    return out.withColumn("description", F.concat("name", F.lit(" is a "), F.lower("type")))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, description, weight, position): each nation's main buyer and main seller in each lane; weight is their share of the nation's lines, and rows are in the order of their lines, most first."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # keys only, orders with their customers first: lines are shuffled once, and counted by keys before names join
    lines = t("lineitem").select("l_orderkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("lane")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    orders = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    keyed = lines.select("l_orderkey", "s_nationkey", "lane").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("s_nationkey", "c_nationkey", "lane").agg(F.count("*").alias("n"))
    named = lambda key, name: t("nation").select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name))
    counts = keyed.join(named("s_nationkey", "seller"), "s_nationkey").join(named("c_nationkey", "buyer"), "c_nationkey").groupBy("seller", "buyer", "lane").agg(F.sum("n").alias("n"))
    # both ways of it are read
    counts = cut(counts)

    def main(one: str, other: str, verb: str) -> DataFrame:
        best = counts.groupBy(one, "lane").agg(F.min(F.struct(-F.col("n"), F.col(other).alias("o"))).alias("b"), F.sum("n").alias("all"))
        said = F.concat(F.col(one), F.lit(f" {verb} "), F.col("b.o"), F.lit(" in lane "), "lane")
        return best.select(F.col(one).alias("source"), F.col("b.o").alias("target"), said.alias("description"), (-F.col("b.col1") / F.col("all")).alias("weight"), F.col("b.col1").alias("position"))

    # a few rows for each nation, read again in every step of a query
    return cut(main("seller", "buyer", "sells most to").unionByName(main("buyer", "seller", "buys most from")))


def relationships(spark: SparkSession, sf_dir: str, places: bool = False, with_trades: bool | None = None, among: DataFrame | None = None) -> DataFrame:
    """(id, source, target, description, weight, position); trades are among them by default in the graph of places only.

    position is the order of the rows of one source and target. Of entities `among` (name), if given: those between two of
    them. All lines are read then too, but those of other parts go before repeats are looked for.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nation, region, supplier = t("nation"), t("region"), t("supplier")
    part_name = lambda c: F.concat(F.lit("Part#"), F.col(c).cast("string"))
    name = lambda c: F.col(c)
    lines = t("lineitem").select("l_suppkey", part_name("l_partkey").alias("part"), F.col("l_discount").cast("double").alias("d"))
    if among is not None:
        lines = lines.join(among.withColumnRenamed("name", "part"), "part", "left_semi")
    lines = lines.groupBy("l_suppkey", "part").agg(F.max("d").alias("d"))
    parts = [
        nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(name("n_name").alias("source"), name("r_name").alias("target"), F.lit(1.0).alias("weight")),
        supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(name("s_name").alias("source"), name("n_name").alias("target"), clamp(F.col("s_acctbal").cast("double") / 10000).alias("weight")),
        t("customer").join(nation, F.col("c_nationkey") == nation["n_nationkey"]).select(name("c_name").alias("source"), name("n_name").alias("target"), clamp(F.col("c_acctbal").cast("double") / 10000).alias("weight")),
        lines.join(supplier, lines["l_suppkey"] == supplier["s_suppkey"]).select(name("s_name").alias("source"), F.col("part").alias("target"), clamp(F.col("d") * 10).alias("weight")),
        t("part").select(part_name("p_partkey").alias("source"), name("p_brand").alias("target"), clamp(F.col("p_size").cast("double") / 50).alias("weight")),
    ]
    out = reduce(DataFrame.unionByName, parts[:3] if places else parts)
    out = out.withColumn("description", F.concat("source", F.lit(" is linked to "), "target")).withColumn("position", F.lit(0).cast("long"))
    if places if with_trades is None else with_trades:
        out = out.unionByName(trades(spark, sf_dir))
    if among is not None:
        out = out.join(among.withColumnRenamed("name", "source"), "source", "left_semi").join(among.withColumnRenamed("name", "target"), "target", "left_semi")
    return out.withColumn("id", uuid5(F.concat(F.lit("relation:"), F.concat_ws("\u0000", "source", "target", "description"))))


_ENDS = """
    select r_name name, 'LOCATION' type from region union all select n_name, 'LOCATION' from nation
    union all select s_name, 'ORGANIZATION' from supplier union all select c_name, 'PERSON' from customer"""
_LINKS = """
    select n_name source, r_name target, 1.0::double weight from nation join region on n_regionkey = r_regionkey
    union all select s_name, n_name, greatest(0.0, least(1.0, s_acctbal::double / 10000)) from supplier join nation on s_nationkey = n_nationkey
    union all select c_name, n_name, greatest(0.0, least(1.0, c_acctbal::double / 10000)) from customer join nation on c_nationkey = n_nationkey"""
_MORE_ENDS = """
    union all select 'Part#' || p_partkey::varchar, 'PRODUCT' from part union all select distinct p_brand, 'ARTIFACT' from part"""
_MORE_LINKS = """
    union all select s_name, 'Part#' || l_partkey::varchar, greatest(0.0, least(1.0, max(l_discount::double) * 10)) from lineitem join supplier on l_suppkey = s_suppkey group by s_name, l_partkey
    union all select 'Part#' || p_partkey::varchar, p_brand, greatest(0.0, least(1.0, p_size::double / 50)) from part"""


_TRADES = """
    union all select seller, b.o, seller || ' sells most to ' || b.o || ' in lane ' || lane, b.n / total, -b.n from (select seller, lane, first({'o': buyer, 'n': n} order by n desc, buyer) b, sum(n) total from trade_counts group by all)
    union all select buyer, b.o, buyer || ' buys most from ' || b.o || ' in lane ' || lane, b.n / total, -b.n from (select buyer, lane, first({'o': seller, 'n': n} order by n desc, seller) b, sum(n) total from trade_counts group by all)"""
_TRADE_COUNTS = """
trade_counts as (select x.n_name seller, y.n_name buyer, l_returnflag || l_linestatus lane, count(*) n from lineitem join supplier on l_suppkey = s_suppkey join nation x on s_nationkey = x.n_nationkey
  join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation y on c_nationkey = y.n_nationkey group by all),"""


def _sql(ends: str, links: str, trades: bool = False) -> str:
    return f"""
{_TRADE_COUNTS if trades else ''}
ents as (select name, type, name || ' is a ' || lower(type) description from ({ends})),
rels as (select source, target, source || ' is linked to ' || target description, weight, 0::bigint ord from ({links}){_TRADES if trades else ''}),
und as (select distinct a, b from (select source a, target b from rels union all select target, source from rels) where a <> b)
"""


#: The same tables as SQL common table expressions.
SQL, PLACES_SQL = _sql(_ENDS + _MORE_ENDS, _LINKS + _MORE_LINKS), _sql(_ENDS, _LINKS, trades=True)
WHOLE_SQL = _sql(_ENDS + _MORE_ENDS, _LINKS + _MORE_LINKS, trades=True)

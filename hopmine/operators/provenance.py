"""Source passages behind paths, under unit and token budgets.

Paths are (path_id, path); relationships and entities carry text_unit_ids; `position` gives the file order of relationships.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import cut
from .paths import hops_of

#: Units of a path that one round of a budgeted selection looks at.
PER_ROUND = 64


def hop_relations(hops: DataFrame, relationships: DataFrame, directed: bool = False) -> DataFrame:
    """hops (.., a, b) with the relationship rows from a to b, or in either direction; a self-loop once."""
    forward = hops.join(relationships, (F.col("a") == F.col("source")) & (F.col("b") == F.col("target")))
    if directed:
        return forward
    back = hops.join(relationships, (F.col("b") == F.col("source")) & (F.col("a") == F.col("target")) & (F.col("a") != F.col("b")))
    return forward.unionByName(back)


def ranked_units(paths: DataFrame, relationships: DataFrame, entities: DataFrame, directed: bool = False, entity_context: bool = True) -> DataFrame:
    """(path_id, unit_id, rank): units of relationships hop by hop, then those of entities in path order, each at its first place.

    Only ids are shuffled here; texts join after selection.
    """
    rel = hop_relations(hops_of(paths), relationships, directed).select("path_id", F.lit(0).alias("section"), "hop", "position", F.posexplode("text_unit_ids").alias("pos", "unit_id"))
    rows = rel
    if entity_context:
        nodes = paths.select("path_id", F.posexplode("path").alias("hop", "name")).join(entities.select("name", "text_unit_ids"), "name")
        rows = rel.unionByName(nodes.select("path_id", F.lit(1).alias("section"), "hop", F.lit(0).cast(rel.schema["position"].dataType).alias("position"), F.posexplode("text_unit_ids").alias("pos", "unit_id")))
    firsts = rows.groupBy("path_id", "unit_id").agg(F.min(F.struct("section", "hop", "position", "pos")).alias("ord"))
    return firsts.select("path_id", "unit_id", F.row_number().over(W.partitionBy("path_id").orderBy("ord")).alias("rank"))


def selected_units(ranked: DataFrame, units: DataFrame, max_units: int | None = None, max_tokens: int | None = None, per_round: int = PER_ROUND) -> DataFrame:
    """(path_id, unit_id, n_tokens, pos): units in rank order up to max_units, skipping any that would pass max_tokens.

    With a token budget paths take their units in rounds. Of the units that still fit by themselves, a path looks at the
    first per_round by rank and takes those in front of the first one that doesn't fit with them; what is left over is
    what fits into the rest of the budget behind them, and a path without any leaves. A path carries its tokens and its
    number of units only, however many units its entities have. Units of a null or no size count 0 tokens.
    """
    sized = ranked.join(units.select(F.col("id").alias("unit_id"), F.greatest(F.lit(0), F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens")), "unit_id")
    if max_tokens is None:
        kept = sized if max_units is None else sized.filter(F.col("rank") <= max_units)
        return kept.select("path_id", "unit_id", F.col("n_tokens").cast("int").alias("n_tokens"), F.col("rank").alias("pos"))
    most = max_units if max_units is not None else (1 << 31) - 1
    none = F.lit(0).cast("long")
    left = cut(sized.filter((F.col("n_tokens") <= max_tokens) & F.lit(most > 0)).select("path_id", "unit_id", "n_tokens", "rank", none.alias("used"), none.alias("had")))
    taken = left.limit(0).select("path_id", "unit_id", "n_tokens", F.col("rank").cast("long").alias("pos"))
    by_rank = W.partitionBy("path_id").orderBy("rank")
    while left.limit(1).count():
        # Spark cuts a path down to its first units before it shuffles them
        looked = left.withColumn("i", F.row_number().over(by_rank)).filter(F.col("i") <= per_round)
        fits = (F.col("used") + F.sum("n_tokens").over(by_rank.rowsBetween(W.unboundedPreceding, 0)) <= max_tokens) & (F.col("had") + F.col("i") <= most)
        new = cut(looked.withColumn("fits", fits).filter("fits").select("path_id", "unit_id", "n_tokens", "rank", (F.col("had") + F.col("i")).alias("pos")))
        taken = taken.unionByName(new.drop("rank"))
        state = new.groupBy("path_id").agg(F.sum("n_tokens").alias("more"), F.count("*").alias("n"), F.max("rank").alias("upto"))
        rest = left.join(state, "path_id").filter(F.col("rank") > F.col("upto")).withColumn("used", F.col("used") + F.col("more")).withColumn("had", F.col("had") + F.col("n"))
        left = cut(rest.filter((F.col("used") + F.col("n_tokens") <= max_tokens) & (F.col("had") < most)).select(*left.columns))
    return taken.select("path_id", "unit_id", F.col("n_tokens").cast("int").alias("n_tokens"), F.col("pos").cast("int").alias("pos"))


def titled(units: DataFrame, documents: DataFrame) -> DataFrame:
    """(unit_id, titles): titles of a unit's documents in order; a null title is a document that is unknown."""
    each = units.select(F.col("id").alias("unit_id"), F.posexplode("document_ids").alias("pos", "doc"))
    named = each.join(documents.select(F.col("id").alias("doc"), F.coalesce("title", F.lit("")).alias("title")), "doc", "left")
    return named.groupBy("unit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda s: s["title"]).alias("titles"))


def path_tags(selected: DataFrame, paths: DataFrame, units: DataFrame, entities: DataFrame, relationships: DataFrame, directed: bool = False) -> DataFrame:
    """(path_id, unit_id, path_entities, path_relationships) of selected units: what a unit names of the path, in the unit's order.

    path_relationships are (source, target) of the relationships behind the path's hops. A unit that names nothing has empty lists.
    """
    kept = selected.select("path_id", "unit_id")
    named = kept.join(units.select(F.col("id").alias("unit_id"), F.posexplode("entity_ids").alias("pos", "eid")), "unit_id").join(entities.select(F.col("id").alias("eid"), "name"), "eid")
    on_path = named.join(paths.select("path_id", F.explode(F.array_distinct("path")).alias("name")), ["path_id", "name"])
    ents = on_path.groupBy("path_id", "unit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]).alias("path_entities"))
    behind = hop_relations(hops_of(paths), relationships, directed).select("path_id", F.col("id").alias("rid"), "source", "target").distinct()
    linked = kept.join(units.select(F.col("id").alias("unit_id"), F.posexplode("relationship_ids").alias("pos", "rid")), "unit_id").join(behind, ["path_id", "rid"])
    rels = linked.groupBy("path_id", "unit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source", "target"))), lambda s: F.struct(s["source"].alias("source"), s["target"].alias("target"))).alias("path_relationships"))
    both = kept.join(ents, ["path_id", "unit_id"], "left").join(rels, ["path_id", "unit_id"], "left")
    return both.withColumn("path_entities", F.coalesce("path_entities", F.array().cast("array<string>"))).withColumn("path_relationships", F.coalesce("path_relationships", F.array().cast("array<struct<source:string,target:string>>")))


def rendered(selected: DataFrame, units: DataFrame, documents: DataFrame) -> DataFrame:
    """(path_id, context): numbered passages with titles and unit ids, a blank line between."""
    texts = selected.join(units.select(F.col("id").alias("unit_id"), "text"), "unit_id").join(titled(units, documents), "unit_id", "left")
    names = F.array_join(F.coalesce("titles", F.array().cast("array<string>")), ", ")
    head = F.concat(F.lit("[Source "), F.col("pos").cast("string"), F.lit(" | "), F.when(names == "", F.lit("unknown document")).otherwise(names), F.lit(" | text_unit="), "unit_id", F.lit("]\n"), "text")
    return texts.withColumn("block", head).groupBy("path_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda s: s["block"]), "\n\n").alias("context"))


def merged_sources(selected: DataFrame) -> DataFrame:
    """(question_id, number, unit_id, supports_hops) of (question_id, hop, unit_id, pos): distinct units in first-seen order with the sorted hops they support."""
    per = selected.groupBy("question_id", "unit_id").agg(F.min(F.struct("hop", "pos")).alias("ord"), F.sort_array(F.collect_set("hop")).alias("supports_hops"))
    return per.select("question_id", F.row_number().over(W.partitionBy("question_id").orderBy("ord")).alias("number"), "unit_id", "supports_hops")


def lookup_failures(paths: DataFrame, relationships: DataFrame, entities: DataFrame, units: DataFrame, documents: DataFrame) -> DataFrame:
    """(path_id, reason, what): unknown entities, hops without a relationship, unknown units, unknown documents."""
    nodes = paths.select("path_id", F.explode("path").alias("name"))
    unknown = nodes.join(entities.select("name"), "name", "left_anti").select("path_id", F.lit("unknown entity").alias("reason"), F.col("name").alias("what"))
    hops = hops_of(paths)
    linked = hop_relations(hops, relationships)
    bare = hops.join(linked.select("path_id", "hop"), ["path_id", "hop"], "left_anti").select("path_id", F.lit("no relationship").alias("reason"), F.concat_ws(" > ", "a", "b").alias("what"))
    asked = linked.select("path_id", F.explode("text_unit_ids").alias("id")).distinct()
    lost = asked.join(units.select("id"), "id", "left_anti").select("path_id", F.lit("unknown text unit").alias("reason"), F.col("id").alias("what"))
    docs = asked.join(units.select("id", F.explode("document_ids").alias("doc")), "id")
    gone = docs.join(documents.select(F.col("id").alias("doc")), "doc", "left_anti").select("path_id", F.lit("unknown document").alias("reason"), F.col("doc").alias("what"))
    return unknown.unionByName(bare).unionByName(lost).unionByName(gone).distinct()

"""Corpus to graph: chunks, parsed extraction responses, merged entities and relationships, membership arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import uuid5
from ..functions.plugins import Coder, coded_windows
from ..functions.text import json_object, strip

RESPONSE = "struct<entities:array<struct<name:string,type:string,description:string>>,relationships:array<struct<source:string,target:string,description:string,weight:string>>,claims:array<struct<subject:string,description:string>>>"

#: Documents whose first words about a name are joined before the pieces are.
PIECE_DOCS = 1000


def chunks(docs: DataFrame, size: int = 1200, overlap: int = 100, unit: str | Coder = "char") -> DataFrame:
    """(document_id, chunk, id, text, n_tokens) of sliding windows over each text, starting every size - overlap tokens.

    Tokens are characters, white-space words or UTF-8 bytes (`char`, `word`, `byte`), or those of a caller's coder. In bytes, incomplete characters at a window's edges are
    dropped and n_tokens counts what is left. The last window may lie inside the one before; empty texts have none.
    """
    if size < 2 or not 0 <= overlap < size:
        raise ValueError("size must be at least 2 and overlap in [0, size)")
    step = size - overlap
    if callable(unit):
        return _named(coded_windows(docs, unit, size, step))
    if unit == "byte":
        return _byte_chunks(docs, size, step)
    tokens = F.col("raw_content") if unit == "char" else F.filter(F.split("raw_content", r"\s+"), lambda w: w != "")
    length = F.char_length("raw_content") if unit == "char" else F.size("tokens")
    rows = docs.select(F.col("id").alias("document_id"), "raw_content", *[tokens.alias("tokens")] * (unit == "word")).withColumn("n", length).filter("n > 0")
    cut = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step))).alias("start"))
    text = F.substring("raw_content", F.col("start") + 1, F.lit(size)) if unit == "char" else F.array_join(F.slice("tokens", F.col("start") + 1, F.lit(size)), " ")
    count = F.least(F.lit(size), F.col("n") - F.col("start"))
    return _named(cut.select("document_id", (F.col("start") / step).cast("int").alias("chunk"), text.alias("text"), count.cast("int").alias("n_tokens")))


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", uuid5(F.concat_ws(":", "document_id", F.col("chunk").cast("string"))))


def _byte_chunks(docs: DataFrame, size: int, step: int) -> DataFrame:
    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for doc, text in zip(frame["id"], frame["raw_content"], strict=True):
                raw = (text or "").encode()
                for k, start in enumerate(range(0, len(raw), step)):
                    part = raw[start : start + size].decode("utf-8", "ignore")
                    rows.append((doc, k, part, len(part.encode())))
            yield pd.DataFrame(rows, columns=["document_id", "chunk", "text", "n_tokens"])

    kind = docs.schema["id"].dataType.simpleString()
    return _named(docs.select("id", "raw_content").mapInPandas(run, f"document_id {kind}, chunk int, text string, n_tokens int"))


def parsed(responses: DataFrame) -> DataFrame:
    """responses (unit_id, doc_pos, chunk, pass, response) with `r`, the parsed object; null where the text has none."""
    return responses.withColumn("r", F.from_json(json_object(F.col("response")), RESPONSE))


def rejected(responses: DataFrame) -> DataFrame:
    """(unit_id, pass, reason) of responses without a JSON object."""
    return parsed(responses).filter("r is null").select("unit_id", "pass", F.lit("no JSON object").alias("reason"))


def mentions(parsed_rows: DataFrame, types: list[str]) -> DataFrame:
    """(unit_id, ord, name, type, description) of entity mentions with a name; unknown types become OTHER, or the last type.

    ord is (document position, chunk, pass, item): the order in which a reader meets the mentions.
    """
    known = list(dict.fromkeys(t.upper() for t in types))
    other = "OTHER" if "OTHER" in known else known[-1]
    rows = parsed_rows.select("unit_id", "doc_pos", "chunk", "pass", F.posexplode("r.entities").alias("item", "e"))
    kind = F.upper(strip(F.coalesce("e.type", F.lit(""))))
    return rows.select(
        "unit_id", F.struct("doc_pos", "chunk", "pass", "item").alias("ord"), strip(F.col("e.name")).alias("name"), F.when(kind.isin(known), kind).otherwise(F.lit(other)).alias("type"), strip(F.coalesce("e.description", F.lit(""))).alias("description")
    ).filter("name <> ''")


def entity_units(found: DataFrame) -> DataFrame:
    """(name, unit_id) of the units that mention a name, once each: the working form, one row a link however often a name occurs."""
    return found.select("name", "unit_id").distinct()


def description_pieces(found: DataFrame, docs_per_piece: int = PIECE_DOCS) -> DataFrame:
    """(name, piece, text): the distinct descriptions of a name in first-seen order, those that docs_per_piece documents in a row were the first to give in one piece.

    The long form of descriptions: a name that a third of all chunks mention has many pieces, and no group of rows is larger than
    what the documents of one piece say of it.
    """
    firsts = found.filter("description <> ''").groupBy("name", "description").agg(F.min("ord").alias("ord"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "description"))), lambda s: s["description"]), " ")
    return firsts.groupBy("name", F.floor(F.col("ord.doc_pos") / docs_per_piece).alias("piece")).agg(text.alias("text"))


def merged_entities(found: DataFrame, docs_per_piece: int = PIECE_DOCS) -> DataFrame:
    """(id, name, type, description): the first mention's type, distinct descriptions in first-seen order.

    Descriptions are reduced to their first place per (name, description) and joined into pieces; only pieces meet in a
    name's one value, for tables that want it.
    """
    head = found.groupBy("name").agg(F.min_by("type", "ord").alias("type"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda s: s["text"]), " ")
    said = description_pieces(found, docs_per_piece).groupBy("name").agg(text.alias("description"))
    return head.join(said, "name", "left").select(uuid5(F.concat(F.lit("entity:"), "name")).alias("id"), "name", "type", F.coalesce("description", F.lit("")).alias("description"))


def with_unit_ids(rows: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """rows with text_unit_ids, the sorted units of links (keys, unit_id), for writing the tables out.

    Only here does a name's list become one value: a name may be in as many units as fit one row (2 GB, or some 50 million ids).
    """
    lists = links.groupBy(*keys).agg(F.sort_array(F.collect_list("unit_id")).alias("text_unit_ids"))
    return rows.join(lists, keys, "left").withColumn("text_unit_ids", F.coalesce("text_unit_ids", F.array().cast("array<string>")))


def weight_of(text: Column) -> Column:
    """A weight in [0, 1]: 0.5 where none is given; null where it is no number."""
    given = F.coalesce(text, F.lit("0.5"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), given.try_cast("double")))


def relation_mentions(parsed_rows: DataFrame) -> DataFrame:
    """(unit_id, source, target, description, weight) of relationships with both ends and a description; weight null: a reject."""
    rows = parsed_rows.select("unit_id", F.inline("r.relationships"))
    return rows.select("unit_id", *[strip(F.coalesce(c, F.lit(""))).alias(c) for c in ("source", "target", "description")], weight_of(F.col("weight")).alias("weight")).filter("source <> '' and target <> '' and description <> ''")


KEYS = ["source", "target", "description"]


def relation_units(found: DataFrame) -> DataFrame:
    """(source, target, description, unit_id) of the units behind a relationship, once each."""
    return found.filter("weight is not null").select(*KEYS, "unit_id").distinct()


def merged_relationships(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, source, target, description, weight): the largest weight per key, both ends known."""
    keyed = found.filter("weight is not null").groupBy(*KEYS).agg(F.max("weight").alias("weight"))
    names = entities.select("name")
    both = keyed.join(names, F.col("source") == F.col("name"), "left_semi").join(names, F.col("target") == F.col("name"), "left_semi")
    return both.withColumn("id", uuid5(F.concat(F.lit("relation:"), F.concat_ws("\u0000", *KEYS))))


def memberships(units: DataFrame, found: DataFrame, relations: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """units with entity_ids (by name) and relationship_ids (by key); units without mentions have empty lists."""
    named = found.select("unit_id", "name").distinct().join(entities.select("name", F.col("id").alias("eid")), "name")
    ids = named.groupBy("unit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "eid"))), lambda s: s["eid"]).alias("entity_ids"))
    keyed = relation_units(relations).join(relationships.select(*KEYS, F.col("id").alias("rid")), KEYS)
    rids = keyed.groupBy("unit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*KEYS, "rid"))), lambda s: s["rid"]).alias("relationship_ids"))
    none = F.array().cast("array<string>")
    out = units.join(ids, units["id"] == ids["unit_id"], "left").drop("unit_id").join(rids, units["id"] == rids["unit_id"], "left").drop("unit_id")
    return out.withColumn("entity_ids", F.coalesce("entity_ids", none)).withColumn("relationship_ids", F.coalesce("relationship_ids", none))


def claims(parsed_rows: DataFrame) -> DataFrame:
    """(id, subject, description, text_unit_ids): one row a claim, under an id from its place."""
    rows = parsed_rows.select("unit_id", "pass", F.posexplode("r.claims").alias("item", "c"))
    return rows.select(uuid5(F.concat_ws(":", F.lit("claim"), "unit_id", "pass", "item")).alias("id"), F.col("c.subject").alias("subject"), F.col("c.description").alias("description"), F.array("unit_id").alias("text_unit_ids"))


def extraction_prompts(units: DataFrame, passes: int, types: list[str], with_claims: bool = False) -> DataFrame:
    """(unit_id, pass, key) of every unit and pass."""
    from ..sources.tables import prompt_key

    each = units.select(F.col("id").alias("unit_id"), "text", F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("pass"))
    return each.select("unit_id", "pass", "text", prompt_key(F.col("pass").cast("string"), F.to_json(F.array(*[F.lit(t) for t in types])), F.lit(str(with_claims).lower()), F.col("text")).alias("key"))


def summary(**tables: DataFrame) -> DataFrame:
    """(name, n_rows) of each table."""
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out

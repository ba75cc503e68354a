"""Queries over documents: upsert, prompt digests, chunks, and the graph that a rule extractor makes of them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.ids import uuid5
from ..operators import generation as H
from ..operators import index as B
from ..operators.paths import valid_edges
from ..sources import star_graph
from ..sources import tables as T
from ..sources.shared import cut, shared_folder
from ..sources.store import ResponseStore
from .base import query, table

TYPES = ["person", "organization", "location", "event", "other"]
NAME = "[A-Z][a-z]{3,}"


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.coalesce("text", F.lit("")).alias("raw_content"))


def _own_folder(spark, name):
    """A new folder in the shared place."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    """select 'entities' "table", name key, type value from ents union all select 'relationships', source || '>' || target, description from rels""",
    graph=True,
)
def a1_graph_tables(spark, d):
    """The star graph written as graph tables and read again under their schemas."""
    folder, none = _own_folder(spark, "graph"), F.array().cast("array<string>").alias("text_unit_ids")
    entities = star_graph.entities(spark, d).select(uuid5(F.concat(F.lit("entity:"), "name")).alias("id"), "*", none)
    T.write_tables({"entities": entities, "relationships": star_graph.relationships(spark, d).select("*", none)}, folder)
    back = {name: spark.read.schema(T.SCHEMAS[name]).parquet(f"{folder}/{name}.parquet") for name in ("entities", "relationships")}
    rows = back["entities"].select(F.lit("entities").alias("table"), F.col("name").alias("key"), F.col("type").alias("value"))
    return rows.unionByName(back["relationships"].select(F.lit("relationships").alias("table"), F.concat_ws(">", "source", "target").alias("key"), F.col("description").alias("value")))


@query("select doc_id, md5(coalesce(text, '')) digest, source title from documents")
def a5_json_records(spark, d):
    """All documents written as JSON records and read again; other scripts stay as they are."""
    folder = _own_folder(spark, "records")
    T.write_records(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("title")), folder)
    return spark.read.schema("doc_id long, text string, title string").json(folder).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"), "title")


@query(
    """with b as (select distinct doc_id from labels) select doc_id::varchar id, case when b.doc_id is null then source else 'new ' || source end title, (b.doc_id is not null)::int is_new
    from documents left join b using (doc_id)"""
)
def a6_upsert(spark, d):
    """Labelled documents come again under a new title."""
    docs = _docs(spark, d).select("id", "title")
    batch = docs.join(table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id")).distinct(), "id", "left_semi").withColumn("title", F.concat(F.lit("new "), "title"))
    return T.upsert(docs, batch)


@query(
    """with p as (select doc_id, sha256('extract' || chr(0) || coalesce(text, '')) key from documents), r as (select distinct key from p join labels using (doc_id))
    select distinct key from p where key not in (select key from r)"""
)
def a7_pending_prompts(spark, d):
    """Prompts of all documents whose text has no response; labelled documents have theirs."""
    prompts = table(spark, d, "documents").select("doc_id", T.prompt_key(F.lit("extract"), F.coalesce("text", F.lit(""))).alias("key"))
    responses = prompts.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return T.pending_prompts(prompts, responses).select("key")


@query(
    """with p as (select distinct doc_id, sha256('extract' || chr(0) || coalesce(text, '')) key from documents), r as (select distinct key from p join labels using (doc_id))
    select distinct key, case when key in (select key from r) then md5(key) end response from p"""
)
def a7_response_store(spark, d):
    """All prompts with their stored responses: those of labelled documents are stored, twice over, then those still pending are asked for."""
    prompts = table(spark, d, "documents").select("doc_id", T.prompt_key(F.lit("extract"), F.coalesce("text", F.lit(""))).alias("key"))
    store = ResponseStore(spark, _own_folder(spark, "responses"))
    first = prompts.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("key", F.md5("key").alias("response"))
    store.append(first)
    # the job again, with other answers: nothing is stored twice
    store.append(first.withColumn("response", F.lit("!")))
    waiting = store.pending(prompts).select("key", F.lit(None).cast("string").alias("response"))
    return waiting.unionByName(store.answered(prompts.select("key").distinct()).select("key", "response"))


@query("select p_name, count(*) n from part group by 1 having count(*) > 1")
def a8_repeated_keys(spark, d):
    return T.repeated_keys(table(spark, d, "part"), "p_name")


@query("select doc_id, coalesce(max(quality)::varchar, '') ids from documents left join labels using (doc_id) group by 1")
def a9_id_lists(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")), "doc_id", "left")
    return joined.select("doc_id", F.array_join(T.id_list(F.col("q"), "int"), ",").alias("ids"))


@query("select source, target from rels where source in (select name from ents where type <> 'ARTIFACT') and target in (select name from ents where type <> 'ARTIFACT')", graph=True)
def a10_valid_edges(spark, d):
    e = star_graph.entities(spark, d).filter("type <> 'ARTIFACT'")
    return valid_edges(star_graph.relationships(spark, d), e).select("source", "target")


@query(
    """with s as (select p_brand structure_id, case when max(p_size) = 50 then 'approved' end review_status from part group by 1),
    x as (select p_brand structure_id, p_partkey example_id, p_size > 45 and p_partkey % 2 = 0 ok from part union all select null, p_partkey, p_size > 48 and p_partkey % 7 = 0 from part),
    o as (select s.structure_id, example_id, 'own' source from s join x using (structure_id) where review_status = 'approved' and ok)
    select * from o union all select s.structure_id, example_id, 'general' from s, x where review_status = 'approved' and x.structure_id is null and ok and s.structure_id not in (select structure_id from o)"""
)
def a11_approved_catalogue(spark, d):
    """Brands stand for structures, parts for examples; a few parts are general examples."""
    part = table(spark, d, "part")
    structures = part.groupBy(F.col("p_brand").alias("structure_id")).agg(F.when(F.max("p_size") == 50, "approved").alias("review_status"))
    approved = lambda size, k: F.when((F.col("p_size") > size) & (F.col("p_partkey") % k == 0), "approved").alias("review_status")
    own = part.select(F.col("p_brand").alias("structure_id"), F.col("p_partkey").alias("example_id"), approved(45, 2))
    general = part.select(F.lit(None).cast("string").alias("structure_id"), F.col("p_partkey").alias("example_id"), approved(48, 7))
    return H.approved_examples(structures, own.unionByName(general)).select("structure_id", "example_id", "source")


@query("select item_id, text question, null::boolean answerable, null::boolean multi_hop from benchmark order by md5('79:' || item_id::varchar), item_id limit 20")
def a12_evaluation_sample(spark, d):
    """20 items in a seeded order; the number is the operator's argument."""
    return H.evaluation_sample(table(spark, d, "benchmark").select("item_id", F.col("text").alias("question")), 20, 79)


@query(
    """with p as (select item_id, text question, string_split(text, ', ') parts from benchmark order by md5('44:' || item_id::varchar), item_id limit 20)
    select item_id, 0 pos, question from p union all
    select item_id, i pos, parts[i] question from (select item_id, parts, unnest(range(1, len(parts) + 1)) i from p) where not contains(parts[i], 'an') and not contains(parts[i], '#1')""".replace("not contains(parts[i], 'an')", "not contains(parts[i], '>>')")
)
def a13_decomposed_sample(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"), F.split("text", ", ").alias("parts"))
    return H.decomposed_sample(items, 20, 44)


# -- index -------------------------------------------------------------------------------------------------------------

UUID = "(substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr({h},18,3)||'-'||substr({h},21,12))"
SHA = "sha1('\\x6B\\xA7\\xB8\\x11\\x9D\\xAD\\x11\\xD1\\x80\\xB4\\x00\\xC0\\x4F\\xD4\\x30\\xC8'::blob || encode({k}))"


def uuid_sql(key: str) -> str:
    return UUID.format(h=SHA.format(k=key))


CHUNKS_SQL = f"""
docs as (select doc_id::varchar id, coalesce(text, '') raw from documents),
ch as (select id document_id, (s / 1100)::int chunk, substr(raw, s + 1, 1200) text from (select id, raw, unnest(range(0, length(raw), 1100)) s from docs)),
units as (select *, {uuid_sql("document_id || ':' || chunk::varchar")} unit_id from ch),
nm as (select *, regexp_extract_all(text, '{NAME}') all_names from units),
men as (select unit_id, document_id, chunk, unnest(all_names) name from nm),
ents as (select name, case length(name) % 5 when 0 then 'PERSON' when 1 then 'ORGANIZATION' when 2 then 'LOCATION' else 'OTHER' end type, 'Word of ' || length(name) || ' letters' description, count(*) n_units, bit_xor(('0x' || substr(md5(unit_id), 1, 15))::bigint) units, {uuid_sql("'entity:' || name")} id from (select distinct unit_id, name from men) group by name),
rm as (select unit_id, all_names[1] source, list_filter(all_names, lambda x: x <> all_names[1])[1] target, least(1.0, length(all_names[1]) / 10.0)::double weight from nm),
rels as (select source, target, 'Seen with ' || target description, max(weight) weight, count(*) n_units, bit_xor(('0x' || substr(md5(unit_id), 1, 15))::bigint) units, {uuid_sql("'relation:' || source || chr(0) || target || chr(0) || 'Seen with ' || target")} id from rm where target is not null group by all)
"""


def _units(spark, d, unit="char"):
    return B.chunks(_docs(spark, d), unit=unit)


def _responses(spark, d):
    """Extraction responses by rule: capitalised words are entities, the first two different ones a relationship; every other answer is fenced."""
    u = _units(spark, d)
    names = F.regexp_extract_all("text", F.lit(f"({NAME})"), 1)
    rows = u.select(F.col("id").alias("unit_id"), F.col("document_id").cast("long").alias("doc_pos"), "chunk", F.lit(1).alias("pass"), names.alias("names"))
    kinds = F.array(*[F.lit(t) for t in ("person", " Organization ", "location", "weird", "other")])
    entities = F.transform("names", lambda n: F.struct(n.alias("name"), F.get(kinds, F.char_length(n) % 5).alias("type"), F.concat(F.lit("Word of "), F.char_length(n), F.lit(" letters")).alias("description")))
    other = F.get(F.filter("names", lambda n: n != F.get("names", F.lit(0))), F.lit(0))
    relation = F.struct(F.get("names", F.lit(0)).alias("source"), other.alias("target"), F.concat(F.lit("Seen with "), other).alias("description"), (F.char_length(F.get("names", F.lit(0))) / 10).cast("string").alias("weight"))
    claim = F.array_compact(F.array(F.when(F.size("names") > 0, F.struct(F.get("names", F.lit(0)).alias("subject"), F.lit("starts a passage").alias("description")))))
    body = F.to_json(F.struct(entities.alias("entities"), F.when(other.isNotNull(), F.array(relation)).alias("relationships"), claim.alias("claims")))
    fenced = F.when(F.col("chunk") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), body))
    return u, rows.select("unit_id", "doc_pos", "chunk", "pass", fenced.alias("response"))


def _index(spark, d):
    u, responses = _responses(spark, d)
    # what parsing gives is a table of its own: mentions, relationships and claims all come from it
    parsed = cut(B.parsed(responses))
    found, linked = B.mentions(parsed, TYPES), B.relation_mentions(parsed)
    entities = B.merged_entities(found)
    return u, parsed, found, linked, entities, B.merged_relationships(linked, entities)


@query(f"with {CHUNKS_SQL} select document_id, chunk, unit_id id, length(text) n_tokens, md5(text) digest from units")
def b1_chunks(spark, d):
    return _units(spark, d).select("document_id", "chunk", "id", "n_tokens", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def _letters():
    """A caller's token coder: its tokens are characters."""
    return lambda texts: [list(t) for t in texts], lambda windows: ["".join(w) for w in windows]


@query(f"with {CHUNKS_SQL} select document_id, chunk, unit_id id, length(text) n_tokens, md5(text) digest from units")
def b1_coded_chunks(spark, d):
    """Chunks by a coder that the caller brings."""
    return _units(spark, d, _letters).select("document_id", "chunk", "id", "n_tokens", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query(f"with {CHUNKS_SQL} select document_id, count(*) n_chunks, sum(length(text))::bigint n_tokens from units group by 1")
def b2_token_counts(spark, d):
    return _units(spark, d).groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"))


@query(f"select doc_id, {uuid_sql('doc_id::varchar || chr(58) || source')} id from documents")
def b3_stable_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", uuid5(F.concat_ws(":", F.col("doc_id").cast("string"), "source")).alias("id"))


@query(f"with {CHUNKS_SQL} select unit_id, len(all_names) n_entities from nm")
def b4_parsed_responses(spark, d):
    return B.parsed(_responses(spark, d)[1]).select("unit_id", F.size("r.entities").alias("n_entities"))


@query(f"with {CHUNKS_SQL} select type, count(*) n from men join ents using (name) group by 1")
def b5_mentions(spark, d):
    """Cleaned mentions by coerced type (also the type coercion's query)."""
    return B.mentions(B.parsed(_responses(spark, d)[1]), TYPES).groupBy("type").agg(F.count("*").alias("n"))


def _counted(links, keys):
    """(keys, n_units, units): how many units, and the exclusive or of their digests, which needs no list of them."""
    digest = F.conv(F.substring(F.md5("unit_id"), 1, 15), 16, 10).cast("long")
    return links.groupBy(*keys).agg(F.count("*").alias("n_units"), F.bit_xor(digest).alias("units"))


@query(f"with {CHUNKS_SQL} select id, name, type, description, n_units, units from ents")
def b7_merged_entities(spark, d):
    _, _, found, _, entities, _ = _index(spark, d)
    return entities.join(_counted(B.entity_units(found), ["name"]), "name").select("id", "name", "type", "description", "n_units", "units")


@query(f"with {CHUNKS_SQL} select unit_id, source, target, round(weight, 6) weight from rm where target is not null")
def b8_relation_mentions(spark, d):
    return _index(spark, d)[3].select("unit_id", "source", "target", F.round("weight", 6).alias("weight"))


@query(f"with {CHUNKS_SQL} select id, source, target, description, round(weight, 6) weight, n_units, units from rels")
def b9_merged_relationships(spark, d):
    _, _, _, linked, _, relationships = _index(spark, d)
    return relationships.join(_counted(B.relation_units(linked), B.KEYS), B.KEYS).select("id", *B.KEYS, F.round("weight", 6).alias("weight"), "n_units", "units")


@query(
    f"""with {CHUNKS_SQL}, e as (select unit_id, list(id order by name) l from (select distinct unit_id, name from men) join ents using (name) group by 1),
    r as (select rm.unit_id, list(rels.id) l from rm join rels on rm.source = rels.source and rm.target = rels.target group by 1)
    select unit_id id, md5(array_to_string(coalesce(e.l, []), ',')) entity_ids, md5(array_to_string(coalesce(r.l, []), ',')) relationship_ids from units left join e using (unit_id) left join r using (unit_id)"""
)
def b10_unit_memberships(spark, d):
    u, _, found, linked, entities, relationships = _index(spark, d)
    return B.memberships(u, found, linked, entities, relationships).select("id", F.md5(F.array_join("entity_ids", ",")).alias("entity_ids"), F.md5(F.array_join("relationship_ids", ",")).alias("relationship_ids"))


@query(f"with {CHUNKS_SQL} select all_names[1] subject, count(*) n from nm where len(all_names) > 0 group by 1")
def b11_claims(spark, d):
    return B.claims(_index(spark, d)[1]).groupBy("subject").agg(F.count("*").alias("n"))


@query(f"""with {CHUNKS_SQL} select unit_id, p pass, sha256(p::varchar || chr(0) || '["a","b"]' || chr(0) || 'false' || chr(0) || text) key from units, (select unnest([1, 2]) p)""")
def b12_pass_prompts(spark, d):
    return B.extraction_prompts(_units(spark, d), 2, ["a", "b"]).select("unit_id", "pass", "key")


@query(f"with {CHUNKS_SQL} select 'documents' name, count(*) n_rows from docs union all select 'text_units', count(*) from units union all select 'entities', count(*) from ents union all select 'relationships', count(*) from rels union all select 'claims', count(*) from nm where len(all_names) > 0")
def b13_index_summary(spark, d):
    u, parsed, _, _, entities, relationships = _index(spark, d)
    return B.summary(documents=_docs(spark, d), text_units=u, entities=entities, relationships=relationships, claims=B.claims(parsed))

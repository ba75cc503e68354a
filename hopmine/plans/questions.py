"""Queries for provenance, review, ambiguity, generation and annotations, with canned responses derived from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ambiguity as A
from ..operators import annotations as N
from ..operators import generation as H
from ..operators import paths as P
from ..operators import provenance as E
from ..operators import review as R
from ..functions.text import normal_answer
from ..sources import star_graph
from ..sources.shared import cut
from .base import query, table
from .graph import CHAIN_SQL, _walks

# -- provenance: an edge's place p is a hash of its ends, its units are the documents p mod N and 7 p + 3 mod N ---------------------------------------

UNITS_SQL = f"""{CHAIN_SQL}, docn as (select count(*) n from documents),
er as (select *, ('0x' || substr(md5(source || '|' || target), 1, 13))::bigint position from rels),
ru as (select source, target, position, 0 pos, position % (select n from docn) unit from er union all select source, target, position, 1, (7 * position + 3) % (select n from docn) from er),
hops as (select a || ' > ' || b || ' > ' || c path_id, 1 hop, a s, b t from walks union all select a || ' > ' || b || ' > ' || c, 2, b, c from walks),
rk as (select path_id, unit, row_number() over (partition by path_id order by min([hop, position, pos])) rank from hops join ru on (s = source and t = target) or (s = target and t = source and s <> t) group by path_id, unit),
sized as (select rk.*, length(text) // 4 n_tokens, source title, text from rk join documents on doc_id = unit)"""


def _provenance(spark, d):
    """Entities, relationships with units, units (documents as passages), documents, and the walks."""
    e, r, walks = _walks(spark, d)
    docs = table(spark, d, "documents")
    n = docs.count()
    place = F.conv(F.substring(F.md5(F.concat_ws("|", "source", "target")), 1, 13), 16, 10).cast("long")
    rels = r.withColumn("position", place).withColumn("text_unit_ids", F.array((F.col("position") % n).cast("string"), ((7 * F.col("position") + 3) % n).cast("string")))
    units = docs.select(F.col("doc_id").cast("string").alias("id"), "text", F.floor(F.char_length("text") / 4).cast("int").alias("n_tokens"), F.array(F.col("doc_id").cast("string")).alias("document_ids"))
    documents = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"))
    entities = e.withColumn("text_unit_ids", F.array().cast("array<string>"))
    return entities, rels, units, documents, walks


@query(f", {UNITS_SQL} select path_id, hop, least(source, target) || '|' || greatest(source, target) pair from hops join er on (s = source and t = target) or (s = target and t = source and s <> t)", graph=True)
def e1_hop_relations(spark, d):
    _, r, _, _, walks = _provenance(spark, d)
    return E.hop_relations(P.hops_of(walks), r).select("path_id", "hop", F.concat_ws("|", F.least("source", "target"), F.greatest("source", "target")).alias("pair"))


@query(f", {UNITS_SQL} select path_id, unit::varchar unit_id, rank from rk", graph=True)
def e2_ranked_units(spark, d):
    e, r, _, _, walks = _provenance(spark, d)
    return E.ranked_units(walks, r, e)


@query(
    f""", {UNITS_SQL}, rec as (select path_id, list({{'u': unit::varchar, 'n': n_tokens}} order by rank) l from sized group by 1),
    f as (select path_id, list_reduce(list_concat([{{'u': '', 'n': 0}}], l), lambda s, x: case when s.n + x.n <= 1200 then {{'u': case when s.u = '' then x.u else s.u || ',' || x.u end, 'n': s.n + x.n}} else s end) s from rec)
    select path_id, s.u units, s.n n_tokens from f""",
    graph=True,
)
def e3_budgeted_selection(spark, d):
    """Units that fit 1,200 tokens: the budget is the operator's argument."""
    e, r, units, _, walks = _provenance(spark, d)
    kept = E.selected_units(E.ranked_units(walks, r, e), units, None, 1200)
    listed = kept.groupBy("path_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "unit_id"))), lambda s: s["unit_id"]), ",").alias("units"), F.sum("n_tokens").cast("int").alias("n_tokens"))
    return walks.select("path_id").join(listed, "path_id", "left").select("path_id", F.coalesce("units", F.lit("")).alias("units"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


@query("select doc_id::varchar unit_id, source titles from documents")
def e4_document_titles(spark, d):
    _, _, units, documents, _ = _provenance(spark, d)
    return E.titled(units, documents).select("unit_id", F.array_join("titles", ", ").alias("titles"))


TAGS_SQL = """nn as (select n_nationkey k, n_name, r_name, n_name || '|' || r_name rel from nation join region on r_regionkey = n_regionkey),
rg as (select r_regionkey k, r_name from region),
sp as (select s_suppkey k, s_name, s_name || '|' || n_name rel from supplier join nation on s_nationkey = n_nationkey),
says as (select doc_id, [nn.n_name, rg.r_name, sp.s_name] names, [sp.rel, nn.rel] links from documents left join nn on nn.k = doc_id % 25 left join rg on rg.k = doc_id % 5 left join sp on sp.k = doc_id % (select count(*) from supplier) + 1)"""


@query(
    f""", {UNITS_SQL}, {TAGS_SQL} select path_id, unit::varchar unit_id, array_to_string(list_filter(names, lambda x: x in (a, b, c)), ',') path_entities, array_to_string(list_filter(links, lambda x: x in (a || '|' || b, b || '|' || c)), ',') path_relationships
    from rk join walks on path_id = a || ' > ' || b || ' > ' || c join says on doc_id = unit""",
    graph=True,
)
def e5_path_tags(spark, d):
    """Every document names a nation, a region and a supplier, and two relationships, by its number."""
    e, r, units, _, walks = _provenance(spark, d)
    nations, suppliers = table(spark, d, "nation"), table(spark, d, "supplier")
    n = suppliers.count()
    placed = nations.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nn = placed.select(F.col("n_nationkey").alias("k1"), F.md5("n_name").alias("n"), F.md5(F.concat_ws("|", "n_name", "r_name")).alias("nr"))
    rg = table(spark, d, "region").select(F.col("r_regionkey").alias("k2"), F.md5("r_name").alias("r"))
    sp = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("k3"), F.md5("s_name").alias("s"), F.md5(F.concat_ws("|", "s_name", "n_name")).alias("sn"))
    k = F.col("id").cast("long")
    tagged = units.join(nn, k % 25 == F.col("k1"), "left").join(rg, k % 5 == F.col("k2"), "left").join(sp, k % n + 1 == F.col("k3"), "left")
    tagged = tagged.select("id", F.array("n", "r", "s").alias("entity_ids"), F.array("sn", "nr").alias("relationship_ids"))
    found = E.path_tags(E.ranked_units(walks, r, e), walks, tagged, e.withColumn("id", F.md5("name")), r.withColumn("id", F.md5(F.concat_ws("|", "source", "target"))))
    pairs = F.transform("path_relationships", lambda x: F.concat_ws("|", x["source"], x["target"]))
    return found.select("path_id", "unit_id", F.array_join("path_entities", ",").alias("path_entities"), F.array_join(pairs, ",").alias("path_relationships"))


@query(f", {UNITS_SQL} select path_id, md5(string_agg('[Source ' || rank || ' | ' || title || ' | text_unit=' || unit || ']' || chr(10) || text, chr(10) || chr(10) order by rank)) digest from sized where rank <= 3 group by 1", graph=True)
def e6_rendered_context(spark, d):
    e, r, units, documents, walks = _provenance(spark, d)
    kept = E.selected_units(E.ranked_units(walks, r, e), units, 3)
    return E.rendered(kept, units, documents).select("path_id", F.md5(F.encode("context", "UTF-8")).alias("digest"))


@query(
    f""", {UNITS_SQL}, h as (select path_id, hop, unit, row_number() over (partition by path_id, hop order by min([position, pos])) p from hops join ru on (s = source and t = target) or (s = target and t = source and s <> t) group by path_id, hop, unit)
    select path_id question_id, row_number() over (partition by path_id order by min([hop, p])) number, unit::varchar unit_id, array_to_string(list_sort(list(distinct hop)), ',') supports_hops from h group by path_id, unit""",
    graph=True,
)
def e7_merged_sources(spark, d):
    e, r, _, _, walks = _provenance(spark, d)
    per_hop = P.hops_of(walks).select(F.concat_ws("#", "path_id", "hop").alias("k"), "path_id", "hop", F.array("a", "b").alias("path"))
    ranked = E.ranked_units(per_hop.select(F.col("k").alias("path_id"), "path"), r, e, entity_context=False)
    rows = ranked.withColumnRenamed("path_id", "k").join(per_hop.select("k", "path_id", "hop"), "k").select(F.col("path_id").alias("question_id"), "hop", "unit_id", F.col("rank").alias("pos"))
    return E.merged_sources(rows).withColumn("supports_hops", F.array_join("supports_hops", ","))


@query(f", {UNITS_SQL} select path_id question_id, string_agg(unit::varchar, ',' order by rank) units from rk group by 1", graph=True)
def e8_context_union(spark, d):
    """All passages behind a question's hops, each at its first place."""
    e, r, _, _, walks = _provenance(spark, d)
    ranked = E.ranked_units(walks, r, e)
    return ranked.groupBy(F.col("path_id").alias("question_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "unit_id"))), lambda s: s["unit_id"]), ",").alias("units"))


@query(f", {UNITS_SQL} select path_id, 'unknown document' reason, unit::varchar what from rk join documents on doc_id = unit where doc_id not in (select doc_id from labels) union all select a || ' > ' || b || ' > ' || c, 'unknown entity', c from walks", graph=True)
def e9_lookup_failures(spark, d):
    """Regions are taken out of the entities, unlabelled documents out of the documents."""
    e, r, units, documents, walks = _provenance(spark, d)
    known = documents.join(table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id")), "id", "left_semi")
    some = e.join(table(spark, d, "region").select(F.col("r_name").alias("name")), "name", "left_anti")
    return E.lookup_failures(walks, r, some, units, known)


# -- ambiguity ---------------------------------------------------------------------------------------------------------

CAND_SQL = """
q as (select s_name question_id, r_name p0, n_name p1, s_name p2 from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
cand as (select distinct question_id, p0 x, u.b y, v.b z, p1, p2 from q join und u on u.a = p0 join ents e1 on e1.name = u.b and e1.type = 'LOCATION' join und v on v.a = u.b join ents e2 on e2.name = v.b and e2.type = 'ORGANIZATION' where v.b <> p0),
rk as (select *, row_number() over (partition by question_id order by [x, y, z]) rn, count(*) over (partition by question_id) total from cand),
kept as (select question_id, x, y, z, p1, p2, total <= 500 complete from rk where rn <= 500 or (y = p1 and z = p2)),
num as (select *, row_number() over (partition by question_id order by [x, y, z]) - 1 path_id, (y = p1 and z = p2) is_intended from kept),
pr as (select least(source, target) lo, greatest(source, target) hi, max(weight) w from rels group by all),
rec as (select num.*, a.w + b.w total_weight, 1 + (y = p1)::int + (z = p2)::int matching_positions, y answer, p1 intended_answer, right(question_id, 1)::int l from num join pr a on a.lo = least(x, y) and a.hi = greatest(x, y) join pr b on b.lo = least(y, z) and b.hi = greatest(y, z)),
jud as (select *, case when answer = intended_answer then l % 3 <> 0 and path_id % 2 = l % 2 else l >= 5 and path_id % 7 = 0 end admissible, answer = intended_answer and path_id % 2 = l % 2 or l = 8 and path_id % 7 = 0 admissible2, (path_id % 2 = 0)::int + (path_id % 5 = 0)::int hits from rec)
"""


def _questions(spark, d):
    """Per supplier, the path from its region over its nation; the region is open."""
    e, r = star_graph.entities(spark, d), star_graph.relationships(spark, d)
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return e, r, rows.select(F.col("s_name").alias("question_id"), F.array("r_name", "n_name", "s_name").alias("path"))


def _candidates(spark, d):
    e, _, q = _questions(spark, d)
    # read for the candidates and for their hops
    r = cut(star_graph.relationships(spark, d, among=A.names_of_types(q, e)).drop("id"))
    return r, q, cut(A.numbered_candidates(q, P.undirected(r), e, 3))


def _said(records, again=False):
    """Canned verdicts, by the last digit of the question: some know no path to the intended answer, some none but other paths than the intended one, some other answers; in the second round (again) hardly any do."""
    digit, own, x = F.substring("question_id", -1, 1).cast("int"), F.col("answer") == F.col("intended_answer"), F.col("path_id")
    same, other = x % 2 == digit % 2, x % 7 == 0
    ok = (own & same) | ((digit == 8) & other) if again else F.when(own, (digit % 3 != 0) & same).otherwise((digit >= 5) & other)
    return records.select("question_id", F.floor(x / A.BATCH).cast("int").alias("batch"), "path_id", ok.alias("admissible"), F.array(x % 2 == 0, x % 5 == 0).alias("hop_matches"))


def _records(spark, d):
    """Candidates' records; the node behind the region is the answer, so several paths lead to one."""
    r, q, c = _candidates(spark, d)
    # used for the canned answers and for their check; nobody asks for the hops
    return cut(A.path_records(c, r, q, answer_index=1).drop("hops"))


def _judged(spark, d):
    records = _records(spark, d)
    return A.ingest_verdicts(records, _said(records))[0]


@query(f", {CAND_SQL} select question_id, path_id, x || ' > ' || y || ' > ' || z path, is_intended, complete from num", graph=True)
def g1_candidate_paths(spark, d):
    """Up to 500 alternatives per question (the cap is the operator's argument), and the intended path."""
    return _candidates(spark, d)[2].select("question_id", "path_id", P.sequence_text("path").alias("path"), "is_intended", "complete")


@query(f", {CAND_SQL} select question_id, count(*) n, bool_and(complete) complete, max(is_intended::int) has_intended from num group by 1", graph=True)
def g2_cap_and_completeness(spark, d):
    return _candidates(spark, d)[2].groupBy("question_id").agg(F.count("*").alias("n"), F.bool_and("complete").alias("complete"), F.max(F.col("is_intended").cast("int")).alias("has_intended"))


@query(f", {CAND_SQL} select question_id, path_id, round(total_weight, 6) total_weight, matching_positions, answer from rec", graph=True)
def g3_path_records(spark, d):
    return _records(spark, d).select("question_id", "path_id", F.round("total_weight", 6).alias("total_weight"), "matching_positions", "answer")


@query(
    f""", {CAND_SQL}, dd as (select least(source, target) lo, greatest(source, target) hi, array_to_string(list_sort(list(description)), ';') t from rels group by all)
    select question_id, 1 hop, p0 a, p1 b, 'LOCATION' a_type, 'LOCATION' b_type, t descriptions from q left join dd on lo = least(p0, p1) and hi = greatest(p0, p1)
    union all select question_id, 2, p1, p2, 'LOCATION', 'ORGANIZATION', t from q left join dd on lo = least(p1, p2) and hi = greatest(p1, p2)""",
    graph=True,
)
def g4_intended_constraints(spark, d):
    e, r, q = _questions(spark, d)
    return A.intended_constraints(q, r, e).select("question_id", "hop", "a", "b", "a_type", "b_type", F.array_join("descriptions", ";").alias("descriptions"))


#: Per trade of a nation with another one, the path from the seller over the buyer to the buyer's region; the seller is open.
TRADE_SQL = """
tq as (select distinct seller || '>' || o question_id, seller p0, o p1, r_name p2 from (select seller, lane, first(buyer order by n desc, buyer) o from trade_counts group by all) join nation on n_name = o join region on r_regionkey = n_regionkey where seller <> o),
tc as (select question_id, p0 x, u.b y, v.b z, p1, p2 from tq join und u on u.a = p0 join ents e1 on e1.name = u.b and e1.type = 'LOCATION' join und v on v.a = u.b and v.b <> p0 join ents e2 on e2.name = v.b and e2.type = 'LOCATION'),
dl as (select source, target, list(description order by ord, description) l, max(weight) w from rels group by all),
hop_list as (select question_id, x, y, z, p1, p2, list_concat(coalesce(a.l, []), coalesce(b.l, [])) d1, list_concat(coalesce(c.l, []), coalesce(d.l, [])) d2, greatest(a.w, b.w) w1, greatest(c.w, d.w) w2
  from tc left join dl a on a.source = x and a.target = y left join dl b on b.source = y and b.target = x left join dl c on c.source = y and c.target = z left join dl d on d.source = z and d.target = y)"""


def _trade_questions(spark, d):
    """Places with trades, and a question per nation and main buyer."""
    e, r = star_graph.entities(spark, d, places=True), star_graph.relationships(spark, d, places=True)
    sold = r.filter(F.col("description").contains(" sells most to ")).filter("source <> target").select(F.col("source").alias("p0"), F.col("target").alias("p1")).distinct()
    homes = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("p1"), F.col("r_name").alias("p2"))
    return e, r, cut(sold.join(homes, "p1").select(F.concat_ws(">", "p0", "p1").alias("question_id"), F.array("p0", "p1", "p2").alias("path")))


@query(
    f", {TRADE_SQL} select question_id, x || ' > ' || y || ' > ' || z path, array_to_string(d1, '; ') || ' / ' || array_to_string(d2, '; ') descriptions, round(w1 + w2, 6) total_weight, 1 + (y = p1)::int + (z = p2)::int matching_positions from hop_list",
    graph="places",
)
def g3_path_hops(spark, d):
    """Records over parallel relationships in both directions, with all descriptions of each hop in row order."""
    e, r, q = _trade_questions(spark, d)
    records = A.path_records(cut(A.numbered_candidates(q, P.undirected(r), e, 3)), r, q)
    said = F.array_join(F.transform("hops", lambda h: F.array_join(h["descriptions"], "; ")), " / ")
    return records.select("question_id", P.sequence_text("path").alias("path"), said.alias("descriptions"), F.round("total_weight", 6).alias("total_weight"), "matching_positions")


@query(
    f""", {TRADE_SQL}, own as (select * from hop_list where y = p1 and z = p2)
    select question_id, 1 hop, x a, y b, array_to_string(d1, '; ') descriptions from own union all select question_id, 2, y, z, array_to_string(d2, '; ') from own""",
    graph="places",
)
def g4_trade_constraints(spark, d):
    """The intended hops' descriptions over parallel relationships, in row order."""
    e, r, q = _trade_questions(spark, d)
    return A.intended_constraints(q, r, e).select("question_id", "hop", "a", "b", F.array_join("descriptions", "; ").alias("descriptions"))


@query(f", {CAND_SQL} select question_id, (path_id // 20)::int batch, string_agg(path_id::varchar, ',' order by path_id) path_ids from rec group by all", graph=True)
def g5_validation_batches(spark, d):
    r, q, c = _candidates(spark, d)
    return A.validation_batches(A.path_records(c, r, q)).select("question_id", "batch", F.array_join("path_ids", ",").alias("path_ids"))


@query(f", {CAND_SQL} select question_id, count(*) n, count(*) filter (admissible) n_admissible from jud group by 1", graph=True)
def g6_verdicts(spark, d):
    return _judged(spark, d).groupBy("question_id").agg(F.count("*").alias("n"), F.count_if("admissible").alias("n_admissible"))


GROUPS_SQL = f""", {CAND_SQL}, grp as (select question_id, any_value(intended_answer) intended, coalesce(list_sort(list(distinct answer) filter (admissible)), []) answers, coalesce(list_sort(list(distinct answer) filter (admissible2)), []) answers2, bool_and(complete) complete from jud group by 1),
gg as (select *, list_contains(answers, intended) intended_admissible, complete and answers = [intended] is_unique, complete and answers2 = [intended] unique2 from grp),
per as (select question_id, answer, count(*) filter (admissible) k, count(*) filter (admissible2) k2 from jud group by 1, 2),
pa as (select question_id, coalesce(string_agg(answer || ':' || k, ';' order by answer) filter (k > 0), '') t, coalesce(string_agg(answer || ':' || k2, ';' order by answer) filter (k2 > 0), '') t2 from per group by 1)"""


def _counted(paths):
    """How many paths lead to each answer, as text."""
    return F.array_join(F.transform(F.map_keys(paths), lambda a: F.concat(a, F.lit(":"), F.size(F.element_at(paths, a)).cast("string"))), ";")


@query(GROUPS_SQL + " select question_id, array_to_string(answers, ';') answers, t answer_paths, intended_admissible, is_unique from gg join pa using (question_id)", graph=True)
def g7_answer_groups(spark, d):
    return A.answer_groups(_judged(spark, d)).select("question_id", F.array_join("answers", ";").alias("answers"), _counted(F.col("answer_paths")).alias("answer_paths"), "intended_admissible", "is_unique")


#: The candidates without the cap, for the query that takes the best of all of them.
ALL_CAND_SQL = CAND_SQL.replace("total <= 500 complete", "true complete").replace(" from rk where rn <= 500 or (y = p1 and z = p2)", " from rk")


@query(
    f""", {ALL_CAND_SQL}, s as (select question_id, answer, path_id, 10000.0 * admissible::int + 1000.0 * hits + 100.0 * matching_positions + ln(1 + greatest(0, total_weight)) score from jud where answer <> intended_answer),
    b as (select * from (select *, row_number() over (partition by question_id, answer order by score desc, path_id) r from s) where r = 1)
    select question_id, rank, answer, round(score, 6) score from (select *, row_number() over (partition by question_id order by score desc, answer) rank from b) where rank <= 4""",
    graph=True,
)
def g8_distractors(spark, d):
    """The four best wrong answers per question, out of all its candidates.

    Suppliers of one nation whose canned verdicts go by the same digit are asked and judged alike, but for the supplier
    itself: the paths of one of them are judged for all.
    """
    e, r, q = _questions(spark, d)
    alike = F.min("question_id").over(W.partitionBy(F.slice("path", 1, 2), F.substring("question_id", -1, 1)))
    q = cut(q.withColumn("like", alike))
    one = cut(q.filter("question_id = like").drop("like"))
    r = cut(star_graph.relationships(spark, d, among=A.names_of_types(one, e)).drop("id"))
    records = cut(A.path_records(cut(A.numbered_candidates(one, P.undirected(r), e, 3, cap=None)), r, one, answer_index=1).drop("hops"))
    judged = A.ingest_verdicts(records, _said(records))[0]
    return A.shared_distractors(q, judged, (2,)).withColumn("score", F.round("score", 6))


@query(
    GROUPS_SQL
    + """, dd as (select question_id, 'discard' policy, case when is_unique then 'accepted' else 'discarded' end decision, case when is_unique then [intended] else [] end fine, t from gg join pa using (question_id)
    union all select question_id, 'retain', case when not intended_admissible then 'discarded' when is_unique then 'accepted' else 'retained_with_alternatives' end, answers, t from gg join pa using (question_id)
    union all select question_id, 'disambiguate', case when is_unique then 'accepted' when intended_admissible and unique2 then 'disambiguated' else 'discarded' end, case when is_unique or intended_admissible and unique2 then [intended] else [] end, case when not is_unique and intended_admissible then t2 else t end from gg join pa using (question_id))
    select question_id, policy, decision, array_to_string(fine, ';') acceptable_answers, t answer_paths from dd""",
    graph=True,
)
def g9_policy_decision(spark, d):
    """All three policies; questions that are rewritten have a second round of canned verdicts."""
    records = _records(spark, d)
    groups = cut(A.answer_groups(A.ingest_verdicts(records, _said(records))[0]))
    again = A.answer_groups(A.ingest_verdicts(records, _said(records, True))[0])
    out = [A.policy_decision(groups, p, again).select("question_id", F.lit(p).alias("policy"), "decision", F.array_join("acceptable_answers", ";").alias("acceptable_answers"), _counted(F.col("answer_paths")).alias("answer_paths")) for p in ("discard", "retain", "disambiguate")]
    return out[0].unionByName(out[1]).unionByName(out[2])


PATTERN_SQL = """, q as (select distinct r_name question_id, r_name r from region),
pat as (select question_id, r, n.b n, s.b s, p.b p from q join und n on n.a = r join ents e1 on e1.name = n.b and e1.type = 'LOCATION' join und s on s.a = n.b join ents e2 on e2.name = s.b and e2.type = 'ORGANIZATION'
  join und p on p.a = s.b join ents e3 on e3.name = p.b and e3.type = 'PRODUCT' where n.b <> r),
kept as (select * from (select *, row_number() over (partition by question_id order by r, n, s, p) pos, count(*) over (partition by question_id) total from pat) where pos <= 500)"""
PATTERN3_SQL = """, q as (select distinct r_name question_id, r_name r from region),
pat as (select distinct question_id, r, n.b n, s.b s from q join und n on n.a = r join ents e1 on e1.name = n.b and e1.type = 'LOCATION' join und s on s.a = n.b join ents e2 on e2.name = s.b and e2.type = 'ORGANIZATION' where n.b <> r),
kept as (select *, min(n) over (partition by question_id) intended, length(question_id) % 3 m from (select *, row_number() over (partition by question_id order by r, n, s) pos, count(*) over (partition by question_id) total from pat) where pos <= 500),
j as (select *, n answer, total <= 500 complete, case m when 0 then n = intended and pos % 2 = 0 when 1 then pos % 3 = 0 else n <> intended and pos % 3 = 0 end ok, n = intended ok2 from kept),
g as (select question_id, any_value(intended) intended, bool_and(complete) complete, coalesce(list_sort(list(distinct answer) filter (ok)), []) a1, coalesce(list_sort(list(distinct answer) filter (ok2)), []) a2, coalesce(list(answer order by pos) filter (not ok), [])[1:4] w1, coalesce(list(answer order by pos) filter (not ok2), [])[1:4] w2 from j group by 1),
u as (select *, complete and a1 = [intended] u1, complete and a2 = [intended] u2, not (complete and a1 = [intended]) and list_contains(a1, intended) again from g)"""


def _assignments(spark, d, roles=("r", "n", "s", "p")):
    e, r = star_graph.entities(spark, d), star_graph.relationships(spark, d)
    q = table(spark, d, "region").select(F.col("r_name").alias("question_id"), F.col("r_name").alias("r"))
    kinds = [("r", "LOCATION"), ("n", "LOCATION"), ("s", "ORGANIZATION"), ("p", "PRODUCT")][: len(roles)]
    return A.pattern_assignments(q, e, P.undirected(r), kinds, list(zip(roles, roles[1:], strict=False)), ("r",))


@query(PATTERN_SQL + " select question_id, r, n, s, p, pos, total <= 500 complete from kept", graph=True)
def g10_pattern_assignments(spark, d):
    """Up to 500 assignments per question (the operator's cap) of region, nation, supplier, part."""
    return _assignments(spark, d)


@query(
    """, lo as (select name from ents where type = 'LOCATION'),
    pat as (select x.a r, x.b n, y.b m from und x join und y on y.a = x.b and y.b <> x.a join und z on z.a = y.b and z.b = x.a where x.a in (from lo) and x.b in (from lo) and y.b in (from lo)),
    kept as (select * from (select *, row_number() over (order by r, n, m) pos, count(*) over () total from pat) where pos <= 500)
    select r_name question_id, r, n, m, pos, total <= 500 complete from kept, region""",
    graph="places",
)
def g10_open_triangles(spark, d):
    """A cyclic pattern without fixed roles over places with trades: up to 500 assignments (the operator's cap), the same for every question."""
    e, r = star_graph.entities(spark, d, places=True), star_graph.relationships(spark, d, places=True)
    q = table(spark, d, "region").select(F.col("r_name").alias("question_id"))
    return A.pattern_assignments(q, e, P.undirected(r), [(x, "LOCATION") for x in "rnm"], [("r", "n"), ("n", "m"), ("m", "r")], ())


@query(
    PATTERN3_SQL
    + """, dd as (select question_id, 'discard' policy, case when u1 then 'accepted' else 'discarded' end decision, a1 answers, case when u1 then [intended] else [] end fine, w1 wrong from u
    union all select question_id, 'retain', case when len(a1) > 0 then 'accepted' else 'discarded' end, a1, a1, w1 from u
    union all select question_id, 'disambiguate', case when again and u2 then 'disambiguated' when u1 then 'accepted' else 'discarded' end, case when again then a2 else a1 end, case when u1 or again and u2 then [intended] else [] end, case when again then w2 else w1 end from u)
    select question_id, policy, decision, array_to_string(answers, ';') answers, array_to_string(fine, ';') acceptable_answers, array_to_string(wrong, ';') distractors from dd""",
    graph=True,
)
def g11_structure_policy(spark, d):
    """All three policies over the assignments of region, nation and supplier, whose answer is the nation; verdicts are canned by the length of the region's name."""
    from pyspark.sql import Window as W

    rows = _assignments(spark, d, ("r", "n", "s")).withColumn("intended_answer", F.min("n").over(W.partitionBy("question_id"))).withColumn("m", F.char_length("question_id") % 3)
    own, x = F.col("n") == F.col("intended_answer"), F.col("pos")
    ok = F.when(F.col("m") == 0, own & (x % 2 == 0)).when(F.col("m") == 1, x % 3 == 0).otherwise(~own & (x % 3 == 0))
    results = cut(rows.select("question_id", x.alias("id"), F.col("n").alias("answer"), ok.alias("admissible"), "intended_answer", "complete"))
    again = results.withColumn("admissible", F.col("answer") == F.col("intended_answer"))
    text = lambda c: F.array_join(c, ";").alias(c)
    out = [A.structure_decision(results, p, again).select("question_id", F.lit(p).alias("policy"), "decision", text("answers"), text("acceptable_answers"), text("distractors")) for p in ("discard", "retain", "disambiguate")]
    return out[0].unionByName(out[1]).unionByName(out[2])


# -- review: canned answers about documents' sources -------------------------------------------------------------------

def _canned(spark, d):
    """(question_id, attempt, expected, aliases, n_passages, response): right, nearly right, wrong, incomplete and mistyped answers, some called equivalent by a second response."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    x = F.col("doc_id")
    predicted = F.when(x % 5 == 0, F.concat(F.upper("source"), F.lit("!"))).when(x % 5 == 1, F.concat(F.lit("The "), "source")).otherwise(F.lit("other"))
    flag = F.when(x % 7 == 0, F.lit('"yes"')).when(x % 11 == 0, F.lit("false")).otherwise(F.lit("true"))
    text = F.concat(F.lit('{"answerable": '), flag, F.lit(', "answer": "'), predicted, F.lit('", "evidence_sources": ['), (1 + x % 5).cast("string"), F.lit('], "equivalent": [false, '), (x % 10 == 3).cast("string"), F.lit("]}"))
    return docs.select(F.floor(x / 3).alias("question_id"), (x % 3).cast("int").alias("attempt"), F.col("doc_id"), F.col("source").alias("expected"), F.array(F.concat(F.lit("alias "), "source")).alias("aliases"), (1 + x % 4).cast("int").alias("n_passages"), F.when(x % 13 == 0, F.lit("no answer")).otherwise(text).alias("response"))


REVIEW_SQL = """with c as (select doc_id, doc_id // 3 question_id, doc_id % 3 attempt, doc_id % 13 = 0 bad, doc_id % 7 = 0 mistyped, doc_id % 11 = 0 negative, doc_id % 5 in (0, 1) or doc_id % 10 = 3 hit, 1 + doc_id % 5 cite, 1 + doc_id % 4 n_passages from documents),
v as (select *, not bad and not mistyped and not negative answerable, not bad and cite <= n_passages cited, not bad and not mistyped and not negative and hit matched from c)"""


def _verdicts(spark, d):
    return R.single_hop_verdict(R.answer_match(R.parse(_canned(spark, d), R.ANSWER)))


@query("select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(source || ' the ' || lang)), '[^a-z0-9_]+', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), ' +', ' ', 'g')) answer from documents")
def f1_normalised_answers(spark, d):
    return table(spark, d, "documents").select("doc_id", normal_answer(F.concat("source", F.lit(" the "), "lang")).alias("answer"))


@query(REVIEW_SQL + " select doc_id, matched matches from v")
def f2_answer_match(spark, d):
    return R.answer_match(R.parse(_canned(spark, d), R.ANSWER)).select("doc_id", "matches")


@query(REVIEW_SQL + " select doc_id, cited from v")
def f3_citation_check(spark, d):
    return R.parse(_canned(spark, d), R.ANSWER).select("doc_id", R.citations_ok(F.col("r.evidence_sources"), F.col("n_passages")).alias("cited"))


@query(REVIEW_SQL + " select doc_id, answerable and cited and matched supported, concat_ws(';', case when not answerable then 'not_answerable_from_context' end, case when answerable and not cited then 'missing_or_invalid_evidence_citations' end, case when answerable and not matched then 'answer_does_not_match_expected' end) failures from v")
def f4_single_hop_verdict(spark, d):
    return _verdicts(spark, d).select("doc_id", "supported", F.array_join("failures", ";").alias("failures"))


@query(
    REVIEW_SQL + """, p as (select question_id, min(case when answerable and cited and matched then attempt end) accepted_attempt, max(attempt) l from v group by 1)
    select question_id, accepted_attempt, coalesce(accepted_attempt, l) + 1 attempts, accepted_attempt is null discarded from p"""
)
def f5_regeneration(spark, d):
    return R.regeneration(_verdicts(spark, d))


@query(f", {UNITS_SQL}, h as (select path_id, hop, unit, row_number() over (partition by path_id, hop order by min([position, pos])) p from hops join ru on (s = source and t = target) or (s = target and t = source and s <> t) group by path_id, hop, unit) select path_id || '#' || hop hop_id, string_agg(unit::varchar, ',' order by p) units from h where p <= 4 group by 1", graph=True)
def f6_hop_evidence(spark, d):
    """At most four units per hop of every walk."""
    e, r, units, _, walks = _provenance(spark, d)
    per_hop = P.hops_of(walks).select(F.concat_ws("#", "path_id", "hop").alias("path_id"), F.array("a", "b").alias("path"))
    kept = E.selected_units(E.ranked_units(per_hop, r, e, entity_context=False), units, 4)
    return kept.groupBy("path_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "unit_id"))), lambda s: s["unit_id"]), ",").alias("units")).withColumnRenamed("path_id", "hop_id")


@query(
    f""", {CHAIN_SQL}, asked as (select a || ' > ' || b || ' > ' || c path_id, a x, c y from walks union all select b || ' > ' || a, b, a from walks union all select distinct b || ' > ' || c, b, c from walks)
    select path_id, coalesce(n, 0) n_direct from asked left join pairs on lo = least(x, y) and hi = greatest(x, y)""",
    graph=True,
)
def f7_direct_edges(spark, d):
    """Walks of three, whose ends are never linked, and their parts of two, whose ends are."""
    _, r, walks = _walks(spark, d)
    part = lambda *at: walks.select(F.array(*[F.element_at("path", i) for i in at]).alias("path")).distinct().withColumn("path_id", P.sequence_text("path"))
    return R.shortcuts(walks.select("path_id", "path").unionByName(part(2, 1).select("path_id", "path")).unionByName(part(2, 3).select("path_id", "path")), r)


def _flag(c, yes, no):
    """true, false or missing."""
    return F.when(yes, F.lit(True)).when(no, F.lit(False)).alias(c)


def _hop_reviews(spark, d):
    """Reviews of a two-hop question: complete, repeated, of one hop only, of a third one, with flags that are false or missing."""
    x = F.col("doc_id")
    hop = lambda i: F.struct(F.lit(i).alias("hop"), _flag("required_by_question", x % 9 > 1, x % 9 == 1), _flag("supported_by_sources", x % 8 != 7, x % 16 == 7), F.lit(i == 1).alias("feeds_later_hop"))
    some = F.when(x % 6 == 5, F.array(hop(1))).when(x % 6 == 4, F.array(hop(2), hop(1), hop(1))).when(x % 12 == 3, F.array(hop(1), hop(2), hop(3))).when(x % 12 == 9, F.array(hop(2), hop(2))).otherwise(F.array(hop(2), hop(1)))
    return table(spark, d, "documents").select("doc_id", some.alias("hop_reviews"))


HOPS_SQL = """with hr as (select doc_id, case when doc_id % 6 = 5 then [1] when doc_id % 6 = 4 then [2, 1, 1] when doc_id % 12 = 3 then [1, 2, 3] when doc_id % 12 = 9 then [2, 2] else [2, 1] end ids, doc_id % 9 > 1 required, doc_id % 8 <> 7 supported from documents),
al as (select doc_id, list_sort(list_distinct(ids)) = [1, 2] and len(list_filter(ids, lambda h: not (required and supported and (h = 1 or h = 2)))) = 0 aligned, list_sort(list_distinct(ids)) = [1, 2] and required and supported needed from hr)"""


@query(HOPS_SQL + " select doc_id, aligned from al")
def f8_hop_alignment(spark, d):
    return R.parse(_hop_reviews(spark, d).select("doc_id", F.to_json(F.struct("hop_reviews")).alias("response")), R.CHAIN).select("doc_id", R.hop_alignment(F.col("r.hop_reviews"), F.lit(2)).alias("aligned"))


def _necessity(spark, d):
    each = _hop_reviews(spark, d).select(F.col("doc_id").alias("question_id"), F.lit(2).alias("n_hops"), F.explode("hop_reviews").alias("h"))
    found = F.when(F.col("h.supported_by_sources"), F.lit(False)).otherwise(F.when(F.col("h.supported_by_sources").isNotNull(), F.lit(True)))
    return R.hop_necessity(each.select("question_id", "n_hops", "h.hop", F.col("h.required_by_question").alias("necessary"), found.alias("bypass_found")))


@query(HOPS_SQL + " select doc_id question_id, needed all_necessary from al")
def f9_hop_necessity(spark, d):
    return _necessity(spark, d)


F10_SQL = HOPS_SQL + """, c as (select doc_id, doc_id % 11 <> 0 well, doc_id % 13 not in (0, 1) and doc_id % 17 <> 0 answerable, doc_id % 19 not in (0, 1) hit, doc_id % 23 not in (0, 1) follows, doc_id % 29 <> 0 seq, doc_id % 31 = 0 extra, doc_id % 37 not in (0, 1) clear from documents),
v as (select doc_id, well, answerable, answerable and hit matched, follows, seq, extra, aligned, needed, clear from c join al using (doc_id))"""


@query(
    F10_SQL
    + """ select doc_id, well and answerable and matched and follows and seq and not extra and aligned and needed and clear accepted, concat_ws(';', case when not well then 'not_well_formed' end, case when not answerable then 'not_answerable' end,
    case when answerable and not matched then 'answer_mismatch' end, case when not follows then 'does_not_follow_intended_chain' end, case when not seq then 'no_sequential_dependency' end, case when extra then 'unsupported_constraints' end,
    case when not aligned then 'hop_alignment_failed' end, case when not needed then 'unnecessary_hop_or_bypass' end, case when not clear then 'shortcut_found' end) failures from v"""
)
def f10_multi_hop_verdict(spark, d):
    """Raw responses of four reviews, parsed and judged; some flags are false, some missing, some of the wrong type."""
    x = F.col("doc_id")
    answer = F.struct(_flag("well_formed", x % 11 != 0, x % 22 == 0), _flag("answerable", ~(x % 13).isin(0, 1), x % 13 == 1), F.when(x % 17 != 0, F.when(x % 19 == 0, F.lit("wrong")).when(x % 19 == 1, F.lit("an other")).otherwise(F.concat(F.lit("The "), F.upper("source")))).alias("answer"))
    chain = F.struct(
        F.when(x % 23 == 1, F.lit("yes")).when(x % 23 == 0, F.lit("false")).otherwise(F.lit("true")).alias("f"), _flag("sequential_dependency", x % 29 != 0, x % 58 == 0), F.when(x % 31 == 0, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>")).alias("unsupported_constraints"), "hop_reviews",
    )
    # a flag of the wrong type is spelled as text
    chain_text = F.regexp_replace(F.to_json(chain), '"f":"(true|false)"', '"follows_intended_chain":$1')
    rows = table(spark, d, "documents").join(_hop_reviews(spark, d), "doc_id").select("doc_id", "source", F.to_json(answer).alias("response"), F.regexp_replace(chain_text, '"f":', '"follows_intended_chain":').alias("chain_response"), F.to_json(F.struct(_flag("shortcut_found", x % 37 == 1, x % 37 > 1))).alias("shortcut_response"))
    said = R.parse(rows, "struct<well_formed:boolean,answerable:boolean,answer:string,equivalent:array<boolean>>").withColumn("expected", F.col("source")).withColumn("aliases", F.array().cast("array<string>"))
    chained = R.parse(R.answer_match(said).withColumnRenamed("r", "r1"), R.CHAIN, "chain_response").withColumnRenamed("r", "chain")
    full = R.parse(chained, "struct<shortcut_found:boolean>", "shortcut_response").withColumn("shortcut_found", F.col("r.shortcut_found")).drop("r").withColumnRenamed("r1", "r").withColumn("n_hops", F.lit(2))
    needed = _necessity(spark, d).select(F.col("question_id").alias("doc_id"), "all_necessary")
    return R.multi_hop_verdict(full.join(needed, "doc_id")).select("doc_id", "accepted", F.array_join("failures", ";").alias("failures"))


@query(
    """with c as (select doc_id, case when doc_id % 10 = 0 then [1] else [1, 2] end rel, case when doc_id % 3 = 0 then [3] else [] end ops, case when doc_id % 10 = 0 then [1] when doc_id % 7 = 0 then [1] when doc_id % 7 = 1 then [2, 1, 2] else [1, 2] end said, case when doc_id % 3 = 0 and doc_id % 4 <> 0 then [3, 3] when doc_id % 16 = 1 then [4] else [] end said_ops,
    doc_id % 11 not in (0, 1) valid, doc_id % 13 not in (0, 1) clear, doc_id % 5 = 0 uniq, case doc_id % 3 when 0 then 'strict' when 1 then 'balanced' else 'loose' end rigor from documents),
    v as (select *, list_sort(list_concat(rel, ops)) = list_sort(list_distinct(list_concat(said, said_ops))) complete, len(rel) < 2 few from c)
    select doc_id, not few and valid and complete and clear and (rigor <> 'strict' or uniq) accepted, case when few then 'fewer_than_two_relational_hops' when complete then '' else 'incomplete_topology_review' end failures from v"""
)
def f11_structure_verdict(spark, d):
    """Raw responses to two relational hops and, for some, an operation: reviews that are complete, repeated, missing or of other hops."""
    x = F.col("doc_id")
    hop = lambda i, op=None: F.struct(F.lit(i).alias("hop"), F.lit(None if op else "a").alias("source"), F.lit(None if op else "b").alias("target"), F.lit(op).cast("string").alias("operation"))
    two = F.when(x % 10 == 0, F.array(hop(1))).otherwise(F.array(hop(1), hop(2)))
    hops = F.when(x % 3 == 0, F.concat(two, F.array(hop(3, "argmax")))).otherwise(two)
    ids = lambda *n: F.array(*[F.struct(F.lit(i).alias("hop")) for i in n])
    none = F.array().cast("array<struct<hop:int>>")
    said = F.when((x % 10 == 0) | (x % 7 == 0), ids(1)).when(x % 7 == 1, ids(2, 1, 2)).otherwise(ids(1, 2))
    ops = F.when((x % 3 == 0) & (x % 4 != 0), ids(3, 3)).when(x % 16 == 1, ids(4)).otherwise(none)
    body = F.struct(_flag("valid", ~(x % 11).isin(0, 1), x % 11 == 1), _flag("globally_unique", x % 5 == 0, x % 5 == 1), said.alias("hop_reviews"), ops.alias("operation_reviews"), _flag("shortcut_found", x % 13 == 1, x % 13 > 1))
    rows = table(spark, d, "documents").select("doc_id", hops.alias("hops"), F.to_json(body).alias("response"), F.get(F.array(F.lit("strict"), F.lit("balanced"), F.lit("loose")), (x % 3).cast("int")).alias("rigor"))
    return R.structure_verdict(R.parse(rows, R.STRUCTURE)).select("doc_id", "accepted", F.array_join("failures", ";").alias("failures"))


OPS_SQL = """with b as (select n_name q, s_name nm, s_acctbal::double x from supplier join nation on s_nationkey = n_nationkey),
od as (select o_custkey, o_orderkey::varchar nm, strftime(o_orderdate, '%Y-%m-%d') dt from orders),
ln as (select distinct l_orderkey, l_suppkey::varchar nm, l_returnflag v from lineitem),
ops as (select 'argmin:' || q question_id, first(nm order by x, nm) answer from b group by 1 union all select 'argmax:' || q, first(nm order by x desc, nm) from b group by 1
union all select 'counting:' || n_name, count(distinct c_name)::varchar from customer join nation on c_nationkey = n_nationkey group by 1
union all select 'temporal_order:' || o_custkey, string_agg(nm, ' < ' order by dt, nm) from od group by 1
union all select 'selection:' || q, string_agg(nm, ', ' order by nm) filter (x < 0) from b group by 1
union all select 'comparison:' || l_orderkey, case when count(distinct nm) = 2 then case when min(x) = max(x) then 'equal' else first(nm order by x desc, nm) end end from (select l_orderkey, l_linenumber::varchar nm, l_extendedprice::double x from lineitem) group by 1
union all select 'intersection:' || l_orderkey, (select string_agg(nm, ', ' order by nm) from (select nm from ln y where y.l_orderkey = z.l_orderkey group by nm having count(distinct v) = (select count(distinct v) from ln w where w.l_orderkey = z.l_orderkey))) from (select distinct l_orderkey from lineitem) z)"""


def _operations(spark, d):
    """Values for every operation, out of suppliers' balances, customers, orders' dates and lines."""
    t = lambda name: table(spark, d, name)
    named = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = lambda df, op, q, name, value: df.select(F.concat(F.lit(f"{op}:"), F.col(q).cast("string")).alias("question_id"), F.lit(op).alias("operation"), F.col(name).cast("string").alias("name"), value.cast("string").alias("value"))
    balance = F.col("s_acctbal").cast("double")
    parts = [
        rows(named, "argmin", "n_name", "s_name", balance), rows(named, "argmax", "n_name", "s_name", balance), rows(named, "selection", "n_name", "s_name", balance < 0),
        rows(t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")), "counting", "n_name", "c_name", F.lit(None)),
        rows(t("orders"), "temporal_order", "o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd")),
        rows(t("lineitem"), "comparison", "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double")), rows(t("lineitem"), "intersection", "l_orderkey", "l_suppkey", F.col("l_returnflag")),
    ]
    return R.operation_answers(reduce(DataFrame.unionByName, parts))


@query(OPS_SQL + " select question_id, answer from ops")
def f12_operation_answers(spark, d):
    """All seven operations over whole tables."""
    return _operations(spark, d).select("question_id", "answer")


@query(
    OPS_SQL
    + """, r as (select *, ('0x' || substr(md5(question_id), 1, 4))::bigint % 4 k from ops)
    select question_id, case k when 0 then answer when 1 then 'said' end answer, case when k = 0 and answer is null then 'pending' when k > 1 then 'operation_review' end stage from r"""
)
def f12_operation_verdict(spark, d):
    """Valid, invalid and unreadable responses; questions without one take the computed answer."""
    # read for the questions and for the canned responses
    computed = cut(_operations(spark, d))
    k = F.conv(F.substring(F.md5("question_id"), 1, 4), 16, 10).cast("int") % 4
    said = F.when(k == 1, '{"valid": true, "answer": "said"}').when(k == 2, '{"valid": false, "answer": "said"}').otherwise('valid, but no JSON')
    responses = computed.filter(k > 0).select("question_id", said.alias("response"))
    return R.operation_verdict(computed, responses, computed)


# -- generation and evaluation -----------------------------------------------------------------------------------------


def _prompt_sql(kind: str) -> str:
    task, shown = H.TASKS[kind][0].replace("'", "''"), H.TASKS[kind][1]
    blocks = " || ".join(f"chr(10) || chr(10) || '{c.capitalize()}:' || chr(10) || coalesce({c}, '')" for c in shown)
    return f"select doc_id, '{kind}' kind, sha256('{kind}' || chr(0) || 'Task: {task}' || {blocks}) key from p"


_PROMPTED = tuple(H.TASKS)
_SHOWN = sorted({c for k in _PROMPTED for c in H.TASKS[k][1]})


@query(f"with p as (select doc_id, {', '.join('text as context' if c == 'context' else f'lang source' if c == 'source' else f'source as {c}' for c in _SHOWN)} from documents) " + " union all ".join(_prompt_sql(k) for k in _PROMPTED))
def h1_prompt_table(spark, d):
    """All kinds of prompts over every document as context."""
    rows = table(spark, d, "documents").select("doc_id", *[(F.col("text") if c == "context" else F.col("lang") if c == "source" else F.col("source")).alias(c) for c in _SHOWN])
    out = [H.prompts(rows, k).select("doc_id", F.lit(k).alias("kind"), "key") for k in _PROMPTED]
    return reduce(DataFrame.unionByName, out)


@query("with v as (select p_brand structure_id, count(*) filter (p_size > 45) n_examples from part group by 1 having max(p_size) > 46) select p_partkey set_id, p_brand structure_id, case when n_examples is null then 'structure_review_required' when n_examples = 0 then 'example_review_required' end stage from part left join v on structure_id = p_brand")
def h2_catalogue_gate(spark, d):
    part = table(spark, d, "part")
    view = part.groupBy(F.col("p_brand").alias("structure_id")).agg(F.count_if(F.col("p_size") > 45).alias("n_examples"), F.max("p_size").alias("m")).filter("m > 46").drop("m")
    return H.catalogue_gate(part.select(F.col("p_partkey").alias("set_id"), F.col("p_brand").alias("structure_id")), view)


@query("select s_name hop_id, description as text from rels join supplier on source = s_name join nation on n_nationkey = s_nationkey and n_name = target", graph=True)
def h3_hop_texts(spark, d):
    """Suppliers to nations, half of the hops marked as against the edge's direction."""
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    hops = rows.select(F.col("s_name").alias("hop_id"), F.col("s_name").alias("a"), F.col("n_name").alias("b"), (F.col("s_suppkey") % 2 == 0).alias("reverse"))
    return H.hop_texts(hops, star_graph.relationships(spark, d))


@query(
    """, dl as (select source, target, string_agg(description, chr(10) order by ord, description) t from rels group by all), np as (select x.n_name a, y.n_name b, (x.n_nationkey + y.n_nationkey) % 2 = 0 back from nation x join nation y on x.n_name <> y.n_name)
    select a || '>' || b hop_id, case when back then coalesce(r.t, f.t) else coalesce(f.t, r.t) end as text from np left join dl f on f.source = a and f.target = b left join dl r on r.source = b and r.target = a""",
    graph="places",
)
def h3_trade_texts(spark, d):
    """All ordered pairs of nations as hops, half of them marked as against the direction: parallel, reverse and missing relationships."""
    x, y = (table(spark, d, "nation").select(F.col("n_nationkey").alias(f"k{i}"), F.col("n_name").alias(i)) for i in "ab")
    pairs = x.join(y, F.col("a") != F.col("b")).select(F.concat_ws(">", "a", "b").alias("hop_id"), "a", "b", ((F.col("ka") + F.col("kb")) % 2 == 0).alias("reverse"))
    return H.hop_texts(pairs, star_graph.relationships(spark, d, places=True))


@query(f", {CHAIN_SQL} select a || ' > ' || b || ' > ' || c path_id, case when right(a, 1)::int % 3 = 0 then 'op ' || b when right(a, 1)::int % 2 = 0 then c else 'composed ' || a end answer from walks", graph=True)
def h4_expected_answer(spark, d):
    """Operations answer some questions; of the others some have an answer role among their entities."""
    _, _, walks = _walks(spark, d)
    at = lambda i: F.element_at("path", i)
    digit = F.substring(at(1), -1, 1).cast("int")
    roles = F.map_from_arrays(F.array(F.lit("x"), F.lit("y"), F.when(digit % 2 == 0, "z").otherwise("w")), "path")
    operation = F.when(digit % 3 == 0, F.concat(F.lit("op "), at(2)))
    return walks.select("path_id", H.expected_answer(F.try_element_at(roles, F.lit("z")), operation, F.concat(F.lit("composed "), at(1))).alias("answer"))


@query(f"select s_name set_id, case when s_suppkey % 2 = 0 then 'path' else 'pattern' end route {'from supplier join nation on s_nationkey = n_nationkey'}")
def h5_ambiguity_route(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    path = F.array("s_name", "n_name")
    return rows.select(F.col("s_name").alias("set_id"), H.ambiguity_route(path, F.array("n_name", "s_name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise(F.col("s_name")), F.lit(False)).alias("route"))


@query("select doc_id attempt from documents join labels using (doc_id) where quality = 1 and toxic = 0 and doc_id < 500 order by doc_id limit 25")
def h6_acceptance(spark, d):
    """The first 25 accepted attempts out of 20 times as many: both numbers are the operator's arguments."""
    attempts = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("attempt"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("accepted"))
    return H.accepted_attempts(attempts, 25).select("attempt")


@query(
    F10_SQL
    + """, st as (select doc_id, case when doc_id % 14 = 0 then 'structure_review_required' when doc_id % 14 = 1 then 'example_review_required' when doc_id % 5 = 4 then 'single_hop_review' when not (well and answerable and matched and follows and seq and not extra and aligned and needed and clear) then 'multi_hop_review' when doc_id % 3 = 0 then 'ambiguity' end stage from v)
    select stage, count(*) n from st where stage is not null group by 1"""
)
def h7_rejection_funnel(spark, d):
    """Attempts stop at the first stage that rejects them: the catalogue's gate, the hops' review, the verdict of f10, ambiguity."""
    x = F.col("doc_id")
    judged = f10_multi_hop_verdict(spark, d)
    stage = F.when(x % 14 == 0, H.FUNNEL[0]).when(x % 14 == 1, H.FUNNEL[1]).when(x % 5 == 4, H.FUNNEL[2]).when(~F.col("accepted"), H.FUNNEL[4]).when(x % 3 == 0, H.FUNNEL[5])
    return H.funnel(judged.select(stage.alias("stage")))


@query(
    """select s_name question_id, to_json({'question': 'Where is ' || s_name || '?', 'answer': r_name, 'structure_id': 'chain', 'entities': {'a': s_name, 'b': n_name, 'c': r_name}, 'entity_path': [s_name, n_name, r_name],
    'resolved_hops': [{'hop': 1, 'source': s_name, 'target': n_name}, {'hop': 2, 'source': n_name, 'target': r_name}], 'single_hops': [{'hop': 1, 'question': 'Which nation?', 'answer': n_name}, {'hop': 2, 'question': 'Which region?', 'answer': r_name}],
    'context': s_comment_, 'context_passages': [{'text_unit_id': s_name, 'text': s_comment_}], 'multi_hop_review': {'accepted': true}, 'operation_review': {'valid': true}, 'ambiguity': {'decision': 'accepted'}, 'distractors': others, 'all_entities': [s_name, n_name, r_name]})::varchar record
    from (select *, s_name || ' lies in ' || n_name s_comment_, (select list(r2.r_name order by r2.r_name) from region r2 where r2.r_name <> r_name) others from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)""".replace("from region r2 where r2.r_name <> r_name)", "from region r2 where r2.r_name <> region.r_name)")
)
def h8_accepted_record(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # a handful of regions
    every = table(spark, d, "region").agg(F.array_sort(F.collect_list("r_name")).alias("every"))
    text = F.concat("s_name", F.lit(" lies in "), "n_name")
    hop = lambda i, a, b: F.struct(F.lit(i).alias("hop"), F.col(a).alias("source"), F.col(b).alias("target"))
    asked = lambda i, q, a: F.struct(F.lit(i).alias("hop"), F.lit(q).alias("question"), F.col(a).alias("answer"))
    return H.accepted_record(
        rows.join(every).select(
            F.col("s_name").alias("question_id"), F.concat(F.lit("Where is "), "s_name", F.lit("?")).alias("question"), F.col("r_name").alias("answer"), F.lit("chain").alias("structure_id"),
            F.create_map(F.lit("a"), "s_name", F.lit("b"), "n_name", F.lit("c"), "r_name").alias("entities"), F.array("s_name", "n_name", "r_name").alias("entity_path"), F.array(hop(1, "s_name", "n_name"), hop(2, "n_name", "r_name")).alias("resolved_hops"),
            F.array(asked(1, "Which nation?", "n_name"), asked(2, "Which region?", "r_name")).alias("single_hops"), text.alias("context"), F.array(F.struct(F.col("s_name").alias("text_unit_id"), text.alias("text"))).alias("context_passages"),
            F.struct(F.lit(True).alias("accepted")).alias("multi_hop_review"), F.struct(F.lit(True).alias("valid")).alias("operation_review"), F.struct(F.lit("accepted").alias("decision")).alias("ambiguity"), F.array_except("every", F.array("r_name")).alias("distractors"),
        )
    )


_DIGIT = "('0x' || substr(md5({0}), {1}, 2))::bigint"
#: Canned answers of the stages by the digest of the question: a few can't be processed, a few stages lack an answer, some adjudications say no.
EVAL_SQL = f"""al_ as (select *, {_DIGIT.format('question', 1)} % 4 <> 0 pre, {_DIGIT.format('question', 3)} % 9 = 0 lost, {_DIGIT.format('question', 5)} % 5 <> 0 yes from items),
i as (select *, case when not pre then 2 when lost then 4 else 7 end n_stages, yes and (not pre or not lost) accepted from al_)"""
DOCS_SQL = "with items as (select doc_id, 'Q ' || doc_id question, coalesce(text, '') context from documents), "


def _answers(items):
    """(item_id, stage, response) for (item_id, question): one in nine lacks the shortcut stage."""
    two = lambda at: F.conv(F.substring(F.md5("question"), at, 2), 16, 10).cast("int")
    each = items.select("item_id", "question", F.explode(F.array(*[F.lit(s) for s in H.STAGES])).alias("stage")).filter(~((F.col("stage") == "shortcut") & (two(3) % 9 == 0)))
    body = F.when(F.col("stage") == "precheck", F.when(two(1) % 4 != 0, '```json\n{"processable": true}\n```').otherwise('{"processable": "true"}')).when(F.col("stage") == "adjudication", F.when(two(5) % 5 != 0, '{"accepted": true}').otherwise('{"accepted": null}')).otherwise(F.concat(F.lit('Here: {"s": "'), "stage", F.lit('"}')))
    return each.select("item_id", "stage", body.alias("response"))


def _items(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.concat(F.lit("Q "), F.col("doc_id").cast("string")).alias("question"), F.coalesce("text", F.lit("")).alias("context"))


# an item without a shortcut answer is asked six stages, of which five are answered, and its adjudication never
@query(DOCS_SQL + EVAL_SQL.replace("when lost then 4", "when lost then 5") + " select doc_id item_id, pre processable, n_stages, accepted from i")
def h9_staged_evaluation(spark, d):
    items = _items(spark, d)
    return H.staged_evaluation(items, _answers(items))


def _stage_sql(stage: str) -> str:
    answer = lambda s: "case when pre then '{\"processable\": true}' else '{\"processable\": \"true\"}' end" if s == "precheck" else f"case when pre then '{{\"s\": \"{s}\"}}' else '{{}}' end"
    blocks = " || ".join(f"chr(10) || chr(10) || '{s.capitalize()}:' || chr(10) || {answer(s)}" for s in H.STAGE_INPUTS[stage])
    ready = {"precheck": "true", "adjudication": "not pre or not lost"}.get(stage, "pre")
    return f"select doc_id item_id, '{stage}' stage, sha256('evaluate:{stage}' || chr(0) || 'Task: {H.STAGE_TASKS[stage]}' || chr(10) || chr(10) || 'Question:' || chr(10) || question {'|| ' + blocks if blocks else ''} || chr(10) || chr(10) || 'Context:' || chr(10) || context) key from i where {ready}"


@query(DOCS_SQL + EVAL_SQL + " " + " union all ".join(_stage_sql(s) for s in H.STAGES))
def h9_stage_prompts(spark, d):
    """The prompts of all stages, each with the answers before it, as far as those let it be asked."""
    items = _items(spark, d)
    return H.evaluation_prompts(items, _answers(items)).select("item_id", "stage", "key")


@query(
    f"""with p as (select doc_id, coalesce(text, '') context, md5(coalesce(text, '')) h from documents), f as (select * from p order by doc_id limit 40),
    u as (select * from p where doc_id % 3 <> 0 and doc_id < 800 order by doc_id limit 40), w as (select * from p where doc_id % 3 <> 0 and doc_id % 2 = 0 and doc_id < 800 order by doc_id limit 40),
    items as (select 'baseline' "mode", 'D ' || h question from f union all select 'no_graph', 'J ' || md5('H ' || h) from f union all select 'no_composition', 'D ' || h from w union all select 'no_self_review', 'G ' || doc_id from u union all select 'full', 'G ' || doc_id from w), {EVAL_SQL}
    select "mode", count(*) n, count(*) filter (accepted) n_accepted, round(avg(accepted::int), 6) rate from i group by 1"""
)
def h10_ablation(spark, d):
    """Five modes of up to 40 questions each (the operator's count), every one with its own prompts, responses and gates."""
    contexts = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.coalesce("text", F.lit("")).alias("context"))
    answered = lambda rows, kind, name, digest, out: H.prompts(rows, kind).select("key", F.concat(F.lit(name), digest).alias(out)).distinct()
    of_context = F.md5(F.encode("context", "UTF-8"))
    listed = answered(contexts, "hop_list", "H ", of_context, "hops")
    joined = answered(contexts.withColumn("hops", F.concat(F.lit("H "), of_context)), "hop_join", "J ", F.md5("hops"), "question")
    x = F.col("pos")
    attempts = contexts.select(x.alias("attempt"), F.concat(F.lit("G "), x.cast("string")).alias("question"), "context", (x % 3 != 0).alias("passes"), ((x % 3 != 0) & (x % 2 == 0)).alias("reviewed"))
    made = H.ablation_items(contexts, attempts, answered(contexts, "direct", "D ", of_context, "question"), listed, joined, 40)
    items = cut(made.withColumn("item_id", F.concat_ws(":", "mode", "item_id")))
    return H.ablation(H.staged_evaluation(items, _answers(items)).join(items.select("item_id", "mode"), "item_id"))


@query(DOCS_SQL + EVAL_SQL + " select doc_id, question, md5(context) context, accepted from i")
def h11_batch_evaluation(spark, d):
    """Records of question and context with their evaluation."""
    items = _items(spark, d)
    done = H.staged_evaluation(items, _answers(items))
    return items.join(done, "item_id").select(F.col("item_id").alias("doc_id"), "question", F.md5(F.encode("context", "UTF-8")).alias("context"), "accepted")


# -- annotations: three reviewers of labelled documents ----------------------------------------------------------------

NOTES_SQL = """with n as (select doc_id item_id, 'a' reviewer, quality = 1 answerable, toxic = 0 multi_hop from labels union all
select doc_id, 'b', (quality = 1) <> (doc_id % 7 = 0), toxic = 0 from labels union all select doc_id, 'c', quality = 1, case when doc_id % 5 <> 0 then toxic = 0 end from labels),
f as (select item_id, reviewer, coalesce(answerable, false) x, coalesce(multi_hop, false) y from n)"""


def _notes(spark, d):
    base = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 0).alias("t"))
    a = base.select("item_id", F.lit("a").alias("reviewer"), F.col("q").alias("answerable"), F.col("t").alias("multi_hop"))
    b = base.select("item_id", F.lit("b").alias("reviewer"), (F.col("q") != (F.col("item_id") % 7 == 0)).alias("answerable"), F.col("t").alias("multi_hop"))
    c = base.select("item_id", F.lit("c").alias("reviewer"), F.col("q").alias("answerable"), F.when(F.col("item_id") % 5 != 0, F.col("t")).alias("multi_hop"))
    return a.unionByName(b).unionByName(c)


@query(NOTES_SQL + " select p.reviewer a, q.reviewer b, count(*) filter ((p.x and p.y) = (q.x and q.y)) n_agree, count(*) n_items from f p join f q using (item_id) group by all")
def i1_agreement(spark, d):
    return N.agreement(_notes(spark, d))


@query(NOTES_SQL + " select item_id, quality, toxic, count(*) filter (x) >= 2 answerable, count(*) filter (y) >= 2 multi_hop, count(*) n_reviewers from f join (select distinct doc_id, quality, toxic from labels) l on doc_id = item_id group by all")
def i2_majority_vote(spark, d):
    items = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), "quality", "toxic").distinct()
    return N.majority(_notes(spark, d), items)


@query(NOTES_SQL + ", n2 as (select * from n where reviewer <> 'c' or item_id % 4 <> 0) select reviewer, count(distinct item_id) n_items, 'other number of items' reason from n2 group by 1 having count(distinct item_id) < (select count(distinct item_id) from n2)")
def i2_uneven_reviewers(spark, d):
    """The third reviewer lacks every fourth item."""
    return N.uneven_reviewers(_notes(spark, d).filter((F.col("reviewer") != "c") | (F.col("item_id") % 4 != 0)))


@query(NOTES_SQL + " select p.reviewer a, q.reviewer b, count(*) filter (p.x and q.x) answerable, count(*) filter (p.y and q.y) multi_hop, count(*) filter (p.x and q.x and p.y and q.y) valid from f p join f q using (item_id) where p.reviewer < q.reviewer group by all")
def i3_validity_counts(spark, d):
    return N.validity_counts(_notes(spark, d))


@query(
    """with r as (select turn % 2 kind, text completion, case when conv_id % 3 = 0 then translate(text, 'e', 'E') || '!' when conv_id % 3 = 1 then text || '</answer> and more' else text || ' x' end answer from conversations where role = 'assistant'),
    p as (select kind, trim(regexp_replace(regexp_replace(lower(split_part(completion, '</answer>', 1)), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+', ' ', 'g')) = trim(regexp_replace(regexp_replace(lower(split_part(answer, '</answer>', 1)), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+', ' ', 'g')) ok from r)
    select kind, count(*) n, count(*) filter (ok) n_correct, round(avg(ok::int), 6) accuracy from p group by 1"""
)
def i4_exact_match(spark, d):
    x = F.col("conv_id") % 3
    answer = F.when(x == 0, F.concat(F.translate("text", "e", "E"), F.lit("!"))).when(x == 1, F.concat("text", F.lit("</answer> and more"))).otherwise(F.concat("text", F.lit(" x")))
    records = table(spark, d, "conversations").filter("role = 'assistant'").select((F.col("turn") % 2).alias("kind"), F.col("text").alias("completion"), answer.alias("answer"))
    return N.exact_match(records, "kind")

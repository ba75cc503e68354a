"""Graph, index, review and sampling operators on literal rows and against brute force."""

import hashlib
import itertools
import json
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hopmine.functions.ids import uuid5
from hopmine.functions.text import json_object, normal_answer, strip
from hopmine.operators import ambiguity, generation, index, paths, provenance, review, structures, subgraphs
from hopmine.sources import tables


def graph(spark, n=9, m=16, seed=1):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(n)]
    ents = [(x, rng.choice("AB"), f"about {x}") for x in names]
    rels = [(f"r{k}", rng.choice(names), rng.choice(names), f"d{k}", rng.random()) for k in range(m)]
    return ents, rels, spark.createDataFrame(ents, "name string, type string, description string"), spark.createDataFrame(rels, "id string, source string, target string, description string, weight double")


def neighbours(rels):
    out = {}
    for _, s, t, *_ in rels:
        if s != t:
            out.setdefault(s, set()).add(t)
            out.setdefault(t, set()).add(s)
    return out


def connected(nodes, near):
    seen, todo = set(), [nodes[0]]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [y for y in near.get(x, ()) if y in nodes]
    return len(seen) == len(nodes)


def test_uuid5_equals_the_standard_one(spark):
    keys = ["", "entity:Ä", "relation:a\0b\0c"]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(uuid5(F.col("k"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, k)) for k in keys]


def test_json_object(spark):
    rows = ['{"x": 1}', '```json\n{"x": 1}\n```', 'Sure: {"x": {"y": 2}} done', "[1]", "no", None, "{broken", '[{"x": 1}]', '[note] {"x": 1}', '```\n{"x": 1}', ' \u2003{"x": 1}\n', "} {", '{"x": "}"', ""]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in rows], "k string").select(json_object(F.col("k"))).collect()]
    assert got == ['{"x": 1}', '{"x": 1}', '{"x": {"y": 2}}', None, None, None, None, None, '{"x": 1}', '{"x": 1}', '{"x": 1}', None, None, None]


def test_strip_and_normal_answer(spark):
    df = spark.createDataFrame([("  a b\t\n",), (" The Café, an  Éclair! ",), (None,), ("STRASSE straße",)], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == ["a b", "The Café, an  Éclair!", None, "STRASSE straße"]
    assert [r[0] for r in df.select(normal_answer("t")).collect()] == ["b", "cafe eclair", None, "strasse strasse"]


# -- sources -----------------------------------------------------------------------------------------------------------


def test_tables_round_trip(spark, tmp_path):
    some = {name: spark.createDataFrame([], schema) for name, schema in tables.SCHEMAS.items()}
    some["documents"] = spark.createDataFrame([("1", "t", "ä")], tables.SCHEMAS["documents"])
    tables.write_tables(some, str(tmp_path))
    back = tables.read_tables(spark, str(tmp_path))
    assert {k: v.count() for k, v in back.items()} == {"documents": 1, "text_units": 0, "entities": 0, "relationships": 0, "claims": 0}
    assert back["text_units"].schema["document_ids"].dataType.simpleString() == "array<string>"


def test_corpus_and_records(spark, tmp_path):
    (tmp_path / "a.b.txt").write_text("line 1\nline 2")
    row = tables.read_corpus(spark, str(tmp_path / "*.txt")).first()
    assert (row.title, row.raw_content, row.id) == ("a.b", "line 1\nline 2", str(uuid.uuid5(uuid.NAMESPACE_URL, str(tmp_path / "a.b.txt"))))
    (tmp_path / "a b+c%20.txt").write_text("x")
    odd = tables.read_corpus(spark, str(tmp_path / "a b*.txt")).first()
    assert (odd.title, odd.id) == ("a b+c%20", str(uuid.uuid5(uuid.NAMESPACE_URL, str(tmp_path / "a b+c%20.txt"))))
    (tmp_path / "one.json").write_text('{"q": "x",\n "n": 1}')
    (tmp_path / "many.json").write_text('[{"q": "y", "n": 2}, {"q": "z", "n": 3}]')
    got = tables.read_records(spark, str(tmp_path / "*.json"), "q string, n long")
    assert sorted(r.q for r in got.collect()) == ["x", "y", "z"]
    tables.write_records(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_id_lists_and_pending(spark):
    df = spark.createDataFrame([(1, ["a", None, "b"], "x"), (2, None, None)], "k int, l array<string>, s string")
    got = df.select("k", tables.id_list(F.col("l"), "array<string>").alias("l"), tables.id_list(F.col("s"), "string").alias("s")).orderBy("k").collect()
    assert [(r.l, r.s) for r in got] == [(["a", "b"], ["x"]), ([], [])]
    prompts = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, n int")
    assert [r.key for r in tables.pending_prompts(prompts, spark.createDataFrame([("b",)], "key string")).collect()] == ["a"]
    key = spark.range(1).select(tables.prompt_key(F.lit("p"), F.lit("q"))).first()[0]
    assert key == hashlib.sha256(b"p\0q").hexdigest()


# -- index -------------------------------------------------------------------------------------------------------------


def test_chunks(spark):
    df = spark.createDataFrame([("d", "abcdef"), ("e", ""), ("f", "ab")], "id string, raw_content string")
    got = index.chunks(df, 3, 1).orderBy("document_id", "chunk").collect()
    assert [(r.document_id, r.text, r.n_tokens) for r in got] == [("d", "abc", 3), ("d", "cde", 3), ("d", "ef", 2), ("f", "ab", 2)]
    assert got[0].id == str(uuid.uuid5(uuid.NAMESPACE_URL, "d:0"))
    words = index.chunks(spark.createDataFrame([("d", " a b  c d ")], "id string, raw_content string"), 3, 1, "word").orderBy("chunk").collect()
    assert [r.text for r in words] == ["a b c", "c d"]
    raw = index.chunks(spark.createDataFrame([("d", "aéb")], "id string, raw_content string"), 2, 0, "byte").orderBy("chunk").collect()
    assert [(r.text, r.n_tokens) for r in raw] == [("a", 1), ("b", 1)]
    for size, overlap in ((1, 0), (3, 3), (3, -1)):
        with pytest.raises(ValueError):
            index.chunks(df, size, overlap)


def test_index_merges_in_reading_order(spark):
    rows = [
        ("u2", 1, 0, 1, '{"entities": [{"name": " Ann ", "type": "place", "description": "second"}, {"name": " "}], "relationships": [{"source": "Ann", "target": "Bob", "description": "d", "weight": 7}]}'),
        ("u1", 0, 0, 1, '```json\n{"entities": [{"name": "Ann", "type": "person", "description": "first"}, {"name": "Bob", "type": "odd"}], "relationships": [{"source": "Ann", "target": "Bob", "description": "d"}, {"source": "Ann", "target": "Zed", "description": "d"}, {"source": "Ann", "target": "Bob", "description": " "}], "claims": [{"subject": "Ann", "description": "c"}]}\n```'),
        ("u3", 2, 0, 1, "nothing"),
    ]
    responses = spark.createDataFrame(rows, "unit_id string, doc_pos long, chunk int, pass int, response string")
    parsed = index.parsed(responses)
    found, linked = index.mentions(parsed, ["person", "place"]), index.relation_mentions(parsed)
    entities = index.merged_entities(found)
    got = {r.name: r for r in index.with_unit_ids(entities, index.entity_units(found), ["name"]).collect()}
    assert (got["Ann"].type, got["Ann"].description, got["Ann"].text_unit_ids) == ("PERSON", "first second", ["u1", "u2"])
    assert got["Bob"].type == "PLACE" and set(got) == {"Ann", "Bob"}
    relations = index.merged_relationships(linked, entities)
    listed = index.with_unit_ids(relations, index.relation_units(linked), index.KEYS)
    assert [(r.source, r.target, r.weight, r.text_unit_ids) for r in listed.collect()] == [("Ann", "Bob", 1.0, ["u1", "u2"])]
    assert [(r.unit_id, r.reason) for r in index.rejected(responses).collect()] == [("u3", "no JSON object")]
    units = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "id string")
    members = {r.id: (len(r.entity_ids), len(r.relationship_ids)) for r in index.memberships(units, found, linked, entities, relations).collect()}
    assert members == {"u1": (2, 1), "u2": (1, 1), "u3": (0, 0)}
    assert [r.subject for r in index.claims(parsed).collect()] == ["Ann"]


# -- graph -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("directed,n", [(False, 2), (True, 2), (False, 3), (True, 3), (False, 4), (True, 4), (False, 5)])
def test_type_sequences_by_brute_force(spark, directed, n):
    ents, rels, e, r = graph(spark)
    kind = {n: t for n, t, _ in ents}
    edges = {(s, t) for _, s, t, *_ in rels if s != t}
    if not directed:
        edges |= {(t, s) for s, t in edges}
    want = Counter()
    for p in itertools.permutations(kind, n):
        if all(x in edges for x in zip(p, p[1:])) and (directed or p < p[::-1]):
            want[tuple(kind[x] for x in p)] += 1
    got = {tuple(x.types): x.n_paths for x in paths.rank_type_sequences(r, e, n, directed).collect()}
    assert got == want
    assert sum(x.n_paths for x in paths.rank_type_sequences(r, e, 1).collect()) == len(ents)


def test_connected_sets_by_brute_force(spark):
    ents, rels, e, r = graph(spark)
    near = neighbours(rels)
    want = {c for k in (1, 2, 3, 4) for c in itertools.combinations(sorted(n for n, *_ in ents), k) if connected(c, near)}
    got = subgraphs.connected_sets(paths.undirected(r), e, 1, 4)
    assert {tuple(x.nodes) for x in got.collect()} == want
    first = subgraphs.connected_sets(paths.undirected(r), e, 2, 3, limit=3).collect()
    assert [tuple(x.nodes) for x in first] == sorted(c for c in want if len(c) == 2)[:3]
    few = subgraphs.connected_sets(paths.undirected(r), e, 2, 2, max_degree=2)
    small = {x for x in near if len(near[x]) <= 2}
    assert {tuple(x.nodes) for x in few.collect()} == {c for c in want if len(c) == 2 and set(c) <= small}


def test_connectivity_and_sampling(spark):
    ents, rels, e, r = graph(spark)
    near = neighbours(rels)
    sets = [list(c) for c in itertools.combinations(sorted(n for n, *_ in ents), 3)]
    df = spark.createDataFrame([("|".join(c), c) for c in sets], "set_id string, nodes array<string>")
    got = {x.set_id: x.connected for x in subgraphs.is_connected(df, paths.undirected(r)).collect()}
    assert got == {"|".join(c): connected(c, near) for c in sets}
    pairs = paths.undirected(r)
    drawn = subgraphs.sampled_sets(pairs, e, 2, 3, 12, seed=4).collect()
    assert [x.nodes for x in drawn] == [x.nodes for x in subgraphs.sampled_sets(pairs, e, 2, 3, 12, seed=4).collect()]
    assert len({tuple(x.nodes) for x in drawn}) == len(drawn) == 12 and all(connected(x.nodes, near) for x in drawn)
    with pytest.raises(ValueError):
        subgraphs.check_sizes(3, 2, 9)


def test_instances_are_all_sets_or_a_sample(spark):
    _, rels, e, r = graph(spark, seed=2)
    pairs, near = paths.undirected(r), neighbours(rels)
    every = {tuple(x.nodes) for x in subgraphs.connected_sets(pairs, e, 2, 3).collect()}
    # 9 nodes have 36 + 84 combinations
    assert {tuple(x.nodes) for x in structures.instances(pairs, e, 2, 3, bound=120).collect()} == every
    drawn = [tuple(x.nodes) for x in structures.instances(pairs, e, 2, 3, bound=119, count=5).collect()]
    assert len(drawn) == len(set(drawn)) == 5 and set(drawn) < every and all(connected(x, near) for x in drawn)


def test_self_loops_and_parallel_edges_count(spark):
    e = spark.createDataFrame([("a", "T", ""), ("b", "T", "")], "name string, type string, description string")
    r = spark.createDataFrame([("1", "a", "a", "", 1.0), ("2", "a", "b", "", 1.0), ("3", "a", "b", "x", 1.0)], "id string, source string, target string, description string, weight double")
    sets = spark.createDataFrame([("s", ["a", "b"])], "set_id string, nodes array<string>")
    got = {x.name: (x.degree, x.n_in, x.n_out) for x in subgraphs.degrees(sets, r).collect()}
    assert got == {"a": (4, 1, 3), "b": (2, 2, 0)}
    record = subgraphs.subgraph_records(sets, r, e).first()
    assert (record.n_nodes, record.n_edges) == (2, 3)


@pytest.mark.parametrize("directed", [False, True])
def test_canonical_ids_ignore_names(spark, directed):
    ents, rels, e, r = graph(spark, 7, 12, seed=3)
    sets = [list(c) for c in itertools.combinations(sorted(n for n, *_ in ents), 3)]
    df = spark.createDataFrame([("|".join(c), c) for c in sets], "set_id string, nodes array<string>")
    got = {x.set_id: x.structure_id for x in structures.canonical(subgraphs.subgraph_records(df, r, e), directed).collect()}
    few = df.unionByName(spark.createDataFrame([("n0", ["n0"]), ("n1|n2", ["n1", "n2"])], "set_id string, nodes array<string>"))
    assert {x.set_id: x.structure_id for x in structures.canonical_sets(df, r, e, 3, directed).collect()} == got
    records = structures.canonical(subgraphs.subgraph_records(few, r, e), directed).collect()
    assert Counter(map(tuple, structures.canonical_sets(few, r, e, 4, directed).collect())) == Counter(map(tuple, records))
    kind = {n: t for n, t, _ in ents}
    shape = {}
    for c in sets:
        options = []
        for p in itertools.permutations(c):
            types = [kind[x] for x in p]
            if types == sorted(types):
                counts = Counter()
                for _, s, t, *_ in rels:
                    if s in c and t in c:
                        k = (p.index(s), p.index(t))
                        counts[k if directed else tuple(sorted(k))] += 1
                options.append((tuple(types), tuple(sorted((*k, n) for k, n in counts.items()))))
        shape["|".join(c)] = frozenset(options)
    assert set(got) == set(shape)
    for a, b in itertools.combinations(shape, 2):
        assert (got[a] == got[b]) == bool(shape[a] & shape[b])


def test_canonical_id_compares_text():
    # a multiplicity of 10 is smaller than 2 as text
    assert structures.canonical_id(["T", "T"], [(0, 1, 2), (1, 0, 10)], True) == '{"directed":true,"entity_types":["T","T"],"edges":[[0,1,10],[1,0,2]]}'


def test_draws(spark):
    inst = spark.createDataFrame([("x" if i < 30 else "y" if i < 39 else "z", f"s{i}") for i in range(40)], "structure_id string, set_id string")
    many = structures.draw_with_replacement(inst, 4000, "proportional", seed=1).groupBy("structure_id").count().collect()
    share = {r.structure_id: r["count"] / 4000 for r in many}
    assert sum(r["count"] for r in many) == 4000 and abs(share["x"] - 0.75) < 0.04 and abs(share["z"] - 0.025) < 0.02
    even = {r.structure_id: r["count"] / 3000 for r in structures.draw_with_replacement(inst, 3000, "uniform", seed=1).groupBy("structure_id").count().collect()}
    assert all(abs(v - 1 / 3) < 0.05 for v in even.values())
    every = structures.draw_without_replacement(inst, 40, "rare", seed=2).collect()
    assert len({r.set_id for r in every}) == 40 and {r.draw for r in every} == set(range(40))
    with pytest.raises(ValueError):
        structures.draw_without_replacement(inst, 41)
    with pytest.raises(ValueError):
        structures.policy_weight(F.lit(1), "common", 0.0)
    assert abs(sum(r.proportion for r in structures.frequencies(inst).collect()) - 1) < 1e-9


def test_representatives_by_brute_force(spark):
    rng = random.Random(6)
    words = "abcdefgh"
    rows = [(f"t{i % 2}", f"s{i:02}", f"n{i:02}", round(rng.random() * 2, 3), sorted(set(rng.choices(words, k=4)))) for i in range(30)]
    df = spark.createDataFrame(rows, "structure_id string, set_id string, names string, quality double, signature array<string>")
    got = {}
    for r in structures.representatives(df, 4).orderBy("structure_id", "rank").collect():
        got.setdefault(r.structure_id, []).append(r.set_id)
    for t in ("t0", "t1"):
        pool, chosen = [r for r in rows if r[0] == t], []
        while len(chosen) < 4:
            like = lambda r: max((len(set(r[4]) & set(c[4])) / len(set(r[4]) | set(c[4])) for c in chosen), default=0.0)
            best = max((r for r in pool if r not in chosen), key=lambda r: (r[3] - like(r), r[2]))
            chosen.append(best)
        assert got[t] == [c[1] for c in chosen]
    have = spark.createDataFrame([("t0", 3)], "structure_id string, n_examples int")
    assert Counter(r.structure_id for r in structures.backfill(have, df, 4).collect()) == {"t0": 1, "t1": 4}


def test_hops(spark):
    kind = "array<struct<hop:int,source:string,target:string,operation:string,inputs:array<string>,returns:array<string>>>"
    hops = [(1, "a", "b", None, None, None), (2, "c", "b", None, None, None), (3, None, None, "argmax", ["a", "zz"], ["c"])]
    df = spark.createDataFrame([(hops, {"a": "A", "b": "B", "c": "C"})], f"hops {kind}, roles map<string,string>")
    r = df.select(structures.resolved_hops(F.col("hops"), F.col("roles")).alias("h")).first().h
    assert [(x.source, x.target) for x in r] == [("A", "B"), ("C", "B"), (None, None)] and r[2].inputs == ["A", "zz"] and r[2].returns == ["C"]
    back = spark.createDataFrame([([(1, "a", "b", None, None, None), (2, "b", "c", None, None, None), (3, "b", "c", None, None, None), (4, "d", "e", None, None, None)],)], f"hops {kind}")
    assert back.select(structures.ordered_path(F.col("hops"))).first()[0] == ["a", "b", "c", "b"]
    path = df.select(structures.ordered_path(structures.relational_hops(structures.resolved_hops(F.col("hops"), F.col("roles"))))).first()[0]
    assert path == ["A", "B", "C"]


# -- provenance --------------------------------------------------------------------------------------------------------


def test_budget_skips_and_stops(spark):
    ranked = spark.createDataFrame([("p", f"u{i}", i) for i in range(1, 6)], "path_id string, unit_id string, rank int")
    units = spark.createDataFrame([("u1", 5), ("u2", 9), ("u3", 3), ("u4", None), ("u5", 2)], "id string, n_tokens int")
    pick = lambda *a: [r.unit_id for r in provenance.selected_units(ranked, units, *a).orderBy("pos").collect()]
    assert pick(None, 10) == ["u1", "u3", "u4", "u5"]
    assert pick(2, 10) == ["u1", "u3"]
    assert pick(3, None) == ["u1", "u2", "u3"]


# -- review ------------------------------------------------------------------------------------------------------------


def test_flags_must_be_literal(spark):
    rows = [
        (1, '{"answerable": true, "answer": "The X!", "evidence_sources": [1, 2]}', 2), (2, '{"answerable": "true", "answer": "x", "evidence_sources": [1]}', 2), (3, '{"answerable": true, "answer": "y z", "evidence_sources": [3]}', 2), (4, "?", 2),
        (5, '{"answerable": true, "answer": "q", "evidence_sources": []}', 2), (6, '{"answerable": true, "answer": "q", "evidence_sources": [2], "equivalent": [false, true]}', 2), (7, '{"answerable": true, "evidence_sources": [2]}', 2),
    ]
    df = spark.createDataFrame(rows, "id int, response string, n_passages int").withColumn("expected", F.lit("x")).withColumn("aliases", F.array(F.lit("Y, Z")))
    got = {r.id: (r.supported, r.failures) for r in review.single_hop_verdict(review.answer_match(review.parse(df, review.ANSWER))).collect()}
    none, cited, other = "not_answerable_from_context", "missing_or_invalid_evidence_citations", "answer_does_not_match_expected"
    # what isn't answerable fails for that alone
    assert got == {1: (True, []), 2: (False, [none]), 3: (False, [cited]), 4: (False, [none]), 5: (False, [cited, other]), 6: (True, []), 7: (False, [none])}


def test_multi_hop_conditions_one_by_one(spark):
    hop = lambda i: {"hop": i, "required_by_question": True, "supported_by_sources": True, "feeds_later_hop": i == 1}
    good = ({"well_formed": True, "answerable": True, "answer": "X"}, {"follows_intended_chain": True, "sequential_dependency": True, "unsupported_constraints": [], "hop_reviews": [hop(2), hop(1)]}, True, False)
    change = lambda at, **fields: tuple({**x, **fields} if i == at else x for i, x in enumerate(good))
    cases = [
        (good, []), (change(0, well_formed=None), ["not_well_formed"]), (change(0, answerable="yes"), ["not_answerable"]), (change(0, answer=None), ["not_answerable"]), (change(0, answer="other"), ["answer_mismatch"]),
        (change(1, follows_intended_chain=False), ["does_not_follow_intended_chain"]), (change(1, sequential_dependency=None), ["no_sequential_dependency"]), (change(1, unsupported_constraints=["c"]), ["unsupported_constraints"]), (change(1, unsupported_constraints=None), []),
        (change(1, hop_reviews=[hop(1)]), ["hop_alignment_failed"]), (change(1, hop_reviews=[hop(1), hop(1), hop(2)]), []), (change(1, hop_reviews=[hop(1), {**hop(2), "supported_by_sources": None}]), ["hop_alignment_failed"]),
        ((*good[:2], False, False), ["unnecessary_hop_or_bypass"]), ((*good[:3], None), ["shortcut_found"]), ((*good[:3], True), ["shortcut_found"]), ((*change(0, answerable=False, well_formed=False)[:2], None, None), ["not_well_formed", "not_answerable", "unnecessary_hop_or_bypass", "shortcut_found"]),
    ]
    df = spark.createDataFrame([(i, json.dumps(c[0]), json.dumps(c[1]), c[2], c[3]) for i, (c, _) in enumerate(cases)], "id int, response string, chain string, all_necessary boolean, shortcut_found boolean")
    df = review.parse(df.withColumn("expected", F.lit("x")).withColumn("aliases", F.array().cast("array<string>")).withColumn("n_hops", F.lit(2)), "struct<well_formed:boolean,answerable:boolean,answer:string,equivalent:array<boolean>>")
    df = review.answer_match(df).withColumn("chain", F.from_json("chain", review.CHAIN))
    got = {r.id: (r.accepted, r.failures, r.decision) for r in review.multi_hop_verdict(df).collect()}
    assert got == {i: (not f, f, "discarded" if f else "accepted") for i, (_, f) in enumerate(cases)}
    short = spark.createDataFrame([("p", ["a", "b"]), ("q", ["a", "b", "c"])], "path_id string, path array<string>")
    assert [r.path_id for r in review.short_paths(short).collect()] == ["p"]


def test_structure_verdicts(spark):
    hops = [(1, "a", "b"), (2, "b", "c"), (3, None, None)]
    said = lambda **x: json.dumps({"valid": True, "globally_unique": True, "shortcut_found": False, "hop_reviews": [{"hop": 1}, {"hop": 2}, {"hop": 1}], "operation_reviews": [{"hop": 3}], **x})
    rows = [
        (1, hops, said(), "strict", True, []), (2, hops, said(valid=False, failure_reasons=["f"]), "strict", False, ["f"]), (3, hops, said(valid=None), "loose", False, []), (4, hops, said(operation_reviews=[]), "loose", False, ["incomplete_topology_review"]),
        (5, hops, said(globally_unique=False), "strict", False, []), (6, hops, said(globally_unique=False), "balanced", True, []), (7, hops, said(shortcut_found=None), "loose", False, []), (8, [hops[0], hops[2]], said(), "strict", False, ["fewer_than_two_relational_hops"]),
    ]
    df = review.parse(spark.createDataFrame([r[:4] for r in rows], "id int, hops array<struct<hop:int,source:string,target:string>>, response string, rigor string"), review.STRUCTURE)
    got = {r.id: (r.accepted, r.failures) for r in review.structure_verdict(df).collect()}
    assert got == {r[0]: r[4:] for r in rows}


def test_operations(spark):
    rows = [("q", "argmin", "a", "2"), ("q", "argmin", "b", "1"), ("t", "temporal_order", "a", "2001-02-03"), ("t", "temporal_order", "b", "1999-01-01"), ("u", "argmax", "a", "x"), ("u", "argmax", "b", "1"), ("c", "counting", "a", None), ("c", "counting", "b", None)]
    rows += [("m", "comparison", "a", "1"), ("m", "comparison", "b", "3"), ("e", "comparison", "a", "1"), ("e", "comparison", "b", "1.0"), ("i", "intersection", "a", "x"), ("i", "intersection", "a", "y"), ("i", "intersection", "b", "x"), ("i", "intersection", "c", "y"), ("i", "intersection", "c", "x")]
    rows += [("s", "selection", "a", "true"), ("s", "selection", "b", "no"), ("n", "selection", "a", "no"), ("x", "unheard", "a", "1")]
    df = spark.createDataFrame(rows, "question_id string, operation string, name string, value string")
    computed = review.operation_answers(df)
    assert {r.question_id: r.answer for r in computed.collect()} == {"q": "b", "t": "b < a", "u": None, "c": "2", "m": "b", "e": "equal", "i": "a, c", "s": "a", "n": None, "x": None}
    said = spark.createDataFrame([("q", '{"valid": true, "answer": "said"}'), ("t", '{"valid": "true", "answer": "said"}'), ("u", "?")], "question_id string, response string")
    got = {r.question_id: (r.answer, r.stage) for r in review.operation_verdict(computed, said, computed).collect()}
    assert got["q"] == ("said", None) and got["t"] == got["u"] == (None, "operation_review") and got["c"] == ("2", None) and got["n"] == (None, "pending")
    assert {r.stage for r in review.operation_verdict(computed, said).filter("question_id = 'c'").collect()} == {"pending"}


# -- ambiguity ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("fixed", [(0,), (2,), (0, 2), (1,)])
def test_candidates_by_brute_force(spark, fixed):
    ents, rels, e, r = graph(spark, 9, 20, seed=8)
    kind, near = {n: t for n, t, _ in ents}, neighbours(rels)
    simple = [p for p in itertools.permutations(kind, 3) if p[1] in near.get(p[0], ()) and p[2] in near.get(p[1], ())]
    wanted = random.Random(1).sample(simple, 4)
    q = spark.createDataFrame([(i, list(p)) for i, p in enumerate(wanted)], "question_id int, path array<string>")
    got = {}
    for x in ambiguity.candidate_paths(q, paths.undirected(r), e, 3, fixed).collect():
        got.setdefault(x.question_id, set()).add((tuple(x.path), x.is_intended, x.complete))
    for i, w in enumerate(wanted):
        want = {p for p in simple if all(kind[a] == kind[b] for a, b in zip(p, w)) and all(p[k] == w[k] for k in fixed)}
        assert got[i] == {(p, p == w, True) for p in want}
    capped = ambiguity.candidate_paths(q, paths.undirected(r), e, 3, fixed, cap=1).collect()
    for i, w in enumerate(wanted):
        assert any(tuple(x.path) == w for x in capped if x.question_id == i)


def test_patterns_by_brute_force(spark):
    ents, rels, e, r = graph(spark, 9, 24, seed=5)
    kind, near = {n: t for n, t, _ in ents}, neighbours(rels)
    roles, edges = [("x", "A"), ("y", "B"), ("z", "A"), ("w", "B")], [("x", "y"), ("y", "z"), ("x", "w"), ("w", "z")]
    start = [n for n in kind if kind[n] == "A"]
    q = spark.createDataFrame([(n, n) for n in start], "question_id string, x string")
    got = {(g.x, g.y, g.z, g.w) for g in ambiguity.pattern_assignments(q, e, paths.undirected(r), roles, edges, ("x",)).collect()}
    want = set()
    for p in itertools.permutations(kind, 4):
        at = dict(zip("xyzw", p))
        if all(kind[at[k]] == t for k, t in roles) and all(at[b] in near.get(at[a], ()) for a, b in edges):
            want.add(p)
    assert got == want and want
    with pytest.raises(ValueError, match="unknown roles"):
        ambiguity.pattern_assignments(q, e, paths.undirected(r), roles, [*edges, ("x", "v")], ("x",))


@pytest.mark.parametrize("cap", [2, 3])
def test_a_search_that_the_cap_cuts_is_not_unique(spark, cap):
    e = spark.createDataFrame([("r", "L"), ("n1", "N"), ("n2", "N"), ("n3", "N"), ("p1", "P"), ("p2", "P")], "name string, type string")
    pairs = [("r", "n1"), ("r", "n2"), ("r", "n3"), ("n1", "p1"), ("n2", "p1"), ("n3", "p2")]
    both = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "a string, b string")
    q = spark.createDataFrame([("q", "r")], "question_id string, r string")
    found = ambiguity.pattern_assignments(q, e, both, [("r", "L"), ("n", "N"), ("p", "P")], [("r", "n"), ("n", "p")], ("r",), cap)
    rows = found.select("question_id", F.col("pos").alias("id"), F.col("p").alias("answer"), (F.col("p") == "p1").alias("admissible"), F.lit("p1").alias("intended_answer"), "complete")
    decided = ambiguity.structure_decision(rows, "disambiguate").first()
    assert found.count() == cap and decided.answers == ["p1"] and (decided.decision, decided.acceptable_answers) == (("accepted", ["p1"]) if cap == 3 else ("discarded", []))


def test_structure_decisions(spark):
    rows = [("q", i, a, ok, "x", True) for i, (a, ok) in enumerate([("x", True), ("y", True), ("z", None), ("w", False), ("x", False), ("v", False), ("u", False)])]
    rows += [("o", 0, "y", True, "x", True), ("n", 0, "x", False, "x", True)]
    df = spark.createDataFrame(rows, "question_id string, id int, answer string, admissible boolean, intended_answer string, complete boolean")
    again = spark.createDataFrame([("q", 0, "x", True), ("q", 1, "y", False), ("o", 0, "x", True)], "question_id string, id int, answer string, admissible boolean")
    got = lambda *a: {r.question_id: (r.decision, r.acceptable_answers, r.distractors) for r in ambiguity.structure_decision(df, *a).collect()}
    wrong = ["z", "w", "x", "v"]
    assert got("discard") == {"q": ("discarded", [], wrong), "o": ("discarded", [], []), "n": ("discarded", [], ["x"])}
    assert got("retain") == {"q": ("accepted", ["x", "y"], wrong), "o": ("accepted", ["y"], []), "n": ("discarded", [], ["x"])}
    # only a question whose intended answer is among the answers is asked again
    assert got("disambiguate", again) == {"q": ("disambiguated", ["x"], ["y"]), "o": ("discarded", [], []), "n": ("discarded", [], ["x"])}


def test_batches_with_other_ids_are_rejected(spark):
    records = spark.createDataFrame([("q", i) for i in range(45)], "question_id string, path_id int")
    said = spark.createDataFrame([("q", i // 20, i, True, [True]) for i in range(45) if i != 25] + [("q", 2, 99, True, [True])], "question_id string, batch int, path_id int, admissible boolean, hop_matches array<boolean>")
    good, rejects = ambiguity.ingest_verdicts(records, said)
    assert good.count() == 20 and sorted(r.batch for r in rejects.collect()) == [1, 2]


def test_policies_go_by_the_intended_answer(spark):
    """Paths p0.. with answers; the intended path of a and b is not admissible, another one to its answer is."""
    judged = [("a", 0, "x", True, False), ("a", 1, "x", False, True), ("b", 0, "x", True, False), ("b", 1, "x", False, True), ("b", 2, "y", False, True), ("c", 0, "x", True, True), ("c", 1, "y", False, True), ("d", 0, "x", True, False), ("d", 1, "y", False, True), ("e", 0, "x", True, False)]
    df = spark.createDataFrame([(q, i, [f"p{i}", x], x, own, ok, "x", True) for q, i, x, own, ok in judged], "question_id string, path_id int, path array<string>, answer string, is_intended boolean, admissible boolean, intended_answer string, complete boolean")
    groups = ambiguity.answer_groups(df)
    found = {r.question_id: (r.answers, r.intended_admissible, r.is_unique) for r in groups.collect()}
    assert found == {"a": (["x"], True, True), "b": (["x", "y"], True, False), "c": (["x", "y"], True, False), "d": (["y"], False, False), "e": ([], False, False)}
    assert {r.question_id: r.answer_paths for r in groups.collect()}["b"] == {"x": [["p1", "x"]], "y": [["p2", "y"]]}
    got = lambda *a: {r.question_id: (r.decision, r.acceptable_answers) for r in ambiguity.policy_decision(groups, *a).collect()}
    assert got("discard") == {"a": ("accepted", ["x"]), "b": ("discarded", []), "c": ("discarded", []), "d": ("discarded", []), "e": ("discarded", [])}
    assert got("retain") == {"a": ("accepted", ["x"]), "b": ("retained_with_alternatives", ["x", "y"]), "c": ("retained_with_alternatives", ["x", "y"]), "d": ("discarded", ["y"]), "e": ("discarded", [])}
    again = ambiguity.answer_groups(df.filter("question_id <> 'c' or answer = 'x'").filter("question_id <> 'a' and question_id <> 'e'"))
    assert got("disambiguate", again) == {"a": ("accepted", ["x"]), "b": ("discarded", []), "c": ("disambiguated", ["x"]), "d": ("discarded", []), "e": ("discarded", [])}
    with pytest.raises(ValueError):
        ambiguity.policy_decision(groups, "other", again)


def test_directed_records(spark):
    q = spark.createDataFrame([("q", ["a", "b"])], "question_id string, path array<string>")
    c = spark.createDataFrame([("q", 0, ["a", "b"], True, True)], "question_id string, path_id int, path array<string>, is_intended boolean, complete boolean")
    r = spark.createDataFrame([("a", "b", "there", 0.25), ("b", "a", "back", 0.5)], "source string, target string, description string, weight double")
    both, one = (ambiguity.path_records(c, r, q, directed=x).first() for x in (False, True))
    # the rows of the hop's own direction come first
    assert (both.hops[0].descriptions, both.total_weight) == (["there", "back"], 0.5) and (one.hops[0].descriptions, one.total_weight) == (["there"], 0.25)


def test_nearest_examples_by_brute_force(spark):
    rng = random.Random(3)
    text = lambda k: " ".join(rng.choice("abcdefghij") for _ in range(k))
    wanted = [(f"w{i}", "s" if i % 2 else "t", text(rng.randrange(4))) for i in range(12)]
    examples = [("s" if i % 3 else "t", i, i, text(3), rng.randrange(3)) for i in range(9)]
    got = {}
    w, x = spark.createDataFrame(wanted, "set_id string, structure_id string, text string"), spark.createDataFrame(examples, "structure_id string, example_id int, pos int, text string, n_contexts int")
    for r in structures.nearest_examples(w, x, 3).orderBy("set_id", "rank").collect():
        got.setdefault(r.set_id, []).append((r.example_id, round(r.overlap, 9)))
    for s, t, text_ in wanted:
        a = set(text_.split())
        like = lambda e: len(a & set(e[3].split())) / len(a | set(e[3].split()))
        best = sorted((e for e in examples if e[0] == t), key=lambda e: (-like(e), -e[4], e[2]))[:3]
        assert got[s] == [(e[1], round(like(e), 9)) for e in best]


def test_reviewers_and_catalogue(spark):
    from hopmine.operators import annotations

    notes = spark.createDataFrame([(i, r, i % 2 == 0, True) for i in range(4) for r in "abc" if (i, r) != (3, "c")], "item_id int, reviewer string, answerable boolean, multi_hop boolean")
    items = spark.createDataFrame([(i, f"q{i}") for i in range(4)], "item_id int, question string")
    assert {r.item_id: (r.question, r.answerable, r.multi_hop) for r in annotations.majority(notes, items).collect()} == {i: (f"q{i}", i % 2 == 0, True) for i in range(4)}
    assert [(r.reviewer, r.n_items) for r in annotations.uneven_reviewers(notes).collect()] == [("c", 3)]
    s = spark.createDataFrame([("x", "approved"), ("y", "approved"), ("z", None)], "structure_id string, review_status string")
    e = spark.createDataFrame([("x", 1, "approved", "q1"), ("x", 2, None, "q2"), ("y", 3, "pending", "q3"), (None, 4, "approved", "q4"), ("z", 5, "approved", "q5")], "structure_id string, example_id int, review_status string, question string")
    assert sorted((r.structure_id, r.example_id, r.question, r.source) for r in generation.approved_examples(s, e).collect()) == [("x", 1, "q1", "own"), ("y", 4, "q4", "general")]


def test_an_item_that_cant_be_processed_goes_to_adjudication(spark):
    items = spark.createDataFrame([("a", "Q", "C"), ("b", "Q", "C"), ("c", "Q", "C")], "item_id string, question string, context string")
    said = [("a", "precheck", '{"processable": false}'), ("b", "precheck", '```json\n{"processable": true}\n```'), ("b", "decomposition", '{"hops": []}')]
    responses = spark.createDataFrame(said, "item_id string, stage string, response string")
    asked = {}
    for r in generation.evaluation_prompts(items, responses).collect():
        asked.setdefault(r.item_id, {})[r.stage] = r.prompt
    assert {i: set(x) for i, x in asked.items()} == {"a": {"precheck", "adjudication"}, "b": {"precheck", "decomposition", "paths"}, "c": {"precheck"}}
    assert "Decomposition:\n{}" in asked["a"]["adjudication"] and '{"hops": []}' in asked["b"]["paths"]
    done = responses.unionByName(spark.createDataFrame([("a", "adjudication", '{"accepted": false}')], responses.schema))
    assert {r.item_id: (r.processable, r.n_stages, r.accepted) for r in generation.staged_evaluation(items, done).collect()} == {"a": (False, 2, False), "b": (True, 2, False), "c": (False, 0, False)}


def test_evaluation_sample_is_stable(spark):
    items = spark.range(50).select(F.col("id").alias("item_id"))
    a = [r.item_id for r in generation.evaluation_sample(items, 10, 79).collect()]
    assert a == [r.item_id for r in generation.evaluation_sample(items.repartition(3), 10, 79).collect()]
    assert a != [r.item_id for r in generation.evaluation_sample(items, 10, 44).collect()] and len(set(a)) == 10


# -- sets that are counted and numbered, not listed ---------------------------------------------------------------------


def tangled(spark, seed):
    """A graph with triangles, parallel relationships, self-loops, a hub, a missing type and an unknown end."""
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(13)]
    ents = spark.createDataFrame([(n, rng.choice(["A", "B", None])) for n in names], "name string, type string")
    ends = [(rng.choice(names), rng.choice(names)) for _ in range(40)] + [("n01", n) for n in names] + [("n00", "unknown")]
    return ents, spark.createDataFrame([(str(i), a, b, "d", 1.0) for i, (a, b) in enumerate(ends)], "id string, source string, target string, description string, weight double")


def listed(ents, rels, low, directed):
    sets = subgraphs.connected_sets(paths.undirected(paths.valid_edges(rels, ents)), ents, low, 3).withColumn("set_id", F.array_join("nodes", "|"))
    return sorted((r.structure_id, r.set_id) for r in structures.canonical_sets(sets, rels, ents, 3, directed).collect())


@pytest.mark.parametrize("directed", [True, False])
def test_census_counts_what_listing_finds(spark, directed):
    for seed in (1, 2):
        ents, rels = tangled(spark, seed)
        for low in (1, 3):
            got = {r.structure_id: r.n for r in structures.census(rels, ents, low, 3, directed).collect()}
            assert got == Counter(s for s, _ in listed(ents, rels, low, directed))
    with pytest.raises(ValueError, match="1 to 3"):
        structures.census(rels, ents, 2, 4)


@pytest.mark.parametrize("directed", [True, False])
def test_every_number_is_another_set(spark, directed):
    ents, rels = tangled(spark, 3)
    counted = structures.CountedSets(rels, ents, 2, directed)
    every = counted.frequencies().select("structure_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("pos"))
    got = counted.located(every)
    assert sorted((r.structure_id, "|".join(r.nodes)) for r in got.collect()) == listed(ents, rels, 2, directed)


def test_draws_of_numbers_are_draws_of_sets(spark):
    ents, rels = tangled(spark, 4)
    counted, want = structures.CountedSets(rels, ents, 3), set(listed(ents, rels, 3, True))
    again = [sorted((r.draw, r.structure_id, "|".join(r.nodes)) for r in counted.draw_with_replacement(200, "common", seed=5).collect()) for _ in range(2)]
    assert again[0] == again[1] and [r[0] for r in again[0]] == list(range(200)) and {r[1:] for r in again[0]} <= want
    once = {(r.structure_id, "|".join(r.nodes)) for r in counted.draw_without_replacement(len(want), "rare", seed=5).collect()}
    assert once == want
    with pytest.raises(ValueError, match="more draws"):
        counted.draw_without_replacement(len(want) + 1)


def test_empty_graphs_have_no_structures(spark):
    ents, rels = tangled(spark, 4)
    assert structures.census(rels.limit(0), ents.limit(0)).collect() == []
    assert structures.CountedSets(rels.limit(0), ents).frequencies().collect() == []


# -- first paths ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [2, 3, 4])
@pytest.mark.parametrize("limit", [1, 3, 40])
def test_first_paths_by_brute_force(spark, n, limit):
    """One type and a dense graph: walks come back to their own nodes, so prefixes die and searches run again."""
    rng = random.Random(10 * n + limit)
    names = [f"n{i}" for i in range(8)]
    kind = {m: rng.choice("AAB") for m in names}
    pairs = sorted({(a, b) for a in names for b in names if a != b and rng.random() < 0.35})
    ents = spark.createDataFrame(list(kind.items()), "name string, type string")
    asked = {}
    for i in range(6):
        types = [rng.choice("AAB") for _ in range(n)]
        fixed = [rng.choice([m for m in names if kind[m] == t]) if rng.random() < 0.4 else None for t in types]
        asked[f"q{i}"] = (types, fixed)
    searches = spark.createDataFrame([(q, t, f) for q, (t, f) in asked.items()], "search string, types array<string>, fixed array<string>")
    search = ambiguity.PathSearch(spark.createDataFrame(pairs, "a string, b string"), ents, n)
    got = {}
    for r in search.first(searches, limit).collect():
        got.setdefault(r.search, []).append(tuple(r.path))
    for q, (types, fixed) in asked.items():
        every = sorted(p for p in itertools.permutations(names, n) if all(e in pairs for e in zip(p, p[1:])) and all(kind[x] == t and f in (None, x) for x, t, f in zip(p, types, fixed)))
        assert sorted(got.get(q, [])) == every[:limit]


def test_a_hub_does_not_widen_a_search(spark):
    """2,000 nodes on either side of a hub have 4 million paths through it; no level has more than a few times the limit."""
    left, right = [f"l{i:04d}" for i in range(2000)], [f"r{i:04d}" for i in range(2000)]
    ents = spark.createDataFrame([("hub", "H"), *[(x, "L") for x in left], *[(x, "R") for x in right]], "name string, type string")
    pairs = [(x, "hub") for x in left] + [("hub", x) for x in right] + [(x, y) for x, y in zip(right, right[1:])]
    search = ambiguity.PathSearch(spark.createDataFrame(pairs, "a string, b string"), ents, 4)
    searches = spark.createDataFrame([("s", ["L", "H", "R", "R"], [None] * 4)], "search string, types array<string>, fixed array<string>")
    got = sorted(tuple(r.path) for r in search.first(searches, 51).collect())
    assert got == [("l0000", "hub", x, y) for x, y in zip(right, right[1:])][:51]
    assert search.widest <= 51 * 4 + 4


# -- texts, order of rows ---------------------------------------------------------------------------------------------------


def best(spark, examples, described, n):
    """Names of the examples (name, relations) chosen for a set with these descriptions."""
    wanted = spark.createDataFrame([("s", "k", described)], "set_id string, structure_id string, d array<string>").select("set_id", "structure_id", structures.relation_text(F.col("d")).alias("text"))
    none = F.lit(None).cast("array<string>")
    known = spark.createDataFrame([("k", name, i, r) for i, (name, r) in enumerate(examples)], "structure_id string, example_id string, pos int, r array<string>")
    known = known.withColumn("text", structures.example_text(none, none, F.col("r"))).withColumn("n_contexts", F.lit(0)).drop("r")
    return [r.example_id for r in structures.nearest_examples(wanted, known, n).orderBy("rank").collect()]


def test_nearest_examples_compare_relations_and_keys(spark):
    assert best(spark, [("Q1", ["was born in a city"]), ("Q2", ["directed a film"])], ["film directed by person"], 1) == ["Q2"]
    assert set(best(spark, [("Q1", ["born in city"]), ("Q2", ["city birthplace"]), ("Q3", ["directed film"])], ["birth city"], 2)) == {"Q1", "Q2"}
    # a key's name is a word of every example, and case is folded
    assert best(spark, [("Q1", ["x y z"]), ("Q2", ["STRASSE"])], ["Straße"], 1) == ["Q2"]
    rows = spark.createDataFrame([(["a"], ["b\nc"], ["D_1"])], "q array<string>, c array<string>, r array<string>").select(structures.example_text(F.col("q"), F.col("c"), F.col("r")).alias("t"))
    text = json.dumps({"questions": ["a"], "contexts": ["b\nc"], "relations": ["D_1"]}, ensure_ascii=False, separators=(",", ":"))
    assert rows.first().t == text


def test_descriptions_keep_the_order_of_rows(spark):
    rels = spark.createDataFrame([("a", "b", "zulu", 0.1, 1), ("a", "b", "alpha", 0.4, 2), ("b", "a", "mike", 0.9, 0), ("a", "b", None, None, 3)], "source string, target string, description string, weight double, position int")
    ents = spark.createDataFrame([("a", "A"), ("b", "B")], "name string, type string")
    q = spark.createDataFrame([("q", ["a", "b"])], "question_id string, path array<string>")
    found = spark.createDataFrame([("q", 0, ["a", "b"], True, True)], "question_id string, path_id int, path array<string>, is_intended boolean, complete boolean")
    for directed, want, weight in ((False, ["zulu", "alpha", "", "mike"], 0.9), (True, ["zulu", "alpha", ""], 0.4)):
        record = ambiguity.path_records(found, rels, q, directed=directed).first()
        assert record.hops[0].descriptions == want and record.total_weight == weight
        assert ambiguity.intended_constraints(q, rels, ents, directed).first().descriptions == want
    hops = spark.createDataFrame([("f", "a", "b", False), ("r", "a", "b", True), ("n", "b", "c", None)], "hop_id string, a string, b string, reverse boolean")
    assert {r.hop_id: r.text for r in generation.hop_texts(hops, rels.filter("description is not null")).collect()} == {"f": "zulu\nalpha", "r": "mike", "n": None}
    only = rels.filter("source = 'a' and description is not null")
    assert {r.hop_id: r.text for r in generation.hop_texts(hops, only).collect()}["r"] == "zulu\nalpha"


PATTERNS = {
    "chain": ([("x", "A"), ("y", "B"), ("z", "A")], [("x", "y"), ("y", "z")], ("x",)),
    "late": ([("x", "A"), ("y", "B"), ("z", "A")], [("x", "y"), ("y", "z")], ("z",)),
    "converge": ([("x", "A"), ("y", "A"), ("z", "B")], [("x", "z"), ("y", "z")], ("x",)),
    "diverge": ([("x", "B"), ("y", "A"), ("z", "A")], [("x", "y"), ("x", "z")], ()),
    "diamond": ([("x", "A"), ("y", "B"), ("z", "B"), ("w", "A")], [("x", "y"), ("x", "z"), ("y", "w"), ("z", "w")], ()),
    "triangle": ([("x", "A"), ("y", "A"), ("z", "B")], [("x", "y"), ("y", "z"), ("z", "x")], ("y",)),
    "apart": ([("x", "A"), ("y", "B"), ("z", "A")], [("x", "y")], ("x",)),
    "alone": ([("x", "B"), ("y", "B")], [], ()),
}


@pytest.mark.parametrize("shape", sorted(PATTERNS))
def test_patterns_of_every_shape_in_table_order(spark, shape):
    """Backtracking in role order over entities in table order, which isn't that of their names."""
    roles, edges, fixed = PATTERNS[shape]
    ents, rels, e, r = graph(spark, 9, 24, seed=6)
    kind, near = {n: t for n, t, _ in ents}, neighbours(rels)
    order = sorted(kind, key=lambda n: hashlib.md5(n.encode()).hexdigest())
    e = e.join(spark.createDataFrame([(n, i) for i, n in enumerate(order)], "name string, position long"), "name")
    starts = [n for n in kind if fixed and kind[n] == dict(roles)[fixed[0]]] or [None]
    q = spark.createDataFrame([(str(n), n) for n in starts], f"question_id string, {fixed[0] if fixed else 'unused'} string")
    for cap in (2, 1000):
        got = {}
        for g in ambiguity.pattern_assignments(q, e, paths.undirected(r), roles, edges, fixed, cap).orderBy("pos").collect():
            got.setdefault(g.question_id, []).append((tuple(g[x] for x, _ in roles), g.complete))
        for n in starts:
            every = []
            for p in itertools.permutations(order, len(roles)):
                at = dict(zip((x for x, _ in roles), p))
                if all(kind[at[x]] == t for x, t in roles) and all(at[y] in near.get(at[x], ()) for x, y in edges) and all(at[f] == n for f in fixed):
                    every.append((p, None))
            assert got.get(str(n), []) == [(p, len(every) <= cap) for p, _ in every[:cap]]


# -- what callers bring, and what is stored -----------------------------------------------------------------------------------


def letters():
    return lambda texts: [list(t) for t in texts], lambda windows: ["".join(w) for w in windows]


def utf8():
    return lambda texts: [list(t.encode()) for t in texts], lambda windows: [bytes(w).decode("utf-8", "ignore") for w in windows]


def test_a_callers_tokens_make_the_chunks(spark):
    df = spark.createDataFrame([("d", "abcdef"), ("e", ""), ("f", None), ("g", "größe 😀 x")], "id string, raw_content string")
    got = index.chunks(df, 3, 1, letters).filter("document_id = 'd'").orderBy("chunk").collect()
    assert [(r.text, r.n_tokens) for r in got] == [("abc", 3), ("cde", 3), ("ef", 2)]
    rows = lambda unit: sorted(map(tuple, index.chunks(df, 4, 1, unit).select("document_id", "chunk", "id", "text", "n_tokens").collect()))
    assert rows(utf8) == rows("byte") and index.chunks(df.limit(0), 3, 1, letters).collect() == []


def moody():
    """A provider that fails on its first call in a worker, then answers all but prompts with an x, and those with a y in the second try only."""
    calls, seen = [], set()

    def ask(prompts):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("busy")
        again = [p in seen for p in prompts]
        seen.update(prompts)
        return [None if "x" in p or ("y" in p and not old) else p.upper() for p, old in zip(prompts, again)]

    return ask


def test_a_provider_is_asked_again_for_what_it_left_out(spark):
    prompts = spark.createDataFrame([("1", "a"), ("2", "bx"), ("3", "cy"), ("1", "a")], "key string, prompt string").coalesce(1)
    from hopmine.functions.plugins import provided

    got = {r.key: (r.response, r.attempts) for r in provided(prompts.repartition(1), moody, attempts=3).collect()}
    assert {k: v[0] for k, v in got.items()} == {"1": "A", "2": None, "3": "CY"} and got["2"][1] == 3


def test_the_store_keeps_first_answers_and_opens_few_buckets(spark, tmp_path):
    from hopmine.sources.store import ResponseStore

    store = ResponseStore(spark, str(tmp_path / "store"))
    key = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    rows = lambda ids, said: spark.createDataFrame([(key(i), said) for i in ids], "key string, response string")
    asked = rows(range(40), "").select("key")
    assert store.pending(asked).count() == 40 and store.answered(asked).count() == 0
    store.append(rows(range(20), "one"))
    store.append(rows(range(10, 30), "two").unionByName(rows([35], None)))
    store.append(rows(range(30), "three"))
    got = {r.key: r.response for r in store.answered(asked).collect()}
    assert got == {key(i): "one" if i < 20 else "two" for i in range(30)}
    assert {r.key for r in store.pending(asked.unionByName(asked)).collect()} == {key(i) for i in range(30, 40)}
    plan = store.read(rows([3], ""))._jdf.queryExecution().toString()
    assert "bucket" in plan and key(3)[:2] in plan


@pytest.mark.parametrize("per_round", [1, 3, 64])
@pytest.mark.parametrize("most", [None, 0, 4])
def test_budgets_in_rounds_by_brute_force(spark, per_round, most):
    rng = random.Random(per_round)
    size = {f"u{i}": rng.choice([None, 0, 1, 2, 3, 5, 8, 13, 40]) for i in range(60)}
    ranked = [(p, u, i + 1) for p in range(8) for i, u in enumerate(rng.sample(sorted(size), 10 * p % 61))]
    units = spark.createDataFrame(list(size.items()), "id string, n_tokens int")
    got = provenance.selected_units(spark.createDataFrame(ranked, "path_id int, unit_id string, rank int"), units, most, 30, per_round).collect()
    want = set()
    for p in range(8):
        used, n = 0, 0
        for _, u, _ in sorted((r for r in ranked if r[0] == p), key=lambda r: r[2]):
            if used + (size[u] or 0) <= 30 and (most is None or n < most):
                used, n = used + (size[u] or 0), n + 1
                want.add((p, u, size[u] or 0, n))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_descriptions_are_joined_in_pieces(spark):
    """A name in a third of all mentions, with descriptions of its own and repeated ones."""
    rng = random.Random(2)
    rows = [(f"u{d}", (d, c, 0, i), rng.choice(["hub", "a", "b"]), "T", rng.choice(["", f"said {d} {i}", "again", f"again {d % 3}"])) for d in range(60) for c in range(2) for i in range(2)]
    rng.shuffle(rows)
    found = spark.createDataFrame(rows, "unit_id string, ord struct<doc_pos:long,chunk:int,pass:int,item:int>, name string, type string, description string")
    want = {}
    for _, _, name, _, text in sorted(rows, key=lambda r: r[1]):
        seen = want.setdefault(name, [])
        if text and text not in seen:
            seen.append(text)
    for size in (1, 7, 1000):
        assert {r.name: r.description for r in index.merged_entities(found, size).collect()} == {n: " ".join(t) for n, t in want.items()}
        pieces = index.description_pieces(found, size).collect()
        assert len(pieces) == len({(r.name, r.piece) for r in pieces}) and all(0 <= r.piece <= 59 // size for r in pieces)

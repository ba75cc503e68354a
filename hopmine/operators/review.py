"""Verdicts on questions from response tables. A missing or wrongly typed flag is never true and never false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_object, normal_answer, normal_answers

ANSWER = "struct<answerable:boolean,answer:string,evidence_sources:array<int>,equivalent:array<boolean>,reason:string>"
CHAIN = "struct<follows_intended_chain:boolean,sequential_dependency:boolean,unsupported_constraints:array<string>,hop_reviews:array<struct<hop:int,required_by_question:boolean,supported_by_sources:boolean,feeds_later_hop:boolean>>>"
STRUCTURE = "struct<valid:boolean,answer:string,globally_unique:boolean,hop_reviews:array<struct<hop:int>>,operation_reviews:array<struct<hop:int>>,shortcut_found:boolean,failure_reasons:array<string>>"
OPERATION = "struct<valid:boolean,answer:string,reason:string>"


def is_true(c: Column) -> Column:
    return c.eqNullSafe(F.lit(True))


def is_false(c: Column) -> Column:
    return c.eqNullSafe(F.lit(False))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs]))


def parse(rows: DataFrame, schema: str, column: str = "response") -> DataFrame:
    return rows.withColumn("r", F.from_json(json_object(F.col(column)), schema))


def is_answerable(r: Column) -> Column:
    """Literally answerable, with an answer in words."""
    return is_true(r["answerable"]) & r["answer"].isNotNull()


def answer_match(rows: DataFrame) -> DataFrame:
    """rows (expected, aliases, r) with `matches`: an answerable response whose normalised answer is the expected one or an alias, or that a second response called equivalent to one of them.

    r.equivalent has the second responses for the expected answer and each alias, as far as they were asked.
    """
    wanted = F.concat(F.array("expected"), F.coalesce("aliases", F.array().cast("array<string>")))
    exact = F.array_contains(normal_answers(wanted), normal_answer(F.col("r.answer")))
    same = F.coalesce(F.exists("r.equivalent", lambda x: x.eqNullSafe(F.lit(True))), F.lit(False))
    return rows.withColumn("matches", is_answerable(F.col("r")) & (F.coalesce(exact, F.lit(False)) | same))


def citations_ok(citations: Column, n_passages: Column) -> Column:
    """A non-empty list of numbers from 1 to the number of passages."""
    return F.coalesce((F.size(citations) > 0) & F.forall(citations, lambda x: x.isNotNull() & (x >= 1) & (x <= n_passages)), F.lit(False))


def single_hop_verdict(rows: DataFrame) -> DataFrame:
    """rows with supported and the failure reasons, from (r, matches, n_passages); only an answerable response can fail for its citations or its answer."""
    answerable = is_answerable(F.col("r"))
    cited = citations_ok(F.col("r.evidence_sources"), F.col("n_passages"))
    matched = F.coalesce("matches", F.lit(False))
    # fixed values: the reasons
    failures = reasons((~answerable, "not_answerable_from_context"), (answerable & ~cited, "missing_or_invalid_evidence_citations"), (answerable & ~matched, "answer_does_not_match_expected"))
    return rows.withColumn("supported", answerable & cited & matched).withColumn("failures", failures)


def regeneration(rows: DataFrame, max_regenerations: int = 2) -> DataFrame:
    """(question_id, accepted_attempt, attempts, discarded) over (question_id, attempt, supported): the first supported attempt wins."""
    tried = rows.filter(F.col("attempt") <= max_regenerations)
    per = tried.groupBy("question_id").agg(F.min(F.when(F.col("supported"), F.col("attempt"))).alias("accepted_attempt"), F.max("attempt").alias("last"))
    return per.select("question_id", "accepted_attempt", (F.coalesce("accepted_attempt", "last") + 1).alias("attempts"), F.col("accepted_attempt").isNull().alias("discarded"))


def shortcuts(paths: DataFrame, relationships: DataFrame) -> DataFrame:
    """(path_id, n_direct): relationships in either direction between the two ends of a path."""
    ends = paths.select("path_id", F.element_at("path", 1).alias("a"), F.element_at("path", -1).alias("b"))
    low, high = F.least("source", "target"), F.greatest("source", "target")
    counts = relationships.groupBy(low.alias("low"), high.alias("high")).agg(F.count("*").alias("n"))
    keyed = ends.withColumn("low", F.least("a", "b")).withColumn("high", F.greatest("a", "b"))
    return keyed.join(counts, ["low", "high"], "left").select("path_id", F.coalesce("n", F.lit(0)).alias("n_direct"))


def same_ids(found: Column, expected: Column) -> Column:
    """Whether two lists hold the same numbers, however often each; false for a missing list."""
    tidy = lambda c: F.array_sort(F.array_distinct(c))
    return F.coalesce(tidy(found) == tidy(expected), F.lit(False))


def hop_alignment(hops: Column, n_hops: Column) -> Column:
    """The ids of the reviewed hops are 1..n, and each review says required, supported, and feeding a later hop unless it is of the last."""
    good = F.forall(hops, lambda h: is_true(h["required_by_question"]) & is_true(h["supported_by_sources"]) & (is_true(h["feeds_later_hop"]) | h["hop"].eqNullSafe(n_hops)))
    return same_ids(F.transform(hops, lambda h: h["hop"]), F.sequence(F.lit(1), n_hops)) & F.coalesce(good, F.lit(False))


def hop_necessity(rows: DataFrame) -> DataFrame:
    """(question_id, all_necessary) over (question_id, n_hops, hop, necessary, bypass_found): the responses' hops are 1..n, each necessary and without bypass."""
    per = rows.groupBy("question_id", "n_hops").agg(F.collect_set("hop").alias("ids"), F.bool_and(is_true(F.col("necessary")) & is_false(F.col("bypass_found")) & F.col("hop").isNotNull()).alias("good"))
    return per.select("question_id", (same_ids(F.col("ids"), F.sequence(F.lit(1), F.col("n_hops"))) & F.col("good")).alias("all_necessary"))


def multi_hop_verdict(rows: DataFrame) -> DataFrame:
    """rows with accepted, decision and failures, the nine conditions in order.

    rows: (n_hops, answer r with well_formed, matches, chain (see CHAIN), all_necessary, shortcut_found). A missing flag
    fails its condition; the answer can only mismatch where it is answerable. Paths of fewer than three entities are for
    the caller to reject (short_paths).
    """
    answerable, matched = is_answerable(F.col("r")), F.coalesce("matches", F.lit(False))
    chain = F.col("chain")
    constrained = F.coalesce(F.size(chain["unsupported_constraints"]) > 0, F.lit(False))
    # fixed values: the failures, in their order
    conditions = (
        (~is_true(F.col("r.well_formed")), "not_well_formed"),
        (~answerable, "not_answerable"),
        (answerable & ~matched, "answer_mismatch"),
        (~is_true(chain["follows_intended_chain"]), "does_not_follow_intended_chain"),
        (~is_true(chain["sequential_dependency"]), "no_sequential_dependency"),
        (constrained, "unsupported_constraints"),
        (~hop_alignment(chain["hop_reviews"], F.col("n_hops")), "hop_alignment_failed"),
        (~is_true(F.col("all_necessary")), "unnecessary_hop_or_bypass"),
        (~is_false(F.col("shortcut_found")), "shortcut_found"),
    )
    judged = rows.withColumn("failures", reasons(*conditions)).withColumn("accepted", F.size("failures") == 0)
    return judged.withColumn("decision", F.when(F.col("accepted"), "accepted").otherwise("discarded"))


def short_paths(paths: DataFrame) -> DataFrame:
    """(path_id, reason) of paths that are too short for a multi-hop review: a reject."""
    return paths.filter(F.size("path") < 3).select("path_id", F.lit("fewer than three entities").alias("reason"))


def structure_verdict(rows: DataFrame) -> DataFrame:
    """rows (hops, r, rigor) with accepted, decision and failures; hops are resolved ones, r the response (see STRUCTURE).

    Accepted: at least two relational hops, a literally valid response without shortcut that reviews exactly the hops
    there are, operations among them; strict also asks for one global answer. Other rigors than strict, balanced and loose are an error.
    """
    relational = F.size(F.filter("hops", lambda h: h["source"].isNotNull() & h["target"].isNotNull()))
    number = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<hop:int>>")), lambda h: h["hop"])
    reviewed = F.concat(number(F.col("r.hop_reviews")), number(F.col("r.operation_reviews")))
    complete = same_ids(reviewed, F.transform("hops", lambda h: h["hop"]))
    rigor = F.when(F.col("rigor").isin("strict", "balanced", "loose"), F.col("rigor")).otherwise(F.raise_error(F.lit("rigor must be strict, balanced or loose")))
    valid = is_true(F.col("r.valid")) & complete & is_false(F.col("r.shortcut_found")) & ((rigor != "strict") | is_true(F.col("r.globally_unique")))
    none = F.array().cast("array<string>")
    said = F.concat(F.coalesce("r.failure_reasons", none), F.when(complete, none).otherwise(F.array(F.lit("incomplete_topology_review"))))
    few = F.coalesce(relational, F.lit(0)) < 2
    judged = rows.withColumn("accepted", F.when(few, False).otherwise(valid)).withColumn("failures", F.when(few, F.array(F.lit("fewer_than_two_relational_hops"))).otherwise(said))
    return judged.withColumn("decision", F.when(F.col("accepted"), "accepted").otherwise("discarded"))


#: Operations over assigned entities.
OPERATIONS = ("comparison", "argmin", "argmax", "counting", "temporal_order", "intersection", "selection")


def operation_answers(values: DataFrame) -> DataFrame:
    """(question_id, answer) of (question_id, operation, name, value): what the operation gives over a question's entities.

    argmin and argmax: the entity with the smallest or largest number; comparison: `greater` for the one with the larger
    number of two, `equal` if they tie; counting: how many different entities; temporal_order: the entities by date,
    joined by ` < `; intersection: the entities that every one of the question's values has, joined by `, `; selection:
    the entities whose value is literally true. null where values can't be read or nothing is selected: such questions
    wait for a response. Ties go to the smaller name.
    """
    # each operation takes the columns and aggregates that it needs; what belongs to a line-sized table is shuffled once, by question
    of = lambda *ops: values.filter(F.col("operation").isin(*ops))
    keys, x = ["question_id", "operation"], F.col("value").try_cast("double").alias("x")
    numbers = (F.count("x") == F.count("*")).alias("numbers")
    ends = of("argmin", "argmax").select(*keys, "name", x).groupBy(*keys).agg(numbers, F.min(F.struct("x", "name")).alias("low"), F.min(F.struct((-F.col("x")).alias("x"), "name")).alias("high"))
    ends = ends.select(*keys, F.when(F.col("numbers"), F.when(F.col("operation") == "argmin", F.col("low.name")).otherwise(F.col("high.name"))).alias("answer"))
    two = of("comparison").select(*keys, "name", x).repartition("question_id").groupBy(*keys, "name").agg(F.count("*").alias("c"), F.count("x").alias("cx"), F.min("x").alias("least"), F.max("x").alias("most"))
    two = two.groupBy(*keys).agg((F.sum("cx") == F.sum("c")).alias("numbers"), F.count("name").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.min(F.struct((-F.col("most")).alias("x"), "name")).alias("high"))
    two = two.select(*keys, F.when(F.col("numbers") & (F.col("n") == 2), F.when(F.col("least") == F.col("most"), "equal").otherwise(F.col("high.name"))).alias("answer"))
    counted = of("counting").select(*keys, "name").distinct().groupBy(*keys).agg(F.count("name").cast("string").alias("answer"))
    dated = of("temporal_order").select(*keys, "name", F.try_to_date("value", "yyyy-MM-dd").alias("d")).groupBy(*keys).agg((F.count("d") == F.count("*")).alias("dates"), F.array_sort(F.collect_set(F.struct("d", "name"))).alias("by_date"))
    dated = dated.select(*keys, F.when(F.col("dates"), F.array_join(F.transform("by_date", lambda s: s["name"]), " < ")).alias("answer"))
    # one row a question and entity: an operation's entities are those of a few roles
    shared = of("intersection").select(*keys, "name", "value").repartition("question_id").groupBy(*keys, "name").agg(F.collect_set("value").alias("v")).groupBy(*keys).agg(F.collect_list(F.struct("name", "v")).alias("held"))
    every = F.size(F.array_distinct(F.flatten(F.transform("held", lambda s: s["v"]))))
    shared = shared.withColumn("held", F.filter("held", lambda s: F.size(s["v"]) == every))
    shared = shared.select(*keys, F.when(F.size("held") > 0, F.array_join(F.array_sort(F.transform("held", lambda s: s["name"])), ", ")).alias("answer"))
    chosen = of("selection").groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.lower("value") == "true", F.col("name")))).alias("chosen"))
    chosen = chosen.select(*keys, F.when(F.size("chosen") > 0, F.array_join("chosen", ", ")).alias("answer"))
    known = ("argmin", "argmax", "comparison", "counting", "temporal_order", "intersection", "selection")
    rest = values.filter(~F.coalesce(F.col("operation").isin(*known), F.lit(False))).select(*keys).distinct().withColumn("answer", F.lit(None).cast("string"))
    return reduce(DataFrame.unionByName, [ends, two, counted, dated, shared, chosen, rest])


def operation_verdict(questions: DataFrame, responses: DataFrame, computed: DataFrame | None = None) -> DataFrame:
    """(question_id, answer, stage) of questions with operation hops: a response's answer, if it is literally valid.

    responses: (question_id, response). Any other response stops the question at operation_review. Questions without a
    response take the computed answer (question_id, answer), where there is one, and are pending otherwise.
    """
    said = parse(responses, OPERATION).select("question_id", F.lit(True).alias("asked"), is_true(F.col("r.valid")).alias("valid"), F.coalesce("r.answer", F.lit("")).alias("said"))
    if computed is questions:
        # the questions bring their answers along
        both = questions.select("question_id", F.col("answer").alias("own")).join(said, "question_id", "left")
    else:
        own = computed.select("question_id", F.col("answer").alias("own")) if computed is not None else questions.select("question_id").limit(0).withColumn("own", F.lit(None).cast("string"))
        both = questions.select("question_id").join(said, "question_id", "left").join(own, "question_id", "left")
    stage = F.when(F.col("asked") & ~F.col("valid"), "operation_review").when(F.col("asked").isNull() & F.col("own").isNull(), "pending")
    return both.select("question_id", F.when(F.col("asked"), F.when(F.col("valid"), F.col("said"))).otherwise(F.col("own")).alias("answer"), stage.alias("stage"))

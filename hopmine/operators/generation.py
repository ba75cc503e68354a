"""Prompt tables, gates, acceptance, staged evaluation and ablations. The model is outside: prompts out, responses in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_object
from ..sources.tables import prompt_key
from .review import is_true

#: The stages of an evaluation, and the earlier answers that each one reads.
STAGE_INPUTS = {
    "precheck": (),
    "decomposition": ("precheck",),
    "paths": ("precheck", "decomposition"),
    "validation": ("decomposition", "paths"),
    "shortcut": ("decomposition", "validation"),
    "ambiguity": ("precheck", "decomposition", "validation"),
    "adjudication": ("precheck", "decomposition", "paths", "validation", "shortcut", "ambiguity"),
}
STAGES = tuple(STAGE_INPUTS)
MODES = ("baseline", "no_graph", "no_composition", "no_self_review", "full")
FUNNEL = ("structure_review_required", "example_review_required", "single_hop_review", "operation_review", "multi_hop_review", "ambiguity")

#: What each kind of prompt asks for, and the columns that it shows.
TASKS: dict[str, tuple[str, tuple[str, ...]]] = {
    "structure_induction": ("Name the roles of this graph pattern, an order of hops, the open and hidden roles and the answer role.", ("schema", "instance")),
    "worked_example": ("Write one question per hop and one that joins them all for this pattern, from the passages alone.", ("structure", "entities", "examples", "context")),
    "single_hop": ("Ask about this one fact so that the second entity is the only answer.", ("source", "target", "relationship", "context", "examples")),
    "composition": ("Join the hop questions into one question; name open entities, never hidden ones.", ("structure", "entities", "hops", "context", "examples")),
    "operation": ("Carry out the pattern's operations on these facts and say whether the result holds.", ("structure", "entities", "hops", "context")),
    "answer_review": ("Answer the question from the passages and cite them by number.", ("question", "context")),
    "equivalence_review": ("Do both answers mean the same?", ("predicted", "expected")),
    "regeneration": ("Write the hop question anew without the faults listed.", ("source", "target", "relationship", "context", "question", "failures")),
    "chain_review": ("Does the question follow the intended hops, each on the one before?", ("question", "hops", "context")),
    "necessity_review": ("Can the answer be found without this hop?", ("question", "answer", "hop", "hops", "context")),
    "shortcut_review": ("Is there a direct way to the answer?", ("question", "answer", "relationships", "context")),
    "structure_review": ("Check every hop and operation of the pattern behind the question.", ("question", "answer", "hops", "context")),
    "rewrite": ("Change the question as little as needed to leave the intended answer only.", ("question", "answer", "path", "alternatives")),
    "direct": ("Write one question of several hops and its answer from this text.", ("context",)),
    "hop_list": ("Write questions that each need the answer before, from this text.", ("context",)),
    "hop_join": ("Join these questions into one.", ("hops", "context")),
}
#: What each stage of an evaluation asks for.
STAGE_TASKS = {
    "precheck": "Can the question be worked on with this text alone? List the facts that it needs.",
    "decomposition": "Split the question into the fewest hops that the facts support.",
    "paths": "List every way to an answer, also those that fail.",
    "validation": "Which of these ways hold in the text and meet all conditions?",
    "shortcut": "Leave out one hop at a time: does the answer still follow?",
    "ambiguity": "Look for other answers anywhere in the text.",
    "adjudication": "Weigh all stages: is it a valid question of several hops with one answer?",
}


def prompts(rows: DataFrame, kind: str, *parts: tuple[str, str]) -> DataFrame:
    """rows with prompt and key: what the kind of prompt asks for and a paragraph per column that it shows, in order, or per (title, column) of parts."""
    task, shown = TASKS.get(kind, (kind.replace("_", " "), ()))
    blocks = [F.concat(F.lit(f"{title}:\n"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for title, c in parts or [(c.capitalize(), c) for c in shown]]
    return rows.withColumn("prompt", F.concat_ws("\n\n", F.lit(f"Task: {task}"), *blocks)).withColumn("key", prompt_key(F.lit(kind), "prompt"))


def approved_examples(structures: DataFrame, examples: DataFrame) -> DataFrame:
    """The approved examples (all their columns) of approved structures, under their structure_id, with `source`: own, or general for structures without any of their own.

    A missing review status is pending. General examples have a null structure_id; there are few of them.
    """
    ok = F.coalesce("review_status", F.lit("pending")) == "approved"
    wanted = structures.filter(ok).select("structure_id")
    own = examples.filter(ok).join(wanted, "structure_id").withColumn("source", F.lit("own"))
    bare = wanted.join(own.select("structure_id"), "structure_id", "left_anti").withColumn("_general", F.lit(True))
    general = examples.filter(ok & F.col("structure_id").isNull()).drop("structure_id").withColumn("_general", F.lit(True)).withColumn("source", F.lit("general"))
    return own.unionByName(bare.join(general, "_general").drop("_general"))


def approved_view(structures: DataFrame, examples: DataFrame) -> DataFrame:
    """(structure_id, n_examples, source) of approved structures with their approved examples; without any, the approved general ones stand in.

    A missing review status is pending. General examples have a null structure_id.
    """
    ok = F.coalesce("review_status", F.lit("pending")) == "approved"
    own = examples.filter(ok & F.col("structure_id").isNotNull()).groupBy("structure_id").agg(F.count("*").alias("n"))
    general = examples.filter(ok & F.col("structure_id").isNull()).agg(F.count("*").alias("g"))
    joined = structures.filter(ok).select("structure_id").join(own, "structure_id", "left").join(F.broadcast(general))
    return joined.select("structure_id", F.coalesce("n", "g").alias("n_examples"), F.when(F.col("n").isNotNull(), "own").otherwise("general").alias("source"))


def catalogue_gate(instances: DataFrame, view: DataFrame) -> DataFrame:
    """(set_id, structure_id, stage): the stage at which an instance stops, null if it goes on."""
    stage = F.when(F.col("n_examples").isNull(), "structure_review_required").when(F.col("n_examples") == 0, "example_review_required")
    return instances.join(view, "structure_id", "left").select("set_id", "structure_id", stage.alias("stage"))


def hop_texts(hops: DataFrame, relationships: DataFrame) -> DataFrame:
    """(hop_id, text): descriptions of a hop's relationships in row order, by line; against its direction if marked, in either if there are none.

    hops: (hop_id, a, b, reverse). Row order is that of `position`, where the relationships have it, then of the descriptions.
    """
    order = [c for c in ("position",) if c in relationships.columns]
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, "description"))), lambda x: x["description"])
    facing = hops.select("hop_id", "a", "b", F.when(is_true(F.col("reverse")), F.col("b")).otherwise(F.col("a")).alias("source"), F.when(is_true(F.col("reverse")), F.col("a")).otherwise(F.col("b")).alias("target"))
    text = lambda df, name: df.groupBy("hop_id").agg(F.array_join(listed, "\n").alias(name))
    exact = text(facing.join(relationships, ["source", "target"]), "exact")
    either = text(facing.select("hop_id", F.col("target").alias("source"), F.col("source").alias("target")).join(relationships, ["source", "target"]), "other")
    return hops.select("hop_id").join(exact, "hop_id", "left").join(either, "hop_id", "left").select("hop_id", F.coalesce("exact", "other").alias("text"))


def expected_answer(role_answer: Column, operation_answer: Column, composed: Column) -> Column:
    """The operation's answer where there is one, else the answer role's entity, else the composed answer."""
    return F.coalesce(operation_answer, role_answer, composed)


def ambiguity_route(path: Column, entities: Column, answer: Column, has_operation: Column) -> Column:
    """'path' for a plain chain that ends at the answer and covers all entities, else 'pattern'."""
    chain = ~has_operation & (F.element_at(path, -1) == answer) & (F.array_sort(path) == F.array_sort(entities))
    return F.when(F.coalesce(chain, F.lit(False)), "path").otherwise("pattern")


def accepted_attempts(attempts: DataFrame, count: int, max_attempts: int | None = None) -> DataFrame:
    """The first count accepted attempts within max_attempts (20 * count), all attempts being evaluated as one table."""
    return attempts.filter((F.col("attempt") < (max_attempts or 20 * count)) & is_true(F.col("accepted"))).orderBy("attempt").limit(count)


def funnel(attempts: DataFrame) -> DataFrame:
    """(stage, n) of rejected attempts."""
    return attempts.filter("stage is not null").groupBy("stage").agg(F.count("*").alias("n"))


#: The fields of an accepted question's record, in order; `all_entities` are the distinct ones of the assignment.
RECORD = ("question", "answer", "structure_id", "entities", "entity_path", "resolved_hops", "single_hops", "context", "context_passages", "multi_hop_review", "operation_review", "ambiguity", "distractors")


def accepted_record(rows: DataFrame) -> DataFrame:
    """(question_id, record): the RECORD columns that rows has, and all_entities out of entities (a map of roles), as one JSON text."""
    body = F.struct(*[c for c in RECORD if c in rows.columns], F.array_distinct(F.map_values("entities")).alias("all_entities"))
    return rows.select("question_id", F.to_json(body).alias("record"))


def _stages(items: DataFrame, responses: DataFrame) -> DataFrame:
    """items with a column per stage, its answer's JSON object, and `processable`."""
    said = responses.filter(F.col("stage").isin(list(STAGES))).select("item_id", "stage", json_object(F.col("response")).alias("r"))
    per = said.groupBy("item_id").agg(*[F.max(F.when(F.col("stage") == s, F.col("r"))).alias(s) for s in STAGES])
    joined = items.join(per, "item_id", "left")
    return joined.withColumn("processable", is_true(F.from_json("precheck", "processable boolean")["processable"]))


def _ready(stage: str) -> Column:
    """Whether a stage can be asked: all answers that it reads are there; an item that can't be processed goes straight to the last one."""
    there = reduce(lambda a, b: a & b, [F.col(s).isNotNull() for s in STAGE_INPUTS[stage]], F.lit(True))
    if stage == "precheck":
        return there
    if stage == "adjudication":
        return F.when(F.col("processable"), there).otherwise(F.col("precheck").isNotNull())
    return F.col("processable") & there


def evaluation_prompts(items: DataFrame, responses: DataFrame) -> DataFrame:
    """(item_id, stage, prompt, key) of every stage of (item_id, question, context) that can be asked, with the answers of earlier stages that it reads.

    responses: (item_id, stage, response). What an item that can't be processed shows of the stages in between is empty.
    """
    rows = _stages(items, responses)
    made = []
    for stage, read in STAGE_INPUTS.items():
        answer = lambda s: F.coalesce(F.col(s) if s == "precheck" else F.when(F.col("processable"), F.col(s)), F.lit("{}"))
        blocks = [F.concat(F.lit("Question:\n"), "question"), *[F.concat(F.lit(f"{s.capitalize()}:\n"), answer(s)) for s in read], F.concat(F.lit("Context:\n"), "context")]
        made.append(F.when(_ready(stage), F.struct(F.lit(stage).alias("stage"), F.concat_ws("\n\n", F.lit(f"Task: {STAGE_TASKS[stage]}"), *blocks).alias("prompt"))))
    each = rows.select("item_id", F.explode(F.array_compact(F.array(*made))).alias("s")).select("item_id", "s.stage", "s.prompt")
    return each.withColumn("key", prompt_key(F.concat(F.lit("evaluate:"), "stage"), "prompt"))


def staged_evaluation(items: DataFrame, responses: DataFrame) -> DataFrame:
    """(item_id, processable, n_stages, accepted) of items (item_id, ..): n_stages is how many stages were asked and answered.

    responses: (item_id, stage, response). An item is accepted if its adjudication could be asked and answered with a
    literally true `accepted`.
    """
    rows = _stages(items.select("item_id"), responses)
    done = [(_ready(s) & F.col(s).isNotNull()).cast("int") for s in STAGES]
    accepted = _ready("adjudication") & is_true(F.from_json("adjudication", "accepted boolean")["accepted"])
    return rows.select("item_id", "processable", reduce(lambda a, b: a + b, done).alias("n_stages"), F.coalesce(accepted, F.lit(False)).alias("accepted"))


def ablation_items(contexts: DataFrame, attempts: DataFrame, direct: DataFrame, listed: DataFrame, joined: DataFrame, count: int) -> DataFrame:
    """(mode, item_id, question, context) of the five modes, to be evaluated alike.

    contexts: (pos, context); attempts: generation's (attempt, question, context, passes, reviewed), where `passes` leaves
    the self-review out and `reviewed` has it; direct and joined: (key, question) responses to the `direct` prompt of a
    context and to the `hop_join` prompt, which shows the answer to the context's `hop_list` prompt: listed (key, hops). baseline and no_graph
    take the first count contexts; full and no_self_review the first count attempts that get through; no_composition is
    full with its questions asked directly of their contexts.
    """
    first = contexts.orderBy("pos").limit(count).withColumn("item_id", F.col("pos").cast("string"))
    taken = lambda flag: accepted_attempts(attempts.withColumn("accepted", F.col(flag)), count).select(F.col("attempt").cast("string").alias("item_id"), "question", "context")
    asked = lambda rows, kind, said, *names: prompts(rows.drop(*names), kind).select("item_id", "context", "key").join(said.select("key", *names), "key").drop("key")

    def joined_up(rows: DataFrame) -> DataFrame:
        """Two prompts in a row: the hops of a context, then one question out of them."""
        shown = prompts(asked(rows, "hop_list", listed, "hops"), "hop_join")
        return shown.select("item_id", "context", "key").join(joined.select("key", "question"), "key").drop("key")

    full = taken("reviewed")
    branches = {
        "baseline": asked(first, "direct", direct, "question"),
        "no_graph": joined_up(first),
        "no_composition": asked(full, "direct", direct, "question"),
        "no_self_review": taken("passes"),
        "full": full,
    }
    return reduce(DataFrame.unionByName, [rows.select(F.lit(mode).alias("mode"), "item_id", "question", "context") for mode, rows in branches.items()])


def ablation(evaluated: DataFrame) -> DataFrame:
    """(mode, n, n_accepted, rate) over (mode, accepted)."""
    return evaluated.filter(F.col("mode").isin(list(MODES))).groupBy("mode").agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"), F.round(F.avg(F.col("accepted").cast("int")), 6).alias("rate"))


def evaluation_sample(items: DataFrame, n: int, seed: int, key: str = "item_id") -> DataFrame:
    """The first n items in a seeded pseudo-random order, with empty labels."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return items.orderBy(order, key).limit(n).withColumn("answerable", F.lit(None).cast("boolean")).withColumn("multi_hop", F.lit(None).cast("boolean"))


def decomposed_sample(items: DataFrame, n: int, seed: int, key: str = "item_id") -> DataFrame:
    """(item_id, pos, question): sampled items (pos 0), each followed by its sub-questions that refer to no other one.

    items: (item_id, question, parts array<string>). A part with `>>` or `#1` refers to another; a lone `#2` passes.
    """
    picked = evaluation_sample(items, n, seed, key)
    parts = picked.select(key, F.posexplode("parts").alias("p", "question")).filter(~F.col("question").contains(">>") & ~F.col("question").contains("#1"))
    return picked.select(key, F.lit(0).alias("pos"), "question").unionByName(parts.select(key, (F.col("p") + 1).alias("pos"), "question"))

"""Question generation as one job that can be stopped and run again: sample, gate, roles, hop questions, composition, review, ambiguity.

Attempts run in waves, each twice as long, until enough questions are accepted or 20 times as many attempts were made. The
model is a provider (functions.plugins) that is asked only for prompts that the store has no response to; whatever was
answered before a stop is never asked again, and a wave that is written is not run again. Everything else follows from the
seed, so a job that was stopped comes to the same records as one that wasn't.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plugins import Provider, provided
from ..functions.text import json_object, normal_answer
from ..operators import ambiguity as A
from ..operators import generation as H
from ..operators import structures as S
from ..operators.paths import undirected
from ..operators.review import is_true
from ..sources.shared import cut
from ..sources.store import ResponseStore

CATALOGUE = "structure_id string, review_status string, n_examples int, roles array<struct<pos:int,role:string,type:string>>, hops array<struct<hop:int,source:string,target:string>>"
_HOPS = "array<struct<hop:int,source:string,target:string,operation:string,inputs:array<string>,returns:array<string>>>"
GATE, HOPS, REVIEW, AMBIGUITY = H.FUNNEL[0], H.FUNNEL[2], H.FUNNEL[4], H.FUNNEL[5]
RECORD = "attempt long, structure_id string, stage string, question string, answer string, path array<string>, hops array<struct<hop:int,a:string,b:string,question:string>>"


class GenerationJob:
    """Questions over the connected sets of low to 3 entities of a graph.

    catalogue has CATALOGUE's columns, one row a structure: its roles with their types, and its hops between roles. Hops
    that have no relationship, whose question or answer is missing, or whose answer isn't the hop's target, stop an attempt, as do
    structures that aren't approved or have no example, compositions that aren't literally valid, and questions with other
    answers than the intended one. The first wave has `ahead` attempts for each question wanted. Only attempts whose hops run along one path of two or three entities can be accepted.
    """

    def __init__(self, spark: SparkSession, folder: str, entities: DataFrame, relationships: DataFrame, catalogue: DataFrame, provider: Provider, count: int, low: int = 2, policy: str = "proportional", seed: int = 0, tries: int = 3, ahead: int = 2):
        self.ahead, self.spark, self.folder, self.provider, self.count, self.policy, self.seed, self.tries = ahead, spark, folder.rstrip("/"), provider, count, policy, seed, tries
        self.entities, self.relationships, self.catalogue = cut(entities), cut(relationships), cut(catalogue.select(*[c.split(" ")[0] for c in CATALOGUE.split(", ")]))
        self.store = ResponseStore(spark, f"{self.folder}/responses")
        self.sets = S.CountedSets(self.relationships, self.entities, low)

    def _ask(self, rows: DataFrame, kind: str, schema: str, *parts: tuple[str, str]) -> DataFrame:
        """rows with r, the parsed response to each one's prompt; null where there is none or it isn't an object."""
        asked = cut(H.prompts(rows, kind, *parts))
        waiting = self.store.pending(asked.select("key", "prompt"))
        self.store.append(provided(waiting, self.provider, self.tries).select("key", "response"))
        said = self.store.read(asked.select("key"))
        return cut(asked.join(said, "key", "left").withColumn("r", F.from_json(json_object(F.col("response")), schema)).drop("key", "prompt", "response"))

    def _sampled(self, low: int, high: int) -> tuple[DataFrame, DataFrame]:
        """(attempt, structure_id, stage) that the catalogue stops, and (attempt, structure_id, path, hops (hop, a, b)) that go on; a path is null where roles or hops don't make one."""
        drawn = self.sets.draw_with_replacement(high, self.policy, seed=self.seed).filter(F.col("draw") >= low)
        rows = cut(drawn.select(F.col("draw").alias("attempt"), "structure_id", "nodes"))
        view = self.catalogue.filter(F.coalesce("review_status", F.lit("pending")) == "approved").select("structure_id", "n_examples")
        gated = H.catalogue_gate(rows.select(F.col("attempt").alias("set_id"), "structure_id"), view).withColumnRenamed("set_id", "attempt")
        going = gated.filter("stage is null").select("attempt").join(rows, "attempt")
        nodes = going.select(F.col("attempt").alias("set_id"), "structure_id", F.explode("nodes").alias("name")).join(self.entities.select("name", F.coalesce("type", F.lit("")).alias("type")), "name")
        roles = self.catalogue.select("structure_id", F.explode("roles").alias("x")).select("structure_id", "x.pos", "x.role", "x.type")
        held = S.assign_roles(nodes, roles).groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "name"))).alias("held"))
        placed = going.join(held.withColumnRenamed("set_id", "attempt"), "attempt").join(self.catalogue.select("structure_id", "hops"), "structure_id")
        full = F.transform("hops", lambda h: F.struct(h["hop"].alias("hop"), h["source"].alias("source"), h["target"].alias("target"), F.lit(None).cast("string").alias("operation"), F.lit(None).cast("array<string>").alias("inputs"), F.lit(None).cast("array<string>").alias("returns"))).cast(_HOPS)
        resolved = S.resolved_hops(full, F.col("held"))
        out = placed.select("attempt", "structure_id", S.ordered_path(resolved).alias("path"), F.transform(resolved, lambda h: F.struct(h["hop"].alias("hop"), h["source"].alias("a"), h["target"].alias("b"))).alias("hops"))
        return gated.filter("stage is not null"), cut(out)

    def _hop_questions(self, rows: DataFrame) -> DataFrame:
        """(attempt, asked (hop, a, b, question)) of attempts whose hops all have a question with the right answer."""
        each = rows.filter(F.size("path") == F.size("hops") + 1).select("attempt", F.explode("hops").alias("h")).select("attempt", "h.*")
        name = F.concat_ws(":", "attempt", "hop")
        texts = H.hop_texts(each.select(name.alias("hop_id"), "a", "b", F.lit(False).alias("reverse")), self.relationships)
        known = each.withColumn("hop_id", name).join(texts, "hop_id").withColumnsRenamed({"text": "relationship"}).filter("relationship is not null")
        said = self._ask(known, "single_hop", "struct<question:string,answer:string>", ("Source", "a"), ("Target", "b"), ("Relationship", "relationship"))
        good = said.filter(F.col("r.question").isNotNull() & (normal_answer(F.col("r.answer")) == normal_answer(F.col("b"))))
        asked = good.groupBy("attempt").agg(F.array_sort(F.collect_list(F.struct("hop", "a", "b", F.col("r.question").alias("question")))).alias("asked"))
        return rows.join(asked, "attempt").filter(F.size("asked") == F.size("hops")).select("attempt", "asked")

    def _unambiguous(self, rows: DataFrame) -> DataFrame:
        """(attempt) of (attempt, path, question) whose intended answer is the only admissible one."""
        pairs, found = undirected(self.relationships), []
        for n in (2, 3):
            q = cut(rows.filter(F.size("path") == n).select(F.col("attempt").alias("question_id"), "path", "question"))
            records = cut(A.path_records(A.numbered_candidates(q.select("question_id", "path"), pairs, self.entities, n), self.relationships, q))
            batches = A.validation_batches(records).drop("prompt", "key").join(q.select("question_id", "question"), "question_id")
            shown = records.select("question_id", F.floor(F.col("path_id") / A.BATCH).cast("int").alias("batch"), F.concat_ws(": ", F.col("path_id").cast("string"), F.array_join("path", " > ")).alias("line"), "path_id")
            lines = shown.groupBy("question_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path_id", "line"))), lambda x: x["line"]), "\n").alias("candidates"))
            said = self._ask(batches.join(lines, ["question_id", "batch"]), "candidate_review", "struct<candidates:array<struct<id:int,admissible:boolean>>>", ("Question", "question"), ("Candidates", "candidates"))
            returned = said.select("question_id", "batch", F.explode("r.candidates").alias("c")).select("question_id", "batch", F.col("c.id").alias("path_id"), F.col("c.admissible").alias("admissible"), F.lit(None).cast("array<boolean>").alias("hop_matches"))
            judged, rejects = A.ingest_verdicts(records, returned)
            # a question with a batch that came back otherwise isn't decided
            groups = A.answer_groups(judged.join(rejects.select("question_id").distinct(), "question_id", "left_anti"))
            found.append(A.policy_decision(groups, "discard").filter("decision = 'accepted'").select(F.col("question_id").alias("attempt")))
        return reduce(DataFrame.unionByName, found)

    def _wave(self, low: int, high: int) -> DataFrame:
        """The records of the attempts low to high - 1."""
        stopped, going = self._sampled(low, high)
        hopped = cut(self._hop_questions(going))
        known = going.join(hopped, "attempt").withColumn("shown", F.array_join(F.transform("asked", lambda x: F.concat_ws(" ", x["hop"].cast("string"), x["question"], x["b"])), "\n"))
        made = self._ask(known, "composition", "struct<question:string>", ("Hops", "shown")).withColumn("question", F.col("r.question")).drop("r").filter("question is not null")
        valid = cut(self._ask(made, "chain_review", "struct<valid:boolean>", ("Question", "question"), ("Hops", "shown")).filter(is_true(F.col("r.valid"))).drop("r"))
        alone = cut(self._unambiguous(valid))
        has = lambda df, name: df.select("attempt", F.lit(True).alias(name))
        judged = going.join(hopped, "attempt", "left").join(valid.select("attempt", "question"), "attempt", "left").join(has(alone, "alone"), "attempt", "left")
        stage: Column = F.when(F.col("asked").isNull(), HOPS).when(F.col("question").isNull(), REVIEW).when(F.col("alone").isNull(), AMBIGUITY)
        kinds = [c.split(" ", 1) for c in RECORD.split(", ")]
        full = judged.select("attempt", "structure_id", stage.alias("stage"), "question", F.when(F.col("alone"), F.element_at("path", -1)).alias("answer"), "path", F.col("asked").alias("hops"))
        early = stopped.select("attempt", "structure_id", "stage", *[F.lit(None).cast(kind).alias(c) for c, kind in kinds[3:]])
        return full.unionByName(early).select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds])

    def _done(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def run(self) -> DataFrame:
        """All attempts made, with RECORD's columns; `stage` is where an attempt stopped, null for accepted ones.

        generation.accepted_attempts and funnel take them from here.
        """
        low, high, most, waves = 0, min(self.ahead, 20) * self.count, 20 * self.count, []
        while True:
            path = f"{self.folder}/attempts/{low}-{high}"
            if not self._done(path):
                self._wave(low, high).write.mode("overwrite").parquet(path)
            waves.append(self.spark.read.schema(RECORD).parquet(path))
            made = reduce(DataFrame.unionByName, waves)
            if high >= most or made.filter("stage is null").count() >= self.count:
                return made
            low, high = high, min(most, 2 * high)

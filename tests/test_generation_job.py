"""A generation job that is stopped and run again, against one that isn't."""

import json
import random

from pyspark.sql import functions as F

from hopmine.operators import generation
from hopmine.plans.generation_job import CATALOGUE, GenerationJob


def graph(spark):
    rng = random.Random(4)
    kinds = {f"n{i:02d}": "ABC"[i % 3] for i in range(24)}
    ents = spark.createDataFrame([(n, k) for n, k in kinds.items()], "name string, type string")
    ends = sorted({(a, b) for a in kinds for b in kinds if (kinds[a], kinds[b]) in (("A", "B"), ("B", "C")) and rng.random() < 0.3})
    rels = spark.createDataFrame([(f"r{i}", a, b, f"{a} leads to {b}", 0.5) for i, (a, b) in enumerate(ends)], "id string, source string, target string, description string, weight double")
    chain = '{"directed":true,"entity_types":["A","B","C"],"edges":[[0,1,1],[1,2,1]]}'
    pair = '{"directed":true,"entity_types":["A","B"],"edges":[[0,1,1]]}'
    bare = '{"directed":true,"entity_types":["B","C"],"edges":[[0,1,1]]}'
    roles = [(0, "x", "A"), (1, "y", "B"), (2, "z", "C")]
    rows = [(chain, "approved", 2, roles, [(1, "x", "y"), (2, "y", "z")]), (pair, "approved", 1, roles[:2], [(1, "x", "y")]), (bare, "approved", 0, roles[1:], [(1, "y", "z")]), ("other", None, 3, [], [])]
    return ents, rels, spark.createDataFrame(rows, CATALOGUE)


def answers(log):
    """A model that answers by the prompt's text and writes down what it was asked."""

    def make():
        def ask(prompts):
            with open(log, "a", encoding="utf-8") as f:
                f.writelines(json.dumps(p) + "\n" for p in prompts)
            return [answer(p) for p in prompts]

        return ask

    return make


def answer(prompt):
    sections = dict(part.split(":\n", 1) for part in prompt.split("\n\n")[1:])
    digit = sum(map(ord, prompt)) % 7
    if "Relationship" in sections:
        return json.dumps({"question": f"Where from {sections['Source']}?", "answer": "wrong" if digit == 0 else sections["Target"]})
    if "Candidates" in sections:
        lines = sections["Candidates"].split("\n")
        # the intended answer is the last hop's; some questions have others too
        return json.dumps({"candidates": [{"id": int(x.split(":")[0]), "admissible": digit == 3 or sections["Question"].endswith(x[-3:])} for x in lines]})
    if "Question" in sections:
        return "```json\n" + json.dumps({"valid": digit != 1}) + "\n```"
    return json.dumps({"question": f"Q {sections['Hops']}"}) if digit != 2 else "no JSON"


class Stopped(Exception):
    pass


def records(df):
    return sorted(str(r) for r in df.collect())


def test_a_stopped_job_runs_on_to_the_same_records(spark, tmp_path):
    ents, rels, catalogue = graph(spark)
    logs = [tmp_path / n for n in ("whole", "cut")]
    for log in logs:
        log.write_text("")
    job = lambda name, log: GenerationJob(spark, str(tmp_path / name), ents, rels, catalogue, answers(str(log)), 2, seed=2, ahead=20)
    whole = job("a", logs[0]).run()
    rows = whole.collect()
    assert len(rows) == 40 and "structure_review_required" in {r.stage for r in rows}
    assert sum(r.stage is None for r in rows) >= 2
    for r in generation.accepted_attempts(whole.withColumn("accepted", F.col("stage").isNull()), 2).collect():
        assert r.answer == r.path[-1] and [h.b for h in r.hops] == r.path[1:]
    # stopped behind the compositions: their answers are stored, nothing of the wave is
    stopped = job("b", logs[1])

    def stop(rows):
        raise Stopped

    stopped._unambiguous = stop
    try:
        stopped.run()
        raise AssertionError("not stopped")
    except Stopped:
        del stopped._unambiguous
    assert records(stopped.run()) == records(whole)
    # nothing was asked twice, before the stop and after it
    asked = [log.read_text().split("\n")[:-1] for log in logs]
    assert sorted(asked[0]) == sorted(asked[1]) and len(set(asked[0])) == len(asked[0])

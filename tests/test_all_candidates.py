"""Distractors out of all candidates, whatever their number."""

from pyspark.sql import functions as F

from hopmine import registry
from hopmine.operators import ambiguity, paths


def star(spark):
    """Three nations of a region, of which the last comes behind 600 paths; a supplier of two nations."""
    ends = [(f"n{i}", "r", 1.0) for i in (1, 2, 3)] + [(f"s{i:03}", f"n{1 + i // 300}", (i * 37 % 101) / 100) for i in range(650)] + [("s001", "n3", 0.5)]
    kinds = [("r", "L")] + [(f"n{i}", "L") for i in (1, 2, 3)] + [(f"s{i:03}", "O") for i in range(650)]
    r = spark.createDataFrame(ends, "source string, target string, weight double").withColumn("description", F.concat("source", F.lit(" in "), "target"))
    q = spark.createDataFrame([(f"s{i:03}", ["r", f"n{1 + i // 300}", f"s{i:03}"]) for i in range(650)], "question_id string, path array<string>")
    return r, spark.createDataFrame(kinds, "name string, type string"), q


def judged(r, e, q):
    """Verdicts by the last digit of the question and the number of the path."""
    records = ambiguity.path_records(ambiguity.numbered_candidates(q, paths.undirected(r), e, 3, cap=None), r, q, answer_index=1)
    digit, x = F.substring("question_id", -1, 1).cast("int"), F.col("path_id")
    return records.withColumn("admissible", (digit >= 5) & (x % 7 == 0)).withColumn("hop_matches", F.array(x % 2 == digit % 2, x % 5 == 0)).localCheckpoint()


def test_distractors_of_all_candidates(spark):
    """F16: the first 500 candidates were kept, so nations behind them were never offered; some of 650 questions are judged here one by one."""
    r, e, q = star(spark)
    q = q.withColumn("like", F.concat(F.lit("s"), F.lpad(F.col("path")[1].substr(2, 1).cast("int") * 300 - 300 + F.substring("question_id", -1, 1).cast("int"), 3, "0"))).localCheckpoint()
    one = q.filter("question_id = like").drop("like").localCheckpoint()
    assert one.count() == 30
    got = ambiguity.shared_distractors(q, judged(r, e, one), (2,)).localCheckpoint()
    some = q.filter("question_id in ('s001', 's000', 's347', 's299', 's649', 's011')").drop("like").localCheckpoint()
    all_of = judged(r, e, some)
    assert all_of.groupBy("question_id").count().select("count").distinct().collect() == [(651,)] and all_of.filter("not complete").count() == 0
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(got.join(some, "question_id", "left_semi")) == rows(ambiguity.distractors(all_of))
    assert {x.answer for x in got.filter("question_id = 's000'").collect()} == {"n2", "n3"} and got.select("question_id").distinct().count() == 650


def test_query_has_no_cap():
    sql = registry.oracle_sql()
    assert "500" not in sql["g8_distractors"] and "rn <= 500" in sql["g7_answer_groups"]

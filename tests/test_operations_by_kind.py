"""Operations' answers, each kind with the columns that it needs."""

from hopmine.operators import review


def test_each_kind_is_shuffled_once(spark):
    """every row was expanded for two distinct counts and carried all kinds' sets; odd rows keep their answers."""
    rows = [
        ("a", "argmin", "x", "1"), ("a", "argmin", "y", "-2.5"), ("a2", "argmax", "x", "3"), ("a2", "argmax", "b", "3"), ("a3", "argmax", "x", "no"),
        ("c", "comparison", "x", "1"), ("c", "comparison", "y", "2"), ("c", "comparison", "x", "0"), ("c2", "comparison", "x", "1"), ("c2", "comparison", "y", "1.0"), ("c3", "comparison", "x", "1"), ("c4", "comparison", "x", "1"), ("c4", "comparison", "y", None),
        ("c5", "comparison", None, "9"), ("c5", "comparison", "y", "2"), ("n", "counting", "x", None), ("n", "counting", "x", "1"), ("n", "counting", "y", None), ("n", "counting", None, None),
        ("t", "temporal_order", "x", "2001-01-02"), ("t", "temporal_order", "y", "2001-01-01"), ("t2", "temporal_order", "x", "soon"), ("i", "intersection", "x", "1"), ("i", "intersection", "x", "2"), ("i", "intersection", "y", "1"), ("i", "intersection", "z", "2"), ("i", "intersection", "z", "1"),
        ("i2", "intersection", "x", "1"), ("i2", "intersection", "y", "2"), ("i3", "intersection", "x", None), ("s", "selection", "y", "TRUE"), ("s", "selection", "x", "true"), ("s2", "selection", "x", "false"), ("u", "other", "x", "1"), ("v", None, "x", "1"),
    ]
    df = spark.createDataFrame(rows, "question_id string, operation string, name string, value string")
    found = review.operation_answers(df)
    want = {"a": "y", "a2": "b", "a3": None, "c": "y", "c2": "equal", "c3": None, "c4": None, "c5": None, "n": "2", "t": "y < x", "t2": None, "i": "x, z", "i2": None, "i3": "x", "s": "x, y", "s2": None, "u": None, "v": None}
    assert {r.question_id: r.answer for r in found.collect()} == want and found.count() == len(want)
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()

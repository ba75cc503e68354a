"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa. " * 3000

ROWS = [
    (1, "one two three four five six seven eight", "a", 3.0),
    (2, "one  two\tthree four five six\nseven eight ", "a", 3.0),
    (3, "", None, None),
    (4, None, "b", 1.0),
    (5, LONG, "b", 1.0),
    (6, LONG + "end", None, 1.0),
    (7, " \t\n", "c", 1.0),
    (8, "Zwölf größere 😀 Wörter", "c", 1.0),
    (1, "one two three four five six seven eight", "a", 3.0),
    (None, "no id here but some words", "a", 2.0),
    (9, "one two three four five six seven eight", "z", 3.0),
]
# the extra columns clash with names that operators use
SCHEMA = "doc_id long, text string, source string, size double"


def docs(spark, rows=ROWS):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "range", "key", "row", "spans", "bands", "taken", "kept", "score", "label", "norm", "sha", "name", "tie", "t", "a.b", "_gone", "_maybe"):
        df = df.withColumn(c, F.lit("x"))
    return df.withColumn("lang", F.lit(None).cast("string"))


def none(spark):
    return docs(spark).limit(0)

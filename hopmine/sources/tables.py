"""Graph tables: schemas, readers, writers, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": "id string, title string, raw_content string",
    "text_units": "id string, text string, n_tokens int, document_ids array<string>, entity_ids array<string>, relationship_ids array<string>",
    "entities": "id string, name string, type string, description string, text_unit_ids array<string>",
    "relationships": "id string, source string, target string, description string, weight double, text_unit_ids array<string>",
    "claims": "id string, subject string, description string, text_unit_ids array<string>",
}


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The graph tables of a folder under their fixed schemas; no schema is inferred."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet") for name, schema in SCHEMAS.items()}


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, raw_content) of text files: id from the resolved path, title the name without its ending."""
    from ..functions.ids import uuid5

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw_content"))
    # Spark gives paths as URLs; a plus sign is one in them
    plain = F.url_decode(F.replace(F.regexp_replace("path", "^file:(//)?", ""), F.lit("+"), F.lit("%2B")))
    return files.select(uuid5(plain).alias("id"), F.regexp_replace(F.element_at(F.split(plain, "/"), -1), r"(?<=.)\.[^.]+$", "").alias("title"), "raw_content")


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON records: a file holds one object or an array of them, on any number of lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Parquet with the fixed columns and types, also for empty tables."""
    for name, df in tables.items():
        columns = [c.split(" ", 1) for c in SCHEMAS[name].split(", ")]
        df.select(*[F.col(c).cast(t).alias(c) for c, t in columns]).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that more than one row has, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def id_list(column: Column, kind: str) -> Column:
    """An id field (null, scalar or list, by its Spark type) as a list of non-null strings."""
    if not kind.startswith("array"):
        column = F.array(column)
    return F.filter(F.coalesce(column.cast("array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())


def upsert(existing: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Existing rows whose key isn't in the batch (is_new 0), then the batch's rows (is_new 1)."""
    kept = existing.join(batch.select(key).distinct(), key, "left_anti")
    return kept.withColumn("is_new", F.lit(0)).unionByName(batch.withColumn("is_new", F.lit(1)))


def prompt_key(*parts: Column | str) -> Column:
    """The digest under which a prompt and its response are stored: SHA-256 of the parts, joined by NUL."""
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def pending_prompts(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Distinct prompts without a response: only the digest is compared, the text goes along with the survivors."""
    return prompts.dropDuplicates(["key"]).join(responses.select("key").distinct(), "key", "left_anti")

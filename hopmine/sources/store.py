"""A store of responses: append-only Parquet in buckets by the first digits of the digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut


class ResponseStore:
    """Responses (key, response) in a folder that all executors share.

    Keys are hex digests, so buckets are even, and whoever asks for some keys opens their buckets only. Appending stores
    what isn't there yet, so a job that runs again after a failure adds nothing twice. Files are never changed; should two
    jobs store one key at the same time, readers take the smaller of its responses, always the same.
    """

    def __init__(self, spark: SparkSession, folder: str, digits: int = 2):
        self.spark, self.folder, self.digits = spark, folder, digits

    def _bucket(self):
        return F.substring("key", 1, self.digits).alias("bucket")

    def _exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def read(self, asked: DataFrame | None = None) -> DataFrame:
        """(key, response), one row a key: all, or those in the buckets of asked (key)."""
        if not self._exists():
            return self.spark.createDataFrame([], "key string, response string")
        rows = self.spark.read.schema("key string, response string, bucket string").parquet(self.folder)
        if asked is not None:
            # at most 16 ** digits names: partitions that the scan leaves out
            names = [r.bucket for r in asked.select(self._bucket()).distinct().collect()]
            rows = rows.filter(F.col("bucket").isin(names))
        return rows.groupBy("key").agg(F.min("response").alias("response"))

    def append(self, responses: DataFrame) -> None:
        """Stores the responses (key, response) of keys that have none; null responses are none. Responses are computed once."""
        new = cut(responses.filter(F.col("key").isNotNull() & F.col("response").isNotNull()).groupBy("key").agg(F.min("response").alias("response")))
        new = new.join(self.read(new).select("key"), "key", "left_anti")
        new.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.folder)

    def pending(self, prompts: DataFrame) -> DataFrame:
        """prompts (key, ..), one row a key, without a stored response."""
        return prompts.dropDuplicates(["key"]).join(self.read(prompts).select("key"), "key", "left_anti")

    def answered(self, prompts: DataFrame) -> DataFrame:
        """prompts with their stored response."""
        return prompts.join(self.read(prompts), "key")

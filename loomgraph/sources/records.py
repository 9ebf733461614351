"""Run records of a benchmark: result files of two generations, and the sums of their usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Both generations: once the arm was a name with the model beside it, now it is an object.
RECORD = "caseId string, arm string, model string, replicate int, startedAt string, metrics string, invalid string"
ARM = "struct<id:string,toolset:string,model:string>"
USAGE = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Result files under a path, one JSON object each, with arms as objects."""
    return upgraded(spark.read.schema(RECORD).option("multiLine", True).json(path))


def upgraded(records: DataFrame) -> DataFrame:
    """Records with ``arm`` as (id, toolset, model): an older one's name is its toolset, its id names both."""
    known = F.from_json("arm", ARM)
    model = F.coalesce("model", F.lit("unknown"))
    older = F.struct(F.concat_ws("/", "arm", model).alias("id"), F.col("arm").alias("toolset"), model.alias("model"))
    is_object = F.ltrim("arm").startswith("{")
    return records.withColumn("arm", F.when(is_object, known).otherwise(older)).drop("model")


def token_sum(usage: Column) -> Column:
    """All tokens that a loop processed, from a map of counts: a cached token is still one that was read."""
    total = F.lit(0).cast("long")
    for name in USAGE:
        total = total + F.coalesce(usage[name].cast("long"), F.lit(0))
    return total

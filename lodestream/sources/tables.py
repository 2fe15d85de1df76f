"""Record sources: Parquet tables and the two seed records."""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from lodestream.sources.schemas import RECORD_SCHEMA

# The seed records.
SEEDS = [
    (0, "alpha", "Primary schema revisions", 3, "schema revisions: alpha\nstate: active", datetime.fromtimestamp(0, timezone.utc)),
    (1, "beta", "Secondary schema revisions", 5, "schema revisions: beta\nstate: review", datetime.fromtimestamp(1, timezone.utc)),
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seed_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEEDS, RECORD_SCHEMA)

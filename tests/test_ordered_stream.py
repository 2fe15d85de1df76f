import time

import pytest
from pyspark.sql import functions as F

from lodestream.plans import QUERIES
from lodestream.streaming import keyed_state, revise_in_order, revise_stream
from tests.compare import spark_rows

SCHEMA = "id string, seq bigint, expected double, at timestamp"


class Feed:
    """A stream of files, run until they are read; each run is a new query on the same checkpoint."""

    def __init__(self, spark, path, records):
        self.spark, self.path, self.records = spark, str(path), records

    def add(self, rows):
        df = self.spark.createDataFrame(rows, "id string, seq bigint, expected double, s bigint")
        df.select("id", "seq", "expected", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        time.sleep(1.1)  # files are read in order of their time

    def run(self):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
        with keyed_state(self.spark):
            query = revise_in_order(stream, self.records, "1 hour").writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    def rows(self):
        return sorted(tuple(r) for r in self.spark.read.schema("id string, seq bigint, status int, revision bigint").parquet(f"{self.path}/out").collect())


def test_out_of_order_files_with_a_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path, spark.createDataFrame([("a", 0), ("b", 1)], "id string, revision bigint"))
    feed.add([("a", 2, 1.0, 3), ("a", 0, 0.0, 1), ("b", 0, 1.0, 1)])
    feed.add([("x", 0, 0.0, 1), ("a", 5, None, 9)])
    feed.run()
    assert feed.rows() == []  # all of it is within the delay
    feed.add([("a", 1, 0.0, 2), ("b", 1, 1.0, 2), (None, 0, None, 3600 + 5)])
    feed.run()
    first = [("a", 0, 200, 1), ("a", 1, 409, 1), ("a", 2, 200, 2), ("b", 0, 200, 2), ("b", 1, 409, 2), ("x", 0, 404, None)]
    assert feed.rows() == first
    feed.add([("a", 4, 2.0, 8), ("b", 2, 2.0, 8), (None, 0, None, 3600 + 20)])
    feed.run()
    assert feed.rows() == sorted(first + [("a", 4, 200, 3), ("a", 5, 409, 3), ("b", 2, 200, 3)])


def test_a_repeated_attempt_raises(spark, tmp_path):
    feed = Feed(spark, tmp_path, spark.createDataFrame([("a", 0)], "id string, revision bigint"))
    feed.add([("a", 0, 0.0, 1)])
    feed.add([("a", 0, 0.0, 1), (None, 0, None, 3600 + 5)])
    with pytest.raises(Exception, match="was given before"):
        feed.run()


def test_a_repeat_in_a_batch_raises_in_order_of_arrival(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 0.0), ("a", 0, 1.0)], "id string, seq bigint, expected double")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    records = spark.createDataFrame([("a", 0)], "id string, revision bigint")
    query = revise_stream(stream, records).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="two attempts"):
        query.awaitTermination()


def test_of_the_tables_as_the_sequence(spark, sf_dir):
    assert spark_rows(QUERIES["put_stream_ordered"](spark, sf_dir)) == spark_rows(QUERIES["put_sequence"](spark, sf_dir))

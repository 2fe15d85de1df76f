import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.operators import apply_attempts, apply_linked, carry_last, first_match, lookup
from lodestream.plans import QUERIES
from lodestream.sources import ATTEMPT_SCHEMA, seed_records
from tests.compare import spark_rows


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_carry_against_a_loop(spark, parts):
    """Keys that span tasks, keys without values, null keys and ties."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(40), rng.choice([None, None, None, rng.randrange(100)]), i) for i in range(400)]
    rows += [("z", i, None, 1000 + i) for i in range(30)]
    rows = [(k, o, None if k == "b" else v, i) for k, o, v, i in rows]
    seen, expected = {}, []
    for k, o, v, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2] is None, -1 if r[2] is None else r[2])):
        seen[k] = seen.get(k) if v is None else v
        expected.append((i, seen[k]))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, o bigint, v bigint, i bigint")
        assert rows_of(carry_last(df, ["k"], [F.col("o")], "v", "seen").select("i", "seen")) == sorted(expected, key=repr)
        assert carry_last(df.limit(0), ["k"], [F.col("o")], "v", "seen").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.one_of(st.none(), st.integers(0, 4).map(float), st.just(1.5))), max_size=25))
def test_links_accept_what_the_fold_accepts(spark, steps):
    records = spark.createDataFrame([("a", 0, ""), ("b", 2, "")], "id string, revision bigint, content string")
    attempts = spark.createDataFrame([(k, i, e, "c") for i, (k, e) in enumerate(steps)], ATTEMPT_SCHEMA)
    assert rows_of(apply_linked(records, attempts)) == rows_of(apply_attempts(records, attempts)[0])


def test_links_of_the_tables(spark, sf_dir):
    assert spark_rows(QUERIES["put_sequence_links"](spark, sf_dir)) == spark_rows(QUERIES["put_sequence"](spark, sf_dir))


def test_a_long_chain_is_spread_over_tasks(spark):
    """One id with nearly all rows: as the fold answers, with no task that holds most of them."""
    n = 6_000
    attempts = spark.range(n).select(F.lit("a").alias("id"), F.col("id").alias("seq"), F.floor(F.col("id") / 2).cast("double").alias("expected"), F.lit("c").alias("content"))
    records = spark.createDataFrame([("a", 0, ""), ("b", 7, "kept")], "id string, revision bigint, content string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = apply_linked(records, attempts)
        assert rows_of(got) == rows_of(apply_attempts(records, attempts)[0])
        dealt = got.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in dealt) < 0.6 * n
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_seqs_raise(spark):
    twice = spark.createDataFrame([("alpha", 0, 3.0, "x"), ("alpha", 0, 4.0, "y")], ATTEMPT_SCHEMA)
    with pytest.raises(ValueError, match="two attempts"):
        apply_linked(seed_records(spark), twice)


def test_first_of_repeated_ids(spark):
    records = spark.createDataFrame([(1, "x", 9, "late"), (0, "x", 3, "first"), (2, "y", 5, "only"), (7, None, 1, "n"), (8, None, 1, "n")], "ord bigint, id string, revision bigint, content string")
    assert rows_of(first_match(records)) == sorted([(0, "x", 3, "first"), (2, "y", 5, "only"), (7, None, 1, "n"), (8, None, 1, "n")], key=repr)
    keys = spark.createDataFrame([("x",), ("y",), ("w",)], "id string")
    assert {(r["id"], r["status"], r["etag"]) for r in lookup(records, keys).collect()} == {("x", 200, "3"), ("y", 200, "5"), ("w", 404, None)}
    attempts = spark.createDataFrame([("x", 0, 3.0, "new"), ("x", 1, 9.0, "stale")], ATTEMPT_SCHEMA)
    expected = [("x", 0, 200, 4), ("x", 1, 409, 4)]
    assert rows_of(apply_linked(records, attempts)) == expected and rows_of(apply_attempts(records, attempts)[0]) == expected
    after = apply_attempts(records, attempts)[1]
    assert rows_of(after.where("id = 'x'")) == [(0, "x", 4, "new"), (1, "x", 9, "late")]
    tied = spark.createDataFrame([(0, "x", 4, "b"), (0, "x", 4, "a")], "ord bigint, id string, revision bigint, content string")
    assert rows_of(first_match(tied)) == [(0, "x", 4, "a")]

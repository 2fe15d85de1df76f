import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.functions import iso_millis, line_count
from lodestream.operators import analyze, apply_attempts, apply_bodies, count_records, duplicate_ids, get_by_id, list_summaries, lookup, parse_bodies, responses
from lodestream.plans import ORACLES, QUERIES
from lodestream.sources import ATTEMPT_SCHEMA, SnapshotStore, seed_records
from tests.compare import oracle_rows, spark_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == oracle_rows(sf_dir, ORACLES[name])


def test_line_counts(spark):
    cases = {"": 1, "a": 1, "a\n": 2, "a\nb": 2, "a\r\nb": 2, "a\rb": 1, "\n\n": 3, "a\n\nb\n": 4}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "s string").select("s", line_count(F.col("s")))
    assert dict(df.collect()) == {**cases, None: None}


def test_seed_records(spark):
    seeds = seed_records(spark)
    assert count_records(seeds, "x").collect()[0]["n"] == 2
    assert "content" not in list_summaries(seeds).columns
    assert get_by_id(seeds, "alpha").select("revision", iso_millis(F.col("updatedAt"))).collect() == [(3, "1970-01-01T00:00:00.000Z")]
    assert duplicate_ids(seeds).count() == 0
    keys = spark.createDataFrame([("alpha",), ("none",)], "id string")
    assert {(r["id"], r["status"], r["etag"], r["error"]) for r in lookup(seeds, keys).collect()} == {("alpha", 200, "3", None), ("none", 404, None, "not_found")}
    drafts = spark.createDataFrame([("alpha", ""), ("beta", None), ("none", "x")], "id string, draft string")
    assert {(r["id"], r["status"], r["lines"]) for r in analyze(seeds, drafts).collect()} == {("alpha", 200, 1), ("beta", 200, 2), ("none", 404, None)}


def test_attempts_in_order(spark):
    attempts = spark.createDataFrame(
        [("alpha", 0, 3.0, "x"), ("alpha", 1, 3.0, "y"), ("alpha", 2, 4.0, "z"), ("beta", 0, None, "q"), ("beta", 1, 5.0, None), ("none", 0, 1.0, "n")], ATTEMPT_SCHEMA
    )
    outcomes, after = apply_attempts(seed_records(spark), attempts, as_of="2024-01-01")
    assert {tuple(r) for r in outcomes.collect()} == {("alpha", 0, 200, 4), ("alpha", 1, 409, 4), ("alpha", 2, 200, 5), ("beta", 0, 409, 5), ("beta", 1, 200, 6), ("none", 0, 404, None)}
    assert {(r["id"], r["revision"], r["content"]) for r in after.collect()} == {("alpha", 5, "z"), ("beta", 6, "")}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 3)), min_size=1, max_size=12))
def test_attempts_against_a_loop(spark, steps):
    revision, expected = {"a": 0}, set()
    for seq, (key, named) in enumerate(steps):
        if key not in revision:
            expected.add((key, seq, 404, None))
        elif named == revision[key]:
            revision[key] += 1
            expected.add((key, seq, 200, revision[key]))
        else:
            expected.add((key, seq, 409, revision[key]))
    records = spark.createDataFrame([("a", 0, "")], "id string, revision bigint, content string")
    attempts = spark.createDataFrame([(k, i, float(n), "c") for i, (k, n) in enumerate(steps)], ATTEMPT_SCHEMA)
    assert {tuple(r) for r in apply_attempts(records, attempts)[0].collect()} == expected


def test_bodies(spark):
    bodies = ['{"revision":3}', '{"revision":3.0,"content":"a"}', '{"revision":"3"}', "{}", "nope", "3", "[]"]
    got = [(r["bad"], r["expected"], r["content"]) for r in parse_bodies(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()]
    assert got == [(False, 3.0, None), (False, 3.0, "a"), (False, None, None), (False, None, None), (True, None, None), (True, None, None), (False, None, None)]


def test_responses(spark):
    """An accepted attempt gives the row, a stale one the current row, content included."""
    attempts = spark.createDataFrame([("alpha", 0, 3.0, "updated"), ("alpha", 1, 3.0, "stale"), ("beta", 0, 9.0, "x"), ("none", 0, 1.0, "n")], ATTEMPT_SCHEMA)
    got = {(r["id"], r["seq"]): r for r in responses(seed_records(spark), attempts, as_of="2024-01-01").collect()}
    row, current = got["alpha", 0]["row"], got["alpha", 1]["current"]
    assert (row["revision"], row["content"], row["name"], row["updatedAt"].year) == (4, "updated", "Primary schema revisions", 2024)
    assert current == row and got["alpha", 1]["row"] is None and got["alpha", 1]["error"] == "revision_conflict"
    assert got["beta", 0]["current"]["content"] == "schema revisions: beta\nstate: review" and got["beta", 0]["current"]["updatedAt"].year == 1970
    assert (got["none", 0]["status"], got["none", 0]["error"], got["none", 0]["current"]) == (404, "not_found", None)


def test_bodies_are_applied_and_repeated_seqs_are_not(spark):
    requests = [("alpha", 0, "nope"), ("alpha", 1, '{"revision":3,"content":"a"}'), ("alpha", 2, '{"revision":"4"}'), ("none", 0, "[1"), ("none", 1, "{}")]
    got = apply_bodies(seed_records(spark), spark.createDataFrame(requests, "id string, seq bigint, body string")).collect()
    assert {(r["id"], r["seq"], r["status"], r["revision"]) for r in got} == {("alpha", 0, 400, None), ("alpha", 1, 200, 4), ("alpha", 2, 409, 4), ("none", 0, 400, None), ("none", 1, 404, None)}
    twice = spark.createDataFrame([("alpha", 0, 3.0, "x"), ("alpha", 0, 4.0, "y")], ATTEMPT_SCHEMA)
    with pytest.raises(Exception, match="two attempts"):
        apply_attempts(seed_records(spark), twice)[0].collect()


def test_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "records"))
    assert store.latest() == 0
    assert store.commit(seed_records(spark), 0) == 1
    attempts = spark.createDataFrame([("alpha", 0, 3.0, "new")], ATTEMPT_SCHEMA)
    _, after = apply_attempts(store.read(), attempts)
    assert store.commit(after, 1) == 2
    with pytest.raises(ValueError):
        store.commit(after, 1)
    assert {r["revision"] for r in store.read().collect()} == {4, 5}
    assert {r["revision"] for r in store.read(1).collect()} == {3, 5}


def test_filter_and_projection_reach_the_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = list_summaries(docs, "text")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]
    assert "EqualTo(doc_id,7)" in get_by_id(docs, 7, "doc_id")._jdf.queryExecution().executedPlan().toString()


def test_an_id_with_most_attempts(spark):
    """A conversation of 60,000 attempts with contents: right, and not gathered in one row."""
    n = 60_000
    attempts = spark.range(n).select(F.lit("a").alias("id"), F.col("id").alias("seq"), F.floor(F.col("id") / 2).cast("double").alias("expected"), F.concat(F.lit("c"), F.col("id")).alias("content"))
    outcomes, after = apply_attempts(spark.createDataFrame([("a", 0, ""), ("b", 7, "kept")], "id string, revision bigint, content string"), attempts)
    plan = outcomes._jdf.queryExecution().optimizedPlan().toString() + after._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    revision, status = 0, {}
    for i in range(n):
        status[i] = 200 if i // 2 == revision else 409
        revision += i // 2 == revision
        last = i if status[i] == 200 else last
    assert {r["seq"]: r["status"] for r in outcomes.collect()} == status
    assert {tuple(r) for r in after.collect()} == {("a", revision, f"c{last}"), ("b", 7, "kept")}

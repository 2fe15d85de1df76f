import json
import random
import sys

import pytest
from pyspark.sql import functions as F

from lodestream.functions import line_count
from lodestream.operators import analyze_delayed, apply_bodies, classify_bodies, conditional_lookup, etag_matches, list_at, replay
from lodestream.operators.bodies import MOST_BYTES, number_text, value_text
from lodestream.sources import SnapshotStore, seed_records

LOG = "id string, seq bigint, op string, body string, if_none_match string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def put(revision, content):
    return json.dumps({"revision": revision, "content": content})


def test_load_save_and_stale_save(spark):
    """A record is read, saved with the revision read, and a second save with that revision is refused."""
    log = [("alpha", 0, "GET", None, None), ("alpha", 1, "PUT", put(3, "updated"), None), ("alpha", 2, "PUT", put(3, "stale"), None), ("alpha", 3, "GET", None, "3"), ("alpha", 4, "GET", None, 'W/4, "x"')]
    got = {r["seq"]: r for r in replay(seed_records(spark), spark.createDataFrame(log, LOG)).collect()}
    assert [got[i]["status"] for i in range(5)] == [200, 200, 409, 200, 304]
    assert (got[0]["etag"], got[0]["content"]) == ("3", "schema revisions: alpha\nstate: active")
    assert (got[2]["error"], got[2]["revision"], got[2]["content"]) == ("revision_conflict", 4, "updated")
    assert (got[3]["etag"], got[3]["content"], got[4]["etag"], got[4]["content"]) == ("4", "updated", "4", None)


def loop(records, log):
    """The same requests one after the other."""
    store, out = {k: list(v) for k, v in records.items()}, []
    lines = lambda s: len(s.replace("\r\n", "\n").split("\n"))
    for key, seq, op, body, header in sorted(log, key=lambda r: r[1]):
        row = store.get(key)
        try:
            parsed = None if body is None else json.loads(body)
            bad = body is not None and not isinstance(parsed, (dict, list))
        except ValueError:
            bad = True
        if bad:
            out.append((key, seq, op, 400, "bad_request", None, None, None, None))
        elif row is None:
            out.append((key, seq, op, 404, "not_found", None, None, None, None))
        elif op == "GET":
            hit = header == str(row[0]) or header == "*"
            out.append((key, seq, op, 304 if hit else 200, None, str(row[0]), row[0], None if hit else row[1], None))
        elif body is None:
            out.append((key, seq, op, 500, "internal", None, row[0], None, None))
        elif op == "PUT":
            ok = isinstance(parsed, dict) and isinstance(parsed.get("revision"), (int, float)) and parsed["revision"] == row[0]
            if ok:
                content = parsed.get("content")
                row[:] = [row[0] + 1, "" if content is None else value_text(content)]
            out.append((key, seq, op, 200 if ok else 409, None if ok else "revision_conflict", None, row[0], row[1], None))
        else:
            draft = parsed.get("content") if isinstance(parsed, dict) else None
            out.append((key, seq, op, 200, None, None, row[0], None, lines(row[1] if draft is None else value_text(draft))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,sent", [(1, 1 << 20), (2, 0)])
def test_replay_against_a_loop(spark, monkeypatch, seed, sent):
    monkeypatch.setattr(sys.modules["lodestream.operators.replay"], "SENT", sent)
    rng = random.Random(seed)
    store = {"a": [0, "x\ny"], "b": [2, ""], "c": [7, "one"]}
    contents = ["t", "a\r\nb\n", "", None, 1.5, [1, [2, None]], {"k": 1}, True]
    log = []
    for seq in range(150):
        key, op = rng.choice(["a", "a", "a", "b", "c", "none", None]), rng.choice(["PUT", "PUT", "GET", "ANALYZE"])
        body = rng.choice([put(rng.randrange(9), rng.choice(contents)), put(rng.randrange(9), rng.choice(contents)), '{"content":"d\\ne"}', "{}", "[]", "nope", None])
        log.append((key, seq, op, body if op != "GET" or body == "nope" else None, rng.choice([None, "", "3", "*"]) if op == "GET" else None))
    records = spark.createDataFrame([(i, k, *v) for i, (k, v) in enumerate(store.items())] + [(9, "a", 50, "not the first")], "ord bigint, id string, revision bigint, content string")
    assert rows_of(replay(records, spark.createDataFrame(log, LOG).repartition(3))) == loop(store, log)


def test_replay_of_nothing(spark):
    log = spark.createDataFrame([("alpha", 0, "GET")], "id string, seq bigint, op string")
    assert replay(seed_records(spark), log.limit(0)).count() == 0
    assert [r["status"] for r in replay(seed_records(spark).limit(0), log).collect()] == [404]
    with pytest.raises(Exception, match="unknown op"):
        replay(seed_records(spark), log.withColumn("op", F.lit("POST"))).collect()
    with pytest.raises(ValueError, match="two attempts"):
        replay(seed_records(spark), log.union(log)).collect()


def test_a_list_shows_the_revisions_of_its_place(spark):
    log = spark.createDataFrame([("alpha", 0, "PUT", put(3, "x")), ("beta", 1, "PUT", put(5, "y")), ("alpha", 2, "PUT", put(4, "z")), ("beta", 3, "GET", None)], "id string, seq bigint, op string, body string")
    for place, alpha, beta in ((0, 3, 5), (1, 4, 5), (3, 5, 6), (9, 5, 6)):
        got = list_at(seed_records(spark), log, place)
        assert got.columns == ["ord", "id", "name", "revision", "updatedAt"]
        assert {r["id"]: r["revision"] for r in got.collect()} == {"alpha": alpha, "beta": beta}
    twice = seed_records(spark).union(seed_records(spark).withColumn("ord", F.col("ord") + 5))
    assert rows_of(list_at(twice, log, 9).where("id = 'alpha'").select("ord", "revision")) == [(0, 5), (5, 3)]
    assert list_at(seed_records(spark).limit(0), log, 9).count() == 0


def test_an_answer_meets_the_revision_in_force(spark):
    """A write at 50 ms falls into alpha's delay, not into beta's."""
    log = [(k, s, op, at, body) for k in ("alpha", "beta", "none") for s, op, at, body in [(0, "ANALYZE", 0, '{"content":"a\\nb"}'), (1, "ANALYZE", 0, "{}"), (2, "PUT", 50, None), (3, "ANALYZE", 60, "{}"), (4, "ANALYZE", 60, "{"), (5, "ANALYZE", 60, None)]]
    log = [(k, s, op, at, put({"alpha": 3, "beta": 5}.get(k, 1), "1\n2\n3") if op == "PUT" else body) for k, s, op, at, body in log]
    requests = spark.createDataFrame(log, "id string, seq bigint, op string, at bigint, body string")
    got = {(r["id"], r["seq"]): (r["status"], r["ready"], r["revision"], r["lines"]) for r in analyze_delayed(seed_records(spark), requests, F.when(F.col("id") == "alpha", 100).otherwise(20)).collect()}
    assert [got["alpha", s] for s in (0, 1, 3)] == [(200, 100, 4, 2), (200, 100, 4, 3), (200, 160, 4, 3)]
    assert [got["beta", s] for s in (0, 1, 3)] == [(200, 20, 5, 2), (200, 20, 5, 2), (200, 80, 6, 3)]
    assert [got["none", s] for s in (0, 4, 5)] == [(404, 20, None, None), (400, 80, None, None), (404, 80, None, None)]
    assert got["beta", 5] == (500, 80, None, None)


def test_a_write_at_the_moment_of_an_answer_counts(spark):
    log = spark.createDataFrame([("alpha", 0, "ANALYZE", 0, "{}"), ("alpha", 1, "PUT", 20, put(3, "x"))], "id string, seq bigint, op string, at bigint, body string")
    assert [r["revision"] for r in analyze_delayed(seed_records(spark), log, F.lit(20)).collect()] == [4]


# What String(JSON.parse(x)) gives for a body's content.
STRINGS = {
    '"a"': "a", '""': "", '"1.0"': "1.0", '"null"': "null", '"\\u00e9\\n"': "é\n", "true": "true", "false": "false", "0": "0", "-0": "0", "-0.0": "0", "7": "7", "-5": "-5", "1.0": "1", "3e0": "3",
    "0.1": "0.1", "-12.50": "-12.5", "1e21": "1e+21", "1e20": "100000000000000000000", "123456789012345678": "123456789012345680", "999999999999999": "999999999999999", "1e-6": "0.000001", "1.5e-7": "1.5e-7",
    "5e-324": "5e-324", "1e400": "Infinity", "-1e400": "-Infinity", "1.7976931348623157e308": "1.7976931348623157e+308", "{}": "[object Object]", '{"a":[1]}': "[object Object]", "[]": "", "[[],[]]": ",", "[null]": "",
    "[1,2]": "1,2", '[1,[2,[3,"x"]],null,true,{"a":1},0.50]': "1,2,3,x,,true,[object Object],0.5", "null": None,
}


def test_content_as_text(spark):
    df = spark.createDataFrame([(k, f'{{"content":{k}}}') for k in STRINGS] + [("none", "{}")], "k string, body string")
    assert {r["k"]: r["content"] for r in classify_bodies(df).collect()} == {**STRINGS, "none": None}
    assert [number_text(x) for x in (float("nan"), 1e16, 0.000123, 120.0)] == ["NaN", "10000000000000000", "0.000123", "120"]


def test_body_classes(spark):
    large = '{"content":"' + "x" * (MOST_BYTES - 14) + '"}'
    wide = '{"content":"' + "é" * (MOST_BYTES // 2) + '"}'
    cases = {
        "{}": None, "[]": None, "[1]": None, "": None, ' {"a":1} \n': None, "  ": 400, "3": 400, '"s"': 400, "null": 400, "nope": 400, '{"a":1} x': 400, '{"a":1}{"b":2}': 400, "{},{}": 400, '{},"c":{}': 400, "{}],[{}": 400, '{"revision":': 400,
        large: None, large + " ": 413, wide: 413,
    }
    got = {r["body"]: r["refused"] for r in classify_bodies(spark.createDataFrame([(b,) for b in cases], "body string")).collect()}
    assert got == cases
    asked = [(k, i, b) for k in ("alpha", "none") for i, b in enumerate(["nope", large + " ", None, "{}", '{"revision":3,"content":[1,null]}'])]
    out = {(r["id"], r["seq"]): r["status"] for r in apply_bodies(seed_records(spark), spark.createDataFrame(asked, "id string, seq bigint, body string")).collect()}
    assert [out["alpha", i] for i in range(5)] == [400, 413, 500, 409, 200] and [out["none", i] for i in range(5)] == [400, 413, 404, 404, 404]


def test_headers(spark):
    cases = [("3", True), ("W/3", True), ("4", False), ("", False), (None, False), ("*", True), ("*, 4", False), ("4,3", True), (" 4 ,  W/3 ", True), ('"3"', False), ("33", False)]
    got = spark.createDataFrame(cases, "h string, want boolean").select("want", etag_matches(F.col("h"), F.lit("3")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)
    keys = spark.createDataFrame([("alpha", "3", False), ("beta", "3", False), ("none", "*", False), ("alpha", "W/3", True)], "id string, if_none_match string, forced boolean")
    rows = {(r["id"], r["forced"]): r for r in conditional_lookup(seed_records(spark), keys, no_cache="forced").collect()}
    assert [rows[k]["status"] for k in (("alpha", False), ("beta", False), ("none", False), ("alpha", True))] == [304, 200, 404, 200]
    assert rows["alpha", False]["content"] is None and rows["alpha", False]["etag"] == "3" and rows["alpha", True]["content"]


def test_a_crashed_commit_leaves_the_store_open(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path / "records"))
    assert store.commit(seed_records(spark), 0) == 1

    def crash(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(SnapshotStore, "_mark", crash)
        with pytest.raises(RuntimeError):
            store.commit(seed_records(spark).limit(1), 1)
    assert store.latest() == 1 and store.read().count() == 2
    (tmp_path / "records/_DRAFTS").mkdir(exist_ok=True)
    (tmp_path / "records/_DRAFTS/v=2-cut").write_text("v=2-c")  # a crash before the rename
    assert store.commit(seed_records(spark), 1) == 2
    assert store.drop_orphans() == []  # none is a day old
    gone = store.drop_orphans(0)
    assert len(gone) == 2 and "v=2-cut" in gone and store.read().count() == 2 and store.read(1).count() == 2
    with pytest.raises(ValueError, match="another writer"):
        store._mark(2, "v=2-other")
    assert store.read().count() == 2


def test_lines_of_an_analysis_are_those_of_its_text(spark):
    assert spark.createDataFrame([("a\r\nb\n",)], "s string").select(line_count(F.col("s"))).first()[0] == 3

import hashlib
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.llm.chat import BEGIN, CONTROL, FINISH, digest_conversations, format_conversations, in_order, parse, render_turn
from lodestream.llm.registry import QUERIES

bits = st.lists(st.sampled_from([*CONTROL, "<|turn|>", "<|end|>\n", "<|finish|>\n", "\\", "<", "|", "a", "\n", "é🙂", "<\\|", "[", "/", "s>"]), max_size=8).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "", "<|end|>"]), bits), max_size=4))
def test_round_trip(turns):
    text = BEGIN + "".join(render_turn(r, t) for r, t in turns) + FINISH
    assert parse(text) == turns
    assert text.count(BEGIN) == text.count(FINISH) == 1 and text.count("<|end|>") == len(turns) and "[INST]" not in text


def digests(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0], t[1] if t[0] else 0, t[2], t[3]))
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        body = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        chars = len(BEGIN + FINISH) + sum(len(render_turn(r, t)) for *_, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


ODD = [(1, 1, "assistant", "x"), (1, 0, "user", None), (2, 0, None, "</s> \\ <|end|>"), (2, 0, None, "</s> \\ <|end|>"), (None, None, "assistant", "[INST]"), (3, 0, "assistant", "long 🙂" * 20000)]


def test_odd_rows(spark):
    frame = spark.createDataFrame(ODD, "conv_id bigint, turn bigint, role string, text string").withColumn("segment", F.lit(1))
    got = digest_conversations(format_conversations(frame)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == digests(ODD)
    assert digest_conversations(format_conversations(frame.limit(0))).count() == 0


def test_turns_are_rendered_where_they_lie(spark):
    """One conversation has almost all rows: no shuffle stands before rendering, and joined segments parse to the source."""
    rows = [(1, i // 2, "user" if i % 2 else "assistant", f"{i % 7} </s>\n\\ {'x' * (i % 5)}") for i in range(400)] + [(1, 3, "user", None), (2, 0, "a\nb", "<|end|>\n")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").repartition(7)
    segments = format_conversations(frame)
    plan = segments._jdf.queryExecution().optimizedPlan().toString()
    rendering = plan[plan.index("MapInArrow") : plan.index("Aggregate")] if plan.index("MapInArrow") < plan.index("Aggregate") else plan[plan.index("MapInArrow") :]
    assert "RepartitionByExpression" not in rendering and "Sort" not in rendering
    joined = {}
    for r in in_order(segments).collect():
        joined[r["conv_id"]] = joined.get(r["conv_id"], "") + r["segment"]
    for conv in (1, 2):
        assert parse(joined[conv]) == [(r, t or "") for c, _, r, t in sorted(rows, key=lambda x: (x[1], x[2], x[3] or "")) if c == conv]
    assert {r[0]: tuple(r)[1:] for r in digest_conversations(segments).collect()} == digests(rows)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    want = digests([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op6_chat_formatting"](spark, sf_dir).collect()}
    assert got == want and got[-1][2] == len(said)

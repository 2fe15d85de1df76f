import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import toxicity
from lodestream.llm.registry import QUERIES
from lodestream.llm.toxicity import NAMES, STRONG, Features, _plain, entry_weight, learn_lexicons, score_toxicity

DOCS, LABELS = "doc_id bigint, text string", "doc_id bigint, toxic int"


@pytest.mark.parametrize("sf,auc,recall", [("sf0.1", 0.98, 0.85)])
def test_held_out_accuracy(spark, sf, auc, recall):
    """On rows whose labels weren't learnt; a tenth of them is toxic."""
    d = f"/root/testdata/{sf}"
    got = QUERIES["op13_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    pairs = toxic.score.to_numpy()[:, None] - clean.score.to_numpy()[None]
    assert ((pairs > 0) + 0.5 * (pairs == 0)).mean() >= auc
    assert toxic.predicted.mean() >= recall and clean.predicted.mean() <= 0.01
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_every_row_is_scored_and_held_out_by_its_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = QUERIES["op13_toxicity"](spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    assert got.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 5 == 0)).count() == 0


def test_held_out_labels_teach_nothing(spark, sf_dir):
    """Turning every held-out label round, and any other column, changes no score."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {tuple(r) for r in score_toxicity(docs, labels).collect()}
    b = {tuple(r) for r in score_toxicity(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), turned).collect()}
    assert {(i, h, round(s, 9), p) for i, h, s, p in a} == {(i, h, round(s, 9), p) for i, h, s, p in b}


def test_disguised_words():
    for raw in ("idiot", "Idiot,", "id1ot", "!d!ot", "i.d.i.o.t", "IDIOOOOT!!", "(idi*ot)", "«idiot»"):
        assert _plain(raw)[0] in ("idiot", "idit"), raw
    assert _plain("idiot.") == ("idiot", False) and _plain("1d10t") == ("idiot", True) and _plain("---") == ("", False) and _plain("42") == ("", False)
    row = dict(zip(NAMES, Features({}).row("you absolute i d i o t, you")))
    assert row["spaced"] == 1


def test_features_by_hand():
    f = Features({"blarg": 3.0, "zorf*": 2.0, "meh": 1.0})
    row = dict(zip(NAMES, f.row("You blarg! Said the zorfling to MEH people, they blarg?!")))
    assert (row["strong"], row["weak"]) == (3 / 10, 4 / 10)
    assert (row["most"], row["three_most"], row["by_stem"]) == (3.0, 5.0, 1 / 10)  # one word twice and one beginning
    assert (row["near_second"], row["capital_words"], row["doubled_marks"]) == (2 / 10, 1 / 10, 1 / 10)
    assert math.isclose(row["capitals"], 5 / 43, rel_tol=0.05) and row["log_strong"] == math.log(4)
    assert f.row("") == [0.0] * len(NAMES) and f.row(" \n\t") == [0.0] * len(NAMES)
    assert STRONG <= 2.0


def test_pieces_of_a_long_text_sum_up(monkeypatch):
    rng = random.Random(1)
    words = ["you", "blarg", "zorfing", "fine", "OK,", "st0p", "été", "!!"]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(20)]
    whole = [Features({"blarg": 3.0, "zorf*": 2.0}).row(t) for t in texts]
    monkeypatch.setattr(toxicity, "PIECE", 37)
    assert np.allclose(whole, [Features({"blarg": 3.0, "zorf*": 2.0}).row(t) for t in texts])
    assert all(x in (0.0, 1.0) or x >= 0 for x in Features({}).row("x" * 500))


def test_lexicon_against_a_count(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        label = float(i % 4 == 0)
        words = rng.choices(["alpha", "beta", "gamma", "delta"], k=6) + (["vilest", "vilex"][i % 8 == 0 :][:1] if label else [])
        rows.append((" ".join(words), label, i % 3))
    fit = spark.createDataFrame(rows, "text string, label double, fold int")
    *others, every = learn_lexicons(fit)
    n, m = sum(r[1] for r in rows), sum(1 - r[1] for r in rows)
    keys = {"vilest": 15, "vilex": 15, "vile*": 30, "viles*": 15}
    assert set(every) == set(keys)
    for k, held in keys.items():
        assert math.isclose(every[k], entry_weight(held, 0, n, m), rel_tol=1e-9)
    for f in range(3):  # a fold's own texts don't count
        toxic = [r for r in rows if r[1] and r[2] != f]
        assert math.isclose(others[f]["vile*"], entry_weight(len(toxic), 0, len(toxic), sum(1 - r[1] for r in rows if r[2] != f)), rel_tol=1e-9)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 400_000), (4, "same"), (4, "same"), (None, "same")], DOCS)
    for labels in ([], [(1, 0), (2, 0)], [(1, 1), (None, 1), (4, 1), (4, 0), (3, None), (9, 1), (2, 7)]):
        got = score_toxicity(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(got) == 6 and len({r["score"] for r in got}) == 1 and all(0 <= r["score"] <= 1 for r in got)
        assert {r["held_out"] for r in got if r["doc_id"] is None} == {True}
    assert score_toxicity(docs.limit(0), spark.createDataFrame([(1, 1)], LABELS)).collect() == []
    odd = docs.select("doc_id", "text", F.lit("a").alias("score"), F.lit("b").alias("FEATURES"), F.lit(1).alias("toxic"), F.lit(2).alias("digest"))
    assert score_toxicity(odd, spark.createDataFrame([(1, 1)], LABELS)).columns == ["doc_id", "held_out", "score", "predicted"]

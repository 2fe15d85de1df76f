import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestream.llm import near_dedup
from lodestream.llm.near_dedup import near_duplicates
from lodestream.llm.registry import QUERIES
from lodestream.llm.shingles import Circulant, shingle_sets


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows, threshold=85):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def variants(seed=5):
    """Chains of edits, so that members of a group reach each other only through others."""
    rng = random.Random(seed)
    rows, vocabulary = [], [f"W{i}é" for i in range(400)]
    for _ in range(6):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(rng.choice([2, 14, 40])):
            rows.append(" \n".join(text) if rng.random() < 0.3 else " ".join(text).upper())
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
    return rows


def test_sets_and_signatures():
    texts = ["", " \n", "a b", "A b", "a b c d e", "a b c d e f a b c d e", "é" * 3, "x" * 3_000_000 + " y", "a b c d e " * 400_000]
    sets = list(shingle_sets(pa.array(texts)))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert (sets[2] == sets[3]).all() and np.intersect1d(sets[4], sets[5]).size == 1
    sliced = list(shingle_sets(pa.array(texts).slice(2, 4)))
    assert all((a == b).all() for a, b in zip(sliced, sets[2:6]))
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.r_[a[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)]
    s = Circulant(200, 5).signatures([a, b])
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.06


def test_against_all_pairs(spark):
    rows = list(enumerate([*variants(), None, "", "one two", "One  two", " "]))
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"node": F.lit(1), "key": F.lit("x"), "kept": F.lit(2)})
    for block in (512, 4):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(frame, block=block).collect()}
        assert got == brute(rows)


def test_odd_rows(spark):
    frame = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "x y"), (7, None)], "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_duplicates(frame).collect())
    assert got == [("4", "4", True), ("4", "4", True), ("7", "7", True), ("None", "4", False), ("None", "None", True)]
    assert near_duplicates(frame.limit(0)).count() == 0


def test_query_against_all_pairs(spark, sf_dir="/root/testdata/sf0.01"):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for threshold, frame in ((85, QUERIES["op2_near_dedup"](spark, sf_dir)), (80, near_duplicates(docs, 80)), (80, near_duplicates(docs, 80, deviations=None))):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in frame.collect()}
        assert got == brute(rows, threshold)


def test_many_that_share_most_words_and_stay_apart(spark):
    """Pages that share 400 of 480 words are in one bucket and apart; a few of them have near copies."""
    rng = random.Random(9)
    common = [f"c{rng.randrange(10**6)}" for _ in range(400)]
    own = [[f"o{rng.randrange(10**6)}" for _ in range(80)] for _ in range(1500)]
    rows = [(i, " ".join(common + x)) for i, x in enumerate(own)]
    rows += [(2000 + i, " ".join(common + own[i][:70] + ["x"] * 10)) for i in range(5)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == {**{i: i for i in range(1500)}, **{2000 + i: i for i in range(5)}}


def test_many_near_misses_of_one_text(spark):
    """Copies of one text with edits here and there: some reach the threshold, most pairs fall a little short of it."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(400):
        text = list(base)
        for p in rng.sample(range(300), rng.choice([3, 6, 8, 9, 10])):
            text[p] = f"e{rng.randrange(3)}" if rng.random() < 0.5 else f"o{i}"
        rows.append((i, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block in (256, 16):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(frame, block=block).collect()}
        assert got == brute(rows)


def test_sets_of_long_near_misses_move_once(spark, monkeypatch):
    """Long texts that nearly match share thousands of rare shingles; their whole sets go to one cell each."""
    rng = random.Random(8)
    base, rows = [f"b{i}" for i in range(2000)], []
    for i in range(12):
        text = list(base)
        for p in rng.sample(range(2000), 34 if i else 30):
            text[p] = f"o{i}x{p}"
        rows.append((i, " ".join(text)))
    met, inner = [], near_dedup._cells

    def spy(members, *args, whole):
        if whole:
            met.append(members.count())
        return inner(members, *args, whole=whole)

    monkeypatch.setattr(near_dedup, "_cells", spy)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows)
    assert met and max(met) <= 12

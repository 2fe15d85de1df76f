import math
import random
import re

import numpy as np
import pytest

from lodestream.llm import lexical
from lodestream.llm.lexical import search, terms
from lodestream.llm.registry import ORACLES, QUERIES
from tests.compare import oracle_rows, spark_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def cut(text):
    return [m.translate(UPPER) for m in TERM.findall(text or "")]


def brute(docs, items, k=10):
    words = [(i, cut(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = {t: sum(t in set(w) for _, w in words) for _, x in items for t in set(cut(x))}
    out = []
    for item, text in items:
        scored = []
        for doc, w in words:
            m = 10 + 90 * len(w) * n // total if w else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in set(cut(text)) if t in w)
            if score > 0:
                scored.append((-score, doc is None, doc))
        ranked = sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:k]
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(ranked)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_agrees_with_sql(spark, sf_dir):
    for where in (sf_dir, "/root/testdata/sf0.01"):
        assert spark_rows(QUERIES["op12_lexical_search"](spark, where)) == oracle_rows(where, ORACLES["op12_lexical_search"])


def test_terms_are_whole_over_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("aB9é_- \n\tÄ中.") for _ in range(rng.randrange(60)))
        assert [t.decode() for piece in terms(text.encode()) for t in piece] == cut(text)


@pytest.mark.parametrize("block", [1, 12, 1 << 18])
def test_against_brute_force(spark, monkeypatch, block):
    """Copies that tie across shards and tasks, odd rows, and trees of several levels."""
    rng = random.Random(block)
    vocabulary = [f"w{i}" for i in range(30)] + ["Émile", "ÉMILE", "x-ray", "A1"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 8, 30])))) for i in range(300)]
    docs += [(1000 + i, "w1 w2 w3") for i in range(80)] + [(2000, None), (2001, ""), (2002, "-- !!"), (None, "w1 w2 w3"), (5, "w1 w2 w3"), (5, "w1 w2 w3")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 9])))) for i in range(12)] + [(90, "w1 w2 w3"), (91, None), (92, "unseen"), (93, ""), (90, "w1, W2; w3"), (94, "w4 unseen w4")]
    monkeypatch.setattr(lexical, "SHARD_DOCS", 60)
    monkeypatch.setattr(lexical, "RANGES", (2, 8, 64))
    got = search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), block_terms=block)
    assert rows_of(got) == brute(docs, items)


def test_ranges_that_cannot_rank_stay_closed(monkeypatch):
    monkeypatch.setattr(lexical, "RANGES", (4, 16, 64))
    rng = np.random.default_rng(0)
    doc = np.arange(64)
    tree = lexical.Tree(np.array([7]), np.array([64]), doc, np.sort(rng.integers(1, 1000, 64)), 64)
    opened, inner = [], tree.bounds
    tree.bounds = lambda *a: opened.append(a[2:]) or inner(*a)
    best = lexical.best_first(tree, np.array([0]), np.array([3]), doc.tolist(), 3, [])
    assert [i for _, i in best] == [63, 62, 61] and sum(level == 0 for level, _, _ in opened) == 1
    # a second shard with nothing better is left at its root
    worse = lexical.Tree(np.array([7]), np.array([64]), doc, np.ones(64, np.int64), 64)
    worse.bounds = lambda *a, f=worse.bounds: opened.append(a[2:]) or f(*a)
    opened.clear()
    assert lexical.best_first(worse, np.array([0]), np.array([3]), doc.tolist(), 3, best) == best and len(opened) == 1
    # one whose bound equals the last score is opened, for its smaller id
    equal = lexical.Tree(np.array([7]), np.array([1]), np.array([0]), np.array([best[-1][0] // 3]), 1)
    assert lexical.best_first(equal, np.array([0]), np.array([3]), [1], 3, best)[-1] == (best[-1][0], 1)


def test_empty_tables_and_clashing_columns(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert search(d, i).collect() == [] and search(d, i).columns == ["item_id", "rank", "doc_id", "score"]
    odd = spark.createDataFrame([(1, "a b", 7, "r", "t")], "doc_id bigint, text string, id bigint, rank string, TERM string")
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in search(odd, items.withColumn("score", items.item_id)).collect()] == [(1, 1, 1)]

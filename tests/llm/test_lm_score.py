import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestream.llm import lm_score as L
from lodestream.llm.lm_score import score_texts
from lodestream.llm.registry import QUERIES


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def base(rows):
    out = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(t for h, (_, x) in zip(out, rows) if not h for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return [
        (i, h, len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x)))
        for h, (i, x) in zip(out, rows)
    ]


def agree(got, rows):
    key = lambda r: (str(r[0]), *r[1:5])
    for g, w in zip(sorted((tuple(r) for r in got), key=key), sorted(base(rows), key=key), strict=True):
        assert g[:5] == w[:5]
        assert math.isclose(g[5], w[5], rel_tol=1e-9)
        assert g[6] < 0 and g[7] > 0


def test_odd_rows(spark):
    rows = [(i, f"word{i % 3} Word{i} and é 日本 the") for i in range(40)]
    rows += [(40, None), (41, ""), (42, " \n"), (None, "null id word1"), (3, "word0 Word3"), (3, "word0 Word3"), (43, "x" * 70_000 + " y"), (44, "x" * 69_000 + "z"), (45, "a b " * 30_000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lp": F.lit("x"), "word": F.lit(1), "held": F.lit(2)})
    for head in (1 << 18, 3):
        agree(score_texts(frame, head=head).collect(), rows)
    assert score_texts(frame.limit(0)).count() == 0


TEXTS = ["the cat sat on the mat and the cat ran", "a dog sat on a mat", "the dog and the cat ran off", "der hund und die katze", "die katze sitzt auf der matte", "zzyq zzyq the zzyq qua"]


def model(seed=3):
    """A coder, and tables and states of no particular fit."""
    rng = np.random.default_rng(seed)
    count, texts, spelt = Counter(), Counter(), np.zeros(257, np.int64)
    for t in TEXTS:
        count.update(tokens(t))
        texts.update(set(tokens(t)))
    words = [w for w in count if w is None or count[w] > 1]
    raw = [(w or "").encode() for w in words]
    for w in count.keys() - set(words):
        spelt[:256] += np.bincount(np.frombuffer(w.encode(), np.uint8), minlength=256)
        spelt[256] += 1
    hashes = np.array([L.END if w is None else int(next(L._words(pa.array([w])))[5][0]) for w in words])
    coder = L.make_coder(raw, hashes, np.array([count[w] for w in words]), np.array([texts[w] for w in words]), 5, spelt, 5, 3)
    tables = [[rng.integers(0, 40, (2, 1 << bits)).astype(np.float32) for _ in range(k)] for k, bits in zip(L.CONTEXTS, L.SLOT_BITS)]
    states = [(rng.normal(0.2, 0.2, (L.GATES, k + 3)).astype(np.float32), rng.uniform(0.05, 0.95, L.GATES * L.LEVELS).astype(np.float32)) for k in L.CONTEXTS]
    return coder, tables, states, dict(zip(raw, coder.symbols[np.searchsorted(coder.hashes, hashes)]))


def vectorised(coder, tables, states, texts):
    mixers = [L.Mixer(t, tables[t], states[t]) for t in (0, 1)]
    out = []
    for _, *x in L._words(pa.array(texts)):
        both = L.symbols(coder, *x)[:2]
        out.append(sum(np.bincount(s.row, L.log_symbols(coder, m, s), minlength=len(texts)) for s, m in zip(both, mixers)))
    return sum(out)


MASK = (1 << 64) - 1


def mixed(x):
    return int(L.mix(np.array([x & MASK], np.uint64))[0])


def one_bit(tables, state, tree, d, node_hash, order0, contexts, text, t, bit):
    """The natural log of a bit's probability, number by number."""
    squash = lambda z: 1 / (1 + math.exp(-z))
    seen = lambda n: (n > 0) + (n > 3) + (n > 31)
    x, picks = [order0], {}
    for k, c in enumerate(contexts):
        slot = (((c ^ node_hash) * int(L._MULT)) & MASK) >> (64 - L.SLOT_BITS[t])
        n0, n1 = (float(tables[t][k][y][slot]) for y in (0, 1))
        x.append(math.log((n1 + 0.4) / (n0 + 0.4)))
        picks[k] = seen(n0 + n1)
    if t == 0:
        n0, n1 = text
        one = squash(order0)
        x.append(math.log((n1 + one) / (n0 + 1 - one)))
        picks[len(contexts)] = seen(n0 + n1)
        gate = (d * 4 + picks[4]) * 4 + picks[0]
    else:
        x.append(0.0)
        gate = (d * 4 + picks[2]) * 4 + picks[4]
    weights, refined = state
    z = max(-14.0, min(14.0, sum(float(w) * v for w, v in zip(weights[gate], [*x, 1.0]))))
    p = (squash(z) + float(refined[gate * L.LEVELS + min(L.LEVELS - 1, max(0, int(z + 12)))])) / 2
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p if bit else 1 - p)


def slowly(coder, tables, states, numbers, text):
    """The natural log of a text's probability by a loop over its tokens, symbols and bits."""
    words = tokens(text)
    code = {w: int(next(L._words(pa.array([w])))[5][0]) & MASK for w in set(words) - {None}} | {None: int(L.END)}
    passed, escaped, total = defaultdict(lambda: [0, 0]), [], 0.0
    shorts = []
    for i, w in enumerate(words):
        one, two = (code[words[i - k]] if i >= k else int(L.START) for k in (1, 2))
        short1, short2 = (shorts[-k] if len(shorts) >= k else int(L.START) for k in (1, 2))
        contexts = [mixed(one ^ 1), mixed(one + mixed(two)), mixed(short1 ^ 2), mixed(short1 + mixed(short2))]
        raw = (w or "").encode()
        number = numbers.get(raw, len(coder.symbols))
        if raw not in numbers:
            if raw in escaped:
                number += 1
                total += math.log(escaped.count(raw) / len(escaped))
        spell = number == len(coder.symbols)
        tree = coder.trees[0]
        total += float(tree.rest[number])
        for d in range(tree.depth[number]):
            node, bit = int(tree.node[d][number]), int(tree.bit[d][number])
            total += one_bit(tables, states[0], tree, d, int(tree.hash[node]), float(tree.odds[node]), contexts, passed[node], 0, bit)
            passed[node][bit] += 1
        if raw not in numbers:
            escaped.append(raw)
        if spell:
            tree, so_far = coder.trees[1], []
            for b in [*raw, 256]:
                hashes, last = [mixed(contexts[2] ^ 3)], 0
                for k in range(1, 5):
                    last = (last * 263 + (so_far[-k] + 1 if len(so_far) >= k else 0)) & MASK
                    hashes.append(mixed(last + (k << 60)))
                total += float(tree.rest[b])
                for d in range(tree.depth[b]):
                    node, bit = int(tree.node[d][b]), int(tree.bit[d][b])
                    total += one_bit(tables, states[1], tree, d, int(tree.hash[node]), float(tree.odds[node]), hashes, None, 1, bit)
                so_far.append(b)
        if w is not None and len(raw) <= L.SHORT:
            shorts.append(code[w])
    return total


def test_a_slow_mixer_agrees():
    fitted = model()
    texts = [*TEXTS, "", "new words new words the cat", "é é the é"]
    got = vectorised(*fitted[:3], texts)
    for text, x in zip(texts, got):
        assert math.isclose(x, slowly(*fitted, text), rel_tol=1e-5), text


def test_probabilities_add_up():
    """Over all symbols of a tree, in any context: words, escape and mark after given words; bytes and the end of a word."""
    coder, tables, states, _ = model()
    for t, tree in enumerate(coder.trees):
        mixer, n = L.Mixer(t, tables[t], states[t]), len(tree.depth)
        for seed in range(3):
            contexts = [np.full(n, c, np.uint64) for c in np.random.default_rng(seed).integers(0, 1 << 62, L.CONTEXTS[t])]
            every = L.Symbols(t, np.arange(n), np.arange(n), contexts)  # each in a text of its own, after nothing
            assert math.isclose(np.exp(L.log_symbols(coder, mixer, every)).sum(), 1, rel_tol=1e-4)


def test_order_and_partitions(spark):
    """Scores are the same for every dealing of rows, and change if a text's words are turned round."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    turned = docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.array_join(F.reverse(F.split("text", r"\s+")), " ").alias("text"))
    turned = turned.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)  # none of them is learnt from
    both = docs.union(turned)
    runs = []
    try:
        for n in (4, 16, 4):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            runs.append({r["doc_id"]: r["score"] for r in score_texts(both.repartition(n)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert all(math.isclose(runs[0][i], run[i], rel_tol=1e-9) for run in runs for i in runs[0])
    words = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
    compared = [(runs[0][i], runs[0][i - 1_000_000]) for i in runs[0] if i >= 1_000_000 and words[i - 1_000_000] > 20]
    assert len(compared) > 20 and all(abs(a - b) > 1e-3 for a, b in compared)


def test_query_and_the_base(spark, sf_dir="/root/testdata/sf0.01"):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op3_lm_score"](spark, sf_dir).collect()
    agree(got, rows)
    test = [r for r in got if r["held_out"]]
    model, unigram = (sum(r[k] for r in test) / sum(r["n_tokens"] for r in test) for k in ("score", "base_score"))
    assert model > unigram
    size = {i: len((t or "").encode()) for i, t in rows}
    assert all(math.isclose(r["bits_per_byte"], -r["score"] / math.log10(2) / size[r["doc_id"]]) for r in got)


def test_most_held_out_documents_beat_the_base(spark, sf_dir="/root/testdata/sf0.1"):
    """At sf0.01 a sixth of held-out tokens are new, each of which the base gives the whole mass of new tokens, as no probability over words can; here it is a fourteenth."""
    test = QUERIES["op3_lm_score"](spark, sf_dir).where("held_out").collect()
    assert np.mean([r["score"] > r["base_score"] for r in test]) > 0.8


def test_tables_without_and_with_one_training_row(spark):
    """All rows held out: no training tokens, every score finite; one training row is enough to learn from."""
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    other = next(i for i in range(60) if zlib.crc32(str(i).encode()) % 5 != 1)
    for rows in ([(i, "the cat sat") for i in held], [(i, "the cat sat") for i in held] + [(other, "the dog sat")], [(other, None)]):
        got = score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert len(got) == len(rows) and all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in got)
        agree(got, rows)


def test_weights_are_learnt_from_all_training_texts(spark, monkeypatch):
    """More texts than were once sampled: weights and refining tables are those of a loop over every training text."""
    seen = []
    fit = L.fit_mixers

    def watched(*args):
        seen.append((args, fit(*args)))
        return seen[-1][1]

    monkeypatch.setattr(L, "fit_mixers", watched)
    rows = [(i, f"w{i % 50} x{i * i % 7} the w{i % 11} n{i}") for i in range(6000)]
    score_texts(spark.createDataFrame(rows, "doc_id bigint, text string"))
    (docs, k, coder, tables, *_), states = seen[0]
    texts = defaultdict(list)
    for key, body in docs.where("not held").select(k, "body").collect():
        texts[key % 8].append((key, body))
    assert sum(map(len, texts.values())) > 4700
    learnt = []
    for shard in sorted(texts):
        mixers = [L.Mixer(t, tables.value[t]) for t in (0, 1)]
        for _, *x in L._words(pa.array([body for _, body in sorted(texts[shard])])):
            for s, mixer in zip(L.symbols(coder.value, *x, learning=True), mixers):
                L.fit_symbols(coder.value, mixer, s)
        learnt.append(mixers)
    middle = 1 / (1 + np.exp(-(np.tile(np.arange(L.LEVELS), L.GATES) + 0.5 - 12)))
    for t, (weights, refined) in enumerate(states):
        assert np.allclose(weights, np.mean([m[t].weights for m in learnt], 0), atol=1e-5)
        pairs = sum(m[t].pairs for m in learnt)
        assert np.allclose(refined, (pairs[1] + 20 * middle) / (pairs.sum(0) + 20), atol=1e-5)
    column = pa.array(["a b", "c" * 70_000, "", "d e f", "g" * 200_000, "h"] * 9)
    whole = [(3, x) for x in L._cut([column])]
    for n in (1, 4, 54):
        batches = [pa.record_batch([pa.array([3] * len(x), pa.int32()), x], ["shard", "body"]) for x in (column.slice(i, n) for i in range(0, 54, n))]
        assert list(L.shard_chunks(batches)) == whole


def test_coded_counts():
    """Up to 2^16 pairs of counts are kept as they are; of more, the leading digits."""
    rng = np.random.default_rng(5)
    for top, near in ((200, 0), (1 << 30, 0.02)):
        n = rng.integers(0, top, (2, 1 << 18)).astype(np.float32)
        n[:, :1000] %= 8
        out = L.coded([n])
        got = out.counts[0][:, out.codes[0]]
        assert len(out.counts[0][0]) <= 1 << 16 and np.all(np.abs(got - n) <= near * n)


def test_slots_of_a_context():
    """After one context no two nodes share a slot, and the bits of a symbol lie in three runs of 64 bytes of two-byte codes."""
    rng = np.random.default_rng(7)
    for weights, bits in ((rng.zipf(1.3, 100_000).clip(1, 10**6) * 256, L.SLOT_BITS[0]), (rng.integers(1, 10**6, 257), L.SLOT_BITS[1])):
        tree = L.Tree(weights) if bits == L.SLOT_BITS[0] else L.Tree(weights, slot_bits=bits)
        for context in rng.integers(0, 1 << 63, 3).astype(np.uint64):
            slot = ((context ^ tree.hash) * L._MULT) >> np.uint64(64 - bits)
            assert len(np.unique(slot)) == len(tree.hash)
            block = (slot >> np.uint64(5)).astype(np.int64)
            for symbol in rng.integers(0, len(weights), 200):
                assert len({int(block[tree.node[d, symbol]]) for d in range(tree.depth[symbol])}) <= 3


def test_dictionary_of_crowded_slots():
    """Words are found among others whose hashes start alike, and only words are."""
    rng = np.random.default_rng(11)
    hashes = np.unique(np.r_[rng.integers(-1 << 63, (1 << 63) - 1, 3000), (rng.integers(-1 << 17, 1 << 17, 40)[:, None] * (1 << 46) + rng.integers(0, 1 << 40, (40, 9))).ravel(), L.END])
    rng.shuffle(hashes)
    words = [b"w%d" % i for i in range(len(hashes))]
    coder = L.make_coder(words, hashes, rng.integers(1, 99, len(hashes)), np.full(len(hashes), 2), 5, np.zeros(257, np.int64), 5, 3)
    asked = np.r_[hashes, hashes + 1, rng.integers(-1 << 63, (1 << 63) - 1, 3000)]
    at, hit = coder.find(asked)
    assert np.array_equal(hit, np.isin(asked, hashes)) and np.array_equal(coder.hashes[at[hit]], asked[hit])


def test_passes_by_counting():
    """Earlier symbols of a text with the same first bits, as a loop counts them; many texts, some long, empty runs between."""
    coder = model()[0]
    rng = np.random.default_rng(13)
    row = np.sort(np.r_[rng.integers(0, 40, 300), np.full(9000, 41), rng.integers(42, 60, 50)])
    number = rng.integers(0, len(coder.trees[0].depth), len(row))
    arranged = L.Arranged(coder, L.Symbols(0, number, row, [np.zeros(len(row), np.uint64)] * L.CONTEXTS[0]))
    got = np.empty((L.DEPTH + 1, len(row)), np.float32)
    got[:, arranged.order] = L.passes(row, arranged)
    tree, seen = coder.trees[0], Counter()
    for i, (r, s) in enumerate(zip(row.tolist(), number.tolist())):
        path = tuple(int(b) for b in tree.bit[: tree.depth[s], s])
        for d in range(len(path) + 1):
            assert got[d, i] == seen[r, path[:d]]
            seen[r, path[:d]] += 1

import random
import re
from collections import Counter, defaultdict
from functools import lru_cache

from pyspark.sql import functions as F

from lodestream.llm import decontaminate
from lodestream.llm.decontaminate import UNITS, drop_leaks, flag_leaks
from lodestream.llm.registry import QUERIES

ITEMS = [
    (1, "A train leaves Paris at 9 with 120 people and travels 300 km to Lyon, then 120 people leave the train in the city of Lyon."),
    (2, "What is the capital city of France"),
    (3, "If Anna has 3 apples and gives 3 apples to Bob, how many apples will be left for Anna at the end of the day?"),
    (4, None), (5, ""), (6, "yes"), (None, "An item that has no number of its own but should still be found by the scan here."),
]
PAD = "some words that come before and have nothing to do with it at all. "
DOCS = [
    (1, PAD + ITEMS[0][1] + " " + PAD),
    (2, (PAD + ITEMS[0][1]).lower().replace(" ", "\n")),
    (3, PAD + "A train leaves Berlin at 7 with 250 people and travels 550 mi to Munich, then 250 people leave the train in the city of Munich."),
    (4, PAD + "A train leaves Berlin at 7 with 250 people and travels 550 mi to Munich, then 99 people leave the train in the city of Bonn."),
    (5, PAD * 40), (6, None), (7, ""), (8, "He asked: what is the CAPITAL city of France?"), (9, "what is the capital of France"),
    (10, "If Carl has 1,500 apples and gives 1,500 apples to Dora, how many apples will be left for Carl at the end of the day?"),
    (11, " ".join(ITEMS[2][1].split()[:9])), (12, ITEMS[2][1]), (12, ITEMS[2][1]), (12, PAD), (None, ITEMS[1][1]), (None, PAD),
    (13, "word " * 100_000 + ITEMS[0][1]), (14, ITEMS[6][1]),
]


def frames(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string").withColumns({"h": F.lit("x"), "pos": F.lit(1), "items": F.lit(0), "window": F.lit(2)})
    return docs, spark.createDataFrame(ITEMS, "item_id bigint, text string")


def test_flags(spark):
    docs, items = frames(spark)
    for sent in (10_000, 0):
        rows = flag_leaks(docs, items, sent=sent).collect()
        assert len(rows) == len(DOCS)
        found = sorted((r["doc_id"] or -1, tuple(r["items"]), r["reparameterised"]) for r in rows if r["contaminated"])
        plain = [(d, i) for d, i, _ in found]
        assert plain == [(-1, (2,)), (1, (1,)), (2, (1,)), (3, (1,)), (8, (2,)), (10, (3,)), (12, (3,)), (12, (3,)), (13, (1,)), (14, ())]
        assert {d: x for d, _, x in found} == {-1: False, 1: False, 2: False, 3: True, 8: False, 10: True, 12: False, 13: False, 14: False}


def test_drops_and_empty_tables(spark):
    docs, items = frames(spark)
    left = drop_leaks(docs, items)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, 4, 5, 6, 7, 9, 11, 12]
    assert flag_leaks(docs, items.limit(0)).where("contaminated").count() == 0
    assert flag_leaks(docs.limit(0), items).count() == 0


def found(spark, items, docs):
    flags = flag_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    return {r["doc_id"]: (r["items"], r["reparameterised"]) for r in flags.collect()}


def test_verbatim_copies_of_numbers_and_short_items(spark):
    items = [(1, "What is 345 + 128 - 57 + 99 - 13 + 6?"), (2, "Which number comes next in 2, 4, 8, 16, 32, 64, 128?"), (3, "Name three primes"), (4, "7 * 8 = 56")]
    docs = [(i, PAD + text + " " + PAD) for i, text in items] + [(5, PAD + "What is 1 + 2 - 3 + 4 - 5 + 7?"), (6, "Name three rivers"), (7, PAD)]
    # 5 is a whole sentence of an item's template, with one value for each of its values
    assert found(spark, items, docs) == {**{i: ([i], False) for i, _ in items}, 5: ([1], True), 6: ([], False), 7: ([], False)}


def test_number_heavy_and_short_items_with_other_values(spark):
    items = [(1, "What is 345 + 128 - 57 + 99 - 13 + 6?"), (2, "Solve 3 x + 7 = 22"), (3, "Compute 12 * 7"), (4, "Tom has 5 apples"), (5, "7 * 8 = 56")]
    docs = [
        (1, PAD + "What is 1 + 2 - 3 + 4 - 5 + 7? " + PAD), (2, "Solve 4 x + 9 = 33"), (3, PAD + "Compute 13 * 8. " + PAD), (4, "Anna has 9 apples. " + PAD),
        (5, "What is 1 + 1 - 1 + 4 - 5 + 7?"), (6, "then Solve 4 x + 9 = 33"), (7, "Anna has 9 apples and more"), (8, "3 * 9 = 27"), (9, PAD + "we compute 13 * 8. "),
    ]
    assert found(spark, items, docs) == {1: ([1], True), 2: ([2], True), 3: ([3], True), 4: ([4], True), **{i: ([], False) for i in range(5, 10)}}


def test_words_that_hold_digits_are_no_numbers(spark):
    said = "the quick code that we use for all of our parts is"
    items = [(i, f"{said} q{1000 + i} and then {chr(97 + i)} x{7 * i} in row {chr(97 + i) * 3}") for i in range(6)]
    docs = [(i, f"{said} q{2000 + i} and then {chr(107 + i)} x{9 * i + 5} in row {chr(107 + i) * 3}") for i in range(6)] + [(9, items[2][1])]
    assert found(spark, items, docs) == {**{i: ([], False) for i in range(6)}, 9: ([2], False)}


def test_a_sentence_that_items_share_pairs_no_document_with_all_of_them(spark, monkeypatch):
    rng, said = random.Random(6), "this is the one sentence that all of them begin with"
    own = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(14))
    items = [(i, f"{said} {own()}") for i in range(60)]
    docs = [(i, f"{said} {own()}") for i in range(60)] + [(100 + i, items[i][1]) for i in range(3)] + [(200, said)]
    written, inner = {}, decontaminate.materialise

    def spy(df, name):
        out = inner(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(decontaminate, "materialise", spy)
    assert found(spark, items, docs) == {**{i: ([], False) for i in range(60)}, **{100 + i: ([i], False) for i in range(3)}, 200: ([], False)}
    assert written["aligned"] < 300
    # a passage long enough to hold an item holds all that share it
    long = said + " and go on with for quite some more"
    assert found(spark, [(i, f"{long} {own()}") for i in range(12)], [(1, long)]) == {1: (list(range(12)), False)}


def test_names_that_open_and_names_of_several_words(spark):
    items = [(1, "Anna buys 12 pencils and 3 pens for 5 dollars"), (2, "Anna gave Bob 3 apples and Bob ate them before Anna left")]
    docs = [
        (1, PAD + "Bob buys 7 pencils and 4 pens for 9 dollars. " + PAD), (2, PAD + "Mary Ann buys 7 pencils and 4 pens for 9 dollars"), (3, "Anna sells 7 pencils or 4 pens at 9 dollars"),
        (4, PAD + "Mary Ann gave Carl Smith 5 apples and Carl Smith ate them before Mary Ann left"), (5, PAD + "Mary gave Carl 5 apples and Dora ate them before Emil left"),
        (6, "so then Bob buys 7 pencils and 4 pens for 9 dollars"), (7, items[0][1]),
    ]
    assert found(spark, items, docs) == {1: ([1], True), 2: ([1], True), 3: ([], False), 4: ([2], True), 5: ([], False), 6: ([1], True), 7: ([1], False)}


def test_slots_are_one_to_one(spark):
    items = [(1, "A train leaves at 120 and arrives at 250 with 300 people and 470 bags in the last of all cars")]
    docs = [(1, PAD + items[0][1].replace("120", "5").replace("250", "5").replace("300", "5").replace("470", "5")), (2, PAD + items[0][1].replace("120", "7").replace("470", "9"))]
    assert found(spark, items, docs) == {1: ([], False), 2: ([1], True)}


def test_pieces_of_several_alignments_are_none(spark):
    words = "one of the many things that a person could say about rivers is how very slow they are in summer".split()
    docs = [(1, " ".join([*words[:9], "so", "it", "is", *words[9:18], "and", "then", *words[18:]])), (2, " ".join(words))]
    assert found(spark, [(1, " ".join(words))], docs) == {1: ([], False), 2: ([1], False)}


TOKEN = re.compile(r"(?:[0-9A-Za-z\u0080-\U0010ffff]|(?<=[0-9])[.,](?=[0-9]))+")


def slow_forms(text):
    """By form: tokens as (value, kind, whether a sentence opens, first and end place), written without arrays."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    out, end, before = [], 0, False
    for m in TOKEN.finditer(text or ""):
        value, number = lower(m[0]), bool(re.fullmatch("[0-9.,]+", m[0]))
        opens = not out or bool(re.search("[\n\r!.:?]", text[end : m.start()]))
        kind = "number" if number else "unit" if before and value in UNITS else ""
        out.append((value, kind, opens, "A" <= m[0][0] <= "Z" and not re.search("[0-9]", value)))
        end, before = m.end(), number
    by = {0: [(v, "", o, i, i + 1) for i, (v, _, o, _) in enumerate(out)], 1: [(v, k, o, i, i + 1) for i, (v, k, o, _) in enumerate(out)]}
    for form in (2, 3):
        mine = [(v, "name" if n and (form == 3 or not o) else k, o) for v, k, o, n in out]
        if all(a[1] == b[1] for a, b in zip(mine, by[1])):
            continue
        by[form] = []
        for i, (v, k, o) in enumerate(mine):
            if i and k == "name" and mine[i - 1][1] == "name" and not o:
                last = by[form].pop()
                by[form].append((f"{last[0]} {v}", *last[1:4], i + 1))
            else:
                by[form].append((v, k, o, i, i + 1))
    return by


slow_forms = lru_cache(maxsize=500)(slow_forms)


def template(part):
    return tuple(k or "=" + v for v, k, *_ in part)


@lru_cache(maxsize=100)
def places(doc, form, size):
    out = defaultdict(list)
    said = slow_forms(doc)[form]
    for j in range(len(said) - size + 1):
        out[template(said[j : j + size])].append(j)
    return out


def slow_hits(doc, item, window=8, cover=13):
    """(held, re-parameterised), window by window."""
    texts, items = slow_forms(doc), slow_forms(item)
    total, held, other = len(items[0]), False, False
    shifts, slots = {}, {}
    for form, own in items.items():
        size = min(window, len(own))
        if not size or form not in texts:
            continue
        said = texts[form]
        parts = [own[i : i + size] for i in range(len(own) - size + 1)]
        kept = [i for i, a in enumerate(parts) if not form or (total >= 5 and 2 * sum(not k for _, k, *_ in a) >= size)]
        alone = not kept and size == len(own) >= 3 and any(not k for _, k, *_ in own)
        for i in kept or ([0] if alone else []):
            a = parts[i]
            for j in places(doc, form, size).get(template(a), ()):
                if alone and not (said[j][2] and (j + size == len(said) or said[j + size][2])):
                    continue
                shifts.setdefault((form, j - i), set()).update(range(own[i][3], own[i + size - 1][4]))
                mine = {(i + k, said[j + k][0], own[i + k][0]) for k in range(size) if own[i + k][1] and not (own[i + k][2] and own[i + k][0] == said[j + k][0])}
                slots.setdefault(j - i, set()).update(mine)
    for (form, shift), at in shifts.items():
        pairs = Counter((w, v) for _, v, w in slots[shift])
        if form and pairs:
            agreed = [sum(max(n for p, n in pairs.items() if p[k] == x) for x in {p[k] for p in pairs}) for k in (0, 1)]
            if min(agreed) / len(slots[shift]) < 0.8:
                continue
        if len(at) >= min(cover, total):
            held = True
            other |= bool(form) and any(w != v for w, v in pairs)
    return held, other


def test_query_against_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {r["doc_id"]: (r["items"], r["reparameterised"]) for r in QUERIES["op4_decontamination"](spark, sf_dir).collect()}
    rng = random.Random(3)
    some = dict(rng.sample(sorted(docs.items()), 60)) | {i: t for i, t in docs.items() if got[i][0]}
    for i, text in some.items():
        hits = {k: slow_hits(text, x) for k, x in items.items()}
        assert got[i] == (",".join(str(k) for k in sorted(hits) if hits[k][0]), any(o for h, o in hits.values() if h)), i


def test_made_cases_against_brute_force(spark):
    docs, items = DOCS + [(100 + i, d) for i, (_, d) in enumerate([(1, "Anna buys 12 pencils and 3 pens for 5 dollars."), (2, PAD + "Mary Ann buys 7 pencils and 4 pens for 9 dollars")])], ITEMS + [(50, "Anna buys 12 pencils and 3 pens for 5 dollars")]
    flags = flag_leaks(spark.createDataFrame([(i, d) for i, (_, d) in enumerate(docs)], "doc_id bigint, text string"), spark.createDataFrame([(k, x) for k, (_, x) in enumerate(items)], "item_id bigint, text string"))
    for r in flags.collect():
        hits = {k: slow_hits(docs[r["doc_id"]][1], x) for k, (_, x) in enumerate(items)} if r["doc_id"] != 16 else None
        if hits is not None:
            assert (r["items"], r["reparameterised"]) == ([k for k in hits if hits[k][0]], any(o for h, o in hits.values() if h)), docs[r["doc_id"]]


def test_query_finds_planted_items(spark, sf_dir):
    words = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    docs = {r["doc_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if f" {x} " in f" {t} "}
    got = {(r["doc_id"], i) for r in QUERIES["op4_decontamination"](spark, sf_dir).collect() for i in map(int, filter(None, r["items"].split(",")))}
    assert whole and whole <= got

    def shares(d, i, n):
        w = items[i].split()
        return any(f" {' '.join(w[k : k + n])} " in f" {docs[d]} " for k in range(max(1, len(w) - n + 1)))

    assert all(shares(d, i, 8) for d, i in got)

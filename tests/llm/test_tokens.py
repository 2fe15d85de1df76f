import uuid
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestream.llm import packing, token_counts, token_files
from lodestream.llm.encode import Encoder
from lodestream.llm.packing import cut_pieces, pack, ranges, sweep
from lodestream.llm.registry import QUERIES
from lodestream.llm.shared import StoredArray
from lodestream.llm.token_counts import count_tokens, may_miss, read_cache, tokenizer_version
from lodestream.llm.token_files import open_token_files, read_token_files, write_token_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n", "a  b", " a", "a ", "a\n\nb", "a \n b", "a  b", "a  b", "don't I'll", "x<|endoftext|>y z", "<|startoftext|> a", "é ́x", "ΑΣ ΑΣ.", "12 345\t6", "a\r\nb", "\x1cb \x1c", "日本 語", "🙂 🙂", "a\xa0b \xa0c\xa0 d", "I'LL it's ’s", "x²3 ½", "\xa0\n\xa0 a", "a" * 5000]


@pytest.mark.parametrize("path", [BYTE, WORD, public_tokenizers.path("piece_bpe_32k.model")])
def test_pieces_give_the_library_s_ids(path):
    enc = Encoder(path, limit=7)
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(ODD)] == [list(x) for x in enc._library(ODD)]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(" \n\t\r'stdSabΣéÉÀ×ªµ́\xa0 \x1c\x85İǅ1²½.,!’—日🙂_<|>"), max_size=14))
def test_random_texts(text):
    for path in (BYTE, WORD):
        enc = _encoders.setdefault(path, Encoder(path, limit=50))
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == enc._library([text])[0]


_encoders: dict = {}
ROWS = [(1, "one two"), (2, None), (3, ""), (4, "one  two\n"), (None, "null id"), (5, "again"), (5, "again"), (6, "long " * 4000)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"id": F.lit(7), "n_tokens": F.lit("x"), "body": F.lit("y")})


def test_counts_and_cache(spark, tmp_path):
    tok, cache = Tokenizer.from_file(WORD), str(tmp_path / "cache")
    got = count_tokens(frame(spark), WORD, cache).collect()
    want = sorted((str(i), len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    version = tokenizer_version(WORD)
    assert read_cache(spark, cache, version).count() == 5  # 1 and 4, 2 and 3, 5 and 5 are alike
    more = frame(spark, [(9, "one two"), (10, "new")])
    assert {(r["doc_id"], r["n_tokens"]) for r in count_tokens(more, WORD, cache).collect()} == {(9, 2), (10, 1)}
    assert read_cache(spark, cache, version).count() == 6
    assert count_tokens(frame(spark, []), WORD).count() == 0


def test_only_distinct_misses_are_encoded(spark, tmp_path, monkeypatch):
    """Repeated rows, null ids, copies and texts that differ in white space alone are encoded once."""
    log = tmp_path / "encoded"
    log.mkdir()

    class Spy(Encoder):
        def encode(self, texts):
            for t in texts:
                (log / uuid.uuid4().hex).write_text(t)
            return super().encode(texts)

    monkeypatch.setattr(token_counts, "encoder", lambda path: Spy(path))
    rows = [(1, "one two"), (1, "one two"), (None, "one  two"), (None, "null id"), (None, "null id"), (2, None), (3, ""), (4, "é 🙂"), *((i, "copy of it") for i in range(50, 3000))]
    cache = str(tmp_path / "cache")
    for again in range(2):
        got = count_tokens(frame(spark, rows), WORD, cache).collect()
        assert len(got) == len(rows) and {(r["n_bytes"], r["n_tokens"]) for r in got if r["doc_id"] in (1, 3, 4)} == {(7, 2), (0, 0), (7, len(Tokenizer.from_file(WORD).encode("é 🙂", add_special_tokens=False).ids))}
        texts = sorted(" ".join(p.read_text().split()) for p in log.iterdir())
        assert texts == ["", "copy of it", "null id", "one two", "é 🙂"]
    counted = read_cache(spark, cache, tokenizer_version(WORD))
    counted.write.mode("append").parquet(f"{cache}/tokenizer={tokenizer_version(WORD)}")
    assert count_tokens(frame(spark, rows), WORD, cache).count() == len(rows)


def test_only_texts_of_misses_move(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("h"), F.xxhash64(F.col("id") + 1).alias("ih"), F.col("id").cast("string").alias("body"))
    misses = rows.where("body in ('7', '70', '700')").select("h", "ih")
    kept = may_miss(rows, misses)
    assert sorted(r["body"] for r in kept.collect()) == ["7", "70", "700"] and kept.columns == rows.columns
    assert may_miss(rows, rows.select("h", "ih")).count() == 5000 and may_miss(rows, misses.limit(0)).count() == 0
    # what is shuffled is the bits of the misses; the rows meet the map where they are
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "body" in x] == []


def test_files_of_odd_ids_in_parts_by_size(spark, tmp_path, monkeypatch):
    """A null id isn't the smallest one; parts follow the bytes; ids are read by ranges."""
    monkeypatch.setattr(token_files, "PART_BYTES", 1 << 10)
    least = -(1 << 63)
    rows = [(None, "null"), (None, None), (least, "least"), *((i, f"text {i} " * 40) for i in range(40)), (99, "long " * 3000)]
    files = write_token_files(frame(spark, rows), BYTE, 2, str(tmp_path / "files"))
    assert len(files.manifest) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = read_token_files(spark, files).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, least, *range(40), 99]
    tok = Tokenizer.from_file(BYTE)
    want = {i: zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows if i is not None}
    assert {r["doc_id"]: r["ids_crc32"] for r in got if r["doc_id"] is not None} == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=12), st.integers(1, 9))
def test_checksums_by_windows(sizes, window):
    ids, offsets = np.arange(200, dtype="<u2"), np.cumsum([0, *sizes])
    before, token_files.WINDOW = token_files.WINDOW, window
    try:
        got = token_files._checksums(ids, offsets)
    finally:
        token_files.WINDOW = before
    assert got == [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(offsets, offsets[1:])]


def test_ranges_of_a_stored_array(tmp_path):
    flat = np.arange(1000, dtype="<u4")
    flat.tofile(tmp_path / "x.ids")
    stored = StoredArray(f"file://{tmp_path}/x.ids", "<u4")
    assert len(stored) == 1000 and stored[10:20].tolist() == list(range(10, 20))
    assert stored[990:2000].tolist() == list(range(990, 1000)) and stored[5:5].tolist() == []


def test_files(spark, tmp_path):
    tok, path = Tokenizer.from_file(BYTE), str(tmp_path / "files")
    write_token_files(frame(spark), BYTE, 2, path)
    got = read_token_files(spark, open_token_files(spark, path)).orderBy("start").collect()
    start, want = 0, []
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert read_token_files(spark, write_token_files(frame(spark, []), BYTE, 2)).count() == 0


def whole(rows, capacity):
    """Sequences have no gap, overlap or excess."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def plain_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def best_fit(runs, capacity):
    """The supersteps one after the other."""
    out, gaps, opened = [], [], 0
    for low, high in ranges(capacity, 1):
        mine = {n: c for n, c in runs.items() if low <= n <= high}
        matches, left, opened = sweep(mine, [g for g in gaps if g[0] >= low], opened, capacity)
        out += matches
        gaps = left + [g for g in gaps if g[0] < low]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_runs_pack_as_single_documents_do(lengths):
    runs = {n: lengths.count(n) for n in lengths}
    rows, ranks = [], defaultdict(list)
    for length, rank, count, first, each, at in best_fit(runs, 20):
        for k in range(count):
            rows.append({"sequence_id": first + k // each, "offset": at + k % each * length, "length": length})
            ranks[length].append(rank + k)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in runs.items()}
    assert whole(rows, 20) == plain_best_fit(lengths, 20)


def test_pack(spark):
    tok = Tokenizer.from_file(BYTE)
    rows = pack(cut_pieces(frame(spark), BYTE, 0, 64), 64).collect()
    whole(rows, 64)
    pieces = defaultdict(list)
    for r in rows:
        if r["doc_id"] == 6:
            pieces[r["piece"]] = [r["start"], r["length"], r["ids_crc32"]]
    ids = np.array([*tok.encode("long " * 4000, add_special_tokens=False).ids, 0], "<u4")
    assert sum(n for _, n, _ in pieces.values()) == len(ids)
    assert all(n == 64 for k, (_, n, _) in pieces.items() if k)
    assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in pieces.values())
    assert pack(cut_pieces(frame(spark, []), BYTE, 0)).count() == 0


def test_pack_is_best_fit_in_blocks_and_keeps_other_columns(spark, monkeypatch):
    monkeypatch.setattr(packing, "LAST", 4)
    rng = np.random.default_rng(8)
    lengths = [*rng.integers(1, 65, 300).tolist(), *[7] * 200, *[40] * 100]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id bigint, length bigint")
    rows = rows.withColumns({"rank": F.lit("r"), "offset": F.lit("o"), "n": F.lit(1), "first": F.lit(2), "block": F.lit(3)})
    for block in (4096, 8):
        got = pack(rows, 64, block)
        assert got.columns == ["id", "length", "rank", "n", "first", "block", "sequence_id", "offset"]
        got = got.collect()
        assert sorted((r["id"], r["length"], r["rank"], r["n"]) for r in got) == [(i, n, "r", 1) for i, n in enumerate(lengths)]
        assert whole(got, 64) == plain_best_fit(lengths, 64)
    with pytest.raises(ValueError):
        pack(rows, 63)


def test_queries(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    counts = {r["doc_id"]: r for r in QUERIES["op1_token_counts"](spark, sf_dir).collect()}
    files = {r["doc_id"]: r for r in QUERIES["op7_token_files"](spark, sf_dir).collect()}
    start = 0
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        n = len(word.encode(d["text"], add_special_tokens=False).ids)
        assert (counts[d["doc_id"]]["n_tokens"], counts[d["doc_id"]]["over_limit"]) == (n, n > 2048)
        ids = np.array([*byte.encode(d["text"], add_special_tokens=False).ids, 2], "<u4")
        assert tuple(files[d["doc_id"]])[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    rows = QUERIES["op8_best_fit_packing"](spark, sf_dir).collect()
    assert sum(r["length"] for r in rows) == start
    pieces = defaultdict(dict)
    for r in rows:
        pieces[r["doc_id"]][r["piece"]] = r
    for d in docs:
        ids = np.array([*byte.encode(d["text"], add_special_tokens=False).ids, 0], "<u4")
        own = [pieces[d["doc_id"]][k] for k in range(len(pieces[d["doc_id"]]))]
        assert [r["length"] for r in own] == [(len(ids) - 1) % 2048 + 1, *[2048] * ((len(ids) - 1) // 2048)]
        assert [r["start"] for r in own] == [sum(r["length"] for r in own[:k]) for k in range(len(own))]
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    assert whole(rows, 2048) == plain_best_fit([r["length"] for r in rows], 2048)

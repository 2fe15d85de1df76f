"""Ranked lexical search: a max tree over document ranges per term, searched by branch and bound.

Tasks cut their documents into shards and keep, per shard, the postings of the
terms that queries ask for; counts over all documents (N, L, df) follow from
the shards. In a shard each term has a tree over ranges of documents: its
largest share of a score in each range of 4,096, of 512 and of 64 documents.
A query's bound on a range is the sum of its terms' maxima there, weighted. The
range of highest bound is opened first; the search ends when no range can hold
a document that ranks among the best. A range whose bound equals the last
score kept is opened too, as its document may have the smaller id.

Queries go out in blocks of a bounded number of terms, each against all
documents. What is shuffled is a few best documents per query and task.
"""

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from lodestream.llm.shared import discard, materialise, ship, small_batches

#: Bytes of a term: ASCII digits and letters, and all bytes of other characters.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20
#: Documents and postings of a shard; one of them is reached first.
SHARD_DOCS, SHARD_POSTINGS = 4096, 1 << 19
#: Documents in a tree's ranges, from the leaves up.
RANGES = (64, 512, 4096)
#: Terms of a block of queries, which the driver and every task hold.
BLOCK_TERMS = 1 << 18


def terms(text: bytes):
    """Yields lists of a text's terms, in order: maximal runs of term bytes, A-Z lower-cased."""
    folded, lo = text.translate(_FOLD), 0
    while lo < len(folded):
        hi = lo + PIECE
        if hi < len(folded):
            cut = folded.rfind(b" ", lo, hi)
            hi = cut + 1 if cut >= lo else (folded.find(b" ", hi) + 1 or len(folded))
        yield folded[lo:hi].split()
        lo = hi


def _query_terms(batches):
    for batch in batches:
        found = [sorted({t for piece in terms(x or b"") for t in piece}) for x in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.record_batch([batch.column("id"), pa.array(found, pa.list_(pa.binary()))], ["id", "terms"])


def _blocks(items: DataFrame, size: int):
    """Runs of (id, terms) with ``size`` terms at most, or one item."""
    block, held = [], 0
    for row in items.toLocalIterator():
        if block and held + len(row["terms"]) > size:
            yield block
            block, held = [], 0
        block.append((row["id"], [bytes(t) for t in row["terms"]]))
        held += len(row["terms"])
    if block:
        yield block


class _Shard:
    """Documents with at least one asked term, and their postings."""

    def __init__(self):
        self.ids, self.sizes, self.doc, self.term, self.tf = [], [], [], [], []
        self.with_terms = self.all_terms = 0

    def row(self, kind) -> pa.RecordBatch:
        doc, term, tf = (np.array(x, np.int32) for x in (self.doc, self.term, self.tf))
        order = np.lexsort((doc, term))
        asked, counts = np.unique(term, return_counts=True)
        lists = [(self.ids, kind), (self.sizes, pa.int64()), (asked, pa.int32()), (counts, pa.int32()), (doc[order], pa.int32()), (tf[order], pa.int32())]
        arrays = [pa.array([x.tolist() if isinstance(x, np.ndarray) else x], pa.list_(t)) for x, t in lists]
        return pa.record_batch([*arrays, pa.array([self.with_terms], pa.int64()), pa.array([self.all_terms], pa.int64())], ["ids", "sizes", "term", "count", "doc", "tf", "with_terms", "all_terms"])


def _index(asked: dict[bytes, int]):
    """Shards of the task's documents, with postings of the ``asked`` terms."""
    find = asked.get

    def run(batches):
        shard, kind = _Shard(), None
        for batch in batches:
            ids = batch.column("id")
            kind = ids.type
            for doc_id, text in zip(ids.to_pylist(), batch.column("text").cast(pa.binary())):
                n, found = 0, Counter()
                for piece in terms(text.as_py() or b""):
                    n += len(piece)
                    for t, c in Counter(piece).items():
                        at = find(t)
                        if at is not None:
                            found[at] += c
                shard.with_terms += n > 0
                shard.all_terms += n
                if found:
                    shard.doc.extend([len(shard.ids)] * len(found))
                    shard.term.extend(found.keys())
                    shard.tf.extend(found.values())
                    shard.ids.append(doc_id)
                    shard.sizes.append(n)
                if len(shard.ids) >= SHARD_DOCS or len(shard.doc) >= SHARD_POSTINGS:
                    yield shard.row(kind)
                    shard = _Shard()
        if shard.all_terms:
            yield shard.row(kind)

    return run


class Tree:
    """The postings of a shard with each level's maxima, as sorted (term, range) keys."""

    def __init__(self, asked: np.ndarray, counts: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int):
        self.asked = asked
        term = np.repeat(np.arange(len(asked)), counts)  # the shard's own number of a term
        self.levels = []  # (documents of a range, ranges, keys, values), documents themselves first
        keys, values = term * docs + doc, impact
        self.levels.append((1, docs, keys, values))
        for size in RANGES:
            ranges = -(-docs // size)
            keys = term * ranges + doc // size
            heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            self.levels.append((size, ranges, keys[heads], np.maximum.reduceat(impact, heads)))

    def bounds(self, own: np.ndarray, weights: np.ndarray, level: int, lo: int, hi: int) -> np.ndarray:
        """Sums over a query's terms (``own``: the shard's numbers) for the ranges lo to hi of a level."""
        _, ranges, keys, values = self.levels[level]
        start, end = np.searchsorted(keys, own * ranges + lo), np.searchsorted(keys, own * ranges + hi)
        n = end - start
        at = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        total = np.zeros(hi - lo, np.int64)
        np.add.at(total, keys[at] % ranges - lo, np.repeat(weights, n) * values[at])
        return total


def _better(a):
    """Order of (score, id): the higher score, then the smaller id, none last."""
    return (-a[0], a[1] is None, a[1] or 0)


def best_first(tree: Tree, own: np.ndarray, weights: np.ndarray, ids: list, k: int, best: list) -> list:
    """``best``, (score, id) in rank order, with the shard's documents taken in; k at most."""
    top = len(tree.levels) - 1
    _, ranges, _, _ = tree.levels[top]
    heap = [(-int(b), top, i) for i, b in enumerate(tree.bounds(own, weights, top, 0, ranges)) if b > 0]
    heapq.heapify(heap)
    while heap:
        bound, level, i = heapq.heappop(heap)
        least = best[-1][0] if len(best) == k else 1  # scores have to be above 0
        if -bound < least:
            break
        size, below = tree.levels[level][0], tree.levels[level - 1]
        lo = i * size // below[0]
        hi = min(lo + size // below[0], below[1])
        sums = tree.bounds(own, weights, level - 1, lo, hi)
        worth = np.flatnonzero(sums >= least)
        if level > 1:
            for j in worth.tolist():
                heapq.heappush(heap, (-int(sums[j]), level - 1, lo + j))
        elif len(worth):
            best = heapq.nsmallest(k, best + [(int(sums[j]), ids[lo + j]) for j in worth.tolist()], key=_better)
    return best


def impacts(tf: np.ndarray, sizes: np.ndarray, docs: int, total: int) -> np.ndarray:
    """A posting's share of a score before its term's weight; ``sizes``: the terms of its document."""
    if 90 * int(sizes.max(initial=0)) * docs >= 1 << 63:
        scaled = np.array([90 * int(n) * docs // total for n in sizes.tolist()], np.int64)
    else:
        scaled = 90 * sizes * docs // total
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * (10 + scaled))


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _search(block: list, numbers: dict[bytes, int], weights: np.ndarray, docs: int, total: int, k: int, item_kind, doc_kind):
    """The k best documents of a task for every item of the block."""
    wanted = [np.array(sorted(numbers[t] for t in ts), np.int64) for _, ts in block]

    def run(batches):
        best = [[] for _ in block]
        for batch in batches:
            for row in range(batch.num_rows):
                sizes, asked, counts, doc, tf = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("sizes", "term", "count", "doc", "tf"))
                if not len(doc):
                    continue
                ids = batch.column("ids")[row].values.to_pylist()
                doc, asked = doc.astype(np.int64), asked.astype(np.int64)
                tree = Tree(asked, counts, doc, impacts(tf, sizes[doc], docs, total), len(ids))
                for i, want in enumerate(wanted):
                    own = np.searchsorted(asked, want)
                    own = own[(own < len(asked)) & (asked[np.minimum(own, len(asked) - 1)] == want)]
                    if len(own):
                        best[i] = best_first(tree, own, weights[asked[own]], ids, k, best[i])
        rows = [(i, block[i][0], doc_id, score) for i, found in enumerate(best) for score, doc_id in found]
        if rows:
            item, item_id, doc_id, score = zip(*rows)
            yield pa.record_batch([pa.array(item, pa.int32()), pa.array(item_id, item_kind), pa.array(doc_id, doc_kind), pa.array(score, pa.int64())], ["item", "item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Per item its k documents of highest score above 0: item id, rank, doc id, score.

    Both tables have an integer id and a text; every other column is left
    alone, whatever its name. A term's weight is floor(1000 ln((2N+2)/(2df+1))),
    its share of a score weight * ((10^9 tf) div (1000 tf + 8 m)), where m = 10
    + (90 n N) div L for a document of n terms; N counts documents with a term,
    L all their terms. Equal scores rank by ascending id, a null id last.

    A null or empty text has no terms: as a document it is in no result and not
    in N, as an item it gives no row. Every row is a document or an item of its
    own, so repeated ones are ranked each. A table without rows gives none.
    Long texts are cut into terms by a megabyte at a time; what is held of one
    is its asked terms. A task holds one shard and k documents per item.
    """
    spark = docs.sparkSession
    ship(spark)
    queries = items.select(F.col(item_id).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    queries = materialise(queries.mapInArrow(_query_terms, "id bigint, terms array<binary>"), "query-terms")
    corpus = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = lambda name, kind: (name, ArrayType(kind))
    shards_schema = StructType()
    for name, kind in [*(whole(c, LongType()) for c in ("ids", "sizes")), *(whole(c, IntegerType()) for c in ("term", "count", "doc", "tf")), ("with_terms", LongType()), ("all_terms", LongType())]:
        shards_schema.add(name, kind)
    out = StructType().add("item", IntegerType()).add("item_id", LongType()).add("doc_id", LongType()).add("score", LongType())
    found = spark.createDataFrame([], out.add("block", IntegerType()))
    for at, block in enumerate(_blocks(queries, block_terms)):
        numbers = {t: i for i, t in enumerate(sorted({t for _, ts in block for t in ts}))}
        if not numbers:
            continue
        with small_batches(spark, 1000):
            shards = materialise(corpus.mapInArrow(_index(numbers), shards_schema), "shards")
        n, total = shards.agg(F.coalesce(F.sum("with_terms"), F.lit(0)), F.coalesce(F.sum("all_terms"), F.lit(0))).first()
        if total:
            counts = shards.select(F.explode(F.arrays_zip("term", "count")).alias("x")).groupBy("x.term").agg(F.sum("x.count").alias("df"))
            weights = np.zeros(len(numbers), np.int64)
            for row in counts.collect():  # a row per term of the block at most
                weights[row["term"]] = weight(n, row["df"])
            job = _search(block, numbers, weights, n, total, k, pa.int64(), pa.int64())
            with small_batches(spark, 1):
                hits = materialise(shards.mapInArrow(job, StructType(out.fields[:4])), "hits")
            found = found.unionByName(hits.withColumn("block", F.lit(at)))
        discard(shards)
    discard(queries)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
    return ranked.select(F.col("item_id").alias(item_id), "rank", F.col("doc_id").alias(doc_id), "score")

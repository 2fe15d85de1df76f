"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

1. Signatures of every text; texts with equal shingle sets become one node.
2. Nodes that share a band key are in a bucket. Each bucket's pivot, the member
   with the most company over all buckets, is compared with every member.
3. Nodes of buckets that are in several components yet are held against each
   other by their rarest shingles: at the threshold, two sets share one of the
   first few (a share of 1 - threshold of the set) in order of rarity. What
   they have in common with a page's many others, as boilerplate, is never
   among these, so pages that share only that don't meet. The nodes of one rare
   shingle are dealt into cells of two blocks, by their sketches alone. Of the
   pairs across components whose sketches are near, a cell gives a forest, with
   fewer pairs than it has nodes. The trees that these forests grow into over
   all cells hold every such pair, so a node's set goes to the cells of its tree
   once or per block, not once per rare shingle. There whole sets are compared
   across components; a cell merges components as it links them, and gives a
   link only where it merged two.
Links are confirmed on whole shingle sets, and components are taken over all.
Pairs already connected are never formed, so a large group of copies costs its
size. Keys that many rows have are joined where the rows are.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.components import components
from lodestream.llm.shared import HOT, discard, join_dealt, materialise, ship
from lodestream.llm.shingles import Circulant, mix, shingle_sets

#: 26 bands of 5: a pair at similarity 0.85 shares none in 3e-7 of cases.
BANDS, ROWS = 26, 5
#: Members of a block, and shingles a member on average; a cell holds two blocks.
BLOCK, LONG = 256, 2048
#: Coordinates, a byte of each, by which pairs are screened before their sets are compared.
SKETCH = 512
#: A pair at the threshold agrees in fewer coordinates by so many standard deviations in 1e-9 of cases, if coordinates are independent.
DEVIATIONS = 6

SIGNED = "doc_id bigint, h bigint, n_shingles bigint, set_key binary, bands array<bigint>"


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, h, n_shingles, set_key, bands) of each row; h hashes the text, set_key is 128 bits over the set."""
    ship(docs.sparkSession)

    def run(batches):
        circulant = Circulant(bands, rows)
        for batch in batches:
            sets = list(shingle_sets(batch.column("body")))
            some = [i for i, s in enumerate(sets) if len(s)]
            keys, names = [None] * len(sets), [None] * len(sets)
            if some:
                signatures = circulant.signatures([sets[i] for i in some])
                for i, k in zip(some, circulant.band_keys(signatures)):
                    keys[i], s = k, sets[i]
                    names[i] = np.array([mix(s).sum(), mix(s * np.uint64(0xA0761D6478BD642F)).sum() + np.uint64(len(s))]).tobytes()
            yield pa.record_batch(
                [batch.column("id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "h", "n_shingles", "set_key", "bands"],
            )

    body = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(body).alias("h"), body.alias("body")).mapInArrow(run, SIGNED)


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles, sketch) of the documents that stand for nodes; the sketch is the low byte of each coordinate."""

    def run(batches):
        circulant = Circulant(SKETCH, 1)
        for batch in batches:
            sets = list(shingle_sets(batch.column("body")))
            ids = batch.column("id").filter(pa.array([len(s) > 0 for s in sets], pa.bool_()))
            sets = [s for s in sets if len(s)]
            sketches = circulant.signatures(sets).astype(np.uint8)
            yield pa.record_batch([ids, pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([g.tobytes() for g in sketches], pa.binary())], ["node", "shingles", "sketch"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    # merged at every size: the list of nodes grows with the input and is not to be broadcast
    return rows.join(nodes.select(F.col("node").alias("id")).hint("merge"), "id", "left_semi").mapInArrow(run, "node bigint, shingles binary, sketch binary").distinct()


def _agree(x: np.ndarray, y: np.ndarray, threshold: int, slack: float) -> np.ndarray:
    return (x == y).sum(1) >= (threshold / 100 - slack) * x.shape[1]


def _sketch_array(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _screen(pairs: DataFrame, sets: DataFrame, threshold: int, slack: float) -> DataFrame:
    """Of pairs (a, b), those whose sketches leave the threshold within reach."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keep = _agree(_sketch_array(batch.column("x")), _sketch_array(batch.column("y")), threshold, slack)
                yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a")
    return first.join(sets.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _reach(s: np.ndarray, t: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets reach the threshold, in hundredths."""
    if len(s) > len(t):
        s, t = t, s
    common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
    return 100 * common >= threshold * (len(s) + len(t) - common)


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b), those whose whole sets reach the threshold, in hundredths."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                keep.append(_reach(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold))
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    return first.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _rare(apart: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(node, n_shingles, key): each node's first shingles by rarity among the nodes, as many as decide, without those of a single node."""

    def run(batches):
        for batch in batches:
            for node, raw in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist()):
                keys = np.frombuffer(raw, np.int64)
                yield pa.record_batch([pa.array(np.full(len(keys), node)), pa.array(np.full(len(keys), len(keys))), pa.array(keys)], ["node", "size", "key"])

    spread = materialise(sets.join(apart.hint("merge"), "node", "left_semi").select("node", "shingles").mapInArrow(run, "node bigint, size bigint, key bigint"), "apart")
    often = materialise(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    met = join_dealt(spread, often, "key", _hot(often))
    own = met.groupBy("node").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
    # those of a single node come first
    first = f"size - (size * {threshold} + 99) div 100 + 1 - (size - size(keys))"
    kept = own.where(f"{first} > 0").select("node", F.col("size").alias("n_shingles"), F.explode(F.expr(f"slice(keys, 1, cast({first} as int))")).alias("k"))
    rare = materialise(kept.select("node", "n_shingles", "k.key"), "rare")
    discard(spread, often)
    return rare


def _hot(sizes: DataFrame) -> DataFrame:
    """The keys, of (key, n), that more than a thousandth of the rows have: fewer than a thousand."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    return sizes.where(F.col("n") * HOT > total).select("key")


def _cells(members: DataFrame, threshold: int, slack: float, block: int, whole: bool) -> DataFrame:
    """Pairs (a, b) across components of members (node, component, sketch[, shingles]) of a key.

    With ``whole`` sets these are links, as many as connect what is linked;
    else pairs of near sketches, as many as connect the nodes of all such pairs.
    A key's largest component, ``main``, is connected in itself: its ``m`` of
    ``n`` members meet only the others, never each other. Blocks are counted by
    members and, of whole sets, by shingles, so a key of few but long sets has
    several too. A key of one block's size is one cell.
    """
    blocks = lambda n, size: F.ceil(F.greatest(n / block, size / (block * LONG)) if whole else n / block).cast("int")
    place = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    one = blocks(F.col("n"), F.col("size")) <= 1
    inside = (F.col("component") == F.col("main")) & ~F.col("one")
    dealt = members.withColumn("one", one)
    dealt = dealt.withColumn("outer", F.when(F.col("one"), 1).otherwise(blocks(F.col("n") - F.col("m"), F.col("size") - F.col("main_size"))))
    dealt = dealt.withColumn("inner", F.when(F.col("one"), 0).otherwise(blocks(F.col("m"), F.col("main_size"))))
    dealt = dealt.withColumn("blk", F.when(inside, F.col("outer") + place("inner")).otherwise(place("outer")))
    met = F.sequence(F.lit(0), F.when(inside, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1)
    own = ["node", "component", "sketch", *(["shingles"] if whole else ["n_shingles"])]
    cells = dealt.select("*", F.explode(met).alias("other")).select("key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", *own)

    def run(key, table):
        key = tuple(k.as_py() for k in key)
        node, component, blk = (table.column(c).to_numpy() for c in ("node", "component", "blk"))
        if whole:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
            size, tree = np.array([len(s) for s in sets]), component.copy()
        else:
            size, tree = table.column("n_shingles").to_numpy(), np.arange(len(node))
        sketch = _sketch_array(table.column("sketch"))
        left = np.flatnonzero(blk == key[1])
        right = np.flatnonzero(blk == key[2])
        a, b = [], []
        for p in left:
            q = right[(component[right] != component[p]) & (tree[right] != tree[p]) & (node[right] > node[p] if key[1] == key[2] else True)]
            q = q[(100 * np.minimum(size[q], size[p]) >= threshold * np.maximum(size[q], size[p]))]
            if len(q):
                for x in q[_agree(sketch[q], sketch[p][None, :], threshold, slack)]:
                    if tree[x] != tree[p] and (not whole or _reach(sets[p], sets[x], threshold)):
                        tree[tree == tree[x]] = tree[p]
                        a.append(min(node[p], node[x]))
                        b.append(max(node[p], node[x]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def _split(members: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (node, n_shingles, key) of keys with several components, with component, n, size, m, main and main_size (see ``_cells``); and a table to discard after use."""
    placed = members.select("node", "n_shingles", "key").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("size"))
    top = F.max(F.struct("m", "component", "size")).alias("top")
    several = materialise(sizes.groupBy("key").agg(top, F.count(F.lit(1)).alias("parts"), F.sum("m").alias("n"), F.sum("size").alias("size")).where("parts > 1"), "split")
    main = [F.col("top.m").alias("m"), F.col("top.component").alias("main"), F.col("top.size").alias("main_size")]
    return join_dealt(placed, several.select("key", "n", "size", *main), "key", _hot(several)), several


def _labelled(docs: DataFrame, threshold: int, id_col: str, text_col: str, bands: int, rows: int, block: int, deviations: float | None) -> DataFrame:
    slack = 1.0 if deviations is None else deviations * (threshold * (100 - threshold) / SKETCH) ** 0.5 / 100
    signed = materialise(sign(docs, id_col, text_col, bands, rows), "signed")
    named = signed.where("n_shingles > 0")
    nodes = materialise(named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("n")), "nodes")
    heads = nodes.where("node is not null").select("node", "set_key")
    full = named.withColumnRenamed("doc_id", "node").join(heads.hint("merge"), ["node", "set_key"], "left_semi").dropDuplicates(["node", "set_key"])
    spread = materialise(full.select("node", "n_shingles", F.explode("bands").alias("key")), "bands")
    shared = materialise(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    hot = materialise(_hot(shared), "hot")
    members = materialise(join_dealt(spread, shared, "key", hot), "members")

    score = members.groupBy("node").agg(F.sum("n").alias("score"))
    sets = materialise(_sets(docs, score, id_col, text_col), "sets")
    seated = members.join(score, "node")
    pivots = materialise(seated.groupBy("key").agg(F.max(F.struct("score", -F.col("node"), "n_shingles")).alias("p")).select("key", (-F.col("p.col2")).alias("pivot"), F.col("p.n_shingles").alias("pn")), "pivots")
    sized = 100 * F.least("n_shingles", "pn") >= threshold * F.greatest("n_shingles", "pn")
    pairs = join_dealt(members, pivots, "key", hot).where(F.col("node") != F.col("pivot")).where(sized).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = materialise(_confirm(_screen(pairs, sets, threshold, slack), sets, threshold), "links")
    found = components(links)

    divided, several = _split(members.where("n > 2"), found)
    apart = materialise(divided.select("node").distinct(), "apart")
    discard(spread, shared, hot, members, pivots, links, several)
    rare = _rare(apart, sets, threshold)
    met, several = _split(rare, found)
    near = materialise(_cells(met.join(sets.select("node", "sketch"), "node"), threshold, slack, block, whole=False), "near")
    discard(apart, rare, several)
    if not near.isEmpty():
        trees = components(near).select("node", F.col("component").alias("key"))
        met, several = _split(trees.join(nodes.select("node", "n_shingles"), "node"), found)
        more = materialise(_cells(met.join(sets, "node"), threshold, slack, block, whole=True), "links")
        discard(several)
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        discard(more)
    discard(near)
    labels = materialise(nodes.select("set_key", "node", "n").join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"), "n"), "labels")
    discard(nodes, sets)
    slim = signed.select("doc_id", "h", "n_shingles", F.col("set_key").alias("key"))
    placed = join_dealt(slim.where("n_shingles > 0"), labels.select(F.col("set_key").alias("key"), "component"), "key", _hot(labels.select(F.col("set_key").alias("key"), "n")))
    out = placed.unionByName(slim.where("n_shingles = 0").withColumn("component", F.col("doc_id")))
    return out.select("doc_id", "h", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.col("component").isNull()).alias("kept"))


def near_duplicates(
    docs: DataFrame,
    threshold: int = 85,
    id_col: str = "doc_id",
    text_col: str = "text",
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
    deviations: float | None = DEVIATIONS,
) -> DataFrame:
    """A row (doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Two documents are linked if 100 * common >= threshold * united shingles.
    component_id is the smallest id reachable; kept holds where it is the own
    id. A null text, or one without words, has no shingles and no links. Rows
    with one id are one document. Null ids take part through texts with equal
    shingles that have an id; else they stand alone, with a null component, and
    are kept. An empty table gives an empty one. Whole texts are shingled; a task
    needs some 40 bytes for each byte of the longest one. Pairs are screened by sketches
    before their sets are compared; ``deviations=None`` turns that off.
    """
    return _labelled(docs, threshold, id_col, text_col, bands, rows, block, deviations).drop("h")


def drop_near_duplicates(
    docs: DataFrame, threshold: int = 85, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, deviations: float | None = DEVIATIONS
) -> DataFrame:
    """The kept rows of ``docs`` in all their columns, of which none may be named __key; rows alike in id and text stay once."""
    key = lambda i, h: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), h)
    kept = _labelled(docs, threshold, id_col, text_col, bands, rows, block, deviations).where("kept").select(key(F.col("doc_id"), F.col("h")).alias("__key")).distinct().hint("merge")
    own = key(F.col(id_col).cast("bigint"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return docs.withColumn("__key", own).join(kept, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")

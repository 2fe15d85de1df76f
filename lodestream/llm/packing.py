"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Bulk-synchronous best fit, longest documents first. Documents of one length are
alike to a packer, as are sequences with one gap, so both are tables of runs,
sorted by size. A superstep takes the unplaced runs of a range of lengths (each
range halves the lengths that are left, until few are) and the gaps, both in order of size, and
sweeps over both: every run goes to its successors, the smallest gaps that hold
it, in bulk. It writes what was matched and the gaps as they are then, for the
next one. There are at most ``capacity`` lengths and as many gaps, so a sweep
reads as few rows however many documents there are. Conflicts between documents
of a run are settled by rank: ranks are counted within tasks and joined by
prefix sums, and matches hold ranges of ranks that documents are joined to in
blocks, so no run, however large, meets in one task.
"""

import bisect
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.llm.encode import encoder
from lodestream.llm.shared import materialise, ship

#: Lengths of the last superstep at most.
LAST = 64
#: Ranks of a length that are placed together.
BLOCK = 4096
RANK, BLOCK_OF = "__rank", "__block"
RUN, GAP, MATCH, OPENED = range(4)
STATE_NAMES = ["kind", "length", "n", "first", "rank", "each", "at"]
STATE = "kind int, " + ", ".join(f"{c} bigint" for c in STATE_NAMES[1:])
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids: (doc_id, piece, start, length, ids_crc32).

    A document is its ids and then ``end_id``; a null text is empty. Only longer
    ones are cut, the first piece being the shorter one. No shuffle.
    """
    ship(docs.sparkSession)

    def cut(batches):
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc, b in zip(batch.column("id").to_pylist(), enc.encode_column(batch.column("body"))):
                b += end
                n, lo, k = len(b) // 4, 0, 0
                while lo < n:
                    size = (n - 1) % capacity + 1 if not lo else capacity
                    out.append((doc, k, lo, size, zlib.crc32(b[4 * lo : 4 * (lo + size)])))
                    lo, k = lo + size, k + 1
            cols = list(zip(*out)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return rows.mapInArrow(cut, PIECES)


def sweep(runs: dict[int, int], free: list[tuple[int, int, int]], opened: int, capacity: int) -> tuple[list[tuple], list[tuple[int, int, int]], int]:
    """Places runs (documents by length) in gaps and new sequences: (matches, gaps, sequences opened so far).

    Longest runs first. A run goes to its successor gaps; a sequence takes items
    while they fit, as its gap stays the tightest. With no gap left that holds
    the run, new sequences open. Gaps are (size, first sequence, sequences), a
    match is (length, first rank, count, first sequence, items a sequence, offset).
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # the gaps there are, ascending
    out: list[tuple] = []

    def put(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                bisect.insort(sizes, gap)
                gaps[gap] = []
            gaps[gap].append((first, count))

    for gap in sorted(free):
        put(*gap)
    for length in sorted(runs, reverse=True):
        rank, left = 0, runs[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                each = capacity // length
                gap, first, count = capacity, opened, -(-left // each)
                opened += count
            each = gap // length
            full = min(count, left // each)
            if full:
                out.append((length, rank, full * each, first, each, capacity - gap))
                put(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = left if full < count else 0  # fewer than fill one sequence
            if rest:
                out.append((length, rank, rest, first + full, rest, capacity - gap))
                put(gap - rest * length, first + full, 1)
                rank, left, full = rank + rest, 0, full + 1
            put(gap, first + full, count - full)
    return out, [(gap, *run) for gap in sizes for run in gaps[gap]], opened


def ranges(capacity: int, last: int | None = None):
    """(low, high) of the lengths of each superstep, longest first."""
    high = capacity
    while high:
        low = high // 2 + 1 if high > (last or LAST) else 1
        yield low, high
        high = low - 1


def match_runs(runs: DataFrame, capacity: int) -> DataFrame:
    """The matches (length, lo, count, first, each, at) of runs (length, n); only the number of opened sequences reaches the driver."""
    spark = runs.sparkSession
    gaps = spark.createDataFrame([], STATE)
    done, opened = [], 0
    least, most = runs.agg(F.min("length"), F.max("length")).first()
    for low, high in ranges(capacity):
        if least is None or high < least or low > most:
            continue

        def step(batches, opened=opened):
            some, free = {}, []
            for batch in batches:
                for r in batch.to_pylist():
                    if r["kind"] == RUN:
                        some[r["length"]] = r["n"]
                    else:
                        free.append((r["length"], r["first"], r["n"]))
            matches, left, total = sweep(some, free, opened, capacity)
            rows = [(MATCH, length, count, first, rank, each, at) for length, rank, count, first, each, at in matches]
            rows += [(GAP, gap, n, first, 0, 0, 0) for gap, first, n in left] + [(OPENED, 0, total, 0, 0, 0, 0)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(),) + (pa.int64(),) * 6)], STATE_NAMES)

        zero = [F.lit(0).cast("bigint").alias(c) for c in STATE_NAMES[3:]]
        mine = runs.where(F.col("length").between(low, high)).select(F.lit(RUN).alias("kind"), "length", "n", *zero)
        swept = materialise(mine.union(gaps).coalesce(1).sortWithinPartitions("kind", "length", "first").mapInArrow(step, STATE), "sweep")
        opened = swept.where(F.col("kind") == OPENED).first()["n"]
        done.append(swept.where(F.col("kind") == MATCH))
        gaps = swept.where(F.col("kind") == GAP)
    out = spark.createDataFrame([], STATE)
    for part in done:
        out = out.union(part)
    return out.select("length", F.col("rank").alias("lo"), F.col("n").alias("count"), "first", "each", "at")


def _ranked(pieces: DataFrame) -> DataFrame:
    """Adds a rank: every value from 0 on once within each length."""

    def local(batches):
        task, seen = uuid.uuid4().hex, np.zeros(0, np.int64)
        for batch in batches:
            n = batch.column("length").to_numpy(zero_copy_only=False)
            order = np.argsort(n, kind="stable")
            s = n[order]
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
            counts = np.diff(np.r_[starts, len(s)])
            if len(s) and s[-1] >= len(seen):
                seen = np.r_[seen, np.zeros(int(s[-1]) + 1 - len(seen), np.int64)]
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(s)) - np.repeat(starts, counts) + seen[s]
            if len(s):
                seen[s[starts]] += counts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * len(n), pa.string()), pa.array(rank)], [*batch.schema.names, "__task", "__local"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", __task string, __local bigint"
    rows = materialise(pieces.mapInArrow(local, schema), "pieces")
    before = W.partitionBy("length").orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
    bases = rows.groupBy("length", "__task").agg(F.count(F.lit(1)).alias("n")).select("length", "__task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    return rows.join(bases, ["length", "__task"]).select(*pieces.columns, (F.col("__base") + F.col("__local")).alias(RANK))


def pack(pieces: DataFrame, capacity: int = 2048, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to pieces, each of 1 to ``capacity`` ids; columns of these names are replaced.

    Sequences are gapless from 0. All rows are packed, repeated ones too; an
    empty table gives an empty one. The runs, the gaps and the matches are
    tables; documents move once, to meet the matches of their length's ranks.
    """
    ship(pieces.sparkSession)
    ranked = materialise(_ranked(pieces.drop("sequence_id", "offset")), "ranked")
    runs = materialise(ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "runs")
    odd = F.col("length").isNull() | ~F.col("length").between(1, capacity)
    if not runs.where(odd).isEmpty():
        raise ValueError("a piece is empty or longer than a sequence")
    matches = match_runs(runs, capacity)
    of = lambda x: F.floor(x / block)
    spread = matches.select("*", F.explode(F.sequence(of(F.col("lo")), of(F.col("lo") + F.col("count") - 1))).alias("block"))
    keep = [f for f in ranked.schema.fields if f.name != RANK]

    def place(key, left, right):
        """A block of a length's documents against the matches of its ranks."""
        right = right.sort_by("lo")
        lo, first, each, at = (right.column(c).to_numpy() for c in ("lo", "first", "each", "at"))
        rank = left.column(RANK).to_numpy()
        m = np.searchsorted(lo, rank, side="right") - 1
        k = rank - lo[m]
        out = left.drop_columns([RANK, BLOCK_OF])
        return out.append_column("sequence_id", pa.array(first[m] + k // each[m])).append_column("offset", pa.array(at[m] + k % each[m] * key[0].as_py()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", sequence_id bigint, offset bigint"
    rows = ranked.withColumn(BLOCK_OF, of(F.col(RANK))).groupBy("length", BLOCK_OF)
    return rows.cogroup(spread.groupBy("length", "block")).applyInArrow(place, schema)

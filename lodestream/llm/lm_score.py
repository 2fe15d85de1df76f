"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is a sequence of lower-cased words and an end. A word that is in the
dictionary is one symbol; any other is an escape and then its bytes, each a
symbol, with an end of its own, or, if the text had it before, a mark and which
one it is. Where the model learns, a word of a single text isn't in the
dictionary, as it would be new if that text were left out. Symbols are coded in bits by a tree that halves
the training counts of the symbols in the order of their bytes, so a symbol of
probability p takes about log2(1/p) bits and words that start alike share bits.

Each bit is predicted in the text, at its place, from counts of that bit in
several contexts: none, the word before, the two words before, the last short
words (which tell the language) and the text so far, or, in a spelled word, its
bytes so far.
A context with the node of the tree is hashed into a table. The predictions' log
odds are mixed by weights that a gate picks by the bit's depth and by how often
two of the contexts were seen; the weights are learnt online, one step after the
other, and a table over the mixed odds, learnt in the same passes, refines them.
Bits below ``DEPTH`` go by the training counts alone.

Token counts grow with the input: they are in Spark, and joined for what is not
in the dictionary. What is sent to tasks is bounded by ``HEAD`` and the tables'
sizes. Everything is counted over all training texts, and the weights and the
refining table are learnt from all of them: texts are dealt to shards by hash,
as many as the texts ask for, and the weights of the shards are averaged. Counts
and what is summed of the shards are integers, so that scores do not depend on
how Spark deals the rows.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.shared import materialise, ship, small_batches
from lodestream.llm.shingles import _LOWER, chunks, mix, text_buffers, word_hashes, word_spans

#: The end of a text as a token, and what stands before its first one.
END, START = np.int64(0x5E17_0F7E_0D0C), np.uint64(0x2B99_2DDF_A232)
#: Most words of the dictionary, the most frequent ones of training texts.
HEAD = 1 << 17
#: Bits of a symbol that are mixed.
DEPTH = 12
#: Longest short word, in bytes.
SHORT = 3
#: Contexts of a word's bits and of a spelled byte's bits, beside the node alone; slots of each one's table.
CONTEXTS, SLOT_BITS = (4, 5), (19, 18)
#: About how many training texts a shard has that weights are learnt in, the fewest shards, and symbols of a step.
SHARD_TEXTS, SHARDS, STEP_ROWS = 4096, 8, 2048
#: Symbols whose order in their texts is found at once.
PASSES = 8192
#: Weights are summed as integers, in parts of a unit.
UNIT = 1 << 32
RATE, LEVELS, SEEN = 0.05, 24, 4
GATES = DEPTH * SEEN * SEEN
BLOCK = 1 << 14
#: Bytes of text that are worked on at once; a longer text is by itself.
CHUNK = 1 << 18
#: Tokens and, apart, bits whose slots a task holds before it counts them; bits after which it gives its counts, so that they fit 32 bits.
HELD, HELD_BITS, FULL = 1_000_000, 4_000_000, 1 << 31
#: Pieces that a block's counts are first summed in, so that no task gets those of all tasks.
SALTS = 16
TABLES = "salt int, tree int, context int, block int, n binary"
#: Brings to the top what slots are of a context's hash and a node's; nodes that differ in low bits have slots side by side.
_MULT = np.uint64(1 << 32 - max(SLOT_BITS))
#: Depths of a tree whose nodes have slots side by side, 64 bytes of codes at most.
NEAR = 5


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 5; a null id is an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A table's slots of hashes; that of two hashes' exclusive or is their slots' exclusive or."""
    return (hashes * _MULT >> np.uint64(64 - bits)).astype(np.int32)


class Tree:
    """A binary code over weighted symbols in a given order: every node halves the weight of its symbols."""

    def __init__(self, weights: np.ndarray, depth: int = DEPTH, slot_bits: int = max(SLOT_BITS)):
        n = len(weights)
        total = np.r_[0, np.cumsum(weights.astype(np.int64))]
        self.node = np.zeros((depth, n), np.uint16)  # by depth, the node that a symbol is under
        self.bit = np.zeros((depth, n), np.uint8)
        self.depth = np.zeros(n, np.int8)
        lo, hi, made, odds = np.array([0]), np.array([n]), 0, []
        group, within, groups, hashes = np.array([0]), np.array([1]), 0, []  # nodes below one of every NEAR depths, and which of these one is
        for d in range(depth):
            whole = hi - lo > 1
            lo, hi, group, within = lo[whole], hi[whole], group[whole], within[whole]
            if not len(lo):
                break
            if d % NEAR == 0:
                group, within = groups + np.arange(len(lo)), np.ones(len(lo), np.int64)
                groups += len(lo)
            hashes.append(group * 0x5851F42D << NEAR | within)
            group, within = np.repeat(group, 2), (within[:, None] * 2 + [0, 1]).ravel()
            cut = np.clip(np.searchsorted(total, (total[lo] + total[hi]) / 2), lo + 1, hi - 1)
            odds.append(np.log((total[hi] - total[cut] + 0.4) / (total[cut] - total[lo] + 0.4)))
            size = hi - lo
            at = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            self.node[d, at] = made + np.repeat(np.arange(len(lo)), size)
            self.bit[d, at] = at >= np.repeat(cut, size)
            self.depth[at] = d + 1
            made += len(lo)
            lo, hi = np.sort(np.r_[lo, cut]), np.sort(np.r_[cut, hi])
        self.odds = np.concatenate([np.zeros(0), *odds]).astype(np.float32)
        self.one = 1 / (1 + np.exp(-self.odds))
        # what is below the last bit: a symbol's share of those that are still possible
        group = np.zeros(n, np.int64)
        for d in range(depth):
            group = np.where(self.depth > d, group * 2 + self.bit[d], group)
        key = group * (depth + 1) + self.depth
        _, of = np.unique(key, return_inverse=True)
        self.rest = np.log(weights / np.bincount(of, weights=weights)[of]) if n else np.zeros(0)
        # no two nodes have the same slot after one context
        self.hash = np.concatenate([np.zeros(0, np.int64), *hashes]).astype(np.uint64) << np.uint64(32 + max(SLOT_BITS) - slot_bits)
        self.code = np.ascontiguousarray((self.node << 1 | self.bit).T)  # a symbol's nodes and bits side by side
        # by node and bit: the slot after a context of hash 0, the odds, the bit's share by the training counts
        self.slot, self.odds_of = np.repeat(slots(self.hash, slot_bits), 2), np.repeat(self.odds, 2)
        self.share = np.stack([1 - self.one, self.one], 1).ravel().astype(np.float32)


@dataclass
class Coder:
    """The dictionary: sorted hashes with each one's symbol, training count and number of texts, and the trees of words and bytes.

    ``slots``: the place of a slot's most frequent word, ``bounds``: of its first one.
    The symbol after the last is the escape, the next one marks a word that was escaped before.
    """

    hashes: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray
    texts: np.ndarray
    trees: tuple[Tree, Tree]
    slots: np.ndarray
    bounds: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of hashes; the most frequent word of a slot is found at once."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = self.slots[_slot(h)].astype(np.int64)
        hit = self.hashes[at] == h
        rest = np.flatnonzero(~hit)
        slot = _slot(h[rest])
        first, size = self.bounds.take(slot), self.bounds.take(slot + 1)
        size -= first
        k, few = 0, np.flatnonzero(size > 1)  # of one word, it was that one or none
        while len(few):
            rest, first, size = rest.take(few), first.take(few), size.take(few)
            found = first + k
            same = self.hashes.take(found) == h.take(rest)
            at[rest[same]], hit[rest[same]] = found[same], True
            k += 1
            few = np.flatnonzero(~same & (size > k))
        return at, hit


def _slot(h: np.ndarray) -> np.ndarray:
    """The first bits of hashes, so that words of a slot are neighbours in order."""
    return (h >> 46) + (1 << 17)


def make_coder(words: list[bytes], hashes: np.ndarray, counts: np.ndarray, texts: np.ndarray, escaped: int, letters: np.ndarray, once: int, twice: int) -> Coder:
    """The coder of a dictionary; ``escaped``: training tokens beside it, ``letters``: counts of the bytes and, last, of the ends of spelled words.

    Of each word's count a share is left for new ones, as by the numbers of
    words of one text and of two.
    """
    share = round(256 * (once + 1) / (once + 2 * twice + 2))
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    symbol = np.empty(len(words), np.int64)
    symbol[order] = np.arange(len(words))
    at = np.argsort(hashes)
    new = 256 * escaped + share * len(words) + 256
    weights = np.r_[np.maximum(256 * counts[order] - share, 1), new, new // 8]
    slots, often = np.zeros(1 << 18, np.int32), np.argsort(counts[at], kind="stable")
    slots[_slot(hashes[at][often])] = often
    bounds = np.searchsorted(_slot(hashes[at]), np.arange(len(slots) + 1))
    return Coder(hashes[at], symbol[at], counts[at], texts[at], (Tree(weights), Tree(letters + 1, slot_bits=SLOT_BITS[1])), slots, bounds)


def _words(column):
    """Yields (first row, bytes, starts, ends, rows of words, hashes, rows) over an Arrow text column."""
    raw, offsets = text_buffers(column)
    for lo, hi in chunks(offsets, CHUNK):
        part = _LOWER[raw[offsets[lo] : offsets[hi]]]
        bounds = offsets[lo : hi + 1] - offsets[lo]
        starts, ends = word_spans(part, bounds)
        yield lo, part, starts, ends, np.searchsorted(bounds, starts, side="right") - 1, word_hashes(part, starts, ends).view(np.int64), hi - lo


def _slices(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    off = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    data = part[np.repeat(starts - off[:-1], sizes) + np.arange(off[-1])] if len(sizes) else part[:0]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())])


@dataclass
class Symbols:
    """Symbols in order: the tree that codes them, each one's number, the row of its text, its contexts' hashes and what is known of its probability."""

    tree: int
    number: np.ndarray
    row: np.ndarray
    contexts: list[np.ndarray]
    rest: np.ndarray | float = 0.0


def sequence(starts, ends, row, h, rows: int):
    """(rows, hashes, places of the words, contexts) of the tokens of texts in order, each text's end included."""
    place = np.arange(len(h)) + row
    head = np.searchsorted(row, np.arange(rows)) + np.arange(rows)  # of each text's first token
    n = len(h) + rows
    own, texts, short = np.full(n, END), np.zeros(n, np.int64), np.zeros(n, bool)
    own[place], texts[place], short[place] = h, row, ends - starts <= SHORT
    last = np.r_[head[1:] - 1, n - 1] if rows else head
    texts[last] = np.arange(rows)
    first = head[texts] if rows else texts
    at = np.arange(n)
    word = own.view(np.uint64)

    def before(k):
        out = np.full(n, START)
        out[k:] = np.where(at[k:] - first[k:] >= k, word[: n - k], START)
        return out

    one, two = before(1), before(2)
    # the last short word before each token, and the one before that; -1 if the text has none
    to = np.r_[-1, np.maximum.accumulate(np.where(short, at, -1))[:-1]] if n else at
    to = np.where(to >= first, to, -1)
    short1 = np.where(to >= 0, word[to], START)
    to2 = np.where(to >= 0, to[to], -1)
    short2 = np.where(to2 >= 0, word[to2], START)
    pair = mix(short1 + mix(short2))
    return texts, own, place, [mix(one ^ np.uint64(1)), mix(one + mix(two)), mix(short1 ^ np.uint64(2)), pair]


def spelled(part, starts, ends, row, language):
    """The bytes of escaped words as symbols, each word's end last."""
    sizes = ends - starts + 1
    off = np.r_[0, np.cumsum(sizes)]
    n = int(off[-1])
    place = np.arange(n) - np.repeat(off[:-1], sizes)
    number = np.full(n, 256, np.int64)
    body = place < np.repeat(sizes - 1, sizes)
    number[body] = part[(np.repeat(starts, sizes) + place)[body]]
    last = np.zeros(n, np.uint64)
    hashes = [mix(np.repeat(language, sizes) ^ np.uint64(3))]
    byte = number.astype(np.uint64) + np.uint64(1)
    for k in range(1, 5):
        prior = np.zeros(n, np.uint64)
        prior[k:] = np.where(place[k:] >= k, byte[: n - k], np.uint64(0))
        last = last * np.uint64(263) + prior
        hashes.append(mix(last + np.uint64(k << 60)))
    return Symbols(1, number, np.repeat(row, sizes), hashes)


def earlier(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens in order: how many come before each in its text, and how many of those are alike."""
    place = np.arange(len(h))
    if not len(h):
        return place, place
    before = place - np.searchsorted(row, np.arange(row[-1] + 1))[row]
    key = mix(h.view(np.uint64) ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    start = np.r_[True, ordered[1:] != ordered[:-1]]
    alike = np.empty(len(h), np.int64)
    alike[order] = place - np.maximum.accumulate(np.where(start, place, 0))
    return before, alike


def symbols(coder: Coder, part, starts, ends, row, h, rows: int, learning: bool = False):
    """(words and ends, spelled bytes, dictionary places, which tokens are in the dictionary, hashes) of texts.

    For ``learning``, a word of a single text isn't in it.
    """
    texts, own, place, contexts = sequence(starts, ends, row, h, rows)
    at, hit = coder.find(own)
    number, known = np.full(len(own), len(coder.symbols)), np.zeros(len(own))
    if len(coder.hashes):
        if learning:
            hit &= (coder.texts[at] > 1) | (own == END)
        number = np.where(hit, coder.symbols[at], len(coder.symbols))
    new = np.flatnonzero(~hit[place])
    before, alike = earlier(row[new], h[new])
    again = alike > 0
    number[place[new[again]]] += 1
    known[place[new[again]]] = np.log(alike[again] / before[again])
    new = new[~again]
    bytes_of = spelled(part, starts[new], ends[new], row[new], contexts[2][place[new]])
    return Symbols(0, number, texts, contexts, known), bytes_of, at, hit, own


class Arranged:
    """Symbols by runs of ``STEP_ROWS``, in each the deepest first, so that the bits of a depth are those of the run's first symbols.

    ``order``: the symbols' places before; ``code``: by depth, twice the node and
    the bit; ``contexts``: each context's slots before a node is taken in.
    """

    def __init__(self, coder: Coder, s: Symbols):
        self.tree = coder.trees[s.tree]
        depth = self.tree.depth.take(s.number)
        key = np.arange(len(depth)) // STEP_ROWS * (DEPTH + 1) + DEPTH
        key -= depth
        if len(key) and key[-1] + DEPTH < 1 << 15:
            key = key.astype(np.int16)  # sorted by digits
        self.order = np.argsort(key, kind="stable")
        self.depth = depth.take(self.order)
        self.code = np.ascontiguousarray(self.tree.code.take(s.number.take(self.order), axis=0).T)
        self.contexts = np.stack([slots(context, SLOT_BITS[s.tree]).take(self.order) for context in s.contexts])

    def runs(self):
        """Yields, for each run, (first symbol, by depth the number of symbols with a bit, twice the node and the bit)."""
        for lo in range(0, len(self.depth), STEP_ROWS):
            depth = self.depth[lo : lo + STEP_ROWS]
            deep = len(depth) - np.cumsum(np.bincount(depth, minlength=DEPTH + 1))[:DEPTH]
            deep = deep[deep > 0].tolist()
            if deep:
                yield lo, deep, np.concatenate([of[lo : lo + m] for of, m in zip(self.code, deep)], dtype=np.int64)

    def slots(self, lo: int, deep: list[int], code: np.ndarray) -> np.ndarray:
        """(contexts, bits): the slots of a run's bits."""
        out = np.concatenate([self.contexts[:, lo : lo + m] for m in deep], axis=1)
        out ^= self.tree.slot.take(code)
        return out


def passes(row: np.ndarray, symbols: Arranged) -> np.ndarray:
    """(depths + 1, symbols as arranged): how many symbols before one in its text share its first bits, as many as the depth.

    The order that brings symbols of a text with the same first bits together is
    made bit by bit: those with a 0 first, each half in order.
    """
    n = len(row)
    out = np.zeros((DEPTH + 1, n), np.float32)
    arranged = np.empty(n, np.int64)
    arranged[symbols.order] = np.arange(n)
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if n else arranged
    text = np.repeat(heads, np.diff(heads, append=n))
    bits = (symbols.code & 1).astype(bool)
    lo = 0
    while lo < n:  # whole texts, few enough for a core's cache
        hi = min(lo + PASSES, n)
        hi = int(text[hi]) if hi < n and text[hi] > lo else int(np.searchsorted(row, row[hi - 1], side="right"))
        order, start = arranged[lo:hi], text[lo:hi] - lo
        lo = hi
        place = np.arange(len(order))
        out[0][order] = place - start
        for d in range(DEPTH):
            bit = bits[d].take(order)
            one, zero = np.flatnonzero(bit), np.flatnonzero(~bit)
            first = np.cumsum(bit)
            first -= bit
            first = first.take(start)  # ones before the first of the group
            start -= first
            order = np.concatenate([order.take(zero), order.take(one)])
            start = np.concatenate([start.take(zero), first.take(one) + len(zero)])
            before = place - start
            out[d + 1][order] = before
            if d % 2:  # groups of one symbol, or without further bits, stay as they are
                last = np.r_[before[1:] == 0, True] if len(before) else before > 0
                keep = symbols.depth.take(order) > d + 1
                keep &= ~last | (before > 0)
                left = np.flatnonzero(keep)
                order, place = order.take(left), place[: len(left)]
                start = (np.cumsum(keep) - keep).take(start.take(left))
    return out


def _distinct(column, train: np.ndarray):
    """Yields (words, hashes, counts in training texts and numbers of these) of the distinct words of runs of texts."""
    for lo, part, starts, ends, row, h, n in _words(column):
        # places by word and then in order, so a text's are together
        order = np.argsort(h, kind="stable")
        w, r = h[order], row[order]
        own = train[lo : lo + n][r]
        new = np.r_[True, w[1:] != w[:-1]][: len(w)]
        news = np.r_[True, r[1:] != r[:-1]][: len(w)] | new
        at, first = np.flatnonzero(new), order[new]
        counts = [np.add.reduceat(x, at, dtype=np.int64) if len(at) else at for x in (own, news & own)]
        yield _slices(part, starts[first], ends[first]), w[at], np.stack(counts, 1)


def count_words(docs: DataFrame) -> DataFrame:
    """(wh, word, c, df): each distinct token of all texts, its count in training texts and the number of these; tasks count their batches first."""

    def run(batches):
        parts, hashes, counts, held = [], [], [], 0

        def reduced():
            u, first, at = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            c = [pa.array(np.bincount(at, weights=k).astype(np.int64)) for k in np.concatenate(counts).T]
            return pa.record_batch([pa.concat_arrays(parts).take(pa.array(first)), pa.array(u), *c], ["word", "wh", "c", "df"])

        for batch in batches:
            train = ~batch.column("held").to_numpy(zero_copy_only=False)
            for found in ([pa.array([b""], pa.binary()), np.array([END]), np.array([[train.sum()] * 2])], *_distinct(batch.column("body"), train)):
                for x, y in zip((parts, hashes, counts), found):
                    x.append(y)
                held += len(found[1])
            if held > HELD:
                yield reduced()
                parts, hashes, counts, held = [], [], [], 0
        if held:
            yield reduced()

    counted = docs.select("held", "body").mapInArrow(run, "word binary, wh bigint, c bigint, df bigint")
    return counted.groupBy("wh", "word").agg(F.sum("c").alias("c"), F.sum("df").alias("df"))


def head_count(words: DataFrame, head: int, least: int = 1) -> int:
    """The smallest count, of a fixed scale and ``least`` or more, that at most ``head`` tokens reach."""
    step = F.floor(F.log2("c") * 16)
    found = sorted(words.where(F.col("c") >= least).groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("c"), F.min("c").alias("lo")).collect(), reverse=True)
    out, n = (found[0]["c"] + 1 if found else least), 0
    for r in found:
        n += r["n"]
        if n > head:
            break
        out = r["lo"]
    return out


def fit_coder(words: DataFrame, head: int) -> Coder:
    """The dictionary's words, at most ``head``, reach the driver; of the spelled ones, the counts of their bytes."""
    least = head_count(words, head)
    top = words.where(F.col("c") >= least).toPandas()

    def count(batches):
        out = np.zeros(257, np.int64)
        for batch in batches:
            c, column = batch.column("c").to_numpy(), batch.column("word")
            _, off, data = column.buffers()
            at = np.frombuffer(off, np.int32, len(column) + 1, column.offset * 4)
            raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
            out[:256] += np.bincount(raw, weights=np.repeat(c, np.diff(at)), minlength=256).astype(np.int64)
            out[256] += c.sum()
        yield pa.record_batch([pa.array(np.arange(257)), pa.array(out)], ["b", "n"])

    spelt = words.where((F.col("c") > 0) & ((F.col("c") < least) | (F.col("df") == 1))).select("word", F.col("df").alias("c")).mapInArrow(count, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).collect()
    letters = np.zeros(257, np.int64)
    for b, n in spelt:
        letters[b] = n
    few = [F.count(F.when(F.col("df") == k, 1)) for k in (1, 2)]
    escaped, once, twice = words.agg(F.coalesce(F.sum(F.when(F.col("c") < least, F.col("c"))), F.lit(0)), *few).first()
    return make_coder([bytes(w) for w in top["word"]], top["wh"].to_numpy(np.int64), top["c"].to_numpy(np.int64), top["df"].to_numpy(np.int64), escaped, letters, once, twice)


def count_tables(docs: DataFrame, coder) -> list[list[np.ndarray]]:
    """By tree and context, counts (2, slots) of the bits over all training texts.

    Tasks give what they counted in blocks, which are summed in two rounds as
    they stream by.
    """

    def read(batches):
        n = [[np.zeros(2 << bits, np.uint32) for _ in range(k)] for k, bits in zip(CONTEXTS, SLOT_BITS)]
        seen: list[list[list[np.ndarray]]] = [[[] for _ in range(k)] for k in CONTEXTS]
        held = total = 0
        salt = TaskContext.get().partitionId() % SALTS

        def flush():
            for t, of in enumerate(seen):
                for k, x in enumerate(of):
                    if x:
                        np.add(n[t][k], np.bincount(np.concatenate(x), minlength=2 << SLOT_BITS[t]), out=n[t][k], casting="unsafe")
                        x.clear()

        def counted():
            for t, tables in enumerate(n):
                for k, table in enumerate(tables):
                    for b, block in enumerate(table.reshape(-1, BLOCK)):
                        if block.any():
                            yield _block(salt, t, k, b, block)

        for batch in batches:
            for _, *texts in _words(batch.column("body")):
                for s in symbols(coder.value, *texts, learning=True)[:2]:
                    arranged = Arranged(coder.value, s)
                    for lo, deep, code in arranged.runs():
                        side = (code & 1).astype(np.int32) << np.int32(SLOT_BITS[s.tree])
                        held += len(code)
                        for x, slot in zip(seen[s.tree], arranged.slots(lo, deep, code) | side):
                            x.append(slot)
                if held > HELD_BITS:
                    flush()
                    total, held = total + held, 0
                if total > FULL:
                    yield from counted()
                    for tables in n:
                        for table in tables:
                            table.fill(0)
                    total = 0
        flush()
        yield from counted()

    def add(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for salt, t, k, b, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                sums.setdefault((salt, t, k, b), np.zeros(BLOCK, np.int64)).__iadd__(np.frombuffer(n, f"<u{len(n) // BLOCK}"))
        for (salt, *key), n in sums.items():
            yield _block(0, *key, n)

    parts = docs.where("not held").select("body").mapInArrow(read, TABLES)
    for keys in (["salt", "tree", "context", "block"], ["tree", "context", "block"]):
        parts = parts.repartition(*keys).mapInArrow(add, TABLES)
    out = [[np.zeros(2 << bits, np.float32) for _ in range(k)] for k, bits in zip(CONTEXTS, SLOT_BITS)]
    for r in parts.coalesce(4).toLocalIterator():  # 27 MB in all
        out[r["tree"]][r["context"]][r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["n"], f"<u{len(r['n']) // BLOCK}")
    return [[n.reshape(2, -1) for n in tables] for tables in out]


def _block(salt, tree, context, block, n) -> pa.RecordBatch:
    """A row of counts in the least bytes that hold them."""
    n = n.astype(next(f"<u{size}" for size in (1, 2, 4, 8) if n.max() < 1 << 8 * size))
    kinds = (pa.int32(),) * 4 + (pa.binary(),)
    return pa.record_batch([pa.array([x], t) for x, t in zip((salt, tree, context, block, n.tobytes()), kinds)], ["salt", "tree", "context", "block", "n"])


def _steps_seen(n: np.ndarray) -> np.ndarray:
    """How often a context was seen, in SEEN steps: never, up to 3, up to 31, more."""
    return (n > 0).view(np.int8) + (n > 3).view(np.int8) + (n > 31).view(np.int8)


@dataclass
class Coded:
    """Tables of counts in two bytes a slot: by context, each slot's code, and the counts (2, codes) that codes stand for."""

    codes: np.ndarray
    counts: list[np.ndarray]


def coded(tables: list[np.ndarray]) -> Coded:
    """Tables with more than 2^16 pairs of counts keep as many leading binary digits of each count as leave no more."""
    codes, counts = np.zeros((len(tables), tables[0].shape[1] if tables else 0), np.uint16), []
    for out, n in zip(codes, tables):
        n = n.astype(np.int64)
        pairs, at = np.unique(n[0] << 32 | n[1], return_inverse=True)
        digits, few, to = 17, pairs, None
        while len(few) > 1 << 16:
            digits -= 1
            two = np.stack([pairs >> 32, pairs & 0xFFFFFFFF])
            low = np.maximum(np.frexp(two.astype(float))[1] - digits, 0)
            two = (two >> low << low) + (1 << low >> 1)
            few, to = np.unique(two[0] << 32 | two[1], return_inverse=True)
        at = at if to is None else to[at]
        # what is looked up often comes first, so that it is side by side
        order = np.argsort(-np.bincount(at, weights=n[0] + n[1], minlength=len(few)), kind="stable")
        place = np.empty(len(few), np.uint16)
        place[order] = np.arange(len(few))
        out[:], few = place[at], few[order]
        counts.append(np.stack([few >> 32, few & 0xFFFFFFFF]).astype(np.float32))
    return Coded(codes, counts)


class Mixer:
    """Weights by gate over a tree's predictors (no context, hashed ones, the text so far) and a bias, and the refining table.

    Without a ``state`` it learns: a bit's own occurrence is left out of the
    counts of its contexts, so a code has log odds for each value of the bit.
    """

    def __init__(self, tree: int, tables: Coded | list[np.ndarray], state: tuple | None = None):
        self.tree = tree
        tables = tables if isinstance(tables, Coded) else coded(tables)
        self.codes, self.odds, self.seen = tables.codes, [], []
        self.learning = state is None
        if self.learning:
            self.reset()
        else:
            self.weights, self.refined = state
        for n in tables.counts:
            n0, n1 = np.zeros((2, 1 << 16, 1 + self.learning), np.float32)
            for y in range(1 + self.learning):
                n0[: n.shape[1], y] = np.maximum(n[0] - (self.learning and y == 0), 0)
                n1[: n.shape[1], y] = np.maximum(n[1] - (self.learning and y == 1), 0)
            self.odds.append(np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4))).ravel())
            self.seen.append(_steps_seen(n0 + n1).ravel())

    def reset(self) -> None:
        k = CONTEXTS[self.tree]
        self.weights = np.tile(np.array([0.4] + [0.6 / k] * k + [0.0, 0.0], np.float32), (GATES, 1))
        self.power = np.zeros((GATES, k + 3))
        self.pairs = np.zeros((2, GATES * LEVELS), np.int64)

    @property
    def gate_by(self) -> tuple[int, int]:
        """What picks the gate by how often it was seen: the text so far and the word before; two and four bytes before."""
        return ((CONTEXTS[0], 0), (2, 4))[self.tree]

    def inputs(self, symbols: Arranged, passed: np.ndarray | None, lo: int, deep: list[int], code):
        """(log odds (predictors, bits), gate) of the bits of a run of symbols; ``passed``: what ``passes`` gives, None for spelled bytes."""
        tree, k, bit = symbols.tree, CONTEXTS[self.tree], code & 1
        x = np.empty((k + 3, len(code)), np.float32)
        tree.odds_of.take(code, out=x[0], mode="clip")
        x[-2], x[-1] = 0, 1
        picks = {}
        if passed is not None:
            so_far, alike = (np.concatenate([of[lo : lo + m] for of, m in zip(passed[i:], deep)]) for i in (0, 1))
            picks[k] = _steps_seen(so_far)
            share = tree.share.take(code)
            so_far -= alike
            so_far += 1 - share
            alike += share
            alike /= so_far
            np.log(alike, out=alike)  # of the bit as it is
            np.multiply(alike, bit.astype(np.float32) * 2 - 1, out=x[-2])
        for i, slot in enumerate(symbols.slots(lo, deep, code)):
            n = self.codes[i].take(slot.astype(np.int64), mode="clip").astype(np.int64)
            if self.learning:
                n <<= 1
                n |= bit
            self.odds[i].take(n, out=x[i + 1], mode="clip")
            if i in self.gate_by:
                picks[i] = self.seen[i].take(n, mode="clip")
        first, second = self.gate_by
        gate = picks[first] * np.int8(SEEN)
        gate += picks[second]
        gate = gate.astype(np.int64)
        gate += np.repeat(np.arange(len(deep)) * (SEEN * SEEN), deep)
        return x, gate

    def mix(self, x, gate):
        z = np.einsum("ij,ij->j", np.ascontiguousarray(self.weights.T).take(gate, axis=1, mode="clip"), x)
        return np.clip(z, -14, 14, out=z)

    @staticmethod
    def level(z, gate):
        out = np.clip(z + np.float32(12), 0, LEVELS - 1).astype(np.int64)
        out += gate * LEVELS
        return out

    def learn(self, x, gate, bit):
        """One online step: the refining table sees what was mixed, then the weights follow the error."""
        z = self.mix(x, gate)
        self.pairs += np.bincount(self.level(z, gate) + bit * (GATES * LEVELS), minlength=2 * GATES * LEVELS).reshape(2, -1)
        wrong = bit.astype(np.float32)
        wrong -= 1 / (1 + np.exp(-z))
        # neighbours of one gate are summed apart, as a sum waits for the one before
        apart = gate + (np.arange(len(gate)) & 3) * GATES
        summed = lambda v=None: np.bincount(apart, weights=v, minlength=4 * GATES).reshape(4, -1).sum(0)
        mass = np.maximum(summed(), 1)[:, None]
        slope = np.zeros_like(self.power)
        for i in range(len(x) - 1 - self.tree):  # a spelled byte has no text so far
            slope[:, i] = summed(wrong * x[i])
        slope[:, -1] = summed(wrong)
        slope /= mass
        self.power += slope**2
        self.weights += (RATE * slope / np.sqrt(self.power + 1e-4)).astype(np.float32)

    def bits(self, x, gate, bit):
        """The probability of each bit: the mean of the mixed and the refined one."""
        z = self.mix(x, gate)
        p = self.refined.take(self.level(z, gate))
        p += 1 / (1 + np.exp(-z))
        p *= np.float32(0.5)
        np.clip(p, np.float32(1e-6), np.float32(1 - 1e-6), out=p)
        p -= (1 - bit).astype(np.float32)  # a 0 has what is left of 1
        return np.abs(p, out=p)


def fit_symbols(coder: Coder, mixer: Mixer, s: Symbols) -> None:
    """Learns symbols in order, ``STEP_ROWS`` at a time, each left out of the counts of its contexts."""
    arranged = Arranged(coder, s)
    passed = None if s.tree else passes(s.row, arranged)
    for lo, deep, code in arranged.runs():
        mixer.learn(*mixer.inputs(arranged, passed, lo, deep, code), code & 1)


def shard_chunks(batches):
    """Yields (shard, texts) of rows that come by shard: chunks of about ``CHUNK`` bytes, cut from the shard's first text on, whatever the batches."""
    shard, held, size = None, [], 0
    for batch in batches:
        of, body = batch.column("shard").to_numpy(), batch.column("body")
        cuts = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            if held and of[lo] != shard:
                for part in _cut(held):
                    yield shard, part
                held, size = [], 0
            shard, piece = int(of[lo]), body.slice(lo, hi - lo)
            held.append(piece)
            size += piece.nbytes
            if size > 8 * CHUNK:
                *whole, last = _cut(held)  # more texts may belong to the last
                for part in whole:
                    yield shard, part
                held, size = [last], last.nbytes
    for part in _cut(held) if held else ():
        yield shard, part


def _cut(held: list[pa.Array]) -> list[pa.Array]:
    column = pa.concat_arrays(held)
    return [column.slice(lo, hi - lo) for lo, hi in chunks(text_buffers(column)[1], CHUNK)]


def fit_mixers(docs: DataFrame, id_hash: Column, coder, tables, texts: int, size: int) -> list[tuple]:
    """(weights, refining table) by tree, learnt from all of the ``texts`` training texts.

    They are dealt by hash to shards of about ``size``, at least ``SHARDS``; each
    shard learns online over its texts in order of hash, and the shards' weights
    are averaged. What shards have learnt is summed in tasks, as integers.
    """
    shards = max(SHARDS, -(-texts // size))
    dealt = docs.where("not held").select(id_hash.alias("k"), "body").withColumn("shard", F.pmod("k", F.lit(shards)).cast("int"))

    def packed(n, mixers_of) -> pa.RecordBatch:
        state = [x.tobytes() for x in mixers_of]
        return pa.record_batch([pa.array([TaskContext.get().partitionId() % SALTS], pa.int32()), pa.array([n], pa.int64()), pa.array([state], pa.list_(pa.binary()))], ["salt", "n", "state"])

    def run(batches):
        mixers = [Mixer(t, tables.value[t]) for t in (0, 1)]
        total, n, now = [], 0, None

        def end():
            learnt = [x for m in mixers for x in (np.rint(m.weights.astype(np.float64) * UNIT).astype(np.int64), m.pairs)]
            total[:] = [a + b for a, b in zip(total, learnt)] if total else learnt
            for m in mixers:
                m.reset()

        for shard, column in shard_chunks(batches):
            if shard != now and now is not None:
                end()
                n += 1
            now = shard
            for _, *texts_of in _words(column):
                for s, mixer in zip(symbols(coder.value, *texts_of, learning=True), mixers):
                    fit_symbols(coder.value, mixer, s)
        if now is not None:
            end()
            yield packed(n + 1, total)

    def add(batches):
        total, n = [], 0
        for batch in batches:
            for k, state in zip(batch.column("n").to_pylist(), batch.column("state").to_pylist()):
                learnt = [np.frombuffer(x, np.int64) for x in state]
                total, n = [a + b for a, b in zip(total, learnt)] if total else learnt, n + k
        if n:
            yield packed(n, total)

    schema = "salt int, n bigint, state array<binary>"
    learnt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "k", "body").select("shard", "body").mapInArrow(run, schema)
    found = learnt.repartition(SALTS, "salt").mapInArrow(add, schema).collect()
    n, out = sum(r["n"] for r in found), []
    middle = 1 / (1 + np.exp(-(np.tile(np.arange(LEVELS), GATES) + 0.5 - 12)))
    for t in (0, 1):
        weights, pairs = (sum((np.frombuffer(r["state"][2 * t + i], np.int64) for r in found), np.int64(0)) for i in (0, 1))
        start = Mixer(t, [])
        weights = (weights / (n * UNIT)).reshape(GATES, -1).astype(np.float32) if n else start.weights
        pairs = pairs.reshape(2, -1) if n else start.pairs
        out.append((weights, ((pairs[1] + 20 * middle) / (pairs.sum(0) + 20)).astype(np.float32)))
    return out


def log_symbols(coder: Coder, mixer: Mixer, s: Symbols) -> np.ndarray:
    """Natural log of the probability of each symbol."""
    arranged = Arranged(coder, s)
    passed = None if s.tree else passes(s.row, arranged)
    product = np.ones(len(s.number))  # at least 1e-6 to the DEPTH
    for lo, deep, code in arranged.runs():
        p, at = mixer.bits(*mixer.inputs(arranged, passed, lo, deep, code), code & 1), 0
        for m in deep:
            product[lo : lo + m] *= p[at : at + m]
            at += m
    out = coder.trees[s.tree].rest[s.number] + s.rest
    out[arranged.order] += np.log(product)
    return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """A row (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row of ``docs``.

    Tokens are lower-cased words and the end. Training texts are those that
    aren't held out. ``base_score`` is a smoothed unigram log10 probability,
    ``score`` the mixing model's, over all words of the text in their order;
    white space isn't coded. ``bits_per_byte`` are its bits by the text's UTF-8
    bytes (1 at least). A null text is empty, so it is its end alone. Repeated
    rows count as often as they stand; an empty table gives an empty one.
    """
    with small_batches(docs.sparkSession):
        return _score(docs, id_col, text_col, head, shard_texts)


def _score(docs: DataFrame, id_col: str, text_col: str, head: int, shard_texts: int) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), held_out(F.col(id_col)).alias("held"), body.alias("body"))
    words = materialise(count_words(rows), "words")
    texts = F.max(F.when((F.col("wh") == int(END)) & (F.octet_length("word") == 0), F.col("c")))
    n, v, texts = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(texts, F.lit(0))).first()
    coder = spark.sparkContext.broadcast(fit_coder(words, head))
    tables = spark.sparkContext.broadcast([coded(n) for n in count_tables(rows, coder)])
    states = fit_mixers(rows, F.xxhash64(F.coalesce("id", F.lit(0)), "body"), coder, tables, texts, shard_texts)
    floor = float(np.log10(n + 0.5 * (v + 1)))

    def run(batches):
        own = coder.value
        mixers = [Mixer(t, tables.value[t], states[t]) for t in (0, 1)]
        base = np.log10(own.counts + 0.5) - floor
        task, done = TaskContext.get().taskAttemptId(), 0
        for batch in batches:
            out = []
            for _, *texts in _words(batch.column("body")):
                count = texts[-1]
                of, bytes_of, at, hit, hashes = symbols(own, *texts)
                sums = [np.bincount(s.row, weights=log_symbols(own, m, s), minlength=count) for s, m in zip((of, bytes_of), mixers)]
                sizes = np.bincount(of.row, minlength=count)
                rest = np.flatnonzero(~hit)
                off = np.r_[0, np.cumsum(np.bincount(of.row[rest], minlength=count))].astype(np.int32)
                out.append([
                    pa.array(sizes), pa.array(np.bincount(of.row[hit], weights=base[at[hit]], minlength=count).astype(float)), pa.array(np.bincount(of.row[hit], minlength=count)),
                    pa.array((sums[0] + sums[1]).astype(float) / np.log(10)), pa.ListArray.from_arrays(pa.array(off), pa.array(hashes[rest])),
                ])
            if out:
                place = pa.array(np.arange(done, done + batch.num_rows))
                done += batch.num_rows
                cols = [pa.concat_arrays(x) for x in zip(*out)]
                yield pa.record_batch([batch.column("id"), batch.column("held"), batch.column("n_bytes"), pa.array([task] * batch.num_rows, pa.int64()), place, *cols], ["doc_id", "held_out", "n_bytes", "task", "place", "n_tokens", "base", "known", "score", "rest"])

    schema = "doc_id bigint, held_out boolean, n_bytes int, task bigint, place bigint, n_tokens bigint, base double, known bigint, score double, rest array<bigint>"
    scored = materialise(rows.withColumn("n_bytes", F.octet_length("body")).mapInArrow(run, schema), "scored")
    rest = scored.select("task", "place", F.explode("rest").alias("wh")).join(words.select("wh", "c"), "wh")
    # in order of count, so that the sum is the same in every run
    more = rest.groupBy("task", "place").agg(F.sum((F.col("c") > 0).cast("bigint")).alias("known2"), F.sort_array(F.collect_list("c")).alias("cs"))
    more = more.select("task", "place", "known2", F.expr(f"aggregate(cs, 0.0D, (s, c) -> s + log10(c + 0.5) - {floor!r}D)").alias("base2"))
    out = scored.drop("rest").join(more, ["task", "place"], "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") / float(np.log10(2)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )

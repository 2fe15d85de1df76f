"""Benchmark decontamination by canonical templates.

Texts and benchmark items are cut into runs of letters and digits; whole numbers,
units behind a number, and names become typed placeholders (a word that holds
a digit, as h2o, is none of these). Windows of the
placeholder texts are hash-joined. A copy with other numbers or names still
matches, and its slots tell whether it is one: along an alignment, each value
of the item has to stand for one value of the text throughout, and no two for
the same one.

Four forms are kept of every window. In the literal form numbers and units stay
as they are, so that a verbatim copy is found whatever it consists of; in the
plain form names stay, in lower case, so that a copy in other case is found; in
the named form a run of capitalised words inside a sentence is one name, and in
the opening form so is one that opens a sentence. Each form matches with itself
only, and places are counted in its own tokens.

Templates with fewer literals than placeholders, and short ones, are common in
any text, so their windows are dropped but in the literal form. An item of at most a
window's length that loses its windows so is looked for as a whole: as the run
of sentences that it is, with at least one literal and three tokens.

A window that many items share, as a sentence of theirs, would pair every
document that has it with all of them. It only helps to verify documents that
a rarer window of the item has found, where such windows alone can't cover the item.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.shared import materialise, ship
from lodestream.llm.shingles import _LOWER, chunks, mix, text_buffers, word_hashes

# Units of measure that follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces t ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters degree degrees percent dollar dollars cent cents euro euros usd eur gbp "
    "mph kmh hz khz mhz ghz w kw v kv a j kj cal kcal kb mb gb tb"
).split()

WINDOW = 8
#: Words of an item that windows have to cover; a shorter item has to be covered whole.
COVER = 13
#: Share of slots that have to agree along an alignment.
CONSISTENT = 0.8
#: Items of fewer tokens are too common a phrase to tell a copy with other values by, but as whole sentences.
LEAST = 5
#: Items that may share a window before it no longer finds documents by itself.
SHARED = 8
#: Benchmark windows up to which their hashes are sent to the tasks, 8 bytes each.
SENT = 2_000_000

NUM, UNIT, NAME = (np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)) for k in (1, 2, 3))
HITS = "doc_id bigint, h bigint, form int, pos bigint, window bigint, slots array<bigint>"
LITERAL, PLAIN, NAMED, OPENING = range(4)
#: Added to a form for windows that are whole sentences and a whole item.
WHOLE = 4

_BYTES = np.arange(256)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_WORD = _DIGIT | _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_POINT = np.isin(_BYTES, [44, 46])
_STOP = np.isin(_BYTES, [10, 13, 33, 46, 58, 63])


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer("".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) for u in UNITS])
    return np.sort(word_hashes(raw, ends - [len(u) for u in UNITS], ends))


_UNITS = _unit_hashes()


def tokens(part: np.ndarray, bounds: np.ndarray, places: bool = False):
    """(row, value hash, placeholder kind in the named form, kind in the plain form, kind in the opening form) of each token; kind 0 is a literal.

    With ``places``: (row, value hash, first byte).
    """
    n = len(part)
    inside = _WORD[part]
    digit = _DIGIT[part]
    if n > 2:
        inside[1:-1] |= _POINT[part[1:-1]] & digit[:-2] & digit[2:]  # 1,000 and 2.5 are one token
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    row = np.searchsorted(bounds, starts, side="right") - 1
    value = word_hashes(_LOWER[part], starts, ends)
    if places:
        return row, value, starts
    digits, letters = np.r_[0, np.cumsum(digit)], np.r_[0, np.cumsum(_WORD[part] & ~digit)]
    has_digit = digits[ends] > digits[starts]
    number = has_digit & (letters[ends] == letters[starts])
    unit = np.zeros(len(value), bool)
    if len(value):
        at = np.minimum(np.searchsorted(_UNITS, value), len(_UNITS) - 1)
        unit[1:] = number[:-1] & ~number[1:] & (row[1:] == row[:-1]) & (_UNITS[at[1:]] == value[1:])
    stops = np.r_[0, np.cumsum(_STOP[part])]
    opens = np.ones(len(value), bool)
    opens[1:] = (row[1:] != row[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
    plain = np.where(number, NUM, np.where(unit, UNIT, np.uint64(0)))
    name = _UPPER[part[starts]] & (plain == 0) & ~has_digit if len(value) else opens
    return row, value, np.where(name & ~opens, NAME, plain), plain, np.where(name, NAME, plain), opens


def forms(part: np.ndarray, bounds: np.ndarray):
    """Yields (form, rows, value hashes, kinds, whether a sentence opens, first and end place in the text) of tokens, a run of names as one.

    A form is left out for texts where it would be the plain one.
    """
    row, value, named, plain, opening, opens = tokens(part, bounds)
    at = np.arange(len(value)) - np.searchsorted(row, np.arange(len(bounds) - 1))[row]
    yield LITERAL, row, value, np.zeros(len(value), np.uint64), opens, at, at + 1
    yield PLAIN, row, value, plain, opens, at, at + 1
    for form, kind in ((NAMED, named), (OPENING, opening)):
        differs = np.zeros(len(bounds) - 1, bool)
        differs[row[kind != plain]] = True
        mine = differs[row]
        if not mine.any():
            continue
        r, v, k, o, i = row[mine], value[mine], kind[mine], opens[mine], at[mine]
        # a run goes on within a text and a sentence
        on = np.r_[False, (k[1:] == NAME) & (k[:-1] == NAME) & (r[1:] == r[:-1]) & ~o[1:]]
        start, place = np.flatnonzero(~on), np.arange(len(v))
        place = (place - np.maximum.accumulate(np.where(on, 0, place))).astype(np.uint64)
        value_of = np.add.reduceat(np.where(on, mix(v + place), v), start)
        yield form, r[start], value_of, k[start], o[start], i[start], i[start] + np.diff(np.r_[start, len(v)])


def windows(column, sizes: dict[int, list[int]], known: np.ndarray | None = None):
    """Yields (row, form, place, window hash, slots, openers, first and end place in the text) of the windows of each form's sizes.

    But for the literal form these are windows with as many literals as
    placeholders or more; for forms from ``WHOLE`` on, windows that begin and
    end with a sentence and have a literal. ``known``: sorted hashes to which the windows are
    kept. Slots are value hashes, 0 for a literal; an opener is a slot that
    opens a sentence.
    """
    raw, offsets = text_buffers(column)
    for lo, hi in chunks(offsets):
        part = raw[offsets[lo] : offsets[hi]]
        for form, row, value, kind, opens, at, end in forms(part, offsets[lo : hi + 1] - offsets[lo]):
            head = np.searchsorted(row, np.arange(hi - lo))
            mixed = mix(np.where(kind == 0, value, kind))
            literal = np.r_[0, np.cumsum(kind == 0)]
            closes = np.r_[(row[1:] != row[:-1]) | opens[1:], np.ones(min(1, len(row)), bool)]
            for tag, size in [(t, n) for t in (form, form + WHOLE) for n in sizes.get(t, [])]:
                m = len(value) - size + 1
                if m <= 0:
                    continue
                whole = row[:m] == row[size - 1 :]
                acc = np.full(m, np.uint64(size * 8 + tag), np.uint64)
                for k in range(size):
                    acc = acc * np.uint64(0xD1342543DE82EF95) + mixed[k : k + m]
                acc = mix(acc)
                literals = literal[size:] - literal[:m]
                if tag >= WHOLE:
                    keep = whole & opens[:m] & closes[size - 1 :] & (literals > 0)
                else:
                    keep = whole & ((form == LITERAL) | (2 * literals >= size))
                if known is not None:
                    keep &= known[np.minimum(np.searchsorted(known, acc), len(known) - 1)] == acc if len(known) else False
                for i in np.flatnonzero(keep).tolist():
                    slots = np.where(kind[i : i + size] == 0, np.uint64(0), value[i : i + size]).view(np.int64)
                    yield lo + int(row[i]), tag, i - int(head[row[i]]), int(acc[i : i + 1].view(np.int64)[0]), slots.tolist(), opens[i : i + size].tolist(), int(at[i]), int(end[i + size - 1])


def token_counts(column) -> np.ndarray:
    """(rows, forms) of how many tokens each text has in a form, 0 where that is left out."""
    raw, offsets = text_buffers(column)
    out = np.zeros((len(offsets) - 1, 4), np.int64)
    for lo, hi in chunks(offsets):
        for form, row, *_ in forms(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
            out[lo:hi, form] = np.bincount(row, minlength=hi - lo)
    return out


ITEMS = "item_id bigint, item_tokens bigint, form int, size int, item_pos bigint, window bigint, item_slots array<bigint>, item_opens array<boolean>, item_at bigint, item_end bigint"


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The windows of items in each form (``ITEMS``); an item of fewer tokens than a window is one window."""
    ship(benchmark.sparkSession)

    def cut(batches):
        for batch in batches:
            out, column = [], batch.column("body")
            counts = token_counts(column)
            # an item below LEAST tokens is looked for as it stands alone
            size_of = np.minimum(window, np.where((counts[:, [LITERAL]] >= LEAST) | (np.arange(4) == LITERAL), counts, 0))
            found = set()
            for form in range(4):
                for size in np.unique(size_of[:, form]).tolist():
                    for row, _, pos, key, slots, opens, at, end in windows(column, {form: [size]}) if size else ():
                        if size_of[row, form] == size:
                            found.add((row, form))
                            out.append((batch.column("id")[row].as_py(), int(counts[row, LITERAL]), form, size, pos, key, slots, opens, at, end))
            # items of a window's length at most without one in a form: as whole sentences
            for form in range(1, 4):
                for size in range(3, window + 1):
                    for row, tag, pos, key, slots, opens, at, end in windows(column, {form + WHOLE: [size]}):
                        if counts[row, form] == size and (row, form) not in found:
                            out.append((batch.column("id")[row].as_py(), int(counts[row, LITERAL]), tag, size, pos, key, slots, opens, at, end))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.int64())
                names = ["item_id", "item_tokens", "form", "size", "item_pos", "window", "item_slots", "item_opens", "item_at", "item_end"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    rows = benchmark.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return rows.mapInArrow(cut, ITEMS)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: int = COVER, id_col: str = "doc_id", text_col: str = "text", sent: int = SENT) -> DataFrame:
    """(doc_id, h, item_id, covered, item_tokens, reparameterised) for each document and item it holds.

    h is the hash of the text, so rows that share an id but not a text are told
    apart; repeated rows give one. An item is held if, in one form and along one
    alignment, consistent windows cover ``cover`` of its tokens, or all if it
    has fewer. Null and empty texts hold nothing; of items below ``LEAST``
    tokens only verbatim copies and whole sentences count; empty tables give an
    empty one. If the
    benchmark has at most ``sent`` windows, tasks keep only document windows
    with a known hash before the join; beyond that all windows are joined.
    """
    spark = docs.sparkSession
    items = materialise(item_windows(benchmark, window), "items")
    sizes: dict[int, list[int]] = {}
    for r in items.select("form", "size").distinct().collect():
        sizes.setdefault(r["form"], []).append(r["size"])
    known = None
    if items.count() <= sent:
        known = np.sort(items.select("window").distinct().toArrow().column("window").to_numpy().view(np.uint64))
        known = spark.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            column, out = batch.column("body"), []
            for row, form, pos, key, slots, *_ in windows(column, sizes, known.value if known else None):
                out.append((row, form, pos, key, slots))
                if len(out) >= 50_000:
                    yield _hits(batch, out)
                    out = []
            if out:
                yield _hits(batch, out)

    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("h"), body.alias("body"))
    hits = rows.mapInArrow(run, HITS)
    finding, verifying = _by_rarity(items, cover)
    told = ["doc_id", "h", "item_id", "item_tokens", "form", "pos", "item_pos", "slots", "item_slots", "item_opens", "item_at", "item_end"]
    some = not verifying.isEmpty()
    if some:
        hits = materialise(hits, "hits")
    # repeated rows of a document would only repeat its hits
    joined = hits.join(finding, ["form", "window"]).select(*told).distinct().withColumn("shift", F.col("pos") - F.col("item_pos"))
    if some:
        joined = materialise(joined, "found")
        met = joined.select("doc_id", "h", "item_id", "shift").distinct().alias("m").join(verifying.alias("v"), F.col("m.item_id").eqNullSafe(F.col("v.item_id")))
        met = met.select("m.doc_id", "m.h", "m.item_id", "m.shift", "v.item_tokens", "v.form", "v.window", "v.item_pos", "v.item_slots", "v.item_opens", "v.item_at", "v.item_end")
        there = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.form") == F.col("y.form")) & (F.col("x.window") == F.col("y.window")) & (F.col("x.item_pos") + F.col("x.shift") == F.col("y.pos"))
        own = {"slots": "y.slots", "pos": "y.pos"}
        more = met.alias("x").join(hits.alias("y"), there).select(*(own.get(c, f"x.{c}") for c in told), "x.shift").distinct()
        joined = joined.unionByName(more)
    aligned = materialise(joined, "aligned")
    key = ["doc_id", "h", "item_id", "shift"]
    # a slot seen from several windows is one slot; a word that opens a sentence in both is none
    slot = F.explode(F.filter(F.transform(F.arrays_zip("slots", "item_slots", "item_opens"), lambda s, i: F.struct((F.col("item_pos") + i).alias("at"), s["slots"].alias("v"), s["item_slots"].alias("w"), s["item_opens"].alias("o"))), lambda s: (s["v"] != 0) & ~(s["o"] & (s["v"] == s["w"]))))
    slots = aligned.select(*key, slot.alias("s")).select(*key, "s.*").distinct()
    pairs = slots.groupBy(*key, "w", "v").agg(F.count(F.lit(1)).alias("n"))
    # how many slots agree if an item's value has one text's value only, and the other way round
    values = pairs.groupBy(*key, "w").agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.max((F.col("w") != F.col("v")).cast("int")).alias("other"), F.lit(0).cast("bigint").alias("back"))
    back = pairs.groupBy(*key, "v").agg(F.max("n").alias("back")).select(*key, F.lit(None).cast("bigint").alias("w"), F.lit(0).cast("bigint").alias("most"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("other"), "back")
    agreed = values.unionByName(back).groupBy(*key).agg((F.least(F.sum("most"), F.sum("back")) / F.sum("n")).alias("share"), F.max("other").alias("other"))
    same = lambda x, y: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in key]
    checked = aligned.alias("a").join(agreed.alias("g"), _all(same("a", "g")), "left").where((F.col("form") == LITERAL) | (F.coalesce(F.col("share"), F.lit(1.0)) >= CONSISTENT))
    checked = checked.select("a.*", F.when(F.col("form") != LITERAL, F.col("other")).alias("other"))
    along = checked.groupBy(*key, "form").agg(F.max("item_tokens").alias("item_tokens"), F.array_sort(F.collect_set(F.struct("item_at", "item_end"))).alias("at"), F.max(F.coalesce("other", F.lit(0))).alias("other"))
    held = along.withColumn("covered", F.expr(COVERED)).where(F.col("covered") >= F.least(F.lit(cover), F.col("item_tokens")))
    return held.groupBy("doc_id", "h", "item_id").agg(F.max("covered").alias("covered"), F.max("item_tokens").alias("item_tokens"), (F.max("other") == 1).alias("reparameterised"))


#: Places that spans ``at``, in ascending order, cover.
COVERED = "aggregate(at, named_struct('n', 0L, 'to', 0L), (s, x) -> named_struct('n', s.n + greatest(0L, x.item_end - greatest(s.to, x.item_at)), 'to', greatest(s.to, x.item_end)), s -> s.n)"


def _by_rarity(items: DataFrame, cover: int) -> tuple[DataFrame, DataFrame]:
    """Item windows that find documents, and those that only verify what others found.

    The latter are shared by more than SHARED items, and are of an item and form whose shared
    windows together cover too little to hold it, so a document that holds it has another one.
    """
    shared = items.select("form", "window", "item_id").distinct().groupBy("form", "window").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARED).select("form", "window", F.lit(True).alias("shared"))
    marked = materialise(items.join(shared, ["form", "window"], "left"), "item-windows")
    spans = F.array_sort(F.collect_set(F.struct("item_at", "item_end"))).alias("at")
    whole = marked.where("shared").groupBy("item_id", "form").agg(spans, F.min("item_tokens").alias("item_tokens")).withColumn("reach", F.expr(COVERED))
    short = whole.where(F.col("reach") < F.least(F.lit(cover), F.col("item_tokens"))).select(F.col("item_id").alias("__item"), F.col("form").alias("__form"))
    same = F.col("item_id").eqNullSafe(F.col("__item")) & (F.col("form") == F.col("__form"))
    verifying = marked.where("shared").join(short, same, "left_semi").drop("shared")
    finding = marked.where("shared is null").drop("shared").unionByName(marked.where("shared").join(short, same, "left_anti").drop("shared"))
    return finding, verifying


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out &= c
    return out


def _hits(batch, out):
    row, form, pos, key, slots = zip(*out)
    rows = pa.array(row, pa.int64())
    return pa.record_batch(
        [batch.column("doc_id").take(rows), batch.column("h").take(rows), pa.array(form, pa.int32()), pa.array(pos, pa.int64()), pa.array(key, pa.int64()), pa.array(slots, pa.list_(pa.int64()))],
        ["doc_id", "h", "form", "pos", "window", "slots"],
    )


def flag_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, contaminated, items, reparameterised) for each row, repeated ones too; items in ascending order, empty if there are none. An empty table gives an empty one."""
    leaks = find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    flags = leaks.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("reparameterised").alias("reparameterised"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    d, f = rows.alias("d"), flags.alias("f")
    out = d.join(f, (F.col("d.h") == F.col("f.h")) & F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), "left")
    return out.select("d.doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, in all their columns, that hold no item; none may be named __own."""
    leaks = find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct().hint("merge")
    rows = docs.withColumn("__own", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return rows.join(leaks, (F.col("__own") == F.col("__h")) & F.col(id_col).cast("bigint").eqNullSafe(F.col("__id")), "left_anti").drop("__own")

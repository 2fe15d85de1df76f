"""Secret scans: certain patterns, and weak parts that count only together.

Certain spans are assignments, access identifiers and long hex strings. A weak
part, such as a 40-character secret without a name, is reported only if a
complementary part (an access identifier, an assignment or an endpoint) lies in
its scope, ``SCOPE`` code points either way. Everything is built-in column
functions and joins.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.shared import materialise

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
#: A secret without a name: a run of 24 or more characters of base 64 with a digit and a capital letter.
WEAK_SECRET = r"(?<![A-Za-z0-9/+=_-])(?=[A-Za-z/+]*[0-9])(?=[a-z0-9/+]*[A-Z])[A-Za-z0-9/+]{24,}={0,2}(?![A-Za-z0-9/+=_-])"
ENDPOINT = r"(?:https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9][A-Za-z0-9.:@/_-]*"

KINDS = ("assign", "access", "hex", "weak_secret", "weak_endpoint")
SCOPE = 300
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Elements of an array that a running value is taken over at once.
RUN = 256
#: Code points of the blocks that a text is cut into before pieces are taken from it.
CUT = 4096


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def running(values: Column, step) -> Column:
    """What ``step`` (sum or maximum, from 0) gives over the integers before each.

    Adding to an array copies it, so that one aggregate over a long array would
    be quadratic: values are taken in runs, and runs by their totals.
    """

    def over(xs):
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, start, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))

    firsts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(RUN))).otherwise(F.array().cast("array<int>"))
    runs = F.transform(firsts, lambda k: over(F.slice(values, k, RUN)))
    return _let(runs, lambda r: F.flatten(F.zip_with(r, over(F.transform(r, lambda x: x["at"]))["out"], lambda x, o: F.transform(x["out"], lambda v: step(o, v)))))


def find_all(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of leftmost non-overlapping matches whose ``group`` has ``least`` characters, in code points.

    The parts between matches and the matches add up to the text, so running
    lengths give the places.
    """
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    size = lambda x: F.transform(x, F.length)
    lengths = F.arrays_zip(F.slice(size(parts), 1, F.size(found)).alias("p"), size(found).alias("m"), size(value).alias("v"))

    def spans(rows):
        starts = running(F.transform(rows, lambda r: r["p"] + r["m"]), lambda x, y: x + y)
        placed = F.zip_with(rows, starts, lambda r, at: F.struct((at + r["p"]).alias("start"), F.lit(kind).alias("kind"), (at + r["p"] + r["m"]).alias("end"), r["v"].alias("v")))
        kept = F.filter(placed, lambda s: s["v"] >= least)
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    return F.when(text.rlike(pattern), _let(lengths, spans)).otherwise(F.array().cast(SPAN))


def _links(rows: DataFrame) -> DataFrame:
    """(key, linked spans): weak spans with a complementary part in scope, by an interval join over bins as wide as the scope.

    Each (key, bin, role) is first reduced to its smallest and largest start:
    a part in the same bin is in scope, and of the bins beside it the nearest
    part decides. A weak span thus meets at most three rows a role.
    """
    parts = rows.select("__key", F.explode(F.concat("__base", "__weak")).alias("s")).distinct().select("__key", "s", F.floor(F.col("s.start") / SCOPE).alias("bin"))
    # hex strings and unnamed secrets are secrets; the others tell whose or where
    others = parts.where(F.col("s.kind").isin(0, 1, 4))
    near = others.groupBy("__key", "bin", F.col("s.kind").alias("role")).agg(F.min("s.start").alias("lo"), F.max("s.start").alias("hi"))
    around = near.select("__key", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), "role", "lo", "hi")
    weak = parts.where(F.col("s.kind").isin(3, 4))
    in_scope = (F.abs(F.col("lo") - F.col("s.start")) <= SCOPE) | (F.abs(F.col("hi") - F.col("s.start")) <= SCOPE)
    # a secret needs any other part; an endpoint needs an access identifier, an assignment or an unnamed secret
    secrets = weak.where("s.kind = 3").join(around, ["__key", "bin"]).where(in_scope)
    holders = parts.where(F.col("s.kind").isin(0, 1, 3)).groupBy("__key", "bin").agg(F.min("s.start").alias("lo"), F.max("s.start").alias("hi"))
    round_holders = holders.select("__key", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), "lo", "hi")
    ends = weak.where("s.kind = 4").join(round_holders, ["__key", "bin"]).where(in_scope)
    both = secrets.select("__key", "s").unionByName(ends.select("__key", "s")).distinct()
    return both.groupBy("__key").agg(F.array_sort(F.collect_list("s")).alias("__linked"))


def find_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``base`` and ``spans``, arrays of (start, kind, end) in order.

    A null text is empty; an empty table gives an empty one; columns named base
    and spans are replaced. ``base`` holds the certain spans, ``spans`` those and
    the linked weak ones that no certain span overlaps. Matching is local to a
    row; only rows with weak parts and something to link them to are shuffled,
    each by a number of its own, so copies of a text don't meet.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("base", "spans")]
    body = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(*keep, body.alias("__body"))
    base = F.array_sort(F.concat(find_all(F.col("__body"), ASSIGN, 0, 2, 8), find_all(F.col("__body"), ACCESS, 1, 0, 16), find_all(F.col("__body"), HEX, 2)))
    weak = F.concat(find_all(F.col("__body"), WEAK_SECRET, 3), find_all(F.col("__body"), ENDPOINT, 4))
    found = named.select(*keep, base.alias("__base"), weak.alias("__weak"))
    free = "filter(__weak, w -> not exists(__base, b -> b.start < w.end and w.start < b.end))"
    ready = found.select(*keep, "__base", F.expr(f"case when size(__weak) > 0 then {free} else __weak end").alias("__weak"), F.monotonically_increasing_id().alias("__key"))
    # the numbers are written, so they stay as they are
    scanned = materialise(ready, "secret-spans")
    roles = "size(__weak) > 0 and size(__base) + size(__weak) > 1"
    linked = scanned.where(roles).join(_links(scanned.where(roles)), "__key", "left")
    alone = scanned.where(f"not ({roles})").withColumn("__linked", F.lit(None).cast(SPAN))
    rows = alone.unionByName(linked)
    return rows.select(*keep, F.col("__base").alias("base"), F.array_sort(F.concat("__base", F.coalesce("__linked", F.array().cast(SPAN)))).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")


def redact(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with each run of overlapping spans replaced by a mark.

    A piece of a text is found by counting from its start, so pieces are taken
    from blocks of ``CUT`` code points: the work follows the text's length.
    """
    block = lambda at: F.floor(at / CUT).cast("int")

    def piece(blocks, lo, hi):
        own = F.array_join(F.slice(blocks, block(lo) + 1, block(hi) - block(lo) + 1), "")
        return F.substr(own, F.pmod(lo, F.lit(CUT)) + 1, hi - lo)

    def pieces(blocks):
        # ``to``: where the spans before each end
        ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
        opening = F.filter(F.zip_with(spans, ends, lambda s, to: F.struct(s["start"].alias("start"), to.alias("to"))), lambda s: s["start"] >= s["to"])
        kept = F.transform(opening, lambda s: F.concat(piece(blocks, s["to"], s["start"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), piece(blocks, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(blocks, pieces)).otherwise(text)

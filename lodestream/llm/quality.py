"""Quality rules as a ledger of bits, with policies applied afterwards.

Every rule is evaluated once; the ledger holds its measurements and one failure
bit per rule. A policy is a version with the mask of rules that reject, so that
changing a policy or asking what a rule alone rejects never reads a text again.
Everything is built-in column functions; no shuffle before the ablation report.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Each rule's bit and the condition under which a document fails it, over the measurements.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 10"),
    "repeated_windows": (1, "100 * n_repeat_words > 20 * n_words"),
    "symbols": (2, "100 * n_symbols > 20 * n_words"),
    "duplicate_lines": (3, "n_dup_lines >= 3 and 100 * n_dup_lines > 40 * n_lines"),
    "long_words": (4, "n_words > 0 and word_chars > 15 * n_words"),
    "no_letters": (5, "2 * n_letters < word_chars"),
}
BASE = ("few_words", "repeated_windows")

#: Rules that reject, by version; a version never changes once used.
POLICIES: dict[int, tuple[str, ...]] = {
    1: BASE,
    2: (*BASE, "symbols", "duplicate_lines"),
    3: (*BASE, "symbols", "duplicate_lines", "long_words", "no_letters"),
    4: (*BASE, "symbols", "duplicate_lines", "long_words"),  # short prose with long numbers or keys is kept, for redaction
}
LATEST = max(POLICIES)


def mask(rules) -> int:
    return sum(1 << RULES[r][0] for r in rules)


def _repeat_words(windows: str, order: str) -> tuple[Column, Column]:
    """Two steps over an array of window hashes: those that recur in order of their hash, then the words they cover."""
    # sorting is left to texts with a recurring window
    ordered = F.expr(
        f"case when size(array_distinct({windows})) < size({windows}) then array_sort(transform({windows}, (h, i) -> struct(h as h, i as i))) end"
    )
    starts = (
        f"array_sort(transform(filter({order}, (x, k) -> (k > 0 and get({order}, k - 1).h = x.h) or (k + 1 < size({order}) and get({order}, k + 1).h = x.h)), x -> x.i))"
    )
    return ordered, F.expr(starts)


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the measurements and ``failure_bits`` to each row of ``docs``; columns of those names, in any case, are replaced.

    Repeated rows are measured each; an empty table gives an empty one. A text
    is held whole in the JVM, also as its words and windows. Windows are told apart by 64-bit hashes, not confirmed on words:
    of a million windows two differ and collide with odds of 1 in 36 million.

    A null or empty text has no words, so it fails few_words and no rule that
    divides by words. Lines are parted by \\n; only lines with a word count.
    Windows are 5 words as written; ``n_repeat_words`` counts the words in
    windows that occur at least twice.
    """
    keep = [c for c in docs.columns if c.lower() not in (*MEASURES, "failure_bits")]
    body = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.select(*keep, body.alias("__body"), F.array_remove(F.split(body, SPACE), "").alias("__words"))
    b = a.select(
        *keep,
        "__body",
        "__words",
        F.filter(F.split("__body", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
        F.expr(
            "case when size(__words) >= 5 then transform(sequence(0, size(__words) - 5), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2], __words[i + 3], __words[i + 4])) else array() end"
        ).alias("__windows"),
    )
    ordered, starts = _repeat_words("__windows", "__ordered")
    c = b.select(*keep, "__body", "__words", "__lines", ordered.alias("__ordered"))
    d = c.select(*keep, "__body", "__words", "__lines", starts.alias("__starts"))
    measured = d.select(
        *keep,
        F.size("__words").cast("bigint").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("__body", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(
            F.expr("aggregate(zip_with(__starts, slice(__starts, 2, size(__starts)), (x, y) -> least(5, coalesce(y - x, 5))), 0L, (s, x) -> s + x)"), F.lit(0)
        ).cast("bigint").alias("n_repeat_words"),
        F.length(F.regexp_replace("__body", r"[^\p{L}]+", "")).cast("bigint").alias("n_letters"),
    )
    bits = " + ".join(f"case when {fails} then {1 << bit}L else 0L end" for bit, fails in RULES.values())
    return measured.withColumn("failure_bits", F.expr(bits))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters")


def passes(version: int = LATEST, bits: str = "failure_bits") -> Column:
    """Whether a ledger row is kept under a policy."""
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[version]))) == 0


def ablations(rows: DataFrame, bits: str = "failure_bits") -> DataFrame:
    """Per policy version and rule of it: documents, kept, failing the rule, and kept only if the rule were left out.

    Documents are first counted by their bits, of which there are at most
    2 to the number of rules, so the report is made from those counts.
    """
    counts = rows.groupBy(F.col(bits).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    spark = rows.sparkSession
    table = spark.createDataFrame(
        [(v, r, 1 << RULES[r][0], mask(rules)) for v, rules in POLICIES.items() for r in rules], "version int, rule string, bit bigint, mask bigint"
    )
    some = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    failed = F.col("bits").bitwiseAND(F.col("mask"))
    # one row per rule and policy against one per set of bits: both sizes are fixed by RULES
    return (
        table.join(F.broadcast(counts), F.lit(True), "left")
        .groupBy("version", "rule")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("documents"),
            some(failed == 0)("kept"),
            some(F.col("bits").bitwiseAND(F.col("bit")) != 0)("failing"),
            some(failed == F.col("bit"))("only_this"),
        )
    )

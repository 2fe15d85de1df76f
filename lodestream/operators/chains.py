"""Conditional updates by links between attempts, for ids with any share of the rows.

An attempt that is accepted at revision r is followed by the first later
attempt that names r + 1, so each attempt has at most one successor, whatever
is accepted in the end. The accepted ones are those that can be reached from
the stored revision; they are found in rounds of joins that double the length
of a jump, so an id with a chain of n attempts takes log2(n) rounds and is
spread over tasks by (id, seq).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators.asof import carry_last
from lodestream.operators.records import first_match
from lodestream.sources.shared import discard, materialise

#: Doubles hold every integer up to here; a revision named beyond it matches none.
EXACT = 1 << 53


def _nodes(records: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, seq, level): the revision that an attempt names; and heads (id, level): stored revisions, of the first record of an id."""
    named = F.col("expected").cast("double")
    whole = attempts.where(F.col("id").isNotNull() & (F.abs(named) < EXACT) & (F.floor(named) == named))
    heads = first_match(records).where("id is not null and revision is not null").select("id", F.col("revision").cast("bigint").alias("level"))
    return whole.select("id", F.col("seq").cast("bigint").alias("seq"), named.cast("bigint").alias("level")), heads


def successors(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """(id, seq, next): the first later attempt that names the next revision; seq is null for a stored record."""
    none = F.lit(None).cast("bigint")
    asking = nodes.select("id", (F.col("level") + 1).alias("level"), "seq", none.alias("target")).unionByName(heads.select("id", "level", none.alias("seq"), none.alias("target")))
    asked = nodes.select("id", "level", "seq", F.col("seq").alias("target"))
    rows = asking.unionByName(asked)
    # from the last to the first: the target last met is the first later one
    met = carry_last(rows, ["id", "level"], [F.col("seq").desc_nulls_last()], "target", "next")
    return met.where("target is null and next is not null").select("id", "seq", "next")


def accepted(records: DataFrame, attempts: DataFrame) -> DataFrame:
    """(id, seq) of the accepted attempts."""
    links = materialise(successors(*_nodes(records, attempts)), "links")
    reached = materialise(links.where("seq is null").select("id", F.col("next").alias("seq")), "reached")
    jumps = materialise(links.where("seq is not null"), "jumps")
    discard(links)
    while True:
        far = materialise(reached.join(jumps, ["id", "seq"]).select("id", F.col("next").alias("seq")), "reached")
        if far.isEmpty():
            break
        further = jumps.join(jumps.select("id", F.col("seq").alias("next"), F.col("next").alias("__next")), ["id", "next"]).select("id", "seq", F.col("__next").alias("next"))
        reached, jumps, done = materialise(reached.unionByName(far), "reached"), materialise(further, "jumps"), (reached, jumps, far)
        discard(*done)
    discard(far, jumps)
    return reached


def no_repeats(attempts: DataFrame) -> None:
    """Raises if an (id, seq) is repeated."""
    repeated = attempts.where("id is not null").groupBy("id", "seq").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{repeated[0]['id']!r} has two attempts of seq {repeated[0]['seq']}")


def apply_linked(records: DataFrame, attempts: DataFrame) -> DataFrame:
    """Outcomes (id, seq, status, revision), equal to those of ``apply_attempts``.

    Ids and records as there, seqs not null; of records with one id the first
    is meant. A repeated (id, seq) raises. No step gathers an id: links and
    current revisions are carried along ranges of rows (``carry_last``), jumps
    are joined by (id, seq).
    """
    asked = attempts.select("id", F.col("seq").cast("bigint").alias("seq"), F.col("expected").cast("double").alias("expected"))
    no_repeats(asked)
    won = accepted(records, asked).withColumn("__won", F.lit(True))
    tried = asked.join(won, ["id", "seq"], "left").select("id", "seq", F.when(F.col("__won"), F.col("expected").cast("bigint") + 1).alias("made"), F.lit(False).alias("__stored"))
    stored = first_match(records).select("id", F.lit(None).cast("bigint").alias("seq"), F.col("revision").cast("bigint").alias("made"), F.lit(True).alias("__stored"))
    rows = materialise(tried.unionByName(stored.where("id is not null")), "tried")
    seen = carry_last(rows, ["id"], [F.col("seq").asc_nulls_first()], "made", "revision")
    status = F.when(F.col("made").isNotNull(), 200).when(F.col("revision").isNotNull(), 409).otherwise(404)
    return seen.where(~F.col("__stored")).select("id", "seq", status.alias("status"), "revision")

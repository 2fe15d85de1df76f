"""Conditional updates: a write is accepted only if it names the current revision."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from lodestream.operators.bodies import MOST_BYTES, classify_bodies
from lodestream.operators.records import first_match


def parse_bodies(requests: DataFrame, body: str = "body") -> DataFrame:
    """JSON bodies to attempts: adds ``bad``, ``expected`` and ``content``, as ``classify_bodies`` reads them; bad is a body that is refused."""
    return classify_bodies(requests, body).withColumn("bad", F.col("refused").isNotNull()).drop("refused")


def apply_attempts(records: DataFrame, attempts: DataFrame, as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Applies each id's attempts in ascending ``seq``; returns (outcomes, next records).

    records: (id, revision, content, ...), of which the first of an id is meant
    (``first_match``; the others stay as they are); attempts: (id, seq,
    expected double, content), seq unique in an id: a repeated one raises. Outcomes: id, seq, status
    (200, 409 or 404) and the revision after the attempt (null for 404). An
    accepted write sets the content (null: empty), adds one to the revision and
    sets ``updatedAt`` to ``as_of`` if that is given; next records keep their
    columns and hold records without attempts unchanged.

    One shuffle on id, without contents; rows are sorted by id and seq and
    streamed with the current revision as the only state, so an id may have any
    number of attempts. The content of an id's last accepted attempt is joined.
    """
    firsts = first_match(records)
    stored = firsts.where("id is not null").select("id", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("double").alias("expected"), F.col("revision").cast("bigint").alias("rev"), F.lit(True).alias("stored"))
    asked = attempts.select("id", F.col("seq").cast("bigint").alias("seq"), F.col("expected").cast("double").alias("expected"), F.lit(None).cast("bigint").alias("rev"), F.lit(False).alias("stored"))
    rows = stored.unionByName(asked).repartition("id").sortWithinPartitions("id", F.col("stored").desc(), "seq", "expected")
    kind = rows.schema["id"].dataType
    outcomes = rows.mapInArrow(_outcomes, StructType().add("id", kind).add("seq", LongType()).add("status", IntegerType()).add("revision", LongType()))
    last = rows.mapInArrow(_last, StructType().add("id", kind).add("seq", LongType()).add("_rev", LongType()))
    contents = attempts.select("id", F.col("seq").cast("bigint").alias("seq"), F.coalesce("content", F.lit("")).alias("_content"))
    changed = last.join(contents, ["id", "seq"]).select("id", "_rev", "_content", F.lit(True).alias("_new"))
    new = {"revision": F.col("_rev"), "content": F.col("_content")}
    if as_of is not None and "updatedAt" in records.columns:
        new["updatedAt"] = F.lit(as_of).cast("timestamp")
    if firsts is not records:  # only the first record of an id changes
        changed = changed.join(firsts.select("id", F.col("ord").alias("_ord")), "id")
        joined = records.join(changed, (records["id"] == changed["id"]) & (records["ord"] == changed["_ord"]), "left").drop(changed["id"])
    else:
        joined = records.join(changed, "id", "left")
    return outcomes, joined.select(*[F.when(F.col("_new"), new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in records.columns])


def responses(records: DataFrame, attempts: DataFrame, as_of: str | None = None) -> DataFrame:
    """Per attempt: id, seq, status, error, ``row`` (the accepted record, for 200) and ``current`` (the stored one, for 409).

    A record after an attempt is the one of its id and revision then: the
    stored one, or that of the attempt which made the revision.
    """
    records = first_match(records)
    outcomes = apply_attempts(records, attempts)[0]
    written = attempts.select("id", F.col("seq").cast("bigint").alias("seq"), F.coalesce("content", F.lit("")).alias("_content"))
    made = outcomes.where("status = 200").join(written, ["id", "seq"]).select("id", "revision", "_content", F.lit(True).alias("_new"))
    kept = records.select("id", F.col("revision").cast("bigint").alias("revision"), F.col("content").alias("_content"), F.lit(False).alias("_new"))
    others = [c for c in records.columns if c not in ("id", "revision", "content")]
    found = outcomes.join(made.unionByName(kept), ["id", "revision"], "left").join(records.select("id", *others), "id", "left")
    if as_of is not None and "updatedAt" in others:
        found = found.withColumn("updatedAt", F.when(F.col("_new"), F.lit(as_of).cast("timestamp")).otherwise(F.col("updatedAt")))
    record = F.struct(*(F.col("_content").alias(c) if c == "content" else F.col(c) for c in records.columns))
    error = F.when(F.col("status") == 404, "not_found").when(F.col("status") == 409, "revision_conflict")
    return found.select("id", "seq", "status", error.alias("error"), F.when(F.col("status") == 200, record).alias("row"), F.when(F.col("status") == 409, record).alias("current"))


def apply_bodies(records: DataFrame, requests: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Outcomes (id, seq, status, revision) of requests (id, seq, body).

    Too large and malformed bodies are answered 413 and 400, whatever their id
    (``classify_bodies``), a missing body 500, or 404 where there is no record;
    all others as ``apply_attempts`` gives them.
    """
    seq = F.col("seq").cast("bigint").alias("seq")
    parsed = classify_bodies(requests, most_bytes=most_bytes)
    none = F.lit(None).cast("bigint").alias("revision")
    bad = parsed.where("refused in (413, 400)").select("id", seq, F.col("refused").alias("status"), none)
    known = first_match(records).where("id is not null").select("id", F.lit(True).alias("_hit")).distinct()
    absent = parsed.where("refused = 500").join(known, "id", "left").select("id", seq, F.when(F.col("_hit"), 500).otherwise(404).alias("status"), none)
    taken = parsed.where("refused is null").select("id", "seq", "expected", "content")
    return bad.unionByName(absent).unionByName(apply_attempts(records, taken)[0])


def _fold(batches):
    """Yields (batch, status of each row, revisions after it, rows that are attempts, ids that ended with (id, seq, revision) of the last accepted one)."""
    current, hit, rev, accepted, last = None, False, None, None, None
    for batch in batches:
        status, after, asked, ended = [], [], [], []
        columns = (batch.column(k).to_pylist() for k in ("id", "seq", "expected", "rev", "stored"))
        for i, (key, seq, expected, stored_rev, stored) in enumerate(zip(*columns)):
            if stored or key != current:
                if accepted:
                    ended.append(accepted)
                current, hit, rev, accepted, last = key, stored, stored_rev, None, None
            if stored:
                continue
            if last == (seq,):
                raise ValueError(f"{key!r} has two attempts of seq {seq}")
            last = (seq,)
            if not hit:
                status.append(404)
            elif expected == (None if rev is None else float(rev)):
                status.append(200)
                if rev is not None:
                    rev += 1
                    accepted = (key, seq, rev)
            else:
                status.append(409)
            after.append(rev)
            asked.append(i)
        yield batch, status, after, asked, ended
    if accepted:
        yield None, [], [], [], [accepted]


def _outcomes(batches):
    for batch, status, after, asked, _ in _fold(batches):
        if asked:
            own = batch.take(pa.array(asked, pa.int64()))
            yield pa.record_batch([own.column("id"), own.column("seq"), pa.array(status, pa.int32()), pa.array(after, pa.int64())], ["id", "seq", "status", "revision"])


def _last(batches):
    kind = None
    for batch, _, _, _, ended in _fold(batches):
        kind = kind if batch is None else batch.column("id").type
        if ended:
            key, seq, rev = zip(*ended)
            yield pa.record_batch([pa.array(key, kind), pa.array(seq, pa.int64()), pa.array(rev, pa.int64())], ["id", "seq", "_rev"])

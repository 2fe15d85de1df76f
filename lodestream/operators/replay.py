"""Reads, writes and analyses against one store that changes as they arrive.

The accepted writes are found by links (``chains``), so nothing waits for the
request before it; every request is then paired with the revision in force at
its place by an as-of join. Ids may hold any share of the requests.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import line_count
from lodestream.operators.asof import carry_last
from lodestream.operators.bodies import classify_bodies
from lodestream.operators.chains import accepted, no_repeats
from lodestream.operators.records import etag_matches, first_match
from lodestream.sources.shared import materialise

OPS = ("GET", "PUT", "ANALYZE")
#: Bytes of (id, revision) up to which a list of them goes to every task.
SENT = 16 << 20


def _parsed(requests: DataFrame) -> DataFrame:
    """(id, seq, op, at, header, refused, expected, content) of requests; optional columns are null where they are missing."""
    has = lambda c, kind: (F.col(c) if c in requests.columns else F.lit(None)).cast(kind)
    op = F.upper("op")
    known = F.when(op.isin(*OPS), op).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
    rows = requests.select("id", F.col("seq").cast("bigint").alias("seq"), known.alias("op"), has("at", "bigint").alias("at"), has("if_none_match", "string").alias("header"), has("body", "string").alias("body"))
    return materialise(classify_bodies(rows).drop("body"), "requests")


def _written(records: DataFrame, parsed: DataFrame) -> DataFrame:
    """The requests with ``made``, the revision that an accepted write makes."""
    puts = parsed.where("op = 'PUT' and refused is null").select("id", "seq", "expected")
    won = accepted(records, puts).withColumn("__won", F.lit(True))
    made = F.when(F.col("__won"), F.col("expected").cast("bigint") + 1)
    return materialise(parsed.join(won, ["id", "seq"], "left").withColumn("made", made).drop("__won"), "written")


def _stored(records: DataFrame, like: DataFrame) -> DataFrame:
    """Stored revisions as rows before all requests."""
    values = {"id": F.col("id"), "made": F.col("revision").cast("bigint"), "op": F.lit("STORED")}
    return first_match(records).where("id is not null").select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields))


def _asked(records: DataFrame, answered: DataFrame) -> DataFrame:
    """The records whose stored content is sent; where a list of these is at most SENT bytes, contents of others never leave their task."""
    sent = answered.where("status in (200, 409)").select("id", "revision").distinct()
    size = sent.agg(F.coalesce(F.sum(F.octet_length(F.col("id").cast("string")) + 40), F.lit(0))).first()[0]
    if size > SENT:
        return records
    stored = first_match(records).withColumn("__revision", F.col("revision").cast("bigint"))
    listed = sent.select("id", F.col("revision").alias("__revision"))
    return stored.join(F.broadcast(listed), ["id", "__revision"], "left_semi").select(*records.columns)


def _versions(records: DataFrame, written: DataFrame) -> DataFrame:
    """(id, revision, text) of every revision there is: the stored ones and those that writes made."""
    stored = first_match(records).where("id is not null").select("id", F.col("revision").cast("bigint").alias("revision"), F.col("content").alias("text"))
    return stored.unionByName(written.where("made is not null").select("id", F.col("made").alias("revision"), F.coalesce("content", F.lit("")).alias("text")))


def replay(records: DataFrame, requests: DataFrame) -> DataFrame:
    """What each request of a log is answered: id, seq, op, status, error, etag, revision, content, lines.

    records: (id, revision, content), of which the first of an id is meant
    (``first_match``). requests: (id, seq, op) with op GET, PUT or ANALYZE, and
    optionally a JSON ``body`` and ``if_none_match``. seq is the order of
    arrival, of which only that within an id matters; a repeated (id, seq) or an
    unknown op raises. Each request meets the store as the writes before it left it.

    Bodies that are refused (``classify_bodies``) are answered 413 or 400,
    whatever the id; then an unknown id, also a null one, 404; then 500 for a
    write or analysis without a body. A write is 200 or 409 by its revision, a
    read 200, or 304 if its header names the etag. revision is the one in force
    after the request; content is that of the record which is sent (200 and, as
    the current one, 409); lines are those of an analysis' draft or of the
    record. No records: every answer is 404; no requests: no rows.
    """
    parsed = _parsed(requests)
    no_repeats(parsed)
    written = _written(records, parsed)
    rows = written.drop("content").unionByName(_stored(records, written).drop("content"))
    seen = carry_last(rows, ["id"], [F.col("seq").asc_nulls_first()], "made", "revision").where("op <> 'STORED'")
    status = (
        F.when(F.col("refused").isin(413, 400), F.col("refused"))
        .when(F.col("revision").isNull(), 404)
        .when(F.col("op") == "GET", F.when(etag_matches(F.col("header"), F.col("revision").cast("string")), 304).otherwise(200))
        .when(F.col("refused") == 500, 500)
        .when((F.col("op") == "ANALYZE") | F.col("made").isNotNull(), 200)
        .otherwise(409)
    )
    answered = seen.select("id", "seq", "op", status.alias("status"), F.when(~F.coalesce(F.col("refused").isin(413, 400), F.lit(False)), F.col("revision")).alias("revision"))
    drafts = written.where("op = 'ANALYZE' and content is not null").select("id", "seq", line_count(F.col("content")).alias("draft_lines"))
    answered = materialise(answered, "answered")
    told = answered.where("status in (200, 409)").join(_versions(_asked(records, answered), written), ["id", "revision"]).join(drafts, ["id", "seq"], "left")
    content = F.when(F.col("op") != "ANALYZE", F.col("text"))
    lines = F.when(F.col("op") == "ANALYZE", F.coalesce("draft_lines", line_count(F.col("text"))))
    full = told.select("id", "seq", "op", "status", "revision", content.alias("content"), lines.alias("lines"))
    rest = answered.where("status not in (200, 409)").select("id", "seq", "op", "status", "revision", F.lit(None).cast("string").alias("content"), F.lit(None).cast("bigint").alias("lines"))
    names = {400: "bad_request", 404: "not_found", 409: "revision_conflict", 413: "too_large", 500: "internal"}
    error = F.element_at(F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.lit(v)))), F.col("status"))
    etag = F.when(F.col("op").eqNullSafe("GET") & F.col("status").isin(200, 304), F.col("revision").cast("string"))
    return full.unionByName(rest).select("id", "seq", "op", "status", error.alias("error"), etag.alias("etag"), "revision", "content", "lines")


def list_at(records: DataFrame, requests: DataFrame, place: int) -> DataFrame:
    """What a list request is answered before the request ``place`` of a log: every stored record without its content, with the revision then in force.

    requests as for ``replay``, with seq as the order over all ids. All records
    are listed, in no order (``ord`` gives theirs); of those that share an id
    only the first is written to. Only writes before ``place`` are read.
    """
    parsed = _parsed(requests.where((F.upper("op") == "PUT") & (F.col("seq") < place)))
    no_repeats(parsed)
    last = _written(records, parsed).where("made is not null").groupBy("id").agg(F.max("made").alias("__made"))
    one = ["id", *(["ord"] if "ord" in records.columns else [])]
    changed = last.join(first_match(records).select(*one), "id")
    summaries = [c for c in records.columns if c != "content"]
    revision = F.coalesce("__made", F.col("revision").cast("bigint")).alias("revision")
    return records.select(*summaries).join(changed, one, "left").select(*(revision if c == "revision" else c for c in summaries))


def analyze_delayed(records: DataFrame, requests: DataFrame, delay: Column) -> DataFrame:
    """Analyses that are answered some time after they arrive: id, seq, status, error, ready, revision, lines.

    requests as for ``replay``, with PUT and ANALYZE rows and ``at``, the
    milliseconds of arrival, in the order of seq. An analysis waits for
    ``delay``, a column of milliseconds over id, and is then answered with the
    revision in force: its interval runs from the write that made it, inclusive,
    to the next. So a draft can be paired with a revision newer than the one it
    was sent for. The delay only moves the moment of the answer; an unknown id is
    404 and a refused body 413 or 400 on arrival.
    """
    parsed = _parsed(requests)
    no_repeats(parsed)
    written = _written(records, parsed)
    ready = F.col("at") + F.when(F.col("op") == "ANALYZE", delay).otherwise(0)
    rows = written.drop("content").unionByName(_stored(records, written).drop("content")).withColumn("ready", ready.cast("bigint"))
    order = [F.col("ready").asc_nulls_first(), F.when(F.col("op") == "ANALYZE", 1).otherwise(0).asc(), F.col("seq").asc_nulls_first()]
    seen = carry_last(rows, ["id"], order, "made", "revision").where("op = 'ANALYZE'")
    status = F.when(F.col("refused").isin(413, 400), F.col("refused")).when(F.col("revision").isNull(), 404).when(F.col("refused") == 500, 500).otherwise(200)
    answered = seen.select("id", "seq", "ready", status.alias("status"), F.when(status == 200, F.col("revision")).alias("revision"))
    texts = _versions(records, written).select("id", "revision", line_count(F.col("text")).alias("stored_lines"))
    drafts = written.where("op = 'ANALYZE' and content is not null").select("id", "seq", line_count(F.col("content")).alias("draft_lines"))
    out = answered.join(texts, ["id", "revision"], "left").join(drafts, ["id", "seq"], "left")
    error = F.when(F.col("status") == 404, "not_found").when(F.col("status") == 400, "bad_request").when(F.col("status") == 413, "too_large").when(F.col("status") == 500, "internal")
    return out.select("id", "seq", "status", error.alias("error"), "ready", "revision", F.when(F.col("status") == 200, F.coalesce("draft_lines", "stored_lines")).alias("lines"))

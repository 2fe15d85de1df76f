"""The record operators over the driver's tables, with the SQL that should agree.

Documents serve as records, conversations as update attempts (their turn is the
order) and labels as the records that those attempts meet.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import (
    analyze,
    apply_attempts,
    apply_bodies,
    apply_linked,
    conditional_lookup,
    count_records,
    get_by_id,
    list_summaries,
    lookup,
    responses,
)
from lodestream.operators import analyze_delayed as answer_delayed
from lodestream.operators import list_at as list_before
from lodestream.operators import replay as answer_log
from lodestream.sources import read_table
from lodestream.sources.shared import new_path
from lodestream.streaming import keyed_state, revise_in_order, revise_stream


def bootstrap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_records(read_table(spark, sf_dir, "documents"), "records")


def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_summaries(read_table(spark, sf_dir, "documents"), "text")


def get_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's id looked up among the labelled documents: hits and 404s."""
    keys = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    records = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("bigint").alias("revision"), "toxic")
    return lookup(records, keys)


def get_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document by its id, which reaches the scan."""
    return get_by_id(read_table(spark, sf_dir, "documents"), 7, "doc_id")


def get_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have a label record, by status."""
    keys = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    records = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return lookup(records, keys).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def analyze_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return analyze(records).select("id", "lines")


def analyze_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns of conversations as drafts of the documents with their ids."""
    records = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    turns = read_table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("id"), F.col("text").alias("draft"))
    drafts = records.select("id").join(turns, "id", "left")
    return analyze(records, drafts).select("id", "status", "lines")


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn").cast("bigint")
    return read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("id"), turn.alias("seq"), F.floor(turn / 2).cast("double").alias("expected"), F.col("text").alias("content")
    )


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.lit(0).cast("bigint").alias("revision"), F.lit("").alias("content"))


def put_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt per labelled document, against revision 3, naming 3 + quality."""
    records = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit(3).cast("bigint").alias("revision"), F.col("text").alias("content"))
    attempts = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("id"), F.lit(0).cast("bigint").alias("seq"), (3 + F.col("quality")).cast("double").alias("expected"), F.lit("new").alias("content")
    )
    return apply_attempts(records, attempts)[0].select("id", "status", "revision")


def put_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_attempts(_store(spark, sf_dir), _attempts(spark, sf_dir))[0]


def put_sequence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after the sequence: revisions and content lengths."""
    _, after = apply_attempts(_store(spark, sf_dir), _attempts(spark, sf_dir))
    return after.select("id", "revision", F.length("content").cast("bigint").alias("content_chars"))


def put_sequence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence by successor links and pointer doubling."""
    return apply_linked(_store(spark, sf_dir), _attempts(spark, sf_dir))


def put_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each attempt of the sequence is answered: the accepted record, or the stored one that it conflicts with."""
    answers = responses(_store(spark, sf_dir), _attempts(spark, sf_dir))
    part = lambda c: [F.col(f"{c}.revision").alias(f"{c}_revision"), F.length(f"{c}.content").cast("bigint").alias(f"{c}_chars")]
    return answers.select("id", "seq", "status", "error", *part("row"), *part("current"))


def put_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence as JSON bodies: some cut off, missing, too large for a limit of 64 KB, or with the revision as a string."""
    asked = _attempts(spark, sf_dir)
    number = F.to_json(F.struct(F.col("expected").alias("revision"), "content"))
    text = F.to_json(F.struct(F.col("expected").cast("string").alias("revision"), "content"))
    body = (
        F.when(F.col("seq") % 8 == 7, F.concat(number, F.repeat(F.lit(" "), 1 << 16)))
        .when(F.col("seq") % 4 == 3, F.lit('{"revision":'))
        .when(F.col("seq") % 4 == 2, text)
        .when(F.col("seq") != 5, number)
    )
    return apply_bodies(_store(spark, sf_dir), asked.select("id", "seq", body.alias("body")), most_bytes=1 << 16)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as records of revision 0."""
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit(0).cast("bigint").alias("revision"), F.col("text").alias("content"))


def _asked_id() -> Column:
    """Conversations ask for the document of their id; those whose id ends in 3 for one that isn't there."""
    return F.when(F.col("conv_id") % 10 == 3, -F.col("conv_id")).otherwise(F.col("conv_id")).cast("string").alias("id")


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as logs of writes, conditional reads and analyses, by turns, against the documents."""
    turn = F.col("turn").cast("bigint")
    said = F.to_json(F.struct(F.col("text").alias("content")))
    op = F.when(turn % 3 == 0, "PUT").when(turn % 3 == 1, "GET").otherwise("ANALYZE")
    body = F.when(turn % 3 == 0, F.to_json(F.struct(F.floor(turn / 6).alias("revision"), F.col("text").alias("content")))).when(turn % 3 == 2, F.when(turn % 4 == 2, "{}").otherwise(said))
    header = F.when(turn % 3 == 1, F.when(turn % 4 == 1, "x, W/1").otherwise("7"))
    log = read_table(spark, sf_dir, "conversations").select(_asked_id(), turn.alias("seq"), op.alias("op"), body.alias("body"), header.alias("if_none_match"))
    answers = answer_log(_texts(spark, sf_dir), log)
    return answers.select("id", "seq", "op", "status", "error", "etag", "revision", F.length("content").cast("bigint").alias("content_chars"), "lines")


def list_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of labelled records as it stands before turn 5 of all conversations, taken as one log."""
    asked = _attempts(spark, sf_dir)
    body = F.to_json(F.struct(F.col("expected").alias("revision"), "content"))
    return list_before(_store(spark, sf_dir), asked.select("id", "seq", F.lit("PUT").alias("op"), body.alias("body")), 5)


def analyze_delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as writes and analyses 30 ms apart; answers take 100 ms for ids that end in 0, else 20."""
    turn = F.col("turn").cast("bigint")
    write = F.to_json(F.struct(F.floor(turn / 2).alias("revision"), F.col("text").alias("content")))
    draft = F.when(turn % 4 == 1, "{}").otherwise(F.to_json(F.struct(F.col("text").alias("content"))))
    log = read_table(spark, sf_dir, "conversations").select(
        _asked_id(), turn.alias("seq"), F.when(turn % 2 == 0, "PUT").otherwise("ANALYZE").alias("op"), (30 * turn).alias("at"), F.when(turn % 2 == 0, write).otherwise(draft).alias("body")
    )
    return answer_delayed(_texts(spark, sf_dir), log, F.when(F.col("id").endswith("0"), 100).otherwise(20))


def get_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as records that share an id: each labelled id gets the first one stored."""
    turns = read_table(spark, sf_dir, "conversations").select(F.col("turn").cast("bigint").alias("ord"), F.col("conv_id").alias("id"), (F.col("turn") + 3).cast("bigint").alias("revision"), "role", F.length("text").cast("bigint").alias("chars"))
    return lookup(turns, read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


def get_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels read by every document's id, with headers that name any, a weak, another or no tag."""
    key = F.col("doc_id")
    header = F.when(key % 4 == 0, "*").when(key % 4 == 1, 'W/1 ,"2"').when(key % 4 == 2, "0,7").otherwise("")
    keys = read_table(spark, sf_dir, "documents").select(key.alias("id"), header.alias("if_none_match"))
    records = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("bigint").alias("revision"), "toxic")
    return conditional_lookup(records, keys)


def put_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same attempts as a stream."""
    out = new_path(spark, "put-stream")
    table = f"{sf_dir}/conversations.parquet"
    schema = spark.read.parquet(table).schema
    # a single file is read by its folder and a name filter
    reader = spark.readStream.schema(schema)
    folder, _, name = table.rpartition("/")
    source = reader.parquet(table) if _is_dir(spark, table) else reader.option("pathGlobFilter", name).parquet(folder)
    turn = F.col("turn").cast("bigint")
    attempts = source.select(F.col("conv_id").cast("string").alias("id"), turn.alias("seq"), F.floor(turn / 2).cast("double").alias("expected"))
    query = (
        revise_stream(attempts, _store(spark, sf_dir))
        .writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema("id string, seq bigint, status int, revision bigint").parquet(f"{out}/rows")


def put_stream_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence as a stream that is out of order and is stopped half-way: both halves hold early and late turns of an id."""
    feed, out = new_path(spark, "attempts"), new_path(spark, "put-stream-ordered")
    late = F.pmod(F.xxhash64("id", "seq"), F.lit(2))
    attempts = _attempts(spark, sf_dir).select("id", "seq", "expected", F.timestamp_seconds(F.col("seq") + 1).alias("at"))
    clock = spark.range(1).select(F.lit(None).cast("string").alias("id"), F.lit(0).cast("bigint").alias("seq"), F.lit(None).cast("double").alias("expected"), F.timestamp_seconds(F.lit(10**10)).alias("at"))
    for rows in (attempts.where(late == 0), attempts.where(late == 1).unionByName(clock)):
        rows.repartition(2).write.mode("append").parquet(feed)
        with keyed_state(spark):
            query = (
                revise_in_order(spark.readStream.schema(attempts.schema).parquet(feed), _store(spark, sf_dir), delay="3650 days")
                .writeStream.format("parquet")
                .option("path", f"{out}/rows")
                .option("checkpointLocation", f"{out}/state")
                .trigger(availableNow=True)
                .start()
            )
        query.awaitTermination()
    return spark.read.schema("id string, seq bigint, status int, revision bigint").parquet(f"{out}/rows")


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


QUERIES = {
    "bootstrap_count": bootstrap_count,
    "list_summaries": list_documents,
    "get_by_id": get_records,
    "get_status": get_status,
    "analyze_lines": analyze_lines,
    "analyze_draft": analyze_draft,
    "put_single": put_single,
    "put_sequence": put_sequence,
    "put_sequence_state": put_sequence_state,
    "put_stream": put_stream,
    "get_one": get_one,
    "put_conflict": put_conflict,
    "put_bodies": put_bodies,
    "put_sequence_links": put_sequence_links,
    "replay": replay,
    "list_at": list_at,
    "analyze_delayed": analyze_delayed,
    "put_stream_ordered": put_stream_ordered,
    "get_first": get_first,
    "get_conditional": get_conditional,
}

_CHAIN = """
with recursive a as (
  select conv_id, turn, text, floor(turn / 2) as expected,
         row_number() over (partition by conv_id order by turn) as step
  from conversations),
r as (
  select a.conv_id, a.turn, a.step, l.doc_id is not null as hit,
         case when l.doc_id is null then 404 when a.expected = 0 then 200 else 409 end as status,
         case when l.doc_id is null then null when a.expected = 0 then 1 else 0 end::bigint as revision,
         case when a.expected = 0 then coalesce(a.text, '') else '' end as content
  from a left join labels l on a.conv_id = l.doc_id where a.step = 1
  union all
  select a.conv_id, a.turn, a.step, r.hit,
         case when not r.hit then 404 when a.expected = r.revision then 200 else 409 end,
         case when not r.hit then null when a.expected = r.revision then r.revision + 1 else r.revision end,
         case when a.expected = r.revision then coalesce(a.text, '') else r.content end
  from r join a on a.conv_id = r.conv_id and a.step = r.step + 1)
"""

_OUTCOMES = _CHAIN + "select conv_id::varchar as id, turn::bigint as seq, status::integer as status, revision from r"

ORACLES = {
    "bootstrap_count": "select 'records' as family, count(*) as n from documents",
    "list_summaries": "select * exclude (text) from documents",
    "get_by_id": """select item_id as id, case when l.doc_id is null then 404 else 200 end::integer as status,
        case when l.doc_id is null then 'not_found' end as error, quality::bigint as revision, toxic, quality::varchar as etag
        from benchmark left join labels l on item_id = l.doc_id""",
    "get_status": "select case when l.doc_id is null then 404 else 200 end::integer as status, count(*) as n from documents d left join labels l on d.doc_id = l.doc_id group by 1",
    "analyze_lines": r"select doc_id as id, len(regexp_split_to_array(text, '\r?\n'))::bigint as lines from documents",
    "analyze_draft": r"""select doc_id as id, 200::integer as status, len(regexp_split_to_array(coalesce(c.text, d.text), '\r?\n'))::bigint as "lines"
        from documents d left join (select * from conversations where turn = 0) c on c.conv_id = d.doc_id""",
    "put_single": """select l.doc_id::varchar as id, case when d.doc_id is null then 404 when quality = 0 then 200 else 409 end::integer as status,
        case when d.doc_id is null then null when quality = 0 then 4 else 3 end::bigint as revision
        from labels l left join documents d on d.doc_id = l.doc_id""",
    "put_sequence": _OUTCOMES,
    "put_sequence_state": _CHAIN
    + """select l.doc_id::varchar as id, coalesce(e.revision, 0)::bigint as revision, coalesce(length(e.content), 0)::bigint as content_chars
        from labels l left join (select * from r qualify row_number() over (partition by conv_id order by step desc) = 1) e on e.conv_id = l.doc_id""",
    "put_stream": _OUTCOMES,
    "put_sequence_links": _OUTCOMES,
    "put_stream_ordered": _OUTCOMES,
    "get_one": "select * from documents where doc_id = 7",
    "put_conflict": _CHAIN
    + """select conv_id::varchar as id, turn::bigint as seq, status::integer as status,
        case status when 404 then 'not_found' when 409 then 'revision_conflict' end as error,
        case when status = 200 then revision end as row_revision, case when status = 200 then length(content) end::bigint as row_chars,
        case when status = 409 then revision end as current_revision, case when status = 409 then length(content) end::bigint as current_chars from r""",
    "put_bodies": _CHAIN.replace("from conversations)", "from conversations where turn % 4 <> 3 and turn <> 5)").replace("floor(turn / 2) as", "case when turn % 4 = 2 then -1 else floor(turn / 2) end as")
    + """select conv_id::varchar as id, turn::bigint as seq, status::integer as status, revision from r
        union all select conv_id::varchar, turn::bigint, case when turn = 5 then case when l.doc_id is null then 404 else 500 end when turn % 8 = 7 then 413 else 400 end::integer, null
        from conversations left join labels l on conv_id = l.doc_id where turn % 4 = 3 or turn = 5""",
    "replay": """
with recursive a as (
  select case when conv_id % 10 = 3 then -conv_id else conv_id end as conv_id, turn, text, turn % 3 as k, floor(turn / 6) as expected, row_number() over (partition by conv_id order by turn) as step from conversations),
s as (select doc_id, text from documents),
r as (
  select conv_id, turn, k, a.text as said, step, doc_id is not null as hit, k = 0 and expected = 0 as won,
         case when doc_id is not null then (k = 0 and expected = 0)::bigint end as revision,
         case when k = 0 and expected = 0 then coalesce(a.text, '') else s.text end as content
  from a left join s on doc_id = conv_id where step = 1
  union all
  select a.conv_id, a.turn, a.k, a.text, a.step, r.hit, a.k = 0 and a.expected = r.revision,
         r.revision + (a.k = 0 and a.expected = r.revision)::bigint,
         case when a.k = 0 and a.expected = r.revision then coalesce(a.text, '') else r.content end
  from r join a on a.conv_id = r.conv_id and a.step = r.step + 1),
t as (select *, case when not hit then 404 when k = 0 and not won then 409 when k = 1 and turn % 4 = 1 and revision = 1 then 304 else 200 end as st from r)
select conv_id::varchar as id, turn::bigint as seq, case k when 0 then 'PUT' when 1 then 'GET' else 'ANALYZE' end as op, st::integer as status,
       case st when 404 then 'not_found' when 409 then 'revision_conflict' end as error, case when k = 1 and hit then revision::varchar end as etag, revision,
       case when k < 2 and st in (200, 409) then length(content) end::bigint as content_chars,
       case when k = 2 and hit then len(regexp_split_to_array(case when turn % 4 = 2 then content else coalesce(said, content) end, '\\r?\\n')) end::bigint as "lines"
from t""",
    "analyze_delayed": """
with recursive a as (
  select case when conv_id % 10 = 3 then -conv_id else conv_id end as conv_id, turn, text, floor(turn / 2) as expected, row_number() over (partition by conv_id order by turn) as step from conversations where turn % 2 = 0),
s as (select doc_id, text from documents),
r as (
  select conv_id, turn, step, expected = 0 as won, (expected = 0)::bigint as revision, coalesce(a.text, '') as said from a join s on doc_id = conv_id where step = 1
  union all
  select a.conv_id, a.turn, a.step, a.expected = r.revision, r.revision + (a.expected = r.revision)::bigint, coalesce(a.text, '') from r join a on a.conv_id = r.conv_id and a.step = r.step + 1),
v as (
  select *, lead(since) over (partition by id order by revision) as until from (
    select conv_id as id, revision, said as content, 30 * turn as since from r where won union all select doc_id, 0, text, -1 from s)),
q as (select case when conv_id % 10 = 3 then -conv_id else conv_id end as conv_id, turn, text, 30 * turn + case when conv_id % 10 = 0 then 100 else 20 end as ready from conversations where turn % 2 = 1)
select conv_id::varchar as id, turn::bigint as seq, case when v.id is null then 404 else 200 end::integer as status, case when v.id is null then 'not_found' end as error, ready::bigint as ready, revision,
       case when v.id is not null then len(regexp_split_to_array(case when turn % 4 = 1 then content else coalesce(text, content) end, '\\r?\\n')) end::bigint as "lines"
from q left join v on v.id = conv_id and ready >= since and (until is null or ready < until)""",
    "list_at": _CHAIN
    + """select l.doc_id::varchar as id, coalesce(e.revision, 0)::bigint as revision
        from labels l left join (select * from r where turn < 5 qualify row_number() over (partition by conv_id order by step desc) = 1) e on e.conv_id = l.doc_id""",
    "get_first": """
select doc_id as id, case when c.conv_id is null then 404 else 200 end::integer as status, case when c.conv_id is null then 'not_found' end as error,
       turn::bigint as ord, (turn + 3)::bigint as revision, role, length(text)::bigint as chars, (turn + 3)::varchar as etag
from labels left join (select * from conversations qualify row_number() over (partition by conv_id order by turn) = 1) c on c.conv_id = doc_id""",
    "get_conditional": """
select d.doc_id as id, case d.doc_id % 4 when 0 then '*' when 1 then 'W/1 ,"2"' when 2 then '0,7' else '' end as if_none_match,
       case when l.doc_id is null then 404 when fresh then 304 else 200 end::integer as status, case when l.doc_id is null then 'not_found' end as error,
       case when not fresh then quality end::bigint as revision, case when not fresh then toxic end as toxic, quality::varchar as etag
from documents d left join (select *, case doc_id % 4 when 0 then true when 1 then quality = 1 when 2 then quality = 0 else false end as fresh from labels) l on l.doc_id = d.doc_id""",
}

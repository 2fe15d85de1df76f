"""Token counts through a digest cache.

Stored counts are keyed by the digest of the normalised content and the digest
of the tokenizer's file. Counting joins documents' digests to the cache, encodes
one document of each distinct missing digest, appends the counts and joins again.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.encode import encoder, tokenizer_kind
from lodestream.llm.shared import HOT, join_dealt, materialise, new_path, ship

CACHE_SCHEMA = "content_digest binary, n_tokens bigint"

#: Bits of the map of missing texts: 16 MB for every task, at any number of them.
MAP_BITS = 1 << 27


def tokenizer_version(path: str) -> str:
    """SHA-256 of the tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def content_digest(text: Column, kind: str) -> Column:
    """SHA-256 of the content in a form that keeps its count: if the tokenizer drops white space, runs of ASCII white space are one blank, and none at the ends."""
    body = F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.trim(F.regexp_replace(body, r"[ \t\n\r\f\x0B]+", " ")) if kind == "drop" else body, 256))


def read_cache(spark: SparkSession, cache_dir: str, version: str) -> DataFrame:
    path = f"{cache_dir}/tokenizer={version}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CACHE_SCHEMA)
    # a digest that was appended twice has the same count twice
    return spark.read.schema(CACHE_SCHEMA).parquet(path).dropDuplicates(["content_digest"])


def may_miss(rows: DataFrame, misses: DataFrame) -> DataFrame:
    """The rows whose hash ``h`` can be one of ``misses``: all that are, and of the others about one in MAP_BITS / misses.

    A bit for each hash, in maps of 32,768, goes to the tasks; no row moves.
    """
    at = F.pmod(F.col("h"), F.lit(MAP_BITS))
    bucket, bit = F.shiftright(at, 15), at.bitwiseAND(F.lit(32767))
    maps = misses.select(bucket.alias("bucket"), bit.alias("bit")).repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    return rows.withColumn("bucket", bucket).join(F.broadcast(maps), "bucket").where(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1).drop("bucket", "bits")


def count_tokens(docs: DataFrame, tokenizer: str, cache_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (id, content_digest, n_bytes, n_tokens) for each row of ``docs``.

    A null text counts as empty: 0 bytes, 0 tokens. Rows with equal content
    share one encoding; null and repeated ids are kept as rows; an empty table
    gives an empty one. Other columns of ``docs`` aren't read. ``tokenizer`` is a
    path valid on every machine. ``cache_dir`` has one writer at a time; None
    starts an empty cache in the shared folder.

    Digests are taken once, and written with hashes of text and id. Of the rows
    of a missing digest one is chosen by these hashes, and its text encoded. Only
    texts whose hash a bitmap of the missing ones holds leave their task, once,
    copies being reduced before; the bitmap has one size whatever the input, so
    beyond some 10^8 misses in one call texts that aren't missing move as well.
    Counts of digests that many rows have go to the rows, so no key gathers the
    copies of a text.
    """
    spark = docs.sparkSession
    ship(spark)
    kind, version = tokenizer_kind(tokenizer), tokenizer_version(tokenizer)
    cache_dir = cache_dir or new_path(spark, "token-cache")
    body = F.coalesce(F.col(text_col), F.lit(""))
    hashes = [F.xxhash64(body).alias("h"), F.xxhash64(F.col(id_col)).alias("ih")]
    keyed = materialise(docs.select(F.col(id_col).alias("id"), content_digest(F.col(text_col), kind).alias("content_digest"), F.octet_length(body).cast("bigint").alias("n_bytes"), *hashes), "digests")
    counts = materialise(keyed.groupBy("content_digest").agg(F.min(F.struct("h", "ih")).alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    misses = materialise(counts.join(read_cache(spark, cache_dir, version), "content_digest", "left_anti").select("content_digest", "first.h", "first.ih"), "misses")

    def encode(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            counts = [len(b) // 4 for b in enc.encode_column(batch.column("body"))]
            yield pa.record_batch([batch.column("content_digest"), pa.array(counts, pa.int64())], ["content_digest", "n_tokens"])

    if not misses.isEmpty():
        texts = may_miss(docs.select(*hashes, body.alias("body")), misses).groupBy("h", "ih").agg(F.first("body").alias("body")).join(misses.hint("merge"), ["h", "ih"])
        texts.select("content_digest", "body").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(f"{cache_dir}/tokenizer={version}")

    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * HOT > total).select("content_digest")
    slim = keyed.select("id", "content_digest", "n_bytes")
    return join_dealt(slim, read_cache(spark, cache_dir, version), "content_digest", hot).select(F.col("id").alias(id_col), "content_digest", "n_bytes", "n_tokens")

"""Count, list and look up records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_records(records: DataFrame, family: str) -> DataFrame:
    """One row: the family's name and the number of records."""
    return records.agg(F.count(F.lit(1)).alias("n")).select(F.lit(family).alias("family"), "n")


def list_summaries(records: DataFrame, content: str = "content") -> DataFrame:
    """Every field but the content, so that a columnar scan never reads it."""
    return records.drop(content)


def get_by_id(records: DataFrame, key, id_col: str = "id") -> DataFrame:
    """The record with that id; the predicate reaches the scan."""
    return records.where(F.col(id_col) == F.lit(key))


def first_match(records: DataFrame, id_col: str = "id", ord_col: str = "ord") -> DataFrame:
    """The first record of each id, by ``ord``; records without that column are taken to have unique ids and are returned as they are.

    Ids are counted first, over ids alone; only rows of an id that repeats are
    then reduced, in their tasks before they are shuffled. Records of equal
    ``ord`` are ordered by their other columns. Null ids are kept as they are,
    since no key equals them.
    """
    if ord_col not in records.columns:
        return records
    repeated = records.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(id_col)
    others = [c for c in records.columns if c != ord_col]
    least = records.join(repeated, id_col, "left_semi").groupBy(id_col).agg(F.min(F.struct(ord_col, *others)).alias("_first"))
    firsts = least.select(*(F.col("_first")[c].alias(c) for c in records.columns))
    return records.join(repeated, id_col, "left_anti").select(*records.columns).unionByName(firsts)


def lookup(records: DataFrame, keys: DataFrame, id_col: str = "id") -> DataFrame:
    """A row per key: status 200 with the first such record's fields and its etag, or 404 with nulls."""
    found = first_match(records, id_col).withColumn("_hit", F.lit(True))
    etag = [F.col("revision").cast("string").alias("etag")] if "revision" in records.columns else []
    return keys.join(found, id_col, "left").select(
        *keys.columns,
        F.when(F.col("_hit"), 200).otherwise(404).alias("status"),
        F.when(F.col("_hit").isNull(), "not_found").alias("error"),
        *[c for c in records.columns if c != id_col],
        *etag,
    )


def etag_matches(header: Column, etag: Column) -> Column:
    """Whether an If-None-Match header names the etag: ``*`` alone, or one of its comma-separated tags, weak or not; false for a null or empty header."""
    same = lambda tag: (tag == etag) | (tag == F.concat(F.lit("W/"), etag)) | (F.concat(F.lit("W/"), tag) == etag)
    tags = F.transform(F.split(header, ",", -1), lambda tag: F.trim(tag))
    return F.coalesce((header != "") & etag.isNotNull() & ((header == "*") | F.exists(tags, same)), F.lit(False))


def conditional_lookup(records: DataFrame, keys: DataFrame, id_col: str = "id", header: str = "if_none_match", no_cache: str | None = None) -> DataFrame:
    """``lookup`` with a header per key: 304 and nulls, but for id and etag, where the header names the record's etag.

    ``no_cache`` names a boolean column that asks for the record in any case.
    That the original answers so follows from its framework, not from its own code.
    """
    found = lookup(records, keys, id_col)
    asks = etag_matches(F.col(header), F.col("etag"))
    if no_cache is not None:
        asks = asks & ~F.coalesce(F.col(no_cache), F.lit(False))
    fresh = (F.col("status") == 200) & asks
    told = [F.when(~fresh, F.col(c)).alias(c) for c in records.columns if c != id_col]
    return found.select(*keys.columns, F.when(fresh, 304).otherwise(F.col("status")).alias("status"), "error", *told, "etag")


def duplicate_ids(records: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids held by more than one record: lookups and updates then mean the first (``first_match``)."""
    return records.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

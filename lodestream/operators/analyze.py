"""Line counts of stored or draft text."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions import line_count
from lodestream.operators.records import first_match


def analyze(records: DataFrame, drafts: DataFrame | None = None, id_col: str = "id", content: str = "content") -> DataFrame:
    """Per request: status and the lines of its draft, or of the stored content where the draft is null.

    drafts: (id, draft), a row per request; without it each record is analyzed
    as stored, which is a projection without a shuffle. An empty draft is used
    (one line). An unknown id has status 404 and the error not_found. Of records
    with one id the first is meant.
    """
    revision = F.col("revision") if "revision" in records.columns else F.lit(None).cast("bigint")
    none = F.array().cast("array<string>").alias("diagnostics")
    if drafts is None:
        return records.select(id_col, F.lit(200).alias("status"), revision.alias("revision"), line_count(F.col(content)).alias("lines"), none)
    stored = first_match(records, id_col).select(id_col, revision.alias("revision"), F.col(content).alias("_content"), F.lit(True).alias("_hit"))
    return drafts.join(stored, id_col, "left").select(
        id_col,
        F.when(F.col("_hit"), 200).otherwise(404).alias("status"),
        F.when(F.col("_hit").isNull(), "not_found").alias("error"),
        "revision",
        F.when(F.col("_hit"), line_count(F.coalesce("draft", "_content"))).alias("lines"),
        none,
    )

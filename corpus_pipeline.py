"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's docs. All but the last return the columns of
documents.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.decontaminate import drop_leaks
from lodestream.llm.near_dedup import drop_near_duplicates
from lodestream.llm.packing import cut_pieces, pack
from lodestream.llm.quality import ledger, passes
from lodestream.llm.secrets import find_secrets, redact
from lodestream.llm.shared import materialise

#: Similarity, in hundredths, from which documents are near copies.
SIMILAR = 80


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns under names of their own, as users may call theirs what an operator calls its; and the new name of each."""
    names = [f"__u{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the latest policy, by the stored ledger.

    A null or empty text has too few words. Repeated rows are judged each. All
    columns come back as they were, whatever their names.
    """
    rows, at = _apart(docs)
    kept = materialise(ledger(rows, at["text"]), "ledger").where(passes())
    return kept.select(*at.values()).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest id, once if its row is repeated.

    A text without words stays, as does one without an id, unless its shingles
    are those of a text with one. All columns come back as they were.
    """
    rows, at = _apart(docs)
    return drop_near_duplicates(rows, threshold=SIMILAR, id_col=at["doc_id"], text_col=at["text"]).toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none. Repeated rows stay or go together. All
    columns come back as they were.
    """
    rows, at = _apart(docs)
    return drop_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=at["doc_id"], text_col=at["text"]).toDF(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark and n_chars, where there is such a column, brought up to date.

    A text without secrets, null and empty ones too, and every other column
    come back as they were.
    """
    rows, at = _apart(docs)
    found = find_secrets(rows, at["text"]).withColumn("__clean", redact(F.col(at["text"]), F.col("spans")))
    new = {"text": F.col("__clean")}
    if "n_chars" in at:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("__clean").cast("bigint")).otherwise(F.col(at["n_chars"]))
    return found.select(*(new.get(c, F.col(n)).alias(n) for c, n in at.items())).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences; a null or empty text is its end id alone."""
    return pack(cut_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicate removal", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret redaction", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: Near duplicates and tokenisers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs

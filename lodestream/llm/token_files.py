"""Token ids as flat unsigned integer files with 64-bit document offsets.

A set of parts, each three files: ``.ids`` (unsigned 16-bit ids if the
vocabulary fits, else 32-bit), ``.off`` (unsigned 64-bit, one more than the
documents) and ``.doc`` (signed 64-bit document ids; of a null id, zero). The
manifest has a row per part: its name, dtype, documents, how many of these, which
come first, have a null id, ids, and base, the ids in all parts before it.
"""

import json
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.encode import encoder
from lodestream.llm.shared import map_array, new_path, open_write, ship

#: A part holds about so many bytes of text at most, so a task's work doesn't grow with the input.
PART_BYTES = 128 << 20
#: Ids read at once.
WINDOW = 1 << 20
MANIFEST = "part int, name string, dtype string, n_docs bigint, n_nulls bigint, n_tokens bigint, base bigint"


@dataclass
class TokenFiles:
    path: str
    manifest: list[tuple]


def _vocab_size(path: str) -> int:
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        return max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encodes documents in ascending id order and writes the parts.

    Order: id (null first), then a hash of the text; rows alike in both are
    alike in all that is written. A null text is empty and so has the end id
    alone; no rows give no parts. Long texts are encoded whole. One range shuffle
    brings documents into order, over as many parts as shuffles have, or more if
    parts would exceed PART_BYTES; each task streams its own part, and a retried task writes under another name, so the manifest,
    made from finished tasks, never names half a file. Its rows, one per part,
    are all that reaches the driver, for the prefix sums.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or new_path(spark, "token-files")
    dtype = "<u2" if max(_vocab_size(tokenizer), end_id + 1) <= 1 << 16 else "<u4"
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), body.alias("body"), F.xxhash64(body).alias("h"))
    n_bytes = rows.agg(F.sum(F.octet_length("body").cast("bigint"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PART_BYTES))
    ordered = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), "h").sortWithinPartitions(F.col("id").asc_nulls_first(), "h")

    def write(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        end = np.array([end_id], dtype=dtype).tobytes()
        n_docs = n_nulls = total = 0
        with open_write(f"{path}/{name}.ids") as ids, open_write(f"{path}/{name}.off") as off, open_write(f"{path}/{name}.doc") as doc:
            off.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                sizes = []
                for b in enc.encode_column(batch.column("body")):
                    ids.write(np.frombuffer(b, "<u4").astype(dtype).tobytes() + end)
                    sizes.append(len(b) // 4 + 1)
                ends = total + np.cumsum(sizes, dtype=np.uint64)
                off.write(ends.astype("<u8").tobytes())
                doc.write(batch.column("id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                total, n_docs, n_nulls = int(ends[-1]) if len(ends) else total, n_docs + len(sizes), n_nulls + batch.column("id").null_count
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([name]), *(pa.array([x], pa.int64()) for x in (n_docs, n_nulls, total))], ["part", "name", "n_docs", "n_nulls", "n_tokens"])

    done = ordered.select("id", "body").mapInArrow(write, "part int, name string, n_docs bigint, n_nulls bigint, n_tokens bigint").collect()
    manifest, base = [], 0
    for r in sorted(done, key=lambda r: r["part"]):
        if r["n_docs"]:
            manifest.append((r["part"], r["name"], dtype, r["n_docs"], r["n_nulls"], r["n_tokens"], base))
            base += r["n_tokens"]
    spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    return TokenFiles(path, manifest)


def open_token_files(spark: SparkSession, path: str) -> TokenFiles:
    return TokenFiles(path, [tuple(r) for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy("part").collect()])


def _checksums(ids, offsets):
    """crc32 of each document's ids as 32-bit integers; ids are read about WINDOW at a time, several documents or a piece of one."""
    out, i = [], 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + WINDOW, "right")) - 1)
        if offsets[j] - offsets[i] <= WINDOW:
            flat = ids[offsets[i] : offsets[j]].astype("<u4")
            out += [zlib.crc32(flat[a - offsets[i] : b - offsets[i]]) for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1])]
        else:
            crc = 0
            for lo in range(offsets[i], offsets[j], WINDOW):
                crc = zlib.crc32(ids[lo : min(lo + WINDOW, offsets[j])].astype("<u4"), crc)
            out.append(crc)
        i = j
    return out


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens (with the end id) and the crc32 of its ids as 32-bit integers."""
    ship(spark)
    path = files.path
    rows = spark.createDataFrame(files.manifest, MANIFEST).repartition(max(1, len(files.manifest)))

    def read(batches):
        for batch in batches:
            for p in batch.to_pylist():
                ids, off, doc = (map_array(f"{path}/{p['name']}.{x}", t) for x, t in (("ids", p["dtype"]), ("off", "<u8"), ("doc", "<i8")))
                for lo in range(0, p["n_docs"], 4096):
                    o = off[lo : lo + 4097].astype(np.int64)
                    d = np.array(doc[lo : lo + len(o) - 1])
                    crc = _checksums(ids, o)
                    yield pa.record_batch(
                        [pa.array(d, pa.int64(), mask=np.arange(lo, lo + len(d)) < p["n_nulls"]), pa.array(o[:-1] + p["base"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return rows.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

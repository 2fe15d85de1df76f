"""What the operators share: the shared folder, materialised tables and storage that tasks can write."""

import os
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "lodestream-package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "lodestream")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local master gets a new local folder, as in tests;
    with executors elsewhere it would be split over machines, so that raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lodestream-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: cuts lineage, and what made it never runs twice.

    Written with zstd, as snappy takes direct buffers of a page's size in and out, which long texts make large and only a full collection frees.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.materialised_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing reads any more."""
    for df in tables:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.materialised_at)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 250):
    """Texts go to Python by so many rows at once, for operators whose other state is large; jobs have to run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: A key is hot if it has more than one in so many rows, so that there are fewer hot keys than that.
HOT = 1000


def join_dealt(rows: DataFrame, other: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` joined to their key's row of ``other``, however many rows a key has.

    ``hot``: the keys of more than a thousandth of the rows, of which there are
    fewer than a thousand. Their rows of ``other`` go to every task, so rows of
    hot keys stay where they are; all others are shuffled by key.
    """
    few = other.join(F.broadcast(hot), key, "left_semi")
    spread = rows.join(F.broadcast(hot), key, "left_anti").join(other.hint("merge"), key)
    return rows.join(F.broadcast(few), key).unionByName(spread)


def open_write(path: str):
    """A binary stream for a task to write; any scheme that pyarrow knows, or a local path."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        os.makedirs(os.path.dirname(url.path), exist_ok=True)
        return open(url.path, "wb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    return store.open_output_stream(inner)


class StoredArray:
    """The flat array in a file of a store, read by ranges."""

    def __init__(self, path: str, dtype: str):
        import numpy as np
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        self.dtype, self.file = np.dtype(dtype), store.open_input_file(inner)

    def __len__(self) -> int:
        return self.file.size() // self.dtype.itemsize

    def __getitem__(self, span: slice):
        import numpy as np

        lo, hi, _ = span.indices(len(self))
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(max(0, hi - lo) * size, lo * size), self.dtype)


def map_array(path: str, dtype: str):
    """The flat array in a file, to be sliced: memory-mapped if the file is local or mounted, else read by ranges."""
    import numpy as np

    url = urlparse(path)
    if url.scheme in ("", "file"):
        return np.memmap(url.path, dtype=dtype, mode="r") if os.path.getsize(url.path) else np.zeros(0, dtype)
    return StoredArray(path, dtype)

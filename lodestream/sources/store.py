"""Versioned Parquet snapshots that survive a writer's crash.

Plain Parquet has no row updates, and overwriting a table that is being read
loses it. Each commit therefore writes a new folder ``v=<n>-<random>``, which no
other commit can meet, and then names it in the marker ``_LATEST/<n>``. The
marker is written elsewhere first and renamed to its place, which fails if
another writer was first; so readers see a version only once it is whole, and a
crash at any point leaves nothing but files that no marker names.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestream.sources.schemas import RECORD_SCHEMA


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, sub: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{sub}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, sub: str) -> list[str]:
        fs, p = self._hadoop(sub)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def latest(self) -> int:
        """The newest whole version, 0 if there is none."""
        return max((int(n) for n in self._names("_LATEST") if n.isdigit()), default=0)

    def folder(self, version: int) -> str:
        """The folder that a version's marker names."""
        fs, p = self._hadoop(f"_LATEST/{version}")
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.schema(RECORD_SCHEMA).parquet(f"{self.path}/{self.folder(version or self.latest())}")

    def commit(self, records: DataFrame, base: int) -> int:
        """Writes ``records`` as the version after ``base``; fails if another writer was first."""
        version = base + 1
        if self.latest() != base:
            raise ValueError(f"version {base} is not the latest")
        folder = f"v={version}-{uuid.uuid4().hex}"
        records.select(*RECORD_SCHEMA.names).write.mode("errorifexists").parquet(f"{self.path}/{folder}")
        self._mark(version, folder)
        return version

    def _mark(self, version: int, folder: str) -> None:
        fs, draft = self._hadoop(f"_DRAFTS/{folder}")
        _, marker = self._hadoop(f"_LATEST/{version}")
        out = fs.create(draft, False)
        out.write(folder.encode())
        out.close()
        fs.mkdirs(marker.getParent())
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # never replaces a marker
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(marker), options)
        except Exception as e:
            if fs.exists(marker):
                raise ValueError(f"version {version} was committed by another writer") from e
            raise

    def drop_orphans(self, older_than_s: float = 86_400) -> list[str]:
        """Deletes what crashed commits left: folders and drafts that no marker names, last changed so long ago; returns their names.

        The age keeps those of a commit that is under way.
        """
        named = {self.folder(int(n)) for n in self._names("_LATEST") if n.isdigit()}
        now, gone = self.spark._jvm.System.currentTimeMillis(), []
        for sub in ("", "_DRAFTS"):
            fs, p = self._hadoop(sub)
            for s in fs.listStatus(p) if fs.exists(p) else []:
                name = s.getPath().getName()
                if name.startswith("v=") and (sub or name not in named) and now - s.getModificationTime() >= older_than_s * 1000:
                    fs.delete(s.getPath(), True)
                    gone.append(name)
        return gone

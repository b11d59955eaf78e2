"""Publishing a set of tables so that readers see all of it or none.

A release is written to a folder of its own, ``target/releases/<id>``, and checked there: every table must read back as many
rows as were written. Only then the pointer ``target/CURRENT``, a file that names the release, is replaced. A job that dies
on the way leaves an unfinished release that nothing points to; readers go on with the one before. The pointer is renamed
over the old one where the file system can do that in one step, as HDFS and local disks can; a store that replaces an object
in one step when its write is closed gets a plain write.

Every release leaves an audit, ``target/audit/<id>``: a row per table with the stamp of the run, the same in all rows, the rows
it holds and when it was written. The stamp is taken once, when the run starts, so tables of one run can be told by it. Audits
outlive the releases that are pruned.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.sources.raw import counted

POINTER = "CURRENT"
AUDIT = "release STRING, started_at TIMESTAMP, table_name STRING, rows BIGINT, written_at TIMESTAMP"


class NotPublished(Exception):
    """The target has no finished release."""


class IncompleteRelease(Exception):
    """A table of a release does not hold the rows that were written."""


def run_stamp() -> datetime:
    """The time that stands for a run, to be taken once at its start."""
    return datetime.now(timezone.utc)


class Shelf:
    """Releases of tables below ``target``."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.target, *parts]))
        return self._file_system(path).makeQualified(path)

    def _file_system(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def _files(self):
        return self._file_system(self._path())

    def current(self) -> str:
        """The release that readers see."""
        pointer = self._path(POINTER)
        if not self._files.exists(pointer):
            raise NotPublished(self.target)
        stream = self._files.open(pointer)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def table(self, name: str, release: str | None = None) -> DataFrame:
        """A published table. The release is resolved now: later ones do not change this DataFrame."""
        return self.spark.read.parquet(f"{self.target}/releases/{release or self.current()}/{name}")

    def releases(self) -> list[str]:
        """All releases, finished or not, in order of their start."""
        folder = self._path("releases")
        return sorted(f.getPath().getName() for f in self._files.listStatus(folder)) if self._files.exists(folder) else []

    def publish(self, tables: Mapping[str, DataFrame], stamp: datetime | None = None) -> str:
        """Write all tables as one release, check them, write their audit and point to the release; returns its id.

        ``stamp``: when the run that made the tables started; by default now.
        """
        release = f"{run_stamp().strftime('%Y%m%dT%H%M%S%f')}-{uuid.uuid4().hex[:8]}"
        stamp = stamp or run_stamp()
        written, audit = {}, []
        for name, df in tables.items():
            df, seen = counted(df, f"publish_{name}_{release}")
            df.write.parquet(f"{self.target}/releases/{release}/{name}")
            written[name] = seen.get["rows"]
            audit.append((release, stamp, name, written[name], run_stamp()))
        for name, rows in written.items():
            found = self.table(name, release).count()  # from the files' footers, not their rows
            if found != rows:
                raise IncompleteRelease(f"{name}: {rows} rows written, {found} found")
        self.spark.createDataFrame(audit, AUDIT).coalesce(1).write.parquet(f"{self.target}/audit/{release}")
        self._point_to(release)
        return release

    def audit(self, release: str | None = None) -> DataFrame:
        """release, started_at, table_name, rows, written_at of the tables of a release, by default the one readers see."""
        return self.spark.read.schema(AUDIT).parquet(f"{self.target}/audit/{release or self.current()}")

    def history(self) -> DataFrame:
        """The audits of all releases that were finished up to the current one, those since pruned among them."""
        return self.spark.read.schema(AUDIT).parquet(f"{self.target}/audit/*").filter(F.col("release") <= self.current())

    def _point_to(self, release: str) -> None:
        jvm = self.spark.sparkContext._jvm
        staged, pointer = self._path(f".{POINTER}-{release}"), self._path(POINTER)
        one_step = self._files.getScheme() in ("file", "hdfs", "viewfs")
        stream = self._files.create(staged if one_step else pointer, True)
        try:
            stream.write(bytearray(release.encode()))
        finally:
            stream.close()
        if one_step:
            over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            over[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "OVERWRITE")
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                pointer.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(staged, pointer, over)

    def prune(self, keep: int = 2) -> list[str]:
        """Delete all but the last ``keep`` releases up to the current one, and unfinished ones before it; returns them."""
        now = self.current()
        old = [r for r in self.releases() if r < now]
        gone = old[:max(0, len(old) - (keep - 1))]
        for release in gone:
            self._files.delete(self._path("releases", release), True)
        return gone

"""Several tables changed in one commit: readers see all of its new versions or none."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class CommitConflict(RuntimeError):
    """Another writer has committed since the expected revision."""


class TableSet:
    """Tables whose versions are folders; a manifest names the current version of each.

    A commit writes every changed table first, in folders that no manifest names yet, and then moves
    one small manifest into place under the next revision. That move fails if the name is taken, so
    of two writers with one expected revision the second learns of it; a writer that dies before the move
    leaves nothing but folders that no reader sees. Old manifests stay, so a reader keeps its revision.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(self._conf)

    def revision(self) -> int:
        """The number of the newest manifest; 0 before the first commit."""
        fs, top = self._fs(), self._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not fs.exists(top):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return max((int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n))), default=0)

    def manifest(self, revision: int | None = None) -> dict[str, str]:
        """Table -> version of a revision, the newest if none is named."""
        number = self.revision() if revision is None else revision
        if number == 0:
            return {}
        stream = self._fs().open(self._path(f"manifest-{number:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["tables"]
        finally:
            stream.close()

    def read(self, table: str, revision: int | None = None) -> DataFrame:
        version = self.manifest(revision).get(table)
        if version is None:
            raise AnalysisException(f"no table {table} at revision {self.revision() if revision is None else revision}")
        return self.spark.read.parquet(f"{self.folder}/{version}")

    def commit(self, changes: dict[str, DataFrame], expected: int | None = None) -> int:
        """Write all tables of ``changes`` and make them current together; the new revision.

        ``expected`` is the revision that the changes were made from, the current one if not given.
        """
        base = self.revision() if expected is None else expected
        if self.revision() != base:
            raise CommitConflict(f"expected revision {base}, found {self.revision()}")
        fresh = {}
        for table, df in changes.items():
            if not re.fullmatch(r"[A-Za-z0-9_]+", table):
                raise ValueError(f"not a table name: {table!r}")
            fresh[table] = f"{table}/v-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{fresh[table]}")
        body = json.dumps({"revision": base + 1, "tables": self.manifest(base) | fresh}, sort_keys=True)
        return self._publish(base + 1, body)

    def _publish(self, revision: int, body: str) -> int:
        fs = self._fs()
        draft, final = self._path(f".manifest-{uuid.uuid4().hex}"), self._path(f"manifest-{revision:012d}.json")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        never = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = getattr(self._jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(draft, final, never)
        except Exception as e:
            if fs.exists(draft):
                fs.delete(draft, False)
            if fs.exists(final):
                raise CommitConflict(f"revision {revision} was committed by another writer") from e
            raise
        return revision

"""Shared-folder helpers: where state and cut lineage go, and Hadoop file access.

Everything that has to outlive an executor is written under the folder the
cluster names in ``spark.checkpoint.dir``. Only where that is unset (tests, a
laptop) is a temporary folder made and set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; in local mode a temporary one if unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; a cluster must name a shared folder")
    where = "file://" + tempfile.mkdtemp(prefix="tidewater-")
    spark.conf.set("spark.checkpoint.dir", where)
    spark.sparkContext.setCheckpointDir(where)
    return where


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name (not created) below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folder of each application for what nobody needs once it ends.
_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """``new_dir`` for what nobody needs once the application ends: Hadoop deletes
    it then, on whatever file system it is; ``discard`` does earlier."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        root = new_dir(spark, "scratch")
        files = Files(spark, root)
        files.fs.mkdirs(files.path(root))
        files.fs.deleteOnExit(files.path(root))
        _SCRATCH[app] = root
    return f"{_SCRATCH[app]}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    and a lost executor costs a read, not a recomputation."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame | str | None) -> None:
    """Delete the folders of cuts that nothing reads any more."""
    for f in frames:
        path = getattr(f, "_scratch", f)
        if isinstance(path, str) and path.startswith(tuple(f"{root}/" for root in _SCRATCH.values())):
            Files(SparkSession.active(), path).delete(path)


class Files:
    """The few file operations the table layer needs, through Hadoop, so any
    file system the cluster knows will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def size(self, p: str) -> int:
        return self.fs.getFileStatus(self.path(p)).getLen()

    def list(self, p: str) -> list[tuple[str, bool, int]]:
        """(name, is_dir, bytes) of the children; empty if ``p`` is missing."""
        if not self.exists(p):
            return []
        return sorted((s.getPath().getName(), s.isDirectory(), s.getLen()) for s in self.fs.listStatus(self.path(p)))

    def read_text(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read_bytes(self, p: str) -> bytes:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_bytes(self, p: str, data: bytes) -> None:
        """Write beside ``p`` and rename, so that ``p`` is there whole or not."""
        tmp = f"{p}.{uuid.uuid4().hex}.part"
        out = self.fs.create(self.path(tmp), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        self._rename(tmp, p)

    def copy(self, source: str, target: str) -> None:
        tmp = f"{target}.{uuid.uuid4().hex}.part"
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(source), self.fs, self.path(tmp), False, self.conf)
        self._rename(tmp, target)

    def tree(self, p: str) -> list[str]:
        """Paths of all files below ``p``, relative to it, in order."""
        if not self.exists(p):
            return []
        root, out, found = self.fs.makeQualified(self.path(p)).toUri().getPath().rstrip("/"), [], self.fs.listFiles(self.path(p), True)
        while found.hasNext():
            out.append(found.next().getPath().toUri().getPath()[len(root) + 1 :])
        return sorted(out)

    def create_text(self, p: str, text: str) -> bool:
        """Create ``p`` only if it doesn't exist; False if another writer was first."""
        try:
            out = self.fs.create(self.path(p), False)
        except Exception as e:  # py4j wraps FileAlreadyExistsException
            if "AlreadyExists" in str(e):
                return False
            raise
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        return True

    def replace_text(self, p: str, text: str) -> None:
        """Write beside ``p`` and rename over it in one step, so a reader sees
        the old or the new text, never half of one and never none."""
        tmp = f"{p}.{uuid.uuid4().hex}.tmp"
        self.create_text(tmp, text)
        self._rename(tmp, p)

    def _rename(self, source: str, target: str) -> None:
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        context.rename(self.path(source), self.path(target), options)

    def delete(self, p: str) -> None:
        if self.exists(p):
            self.fs.delete(self.path(p), True)

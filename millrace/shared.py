"""What has to outlive an executor is kept in folders that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Return the path of a new, unused folder that every executor can reach.

    The base is the session's ``spark.checkpoint.dir``, else the folder given to
    ``setCheckpointDir``, and without either a folder in the warehouse. All of them must be
    reached by every executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = spark.sparkContext.getCheckpointDir()
        base = given if isinstance(given, str) else None
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, as a Parquet table in the shared folder, and return that table.

    Unlike a cached DataFrame the table survives lost executors, so its rows are never
    computed a second time. Its size is known to later plans, and they still prune columns.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """A folder that every executor reaches, for a driver that keeps a few small files in it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def below(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{name}")

    def _store(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def make(self) -> None:
        """Make the folder, if there is none."""
        store, path = self._store()
        store.mkdirs(path)

    def names(self) -> list[str]:
        """The names of what is in the folder; none if there is no such folder."""
        store, path = self._store()
        if not store.exists(path):
            return []
        return [entry.getPath().getName() for entry in store.listStatus(path)]

    def read(self, name: str) -> str | None:
        """The text of a small file, null if there is none."""
        store, path = self._store(name)
        if not store.exists(path):
            return None
        stream = store.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write a small file, in the place of one that is there."""
        store, path = self._store(name)
        _, draft = self._store(f"_draft-{uuid.uuid4().hex}")
        stream = store.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if store.exists(path):
            store.delete(path, False)
        store.rename(draft, path)

    def delete(self, name: str) -> None:
        """Delete a file or a folder with all that is in it."""
        store, path = self._store(name)
        store.delete(path, True)

    def move_all(self, target: str) -> None:
        """Move what is in the folder to another one, which is made if need be; the folder goes."""
        store, path = self._store()
        end = self.spark._jvm.org.apache.hadoop.fs.Path(target)
        store.mkdirs(end)
        for entry in store.listStatus(path):
            moved = self.spark._jvm.org.apache.hadoop.fs.Path(end, entry.getPath().getName())
            if not store.rename(entry.getPath(), moved):
                raise OSError(f"{entry.getPath()} could not be moved to {target}")
        store.delete(path, True)

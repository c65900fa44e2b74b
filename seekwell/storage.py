"""Small files next to the tables, through the Hadoop file system of the
session, so that any store Spark can write to works."""

import json

from pyspark.sql import SparkSession


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self._spark = spark
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = fs.makeQualified(path).toString().rstrip("/")

    def _open(self, name: str):
        path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        conf = self._spark._jsc.hadoopConfiguration()
        return path.getFileSystem(conf), path

    def exists(self, name: str) -> bool:
        fs, path = self._open(name)
        return fs.exists(path)

    def remove(self, name: str) -> None:
        fs, path = self._open(name)
        fs.delete(path, True)

    def names(self, directory: str) -> list[str]:
        fs, path = self._open(directory)
        if not fs.exists(path):
            return []
        return [status.getPath().getName() for status in fs.listStatus(path)]

    def read_text(self, name: str) -> str:
        fs, path = self._open(name)
        stream = fs.open(path)
        try:
            return self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read_json(self, name: str) -> dict:
        return json.loads(self.read_text(name))

    def write_json(self, name: str, value: dict) -> None:
        """Visible as a whole or not at all: written aside, then renamed."""
        fs, path = self._open(name)
        _, aside = self._open(f"{name}.tmp")
        stream = fs.create(aside, True)
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            stream.close()
        if not fs.rename(aside, path):
            raise RuntimeError(f"could not write {path}")

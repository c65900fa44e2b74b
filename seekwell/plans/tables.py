"""The tables of an index, as Spark keeps them: Parquet tables with partitions and
buckets.

Rows are partitioned by the version that wrote them and bucketed by file, `(folder,
path)`, so a join of two tables of an index by file needs no exchange: both sides are
read bucket by bucket. A table may also be partitioned by a part of the folder; a search
in some folders then reads the partitions of these folders only. The number of buckets
is fixed when the first version is written. With a bucketed join one task reads one
bucket of all versions, so an index that will grow much should be given the number it
needs then, about one per half GB."""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.ids import folder_part
from ..session import freeing_shuffles
from ..storage import Storage

KEY = ["folder", "path"]
_VERSION, _PART = (StructField(n, IntegerType(), False) for n in ("version", "folder_part"))


def table_schema(schema: StructType, parted: bool) -> StructType:
    return StructType([*schema.fields, _VERSION, *([_PART] if parted else [])])


class VersionedTable:
    def __init__(self, spark: SparkSession, store: Storage, name: str, schema: StructType, buckets: int, parts: int = 0):
        """`parts` of the folders, or 0 for none."""
        self._spark, self._store, self._folder, self._buckets = spark, store, name, buckets
        self._parts = parts
        self._place = ["version", "folder_part"] if parts else ["version"]
        self.schema = table_schema(schema, parts > 0)
        where = f"{store.root}/{name}"
        self.name = f"seekwell_{name}_{hashlib.sha256(where.encode()).hexdigest()[:16]}"
        self._listed: set[int] = set()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        quoted = where.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet OPTIONS (compression 'zstd') "
            f"PARTITIONED BY ({', '.join(self._place)}) CLUSTERED BY (folder, path) INTO {buckets} BUCKETS "
            f"LOCATION '{quoted}'"
        )

    def clear(self, version: int) -> None:
        """Remove what an unfinished attempt left of `version`."""
        self._spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (version = {version})")
        self._store.remove(f"{self._folder}/version={version}")

    def write(self, rows: DataFrame, version: int) -> None:
        """Store `rows` as `version`, in place of what an unfinished attempt left. Rows
        are best dealt by `repartition(buckets, *KEY)` before they become large."""
        self.clear(version)
        placed = rows.withColumn("version", F.lit(version))
        if self._parts:
            placed = placed.withColumn("folder_part", folder_part(F.col("folder"), self._parts))
        writer = placed.select(*self.schema.names).write.format("parquet").mode("append")
        with freeing_shuffles(rows.sparkSession):
            writer.partitionBy(*self._place).bucketBy(self._buckets, *KEY).saveAsTable(self.name)
        self._listed.add(version)

    def read(self, versions: list[int]) -> DataFrame:
        """The rows of some versions. Partitions that others wrote are looked up once."""
        if not versions:
            return self._spark.createDataFrame([], self.schema)
        if not self._listed.issuperset(versions):
            self._spark.catalog.recoverPartitions(self.name)
            self._spark.catalog.refreshTable(self.name)
            self._listed.update(versions)
        return self._spark.table(self.name).filter(F.col("version").isin(versions))

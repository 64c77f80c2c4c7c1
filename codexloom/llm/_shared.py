"""Tables, the shared folder and small Spark helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import shared_dir

#: Largest table, in bytes of its values, that an operator broadcasts; beyond it, joins shuffle.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stage:
    """Tables that one operator run writes to the shared folder.  They cut lineage,
    so a lost executor costs the recomputation of one step at most."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(path)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes what ``save`` returned."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a side for broadcasting if its values are measured to have few bytes; else a
    join with it stays a shuffle join.  Numbers count 8 bytes, others their own length."""
    width = F.lit(8 * len(df.columns))
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif not isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            width = width + F.length(F.to_json(F.struct(f.name)))
    return F.broadcast(df) if (df.agg(F.sum(width).alias("b")).first()["b"] or 0) <= most else df


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from (crc32 of the id's text, mod 3, is 1)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled(rows: DataFrame, by: str, n: int, *then: str) -> DataFrame:
    """The first ``n`` rows by the hash column ``by``.  Where there are many more, a cut of
    the hash that the count gives leaves about twice ``n`` of them, so no partition sends
    more than its share to the task that orders them."""
    total = rows.count()
    if total > 4 * n:
        rows = rows.where(F.col(by) < F.lit(int(-(1 << 63) + (1 << 64) * (2 * n / total))))
    return rows.orderBy(by, *then).limit(n)

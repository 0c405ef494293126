"""What the operators share: the shared folder, written tables, checked broadcasts, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_root

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch at most, as one text may have hundreds of kilobytes.
BATCH_ROWS = 128

def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/siltstone/{tag}-{uuid.uuid4().hex}"


class Written:
    """A table written to the shared folder: it cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = shared_path(self.spark, tag)
        df.write.option("compression", "zstd").parquet(self.path)
        self.schema = df.schema

    @classmethod
    def at(cls, spark: SparkSession, path: str, schema: str) -> Written:
        """A table that lies there already."""
        self = cls.__new__(cls)
        self.spark, self.path, self.schema = spark, path, schema
        return self

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Remove the table, once nothing reads it any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcast if it is counted and has at most ``rows`` rows.

    Larger tables join by shuffle, where adaptive execution splits hot keys.
    ``df`` should be a written table, as it is read twice.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short: texts are long, so rows alone must bound memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def n_words(text: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)

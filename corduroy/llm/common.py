"""Helpers that the training-data operators share: the shared folder, written tables, words, bounded Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but the ASCII white space 0x20 and 0x09-0x0D; the same in Java and Python patterns.
WORD_SPACE = "[\\x20\\x09-\\x0D]+"

#: Bytes of an Arrow batch sent to a Python worker, so that long texts don't add up to gigabytes.
BATCH_BYTES = 8 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; in local mode, where it is unset, a temporary one."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corduroy-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and not base.startswith("file:"):
        root = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        base = root.rstrip("/") + base if root != "file:///" else "file://" + base
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/corduroy/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, path: str, sort: str | None = None) -> DataFrame:
    """Write df as Parquet and read it back: cuts lineage with files that outlive lost executors."""
    if sort:
        df = df.sortWithinPartitions(sort)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, unless the session already does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))


def open_fs(uri: str):
    """(pyarrow filesystem, path in it) of a URI; used inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + uri[5:] if re.match("file:/[^/]", uri) else uri)


def crc32_mod(column: str, n: int):
    """crc32 of an id written as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Calls that empty what a worker keeps between rows; see keep_for_a_partition.
_release: list = []


def keep_for_a_partition(clear) -> None:
    """Have ``clear`` called at the end of every partition that map_rows goes through, since workers are used again."""
    _release.append(clear)


def partition_end() -> None:
    """Free what a worker keeps, and Arrow's unused memory, when a partition has been gone through."""
    import pyarrow as pa

    for clear in _release:
        clear()
    pa.default_memory_pool().release_unused()


def frame(rows: list, columns: list[str]):
    """A pandas frame of objects: integers stay exact beside nulls."""
    import pandas as pd

    return pd.DataFrame(rows, columns=columns, dtype=object)


def map_rows(df: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    """fn from an iterator of pandas frames to one, in byte-bounded Arrow batches; 64-bit integers stay exact beside nulls."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches):
        import pyarrow as pa

        try:
            for frame in fn(b.to_pandas(integer_object_nulls=True) for b in batches):
                yield pa.RecordBatch.from_pandas(frame, schema=arrow, preserve_index=False)
        finally:
            partition_end()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, kind)

"""Session defaults that the engine's semantics rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corduroy", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ANSI mode stays on. Extra settings by keyword with "__" for "."."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; in local mode, where it is unset, a temporary one."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if conf.get("spark.master", "local").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corduroy-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def steps(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes a step of an operator as Parquet in a new folder of the shared one and reads it back."""
    root = f"{shared_folder(spark)}/corduroy/steps-{uuid.uuid4().hex[:12]}"

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    return write

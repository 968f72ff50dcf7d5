"""Layered writes, idempotent registration, coercion and lineage rows."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import upsert


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder (or a pattern of folders) holds a whole write: one that ended with its success file."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def write_bronze(df: DataFrame, root: str, dataset: str, version: str, md5: str, stamp: str = "") -> tuple[str, bool]:
    """(path, written): a source with a known checksum is not written again; another one gets a folder of its own beside it.

    Every write adds a row to the register below the dataset (path, version, source_md5, stamp, superseded); the rows of earlier
    checksums are then marked as superseded by it.
    """
    spark, base = df.sparkSession, f"{root}/bronze/{dataset}"
    path = f"{base}/v={version}/md5={md5}"
    if exists(spark, path):
        return path, False
    df.write.mode("overwrite").parquet(path)
    row = spark.createDataFrame([(path, version, md5, stamp)], "path string, version string, source_md5 string, stamp string")
    row.write.mode("append").parquet(f"{base}/register")
    return path, True


def bronze_register(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """The register of a dataset's writes with ``superseded``: whether a later stamp has another checksum."""
    rows = spark.read.parquet(f"{root}/bronze/{dataset}/register")
    last = rows.agg(F.max_by("source_md5", F.struct("stamp", "path")).alias("_last"))
    return rows.join(F.broadcast(last)).withColumn("superseded", F.col("source_md5") != F.col("_last")).drop("_last")  # one row


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """Rows as CSV with a header, in UTF-8; with bom, the header line begins with a byte-order mark for spreadsheet programs."""
    names = {c: f"\ufeff{c}" for c in df.columns[:1]} if bom else {}
    df.withColumnsRenamed(names).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_json(df: DataFrame, path: str, nested: dict[str, list[str]] | None = None) -> None:
    """Rows as JSON lines; ``nested`` gathers columns into objects by name."""
    nested = nested or {}
    inner = {c for cols in nested.values() for c in cols}
    shown = [F.col(c) for c in df.columns if c not in inner] + [F.struct(*cols).alias(name) for name, cols in nested.items()]
    df.select(*shown).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def segments_json(segments: DataFrame, vertices: DataFrame) -> DataFrame:
    """segments with ``coords``, the array of [lon, lat] of their vertices (seg_id, i, lat, lon) in order."""
    lines = vertices.groupBy("seg_id").agg(F.array_sort(F.collect_list(F.struct("i", "lon", "lat"))).alias("_p"))  # one segment's own vertices
    points = F.transform(F.col("_p"), lambda p: F.array(p["lon"], p["lat"]))
    return segments.join(lines.select("seg_id", points.alias("coords")), "seg_id", "left")


def flat_routes(routes: DataFrame) -> DataFrame:
    """A row for each vertex of routes (route_id, geometry: array of [lon, lat]): route_id, orden, lat, lon."""
    at = routes.select("route_id", F.posexplode("geometry").alias("orden", "p"))
    return at.select("route_id", F.col("orden").cast("long").alias("orden"), F.col("p")[1].alias("lat"), F.col("p")[0].alias("lon"))


def write_layer(df: DataFrame, root: str, layer: str, dataset: str, version: str, stamp: str = "") -> str:
    """Rows of a dataset in a layer; a row about each write goes to the layer's register of the dataset."""
    path = f"{root}/{layer}/{dataset}/v={version}"
    df.write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    about = [(path, version, stamp, spark.read.parquet(path).count(), [f"{c} {kind}" for c, kind in df.dtypes])]
    spark.createDataFrame(about, "path string, version string, stamp string, n_rows long, columns array<string>").coalesce(1).write.mode("append").json(f"{root}/{layer}/{dataset}/register")
    return path


def coerce_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns to numbers, else to dates, where nothing is lost by it; the counts come from one pass."""
    if not columns:
        return df
    n = df.agg(*[x for c in columns for x in (F.count(c).alias(f"{c}__n"), F.count(F.col(c).try_cast("double")).alias(f"{c}__d"), F.count(F.col(c).try_cast("date")).alias(f"{c}__t"))]).first()
    kind = {c: "double" if n[f"{c}__n"] == n[f"{c}__d"] else "date" if n[f"{c}__n"] == n[f"{c}__t"] else None for c in columns}
    return df.withColumns({c: F.col(c).try_cast(k) for c, k in kind.items() if k})


def archive_new(archive: DataFrame, batch: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Rows of a batch whose key the archive doesn't hold, once each, with the time they were first seen."""
    return batch.dropDuplicates(keys).join(archive.select(*keys).distinct(), keys, "left_anti").withColumn("primera_vista", F.lit(stamp))


def code_digest(*modules) -> str:
    """A hash of the source files of modules, so that a fingerprint tells runs of different code apart."""
    digest = hashlib.sha256()
    for m in modules:
        with open(m.__file__, "rb") as f:
            digest.update(f.read())
    return digest.hexdigest()


def fingerprint(*parts: object) -> str:
    """Hash of code and configuration that took part in a measurement."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def record_lineage(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], stamp: str = "created_at") -> DataFrame:
    """Add rows to a lineage table, kept as appended Parquet below path; gives its present state, the latest row of each key."""
    rows.write.mode("append").parquet(path)
    return lineage(spark, path, keys, stamp)


def lineage(spark: SparkSession, path: str, keys: list[str], stamp: str = "created_at") -> DataFrame:
    every = spark.read.parquet(path)
    return upsert(every, every.limit(0), keys, stamp)

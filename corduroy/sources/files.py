"""Readers by kind of file, text sniffing, spreadsheets and shapefiles."""

from __future__ import annotations

import struct
import zipfile
from io import BytesIO
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_date

#: Lines by which the encoding and the separator of a CSV file are told.
SNIFFED = 200
_READERS: dict = {}


def register(kind: str):
    def add(fn):
        _READERS[kind] = fn
        return fn

    return add


def read(spark: SparkSession, spec: dict) -> DataFrame:
    """Read ``spec`` (source_type, path, options); an unknown type is a ValueError. New types: ``register``."""
    kind = spec.get("source_type")
    if kind not in _READERS:
        raise ValueError(f"unknown source type {kind!r}; known: {', '.join(sorted(_READERS))}")
    return _READERS[kind](spark, spec["path"], **spec.get("options", {}))


@register("csv")
def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8", schema=None, header: bool = True, dates: dict | None = None, numeric: list | None = None) -> DataFrame:
    """Rows of CSV files; sep and encoding may be "auto", dates names columns with their formats, numeric columns with numbers.

    A byte-order mark is no part of the first name. What is no date or number becomes null.
    """
    if "auto" in (sep, encoding):
        whole = spark.read.schema("value string").option("sep", "\u0001").option("quote", "").option("encoding", "ISO-8859-1").csv(path)  # a byte a character
        lines = [r["value"] or "" for r in whole.limit(SNIFFED).collect()]
        head = "\n".join(lines).encode("latin-1", "ignore")
        encoding = sniff_encoding(head) if encoding == "auto" else encoding
        sep = sniff_separator(lines[0] if lines else "") if sep == "auto" else sep
    java = {"utf-8-sig": "UTF-8", "cp1252": "ISO-8859-1", "latin-1": "ISO-8859-1"}.get(encoding, encoding)
    reader = spark.read.option("sep", sep).option("encoding", java).option("header", header)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    if encoding == "cp1252":  # Latin-1 but for 0x80 to 0x9F, and no character set of this reader
        low = {chr(i): bytes([i]).decode("cp1252", "ignore") for i in range(0x80, 0xA0)}
        low = {a: b for a, b in low.items() if b}
        df = df.withColumnsRenamed({c: c.translate(str.maketrans(low)) for c in df.columns})
        df = df.withColumns({c: F.translate(c, "".join(low), "".join(low.values())) for c, kind in df.dtypes if kind == "string"})
    df = df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns if c.startswith("\ufeff")})
    df = df.withColumns({c: parse_date(F.col(c), formats) for c, formats in (dates or {}).items()})
    return df.withColumns({c: F.col(c).try_cast("double") for c in numeric or []})


@register("json")
def read_json(spark: SparkSession, path: str, schema=None, orient: str = "records") -> DataFrame:
    """A list of objects; with orient="index" one object of rows by key, with "columns" one of columns of values by key (``key``).

    The last two need the schema, a DDL list of columns.
    """
    if orient == "index":
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, struct<{schema}>>")))
        return rows.select("key", "value.*")
    if orient == "columns":
        fields = T.StructType.fromDDL(schema).fields
        cells = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("c", "values"))
        flat = cells.select("c", F.explode("values").alias("key", "v"))
        wide = flat.groupBy("key").agg(*[F.max(F.when(F.col("c") == f.name, F.col("v"))).try_cast(f.dataType).alias(f.name) for f in fields])
        return wide
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


@register("parquet")
def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@register("geojson")
def read_geojson(spark: SparkSession, path: str, properties: str, kinds: list[str] | None = None) -> DataFrame:
    """Features as the named properties (a DDL list), kind, coords (array of [lon, lat]), and lon, lat of the first of them.

    Points, lines and polygons (their outer ring) are known; ``kinds`` selects some. Other geometries have null coords.
    """
    schema = f"features array<struct<geometry: struct<type: string, coordinates: string>, properties: struct<{properties}>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    coords = (
        F.when(kind == "Point", F.array(F.from_json(raw, "array<double>")))
        .when(kind == "LineString", F.from_json(raw, "array<array<double>>"))
        .when(kind == "Polygon", F.get(F.from_json(raw, "array<array<array<double>>>"), F.lit(0)))
    )
    out = f.select(F.col("f.properties.*"), kind.alias("kind"), coords.alias("coords"))
    out = out.where(F.col("kind").isin(kinds)) if kinds else out
    first = F.get("coords", F.lit(0))
    return out.select("*", F.get(first, F.lit(0)).alias("lon"), F.get(first, F.lit(1)).alias("lat"))


def sniff_encoding(head: bytes) -> str:
    """utf-8-sig, cp1252 or latin-1: the first that decodes the first bytes of a file."""
    for name in ("utf-8-sig", "cp1252"):
        try:
            head.decode(name)
            return name
        except UnicodeDecodeError as e:
            if name == "utf-8-sig" and e.start >= len(head) - 3:  # cut inside a character
                return name
    return "latin-1"


def sniff_separator(line: str) -> str:
    return ";" if line.count(";") > line.count(",") else ","


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """path, size, modified, md5, sha256 of the files at a path; contents are read in pieces, so a file may be of any size."""

    def digest(batches):
        import hashlib

        import pandas as pd
        from pyarrow import fs

        for pdf in batches:
            rows = []
            for uri, size, modified in zip(pdf["path"], pdf["size"], pdf["modified"]):
                # Spark writes file:/x where a URI has file:///x, and escapes what a URI can't hold
                system, at = fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
                md5, sha = hashlib.md5(), hashlib.sha256()
                with system.open_input_stream(at) as source:
                    while piece := source.read(8 << 20):
                        md5.update(piece)
                        sha.update(piece)
                rows.append((uri, size, modified, md5.hexdigest(), sha.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "size", "modified", "md5", "sha256"])

    found = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return found.mapInPandas(digest, "path string, size long, modified timestamp, md5 string, sha256 string")


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _sheet_number(book: zipfile.ZipFile, name: str) -> int:
    """The place (from 1) of the worksheet with this name; ValueError if there is none."""
    names = [x.get("name") for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if x.tag.endswith("}sheet")]
    if name not in names:
        raise ValueError(f"no sheet {name!r}; there are {', '.join(names)}")
    return names.index(name) + 1


def sheet_rows(data: bytes, sheet: int | str = 1, header_row: int = 0) -> tuple[list[str], list[list[str | None]]]:
    """Header and rows (all text) of a worksheet, by number or name; rows before header_row are preamble."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(BytesIO(data)) as z:
        sheet = _sheet_number(z, sheet) if isinstance(sheet, str) else sheet
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iterfind(".//m:t", ns)) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", ns)]
        rows = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iterfind(".//m:row", ns):
            cells: dict[int, str | None] = {}
            for c in row.iterfind("m:c", ns):
                v, kind = c.find("m:v", ns), c.get("t")
                text = "".join(t.text or "" for t in c.iterfind(".//m:t", ns)) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
                cells[_column(c.get("r", "A"))] = text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    rows = rows[header_row:]
    names = [x or f"c{i}" for i, x in enumerate(rows[0])] if rows else []
    return names, [(r + [None] * len(names))[: len(names)] for r in rows[1:]]


@register("excel")
def read_excel(spark: SparkSession, path: str, columns: list[str] | dict[str, str], sheet: int | str = 1, header_row: int = 0) -> DataFrame:
    """Worksheets of the .xlsx files at a path, as text: columns by name, or by letter ({"B": "km"}); a file is parsed in one task."""
    letters = columns if isinstance(columns, dict) else {}
    columns = list(columns.values()) if letters else columns

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                names, rows = sheet_rows(bytes(content), sheet, header_row)
                at = [_column(x) for x in letters] if letters else [names.index(c) if c in names else None for c in columns]
                yield pd.DataFrame([[None if i is None or i >= len(r) else r[i] for i in at] for r in rows], columns=columns, dtype=object)

    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def shapes(shp: bytes, dbf: bytes) -> list[dict]:
    """Records of a shapefile: its attributes as text, ``coords`` as [x, y] pairs and ``parts``, where each part of them begins."""
    n, head, width = struct.unpack("<IHH", dbf[4:12])
    fields, at, out = [], 32, []
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode("latin-1"), dbf[at + 16]))
        at += 32
    at = 100
    for i in range(n):
        row, place = {}, head + i * width + 1
        for name, size in fields:
            row[name] = dbf[place : place + size].decode("latin-1").strip() or None
            place += size
        (words,) = struct.unpack(">I", shp[at + 4 : at + 8])
        body = shp[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        (kind,) = struct.unpack("<I", body[:4])
        if kind in (3, 5):
            parts, points = struct.unpack("<II", body[36:44])
            flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            row["coords"] = [list(p) for p in zip(flat[::2], flat[1::2])]
            row["parts"] = list(struct.unpack(f"<{parts}I", body[44 : 44 + 4 * parts]))
        elif kind == 1:
            row["parts"] = [0]
            row["coords"] = [list(struct.unpack("<2d", body[4:20]))]
        else:
            row["coords"], row["parts"] = [], []
        out.append(row)
    return out


@register("shapefile")
def read_shapefile(spark: SparkSession, path: str, attributes: list[str]) -> DataFrame:
    """Shapes of the .shp / .dbf pairs in a folder: the attributes as text, coords and parts; a pair is parsed in one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").load(path)
    pairs = files.groupBy(F.regexp_replace("path", "\\.(shp|dbf)$", "").alias("name")).agg(F.max_by("content", "path").alias("shp"), F.min_by("content", "path").alias("dbf"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for a, b in zip(pdf["shp"], pdf["dbf"]):
                rows = shapes(bytes(a), bytes(b))
                yield pd.DataFrame([[r.get(c) for c in attributes] + [r["coords"], r["parts"]] for r in rows], columns=[*attributes, "coords", "parts"])

    return pairs.mapInPandas(run, ", ".join(f"`{c}` string" for c in attributes) + ", coords array<array<double>>, parts array<int>")


def query_files(spark: SparkSession, sql: str, **paths: str) -> DataFrame:
    """The rows of a SQL text over Parquet folders, each under the name given to it: query_files(spark, "SELECT * FROM {a}", a=path)."""
    return spark.sql(sql, **{name: spark.read.parquet(path) for name, path in paths.items()})


def read_table(spark: SparkSession, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table of the session's catalogue, read only."""
    df = spark.table(name)
    return df.select(*columns) if columns else df


def read_configs(folder: str) -> dict[str, dict]:
    """The YAML files of a local folder by name without ending, in order of their names."""
    import glob
    import os

    import yaml

    out = {}
    for path in sorted(glob.glob(os.path.join(folder, "*.y*ml"))):
        with open(path, encoding="utf-8") as f:
            out[os.path.splitext(os.path.basename(path))[0]] = yaml.safe_load(f) or {}
    return out

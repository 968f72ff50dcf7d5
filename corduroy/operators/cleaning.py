"""Configured cleaning: rename, drop, fold, dates, numbers, imputation, first of equal keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold, lenient_double, parse_date
from .ranks import quantiles


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row (in ``order``) of each key; nulls are one key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def impute(df: DataFrame, plan: dict[str, str | tuple], fit: DataFrame | None = None) -> DataFrame:
    """plan: column -> "median", "mode" (ties: smallest), ("constant", value) or "keep".

    Statistics come from ``fit`` (the training rows) if given, else from df itself. A median of no values is 0 where ``fit`` is given.
    """
    source = df if fit is None else fit
    medians = [c for c, how in plan.items() if how == "median"]
    known: dict = {}
    if medians:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in medians])
        found = quantiles(source.select(F.explode(cells).alias("c")).select("c.*"), "x", [0.5], ["column"]).collect()  # a row a column
        known = {c: (0.0 if fit is not None else None) for c in medians} | {r["column"]: r["q"][0] for r in found}
    modes = {c: F.mode(c, True) for c, how in plan.items() if how == "mode"}
    if modes:
        known |= source.agg(*[x.alias(c) for c, x in modes.items()]).first().asDict()
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in known.items() if v is not None})
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(how[1])) for c, how in plan.items() if isinstance(how, tuple)})


def clean(df: DataFrame, spec: dict) -> DataFrame:
    """spec: rename, drop, fold, raw_text (trim only), dates {column: formats}, numeric, impute, key, order; applied in this order.

    Applying it to its own result changes nothing.
    """
    df = df.withColumnsRenamed({k: v for k, v in spec.get("rename", {}).items() if k in df.columns}).drop(*spec.get("drop", []))
    has = lambda names: [c for c in names if c in df.columns]
    kinds = dict(df.dtypes)
    new = {c: fold(F.col(c)) for c in has(spec.get("fold", []))} | {c: fold(F.col(c), accents=False) for c in has(spec.get("raw_text", []))}
    new |= {c: parse_date(F.col(c), spec["dates"][c]) for c in has(spec.get("dates", {})) if kinds[c] == "string"}
    new |= {c: lenient_double(F.col(c)) for c in has(spec.get("numeric", [])) if kinds[c] == "string"}
    df = impute(df.withColumns(new), {c: how for c, how in spec.get("impute", {}).items() if c in df.columns})
    return keep_first(df, spec["key"], spec["order"]) if spec.get("key") else df


def change_log(before: DataFrame, after: DataFrame) -> DataFrame:
    """column, null_before, null_after of the columns that both have, each side in one pass."""
    cols = [c for c in before.columns if c in after.columns]

    def nulls(df, name):
        row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias(name)) for c in cols])).alias("x")).select("x.*")

    return nulls(before, "null_before").join(nulls(after, "null_after"), "column")


def operation_log(df: DataFrame, spec: dict) -> DataFrame:
    """step, operation, column and detail of every step that clean() takes on df with this spec, in its order."""
    renamed = {k: v for k, v in spec.get("rename", {}).items() if k in df.columns}
    rows = [("rename", k, v) for k, v in renamed.items()] + [("drop", c, "") for c in spec.get("drop", [])]
    columns = {renamed.get(c, c) for c in df.columns} - set(spec.get("drop", []))
    for step in ("fold", "raw_text", "dates", "numeric"):
        rows += [(step, c, "|".join(spec[step][c]) if step == "dates" else "") for c in spec.get(step, []) if c in columns]
    rows += [("impute", c, how if isinstance(how, str) else f"{how[0]}={how[1]}") for c, how in spec.get("impute", {}).items() if c in columns]
    rows += [("keep_first", c, spec["order"]) for c in spec.get("key", [])]
    return df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "step int, operation string, `column` string, detail string")

"""Contracts, domain rules, profiles, the data-quality score and its audit."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import in_box
from ..functions.text import fold, record_id
from ..session import steps
from .ranks import quantiles

# The numeric types, and the weights of the score's dimensions.
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
WEIGHTS = {"completeness": 0.22, "validity": 0.22, "uniqueness": 0.15, "consistency": 0.15, "integrity": 0.18, "freshness": 0.08}


def _numeric(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.simpleString().split("(")[0] in NUMERIC


# --- contract ---------------------------------------------------------------------------------------------------------------


def _typed(df: DataFrame, name: str, kind: str) -> Column | None:
    """An aggregate that counts values of another kind than the contract's; None where the column's type can hold no other."""
    c, held = F.col(name), dict(df.dtypes)[name]
    fits = {
        "integer": _numeric(df, name),
        "float": _numeric(df, name),
        "string": held == "string",
        "datetime": held in ("date", "timestamp", "timestamp_ntz"),
        "boolean": held == "boolean",
    }
    if kind not in fits:
        raise ValueError(f"unknown type {kind!r} for column {name!r}")
    if not fits[kind]:
        return F.count(c)
    return F.count_if(c.isNotNull() & (c % 1 != 0)) if kind == "integer" else None


def _bounded(df: DataFrame, name: str, low: bool, bound) -> Column:
    """Whether a value is beyond a bound: as a number, as a date (also for texts that are dates), else as text."""
    c = F.col(name)
    beyond = (lambda v, x: v < x) if low else (lambda v, x: v > x)
    if _numeric(df, name):
        return beyond(c.try_cast("double"), F.lit(bound))
    if dict(df.dtypes)[name] in ("date", "timestamp", "timestamp_ntz"):
        return beyond(c.cast("date"), F.lit(str(bound)).try_cast("date"))
    text, limit = c.cast("string"), F.lit(str(bound))
    return F.coalesce(beyond(text.try_cast("date"), limit.try_cast("date")), beyond(text, limit))


def _rule_columns(df: DataFrame, contract: dict, as_of: str | None) -> dict[tuple[str, str], Column]:
    """An aggregate that counts the offending rows, for each (column, rule)."""
    out: dict[tuple[str, str], Column] = {}
    for name, spec in contract["columns"].items():
        if name not in df.columns:
            continue
        c = F.col(name)
        if spec.get("nullable") is False:
            out[name, "nullable"] = F.count_if(c.isNull())
        if spec.get("type") and (wrong := _typed(df, name, spec["type"])) is not None:
            out[name, "type"] = wrong
        if spec.get("unique"):
            out[name, "unique"] = F.count("*") - F.count_distinct(F.struct(c))  # nulls are one value
        for rule in ("min", "max"):
            if rule in spec:
                out[name, rule] = F.count_if(_bounded(df, name, rule == "min", spec[rule]))
        for rule, bad in (("min_date", lambda v, x: v < x), ("max_date", lambda v, x: v > x)):
            if rule in spec:
                out[name, rule] = F.count_if(bad(c.try_cast("date"), F.lit(spec[rule]).cast("date")))
        if "max_before_today_days" in spec:
            if as_of is None:
                raise ValueError(f"column {name!r}: max_before_today_days needs as_of")
            latest = F.date_sub(F.lit(as_of).cast("date"), spec["max_before_today_days"])
            out[name, "max_before_today_days"] = F.count_if(c.try_cast("date") > latest)
        if "pattern" in spec:
            out[name, "pattern"] = F.count_if(c.isNotNull() & ~c.cast("string").rlike(f"^(?:{spec['pattern']})"))
        if "allowed_values" in spec:
            out[name, "allowed_values"] = F.count_if(_disallowed(df, name, spec["allowed_values"]))
        if "min_length" in spec:
            out[name, "min_length"] = F.count_if(F.length(c) < spec["min_length"])
        if "max_length" in spec:
            out[name, "max_length"] = F.count_if(F.length(c) > spec["max_length"])
    return out


def in_catalog(c: Column, values: list) -> Column:
    """Whether a value is one of the catalogue's, folded on both sides; a catalogue is configuration, so its size is the file's."""
    return F.coalesce(fold(c).isin([fold(F.lit(str(v))) for v in values]), F.lit(False))


def _disallowed(df: DataFrame, name: str, allowed: list) -> Column:
    c = F.col(name)
    return c.isNotNull() & ~(F.coalesce(c.isin(allowed), F.lit(False)) if _numeric(df, name) else in_catalog(c, allowed))


def contract_report(df: DataFrame, contract: dict, as_of: str | None = None) -> DataFrame:
    """(column, rule, n) of every broken rule, from one pass; missing and extra columns are rules of their own."""
    fixed = [(c, "missing", 1) for c in contract["columns"] if c not in df.columns]
    if contract.get("allow_extra", True) is False:
        fixed += [(c, "extra", 1) for c in df.columns if c not in contract["columns"]]
    rules = _rule_columns(df, contract, as_of)
    start = df.sparkSession.createDataFrame(fixed, "`column` string, rule string, n long")
    if not rules:
        return start
    counts = df.agg(*[x.cast("long").alias(f"r{i}") for i, x in enumerate(rules.values())])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.col(f"r{i}").alias("n")) for i, (c, r) in enumerate(rules)])
    return start.unionByName(counts.select(F.explode(rows).alias("x")).select("x.*").where("n > 0"))


def contract_errors(report: DataFrame) -> DataFrame:
    """report with a message for each broken rule."""
    text = F.format_string("%s: %d %s", F.col("column"), F.col("n"), F.concat(F.lit("break rule "), F.col("rule")))
    message = F.when(F.col("rule") == "missing", F.concat("column", F.lit(": missing"))).when(F.col("rule") == "extra", F.concat("column", F.lit(": not in the contract")))
    return report.withColumn("message", message.otherwise(text))


def contract_valid(report: DataFrame) -> DataFrame:
    """One row: valid, n_errors (broken rules) and n_values (offending values)."""
    return report.agg((F.count("*") == 0).alias("valid"), F.count("*").alias("n_errors"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_values"))


def disallowed_examples(df: DataFrame, contract: dict, most: int = 5) -> DataFrame:
    """column and examples: the first distinct values, in order, that a column's allowed_values lack."""
    found = None
    for name, spec in contract["columns"].items():
        if name in df.columns and "allowed_values" in spec:
            bad = df.where(_disallowed(df, name, spec["allowed_values"])).select(F.lit(name).alias("column"), F.col(name).cast("string").alias("value"))
            found = bad if found is None else found.unionByName(bad)
    if found is None:
        return df.sparkSession.createDataFrame([], "`column` string, examples array<string>")
    first = Window.partitionBy("column").orderBy("value")
    few = found.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= most)
    return few.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("examples"))


def contract_ranges(contract: dict) -> dict[str, tuple[float, float]]:
    """(low, high) of the numeric columns of a contract that declare a bound; an open side is infinite."""
    out = {}
    for name, spec in contract["columns"].items():
        if spec.get("type") in ("integer", "float") and (spec.get("min") is not None or spec.get("max") is not None):
            low, high = spec.get("min"), spec.get("max")
            out[name] = (-math.inf if low is None else low, math.inf if high is None else high)
    return out


def resolve_catalogs(columns: list[str], catalogs: dict[str, list], aliases: dict[str, str]) -> dict[str, list]:
    """Catalogues by the column that their name stands for; empty ones and those of absent columns are left out."""
    named = {aliases.get(name, name): values for name, values in catalogs.items() if values}
    return {c: values for c, values in named.items() if c in columns}


def contract_spec(df: DataFrame, contract: dict, catalogs: dict[str, list] | None = None, aliases: dict[str, str] | None = None, **more) -> dict:
    """The score's spec that a contract implies: required and numeric columns, ranges, catalogues and the primary key."""
    cols = contract["columns"]
    return {
        "required": [c for c, r in cols.items() if r.get("nullable", True) is False and c in df.columns],
        "numeric": [c for c, r in cols.items() if r.get("type") in ("integer", "float") and c in df.columns],
        "ranges": contract_ranges(contract),
        "catalogs": resolve_catalogs(df.columns, catalogs or {}, aliases or {}),
        "key": contract.get("primary_key", []),
    } | more


# --- domain rules -----------------------------------------------------------------------------------------------------------


def rule_flags(df: DataFrame, rules: list[dict], as_of: str) -> list[tuple[dict, str, Column]]:
    """(rule, column, how often the row breaks it) for the rule kinds below."""
    out = []
    for r in rules:
        kind, c = r["kind"], r.get("column")
        col = F.col(c) if c else None
        if kind in ("pk_not_null", "fecha_parsable"):
            out.append((r, c, col.isNull()))
        elif kind == "pk_unique":
            out.append((r, c, F.row_number().over(Window.partitionBy(c).orderBy(r["order"])) > 1))
        elif kind == "fecha_no_futura":
            out.append((r, c, col > F.lit(as_of).cast("date")))
        elif kind == "coordenadas":
            lat, lon = (F.col(x) for x in r["columns"])
            out.append((r, ",".join(r["columns"]), lat.isNotNull() & lon.isNotNull() & ~in_box(lat, lon, r["box"])))
        elif kind == "no_negativos":
            out += [(r, x, F.col(x) < 0) for x in r["columns"]]
        elif kind == "catalogo":
            out.append((r, c, col.isNotNull() & ~in_catalog(col, r["values"])))
        elif kind == "rango":
            beyond = (col < r["min"]) | (col > r["max"])
            other = r.get("limit")  # (column, greatest value) of the limit that the value is held against
            out.append((r, c, F.coalesce(beyond, F.lit(False)) | F.coalesce(F.col(other[0]) > other[1], F.lit(False)) if other else beyond))
        elif kind == "formato":
            out.append((r, c, col.isNotNull() & ~col.rlike(r["pattern"])))
        elif kind == "consistencia":
            out.append((r, ",".join(r["columns"]), F.col(r["columns"][0]).isNotNull() & F.col(r["columns"][1]).isNull()))
        else:
            raise ValueError(f"unknown rule kind {kind!r}")
    return out


def violations(df: DataFrame, rules: list[dict], row_id: str, as_of: str) -> DataFrame:
    """One row per row and broken rule: row_id, rule, column, severity."""
    flags = rule_flags(df, rules, as_of)
    marked = df.select(F.col(row_id).alias("row_id"), *[F.coalesce(x, F.lit(False)).alias(f"f{i}") for i, (_, _, x) in enumerate(flags)])
    found = F.array(*[F.when(F.col(f"f{i}"), F.struct(F.lit(r["name"]).alias("rule"), F.lit(c).alias("column"), F.lit(r["severity"]).alias("severity"))) for i, (r, c, _) in enumerate(flags)])
    return marked.select("row_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("row_id", "x.*")


def violation_table(found: DataFrame, most: int = 0) -> DataFrame:
    """rule, column, severity, n; with ``most``, also ``rows``: the smallest row ids, so many at most."""
    keys = ["rule", "column", "severity"]
    n = found.groupBy(*keys).agg(F.count("*").alias("n"))
    if not most:
        return n
    few = found.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("row_id"))).where(F.col("_n") <= most)
    return n.join(few.groupBy(*keys).agg(F.array_sort(F.collect_list("row_id")).alias("rows")), keys)


def quarantine(df: DataFrame, found: DataFrame, row_id: str, dataset: str) -> DataFrame:
    """A record per row and critical rule, with a repeatable id and the row as JSON."""
    critical = found.where("severity = 'critical'").select("row_id", "rule")
    body = df.select(F.col(row_id).alias("row_id"), F.to_json(F.struct(*df.columns)).alias("record"))
    return critical.join(body, "row_id").select(record_id(F.lit(dataset), F.col("row_id"), F.col("rule")).alias("quarantine_id"), "row_id", "rule", "record")


# --- score ------------------------------------------------------------------------------------------------------------------


def _flags(df: DataFrame, spec: dict, as_of: str) -> dict[str, list[Column]]:
    """For each dimension that rows bear on, a flag for each check; null where the row doesn't count."""
    cols, ranges = df.columns, spec.get("ranges", {})
    default = {c: (0.0, math.inf) for c in spec.get("numeric", []) if c not in ranges}
    checks = [F.col(c).between(*r) for c, r in {**default, **ranges}.items() if c in cols]
    checks += [F.when(F.col(c).isNotNull(), in_catalog(F.col(c), v)) for c, v in spec.get("catalogs", {}).items() if c in cols]
    out = {
        "completeness": [F.col(c).isNotNull() for c in spec["required"] if c in cols],
        "validity": checks,
        "consistency": [F.col(c) == F.upper(F.col(c)) for c in spec.get("nominal", []) if c in cols],
    }
    if spec.get("date"):
        since = F.date_sub(F.lit(as_of).cast("date"), spec.get("window_days", 365))
        out["freshness"] = [F.col(spec["date"]).try_cast("date") >= since]
    return out


def _mean_share(flags: list[Column], empty: float) -> Column:
    """The mean over the flags, in per cent, of the share of rows that meet each; flags that count nowhere are left out."""
    shares = [F.avg(x.cast("double")) for x in flags]
    seen = sum((x.isNotNull().cast("int") for x in shares), F.lit(0))
    return 100.0 * F.coalesce(F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in shares), F.lit(0.0)), seen), F.lit(empty))


def _keys(spec: dict, columns: list[str]) -> list[str]:
    keys = spec.get("key") or []
    return [k for k in ([keys] if isinstance(keys, str) else keys) if k in columns]


def dimensions(df: DataFrame, spec: dict, as_of: str) -> DataFrame:
    """One row of the six dimensions (0 to 100, two decimals) and the weighted score ``dqs``, from one pass.

    spec: required, numeric (0 or more where no range is given), ranges {column: (low, high)}, catalogs {column: values}, key (one
    column or several), nominal, date, window_days, integrity and weights. Checks of columns without values are left out; without
    any check a dimension is 100, but without any date freshness is 0.
    """
    flags, keys = _flags(df, spec, as_of), _keys(spec, df.columns)
    repeats = F.count("*") - F.count_distinct(F.struct(*keys)) if keys else F.lit(0)
    unique = 100.0 * (1 - F.coalesce(F.try_divide(repeats, F.count("*")), F.lit(0.0)))
    row = df.agg(
        F.round(_mean_share(flags["completeness"], 1.0), 2).alias("completeness"),
        F.round(_mean_share(flags["validity"], 1.0), 2).alias("validity"),
        F.round(unique, 2).alias("uniqueness"),
        F.round(_mean_share(flags["consistency"], 1.0), 2).alias("consistency"),
        F.lit(float(spec.get("integrity", 100.0))).alias("integrity"),
        F.round(_mean_share(flags["freshness"], 0.0) if "freshness" in flags else F.lit(100.0), 2).alias("freshness"),
    )
    return row.withColumn("dqs", weighted(spec.get("weights", WEIGHTS)))


def weighted(weights: dict[str, float]) -> Column:
    """The score of a row of dimensions under some weights."""
    return F.round(sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)), 2)


def weight_scenarios(dims: DataFrame, scenarios: dict[str, dict[str, float]], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """scenario, dqs and delta (against the given weights) of a row of dimensions, for named weights that add up to 1."""
    fair = {name: w for name, w in scenarios.items() if abs(sum(w.values()) - 1.0) <= 1e-3}
    rows = [F.struct(F.lit(name).alias("scenario"), weighted(w).alias("dqs"), F.round(weighted(w) - weighted(weights), 2).alias("delta")) for name, w in fair.items()]
    return dims.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def integrity_share(df: DataFrame, fk: str, ref: DataFrame, key: str) -> DataFrame:
    """Percentage of non-null foreign keys that exist; 100 without any."""
    known = ref.select(F.col(key).alias(fk)).distinct().withColumn("_ok", F.lit(True))
    held = df.where(F.col(fk).isNotNull()).join(known, fk, "left")
    return held.agg(F.round(100.0 * F.coalesce(F.avg(F.coalesce("_ok", F.lit(False)).cast("double")), F.lit(1.0)), 2).alias("integrity"))


def gate(dqs: float, critical: int, threshold: float = 90.0) -> str:
    """FAILED with critical violations, WARNING below the threshold, else PASSED."""
    return "FAILED" if critical else "WARNING" if dqs < threshold else "PASSED"


def gate_column(dqs: Column, critical: Column, threshold: float = 90.0) -> Column:
    """gate() as an expression."""
    return F.when(critical > 0, "FAILED").when(dqs < threshold, "WARNING").otherwise("PASSED")


def model_ready(contract_ok: bool, gate_status: str, lineage: bool, critical: int, dqs: float, version: str | None, min_dqs: float = 90.0) -> dict:
    checks = {"contract": contract_ok, "gate": gate_status == "PASSED", "lineage": lineage, "no_critical": not critical, "dqs": dqs >= min_dqs, "version": bool(version)}
    return checks | {"model_ready": all(checks.values())}


# --- profile and audit ------------------------------------------------------------------------------------------------------


def profile(df: DataFrame, top: int = 0) -> DataFrame:
    """A row per column: dtype, n_rows, n_null, pct_null, n_unique, and for numbers min, max, mean, std, q25, q75 (with ``top``, top_values too).

    The table is melted once into counted (column, value) pairs, which are written and then summed: no task holds a column's values.
    """
    kinds = F.create_map(*[F.lit(x) for c, k in df.dtypes for x in (c, k)])
    order = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns) for x in (c, i)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), (F.col(c).cast("double") if _numeric(df, c) else F.lit(None).cast("double")).alias("x")) for c in df.columns]
    melted = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    counted = steps(df.sparkSession)(melted.groupBy("column", "value", "x").agg(F.count("*").alias("n")), "counted")
    known, x, n = F.col("value").isNotNull(), F.col("x"), F.col("n")
    held = F.sum(F.when(x.isNotNull(), n))
    mean = F.try_divide(F.sum(x * n), held)
    rows = counted.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(known, 0).otherwise(n)).alias("n_null"), F.count_if(known).alias("n_unique"),
        F.min("x").alias("min"), F.max("x").alias("max"), mean.alias("mean"), held.alias("_held"),
    )
    centred = counted.where("x IS NOT NULL").join(F.broadcast(rows.select("column", F.col("mean").alias("_m"))), "column")  # a row a column
    spread = centred.groupBy("column").agg(F.sqrt(F.try_divide(F.sum(F.pow(x - F.col("_m"), F.lit(2)) * n), F.sum("n") - 1)).alias("std"))
    q = quantiles(counted, "x", [0.25, 0.75], ["column"], "n").select("column", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q75"))
    out = rows.join(spread, "column", "left").join(q, "column", "left")
    if top:
        few = top_values(df, df.columns, top).groupBy("column").agg(F.array_sort(F.collect_list(F.struct(-F.col("n"), "value"))).alias("_t"))
        out = out.join(few.select("column", F.col("_t.value").alias("top_values")), "column", "left")
    pct = F.round(100.0 * F.try_divide(F.col("n_null"), F.col("n_rows")), 2)
    shown = ["column", kinds[F.col("column")].alias("dtype"), "n_rows", "n_null", pct.alias("pct_null"), "n_unique", "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "q25", "q75"]
    return out.orderBy(order[F.col("column")]).select(*shown, *(["top_values"] if top else []))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, mean, std, min, q25, q50, q75 and max of numeric columns."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("c")
    melted = df.select(cells).select("c.*")
    rows = melted.groupBy("column").agg(F.count("x").alias("count"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    q = quantiles(melted, "x", [0.25, 0.5, 0.75], ["column"])
    return rows.join(q, "column", "left").select("column", "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """column, value, n, pct of the k most frequent values of each column (ties: smaller value)."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    n = df.select(cells).select("x.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    total = n.groupBy("column").agg(F.sum("n").alias("total"))
    first = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    few = n.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return few.join(F.broadcast(total), "column").select("column", "value", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"))  # a row a column


def null_delta(before: DataFrame, after: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Null percentages of two profiles side by side, through the rename map."""
    names = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv]) if renames else None
    name = F.coalesce(names[F.col("column")], F.col("column")) if renames else F.col("column")
    b = before.select(name.alias("column"), F.col("pct_null").alias("before"))
    return b.join(after.select("column", F.col("pct_null").alias("after")), "column", "full_outer").withColumn("resolved", F.round(F.coalesce("before", F.lit(0.0)) - F.coalesce("after", F.lit(0.0)), 2))


def weight_sensitivity(dims: dict[str, float], weights: dict[str, float] = WEIGHTS, draws: int = 300, seed: int = 7) -> dict:
    """Spread of the score under Dirichlet weights around the given ones; the score is linear, so no data is read again."""
    rng = random.Random(seed)
    scores = []
    for _ in range(draws):
        g = {k: rng.gammavariate(100 * w, 1) for k, w in weights.items()}
        scores.append(sum(g[k] * dims[k] for k in g) / sum(g.values()))
    scores.sort()
    at = lambda q: scores[min(draws - 1, int(q * draws))]
    return {"p05": at(0.05), "p50": at(0.50), "p95": at(0.95), "spread": at(0.95) - at(0.05)}


def sensitivity_verdict(spread: float, robust: float = 5.0, fragile: float = 12.0) -> str:
    """ALTA for a score that weights hardly move, BAJA for one that they move much, else MEDIA."""
    return "ALTA" if spread <= robust else "BAJA" if spread >= fragile else "MEDIA"


def bootstrap_interval(df: DataFrame, flags: list[Column], draws: int = 300, seed: int = 7) -> dict:
    """95 % interval of the mean of 0/1 flags (null: not counted), by a Poisson bootstrap of the rows; see _drawn_shares."""
    shares = _drawn_shares(df, {"flags": flags}, draws, seed)
    drawn = sorted(100 * x for x in shares[1:, 0])
    return {"point": 100 * float(shares[0, 0]), "low": drawn[int(0.025 * draws)], "high": drawn[min(draws - 1, int(0.975 * draws))]}


def _drawn_shares(df: DataFrame, flags: dict[str, list[Column]], draws: int, seed: int):
    """Array of shares (NaN where nothing counts): row 0 as observed, then a row a draw; a column for each group, the mean over its flags.

    Every row counts Poisson(1) times in a draw. Rows with equal flags are interchangeable, so a combination of flags with n rows
    counts Poisson(n) times, drawn from a seed of its own: results depend neither on partitions nor on retries. Tasks add up what
    each flag meets and holds in each draw; what comes to the driver is draws x flags numbers, however many combinations there are.
    """
    import numpy as np

    groups = [g for g, xs in flags.items() for _ in xs]
    columns = [x.cast("int").alias(f"f{i}") for i, x in enumerate(x for xs in flags.values() for x in xs)]
    names = [f"f{i}" for i in range(len(columns))]
    counts = df.groupBy(*columns).agg(F.count("*").alias("n")).withColumn("key", F.xxhash64(*[F.coalesce(c, F.lit(-1)) for c in names]))

    def draw(batches):
        import pandas as pd

        met, held = (np.zeros((draws + 1, len(names))) for _ in range(2))
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                some = pdf.iloc[at : at + 1024]
                f, n = some[names].to_numpy(float), some["n"].to_numpy()
                times = np.stack([np.concatenate([[m], np.random.default_rng([seed, k & 0xFFFFFFFFFFFFFFFF]).poisson(m, draws)]) for m, k in zip(n.tolist(), some["key"].tolist())], 1)
                held += times @ ~np.isnan(f)
                met += times @ np.nan_to_num(f)
        d, i = np.nonzero(held)
        yield pd.DataFrame({"d": d.astype("int32"), "i": i.astype("int32"), "met": met[d, i].astype("int64"), "held": held[d, i].astype("int64")})

    sums = counts.mapInPandas(draw, "d int, i int, met long, held long").groupBy("d", "i").agg(F.sum("met").alias("met"), F.sum("held").alias("held"))
    each = np.full((draws + 1, len(names)), np.nan)
    for d, i, met, held in sums.collect():  # draws x flags rows
        each[d, i] = met / held
    out = np.full((draws + 1, len(flags)), np.nan)
    for k, group in enumerate(flags):
        x = each[:, [i for i, g in enumerate(groups) if g == group]]
        seen = (~np.isnan(x)).sum(1)
        out[seen > 0, k] = np.nansum(x[seen > 0], 1) / seen[seen > 0]
    return out


def bootstrap_score(df: DataFrame, spec: dict, as_of: str, draws: int = 300, seed: int = 42) -> DataFrame:
    """dimension, point, low, high, width, std and centred: 95 % intervals of the score and of its dimensions, from whole-table counts.

    Uniqueness and integrity stay at what was observed, since resampling rows would repeat their keys.
    """
    import numpy as np

    spark, weights = df.sparkSession, spec.get("weights", WEIGHTS)
    schema = "dimension string, point double, low double, high double, width double, std double, centred boolean"
    observed = dimensions(df, spec, as_of).first().asDict()
    flags = {k: x for k, x in _flags(df, spec, as_of).items() if x}
    shares = _drawn_shares(df, flags, draws, seed)
    empty = {"freshness": 0.0}
    drawn: dict[str, list[float]] = {k: [] for k in [*weights, "dqs"]}
    for row in shares[1:] if not np.isnan(shares[0]).all() else []:
        now = dict(observed) | {k: round(100 * (empty.get(k, 1.0) if np.isnan(v) else float(v)), 2) for k, v in zip(flags, row)}
        now["dqs"] = round(sum(now[k] * w for k, w in weights.items()), 2)
        for k in drawn:
            drawn[k].append(now[k])
    rows = []
    for k, values in drawn.items():
        low, high = (float(np.percentile(values, x)) for x in (2.5, 97.5)) if values else (observed[k], observed[k])
        point = float(observed[k])
        rows.append((k, point, round(low, 2), round(high, 2), round(high - low, 2), round(float(np.std(values)) if values else 0.0, 3), bool(round(low, 2) <= point <= round(high, 2))))
    return spark.createDataFrame(rows, schema)


def run_drift(runs: DataFrame, min_runs: int = 2, tolerance: float = 0.5) -> DataFrame:
    """dataset, fingerprint, n_runs, range of the score and verdict: runs measured alike should agree."""
    g = runs.groupBy("dataset", "fingerprint").agg(F.count("*").alias("n_runs"), F.round(F.max("dqs") - F.min("dqs"), 4).alias("dqs_range"))
    verdict = F.when(F.col("n_runs") < min_runs, "insufficient").when(F.col("dqs_range") <= tolerance, "stable").otherwise("drift")
    return g.withColumn("verdict", verdict)


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))

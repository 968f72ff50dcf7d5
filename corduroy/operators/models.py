"""Count regressions from Spark aggregates, validation and baselines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import good_surface, log1p_of, nb_distribution, on_main_route
from ..functions.text import corridor
from ..session import steps
from .cleaning import impute
from .ranks import numbered, quantiles


def _linear(columns: list[str], beta, offset: str | None):
    eta = sum((F.col(c) * float(b) for c, b in zip(columns, beta)), F.lit(0.0))
    return eta + F.col(offset) if offset else eta


def fit_counts(df: DataFrame, y: str, columns: list[str], offset: str | None = None, alpha: float = 0.0, steps: int = 30, tol: float = 1e-8) -> dict:
    """Negative-binomial (alpha > 0) or Poisson (alpha = 0) regression with log link by iterated weighted least squares.

    A step is one aggregate of p (p + 1) / 2 + p sums; only those come to the driver. Gives beta, cov, deviance.
    """
    import numpy as np

    p = len(columns)
    mean = df.agg(F.avg(F.col(y))).first()[0] or 1e-3
    beta = np.zeros(p)
    beta[0] = math.log(max(mean, 1e-6)) - (df.agg(F.avg(offset)).first()[0] if offset else 0.0)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    for _ in range(steps):
        eta = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), _linear(columns, beta, offset)))
        rows = df.select(F.col(y).cast("double").alias("_y"), *columns, F.exp(eta).alias("_mu"), (eta - (F.col(offset) if offset else F.lit(0.0))).alias("_xb"))
        w = F.col("_mu") / (1 + alpha * F.col("_mu"))
        z = F.col("_xb") + (F.col("_y") - F.col("_mu")) / F.col("_mu")
        sums = rows.agg(*[F.sum(w * F.col(columns[i]) * F.col(columns[j])) for i, j in pairs], *[F.sum(w * F.col(c) * z) for c in columns]).first()
        a, b = np.zeros((p, p)), np.array(sums[len(pairs) :], float)
        for (i, j), s in zip(pairs, sums):
            a[i, j] = a[j, i] = s
        new = np.linalg.solve(a + 1e-10 * np.eye(p), b)
        moved, beta = np.abs(new - beta).max(), new
        if moved < tol:
            break
    return {"columns": columns, "beta": beta, "cov": np.linalg.inv(a + 1e-10 * np.eye(p)), "alpha": alpha, "offset": offset}


def predict(df: DataFrame, model: dict, name: str = "mu") -> DataFrame:
    return df.withColumn(name, F.exp(F.least(F.lit(30.0), _linear(model["columns"], model["beta"], model["offset"]))))


def log_likelihood(df: DataFrame, y: str, mu: str, alphas: list[float]) -> dict[float, float]:
    """NB2 (alpha > 0) or Poisson (alpha = 0) log-likelihood for each alpha.

    The logarithms of gamma functions depend on the count alone, so they are taken once for each distinct count, whose number is
    small; all else is one aggregate a count.
    """
    m = F.greatest(F.col(mu).cast("double"), F.lit(1e-12))

    def by_mean(a: float):
        if a <= 0:
            return F.col("_y") * F.ln(m) - m
        return (1 / a) * F.ln((1 / a) / (1 / a + m)) + F.col("_y") * F.ln(m / (1 / a + m))

    rows = df.select(F.col(y).cast("double").alias("_y"), mu).groupBy("_y").agg(F.count("*").alias("n"), *[F.sum(by_mean(a)).alias(f"l{i}") for i, a in enumerate(alphas)]).collect()
    total = dict.fromkeys(alphas, 0.0)
    for r in rows:
        for i, a in enumerate(alphas):
            gamma = math.lgamma(r["_y"] + 1 / a) - math.lgamma(1 / a) if a > 0 else 0.0
            total[a] += r[f"l{i}"] + r["n"] * (gamma - math.lgamma(r["_y"] + 1))
    return total


def fit_negative_binomial(df: DataFrame, y: str, columns: list[str], offset: str | None = None, grid: int = 60) -> dict:
    """NB2 with the dispersion from a log grid over [0.01, 50] by profile likelihood, alternated with the fit until it stays."""
    alphas = [0.01 * (50 / 0.01) ** (i / (grid - 1)) for i in range(grid)]
    model, alpha = fit_counts(df, y, columns, offset), None
    for _ in range(6):
        ll = log_likelihood(predict(df, model), y, "mu", alphas)
        best = max(alphas, key=lambda a: ll[a])
        if best == alpha:
            break
        alpha = best
        model = fit_counts(df, y, columns, offset, alpha)
    null = fit_counts(df.withColumn("_one", F.lit(1.0)), y, ["_one"], offset, alpha)
    ll_null = log_likelihood(predict(df.withColumn("_one", F.lit(1.0)), null), y, "mu", [alpha])[alpha]
    ll_full = log_likelihood(predict(df, model), y, "mu", [alpha])[alpha]
    return model | {"loglik": ll_full, "mcfadden": 1 - ll_full / ll_null, "aic": 2 * (len(columns) + 1) - 2 * ll_full}


def rate_ratios(model: dict) -> list[dict]:
    """Per column: rate ratio with 95 % interval and two-sided p."""
    out = []
    for i, c in enumerate(model["columns"]):
        b, se = float(model["beta"][i]), math.sqrt(max(float(model["cov"][i, i]), 0.0))
        out.append({"column": c, "irr": math.exp(b), "low": math.exp(b - 1.96 * se), "high": math.exp(b + 1.96 * se), "p": math.erfc(abs(b / se) / math.sqrt(2)) if se else float("nan")})
    return out


def cluster_cov(df: DataFrame, model: dict, y: str, cluster: str):
    """Sandwich covariance with scores summed by cluster."""
    import numpy as np

    cols, a = model["columns"], model["alpha"]
    score = (F.col(y) - F.col("mu")) / (1 + a * F.col("mu"))
    sums = predict(df, model).groupBy(cluster).agg(*[F.sum(score * F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)])
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols))]
    row = sums.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i, j in pairs]).first()
    meat = np.array(row, float).reshape(len(cols), len(cols))
    return model["cov"] @ meat @ model["cov"]


def metrics(df: DataFrame, y: str, mu: str) -> DataFrame:
    """One row: mae, rmse, r2, deviance (null if a mean is not positive), bias."""
    e = F.col(y) - F.col(mu)
    d = 2 * (F.when(F.col(y) > 0, F.col(y) * F.ln(F.greatest(F.col(y).cast("double"), F.lit(1e-300)) / F.col(mu))).otherwise(0.0) - e)
    total = F.sum(F.pow(F.col(y), F.lit(2))) - F.pow(F.sum(y), F.lit(2)) / F.count("*")
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.nullif(total, F.lit(0.0)))).alias("r2"), F.when(F.min(mu) > 0, F.avg(F.when(F.col(mu) > 0, d))).alias("deviance"), F.avg(-e).alias("bias"))


def group_folds(sizes: dict[str, int], k: int = 5) -> dict[str, int]:
    """Groups to folds, the largest first to the lightest fold."""
    load, out = [0] * k, {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = min(range(k), key=lambda i: (load[i], i))
        out[g], load[f] = f, load[f] + n
    return out


def split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """df with ``is_test``: a repeatable share of the keys, the same for equal keys wherever they lie."""
    return df.withColumn("is_test", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(test * 1_000_000))


def split_exactly(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """df with ``is_test``: the first floor(n * test) rows of a repeatable shuffle (by a hash of the unique key)."""
    n = df.agg(F.count("*").alias("_n"))
    at = numbered(df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))), ["_h", key], "_i").join(F.broadcast(n))  # one row
    return at.withColumn("is_test", F.col("_i") < F.floor(F.col("_n") * test)).drop("_h", "_i", "_n")


def interval_coverage(df: DataFrame, y: str, mu: str, alpha: float, level: float) -> float:
    """The coverage of interval_counts as a number."""
    return interval_counts(df, y, mu, alpha, level).first()["coverage"]


def interval_counts(df: DataFrame, y: str, mu: str, alpha: float, level: float) -> DataFrame:
    """One row: n, n_inside and coverage, the per cent of counts within the central NB2 interval (size 1 / alpha, p 1 / (1 + alpha mu))."""
    low, high = (1 - level) / 2, 1 - (1 - level) / 2
    upto, before = nb_distribution(F.col("_y"), F.col("_m"), alpha)
    rows = df.where(F.col(y).isNotNull() & F.col(mu).isNotNull()).groupBy(F.col(y).cast("double").alias("_y"), F.col(mu).cast("double").alias("_m")).agg(F.count("*").alias("_n"))
    inside = rows.select("_n", ((upto >= low) & (before < high)).alias("_ok"))
    out = inside.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("_ok"), F.col("_n"))), F.lit(0)).alias("n_inside"))
    return out.withColumn("coverage", 100.0 * F.try_divide(F.col("n_inside"), F.col("n")))


# --- checks before a fit, and what is reported after it


def checked_design(df: DataFrame, columns: list[str], exposure: str) -> tuple[DataFrame, list[str], list[str]]:
    """(df with ``log_expo``, columns that vary, constant ones): the design for an offset regression, from one pass.

    An exposure that is null, not finite or not positive raises ValueError instead of being clipped.
    """
    x = F.col(exposure).cast("double")
    bad = F.count_if(x.isNull() | F.isnan(x) | (x <= 0) | (x == math.inf))
    row = df.agg(bad.alias("_bad"), F.count("*").alias("_n"), F.min(x).alias("_low"), *[(F.min(c).eqNullSafe(F.max(c)) & (F.count(c).isin(0) | (F.count(c) == F.count("*")))).alias(c) for c in columns]).first()
    if row["_bad"]:
        raise ValueError(f"exposure not positive or not finite in {row['_bad']} of {row['_n']} rows (least {row['_low']})")
    vary = [c for c in columns if not row[c]]
    return df.withColumn("log_expo", F.ln(x)), vary, [c for c in columns if row[c]]


def segment_design(segments: DataFrame) -> DataFrame:
    """Features of a segment for the count models: one, log_near, log_dist, sup_buena, main, log_vel, expo and corredor.

    segments: seg_id, y, ruta, superficie, n_near (points near by), dist_km (to the nearest toll), vel_proy, expo.
    """
    near, dist = log1p_of(F.col("n_near")), log1p_of(F.col("dist_km"))
    shown = ["seg_id", "y", F.lit(1.0).alias("one"), near.alias("log_near"), dist.alias("log_dist"), good_surface(F.col("superficie")).cast("double").alias("sup_buena"), on_main_route(F.col("ruta")).cast("double").alias("main"), log1p_of(F.col("vel_proy")).alias("log_vel")]
    return segments.select(*shown, "expo", corridor(F.col("ruta")).alias("corredor"))


#: Most values of a column that becomes one column each.
MOST_VALUES = 200


#: The prediction model's distances and what their logarithms are called; columns that go in as they are.
DISTANCES = {"dist_peligro_km": "log_peligro", "dist_peajes_km": "log_peajes", "dist_radares_km": "log_radares"}
PLAIN = ("carriles", "vel_proy", "sinuosidad", "radares_10km", "sup_buena", "principal")


def prediction_design(segments: DataFrame, fit: DataFrame | None = None, distances: dict[str, str] = DISTANCES, plain: tuple[str, ...] = PLAIN) -> tuple[DataFrame, list[str]]:
    """(segments with the features of the prediction model, their names): an intercept, regions and topographies but the first, and the rest.

    Speeds and lanes that are missing become the median, sinuosity ends at its 99th percentile, distances become log1p. Medians, the
    percentile and the values of the two categories are those of ``fit`` (the rows themselves unless given), so that rows to be
    predicted are treated like the ones that taught.
    """
    taught = segments if fit is None else fit
    rows = impute(segments, {"vel_proy": "median", "carriles": "median"}, fit=taught)
    most = quantiles(taught, "sinuosidad", [0.99]).first()["q"][0]
    rows = rows.withColumn("one", F.lit(1.0)).withColumn("sinuosidad", F.least(F.col("sinuosidad").cast("double"), F.lit(most).cast("double")))
    names = ["one"]
    for column, prefix in (("region", "reg"), ("topografia", "top")):
        values = [r[0] for r in taught.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(MOST_VALUES + 1).collect()]
        if len(values) > MOST_VALUES:
            raise ValueError(f"{column} has over {MOST_VALUES} values")
        for v in values[1:]:
            rows = rows.withColumn(f"{prefix}_{v}", F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)))
            names.append(f"{prefix}_{v}")
    return rows.withColumns({name: log1p_of(F.col(source)) for source, name in distances.items()}), [*names, *plain, *distances.values()]


def pearson(df: DataFrame, y: str, mu: str, alpha: float = 0.0) -> DataFrame:
    """df with ``pearson``: (y - mu) over the model's standard deviation."""
    m = F.col(mu)
    return df.withColumn("pearson", (F.col(y) - m) / F.sqrt(m + alpha * m * m))


def dispersion(df: DataFrame, y: str, mu: str, n_columns: int, alpha: float = 0.0) -> DataFrame:
    """One row: n, chi2 and chi2 over the degrees of freedom; about 1 for a model that fits."""
    rows = pearson(df, y, mu, alpha).agg(F.count("*").alias("n"), F.sum(F.col("pearson") * F.col("pearson")).alias("chi2"))
    return rows.withColumn("chi2_df", F.try_divide(F.col("chi2"), (F.col("n") - n_columns).cast("double")))


def residual_spots(df: DataFrame, y: str, mu: str, alpha: float = 0.0, least: int = 5, above: float = 1.5) -> DataFrame:
    """Rows with at least so many events and a Pearson residual above the limit."""
    return pearson(df, y, mu, alpha).where((F.col(y) >= least) & (F.col("pearson") > above))


# --- validation


def baselines(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    """test with ``media`` and ``mediana``: the training rows' mean and median of y as predictions."""
    mean = train.agg(F.avg(F.col(y).cast("double")).alias("media"))
    median = quantiles(train, y, [0.5]).select(F.col("q")[0].alias("mediana"))
    return test.join(F.broadcast(mean)).join(F.broadcast(median))  # one row each


def persistence(history: DataFrame, test: DataFrame, key: str, year: str, y: str) -> DataFrame:
    """test with ``persistencia``: the same key's y of the year before, null without history."""
    before = history.select(F.col(key), (F.col(year) + 1).alias(year), F.col(y).cast("double").alias("persistencia"))
    return test.join(before, [key, year], "left")


def temporal_holdout(df: DataFrame, year: str, last: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the years up to ``last``, rows after it)."""
    return df.where(F.col(year) <= last), df.where(F.col(year) > last)


def grouped_validation(df: DataFrame, y: str, columns: list[str], exposure: str, group: str, k: int = 5) -> DataFrame:
    """model and metrics of k-fold validation with whole groups held out: the offset model and the baselines.

    Missing values of a column become the median of the fold's training rows, so that no held-out row has a part in it.
    """
    folds = group_folds({r[group]: r["n"] for r in df.groupBy(group).agg(F.count("*").alias("n")).collect()}, k)  # a row a group
    write = steps(df.sparkSession)
    placed = df.withColumn("_fold", F.create_map(*[F.lit(x) for g, f in folds.items() for x in (g, f)])[F.col(group)])
    scored = None
    for fold in range(k):
        train, test = placed.where(F.col("_fold") != fold), placed.where(F.col("_fold") == fold)
        if test.isEmpty() or train.isEmpty():
            continue
        plan = dict.fromkeys(columns, "median")
        fitted, vary, _ = checked_design(write(impute(train, plan), f"train-{fold}"), columns, exposure)
        held = impute(test, plan, fit=train).withColumn("log_expo", F.ln(F.col(exposure).cast("double")))
        model = fit_counts(fitted.withColumn("_one", F.lit(1.0)), y, ["_one", *vary], "log_expo")
        out = baselines(train, predict(held.withColumn("_one", F.lit(1.0)), model, "glm"), y).select(F.col(y).cast("double").alias("_y"), "glm", "media", "mediana")
        scored = out if scored is None else scored.unionByName(out)
    return compare(scored, "_y", ["glm", "media", "mediana"])


def compare(df: DataFrame, y: str, predictions: list[str]) -> DataFrame:
    """model, n and metrics() of each prediction, over the rows that have one."""
    rows = None
    for name in predictions:
        some = df.where(F.col(name).isNotNull())
        row = metrics(some, y, name).join(F.broadcast(some.agg(F.count("*").alias("n")))).withColumn("model", F.lit(name))  # one row each
        rows = row if rows is None else rows.unionByName(row)
    return rows

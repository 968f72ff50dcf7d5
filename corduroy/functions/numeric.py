"""Numeric, calendar and risk expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(x: Column, y: Column) -> Column:
    """x / y, null for a zero divisor."""
    return F.try_divide(x.cast("double"), F.nullif(y.cast("double"), F.lit(0.0)))


def clip(c: Column, low=None, high=None) -> Column:
    if low is not None:
        c = F.when(c.isNotNull(), F.greatest(c, F.lit(low)))
    return c if high is None else F.when(c.isNotNull(), F.least(c, F.lit(high) if not isinstance(high, Column) else high))


def right_bins(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Labels of right-closed bins (edges[i], edges[i + 1]]; null outside."""
    out = None
    for low, high, label in zip(edges, edges[1:], labels):
        hit = (c > low) & (c <= high)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def whole_or_zero(c: Column) -> Column:
    """The whole part of a number that may be quoted; 0 for anything else."""
    text = F.regexp_replace(F.trim(c.cast("string")), "^[\"']+|[\"']+$", "")
    return F.coalesce(F.replace(text, F.lit(","), F.lit("")).try_cast("double").try_cast("bigint"), F.lit(0).cast("long"))


def count_or_zero(c: Column) -> Column:
    """A count: 0 where it is missing, no number or negative."""
    return F.greatest(F.coalesce(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def span_km(km0: Column, km1: Column) -> Column:
    """Length of a segment whichever way it runs; null where it has none."""
    return F.nullif(F.abs(km1.cast("double") - km0.cast("double")), F.lit(0.0))


def log1p_of(c: Column) -> Column:
    """ln(1 + x) of a count; null below 0."""
    return F.when(c >= 0, F.log1p(c.cast("double")))


def mid_month(year: Column, month: Column) -> Column:
    """The 15th of a month, for events of which only year and month are known; null for an impossible month."""
    return F.when(month.between(1, 12), F.make_date(year.cast("int"), F.when(month.between(1, 12), month).cast("int"), F.lit(15)))


# The surface that counts as good, and the prefix of the main coastal route.
GOOD_SURFACE, MAIN_ROUTE = "ASFALTADO", "PE-1"


def over_limit(speed: Column, limit: Column) -> Column:
    """Whether a speed exceeds its limit; false where either is missing."""
    return F.coalesce(speed > limit, F.lit(False))


def good_surface(surface: Column) -> Column:
    return F.coalesce(F.upper(F.trim(surface)).startswith(GOOD_SURFACE), F.lit(False)).cast("long")


def on_main_route(route: Column) -> Column:
    """Whether a route is the main one or one of its branches (a letter after its name), not one with another number."""
    return F.coalesce(F.upper(F.trim(route)).rlike(f"^{MAIN_ROUTE}(?![0-9])"), F.lit(False)).cast("long")


# Fixed values below: bins, factors and their labels.


def day_part(hour: Column) -> Column:
    return right_bins(hour, [-1, 6, 12, 18, 23], ["madrugada", "manana", "tarde", "noche"])


def speed_band(v: Column) -> Column:
    return right_bins(v, [-1, 60, 80, 100, 1e9], ["<60", "60-80", "80-100", ">100"])


def risk_level(v: Column, low: float, high: float) -> Column:
    return F.when(v < low, "Bajo").when(v <= high, "Medio").when(v > high, "Alto")


def temporal_factor(ts: Column) -> Column:
    """Saturday 1.25, Sunday 1.10; from 19 to 5 o'clock 1.30, from 5 to 8 1.05; their product to three decimals."""
    day, hour = F.weekday(ts), F.hour(ts)
    by_day = F.when(day == 5, 1.25).when(day == 6, 1.10).otherwise(1.0)
    by_hour = F.when((hour >= 19) | (hour < 5), 1.30).when(hour < 8, 1.05).otherwise(1.0)
    return F.round(by_day * by_hour, 3)


def calendar(ts: Column) -> dict[str, Column]:
    return {"anio": F.year(ts).cast("long"), "mes": F.month(ts).cast("long"), "dia_semana": F.weekday(ts).cast("long"), "hora3": (F.floor(F.hour(ts) / 3) * 3).cast("long")}


def weight_of(c: Column, weights: dict[str, float], default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[c], F.lit(default))


def one_hot(c: Column, values: list[str], prefix: str) -> list[Column]:
    """0/1 columns for every value but the first in sorted order."""
    return [F.when(c == v, 1).otherwise(0).cast("long").alias(f"{prefix}_{i}") for i, v in enumerate(sorted(values)) if i]


def severity_weight(dead: Column, injured: Column) -> Column:
    return 3 * F.coalesce(dead, F.lit(0)) + F.coalesce(injured, F.lit(0)) + 1


def poisson_deviance(y: Column, mu: Column) -> Column:
    """2 (y ln(y / mu) - (y - mu)), also for y = 0; null for mu <= 0."""
    return F.when(mu > 0, 2 * (F.when(y > 0, y * F.ln(F.greatest(y, F.lit(1e-300)) / mu)).otherwise(0.0) - (y - mu)))


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for positive x, by Stirling's series eight places further up."""
    z = x + 8.0
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (z * z)) / (z * z)) / (z * z)) / z
    below = F.ln(x)
    for i in range(1, 8):
        below = below + F.ln(x + float(i))
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - below


def incomplete_beta(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) for 0 < x < 1 and rest = 1 - x, by its continued fraction.

    The fraction is taken on the side where it converges, in a number of steps that grows with the root of the larger parameter.
    """
    swap = x > (a + 1) / (a + b + 2)
    p, q, at = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, rest).otherwise(x)
    given = F.struct(p.alias("p"), q.alias("q"), at.alias("x"), (F.ln(x) * a + F.ln(rest) * b + log_gamma(a + b) - log_gamma(a) - log_gamma(b)).alias("front"))

    def apart(v: Column) -> Column:
        return F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def step(s: Column, n: Column) -> Column:
        """One coefficient: of even number for the denominators' first, of odd for their second half."""
        m, p, q, x = F.floor(n / 2).cast("double"), s["p"], s["q"], s["x"]
        even = m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))
        k = F.when(n % 2 == 0, even).otherwise(odd)
        d, c = 1 / apart(1 + k * s["d"]), apart(1 + k / s["c"])
        return F.struct(p.alias("p"), q.alias("q"), x.alias("x"), s["front"].alias("front"), c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    first = F.transform(F.array(given), lambda g: F.struct(g["p"].alias("p"), g["q"].alias("q"), g["x"].alias("x"), g["front"].alias("front"), F.lit(1.0).alias("c"), F.lit(0.0).alias("d"), F.lit(1.0).alias("h")))[0]
    steps = F.sequence(F.lit(1), (80 + 8 * F.sqrt(F.greatest(a, b))).cast("int"))
    # the fraction 1 / (1 + k1 / (1 + k2 / (1 + ...))): its reciprocal is built up, so the last h is divided by
    tail = F.aggregate(steps, first, step, lambda s: F.exp(s["front"]) / (s["p"] * s["h"]))
    return F.when(swap, 1 - tail).otherwise(tail)


def nb_distribution(y: Column, mu: Column, alpha: float) -> tuple[Column, Column]:
    """Probabilities of at most y, and of fewer than y, under the NB2 distribution with mean mu and dispersion alpha (over 0)."""
    r, p, rest = F.lit(1 / alpha), 1 / (1 + alpha * mu), alpha * mu / (1 + alpha * mu)
    upto = F.when(y < 0, 0.0).when(mu <= 0, 1.0).otherwise(incomplete_beta(r, y + 1, p, rest))
    before = F.when(y < 1, 0.0).when(mu <= 0, 1.0).otherwise(incomplete_beta(r, F.greatest(y, F.lit(1.0)), p, rest))
    return upto, before

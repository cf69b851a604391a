"""Normal distribution, dependent p-values and false discovery rates as expressions.

The texts are plain SQL that Spark and other engines evaluate alike; ``col`` versions wrap them for DataFrames.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the published rational approximation of the normal quantile (Acklam).
QA = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
QB = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
QC = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
QD = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]
#: Coefficients of the published approximation of the complementary error function (Numerical Recipes).
EC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
#: p-values are kept this far from 0 and 1 before a quantile is taken.
LEAST_P = 1e-15
EULER = 0.57722


def lit(x: float) -> str:
    """A double in either engine's SQL."""
    return f"CAST('{x!r}' AS DOUBLE)"


def _poly(coefficients: list[float], x: str, last: float | None = None) -> str:
    out = lit(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {lit(c)})"
    return out if last is None else f"({out} * {x} + {lit(last)})"


def clamp(p: str) -> str:
    return f"least(greatest({p}, {lit(LEAST_P)}), {lit(1 - LEAST_P)})"


def quantile(p: str) -> str:
    """Standard normal quantile of ``p``."""
    p = clamp(p)
    q, r = f"({p} - {lit(0.5)})", f"(({p} - {lit(0.5)}) * ({p} - {lit(0.5)}))"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln({lit(1.0)} - {p}))"
    tail = lambda s: f"({_poly(QC, s)} / {_poly(QD, s, 1.0)})"
    return (
        f"CASE WHEN {p} < {lit(0.02425)} THEN {tail(low)} WHEN {p} > {lit(0.97575)} THEN -{tail(high)} "
        f"ELSE ({_poly(QA, r)} * {q}) / {_poly(QB, r, 1.0)} END"
    )


def probit(p: str) -> str:
    """Quantile of the upper tail: large for small p."""
    return f"(-({quantile(p)}))"


def tail(z: str) -> str:
    """Probability of a standard normal above ``z``."""
    x = f"(({z}) / {lit(math.sqrt(2))})"
    t = f"({lit(1.0)} / ({lit(1.0)} + {lit(0.5)} * abs({x})))"
    e = f"({lit(0.5)} * {t} * exp(-{x} * {x} + {_poly(EC[::-1], t)}))"
    return f"CASE WHEN {x} >= 0 THEN {e} ELSE {lit(1.0)} - {e} END"


def combined(zw: str, w2: str, w: str, rho: str) -> str:
    """p of sum(w z) = zw under pairwise correlation rho, given sum(w^2) and sum(w); not a number counts as 0."""
    return tail(f"({zw} / sqrt(({lit(1.0)} - {rho}) * {w2} + {rho} * {w} * {w}))")


def gev_survival(x: str, xi: str, mu: str, sigma: str) -> str:
    """Upper tail of the generalised extreme value distribution, 7 digits; 1 below and 0 above its support."""
    y = f"({lit(1.0)} + {xi} * ({x} - {mu}) / {sigma})"
    gumbel = f"({lit(1.0)} - exp(-exp(-({x} - {mu}) / {sigma})))"
    return (
        f"round(CASE WHEN abs({xi}) < {lit(1e-9)} THEN {gumbel} WHEN {y} <= 0 THEN CASE WHEN {xi} > 0 THEN {lit(1.0)} ELSE {lit(0.0)} END "
        f"ELSE {lit(1.0)} - exp(-pow({y}, -{lit(1.0)} / {xi})) END, 7)"
    )


def probit_col(p: str) -> Column:
    return F.expr(probit(p))


def tail_col(z: str) -> Column:
    return F.expr(tail(z))


def bh_fdr(df, p: str, order: list[str], by: list[str] = (), out: str = "fdr"):
    """Benjamini-Hochberg adjusted p-values; rows without p get none and don't count.

    ``order`` breaks ties. With ``by`` each group is a family, else all rows are. Families are ranked by ranges, so that no
    task sorts a whole one.
    """
    from ..operators.ranking import adjusted

    return adjusted(df, p, order, out, by)

"""Closed-form statistics, as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame

# The proportion that stands in for an empty PSI cell, and the
# PSI levels of the drift status.
PSI_EPSILON = 1e-4
PSI_MODERATE = 0.1
PSI_SIGNIFICANT = 0.25

# A sum of squared deviations below this is rounding noise: the column is
# constant for the purpose of skewness and kurtosis.
CONSTANT_SS = 1e-14



def percentage(part: str, whole: str) -> str:
    """``part / whole * 100``; 0 when there is nothing to divide by."""
    return f"coalesce(try_divide({part}, {whole}) * 100, 0D)"


def with_shape(sums: DataFrame) -> DataFrame:
    """Add ``mean``, sample ``std`` and bias-corrected ``skew`` and excess ``kurtosis``.

    ``sums`` has the count ``n`` (at least 1) and ``s1..s4``, sums of powers of
    ``x - shift``. With the shift near the median the mean lies within about one
    standard deviation of it, so the subtractions below do not cancel: power
    sums are then as accurate as an online update and far cheaper, being plain
    additions inside generated code.
    """
    central = sums.selectExpr(
        "*", "cast(n AS double) AS c", "s1 / n AS a", "s2 / n AS p2", "s3 / n AS p3", "s4 / n AS p4"
    ).selectExpr(
        "*",
        "greatest(p2 - a * a, 0D) AS m2",
        "p3 - 3 * a * p2 + 2 * a * a * a AS m3",
        "p4 - 4 * a * p3 + 6 * a * a * p2 - 3 * a * a * a * a AS m4",
    )
    constant = f"m2 * c < {CONSTANT_SS!r}D"
    return central.selectExpr(
        *[x for x in sums.columns if x not in ("s1", "s2", "s3", "s4", "shift")],
        "shift + a AS mean",
        "CASE WHEN n >= 2 THEN sqrt(try_divide(m2 * c, c - 1)) END AS std",
        f"CASE WHEN n < 3 THEN NULL WHEN {constant} THEN 0D ELSE "
        "try_divide(sqrt(c * (c - 1)), c - 2) * try_divide(m3, pow(m2, 1.5D)) END AS skew",
        f"CASE WHEN n < 4 THEN NULL WHEN {constant} THEN 0D ELSE "
        "try_divide(c - 1, (c - 2) * (c - 3)) * ((c + 1) * (try_divide(m4, m2 * m2) - 3) + 6) "
        "END AS kurtosis",
    )


def lerp(low: str, high: str, t: str) -> str:
    """SQL text of a linear interpolation as a weighted mean, exact at both ends and when low = high."""
    return f"CASE WHEN {low} = {high} THEN {low} ELSE (1 - {t}) * {low} + {t} * {high} END"


def entropy_bits(n: str, sum_c_log2_c: str) -> str:
    """Shannon entropy from the row count and the sum of ``c * log2(c)``."""
    return f"greatest(log2({n}) - try_divide({sum_c_log2_c}, {n}), 0D)"


def psi_term(ref_share: str, cur_share: str) -> str:
    """One cell's part of the Population Stability Index; empty cells count as epsilon."""

    def positive(share: str) -> str:
        return f"CASE WHEN {share} = 0 THEN {PSI_EPSILON!r}D ELSE {share} END"

    ref, cur = positive(ref_share), positive(cur_share)
    return f"({cur} - {ref}) * ln({cur} / {ref})"


def drift_status(psi: str) -> str:
    return (
        f"CASE WHEN {psi} >= {PSI_SIGNIFICANT}D THEN 'significant' "
        f"WHEN {psi} >= {PSI_MODERATE}D THEN 'moderate' ELSE 'stable' END"
    )


def relative_change(ref_mean: str, cur_mean: str) -> str:
    """Change of the mean in percent of the signed reference mean; 0 if that is 0."""
    return (
        f"CASE WHEN {ref_mean} = 0 THEN 0D "
        f"ELSE try_divide({cur_mean} - {ref_mean}, {ref_mean}) * 100 END"
    )


def ks_p_value(d: str, n_ref: str, n_cur: str) -> str:
    """Asymptotic two-sample p-value ``min(1, 2 exp(-2 lambda^2))``."""
    n1, n2 = f"cast({n_ref} AS double)", f"cast({n_cur} AS double)"
    return f"least(1D, 2 * exp(-2 * {d} * {d} * ({n1} * {n2} / ({n1} + {n2}))))"

"""Fractions, levels, Beta algebra and scores as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Levels:
    """Thresholds of the middle and high methylation levels."""

    middle: float = 0.2
    high: float = 0.7


# The thresholds that the two discovery programs use.
COUNT_LEVELS, MIXTURE_LEVELS = Levels(0.1, 0.75), Levels(0.1, 0.5)


def frac32(part: Column, whole: Column) -> Column:
    """Single-precision quotient; null without coverage."""
    return F.when(whole > 0, (part.cast("float") / whole.cast("float")).cast("float"))


def frac64(part: Column, whole: Column) -> Column:
    """Double-precision quotient; null without coverage."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double"))


def f32(x: float) -> Column:
    return F.lit(x).cast("float")


def level(n_mod: Column, n_valid_cov: Column, levels: Levels = Levels()) -> Column:
    """High, Middle or Low; without modification or coverage Low."""
    fraction = frac32(n_mod, n_valid_cov)
    return (
        F.when((n_mod == 0) | (n_valid_cov == 0), "Low")
        .when(fraction >= f32(levels.high), "High")
        .when(fraction >= f32(levels.middle), "Middle")
        .otherwise("Low")
    )


def diff_fraction(n_diff: Column, n_valid_cov: Column) -> Column:
    """Share of differing reads; null without coverage."""
    return F.when(n_valid_cov > 0, (n_diff.cast("float") / (n_diff + n_valid_cov).cast("float")).cast("float"))


def percent_text(n_mod: Column, n_valid_cov: Column) -> Column:
    """Percentage with one decimal, ties to even, ``0.0`` without coverage."""
    percent = ((n_mod * 100).cast("float") / n_valid_cov.cast("float")).cast("float")
    return F.when(n_valid_cov > 0, F.format_string("%.1f", F.bround(percent.cast("double"), 1))).otherwise("0.0")


# ---- Beta distributions ----


def beta_mean(a: Column, b: Column) -> Column:
    return a / (a + b)


def beta_variance(a: Column, b: Column) -> Column:
    return a * b / ((a + b) * (a + b) * (a + b + 1))


def beta_sd(a: Column, b: Column) -> Column:
    return F.sqrt(beta_variance(a, b))


# The coefficients of the Lanczos approximation of the gamma function (g = 7, n = 9).
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number (reflected below one half); null for others."""

    def above(z: Column) -> Column:
        z = z - 1.0
        series = F.lit(_LANCZOS[0])
        for i, c in enumerate(_LANCZOS[1:], 1):
            series = series + F.lit(c) / (z + float(i))
        t = z + 7.5
        return F.lit(0.9189385332046727) + (z + 0.5) * F.log(t) - t + F.log(series)

    return F.when(x >= 0.5, above(x)).when(x > 0, F.log(F.pi() / F.sin(F.pi() * x)) - above(1.0 - x))


def log_beta(a: Column, b: Column) -> Column:
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def beta_log_pdf(x: Column, a: Column, b: Column, log_b: Column | None = None) -> Column:
    """Log density for 0 < x < 1; null outside, where it has no finite value."""
    lb = log_beta(a, b) if log_b is None else log_b
    return F.when((x > 0) & (x < 1), (a - 1.0) * F.log(x) + (b - 1.0) * F.log(1.0 - x) - lb)


def log_sum_exp(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return top + F.log(F.exp(a - top) + F.exp(b - top))


# ---- scores of motifs from their high and low counts ----


def ad_hoc_score(high: Column, low: Column, parent_high: Column, parent_low: Column, pseudo: float = 1.0) -> Column:
    a, b, pa, pb = (x + pseudo for x in (high, low, parent_high, parent_low))
    spread = (beta_sd(a, b) + beta_sd(pa, pb)) / 2.0
    return beta_mean(a, b) * -F.log10(spread) * (beta_mean(a, b) - beta_mean(pa, pb))


def ad_hoc_priority(high: Column, low: Column, seed_high: Column, seed_low: Column, pseudo: float = 1.0) -> Column:
    return (1.0 - (high + pseudo) / (low + pseudo)) / ((seed_high + pseudo) / (seed_low + pseudo))


def log_odds(high: Column, low: Column, other_high: Column, other_low: Column, pseudo: float = 1.0) -> Column:
    """Log of the odds ratio of (high, other_high) against (low, other_low)."""
    return F.log(((high + pseudo) / (other_high + pseudo)) / ((low + pseudo) / (other_low + pseudo)))


def log_odds_z(high: Column, low: Column, other_high: Column, other_low: Column, pseudo: float = 1.0) -> Column:
    variance = sum((1.0 / (x + pseudo) for x in (low, other_high, other_low)), 1.0 / (high + pseudo))
    return log_odds(high, low, other_high, other_low, pseudo) / F.sqrt(variance)


def improvement_score(mean: Column, parent_mean: Column) -> Column:
    return mean * (mean - parent_mean)


def mixture_score(pi: Column, alpha: Column, beta: Column) -> Column:
    return pi * beta_mean(alpha, beta)

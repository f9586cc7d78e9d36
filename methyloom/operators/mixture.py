"""Beta and Beta-mixture fits as aggregations.

One step of the fit with a fixed false component is a projection (responsibilities) and an aggregate
(mixing weight, weighted moments); by default one step is taken, more on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methyloom.functions.measures import beta_log_pdf, beta_mean, beta_variance, frac64, log_beta, log_sum_exp
from methyloom.operators.spread import with_lookup
from methyloom.session import checkpointed

CLAMP = 1e-12
_PLACE = lambda df: [c for c in ("position", "strand") if c in df.columns]  # noqa: E731  tells records of a group apart


def beta_moments(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mean, variance, alpha, beta) by the method of moments; no coverage is skipped.

    Without a record there is no row; with a variance below 1e-12 alpha and beta are null.
    """
    x = frac64(F.col("n_mod"), F.col("n_valid_cov"))
    stats = df.where("n_valid_cov > 0").groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"))
    c = F.when(F.col("variance") >= 1e-12, F.col("mean") * (1 - F.col("mean")) / F.col("variance") - 1)
    return stats.select(*by, "n", "mean", "variance", (F.col("mean") * c).alias("alpha"), ((1 - F.col("mean")) * c).alias("beta"))


def _clamped(low: float = CLAMP) -> Column:
    x = frac64(F.col("n_mod"), F.col("n_valid_cov"))
    return F.least(F.greatest(x, F.lit(low)), F.lit(1.0 - low))


def with_log_beta(models: DataFrame) -> DataFrame:
    """Models with the logarithms of the Beta functions of both components."""
    return models.withColumn("lbt", log_beta(F.col("ta"), F.col("tb"))).withColumn("lbf", log_beta(F.col("fa"), F.col("fb")))


def with_models(df: DataFrame, models: DataFrame, by: list[str], hashed: bool = False) -> DataFrame:
    """Records with the model of their group. Models that know their number of records (``n``) spread a group over the cluster."""
    return with_lookup(df, models, by, "n", hashed=hashed) if "n" in models.columns else df.join(models, by)


def em_step(df: DataFrame, models: DataFrame, by: list[str], penalty: float, prior: tuple[float, float] = (0.0, 0.0), clamp: float = CLAMP, hashed: bool = False) -> DataFrame:
    """(by, n, pi, alpha, beta, loglik): one step from ``models`` (by, pi, ta, tb, fa, fb).

    The false component weighs ``penalty``. Groups whose weights or variance vanish, or whose
    moments fit no Beta, have null alpha and beta. ``models`` has one row per group; ``hashed`` as in ``with_lookup``.
    """
    x = F.col("x")
    rows = (
        with_models(df.where("n_valid_cov > 0").select(*by, _clamped(clamp).alias("x"), *_PLACE(df)), with_log_beta(models), by, hashed)
        .withColumn("lt", F.log("pi") + beta_log_pdf(x, F.col("ta"), F.col("tb"), F.col("lbt")))
        .withColumn("lf", F.log(1 - F.col("pi")) + beta_log_pdf(x, F.col("fa"), F.col("fb"), F.col("lbf")) + F.log(F.lit(penalty)))
        .where("lt is not null and lf is not null")
        .withColumn("ll", log_sum_exp(F.col("lt"), F.col("lf")))
        .withColumn("r", F.exp(F.col("lt") - F.col("ll")))
    )
    r = F.col("r")
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(r).alias("new_pi"), F.sum(r).alias("w"), F.sum(r * x).alias("wx"),
        F.sum(r * x * x).alias("wxx"), F.sum("ll").alias("loglik"),
    )
    mu = F.col("wx") / F.col("w")
    var = F.greatest(F.col("wxx") / F.col("w") - mu * mu, F.lit(0.0))
    c = F.when((F.col("w") > 0) & (F.col("var") >= 1e-12), F.col("mu") * (1 - F.col("mu")) / F.col("var") - 1)
    fitted = sums.withColumn("mu", F.when(F.col("w") > 0, mu)).withColumn("var", F.when(F.col("w") > 0, var)).withColumn("c", c)
    ok = F.col("c") > 0
    return fitted.select(
        *by, "n", F.col("new_pi").alias("pi"),
        F.when(ok, F.col("mu") * F.col("c") + prior[0]).alias("alpha"),
        F.when(ok, (1 - F.col("mu")) * F.col("c") + prior[1]).alias("beta"), "loglik",
    )


def fit(df: DataFrame, models: DataFrame, by: list[str], penalty: float, iterations: int = 1, tolerance: float = 1e-6, **kwargs) -> DataFrame:
    """``em_step`` repeated until the log likelihood of a group changes by less than ``tolerance``, at most ``iterations`` times.

    The false component stays. Groups that have converged take no further part. Where a step gives no
    true component, the one before it is kept. The records and, after every step, the models are
    written, so that no plan grows with the steps. With one step the result is that of ``em_step``;
    with more, ``steps`` and ``converged`` are added.
    """
    if iterations == 1:
        return em_step(df, models, by, penalty, **kwargs)
    records = checkpointed(df.where("n_valid_cov > 0").select(*by, *_PLACE(df), "n_mod", "n_valid_cov"))
    counts = records.groupBy(*by).agg(F.count("*").alias("n"))
    start = models.drop("n").join(counts, by).select(*by, "pi", "ta", "tb", "fa", "fb", "n")
    state = checkpointed(start.select("*", F.lit(None).cast("double").alias("loglik"), F.lit(0).alias("steps"), F.lit(False).alias("converged")))
    for _ in range(iterations):
        still = state.where("not converged")
        if not still.limit(1).count():
            break
        step = em_step(records, still.select(*by, "pi", "ta", "tb", "fa", "fb", "n"), by, penalty, **kwargs)
        new = step.select(*by, F.col("pi").alias("new_pi"), "alpha", "beta", F.col("loglik").alias("new_loglik"))
        near = F.coalesce(F.abs(F.col("new_loglik") - F.col("loglik")) < tolerance, F.lit(False))
        moved = still.join(new, by).select(
            *by, F.col("new_pi").alias("pi"), F.coalesce("alpha", "ta").alias("ta"), F.coalesce("beta", "tb").alias("tb"), "fa", "fb", "n",
            F.col("new_loglik").alias("loglik"), (F.col("steps") + 1).alias("steps"), near.alias("converged"),
        )
        state = checkpointed(state.where("converged").unionByName(moved))
    return state.select(*by, "n", "pi", F.col("ta").alias("alpha"), F.col("tb").alias("beta"), "loglik", "steps", "converged")


def seed_models(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, pi, ta, tb, fa, fb, n): Beta(10, 1) at weight 0.01 against the Beta of all records, its beta at least 1.1.

    Groups whose moments give an alpha of 1e-9 or less have no density, hence no seed.
    """
    m = beta_moments(df, by).where("alpha > 1e-9")
    return m.select(*by, F.lit(0.01).alias("pi"), F.lit(10.0).alias("ta"), F.lit(1.0).alias("tb"), F.col("alpha").alias("fa"), F.greatest("beta", F.lit(1.1)).alias("fb"), "n")


def mixture_stats(models: DataFrame) -> DataFrame:
    """Models with the mean and variance of the mixture."""
    tm, fm = beta_mean(F.col("ta"), F.col("tb")), beta_mean(F.col("fa"), F.col("fb"))
    mean = F.col("pi") * tm + (1 - F.col("pi")) * fm
    second = F.col("pi") * (beta_variance(F.col("ta"), F.col("tb")) + tm * tm) + (1 - F.col("pi")) * (beta_variance(F.col("fa"), F.col("fb")) + fm * fm)
    return models.withColumn("mean", mean).withColumn("variance", second - mean * mean)


def log_likelihoods(df: DataFrame, models: DataFrame, by: list[str], clamp: float = 1e-6) -> DataFrame:
    """(by, loglik_true, loglik_false): sums of the log densities of both components."""
    rows = with_models(df.where("n_valid_cov > 0").select(*by, _clamped(clamp).alias("x"), *_PLACE(df)), with_log_beta(models), by)
    x = F.col("x")
    return rows.groupBy(*by).agg(
        F.sum(beta_log_pdf(x, F.col("ta"), F.col("tb"), F.col("lbt"))).alias("loglik_true"),
        F.sum(beta_log_pdf(x, F.col("fa"), F.col("fb"), F.col("lbf"))).alias("loglik_false"),
    )


def standalone_fit(df: DataFrame, models: DataFrame, by: list[str], max_iterations: int = 100) -> DataFrame:
    """The fit that subtracts ln 2 from the false term and adds the prior Beta(5, 1), until it converges or ``max_iterations``."""
    return fit(df, models, by, penalty=0.5, iterations=max_iterations, prior=(5.0, 1.0), clamp=1e-6)


def score_single_motifs(motif_records: DataFrame, by: list[str], min_records: int = 10, min_fraction: float = 0.2) -> DataFrame:
    """Plus-strand records of motifs scored from Beta(5, 2) at weight 0.05 and penalty 2.

    Motifs with fewer than ``min_records`` records above ``min_fraction`` are left out.
    """
    plus = motif_records.where("strand = '+'")
    strong = F.count(F.when(frac64(F.col("n_mod"), F.col("n_valid_cov")) > min_fraction, 1))
    enough = plus.groupBy(*by).agg(strong.alias("strong")).where(F.col("strong") >= min_records).select(*by)
    kept = plus.join(enough, by, "left_semi")
    false = checkpointed(seed_models(kept, by).select(*by, "fa", "fb", "n"))
    models = false.select(*by, F.lit(0.05).alias("pi"), F.lit(5.0).alias("ta"), F.lit(2.0).alias("tb"), "fa", "fb", "n")
    return em_step(kept, models, by, penalty=2.0)

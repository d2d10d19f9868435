"""Result tables: model selection, cross-validation and power summaries, pairwise likelihood sums."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import checkpointed


def scenarios(spark: SparkSession, sizes: list[int], strategies: list[str], n_designs: int, nsim: int, models: list[str]) -> DataFrame:
    """scenario_id (from 1, by size, strategy and design), sample_size, strategy, design, sim, model; only random strategies have several designs."""
    designs = [n_designs if s == "random" else 1 for s in strategies]
    first = [sum(designs[:k]) for k in range(len(designs))]
    array = lambda xs: F.array(*map(F.lit, xs))
    drawn = F.array(*[F.struct(F.lit(s).alias("name"), F.lit(n).alias("n"), F.lit(k).alias("first")) for s, n, k in zip(strategies, designs, first, strict=True)])
    rows = spark.range(1).select(F.posexplode(array(sizes)).alias("at", "sample_size")).select("*", F.explode(drawn).alias("s"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("s.n"))).alias("design"))
    number = F.col("at") * sum(designs) + F.col("s.first") + F.col("design")
    rows = rows.select(number.cast("long").alias("scenario_id"), F.col("sample_size").cast("long").alias("sample_size"), F.col("s.name").alias("strategy"), F.col("design").cast("long").alias("design"))
    sims = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(nsim).cast("long"))).alias("sim"))
    return sims.select("*", F.explode(array(models)).alias("model"))


def with_power(summary: DataFrame, power: DataFrame, keys: list[str]) -> DataFrame:
    """Add the power that ``power`` (keys, power) gives for each row; null without a match."""
    return summary.join(power.select(*keys, "power"), keys, "left")


def label_heights(curves: DataFrame, panel: str, value: str) -> DataFrame:
    """Each panel's highest value, and a label's height just below."""
    return curves.groupBy(panel).agg(F.max(value).alias("ymax"), (F.max(value) * 0.98).alias("label_y"))


def information_criterion(loglik: Column, k: Column, n: Column, kind: str = "aic") -> Column:
    if kind == "aic":
        return -2 * loglik + 2 * k
    if kind == "aicc":
        return -2 * loglik + 2 * k * (n / (n - k - 1))
    if kind == "bic":
        return -2 * loglik + k * F.log(n * (n - 1) / 2)
    raise ValueError(kind)


def aic_table(models: DataFrame, kind: str = "aic", by: list[str] | None = None) -> DataFrame:
    """models: model_id, loglik, k, n (focal sites). Adds ic, delta, weight, cumulative weight, best first."""
    by = by or []
    m = models.withColumn("ic", information_criterion(F.col("loglik"), F.col("k"), F.col("n"), kind))
    w = Window.partitionBy(*by)
    m = m.withColumn("delta", F.col("ic") - F.min("ic").over(w))
    m = m.withColumn("weight", F.exp(-F.col("delta") / 2) / F.sum(F.exp(-F.col("delta") / 2)).over(w))
    return m.withColumn("cum_weight", F.sum("weight").over(w.orderBy("delta", "model_id").rowsBetween(Window.unboundedPreceding, 0)))


def cv_selection(cv: DataFrame) -> DataFrame:
    """model_id, loglik -> difference to the best and rank."""
    w = Window.partitionBy()
    return cv.select("model_id", "loglik", (F.max("loglik").over(w) - F.col("loglik")).alias("delta"), F.rank().over(Window.orderBy(F.desc("loglik"))).alias("rank"))


def mark_selection(rows: DataFrame, by: str = "replicate") -> DataFrame:
    """delta and selected within one replicate; null or NaN criteria take no part."""
    good = F.col("ic").isNotNull() & ~F.isnan("ic")
    low = F.min(F.when(good, F.col("ic"))).over(Window.partitionBy(by))
    return rows.withColumn("delta", F.when(good, F.col("ic") - low)).withColumn("selected", F.coalesce(F.when(good, F.col("ic") == low), F.lit(False)))


def power_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """rate of successes and mean error; rows: ``by``, ok, error."""
    return rows.groupBy(*by).agg(F.avg(F.col("ok").cast("double")).alias("rate"), F.avg(F.when(~F.isnan("error"), F.col("error"))).alias("mean_error"), F.count("*").alias("n"))


def all_parameter_power(rows: DataFrame, by: list[str], replicate: str) -> DataFrame:
    """Share of replicates in which every parameter was recovered."""
    return rows.groupBy(*by, replicate).agg(F.bool_and("ok").alias("__all")).groupBy(*by).agg(F.avg(F.col("__all").cast("double")).alias("power"))


def parameter_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """bias, rmse and coverage; rows: ``by``, est, truth, lower, upper."""
    e = F.col("est") - F.col("truth")
    inside = F.col("truth").between(F.col("lower"), F.col("upper"))
    return rows.groupBy(*by).agg(F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(inside.cast("double")).alias("coverage"))


def cv_summary(rows: DataFrame, value: str = "loglik") -> DataFrame:
    return rows.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))


def average_ranks(rows: DataFrame, c: str, rank: str) -> DataFrame:
    """Add the rank by ``c``, from 1; equal values share the mean of theirs. Null or NaN values must be gone.

    Distinct values are counted and dealt by range; a running sum within each
    range is moved by the counts of the ranges before it (one row a range).
    """
    values = rows.groupBy(c).agg(F.count("*").alias("__n")).repartitionByRange(c)
    values = checkpointed(values.withColumn("__p", F.spark_partition_id()))
    before = F.sum("__all").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = values.groupBy("__p").agg(F.sum("__n").alias("__all")).select("__p", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.sum("__n").over(Window.partitionBy("__p").orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
    ranked = values.withColumn("__to", within).join(F.broadcast(starts), "__p")
    ranked = ranked.select(c, (F.col("__before") + F.col("__to") - (F.col("__n") - 1) / 2).alias(rank))
    return rows.join(ranked, c)


def correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman (average ranks) over rows with both values."""
    good = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    ranked = average_ranks(average_ranks(good, "x", "rx"), "y", "ry")
    return ranked.agg(F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"))


def response_change(values: DataFrame, column: str, beta: float, se: float, probs: tuple[float, float] = (0.1, 0.9), z: float = 1.959963984540054) -> DataFrame:
    """Coefficient times the distance of two quantiles, with its interval."""
    span = F.col("hi") - F.col("lo")
    q = values.agg(F.percentile(column, F.lit(probs[0])).alias("lo"), F.percentile(column, F.lit(probs[1])).alias("hi"))
    return q.select("lo", "hi", (span * beta).alias("change"), (span * beta - F.abs(span) * se * z).alias("lower"), (span * beta + F.abs(span) * se * z).alias("upper"))


def ols_start(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Intercept, slope (0 with the mean where it isn't positive) and tau = log(n / RSS)."""
    s = pairs.agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, y).alias("sxy"), F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy"))
    slope = F.when(F.col("sxy") > 0, F.col("sxy") / F.col("sxx")).otherwise(0.0)
    s = s.withColumn("beta", slope)
    return s.select("beta", (F.col("my") - F.col("beta") * F.col("mx")).alias("alpha"), (-F.log(F.col("syy") - F.col("beta") * F.col("sxy"))).alias("tau"))


def leastsquares_loglik(pairs: DataFrame, x: str, y: str, alpha: float, beta: float, tau: float) -> DataFrame:
    e = F.col(y) - alpha - beta * F.col(x)
    return pairs.agg((-0.5 * math.exp(tau) * F.sum(e * e) + 0.5 * tau * F.count("*")).alias("loglik"))


def mlpe_loglik(pairs: DataFrame, x: str, y: str, alpha: float, beta: float, tau: float, rho: float) -> DataFrame:
    """Log-likelihood of pairs with errors correlated by shared site, from sums by site; i > j over all pairs."""
    e = F.col(y) - alpha - beta * F.col(x)
    rows = pairs.select("i", "j", e.alias("e"))
    ends = rows.select(F.col("i").alias("s"), "e").unionByName(rows.select(F.col("j").alias("s"), "e"))
    site = ends.groupBy("s").agg(F.sum("e").alias("e")).agg(F.count("*").alias("n"), F.sum(F.col("e") * F.col("e")).alias("ss"), F.sum("e").alias("t"))
    total = rows.agg(F.sum(F.col("e") * F.col("e")).alias("ee"), F.count("*").alias("m"))
    a, n, m = 1 / (1 - 2 * rho), F.col("n"), F.col("m")
    d1, d2 = 2 * (n - 1) * a + 1 / rho, (n - 2) * a + 1 / rho
    quad = a * F.col("ee") - a * a * ((F.col("t") * F.col("t") / n) / d1 + (F.col("ss") - F.col("t") * F.col("t") / n) / d2)
    logdet = F.log(d1) + (n - 1) * F.log(d2) + n * math.log(rho) + m * math.log(1 - 2 * rho)
    one = site.join(F.broadcast(total))
    return one.select((-0.5 * math.exp(tau) * quad + 0.5 * tau * m - 0.5 * logdet).alias("loglik"))


def mlpe_subset_loglik(pairs: DataFrame, x: str, y: str, alpha: float, beta: float, tau: float, rho: float) -> DataFrame:
    """The likelihood of ``mlpe_loglik`` over chosen pairs only, where it has no closed form.

    A task holds one dense matrix of the sites in the pairs. No pairs give no row.
    """
    rows = pairs.select(F.lit(0).alias("g"), "i", "j", (F.col(y) - alpha - beta * F.col(x)).cast("double").alias("e"))

    def loglik(pdf: pd.DataFrame) -> pd.DataFrame:
        e, m, a = pdf["e"].to_numpy(), len(pdf), 1 - 2 * rho
        ids, code = np.unique(np.concatenate([pdf["i"], pdf["j"]]), return_inverse=True)
        i, j = code[:m], code[m:]
        shared = np.zeros((len(ids), len(ids)))
        for p, q in ((i, i), (j, j), (i, j), (j, i)):
            np.add.at(shared, (p, q), 1.0)
        s = np.bincount(i, e, len(ids)) + np.bincount(j, e, len(ids))
        inner = np.eye(len(ids)) * (a / rho) + shared
        quad = (e @ e - s @ np.linalg.solve(inner, s)) / a
        logdet = m * math.log(a) + len(ids) * math.log(rho / a) + np.linalg.slogdet(inner)[1]
        return pd.DataFrame({"loglik": [-0.5 * math.exp(tau) * quad + 0.5 * tau * m - 0.5 * logdet]})

    return rows.groupBy("g").applyInPandas(loglik, "loglik double")

"""Statistics of paired benchmark runs: medians and hinges, cost per success, bootstrap intervals and sign tests.

Runs: ``arm, task, tokens, passed, flagged, infra``. Runs that the harness broke (infra) count nowhere but in their number; flagged runs
cost, but their verdict isn't trusted.

Edge cases: a null flag is false, a null number isn't one; fewer than four numbers have their median as both hinges; no clean pass makes the cost
per success infinite; no deltas, no interval; a sign test without untied pairs has p 1; ties of equal numbers don't matter to any result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESAMPLES, SEED = 10_000, 20260904


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def hinges(df: DataFrame, value: str, *by: str) -> DataFrame:
    """``by, n, median, low, high``: the median and the medians of the lower and upper half, without the middle."""
    w = Window.partitionBy(*by)
    ranked = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v")).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy("v")))
    lower, upper = F.col("r") <= F.floor(F.col("n") / 2), F.col("r") > F.floor((F.col("n") + 1) / 2)
    out = ranked.groupBy(*by).agg(F.max("n").alias("n"), F.percentile("v", 0.5).alias("median"), F.percentile(F.when(lower, F.col("v")), 0.5).alias("l"), F.percentile(F.when(upper, F.col("v")), 0.5).alias("h"))
    few = F.col("n") < 4
    return out.select(*by, "n", "median", F.when(few, F.col("median")).otherwise(F.col("l")).alias("low"), F.when(few, F.col("median")).otherwise(F.col("h")).alias("high"))


def arm_stats(runs: DataFrame) -> DataFrame:
    """A row for each arm: how many runs of each sort, tokens, pass rates with flagged runs left out and taken as failures, and cost per success with
    flagged runs' spend (``cps``) and without (``cps_clean``)."""
    infra, flagged = _flag("infra"), _flag("flagged")
    clean, ran = ~infra & ~flagged, ~infra
    won = clean & _flag("passed")
    spent = lambda c: F.coalesce(F.sum(F.when(c, F.col("tokens"))), F.lit(0))
    n = runs.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(infra).alias("n_infra"), F.count_if(ran & flagged).alias("n_flagged"), F.count_if(clean).alias("n_clean"), F.count_if(won).alias("passes"),
        F.count_distinct("task").alias("n_tasks"), F.coalesce(F.max(F.when(ran, F.col("tokens"))), F.lit(0)).alias("max_tokens"), spent(ran).alias("spent"), spent(clean).alias("clean_spent"),
    )
    h = hinges(runs.where(ran), "tokens", "arm").drop("n")
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    cps = lambda s: F.when(F.col("passes") > 0, F.col(s) / F.col("passes")).otherwise(float("inf"))
    out = n.join(h, "arm", "left")
    p, c = F.col("passes"), F.col("n_clean")
    return out.select("arm", "n_total", "n_infra", "n_flagged", "n_clean", "n_tasks", "passes", "max_tokens", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in ("median", "low", "high")], rate(p, c).alias("pass_rate"), rate(p, c + F.col("n_flagged")).alias("pass_rate_flagged_fail"), cps("spent").alias("cps"), cps("clean_spent").alias("cps_clean"))


def paired_deltas(runs: DataFrame, a: str, b: str) -> DataFrame:
    """``task, delta``: of tasks that both arms ran, the difference of their median tokens, ``a`` less ``b``."""
    m = runs.where(~_flag("infra") & F.col("arm").isin(a, b)).groupBy("task").agg(*[F.percentile(F.when(F.col("arm") == x, F.col("tokens")), 0.5).alias(k) for k, x in (("x", a), ("y", b))])
    return m.where("x IS NOT NULL AND y IS NOT NULL").select("task", (F.col("x") - F.col("y")).alias("delta"))


def paired_bootstrap(deltas: DataFrame, *by: str, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """``by, n, low, high``: of each group of deltas (``delta``) the 95 % interval of the median, by resampling with replacement.

    Draw j of resample r is a hash of both, of the seed and of the group, so reruns agree wherever they run. A resample is one row: it draws places in the
    order of the deltas, and only its middle places are looked up. So deltas are never copied, and groups and resamples spread over the tasks.
    """
    keys = list(by)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    ranked = deltas.where("delta IS NOT NULL").select(*keys, "delta").withColumn("place", F.row_number().over(w.orderBy("delta")) - 1)
    sizes = ranked.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 0")
    tries = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r")).repartition(*keys, "r")
    head = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.col("r").cast("string"), F.lit(""))
    draw = lambda j: F.conv(F.substring(F.md5(F.concat(F.col("__head"), j.cast("string"))), 1, 8), 16, 10).cast("long") % F.col("n")
    drawn = tries.withColumn("__head", head).withColumn("d", F.array_sort(F.transform(F.sequence(F.lit(0), F.col("n") - 1), draw)))
    middle = F.array(F.element_at("d", F.floor((F.col("n") + 1) / 2).cast("int")), F.element_at("d", (F.floor(F.col("n") / 2) + 1).cast("int")))
    places = drawn.select(*keys, "n", "r", F.explode(middle).alias("place"))
    same = [places[k].eqNullSafe(ranked[k]) for k in keys]
    medians = places.join(ranked, [*same, places["place"] == ranked["place"]]).groupBy(*[places[k] for k in keys], places["n"], places["r"]).agg(F.avg("delta").alias("m"))
    at = F.row_number().over(w.orderBy("m", "r")) - 1
    lo, hi = int(0.025 * resamples), min(int(0.975 * resamples), resamples - 1)
    picked = medians.withColumn("at", at)
    return picked.groupBy(*keys, "n").agg(F.max(F.when(F.col("at") == lo, F.col("m"))).alias("low"), F.max(F.when(F.col("at") == hi, F.col("m"))).alias("high"))


def sign_test_p(better: Column, total: Column) -> Column:
    """One-sided exact probability of at least so many better pairs of ``total`` untied ones, by logarithms of the terms, so that thousands of pairs don't vanish."""
    b = F.greatest(F.lit(0), F.least(better, total))
    start = F.struct((-total * F.log(F.lit(2.0))).alias("c"), F.lit(0.0).alias("s"))
    step = lambda acc, i: F.struct((acc["c"] + F.log((total - i) / (i + 1.0))).alias("c"), (acc["s"] + F.exp(acc["c"])).alias("s"))
    # the last term's successor may be log 0, which is null and isn't used
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), total - b), start, step)["s"]
    return F.when(total <= 0, 1.0).otherwise(F.least(F.lit(1.0), tail))


def sign_test(deltas: DataFrame, *by: str) -> DataFrame:
    """``by, better, total, p``: how many deltas are below zero, of those that aren't zero, and how likely that many are by chance."""
    n = deltas.groupBy(*by).agg(F.count_if(F.col("delta") < 0).alias("better"), F.count_if(F.col("delta") != 0).alias("total"))
    return n.withColumn("p", sign_test_p(F.col("better"), F.col("total")))

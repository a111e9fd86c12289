"""Statistics of training and reinforcement steps as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IGNORED = -100


def total(x: Column) -> Column:
    return F.aggregate(x.cast("array<double>"), F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def counted_labels(labels: Column) -> Column:
    """Labels that count, all but the ignored ones."""
    return F.size(F.filter(labels, lambda x: x != IGNORED))


def weighted_loss(df: DataFrame, loss: str, tokens: str) -> DataFrame:
    """(loss, perplexity): mean over tokens, and its exponential."""
    mean = F.sum(F.col(loss) * F.col(tokens)) / F.sum(tokens)
    return df.agg(mean.alias("loss")).withColumn("perplexity", F.exp("loss"))


def next_token_hits(predictions: Column, labels: Column) -> Column:
    """Predictions that equal the label one place later, among labels that count."""
    n = F.size(labels)
    ahead = F.zip_with(F.slice(predictions, 1, F.greatest(n - 1, F.lit(0))), F.slice(labels, 2, F.greatest(n - 1, F.lit(0))), lambda p, y: ((p == y) & (y != IGNORED)).cast("int"))
    return F.aggregate(ahead, F.lit(0), lambda a, v: a + v)


def next_token_accuracy(df: DataFrame, predictions: str, labels: str, compat: bool = False) -> DataFrame:
    """Share of hits among the labels that can be predicted; ``compat`` divides by all counted labels instead."""
    y = F.col(labels)
    base = counted_labels(y) if compat else counted_labels(F.slice(y, 2, F.greatest(F.size(y) - 1, F.lit(0))))
    return df.agg((F.sum(next_token_hits(F.col(predictions), y)) / F.sum(base)).alias("accuracy"))


def batch_rewards(df: DataFrame, step: str, reward: str) -> DataFrame:
    """(step, mean, std) of each batch; the sample deviation of one reward is null."""
    return df.groupBy(step).agg(F.avg(reward).alias("mean"), F.stddev_samp(reward).alias("std"))


def trailing(batches: DataFrame, step: str, width: int = 10) -> DataFrame:
    """``batches`` with means of the last ``width`` batch means and deviations, the current one included.

    The window runs over batches, of which there are few beside their rows.
    """
    own = W.orderBy(step).rowsBetween(-(width - 1), 0)
    return batches.withColumn("mean_trailing", F.avg("mean").over(own)).withColumn("std_trailing", F.avg("std").over(own))


def standardised(df: DataFrame, step: str, reward: str, width: int = 10) -> DataFrame:
    """``df`` with ``scaled``: the reward less the trailing mean, over the trailing deviation."""
    t = trailing(batch_rewards(df, step, reward), step, width).select(step, "mean_trailing", "std_trailing")
    return df.join(t, step).withColumn("scaled", (F.col(reward) - F.col("mean_trailing")) / (F.col("std_trailing") + 1e-8)).drop("mean_trailing", "std_trailing")


def best_so_far(batches: DataFrame, step: str, value: str = "mean") -> DataFrame:
    return batches.withColumn("best", F.max(value).over(W.orderBy(step).rowsBetween(W.unboundedPreceding, 0)))


def linear_decay(step: Column, start: float, end: float, steps: int) -> Column:
    """A coefficient that falls linearly from ``start`` to ``end`` within ``steps``, then stays."""
    return F.lit(start) + (end - start) * F.least(F.lit(1.0), step / F.lit(float(steps)))


def tumbling(df: DataFrame, step: str, every: int, **sums: str) -> DataFrame:
    """Sums over groups of ``every`` steps, counted from 1."""
    return df.groupBy(F.floor((F.col(step) - 1) / every).alias("group")).agg(*[F.sum(c).alias(name) for name, c in sums.items()])


def rollout_statistics(df: DataFrame) -> DataFrame:
    """One row over rollouts with arrays kl, logprobs, values, returns, mask and a score: means, deviations, and how much
    of the returns the values explain."""
    masked = lambda c: dot(F.col(c), F.col("mask"))
    length = total(F.col("mask"))
    flat = F.arrays_zip("values", "returns", "mask")
    rows = df.select(masked("kl").alias("kl"), (-masked("logprobs")).alias("surprise"), length.alias("length"), "score", F.filter(flat, lambda z: z["mask"] > 0).alias("z"))
    err = lambda p: F.aggregate("z", F.lit(0.0), lambda a, z: a + F.pow(z["returns"] - (z["values"] if p else 0.0), 2))
    tot = F.aggregate("z", F.lit(0.0), lambda a, z: a + z["returns"])
    res = F.aggregate("z", F.lit(0.0), lambda a, z: a + (z["returns"] - z["values"]))
    r = rows.select("*", err(True).alias("e2"), err(False).alias("r2"), tot.alias("r1"), res.alias("e1"), F.size("z").alias("n"))
    spread = lambda s2, s1: F.sum(s2) / F.sum("n") - F.pow(F.sum(s1) / F.sum("n"), 2)
    return r.agg(
        F.avg("kl").alias("kl"), F.avg(F.col("surprise") / F.greatest("length", F.lit(1.0))).alias("entropy"), F.avg("score").alias("score_mean"), F.stddev_samp("score").alias("score_std"),
        F.avg("length").alias("length_mean"), F.stddev_samp("length").alias("length_std"), (1 - spread("e2", "e1") / spread("r2", "r1")).alias("explained_variance"),
    )


def check_rollouts(df: DataFrame) -> DataFrame:
    """``df`` unchanged, failing at run time where a rollout's arrays differ in length or its score is missing."""
    ok = (F.size("query") > 0) & (F.size("response") > 0) & (F.size("logprobs") == F.size("response")) & F.col("score").isNotNull()
    return df.filter(F.assert_true(ok, F.lit("a rollout has arrays of different lengths or no score")).isNull())


def ppo_loss(ratio: Column, advantage: Column, clip: float = 0.2) -> Column:
    """Clipped policy loss of one token."""
    bounded = F.greatest(F.least(ratio, F.lit(1 + clip)), F.lit(1 - clip))
    return F.greatest(-advantage * ratio, -advantage * bounded)


def value_loss(value: Column, old: Column, returned: Column, clip: float = 0.2) -> Column:
    """Clipped value loss of one token."""
    bounded = F.greatest(F.least(value, old + clip), old - clip)
    return 0.5 * F.greatest(F.pow(value - returned, 2), F.pow(bounded - returned, 2))


def best_of(df: DataFrame, prompt: str, score: str, key: str) -> DataFrame:
    """The best-scored response of each prompt; ties go to the smaller key. Aggregated, not ranked, so hot prompts are light."""
    rest = [c for c in df.columns if c != prompt]
    best = F.max_by(F.struct(*rest), F.struct(score, -F.col(key)))
    return df.groupBy(prompt).agg(best.alias("_b")).select(prompt, "_b.*")


def log_sum_exp(df: DataFrame, value: str) -> DataFrame:
    """log of the sum of exponentials over rows, with the largest taken out first."""
    top = df.agg(F.max(value).alias("_m"))
    return df.crossJoin(F.broadcast(top)).agg((F.first("_m") + F.log(F.sum(F.exp(F.col(value) - F.col("_m"))))).alias("log_sum_exp"))  # top: one row

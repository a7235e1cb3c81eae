"""Reward scores of completions and their standing inside each prompt's group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.functions import text as X
from prefloom.functions.vectors import cosine
from prefloom.operators.skew import salted_join

# A reward is a function of the frame's columns, given by name.
Reward = Callable[..., Column]

# Fixed values.
REWARD_WEIGHT = 2.0
GROUP_SIZE = 8


def mean_pool(df: DataFrame, by: list[str], vector: str, out: str = "embedding") -> DataFrame:
    """One mean vector per key, summed in parts before the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return df.groupBy(*by).agg(vector_to_array(mean).alias(out))


def similarity_reward(completion: Column, chosen: Column, rejected: Column,
                      score_chosen: Column, score_rejected: Column) -> Column:
    """``2 (s_c cos(y, chosen) - s_r cos(y, rejected))``; absent scores count as 0."""
    near = F.coalesce(score_chosen, F.lit(0.0)) * cosine(completion, chosen)
    far = F.coalesce(score_rejected, F.lit(0.0)) * cosine(completion, rejected)
    return F.lit(REWARD_WEIGHT) * (near - far)


def distinct_char_reward(completion: Column, dtype: T.DataType = T.StringType()) -> Column:
    return X.distinct_chars(X.completion_text(completion, dtype)).cast("double")


def apply_reward(df: DataFrame, reward: Reward, columns: dict[str, str], out: str = "reward") -> DataFrame:
    """Adds the reward; ``columns`` maps the function's argument names to column names.

    The function returns a Column: built-in expressions, or a call of a scalar
    ``pandas_udf`` over the same columns.
    """
    return df.withColumn(out, reward(**{arg: F.col(name) for arg, name in columns.items()}))


def zero_score_share(df: DataFrame) -> DataFrame:
    """Share of rows whose two scores are both 0, for which the similarity reward is always 0."""
    zero = (F.coalesce("score_chosen", F.lit(0.0)) == 0) & (F.coalesce("score_rejected", F.lit(0.0)) == 0)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(zero.cast("double")).alias("zero_share"))


def group_advantage(df: DataFrame, group: str, key: list[str], reward: str = "reward",
                    eps: float = 1e-4) -> DataFrame:
    """Adds ``advantage``: the reward standardised inside its group.

    Groups are summarised in parts and joined back, so a large group is not one task.
    A group of one has no spread and gets 0.
    """
    spread = df.groupBy(group).agg(F.avg(reward).alias("_mean"), F.stddev_samp(reward).alias("_sd"))
    joined = salted_join(df, spread, [group], key)
    z = (F.col(reward) - F.col("_mean")) / (F.coalesce("_sd", F.lit(0.0)) + F.lit(eps))
    return joined.withColumn("advantage", z).drop("_mean", "_sd")


def best_of_group(df: DataFrame, group: str, key: str, reward: str = "reward") -> DataFrame:
    """Key and reward of each group's best row; the lowest key wins a tie."""
    best = F.max_by(F.struct(F.col(key), F.col(reward)), F.struct(F.col(reward), -F.col(key)))
    return df.groupBy(group).agg(best.alias("_best")).select(
        group, F.col(f"_best.{key}").alias(key), F.col(f"_best.{reward}").alias(reward))

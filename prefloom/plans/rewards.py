"""Completions to rewards, standings in the group and the best of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame

from prefloom.operators import rewards


def score_rewards(df: DataFrame, reward: rewards.Reward, columns: dict[str, str],
                  group: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Scored rows with their group advantage, and the best row of every group."""
    scored = rewards.apply_reward(df, reward, columns)
    return rewards.group_advantage(scored, group, [key]), rewards.best_of_group(scored, group, key)

"""Methods and metrics by name; add an entry to extend either."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from prefloom.operators import contracts, metrics, project


@dataclass(frozen=True)
class Method:
    """A contract check on the frame and the projection to the method's training rows."""

    check: Callable[[DataFrame], object]
    project: Callable[..., DataFrame]
    shuffled: bool = False


METHODS: dict[str, Method] = {
    "sft": Method(lambda df: contracts.check("sft", df), lambda df, keep: project.sft_rows(df)),
    "dpo": Method(lambda df: contracts.check("dpo", df), lambda df, keep: project.pair_rows(df)),
    "orpo": Method(lambda df: contracts.check("orpo", df), lambda df, keep: project.pair_rows(df)),
    "kto": Method(lambda df: contracts.check("kto", df),
                  lambda df, keep: project.kto_rows(df, keep=keep), shuffled=True),
    "grpo": Method(lambda df: contracts.check("grpo", df), lambda df, keep: project.grpo_rows(df, keep)),
}

# Each takes a frame of per-sample values and returns one row per run.
METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "loss": metrics.loss_metrics,
    "preference": metrics.preference_metrics,
    "training": metrics.training_metrics,
}


def add_method(name: str, method: Method) -> None:
    METHODS[name.lower()] = method


def add_metric(name: str, metric: Callable[[DataFrame], DataFrame]) -> None:
    METRICS[name] = metric


def method(name: str) -> Method:
    found = METHODS.get(name.lower())
    if found is None:
        raise contracts.ContractError(f"unknown method: {name}")
    return found

"""Rewards of generated texts by name, and the loop of rollout, reward and scaling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.prompts import judge_prompt
from marginalia.functions.services import text_service
from marginalia.functions.text import judged_score, structure_score
from marginalia.operators import rollouts

#: Keys of a film record.
FILM_KEYS = ("title", "year", "cast", "genres", "href", "extract")
#: Threads and tries of a judge.
JUDGE_THREADS, JUDGE_TRIES = 32, 8
JUDGES = {
    "llmjudge": "Judge how well the text fits what was asked, as JSON with holistic_score from 1 to 10.\nAsked: {condition}\nText: {response}",
    "llmjudge_biorxiv": "Judge how well the abstract fits its features, as JSON with holistic_score from 1 to 10.\nFeatures: {condition}\nAbstract: {response}",
}

Client = Callable[[], Callable[[str], str]]


def reward(name: str, prompt: Column, response: Column, client: Client | None = None) -> Column:
    """The reward of that name: ``movie-json`` from the structure of a response, others from a judge's answer.

    A judge that fails, or answers without a score, gives null, never a random number.
    """
    if name == "movie-json":
        return structure_score(response, FILM_KEYS)
    if name in JUDGES:
        if client is None:
            raise ValueError(f"{name} needs a client")
        ask = text_service(client, JUDGE_THREADS, JUDGE_TRIES, failed=None)
        return judged_score(ask(judge_prompt(JUDGES[name], prompt, response)))
    raise KeyError(f"unknown reward {name!r}; known are movie-json, {', '.join(sorted(JUDGES))}")


def named_reward(path: str) -> str:
    """The reward that a model path asks for."""
    return next((n for n in sorted([*JUDGES, "movie-json"], key=len, reverse=True) if n in path), "llmjudge")


def rollout_rewards(prompts: DataFrame, step: str, prompt: str, policy: Callable[[Column], Column], name: str, client: Client | None = None, width: int = 10) -> DataFrame:
    """``prompts`` with response, reward and scaled: rollouts of a policy, their rewards, scaled by the trailing batches.

    Rewards that are null stay null and count in no mean.
    """
    rolled = prompts.withColumn("response", policy(F.col(prompt)))
    scored = rolled.withColumn("reward", reward(name, F.col(prompt), F.col("response"), client))
    return rollouts.standardised(scored, step, "reward", width)

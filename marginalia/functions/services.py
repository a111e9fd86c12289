"""Pluggable row functions for models that are not here: clients with retries, and deterministic stand-ins.

The stand-ins (hashed embeddings, rule features, word chains) have the interfaces of the models they stand for, not their
quality.
"""

from __future__ import annotations

import random
import time
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAILED = "GENERATION_ERROR"


def with_retries(call: Callable[[str], str], tries: int = 5, pause: Callable[[float], None] = time.sleep, failed: str | None = FAILED) -> Callable[[str | None], str | None]:
    """``call`` tried again after 2^k seconds and a little; after the last try the result is ``failed``."""

    def run(text: str | None) -> str | None:
        for k in range(tries):
            try:
                return call(text or "")
            except Exception:  # noqa: BLE001 - whatever a client raises
                if k + 1 < tries:
                    pause(2**k + random.random())
        return failed

    return run


def text_service(factory: Callable[[], Callable[[str], str]], threads: int = 8, tries: int = 5, failed: str | None = FAILED):
    """A column function that sends each text to a client; ``factory`` makes the client once in each Python worker.

    Answers keep the order of the rows. Failures give ``failed``: the marker for annotation, null for judges.
    """

    @F.pandas_udf(T.StringType())
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = with_retries(factory(), tries, failed=failed)
        with ThreadPoolExecutor(threads) as pool:
            for texts in batches:
                yield pd.Series(list(pool.map(run, texts)), dtype=object)

    return ask


def hashed_embedding(width: int = 64, words: int = 512):
    """A column function: unit vectors of hashed words of the first ``words`` words, as encoders with a limit read them."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> np.ndarray:
            v = np.zeros(width, np.float32)
            for w in (t or "").lower().split()[:words]:
                h = zlib.crc32(w.encode())
                v[h % width] += 1 if h & 0x10000 else -1
            n = np.linalg.norm(v)
            return v / n if n else v

        return texts.map(one)

    return embed


def word_chain(followers: dict[str, list[str]], words: int = 60, temperature_seed: int = 0) -> Callable[[str], str]:
    """A text generator that walks a table of followers from the last word of the prompt, repeatably."""

    def generate(prompt: str) -> str:
        rnd = random.Random(zlib.crc32(prompt.encode()) + temperature_seed)
        last = (prompt.split() or [""])[-1]
        out = []
        for _ in range(words):
            nexts = followers.get(last) or followers.get("") or []
            if not nexts:
                break
            last = rnd.choice(nexts)
            out.append(last)
        return " ".join(out)

    return generate


def rule_features(rules: dict[str, list[tuple[str, str]]], default: str = "Other") -> Callable[[str], str]:
    """A feature extractor: for each field the option of the first rule whose word occurs, as JSON text."""
    import json

    def extract(text: str) -> str:
        low = text.lower()
        return json.dumps({f: next((o for w, o in pairs if w in low), default) for f, pairs in rules.items()})

    return extract


def top_filtered(logits: np.ndarray, k: int = 0, p: float = 1.0, temperature: float = 1.0) -> np.ndarray:
    """Probabilities after temperature, the k likeliest and the smallest set that reaches p."""
    z = logits / temperature
    q = np.exp(z - z.max())
    q /= q.sum()
    order = np.argsort(-q)
    keep = np.zeros(len(q), bool)
    keep[order[: k or len(q)]] = True
    before = np.cumsum(q[order]) - q[order]
    keep[order[before >= p]] = False
    q = np.where(keep, q, 0)
    return q / q.sum()

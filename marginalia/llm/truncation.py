"""Detection of texts that were cut off, and how often each source cuts.

Intact values are cut artificially to make positives; a hashed logistic regression on closing characters, punctuation
and length-to-limit features is fitted on a bounded, documented sample and then scores every record where it lies.
Field limits come from the length histogram of all records of a source.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.session import bounded_rows

#: Parameters: hashed dimensions, rows of the training sample at most, sources whose limits are kept at most.
DIMENSIONS, SAMPLE_ROWS, MAX_SOURCES = 1 << 15, 16_000, 100_000
#: A length is a source's limit if at least this share, and this many, of its rows end exactly there, at its longest.
LIMIT_SHARE, LIMIT_ROWS = 0.01, 3

#: What transfers and viewers put after a cut.
MARKS = ("...", " ...", "…", " …", " [", "�", " �", " \\u00", "\n", " ", "  ")
_MARK = re.compile(r"(?:\s|\.\.\.|…|\[|�|\\u?[0-9a-fA-F]{0,3})+\Z")
_ESCAPE = re.compile(r"\\u?[0-9a-fA-F]{0,3}\Z")
_SENTENCE = re.compile(r"[.!?][\"'”’)\]]*\s|[。！？]")
_OPEN, _CLOSE = "([{“", ")]}”"


def _closed(text: str) -> bool:
    """Whether ``text`` ends with a sentence's mark and closing marks, or with a closing bracket."""
    return text.rstrip("\"'”’»)]*`_").endswith((".", "!", "?", "。", "！", "？")) or text.rstrip("\"'*`_").endswith((")", "]", "|", "}"))


def _unmarked(text: str) -> str:
    """``text`` (without outer white space) without what was put after a cut."""
    if text.endswith(("...", "…", "[", "�")) or _ESCAPE.search(text[-5:]):
        return _MARK.sub("", text)
    return text


def bare(text: str) -> str:
    """``text`` without outer white space and without fences, quotes or emphasis that surround all of it."""
    t = text.strip()
    if "```" in t:
        t = re.sub(r"\A```\w*\n|\n?```\Z", "", t).strip()
    for mark in ("**", '"', "*"):
        if len(t) > 2 * len(mark) and t.startswith(mark) and t.endswith(mark):
            t = t[len(mark) : -len(mark)].strip()
    return t


def _shape(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word))


def features(text: str, at_limit: float) -> list[str]:
    """Named features of one text; ``at_limit`` is its length as a share of the source's limit, 0 without one."""
    t = bare(text)
    core = _unmarked(t)
    marked = core != t and not (t.endswith("...") and not core)
    lines = core.split("\n")
    last = lines[-1].strip()
    words = core.split()
    tail = words[-1] if words else ""
    ends = _closed(core)
    opened = [sum(core.count(a) - core.count(b) for a, b in zip(_OPEN, _CLOSE)) > 0, core.count('"') % 2 == 1]
    sentences = len(_SENTENCE.findall(core))
    items = re.split(r"[,;]\s+", last)
    listed = len(items) >= 3 and max(len(i.split()) for i in items) <= 4 and not sentences
    is_json = core[:1] in "{["
    whole_json = False
    if is_json:
        try:
            json.loads(core)
            whole_json = True
        except (ValueError, RecursionError):
            pass
    closing = core[-1:] if core[-1:] and not core[-1].isalnum() else "a" if core[-1:].islower() else "9" if core[-1:].isdigit() else "o" if core and ord(core[-1]) > 0x2E80 else "A"
    kind = "json" if is_json else "list" if listed else "row" if last.startswith("|") else "bullet" if re.match(r"[-*•]\s", last) else "field" if len(lines) > 1 and re.match(r"\w+:", last) else "line" if len(lines) > 1 and len(last.split()) <= 6 else "prose"
    short = min(len(words), 6) if not sentences and not is_json else 9
    out = [
        "bias", f"close:{closing}", f"ends:{ends}", f"kind:{kind}", f"kind+ends:{kind}{ends}", f"kind+close:{kind}{closing}", f"json:{is_json}{whole_json}",
        f"open:{opened}", f"mark:{marked}", f"mark+ends:{marked}{ends}", f"sentences:{min(sentences, 4)}", f"short:{short}{ends}{kind}",
        f"tail2:{core[-2:].lower()}", f"tail3:{core[-3:].lower()}", f"tailshape:{_shape(tail)}", f"tailword:{tail.lower()}", f"taillen:{min(len(tail), 8)}",
        f"first:{words[0].lower() if words else ''}{ends}", f"two:{' '.join(words[:2]).lower()}{ends}{kind}",
        f"whole:{core.lower() if len(core) < 40 else ''}", f"lastcap:{last[:1].isupper()}{ends}", f"limit:{'at' if abs(at_limit - 1) < 1e-9 else 'over' if at_limit > 1 else 'under'}{ends}",
        f"limit10:{int(min(at_limit, 1) * 10)}",
    ]
    return out


def _row(text: str, at_limit: float) -> np.ndarray:
    return np.fromiter((zlib.crc32(f.encode("utf-8", "surrogatepass")) % DIMENSIONS for f in features(text, at_limit)), np.int32)


def artificial(text: str, seed: int, limit: int | None) -> tuple[str, float] | None:
    """``text`` cut at a place that ``seed`` chooses, perhaps with a mark after it, and its share of the limit."""
    rng = np.random.default_rng(seed)
    body = bare(text)
    if len(body) < 12:
        return None
    at = int(rng.integers(min(8, len(body) - 2), len(body) - 1))
    cut = body[:at] if rng.random() < 0.75 else body[: max(body.rfind(" ", 0, at), 4)]
    if _closed(cut.rstrip()) and not cut.startswith("{"):
        cut = cut.rstrip().rstrip(".!?。")[:-1]
    mark = MARKS[int(rng.integers(len(MARKS)))] if rng.random() < 0.4 else ""
    at_limit = 1.0 if limit and rng.random() < 0.5 else float(rng.random() * 0.95) if limit else 0.0
    return cut + mark, at_limit


def examples(text: str, limit: int | None, seed: int) -> list[tuple[np.ndarray, float]]:
    """(features, label) of a text if it looks intact (0), and of a cut of it if it can be cut (1)."""
    core = bare(text)
    if not any(c.isalnum() for c in core):
        return []
    prose = bool(_SENTENCE.search(core + " "))
    closed = _closed(core) and not core.endswith(("...", "…", "[", "�"))
    last = core.split("\n")[-1]
    plain = not prose and "{" not in core and (len(core.split()) <= 3 or len(re.split(r"[,;]\s+", core)) >= 4)
    line = "\n" in core and len(last) <= 70
    out = []
    if closed or plain or line:
        out.append((_row(text, len(text) / limit if limit else 0.0), 0.0))
    if closed and (prose or core.startswith("{")) and (made := artificial(text, seed, limit)):
        out.append((_row(*made), 1.0))
    return out


def fit(rows: list[np.ndarray], labels: list[float], epochs: int = 12, rate: float = 0.3) -> np.ndarray:
    """Weights of a logistic regression on rows of hashed features."""
    weights = np.zeros(DIMENSIONS)
    if not rows:
        return weights
    x, y = np.stack(rows), np.array(labels)
    rng = np.random.default_rng(0)
    seen = np.zeros(DIMENSIONS)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for part in np.array_split(order, max(1, len(order) // 64)):
            p = 1 / (1 + np.exp(-np.clip(weights[x[part]].sum(1), -30, 30)))
            grad = np.bincount(x[part].ravel(), np.repeat(p - y[part], x.shape[1]), DIMENSIONS) / len(part)
            seen += grad * grad
            weights -= rate * (grad + 1e-5 * weights) / (np.sqrt(seen) + 1e-3)
    return weights


def records(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(src_table, row_id, source, text) of tables given as name: (table, key column, text column)."""
    out = None
    for name, (df, key, text) in tables.items():
        one = df.select(F.lit(name).alias("src_table"), F.col(key).alias("row_id"), F.col("source"), F.col(text).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def field_limits(rows: DataFrame) -> DataFrame:
    """(src_table, source, limit) where the longest length of a source is one at which many of its rows end."""
    lengths = rows.filter(F.col("text").isNotNull()).groupBy("src_table", "source", F.length("text").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    by = lengths.groupBy("src_table", "source").agg(F.max("n").alias("limit"), F.max_by("rows", "n").alias("at"), F.sum("rows").alias("all"))
    return by.filter((F.col("at") >= LIMIT_ROWS) & (F.col("at") >= LIMIT_SHARE * F.col("all"))).select("src_table", "source", "limit")


def train(rows: DataFrame, limits: dict) -> np.ndarray:
    """Weights from the rows with the lowest hashes, about ``SAMPLE_ROWS`` of them at any size of the input.

    Texts become features where they lie; only the features of the sample come to the driver. Rows of one key count once.
    """
    mark = F.pmod(F.xxhash64("src_table", "row_id"), F.lit(1_000_000_000))
    filled = rows.filter(F.col("text").isNotNull())
    share = min(1.0, SAMPLE_ROWS / max(filled.count(), 1))
    known = rows.sparkSession.sparkContext.broadcast(limits)  # at most MAX_SOURCES limits

    @F.pandas_udf("array<struct<x: binary, y: double>>")
    def made(table: pd.Series, source: pd.Series, text: pd.Series, seed: pd.Series) -> pd.Series:
        each = zip(table, source, text, seed)
        return pd.Series([[{"x": x.tobytes(), "y": y} for x, y in examples(c, known.value.get((t, s)) or None, int(n))] for t, s, c, n in each], dtype=object)

    picked = filled.withColumn("_mark", mark).filter(F.col("_mark") < int(share * 1_000_000_000)).groupBy("_mark").agg(F.min(F.struct("src_table", "source", "text")).alias("_s"))
    coded = picked.select("_mark", made("_s.src_table", "_s.source", "_s.text", "_mark").alias("_e"))
    sample = sorted(bounded_rows(coded, 2 * SAMPLE_ROWS, "training sample"))
    return fit([np.frombuffer(e.x, np.int32) for r in sample for e in r._e], [e.y for r in sample for e in r._e])


def score(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``rows`` with a boolean column ``cut``.

    Null, empty and blank texts, and texts without letter or digit, are not cut. Texts of any length are read whole.
    An empty input gives no rows.
    """
    spark = rows.sparkSession
    limits = {(r.src_table, r.source): r.limit for r in bounded_rows(field_limits(rows), MAX_SOURCES, "field limits")}
    shared = spark.sparkContext.broadcast((train(rows, limits), limits))  # DIMENSIONS numbers and at most MAX_SOURCES limits

    @F.pandas_udf(T.BooleanType())
    def cut(table: pd.Series, source: pd.Series, text: pd.Series) -> pd.Series:
        weights, known = shared.value
        bar = np.log(threshold / (1 - threshold))

        def one(table: str, source: str | None, text: str | None) -> bool:
            if not text or not any(c.isalnum() for c in text):
                return False
            limit = known.get((table, source))
            return bool(weights[_row(text, len(text) / limit if limit else 0.0)].sum() > bar)

        return pd.Series([one(*r) for r in zip(table, source, text)], dtype=bool)

    return rows.withColumn("cut", cut("src_table", "source", "text"))


def cut_rows(rows: DataFrame) -> DataFrame:
    """(src_table, row_id) of the texts that were cut; one row per key, also for redelivered rows."""
    return score(rows).filter("cut").select("src_table", "row_id").distinct()


def cut_shares(rows: DataFrame) -> DataFrame:
    """(src_table, source, rows, cut_rows, share) over distinct keys."""
    each = score(rows).groupBy("src_table", "source", "row_id").agg(F.max("cut").alias("cut"))
    flag: Column = F.sum(F.col("cut").cast("long"))
    return each.groupBy("src_table", "source").agg(F.count(F.lit(1)).alias("rows"), flag.alias("cut_rows")).withColumn("share", F.col("cut_rows") / F.col("rows"))

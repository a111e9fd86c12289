"""Mapping of freely typed values to the entries of a reference list.

Token-level repair: each distinct token of the distinct values is joined to the reference vocabulary by edit distance
(an equality join on deletion neighbourhoods, so no pair is formed that shares no neighbour), then the repaired tokens
rank the complete entries by soft TF-IDF. Rows only meet the result through their distinct value.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.terms import BLANK
from marginalia.session import broadcast_if_small, materialize

#: Edits (insert, delete, replace, swap of neighbours) up to which a token is repaired by the join; neighbourhoods of
#: so many deletions find all such pairs.
REACH = 2
#: Parameters of the decision: least score of a match; share of a stray token's weight that counts against it; score
#: from which a pair is a candidate for the closer look, and up to which a value needs one.
LEAST, STRAY, CANDIDATE, SURE = 0.64, 0.12, 0.2, 0.85
#: Words of the reference list up to which they are sent to the tokens (some 150 neighbours of a few bytes each).
LISTED = 2000
#: Names of the reference list up to which they are broadcast (some 100 bytes each).
ENTRIES = 20_000
#: Tokens that may have been written together, at most; letters at an end of a long token that bring it to a name's word,
#: and the score such a pair needs.
SPAN, GLUE, GLUED = 6, 5, 0.8

_RUN = re.compile(r"[^\W_]+")


def fold(text: str) -> list[str]:
    """Tokens of ``text``: runs of letters and digits without case and diacritics."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _RUN.findall(plain.casefold())


def _singular(token: Column) -> Column:
    return F.when((F.length(token) > 3) & token.rlike("[^s]s$"), F.regexp_replace(token, "s$", "")).otherwise(token)


def edits(a: str, b: str, inside: bool = False) -> tuple[int, int, int]:
    """(edits, start, end): edits from ``b`` to ``a``, a swap of neighbours counting once.

    With ``inside`` they lead to the best stretch ``a[start:end]``, else to all of ``a``.
    """
    before: list = []
    row = [(j, 0) for j in range(len(b) + 1)]
    best = (row[-1][0], 0, 0)
    for i, x in enumerate(a, 1):
        two, before, row = before, row, [(0, i) if inside else (i, 0)]
        for j, y in enumerate(b, 1):
            cell = min((before[j][0] + 1, before[j][1]), (row[j - 1][0] + 1, row[j - 1][1]), (before[j - 1][0] + (x != y), before[j - 1][1]))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                cell = min(cell, (two[j - 2][0] + 1, two[j - 2][1]))
            row.append(cell)
        if row[-1][0] < best[0]:
            best = (*row[-1], i)
    return best if inside else (row[-1][0], 0, len(a))


def distance(a: str, b: str, most: int) -> int:
    """Edits between two tokens, a swap of neighbours counting once; ``most`` + 1 as soon as they exceed ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        two, before, row = before, row, [i]
        left = i
        for j, y in enumerate(b, 1):
            cost = before[j - 1] if x == y else before[j - 1] + 1
            if before[j] < cost:
                cost = before[j] + 1
            if left < cost:
                cost = left + 1
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and two[j - 2] < cost:
                cost = two[j - 2] + 1
            row.append(cost)
            left = cost
        if min(row) > most and (not before or min(before) > most):
            return most + 1
    return min(row[-1], most + 1)


def may_reach(letters: Counter, name: Sequence[str], least: float) -> bool:
    """Whether a value of these letters can have a ``closeness`` of ``least``: each letter it lacks costs an edit."""
    hits = 0
    for word in name:
        lacking = sum((Counter(word) - letters).values())
        if lacking * 2 < len(word) and (len(word) > 3 or not lacking):
            hits += len(word) - lacking
    return hits >= least * sum(map(len, name))


def closeness(tokens: Sequence[str], name: Sequence[str]) -> float:
    """Share of a name's letters that return in a value, whatever the order and the gaps between its words.

    Each word takes a stretch of its own, longer words first; words of three letters or fewer must return unchanged.
    """
    run = "".join(tokens)
    hits = 0
    for word in sorted(name, key=len, reverse=True):
        if (at := run.find(word)) >= 0:
            d, start, end = 0, at, at + len(word)
        else:
            d, start, end = edits(run, word, inside=True)
        if d * 2 < len(word) and (len(word) > 3 or d == 0):
            hits += len(word) - d
            run = run[:start] + " " * (end - start) + run[end:]
    return hits / sum(map(len, name))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [] if t is None else fold(t))


def _less_one(token: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.length(token))))


def neighbours(token: Column) -> Column:
    """The token and all that is left of it after up to two deletions (one, for tokens of three letters or fewer)."""
    one = F.when(F.length(token) > 1, _less_one(token)).otherwise(F.array().cast("array<string>"))
    two = F.when(F.length(token) > 3, F.flatten(F.transform(one, _less_one))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(token), one, two))


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 for equal tokens, less by a fraction for each edit that their length allows, else null."""

    def one(x: str, y: str) -> float | None:
        n = max(len(x), len(y))
        most = 0 if n <= 2 else 1 if n <= 5 else REACH
        d = 0 if x == y else distance(x, y, most)
        return 1 - d / (n + 2) if d <= most else None

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)


def _close_look(pairs: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """(feature, value, item_id, score) of the (feature, value, item_id, tokens) pairs whose closeness reaches ``least``."""

    @F.pandas_udf(T.DoubleType())
    def close(tokens: pd.Series, name: pd.Series) -> pd.Series:
        known: dict[tuple, float | None] = {}
        letters: dict[tuple, Counter] = {}

        def one(ts: tuple, ws: tuple) -> float | None:
            if (ts, ws) not in known:
                if ts not in letters:
                    letters[ts] = Counter("".join(ts))
                score = closeness(ts, ws) if may_reach(letters[ts], ws, least) else 0.0
                known[ts, ws] = score if score >= least else None
            return known[ts, ws]

        return pd.Series([one(tuple(t), tuple(n)) for t, n in zip(tokens, name)], dtype=float)

    # few bytes, much work: as many tasks as the session shuffles into, values of the same tokens in one of them
    spread = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tokens")
    named = spread.join(broadcast_if_small(entries.select("feature", "item_id", F.col("tokens").alias("_name")), ENTRIES), ["feature", "item_id"])
    return named.select("feature", "value", "item_id", close("tokens", "_name").alias("score")).filter("score is not null")


def vocabulary(domain: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, item_id, name_no, tokens, whole) of every name of every entry of the features."""
    names = domain.filter(F.col("feature_name").isin(list(features))).select(
        F.col("feature_name").alias("feature"), "item_id", F.posexplode(F.concat(F.array("option_text"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name_no", "name")
    )
    return names.withColumn("tokens", _fold("name")).withColumn("whole", F.array_join("tokens", "")).filter(F.size("tokens") > 0)


def _deletions(token: str) -> set[str]:
    """As ``neighbours``."""
    one = {token[:i] + token[i + 1 :] for i in range(len(token))} if len(token) > 1 else set()
    two = {t[:i] + t[i + 1 :] for t in one for i in range(len(t))} if len(token) > 3 else set()
    return {token} | one | two


def _near_words(tokens: DataFrame, words: DataFrame, listed: list) -> DataFrame:
    """(feature, token, word): pairs that share a neighbour, found at the tokens in the neighbours of a short list of words."""
    spark = tokens.sparkSession
    at: dict[str, dict[str, list[str]]] = {}
    for feature, word in sorted(map(tuple, listed)):
        own = at.setdefault(feature, {})
        for n in _deletions(word):
            own.setdefault(n, []).append(word)
    shared = spark.sparkContext.broadcast(at)  # neighbours of at most LISTED words

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def near(features: pd.Series, texts: pd.Series) -> pd.Series:
        known = shared.value

        def one(feature: str, token: str) -> list[str]:
            own = known.get(feature, {})
            return sorted({w for n in _deletions(token) if n in own for w in own[n]})

        return pd.Series([one(*x) for x in zip(features, texts)], dtype=object)

    return tokens.select("feature", "token", F.explode(near("feature", "token")).alias("word"))


def repair_tokens(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(feature, token, word, sim): reference words within reach of each distinct token.

    Words up to ``LISTED`` go to the tokens, more are joined to them; either way a pair meets on a common neighbour. A
    single letter stands for the words it begins, as in abbreviated names.
    """
    spread = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    longest = words.groupBy("feature").agg(F.max(F.length("word")).alias("_most"))
    # few bytes, much work: as many tasks as the session shuffles into, which adaptive execution would merge
    near = tokens.join(F.broadcast(longest), "feature").filter(F.length("token") <= F.col("_most") + REACH).drop("_most").repartition(spread, "token")
    listed = words.select("feature", "word").distinct().limit(LISTED + 1).collect()
    if len(listed) <= LISTED:
        pairs = _near_words(near, words, listed)
    else:
        left = near.select("feature", "token", F.explode(neighbours(F.col("token"))).alias("_n"))
        right = words.select("feature", "word", F.explode(neighbours(F.col("word"))).alias("_n"))
        pairs = left.join(right, ["feature", "_n"]).select("feature", "token", "word").distinct().repartition(spread, "token")
    repaired = pairs.withColumn("sim", _similarity(F.col("token"), F.col("word"))).filter("sim is not null")
    letters = tokens.filter(F.length("token") == 1).join(words.filter(F.length("word") > 3).withColumn("token", F.substring("word", 1, 1)), ["feature", "token"])
    return repaired.unionByName(letters.select("feature", "token", "word", F.lit(0.8).alias("sim")))


def rank_entries(values: DataFrame, domain: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value, item_id, score) of the best entry of each distinct value that shares a repaired token with one."""
    entries = materialize(vocabulary(domain, features), "entries")
    parts = entries.select("feature", "item_id", "name_no", F.explode("tokens").alias("word")).withColumn("word", _singular(F.col("word")))
    parts = parts.groupBy("feature", "item_id", "name_no", "word").agg(F.count(F.lit(1)).alias("times"))
    # inverse document frequency over the names of the reference list
    total = entries.groupBy("feature").agg(F.count(F.lit(1)).alias("_names"))
    idf = parts.groupBy("feature", "word").agg(F.count(F.lit(1)).alias("_df")).join(total, "feature").withColumn("idf", F.log(1 + F.col("_names") / F.col("_df"))).select("feature", "word", "idf")
    weights = materialize(parts.join(idf, ["feature", "word"]), "weights")
    norm = weights.groupBy("feature", "item_id", "name_no").agg(F.sum(F.col("times") * F.col("idf")).alias("norm"))
    folded = materialize(values.withColumn("tokens", _fold("value")).filter(F.size("tokens") > 0), "folded")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(SPAN)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("tokens") - n + 1)), lambda i: F.array_join(F.slice("tokens", i, n), ""))))
    pieces = folded.select("feature", "value", F.explode("tokens").alias("token")).withColumn("token", _singular(F.col("token")))
    pieces = pieces.groupBy("feature", "value", "token").agg(F.count(F.lit(1)).alias("have"))
    runs = folded.select("feature", "value", F.explode(F.array_distinct(spans)).alias("token"))
    wholes = entries.select("feature", "item_id", F.col("whole").alias("word")).distinct()
    words = parts.select("feature", "word").union(wholes.select("feature", "word")).distinct()
    tokens = materialize(runs.select("feature", "token").union(pieces.select("feature", "token")).distinct(), "tokens")
    repaired = materialize(repair_tokens(tokens, words), "repaired")

    # soft TF-IDF: each reference word takes its most similar token, and tokens left over count a little against the entry
    matched = pieces.join(repaired.join(weights, ["feature", "word"]), ["feature", "token"])
    hit = F.max(F.col("sim") * F.col("idf")) * F.least(F.max("times"), F.sum("have"))
    by_word = matched.groupBy("feature", "value", "item_id", "name_no", "word").agg(hit.alias("hit"), F.max_by("token", "sim").alias("token"))
    by_name = by_word.groupBy("feature", "value", "item_id", "name_no").agg(F.sum("hit").alias("hit"), F.count_distinct("token").alias("used"))
    stray = F.greatest(F.size(F.array_distinct("tokens")) - F.col("used"), F.lit(0))
    soft = by_name.join(norm, ["feature", "item_id", "name_no"]).join(folded, ["feature", "value"])
    soft = soft.withColumn("score", F.col("hit") / (F.col("norm") + STRAY * stray))
    # names written together or cut at other places: the same repair, over neighbouring tokens without their gaps
    run = runs.join(repaired.filter(F.length("token") > 1), ["feature", "token"]).join(wholes.filter(F.length("word") > 2), ["feature", "word"])
    scored = soft.select("feature", "value", "item_id", "score").unionByName(run.select("feature", "value", "item_id", F.col("sim").alias("score")))
    best = materialize(scored.groupBy("feature", "value", "item_id").agg(F.max("score").alias("score")), "scored")
    # entries of which the repair found only a part: letters of the whole name against the whole value
    unsure = best.groupBy("feature", "value").agg(F.max("score").alias("_top")).filter(F.col("_top") < SURE)
    near = best.filter(F.col("score") >= CANDIDATE).join(unsure, ["feature", "value"]).join(folded, ["feature", "value"])
    close = _close_look(near.drop("score", "_top"), entries, LEAST)
    # names glued to other words: long tokens that begin or end as a word of a name does, by the same closer look
    ends = lambda c: F.explode(F.array(F.concat(F.lit("^"), F.left(c, F.lit(GLUE))), F.concat(F.lit("$"), F.right(c, F.lit(GLUE)))))
    sure = best.groupBy("feature", "value").agg(F.max("score").alias("_top")).filter(F.col("_top") >= SURE)
    long = pieces.filter(F.length("token") >= 2 * GLUE - 2).select("feature", "value", ends(F.col("token")).alias("_e")).join(sure, ["feature", "value"], "left_anti")
    named = parts.filter(F.length("word") >= GLUE).select("feature", "item_id", ends(F.col("word")).alias("_e"))
    met = long.join(named, ["feature", "_e"]).select("feature", "value", "item_id").distinct().join(folded, ["feature", "value"])
    close = close.unionByName(_close_look(met, entries, GLUED))
    top = F.struct("score", -F.col("item_id"))
    return best.unionByName(close).groupBy("feature", "value").agg(F.max_by("item_id", top).alias("item_id"), F.max("score").alias("score"))


def distinct_values(df: DataFrame, key: str, columns: Sequence[str], prefix: str = "map_") -> DataFrame:
    """(key, feature, value) of every value that is neither null nor blank."""
    each = F.explode(F.array(*[F.struct(F.lit(c.removeprefix(prefix)).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]))
    rows = df.select(F.col(key), each.alias("_v")).select(key, "_v.feature", "_v.value")
    return rows.filter(F.col("value").isNotNull() & ~F.col("value").rlike(BLANK))


def map_values(df: DataFrame, key: str, columns: Sequence[str], domain: DataFrame, prefix: str = "map_", scores: bool = False) -> DataFrame:
    """(key, feature_name, item_id) of every typed value: neither null nor blank nor exactly an option.

    ``item_id`` is -1 where no entry is meant. One row per key and column, also for redelivered rows. Values of any
    length are compared whole; an empty table gives no rows and an empty reference list maps everything to -1.
    """
    rows = distinct_values(df, key, columns, prefix)
    exact = domain.select(F.col("feature_name").alias("feature"), F.col("option_text").alias("value")).distinct()
    typed = materialize(rows.join(exact, ["feature", "value"], "left_anti").distinct(), "typed")
    values = typed.select("feature", "value").distinct()
    ranked = rank_entries(values, domain, [c.removeprefix(prefix) for c in columns])
    item = F.when(F.col("score") >= LEAST, F.col("item_id")).otherwise(F.lit(-1))
    out = typed.join(ranked, ["feature", "value"], "left").withColumn("item_id", F.coalesce(item, F.lit(-1)).cast("long"))
    return out.select(key, F.concat(F.lit(prefix), "feature").alias("feature_name"), "item_id", *(["value", "score"] if scores else []))

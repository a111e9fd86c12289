"""Loading of text records into typed columns, with the records that do not load set apart.

Strict load plus anti-join: every raw row keeps its offset (its key), only conforming rows are parsed into columns,
the loaded offsets are subtracted from the raw ones, and just the remainder is diagnosed row by row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.session import bounded_rows

#: The white space that Python's str.strip removes, as a Java character class.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The reasons, in the order in which they are looked for.
REASONS = ("syntax", "columns", "values")

_FENCE = re.compile(r"```(?:json)?(.*)```", re.DOTALL)
_JSON_SPACE = r"[ \t\n\r]*+"
#: A strict JSON string with a bounded number of escapes.
_JSON_STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+){0,%d}+"'


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"^{SPACE}+", ""), rf"{SPACE}+\z", "")


def unwrap(text: Column) -> Column:
    """``text`` without outer white space and without one surrounding Markdown fence (tag ``json`` or none)."""

    def inner(t: Column) -> Column:
        body = F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - 3), r"^```(?:json)?", "")
        return F.when(t.startswith("```") & t.endswith("```") & (F.length(t) >= 6), _bare(body)).otherwise(t)

    return let(_bare(text), inner)


def flat_object_pattern(n: int, escapes: int) -> str:
    """Java pattern of a strict JSON object of exactly ``n`` string members of at most so many escapes each."""
    s, w = _JSON_STRING % escapes, _JSON_SPACE
    member = f"{w}{s}{w}:{w}{s}{w}"
    return rf"^\{{{member}(?:,{member}){{{n - 1}}}\}}\z"


def domain_options(domain: DataFrame, max_rows: int = 20_000) -> dict[str, list[str]]:
    """Options per feature of a (feature_name, option_text) table; the domain is metadata of a checked bound."""
    rows = bounded_rows(domain.select("feature_name", "option_text").distinct(), max_rows, "feature domain")
    out: dict[str, list[str]] = {}
    for feature, option in sorted(tuple(r) for r in rows):
        out.setdefault(feature, []).append(option)
    return out


def strict_load(raw: DataFrame, text: str, options: dict[str, list[str]], into: str = "_loaded") -> DataFrame:
    """Only the conforming rows of ``raw``, with the parsed record as struct column ``into``."""
    names = sorted(options)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    # a character of a name or an option is at most two escapes (of a surrogate pair), so no conforming row is missed
    longest = max(map(len, [*names, *(o for own in options.values() for o in own)]), default=0)
    pattern = flat_object_pattern(len(names), 2 * longest)

    def checked(j: Column) -> Column:
        ok = F.lit(True)
        for n in names:
            ok = ok & F.coalesce(j[n].isin(options[n]), F.lit(False))
        return F.when(ok, j)

    parsed = let(unwrap(F.col(text)), lambda b: F.when(b.rlike(pattern), let(F.from_json(b, schema), checked)))
    return raw.withColumn(into, parsed).filter(F.col(into).isNotNull())


def _refuse(token: str) -> None:
    raise ValueError(token)


def _is_json_deep(body: str) -> bool | None:
    """Whether ``body`` is one strict JSON object, without recursion (for nesting too deep for the parser)."""
    token = re.compile(
        r'[ \t\n\r]*(?:(?P<p>[{}\[\],:])|(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")'
        r"|(?P<v>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))"
    )
    stack: list[str] = []
    want, at = "value", 0
    body = body.rstrip(" \t\n\r")
    while at < len(body):
        m = token.match(body, at)
        if not m:
            return False
        at = m.end()
        p = m["p"]
        if want == "done":
            return False
        if want in ("value", "value or ]") and p in ("{", "["):
            stack.append(p)
            want = "key or }" if p == "{" else "value or ]"
            continue
        if (want == "key or }" and p == "}") or (want == "value or ]" and p == "]") or (want == "next" and p and p in "}]"):
            if not stack or {"{": "}", "[": "]"}[stack.pop()] != p:
                return False
        elif want in ("value", "value or ]") and not p:
            if not stack:
                return False
        elif want in ("key", "key or }") and m["s"]:
            want = "colon"
            continue
        elif want == "colon" and p == ":":
            want = "value"
            continue
        elif want == "next" and p == ",":
            want = "key" if stack[-1] == "{" else "value"
            continue
        else:
            return False
        want = "next" if stack else "done"
    return want == "done" and body.lstrip(" \t\n\r").startswith("{")


def diagnose(text: str | None, options: dict[str, frozenset[str]]) -> str | None:
    """Why ``text`` does not load, or None if it does. Defined for null, blank and arbitrarily nested or long texts."""
    found = record_or_reason(text, options)
    return found if isinstance(found, str) else None


def record_or_reason(text: str | None, options: dict[str, frozenset[str]]) -> str | dict[str, str]:
    """The record that ``text`` holds, or why it does not load."""
    if text is None:
        return "syntax"
    body = text.strip()
    if (m := _FENCE.fullmatch(body)) is not None:
        body = m[1].strip()
    if not body.startswith("{"):
        return "syntax"
    try:
        pairs = json.loads(body, object_pairs_hook=lambda p: ("object", p), parse_constant=_refuse, parse_int=lambda _: 0, parse_float=lambda _: 0.0)
    except ValueError:
        return "syntax"
    except RecursionError:
        return ("values" if _is_json_deep(body) else "syntax") if not _top_names_differ(body, options) else ("columns" if _is_json_deep(body) else "syntax")
    names = [k for k, _ in pairs[1]]
    if len(names) != len(options) or set(names) != set(options):
        return "columns"
    return dict(pairs[1]) if all(isinstance(v, str) and v in options[k] for k, v in pairs[1]) else "values"


def _top_names_differ(body: str, options: dict[str, frozenset[str]]) -> bool:
    names, depth = [], 0
    for m in re.finditer(r'("(?:[^"\\]|\\.)*")([ \t\n\r]*:)?|[{}\[\]]', body):
        if m[0] in "{[":
            depth += 1
        elif m[0] in "}]":
            depth -= 1
        elif depth == 1 and m[2]:
            names.append(json.loads(m[1], strict=False))
    return len(names) != len(options) or set(names) != set(options)


def split_load(raw: DataFrame, key: str, text: str, options: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(loaded, failed) of the records in ``raw[text]``.

    ``loaded`` has ``key`` and a column for each feature; ``failed`` has ``key`` and ``reason``. Either holds one row
    per key: a redelivered row counts once, and a key of which any delivery conforms is loaded. A row that the strict load
    leaves over and the diagnosis finds no fault with is loaded from the diagnosis. Rows whose key is null
    are kept apart by their text. Null and blank texts fail with ``syntax``; other columns of ``raw`` may have any
    name. An empty input gives two empty results.
    """
    names = sorted(options)
    rows = raw.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(0).alias("_salt"))
    rows = rows.withColumn("_off", F.coalesce(F.col("_key").cast("string"), F.lit("")))
    good = strict_load(rows, "_text", options)
    loaded = good.dropDuplicates(["_off", "_salt"]).select(F.col("_key").alias(key), *[F.col("_loaded")[n].alias(n) for n in names])
    rest = rows.join(good.select("_off", "_salt"), ["_off", "_salt"], "left_anti").dropDuplicates(["_off", "_salt"])
    sets = {k: frozenset(v) for k, v in options.items()}

    @F.pandas_udf("reason string, record array<string>")
    def diagnosis(texts: pd.Series) -> pd.DataFrame:
        found = [record_or_reason(t, sets) for t in texts]
        return pd.DataFrame({"reason": [x if isinstance(x, str) else None for x in found], "record": [None if isinstance(x, str) else [x[n] for n in names] for x in found]})

    told = rest.select("_key", diagnosis.asNondeterministic()("_text").alias("_d"))  # else it is run once more for the filter
    failed = told.filter(F.col("_d.reason").isNotNull()).select(F.col("_key").alias(key), F.col("_d.reason").alias("reason"))
    left = told.filter(F.col("_d.reason").isNull()).select(F.col("_key").alias(key), *[F.element_at("_d.record", i + 1).alias(n) for i, n in enumerate(names)])
    return loaded.unionByName(left), failed


def failure_report(failed: DataFrame, raw: DataFrame, key: str, by: Iterable[str]) -> DataFrame:
    """Failed records per reason and the columns ``by`` of the first delivery."""
    keep = raw.select(key, *by).dropDuplicates([key])
    return failed.join(keep, key).groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("records"))

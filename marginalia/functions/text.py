"""Text and JSON column functions: fences, tolerant parsers, option lists, schema files, templates, scores."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.operators.ingest import SPACE

_MAP = T.MapType(T.StringType(), T.StringType())


def strip(c: Column) -> Column:
    """White space of any kind off both ends (``F.trim`` takes spaces only)."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def without_fence(c: Column) -> Column:
    """Without a leading ```json or ``` and a trailing ```, only if the text starts with a fence."""
    t = strip(c)
    body = strip(F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?", ""), r"```\z", ""))
    return F.when(t.startswith("```"), body).otherwise(t)


def _text_of(v: object) -> str | None:
    return v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False)


def _as_map(v: object) -> dict[str, str | None] | None:
    return {str(k): _text_of(x) for k, x in v.items()} if isinstance(v, dict) else None


def _load(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _literal(text: str) -> object:
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None


def _each(texts: pd.Series, one) -> pd.Series:
    return pd.Series([None if t is None else one(t) for t in texts], dtype=object)


@F.pandas_udf(_MAP)
def parse_or_literal(texts: pd.Series) -> pd.Series:
    """JSON object, else a literal in program syntax, else an empty map; null and empty texts give an empty map."""

    def one(t: str | None) -> dict:
        t = (t or "").strip()
        if t.startswith("```"):
            t = re.sub(r"\A```(?:json)?|```\Z", "", t).strip()
        return _as_map(_load(t)) or _as_map(_literal(t)) or {}

    return pd.Series([one(t) for t in texts], dtype=object)


@F.pandas_udf(_MAP)
def parse_sliced(texts: pd.Series) -> pd.Series:
    """JSON object of the text between a seven-letter opening and a three-letter closing, else of all of it, else null."""

    def one(t: str) -> dict | None:
        inner = _as_map(_load(t[7:-3]))
        return inner if inner is not None else _as_map(_load(t))

    return _each(texts, one)


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON in compact form, its characters unescaped and its keys in order; anything else as it is; null as empty."""

    def one(t: str | None) -> str:
        if t is None:
            return ""
        u = t.strip()
        if u.startswith("```"):
            u = re.sub(r"\A```(?:json)?|```\Z", "", u).strip()
        try:
            return json.dumps(json.loads(u), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return t

    return pd.Series([one(t) for t in texts], dtype=object)


def split_options(c: Column) -> Column:
    """Options between bars outside parentheses, trimmed, without empty ones (balanced, not nested parentheses)."""
    return F.filter(F.transform(F.split(c, r"\|(?![^()]*\))"), strip), lambda x: x != "")


def split_outside(text: str, marks: str = "()*") -> list[str]:
    """Options between bars outside (nested) parentheses and, with ``*`` in ``marks``, outside stars."""
    out, depth, starred, now = [], 0, False, ""
    for ch in text:
        if ch == "|" and depth == 0 and not starred:
            out.append(now)
            now = ""
            continue
        depth = depth + (ch == "(") - (ch == ")" and depth > 0)
        starred = starred != (ch == "*" and "*" in marks)
        now += ch
    return [x for x in (p.strip() for p in [*out, now]) if x]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_nested(texts: pd.Series) -> pd.Series:
    """``split_outside`` of each text."""
    return _each(texts, split_outside)


#: Java pattern of a field of a schema file: a name and its option list. The second one allows stars and angle brackets.
FIELD_COMPAT = r'"([\w /-]+)"\s*:\s*"<([^>]*)>"'
FIELD = r'"([^"]+)"\s*:\s*"<(.*?)>"\s*(?:,|//|\}|$|\n)'


def schema_fields(c: Column, compat: bool = False) -> Column:
    """Array of (name, options) of the fields of a schema text; ``compat`` loses fields with unusual names or options."""
    pattern = FIELD_COMPAT if compat else FIELD
    names = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    lists = F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
    return F.zip_with(names, lists, lambda n, o: F.struct(n.alias("name"), split_options(o).alias("options")))


def read_schema(text: str, compat: bool = False) -> dict[str, list[str]]:
    """Fields of a schema text on the driver; a text without any field is an error."""
    pattern = FIELD_COMPAT if compat else FIELD
    found = {n: split_outside(o, "()") for n, o in re.findall(pattern, text, re.MULTILINE)}
    if not found:
        raise ValueError("the schema text names no field")
    return found


_FEATURE = re.compile(r"^\s*\d+[.)]\s*\**\s*([^:*]+?)\s*\**\s*:?\s*\**\s*$|^\s*\d+[.)]\s*\**\s*([^:*]+?)\s*\**\s*:\s*(.*)$")
_VALUES = re.compile(r"(?:possible\s+)?values?\s*\**\s*:\s*\**\s*(.+)", re.IGNORECASE)
_DESCRIPTION = re.compile(r"description\s*\**\s*:\s*\**\s*(.+)", re.IGNORECASE)


@F.udtf(returnType="name string, options array<string>, description string")
class NumberedSchema:
    """(name, options, description) of a numbered feature list as models write it: one row for each feature.

    Options stand in quotes, else between bars, else between commas outside parentheses.
    """

    def eval(self, text: str | None):
        name, options, description = None, [], None
        for line in (text or "").split("\n"):
            if m := _VALUES.search(line):
                body = m[1].strip().strip("*").strip().strip("[]")
                quoted = re.findall(r'"([^"]+)"', body)
                options = quoted or (split_outside(body) if "|" in body else [p.strip() for p in re.split(r",(?![^()]*\))", body) if p.strip()])
            elif m := _DESCRIPTION.search(line):
                description = m[1].strip()
            elif m := _FEATURE.match(line):
                if name:
                    yield name, options, description
                name, options, description = (m[1] or m[2]).strip().lower().replace(" ", "_"), [], None
        if name:
            yield name, options, description


def schema_text(name: Column, options: Column) -> Column:
    """A field of a schema text: its name and its options between bars."""
    return F.concat(F.lit('"'), name, F.lit('": "<'), F.array_join(options, "|"), F.lit('>"'))


def snake(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def spaced(c: Column) -> Column:
    return F.translate(F.lower(c), "_", " ")


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """``template`` with named placeholders replaced; doubled braces become single ones. Nulls fill in as empty."""
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{\{|\}\}|\{(\w+)\}", template):
        parts.append(F.lit(template[at : m.start()]))
        parts.append(F.lit(m[0][0]) if m[1] is None else F.coalesce(values[m[1]].cast("string"), F.lit("")))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def without_affixes(c: Column, prefixes: Sequence[str] = (), suffix: str = "") -> Column:
    """Each prefix in turn, then the suffix, taken off where it is there."""
    for p in prefixes:
        c = F.when(c.startswith(p), F.substring(c, len(p) + 1, 1 << 30)).otherwise(c)
    return F.when(c.endswith(suffix), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(c) if suffix else c


def judged_score(c: Column, field: str = "holistic_score") -> Column:
    """The number after a field name in a judge's answer, else null (never a random score)."""
    return F.nullif(F.regexp_extract(c, rf'"{field}"\s*:\s*"?(-?[0-9]+(?:\.[0-9]+)?)', 1), F.lit("")).cast("double")


def structure_score(c: Column, expected: Sequence[str], each: float = 0.1, bonus: float = 0.4) -> Column:
    """-1 for what is no JSON object; else 1, plus ``each`` for every expected key, less it for extra and missing ones,
    plus ``bonus`` for exactly the expected keys."""
    keys = _object_keys(c)
    want = F.array(*map(F.lit, expected))
    n = lambda x: F.size(x)
    hits, extra, missing = n(F.array_intersect(keys, want)), n(F.array_except(keys, want)), n(F.array_except(want, keys))
    return F.when(keys.isNull(), -1.0).otherwise(F.round(1.0 + each * (hits - extra - missing) + F.when((extra == 0) & (missing == 0), bonus).otherwise(0.0), 4))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _object_keys(texts: pd.Series) -> pd.Series:
    def one(t: str) -> list[str] | None:
        v = _load(t)
        return list(v) if isinstance(v, dict) else None

    return _each(texts, one)


def matching_keys(asked: Column, got: Column) -> Column:
    """How many keys of the first map have the same value in the second; null if either is null."""
    same = F.filter(F.map_keys(asked), lambda k: F.element_at(asked, k) == F.element_at(got, k))
    return F.when(asked.isNotNull() & got.isNotNull(), F.size(same))


def checkpoint_number(path: Column) -> Column:
    """The number after the last ``checkpoint`` of a path, else null."""
    return F.substring_index(F.substring_index(path, "checkpoint", -1), "/", 1).try_cast("int")


def linspace(low: float, high: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(low)) + i * ((high - low) / max(1, n - 1)))


def examples_block(texts: Column) -> Column:
    """``Example i:`` and a text, for each text of an array, with blank lines between."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), t)), "\n\n")

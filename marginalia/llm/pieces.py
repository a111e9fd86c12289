"""Splitting of texts above a token limit at natural boundaries, with overlap.

A text becomes a string with one letter for each of its tokens: the strongest boundary at the token's end. Bounded
quantifiers then count tokens, so a regular expression whose alternatives are ordered by boundary strength cuts the
letter string up to the limit, with a fallback inside words. Lookback offsets from the same letters supply the overlap;
all of that is built-in array functions.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.tokens import encoder, ranks

#: Letters of the boundaries at the end of a token: paragraph, sentence or line, word, inside a word, inside a character.
PARAGRAPH, SENTENCE, WORD, INSIDE, BROKEN = "PSWCX"
#: Tokens left free by a cut inside a word, as its parts may be encoded with a few tokens more.
MARGIN = 24

_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*(?=\S)")
_LINE = re.compile(r"\n[^\S\n]*(?=\S)")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]*_`]*(?=\s)|[。！？](?=[\w\s])")
_WORD = re.compile(r"(?<=\S)(?=\s)")

_MARKED = T.StructType([T.StructField("letters", T.StringType()), T.StructField("ends", T.ArrayType(T.IntegerType()))])


def boundary_letters(text: str, lengths: np.ndarray) -> tuple[str, np.ndarray]:
    """(letters, ends): boundary letter and end offset in characters of each token of ``lengths`` bytes."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    starts = (raw & 0xC0) != 0x80
    byte_end = np.cumsum(lengths)
    whole = np.append(starts, True)[byte_end]
    # characters begun before a byte offset
    ends = np.concatenate([[0], np.cumsum(starts)])[byte_end]
    strength = np.full(len(text) + 1, ord(INSIDE), np.uint8)
    for letter, pattern in ((WORD, _WORD), (SENTENCE, _LINE), (SENTENCE, _SENTENCE), (PARAGRAPH, _PARAGRAPH)):
        strength[[m.end() for m in pattern.finditer(text)]] = ord(letter)
    letters = np.where(whole, strength[ends], ord(BROKEN)).astype(np.uint8)
    return letters.tobytes().decode("ascii"), np.where(whole, ends, ends - 1)


def mark_tokens(vocabulary: Broadcast, limit: int):
    """A column function: letters and end offsets of the tokens of texts above ``limit`` tokens, else null."""

    @F.pandas_udf(_MARKED)
    def mark(texts: pd.Series) -> pd.DataFrame:
        data = vocabulary.value
        encode = encoder(data).encode_ordinary
        table = _lengths(data)
        out = []
        for t in texts:
            # a token has at least one byte, so a text of no more bytes than the limit is not encoded
            ids = encode(t) if t and len(t) * 4 > limit else []
            if len(ids) <= limit:
                out.append((None, None))
                continue
            letters, ends = boundary_letters(t, table[ids])
            out.append((letters, ends.tolist()))
        return pd.DataFrame(out, columns=["letters", "ends"])

    return mark.asNondeterministic()  # else it is run once more for the filter on its result


_TABLES: dict[int, np.ndarray] = {}


def _lengths(data: bytes) -> np.ndarray:
    if id(data) not in _TABLES:
        found = ranks(data)
        table = np.zeros(max(found.values()) + 1, np.int64)
        for b, i in found.items():
            table[i] = len(b)
        _TABLES[id(data)] = table
    return _TABLES[id(data)]


def cut_pattern(limit: int, overlap: int) -> str:
    """Alternatives by boundary strength; the first piece may use the whole limit, later ones leave room for overlap."""

    def one(most: int) -> list[str]:
        # a boundary of each strength in the second half of the room, then one anywhere, then a cut inside a word
        half = most // 2
        strong = [f"[A-Z]{{{half},{most - 1}}}{b}" for b in ("P", "[PS]", "[PSW]")]
        early = [f"[A-Z]{{0,{half - 1}}}{b}" for b in ("P", "[PS]", "[PSW]")]
        return [f"[A-Z]{{1,{most}}}\\z", *strong, *early, f"[A-Z]{{0,{most - MARGIN - 1}}}[^X]", f"[A-Z]{{1,{most}}}"]

    first = "|".join(one(limit))
    return f"^(?:{first})|(?:{'|'.join(one(limit - overlap))})"


def split_long(df: DataFrame, key: str, text: str, vocabulary: Broadcast, limit: int = 512, overlap: int = 64) -> DataFrame:
    """(key, piece, start, end, overlap, text) of every text above ``limit`` tokens, in tokens of the vocabulary.

    Pieces have at most ``limit`` tokens; each begins up to ``overlap`` tokens before the end of the one before it, at
    the earliest sentence there, else the earliest word, else inside a word but never inside a character. Texts up to
    the limit, empty and null ones give no rows. Keys may repeat or be null.
    """
    pattern = cut_pattern(limit, overlap)
    marked = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).withColumn("_m", mark_tokens(vocabulary, limit)("_text")).filter(F.col("_m.letters").isNotNull())
    sizes = F.transform(F.regexp_extract_all("_m.letters", F.lit(pattern), F.lit(0)), F.length)
    cores = marked.select("_key", "_text", F.col("_m.letters").alias("_l"), F.col("_m.ends").alias("_e"), sizes.alias("_n"))

    def bounds(n: Column) -> Column:
        zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"))
        grown = F.aggregate(n, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.struct(F.element_at(acc, -1)["e"].alias("s"), (F.element_at(acc, -1)["e"] + x).alias("e")))))
        return F.slice(grown, 2, F.size(n))

    def back(s: Column, least: Column) -> Column:
        # letters of the tokens before the start; a boundary there is a place to begin
        tail = F.substring(F.col("_l"), F.greatest(s - overlap, least), s - F.greatest(s - overlap, least))
        place = F.coalesce(*[F.nullif(F.regexp_instr(tail, F.lit(p)), F.lit(0)) for p in ("[PS]", "W", "[^X]")], F.length(tail))
        return F.when(s > 0, F.length(tail) - place).otherwise(0)

    cut = cores.withColumn("_b", bounds(F.col("_n")))

    def piece(b: Column, i: Column) -> Column:
        s = b["s"] - F.when(i > 0, back(b["s"], F.element_at("_b", F.greatest(i, F.lit(1)))["s"] + 1)).otherwise(0)
        begin = F.when(s > 0, F.element_at("_e", F.greatest(s, F.lit(1)))).otherwise(0)
        body = F.substring("_text", begin + 1, F.element_at("_e", b["e"]) - begin)
        return F.struct(s.alias("s"), b["s"].alias("c"), b["e"].alias("e"), body.alias("t"))

    # outer: every row has pieces, and the filter that the plain form implies would be pushed down and cut all texts again
    each = cut.select("_key", F.posexplode_outer(F.transform("_b", piece)).alias("piece", "_p"))
    s, c, e = (F.col("_p")[name] for name in "sce")
    return each.select(F.col("_key").alias(key), "piece", s.alias("start"), e.alias("end"), (c - s).alias("overlap"), F.col("_p")["t"].alias("text"))

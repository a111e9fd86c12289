"""Token lists of instruction and answer pairs: truncation, label masks, padding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IGNORED = -100
#: Pattern of the stand-in tokenizer.
PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\t-\r ]"


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def hashed_words(texts: pd.Series) -> pd.Series:
    """Stand-in tokenizer: runs of letters and digits, and single signs, as hashed ids from 10 to 32,009; null gives an empty list."""
    import zlib

    import regex

    find = regex.compile(PATTERN).findall
    return texts.map(lambda t: [10 + zlib.crc32(w.encode()) % 32_000 for w in find(t or "")])


def training_rows(df: DataFrame, instruction: str, answer: str, tokenizer=hashed_words, most_instruction: int = 300, most_answer: int = 512, end: int = 2) -> DataFrame:
    """``df`` with input_ids, attention_mask and labels: both parts cut apart, an end mark added, the instruction masked."""
    rows = df.withColumn("_i", F.slice(tokenizer(instruction), 1, most_instruction)).withColumn("_a", F.slice(tokenizer(answer), 1, most_answer))
    full = F.concat("_i", "_a", F.array(F.lit(end)))
    labels = F.concat(F.array_repeat(F.lit(IGNORED), F.size("_i")), F.col("_a"), F.array(F.lit(end)))
    return rows.select(*df.columns, full.alias("input_ids"), F.array_repeat(F.lit(1), F.size(full)).alias("attention_mask"), labels.alias("labels"))


def prompt_rows(df: DataFrame, prompt: str, tokenizer=hashed_words, most: int = 256) -> DataFrame:
    """``df`` with input_ids: the prompt's tokens, cut."""
    return df.withColumn("input_ids", F.slice(tokenizer(prompt), 1, most))


def padded(ids: Column, length: Column, pad: int, left: bool = False) -> Column:
    fill = F.array_repeat(F.lit(pad), F.greatest(length - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def collate(df: DataFrame, batch: str, pad: int = 0, length: int | None = None, left: bool = False) -> DataFrame:
    """``df`` with its lists padded to the longest of the batch or to ``length``; the mask marks what is no padding."""
    if length is None:
        most = df.groupBy(batch).agg(F.max(F.size("input_ids")).alias("_n"))
        rows = df.join(most, batch)
    else:
        rows = df.withColumn("_n", F.lit(length)).withColumn("input_ids", F.slice("input_ids", 1, length)).withColumn("labels", F.slice("labels", 1, length))
    ids = padded(F.col("input_ids"), F.col("_n"), pad, left)
    return rows.withColumn("labels", padded(F.col("labels"), F.col("_n"), IGNORED, left)).withColumn("input_ids", ids).withColumn("attention_mask", F.transform("input_ids", lambda x: (x != pad).cast("int"))).drop("_n")

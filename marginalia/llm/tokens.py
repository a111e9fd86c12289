"""Encoding of a whole corpus with a byte-level BPE vocabulary, and decoding.

Global distinct-word shuffle. Documents are cut into pre-tokens once. Within a block of neighbouring documents every
distinct pre-token gets a local number, so positions stay in the block as packed numbers and only (block, number, word)
rows travel: one for each distinct word of a block instead of one for each position. Shuffled by word, each distinct
word is encoded once; its ids go back to the blocks, which put their documents together again by position.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.session import materialize

#: Parameter: folder of the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the published pre-token pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text in a block; a longer document is a block of its own.
BLOCK_CHARS = 4_000_000
#: A vocabulary file is broadcast up to this size.
VOCABULARY_BYTES = 16_000_000


def load_vocabulary(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> Broadcast:
    """The vocabulary file ``name`` of ``folder`` as a broadcast of checked size."""
    data = Path(folder, name).read_bytes()
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{name} has {len(data)} bytes; at most {VOCABULARY_BYTES} are broadcast")
    return spark.sparkContext.broadcast(data)


def ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


@lru_cache(maxsize=4)
def encoder(data: bytes):
    """The encoder of a vocabulary, once for each Python worker."""
    import tiktoken

    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks(data), special_tokens={})


def _pack(numbers: np.ndarray) -> bytes:
    import zstandard

    kind = np.uint16 if not len(numbers) or numbers.max() < 65536 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + zstandard.ZstdCompressor(level=3).compress(numbers.astype(kind).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint16 if data[0] == 2 else np.uint32)


def word_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(block, words, keys, sizes, codes): the documents as numbers of their block's distinct pre-tokens."""
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("keys", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("codes", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(PATTERN).findall
        first = TaskContext.get().partitionId() << 33
        out_schema = None
        made, chars = 0, 0
        words: dict[str, int] = {}
        keys: list = []
        sizes: list[int] = []
        codes: list[np.ndarray] = []

        def block(arrow_key: pa.DataType) -> pa.RecordBatch:
            flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([first + made], pa.int64()), pa.array([list(words)], pa.list_(pa.string())), pa.array([keys], pa.list_(arrow_key)), pa.array([sizes], pa.list_(pa.int32())), pa.array([_pack(flat)], pa.binary())],
                names=["block", "words", "keys", "sizes", "codes"],
            )

        for batch in batches:
            out_schema = batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if chars and chars + len(t or "") > BLOCK_CHARS:
                    yield block(out_schema)
                    made, chars, words, keys, sizes, codes = made + 1, 0, {}, [], [], []
                row = [words.setdefault(w, len(words)) for w in find(t)] if t else []
                keys.append(k)
                sizes.append(len(row))
                codes.append(np.array(row, np.uint32))
                chars += len(t or "")
        if keys:
            yield block(out_schema)

    return df.select(key, text).mapInArrow(cut, schema)


def encode(df: DataFrame, key: str, text: str, vocabulary: Broadcast) -> DataFrame:
    """(key, ids) of every row, without special tokens; names of special tokens inside a text are ordinary text.

    Null and empty texts give an empty list. Keys may be null or repeat: every row gives one row. Texts of any length
    and texts without a space are encoded whole.
    """
    kind = df.schema[key].dataType
    blocks = materialize(word_blocks(df, key, text), "word-blocks")
    words = blocks.select("block", F.posexplode("words").alias("n", "word"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_word = encoder(vocabulary.value).encode_ordinary
        last, ids = None, b""
        for batch in batches:
            out = []
            for w in batch.column(2).to_pylist():
                if w != last:
                    last, ids = w, np.array(encode_word(w), np.int32).tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "n", "ids"])

    met = words.repartition("word").sortWithinPartitions("word").mapInArrow(look_up, "block long, n int, ids binary")
    # a block's dictionary is bounded by the block: at most as many entries as it has characters
    found = met.groupBy("block").agg(F.collect_list(F.struct("n", "ids")).alias("found"))
    whole = blocks.select("block", "keys", "sizes", "codes").join(found, "block", "left")
    out_schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {f: batch.column(f)[i] for f in ("keys", "sizes", "codes", "found")}
                codes = _unpack(one["codes"].as_py())
                sizes = one["sizes"].values.to_numpy()
                ids, starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
                if one["found"].is_valid and len(codes):
                    met = one["found"].values
                    n = met.field("n").to_numpy()
                    packed = met.field("ids").take(pa.array(np.argsort(n)))
                    ends = np.concatenate([[0], np.cumsum(pa.compute.binary_length(packed).to_numpy() // 4)])
                    table = np.frombuffer(b"".join(packed.to_pylist()), np.int32)
                    counts = np.diff(ends)[codes]
                    starts = np.concatenate([[0], np.cumsum(counts)])
                    ids = table[np.repeat(ends[:-1][codes] - starts[:-1], counts) + np.arange(starts[-1])]
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                offsets = starts[bounds] if len(codes) else np.zeros(len(sizes) + 1, np.int64)
                for a in range(0, len(sizes), 2000):
                    b = min(a + 2000, len(sizes))
                    part = pa.ListArray.from_arrays(pa.array((offsets[a : b + 1] - offsets[a]).astype(np.int32)), pa.array(ids[offsets[a] : offsets[b]]))
                    yield pa.RecordBatch.from_arrays([one["keys"].values.slice(a, b - a), part], names=[key, "ids"])

    return whole.select("keys", "sizes", "codes", "found").mapInArrow(put_together, out_schema)


def token_bytes(spark: SparkSession, vocabulary: Broadcast) -> DataFrame:
    """(id, hex): the bytes of each token; as many rows as the vocabulary has."""
    return spark.createDataFrame(pd.DataFrame([(i, b.hex().upper()) for b, i in ranks(vocabulary.value).items()], columns=["id", "hex"]).astype({"id": "int32"}))


def decode(encoded: DataFrame, key: str, vocabulary: Broadcast) -> DataFrame:
    """(key, text): the texts of lists of ids, by a join with the token-byte table.

    An empty list gives an empty text, a null one null; bytes that are no UTF-8 become replacement characters.
    """
    rows = encoded.select(F.col(key).alias("_key"), "ids", F.monotonically_increasing_id().alias("_row"))
    table = F.broadcast(token_bytes(encoded.sparkSession, vocabulary))  # a vocabulary file's size is checked on loading
    each = rows.select("_row", "_key", F.posexplode_outer("ids").alias("_n", "id"), F.col("ids").isNull().alias("_null")).join(table, "id", "left")
    text = F.decode(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "hex"))), lambda x: x["hex"]), "")), "UTF-8")
    return each.groupBy("_row", "_key", "_null").agg(text.alias("text")).select(F.col("_key").alias(key), F.when(~F.col("_null"), F.coalesce("text", F.lit(""))).alias("text"))


def count_tokens(vocabulary: Broadcast):
    """A column function: tokens of a text; null and empty texts have none."""

    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        encode_text = encoder(vocabulary.value).encode_ordinary
        return pd.Series([len(encode_text(t)) if t else 0 for t in texts], dtype="int32")

    return count
